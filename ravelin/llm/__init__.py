"""Operators for preparing language-model training data. Nothing else in ravelin imports this package."""
