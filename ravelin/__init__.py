"""Ravelin: retrieval, grounding and evaluation analytics as Spark plans."""
