"""Text scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 41 stopwords that content tokens leave out.
STOPWORDS = (
    "a an and are as at be by for from has have how in is it its of on or "
    "that the to was were what when where which who why with does do did "
    "not no can could should would"
).split()
IDK = "i don't know"
# Numerals, and words with a capital first letter at the start of a word, in any script.
NUMERAL = r"\p{Nd}[\p{Nd},.]*"
CAPITALISED = r"(?:^|[^\p{L}\p{N}_])([A-Z][a-zA-Z]{2,})"


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens without stopwords; order and repeats stay."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokenize(text), lambda t: ~F.array_contains(stop, t))


def split_sentences(text: Column, keep_blank: bool = False) -> Column:
    parts = F.split(text, r"(?<=[.!?])\s+")
    return parts if keep_blank else F.filter(parts, lambda s: F.trim(s) != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Stripped, non-empty paragraphs; their position counts surviving ones only."""
    return F.filter(F.transform(F.split(text, separator, -1), strip), lambda p: p != "")


def first_sentences(text: Column, n: int = 2, keep_blank: bool = False) -> Column:
    return strip(F.array_join(F.slice(split_sentences(text, keep_blank), 1, n), " "))


def query_prefix(text: Column, n: int = 6) -> Column:
    """The first n white-space words, the query of a workload."""
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, n), " ")


def cache_key(query: Column, corpus: Column, max_tokens: Column) -> Column:
    squeezed = strip(F.regexp_replace(F.lower(query), r"\s+", " "))
    return F.sha2(F.concat_ws("|", F.lit("v1"), corpus, squeezed, F.coalesce(max_tokens.cast("string"), F.lit("None"))), 256)


def client_tag(key: Column) -> Column:
    return F.concat(F.lit("key:"), F.substring(F.sha2(key, 256), 1, 12))


def slug(name: Column, prefix: str = "upload-") -> Column:
    base = F.regexp_replace(F.lower(name), r"\.[^.]*$", "")
    cleaned = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("doc")))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def citation_markers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int"))


def without_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[(\d+)\]", "")


def numerals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMERAL), F.lit(0))


def capitalised(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(1)), F.lower)


def is_idk(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"\.+$", "") == IDK


def prompt(query: Column, chunks: Column) -> Column:
    """Numbered context lines and the question."""
    lines = F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))
    return F.concat(F.lit("Context:\n"), F.array_join(lines, "\n"), F.lit("\n\nQuestion: "), query)


def coverage(tokens: Column, context: Column) -> Column:
    """Share of tokens (with repeats) that the context has; 1 without tokens."""
    present = F.size(F.filter(tokens, lambda t: F.array_contains(context, t)))
    return F.when(F.size(tokens) == 0, 1.0).otherwise(present / F.size(tokens))


def held(tokens: Column, missing: Column) -> Column:
    """How many of the tokens (with repeats) are not among ``missing``, the distinct tokens that a context lacks: a column made with
    ``array_except`` from the context, which is hashed once a row, where looking up each token walks the context."""
    return F.size(tokens) - F.size(F.filter(tokens, lambda t: F.array_contains(missing, t)))


def share_held(tokens: Column, missing: Column) -> Column:
    """``coverage`` by the missing tokens."""
    return F.when((F.size(tokens) == 0) | (F.size(missing) == 0), 1.0).otherwise(held(tokens, missing) / F.size(tokens))
