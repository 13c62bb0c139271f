"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, mixing, periods, quality, toxicity, tries, warc
from ._store import Scratch
from .decontaminate import decontaminate
from .ngram_jaccard import ngram_jaccard
from .phrases import compare_with_next
from .substring import substring_dedup
from .tokens import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digest(chat.format_chats(rows.unionByName(more), tokenizer_file("byte_bpe_50k.json")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = langid.fold("doc_id", 3) == 1
    out = toxicity.score(docs, toxicity.fit(docs, labels, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold("doc_id", 4) == 2
    out = langid.identify(docs, langid.fit(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", F.round("cross_entropy", 4).alias("cross_entropy"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten goes on from word a with the p words from there again and again; a and p follow from the id's checksum."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.periodic_runs(table(spark, sf_dir, "documents"), prepare=repeating))


def regrouped(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every conversation c rebuilt from numbered turns: the first h turns of conversation c - c % 100, then its own after its first
    h; h follows from the id's checksum. A first conversation has a hundred others and five turns at most to give."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    first = F.col("conv_id") - F.col("conv_id") % 100
    heads = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("place") <= 5)).withColumnRenamed("conv_id", "first")
    given = ids.select("conv_id", first.alias("first"), h.alias("h")).join(heads, "first").filter("place <= h").drop("first", "h")
    lent = heads.groupBy("first").agg(F.max("place").alias("most"))
    shift = F.least(F.col("h"), F.coalesce("most", F.lit(0))) - F.col("h")
    own = turns.withColumns({"h": h, "first": first}).filter("place > h").join(lent, "first", "left").withColumn("place", F.col("place") + shift).drop("first", "most", "h")
    return given.unionByName(own)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Scratch(spark, "turns").write(tries.numbered_turns(tries.hashed_turns(table(spark, sf_dir, "conversations"))), "turns")
    ids = turns.select("conv_id").distinct()
    return tries.prefix_trie(regrouped(turns, ids), ids)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_language_id": op8_language_id,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_decontaminate": op10_decontaminate,
    "op11_lz_fingerprints": op11_lz_fingerprints,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {"op4_mixing": mixing.oracle(), "op9_warc_derivatives": warc.oracle()}
