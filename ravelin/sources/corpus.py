"""Corpus sources: strict and lenient JSONL, uploads, evaluation sets, metric text; and classification for ingestion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise_newlines, paragraphs, slug
from ..operators.ordered import numbered
from .digests import Sha256
from .lines import read_lines
from .shared import Files, fresh_path, small_batches, written

REQUIRED = ("doc_id", "text", "title")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "title", "text", "source")])
MALFORMED_LIMIT = 0.10
UPLOAD_PARAGRAPHS = 200


class CorpusFormatError(ValueError):
    pass


def validate(lines: DataFrame) -> DataFrame:
    """The fields of each line (file, line, row, value) and ``reason``, null for a valid one."""
    keys = F.json_object_keys("value")
    missing = F.array_sort(F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: ~F.array_contains(keys, k)))
    rows = lines.select("file", "line", "row", "value", keys.alias("keys"), missing.alias("missing"), F.from_json("value", SCHEMA).alias("d"))
    told = F.try_parse_json("value")
    text = F.when(F.schema_of_variant(F.try_variant_get(told, "$.text", "variant")) == "STRING", F.try_variant_get(told, "$.text", "string"))
    reason = (
        F.when(F.col("keys").isNull(), "not a JSON object")
        .when(F.size("missing") > 0, F.concat(F.lit("missing fields: "), F.array_join("missing", ", ")))
        .when(text.isNull() | ~text.rlike(r"\S"), "text must be a non-empty string")
    )
    return rows.select("file", "line", "row", reason.alias("reason"), "d.*")


def load_strict(spark: SparkSession, path: str, separator: str = "\n\n") -> DataFrame:
    """Chunks of a corpus; any bad line, or no line, is an error."""
    rows = validate(read_lines(spark, path))
    bad = rows.filter("reason is not null").orderBy("file", "line").first()
    if bad:
        raise CorpusFormatError(f"{bad['file']}:{bad['line']}: {bad['reason']}")
    made = chunk(rows, separator)
    if rows.isEmpty() or not rows.join(made, "doc_id", "left_anti").isEmpty():
        raise CorpusFormatError(f"{path}: empty corpus or document")
    return made


def load_lenient(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and a quarantine (file, line, reason); an error if none is good or more than a tenth is bad."""
    rows = validate(read_lines(spark, path))
    n = rows.agg(F.count("*").alias("all"), F.count("reason").alias("bad")).first()
    if n["all"] == n["bad"] or n["bad"] / n["all"] > MALFORMED_LIMIT:
        raise CorpusFormatError(f"{n['bad']} of {n['all']} lines are malformed")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("file", "line", "reason")


def chunk(docs: DataFrame, separator: str = "\n\n", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk_id, text, text_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(paragraphs(F.col(text_col), separator)).alias("chunk_index", "text"))
    return rows.select("doc_id", "chunk_index", F.concat(F.col("doc_id").cast("string"), F.lit("::c"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", F.sha2("text", 256).alias("text_sha256"))


#: A chunk's text goes through the shuffle of ``corpus_hash`` in parts of so many characters, so many rows to a range; a task of the
#: chain takes consecutive ranges of so many bytes, or one.
PART_CHARS, RANGE_ROWS, CHAIN_BYTES = 4096, 1 << 16, 256 << 20


def corpus_hash(chunks: DataFrame) -> DataFrame:
    """One row: the SHA-256 of ids and texts of all chunks in order of doc_id (nulls last) and chunk_index, and their number; null
    without any. A chunk without id or text counts, but adds nothing. Chunks that share doc_id and index come in an order that their
    contents settle.

    Ranges of the order are sorted side by side and written as blocks of bytes. One digest over everything is sequential, so then job
    follows job: a task takes the next ``CHAIN_BYTES`` of blocks and hands the digest's state (112 bytes) by the driver to the next. All
    runs when this is called. What a task reads does not grow with the corpus, the number of these jobs does; ``corpus_digest`` needs none."""
    spark = chunks.sparkSession
    small_batches(spark)
    whole = F.col("chunk_id").isNotNull() & F.col("text").isNotNull()
    parts = F.greatest(F.ceil(F.length("text") / PART_CHARS), F.lit(1))
    size = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.when(whole, parts)), F.lit(0)).alias("rows")).first()

    # The row's number keeps parts of equal chunks apart; it must be made before the parts are.
    rows = chunks.filter(whole).select("doc_id", "chunk_index", "chunk_id", F.xxhash64("chunk_id", "text").alias("tie"), "text").withColumn("row", F.monotonically_increasing_id())
    cut = F.when(F.length("text") > PART_CHARS, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART_CHARS}}}"), F.lit(0))).otherwise(F.array("text"))
    rows = rows.select("doc_id", "chunk_index", "chunk_id", "tie", "row", F.posexplode(cut).alias("part", "text"))
    head = F.when(F.col("part") == 0, F.concat(F.lit("\x00"), "chunk_id", F.lit("\x01"))).otherwise("")
    rows = rows.select("doc_id", "chunk_index", "tie", "row", "part", F.concat(head, "text").cast("binary").alias("bytes"))
    order = [F.asc_nulls_last("doc_id"), F.asc_nulls_last("chunk_index"), "tie", "row", "part"]
    ordered = rows.repartitionByRange(max(1, -(-size["rows"] // RANGE_ROWS)), *order).sortWithinPartitions(*order).select("bytes")

    def joined(batches):
        for seq, batch in enumerate(batches):
            block = b"".join(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([len(block)]), pa.array([block], pa.binary())], ["seq", "size", "block"])

    path, schema = fresh_path(spark, "corpus-blocks"), "seq long, size long, block binary"
    blocks = ordered.mapInArrow(joined, schema).withColumn("range", F.spark_partition_id())
    blocks.sortWithinPartitions("range", "seq").write.partitionBy("range").parquet(path)
    stored = spark.read.schema(f"{schema}, range int").option("basePath", path)
    digest, state = Sha256(), None
    for ranges in _runs(stored.parquet(path).groupBy("range").agg(F.sum("size").alias("size")).orderBy("range").collect(), CHAIN_BYTES):
        some = stored.parquet(*(f"{path}/range={k}" for k in ranges)).coalesce(1).sortWithinPartitions("range", "seq").select("block")
        state = some.mapInArrow(_absorbing(state), "state binary").first()["state"]
        digest = Sha256(bytes(state))
    Files(spark, path).delete("")
    return spark.range(1).select(F.lit(digest.hexdigest() if state else None).cast("string").alias("corpus_sha256"), F.lit(size["chunks"]).cast("long").alias("chunks"))


def _runs(ranges: list, most: int) -> list[list[int]]:
    """Consecutive ranges of so many bytes in all, or single ones."""
    runs, held = [], 0
    for r in ranges:
        if not runs or held + r["size"] > most:
            runs.append([])
            held = 0
        runs[-1].append(r["range"])
        held += r["size"]
    return runs


def _absorbing(state: bytes | None):
    def run(batches):
        digest, first = Sha256(state and bytes(state)), state is None
        for batch in batches:
            for block in batch.column(0):
                data = block.as_py()
                digest.update(data[1:] if first else data)  # no separator before the first chunk
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([digest.state], pa.binary())], ["state"])

    return run


def corpus_digest(chunks: DataFrame) -> DataFrame:
    """One row: a digest of the chunks in any order (the sum of their digests' first 60 bits), and their number."""
    one = F.conv(F.substring(F.sha2(F.concat("chunk_id", F.lit("\x01"), "text"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return chunks.agg(F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("digest"), F.count("*").alias("chunks"))


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, changed or unchanged by content digest; of ids that repeat within ``new`` the later row counts (ord)."""
    latest = new.groupBy("doc_id").agg(F.max_by("sha", "ord").alias("sha"))
    known = old.select("doc_id", F.col("sha").alias("was"))
    return latest.join(known, "doc_id", "left").select("doc_id", F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("sha"), "unchanged").otherwise("changed").alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_jsonl(docs: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Documents as JSON lines in so many files at most (``spark.sql.shuffle.partitions`` where none is said), whose names sort as the key
    does: ranges of the key, sorted and written side by side. The files' contents one after the other are the same however they are
    cut; null keys come first."""
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(files, F.asc_nulls_first(key)).sortWithinPartitions(F.asc_nulls_first(key))
    ordered.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.option("lineSep", "\n").text(path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries of a JSONL file: query_id, query, relevant_chunk_ids, expected_answer. A line without one of these, or a file
    without lines, is an error; blank lines are passed over."""
    fields = ("query_id", "query", "relevant_chunk_ids", "expected_answer")
    lines = read_lines(spark, path)
    missing = F.array_sort(F.filter(F.array(*map(F.lit, fields)), lambda k: ~F.array_contains(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), k)))
    bad = lines.select("file", "line", missing.alias("missing")).filter(F.size("missing") > 0).orderBy("file", "line").first()
    if bad:
        raise CorpusFormatError(f"{bad['file']}:{bad['line']}: missing {', '.join(bad['missing'])}")
    if lines.isEmpty():
        raise CorpusFormatError(f"{path}: empty evaluation set")
    return lines.select("line", F.from_json("value", "query_id string, query string, relevant_chunk_ids array<string>, expected_answer string").alias("d")).select("line", "d.*")


def read_grounding(spark: SparkSession, path: str) -> DataFrame:
    """Labelled responses of a JSONL file, blank lines passed over."""
    schema = "id string, dataset_name string, documents array<string>, response_sentences array<array<string>>, unsupported_response_sentence_keys array<string>, adherence_score boolean"
    return read_lines(spark, path).select(F.from_json("value", schema).alias("d")).select("d.*")


def read_uploads(spark: SparkSession, path: str, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """Uploads: doc_id, text, paragraphs and ``reason`` (null: accepted). Text files are .txt and .md; .pdf files go through
    ``pdf_text``. Other types, unreadable files, and those without or with too many paragraphs are rejected with their reason."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    plain, pdf = F.lower(name).rlike(r"\.(txt|md)$"), F.lower(name).endswith(".pdf")
    text = F.when(plain, F.decode("content", "UTF-8"))
    if pdf_text:

        @F.pandas_udf("string")
        def extracted(content: pd.Series) -> pd.Series:
            return content.map(pdf_text)

        text = text.when(pdf, extracted("content"))
    rows = files.select(slug(name).alias("doc_id"), normalise_newlines(text).alias("text"), (plain | (pdf & F.lit(pdf_text is not None))).alias("known"))
    rows = rows.withColumn("paragraphs", F.size(paragraphs(F.coalesce("text", F.lit("")))))
    reason = F.when(~F.col("known"), "unsupported file type").when(F.col("paragraphs") < 1, "no text").when(F.col("paragraphs") > UPLOAD_PARAGRAPHS, f"more than {UPLOAD_PARAGRAPHS} paragraphs")
    return rows.select("doc_id", "text", "paragraphs", reason.alias("reason"))


def read_metrics(lines: DataFrame) -> DataFrame:
    """Prometheus text lines (value) -> metric, labels, value."""
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})? ([^ ]+)"
    rows = lines.filter(~F.col("value").startswith("#") & F.col("value").rlike(pattern))
    pairs = F.regexp_extract_all(F.regexp_extract("value", pattern, 2), F.lit(r'([a-zA-Z_]+="[^"]*")'), F.lit(1))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r'^([^=]+)=', 1), F.regexp_extract(p, r'="([^"]*)"', 1))))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("metric"), labels.alias("labels"), F.regexp_extract("value", pattern, 3).cast("double").alias("value"))


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows a group, by the md5 of seed and key."""
    from pyspark.sql import Window as W

    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(h, key))).filter(F.col("place") <= k)


def synthetic(spark: SparkSession, n: int, vocabulary: int = 5000, seed: int = 42) -> DataFrame:
    """n documents of 80 to 120 words, word i with weight 1/(i+1)."""
    length = 80 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(41))
    unit = lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    word = lambda i: F.concat(F.lit("w"), F.floor(F.pow(F.lit(float(vocabulary)), unit(i))).cast("string"))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), length.cast("int")), word), " ").alias("text"))


#: Words that are joined by a broadcast; drawn words beyond them are rare enough for a shuffle.
FREQUENT = 10_000


def vocabulary(docs: DataFrame, seed: int = 42, *, text_col: str = "text") -> DataFrame:
    """The distinct lower-case white-space words of all texts (word, i), numbered from 0 in an order that the seed shuffles."""
    words = docs.select(F.explode(F.array_distinct(F.filter(F.split(F.lower(F.col(text_col)), r"\s+"), lambda w: w != ""))).alias("word")).distinct()
    shuffled = written(words.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "word"))), "vocabulary")
    return numbered(shuffled, ["h", "word"], "i").select("word", "i")


def synthetic_like(docs: DataFrame, n: int, seed: int = 42, *, text_col: str = "text") -> DataFrame:
    """n documents (doc_id, text) of 80 to 120 words each, drawn from the words of these texts with weight 1/(i+1) for word i, so that
    their tokens are as long as real ones. The first ``FREQUENT`` words, which hold most draws, come by a broadcast, the others by a
    shuffle in which no word has more than about 1/``FREQUENT`` of the draws. Without words there is no document."""
    spark = docs.sparkSession
    words = written(vocabulary(docs, seed, text_col=text_col), "numbered")
    size = words.count()
    if not size:
        return spark.createDataFrame([], "doc_id long, text string")
    chance = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")
    made = spark.range(n).select(F.col("id").alias("doc_id"), (80 + chance(F.col("id")) % 41).cast("int").alias("length"))
    drawn = made.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("place"))
    unit = chance(F.col("doc_id"), F.col("place")) / F.lit(float(1 << 32))
    drawn = drawn.withColumn("i", F.least(F.floor(F.pow(F.lit(float(size + 1)), unit)) - 1, F.lit(size - 1)))
    often = drawn.filter(F.col("i") < FREQUENT).join(F.broadcast(words.filter(F.col("i") < FREQUENT)), "i")
    # Spark takes the drawn words for as few rows as there are documents, and would send them all to the driver for a broadcast.
    seldom = drawn.filter(F.col("i") >= FREQUENT).hint("merge").join(words.filter(F.col("i") >= FREQUENT), "i")
    whole = often.unionByName(seldom).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return whole.select("doc_id", F.array_join("w.word", " ").alias("text"))
