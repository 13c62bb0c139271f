"""What must not grow with the tables: rows sent to the driver, in one task, or in one Python batch."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from ravelin.operators import dense, grounding, lexical, pipelines, state, timeline
from ravelin.sources import corpus
from ravelin.sources.digests import Sha256
from ravelin.sources.shared import BATCH_BYTES, BATCH_LIMIT


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_drawn_words_are_not_broadcast(spark):
    docs = spark.createDataFrame([(k, f"one two three{k}") for k in range(50)], "doc_id long, text string")
    assert plan(corpus.synthetic_like(docs, 1000)).count("SortMergeJoin") == 1


def test_slots_get_narrower_with_more_rows(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 + F.when(F.col("id") > 3000, 1000).otherwise(0)).alias("us"), (F.col("id") % 40).cast("double").alias("value"))
    wide = {(r["k"], r["us"]): (r["increase"], r["rate"]) for r in state.counter_rate(rows, 80_000, "k").collect()}
    monkeypatch.setattr(timeline, "SLOT_ROWS", 100)
    width = timeline.fitting(rows, ["k"], "us", 10_000)
    assert rows.groupBy("k", timeline.slot("us", width).alias("s")).count().agg(F.max("count")).first()[0] <= 100
    assert {(r["k"], r["us"]): (r["increase"], r["rate"]) for r in state.counter_rate(rows, 80_000, "k").collect()} == wide
    assert timeline.fitting(rows.withColumn("us", F.lit(5)), ["k"], "us", 10_000) >= 1  # one time cannot be cut


def test_grounding_takes_small_batches(spark):
    spark.conf.unset(BATCH_LIMIT)
    answers = spark.range(0, 6000, 1, 1).select("id", F.lit("One two. Three.").alias("answer"), F.repeat(F.lit("three four five "), 200).alias("context"))
    rows = grounding.sentences(answers, "answer", "context")

    @F.arrow_udf("long")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    assert answers.select(held("context").alias("n")).agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
    assert {tuple(r["missing"]) for r in rows.collect()} == {("one", "two"), ()}


def test_search_reads_texts_once_and_shuffles_none(spark):
    docs = spark.createDataFrame([(k, f"alpha w{k % 7} beta w{k % 5} {'gamma' * (k % 2)}") for k in range(60)] + [(60, None), (61, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w3 gamma"), (2, "alpha w4"), (3, None)], "qid long, query string")
    hits = lexical.bm25(asked, docs, 5)
    assert "regexp_extract_all" not in plan(hits)  # lengths and counts were written by the first pass
    assert {r["qid"] for r in hits.collect()} == {1, 2}
    vectors = dense.hashing_vectors(asked, id_col="qid", text_col="query").withColumnRenamed("id", "qid")
    one, other = dense.hashed_topk(vectors, docs, 5), dense.dense_topk(vectors, dense.hashing_vectors(docs), 5)
    assert one.count() == 10 and one.exceptAll(other).isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = pipelines.with_texts(hits, docs)
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found) and found.count() == 10
        assert "SortMergeJoin" in plan(pipelines.with_texts(hits, docs, most=3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_digest_state_carries_on():
    data, state = bytes(range(256)) * 3, None
    for cut in (data[:1], data[1:64], b"", data[64:700], data[700:]):
        digest = Sha256(state)
        digest.update(cut)
        state = digest.state
    assert digest.hexdigest() == digest.hexdigest() == hashlib.sha256(data).hexdigest()
    assert Sha256().hexdigest() == hashlib.sha256(b"").hexdigest()


def test_corpus_hash_is_made_by_a_chain_of_tasks(spark, monkeypatch):
    long = "é𝄞\n" * 500
    rows = [(k, i, f"{k}::c{i}", long[: k * 7] if k % 9 == 0 else f"text {k} {i}") for k in range(300) for i in range(k % 4)]
    rows += [(7, 9, "7::c9", long), (7, 9, "7::c9", long), (8, 9, "8::c9", ""), (None, 0, None, "no id"), (9, 9, "9::c9", None)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk_id string, text string").repartition(5)
    told = [f"{c}\x01{t}" for _, _, c, t in sorted((r for r in rows if None not in r), key=lambda r: r[:2])]
    monkeypatch.setattr(corpus, "PART_CHARS", 100)
    monkeypatch.setattr(corpus, "RANGE_ROWS", 50)
    monkeypatch.setattr(corpus, "CHAIN_BYTES", 2000)
    taken, absorbing = [], corpus._absorbing
    monkeypatch.setattr(corpus, "_absorbing", lambda state: taken.append(state) or absorbing(state))
    found = corpus.corpus_hash(chunks).first()
    assert (found["corpus_sha256"], found["chunks"]) == (hashlib.sha256("\0".join(told).encode()).hexdigest(), len(rows))
    assert len(taken) > 3 and taken[0] is None and None not in taken[1:]
    assert tuple(corpus.corpus_hash(chunks.filter("text is null")).first()) == (None, 1)  # as SQL: nothing to digest
    assert tuple(corpus.corpus_hash(chunks.limit(0)).first()) == (None, 0)
