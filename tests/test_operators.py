import collections
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as X
from ravelin.operators import dense, fusion, grounding, learning, lexical, metrics, pipelines, state
from ravelin.sources import corpus, tables, versions
from ravelin.streaming import forms


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text(spark):
    assert one(spark, X.tokenize(F.lit("Nine (9) Otters: dive-2?"))) == ["nine", "9", "otters", "dive", "2"]
    assert one(spark, X.content_tokens(F.lit("Where IS the harbour by now"))) == ["harbour", "now"]
    assert len(one(spark, X.split_sentences(F.lit("Rain fell! Roads shut. Who knew? Nobody.")))) == 4
    assert one(spark, X.paragraphs(F.lit("a\n\n \n\n b "))) == ["a", "b"]
    assert one(spark, X.citation_markers(F.lit("x [1] y [12]"))) == [1, 12]
    assert one(spark, X.slug(F.lit("My File!.TXT"))) == "upload-my-file"
    assert one(spark, X.is_idk(F.lit(" I don't know. ")))
    assert one(spark, X.capitalised(F.lit("éAbc Old_Man Über Tin \u00a0Zinc x1Abc Ab"))) == ["old", "tin", "zinc"]
    assert one(spark, X.numerals(F.lit("a1,5 \u0663. -2"))) == ["1,5", "\u0663.", "2"]


def test_coverage(spark):
    tokens = lambda s: X.content_tokens(F.lit(s))
    assert one(spark, X.coverage(tokens("harbour lights burn green"), tokens("green lights mark the harbour mouth"))) == 0.75
    assert one(spark, X.coverage(tokens("was it not"), tokens(""))) == 1.0


def bm25_plain(queries, docs, k1=1.5, b=0.75):
    tokens = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in docs}
    mean = sum(map(len, tokens.values())) / len(tokens)
    out = []
    for q, text in queries:
        scores = {}
        for term in set(re.findall("[a-z0-9]+", text.lower())):
            df = sum(term in w for w in tokens.values())
            idf = max(0.0, math.log((len(tokens) - df + 0.5) / (df + 0.5) + 1))
            for i, w in tokens.items():
                if term in w:
                    tf = w.count(term)
                    scores[i] = scores.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
        ranked = sorted(((-round(s, 6), i) for i, s in scores.items() if round(s, 6) > 0))
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(ranked, 1)]
    return out


def test_bm25(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("oak elm ash fir yew bay fig".split()) for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    asked = [(1, "oak oak Elm"), (2, "fir?"), (3, "nothing here"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "qid int, query string")
    want = [r for r in bm25_plain(asked, rows) if r[3] <= 7]
    got = lambda frame: sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in frame.collect())
    assert got(lexical.bm25(queries, docs, 7)) == sorted(want)
    lexical.build_index(docs, f"file://{tmp_path}/index", buckets=4)
    assert got(lexical.search_index(queries, f"file://{tmp_path}/index", 7)) == sorted(want)
    with pytest.raises(Exception):
        lexical.build_index(docs, f"file://{tmp_path}/index")
    with pytest.raises(ValueError):
        lexical.build_index(docs.limit(0), f"file://{tmp_path}/other")
    with pytest.raises(ValueError):
        lexical.bm25(queries, docs, 0)


def test_dense(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0]), ("d", [0.5**0.5, 0.5**0.5, 0.0])], "id string, vector array<float>")
    rows = dense.dense_topk(spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "qid int, vector array<float>"), docs, 100).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [("b", 1.0), ("d", 0.707107), ("a", 0.0), ("c", 0.0)]
    with pytest.raises(Exception, match="vectors must have 3 values"):
        dense.dense_topk(spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "qid int, vector array<float>"), docs.union(spark.createDataFrame([("e", [1.0])], docs.schema)), 5).collect()
    ties = spark.range(5000).select(F.col("id"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("vector")).repartition(5)
    found = dense.dense_topk(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "qid int, vector array<double>"), ties, 3).orderBy("qid", "rank").collect()
    assert [r["id"] for r in found] == [0, 1, 2, 0, 2, 4]
    row = dense.hashing_embed(spark.createDataFrame([(1, "raft")], "doc_id int, text string")).first()
    assert (row["bucket"], row["weight"]) == (303, 1.0)


def ranked(spark, *ids):
    return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "qid int, id string, rank int")


def test_rrf(spark):
    rows = fusion.rrf([ranked(spark, "a", "b", "c"), ranked(spark, "c", "b", "a")]).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["a", "c", "b"] and rows[0]["score"] == round(1 / 61 + 1 / 63, 9)
    assert [r["id"] for r in fusion.rrf([ranked(spark, "a"), ranked(spark, "b")]).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        fusion.check_lists([ranked(spark, "a", "a")])
    with pytest.raises(Exception, match="occurs twice"):
        fusion.rrf([ranked(spark, "b"), ranked(spark, "a", "a")]).collect()
    with pytest.raises(ValueError):
        fusion.rrf([ranked(spark, "a")], k=0)


@pytest.mark.parametrize("options,order,status", [({}, ["doc3", "doc1", "doc2"], "full"), ({"budget": 0.0, "cost": 1.0}, ["doc1", "doc2", "doc3"], "skipped_budget"), ({"budget": 2.5, "cost": 1.0}, ["doc1", "doc2", "doc3"], "partial"), ({"depth": 0}, ["doc1", "doc2", "doc3"], "disabled")])
def test_rerank(spark, options, order, status):
    fused = spark.createDataFrame([(1, "doc1", 1, 5.0), (1, "doc2", 2, 1.0), (1, "doc3", 3, 9.0)], "qid int, id string, rank int, rerank_score double")
    rows = fusion.rerank(fused, **({"depth": 3, "final": 3, "batch": 2} | options)).orderBy("position").collect()
    assert [r["id"] for r in rows] == order and {r["status"] for r in rows} == {status}


def test_citations(spark):
    chunks = ["the ferry crosses twice each morning", "gulls nest beneath old cranes"]
    answer = "The ferry crosses each morning [1]. Trains need 42 tickets always [2]. Gulls nest beneath cranes. Gulls nest beneath cranes [1]. Cranes rust [9]. [1]"
    rows = grounding.verdicts(spark.createDataFrame([(1, answer, chunks)], "k int, a string, c array<string>"), "a", "c").orderBy("index").collect()
    assert [r["verdict"] for r in rows] == ["supported", "unsupported", "supported_uncited", "unsupported", "invalid_citation"]


STATUSES = [
    ((0, False, "ok", "none", "x", 1, 0), "no_results"),
    ((2, True, "ok", "none", "x", 1, 0), "ok_no_answer"),
    ((2, False, "none", "ok", "x", 1, 0), "degraded_no_llm"),
    ((2, False, "throttled", "none", "x", 1, 0), "degraded_quota_throttled"),
    ((2, False, "quota_429", "timeout", "x", 1, 0), "degraded_quota"),
    ((2, False, "timeout", "auth", "x", 1, 0), "degraded_timeout"),
    ((2, False, "server_error", "none", "x", 1, 0), "degraded_llm_error"),
    ((2, False, "malformed", "none", "x", 1, 0), "degraded_llm_malformed"),
    ((2, False, "config", "none", "x", 1, 0), "degraded_llm_config"),
    ((2, False, "auth", "none", "x", 1, 0), "degraded_llm_auth"),
    ((2, False, "timeout", "ok", "x", 1, 0), "ok"),
    ((2, False, "ok", "none", "I don't know.", 0, 1), "ok_no_answer"),
    ((2, False, "ok", "none", "x", 0, 3), "degraded_citation_rejected"),
    ((2, False, "ok", "none", "x", 1, 2), "ok_partial_rejected"),
    ((2, False, "ok", "none", "x", 1, 0), "ok"),
]


def test_statuses(spark):
    rows = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(STATUSES)], "i int, r int, w boolean, p string, f string, t string, k int, j int")
    got = {r["i"]: r["s"] for r in rows.select("i", grounding.answer_status(*map(F.col, "rwpftkj")).alias("s")).collect()}
    assert [got[i] for i in range(len(STATUSES))] == [s for _, s in STATUSES]
    codes = spark.createDataFrame([(200, "x", None), (200, " ", None), (429, None, None), (403, None, None), (503, None, None), (404, None, None), (None, None, "timeout"), (None, None, "network")], "c int, b string, f string")
    assert [r["o"] for r in codes.select(grounding.http_outcome(F.col("c"), F.col("b"), F.col("f")).alias("o")).collect()] == ["ok", "malformed", "quota_429", "auth", "server_error", "config", "timeout", "server_error"]


def test_generate(spark):
    docs = spark.createDataFrame([("a", "The ferry crosses at noon. It is slow."), ("b", "Gulls nest on cranes.")], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "ferry noon"), (2, "zebra"), (3, "gulls nest")], "qid int, query string")
    hits = pipelines.hybrid(queries, docs)
    assert {r["status"] for r in hits.collect()} == {"full"}
    assert [r["status"] for r in pipelines.hybrid(queries, docs.limit(0)).collect()] == ["no_candidates"] * 3
    plain = {r["qid"]: r for r in pipelines.generate(queries, hits, docs).collect()}
    assert plain[1]["status"] == "degraded_no_llm" and plain[1]["answer"] == "The ferry crosses at noon. It is slow." and plain[2]["status"] == "ok_no_answer"
    calls = []

    def call(text):
        calls.append(text)
        if "gulls" in text.rsplit("Question", 1)[1]:
            raise pipelines.Outcome("quota_429", 7.0)
        if len(calls) % 2:
            raise pipelines.Outcome("server_error")
        return "The ferry crosses at noon [1]. Dragons fly by night [1]."

    got = {r["qid"]: r for r in pipelines.generate(queries, hits.coalesce(1), docs, call).collect()}
    assert (got[1]["status"], got[1]["answer"], got[1]["citations"]) == ("ok_partial_rejected", "The ferry crosses at noon [1].", "1")
    assert (got[3]["status"], got[3]["retry_after"]) == ("degraded_quota", 7.0) and got[3]["answer"].startswith("Gulls")
    assert {r["qid"]: r["status"] for r in pipelines.generate(queries, hits, docs, call, lambda text: "Gulls nest.").collect()}[3] == "ok"

    class Longest:
        def scores(self, query, passages):
            return [len(p) for p in passages]

    order = [r["id"] for r in pipelines.hybrid(queries.filter("qid = 3"), docs, make=Longest).orderBy("position").collect()]
    assert order == ["a", "b"]


def test_embedders(spark):
    class Tiny:
        embedder_id, dim, failures = "tiny", 2, 0

        def embed(self, texts):
            Tiny.failures += 1
            if Tiny.failures % 3:
                raise OSError("later")
            return np.array([[len(t), 1.0] for t in texts])

    docs = spark.createDataFrame([(i, "x" * i) for i in range(70)], "doc_id long, text string").coalesce(1)
    assert [r["vector"] for r in dense.embed(docs, Tiny, backoff=0).orderBy("id").collect()] == [[float(i), 1.0] for i in range(70)]
    with pytest.raises(Exception, match="later"):
        dense.embed(docs, Tiny, backoff=0, attempts=1).collect()
    ids, mask, kinds = dense.pad([[5, 6, 7], [8], []], most=2)
    assert ids.tolist() == [[5, 6], [8, 0], [0, 0]] and mask.tolist() == [[1, 1], [1, 0], [0, 0]] and not kinds.any()
    states = np.array([[[3.0, 4.0], [9.0, 9.0]]])
    assert np.allclose(dense.pool(states, np.array([[1, 0]])), [[0.6, 0.8]]) and np.allclose(dense.pool(states, np.array([[1, 1]]), "cls"), [[0.6, 0.8]])


def test_training(spark):
    """Newton steps against plain gradient descent of the same loss."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 5, 0] + [0, 2, 7]
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0.8).astype(int)
    names = ["a", "b", "c"]
    rows = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, label int")
    model = learning.train(rows, names, l2=50.0)
    z, n = (x - x.mean(axis=0)) / np.where(x.std(axis=0) < 1e-12, 1, x.std(axis=0)), len(x)
    each = np.where(y == 1, (n - y.sum()) / y.sum(), 1.0)
    each /= each.mean()
    w, b = np.zeros(3), 0.0
    for _ in range(3000):
        error = (1 / (1 + np.exp(-(z @ w + b))) - y) * each
        w -= 0.5 * (z.T @ error / n + 50 * w / n)
        b -= 0.5 * error.mean()
    assert np.allclose(model["coefficients"], w, atol=1e-4) and abs(model["intercept"] - b) < 1e-4
    still = learning.gradient(rows.withColumn("weight", F.when(F.col("label") == 1, float(each.max())).otherwise(float(each.min()))), model, names, 50.0)
    assert all(abs(r["gradient"]) < 1e-6 for r in still.collect())
    assert learning.train(rows.filter("label = 0"), names)["coefficients"] == [0.0] * 3


def test_metrics(spark):
    rows = spark.createDataFrame([(True, True), (True, True), (True, False), (False, True), (False, False), (False, False)], "predicted boolean, actual boolean")
    r = metrics.confusion(rows).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"], r["accuracy"]) == (2, 1, 1, 2, 0.6667, 0.6667)
    scores = lambda *v: spark.createDataFrame(list(v), "score double, actual int")
    assert metrics.auc(scores((0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0))).first()["auc"] == 1.0
    assert metrics.auc(scores((0.5, 1), (0.5, 0))).first()["auc"] == 0.5
    assert metrics.auc(scores((0.5, 1))).first()["auc"] is None
    best = metrics.best_f1(scores((0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0))).first()
    assert (best["threshold"], best["f1"]) == (0.2, 1.0)


def test_state(spark):
    rows = spark.createDataFrame([(i, 1, i * 1000) for i in range(7)] + [(9, 2, 0)], "event_id long, user_id long, us long")
    got = {r["event_id"]: r for r in state.rate_limit(rows, 5, 60_000_000).collect()}
    assert [got[i]["allowed"] for i in range(7)] == [True] * 5 + [False] * 2 and got[9]["allowed"]
    assert [got[i]["remaining"] for i in range(5)] == [4, 3, 2, 1, 0]
    buckets = spark.createDataFrame([(2.0, 1), (3.5, 0), (5.0, 9), (float("inf"), 0)], "le double, n long")
    assert state.histogram_quantile(buckets, 0.95).first()["quantile"] == round(3.5 + 1.5 * 8.5 / 9, 6)
    jobs = spark.createDataFrame([(i, 1, i * 0.01, 10.0) for i in range(4)], "job_id long, server long, at double, seconds double")
    assert [r["admitted"] for r in state.admission(jobs, slots=1, depth=2).orderBy("job_id").collect()] == [True, True, True, False]
    held = spark.createDataFrame([(s, s != 3) for s in range(8)], "step int, active boolean")
    assert [r["step"] for r in state.firing(held, 2).collect()] == [2, 6, 7]


def test_state_edges(spark):
    """Null keys are one key; an open budget stays where it was; breaker, admission and cache against plain versions."""
    rows = spark.createDataFrame([(i, None, i) for i in range(4)], "event_id long, user_id long, us long")
    assert [r["count"] for r in state.rate_limit(rows, 2, 1000).orderBy("event_id").collect()] == [1, 2, 3, 4]
    uses = spark.createDataFrame([(i, "a", i, 30) for i in range(6)], "event_id long, resource string, us long, n int")
    got = state.budget(uses, 100).orderBy("event_id").collect()
    assert [r["used_before"] for r in got] == [0, 30, 60, 90, 90, 90] and [r["open"] for r in got] == [False] * 3 + [True] * 3
    sizes = [(0, 100), (10, 99), (60, 80), (119, 95), (120, None), (180, 75)]
    checks = spark.createDataFrame([(i, "s", t * 1_000_000, v) for i, (t, v) in enumerate(sizes)], "event_id long, store string, us long, size long")
    assert [r["state"] for r in state.storage_breaker(checks, 100).orderBy("event_id").collect()] == ["open", "open", "alert", "alert", "closed", "alert"]

    rng = random.Random(5)
    at = 0.0
    jobs = []
    for i in range(300):
        at += rng.expovariate(2.0)
        jobs.append((i, 1, round(at, 3), round(rng.uniform(0.2, 3.0), 3)))
    frame = spark.createDataFrame(jobs, "job_id long, server long, at double, seconds double")
    free, queue, want = [0.0, 0.0], [], {}
    for i, _, at, took in jobs:  # two servers, first come first served, at most three wait
        queue = [start for start in queue if start > at]
        if min(free) > at and len(queue) >= 3:
            want[i] = None
            continue
        k = free.index(min(free))
        want[i] = max(at, free[k])
        free[k] = want[i] + took
        if want[i] > at:
            queue.append(want[i])
    got = {r["job_id"]: r["start"] for r in state.admission(frame, slots=2, depth=3).collect()}
    assert all((got[i] is None) == (want[i] is None) and (got[i] is None or abs(got[i] - want[i]) < 1e-9) for i in want)

    asked = [(i, 1, rng.choice("abcdef"), i * 10) for i in range(200)]
    held, hits = [], {}
    for i, _, q, us in asked:
        fresh = [s for k, s in held if k == q and us - s < 150]
        hits[i] = bool(fresh)
        if not fresh:
            held = [(k, s) for k, s in held if k != q]
            held = held[max(0, len(held) - 2) :] + [(q, us)]
    assert {r["event_id"]: r["hit"] for r in state.fifo_cache(spark.createDataFrame(asked, "event_id long, server long, query string, us long"), size=3, ttl_us=150).collect()} == hits


def test_streaming(spark, tmp_path):
    """Streams read to their end give what the batch forms give."""
    from pyspark.sql.streaming import StreamingQuery  # noqa: F401

    rows = spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), (F.col("id") * 7 % 60 * 60_000_000).alias("us"))
    rows = rows.withColumn("ts", F.timestamp_micros("us"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(made, mode="append"):
        name = f"t{abs(hash(made)) % 10**9}"
        made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    counts = run(forms.windowed_counts(stream(), "10 minutes", None, "user_id"), "complete")
    want = rows.groupBy(F.window("ts", "10 minutes"), "user_id").agg(F.count("*").alias("n"))
    key = lambda frame: sorted((r["window"]["start"], r["user_id"], r["n"]) for r in frame.collect())
    assert key(counts) == key(want)
    assert run(forms.first_per_day(stream(), "user_id")).count() == 3


def test_reports(spark, tmp_path):
    root = f"file://{tmp_path}"
    store = tables.TableStore(spark, f"{root}/tables")
    store.upsert("docs", spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int"), "doc_id")
    assert sorted(map(tuple, store.upsert("docs", spark.createDataFrame([("b", 2), ("c", 2)], "doc_id string, v int"), "doc_id").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    chunk = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, chunk_index int, text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id string")
    store.replace_chunks("chunks", ids("a", "b"), chunk(("b", 0, "x"), ("a", 1, "y"), ("a", 0, "z")))
    store.replace_chunks("chunks", ids("a"), chunk(("a", 0, "new")))
    store.replace_chunks("chunks", ids("zz"), chunk().limit(0) if False else chunk(("zz", 0, "q")).limit(0))
    assert [tuple(r) for r in store.ordered_chunks("chunks").collect()] == [("a", 0, "new"), ("b", 0, "x")]
    store.log(spark.createDataFrame([(1, "q")], "log_id long, query_text string"), spark.createDataFrame([(1, "a::c0", 1, 0.5), (9, "lost", 1, 0.1)], "log_id long, chunk_id string, rank int, score double"))
    queries, cited = store.logs()
    assert queries.count() == 1 and [r["chunk_id"] for r in cited.collect()] == ["a::c0"]
    rows = spark.createDataFrame([(None, 10, "x"), ("d", 9, None), (None, 9, "y")], "dataset_name string, id long, z string").repartition(3)
    tables.write_reproducible(rows, f"{tmp_path}/sample")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "sample").glob("part-*"))).splitlines()
    assert [json.loads(x)["id"] for x in lines] == [10, 9, 9] and list(json.loads(lines[0])) == ["dataset_name", "id", "z"]
    (tmp_path / "in.txt").write_text("abc")
    report = tables.write_report(spark, root, "run", "20260101T000000Z", spark.createDataFrame([(0.5,)], "p_at_1 double"), {"corpus": f"{root}/in.txt"}, seed=42)
    assert report["inputs_sha256"]["corpus"].startswith("ba7816bf") and json.loads((tmp_path / "run_20260101T000000Z.json").read_text())["metrics"] == {"p_at_1": 0.5}


def test_scans(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"query_id": "1", "query": "q", "relevant_chunk_ids": ["a"], "expected_answer": "x"}\n\n')
    assert corpus.read_eval(spark, str(tmp_path / "e.jsonl")).first()["relevant_chunk_ids"] == ["a"]
    (tmp_path / "f.jsonl").write_text('\n{"query_id": "1", "query": "q"}')
    with pytest.raises(corpus.CorpusFormatError, match=":2: missing expected_answer, relevant_chunk_ids"):
        corpus.read_eval(spark, str(tmp_path / "f.jsonl"))
    (tmp_path / "g.jsonl").write_text('{"id": "1", "documents": ["d", "e"], "response_sentences": [["a", "S."], ["b"], ["c", "T."]], "unsupported_response_sentence_keys": ["c"]}\n\n')
    made = learning.labelled_sentences(corpus.read_grounding(spark, str(tmp_path / "g.jsonl"))).orderBy("index").collect()
    assert [(r["key"], r["label"], r["total"], r["context"]) for r in made] == [("a", 0, 2, "d\n\ne"), ("c", 1, 2, "d\n\ne")]
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "A b.md").write_text("one\r\n\r\ntwo")
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "d.exe").write_bytes(b"x")
    (folder / "e.txt").write_text("\n\n".join("p" * 201))
    got = {r["doc_id"]: (r["paragraphs"], r["reason"]) for r in corpus.read_uploads(spark, str(folder)).collect()}
    assert got["upload-a-b"] == (2, None) and got["upload-c"][1] == got["upload-d"][1] == "unsupported file type" and got["upload-e"] == (201, "more than 200 paragraphs")
    assert {r["doc_id"]: r["text"] for r in corpus.read_uploads(spark, str(folder), lambda data: "page").collect()}["upload-c"] == "page"
    lines = spark.createDataFrame([("# HELP x",), ('x_total{a="1",b="c d"} 3.5',), ("y 2",)], "value string")
    assert [(r["metric"], r["labels"], r["value"]) for r in corpus.read_metrics(lines).collect()] == [("x_total", {"a": "1", "b": "c d"}, 3.5), ("y", {}, 2.0)]
    assert [r["n"] for r in corpus.synthetic(spark, 20).select(F.size(F.split("text", " ")).alias("n")).collect()] == [r["n"] for r in corpus.synthetic(spark, 20).select(F.size(F.split("text", " ")).alias("n")).collect()]

    class Rows(tables.PagedSource):
        fetch = staticmethod(lambda first, n: [{"v": first + i} for i in range(n)])

        @classmethod
        def name(cls):
            return "rows_of_pages"

    spark.dataSource.register(Rows)
    places = tables.sampled_places(1000, 5, "42:x")
    read = spark.read.format("rows_of_pages").options(total="1000", wanted=",".join(map(str, places))).load()
    assert sorted((r["place"], json.loads(r["row"])["v"]) for r in read.collect()) == [(p, p) for p in places] and len(places) == 5


def test_sources(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text(json.dumps({"doc_id": "d1", "title": "t", "text": "para one.\n\npara two."}) + "\n\n")
    assert [r["chunk_id"] for r in corpus.load_strict(spark, str(path)).orderBy("chunk_index").collect()] == ["d1::c0", "d1::c1"]
    path.write_text("\n".join([json.dumps({"doc_id": str(i), "title": "t", "text": "x"}) for i in range(30)] + ["{bad", "[1]"]))
    good, bad = corpus.load_lenient(spark, str(path))
    assert (good.count(), bad.count()) == (30, 2)
    with pytest.raises(corpus.CorpusFormatError):
        corpus.load_strict(spark, str(path))
    path.write_text('{"doc_id":"a","title":"t","text":5}\n{"doc_id":"b","title":"t","text":"x"}')
    assert [r["reason"] for r in corpus.validate(corpus.read_lines(spark, str(path))).collect()] == ["text must be a non-empty string", None]
    path.write_text('{"doc_id":"a","title":"t"}\n{"doc_id":"a","title":"t","text":" "}')
    with pytest.raises(corpus.CorpusFormatError):
        corpus.load_lenient(spark, str(path))


def test_versions(spark, tmp_path):
    store = versions.VersionStore(spark, f"file://{tmp_path}/index")
    store.write("v1", spark.range(5), dim=3)
    assert store.read("v1").count() == 5
    with pytest.raises(FileExistsError):
        store.write("v1", spark.range(5))
    for name, created in (("v1", 1), ("v2", 2), ("v3", 3)):
        store.begin(name, created)
    store.ready("v1")
    store.activate("v1")
    store.ready("v2")
    store.failed("v3", "e" * 3000)
    assert len(store.registry()["v3"]["error"]) == 2000
    with pytest.raises(ValueError):
        store.ready("v3")
    store.activate("v2")
    assert store.rollback() == "v1" and store.registry()["v2"]["status"] == "rolled_back"
    store.write("v2", spark.range(2))
    assert store.collect_garbage() == ["v2"]
    spark.range(6).write.mode("overwrite").parquet(f"file://{tmp_path}/index/v1/data")
    with pytest.raises(versions.IndexIntegrityError):
        store.read("v1")


def test_entry():
    import __spark_entry__ as e

    assert len(e.queries()) >= 70 and set(e.oracle_sql()) <= set(e.queries())
