"""Statistics of whole tables, missing tokens of sentences, ranking by relevance alone, and texts of a real vocabulary."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ravelin.operators import fusion, grounding, metrics
from ravelin.sources import corpus


def test_completeness(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, None), (2, None, math.nan, None), (2, None, math.nan, None)], "k int, `a.b` string, v double, n long")
    got = {r["column_name"]: (r["type"], r["present"], r["missing"], r["percent"]) for r in metrics.completeness(rows).collect()}
    assert got == {"k": ("int", 3, 0, 100.0), "a.b": ("string", 1, 2, 33.333333), "v": ("double", 1, 2, 33.333333), "n": ("bigint", 0, 3, 0.0)}
    shape = {r["type"]: r.asDict() for r in metrics.table_shape(rows).collect()}
    assert shape["string"] == {"type": "string", "columns": 1, "missing": 2, "rows": 3, "duplicated": 1, "all_columns": 4}
    assert {r["percent"] for r in metrics.completeness(rows.limit(0)).collect()} == {None}
    assert metrics.table_shape(rows.limit(0)).first()["rows"] == 0


def test_duplicates_tell_null_from_text(spark):
    rows = spark.createDataFrame([(None, "x"), ("x", None), ("", "x"), (None, "x")], "a string, b string")
    assert metrics.table_shape(rows).first()["duplicated"] == 1


@pytest.mark.parametrize("values", [[0.0, 1.0, 0.5, 0.25, 0.999], [3.0, 3.0], [-2.5, 8.0, 8.0, 1.0, None, math.nan, math.inf]])
def test_histogram(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    want, edges = np.histogram([v for v in values if v is not None and math.isfinite(v)], bins=28)
    got = metrics.histogram(rows, "v").orderBy("bin").collect()
    assert [r["n"] for r in got] == want.tolist()
    assert np.allclose([r["low"] for r in got] + [got[-1]["high"]], edges, atol=1e-6)
    assert metrics.histogram(rows.limit(0), "v").isEmpty()


def test_boxes(spark):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1) for _ in range(400)] + [9.0, -9.0], None: [5.0], "c": [1.0, 1.0, 1.0, 7.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("empty", math.nan)], "g string, v double")
    got = {r["g"]: r for r in metrics.boxes(rows, "v", "g").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        q1, q2, q3 = np.percentile(vs, [25, 50, 75])
        reach = 1.5 * (q3 - q1)
        inside = [v for v in vs if q1 - reach <= v <= q3 + reach]
        want = (min([*inside, q1]), q1, q2, q3, max([*inside, q3]))
        assert np.allclose([got[k][c] for c in ("low", "q25", "q50", "q75", "high")], want, atol=1e-6)
        assert (got[k]["n"], got[k]["outside"]) == (len(vs), len(vs) - len(inside))


def test_lacking():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [([[rng.choice(words) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(6))], [rng.choice(words) for _ in range(rng.randrange(25))]) for _ in range(300)]
    rows += [(None, ["w1"]), ([["w1", "w1"], []], None), ([["w1", "w2"]], []), ([], ["w3"]), ([["w2", "w2", "é"]], ["é"])]
    kinds = pa.list_(pa.list_(pa.string())), pa.list_(pa.string())
    for part in (rows, rows[-5:], [], [(None, None)]):
        lists, pools = pa.array([x for x, _ in part], kinds[0]), pa.array([y for _, y in part], kinds[1])
        want = [None if x is None else [None if y is None else list(dict.fromkeys(t for t in s if t not in y)) for s in x] for x, y in part]
        assert grounding.lacking.func(lists, pools).to_pylist() == want
        if part:
            assert grounding.lacking.func(lists.slice(1), pools.slice(1)).to_pylist() == want[1:]


def test_long_answer_meets_its_context_once(spark):
    answer, context = " ".join(f"Word{i} stays here." for i in range(3000)), " ".join(f"word{i}" for i in range(0, 3000, 2))
    rows = spark.createDataFrame([(1, answer, context), (2, "Nothing known.", ""), (3, None, "x"), (4, "", "x")], "k int, a string, c string")
    got = grounding.features(grounding.sentences(rows, "a", "c", parts=True)).select("k", "index", "coverage").orderBy("k", "index").collect()
    assert [r["k"] for r in got] == [1] * 3000 + [2]
    assert [round(r["coverage"], 6) for r in got] == [0.333333, 0.0] * 1500 + [0.0]


def test_by_relevance(spark):
    rows = spark.createDataFrame([(1, 10, 2, 0.5), (1, 11, 1, 0.5), (1, 12, 3, 0.9), (1, 13, 4, None), (1, 14, 5, math.nan), (2, 10, 1, 0.0)], "qid int, id int, rank int, rerank_score double")
    order = lambda df: [(r["qid"], r["id"]) for r in df.orderBy("qid", "position").collect()]
    assert order(fusion.by_relevance(rows)) == [(1, 12), (1, 11), (1, 10), (1, 13), (1, 14), (2, 10)]
    assert order(fusion.by_relevance(rows, 2)) == [(1, 12), (1, 11), (2, 10)]
    with pytest.raises(ValueError):
        fusion.by_relevance(rows, 0)


def test_real_vocabulary(spark, monkeypatch):
    docs = spark.createDataFrame([("One two  three\n",), ("TWO four",), (None,), ("",)], "text string")
    words = {r["i"]: r["word"] for r in corpus.vocabulary(docs).collect()}
    assert sorted(words) == [0, 1, 2, 3] and set(words.values()) == {"one", "two", "three", "four"}
    made = {r["doc_id"]: r["text"].split(" ") for r in corpus.synthetic_like(docs, 200).collect()}
    assert sorted(made) == list(range(200)) and all(80 <= len(w) <= 120 for w in made.values())
    drawn = [w for text in made.values() for w in text]
    share = [drawn.count(words[i]) / len(drawn) for i in range(4)]
    assert share == sorted(share, reverse=True) and abs(share[0] - math.log(2) / math.log(5)) < 0.02
    monkeypatch.setattr(corpus, "FREQUENT", 1)  # nearly all by the shuffle: the same texts
    assert {r["doc_id"]: r["text"].split(" ") for r in corpus.synthetic_like(docs, 200).collect()} == made
    assert corpus.synthetic_like(docs.limit(0), 5).isEmpty()
    assert corpus.synthetic_like(docs.select(F.lit(" ").alias("text")), 5).isEmpty()
