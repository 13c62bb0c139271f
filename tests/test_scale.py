"""Forms that many tasks share: line numbers, row numbers."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.operators import quantiles as exact
from ravelin.operators import impacts, lexical, state, timeline
from ravelin.operators.blocks import Best
from ravelin.operators.quantiles import at_ranks, quantiles
from ravelin.plans import queries as plans
from ravelin.sources import corpus, lines, tables, versions
from ravelin.sources.lines import read_lines


@pytest.fixture
def small_blocks(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "10", "spark.sql.files.minPartitionNum": "50"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines(spark, tmp_path, small_blocks):
    rng = random.Random(8)
    want = {}
    for name in "abc":
        lines = [rng.choice(["", " ", f"{name}{k} " + "xü" * rng.randrange(60)]) for k in range(rng.choice([700, 1500]))]
        end = rng.choice(["\n", "\r\n"])
        (tmp_path / f"{name}.txt").write_bytes(end.join(lines).encode() + (b"" if name == "a" else end.encode()))
        want |= {(name, k): x for k, x in enumerate(lines, 1) if x.strip()}
    rows = read_lines(spark, f"file://{tmp_path}")
    got = {(r["file"].rsplit("/", 1)[1][0], r["line"]): r["value"] for r in rows.collect()}
    assert [k for _, k in sorted((r["row"], (r["file"], r["line"])) for r in rows.collect())] == sorted((r["file"], r["line"]) for r in rows.collect())
    assert got == want and spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 20
    assert read_lines(spark, f"file://{tmp_path}", blank=True).filter("value = ''").count() > 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "wholetext" not in plan.lower()
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.txt").write_text("")
    assert read_lines(spark, f"file://{empty}").isEmpty()


def test_cut_differently(spark, tmp_path, small_blocks, monkeypatch):
    """A second scan that does not see the first one's blocks, or sees them at other places, fails rather than numbering lines wrongly."""
    (tmp_path / "a.txt").write_text("\n".join(f"line {k}" for k in range(3000)))
    right = lines.blocks
    assert read_lines(spark, f"file://{tmp_path}").agg(F.max("line")).first()[0] == 3000
    for wrong in (lambda scan: right(scan).withColumn("first", F.col("first") + 1), lambda scan: right(scan).filter("start = 0")):
        monkeypatch.setattr(lines, "blocks", wrong)
        with pytest.raises(Exception, match="cut in another way"):
            read_lines(spark, f"file://{tmp_path}").collect()


def test_strict_error_names_the_line(spark, tmp_path, small_blocks):
    good = [json.dumps({"doc_id": str(i), "title": "t", "text": "x" * 50}) for i in range(400)]
    (tmp_path / "c.jsonl").write_text("\n\n".join(good) + "\n{bad\n")
    with pytest.raises(corpus.CorpusFormatError, match=r"c\.jsonl:800: not a JSON object"):
        corpus.load_strict(spark, f"file://{tmp_path}/c.jsonl")
    rows, bad = corpus.load_lenient(spark, f"file://{tmp_path}/c.jsonl")
    assert rows.count() == 400 and [r["line"] for r in bad.collect()] == [800]


def test_row_numbers(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "é", None]) and f"d{rng.randrange(40)}", k, f"c{k}") for k in range(300)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, chunk_id string").repartition(4)
    want = {c: i for i, (_, _, c) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    for parts in (1, 7):
        assert {r["chunk_id"]: r["row"] for r in versions.row_numbers(chunks, parts).collect()} == want


def test_jsonl_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(k, None if k == 5 else " " if k == 6 else f"text {k}\n  end", "s") for k in range(1, 40)], "doc_id long, text string, source string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in plans.jsonl_scan(spark, str(tmp_path)).collect()}
    assert {int(i): r["row"] for i, r in got.items()} == {k: k - 1 for k in range(1, 40)}
    assert got["5"]["reason"] == "missing fields: text" and got["6"]["reason"].startswith("text must") and got["7"]["reason"] is None
    rows = read_lines(spark, str(tmp_path / "documents.parquet"), blank=True)
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_reproducible_in_files(spark, tmp_path):
    """The bytes do not depend on how rows are cut, neither before nor by the writer."""
    rng = random.Random(15)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(300), f"z{k}") for k in range(200)]
    found = set()
    for k, (parts, files) in enumerate([(1, 1), (5, 1), (3, 4), (7, 9)]):
        tables.write_reproducible(spark.createDataFrame(rows, "dataset_name string, id long, z string").repartition(parts), f"{tmp_path}/{k}", files=files)
        found.add(b"".join(p.read_bytes() for p in sorted((tmp_path / str(k)).glob("part-*"))))
    assert len(found) == 1 and len(found.pop().splitlines()) == 200


@pytest.mark.parametrize("bits,few", [(16, 0), (7, 20)])
def test_exact_ranks(spark, bits, few, monkeypatch):
    """Every place of every group, of doubles of all sizes, against a sort."""
    monkeypatch.setattr(exact, "FEW", few)
    rng = random.Random(bits)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 1.0000000000000002, 0.1 + 0.2, 0.3]
    rows = [("a", rng.choice(odd)) for _ in range(60)] + [(None, rng.uniform(-1, 1) * 10.0 ** rng.randrange(-320, 308)) for _ in range(80)] + [("c", float(rng.randrange(4))) for _ in range(50)] + [("d", None), ("e", float("nan")), ("e", 1e300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {f"r{k}": F.floor(F.lit(k / 20) * (F.col("n") - 1)) for k in range(21)}
    got = {r["g"]: r for r in at_ranks(df, "v", shares, "g", bits=bits).collect()}
    assert set(got) == {"a", None, "c", "e"}
    for g, r in got.items():
        own = sorted((v for k, v in rows if k == g and v is not None), key=lambda v: (v != v, v))
        assert r["n"] == len(own)
        for k in range(21):
            want = own[math.floor(k / 20 * (len(own) - 1))]
            assert r[f"r{k}"] == want or want != want and r[f"r{k}"] != r[f"r{k}"], (g, k)
    for kind in ("long", "int", "date", "timestamp", "boolean"):
        cast = {"date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "timestamp": F.timestamp_micros(F.col("id") * 977 - 10**15), "boolean": F.col("id") > 20}.get(kind, ((F.col("id") * 7919 % 1000 - 500) * 10**5).cast(kind))
        table = spark.range(41).select(cast.alias("v"))
        want = sorted(r["v"] for r in table.collect())
        assert at_ranks(table, "v", {"least": F.lit(0), "mid": F.lit(20), "most": F.col("n") - 1}).collect() == [(41, want[0], want[20], want[40])]
    assert at_ranks(df.filter("false"), "v", {"x": F.lit(0)}, "g").isEmpty()
    with pytest.raises(TypeError):
        at_ranks(df, "g", {"x": F.lit(0)})


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    values = [float(x) for x in rng.lognormal(size=501)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    r = quantiles(df, "v", {"a": 0.0, "b": 0.25, "c": 0.937, "d": 1.0}).first()
    assert np.allclose([r[c] for c in "abcd"], np.quantile(values, [0, 0.25, 0.937, 1]), rtol=1e-15)


def test_running_in_slots(spark):
    """Running values of hot, null and rare keys in narrow slots, forwards and backwards, against a plain walk."""
    rng = random.Random(12)
    rows = [(i, rng.choice([None, "hot", "hot", "hot", "b"]), rng.choice([None, *range(-30, 90)]), rng.randrange(-4, 5) if i % 6 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, us long, v int").repartition(4)
    for width in (7, 1000):
        for backwards in (False, True):
            values = {"n": ("count", F.col("v"), True), "total": ("sum", F.col("v"), False), "top": ("max", F.col("v"), False), "least": ("min", F.col("v"), True)}
            got = {r["id"]: r for r in timeline.running(df, ["k"], ["us", "id"], width, values, backwards=backwards).collect()}
            assert len(got) == 500
            for key in (None, "hot", "b"):
                own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]), reverse=backwards)
                seen = []
                for i, _, _, v in own:
                    earlier, seen = [x for x in seen if x is not None], [*seen, v]
                    upto = [x for x in seen if x is not None]
                    assert (got[i]["n"], got[i]["total"], got[i]["top"], got[i]["least"]) == (len(upto), sum(earlier) if earlier else None, max(earlier, default=None), min(upto, default=None)), (width, backwards, i)


def test_increase_and_rate(spark):
    rng = random.Random(13)
    events = [(i, rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(0, 3000)) for i in range(600)]
    df = spark.createDataFrame(events, "event_id int, k string, us long").repartition(4)
    for window in (1, 10, 333, 10_000):
        got = {r["event_id"]: r["increase"] for r in state.increase(df, window, "k").collect()}
        assert got == {i: sum(1 for _, b, t in events if b == k and us - window < t <= us) for i, k, us in events}
    samples = sorted({(k, us): float(rng.randrange(30)) for _, k, us in events}.items(), key=lambda x: (x[0][0] or "", x[0][1]))
    frame = spark.createDataFrame([(k, us, v) for (k, us), v in samples], "k string, us long, value double").repartition(3)
    gained = {(r["k"], r["us"]): r["increase"] for r in state.counter_increase(frame, "k", width_us=50).collect()}
    last = {}
    for (k, us), v in samples:
        was = last.get(k)
        assert gained[k, us] == (0.0 if was is None else v if v < was else v - was)
        last[k] = v
    rates = {(r["k"], r["us"]): r["increase"] for r in state.counter_rate(frame, 400, "k").collect()}
    for (k, us), _ in samples:
        own = [(t, v) for (b, t), v in samples if b == k and us - 400 < t <= us]
        if len(own) < 2:
            assert rates[k, us] is None
            continue
        total, span, lead = sum(gained[k, t] for t, _ in own[1:]), us - own[0][0], own[0][0] - (us - 400)
        step = span / (len(own) - 1)
        before = lead if lead < step * 1.1 else step / 2
        if total > 0:
            before = min(before, span * own[0][1] / total)
        assert rates[k, us] == pytest.approx(total * (span + before) / span, abs=2e-6)


def test_hot_key_uses_all_tasks(spark):
    """Two keys' events are dealt to many tasks: no window over a whole key."""
    df = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 2).alias("k"), (F.col("id") * 1000).alias("us"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = timeline.running(df, ["k"], ["us"], 50_000, {"n": ("count", F.lit(1), True)})
        sizes = [r["c"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c"), F.max("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) >= 12 and max(sizes) < 4000 / 4


def test_impact_index(spark, tmp_path):
    """The pruned search gives what the plain one gives, and looks at fewer postings."""
    rng = random.Random(17)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 40))) + (" rare" * (i % 97 == 0))) for i in range(1500)] + [(5000, None), (5001, "")], "doc_id long, text string").repartition(4)
    asked = [(q, " ".join(rng.sample(words, rng.randrange(1, 6)))) for q in range(40)] + [(40, "rare w0 w1"), (41, "unknown"), (42, ""), (43, None), (44, "w0")]
    queries = spark.createDataFrame(asked, "qid int, query string")
    path = f"file://{tmp_path}/index"
    impacts.build(docs, path, shard_docs=400, block_docs=16)
    for k in (1, 7):
        want = sorted(map(tuple, lexical.bm25(queries, docs, k).select("qid", "id", "score", "rank").collect()))
        for most in (5000, 10):
            assert sorted(map(tuple, impacts.search(queries, path, k, max_queries=most).select("qid", "id", "score", "rank").collect())) == want
    with pytest.raises(Exception):
        impacts.build(docs, path)
    with pytest.raises(ValueError):
        impacts.build(docs.limit(0), f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        impacts.search(queries, path, 0)
    assert impacts.search(queries.limit(0), path).isEmpty()
    texts = spark.createDataFrame([("a", "oak elm"), ("b", "oak oak"), (None, "oak")], "doc_id string, text string")
    impacts.build(texts, f"file://{tmp_path}/text")
    assert [r["id"] for r in impacts.search(queries.limit(1).select("qid", F.lit("oak").alias("query")), f"file://{tmp_path}/text").orderBy("rank").collect()] == ["b", "a"]
    shard = impacts.Shard(64)
    n = np.full(64, 8)
    shard.put(0, np.arange(64), n, np.full(64, 0.5), np.arange(512), np.full(512, 0.5))  # common
    shard.put(1, np.array([3, 40]), np.array([2, 2]), np.array([2.0, 1.9]), np.array([24, 25, 320, 321]), np.array([2.0, 1.0, 1.9, 1.8]))
    best = Best(1, 3, True)
    shard.search(best, 0, [(0, 0.1), (1, 5.0)])
    assert best.ids[0] == [24, 320, 321] and shard.read < 100
