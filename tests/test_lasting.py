"""Streams whose state ends, transactions over tables, and a paged source that goes on where it stopped."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from ravelin.operators import dense, state
from ravelin.sources import tables, vectors, versions
from ravelin.streaming import forms

HOUR = 3_600_000_000


def streamed(spark, made, path):
    """The rows of a stream read to its end, and the keys that its state holds after each batch."""
    name = f"s{abs(hash(path)) % 10**9}"
    query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name), [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


FOLDS = {
    "rate_limit": (state.anchored_limit(3, HOUR), lambda rows: state.rate_limit(rows, 3, HOUR)),
    "budget": (state.daily_budget(20), lambda rows: state.budget(rows, 20, key="user_id")),
    "breaker": (state.breaker(100, cache_us=HOUR), lambda rows: state.storage_breaker(rows, 100, cache_us=HOUR, key="user_id")),
}


@pytest.mark.parametrize("name", FOLDS)
def test_folded_stream(spark, tmp_path, name):
    """Files that come one by one, their events out of order by up to two hours, give what the batch form gives; states of silent
    keys are gone in the end."""
    rng = random.Random(14)
    events = [(i, rng.randrange(12) if i % 9 else None, rng.randrange(5 * 24 * 3600) * 1_000_000 + rng.randrange(10**6), rng.randrange(1, 6), rng.choice([None, 50, 75, 95])) for i in range(400)]
    arrival = sorted(events, key=lambda e: e[2] + rng.randrange(2 * HOUR))
    schema = "event_id long, user_id long, us long, n long, size long"
    source = tmp_path / "in"
    source.mkdir()
    parts = [arrival[k : k + 80] for k in range(0, 400, 80)] + [[(9999, 77, 30 * 24 * HOUR, 1, 1)], [(9998, 77, 60 * 24 * HOUR, 1, 1)]]
    for k, part in enumerate(parts):
        frame = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1)
        frame.write.parquet(f"{source}/f{k}")
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/*")
    folds, batch = FOLDS[name]
    rows, held = streamed(spark, forms.folded(stream, folds, "user_id", late="3 hours"), str(tmp_path))
    want = batch(spark.createDataFrame(events, schema))
    columns = want.columns
    got = sorted(map(tuple, rows.filter("event_id < 9000").select(columns).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) == 400
    assert max(held) >= 12 and held[-1] <= 1, held


def test_two_writers(spark, tmp_path):
    """Writers at once: additions and upserts of unlike keys are all there, counters lose no step, and a commit is whole."""
    store = tables.TableStore(spark, f"file://{tmp_path}/store")
    store.write("counter", spark.createDataFrame([("x", 0)], "name string, n int"))
    failed = []

    def work(me):
        try:
            for k in range(4):
                store.run(lambda t: t.add("events", spark.createDataFrame([(me, k)], "who int, k int")))

                def step(t):
                    n = t.read("counter").first()["n"]
                    t.write("counter", spark.createDataFrame([("x", n + 1)], "name string, n int"))
                    t.add("steps", spark.createDataFrame([(n + 1,)], "n int"))

                store.run(step)
        except Exception as error:
            failed.append(error)

    writers = [threading.Thread(target=work, args=(me,)) for me in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    assert store.read("counter").first()["n"] == 12 and sorted(r["n"] for r in store.read("steps").collect()) == list(range(1, 13))
    assert sorted(map(tuple, store.read("events").collect())) == [(a, b) for a in range(3) for b in range(4)]
    assert store.versions() == list(range(25))
    first, second = store.snapshot(), store.snapshot()
    first.upsert("docs", spark.createDataFrame([("a", 1)], "doc_id string, v int"), "doc_id")
    second.read("docs")
    second.write("other", spark.range(3))
    before = store.snapshot()
    first.commit()
    with pytest.raises(tables.Conflict, match="docs"):
        second.commit()
    assert store.read("other") is None and before.read("docs") is None  # a snapshot stays as it was
    third = store.snapshot()
    third.write("other", spark.range(3))
    store.run(lambda t: t.add("events", spark.createDataFrame([(9, 9)], "who int, k int")))
    third.commit()  # another table has changed meanwhile
    assert store.read("other").count() == 3 and store.read("events").count() == 13
    kept = store.read("counter").inputFiles()
    assert store.vacuum(keep=2, grace_s=1e6) == [] and len(store.vacuum(keep=2, grace_s=-1.0)) >= 11
    assert store.read("counter").inputFiles() == kept and store.read("events").count() == 13


def test_registry_writers(spark, tmp_path):
    """Versions that begin at once are all in the registry, and one is active after two were activated at once."""
    store = versions.VersionStore(spark, f"file://{tmp_path}/index")

    def work(me):
        own = versions.VersionStore(spark, f"file://{tmp_path}/index")
        own.begin(f"v{me}", me)
        own.ready(f"v{me}")
        own.activate(f"v{me}")

    writers = [threading.Thread(target=work, args=(me,)) for me in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    states = store.registry()
    assert set(states) == {"v0", "v1", "v2", "v3"} and sorted(v["status"] for v in states.values()) == ["active", "ready", "ready", "ready"]


def test_resumed_pages(spark, tmp_path):
    """A service that fails, throttles and loses a page for a while: all rows are there once, and pages that came are not asked for again."""
    calls = f"{tmp_path}/calls"

    def fetch(first, n, calls=calls):
        with open(calls, "a") as f:
            f.write(f"{first}\n")
        with open(calls) as f:
            times = f.read().split().count(str(first))
        if first == 30 and times <= 4:
            raise OSError("gone")
        if first % 20 == 0 and times == 1:
            raise tables.Throttled(0.05)
        if times == 1:
            raise OSError("later")
        return [{"v": first + i} for i in range(n) if first + i < 73]

    class Unsteady(tables.PagedSource):
        @classmethod
        def name(cls):
            return "unsteady"

    Unsteady.fetch = staticmethod(fetch)
    spark.dataSource.register(Unsteady)
    store = tables.TableStore(spark, f"file://{tmp_path}/store")
    wanted = [x for x in range(73) if x % 3]
    with pytest.raises(OSError, match="rows are missing, the first at place 31"):
        tables.fetch_pages(store, "rows", "unsteady", wanted, page=10, rounds=1, attempts=2, backoff=0.01)
    told = open(calls).read().split()
    rows = tables.fetch_pages(store, "rows", "unsteady", wanted, page=10, rounds=3, attempts=2, backoff=0.01)
    assert sorted((r["place"], json.loads(r["row"])["v"]) for r in rows.collect()) == [(x, x) for x in wanted]
    assert set(open(calls).read().split()[len(told) :]) == {"30"}


def test_vector_index(spark, tmp_path):
    """A stored index answers as its vectors do; any byte flipped, any file or row lost, doubled or swapped fails the search."""
    import shutil

    rng = random.Random(16)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    vectors_of = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(q, rows[q][1]) for q in (3, 50)], "qid int, vector array<float>")
    store = versions.VersionStore(spark, f"file://{tmp_path}/index")
    index = vectors.VectorIndex(store)
    root = index.write("v1", vectors_of, 1, dim=8)
    with pytest.raises(versions.IndexIntegrityError, match="no active"):
        index.search(asked)
    store.activate("v1")
    want = sorted(map(tuple, dense.dense_topk(asked, vectors_of, 5).collect()))
    assert sorted(map(tuple, index.search(asked, 5).collect())) == want
    with pytest.raises(ValueError):
        index.write("v1", vectors_of, 2)
    assert index.write("v2", vectors_of.filter("id <> 7"), 2) != root
    folder = tmp_path / "index" / "v1" / "data"
    shutil.copytree(folder, tmp_path / "good")
    files = sorted(folder.glob("part-*.parquet"))
    whole = files[0].read_bytes()

    def restore():
        shutil.rmtree(folder)
        shutil.copytree(tmp_path / "good", folder)
        spark.catalog.clearCache()

    for place in [5, *range(40, len(whole) - 8, len(whole) // 8), len(whole) - 6]:
        broken = bytearray(whole)
        broken[place] ^= 0x10
        files[0].write_bytes(broken)
        for crc in folder.glob(".*.crc"):
            crc.unlink()
        try:
            got = sorted(map(tuple, index.search(asked, 5).collect()))
            assert got == want, place  # a byte of the file that says nothing (a name of the writer) may change
        except AssertionError:
            raise
        except Exception:
            pass
        restore()
    files[1].unlink()
    with pytest.raises(versions.IndexIntegrityError, match="differs"):
        index.search(asked)
    restore()
    name = files[0].name
    changed = spark.read.parquet(str(tmp_path / "good" / name)).withColumn("vector", F.when(F.col("id") == F.lit(spark.read.parquet(str(files[0])).first()["id"]), F.array_repeat(F.lit(0.5).cast("float"), 8)).otherwise(F.col("vector")))
    changed.coalesce(1).write.parquet(str(tmp_path / "changed"))
    shutil.copy(next((tmp_path / "changed").glob("part-*.parquet")), files[0])
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="differs from its hash"):
        index.search(asked).collect()
    restore()
    store.change(lambda states: states | {"v1": states["v1"] | {"root": "0" * 64}})
    with pytest.raises(versions.IndexIntegrityError, match="registry"):
        index.search(asked)
