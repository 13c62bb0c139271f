"""Order over ranges against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators.ordered import Ranges, numbered


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_numbers_and_running(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "a", "b", "b", "b", "b", "c", f"k{n % 7}"]), rng.choice([None, *range(50)]), n, rng.randrange(-5, 9) if n % 5 else None) for n in range(700)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    got = {r["id"]: r["row"] for r in numbered(df, ["g", "t", "id"], parts=parts).collect()}
    assert [got[r[2]] for r in order] == list(range(len(rows)))
    ranges = Ranges(df, ["g", "t", "id"], parts)
    out = ranges.running(["g"], {"total": ("sum", F.col("v")), "n": ("count", F.col("v")), "x": ("bit_xor", F.xxhash64("id")), "top": ("max", F.col("v")), "least": ("min", F.col("v"))})
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    found = {r["id"]: r for r in out.collect()}
    state = {}
    for g, t, i, v in order:
        total, n, x, top, least = state.get(g, (None, 0, 0, None, None))
        if v is not None:
            total, n, top, least = (total or 0) + v, n + 1, v if top is None else max(top, v), v if least is None else min(least, v)
        state[g] = total, n, x ^ hashes[i], top, least
        r = found[i]
        assert (r["total"], r["n"], r["x"], r["top"], r["least"]) == state[g], (g, t, i)
    if parts > 1:  # one shuffle of the rows, and none for the window
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "hashpartitioning" not in plan and "shufflepartitionidpassthrough" in plan
    assert numbered(df.filter("false"), ["g"]).isEmpty() and Ranges(df.filter("false"), ["g", "t"], parts).running(["g"], {"n": ("count", F.lit(1))}).isEmpty()
