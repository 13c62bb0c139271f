"""Operators 11 to 13 against plain versions, and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import periods, phrases, queries, tries


def plain_phrases(text):
    """The set of phrases, byte by byte."""
    data, found, phrase = text.encode(), set(), b""
    for k in range(len(data)):
        phrase += data[k : k + 1]
        if phrase not in found:
            found.add(phrase)
            phrase = b""
    return found


def test_fingerprints(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["für", "ab", "\U0001f600", "house", "x"]) for _ in range(n))
    texts = [say(rng.randrange(90)) for _ in range(40)] + ["", "a", None, "é"]
    rows = [(k if k % 9 else None, t, "x", k) for k, t in enumerate([*texts, texts[3], texts[3]])]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, h string, tail int").repartition(3)
    plain = {t or "": plain_phrases(t or "") for _, t, *_ in rows}
    got = {r["doc_id"]: r for r in phrases.fingerprints(docs.filter("doc_id is not null")).collect()}
    for i, t, *_ in rows:
        if i is not None:
            assert got[i]["n_chars"] == len(t or "") and len(got[i]["fingerprint"]) == 8 * min(phrases.SIZE, len(plain[t or ""]))
    for a, b in ((1, 2), (5, 7), (40, 1), (40, 42)):  # sets smaller than the signature: exact
        x, y = (plain_phrases(rows[k][1] or "") for k in (a, b))
        if len(x | y) <= phrases.SIZE:
            want = len(x & y) / len(x | y) if x | y else 1.0
            assert phrases.likeness(*(phrases.hashes_of(got[k]["fingerprint"]) for k in (a, b))) == pytest.approx(want)
    order = sorted([*rows, rows[4]], key=lambda r: (r[0] is None, -(r[0] or 0)))
    for parts in (1, 3, 50):
        out = phrases.compare_with_next(docs, parts=parts)
        near = phrases.likeness_column(F.col("fingerprint"), F.col("edited_fingerprint")).alias("again")
        found = sorted(out.select("*", near).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
        assert [r["doc_id"] for r in found] == [r[0] for r in order]
        assert all(r["again"] == pytest.approx(r["near_edited"]) for r in found)
        for k, r in enumerate(found):
            i, t = order[k][0], order[k][1] or ""
            if i is not None and order[(k + 1) % len(order)][0] is not None:
                then = order[(k + 1) % len(order)][1] or ""
                edited = t[: len(t) - len(t) // 2] + then[: len(t) // 2]
                assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
                assert r["edited_fingerprint"] == phrases.fingerprint(phrases.Parse().feed(edited.encode()).hashes())
                assert r["near_next"] == phrases.likeness(*(phrases.Parse().feed(x.encode()).hashes() for x in (t, then)))
        first = [r for r in order if r[0] is not None][0]
        assert not out.filter(F.col("doc_id") == first[0]).isEmpty()
    assert phrases.compare_with_next(docs.filter("false")).isEmpty() and phrases.fingerprints(docs.filter("false")).isEmpty()
    one = phrases.compare_with_next(docs.filter("doc_id = 41")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    nobody = phrases.compare_with_next(spark.createDataFrame([(None, None), (None, None)], "doc_id string, text string")).collect()
    assert [(r["n_chars"], r["near_next"], r["fingerprint"]) for r in nobody] == [(0, 1.0, "")] * 2


def test_fingerprint_pieces(monkeypatch):
    """However a text is cut, its fingerprint is the same, also where the dictionary starts anew; near copies are near."""
    rng = random.Random(4)
    data = bytes(rng.choice(b"abcde ") for _ in range(5000))
    monkeypatch.setattr(phrases, "PIECE", 700)
    monkeypatch.setattr(phrases, "DICTIONARY", 150)
    whole = phrases.Parse().feed(data).hashes()
    for _ in range(20):
        cut = rng.randrange(len(data))
        first = phrases.Parse().feed(data[:cut])
        assert np.array_equal(first.copy().feed(data[cut:]).hashes(), whole) and np.array_equal(first.feed(data[cut:]).hashes(), whole)
    monkeypatch.undo()
    known = plain_phrases(data.decode())
    assert phrases.Parse().feed(data).dictionary == known
    near = data[:2500] + b"zz" + data[2500:]
    x, y = known, plain_phrases(near.decode())
    assert abs(phrases.likeness(phrases.Parse().feed(data).hashes(), phrases.Parse().feed(near).hashes()) - len(x & y) / len(x | y)) < 0.15


def plain_runs(words):
    """Every lag's stretches of matches; those whose stretch has a smaller period are left out."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            m = 0
            while k + m < n - q and words[k + m] == words[k + m + q]:
                m += 1
            length = m + q
            if m and length >= max(12, 2 * q):
                part = words[k : k + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((k, length, q))
            k += m + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_texts(rng):
    for _ in range(150):
        text = []
        for _ in range(rng.randrange(1, 6)):
            base = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 12))]
            text += (base * rng.randrange(1, 9))[: rng.randrange(1, 80)]
        yield text
    for q in (64, 65, 100, 131):  # long periods, which go over the grid
        base = [f"w{rng.randrange(9)}" for _ in range(q)]
        yield [f"x{rng.randrange(5)}" for _ in range(rng.randrange(40))] + (base * 3)[: 2 * q + rng.randrange(q)] + ["end"] * rng.randrange(30)
        yield ["e"] * 7 + (base * 2)[: 2 * q - 1] + ["f"] + (base * 2)[: 2 * q]


def test_runs_brute(monkeypatch):
    rng = random.Random(5)
    for heavy, grid in ((0.5, 64), (0.0, 8), (1e9, 9)):
        monkeypatch.setattr(periods, "HEAVY", heavy)
        monkeypatch.setattr(periods, "GRID_FROM", grid)
        for text in periodic_texts(rng):
            ids = periods.word_ids([w.encode() for w in text])
            counts = periods.lag_counts(ids)
            assert counts[1:].tolist() == [sum(a == b for a, b in zip(text, text[q:])) for q in range(1, len(text) // 2 + 1)]
            assert periods.runs_of(ids) == plain_runs(text), text
    monkeypatch.undo()
    assert periods.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert [r[1:] for r in periods.runs_of(np.arange(200_000) % 50_000)] == [(200_000, 50_000)]


def test_periodic_runs(spark):
    rng = random.Random(6)
    rows = [(k if k % 13 else None, " \t".join(t), 1, "z") for k, t in enumerate(periodic_texts(rng))] + [(500, None, 1, "z"), (501, "", 1, "z"), (502, "a" * 200_000, 1, "z"), (503, " é" * 30, 1, "z"), (503, " é" * 30, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, start string").repartition(3)
    want = []
    for i, t, *_ in rows:
        words = [w.decode() for w in queries.repeating(i, (t or "").encode().split())]
        runs = plain_runs(words)
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = periods.digest(periods.periodic_runs(docs, prepare=queries.repeating))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert any(r[2] for r in want) and periods.digest(periods.periodic_runs(docs.filter("false"))).isEmpty()


def plain_trie(conversations, rebuild):
    """Every node of a dictionary of prefixes; ``conversations``: id to turns (role, text)."""
    paths = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        paths[c] = conversations.get(c - c % 100, [])[:h] + own[h:]
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, own in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        out.append((min(own), len(node), min(nodes[node[:-1]]) if node else None, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed, tmp_path):
    rng = random.Random(seed)
    ids = [*range(0, 30), *range(100, 140), *range(205, 230), 300, 1000, *range(20_000, 20_010)]
    rows, held = [], {}
    for c in ids:
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "\U0001f600é", "", None, f"own {c}"])) for _ in range(rng.randrange(0, 9))]
        turns = turns if c % 7 else [("user", "a")] * len(turns)
        if c == 25:
            turns = [("user", "x" * 1000)] * 120
        order = [None, *range(len(turns))]
        rows += [(c, t, role, text, 1, 2) for t, (role, text) in zip(order, turns)]
        if turns:
            held[c] = [(role or "", text or "") for role, text in turns]
    rng.shuffle(rows)
    table = spark.createDataFrame([*rows, (None, 1, "user", "nobody", 1, 2)], "conv_id long, turn int, role string, text string, place int, depth int").repartition(3)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = queries.op13_prefix_trie(spark, str(tmp_path))
    assert got.columns == columns and sorted(map(tuple, got.collect()), key=str) == plain_trie(held, True)
    turns = tries.numbered_turns(tries.hashed_turns(table))
    extra = spark.createDataFrame([(-5,), (25,), (None,), (7_000_000,)], "conv_id long")  # conversations without turns
    got = tries.prefix_trie(turns, turns.select("conv_id").union(extra))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(held | {-5: [], 7_000_000: []}, False)


def test_prefix_trie_empty(spark):
    table = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    turns = tries.numbered_turns(tries.hashed_turns(table))
    assert tries.prefix_trie(turns, turns.select("conv_id")).isEmpty()
