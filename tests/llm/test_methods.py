"""The methods against plain versions of themselves, and edge cases."""

import collections
import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import langid, mixing, quality, toxicity, warc
from ravelin.llm import substring as sub
from ravelin.llm._letters import letter_table
from ravelin.llm.decontaminate import decontaminate
from ravelin.llm.substring import substring_dedup


def test_decontaminate_brute(spark):
    """Exact and proximity matches in one and many parts, with null and repeated ids of unlike texts."""
    rng = random.Random(21)
    say = lambda n: [f"v{rng.randrange(12)}" for _ in range(n)]
    items = [(f"i{k}", say(rng.randrange(0, 9))) for k in range(14)] + [("i0", say(5)), (None, say(3))]
    rows = [(rng.choice([None, 1, 2, 3, k]), say(rng.randrange(0, 60))) for k in range(60)]
    windows = [(name, tuple(w[k : k + 4])) for name, w in items if name and w for k in range(max(1, len(w) - 3))]

    def want(words):
        hit, exact, close = [False] * len(words), set(), set()
        for name, window in windows:
            n = len(window)
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) == window:
                    hit[k : k + n] = [True] * n
                    exact.add(name)
            for k in range(-n, len(words)):
                if set(window) <= set(words[max(k, 0) : max(k + n + 1, 0)]):
                    close.add(name)
        return len(words), sum(hit), tuple(sorted(exact)), tuple(sorted(close - exact))

    docs = spark.createDataFrame([(i, " ".join(w), 1, 2) for i, w in rows], "doc_id long, text string, shard int, at int").repartition(3)
    bench = spark.createDataFrame([(i, ",".join(w)) for i, w in items], "item_id string, text string")
    for part_bytes in (10_000, 40):
        got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["near_items"])) for r in decontaminate(docs, bench, size=4, slop=1, part_bytes=part_bytes).collect())
        assert got == collections.Counter((i, *want(w)) for i, w in rows)
    assert decontaminate(docs, bench.filter("false")).filter("contaminated").isEmpty()
    assert decontaminate(docs.filter("false"), bench).isEmpty()


def test_substring_rows(spark, monkeypatch):
    """Rows of one id with unlike texts; and hot anchors, which go through finer ones."""
    rng = random.Random(22)
    a, b = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a)]
    got = sorted(((r["doc_id"] or 0, r["kept_text"].split()[:1] == [], r["n_removed"]) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, False, 0), (1, False, 0), (2, False, 0), (2, True, 60), (3, True, 60)]
    monkeypatch.setattr(sub, "SHARD_PASSAGES", 3)
    passage = [f"p{k}" for k in range(70)]
    texts = [[f"x{rng.randrange(9)}" for _ in range(rng.randrange(30))] + passage[rng.randrange(15) :] + [f"y{rng.randrange(9)}" for _ in range(rng.randrange(30))] for _ in range(60)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            first.setdefault(tuple(t[k : k + 50]), i)
    for r in substring_dedup(frame).collect():
        t = texts[r["doc_id"]]
        gone = [any(first[tuple(t[j : j + 50])] < r["doc_id"] for j in range(max(0, k - 49), min(k, len(t) - 50) + 1)) for k in range(len(t))]
        assert r["n_removed"] == sum(gone) and r["kept_text"].split() == [w for w, g in zip(t, gone) if not g]


def plain_kneser_ney(texts, order=4):
    """log P of a symbol after its context, from dictionaries."""
    counts = collections.Counter(f"   {t} "[k : k + order] for t in texts for k in range(len(t) + 1))
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
    symbols = len({g[-1] for g in counts}) + 1

    def p(gram):
        if not gram:
            return 1 / symbols
        table, below = tables[len(gram)], p(gram[1:])
        once, twice = (sum(c == k for c in table.values()) for k in (1, 2))
        d = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
        own = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        return max(own.get(gram, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * below if own else below

    return lambda t: -sum(math.log(p(f"   {t} "[k : k + order])) for k in range(len(t) + 1)) / (len(t) + 1)


def test_langid_brute(spark):
    rng = random.Random(23)
    say = lambda kind, n: " ".join("".join(rng.choice(kind) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    texts = {"aa": [say("abc", 8) for _ in range(12)], "bb": [say("bcdß", 8) for _ in range(9)]}
    frame = spark.createDataFrame([(i, t, k) for k in texts for i, t in enumerate(texts[k])], "doc_id long, text string, lang string")
    model = langid.fit(frame, F.lit(True))
    # One alphabet for both: symbols are counted over all languages.
    probe = ["abcab cab", "ddß bcd", "zz"]
    got, _ = model.entropies(probe, letter_table())
    both = {" ", *"abcdß"}
    for i, lang in enumerate(("aa", "bb")):
        plain = plain_kneser_ney(texts[lang])
        assert model.floor[i] == pytest.approx(-math.log(len(both) + 1))
        want = plain_with_floor(texts[lang], len(both) + 1)
        assert got[:, i] == pytest.approx([want(t) for t in probe], rel=1e-4) and plain(probe[0]) > 0
    scores = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(list(enumerate([*probe, "", None])), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(probe[:2]):
        e = got[i] * (len(t) + 1)
        assert scores[i]["score"] == pytest.approx(1 / (1 + math.exp(-abs(e[0] - e[1]) * len(t) / (len(t) + 1))), rel=1e-3)
    assert [scores[i]["lang_pred"] for i in range(5)] == ["aa", "bb", scores[2]["lang_pred"], "und", "und"]


def plain_with_floor(texts, symbols):
    made = plain_kneser_ney.__code__.replace(co_name="plain_with_floor")
    scope = dict(plain_kneser_ney.__globals__)
    scope["len"] = lambda x: symbols - 1 if isinstance(x, set) else len(x)
    return type(plain_kneser_ney)(made, scope, "plain_with_floor", plain_kneser_ney.__defaults__)(texts)


def test_toxicity_parts(spark):
    """Bags and gradients against plain versions; texts without n-grams."""
    table = letter_table()
    texts = ["one two three four", "a", "", None, "x" * 30 + " yy"]
    bucket, owner, first, n = toxicity.features(texts, table)
    per_text = [[], [], [], [], []]
    for text, out in zip(texts, per_text):
        words = (text or "").split()
        for k in range(0, max(len(words), 1), toxicity.BAG_WORDS):
            out.append(sum(max(len(w) + 3 - s, 0) for w in words[k : k + toxicity.BAG_WORDS] for s in toxicity.SIZES))
    assert np.bincount(owner, minlength=n).tolist() == [c for out in per_text for c in out]
    assert first.tolist() == np.cumsum([0, *(len(out) for out in per_text[:-1])]).tolist()
    rng = np.random.default_rng(1)
    model = toxicity.Toxicity(rng.normal(size=toxicity.BUCKETS), -0.2, (np.array([-9.0, 9.0]), np.array([0.0, 1.0])))
    want = [model.bias + (model.weight[bucket[owner == k]].mean() if (owner == k).any() else 0) for k in range(n)]
    assert model.bags(bucket, owner, n) == pytest.approx(want, rel=1e-5)
    for lone in ([None], [""], ["a"], [], [None, "bad word"]):
        assert len(model.scores(lone, table)) == len(lone)
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(frame, model).collect()) and toxicity.score(frame, None).count() == 3

    embed, soft = rng.normal(size=(9, toxicity.DIM)), rng.normal(size=(toxicity.DIM + 1, 2))
    grams, start, held, size = np.array([0, 3, 3, 8, 1]), np.array([0, 3]), np.array([3, 2]), np.array([4, 2])
    label, weight = np.array([1, 0]), np.array([2.0, 0.5])

    def loss():
        total = 0.0
        for k in range(2):
            hidden = np.append(embed[grams[start[k] : start[k] + held[k]]].sum(axis=0) / size[k], 1)
            z = hidden @ soft
            total += weight[k] * (np.log(np.exp(z).sum()) - z[label[k]]) / 2
        return total

    g_soft, g_gram = toxicity.gradients(embed, soft, grams, start, held, size, label, weight)
    for array, at, got in ((soft, (2, 1), g_soft[2, 1]), (soft, (toxicity.DIM, 0), g_soft[toxicity.DIM, 0]), (embed, (3, 4), g_gram[grams == 3, 4].sum()), (embed, (1, 0), g_gram[grams == 1, 0].sum())):
        keep = array[at]
        array[at] = keep + 1e-6
        up = loss()
        array[at] = keep - 1e-6
        assert got == pytest.approx((up - loss()) / 2e-6, rel=1e-4)
        array[at] = keep
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def test_mixing_targets(spark):
    rng = random.Random(24)
    rows = [(i, "word " * rng.randrange(1, 40), rng.choice("aaaaaab"), rng.choice(["x", "x", "x", "y", None])) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("cells", F.lit(1))
    targets = {"source": spark.createDataFrame([("a", 0.4), ("b", 0.6)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.3), ("y", 0.5), ("", 0.2)], "lang string, target double")}
    out = mixing.mix_sources(frame, targets=targets).toPandas()
    taken = out.n_tokens * out.copies
    for name, wanted in (("source", {"a": 0.4, "b": 0.6}), ("lang", {"x": 0.3, "y": 0.5, "": 0.2})):
        raked = (out.n_tokens * out.weight).groupby(out[name]).sum() / out.n_tokens.sum()
        shares = taken.groupby(out[name]).sum() / taken.sum()
        assert all(abs(raked[k] - v) < 2e-4 and abs(shares[k] - v) < 0.03 for k, v in wanted.items())
    assert out.residual.max() < 2e-4 and (out.copies == np.floor(out.expected)).mean() < 1
    empty = mixing.mix_sources(spark.createDataFrame([(1, None, "a", "x"), (2, " \n", None, "y"), (2, " \n", None, "y")], "doc_id long, text string, source string, lang string"))
    assert [(r["copies"], r["selected"]) for r in empty.collect()] == [(1, True)] * 3


def test_quality_forest(spark):
    rng = np.random.default_rng(25)
    x = rng.normal(size=(400, 4))
    forest = quality.Forest(x, trees=7, rows=64)

    def path(tree, row):
        column, cut, child, length = tree
        node = 0
        while child[node] >= 0:
            node = child[node] + int(row[column[node]] >= cut[node])
        return length[node]

    usual = 2 * (math.log(63) + 0.5772156649) - 2 * 63 / 64
    want = [2 ** -(sum(path(t, row) for t in forest.trees) / 7 / usual) for row in x[:50]]
    assert forest.scores(x[:50]) == pytest.approx(want)
    assert forest.scores(np.full((1, 4), 30.0))[0] > np.quantile(forest.scores(x), 0.99)
    good = [" ".join(f"w{rng.integers(9999)}" for _ in range(80)) for _ in range(120)]
    bad = [" ".join(rng.choice(["#*$", "<&>|", f"w{rng.integers(9999)}"]) + str(rng.integers(9999)) for _ in range(80)) for _ in range(40)]
    rows = [(i, t, y) for i, (t, y) in enumerate([*((t, 1) for t in good), *((t, 0) for t in bad), (None, 0), ("", 0)])]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("k", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(frame, quality.fit(frame, labels)).collect()}
    held = [(got[i]["kept"], y) for i, _, y in rows if i % 2 == 0]
    assert sum(k for k, y in held if y) >= 58 and not any(k for k, y in held if not y)
    assert quality.fit(frame, labels.filter("false")) is None
    assert {r["kept"] for r in quality.judge(frame.filter("doc_id < 120"), None).collect()} == {True}


def test_warc_files(spark, tmp_path):
    """Records from plain and gzip files, source headers kept, nothing forged by line breaks, entities."""
    html = "<title>a\r\nlanguage: zz</title><p>caf&eacute; &#8217;&#x41; &amp;lt; &#xD800; &nope;</p>é".encode()

    def record(kind, name, block, more=b""):
        return b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:" + name + b">\r\nWARC-Target-URI: http://x/" + name + b"\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n" + more + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: a\r\n b\r\n\r\n"
    data = record(b"warcinfo", b"i", b"software: x\r\n\r\nmore") + record(b"response", b"1", http + html, b"WARC-Payload-Digest: sha1:ABC\r\n") + record(b"response", b"2", b"HTTP/1.1 404 N\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + "é".encode("latin-1")) + record(b"response", b"3", b"")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(part) for part in (data[:300], data[300:])))
    for name in ("a.warc", "b.warc.gz"):
        rows = {r["key"]: r for r in warc.read_warc(spark, str(tmp_path / name)).collect()}
        assert set(rows) == {"<urn:i>", "<urn:1>", "<urn:2>", "<urn:3>"} and all(r["complete"] for r in rows.values())
        assert rows["<urn:1>"]["body"].encode() == html and rows["<urn:2>"]["body"] == "é"
        assert warc.parse(data)[1][1] == http + html
        made = {(r["key"], r["record_type"]): r for r in warc.derive(warc.read_warc(spark, str(tmp_path / name))).collect()}
        assert len(made) == 6
        meta, text = made["<urn:1>", "metadata"], made["<urn:1>", "conversion"]
        fields = meta["block"].split("\r\n")
        assert "title: a language: zz" in fields and "language: zz" not in fields and "http-header: X-Long: a b" in fields
        assert meta["payload_digest"] == text["payload_digest"] == "sha1:ABC" and meta["refers_to"] == "<urn:1>" and text["target_uri"] == "http://x/1"
        assert text["block"].split("\n")[-2:] == ["café ’A &lt; &#xD800; &nope;", "é"]
        assert made["<urn:2>", "metadata"]["block"].startswith("source-record-id: <urn:2>") and made["<urn:3>", "conversion"]["block"] == ""
    forged = warc.derive(warc.responses(spark.createDataFrame([(1, "http://a\r\nX: y", None)], "page_id long, url string, html string"))).collect()
    assert all("\r\nX: y" not in r["warc_headers"] for r in forged)


def test_pipeline(spark, tmp_path):
    """All stages over a small corpus: copies, repeated passages and benchmark passages go, the rest stays."""
    import corpus_pipeline as pipeline

    rng = random.Random(26)
    alphabet = ["abcdefghij", "qrstuvwxyz"]
    say = lambda k, n: [f"{''.join(rng.choice(alphabet[k]) for _ in range(6))}" for _ in range(n)]
    item, passage = say(0, 20), say(0, 60)
    texts = [say(k % 2, 90) for k in range(40)]
    texts += [texts[0], texts[1][:-2] + say(1, 2), [*say(0, 40), *item], [*passage, *say(0, 90)], [*say(0, 90), *passage], passage]
    rows = [(i, " ".join(t), ["en", "de"][i % 2] if i < 40 else "en", f"s{i % 3}", 0, "x") for i, t in enumerate(texts)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept) == {*range(40), 43, 44} and kept[44].split() == texts[44][:90] and all(kept[i].split() == texts[i] for i in range(40))
    final = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    chance = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) / 2**48
    assert set(final) <= set(kept) and all(r["copies"] == math.floor(r["expected"]) + (chance(i) < r["expected"] % 1) for i, r in final.items())
    assert len(final) > 20
