import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import chat, langid, mixing, quality, toxicity, warc
from ravelin.llm.decontaminate import decontaminate
from ravelin.llm.ngram_jaccard import ngram_jaccard
from ravelin.llm.substring import Automaton, substring_dedup
from ravelin.llm.tokens import Counter, count_tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, key string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8, "x") for i, t in texts], DOCS)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=1):
    """Unlike texts, exact copies, near copies with few edits, short and empty texts, one very long text."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(30)]
    base = words(rng, 150)
    for k in range(40):
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts.append("\n".join(copy))
    texts += [texts[0], texts[0].upper(), "", None, "a b", "a  b", "A B", "x", " ".join(words(rng, 20_000))]
    return list(enumerate(texts))


@pytest.mark.parametrize("dense_rows,block_rows", [(64, 400), (4, 5)])
def test_jaccard(spark, dense_rows, block_rows):
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard(docs(spark, rows), dense_rows=dense_rows, block_rows=block_rows).collect()}
    sets, root = {}, {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        root[i] = i

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def linked(rows, percent=80):
    """Brute force: the least id of each row's component."""
    sets, root = {}, {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        root[i] = i

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("dense_rows,block_rows,group", [(64, 400, 1), (2, 3, 5)])
def test_jaccard_added_text(spark, dense_rows, block_rows, group):
    """Copies with rarer words put before or after the text, or cut off it, at similarities about the limit."""
    rng = random.Random(11)
    texts = []
    for added in range(8, 27, 2):
        rare = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
        for kind in range(3):
            base = words(rng, 104, 60)
            for _ in range(group):
                texts.append(base if kind < 2 else base + rare(added))
                texts.append([base + rare(added), rare(added) + base, base][kind])
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard(docs(spark, rows), dense_rows=dense_rows, block_rows=block_rows).collect()}
    assert got == linked(rows)


def test_jaccard_empty_and_null_ids(spark):
    assert ngram_jaccard(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s"), (3, "a b c d e f")]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_jaccard(docs(spark, rows)).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_automaton():
    rng = random.Random(3)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    a = Automaton()
    for i, t in enumerate(texts):
        a.add(t, i)
    a.close()
    for w in (1, 3, 6):
        first = {}
        for i, t in enumerate(texts):
            for k in range(len(t) - w + 1):
                first.setdefault(tuple(t[k : k + w]), i)
        probe = [rng.randrange(3) for _ in range(200)]
        want = [(k, first[tuple(probe[k : k + w])]) for k in range(len(probe) - w + 1) if tuple(probe[k : k + w]) in first]
        assert list(a.owners(probe, w)) == want


def test_substring(spark):
    rng = random.Random(2)
    passage = words(rng, 70)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 120)) + (passage[i % 5 :] if i % 3 == 0 else []) + words(rng, 30))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, rows[4][1]), (53, "Ai. " * 300), (54, "Ai. " * 200), (4, rows[4][1])]
    got = {r["doc_id"]: r for r in substring_dedup(docs(spark, rows)).collect()}
    first = {}
    texts = dict(rows)
    for i in sorted(texts):
        w = (texts[i] or "").split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in texts.items():
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert (r["kept_text"] or "").split() == kept
    assert substring_dedup(docs(spark, [(None, "a " * 60), (1, "a " * 60)])).agg(F.sum("n_removed")).first()[0] == 0
    assert substring_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("part_bytes", [16_000_000, 60])
def test_decontaminate(spark, part_bytes):
    rng = random.Random(4)
    long = " ".join(words(rng, 15))
    bench = spark.createDataFrame([(1, long), (2, "Red fox, jumps"), (3, None), (10, "..."), (11, "red fox jumps")], "item_id long, text string")
    rows = [(1, "x " + long.upper() + " y"), (2, "the red-fox JUMPS far"), (3, None), (4, ""), (5, " ".join(long.split()[:9])), (6, "fox jumps red"), (2, "the red-fox JUMPS far")]
    got = collections.defaultdict(list)
    for r in decontaminate(docs(spark, rows), bench, part_bytes=part_bytes).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]))
    sha = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert got[1] == [(17, 15, 1, sha("1"), True)]
    assert got[2] == [(5, 3, 2, sha("11", "2"), True)] * 2
    assert got[3] == got[4] == [(0, 0, 0, sha(), False)]
    assert got[5] == [(9, 0, 0, sha(), False)] and got[6][0][1] == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|done|> \x1b\x1b. [INST]"), (1, 1, "assistant", "a</s>\x1b<|turn|>é😀 "), (1, 2, "assistant", None), (2, 0, "assistant", "yes"), (None, 0, "user", "<"), (3, 1, "assistant", "b"), (3, 0, None, "|"), (3, 1, "assistant", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    for size in (1_000_000, 1):
        got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(frame, path, part_chars=size)).collect()}
        for k in (1, 2, 3, None):
            turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == k), key=lambda v: v[0])
            said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    with pytest.raises(ValueError):
        chat.Template(turn="<<", says="<<|")


def test_tokens(spark):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = ["", "áb É́ it's WE'LL x2²³", "<|endoftext|> hi<|startoftext|>there", "İ ΣΑΣ ς 日本語 😀", "ªº µ×÷ ÿ\x1cy\x00z", "don't've123abc_x__ 'S", "word " * 5000]
    want = [len(e) for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert Counter(path).counts(texts) == want
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs(spark, list(enumerate([*texts, None]))), path).collect()}
    assert got == {i: (len(t.encode()), n, n > 2048) for i, (t, n) in enumerate(zip([*texts, ""], [*want, 0]))}


def test_quality():
    texts = [b"", b"a b\na b\n\n  \nx | y", ("A é #1 " * 30).encode(), b"one two three four five"]
    s = quality.statistics(texts)
    assert s["n_words"].tolist() == [0, 7, 90, 5] and s["n_dup_lines"].tolist() == [0, 1, 0, 0]
    assert s["n_symbols"].tolist() == [0, 1, 30, 0] and s["n_repeat_words"].tolist() == [0, 0, 90, 0]
    assert s["word_chars"].tolist() == [0, 7, 120, 19]
    assert quality.base_failed(s).all()


def test_langid(spark):
    rng = random.Random(5)
    kinds = {"aa": "abcdef", "bb": "defghiß"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(40)), k) for i in range(80) for k in [("aa", "bb")[i % 2]]]
    frame = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !!", "bb"), (902, "abcab fedcb", None)], "doc_id long, text string, lang string")
    model = langid.fit(frame, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[901]["rejected"]
    assert langid.fit(frame.filter("false"), F.lit(True)) is None


def test_langid_many_grams(spark):
    """A language with few texts beside one with millions of grams, each of them more frequent."""
    rng = np.random.default_rng(9)
    wide = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 100_000))) for _ in range(31)]
    small = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(40)) for _ in range(12)]
    rows = [(i, t, "wide") for i, t in enumerate([*wide, *wide])] + [(100 + i, t, "small") for i, t in enumerate(small)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = langid.fit(frame, F.lit(True))
    own = frame.filter("doc_id >= 100")
    assert [r["lang_pred"] for r in langid.identify(own, model).collect()] == ["small"] * 12
    code = langid.grams(langid.letters(small[:1], langid.letter_table(), langid.ORDER - 1)[0])
    assert (langid.Level.find(model.levels[langid.ORDER].keys, langid._hash(code, langid.ORDER)) >= 0).all()


def test_langid_limits(spark):
    """A language with a few of many rows rejects too."""
    rng = random.Random(10)
    say = lambda letters, n=40: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, say(["abcdef", "defghi"][i % 2]), ["aa", "bb"][i % 2]) for i in range(6000)] + [(9000 + i, say("uvwxyz"), "cc") for i in range(3 + 4)]
    rows += [(9100 + i, say("rstuvw"), "dd") for i in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, F.lit(True))
    assert model.langs == ["aa", "bb", "cc", "dd"] and all(np.isfinite(model.rules[i][3]) for i in range(4))
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    assert all(got[i]["lang_pred"] == k and not got[i]["rejected"] for i, _, k in rows if k in ("cc", "dd"))
    assert sum(r["rejected"] for r in got.values()) == 0
    odd = spark.createDataFrame([(1, "uzklm nopqj zuklm jqpon mlkuz " * 20)], "doc_id long, text string")
    assert langid.identify(odd, model).first()["rejected"]


def test_toxicity(spark):
    rng = random.Random(6)
    common = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(common, k=60) + (["badword"] * 2 if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(240)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels, F.col("doc_id") % 4 != 1)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 4 == 1]
    pairs = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
    assert sum(pairs) / len(pairs) > 0.95
    assert toxicity.fit(frame, labels.filter("false"), F.lit(True)) is None and 0 <= got[999] <= 1


def test_mixing(spark):
    rows = [(i, "word " * (1 + i % 7), ["a", "b", None][i % 3], ["x", "y"][i % 2]) for i in range(300)] + [(900, None, "z", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix_sources(frame).toPandas()
    assert len(out) == 301 and (out.expected >= 0).all() and (out.copies - out.expected).abs().max() < 1
    assert abs((out.expected * out.n_tokens).sum() / out.n_tokens.sum() - mixing.BUDGET) < 0.01
    assert mixing.mix_sources(frame.filter("false")).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a", "<html lang='x'><title>T &amp; U</title><p>one<br>two</p><script>no()</script></html>"), (2, None, None)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages))
    data = b"".join(bytes(r["record"]) for r in warc.serialise(made.orderBy("key", "record_type")).collect())
    records = warc.parse(data)
    assert len(records) == 4 and [h["WARC-Type"] for h, _ in records] == ["conversion", "metadata"] * 2
    for headers, block in records:
        assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    assert records[0][1].decode().splitlines() == ["T & U", "one", "two"] and records[0][0]["WARC-Refers-To"] == records[1][0]["WARC-Refers-To"]


def test_pipeline_rows(spark, tmp_path):
    """Null and repeated ids in the stages: each row is judged by its own text."""
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    a, b, c, d, e = (" ".join(words(rng, 80)) for _ in range(5))
    item = " ".join(words(rng, 15))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    passage = " ".join(words(rng, 60))
    left = lambda stage, rows: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs(spark, rows), str(tmp_path)).collect()), key=repr)
    rows = [(None, a), (None, b), (None, c), (3, c), (3, d), (3, d), (5, e), (5, d), (7, c), (8, None)]
    assert left(pipeline.near_copies, rows) == sorted([(None, a), (None, b), (None, c), (3, c), (3, d), (5, e), (8, None)], key=repr)
    rows = [(None, a), (None, f"{b} {item}"), (3, c), (3, f"{d} {item}")]
    assert left(pipeline.benchmark_free, rows) == sorted([(None, a), (3, c)], key=repr)
    rows = [(3, f"{a} {passage}"), (5, b), (5, f"{c} {passage}"), (None, passage)]
    assert left(pipeline.repeated_passages, rows) == sorted([(3, f"{a} {passage}"), (5, b), (5, c), (None, passage)], key=repr)
    spoken = [(i, " ".join(words(rng, 60, 300)), "en") for i in range(60)]
    frame = spark.createDataFrame([*spoken, (None, spoken[0][1], None), (None, "12 !!", None), (3, "34 !!", None)], "doc_id long, text string, lang string")
    assert sorted((r["doc_id"] is None, r["text"]) for r in pipeline.language_id(spark, frame, "").collect()) == sorted([*((False, t) for _, t, _ in spoken), (True, spoken[0][1])])
