"""The operators on texts against plain versions of what they mean, and the odd cases that each must define."""

import random
import re
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import bpe_count, decontaminate, language, near_dup, quality
from affinis.llm._words import words
from affinis.operators.components import components

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem " * 200_000


def split(text):
    return WORD.findall((text or "").translate(LOW))


def docs_of(spark, texts, more=""):
    """Ids from 0; with columns whose names clash with added ones."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    clashing = ["n_words", "hits", "items", "spans", "contaminated", "score", "predicted", "lang_pred", "rejected", "kept", "class_id", "n_hit", "component", "id", "key", "slot"]
    return df.withColumns({c: F.lit("x") for c in clashing})


def prose(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "jota", "kappa"]) + str(rnd.randrange(30)) for _ in range(n))


def test_words_match_the_pattern():
    import pyarrow as pa

    rnd = random.Random(1)
    texts = [None, "", "A", "É é", "a\x00b", "x" * 3_000_000] + ["".join(rnd.choice("aB9é \n.,_-日\x7f`@[") for _ in range(rnd.randrange(60))) for _ in range(500)]
    got, seen = {}, {}
    for w in words(pa.array(texts, pa.string())):
        for i in range(len(w.first) - 1):
            got[w.lo + i] = w.hashes[w.first[i] : w.first[i + 1]].tolist()
    for i, t in enumerate(texts):
        want = split(t)
        assert len(want) == len(got[i])
        for word, h in zip(want, got[i]):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


# ---- benchmark decontamination


def contamination(texts, items):
    windows = []
    for item, text in items:
        w = split(text)
        windows += [(item, tuple(w[i : i + 13])) for i in range(max(1, len(w) - 12)) if w]
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("item_chars", [8 << 20, 400])
def test_decontamination(spark, monkeypatch, item_chars):
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", item_chars)
    rnd = random.Random(2)
    items = [(i, prose(rnd, rnd.choice([3, 12, 13, 14, 40]))) for i in range(30)] + [(30, ""), (31, None), (None, "never met words"), (32, items_text := "one two three"), (33, items_text)]
    texts = [None, "", "...", LONG, "One, two; THREE four", "one two", "one two three one two three"]
    for _ in range(40):
        a = rnd.choice(items[:30])[1].split()
        cut = rnd.randrange(len(a))
        texts.append(f"{prose(rnd, rnd.randrange(30))}, {' '.join(a[cut:])} . {' '.join(a).upper()} {prose(rnd, rnd.randrange(300))}")
    texts.append(texts[-1])
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_contamination(docs_of(spark, texts), bench).orderBy("doc_id").collect()
    want = contamination(texts, [(i, t) for i, t in items if i is not None])
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows] == want
    for r in rows:
        inside = [w for s in r["spans"] for w in split(r["text"][s["start"] : s["stop"]])]
        assert len(inside) == r["n_hit"]
    assert sum(r["contaminated"] for r in rows) > 10


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.find_contamination(docs_of(spark, ["a b"]), none).first()["contaminated"]
    assert decontaminate.find_contamination(docs_of(spark, ["a"]).limit(0), none).count() == 0


# ---- near-duplicates


def similarity_classes(texts, limit=0.8):
    sets = []
    for t in texts:
        w = split(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        same = texts[i] is not None and texts[i] == texts[j]
        if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= limit * len(sets[i] | sets[j]) - 1e-12):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))]


def near_copies(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("chunk", "tf"), [(256, True), (8, True), (8, False)])
def test_near_duplicates(spark, monkeypatch, chunk, tf):
    """Also with chunks so small that components are cut, and chains of copies of copies."""
    monkeypatch.setattr(near_dup, "CHUNK_TEXTS", chunk)
    monkeypatch.setattr(near_dup, "HUBS", 2)
    rnd = random.Random(3)
    texts = [None, None, "", "", "...", "one two", "One, two", "one two three", LONG, LONG + "more", "!!!", "!!!"]
    base = prose(rnd, 120)
    texts += near_copies(rnd, base, 40, 2)
    chain = prose(rnd, 150)
    for _ in range(30):  # each like the last, far from the first
        chain = near_copies(rnd, chain, 1, 2)[0]
        texts.append(chain)
    shared = prose(rnd, 60)
    texts += [f"{prose(rnd, 60)} {shared}" for _ in range(25)]
    texts += [prose(rnd, 80) for _ in range(10)] + [base] * 5
    texts += [f"{base} " + "same line again " * k for k in (1, 40)]
    rows = near_dup.classes(docs_of(spark, texts), tf=tf).collect()
    assert len(rows) == len(texts)
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert [got[i] for i in range(len(texts))] == similarity_classes(texts)
    assert all(r["kept"] == (r["class_id"] == r["doc_id"]) for r in rows)


def test_near_duplicates_with_a_passage_repeated(spark):
    """One of two copies repeats a passage; the sets of shingles stay alike."""
    rnd = random.Random(5)
    texts = []
    for long, times in product((12, 30, 60), (20, 60, 100, 200)):
        for _ in range(4):
            base, passage = prose(rnd, 60), prose(rnd, long)
            texts += [f"{base} {passage}", f"{base} " + " ".join([passage] * times)]
    want = similarity_classes(texts)
    assert want[1::2] == want[::2]
    rows = near_dup.classes(docs_of(spark, texts)).collect()
    assert [r["class_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == want


def test_near_duplicates_of_odd_rows(spark):
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (None, None), (7, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in near_dup.classes(rows).collect()), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, True), (None, None, True), (None, None, True), (7, 7, True)], key=repr)
    assert near_dup.classes(rows.limit(0)).count() == 0


def test_signature_estimates_probability_jaccard():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 2**63, 60, dtype=np.uint64)
    wa, wb = rnd.uniform(0.5, 4, 50), rnd.uniform(0.5, 4, 50)
    a, b = dict(zip(h[:50].tolist(), wa)), dict(zip(h[10:].tolist(), wb))
    want = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())
    k = 4096
    for block in (1, 2, 64):
        s = near_dup.signatures(np.concatenate([h[:50], h[10:]]), np.concatenate([wa, wb]), np.repeat([0, 1], 50), 2, k, block)
        assert (s[0] == s[1]).mean() == pytest.approx(want, abs=4 * (want * (1 - want) / k) ** 0.5)
        first = s if block == 1 else first
        assert (s == first).all()  # the arrivals are the same however many are made at a time


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(100)] + [(5, 5), (None, 1)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] and None not in e for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- classifiers


def test_language(spark):
    rnd = random.Random(5)
    syllables = {"xx": ["ba", "do", "ki", "lu"], "yy": ["sch", "ung", "ein", "über"], "zz": ["ción", "ñá", "que", "los"]}
    make = lambda v: " ".join("".join(rnd.choice(syllables[v]) for _ in range(3)) for _ in range(rnd.randrange(5, 40)))
    rows = [(i, make(v), v) for i, v in enumerate(["xx", "yy", "zz"] * 60)] + [(900, "no letter", None), (901, None, "xx"), (902, "", "yy"), (903, "123 ...", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 3 <> 0 OR doc_id > 300 OR doc_id % 2 = 0"))
    assert model.languages == ["xx", "yy", "zz"] and len(model.centroids) > 6
    odd = [None, "", "12 ...", "日本", "a", LONG]
    got = language.predict(docs_of(spark, odd + [r[1] for r in rows[:180]]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and [r["score"] for r in got[:3]] == [0.0] * 3
    assert all(r["lang_pred"] in model.languages for r in got[3:6]) and got[3]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["lang_pred"] == x[2] for r, x in zip(got[6:], rows)) >= 178
    nothing = language.fit(df.limit(0))
    assert language.predict(docs_of(spark, ["abc"]), nothing).first()["lang_pred"] == "und"


def test_quality(spark):
    rnd = random.Random(6)
    good, bad = lambda: prose(rnd, rnd.randrange(5, 60)), lambda: prose(rnd, rnd.randrange(5, 60)).replace("a", "&&")
    texts = [good() if i % 4 else bad() for i in range(300)] + [None, "", LONG]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(0, 0), (None, 1), (5, None), (10**6, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).orderBy("doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 4 > 0) for r in got[200:300]) >= 97
    assert got[300]["score"] == got[301]["score"]
    again = quality.score(docs.repartition(7), quality.fit(docs.repartition(5), labels)).orderBy("doc_id").collect()
    assert [r["score"] for r in again] == [r["score"] for r in got]
    one = quality.fit(docs, labels.where("quality = 1"))
    assert quality.score(docs, one).first()["score"] == pytest.approx(1, abs=1e-3)
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).first()["score"] == pytest.approx(0.5)


def test_descent_reaches_the_optimum():
    """The duality gap of the hinge problem closes."""
    rnd = np.random.default_rng(2)
    rows = [np.sort(rnd.choice(40, 8, replace=False)) for _ in range(60)]
    y = np.array([1 if r[0] < 4 else -1 for r in rows])
    ratio = quality.log_count_ratio(rows, y)
    w, b = quality.descend(rows, y, ratio, passes=3000, tolerance=1e-8)
    x = np.zeros((60, 1 << quality.BITS), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    primal = lambda w, b: 0.5 * (float(w @ w) + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = primal(w, b)
    for _ in range(50):
        step = rnd.standard_normal(len(w)).astype(np.float32) * (np.abs(x).sum(0) > 0) * 0.01
        assert primal(w + step, b + rnd.normal() * 0.01) >= best - 1e-3


# ---- token counts


def test_token_counts(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    m = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path(bpe_count.MODEL))
    rnd = random.Random(7)
    texts = [None, "", " ", "   ", "\n", "a  b", "<s>x</s>", "▁▁a", "é x", "日本語 😀", "\x00\t", "x" * 20_000, LONG[:60_000]]
    texts += ["".join(rnd.choice("abcdeth é日.,\n 1<>|") for _ in range(rnd.randrange(80))) for _ in range(400)]
    got = bpe_count.count_tokens(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(m.encode(t or "")) for t in texts]
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and got[11]["over_limit"]


def test_token_counts_forget(monkeypatch):
    monkeypatch.setattr(bpe_count, "REMEMBER", 3)
    c = bpe_count.MergeCounter({"a": 9, "b": 9, "ab": 0, "aba": 1, "▁": 9, "▁ab": 2})
    assert [c.count(t) for t in ("ab", "abab", "ba", "c", "ab ab ab ba bb", "é")] == [1, 2, 3, 2, 9, 3]


