"""The operators on vectors, addresses, sources, conversations and sequences, and the pipeline."""

import hashlib
import math
import random
import struct
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinis.llm import chat, embed_dup, mixing, queries, training_order, urls
from affinis.llm._encode import END, encoder

SF = "/root/testdata/sf0.001"


# ---- vectors


def vector_links(rows, cosine=0.95):
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append((w := np.array(v) / np.abs(v).max()) / np.linalg.norm(w) if ok else None)
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], math.inf if k is None else k)
    return sorted(((k, n[i], None if least[find(i)] == math.inf else least[find(i)]) for i, (k, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("cell", "core", "outer"), [(8192, 4096, 16384), (20, 64, 256), (7, 64, 256)])
def test_near_vectors(spark, monkeypatch, cell, core, outer):
    for name, value in (("CELL_ROWS", cell), ("CORE", core), ("OUTER", outer)):
        monkeypatch.setattr(embed_dup, name, value)
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.standard_normal(8).tolist()) for i in range(150)]
    hub = rnd.standard_normal(8)
    rows += [(200 + i, (hub + rnd.normal(0, 0.12, 8)).tolist()) for i in range(150)]
    walk = rnd.standard_normal(8)
    for i in range(40):
        walk = walk + rnd.normal(0, 0.25, 8)
        rows.append((400 + i, (walk * 10.0**i).tolist()))
    nan, inf = float("nan"), float("inf")
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [None] * 8), (504, [nan] + [1.0] * 7), (505, [inf] + [1.0] * 7), (506, [1e-200] * 8), (507, [1e200] * 8)]
    rows += [(508, [1.0, 0.0]), (509, [1.0, 0.1]), (510, [2.0]), (511, [3.0]), (512, [-3.0]), (200, rows[150][1]), (None, rows[150][1]), (None, [1.0, -5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("uid", F.lit("x")).withColumn("cell", F.lit(1))
    got = embed_dup.near_vectors(df.repartition(3)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == vector_links(rows)
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got if r["vec_id"] is not None)
    assert embed_dup.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_floats_at_the_limit(spark):
    """Pairs within single precision of the limit are decided in double precision."""
    angle = math.acos(0.95)
    rows = [(i, [1.0, 0.0]) if i == 0 else (i, [math.cos(angle + d), math.sin(angle + d)]) for i, d in enumerate([0, -1e-9, 1e-9, -1e-7, 1e-7])]
    got = embed_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id = 0").first()
    assert got["n_links"] == 2


# ---- addresses


def test_rules_and_parts(spark):
    cases = {
        None: ("", "", None),
        "no scheme/en/": ("", "", None),
        "http://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7"),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/"),
        "http://com/en/": ("com", "/en/", "com/en/"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/"),
        "x://a.net/de/#x": ("a.net", "/de/", "net/de/"),
        "x://example.net/de/80": ("example.net", "/de/80", "example.net/de/8"),
        "x://a.org?/es/": ("a.org", "", None),
        "://": ("", "", None),
        "a://b://c/d": ("b:", "//c/d", None),
        "http://ÀB.org/es/\nx": ("Àb.org", "/es/\nx", "org/es/"),
    }
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, bad int").withColumn("rule", F.lit(7)).withColumn("rate", F.lit(1)).withColumn("n", F.lit(1))
    got = {r["url"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(df, queries.RULES).collect()}
    assert got == cases
    assert urls.judge(df.limit(0), queries.RULES).count() == 0


def test_reputation_shrinks(spark):
    rows = [("bad.site.com", 1)] * 60 + [("new.site.com", 1)] + [("other.site.com", 0)] * 60 + [(f"h{i}.fine{i % 9}.org", 0) for i in range(300)] + [("unseen.site.com", None), ("lone", 1), ("", None)]
    r = {x["host"]: x for x in urls.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert r["bad.site.com"]["bound"] > 0.5 > r["new.site.com"]["bound"] and r["other.site.com"]["rate"] < 0.1
    assert r["h1.fine1.org"]["rate"] < 0.1 and r["h1.fine1.org"]["rate"] < r["unseen.site.com"]["rate"] < r["bad.site.com"]["rate"]
    assert all(0 < x["rate"] < 1 for x in r.values())
    none = urls.judge(spark.createDataFrame([("http://a.b/", None)], "url string, bad int"), [])
    assert none.first()["verdict"] == "allow"
    many = spark.createDataFrame([("http://x.bad.com/", 1)] * 90 + [("http://y.good.com/", 0)] * 90, "url string, bad int")
    assert {(x["host"], x["verdict"]) for x in urls.judge(many, []).collect()} == {("x.bad.com", "block"), ("y.good.com", "allow")}


# ---- mixing


def edf(a, frame):
    """Earliest deadline first over one frame, step by step."""
    done, out = [0] * len(a), []
    for t in range(frame):
        due = [(math.ceil(Fraction((done[i] + 1) * frame, a[i])), i) for i in range(len(a)) if done[i] < a[i] and done[i] * frame // a[i] <= t]
        i = min(due)[1]
        done[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 1.0, "c": 2.0}, {"a": 1.0, "zero": 0.0}])
def test_schedule_is_fair(spark, weights):
    supply = spark.createDataFrame([("a", 500), ("b", 90), ("c", 7), ("", 1)], "key string, total long")
    plan = sorted(map(tuple, mixing.schedule(supply, weights, 0.8, 128).collect()))
    a = [p[1] for p in plan]
    assert sum(a) == 128
    want = edf(a, 128)
    assert [p[2] for p in plan] == [[t for t, i in enumerate(want) if i == k] for k in range(len(plan))]
    for t in range(1, 4 * 128):  # over several frames
        for _, share, slots in plan:
            have = t // 128 * share + sum(s < t % 128 for s in slots)
            assert abs(have - Fraction(share * t, 128)) < 1


def test_mix(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "s1", "s2", None]), "x" * rnd.randrange(50)) for i in range(3000)]
    rows += [(3000, "s1", None), (3001, "s1", ""), (3002, "s2", "y" * 5000), (None, "s2", "z"), (7, "hot", "again"), (7, "hot", "again")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slot", F.lit("x")).withColumn("h", F.lit("x"))
    got = mixing.mix(df, block_chars=500, frame=64).collect()
    assert len(got) == len(rows)
    place, size = defaultdict(set), defaultdict(int)
    for r in got:
        place[r["slot"]].add((r["source"], r["block"]))
        size[r["source"], r["block"]] += len(r["text"] or "")
    assert all(len(p) == 1 for p in place.values())  # a slot has one block
    assert all(v < 500 + 5000 for v in size.values())
    share = lambda s: sum(len(r["text"] or "") for r in got if r["source"] == s and r["in_mix"]) / sum(len(r["text"] or "") for r in got if r["in_mix"])
    before = sum(len(t or "") for _, s, t in rows if s == "hot") / sum(len(t or "") for _, _, t in rows)
    assert share("hot") < before and all(r["in_mix"] for r in got if r["source"] in ("s1", None))
    again = {(r["doc_id"], r["slot"]) for r in mixing.mix(df.repartition(5), block_chars=500, frame=64).collect()}
    assert again == {(r["doc_id"], r["slot"]) for r in got}
    assert not any(r["in_mix"] for r in mixing.mix(df, weights={"s1": 1.0}).where("source = 'hot'").collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_keeps_sources_smaller_than_a_block(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 12}", "x" * 1000) for i in range(2400)] + [(9999, "tiny", "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for kw in ({}, {"block_chars": 4000}, {"block_chars": 4000, "fraction": 0.5}):  # the frame is the one in use
        got = mixing.mix(df, **kw).collect()
        first = [r for r in got if r["source"] != "hot" and r["block"] == 0]
        assert {r["source"] for r in first} == {"s0", "s3", "s6", "s9", "tiny"} and all(r["in_mix"] for r in first)
    got = mixing.mix(df, block_chars=4000).collect()
    assert all(r["in_mix"] for r in got if r["source"] != "hot")


def test_pipeline_mixes_without_loss(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 20}", "x" * 60_000) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.source_mix(spark, df, SF).collect()) == list(range(600))
    got = mixing.mix(df, fraction=None).collect()
    assert all(r["in_mix"] for r in got) and len({(r["source"], r["block"]) for r in got}) == len({r["slot"] for r in got})
    assert sum(not r["in_mix"] for r in mixing.mix(df).collect()) > 20  # a fraction asked for cuts
    only = mixing.mix(df, weights={"s1": 1.0}, fraction=None).collect()
    assert all(r["in_mix"] == (r["source"] == "s1") for r in only)


def test_cuts():
    sources = [(40, 3, [0, 3, 6]), (7, 4, [1, 2, 5, 7]), (1, 1, [4])]
    taken = sorted(j // a * 8 + slots[j % a] for blocks, a, slots in sources for j in range(blocks))
    for n in (1, 2, 5, 48):
        got = mixing.cuts(sources, n, 8)
        assert len(got) == n - 1
        sizes = np.diff([0, *[sum(t < c for t in taken) for c in got], len(taken)])
        assert sizes.sum() == 48 and sizes.max() - sizes.min() <= 1
    assert mixing.cuts([], 3, 8) == [0, 0]


def test_phases_follow_the_slots(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot", "hot", "hot", 's"1', "s2", None]), f"{i} " + "x" * rnd.randrange(300)) for i in range(1500)]
    rows += [(None, "s2", "z"), (None, "hot", None), (9, "hot", "again"), (9, "hot", "again"), (2000, "s2", "y" * 5000), (2001, "tiny", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    made = mixing.in_phases(df, block_chars=256, frame=64, phases=10)
    made.write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    assert read.columns == df.columns and read.count() == len(rows)
    got = sorted(map(tuple, read.select("*", mixing.phase(read)).collect()), key=repr)
    slots = {r[:3]: r[3] for r in map(tuple, mixing.mix(df, fraction=None, block_chars=256, frame=64).drop("block", "in_mix").collect())}
    phase = {r[:3]: r[3] for r in got}
    assert sorted((r[:3] for r in got), key=repr) == sorted(rows, key=repr) and set(phase.values()) == set(range(10))
    by_slot = sorted((slots[r], phase[r]) for r in slots)
    assert [p for _, p in by_slot] == sorted(p for _, p in by_slot)
    chars = [sum(len(r[2] or "") for r in got if r[3] == p) for p in range(10)]
    assert max(chars) < 1.5 * min(chars) and sum(chars) == sum(len(r[2] or "") for r in rows)
    hot = [sum(len(r[2] or "") for r in got if r[3] == p and r[1] == "hot") / chars[p] for p in range(10)]
    assert sum(hot[:5]) / 5 + 0.05 < sum(hot) / 10 < hot[9]
    only = mixing.in_phases(df, weights={"s2": 1.0, "tiny": 0.0}, block_chars=256, frame=64)
    assert sorted(r["source"] for r in only.collect()) == sorted(r[1] for r in rows if r[1] == "s2")
    assert mixing.in_phases(df.limit(0)).count() == 0 and df.select(mixing.phase(df)).distinct().collect() == [(0,)]


def test_mixture_orders_the_shards(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice("abcde fgh ") for _ in range(3000)), "en", "hot" if i % 3 else f"s{i % 12}", 3000) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(4).write.parquet(f"{tmp_path}/docs")
    corpus_pipeline.source_mix(spark, spark.read.parquet(f"{tmp_path}/docs"), SF).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    assert mixed.columns == df.columns
    seqs = corpus_pipeline.shards(spark, mixed, SF).orderBy("slot").collect()
    assert {d for r in seqs for d in r["doc_ids"]} == set(range(900))
    parts = [[rows[d][3] == "hot" for r in part for d in r["doc_ids"]] for part in (seqs[: len(seqs) // 2], seqs[-len(seqs) // 10 :])]
    early, late = [sum(p) / len(p) for p in parts]
    a = {r["key"]: r["a"] for r in mixing.schedule(spark.createDataFrame([("hot", 1800000), *[(f"s{i}", 225000) for i in (0, 3, 6, 9)]], "key string, total long"), None, 0.8, 8192).collect()}
    assert abs(early - a["hot"] / 8192) < 0.03 and late > 0.9  # its weight, not its share of 2/3, until others run dry
    of = dict(map(tuple, mixed.select("doc_id", mixing.phase(mixed)).collect()))
    first = [of[r["doc_ids"][0]] for r in seqs]
    assert len(of) == 900 and max(first) > 20 and first == sorted(first)  # phase after phase, a sequence with the first text in it


# ---- chat


def test_chat(spark):
    nasty = ["<|im_end|>", "<\\|x", "<\\\\|im_end|>\n<|im_start|>user\n", "<", "<|", "|>", "a\n\nb", "", "\\", "é😀"]
    rows = []
    for i, a in enumerate(nasty):
        rows += [(i, 0, "user", a), (i, 1, "assistant", a + a)]
    rows += [(100, 0, "system", "s"), (100, 1, "user", None), (100, 2, "assistant", "x"), (100, 3, "user", "y")]
    rows += [(101, 1, "assistant", "first"), (101, 2, None, "no role"), (101, 2, "us%er\n<|", "odd"), (101, 2, "assistant", "b"), (101, 2, "assistant", "b"), (None, 0, "user", "u"), (102, None, "user", "z" * 1_000_000), (102, 5, "assistant", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(1))
    made = chat.format_conversations(df.repartition(4))
    got = {r["conv_id"]: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss_text(F.col("segments")).alias("loss")).collect()}
    key = lambda r: ((r[1] is not None, r[1]), r[2] or "", r[3] or "")
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=key)
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2] or "", x[3] or "") for x in turns]
        assert r["loss"] == "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(turns) == r["formatted"].count("<|im_end|>")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert all(got[i]["valid"] for i in range(len(nasty))) and got[102]["valid"]
    assert not got[100]["valid"] and not got[101]["valid"] and not got[None]["valid"]
    assert chat.format_conversations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(turn_open="[user]")


# ---- training order


def test_permutation():
    for n in (1, 2, 3, 10, 255, 256, 257, 5000):
        p = training_order.permute(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n)) and (training_order.permute(p, n, back=True) == np.arange(n)).all()
    assert (training_order.permute(np.arange(5000), 5000, key=1) != training_order.permute(np.arange(5000), 5000, key=2)).mean() > 0.99


@pytest.mark.parametrize("fixed", [True, False])
def test_shards(spark, tmp_path, fixed):
    rnd = random.Random(8)
    texts = [None, "", "one", "a  b \n c", "<|endoftext|>", "x " * 30_000] + ["".join(rnd.choice("abc de é\n ") for _ in range(rnd.randrange(400))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again")], "doc_id long, text string").withColumn("slot", F.lit(1))
    df.repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    step = training_order.stride(64)
    training_order.write_shards(docs, f"{tmp_path}/shards", 64, 16, fixed=fixed)
    rows = training_order.read_shards(spark, f"{tmp_path}/shards", 64).orderBy("slot").collect()
    files = sorted(tmp_path.glob("shards/part-*"))
    n = sum(f.stat().st_size for f in files) // step
    assert [r["slot"] for r in rows] == list(range(n)) and len({r["seq_id"] for r in rows}) == n and len(files) > n / 16 / 3
    # slots follow the permutation of all numbers that there may be
    places = training_order.permute(np.array([r["seq_id"] for r in rows]), (docs if fixed else docs.select("doc_id", "text")).rdd.getNumPartitions() * training_order.SPAN)
    assert (np.diff(places) > 0).all()
    by_shard = {int(f.name[5:10]): f for f in files}
    for r in rows:  # a reader finds a record by its shard and offset alone
        with open(by_shard[r["shard"]], "rb") as f:
            f.seek(r["byte_offset"])
            tokens, n_docs, _, number = struct.unpack(training_order.HEAD, f.read(training_order.HEAD_BYTES))
            ids = struct.unpack(f"<{training_order.DOCS}q", f.read(8 * training_order.DOCS))[:n_docs]
            f.read(2 * training_order.DOCS)
            assert (tokens, list(ids), number) == (r["n_tokens"], r["doc_ids"], r["seq_id"]) and f.read(2 * tokens) == r["tokens"]
    # the documents of a sequence, from where they begin
    encode, of = encoder(), {}
    for i, t in [*enumerate(texts), (-1, "no id"), (3, "again")]:
        if t:
            of.setdefault(i, []).append([*encode(t).tolist(), END])
    parts: dict[int, list[list[int]]] = {}
    for r in sorted(rows, key=lambda r: r["seq_id"]):
        tokens = np.frombuffer(r["tokens"], np.uint16).tolist()
        for j, (doc, lo) in enumerate(zip(r["doc_ids"], r["doc_starts"], strict=True)):
            part = tokens[lo : (r["doc_starts"] + [len(tokens)])[j + 1]]
            if j or not r["continues"]:
                parts.setdefault(doc, []).append(part)
            else:
                parts[doc][-1] += part
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in of.items()}
    stream = np.concatenate([np.frombuffer(r["tokens"], np.uint16) for r in sorted(rows, key=lambda r: r["seq_id"])]).tolist()
    want = sorted(tuple(encode(t).tolist()) for t in [*texts, "no id", "again"] if t)
    got, part = [], []
    for t in stream:
        if t == END:
            got.append(tuple(part))
            part = []
        else:
            part.append(t)
    assert sorted(got) == want and not part
    assert training_order.training_order(docs.limit(0), 64, 16).count() == 0 and training_order.training_order(docs.where("doc_id < 2")).count() == 0
    texts_of_one = spark.createDataFrame([(i, "one") for i in range(1000)], "doc_id long, text string").coalesce(1)
    few = training_order.training_order(texts_of_one, 2048, 16).collect()  # no more documents than a record names
    assert max(len(r["doc_ids"]) for r in few) == training_order.DOCS and sorted(i for r in few for i in r["doc_ids"]) == list(range(1000))
    assert all(len(r["sha256"]) == 64 for r in few)
    with open(files[0], "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        training_order.read_shards(spark, f"{tmp_path}/shards", 64)


@pytest.mark.parametrize("phases", [1, 3, 9])
def test_shards_in_phases(spark, tmp_path, phases):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abc de é ") for _ in range(rnd.randrange(900))), rnd.randrange(phases) * 5 - 3) for i in range(300)] + [(300, None, None), (301, "no phase", None)]
    spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for path in ("a", "b"):
        training_order.write_shards(docs, f"{tmp_path}/{path}", 64, 16, fixed=path == "a", phase="part")
    got = training_order.read_shards(spark, f"{tmp_path}/a", 64).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(len(got))) and len({r["shard"] for r in got}) > len(got) / 16 / 3
    of = {i: p or 0 for i, _, p in rows}
    first = [of[r["doc_ids"][0]] for r in got]
    assert first == sorted(first)
    n = docs.rdd.getNumPartitions() * training_order.SPAN
    places = training_order.permute(np.array([r["seq_id"] for r in got]), n)
    assert all(a < b for a, b, p, q in zip(places, places[1:], first, first[1:]) if p == q)
    encode = encoder()
    tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint16) for r in sorted(got, key=lambda r: r["seq_id"])]).tolist()
    want = sorted([*encode(t).tolist(), END] for _, t, _ in rows if t)
    ends = [-1, *[i for i, t in enumerate(tokens) if t == END]]
    assert sorted(tokens[a + 1 : b + 1] for a, b in zip(ends, ends[1:])) == want and tokens[-1] == END
    with pytest.raises(ValueError, match="phases"):
        many = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").alias("part"))
        training_order.write_shards(many, f"{tmp_path}/c", phase="part")


def test_encoder_equals_the_library():
    e, rnd = encoder(), random.Random(9)
    for _ in range(3000):
        t = "".join(rnd.choice("ab'sé 日\n\t .,1  <|>\xa0　\r") for _ in range(rnd.randrange(25)))
        assert e(t).tolist() == e.library.encode_ordinary(t), repr(t)


# ---- the pipeline


def test_pipeline_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.sql("SELECT cast(null AS long) AS doc_id, 'a few plain words of a text' AS text, cast(null AS string) AS lang, cast(null AS string) AS source, cast(null AS long) AS n_chars UNION ALL SELECT 999999L, null, null, null, null")
    docs, names = documents.unionByName(odd), documents.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() > 0 and "sha256" in last.columns
    none = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_pipeline_keeps_the_clean(spark):
    """Nothing is dropped but what a stage decides to drop, held against plain versions on the stage's own input."""
    from tests.llm.test_text_operators import contamination, similarity_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    classes = similarity_classes([r["text"] for r in rows])
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == {rows[i]["doc_id"] for i in set(classes)}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = contamination([r["text"] for r in rows], items)
    got = {r["doc_id"] for r in corpus_pipeline.benchmark_passages(spark, docs, SF).collect()}
    assert got == {r["doc_id"] for r, b in zip(rows, bad) if not b[3]}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


# ---- the queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_its_columns(spark, name):
    want = {
        "op1": "doc_id n_words n_hit n_items items_sha256 contaminated", "op3": "page_id host path rule verdict", "op5": "doc_id held_out lang_pred score",
        "op6": "doc_id held_out score predicted", "op7": "doc_id n_bytes n_tokens over_limit", "op8": "vec_id n_links component_id kept",
        "op10": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    }.get(name.split("_")[0], "")
    df = queries.QUERIES[name](spark, SF)
    assert want.split() == df.columns[: len(want.split())] and df.count() > 0


def test_chat_query_digests(spark):
    row = queries.op10_chat_format(spark, SF).where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["n_turns"] == 2


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)
