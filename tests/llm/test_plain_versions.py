"""Queries that SQL can't express against plain versions over whole tables, their folds, and rows out of the ordinary."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinis.llm import _common, bpe_count, chat, decontaminate, language, mixing, near_dup, quality, queries
from affinis.operators import components
from affinis.plans import lineage
from tests.llm.test_text_operators import similarity_classes

SF = "/root/testdata/sf0.001"
U32 = 0xFFFFFFFF


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").cache()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_languages(spark, documents):
    """Nearest centroid by cosine, term by term, with the fitted parameters."""
    rows = documents.collect()
    model = language.fit(documents.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    right = held = 0
    for r in rows:
        counts: dict[int, int] = {}
        b = [x if 97 <= x <= 122 or x >= 128 else 32 for x in f" {r['text'] or ''} ".lower().encode()]
        for i in range(len(b) - 1):
            two = (b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA77) & U32
            at = [((two * 0x2C1B3C6D) & U32) >> 19]
            if i + 2 < len(b):
                at.append((((two ^ (b[i + 2] * 0xC2B2AE3D & U32)) * 0x27D4EB2F) & U32) >> 19)
            for k in at:
                counts[k] = counts.get(k, 0) + 1
        v = {k: math.log1p(c) * float(model.idf[k]) for k, c in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[k]) for k, x in v.items()) / max(length, 1e-12) for c in model.centroids]
        best = max(range(len(cosine)), key=lambda j: cosine[j])
        mine = got[r["doc_id"]]
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
        else:
            assert mine["score"] == pytest.approx(cosine[best], abs=1e-4)
            if sorted(cosine)[-1] - sorted(cosine)[-2] > 1e-4:
                assert mine["lang_pred"] == model.languages[model.owner[best]]
        assert mine["held_out"] == (remainder(r["doc_id"], 3) == 1)
        if mine["held_out"] and r["lang"] and r["text"]:
            held, right = held + 1, right + (mine["lang_pred"] == r["lang"])
    assert held > 30 and right / held > 0.9


def test_quality(spark, documents):
    """The linear model's margin gram by gram, with the fitted parameters, through the logistic curve."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = quality.fit(documents.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r for r in queries.op6_quality(spark, SF).collect()}
    factors = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows[:120]:
        b, grams = (r["text"] or "").encode(), set()
        for n in (1, 2, 3, 4):
            for i in range(len(b) - n + 1):
                h = n
                for j in range(n):
                    h ^= ((b[i + j] + 1) * factors[j]) & U32
                    if j:
                        h = (h * 0x2C1B3C6D) & U32
                grams.add(((h * 0x9E3779B1) & U32) >> (32 - quality.BITS))
        margin = model.bias
        if grams:
            margin += sum(float(model.weights[g]) for g in grams) / max(math.sqrt(sum(float(model.ratio[g]) ** 2 for g in grams)), 1e-6)
        want = 1 / (1 + math.exp(-max(-30, min(30, model.a * margin + model.b))))
        mine = got[r["doc_id"]]
        assert mine["score"] == pytest.approx(want, abs=1e-4) and mine["predicted"] == (mine["score"] >= 0.3)
        assert mine["held_out"] == (remainder(r["doc_id"], 5) == 0)


def test_fitted_rows_are_bounded():
    grams = np.arange(0, 100_000, 3, dtype=np.uint32)
    some = quality.first_of(grams, 500)
    assert len(some) == 500 and set(some) <= set(grams) and (np.diff(some.astype(int)) > 0).all()
    assert set(quality.first_of(some, 100)) == set(quality.first_of(grams, 100)) and quality.first_of(some, 500) is some


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(bpe_count.MODEL))
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op7_token_counts(spark, sf).collect():
        n = len(library.encode(texts[r["doc_id"]], num_threads=1))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_texts_that_share_a_passage(spark, monkeypatch):
    """A component of many chunks whose texts share half, hardly any linked: links are found, other pairs don't meet."""
    monkeypatch.setattr(near_dup, "CHUNK_TEXTS", 8)
    monkeypatch.setattr(near_dup, "BANDS", 36)
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join([*base[:30], *(f"w{i}x{j}" for j in range(12)), *base[30:]]) for i in range(120)]
    for i in range(0, 30, 3):  # near-copies, far apart in the order of ids
        words = texts[i].split()
        words[rnd.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += [" ".join([*base, "end"])] * 3
    met = []
    inner = near_dup._linked
    monkeypatch.setattr(near_dup, "_linked", lambda groups, s: met.append(groups.count()) or inner(groups, s))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df.repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == similarity_classes(texts)
    assert len(met) <= 2 and sum(met) < 12 * len(texts)


def test_item_ids_may_be_strings(spark):
    bench = spark.createDataFrame([("b-2", "one two three"), ("a-1", "four five"), ("c", "never")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "ONE two, three four five")], "doc_id long, text string")
    assert decontaminate.find_contamination(docs, bench).first()["items"] == ["a-1", "b-2"]


def test_one_letter_has_a_language_of_its_own(spark):
    rows = [(i, f"{'x' if i % 2 else 'é'} {'xyz' if i % 2 else 'éàü'}", "x" if i % 2 else "e") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([("x",), ("é",)], "text string")
    assert [r["lang_pred"] for r in language.predict(asked, model).collect()] == ["x", "e"]


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"] is None, r["valid"]) for r in made) == [(False, True), (True, False), (True, False)]


def test_mixture_of_null_ids_and_clashing_names(spark):
    rows = [(None, "s", f"text {i}", i) for i in range(200)] + [(5, "t", "same", i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, Block long")
    out = mixing.mix(df, block_chars=64, fraction=None)
    assert [c for c in out.columns if c.lower() == "block"] == ["block"] and out.count() == 400
    again = mixing.mix(df.repartition(7), block_chars=64, fraction=None)
    key = lambda d: sorted((r["text"], r["block"], r["slot"]) for r in d.collect())
    assert key(out) == key(again)
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit("x").alias("text"))
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(many)


def test_one_of_each_group_stays_in_the_pipeline(spark, tmp_path):
    text = "a text of more than five words that comes again and again"
    rows = [(7, text)] * 3 + [(None, text)] * 2 + [(3, text + " once")] * 2 + [(None, "alone"), (None, None), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/docs")
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), SF).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in got), key=repr) == sorted(
        [(False, 3, text + " once"), (True, None, "alone"), (True, None, None), (False, 9, None), (False, 9, "")], key=repr
    )


def test_tables_are_deleted(spark):
    """Of an operator's tables only those stay that its result is read from."""
    before = set(lineage._tables)
    near_dup.classes(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(set(lineage._tables) - before) == 1
    out = lineage.settled(lambda: near_dup.classes(spark.createDataFrame([(1, "a b")], "doc_id long, text string")), "only")
    assert out.count() == 1 and len(set(lineage._tables) - before) == 2
    lineage.discard(out)
    assert len(set(lineage._tables) - before) == 1


def test_facts_reach_the_parts_of_a_hot_key(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(600)] + [(None, "hot"), (None, None)], "id long, k string")
    facts = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), _common.parts_of("id"))
    for how in ("inner", "left"):
        got = _common.told(rows, facts, ["k"], "id", how)
        want = rows.join(facts.drop("parts"), "k", how)
        assert got.columns == want.columns == ["k", "id", "n"]
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    per = rows.where("k = 'hot'").groupBy(_common._part("id").alias("p")).count().collect()
    assert len(per) == _common.PARTS and max(r["count"] for r in per) < 40


def test_texts_of_one_base_meet_once_and_not_for_each_rare_shingle(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK_TEXTS", 8)
    monkeypatch.setattr(near_dup, "HUBS", 2)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        rate = rng.uniform(0.005, 0.07)
        texts.append(" ".join(f"x{rng.randrange(1 << 40)}" if rng.random() < rate else w for w in base))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    met, inner = [], near_dup._linked
    monkeypatch.setattr(near_dup, "_linked", lambda groups, s: met.append(groups.count()) or inner(groups, s))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()} == dict(enumerate(root))
    assert met[-1] < 60 * 17, met  # all with all in blocks of 8; one group for each shingle took several times that


def jobs_of(spark, name, f):
    """What f() gives, and how many jobs Spark ran for it."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("few", [0, 40, 1 << 18])
def test_components_by_tables_and_by_one_task(spark, monkeypatch, few):
    """Chains, a star, a clique and loops, of which tables do all, the first rounds or nothing."""
    monkeypatch.setattr(components, "FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(60)] + [(-5, -(1 << 62)), (7, 7), (None, 3), (500, None), (900, 900)]
    edges += [(299, i) for i in range(200, 299)] + [(i, j) for i in range(400, 412) for j in range(400, 412)] * 2
    want = {i: 0 for i in range(61)} | {i: 200 for i in range(200, 300)} | {i: 400 for i in range(400, 412)} | {-5: -(1 << 62), -(1 << 62): -(1 << 62)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got, jobs = jobs_of(spark, f"components-{few}", lambda: components.components(df).collect())
    assert sorted(map(tuple, got)) == sorted(want.items())
    assert jobs <= 12 or few < len(edges), jobs


def test_near_duplicates_of_few_texts_take_few_jobs(spark, monkeypatch):
    """A chain of near copies in many chunks: each round of a contraction by tables takes as many stages as all shuffles have."""
    monkeypatch.setattr(near_dup, "CHUNK_TEXTS", 8)
    monkeypatch.setattr(near_dup, "HUBS", 2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[i : i + 80]) for i in range(0, 200, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, jobs = jobs_of(spark, "chain", lambda: near_dup.classes(df).collect())
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(i, 0) for i in range(100)}
    assert jobs < 160, jobs
