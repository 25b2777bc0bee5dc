"""Mixing sources to target weights by Pfair scheduling. DataFrame and SQL functions only.

The texts of a source, in the order of a digest of id and text, are cut into blocks of ``block_chars`` characters. Target weights are multiples
of 1/frame: source s owns a(s) of every ``frame`` slots. Block j of s is released at slot floor(j * frame / a) and due
by ceil((j + 1) * frame / a); the released block with the earliest deadline takes the slot. Because every source has
used up exactly its a(s) slots at the end of a frame, one frame is scheduled (a fold over ``frame`` steps, whatever the
size of the corpus) and repeats: slot(j) = (j div a) * frame + pattern[j mod a]. At every slot each source is less
than one block away from its weight.

For a training order the slots are cut into phases. A source's texts go through the phases in the order of the digest,
so a phase begins at one digest for each source, and these few tell a text's phase from its source, id and text alone.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

FRAME = 8192
BLOCK_CHARS = 1 << 16
MAX_SOURCES = 1000
ROWS_PER_BUCKET = 20_000
#: Phases at most, characters of a block for them, and blocks of a phase for each source, at least.
PHASES, PHASE_BLOCK_CHARS, PHASE_BLOCKS = 64, 1 << 12, 2
#: Hexadecimal digits of a digest that tell where a phase begins.
DIGITS = 12
SEED = 11


def schedule(supply: DataFrame, weights: Mapping[str, float] | None, alpha: float, frame: int) -> DataFrame:
    """supply(key, total) -> (key, a, slots array<int>): the slots of one frame that each source owns.

    At most MAX_SOURCES sources (the query fails beyond), so the one row that the fold runs over has a fixed bound.
    """
    if weights is None:
        w = F.pow(F.greatest("total", F.lit(1)).cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        w = F.coalesce(F.try_element_at(given, "key"), F.lit(0.0))
    every = Window.partitionBy()
    ranked = Window.partitionBy().orderBy(F.desc("rest"), "key")
    shares = (
        supply.withColumn("w", w)
        .where("w > 0")
        .withColumn("n", F.count("*").over(every))
        .withColumn("q", F.col("w") / F.sum("w").over(every) * (F.lit(frame) - F.col("n")))
        .withColumn("rest", F.col("q") - F.floor("q"))
        .withColumn("left", F.lit(frame) - F.col("n") - F.sum(F.floor("q")).over(every))
        .withColumn("a", (1 + F.floor("q") + F.when(F.row_number().over(ranked) <= F.col("left"), 1).otherwise(0)).cast("int"))
    )
    one = shares.groupBy().agg(F.sort_array(F.collect_list(F.struct("key", "a"))).alias("s")).select(
        F.transform("s", lambda x: x.key).alias("keys"), F.transform("s", lambda x: x.a).alias("a"), F.size("s").alias("n")
    )
    one = one.where("n > 0").where(F.assert_true(F.col("n") <= MAX_SOURCES, F.lit("too many sources")).isNull())
    fold = f"""
        aggregate(
          sequence(0, {frame} - 1),
          named_struct('done', array_repeat(0, n), 'order', cast(array() AS array<int>)),
          (st, t) -> transform(
            array(array_min(transform(sequence(0, n - 1), i ->
              IF(st.done[i] < a[i] AND (st.done[i] * {frame}) DIV a[i] <= t,
                 named_struct('due', ((st.done[i] + 1) * {frame} + a[i] - 1) DIV a[i], 'i', i), NULL)))),
            p -> named_struct('done', transform(st.done, (v, k) -> IF(k = p.i, v + 1, v)), 'order', array_append(st.order, p.i)))[0],
          st -> st.order)"""
    return (
        one.select("keys", "a", F.posexplode(F.expr(fold)).alias("slot", "i"))
        .groupBy(F.expr("keys[i]").alias("key"), F.expr("a[i]").alias("a"))
        .agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    )


def _key() -> Column:
    return F.coalesce("source", F.lit(""))


def _digest(seed: int) -> Column:
    """Of id and text, so that null and repeated ids are spread; rows that share both are alike."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}|"), F.coalesce("text", F.lit(""))))


def _laid(docs: DataFrame, weights: Mapping[str, float] | None, alpha: float, block_chars: int, frame: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs with __key, __h, __a, block and slot; supply(key, total); the schedule of the sources."""
    n = docs.count()
    buckets = max(256, -(-n // ROWS_PER_BUCKET))
    rows = docs.withColumns({"__key": _key(), "__size": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "__h": _digest(seed)})
    rows = rows.withColumn("__bucket", F.expr(f"cast(conv(substr(__h, 1, 8), 16, 10) AS long) * {buckets} DIV 4294967296"))
    totals = materialise(rows.groupBy("__key", "__bucket").agg(F.sum("__size").alias("size")), "mix-totals")
    base = totals.select(
        "__key", "__bucket", (F.sum("size").over(Window.partitionBy("__key").orderBy("__bucket")) - F.col("size")).alias("__base")
    )
    if totals.select("__key").distinct().limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    supply = totals.groupBy(F.col("__key").alias("key")).agg(F.sum("size").alias("total"))
    plan = schedule(supply, weights, alpha, frame)
    within = Window.partitionBy("__key", "__bucket").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    # plan has at most MAX_SOURCES rows and ``frame`` integers in all
    laid = (
        rows.withColumn("__before", F.coalesce(F.sum("__size").over(within), F.lit(0)))
        .join(base, ["__key", "__bucket"])
        .join(F.broadcast(plan.withColumnsRenamed({"key": "__key", "a": "__a", "slots": "__slots"})), "__key", "left")
        .withColumn("block", F.expr(f"(__base + __before) DIV {block_chars}"))
        .withColumn("slot", F.expr(f"(block DIV __a) * {frame} + __slots[cast(block % __a AS int)]"))
    )
    return laid, supply, plan


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.8,
    fraction: float | None = 1.0,
    block_chars: int = BLOCK_CHARS,
    frame: int = FRAME,
    seed: int = SEED,
) -> DataFrame:
    """All rows of docs with block, slot (null if the source has no weight) and in_mix added.

    docs: doc_id, text, source and any other columns, which pass through. weights: source -> target weight; by default
    each source's share of characters to the power alpha (under 1: large sources give way to small ones). The mixture
    has as many slots as ``fraction`` times the blocks there are; in_mix marks the blocks that a source's weight promises
    it of these: rounded up, one at least, also if the last of them is only due behind the end. Slots of a source that
    has run dry stay vacant, what a source has beyond its promised blocks stays out; no other row is left out. With a
    fraction of None nothing of a source with a weight stays out: what is beyond comes at its later slots.
    A null source is a source of its own (named by the empty string in weights); null and empty texts have length 0
    and belong to the block where they stand; a text longer than a block belongs to the block where it begins and the
    blocks that it covers stay without other rows. Repeated rows are kept, each with a place of its own; columns
    of docs with the names of added ones are replaced. Sources may
    be of any size: prefix sums run within hashed buckets of a source, over totals by bucket.
    """
    laid, supply, _ = _laid(docs, weights, alpha, block_chars, frame, seed)
    promised = F.col("__a").isNotNull()
    if fraction is not None:
        blocks = supply.select(F.greatest(F.lit(1), F.ceil(F.col("total") / block_chars)).alias("b")).agg(F.sum("b")).first()[0] or 0
        length = int(-(-blocks * fraction // 1))
        promised &= F.expr(f"block < greatest(1L, (__a * {length}L + {frame - 1}L) DIV {frame})")
    kept = [c for c in docs.columns if c.lower() not in ("block", "slot", "in_mix")]
    return laid.withColumn("in_mix", promised).select(*kept, "block", "slot", "in_mix")


def cuts(sources: list[tuple[int, int, list[int]]], phases: int, frame: int) -> list[int]:
    """sources(blocks, a, slots) -> the slots that the phases after the first begin at, for an equal number of blocks in each."""

    def before(t: int) -> int:
        return sum(min(blocks, t // frame * a + bisect_left(slots, t % frame)) for blocks, a, slots in sources)

    end = max(((b - 1) // a * frame + slots[(b - 1) % a] + 1 for b, a, slots in sources), default=0)
    every = before(end)
    return [bisect_left(range(end), -(-k * every // phases), key=before) for k in range(1, phases)]


def in_phases(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.8,
    block_chars: int = PHASE_BLOCK_CHARS,
    frame: int = FRAME,
    seed: int = SEED,
    phases: int = PHASES,
) -> DataFrame:
    """The rows of docs whose source has a weight, as they are; phase() tells of each its phase of the mixture.

    docs and weights are as for mix() with a fraction of None. The slots are cut into phases with equal numbers of
    blocks, ``phases`` of them, or fewer where a source would have under PHASE_BLOCKS blocks of one on average. So to the
    end of any phase each source is less than a block away from its weight, until sources run dry; a text is of the phase
    that it begins in. Where the phases begin in each source, at most MAX_SOURCES times ``phases`` digests, goes with the
    column source as its metadata, which a table written from the result keeps. Rows alike in id and text are in one phase.
    """
    laid, supply, plan = _laid(docs.select("doc_id", "source", "text"), weights, alpha, block_chars, frame, seed)
    if weights is not None:
        docs = docs.where(_key().isin([k for k, v in weights.items() if v > 0]))
    # one row for each source, at most MAX_SOURCES
    sources = [(max(1, -(-r["total"] // block_chars)), r["a"], r["slots"]) for r in plan.join(supply, "key").collect()]
    phases = max(1, min(phases, sum(s[0] for s in sources) // (PHASE_BLOCKS * max(1, len(sources)))))
    begins: dict[str, list[str]] = {}
    if phases > 1:
        slots = F.array(*[F.lit(t) for t in cuts(sources, phases, frame)])
        number = F.transform(F.array("slot"), lambda at: F.size(F.filter(slots, lambda t: t <= at)))[0]
        first = laid.where("slot IS NOT NULL").groupBy("__key", number.alias("phase")).agg(F.min(F.substring("__h", 1, DIGITS)))
        found: dict[str, dict[int, str]] = {}
        for key, k, h in first.collect():
            found.setdefault(key, {})[k] = h
        for key, at in found.items():
            begins[key] = [min(h for j, h in at.items() if j >= k) for k in range(1, max(at) + 1)]
    told = {**docs.schema["source"].metadata, "phases": json.dumps({"seed": seed, "begins": begins})}
    return docs.withMetadata("source", told)


def phase(docs: DataFrame) -> Column:
    """The phase of a row of docs, from 0, as the metadata of the column source tell it; 0 without them, or for a source they don't name."""
    if "phases" not in docs.schema["source"].metadata:
        return F.lit(0)
    told = json.loads(docs.schema["source"].metadata["phases"])
    begins = F.try_element_at(F.from_json(F.lit(json.dumps(told["begins"])), "map<string,array<string>>"), _key())
    begins = F.coalesce(begins, F.array().cast("array<string>"))
    # the digest as an argument, so that it is made once
    return F.transform(F.array(F.substring(_digest(told["seed"]), 1, DIGITS)), lambda h: F.size(F.filter(begins, lambda b: b <= h)))[0]
