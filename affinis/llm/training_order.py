"""Token identifiers in training order: packed sequences, a keyed Feistel permutation, shards of fixed stride.

Identifiers of all texts of a partition, each text followed by an end mark, are cut into sequences of ``length``.
Sequence i of partition p has the number p * SPAN + i; a Feistel network over the next even number of bits, walked until
it falls below partitions * SPAN, permutes these numbers, so that every text is encoded once: no count of sequences is
needed before they are dealt out. Shards are ranges of the permuted numbers, in order; a sequence's slot is how many
come before it, which the sizes of the files before its own tell. So a reader that knows a slot knows its file and
offset, and resumes anywhere. Texts may have phases: then the sequences are dealt out phase after phase, by the
permutation within each; a partition's texts are taken in the order of their phases, and a sequence is of the phase that
its first token is of.

A record is 4 bytes n_tokens, 2 bytes n_docs, 2 bytes whether it begins inside a text, 8 bytes its number; DOCS times 8
bytes of doc_id, DOCS times 2 bytes of where that document begins; 2 * length bytes of identifiers, the end mark after
the last; a line feed. Numbers are little-endian.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, fresh, give_back, materialise, small_batches
from ._encode import END, encoder
from ._words import mix64

LENGTH, PER_SHARD, KEY = 2048, 4096, 0x5EED
#: Documents that a sequence may hold parts of; one with as many is closed before the next, however short.
DOCS = 24
ROUNDS = 6
HEAD, HEAD_BYTES = "<iHHq", 16
#: Sequences of one partition, at most.
SPAN = 1 << 32
#: Bytes of text for each token that the number of shards is reckoned by.
TOKEN_BYTES = 3
RECORDS = 256
MAX_PHASES = 1024


def _keys(key: int) -> np.ndarray:
    return mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))


def _once(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix64(left + k) & mask), left
        else:
            left, right = right, left ^ (mix64(right + k) & mask)
    return (left << np.uint64(half)) | right


def permute(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """Where the numbers x below n go (or come from), one to one onto the numbers below n."""
    half, keys = max(1, -(-max(n - 1, 1).bit_length() // 2)), _keys(key)
    out = _once(x.astype(np.uint64), half, keys, back)
    while len(far := np.flatnonzero(out >= n)):
        out[far] = _once(out[far], half, keys, back)
    return out.astype(np.int64)


def stride(length: int) -> int:
    return HEAD_BYTES + 10 * DOCS + 2 * length + 1


class Packer:
    """Cuts the tokens of texts in turn into records."""

    def __init__(self, length: int, first: int) -> None:
        self.length, self.number = length, first
        self.rows = np.zeros((RECORDS, stride(length) - 1), np.uint8)
        self.phases = np.zeros(RECORDS, np.int64)
        self.made = 0
        self.open()

    def open(self) -> None:
        self.tokens = np.full(self.length, END, "<u2")
        self.filled, self.inside, self.ids, self.starts = 0, 0, [], []

    def close(self) -> None:
        n, row = len(self.ids), self.rows[self.made]
        row[: HEAD_BYTES] = np.frombuffer(struct.pack(HEAD, self.filled, n, self.inside, self.number), np.uint8)
        docs = np.zeros(DOCS, "<i8"), np.zeros(DOCS, "<u2")
        docs[0][:n], docs[1][:n] = self.ids, self.starts
        at = HEAD_BYTES
        for part in (*docs, self.tokens):
            row[at : at + part.nbytes] = part.view(np.uint8)
            at += part.nbytes
        self.made, self.number = self.made + 1, self.number + 1
        self.open()

    def add(self, doc: int, tokens: np.ndarray, phase: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers, records, phases) whenever there are RECORDS of them."""
        at = 0
        while at < len(tokens):
            if len(self.ids) == DOCS:
                self.close()
                if self.made == RECORDS:
                    yield self.take()
            n = min(self.length - self.filled, len(tokens) - at)
            self.inside = self.inside or int(at > 0)
            if not self.ids:
                self.phases[self.made] = phase
            self.ids.append(doc)
            self.starts.append(self.filled)
            self.tokens[self.filled : self.filled + n] = tokens[at : at + n]
            self.filled, at = self.filled + n, at + n
            if self.filled == self.length:
                self.close()
                if self.made == RECORDS:
                    yield self.take()

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, self.made = self.made, 0
        return np.arange(self.number - n, self.number), self.rows[:n], self.phases[:n]


def write_shards(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
    ranks: str | None = None,
    fixed: bool = False,
    phase: str | None = None,
) -> None:
    """Write docs (doc_id, text) to the folder path as shards.

    docs must give the same rows in the same partitions if a task is run again after a lost executor: pass fixed=True
    for a plain scan of files, else it is written to the shared folder first. A null or empty text gives no part of a
    sequence; a text of any length is written whole. A null doc_id is written as -1. The last sequence of a partition
    may be shorter, and so is one that ends because it holds DOCS documents. Repeated rows are written as often as they
    occur; other columns are not read, but for the one that ``phase`` names: whole numbers, at most MAX_PHASES of them,
    lower ones first, null as 0, a function of the row. No tokens: no records. Only the records are shuffled, once, straight to their
    shard. A shard has about per_shard records at TOKEN_BYTES bytes of text for a token; the ranges are equal (within a
    phase, which has its share of the shards by its bytes), so that the numbers of records differ by about their square
    root. Files are committed by Spark's text writer, which gets the bytes by a cast to string that doesn't check them,
    and ends each record with the line feed; a file whose size is not a multiple of the stride fails the reading.
    """
    small_batches(docs.sparkSession)
    at = F.lit(0) if phase is None else F.coalesce(F.col(phase).cast("int"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), at.alias("phase"))
    if not fixed:
        rows = materialise(rows, "texts")
    sizes = rows.groupBy("phase").agg(F.count("text"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).limit(MAX_PHASES + 1).collect()
    if len(sizes) > MAX_PHASES:
        raise ValueError(f"more than {MAX_PHASES} phases")
    tokens = {p: size // TOKEN_BYTES + texts for p, texts, size in sorted(sizes)}
    total = sum(tokens.values())
    shards = max(1, -(-total // (length * per_shard)))
    partitions = max(1, rows.rdd.getNumPartitions())
    domain = partitions * SPAN
    phases = {p: i for i, p in enumerate(tokens)}
    # where the phases begin and end, in shards
    edges = np.cumsum([0, *tokens.values()]) / max(1, total) * shards
    ordered = rows.sortWithinPartitions("phase", "doc_id", "text") if len(phases) > 1 else rows

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(ranks), TaskContext.get().partitionId()
        if part >= partitions:
            raise RuntimeError("docs has more partitions than before")
        packer, end = Packer(length, part * SPAN), np.array([END], np.uint16)

        def batch(numbers: np.ndarray, made: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            if numbers[-1] >= (part + 1) * SPAN:
                raise RuntimeError("a partition has too many sequences")
            places = permute(numbers, domain, key)
            # rises with the phase and the place in it, rounding included
            to = np.minimum(edges[of] + places / domain * (edges[of + 1] - edges[of]), edges[of + 1])
            to = np.minimum(to.astype(np.int32), shards - 1)
            ends = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
            data = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(ends), pa.py_buffer(made.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(to), pa.array(of), pa.array(places), data], names=["shard", "phase", "place", "record"])

        for b in it:
            for doc, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if text := text.as_py():
                    for made in packer.add(-1 if doc is None else doc, np.concatenate([encode(text), end]), phases[at]):
                        yield batch(*made)
        if packer.filled:
            packer.close()
        if packer.made:
            yield batch(*packer.take())
        give_back()

    out = ordered.mapInArrow(records, "shard int, phase long, place long, record binary")
    out = out.repartitionById(shards, F.col("shard")).sortWithinPartitions("phase", "place")
    out.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").text(path)
    discard(rows)


def _shard(path: str) -> int:
    return int(re.search(r"part-(\d+)", path.rsplit("/", 1)[1])[1])


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, tokens: bool = True) -> DataFrame:
    """One row per record of the shards: slot, seq_id, shard, byte_offset, n_tokens, continues, doc_ids, doc_starts, tokens (binary).

    seq_id is the number before the permutation, continues tells that the first document began in the sequence before,
    doc_ids and doc_starts are the documents and their first tokens here. With tokens=False their digest (sha256) stands
    in their place. The driver learns the size of each file; a file is read by one task.
    """
    step = stride(length)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    sizes = sorted((_shard(p), n) for p, n in files.select("path", "length").collect())
    if odd := [n for _, n in sizes if n % step]:
        raise ValueError(f"{len(odd)} shards have a size that is not a multiple of {step}")
    base = dict(zip([s for s, _ in sizes], np.cumsum([0] + [n // step for _, n in sizes]).tolist(), strict=False))
    fields = "slot long, seq_id long, shard int, byte_offset long, n_tokens int, continues boolean, doc_ids array<long>, doc_starts array<int>"
    schema = f"{fields}, tokens binary" if tokens else f"{fields}, sha256 string"
    ids_at, starts_at, tokens_at = HEAD_BYTES, HEAD_BYTES + 8 * DOCS, HEAD_BYTES + 10 * DOCS

    def parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard, data = _shard(name), np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, step)
                for lo in range(0, len(data), RECORDS):
                    part = data[lo : lo + RECORDS]
                    heads = [struct.unpack(HEAD, x.tobytes()) for x in part[:, : HEAD_BYTES]]
                    docs = [(x[ids_at:starts_at].view("<i8")[: h[1]], x[starts_at:tokens_at].view("<u2")[: h[1]]) for x, h in zip(part, heads, strict=True)]
                    told = [x[tokens_at : tokens_at + 2 * h[0]].tobytes() for x, h in zip(part, heads, strict=True)]
                    at = np.arange(lo, lo + len(part), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(base[shard] + at),
                            pa.array([h[3] for h in heads], pa.int64()),
                            pa.array(np.full(len(part), shard, np.int32)),
                            pa.array(at * step),
                            pa.array([h[0] for h in heads], pa.int32()),
                            pa.array([bool(h[2]) for h in heads]),
                            pa.array([d[0] for d in docs], pa.list_(pa.int64())),
                            pa.array([d[1].astype(np.int32) for d in docs], pa.list_(pa.int32())),
                            pa.array(told, pa.binary()) if tokens else pa.array([hashlib.sha256(x).hexdigest() for x in told], pa.string()),
                        ],
                        names=["slot", "seq_id", "shard", "byte_offset", "n_tokens", "continues", "doc_ids", "doc_starts", "tokens" if tokens else "sha256"],
                    )
            del b
        give_back()

    return files.select("path", "content").mapInArrow(parsed, schema)


def training_order(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, fixed: bool = False, phase: str | None = None) -> DataFrame:
    """Write docs as shards into the shared folder and return what they hold, with the digest of the tokens (sha256) in their place."""
    spark = docs.sparkSession
    path = fresh(spark, "shards")
    write_shards(docs, path, length, per_shard, key, fixed=fixed, phase=phase)
    return read_shards(spark, path, length, tokens=False)
