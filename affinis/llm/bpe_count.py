"""Token counts by byte-pair merging with a heap over a linked list: initial symbols minus merges, no identifiers.

Works from the ranks of a sentencepiece BPE model with byte fallback: the text gets a leading space if it isn't empty,
spaces become U+2581, each character is a symbol, and the adjacent pair with the best score (the leftmost among equals)
merges until none is in the vocabulary. A symbol left over that is not in the vocabulary counts its UTF-8 bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import give_back, small_batches

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Entries that a worker remembers; beyond, it starts anew (about 100 bytes each).
REMEMBER = 1_500_000


class MergeCounter:
    """Counts tokens of texts under one model."""

    def __init__(self, ranks: dict[str, int]) -> None:
        """ranks: piece -> rank, the lowest merges first; equal ranks merge from the left."""
        self.ranks = ranks
        self.pairs = {p[i : i + 2] for p in ranks for i in range(len(p) - 1)}
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in ranks)
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> MergeCounter:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        order = {s: r for r, s in enumerate(sorted({m.get_score(i) for i in pieces}, reverse=True))}
        return cls({m.id_to_piece(i): order[m.get_score(i)] for i in pieces})

    def merged(self, text: str) -> int:
        """Tokens of one run of symbols."""
        ranks, n = self.ranks, len(text)
        sym = list(text)
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heap = []
            for i in range(n - 1):
                r = ranks.get(text[i : i + 2])
                if r is not None:
                    heap.append((r, i, text[i : i + 2]))
            heapq.heapify(heap)
            while heap:
                _, i, pair = heapq.heappop(heap)
                a = sym[i]
                if a is None or (j := after[i]) >= n or a + sym[j] != pair:
                    continue
                sym[i], sym[j] = pair, None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = ranks.get(x := pair + sym[k])
                    if r is not None:
                        heapq.heappush(heap, (r, i, x))
                if (h := before[i]) >= 0:
                    r = ranks.get(x := sym[h] + pair)
                    if r is not None:
                        heapq.heappush(heap, (r, h, x))
        return sum(1 if s in ranks else len(s.encode()) for s in sym if s is not None)

    def part(self, text: str) -> int:
        got = self.parts.get(text)
        if got is None:
            if len(self.parts) >= REMEMBER:
                self.parts.clear()
            got = self.merged(text)
            if len(text) <= 64:
                self.parts[text] = got
        return got

    def word(self, text: str) -> int:
        """Tokens of a space and the characters up to the next one. No merge crosses a pair of characters that no piece holds."""
        pairs, start, total = self.pairs, 0, 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                total += self.part(text[start:i])
                start = i
        return total + self.part(text[start:])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.inner_space:
            return self.merged(SPACE + text.replace(" ", SPACE))
        words = text.replace(SPACE, " ").split(" ")
        known, total, runs = self.words, 0, 0
        for w in words:
            if w:
                if runs:
                    total += self.word(SPACE * (runs + 1) + w)
                    runs = 0
                else:
                    got = known.get(w)
                    if got is None:
                        got = self.word(SPACE + w)
                        if len(w) <= 64:
                            if len(known) >= REMEMBER:
                                known.clear()
                            known[w] = got
                    total += got
            else:
                runs += 1
        if runs:
            total += self.word(SPACE * runs)
        return total


_LOADED: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _LOADED:
        _LOADED[path] = MergeCounter.load(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row, in the partitions that docs has: nothing is shuffled.

    A null or empty text has no bytes and no tokens. Texts of any length are counted whole. Repeated rows and null
    keys stay. Only key and text are read, so further columns may have any name. model: the path of the vocabulary
    file on the workers.
    """
    small_batches(docs.sparkSession)
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for b in it:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([count(x.as_py()) for x in b.column(2)], pa.int64())], names=["key", "n_bytes", "n_tokens"]
            )
        give_back()

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(batches, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
