"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all items, one scan of each text.

The alphabet is words, so a match's place is its word number; word numbers map back to character offsets of the
original text for the texts that are hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import give_back, small_batches, with_added
from ._words import AS_WORDS

WINDOW = 13
#: Characters of items that go into one automaton; more items go into further ones, through which texts pass in turn.
ITEM_CHARS = 8 << 20
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_ADDED = ("n_words", "hits", "items")


def word_list(text: str | None) -> list[bytes]:
    return text.encode().translate(AS_WORDS).split() if text else []


class Scanner:
    """The automaton of some items: (item_id, text) rows."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW) -> None:
        import ahocorasick

        self.ids: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in word_list(text)]
            for i in range(max(1, len(w) - window + 1)) if w else ():
                windows.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in windows.items():
            self.automaton.add_word(key, (len(key), found))
        self.some = bool(windows)
        if self.some:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[int], set[int]]:
        """Runs of hit words as from, to, from, to, ..., and the items with a window that occurs."""
        runs: list[int] = []
        found: set[int] = set()
        if not self.some or not words:
            return runs, found
        get = self.ids.get
        for end, (n, items) in self.automaton.iter(tuple([get(x, 0) for x in words])):
            found |= items
            join(runs, end - n + 1, end + 1)
        return runs, found


def join(runs: list[int], start: int, stop: int) -> None:
    """Add a run to runs that is not before them by its end."""
    while runs and start <= runs[-1]:
        stop = max(stop, runs.pop())
        start = min(start, runs.pop())
    runs += (start, stop)


def spans_of(text: str, runs: list[int]) -> list[dict[str, int]]:
    """Character offsets of runs of words."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "stop": at[b - 1][1]} for a, b in zip(runs[::2], runs[1::2], strict=True)]


_LOADED: dict[int, Scanner] = {}


def _pass(docs: DataFrame, text: str, items: list[tuple[object, str]], kind: T.DataType, window: int, last: bool) -> DataFrame:
    key = hash(tuple(items))
    columns = [c for c in docs.columns if c not in (*_ADDED, "spans")]
    first = "hits" not in docs.columns
    added = f"n_words bigint, hits array<int>, items array<{kind.simpleString()}>" + ", spans array<struct<start: int, stop: int>>" * last
    schema, id_type = with_added(docs, added, columns), pa.list_(to_arrow_type(kind))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Scanner(items, window)
        scan = _LOADED[key].scan
        for b in it:
            n_words, hits, found, spans = [], [], [], []
            for i, x in enumerate(b.column(text)):
                x = x.as_py()
                words = word_list(x)
                runs, ids = scan(words)
                if not first:
                    old = b.column("hits")[i].as_py()
                    both, runs = sorted([*zip(old[::2], old[1::2], strict=True), *zip(runs[::2], runs[1::2], strict=True)], key=lambda r: r[1]), []
                    for r in both:
                        join(runs, *r)
                    ids |= set(b.column("items")[i].as_py())
                n_words.append(len(words))
                hits.append(runs)
                found.append(sorted(ids))
                spans.append(spans_of(x, runs) if runs and last else [])
            made = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, id_type)]
            if last:
                made.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *made], names=schema.names)
        give_back()

    return docs.mapInArrow(batches, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """Every row of docs with n_words, n_hit, items, spans and contaminated added; nothing is shuffled.

    benchmark: item_id, text. Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters. An item's
    windows are its runs of ``window`` words, or all of its words if they are fewer; a word of a text inside any
    occurrence of a window is hit. items: ids (sorted) with a window that occurs; spans: character offsets of the runs
    of hit words. contaminated: some word is hit, and one in ``one_in`` at least. Null and empty texts have no words,
    null and empty items no windows; an empty benchmark hits nothing. Items with a null id are left out. Repeated rows
    stay; columns of docs with the names of added ones are replaced. Texts of any length are scanned whole. Items go to
    the workers with their code; beyond ITEM_CHARS characters of them there are further automata, of about as many each.
    Ids keep their type, whole numbers or strings.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_hit", "contaminated", "spans", *_ADDED)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    kind = items.schema["item_id"].dataType
    parts = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))
    for i in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else items
        docs = _pass(docs, text, sorted(map(tuple, mine.collect())), kind, window, i == parts - 1)
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).drop("hits")
