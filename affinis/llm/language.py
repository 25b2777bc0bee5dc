"""Language identification: the nearest of several centroids per language, by cosine of TF-IDF vectors of byte n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_share, give_back, small_batches, with_added

DIM = 1 << 13
#: Rows that a model is fitted on, over all languages, about.
FIT_ROWS = 4000
MAX_LANGUAGES = 200
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes of lower-cased text; all but letters and non-ASCII bytes count as a space.
_LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def counts(text: str | None) -> np.ndarray:
    """How often each hashed pair and triple of bytes occurs; a space stands before and after the text."""
    b = _LETTERS[np.frombuffer(f" {text or ''} ".lower().encode(), np.uint8)]
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - 13)
    return np.bincount((two * np.uint32(0x2C1B3C6D)) >> shift, minlength=DIM) + np.bincount(three >> shift, minlength=DIM)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return unit(np.log1p(rows).astype(np.float32) * self.idf)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid (the first among equals), and the cosine to it."""
        cosine = self.vectors(rows) @ self.centroids.T
        best = cosine.argmax(1)
        return best, cosine[np.arange(len(rows)), best]


def cluster(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Spherical k-means from k-means++ seeds; empty clusters go."""
    rnd = np.random.default_rng(seed)
    at = [int(rnd.integers(len(x)))]
    for _ in range(min(k, len(x)) - 1):
        far = np.maximum(1 - (x @ x[at].T).max(1), 0) ** 2
        if far.sum() <= 1e-9:
            break
        at.append(int(rnd.choice(len(x), p=far / far.sum())))
    c = x[at]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = unit(np.stack([x[near == j].mean(0) for j in range(len(c)) if (near == j).any()]))
    return c


def train(rows: np.ndarray, languages: list[str], per_language: int = 4, reject_share: float = 0.005) -> Model:
    """rows: counts; languages: of each row. A language's limit of rejection is the cosine that reject_share of its rows fall short of."""
    names = sorted(set(languages))
    df = sum(((rows[lo : lo + 256] > 0).sum(0) for lo in range(0, len(rows), 256)), np.zeros(DIM, np.int64))
    model = Model(names, (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, np.int64), np.zeros(len(names)))
    x, lang = np.empty(rows.shape, np.float32), np.array([names.index(v) for v in languages], np.int64)
    for lo in range(0, len(rows), 256):  # so that few copies of so large a matrix are held at a time
        x[lo : lo + 256] = model.vectors(rows[lo : lo + 256])
    parts = [cluster(x[lang == i], per_language) for i in range(len(names))]
    if parts:
        model.centroids, model.owner = np.concatenate(parts).astype(np.float32), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        model.least = np.array([float(np.quantile((x[lang == i] @ p.T).max(1), reject_share)) for i, p in enumerate(parts)])
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS, per_language: int = 4) -> Model:
    """Learn from about fit_rows rows of docs in all, as many of each language, chosen by a hash of the key.

    Rows without a language or without a letter are left out. The n-gram counts of the chosen rows come to the driver.
    At most MAX_LANGUAGES languages.
    """
    small_batches(docs.sparkSession)
    named = docs.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    n = named.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chosen = bounded_share(named, "key", "lang", fit_rows // max(n, 1))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            kept = [(r["lang"], counts(r["text"])) for r in b.to_pylist() if has_letter(r["text"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in kept], pa.string()), pa.array([np.minimum(c, 65535).astype(np.uint16).tobytes() for _, c in kept], pa.binary())], names=["lang", "counts"]
            )

    got = sorted(((r[0], r[1]) for r in chosen.mapInArrow(batches, "lang string, counts binary").collect()), key=lambda r: (r[0], bytes(r[1])))
    rows = np.empty((len(got), DIM), np.uint16)
    languages = [k for k, _ in got]
    for i in range(len(got)):
        rows[i], got[i] = np.frombuffer(got[i][1], np.uint16), None
    return train(rows, languages, per_language)


def predict(docs: DataFrame, model: Model, text: str = "text", block: int = 64) -> DataFrame:
    """Every row of docs with lang_pred, score (cosine, 0 to 1) and rejected added; nothing is shuffled.

    A null text, and one without a letter, is ``und`` with score 0 and rejected; so is every text if no language was
    learned. Any other gets the language of its nearest centroid; rejected tells that it is further away than that
    language's own texts are. Whole texts count. Repeated rows stay; columns of docs with the names of added ones are
    replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    place = docs.columns.index(text)
    schema = with_added(docs, "lang_pred string, score double, rejected boolean")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lang, score, out = ["und"] * b.num_rows, [0.0] * b.num_rows, [True] * b.num_rows
            for lo in range(0, b.num_rows, block):
                part = b.column(place).slice(lo, block).to_pylist()
                some = [i for i, x in enumerate(part) if has_letter(x)] if len(model.centroids) else []
                if some:
                    best, cosine = model.nearest(np.stack([counts(part[i]) for i in some]))
                    for i, j, c in zip(some, best.tolist(), cosine.tolist(), strict=True):
                        own = int(model.owner[j])
                        lang[lo + i], score[lo + i], out[lo + i] = model.languages[own], min(max(c, 0.0), 1.0), bool(c < model.least[own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=schema.names)
        give_back()

    return docs.mapInArrow(batches, schema)
