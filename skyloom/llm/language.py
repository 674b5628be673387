"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed letter n-grams. Each language has several
centroids, found by spherical k-means over a bounded, hash-chosen sample of labelled rows.
The language of the centroid with the largest cosine wins; a text that is much farther from it
than learned texts with as many different n-grams are is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 1 << 13
#: Labelled rows of each language that the classifier is fitted on, about; the hash of doc_id chooses them.
SAMPLE_PER_LANG = 400
CENTROIDS = 4
#: Languages whose counts may be broadcast; if there are more, the join is shuffled.
MOST_LANGS = 10_000
#: A text is rejected when its cosine is under this share of the median of learned texts with about as many different n-grams,
#: or, with fewer than LEAST_GRAMS of them, which tell little, under MARGIN of the least cosine of a learned text.
SHARE, MARGIN, LEAST_GRAMS = 0.75, 0.25, 363
#: Learned texts of a language that a median is taken of, at least.
ENOUGH = 30
_BINS = 2 * DIMS.bit_length()
UNKNOWN = "und"
_GAPS = re.compile(r"[\W\d_]+")


def term_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the UTF-8 bytes of lower-cased words; None without a letter."""
    words = _GAPS.sub(" ", text.lower()) if text else ""
    if not any(map(str.isalpha, words)):
        return None
    a = np.frombuffer(f" {words.strip()} ".encode(), np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(257) + a[2:]
    grams = np.concatenate([a, two + np.uint32(1 << 18), three + np.uint32(1 << 26)])
    hashed = (grams * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
    return np.bincount(hashed, minlength=DIMS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class CentroidModel:
    langs: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def vectors(self, counts: list[np.ndarray]) -> np.ndarray:
        return _unit(np.log1p(np.stack(counts).astype(np.float32)) * self.idf)

    def predict(self, counts: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine in 0 to 1, and whether it is rejected, of each."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        top = cosines[np.arange(len(best)), best]
        rejected = top < self.floors[best, evidence_bins(counts)]
        return [self.langs[self.owner[b]] for b in best], np.clip(top, 0, 1).astype(float), rejected


def _without_own(x: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """Each row's largest cosine to the centroids, to its own as it would be without the row."""
    own = cosines.argmax(axis=1)
    sums = np.stack([x[own == j].sum(axis=0) for j in range(cosines.shape[1])])
    left_out = (x * _unit(sums[own] - x)).sum(axis=1)
    others = np.where(np.arange(cosines.shape[1]) == own[:, None], -1, cosines).max(axis=1)
    return np.maximum(left_out, others)


def evidence_bins(counts: list[np.ndarray]) -> np.ndarray:
    """Half doublings of the number of different n-grams of each."""
    return (2 * np.log2([max(1, int(np.count_nonzero(c))) for c in counts])).astype(int)


def rejection_floors(cosines: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The least cosine that is accepted, by evidence bin, of learned texts' cosines; a bin without ENOUGH texts is like the next below that has them."""
    floors = np.full(_BINS, MARGIN * max(0.0, cosines.min()))
    known = np.flatnonzero(np.bincount(bins) >= ENOUGH)
    known = known[known >= int(2 * np.log2(LEAST_GRAMS))]
    for b in range(known[0] if len(known) else _BINS, _BINS):
        floors[b] = max(floors[b], SHARE * np.median(cosines[bins == known[known <= b][-1]]))
    return floors


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and each row's cosine to its own; the start is farthest-first, so no chance is involved."""
    picked = [int((x @ _unit(x.mean(axis=0))).argmax())]
    while len(picked) < min(k, len(x)):
        picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
    centres = x[picked]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.stack([_unit(x[own == j].mean(axis=0)) if (own == j).any() else centres[j] for j in range(len(centres))])
    cosines = x @ centres.T
    return centres, cosines


def fit_model(counts: list[np.ndarray], langs: list[str], k: int = CENTROIDS) -> CentroidModel:
    """The model of labelled count vectors, in any order."""
    order = sorted(range(len(langs)), key=lambda i: (langs[i], counts[i].tobytes()))
    stack = np.stack([counts[i] for i in order]) if order else np.zeros((0, DIMS))
    labels = np.array([langs[i] for i in order], object)
    idf = np.log((1 + len(order)) / (1 + (stack > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(np.log1p(stack.astype(np.float32)) * idf)
    names = sorted(set(langs))
    bins = evidence_bins(list(stack))
    owner, centres, floors = [], [], []
    for n, name in enumerate(names):
        mine = x[labels == name]
        found, cosines = _k_means(mine, k)
        own = cosines.argmax(axis=1)
        floor = rejection_floors(_without_own(mine, cosines), bins[labels == name])
        for j in range(len(found)):
            if (own == j).any():
                owner.append(n)
                centres.append(found[j])
                floors.append(floor)
    return CentroidModel(names, np.array(owner, int), np.array(centres, np.float32).reshape(-1, DIMS), np.array(floors).reshape(-1, _BINS), idf)


def is_held_out(doc_id: F.Column | str = "doc_id"):
    """Whether the row is kept from learning: crc32 of doc_id as text is 2 modulo 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(df: DataFrame, per_lang: int = SAMPLE_PER_LANG, k: int = CENTROIDS) -> CentroidModel:
    """Fit on about ``per_lang`` rows of each lang, of those that are not held out.

    The rows are those with the least hashes of doc_id, by a share of the hash range that
    follows each language's count, so the sample is the same on every run and bounded.
    """
    able = df.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()
    )
    sizes = able.groupBy("lang").agg(F.count("*").alias("n"))
    if sizes.limit(MOST_LANGS + 1).count() <= MOST_LANGS:
        sizes = F.broadcast(sizes)
    share = F.lit(per_lang) / F.greatest(F.col("n"), F.lit(per_lang))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(term_counts(t), n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = [x for x in found if x[0] is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0].astype("<u4").tobytes() for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())],
                ["counts", "lang"],
            )

    sample = able.join(sizes, "lang").filter(place < share).select("text", "lang")
    rows = sample.mapInArrow(count, "counts binary, lang string").collect()
    return fit_model([np.frombuffer(r.counts, "<u4") for r in rows], [r.lang for r in rows], k)


def identify(spark: SparkSession, df: DataFrame, model: CentroidModel, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``df`` with lang_pred string, score double and rejected boolean.

    A text that is null or has no letter, or any text when nothing was learned, is ``und``
    with score 0 and rejected. Equal cosines go to the language first in order. Whole texts
    are used, of any length; repeated rows are scored one by one, and ``columns`` may have
    any names but those three and ``text_``.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = [term_counts(x.as_py()) for x in part.column(0)]
                there = [i for i, c in enumerate(counts) if c is not None and m.langs]
                langs, score, out = [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
                if there:
                    found, cosines, far = m.predict([counts[i] for i in there])
                    score[there], out[there] = cosines, far
                    for i, name in zip(there, found, strict=True):
                        langs[i] = name
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(langs, pa.string()), pa.array(score), pa.array(out)],
                    [*part.schema.names[1:], "lang_pred", "score", "rejected"],
                )

    taken = df.select(F.col("text").alias("text_"), *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[1:])
    return taken.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
