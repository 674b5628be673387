"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-case words. Karp-Rabin hashes of all
windows of a few words are looked up in the items' index; a document and an item with a
common window are a pair. In a pair, the longest match of unmarked words is marked again and
again until none of the least length is left, so passages are found in whatever order they
come. An item leaks into a document if the tiles cover enough of its words.

Items are indexed in slices of bounded size. A slice is broadcast, documents stream past it,
and only pairs come out; a larger benchmark means more passes, not larger tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a seed and of the shortest tile; share of an item's words that tiles must cover.
SEED_WORDS, COVERAGE = 5, 0.5
#: Characters of the items that one broadcast slice holds at most, about.
SLICE_CHARS = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = r"[\p{P}\p{S}]+"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts and where each text's words begin (and the last end).

    Words are lower-case; punctuation and symbols are white space.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _PUNCTUATION, " ")
    lists = pc.utf8_split_whitespace(plain)
    offsets = np.asarray(lists.offsets, np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    # white space at either end leaves empty words
    full = np.asarray(pc.not_equal(words, ""))
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), before[offsets]


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k words, given by number; at least one window must fit."""
    out = np.zeros(len(ids) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _BASE + ids[i : len(ids) - k + 1 + i]
    return out


def tiles(item: np.ndarray, doc: np.ndarray, seeds: np.ndarray | list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length) of the tiles, the longest first.

    ``seeds`` are the places where a window of ``least`` words begins in both. Matches of equal
    length are taken by their places.
    """
    if not len(seeds):
        return []
    pairs = np.asarray(seeds, np.int64)
    places = np.unique(pairs[:, 0] * len(doc) + pairs[:, 1])
    seed_set = np.stack([places // len(doc), places % len(doc)], axis=1)
    diagonal = seed_set[:, 1] - seed_set[:, 0]
    order = np.lexsort((seed_set[:, 0], diagonal))
    seed_set, diagonal = seed_set[order], diagonal[order]
    new = np.append(True, (np.diff(diagonal) != 0) | (np.diff(seed_set[:, 0]) != 1))
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(seed_set)))
    queue = [(-(int(n) + least - 1), int(seed_set[s, 0]), int(seed_set[s, 1])) for s, n in zip(starts, runs, strict=True)]
    heapq.heapify(queue)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    found = []
    while queue:
        n, i, j = heapq.heappop(queue)
        n = -n
        taken = in_item[i : i + n] | in_doc[j : j + n]
        if not taken.any():
            in_item[i : i + n] = True
            in_doc[j : j + n] = True
            found.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(queue, (a - b, i + a, j + a))
    return found


@dataclass
class Slice:
    """Items of the benchmark with an index of their windows' hashes."""

    item_ids: list
    items: list[np.ndarray]
    vocabulary: list[str]
    least: int

    def prepare(self) -> Slice:
        self.lengths = sorted({min(self.least, len(x)) for x in self.items})
        self.index = {}
        self.words = pa.array(self.vocabulary, pa.string())
        for k in self.lengths:
            hashes, owner, place = [], [], []
            for n, x in enumerate(self.items):
                if min(self.least, len(x)) == k:
                    h = window_hashes(x, k)
                    hashes.append(h)
                    owner.append(np.full(len(h), n))
                    place.append(np.arange(len(h)))
            h, o, p = map(np.concatenate, (hashes, owner, place))
            order = np.argsort(h, kind="stable")
            self.index[k] = h[order], o[order], p[order]
        return self

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]], int]]:
        """(row, item, tiles, words of the item) of every pair with a common window."""
        words, offsets = words_of(texts)
        ids = np.asarray(pc.fill_null(pc.index_in(words, self.words), -1)).astype(np.int64)
        known = ids >= 0
        numbers = (ids + 1).astype(np.uint64)
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for k in self.lengths:
            if len(numbers) < k:
                continue
            whole = np.convolve(known, np.ones(k, np.int64), "valid") == k
            whole &= row_of[k - 1 :] == row_of[: len(row_of) - k + 1]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            hashes, owner, place = self.index[k]
            mine = window_hashes(numbers, k)[at]
            lo, hi = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
            hit = hi > lo
            at, lo, hi = at[hit], lo[hit], hi[hit]
            n = hi - lo
            doc_at = np.repeat(at, n)
            entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            row, item, start = row_of[doc_at], owner[entry], place[entry]
            order = np.lexsort((item, row))
            row, item, start, doc_at = row[order], item[order], start[order], doc_at[order]
            edges = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0))) if len(row) else []
            for a, b in zip(edges, np.append(edges[1:], len(row)) if len(row) else [], strict=True):
                r, t = int(row[a]), int(item[a])
                doc, x = numbers[offsets[r] : offsets[r + 1]], self.items[t]
                d0 = int(offsets[r])
                same = np.ones(b - a, bool)
                for w in range(k):  # hashes may agree by chance
                    same &= x[start[a:b] + w] == numbers[doc_at[a:b] + w]
                yield r, t, tiles(x, doc, np.stack([start[a:b][same], doc_at[a:b][same] - d0], axis=1), k), len(x)


def slices(benchmark: DataFrame, least: int = SEED_WORDS, chars: int = SLICE_CHARS) -> Iterator[Slice]:
    """The benchmark (item_id, text) in slices of at most about ``chars`` characters, dealt by a hash of id and text, so that copies are spread.

    Items without a word are left out; no document can hold them.
    """
    total = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-total * 2 // chars)) if total > chars else 1
    for k in range(n):
        rows = benchmark.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text or ""))
        words, offsets = words_of(pa.array([r.text for r in rows], pa.string()))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        numbers = np.asarray(coded.indices).astype(np.uint64) + np.uint64(1)
        there = [i for i in range(len(rows)) if offsets[i + 1] > offsets[i]]
        yield Slice([rows[i].item_id for i in there], [numbers[offsets[i] : offsets[i + 1]] for i in there], coded.dictionary.to_pylist(), least)


def find_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = SEED_WORDS, coverage: float = COVERAGE
) -> DataFrame:
    """doc_id, item_id, n_tiles, covered, item_words and coverage of every item that leaks into a document.

    A pair is returned if tiles of at least ``least`` words, or of the whole item if that is
    shorter, cover at least ``coverage`` of the item's words. Null and empty texts leak
    nothing, whole texts of any length are read, repeated rows and items are reported one by
    one, and other columns are not looked at.
    """
    schema = "doc_id long, item_id long, n_tiles long, covered long, item_words long, coverage double"
    parts = []
    for piece in slices(benchmark, least):
        shared = spark.sparkContext.broadcast(piece)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = shared.value.prepare()
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    out = [
                        (some.column(0)[r].as_py(), part.item_ids[t], len(found), c, n, c / n)
                        for r, t, found, n in part.find(some.column(1))
                        if (c := sum(x[2] for x in found)) >= coverage * n
                    ]
                    if out:
                        kinds = [pa.int64()] * 5 + [pa.float64()]
                        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

        parts.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = SEED_WORDS, coverage: float = COVERAGE
) -> DataFrame:
    """The rows of ``docs``, all columns, into which no item leaks; decided row by row, as ``find_leaks`` does."""
    columns = docs.columns
    for piece in slices(benchmark, least):
        shared = spark.sparkContext.broadcast(piece)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = shared.value.prepare()
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    clean = np.ones(some.num_rows, bool)
                    for r, _, found, n in part.find(some.column(some.schema.get_field_index("text"))):
                        if sum(x[2] for x in found) >= coverage * n:
                            clean[r] = False
                    yield some.filter(pa.array(clean))

        docs = docs.select(*columns).mapInArrow(run, docs.schema)
    return docs
