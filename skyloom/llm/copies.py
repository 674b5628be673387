"""Near copies of documents: pairs whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates are the links of op9: SimHash fingerprints that differ in at most three bits, found
in BK-trees. They cannot be all: pairs at 0.8 differ in about ten bits of 64, more than any
blocks of bits can be searched for. MinHash adds the rest: BANDS keys of ROWS minima each, of
which a pair at 0.8 shares none with a chance of 1.3e-7. Candidates are joined into groups, and within a group every
pair that could still join two parts is compared on its whole sets of shingles, so nothing
is a copy by its keys alone. Large groups are dealt into parts and every pair of parts is compared in a
task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.components import connected_components
from skyloom.llm.lines import _BYTES, ODD, SLICE_BYTES, SLICE_LINES, _bytes_of, _mixed, _sequence_hash, _slices
from skyloom.llm.simhash import fingerprint_of, link_fingerprints
from skyloom.llm.workspace import materialise

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
#: Members and shingles of one part of a group, at most about.
PART, PART_SHINGLES = 1000, 250_000
#: Shingles that are mixed at once.
_STRETCH = 1 << 9
#: Bytes with A-Z as lower case and white space as a space.
_LOWER = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\v\f\r", b" " * 5)), np.uint8)


def shingles_of(texts: pa.Array, words: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, hashes, ends): for slices of texts where they begin, the hashes of all their shingles, repeats included, and where those of each end.

    Words are as op9 takes them: A-Z become lower case, white space of ASCII parts them. Too few words are one shingle, no words too.
    """
    texts = pc.fill_null(texts, "")
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    for a, b in _slices(sizes, SLICE_BYTES, SLICE_LINES):
        raw, begin = _bytes_of(texts.slice(a, b - a))
        # a text's end is a word's end
        parted = np.full(len(raw) + b - a, 0x20, np.uint8)
        begin = begin + np.arange(b - a + 1)
        inside = np.ones(len(parted), bool)
        inside[begin[1:] - 1] = False
        parted[inside] = _LOWER[raw]
        letter = np.zeros(len(parted) + 1, np.int8)
        letter[1:] = parted != 0x20
        step = np.diff(letter)
        first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        size = end - first
        codes = _sequence_hash(_BYTES[parted[letter[1:].view(bool)]], np.cumsum(size) - size, size) if len(size) else np.zeros(0, np.uint64)
        start = np.searchsorted(first, begin)
        n, start = np.diff(start), start[:-1]
        count = np.maximum(n - words + 1, 1)
        ends = np.cumsum(count)
        of = np.repeat(np.arange(b - a), count)
        at = start[of] + np.arange(len(of)) - (ends - count)[of]
        # all shingles have so many words, but those of short texts
        hashes = np.zeros(len(of), np.uint64)
        padded = np.r_[codes, np.zeros(words, np.uint64)]
        for k in range(words):
            hashes = hashes * ODD + np.where(k < n[of], padded[at + k], np.uint64(0))
        yield a, _mixed(hashes + np.minimum(n, words).astype(np.uint64)[of]), ends


def _sets(texts: pa.Array, words: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of each text's shingles, and its set of them, sorted."""
    for _, hashes, ends in shingles_of(texts, words):
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            one = hashes[a:b]
            known = np.sort(one)
            yield one, known[np.r_[True, known[1:] != known[:-1]]]


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**32, (2, BANDS * ROWS, 1), np.uint32)
    return a | np.uint32(1), b


def least_of(shingles: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least of 32 bits of the shingles under each mixer."""
    a, b = mixers
    least, bits = np.full(BANDS * ROWS, 2**32 - 1, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(bits), _STRETCH):
        mixed = bits[at : at + _STRETCH] * a
        mixed += b
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of the minima of each row."""
    bands, key = least.reshape(len(least), BANDS, ROWS).astype(np.uint64), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed((key + np.uint64(1)) * ODD + bands[:, :, k])
    return key.view(np.int64)


def _signed(df: DataFrame) -> DataFrame:
    """unknown, doc_id, text_hash, sid (a hash of the set), size, fp (the SimHash of all shingles) and keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _mixers()
        for batch in batches:
            if not batch.num_rows:
                continue
            fps, sids, sizes, least = [], [], [], []
            for hashes, shingles in _sets(batch.column(0)):
                fps.append(fingerprint_of(hashes))
                sids.append(xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63))
                sizes.append(len(shingles))
                least.append(least_of(shingles, mixers))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(least) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band_keys(np.stack(least)).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), fp, keys], [*batch.schema.names[1:], "sid", "size", "fp", "keys"])

    rows = df.select("text", F.col("doc_id").isNull().alias("unknown"), "doc_id", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "unknown boolean, doc_id long, text_hash long, sid long, size long, fp long, keys array<long>")


def spanning_copies(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each of sorted sets of shingles the index of a member of its group, the same for all that are linked."""
    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    label = np.arange(len(sets))
    mark = np.zeros(len(codes) + 1, np.int64)
    for x in range(len(sets)):
        low, high = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        if not ((label != label[x]) & (low >= similarity * high - 1e-9)).any():
            continue
        own = codes[starts[x] : starts[x] + sizes[x]]
        mark[own] = 1
        shared = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        alike = shared >= similarity * (sizes + sizes[x] - shared) - 1e-9
        hit = np.unique(label[alike])
        if len(hit) > 1:
            label[np.isin(label, hit)] = hit[0]
    return label


def _links(cells: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = dict(zip(table["sid"].to_pylist(), table["shingles"].to_pylist(), strict=True))
        sids = np.array(sorted(rows), np.int64)
        label = spanning_copies([np.frombuffer(rows[s], np.uint64) for s in sids.tolist()])
        moved = np.flatnonzero(label != np.arange(len(sids)))
        return pa.table({"u": pa.array(sids[moved]), "v": pa.array(sids[label[moved]])})

    return cells.groupBy("root", "i", "j").applyInArrow(run, "u long, v long").distinct()


def _with_sets(df: DataFrame) -> DataFrame:
    """sid, root, parts and the set as bytes of every row of (text, sid, root, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for _, s in _sets(batch.column(0))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sets], [*batch.schema.names[1:], "shingles"])

    return df.select("text", "sid", "root", "parts").mapInArrow(run, "sid long, root long, parts int, shingles binary")


def fingerprint_links(spark: SparkSession, reps: DataFrame) -> DataFrame:
    """(u, v) that join all sids of (sid, fp) whose fingerprints reach one another over links of op9."""
    roots = link_fingerprints(spark, reps.select("fp").distinct())
    rooted = reps.select("sid", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("sid", F.coalesce("root", "fp").alias("root"))
    leads = rooted.groupBy("root").agg(F.min("sid").alias("v"), F.count("*").alias("n")).filter("n > 1").select("root", "v")
    return rooted.join(leads, "root").select(F.col("sid").alias("u"), "v")


def first_copies(spark: SparkSession, df: DataFrame, part: int = PART) -> DataFrame:
    """unknown, doc_id and text_hash of one row of each group of near copies: the least, null ids last.

    A group is connected by pairs with a similarity of at least SIMILARITY. Rows that are equal in doc_id and text are one.
    """
    least = F.min(F.struct("unknown", "doc_id", "text_hash", "size", "fp", "keys")).alias("k")
    reps = materialise(spark, _signed(df).groupBy("sid").agg(least).select("sid", "k.*"), "sets")
    keyed = reps.select("sid", F.explode("keys").alias("key"))
    leads = keyed.groupBy("key").agg(F.min("sid").alias("v"), F.count("*").alias("n")).filter("n > 1").select("key", "v")
    by_keys = keyed.join(leads, "key").select(F.col("sid").alias("u"), "v")
    met = connected_components(spark, fingerprint_links(spark, reps).unionByName(by_keys))
    members = met.select(F.col("node").alias("sid"), "root").unionByName(met.select(F.col("root").alias("sid"), "root").distinct())
    known = materialise(spark, members.join(reps.drop("keys", "fp"), "sid"), "candidates")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(part)), F.ceil(F.sum("size") / F.lit(PART_SHINGLES))).cast("int")
    dealt = known.join(known.groupBy("root").agg(parts.alias("parts")), "root").select("sid", "root", "parts", F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    docs = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    sets = _with_sets(docs.join(dealt, same))
    own = F.pmod(F.xxhash64("sid", F.lit(7)), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    shared = F.filter(cells, lambda x: (x["i"] != x["j"]) | (F.col("parts") == 1))
    links = _links(sets.select("sid", "root", "shingles", F.explode(shared).alias("c")).select("sid", "root", "c.i", "c.j", "shingles"))
    roots = connected_components(spark, links)
    grouped = reps.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return grouped.groupBy("root").agg(F.min(F.struct("unknown", "doc_id", "text_hash")).alias("kept")).select("kept.*")
