"""Near-duplicate documents by SimHash, linked through BK-trees.

Fingerprints are made where the texts are. Only distinct fingerprints go on: each goes to
the buckets of every pair of its five blocks of bits, since of two fingerprints that differ
in at most three bits at least two blocks agree. A bucket is a shard with a BK-tree of its
own, whose children are keyed by the Hamming distance to their parent; every member is
looked up along the edges within the radius. A large bucket is dealt into parts, and every
pair of parts is a shard, so no task holds more than two parts and no link is lost. Shards
return spanning links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.components import connected_components
from skyloom.llm.workspace import materialise

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Members of one part of a bucket, at most about.
PART = 4096
_VOTES = 1 << 16


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _decided(votes: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of the 64-bit hashes of a text's shingles, repeats included."""
    return _decided(sum(_votes(hashes[at : at + _VOTES]) for at in range(0, len(hashes), _VOTES)), len(hashes))


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the space-joined shingles of a text, as an unsigned 64-bit number.

    A-Z become lower case, words are separated by the six ASCII white-space characters. Fewer
    words than a shingle has are one shingle; no words give 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), _VOTES):
        hashes = np.array([digest(line[s:e], seed) for s, e in zip(starts[at : at + _VOTES], stops[at : at + _VOTES], strict=True)], "<u8")
        votes += _votes(hashes)
    return _decided(votes, len(starts))


def with_fingerprints(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row with fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps)], [*batch.schema.names[1:], "fp"])

    taken = df.select(F.col("text").alias("text_"), *columns)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in taken.schema.fields[1:])
    return taken.mapInArrow(run, f"{schema}fp long")


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct ``fps`` (uint64), the index of each one's least linked member, by a BK-tree.

    The first of a subtree is its root and the rest hang under it by their distance to it;
    all look-ups that reach a root are answered together, and go on along the edges within
    the radius of their distance. A subtree that is already joined with all that look it up
    is left.
    """
    label = np.arange(len(fps))
    todo = [(label.copy(), label.copy())]
    while todo:
        tree, asking = todo.pop()
        root, rest = tree[0], tree[1:]
        far = np.bitwise_count(fps[asking] ^ fps[root])
        near = label[asking[far <= radius]]
        if len(near):
            joined = np.unique(np.append(near, label[root]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
        if len(rest):
            edge = np.bitwise_count(fps[rest] ^ fps[root])
            for d in np.unique(edge):
                child = rest[edge == d]
                go = asking[np.abs(far.astype(np.int16) - int(d)) <= radius]
                if len(go) and (label[np.concatenate([go, child])] != label[go[0]]).any():
                    todo.append((child, go))
    return label


def _blocks(fp: Column, radius: int) -> list[Column]:
    """The values of radius + 2 blocks of bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bucketed(fps: DataFrame, radius: int) -> DataFrame:
    """(bucket, fp) for every pair of blocks."""
    blocks = _blocks(F.col("fp"), radius)
    pairs = [F.xxhash64(F.lit(i * 100 + j), blocks[i], blocks[j]) for i, j in combinations(range(len(blocks)), 2)]
    return fps.select(F.explode(F.array(*pairs)).alias("bucket"), "fp")


def _shards(keyed: DataFrame, part: int) -> DataFrame:
    """(bucket, i, j, fp): buckets of two or more members, the large ones as all pairs i <= j of their parts."""
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(part)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")),
    )
    return (
        keyed.join(sizes, "bucket")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .select("bucket", "fp", F.explode(cells).alias("c"))
        .select("bucket", "c.i", "c.j", "fp")
    )


def _links(shards: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        for batch in chain(batches, [None]):  # None: nothing follows
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = np.stack([np.asarray(c, np.int64) for c in batch.columns])
                held = np.concatenate([held, new], axis=1)
            if not held.shape[1]:
                continue
            starts = np.flatnonzero(np.append(True, (held[:3, 1:] != held[:3, :-1]).any(axis=0)))
            stops = np.append(starts[1:], held.shape[1])
            if batch is not None:  # the last shard may go on
                last = starts[-1]
                starts, stops = starts[:-1], stops[:-1]
            left, right = [], []
            for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
                if e - s < 2:
                    continue
                fps = np.unique(held[3, s:e])
                label = spanning_links(fps.view(np.uint64), radius)
                moved = np.flatnonzero(label != np.arange(len(fps)))
                left.append(fps[moved])
                right.append(fps[label[moved]])
            held = held[:, last:] if batch is not None else held[:, :0]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["u", "v"])

    ordered = shards.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def link_fingerprints(spark: SparkSession, fps: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """(node, root) of distinct fingerprints (fp long) that reach a smaller one over links of at most ``radius`` bits."""
    return connected_components(spark, _links(_shards(_bucketed(fps, radius), part), radius))


def near_duplicates(spark: SparkSession, df: DataFrame, columns: list[str], radius: int = RADIUS) -> DataFrame:
    """``columns``, fp, root and component_id of every row of ``df`` (doc_id, text and any others).

    Columns named fp, root or component_id give way to those of the result.

    root is the least fingerprint of the row's component, component_id is the smallest doc_id that is reachable over links of fingerprints that
    differ in at most ``radius`` bits, the row's own included; null only if no doc_id of the
    component is known. Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows are kept, an empty table gives no rows.
    """
    asked = [c for c in columns if c not in ("fp", "root", "component_id")]
    rows = df.select("text", F.col("doc_id").alias("id_"), F.struct("doc_id", *asked).alias("row_") if "doc_id" not in asked else F.struct(*asked).alias("row_"))
    docs = materialise(spark, with_fingerprints(rows, ["id_", "row_"]), "fingerprints")
    least = docs.groupBy("fp").agg(F.min("id_").alias("least"))
    roots = link_fingerprints(spark, docs.select("fp").distinct(), radius)
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return docs.join(named, "fp").select(*[F.col("row_").getField(c).alias(c) for c in asked], "fp", "root", "component_id")
