"""Packing documents into fixed-length token sequences by best-fit decreasing.

A document is its byte-level BPE ids and one end id. Overlong documents are first cut
into full windows; the remainders go, longest first, each into the tightest open window
that a segment tree over the remaining capacities finds. What little stays open at the
end of a batch is topped up by cutting pieces of the emptiest windows, and the last
window is dealt out in powers of two, which need no padding.

Every task packs its own rows in batches of bounded size: nothing is shuffled, no state
is shared, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
END_ID = 1
#: Fixed value: the added token of byte_bpe_50k and its id.
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces and token bytes that one batch holds at most.
BATCH_PIECES, BATCH_BYTES = 16_384, 64 << 20
#: Windows with more than this many free tokens are topped up.
TOP_UP = 8
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
#: A space next to other white space; such a place is no safe cut.
_ODD = re.compile(r" (?=\s)|(?<=\s) ")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CACHED_CHARS, _CACHED = 48, 400_000


class BytePairEncoder(dict):
    """Text to ids, as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins what stands before a single space with what follows, so
    a text is the concatenation of its space-led chunks, and chunks are kept once encoded.
    Strings of special tokens are ordinary text to ``encode`` and tokens to ``encode_all``.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int] | None = None) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in (special or {}).items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.plain(" " + chunk)
        if len(chunk) <= _CACHED_CHARS:
            if len(self) >= _CACHED:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        chunks = _SAFE.split(text) if _ODD.search(text) else text.split(" ")
        return self.plain(chunks[0]) + b"".join([self[c] for c in chunks[1:]])

    def encode_all(self, text: str) -> bytes:
        """Ids of a text in which special tokens stand for themselves, as the tokenizer has it when loaded."""
        if not self.cut or not any(t in text for t in self.special):
            return self.encode(text)
        return b"".join([self.special[t] if k % 2 else self.encode(t) for k, t in enumerate(self.cut.split(text))])


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str | None = None, pattern: str | None = None) -> BytePairEncoder:
    """The encoder of a rank file, loaded once a process; by default the public byte_bpe_50k."""
    special = None
    if path is None:
        import public_tokenizers

        path, pattern, special = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BytePairEncoder(path, pattern, special)
    return _encoders[path, pattern]


class OpenWindows:
    """Windows by remaining capacity; a segment tree finds the tightest that is large enough."""

    def __init__(self, window: int) -> None:
        self.half = 1 << window.bit_length()
        self.counts = [0] * (2 * self.half)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        node = self.half + capacity
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the smallest capacity of at least ``least``."""
        node = self.half + least
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.half:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        capacity = node - self.half
        self._count(capacity, -1)
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Indices of ``lengths``, in that order, dealt to windows; every length is 1 to ``window``."""
    free, windows = OpenWindows(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if (found := free.take(n)) is None:
            found = window, len(windows)
            windows.append([])
        left, w = found
        windows[w].append(i)
        if left > n:
            free.add(left - n, w)
    return windows


def top_up(windows: list[list[tuple[int, int, int]]], window: int, slack: int = TOP_UP) -> list[list[tuple[int, int, int]]]:
    """Cut pieces (owner, start, length) of the emptiest windows to fill the others.

    The last window left over is dealt out in powers of two.
    """
    used = [sum(p[2] for p in w) for w in windows]
    full = [w for w, u in zip(windows, used, strict=True) if window - u <= slack]
    spare = [w for w, u in sorted(zip(windows, used, strict=True), key=lambda x: -x[1]) if window - u > slack]
    fill = 0
    while fill < len(spare) - 1:
        into, giver = spare[fill], spare[-1]
        room = window - sum(p[2] for p in into)
        while room and giver:
            owner, start, length = giver.pop()
            if length > room:
                giver.append((owner, start, length - room))
                start, length = start + length - room, room
            into.append((owner, start, length))
            room -= length
        if not giver:
            spare.pop()
        if not room:
            full.append(into)
            fill += 1
    for rest in spare[fill:]:
        left = sum(p[2] for p in rest)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            part: list[tuple[int, int, int]] = []
            while room:
                owner, start, length = rest.pop()
                if length > room:
                    rest.append((owner, start + room, length - room))
                    length = room
                part.append((owner, start, length))
                room -= length
            full.append(part)
    return full


def _pack_batch(docs: list[tuple[int | None, bytes]], window: int, first: int) -> tuple[pa.RecordBatch, int]:
    """Rows for whole documents (doc_id, ids), whose sequences are numbered from ``first``."""
    rest: list[tuple[int, int, int]] = []
    full: list[list[tuple[int, int, int]]] = []
    for k, (_, ids) in enumerate(docs):
        n = len(ids) // 4
        cut = n - n % window
        full.extend([(k, s, window)] for s in range(0, cut, window))
        if n > cut:
            rest.append((k, cut, n - cut))
    packed = [[rest[i] for i in w] for w in best_fit_decreasing([p[2] for p in rest], window)]
    columns: list[list] = [[] for _ in range(7)]
    for sequence, pieces in enumerate(full + top_up(packed, window), first):
        offset = 0
        for k, start, length in pieces:
            doc_id, ids = docs[k]
            row = doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset
            for column, x in zip(columns, row, strict=True):
                column.append(x)
            offset += length
        first = sequence + 1
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names), first


def pack_documents(df: DataFrame, window: int = WINDOW, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces of all documents of ``df`` (doc_id long, text string), packed into sequences.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece;
    each id of a document lies in exactly one piece. A null or empty text is one end id. A
    null doc_id is kept as null, repeated rows are packed one by one, an empty table gives
    no rows, and other columns are not looked at. sequence_id is unique over the result: the
    partition's number, then a count. Texts of any length are encoded whole; where
    ``<|endoftext|>`` stands in one, it is its token. ``ranks`` and
    ``pattern`` name another rank file and its pre-tokenizer, without special tokens.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(ranks, pattern).encode_all, TaskContext.get().partitionId() << 40
        docs: list[tuple[int | None, bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                docs.append((doc_id, ids))
                held += len(ids)
                if len(docs) >= BATCH_PIECES or held >= BATCH_BYTES:
                    out, sequence = _pack_batch(docs, window, sequence)
                    docs, held = [], 0
                    yield out
        if docs:
            yield _pack_batch(docs, window, sequence)[0]

    return df.select("doc_id", "text").mapInArrow(run, SCHEMA)
