"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are tagged as the beginning of a secret, its inside, or outside. Their features are
shape, neighbouring words and marks, and features of the whole file. The field is trained
here, on generated lines with a fixed seed, by maximum likelihood with the forward-backward
algorithm. Decoding is exact: a token whose score for outside leads by more than any two
transitions can give back is outside on the best path, and Viterbi runs over the stretches
between such tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The patterns whose matches are always reported, with their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "crf")
#: Words that speak of a secret nearby.
KEYWORDS = (
    "password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "bearer", "authorization",
    "credential", "credentials", "access_key", "secret_key", "private", "auth",
)
O, B, I = range(3)

# classes of characters: 0 space, 1 lower, 2 upper, 3 digit, 4 mark within tokens, 5 other letter, 6 separator
_CLASS = np.full(129, 6, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128] = 1, 2, 3, 5
for _c in "+/_.-":
    _CLASS[ord(_c)] = 4
_HEX = np.zeros(129, bool)
_HEX[48:58], _HEX[97:103] = True, True
_BEFORE = np.zeros(129, np.int8)
for _n, _s in enumerate((" \t", "\r\n\v\f", "\"'`", "=:", "@#%&*$"), 1):
    for _c in _s:
        _BEFORE[ord(_c)] = _n
#: Lengths and first two letters of keywords, in either case.
_LENGTHS = np.zeros(max(map(len, KEYWORDS)) + 2, bool)
_LENGTHS[[len(k) for k in KEYWORDS]] = True
_PAIRS = np.zeros((129, 129), bool)
for _k in KEYWORDS:
    for _a in (_k[0], _k[0].upper()):
        for _b in (_k[1], _k[1].upper()):
            _PAIRS[ord(_a), ord(_b)] = True
#: Numbers of values of the features.
_SIZES = (7, 6, 32, 5, 3, 6, 6, 4, 4, 6, 2)


class Tokens:
    """Tokens of a text as arrays: where they begin and end, and their features."""

    def __init__(self, codes: np.ndarray, starts_of: np.ndarray) -> None:
        """``codes``: code points of texts that end with white space each; ``starts_of``: where the texts begin."""
        small = np.minimum(codes, 128)
        kind = _CLASS[small]
        self.hex = _HEX[small]
        inside = (kind >= 1) & (kind <= 5)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        self.starts, self.stops = edge[::2], edge[1::2]
        self.features = self._features(codes, small, kind, starts_of) if len(self.starts) else np.zeros((0, len(_SIZES)), np.int64)

    def _features(self, codes, small, kind, starts_of) -> np.ndarray:
        s, e = self.starts, self.stops
        n = e - s
        both = np.stack([s, e], axis=1).ravel()
        both = both[:-1] if both[-1] >= len(codes) else both

        def count(what: np.ndarray) -> np.ndarray:
            return np.add.reduceat(what.astype(np.int32), both)[::2]

        counts = [count(kind == c) for c in range(1, 6)]
        lower, upper, digit, mark, other = counts
        changes = count(np.append(False, kind[1:] != kind[:-1]))
        hexes = count(self.hex)
        length = np.digitize(n, [4, 8, 16, 24, 32, 64])
        digits = np.digitize(digit / n, [1e-9, 0.15, 0.3, 0.6, 1.0])
        shape = sum((c > 0).astype(np.int64) << k for k, c in enumerate(counts))
        rough = np.digitize(changes / n, [0.08, 0.2, 0.35, 0.6])
        hexed = (hexes == n).astype(np.int64) + ((hexes == n) & (digit > 0))
        before, after = _BEFORE[small[np.maximum(s - 1, 0)]], _BEFORE[small[np.minimum(e, len(small) - 1)]]
        before = np.where(s == 0, 2, before)
        key = self._keywords(codes, s, e, n)
        file_of = np.searchsorted(starts_of, s, "right") - 1
        same1 = np.append(False, file_of[1:] == file_of[:-1])
        same2 = np.concatenate([[False, False], file_of[2:] == file_of[:-2]])[: len(s)]
        prev1 = np.append(False, key[:-1]) & same1
        prev2 = np.concatenate([[False, False], key[:-2]])[: len(s)] & same2
        near = np.where(key, 3, np.where(prev1, 1, np.where(prev2, 2, 0)))
        plain = np.where(digit == n, 1, np.where(lower + other == n, 2, 3))
        behind = np.where(same1, np.append(0, plain[:-1]), 0)
        files = len(starts_of)
        has_key = np.bincount(file_of[key], minlength=files) > 0
        share = np.bincount(file_of, digit, files) / np.maximum(np.bincount(file_of, n, files), 1)
        file = (has_key * 3 + np.digitize(share, [0.02, 0.1]))[file_of]
        akia = np.zeros(len(s), np.int64)
        a = np.flatnonzero((codes[s] == 65) & (n >= 16) & (upper + digit == n))
        akia[a] = codes[s[a] + 1] == 75
        return np.stack([length, digits, shape, rough, hexed, before, after, near, behind, file, akia]).T

    @staticmethod
    def _keywords(codes, s, e, n) -> np.ndarray:
        key = np.zeros(len(s), bool)
        at = np.flatnonzero(_LENGTHS[np.minimum(n, len(_LENGTHS) - 1)])
        at = at[_PAIRS[np.minimum(codes[s[at]], 128), np.minimum(codes[s[at] + 1], 128)]]
        known = set(KEYWORDS)
        seen: dict[bytes, bool] = {}
        for i in at.tolist():
            raw = codes[s[i] : e[i]].tobytes()
            if (hit := seen.get(raw)) is None:
                hit = seen[raw] = raw.decode("utf-32-le", "replace").lower() in known
            key[i] = hit
        return key


def _emissions(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Scores of the three tags for each token; ``weights`` holds all features' values one after the other."""
    at = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
    out = np.zeros((len(features), 3))
    for k, first in enumerate(at):
        out += weights[first : first + _SIZES[k]].take(features[:, k], axis=0)
    return out


def viterbi(scores: np.ndarray, transitions: np.ndarray, before: int | None, after: int | None) -> list[int]:
    """Best tags of a stretch; the tags outside it on either side are given, None at a text's ends."""
    v = scores[0] + (transitions[before] if before is not None else 0)
    back = []
    for x in scores[1:]:
        through = v[:, None] + transitions
        back.append(through.argmax(axis=0))
        v = through.max(axis=0) + x
    if after is not None:
        v = v + transitions[:, after]
    tags = [int(v.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def slack(transitions: np.ndarray) -> float:
    """The most that two transitions gain if the tag between them is not outside."""
    t = transitions
    best = 0.0
    for x in (B, I):
        gain_in = max(0.0, float((t[:, x] - t[:, O]).max()))
        gain_out = max(0.0, float((t[x, :] - t[O, :]).max()))
        best = max(best, gain_in + gain_out)
    return best


def decode(scores: np.ndarray, transitions: np.ndarray, new_text: np.ndarray) -> np.ndarray:
    """Tags of all tokens; ``new_text`` marks the first token of each text."""
    tags = np.zeros(len(scores), np.int8)
    sure = scores[:, O] - scores[:, 1:].max(axis=1) > slack(transitions)
    loose = np.flatnonzero(~sure)
    if not len(loose):
        return tags
    cut = np.append(True, (np.diff(loose) > 1) | new_text[loose[1:]])
    begins = np.flatnonzero(cut)
    for a, b in zip(begins.tolist(), np.append(begins[1:], len(loose)).tolist(), strict=True):
        i, j = int(loose[a]), int(loose[b - 1]) + 1
        before = None if new_text[i] else O
        after = None if j == len(scores) or new_text[j] else O
        tags[i:j] = viterbi(scores[i:j], transitions, before, after)
    return tags


def _lines(rng: np.random.Generator) -> Iterator[list[tuple[str, bool]]]:
    """Generated files: parts of text, each with whether it is a secret."""
    syllables = "the an re on ti er ed ing ation le de que ment ei ung lich es os la por cion ou th st".split()
    hexes, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed = letters + letters.upper() + "0123456789"

    def some(alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    def word() -> str:
        w = "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 5)))
        style = rng.random()
        return w.capitalize() if style < 0.15 else w.upper() if style < 0.2 else w + ".,;!"[rng.integers(4)] if style < 0.35 else w

    def prose() -> list[tuple[str, bool]]:
        return [(" ".join(word() for _ in range(rng.integers(1, 12))) + " ", False)]

    def harmless() -> list[tuple[str, bool]]:
        n = rng.integers
        kinds = (
            lambda: some("0123456789", int(n(4, 20))),
            lambda: ".".join(str(x) for x in n(0, 255, 4)),
            lambda: f"{word()}.{word()}@{word()}.example.com",
            lambda: f"https://{word()}.example.org/{word()}/{n(1, 9999)}",
            lambda: f"+{n(1, 99)} {n(100, 999)} {n(1000, 9999)}",
            lambda: f"{n(1990, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}T{n(0, 23):02d}:{n(0, 59):02d}",
            lambda: f"version {n(0, 9)}.{n(0, 30)}.{n(0, 9)}",
            lambda: f"{n(100, 999)}-{n(10, 99)}-{n(1000, 9999)}",
            lambda: f"{word()}_{word()}_{n(1, 99)}.py",
            lambda: f"the {KEYWORDS[n(len(KEYWORDS))]} {word()} {word()}",
            lambda: f"{word()}{'*%&$#'[n(5)] * 3} {word()}{'*%&$#'[n(5)] * 3}",
            lambda: f"{word().strip('.,;!')}-{word().strip('.,;!')}-{word()}",
            lambda: f"/static/js/main.{some(hexes, int((8, 16, 20)[n(3)]))}.chunk.js",
            lambda: f"{word().strip('.,;!')}.{some(hexes, 8)}.css",
            lambda: f"{KEYWORDS[n(len(KEYWORDS))]} = {word()}",
            lambda: f"{word()}{n(1, 99)}{word()}",
            lambda: some(hexes, int(n(6, 11))),
        )
        return [(str(kinds[n(len(kinds))]()) + " ", False)]

    def secret() -> list[tuple[str, bool]]:
        n = rng.integers
        key = KEYWORDS[n(len(KEYWORDS))]
        key = key.upper() if n(3) == 0 else key
        joins = (" = ", "=", ": ", " is ", ' = "', "='", ' ": "')
        body = (
            lambda: some(hexes, int((32, 40, 64)[n(3)])),
            lambda: some(mixed, int(n(16, 48))),
            lambda: "ghp_" + some(mixed, 36),
            lambda: "sk_live_" + some(mixed, 24),
            lambda: "xoxb-" + some("0123456789", 12) + "-" + some(mixed, 24),
            lambda: "eyJ" + some(mixed, 30) + ".eyJ" + some(mixed, 60) + "." + some(mixed + "_-", 43),
            lambda: some(mixed + "+/", 40),
            lambda: some(letters, 6) + some("0123456789", 4) + some(mixed, 6),
            lambda: some(mixed, int(n(9, 16))),
        )
        value = str(body[n(len(body))]())
        style = n(5)
        if style == 0:
            return [("AKIA" + some(letters.upper() + "0123456789", 16), True), (" ", False)]
        if style == 1:
            return [("-----BEGIN PRIVATE KEY-----\n", False)] + [x for _ in range(n(2, 6)) for x in ((some(mixed + "+/", 64), True), ("\n", False))]
        if style == 2 and len(value) >= 24:
            return [(value, True), (" ", False)]
        join = joins[n(len(joins))]
        return [(key + join, False), (value, True), ('"\n' if '"' in join else "'\n" if "'" in join else "\n", False)]

    for _ in range(360):
        parts: list[tuple[str, bool]] = []
        for _ in range(rng.integers(3, 9)):
            r = rng.random()
            parts += prose() if r < 0.55 else harmless() if r < 0.8 else secret()
        yield parts


def _examples(seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, tags) of each generated file."""
    for parts in _lines(np.random.default_rng(seed)):
        text, spans, at = "", [], 0
        for part, is_secret in parts:
            if is_secret:
                spans.append((at, at + len(part)))
            text += part
            at += len(part)
        codes = np.frombuffer((text + "\n").encode("utf-32-le"), np.uint32)
        tokens = Tokens(codes, np.array([0]))
        tags = np.zeros(len(tokens.starts), int)
        for k, (a, b) in enumerate(spans):
            hit = (tokens.starts < b) & (tokens.stops > a)
            follows = k > 0 and a - spans[k - 1][1] <= 1
            tags[hit] = I
            if not follows:
                tags[np.flatnonzero(hit)[:1]] = B
        if len(tags):
            yield tokens.features, tags


@lru_cache(maxsize=2)
def trained_field(seed: int = 20, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """(weights of feature values, transitions) of maximum penalised likelihood on the generated files."""
    examples = list(_examples(seed))
    longest = max(len(t) for _, t in examples)
    n = len(examples)
    at = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
    feats = np.zeros((n, longest, len(_SIZES)), np.int64)
    gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for k, (f, t) in enumerate(examples):
        feats[k, : len(t)], gold[k, : len(t)], mask[k, : len(t)] = f + at, t, True
    w, tr = np.zeros((sum(_SIZES), 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    one = np.eye(3)
    gold_pairs = np.zeros((3, 3))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        e = w[feats].sum(axis=2)
        alpha = np.zeros((n, longest, 3))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            m = alpha[:, t - 1, :, None] + tr
            top = m.max(axis=1)
            alpha[:, t] = np.where(mask[:, t, None], top + np.log(np.exp(m - top[:, None]).sum(axis=1)) + e[:, t], alpha[:, t - 1])
        beta = np.zeros((n, longest, 3))
        for t in range(longest - 2, -1, -1):
            m = tr + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = m.max(axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], top + np.log(np.exp(m - top[..., None]).sum(axis=2)), 0)
        last = alpha[:, -1]
        z = last.max(axis=1) + np.log(np.exp(last - last.max(axis=1, keepdims=True)).sum(axis=1))
        node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + tr + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        gw = np.zeros_like(w)
        diff = (one[gold] - node) * mask[..., None]
        for f in range(len(_SIZES)):
            for tag in range(3):
                gw[:, tag] += np.bincount(feats[..., f].ravel(), diff[..., tag].ravel(), len(w))
        gt = gold_pairs - pair.sum(axis=(0, 1))
        for x, g, k in ((w, gw / n - 0.001 * w, 0), (tr, gt / n - 0.02 * tr, 2)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
            x += 0.15 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
    return w, tr


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; ``hexes`` are the text's runs of hex digits that are long enough."""
    found = [(a, 2, b) for a, b in hexes]
    low = text.lower()
    if any(k in low for k in ASSIGN_MARKS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found


def scan_texts(texts: list[str], field: tuple[np.ndarray, np.ndarray]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text, both (start, kind, end) in order; ``field`` as ``trained_field`` returns it."""
    whole = "".join(f"{t}\n" for t in texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    starts_of = begin[:-1]
    tokens = Tokens(codes, starts_of)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tokens.hex.view(np.int8), [0]])))
    runs = np.stack([edges[::2], edges[1::2]], axis=1)
    runs = runs[runs[:, 1] - runs[:, 0] >= HEX_LEAST]
    hexes: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k, (a, b) in zip((np.searchsorted(begin, runs[:, 0], "right") - 1).tolist(), runs.tolist(), strict=True):
        hexes[k].append((a - int(begin[k]), b - int(begin[k])))
    base = [sorted(base_spans(t, h)) for t, h in zip(texts, hexes, strict=True)]
    weights, transitions = field
    file_of = np.searchsorted(begin, tokens.starts, "right") - 1
    new = np.append(True, file_of[1:] != file_of[:-1])[: len(file_of)]
    tags = decode(_emissions(weights, tokens.features), transitions, new)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hit = np.flatnonzero(tags)
    if len(hit):
        starts_new = np.append(True, (np.diff(hit) > 1) | (tags[hit[1:]] == B) | new[hit[1:]])
        cuts = np.flatnonzero(starts_new)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(hit)).tolist(), strict=True):
            k = int(file_of[hit[a]])
            s, e = int(tokens.starts[hit[a]] - begin[k]), int(tokens.stops[hit[b - 1]] - begin[k])
            if not any(x <= s and e <= y for x, _, y in base[k]):
                added[k].append((s, 3, e))
    return list(zip(base, added, strict=True))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans and spans of every row of ``df`` (doc_id, text).

    Spans are kind:start:end in code points, by start, then kind, comma-joined; a null or empty
    text has none. base_spans are those of the fixed patterns, spans has the field's besides,
    those that lie inside a fixed one left out. Texts of any length are scanned whole, repeated
    rows one by one; other columns are not looked at.
    """
    field = trained_field()
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held, first = [], 0, at
                while at < batch.num_rows and held < 400_000:
                    texts.append(batch.column(1)[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                found = scan_texts(texts, field)
                counts = [[sum(k == n for _, k, _ in base) for base, _ in found] for n in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, at - first),
                        *[pa.array(c, pa.int64()) for c in counts],
                        pa.array([_joined(base) for base, _ in found], pa.string()),
                        pa.array([_joined(base + more) for base, more in found], pa.string()),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    return df.select("doc_id", "text").mapInArrow(run, schema)
