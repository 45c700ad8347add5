"""Weighted word shingles of texts and their improved consistent weighted samples, in numpy inside tasks.

A word is a run of ASCII letters, digits, underscores and characters beyond ASCII, lower-cased. A shingle is five words in a
row; a text of one to four words is one shingle. Weights are term frequency times inverse document frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text, and shingles, that are handled at a time.
PIECE = 1 << 20
SLICE = 1 << 16
BUCKETS = 1 << 17

_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, base, _U)]))


_BYTE_POWERS = _powers(0x9E3779B97F4A7C15, 4096)
_SHINGLE_POWERS = _powers(0xD6E8FEB86659FD93, WIDTH)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text's bytes in stretches of bounded size, cut between words where there is such a place."""
    start = 0
    while len(data) - start > PIECE:
        ends = np.flatnonzero(~_WORD_BYTE[np.frombuffer(data, np.uint8, PIECE, start)])
        stop = start + (int(ends[-1]) if len(ends) and ends[-1] else PIECE)
        yield data[start:stop]
        start = stop
    yield data[start:]


def _hash_words(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some stretches, and the stretch each is in."""
    b = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    inside = _WORD_BYTE[b]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    terms = (b[inside].astype(_U) + _U(1)) * _BYTE_POWERS[place % len(_BYTE_POWERS)] + (place // len(_BYTE_POWERS)).astype(_U)
    bounds = np.cumsum([len(g) + 1 for g in group])
    return mix(np.add.reduceat(terms, first)), np.searchsorted(bounds, starts, side="right")


def words(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        hashes, where = _hash_words(group)
        cuts = np.searchsorted(where, np.arange(len(group) + 1))
        for n, doc in enumerate(owner):
            out[doc].append(hashes[cuts[n] : cuts[n + 1]])

    for doc, text in enumerate(texts):
        for piece in _pieces(text.lower().encode()):
            if group and size + len(piece) > PIECE:
                flush()
                group, owner, size = [], [], 0
            group.append(piece)
            owner.append(doc)
            size += len(piece)
    if group:
        flush()
    return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in out]


def identity(text: str, hashes: np.ndarray) -> bytes:
    """16 bytes that equal word sequences share; without words, those of the text itself."""
    if not len(hashes):
        raw = np.frombuffer(b"\0" + text.encode(), np.uint8).astype(_U)
        hashes = mix(raw + _U(1 << 32))
    sums = [
        (mix(hashes + _U(salt)) * _powers(base, len(hashes))).sum(dtype=_U)
        for salt, base in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F))
    ]
    return mix(np.array(sums, _U) + _U(len(hashes))).tobytes()


def shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs."""
    n = len(hashes)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    width = min(n, WIDTH)
    rolled = np.zeros(n - width + 1, _U)
    for j in range(width):
        rolled += hashes[j : n - width + 1 + j] * _SHINGLE_POWERS[j]
    return np.unique(mix(rolled), return_counts=True)


class Weights:
    """tf-idf weights: ``idf = ln(1 + n_docs / max(df, floor * n_docs))``, with df listed where it is above the floor."""

    def __init__(self, n_docs: int, floor: float, heavy: np.ndarray, df: np.ndarray):
        order = np.argsort(heavy)
        self.heavy, self.idf = heavy[order], np.log1p(n_docs / df[order])
        self.rare = float(np.log1p(n_docs / max(1.0, floor * n_docs))) if n_docs else 1.0

    def of(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(shingle), self.rare)
        if len(self.heavy) and len(shingle):
            at = np.minimum(np.searchsorted(self.heavy, shingle), len(self.heavy) - 1)
            hit = self.heavy[at] == shingle
            idf[hit] = self.idf[at[hit]]
        return tf * idf


def bucket_of(shingle: np.ndarray) -> np.ndarray:
    """The sketch bucket of each shingle."""
    return (shingle >> _U(64 - 17)).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights); 0 where either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    shared = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at 65,536 evenly spaced probabilities, by Newton's method from a bracket."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


class Sampler:
    """Improved consistent weighted sampling: ``k`` samples of a weighted set, of which two sets share each with a
    probability equal to their weighted Jaccard similarity. The three random numbers of a shingle and a sample come from
    one hash of both."""

    def __init__(self, k: int, seed: int = 1):
        g = _gamma_quantiles()
        self.r, self.inverse_r, self.log_c = g.astype(np.float32), (1 / g).astype(np.float32), np.log(g).astype(np.float32)
        self.beta = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
        self.salts = mix(np.arange(1, k + 1, dtype=_U) + _U(seed << 32))

    def __call__(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row of ``k`` 64-bit samples for each (shingles, weights); those of an empty set mean nothing."""
        k, low = len(self.salts), _U(0xFFFF)
        best = np.full((len(sets), k), np.inf, np.float32)
        out = np.zeros((len(sets), k), _U)
        if not sets:
            return out
        elements = np.concatenate([s for s, _ in sets])
        logs = np.log(np.concatenate([w for _, w in sets])).astype(np.float32)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
        for a in range(0, len(elements), SLICE):
            x, lw, docs = elements[a : a + SLICE], logs[a : a + SLICE], owner[a : a + SLICE]
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            sizes, present = np.diff(np.append(first, len(docs))), docs[first]
            for j, salt in enumerate(self.salts):
                u = mix(x ^ salt)
                i = (u & low).view(np.int64)
                beta = self.beta[(u >> _U(32) & low).view(np.int64)]
                t = np.floor(lw * self.inverse_r[i] + beta)
                cost = self.log_c[(u >> _U(16) & low).view(np.int64)] - self.r[i] * (t - beta + np.float32(1))
                least = np.minimum.reduceat(cost, first)
                at = np.flatnonzero(cost == np.repeat(least, sizes))
                at = at[np.flatnonzero(np.diff(docs[at], prepend=-1))]  # one of equals
                better = least < best[present, j]
                rows = present[better]
                best[rows, j] = least[better]
                chosen = at[better]
                out[rows, j] = mix(x[chosen] + mix(t[chosen].astype(np.int64).view(_U) + salt))
        return out
