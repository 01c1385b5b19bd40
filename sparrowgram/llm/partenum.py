"""Word-shingle sets and PartEnum signatures.

Sets of at most `k` differing elements agree on a part of the domain. The domain is cut into first-level parts, each into PARTS
second-level parts; of n first-level parts one differs in at most MISS elements if n * (MISS + 1) > k, and then PARTS - MISS of
its second-level parts agree. A signature stands for what a set has in such a selection, one for each selection.

Similarity: sizes fall into bands whose largest size is 1/threshold times the least; similar sets are of one band or
neighbours. Band i's signatures are made by the sets of bands i - 1 and i, for the difference that the largest size of band i allows.

A selection in which a set has nothing says nothing, and would unite all such sets. So there are SPARE further first-level parts: a set
is good under a seed if no more of its parts have an empty selection than there are spare ones; a similar set then agrees
with it on a selection that isn't empty. A set makes signatures under each seed up to the first under which it is good, and if it's
good under none of SEEDS, also those of its empty selections under the last. Of two similar sets the one that is good first shows the pair
under that seed, which the other has tried as well; if neither ever is, the empty selections do. So no pair is lost.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

U = np.uint64
MISS, PARTS, SEEDS = 1, 3, 6
WORDS = 5


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, int]:
    r = np.random.default_rng(20240)
    return r.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1), 0x9E3779B97F4A7C15


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p ** i and p ** -i, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        p = tables()[1]
        for k, base in enumerate((p, pow(p, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of WORDS words; with fewer words, of the whole sequence."""
    words = text.encode().lower().split() if text else None  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    letters, _ = tables()
    out = []
    step = 1 << 20  # words at a time; parts overlap by WORDS - 1 words
    gaps = np.flatnonzero(data == 32)
    begin = np.concatenate([[0], gaps + 1])
    end = np.concatenate([gaps, [len(data)]])
    for a in range(0, len(begin), step):
        b = min(len(begin), a + step + WORDS - 1)
        lo, hi = int(begin[a]), int(end[b - 1])
        p, inverse = powers(hi - lo + 1)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(letters[data[lo:hi]] * p[: hi - lo], out=run[1:])
        s, e = begin[a:b] - lo, end[a:b] - lo
        w = mix((run[e] - run[s]) * inverse[s] + (e - s).astype(np.uint64))
        n = min(WORDS, len(w))
        h = w[: len(w) - n + 1].copy()
        for k in range(1, n):
            h = mix(h * U(0xD6E8FEB86659FD93) + w[k : len(w) - n + 1 + k])
        out.append(mix(h + U(n)))
        if b == len(begin):
            break
    h = np.sort(np.concatenate(out) if len(out) > 1 else out[0])
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


@lru_cache(maxsize=4)
def band_ends(num: int, den: int) -> list[int]:
    """The largest size of each band, for a threshold of num / den."""
    ends, first = [], 1
    while first < 1 << 40:
        ends.append(first * den // num)
        first = ends[-1] + 1
    return ends


def difference(a: int, b: int, num: int, den: int) -> int:
    """The most elements in which similar sets of a and b elements can differ."""
    return (a + b) * (den - num) // (den + num)


def layout(k: int) -> tuple[int, int, int, int]:
    """First-level parts, spare ones among them, parts of each, misses."""
    if k == 0:
        return 1, 0, 1, 0
    need = k // (MISS + 1) + 1
    spare = 1 + need // 10 if need > 4 else 0
    return need + spare, spare, PARTS + (2 if need <= 4 else 0), MISS


def signatures(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of one sorted set, not empty."""
    ends = band_ends(num, den)
    own = int(np.searchsorted(ends, len(h)))
    return np.concatenate([of_band(h, i, difference(ends[i], ends[i], num, den)) for i in (own, own + 1)])


def of_band(h: np.ndarray, band: int, k: int) -> np.ndarray:
    n, spare, parts, miss = layout(k)
    picks = list(combinations(range(parts), parts - miss))
    out = []
    for seed in range(SEEDS):
        e = h if seed == 0 else np.sort(mix(h + U(seed)))
        # cells are ranges of the hash: contiguous in the sorted set
        edges = (np.arange(n * parts + 1, dtype=np.float64) * (2.0**64 / (n * parts)))
        at = np.searchsorted(e, edges[1:-1].astype(np.uint64))
        at = np.concatenate([[0], at, [len(e)]])
        run = np.zeros(len(e) + 1, np.uint64)
        np.cumsum(mix(e ^ U(0x5851F42D4C957F2D)), out=run[1:])
        size = np.diff(at).reshape(n, parts)
        cell = mix((run[at[1:]] - run[at[:-1]]).reshape(n, parts) + np.arange(parts, dtype=np.uint64)[None, :] * U(0xA0761D6478BD642F))
        where = np.arange(n, dtype=np.uint64) * U(64)
        full, sigs = [], []
        for j, pick in enumerate(picks):
            full.append(size[:, pick].sum(axis=1) > 0)
            sigs.append(mix(cell[:, pick].sum(axis=1, dtype=np.uint64) + mix(where + U(j) + U(band << 40) + U(seed << 32))))
        full, sigs = np.array(full), np.array(sigs)
        good = int((~full).any(axis=0).sum()) <= spare
        out.append(sigs.ravel() if not good and seed == SEEDS - 1 else sigs[full])
        if good:
            break
    return np.concatenate(out)
