"""Sets of word shingles as 64-bit hashes, by numpy over whole slices of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed random odd multipliers and byte values; any others would do.
_RNG = np.random.default_rng(20240229)
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _ODD(256)
_PLACE = _ODD(16)
_BASE = _ODD(1)[0]
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time.
CHUNK = 1 << 19


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(_BASE, CHUNK)
_DOWN = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), CHUNK)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that lets every bit bear on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte offsets of the words [^\\x20\\x09-\\x0D]+ of `raw`, A-Z taken as a-z."""
    hashes, starts, lo = [], [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + CHUNK)
        if hi < len(raw):  # not within a word
            cut = max(raw.rfind(b, lo, hi) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if cut <= lo:  # a word longer than a chunk
                ends = [p for p in (raw.find(b, hi) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if p >= 0]
                hi = min(ends, default=len(raw))
            else:
                hi = cut + 1
        part = np.frombuffer(raw, np.uint8, hi - lo, lo)
        solid = ~_SPACE[part]
        edge = np.diff(np.concatenate([[False], solid, [False]]).view(np.int8))
        begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        up, down = (_UP, _DOWN) if len(part) <= CHUNK else (_powers(_BASE, len(part)), _powers(_DOWN[1], len(part)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)])])
        hashes.append(mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        starts.append(begin + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """The ascending distinct hashes of each text's k-word shingles; a text of fewer words has its
    whole sequence as one, a text without words has none."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    hashes, starts = word_hashes(b"\n".join(raw))
    edges = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw]))
    all_of = np.zeros(0, np.uint64)
    if len(hashes) >= k:
        n = len(hashes) - k + 1
        all_of = sum((hashes[j : j + n] * _PLACE[j] for j in range(k)), np.zeros(n, np.uint64))
        all_of = mixed(all_of + _PLACE[15])
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a >= k:
            yield np.unique(all_of[a : b - k + 1])
        elif b > a:
            few = hashes[a:b] * _PLACE[: b - a]
            yield mixed(few.sum(keepdims=True, dtype=np.uint64) + _PLACE[15 - (b - a)])
        else:
            yield np.zeros(0, np.uint64)
