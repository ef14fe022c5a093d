"""Words of UTF-8 text and 64-bit fingerprints of word sequences, over whole Arrow batches at once.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes depend only on the words, not on the white space between
them or on where a document lies in its batch. A word's hash is a chain of bijective mixing steps, so
none of its weaknesses are those of a polynomial; other seeds give unrelated hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of more bytes are hashed by BLAKE2b.
LONG = 128
_U = np.uint64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse; the longest so far is kept."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(12, (max(n, 1) - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up), np.cumprod(down)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and the number of its document."""
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of each word's bytes: eight at a time, each chained through a mixing step; long words by their digest."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64), seed)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[: len(data) + 1].view(), (len(data) + 1, 8), (1, 1))
    at, lane = np.flatnonzero(sizes <= LONG), 0
    while len(at):
        part = np.ascontiguousarray(lanes[starts[at] + lane]).view("<u8").reshape(-1)
        left = np.minimum(sizes[at] - lane, 8)
        out[at] = mix(out[at] ^ (part & _KEEP[left]), seed + 40)
        lane += 8
        at = at[sizes[at] > lane]
    for i in np.flatnonzero(sizes > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(4, "little")).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


def grams(words: np.ndarray, n: int, seed: int = 2) -> np.ndarray:
    """A hash of each ``n`` consecutive entries of ``words`` (also across documents: mask with ``inside``)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(0xA0761D6478BD642F, len(words) + 1)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words, seed) * up[:-1], out=prefix[1:])
    return mix((prefix[n:] - prefix[:-n]) * down[: len(words) - n + 1], seed + 1)


def inside(docs: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words from each place on are of one document."""
    return docs[: len(docs) - n + 1] == docs[n - 1 :] if len(docs) >= n else np.zeros(0, bool)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive entries, by doubling."""
    if len(x) < n:
        return x[:0]
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if width < n else x
