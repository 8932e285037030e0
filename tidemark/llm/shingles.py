"""Sets of word shingles of whole texts as sorted arrays of 64-bit fingerprints, made with array operations."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

WIDTH = 5
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_FACTOR = mixed(np.arange(1001, 1001 + 64, dtype=np.uint64) * _STEP) | np.uint64(1)


def _word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII white space parts them, A-Z in lower case) and each text's first word."""
    buf = b" " + b" ".join(raw).translate(_LOWER) + b" "
    b = np.frombuffer(buf, np.uint8)
    space = _SPACE[b]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    sizes = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
    first = np.searchsorted(starts, np.cumsum([1, *(len(r) + 1 for r in raw)]))
    if not len(starts):
        return np.zeros(0, np.uint64), first
    offsets = np.cumsum(sizes) - sizes
    letters = b[~space]
    power = np.cumprod(np.full(int(sizes.max()), _FACTOR[0]))
    terms = _BYTE[letters] * power[np.arange(len(letters)) - np.repeat(offsets, sizes)]
    return mixed(np.add.reduceat(terms, offsets) + sizes.astype(np.uint64)), first


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending. Fewer than ``width`` words are one shingle; a null text
    and one without words have none. Two different shingles share a fingerprint once in about 2**64 pairs."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    words, first = _word_hashes(raw)
    n = max(0, len(words) - width + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(width):
        joined += words[k : k + n] * _FACTOR[k + 1]
    joined = mixed(joined)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(joined[a : z - width + 1]))
        elif z > a:
            short = (words[a:z] * _FACTOR[1 : 1 + z - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(short + _FACTOR[10 + z - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a digest of the whole set."""
    d = hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
