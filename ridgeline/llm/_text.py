"""Vectorised words, shingles and fingerprints of whole texts (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: ASCII white space of the word pattern [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd base of the polynomial that hashes the bytes of a word, and its inverse mod 2**64.
_BASE = 0x9E6C63D0876A9A6D
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A full avalanche of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, _U), np.full(size, _BACK, _U)
        up[0] = down[0] = 1
        _powers[size] = (np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U))
    return _powers[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and each text's offset into them."""
    buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(start, begins)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles.

    Texts are lower-cased by ``bytes.lower`` (A-Z only). A text of fewer words than
    ``width`` is one shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0
    for t in [*texts, None]:
        if t is None or (chunk and size + len(t) > 2_000_000):
            out += _sets(chunk, width)
            chunk, size = [], 0
        if t is not None:
            chunk.append(t)
            size += len(t)
    return out


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    words, at = word_hashes([t.lower() for t in texts])
    odd = mix(np.arange(width, dtype=_U) + _U(0xA0761D6478BD642F)) | _U(1)
    n = max(0, len(words) - width + 1)
    all_shingles = np.zeros(n, _U)
    for k in range(width):
        all_shingles += words[k : k + n] * odd[k]
    all_shingles = mix(all_shingles)
    out = []
    for i, j in zip(at[:-1], at[1:]):
        if j - i >= width:
            out.append(np.unique(all_shingles[i : j - width + 1]))
        elif j > i:
            short = (words[i:j] * odd[: j - i]).sum(keepdims=True, dtype=_U)
            out.append(mix(short + _U(int(j - i))))
        else:
            out.append(np.zeros(0, _U))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums that name a set of hashes."""
    a, b = mix(s ^ _U(0x5BF03635)).sum(dtype=_U), mix(s + _U(0x9E3779B97F4A7C15)).sum(dtype=_U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
