"""Word shingles of many texts at once, as arrays of hashes.

Words are the longest runs of ``a``-``z`` and ``0``-``9`` in the lower-case text. All words of a
block of texts are hashed together by one polynomial prefix sum over its bytes, so the cost is a few
array passes a byte and no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DOC_BITS = 14  # texts of a block
HASH_BITS = 64 - DOC_BITS
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("0") : ord("9") + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix; works on arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up = np.full(size, _BASE)
        down = np.full(size, inv)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def blocks(texts: list[str], max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``max_bytes`` each; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= max_bytes or i + 1 - start >= 1 << DOC_BITS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of ``width`` words of each text, sorted.

    The texts must fit into one block (at most ``2**DOC_BITS``). A text with fewer words has none.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raw])
    is_word = _WORD[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if is_word[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]  # the last byte is no word byte
    if len(begin) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    word = mix((total[end] - total[begin]) * down[begin])
    doc = np.searchsorted(ends_of, begin, side="right")
    n = len(word) - width + 1
    h = word[:n].copy()
    for k in range(1, width):
        h = mix(h * np.uint64(3) + word[k : k + n])
    same = doc[:n] == doc[width - 1 :]
    key = (doc[:n][same].astype(np.uint64) << np.uint64(HASH_BITS)) | (h[same] >> np.uint64(DOC_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1)
