"""Prediction by partial matching over the bytes of words, for many languages at once.

Each language has a context tree of the bytes of its training words, each word between two spaces,
down to ``ORDER`` bytes of context. A byte costs ``-log2(n / (N + d))`` in the longest context that
has seen it (n times it, N bytes of d kinds in all) and ``-log2(d / (N + d))`` for each escape from
a longer one on the way; below the empty context stand 8 bits. The statistics are frozen after
fitting, so what a byte costs depends on its context alone: the trees of all languages are folded
into one sorted table for each order, with a vector of costs, escapes already added.
"""

from __future__ import annotations

import numpy as np

ORDER = 5


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, place, key) of each byte to code: the key holds it and up to ORDER bytes before."""
    buf = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(buf)) - np.repeat(np.cumsum(length) - length, length)
    key = buf.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= buf[:-k] << np.uint64(8 * k)
    coded = place > 0
    return word[coded], place[coded], key[coded]


def _low(key: np.ndarray, n_bytes: int) -> np.ndarray:
    return key & np.uint64((1 << 8 * n_bytes) - 1)


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, key)
    at[at == len(table)] = 0
    return at, table[at] == key if len(table) else np.zeros(len(key), bool)


class ContextTrees:
    """Frozen trees of several languages."""

    def __init__(self, words: list[list[bytes]], counts: list[np.ndarray]):
        n_lang = len(words)
        self.n_lang = n_lang
        parts = [(*_grams(w), c) if len(w) else None for w, c in zip(words, counts)]
        self.grams, self.cost, self.contexts, self.escape = [], [], [], []
        for k in range(ORDER + 1):
            seen = []
            for lang, p in enumerate(parts):
                if p is None:
                    continue
                word, place, key, c = p
                on = place >= k
                g, inv = np.unique(_low(key[on], k + 1), return_inverse=True)
                seen.append((lang, g, np.bincount(inv, weights=c[word[on]])))
            grams = np.unique(np.concatenate([g for _, g, _ in seen])) if seen else np.empty(0, np.uint64)
            n = np.zeros((len(grams), n_lang))
            for lang, g, c in seen:
                n[np.searchsorted(grams, g), lang] = c
            ctx, of = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(n / (total + kinds)[of])
            if k == 0:
                below = np.full((len(grams), n_lang), 8.0)
            else:
                below = self.cost[k - 1][np.searchsorted(self.grams[k - 1], _low(grams, k))]
            self.grams.append(grams)
            self.cost.append(np.where(n > 0, own, escape[of] + below).astype(np.float32))
            self.contexts.append(ctx)
            self.escape.append(escape.astype(np.float32))

    def code_lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits (words x languages) each word costs in each language."""
        if not words:
            return np.zeros((0, self.n_lang), np.float32)
        word, place, key = _grams(words)
        bits = np.zeros((len(key), self.n_lang), np.float32)
        open_ = np.arange(len(key))
        for k in range(ORDER, -1, -1):
            can = place[open_] >= k
            on = open_[can]
            if not len(on):
                continue
            at, hit = _find(self.grams[k], _low(key[on], k + 1))
            bits[on[hit]] += self.cost[k][at[hit]]
            miss = on[~hit]
            at, known = _find(self.contexts[k], _low(key[miss] >> np.uint64(8), k))
            bits[miss[known]] += self.escape[k][at[known]]
            open_ = np.concatenate((open_[~can], miss))
        bits[open_] += 8.0
        return np.add.reduceat(bits, np.searchsorted(word, np.arange(len(words))), axis=0)
