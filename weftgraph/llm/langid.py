"""Languages of documents and of the stretches in documents that change language.

Labels are fitted on a bounded sample of labelled documents; a part of the labels may be wrong, so
sentences that the trees of another language code in fewer bits are taken out and the trees are
fitted anew. Then every sentence of every document gets its exact code length in each language, and
the cheapest sequence of languages, a change costing ``SWITCH`` bits, gives the stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ppm import ContextTrees
from .shingles import blocks
from .wordscan import Scan, scan

SAMPLE = 200  # labelled documents of a language that the trees are fitted on, at most
SWITCH = 30.0  # bits that a change of language costs
TEMPER = 0.1  # successive bytes are not independent: weight of a bit in the confidence
CLEANING = 2  # rounds of taking out sentences that look like another language
KNOWN = 200_000  # words whose code lengths a task remembers

_LETTERS = re.compile(r"[^\W\d_]+")


def label_map(languages: DataFrame) -> dict[str, str]:
    """Every name of a language, in lower case, to its code; the table has one row a language."""
    out: dict[str, str] = {}
    for r in languages.collect():
        for name in (r["lang"], r["iso3"], r["lang_name"]):
            if name:
                out.setdefault(name.strip().lower(), r["lang"])
    return out


def label_language(label: Column, names: dict[str, str]) -> Column:
    """The code that a label names, without regard to case and to what follows ``-`` or ``_``."""
    key = F.lower(F.trim(F.regexp_extract(label, r"(?s)^([^-_]*)", 1)))
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(label.isNotNull(), F.element_at(pairs, key))


@dataclass
class LanguageModel:
    codes: list[str]
    trees: ContextTrees


def _unique_words(s: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first place, number of each word among them)."""
    h, at, inv = np.unique(s.word_hash, return_index=True, return_inverse=True)
    return h, at, inv


def _unit_bits(bits: np.ndarray, word_unit: np.ndarray, n_units: int) -> np.ndarray:
    """Sum of the words' bits by sentence; words come in order of their sentences."""
    out = np.zeros((n_units, bits.shape[1]))
    if len(word_unit):
        unit, at = np.unique(word_unit, return_index=True)
        out[unit] = np.add.reduceat(bits, at, axis=0)
    return out


def fit(texts: list[str], labels: list[str], codes: list[str]) -> LanguageModel:
    """Context trees of each of ``codes`` from labelled texts, some labels of which may be wrong."""
    vocab: dict[bytes, int] = {}
    units, tokens, lang_of, base = [], [], [], 0
    for a, b in blocks(texts):
        s = scan(texts[a:b])
        _, at, inv = _unique_words(s)
        number = np.array([vocab.setdefault(s.word(i), len(vocab)) for i in at], np.int64)
        tokens.append(number[inv])
        units.append(s.word_unit + base)
        lang_of.append(np.array([codes.index(x) for x in labels[a:b]], np.int64)[s.doc])
        base += len(s.doc)
    if not tokens:
        return LanguageModel(codes, ContextTrees([[] for _ in codes], [np.empty(0)] * len(codes)))
    unit, token, lang = np.concatenate(units), np.concatenate(tokens), np.concatenate(lang_of)
    words = list(vocab)
    keep = np.ones(len(lang), bool)
    for rnd in range(CLEANING + 1):
        on = keep[unit]
        ws, cs = [], []
        for k in range(len(codes)):
            c = np.bincount(token[on & (lang[unit] == k)], minlength=len(words))
            some = np.flatnonzero(c)
            ws.append([words[i] for i in some])
            cs.append(c[some].astype(np.float64))
        trees = ContextTrees(ws, cs)
        if rnd < CLEANING:
            bits = _unit_bits(trees.code_lengths(words)[token], unit, len(lang))
            keep = bits.argmin(axis=1) == lang
    return LanguageModel(codes, trees)


def fit_on_sample(docs: DataFrame, key: str, text: str, label: Column, codes: list[str], sample: int = SAMPLE) -> LanguageModel:
    """Trees from at most ``sample`` whole documents of each language, those with the least hashes
    of their keys; only these ``len(codes) * sample`` rows come to the driver."""
    d = docs.select(F.col(key).alias("k"), label.alias("l")).where(F.col("l").isin(codes))
    w = Window.partitionBy("l").orderBy(F.xxhash64("k", F.lit(11)), "k")
    some = d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample).select("k", "l")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k").where("t is not null")
    rows = sorted(rows.collect(), key=lambda r: (r["l"], str(r["k"])))
    return fit([r["t"] for r in rows], [r["l"] for r in rows], codes)


def stretches(bits: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each sentence in the cheapest sequence, given their bits by language."""
    best = bits.argmin(axis=1)
    if (best == best[0]).all():
        return best
    n, n_lang = bits.shape
    cost, back = bits[0].copy(), np.zeros((n, n_lang), np.int64)
    for i in range(1, n):
        low = int(cost.argmin())
        change = cost[low] + switch
        back[i] = np.where(cost <= change, np.arange(n_lang), low)
        cost = np.minimum(cost, change) + bits[i]
    out = np.empty(n, np.int64)
    out[-1] = cost.argmin()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def confidence(bits: np.ndarray, lang: int) -> float:
    x = -(bits - bits.min()) * TEMPER * np.log(2)
    p = np.exp(x)
    return float(p[lang] / p.sum())


class _Words:
    """Code lengths of words met before; bounded."""

    def __init__(self, trees: ContextTrees):
        self.trees = trees
        self.hash, self.bits = np.empty(0, np.uint64), np.empty((0, trees.n_lang), np.float32)

    def bits_of(self, s: Scan) -> np.ndarray:
        h, at, inv = _unique_words(s)
        if len(self.hash) > KNOWN:
            self.__init__(self.trees)
        place = np.searchsorted(self.hash, h)
        place[place == len(self.hash)] = 0
        new = self.hash[place] != h if len(self.hash) else np.ones(len(h), bool)
        if new.any():
            got = self.trees.code_lengths([s.word(i) for i in at[new]])
            every = np.concatenate((self.hash, h[new]))
            order = np.argsort(every, kind="stable")
            self.hash, self.bits = every[order], np.concatenate((self.bits, got))[order]
            place = np.searchsorted(self.hash, h)
        return self.bits[place[inv]]


def identify(docs: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """(key, seg_no, n_segs, start_char, end_char, lang, confidence): the stretches of each text.

    Stretches are numbered from 1 and cover the whole text; a text in one language has one. A text
    without letters, and a null text, has no row. A text whose letters all stand in markup,
    parameters or commands is judged by these. Repeated rows are judged one by one; an empty table
    gives an empty result. Columns besides key and text are ignored. Words that no tree knows cost
    the same in all languages but for escapes; ties go to the language named first.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, seg_no int, n_segs int, start_char int, end_char int, lang string, confidence double"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def judge(texts: list[str], words: _Words):
        s = scan(texts)
        bits = _unit_bits(words.bits_of(s), s.word_unit, len(s.doc))
        has = np.zeros(len(s.doc), bool)
        has[s.word_unit] = True
        units = np.flatnonzero(has)
        doc, first = s.doc[units], np.searchsorted(s.doc[units], np.arange(len(texts) + 1))
        bits = bits[units]
        for i, t in enumerate(texts):
            a, b = first[i], first[i + 1]
            if a == b:
                found = [w.lower().encode() for w in _LETTERS.findall(t)]
                if found:
                    v = words.trees.code_lengths(found).sum(axis=0)
                    lang = int(v.argmin())
                    yield i, 1, 1, 0, len(t), lang, confidence(v, lang)
                continue
            path = stretches(bits[a:b])
            cuts = np.flatnonzero(np.diff(path)) + 1
            edges = [0, *cuts.tolist(), b - a]
            starts = [0, *s.start[units[a + cuts]].tolist(), len(t)]
            for k in range(len(edges) - 1):
                lang = int(path[edges[k]])
                v = bits[a + edges[k] : a + edges[k + 1]].sum(axis=0)
                yield i, k + 1, len(edges) - 1, starts[k], starts[k + 1], lang, confidence(v, lang)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        words = _Words(m.trees)
        for batch in batches:
            texts, keys = batch["_t"].tolist(), batch[key].to_numpy()
            for a, b in blocks(texts):
                rows = list(judge(texts[a:b], words))
                if rows:
                    at, *cols = zip(*rows)
                    yield pd.DataFrame(
                        {key: keys[np.array(at) + a], "seg_no": cols[0], "n_segs": cols[1], "start_char": cols[2], "end_char": cols[3], "lang": [m.codes[x] for x in cols[4]], "confidence": cols[5]}
                    )

    d = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_t")).where("_t is not null")
    return d.mapInPandas(run, schema)
