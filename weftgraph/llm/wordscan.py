"""Words and sentences of many texts at once, for language identification.

What carries no language is blanked first: front matter, fenced code, table rows, tags. Then all
work is on the bytes of a block of texts: letters are folded (lower case, no accents, no combining
marks), sentences end at line ends and after stops, and tokens that look like parameters, options
or commands (digits, underscores, inner dots, hyphens or capitals, leading dashes) are skipped.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np

from .shingles import _powers, mix

_FRONT = re.compile(r"\A\ufeff?---[ \t]*\r?\n.*?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*\r?$|\Z)", re.S | re.M)
_ROW = re.compile(r"^[ \t]*\|.*$", re.M)
_TAG = re.compile(r"<[!/?]?([A-Za-z][\w.-]*)[^<>]*>")
# Tags inside a line; all others end one.
_IN_LINE = frozenset("a abbr b cite code em i keyword kbd ph q s small span strong sub sup term tm tt u xref".split())
_CODE_TAG = re.compile(r"<(codeblock|codeph|cmdname|parmname|option|uicontrol|menucascade|filepath|pre|code|screen)\b[^<>]*>.*?</\1>", re.S)
_TICK = re.compile(r"`[^`\n]+`")
_KEEP_LINES = re.compile(r"[^\n]")


def blank(text: str) -> str:
    """The text with everything that carries no language replaced by spaces, place by place."""

    def out(m: re.Match) -> str:
        return _KEEP_LINES.sub(" ", m[0])

    def line(m: re.Match) -> str:
        return out(m) if m[1].lower() in _IN_LINE else out(m)[:-1] + "\n"

    if "<" in text:
        text = _TAG.sub(line, _CODE_TAG.sub(out, text))
    if text[:4].lstrip("\ufeff").startswith("---"):
        text = _FRONT.sub(out, text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(out, text)
    if "`" in text:
        text = _TICK.sub(out, text)
    if "|" in text:
        text = _ROW.sub(out, text)
    return text


def _fold_table() -> np.ndarray:
    """Base letter for two-byte letters with a Latin base, by (lead - 0xC3) * 64 + low bits; else 0."""
    t = np.zeros(3 * 64, np.uint8)
    for cp in range(0xC0, 0x180):
        base = unicodedata.normalize("NFKD", chr(cp))[0].lower()
        base = "s" if cp == 0xDF else base
        if "a" <= base <= "z":
            t[((0xC0 | cp >> 6) - 0xC3) * 64 + (cp & 63)] = ord(base)
    return t


_FOLD = _fold_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _is(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SPACE, _ODD, _STOP = _is(" \t\n\r\f\v"), _is("0123456789_=/\\@#$%{}[]^~+&*"), _is(".!?:;")


@dataclass
class Scan:
    """``doc``, ``start``, ``end`` of each sentence (code points of its text); ``word_unit``: the
    sentence of each word; ``word_hash``; ``word(i)``: its folded bytes."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_unit: np.ndarray
    word_hash: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    buf: np.ndarray

    def word(self, i: int) -> bytes:
        return self.buf[self.begin[i] : self.stop[i]].tobytes()


def scan(texts: list[str]) -> Scan:
    raw = [blank(t).encode("utf-8", "replace") for t in texts]
    src = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    doc_end = np.cumsum([len(r) + 1 for r in raw])
    nxt, nx2 = np.append(src[1:], 0).astype(np.uint8), np.append(src[2:], [0, 0]).astype(np.uint8)

    buf, keep, apart = src.copy(), np.ones(len(src), bool), np.zeros(len(src), bool)
    camel = np.zeros(len(src), bool)
    low, up = (src >= 97) & (src <= 122), (src >= 65) & (src <= 90)
    camel[:-1] = low[:-1] & up[1:]
    buf = _LOWER[buf]
    stop_cjk = np.zeros(len(src), bool)
    if (src >= 0x80).any():
        two = np.flatnonzero((src >= 0xC3) & (src <= 0xC5))
        base = _FOLD[(src[two].astype(np.int64) - 0xC3) * 64 + (nxt[two] & 63)]
        two, base = two[base > 0], base[base > 0]
        buf[two], keep[two + 1] = base, False
        marks = np.flatnonzero((src == 0xCC) | ((src == 0xCD) & (nxt < 0xB0)))
        keep[marks] = keep[marks + 1] = False
        kana = np.flatnonzero((src == 0xE3) & (nxt == 0x82) & ((nx2 == 0x99) | (nx2 == 0x9A)))
        for d in range(3):
            keep[kana + d] = False
        # Cyrillic capitals
        a = np.flatnonzero((src == 0xD0) & (nxt >= 0x90) & (nxt <= 0x9F))
        buf[a + 1] = nxt[a] + 0x20
        a = np.flatnonzero((src == 0xD0) & (nxt >= 0xA0) & (nxt <= 0xAF))
        buf[a], buf[a + 1] = 0xD1, nxt[a] - 0x20
        a = np.flatnonzero((src == 0xD0) & (nxt == 0x81))
        buf[a], buf[a + 1] = 0xD0, 0xB5
        a = np.flatnonzero((src == 0xD1) & (nxt == 0x91))
        buf[a], buf[a + 1] = 0xD0, 0xB5
        # punctuation beyond ASCII
        a = np.flatnonzero(src == 0xC2)
        apart[a] = apart[a + 1] = True
        three = (src == 0xE2) | ((src == 0xE3) & (nxt == 0x80)) | ((src == 0xEF) & ((nxt == 0xBB) | (nxt == 0xBC)))
        a = np.flatnonzero(three)
        for d in range(3):
            apart[a + d] = True
        full = ((src == 0xE3) & (nxt == 0x80) & (nx2 == 0x82)) | ((src == 0xEF) & (nxt == 0xBC) & ((nx2 == 0x81) | (nx2 == 0x9F)))
        stop_cjk[np.flatnonzero(full) + 2] = True

    # sentence ends, as places after which a new one begins
    space = _SPACE[src]
    last = (src == 10) | stop_cjk
    last[:-1] |= _STOP[src[:-1]] & space[1:]
    last[-1] = True
    ends = np.flatnonzero(last) + 1
    begins = np.concatenate(([0], ends[:-1]))
    # letters: only ASCII letters and bytes of other scripts count
    high = (src >= 0x80) & ~apart
    buf[apart] = 32
    letter = ((buf >= 97) & (buf <= 122)) | (high & (buf >= 0x80))

    pos = np.flatnonzero(keep)
    b, let, hi = buf[pos], letter[pos], (buf[pos] >= 0x80)
    sp = _SPACE[b]
    # tokens: runs without space on one side of the ASCII border
    kind = np.where(sp, 0, np.where(hi, 2, 1)).astype(np.int8)
    change = np.flatnonzero(np.diff(kind)) + 1
    tok = np.zeros(len(b), np.int64)
    tok[change] = 1
    tok = np.cumsum(tok)
    odd = _ODD[b] | camel[pos]
    inner = np.zeros(len(b), bool)
    inner[1:-1] = ((b[1:-1] == 46) | (b[1:-1] == 45) | (b[1:-1] == 58)) & let[:-2] & let[2:]
    lead = np.zeros(len(b), bool)
    lead[:-1] = (b[:-1] == 45) & (let[1:] | (b[1:] == 45))
    lead[1:] &= ~let[:-1]
    bad = np.bincount(tok, weights=odd | inner | lead) > 0
    is_word = let & (kind > 0) & ~bad[tok]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    # a border between scripts ends a word, too
    begin, stop = edge[0::2], edge[1::2]
    up_, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up_[: len(b)], out=total[1:])
    h = mix((total[stop] - total[begin]) * down[begin])
    unit = np.searchsorted(ends, pos[begin], side="right") if len(begin) else np.empty(0, np.int64)
    chars = np.concatenate(([0], np.cumsum((src & 0xC0) != 0x80)))
    doc = np.searchsorted(doc_end, begins, side="right")
    first = chars[np.concatenate(([0], doc_end[:-1]))]
    return Scan(doc, chars[begins] - first[doc], chars[ends] - first[doc], unit, h, begin, stop, b)
