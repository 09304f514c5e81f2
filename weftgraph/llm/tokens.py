"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the vocabulary's texts are divided before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

RUN = 10_000  # white space of this length is taken out of a text before the pattern sees it
_LONG_RUN = regex.compile(rf"\p{{White_Space}}{{{RUN},}}")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of the whole text.

    The pattern's engine has a stack for white space that it goes back over, so very long runs of it
    are encoded apart: before a word the pattern takes a run but its last character, at the end of the
    text all of it, and what stands before the run ends in a token that the run cannot change. The
    count is therefore that of the whole."""
    enc, n, at = encoding(path), 0, 0
    for m in _LONG_RUN.finditer(text) if len(text) >= RUN else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += _encoded(enc, text[at : m.start()]) + len(enc._encode_single_piece(text[m.start() : end]))
        at = end
    return n + _encoded(enc, text[at:] if at else text)


def _encoded(enc, text: str) -> int:
    # long results as an array, not as a list of objects
    return len(enc.encode_ordinary(text)) if len(text) < 100_000 else len(enc.encode_to_numpy(text, disallowed_special=()))


def token_counts(df: DataFrame, key: str, text: str, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """(key, keep..., n_tokens), written once to the shared folder; a null text has 0 tokens."""
    d = df.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{key}`"), *[F.col(f"`{k}`") for k in keep])
    fields = [f for f in d.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = np.fromiter((0 if t is None else count_tokens(t, path) for t in b["_text"]), np.int64, len(b))
            yield b.drop(columns="_text").assign(n_tokens=n)

    return cut(d.mapInPandas(run, schema))
