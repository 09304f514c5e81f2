"""Splitting oversized texts at natural boundaries.

One bounded-quantifier regular expression is matched over and over along the text. Its
alternatives are ordered by the strength of the boundary they end on (rest of the text, paragraph,
line, sentence, clause, word) and end in a fallback of plain characters, so consecutive matches are
contiguous and no character is lost. The overlap is looked back from each match's offset. All of it
runs in the JVM on SQL array functions; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundary_pattern(first: int, later: int) -> str:
    """Pattern whose successive matches cut a text: at most ``first`` code points for the match at
    the start of the text, at most ``later`` for the others. A strong boundary is taken only in the
    second half of the window, so that pieces do not get needlessly short; before characters are
    cut, each kind is tried over the whole window."""

    def window(n: int) -> str:
        half = max(1, n // 2)
        ends = (
            r"(?<=\n[ \t]{0,8}\r?\n)(?![\r\n])",  # paragraph
            r"(?<=\n)",  # line
            r"(?<=[.!?…][\"'”’»)\]]{0,2}\s)(?!\s)|(?<=[。！？]」?)(?![。！？」])",  # sentence
        )
        strong = [f".{{{half},{n}}}(?:{e})" for e in ends]
        weak = [
            rf".{{{half},{n}}}(?<=\s)(?!\s)",  # word, in the second half
            rf".{{1,{n}}}(?<=\s)(?!\s)",  # word, anywhere
            rf".{{1,{n}}}(?<=[、，。」）])",  # scripts without spaces
            rf".{{1,{n}}}(?![\p{{M}}\n])",  # characters, not before a combining mark or inside CRLF
            rf".{{1,{n}}}",
        ]
        return "|".join([rf".{{1,{n}}}\z", *strong, *weak])

    return rf"(?s)\A(?:{window(first)})|(?!\A)(?:{window(later)})"


def _overlap(prev: Column, overlap: int) -> Column:
    """The last ``overlap`` characters of a cut, moved on to the next word start when there is one
    in the first half of them."""
    tail = F.substring(prev, -overlap, overlap)
    tail = F.when(F.length(prev) > overlap, tail).otherwise(prev)
    return F.when(
        F.length(prev) > overlap, F.regexp_extract(tail, rf"(?s)\A(?:.{{0,{overlap // 2}}}?\s)?(.*)\z", 1)
    ).otherwise(tail)


def cuts(text: Column, limit: int = 2000, overlap: int = 150) -> Column:
    """Contiguous cuts of ``text`` whose concatenation is the text; null for null."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    found = F.regexp_extract_all(text, F.lit(boundary_pattern(limit, limit - overlap)), F.lit(0))
    return F.when(text.isNotNull(), F.when(F.length(text) <= limit, F.array(text)).otherwise(found))


def split_texts(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 150) -> DataFrame:
    """Rows ``(key, piece_no, n_pieces, start_char, cut_char, end_char, piece)``.

    ``piece`` has at most ``limit`` code points. It covers ``[start_char, end_char)`` of the text,
    0-based; ``[start_char, cut_char)`` repeats the end of the piece before. Concatenating
    ``substr(piece, cut_char - start_char)`` in order of ``piece_no`` (from 1) gives the text back.

    Null text: no row. Empty text: one empty piece. A text of at most ``limit`` characters: one
    piece. Repeated rows and equal keys are split one by one. Columns besides key and text, whatever
    their names, are left out; no name is used twice as the input is narrowed to two columns first.
    """
    kt = df.schema[key].dataType.simpleString()
    c = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t is not null")
    c = c.select("k", cuts(F.col("t"), limit, overlap).alias("c"))
    # each cut with its place and the end of the one before it, so that a row of the result holds its
    # own piece only. The outer form of explode keeps Spark from filtering on the computed array,
    # for which it would make it twice
    before = F.concat(F.array(F.lit("")), F.slice("c", 1, F.size("c") - 1))
    heads = F.transform(before, lambda x: _overlap(x, overlap)) if overlap else F.transform("c", lambda x: F.lit(""))
    c = c.select("k", "c", F.size("c").alias("n"), F.transform("c", lambda x: F.length(x)).alias("len"))
    c = c.withColumn("sums", _block_sums("len")).withColumn("sums", F.transform("sums", lambda _, b: _total(F.slice("sums", 1, b))))
    c = c.select("k", "n", F.posexplode_outer(F.arrays_zip(heads.alias("h"), F.col("c").alias("o"), _places("len", "sums").alias("at"))).alias("i", "x"))
    c = c.select("k", "n", "i", F.col("x.h").alias("h"), F.col("x.o").alias("o"), F.col("x.at").alias("at"))
    return c.select(
        F.col("k").cast(kt).alias(key),
        (F.col("i") + 1).cast("int").alias("piece_no"),
        F.col("n").cast("int").alias("n_pieces"),
        (F.col("at") - F.length("h")).cast("int").alias("start_char"),
        F.col("at").cast("int").alias("cut_char"),
        (F.col("at") + F.length("o")).cast("int").alias("end_char"),
        F.concat("h", "o").alias("piece"),
    )


_BLOCK = 64  # numbers of a block of prefix sums


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _block_sums(numbers: str) -> Column:
    """The sum of each block of numbers. With the sums of all blocks before it a prefix sum looks at
    one block only, so the work stays about in proportion to the numbers."""
    last = F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(numbers, b * _BLOCK + 1, _BLOCK)))


def _places(numbers: str, sums: str) -> Column:
    """The sum of all numbers before each."""
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    return F.transform(numbers, lambda _, i: F.element_at(sums, block(i) + 1) + _total(F.slice(numbers, block(i) * _BLOCK + 1, i % _BLOCK)))


def divided(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 150) -> DataFrame:
    """The keys of the texts that :func:`cuts` divides, each once, with their number of pieces."""
    long = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_t")).where(F.length("_t") > limit)
    c = long.select(key, F.size(cuts(F.col("_t"), limit, overlap)).alias("n_pieces"))
    # the count is looked at only once it is made, so no filter on it makes the cuts a second time
    return c.groupBy(key).agg(F.max("n_pieces").alias("n_pieces")).where("n_pieces > 1")
