"""Column functions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_value(c: Column) -> Column:
    """Spaces at both ends removed, lower case."""
    return F.lower(F.trim(c))


def base_id(target) -> Column:
    """The id a target names: what stands before the first ``#``."""
    return F.substring_index(target, "#", 1)


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def excerpt(text: Column, n: int) -> Column:
    """Line feeds become spaces, then the first n characters, with an ellipsis if there are more."""
    flat = F.translate(text, "\n", " ")
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def terms(query: str) -> list[str]:
    """Lower-case words of a query, split at Unicode white space; repeats stay and count again."""
    found = query.lower().split()
    if not found:
        raise ValueError("query must not be empty")
    return found


def score(title: Column, text: Column, words: list[str]) -> Column:
    """5 for each word the title contains, and 1 for each place, without overlap, in the text."""
    t, x = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for w in words:
        places = (F.char_length(x) - F.char_length(F.replace(x, F.lit(w), F.lit("")))) / F.lit(len(w))
        total = total + F.when(t.contains(w), F.lit(5)).otherwise(0) + places.cast("int")
    return total
