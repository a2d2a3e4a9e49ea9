"""Text functions of place search: normal forms, grams, spans, edit distance."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


@F.pandas_udf(StringType())
def _stripped(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks; Spark has no function for it."""

    def strip(t):
        if t is None or t.isascii():
            return t
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    return texts.map(strip)


def normal(text: Column) -> Column:
    """Lower case, ß as ss, marks stripped, one space for all that is neither letter nor digit."""
    plain = _stripped(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def grams(text: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` letters; none in a shorter text."""
    last = F.length(text) - (n - 1)
    found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def spans(tokens: Column, most: int = 8) -> Column:
    """Every run of up to ``most`` tokens, joined without spaces."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    each = lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(most), n - i + 1)), lambda k: F.array_join(F.slice(tokens, i, k), "")
    )
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(starts, each)))).otherwise(F.array().cast("array<string>"))


def _damerau(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours as one; ``most`` + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return min(one[-1], most + 1)


@F.pandas_udf(IntegerType())
def edits(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    """Edit distance of pairs, on candidates that grams have found."""
    return pd.Series([None if x is None or y is None else _damerau(x, y, int(m)) for x, y, m in zip(a, b, most)], dtype="Int32")


def edit_budget(text: Column) -> Column:
    """Edits that a word may differ by: none below five letters, one below eight, else two."""
    return F.when(F.length(text) < 5, 0).when(F.length(text) < 8, 1).otherwise(2)


def shortened(name: str, most: Column) -> Column:
    """The text and all that is left of it without up to ``most`` letters, two at most."""

    def less(c: Column) -> Column:
        cut = lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))
        return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), cut)).otherwise(F.array().cast("array<string>"))

    text, none = F.col(name), F.array().cast("array<string>")
    one = F.when(most >= 1, less(text)).otherwise(none)
    two = F.when(most >= 2, F.flatten(F.transform(less(text), less))).otherwise(none)
    return F.array_distinct(F.concat(F.array(text), one, two))
