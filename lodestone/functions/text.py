"""Text normalisation, tokens and n-grams as Column -> Column functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java's pattern of strings whose NFKC form is themselves and whose case folding is lower() with sharp s as ss.
SAFE = r"^[\x{0}-\x{17E}&&[^\x{A0}\x{A8}\x{AA}\x{AF}\x{B2}-\x{B5}\x{B8}-\x{BA}\x{BC}-\x{BE}\x{130}\x{132}\x{133}\x{13F}\x{140}\x{149}]]*$"


def fold_python(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def _fold(c: Column) -> Column:
    """fold_python() on Arrow batches; a nested function, so executors get it by value."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return F.pandas_udf(run, "string")(c)


def fold(c: Column, unicode: bool = True) -> Column:
    """NFKC and case folding. Natively where that is proven equal; other rows go through Python, unless unicode is off."""
    native = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    if not unicode:
        return native
    safe = c.rlike(SAFE)
    return F.coalesce(F.when(safe, native), _fold(F.when(~safe, c)))


def normalize_text(c: Column, unicode: bool = True) -> Column:
    """'' for null; folded, punctuation and white space as one space, trimmed."""
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit("")), unicode), r"[^\p{L}\p{N}_]+", " "))


def beyond_native(*columns: str) -> Column:
    """Whether any of the columns needs the Python path; never null."""
    return reduce(lambda a, b: a | b, [~F.coalesce(F.col(c), F.lit("")).rlike(SAFE) for c in columns])


def needs_unicode(df: DataFrame, *columns: str) -> bool:
    """Whether any value needs the Python path: one native scan, over when the first is found."""
    return bool(df.where(beyond_native(*columns)).limit(1).count())


def all_tokens(c: Column) -> Column:
    """Tokens of a normalised text, in order, with repeats."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def tokens(c: Column) -> Column:
    return F.array_distinct(all_tokens(c))


def first_token(c: Column) -> Column:
    """'' if there is none."""
    return F.coalesce(F.get(all_tokens(c), F.lit(0)), F.lit(""))


def first_two_tokens(c: Column) -> Column:
    """Null if there are fewer than two."""
    t = all_tokens(c)
    return F.when(F.size(t) >= 2, F.concat_ws(" ", F.slice(t, 1, 2)))


def digit_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: t.rlike(r"^\p{Nd}+$"))


def character_grams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams of ^text$; none of ''."""
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1))), lambda i: F.substr(padded, i, F.lit(n)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))
