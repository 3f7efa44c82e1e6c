"""Similarities of normalised texts and token sets. The conventions for empty sides differ on purpose; each says its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text


def _double(x) -> Column:
    return F.lit(float(x))


def levenshtein_sim(a: Column, b: Column) -> Column:
    """1 if equal (both empty too), 0 if one is empty, else 1 - distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, _double(1)).when((a == "") | (b == ""), _double(0)).otherwise(F.greatest(_double(0), 1 - F.levenshtein(a, b) / longer))


def set_jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), _double(0)).otherwise(both / (F.size(a) + F.size(b) - both))


def set_jaccard_or_null(a: Column, b: Column) -> Column:
    """Null if both sets are empty, 0 if one is."""
    return F.when((F.size(a) > 0) | (F.size(b) > 0), set_jaccard(a, b))


def token_sort_sim(a: Column, b: Column) -> Column:
    """0 if either is empty, else levenshtein_sim of the sorted tokens, repeats included."""
    ordered = lambda c: F.array_join(F.array_sort(text.all_tokens(c)), " ")
    return F.when((a == "") | (b == ""), _double(0)).otherwise(levenshtein_sim(ordered(a), ordered(b)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common tokens by those of the smaller set; 0 if that is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / F.when(least > 0, least)).otherwise(_double(0))


def length_ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, F.least(F.length(a), F.length(b)) / F.when(longer > 0, longer)).otherwise(_double(0))


def flag(condition: Column) -> Column:
    return F.when(condition, _double(1)).otherwise(_double(0))


def equal_not_empty(a: Column, b: Column) -> Column:
    return (a != "") & (a == b)
