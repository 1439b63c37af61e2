"""Retrieval quality as column expressions over arrays of retrieved and expected ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _set(a: Column) -> Column:
    return F.array_distinct(F.coalesce(a, F.array().cast("array<string>")))


def precision_recall_f1(retrieved: Column, expected: Column) -> Column:
    """struct(precision, recall, f1) on sets; nothing expected counts as met when nothing was retrieved."""
    r, e = _set(retrieved), _set(expected)
    return of_counts(F.size(F.array_intersect(r, e)), F.size(r), F.size(e))


def of_counts(both: Column, retrieved: Column, expected: Column) -> Column:
    """``precision_recall_f1`` from the numbers of ids that are in both sets, retrieved and expected."""
    none = F.when(retrieved == 0, 1.0).otherwise(0.0)
    p = F.when(expected == 0, none).when(retrieved == 0, 0.0).otherwise(both / F.greatest(retrieved, F.lit(1)))
    c = F.when(expected == 0, 1.0).when(retrieved == 0, 0.0).otherwise(both / F.greatest(expected, F.lit(1)))
    f = F.when(expected == 0, none).when(p + c > 0, 2 * p * c / (p + c)).otherwise(0.0)
    return F.struct(p.alias("precision"), c.alias("recall"), f.alias("f1"))


def dcg(retrieved: Column, expected: Column, k: int) -> Column:
    """Binary gains, discounted by log2 of the place; an id that comes twice counts twice."""
    return dcg_of(F.transform(retrieved, lambda x: F.array_contains(expected, x)), F.size(expected), k)


def dcg_of(hits: Column, expected: Column, k: int) -> Column:
    """``dcg`` from whether each retrieved id is expected, in order, and the number of expected ids."""
    gains = F.transform(F.slice(hits, 1, k), lambda x, i: F.when(x, 1 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    return F.coalesce(F.when((F.size(hits) > 0) & (expected > 0), F.aggregate(gains, F.lit(0.0), lambda acc, x: acc + x)), F.lit(0.0))


def ideal_dcg(expected: Column, k: int) -> Column:
    return ideal_of(F.size(expected), k)


def ideal_of(expected: Column, k: int) -> Column:
    return F.when(expected > 0, F.aggregate(F.sequence(F.lit(1), F.least(expected, F.lit(k))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1.0)))).otherwise(0.0)


def ndcg(retrieved: Column, expected: Column, k: int) -> Column:
    return ndcg_of(F.transform(retrieved, lambda x: F.array_contains(expected, x)), F.size(expected), k)


def ndcg_of(hits: Column, expected: Column, k: int) -> Column:
    best = ideal_of(expected, k)
    return F.when(best > 0, dcg_of(hits, expected, k) / best).otherwise(0.0)


def token_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the sets of lower-cased words split at white space."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)
