"""Set similarities over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, items: Column, *columns: str, name: str = "t") -> DataFrame:
    """Columns and one row per item.

    The outer form, since a plain explode adds a filter on the items that is pushed down
    to where they are made, and makes them once more.
    """
    return rows.select(*columns, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of ' text '; none for an empty text."""
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), c, F.lit(" ")), F.lit("(?s)(?=(...))"), F.lit(1)))


def jaccard(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """Common share of the union; ``empty`` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Common share of the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def weight(weights: Column, default: Column):
    """token -> its weight from a map column, or the default."""
    return lambda t: F.coalesce(F.element_at(weights, t), default)


def total(a: Column, w) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda s, t: s + w(t))


def weighted_overlap(a: Column, b: Column, w) -> Column:
    """Weight of the common tokens in that of a; 0 if a weighs nothing."""
    all_a = total(a, w)
    return F.when(all_a == 0, F.lit(0.0)).otherwise(total(F.array_intersect(a, b), w) / all_a)


def weighted_cosine(a: Column, b: Column, w) -> tuple[Column, Column]:
    """(cosine, containment) of binary vectors with squared weights; 0 where one is empty."""
    square = lambda t: w(t) * w(t)
    x, y, both = total(a, square), total(b, square), total(F.array_intersect(a, b), square)
    none = (x == 0) | (y == 0)
    return F.when(none, F.lit(0.0)).otherwise(both / F.sqrt(x * y)), F.when(none, F.lit(0.0)).otherwise(both / F.least(x, y))


def heaviest(a: Column, w) -> Column:
    """Largest weight in the set; 0 for none."""
    return F.coalesce(F.array_max(F.transform(a, w)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
