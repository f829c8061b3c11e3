"""Joins on time that stay equi-joins: intervals by bins, nearest values by ranges of the time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X


def _bin(x: str | Column, width: float) -> Column:
    return F.floor(X.col(x) / width)


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows with equal ``on`` whose closed spans meet, each pair once; columns of both sides.

    Either side is listed under every bin of ``width`` that it touches, so a row is copied as
    often as it is bins long: take a width of about the usual length. A pair counts in the bin
    where the later of the two begins. Rows with a null or backward span meet nothing."""
    names = [c for c in right.columns if c not in on]
    clash = set(names) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    (a, b), (c, d) = left_span, right_span
    dealt = lambda df, lo, hi: df.filter(F.col(lo) <= F.col(hi)).withColumn("__bin", F.explode(F.sequence(_bin(lo, width), _bin(hi, width))))
    rows = dealt(left, a, b).join(dealt(right, c, d), [*on, "__bin"])
    meets = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("__bin") == _bin(F.greatest(a, c), width))
    return rows.filter(meets).select(*left.columns, *names)


def nearest(points: DataFrame, values: DataFrame, on: str, at: str, value: str, span: float = 256.0) -> DataFrame:
    """``points`` with the nearest ``value`` of the same ``on`` as ``nearest``, the smaller one on ties, null without any.

    Points and values are sorted together within ranges of ``span``; what lies beyond a range's
    ends comes from a row per range. So neither the values of a key nor its points need to be in
    one task."""
    points = points.withColumn("__range", _bin(at, span))
    values = values.filter(F.col(value).isNotNull()).select(F.col(on), F.col(value).cast("double").alias("__v")).withColumn("__range", _bin("__v", span))
    ends = values.groupBy(on, "__range").agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    ranges = ends.unionByName(points.select(on, "__range").distinct(), allowMissingColumns=True).groupBy(on, "__range").agg(F.min("__low").alias("__low"), F.max("__high").alias("__high"))
    order = Window.partitionBy(on).orderBy("__range")
    ranges = ranges.select(
        F.col(on).alias("__on"), F.col("__range").alias("__r"),
        F.last("__high", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("__low", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    both = points.withColumn("__point", F.lit(1)).unionByName(values.withColumn(at, F.col("__v")).withColumn("__point", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(on, "__range").orderBy(at, "__point")
    both = both.withColumns(
        {"__below": F.last("__v", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__above": F.first("__v", True).over(inside.rowsBetween(0, Window.unboundedFollowing))}
    ).filter("__point = 1")
    rows = both.join(ranges, F.col(on).eqNullSafe(F.col("__on")) & F.col("__range").eqNullSafe(F.col("__r")), "left")
    below, above = F.coalesce("__below", "__before"), F.coalesce("__above", "__after")
    chosen = F.when(below.isNull(), above).when(above.isNull() | (F.col(at) - below <= above - F.col(at)), below).otherwise(above)
    names = [c for c in points.columns if c != "__range"]
    return rows.select(*names, chosen.alias("nearest"))
