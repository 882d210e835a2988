"""Windows and small expressions for series of frames, one series a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def video():
    """One partitioning serves all windows, so that Spark shuffles and sorts a table once."""
    return Window.partitionBy("video_id")


def by_frame():
    return Window.partitionBy("video_id").orderBy("frame")


def whole():
    """All rows of a video, in the order of by_frame(), so that Spark works it out in one pass with windows of that order."""
    return by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Euclidean, as a plain square root."""
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def where(df: DataFrame, test: Column) -> DataFrame:
    """df.filter(test) for a long test: worked out once a row, in compiled code. A plain filter is moved into the join
    below, where the columns that the test mentions are worked out anew at each mention; a row's number isn't moved."""
    met = df.withColumns({"__met": test, "__row": F.monotonically_increasing_id()})
    return met.filter("__met AND __row >= 0").drop("__met", "__row")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def angle(ax: Column, ay: Column, bx: Column, by: Column, na: Column, nb: Column) -> Column:
    """Degrees between two vectors of lengths na and nb; null if one is zero."""
    return F.degrees(F.acos(clip(F.try_divide(ax * bx + ay * by, na * nb), -1.0, 1.0)))


def numbered(df: DataFrame) -> DataFrame:
    """With `k`, the row's place in its series from 0, and `n`, the series' rows."""
    return df.withColumn("k", F.row_number().over(by_frame()) - 1).withColumn("n", F.count("*").over(whole()).cast("int"))


def ordered_list(*fields: str) -> Column:
    """An aggregate: structs of the fields, sorted by them in turn."""
    return F.array_sort(F.collect_list(F.struct(*fields)))
