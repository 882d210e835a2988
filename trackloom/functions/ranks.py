"""Places of rows in ordered groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.stages import Shelf

#: A table of at most so many narrow rows is broadcast; a longer one is joined by Spark's choice.
MOST_BROADCAST = 10_000


def joined_small(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner", most: int = MOST_BROADCAST) -> DataFrame:
    """left with the other columns of right, joined null-safe; right, a table that is worked out already, is
    broadcast only if it is found to have at most `most` rows."""
    hint = F.broadcast(right) if right.limit(most + 1).count() <= most else right
    names = {c: f"__{c}_of_right" for c in columns}
    for c, name in names.items():
        hint = hint.withColumnRenamed(c, name)
    met = F.lit(True)
    for c, name in names.items():
        met = met & F.col(c).eqNullSafe(F.col(name))
    return left.join(hint, met, how).drop(*names.values())


def ranked(shelf: Shelf, df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "ranked") -> DataFrame:
    """df with `at`, the row's place from 0 in its group by `order` (nulls first), and `total`, the group's rows.

    Rows are dealt out by range over (by, order), so a group of any size is cut over tasks; a row's place is
    its place in its part plus the rows of the group in parts before. Equal rows are told apart by where they
    are read, so that many of them are cut too. The parts are written to the shelf under `name`.
    """
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order, "__salt")]
    parts = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__salt")
    parts = parts.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.expr("shiftright(__at, 33)"))
    parts = shelf.put(name, parts)
    counts = parts.groupBy(*by, "__part").agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"__before": F.coalesce(before, F.lit(0)), "total": F.sum("__n").over(group)}).drop("__n")
    counts = shelf.put(f"{name}-parts", counts)
    out = joined_small(parts, counts, [*by, "__part"])
    at = F.col("__at") - F.col("__from") + F.col("__before")
    return out.withColumn("at", at).drop("__at", "__part", "__from", "__before")
