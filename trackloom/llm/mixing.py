"""Operator 8: mixing sources to target weights, in DataFrame functions only.

Words are added up per source, the targets follow by water-filling, and each document is taken
floor(rate) times plus once more with a hash-seeded chance of the fraction that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import word_count

#: A broadcast of the source table needs at most this many sources; beyond, Spark shuffles.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> the same with `target`.

    Sources by code point, nulls last, weigh `weights` in turn and share the sum of all sizes; no
    target passes `cap` times its source's size, the excess going to the others by weight. That
    is min(cap * size, level * weight) at one level: sources sorted by cap * size / weight are
    capped up to the first whose share of what is left fits. One row per source is windowed,
    never documents. An empty table gives no row, an empty source a target of 0.
    """
    # One row per source comes in, so the two unpartitioned windows see a summary only.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", rank.alias("rank"), turn.alias("weight"))
    order = Window.orderBy((F.col("source_size") * cap / F.col("weight")), "rank")
    everything = Window.partitionBy()
    before = F.coalesce(
        F.sum(F.col("source_size") * cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumns(
        {
            "level": (F.sum("source_size").over(everything) - before) / rest,
            "place": F.row_number().over(order),
        }
    )
    fits = F.when(F.col("level") <= F.col("source_size") * cap / F.col("weight"), F.struct("place", "level"))
    filled = levels.withColumn("fill", F.min(fits).over(everything)["level"])
    target = F.least(
        (F.col("source_size") * cap).cast("double"), F.coalesce("fill", F.lit(0.0)) * F.col("weight")
    )
    return filled.select("source", "source_size", target.alias("target"))


def chance(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the id (by the text where the id is null)."""
    name = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**48))


def mix_sources(
    docs: DataFrame, seed: str = "mix", cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), carry: tuple[str, ...] = ()
) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, text, size, source_size, target, copies, taken.

    A null source is a source of its own, null or empty text has size 0 and target share 0.
    Repeated rows of one id draw alike, as reruns do. Of the other columns
    only those named in `carry` stay, so none can clash. Documents are never shuffled: the source table is joined by broadcast if it
    is counted to be within BROADCAST_SOURCES, and by Spark's own choice if not.
    """
    sized = docs.select("doc_id", "source", "text", *carry, word_count(F.col("text")).alias("size"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, cap, weights).withColumnRenamed("source", "of_source").persist()
    side = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap))))
    whole = F.floor(F.coalesce(rate, F.lit(0.0)))
    extra = chance(seed, F.col("doc_id"), F.col("text")) < F.coalesce(rate, F.lit(0.0)) - whole
    return (
        sized.join(side, F.col("source").eqNullSafe(F.col("of_source")), "left")
        .withColumn("copies", (whole + extra.cast("int")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("of_source")
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row of mix_sources `copies` times, numbered from 1 in `copy`."""
    taken = mixed.filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of mix_sources over all documents."""
    from trackloom.llm.common import read

    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sizes),
weighted AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM ranked),
levels AS (
  SELECT *, row_number() OVER w AS place,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW w AS (ORDER BY source_size * 3 / weight, rank)),
fill AS (
  SELECT arg_min(level, place) AS fill FROM levels WHERE level <= source_size * 3 / weight),
targets AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, coalesce(fill, 0) * weight) AS target
  FROM levels, fill),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, md5(s.text), '')), 1, 12))::BIGINT
      / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM rated
"""
