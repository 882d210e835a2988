"""Joins of points with the spans that they lie in, by bins of time: an equality that Spark can deal out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames of a bin. A span is copied into every bin that it touches, so rows compared are those of a span's own
#: length and at most a bin more at either end.
BIN = 64


def binned(spans: DataFrame, low: Column, high: Column, width: int = BIN) -> DataFrame:
    """spans with `lo`, `hi` (both inclusive) and one row per `bin` that they touch; empty spans go."""
    s = spans.withColumns({"lo": low.cast("int"), "hi": high.cast("int")}).filter("lo <= hi")
    return s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))


def inside(points: DataFrame, spans: DataFrame, low: Column, high: Column, how: str = "inner", width: int = BIN) -> DataFrame:
    """points(video_id, frame, ...) joined with the spans(video_id, ...) of their video with low <= frame <= high.

    A point has one bin, so no pair comes twice. The spans' columns must have other names than the points', but for
    video_id; `lo` and `hi` come with them. `how` is inner, left, left_semi or left_anti. A video of any length is dealt
    out by its bins; a frame that many spans hold makes as many rows as the result has."""
    s = binned(spans, low, high, width).withColumnRenamed("video_id", "span_video")
    p = points.withColumn("point_bin", F.floor(F.col("frame") / width))
    met = (F.col("video_id") == F.col("span_video")) & (F.col("point_bin") == F.col("bin")) & F.col("frame").between(F.col("lo"), F.col("hi"))
    return p.join(s, met, how).drop("point_bin", "bin", "span_video")
