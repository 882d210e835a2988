"""Deterministic trajectories and poses made from the driver's general tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.ranks import joined_small


@dataclass(frozen=True)
class Clip:
    """What an adapter's videos have in common."""

    fps: float
    frame_w: int
    frame_h: int
    net_y: float


EVENTS, LINEITEM = Clip(5.0, 1280, 100, 50.5), Clip(30.0, 1280, 720, 350.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video per user; error events are missed detections."""
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = F.col("event_type") != "error"
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").cast("string").alias("video_id"),
        (F.row_number().over(order) - 1).alias("frame"),
        F.when(seen, F.col("value") + 1.0).otherwise(0.0).alias("x"),
        F.when(seen, (k + 1).cast("double")).otherwise(0.0).alias("y"),
    )


def lineitem_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long video per supplier, without missed detections."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return li.select(
        F.col("l_suppkey").cast("string").alias("video_id"),
        (F.row_number().over(order) - 1).alias("frame"),
        (F.col("l_quantity") * 20.0).alias("x"),
        (F.col("l_extendedprice") / 150.0).alias("y"),
    )


def videos_of(frames: DataFrame, clip: Clip) -> DataFrame:
    """One row per video of frames."""
    return frames.groupBy("video_id").agg(F.count("*").cast("int").alias("n_frames")).select(
        "video_id", F.lit(clip.frame_w).alias("frame_w"), F.lit(clip.frame_h).alias("frame_h"),
        F.lit(clip.fps).alias("fps"), "n_frames",
    )


def embedding_pose(spark: SparkSession, sf_dir: str, videos: DataFrame, places: DataFrame | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """Two persons a frame, of 17 key points each from an embedding's first 51 numbers, in every video.

    places(video_id, frame) asks for those frames alone, each once and inside its video. `told` names columns that
    follow from a person's key points and stand in their place: persons are few and videos many, so that they are worked out once a person."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = lambda i: F.col("embedding")[i].cast("double")
    points = F.array(*(
        F.struct((120 + 400 * v(3 * i)).alias("x"), (50 + 200 * v(3 * i + 1)).alias("y"), (4 * F.abs(v(3 * i + 2))).alias("conf"))
        for i in range(17)
    ))
    persons = e.select(
        F.expr("cast(vec_id div 2 as int)").alias("frame"), (F.col("vec_id") % 2).cast("int").alias("person_idx"),
        (F.col("vec_id") % 2 + 1).cast("int").alias("track_id"), points.alias("keypoints"),
    )
    if told is not None:
        persons = persons.select("frame", "person_idx", "track_id", *(c.alias(name) for name, c in told.items()))
    longest = videos.agg(F.max("n_frames")).first()[0] or 0
    persons = persons.filter(F.col("frame") < longest)
    # The same persons in every video: an equi-join on the frame, not a product. Rows stay where their frames are, so that
    # frames that are a table already give as many tasks as it has, and a list of videos only as many as that short list.
    spans = videos.select("video_id", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame")) if places is None else places.select("video_id", "frame")
    rest = ["keypoints"] if told is None else list(told)
    return joined_small(spans, persons, ["frame"]).select("video_id", "frame", "person_idx", "track_id", *rest)


#: Court corners (TL, TR, BR, BL) and net points of the calibrated videos, by the video's number modulo 4: both,
#: corners alone, a net alone; the rest have no calibration.
CORNERS = {0: ((400, 46), (880, 48), (1050, 96), (200, 94)), 1: ((360, 44), (920, 44), (1100, 97), (180, 97))}
NETS = {0: ((200, 46), (1080, 56)), 2: ((300, 55), (900, 47))}


def events_calibration(videos: DataFrame) -> DataFrame:
    """(video_id, corners, net) of the videos that have a calibration."""
    k = F.pmod(F.col("video_id").cast("int"), F.lit(4))
    at = lambda p: F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    given = lambda table: F.coalesce(*(F.when(k == n, F.array(*map(at, places))) for n, places in table.items()))
    return videos.filter(k < 3).select("video_id", given(CORNERS).alias("corners"), given(NETS).alias("net"))
