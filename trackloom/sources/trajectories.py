"""Sources: trajectory CSV files, keypoints, requests; table shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
FRAMES = "video_id string, frame int, x double, y double"
VIDEOS = "video_id string, frame_w int, frame_h int, fps double, n_frames int"
CALIBRATION = f"video_id string, corners array<{POINT}>, net array<{POINT}>"
POSE = "video_id string, frame int, person_idx int, track_id int, keypoints array<struct<x:double,y:double,conf:double>>"
REQUEST = (
    "videoId int, s3Url string, skeletonUploadUrl string, skeletonVideoUrl string, minimapUploadUrl string, minimapVideoUrl string, "
    "courtCorners struct<topLeft:struct<x:int,y:int>,topRight:struct<x:int,y:int>,bottomLeft:struct<x:int,y:int>,"
    "bottomRight:struct<x:int,y:int>,netTopLeft:struct<x:int,y:int>,netTopRight:struct<x:int,y:int>>"
)


def normalised(frames: DataFrame) -> DataFrame:
    """Missing coordinates (null, NaN) become 0, the mark of an undetected frame."""
    zero = lambda c: F.when(F.isnan(c), 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return frames.withColumns({"x": zero("x"), "y": zero("y")})


def read_trajectories(spark: SparkSession, path: str, suffix: str = "_ball.csv") -> DataFrame:
    """CSV files of one video each: header names are trimmed and lower-cased, only x and y count, the
    row's place in its file is the frame. The video is the file's name without the suffix.

    A file's rows are numbered in file order by monotonically_increasing_id: files are read whole
    (a video's table is small), so that an id grows with the place in the file.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False, multiLine=True)
    names = {c.strip().lower(): c for c in raw.columns}
    if not {"x", "y"} <= names.keys():
        raise ValueError("a trajectory file needs the columns x and y")
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = raw.select(
        F.regexp_replace(F.url_decode(file), suffix.replace(".", r"\.") + "$", "").alias("video_id"),
        F.monotonically_increasing_id().alias("at"),
        F.expr(f"try_cast(trim(`{names['x']}`) AS double)").alias("x"),
        F.expr(f"try_cast(trim(`{names['y']}`) AS double)").alias("y"),
    )
    order = Window.partitionBy("video_id").orderBy("at")
    return normalised(rows.select("video_id", (F.row_number().over(order) - 1).alias("frame"), "x", "y"))


def extract_keypoints(detections: DataFrame) -> DataFrame:
    """(video_id, frame, persons array<struct<track_id, keypoints>>) -> one row per person; a missing
    track id becomes -(place + 1). Frames without persons give no row."""
    rows = detections.select("video_id", "frame", F.posexplode("persons").alias("person_idx", "p"))
    return rows.select(
        "video_id", "frame", "person_idx",
        F.coalesce(F.col("p.track_id"), -(F.col("person_idx") + 1)).cast("int").alias("track_id"),
        F.col("p.keypoints").alias("keypoints"),
    )


def parse_requests(lines: DataFrame) -> DataFrame:
    """(value string of JSON) -> request columns; missing URLs are empty strings."""
    r = lines.select(F.from_json("value", REQUEST).alias("r")).select("r.*")
    urls = [f.name for f in T._parse_datatype_string(REQUEST).fields if f.name.endswith("Url") and f.name != "s3Url"]
    return r.fillna("", urls)


def calibration_of(requests: DataFrame) -> DataFrame:
    """Corners in the order TL, TR, BR, BL; a net only if both of its points are given."""
    at = lambda name: F.struct(F.col(f"courtCorners.{name}.x").cast("double").alias("x"), F.col(f"courtCorners.{name}.y").cast("double").alias("y"))
    both = F.col("courtCorners.netTopLeft").isNotNull() & F.col("courtCorners.netTopRight").isNotNull()
    return requests.select(
        F.col("videoId").cast("string").alias("video_id"),
        F.when(F.col("courtCorners").isNotNull(), F.array(*map(at, ("topLeft", "topRight", "bottomRight", "bottomLeft")))).alias("corners"),
        F.when(both, F.array(at("netTopLeft"), at("netTopRight"))).alias("net"),
    )
