"""Robust peaks of a score series, and the hits that they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config
from trackloom.functions.folds import keep_apart, strongest_apart
from trackloom.functions.series import by_frame, video
from trackloom.functions.sweeps import prominent_maxima, swept

_EVENT = "struct<frame:int,score:double>"


def fences(scores: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(video_id, scored, q1, q3, top, fence): Tukey's upper fence over the non-zero scores; null with
    under 6 of them or without a spread. Videos without a score give no row."""
    own = scores.filter("score > 0").groupBy("video_id").agg(
        F.count("*").alias("scored"), F.percentile("score", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.max("score").alias("top")
    )
    spread = F.col("q")[1] - F.col("q")[0]
    fence = F.when((F.col("scored") >= 6) & (spread > 1e-6), F.col("q")[1] + config.fence_iqr * spread)
    return own.select("video_id", "scored", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), "top", fence.alias("fence"))


def suppressed(scores: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Dense scores with `work` (0 beyond the fence) and `height`, the least height of a peak: the rule of
    `fences` over each video's window, so that the series is read once."""
    scored, beyond = F.when(F.col("score") > 0, F.col("score")), F.col("score") > F.col("fence")
    s = scores.withColumns({"scored": F.count(scored).over(video()), "q": F.percentile(scored, F.array(F.lit(0.25), F.lit(0.75))).over(video())})
    spread = F.col("q")[1] - F.col("q")[0]
    s = s.withColumn("fence", F.when((F.col("scored") >= 6) & (spread > 1e-6), F.col("q")[1] + config.fence_iqr * spread)).filter("scored > 0")
    s = s.withColumn("work", F.when(beyond, 0.0).otherwise(F.col("score")))
    top = F.when(F.max(beyond.cast("int")).over(video()) == 1, F.col("fence")).otherwise(F.max("work").over(video()))
    # Without any score left there is no peak, whatever the fence.
    return s.withColumn("height", F.when(F.max("work").over(video()) > 0, top * config.peak_threshold_ratio)).drop("fence", "q", "scored")


def local_maxima(series: DataFrame, value: str = "work") -> DataFrame:
    """(video_id, frame, value) of strict local maxima of a dense series: a plateau counts once, at its
    middle rounded down, and only if it falls on both sides."""
    v = F.col(value)
    runs = (
        series.withColumn("run", F.sum(F.coalesce((v != F.lag(v).over(by_frame())).cast("int"), F.lit(0))).over(by_frame()))
        .groupBy("video_id", "run").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.first(value).alias(value))
    )
    order = video().orderBy("run")
    sides = runs.withColumns({"before": F.lag(value).over(order), "after": F.lead(value).over(order)})
    return sides.filter((v > F.col("before")) & (v > F.col("after"))).select(
        "video_id", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("frame"), value
    )


def apart(peaks: DataFrame, params: DataFrame) -> DataFrame:
    """Peaks (video_id, frame, score, prominence if there is one), the highest first and of equals the latest,
    dropping those under their video's peak_distance from a kept one."""
    rest = [c for c in ("prominence",) if c in peaks.columns]
    kind = "struct<" + ",".join(["frame:int,score:double", *(f"{c}:double" for c in rest)]) + ">"
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("frame")).alias("f"), *rest)))
    lists = peaks.groupBy("video_id").agg(ordered.alias("events")).join(params.select("video_id", "peak_distance"), "video_id")
    events = F.transform("events", lambda e: F.struct((-e["f"]).alias("frame"), (-e["s"]).alias("score"), *(e[c].alias(c) for c in rest)))
    kept = lists.select("video_id", F.explode(keep_apart(events, F.col("peak_distance"), kind)).alias("e"))
    return kept.select("video_id", "e.*")


def ridges(series: DataFrame, value: str = "work", height: str | None = None) -> DataFrame:
    """(video_id, frame, value, prominence, height) of the strict local maxima of a dense series that is never
    negative: height over the higher of the two lowest values on the way to a higher sample or the series'
    end on each side. A stack takes a video in one pass; `height` is a column that is carried along.

    The windows leave a video's rows together and in order, and the sort says so.
    """
    v = F.col(value)
    s = series.select("video_id", "frame", v.alias("v"), (F.col(height) if height else F.lit(None)).cast("double").alias("height"))
    s = s.withColumns({"before": F.lag("v").over(by_frame()), "after": F.lead("v").over(by_frame())}).filter("v > 0")
    found = swept(s.sortWithinPartitions("video_id", "frame"), prominent_maxima, "video_id string, frame int, v double, prominence double, height double")
    return found.withColumnRenamed("v", value)


def prominences(peaks: DataFrame, series: DataFrame, value: str = "work") -> DataFrame:
    """peaks, local maxima of the series, with their `prominence` in it."""
    return peaks.select("video_id", "frame", "score").join(ridges(series, value).select("video_id", "frame", "prominence"), ["video_id", "frame"])


def strongest(peaks: DataFrame, gap: int = CONFIG.nms_frames) -> DataFrame:
    """Of peaks under `gap` frames apart the stronger one."""
    lists = peaks.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame", "score"))).alias("events"))
    return lists.select("video_id", F.explode(strongest_apart(F.col("events"), gap, _EVENT)).alias("e")).select("video_id", "e.frame", "e.score")


def find_peaks(scores: DataFrame, params: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(video_id, frame, score): fence, local maxima of enough height, distance, prominence, then the stronger of neighbours."""
    return chosen(ridges(suppressed(scores, config), "work", "height").filter("work >= height"), params, config)


def chosen(tall: DataFrame, params: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Of maxima (video_id, frame, work, prominence) those that are far enough apart, prominent, and stronger than their neighbours."""
    far = apart(tall.withColumnRenamed("work", "score"), params)
    return strongest(far.filter(F.col("prominence") >= config.prominence), config.nms_frames)


def candidates(peaks: DataFrame, frames: DataFrame, videos: DataFrame, owner_y: DataFrame) -> DataFrame:
    """Hits: one frame before the peak, owned by the side on which the shuttle is at the peak."""
    h = peaks.join(frames.select("video_id", "frame", "y"), ["video_id", "frame"]).join(owner_y, "video_id").join(videos.select("video_id", "fps"), "video_id")
    owner = F.when(F.col("y") < F.col("owner_y"), "top").otherwise("bottom")
    frame = F.greatest(F.col("frame") - 1, F.lit(0))
    h = h.select("video_id", frame.alias("frame"), (frame / F.col("fps")).alias("time_sec"), "score", owner.alias("owner"), owner.alias("player"))
    return h.withColumns({"hit_number": F.row_number().over(by_frame()), "method": F.lit("peaks")})


def owner_thresholds(videos: DataFrame, calibration: DataFrame | None = None, ratio: float = CONFIG.net_y_ratio) -> DataFrame:
    """(video_id, owner_y): from the corners if given, else from the net's middle, else a share of the height."""
    if calibration is None:
        return videos.select("video_id", (F.col("frame_h") * ratio).alias("owner_y"))
    y = lambda c, i: F.get(F.col(c), F.lit(i))["y"]
    corners = ((y("corners", 0) + y("corners", 1)) / 2 + (y("corners", 2) + y("corners", 3)) / 2) / 2
    net = F.col("frame_h") * ((y("net", 0) + y("net", 1)) / 2 / F.greatest("frame_h", F.lit(1)))
    joined = videos.join(calibration, "video_id", "left")
    return joined.select("video_id", F.coalesce(corners, net, F.col("frame_h") * ratio).alias("owner_y"))
