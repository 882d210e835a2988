"""Rallies: sessions of hits, alternating owners, where the shuttle lands and what that means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config
from trackloom.functions.geometry import drop_place, drop_verdict, half_distances, project_pixel
from trackloom.functions.intervals import inside
from trackloom.functions.series import by_frame, angle, distance


def rallies(hits: DataFrame, videos: DataFrame, config: Config = CONFIG) -> DataFrame:
    """hits with `rally` (from 1): a new one after more than rally_gap_sec without a hit."""
    h = hits.join(videos.select("video_id", "fps"), "video_id")
    wait = (F.col("frame") - F.lag("frame").over(by_frame())) / F.greatest("fps", F.lit(1.0))
    fresh = F.coalesce((wait > config.rally_gap_sec).cast("int"), F.lit(0))
    return h.withColumn("rally", (F.sum(fresh).over(by_frame()) + 1).cast("int")).drop("fps")


def alternate_owners(rallied: DataFrame) -> DataFrame:
    """The first hit of a rally keeps its owner, the others alternate; the player is the owner.

    An owner other than top or bottom on a first hit is undecided and must have been set by the
    shuttle's side before."""
    order = Window.partitionBy("video_id", "rally").orderBy("frame")
    odd = F.row_number().over(order) % 2 == 1
    first = F.first("owner").over(order)
    owner = F.when(odd, first).when(first == "top", "bottom").otherwise("top")
    return rallied.withColumn("owner", owner).withColumn("player", F.col("owner"))


def last_hits(rallied: DataFrame) -> DataFrame:
    """The last hit of each rally."""
    after = F.lead("rally").over(by_frame())
    return rallied.withColumn("after", after).filter("after IS NULL OR after <> rally").drop("after")


def landings(last: DataFrame, points: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, rally, frame, sx, sy, last_hit_number, last_hit_owner): where the shuttle comes down.

    Valid points from max(3, fps/10) frames to 5 seconds after the last hit; three points before and
    after, the first turn of over 80 degrees that slows down to under 0.7, carried on to the end of
    its run within 5 points. Without a turn, or under 7 points: the point before the first gap of
    over 4 frames, else the last point. No point, no landing.
    """
    v = videos.select("video_id", "fps", "n_frames")
    h = last.join(v, "video_id").select(
        "video_id", "rally", F.col("frame").alias("hit"), F.col("hit_number").alias("last_hit_number"), F.col("owner").alias("last_hit_owner"),
        (F.col("frame") + F.greatest(F.lit(3), (F.col("fps") * 0.1).cast("int"))).alias("lo"),
        F.least(F.col("frame") + (F.col("fps") * 5).cast("int"), F.col("n_frames")).alias("hi"),
    )
    p = inside(points.select("video_id", "frame", "x", "y"), h, F.col("lo"), F.col("hi") - 1)
    rally = Window.partitionBy("video_id", "rally")
    order = rally.orderBy("frame")
    at = lambda c, j: F.lead(c, j).over(order) if j > 0 else F.lag(c, -j).over(order)
    p = p.withColumns({"i": F.row_number().over(order) - 1, "m": F.count("*").over(rally).cast("int")})
    pace = lambda axis, one, two: (at(axis, two) - at(axis, one)) / F.greatest(at("frame", two) - at("frame", one), F.lit(1))
    p = p.withColumns({"bx": pace("x", -3, -1), "by": pace("y", -3, -1), "ax": pace("x", 1, 3), "ay": pace("y", 1, 3), "gap": at("frame", 1) - F.col("frame")})
    zero = F.lit(0.0)
    p = p.withColumns({"before": distance(zero, zero, F.col("bx"), F.col("by")), "after": distance(zero, zero, F.col("ax"), F.col("ay"))})
    turn = F.coalesce(angle(*(F.col(c) for c in ("bx", "by", "ax", "ay", "before", "after"))), F.lit(90.0))
    down = (F.col("i") >= 3) & (F.col("i") < F.col("m") - 3) & (F.col("m") >= 7) & (F.col("before") >= 1e-6) & (turn > 80) & (F.col("after") < 0.7 * F.col("before"))
    p = p.withColumn("down", F.coalesce(down, F.lit(False)))
    p = p.withColumn("first", F.min(F.when(F.col("down"), F.col("i"))).over(rally))
    stop = F.min(F.when(~F.col("down") & (F.col("i") > F.col("first")), F.col("i"))).over(rally)
    p = p.withColumn("pick", F.least(stop - 1, F.col("first") + 5))
    broken = F.min(F.when(F.col("gap") > 4, F.col("i"))).over(rally)
    p = p.withColumn("pick", F.coalesce("pick", broken, F.col("m") - 1)).filter("i = pick")
    return p.select("video_id", "rally", "frame", F.col("x").alias("sx"), F.col("y").alias("sy"), "last_hit_number", "last_hit_owner")


def judge_drops(drops: DataFrame, maps: DataFrame) -> DataFrame:
    """drops with the verdict: maps(video_id, to_minimap, to_court, minimap_pts, net_y_minimap).

    `rally_idx` counts a video's drops from 1. mx, my are the whole pixels that the verdict reads."""
    d = drops.join(maps.select("video_id", "to_minimap", "to_court", "minimap_pts", "net_y_minimap"), "video_id")
    mx, my = project_pixel(F.col("to_minimap"), F.col("sx"), F.col("sy"), precise=True)
    d = d.withColumns({"mx": mx, "my": my, "rally_idx": F.row_number().over(Window.partitionBy("video_id").orderBy("rally"))})
    pts, net, at = F.col("minimap_pts"), F.col("net_y_minimap"), (F.col("mx"), F.col("my"))
    d = d.withColumns(drop_place(pts, F.col("to_court"), net, *at))
    d = d.withColumns(half_distances(pts, net, F.col("net_left"), F.col("net_right"), *at))
    d = d.withColumns(drop_verdict(F.col("court_x"), F.col("court_y"), F.col("top_distance"), F.col("bottom_distance")))
    d = d.drop("net_left", "net_right", "top_distance", "bottom_distance")
    shown = F.bround(F.round("margin_cm", 6), 1)  # noise of the arithmetic decides no tie
    away = F.abs(shown)
    # The published texts.
    text = F.when(shown >= 0, F.format_string("%s까지 약 %.1fcm", "nearest_line", away)).otherwise(
        F.format_string("%s 밖 약 %.1fcm", "nearest_line", away)
    )
    return d.withColumns({"is_in": F.col("location") != "out", "verdict": text}).drop("to_minimap", "to_court", "minimap_pts", "net_y_minimap")


def drop_marks(frames: DataFrame, drops: DataFrame, rallied: DataFrame) -> DataFrame:
    """(video_id, frame, rally_idx): which drop is shown at a frame, from its own frame up to the next
    rally's first hit, or the video's end; of overlapping marks the later drop's.

    drops(video_id, frame, rally_idx)."""
    starts = rallied.filter("rally > 1").groupBy("video_id", "rally").agg(F.min("frame").alias("frame"))
    marks = drops.select("video_id", "frame", "rally_idx", F.lit(None).cast("int").alias("start"))
    events = marks.unionByName(starts.select("video_id", "frame", F.lit(None).cast("int").alias("rally_idx"), F.col("frame").alias("start")))
    # At one frame a start comes before a drop: the next start is a later frame's.
    after = Window.partitionBy("video_id").orderBy(F.desc("frame"), F.desc_nulls_last("rally_idx"))
    spans = events.withColumn("until", F.last("start", True).over(after.rowsBetween(Window.unboundedPreceding, -1))).filter("rally_idx IS NOT NULL").withColumnRenamed("frame", "from")
    dense = frames.select("video_id", "frame")
    last = dense.groupBy("video_id").agg(F.max("frame").alias("last"))
    spans = spans.join(last, "video_id").select("video_id", "from", "rally_idx", F.coalesce(F.col("until") - 1, F.col("last")).alias("to"))
    shown = inside(dense, spans, F.col("from"), F.col("to"))
    return shown.groupBy("video_id", "frame").agg(F.max("rally_idx").alias("rally_idx"))
