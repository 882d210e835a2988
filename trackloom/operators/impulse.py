"""Impulse scores: how sharply the shuttle turns at a point, after the filters that rule flight out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config
from trackloom.functions.intervals import inside
from trackloom.functions.series import by_frame, angle, distance, numbered
from trackloom.operators.cleaning import percentile_by_rank

#: The filters, in the order in which they are tried; a point's `dropped` names the first that it fails.
FILTERS = ("gap", "speed", "skip", "future", "flight", "floor", "apex")


def judged_points(cleaned: DataFrame, params: DataFrame, wrists: DataFrame | None = None, config: Config = CONFIG) -> DataFrame:
    """Cleaned points with two neighbours on each side: `impulse`, and `dropped` (null if it is scored).

    wrists(video_id, frame, wx, wy) lifts the floor filter where a wrist is within reach.
    """
    whole = by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = neighbours(numbered(cleaned.select("video_id", "frame", "x", "y"))).withColumns({"x_end": F.last("x").over(whole), "y_end": F.last("y").over(whole)})
    p = p.join(params, "video_id").join(percentile_by_rank(cleaned.join(params.select("video_id", "floor_pct"), "video_id"), "y", "floor_pct"), "video_id")
    return judged_neighbours(p, cleaned, wrists, config)


def neighbours(points: DataFrame) -> DataFrame:
    """points with the frame and place of the second point before and after each."""
    at = lambda name, j: F.lead(name, j).over(by_frame()) if j > 0 else F.lag(name, -j).over(by_frame())
    return points.withColumns({f"{name}_{tag}": at(name, j) for name in ("frame", "x", "y") for tag, j in (("pre", -2), ("post", 2))})


def turns(p: DataFrame, config: Config = CONFIG) -> DataFrame:
    """neighbours' rows with k, n, the video's last point (x_end, y_end), its parameters and `limit` -> those with two
    neighbours on each side, with `impulse`, `early` (the first filter before the floor's that drops one) and `apex`."""
    c = config
    p = p.filter("k >= 2 AND k < n - 2").withColumns({"dt_in": F.col("frame") - F.col("frame_pre"), "dt_out": F.col("frame_post") - F.col("frame")})
    for axis in ("x", "y"):
        p = p.withColumns({
            f"in_{axis}": (F.col(axis) - F.col(f"{axis}_pre")) / F.col("dt_in"),
            f"out_{axis}": (F.col(f"{axis}_post") - F.col(axis)) / F.col("dt_out"),
            f"skip_{axis}": F.col(f"{axis}_post") - F.col(f"{axis}_pre"),
        })
    norm = lambda v: F.sqrt(F.col(f"{v}_x") * F.col(f"{v}_x") + F.col(f"{v}_y") * F.col(f"{v}_y"))
    p = p.withColumns({"speed_in": norm("in"), "speed_out": norm("out"), "norm_skip": norm("skip")})
    turn = angle(*(F.col(v) for v in ("in_x", "in_y", "skip_x", "skip_y", "speed_in", "norm_skip")))
    straight = (F.col("norm_skip") > 1e-6) & (F.col("speed_in") > 1e-6) & (turn < F.col("skip_angle"))
    impulse = distance(F.col("in_x"), F.col("in_y"), F.col("out_x"), F.col("out_y"))
    early = (
        F.when((F.col("dt_in") > F.col("max_frame_gap")) | (F.col("dt_out") > F.col("max_frame_gap")), "gap")
        .when((F.col("speed_in") < F.col("min_speed")) & (F.col("speed_out") < F.col("min_speed")), "speed")
        .when(straight, "skip")
        .when(F.col("n") - 1 - F.col("k") < 3, "future")
        .when(distance(F.col("x"), F.col("y"), F.col("x_end"), F.col("y_end")) < F.col("min_flight"), "flight")
    )
    return p.withColumns({
        "early": early,
        "apex": (F.col("in_y") < -c.apex_up) & (F.col("out_y") > c.apex_down) & (F.abs(F.col("out_x") - F.col("in_x")) < c.apex_horizontal),
        "impulse": F.when(F.col("out_y") - F.col("in_y") > c.downward_turn, impulse * c.downward_bonus).otherwise(impulse),
    })


def floored(low: DataFrame, cleaned: DataFrame) -> DataFrame:
    """low(video_id, frame, y, near_future, min_floor_drop), the few points near the floor, which look ahead as far as
    their video says -> (video_id, frame, floor) of those that have points ahead: `floor` if none of them is high enough."""
    low = low.select("video_id", F.col("frame").alias("at"), F.col("y").alias("low_y"), "near_future", "min_floor_drop")
    ahead = inside(cleaned.select("video_id", "frame", "y"), low, F.col("at") + 1, F.col("at") + F.col("near_future"))
    return ahead.groupBy("video_id", "at").agg((F.min("y") > F.first("low_y") - F.first("min_floor_drop")).alias("floor")).withColumnRenamed("at", "frame")


def judged_neighbours(p: DataFrame, cleaned: DataFrame, wrists: DataFrame | None = None, config: Config = CONFIG) -> DataFrame:
    """judged_points from what `turns` takes."""
    p = turns(p, config)
    low = p.filter("early IS NULL AND y > limit").select("video_id", "frame", "x", "y", "near_future", "min_floor_drop")
    if wrists is not None:
        near = low.join(wrists, ["video_id", "frame"]).filter(distance(F.col("wx"), F.col("wy"), F.col("x"), F.col("y")) < config.wrist_floor_bypass)
        low = low.join(near.select("video_id", "frame"), ["video_id", "frame"], "left_anti")
    p = p.join(floored(low, cleaned), ["video_id", "frame"], "left")
    dropped = F.coalesce(F.col("early"), F.when(F.col("floor"), "floor"), F.when(F.col("apex"), "apex"))
    return p.select("video_id", "frame", "x", "y", "impulse", dropped.alias("dropped"))


def impulse_scores(frames: DataFrame, judged: DataFrame) -> DataFrame:
    """Dense (video_id, frame, score): 0 where a frame isn't scored."""
    kept = judged.filter("dropped IS NULL").select("video_id", "frame", F.col("impulse").alias("score"))
    return frames.select("video_id", "frame").join(kept, ["video_id", "frame"], "left").fillna(0.0, ["score"])
