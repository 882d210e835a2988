"""Net crossings, net faults, and what crossings say about who hit."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config
from trackloom.functions.folds import after_cooldown
from trackloom.functions.series import by_frame
from trackloom.functions.sweeps import claims, swept

_CROSSING = "struct<trigger:int,frame:int,direction:string,cross_x:double,clearance:double>"


def side_changes(frames: DataFrame, nets: DataFrame) -> DataFrame:
    """Every change of the net's side between valid frames, interpolated.

    nets(video_id, slope, intercept). `trigger` is the frame that shows the change, `frame` the
    rounded (half to even) place of the crossing itself; a path along the net crosses half-way.
    """
    p = frames.filter("NOT isnan(x) AND NOT isnan(y) AND x > 0 AND y > 0 AND x < double('infinity') AND y < double('infinity')").join(nets, "video_id")
    p = p.withColumn("net", F.col("slope") * F.col("x") + F.col("intercept")).withColumn("above", F.col("y") < F.col("net"))
    p = p.withColumns({f"{c}0": F.lag(c).over(by_frame()) for c in ("frame", "x", "y", "net", "above")}).filter("above <> above0")
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    fall = dy - F.col("slope") * dx
    t = F.when(F.abs(fall) < 1e-6, 0.5).otherwise(F.try_divide(F.col("net0") - F.col("y0"), fall))
    p = p.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    cross_x = F.col("x0") + F.col("t") * dx
    return p.select(
        "video_id", F.col("frame").alias("trigger"),
        F.bround(F.col("frame0") + F.col("t") * (F.col("frame") - F.col("frame0"))).cast("int").alias("frame"),
        F.when(F.col("above0"), "top_to_bottom").otherwise("bottom_to_top").alias("direction"),
        cross_x.alias("cross_x"),
        (F.col("slope") * cross_x + F.col("intercept") - (F.col("y0") + F.col("t") * dy)).alias("clearance"),
    )


def net_crossings(frames: DataFrame, videos: DataFrame, nets: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Crossings with their time, sides and fault mark, without those within the cooldown of the one before.

    The clearance is 0 up to rounding, as a crossing is where the path meets the net, so a fault
    never occurs; the rule stands as it is stated.
    """
    lists = side_changes(frames, nets).groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("trigger", "frame", "direction", "cross_x", "clearance"))).alias("events")
    )
    c = lists.select("video_id", F.explode(after_cooldown(F.col("events"), config.cooldown, _CROSSING)).alias("e")).select("video_id", "e.*")
    down = F.col("direction") == "top_to_bottom"
    return c.join(videos.select("video_id", "fps"), "video_id").select(
        "video_id", "frame", "trigger", (F.col("frame") / F.col("fps")).alias("time_sec"), "direction",
        F.when(down, "top").otherwise("bottom").alias("hitter_side"), F.when(down, "bottom").otherwise("top").alias("receiver_side"),
        (F.col("clearance") < -config.fault_tolerance).alias("is_fault"), F.col("clearance").alias("clearance_px"), "cross_x",
    )


def net_faults(crossings: DataFrame, frames: DataFrame, nets: DataFrame, net_centers: DataFrame) -> DataFrame:
    """Fault rows of the crossings that are faults: at the net's middle, with the shuttle's height at the frame."""
    f = crossings.filter("is_fault").join(frames.select("video_id", "frame", "y"), ["video_id", "frame"]).join(nets, "video_id").join(net_centers, "video_id")
    return f.select(
        "video_id", "frame", "time_sec", F.col("center_x").alias("crossing_x"), F.col("y").alias("shuttle_y"),
        (F.col("slope") * F.col("center_x") + F.col("intercept")).alias("net_top_y_at_x"), "clearance_px",
    )


def apply_crossing_owners(hits: DataFrame, crossings: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Crossings in order each claim the nearest unclaimed hit before them for the hitter's side; then
    each the first unclaimed hit after them for the receiver's. Claimed hits become `peaks_crossed`."""
    side = lambda c: F.col(c) if c in crossings.columns else F.lit(None)
    seekers = crossings.select("video_id", "frame", "hitter_side", "receiver_side", side("trigger").cast("int").alias("trigger"), F.lit(0).alias("kind"))
    none = F.lit(None).cast("string")
    sought = hits.select("video_id", "frame", none.alias("hitter_side"), none.alias("receiver_side"), F.lit(None).cast("int").alias("trigger"), F.lit(1).alias("kind"))
    # The window asks for a video's rows together and in order, and so the sweep has them.
    order = ["frame", "kind", "trigger", "hitter_side"]
    wait = F.col("frame") - F.lag("frame").over(Window.partitionBy("video_id").orderBy(*order))
    events = seekers.unionByName(sought).withColumn("wait", wait)
    found = swept(events.sortWithinPartitions("video_id", *order), partial(claims, config.crossing_lookback), "video_id string, frame int, side string")
    claimed = hits.join(found, ["video_id", "frame"], "left")
    got = F.col("side").isNotNull()
    return claimed.withColumns({
        "owner": F.coalesce("side", "owner"),
        "player": F.when(got, F.when(F.col("side") == "top", "pink_top").otherwise("green_bottom")).otherwise(F.col("player")),
        "method": F.when(got, "peaks_crossed").otherwise(F.col("method")),
    }).drop("side")
