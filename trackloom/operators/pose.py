"""Pose joins: which frames need poses, the wrist nearest to a hit, owners by pose, rescued hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config
from trackloom.functions.folds import keep_apart
from trackloom.functions.intervals import inside
from trackloom.functions.series import by_frame, distance
from trackloom.operators.peaks import fences

# Places of COCO-17 key points, from 0.
WRISTS, ANKLES, KNEES, HIPS, UPPER = (9, 10), (15, 16), (13, 14), (11, 12), (0, 5, 6, 7, 8, 9, 10)


def point(i: int) -> Column:
    return F.get("keypoints", F.lit(i))


def wanted_frames(targets: DataFrame, videos: DataFrame, radius: int = 2) -> DataFrame:
    """(video_id, frame): the frames within `radius` of targets(video_id, frame), inside the video, each once."""
    near = targets.join(videos.select("video_id", "n_frames"), "video_id").select(
        "video_id", "n_frames", F.explode(F.sequence(F.col("frame") - radius, F.col("frame") + radius)).alias("frame")
    )
    return near.filter("frame >= 0 AND frame < n_frames").select("video_id", "frame").distinct()


def pose_window(pose: DataFrame, targets: DataFrame, videos: DataFrame, radius: int = 2) -> DataFrame:
    """The pose rows within `radius` frames of targets(video_id, frame), inside the video: a semi-join."""
    return pose.join(wanted_frames(targets, videos, radius), ["video_id", "frame"], "left_semi")


def wrist_points(pose: DataFrame, conf: float = CONFIG.foot_conf) -> DataFrame:
    """(video_id, frame, wx, wy) of confident wrists; what lifts the floor filter."""
    rows = pose.filter(F.size("keypoints") >= 11).select("video_id", "frame", F.explode(F.array(*(point(i) for i in WRISTS))).alias("p"))
    return rows.filter((F.col("p.conf") >= conf) & (F.col("p.x") > 0) & (F.col("p.y") > 0)).select(
        "video_id", "frame", F.col("p.x").alias("wx"), F.col("p.y").alias("wy")
    )


def _median_y(points: Column) -> Column:
    """Median height of an array of points; null for none."""
    ys = F.sort_array(F.transform(points, lambda p: p["y"]))
    n = F.size(ys)
    return F.when(n > 0, (F.get(ys, ((n - 1) / 2).cast("int")) + F.get(ys, (n / 2).cast("int"))) / 2)


def _sure(which: tuple[int, ...] | None, conf: float) -> Column:
    pts = F.col("keypoints") if which is None else F.array(*(point(i) for i in which))
    return F.filter(pts, lambda p: (p["conf"] >= conf) & (p["y"] > 0))


def _pair_y(which: tuple[int, int], conf: float) -> Column:
    """The same of two points: the mean of the sure ones."""
    sure = [F.when((point(i)["conf"] >= conf) & (point(i)["y"] > 0), point(i)["y"]) for i in which]
    return F.coalesce((sure[0] + sure[1]) / 2, *sure)


def body_center_y(conf: float = CONFIG.wrist_conf) -> Column:
    """Median height of the first of ankles, knees, hips, upper body, all points that has a sure one."""
    return F.coalesce(*(_pair_y(w, conf) for w in (ANKLES, KNEES, HIPS)), *(_median_y(_sure(w, conf)) for w in (UPPER, None)))


def rescue_center_y(conf: float = CONFIG.wrist_conf) -> Column:
    """Middle of the hips if both are sure, else the median of the upper body, else of all points."""
    both = (point(HIPS[0])["conf"] >= conf) & (point(HIPS[1])["conf"] >= conf)
    middle = F.when(both, (point(HIPS[0])["y"] + point(HIPS[1])["y"]) / 2)
    return F.coalesce(middle, _median_y(_sure(UPPER, conf)), _median_y(_sure(None, conf)))


def foot_center(conf: float = CONFIG.foot_conf) -> Column:
    """struct<x, y>: the ankles' middle if both are seen, else the seen one, else (0, 0)."""
    l, r = point(ANKLES[0]), point(ANKLES[1])
    seen = lambda p: (p["conf"] >= conf) & (p["x"] > 0) & (p["y"] > 0)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return (
        F.when(seen(l) & seen(r), at((l["x"] + r["x"]) / 2, (l["y"] + r["y"]) / 2))
        .when(seen(l), at(l["x"], l["y"])).when(seen(r), at(r["x"], r["y"])).otherwise(at(F.lit(0.0), F.lit(0.0)))
    )


def _wrists_with_center(pose: DataFrame, center: Column, conf: float) -> DataFrame:
    rows = pose.filter(F.size("keypoints") >= 17).select(
        "video_id", "frame", "person_idx", center.alias("center_y"), F.posexplode(F.array(*(point(i) for i in WRISTS))).alias("wrist_idx", "w")
    )
    return rows.filter((F.col("w.conf") >= conf) & (F.col("w.x") > 0) & F.col("center_y").isNotNull())


def nearest_wrists(hits: DataFrame, frames: DataFrame, pose: DataFrame, videos: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(video_id, frame, dist, center_y) of hits with a wrist within reach.

    The hit's own frame counts if it has persons, and then ends the matter if its shuttle is not
    seen; else the first of +1, -1, +2, -2 that has persons and a shuttle.
    """
    order = F.create_map(*(F.lit(v) for pair in ((0, 0), (1, 1), (-1, 2), (2, 3), (-2, 4)) for v in pair))
    probe = hits.select("video_id", F.col("frame").alias("hit"), F.explode(F.sequence(F.col("frame") - 2, F.col("frame") + 2)).alias("frame"))
    probe = probe.join(pose.select("video_id", "frame").distinct(), ["video_id", "frame"])
    probe = probe.join(videos.select("video_id", "n_frames"), "video_id").withColumn("at", F.least(F.col("frame"), F.col("n_frames") - 1))
    shuttle = frames.select("video_id", F.col("frame").alias("at"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    probe = probe.join(shuttle, ["video_id", "at"])
    probe = probe.withColumn("turn", order[F.col("frame") - F.col("hit")]).withColumn("seen", (F.col("sx") > 0) & (F.col("sy") > 0))
    chosen = probe.filter("turn = 0 OR seen").groupBy("video_id", "hit").agg(F.min_by(F.struct("frame", "sx", "sy", "seen"), "turn").alias("c"))
    chosen = chosen.filter("c.seen").select("video_id", "hit", "c.frame", "c.sx", "c.sy")
    near = chosen.join(_wrists_with_center(pose, body_center_y(config.wrist_conf), config.wrist_conf), ["video_id", "frame"])
    near = near.withColumn("dist", distance(F.col("w.x"), F.col("w.y"), F.col("sx"), F.col("sy")))
    best = near.groupBy("video_id", "hit").agg(F.min_by(F.struct("dist", "center_y"), F.struct("dist", "person_idx", "wrist_idx")).alias("b"))
    return best.filter(F.col("b.dist") <= config.wrist_reach).select("video_id", F.col("hit").alias("frame"), "b.dist", "b.center_y")


def apply_pose_owners(hits: DataFrame, wrists: DataFrame, owner_y: DataFrame) -> DataFrame:
    """Hits whose nearest player stands on the other side change owner; their method gets `_pose`."""
    h = hits.join(wrists.select("video_id", "frame", "center_y"), ["video_id", "frame"], "left").join(owner_y, "video_id")
    side = F.when(F.col("center_y") < F.col("owner_y"), "top").when(F.col("center_y").isNotNull(), "bottom")
    h = h.withColumn("side", side).withColumn("change", F.coalesce(F.col("side") != F.col("owner"), F.lit(False)))
    return h.withColumns({
        "owner": F.when(F.col("change"), F.col("side")).otherwise(F.col("owner")),
        "player": F.when(F.col("change"), F.when(F.col("side") == "top", "pink_top").otherwise("green_bottom")).otherwise(F.col("player")),
        "method": F.when(F.col("change"), F.concat("method", F.lit("_pose"))).otherwise(F.col("method")),
    }).drop("center_y", "owner_y", "side", "change")


def near_misses(scores: DataFrame, hits: DataFrame, params: DataFrame, band: tuple[float, float] = CONFIG.near_miss, config: Config = CONFIG) -> DataFrame:
    """(video_id, frame, score) scored within a band of the reference height, away from all hits."""
    ref = fences(scores, config).select("video_id", F.coalesce("fence", "top").alias("ref"))
    s = scores.filter("score > 0").join(ref, "video_id")
    s = s.filter((F.col("score") >= F.col("ref") * band[0]) & (F.col("score") < F.col("ref") * band[1])).select("video_id", "frame", "score")
    # A hit blocks its own frame and the next one.
    taken = hits.select("video_id", F.col("frame").alias("hit")).join(params.select("video_id", "peak_distance"), "video_id")
    reach = F.col("peak_distance") + 3
    return inside(s, taken, F.col("hit") - reach, F.col("hit") + 1 + reach, "left_anti")


def rescue_hits(
    hits: DataFrame, scores: DataFrame, params: DataFrame, frames: DataFrame, pose: DataFrame, videos: DataFrame, owner_y: DataFrame,
    config: Config = CONFIG,
) -> DataFrame:
    """hits with near misses added where a wrist is within reach in the two frames around, in order of
    frame and not near another added one; numbered anew."""
    misses = near_misses(scores, hits, params, config.rescue_band, config)
    probe = misses.select("video_id", F.col("frame").alias("miss"), F.posexplode(F.sequence(F.col("frame") - 2, F.col("frame") + 2)).alias("turn", "frame"))
    probe = probe.join(videos.select("video_id", "n_frames"), "video_id").withColumn("at", F.least(F.col("frame"), F.col("n_frames") - 1))
    shuttle = frames.filter("x > 0 AND y > 0").select("video_id", F.col("frame").alias("at"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    near = probe.join(shuttle, ["video_id", "at"]).join(_wrists_with_center(pose, rescue_center_y(config.wrist_conf), config.wrist_conf), ["video_id", "frame"])
    near = near.withColumn("dist", distance(F.col("w.x"), F.col("w.y"), F.col("sx"), F.col("sy")))
    best = near.groupBy("video_id", "miss").agg(F.min_by(F.struct("dist", "center_y"), F.struct("dist", "turn", "person_idx", "wrist_idx")).alias("b"))
    best = best.filter(F.col("b.dist") <= config.rescue_reach).select("video_id", F.col("miss").alias("frame"), "b.center_y")
    found = best.join(misses, ["video_id", "frame"]).join(params.select("video_id", "peak_distance"), "video_id")
    # A kept miss blocks its own frame and the next one: apart means over peak_distance + 4 frames.
    lists = found.groupBy("video_id", "peak_distance").agg(F.array_sort(F.collect_list(F.struct("frame", "score", "center_y"))).alias("events"))
    kept = lists.select("video_id", F.explode(keep_apart(F.col("events"), F.col("peak_distance") + 5, "struct<frame:int,score:double,center_y:double>")).alias("e"))
    kept = kept.select("video_id", "e.*").join(owner_y, "video_id").join(videos.select("video_id", "fps"), "video_id")
    top = F.col("center_y") < F.col("owner_y")
    new = kept.select(
        "video_id", "frame", (F.col("frame") / F.col("fps")).alias("time_sec"), "score", F.when(top, "top").otherwise("bottom").alias("owner"),
        F.when(top, "pink_top").otherwise("green_bottom").alias("player"), F.lit(0).alias("hit_number"), F.lit("rescue_pose").alias("method"),
    )
    return hits.unionByName(new).withColumn("hit_number", F.row_number().over(by_frame()))
