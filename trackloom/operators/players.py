"""Players on the court views: selection, ghosts, trails, markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG, COURT_X, END_FAR, END_NEAR, NET_Y, SINGLES_LEFT, SINGLES_RIGHT, Config
from trackloom.functions.geometry import homography, points, project, project_pixel, quad_of, signed_distance, single
from trackloom.functions.series import by_frame, where
from trackloom.functions.stages import keep
from trackloom.operators.pose import foot_center


def _side():
    return Window.partitionBy("video_id", "side").orderBy("frame")


def minimap_players(pose: DataFrame, maps: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(video_id, frame, side, mx, my): per frame and side of the net the person on the court, within
    a margin, who is nearest to the middle; the first of equals."""
    p = pose.filter(F.size("keypoints") >= 17).withColumn("foot", foot_center(config.foot_conf)).filter("foot.x > 0 AND foot.y > 0")
    p = p.select("video_id", "frame", "person_idx", "foot").join(maps.select("video_id", "to_minimap", "minimap_pts", "net_y_minimap"), "video_id")
    mx, my = project_pixel(F.col("to_minimap"), F.col("foot.x"), F.col("foot.y"), precise=True)
    away = signed_distance(F.col("mx").cast("double"), F.col("my").cast("double"), quad_of(F.col("minimap_pts")))
    p = where(p.withColumns({"mx": mx, "my": my}), away >= -config.court_margin).withColumn("side", F.when(F.col("my") < F.col("net_y_minimap"), "top").otherwise("bottom"))
    first = F.min_by(F.struct("mx", "my"), F.struct(F.abs(F.col("mx") - config.minimap_w / 2), "person_idx"))
    return p.groupBy("video_id", "frame", "side").agg(first.alias("p")).select("video_id", "frame", "side", "p.mx", "p.my")


def court_players(pose: DataFrame, maps: DataFrame, videos: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(video_id, frame, side, person_idx, tx, ty): one player a side in the shifted view, before ghosts.

    Persons on the court (edges included) are split at the net's height `view_net_y`; two or more on
    one side are split by height, so that the other side gets one. The highest is top, the lowest bottom.
    """
    p = pose.filter(F.size("keypoints") >= 17).withColumn("foot", foot_center(config.foot_conf)).filter("foot.x > 0 AND foot.y > 0")
    p = p.select("video_id", "frame", "person_idx", "foot").join(maps.select("video_id", "src_pts", "to_view", "view_net_y"), "video_id")
    away = signed_distance(F.col("foot.x"), F.col("foot.y"), quad_of(F.col("src_pts")))
    tx, ty = project_pixel(F.col("to_view"), F.col("foot.x"), F.col("foot.y"))
    p = where(p, away >= 0).withColumns({"tx": tx, "ty": ty})
    p = p.withColumn("above", F.col("ty") < F.col("view_net_y"))
    who = F.struct("person_idx", "tx", "ty")
    lowest_key = F.struct("ty", -F.col("person_idx"))
    late_key = F.struct("ty", "person_idx")
    g = p.groupBy("video_id", "frame").agg(
        F.count("*").alias("n"), F.count_if("above").alias("up"),
        F.min_by(who, F.struct("ty", "person_idx")).alias("highest"),
        F.min_by(F.when(F.col("above"), who), F.when(F.col("above"), F.struct("ty", "person_idx"))).alias("top"),
        F.max_by(F.when(~F.col("above"), who), F.when(~F.col("above"), lowest_key)).alias("bottom"),
        F.max_by(who, lowest_key).alias("lowest"), F.max_by(who, late_key).alias("last"),
        F.sort_array(F.collect_list(F.struct("ty", "person_idx", "tx"))).alias("by_y"),
    )
    rest = F.slice("by_y", 2, F.greatest(F.col("n") - 1, F.lit(1)).cast("int"))
    forced = F.array_max(F.transform(rest, lambda q: F.struct(q["ty"].alias("ty"), (-q["person_idx"]).alias("o"), q["tx"].alias("tx"))))
    forced = F.struct((-forced["o"]).cast("int").alias("person_idx"), forced["tx"].alias("tx"), forced["ty"].alias("ty"))
    top = F.when((F.col("n") >= 2) & (F.col("up") == 0), F.col("highest")).when((F.col("n") >= 2) & (F.col("up") == F.col("n")), F.col("highest")).otherwise(F.col("top"))
    bottom = F.when((F.col("n") >= 2) & (F.col("up") == 0), forced).when((F.col("n") >= 2) & (F.col("up") == F.col("n")), F.col("last")).otherwise(F.col("bottom"))
    sides = g.select("video_id", "frame", F.explode(F.map_from_arrays(F.array(F.lit("top"), F.lit("bottom")), F.array(top, bottom))).alias("side", "p"))
    return sides.filter("p IS NOT NULL").select("video_id", "frame", "side", "p.person_idx", "p.tx", "p.ty")


def ghosts(frames: DataFrame, players: DataFrame, value: str, hold: int = CONFIG.ghost) -> DataFrame:
    """Dense (video_id, frame, side, value): the last value seen, for at most `hold` frames without one."""
    dense = frames.select("video_id", "frame", F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("side"))
    seen = dense.join(players.select("video_id", "frame", "side", value), ["video_id", "frame", "side"], "left")
    return seen.withColumn(value, F.last(value, True).over(_side().rowsBetween(-hold, 0)))


def player_trails(players: DataFrame, length: int = CONFIG.trail) -> DataFrame:
    """players with `trail`: the last `length` detections of the side, this one last."""
    # Detections in lots of `length`: a trail is the end of the lot before and the lot's own up to its place, so that a
    # list is gathered once a lot and not once a row.
    k = F.row_number().over(_side()) - 1
    lots = players.withColumns({"lot": F.floor(k / length), "at": (k % length + 1).cast("int")})
    rest = [c for c in players.columns if c not in ("video_id", "side")]
    own = F.array_sort(F.collect_list(F.struct("at", *rest)))
    lots = lots.groupBy("video_id", "side", "lot").agg(own.alias("own"))
    before = F.lag("own").over(Window.partitionBy("video_id", "side").orderBy("lot"))
    lots = lots.withColumn("all", F.transform(F.concat(F.coalesce(before, F.array()), "own"), lambda p: F.struct(p["mx"].alias("mx"), p["my"].alias("my"))))
    rows = lots.select("video_id", "side", F.explode("own").alias("p"), "all", (F.size("all") - F.size("own")).alias("ahead"))
    end = F.col("ahead") + F.col("p.at")
    trail = F.slice("all", F.greatest(end - length, F.lit(0)) + 1, F.least(end, F.lit(length)))
    return rows.withColumn("trail", trail).select(*("p." + c if c in rest else c for c in players.columns), "trail")


def shuttle_trail(points: DataFrame, length: int = CONFIG.trail) -> DataFrame:
    """(video_id, frame, i, tx, ty, alpha, radius, shade): the fading trail of the last detections."""
    t = points.withColumn("trail", F.collect_list(F.struct("x", "y")).over(by_frame().rowsBetween(-(length - 1), 0)))
    n = F.size("trail")
    rows = t.select("video_id", "frame", n.alias("n"), F.posexplode("trail").alias("i", "p"))
    alpha = (F.col("i") + 1) / F.col("n")
    return rows.select(
        "video_id", "frame", "i", F.col("p.x").alias("tx"), F.col("p.y").alias("ty"), alpha.alias("alpha"),
        F.greatest(F.lit(3), (4 + 6 * alpha).cast("int")).alias("radius"), (200 * alpha).cast("int").alias("shade"),
    )


def hit_markers(hits: DataFrame, frames: DataFrame, players: DataFrame) -> DataFrame:
    """(video_id, frame, hit_number, owner, mx, my): the owner's last known place at the hit, that frame
    included. A hit without one has no marker. An as-of join as one window over both tables' rows."""
    seen = players.select("video_id", "side", "frame", F.struct("mx", "my").alias("at"), F.lit(None).cast("int").alias("hit_number"))
    asked = hits.select("video_id", F.col("owner").alias("side"), "frame", F.lit(None).cast("struct<mx:int,my:int>").alias("at"), "hit_number")
    order = Window.partitionBy("video_id", "side").orderBy("frame", F.col("hit_number").asc_nulls_first())
    both = seen.unionByName(asked).withColumn("at", F.last("at", True).over(order))
    return both.filter("hit_number IS NOT NULL AND at IS NOT NULL").select(
        "video_id", "frame", "hit_number", F.col("side").alias("owner"), "at.mx", "at.my"
    )


def near_event(frames: DataFrame, events: DataFrame, reach: int, name: str) -> DataFrame:
    """Dense (video_id, frame, name): true within `reach` frames of an event."""
    marks = events.select("video_id", "frame").distinct().withColumn("hit", F.lit(1))
    d = frames.select("video_id", "frame").join(marks, ["video_id", "frame"], "left")
    return d.select("video_id", "frame", F.coalesce(F.max("hit").over(by_frame().rowsBetween(-reach, reach)) == 1, F.lit(False)).alias(name))


def view_maps(maps: DataFrame, videos: DataFrame, config: Config = CONFIG) -> DataFrame:
    """maps with the shifted court view: to_view (source pixels), court_view (metres), view_net_y."""
    m = maps.join(videos.select("video_id", "frame_h"), "video_id")
    down = config.shift_px - config.shift_ratio * F.col("frame_h")
    shifted = F.transform("src_pts", lambda p: F.struct(p["x"].alias("x"), single(p["y"] + down).alias("y")))
    court = points([(SINGLES_LEFT, END_FAR), (SINGLES_RIGHT, END_FAR), (SINGLES_RIGHT, END_NEAR), (SINGLES_LEFT, END_NEAR)])
    m = keep(m.withColumn("view_pts", shifted)).withColumns({"to_view": homography(F.col("src_pts"), F.col("view_pts")), "court_view": homography(court, F.col("view_pts"))})
    _, net = project(F.col("court_view"), F.lit(COURT_X["center"]), F.lit(NET_Y))
    return keep(m.withColumn("view_net_y", net.cast("float").cast("int").cast("double")).drop("frame_h"))
