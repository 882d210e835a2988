"""What the views draw, as rows of draw commands; pixels are for a player to set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.config import BONES, CONFIG, COURT_X, COURT_Y, Config
from trackloom.functions.geometry import court_to_canvas, project, project_pixel
from trackloom.functions.series import by_frame
from trackloom.operators.pose import foot_center, point

COMMANDS = "view string, z int, primitive string, x1 double, y1 double, x2 double, y2 double, color string, thickness int"


def court_lines(spark: SparkSession) -> DataFrame:
    """The minimap's court: fills, lines and net, in the order in which they are drawn."""
    x, y = COURT_X, COURT_Y
    fills = [("doubles_left", "doubles_right", "#1B401A"), ("singles_left", "singles_right", "#327330")]
    upright = [(k, "end_near", "end_far") for k in ("doubles_left", "singles_left", "singles_right", "doubles_right")]
    upright += [("center", "end_near", "short_service_near"), ("center", "short_service_far", "end_far")]
    level = ["end_near", "back_service_near", "short_service_near", "short_service_far", "back_service_far", "end_far"]
    rows = []

    def add(kind: str, a: tuple, b: tuple, color: str, thickness: int) -> None:
        rows.append(("minimap", len(rows), kind, *court_to_canvas(*a), *court_to_canvas(*b), color, thickness))

    for left, right, color in fills:
        add("fill", (x[left], y["end_far"]), (x[right], y["end_near"]), color, -1)
    for k, near, far in upright:
        add("line", (x[k], y[near]), (x[k], y[far]), "#FFFFFF", 1)
    for k in level:
        add("line", (x["doubles_left"], y[k]), (x["doubles_right"], y[k]), "#FFFFFF", 1)
    add("line", (x["doubles_left"], y["net"]), (x["doubles_right"], y["net"]), "#FF5000", 2)
    return spark.createDataFrame(rows, COMMANDS)


def bone_segments(pose: DataFrame, view: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(video_id, frame, person_idx, bone, x1, y1, x2, y2): bones between two sure key points, scaled
    about the foot and moved to its place in the shifted view (view has to_view)."""
    p = pose.filter(F.size("keypoints") >= 17).withColumn("foot", foot_center(config.foot_conf)).filter("foot.x > 0 AND foot.y > 0")
    # Views are small next to poses: hashed, they need no sort of rows with all their key points.
    p = p.join(view.select("video_id", "to_view").hint("shuffle_hash"), "video_id")
    tx, ty = project(F.col("to_view"), F.col("foot.x"), F.col("foot.y"))
    edges = F.array(*(F.struct(point(a - 1).alias("a"), point(b - 1).alias("b")) for a, b in BONES))
    rows = p.select("video_id", "frame", "person_idx", "foot", tx.alias("tx"), ty.alias("ty"), F.posexplode(edges).alias("bone", "e"))
    rows = rows.filter((F.col("e.a.conf") >= config.foot_conf) & (F.col("e.b.conf") >= config.foot_conf))
    at = lambda end, axis: F.col(f"t{axis}") + (F.col(f"e.{end}.{axis}") - F.col(f"foot.{axis}")) * config.bone_scale
    return rows.select("video_id", "frame", "person_idx", "bone", at("a", "x").alias("x1"), at("a", "y").alias("y1"), at("b", "x").alias("x2"), at("b", "y").alias("y2"))


def overlays(frames: DataFrame, hits: DataFrame, drops: DataFrame, markers: DataFrame, marks: DataFrame) -> DataFrame:
    """(video_id, frame, layer, text, x, y, color): impact labels, hit markers and drop crosses that begin or show at a frame."""
    impact = hits.select("video_id", "frame", F.lit("impact").alias("layer"), F.concat(F.lit("IMPACT #"), F.col("hit_number")).alias("text"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit("#FFFF00").alias("color"))
    circle = markers.select("video_id", "frame", F.lit("hit").alias("layer"), F.col("hit_number").cast("string").alias("text"), F.col("mx").alias("x"), F.col("my").alias("y"), F.when(F.col("owner") == "top", "#3B82F6").otherwise("#F59E0B").alias("color"))
    shown = marks.join(drops.select("video_id", "rally_idx", "mx", "my", "is_in"), ["video_id", "rally_idx"])
    cross = shown.select("video_id", "frame", F.lit("drop").alias("layer"), F.when(F.col("is_in"), "IN").otherwise("OUT").alias("text"), F.col("mx").alias("x"), F.col("my").alias("y"), F.when(F.col("is_in"), "#00FF00").otherwise("#FF0000").alias("color"))
    return impact.unionByName(circle).unionByName(cross)


# Colours of the views' parts, and the height of a net in the court view whose top nobody gave.
BLUE, GOLD, RED, GREY, WHITE, YELLOW, NET = "#3B82F6", "#F59E0B", "#FF0000", "#C8C8C8", "#FFFFFF", "#FFD700", "#FF5000"
NET_HEIGHT = 250


def _court_shapes() -> list[tuple[str, list[tuple[float, float]], str, int]]:
    """The court's parts in metres, in the order in which they are drawn: floors, outline, lines."""
    x, y = COURT_X, COURT_Y

    def box(left: str, right: str) -> list[tuple[float, float]]:
        return [(x[left], y["end_far"]), (x[right], y["end_far"]), (x[right], y["end_near"]), (x[left], y["end_near"])]

    doubles, singles = box("doubles_left", "doubles_right"), box("singles_left", "singles_right")
    out = [("fill", doubles, "#1B401A", -1), ("fill", singles, "#327330", -1), ("outline", doubles, WHITE, 2)]
    out += [("line", [(x[k], y["end_far"]), (x[k], y["end_near"])], WHITE, 2) for k in ("singles_left", "singles_right")]
    level = ("back_service_near", "back_service_far", "short_service_near", "short_service_far")
    out += [("line", [(x["doubles_left"], y[k]), (x["doubles_right"], y[k])], WHITE, 2) for k in level]
    middle = (("end_far", "short_service_far"), ("short_service_near", "end_near"))
    return out + [("line", [(x["center"], y[a]), (x["center"], y[b])], WHITE, 2) for a, b in middle]


def view_court(view: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """(video_id, z, primitive, points array<struct<x,y>>, color, thickness): the court of each video's shifted view
    (view has court_view and to_view), then its net: the top edge, and a post at each end.

    A net of the calibration is its top edge in source pixels; without one it stands NET_HEIGHT above its foot."""
    v = view.select("video_id", "court_view", "to_view")
    if calibration is None:
        v = v.withColumn("net", F.lit(None).cast("array<struct<x:double,y:double>>"))
    else:
        v = v.join(calibration.select("video_id", "net"), "video_id", "left")
    pixel = lambda matrix, x, y: F.struct(*(c.alias(a) for c, a in zip(project_pixel(F.col(matrix), x, y), "xy")))
    at = lambda x, y: pixel("court_view", F.lit(float(x)), F.lit(float(y)))
    shape = lambda kind, points, color, width: F.struct(F.lit(kind).alias("primitive"), points.alias("points"), F.lit(color).alias("color"), F.lit(width).alias("thickness"))
    feet = F.array(*(at(COURT_X[k], COURT_Y["net"]) for k in ("doubles_left", "doubles_right")))
    raised = lambda p: F.struct(p["x"].alias("x"), (p["y"] - NET_HEIGHT).alias("y"))
    v = v.withColumn("feet", feet)
    v = v.withColumn("top", F.when(F.col("net").isNull(), F.transform("feet", raised)).otherwise(F.transform("net", lambda p: pixel("to_view", p["x"], p["y"]))))
    post = lambda i: shape("line", F.array(F.get("feet", F.lit(i)), F.get("top", F.lit(i))), NET, 3)
    shapes = [shape(kind, F.array(*(at(*p) for p in places)), color, width) for kind, places, color, width in _court_shapes()]
    return v.select("video_id", F.posexplode(F.array(*shapes, shape("line", F.col("top"), NET, 6), post(0), post(1))).alias("z", "s")).select("video_id", "z", "s.*")


def frame_overlays(frames: DataFrame, videos: DataFrame, hits: DataFrame, faults: DataFrame | None = None, calibration: DataFrame | None = None) -> DataFrame:
    """(video_id, frame, layer, text, x1, y1, x2, y2, color, size): what is drawn over the frames of the source video, in
    the order of layers: the shuttle (a disc of radius `size`), the net's top, the impact's text and tint (`size` more of
    blue in every pixel) within 2 frames of a hit, the fault's text within 3 of a fault, the frame's number.

    One pass over the frames: events are marked on them, and windows of one order spread the marks."""
    d = frames.select("video_id", "frame", "x", "y").join(videos.select("video_id", "frame_w"), "video_id")
    for name, events, reach in (("impact", hits, 2), ("fault", faults, 3)):
        if events is None:
            d = d.withColumn(name, F.lit(False))
            continue
        d = d.join(events.select("video_id", "frame", F.lit(1).alias(f"{name}_mark")).distinct(), ["video_id", "frame"], "left")
        d = d.withColumn(name, F.coalesce(F.max(f"{name}_mark").over(by_frame().rowsBetween(-reach, reach)) == 1, F.lit(False)))
    net = "array<struct<x:double,y:double>>"
    d = d.withColumn("net", F.lit(None).cast(net)) if calibration is None else d.join(calibration.select("video_id", "net"), "video_id", "left")
    nil = F.lit(None).cast("int")

    def layer(when, name: str, text, place: tuple, color: str, size: int):
        places = [p.cast("int").alias(a) for p, a in zip((*place, nil, nil), ("x1", "y1", "x2", "y2"))]
        return F.when(when, F.struct(F.lit(name).alias("layer"), text.alias("text"), *places, F.lit(color).alias("color"), F.lit(size).alias("size")))

    end = lambda i, a: F.get("net", F.lit(i))[a]
    half, empty = F.floor(F.col("frame_w") / 2), F.lit("")
    layers = F.array(
        layer((F.col("x") > 0) & (F.col("y") > 0), "shuttle", empty, (F.col("x"), F.col("y")), YELLOW, 7),
        layer(F.col("net").isNotNull(), "net", empty, (end(0, "x"), end(0, "y"), end(1, "x"), end(1, "y")), BLUE, 2),
        layer(F.col("impact"), "impact", F.lit("IMPACT"), (half - 90, F.lit(130)), BLUE, 5),
        layer(F.col("impact"), "tint", empty, (nil, nil), BLUE, 60),
        layer(F.col("fault"), "fault", F.lit("NET FAULT"), (half - 130, F.lit(180)), RED, 5),
        layer(F.lit(True), "frame", F.concat(F.lit("F:"), F.col("frame")), (F.lit(20), F.lit(50)), GREY, 2),
    )
    return d.select("video_id", "frame", F.explode(F.filter(layers, lambda s: s.isNotNull())).alias("s")).select("video_id", "frame", "s.*")


def player_dots(held: DataFrame) -> DataFrame:
    """(video_id, frame, side, z, x, y, radius, color, thickness) of held places (video_id, frame, side, at struct<mx,my>):
    a disc in the side's colour, its white rim and its white middle."""
    own = F.when(F.col("side") == "top", BLUE).otherwise(GOLD)
    ring = lambda radius, color, width: F.struct(F.lit(radius).alias("radius"), color.alias("color"), F.lit(width).alias("thickness"))
    rings = F.array(ring(9, own, -1), ring(9, F.lit(WHITE), 2), ring(4, F.lit(WHITE), -1))
    rows = held.filter("at IS NOT NULL").select("video_id", "frame", "side", "at", F.posexplode(rings).alias("z", "r"))
    return rows.select("video_id", "frame", "side", "z", F.col("at.mx").alias("x"), F.col("at.my").alias("y"), "r.*")
