"""Registered queries: every operator on trajectories made from the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import CONFIG as C
from trackloom.functions.geometry import project, quad_of, signed_distance
from trackloom.functions.stages import Shelf, keep
from trackloom.operators import cleaning, crossings, impulse, owners, peaks, players, pose, rallies, render
from trackloom.plans import analysis, blocks
from trackloom.sources import adapters
from trackloom.sources.adapters import EVENTS


class Clip:
    """The tables of the events adapter for one query, each built when first asked for."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def _get(self, name: str, make, kept: bool = True) -> DataFrame:
        if name not in self._made:
            self._made[name] = keep(make()) if kept else make()
        return self._made[name]

    @property
    def frames(self):
        return self._get("frames", lambda: adapters.events_frames(self.spark, self.sf_dir))

    @property
    def videos(self):
        return self._get("videos", lambda: adapters.videos_of(self.frames, EVENTS), kept=False)

    @property
    def points(self):
        return self._get("points", lambda: cleaning.valid_points(self.frames), kept=False)

    @property
    def cleaned(self):
        return self._get("cleaned", lambda: cleaning.clean(self.points))

    @property
    def params(self):
        return self._get("params", lambda: cleaning.adaptive_parameters(self.cleaned, self.videos), kept=False)

    @property
    def judged(self):
        return self._get("judged", lambda: impulse.judged_points(self.cleaned, self.params), kept=False)

    @property
    def scores(self):
        return self._get("scores", lambda: impulse.impulse_scores(self.frames, self.judged))

    @property
    def nets(self):
        return self._get("nets", lambda: self.videos.select("video_id", F.lit(0.0).alias("slope"), F.lit(EVENTS.net_y).alias("intercept")), kept=False)

    @property
    def crossings(self):
        return self._get("crossings", lambda: crossings.net_crossings(self.frames, self.videos, self.nets), kept=False)

    @property
    def owner_y(self):
        return self._get("owner_y", lambda: self.videos.select("video_id", F.lit(EVENTS.net_y).alias("owner_y")), kept=False)

    @property
    def peaks(self):
        return self._get("peaks", lambda: peaks.find_peaks(self.scores, self.params), kept=False)

    @property
    def hits(self):
        return self._get("hits", lambda: peaks.candidates(self.peaks, self.frames, self.videos, self.owner_y))

    @property
    def rallied(self):
        return self._get("rallied", lambda: rallies.rallies(self.hits, self.videos), kept=False)

    @property
    def landed(self):
        return self._get("landed", lambda: rallies.landings(rallies.last_hits(rallies.alternate_owners(self.rallied)), self.points, self.videos), kept=False)

    @property
    def maps(self):
        return self._get("maps", lambda: analysis.calibrated(self.videos, None), kept=False)

    @property
    def drops(self):
        return self._get("drops", lambda: rallies.judge_drops(self.landed, self.maps), kept=False)

    @property
    def pose(self):
        return self._get("pose", lambda: adapters.embedding_pose(self.spark, self.sf_dir, self.videos, self.frames), kept=False)

    @property
    def wrists(self):
        return self._get("wrists", lambda: pose.nearest_wrists(self.hits, self.frames, self.pose_at_hits, self.videos), kept=False)

    @property
    def pose_at_hits(self):
        """What pose_window leaves of the poses, which are only made for the frames that it asks for."""
        return adapters.embedding_pose(self.spark, self.sf_dir, self.videos, pose.wanted_frames(self.hits, self.videos))

    @property
    def on_map(self):
        return self._get("on_map", lambda: players.minimap_players(self.pose, self.maps), kept=False)

    @property
    def calibration(self):
        return self._get("calibration", lambda: adapters.events_calibration(self.videos), kept=False)

    @property
    def sloped(self):
        """Crossings of the calibrated nets. A crossing is where the path meets the net, so only a tolerance below
        zero takes it for a fault; it does so for all, and the fault tables have rows."""
        nets = analysis.nets(self.calibration).drop("center_x")
        return self._get("sloped", lambda: crossings.net_crossings(self.frames, self.videos, nets, replace(C, fault_tolerance=-0.5)), kept=False)

    @property
    def faults(self):
        net = analysis.nets(self.calibration)
        return crossings.net_faults(self.sloped, self.frames, net.drop("center_x"), net.select("video_id", "center_x"))

    @property
    def view(self):
        return self._get("view", lambda: players.view_maps(self.maps, self.videos), kept=False)


def _r(column: str, places: int = 6):
    """Rounded for a comparison across engines; roots and arcs differ in their last bits."""
    return F.round(column, places).alias(column)


QUERIES: dict = {}


def query(f):
    """Registers a function of a Clip under its name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Clip(spark, sf_dir))
    return f


@query
def traj_valid(c: Clip) -> DataFrame:
    return c.points


@query
def traj_step(c: Clip) -> DataFrame:
    return cleaning.steps(c.points).select("video_id", "frame", "gap", _r("step"))


@query
def typical_step(c: Clip) -> DataFrame:
    return cleaning.typical_steps(c.points).select("video_id", _r("typical"))


@query
def traj_clean(c: Clip) -> DataFrame:
    return c.cleaned.select("video_id", "frame", "x", "y")


@query
def traj_params(c: Clip) -> DataFrame:
    return c.params.select(
        "video_id", "points", "avg_gap", _r("gap_ratio"), "max_frame_gap", _r("min_speed"), _r("min_flight"), "peak_distance", "near_future",
        _r("min_floor_drop"), _r("floor_pct"),
    )


@query
def floor_limit(c: Clip) -> DataFrame:
    rows = c.cleaned.join(c.params.select("video_id", "floor_pct"), "video_id")
    return cleaning.percentile_by_rank(rows, "y", "floor_pct").select("video_id", _r("limit"))


@query
def impulse_filters(c: Clip) -> DataFrame:
    return c.judged.select("video_id", "frame", _r("impulse"), F.coalesce("dropped", F.lit("scored")).alias("dropped"))


@query
def impulse_scores(c: Clip) -> DataFrame:
    return c.scores.filter("score > 0").select("video_id", "frame", _r("score"))


@query
def tukey_fence(c: Clip) -> DataFrame:
    return peaks.fences(c.scores).select("video_id", "scored", _r("q1"), _r("q3"), _r("top"), _r("fence"))


@query
def local_maxima(c: Clip) -> DataFrame:
    return peaks.local_maxima(peaks.suppressed(c.scores)).select("video_id", "frame", _r("work"))


@query
def peaks_apart(c: Clip) -> DataFrame:
    found = peaks.local_maxima(c.scores, "score")
    return peaks.apart(found, c.params).select("video_id", "frame", _r("score"))


@query
def peaks_prominence(c: Clip) -> DataFrame:
    found = peaks.local_maxima(c.scores, "score")
    return peaks.prominences(found, c.scores, "score").select("video_id", "frame", _r("score"), _r("prominence"))


@query
def score_nms(c: Clip) -> DataFrame:
    return peaks.strongest(peaks.local_maxima(c.scores, "score")).select("video_id", "frame", _r("score"))


@query
def hits(c: Clip) -> DataFrame:
    return c.hits.select("video_id", "hit_number", "frame", _r("time_sec"), _r("score"), "owner", "player", "method")


@query
def side_changes(c: Clip) -> DataFrame:
    return crossings.side_changes(c.frames, c.nets).select("video_id", "trigger", "frame", "direction", _r("cross_x"))


@query
def net_crossings(c: Clip) -> DataFrame:
    return c.crossings.select("video_id", "frame", _r("time_sec"), "direction", "hitter_side", "receiver_side", "is_fault")


@query
def net_faults(c: Clip) -> DataFrame:
    centers = c.videos.select("video_id", F.lit(640.0).alias("center_x"))
    return analysis.fault_rows(crossings.net_faults(c.crossings, c.frames, c.nets, centers))


@query
def crossing_owner(c: Clip) -> DataFrame:
    return crossings.apply_crossing_owners(c.hits, c.crossings).select("video_id", "frame", "owner", "player", "method")


@query
def alternation_fix(c: Clip) -> DataFrame:
    crossed = crossings.apply_crossing_owners(c.hits, c.crossings)
    return owners.correct_alternation(crossed, c.frames, c.videos, c.owner_y).select("video_id", "frame", "owner", "player", "method")


@query
def rally_sessions(c: Clip) -> DataFrame:
    return c.rallied.select("video_id", "frame", "hit_number", "rally")


@query
def alternate_owner(c: Clip) -> DataFrame:
    return rallies.alternate_owners(c.rallied).select("video_id", "frame", "rally", "owner", "player")


@query
def rally_last_hit(c: Clip) -> DataFrame:
    return rallies.last_hits(c.rallied).select("video_id", "rally", "frame", "hit_number")


@query
def landing(c: Clip) -> DataFrame:
    return c.landed.select("video_id", "rally", "frame", "sx", "sy", "last_hit_number", "last_hit_owner")


@query
def drop_verdict(c: Clip) -> DataFrame:
    # Whole pixels give places with a few decimals, which these don't cut.
    near = [F.round(v, n).alias(v) for v, n in (("margin_cm", 6), ("court_x", 8), ("court_y", 8))]
    return c.drops.select("video_id", "rally_idx", "frame", "mx", "my", "location", "nearest_line", *near, "is_in", "verdict")


@query
def drop_interval(c: Clip) -> DataFrame:
    return rallies.drop_marks(c.frames, c.drops, c.rallied)


@query
def homography_apply(c: Clip) -> DataFrame:
    p = c.points.join(c.maps.select("video_id", "to_minimap", "to_normalized"), "video_id")
    (mx, my), (nx, ny) = project(F.col("to_minimap"), F.col("x"), F.col("y")), project(F.col("to_normalized"), F.col("x"), F.col("y"))
    return p.select("video_id", "frame", *((F.round(v, 4) + F.lit(0.0)).alias(n) for n, v in (("mx", mx), ("my", my), ("nx", nx), ("ny", ny))))  # no -0.0


@query
def point_in_court(c: Clip) -> DataFrame:
    p = c.points.withColumns({"px": F.col("x") * 6, "py": F.col("y")}).join(c.maps.select("video_id", "src_pts"), "video_id")
    away = signed_distance(F.col("px"), F.col("py"), quad_of(F.col("src_pts")))
    return p.select("video_id", "frame", F.round(away, 4).alias("away"), (away >= 0).alias("inside"), (away >= -C.court_margin).alias("near"))


@query
def foot_center(c: Clip) -> DataFrame:
    f = adapters.embedding_pose(c.spark, c.sf_dir, c.videos, c.frames, told={"f": pose.foot_center()})
    return f.select("video_id", "frame", "person_idx", F.round("f.x", 4).alias("x"), F.round("f.y", 4).alias("y"))


@query
def body_center(c: Clip) -> DataFrame:
    p = adapters.embedding_pose(c.spark, c.sf_dir, c.videos, c.frames, told={"owner": pose.body_center_y(), "rescue": pose.rescue_center_y()})
    return p.select("video_id", "frame", "person_idx", F.round("owner", 4).alias("owner_path"), F.round("rescue", 4).alias("rescue_path"))


@query
def pose_window(c: Clip) -> DataFrame:
    return pose.pose_window(c.pose, c.hits, c.videos).select("video_id", "frame", "person_idx")


@query
def wrist_nearest(c: Clip) -> DataFrame:
    return c.wrists.select("video_id", "frame", F.round("dist", 4).alias("dist"), F.round("center_y", 4).alias("center_y"))


@query
def pose_owner(c: Clip) -> DataFrame:
    return pose.apply_pose_owners(c.hits, c.wrists, c.owner_y).select("video_id", "frame", "owner", "player", "method")


@query
def near_miss(c: Clip) -> DataFrame:
    return pose.near_misses(c.scores, c.hits, c.params).select("video_id", "frame", _r("score"))


@query
def rescue(c: Clip) -> DataFrame:
    r = pose.rescue_hits(c.hits, c.scores, c.params, c.frames, c.pose, c.videos, c.owner_y)
    return r.select("video_id", "hit_number", "frame", _r("score"), "owner", "player", "method")


@query
def player_select(c: Clip) -> DataFrame:
    return c.on_map


@query
def court_player_select(c: Clip) -> DataFrame:
    return players.court_players(c.pose, c.view, c.videos)


@query
def player_ghost(c: Clip) -> DataFrame:
    return players.ghosts(c.frames, c.on_map, "mx")


@query
def player_trail(c: Clip) -> DataFrame:
    t = players.player_trails(c.on_map)
    total = F.aggregate("trail", F.lit(0), lambda n, p: n + p["mx"])
    return t.select("video_id", "frame", "side", F.size("trail").alias("length"), total.alias("total_mx"), F.get("trail", F.lit(0))["my"].alias("oldest_my"))


@query
def shuttle_trail(c: Clip) -> DataFrame:
    return players.shuttle_trail(c.points).select("video_id", "frame", "i", "tx", "ty", _r("alpha"), "radius", "shade")


@query
def hit_marker_asof(c: Clip) -> DataFrame:
    return players.hit_markers(rallies.alternate_owners(c.rallied), c.frames, c.on_map)


@query
def impact_flag(c: Clip) -> DataFrame:
    return players.near_event(c.frames, c.hits, 2, "impact")


@query
def crossing_flag(c: Clip) -> DataFrame:
    return players.near_event(c.frames, c.crossings, 3, "crossing")


@query
def bone_segments(c: Clip) -> DataFrame:
    return render.bone_segments(c.pose, c.view).select("video_id", "frame", "person_idx", "bone", *(F.round(v, 2).alias(v) for v in ("x1", "y1", "x2", "y2")))


@query
def court_lines(c: Clip) -> DataFrame:
    return render.court_lines(c.spark).select("view", "z", "primitive", *(_r(v).alias(v) for v in ("x1", "y1", "x2", "y2")), "color", "thickness")


@query
def draw_commands(c: Clip) -> DataFrame:
    return render.overlays(c.frames, c.hits, c.drops, players.hit_markers(rallies.alternate_owners(c.rallied), c.frames, c.on_map), rallies.drop_marks(c.frames, c.drops, c.rallied))


@query
def view_court(c: Clip) -> DataFrame:
    """Each video's court view, its points as text, with the nets that the calibration gives."""
    told = F.array_join(F.transform("points", lambda p: F.concat_ws(",", p["x"], p["y"])), " ")
    return render.view_court(c.view, c.calibration).withColumn("points", told)


@query
def frame_overlays(c: Clip) -> DataFrame:
    return render.frame_overlays(c.frames, c.videos, c.hits, c.faults, c.calibration).fillna(-1)


@query
def player_dots(c: Clip) -> DataFrame:
    return render.player_dots(players.ghosts(c.frames, c.on_map.withColumn("at", F.struct("mx", "my")), "at"))


@query
def hits_json(c: Clip) -> DataFrame:
    return analysis.documents(c.videos, rallies.alternate_owners(c.rallied), c.drops, c.maps)


@query
def api_document(c: Clip) -> DataFrame:
    """The hits of the result documents as rows, read back from the JSON itself."""
    kind = "video_fps double, total_hits int, hits_data array<struct<hit_number:int,frame:int,time_sec:double,player:string>>"
    d = analysis.documents(c.videos, rallies.alternate_owners(c.rallied)).select("video_id", F.from_json("document", kind).alias("d"))
    return d.select("video_id", "d.video_fps", "d.total_hits", F.explode("d.hits_data").alias("h")).select("video_id", "video_fps", "total_hits", "h.*")


@query
def callback_body(c: Clip) -> DataFrame:
    """What the success message tells of each video, read back from the JSON itself."""
    b = analysis.callbacks(c.videos, rallies.alternate_owners(c.rallied), analysis.fault_rows(crossings.net_faults(c.crossings, c.frames, c.nets, c.videos.select("video_id", F.lit(640.0).alias("center_x")))))
    kind = "videoFps double, totalHits int, netFaultEvents array<string>"
    return b.select("video_id", F.from_json("body", kind).alias("b")).select("video_id", F.col("b.videoFps").alias("fps"), F.col("b.totalHits").alias("hits"), F.size("b.netFaultEvents").alias("faults"))


@query
def timeline_row(c: Clip) -> DataFrame:
    f = c.crossings.select("video_id", "frame", "time_sec", F.lit(0.0).alias("clearance_px"))
    return analysis.timeline_rows(f).drop("eventScore")


@query
def top_scores(c: Clip) -> DataFrame:
    """The 20 highest scores; the limit is the report's own."""
    return c.scores.filter("score > 0").orderBy(F.desc("score"), "video_id", "frame").limit(20).select("video_id", "frame", _r("score"))


@query
def removed_points(c: Clip) -> DataFrame:
    return c.points.select("video_id", "frame").exceptAll(c.cleaned.select("video_id", "frame"))


def _places(c: Clip, maps: DataFrame, places: int = 7):
    p = c.points.join(maps.select("video_id", "to_minimap", "to_normalized", "coordinate_mode"), "video_id")
    (mx, my), (nx, ny) = project(F.col("to_minimap"), F.col("x"), F.col("y")), project(F.col("to_normalized"), F.col("x"), F.col("y"))
    return p.select("video_id", "frame", "coordinate_mode", *((F.round(v, places) + F.lit(0.0)).alias(n) for n, v in (("mx", mx), ("my", my), ("nx", nx), ("ny", ny))))


@query
def calibrated_points(c: Clip) -> DataFrame:
    """Points through the maps of the users' own corners, and of default ones where a video has none."""
    return _places(c, analysis.calibrated(c.videos, c.calibration))


@query
def owner_threshold(c: Clip) -> DataFrame:
    return peaks.owner_thresholds(c.videos, c.calibration).select("video_id", _r("owner_y"))


@query
def sloped_changes(c: Clip) -> DataFrame:
    found = crossings.side_changes(c.frames, analysis.nets(c.calibration).drop("center_x"))
    return found.select("video_id", "trigger", "frame", "direction", _r("cross_x"))


@query
def sloped_crossings(c: Clip) -> DataFrame:
    return c.sloped.select("video_id", "frame", _r("time_sec"), "direction", "hitter_side", "receiver_side", "is_fault")


@query
def fault_rows(c: Clip) -> DataFrame:
    return analysis.fault_rows(c.faults).withColumn("clearance_px", F.col("clearance_px") + F.lit(0.0))  # no -0.0


@query
def fault_flag(c: Clip) -> DataFrame:
    return players.near_event(c.frames, c.faults, 3, "fault")


@query
def fault_timeline(c: Clip) -> DataFrame:
    return analysis.timeline_rows(c.faults).drop("eventScore")


@query
def fault_callback(c: Clip) -> DataFrame:
    """The faults of the success messages as rows, read back from the JSON itself."""
    kind = "netFaultEvents array<struct<frame:int,time_sec:double,crossing_x:double,shuttle_y:double,net_top_y_at_x:double>>"
    b = analysis.callbacks(c.videos, rallies.alternate_owners(c.rallied), c.faults).select("video_id", F.from_json("body", kind).alias("b"))
    return b.select("video_id", F.explode("b.netFaultEvents").alias("e")).select("video_id", "e.*")


@query
def floor_bypass(c: Clip) -> DataFrame:
    """The filters with wrists at hand: a wrist within reach lifts the floor filter."""
    judged = impulse.judged_points(c.cleaned, c.params, pose.wrist_points(c.pose))
    return judged.select("video_id", "frame", _r("impulse"), F.coalesce("dropped", F.lit("scored")).alias("dropped"))


@query
def summary_text(c: Clip) -> DataFrame:
    shown = c.faults.withColumn("clearance_px", F.round("clearance_px", 6) + F.lit(0.0))
    return analysis.summaries(c.videos, rallies.alternate_owners(c.rallied), shown)


def long_hits(spark, sf_dir: str) -> DataFrame:
    """Hits of the long line-item videos: the detection at its full length."""
    clip = adapters.LINEITEM
    frames = keep(adapters.lineitem_frames(spark, sf_dir))
    videos = adapters.videos_of(frames, clip)
    owner_y = videos.select("video_id", F.lit(clip.net_y).alias("owner_y"))
    found = analysis.detect(frames, videos, owner_y, alternation=False)
    return found.hits.select("video_id", "hit_number", "frame", _r("time_sec"), _r("score"), "owner")


def long_crossings(spark, sf_dir: str) -> DataFrame:
    """Net crossings of the long line-item videos."""
    clip = adapters.LINEITEM
    frames = keep(adapters.lineitem_frames(spark, sf_dir))
    videos = adapters.videos_of(frames, clip)
    nets = videos.select("video_id", F.lit(0.0).alias("slope"), F.lit(clip.net_y).alias("intercept"))
    return crossings.net_crossings(frames, videos, nets).select("video_id", "frame", _r("time_sec"), "direction")


def split_hits(spark, sf_dir: str) -> DataFrame:
    """long_hits with every video cut into blocks of 64 points, so that each has many."""
    clip, shelf = adapters.LINEITEM, Shelf(spark)
    frames = shelf.put("frames", adapters.lineitem_frames(spark, sf_dir))
    videos = adapters.videos_of(frames, clip)
    found = blocks.detect(frames, videos, videos.select("video_id", F.lit(clip.net_y).alias("owner_y")), size=64)
    shelf.drop("frames")
    return found.select("video_id", "hit_number", "frame", _r("time_sec"), _r("score"), "owner")


QUERIES |= {"long_hits": long_hits, "split_hits": split_hits, "long_crossings": long_crossings}
