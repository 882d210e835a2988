"""Whole analyses over many videos at once: hits, owners, rallies, verdicts, result documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config
from trackloom.functions.geometry import corner, homographies, net_line
from trackloom.functions.stages import keep
from trackloom.operators import cleaning, crossings, impulse, owners, peaks, players, pose, rallies, render
from trackloom.sources.trajectories import normalised


@dataclass
class Detection:
    """Intermediate tables of a detection, each keyed by video_id (and frame)."""

    points: DataFrame
    cleaned: DataFrame
    params: DataFrame
    judged: DataFrame
    scores: DataFrame
    hits: DataFrame


def detect(
    frames: DataFrame, videos: DataFrame, owner_y: DataFrame, crossed: DataFrame | None = None, pose_full: DataFrame | None = None,
    alternation: bool = True, config: Config = CONFIG,
) -> Detection:
    """Hits of all videos, as a library call finds them: with all poses at hand the floor filter and
    the owners use them, and alternation is corrected by evidence unless that is switched off."""
    frames = normalised(frames)
    points = cleaning.valid_points(frames)
    # Tables that several operators read are kept, so that none is worked out twice.
    cleaned = keep(cleaning.clean(points, config))
    params = keep(cleaning.adaptive_parameters(cleaned, videos))
    wrists = pose.wrist_points(pose_full) if pose_full is not None else None
    judged = impulse.judged_points(cleaned, params, wrists, config)
    scores = keep(impulse.impulse_scores(frames, judged))
    hits = keep(peaks.candidates(peaks.find_peaks(scores, params, config), frames, videos, owner_y))
    if crossed is not None:
        hits = crossings.apply_crossing_owners(hits, crossed, config)
    if pose_full is not None:
        hits = pose.apply_pose_owners(hits, pose.nearest_wrists(hits, frames, pose_full, videos, config), owner_y)
    if alternation:
        hits = owners.correct_alternation(hits, frames, videos, owner_y, config)
    return Detection(points, cleaned, params, judged, scores, hits)


def calibrated(videos: DataFrame, calibration: DataFrame | None) -> DataFrame:
    """(video_id, homographies...) of every video, by its corners or by default shares of the frame."""
    if calibration is None:
        v = videos.withColumn("corners", F.lit(None).cast("array<struct<x:double,y:double>>"))
    else:
        wrong = (F.size("corners") != 4) | (F.size("net") != 2)
        checked = calibration.withColumn("corners", F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("a court has 4 corners and a net 2 points"))).otherwise(F.col("corners")))
        v = videos.join(checked.select("video_id", "corners"), "video_id", "left")
    return keep(v.select("video_id", *(c.alias(name) for name, c in homographies(F.col("corners"), F.col("frame_w"), F.col("frame_h")).items())))


def nets(calibration: DataFrame) -> DataFrame:
    """(video_id, slope, intercept, center_x) of the videos with a net."""
    slope, intercept = net_line(F.col("net"))
    center = (corner(F.col("net"), 0, "x") + corner(F.col("net"), 1, "x")) / 2
    return calibration.filter("net IS NOT NULL").select("video_id", slope.alias("slope"), intercept.alias("intercept"), center.alias("center_x"))


def analyze(frames: DataFrame, videos: DataFrame, calibration: DataFrame | None = None, pose_rows: DataFrame | None = None, config: Config = CONFIG) -> dict[str, DataFrame]:
    """The whole analysis: crossings, faults, hits, drops, player, ghost, trail, bone and marker tables, overlays,
    result documents and summaries.

    Hits get owners by crossings, by pose and by near misses that a wrist confirms, and then
    alternate in each rally. Tables that need a pose are absent without one.
    """
    frames = normalised(frames)
    owner_y = peaks.owner_thresholds(videos, calibration)
    maps = calibrated(videos, calibration)
    crossed = faults = None
    if calibration is not None:
        net = nets(calibration)
        crossed = keep(crossings.net_crossings(frames, videos, net.drop("center_x"), config))
        faults = crossings.net_faults(crossed, frames, net.drop("center_x"), net.select("video_id", "center_x"))
    found = detect(frames, videos, owner_y, crossed, alternation=False, config=config)
    hits = found.hits
    if pose_rows is not None:
        near = pose.pose_window(pose_rows, hits.select("video_id", "frame"), videos)
        hits = keep(pose.apply_pose_owners(hits, pose.nearest_wrists(hits, frames, near, videos, config), owner_y))
        hits = keep(pose.rescue_hits(hits, found.scores, found.params, frames, pose_rows, videos, owner_y, config))
    rallied = keep(rallies.alternate_owners(rallies.rallies(hits, videos, config)))
    drops = keep(rallies.judge_drops(rallies.landings(rallies.last_hits(rallied), found.points, videos), maps))
    marks = rallies.drop_marks(frames, drops, rallied)
    out = {"hits": rallied, "drops": drops, "maps": maps, "params": found.params, "scores": found.scores, "marks": marks}
    out |= {"shuttle_trail": players.shuttle_trail(found.points), "impacts": players.near_event(frames, hits, 2, "impact"), "summaries": summaries(videos, rallied, faults)}
    if crossed is not None:
        out |= {"crossings": crossed, "faults": faults, "fault_flags": players.near_event(frames, faults, 3, "fault")}
    if pose_rows is not None:
        view = players.view_maps(maps, videos, config)
        on_map = players.minimap_players(pose_rows, maps, config)
        markers = players.hit_markers(rallied, frames, on_map)
        out |= {"minimap_players": on_map, "court_players": players.court_players(pose_rows, view, videos, config), "hit_markers": markers}
        out |= {"ghosts": players.ghosts(frames, on_map.withColumn("at", F.struct("mx", "my")), "at"), "player_trails": players.player_trails(on_map, config.trail)}
        out |= {"bones": render.bone_segments(pose_rows, view), "overlays": render.overlays(frames, rallied, drops, markers, marks)}
        out |= {"player_dots": render.player_dots(out["ghosts"]), "view_court": render.view_court(view, calibration)}
    out["frame_overlays"] = render.frame_overlays(frames, videos, rallied, faults, calibration)
    out["documents"] = documents(videos, rallied, drops, maps, faults)
    return out


def hit_rows(hits: DataFrame) -> DataFrame:
    """The hits' published fields, times rounded to 3 places."""
    return hits.select("video_id", "hit_number", "frame", F.bround("time_sec", 3).alias("time_sec"), "player")


def fault_rows(faults: DataFrame) -> DataFrame:
    """The faults' published fields."""
    return faults.select("video_id", "frame", F.bround("time_sec", 3).alias("time_sec"), *(F.bround(c, 1).alias(c) for c in ("crossing_x", "shuttle_y", "net_top_y_at_x", "clearance_px")))


def timeline_rows(faults: DataFrame) -> DataFrame:
    """Faults as a time line shows them."""
    sec = F.col("time_sec").cast("int")
    # The published texts.
    return faults.select(
        "video_id", sec.alias("timestamp"), F.format_string("%02d:%02d", F.floor(sec / 60).cast("int"), sec % 60).alias("displayTime"),
        F.lit("NET_FAULT").alias("eventType"), F.lit("네트 걸림").alias("eventTitle"),
        F.concat(F.lit("셔틀콕이 네트 상단보다 "), F.format_string("%.1f", F.abs("clearance_px")), F.lit("px 낮은 위치를 통과하려 했습니다.")).alias("eventDescription"),
        F.lit(None).cast("double").alias("eventScore"),
    )


def documents(videos: DataFrame, hits: DataFrame, drops: DataFrame | None = None, maps: DataFrame | None = None, faults: DataFrame | None = None) -> DataFrame:
    """(video_id, document): one JSON document per video, also for videos without a hit."""
    rows = F.array_sort(F.collect_list(F.struct("hit_number", "frame", "time_sec", "player")))
    own = hit_rows(hits).groupBy("video_id").agg(rows.alias("hits_data"))
    d = videos.select("video_id", F.bround("fps", 2).alias("video_fps")).join(own, "video_id", "left")
    fields = ["video_fps", F.coalesce(F.size("hits_data"), F.lit(0)).alias("total_hits"), F.coalesce("hits_data", F.array()).alias("hits_data")]
    if faults is not None:
        f = fault_rows(faults).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame", "time_sec", "crossing_x", "shuttle_y", "net_top_y_at_x", "clearance_px"))).alias("net_fault_events"))
        d = d.join(f, "video_id", "left")
        fields.append(F.coalesce("net_fault_events", F.array()).alias("net_fault_events"))
    if maps is not None:
        d = d.join(maps.select("video_id", "coordinate_mode"), "video_id", "left")
        fields.append("coordinate_mode")
    if drops is not None:
        j = drops.select(
            "video_id",
            F.struct(
                "rally_idx", "frame", "location", F.bround("margin_cm", 1).alias("margin_cm"), "nearest_line",
                F.bround("court_x", 3).alias("bwf_x"), F.bround("court_y", 3).alias("bwf_y"), "last_hit_number", "last_hit_owner",
            ).alias("j"),
        )
        j = j.groupBy("video_id").agg(F.array_sort(F.collect_list("j")).alias("drop_judgments"))
        d = d.join(j, "video_id", "left")
        fields.append(F.coalesce("drop_judgments", F.array()).alias("drop_judgments"))
    fields = [F.when(F.lit(True), F.col(f)).alias(f) if isinstance(f, str) else f for f in fields]
    return d.select("video_id", F.to_json(F.struct(*fields)).alias("document"))


def _id_json() -> Column:
    """A video's id as JSON: a number if it is a whole one, else a quoted text."""
    listed = F.to_json(F.array("video_id"))
    return F.coalesce(F.expr("try_cast(video_id AS BIGINT)").cast("string"), listed.substr(F.lit(2), F.length(listed) - 2))


def callbacks(videos: DataFrame, hits: DataFrame, faults: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(video_id, body): the success message of each video, without drops. With requests(video_id,
    skeletonVideoUrl, minimapVideoUrl) the addresses that aren't empty are told too."""
    doc = documents(videos, hits, faults=faults)
    parsed = F.from_json("document", "video_fps double, total_hits int, hits_data string, net_fault_events string")
    p = doc.select("video_id", parsed.alias("p"))
    told = F.lit("")
    if requests is not None:
        p = p.join(requests.select("video_id", "skeletonVideoUrl", "minimapVideoUrl"), "video_id", "left")
        for name in ("skeletonVideoUrl", "minimapVideoUrl"):
            one = F.to_json(F.struct(name))
            told = F.concat(told, F.when(F.length(name) > 0, F.concat(F.lit(","), one.substr(F.lit(2), F.length(one) - 2))).otherwise(""))
    body = F.concat(
        F.lit('{"videoId":'), _id_json(), F.lit(',"videoFps":'), F.col("p.video_fps").cast("string"),
        F.lit(',"totalHits":'), F.col("p.total_hits").cast("string"), F.lit(',"hitsData":'), F.col("p.hits_data"), F.lit(',"netFaultEvents":'), F.col("p.net_fault_events"), told, F.lit("}"),
    )
    return p.select("video_id", body.alias("body"))


def summaries(videos: DataFrame, hits: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """(video_id, summary): a text of each video, also of those without a hit: how many hits and faults there are, a
    line per hit by number and, where there are any, a line per fault by time."""
    # The published texts.
    counted = "  타점 수             : {}개", "  네트 걸림           : {}건"
    top, bottom, wide, thin = "상단(블루)", "하단(골드)", "═" * 55, "─" * 55
    listed = lambda line, *order: F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    one = F.format_string("    #%02d  %6.2fs  %s", "hit_number", "time_sec", F.when(F.col("owner") == "top", top).otherwise(bottom))
    d = videos.select("video_id").join(hits.groupBy("video_id").agg(listed(one, "hit_number").alias("h")), "video_id", "left")
    if faults is None:
        d = d.withColumn("f", F.lit(None).cast("array<struct<time_sec:double,frame:int,line:string>>"))
    else:
        one = F.format_string("    %6.2fs  clearance=%+.1fpx  shuttle_y=%.1f  net_y=%.1f", "time_sec", "clearance_px", "shuttle_y", "net_top_y_at_x")
        d = d.join(faults.groupBy("video_id").agg(listed(one, "time_sec", "frame").alias("f")), "video_id", "left")
    lines = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["line"])
    count = lambda text, c: F.concat(F.lit(text.split("{}")[0]), F.coalesce(F.size(c), F.lit(0)).cast("string"), F.lit(text.split("{}")[1]))
    head = F.array(F.lit(wide), F.concat(F.lit("  "), "video_id"), F.lit(wide), count(counted[0], "h"), count(counted[1], "f"), F.lit(thin))
    told = F.when(F.size("f") > 0, F.concat(F.array(F.lit(thin), F.lit("  [NET_FAULT]")), lines(F.col("f")))).otherwise(F.array())
    return d.select("video_id", F.array_join(F.concat(head, lines(F.col("h")), told, F.array(F.lit(wide))), "\n").alias("summary"))


def failures(failed: DataFrame) -> DataFrame:
    """failed(video_id, error) -> (video_id, body): the message of each video that could not be analysed."""
    error = F.to_json(F.struct(F.coalesce(F.col("error").cast("string"), F.lit("")).alias("error")))
    return failed.select("video_id", F.concat(F.lit('{"videoId":'), _id_json(), F.lit(","), error.substr(F.lit(2), F.length(error) - 1)).alias("body"))
