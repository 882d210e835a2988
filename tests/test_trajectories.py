"""Golden values and row-loop versions of the trajectory operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions.folds import after_cooldown, keep_apart, strongest_apart
from trackloom.functions.geometry import court_to_canvas, homographies, net_line, normalized_to_minimap, project, project_pixel, signed_distance
from trackloom.operators import cleaning, crossings, owners, peaks, players, pose, rallies, render
from trackloom.plans import analysis, queries
from trackloom.sources import trajectories
from trackloom.sources.trajectories import FRAMES, POSE, VIDEOS


def frames_of(spark, points, video="v"):
    return spark.createDataFrame([(video, int(f), float(x), float(y)) for f, x, y in points], FRAMES)


def video(spark, n=300, fps=30.0, h=720, name="v"):
    return spark.createDataFrame([(name, 1280, h, fps, n)], VIDEOS)


def hit_table(spark, rows):
    return spark.createDataFrame(
        [("v", f, f / 30.0, float(s), o, o, i + 1, m) for i, (f, s, o, m) in enumerate(rows)],
        "video_id string, frame int, time_sec double, score double, owner string, player string, hit_number int, method string",
    )


def test_zigzag(spark):
    points = [(i, 320 + 2 * i, 500 - 2 * i) for i in range(100)]
    points += [(i, 520 + 2 * (i - 100), 300 + 2 * (i - 100)) for i in range(100, 200)]
    points += [(i, 720 - 2 * (i - 200), 500 - (i - 200)) for i in range(200, 300)]
    v = video(spark)
    d = analysis.detect(frames_of(spark, points), v, peaks.owner_thresholds(v))
    p = d.params.first()
    assert (p.avg_gap, p.min_flight, p.peak_distance) == (1.0, 24.0, 7) and p.min_speed == pytest.approx(0.707107, abs=1e-6)
    assert {r.frame: round(r.score, 6) for r in d.scores.filter("score > 0").collect()} == {99: 2.0, 100: 4.0, 101: 2.0}
    assert [(r.hit_number, r.frame, r.time_sec, r.player) for r in d.hits.collect()] == [(1, 99, 3.3, "top")]
    doc = analysis.documents(v, d.hits).first().document
    assert doc == '{"video_fps":30.0,"total_hits":1,"hits_data":[{"hit_number":1,"frame":99,"time_sec":3.3,"player":"top"}]}'


def test_missing_values(spark):
    nan = float("nan")
    raw = spark.createDataFrame([("v", i, x, y) for i, (x, y) in enumerate(zip([nan, 0.0, 5.0, -1.0, 7.0, None], [1.0, 2.0, 3.0, 4.0, 0.0, 1.0]))], FRAMES)
    assert [r.frame for r in cleaning.valid_points(trajectories.normalised(raw)).collect()] == [2]
    assert [r.frame for r in cleaning.valid_points(raw).collect()] == [2]


def test_csv(spark, tmp_path):
    (tmp_path / "clip_ball.csv").write_text(" X , Y ,Z\n0,0,1\n320,500,2\n,,3\n")
    rows = trajectories.read_trajectories(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r.video_id, r.frame, r.x, r.y) for r in rows] == [("clip", 0, 0.0, 0.0), ("clip", 1, 320.0, 500.0), ("clip", 2, 0.0, 0.0)]


def test_requests(spark):
    c = '{"videoId":9,"s3Url":"u","courtCorners":{"topLeft":{"x":1,"y":2},"topRight":{"x":3,"y":4},"bottomLeft":{"x":5,"y":6},"bottomRight":{"x":7,"y":8},"netTopLeft":{"x":9,"y":9}}}'
    r = trajectories.parse_requests(spark.createDataFrame([(c,)], "value string"))
    assert r.first().skeletonUploadUrl == ""
    k = trajectories.calibration_of(r).first()
    assert [(p.x, p.y) for p in k.corners] == [(1, 2), (3, 4), (7, 8), (5, 6)] and k.net is None


def test_crossing_golden(spark):
    f = frames_of(spark, [(10, 300, 300), (20, 320, 400), (22, 330, 310), (40, 340, 420), (60, 350, 300)])
    net = spark.createDataFrame([("v", 0.0, 330.0)], "video_id string, slope double, intercept double")
    rows = crossings.net_crossings(f, video(spark), net).orderBy("frame").collect()
    assert [(r.frame, r.direction, round(r.time_sec, 3)) for r in rows] == [(13, "top_to_bottom", 0.433), (25, "top_to_bottom", 0.833), (55, "bottom_to_top", 1.833)]
    assert all(abs(r.clearance_px) < 1e-6 and not r.is_fault for r in rows)


@pytest.mark.parametrize(
    "given, kept",
    [("10:5,16:7,30:3", [16, 30]), ("10:5,15:5,18:4", [10]), ("10:1,18:2,26:3", [26]), ("10:1,19:2", [10, 19])],
)
def test_score_nms(spark, given, kept):
    rows = [("v", *map(float, e.split(":"))) for e in given.split(",")]
    df = spark.createDataFrame([(v, int(f), s) for v, f, s in rows], "video_id string, frame int, score double")
    assert sorted(r.frame for r in peaks.strongest(df).collect()) == kept


def test_rallies(spark):
    h = hit_table(spark, [(0, 1, "bottom", "peaks"), (30, 1, "bottom", "peaks"), (60, 1, "bottom", "peaks"), (200, 1, "top", "peaks"), (290, 1, "top", "peaks")])
    r = rallies.alternate_owners(rallies.rallies(h, video(spark, 400))).orderBy("frame").collect()
    assert [x.rally for x in r] == [1, 1, 1, 2, 2] and [x.owner for x in r] == ["bottom", "top", "bottom", "top", "bottom"]


CORNERS = [(400.0, 300.0), (880.0, 300.0), (1100.0, 680.0), (180.0, 680.0)]


def test_verdicts(spark):
    want = {
        (700, 610): (199, 520, "in_bottom", "엔드라인(near)", 143.6, 3.412, 1.436),
        (560, 450): (146, 331, "in_bottom", "좌측 사이드라인", 194.2, 2.402, 5.958),
        (190, 675): (46, 576, "in_bottom", "좌측 사이드라인", 3.6, 0.496, 0.096),
        (933, 517): (288, 422, "in_bottom", "우측 사이드라인", 53.1, 5.109, 3.781),
        (1150, 690): (328, 587, "out", "엔드라인(near)", -16.7, 5.871, -0.167),
        (300, 400): (24, 247, "out", "좌측 사이드라인", -38.4, 0.076, 7.968),
    }
    calib = spark.createDataFrame([("v", CORNERS, None)], trajectories.CALIBRATION)
    maps = analysis.calibrated(video(spark), calib)
    m = maps.first()
    assert m.net_y_minimap == 300.0 and m.coordinate_mode == "user_singles" and m.minimap_pts[0].x == pytest.approx(44.131149, abs=1e-3)
    drops = spark.createDataFrame([("v", i + 1, 10 * i, float(x), float(y), 1, "top") for i, (x, y) in enumerate(want)], "video_id string, rally int, frame int, sx double, sy double, last_hit_number int, last_hit_owner string")
    for r in rallies.judge_drops(drops, maps).collect():
        got = (r.mx, r.my, r.location, r.nearest_line, round(r.margin_cm, 1), round(r.court_x, 3), round(r.court_y, 3))
        assert got[:4] == want[(r.sx, r.sy)][:4] and got[4:] == pytest.approx(want[(r.sx, r.sy)][4:], abs=0.11)
        assert r.verdict.startswith(r.nearest_line)


@pytest.mark.parametrize("place, pixel", [((280.24, 75.0), 27), ((196.48, 76.0), -6), ((261.52, 81.0), 27)])
def test_drops_a_hair_from_a_whole_pixel(spark, place, pixel):
    """Places whose pixel another one takes if they are cut to single precision before they are mapped."""
    maps = analysis.calibrated(video(spark, h=100), None)
    drops = spark.createDataFrame([("v", 1, 10, *place, 1, "top")], "video_id string, rally int, frame int, sx double, sy double, last_hit_number int, last_hit_owner string")
    assert pixel in tuple(rallies.judge_drops(drops, maps).select("mx", "my").first())
    on_map = players.minimap_players(spark.createDataFrame([("v", 10, 0, 1, person(k15=(*place, 0.9), k16=(*place, 0.9)))], POSE), maps).select("mx", "my").collect()
    assert all(pixel in tuple(r) for r in on_map)


def test_auto_map(spark):
    maps = analysis.calibrated(video(spark), None)
    df = spark.createDataFrame([(560.0, 450.0), (700.0, 610.0), (400.0, 600.0)], "x double, y double").crossJoin(maps)
    mx, my = project(F.col("to_minimap"), F.col("x"), F.col("y"))
    got = {r.x: (r.mx, r.my) for r in df.select("x", mx.alias("mx"), my.alias("my")).collect()}
    for x, want in {560.0: (141.8406, 261.9753), 700.0: (203.5328, 486.9378), 400.0: (84.8113, 475.2468)}.items():
        assert got[x] == pytest.approx(want, abs=1e-3)
    assert maps.first().coordinate_mode == "auto_ratio"
    with pytest.raises(Exception, match="4 corners"):
        analysis.calibrated(video(spark), spark.createDataFrame([("v", CORNERS[:3], None)], trajectories.CALIBRATION)).collect()


def test_landing(spark):
    xs = [100, 110, 120, 130, 140, 150, 147, 144, 141, 138, 135, 132]
    f = frames_of(spark, [(3 + i, x, 300) for i, x in enumerate(xs)])
    last = spark.createDataFrame([("v", 1, 0, 1, "top")], "video_id string, rally int, frame int, hit_number int, owner string")
    r = rallies.landings(last, f, video(spark, 20)).first()
    assert (r.frame, r.sx, r.sy) == (9, 147.0, 300.0)
    short = frames_of(spark, [(3, 1, 1), (4, 2, 2), (10, 3, 3)])
    assert rallies.landings(last, short, video(spark, 20)).first().frame == 4
    assert rallies.landings(last, frames_of(spark, [(200, 1, 1)]), video(spark, 300)).count() == 0


def test_ghosts(spark):
    seen = spark.createDataFrame([("v", 0, "top", 1), ("v", 5, "top", 2)], "video_id string, frame int, side string, mx int")
    dense = players.ghosts(frames_of(spark, [(i, 1, 1) for i in range(6)]), seen, "mx").filter("side = 'top'").orderBy("frame").collect()
    assert [r.mx for r in dense] == [1, 1, 1, 1, None, 2]


@pytest.mark.parametrize("offset, removed", [(45, {30}), (60, {30}), (100, {30}), (300, set())])
def test_spikes(spark, offset, removed):
    points = [(i, 100 + 10 * i, 300 + (offset if i == 30 else 0)) for i in range(40)]
    left = {r.frame for r in cleaning.clean(frames_of(spark, points)).collect()}
    assert set(range(40)) - left == removed


def loop_clean(points):
    """The cleaning rules as plain loops over (frame, x, y)."""
    d = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2])
    med = lambda v: sorted(v)[len(v) // 2] if len(v) % 2 else sum(sorted(v)[len(v) // 2 - 1 : len(v) // 2 + 1]) / 2
    if len(points) < 4:
        return points
    moved = [s for s in (d(a, b) for a, b in zip(points, points[1:])) if s > 0]
    least = 2 * (med(moved) if moved else 1.0)
    for _ in range(2):
        n = len(points)
        if n < 4:
            break
        bad = [False] * n
        for i in range(1, n - 1):
            a, b, c = points[i - 1 : i + 2]
            if d(a, c) >= 1 and (d(a, b) + d(b, c)) / d(a, c) > (5 if i < 25 else 2.5) and max(d(a, b), d(b, c)) > least:
                bad[i] = True
        for i in range(1, n - 2):
            a, b, c, e = points[i - 1 : i + 3]
            if not bad[i] and not bad[i + 1] and d(a, e) >= 1 and (d(a, b) + d(b, c) + d(c, e)) / d(a, e) > 2.5 and max(d(a, b), d(c, e)) > least:
                bad[i] = bad[i + 1] = True
        speed = [d(a, b) / max(b[0] - a[0], 1) for a, b in zip(points, points[1:])]
        usual = med([s for s in speed if s > 0]) if any(s > 0 for s in speed) else 1.0
        for j in range(1, n - 1):
            r = usual * (6 if j < 25 else 4)
            if not bad[j] and (speed[j - 1] > r and speed[j] > r or max(speed[j - 1 : j + 1]) > 12 * usual):
                bad[j] = True
        j = 0
        while j < n:
            k = j
            while k < n and bad[k]:
                k += 1
            if k - j >= 3:
                bad[j:k] = [False] * (k - j)
            j = max(k, j + 1)
        points = [p for p, b in zip(points, bad) if not b]
    return points


def test_cleaning_equals_loops(spark):
    rng, want, rows = random.Random(3), {}, []
    for v in range(25):
        x, y, points = 300.0, 300.0, []
        for f in range(60):
            x, y = x + rng.uniform(-6, 9), y + rng.uniform(-6, 6)
            jump = rng.choice([0] * 12 + [30, 60, -80, 150])
            if rng.random() < 0.9:
                points.append((f, x + jump, y - jump))
        want[str(v)] = [p[0] for p in loop_clean(points)]
        rows += [(str(v), *p) for p in points]
    got: dict = {k: [] for k in want}
    for r in cleaning.clean(spark.createDataFrame(rows, FRAMES)).orderBy("video_id", "frame").collect():
        got[r.video_id].append(r.frame)
    assert got == want


def test_plateaus_and_prominence(spark):
    values = [0, 1, 3, 3, 3, 1, 2, 0, 5, 4.5, 4.8, 0, 7]
    s = spark.createDataFrame([("v", i, float(v)) for i, v in enumerate(values)], "video_id string, frame int, score double")
    found = peaks.local_maxima(s, "score")
    assert sorted(r.frame for r in found.collect()) == [3, 6, 8, 10]
    got = {r.frame: round(r.prominence, 6) for r in peaks.prominences(found, s, "score").collect()}
    assert got == {3: 3.0, 6: 1.0, 8: 5.0, 10: 0.3}


def test_folds(spark):
    df = spark.sql("SELECT array(named_struct('frame', 9, 'score', 9D), named_struct('frame', 3, 'score', 5D), named_struct('frame', 12, 'score', 4D)) e")
    kind = "struct<frame:int,score:double>"
    assert [x.frame for x in df.select(keep_apart(F.col("e"), F.lit(5), kind)).first()[0]] == [9, 3]
    assert [x.frame for x in df.select(strongest_apart(F.array_sort("e"), 5, kind)).first()[0]] == [3, 9]
    c = spark.sql("SELECT array(named_struct('trigger', 5, 'frame', 4), named_struct('trigger', 18, 'frame', 17), named_struct('trigger', 30, 'frame', 21)) e")
    assert [x.frame for x in c.select(after_cooldown(F.col("e"), 15, "struct<trigger:int,frame:int>")).first()[0]] == [4, 21]


def test_crossing_owners(spark):
    h = hit_table(spark, [(10, 1, "bottom", "peaks"), (20, 1, "bottom", "peaks"), (45, 1, "top", "peaks"), (200, 1, "top", "peaks")])
    c = spark.createDataFrame([("v", 25, 26, "top", "bottom"), ("v", 30, 31, "bottom", "top")], "video_id string, frame int, trigger int, hitter_side string, receiver_side string")
    got = {r.frame: (r.owner, r.player, r.method) for r in crossings.apply_crossing_owners(h, c).collect()}
    assert got[20] == ("top", "pink_top", "peaks_crossed") and got[10] == ("bottom", "green_bottom", "peaks_crossed")
    assert got[45] == ("bottom", "green_bottom", "peaks_crossed") and got[200] == ("top", "top", "peaks")


def test_alternation(spark):
    v, y = video(spark, 300, 30.0, 100), [(i, 10, 40) for i in range(300)]
    oy = spark.createDataFrame([("v", 50.0)], "video_id string, owner_y double")
    fix = lambda rows: [r.owner for r in owners.correct_alternation(hit_table(spark, rows), frames_of(spark, y), v, oy).orderBy("frame").collect()]
    assert fix([(10, 1, "top", "peaks"), (20, 1, "top", "peaks")]) == ["top", "bottom"]
    assert fix([(10, 1, "top", "peaks"), (20, 9, "top", "peaks")]) == ["bottom", "top"]
    assert fix([(10, 9, "top", "peaks"), (20, 1, "top", "peaks_crossed")]) == ["bottom", "top"]
    assert fix([(10, 1, "top", "a_pose"), (20, 1, "top", "b_pose")]) == ["top", "top"]
    assert fix([(10, 1, "top", "peaks"), (40, 1, "top", "peaks")]) == ["top", "top"]


def person(**points):
    kps = [(0.0, 0.0, 0.0)] * 17
    for k, p in points.items():
        kps[int(k[1:])] = tuple(map(float, p))
    return kps


def test_pose(spark):
    rows = [
        ("v", 11, 0, 1, person(k9=(105, 100, 0.9), k15=(100, 300, 0.9), k16=(110, 310, 0.9))),
        ("v", 11, 1, 2, person(k10=(190, 100, 0.9), k11=(100, 80, 0.9), k12=(100, 90, 0.9))),
        ("v", 50, 0, 1, person(k9=(101, 100, 0.9), k0=(9, 20, 0.5))),
    ]
    p = spark.createDataFrame(rows, POSE)
    f, v = frames_of(spark, [(i, 100, 100) for i in range(60)]), video(spark, 60)
    h = hit_table(spark, [(10, 1, "top", "peaks"), (30, 1, "top", "peaks")])
    near = {r.frame: (r.dist, r.center_y) for r in pose.nearest_wrists(h, f, p, v).collect()}
    assert near == {10: (5.0, 305.0)}
    oy = spark.createDataFrame([("v", 200.0)], "video_id string, owner_y double")
    got = {r.frame: (r.owner, r.method) for r in pose.apply_pose_owners(h, pose.nearest_wrists(h, f, p, v), oy).collect()}
    assert got == {10: ("bottom", "peaks_pose"), 30: ("top", "peaks")}
    centers = {(r.frame, r.person_idx): (r.a, r.b) for r in p.select("frame", "person_idx", pose.body_center_y().alias("a"), pose.rescue_center_y().alias("b")).collect()}
    assert centers == {(11, 0): (305.0, 100.0), (11, 1): (85.0, 85.0), (50, 0): (60.0, 60.0)}
    feet = {(r.frame, r.person_idx): (r.f.x, r.f.y) for r in p.select("frame", "person_idx", pose.foot_center().alias("f")).collect()}
    assert feet == {(11, 0): (105.0, 305.0), (11, 1): (0.0, 0.0), (50, 0): (0.0, 0.0)}
    assert {r.frame for r in pose.pose_window(p, h, v).collect()} == {11}
    scores = spark.createDataFrame([("v", i, 10.0 if i == 30 else 1.0 if i in (49, 50) else 0.0) for i in range(60)], "video_id string, frame int, score double")
    params = spark.createDataFrame([("v", 7)], "video_id string, peak_distance int")
    rescued = pose.rescue_hits(h, scores, params, f, p, v, oy).orderBy("frame").collect()
    assert [(r.frame, r.hit_number, r.method) for r in rescued] == [(10, 1, "peaks"), (30, 2, "peaks"), (49, 3, "rescue_pose")]
    assert {r.frame for r in pose.near_misses(scores, h, params).collect()} == {49, 50}


def test_trails_are_the_last_detections(spark):
    seen = [(v, f, side, f * 3 % 50, f % 40) for v, n in (("a", 95), ("b", 5), ("c", 30)) for f in range(n) for side in ("top", "bottom") if side == "top" or f % 3]
    rows = spark.createDataFrame(seen, "video_id string, frame int, side string, mx int, my int")
    for length in (30, 7, 1):
        got = {(r.video_id, r.frame, r.side): [tuple(p) for p in r.trail] for r in players.player_trails(rows, length).collect()}
        want = {(v, f, s): [(x, y) for w, g, t, x, y in seen if (w, t) == (v, s) and g <= f][-length:] for v, f, s, _, _ in seen}
        assert got == want


@pytest.mark.parametrize("name", ["body_center", "player_trail", "bone_segments", "pose_owner"])
def test_poses_of_all_frames_are_not_kept(spark, monkeypatch, name):
    """Poses are many times wider than what is read off them; none of the tables written down holds key points."""
    written = []
    for module in (queries, analysis, players):
        monkeypatch.setattr(module, "keep", lambda df, own=module.keep: written.append(df.columns) or own(df))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns[0] == "video_id"
    assert written and not any("keypoints" in columns for columns in written)


def test_cleaning_sorts_once(spark):
    """All windows of both passes go by frame: no video's rows are sorted anew for a run of spikes."""
    points = frames_of(spark, [(i, 10 + (90 if i in (7, 12, 13, 20, 21, 22) else 0), 5 + i % 3) for i in range(30)]).withColumn("typical", F.lit(1.0))
    numbered = cleaning.detours(cleaning.numbered(points), cleaning.CONFIG).withColumn("usual", F.lit(1.0))
    plan = cleaning.spikes(numbered, cleaning.CONFIG)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert len([line for line in plan if "Sort [" in line]) == 1


@pytest.mark.parametrize("flags", ["0110100", "0111011", "0111100", "0000111", "01", "0111", "010", "0101011"])
def test_runs_of_spikes_by_hand(spark, flags):
    """Speeds that are far too high make spikes; runs of 3 and more stay, wherever they end."""
    rows = [("v", i, i, len(flags), 10.0**6 if f == "1" else 1.0) for i, f in enumerate(flags)]
    p = spark.createDataFrame(rows, "video_id string, frame int, k int, n int, s_in double")
    p = p.withColumns({"s_out": F.lit(1.0), "usual": F.lit(1.0), "one": F.lit(False), "two": F.lit(False)})
    got = {r.frame for r in cleaning.spikes(p, cleaning.CONFIG).filter("gone").collect()}
    flagged = lambda k: 0 < k < len(flags) - 1 and flags[k] == "1"
    everywhere = {r.frame for r in cleaning.spikes(p, cleaning.CONFIG).filter("spike").collect()}
    run = lambda k: next(b - a - 1 for a in range(k, -1, -1) if a not in everywhere for b in range(k, len(flags) + 1) if b not in everywhere)
    assert {k for k in range(len(flags)) if flagged(k)} <= everywhere
    assert got == ({k for k in everywhere if run(k) < cleaning.CONFIG.longest_spike} if len(flags) >= 4 else set())


def test_court_test_stays_out_of_joins(spark):
    """The long test of a place against the court is worked out once a row, not in the join's own condition."""
    maps = players.view_maps(analysis.calibrated(video(spark), None), video(spark))
    rows = spark.createDataFrame([("v", 10, 0, 1, person(k15=(600, 600, 0.9), k16=(600, 600, 0.9)))], POSE)
    for found in (players.minimap_players(rows, maps), players.court_players(rows, maps, video(spark))):
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [line for line in plan if "Join" in line]
        assert joins and not [line for line in joins if "SQRT" in line.upper() or "lambdafunction" in line]


def test_court_players(spark):
    maps = players.view_maps(analysis.calibrated(video(spark), spark.createDataFrame([("v", CORNERS, None)], trajectories.CALIBRATION)), video(spark))
    at = lambda x, y: person(k15=(x, y, 0.9), k16=(x, y, 0.9))
    rows = [("v", 0, i, i, at(600, y)) for i, y in enumerate((600, 640, 660))] + [("v", 1, 0, 0, at(600, 320)), ("v", 1, 1, 1, at(600, 660)), ("v", 2, 0, 0, at(10, 10))]
    got = {(r.frame, r.side): r.person_idx for r in players.court_players(spark.createDataFrame(rows, POSE), maps, video(spark)).collect()}
    assert got == {(0, "top"): 0, (0, "bottom"): 2, (1, "top"): 0, (1, "bottom"): 1}
    on_map = players.minimap_players(spark.createDataFrame(rows, POSE), maps)
    assert {(r.frame, r.side) for r in on_map.collect()} == {(0, "bottom"), (1, "top"), (1, "bottom")}
    marks = players.hit_markers(hit_table(spark, [(1, 1, "top", "p"), (0, 1, "top", "p")]), None, on_map)
    assert {r.frame for r in marks.collect()} == {1}
    assert render.bone_segments(spark.createDataFrame(rows, POSE), maps).count() == 0


def test_geometry(spark):
    one = spark.range(1)
    c = one.select(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in CORNERS)).alias("c"))
    h = c.select(*(v.alias(k) for k, v in homographies(F.col("c"), F.lit(1280), F.lit(720)).items()))
    px, py = project_pixel(F.col("to_normalized"), F.lit(1100.0), F.lit(680.0))
    assert tuple(h.select(px, py).first()) in {(1, 1), (0, 0), (0, 1), (1, 0)}
    assert court_to_canvas(0, 6.7)[1] == 300.0
    net = one.select(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((5.0, 1.0), (5.0, 3.0)))).alias("n"))
    assert tuple(net.select(*net_line(F.col("n"))).first()) == (0.0, 2.0)
    square = [(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))]
    for p, want in (((5.0, 4.0), 4.0), ((0.0, 3.0), 0.0), ((13.0, 14.0), -5.0)):
        assert one.select(signed_distance(F.lit(p[0]), F.lit(p[1]), square)).first()[0] == pytest.approx(want)
    assert tuple(one.select(*normalized_to_minimap(F.lit(0.5), F.lit(2.0))).first()) == (180, 599)


def test_whole_analysis(spark):
    points = [(i, 600 + 40 * math.sin(i / 7) + i, 400 + 150 * math.sin(i / 9)) for i in range(240)]
    v = video(spark, 240)
    calib = spark.createDataFrame([("v", CORNERS, [(400.0, 400.0), (900.0, 400.0)])], trajectories.CALIBRATION)
    rows = [("v", i, j, j, person(k9=(600 + 40 * math.sin(i / 7) + i + 5 * j, y, 0.9), k15=(620, y, 0.9), k16=(640, y, 0.9))) for i in range(240) for j, y in enumerate((330, 650))]
    out = analysis.analyze(frames_of(spark, points), v, calib, spark.createDataFrame(rows, POSE))
    assert out["crossings"].count() > 3 and out["faults"].count() == 0 and out["hits"].count() >= 1
    assert {r.owner for r in out["hits"].collect()} <= {"top", "bottom"}
    doc = out["documents"].first().document
    assert '"coordinate_mode":"user_singles"' in doc and '"net_fault_events":[]' in doc
    assert out["court_players"].count() > 0 and out["hit_markers"].count() >= 0 and out["marks"].count() >= 0
    n = out["hits"].count()
    assert out["ghosts"].count() == 2 * len(points) and out["ghosts"].filter("at IS NOT NULL").count() > 0
    assert out["player_trails"].filter("size(trail) = 30").count() > 0 and out["bones"].count() >= 0 and out["shuttle_trail"].count() > 0
    drawn = {r["layer"]: r["n"] for r in out["frame_overlays"].groupBy("layer").agg(F.count("*").alias("n")).collect()}
    assert drawn["impact"] == drawn["tint"] == out["impacts"].filter("impact").count() and drawn["frame"] == out["impacts"].count()
    assert drawn.get("fault", 0) == out["fault_flags"].filter("fault").count() and out["view_court"].filter("z = 13").count() == 1
    assert out["player_dots"].count() == 3 * out["ghosts"].filter("at IS NOT NULL").count()
    assert out["overlays"].filter("layer = 'impact'").count() == n and out["impacts"].filter("impact").count() >= n and out["fault_flags"].filter("fault").count() == 0
    told = out["summaries"].first().summary.split("\n")
    assert told[3].endswith(f" {n}개") and told[4].endswith(" 0건") and len(told) == 7 + n
    assert '"totalHits":' in analysis.callbacks(v, out["hits"], out["faults"]).first().body
