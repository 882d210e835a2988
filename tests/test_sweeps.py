"""Sweeps and binned joins against plain versions: prominence, claims of crossings, points in spans."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from trackloom.functions.intervals import inside
from trackloom.functions.sweeps import claims, prominent_maxima
from trackloom.operators import crossings, peaks


def _prominences(values):
    """frame: (value, prominence) of strict local maxima, every side walked."""
    found, i, n = {}, 0, len(values)
    while i < n:
        j = i
        while j + 1 < n and values[j + 1] == values[i]:
            j += 1
        v = values[i]
        if 0 < i and j + 1 < n and values[i - 1] < v > values[j + 1]:
            lows = []
            for way in (range(i, -1, -1), range(j, n)):
                low = v
                for k in way:
                    if values[k] > v:
                        break
                    low = min(low, values[k])
                lows.append(low)
            found[(i + j) // 2] = (v, v - max(lows))
        i = j + 1
    return found


def _swept(rule, rows, names, size):
    step, out = rule, []
    for i in range(0, len(rows), size):
        out += step(dict(zip(names, map(list, zip(*rows[i : i + size])))))
    return out + step(None)


def _series(values, video="v"):
    n = len(values)
    return [
        (video, i, v, values[i - 1] if i else None, values[i + 1] if i + 1 < n else None, 0.5) for i, v in enumerate(values) if v > 0
    ]


_NAMES = ("video_id", "frame", "v", "before", "after", "height")


def test_prominences_equal_walks_on_both_sides():
    rng = random.Random(2)
    for t in range(400):
        values = [float(rng.choice([0, 0, 1, 2, 3, 4, 5][t % 3 :])) for _ in range(rng.randrange(1, 60))]
        got = _swept(prominent_maxima(), _series(values), _NAMES, rng.choice([1, 7, 100]))
        assert {f: (v, p) for _, f, v, p, _ in got} == _prominences(values), values


@pytest.mark.parametrize("shape", ["rising", "falling", "comb", "flat", "mountains"])
def test_a_stretch_of_many_samples_takes_linear_time(shape):
    n = 200_000
    make = {
        "rising": lambda i: i + 1.0, "falling": lambda i: n - i + 0.0, "comb": lambda i: 1.0 + i % 2, "flat": lambda i: 3.0,
        "mountains": lambda i: 1.0 + (i ^ (i >> 1)) % 1021,
    }[shape]
    values = [make(i) for i in range(n)]
    rows = _series(values)
    began = time.process_time()
    got = _swept(prominent_maxima(), rows, _NAMES, 10_000)
    assert time.process_time() - began < 10  # a walk per peak would take hours for the comb
    assert len(got) == {"rising": 0, "falling": 0, "comb": n // 2 - 1, "flat": 0}.get(shape, len(got))


def test_ridges_of_several_videos(spark):
    rng = random.Random(4)
    series = {f"v{k}": [float(rng.choice([0, 1, 1, 2, 5])) for _ in range(80)] for k in range(7)}
    rows = [(v, i, x) for v, values in series.items() for i, x in enumerate(values)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "video_id string, frame int, score double")
    got = {}
    for r in peaks.ridges(df, "score").collect():
        got.setdefault(r.video_id, {})[r.frame] = (r.score, r.prominence)
    assert got == {v: found for v, values in series.items() if (found := _prominences(values))}
    assert peaks.ridges(df.filter("false"), "score").count() == 0


def _claims(hits, crossed, reach):
    free, out = set(hits), []
    for frame, hitter, _ in crossed:
        if near := [h for h in free if frame - reach <= h < frame]:
            free.discard(max(near))
            out.append((max(near), hitter))
    for frame, _, receiver in crossed:
        if near := [h for h in free if frame < h <= frame + reach]:
            free.discard(min(near))
            out.append((min(near), receiver))
    return sorted(out)


def _events(hits, crossed, video="v"):
    events = sorted([(f, 0, h, r) for f, h, r in crossed] + [(f, 1, None, None) for f in hits], key=lambda e: e[:2])
    return [(video, f, f - events[i - 1][0] if i else None, h, r) for i, (f, _, h, r) in enumerate(events)]


def test_claims_equal_a_search_of_all_hits():
    rng, names = random.Random(5), ("video_id", "frame", "wait", "hitter_side", "receiver_side")
    for _ in range(500):
        hits = sorted(rng.sample(range(500), rng.randrange(40)))
        crossed = sorted((rng.randrange(500), *rng.choice([("top", "bottom"), ("bottom", "top")])) for _ in range(rng.randrange(25)))
        got = _swept(claims(30), _events(hits, crossed), names, rng.choice([1, 9]))
        assert sorted((f, side) for _, f, side in got) == _claims(hits, crossed, 30)


def test_crossing_owners_of_a_day_long_video(spark):
    """A day at 30 frames a second, an event every second: one pass, and each hit is claimed once."""
    n = 86_400
    hits = spark.range(n).select(
        F.lit("day").alias("video_id"), (F.col("id") * 30).cast("int").alias("frame"), F.lit("top").alias("owner"), F.lit("top").alias("player"), F.lit("peaks").alias("method")
    )
    sides = [F.when(F.col("id") % 2 == 0, a).otherwise(b) for a, b in (("top", "bottom"), ("bottom", "top"))]
    crossed = spark.range(n).select(
        F.lit("day").alias("video_id"), (F.col("id") * 30 + 15).cast("int").alias("frame"), (F.col("id") * 30 + 16).cast("int").alias("trigger"),
        sides[0].alias("hitter_side"), sides[1].alias("receiver_side"),
    )
    owned = crossings.apply_crossing_owners(hits, crossed)
    r = owned.agg(F.count("*").alias("n"), F.count_if(F.col("method") == "peaks_crossed").alias("claimed"), F.count_if((F.col("frame") / 30 % 2 == 0) == (F.col("owner") == "top")).alias("right")).first()
    assert (r.n, r.claimed, r.right) == (n, n, n)


def test_rows_of_both_kinds_stay_in_order_whatever_their_partitions(spark):
    """Hits and crossings that come hashed by video already, in different numbers of parts."""
    hits = spark.createDataFrame([(f"v{k}", f, "top", "top", "peaks") for k in range(9) for f in (1, 31, 54)], "video_id string, frame int, owner string, player string, method string")
    crossed = spark.createDataFrame([(f"v{k}", f, f + 1, "bottom", "top") for k in range(9) for f in (2, 50)], "video_id string, frame int, trigger int, hitter_side string, receiver_side string")
    grouped = lambda df: df.groupBy("video_id").agg(F.collect_list(F.struct(*(c for c in df.columns if c != "video_id"))).alias("e")).select("video_id", F.explode("e").alias("e")).select("video_id", "e.*")
    got = crossings.apply_crossing_owners(grouped(hits), grouped(crossed)).collect()
    assert sorted((r.video_id, r.frame, r.method, r.owner) for r in got) == sorted(
        (f"v{k}", f, "peaks_crossed", o) for k in range(9) for f, o in ((1, "bottom"), (31, "bottom"), (54, "top"))
    )


@pytest.mark.parametrize("width", [1, 7, 64])
def test_points_in_spans_equal_all_pairs(spark, width):
    rng = random.Random(width)
    points = [(f"v{rng.randrange(3)}", rng.randrange(200)) for _ in range(120)]
    spans = [(f"v{rng.randrange(4)}", i, lo := rng.randrange(-20, 200), lo + rng.randrange(-5, 90)) for i in range(40)]
    p = spark.createDataFrame(points, "video_id string, frame int")
    s = spark.createDataFrame(spans, "video_id string, span int, low int, high int")
    got = inside(p, s, F.col("low"), F.col("high"), width=width).select("video_id", "frame", "span").collect()
    want = [(v, f, i) for v, f in points for w, i, lo, hi in spans if v == w and lo <= f <= hi]
    assert sorted(map(tuple, got)) == sorted(want)
    away = inside(p, s, F.col("low"), F.col("high"), "left_anti", width).collect()
    assert sorted(map(tuple, away)) == sorted(x for x in points if not any(v == x[0] and lo <= x[1] <= hi for v, _, lo, hi in spans))


def test_a_binned_join_makes_rows_by_its_result(spark):
    """100,000 points of one video and 1,000 short spans: what is compared is near what is found."""
    p = spark.range(100_000).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("frame"))
    s = spark.range(1_000).select(F.lit("v").alias("video_id"), (F.col("id") * 100).cast("int").alias("low"))
    assert inside(p, s, F.col("low"), F.col("low") + 9).count() == 10_000
    plan = inside(p, s, F.col("low"), F.col("low") + 9)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "bin" in plan


def test_columns_as_lists():
    import pyarrow as pa

    from trackloom.functions.sweeps import listed

    nan = float("nan")
    for values, kind in (([1, None, 3], pa.int32()), ([0.5, None, nan, 0.0], pa.float64()), ([], pa.float64()), (["a", "b", "a"], pa.string()), (["a", None], pa.string()), ([None, None], pa.float64())):
        column = pa.array(values, kind)
        assert repr(listed(column)) == repr(column.to_pylist()) and repr(listed(column[1:])) == repr(column[1:].to_pylist())
