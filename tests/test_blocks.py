"""Detection in blocks gives what detection of whole videos gives, wherever the cuts fall."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.config import CONFIG
from trackloom.functions.ranks import ranked
from trackloom.functions.stages import Shelf
from trackloom.operators import cleaning, peaks
from trackloom.plans import analysis, blocks
from trackloom.sources.trajectories import FRAMES, VIDEOS


def _jumpy(rng: random.Random, n: int) -> list[tuple[float, float]]:
    """A path with spikes, long zigzags (runs of detours of two), gaps and pauses."""
    out, x, y = [], 300.0, 400.0
    while len(out) < n:
        kind, k = rng.random(), rng.randrange(1, 60)
        for i in range(k):
            x, y = x + rng.uniform(-4, 9), y + rng.uniform(-8, 8)
            x, y = x % 1200 + 1, y % 650 + 1
            if kind < 0.25:
                out.append((x + (250 if i // 2 % 2 else 0), y))
            elif kind < 0.4:
                out.append((0.0, 0.0))
            elif kind < 0.6 and rng.random() < 0.2:
                out.append((x + rng.uniform(200, 400), y))
            else:
                out.append((x, y))
    return out[:n]


@pytest.fixture(scope="module")
def clips(spark):
    rng = random.Random(11)
    lengths = {"a": 700, "b": 331, "c": 9, "d": 3, "e": 1, "none": 5}
    rows = [(v, i, *p) for v, n in lengths.items() for i, p in enumerate(_jumpy(rng, n) if v != "none" else [(0.0, 0.0)] * n)]
    frames = spark.createDataFrame(rows, FRAMES)
    videos = spark.createDataFrame([(v, 1280, 720, 30.0, n) for v, n in lengths.items()], VIDEOS)
    return frames, videos


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("size", [8, 13, 50])
def test_cleaning_in_blocks_equals_cleaning_whole(spark, clips, size):
    points = cleaning.valid_points(clips[0])
    found = blocks.clean(Shelf(spark), points, size=size)
    whole = cleaning.clean(points)
    assert _rows(found, "video_id", "frame", "x", "y", "typical") == _rows(whole, "video_id", "frame", "x", "y", "typical")
    assert whole.count() < points.count()


def test_hits_in_blocks_equal_hits_of_whole_videos(spark, clips):
    frames, videos = clips
    owner_y = videos.select("video_id", F.lit(330.0).alias("owner_y"))
    columns = ("video_id", "hit_number", "frame", "time_sec", "score", "owner", "player", "method")
    whole = _rows(analysis.detect(frames, videos, owner_y, alternation=False).hits, *columns)
    assert whole and _rows(blocks.detect(frames, videos, owner_y, size=44), *columns) == whole
    assert blocks.detect(frames.filter("false"), videos, owner_y).count() == 0


def test_hits_of_frames_with_holes_and_odd_places(spark, clips):
    """Frame numbers that are left out, so that neighbours in the dense series are further apart, and infinite and missing places."""
    frames, videos = clips
    odd = F.when(F.col("frame") % 61 == 5, float("inf")).when(F.col("frame") % 67 == 9, float("nan")).when(F.col("frame") % 71 == 8, F.lit(None)).otherwise(F.col("x"))
    frames = frames.withColumn("x", odd).filter("frame % 7 <> 3 AND frame <> 0 AND frame NOT BETWEEN 200 AND 290")
    owner_y = videos.select("video_id", F.lit(330.0).alias("owner_y"))
    columns = ("video_id", "hit_number", "frame", "time_sec", "score", "owner")
    whole = _rows(analysis.detect(frames, videos, owner_y, alternation=False).hits, *columns)
    assert whole and _rows(blocks.detect(frames, videos, owner_y, size=16), *columns) == whole


def test_the_disk_holds_few_tables_at_a_time(spark, clips, monkeypatch):
    """At any time at most two tables of about all points are kept, and ranks are written of a small part of them."""
    frames, videos = clips
    points, held, ranks, put, drop = cleaning.valid_points(frames).count(), {}, [], Shelf.put, Shelf.drop

    def counted(shelf, name, df):
        out = put(shelf, name, df)
        held[name] = out.count()
        ranks.extend(held[name] for _ in [0] if "at" in out.columns or "__at" in out.columns)
        full.append(sorted(n for n, rows in held.items() if rows > 0.5 * points))
        return out

    def dropped(shelf, *names):
        drop(shelf, *names)
        for n in names:
            held.pop(n, None)

    full: list = []
    monkeypatch.setattr(Shelf, "put", counted)
    monkeypatch.setattr(Shelf, "drop", dropped)
    assert blocks.detect(frames, videos, videos.select("video_id", F.lit(330.0).alias("owner_y")), size=44).count()
    assert max(map(len, full)) == 2, max(full, key=len)
    assert ranks and sum(ranks) < points
    assert set(held) == {"hits"}


def test_quantiles_are_exact_for_any_values(spark):
    """Equal values, values in one bin, odd and even counts, infinity, and shares that differ by video."""
    rng = random.Random(5)
    values = {"wide": [rng.lognormvariate(0, 40) for _ in range(301)], "even": [rng.uniform(1, 900) for _ in range(200)], "one bin": [rng.uniform(100, 101) for _ in range(150)],
              "equal": [7.0] * 90, "two": [1.0, 1e300], "lone": [3.5], "far": [1e-320, 2.0, float("inf")]}
    rows = spark.createDataFrame([(v, x) for v, xs in values.items() for x in xs], "video_id string, v double").repartition(3)
    own = {v: 100.0 * i / len(values) for i, v in enumerate(values)}
    of = spark.createDataFrame(list(own.items()), "video_id string, own double")
    shares = {"q1": F.lit(0.25), "half": F.lit(0.5), "own": F.col("own") / 100.0}
    found = {r["video_id"]: r for r in blocks.quantiles(Shelf(spark), rows, "v", shares, "test", of.select("video_id", "own")).collect()}
    for v, xs in values.items():
        xs = sorted(xs)
        for name, share in (("q1", 0.25), ("half", 0.5), ("own", own[v] / 100.0)):
            pos = (len(xs) - 1) * share
            low, high = xs[math.floor(pos)], xs[math.ceil(pos)]
            assert found[v][name] == low + (high - low) * (pos - math.floor(pos)), (v, name)


def test_stretches_over_several_blocks_and_partitions(spark):
    """One long stretch a video, cut into many blocks, which a join without a broadcast deals over partitions."""
    rng = random.Random(3)
    rows = [(f"v{j}", i, 0.0 if i in (0, 399) else rng.uniform(1.0, 9.0)) for j in range(6) for i in range(400)]
    scores = spark.createDataFrame(rows, "video_id string, frame int, score double")
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        columns = ("video_id", "frame", "work", "prominence", "height")
        found = _rows(blocks._ridges(Shelf(spark), scores, CONFIG, 16), *columns)
        assert found and found == _rows(peaks.ridges(peaks.suppressed(scores), "work", "height"), *columns)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_block_holds_its_size_and_its_halo(spark):
    """A video of 50,000 frames, of which some are missing, in blocks of 1,000: places are gapless, blocks bounded."""
    points = spark.range(50_000).filter("id % 7 <> 3").select(F.lit("long").alias("video_id"), F.col("id").cast("int").alias("frame"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    p = blocks.numbered(points, 1_000)
    n = points.count()
    r = p.agg(F.min("k"), F.max("k"), F.countDistinct("k"), F.max("n"), F.max(F.abs(F.col("k") - (F.col("frame") - F.floor((F.col("frame") + 3) / 7))))).first()
    assert tuple(r) == (0, n - 1, n, n, 0)
    sizes = [r["count"] for r in blocks.in_blocks(p, 8, 1_000).groupBy("video_id").count().collect()]
    assert max(sizes) == 1_016 and len(sizes) == 43
    assert blocks.own(blocks.in_blocks(p, 8, 1_000)).count() == n


def test_ranks_of_a_group_with_many_equal_rows(spark, tmp_path):
    rows = [("hot", 5)] * 400 + [("hot", v) for v in (9, 1, None)] + [(None, 2), (None, 1), ("lone", 3)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = ranked(Shelf(spark), df, ["g"], ["v"]).collect()
    for g in ("hot", None, "lone"):
        own = sorted((r.at, r.v) for r in got if r.g == g)
        assert [at for at, _ in own] == list(range(len(own))) and all(r.total == len(own) for r in got if r.g == g)
        assert [v for _, v in own] == sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v or 0))
