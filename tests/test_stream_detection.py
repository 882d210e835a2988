"""Cleaning and impulses over a stream give what the batch plans give, and replays change nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_blocks import _jumpy, _rows
from trackloom.operators import cleaning, impulse
from trackloom.sources.trajectories import FRAMES, VIDEOS
from trackloom.streaming import detection

POINT = ("video_id", "frame", "x", "y")
JUDGED = (*POINT, "impulse", "dropped")


def _videos(spark, lengths):
    return spark.createDataFrame([(v, 1280, 720, 30.0, n) for v, n in lengths.items()], VIDEOS)


def _stream(spark, frames, videos, path, cuts, hold, query="q"):
    """A micro-batch a stretch of frames."""
    for i, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], 1 << 30])):
        frames.filter(f"frame >= {lo} AND frame < {hi}").coalesce(1).write.parquet(str(path / "in" / f"part={i:02d}"))
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(path / "in" / "*"))
    detection.stream_impulses(stream, videos, str(path / "out"), str(path / "check"), query, hold).awaitTermination()


def _batch(frames, videos):
    cleaned = cleaning.clean(cleaning.valid_points(frames))
    return cleaned, impulse.judged_points(cleaned, cleaning.adaptive_parameters(cleaned, videos))


def test_sketched_quantiles_are_exact_up_to_their_size(spark):
    rng = random.Random(3)
    rows = [(v, rng.choice([rng.random(), 0.5])) for v, n in (("a", 1), ("b", 2), ("c", 1001)) for _ in range(n)]
    df = spark.createDataFrame(rows, "v string, x double").repartition(5)
    one, two = (df.filter(f"x {op} 0.5").groupBy("v").agg(F.kll_sketch_agg_double("x", detection.SKETCH).alias(n)) for op, n in (("<", "s"), (">=", "t")))
    both = one.join(two, "v", "full").withColumn("s", F.coalesce(F.kll_sketch_merge_double("s", "t"), "s", "t"))
    shares = (0.0, 0.25, 0.5, 0.853, 1.0)
    got = {r["v"]: r[1:] for r in both.select("v", *(detection.quantile("s", s).alias(f"q{s}") for s in shares), detection.median("s")).collect()}
    want = {r["v"]: r[1] for r in df.groupBy("v").agg(F.percentile("x", F.array(*map(F.lit, shares)))).collect()}
    assert got.keys() == want.keys()
    for v in got:
        assert list(got[v]) == pytest.approx([*want[v], want[v][2]], abs=1e-12)


def test_short_videos_give_what_the_batch_plans_give(spark, tmp_path):
    """Videos of up to `hold` points, cut anywhere; what comes twice or late changes nothing."""
    rng = random.Random(5)
    lengths = {"a": 260, "b": 131, "c": 9, "d": 3, "e": 1, "none": 5}
    rows = [(v, i, *p) for v, n in lengths.items() for i, p in enumerate(_jumpy(rng, n) if v != "none" else [(0.0, 0.0)] * n)]
    frames, videos = spark.createDataFrame(rows, FRAMES), _videos(spark, lengths)
    _stream(spark, frames.unionAll(frames.filter("frame = 5")), videos, tmp_path, [0, 2, 150], 1000)
    cleaned, judged = _batch(frames, videos)
    got = detection.read_cleaned(spark, str(tmp_path / "out"), "q")
    assert _rows(got, *POINT) == _rows(cleaned, *POINT) and got.count() < cleaning.valid_points(frames).count()
    seen = _rows(detection.read_impulses(spark, str(tmp_path / "out"), "q"), *JUDGED)
    assert seen == _rows(judged, *JUDGED) and any(r[-1] is None for r in seen)
    # The last batch again: it has its line, and nothing changes; late frames of ended videos are left out.
    for number in (2, 3):
        detection._advance(frames, number, videos, str(tmp_path / "out"), "q", 1000, detection.CONFIG)
    assert _rows(detection.read_impulses(spark, str(tmp_path / "out"), "q"), *JUDGED) == seen
    state = spark.read.parquet(str(tmp_path / "out" / "state" / "q" / "3" / "state"))
    assert state.filter("ended AND steps IS NULL").count() == len(lengths)
    assert not (tmp_path / "out" / "state" / "q" / "1").exists()


def _steady(rng: random.Random, n: int) -> list[tuple[float, float]]:
    """Steps of 5 for the most part, so that every median stands from the start; spikes, zigzags and gaps."""
    out, x = [], 100
    while len(out) < n:
        out += [(float(x + 5 * i), 300.0) for i in range(rng.randrange(14, 30))]
        x = int(out[-1][0]) % 600 + 5
        kind, k = rng.random(), rng.randrange(1, 9)
        if kind < 0.4:
            out += [(x + 5.0 * i + (260 if i // 2 % 2 == 0 else 0), 300.0 + 5 * (i % 2)) for i in range(k)]
        elif kind < 0.7:
            out += [(x + 400.0, 600.0)] * min(k, 3)
        else:
            out += [(0.0, 0.0)] * min(k, 4)
    return out[:n]


def test_decisions_dont_hang_on_where_batches_are_cut(spark, tmp_path):
    """Long videos with little held back and medians that stand: the same points are cleaned, the same impulses found."""
    rng = random.Random(9)
    lengths = {v: 330 + 7 * i for i, v in enumerate("abcdef")}
    rows = [(v, i, *p) for v, n in lengths.items() for i, p in enumerate(_steady(rng, n))]
    frames, videos = spark.createDataFrame(rows, FRAMES), _videos(spark, lengths)
    _stream(spark, frames, videos, tmp_path, [0, 90, 98, 250], 40)
    cleaned, judged = _batch(frames, videos)
    got = _rows(detection.read_cleaned(spark, str(tmp_path / "out"), "q"), *POINT)
    assert got == _rows(cleaned, *POINT) and len(got) < cleaning.valid_points(frames).count()
    ours = _rows(detection.read_impulses(spark, str(tmp_path / "out"), "q"), *POINT, "impulse")
    assert ours == _rows(judged, *POINT, "impulse")


def test_hold_is_bounded(spark):
    with pytest.raises(ValueError, match="hold"):
        detection.stream_impulses(None, None, "x", "y", "q", detection.SKETCH + 1)
