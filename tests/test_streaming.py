"""Streams give what the batch plans give."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from trackloom.operators import crossings
from trackloom.sources.trajectories import FRAMES, VIDEOS
from trackloom.streaming import incremental


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_crossings_stream(spark, tmp_path):
    rows = [(v, f, 100.0 + f, 330.0 + 60 * (1 if (f // (7 + int(v))) % 2 else -1) + f % 5) for v in "123" for f in range(90)]
    df = spark.createDataFrame(rows, FRAMES)
    for part in range(3):  # three micro-batches
        df.filter(f"frame >= {30 * part} AND frame < {30 * part + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.video_id, r.frame, r.direction) for r in _run(incremental.stream_crossings(stream, 0.0, 330.0), "crossed")}
    net = spark.createDataFrame([(v, 0.0, 330.0) for v in "123"], "video_id string, slope double, intercept double")
    videos = spark.createDataFrame([(v, 1280, 720, 30.0, 90) for v in "123"], VIDEOS)
    assert got == {(r.video_id, r.frame, r.direction) for r in crossings.net_crossings(df, videos, net).collect()} and got


def test_rally_stream(spark, tmp_path):
    rows = [("v", t) for t in (0.0, 1.0, 4.0, 7.1, 30.0, 99.0)]
    spark.createDataFrame(rows, "video_id string, time_sec double").write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema("video_id string, time_sec double").parquet(str(tmp_path / "hits"))
    found = sorted((r.start_us, r.hits) for r in _run(incremental.stream_rallies(stream), "rallied"))
    assert found[:3] == [(0, 3), (7_100_000, 1), (30_000_000, 1)]


def test_players_stream_in_any_order_and_lose_their_state(spark, tmp_path):
    """Shuffled rows of neighbouring batches give what the batch plans give; a row behind the watermark is dropped;
    the state of silent sides goes."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    seen = {(v, side, f): (rng.random() > 0.4, rng.randrange(360), rng.randrange(600)) for v in "ab" for side in ("top", "bottom") for f in range(60)}
    rows = [(v, side, f, start + timedelta(seconds=f), x if found else None, y if found else None) for (v, side, f), (found, x, y) in seen.items()]
    schema = "video_id string, side string, frame int, at timestamp, mx int, my int"
    parts = [[] for _ in range(6)]
    for r in rows:
        parts[min(5, max(0, r[2] // 10 + rng.choice([0, 0, 1 if r[2] % 10 < 8 and r[2] < 50 else 0])))].append(r)
    later = lambda s: start + timedelta(seconds=s)
    parts += [[("z", "top", 500, later(500), 1, 1)], [("z", "top", 900, later(900), 2, 2), ("a", "top", 10, later(10), 3, 3)], [("z", "top", 1300, later(1300), 3, 3)]]
    for i, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i:02d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = incremental.stream_players(stream, "20 seconds", 60.0).writeStream.format("memory").queryName("held").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r for r in spark.table("held").collect() if r.video_id != "z"]
    want = []
    for v in "ab":
        for side in ("top", "bottom"):
            trail, last = [], None
            for f in range(60):
                found, x, y = seen[v, side, f]
                if found:
                    trail, last = [*trail, (x, y)][-30:], f
                held = trail[-1] if last is not None and f - last <= 3 else (None, None)
                want.append((v, side, f, *held, [x for x, _ in trail], [y for _, y in trail]))
    assert sorted(map(tuple, got), key=lambda r: r[:3]) == sorted(want)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # of five sides only the last video's
