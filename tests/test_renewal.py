"""What is written once, computed once and opened once: the sink's ledger, the manifest, the file source."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trackloom.plans import renewal
from trackloom.sources import files, trajectories
from trackloom.sources.trajectories import FRAMES
from trackloom.streaming import sinks


def _docs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "document string")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    assert sinks.commit(_docs(spark, "a", "b"), 0, "q", out) and sinks.commit(_docs(spark, "c"), 1, "q", out)
    assert not sinks.commit(_docs(spark, "a", "b"), 0, "q", out)  # handed over again after its line was written
    assert sinks.commit(_docs(spark, "x"), 0, "other", out)  # another stream counts for itself
    got = sorted((r.query, r.batch, r.document) for r in sinks.read_committed(spark, out).collect())
    assert got == [("other", 0, "x"), ("q", 0, "a"), ("q", 0, "b"), ("q", 1, "c")]
    assert sorted(map(tuple, sinks.ledger(spark, out).collect())) == [("other", 0, 1), ("q", 0, 2), ("q", 1, 1)]


def test_a_batch_that_failed_half_way_is_not_read_and_then_written_anew(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.commit(_docs(spark, "a"), 0, "q", out)
    _docs(spark, "half").write.parquet(f"{out}/data/query=q/batch=1")  # no line in the ledger
    assert [r.document for r in sinks.read_committed(spark, out).collect()] == ["a"]
    assert sinks.commit(_docs(spark, "half", "whole"), 1, "q", out)
    assert sorted(r.document for r in sinks.read_committed(spark, out).collect()) == ["a", "half", "whole"]


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for part in ("ab", "cd"):
        _docs(spark, *part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sinks.write_once(stream, out, checkpoint, "docs").awaitTermination()
    # The last batch's commit in the checkpoint is lost, as when the driver dies between sink and checkpoint.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    sinks.write_once(stream, out, checkpoint, "docs").awaitTermination()
    assert sorted(r.document for r in sinks.read_committed(spark, out).collect()) == ["a", "b", "c", "d"]
    assert sinks.ledger(spark, out).count() == 2


def test_only_new_and_changed_videos_are_computed(spark, tmp_path):
    out, asked = str(tmp_path / "kept"), []

    def compute(frames):
        asked.append(sorted(r.video_id for r in frames.select("video_id").distinct().collect()))
        return frames.groupBy("video_id").agg(F.sum("x").alias("total")).filter("total > 0")

    def frames(**videos):
        return spark.createDataFrame([(v, i, float(x), 1.0) for v, xs in videos.items() for i, x in enumerate(xs)], FRAMES)

    first = frames(a=[1, 2], b=[3], empty=[0])
    assert renewal.renew(first, compute, out) and renewal.renew(first.repartition(3), compute, out) is None
    assert renewal.renew(frames(a=[1, 2], b=[3], empty=[0], c=[7]), compute, out)
    assert renewal.renew(frames(a=[2, 1], b=[3, 0], empty=[0]), compute, out)
    assert asked == [["a", "b", "empty"], ["c"], ["a", "b"]]
    assert sorted(map(tuple, renewal.results(spark, out).collect())) == [("a", 3.0), ("b", 3.0), ("c", 7.0)]
    assert renewal.fresh(first, out, renewal.Config(warmup=1)).count() == 3  # another configuration is another input


def test_a_filtered_read_opens_one_file(spark, tmp_path):
    for video in ("a", "b c", "d"):
        (tmp_path / f"{video}_ball.csv").write_text(" X , Y ,Z\n0,0,1\n320,500,2\n,,3\nabc,1e2,4\n")
    (tmp_path / "broken_ball.csv").write_text("u,v\n1,2\n")
    rows = files.read_files(spark, str(tmp_path))
    got = sorted(map(tuple, rows.filter("video_id = 'b c' AND frame < 3").collect()))
    assert got == [("b c", 0, 0.0, 0.0), ("b c", 1, 320.0, 500.0), ("b c", 2, 0.0, 0.0)]  # the broken file was never opened
    assert rows.filter(F.col("video_id").isin("a", "d")).rdd.getNumPartitions() == 2
    assert rows.filter("video_id = 'none'").count() == 0
    with pytest.raises(Exception, match="x and y"):
        rows.count()
    plain = trajectories.read_trajectories(spark, str(tmp_path / "a_ball.csv"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, rows.filter("video_id = 'a'").collect()))


def test_a_long_file_is_numbered_over_batches(spark, tmp_path):
    n = 200_000
    (tmp_path / "long_ball.csv").write_text("x,y\n" + "".join(f"{i},{i % 7}\n" for i in range(n)) + "nan,oops\n")
    r = files.read_files(spark, str(tmp_path)).agg(F.count("*"), F.countDistinct("frame"), F.count_if(F.col("x") == F.col("frame"))).first()
    assert tuple(r) == (n + 1, n + 1, n)
