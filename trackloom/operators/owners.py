"""Alternation of owners as a library call has it: conflicts are resolved by evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config

_HIT = "struct<frame:int,time_sec:double,score:double,owner:string,player:string,hit_number:int,method:string,conf:double>"


def correct_alternation(hits: DataFrame, frames: DataFrame, videos: DataFrame, owner_y: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Of neighbouring hits under a second apart with one owner, one is flipped: the one without
    evidence by crossing or pose; else the one with a third of the other's score; else the one
    that was nearer to the line, the later one in a tie. Both by pose: none.

    A fold over a video's hits; a flip of the earlier hit is not held against the hit before it.
    """
    last = videos.select("video_id", "frame_h", (F.col("n_frames") - 1).alias("last"))
    at = frames.select("video_id", F.col("frame").alias("at"), "y")
    h = hits.join(last, "video_id").withColumn("at", F.least("frame", "last")).join(at, ["video_id", "at"]).join(owner_y, "video_id")
    conf = F.least(F.lit(1.0), F.try_divide(F.abs(F.col("y") - F.col("owner_y")), config.position_band * F.col("frame_h")))
    fields = ["frame", "time_sec", "score", "owner", "player", "hit_number", "method"]
    lists = h.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*fields, conf.alias("conf")))).alias("events"))

    def flip(e):
        owner = F.when(e["owner"] == "top", "bottom").otherwise("top")
        player = F.when(owner == "top", "pink_top").otherwise("green_bottom")
        return e.withField("owner", owner).withField("player", player)

    def step(out, e):
        prev = F.try_element_at(out, F.lit(-1))
        pose = lambda s: F.contains(s["method"], F.lit("_pose"))
        sure = lambda s: (s["method"] == "peaks_crossed") | pose(s)
        clash = (prev["owner"] == e["owner"]) & (e["time_sec"] - prev["time_sec"] < 1.0) & ~(pose(prev) & pose(e))
        ratio = e["score"] / F.greatest(prev["score"], F.lit(1e-6))
        which = (
            F.when(sure(prev) & ~sure(e), "this").when(sure(e) & ~sure(prev), "prev")
            .when(ratio >= 3.0, "prev").when(ratio <= 1.0 / 3.0, "this")
            .when(e["conf"] <= prev["conf"], "this").otherwise("prev")
        )
        which = F.when(clash, which).otherwise("none")
        before = F.when(which == "prev", F.concat(F.slice(out, 1, F.size(out) - 1), F.array(flip(prev)))).otherwise(out)
        return F.concat(before, F.array(F.when(which == "this", flip(e)).otherwise(e)))

    out = F.aggregate("events", F.array().cast(f"array<{_HIT}>"), step)
    return lists.select("video_id", F.explode(out).alias("e")).select("video_id", *(f"e.{f}" for f in fields))
