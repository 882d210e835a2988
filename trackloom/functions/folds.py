"""Greedy rules over a video's few events, as folds of sorted arrays: one expression, no Python.

Every fold runs over an aggregated array of events (hundreds a video), never over frames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_apart(events: Column, gap: Column, kind: str) -> Column:
    """Of structs with a `frame`, in their given order of priority, those at least `gap` frames from all kept before."""
    return F.aggregate(
        events,
        F.array().cast(f"array<{kind}>"),
        lambda kept, e: F.when(
            F.forall(kept, lambda o: F.abs(e["frame"] - o["frame"]) >= gap), F.concat(kept, F.array(e))
        ).otherwise(kept),
    )


def strongest_apart(events: Column, gap: int, kind: str) -> Column:
    """Of structs with `frame` and `score` by frame: of two under `gap` frames apart the stronger, of equals the earlier."""
    empty = F.array().cast(f"array<{kind}>")

    def step(kept: Column, e: Column) -> Column:
        last = F.element_at(kept, -1)
        replaced = F.when(e["score"] > last["score"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(e))).otherwise(kept)
        return F.when((F.size(kept) == 0), F.array(e)).otherwise(
            F.when(e["frame"] - F.try_element_at(kept, F.lit(-1))["frame"] >= gap, F.concat(kept, F.array(e))).otherwise(replaced)
        )

    return F.aggregate(events, empty, step)


def after_cooldown(events: Column, cooldown: int, kind: str) -> Column:
    """Of structs with `trigger` and `frame` by trigger, those triggered over `cooldown` frames after the last kept one's frame."""
    start = F.struct(F.lit(-cooldown).alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(
        events,
        start,
        lambda acc, e: F.when(
            e["trigger"] - acc["last"] > cooldown,
            F.struct(e["frame"].alias("last"), F.concat(acc["out"], F.array(e)).alias("out")),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
