"""Operators with small state on unbounded frames: crossings, rallies, held places and trails.

What looks ahead or at medians is in `detection`; fences and peaks stay with the batch plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.config import CONFIG

_CROSSINGS = "video_id string, frame int, trigger int, direction string, cross_x double"
_STATE = "frame int, x double, y double, above boolean, last int"


def stream_crossings(frames: DataFrame, slope: float, intercept: float, cooldown: int = CONFIG.cooldown) -> DataFrame:
    """A stream of (video_id, frame, x, y), in frame order within a video -> its net crossings.

    The state is one small row per video, the last valid frame, its side and the last crossing, and
    stays for good: a processing-time limit would keep an available-now run from ending. Rows of a batch are sorted by frame; frames that come
    after a later batch was handled are taken as they come.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev = state.get if state.exists else None
        last = prev[4] if prev else -cooldown
        prev = prev[:4] if prev and prev[0] is not None else None
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        rows = rows[(rows.x > 0) & (rows.y > 0) & (rows.x < float("inf")) & (rows.y < float("inf"))]
        out = []
        for frame, x, y in zip(rows.frame.tolist(), rows.x.tolist(), rows.y.tolist()):
            above = y < slope * x + intercept
            if prev and above != prev[3] and frame - last > cooldown:
                f0, x0, y0, was = prev
                fall = (y - y0) - slope * (x - x0)
                t = 0.5 if abs(fall) < 1e-6 else (slope * x0 + intercept - y0) / fall
                t = min(1.0, max(0.0, t))
                last = int(round(f0 + t * (frame - f0)))
                out.append((key[0], last, frame, "top_to_bottom" if was else "bottom_to_top", x0 + t * (x - x0)))
            prev = (frame, x, y, above)
        state.update((*(prev or (None, None, None, None)), last))
        yield pd.DataFrame(out, columns=["video_id", "frame", "trigger", "direction", "cross_x"])

    return frames.groupBy("video_id").applyInPandasWithState(step, _CROSSINGS, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_rallies(hits: DataFrame, gap_sec: float = CONFIG.rally_gap_sec, late: str = "10 seconds") -> DataFrame:
    """A stream of (video_id, time_sec) hits -> rallies as session windows: video_id, start, end, hits.

    Hits exactly gap_sec apart stay together, hence the microsecond on the gap; a rally comes out
    once the watermark has passed its end."""
    stamped = hits.withColumn("at", F.timestamp_seconds("time_sec")).withWatermark("at", late)
    wait = f"{int(gap_sec * 1_000_000) + 1} microseconds"
    s = stamped.groupBy("video_id", F.session_window("at", wait).alias("w")).agg(F.count("*").alias("hits"), F.max("at").alias("last"))
    return s.select("video_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("last").alias("end_us"), "hits")


_HELD = "video_id string, side string, frame int, mx int, my int, trail_x array<int>, trail_y array<int>"
_HELD_STATE = (
    "seen int, xs array<int>, ys array<int>, at array<long>, frames array<int>, mx array<int>, my array<int>"
)


def stream_players(players: DataFrame, late: str = "10 seconds", idle: float = 60.0, hold: int = CONFIG.ghost, length: int = CONFIG.trail) -> DataFrame:
    """A stream of (video_id, side, frame, at timestamp, mx, my), without a place (null) where nobody was found ->
    per row the held place (the last one seen at most `hold` frames ago, else null) and the trail, the last `length` places.

    `at` is the event's time and grows with the frame. Rows wait until the watermark, `late` behind the latest time, has
    passed them and come out in order of their frames, whatever the order in which they arrived; a row that arrives
    behind the watermark is dropped. The state of a side is its trail and the rows that wait; it goes once its video has been
    silent for `idle` seconds of event time, and a side that comes back then begins anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        seen, xs, ys, *waiting = state.get if state.exists else (None, [], [], [], [], [], [])
        xs, ys, rows = list(xs), list(ys), list(zip(*waiting))
        if not state.hasTimedOut:
            for pdf in batches:
                new = zip((pdf["at"].astype("int64") // 1_000_000 if pdf["at"].dtype == "datetime64[ns]" else pdf["at"].astype("datetime64[ms]").astype("int64")).tolist(), pdf["frame"].tolist(), pdf["mx"].tolist(), pdf["my"].tolist())
                rows += [(at, f, None if pd.isna(x) else int(x), None if pd.isna(x) else int(y)) for at, f, x, y in new if at > mark]
        rows.sort(key=lambda r: r[:2])
        ready, rows, out = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark], []
        for _, frame, x, y in ready:
            if x is not None:
                xs, ys, seen = [*xs, x][-length:], [*ys, y][-length:], frame
            held = seen is not None and frame - seen <= hold
            out.append((*key, frame, xs[-1] if held else None, ys[-1] if held else None, xs, ys))
        if state.hasTimedOut and not ready and not rows:
            state.remove()
        else:
            state.update((seen, xs, ys, *(map(list, zip(*rows)) if rows else ([], [], [], []))))
            state.setTimeoutTimestamp(max(mark + 1, rows[0][0] if rows else mark + int(1000 * idle)))
        frame = pd.DataFrame(out, columns=["video_id", "side", "frame", "mx", "my", "trail_x", "trail_y"])
        yield frame.astype({"mx": "Int32", "my": "Int32"})

    stamped = players.select("video_id", "side", "frame", "at", "mx", "my").withWatermark("at", late)
    return stamped.groupBy("video_id", "side").applyInPandasWithState(step, _HELD, _HELD_STATE, "append", GroupStateTimeout.EventTimeTimeout)
