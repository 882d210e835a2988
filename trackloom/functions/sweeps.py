"""One pass over sorted rows of many series, in Arrow batches: for rules with a stack or a cursor that no window has.

Spark partitions and sorts; a sweep holds what its rule needs and one batch. Rows of a series come together and in
order, as the partitions are hashed by series and sorted within.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def listed(column: pa.Array) -> list:
    """column.to_pylist(), by way of numpy for numbers and with each distinct text made once, in a fraction of its time."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        out = pc.fill_null(column, 0).to_numpy().tolist()
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else ():
            out[i] = None
        return out
    if pa.types.is_string(column.type) and not column.null_count:
        coded = column.dictionary_encode()
        names = coded.dictionary.to_pylist()
        return [names[i] for i in coded.indices.to_numpy().tolist()]
    return column.to_pylist()


def swept(rows: DataFrame, rule: Callable[[], Callable], schema: str) -> DataFrame:
    """rows, in partitions that hold whole series in order, through a rule.

    rule() makes a step for one task; step(columns: dict of lists of a batch, or None at the end) returns finished
    rows as tuples of `schema`."""
    kind: StructType = _parse_datatype_string(schema)
    names = [f.name for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, arrow = rule(), to_arrow_schema(kind)
        for batch in batches:
            yield _batch(step({n: listed(c) for n, c in zip(batch.schema.names, batch.columns)}), arrow)
        yield _batch(step(None), arrow)

    def _batch(out: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def prominent_maxima() -> Callable:
    """A rule: strict local maxima of non-negative series and their prominence, by a monotonic stack.

    Rows: video_id, frame, v > 0, before and after (the neighbours' values, null at the ends of the series), height;
    it gives (video_id, frame, v, prominence, height). A run of equal values is one place, its middle rounded
    down, and a maximum if it falls on both sides. A place's side ends before the next higher value, at a 0 or
    with the series. Every place goes onto the stack and off it once, so a stretch takes linear time.
    """
    far = float("inf")
    # An entry: value, least value on its left side, least value between it and the next entry, the maximum or None.
    stack: list[list] = []
    run: list = []
    lowest = [far]

    def off(out: list, end: float) -> None:
        value, left, low, top = stack.pop()
        low = min(low, end)
        if top:
            out.append((top[0], top[1], value, value - max(left, min(value, low)), top[2]))
        if stack:
            stack[-1][2] = min(stack[-1][2], value, low)

    def close(out: list, falls: bool) -> None:
        value, first, last, rises, video, height = run
        while stack and stack[-1][0] < value:
            off(out, far)
        if not stack:
            left = min(value, lowest[0])
        else:
            above = stack[-1]
            left = min(value, above[2], above[1] if above[0] == value else far)  # an equal value ends no side
        stack.append([value, left, far, (video, (first + last) // 2, height) if rises and falls else None])
        lowest[0] = min(lowest[0], value)

    def step(columns: dict | None) -> list[tuple]:
        out: list[tuple] = []
        if columns is None:
            return out
        for video, frame, v, before, after, height in zip(*(columns[c] for c in ("video_id", "frame", "v", "before", "after", "height"))):
            if not before:  # a stretch begins
                lowest[0] = far if before is None else 0.0
                run[:] = [v, frame, frame, before is not None, video, height]
            elif before == v:
                run[2] = frame
            else:
                close(out, v < before)
                run[:] = [v, frame, frame, v > before, video, height]
            if not after:
                close(out, after is not None)
                while stack:
                    off(out, far if after is None else 0.0)
        return out

    return step


def claims(reach: int) -> Callable:
    """A rule: crossings each claim one hit before them and one after them, within `reach` frames.

    Rows of both kinds by video and frame, at one frame crossings first: video_id, frame, wait (frames since the
    event before, null at a video's first), hitter_side and receiver_side (null for a hit). Crossings in order first take each the nearest hit before them that is free,
    for the hitter's side; then each the first one after them that is still free, for the receiver's. It gives
    (video_id, frame, side) of the claimed hits.

    The nearest free hit before is the top of a stack of hits, as every later crossing finds it nearer; the
    first free one after is where a cursor stands that only moves on. Events that are over `reach` from the next
    one settle what is before them, so only such a stretch is held.
    """
    video, hits, crossed = [None], [], []

    def settle(out: list) -> None:
        free, at, taken = [], 0, set()
        for frame, hitter, _ in crossed:
            while at < len(hits) and hits[at] < frame:
                free.append(hits[at])
                at += 1
            if free and free[-1] >= frame - reach:
                taken.add(free[-1])
                out.append((video[0], free.pop(), hitter))
        at = 0
        for frame, _, receiver in crossed:
            while at < len(hits) and (hits[at] <= frame or hits[at] in taken):
                at += 1
            if at < len(hits) and hits[at] <= frame + reach:
                out.append((video[0], hits[at], receiver))
                at += 1
        hits.clear()
        crossed.clear()

    def step(columns: dict | None) -> list[tuple]:
        out: list[tuple] = []
        if columns is None:
            settle(out)
            return out
        for name, frame, wait, hitter, receiver in zip(*(columns[c] for c in ("video_id", "frame", "wait", "hitter_side", "receiver_side"))):
            if wait is None or wait > reach:
                settle(out)
                video[0] = name
            if hitter is None:
                hits.append(frame)
            else:
                crossed.append((frame, hitter, receiver))
        return out

    return step
