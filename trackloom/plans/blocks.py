"""Detection of long videos in blocks: no task ever holds a whole video.

A video's points are numbered by a two-level prefix sum: their places in a part of its frames, and the points of
the parts before. Places are cut into blocks, and each block takes along a halo of its neighbours' points, as many
as the rules look at, so that the same rules run on it as on a video. What they need of the whole video comes from
sums, extremes, and ranks of the values near a quantile, and is joined block by block. A stretch of scores is as long as the
shuttle's path has turns without a pause; the peaks of a video, some a second, stay together for the greedy rules.

Each step writes one narrow table and drops what no later step reads, so that the disk holds about two of them and one shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config
from trackloom.functions.ranks import joined_small, ranked
from trackloom.functions.series import by_frame, distance, where
from trackloom.functions.stages import Shelf
from trackloom.functions.sweeps import prominent_maxima, swept
from trackloom.operators import cleaning, impulse, peaks
from trackloom.sources.trajectories import normalised

#: Points of a block, and frames of a part in which they are counted: 10 minutes at 30 frames a second.
SIZE = 18_000
#: Neighbours that a block takes along on each side. A pass of the cleaning looks at 3 points for a detour, one more
#: for a detour of two that began before, and 3 for a run of spikes.
HALO = 8
#: Bins of an octave in which values are counted for a quantile, and bins of all videos that are broadcast (some 100 bytes each).
BINS, MOST_BINS = 8, 500_000


def numbered(rows: DataFrame, size: int = SIZE, valid: str | None = None) -> DataFrame:
    """rows with `k`, the place in the video from 0, `n`, its rows, and from the row before (null at the first) `gap`,
    frames, and `step`, the distance if there are x and y.

    With `valid` only such rows are kept and count as rows; `since` is then the frames from the row before, kept or not
    (null at the first), and `final` tells the video's last row."""
    kept, place = F.expr(valid or "true"), [c for c in ("frame", "x", "y") if c in rows.columns]
    at = F.when(kept, F.col("frame"))
    p = rows.withColumn("part", F.floor(F.col("frame") / size))
    parts = p.groupBy("video_id", "part").agg(
        F.count(at).alias("rows"), F.max("frame").alias("seen"), F.max(at).alias("at"), *(F.max_by(c, at).alias(c) for c in place)
    )
    order = Window.partitionBy("video_id")
    earlier = order.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "video_id", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("ahead"), F.sum("rows").over(order).cast("int").alias("n"),
        F.max("seen").over(earlier).alias("seen"), F.max("seen").over(order).alias("end"),
        F.last(F.when(F.col("at").isNotNull(), F.struct(*place)), True).over(earlier).alias("prior"),
    )
    own = Window.partitionBy("video_id", "part").orderBy("frame")
    p = p.withColumn("seen_b", F.lag("frame").over(own)).filter(kept)
    p = p.withColumns({"at": F.row_number().over(own)} | {f"{c}_b": F.lag(c).over(own) for c in place})
    p = p.join(parts.hint("shuffle_hash"), ["video_id", "part"])
    before = lambda c: F.when(F.col("at") == 1, F.col(f"prior.{c}")).otherwise(F.col(f"{c}_b"))
    p = p.withColumns({"k": (F.col("at") - 1 + F.col("ahead")).cast("int"), "gap": F.col("frame") - before("frame")})
    if "x" in place:
        p = p.withColumn("step", distance(before("x"), before("y"), F.col("x"), F.col("y")))
    if valid:
        p = p.withColumns({"since": F.col("frame") - F.coalesce("seen_b", "seen"), "final": F.col("frame") == F.col("end")})
    return p.drop("part", "ahead", "seen", "end", "prior", "at", "seen_b", *(f"{c}_b" for c in place))


def in_blocks(points: DataFrame, halo: int, size: int = SIZE) -> DataFrame:
    """Numbered points, each in its block and in those whose halo it is in: `video_id` names the block of a
    video, `whole` the video, `own` is true in a point's own block."""
    if halo > size:
        raise ValueError("a halo is at most a block")
    block = lambda k: F.floor(k / size)
    near = F.sequence(block(F.greatest(F.col("k") - halo, F.lit(0))), block(F.col("k") + halo))
    p = points.withColumn("block", F.explode(near)).withColumn("own", block(F.col("k")) == F.col("block"))
    return p.withColumns({"whole": F.col("video_id"), "video_id": F.concat_ws("#", "video_id", "block")})


def own(blocks: DataFrame) -> DataFrame:
    """The points in their own blocks, with their video's name again."""
    return blocks.filter("own").withColumn("video_id", F.col("whole")).drop("whole", "own")


def told(blocks: DataFrame, videos: DataFrame, size: int, carried: DataFrame | None = None) -> DataFrame:
    """in_blocks' rows with the columns of videos(video_id, n, ...) and of carried(video_id, ...), which names blocks.

    These few rows are made one a block and meet the points where the windows over blocks want them anyway, so that
    videos need neither be broadcast nor bring a whole video together; what a block's rows share comes with them."""
    last = F.floor((F.col("n") - 1) / size)
    few = videos.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    few = few.withColumns({"whole": F.col("video_id"), "video_id": F.concat_ws("#", "video_id", "block")})
    few = few if carried is None else few.join(carried, "video_id", "left")
    rows = blocks.drop("whole", "block", "own", "n").join(few.hint("shuffle_hash"), "video_id")
    return rows.withColumn("own", F.floor(F.col("k") / size) == F.col("block"))


def quantiles(shelf: Shelf, rows: DataFrame, value: str, shares: dict[str, Column], name: str, of: DataFrame | None = None) -> DataFrame:
    """(video_id, ...): the linear quantiles of `value`, which is positive, each at its share, which may name a column of of(video_id, ...).

    Values are counted by bins, and only those in a bin that holds a place of a quantile are ranked, as many as they may be."""
    v = F.col(value)
    place = F.when(F.isnan(v), 1 << 15).otherwise(F.least(F.floor(F.log2(v) * BINS), F.lit((1 << 15) - 1))).cast("int")
    rows = rows.select("video_id", value, place.alias("bin"))
    order = Window.partitionBy("video_id")
    earlier = F.sum("rows").over(order.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = rows.groupBy("video_id", "bin").agg(F.count("*").alias("rows"), F.min(value).alias("least"), F.max(value).alias("most"))
    bins = bins.withColumns({"ahead": F.coalesce(earlier, F.lit(0)), "all": F.sum("rows").over(order)})
    bins = bins if of is None else bins.join(of, "video_id")
    bins = bins.withColumns({f"pos_{s}": (F.col("all") - 1) * share for s, share in shares.items()})
    places = [f(f"pos_{s}") for s in shares for f in (F.floor, F.ceil)]
    holds = lambda at: (at >= F.col("ahead")) & (at < F.col("ahead") + F.col("rows"))
    bins = shelf.put(f"{name}-bins", bins.filter(reduce(or_, map(holds, places))).drop("all"))
    # A bin of equal values needs no ranks.
    mixed = bins.filter("least < most").drop("rows", "least", "most")
    r = ranked(shelf, joined_small(rows, mixed, ["video_id", "bin"], most=MOST_BINS), ["video_id", "bin"], [value], name)
    read = lambda rows, of, held: rows.select("video_id", *(f"pos_{s}" for s in shares), *(F.when(held(at), F.col(of)).alias(f"at_{i}") for i, at in enumerate(places)))
    r = read(r, value, lambda at: F.col("at") + F.col("ahead") == at).union(read(bins.filter("NOT least < most"), "least", holds))
    out = []
    for i, s in enumerate(shares):
        low, high, part = F.max(f"at_{2 * i}"), F.max(f"at_{2 * i + 1}"), F.max(F.col(f"pos_{s}") - F.floor(f"pos_{s}"))
        out.append((low + (high - low) * part).alias(s))
    found = shelf.put(f"{name}-of", r.groupBy("video_id").agg(*out))
    shelf.drop(name, f"{name}-parts", f"{name}-bins")
    return found


def _pass(shelf: Shelf, points: DataFrame, typical: DataFrame, name: str, c: Config, size: int) -> DataFrame:
    """One cleaning pass over numbered points, of which typical(video_id, typical) tells the steps."""
    speeds = points.select("video_id", (F.col("step") / F.greatest("gap", F.lit(1))).alias("speed")).filter("speed > 0")
    usual = quantiles(shelf, speeds, "speed", {"usual": F.lit(0.5)}, f"{name}-speeds")
    videos = points.filter("k = 0").select("video_id", "n").join(typical, "video_id").join(usual, "video_id", "left")
    videos = shelf.put(f"{name}-videos", videos.withColumn("usual", F.coalesce("usual", F.lit(1.0))))
    rest = [f for f in ("since", "final") if f in points.columns]
    blocks = in_blocks(points.drop("gap", "step"), HALO, size)
    # The last place without `two` ahead of a block's settled rows: in the block before, up to where they begin, else earlier.
    # Two rounds over the blocks cost less disk than a table of all detours.
    plain, lead = ~F.col("two"), HALO - 3
    carried = cleaning.detours(told(blocks.drop(*rest), videos.drop("usual"), size), c).filter("own").groupBy("video_id", "whole", "block").agg(
        F.max(F.when(plain, F.col("k"))).alias("full"), F.max(F.when(plain & (F.col("k") < (F.col("block") + 1) * size - lead), F.col("k"))).alias("short")
    )
    order = Window.partitionBy("whole").orderBy("block")
    earlier = F.max("full").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.concat_ws("#", "whole", F.col("block") + 1)
    carried = shelf.put(f"{name}-carried", carried.select(after.alias("video_id"), F.coalesce(F.greatest("short", earlier), F.lit(-1)).alias("carried")))
    begin = F.col("block") * size - HALO
    settled = (begin <= 0) | (F.col("k") >= begin + 3)
    gone = cleaning.spikes(cleaning.detours(told(blocks, videos, size, carried), c), c, settled, F.col("carried"))
    kept = shelf.put(f"{name}-kept", own(gone).filter("NOT gone").select("video_id", "frame", "x", "y", *rest))
    shelf.drop(f"{name}-speeds-of", f"{name}-videos", f"{name}-carried")
    return kept


def _cleaned(shelf: Shelf, rows: DataFrame, config: Config, size: int, valid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """cleaning.clean in two tables: points, and (video_id, typical)."""
    p = shelf.put("points", numbered(rows.select("video_id", "frame", "x", "y"), size, valid))
    moved = quantiles(shelf, p.filter("step > 0").select("video_id", "step"), "step", {"moved": F.lit(0.5)}, "steps")
    n = p.filter("k = 0").select("video_id", "n").join(moved, "video_id", "left")
    typical = shelf.put("typical", n.select("video_id", F.when(F.col("n") < 4, 1.0).otherwise(F.coalesce("moved", F.lit(1.0))).alias("typical")))
    shelf.drop("steps-of")
    once = _pass(shelf, p, typical, "one", config, size)
    shelf.drop("points")
    again = shelf.put("points", numbered(once, size))
    shelf.drop("one-kept")
    twice = _pass(shelf, again, typical, "two", config, size)
    shelf.drop("points")
    return twice, typical


def clean(shelf: Shelf, points: DataFrame, config: Config = CONFIG, size: int = SIZE) -> DataFrame:
    """cleaning.clean: (video_id, frame, x, y, typical)."""
    found, typical = _cleaned(shelf, points, config, size)
    return joined_small(found, typical, ["video_id"])


def detect(frames: DataFrame, videos: DataFrame, owner_y: DataFrame, config: Config = CONFIG, size: int = SIZE) -> DataFrame:
    """analysis.detect's hits, without crossings, poses and alternation, for videos of any length."""
    shelf, frames = Shelf(frames.sparkSession), normalised(frames)
    kept, typical = _cleaned(shelf, frames, config, size, cleaning.VALID)
    cleaned = shelf.put("cleaned", numbered(kept, size).drop("step"))
    shelf.drop("two-kept")
    gaps = quantiles(shelf, cleaned.filter("gap IS NOT NULL").select("video_id", "gap"), "gap", {"gap": F.lit(0.5)}, "gaps")
    stats = cleaned.groupBy("video_id").agg(
        F.count("*").alias("points"), (F.max("y") - F.min("y")).alias("span"), F.max_by("x", "frame").alias("x_end"), F.max_by("y", "frame").alias("y_end")
    ).join(typical, "video_id").join(gaps, "video_id", "left")
    stats = shelf.put("stats", stats)
    params = shelf.put("params", cleaning.parameters(stats.drop("x_end", "y_end"), videos))
    limits = quantiles(shelf, cleaned.select("video_id", "y"), "y", {"limit": F.col("floor_pct") / 100.0}, "heights", params.select("video_id", "floor_pct"))
    ruled = params.drop("points").join(stats.select("video_id", F.col("points").alias("n"), "x_end", "y_end"), "video_id").join(limits, "video_id")
    p = own(impulse.neighbours(told(in_blocks(cleaned.drop("gap"), 2, size), shelf.put("ruled", ruled), size)))
    p = where(impulse.turns(p, config), F.expr("early IS NULL AND NOT coalesce(apex, false) AND impulse > 0 AND NOT isnan(impulse)"))
    turned = shelf.put("turns", p.select(
        "video_id", "frame", "k", "n", "since", "final", F.col("impulse").alias("score"), F.coalesce(F.col("y") > F.col("limit"), F.lit(False)).alias("low"), "y", "near_future", "min_floor_drop"
    ))
    low = turned.filter("low")
    floor = shelf.put("floor", impulse.floored(low, cleaned).filter("floor").select("video_id", "frame"))
    shelf.drop("cleaned", "stats", "ruled", "gaps-of", "heights-of", "typical")
    scored = lambda rows: rows.select("video_id", "frame", "k", "n", "since", "final", "score")
    scores = shelf.put("scores", scored(turned.filter("NOT low")).union(scored(low.join(floor, ["video_id", "frame"], "left_anti"))))
    shelf.drop("turns", "floor")
    found = peaks.chosen(_ridges(shelf, scores, config, size).filter("work >= height"), params, config)
    found = shelf.put("peaks", found)
    shelf.drop("scores", "tops", "climbs")
    hits = shelf.put("hits", peaks.candidates(found, frames, videos, owner_y))
    shelf.drop(*(name for name in list(shelf.paths) if name != "hits"))
    return hits


def _ridges(shelf: Shelf, scores: DataFrame, config: Config, size: int) -> DataFrame:
    """peaks.ridges of the suppressed scores, a stretch between zeros at a time. Scores (video_id, frame, score) are dense,
    or the positive ones with k, n, and what `numbered` tells of the dense series, `since` and `final`."""
    if "since" not in scores.columns:
        scores = numbered(scores, size).withColumnRenamed("gap", "since").withColumn("final", F.col("k") == F.col("n") - 1)
    scored = scores.filter("score > 0")
    q = quantiles(shelf, scored.select("video_id", "score"), "score", {"q1": F.lit(0.25), "q3": F.lit(0.75)}, "scored")
    tops = scored.groupBy("video_id").agg(F.max("n").alias("n"), F.count("*").alias("scored"), F.max("score").alias("top")).join(q, "video_id")
    spread = F.col("q3") - F.col("q1")
    tops = tops.withColumn("fence", F.when((F.col("scored") >= 6) & (spread > 1e-6), F.col("q3") + config.fence_iqr * spread))
    height = F.when(F.col("top") > F.col("fence"), F.col("fence")).otherwise(F.col("top")) * config.peak_threshold_ratio
    tops = shelf.put("tops", tops.select("video_id", "n", "fence", height.alias("height")))
    shelf.drop("scored-of")
    # Scores beyond the fence count as 0, and so do rows that aren't there.
    s = told(in_blocks(scored.drop("n").withColumnRenamed("score", "v"), 1, size), tops, size).filter("NOT coalesce(v > fence, false)")
    s = in_neighbours(s)
    # A stretch is named by its first place: the last one at or before a point where what came before is 0 or nothing.
    head = F.when(F.col("own") & (F.coalesce("before", F.lit(0.0)) == 0), F.col("k"))
    s = own(s.withColumn("stretch", F.last(head, True).over(by_frame())))
    s = shelf.put("climbs", s.select("video_id", "block", "stretch", "frame", "v", "before", "after", "height"))
    ahead = Window.partitionBy("video_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = s.groupBy("video_id", "block").agg(F.max("stretch").alias("latest"))
    blocks = blocks.select("video_id", "block", F.max("latest").over(ahead).alias("ahead"))
    # Only the rows that go on with a stretch of an earlier block have to ask for its name.
    later = s.filter("stretch IS NULL").join(blocks, ["video_id", "block"]).withColumn("stretch", F.col("ahead"))
    columns = ("video_id", "stretch", "frame", "v", "before", "after", "height")
    # A stretch may go over several blocks, which lie in different partitions: it is brought together for the sweep.
    rows = s.filter("stretch IS NOT NULL").select(*columns).union(later.select(*columns))
    rows = rows.repartition("video_id", "stretch").sortWithinPartitions("video_id", "stretch", "frame")
    return swept(rows, prominent_maxima, "video_id string, frame int, v double, prominence double, height double").withColumnRenamed("v", "work")


def in_neighbours(blocks: DataFrame) -> DataFrame:
    """Positive rows with the values before and after them in the dense series: null at its ends, 0 where a row isn't there."""
    at = lambda c: F.lag(c).over(by_frame())
    then = lambda c: F.lead(c).over(by_frame())
    before = F.when(F.col("since").isNull(), None).when(at("frame") == F.col("frame") - F.col("since"), at("v")).otherwise(0.0)
    after = F.when(F.col("final"), None).when(then("frame") - then("since") == F.col("frame"), then("v")).otherwise(0.0)
    return blocks.withColumns({"before": before, "after": after})
