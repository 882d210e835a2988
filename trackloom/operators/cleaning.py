"""Valid points, spike removal, and the parameters that adapt to a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config
from trackloom.functions.series import by_frame, video, clip, distance, numbered


#: A detected frame has both coordinates positive; NaN never is.
VALID = "NOT isnan(x) AND NOT isnan(y) AND x > 0 AND y > 0"


def valid_points(frames: DataFrame, finite: bool = False) -> DataFrame:
    """Detected frames; infinity is a coordinate only if `finite` is off."""
    kept = frames.filter(VALID)
    return kept.filter("x < double('infinity') AND y < double('infinity')") if finite else kept


def steps(points: DataFrame) -> DataFrame:
    """points with `gap` (frames) and `step` (distance) from the point before; null at the first."""
    before = lambda c: F.lag(c).over(by_frame())
    return points.withColumns(
        {"gap": F.col("frame") - before("frame"), "step": distance(before("x"), before("y"), F.col("x"), F.col("y"))}
    )


def typical_steps(points: DataFrame) -> DataFrame:
    """(video_id, typical): median of the positive steps; 1 without any, or with under 4 points."""
    moved = F.median(F.when(F.col("step") > 0, F.col("step")))
    return steps(points).groupBy("video_id").agg(
        F.when(F.count("*") < 4, 1.0).otherwise(F.coalesce(moved, F.lit(1.0))).alias("typical")
    )


def detours(points: DataFrame, c: Config) -> DataFrame:
    """(video_id, frame, x, y, typical, k, n, ...) with `one` and `two`, where a detour of one and of two points begins,
    and the speeds `s_in` and `s_out`."""
    x, y = F.col("x"), F.col("y")
    at = lambda name, j: F.lead(name, j).over(by_frame()) if j > 0 else F.lag(name, -j).over(by_frame())
    p = points.withColumns({f"{name}{tag}": at(name, j) for name in ("x", "y") for tag, j in (("_b", -1), ("_a", 1), ("_aa", 2))} | {"frame_b": at("frame", -1), "frame_a": at("frame", 1)})
    p = p.withColumns(
        {
            "d_in": distance(F.col("x_b"), F.col("y_b"), x, y),
            "d_out": distance(x, y, F.col("x_a"), F.col("y_a")),
            "d_next": distance(F.col("x_a"), F.col("y_a"), F.col("x_aa"), F.col("y_aa")),
            "d_skip": distance(F.col("x_b"), F.col("y_b"), F.col("x_a"), F.col("y_a")),
            "d_wide": distance(F.col("x_b"), F.col("y_b"), F.col("x_aa"), F.col("y_aa")),
            "s_in": distance(F.col("x_b"), F.col("y_b"), x, y) / F.greatest(F.col("frame") - F.col("frame_b"), F.lit(1)),
            "s_out": distance(x, y, F.col("x_a"), F.col("y_a")) / F.greatest(F.col("frame_a") - F.col("frame"), F.lit(1)),
        }
    )
    warm = F.col("k") < c.warmup
    inner = (F.col("k") >= 1) & (F.col("k") <= F.col("n") - 2)
    least = 2 * F.col("typical")
    ratio = lambda total, whole: F.when(F.col(whole) >= 1, F.try_divide(total, F.col(whole)))
    one = inner & (ratio(F.col("d_in") + F.col("d_out"), "d_skip") > F.when(warm, c.detour_warmup).otherwise(c.detour))
    one &= F.greatest("d_in", "d_out") > least
    p = p.withColumn("one", F.coalesce(one, F.lit(False)))
    two = (F.col("k") >= 1) & (F.col("k") <= F.col("n") - 3) & ~F.col("one") & ~F.lead("one").over(by_frame())
    two &= (ratio(F.col("d_in") + F.col("d_out") + F.col("d_next"), "d_wide") > c.detour) & (F.greatest("d_in", "d_next") > least)
    return p.withColumn("two", F.coalesce(two, F.lit(False)))


def spikes(p: DataFrame, c: Config, settled: Column | None = None, before: Column | None = None) -> DataFrame:
    """detours' rows and the median speed `usual` -> with `gone`, what a pass removes.

    In a block of a video, `settled` tells the rows whose neighbours are all there, and `before` is the place of the
    last one without `two` ahead of them."""
    warm, inner = F.col("k") < c.warmup, (F.col("k") >= 1) & (F.col("k") <= F.col("n") - 2)
    # A detour of two takes its next point along, so in a run of such starts every other one counts.
    plain = ~F.col("two") if settled is None else ~F.col("two") & settled
    last = F.last(F.when(plain, F.col("k")), True).over(by_frame())
    since = F.col("k") - (last if before is None else F.coalesce(last, before))
    p = p.withColumn("pair", F.col("two") & (since % 2 == 1))
    p = p.withColumn("spike", F.col("one") | F.col("pair") | F.coalesce(F.lag("pair").over(by_frame()), F.lit(False)))
    limit = F.col("usual") * F.when(warm, c.speed_ratio_warmup).otherwise(c.speed_ratio)
    fast = (F.col("s_in") > limit) & (F.col("s_out") > limit) | (F.greatest("s_in", "s_out") > F.col("usual") * c.speed_extreme)
    p = p.withColumn("spike", F.col("spike") | F.coalesce(inner & fast, F.lit(False)))
    # Runs of several flagged points are motion, not spikes. A first point is never flagged.
    p = p.withColumn("calm", F.when(~F.col("spike"), F.col("k")))
    # A run lies between two calm points, or ends with the rows. One that is short enough ends within `longest_spike` rows.
    ahead = range(1, c.longest_spike)
    places = {f"k_{j}": F.lead("k", j).over(by_frame()) for j in ahead} | {f"calm_{j}": F.lead("calm", j).over(by_frame()) for j in ahead}
    p = p.withColumns({"start": F.last("calm", True).over(by_frame()), **places})
    end = F.coalesce(*(F.col(f"calm_{j}") for j in ahead), F.greatest("k", *(F.col(f"k_{j}") for j in ahead), F.lit(0)) + 1)
    gone = F.col("spike") & F.coalesce(end - F.col("start") - 1 < c.longest_spike, F.lit(False)) & (F.col("n") >= 4)
    return p.withColumn("gone", gone).drop("calm", *places)


def _clean_once(points: DataFrame, c: Config) -> DataFrame:
    """One pass over (video_id, frame, x, y, typical): detours of one and of two points, then speeds."""
    p = detours(numbered(points), c)
    p = p.withColumn("usual", F.coalesce(F.median(F.when(F.col("s_in") > 0, F.col("s_in"))).over(video()), F.lit(1.0)))
    return spikes(p, c).filter("NOT gone").select("video_id", "frame", "x", "y", "typical")


def clean(points: DataFrame, config: Config = CONFIG) -> DataFrame:
    """valid points -> (video_id, frame, x, y, typical) without spikes; two passes, places counted anew in each."""
    with_typical = points.select("video_id", "frame", "x", "y").join(typical_steps(points), "video_id")
    return _clean_once(_clean_once(with_typical, config), config)


def adaptive_parameters(cleaned: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per video: thresholds from its frame rate, detection gaps and vertical range.

    Videos with under 5 cleaned points, or none, get the base values.
    """
    stats = steps(cleaned).groupBy("video_id").agg(
        F.count("*").alias("points"), F.median("gap").alias("gap"), F.first("typical").alias("typical"),
        (F.max("y") - F.min("y")).alias("span"),
    )
    return parameters(stats, videos)


def parameters(stats: DataFrame, videos: DataFrame) -> DataFrame:
    """The same from what is known of each video's cleaned points: stats(video_id, points, gap, typical, span)."""
    s = videos.join(stats, "video_id", "left").withColumn("adapts", F.coalesce(F.col("points") >= 5, F.lit(False)))
    ratio = clip(F.col("gap") / 1.5, 1.0, 4.0)
    scale = F.col("fps") / 30.0
    s = s.withColumns({"ratio": ratio, "scale": scale, "range": clip(F.col("span") / F.greatest("frame_h", F.lit(1)) / 0.7, 0.4, 1.0)})
    speed = F.greatest(
        F.lit(0.5),
        F.least(3.0 / (1.0 + (F.col("ratio") - 1.0) * 0.4), F.col("typical") / F.greatest("gap", F.lit(1.0)) * 0.25),
    )
    pick = lambda own, base: F.when(F.col("adapts"), own).otherwise(F.lit(base))
    return s.select(
        "video_id",
        F.coalesce("points", F.lit(0)).cast("int").alias("points"),
        pick(F.col("gap"), 0.0).alias("avg_gap"),
        pick(F.col("ratio"), 1.0).alias("gap_ratio"),
        pick(F.greatest(F.lit(5), (F.col("gap") * 3.5).cast("int")), 5).alias("max_frame_gap"),
        pick(speed, 3.0).alias("min_speed"),
        pick(F.greatest(F.lit(20.0), 60.0 / F.col("ratio") * F.col("range")), 60.0).alias("min_flight"),
        F.lit(CONFIG.skip_angle).alias("skip_angle"),
        pick(F.greatest(F.lit(5), (12 * F.col("scale") * 7 / 12).cast("int")), 12).alias("peak_distance"),
        pick(F.greatest(F.lit(10), (15 * F.col("scale")).cast("int")), 15).alias("near_future"),
        pick(F.greatest(F.lit(0.0), 20.0 / F.pow("ratio", F.lit(1.5))), 20.0).alias("min_floor_drop"),
        pick(clip(85.0 + (F.col("ratio") - 1.0) * 5.0, 85.0, 95.0), 85.0).alias("floor_pct"),
        F.lit(CONFIG.peak_threshold_ratio).alias("threshold_ratio"),
    )


def percentile_by_rank(points: DataFrame, value: str, percent: str) -> DataFrame:
    """(video_id, limit): linear percentile of `value` at each video's own `percent` (a column), by rank."""
    order = video().orderBy(value, "frame")
    ranked = points.select(
        "video_id", value, F.row_number().over(order).alias("r"), ((F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 1) * F.col(percent) / 100.0).alias("pos")
    )
    low = F.max(F.when(F.col("r") - 1 == F.floor("pos"), F.col(value)))
    high = F.max(F.when(F.col("r") - 1 == F.ceil("pos"), F.col(value)))
    part = F.max(F.col("pos") - F.floor("pos"))
    return ranked.groupBy("video_id").agg((low + (high - low) * part).alias("limit"))
