"""Cleaning and impulses over a stream of frames, with bounded look-ahead and mergeable quantile sketches.

The batch plans' own rules run on what a micro-batch brings and on the few points that a video carries over: those that
are not decided yet, as what they look at hasn't come, and a halo of decided ones. What the rules need of the whole
video is taken from sketches of all that came so far (KLL, merged batch by batch), exact up to SKETCH values and
within about 0.3 % of rank beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackloom.config import CONFIG, Config
from trackloom.functions.geometry import let
from trackloom.functions.series import by_frame, video
from trackloom.functions.stages import Shelf
from trackloom.operators import cleaning, impulse
from trackloom.plans.blocks import HALO
from trackloom.sources.trajectories import normalised
from trackloom.streaming.sinks import commit, committed, ledger

#: Values that a sketch holds as they are.
SKETCH = 2048
#: Points of a video that are waited for before the first is decided, so that its medians have settled: a minute at 30 a second.
HOLD = 1800
#: Points after one that a cleaning pass looks at: two for a detour of two, and three for a run of spikes.
AHEAD = 5
#: The number of a video's points while it isn't known.
_OPEN = 1 << 30

_STATE = "video_id string, last int, ended boolean, steps binary, one binary, two binary, gaps binary, heights binary, one_carried int, two_carried int, low double, high double"
_TAIL = "video_id string, frame int, x double, y double, k int, done boolean"


#: Ranks, as a constant that the sketch's function takes: one at least falls to each of up to SKETCH values.
_RANKS = ",".join(str(j / (2 * SKETCH)) for j in range(1, 2 * SKETCH + 1))


def median(sketch: str) -> Column:
    """The median of a sketched column, the mean of the two in the middle; null without a value."""
    at = lambda rank: F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(rank))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, (at(0.5) + at(0.5 + 1e-6)) / 2)


def quantile(sketch: str, share: Column | float) -> Column:
    """The linear quantile of a sketched column at a share that may be a column; null without a value."""
    n = F.kll_sketch_get_n_double(sketch)
    pos = (n - 1) * share
    ranks = F.kll_sketch_get_quantile_double(F.col(sketch), F.split(F.lit(_RANKS), ",").cast("array<double>"))
    at = lambda values, place: F.get(values, F.floor(place / n * (2 * SKETCH)).cast("int"))
    value = lambda v: at(v, F.floor(pos)) + (at(v, F.ceil(pos)) - at(v, F.floor(pos))) * (pos - F.floor(pos))
    return F.when(n > 0, let(ranks, value))


def _grown(state: DataFrame, name: str, rows: DataFrame, value: str) -> DataFrame:
    """state with the rows' values merged into each video's sketch `name`."""
    new = rows.filter(F.col(value).isNotNull()).groupBy("video_id").agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH).alias("new"))
    both = F.coalesce(F.kll_sketch_merge_double(name, "new"), "new", name)
    return state.join(new, "video_id", "left").withColumn(name, both).drop("new")


def _placed(tail: DataFrame, new: DataFrame) -> DataFrame:
    """Points carried over and new ones, which are `fresh`, with places that run on; `top` is the last one."""
    after = tail.groupBy("video_id").agg((F.max("k") + 1).alias("from"))
    k = F.row_number().over(by_frame()) - 1 + F.coalesce("from", F.lit(0))
    new = new.select("video_id", "frame", "x", "y").join(after, "video_id", "left").withColumn("k", k.cast("int")).drop("from")
    p = tail.withColumn("fresh", F.lit(False)).unionByName(new.withColumns({"done": F.lit(False), "fresh": F.lit(True)}))
    return p.withColumns({"top": F.max("k").over(video()), "first": F.min("k").over(video())})


def _tail(p: DataFrame, halo: int) -> DataFrame:
    """Of points with `decides` those that later ones need: `halo` decided ones and all that wait; none of an ended video."""
    p = p.withColumn("done", F.col("done") | F.col("decides"))
    edge = F.coalesce(F.max(F.when(F.col("done"), F.col("k"))).over(video()), F.lit(-1))
    return p.withColumn("edge", edge).filter(~F.col("ended") & (F.col("k") > F.col("edge") - halo))


def _pass(shelf: Shelf, name: str, state: DataFrame, tail: DataFrame, new: DataFrame, hold: int, c: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A cleaning pass: its state, its next tail, and the points that it decides to keep."""
    p = _placed(tail, new)
    if name == "one":
        state = shelf.put("state", _grown(state, "steps", cleaning.steps(p).filter("fresh AND step > 0"), "step"))
    known = state.select("video_id", "ended", F.coalesce(median("steps"), F.lit(1.0)).alias("typical"))
    p = p.join(known, "video_id").withColumn("n", F.when(F.col("ended"), F.col("top") + 1).otherwise(_OPEN))
    if name == "one":
        p = p.withColumn("typical", F.when(F.col("n") < 4, 1.0).otherwise(F.col("typical")))
    p = shelf.put(name, cleaning.detours(p, c).select(*p.columns, "one", "two", "s_in", "s_out"))
    state = shelf.put("state", _grown(state, name, p.filter("fresh AND s_in > 0"), "s_in"))
    usual = state.select("video_id", F.coalesce(median(name), F.lit(1.0)).alias("usual"), F.coalesce(f"{name}_carried", F.lit(-1)).alias("carried"))
    settled = (F.col("first") == 0) | (F.col("k") >= F.col("first") + 3)
    p = cleaning.spikes(p.join(usual, "video_id"), c, settled, F.col("carried"))
    ready = F.col("ended") | (F.col("top") + 1 >= hold) & (F.col("k") <= F.col("top") - AHEAD)
    p = shelf.put(name, p.withColumn("decides", ~F.col("done") & ready).withColumn("plain", ~F.col("two") & settled))
    rest = shelf.put(f"{name}-tail", _tail(p, HALO))
    # The last place without a detour of two, ahead of where the next batch's rows are settled.
    begins = rest.groupBy("video_id").agg((F.min("k") + 3).alias("begins"))
    carried = p.join(begins, "video_id").filter("plain AND k < begins").groupBy("video_id").agg(F.max("k").alias("carried"))
    state = state.join(carried, "video_id", "left").withColumn(f"{name}_carried", F.coalesce("carried", f"{name}_carried")).drop("carried")
    return shelf.put("state", state), rest, p.filter("decides AND NOT gone")


def _judge(shelf: Shelf, state: DataFrame, tail: DataFrame, new: DataFrame, videos: DataFrame, c: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Impulses of cleaned points: the state, the next tail, and the points that are judged."""
    p = shelf.put("cleaned", cleaning.steps(_placed(tail, new)))
    fresh = p.filter("fresh")
    state = _grown(_grown(state, "gaps", fresh, "gap"), "heights", fresh, "y")
    state = state.join(fresh.groupBy("video_id").agg(F.min("y").alias("a"), F.max("y").alias("b")), "video_id", "left")
    state = state.withColumns({"low": F.least("low", "a"), "high": F.greatest("high", "b")}).drop("a", "b")
    state = shelf.put("state", state)
    points = F.coalesce(F.kll_sketch_get_n_double("heights"), F.lit(0)).cast("int")
    typical = F.coalesce(median("steps"), F.lit(1.0))
    stats = state.select("video_id", points.alias("points"), median("gaps").alias("gap"), typical.alias("typical"), (F.col("high") - F.col("low")).alias("span"))
    params = cleaning.parameters(stats, videos.join(state.select("video_id"), "video_id", "left_semi"))
    limits = params.join(state, "video_id").select("video_id", "near_future", "ended", quantile("heights", F.col("floor_pct") / 100.0).alias("limit"))
    whole = by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {f"{a}_end": F.when(F.col("ended"), F.last(a).over(whole)) for a in "xy"}
    p = p.drop("step", "gap").join(limits.drop("near_future"), "video_id").withColumn("n", F.when(F.col("ended"), F.col("top") + 1).otherwise(_OPEN))
    judged = impulse.judged_neighbours(impulse.neighbours(p).withColumns(ends).join(params, "video_id"), p, None, c)
    seen = (F.col("k") <= F.col("top") - 3) & (F.col("frame") + F.col("near_future") < F.max("frame").over(video()))
    p = p.join(limits.select("video_id", "near_future"), "video_id").withColumn("decides", ~F.col("done") & (F.col("ended") | seen))
    p = shelf.put("decided", p)
    out = judged.join(p.filter("decides").select("video_id", "frame"), ["video_id", "frame"], "left_semi")
    return state, _tail(p, 2), out


def _advance(batch: DataFrame, number: int, videos: DataFrame, folder: str, query: str, hold: int, c: Config) -> None:
    """One micro-batch: the state of the batch before and new frames -> the next state and finished rows.

    A batch that is handed over again starts from the same state and overwrites what it left, so it gives the same."""
    spark = batch.sparkSession
    if committed(spark, number, f"{query}-impulses", folder):
        return
    shelf, names = Shelf(spark), {"state": _STATE, "one": _TAIL, "two": _TAIL, "cleaned": _TAIL}
    at = lambda n, name: f"{folder}/state/{query}/{n}/{name}"
    old = {n: spark.read.schema(kind).parquet(at(number - 1, n)) if number else spark.createDataFrame([], kind) for n, kind in names.items()}
    new = normalised(batch.select("video_id", "frame", "x", "y")).dropDuplicates(["video_id", "frame"])
    new = new.join(old["state"].select("video_id", "last", "ended"), "video_id", "left").filter("ended IS NULL OR NOT ended AND frame > last")
    new = shelf.put("new", new.select("video_id", "frame", "x", "y"))
    state = old["state"].join(new.groupBy("video_id").agg(F.max("frame").alias("come")), "video_id", "full")
    state = state.withColumn("last", F.coalesce("come", "last")).drop("come").join(videos.select("video_id", "n_frames"), "video_id", "left")
    state = state.withColumn("ended", F.coalesce(F.col("last") >= F.col("n_frames") - 1, F.lit(False))).drop("n_frames")
    live = shelf.put("state", state)
    live, one, once = _pass(shelf, "one", live, old["one"], cleaning.valid_points(new), hold, c)
    live, two, twice = _pass(shelf, "two", live, old["two"], once, 0, c)
    live, cleaned, judged = _judge(shelf, live, old["cleaned"], twice, videos, c)
    for name, table in {"state": live, "one": one, "two": two, "cleaned": cleaned}.items():
        if name == "state":  # of an ended video only that it ended
            table = table.withColumns({f.name: F.when(~F.col("ended"), F.col(f.name)) for f in table.schema[3:]})
        fields = spark.createDataFrame([], names[name]).columns
        table.select(*fields).write.mode("overwrite").parquet(at(number, name))
    commit(twice.select("video_id", "frame", "x", "y"), number, f"{query}-cleaned", folder)
    commit(judged, number, f"{query}-impulses", folder)
    shelf.drop(*list(shelf.paths))
    if number > 1:
        past = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{query}/{number - 2}")
        past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)


def stream_impulses(frames: DataFrame, videos: DataFrame, folder: str, checkpoint: str, query: str, hold: int = HOLD, config: Config = CONFIG) -> StreamingQuery:
    """Starts a stream of (video_id, frame, x, y) into folder: each batch's cleaned points and judged points (as
    impulse.judged_points gives them), once each; read_cleaned and read_impulses read them.

    Frames come in order from batch to batch, in any order within one; a frame behind its video's latest one of an
    earlier batch is left out, and of repeated ones one stays. A video ends with frame n_frames - 1 of `videos`; one that isn't
    listed there never ends. Until then it carries at most `hold` points and five sketches, and afterwards one small row.

    A video of up to `hold` points gives what the batch plans give. A longer one is cleaned by the medians of all that
    came before a point is decided, not of its whole; its thresholds (gap, range, floor) are those of so far; and the flight
    filter, which looks at the last point, judges only the points that still wait when the video ends.
    """
    if not 0 <= hold <= SKETCH:
        raise ValueError(f"hold is at most {SKETCH}, what a sketch keeps exactly")
    return (
        frames.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, n: _advance(df, n, videos, folder, query, hold, config)).trigger(availableNow=True).start()
    )


def _read(spark: SparkSession, folder: str, query: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data/query={query}")
    lines = ledger(spark, folder).filter(F.col("query") == query).select("batch")
    return rows.withColumn("batch", F.col("batch").cast("long")).join(lines, "batch", "left_semi").drop("query", "batch")


def read_cleaned(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(video_id, frame, x, y) of the committed batches."""
    return _read(spark, folder, f"{query}-cleaned")


def read_impulses(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(video_id, frame, x, y, impulse, dropped) of the committed batches."""
    return _read(spark, folder, f"{query}-impulses")
