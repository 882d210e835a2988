"""Only what is new: results kept by video with a fingerprint of what they were made from."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG, Config

_MANIFEST = "video_id string, fingerprint string, run string, step long"


def fingerprints(frames: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(video_id, fingerprint): of a video's frames in any order and of the configuration.

    The rows' hashes are summed and joined by exclusive or, which partial sums do before the shuffle; a video of any
    length is one narrow row per task. Repeated frames count."""
    one = F.xxhash64("frame", "x", "y")
    own = frames.groupBy("video_id").agg(F.count("*").alias("n"), F.bit_xor(one).alias("mixed"), F.sum(one.cast("decimal(38,0)")).alias("total"))
    return own.select("video_id", F.sha2(F.concat_ws("|", "n", "mixed", "total", F.lit(repr(config))), 256).alias("fingerprint"))


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, fingerprint, run): the latest run of each video; empty before the first."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], _MANIFEST).drop("step")
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    last = Window.partitionBy("video_id").orderBy(F.desc("step"), F.desc("run"))
    return rows.withColumn("r", F.row_number().over(last)).filter("r = 1").select("video_id", "fingerprint", "run")


def fresh(frames: DataFrame, path: str, config: Config = CONFIG) -> DataFrame:
    """(video_id, fingerprint) of the videos that are new, or changed, or were made under another configuration."""
    return fingerprints(frames, config).join(manifest(frames.sparkSession, path).select("video_id", "fingerprint"), ["video_id", "fingerprint"], "left_anti")


def renew(frames: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, config: Config = CONFIG) -> str | None:
    """Computes results (rows with video_id) of the fresh videos alone and keeps them under path; the run's name, or
    None if nothing was fresh.

    Results are written first and the manifest's rows last: a run that fails leaves nothing that counts. A video
    that gives no row is in the manifest too, so it isn't computed again."""
    spark, run = frames.sparkSession, uuid4().hex
    todo = fresh(frames, path, config)
    todo.write.parquet(f"{path}/asked/run={run}")
    todo = spark.read.schema("video_id string, fingerprint string").parquet(f"{path}/asked/run={run}")
    if todo.isEmpty():
        return None
    compute(frames.join(todo.select("video_id"), "video_id", "left_semi")).write.parquet(f"{path}/results/run={run}")
    step = 1
    if _exists(spark, f"{path}/manifest"):
        step = (spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").agg(F.max("step")).first()[0] or 0) + 1
    todo.select("video_id", "fingerprint", F.lit(run).alias("run"), F.lit(step).cast("long").alias("step")).write.mode("append").parquet(f"{path}/manifest")
    return run


def results(spark: SparkSession, path: str) -> DataFrame:
    """The results of every video's latest run; superseded ones are left out."""
    rows = spark.read.parquet(f"{path}/results").withColumn("run", F.col("run").cast("string"))
    return rows.join(manifest(spark, path).select("video_id", "run"), ["video_id", "run"], "left_semi").drop("run")
