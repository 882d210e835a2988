"""A sink that writes each micro-batch once, however often Spark hands it over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_LEDGER = "query string, batch long, rows long"


def _committed(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def committed(spark: SparkSession, number: int, query: str, path: str) -> bool:
    """True if the batch has its line in the ledger."""
    return _committed(spark, f"{path}/ledger/query={query}/batch={number}/_SUCCESS")


def commit(batch: DataFrame, number: int, query: str, path: str) -> bool:
    """Writes a batch's rows under path/data and then its line under path/ledger; False if that line is there already.

    A batch that failed half-way has no line: its folder is written anew, and readers never saw it. A batch that
    Spark replays after its line was written changes nothing. The ledger's line comes with a rename, so it is there
    whole or not at all.
    """
    spark, key = batch.sparkSession, f"query={query}/batch={number}"
    if committed(spark, number, query, path):
        return False
    batch.write.mode("overwrite").parquet(f"{path}/data/{key}")
    rows = spark.read.schema(batch.schema).parquet(f"{path}/data/{key}").count()
    line = spark.createDataFrame([(rows,)], "rows long")
    line.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/ledger/{key}")
    return True


def write_once(rows: DataFrame, path: str, checkpoint: str, query: str) -> StreamingQuery:
    """Starts a stream of result rows (documents, messages, hits) into path, each batch once. `query` names the
    stream and stands for its checkpoint: another checkpoint counts its batches anew, so give it another name."""
    return (
        rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, n: commit(df, n, query, path) and None).trigger(availableNow=True).start()
    )


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch, rows) of what was committed."""
    lines = spark.read.schema(_LEDGER).parquet(f"{path}/ledger")
    return lines.select("query", "batch", "rows")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed batches, with `query` and `batch`; what a failed batch left behind is not among them."""
    rows = spark.read.parquet(f"{path}/data").withColumns({"query": F.col("query").cast("string"), "batch": F.col("batch").cast("long")})
    return rows.join(ledger(spark, path).select("query", "batch"), ["query", "batch"], "left_semi")
