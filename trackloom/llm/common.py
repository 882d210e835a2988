"""What the corpus operators share: word rules, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import let

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    """A test table by the path rule of the driver; any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


#: Elements of a block of `running`.
_STRIDE = 256


def running(values: Column, step, zero: Column) -> Column:
    """array: step's result up to and with each element, as of a sum or a maximum (associative, `zero` its neutral).

    In blocks, whose last results run on to the next ones: a plain fold that appends to its result copies it with
    every element, which is quadratic in a long array; this copies at most a block and the list of blocks."""

    def fold(array: Column, value, out) -> Column:
        start = F.struct(zero.alias("last"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, start, lambda acc, v: F.struct(step(acc["last"], value(v)).alias("last"), F.concat(acc["out"], F.array(out(acc, v))).alias("out")))

    def whole(array: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.size(array) / _STRIDE).cast("int"))
        blocks = F.transform(starts, lambda i: fold(F.slice(array, i * _STRIDE + 1, _STRIDE), lambda v: v, lambda acc, v: step(acc["last"], v)))
        return let(blocks, carried)

    def carried(blocks: Column) -> Column:
        before = fold(blocks, lambda b: b["last"], lambda acc, b: acc["last"])["out"]
        return F.flatten(F.zip_with(blocks, before, lambda b, last: F.transform(b["out"], lambda v: step(last, v))))

    return let(values, whole)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A non-null 64-bit key of a row's id and text, which repeated rows share. Links and finds that it leads to are
    verified on the texts; where rows are dropped by it, unlike rows that shared a key by chance (at 10^9 rows
    the chance of any such pair is some 3 %) would be taken for one."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def id_fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo; -1 where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))
