"""The corpus pipeline: documents in, a mixed training set out, one operator a stage.

Every stage takes all that the one before kept. The first four return the columns of documents;
columns beyond these are left out first, so none can clash. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.stages import Shelf
from trackloom.llm import decontam, mixing, near_dedup, quality_crf, secrets
from trackloom.llm.common import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line field predicts to be bad. A null text counts as an empty one;
    repeated rows stay or go together. Without labels of both kinds the known one decides, or all stay."""
    return quality_crf.keep_good(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at 0.8 or more on shingles of five words: the smallest id, and one
    of its repeated rows. Rows without a word, null texts among them, all stay; rows without an id take part."""
    return near_dedup.keep_one(docs.select(*COLUMNS), k=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item. Null and empty texts hold none and stay;
    repeated rows stay or go together."""
    return decontam.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the text; n_chars follows, and no document goes. Null texts stay null."""
    clean = secrets.redact(secrets.scan_secrets(docs.select(*COLUMNS)))
    chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", chars).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document as often as its source's rate says, numbered in `copy`. A null source is one
    of its own; texts without a word have size 0 and are dealt out like others; repeated rows draw alike."""
    mixed = mixing.mix_sources(docs, carry=("lang", "n_chars"))
    return mixing.emit_copies(mixed).select(*COLUMNS, "size", "source_size", "target", "copy")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing_sources", mixing_sources),
]

#: SQL can express neither the field nor the sketch search. tests/llm runs every stage on planted rows, and compares
#: the groups of near duplicates with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written for the next in the shared folder."""
    docs, shelf = read(spark, sf_dir, "documents"), Shelf(spark)
    for name, stage in STAGES[:-1]:
        docs = shelf.put(name, stage(spark, docs, sf_dir))
    shelf.drop(*(name for name, _ in STAGES[:-2]))
    return STAGES[-1][1](spark, docs, sf_dir)
