"""Operator 7: license scans by diagonal voting, in DataFrame functions only.

All rolling word pairs of all texts are hash-joined to the positions of the templates' pairs. A pair
at word p that is the template's t-th votes for diagonal p - t; a full diagonal is a phrase. Diagonals
are merged in overlapping bands whose width follows from the template, so that a few inserted or lost
words don't split a template and a text can't chain diagonals without end. A band's votes are a span
only if enough of the template's words stand in it in their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import ascii_lower, row_key

#: What parts words, in lower-cased text.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: One word in so many of a template may be lost or changed, one at least.
ONE_IN = 5


@dataclass(frozen=True)
class Template:
    """Lower-cased words that stand for a label; `base` phrases must stand word for word."""

    words: str
    label: str
    base: bool = False


# The base phrases, then openings of public license texts and notices.
TEMPLATES = (
    Template("cc by", "cc-by", True),
    Template("general public license", "gpl", True),
    Template("all rights reserved", "reserved", True),
    Template("released under the mit license", "mit"),
    Template("licensed under the mit license", "mit"),
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    Template("licensed under the apache license version 2 0", "apache-2.0"),
    Template("you may not use this file except in compliance with the license", "apache-2.0"),
    Template("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    Template("subject to the terms of the mozilla public license", "mpl"),
    Template("licensed under the gnu general public license", "gpl"),
    Template("this program is free software you can redistribute it and or modify it", "gpl"),
    Template("licensed under a creative commons attribution", "cc-by"),
    Template("this is free and unencumbered software released into the public domain", "unlicense"),
)


def template_positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, place, length, errors, label, base, hash, t_first, t_second): a row for each word pair
    of each template. As long as the templates, whatever the corpus."""
    rows = []
    for n, t in enumerate(templates):
        w = t.words.split()
        errors = 0 if t.base else max(1, len(w) // ONE_IN)
        rows += [(n, i, len(w), errors, t.label, t.base, a, b) for i, (a, b) in enumerate(zip(w, w[1:]))]
    table = spark.createDataFrame(rows, "template int, place int, length int, errors int, label string, base boolean, t_first string, t_second string")
    return table.withColumn("hash", F.xxhash64("t_first", "t_second"))


def _votes(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(doc_id, key, last, at, template, place, ...): the verified votes of each row, and for each row one
    more without a template, marked `last`, in which `at` is the number of its words.

    Words meet their successors in one pass over the text; exploded rows carry one pair and no array."""
    words = docs.select(
        "doc_id", row_key().alias("key"),
        F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), GAPS, -1), "").alias("words"),
    )
    edge = F.array(F.lit(None).cast("string"))
    paired = F.arrays_zip(F.concat(edge, "words").alias("first"), F.concat("words", edge).alias("second"))
    pairs = words.select("doc_id", "key", F.posexplode(paired).alias("at", "pair")).select(
        "doc_id", "key", "at", "pair.first", "pair.second",
        F.when(F.col("pair.first").isNotNull() & F.col("pair.second").isNotNull(), F.xxhash64("pair.first", "pair.second")).alias("hash"),
    )
    last = F.col("second").isNull()
    met = pairs.join(F.broadcast(template_positions(docs.sparkSession, templates)), "hash", "left").filter(
        last | (F.col("first") == F.col("t_first")) & (F.col("second") == F.col("t_second"))
    )
    return met.select(
        "doc_id", "key", last.alias("last"), F.when(last, F.col("at")).otherwise(F.col("at") - 1).alias("at"),
        "template", "place", "length", "errors", "label", "base",
    )


def _in_order(votes: Column) -> Column:
    """The most template words that stand in their order in the text, by voted pairs: the longest run of
    rising words among the voted ones, sorted by template word. Bounded by a band of one template."""
    ends = lambda step: F.transform(votes, lambda v: F.struct((v["place"] + step).alias("t"), (-v["at"] - step).alias("p")))
    points = F.array_sort(F.array_union(ends(0), ends(1)))  # later text words first within a template word

    def put(least: Column, point: Column) -> Column:
        n = F.size(F.filter(least, lambda x: x < -point["p"]))
        return F.concat(F.slice(least, F.lit(1), n), F.array(-point["p"]), F.slice(least, n + 2, F.size(least)))

    return F.size(F.aggregate(points, F.array().cast("array<int>"), put))


def _bands(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """Rows of license_spans, and one without a label for each row of docs, with `words` and `copies`."""
    diagonal = F.col("at") - F.col("place")
    band = F.floor(diagonal / F.col("errors"))
    bands = F.when(F.col("template").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("base"), F.array(diagonal.cast("long"))).otherwise(F.array(band, band - 1))
    found = (
        _votes(docs, templates).withColumn("band", F.explode(bands))
        .groupBy("doc_id", "key", "template", "length", "errors", "label", "base", "band")
        .agg(
            F.collect_set(F.when(F.col("template").isNotNull(), F.struct("place", "at"))).alias("votes"),
            F.max(F.when(F.col("last"), F.col("at"))).alias("words"), F.count_if("last").alias("copies"),
        )
    )
    enough = F.size("votes") >= F.col("length") - 1 - 2 * F.col("errors")
    matched = F.when(enough, _in_order(F.col("votes"))).otherwise(F.lit(0))
    return (
        found.withColumn("matched", F.when(F.col("template").isNotNull(), matched))
        .filter(F.col("template").isNull() | (F.col("matched") >= F.col("length") - F.col("errors")))
        .select(
            "doc_id", "key", "label", "base", "words", "copies", F.array_min("votes.at").alias("start"),
            (F.array_max("votes.at") + 2).alias("end"), "length", "matched",
        )
        .withColumn("coverage", F.col("matched") / F.greatest("length", F.col("end") - F.col("start")))
    )


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, key, label, base, start, end, coverage): one row per phrase or template found in a text.

    Words start..end-1 hold the span; `coverage` is how many of the template's words stand in it in order,
    by pairs that agree, over the longer of both. A template of n words may lose n // ONE_IN of them, one at least, and
    gain fewer than twice as many; a base phrase must stand word for word. Votes are gathered by band,
    which the template bounds, however long the text. Repeated rows are found once.
    """
    spans = _bands(docs, templates).filter("label IS NOT NULL")
    return spans.groupBy("doc_id", "key", "label", "base", "start", "end").agg(F.max("coverage").alias("coverage"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no word, no label and score 0. Base phrases score 1, a template its
    coverage, a text its best; equal scores need no order. Texts are read once, whole. Repeated rows get
    the same result each; an empty table gives no row; other columns aren't read.
    """

    def joined(kept: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",")

    start = F.when(F.col("base"), F.col("start"))
    found = _bands(docs, templates).groupBy("doc_id", "key").agg(
        F.max("words").cast("long").alias("n_words"),
        F.count_if("base").alias("n_base"),
        F.min(start).cast("long").alias("first_word"),
        F.max(start).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.lit(True)).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.sum("copies").alias("copies"),
    )
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """scan_licenses over all documents."""
    from trackloom.llm.common import read

    return scan_licenses(read(spark, sf_dir, "documents"))
