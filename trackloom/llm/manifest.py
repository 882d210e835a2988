"""Operator 11: a Merkle manifest of a dataset, hashed in blocks by DuckDB on the executors.

Each row is a leaf; the leaves of a group (a language) form a binary tree in the order of their ids, and the
groups' roots form one more. A tree is cut into aligned blocks of 2^bits nodes. Spark numbers the leaves and
deals out the blocks; on the executors DuckDB takes a block's Arrow table up its levels, each one ordered
string_agg and sha256, and reads off every node's siblings. The blocks' roots are nodes of the next round,
and their siblings are joined on as the outer proof. No tree, group or list of roots is ever in one place.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.ranks import joined_small, ranked
from trackloom.functions.stages import Shelf

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block has 4,096 nodes, some 300 KB.
BITS = 12


def hashed(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its UTF-8 bytes' number, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf of a row, with some fields replaced."""
    return hashed(*(field(changed.get(c, F.col(c))) for c in FIELDS))


@cache
def _engine():
    """One DuckDB connection a Python worker, on one thread and with bounded memory."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def _climb(bits: int):
    """Arrow table of one block (at, node, total, ...) -> it with `siblings` from below and `top`, its root."""

    def run(block: pa.Table) -> pa.Table:
        total, engine = block.column("total")[0].as_py(), _engine()
        height = min(bits, max(0, total - 1).bit_length())
        engine.register("block", block)
        engine.execute(f"CREATE OR REPLACE TEMP TABLE nodes AS SELECT 0 AS level, \"at\" % {1 << bits} AS place, node FROM block")
        for level in range(height):
            engine.execute(
                f"INSERT INTO nodes SELECT {level + 1}, place // 2, sha256(string_agg(node, '' ORDER BY place)) "
                f"FROM nodes WHERE level = {level} GROUP BY place // 2"
            )
        top = engine.execute(f"SELECT node FROM nodes WHERE level = {height}").fetchall()[0][0]
        found = engine.sql(
            f"""SELECT b."at", list(s.node ORDER BY k.level) AS siblings
            FROM block b CROSS JOIN (SELECT unnest(range({height})) AS level) k
            LEFT JOIN nodes s ON s.level = k.level AND s.place = xor((b."at" % {1 << bits}) >> k.level, 1)
            GROUP BY b."at" ORDER BY b."at" """
        ).to_arrow_table()
        engine.unregister("block")
        block = block.sort_by("at")
        kind = pa.list_(pa.string())
        siblings = found.column("siblings").cast(kind) if height else pa.array([[]] * len(block), kind)
        return block.append_column("siblings", siblings).append_column("top", pa.array([top] * len(block), pa.string()))

    return run


def _tree(shelf: Shelf, nodes: DataFrame, by: list[str], name: str, bits: int) -> DataFrame:
    """nodes(by, at, total, node, ...) -> they with `siblings`, from the node to the root of its group
    (null where a node has none), and `top`, that root."""
    rounds = []
    most = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        blocks = nodes.withColumn("block", F.expr(f"shiftright(at, {bits})"))
        climbed = blocks.groupBy(*by, "block").applyInArrow(_climb(bits), _with(blocks))
        rounds.append(shelf.put(f"{name}-{len(rounds)}", climbed))
        if most <= 1 << bits:
            break
        most = -(-most // (1 << bits))
        # A tree that has come to its root goes up no further.
        up = rounds[-1].filter(f"total > {1 << bits} AND at % {1 << bits} = 0")
        total = F.expr(f"shiftright(total + {(1 << bits) - 1}, {bits})")
        nodes = up.select(*by, F.col("block").alias("at"), total.alias("total"), F.col("top").alias("node"))
    out = rounds.pop()
    while rounds:
        outer = out.select(*by, F.col("at").alias("block"), F.col("siblings").alias("__outer"), F.col("top").alias("__top"))
        outer = shelf.put(f"{name}-outer", outer)
        out = joined_small(rounds.pop(), outer, [*by, "block"], "left")
        siblings = F.concat("siblings", F.coalesce("__outer", F.array().cast("array<string>")))
        out = out.withColumns({"siblings": siblings, "top": F.coalesce("__top", "top")}).drop("__outer", "__top")
    return out.drop("block")


def _with(df: DataFrame):
    from pyspark.sql.types import ArrayType, StringType, StructType

    return StructType(list(df.schema.fields)).add("siblings", ArrayType(StringType())).add("top", StringType())


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BITS) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text, ...) -> doc_id, lang, leaf, shown (the leaf that is tried, of
    `tampered` n_chars if given), at and lang_at (places of the leaf and its group), siblings and
    lang_siblings (from below; null where a level has none), subroot, root. One row per row.

    Null fields enter as `-`; a null lang is a group of its own, the first. Null ids come first; rows of one id
    are in the order of their leaves, and repeated rows stand side by side. A text of any length is hashed
    whole and goes no further. An empty table gives no row; other columns are never read.
    """
    shelf = Shelf(docs.sparkSession)
    own = docs.select("doc_id", "lang", leaf().alias("node"), (leaf(n_chars=tampered) if tampered is not None else leaf()).alias("shown"))
    leaves = _tree(shelf, ranked(shelf, own, ["lang"], ["doc_id", "node"]), ["lang"], "tree", bits)
    leaves = shelf.put("leaves", leaves)
    shelf.drop("ranked", "tree-0")
    groups = leaves.filter("at = 0").select("lang", F.col("top").alias("node"))
    groups = _tree(shelf, ranked(shelf, groups, [], ["lang"], "groups").withColumn("one", F.lit(0)), ["one"], "forest", bits)
    groups = groups.select("lang", F.col("at").alias("lang_at"), F.col("siblings").alias("lang_siblings"), F.col("top").alias("root"))
    rows = joined_small(leaves, shelf.put("outer", groups), ["lang"])
    return rows.select("doc_id", "lang", F.col("node").alias("leaf"), "shown", "at", "lang_at", "siblings", "lang_siblings", F.col("top").alias("subroot"), "root")


def folded(start: Column, siblings: Column, at: Column) -> Column:
    """The root that a node and its siblings from below give; `at` tells on which side each one stands."""

    def up(node: Column, step: Column) -> Column:
        pair = F.when(step["left"] == 1, F.concat(step["node"], node)).otherwise(F.concat(node, step["node"]))
        return F.sha2(F.when(step["node"].isNull(), node).otherwise(pair), 256)

    steps = F.transform(siblings, lambda s, k: F.struct(s.alias("node"), F.call_function("shiftright", at, k).bitwiseAND(F.lit(1)).alias("left")))
    return F.aggregate(steps, start, up)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The contract's rows: the manifest of all documents, tried on rows of which every seventh id's is tampered with."""
    from trackloom.llm.common import read

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(read(spark, sf_dir, "documents"), F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    root = folded(folded(F.col("shown"), F.col("siblings"), F.col("at")), F.col("lang_siblings"), F.col("lang_at"))
    proof = F.sha2(F.concat_ws("", "siblings", "lang_siblings"), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same rows by DuckDB: whole levels as lists, crc32 bit by bit.
OP11_SQL = """
WITH RECURSIVE fed AS (
    SELECT doc_id, lang, n_chars,
        list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INT + 1, 1))::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM documents),
leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(strlen(m::VARCHAR) || ':' || m, '-') || tail) AS shown
    FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m FROM fed)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
levels AS (
    SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY lang
    UNION ALL
    SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lang_at FROM levels WHERE len(nodes) = 1),
outer_levels AS (
    SELECT 0 AS level, list(subroot ORDER BY lang_at) AS nodes FROM subroots HAVING count(*) > 0
    UNION ALL
    SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM outer_levels WHERE len(nodes) > 1),
steps AS (
    SELECT doc_id, p.lang, place, level, (place >> level) & 1 AS side, nodes[xor(place >> level, 1) + 1] AS sibling
    FROM placed p JOIN levels l ON p.lang IS NOT DISTINCT FROM l.lang WHERE len(nodes) > 1
    UNION ALL
    SELECT doc_id, p.lang, place, 1000 + level, (lang_at >> level) & 1, nodes[xor(lang_at >> level, 1) + 1]
    FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN outer_levels o WHERE len(nodes) > 1),
paths AS (SELECT lang, place, list({'side': side, 'sibling': sibling} ORDER BY level) AS path, string_agg(sibling, '' ORDER BY level) AS siblings FROM steps GROUP BY lang, place),
climbs AS (
    SELECT p.lang, p.place, p.doc_id, p.leaf, p.shown AS node, coalesce(path, []) AS path, coalesce(siblings, '') AS siblings, 1 AS i
    FROM placed p LEFT JOIN paths USING (place) WHERE p.lang IS NOT DISTINCT FROM paths.lang OR paths.place IS NULL
    UNION ALL
    SELECT lang, place, doc_id, leaf,
        sha256(CASE WHEN path[i].sibling IS NULL THEN node WHEN path[i].side = 1 THEN path[i].sibling || node ELSE node || path[i].sibling END), path, siblings, i + 1
    FROM climbs WHERE i <= len(path))
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(siblings) AS proof_sha256, node AS folded_root, node = nodes[1] AS verified
FROM climbs c JOIN subroots s ON c.lang IS NOT DISTINCT FROM s.lang CROSS JOIN outer_levels o
WHERE i > len(path) AND len(nodes) = 1
"""
