"""Operator 4: near-duplicate groups by fast similarity sketching, banding and exact verification.

The sketch has T coordinates. Round i < T throws every shingle into one hashed bin with the value
(i, hash); round T + j throws all into bin j, so every coordinate is filled after 2T rounds, in
practice after a few, and the share of equal coordinates concentrates around the similarity as if
sampled without replacement. BANDS bands of ROWS coordinates give candidate buckets.

Links are confirmed on the full shingle sets. A pair at a similarity of 0.8 meets in no band with
probability (1 - 0.8^5)^36 < 1e-6, and fails the test of sketch bits with probability < 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.stages import Shelf
from trackloom.llm.common import WORD, row_key
from trackloom.llm.components import connected_components

BANDS, ROWS = 36, 5
T = BANDS * ROWS
#: PLANES bits of each coordinate are kept. A pair at 0.8 differs in 34 of T on average, with a deviation
#: of 5.2, in over MOST_DIFFER almost never; of pairs at 0.6, 14 in 100 pass, of those at 0.5 one in 6,000.
PLANES, MOST_DIFFER = 4, 60
#: Pairs that no leader could join are held against WIDE coordinates of WIDE_PLANES bits too. A pair at 0.8
#: differs in 307, with a deviation of 16.2; of pairs at 0.72, 2 in 100 pass.
WIDE, WIDE_PLANES, MOST_WIDE = 2048, 2, 388
#: A bucket's members are compared in blocks of about so many, each pair of blocks in a task of its own.
IN_BLOCK = 1024
#: Nodes of rows without doc_id lie above all ids.
NO_ID = 1 << 62
#: Bytes of text that a task sketches at once.
BLOCK = 4 << 20

_FULL = np.uint64(2**64 - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split parts at exactly the six ASCII white-space bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(tokens: list[bytes], k: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out * _GOLD + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t uint64 coordinates for each non-empty set."""
    lengths = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    out, alive = np.full(len(sets) * t, _FULL), np.arange(len(sets))
    for i in range(2 * t):
        x = mix(flat + np.uint64((i + 1) * int(_GOLD) % 2**64))
        bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, (np.uint64(i) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
        if i % 16 and i > 3:  # a few rounds too many change nothing: their values are higher
            continue
        still = (out.reshape(-1, t)[alive] == _FULL).any(1)
        if not still.any():
            break
        if not still.all():
            alive = alive[still]
            keep = np.isin(owner, alive)
            flat, owner = flat[keep], owner[keep]
    return out.reshape(-1, t)


def _bands(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        h = mix(h * _GOLD + rows[:, :, r])
    return h.view(np.int64)


def _planes(sketch: np.ndarray, planes: int = PLANES) -> np.ndarray:
    """So many bits of every coordinate, in whole words of 64: plane by plane."""
    t = sketch.shape[1]
    low, bits = mix(sketch), np.zeros((len(sketch), planes, -(-t // 64) * 64), np.uint8)
    for p in range(planes):
        bits[:, p, :t] = (low >> np.uint64(p)) & np.uint64(1)
    return np.packbits(bits, axis=2).view(np.int64).reshape(len(sketch), planes * -(-t // 64))


_SKETCHED = "doc_id long, key long, n_shingles long, set1 long, set2 long, bands array<long>, planes array<long>"


def _sketch(k: int):
    def block(rows: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        has = np.array([len(s) > 0 for s in sets])
        full = [s for s in sets if len(s)]
        sketch = sketches(full) if full else np.empty((0, T), np.uint64)
        digests = np.zeros((len(sets), 2), np.int64)
        if full:
            digests[has] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in full), np.int64).reshape(-1, 2)

        def lists(values: np.ndarray) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(has) * values.shape[1]]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))

        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").cast(pa.int64()), rows.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests[:, 0], mask=~has), pa.array(digests[:, 1], mask=~has), lists(_bands(sketch)), lists(_planes(sketch)),
            ],
            ["doc_id", "key", "n_shingles", "set1", "set2", "bands", "planes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, start, size = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                size += len(text or "")
                sets.append(shingle_hashes(words(text), k))
                if size >= BLOCK or i == len(batch) - 1:
                    yield block(batch.slice(start, len(sets)), sets)
                    sets, start, size = [], i + 1, 0

    return run


def _wide(k: int):
    """(id, wide) of (id, text): the bits of a sketch of WIDE coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 128):
                rows = batch.slice(start, 128)
                sets = [shingle_hashes(words(t.as_py()), k) for t in rows.column("text")]
                bits = _planes(sketches(sets, WIDE), WIDE_PLANES)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * bits.shape[1]
                wide = pa.ListArray.from_arrays(pa.array(ends), pa.array(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([rows.column("id"), wide], ["id", "wide"])

    return run


def _shingles(text: str, k: int = 4) -> set[tuple[bytes, ...]]:
    w = words(text)
    return set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)}


def _linked(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            left, right = [], []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                if last[0] != a:
                    last = (a, _shingles(batch.column("text_a")[i].as_py(), k))
                x, y = last[1], _shingles(batch.column("text_b")[i].as_py(), k)
                shared = len(x & y)
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("key").alias("id"), "text").dropDuplicates(["id"])


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, shelf: Shelf) -> DataFrame:
    """The pairs (a, b) of row keys whose full shingle sets are at least 0.8 alike. The text of b comes
    first, as a member has few leaders. A leader's text is then sent once to every IN_BLOCK members that
    it meets, so that a leader of any number of members is dealt out."""
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / IN_BLOCK).alias("fans")).filter("fans > 1")
    fans = shelf.put("fans", fans)  # one row for IN_BLOCK pairs at most
    dealt = pairs.join(fans, "a", "left").withColumn("fans", F.coalesce("fans", F.lit(1).cast("long")))
    leaders = dealt.select(F.col("a").alias("id"), "fans").distinct().join(_texts(docs), "id").select(
        F.col("id").alias("a"), F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(1).cast("long"), "fans")).alias("fan")
    )
    members = dealt.withColumnRenamed("b", "id").join(_texts(docs), "id").select(
        "a", F.col("id").alias("b"), F.col("text").alias("text_b"), (F.pmod(F.xxhash64("id"), F.col("fans")) + 1).alias("fan")
    )
    return members.join(leaders, ["a", "fan"]).select("a", "b", "text_a", "text_b").mapInArrow(_linked(k), "a long, b long")


def _alike(a: str, b: str) -> str:
    """SQL test of two sketched rows: sizes allow 0.8, and the bits don't speak against it."""
    word = lambda w: " | ".join(f"({a}.planes[{3 * p + w}] ^ {b}.planes[{3 * p + w}])" for p in range(PLANES))
    return (
        f"100 * least({a}.n_shingles, {b}.n_shingles) >= 80 * greatest({a}.n_shingles, {b}.n_shingles)"
        f" AND {' + '.join(f'bit_count({word(w)})' for w in range(3))} <= {MOST_DIFFER}"
    )


def _likely_by_leaders(members: DataFrame, sketched: DataFrame) -> DataFrame:
    """(a, b): in each bucket the member with the most bucket mates, a, against every other, b, where
    the sketches allow a link. The order by mates is one for all buckets, so no pair comes both ways."""
    placed = members.select(F.explode("buckets").alias("bucket"), "id", "degree")
    leaders = placed.groupBy("bucket").agg(F.max(F.struct("degree", "id"))["id"].alias("leader"))
    stars = placed.join(leaders, "bucket").filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    x, y = sketched.alias("x"), sketched.alias("y")
    return (
        stars.join(y, F.col("b") == F.col("y.id")).join(x, F.col("a") == F.col("x.id"))
        .filter(_alike("x", "y")).select("a", "b")
    )


def _likely_by_blocks(opened: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different parts of one bucket where the sketches allow a link.

    A bucket is dealt into blocks by a hash of its members; each pair of blocks is one join key, so
    that the pairs of a bucket of any size are compared in many tasks. The short sketch comes first, then
    the wide one; a pair that shares several buckets is looked at in the least of them only."""
    kept = ("id", "part", "n_shingles", "planes", "wide", F.col("open.bucket").alias("buckets"))
    spread = opened.select(*kept, F.explode("open").alias("o")).select(
        *kept[:-1], "buckets", "o.bucket", "o.blocks", F.pmod(F.xxhash64("id", "o.bucket"), F.col("o.blocks")).alias("own")
    )
    last = F.col("blocks") - 1
    x = spread.withColumns({"i": F.col("own"), "j": F.explode(F.sequence("own", last))}).alias("x")
    y = spread.withColumns({"j": F.col("own"), "i": F.explode(F.sequence(F.lit(0).cast("long"), "own"))}).alias("y")
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    half = WIDE // 64
    places = f"sequence(0, {half - 1})"
    differ = f"aggregate({places}, 0, (n, w) -> n + bit_count((x.wide[w] ^ y.wide[w]) | (x.wide[w + {half}] ^ y.wide[w + {half}])))"
    apart = "(x.i < x.j OR x.id < y.id) AND x.part <> y.part"
    once = "x.bucket = array_min(array_intersect(x.buckets, y.buckets))"
    met = x.join(y, same & F.expr(f"{apart} AND {_alike('x', 'y')} AND {once} AND {differ} <= {MOST_WIDE}"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicate_groups(docs: DataFrame, k: int = 4) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per row: doc_id, key, n_shingles, component (null without shingles).

    Shingles have k words. Rows with equal shingle sets are one class, named by the least key of its
    rows, so exact copies never meet again. In each bucket the member with the most bucket mates is
    tested against the others. Components of those links are formed, and then every pair of a bucket
    that is still in two components is tested, which leaves out only pairs that are already connected:
    no component is lost by it.

    Null or white-space texts have no shingle and link with nothing. Rows of one doc_id count as
    one document, so their classes are linked. A row without doc_id takes part, as a node above NO_ID.
    Repeated rows and an empty table need no special case; texts of any length go through whole.
    Other columns are left out.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.select("doc_id", "text", row_key().alias("key"))
    sketched = shelf.put("sketched", docs.mapInArrow(_sketch(k), _SKETCHED))
    node = F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.shiftrightunsigned(F.min("key"), 2))
    classes = shelf.put(
        "classes",
        sketched.filter("n_shingles > 0").groupBy("set1", "set2")
        .agg(node.alias("node"), F.min("key").alias("id"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "planes"))),
    )
    rows = shelf.put("rows", sketched.select("doc_id", "key", "n_shingles", "set1", "set2"))
    shelf.drop("sketched")
    entries = classes.select("id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("mates")).filter("mates > 1")
    members = shelf.put(
        "members", entries.join(shared, "bucket").groupBy("id").agg(F.sum("mates").alias("degree"), F.collect_list("bucket").alias("buckets"))
    )
    likely = shelf.put("likely", _likely_by_leaders(members, classes.select("id", "n_shingles", "planes")))

    # Rows of one doc_id with different sets: their classes are one document.
    many = rows.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(
        F.min(F.struct("set1", "set2")).alias("lo"), F.max(F.struct("set1", "set2")).alias("hi")
    ).filter("lo <> hi").select("doc_id")
    owned = rows.join(many, "doc_id").join(classes.select("set1", "set2", "id"), ["set1", "set2"]).select("doc_id", "id")
    joined = owned.join(owned.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    links = shelf.put("links", _confirm(likely, docs, k, shelf).union(joined))
    first = connected_components(links, shelf)
    root_of = lambda c: first.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))

    # Then whatever pairs of a bucket are still apart.
    placed = members.join(root_of("id"), "id", "left").select("id", F.coalesce("root_id", "id").alias("part"), F.explode("buckets").alias("bucket"))
    still = (
        placed.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n"))
        .filter("lo < hi").select("bucket", F.ceil(F.col("n") / IN_BLOCK).alias("blocks"))
    )
    opened = placed.join(still, "bucket").groupBy("id", "part").agg(F.collect_list(F.struct("bucket", "blocks")).alias("open"))
    opened = shelf.put("opened", opened.join(classes.select("id", "n_shingles", "planes"), "id"))
    wide = opened.select("id").join(_texts(docs), "id").mapInArrow(_wide(k), "id long, wide array<long>")
    opened = shelf.put("opened", opened.join(wide, "id"))
    tested = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = shelf.put("rest", _likely_by_blocks(opened).join(tested, ["a", "b"], "left_anti"))
    shelf.drop("members", "opened", "likely", "links")
    second = _confirm(rest, docs, k, shelf)
    between = second.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
    )
    merged = connected_components(between, shelf).select(F.col("node").alias("part"), F.col("root").alias("top"))

    tops = (
        classes.select("set1", "set2", "node", "id").join(root_of("id"), "id", "left")
        .select("set1", "set2", "node", F.coalesce("root_id", "id").alias("part")).join(merged, "part", "left")
        .select("set1", "set2", "node", F.coalesce("top", "part").alias("top"))
    )
    least = tops.groupBy("top").agg(F.min("node").alias("component"))
    components = shelf.put("components", tops.join(least, "top").select("set1", "set2", "component"))
    shelf.drop(*(name for name in list(shelf.paths) if name not in ("rows", "components")))
    return rows.join(components, ["set1", "set2"], "left").drop("set1", "set2")


def near_duplicates(docs: DataFrame, k: int = 4) -> DataFrame:
    """near_duplicate_groups as doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.

    A row without doc_id is kept only if it reaches no id, and its component_id is null then.
    """
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.when(F.col("component") < NO_ID, F.col("component"))
    )
    return near_duplicate_groups(docs, k).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs with one row of each group left, that with the smallest doc_id, and every row without words.

    Groups are those of near_duplicate_groups. Of repeated rows, or rows of one group that all have
    no doc_id, one stays. All columns stay; `__chosen` and `__key` must not be among them. Rows are told apart
    by a 64-bit hash of id and text: of two unlike rows that shared one, one would go.
    """
    groups = near_duplicate_groups(docs, k).filter("component IS NOT NULL")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "key"))["key"]
    chosen = groups.groupBy("component").agg(first.alias("__chosen")).select("__chosen")
    keyed = docs.withColumn("__key", row_key())
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    one = keyed.filter(worded).join(chosen, F.col("__key") == F.col("__chosen"), "left_semi").dropDuplicates(["__key"])
    return one.drop("__key").unionByName(docs.filter(~worded))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """near_duplicates over all documents, on shingles of four words."""
    from trackloom.llm.common import read

    return near_duplicates(read(spark, sf_dir, "documents"))
