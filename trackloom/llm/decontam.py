"""Operator 9: benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of the canonical tokens are hash-joined
to the benchmark's, windows on one diagonal form a passage, and what the placeholders stood for must
map one to one, so that a question that was given new parameters is found and a chance meeting of
templates is not. Every window is joined by its lower-cased words as well, whatever they are, so that
a copy word for word is found however many numbers and names it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import row_key
from trackloom.llm.near_dedup import mix

#: Tokens in a window, and the fewest of them that must be ordinary words where placeholders may differ.
WINDOW, LEAST_LITERAL = 8, 5
#: An item without such a window (full of numbers, say) has longer ones, or itself as a whole, of this many ordinary words.
WIDE, LEAST_DENSE = 16, 3
#: The membership filter has this many bits whatever the benchmark's size: 2 MB to broadcast.
FILTER_BITS = 1 << 24
#: Bytes of text that a task reads at once, and rows that it gives at once.
BLOCK, AT_ONCE = 1 << 20, 50_000
#: Longer words, in bytes, are hashed one by one.
LONG = 64
#: A passage whose text differs in its slots needs this many windows on its diagonal.
LEAST_CHANGED = 3

# Units that are read as such after a number.
UNITS = frozenset(
    b"mm cm m km in ft yd mi g kg mg lb oz t l ml s sec min h hr hrs hours hour minutes minute seconds second"
    b" days day weeks week months month years year percent % dollars dollar euros euro cents cent usd eur gbp"
    b" mph kph degrees degree c f k w kw v hz mb gb tb meters metres kilometers kilometres miles grams pounds".split()
)
_EDGE = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh3_64_intdigest(b"\0" + x)) for x in (b"number", b"name", b"unit"))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: What a byte is, in bits: white space, stripped from words, none of a number's, A-Z, a-z, beyond ASCII, ends a sentence, may close it.
_SPACE, _STRIPPED, _OTHER, _UPPER, _LOWER, _BEYOND, _STOP, _CLOSER = (1 << k for k in range(8))
_KINDS = np.array(
    [
        _SPACE * (b in b" \t\n\r\v\f") | _STRIPPED * (b in _EDGE) | _OTHER * (b not in b"0123456789.,:/") | _UPPER * (65 <= b <= 90)
        | _LOWER * (97 <= b <= 122) | _BEYOND * (b > 127) | _STOP * (b in b".!?") | _CLOSER * (b in b"\"')]")
        for b in range(256)
    ],
    np.uint8,
)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 1 << 64))


def _hashes(low: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words that stand lower-cased in `low`, 8 bytes a step; `low` has 8 bytes more than its words."""
    size = ends - starts
    eights = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
    step = lambda h, at, left: mix(h ^ (eights[at] & _FIRST_BYTES[np.minimum(left, 8)]))
    out, more = step(size.astype(np.uint64) * _BASE, starts, size), np.flatnonzero(size > 8)
    for k in range(8, LONG, 8):
        if not len(more):
            break
        out[more] = step(out[more], starts[more] + k, size[more] - k)
        more = more[size[more] > k + 8]
    for i in more.tolist():
        out[i] = xxhash.xxh3_64_intdigest(low[starts[i] : ends[i]])
    return out


def _hash_all(low: bytes) -> np.ndarray:
    """Hashes of lower-cased words that a line feed each ends."""
    ends = np.flatnonzero(np.frombuffer(low, np.uint8) == 10)
    return _hashes(low + b"\0" * 8, np.concatenate([[0], ends[:-1] + 1]), ends)


_UNIT_HASHES = _hash_all(b"".join(u + b"\n" for u in sorted(UNITS)))


def _roll(code: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all runs of `width` codes, by doubling; the width counts too."""
    h, have = code, 1
    for bit in bin(width)[3:]:
        h, have = h[:-have] * _power(have) + h[have:], 2 * have
        if bit == "1":
            h, have = h[:-1] * _BASE + code[have:], have + 1
    return h + np.uint64(width) * _power(width)


class Canonical:
    """Canonical tokens of texts (UTF-8), those of one after those of the other: `text` (its place in the list), `own` (hash
    of the lower-cased word), `code` (hash or placeholder), `slot` (what a placeholder stands for, else 0). `first` tells where
    each text's tokens begin, `opens` has the first tokens that may be a name; they aren't taken as one. Words are read all at
    once, as arrays over their bytes, as a corpus has too many distinct ones for a memory of them to help."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        block = b"".join([b"\n", *(part for t in texts for part in (t, b"\n")), b"\0" * 8])
        kinds = _KINDS[np.frombuffer(block, np.uint8)[:-8]]
        solid = (kinds & (_SPACE | _STRIPPED)) == 0
        turns = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        starts, ends = turns[::2], turns[1::2]
        if len(starts):
            # Stripped bytes inside a word part it in runs; those with no white space between them are one.
            last = np.flatnonzero(np.bitwise_or.reduceat(kinds, ends) & _SPACE)
            starts, ends = starts[np.concatenate([[0], last[:-1] + 1])], ends[last]
            rest = np.bitwise_or.reduceat(kinds, np.stack([starts + 1, ends], 1).ravel())[::2]
            rest[ends - starts == 1] = 0
        else:
            rest = np.empty(0, np.uint8)
        begin = kinds[starts]
        number = ((begin | rest) & _OTHER) == 0  # a word begins with a digit if it does with a number's character
        name = ((begin & _UPPER) > 0) & ((rest & (_UPPER | _LOWER)) == _LOWER)
        self.own = _hashes(block.lower(), starts, ends)
        beyond = np.flatnonzero((begin | rest) & _BEYOND)
        if len(beyond):
            words = [block[s:e] for s, e in zip(starts[beyond].tolist(), ends[beyond].tolist())]
            read = (b"\n".join(words) + b"\n").decode("utf-8", "replace")
            self.own[beyond] = _hash_all(read.lower().encode())
            name[beyond] = [w[0].isupper() and w[1:].islower() for w in read.split("\n")[:-1]]

        cuts = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        self.first, self.text = cuts[:-1], np.repeat(np.arange(len(texts)), np.diff(cuts))
        heads = self.first[np.diff(cuts) > 0]
        after = lambda mask: np.concatenate([[False], mask[:-1]]) if len(mask) else mask
        self.opens = heads[name[heads]]
        name &= ~after(self._stops(kinds, ends))
        name[heads] = False
        unit = after(number)
        unit[heads] = False
        unit[unit] = np.isin(self.own[unit], _UNIT_HASHES)
        unit &= ~number
        self.code, self.slot = self.own.copy(), np.where(number | unit | name, self.own, np.uint64(0))
        for which, mark in ((name, _NAME), (unit, _UNIT), (number, _NUM)):
            self.code[which] = mark

    @staticmethod
    def _stops(kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """True for the words that end a sentence: what was stripped from their end ends so, but for what may close it."""
        out = (kinds[ends] & _SPACE) == 0
        spaces = np.flatnonzero(kinds & _SPACE)
        marks = np.concatenate([[0], np.flatnonzero((kinds & (_STRIPPED | _CLOSER)) == _STRIPPED)])  # 0: before any word
        tail = ends[out]
        found = marks[np.searchsorted(marks, spaces[np.searchsorted(spaces, tail)]) - 1]
        out[out] = (found >= tail) & ((kinds[found] & _STOP) > 0)
        return out

    def windows(self, width: int, dense: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, bool, np.ndarray, bool]]:
        """Starts, hashes, plain, template, opening of windows, kind by kind. A plain window is hashed by its words, each
        start has one up to WINDOW; another by its placeholders, if it has any and enough ordinary words, and an opening one
        with its text's first token as a name. A template is a window with enough of them; `dense` asks for LEAST_DENSE
        whatever the width."""
        n = len(self.code) - width + 1
        if width < 1 or n < 1:
            return
        within = self.text[width - 1 :] == self.text[:n]
        filled = np.concatenate([[0], np.cumsum(self.slot != 0)])
        slots = filled[width:] - filled[:-width]
        literal = width - slots
        template = literal >= LEAST_LITERAL * width / WINDOW
        least = LEAST_DENSE if dense else LEAST_LITERAL * width / WINDOW
        if width <= WINDOW:
            at = np.flatnonzero(within)
            yield at, mix(_roll(self.own, width)[at]), True, template[at], False
        other = np.flatnonzero(within & (literal >= least) & (slots > 0))
        opens = self.opens[self.opens < n]
        opens = opens[within[opens] & (literal[opens] - 1 >= least)]
        if len(other) or len(opens):
            rolled = _roll(self.code, width)
            yield other, mix(rolled[other]), False, np.ones(len(other), bool), False
            named = rolled[opens] + (_NAME - self.code[opens]) * _power(width - 1)
            yield opens, mix(named), False, np.ones(len(opens), bool), True

    def shapes(self) -> list[tuple[int, bool]]:
        """A lone item's windows as widths, with true for those that ask for LEAST_DENSE."""
        width = min(WINDOW, len(self.code))
        if any(template.any() for _, _, plain, template, _ in self.windows(width) if plain):
            return [(width, False)]
        wide = min(WIDE, len(self.code))
        return [(width, True)] if wide == width else [(width, False), (wide, True)]


_WINDOWS = "key long, start int, window long, plain boolean, template boolean, slots array<long>"


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    """Keys and texts of a batch, about `size` bytes at a time; a longer text is read alone, whole."""
    keys, column = batch.column("key").to_numpy(zero_copy_only=False), batch.column("text").cast(pa.large_binary())
    lengths = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, "right")))
        yield keys[at:to], column.slice(at, to - at).to_pylist()
        at = to


def _windows(membership=None, shapes: tuple[tuple[int, bool], ...] = ()):
    """Rows of windows with their start and slots: of a document's windows of those shapes (width, dense) that are in the
    filter; without a filter of an item's, a shorter item being one window. A first token that may be a
    name is taken both ways."""

    def known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = hashes % np.uint64(FILTER_BITS)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def rows(keys: np.ndarray, tokens: Canonical, shape: tuple[int, bool], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        width = shape[0]
        for starts, hashes, plain, template, opening in tokens.windows(*shape):
            if bits is not None:
                hit = known(bits, hashes)
                starts, hashes, template = starts[hit], hashes[hit], template[hit]
            for k in range(0, len(starts), AT_ONCE):
                s, part = starts[k : k + AT_ONCE], slice(k, k + AT_ONCE)
                slots = tokens.slot[s[:, None] + np.arange(width)]
                if opening:
                    slots[:, 0] = tokens.own[s]
                text = tokens.text[s]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[text], pa.int64()), pa.array(s - tokens.first[text], pa.int32()), pa.array(hashes[part].view(np.int64)),
                        pa.array(np.full(len(s), plain)), pa.array(template[part]),
                        pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * width, slots.ravel().view(np.int64)),
                    ],
                    ["key", "start", "window", "plain", "template", "slots"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = membership and np.frombuffer(membership.value, np.uint8)
        for batch in batches:
            ready, n = [], 0
            for keys, texts in _blocks(batch, BLOCK if membership else 1):
                tokens = Canonical(texts)
                for shape in shapes if membership else tokens.shapes():
                    for part in rows(keys, tokens, shape, bits):
                        ready.append(part)
                        n += len(part)
                        if n >= AT_ONCE:
                            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                            ready, n = [], 0
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return run


def _filter(windows: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits over the benchmark's windows, built from the distinct bytes that
    are not zero: what comes to the driver is bounded by the bitmap, not by the benchmark."""
    at = F.pmod(F.col("window"), F.lit(FILTER_BITS))
    cells = windows.select(F.shiftright(at, 3).alias("cell"), (at % 8).cast("int").alias("bit"))
    filled = cells.groupBy("cell").agg(F.expr("bit_or(shiftleft(1, bit))").alias("byte")).toPandas()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[filled["cell"].to_numpy(np.int64)] = filled["byte"].to_numpy(np.int64).astype(np.uint8)
    return bits.tobytes()


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> one row per document and item found in it.

    Columns: key (of the row, common.row_key), doc_id, item_id, windows (that agree), first_token,
    last_token, changed_slots (placeholders with another value), verbatim. A passage is one window
    or more that agree with an item on one diagonal, in their words or in a template. If some placeholder differs, LEAST_CHANGED
    windows are needed (or all of the item's templates), and values must map one to one throughout; else the
    windows whose slots or words are equal count alone. An item in which no WINDOW tokens hold LEAST_LITERAL ordinary words has
    templates of WIDE tokens, or of all it has, with LEAST_DENSE of them; with fewer it is found word for word only. Null and empty texts give nothing, on either
    side; repeated rows of one id and text are found once. An item without an id is found too, with a
    null item_id, unless its text has an id in another row. Other columns are ignored.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    named_items = (
        benchmark.groupBy("text").agg(F.collect_set("item_id").alias("ids")).withColumn("item_id", F.explode_outer("ids"))
        .select("item_id", "text", row_key("item_id").alias("item"))
    )
    items = (
        named_items.select(F.col("item").alias("key"), "text")
        .mapInArrow(_windows(), _WINDOWS)
        .select(
            F.col("key").alias("item"), "window", F.col("start").alias("item_start"),
            F.col("template").alias("item_template"), F.col("slots").alias("item_slots"),
        )
        .distinct()
    ).persist()
    # At most WIDE widths, whatever the benchmark's size.
    width = F.size("item_slots")
    literal = width - F.size(F.filter("item_slots", lambda s: s != 0))
    dense = F.col("item_template") & (literal < LEAST_LITERAL * width / WINDOW)
    shapes = tuple(sorted((r["w"], r["dense"]) for r in items.groupBy(width.alias("w")).agg(F.max(dense).alias("dense")).collect()))
    counts = items.groupBy("item").agg(F.count_distinct(F.when(F.col("item_template"), F.col("item_start"))).alias("item_windows"))
    membership = spark.sparkContext.broadcast(_filter(items))
    hits = keyed.select("key", "text").mapInArrow(_windows(membership, shapes), _WINDOWS).distinct().join(items, "window").persist()
    hits = hits.withColumns(
        {"diagonal": F.col("start") - F.col("item_start"), "same": F.col("plain") | (F.col("slots") == F.col("item_slots"))}
    )
    # One to one: no value of the item has two values in the document, nor the other way round.
    slots = (
        hits.select("key", "item", "diagonal", F.explode(F.arrays_zip("slots", "item_slots")).alias("s"))
        .select("key", "item", "diagonal", F.col("s.slots").alias("there"), F.col("s.item_slots").alias("here"))
        .filter("there <> 0 AND here <> 0").distinct()
    )
    mapped = slots.groupBy("key", "item", "diagonal").agg(
        F.count("*").alias("pairs"),
        F.count_distinct("there").alias("there"),
        F.count_distinct("here").alias("here"),
        F.sum((F.col("there") != F.col("here")).cast("long")).alias("changed"),
    )
    runs = hits.groupBy("key", "item", "diagonal").agg(
        F.count_distinct("start").alias("windows"), F.count_distinct(F.when(F.col("same"), F.col("start"))).alias("equal"),
        F.min("start").alias("lo"), F.max(F.col("start") + F.size("slots") - 1).alias("hi"),
    )
    judged = (
        runs.join(mapped, ["key", "item", "diagonal"], "left").join(counts, "item")
        .withColumn("consistent", F.coalesce((F.col("pairs") == F.col("there")) & (F.col("pairs") == F.col("here")), F.lit(True)))
        .withColumn("changed", F.coalesce("changed", F.lit(0)))
        .filter(
            (F.col("equal") > 0)
            | F.col("consistent") & (F.col("windows") >= F.least(F.lit(LEAST_CHANGED), F.col("item_windows")))
        )
    )
    found = judged.groupBy("key", "item").agg(
        F.sum(F.when(F.col("consistent"), F.col("windows")).otherwise(F.col("equal"))).alias("windows"),
        F.min("lo").cast("long").alias("first_token"),
        F.max("hi").cast("long").alias("last_token"),
        F.sum(F.when(F.col("consistent"), F.col("changed")).otherwise(0)).alias("changed_slots"),
    )
    named = keyed.select("key", "doc_id").distinct()
    return (
        named.join(found, "key").join(named_items.select("item", "item_id"), "item").withColumn("verbatim", F.col("changed_slots") == 0)
        .select("key", "doc_id", "item_id", "windows", "first_token", "last_token", "changed_slots", "verbatim")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns, of which none may be `__bad` or `__key`.
    An empty table gives an empty one; texts of any length are searched whole; repeated rows stay or go together."""
    bad = contaminations(docs, benchmark).select(F.col("key").alias("__bad")).distinct()
    return docs.withColumn("__key", row_key()).join(bad, F.col("__key") == F.col("__bad"), "left_anti").drop("__key")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    from trackloom.llm.common import read

    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")
