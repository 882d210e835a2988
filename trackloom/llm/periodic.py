"""Operator 12: runs of words that repeat with a period, and texts without their repeats.

For every period p, pairs of words p apart are compared at points of a grid, about n/p of them a period and so
a harmonic sum in all. Prefix hashes of the word codes, as numpy arrays, tell how far each pair agrees to the
left and to the right: one binary search moves all (period, grid point) pairs of many texts at once. What is
long enough is verified word by word, and of stretches found by several periods the smallest period stays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the texts that are searched together (a longer text is searched alone), and pairs that are compared
#: together; both bound memory and change no result.
BATCH_WORDS, BATCH_PAIRS = 1 << 18, 1 << 20
#: Words a task remembers at most; they are then forgotten, which changes no result.
MEMO = 1 << 20
_MODULUS = np.int64((1 << 31) - 1)
_BASES = (np.int64(1_000_003), np.int64(998_244_353 % ((1 << 31) - 1)))


class Prefixes:
    """Hashes of all prefixes of a sequence of codes, by two bases: equal stretches have equal hashes."""

    def __init__(self, codes: np.ndarray):
        self.hashes, self.powers = [], []
        for base in _BASES:
            self.hashes.append(_scanned((codes.astype(np.int64) * 7919 + 12345) % _MODULUS, base))
            self.powers.append(_powers(base, len(codes) + 1))

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the stretches of n codes at i and at j have one hash."""
        out = np.ones(len(i), bool)
        for h, p in zip(self.hashes, self.powers):
            left = (h[i + n] - h[i] * p[n]) % _MODULUS
            out &= left == (h[j + n] - h[j] * p[n]) % _MODULUS
        return out


def _powers(base: np.int64, n: int) -> np.ndarray:
    """1, base, base^2, ... by doubling."""
    out = np.ones(n, np.int64)
    done, step = 1, base
    while done < n:
        some = min(done, n - done)
        out[done : done + some] = out[:some] * step % _MODULUS
        done, step = done + some, step * step % _MODULUS
    return out


def _scanned(values: np.ndarray, base: np.int64) -> np.ndarray:
    """h[0] = 0, h[k + 1] = h[k] * base + values[k], by doubling strides."""
    h, step, stride = values.copy(), base, 1
    while stride < len(h):
        h[stride:] = (h[stride:] + h[:-stride] * step) % _MODULUS
        step, stride = step * step % _MODULUS, stride * 2
    return np.concatenate([np.zeros(1, np.int64), h])


def _furthest(most: np.ndarray, agree) -> np.ndarray:
    """For each row the largest m <= most for which agree(rows, m) holds; it holds for 0 and, if for m, for all below."""
    low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
    while len(rows := np.flatnonzero(low < high)):
        middle = (low[rows] + high[rows] + 1) // 2
        yes = agree(rows, middle)
        low[rows[yes]] = middle[yes]
        high[rows[~yes]] = middle[~yes] - 1
    return low


def _grid(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, period, point) of every pair to compare, in pieces of about BATCH_PAIRS.

    In a run of L words with period p, L - p >= max(LEAST_WORDS - p, 2p) words equal the one p further, so a
    grid of that spacing has a point among them.
    """
    most = lengths // LEAST_PERIODS
    text = np.repeat(np.arange(len(lengths)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    spacing = np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)
    points = (lengths[text] - 1 - period) // spacing + 1
    total = np.cumsum(points)
    at = 0
    while at < len(text):
        # A single row has no more points than its text has words.
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_PAIRS, "right")))
        n = points[at:end]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        t, p = np.repeat(text[at:end], n), np.repeat(period[at:end], n)
        yield t, p, starts[t] + k * np.repeat(spacing[at:end], n)
        at = end


def find_runs(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of the texts that lie one after the other in codes: rows (text, start, length, period), sorted."""
    found = [np.zeros((0, 5), np.int64)]
    prefixes = Prefixes(codes) if len(codes) else None
    for text, period, point in _grid(starts, lengths):
        same = codes[point] == codes[point + period]
        text, period, point = text[same], period[same], point[same]
        first, last = starts[text], starts[text] + lengths[text]
        right = _furthest(last - point - period, lambda r, m: prefixes.equal(point[r], point[r] + period[r], m))
        # What is too short even with all the words to the left needs no look at them.
        some = right + point - first >= np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)
        text, period, point, first, right = text[some], period[some], point[some], first[some], right[some]
        left = _furthest(point - first, lambda r, m: prefixes.equal(point[r] - m, point[r] + period[r] - m, m))
        long = left + right + period >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        rows = np.stack([text, point - left, left + right + period, period, point], 1)[long]
        found.append(_first_of(rows, 4))  # several points of one run tell the same
    runs = _verified(codes, _first_of(np.concatenate(found), 4))
    runs[:, 1] -= starts[runs[:, 0]]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _first_of(rows: np.ndarray, columns: int) -> np.ndarray:
    """The rows sorted, and of those that agree in the first so many columns the first."""
    rows = np.unique(rows, axis=0)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :columns] != rows[:-1, :columns]).any(1)
    return rows[new]


def _verified(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sorted rows (text, start, length, period, point) with the words compared, one a stretch: its smallest period.

    Hashes may find too much, never too little. Where the words of a stretch's smallest period aren't alike, its
    end is moved to the first unlike ones on either side of the point, and the next period is tried."""
    out = [np.zeros((0, 4), np.int64)]
    while len(rows):
        head = np.ones(len(rows), bool)
        head[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
        stretch, failed = np.cumsum(head) - 1, np.zeros(int(head.sum()), bool)
        kept = []
        for i, (text, start, length, period, point) in enumerate(rows[head].tolist()):
            unlike = np.flatnonzero(codes[start : start + length - period] != codes[start + period : start + length]) + start
            if len(unlike):
                failed[i] = True
                k = int(np.searchsorted(unlike, point))
                end = (int(unlike[k]) if k < len(unlike) else start + length - period) + period
                start = int(unlike[k - 1]) + 1 if k else start
                length = end - start
                if length < max(LEAST_WORDS, LEAST_PERIODS * period):
                    continue
            kept.append((text, start, length, period))
        out.append(np.array(kept, np.int64).reshape(-1, 4))
        rows = rows[~head & failed[stretch]]
    return _first_of(np.concatenate(out), 3)


def repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words any run of (start, length, period) contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


@dataclass
class Coder:
    """Codes of words, the same for equal words until they are forgotten between batches."""

    def __post_init__(self):
        self.forget()

    def forget(self) -> None:
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # at exactly the six ASCII white-space bytes


def _batches(batches: Iterator[pa.RecordBatch], prepare) -> Iterator[list[tuple]]:
    """Rows as (doc_id, words), as many together as hold BATCH_WORDS words."""
    some, n = [], 0
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for i in range(batch.num_rows):
            doc_id = ids[i].as_py()
            words = prepare(doc_id, _words(texts[i].as_py()))
            some.append((doc_id, words))
            n += len(words)
            if n >= BATCH_WORDS or len(some) >= 4096:
                yield some
                some, n = [], 0
    if some:
        yield some


def periodic_runs(docs: DataFrame, prepare=None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, runs (array of start, length, period by start, then period),
    collapsed (the words without a run's repeats, joined by one space). One row per row.

    A run is a stretch of words with smallest period q, LEAST_WORDS and LEAST_PERIODS * q words long at least,
    that a word more on either side would break. Null and empty texts have no words, no runs and an empty
    `collapsed`; repeated rows get the same result; texts of any length are searched whole, and their task holds a
    constant times the longest one; an empty table gives none. Columns other than these two are never read.
    prepare(doc_id, words) -> words may change a text's words first.
    """
    prepare = prepare or (lambda doc_id, words: words)
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for rows in _batches(batches, prepare):
            if len(coder.codes) > MEMO:
                coder.forget()
            lengths = np.array([len(words) for _, words in rows], np.int64)
            starts = np.cumsum(lengths) - lengths
            codes = coder([w for _, words in rows for w in words])
            found = find_runs(codes, starts, lengths)
            cuts = np.searchsorted(found[:, 0], np.arange(len(rows) + 1))
            collapsed = []
            for i, (_, words) in enumerate(rows):
                if cuts[i] < cuts[i + 1]:
                    gone = repeats(len(words), found[cuts[i] : cuts[i + 1], 1:])
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            flat = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in rows], pa.int64()),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat).cast(kind),
                    pa.array(collapsed, pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting of every tenth text: from word a on, the p words at a over and over."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def summary(found: DataFrame) -> DataFrame:
    """periodic_runs' rows -> doc_id, n_runs, the run with most periods (exactly; of equals the first, then that of
    the smallest period) with its exponent in thousandths, and digests of all runs and of the collapsed text."""
    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, _, runs, collapsed in zip(*(c.to_pylist() for c in batch.columns)):
                listed = [(r["start"], r["length"], r["period"]) for r in runs]
                best = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
                milli = 1000 * best[1] // best[2] if listed else None
                text = "".join(f"{s},{n},{p}\n" for s, n, p in listed)
                digests = (hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in (text, collapsed))
                rows.append((doc_id, len(listed), *best, milli, *digests))
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return found.mapInArrow(run, schema)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of the runs of all documents, every tenth of them rewritten."""
    from trackloom.llm.common import read

    return summary(periodic_runs(read(spark, sf_dir, "documents"), planted))
