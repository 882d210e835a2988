"""Operator 2: document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its own and its neighbours' surface features give the state scores, and
the chain carries them along. Forward-backward marginals, weighted by line length, make a document's
badness, which a logistic curve turns into the score. Labels are per document: lines of good
documents are taught as good, those of bad ones as bad until the field itself finds some to be good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import id_fold

#: The fit sees at most so many labelled documents of a quality, and so many lines of one of them.
SAMPLE_DOCS, SAMPLE_LINES = 1500, 300
BLOCK = 4 << 20

_LETTER, _UPPER, _DIGIT, _SYMBOL, _STOP, _SHOUT, _PIPE, _SPACE, _OTHER = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[128:] = _LETTER
for _chars, _kind in (
    (b"abcdefghijklmnopqrstuvwxyz", _LETTER),
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
    (b"0123456789", _DIGIT),
    (b"#*$%&<>@^~_=+{}[]\\/`", _SYMBOL),
    (b".,;:?'\"()-", _STOP),
    (b"!", _SHOUT),
    (b"|", _PIPE),
    (b" \t\r\x0b\x0c", _SPACE),
):
    _CLASS[list(_chars)] = _kind

OWN = 16  # features of a line itself, the first being constant
_NEAR = slice(1, 12)  # those that are also read off the line before and the line after


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their lengths in bytes, number of lines of each text); every text has a line."""
    buffer = b"\n".join(texts) + b"\n"
    data = np.frombuffer(buffer, np.uint8)
    kind = _CLASS[data]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(np.float64)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(np.float64)

    n = {k: count(kind == k) for k in range(_SPACE + 1)}
    blank = (kind == _SPACE) | (data == 10)
    words = count(~blank & np.concatenate([[True], blank[:-1]]))
    solid, some = np.maximum(length - n[_SPACE], 1), np.maximum(words, 1)
    lines_of = np.array([t.count(b"\n") + 1 for t in texts])
    again, distinct, place = np.zeros(len(ends)), np.ones(len(ends)), 0
    for text in texts:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line.strip():
                again[place] = line in seen
                seen.add(line)
                own = line.split()
                distinct[place] = len(set(own)) / len(own)
            place += 1
    last = data[np.maximum(ends - 1, starts)]
    x = np.stack(
        [
            np.ones(len(ends)),
            n[_UPPER] / np.maximum(n[_UPPER] + n[_LETTER], 1),
            n[_DIGIT] / solid,
            n[_SYMBOL] / solid,
            n[_SHOUT] / solid,
            np.minimum(n[_PIPE] / some, 1),
            np.minimum(n[_SYMBOL] / some, 3),
            np.minimum(n[_SHOUT] / some, 3),
            np.minimum(n[_STOP] / some, 2),
            again,
            1 - distinct,
            words == 0,
            np.minimum(solid / some, 30) / 10,
            np.log1p(words) / 5,
            np.isin(last, np.frombuffer(b".!?\"'", np.uint8)) & (length > 0),
            n[_DIGIT] > 0,
        ],
        axis=1,
    ).astype(np.float32)
    return x, length, lines_of


def with_neighbours(x: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """The features with those of the line before and the line after, zero beyond a text's ends."""
    first = np.zeros(len(x), bool)
    first[np.concatenate([[0], np.cumsum(lines_of)[:-1]])] = True
    before, after = np.zeros_like(x[:, _NEAR]), np.zeros_like(x[:, _NEAR])
    before[1:] = x[:-1, _NEAR]
    before[first] = 0
    after[:-1] = x[1:, _NEAR]
    after[:-1][first[1:]] = 0
    return np.concatenate([x, before, after], axis=1)


@dataclass
class Field:
    """Weights of the state `bad`, transition scores [from][to], and the curve from badness to score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = -8.0
    offset: float = 4.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def _pad(values: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lines_of), int(lines_of.max(initial=1))))
    out[np.arange(out.shape[1]) < lines_of[:, None]] = values
    return out


def messages(e: np.ndarray, lines_of: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with emissions) and backward log-odds of `bad`, for rows of padded emissions."""
    forward, backward = np.empty_like(e), np.zeros_like(e)
    forward[:, 0] = e[:, 0]
    for t in range(1, e.shape[1]):
        a = forward[:, t - 1]
        forward[:, t] = e[:, t] + np.logaddexp(moves[0, 1], moves[1, 1] + a) - np.logaddexp(moves[0, 0], moves[1, 0] + a)
    for t in range(e.shape[1] - 2, -1, -1):
        c = e[:, t + 1] + backward[:, t + 1]
        back = np.logaddexp(moves[1, 0], moves[1, 1] + c) - np.logaddexp(moves[0, 0], moves[0, 1] + c)
        backward[:, t] = np.where(t + 1 < lines_of, back, 0)
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def badness(field: Field, x: np.ndarray, length: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each text. Texts go in groups of like length, so that
    padding stays below the lines there are, whatever the longest text."""
    e, ends = field.emissions(with_neighbours(x, lines_of)), np.cumsum(lines_of)
    weight, out = length + 1, np.empty(len(lines_of))
    groups = np.floor(np.log2(lines_of)).astype(int)
    for group in np.unique(groups):
        rows = np.flatnonzero(groups == group)
        own = lines_of[rows]
        take = np.concatenate([np.arange(ends[r] - lines_of[r], ends[r]) for r in rows])
        forward, backward = messages(_pad(e[take], own), own, field.moves)
        w = _pad(weight[take], own)
        out[rows] = (w * _sigmoid(forward + backward)).sum(1) / w.sum(1)
    return out


def score(field: Field, bad: np.ndarray) -> np.ndarray:
    return _sigmoid(field.slope * bad + field.offset)


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], share: tuple[float, float], rounds: int = 3, steps: int = 60) -> Field:
    """docs: (features, lengths, quality) of each; share: how the two qualities weigh in the curve."""
    docs = sorted(docs, key=lambda d: (len(d[0]), d[2], float(d[0].sum())))
    x, lines_of = np.concatenate([d[0] for d in docs]), np.array([len(d[0]) for d in docs])
    length, quality = np.concatenate([d[1] for d in docs]), np.array([d[2] for d in docs])
    wide = with_neighbours(x, lines_of)
    field = Field(wide.mean(0), wide.std(0) + 1e-2, np.zeros(wide.shape[1]), np.zeros((2, 2)))
    field.mean[0], field.scale[0] = 0, 1
    z = (wide - field.mean) / field.scale
    owner = np.repeat(np.arange(len(docs)), lines_of)
    y = (quality[owner] == 0).astype(float)
    each = np.where(quality == 1, 1 / max(1, (quality == 1).sum()), 1 / max(1, (quality == 0).sum()))
    each = each[owner] * len(docs) / 2 / lines_of[owner]  # a document weighs the same however long
    inner = np.arange(1, len(y))[owner[1:] == owner[:-1]]
    groups = [g for g in np.array_split(np.arange(len(docs)), 24) if len(g)]  # sorted by length
    take = [np.flatnonzero((owner >= g[0]) & (owner <= g[-1])) for g in groups]
    for _ in range(rounds):
        first, second = np.zeros(len(field.weights) + 4), np.zeros(len(field.weights) + 4)
        for step in range(1, steps + 1):
            e = z @ field.weights
            forward, cont = np.empty(len(e)), np.empty(len(e))
            for g, rows in zip(groups, take):
                own = lines_of[g]
                f, b = messages(_pad(e[rows], own), own, field.moves)
                real = np.arange(f.shape[1]) < own[:, None]
                forward[rows], cont[rows] = f[real], b[real]
            p = _sigmoid(forward + cont)
            slope = z.T @ (each * (p - y)) / len(docs) + 1e-3 * field.weights
            a, c = forward[inner - 1], e[inner] + cont[inner]
            logs = np.stack([np.full(len(a), field.moves[0, 0]), field.moves[0, 1] + c, field.moves[1, 0] + a, field.moves[1, 1] + a + c])
            q = np.exp(logs - logs.max(0, initial=-np.inf)) if len(a) else logs
            q = q / q.sum(0)
            at = (2 * y[inner - 1] + y[inner]).astype(int)
            moved = np.array([(each[inner] * (q[k] - (at == k))).sum() for k in range(4)]) / len(docs)
            gradient = np.concatenate([slope, moved + 1e-3 * field.moves.reshape(-1)])
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            change = 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            field.weights -= change[:-4]
            field.moves -= change[-4:].reshape(2, 2)
        # Lines of bad documents that look good are good, but for the worst of each document.
        y = np.where(quality[owner] == 0, p >= 0.5, 0).astype(float)
        worst = np.zeros(len(docs))
        np.maximum.at(worst, owner, p)
        y[(quality[owner] == 0) & (p >= worst[owner])] = 1
    bad = np.concatenate([badness(field, x[owner == i], length[owner == i], lines_of[i : i + 1]) for i in range(len(docs))])
    weight = np.where(quality == 1, share[1] / max(1, (quality == 1).sum()), share[0] / max(1, (quality == 0).sum()))
    curve = np.array([-4.0, 2.0])
    design = np.stack([bad, np.ones(len(bad))], 1)
    for _ in range(50):  # Newton, with a ridge that keeps separable samples finite
        p = _sigmoid(design @ curve)
        g = design.T @ (weight * (p - quality)) + 1e-4 * curve
        h = (design.T * (weight * p * (1 - p))) @ design + 1e-4 * np.eye(2)
        curve = curve - np.clip(np.linalg.solve(h, g), -2, 2)
    field.slope, field.offset = curve
    return field


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        found = []
        for row in rows:
            x, length, _ = line_features([(row["text"] or "").encode("utf-8", "surrogatepass")])
            start = row["pick"] % max(1, len(x) - SAMPLE_LINES + 1)
            found.append((x[start : start + SAMPLE_LINES], length[start : start + SAMPLE_LINES]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["quality"] for r in rows], pa.int32()),
                pa.array([f[0].tobytes() for f in found], pa.binary()),
                pa.array([f[1].tobytes() for f in found], pa.binary()),
            ],
            ["quality", "features", "lengths"],
        )


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits the field on at most SAMPLE_DOCS labelled documents of each quality, picked by a hash
    of the id. Rows with null id, quality or text teach nothing; an id with two qualities counts
    as its lower one. Without labelled rows of both kinds all texts score the known share."""
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(id_fold(3) != 1)
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    )
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("pick")
    # Ids are thinned by their hash to about twice the bound before they are sorted.
    most = {q: int(min(1.0, (2 * SAMPLE_DOCS + 100) / max(1, counts.get(q, 0))) * (1 << 30)) for q in (0, 1)}
    part = [
        known.filter(F.col("quality") == q).select("doc_id", "quality", pick).filter(F.col("pick") < most[q])
        .orderBy("pick", "doc_id").limit(SAMPLE_DOCS)
        for q in (0, 1)
    ]
    picked = F.broadcast(part[0].union(part[1]))  # 2 * SAMPLE_DOCS rows at most
    rows = (
        docs.select(F.col("doc_id"), "text").filter("text IS NOT NULL").join(picked, "doc_id")
        .dropDuplicates(["doc_id"])
        .select("text", "quality", "pick")
        .mapInArrow(_sample_features, "quality int, features binary, lengths binary").toPandas()
    )
    sample = [
        (np.frombuffer(r.features, np.float32).reshape(-1, OWN), np.frombuffer(r.lengths, np.float64), int(r.quality))
        for r in rows.itertuples()
    ]
    total = max(1, sum(counts.values()))
    if len({s[2] for s in sample}) < 2:
        wide = OWN + 2 * (_NEAR.stop - _NEAR.start)
        certain = 0.0 if not sample else 9.0 * (1 if sample[0][2] else -1)
        return Field(np.zeros(wide), np.ones(wide), np.zeros(wide), np.zeros((2, 2)), 0.0, certain)
    return fit(sample, (counts.get(0, 0) / total, counts.get(1, 0) / total))


def scores_of(field: Field, texts: pa.Array) -> pa.Array:
    """The score of every text of an Arrow column, BLOCK bytes at a time."""
    found, block, size = [], [], 0
    for i in range(len(texts)):
        block.append((texts[i].as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(block[-1])
        if size >= BLOCK or i == len(texts) - 1:
            found.append(score(field, badness(field, *line_features(block))))
            block, size = [], 0
    return pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, score, predicted, one row per row.

    Null text scores as an empty one, which is a single empty line. Repeated rows score alike.
    Other columns of docs are never read.
    """
    field = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores_of(field, batch.column("text"))], ["doc_id", "score"])

    return (
        docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns, and without a shuffle."""
    field = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater_equal(scores_of(field, batch.column("text")), 0.5))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_crf(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    from trackloom.llm.common import read

    docs = read(spark, sf_dir, "documents")
    scores = quality_scores(docs, read(spark, sf_dir, "labels"))
    return scores.select("doc_id", (id_fold(3) == 1).alias("held_out"), "score", "predicted")
