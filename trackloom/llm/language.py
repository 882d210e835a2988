"""Operator 1: language identification by a byte convolutional network.

Filters of several widths run over one-hot bytes, max pooling keeps each filter's best answer in a
fixed-length window, and a softmax gives the window's language. The network is trained in numpy on
a bounded sample of windows; a text's prediction averages the log-probabilities of all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import id_fold

#: Bytes of a window, filter widths, and filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: The fit sees at most so many windows, one of each labelled document picked by hash.
SAMPLE = 8_000
#: Bytes of text that a task convolves at once.
BLOCK = 1 << 20


@dataclass
class Network:
    """`taps[w][j]` is a 256 x FILTERS table: what byte j of a width-w filter adds; `out` maps pooled answers to languages."""

    langs: list[str]
    taps: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _pairs(tap: np.ndarray) -> np.ndarray:
    """Of two neighbouring taps, what each of the 65,536 byte pairs adds."""
    return (tap[0][:, None, :] + tap[1][None, :, :]).reshape(65536, -1)


def fast_tables(net: Network) -> list[list[np.ndarray]]:
    """The taps of each width in steps of two bytes where that goes; a filter's answer is a sum of few look-ups."""
    return [[_pairs(t[j : j + 2]) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in net.taps]


def answers(data: np.ndarray, tables: list[list[np.ndarray]], step: int = 64) -> np.ndarray:
    """Pooled answers of windows: data is windows x WINDOW bytes; zero bytes pad a text's last window.

    Position comes first and few windows go at once, so that look-ups stay in the cache and the
    pooling runs along contiguous rows."""
    out = np.empty((len(data), len(WIDTHS) * FILTERS), np.float32)
    room = np.empty((2, data.shape[1], step, FILTERS), np.float32)
    for i in range(0, len(data), step):
        one = np.ascontiguousarray(data[i : i + step].T).astype(np.intp)
        pair = (one[:-1] << 8) | one[1:]
        for w, (width, steps) in enumerate(zip(WIDTHS, tables)):
            n = data.shape[1] - width + 1
            total, part = room[:, :n, : one.shape[1]]
            for k, table in enumerate(steps):
                at = (pair if len(table) == 65536 else one)[2 * k : 2 * k + n]
                if one.shape[1] == step:
                    np.take(table, at, 0, out=part if k else total, mode="clip")
                else:
                    (part if k else total)[...] = np.take(table, at, 0)
                if k:
                    np.add(total, part, out=total)
            out[i : i + step, w * FILTERS : (w + 1) * FILTERS] = total.max(0)
    return out


def log_probabilities(net: Network, pooled: np.ndarray) -> np.ndarray:
    z = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(windows: np.ndarray, target: np.ndarray, langs: list[str], steps: int = 400, batch: int = 128, seed: int = 7) -> Network:
    """Adam on cross-entropy; a language weighs the same however many windows it has. Only the byte
    positions that won the pooling get a gradient, so a step touches few table rows."""
    rng = np.random.default_rng(seed)
    shape = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    k = len(WIDTHS) * FILTERS
    net = Network(langs, [shape(w, 256, FILTERS) for w in WIDTHS], np.zeros(k, np.float32), shape(k, len(langs)), np.zeros(len(langs), np.float32))
    params = [*net.taps, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_lang = [np.flatnonzero(target == i) for i in range(len(langs))]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(own, max(1, batch // len(langs))) for own in by_lang if len(own)])
        x, y = windows[rows], target[rows]
        where, pooled = [], []
        for width, tap in zip(WIDTHS, net.taps):
            n = WINDOW - width + 1
            total = sum(tap[j][x[:, j : j + n]] for j in range(width))
            where.append(total.argmax(1))
            pooled.append(total.max(1))
        p = np.concatenate(pooled, 1)
        hidden = np.maximum(p + net.bias, 0)
        delta = np.exp(log_probabilities(net, p))
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        back = (delta @ net.out.T) * (hidden > 0)
        grads = []
        for w, (width, tap) in enumerate(zip(WIDTHS, net.taps)):
            g, part = np.zeros_like(tap), back[:, w * FILTERS : (w + 1) * FILTERS]
            for j in range(width):
                byte = np.take_along_axis(x, where[w] + j, 1)
                np.add.at(g[j], (byte, np.arange(FILTERS)[None, :]), part)
            grads.append(g)
        grads += [back.sum(0), hidden.T @ delta + 1e-4 * net.out, delta.sum(0)]
        for param, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def train(docs: DataFrame) -> Network | None:
    """Fits on one window of at most SAMPLE labelled documents, of each language as many at most (one at
    least); the window starts at a hashed character. Rows with null id, text or lang teach nothing. None
    if no row is left.

    The driver gets the languages' counts first. A hash of the id then thins each language to about twice
    its share before rows are ranked, so that neither the ranking nor the driver sees more on more data.
    """
    labelled = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(id_fold(4) != 2)
    counts = [(r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect()]
    if not counts:
        return None
    quota = max(1, SAMPLE // len(counts))
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, (2 * quota + 100) / n)) for x, n in counts], "lang string, share double")
    pick = F.xxhash64("doc_id")
    thinned = labelled.join(F.broadcast(shares), "lang").filter(F.pmod(pick, F.lit(1 << 30)) < F.col("share") * (1 << 30))  # a row per language
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) + 1
    rows = (
        thinned.filter(F.col("text").rlike(r"\p{L}"))
        .select("lang", F.substring("text", start.cast("int"), F.lit(WINDOW)).alias("piece"), pick.alias("pick")).distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("pick", "piece"))).filter(F.col("rank") <= quota)
        .toPandas().sort_values(["pick", "lang", "piece"], ignore_index=True)
    )
    if not len(rows):
        return None
    langs = sorted(set(rows["lang"]))
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, piece in enumerate(rows["piece"]):
        own = np.frombuffer(piece.encode("utf-8", "surrogatepass")[:WINDOW], np.uint8)
        windows[i, : len(own)] = own
    return fit(windows, np.array([langs.index(x) for x in rows["lang"]]), langs)


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, how many each text has): the text in windows of WINDOW bytes, the last zero-padded."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    data = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    flat, place = data.reshape(-1), 0
    for text, n in zip(texts, counts):
        flat[place : place + len(text)] = np.frombuffer(text, np.uint8)
        place += int(n) * WINDOW
    return data, counts


def predict_languages(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score, one row per row.

    A window counts by the bytes it holds; the text's language has the greatest mean log-probability
    and the score is its share after a softmax of these means. Null texts, texts without a letter
    and untrained networks give `und` and 0. Texts of any length go through in bounded blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = fast_tables(net) if net else None
        for batch in batches:
            texts, letters = batch.column("text"), batch.column("letters").to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            sums = np.zeros((len(texts), len(net.langs) if net else 1))

            def add(pieces: list[bytes], owners: list[int]) -> None:
                data, counts = _cut(pieces)
                logs = log_probabilities(net, answers(data, tables))
                weight = (data != 0).sum(1, keepdims=True)
                np.add.at(sums, np.repeat(owners, counts), logs * weight)

            pieces, owners, size = [], [], 0
            for i in range(len(texts)) if net else ():
                if not letters[i]:
                    continue
                text = texts[i].as_py().encode("utf-8", "surrogatepass")
                for at in range(0, len(text), BLOCK):
                    pieces.append(text[at : at + BLOCK])
                    owners.append(i)
                    size += len(pieces[-1])
                    if size >= BLOCK // 2:
                        add(pieces, owners)
                        pieces, owners, size = [], [], 0
                langs[i] = None
                scores[i] = len(text)
            if pieces:
                add(pieces, owners)
            own = [i for i in range(len(texts)) if langs[i] is None]
            if own:
                mean = sums[own] / np.array([max(1, scores[i]) for i in own])[:, None]
                share = np.exp(mean - mean.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                for i, s in zip(own, share):
                    langs[i], scores[i] = net.langs[int(s.argmax())], float(s.max())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    from trackloom.llm.common import read

    docs = read(spark, sf_dir, "documents")
    found = predict_languages(docs, train(docs))
    return found.select("doc_id", (id_fold(4) == 2).alias("held_out"), "lang_pred", "score")
