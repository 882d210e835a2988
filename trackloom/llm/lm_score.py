"""Operator 10: document scores by masked pseudo-likelihood.

A window network in numpy sees the two words before and the two after a masked word and predicts it:
first its class, then, among the words of the class, the word itself, both from the same hidden state,
so that both sides speak for every word that the network tells apart. A document's score is the sum of
the log-probabilities of all its words, each masked in turn. Counts are of real words, in a table keyed
by word that is never collected; the commonest go to every task, the others are joined by word. The
words that the network tells apart grow with the corpus; all rarer ones share a few classes and are told
apart by their counts. Counts come from all documents; the network starts as the counts' own distribution
and is trained on all documents too, each task on its own part from a shared start, and the parts'
weights are averaged by the words they saw.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.stages import keep as checkpoint

#: Tasks hold the BUCKETS commonest words at most; the others are joined. The commonest of these are told
#: apart, in classes of as many words each as there are classes: LEAST_SIDE to MOST_SIDE, see own_side().
BUCKETS, LEAST_SIDE, MOST_SIDE = 1 << 18, 4, 128
#: Classes of the other words that tasks hold, and of those that they don't hold, by shape.
SHARED, SHAPES = 8, 8
EMBED, HIDDEN, SIDE = 8, 24, 2
#: Words of a training step, and words that a task remembers at most (forgetting changes no result).
STEP, MEMO = 4096, 1 << 19
#: Bytes of text whose words are found at once (a text is never cut, so a longer one takes more), and numbers of a network that
#: take a step at once, so that they stay in a core's own cache.
READ, NUMBERS = 1 << 23, 1 << 14
#: Offsets of the neighbours in a padded sequence.
_OFFSETS = [o for o in range(2 * SIDE + 1) if o != SIDE]
#: Weights in a row when networks are summed; steps that a task should have at least.
BLOCK, STEPS = 4096, 100
#: Steps' words that are scored together.
TOGETHER = 4


def splits(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(the words of some texts, one after the other, and how many each text has), A-Z lower-cased. Words are found by Arrow
    for READ bytes of text at once, as a Python object for each of them cost more than all that was done with it."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // READ
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(texts)]):
        found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts[start:end], "")))
        words, ends = found.values.cast(pa.binary()), found.offsets.to_numpy()
        real = pc.greater(pc.binary_length(words), 0)  # there is an empty one beside white space at either end
        yield words.filter(real), np.diff(np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[ends])


def shape(words: pa.Array) -> np.ndarray:
    """Of each word one of SHAPES, by length and by whether there is anything but letters of ASCII."""
    letters = pc.ascii_is_alpha(pc.cast(words, pa.string(), safe=False)).to_numpy(zero_copy_only=False)
    return 2 * np.minimum(pc.binary_length(words).to_numpy() // 4, SHAPES // 2 - 1) + ~letters


def counted(batches: Iterator[pa.RecordBatch], most: int = MEMO) -> Iterator[pa.RecordBatch]:
    """(word, shape, n) of a part of the documents; a word comes again where more than `most` are to be remembered."""

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def rows(total: pa.Table) -> Iterator[pa.RecordBatch]:
        for part in total.to_batches():
            word, n = part.columns
            yield pa.RecordBatch.from_arrays([word, pa.array(shape(word), pa.int32()), n], ["word", "shape", "n"])

    tables: list[pa.Table] = []
    for batch in batches:
        for words, _ in splits(batch.column("text")):
            counts = words.value_counts()
            tables.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
            if sum(map(len, tables)) > 2 * most:
                tables = [added(tables)]
            if len(tables[0]) > most:
                yield from rows(added(tables))
                tables = []
    if tables:
        yield from rows(added(tables))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, shape, n): how often each word occurs in all documents, one row per word, checkpointed."""
    parts = docs.select("text").mapInArrow(counted, "word binary, shape int, n long")
    return checkpoint(parts.groupBy("word", "shape").agg(F.sum("n").alias("n")))


@dataclass
class Vocabulary:
    """What the network knows of each place: `names` are the words held, the commonest first, and the last
    SHAPES places stand for the words not held, by shape. The first side * side places are symbols of their
    own, the others share SHARED + SHAPES symbols, in which `within` is their log-probability (0 where it
    is not the network's to say: for words of their own, and for shapes, whose words are joined).
    `first` and `second` are the log-probabilities of the classes and of the words in them by counts."""

    symbols: np.ndarray
    within: np.ndarray
    side: int
    first: np.ndarray
    second: np.ndarray
    names: pa.Array = field(default_factory=lambda: pa.array([], pa.binary()))

    @property
    def edge(self) -> int:
        """The symbol beyond a text's ends."""
        return self.side**2 + SHARED + SHAPES

    def places(self, words: pa.Array) -> np.ndarray:
        """Of each word; words that are not held have that of their shape."""
        out = pc.fill_null(pc.index_in(words, value_set=self.names), -1).to_numpy().copy()
        beyond = np.flatnonzero(out < 0)
        out[beyond] = len(self.names) + shape(words.take(pa.array(beyond)))
        return out


def own_side(distinct: int) -> int:
    """Classes of words that are told apart, and words in each: twice the fourth root of the distinct words
    of the corpus, so that these words grow as its square root and the work a word far slower than the corpus."""
    return int(min(MOST_SIDE, max(LEAST_SIDE, 2 * distinct**0.25)))


def vocabulary(counts: np.ndarray, side: int, names: pa.Array | None = None, shapes: dict[int, int] | None = None) -> Vocabulary:
    """Of the words held, the commonest first, and of the occurrences of others by shape. Classes are runs of
    `side` words by rank; words beyond side * side are dealt by rank into SHARED classes of about equal mass."""
    while side and side * side > len(counts):
        side -= 1
    own = side * side
    symbols = np.arange(len(counts), dtype=np.int32)
    mass = np.cumsum(counts[own:], dtype=np.float64)
    symbols[own:] = own + np.minimum((mass / mass[-1:].sum() * SHARED).astype(np.int32), SHARED - 1) if len(mass) else 0
    beyond = np.maximum(np.bincount(symbols[own:] - own, counts[own:], SHARED), 0.5)
    within = np.zeros(len(counts) + SHAPES, np.float32)
    within[own : len(counts)] = np.log(counts[own:] / beyond[symbols[own:] - own])
    inner = counts[:own].reshape(side, side).astype(np.float64)
    first = np.concatenate([inner.sum(1), beyond, [max(0.5, (shapes or {}).get(k, 0)) for k in range(SHAPES)]])
    symbols = np.concatenate([symbols, own + SHARED + np.arange(SHAPES, dtype=np.int32)])
    second = np.log(inner / inner.sum(1, keepdims=True))
    return Vocabulary(symbols, within, side, np.log(first / first.sum()).astype(np.float32), second.astype(np.float32), *([] if names is None else [names]))


def learned_vocabulary(table: DataFrame) -> tuple[Vocabulary, DataFrame, int]:
    """Of corpus_counts' table, with (word, term) of the words that tasks don't hold, the log-probability
    within their shape, and the number of all occurrences. The driver gets BUCKETS words at most and the
    numbers of words by count."""
    by_count = table.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    fits = by_count["words"].cumsum() <= BUCKETS
    least = int(by_count["n"][fits].min()) if fits.any() else 1 << 62
    head = table.filter(F.col("n") >= least).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    rare = table.filter(F.col("n") < least)
    mass = {r["shape"]: r["mass"] for r in rare.groupBy("shape").agg(F.sum("n").alias("mass")).collect()}
    vocab = vocabulary(head["n"].to_numpy(), own_side(int(by_count["words"].sum())), pa.array(head["word"].to_pylist(), pa.binary()), mass)
    masses = F.array(*(F.lit(float(mass.get(k, 1))) for k in range(SHAPES)))
    terms = rare.select("word", F.log(F.col("n") / masses[F.col("shape")]).alias("term"))
    return vocab, terms, int((by_count["n"] * by_count["words"]).sum())


def shapes(side: int) -> tuple:
    """Of the arrays of a network that tells side * side words apart: symbols, window, and then for classes and for the
    words of each class what the hidden state adds to them; the last row of all but the first is a bias or scores of their own."""
    first, words = side + SHARED + SHAPES, (side, HIDDEN + 1, side)
    return (side * side + SHARED + SHAPES + 1, EMBED), (2 * SIDE * EMBED + 1, HIDDEN), (HIDDEN + 1, first), words


class Network(list):
    """The parts of a flat network, as views: symbols, window, bias, what the hidden state adds to classes, their own scores,
    and the same two for words. `joint` has those of shapes(), where a bias lies under its matrix: one product does both."""

    def __init__(self, flat: np.ndarray, side: int):
        self.joint, at = [], 0
        for s in shapes(side):
            n = int(np.prod(s))
            self.joint.append(flat[at : at + n].reshape(s))
            at += n
        embed, window, classes, words = self.joint
        super().__init__([embed, window[:-1], window[-1], classes[:-1], classes[-1], words[:, :-1], words[:, -1]])


def unpack(flat: np.ndarray, side: int) -> Network:
    return Network(flat, side)


def initial_weights(vocab: Vocabulary, seed: int = 11) -> np.ndarray:
    """Symbols and windows at random, scores by counts, nothing yet from the hidden state."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes(vocab.side)), np.float32)
    embed, into, _, _, out_bias, _, inner_bias = unpack(flat, vocab.side)
    embed[:], into[:] = rng.normal(0, 0.3, embed.shape), rng.normal(0, 0.3, into.shape)
    out_bias[:], inner_bias[:] = vocab.first, vocab.second
    return flat


_ROOM: dict[tuple, np.ndarray] = {}


def room(name: str, *size: int, like: np.ndarray) -> np.ndarray:
    """An array of that size and of like's kind, its numbers unset. The next call under that name takes the same memory:
    asking the system for fresh memory at every step cost more than the arithmetic on it."""
    n, key = int(np.prod(size)), (name, like.dtype.char)
    if key not in _ROOM or len(_ROOM[key]) < n:
        _ROOM[key] = np.empty(n, like.dtype)
    return _ROOM[key][:n].reshape(size)


def _taken(name: str, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.take(rows, places, 0, out=room(name, len(places), rows.shape[1], like=rows), mode="clip")


def _window(embed: np.ndarray, padded: np.ndarray) -> np.ndarray:
    """The neighbours' vectors side by side, at every inner place of a padded sequence of symbols, and a last column of ones."""
    n = len(padded) - 2 * SIDE
    vectors, window = _taken("vectors", embed, padded), room("window", n, 2 * SIDE * EMBED + 1, like=embed)
    for k, o in enumerate(_OFFSETS):
        window[:, k * EMBED : (k + 1) * EMBED] = vectors[o : o + n]
    window[:, -1] = 1
    return window


def _hidden(window: np.ndarray, into: np.ndarray) -> np.ndarray:
    """The hidden state and a last column of ones, by which scores of their own are added in the same product."""
    sums, hidden = room("sums", len(window), HIDDEN, like=into), room("hidden", len(window), HIDDEN + 1, like=into)
    np.clip(np.matmul(window, into, out=sums), -15, 15, out=sums)
    # tanh(x) = 1 - 2 / (exp(2x) + 1), in half of np.tanh's time
    np.add(np.exp(np.multiply(sums, 2, out=sums), out=sums), 1, out=sums)
    np.subtract(1, np.divide(2, sums, out=sums), out=hidden[:, :-1])
    hidden[:, -1] = 1
    return hidden


def _class_scores(hidden: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return np.matmul(hidden, classes, out=room("first", len(hidden), classes.shape[1], like=hidden))


def _word_scores(h: np.ndarray, parts: list[tuple[int, slice]], words: np.ndarray) -> np.ndarray:
    """Of the words of each row's class; rows of a class stand together."""
    z = room("second", len(h), len(words), like=h)
    for c, part in parts:
        np.dot(h[part], words[c], out=z[part])  # np.dot takes a tenth less than np.matmul for such small ones
    return z


def _by_class(target: np.ndarray, side: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(places whose word is told apart, in order of its class; each class with its part of them)."""
    own = np.flatnonzero(target < side * side)
    classes = (target[own] // max(1, side)).astype(np.int16)
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(side + 1))
    return own[order], [(c, slice(ends[c], ends[c + 1])) for c in range(side) if ends[c] < ends[c + 1]]


def _first_class(target: np.ndarray, side: int) -> np.ndarray:
    return np.where(target < side * side, target // max(1, side), target - side * side + side)


def _probabilities(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials in place of scores, which stay within +-60 so that they need no shift; their sums)."""
    np.exp(np.clip(z, -60, 60, out=z), out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def log_probabilities(weights: Network, padded: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the symbol at every inner place, given the neighbours."""
    embed, into, classes, words = weights.joint
    side = len(words)
    hidden, first = _hidden(_window(embed, padded), into), _first_class(target, side)
    logs = np.empty(len(target), hidden.dtype)
    for start in range(0, len(target), STEP):
        part = slice(start, start + STEP)
        p, total = _probabilities(_class_scores(hidden[part], classes))
        np.log(p[np.arange(len(p)), first[part]] / total, out=logs[part])
    places, parts = _by_class(target, side)
    if len(places):
        p, total = _probabilities(_word_scores(_taken("own", hidden, places), parts, words))
        logs[places] += np.log(p[np.arange(len(places)), target[places] % side] / total)
    return logs


def gradient(weights: Network, padded: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability of the real words (boundaries have the number after the last symbol).
    The next call takes the same memory for its result."""
    embed, into, classes, words = weights.joint
    side, edge, n = len(words), len(embed) - 1, len(padded) - 2 * SIDE
    flat = room("gradient", sum(w.size for w in weights), like=embed)
    flat[:] = 0
    g_embed, g_into, g_classes, g_words = unpack(flat, side).joint
    target = padded[SIDE : SIDE + n]
    window = _window(embed, padded)
    hidden = _hidden(window, into)
    real = target < edge
    mean = 1 / max(1, np.count_nonzero(real))
    # by a row's scores the gradient is mean / total * (p - total at the word itself): that factor goes to the narrow sides
    p, total = _probabilities(_class_scores(hidden, classes))
    p[np.arange(n), _first_class(np.where(real, target, 0), side)] -= total
    factor = (real * np.divide(mean, total, dtype=p.dtype))[:, None]
    back = np.matmul(p, classes[:-1].T, out=room("back", n, HIDDEN, like=hidden))
    back *= factor
    np.matmul(np.multiply(hidden, factor, out=room("scaled", *hidden.shape, like=hidden)).T, p, out=g_classes)
    places, parts = _by_class(target, side)
    if len(places):
        h, pulled = _taken("own", hidden, places), room("pulled", len(places), HIDDEN, like=hidden)
        p, total = _probabilities(_word_scores(h, parts, words))
        p[np.arange(len(places)), target[places] % side] -= total
        factor = np.divide(mean, total, dtype=p.dtype)[:, None]
        h *= factor
        for c, part in parts:
            own = p[part]
            np.dot(h[part].T, own, out=g_words[c])
            np.dot(own, words[c, :-1].T, out=pulled[part])
        pulled *= factor
        back[places] += pulled
    state, slope = hidden[:, :-1], room("sums", n, HIDDEN, like=hidden)
    np.subtract(1, np.multiply(state, state, out=slope), out=slope)
    back *= slope
    pull = np.matmul(back, into[:-1].T, out=room("pull", n, 2 * SIDE * EMBED, like=hidden))
    vectors = room("spread", len(padded), EMBED, like=hidden)
    vectors[:] = 0
    for k, o in enumerate(_OFFSETS):
        vectors[o : o + n] += pull[:, k * EMBED : (k + 1) * EMBED]
    order = np.argsort(padded.astype(np.int16), kind="stable")  # there are fewer symbols than 2^15
    symbols = padded[order]
    starts = np.flatnonzero(np.diff(symbols, prepend=-1))
    g_embed[symbols[starts]] = np.add.reduceat(_taken("vectors", vectors, order), starts, 0)
    np.matmul(window.T, back, out=g_into)
    return flat


def descend(own: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, step: int) -> None:
    """A step of Adam, in place, NUMBERS at once; g is used up. first and second are 10 and 100 times Adam's means, which
    then need no factor of g."""
    lean, root = 1 - 0.9**step, (1 - 0.99**step) ** 0.5
    for at in range(0, len(own), NUMBERS):
        w, d, a, b = (x[at : at + NUMBERS] for x in (own, g, first, second))
        np.add(np.multiply(a, 0.9, out=a), d, out=a)
        np.add(np.multiply(b, 0.99, out=b), np.multiply(d, d, out=d), out=b)
        np.add(np.sqrt(b, out=d), 1e-7 * root, out=d)
        np.multiply(np.divide(a, d, out=d), 0.01 * root / lean, out=d)
        np.subtract(w, d, out=w)


def encoded(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(row, doc_id, n_tokens, places, others, times) of each row of docs, checkpointed: the places in the vocabulary of
    its words in order, and the words that the vocabulary doesn't hold with their numbers. Texts are split here once,
    for training and scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            places, others = [np.empty(0, np.int32)], []
            n: list[int] = []
            for words, counts in splits(batch.column("text")):
                own = vocab.places(words)
                beyond = np.flatnonzero(own >= len(vocab.names))
                names = words.take(pa.array(beyond)).to_pylist()
                ends = np.searchsorted(beyond, np.cumsum([0, *counts])).tolist()
                others += [Counter(names[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                places.append(own)
                n += counts.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(places))),
                    pa.array([list(o) for o in others], pa.list_(pa.binary())), pa.array([list(o.values()) for o in others], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_tokens", "places", "others", "times"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, places array<int>, others array<binary>, times array<long>")
    return checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))  # the number of a row must not change


def sequences(places: pa.ListArray, vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(padded symbols, places) of each text."""
    edge = np.full(SIDE, vocab.edge, np.int32)
    ends, values = places.offsets.to_numpy(), places.values.to_numpy()
    for start, end in zip(ends[:-1], ends[1:]):
        own = values[start:end]
        yield np.concatenate([edge, vocab.symbols[own], edge]), own


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weights and words of each block, one network's size at most."""
    total: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            sums, n = total.get(row["block"], (0.0, 0))
            total[row["block"]] = (sums + np.array(row["weights"]), n + row["n"])
    kind = pa.list_(pa.float64())
    columns = [pa.array(list(total), pa.int32()), pa.array([s for s, _ in total.values()], kind), pa.array([n for _, n in total.values()], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["block", "weights", "n"])


def train(rows: DataFrame, shared: Broadcast, rounds: int = 1) -> np.ndarray:
    """Rounds of one pass over all documents, as encoded. A task sends its weights times its words, BLOCK weights a row;
    tasks sum them by block, so that the driver gets one network a round."""
    flat = initial_weights(shared.value)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = flat) -> Iterator[pa.RecordBatch]:
            own, vocab, seen = start.copy(), shared.value, 0
            weights = unpack(own, vocab.side)
            first, second, step = np.zeros_like(own), np.zeros_like(own), 0
            waiting, size = [], 0

            def learn(padded: np.ndarray) -> None:
                nonlocal step
                step += 1
                descend(own, gradient(weights, padded), first, second, step)

            for batch in batches:
                for padded, words in sequences(batch.column("places"), vocab):
                    seen += len(words)
                    for at in range(0, len(words), STEP):  # long texts in steps that overlap by their edges
                        waiting.append(padded[at : at + STEP + 2 * SIDE])
                        size += len(waiting[-1])
                        if size >= STEP:
                            learn(np.concatenate(waiting))
                            waiting, size = [], 0
            if waiting:
                learn(np.concatenate(waiting))
            if seen:
                sums = own.astype(np.float64) * seen
                blocks = [sums[at : at + BLOCK] for at in range(0, len(sums), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.list_(pa.float64())), pa.array([seen] * len(blocks), pa.int64())],
                    ["block", "weights", "n"],
                )

        kind = "block int, weights array<double>, n long"
        parts = rows.select("places").mapInArrow(run, kind).repartition("block").mapInArrow(_added, kind).toArrow().sort_by("block").to_pylist()
        if parts:
            flat = np.concatenate([np.array(r["weights"]) / r["n"] for r in parts]).astype(np.float32)
    return flat


def log_likelihoods(weights: Network, vocab: Vocabulary, texts: Iterable[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
    """Of `count` texts as (padded symbols, places): the sums over their words of the log-probability given both
    sides. Short texts share a step, long ones take steps that overlap by their edges."""
    total, waiting, size = np.zeros(count), [], 0

    def add() -> None:
        rows, pieces, owns = zip(*waiting)
        padded, sizes = np.concatenate(pieces), [len(own) for own in owns]
        target = padded[SIDE : len(padded) - SIDE]
        logs = log_probabilities(weights, padded, np.where(target == vocab.edge, 0, target))
        starts = np.cumsum([0] + [len(piece) for piece in pieces[:-1]])
        inner = np.concatenate([start + np.arange(n) for start, n in zip(starts, sizes)])
        terms = logs[inner].astype(np.float64) + vocab.within[np.concatenate(owns)]
        np.add(total, np.bincount(np.repeat(rows, sizes), terms, count), out=total)

    for row, (padded, places) in enumerate(texts):
        for at in range(0, len(places), STEP):
            own = places[at : at + STEP]
            waiting.append((row, padded[at : at + len(own) + 2 * SIDE], own))
            size += len(own)
            if size >= TOGETHER * STEP:
                add()
                waiting, size = [], 0
    if waiting:
        add()
    return total


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, log_prob, mean_log_prob, one row per row.

    Null and empty texts have no token and 0 in all columns. Repeated rows score alike, up to rounding of
    single precision. Texts are scored whole, STEP words at a time; other columns are never read. The weights depend on how the
    rows are dealt to tasks, so that another layout gives slightly other scores.
    """
    vocab, rare, words = learned_vocabulary(corpus_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = encoded(docs, shared)
    flat = train(rows.coalesce(max(1, words // (STEPS * STEP))), shared)  # small parts of a small table learn together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, vocab = unpack(flat, shared.value.side), shared.value
        for batch in batches:
            logs = log_likelihoods(weights, vocab, sequences(batch.column("places"), vocab), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("row", "doc_id", "n_tokens")), pa.array(logs, pa.float64())], ["row", "doc_id", "n_tokens", "held"])

    held = rows.select("row", "doc_id", "n_tokens", "places").mapInArrow(run, "row long, doc_id long, n_tokens long, held double")
    terms = (
        rows.select("row", F.explode(F.arrays_zip("others", "times")).alias("o"))
        .select("row", F.col("o.others").alias("word"), F.col("o.times").alias("times"))
        .join(rare, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("term")).alias("joined"))
    )
    log_prob = F.col("held") + F.coalesce("joined", F.lit(0.0))
    return (
        held.join(terms, "row", "left")
        .select("doc_id", "n_tokens", log_prob.alias("log_prob"), (log_prob / F.greatest("n_tokens", F.lit(1))).alias("mean_log_prob"))
    )


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """pseudo_likelihood over all documents."""
    from trackloom.llm.common import read

    return pseudo_likelihood(read(spark, sf_dir, "documents"))
