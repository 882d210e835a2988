"""Operator 3: quality rules from tokeniser fertility.

Two public vocabularies split every word: one of pieces with byte fallback, one of bytes for many
languages. Characters per token of both, the share of byte-fallback tokens and the entropy of the tokens
are held against bands of the text's script, which are fitted to the quartiles of all texts that pass
the base rules. Word, symbol and repetition counts of the base rules come from the same pass.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.stages import Shelf

_FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: The vocabularies' files, on every executor; see the README for the parameter.
VOCABULARY = os.path.join(_FOLDER, "piece_bpe_32k.model")
BYTE_VOCABULARY = os.path.join(_FOLDER, "byte_bpe_multi_50k.tiktoken")
#: Longer words are split in stretches of so many characters, as merges of one word take quadratic time.
LONG_WORD = 256
#: Words that a task remembers at most; they are then forgotten, which changes no result.
MEMO = 1 << 20


@dataclass(frozen=True)
class Band:
    """A text passes if all of its measures are within; entropy is in bits per bit of log2(tokens)."""

    least_chars: float
    most_chars: float
    least_bytes_chars: float
    most_bytes_chars: float
    most_bytes: float
    least_entropy: float


SCRIPTS = ("latin", "cyrillic", "greek", "cjk", "other")
#: A script's bands reach FENCE spreads beyond its quartiles. A spread is the distance of the quartiles,
#: at least so much of chars per token (as a share of the median), of byte share and of entropy share.
FENCE, LEAST_CHARS, LEAST_BYTES, LEAST_ENTROPY = 3.0, 0.03, 0.02, 0.01
#: A script with fewer texts that pass the base rules has no quartiles to speak of and gets this band.
LEAST_TEXTS, WIDE = 100, Band(0.25, 8.0, 0.25, 8.0, 0.95, 0.35)
#: Code points up to (exclusive) which a range of the Unicode table lasts, and its script.
_RANGES = (
    (0x41, ""), (0x5B, "latin"), (0x61, ""), (0x7B, "latin"), (0xC0, ""), (0x250, "latin"), (0x370, "other"),
    (0x400, "greek"), (0x530, "cyrillic"), (0x1E00, "other"), (0x1F00, "latin"), (0x2000, "greek"), (0x2E80, ""),
    (0xA000, "cjk"), (0xAC00, "other"), (0xD7B0, "cjk"), (0xF900, "other"), (0xFB00, "cjk"), (0x20000, "other"),
    (0x32000, "cjk"), (0x110000, "other"),
)
_ENDS = np.array([r[0] for r in _RANGES])
_SCRIPTS = sorted(SCRIPTS)
_OF_RANGE = np.array([_SCRIPTS.index(r[1]) if r[1] else len(_SCRIPTS) for r in _RANGES])


def script_of(text: str) -> str:
    """The script of most letters of the text; `other` without any."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() < 128:
        return "latin" if any(c.isalpha() for c in text[:64]) or text.upper() != text.lower() else "other"
    counts = np.bincount(_OF_RANGE[np.searchsorted(_ENDS, points, "right")], minlength=len(_SCRIPTS) + 1)[:-1]
    return _SCRIPTS[int(counts.argmax())] if counts.any() else "other"


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    if len(codes) < 4:
        return 0
    if codes.max() < 1 << 20:
        keys = (codes[:-2] << 40) | (codes[1:-1] << 20) | codes[2:]
    else:
        _, codes = np.unique(codes, return_inverse=True)
        _, pairs = np.unique(codes[:-2] * len(codes) + codes[1:-1], return_inverse=True)
        keys = pairs * len(codes) + codes[2:]
    _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    inside = np.zeros(len(codes), bool)
    for j in range(3):
        inside[j : len(again) + j] |= again
    return int(inside.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in data.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


class Splitter:
    """Tokens of words, remembered: flat ids of the first vocabulary with an offset for each word's code,
    and how many tokens the second one takes."""

    def __init__(self, vocabulary: str, byte_vocabulary: str):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        with open(byte_vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = tiktoken.Encoding("bytes", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.ids, self.starts, self.counts, self.others = (np.empty(1 << 16, np.int64) for _ in range(4))
        self.used = 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The code of every word; new words are split, all at once."""
        if len(self.codes) > MEMO // 2:
            self.forget()
        codes = self.codes
        if new := [w for w in dict.fromkeys(words) if w not in codes]:
            texts = [w.decode("utf-8", "replace") for w in new]
            split = self.model.encode(texts, num_threads=1)
            first, last = len(codes), len(codes) + len(new)
            counts = np.fromiter(map(len, split), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(split), np.int64, int(counts.sum()))
            if last > len(self.starts):
                self.starts, self.counts, self.others = (np.resize(x, 2 * last) for x in (self.starts, self.counts, self.others))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
            codes.update(zip(new, range(first, last)))
            self.starts[first:last], self.counts[first:last] = self.used + np.cumsum(counts) - counts, counts
            self.others[first:last] = np.fromiter(map(self.byte_tokens, texts), np.int64, len(new))
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))

    def byte_tokens(self, word: str) -> int:
        """Tokens of the second vocabulary."""
        if len(word) <= LONG_WORD:
            return len(self.bytes_of.encode_ordinary(word))
        return sum(len(self.bytes_of.encode_ordinary(word[i : i + LONG_WORD])) for i in range(0, len(word), LONG_WORD))

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        """The ids of a sequence of words."""
        counts = self.counts[codes]
        before = np.cumsum(counts) - counts
        return self.ids[np.repeat(self.starts[codes] - before, counts) + np.arange(int(counts.sum()))]


def measure(text: str | None, splitter: Splitter) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens, chars per token, per token of
    bytes, byte share, entropy share, script)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at exactly the six ASCII white-space bytes
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    if not words:
        return 0, 0, symbols, 0, 0, 0, 0.0, 0.0, 0.0, 1.0, "other"
    codes = splitter(words)
    ids = splitter.tokens(codes)
    chars, others = len(text) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))), int(splitter.others[codes].sum())
    counts = np.bincount(ids) if len(ids) else np.empty(0, np.int64)
    share = counts[counts > 0] / max(1, len(ids))
    entropy = float(-(share * np.log2(share)).sum() / np.log2(len(ids))) if len(ids) > 1 else 1.0
    return (
        len(words),
        chars,
        symbols,
        duplicate_lines(data),
        repeated_words(codes),
        len(ids),
        chars / len(ids) if len(ids) else 0.0,
        chars / others if others else 0.0,
        float(splitter.is_byte[ids].mean()) if len(ids) else 0.0,
        entropy,
        script_of(text),
    )


_COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, chars_per_byte_token double, byte_share double, entropy_share double, script string"
)


def measures(docs: DataFrame, vocabulary: str = VOCABULARY, byte_vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """docs(doc_id, text, ...) -> the base counts and the fertility measures, with base_failed, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary, byte_vocabulary)
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.string()]
        for batch in batches:
            columns = list(zip(*(measure(text.as_py(), splitter) for text in batch.column("text")))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.select("doc_id", "text").mapInArrow(run, _COLUMNS).withColumn("base_failed", failed)


def fitted_bands(measured: DataFrame) -> dict[str, Band]:
    """The band of each script, from the quartiles of all its texts that pass the base rules. The
    sketches of the quartiles are merged in Spark; the driver gets a row for each script."""
    names = ("chars_per_token", "chars_per_byte_token", "byte_share", "entropy_share")
    quartiles = (F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in names)
    bands = dict.fromkeys(SCRIPTS, WIDE)
    for r in measured.filter("NOT base_failed").groupBy("script").agg(F.count("*").alias("texts"), *quartiles).collect():
        if r["texts"] < LEAST_TEXTS:
            continue
        fences = []
        for name in names[:2]:
            low, middle, high = r[name]
            reach = FENCE * max(high - low, LEAST_CHARS * middle)
            fences += [low - reach, high + reach]
        (low, _, high), (least, _, most) = r["byte_share"], r["entropy_share"]
        fences += [high + FENCE * max(high - low, LEAST_BYTES), least - FENCE * max(most - least, LEAST_ENTROPY)]
        bands[r["script"]] = Band(*fences)
    return bands


def within(bands: dict[str, Band]) -> Column:
    """True for a measured text that is within its script's band."""
    c = F.col
    return reduce(
        or_,
        (
            (c("script") == script)
            & c("chars_per_token").between(b.least_chars, b.most_chars)
            & c("chars_per_byte_token").between(b.least_bytes_chars, b.most_bytes_chars)
            & (c("byte_share") <= b.most_bytes)
            & (c("entropy_share") >= b.least_entropy)
            for script, b in bands.items()
        ),
    )


def fertility_rules(
    docs: DataFrame, vocabulary: str = VOCABULARY, byte_vocabulary: str = BYTE_VOCABULARY, bands: dict[str, Band] | None = None
) -> DataFrame:
    """docs(doc_id, text, ...) -> the base counts, the fertility measures and the verdict, one row per row.

    Null and white-space texts have no word, fail the base rules and have 0 characters per token.
    base_failed: under 50 words, or over half of the words in repeated three-word windows. kept:
    the base rules pass and so does the band of the script; without `bands` these are fitted to all
    texts, and the measures are written once for it. On a band's edge is within. Repeated rows are judged
    alike; a text of any length goes through whole, one at a time. An empty table gives no row. Other
    columns of docs are never read.
    """
    measured = measures(docs, vocabulary, byte_vocabulary)
    if bands is None:
        measured = Shelf(docs.sparkSession).put("measures", measured)
        bands = fitted_bands(measured)
    return measured.withColumn("kept", ~F.col("base_failed") & within(bands))


def op3_fertility_rules(spark, sf_dir: str) -> DataFrame:
    """fertility_rules over all documents."""
    from trackloom.llm.common import read

    return fertility_rules(read(spark, sf_dir, "documents"))
