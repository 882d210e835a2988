"""Operator 13: packing of token sequences by the sum-of-squares rule.

A task packs its own documents as they come and shuffles nothing. A document's last piece goes to the fill
level that leaves the least sum of squared counts of partially filled windows; the counts stand in an array by
level, so one numpy expression weighs all levels. A window is written once it is full. What is still open at
the end is cut anew into full windows and into powers of two, none of which needs padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: The vocabulary's file, on every executor; the folder is a parameter.
VOCABULARY = os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
#: Ids of a sequence, and the id that ends a document.
WINDOW, END = 1024, 0
#: Windows that are open in a task at most. Documents that never fill one another are then cut (see Packer.settle).
MOST_OPEN = 4096
#: The vocabulary's way to cut texts, with repeats that never give back, as none here has to.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def load_tokenizer(vocabulary: str = VOCABULARY):
    """text -> numpy array of ids, as the vocabulary's own library gives them, special tokens of the text included.

    The file is read into another public library, which takes a fourth of the time for the same ids."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    # A byte stands for itself in the file if it is a printable mark, else for the next free code point from 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("packing", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


class Packer:
    """Deals documents into windows of `window` ids; put and end return finished pieces, as rows
    (document, start, length, crc32 of the ids, document's ids, sequence, offset)."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN, first: int = 0):
        self.window, self.most_open, self.next = window, most_open, first
        #: counts[h] windows have h ids; none is counted empty or full.
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[deque] = [deque() for _ in range(window + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, to which `size` more ids add the least sum of squares; of equals the fullest."""
        counts, most = self.counts, self.window - size
        # From h to h + size: (N[h + size] + 1)^2 - N[h + size]^2 + (N[h] - 1)^2 - N[h]^2, but for full and empty windows.
        added = 2 * (counts[size : self.window + 1] - counts[: most + 1]) + 2
        added[most] -= 2 * counts[self.window] + 1
        added[0] = 2 * counts[size] + 1 if size < self.window else 0
        added[1:][counts[1 : most + 1] == 0] = np.iinfo(np.int64).max
        return most - int(np.argmin(added[::-1]))

    def put(self, doc, ids: np.ndarray) -> list[tuple]:
        """A document: full windows are cut off its front, the rest is placed whole."""
        out, cut = [], len(ids) // self.window * self.window
        for start in range(0, cut, self.window):
            out += self._written([(doc, start, ids[start : start + self.window], len(ids))])
        if len(rest := ids[cut:]):
            # A copy, so that a short rest doesn't keep a long document.
            out += self._place(self.level_for(len(rest)), (doc, cut, rest.copy() if cut else rest, len(ids)))
        return out + (self.settle() if self.open > self.most_open else [])

    def _place(self, level: int, piece: tuple) -> list[tuple]:
        pieces = []
        if level:
            pieces = self.levels[level].popleft()
            self.counts[level] -= 1
            self.open -= 1
        pieces.append(piece)
        level += len(piece[2])
        if level == self.window:
            return self._written(pieces)
        self.levels[level].append(pieces)
        self.counts[level] += 1
        self.open += 1
        return []

    def _written(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1
        return out

    def settle(self, end: bool = False) -> list[tuple]:
        """Cuts the pieces of the open windows anew, fullest first, into full windows. What is over becomes one
        open window; at the end, windows of a power of two stay and what is over is cut into powers of two."""
        pieces, out = deque(), []
        for level in range(self.window - 1, 0, -1):
            for window in self.levels[level]:
                if end and level & (level - 1) == 0:
                    out += self._written(window)
                else:
                    pieces.extend(window)
            self.levels[level].clear()
        self.counts[:] = 0
        self.open = 0
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = min(left, self.window)
            if size < self.window and end:
                size = 1 << (size.bit_length() - 1)
            some, free = [], size
            while free:
                doc, start, ids, total = pieces.popleft()
                some.append((doc, start, ids[:free], total))
                if len(ids) > free:
                    pieces.appendleft((doc, start + free, ids[free:], total))
                free -= len(some[-1][2])
            left -= size
            if end or size == self.window:
                out += self._written(some)
            else:
                self.levels[size].append(some)
                self.counts[size] += 1
                self.open += 1
        return out


#: Sequences of a task have numbers from its partition's number times this on.
_STRIDE = 1 << 33


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, most_open: int = MOST_OPEN) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and END; a null text counts as empty, so it has one id. Each id lies in one
    piece, the pieces of a sequence stand without gaps, and a sequence has `window` ids or a power of two, so
    that none is padded. Repeated rows are documents of their own; a document of any length is packed whole, by
    one task, which also holds the ids of at most `most_open` windows. An empty table gives no row. Columns other than the two are never read.
    Task retries over the same rows give the same sequences; another layout of the input gives others.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(vocabulary)
        packer = Packer(window, most_open, TaskContext.get().partitionId() * _STRIDE)
        for batch in batches:
            done = []
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                done += packer.put(ids[i].as_py(), np.append(encode(texts[i].as_py() or ""), np.uint32(END)))
                if len(done) >= 1 << 14:
                    yield _rows(done)
                    done = []
            yield _rows(done)
        yield _rows(packer.settle(end=True))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS[1:]))


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pieces)) or [()] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)


def op13_pack_sequences(spark, sf_dir: str) -> DataFrame:
    """pack over all documents."""
    from trackloom.llm.common import read

    return pack(read(spark, sf_dir, "documents"))
