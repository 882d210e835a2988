"""Operator 6: greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie; a failure link leads from a node to where matching goes on once the
longest pieces within the node's string are popped, and every link keeps how many pieces that pops.
A word is then read once, character by character, and its number of pieces comes out without any
piece being built or any character being read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackloom.llm.fertility import MEMO, VOCABULARY

#: In the vocabulary, a word's first piece begins with this mark and later pieces do not.
MARK = "▁"


def load_pieces(vocabulary: str = VOCABULARY) -> list[str]:
    """The plain pieces of a sentencepiece vocabulary: without controls and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton:
    """count(word) = number of pieces of the greedy longest-match split of MARK + word, or None.

    Node 0 is the root of first pieces (entered through MARK), node 1 that of later pieces. A
    node's `fail` is where its pops lead, -1 if its string cannot be split, and `popped` how many
    pieces they take.
    """

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = {0: False, 1: False}
        for piece in sorted(set(pieces)):
            first = piece.startswith(MARK)
            node, rest = (0, piece[1:]) if first else (1, piece)
            if not first and not rest:
                continue
            for c in rest:
                after = self.next[node].get(c)
                if after is None:
                    after = self.next[node][c] = len(self.next)
                    self.next.append({})
                    ends[after] = False
                node = after
            ends[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        # The root itself can be popped only if the bare mark is a piece.
        self.fail[0], self.popped[0] = (1, 1) if ends[0] else (-1, 0)
        self.bare = ends[0]
        level = [0, 1]
        while level:  # breadth first: links of shorter strings are ready
            below = []
            for node in level:
                for c, child in self.next[node].items():
                    if ends[child]:
                        self.fail[child], self.popped[child] = 1, 1
                    else:
                        at, n = self.fail[node], self.popped[node]
                        while at >= 0 and c not in self.next[at]:
                            n += self.popped[at]
                            at = self.fail[at] if at != 1 else -1
                        if at >= 0:
                            self.fail[child], self.popped[child] = self.next[at][c], n
                    below.append(child)
            level = below

    def count(self, word: str) -> int | None:
        node, n = 0, 0
        for c in word:
            while (after := self.next[node].get(c)) is None:
                if node == 1 or self.fail[node] < 0:
                    return None
                n += self.popped[node]
                node = self.fail[node]
            node = after
        while node > 1:
            if self.fail[node] < 0:
                return None
            n += self.popped[node]
            node = self.fail[node]
        return n if node == 1 else None


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_tokens, n_unknown (long), one row per row.

    A word that the vocabulary cannot spell counts as one token and in n_unknown. Null and empty
    texts have none. Repeated rows count alike; a text of any length is counted whole; columns
    other than these two are never read. The automaton is built once on the driver, from the
    vocabulary alone, and broadcast; a task remembers at most MEMO words.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(load_pieces(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = automaton.value.count, {}
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(memo) > MEMO:
                    memo.clear()
                for w in set(words).difference(memo):
                    n = count(w.decode("utf-8", "surrogatepass"))
                    memo[w] = -1 if n is None else n
                each = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                rows.append((len(words), int(np.abs(each).sum()), int((each < 0).sum())))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """token_counts over all documents."""
    from trackloom.llm.common import read

    return token_counts(read(spark, sf_dir, "documents"))
