"""Operators 11 to 13 against brute force: manifests, periodic runs, packing."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import EDGES, sentence, table
from trackloom.llm import manifest, packing, periodic


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars) -> str:
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _h(*map(told, (doc_id, source, lang, n_chars, text)))


def _levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _siblings(levels: list[list[str]], at: int) -> list[str | None]:
    return [(level[(at >> k) ^ 1] if (at >> k) ^ 1 < len(level) else None) for k, level in enumerate(levels[:-1])]


def _manifest(rows: list[tuple]) -> list[tuple]:
    """(doc_id, lang, leaf, subroot, root, siblings) of every row, all trees built whole."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, _leaf(*r), r[0]))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: _levels([x[2] for x in sorted(groups[v], key=lambda x: x[:3])]) for v in langs}
    forest = _levels([trees[v][-1][0] for v in langs])
    out = []
    for i, v in enumerate(langs):
        for at, x in enumerate(sorted(groups[v], key=lambda x: x[:3])):
            path = _siblings(trees[v], at) + _siblings(forest, i)
            out.append((x[3], v, x[2], trees[v][-1][0], forest[-1][0], [s for s in path if s]))
    return out


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_equals_whole_trees(spark, bits):
    rng = random.Random(bits)
    rows = EDGES + [(100 + i, sentence(rng, i % 7, ["a", "b", "é"]), rng.choice(["en", "de", "é"]), "s", i) for i in range(60)]
    rows += [(500 + i, "x", "zz", None, None) for i in range(16)] + [(7, "lone", "lone", "s", 4)] + [(9, "many", "en", "s", 4)] * 30
    got = manifest.manifest(table(spark, rows), bits=bits).collect()
    found = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [s for s in r["siblings"] + r["lang_siblings"] if s]) for r in got]
    key = lambda r: repr(r)
    assert sorted(found, key=key) == sorted(_manifest(rows), key=key)


def test_manifest_tells_tampered_rows(spark, tmp_path):
    rows = [(i, f"text {i}", "en" if i % 3 else None, "s", None if i % 5 == 0 else i) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for r in manifest.op11_merkle_manifest(spark, str(tmp_path)).collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["doc_id"] % 5 != 0
        assert r["verified"] is (not changed) and (r["folded_root"] == r["root"]) is (not changed)


def test_manifest_of_one_row_and_of_none(spark):
    one = manifest.manifest(table(spark, [(1, "a", "en", "s", 1)])).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in one] == [(_leaf(1, "a", "en", "s", 1),) * 3 + ([],)]
    assert manifest.manifest(table(spark, [])).count() == 0


def _runs(words: list) -> list[tuple]:
    """(start, length, period) of all runs: every period, every stretch."""
    found: dict = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if (n := i - start + p) >= max(24, 3 * p):
                found.setdefault((start, n), p)  # periods ascend
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def _repeating(rng: random.Random) -> list[int]:
    words = [rng.randrange(rng.choice([2, 3, 60])) for _ in range(rng.choice([0, 1, 23, 24, 60, 150, 300]))]
    for _ in range(rng.randrange(4) if len(words) > 40 else 0):
        a, p = rng.randrange(len(words) - 30), rng.randrange(1, 25)
        for i in range(a + p, min(len(words), a + rng.randrange(20, 140))):
            words[i] = words[i - p]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        texts = [_repeating(rng) for _ in range(6)]
        lengths = np.array([len(t) for t in texts])
        got = periodic.find_runs(np.array([w for t in texts for w in t], np.int64), np.cumsum(lengths) - lengths, lengths)
        for k, words in enumerate(texts):
            assert [tuple(r[1:]) for r in got.tolist() if r[0] == k] == _runs(words)


def test_runs_survive_hashes_that_collide(monkeypatch):
    """Hashes that take everything for equal: words alone decide, and nothing false is told."""
    monkeypatch.setattr(periodic.Prefixes, "equal", lambda self, i, j, n: np.ones(len(i), bool))
    words = [1, 2, 3] * 12 + list(range(10, 60)) + [7] * 30
    got = periodic.find_runs(np.array(words, np.int64), np.array([0]), np.array([len(words)]))
    assert [tuple(r[1:]) for r in got.tolist()] == _runs(words)


def test_pairs_in_pieces_find_the_same(monkeypatch):
    words = np.array(_repeating(random.Random(8)) * 3, np.int64)
    whole = periodic.find_runs(words, np.array([0]), np.array([len(words)])).tolist()
    monkeypatch.setattr(periodic, "BATCH_PAIRS", 7)
    assert periodic.find_runs(words, np.array([0]), np.array([len(words)])).tolist() == whole


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = EDGES + [(1000 + i, rng.choice([" ", "\n", " \t "]).join(f"w{w}" for w in _repeating(rng)), "en", "s", 0) for i in range(120)]
    rows += [(5000, "same " * 4000, "en", "s", 0), (5001, " ".join(map(str, range(30000))), "en", "s", 0)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = _runs(words) if n < 3000 else ([(0, 4000, 1)] if doc_id == 5000 else _long(words))
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, _h(listed), _h(kept)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def _long(words: list[str]) -> list[tuple]:
    """Of 30,000 distinct words only the contract's rewriting can repeat."""
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    again = [i for i, w in enumerate(words) if first[w] < i]
    if not again:
        return []
    p = again[0] - first[words[again[0]]]
    return [(again[0] - p, len(words) - again[0] + p, p)]


def test_the_choice_of_level_is_the_least_sum_of_squares():
    rng = random.Random(1)
    packer = packing.Packer(64)
    for _ in range(3000):
        size, counts = rng.randrange(1, 65), packer.counts.copy()

        def total(level):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 64:
                c[level + size] += 1
            return int((c * c).sum())

        able = [h for h in range(64 - size + 1) if h == 0 or counts[h]]
        assert total(packer.level_for(size)) == min(map(total, able))
        packer.put(None, np.zeros(size, np.uint32))


def _check_pieces(pieces: list[tuple], docs: dict, window: int) -> None:
    """docs: ids by document; every id once, no gaps, no sequence that needs padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, n, crc, total, sequence, offset in pieces:
        ids = docs[doc][start : start + n]
        assert n > 0 and total == len(docs[doc]) and crc == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        by_doc[doc].append((start, n))
        by_sequence[sequence].append((offset, n))
    assert set(by_doc) == set(docs)
    for parts, most in [(p, len(docs[d])) for d, p in by_doc.items()] + [(p, None) for p in by_sequence.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == most if most is not None else at <= window and at & (at - 1) == 0


@pytest.mark.parametrize("most_open", [3, 4096])
def test_packed_ids_lie_in_one_piece_each(most_open):
    rng = random.Random(most_open)
    docs = {i: [rng.randrange(50000) for _ in range(rng.choice([1, 5, 33, 63, 64, 65, 300]))] for i in range(900)}
    packer, out = packing.Packer(64, most_open), []
    for doc, ids in docs.items():
        out += packer.put(doc, np.array(ids, np.uint32))
        assert packer.open <= most_open
    _check_pieces(out + packer.settle(end=True), docs, 64)


def test_ids_are_those_of_the_vocabulary(spark):
    from tokenizers import Tokenizer

    own, theirs = packing.load_tokenizer(), Tokenizer.from_file(packing.VOCABULARY)
    rng = random.Random(2)
    texts = ["", " ", "\n\n x", "a  b   c \t\n d ", "don't WE'LL we'll 's", "x<|endoftext|>y  <|endoftext|>", "日本語 ñandú 😀 ٣٤", "   wide", "a" * 5000, " " * 70000 + "x"]
    texts += ["".join(rng.choice("ab '\n\t.,1é日\u0085 s") for _ in range(60)) for _ in range(400)]
    for text in texts:
        assert own(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text[:60])


def test_pack_over_partitions_and_edges(spark):
    own = packing.load_tokenizer()
    rng = random.Random(6)
    # Each document's id is its own, so that pieces can be held against its text.
    rows = [(i, r[1], *r[2:]) for i, r in enumerate(EDGES)]
    rows += [(100 + i, sentence(rng, rng.choice([3, 80, 700, 3000]), ["alpha", "Beta", "γ", "12"]), "en", "s", 0) for i in range(80)]
    docs = {r[0]: [*own(r[1] or "").tolist(), 0] for r in rows}
    got = packing.pack(table(spark, rows).repartition(3)).collect()
    _check_pieces([tuple(r) for r in got], docs, 1024)
    assert [tuple(r)[1:5] for r in packing.pack(table(spark, [(None, None, None, None, None)])).collect()] == [(0, 1, zlib.crc32(bytes(4)), 1)]
    assert packing.pack(table(spark, [])).count() == 0
