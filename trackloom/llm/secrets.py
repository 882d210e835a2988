"""Operator 5: secret scans through a trigram inverted index, in DataFrame functions only.

Every rule's regex is read once on the driver for the trigrams that any match must hold, as an
OR of ANDs. Documents post the wanted trigrams that they contain; the posting lists, trigram to narrow row
keys, are intersected per clause by counting in how many of its lists a row stands; and only the texts of
candidates are verified by the regex. A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import let
from trackloom.llm.common import ascii_lower, running

try:  # the standard library's own parse tree of a regex
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover - before Python 3.11
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `regex` finds leftmost matches, a match stays if its `group` has `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: A whole private key: to its END line if no other line of five dashes comes first; else over what of its own
#: line looks like the key, over lines of base64 or of armour headers, and over the start of the next line.
#: Only single characters are repeated: a repeated group would recurse in Java, once a repeat. The end of the
#: own line's runs of 16 or more is looked for at the ends of runs only, so that blanks are read once.
_PEM = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?>[\s\S]*?(?=-----))-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?=[\x20\t]*[A-Za-z0-9+/=\\]{16})[\x20\tA-Za-z0-9+/=\\]*?"
    r"(?<=[A-Za-z0-9+/=\\])(?![A-Za-z0-9+/=\\])(?![\x20\t]*[A-Za-z0-9+/=\\]{16}))?"
    r"(?:[\x20\t]*(?=\r?\n)[\s\S]*?(?=\r?\n(?!(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):)"
    r"[^\r\n]*?(?:[^A-Za-z0-9+/=\s]|[^\s][\x20\t]+[^\s])|(?![\s\S])))?"
    r"(?:\r?\n[\x20\t]*[A-Za-z0-9+/=]{16,})?)"
)

#: The three base kinds in their listed order, then those that the scan adds.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # A run of 24 or more is the leftmost match of a run that is dropped when shorter.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", _PEM),
)

#: More alternatives than this in one stretch are cut into separate stretches.
_MOST_STRINGS = 64


def _strings(node: list) -> list[set[str] | None]:
    """A parsed sequence as stretches: sets of the strings a stretch can be, None for anything."""
    out: list[set[str] | None] = []

    def put(found: set[str] | None) -> None:
        if found is None:
            out.append(None)
        elif out and out[-1] is not None and len(out[-1]) * len(found) <= _MOST_STRINGS:
            out[-1] = {a + b for a, b in product(out[-1], found)}
        else:
            out.append(found)

    for op, arg in node:
        if op is _c.LITERAL:
            put({chr(arg).lower()})
        elif op is _c.IN and all(x[0] is _c.LITERAL for x in arg):
            put({chr(x[1]).lower() for x in arg})
        elif op is _c.SUBPATTERN:
            for piece in _strings(list(arg[3])):
                put(piece)
        elif op is _c.BRANCH:
            parts = [_strings(list(branch)) for branch in arg[1]]
            if all(len(p) == 1 and p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= _MOST_STRINGS:
                put(set().union(*(p[0] for p in parts)))
            else:
                put(None)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] == 1 and arg[0] == 0:
            inner = _strings(list(arg[2]))
            put(inner[0] | {""} if len(inner) == 1 and inner[0] is not None else None)
        elif op is _c.AT:
            continue
        else:
            put(None)
    return out


def trigram_query(regex: str) -> list[frozenset[str]]:
    """The clauses (any of them, all trigrams of it) that the lower-cased text of a match must
    meet; an empty list if none is mandatory, so that the rule must scan everything."""
    best: list[frozenset[str]] = []
    for stretch in _strings(list(_p.parse(regex))):
        if stretch is None or min(map(len, stretch)) < 3:
            continue
        found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in stretch}
        clauses = sorted((c for c in found if not any(other < c for other in found)), key=sorted)
        if not best or min(map(len, clauses)) > min(map(len, best)):
            best = clauses
    return best


def _wanted(rules: tuple[Rule, ...]) -> list[tuple[str, str, int, int]]:
    """(gram, rule, clause, least) of every clause of the rules: bounded by the rules alone."""
    return [(g, rule.kind, k, len(clause)) for rule in rules for k, clause in enumerate(trigram_query(rule.regex)) for g in sorted(clause)]


def _row() -> dict[str, Column]:
    """128 bits of a row's id and text; repeated rows share them, and rows that did so by chance would only be
    verified for each other's rules too."""
    return {"__a": F.xxhash64("doc_id", "text"), "__b": F.xxhash64(F.lit("row"), "text", "doc_id")}


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: (gram, __a, __b) for each of the wanted trigrams and each row whose lower-cased text
    holds it; a null text holds none."""
    low = docs.select(*(c.alias(name) for name, c in _row().items()), ascii_lower(F.col("text")).alias("__low"))
    held = F.array_compact(F.array(*(F.when(F.contains("__low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select(F.explode(held).alias("gram"), "__a", "__b")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `__rules`: the rules of which the row meets a clause, null text none.

    A clause's posting lists are intersected by counting: a row meets it if it stands in all of them. Lists are
    dealt out by row, narrow as they are, so that no list, however long, is in one place; the rows that meet a
    clause are then joined to their texts.
    """
    wanted = _wanted(rules)
    if not wanted:
        return docs.withColumn("__rules", F.array().cast("array<string>"))
    clauses = docs.sparkSession.createDataFrame(wanted, "gram string, __rule string, __clause int, __least int")
    lists = postings(docs, sorted({g for g, *_ in wanted})).join(F.broadcast(clauses), "gram").repartition("__a", "__b")
    met = lists.groupBy("__a", "__b", "__rule", "__clause", "__least").agg(F.collect_set("gram").alias("__grams"))
    met = met.filter(F.size("__grams") == F.col("__least")).groupBy("__a", "__b").agg(F.collect_set("__rule").alias("__rules"))
    out = docs.withColumns(_row()).join(met, ["__a", "__b"], "left").drop("__a", "__b")
    return out.withColumn("__rules", F.coalesce("__rules", F.array().cast("array<string>")))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end, kind>> of a rule's matches, in code points.

    Pieces between matches and the matches themselves alternate, so that running lengths give every start
    without any position function. The three arrays are worked out once and bound before any lambda reads them."""
    lengths = lambda found: F.transform(found, lambda m: F.length(m))
    found = lengths(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)))
    sizes = lengths(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))) if rule.group else found
    gaps = lengths(F.split(text, rule.regex, -1))

    def placed(b: Column) -> Column:
        moves = F.zip_with(F.slice(b["gap"], 1, F.size(b["len"])), b["len"], lambda gap, n: gap + n)
        ends = running(moves, lambda total, n: total + n, F.lit(0))
        rows = F.filter(F.arrays_zip(ends.alias("end"), b["len"].alias("len"), b["size"].alias("size")), lambda x: x["size"] >= rule.least)
        return F.transform(
            rows, lambda x: F.struct((x["end"] - x["len"]).alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(rule.kind).alias("kind"))
        )

    return let(F.struct(found.alias("len"), gaps.alias("gap"), sizes.alias("size")), placed)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text, ...) with `spans`: array<struct<start, ord, end, kind>> sorted by start and rule.

    Null text counts as empty and has no spans; repeated rows each get the same spans; spans of
    different kinds may overlap. Texts of any length are scanned whole, and an empty table gives an
    empty one. All columns of `docs` stay, but for `spans`, which is replaced; names
    that start with two underscores are the scan's own.
    """
    indexed = [r for r in rules if trigram_query(r.regex)]
    found = candidates(docs, rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        hit = F.array_contains("__rules", rule.kind) if rule in indexed else text.rlike(rule.regex)
        parts.append(F.when(hit, _spans(text, rule, order)).otherwise(none))
    return found.withColumn("spans", F.array_sort(F.concat(*parts))).drop("__rules")


#: Characters of a block of a text; a piece is cut out of its blocks, not counted off from the text's start.
_BLOCK = 1024


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """scan_secrets' rows with every span (overlaps merged) of `text` replaced by `mark`. Time grows with the
    text and its spans, not with their product."""
    text = F.col("text")

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / _BLOCK).cast("int"), F.floor(end / _BLOCK).cast("int")
        block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        at, to = (start % _BLOCK + 1).cast("int"), (end % _BLOCK).cast("int")
        within = F.substr(block(first), at, (end - start).cast("int"))
        across = F.concat(F.substr(block(first), at), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substr(block(last), F.lit(1), to))
        return F.when(first == last, within).otherwise(across)

    def cleaned(b: Column) -> Column:
        # A span starts a mark unless the furthest end of those before it lies beyond its start.
        ends = F.concat(F.array(F.lit(0)), running(F.transform(b["spans"], lambda s: s["end"]), F.greatest, F.lit(0)))

        def joined(ends: Column) -> Column:
            starts = F.transform(b["spans"], lambda s: s["start"])
            rows = F.filter(F.zip_with(F.slice(ends, 1, F.size(starts)), starts, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x: x["s"] >= x["e"])
            marked = F.transform(rows, lambda x: F.concat(piece(b["blocks"], x["e"], x["s"]), F.lit(mark)))
            return F.concat(F.array_join(marked, ""), piece(b["blocks"], F.element_at(ends, -1), b["n"]))

        return let(ends, joined)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    clean = let(F.struct(F.col("spans").alias("spans"), blocks.alias("blocks"), F.length(text).alias("n")), cleaned)
    return docs.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(text))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of scan_secrets over all documents."""
    from trackloom.llm.common import read

    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
