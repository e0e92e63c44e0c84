"""Secret scan: a trigram inverted index per batch of texts picks the texts that a rule can match at all.

Each rule's regex is parsed and turned into a Boolean query over trigrams that any match must hold (AND along a
sequence, OR over alternatives). Per Arrow batch, the postings of exactly those trigrams are built with numpy, each
query intersects and joins postings, and only the candidates are verified by the regex. A rule whose regex has no
mandatory trigram (a bare character run) scans all texts. The index never outlives its batch, so nothing is shuffled,
broadcast or kept, and the work grows with the bytes read.

A null text is empty. Overlapping spans of different kinds are all reported; within a kind, matches are leftmost and
don't overlap; letter case is that of ASCII. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as c
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import LOWER, buffer_of, slices


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Matches whose group ``group`` is shorter are dropped.
    group: int = 0
    least: int = 0


#: The three kinds that are always counted, in this order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further kinds whose spans are added.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?(?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (no condition), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple


def _joined(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(found: set[str]) -> Query:
    return _joined("or", [_joined("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(found)])


def _parts(tree, limit: int = 16) -> tuple[set[str] | None, Query]:
    """(all strings that the tree can match, lower case, or None if they are too many; what any match must hold)"""
    exact: set[str] | None = {""}
    must: list[Query] = []
    run: set[str] = {""}  # strings that end the part read so far
    for op, arg in tree:
        own: set[str] | None = None
        need: Query = True
        if op is c.LITERAL:
            own = {chr(arg).lower()}
        elif op is c.IN and all(o is c.LITERAL for o, _ in arg) and len(arg) <= limit:
            own = {chr(a).lower() for _, a in arg}
        elif op is c.SUBPATTERN:
            own, need = _parts(arg[3], limit)
        elif op is c.BRANCH:
            sub = [_parts(b, limit) for b in arg[1]]
            need = _joined("or", [n if e is None else _of_strings(e) for e, n in sub])
            if all(e is not None for e, _ in sub) and sum(len(e) for e, _ in sub) <= limit:
                own, need = set().union(*(e for e, _ in sub)), True
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, sub = arg
            e, n = _parts(sub, limit)
            if e is not None and high == 1:
                own = e | {""} if low == 0 else e
            elif low:
                need = n if e is None else _of_strings(e)
        elif op is c.AT:
            own = {""}
        if own is not None and len(run) * len(own) <= limit:
            run = {a + b for a in run for b in own}
            exact = None if exact is None else {a + b for a in exact for b in own}
        else:
            must.append(_of_strings(run))
            run, exact = own if own is not None else {""}, None
        must.append(need)
    must.append(_of_strings(run))
    return exact, _joined("and", must)


def trigram_query(pattern: str) -> Query:
    """Trigrams (of the lower-cased text) that every match of the regex must hold; True if there are none."""
    return _parts(_parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(p) for p in query[1]))


class BatchIndex:
    """Postings of the wanted trigrams over the texts of one batch, built piece by piece."""

    PIECE = 1 << 20

    def __init__(self, wanted: list[str]):
        self.wanted = wanted
        self.number = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for i, t in enumerate(wanted):
            a, b, d = t.encode("ascii")
            self.number[a << 16 | b << 8 | d] = i + 1

    def build(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in self.wanted]
        for a in range(0, len(data), self.PIECE):
            low = LOWER[data[a : a + self.PIECE + 2]].astype(np.int32)
            if len(low) < 3:
                break
            code = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(code)
            which, at = code[at], at + a
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[doc + 1]
            which, doc = which[inside], doc[inside]
            for i in np.unique(which).tolist():
                found[i - 1].append(np.unique(doc[which == i]))
        none = np.zeros(0, np.int64)
        return {t: np.unique(np.concatenate([none, *own])) for t, own in zip(self.wanted, found, strict=True)}

    def ask(self, query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return postings[query]
        parts = [self.ask(p, postings, n) for p in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def _scanner(rules: tuple[Rule, ...], id_col: str, text_col: str):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*(trigrams(q) for q in queries)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, found = BatchIndex(wanted), [re.compile(r.pattern, re.ASCII) for r in rules]
        for whole in batches:
            for batch in slices(whole, text_col):
                data, offsets = buffer_of(batch.column(text_col))
                postings = index.build(data, offsets)
                texts = batch.column(text_col).to_pylist()
                spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for k, (rule, regex) in enumerate(zip(rules, found, strict=True)):
                    for i in index.ask(queries[k], postings, len(texts)).tolist():
                        if texts[i]:
                            spans[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i]) if len(m[rule.group]) >= rule.least]
                rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(s)] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(rows, SPANS)], names=["id", "spans"])

    return scan


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_scan(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, spans): for every row of docs its spans (kind, start, end), by start, then in the rules' order."""
    kind = docs.schema[id_col].dataType.simpleString()
    scanned = docs.select(id_col, text_col).mapInArrow(
        _scanner(tuple(rules), id_col, text_col),
        f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>",
    )
    return scanned.withColumnRenamed("id", id_col)
