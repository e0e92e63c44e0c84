"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of every benchmark item (an item of fewer words is one window).
A shift table tells, for the two words that end the current alignment, how far the search may jump without missing a
pattern; where it says zero, a bucket of the patterns ending in those two words is compared directly. Patterns shorter
than the window length get a search of their own, since the shortest pattern bounds every jump.

The benchmark is a query set: its windows (not its items) are dealt to blocks of about ``block_windows`` by hash, so
what is broadcast is bounded whatever the size of an item. With several blocks the documents are scanned once per block,
one block after the other: a block's tables are made, used, and freed before the next one's. The hits of a pass are
written and in the end joined to every row by id and text digest. Documents are scanned where they lie: no shuffle of
texts. A text above 4 MB is cut into words piece by piece.

A word is a run of ASCII digits and letters (A-Z lower-cased) and of all code points from U+0080 on. Null texts have no
words. An item without words matches nothing. Items that repeat a window are all reported. Rows that repeat an id, or
have none, are each returned with the hits of their own text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise
from .textbytes import slices

WINDOW = 13
#: Windows in one broadcast block on average: 13 references of 8 bytes and about 200 bytes of tables each, and their words once.
BLOCK_WINDOWS = 100_000
#: Words that are held at a time of a text above LONG_BYTES.
HELD_WORDS, LONG_BYTES = 1 << 17, 4 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only; in UTF-8 every byte of a code point from U+0080 on is at least 0x80."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Search:
    """Patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = defaultdict(list)
        for p, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), self.length - end)
            self.bucket[p[-self.block :]].append((list(p), items))

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(first word, items) of each occurrence, from left to right."""
        n, length, block, most, shift = len(words), self.length, self.block, self.most, self.shift.get
        end = length
        while end <= n:
            key = tuple(words[end - block : end])
            step = shift(key, most)
            if step:
                end += step
                continue
            for p, items in self.bucket[key]:
                if words[end - length : end] == p:
                    yield end - length, items
            end += 1


def windows_of(text: str | None, window: int) -> list[bytes]:
    """The distinct windows of an item, their words joined by spaces; all words where they are fewer."""
    words = words_of(text)
    return sorted({b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1) if words else 0)})


def searches_of(windows: Iterable[tuple[str, bytes]]) -> list[Search]:
    """A search for each length among windows (item, joined words)."""
    by_length: dict[int, dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
    names: dict[str, str] = {}
    known: dict[bytes, bytes] = {}
    for item, joined in windows:
        p = tuple(known.setdefault(w, w) for w in joined.split(b" "))
        by_length[len(p)][p].append(names.setdefault(item, item))
    return [Search({p: sorted({*of}) for p, of in found.items()}) for _, found in sorted(by_length.items())]


def scan_words(searches: list[Search], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """(word ranges under hits, joined where they touch; the items with occurring windows)"""
    found, items = [], set()
    for s in searches:
        for at, of in s.hits(words):
            found.append((at, at + s.length))
            items.update(of)
    return _joined(found), items


def _joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def scan_text(searches: list[Search], text: str | None, window: int) -> tuple[int, list[tuple[int, int]], set]:
    """(words, spans, items) of one text. A long one is scanned by pieces that overlap by a window less a word."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(raw) <= LONG_BYTES:
        words = WORD.findall(raw)
        return len(words), *(scan_words(searches, words) if words else ([], set()))
    found, items, words, base = [], set(), [], 0
    stream = (m[0] for m in WORD.finditer(raw))
    while more := list(islice(stream, HELD_WORDS)):
        overlap = min(window - 1, len(words))
        base += len(words) - overlap
        words = words[len(words) - overlap :] + more
        spans, of = scan_words(searches, words)
        found += [(base + a, base + b) for a, b in spans]
        items |= of
    return base + len(words), _joined(found), items


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """(id_col, n_words, spans, items) for every row of docs: the word ranges under a benchmark window (end exclusive)
    and the items, sorted as strings, whose windows occur. The windows of an item without an id hit words like others, but
    name no item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = windows_of(text, window)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.binary())], names=["item", "words"])

    windows = materialise(items.mapInArrow(cut, "item string, words binary").distinct(), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)) if blocks > 1 else F.lit(b"")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest.alias("digest"))
    schema = f"id {kind}, digest binary, n_words long, spans array<struct<start: bigint, end: bigint>>, items array<string>"

    def scanned(tables) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = tables.value if tables else []
            for whole in batches:
                for batch in slices(whole, "text"):
                    n, spans, named = [], [], []
                    for t in batch.column("text").to_pylist():
                        words, found, of = scan_text(searches, t, window)
                        n.append(words)
                        spans.append([{"start": a, "end": b} for a, b in found])
                        named.append(sorted(i for i in of if i is not None))
                    columns = [batch.column("id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(named, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "n_words", "spans", "items"])

        return rows.mapInArrow(scan, schema)

    def sent(block: int):
        own = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        return spark.sparkContext.broadcast(searches_of((r["item"], bytes(r["words"])) for r in own.toLocalIterator()))

    if blocks == 1:
        return scanned(sent(0)).select(F.col("id").alias(id_col), "n_words", "spans", "items")
    hits = None
    for block in range(blocks):
        tables = sent(block)
        own = materialise(scanned(tables).filter(F.size("spans") > 0).select("id", "digest", "spans", "items"), "hits")
        tables.unpersist()
        hits = own if hits is None else hits.unionAll(own)
    gathered = hits.groupBy("id", "digest").agg(
        _joined_spans(F.array_sort(F.flatten(F.collect_set("spans")))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("of"),
    )
    gathered = gathered.select(F.col("id").alias("hit_id"), F.col("digest").alias("hit_digest"), "found", "of")
    every = scanned(None).select("id", "digest", "n_words")
    out = every.join(gathered, every["id"].eqNullSafe(gathered["hit_id"]) & (every["digest"] == gathered["hit_digest"]), "left")
    nothing = lambda name: F.array().cast(gathered.schema[name].dataType)
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("found", nothing("found")).alias("spans"), F.coalesce("of", nothing("of")).alias("items"))


def _joined_spans(spans: F.Column) -> F.Column:
    """Sorted ranges, joined where they touch."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def step(done, x):
        last = F.element_at(done, -1)
        longer = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))),
        )
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), longer).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast(kind), step)


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    """At least a twentieth of the words is under a hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def words_hit(spans: F.Column) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
