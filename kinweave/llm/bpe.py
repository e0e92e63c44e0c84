"""BPE encoding and decoding with a published word-end vocabulary.

Text is split at the special tokens, normalised (NFC, lower case) and cut into words; each word's bytes are symbols of
a doubly linked list, and a priority queue holds the merge ranks of neighbouring symbols. The lowest rank is merged
first, the leftmost of equal ones; entries whose symbols have since changed are skipped as stale. A word's result is
kept in a bounded cache, since words repeat. Decoding joins the vocabulary strings of the ids.

Each task loads the vocabulary file once; its path is a parameter (the file is part of an installed package, so it is
the same on every executor). One pass over the rows: no shuffle, and memory bounded by the cache and one batch.
A null or empty text has no tokens and decodes to an empty text.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import slices

#: Fixed value: the pattern that the vocabulary's own file names for cutting words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
BREAK = re.compile(r"[ \n]")
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"
#: Words that a task's cache holds at most, and characters of each: together about 100 MB. A full cache starts anew.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
#: A longer text is encoded in parts, cut before white space, which no word holds; ids are decoded as many at a time.
PART_CHARS = 1 << 20
BATCH_BYTES = 1 << 20


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ending: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*self.ids.values(), *self.special.values())
        self.strings = [""] * size
        for s, i in chain(self.ids.items(), self.special.items()):
            self.strings[i] = s
        #: (left id, right id) as one number -> (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.ids[a] << 32 | self.ids[b], (rank, self.ids[a + b]))
        symbols = byte_symbols()
        self.inner = [self.ids.get(s) for s in symbols]
        self.last = [self.ids.get(s + self.ending) for s in symbols]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words, self.ascii_words = regex.compile(WORDS), re.compile(ASCII_WORDS)
        self.parted = not any(BREAK.search(t) for t in self.special)
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if None in symbols:  # a byte that the vocabulary lacks gives no token
            symbols = [s for s in symbols if s is not None]
        n, get = len(symbols), self.merges.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := get(symbols[i] << 32 | symbols[i + 1]):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, left, right, merged = pop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: one of the two was merged meanwhile
            k = after[j]
            symbols[i], symbols[j], after[i] = merged, -1, k
            if k >= 0:
                before[k] = i
                if found := get(merged << 32 | symbols[k]):
                    push(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := get(symbols[h] << 32 | merged)):
                push(queue, (found[0], h, symbols[h], merged, found[1]))
        return tuple(s for s in symbols if s >= 0)

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self.word(word)
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = out
        return out

    def encode(self, text: str) -> array:
        """Ids as unsigned 32-bit integers."""
        out, at = array("I"), 0
        while len(text) - at > PART_CHARS and self.parted:
            cut = BREAK.search(text, at + PART_CHARS)
            if not cut:
                break
            out.extend(self._encode(text[at : cut.start()]))
            at = cut.start()
        out.extend(self._encode(text[at:] if at else text))
        return out

    def _encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if part.isascii():
                    words = self.ascii_words.findall(part.lower())
                else:
                    # The capital sigma is lowered without regard to its place in the word.
                    words = self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
                known = self.known
                try:
                    out.extend(chain.from_iterable([known[w] for w in words]))
                except KeyError:
                    missing = self.__missing__
                    got = known.get
                    out.extend(chain.from_iterable([got(w) or missing(w) for w in words]))
        return out

    def decode(self, ids) -> str:
        strings, ids = self.strings, np.asarray(ids, np.int64)
        return " ".join(" ".join([strings[i] for i in ids[a : a + PART_CHARS].tolist()]) for a in range(0, len(ids), PART_CHARS))


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker, kept while the worker lives."""
    return Vocabulary(path)


def bpe_encode(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(id_col, n_tokens, ids[, decoded]) for every row of docs. ``ids`` is binary: little-endian unsigned 32-bit
    integers (``unpack_ids`` gives an array). ``decoded`` adds the text that the ids decode to."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for whole in batches:
            for batch in slices(whole, text_col, BATCH_BYTES):
                ids = [np.frombuffer(v.encode(t or ""), np.uint32).astype("<u4") for t in batch.column(text_col).to_pylist()]
                columns = [batch.column(id_col), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if decoded:
                    columns.append(pa.array([v.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded
    return docs.select(id_col, text_col).mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the vocabulary strings of binary ids, joined. Null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in batches:
            texts = [v.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpack_ids(ids: pd.Series) -> pd.Series:
    """Binary ids as an array of integers."""
    return ids.map(lambda x: np.frombuffer(x or b"", "<u4").astype(np.int64))
