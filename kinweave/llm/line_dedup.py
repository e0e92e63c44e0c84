"""Line dedup: a sharded minimal perfect hash over all distinct line hashes, probed by the documents.

Lines are known by the 128-bit MD5 of their key. One aggregation counts the documents of each distinct line hash and
finds the document that would keep the line. All of them are dealt to shards by hash. Each shard builds a minimal
perfect hash (levels of bit arrays: a key that is alone at its position of a level gets the rank of that bit) that
indexes three compact arrays: fingerprint, count, keeping document. Documents send only (id, text hash, line hash) to
the shard of each hash and probe the arrays there: the fingerprint tells whether the line is known, the count whether it
is frequent. Lines and texts are not joined with lines. A shard with hot lines is replicated in proportion to the number
of its probes, known from the counts, so that a line that a third of all documents hold is probed in many tasks.

A null or empty text is one empty line. Rows count as documents: rows that repeat an id count each, and the line stays
in every row with the largest id. Null ids count as documents but never keep a line that another one holds; what is
found for a row goes back to it by id and text hash, so that rows without an id share nothing. Rows of one batch that
agree in id and text probe once, with their number, so that no replica gets a row for each of many such rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import materialise
from .textbytes import mix, slices

STRIPPED = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys in a shard, and probes of one replica of it, at most on average.
SHARD_KEYS, SHARD_PROBES = 50_000, 100_000
#: Stands for no id where arrays need a number; whether there is one is told apart.
NO_ID = -(2**63)


def line_hash(line: str, least: int) -> bytes | None:
    key = line.strip(STRIPPED)
    return hashlib.md5(key.encode("utf-8", "surrogatepass").lower(), usedforsecurity=False).digest() if len(key) >= least else None


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit keys, as levels of bit arrays with twice as many bits as keys left."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.starts = words, np.concatenate([[0], np.cumsum(sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1], 2 * level), 2 * level + 1) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words of all levels, words per level)"""
        levels = []
        while len(keys):
            words = max(1, -(-2 * len(keys) // 64))
            at = cls.place(keys, len(levels), words)
            alone = np.bincount(at, minlength=64 * words)[at] == 1
            bits = np.zeros(64 * words, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
            keys = keys[~alone]
        return np.concatenate(levels) if levels else np.zeros(0, np.uint64), np.array([len(x) for x in levels], np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """A number below the key count, its own for every built key; -1 or any number for other keys."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(len(self.starts) - 1):
            first = self.starts[level]
            at = self.place(keys[open_], level, int(self.starts[level + 1] - first))
            word, bit = first + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.ranks[word] + below)[hit]
            open_ = open_[~hit]
        return out


def _pairs(hashes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """16-byte binaries as pairs of integers."""
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    return np.frombuffer(hashes.cast(pa.binary(16)).buffers()[1], np.uint64)[2 * hashes.offset :][: 2 * len(hashes)].reshape(-1, 2)


ARRAYS = ("words", "sizes", "prints", "counts", "keepers")
SHARD = "shard int, replica int, " + ", ".join(f"{a} binary" for a in ARRAYS)


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    """One row: the perfect hash of the shard's keys and the arrays that it indexes."""
    pairs = _pairs(table.column("hash"))
    words, sizes = PerfectHash.build(pairs)
    at = PerfectHash(words, sizes).index(pairs)
    arrays = [np.empty(len(at), t) for t in (np.uint64, np.int32, np.int64)]
    keeper = table.column("keeper").combine_chunks()
    # A count is negative where no document with the line has an id.
    counts = np.minimum(table.column("n").to_numpy(), np.iinfo(np.int32).max) * np.where(keeper.is_valid().to_numpy(zero_copy_only=False), 1, -1)
    for array, values in zip(arrays, (pairs[:, 1], counts, keeper.fill_null(NO_ID).to_numpy()), strict=True):
        array[at] = values
    row = [[key[0].as_py()], [0], *([x.tobytes()] for x in (words, sizes, *arrays))]
    return pa.table([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), *(pa.array(x, pa.binary()) for x in row[2:])], names=[f.split()[0] for f in SHARD.split(", ")])


def _probe(probes: pa.Table, shard: pa.Table, least_docs: int) -> pa.Table:
    """The (id, t, hash) whose line is in ``least_docs`` documents and kept by another one."""
    names = ["id", "t", "hash"]
    if not probes.num_rows or not shard.num_rows:
        return probes.select(names).slice(0, 0)
    kinds = (("words", np.uint64), ("sizes", np.int64), ("prints", np.uint64), ("counts", np.int32), ("keepers", np.int64))
    words, sizes, prints, counts, keepers = (np.frombuffer(shard.column(c)[0].as_py(), t) for c, t in kinds)
    pairs = _pairs(probes.column("hash"))
    at = PerfectHash(words, sizes).index(pairs)
    ids = probes.column("id").combine_chunks()
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    keeps = (keepers[at] == ids.fill_null(NO_ID).to_numpy()) & (named == (counts[at] > 0))
    drop = (at >= 0) & (prints[at] == pairs[:, 1]) & (np.abs(counts[at]) >= least_docs) & ~keeps
    return probes.select(names).filter(pa.array(drop))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """(id_col, n_lines, n_dropped, text) for every row of docs: lines before dropping, lines dropped, what stays.
    Ids are integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                at, found, rows_ = [], [], []
                same = list(zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), strict=True))
                times = Counter(same)
                for i, (own_key, t) in enumerate(zip(same, batch.column("text").to_pylist(), strict=True)):
                    if c := times.pop(own_key, 0):
                        own = {h for line in (t or "").split("\n") if (h := line_hash(line, least_chars))}
                        at += [i] * len(own)
                        found += own
                        rows_ += [c] * len(own)
                which = pa.array(at, pa.int64())
                columns = [batch.column("id").take(which), batch.column("t").take(which), pa.array(found, pa.binary()), pa.array(rows_, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "t", "hash", "c"])

    lines = rows.mapInArrow(hashed, "id long, t long, hash binary, c long")
    seen = Observation()
    counted = lines.groupBy("hash").agg(F.sum("c").alias("n"), F.max("id").alias("keeper"))
    distinct = materialise(counted.observe(seen, F.sum("n").alias("probes"), F.count("*").alias("keys")), "lines")
    shards = max(1, math.ceil(seen.get["keys"] / SHARD_KEYS), math.ceil((seen.get["probes"] or 0) / SHARD_PROBES))
    shard_of = F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int")
    dealt = distinct.withColumn("shard", shard_of)
    # A row for each shard that needs more than one replica. No hint: Spark broadcasts it where its size allows that.
    loads = dealt.groupBy("shard").agg(F.ceil(F.sum("n") / SHARD_PROBES).cast("int").alias("replicas")).filter("replicas > 1")
    loads = materialise(loads, "loads")
    hot = loads.limit(1).count() > 0
    replicated = lambda df: df.join(loads, "shard", "left").fillna(1, "replicas") if hot else df.withColumn("replicas", F.lit(1))
    arrays = replicated(dealt.groupBy("shard").applyInArrow(_build_shard, SHARD).drop("replica"))
    arrays = arrays.select("shard", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1)).alias("replica"), *ARRAYS)
    probes = replicated(lines.drop("c").withColumn("shard", shard_of)).withColumn("replica", F.pmod(F.xxhash64("id", "t"), F.col("replicas")).cast("int"))
    probes = probes.select("id", "t", "hash", "shard", "replica")
    together = probes.groupBy("shard", "replica").cogroup(arrays.groupBy("shard", "replica"))
    found = together.applyInArrow(lambda mine, shard: _probe(mine, shard, least_docs), "id long, t long, hash binary")
    drops = found.groupBy("id", "t").agg(F.collect_set("hash").alias("drops")).select(F.col("id").alias("drop_id"), F.col("t").alias("drop_t"), "drops")
    own = rows["id"].eqNullSafe(F.col("drop_id")) & (rows["t"] == F.col("drop_t"))
    joined = rows.join(drops, own, "left").select("id", "text", "drops")

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                before, gone, texts = [], [], []
                for t, d in zip(batch.column("text").to_pylist(), batch.column("drops"), strict=True):
                    all_lines = (t or "").split("\n")
                    kept = all_lines
                    if d.is_valid:
                        own = set(d.as_py())
                        kept = [x for x in all_lines if line_hash(x, least_chars) not in own]
                    before.append(len(all_lines))
                    gone.append(len(all_lines) - len(kept))
                    texts.append("\n".join(kept))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(before, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_lines", "n_dropped", "text"])

    return joined.mapInArrow(dropped, "id long, n_lines long, n_dropped long, text string").withColumnRenamed("id", id_col)
