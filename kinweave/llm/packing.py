"""Packing of documents into sequences of a bounded number of tokens.

A document is its token ids and a closing id; only documents longer than a sequence are cut, into pieces of a whole
sequence and a shorter last one. The histogram of piece lengths, which has at most ``capacity`` entries, goes to the
driver, where :mod:`.pack_plan` solves the configuration linear program and rounds it. Pieces then find their places
without a sort or a window over pieces: a piece is numbered among those of its length within the task that encoded it,
the counts by task and length are summed up per length, and the number among all pieces of that length says which use of
which configuration holds it. A length that most pieces have is thus one sum a task, not one group of rows.

Every row of documents is packed on its own, also where ids repeat or are null. A null or empty text is the closing id
alone, one piece of length 1. An empty table gives no pieces. Ids are encoded once; other columns don't pass through,
so their names are free. Pieces are written below the shared folder, so a lost executor changes no number."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunk_tokens import chunk_encoder
from .pack_plan import Plan, pack_plan
from .shared import materialise
from .textbytes import slices

#: Bytes of text encoded at a time; a longer text is one batch.
BATCH_BYTES = 4 << 20
#: Bits of a number among the pieces of one length.
NUMBER_BITS = 44


def cut_pieces(docs: DataFrame, vocabulary_path: str, capacity: int, closing: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids], task, number): a row for every piece. ``number`` counts the
    pieces of one length within one ``task``."""
    end = np.array([closing], "<u4").tobytes()
    whole = capacity * 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, encoder = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), chunk_encoder(vocabulary_path)
        gc.disable()  # nothing here makes cycles, and the collector would walk the pieces of every text
        try:
            for batch in batches:
                for part in slices(batch, text_col, BATCH_BYTES):
                    rows, starts, lengths, crcs, numbers, ids = [], [], [], [], [], []
                    for i, tokens in enumerate(encoder.encode(part.column(text_col).to_pylist())):
                        tokens += end
                        for at in range(0, len(tokens), whole):
                            own = tokens[at : at + whole]
                            rows.append(i)
                            starts.append(at // 4)
                            lengths.append(n := len(own) // 4)
                            crcs.append(zlib.crc32(own))
                            numbers.append(seen[n])
                            seen[n] += 1
                            if with_ids:
                                ids.append(own)
                    starts = np.array(starts, np.int64)
                    columns = [part.column(id_col).take(pa.array(rows, pa.int64())), pa.array((starts // capacity).astype(np.int32)), pa.array(starts)]
                    columns += [pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                    columns += [pa.array(ids, pa.binary())] * with_ids
                    columns += [pa.array([task] * len(rows), pa.int64()), pa.array(np.array(numbers, np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "task", "number"])
        finally:
            gc.enable()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' * with_ids}task long, number long"
    return docs.select(id_col, text_col).mapInArrow(encode, schema).withColumnRenamed("id", id_col)


class Places:
    """Where the pieces of a plan go: for each length, ranges of numbers by configuration."""

    def __init__(self, plan: Plan):
        first, taken = 0, {}
        rows = []
        for uses, config in plan.configurations:
            offset = 0
            for length, n in config:
                start = taken.get(length, 0)
                rows.append((length << NUMBER_BITS | start, start, n, first, offset, length))
                taken[length] = start + uses * n
                offset += length * n
            first += uses
        rows.sort()
        self.keys, self.starts, self.each, self.firsts, self.offsets, self.lengths = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [()] * 6))

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by their numbers among all of their length."""
        at = np.searchsorted(self.keys, length << NUMBER_BITS | number, side="right") - 1
        within = number - self.starts[at]
        return self.firsts[at] + within // self.each[at], self.offsets[at] + within % self.each[at] * length


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 4096, closing: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece with its sequence and its
    place there. Sequences are filled without gaps from 0. The plan that tasks get has a row for each length of a
    configuration, whose number is bounded by the capacity, not by the documents."""
    pieces = materialise(cut_pieces(docs, vocabulary_path, capacity, closing, id_col, text_col, with_ids), "pieces")
    by_task = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(pack_plan(histogram, capacity))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    firsts = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = pieces.join(firsts, ["length", "task"]).withColumn("number", F.col("before") + F.col("number"))
    out = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            columns = [batch.column(i) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["id", *out[1:], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' * with_ids}sequence_id long, offset long"
    return numbered.select(*out, "number").mapInArrow(place, schema).withColumnRenamed("id", id_col)
