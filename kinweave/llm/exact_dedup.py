"""Exact dedup: sorted runs of text digests, merged in binomial exchange rounds.

Every input partition belongs to a leaf, which holds one sorted run of digests. In round r, leaf p exchanges with the
leaf that differs from p in bit r only: each row goes to the one of the two whose bit r is that of the digest's own
bucket. What a leaf keeps and what it receives are two sorted runs; they are merged, and of equal digests only the kept
identifier and the count go on. After log2(leaves) rounds every digest has met all its copies in the leaf of its bucket.
A text with any number of copies sends at most one row per leaf and round; the number of leaves follows the rows, so
that a run, the most that a task holds, has about ``RUN_ROWS`` rows; and neither the driver nor a task ever holds all
digests. With ``fan_in`` above 2 a round exchanges digits to that base instead of bits and merges as many runs.

Two texts count as equal when SHA-256 and a second, independent 64-bit hash agree; both travel with every run and are
compared at every merge. A null text is an empty one. Rows that repeat an id and a text are each returned and judged by
the id; a null id stays only where its whole group has null ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, shuffle_partitions

RUN = "node int, digest binary, twin long, keep long, known boolean, n long"
#: Rows of a leaf's run on average, and leaves at least (as far as the session has partitions).
RUN_ROWS, LEAST_LEAVES = 200_000, 16


def _order(digests: pa.Array, twin: np.ndarray) -> np.ndarray:
    """Rows by digest and twin. The stable sort is a merge: it finds the sorted runs of which the rows consist."""
    words = np.frombuffer(digests.cast(pa.binary(32)).buffers()[1], ">u8")[4 * digests.offset :][: 4 * len(digests)].reshape(-1, 4)
    order = np.argsort(words[:, 0].astype(np.uint64), kind="stable")
    first = words[order, 0]
    tied = first[1:] == first[:-1]
    if (words[order][1:][tied] != words[order][:-1][tied]).any() or (twin[order][1:][tied] != twin[order][:-1][tied]).any():
        order = np.lexsort((twin, *(words[:, k].astype(np.uint64) for k in (3, 2, 1, 0))))
    return order


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A leaf's runs in, one sorted run out: a row per (digest, twin) with the largest ``keep``, whether it is of
    a row with an id, and the summed ``n``."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    order = _order(rows.column("digest"), rows.column("twin").to_numpy())
    rows = rows.take(pa.array(order))
    digest, twin = rows.column("digest"), rows.column("twin").to_numpy()
    new = np.ones(len(order), bool)
    new[1:] = pc.not_equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False) | (twin[1:] != twin[:-1])
    first = np.flatnonzero(new)
    keep = np.maximum.reduceat(rows.column("keep").to_numpy(), first)
    known = np.logical_or.reduceat(rows.column("known").to_numpy(zero_copy_only=False), first)
    n = np.add.reduceat(rows.column("n").to_numpy(), first)
    at = pa.array(first)
    out = pa.RecordBatch.from_arrays([rows.column("node").take(at), digest.take(at), pa.array(twin[first]), pa.array(keep), pa.array(known), pa.array(n)], names=rows.schema.names)
    for i in range(0, out.num_rows, 1 << 14):
        yield out.slice(i, 1 << 14)


def tree_shape(partitions: int, fan_in: int = 2) -> tuple[int, int]:
    """(fan, rounds) with fan <= fan_in and fan ** rounds at least ``partitions``, as near to it as can be."""
    rounds = max(1, math.ceil(math.log(max(2, partitions)) / math.log(fan_in) - 1e-9))
    fan = max(2, math.ceil(round(max(2, partitions) ** (1 / rounds), 9)))
    return fan, rounds


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 2, run_rows: int = RUN_ROWS
) -> DataFrame:
    """(id_col, keep_id, group_size, kept, digest) for every row of docs; ``keep`` is 'largest' or 'smallest' id.

    Ids are integers. An empty table gives an empty result; other columns of docs are neither read nor clash."""
    largest = {"largest": True, "smallest": False}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            F.xxhash64(text).alias("twin"),
            F.spark_partition_id().alias("part"),
        ),
        "digests",
    )
    leaves_wanted = max(min(LEAST_LEAVES, shuffle_partitions(docs.sparkSession)), math.ceil(prints.count() / run_rows))
    fan, rounds = tree_shape(leaves_wanted, fan_in)
    nodes = fan**rounds
    prints = prints.withColumn("leaf", F.pmod(F.col("part"), F.lit(nodes)).cast("int")).drop("part")
    # The complement turns the order around for every id; an id may be any long, so whether there is one goes along.
    turned = lambda c: c if largest else F.bitwise_not(c)
    ranked = F.coalesce(turned(F.col("id")), F.lit(-(2**63)))
    runs = prints.select(
        F.col("leaf").alias("node"), "digest", "twin", ranked.alias("keep"), F.col("id").isNotNull().alias("known"), F.lit(1).cast("long").alias("n")
    )

    def exchange(df: DataFrame) -> DataFrame:
        return df.repartitionById(nodes, F.col("node")).mapInArrow(_merge, RUN)

    leaves = exchange(runs)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(nodes)).cast("int")
    merged = leaves
    for r in range(rounds):
        step = fan**r
        digit = lambda c: F.pmod(F.floor(c / step), F.lit(fan))
        node = F.col("node") + (digit(bucket) - digit(F.col("node"))) * step
        merged = exchange(merged.withColumn("node", node.cast("int")))
    # Back down: a digest's answer goes once to each leaf that holds it, then to the rows of that leaf.
    answers = leaves.select(F.col("node").alias("leaf"), "digest", "twin").join(
        merged.select("digest", "twin", "keep", "known", "n"), ["digest", "twin"]
    )
    kept = F.when(F.col("known"), turned(F.col("keep")))
    return prints.join(answers, ["leaf", "digest", "twin"]).select(
        F.col("id").alias(id_col),
        kept.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(kept).alias("kept"),
        "digest",
    )
