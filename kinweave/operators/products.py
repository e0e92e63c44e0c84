"""Mismatch of all pairs of samples as matrix products: no row for a pair's site is ever made.

At a site a sample is a vector of base shares f, and the expected mismatch of two samples is 1 - f.g. Over a chunk of
sites these vectors stand side by side in one matrix a sample; its product with itself holds the sum of f.g for every
pair at once. Products of the presence flags count common sites, those of the vectors of second powers give the sums of
(f.g)^2, those of presence and quality the sums of qualities. So the counts, sums and squares that a summary needs come
from four products a chunk, and a task hands on one row a pair (and block) instead of one a pair and site.

Reads are shuffled once, by stretches of the genome that lie within one block, and counted where they arrive. A site's
samples meet in one chunk; a task holds a chunk's matrices and four numbers a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import block_start, pair_label
from .blocks import SIZE, block_grid
from .observed import BASES

#: Bases of a stretch; cells (samples x sites) of a chunk's matrices.
STRETCH, CHUNK_CELLS = 100_000, 1 << 16
SUMS = ("overlap", "sum_pwd", "sum_squares", "sum_phred")


class PairSums:
    """The running sums of one block for every pair of m samples, the later of a pair in the column."""

    def __init__(self, samples: int, own_pairs: bool):
        self.m, self.own = samples, own_pairs
        self.sums = np.zeros((4, samples, samples))

    def add(self, site: np.ndarray, sample: np.ndarray, n: np.ndarray, q: np.ndarray, counts: np.ndarray) -> None:
        """Rows of whole sites: numbers of site and sample, reads, mean quality, and reads by base."""
        m, bases = self.m, counts.shape[1]
        upper = np.triu(np.ones((m, m), bool), 1)
        first = 0
        most = max(1, CHUNK_CELLS // m)
        while first < len(site):
            last = int(np.searchsorted(site, site[first] + most))
            at, who = site[first:last] - site[first], sample[first:last]
            sites = int(at[-1]) + 1
            share = counts[first:last] / n[first:last, None]
            there, quality = np.zeros((m, sites)), np.zeros((m, sites))
            there[who, at], quality[who, at] = 1, q[first:last]
            shares, powers = np.zeros((m, sites, bases)), np.zeros((m, sites, bases * (bases + 1) // 2))
            shares[who, at] = share
            i, j = np.triu_indices(bases)  # (f.g)^2 is a product of the second powers, mixed ones twice
            powers[who, at] = share[:, i] * share[:, j] * np.where(i == j, 1, np.sqrt(2))
            shares, powers = shares.reshape(m, -1), powers.reshape(m, -1)
            common, same, squares = there @ there.T, shares @ shares.T, powers @ powers.T
            phred = quality @ there.T
            found = np.stack([common, common - same, common - 2 * same + squares, (phred + phred.T) / 2])
            self.sums += np.where(upper, found, 0)
            if self.own:
                self._add_own(who, n[first:last], q[first:last], counts[first:last])
            first = last

    def _add_own(self, who: np.ndarray, n: np.ndarray, q: np.ndarray, counts: np.ndarray) -> None:
        """A sample against itself: all two reads of a site, from depth 2 on."""
        deep = n > 1
        who, n, q, counts = who[deep], n[deep], q[deep], counts[deep]
        pwd = 1 - (counts * (counts - 1)).sum(1) / (n * (n - 1))
        for k, values in enumerate((np.ones(len(n)), pwd, pwd * pwd, q)):
            self.sums[k, range(self.m), range(self.m)] += np.bincount(who, values, self.m)


def pair_products(obs: DataFrame, samples: DataFrame, genome: DataFrame | None = None, size: int = SIZE, self_comparison: bool = False) -> DataFrame:
    """(pair, s0, s1, [chrom, start,] overlap, sum_pwd, sum_squares, sum_phred): sums over the sites where both samples
    have their least depth, per pair, or with a genome per pair and block. ``samples``: (sample, name, min_depth), one row
    each; ``self_comparison`` adds each sample's own pair. A table without reads gives no rows. Sites that lie in no block of
    the genome are summed with ``start`` null."""
    chosen = sorted((r["sample"], r["min_depth"]) for r in samples.collect()) or [(-1, 0)]
    known = np.array([s for s, _ in chosen], np.int64)
    depth = np.array([d for _, d in chosen], np.int64)
    by_block = genome is not None
    placed = obs.withColumn("stretch", F.floor(F.col("pos") / min(STRETCH, size)))
    if not by_block:
        placed = placed.withColumn("start", F.lit(0).cast("long"))
    else:
        placed = placed.join(F.broadcast(genome.select("chrom", "length")), "chrom", "left").withColumn("start", F.coalesce(block_start(F.col("pos"), F.col("length"), size), F.lit(0).cast("long")))
    keys = ["chrom", "start", "stretch"] if by_block else ["chrom", "stretch"]
    code = F.instr(F.lit("".join(BASES)), F.col("base")) - 1
    ordered = placed.repartition(*keys).sortWithinPartitions(*keys, "pos")
    ordered = ordered.select("chrom", "start", "pos", "sample", code.alias("code"), "phred")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s0", "s1", "chrom", "start", *SUMS]
        totals: dict[tuple[int, int], PairSums] = {}
        held: list[np.ndarray] | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            for (chrom, start), found in totals.items():
                i, j = np.nonzero(found.sums[0])
                columns = [known[i], known[j], np.full(len(i), chrom), np.full(len(i), start), found.sums[0, i, j].astype(np.int64), *found.sums[1:, i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            totals.clear()

        def take(rows: list[np.ndarray]) -> None:
            m, width = len(known), len(BASES) + 1
            at = np.minimum(np.searchsorted(known, rows[3]), m - 1)
            kept = known[at] == rows[3]
            at, (chrom, start, pos, _, code, phred) = at[kept], (c[kept] for c in rows)
            if not len(chrom):
                return
            block = np.flatnonzero((np.diff(chrom, prepend=-1) != 0) | (np.diff(start, prepend=-1) != 0))
            for a, b in zip(block, [*block[1:], len(chrom)], strict=True):
                site = np.cumsum(np.diff(pos[a:b], prepend=-1) != 0) - 1
                cell, of = np.unique(site * m + at[a:b], return_inverse=True)
                n = np.bincount(of)
                quality = np.bincount(of, phred[a:b]) / n
                counts = np.bincount(of * width + np.where(code[a:b] < 0, width - 1, code[a:b]), minlength=len(n) * width).reshape(-1, width)[:, :-1]
                deep = n >= depth[cell % m]
                if deep.any():
                    sums = totals.setdefault((int(chrom[a]) if by_block else 0, int(start[a])), PairSums(m, self_comparison))
                    sums.add((cell // m)[deep], (cell % m)[deep], n[deep], quality[deep], counts[deep].astype(float))

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            ends = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[2] != rows[2][-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last site may go on in the next batch
            held = [c[cut:] for c in rows]
            if cut:
                take([c[:cut] for c in rows])
            if by_block and len(totals) > 16:
                yield from flush()
        if held is not None:
            take(held)
        yield from flush()

    schema = "s0 long, s1 long, chrom long, start long, overlap long, sum_pwd double, sum_squares double, sum_phred double"
    by = ["s0", "s1"] + ["chrom", "start"] * by_block
    merged = ordered.mapInArrow(multiply, schema).groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))
    name = lambda side: F.broadcast(samples.select(F.col("sample").alias(f"s{side}"), F.col("name").alias(f"name{side}")))
    named = merged.join(name(0), "s0").join(name(1), "s1")
    kind = dict(obs.dtypes)["sample"]
    out = [pair_label(F.col("name0"), F.col("name1")).alias("pair"), *(F.col(c).cast(kind).alias(c) for c in ("s0", "s1"))]
    return named.select(*out, *([F.col("chrom").cast(dict(obs.dtypes)["chrom"]).alias("chrom"), F.nullif("start", F.lit(0)).alias("start")] if by_block else []), *SUMS)


def product_summary(products: DataFrame) -> DataFrame:
    """The columns of ``observed.pair_summary`` of pair products without blocks."""
    n, total = F.col("overlap"), F.col("sum_pwd")
    variance = F.when(n > 1, F.greatest((F.col("sum_squares") - total * total / n) / (n - 1), F.lit(0.0))).otherwise(F.lit(float("nan")))
    return products.select("pair", n, total, (total / n).alias("avg_pwd"), variance.alias("variance"), (1.96 * F.sqrt(variance) / F.sqrt(n)).alias("ci95"), (F.col("sum_phred") / n).alias("avg_phred"))


def product_blocks(products: DataFrame, genome: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``blocks.block_summary`` of pair products by block: every pair and block of the grid."""
    pairs = products.select("pair").distinct()
    grid = pairs.join(F.broadcast(block_grid(genome, size)), F.lit(True))
    joined = grid.join(products.select("pair", "chrom", "start", "overlap", "sum_pwd"), ["pair", "chrom", "start"], "left")
    zero = F.coalesce("overlap", F.lit(0).cast("long")).alias("sites")
    return joined.select("pair", "chrom", "start", "end", zero, F.coalesce("sum_pwd", F.lit(0.0)).alias("pwd"))
