"""Comparisons of reads drawn at random: one read a sample for pairs, two reads for a sample's own pair, and sums over
repeated draws.

A draw gives every read a hash. The read of the least hash is a random read; the reads of the least and of the largest
hash are a random pair of two different reads, in random order. Least and largest are aggregates that merge, so a site's
reads are combined before they are shuffled and are never sorted. Further draws are further hashes in the same
aggregation; their sums merge like those of any two sets of draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import pair_label, u01
from .observed import SITE

OUT = ("pair", "s0", "s1", "is_self", *SITE, "num", "den", "pwd", "q0", "q1")


def drawn_reads(obs: DataFrame, samples: DataFrame, seed: int, draws: int = 1, two: bool = False) -> DataFrame:
    """(chrom, pos, sample, name, n, first, second): arrays with the (base, phred) of each draw; ``second`` is null unless
    ``two`` reads are drawn without replacement. Only samples at their least depth (2 at least, if two are drawn) stay."""

    def read(pick, d: int) -> Column:
        stream = "read" if d == 0 else f"read{d}"
        u = u01(seed, stream, *(F.col(c) for c in (*SITE, "sample", "read_ix")))
        found = pick(F.struct(u.alias("u"), "read_ix", "base", "phred"))
        return F.struct(found["base"].alias("base"), found["phred"].alias("phred"))

    first = F.array(*(read(F.min, d) for d in range(draws)))
    second = F.array(*(read(F.max, d) for d in range(draws))) if two else F.lit(None).cast("array<struct<base:string,phred:int>>")
    kept = obs.join(F.broadcast(samples.select("sample")), "sample", "left_semi")
    each = kept.groupBy(*SITE, "sample").agg(F.count("*").alias("n"), first.alias("first"), second.alias("second"))
    least = F.greatest("min_depth", F.lit(2)) if two else F.col("min_depth")
    return each.join(F.broadcast(samples), "sample").filter(F.col("n") >= least).select(*SITE, "sample", "name", "n", "first", "second")


def _compared(a: Column, b: Column) -> list[Column]:
    """Mismatches, draws, their ratio and the mean qualities of two arrays of drawn reads."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: (x["base"] != y["base"]).cast("long")), F.lit(0).cast("long"), lambda t, v: t + v)
    mean = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda t, v: t + v["phred"]) / F.size(x)
    n = F.size(a).cast("long")
    return [differ.alias("num"), n.alias("den"), (differ / n).alias("pwd"), mean(a).alias("q0"), mean(b).alias("q1")]


def sampled_pairs(obs: DataFrame, samples: DataFrame, seed: int, draws: int = 1) -> DataFrame:
    """The columns of ``observed.pair_join`` from drawn reads: ``num`` of ``den`` draws differ."""
    one = drawn_reads(obs, samples, seed, draws)
    x, y = one.alias("x"), one.alias("y")
    both = x.join(y, [F.col("x.chrom") == F.col("y.chrom"), F.col("x.pos") == F.col("y.pos"), F.col("x.sample") < F.col("y.sample")])
    return both.select(
        pair_label(F.col("x.name"), F.col("y.name")).alias("pair"), F.col("x.sample").alias("s0"), F.col("y.sample").alias("s1"), F.lit(False).alias("is_self"),
        F.col("x.chrom"), F.col("x.pos"), *_compared(F.col("x.first"), F.col("y.first")),
    )


def sampled_self(obs: DataFrame, samples: DataFrame, seed: int, draws: int = 1) -> DataFrame:
    """The same for each sample against itself: two of its reads per draw, at a depth of 2 or more."""
    two = drawn_reads(obs, samples, seed, draws, two=True)
    return two.select(pair_label(F.col("name"), F.col("name")).alias("pair"), F.col("sample").alias("s0"), F.col("sample").alias("s1"), F.lit(True).alias("is_self"), *SITE, *_compared(F.col("first"), F.col("second")))


def merge_draws(*sites: DataFrame) -> DataFrame:
    """Sums of several sets of draws of the same pairs: a site that more than one has counts once, with all its draws. Sets
    may be added as they come; the order makes no difference."""
    every = sites[0].select(*OUT)
    for more in sites[1:]:
        every = every.unionByName(more.select(*OUT))
    num, den = F.sum("num"), F.sum("den")
    quality = lambda c: (F.sum(F.col(c) * F.col("den")) / den).alias(c)
    return every.groupBy("pair", "s0", "s1", "is_self", *SITE).agg(num.alias("num"), den.alias("den"), (num / den).alias("pwd"), quality("q0"), quality("q1")).select(*OUT)
