"""Observed side: filters on reads, per-site base counts, pairwise mismatch, pair summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import KNOWN, is_known, is_transition, pair_label, u01

SITE = ["chrom", "pos"]
BASES = (*KNOWN, "N", "*")
COUNTS = tuple(f"c{i}" for i in range(len(BASES)))


# Filters


def filter_chroms(df: DataFrame, chroms: Sequence[int] | DataFrame) -> DataFrame:
    """A list of chromosomes, or the table of a genome (a few dozen rows)."""
    if isinstance(chroms, DataFrame):
        return df.join(F.broadcast(chroms.select("chrom").distinct()), "chrom", "left_semi")
    return df.filter(F.col("chrom").isin(*chroms))


def filter_quality(obs: DataFrame, least: int = 30) -> DataFrame:
    return obs.filter(F.col("phred") >= least)


def semi_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows at a target. No broadcast hint: Spark picks one where the targets' size allows it."""
    return df.join(targets.select(*SITE), SITE, "left_semi")


def filter_known_variants(obs: DataFrame, targets: DataFrame) -> DataFrame:
    """Reads at a target that show its reference or alternate allele."""
    return obs.join(targets.select(*SITE, "ref", "alt"), SITE).filter(F.col("base").isin(F.col("ref"), F.col("alt"))).drop("ref", "alt")


def exclude_transitions(targets: DataFrame) -> DataFrame:
    """Fails where an allele is unknown, as its kind of change can't be told."""
    unknown = ~is_known(F.col("ref")) | ~is_known(F.col("alt"))
    checked = F.when(unknown, F.raise_error(F.lit("transitions can't be told for an unknown allele")).cast("boolean"))
    return targets.filter(~F.coalesce(checked, is_transition(F.col("ref"), F.col("alt"))))


def select_samples(obs: DataFrame, samples: DataFrame) -> DataFrame:
    """Reads of the chosen samples only. samples: (sample, name, min_depth), one row for each sample of interest."""
    return obs.join(F.broadcast(samples.select("sample")), "sample", "left_semi")


def sample_table(obs: DataFrame, indices: Sequence[int], names: Sequence[str] = (), min_depth: Sequence[int] = (1,)) -> DataFrame:
    """(sample, name, min_depth). Short depth lists are used over and over; fails where a sample has no column."""
    spark = obs.sparkSession
    rows = [(s, names[i] if i < len(names) else f"Ind{s}", min_depth[i % len(min_depth)]) for i, s in enumerate(indices)]
    wanted = spark.createDataFrame(rows, "sample int, name string, min_depth int")
    there = obs.select("sample").distinct().withColumn("there", F.lit(True))
    absent = F.raise_error(F.concat(F.lit("no such sample: "), F.col("sample"))).cast("int")
    return wanted.join(there, "sample", "left").select("sample", "name", F.when(F.col("there"), F.col("min_depth")).otherwise(absent).alias("min_depth"))


def filter_depth(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Site counts with at least the sample's depth, judged after all read filters."""
    return counts.join(F.broadcast(samples), "sample").filter("n >= min_depth")


# Aggregates


def site_counts(obs: DataFrame) -> DataFrame:
    """(chrom, pos, sample, n, q, c0..c5): reads, mean quality, and reads of each base, per site and sample."""
    counted = (F.count_if(F.col("base") == b).alias(c) for b, c in zip(BASES, COUNTS, strict=True))
    return obs.groupBy(*SITE, "sample").agg(F.count("*").alias("n"), F.avg("phred").alias("q"), *counted)


def _mismatch(a: str, b: str) -> tuple[Column, Column]:
    den = F.col(f"{a}.n") * F.col(f"{b}.n")
    same = sum((F.col(f"{a}.{c}") * F.col(f"{b}.{c}") for c in COUNTS[1:]), F.col(f"{a}.{COUNTS[0]}") * F.col(f"{b}.{COUNTS[0]}"))
    return den - same, den


def pair_join(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Per site the expected mismatch of every two samples: (pair, s0, s1, is_self, chrom, pos, num, den, pwd, q0, q1).

    The join's key is the site, so a site meets its samples only; it reuses the partitioning of the counts."""
    kept = filter_depth(counts, samples)
    num, den = _mismatch("x", "y")
    both = kept.alias("x").join(kept.alias("y"), [F.col("x.chrom") == F.col("y.chrom"), F.col("x.pos") == F.col("y.pos"), F.col("x.sample") < F.col("y.sample")])
    return both.select(
        pair_label(F.col("x.name"), F.col("y.name")).alias("pair"), F.col("x.sample").alias("s0"), F.col("y.sample").alias("s1"), F.lit(False).alias("is_self"),
        F.col("x.chrom"), F.col("x.pos"), num.alias("num"), den.alias("den"), (num / den).alias("pwd"), F.col("x.q").alias("q0"), F.col("y.q").alias("q1"),
    )


def pair_arrays(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """The same rows as ``pair_join`` from one array of samples per site: one aggregation instead of a self-join, for
    many samples at a site."""
    kept = filter_depth(counts, samples)
    cell = F.struct("sample", "name", "n", "q", *COUNTS)
    sites = kept.groupBy(*SITE).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    pairs = F.flatten(F.transform("cells", lambda x, i: F.transform(F.slice("cells", i + 2, F.size("cells")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    spread = sites.select(*SITE, F.explode(pairs).alias("p")).select(*SITE, "p.x", "p.y")
    num, den = _mismatch("x", "y")
    return spread.select(
        pair_label(F.col("x.name"), F.col("y.name")).alias("pair"), F.col("x.sample").alias("s0"), F.col("y.sample").alias("s1"), F.lit(False).alias("is_self"),
        *SITE, num.alias("num"), den.alias("den"), (num / den).alias("pwd"), F.col("x.q").alias("q0"), F.col("y.q").alias("q1"),
    )


def self_mismatch(obs: DataFrame, samples: DataFrame) -> DataFrame:
    """Mismatch over all two reads of a sample at a site, at depth 2 or more. obs has ``read_ix``: q0 is the mean
    quality of the earlier read of a pair, q1 of the later one."""
    at = F.row_number().over(W.partitionBy(*SITE, "sample").orderBy("read_ix")) - 1
    same = sum((F.count_if(F.col("base") == b) * (F.count_if(F.col("base") == b) - 1) for b in BASES[1:]), F.count_if(F.col("base") == BASES[0]) * (F.count_if(F.col("base") == BASES[0]) - 1))
    n = F.count("*")
    counted = obs.withColumn("i", at).groupBy(*SITE, "sample").agg(
        n.alias("n"), (n * (n - 1) / 2).cast("long").alias("den"), ((n * (n - 1) - same) / 2).cast("long").alias("num"),
        F.sum(F.col("phred") * F.col("i")).alias("late"), F.sum("phred").alias("total"),
    )
    kept = counted.join(F.broadcast(samples), "sample").filter(F.col("n") >= F.greatest(F.col("min_depth"), F.lit(2)))
    early = F.col("total") * (F.col("n") - 1) - F.col("late")
    return kept.select(
        pair_label(F.col("name"), F.col("name")).alias("pair"), F.col("sample").alias("s0"), F.col("sample").alias("s1"), F.lit(True).alias("is_self"),
        *SITE, "num", "den", (F.col("num") / F.col("den")).alias("pwd"), (early / F.col("den")).alias("q0"), (F.col("late") / F.col("den")).alias("q1"),
    )


def pair_sites(obs: DataFrame, samples: DataFrame, self_comparison: bool = False) -> DataFrame:
    """All pairs of samples, with each sample's own pair on request."""
    out = pair_join(site_counts(obs), samples)
    return out.unionByName(self_mismatch(obs, samples)) if self_comparison else out


def first_per_site(sites: DataFrame, order: str) -> DataFrame:
    """Of several lines with a pair's coordinate the first one counts."""
    columns = [c for c in sites.columns if c not in ("pair", *SITE, order)]
    first = sites.groupBy("pair", *SITE).agg(F.min_by(F.struct(*columns), order).alias("__first"))
    return first.select("pair", *SITE, "__first.*")


def summary_columns() -> list[Column]:
    """Overlap, sum and mean of the mismatch, mean quality, deviation and 95 % interval (NaN for a single site), from
    aggregates that merge in one pass."""
    sd = F.coalesce(F.stddev_samp("pwd"), F.lit(float("nan")))
    return [
        F.count("*").alias("overlap"), F.sum("pwd").alias("sum_pwd"), F.avg("pwd").alias("avg_pwd"), F.pow(sd, F.lit(2)).alias("variance"),
        (1.96 * sd / F.sqrt(F.count("*"))).alias("ci95"), F.avg((F.col("q0") + F.col("q1")) / 2).alias("avg_phred"),
    ]


def pair_summary(sites: DataFrame) -> DataFrame:
    return sites.groupBy("pair").agg(*summary_columns())


def comparable_sites(sites: DataFrame) -> DataFrame:
    """(chrom, pos, n_pairs): sites where at least one pair can be compared."""
    return sites.groupBy(*SITE).agg(F.count("*").alias("n_pairs"))


def filter_sites(pileup: DataFrame, sites: DataFrame) -> DataFrame:
    """Pileup lines where a comparison is possible, once each, with the number of pairs."""
    return pileup.join(comparable_sites(sites), SITE)
