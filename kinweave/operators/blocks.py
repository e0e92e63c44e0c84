"""Genome blocks: the block grid, per-block sums and the delete-m jackknife."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import block_start

SIZE = 1_000_000


def block_grid(genome: DataFrame, size: int = SIZE) -> DataFrame:
    """(chrom, start, end) of every block of every chromosome, empty ones as well; ends are exclusive, the last one is
    the chromosome's length."""
    starts = F.sequence(F.lit(1).cast("long"), F.col("length"), F.lit(size).cast("long"))
    kept = F.when((F.size(starts) > 1) & (F.col("length") % size == 1), F.slice(starts, 1, F.size(starts) - 1)).otherwise(starts)
    spread = genome.select("chrom", "length", F.explode(kept).alias("start"))
    return spread.select("chrom", "start", F.least(F.col("start") + size, "length").alias("end"))


def block_summary(sites: DataFrame, genome: DataFrame, size: int = SIZE) -> DataFrame:
    """(pair, chrom, start, end, sites, pwd) for every pair and block of the grid. The block of a site is arithmetic; the
    genome (a few dozen rows) is the only thing joined to the sites. Sites beyond a chromosome's end are in no block."""
    placed = sites.join(F.broadcast(genome), "chrom").withColumn("start", block_start(F.col("pos"), F.col("length"), size)).filter("start IS NOT NULL")
    sums = placed.groupBy("pair", "chrom", "start").agg(F.count("*").alias("sites"), F.sum("pwd").alias("pwd"))
    pairs = sites.select("pair").distinct()
    grid = pairs.join(F.broadcast(block_grid(genome, size)), F.lit(True))
    joined = grid.join(sums, ["pair", "chrom", "start"], "left")
    return joined.select("pair", "chrom", "start", "end", F.coalesce("sites", F.lit(0).cast("long")).alias("sites"), F.coalesce("pwd", F.lit(0.0)).alias("pwd"))


def jackknife_blocks(blocks: DataFrame) -> DataFrame:
    """(pair, chrom, start, hj, theta_j) of every block that holds sites: the pseudo-value without that block."""
    totals = blocks.groupBy("pair").agg(F.sum("sites").alias("n"), F.sum("pwd").alias("total"))
    both = blocks.filter("sites > 0").join(totals, "pair")
    h, theta = F.col("n") / F.col("sites"), F.col("total") / F.col("n")
    rest = F.when(F.col("n") > F.col("sites"), (h - 1) * (F.col("total") - F.col("pwd")) / (F.col("n") - F.col("sites")))
    value = F.when(F.col("n") == F.col("sites"), F.lit(float("nan"))).otherwise(h * theta - rest)
    return both.select("pair", "chrom", "start", h.alias("hj"), value.alias("theta_j"))


def jackknife(blocks: DataFrame, textbook: bool = False) -> DataFrame:
    """(pair, estimate, variance). The variance compares each weighted pseudo-value theta_j / h_j with the estimate and
    divides by all blocks of the grid, empty ones too; ``textbook`` compares theta_j itself and divides by used blocks."""
    values = jackknife_blocks(blocks)
    estimate = values.groupBy("pair").agg(F.sum(F.col("theta_j") / F.col("hj")).alias("estimate"), F.count("*").alias("used"))
    grid = blocks.groupBy("pair").agg(F.count("*").alias("g"))
    weighed = F.col("theta_j") if textbook else F.col("theta_j") / F.col("hj")
    spread = F.sum(F.pow(weighed - F.col("estimate"), F.lit(2)) / (F.col("hj") - 1)).alias("spread")
    sums = values.filter("hj > 1").join(estimate, "pair").groupBy("pair").agg(spread)
    out = estimate.join(grid, "pair").join(sums, "pair", "left")
    return out.select("pair", "estimate", (F.coalesce("spread", F.lit(float("nan"))) / (F.col("used") if textbook else F.col("g"))).alias("variance"))
