"""Recombination between consecutive typed sites, without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import haldane, rate_per_bp


def previous_positions(sites: DataFrame) -> DataFrame:
    """sites (pair, chrom, pos) with ``prev``, the pair's last typed position on the chromosome, 0 at first."""
    return sites.withColumn("prev", F.lag("pos", 1, 0).over(W.partitionBy("pair", "chrom").orderBy("pos")))


#: Bases of a chromosome that one window orders together.
STRETCH = 1_000_000


def cumulative_rates(genetic_map: DataFrame, points: DataFrame) -> DataFrame:
    """(chrom, x, f, rs, re) for every point (chrom, x): the integral of the rate up to x, the sum of the rates of
    intervals that start before x, and of those that end at or before x. Points and interval ends are ordered together
    in one window per stretch of a chromosome, not by a range join; what lies before a stretch comes from a table with a
    row a stretch, so tasks are as many as stretches and sums stay small."""
    stretch = F.floor(F.col("x") / STRETCH)
    within = F.col("x") - F.col("stretch") * STRETCH
    ends = genetic_map.filter("stop > start").select("chrom", F.explode(F.array(
        F.struct(F.col("start").alias("x"), F.lit(2).alias("kind"), F.col("rate").alias("up"), F.lit(0.0).alias("down")),
        F.struct(F.col("stop").alias("x"), F.lit(0).alias("kind"), F.lit(0.0).alias("up"), F.col("rate").alias("down")),
    )).alias("e")).select("chrom", "e.*")
    # An interval that starts at x isn't below x; one that ends at x is: ends, then points, then starts.
    marks = points.select("chrom", "x").distinct().select("chrom", "x", F.lit(1).alias("kind"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    steps = ends.unionByName(marks).withColumn("stretch", stretch).withColumn("moment", within * (F.col("up") - F.col("down")))
    w = W.partitionBy("chrom", "stretch").orderBy("x", "kind").rowsBetween(W.unboundedPreceding, 0)
    run = steps.select("chrom", "stretch", "x", "kind", F.sum("up").over(w).alias("u"), F.sum("down").over(w).alias("d"), F.sum("moment").over(w).alias("m"))
    # Before a stretch: sums of rates, and the integral up to its first base.
    before = W.partitionBy("chrom").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = steps.groupBy("chrom", "stretch").agg(F.sum("up").alias("u"), F.sum("down").alias("d"), F.sum("moment").alias("m"))
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    base = F.col("stretch") * STRETCH
    heads = totals.select("chrom", "stretch", earlier(F.col("u")).alias("u0"), earlier(F.col("d")).alias("d0"), (base * earlier(F.col("u") - F.col("d")) - earlier(base * (F.col("u") - F.col("d")) + F.col("m"))).alias("f0"))
    at = run.filter("kind = 1").join(heads, ["chrom", "stretch"])
    f = F.col("f0") + within * (F.col("u0") - F.col("d0") + F.col("u") - F.col("d")) - F.col("m")
    return at.select("chrom", "x", f.alias("f"), (F.col("u0") + F.col("u")).alias("rs"), (F.col("d0") + F.col("d")).alias("re"))


def recombination(sites: DataFrame, genetic_map: DataFrame) -> DataFrame:
    """sites (pair, chrom, pos) with ``prev`` and ``recomb``, the odd-crossover probability since ``prev``: each map
    interval under [prev, pos) counts with its overlap plus one base."""
    gaps = previous_positions(sites)
    points = gaps.select("chrom", F.explode(F.array("prev", "pos")).alias("x")).distinct()
    at = cumulative_rates(genetic_map, points)
    a = at.select("chrom", F.col("x").alias("prev"), F.col("f").alias("fa"), F.col("re").alias("rea"))
    b = at.select("chrom", F.col("x").alias("pos"), F.col("f").alias("fb"), F.col("rs").alias("rsb"))
    both = gaps.join(a, ["chrom", "prev"]).join(b, ["chrom", "pos"])
    total = F.when(F.col("pos") > F.col("prev"), F.col("fb") - F.col("fa") + F.col("rsb") - F.col("rea")).otherwise(F.lit(0.0))
    return both.withColumn("recomb", haldane(rate_per_bp(total))).drop("fa", "rea", "fb", "rsb")
