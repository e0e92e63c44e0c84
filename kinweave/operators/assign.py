"""Relationship assignment: distributions of simulated mismatch per label, z-scores, ordinal classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def relationship_stats(sims: DataFrame, reps: int, legacy_label_sum: bool = False) -> DataFrame:
    """(pair, label, mean, sd, rank): the simulated mismatch rate of each label, ranked by its mean. sims has ``avg``. A
    label that the tree uses several times has the mean over all its comparisons; ``legacy_label_sum`` divides their
    sum by the replicates only."""
    used = F.lit(reps) if legacy_label_sum else F.count("*")
    mean = sims.groupBy("pair", "label").agg((F.sum("avg") / used).alias("mean"))
    near = F.pow(F.col("avg") - F.col("mean"), F.lit(2))
    spread = sims.join(mean, ["pair", "label"]).groupBy("pair", "label", "mean").agg(F.sqrt(F.sum(near) / (F.lit(reps) if legacy_label_sum else F.count("*"))).alias("sd"))
    return spread.withColumn("rank", F.row_number().over(W.partitionBy("pair").orderBy("mean", "label")) - 1)


def standardise(sims: DataFrame) -> DataFrame:
    """sims with ``x``, the rate in units of its pair's deviation; unchanged where that is zero."""
    w = W.partitionBy("pair")
    mean, sd = F.avg("avg").over(w), F.stddev_pop("avg").over(w)
    return sims.withColumn("x", F.when(sd == 0, F.col("avg")).otherwise((F.col("avg") - mean) / sd))


def zscores(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """(pair, label, rank, mean, sd, z) of the observed rate under every label."""
    return stats.join(summary.select("pair", "avg_pwd"), "pair").select("pair", "label", "rank", "mean", "sd", ((F.col("avg_pwd") - F.col("mean")) / F.col("sd")).alias("z"))


def assign_zscore(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """(pair, label, sim_mean, z): the label with the least absolute z, of equal ones the one with the lower mean."""
    best = zscores(summary, stats).groupBy("pair").agg(F.min_by(F.struct("label", "mean", "z"), F.struct(F.abs("z"), "rank")).alias("b"))
    return best.select("pair", F.col("b.label").alias("label"), F.col("b.mean").alias("sim_mean"), F.col("b.z").alias("z"))


def ordinal_targets(sims: DataFrame, stats: DataFrame) -> DataFrame:
    """sims times thresholds 0 to labels - 2, with ``y``: whether the label's rank is above the threshold."""
    ranks = stats.select("pair", "label", "rank", F.count("*").over(W.partitionBy("pair")).alias("labels"))
    joined = sims.join(ranks, ["pair", "label"]).filter("labels > 1")
    spread = joined.withColumn("threshold", F.explode(F.sequence(F.lit(0), (F.col("labels") - 2).cast("int"))))
    return spread.withColumn("y", (F.col("rank") > F.col("threshold")).cast("int")).drop("labels", "rank")


#: C = 10 as a ridge penalty on the slope, a slight one on the intercept; steps of Newton's method, always as many.
PENALTY, SLIGHT, STEPS = 0.1, 1e-6, 15


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Logistic regression on one feature by Newton's method, with a small penalty on the slope."""
    x, y = np.column_stack([np.ones(len(rows)), rows["x"]]), rows["y"].to_numpy(float)
    b, ridge = np.zeros(2), np.diag([SLIGHT, PENALTY])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
        b = b + move
    return pd.DataFrame({"pair": [key[0]], "threshold": [key[1]], "intercept": [b[0]], "slope": [b[1]]})


def fit_ordinal(targets: DataFrame) -> DataFrame:
    """(pair, threshold, intercept, slope): one small classifier for each pair and threshold; a group has replicates x
    comparisons rows."""
    return targets.select("pair", "threshold", "x", "y").groupBy("pair", "threshold").applyInPandas(_fit, "pair string, threshold int, intercept double, slope double")


def threshold_probs(summary: DataFrame, sims: DataFrame, fits: DataFrame) -> DataFrame:
    """(pair, threshold, s): probability that the observed pair's label ranks above each threshold."""
    scale = sims.groupBy("pair").agg(F.avg("avg").alias("m"), F.stddev_pop("avg").alias("d"))
    at = summary.join(scale, "pair").select("pair", F.when(F.col("d") == 0, F.col("avg_pwd")).otherwise((F.col("avg_pwd") - F.col("m")) / F.col("d")).alias("x"))
    return fits.join(at, "pair").select("pair", "threshold", (1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("x"))))).alias("s"))


def class_probs(probs: DataFrame, stats: DataFrame, clip: bool = False) -> DataFrame:
    """(pair, label, rank, p): differences of neighbouring threshold probabilities; they may be slightly negative."""
    w = W.partitionBy("pair").orderBy("threshold")
    # The label above the last threshold comes from that threshold's own row, so that probs are worked out once.
    own = F.struct(F.col("threshold").alias("rank"), (F.lag("s", 1, 1.0).over(w) - F.col("s")).alias("p"))
    above = F.struct((F.col("threshold") + 1).alias("rank"), F.col("s").alias("p"))
    steps = probs.select("pair", own.alias("own"), above.alias("above"), F.lead("threshold").over(w).isNull().alias("last"))
    every = steps.select("pair", F.inline(F.when(F.col("last"), F.array("own", "above")).otherwise(F.array("own"))))
    each = every.withColumn("p", F.greatest("p", F.lit(0.0))) if clip else every
    return each.join(stats.select("pair", "rank", "label"), ["pair", "rank"]).select("pair", "label", "rank", "p")


def assign_ordinal(classes: DataFrame) -> DataFrame:
    """(pair, label, p): the likeliest label, of equal ones the last."""
    best = classes.groupBy("pair").agg(F.max_by(F.struct("label", "p"), F.struct("p", "rank")).alias("b"))
    return best.select("pair", "b.label", "b.p")


def relatedness_results(summary: DataFrame, stats: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """The result row of each pair: corrected statistics, label, the label's simulated mean and the observed z under it.
    Without ``assigned`` (pair, label) the z-score decides."""
    # One join of the summary, which is long to work out, gives every label's z and the columns of the result.
    z = stats.join(summary, "pair").withColumn("z", (F.col("avg_pwd") - F.col("mean")) / F.col("sd"))
    columns = ["pair", "label", "overlap", "sum_pwd", "avg_pwd", "ci95", "avg_phred", F.col("mean").alias("sim_avg_pwd"), "z"]
    if assigned is not None:
        return z.join(assigned.select("pair", "label"), ["pair", "label"]).select(*columns)
    best = z.groupBy("pair").agg(F.min_by(F.struct(*columns[1:]), F.struct(F.abs("z"), "rank")).alias("b"))
    return best.select("pair", "b.*")
