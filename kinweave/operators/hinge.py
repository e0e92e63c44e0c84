"""Ordinal assignment by linear hinge classifiers with calibrated probabilities, all in columns.

A classifier has one feature, so the hinge loss is minimised exactly in the intercept: with y of +1 and -1 and P
positives, the best intercept for a slope w lies between the P-th and the next of the sorted values y - w x, as just as
many positives as negatives then lie on the wrong side of their margins. What is left is a convex function of the slope,
whose minimum is bracketed in thirds (its derivative won't do: rates repeat, and equal points make it
jump). Probabilities come from a sigmoid over decision values of held-out folds, fitted
by Newton's method with a halved step where a whole one doesn't help. A pair's replicates and comparisons are one array
of some thousand points for each threshold, and its classifiers are a projection of that row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of the hinge; folds of the calibration; steps of the slope's bracket and of Newton's method.
COST, FOLDS, BRACKETS, NEWTON = 10.0, 5, 45, 15
HALVES = (1.0, 0.5, 0.25, 0.125, 0.0)


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _total(points: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda t, p: t + of(p))


def balance(points: Column, positives: Column, slope: Column) -> Column:
    """The best intercept for a slope. points: array of (x, y)."""
    ordered = F.sort_array(F.transform(points, lambda p: p["y"] - slope * p["x"]))
    return _let(ordered, lambda z: (F.element_at(z, positives) + F.element_at(z, positives + 1)) / 2)


def hinge(points: Column) -> Column:
    """struct(slope, intercept) that minimises slope^2 / 2 + COST times the sum of max(0, 1 - y (slope x + intercept)).
    Points of one class alone have slope 0 and their class as intercept."""
    count = F.struct(F.size(F.filter(points, lambda p: p["y"] > 0)).alias("p"), F.size(points).alias("n"))

    def fitted(c: Column) -> Column:
        def loss(w: Column) -> Column:
            return _let(balance(points, c["p"], w), lambda b: w * w / 2 + COST * _total(points, lambda p: F.greatest(F.lit(0.0), 1 - p["y"] * (w * p["x"] + b))))

        def thirds(s: Column, _: Column) -> Column:
            low, high = s["lo"] + (s["hi"] - s["lo"]) / 3, s["hi"] - (s["hi"] - s["lo"]) / 3
            return F.when(loss(low) < loss(high), F.struct(s["lo"].alias("lo"), high.alias("hi"))).otherwise(F.struct(low.alias("lo"), s["hi"].alias("hi")))

        # Slope 0 costs at most 2 COST for each point of the rarer class, so no larger slope can be best.
        most = F.sqrt(4 * COST * F.least(c["p"], c["n"] - c["p"])) + 1
        ends = F.aggregate(F.sequence(F.lit(1), F.lit(BRACKETS)), F.struct((-most).alias("lo"), most.alias("hi")), thirds)
        # The loss has a kink at 0, where classes that overlap have their minimum: that is a slope of 0 and no small number.
        slope = _let(_let(ends, lambda e: (e["lo"] + e["hi"]) / 2), lambda w: F.when(loss(F.lit(0.0)) <= loss(w), F.lit(0.0)).otherwise(w))
        both = _let(slope, lambda w: F.struct(w.alias("slope"), balance(points, c["p"], w).alias("intercept")))
        alone = F.when(c["p"] > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        return F.when((c["p"] > 0) & (c["p"] < c["n"]), both).otherwise(F.struct(F.lit(0.0).alias("slope"), alone.alias("intercept")))

    return _let(count, fitted)


def sigmoid(decisions: Column) -> Column:
    """struct(a, c) of the probability 1 / (1 + exp(a f + c)) of a positive with decision value f, by maximum likelihood
    against targets that are drawn in from 0 and 1 by the sizes of the classes. decisions: array of (f, y)."""
    count = F.struct(F.size(F.filter(decisions, lambda d: d["y"] > 0)).alias("p"), F.size(F.filter(decisions, lambda d: d["y"] < 0)).alias("q"))

    def fitted(n: Column) -> Column:
        target = lambda d: F.when(d["y"] > 0, (n["p"] + 1.0) / (n["p"] + 2.0)).otherwise(1.0 / (n["q"] + 2.0))

        def cost(a: Column, c: Column) -> Column:
            def one(d: Column) -> Column:
                return _let(a * d["f"] + c, lambda e: F.when(e >= 0, target(d) * e + F.log1p(F.exp(-e))).otherwise((target(d) - 1) * e + F.log1p(F.exp(e))))

            return _total(decisions, one)

        def newton(s: Column, _: Column) -> Column:
            def add(t: Column, d: Column) -> Column:
                return _let(
                    1 / (1 + F.exp(s["a"] * d["f"] + s["c"])),
                    lambda p: F.struct(
                        *((t[k] + v).alias(k) for k, v in {"ga": d["f"] * (target(d) - p), "gc": target(d) - p, "haa": d["f"] * d["f"] * p * (1 - p), "hac": d["f"] * p * (1 - p), "hcc": p * (1 - p)}.items())
                    ),
                )

            zero = F.struct(*(F.lit(v).alias(k) for k, v in {"ga": 0.0, "gc": 0.0, "haa": 1e-12, "hac": 0.0, "hcc": 1e-12}.items()))

            def moved(t: Column) -> Column:
                det = t["haa"] * t["hcc"] - t["hac"] * t["hac"]
                da, dc = (t["hac"] * t["gc"] - t["hcc"] * t["ga"]) / det, (t["hac"] * t["ga"] - t["haa"] * t["gc"]) / det
                to = lambda k: F.struct(cost(s["a"] + k * da, s["c"] + k * dc).alias("cost"), (-k).alias("less"), (s["a"] + k * da).alias("a"), (s["c"] + k * dc).alias("c"))
                best = F.array_min(F.transform(F.array(*(F.lit(k) for k in HALVES)), to))
                return F.struct(best["a"].alias("a"), best["c"].alias("c"))

            return _let(F.aggregate(decisions, zero, add), moved)

        start = F.struct(F.lit(0.0).alias("a"), F.log((n["q"] + 1.0) / (n["p"] + 1.0)).alias("c"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), start, newton)

    return _let(count, fitted)


def fit_hinge(targets: DataFrame) -> DataFrame:
    """(pair, threshold, slope, intercept, a, c) of ``assign.ordinal_targets``' rows. A replicate's fold is its number
    modulo FOLDS; held-out decision values come from classifiers of the other folds."""
    point = F.struct((F.col("rep") % FOLDS).alias("fold"), "rep", F.col("x").cast("double").alias("x"), (2.0 * F.col("y") - 1).alias("y"))
    groups = targets.groupBy("pair", "threshold").agg(F.sort_array(F.collect_list(point)).alias("points"))
    # A group takes long for its size: groups aren't packed into few tasks by their bytes.
    groups = groups.repartition(shuffle_partitions(groups.sparkSession), "pair", "threshold")

    def held_out(k: Column) -> Column:
        rest, own = F.filter("points", lambda p: p["fold"] != k), F.filter("points", lambda p: p["fold"] == k)
        return _let(hinge(rest), lambda m: F.transform(own, lambda p: F.struct((m["slope"] * p["x"] + m["intercept"]).alias("f"), p["y"].alias("y"))))

    folds = F.array_distinct(F.transform("points", lambda p: p["fold"]))
    fitted = groups.select("pair", "threshold", hinge(F.col("points")).alias("m"), F.flatten(F.transform(folds, held_out)).alias("decisions"))
    return fitted.select("pair", "threshold", "m.slope", "m.intercept", sigmoid(F.col("decisions")).alias("s")).select("pair", "threshold", "slope", "intercept", "s.a", "s.c")


def hinge_probs(summary: DataFrame, sims: DataFrame, fits: DataFrame) -> DataFrame:
    """(pair, threshold, s): calibrated probability that the observed pair's label ranks above each threshold."""
    scale = sims.groupBy("pair").agg(F.avg("avg").alias("m"), F.stddev_pop("avg").alias("d"))
    at = summary.join(scale, "pair").select("pair", F.when(F.col("d") == 0, F.col("avg_pwd")).otherwise((F.col("avg_pwd") - F.col("m")) / F.col("d")).alias("x"))
    decision = F.col("slope") * F.col("x") + F.col("intercept")
    return fits.join(at, "pair").select("pair", "threshold", (1 / (1 + F.exp(F.col("a") * decision + F.col("c")))).alias("s"))
