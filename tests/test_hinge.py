"""The hinge classifier against enumeration of its optima, the sigmoid against its gradient, probabilities in order."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import assign, hinge


def loss(w, b, points):
    return w * w / 2 + hinge.COST * sum(max(0.0, 1 - y * (w * x + b)) for x, y in points)


def enumerated(points):
    """The least loss over all places where the optimum can be: two margins at points, or one and a free slope."""
    best = loss(0, 1, points), loss(0, -1, points)
    best = min(best)
    for (x, y), (u, v) in itertools.combinations(points, 2):
        if x != u:
            w = (y - v) / (x - u)
            best = min(best, loss(w, y - w * x, points))
    for x, y in points:  # b = y - w x: convex and piecewise quadratic in w
        lo, hi = -400.0, 400.0
        for _ in range(200):
            a, c = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (lo, c) if loss(a, y - a * x, points) < loss(c, y - c * x, points) else (a, hi)
        best = min(best, loss(lo, y - lo * x, points))
    return best


def classes(seed, n, gap):
    r = random.Random(seed)
    return [(r.gauss(gap if y > 0 else 0, 1), y) for y in (r.choice([1.0, -1.0]) for _ in range(n))]


@pytest.mark.parametrize("gap", [-3, 0, 1, 8])
def test_hinge_is_optimal(spark, gap):
    groups = {seed: classes(seed, 24, gap) for seed in range(6)}
    rows = [(s, [(float(x), y) for x, y in p]) for s, p in groups.items()]
    df = spark.createDataFrame(rows, "g int, points array<struct<x:double,y:double>>")
    for r in df.select("g", hinge.hinge(F.col("points")).alias("m")).select("g", "m.*").collect():
        assert loss(r["slope"], r["intercept"], groups[r["g"]]) <= enumerated(groups[r["g"]]) + 1e-5


def test_single_class_and_ties(spark):
    rows = [(0, [(1.0, 1.0), (2.0, 1.0)]), (1, [(1.0, -1.0)]), (2, [(1.0, 1.0), (1.0, -1.0)] * 3)]
    found = {r["g"]: (r["slope"], r["intercept"]) for r in spark.createDataFrame(rows, "g int, points array<struct<x:double,y:double>>").select("g", hinge.hinge(F.col("points")).alias("m")).select("g", "m.*").collect()}
    assert found[0] == (0.0, 1.0) and found[1] == (0.0, -1.0)
    assert loss(*found[2], rows[2][1]) <= enumerated(rows[2][1]) + 1e-5


@pytest.mark.parametrize("gap", [0, 1, 20])
def test_sigmoid_is_stationary(spark, gap):
    decisions = [(float(x), y) for x, y in classes(5, 200, gap)]
    df = spark.createDataFrame([(decisions,)], "d array<struct<f:double,y:double>>")
    a, c = df.select(hinge.sigmoid(F.col("d")).alias("s")).select("s.*").first()
    p, q = (sum(y == s for _, y in decisions) for s in (1, -1))
    t = np.array([(p + 1) / (p + 2) if y > 0 else 1 / (q + 2) for _, y in decisions])
    f = np.array([x for x, _ in decisions])
    missed = t - 1 / (1 + np.exp(a * f + c))
    assert abs(missed.sum()) < 1e-4 and abs((missed * f).sum()) < 1e-3 * max(1, abs(f).max())


def test_probabilities_of_known_relationships(spark):
    """Three labels with rates apart: the observed pair gets its own label, with a probability near one."""
    r = random.Random(2)
    labels = {"twins": 0.1, "siblings": 0.15, "unrelated": 0.2}
    sims = spark.createDataFrame([("A-B", rep, label, r.gauss(m, 0.005)) for rep in range(40) for label, m in labels.items()], "pair string, rep int, label string, avg double")
    drawn = assign.standardise(sims)
    stats = assign.relationship_stats(drawn, 40)
    fits = hinge.fit_hinge(assign.ordinal_targets(drawn, stats))
    for label, m in labels.items():
        probs = hinge.hinge_probs(spark.createDataFrame([("A-B", m)], "pair string, avg_pwd double"), drawn, fits)
        found = {x["label"]: x["p"] for x in assign.class_probs(probs, stats).collect()}
        assert max(found, key=found.get) == label and found[label] > 0.9 and math.isclose(sum(found.values()), 1)


def test_no_python_worker(spark, capsys):
    targets = spark.createDataFrame([("p", 0, 1, 0.5, 1)], "pair string, threshold int, rep int, x double, y int")
    hinge.fit_hinge(targets).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
