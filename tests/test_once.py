"""Inputs that are long to work out are in a plan once: what Spark reads twice it shuffles twice."""

import re

import pytest

from kinweave.operators import assign as asg
from kinweave.plans import queries as qs


def scans(df, column):
    """How often the plan reads the files that have ``column``."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len([r for r in re.findall(r"Relation \[([^\]]*)\]", plan) if re.search(rf"\b{column}#", r)])


def test_results_work_the_summary_out_once(spark, tmp_path):
    spark.createDataFrame([("p", 9, 3.0, 0.30, 0.1, 30.0), ("q", 8, 1.0, 0.11, 0.1, 31.0)], "pair string, overlap long, sum_pwd double, avg_pwd double, ci95 double, avg_phred double").write.parquet(str(tmp_path / "summary"))
    summary = spark.read.parquet(str(tmp_path / "summary"))
    stats = spark.createDataFrame([(p, label, mean, 0.1, i) for p in "pq" for i, (label, mean) in enumerate([("same", 0.1), ("none", 0.25)])], "pair string, label string, mean double, sd double, rank int")
    given = spark.createDataFrame([("p", "same"), ("q", "none")], "pair string, label string")
    for assigned, want in ((None, [("p", "none"), ("q", "same")]), (given, [("p", "same"), ("q", "none")])):
        found = asg.relatedness_results(summary, stats, assigned)
        assert scans(found, "avg_phred") == 1
        rows = {r["pair"]: r for r in found.collect()}
        assert [(p, r["label"]) for p, r in sorted(rows.items())] == want
        means = {"same": 0.1, "none": 0.25}
        for r in rows.values():
            assert r["sim_avg_pwd"] == means[r["label"]] and r["z"] == (r["avg_pwd"] - r["sim_avg_pwd"]) / 0.1 and (r["overlap"], r["avg_phred"]) == ((9, 30.0) if r["pair"] == "p" else (8, 31.0))


def test_class_probabilities_work_the_thresholds_out_once(spark, tmp_path):
    spark.createDataFrame([("p", 1, 0.25), ("p", 0, 0.75), ("q", 0, 0.5), ("r", 0, 0.25), ("r", 1, 0.5), ("r", 2, 0.0)], "pair string, threshold int, s double").write.parquet(str(tmp_path / "probs"))
    stats = spark.createDataFrame([(p, i, f"l{i}") for p, n in (("p", 3), ("q", 2), ("r", 4)) for i in range(n)], "pair string, rank int, label string")
    for clip, second in ((False, -0.25), (True, 0.0)):
        found = asg.class_probs(spark.read.parquet(str(tmp_path / "probs")), stats, clip)
        assert scans(found, "s") == 1
        assert sorted(map(tuple, found.collect())) == [("p", "l0", 0, 0.25), ("p", "l1", 1, 0.5), ("p", "l2", 2, 0.25), ("q", "l0", 0, 0.5), ("q", "l1", 1, 0.5), ("r", "l0", 0, 0.75), ("r", "l1", 1, second), ("r", "l2", 2, 0.5), ("r", "l3", 3, 0.0)]


#: How often a plan reads lineitem: two sides of the pair join, the other times for the rates.
ONCE = {"r5_results": 4, "r3_hinge_probs": 8, "r4_hinge_label": 8, "r4_ordinal_label": 8}


@pytest.mark.parametrize("name", ONCE)
def test_queries_join_pairs_once(spark, sf, name):
    assert scans(qs.queries()[name](spark, sf), "l_quantity") == ONCE[name]
