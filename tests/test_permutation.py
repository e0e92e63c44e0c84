"""Keyed permutations and the founders drawn by them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinweave.operators import pedigree, permutation


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 100])
def test_every_number_once(spark, n):
    rows = spark.range(4).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    found = rows.select("key", "k", permutation.permuted(F.col("k"), n, 9, "s", F.col("key")).alias("x")).collect()
    orders = {key: [r["x"] for r in sorted((r for r in found if r["key"] == key), key=lambda r: r["k"])] for key in range(4)}
    assert all(sorted(o) == list(range(n)) for o in orders.values())
    assert n < 17 or len({tuple(o) for o in orders.values()}) == 4


def test_draws_are_even(spark):
    """Every member is drawn about as often as any other, and so is every ordered pair of the first two draws."""
    rows = spark.range(6000).select("id", *(permutation.permuted(F.lit(k), 6, 9, "s", F.col("id")).alias(f"x{k}") for k in (0, 1))).collect()
    pairs = Counter((r["x0"], r["x1"]) for r in rows)
    assert len(pairs) == 30 and all(abs(v - 200) < 75 for v in pairs.values())


def people(sexes):
    return tuple((f"p{i}", None, None, s) for i, s in enumerate(sexes))


@pytest.mark.parametrize("sexes", [("unknown",) * 3, ("male", "female", "unknown"), ("unknown", "male", "male"), ("female",) * 4])
def test_founders(spark, sexes):
    tree = pedigree.Tree(people(sexes), (), {f"p{i}": i for i in range(len(sexes))})
    members = [(f"S{i:02d}", i, "male" if i % 2 else "female") for i in range(12)]
    panel = spark.createDataFrame(members, "sample string, idx int, sex string")
    reps = pedigree.expand_replicates(spark.createDataFrame([("a",), ("b",)], "pair string"), 60)
    out = spark.createDataFrame([("S03",), ("S04",)], "sample string")
    found = permutation.permuted_founders(reps, panel, tree, 5, exclude=out).collect()
    assert len(found) == 120
    sex = {i: s for _, i, s in members}
    for r in found:
        drawn = list(r["founders"])
        assert len({*drawn}) == len(sexes) and not {*drawn} & {3, 4} and None not in drawn
        assert all(w in ("unknown", sex[i]) for w, i in zip(sexes, drawn, strict=True))
    assert {i for r in found for i in r["founders"]} == ({*range(12)} - {3, 4} if "unknown" in sexes else {i for i, s in sex.items() if s in sexes} - {3, 4})
    again = permutation.permuted_founders(reps.repartition(7), panel.repartition(3), tree, 5, exclude=out)
    assert {(r["pair"], r["rep"]): list(r["founders"]) for r in again.collect()} == {(r["pair"], r["rep"]): list(r["founders"]) for r in found}


def test_too_few_members(spark):
    tree = pedigree.Tree(people(("male", "male")), (), {"p0": 0, "p1": 1})
    panel = spark.createDataFrame([("a", 0, "male"), ("b", 1, "female")], "sample string, idx int, sex string")
    with pytest.raises(ValueError, match="too few"):
        permutation.permuted_founders(pedigree.expand_replicates(spark.createDataFrame([("a",)], "pair string"), 2), panel, tree, 5)
