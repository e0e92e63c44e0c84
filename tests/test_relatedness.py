import math
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import assign as asg
from kinweave.operators import pedigree as pg
from kinweave.operators import recombination as rc

CHILD = pg.Tree((("f", None, None, "male"), ("m", None, None, "female"), ("c", "f", "m", "male")), ((0, "child", "f", "c"),), {"f": 0, "m": 1, "c": 2})


def test_recombination(spark):
    r = random.Random(3)
    cuts = sorted(r.sample(range(1, 400), 30))
    rows = [(1, a, b, float(r.randrange(1, 9))) for a, b in zip([0, *cuts], cuts, strict=False)]
    pos = sorted({*r.sample(range(1, 450), 60), cuts[3], cuts[9]})
    sites = spark.createDataFrame([("p", 1, x) for x in pos], "pair string, chrom int, pos long")
    got = {x["pos"]: x["recomb"] for x in rc.recombination(sites, spark.createDataFrame(rows, "chrom int, start long, stop long, rate double")).collect()}
    last = 0
    for x in pos:
        d = sum(rate * (min(stop, x) - max(start, last) + 1) for _, start, stop, rate in rows if start < x and stop > last) / 100 / 1e6
        assert got[x] == pytest.approx(0.5 * (1 - math.exp(-2 * d)), abs=1e-15)
        last = x


@pytest.mark.parametrize("x_mode", [False, True])
def test_gene_drop(spark, x_mode):
    rows = [(a, b, c, d, s, t, x, y) for a in (0, 1) for b in (2, 3) for c in (4, 5) for d in (6, 7) for s in (0, 1) for t in (0, 1) for x in (0, 1) for y in (0, 1)]
    df = spark.createDataFrame([(*r[:4], [r[4], r[5]], r[6], r[7]) for r in rows], "g0_0 int, g0_1 int, g1_0 int, g1_1 int, strands array<int>, x2_0 int, x2_1 int")
    for r in pg.gene_drop(df, CHILD, x_mode).collect():
        mother = (r["g1_0"], r["g1_1"])[r["strands"][1] ^ r["x2_1"]]
        father = (r["g0_0"], r["g0_1"])[r["strands"][0] ^ r["x2_0"]]
        assert (r["g2_0"], r["g2_1"]) == (mother if x_mode else father, mother)


def test_read_draw(spark):
    draw = lambda contam, af, err: [r[0] for r in spark.range(400).select(pg.draw_read(F.lit(0), F.lit(0), F.lit(contam), F.lit(af), F.lit(err), 1, F.col("id"))).collect()]
    assert set(draw(0.0, 1.0, 0.0)) == {0} and set(draw(1.0, 1.0, 0.0)) == {1}
    assert set(draw(0.0, 0.0, 1.0)) == {1, 2, 3}
    assert 0.3 < sum(draw(0.5, 1.0, 0.0)) / 400 < 0.7


def test_founders(spark):
    members = spark.createDataFrame([(f"s{i}", i, ("male", "female")[i % 2]) for i in range(6)], "sample string, idx int, sex string")
    reps = pg.expand_replicates(spark.createDataFrame([("a-b",)], "pair string"), 50)
    banned = members.filter("idx < 2")
    got = [r["founders"] for r in pg.draw_founders(reps, members, CHILD, 1, banned).collect()]
    assert len(got) == 50 and all(f % 2 == 0 and m % 2 == 1 and min(f, m) > 1 for f, m in got) and len({*map(tuple, got)}) > 2
    with pytest.raises(ValueError):
        pg.draw_founders(reps, members.withColumn("sex", F.lit("unknown")), CHILD, 1)


def test_sexes(spark):
    tree = pg.Tree((("a", None, None, "unknown"), ("b", None, None, "unknown"), ("c", "a", "b", "unknown"), ("d", None, None, "unknown"), ("e", "c", "d", "unknown")), (), {})
    sexes = pg.assign_sex(tree, 5)
    rows = spark.range(200).select(F.lit("p").alias("pair"), F.col("id").alias("rep")).select(*(c.alias(i) for i, c in sexes.items())).collect()
    assert all(r["a"] != r["b"] and r["c"] != r["d"] for r in rows) and 50 < sum(r["a"] == "male" for r in rows) < 150


def test_tree_order(spark):
    people = spark.createDataFrame([("c", "f", "m", "male"), ("f", None, None, "male"), ("m", None, None, "female")], "iid string, fid string, mid string, sex string")
    cmp = spark.createDataFrame([(0, "child", "f", "c")], "ord int, label string, i0 string, i1 string")
    assert [p[0] for p in pg.Tree.of(people, cmp).people] == ["f", "m", "c"]
    with pytest.raises(ValueError):
        pg.Tree.of(people.filter("iid <> 'f'"), cmp)


def test_assignment(spark):
    r = random.Random(9)
    means = {"self": 0.1, "first": 0.2, "none": 0.3}
    sims = spark.createDataFrame([("p", i, k, label, r.gauss(m, 0.01)) for i in range(60) for k, (label, m) in enumerate(means.items())], "pair string, rep int, ord int, label string, avg double")
    stats = asg.relationship_stats(sims, 60)
    assert [x["label"] for x in stats.orderBy("rank").collect()] == list(means)
    for observed, want in ((0.09, "self"), (0.21, "first"), (0.31, "none")):
        summary = spark.createDataFrame([("p", observed)], "pair string, avg_pwd double")
        assert asg.assign_zscore(summary, stats).first()["label"] == want
        scaled = asg.standardise(sims)
        fits = asg.fit_ordinal(asg.ordinal_targets(scaled, stats))
        classes = asg.class_probs(asg.threshold_probs(summary, scaled, fits), stats)
        assert asg.assign_ordinal(classes).first()["label"] == want
        assert sum(x["p"] for x in classes.collect()) == pytest.approx(1.0)
    doubled = sims.unionAll(sims.withColumn("ord", F.col("ord") + 3))
    legacy = {x["label"]: x["mean"] for x in asg.relationship_stats(doubled, 60, legacy_label_sum=True).collect()}
    assert legacy["first"] == pytest.approx(2 * {x["label"]: x["mean"] for x in stats.collect()}["first"])


def test_legacy_class_edges(spark):
    probs = spark.createDataFrame([("p", 0, 0.5), ("p", 1, 0.6)], "pair string, threshold int, s double")
    stats = spark.createDataFrame([("p", i, x) for i, x in enumerate("abc")], "pair string, rank int, label string")
    raw = [x["p"] for x in asg.class_probs(probs, stats).orderBy("rank").collect()]
    assert raw == [pytest.approx(0.5), pytest.approx(-0.1), pytest.approx(0.6)]
    assert min(x["p"] for x in asg.class_probs(probs, stats, clip=True).collect()) == 0
