"""Resampling by stretches of a chromosome: the same flags and counts as in one window by pair and replicate."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.functions.scalar import u01
from kinweave.operators import haplotypes as hp
from kinweave.operators import pedigree as pg
from kinweave.plans import queries as qs

TREE = pg.Tree((("f", None, None, "male"), ("m", None, None, "female"), ("c", "f", "m", "male")), ((0, "child", "f", "c"), (1, "none", "f", "m")), {"f": 0, "m": 1, "c": 2})
SEED = 5


@pytest.fixture
def typed(spark, monkeypatch):
    monkeypatch.setattr(pg, "STRETCH", 100)
    r = random.Random(1)
    places = sorted({(c, p) for c in (1, 2, 10) for p in [1, 99, 100, 101, 200, *r.sample(range(1, 3000), 40)]})
    rows = [(pair, c, p, 0.5, 30.0, 20.0, 0.25, 0.75) for pair in ("a", "b") for c, p in places if r.random() < 0.9]
    return spark.createDataFrame(rows, "pair string, chrom int, pos long, recomb double, q0 double, q1 double, caf0 double, caf1 double")


@pytest.mark.parametrize("rate, x_mode", [(0.0, False), (0.4, False), (0.4, True)])
def test_flags_run_on_over_stretches(spark, typed, rate, x_mode):
    every = pg.downsample_sites(pg.stretched(typed).withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1), F.lit(7)))), rate, SEED)
    before = pg.crossovers_before(every, TREE, SEED, x_mode)
    found = pg.crossovers(every.join(before, ["pair", "rep", "chrom", "stretch"]), TREE, SEED, x_mode)
    hits = [F.lit(False) if x_mode and k == 0 else u01(SEED, "xover", F.col("pair"), F.col("rep"), F.col("chrom"), F.col("pos"), F.lit(i), F.lit(k)) < F.col("recomb") for i, k in TREE.slots]
    running, want = defaultdict(lambda: [0, 0]), {}
    for x in every.select("pair", "rep", "chrom", "pos", F.array(*hits).alias("h")).orderBy("pair", "rep", "chrom", "pos").collect():
        now = running[x["pair"], x["rep"]]
        now[:] = [a ^ b for a, b in zip(now, x["h"], strict=True)]
        want[tuple(x)[:4]] = tuple(now)
    got = {tuple(x)[:4]: tuple(x)[4:] for x in found.select("pair", "rep", "chrom", "pos", *(f"x{TREE.number[i]}_{k}" for i, k in TREE.slots)).collect()}
    assert got == want and len({v for v in want.values()}) == (2 if x_mode else 4)


def test_panels_by_site_and_by_pattern_give_the_same_counts(spark, typed, monkeypatch):
    places = [tuple(x) for x in typed.select("chrom", "pos").distinct().orderBy("chrom", "pos").collect()][:-3]
    words = [0x123456789ABCDEF, -0x7EDCBA987654321, 0]
    sites = spark.createDataFrame([(c, p, i % 3) for i, (c, p) in enumerate(places)], "chrom int, pos long, pattern int")
    coded = hp.Coded(sites, spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "pattern int, bits array<long>"))
    replicates = spark.createDataFrame([(p, r, [r, r + 9], [r % 2, 1], 0.1, 0.2, None, None) for p in "ab" for r in (0, 1, 2)], "pair string, rep int, founders array<int>, strands array<int>, contam0 double, contam1 double, err0 double, err1 double")
    run = lambda rows, panel: sorted(map(tuple, pg.simulate(rows, panel, replicates, TREE, SEED, drop_rate=0.2, fixation=0.1).collect()))
    plain = run(typed, coded.at_sites(coded.patterns))
    assert len(plain) == 12 and any(x[-2] for x in plain)
    assert run(typed, coded) == plain and run(typed.join(sites, ["chrom", "pos"]), coded) == plain
    monkeypatch.setattr(pg, "STRETCH", 10_000)
    assert run(typed, coded) == plain


def test_no_window_holds_all_sites_of_a_replicate(spark, sf):
    plan = qs.queries()["m9_sims"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan
    assert not re.search(r"windowspecdefinition\(pair#\d+, rep#\d+, chrom#\d+ ASC[^,]*, pos#", plan)
    # Sites that would fit a broadcast are dealt all the same.
    assert "strategy=merge" in plan
