"""Pair sums by matrix products: against the pair rows, with 200 samples, and the shape of the plan."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocks, observed, products


@pytest.fixture(autouse=True)
def whole_shuffles(spark):
    """Without coalescing, so that samples of a site in different partitions would show."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

OBS = "chrom int, pos long, sample int, base string, phred int, read_ix int"


def made(spark, samples, sites, seed, most=3):
    r = random.Random(seed)
    rows = []
    for s in range(sites):
        chrom, pos = 1 + s % 3, 1 + (s * 7919) % 250_000
        for sample in range(samples):
            if r.random() < 0.4:
                rows += [(chrom, pos, sample, r.choice("ACGTN*R"), r.randrange(20, 41), i) for i in range(r.randrange(1, most + 1))]
    people = spark.createDataFrame([(i, f"S{i}", 1 + i % 2) for i in range(samples)], "sample int, name string, min_depth int")
    return spark.createDataFrame(rows, OBS).dropDuplicates(["chrom", "pos", "sample", "read_ix"]).repartition(5), people


def close(a, b):
    a, b = ({tuple(v for v in r if not isinstance(v, float)): [v for v in r if isinstance(v, float)] for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and a
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9, nan_ok=True), k


@pytest.mark.parametrize("cells", [10, 1 << 16])
def test_sums_equal_pair_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(products, "CHUNK_CELLS", cells)
    obs, people = made(spark, 6, 300, 1)
    want = observed.pair_summary(observed.pair_sites(obs, people, self_comparison=True))
    found = products.product_summary(products.pair_products(obs, people, self_comparison=True))
    close(found.select(want.columns), want)


def test_blocks_equal_pair_rows(spark):
    obs, people = made(spark, 5, 400, 2)
    genome = spark.createDataFrame([(1, 250_000), (2, 200_001), (3, 251_000)], "chrom int, length long")
    want = blocks.block_summary(observed.pair_sites(obs, people).filter("pos <= 200001"), genome, 20_000)
    found = products.product_blocks(products.pair_products(obs.filter("pos <= 200001"), people, genome, 20_000), genome, 20_000)
    close(found.select(want.columns), want)


def test_two_hundred_samples(spark):
    obs, people = made(spark, 200, 40, 3, most=1)
    people = people.withColumn("min_depth", F.lit(1))
    want = observed.pair_summary(observed.pair_arrays(observed.site_counts(obs), people))
    close(products.product_summary(products.pair_products(obs, people)).select(want.columns), want)


def test_absent_samples_and_empty_tables(spark):
    obs, people = made(spark, 3, 20, 4)
    assert products.pair_products(obs.limit(0), people).collect() == []
    assert products.pair_products(obs, people.limit(0)).collect() == []
    two = people.filter("sample <> 1")
    want = observed.pair_summary(observed.pair_sites(obs, two))
    close(products.product_summary(products.pair_products(obs, two)).select(want.columns), want)


def test_plan_has_one_exchange_of_reads(spark, capsys, tmp_path):
    obs, people = made(spark, 3, 20, 5)
    obs.write.parquet(str(tmp_path / "obs"))
    products.product_summary(products.pair_products(spark.read.parquet(str(tmp_path / "obs")), people)).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "Generate" not in plan and "Window" not in plan
    # reads by stretch, then the few rows a pair; the samples' names are broadcast
    exchanges = [line for line in plan.splitlines() if " Exchange " in line]
    assert ["hashpartitioning(chrom" in e for e in exchanges] == [False, True]
