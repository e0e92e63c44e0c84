"""Bitmap haplotypes against plain lists: packing, frequencies, unnesting, nested pairs and contaminants."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinweave.operators import haplotypes as hp


def panel_of(spark, samples, seed=1):
    r = random.Random(seed)
    alleles = {(1 + s % 2, 10 * s): [r.randrange(2) for _ in range(2 * samples)] for s in range(1, 30)}
    index = spark.createDataFrame([(f"S{i:03d}", i) for i in range(samples)], "sample string, idx int")
    rows = [(c, p, "".join(map(str, a))) for (c, p), a in alleles.items()]
    bits = spark.createDataFrame(rows, "chrom int, pos long, digits string").select("chrom", "pos", hp.pack_digits(F.col("digits")).alias("bits"))
    return alleles, index, bits


@pytest.mark.parametrize("samples", [1, 31, 32, 33, 100])
def test_pack_and_unpack(spark, samples):
    alleles, index, bits = panel_of(spark, samples)
    found = {(r["chrom"], r["pos"]): list(r["haps"]) for r in hp.haplotype_arrays(bits, index).collect()}
    assert found == alleles
    assert {(r["chrom"], r["pos"]): r["n"] for r in bits.select("chrom", "pos", hp.alternates(F.col("bits")).alias("n")).collect()} == {k: sum(v) for k, v in alleles.items()}
    calls = {(r["chrom"], r["pos"], r["sample"]): (r["a0"], r["a1"]) for r in hp.genotypes(bits, index).collect()}
    assert calls == {(*k, f"S{i:03d}"): (v[2 * i], v[2 * i + 1]) for k, v in alleles.items() for i in range(samples)}
    assert bits.select(hp.allele(F.col("bits"), F.lit(64 * 4 + 1)).alias("x")).first()["x"] is None


def test_frequencies(spark):
    samples = 70
    alleles, index, bits = panel_of(spark, samples)
    groups = {"early": range(0, 3), "late": range(60, 70), "odd": range(1, 70, 2), "all": range(70)}
    panel = spark.createDataFrame([(f"S{i:03d}", g) for g, ids in groups.items() for i in ids] + [("S000", "early")], "sample string, grp string")
    found = {(r["chrom"], r["pos"], r["grp"]): round(r["af"], 4) for r in hp.bit_frequencies(bits, hp.masks(panel, index)).collect()}
    want = {(*k, g): round(sum(v[2 * i] + v[2 * i + 1] for i in ids) / (2 * len(ids)), 4) for k, v in alleles.items() for g, ids in groups.items()}
    assert found == pytest.approx(want, abs=1e-4) and len(found) == len(want)


def test_calls_of_every_kind(spark):
    """Calls in a header's order with members that the panel lacks, single calls, further fields; other calls fail."""
    order = spark.createDataFrame([(2, 0), (0, 1)], "at int, idx int")
    vcf = spark.createDataFrame([(1, 1, ["0|1", "1|1", "1|0"]), (1, 2, ["1", "0|0:9", "0|1:3:x"]), (2, 3, ["0|0", "?", "1|1"])], "chrom int, pos long, calls array<string>")
    found = {r["pos"]: list(r["haps"]) for r in hp.haplotype_arrays(hp.site_bitmaps(vcf, order), order).collect()}
    assert found == {1: [1, 0, 0, 1], 2: [0, 1, 1, 1], 3: [1, 1, 0, 0]}
    with pytest.raises(PySparkException):
        hp.site_bitmaps(vcf, spark.createDataFrame([(1, 0)], "at int, idx int")).collect()


def test_nested_pairs(spark):
    alleles, index, bits = panel_of(spark, 40)
    r = random.Random(4)
    pairs = [f"P{i}" for i in range(7)]
    rows = [(p, c, s, float(i)) for i, (c, s) in enumerate([*alleles, (9, 9)]) for p in pairs if r.random() < 0.7]
    sites = spark.createDataFrame(rows, "pair string, chrom int, pos long, pwd double")
    attached = hp.attach_nested(sites, bits, alts=hp.alternates(F.col("bits")))
    assert sorted(tuple(x) for x in attached.select("pair", "chrom", "pos", "pwd", "alts").collect()) == sorted((*x, sum(alleles[x[1:3]])) for x in rows if x[1:3] in alleles)
    drawn = [(p, side, f"S{r.randrange(40):03d}") for p in pairs[:6] for side in (0, 1) for _ in range(3)] + [("P0", 0, "S001"), ("P0", 0, "S001")]
    contaminants = spark.createDataFrame(drawn, "pair string, side int, sample string")
    found = {(x["pair"], x["chrom"], x["pos"]): (x["caf0"], x["caf1"]) for x in hp.nested_contaminants(sites, bits, contaminants, index).collect()}
    want = {}
    for p, c, s, _ in rows:
        if (c, s) in alleles and p != "P6":
            own = [[int(name[1:]) for q, side, name in drawn if (q, side) == (p, k)] for k in (0, 1)]
            want[p, c, s] = tuple(sum(alleles[c, s][2 * i] + alleles[c, s][2 * i + 1] for i in ids) / (2 * len(ids)) for ids in own)
    assert found == want and want


def test_store_meets_one_row_a_site(spark, capsys):
    _, _, bits = panel_of(spark, 40)
    sites = spark.createDataFrame([(p, 1, 10) for p in "abc"], "pair string, chrom int, pos long")
    hp.attach_nested(sites, bits, alts=hp.alternates(F.col("bits"))).explain()
    plan = capsys.readouterr().out
    # The pairs are rows again above the join; the bitmaps end below it.
    assert plan.index("Generate explode(pairs") < plan.index("Join")
    assert "bits" not in plan[: plan.index("Join")]
