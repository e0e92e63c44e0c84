"""Calls of a panel: no text of them for each site, and rows only where their sites are."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import scalar as sc
from kinweave.operators import haplotypes as hp
from kinweave.plans import adapters as ad
from kinweave.plans import queries as qs
from kinweave.sources import readers as rd
from kinweave.sources import store


def rows(df):
    return sorted(tuple(map(repr, r)) for r in df.collect())


class Lines(Exception):
    pass


@pytest.mark.parametrize("name", ["s9_vcf_genotypes", "s13_store_genotypes", "s14_store_freqs", "s16_store_haps", "s17_store_chroms", "s13_grown_store", "j4_bucketed_lookup"])
def test_lines_do_not_grow_with_members(spark, sf, monkeypatch, name):
    def parse(lines):
        raise Lines(lines.select(F.max(F.size(F.split("value", "\t")))).first()[0])

    monkeypatch.setattr(qs, "BUILT", {})
    monkeypatch.setattr(rd, "parse_vcf", parse)
    with pytest.raises(Lines) as found:
        qs.queries()[name](spark, sf)
    assert found.value.args == (10,)


@pytest.mark.parametrize("name", ["s10_find_vcfs", "o5_several_vcfs"])
def test_files_do_not_grow_with_members(spark, sf, monkeypatch, name):
    found, find = [], rd.find_inputs
    monkeypatch.setattr(rd, "find_inputs", lambda *a: found.extend(find(*a)) or found)
    qs.queries()[name](spark, sf)
    lines = spark.read.text(found).filter("value NOT LIKE '#%'")
    assert len(found) == 3 and [r[0] for r in lines.select(F.size(F.split("value", "\t"))).distinct().collect()] == [10]


@pytest.mark.parametrize("name", ["o5_several_vcfs", "s13_store_genotypes", "s9_vcf_genotypes"])
def test_calls_are_shuffled_nested(spark, sf, capsys, name):
    """No exchange is above the step that makes a row of each call."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = qs.queries()[name](spark, sf)
        capsys.readouterr()
        found.explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out.splitlines()
    branches = []
    for line in plan:
        if "Generate inline(__sites" in line:
            branches.append([])
        if branches:
            branches[-1].append(line)
    assert len(branches) == (3 if name.startswith("o5") else 1) and not any("Exchange" in line for line in plan[: plan.index(branches[0][0])])
    for lines in branches:
        calls = max(i for i, line in enumerate(lines) if "Generate" in line)
        assert calls and min(i for i, line in enumerate(lines) if "Exchange" in line) > calls


def test_spread_deals_a_patterns_sites(spark, sf, monkeypatch):
    coded, index = ad.panel(spark, sf), ad.adapter(spark, sf, "INDEX")
    few = hp.Coded(coded.sites.withColumn("pattern", F.col("pattern") % 2), coded.patterns.filter("pattern < 2"))  # two patterns, many sites
    want = rows(few.at_sites(hp.genotypes(few.patterns, index)))
    assert want and rows(few.spread(few.patterns, lambda b: hp.genotypes(b, index))) == want
    monkeypatch.setattr(hp, "TOGETHER", 3)
    assert rows(few.spread(few.patterns, lambda b: hp.genotypes(b, index))) == want


def test_keyed_lines_are_packed_as_whole_ones(spark):
    info = {"VT": "SNP"}
    texts = {"a": "0|1\t1|1", "b": "1|0\t0|0", "c": "1|1\t1|1"}
    lines = [(1, 10, info, "a"), (1, 20, info, "a"), (2, 10, info, "b"), (2, 30, info, "c"), (2, 30, info, "a"), (2, 40, {"VT": "INDEL"}, "c")]
    schema = "chrom int, pos long, info map<string,string>, calls_text string"
    vcf = lambda f: spark.createDataFrame([(*x[:3], f(x[3])) for x in lines], schema).withColumn("info_text", F.lit(""))
    keyed = spark.createDataFrame([*texts.items()], "pattern string, calls_text string")
    packed = [store.packed_calls(vcf(lambda k: k), keyed), store.packed_calls(vcf(texts.get))]
    short, whole = (rows(hp.Coded(s.select("chrom", "pos", "pattern"), c).at_sites(c)) for s, c in packed)
    assert short == whole and len(whole) == 3
    spread = qs.spread_calls(packed[0][0], keyed, ["s1", "s2"])
    assert sorted(map(tuple, spread.collect())) == [(1, 10, "s1", 0, 1), (1, 10, "s2", 1, 1), (1, 20, "s1", 0, 1), (1, 20, "s2", 1, 1), (2, 10, "s1", 1, 0), (2, 10, "s2", 0, 0)]


def test_long_digits_are_packed_in_one_pass(spark):
    r = random.Random(1)
    texts = ["".join(r.choices("01", k=n)) for n in (0, 1, 63, 64, 65, 128, 1_000, 200_001)]
    found = spark.createDataFrame([(t,) for t in texts], "d string").select("d", hp.pack_digits(F.col("d")).alias("w"))
    assert "substring(" not in found._jdf.queryExecution().optimizedPlan().toString()  # a search from the string's start for each word
    for t, words in found.collect():
        whole = t.ljust(-(-len(t) // 64) * 64, "0")
        assert [w % 2**64 for w in words] == [int(whole[i : i + 64], 2) for i in range(0, len(whole), 64)]


def test_info_tags(spark):
    texts = {"VT=SNP;M;AA=x": {"VT": "SNP", "M": None, "AA": "x"}, "A=1;A=2;B": {"A": "1", "B": None}, "": {}, ";;": {}, "A=;B==x=y;C": {"A": "", "B": "=x=y", "C": None}, "A;A=3": {"A": None}, "=5;;x": {"": "5", "x": None}}
    found = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", sc.info_map(F.col("t")).alias("m")).collect()
    assert {r["t"]: r["m"] for r in found} == texts | {None: None}
