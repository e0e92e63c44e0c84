import math
from itertools import combinations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinweave.operators import blocks as blk
from kinweave.operators import observed as ob
from kinweave.sources import readers as rd
from kinweave.streaming import pileup as st


def lines(spark, *text):
    return rd.parse_pileup(spark.createDataFrame([("\t".join(t.split()),) for t in text], "value string"))


def bases(spark, bases_, quals, ref="C", **options):
    pile = spark.createDataFrame([(1, 1, ref, [(0, 1, bases_, quals)])], "chrom int, pos long, ref string, samples array<struct<sample:int,depth:int,bases:string,quals:string>>")
    rows = rd.explode_reads(pile, **options).orderBy("read_ix").collect()
    return "".join(r["base"] for r in rows), [r["phred"] for r in rows]


def test_tokens(spark):
    assert bases(spark, ",.Aa", "AAAA") == ("CCAA", [32] * 4)
    assert bases(spark, "^F.,$G", "A5J") == ("CCG", [32, 20, 41])
    assert bases(spark, "g$^]*t", "AB") == ("GT", [32, 33])
    assert bases(spark, "*A", "AB") == ("A", [32])
    assert bases(spark, "*A", "AB", consider_dels=True) == ("*A", [32, 33])
    assert bases(spark, "*A", "AB", dels_have_quality=True) == ("A", [33])
    assert bases(spark, ".+2ACt-12ACGTACGTACGT,", "ABC") == ("CTC", [32, 33, 34])
    assert bases(spark, ".+1*g", "AB") == ("CG", [32, 33])
    assert bases(spark, ".-61" + "A" * 61 + "t^+g+200" + "C" * 200 + "$", "ABC") == ("CTG", [32, 33, 34])
    for wrong, quals in ((">", "A"), ("AA", "A"), ("A?", "AA"), ("A+5AC", "A"), ("A+", "A")):
        with pytest.raises(PySparkException):
            bases(spark, wrong, quals)


def test_parse_line(spark):
    got = lines(spark, "chrX 22 r 1 . A 0 * *", "22 5 a 2 ,, AB 1 T J").collect()
    assert [(r["chrom"], r["pos"], r["ref"], len(r["samples"])) for r in got] == [(88, 22, "N", 2), (22, 5, "A", 2)]
    assert tuple(got[1]["samples"][1]) == (1, 1, "T", "J")


def plain_pair(a, b):
    return sum(x != y for x in a for y in b) / (len(a) * len(b))


def test_mismatch(spark):
    pile = lines(spark, "1 10 C 4 TTCC JJJJ 2 CC AA", "1 20 A 3 AAC JJA 3 CCA JJJ", "1 30 A 0 * * 1 A J", "2 5 G 1 G ! 1 G J")
    obs = ob.filter_quality(rd.explode_reads(pile))
    samples = ob.sample_table(obs, [0, 1])
    got = {(r["chrom"], r["pos"]): r for r in ob.pair_sites(obs, samples).collect()}
    assert set(got) == {(1, 10), (1, 20)}
    assert got[1, 10]["pwd"] == plain_pair("TTCC", "CC") == 0.5
    assert got[1, 20]["pwd"] == pytest.approx(plain_pair("AAC", "CCA"))
    both = {(r["pair"], r["pos"]): r for r in ob.pair_sites(obs, samples, self_comparison=True).filter("is_self").collect()}
    for pair, pos, reads, quals in (("Ind0-Ind0", 10, "TTCC", [41] * 4), ("Ind0-Ind0", 20, "AAC", [41, 41, 32]), ("Ind1-Ind1", 20, "CCA", [41] * 3)):
        r, n = both[pair, pos], math.comb(len(reads), 2)
        assert r["pwd"] == pytest.approx(sum(x != y for x, y in combinations(reads, 2)) / n)
        assert (r["q0"], r["q1"]) == tuple(pytest.approx(sum(c[i] for c in combinations(quals, 2)) / n) for i in (0, 1))
    assert ob.pair_arrays(ob.site_counts(obs), samples).count() == 2
    assert ob.filter_sites(pile, ob.pair_join(ob.site_counts(obs), samples)).count() == 2


def test_summary_of_one_site(spark):
    one = spark.createDataFrame([("a-b", 0.5, 30.0, 40.0)], "pair string, pwd double, q0 double, q1 double")
    r = ob.pair_summary(one).first()
    assert (r["overlap"], r["sum_pwd"], r["avg_phred"]) == (1, 0.5, 35.0) and math.isnan(r["ci95"])


def test_samples_and_depth(spark):
    obs = spark.createDataFrame([(1, 1, s, i, "A", 40) for s in (0, 1) for i in range(s + 1)], "chrom int, pos long, sample int, read_ix int, base string, phred int")
    assert [tuple(r) for r in ob.sample_table(obs, [0, 1], ["x"], [2]).orderBy("sample").collect()] == [(0, "x", 2), (1, "Ind1", 2)]
    with pytest.raises(PySparkException):
        ob.sample_table(obs, [0, 7]).collect()
    assert ob.filter_depth(ob.site_counts(obs), ob.sample_table(obs, [0, 1], (), [2])).count() == 1


@pytest.mark.parametrize(("length", "size", "want"), [(249250621, 1_000_000, 250), (10, 3, [(1, 4), (4, 7), (7, 10)]), (9, 3, [(1, 4), (4, 7), (7, 9)]), (11, 3, [(1, 4), (4, 7), (7, 10), (10, 11)]), (2, 3, [(1, 2)])])
def test_blocks(spark, length, size, want):
    grid = [(r["start"], r["end"]) for r in blk.block_grid(spark.createDataFrame([(1, length)], "chrom int, length long"), size).orderBy("start").collect()]
    assert len(grid) == want if isinstance(want, int) else grid == want
    if length < 100:
        pos = spark.range(1, length + 1).select(F.lit("p").alias("pair"), F.lit(1).alias("chrom"), F.col("id").alias("pos"), F.lit(0.5).alias("pwd"))
        blocks = blk.block_summary(pos, spark.createDataFrame([(1, length)], "chrom int, length long"), size).collect()
        assert sum(r["sites"] for r in blocks) == length and len(blocks) == len(grid)


def test_jackknife_of_equal_blocks(spark):
    rows = [("p", 1, 3 * b + 1, 1.0) for b in range(4) for _ in range(2)]
    found = blk.jackknife(blk.block_summary(spark.createDataFrame(rows, "pair string, chrom int, pos long, pwd double"), spark.createDataFrame([(1, 12)], "chrom int, length long"), 3)).first()
    assert found["estimate"] == pytest.approx(1.0) and found["variance"] == pytest.approx(4 * (0.25 - 1) ** 2 / 3 / 4)


def test_line_pairs_equal_batch(spark):
    pile = lines(spark, "1 10 C 4 TTCC JJJJ 2 CC AA 0 * *", "1 20 A 3 AA+2ACC JJA 3 CC^FA$ JJJ 1 T J")
    obs = ob.filter_quality(rd.explode_reads(pile))
    want = ob.pair_join(ob.site_counts(obs), ob.sample_table(obs, [0, 1, 2]))
    columns = ["pair", "chrom", "pos", "num", "den", "pwd", "q0", "q1"]
    key = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert key(st.line_pairs(pile)) == key(want)


#: With and without the second sample's deletion.
FIRST = {False: (4, 4, 40.0, 40.0), True: (6, 6, 40.0, 40.0)}


def test_line_pairs_of_odd_lines(spark):
    """Low and missing qualities, indels, no reads, deletions; each read is looked at by two lambdas and not by nine."""
    lines = ["1\t5\ta\t3\t^F.,T$\tI#I\t2\t*C+2ACg\tIII\t0\t*\t*", "X\t9\tN\t4\t..,A\tII\t1\t-1Ag\tI\t2\tTt\t?>", "2\t7\tC\t2\t..\t>>\t2\tAA\tII\t1\t.\tI"]
    pile = rd.parse_pileup(spark.createDataFrame([(x,) for x in lines], "value string"))
    for dels in (False, True):
        got = {(r["pair"], r["chrom"], r["pos"]): (r["num"], r["den"], r["q0"], r["q1"]) for r in st.line_pairs(pile, consider_dels=dels).collect()}
        assert got[("Ind0-Ind1", 1, 5)] == FIRST[dels] and got[("Ind0-Ind1", 88, 9)] == (2, 2, 40.0, 40.0)
        assert got[("Ind0-Ind2", 88, 9)] == (2, 2, 40.0, 30.0) and got[("Ind1-Ind2", 2, 7)] == (2, 2, 40.0, 40.0) and len(got) == 5
    plan = st.line_pairs(pile)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(split(" in plan and "named_struct(base" not in plan
    for bad, word in ((">", "reference skip"), ("Q", "not an allele")):
        skip = rd.parse_pileup(spark.createDataFrame([(f"1\t5\tA\t1\t{bad}\tI\t1\tA\tI",)], "value string"))
        try:
            st.line_pairs(skip).collect()
        except Exception as e:
            assert word in str(e)
        else:
            raise AssertionError(bad)
