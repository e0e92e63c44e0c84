import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinweave.functions import scalar as sc
from kinweave.operators import observed as ob
from kinweave.operators import panel as pn
from kinweave.sources import readers as rd
from kinweave.sources import sinks, store
from kinweave.sources.scratch import scratch


def file(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("name", "text"), [
    ("a.snp", "rs1 1 0.0 100 A T\n rs2  23 0.1 7 c G\nrs3 1 0.0 100 G C\n"),
    ("a.vcf", "##x\n#CHROM\n1\t100\t.\tA\tT\nchrX\t7\t.\tC\tG\n1\t100\t.\tG\tC\n"),
    ("a.tsv", "1\t100\tA\tT\nX\t7\tC\tG\n"), ("a.csv", "1,100,A,T\nX,7,C,G\n1,100,C,C\n"), ("a.txt", "1 100 A T\nX  7 C G\n\n"),
])
def test_targets(spark, tmp_path, name, text):
    assert values(rd.read_targets(spark, file(tmp_path, name, text))) == [(1, 100, "A", "T"), (88, 7, "C", "G")]


def test_transitions(spark):
    rows = spark.createDataFrame([(1, 1, "A", "G"), (1, 2, "A", "C")], "chrom int, pos long, ref string, alt string")
    assert values(ob.exclude_transitions(rows)) == [(1, 2, "A", "C")]
    with pytest.raises(PySparkException):
        ob.exclude_transitions(spark.createDataFrame([(1, 1, "N", "G")], rows.schema)).collect()


def test_panel(spark, tmp_path):
    path = file(tmp_path, "x.panel", "s1\tFIN\tEUR\tmale\n\ns2\tACB\tAFR\n")
    assert values(rd.read_panel(spark, path)) == [("s1", "EUR", "male"), ("s1", "FIN", "male"), ("s2", "ACB", "unknown"), ("s2", "AFR", "unknown")]
    assert rd.find_panel(spark, str(tmp_path)).endswith("x.panel")
    file(tmp_path, "y.panel", "s\tA\tB\n")
    with pytest.raises(ValueError):
        rd.find_panel(spark, str(tmp_path))
    with pytest.raises(ValueError):
        rd.find_inputs(spark, str(tmp_path))
    with pytest.raises(PySparkException):
        rd.read_panel(spark, file(tmp_path, "z.txt", "s1\tFIN\n")).collect()


def test_genome_and_map(spark, tmp_path):
    assert values(rd.read_genome(spark, file(tmp_path, "g.fai", "1\t249\t5\t6\t7\nchrX\t155\t0\nGL000\t1\n"))) == [(1, 249), (88, 155)]
    assert rd.genome_for(rd.read_genome(spark)).count() == 22 and rd.genome_for(rd.read_genome(spark), True).first()["length"] == 155270560
    folder = tmp_path / "maps"
    folder.mkdir()
    (folder / "a.txt").write_text("Chromosome\tPosition(bp)\tRate(cM/Mb)\tMap(cM)\nchr1\t100\t2.5\t0\nchr1\t250\t1.5\t0\n")
    (folder / "b.txt").write_text("Chromosome\tPosition(bp)\tRate(cM/Mb)\tMap(cM)\nchrX_par1\t10\t1\t0\nchrX\t30\t2\t0\n")
    assert values(rd.read_genetic_map(spark, str(folder))) == [(1, 0, 100, 2.5), (1, 100, 250, 1.5), (88, 0, 10, 1.0), (88, 10, 30, 2.0)]


VCF = """##fileformat=VCFv4.1
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
1\t10\t.\tA\tC\t.\t.\tVT=SNP;EUR_AF=0.25;AFR_AF=0.5\tGT\t0|1\t1|1
1\t20\t.\tA\tC\t.\t.\tMULTI_ALLELIC;VT=SNP;EUR_AF=0.1\tGT\t0|0\t0|0
1\t30\t.\tA\tC\t.\t.\tVT=SNP\tGT\t0|0\t0|0
1\t30\t.\tA\tCT\t.\t.\tVT=INDEL\tGT\t0|0\t0|0
X\t40\t.\tA\tC\t.\t.\tVT=SNP;EUR_AF=0.75\tGT\t1\t0|1
"""


def test_store(spark, tmp_path):
    vcf, header = rd.read_vcf(spark, file(tmp_path, "v.vcf", VCF)), rd.vcf_header(spark, file(tmp_path, "v.vcf", VCF))
    assert header == ["s1", "s2"]
    panel = rd.read_panel(spark, file(tmp_path, "p.panel", "s1\tFIN\tEUR\tmale\ns2\tACB\tAFR\tfemale\n"))
    out = scratch(spark, "store")
    store.build_panel_store(vcf, header, panel, out)
    assert values(store.read_panel_store(spark, out, "genotypes").select("chrom", "pos", "sample", "a0", "a1")) == [(1, 10, "s1", 0, 1), (1, 10, "s2", 1, 1), (88, 40, "s1", 1, 1), (88, 40, "s2", 0, 1)]
    assert values(store.read_panel_store(spark, out).select("chrom", "pos", "haps")) == [(1, 10, [0, 1, 1, 1]), (88, 40, [1, 1, 0, 1])]
    assert values(store.read_panel_store(spark, out, "freqs", [1]).select("pos", "grp", "af")) == [(10, "AFR", 0.5), (10, "EUR", 0.25)]
    assert values(store.store_chroms(spark, out)) == [(1,), (88,)]
    assert values(rd.read_panel(spark, f"{out}/panel")) == values(panel)
    with pytest.raises(PySparkException):
        store.build_panel_store(vcf, header, panel, out)
    with pytest.raises(PySparkException):
        store.read_panel_store(spark, str(tmp_path), "freqs")
    afs = pn.compute_afs(store.read_panel_store(spark, out, "genotypes"), panel)
    assert values(afs.filter("chrom = 1").select("grp", "af")) == [("ACB", 1.0), ("AFR", 1.0), ("EUR", 0.5), ("FIN", 0.5)]


def test_vcf_failures(spark, tmp_path):
    head = "\n".join(VCF.split("\n")[:2]) + "\n1\t5\t.\tA\tC\t.\t.\t"
    with pytest.raises(PySparkException):
        pn.filter_biallelic_snps(rd.read_vcf(spark, file(tmp_path, "a.vcf", head + "AA=1\tGT\t0|0\t0|0\n"))).collect()
    with pytest.raises(PySparkException):
        pn.info_frequencies(rd.read_vcf(spark, file(tmp_path, "b.vcf", head + "VT=SNP;EUR_AF=1;EUR_AF=0\tGT\t0|0\t0|0\n"))).collect()
    with pytest.raises(PySparkException):
        rd.vcf_genotypes(rd.read_vcf(spark, file(tmp_path, "c.vcf", head + "VT=SNP\tGT\t0/0\t0|0\n")), ["s1", "s2"]).collect()


STANDARD = "# tree\niid fid mid sex # head\nf 0 0 1\nm 0 0 2\n\nc f m 1\nCOMPARE Unrelated f m\nCOMPARE Child f c # end\n"
SECTIONS = "INDIVIDUALS\nf\nm\nc\nRELATIONSHIPS\nc=repro(f, m)\nCOMPARISONS\nUnrelated=compare(f,m) # x\nChild=compare(f, c)\n"


def test_pedigrees(spark, tmp_path):
    tree, cmp = rd.read_pedigree(spark, file(tmp_path, "a.ped", STANDARD))
    assert values(tree) == [("c", "f", "m", "male"), ("f", None, None, "male"), ("m", None, None, "female")]
    assert values(cmp) == [(0, "Unrelated", "f", "m"), (1, "Child", "f", "c")]
    tree2, cmp2 = rd.read_pedigree(spark, file(tmp_path, "b.txt", SECTIONS))
    assert values(tree2.drop("sex")) == values(tree.drop("sex")) and values(cmp2) == values(cmp)
    for text in ("f 0 0\nm 0 0\nc f m\n", "1 f 0 0 1 9\n1 m 0 0 2 9\n1 c f m 1 9\n"):
        assert values(rd.read_pedigree(spark, file(tmp_path, "c.ped", text))[0].drop("sex")) == values(tree.drop("sex"))


def test_scalars(spark):
    row = lambda *c: tuple(spark.range(1).select(*c).first())
    assert row(*(sc.chrom_id(F.lit(x)) for x in ("chr7", "X", "X_par2", "GL1", "300"))) == (7, 88, 88, None, None)
    assert row(sc.expand_ranges(F.lit("0-3 7 2")), sc.expand_ranges(F.lit("21-22 X"))) == ([0, 1, 2, 3, 7], [21, 22, 88])
    assert row(sc.rate_spec(F.lit("2")), sc.rate_spec(F.lit("1-3"))) == ((0.02, 0.02), (0.01, 0.03))
    for bad in (sc.rate_spec(F.lit("1-300")), sc.rate_spec(F.lit("-")), sc.allele(F.lit("R")), sc.allele(F.lit("!")), sc.decode_gt(F.lit("0/1"))["a0"]):
        with pytest.raises(PySparkException):
            row(bad)
    assert 0 <= row(sc.u01(1, "s", F.lit(3)))[0] < 1


def test_sinks(spark, tmp_path):
    summary = spark.createDataFrame([("b", 2, 1.25, 0.5, 0.1, 30.0), ("a", 1, 0.0, 0.0, float("nan"), 40.0)], "pair string, overlap long, sum_pwd double, avg_pwd double, ci95 double, avg_phred double")
    path = scratch(spark, "pwd")
    sinks.write_pwd(summary, path)
    assert [r["value"] for r in spark.read.text(path).collect()][0] == "Pair_name\tRaw.Overlap\tRaw.Sum.PWD\tRaw.Avg.PWD\tRaw.CI.95\tRaw.Avg.Phred"
    with pytest.raises(PySparkException):
        sinks.write_pwd(summary, path)
    sinks.write_pwd(summary, path, "overwrite")
    classes = spark.createDataFrame([("p", "x", 1, 0.3), ("p", "y", 0, 0.7)], "pair string, label string, rank int, p double")
    assert sinks.probs_rows(classes).columns == ["pair", "y", "x"]


def test_broken_map_lines(spark, tmp_path):
    """A header is skipped whatever it says; any other line that can't be read fails, or is returned."""
    folder = tmp_path / "maps"
    folder.mkdir()
    (folder / "a.TXT").write_text("chr1\t1\t1\t1\nchr1\t100\t2.5\t0\nchrQ\t200\t1\t0\nchr1\tx5\t1\t0\n\nchr1\t300\tz\t0\nchr1\n")
    (folder / "b.txt").write_text("Chromosome\tPosition\tRate\tMap\n")
    (folder / "c.map").write_text("chr1\t1\t1\t1\nbroken\n")
    with pytest.raises(Exception, match="not a line of a genetic map"):
        rd.read_genetic_map(spark, str(folder)).collect()
    assert values(rd.read_genetic_map(spark, str(folder), strict=False)) == [(1, 0, 100, 2.5)]
    assert sorted(r["line"] for r in rd.rejected_map_lines(spark, str(folder)).collect()) == ["chr1", "chr1\t300\tz\t0", "chr1\tx5\t1\t0", "chrQ\t200\t1\t0"]
