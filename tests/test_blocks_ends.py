"""Sites beyond the end of their chromosome."""

from kinweave.operators import blocks as blk
from kinweave.operators import products as pr
from kinweave.streaming import pileup as st


def test_no_block_beyond_the_end(spark):
    """A site behind the last position of its chromosome, or on an unknown one, is in no block; its pair stays."""
    genome = spark.createDataFrame([(1, 250), (2, 201)], "chrom int, length long")
    rows = [("a", 1, 250), ("a", 1, 251), ("a", 1, 9_000), ("a", 2, 201), ("a", 2, 202), ("b", 1, 300)]
    sites = spark.createDataFrame([(*r, 0.5) for r in rows], "pair string, chrom int, pos long, pwd double")
    found = {(r["pair"], r["chrom"], r["start"]): (r["sites"], r["pwd"]) for r in blk.block_summary(sites, genome, 100).collect()}
    held = {k: v for k, v in found.items() if v[0]}
    assert held == {("a", 1, 201): (1, 0.5), ("a", 2, 101): (1, 0.5)} and len(found) == 10
    assert sorted(tuple(r) for r in st.running_blocks(sites, genome, 100).collect()) == [("a", 1, 201, 1, 0.5), ("a", 2, 101, 1, 0.5)]


def test_products_beyond_the_end(spark):
    genome = spark.createDataFrame([(1, 250)], "chrom int, length long")
    reads = [(1, p, s, "A", 30) for p, who in ((250, (0, 1)), (251, (0, 1)), (400, (0, 1, 2))) for s in who] + [(7, 5, 0, "A", 30), (7, 5, 2, "C", 30)]
    obs = spark.createDataFrame(reads, "chrom int, pos long, sample int, base string, phred int")
    people = spark.createDataFrame([(s, f"Ind{s}", 1) for s in range(3)], "sample int, name string, min_depth int")
    blocks = pr.product_blocks(pr.pair_products(obs, people, genome, 100), genome, 100)
    found = {(r["pair"], r["start"]): r["sites"] for r in blocks.collect()}
    assert found == {(p, s): int((p, s) == ("Ind0-Ind1", 201)) for p in ("Ind0-Ind1", "Ind0-Ind2", "Ind1-Ind2") for s in (1, 101, 201)}
