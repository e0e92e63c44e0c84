"""Panel side: site filters, genotype and frequency stores' contents, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import info_afs, round4

SITE = ["chrom", "pos"]


def drop_duplicate_sites(sites: DataFrame) -> DataFrame:
    """All copies of a repeated coordinate go; judged before any other filter, on the coordinates alone."""
    repeated = sites.groupBy(*SITE).agg(F.count("*").alias("__n")).filter("__n > 1").select(*SITE)
    return sites.join(repeated, SITE, "left_anti")


def filter_biallelic_snps(sites: DataFrame) -> DataFrame:
    """No MULTI_ALLELIC flag and a VT of SNP exactly; a record without VT fails."""
    vt = F.try_element_at("info", F.lit("VT"))
    missing = F.raise_error(F.concat(F.lit("no VT tag at "), F.concat_ws(":", *SITE))).cast("boolean")
    snp = F.when(vt.isNull(), missing).otherwise(vt == "SNP")
    return sites.filter(~F.map_contains_key("info", "MULTI_ALLELIC") & snp)


def info_frequencies(vcf: DataFrame, info_col: str = "info_text") -> DataFrame:
    """(chrom, pos, grp, af) of the frequency tags of each record."""
    return vcf.select(*SITE, F.explode(info_afs(F.col(info_col))).alias("x")).select(*SITE, "x.grp", "x.af")


def compute_afs(genotypes: DataFrame, panel: DataFrame) -> DataFrame:
    """(chrom, pos, grp, af): share of alternate alleles in each group, to four decimals."""
    joined = genotypes.join(F.broadcast(panel.select("sample", "grp").distinct()), "sample")
    share = F.sum(F.col("a0") + F.col("a1")) / (2 * F.count("*"))
    return joined.groupBy(*SITE, "grp").agg(round4(share).cast("float").alias("af"))


def site_haps(genotypes: DataFrame, index: DataFrame) -> DataFrame:
    """(chrom, pos, haps): per site the alleles of all panel samples, haps[2 * idx + strand]. index: (sample, idx)."""
    cells = genotypes.join(F.broadcast(index), "sample").select(*SITE, F.struct("idx", F.col("a0").cast("tinyint").alias("a0"), F.col("a1").cast("tinyint").alias("a1")).alias("c"))
    ordered = cells.groupBy(*SITE).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return ordered.select(*SITE, F.flatten(F.transform("cs", lambda c: F.array(c["a0"], c["a1"]))).alias("haps"))


def panel_index(panel: DataFrame) -> DataFrame:
    """(sample, idx): samples numbered by name. A panel has at most some thousand rows."""
    return panel.select("sample").distinct().select("sample", (F.row_number().over(W.orderBy("sample")) - 1).alias("idx"))


def sample_groups(panel: DataFrame) -> DataFrame:
    return panel.groupBy("sample").agg(F.array_sort(F.collect_set("grp")).alias("grps"))


def panel_members(panel: DataFrame, grp: str) -> DataFrame:
    return panel.filter(F.col("grp") == grp).select("sample", "sex").distinct()


def subset_panel(panel: DataFrame, groups: Sequence[str]) -> DataFrame:
    return panel.filter(F.col("grp").isin(*groups))


def attach_genotypes(sites: DataFrame, store: DataFrame) -> DataFrame:
    """sites with the store's row at their coordinate, whole, for each row of sites; see ``haplotypes.attach_nested`` for
    pairs, whose sites then meet the store once."""
    return sites.join(store, SITE)


def attach_freq(sites: DataFrame, freqs: DataFrame, grp: str) -> DataFrame:
    return sites.join(freqs.filter(F.col("grp") == grp).select(*SITE, "af"), SITE)


def missing_sites(sites: DataFrame, store: DataFrame) -> DataFrame:
    """(pair, missing): how many of a pair's sites the store lacks; pairs that lack none are left out."""
    return sites.join(store.select(*SITE), SITE, "left_anti").groupBy("pair").agg(F.count("*").alias("missing"))


def filter_maf(df: DataFrame, freqs: DataFrame, grp: str, least: float) -> DataFrame:
    """Rows whose site has a group frequency of ``least`` to 1 - ``least``."""
    kept = freqs.filter((F.col("grp") == grp) & (F.col("af") >= least) & (F.col("af") <= 1 - least))
    return df.join(kept.select(*SITE), SITE, "left_semi")


def failed_maf(freqs: DataFrame, grp: str, least: float) -> DataFrame:
    return freqs.filter((F.col("grp") == grp) & ((F.col("af") < least) | (F.col("af") > 1 - least))).select(*SITE)


def correct_pair_sites(sites: DataFrame, failed: DataFrame) -> DataFrame:
    """The observed side without the sites that failed on the panel's side."""
    return sites.join(failed.select(*SITE), SITE, "left_anti")
