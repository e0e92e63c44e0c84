"""Haplotypes of a panel as bitmaps: a site is one row with a bit for each haplotype.

A ``Coded`` panel holds each distinct bitmap once, as a pattern with a key, and sites with their pattern's key. What follows
from a bitmap alone is worked out once a pattern; where a row needs single bits, patterns meet it last.

Bit ``2 * idx + strand`` of a site is the allele of the panel's sample ``idx``, the first bit of a word being its highest.
A population is a mask, so its alternate frequency is the number of bits of ``bits & mask``: a projection of the site's
row, with no row a call and no shuffle. Genotypes and arrays of alleles are unnested where somebody asks for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import decode_gt, round4

SITE = ["chrom", "pos"]
WORD = 64
#: Sites of a pattern that are unnested together.
TOGETHER = 1000


@dataclass(frozen=True)
class Coded:
    """sites: (chrom, pos, pattern); patterns: (pattern, bits), a row for each pattern."""

    sites: DataFrame
    patterns: DataFrame

    def at_sites(self, rows: DataFrame) -> DataFrame:
        """(chrom, pos, the other columns) of rows with ``pattern``, for each site."""
        rest = [c for c in rows.columns if c != "pattern"]
        return self.sites.join(rows, "pattern").select(*SITE, *rest)

    def spread(self, rows: DataFrame, unnest: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(chrom, pos, the other columns) of ``unnest(rows)``, for each site, where a pattern has many rows, such as a call of
        each sample. Patterns are shuffled nested, as ``rows`` has them, and dealt to tasks by TOGETHER of their sites; a task
        unnests a pattern and repeats each of its rows for the sites. ``unnest`` keeps columns that it doesn't know."""
        spark, place = self.sites.sparkSession, F.row_number().over(W.partitionBy("pattern").orderBy(*SITE)) - 1
        placed = self.sites.select(*SITE, "pattern", F.floor(place / TOGETHER).alias("__part"))
        parts = placed.groupBy("pattern", "__part").agg(F.collect_list(F.struct(*SITE)).alias("__sites"))
        dealt = parts.join(rows, "pattern").repartition(8 * spark.sparkContext.defaultParallelism, "pattern", "__part")
        each = unnest(dealt.drop("pattern", "__part"))
        return each.select(F.inline("__sites"), *(c for c in each.columns if c != "__sites"))

    def reduced(self, **columns: Column) -> DataFrame:
        """(chrom, pos, columns), of which each is worked out once a pattern."""
        return self.at_sites(self.patterns.select("pattern", *(c.alias(n) for n, c in columns.items())))


def coded(panel: DataFrame | Coded) -> Coded:
    """A panel of bitmaps by site as a coded one, in which each site is a pattern of its own."""
    if isinstance(panel, Coded):
        return panel
    key = F.struct(*SITE).alias("pattern")
    return Coded(panel.select(*SITE, key), panel.select(key, "bits"))


def meet(rows: DataFrame, panel: DataFrame | Coded) -> DataFrame:
    """rows with ``bits`` of their coordinate. Bits of a coded panel are joined last and travel with no row."""
    if isinstance(panel, Coded):
        return rows.join(panel.sites, SITE).join(panel.patterns, "pattern").drop("pattern")
    return rows.join(panel, SITE)


def _keys(bitmaps: DataFrame) -> list[str]:
    return [c for c in bitmaps.columns if c != "bits"]


def pack_digits(digits: Column) -> Column:
    """A string of 0 and 1 as an array of 64-bit words; the last word is filled up with zeros. The string is cut up in one pass:
    to look for each word's place in it would take the square of its length."""
    words = F.regexp_extract_all(digits, F.lit(f".{{1,{WORD}}}"), F.lit(0))
    none = F.array().cast("array<long>")
    return F.when(digits != "", F.transform(words, lambda w: F.conv(F.rpad(w, WORD, "0"), 2, -10).cast("long"))).otherwise(none)


def call_digits(calls: Column, joined: Column) -> Column:
    """The alleles of calls (``a|b``, or ``a`` for both strands, further fields behind a colon) as digits; fails at any
    other call. ``joined`` is all calls in one text: only sites whose calls aren't all ``a|b`` look at them one by one."""
    each = F.transform(calls, lambda c: decode_gt(F.substring_index(c, ":", 1)))
    slow = F.array_join(F.transform(each, lambda g: F.concat(g["a0"].cast("string"), g["a1"].cast("string"))), "")
    return F.when(joined.rlike(r"^(?:[01]\|[01])*$"), F.replace(joined, F.lit("|"), F.lit(""))).otherwise(slow)


def site_bitmaps(vcf: DataFrame, order: DataFrame) -> DataFrame:
    """(chrom, pos, bits) of biallelic sites with ``calls``; rows with ``pattern`` have that key instead. order: (at, idx), the place of a panel sample's call among
    the calls; a few thousand rows, which become one array."""
    one = order.agg(F.array_sort(F.collect_list(F.struct("idx", "at"))).alias("__order"))
    placed = vcf.join(F.broadcast(one), F.lit(True))
    keys = ["pattern"] if "pattern" in vcf.columns else SITE
    # A column for each step: an expression within a lambda function would be worked out for every word.
    ordered = placed.select(*keys, F.transform("__order", lambda o: F.element_at("calls", o["at"] + 1)).alias("__calls"))
    joined = ordered.select(*keys, "__calls", F.array_join("__calls", "").alias("__joined"))
    digits = joined.select(*keys, call_digits(F.col("__calls"), F.col("__joined")).alias("__digits"))
    return digits.select(*keys, pack_digits(F.col("__digits")).alias("bits"))


def allele(bits: Column, haplotype: Column) -> Column:
    """The allele of one haplotype; null outside the bitmap."""
    word = F.get(bits, (haplotype / WORD).cast("int"))
    return F.call_function("shiftright", word, (WORD - 1 - haplotype % WORD).cast("int")).bitwiseAND(F.lit(1)).cast("int")


def alternates(bits: Column) -> Column:
    """How many haplotypes carry the alternate allele."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def unpack(bits: Column, size: Column) -> Column:
    """The first ``size`` alleles as an array."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda h: allele(bits, h).cast("tinyint"))


def masks(panel: DataFrame, index: DataFrame) -> DataFrame:
    """(grp, mask, size): the haplotypes of each group. panel: (sample, grp); index: (sample, idx)."""
    rows = panel.select("sample", "grp").distinct().join(F.broadcast(index), "sample")
    # The two strands of a sample lie in one word, at an even place.
    both = F.call_function("shiftleft", F.lit(3).cast("long"), (WORD - 2 - F.col("idx") * 2 % WORD).cast("int"))
    words = rows.groupBy("grp", (F.col("idx") * 2 / WORD).cast("int").alias("word")).agg(F.bit_or(both).alias("mask"), F.count("*").alias("n"))
    whole = words.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"), F.max("word").alias("last"), F.sum("n").alias("n"))
    filled = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return whole.select("grp", filled.alias("mask"), (2 * F.col("n")).alias("size"))


def bit_frequencies(bitmaps: DataFrame, group_masks: DataFrame) -> DataFrame:
    """(chrom, pos, grp, af): share of alternate alleles in each group, to four decimals. The masks (one row a population)
    become one broadcast row. As in the next two, whatever keys the bitmaps have stay (patterns' as well as sites')."""
    one = group_masks.agg(F.array_sort(F.collect_list(F.struct("grp", "mask", "size"))).alias("__masks"))

    def share(m: Column) -> Column:
        # zip_with pads the shorter mask with null, which counts nothing
        common = F.aggregate(F.zip_with("bits", m["mask"], lambda b, w: F.coalesce(F.bit_count(b.bitwiseAND(w)), F.lit(0))), F.lit(0), lambda n, k: n + k)
        return round4(common / m["size"]).cast("float")

    each = F.transform("__masks", lambda m: F.struct(m["grp"].alias("grp"), share(m).alias("af")))
    return bitmaps.join(F.broadcast(one), F.lit(True)).select(*_keys(bitmaps), F.inline(each))


def genotypes(bitmaps: DataFrame, index: DataFrame) -> DataFrame:
    """(chrom, pos, sample, a0, a1), a row for each call."""
    one = index.agg(F.array_sort(F.collect_list(F.struct("idx", "sample"))).alias("__index"))
    call = lambda i: F.struct(i["sample"].alias("sample"), allele(F.col("bits"), i["idx"] * 2).alias("a0"), allele(F.col("bits"), i["idx"] * 2 + 1).alias("a1"))
    return bitmaps.join(F.broadcast(one), F.lit(True)).select(*_keys(bitmaps), F.inline(F.transform("__index", call)))


def haplotype_arrays(bitmaps: DataFrame, index: DataFrame) -> DataFrame:
    """(chrom, pos, haps): the alleles of all panel samples as an array, haps[2 * idx + strand]."""
    n = index.agg((F.count("*") * 2).cast("int").alias("__n"))
    return bitmaps.join(F.broadcast(n), F.lit(True)).select(*_keys(bitmaps), unpack(F.col("bits"), F.col("__n")).alias("haps"))


# Pairs nested by site


def nest_pairs(sites: DataFrame) -> DataFrame:
    """(chrom, pos, pairs): one row a site with the rows of its pairs, so that what is known of a site is joined once."""
    rest = [c for c in sites.columns if c not in SITE]
    return sites.groupBy(*SITE).agg(F.collect_list(F.struct(*rest)).alias("pairs"))


def unnest_pairs(nested: DataFrame) -> DataFrame:
    """A row for each pair of a site, with the other columns of the site's row."""
    rest = [c for c in nested.columns if c != "pairs"]
    return nested.select(*rest, F.explode("pairs").alias("__pair")).select("__pair.*", *rest)


def _sides(contaminants: DataFrame, index: DataFrame) -> DataFrame:
    """(pair, ids0, ids1): panel indices of each side's contaminants, a sample drawn twice being there twice."""
    own = contaminants.join(F.broadcast(index), "sample").groupBy("pair", "side").agg(F.collect_list("idx").alias("ids"))
    return own.groupBy("pair").agg(*(F.max(F.when(F.col("side") == k, F.col("ids"))).alias(f"ids{k}") for k in (0, 1)))


def _share(ids: Column) -> Column:
    """The share of alternate alleles among samples of the row's ``bits``."""
    count = lambda i: allele(F.col("bits"), i * 2) + allele(F.col("bits"), i * 2 + 1)
    return F.aggregate(ids, F.lit(0), lambda n, i: n + count(i)) / (2 * F.size(ids))


def contaminant_shares(panel: Coded, contaminants: DataFrame, index: DataFrame) -> DataFrame:
    """(pair, pattern, caf0, caf1): the same as ``nested_contaminants`` once for each pattern and pair, not for each site."""
    each = panel.patterns.crossJoin(_sides(contaminants, index))
    return each.select("pair", "pattern", *(_share(F.col(f"ids{k}")).alias(f"caf{k}") for k in (0, 1)))


def nested_contaminants(sites: DataFrame, bitmaps: DataFrame | Coded, contaminants: DataFrame, index: DataFrame) -> DataFrame:
    """(pair, chrom, pos, caf0, caf1): share of alternate alleles among each side's contaminants, worked out on the one
    row that a site has, so only two numbers go on with a pair. contaminants: (pair, side, sample); a sample drawn twice
    counts twice. Pairs are numbered and their few contaminants are one broadcast array, looked up by number."""
    sides = _sides(contaminants, index).withColumn("k", F.row_number().over(W.orderBy("pair")) - 1)
    one = sides.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids0", "ids1"))), lambda s: F.struct(s["ids0"].alias("ids0"), s["ids1"].alias("ids1"))).alias("__sides"))
    nested = nest_pairs(sites.select("pair", *SITE).join(F.broadcast(sides.select("pair", "k")), "pair"))

    def reduced(p: Column) -> Column:
        side = F.get("__sides", p["k"])
        return F.struct(p["pair"].alias("pair"), *(_share(side[f"ids{k}"]).alias(f"caf{k}") for k in (0, 1)))

    at = meet(nested, bitmaps).join(F.broadcast(one), F.lit(True))
    return at.select(*SITE, F.inline(F.transform("pairs", reduced))).select("pair", *SITE, "caf0", "caf1")


def attach_nested(sites: DataFrame, store: DataFrame, **columns: Column) -> DataFrame:
    """sites with ``columns`` of the store's row at their coordinate. A stored site is reduced to them before it is joined,
    and meets one row a site, whose pairs are rows again afterwards: no haplotypes go with a pair."""
    return unnest_pairs(nest_pairs(sites).join(store.select(*SITE, *(c.alias(n) for n, c in columns.items())), SITE))
