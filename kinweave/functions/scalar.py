"""Column functions over chromosomes, alleles, base qualities, blocks, rates and INFO fields (all run in the JVM)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The number that stands for the X chromosome; the known alleles; the transitions; IUPAC codes.
X = 88
KNOWN = ("A", "C", "G", "T")
TRANSITIONS = ("AG", "GA", "CT", "TC")
IUPAC = ("R", "Y", "S", "W", "K", "M", "B", "D", "H", "V")
X_NAMES = ("X", "X_par1", "X_par2")
CROSS_BITS = float(1 << 48)


def chrom_id(name: Column) -> Column:
    """``chr`` prefix dropped; X and its pseudo-autosomal parts are 88; null where the rest is no number up to 255."""
    bare = F.regexp_replace(name, "^chr", "")
    number = F.when(bare.rlike("^[0-9]{1,3}$"), bare.cast("int"))
    return F.when(bare.isin(*X_NAMES), F.lit(X)).when(number <= 255, number)


def phred(char: Column) -> Column:
    return F.ascii(char) - 33


def phred_ascii(q: Column) -> Column:
    return F.char((q + 33).cast("int"))


def phred_prob(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def allele(char: Column) -> Column:
    """The upper-cased allele; fails on IUPAC codes and on anything else that is no allele."""
    up = F.upper(char)
    ambiguous = F.raise_error(F.concat(F.lit("ambiguous allele: "), up)).cast("string")
    invalid = F.raise_error(F.concat(F.lit("not an allele: "), char)).cast("string")
    return F.when(up.isin(*KNOWN, "N", "*"), up).when(up.isNull(), up).when(up.isin(*IUPAC), ambiguous).otherwise(invalid)


def is_known(base: Column) -> Column:
    return base.isin(*KNOWN)


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin(*TRANSITIONS)


def block_start(pos: Column, length: Column, size: int) -> Column:
    """1-based start of the block of a position. The last block ends with the chromosome and holds its last position,
    also where that would start a block of its own. A position outside the chromosome has no block: null."""
    last = F.when((length % size == 1) & (length > 1), length - size).otherwise(length - 1 - (length - 1) % size + 1)
    return F.when(pos.between(1, length), F.least(pos - (pos - 1) % size, last))


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws("-", a, b)


def expand_ranges(text: Column) -> Column:
    """``"0-3 7 X"`` as a sorted array of distinct integers; both ends of a range count, X is 88."""
    parts = F.filter(F.split(text, r"[\s,]+"), lambda p: p != "")
    number = lambda p: F.when(p == "X", F.lit(X)).otherwise(F.try_to_number(p, F.lit("999999")).cast("int"))
    ends = lambda p: F.split(p, "-")
    spread = F.transform(parts, lambda p: F.sequence(number(F.element_at(ends(p), 1)), number(F.element_at(ends(p), -1))))
    return F.array_sort(F.array_distinct(F.flatten(spread)))


def recycle(index: Column, values: Column) -> Column:
    """A short parameter list is used over and over."""
    return F.element_at(values, (index % F.size(values) + 1).cast("int"))


def rate_spec(text: Column) -> Column:
    """``"2"`` or ``"1-3"`` percent as struct(lo, hi) of ratios; fails outside 0 to 100."""
    parts = F.split(text, "-")
    lo, hi = (F.element_at(parts, i).cast("double") for i in (1, -1))
    wrong = (lo < 0) | (hi > 100) | (lo > hi) | lo.isNull() | hi.isNull()
    bad = F.raise_error(F.concat(F.lit("not a percentage or range: "), text)).cast("double")
    return F.struct(F.when(wrong, bad).otherwise(lo / 100).alias("lo"), (hi / 100).alias("hi"))


def u01(seed: int, stream: str, *keys: Column) -> Column:
    """A uniform draw in [0, 1) that depends on nothing but the seed, the stream's name and the keys: 48 bits of an MD5.
    Retries and repartitioning can't change it."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / CROSS_BITS


def draw_rate(spec: Column, seed: int, stream: str, *keys: Column) -> Column:
    return spec["lo"] + (spec["hi"] - spec["lo"]) * u01(seed, stream, *keys)


def info_map(info: Column) -> Column:
    """An INFO field as a map; flags have a null value, of a repeated tag the first wins."""
    tags = F.filter(F.split(info, ";"), lambda t: t != "")
    split = F.transform(tags, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.when(t.contains("="), F.substring(t, F.instr(t, F.lit("=")) + 1, F.length(t))).alias("v")))
    keys = F.transform(split, lambda s: s["k"])
    first = F.filter(split, lambda s, i: F.array_position(keys, s["k"]) == i + 1)
    # Seldom needed, and slow: each tag looks through all of them.
    names = F.transform(tags, lambda t: F.substring_index(t, "=", 1))
    simple = F.str_to_map(F.array_join(tags, ";"), F.lit(";"), F.lit("="))
    return F.when((F.size(F.array_distinct(names)) == F.size(names)) & (F.size(tags) > 0), simple).otherwise(F.map_from_entries(first))


def info_afs(info: Column) -> Column:
    """All ``<population>_AF`` tags as array<struct(grp, af)>; fails where a population comes twice."""
    tags = F.filter(F.split(info, ";"), lambda t: F.substring_index(t, "=", 1).endswith("_AF"))
    out = F.transform(tags, lambda t: F.struct(F.regexp_replace(F.substring_index(t, "=", 1), "_AF$", "").alias("grp"), F.substring_index(t, "=", -1).cast("float").alias("af")))
    names = F.transform(out, lambda s: s["grp"])
    bad = F.raise_error(F.concat(F.lit("repeated frequency tag: "), info)).cast("array<struct<grp:string,af:float>>")
    return F.when(F.size(F.array_distinct(names)) == F.size(names), out).otherwise(bad)


def haldane(d: Column) -> Column:
    """Probability of an odd number of crossovers."""
    return 0.5 * (1 - F.exp(-2.0 * d))


def rate_per_bp(rate: Column) -> Column:
    """cM per Mb as a probability per base."""
    return rate / 100.0 / 1e6


def round4(x: Column) -> Column:
    return F.round(x, 4)


def sex(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("male", "1"), "male").when(low.isin("female", "2"), "female").otherwise("unknown")


def decode_gt(gt: Column) -> Column:
    """``a|b`` as struct(a0, a1); a single call (male X) counts for both; anything else fails."""
    two = gt.rlike(r"^[0-9]\|[0-9]$")
    one = gt.rlike("^[0-9]$")
    bad = F.raise_error(F.concat(F.lit("not a phased genotype: "), gt)).cast("int")
    first = F.when(two | one, F.substring(gt, 1, 1).cast("int")).otherwise(bad)
    return F.struct(first.alias("a0"), F.substring(gt, -1, 1).cast("int").alias("a1"))
