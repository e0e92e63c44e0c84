"""Resampled relationship statistics: pairs x replicates x sites as ordinary rows.

A family tree is a few dozen rows; it is read to the driver once and unrolled into columns, so that a whole generation
is one projection and no join. All draws are hashes of their keys (``u01``), so results don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import phred_prob, u01
from .haplotypes import Coded, coded
from .haplotypes import allele as haplotype_allele

SITE = ("chrom", "pos")
KEYS = ("pair", "rep")


@dataclass(frozen=True)
class Tree:
    """People in an order where parents come first, (iid, fid, mid, sex), and comparisons (ord, label, i0, i1)."""

    people: tuple[tuple[str, str | None, str | None, str], ...]
    comparisons: tuple[tuple[int, str, str, str], ...]
    number: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, people: DataFrame, comparisons: DataFrame) -> Tree:
        rows = {r["iid"]: (r["iid"], r["fid"], r["mid"], r["sex"]) for r in people.orderBy("iid").collect()}
        placed: dict[str, tuple] = {}
        while len(placed) < len(rows):
            ready = [r for i, r in rows.items() if i not in placed and all(p is None or p in placed for p in r[1:3])]
            if not ready:
                raise ValueError("the tree has a circle or names an unknown parent")
            placed |= {r[0]: r for r in ready}
        cmp = [(r["ord"], r["label"], r["i0"], r["i1"]) for r in comparisons.orderBy("ord").collect()]
        if unknown := {i for c in cmp for i in c[2:]} - {*placed}:
            raise ValueError(f"compared but not in the tree: {sorted(unknown)}")
        return cls(tuple(placed.values()), tuple(cmp), {i: k for k, i in enumerate(placed)})

    @property
    def founders(self) -> list[tuple]:
        return [p for p in self.people if p[1] is None and p[2] is None]

    @property
    def slots(self) -> list[tuple[str, int]]:
        """(offspring, 0 for its father or 1 for its mother)"""
        return [(p[0], k) for p in self.people for k in (0, 1) if p[1 + k] is not None]

    def name(self, iid: str, slot: int) -> str:
        return f"g{self.number[iid]}_{slot}"


def expand_replicates(pairs: DataFrame, reps: int) -> DataFrame:
    return pairs.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def draw_founders(replicates: DataFrame, members: DataFrame, tree: Tree, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """replicates with ``founders``, panel indices in the tree's order, drawn without replacement. members: (sample, idx,
    sex) of a population. A founder of known sex is drawn among members of that sex, those of unknown sex among all the
    rest. ``exclude`` lists samples (contaminants) that aren't drawn."""
    if exclude is not None:
        members = members.join(F.broadcast(exclude.select("sample").distinct()), "sample", "left_anti")
    founders = tree.founders
    sexes = [p[3] for p in founders]
    if any(s != "unknown" for s in sexes) and not members.filter("sex <> 'unknown'").limit(1).count():
        raise ValueError("founders have a known sex; the panel has none")
    # The panel (some thousand members) is one row; each replicate draws from that array, without a row a member.
    pool = members.agg(F.array_sort(F.collect_list(F.struct("sample", "idx", "sex"))).alias("pool"))
    draw = lambda m: u01(seed, "founder", *(F.col(k) for k in KEYS), m["sample"])
    drawn = F.transform("pool", lambda m: F.struct(draw(m).alias("u"), m["idx"].alias("idx"), m["sex"].alias("sex")))
    # Few rows with much work each: dealt to all cores, which adaptive plans would not do for so few bytes.
    dealt = replicates.select(*KEYS).repartition(4 * replicates.sparkSession.sparkContext.defaultParallelism, *KEYS)
    lists = dealt.join(F.broadcast(pool), F.lit(True)).select(*KEYS, F.array_sort(drawn).alias("ms"))
    of_sex = lambda s: F.transform(F.filter("ms", lambda m: m["sex"] == s), lambda m: m["idx"])
    pools = {s: of_sex(s) for s in ("male", "female")}
    want = {s: sexes.count(s) for s in pools}
    used = F.concat(*(F.slice(pools[s], 1, n) for s, n in want.items())) if any(want.values()) else F.array().cast("array<int>")
    rest = F.array_except(F.transform("ms", lambda m: m["idx"]), used)
    picked, at = [], {"male": 0, "female": 0, "unknown": 0}
    for s in sexes:
        pool = pools.get(s, rest)
        got = F.try_element_at(pool, F.lit(at[s] + 1))
        picked.append(F.coalesce(got, F.raise_error(F.lit(f"too few panel members for {len(founders)} founders")).cast("int")))
        at[s] += 1
    return replicates.join(lists.select(*KEYS, F.array(*picked).alias("founders")), list(KEYS))


def with_parents(sims: DataFrame, replicates: DataFrame, tree: Tree, index: DataFrame, sexes: dict[str, Column] | None = None) -> DataFrame:
    """sims (pair, rep, i0, i1) with id0 and id1, the panel samples that stand for founders, and sex0 and sex1; null for
    offspring and for unknown sexes. ``sexes`` are columns as ``assign_sex`` gives them, else the tree's own are taken."""
    place = {p[0]: k for k, p in enumerate(tree.founders)}
    own = {p[0]: F.lit(p[3]) for p in tree.people if p[3] != "unknown"} if sexes is None else sexes
    names = index.agg(F.array_sort(F.collect_list(F.struct("idx", "sample"))).alias("__names"))
    out = sims.join(replicates.select(*KEYS, "founders"), list(KEYS)).join(F.broadcast(names), F.lit(True))  # a panel is one row

    def pick(person: str, values: dict) -> Column:
        found = F.lit(None).cast("string")
        for iid, value in values.items():
            found = F.when(F.col(person) == iid, value).otherwise(found)
        return found

    name = lambda k: F.get(F.filter("__names", lambda m: m["idx"] == F.get("founders", F.lit(k))), F.lit(0))["sample"]
    ids = {f"id{k}": pick(f"i{k}", {iid: name(at) for iid, at in place.items()}) for k in (0, 1)}
    return out.withColumns(ids | {f"sex{k}": pick(f"i{k}", own) for k in (0, 1)}).drop("founders", "__names")


def draw_contaminants(pairs: DataFrame, members: DataFrame, count: int, seed: int) -> DataFrame:
    """(pair, side, sample): ``count`` members a side of each pair, with replacement."""
    pool = members.agg(F.array_sort(F.collect_set("sample")).alias("pool"))
    spread = pairs.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    at = F.floor(u01(seed, "contam", F.col("pair"), F.col("side"), F.col("k")) * F.size("pool")).cast("int")
    return spread.join(F.broadcast(pool), F.lit(True)).select("pair", "side", F.element_at("pool", at + 1).alias("sample"))


def draw_strands(replicates: DataFrame, tree: Tree, seed: int) -> DataFrame:
    """replicates with ``strands``: for each offspring and parent the strand that it starts on."""
    one = lambda iid, k: (u01(seed, "strand", *(F.col(c) for c in KEYS), F.lit(iid), F.lit(k)) < 0.5).cast("int")
    return replicates.withColumn("strands", F.array(*(one(i, k) for i, k in tree.slots)) if tree.slots else F.array().cast("array<int>"))


def assign_sex(tree: Tree, seed: int) -> dict[str, Column]:
    """A column for each person's sex: the tree's own, else drawn per replicate, the other parent of a child being of the
    opposite sex."""
    known: dict[str, Column] = {i: F.lit(s) for i, _, _, s in tree.people if s != "unknown"}
    other = lambda c: F.when(c == "male", "female").otherwise("male")
    couples = list(dict.fromkeys((p[1], p[2]) for p in tree.people if p[1] is not None and p[2] is not None))

    def settle() -> None:
        again = True
        while again:
            again = False
            for a, b in couples:
                for x, y in ((a, b), (b, a)):
                    if x in known and y not in known:
                        known[y], again = other(known[x]), True

    settle()
    for iid, *_ in tree.people:
        if iid not in known:
            known[iid] = F.when(u01(seed, "sex", *(F.col(c) for c in KEYS), F.lit(iid)) < 0.5, "male").otherwise("female")
            settle()
    return known


def downsample_sites(df: DataFrame, rate: float, seed: int) -> DataFrame:
    """Drops a site of a replicate with probability ``rate``."""
    return df.filter(u01(seed, "snpdrop", *(F.col(c) for c in (*KEYS, *SITE))) >= rate) if rate else df


def founder_haplotypes(panel: Coded, replicates: DataFrame, tree: Tree) -> DataFrame:
    """(pair, pattern, alleles): what the founders of a pair's replicates carry at sites of a pattern, as
    alleles[rep][2 * founder + strand]. A bitmap is read once a pair, however many sites have it, and goes with no site."""
    each = replicates.groupBy("pair").agg(F.collect_list(F.struct("rep", "founders")).alias("__reps"))

    def carried(r: Column) -> Column:
        at = (2 * F.get(r["founders"], F.lit(k)) + s for k in range(len(tree.founders)) for s in (0, 1))
        return F.struct(r["rep"].alias("rep"), F.array(*(haplotype_allele(F.col("bits"), h) for h in at)).alias("alleles"))

    return panel.patterns.crossJoin(each).select("pair", "pattern", F.map_from_entries(F.transform("__reps", carried)).alias("alleles"))


def with_founders(rows: DataFrame, tree: Tree, seed: int, fixation: float = 0.0) -> DataFrame:
    """rows with the founders' alleles as columns g<person>_<strand> instead of ``alleles`` (see ``founder_haplotypes``). With
    probability ``fixation`` a row's founders all carry the reference."""
    fixed = u01(seed, "affix", *(F.col(c) for c in (*KEYS, *SITE))) < fixation if fixation else F.lit(False)
    own = F.try_element_at("alleles", F.col("rep"))
    places = [(iid, s) for iid, *_ in tree.founders for s in (0, 1)]
    columns = (F.when(fixed, 0).otherwise(F.get(own, F.lit(h))).alias(tree.name(*p)) for h, p in enumerate(places))
    return rows.select(*(c for c in rows.columns if c != "alleles"), *columns)


#: Bases of a chromosome whose crossovers one window orders.
STRETCH = 50_000_000


def stretched(sites: DataFrame) -> DataFrame:
    """sites with ``stretch``, the part of the chromosome that they lie in."""
    return sites.withColumn("stretch", F.floor(F.col("pos") / STRETCH))


def _hits(tree: Tree, seed: int, x_mode: bool) -> dict[str, Column]:
    """x<person>_<slot>: whether a flag is toggled at the row's site."""
    hit = lambda iid, k: u01(seed, "xover", *(F.col(c) for c in (*KEYS, *SITE)), F.lit(iid), F.lit(k)) < F.col("recomb")
    return {f"x{tree.number[i]}_{k}": F.lit(0) if x_mode and k == 0 else hit(i, k).cast("int") for i, k in tree.slots}


def crossovers_before(rows: DataFrame, tree: Tree, seed: int, x_mode: bool = False) -> DataFrame:
    """(pair, rep, chrom, stretch, before): each slot's flag as it is where a stretch begins, in the tree's order. rows: (pair,
    rep, chrom, pos, stretch, recomb). They become a row a stretch before anything is ordered."""
    hits = _hits(tree, seed, x_mode)
    part = [*KEYS, "chrom", "stretch"]
    totals = rows.select(*part, *(h.alias(n) for n, h in hits.items())).groupBy(*part).agg(F.count("*").alias("__n"), *(F.sum(n).alias(n) for n in hits))
    w = W.partitionBy(*KEYS).orderBy("chrom", "stretch").rowsBetween(W.unboundedPreceding, -1)
    flags = [(F.coalesce(F.sum(n).over(w), F.lit(0)) % 2).cast("int") for n in hits]
    return totals.select(*part, F.array(*flags).cast("array<int>").alias("before"))


def crossovers(rows: DataFrame, tree: Tree, seed: int, x_mode: bool = False) -> DataFrame:
    """rows with x<person>_<slot>: whether the strand is switched at the site. A flag is toggled with the probability
    ``recomb`` at each typed site, so it is the parity of a running sum: one window for all flags, over the stretch alone, on
    top of ``before`` (see ``crossovers_before``)."""
    w = W.partitionBy(*KEYS, "chrom", "stretch").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = _hits(tree, seed, x_mode)
    flags = {n: ((F.get("before", F.lit(at)) + F.sum(h).over(w)) % 2).cast("int") for at, (n, h) in enumerate(hits.items())}
    return rows.withColumns(flags) if flags else rows


def gene_drop(rows: DataFrame, tree: Tree, x_mode: bool = False, sexes: dict[str, Column] | None = None) -> DataFrame:
    """rows with every person's alleles: a child takes, of each parent, the allele of its strand there. On the X, a son's
    two slots both hold his mother's allele."""
    slots = {s: k for k, s in enumerate(tree.slots)}
    if x_mode and sexes is None:
        if any(p[3] == "unknown" for p in tree.people):
            raise ValueError("every person of the tree needs a sex on the X chromosome")
        sexes = {p[0]: F.lit(p[3]) for p in tree.people}
    for iid, *parents in (p[:3] for p in tree.people):
        if parents == [None, None]:
            continue
        got = []
        for k, parent in enumerate(parents):
            strand = (F.get("strands", F.lit(slots[iid, k])) + F.col(f"x{tree.number[iid]}_{k}")) % 2
            got.append(F.when(strand == 0, F.col(tree.name(parent, 0))).otherwise(F.col(tree.name(parent, 1))))
        if x_mode:
            got[0] = F.when(sexes[iid] == "male", got[1]).otherwise(got[0])
        rows = rows.withColumns({tree.name(iid, k): g for k, g in enumerate(got)})
    return rows


def draw_base(a0: Column, a1: Column, contam: Column, af: Column, seed: int, *keys: Column) -> Column:
    """An allele of a genotype, or of a contaminant with the alternate's local frequency ``af``."""
    u = lambda stream: u01(seed, stream, *keys)
    return F.when(u("cpick") < contam, F.when(u("caf") < af, 1).otherwise(0)).otherwise(F.when(u("allele") < 0.5, a0).otherwise(a1))


def with_error(base: Column, err: Column, seed: int, *keys: Column) -> Column:
    """The base as it is read: with probability ``err`` one of the three others."""
    wrong = F.floor(u01(seed, "errbase", *keys) * 3).cast("int")
    return F.when(u01(seed, "err", *keys) < err, wrong + (wrong >= base).cast("int")).otherwise(base)


def draw_read(a0: Column, a1: Column, contam: Column, af: Column, err: Column, seed: int, *keys: Column) -> Column:
    """The base seen in one read of a genotype: 0 or 1, or 2 or 3 after an error."""
    return with_error(draw_base(a0, a1, contam, af, seed, *keys), err, seed, *keys)


def compare_relationships(rows: DataFrame, tree: Tree, seed: int) -> DataFrame:
    """(pair, rep, ord, label, i0, i1, pwd, overlap): mismatches of one read a side over all sites, for each comparison of
    the tree. rows: alleles with contam0, contam1, caf0, caf1 and err0, err1 (or q0, q1, from which errors follow). The
    comparisons are columns until the sums are made, so rows aren't multiplied by them."""
    sides = [(o, k, iid) for o, _, *ids in tree.comparisons for k, iid in enumerate(ids)]
    keys = lambda o, k: (*(F.col(c) for c in (*KEYS, *SITE)), F.lit(o), F.lit(k))
    # Bases first and errors in a projection of their own, so that no draw is worked out twice.
    drawn = {f"b{o}_{k}": draw_base(F.col(tree.name(i, 0)), F.col(tree.name(i, 1)), F.col(f"contam{k}"), F.col(f"caf{k}"), seed, *keys(o, k)) for o, k, i in sides}
    err = [F.coalesce(F.col(f"err{k}"), phred_prob(F.col(f"q{k}"))).alias(f"e{k}") for k in (0, 1)]
    rows = rows.select(*KEYS, *SITE, *err, *(c.alias(n) for n, c in drawn.items()))
    rows = rows.select(*KEYS, *(with_error(F.col(f"b{o}_{k}"), F.col(f"e{k}"), seed, *keys(o, k)).alias(f"b{o}_{k}") for o, k, _ in sides))
    seen = [(F.col(f"b{c[0]}_0") != F.col(f"b{c[0]}_1")).cast("long").alias(f"d{c[0]}") for c in tree.comparisons]
    wide = rows.select(*KEYS, *seen).groupBy(*KEYS).agg(F.count("*").alias("overlap"), *(F.sum(f"d{c[0]}").alias(f"d{c[0]}") for c in tree.comparisons))
    cells = F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(label).alias("label"), F.lit(a).alias("i0"), F.lit(b).alias("i1"), F.col(f"d{o}").alias("pwd")) for o, label, a, b in tree.comparisons))
    return wide.select(*KEYS, "overlap", F.inline(cells)).select(*KEYS, "ord", "label", "i0", "i1", "pwd", "overlap")


def add_missing(sims: DataFrame, missing: DataFrame) -> DataFrame:
    """Sites that the store lacks count as overlap without mismatch."""
    more = F.coalesce("missing", F.lit(0).cast("long"))
    return sims.join(missing, "pair", "left").withColumn("overlap", F.col("overlap") + more).drop("missing").withColumn("avg", F.col("pwd") / F.col("overlap"))


def simulate(
    sites: DataFrame,
    haps: DataFrame | Coded,
    replicates: DataFrame,
    tree: Tree,
    seed: int = 42,
    drop_rate: float = 0.0,
    fixation: float = 0.0,
    x_mode: bool = False,
    sexes: dict[str, Column] | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
) -> DataFrame:
    """Everything from founders to counters. sites: (pair, chrom, pos, recomb, q0, q1, caf0, caf1), or these with their ``pattern`` in
    the panel; replicates: (pair, rep, founders, strands, contam0, contam1, err0, err1), where a null err takes the site's
    qualities. ``keep`` may write what is read twice, under a name.

    Sites are shuffled before they are multiplied by replicates: a stretch of a pair's chromosome lies in one task, which makes
    the replicates' rows, orders and sums them up. What is before a stretch comes from a row a stretch."""
    panel, part = coded(haps), ["pair", "chrom", "stretch"]
    typed = keep(stretched(sites if "pattern" in sites.columns else sites.join(panel.sites, list(SITE))), "typed-sites")
    rest = [c for c in replicates.columns if c not in (*KEYS, "founders")]
    each = replicates.groupBy("pair").agg(F.collect_list("rep").alias("__reps"))
    every = typed.select(*part, "pos", "recomb").join(each, "pair").select(*part, "pos", "recomb", F.explode("__reps").alias("rep"))
    before = crossovers_before(downsample_sites(every, drop_rate, seed), tree, seed, x_mode)
    heads = before.join(replicates.drop("founders"), list(KEYS)).groupBy(*part).agg(F.collect_list(F.struct("rep", "before", *rest)).alias("__reps"))
    found = keep(founder_haplotypes(panel, replicates, tree), "founder-haplotypes")
    # Few bytes with much work each: an adaptive plan would leave them to few tasks, or copy small sites to a single one that
    # holds the heads. Both sides stay dealt by stretch.
    spark = typed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = typed.repartition(tasks, *part).join(heads.hint("merge"), part).join(found, ["pair", "pattern"])
    rows = rows.select(*(c for c in rows.columns if c not in ("__reps", "pattern")), F.explode("__reps").alias("__rep")).select("*", "__rep.*").drop("__rep")
    rows = with_founders(downsample_sites(rows, drop_rate, seed), tree, seed, fixation)
    rows = gene_drop(crossovers(rows, tree, seed, x_mode), tree, x_mode, sexes)
    return compare_relationships(rows, tree, seed)
