"""Draws without replacement by keyed permutations: the k-th draw of a replicate is the k-th value of a permutation of
0 to n - 1 that belongs to the replicate. A permutation is a network of rounds that add a hash of one half of a number to
the other half; numbers of the grid that are n or more are sent on through the network until one is below n. So a draw
costs a few hashes, however large n is, and no replicate ever looks at all members of a panel."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import u01
from .pedigree import KEYS, Tree

#: Rounds of a network: 14 draw evenly from six members too, 6 would do from a hundred on. Walks at most.
ROUNDS, MOST_WALKS = 14, 64


def permuted(k: Column, n: int, seed: int, stream: str, *keys: Column) -> Column:
    """The place of ``k`` (0 to n - 1) in the permutation of n numbers that belongs to ``keys``."""
    wide = math.isqrt(max(n - 1, 0)) + 1
    high = -(-n // wide)

    def turn(r: int) -> Callable[[Column], Column]:
        own, other, size = ("h", "l", high) if r % 2 == 0 else ("l", "h", wide)

        def added(s: Column) -> Column:
            more = F.floor(u01(seed, f"{stream}{r}", *keys, s[other]) * size)
            moved = ((s[own] + more) % size).cast("long")
            return F.struct(*((moved if name == own else s[name]).alias(name) for name in ("h", "l")))

        return added

    def once(x: Column) -> Column:
        state = F.struct(F.floor(x / wide).cast("long").alias("h"), (x % wide).cast("long").alias("l"))
        for r in range(ROUNDS):
            # A round's result is worked out once, for the next one to use twice.
            state = F.transform(F.array(state), turn(r))[0]
        return F.transform(F.array(state), lambda s: s["h"] * wide + s["l"])[0]

    start = F.struct(k.cast("long").alias("x"), F.lit(False).alias("done"))

    def walk(s: Column, _: Column) -> Column:
        sent = F.transform(F.array(once(s["x"])), lambda x: F.struct(x.alias("x"), (x < n).alias("done")))[0]
        return F.when(s["done"], s).otherwise(sent)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_WALKS)), start, walk)
    return F.transform(F.array(end), lambda e: F.when(e["done"], e["x"]).otherwise(F.raise_error(F.lit("no draw below the size")).cast("long")))[0]


def permuted_founders(replicates: DataFrame, members: DataFrame, tree: Tree, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """replicates with ``founders``, panel indices in the tree's order, drawn without replacement: those of known sex among
    the members of that sex, the others among all members that aren't drawn yet. members: (sample, idx, sex) of a
    population; ``exclude`` lists samples that aren't drawn. Members are numbered by name."""
    if exclude is not None:
        members = members.join(F.broadcast(exclude.select("sample").distinct()), "sample", "left_anti")
    names = F.transform(F.array_sort(F.collect_list(F.struct("sample", "idx", "sex"))), lambda m: F.struct(m["idx"].alias("idx"), m["sex"].alias("sex")))
    pool = members.agg(names.alias("__all"))  # a panel is one row
    of = lambda s: F.transform(F.filter("__all", lambda m: m["sex"] == s), lambda m: m["idx"])
    pool = pool.select(F.transform("__all", lambda m: m["idx"]).alias("unknown"), of("male").alias("male"), of("female").alias("female"))
    sizes = pool.select(*(F.size(c).alias(c) for c in pool.columns)).first().asDict()
    sexes = [p[3] for p in tree.founders]
    want = {s: sexes.count(s) for s in sizes}
    if len(sexes) > sizes["unknown"] or any(want[s] > sizes[s] for s in ("male", "female")):
        raise ValueError(f"too few panel members for {len(sexes)} founders")
    keys = [F.col(k) for k in KEYS]

    def drawn(sex: str, count: int) -> Column:
        return F.array(*(F.get(sex, permuted(F.lit(k), sizes[sex], seed, f"founder-{sex}", *keys).cast("int")) for k in range(count))) if count else F.array().cast("array<int>")

    lists = replicates.select(*KEYS).join(F.broadcast(pool), F.lit(True))
    lists = lists.select(*KEYS, *(drawn(s, want[s]).alias(f"__{s}") for s in ("male", "female")), drawn("unknown", len(sexes) if want["unknown"] else 0).alias("__any"))
    # Those of known sex take some of the first draws at most, so enough of these are left.
    lists = lists.withColumn("__rest", F.array_except("__any", F.concat("__male", "__female")))
    at, picked = {"male": 0, "female": 0, "unknown": 0}, []
    for s in sexes:
        picked.append(F.get("__rest" if s == "unknown" else f"__{s}", F.lit(at[s])))
        at[s] += 1
    return replicates.join(lists.select(*KEYS, F.array(*picked).alias("founders")), list(KEYS))
