"""Registries: people of any number of families in one table, their generations and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch, stored

KEY = ("family", "iid")
#: A person's number, base, the numbers of up to two people that they point at and how far up these are.
STATE = "id long, unlisted boolean, circle boolean, base long, p long, pw long, q long, qw long, kind int"
SETTLED, SINGLE, DOUBLE = 0, 1, 2


def _once(people: DataFrame) -> DataFrame:
    """(family, iid, parents, conflict): a row for each person. The least of several pairs of parents counts."""
    named = people.filter("iid IS NOT NULL").select(F.coalesce("family", F.lit("")).alias("family"), "iid", F.struct("fid", "mid").alias("parents"))
    least, most = F.min("parents"), F.max("parents")
    return named.groupBy(*KEY).agg(least.alias("parents"), (~least.eqNullSafe(most)).alias("conflict"))


def _pointed(once: DataFrame) -> DataFrame:
    """STATE without ``kind``: pointers to the parents that are listed, each one step up."""
    parents = F.array_compact(F.array_distinct(F.array("parents.fid", "parents.mid")))
    links = once.select("family", "id", F.explode(parents).alias("to"))
    met = links.join(once.select("family", F.col("iid").alias("to"), F.col("id").alias("at")), ["family", "to"], "left")
    links = met.select("id", "at", F.col("at").isNull().alias("unlisted"))
    rows = links.unionAll(once.select("id", F.lit(None).cast("long"), F.lit(False)))
    found = rows.groupBy("id").agg(F.bool_or("unlisted").alias("unlisted"), F.min("at").alias("p"), F.max("at").alias("q"))
    one = F.lit(1).cast("long")
    return found.select("id", "unlisted", F.lit(False).alias("circle"), (one - 1).alias("base"), "p", one.alias("pw"), "q", one.alias("qw"))


def _kept(rows: DataFrame, limit: int) -> DataFrame:
    """rows in order, written by how many pointers they have left. Two pointers to one person: the heavier one says all."""
    # Up more steps than there are people, somebody is met twice.
    lost = lambda c: F.coalesce((F.col(c) == F.col("id")) | (F.col(f"{c}w") > limit), F.lit(False))
    both = F.col("p") != F.col("q")
    rows = rows.select("id", "unlisted", (F.col("circle") | lost("p") | lost("q")).alias("circle"), "base", F.coalesce("p", "q").alias("p"),
        F.when(F.col("p") == F.col("q"), F.greatest("pw", "qw")).when(F.col("p").isNull(), F.col("qw")).otherwise(F.col("pw")).alias("pw"),
        F.when(both, F.col("q")).alias("q"), F.when(both, F.col("qw")).alias("qw"))
    kind = F.when(F.col("p").isNull() | F.col("circle"), SETTLED).when(F.col("q").isNull(), SINGLE).otherwise(DOUBLE)
    path = scratch(rows.sparkSession, "registry")
    rows.withColumn("kind", kind).write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(STATE).parquet(path)


def _moved(rows: DataFrame, view: DataFrame) -> DataFrame:
    """The open people of rows, whose pointers to people of ``view`` are gone where these are settled, and put on to where
    these point with their only one. Other pointers stay."""
    view = view.select(F.col("id").alias("at"), F.col("base").alias("up"), F.col("circle").alias("lost"), (F.col("kind") == SETTLED).alias("gone"), F.col("p").alias("next"), F.col("pw").alias("far"))

    def step(rows: DataFrame, c: str) -> DataFrame:
        met, w = rows.join(view, F.col(c) == F.col("at"), "left"), f"{c}w"
        further = lambda stays, moves: F.when(F.col("at").isNull(), stays).when(~F.col("gone"), moves)
        changed = {
            "base": F.greatest(F.col("base"), F.col("up") + F.col(w)), "circle": F.col("circle") | (F.coalesce("gone", F.lit(False)) & F.coalesce("lost", F.lit(False))),
            c: further(F.col(c), F.col("next")), w: further(F.col(w), F.col(w) + F.col("far")),
        }
        return met.select(*(changed.get(n, F.col(n)).alias(n) for n in rows.columns))

    # A missing second pointer would send all single ones to one task.
    return step(rows.filter(F.col("kind") == SINGLE), "p").unionAll(step(step(rows.filter(F.col("kind") == DOUBLE), "p"), "q")).drop("kind")


def generations(people: DataFrame) -> DataFrame:
    """(family, iid, generation, error), a row for each person of people (family, iid, fid, mid).

    The generation is one more than the parents' deeper one; who has no listed parent is of generation 0. Ids belong to
    their family; a null family is the one with the empty name, rows without ``iid`` are no people. ``error`` is null or,
    the first that holds: ``circle`` (the person is an ancestor of their own, or descends from somebody who is; generation
    null), ``conflict`` (listed with unlike parents: of these pairs the least counts), ``unlisted`` (has a parent that the
    family doesn't list, who counts as unknown).

    Everybody points at their listed parents. In each round those without pointers are settled and the others jump over
    whoever has one pointer or none, as (max, +) functions of one variable are closed under composition: a line of n
    people takes log2(n) rounds, a tree with both parents known at most a round for each generation. People are numbered once
    and rounds join numbers. A round joins what is still open with who is settled and then with whoever has one pointer or
    none, who are often few; both are written, so that no lineage grows. A round that settles nobody leaves people who all
    point at each other: circles."""
    once = stored(_once(people).withColumn("id", F.monotonically_increasing_id()), "registry")
    limit = left = once.count()
    open_ = _kept(_pointed(once), limit)
    told = []
    while left:
        closed = open_.filter(F.col("kind") == SETTLED)
        done = closed.count()
        if not done:
            closed = open_.withColumn("circle", F.lit(True))
        told.append(closed)
        if done in (0, left):
            break
        left -= done
        rest = _kept(_moved(open_, closed), limit)
        ends = rest.filter(F.col("kind") == SETTLED).drop("kind")
        open_ = _kept(_moved(rest, rest.filter(F.col("kind") != DOUBLE)).unionAll(ends), limit)
    out = told[0] if told else open_
    for more in told[1:]:
        out = out.unionAll(more)
    out = once.select("id", *KEY, "conflict").join(out.select("id", "base", "circle", "unlisted"), "id")
    error = F.when(F.col("circle"), "circle").when(F.col("conflict"), "conflict").when(F.col("unlisted"), "unlisted")
    return out.select(*KEY, F.when(~F.col("circle"), F.col("base")).alias("generation"), error.alias("error"))
