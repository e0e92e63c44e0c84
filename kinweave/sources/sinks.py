"""Text sinks with the layouts of the result files. All writers fail where the target exists, unless told otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GUARD = "errorifexists"


def fixed(column: str, digits: int) -> Column:
    """A double's exact value to so many digits, halves to the even digit, as C prints it; Java's formatter rounds the
    shortest decimal, halves up. The product with 10^digits is the sum of two exact parts."""
    x, unit = F.col(column).cast("double"), 10**digits
    size = F.abs(x)
    upper = size * float(2**27 + 1) - (size * float(2**27 + 1) - size)
    high, low = upper * float(unit), (size - upper) * float(unit)
    whole = F.floor(high) + F.floor(low)
    a, b = high - F.floor(high), low - F.floor(low)
    # a + b is below 2; their sum might be rounded, the distance from a to a half isn't.
    more = F.lit(0)
    for k in (0, 1):
        more = F.when(b > k + 0.5 - a, k + 1).when(b == k + 0.5 - a, k + (whole + k) % 2).otherwise(more)
    n = whole + more
    # The last digits are split off the decimal text, so that nothing is divided.
    text = F.lpad(n.cast("string"), 20, "0")
    exact = F.concat(F.when(x < 0, "-").otherwise(""), F.regexp_replace(F.substring(text, 1, 20 - digits), "^0+(?=.)", ""), F.lit("." if digits else ""), F.substring(text, 21 - digits, digits))
    return F.when(size < 1e18 / unit, exact).otherwise(F.format_string(f"%.{digits}f", x))


def _write(df: DataFrame, path: str, mode: str, by: str | None = None) -> None:
    writer = df.write.mode(mode).option("sep", "\t").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def pwd_rows(summary: DataFrame, prefix: str = "Raw") -> DataFrame:
    return summary.select(
        F.col("pair").alias("Pair_name"), F.col("overlap").alias(f"{prefix}.Overlap"), fixed("sum_pwd", 1).alias(f"{prefix}.Sum.PWD"),
        *(fixed(c, 6).alias(f"{prefix}.{n}") for c, n in (("avg_pwd", "Avg.PWD"), ("ci95", "CI.95"), ("avg_phred", "Avg.Phred"))),
    )


def write_pwd(summary: DataFrame, path: str, mode: str = GUARD) -> None:
    """One row a pair, in the order of the labels."""
    _write(pwd_rows(summary).orderBy("Pair_name"), path, mode)


def write_blocks(blocks: DataFrame, path: str, mode: str = GUARD) -> None:
    """A folder a pair with all blocks of the grid, by chromosome and start."""
    _write(blocks.repartition("pair").sortWithinPartitions("pair", "chrom", "start"), path, mode, "pair")


#: The layout of a file of simulated counts, and what stands for an unknown.
SIMS = {"replicate": "rep", "label": "label", "parent0": "i0", "parent1": "i1", "parent0.id": "id0", "parent1.id": "id1", "pwd": "pwd", "overlap": "overlap", "avg": "avg", "parent0.sex": "sex0", "parent1.sex": "sex1"}
UNKNOWN = "None"


def sims_rows(sims: DataFrame) -> DataFrame:
    """(pair, ord, the columns of SIMS). Who stands for a founder and which sex a person has may be missing or null."""
    known = {c: F.coalesce(F.col(c), F.lit(UNKNOWN)) if c in sims.columns else F.lit(UNKNOWN) for c in ("id0", "id1", "sex0", "sex1")}
    columns = {**{c: F.col(c) for c in ("rep", "label", "i0", "i1", "pwd", "overlap")}, "avg": fixed("avg", 6), **known}
    return sims.select("pair", "ord", *(columns[c].alias(n) for n, c in SIMS.items()))


def write_sims(sims: DataFrame, path: str, mode: str = GUARD) -> None:
    """A folder a pair, by replicate and comparison."""
    rows = sims_rows(sims).repartition("pair").sortWithinPartitions("pair", "replicate", "ord")
    _write(rows.drop("ord"), path, mode, "pair")


def result_rows(results: DataFrame) -> DataFrame:
    stats = pwd_rows(results, "Corr")
    names = [c for c in stats.columns if c != "Pair_name"]
    more = results.select(F.col("pair").alias("Pair_name"), F.col("label").alias("Most_Likely_rel."), fixed("sim_avg_pwd", 6).alias("Sim.Avg.PWD"), fixed("z", 6).alias("Min.Z_Score"))
    return stats.join(more, "Pair_name").select("Pair_name", F.col("`Most_Likely_rel.`"), *(F.col(f"`{c}`") for c in names), F.col("`Sim.Avg.PWD`"), F.col("`Min.Z_Score`"))


def write_results(results: DataFrame, path: str, mode: str = GUARD) -> None:
    _write(result_rows(results).orderBy("Pair_name"), path, mode)


def probs_rows(classes: DataFrame) -> DataFrame:
    """(pair, a column for each label): labels in ascending order of their first rank over all pairs."""
    order = [r["label"] for r in classes.groupBy("label").agg(F.min("rank").alias("r")).orderBy("r", "label").collect()]
    return classes.groupBy("pair").pivot("label", order).agg(F.first("p"))


def write_probs(classes: DataFrame, path: str, mode: str = GUARD) -> None:
    _write(probs_rows(classes).orderBy("pair"), path, mode)
