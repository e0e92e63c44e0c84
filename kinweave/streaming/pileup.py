"""Pileup lines as a stream. A line holds all samples of a site, so pairs are made within the line, without a join, and
only the sums are state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import block_start, pair_label, phred
from ..operators.observed import BASES, summary_columns
from ..sources.readers import parse_pileup, read_symbols, symbol_base


def _bases(sample: Column, ref: Column, consider_dels: bool) -> Column:
    """A sample's reads as a string with a base each."""
    symbols = read_symbols(sample["bases"])
    symbols = symbols if consider_dels else F.translate(symbols, "*", "")
    return F.when(sample["depth"] > 0, F.regexp_replace(symbols, "[.,]", ref)).otherwise("")


def _known(bases: Column, ref: Column, where: Column) -> Column:
    """The same; fails as ``symbol_base`` does."""
    odd = F.regexp_extract(bases, r"[^ACGTN*]", 0)
    return F.when(bases.rlike(r"^[ACGTN*]*$"), bases).otherwise(symbol_base(odd, ref, where))


def line_pairs(pileup: DataFrame, least_quality: int = 30, min_depth: int = 1, consider_dels: bool = False) -> DataFrame:
    """(pair, chrom, pos, num, den, pwd, q0, q1) of every pair of a line's samples, stateless."""
    # Whole strings where it can be, as each lambda is worked out read by read; a step for whatever is used more than once.
    ref, where, low = F.col("ref"), F.concat_ws(":", "chrom", "pos"), max(least_quality + 33, 0)
    below = "".join(map(chr, range(1, low)))
    named = F.transform("samples", lambda s: F.struct(s["sample"].alias("sample"), F.coalesce(s["quals"], F.lit("")).alias("quals"), _bases(s, ref, consider_dels).alias("bases")))
    known = F.transform(named, lambda s: F.struct(s["sample"].alias("sample"), F.substring(s["quals"], F.lit(1), F.length(s["bases"])).alias("quals"), _known(s["bases"], ref, where).alias("bases")))
    good = lambda s: F.filter(F.split(s["bases"], ""), lambda t, i: F.substring(s["quals"], i + 1, F.lit(1)) >= chr(low))
    kept = F.transform(known, lambda s: F.struct(s["sample"].alias("sample"), F.array_join(good(s), "").alias("b"), F.translate(s["quals"], below, "").alias("q")))
    cell = lambda k: F.struct(
        k["sample"].alias("sample"), F.length(k["b"]).cast("long").alias("n"),
        F.array(*((F.length(k["b"]) - F.length(F.replace(k["b"], F.lit(b), F.lit("")))).cast("long") for b in BASES)).alias("c"),
        F.aggregate(F.split(k["q"], ""), F.lit(0), lambda t, c: t + F.when(c != "", phred(c)).otherwise(0)).alias("q"),
    )
    cells = F.filter(F.transform(kept, cell), lambda c: c["n"] >= min_depth)
    rows = pileup.select("chrom", "pos", cells.alias("cells"))
    pairs = F.flatten(F.transform("cells", lambda x: F.transform(F.filter("cells", lambda y: y["sample"] > x["sample"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    spread = rows.select("chrom", "pos", F.explode(pairs).alias("p")).select("chrom", "pos", "p.x", "p.y")
    name = lambda c: F.concat(F.lit("Ind"), c)
    den = F.col("x.n") * F.col("y.n")
    num = den - F.aggregate(F.zip_with("x.c", "y.c", lambda a, b: a * b), F.lit(0).cast("long"), lambda t, v: t + v)
    return spread.select(
        pair_label(name(F.col("x.sample")), name(F.col("y.sample"))).alias("pair"), "chrom", "pos", num.alias("num"), den.alias("den"), (num / den).alias("pwd"),
        (F.col("x.q") / F.col("x.n")).alias("q0"), (F.col("y.q") / F.col("y.n")).alias("q1"),
    )


def stream_pileup(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """Pileup lines of the files of a folder, as they arrive."""
    return parse_pileup(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def first_lines(pairs: DataFrame) -> DataFrame:
    """Of repeated coordinates of a pair the first to arrive counts, in whatever order lines come. Its state grows with the
    sites; see ``first_lines_within`` for sorted lines."""
    return pairs.dropDuplicates(["pair", "chrom", "pos"])


#: Milliseconds of event time that a chromosome takes; more than any has bases.
CHROM_SPAN = 1 << 36


def coordinate_time(chrom: Column, pos: Column) -> Column:
    """A coordinate as event time: a base is a millisecond, chromosomes follow each other. A position beyond the span
    would be taken for one on the next chromosome, so it fails."""
    within = F.when(pos < CHROM_SPAN, pos).otherwise(F.raise_error(F.concat_ws(":", F.lit("position beyond the span of a chromosome"), chrom, pos)).cast("long"))
    return F.timestamp_millis(chrom.cast("long") * CHROM_SPAN + within)


def first_lines_within(pairs: DataFrame, disorder: int) -> DataFrame:
    """``first_lines`` of lines that are sorted but for ``disorder`` bases, with as much state. A line counts if no line of
    its pair and coordinate came before it; it may lie up to ``disorder`` bases behind the furthest line of the batches
    before its own (in any order within a batch). A line further behind is left out, and counted in the progress report
    as ``numRowsDroppedByWatermark``. State is a row for each pair and site within that stretch."""
    timed = pairs.withColumn("__at", coordinate_time(F.col("chrom"), F.col("pos"))).withWatermark("__at", f"{disorder} milliseconds")
    return timed.dropDuplicatesWithinWatermark(["pair", "chrom", "pos"]).drop("__at")


def running_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pair").agg(*summary_columns())


def running_blocks(pairs: DataFrame, genome: DataFrame, size: int = 1_000_000) -> DataFrame:
    placed = pairs.join(F.broadcast(genome), "chrom").withColumn("start", block_start(F.col("pos"), F.col("length"), size)).filter("start IS NOT NULL")
    return placed.groupBy("pair", "chrom", "start").agg(F.count("*").alias("sites"), F.sum("pwd").alias("pwd"))
