"""The corpus pipeline: quality, exact dedup, near-dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return
the columns of documents. Rows with an empty or null text are judged like any others. Every row is judged on its own,
also where ids repeat or are null: such rows work under a stand-in number, beyond all ids, for as long as a stage lasts.
Of equal texts, or of a group of near copies, a row whose id is its own thus stays before one whose id repeats. Extra
columns pass through, whatever their names (but for ``__row``, a stage's own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.bpe import bpe_encode
from kinweave.llm.decontaminate import benchmark_hits, contaminated, words_hit
from kinweave.llm.exact_dedup import exact_dedup
from kinweave.llm.near_dedup import near_dedup
from kinweave.llm.quality import fit_quality, score_quality
from kinweave.llm.queries import table, vocabulary_path
from kinweave.llm.shared import materialise

#: Fixed value: similarity in hundredths at which the near-dedup stage links two documents.
NEAR = 80


#: Names of the working columns; those of documents may not be so called.
ROW = "__row"
#: Ids below this one leave room above them for the stand-ins, whose numbers are of the order of partitions times 2^33.
ROOM = 1 << 62


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for every row: the id where no other row has it, else one beyond all ids."""
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = materialise(ids.filter("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")), "repeated-ids")
    nulls, several = docs.filter("doc_id IS NULL"), repeated.limit(1).count() > 0
    if not several and not nulls.limit(1).count():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    own = docs.filter("doc_id IS NOT NULL")
    again = own.join(repeated, own["doc_id"] == repeated["__id"], "left_semi").unionAll(nulls)
    own = own.join(repeated, own["doc_id"] == repeated["__id"], "left_anti")
    largest = docs.agg(F.max("doc_id")).first()[0] or 0
    if largest < ROOM:
        numbered, after = own.withColumn(ROW, F.col("doc_id").cast("long")), largest + 1
    else:  # no room above the ids: they become numbers in the same order, far below the largest long
        ranked = own.select(F.col("doc_id").alias("__id")).repartitionByRange("__id").sortWithinPartitions("__id")
        ranked = materialise(ranked.withColumn(ROW, F.monotonically_increasing_id()), "ranks")
        numbered, after = own.join(ranked, own["doc_id"] == ranked["__id"]).select(*own.columns, ROW), ROOM
    # Written once, so that a row keeps its number.
    again = materialise(again.withColumn(ROW, F.monotonically_increasing_id() + F.lit(after).cast("long")), "stand-ins")
    return numbered.unionAll(again)


def _only(numbered: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The rows of documents whose number is among those of ``found`` (left_semi), or isn't (left_anti)."""
    return numbered.join(found.select(ROW), ROW, how).drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted to labels.quality, rejects go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever names other columns have, none clashes
    own = dict(zip(docs.columns, names, strict=True))
    scored = score_quality(docs.toDF(*names), model, own["doc_id"], own["text"], tuple(n for n in names if n != own["doc_id"]))
    return scored.filter("predicted = 1").select(*(F.col(n).alias(c) for c, n in own.items()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays; of fully equal rows one."""
    rows = _numbered(docs)
    return _only(rows, exact_dedup(rows, id_col=ROW, keep="smallest").filter("kept"), "left_semi").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a Jaccard similarity of 0.8 or more on five-word shingles) the document with the
    smallest id stays."""
    rows = _numbered(docs)
    return _only(rows, near_dedup(rows, id_col=ROW, least=NEAR).filter("kept"), "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words under benchmark windows go."""
    rows = _numbered(docs)
    hits = benchmark_hits(rows, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return _only(rows, hits.filter(contaminated(words_hit(F.col("spans")), F.col("n_words"))), "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids as little-endian unsigned 32-bit integers."""
    return bpe_encode(docs, vocabulary_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("bpe", encode)]

#: Near-dedup and the fitted classifier have no SQL form; tests/llm/test_pipeline.py holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
