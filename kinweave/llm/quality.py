"""Quality classifier: a sparse rule ensemble.

Statistics of each text (shares of capitals, symbols, digits, repeats and so on) feed a small random forest; every path
from a root to a node is a conjunctive rule over the statistics. A lasso logistic regression over the rules keeps few
of them and weights them, and the result is compiled into one Spark column expression: scoring is a projection.

The fit reads labelled rows only, at most ``most_labelled`` of them, taken in the order of a hash of the id, so that
the sample doesn't depend on the layout of the tables. The statistics of the sample are fitted by Spark's own learners.
Everything else covers all rows and whole texts, without a shuffle. A null or empty text has statistics of zero and is
scored like any other. Texts above 4 MB are read in parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import PART_BYTES, RangeHash, buffer_of, slices, word_bounds, word_parts

MOST_LABELLED = 20_000
STATISTICS = (
    "chars", "words", "word_len", "capitals", "digits", "stops", "marks", "symbols", "bars", "lines",
    "line_len", "first_caps", "all_caps", "doubled", "distinct", "long_words", "symbol_words", "mark_words",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(x) for x in chars]] = True
    return out


CAPITAL = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT, STOP, MARK, BAR = _class("0123456789"), _class(".,;:"), _class("!?"), _class("|")
SYMBOL = _class("#$%&*@^~=+<>{}[]\\_/")
FIRST = np.ones(256, bool)
FIRST[0x80:0xC0] = False  # bytes that go on a code point


COUNTS = (
    "chars", "words", "word_chars", "capitals", "digits", "stops", "marks", "symbols", "bars", "breaks",
    "first_caps", "all_caps", "doubled", "distinct", "long_words", "symbol_words", "mark_words",
)


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(COUNTS by name for each text of the buffer, hashes of the words in their order)"""
    n = len(offsets) - 1
    sums = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    total = lambda flag: np.diff(sums(flag)[offsets])
    capital = CAPITAL[data]
    # Capitals of the Latin-1 letters: 0xC3 0x80 to 0x9E.
    capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    start, end, doc = word_bounds(data, offsets)
    per = lambda flag: np.bincount(doc, weights=flag, minlength=n).astype(np.int64)
    within = lambda flag: (s := sums(flag))[end] - s[start]
    word_len, word_caps = within(FIRST[data]), within(capital)
    hashed = RangeHash(data)(start, end)
    same = np.zeros(len(start), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashed, doc))
    new = np.ones(len(start), bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    columns = (
        total(FIRST[data]), np.bincount(doc, minlength=n), per(word_len), total(capital), total(DIGIT[data]), total(STOP[data]), total(MARK[data]),
        total(SYMBOL[data]), total(BAR[data]), total(data == 0x0A), per(word_caps > 0), per((word_caps >= 2) & (2 * word_caps >= word_len)),
        per(same), np.bincount(doc[order][new], minlength=n), per(word_len > 14), per(within(SYMBOL[data]) > 0), per(within(MARK[data]) > 0),
    )
    return dict(zip(COUNTS, columns, strict=True)), hashed


def _counts_in_parts(data: np.ndarray) -> dict[str, np.ndarray]:
    """``_counts`` of one long text, read in parts that are cut at white space."""
    total, seen, last = dict.fromkeys(COUNTS, 0), np.zeros(0, np.uint64), None
    for a, b in word_parts(data):
        own, hashed = _counts(data[a:b], np.array([0, b - a]))
        for k in COUNTS:
            total[k] = total[k] + own[k]
        if len(hashed):
            total["doubled"] = total["doubled"] + int(hashed[0] == last)
            last, seen = hashed[-1], np.unique(np.concatenate([seen, hashed]))
    return total | {"distinct": np.array([len(seen)])}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of the buffer."""
    x = _counts_in_parts(data) if len(offsets) == 2 and len(data) > PART_BYTES else _counts(data, offsets)[0]
    c, w, lines = np.maximum(x["chars"], 1), np.maximum(x["words"], 1), x["breaks"] + 1
    columns = [
        x["chars"], x["words"], x["word_chars"] / w, x["capitals"] / c, x["digits"] / c, x["stops"] / w, x["marks"] / w, x["symbols"] / w,
        x["bars"] / w, lines, x["chars"] / lines, x["first_caps"] / w, x["all_caps"] / w, x["doubled"] / w, x["distinct"] / w,
        x["long_words"] / w, x["symbol_words"] / w, x["mark_words"] / w,
    ]
    return np.column_stack([np.asarray(v, np.float64) for v in columns])


def _statistics(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` as k0, k1 and so on, whatever their names, and STATISTICS."""
    text_at = f"k{keep.index(text_col)}" if text_col in keep else "text"

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at):
                found = statistics(*buffer_of(batch.column(text_at)))
                columns = [batch.column(i) for i in range(len(keep))] + [pa.array(x) for x in found.T]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(keep))), *STATISTICS])

    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*(f"k{i} {k}" for i, k in enumerate(kinds)), *(f"{s} double" for s in STATISTICS)])
    chosen = [*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), *([F.col(f"`{text_col}`").alias("text")] if text_at == "text" else [])]
    return docs.select(*chosen).mapInArrow(stats, schema)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, *STATISTICS) for every row of docs. ``keep`` names other columns to pass through; one with the name
    of a statistic is refused here (``score_quality`` takes it)."""
    names = (id_col, *keep)
    if clash := {*names} & {*STATISTICS}:
        raise ValueError(f"columns named like statistics: {sorted(clash)}")
    return _statistics(docs, text_col, names).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), *STATISTICS)


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds low < statistic <= high."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> F.Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                out = out & (F.col(name) > low)
            if high < math.inf:
                out = out & (F.col(name) <= high)
        return out


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> F.Column:
        """The probability of label 1 as a column over STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(node, features: tuple[str, ...], bounds: dict) -> Iterator[Rule]:
    """Rules of all nodes below a root of one of the forest's trees."""
    if bounds:
        yield Rule(tuple((k, *v) for k, v in sorted(bounds.items())))
    if node.subtreeDepth() > 0:
        name, cut = features[node.split().featureIndex()], float(node.split().threshold())
        low, high = bounds.get(name, (-math.inf, math.inf))
        yield from _paths(node.leftChild(), features, bounds | {name: (low, min(high, cut))})
        yield from _paths(node.rightChild(), features, bounds | {name: (max(low, cut), high)})


def fit_rules(sample: DataFrame, label_col: str = "label", trees: int = 16, depth: int = 3, penalty: float = 0.0005, seed: int = 7) -> Ensemble:
    """The ensemble fitted to labelled statistics (label 0 or 1). Without rows of both labels the score is constant:
    the share of label 1, smoothed."""
    n, ones = sample.agg(F.count("*"), F.sum(label_col)).first()
    ones = int(ones or 0)
    if ones in (0, n):
        return Ensemble((), math.log((ones + 1) / (n - ones + 1)))
    data = sample.select(F.col(label_col).cast("double").alias("label"), *STATISTICS)
    vectors = data.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=seed).fit(vectors)
    rules = list(dict.fromkeys(r for t in forest.trees for r in _paths(t._java_obj.rootNode(), STATISTICS, {})))
    fired = data.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(fired)
    weights = lasso.coefficients.toArray()
    return Ensemble(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    learn: F.Column | None = None,
    most_labelled: int = MOST_LABELLED,
) -> Ensemble:
    """Fit to docs with a non-null label. ``learn`` is a condition over the column ``__id`` of rows to learn from."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)")
    if learn is not None:
        marked = marked.filter(learn)
    sample = marked.orderBy(F.xxhash64(F.col("__id")), "__label").limit(most_labelled)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    stats = text_statistics(texts, "__id", "__text", ("__label",))
    # Bounded after the join as well, as an id may have many rows: at most 20,000 rows of numbers, the same ones in the
    # same order whatever the layout of the tables.
    stats = stats.orderBy(F.xxhash64("__id"), "__label", *STATISTICS).limit(most_labelled)
    rows = stats.orderBy("__id", "__label", *STATISTICS).toArrow()
    small = spark.createDataFrame(rows, stats.schema).coalesce(2).cache()
    try:
        return fit_rules(small.withColumnRenamed("__label", "label"))
    finally:
        small.unpersist()


def score_quality(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, score, predicted) for every row of docs; kept columns may have the names of statistics."""
    names = (id_col, *keep)
    stats = _statistics(docs, text_col, names)
    scored = stats.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), ensemble.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
