import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import bpe, queries
from kinweave.llm.quality import Ensemble, fit_quality, score_quality

from .common import DOCS, edge_docs
from .test_near_dedup import plain
from .test_scans import plain_hits


def test_stages(spark, sf):
    docs = queries.table(spark, sf, "documents")
    items = [tuple(x) for x in queries.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    v = bpe.Vocabulary(queries.vocabulary_path())
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name == "bpe":
            got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out.collect()}
            assert got == {i: list(v.encode(t or "")) for i, t in before.items()}
            break
        assert out.columns == docs.columns
        stay = {r["doc_id"] for r in out.collect()}
        if name == "quality":
            marks = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
            right = [(i in stay) == bool(marks[i]) for i in before if i in marks]
            assert np.mean(right) > 0.95
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i], i)
            assert stay == {*first.values()}
        elif name == "near_dedup":
            assert stay == {i for i, (_, c) in plain(before.items(), least=cp.NEAR).items() if i == c}
        else:
            hits = {i: plain_hits(t, items) for i, t in before.items()}
            assert stay == {i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
        docs = out.cache()


def test_edges(spark, sf):
    docs = edge_docs(spark)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() <= docs.count(), name
        assert stage(spark, spark.createDataFrame([], DOCS), sf).count() == 0, name


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op2_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_quality_edges(spark):
    docs = edge_docs(spark)
    same = spark.createDataFrame([(1, 1), (2, 1), (99, None)], "doc_id long, quality int")
    assert fit_quality(docs, same).rules == ()
    none = fit_quality(docs, same.limit(0))
    assert {r["score"] for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), Ensemble((), 0.0)).count() == 0
    twice = score_quality(docs, Ensemble((), 1.0), keep=("text", "keep_id"))
    assert twice.columns == ["doc_id", "text", "keep_id", "score", "predicted"] and twice.count() == docs.count()


def test_language(spark):
    from kinweave.llm.language import identify_languages, learn_languages

    sf = "/root/testdata/sf0.01"
    found = queries.op9_language(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.93
    docs = edge_docs(spark)
    learned = learn_languages(queries.table(spark, sf, "documents"), F.lit(True))
    got = {r["doc_id"]: r for r in identify_languages(docs, learned).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, t in texts.items():
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t
        assert 0 <= got[i]["score"] <= 1
    assert learn_languages(docs.limit(0), F.lit(True)) == {}
    assert {r["lang_pred"] for r in identify_languages(docs, {}).collect()} == {"und"}


def run_stage(spark, sf, name, rows, more=""):
    docs = spark.createDataFrame(rows, "doc_id long, text string" + more)
    out = dict(cp.STAGES)[name](spark, docs, sf)
    assert out.columns == docs.columns
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_rows_of_repeated_and_null_ids(spark, sf):
    a, b = "one text that stands here more than once", "and quite another text of some words too"
    got = run_stage(spark, sf, "exact_dedup", [(1, a), (1, a), (1, b), (0, b), (None, a), (None, None), (None, "")])
    texts = [t or "" for _, t in got]
    assert sorted(texts) == sorted([a, b, ""]) and (0, b) in got
    got = run_stage(spark, sf, "near_dedup", [(7, b), (7, a), (9, a + " tail"), (None, "x y z"), (None, b + " more")])
    assert {t for _, t in got} >= {"x y z"}
    long = " ".join(f"w{i}" for i in range(60))
    got = run_stage(spark, sf, "near_dedup", [(5, long), (7, long + " end"), (7, "other"), (None, "start " + long), (None, None), (None, "lone")])
    assert got == sorted([(5, long), (7, "other"), (None, None), (None, "lone")], key=repr)
    item = next(r["text"] for r in queries.table(spark, sf, "benchmark").collect() if len((r["text"] or "").split()) > 15)
    got = run_stage(spark, sf, "decontaminate", [(3, "clean"), (3, item), (None, item), (None, "clean too"), (4, None)])
    assert got == sorted([(3, "clean"), (None, "clean too"), (4, None)], key=repr)


def test_columns_named_like_statistics(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").limit(40).collect()]
    plain_ = run_stage(spark, sf, "quality", rows)
    clashing = ", words int, chars string, score double, predicted int, n_words long, kept boolean, spans string, digest int"
    got = run_stage(spark, sf, "quality", [(*r, 1, "c", 0.5, 0, 2, True, "s", 3) for r in rows], clashing)
    assert sorted(r[:2] for r in got) == sorted(plain_) and all(r[2:] == (1, "c", 0.5, 0, 2, True, "s", 3) for r in got)
    for name in ("exact_dedup", "near_dedup", "decontaminate"):
        assert len(run_stage(spark, sf, name, [(*r, 1, "c", 0.5, 0, 2, True, "s", 3) for r in rows[:5]], clashing)) <= 5


@pytest.mark.parametrize("largest", [2**63 - 1, 2**62, 40])
def test_ids_of_any_size(spark, sf, largest):
    """Repeated and null ids beside the largest long: every row has a number of its own, in the order of the ids."""
    texts = {largest: "own", -(2**63): "own", 7: "twice", None: "own"}
    made = [(i, t, "en", "s", 3) for i, t in texts.items()] + [(7, "twice", "en", "s", 3), (None, "alone", "en", "s", 3)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows = cp._numbered(docs).collect()
    numbers = [r[cp.ROW] for r in rows]
    assert len({*numbers}) == len(rows) == 6
    by_id = {r["doc_id"]: r[cp.ROW] for r in rows}
    assert by_id[-(2**63)] < by_id[largest] < min(r[cp.ROW] for r in rows if r["doc_id"] in (7, None))
    kept = sorted(((r["doc_id"], r["text"]) for r in cp.exact(spark, docs, sf).collect()), key=repr)
    assert kept == sorted([(-(2**63), "own"), (7, "twice"), (None, "alone")], key=repr)
