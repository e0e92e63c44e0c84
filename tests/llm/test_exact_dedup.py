import hashlib

import pytest

from kinweave.llm.exact_dedup import exact_dedup, tree_shape

from .common import DOCS, edge_docs, rows


def plain(docs, best):
    groups = {}
    for r in docs:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        keep = best([i for i in ids if i is not None], default=None)
        out += [(i, keep, len(ids), i == keep, bytearray(hashlib.sha256(text.encode()).digest())) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_against_plain(spark, keep, fan_in):
    docs = edge_docs(spark, ["same"] * 40 + ["b"] * 3)
    best = max if keep == "largest" else min
    assert rows(exact_dedup(docs, keep=keep, fan_in=fan_in)) == plain(docs.collect(), best)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_extreme_ids(spark, keep):
    """Any long is an id: none is taken for a null."""
    ends = [-(2**63), -(2**63) + 1, -1, 0, 2**63 - 1]
    made = [(i, t) for t, ids in {"a": ends, "b": [ends[0], None], "c": [ends[4], None], "d": [None], "e": [ends[1], None], "f": ends[:1]}.items() for i in ids]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    assert rows(exact_dedup(docs, keep=keep)) == plain(docs.collect(), max if keep == "largest" else min)


def test_empty_and_all_null(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup(none).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(nulls).collect()] == [(None, 2, True)] * 2


def test_tree_shape():
    for n in (1, 2, 8, 12, 47, 64, 211, 1000, 5000):
        fan, rounds = tree_shape(n)
        assert 2 <= fan <= 8 and fan**rounds >= n
