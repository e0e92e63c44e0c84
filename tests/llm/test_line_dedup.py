import random

import numpy as np
import pytest

from kinweave.llm import line_dedup as ld

from .common import DOCS, edge_docs


def plain(rows, chars=40, docs=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    found = {}
    for k, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                found.setdefault(key(line), set()).add(k)
    keep = {x: max((rows[k][0] for k in own if rows[k][0] is not None), default=None) for x, own in found.items() if len(own) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bounds", [(50_000, 100_000), (3, 20)])
def test_against_plain(spark, monkeypatch, bounds):
    monkeypatch.setattr(ld, "SHARD_KEYS", bounds[0])
    monkeypatch.setattr(ld, "SHARD_PROBES", bounds[1])
    r = random.Random(8)
    pool = ["é" * 40, "x" * 39, "Common LINE number %d with some more words to be long enough", "  padded line that is long enough to count as one \t"]
    pool = pool[:2] + [pool[2] % i for i in range(20)] + pool[3:]
    extra = ["\n".join(r.choice([x, x.upper(), " " + x + "\r", "short"]) for x in r.choices(pool, k=r.randrange(1, 9))) for _ in range(80)]
    docs = edge_docs(spark, extra)
    own = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert sorted(map(tuple, ld.dedup_lines(docs).collect()), key=repr) == plain(own)


def test_rows_without_id_that_agree(spark):
    """They count each, but probe once a batch."""
    common = "a line that is long enough and in every one of the rows"
    own = [(None, common + "\nshort")] * 3000 + [(7, common)] * 3 + [(8, common + "\n" + common), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t) for i, t in own], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ld.dedup_lines(docs).collect()), key=repr) == plain(own)
    for some in ([(None, common)] * 6, [(None, common)] * 6 + [(-(2**63), common)], [(-(2**63), common)] * 3 + [(-(2**63) + 1, common)] * 2):
        assert sorted(map(tuple, ld.dedup_lines(spark.createDataFrame(some, "doc_id long, text string")).collect()), key=repr) == plain(some)


def test_empty(spark):
    assert ld.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 1000, 20_000):
        keys = np.unique(rng.integers(0, 2**63, (n, 2), dtype=np.uint64), axis=0)
        table = ld.PerfectHash(*ld.PerfectHash.build(keys))
        assert sorted(table.index(keys).tolist()) == list(range(len(keys)))
        assert len(table.words) * 64 < 6 * n + 512
