import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kinweave.llm import queries
from kinweave.llm import substring_dedup as sd

from .common import DOCS, edge_docs


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + length]) for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytearray(kept)))
    return out


def test_repeated_starts():
    r = random.Random(1)
    for trial in range(150):
        parts = [np.array([r.randrange(3) for _ in range(r.randrange(0, 40))], np.uint8) for _ in range(r.randrange(0, 8))]
        length = r.choice([1, 2, 5, 9])
        seen = Counter(p[i : i + length].tobytes() for p in parts for i in range(len(p) - length + 1))
        want = [(k, i) for k, p in enumerate(parts) for i in range(len(p) - length + 1) if seen[p[i : i + length].tobytes()] > 1]
        assert list(zip(*(x.tolist() for x in sd.repeated_starts(parts, length)), strict=True)) == want


@pytest.mark.parametrize("bounds", [{}, {"anchor_bytes": 60, "shard_bytes": 200}, {"anchor_bytes": 1, "shard_bytes": 1}])
def test_against_plain(spark, bounds):
    r = random.Random(6)
    make = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    shared = [make(n) for n in (12, 25, 60, 200)]
    extra = [make(r.randrange(30)) + r.choice(shared) + make(r.randrange(30)) for _ in range(60)] + ["ab" * 40, "x" * 13, shared[3], shared[3], make(3000)]
    docs = edge_docs(spark, extra)
    own = docs.collect()
    want = sorted(((x["doc_id"], *p) for x, p in zip(own, plain([x["text"] for x in own], 12), strict=True)), key=repr)
    got = sorted(map(tuple, sd.dedup_substrings(docs, length=12, anchor=4, **bounds).collect()), key=repr)
    assert got == want


def test_long_text_in_parts(monkeypatch):
    r = random.Random(7)
    passage = "".join(r.choice("abc") for _ in range(120))
    long_text = "".join(r.choice("abc") for _ in range(900)) + passage + "".join(r.choice("abc") for _ in range(500)) + passage + "xyz"
    data, length = np.frombuffer(long_text.encode(), np.uint8), 12
    monkeypatch.setattr(sd, "PART_BYTES", 100)
    seen = Counter(long_text[i : i + length] for i in range(len(long_text) - length + 1))
    starts, groups = [], {}
    for _, at, n, _, anchor, _, *windows in sd.fragments_in_parts(data, np.array([0, len(data)]), length, 4):
        for a, m, h, *w in zip(at.tolist(), n.tolist(), anchor.tolist(), *(x.tolist() for x in windows), strict=True):
            starts += range(a, a + m)
            for i in range(a, a + m):
                groups.setdefault(long_text[i : i + length], []).append((h, {(j, x) for j, x in enumerate(w) if x}))
    assert sorted(starts) == list(range(len(long_text) - length + 1))
    for text, own in groups.items():
        assert len(own) == seen[text] and len({h for h, _ in own}) == 1
        if len(own) > 1:
            assert own[0][1] & own[1][1]


def test_on_tables(spark, sf):
    own = queries.table(spark, sf, "documents").collect()
    want = {x["doc_id"]: (*p[:3], hashlib.sha256(p[3]).hexdigest()) for x, p in zip(own, plain([x["text"] for x in own], 400), strict=True)}
    assert {x[0]: tuple(x)[1:5] for x in queries.op1_substring_dedup(spark, sf).collect()} == want


def test_empty(spark):
    assert sd.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0
