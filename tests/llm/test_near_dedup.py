import random
import re

import numpy as np
import pytest

from kinweave.llm import near_dedup as nd
from kinweave.llm import queries
from kinweave.llm import textbytes as tb
from kinweave.llm.components import connected_components

from .common import DOCS, edge_docs


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs, least=85):
    sets = [(i, plain_set(t)) for i, t in docs if i is not None]
    comp = {i: i for i, _ in sets}
    owners = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(k)

    def root(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for k, (i, s) in enumerate(sets):
        common = {}
        for x in s:
            for o in owners[x]:
                if o < k:
                    common[o] = common.get(o, 0) + 1
        for o, n in common.items():
            if 100 * n >= least * (len(s) + len(sets[o][1]) - n):
                a, b = root(i), root(sets[o][0])
                comp[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets}


def near_texts(seed=2):
    r = random.Random(seed)
    out = []
    for size, copies in ((60, 40), (146, 60), (30, 10), (400, 6)):
        base = [f"w{r.randrange(4000)}" for _ in range(size)]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(size)] = f"e{r.randrange(10**6)}"
            out.append(r.choice([" ", "\n", "  "]).join(t))
    out += ["a b", "A  b", "a b c d e", "a b c d e f", "x"]
    return out


@pytest.mark.parametrize("bounds", [{}, {"family_docs": 12, "family_shingles": 4000}, {"family_docs": 3, "family_shingles": 300}])
def test_against_plain(spark, bounds):
    docs = edge_docs(spark, near_texts())
    got = nd.near_dedup(docs, **bounds).collect()
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(got) == len(own)
    want = plain(own)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_on_tables(spark, sf):
    own = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    want = plain(own)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10_near_dedup(spark, sf).collect()}
    assert got == want


def test_empty(spark):
    assert nd.near_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_estimate():
    rng = np.random.default_rng(3)
    for j in (0.3, 0.85, 0.95):
        n, found = 300, []
        k = round(n * 2 * j / (1 + j))
        for _ in range(30):
            a = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            both = np.concatenate([a[:n], a[:k], a[n : 2 * n - k]])
            registers = nd.sketches(both, np.array([0, n, 2 * n]))
            found.append(nd.estimate(registers, np.array([n, n]), np.array([0]), np.array([1]))[0])
        assert abs(np.mean(found) - k / (2 * n - k)) < 0.02
    # merging: the sketch of a union is the registers' maximum
    a, b = nd.sketches(both[:n], np.array([0, n])), nd.sketches(both[n:], np.array([0, n]))
    union = np.unique(both)
    assert np.array_equal(np.maximum(a, b), nd.sketches(union, np.array([0, len(union)])))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    comp = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in comp.items() if k != v}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    # Nodes with more than two links count as hubs; a chain of stars whose centres are neither first nor last.
    stars = [(50 * i + 20, 50 * i + j) for i in range(6) for j in range(40)] + [(50 * i + 39, 50 * i + 50) for i in range(5)]
    for own, most in ((edges, 2), (stars, 2), (stars, 30)):
        again = connected_components(spark.createDataFrame(own, "u long, v long"), most_links=most)
        want = got if own is edges else {n: 0 for e in stars for n in e if n}
        rows = again.collect()
        assert len(rows) == len(want) and {x["node"]: x["component"] for x in rows} == want


def graded_texts(seed=6):
    """Pairs of similarity just above and below 0.80, and at it: k of n shingles in common."""
    r = random.Random(seed)
    out = []
    for n, cut in ((100, 8), (100, 11), (100, 13), (86, 9), (200, 18), (90, 10)):
        for _ in range(12):
            base = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
            out += [" ".join(base), " ".join(base[:-cut] + [f"e{r.randrange(10**9)}" for _ in range(cut)])]
    return out


def test_least_80(spark):
    docs = spark.createDataFrame(list(enumerate(graded_texts())), "doc_id long, text string")
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain(own, 80)
    assert want != plain(own)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_dedup(docs, least=80).collect()}
    assert got == want
    for least in (80, 85, 90):
        bands = nd.bands_for(least)
        assert nd.REGISTERS % bands == 0 and (1 - (least / 100) ** (nd.REGISTERS // bands)) ** bands <= 1e-5
    assert (nd.bands_for(85), nd.bands_for(80)) == (40, 64)


def test_pipeline_stage_links_from_80(spark, sf):
    import corpus_pipeline as cp

    docs = spark.createDataFrame(list(enumerate(graded_texts())), "doc_id long, text string")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], 80)
    assert {r["doc_id"] for r in cp.near(spark, docs, sf).collect()} == {i for i, (_, c) in want.items() if i == c}


def test_no_link_by_colliding_words(spark):
    """Thue-Morse words cancel in polynomial hashes modulo a power of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nd.near_dedup(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_high_bits_that_agree():
    owner = np.zeros(6, np.int64)
    hashed = np.array([5, 1, 5, 1, 5, 1 << 40], np.uint64)
    found, starts = nd._distinct(owner, hashed, 1)
    assert sorted(found.tolist()) == [1, 5, 1 << 40] and starts.tolist() == [0, 3]


def test_low_thresholds():
    assert nd.bands_for(85) == 40 and nd.bands_for(80) == 64
    with pytest.raises(ValueError):
        nd.bands_for(2)


def test_parts_of_a_long_text(monkeypatch):
    r = random.Random(3)
    text = " ".join(f"w{r.randrange(300)}" for _ in range(5000)).encode()
    data = np.frombuffer(text, np.uint8)
    whole, _ = nd.shingle_sets(data, np.array([0, len(data)]))
    monkeypatch.setattr(nd, "PART_BYTES", 1000)
    monkeypatch.setattr(nd, "word_parts", lambda d, overlap: tb.word_parts(d, overlap, 1000))
    monkeypatch.setattr(nd, "SKETCHED", 700)
    parts, starts = nd.shingle_sets(data, np.array([0, len(data)]))
    assert np.unique(whole).tolist() == parts.tolist() and starts[-1] == len(whole)
    few = nd.sketches(parts, starts)
    monkeypatch.setattr(nd, "SKETCHED", 1 << 20)
    assert (few == nd.sketches(whole, np.array([0, len(whole)]))).all()
