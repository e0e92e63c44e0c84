"""Generations of registries against plain recursion."""

import random

import pytest

from kinweave.operators import registry
from kinweave.operators.registry import generations
from kinweave.sources import readers as rd

PEOPLE = "family string, iid string, fid string, mid string, extra int"


def plain(rows):
    pairs = {}
    for family, iid, fid, mid, *_ in rows:
        if iid is not None:
            pairs.setdefault((family or "", iid), set()).add((fid, mid))
    parents = {k: min(v, key=lambda p: [(x is not None, x or "") for x in p]) for k, v in pairs.items()}
    up = {k: {(k[0], x) for x in p if x is not None} for k, p in parents.items()}
    depth = {}
    while True:  # who has only settled parents is settled
        ready = [k for k in up if k not in depth and all(x in depth or x not in up for x in up[k])]
        if not ready:
            break
        depth |= {k: 1 + max((depth[x] for x in up[k] if x in up), default=-1) for k in ready}
    error = lambda k: "circle" if k not in depth else "conflict" if len(pairs[k]) > 1 else "unlisted" if up[k] - set(up) else None
    return sorted(((*k, depth.get(k), error(k)) for k in up), key=repr)


def same(spark, rows):
    got = generations(spark.createDataFrame([(*r, 1) for r in rows], PEOPLE)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    rows = []
    for family in ("a", "b", None, "c"):
        n = r.randrange(5, 40)
        pick = lambda i, odd: r.choice([None, str(r.randrange(n + 2)) if r.random() < odd else str(r.randrange(i)) if i else None])  # noqa: B023, E731
        rows += [(family, str(i), pick(i, 0.05), pick(i, 0.05)) for i in range(n)]
        rows += [(family, str(r.randrange(n)), None, str(r.randrange(n))) for _ in range(2)]
    same(spark, rows)


def test_long_line_and_odd_circle(spark):
    line = [("x", str(i), str(i - 1) if i else None, None) for i in range(300)]
    circle = [("y", str(i), str((i + 1) % 7), None) for i in range(7)] + [("y", "z", "3", "t"), ("y", "t", None, None), ("y", "self", "self", None)]
    knot = [("k", a, b, c) for a, b, c in ("abc", "bca", "cab")] + [("k", "d", "a", "d2"), ("k", "d2", None, None)]
    got = same(spark, line + circle + knot)
    assert max(x["generation"] or 0 for x in got) == 299


def test_one_sire_of_all(spark):
    same(spark, [("f", "sire", None, None)] + [("f", str(i), "sire", str(i - 1) if i % 3 else None) for i in range(500)])


def test_odd_rows(spark):
    same(spark, [(None, "a", None, None), ("", "b", "a", "a"), ("", "b", "a", "a"), ("q", None, "a", "b"), ("q", "a", "b", None)])
    assert generations(spark.createDataFrame([], PEOPLE)).count() == 0


def test_read_registry(spark, tmp_path):
    (tmp_path / "a.fam").write_text("# people\nF1 a 0 0 1 -9\nF1\tb\t0\t0\t2\n\nF1 c a b 0 2 # child\n")
    (tmp_path / "b.fam").write_text("F2 a b c\nF2 broken 0\n")
    got = sorted(map(tuple, rd.read_registry(spark, str(tmp_path)).collect()))
    assert got == [("F1", "a", None, None, "male"), ("F1", "b", None, None, "female"), ("F1", "c", "a", "b", "unknown"), ("F2", "a", "b", "c", "unknown")]
    assert [x["line"] for x in rd.rejected_registry_lines(spark, str(tmp_path)).collect()] == ["F2 broken 0"]


def test_rounds_join_numbers(spark, monkeypatch):
    """Names are joined before the rounds and after them; a round's state is numbers, parted by who is settled."""
    written = []
    kept = registry._kept

    def watched(*args):
        written.append(kept(*args))
        return written[-1]

    monkeypatch.setattr(registry, "_kept", watched)
    same(spark, [("f", str(i), str(i // 2) if i > 1 else None, str(i // 3) if i > 2 else None) for i in range(1, 200)])
    assert 2 < len(written) < 20 and all("string" not in dict(s.dtypes).values() for s in written)
    assert all("PartitionFilters: [isnotnull(kind" in s.filter("kind = 0")._jdf.queryExecution().toString() for s in written)
