"""The store that grows by file: contents, sites that are there already, other sessions, and plans without an exchange of it."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.sources import buckets
from kinweave.sources.scratch import scratch


def rows(n, seed):
    r = random.Random(seed)
    return sorted({(r.randrange(1, 23), r.randrange(1, 10**8)): [r.getrandbits(62), seed] for _ in range(n)}.items())


def frame(spark, made):
    return spark.createDataFrame([(c, p, b) for (c, p), b in made], "chrom int, pos long, bits array<long>")


def contents(df):
    return sorted(((r["chrom"], r["pos"]), list(r["bits"])) for r in df.collect())


def test_growth(spark):
    path, a, b = scratch(spark, "grow"), rows(500, 1), rows(300, 2)
    buckets.create_sites(frame(spark, a), path, 4)
    assert buckets.append_sites(frame(spark, b), path, 4) == 0
    assert contents(buckets.open_sites(spark, path, 4)) == sorted(a + b)
    with pytest.raises(ValueError, match="in the store already"):
        buckets.append_sites(frame(spark, [*rows(50, 3), *a[:2]]), path, 4)
    assert contents(buckets.open_sites(spark, path, 4)) == sorted(a + b)
    changed = [(k, [0, 0]) for k, _ in a[:5]]
    assert buckets.append_sites(frame(spark, changed + rows(50, 3)), path, 4, repeated="skip") == 5
    assert contents(buckets.open_sites(spark, path, 4)) == sorted(a + b + rows(50, 3))
    assert buckets.append_sites(frame(spark, []), path, 4) == 0
    with pytest.raises(Exception, match="already exists"):
        buckets.create_sites(frame(spark, a), path, 4)


def test_another_session_opens_it(spark):
    path, a = scratch(spark, "other"), rows(200, 4)
    buckets.create_sites(frame(spark, a), path, 4)
    spark.sql(f"DROP TABLE {buckets._table(path)}")  # an external table: its files stay
    assert contents(buckets.open_sites(spark, path, 4)) == a
    buckets.append_sites(frame(spark, rows(100, 5)), path, 4)
    assert contents(buckets.open_sites(spark, path, 4)) == sorted(a + rows(100, 5))


def test_lookups_move_the_other_side_alone(spark, capsys):
    path, a = scratch(spark, "plan"), rows(400, 6)
    buckets.create_sites(frame(spark, a[:300]), path, 4)
    buckets.append_sites(frame(spark, a[300:]), path, 4)
    asked = frame(spark, a[::3] + rows(30, 7)).select("chrom", "pos", F.lit("p").alias("pair"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = buckets.look_up(asked, path, 4)
        found.explain()
        plan = capsys.readouterr().out.splitlines()
        assert contents(found) == a[::3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(i for i, line in enumerate(plan) if "FileScan parquet" in line)
    depth = plan[scan].index("FileScan")
    above = []  # operators on the way from the scan to the join
    for line in reversed(plan[:scan]):
        at = len(line) - len(line.lstrip(" :+-"))
        if at < depth:
            above.append(line)
            depth = at
        if "Join" in line:
            break
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in above), above
    assert sum("Exchange hashpartitioning(chrom" in line for line in plan) == 1
