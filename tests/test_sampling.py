"""Drawn reads against plain code, and first lines of a sorted stream with bounded state."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.operators import observed, sampling
from kinweave.plans import queries
from kinweave.sources.scratch import scratch
from kinweave.streaming import pileup as st

OBS = "chrom int, pos long, sample int, base string, phred int, read_ix int"


def made(spark, seed=3):
    r = random.Random(seed)
    rows = [(1 + s % 2, 10 * s, sample, r.choice("ACG"), r.randrange(20, 41), i) for s in range(60) for sample in range(3) for i in range(r.randrange(0, 5))]
    people = spark.createDataFrame([(i, f"S{i}", 1 + (i == 2)) for i in range(3)], "sample int, name string, min_depth int")
    return rows, spark.createDataFrame(rows, OBS).repartition(4), people


def u01(seed, *keys):
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:12], 16) / 2**48


def plain_draws(rows, depth, draws, two):
    """{(chrom, pos, sample): [(first read, second read), ...]} by sorting every site's reads."""
    sites = defaultdict(list)
    for c, p, s, base, phred, i in rows:
        sites[c, p, s].append((i, base, phred))
    out = {}
    for key, own in sites.items():
        if len(own) >= max(depth[key[2]], 2 if two else 1):
            ranked = [sorted(own, key=lambda x: u01(7, "read" if d == 0 else f"read{d}", *key, x[0])) for d in range(draws)]
            out[key] = [(x[0], x[-1]) for x in ranked]
    return out


@pytest.mark.parametrize("draws", [1, 4])
def test_drawn_pairs(spark, draws):
    rows, obs, people = made(spark)
    one = plain_draws(rows, {0: 1, 1: 1, 2: 2}, draws, False)
    want = {}
    for (c, p, s), a in one.items():
        for t in range(s + 1, 3):
            if (c, p, t) in one:
                b = one[c, p, t]
                num = sum(x[0][1] != y[0][1] for x, y in zip(a, b, strict=True))
                want[f"S{s}-S{t}", c, p] = (num, draws, sum(x[0][2] for x in a) / draws, sum(y[0][2] for y in b) / draws)
    found = {(r["pair"], r["chrom"], r["pos"]): (r["num"], r["den"], r["q0"], r["q1"]) for r in sampling.sampled_pairs(obs, people, 7, draws).collect()}
    assert found == want and want


def test_two_reads_of_one_sample(spark):
    rows, obs, people = made(spark)
    two = plain_draws(rows, {0: 1, 1: 1, 2: 2}, 3, True)
    want = {(f"S{s}-S{s}", c, p): (sum(a[1] != b[1] for a, b in x), 3, sum(a[2] for a, _ in x) / 3, sum(b[2] for _, b in x) / 3) for (c, p, s), x in two.items()}
    found = {(r["pair"], r["chrom"], r["pos"]): (r["num"], r["den"], r["q0"], r["q1"]) for r in sampling.sampled_self(obs, people, 7, 3).collect()}
    assert found == want and want


def test_two_reads_are_fair(spark):
    """Over many sites each ordered pair of three reads is drawn about as often as any other."""
    obs = spark.range(6000).select(F.lit(1).alias("chrom"), "id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("read_ix"))
    obs = obs.select("chrom", F.col("id").alias("pos"), F.lit(0).alias("sample"), F.substring(F.lit("ACG"), F.col("read_ix") + 1, F.lit(1)).alias("base"), F.lit(30).alias("phred"), "read_ix")
    people = spark.createDataFrame([(0, "S0", 1)], "sample int, name string, min_depth int")
    drawn = sampling.drawn_reads(obs, people, 5, two=True).select(F.col("first")[0]["base"].alias("a"), F.col("second")[0]["base"].alias("b"))
    counts = Counter((r["a"], r["b"]) for r in drawn.collect())
    assert len(counts) == 6 and all(a != b for a, b in counts) and all(abs(n - 1000) < 150 for n in counts.values())


def test_draws_merge(spark):
    """Draws that are added one by one give the sums of all of them at once, and a summary as usual."""
    _, obs, people = made(spark)
    parts = [sampling.sampled_pairs(obs, people, seed) for seed in (1, 2, 3)]
    step = sampling.merge_draws(sampling.merge_draws(parts[0], parts[1]), parts[2])
    once = sampling.merge_draws(*reversed(parts))
    key = lambda df: sorted((r["pair"], r["chrom"], r["pos"], r["num"], r["den"], round(r["q0"], 9), round(r["q1"], 9)) for r in df.collect())
    assert key(step) == key(once) and all(r[4] == 3 for r in key(once))
    assert observed.pair_summary(once).count() == 3


def test_no_window_over_reads(spark, capsys):
    _, obs, people = made(spark)
    sampling.sampled_self(obs, people, 7, 2).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "partial_min" in plan and "partial_max" in plan


# Streams


def test_state_of_first_lines_is_bounded(spark, sf):
    kept, reports = queries.first_arrivals(spark, sf)
    most = max(r["numRowsTotal"] for r in reports)
    assert kept.count() > 2 * most > 0
    assert sum(r["numRowsDroppedByWatermark"] for r in reports) == 0


def test_lines_far_behind_are_left_out(spark):
    """A line within the disorder counts (once); one further behind doesn't."""
    source, out, marks = (scratch(spark, n) for n in ("late", "out", "marks"))
    line = lambda pos, ref="A": f"1\t{pos}\t{ref}\t1\t.\tI\t1\t.\tI"
    for lot in ([line(1000), line(2000), line(2000, "C")], [line(1950), line(1000), line(1960), line(2000)], [line(1955)]):
        spark.createDataFrame([(x,) for x in lot], "value string").coalesce(1).write.mode("append").text(source)
        kept = st.first_lines_within(st.line_pairs(st.stream_pileup(spark, source, 10)), 100)
        going = kept.writeStream.outputMode("append").option("checkpointLocation", marks).option("path", out).format("parquet").trigger(availableNow=True).start()
        going.awaitTermination()
    assert sorted(r["pos"] for r in spark.read.parquet(out).collect()) == [1000, 1950, 1955, 1960, 2000]
