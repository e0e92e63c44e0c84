"""From a pileup of every kind of token to the printed pair file, against a plain version of the whole way."""

import random
from itertools import combinations
from statistics import fmean, stdev

from kinweave.operators import observed as ob
from kinweave.sources import readers as rd
from kinweave.sources import sinks


def make_lines(seed=11, sites=400, samples=3):
    """(text lines, reads by (site, sample))"""
    r = random.Random(seed)
    lines, reads = [], {}
    for k in range(sites):
        ref, fields = r.choice("ACGT"), []
        for s in range(samples):
            depth = r.choice([0, 1, 1, 2, 3])
            bases, quals, own = "", "", []
            for _ in range(depth):
                base, q = r.choice([ref, ref, ref, r.choice("ACGTN")]), r.randrange(20, 50)
                text = r.choice(".,") if base == ref else r.choice([base, base.lower()])
                text = r.choice(["", "", "^+", "^F", "^$"]) + text + r.choice(["", "", "$", "+3acg", "-61" + "ACGTT" * 12 + "A", "+130" + "g" * 130])
                bases, quals = bases + text + r.choice(["", "", "*"]), quals + chr(q + 33)
                own.append((base, q))
            fields += [str(depth), bases or "*", quals or "*"]
            reads[k, s] = own
        lines.append("\t".join([str(1 + k % 22), str(1000 + 37 * k), ref, *fields]))
    return lines, reads


def plain_file(reads, sites, samples, least=30):
    out = ["Pair_name\tRaw.Overlap\tRaw.Sum.PWD\tRaw.Avg.PWD\tRaw.CI.95\tRaw.Avg.Phred"]
    for a, b in combinations(range(samples), 2):
        rates, quality = [], []
        for k in range(sites):
            x, y = ([c for c in reads[k, s] if c[1] >= least] for s in (a, b))
            if x and y:
                rates.append(fmean(i[0] != j[0] for i in x for j in y))
                quality.append((fmean(c[1] for c in x) + fmean(c[1] for c in y)) / 2)
        ci = 1.96 * stdev(rates) / len(rates) ** 0.5
        out.append(f"Ind{a}-Ind{b}\t{len(rates)}\t{sum(rates):.1f}\t{fmean(rates):.6f}\t{ci:.6f}\t{fmean(quality):.6f}")
    return out


def test_printed_file(spark, tmp_path):
    lines, reads = make_lines()
    (tmp_path / "x.pileup").write_text("\n".join(lines) + "\n")
    obs = ob.filter_quality(rd.explode_reads(rd.read_pileup(spark, str(tmp_path / "x.pileup"))), 30)
    summary = ob.pair_summary(ob.pair_sites(obs, ob.sample_table(obs, [0, 1, 2])))
    sinks.write_pwd(summary.coalesce(1), str(tmp_path / "out"))
    got = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert got == plain_file(reads, 400, 3)
