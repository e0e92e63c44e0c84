"""Near-dedup: SetSketch registers, banded, estimated jointly by likelihood, then verified on full sets.

1. Every text becomes the set of its distinct five-word shingles (64-bit hashes) and a SetSketch of 320 registers. An
   element's values are exponentially spaced (ascending order statistics) and go to the registers along a permutation
   of its own; a register keeps the least value, truncated to a power of b. Elements stop once their next value is above
   all registers, so long texts cost few draws per shingle.
2. Equal sets form a class, named by its smallest id; from here on a class counts once, however many copies it has.
3. Registers are cut into bands, more and shorter ones for a lower threshold (``bands_for``): 40 of 8 from 0.85 on, where
   two sets at the threshold share no band with probability 3 in a million, 64 of 5 for 0.80 (9e-12); above it less.
   Classes that share a band are linked to the smallest one of that bucket, and the connected components of these links
   are families: no two classes of different families share a band.
4. Families are dealt to bounded bins. In a bin, pairs that share a band are estimated: maximum likelihood of the
   Jaccard similarity given which register of each is larger and both set sizes. Those within reach of the threshold
   are verified on the full sets, best first, and only while they lie in different components; a bin returns a
   spanning forest of its verified links, not pairs.
5. A family too large for one task is first held against its pivots: every class meets the smallest class that it
   shares a band with, in blocks of bounded size. What is linked then is one component. Families that still hold several
   components are dealt again, so that every pair that shares a band and is still apart meets in some bounded task:
   either the main component's blocks each with every block of the others, and the others' blocks with each other, or
   bucket by bucket, whichever sends fewer rows. The links are joined by connected components.

Null ids link with nothing. Texts without words have an empty set and link with nothing. Rows that repeat an id are
taken as linked. Ids are integers. Texts above 4 MB are cut into shingles part by part; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialise, shuffle_partitions
from .textbytes import LOWER, PART_BYTES, RangeHash, buffer_of, mix, slices, word_bounds, word_count, word_parts

SHINGLE = 5
REGISTERS, LEAST_BANDS = 320, 40
#: Share of pairs at the threshold that may be without a common band.
MOST_MISSED = 1e-5
#: Base, rate and largest value of the registers (16 bits each).
B, A, Q = 1.001, 20.0, (1 << 16) - 2
STEPS = np.array([t for t in range(1, REGISTERS) if math.gcd(t, REGISTERS) == 1], np.int64)
#: A family up to this size goes to one task as a whole, as does a block of a larger one; bins take about BIN_SHINGLES.
FAMILY_DOCS, FAMILY_SHINGLES, BIN_SHINGLES = 4_000, 500_000, 500_000
#: Hashes that are sketched at a time.
SKETCHED = 1 << 20


def _distinct(owner: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): each owner's distinct hashes, one owner after the other."""
    packed = (owner.astype(np.uint64) << np.uint64(44)) | (hashed >> np.uint64(20))
    order = np.argsort(packed)
    tied = packed[order][1:] == packed[order][:-1]
    if (hashed[order][1:][tied] != hashed[order][:-1][tied]).any():  # hashes that agree in their high bits only
        order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    owner, hashed = owner[new], hashed[new]
    return hashed, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the distinct shingle hashes of each text, one text after the other. A single long text is read
    in parts that overlap by a shingle less a word."""
    if len(offsets) == 2 and len(data) > PART_BYTES and word_count(data) >= SHINGLE:
        parts = [_sets(data[a:b], np.array([0, b - a]))[0] for a, b in word_parts(data, SHINGLE - 1) if word_count(data[a:b]) >= SHINGLE]
        hashed = np.unique(np.concatenate(parts))
        return hashed, np.array([0, len(hashed)])
    return _sets(data, offsets)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    start, end, doc = word_bounds(data, offsets)
    words = RangeHash(LOWER[data])(start, end)
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    factor = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        whole = max(0, len(words) - SHINGLE + 1)
        hashed = np.zeros(whole, np.uint64)
        for k in range(SHINGLE):
            hashed = hashed * factor + words[k : k + whole]
        hashed = mix(hashed, 11)
        inside = doc[:whole] == doc[SHINGLE - 1 : SHINGLE - 1 + whole] if whole else np.zeros(0, bool)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        shorts = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = counts[short] > k
            at = np.where(has, first[short] + k, 0)
            shorts = np.where(has, shorts * factor + words[at], shorts) if len(words) else shorts
        shorts = mix(shorts + counts[short].astype(np.uint64), 12)
    return _distinct(np.concatenate([doc[:whole][inside], short]), np.concatenate([hashed[inside], shorts]), n)


def _minima(h: np.ndarray, doc: np.ndarray, least: np.ndarray) -> None:
    """Lowers the registers ``least`` (texts x REGISTERS) by the values of the elements h of the texts doc."""
    flat = least.reshape(-1)
    place = (mix(h, 21) % np.uint64(REGISTERS)).astype(np.int64)
    step = STEPS[(mix(h, 22) % np.uint64(len(STEPS))).astype(np.int64)]
    x = np.zeros(len(h))
    for j in range(REGISTERS):
        u = ((mix(h, 100 + j) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) / (A * (REGISTERS - j))
        np.minimum.at(flat, doc * REGISTERS + place, x)
        place = (place + step) % REGISTERS
        if j < 16 or j % 4 == 0:
            live = np.unique(doc)
            most = np.empty(len(least))
            most[live] = least[live].max(axis=1)
            on = x < most[doc]
            if not on.all():
                h, doc, place, step, x = h[on], doc[on], place[on], step[on], x[on]
        if not len(h):
            break


def sketches(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (texts x REGISTERS, uint16) of consecutive sets."""
    n = len(starts) - 1
    least = np.full((n, REGISTERS), np.inf)
    for a in range(0, len(hashes), SKETCHED):
        h = hashes[a : a + SKETCHED]
        _minima(h, np.searchsorted(starts, np.arange(a, a + len(h)), "right") - 1, least)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / math.log(B))
    return np.clip(k, 0, Q + 1).astype(np.uint16)


def bands_for(least: int) -> int:
    """The fewest bands of equal length, from LEAST_BANDS on, that miss at most MOST_MISSED of the pairs of similarity
    ``least`` hundredths. Thresholds that no number of bands can serve so are refused."""
    counts = [b for b in range(LEAST_BANDS, REGISTERS + 1) if REGISTERS % b == 0]
    found = next((b for b in counts if (1 - (least / 100) ** (REGISTERS // b)) ** b <= MOST_MISSED), None)
    if found is None:
        raise ValueError(f"a similarity of {least} hundredths is too low for {REGISTERS} registers")
    return found


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band, different from band to band."""
    out = np.empty((len(registers), bands), np.uint64)
    rows = REGISTERS // bands
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(registers), b + 1, np.uint64)
            for r in range(b * rows, (b + 1) * rows):
                key = mix(key ^ registers[:, r].astype(np.uint64), 31)
            out[:, b] = key
    return out


def _share(x: np.ndarray) -> np.ndarray:
    """Probability that a register of the first set is larger, for x = u - vJ."""
    return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / math.log(B)


def joint_likelihood(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, given how many registers of the first sketch are larger, smaller
    and equal, and the sizes of both sets. Golden-section search, as the likelihood has one peak."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def loss(j):
        p, q = _share(u - v * j), _share(v - u * j)
        rest = np.maximum(1 - p - q, 1e-12)
        return -(larger * np.log(np.maximum(p, 1e-12)) + smaller * np.log(np.maximum(q, 1e-12)) + equal * np.log(rest))

    low, high, g = np.zeros(len(u)), top.copy(), (math.sqrt(5) - 1) / 2
    for _ in range(24):
        a, b = high - g * (high - low), low + g * (high - low)
        left = loss(a) < loss(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def estimate(registers: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 15):
        a, b = registers[i[s : s + (1 << 15)]], registers[j[s : s + (1 << 15)]]
        larger, equal = (a > b).sum(axis=1), (a == b).sum(axis=1)
        out[s : s + (1 << 15)] = joint_likelihood(larger, REGISTERS - larger - equal, equal, sizes[i[s : s + (1 << 15)]], sizes[j[s : s + (1 << 15)]])
    return out


def _bucket_pairs(order: np.ndarray, size: np.ndarray, first: np.ndarray, group: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within buckets whose members lie in different components (``group``), some at a time."""
    for s, at in zip(size.tolist(), first.tolist(), strict=True):
        own = order[at : at + s]
        if (group[own] == group[own[0]]).all():
            continue
        rows = max(1, most // s)
        for r in range(0, s, rows):
            i, j = np.nonzero(group[own[r : r + rows], None] != group[None, own])
            up = i + r < j
            yield own[i[up] + r], own[j[up]]


def link_sets(hashes: np.ndarray, starts: np.ndarray, least: int, known: np.ndarray | None = None) -> np.ndarray:
    """Component (the index of a member) of each set, where sets with 100 * intersection >= least * union are linked.
    Sets with the same number in ``known`` are taken as linked already."""
    n = len(starts) - 1
    sizes = np.diff(starts)
    registers = sketches(hashes, starts)
    keys = band_keys(registers, bands_for(least))
    parent = np.arange(n)
    if known is not None and n:
        _, first, which = np.unique(known, return_index=True, return_inverse=True)
        parent = first[which]
    # Reach of the estimate: five standard deviations below the threshold.
    reach = least / 100 - 5 * math.sqrt(least / 100 * (1 - least / 100) / REGISTERS)

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = int(parent[a])
        return a

    def groups() -> np.ndarray:
        out = parent.copy()
        while (out != parent[out]).any():
            out = parent[out]
        return out

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        near = (100 * np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j])) & (sizes[i] > 0)
        i, j = i[near], j[near]
        likely = estimate(registers, sizes, i, j)
        order = np.argsort(-likely, kind="stable")
        for k in order[likely[order] >= reach].tolist():
            a, b = int(i[k]), int(j[k])
            ra, rb = root(a), root(b)
            if ra != rb:
                x, y = hashes[starts[a] : starts[a + 1]], hashes[starts[b] : starts[b + 1]]
                both = _common(x, y)
                if 100 * both >= least * (len(x) + len(y) - both):
                    parent[max(ra, rb)] = min(ra, rb)

    buckets = []
    for b in range(keys.shape[1]):
        order = np.argsort(keys[:, b], kind="stable")
        new = np.flatnonzero(np.concatenate([[True], keys[order[1:], b] != keys[order[:-1], b]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(new, n))
        buckets.append((order, size[size > 1], new[size > 1]))
    # Each bucket's first member with all others that are apart from it: joins most of a group that is alike.
    for order, size, first in buckets:
        if len(size):
            group = groups()
            own = np.repeat(order[first], size - 1)
            rest = np.concatenate([order[a + 1 : a + s] for s, a in zip(size.tolist(), first.tolist(), strict=True)])
            apart = group[own] != group[rest]
            verify(own[apart], rest[apart])
    # Then every pair that shares a band and is still apart, in the first band that it shares.
    for b, (order, size, first) in enumerate(buckets):
        if len(size):
            group = groups()
            held: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0
            for i, j in _bucket_pairs(order, size, first, group):
                fresh = np.concatenate([~(keys[i[s : s + (1 << 15)], :b] == keys[j[s : s + (1 << 15)], :b]).any(axis=1) for s in range(0, len(i), 1 << 15)]) if b and len(i) else np.ones(len(i), bool)
                held.append((i[fresh], j[fresh]))
                waiting += len(held[-1][0])
                if waiting >= 1 << 19:
                    verify(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, waiting = [], 0
            if held:
                verify(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return groups()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sets, sorted by their high bits as shingle_sets leaves them."""
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _sketched(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            hashes, starts = shingle_sets(*buffer_of(batch.column("text")))
            sums = []
            for seed in (41, 42):
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes, seed))])
                    sums.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
            keys = band_keys(sketches(hashes, starts), bands).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(starts)), pa.array(sums[0]), pa.array(sums[1]), lists], names=["id", "n", "d1", "d2", "bands"])


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 85,
    family_docs: int = FAMILY_DOCS,
    family_shingles: int = FAMILY_SHINGLES,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs. ``least`` is the similarity in hundredths at
    which two documents are linked; the lower, the more bands are shuffled."""
    spark = docs.sparkSession
    bands = bands_for(least)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = materialise(rows.mapInArrow(lambda batches: _sketched(batches, bands), "id long, n long, d1 long, d2 long, bands array<long>"), "sets")
    real = base.filter("n > 0 AND id IS NOT NULL")
    classes = materialise(real.groupBy("d1", "d2", "n").agg(F.min("id").alias("cls"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("cls", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("cls").alias("pivot"), F.max("cls").alias("other")).filter("pivot < other")
    edges = banded.join(shared.select("key", "pivot"), "key").filter("cls <> pivot").select(F.col("cls").alias("u"), F.col("pivot").alias("v")).distinct()
    edges = materialise(edges, "band-links")
    roots = connected_components(edges)
    tops = roots.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    members = materialise(roots.unionAll(tops).join(classes.select(F.col("cls").alias("node"), "n"), "node").select(F.col("node").alias("cls"), F.col("component").alias("family"), "n"), "families")
    sized = members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    large = sized.filter((F.col("docs") > family_docs) | (F.col("shingles") > family_shingles)).select("family")
    n_large = large.count()

    # The texts of all families, by one shuffle of the documents at any size; what is dealt later joins these.
    texts = materialise(rows.join(members.select("cls").hint("merge"), rows["id"] == F.col("cls")).select("cls", "text"), "family-texts")

    def linked(dealt: DataFrame) -> DataFrame:
        """Links (u, v) of the classes dealt together; dealt: (cls, n, group, known), where ``known`` numbers what is linked already."""
        total = dealt.agg(F.sum("n")).first()[0] or 0
        bins = max(shuffle_partitions(spark), math.ceil(total / BIN_SHINGLES))
        placed = dealt.withColumn("bin", F.pmod(F.col("group"), F.lit(bins)).cast("int")).select("cls", "known", "bin").distinct()
        # As many tasks as bins: a bin is small but takes long, so none should share a task.
        together = texts.join(placed, "cls").select("bin", "cls", "known", "text").repartition(bins, "bin")
        return together.groupBy("bin").applyInArrow(lambda key, table: _links(table, least), "u long, v long")

    whole = members.join(large, "family", "left_anti") if n_large else members
    dealt = whole.select("cls", "n", F.xxhash64("family").alias("group"), F.col("cls").alias("known"))
    if n_large:
        own = materialise(members.join(large, "family", "left_semi"), "large-families")
        pivots = edges.groupBy(F.col("u").alias("cls")).agg(F.min("v").alias("pivot")).join(own, "cls")
        first = materialise(linked(dealt.unionAll(_pivot_blocks(pivots, own, family_docs, family_shingles))), "first-links")
        joined = connected_components(first)
        known = own.join(joined, own["cls"] == joined["node"], "left").select("cls", "family", "n", F.coalesce("component", "cls").alias("known"))
        again = materialise(_still_apart(classes.select("cls", "bands").join(known, "cls"), family_docs, family_shingles), "apart")
        found = connected_components(first.unionAll(linked(again)))
    else:  # each family was whole in one bin: its links already lead to the smallest member
        found = materialise(linked(dealt).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "links")
    named = classes.join(found, classes["cls"] == found["node"], "left").select("d1", "d2", "n", F.coalesce("component", "cls").alias("component_id"))
    real_id = F.when(F.col("n") > 0, F.col("id"))
    out = base.drop("bands").join(named, ["d1", "d2", "n"], "left")
    component = F.when(real_id.isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _links(table: pa.Table, least: int) -> pa.Table:
    """(u, v): the members of a task's table that are linked, each with the smallest of its component."""
    ids = table.column("cls").to_numpy()
    sets = [shingle_sets(*buffer_of(b.column("text"))) for whole in table.combine_chunks().to_batches() for b in slices(whole, "text")]
    hashes = np.concatenate([h for h, _ in sets]) if sets else np.zeros(0, np.uint64)
    sizes = np.concatenate([np.diff(s) for _, s in sets]) if sets else np.zeros(0, np.int64)
    found = link_sets(hashes, np.concatenate([[0], np.cumsum(sizes)]), least, table.column("known").to_numpy())
    best = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(best, found, ids)
    apart = best[found] != ids
    return pa.table({"u": pa.array(ids[apart], pa.int64()), "v": pa.array(best[found][apart], pa.int64())})


def _blocks(docs: F.Column, shingles: F.Column, most_docs: int, most_shingles: int) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(docs / most_docs), F.ceil(shingles / most_shingles)).cast("int")


def _pivot_blocks(pivots: DataFrame, members: DataFrame, most_docs: int, most_shingles: int) -> DataFrame:
    """(cls, n, group, known): the classes (cls, pivot, n) in bounded blocks, each with its pivot."""
    sized = pivots.groupBy("pivot").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    sized = sized.select("pivot", _blocks(F.col("docs"), F.col("shingles"), most_docs, most_shingles).alias("blocks"))
    group = F.xxhash64("pivot", "block").alias("group")
    own = pivots.join(sized, "pivot").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    every = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tops = every.join(members.select(F.col("cls").alias("pivot"), "n"), "pivot").select(F.col("pivot").alias("cls"), "n", group)
    return own.select("cls", "n", group).unionAll(tops).withColumn("known", F.col("cls"))


def _still_apart(members: DataFrame, most_docs: int, most_shingles: int) -> DataFrame:
    """(cls, n, group, known): members (cls, bands, family, n, known) of families that hold several components (``known``),
    dealt so that all pairs of different components that share a band meet; each family in the way that takes fewer rows."""
    half = lambda docs, shingles: _blocks(2 * docs, 2 * shingles, most_docs, most_shingles)
    main = F.max(F.struct("docs", "known", "shingles")).alias("main")
    parts = members.groupBy("family", "known").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    sized = parts.groupBy("family").agg(F.count("*").alias("parts"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"), main).filter("parts > 1")
    others = F.col("docs") - F.col("main.docs")
    sized = sized.select("family", "main", others.alias("others"), half(F.col("main.docs"), F.col("main.shingles")).alias("mains"), half(others, F.col("shingles") - F.col("main.shingles")).alias("rest"))
    sized = sized.withColumn("by_family", F.col("main.docs") * F.col("rest") + F.col("others") * (F.col("mains") + F.col("rest")))
    # Buckets that are still open; a bucket lies in one family.
    spread = members.select("cls", "family", "n", "known", F.explode("bands").alias("key"))
    cells = spread.groupBy("key", "known").agg(F.min("family").alias("family"), F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    buckets = cells.groupBy("key").agg(F.min("family").alias("family"), F.count("*").alias("parts"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles")).filter("parts > 1")
    one = (F.col("docs") <= most_docs) & (F.col("shingles") <= most_shingles)
    buckets = buckets.withColumn("blocks", F.when(one, F.lit(1)).otherwise(half(F.col("docs"), F.col("shingles"))))
    buckets = materialise(buckets.select("key", "family", "docs", "blocks"), "open-buckets")
    costs = buckets.groupBy("family").agg(F.sum(F.col("docs") * F.col("blocks")).alias("by_bucket"))
    chosen = materialise(sized.join(costs, "family").withColumn("whole", F.col("by_family") <= F.col("by_bucket")), "ways")
    # A family's blocks: the main component's with every one of the others', and the others' with each other.
    ways = chosen.filter("whole").select("family", F.col("main.known").alias("main"), "mains", "rest")
    row = members.join(ways, "family").select("cls", "n", "known", "family", (F.col("known") == F.col("main")).alias("own"), "mains", "rest")
    row = row.withColumn("block", F.pmod(F.xxhash64("cls"), F.when(F.col("own"), F.col("mains")).otherwise(F.col("rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met = lambda a, b: F.xxhash64("family", F.lit(1), a, b)
    with_others = F.transform(upto("rest"), lambda j: met(F.col("block"), j))
    with_main = F.transform(upto("mains"), lambda i: met(i, F.col("block")))
    each_other = F.transform(upto("rest"), lambda j: F.xxhash64("family", F.lit(2), F.least("block", j), F.greatest("block", j)))
    groups = F.when(F.col("own"), with_others).otherwise(F.concat(with_main, each_other))
    by_family = row.select("cls", "n", F.explode(groups).alias("group"), "known")
    # Or the open buckets, large ones by pairs of blocks.
    open_ = buckets.join(chosen.filter("NOT whole").select("family"), "family", "left_semi").select("key", "blocks")
    placed = spread.select("cls", "n", "known", "key").join(open_, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return by_family.unionAll(placed.select("cls", "n", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "known"))
