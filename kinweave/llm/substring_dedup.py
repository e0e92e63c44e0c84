"""Suffix-array dedup: remove every byte under a string of ``length`` bytes that also starts anywhere else.

1. Each string is owned by one anchor: the least hash among the ``k``-grams inside it. The starts that share an anchor
   occurrence are consecutive and make a fragment (the bytes of all their strings). Equal strings have equal anchors,
   so only fragments of the same anchor can share a string, and every string lies in exactly one fragment.
2. Fragments are known by hashes of their bytes. An anchor that occurs once can't repeat a string and is dropped. A
   fragment that occurs twice repeats every string of it: it is covered as a whole and goes on as one copy, since sorting
   suffixes of equal bytes would find nothing else; an anchor with a single distinct fragment is settled.
3. A shared string holds one of a few windows at fixed offsets from the anchor, three quarters of its length; distinct
   fragments that share no window hash with another one of their anchor are dropped. The remaining ones are cut out of
   their documents and packed by anchor into shards of about ``shard_bytes``. A shard sorts the suffixes of its
   fragments, takes the Burrows-Wheeler transform, and expands intervals breadth first: from all intervals of strings of
   length l, backward extension by each preceding byte gives those of length l + 1, and a boundary reached for the first
   time has a common prefix of l. Prefixes thus come by increasing value, and at ``length`` the expansion stops:
   boundaries not reached yet join suffixes that share a whole string.
4. An anchor with more than ``anchor_bytes`` (a passage in a large part of all documents) is cut finer: its fragments are
   aligned at the anchor, so strings are told apart by where in them the anchor stands. For each range of such places a
   fragment gives one piece; pieces of one range meet only where they share the bytes that all strings of the range
   hold. Equal pieces count as one, and each such group goes to the shards. Groups that are still too large are cut to
   narrower ranges, down to single strings, where equal pieces are all there is.
5. Covered starts go back to all copies of a piece or fragment and from there to the documents, which lose the bytes.

Strings are judged on the input; overlapping occurrences within one document count. Null texts are empty. Rows that
repeat an id are documents of their own; if they repeat the text as well, each repeats the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, shuffle_partitions
from .textbytes import RangeHash, buffer_of, slices

LENGTH, ANCHOR = 400, 32
#: Windows of a fragment: any string of ``length`` bytes around an anchor covers one of them.
WINDOWS = 4
#: Bytes of fragments that a shard takes, and those of one anchor (or group of pieces) that stay together, at most.
SHARD_BYTES, ANCHOR_BYTES = 192 << 10, 192 << 10
#: Shards that are packed together.
PACKED = 64
#: A longer text is read in parts; bits of a place in what is read at once.
PART_BYTES, PLACE_BITS = 4 << 20, 24
NO_ID = -(2**63)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values: of prefix minima and suffix minima within blocks of w."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first start within the text, number of starts, anchor's place after the first start, anchor hash, fragment
    hash, window hashes...) of all fragments. A window hash has 32 bits; 0 where the window would leave the text. Chance
    agreements of anchors and windows cost time only. Two equal strings have the same anchor, unless two of its candidates
    agree in the high bits that are compared and differ in order elsewhere: then the first one counts, in both."""
    n = len(data)
    ranges = RangeHash(data)
    grams = ranges.rolling(k)
    # One width for all batches, so that equal strings have equal anchors wherever they lie.
    if n >= 1 << PLACE_BITS:
        raise ValueError(f"a batch of {n} bytes is too long")
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    least = window_minima(packed, length - k + 1)  # for each start of a string
    m = len(least)
    edge = np.zeros(m + 1, bool)
    edge[:1] = edge[m:] = True
    edge[1:m] = least[1:] != least[:-1]
    stops = offsets[1:] - length + 1  # the first start in each text that has no string
    edge[offsets[:-1][offsets[:-1] < m]] = True
    edge[stops[(stops > 0) & (stops < m)]] = True
    at = np.flatnonzero(edge)
    first, end = at[:-1], at[1:]
    text = np.searchsorted(offsets, first, "right") - 1
    real = first + length <= offsets[text + 1]
    first, end, text = first[real], end[real], text[real]
    place = (least[first] & low).astype(np.int64)
    step = -(-length // WINDOWS)
    windows = []
    for j in range(WINDOWS):
        a = place - j * step
        b = a + length - step
        inside = (a >= offsets[text]) & (b <= offsets[text + 1])
        hashed = ranges(np.where(inside, a, 0), np.where(inside, b, 0), 4 + j)
        windows.append(np.where(inside, (hashed >> np.uint64(32)) | np.uint64(1), np.uint64(0)).astype(np.uint32).view(np.int32))
    return text, first - offsets[text], end - first, place - first, grams[place], ranges(first, end - 1 + length, 2), *windows


def fragments_in_parts(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``fragments``, of a single long text a part at a time, so that memory stays bounded. Parts overlap by one string
    less a byte: each string lies in one part, with its anchor and the window it covers."""
    if len(offsets) != 2 or len(data) <= PART_BYTES:
        yield fragments(data, offsets, length, k)
        return
    for s in range(0, len(data), PART_BYTES):
        part = data[s : s + PART_BYTES + length - 1]
        text, at, *rest = fragments(part, np.array([0, len(part)]), length, k)
        yield text, at + s, *rest


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` codes at least, by doubling; after the first round only suffixes that
    still share a rank are sorted on. Equal ones may stand in any order."""
    n = len(codes)
    base = int(codes.max()) + 2
    step = max(1, min(4, int(62 // math.log2(base))))
    key = np.zeros(n, np.int64)
    for j in range(step):
        key = key * base + np.concatenate([codes[j:] + 1, np.zeros(min(j, n), np.int64)])
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)  # the first row of those with an equal prefix, plus one; past the end 0
    rank[n] = 0
    row = np.arange(n)  # of the suffixes that aren't told apart yet
    suffix, sorted_key = order, key[order]
    while True:
        new = np.ones(len(suffix), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        group = np.cumsum(new) - 1
        first = row[new]
        rank[suffix] = first[group] + 1
        shared = np.bincount(group, minlength=len(first))[group] > 1 if len(group) else new
        suffix, row = suffix[shared], row[shared]
        if step >= depth or not len(suffix):
            return order
        key = rank[suffix] * (n + 1) + rank[np.minimum(suffix + step, n)]
        by = np.argsort(key)
        suffix, sorted_key = suffix[by], key[by]
        order[row] = suffix
        step *= 2


def repeated_starts(parts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, start within it) of every string of ``length`` bytes that starts more than once in the parts."""
    count = len(parts)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    ends = np.cumsum(sizes)
    # Each part ends with a separator of its own, so that no string runs on into the next part.
    codes = np.empty(int(ends[-1]) if count else 0, np.int64)
    for i, (p, e) in enumerate(zip(parts, ends.tolist(), strict=True)):
        codes[e - len(p) - 1 : e - 1] = p.astype(np.int64) + count
        codes[e - 1] = i
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_order(codes, length + 1)
    bwt = codes[order - 1]
    narrow = bwt.astype(np.uint16) if count + 256 < 1 << 16 else bwt
    by_code = np.argsort(narrow, kind="stable")
    back = np.empty(n, np.int64)  # row of the suffix that is one byte longer
    back[by_code] = np.arange(n)
    following = np.full(n, n, np.int64)  # next row with the same preceding byte
    same = bwt[by_code[1:]] == bwt[by_code[:-1]]
    following[by_code[:-1][same]] = by_code[1:][same]
    keyed = bwt[by_code] * (n + 1) + by_code
    reached = np.zeros(n + 1, bool)  # boundary before a row whose common prefix is known to be shorter than length
    reached[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(length):
        if not len(low):
            break
        width = high - low + 1
        owner = np.repeat(np.arange(len(low)), width)
        row = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + low[owner]
        last = following[row] > high[owner]  # the last row of each preceding byte within its interval
        row, owner = row[last], owner[last]
        top = back[row]
        fresh = ~reached[top + 1]
        row, owner, top = row[fresh], owner[fresh], top[fresh]
        reached[top + 1] = True
        low = np.searchsorted(keyed, bwt[row] * (n + 1) + low[owner])
        high = top
    again = ~reached[:-1] | ~reached[1:]
    at = np.sort(order[again])
    part = np.searchsorted(ends, at, "right")
    return part, at - (ends[part] - sizes[part])


def joined(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as maximal runs, touching ones joined."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    cut = np.flatnonzero(new)
    return first[cut], end[np.append(cut[1:], len(first)) - 1] if len(first) else end


WINDOW_NAMES = [f"w{j}" for j in range(WINDOWS)]
FRAGMENT = "id long, t long, at int, n int, off int, anchor long, frag long, " + ", ".join(f"{w} int" for w in WINDOW_NAMES)
CUT = "anchor long, frag long, off int, part binary"
CELL = "anchor long, frag long, lo int, shift int, off int, core long, piece long, part binary"
COVERED = "anchor long, frag long, a int, b int"


def _expanded(pieces: DataFrame, groups: DataFrame, by: list[str], names: list[str], length: int, shard_bytes: int) -> DataFrame:
    """(names, a, b): runs of starts of the strings that repeat within the groups of pieces (names, part). ``groups`` has
    a row (by, bytes) for each group; groups are packed, whole, into shards of about ``shard_bytes``."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    w = W.partitionBy("bucket").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    packed = groups.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(total / (PACKED * shard_bytes))))))
    packed = materialise(packed.select(*by, "bucket", F.floor((F.sum("bytes").over(w) - F.col("bytes") / 2) / shard_bytes).alias("slot")), "shards")
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", a int, b int"

    def expand(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("part").to_pylist()]
        part, at = repeated_starts(parts, length)
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(part)) - 1 if len(first) else first
        which = pa.array(part[first])
        own = {n: table.column(n).take(which) for n in names}
        return pa.table(own | {"a": pa.array(at[first], pa.int32()), "b": pa.array(at[last] + 1, pa.int32())})

    # So many tasks as asked for: shards are small but take long, so few of them should share a task.
    tasks = max(shuffle_partitions(pieces.sparkSession), math.ceil(total / (PACKED * shard_bytes)))
    dealt = pieces.join(packed, by).select("bucket", "slot", *names, "part").repartition(tasks, "bucket", "slot")
    return dealt.groupBy("bucket", "slot").applyInArrow(expand, schema)


def _cells(width: int, length: int):
    """Pieces of pieces: of (anchor, frag, shift, off, part) one for each range of ``width`` places of the anchor. A piece
    starts ``shift`` bytes after its fragment and has the anchor at ``off``; ``core`` are the bytes that every string of
    its range holds, ``piece`` all of them."""
    digest = xxhash.xxh3_64_intdigest
    signed = lambda x: np.array(x, np.uint64).view(np.int64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, los, shifts, offs, cores, hashes, cut = [], [], [], [], [], [], []
            for i, (shift, off, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shift", "off", "part")), strict=True)):
                least = off - (len(part) - length)  # the anchor's place in the last string of the piece
                for lo in range(least // width * width, off + 1, width):
                    low, high = max(lo, least), min(lo + width - 1, off)
                    own = part[off - high : off - low + length]
                    at.append(i)
                    los.append(lo)
                    shifts.append(shift + off - high)
                    offs.append(high)
                    cores.append(digest(part[off - lo : off - lo - width + 1 + length]))
                    hashes.append(digest(own))
                    cut.append(own)
            which = pa.array(at, pa.int64())
            ints = (pa.array(x, pa.int32()) for x in (los, shifts, offs))
            columns = [batch.column("anchor").take(which), batch.column("frag").take(which), *ints, pa.array(signed(cores)), pa.array(signed(hashes)), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in CELL.split(", ")])

    return split


def _hot_anchors(pieces: DataFrame, length: int, most_bytes: int, shard_bytes: int) -> DataFrame:
    """(anchor, frag, a, b): repeated starts of the fragments (anchor, frag, off, part) of anchors with many bytes."""
    group, each = ["anchor", "lo", "core"], ["anchor", "lo", "core", "piece"]
    width = 1 << max(0, (length // 3).bit_length() - 1)
    open_, out = pieces.withColumn("shift", F.lit(0)), None
    while True:
        cells = materialise(open_.select("anchor", "frag", "shift", "off", "part").mapInArrow(_cells(width, length), CELL), "cells")
        kinds = cells.groupBy(*each).agg(F.count("*").alias("copies"), F.max(F.length("part")).alias("bytes"), F.min("frag").alias("one"))
        kinds = materialise(kinds, "kinds")
        groups = materialise(kinds.groupBy(*group).agg(F.count("*").alias("kinds"), F.sum("bytes").alias("bytes")).filter("kinds > 1"), "groups")
        small = groups.filter(F.col("bytes") <= most_bytes)
        ones = kinds.select(*each, F.col("one").alias("frag")).join(small.select(*group), group, "left_semi")
        parts = cells.select(*each, "frag", "part").join(ones, [*each, "frag"], "left_semi")
        repeated = _expanded(parts, small.select(*group, "bytes"), group, each, length, shard_bytes)
        equal = kinds.filter("copies > 1").select(*each, F.lit(0).alias("a"), (F.col("bytes") - (length - 1)).cast("int").alias("b"))
        found = materialise(repeated.unionAll(equal), "piece-cover")
        found = cells.select(*each, "frag", "shift").join(found, each).select("anchor", "frag", (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"))
        out = found if out is None else out.unionAll(found)
        large = groups.filter(F.col("bytes") > most_bytes).select(*group)
        if width == 1 or not large.limit(1).count():
            return out
        open_, width = cells.join(large, group, "left_semi"), max(1, width // 4)


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept) for every row of docs; ``kept`` is binary, the bytes that stay.
    Ids are integers; ``anchor`` is at most ``length``."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                for text, at, n, off, own, frag, *windows in fragments_in_parts(*buffer_of(batch.column("text")), length, anchor):
                    which = pa.array(text)
                    numbers = (at.astype(np.int32), n.astype(np.int32), off.astype(np.int32), own.view(np.int64), frag.view(np.int64), *windows)
                    columns = [batch.column("id").take(which), batch.column("t").take(which), *(pa.array(x) for x in numbers)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "t", "at", "n", "off", "anchor", "frag", *WINDOW_NAMES])

    every = materialise(rows.mapInArrow(cut, FRAGMENT), "fragments")
    # Small tables are written before they are joined, so that Spark sees plain sides and can split a hot key.
    busy = materialise(every.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "repeated")
    found = materialise(every.join(busy, "anchor"), "busy")
    one = F.min(F.struct("id", "t", "at", "n", "off", *WINDOW_NAMES)).alias("one")
    distinct = materialise(found.groupBy("anchor", "frag").agg(F.count("*").alias("copies"), one).select("anchor", "frag", "copies", "one.*"), "distinct")
    several = materialise(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor"), "several")
    windows = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(w).alias("w")) for j, w in enumerate(WINDOW_NAMES))))
    spread = distinct.join(several, "anchor").select("anchor", "frag", windows.alias("x")).select("anchor", "frag", "x.j", "x.w").filter("w <> 0")
    alike = materialise(spread.groupBy("anchor", "j", "w").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "alike")
    kept = spread.join(alike, ["anchor", "j", "w"]).select("anchor", "frag").distinct()
    parts = materialise(distinct.join(kept, ["anchor", "frag"]).select("anchor", "frag", "id", "t", "at", "n", "off"), "parts")
    cell = F.struct("anchor", "frag", "at", "n", "off")
    wanted = parts.groupBy("id", "t").agg(F.collect_list(cell).alias("parts"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each fragment."""
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                data, offsets = buffer_of(batch.column("text"))
                lists = batch.column("parts")
                anchors, frags, at, n, off = (lists.flatten().field(i) for i in range(5))
                start = offsets[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())] + at.to_numpy()
                end = start + n.to_numpy() - 1 + length
                cut = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchors, frags, off, pa.array(cut, pa.binary())], names=["anchor", "frag", "off", "part"])

    # A row given twice is cut out twice; its fragments have two copies and are covered as a whole anyway.
    pieces = materialise(wanted.join(rows, ["id", "t"]).select("text", "parts").mapInArrow(cut_out, CUT), "pieces")
    per_anchor = materialise(parts.groupBy("anchor").agg(F.sum(F.col("n") + F.lit(length - 1)).alias("bytes")), "anchors")
    cover = _expanded(pieces, per_anchor.filter(F.col("bytes") <= anchor_bytes), ["anchor"], ["anchor", "frag"], length, shard_bytes)
    hot = per_anchor.filter(F.col("bytes") > anchor_bytes).select("anchor")
    if hot.limit(1).count():
        cover = cover.unionAll(_hot_anchors(pieces.join(hot, "anchor", "left_semi"), length, anchor_bytes, shard_bytes))
    whole = distinct.filter("copies > 1").select("anchor", "frag", F.lit(0).alias("a"), F.col("n").alias("b"))
    cover = materialise(cover.unionAll(whole).groupBy("anchor", "frag").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "cover")
    spans = found.join(cover, ["anchor", "frag"]).select("id", "t", "at", F.explode("runs").alias("run"))
    spans = spans.select("id", "t", (F.col("at") + F.col("run.a")).alias("a"), (F.col("at") + F.col("run.b") + (length - 1)).alias("b"))
    spans = spans.groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            removed, runs, kept = [], [], []
            for i, s in enumerate(batch.column("spans")):
                own = data[offsets[i] : offsets[i + 1]]
                first = end = np.zeros(0, np.int64)
                if s.is_valid:
                    first, end = joined(*(s.values.field(j).to_numpy() for j in (0, 1)))
                stay = np.ones(len(own), bool)
                for a, b in zip(first.tolist(), end.tolist(), strict=True):
                    stay[a:b] = False
                kept.append(own[stay].tobytes())
                removed.append(len(own) - len(kept[-1]))
                runs.append(len(first))
            columns = [batch.column("id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.join(spans, ["id", "t"], "left").select("id", "text", "spans").mapInArrow(remove, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
