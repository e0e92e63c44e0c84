"""Words that differ by one letter, and the frequent spelling behind a rare one.

The distinct words are numbered in their order, and so are the nodes of their trie (prefixes) and of the trie of the
reversed words (suffixes), shard by shard of a range partitioning. A word is then integer pairs of a prefix node and a
suffix node: ``(word[:i], word[i+1:])`` skips a position, ``(word[:i], word[i:])`` is an inserted one. Two words that
share a skipping pair differ by a replacement there; a skipping pair that meets an inserting one is a deletion. Nodes
stand for whole strings, so the neighbours are exact and no string is compared. A pair determines all letters but one:
at most as many words meet at it as the alphabet has letters, whatever the corpus is, and none of them are written out
as pairs; each learns its number of neighbours there and the best of them. A skip within a run of equal letters is met
by the run's first only, so no neighbour is counted twice.

A node number is the shard's number and a count within. The prefixes of a shard's last word have numbers that follow
from their length, so the next shards can name the nodes they share with it, knowing only three lengths a shard.

Null texts have no words; a null id counts as an empty one. Empty tables give no words. Repeated rows count each.
Extra columns play no part. Long texts are read in parts; a word of any length takes memory in proportion to it."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, shuffle_partitions

#: A-Z lower-cased, other letters up to U+00FF as they are, the rest white space; over Latin-1, where a byte is a code point.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Code points of a text that are read at a time; words that a task counts before it hands them on.
PART_CHARS, COUNTED = 1 << 20, 400_000
#: Words of a shard; bits of a node's number within its shard.
SHARD_WORDS, NODE_BITS = 200_000, 40


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PART_CHARS:
        cut = data.find(b" ", at + PART_CHARS)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def count_words(docs: DataFrame, drop_every: int, shortest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters, of at least ``shortest`` code points. Where the CRC-32 of ``id:run`` is
    a multiple of ``drop_every``, the run has lost the code point at that CRC modulo its length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        crc32 = zlib.crc32
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = crc32(f"{'' if key is None else key}:".encode())
                for part in _parts(text.encode("latin-1", "replace").translate(LETTERS)):
                    for run, n in Counter([w for w in part.split() if len(w) >= shortest]).items():
                        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                        if h % drop_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < shortest:
                                continue
                        found[run] += n
                    if len(found) > COUNTED:
                        yield out()
                        found.clear()
        if found:
            yield out()

    counted = docs.select(id_col, text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def inherited(edges: list[tuple[int, int, int, int]]) -> dict[int, list[tuple[int, int]]]:
    """{shard: [(depth, owner), ...]}: which earlier shard numbered the nodes down to each depth that a shard shares
    with those before it. ``edges``: (shard, length shared with the shard before, length that all its words share,
    length of its last word) in order."""
    found: dict[int, list[tuple[int, int]]] = {}
    path: list[tuple[int, int]] = []  # of the last word of the shard before
    for shard, before, own, last in edges:
        cut = lambda depth: [(min(d, depth), o) for i, (d, o) in enumerate(path) if (path[i - 1][0] if i else 0) < depth]  # noqa: B023, E731
        found[shard] = cut(before)
        path = cut(min(before, own))
        if last > (path[-1][0] if path else 0):
            path.append((last, shard))
    return found


def number_nodes(keys: DataFrame, shards: int) -> DataFrame:
    """(wid, nodes, fresh) for every row (wid, key) of distinct keys: the number of each prefix's node, the empty one's
    (0) first, and whether each letter differs from the one before it."""
    ranged = materialise(keys.repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id()), "trie-shards")
    order = W.orderBy("shard")
    edges = ranged.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last")).withColumn("previous", F.lag("last").over(order))
    shared = F.udf(lambda a, b: 0 if a is None else common_prefix(a, b), "int")
    edges = edges.select("shard", shared("previous", "first").alias("before"), shared("first", "last").alias("own"), F.length("last").alias("size"))
    owners = inherited(sorted(tuple(r) for r in edges.collect()))  # four numbers a shard

    def number(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = sorted(zip(table.column("key").to_pylist(), table.column("wid").to_pylist(), strict=True))
        mark = shard << NODE_BITS
        last = rows[-1][0]
        fresh_number = mark + len(last)
        path, depth = [0], 0
        for upto, owner in owners[shard]:
            for depth in range(depth + 1, upto + 1):
                path.append((owner << NODE_BITS) + depth)
        before, nodes, fresh, sizes = rows[0][0][: len(path) - 1], [], [], []
        for key, _ in rows:
            kept = common_prefix(before, key)
            del path[kept + 1 :]
            reserved = common_prefix(key, last)
            for depth in range(kept + 1, len(key) + 1):
                if depth <= reserved:
                    path.append(mark + depth)
                else:
                    fresh_number += 1
                    path.append(fresh_number)
            nodes += path
            fresh += [True, *map(str.__ne__, key[1:], key)]
            sizes.append(len(key))
            before = key
        sizes = np.array(sizes, np.int64)
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        columns = [pa.array([w for _, w in rows], pa.int64()), pa.ListArray.from_arrays(offsets(sizes + 1), pa.array(nodes, pa.int64())), pa.ListArray.from_arrays(offsets(sizes), pa.array(fresh, pa.bool_()))]
        return pa.Table.from_arrays(columns, names=["wid", "nodes", "fresh"])

    return ranged.groupBy("shard").applyInArrow(number, "wid long, nodes array<long>, fresh array<boolean>")


#: Kinds of pairs: a skip within a run of equal letters, any other skip, an insertion.
REPEATED, SKIP, INSERT = 0, 1, 2


def pairs(words: DataFrame, shards: int) -> DataFrame:
    """(p, s, kind, wid, n): the integer pairs of every word (wid, word, n)."""
    forward = number_nodes(words.select("wid", F.col("word").alias("key")), shards)
    backward = number_nodes(words.select("wid", F.reverse("word").alias("key")), shards)
    both = words.select("wid", "n", F.length("word").alias("size")).join(forward, "wid").join(backward.select("wid", F.col("nodes").alias("back")), "wid")
    skips = F.transform(
        F.sequence(F.lit(0), F.col("size") - 1),
        lambda i: F.struct(F.get("nodes", i).alias("p"), F.get("back", F.col("size") - 1 - i).alias("s"), F.get("fresh", i).cast("int").alias("kind")),
    )
    inserts = F.transform(
        F.sequence(F.lit(0), F.col("size")), lambda i: F.struct(F.get("nodes", i).alias("p"), F.get("back", F.col("size") - i).alias("s"), F.lit(INSERT).alias("kind"))
    )
    return both.select("wid", "n", F.inline(F.concat(skips, inserts)))


def _meet(p: np.ndarray, s: np.ndarray, kind: np.ndarray, wid: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """[word, neighbours, n and word of the best of them] of words that meet at a pair; rows are sorted by pair."""
    start = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])) if len(p) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(p)))
    own = np.repeat(size > 1, size)
    kind, wid, n, group = kind[own], wid[own], n[own], np.repeat(np.cumsum(size > 1) - 1, size)[own]
    start = np.flatnonzero(np.diff(group, prepend=-1))
    if not len(start):
        return [np.zeros(0, np.int64)] * 4
    none = len(wid)
    by_rank = np.lexsort((wid, -n))  # the most frequent first, of equal ones the first in order
    rank = np.empty(none, np.int64)
    rank[by_rank] = np.arange(none)
    least = lambda of, who: np.minimum.reduceat(np.where(who, of, none), start)[group]
    total = lambda who: np.add.reduceat(who.astype(np.int64), start)[group]
    skip, fresh, inserted = kind != INSERT, kind == SKIP, kind == INSERT
    first = least(rank, skip)
    second = least(rank, skip & (rank != first))
    best = np.where(rank == first, second, first)
    best = np.where(fresh, np.minimum(best, least(rank, inserted)), best)
    best = np.where(inserted, least(rank, fresh), best)
    count = np.where(inserted, total(fresh), total(skip) - 1 + fresh * total(inserted))
    met = count > 0
    best = by_rank[best[met]]
    return [wid[met], count[met], n[best], wid[best]]


def neighbours(pair_rows: DataFrame) -> DataFrame:
    """(wid, n_near, best): the number of a word's neighbours, and the best of them (n, the number of the word negated)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _meet(*rows)], names=["wid", "met", "best_n", "best_wid"])
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last pair may go on in the next batch
            held = [c[cut:] for c in rows]
            if cut:
                yield out([c[:cut] for c in rows])
        if held is not None:
            yield out(held)

    ordered = pair_rows.select("p", "s", "kind", "wid", "n").repartition("p", "s").sortWithinPartitions("p", "s")
    met = ordered.mapInArrow(meet, "wid long, met long, best_n long, best_wid long")
    best = F.max(F.struct("best_n", (-F.col("best_wid")).alias("wid")))
    return met.groupBy("wid").agg(F.sum("met").alias("n_near"), best.alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """(wid, root): the end of every chain of (wid, to) links, by doubling. ``to`` is at least ten times as frequent
    as ``wid``, so chains end, after 19 links at most."""
    found = materialise(links.select("wid", "to"), "forms")
    while True:
        ahead = found.select(F.col("wid").alias("at"), F.col("to").alias("next"))
        found = found.join(ahead, found["to"] == ahead["at"], "left").select("wid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        found = materialise(found, "forms")
        if not found.filter("moved").limit(1).count():
            return found.select("wid", F.col("to").alias("root"))
        found = found.select("wid", "to")


def spelling_forms(docs: DataFrame, drop_every: int = 31, shortest: int = 7, least: int = 2, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word that occurs at least ``least`` times. Two words are near if
    one inserted, deleted or replaced code point makes one the other. ``form`` is the near word of largest n (of equal
    ones the first in code-point order) if that is at least ``ratio`` (2 or more) times the word's own; ``root`` the end
    of the forms."""
    counted = materialise(count_words(docs, drop_every, shortest, id_col, text_col).filter(F.col("n") >= least), "words")
    distinct = counted.count()
    shards = max(1, -(-distinct // SHARD_WORDS), min(shuffle_partitions(docs.sparkSession), -(-distinct // 20_000)))
    # Numbers in the words' own order.
    ordered = counted.repartitionByRange(shards, "word").sortWithinPartitions("word")
    words = materialise(ordered.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "numbered-words")
    near = words.join(neighbours(pairs(words, shards)), "wid", "left").select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    is_form = F.col("best.best_n") >= ratio * F.col("n")
    near = near.withColumn("to", F.when(is_form, -F.col("best.wid"))).withColumn("form_n", F.when(is_form, F.col("best.best_n"))).drop("best")
    near = materialise(near, "near-words")
    plain = near.filter("to IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    linked = near.filter("to IS NOT NULL")
    named = lambda name, key: words.select(F.col("wid").alias(key), F.col("word").alias(name))
    linked = linked.join(follow(linked), "wid").join(named("form", "to"), "to").join(named("root_word", "root"), "root")
    return plain.unionAll(linked.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n"))
