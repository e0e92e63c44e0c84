"""The trie of conversation prefixes: how many conversations share each beginning, and what sharing it saves.

Turns become numbers of a dictionary of distinct (role, text), so texts are shuffled only as digests. Equal sequences
are merged first, before any shard sees them. Distinct sequences are range-partitioned in their order and each shard
builds a ternary search tree of its turn numbers, inserting the median of every interval first so that siblings are
balanced; nodes are numbered as they are made, parents before children, and one backward pass over the numbers
accumulates members, leaves and savings without recursion. As shards follow each other in order, a node lies in several
shards only if it is a prefix shared by the last sequence of one and the first of the next: two lengths a shard tell
which nodes these are and which shard saw them first, so every shard counts only what no shard before it counted, and
the partial rows of boundary nodes add up.

Order of a conversation's turns: by turn, null first; turns of equal number by role, then text. Null roles and texts are
empty. Rows without conv_id belong to no conversation and are left out. Repeated rows are turns of their own. A table
without conversations has no nodes, not even the root. Extra columns play no part. A conversation's turn numbers (8 bytes
a turn, no text) are one row; a shard holds about ``SHARD_TURNS`` turns of distinct sequences."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, shuffle_partitions

#: Turns of distinct sequences in one shard, on average.
SHARD_TURNS = 400_000
#: A turn more frequent than both, in rows and as a share of all, is looked up by broadcast: fewer than 20,000 can be.
HOT_ROWS, HOT_SHARE = 1_000, 20_000
#: Ids of members that are joined to one text before they are hashed.
BLOCK_IDS = 4_096
EMPTY = hashlib.sha256(b"").hexdigest()


def _encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, id, size): turns as dictionary numbers; ``tie`` orders turns of one number."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    slim = materialise(rows.select("conv_id", "turn", "digest", "size"), "turn-digests")
    counted = slim.groupBy("digest").agg(F.count("*").alias("n"))
    dictionary = materialise(counted.withColumn("id", F.monotonically_increasing_id()), "turn-dictionary")
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    hot = dictionary.filter(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select("digest", F.col("id").alias("hot_id"))
    found = slim.join(F.broadcast(hot), "digest", "left")
    rest = found.filter("hot_id IS NULL").drop("hot_id").join(dictionary.select("digest", "id"), "digest")
    coded = found.filter("hot_id IS NOT NULL").withColumnRenamed("hot_id", "id").select(rest.columns).unionAll(rest)
    several = slim.groupBy("conv_id", "turn").agg(F.countDistinct("digest").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    several = materialise(several, "tied-turns")
    if not several.limit(1).count():
        return coded.withColumn("tie", F.lit(0))
    same = (rows["conv_id"] == several["c"]) & rows["turn"].eqNullSafe(several["t"])
    tied = rows.join(several, same, "left_semi").select("conv_id", "turn", "digest", "role", "text").distinct()
    order = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    tied = tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d"), order.alias("tie"))
    same = (coded["conv_id"] == tied["c"]) & coded["turn"].eqNullSafe(tied["t"]) & (coded["digest"] == tied["d"])
    return coded.join(tied, same, "left").select(*coded.columns, F.coalesce("tie", F.lit(0)).alias("tie"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, as an array of (id, size)."""
    own = F.sort_array(F.collect_list(F.struct("turn", "tie", "id", "size")))
    return _encoded(turns).groupBy("conv_id").agg(F.transform(own, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(convs: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Every conversation with its first ``head`` turns (at most ``most``) replaced by as many of conversation
    ``base``'s; a base that doesn't exist gives none."""
    heads = convs.select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, most).alias("first"))
    placed = convs.withColumn("base_id", base).withColumn("head", head).join(heads, "base_id", "left")
    none = F.slice("turns", 1, 0)
    own = F.when(F.size("turns") > F.col("head"), F.slice("turns", F.col("head") + 1, F.size("turns"))).otherwise(none)
    first = F.when(F.col("head") > 0, F.slice(F.coalesce("first", none), 1, F.col("head"))).otherwise(none)
    return placed.select("conv_id", F.concat(first, own).alias("turns"))


ROW = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _batch(rows: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, conv_id, ids, sizes) rows, as one row for every few thousand members of a sequence."""
    names = ["digest", "first", "n", "listed", "ids", "sizes"]
    last, own, held = None, [], ()
    block = lambda: (last, own[0], len(own), ",".join(map(str, own)), *held)
    for batch in batches:
        done = []
        for digest, conv, *sequence in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if own and (digest != last or len(own) >= BLOCK_IDS):
                done.append(block())
                own = []
            if not own:
                last, held = digest, sequence
            own.append(conv)
        if done:
            yield _batch(done, names, ROW)
    if own:
        yield _batch([block()], names, ROW)


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each sequence in order, as one row with the digest of all its members' ids: a running hash, so a
    sequence with any number of members needs the memory of one block."""
    names, types = ["ids", "sizes", "n", "conv_id", "ends"], [*ROW[4:], pa.int64(), pa.int64(), pa.string()]
    last, found, running = None, None, None
    for batch in batches:
        done = []
        for digest, first, n, listed, ids, sizes in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if digest != last:
                if found:
                    done.append((*found, running.hexdigest()))
                last, found, running = digest, [ids, sizes, 0, first], hashlib.sha256()
            else:
                running.update(b",")
            found[2] += n
            running.update(listed.encode())
        if done:
            yield _batch(done, names, types)
    if found:
        yield _batch([(*found, running.hexdigest())], names, types)


def sequences(convs: DataFrame) -> DataFrame:
    """(ids, sizes, n, conv_id, ends): each distinct sequence once, with the number of its conversations, the smallest
    of their ids and the digest of them all. Ranges of (sequence, id) split a sequence that most conversations have."""
    ids, sizes = F.transform("turns", lambda t: t["id"]), F.transform("turns", lambda t: t["size"])
    digest = F.unhex(F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256))
    rows = materialise(convs.select(digest.alias("digest"), "conv_id", ids.alias("ids"), sizes.alias("sizes")), "rebuilt")
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    kind = "digest binary, first long, n long, listed string, ids array<long>, sizes array<long>"
    blocks = ranged.mapInArrow(_list_blocks, kind)
    own = blocks.repartition("digest").sortWithinPartitions("digest", "first")
    return own.mapInArrow(_join_blocks, "ids array<long>, sizes array<long>, n long, conv_id long, ends string")


class TernaryTree:
    """A ternary search tree of integer sequences in flat arrays. Node 0 is the root of the trie; ``low`` and ``high``
    lead to siblings, ``down`` to the first child found; ``parent`` is the trie's parent."""

    def __init__(self):
        self.key, self.low, self.high, self.down = (array("q", [0]) for _ in range(4))
        self.parent, self.depth, self.size = (array("q", [0]) for _ in range(3))
        self.members, self.least = array("q", [0]), array("q", [2**63 - 1])

    def _new(self, key: int, size: int, parent: int, least: int) -> int:
        at = len(self.key)
        for column, value in ((self.key, key), (self.low, 0), (self.high, 0), (self.down, 0), (self.parent, parent), (self.size, size), (self.members, 0), (self.least, least)):
            column.append(value)
        self.depth.append(self.depth[parent] + 1)
        return at

    def insert(self, ids: list[int], sizes: list[int], n: int, conv: int) -> int:
        """Adds n members of one sequence, the smallest of them ``conv``; the sequence's last node."""
        key, low, high, down, members, least = self.key, self.low, self.high, self.down, self.members, self.least
        node = 0
        members[0] += n
        least[0] = min(least[0], conv)
        for i, own in enumerate(ids):
            at, links, behind = down[node], down, node
            while at and key[at] != own:
                links, behind = (low, at) if own < key[at] else (high, at)
                at = links[at]
            if not at:
                at = self._new(own, sizes[i], node, conv)
                links[behind] = at
            members[at] += n
            if conv < least[at]:
                least[at] = conv
            node = at
        return node


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every interval before its two halves."""
    waiting = [(0, n)]
    for a, b in waiting:
        if a < b:
            mid = (a + b) // 2
            yield mid
            waiting += [(a, mid), (mid + 1, b)]


def common_prefix(a: list[int], b: list[int]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905


NODES = "shard int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, key binary, parent_key binary"
KINDS = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary()]


def _shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard. A boundary node has a ``key``, and counts of what no earlier shard counted; a node below
    one has its parent's key in place of the parent's id."""
    shard, before, after = (table.column(c)[0].as_py() for c in ("shard", "before", "after"))
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "n", "conv_id", "ends")), strict=True), key=lambda r: r[0])
    tree, ends = TernaryTree(), {}
    last_of = [0, 0]
    for i in medians(len(rows)):
        ids, sizes, n, conv, listed = rows[i]
        node = tree.insert(ids, sizes, n, conv)
        ends[node] = listed
        if i == 0:
            last_of[0] = node
        if i == len(rows) - 1:
            last_of[1] = node
    count = len(tree.key)
    keys: list[bytes | None] = [None] * count
    seen = bytearray(count)  # nodes that an earlier shard has too
    paths = []
    for end in last_of:
        path = [end]
        while path[-1]:
            path.append(tree.parent[path[-1]])
        paths.append(path[::-1])
    for path, shared, earlier in ((paths[0], before, True), (paths[1], after, False)):
        key = b""
        for node in path[: shared + 1] if shared >= 0 else ():
            key = hashlib.sha256(key + tree.key[node].to_bytes(8, "little")).digest() if node else b"root"
            keys[node] = key
            if earlier:
                seen[node] = 1
    continued = after == len(paths[1]) - 1  # the next shard's first sequence goes on below this one's last
    children, leaves, saved = (array("q", bytes(8 * count)) for _ in range(3))
    for node in range(count - 1, -1, -1):  # children have larger numbers than their parents
        new = not seen[node]
        saved[node] += (tree.members[node] - new) * tree.size[node]
        if not tree.down[node] and not (continued and node == last_of[1]):
            leaves[node] += 1
        if node:
            up = tree.parent[node]
            children[up] += new
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    up = [None, *(tree.parent[i] for i in range(1, count))]
    columns = [
        [shard] * count,
        tree.depth,
        tree.least,
        [None if u is None or keys[u] is not None else tree.least[u] for u in up],
        tree.members,
        children,
        leaves,
        saved,
        [ends.get(i) for i in range(count)],
        keys,
        [None if u is None else keys[u] for u in up],
    ]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS, strict=True)], names=[c.split()[0] for c in NODES.split(", ")])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node of the
    trie of ``convs`` (conv_id, turns as an array of (id, size)); see :func:`conversations`. ``saved_tokens`` counts
    UTF-8 bytes."""
    spark = convs.sparkSession
    distinct = materialise(sequences(convs), "sequences")
    turns = distinct.agg(F.sum(F.size("ids"))).first()[0] or 0
    shards = max(1, -(-turns // SHARD_TURNS), min(shuffle_partitions(spark), -(-turns // 20_000)))
    ranged = materialise(distinct.repartitionByRange(shards, "ids").withColumn("shard", F.spark_partition_id()), "shards")
    # One row a shard: its first and last sequence against its neighbours'. Shards that got no row aren't there.
    order = W.orderBy("shard")
    edges = ranged.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    prefix = F.udf(lambda a, b: -1 if a is None or b is None else common_prefix(a, b), "int")
    edges = edges.withColumn("previous", F.lag("last").over(order)).withColumn("next", F.lead("first").over(order))
    edges = materialise(edges.select("shard", prefix("previous", "first").alias("before"), prefix("last", "next").alias("after")), "shard-edges")
    nodes = ranged.join(F.broadcast(edges), "shard").groupBy("shard").applyInArrow(_shard_nodes, NODES)
    nodes = materialise(nodes, "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    edge = nodes.filter("key IS NOT NULL")
    merged = edge.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends").alias("ends"), F.first("parent_key").alias("parent_key"))
    merged = materialise(merged, "boundary-nodes")
    # A shard's own copy of its boundary nodes, so that the root's many children don't meet at one key.
    known = merged.select(F.col("key").alias("up"), F.col("conv_id").alias("up_id"))
    places = edge.select("shard", F.col("key").alias("up")).join(known, "up")
    inner = nodes.filter("key IS NULL").drop("key")
    below = inner.filter("parent_key IS NOT NULL").withColumnRenamed("parent_key", "up").join(places, ["shard", "up"])
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    found = inner.filter("parent_key IS NULL").select(out)
    found = found.unionAll(below.withColumn("parent_conv_id", F.col("up_id")).select(out))
    top = merged.join(known, merged["parent_key"] == known["up"], "left").withColumn("parent_conv_id", F.col("up_id"))
    found = found.unionAll(top.select(out))
    return found.select(*out[:6], F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
