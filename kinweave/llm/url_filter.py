"""URL filters: ordered host and path rules, and a Bloom filter cascade for long lists of blocked domains.

The cascade answers "is this key listed?" without a join and without error for every key of a known universe (all keys
of the corpus): level 0 is a Bloom filter of the listed keys; level 1 one of the unlisted keys that level 0 lets
through; level 2 one of the listed keys that level 1 lets through, and so on. A key's answer is the parity of the first
level that rejects it. Every level hashes the keys' bytes anew, with a seed of its own, until no key is left to tell
apart; should levels stop helping, the rest is a list of keys, so building always ends.

A row's keys (the suffixes of its host, as far as a listed domain can be one, and its location: host and path) are
listed where one of them is. Rows and keys are dealt to shards by location, and a task builds the cascade of each shard: nothing about keys reaches the driver.
Where all cascades together are within ``max_bytes`` they are broadcast and rows are probed where they lie; beyond that
rows travel to the cascade of their shard, in replicas of it as many as its rows need.

Null urls have an empty host and path. Rows that repeat are judged each; other columns of pages are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

#: All cascades together, where they are broadcast; about 40 million listed keys.
MAX_BYTES = 64 << 20
#: Hosts of a shard, and rows of one replica of it, on average.
SHARD_HOSTS, SHARD_ROWS = 200_000, 200_000
#: Levels at most.
MOST_LEVELS = 48
HASHES = 4
#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _after_scheme(url: F.Column) -> F.Column:
    """What follows the first ``://``; null without one. A pattern could backtrack to a later one (as in ``?u=http://``)."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: F.Column) -> F.Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """From the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules: Sequence[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Of equally long ones the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, prefix in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(own + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def bits_for(n: int, rate: float) -> int:
    """Bits of a Bloom filter with HASHES hashes for n keys at that rate of false positives, a multiple of 64."""
    return 64 * max(1, math.ceil(-HASHES * n / math.log(1 - rate ** (1 / HASHES)) / 64))


def _positions(keys: list[bytes], bits: int, level: int) -> np.ndarray:
    """HASHES bit positions for each key, by double hashing of two 64-bit hashes that belong to the level alone."""
    digest = xxhash.xxh3_128_digest
    two = np.frombuffer(b"".join([digest(k, level + 1) for k in keys]), "<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        at = two[:, :1] + (two[:, 1:] | np.uint64(1)) * np.arange(HASHES, dtype=np.uint64)
    return (at % np.uint64(bits)).astype(np.int64)


def _passes(words: np.ndarray, keys: list[bytes], level: int) -> np.ndarray:
    at = _positions(keys, 64 * len(words), level)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


class Cascade:
    """Bit arrays by level, and the keys (of the side that the next level would encode) that are left as a list."""

    def __init__(self, levels: list[np.ndarray], rest: set[bytes]):
        self.levels, self.rest = levels, rest

    @classmethod
    def build(cls, listed: list[bytes], others: list[bytes]) -> Cascade:
        levels: list[np.ndarray] = []
        own, other = listed, others
        while own and len(levels) < MOST_LEVELS:
            # The first level lets few through when the other side is far larger; later ones halve what is left.
            rate = max(1e-6, min(0.5, len(own) / max(1, len(other)) / 2)) if not levels else 0.5
            words = np.zeros(bits_for(len(own), rate) // 64, np.uint64)
            at = _positions(own, 64 * len(words), len(levels)).reshape(-1)
            np.bitwise_or.at(words, at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)))
            through = _passes(words, other, len(levels)) if other else np.zeros(0, bool)
            levels.append(words)
            own, other = [k for k, on in zip(other, through.tolist(), strict=True) if on], own
        return cls(levels, {*own})

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """Which keys are listed. Exact for keys of the universe that the cascade was built over."""
        listed, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
        for level, words in enumerate(self.levels):
            through = _passes(words, [keys[i] for i in open_.tolist()], level) if len(open_) else np.zeros(0, bool)
            listed[open_[~through]] = level % 2 == 1
            open_ = open_[through]
        side = len(self.levels) % 2 == 0
        for i in open_.tolist():
            listed[i] = (keys[i] in self.rest) == side
        return listed


CASCADE = "shard int, bytes long, levels array<binary>, rest array<binary>"


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    names = [k.encode("utf-8", "surrogatepass") for k in table.column("key").to_pylist()]
    flags = table.column("listed").to_pylist()
    built = Cascade.build([k for k, on in zip(names, flags, strict=True) if on], [k for k, on in zip(names, flags, strict=True) if not on])
    size = sum(x.nbytes for x in built.levels) + sum(map(len, built.rest))
    columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([size], pa.int64()), pa.array([[x.tobytes() for x in built.levels]], pa.list_(pa.binary())), pa.array([sorted(built.rest)], pa.list_(pa.binary()))]
    return pa.table(columns, names=["shard", "bytes", "levels", "rest"])


def _read(levels: list[bytes], rest: list[bytes]) -> Cascade:
    return Cascade([np.frombuffer(x, np.uint64) for x in levels], {*rest})


def _any_listed(cascade: Cascade, keys: pa.Array) -> np.ndarray:
    """For each list of keys whether one of them is listed; each distinct key is looked up once."""
    flat = keys.flatten().dictionary_encode()
    known = cascade.lookup([k.encode("utf-8", "surrogatepass") for k in flat.dictionary.to_pylist()])
    owner = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(keys), 0).to_numpy())
    out = np.zeros(len(keys), bool)
    if len(owner):
        out[owner[known[flat.indices.to_numpy()]]] = True
    return out


def listed_by_cascade(rows: DataFrame, keys: F.Column, home: F.Column, listed: DataFrame, max_bytes: int = MAX_BYTES, shard_hosts: int = SHARD_HOSTS) -> DataFrame:
    """rows with a boolean column ``listed``: whether one of the row's keys (an array of strings) is in ``listed`` (key).
    ``home`` is a string that decides a row's keys (a host) and by which rows are dealt. A row whose home is null is
    unlisted. The other columns of rows pass through; one named ``listed`` is replaced."""
    rows = rows.drop("listed")
    kind = T.StructType([*rows.schema.fields, T.StructField("listed", T.BooleanType())])
    homes = materialise(rows.select(home.alias("home"), keys.alias("keys")).filter("home IS NOT NULL").distinct(), "url-homes")
    shards = max(1, math.ceil(homes.count() / shard_hosts))
    shard_of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    universe = homes.select(shard_of("home").alias("shard"), F.explode("keys").alias("key")).distinct()
    own = listed.select("key", F.lit(True).alias("listed")).filter("key IS NOT NULL").distinct()
    marked = universe.join(own, "key", "left").select("shard", "key", F.coalesce("listed", F.lit(False)).alias("listed"))
    cascades = materialise(marked.groupBy("shard").applyInArrow(_build_shard, CASCADE), "cascades")
    asked = rows.withColumns({"__keys": F.when(home.isNotNull(), keys), "__shard": shard_of(home)})
    names = rows.columns

    def judged(batch: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(found)], names=[*names, "listed"])

    if (cascades.agg(F.sum("bytes")).first()[0] or 0) <= max_bytes:
        sent = rows.sparkSession.sparkContext.broadcast({r["shard"]: (r["levels"], r["rest"]) for r in cascades.collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read: dict[int, Cascade] = {}
            for b in batches:
                shard, asked_keys = b.column("__shard").fill_null(-1).to_numpy(), b.column("__keys")
                found = np.zeros(b.num_rows, bool)
                for s in np.unique(shard).tolist():
                    if s in sent.value:
                        read[s] = read.get(s) or _read(*sent.value[s])
                        at = np.flatnonzero(shard == s)
                        found[at] = _any_listed(read[s], asked_keys.take(pa.array(at)))
                yield judged(b, found)

        return asked.mapInArrow(probe, kind)

    loads = asked.groupBy("__shard").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("__replicas"))
    loads = materialise(loads.filter("__shard IS NOT NULL"), "url-loads")
    each = cascades.join(loads, cascades["shard"] == loads["__shard"]).withColumn("__replica", F.explode(F.sequence(F.lit(0), F.col("__replicas") - 1)))
    dealt = asked.join(loads, "__shard").withColumn("__replica", F.pmod(F.monotonically_increasing_id(), F.col("__replicas")).cast("int")).drop("__replicas")

    def probe_shard(mine: pa.Table, cascade: pa.Table) -> pa.Table:
        mine = mine.combine_chunks()
        found = np.zeros(mine.num_rows, bool)
        if mine.num_rows:
            found = _any_listed(_read(cascade.column("levels")[0].as_py(), cascade.column("rest")[0].as_py()), mine.column("__keys").combine_chunks())
        return pa.table([*(mine.column(n) for n in names), pa.array(found)], names=[*names, "listed"])

    met = dealt.groupBy("__shard", "__replica").cogroup(each.select("__shard", "__replica", "levels", "rest").groupBy("__shard", "__replica")).applyInArrow(probe_shard, kind)
    return met.unionAll(rows.filter(home.isNull()).withColumn("listed", F.lit(False)))


def suffixes(host: F.Column, depth: int) -> F.Column:
    """The last 1 to ``depth`` labels of a host: the domains of up to so many labels that it belongs to."""
    return F.array_distinct(F.array(*(F.substring_index(host, ".", -k) for k in range(1, depth + 1))))


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bytes: int = MAX_BYTES,
    shard_hosts: int = SHARD_HOSTS,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, listed) for every row of pages: the longest rule's verdict, else block for a
    host under a listed domain or a listed location and allow for any other. ``listed`` (key) holds blocked domains and
    locations (a host and a path from its first ``/`` on); A-Z of their hosts are lower-cased. Null keys list nothing."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    named = F.regexp_extract("key", "^[^/]*", 0)
    lower = F.translate(named, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = listed.select(F.concat(lower, F.substring("key", F.length(named) + 1, F.length("key"))).alias("key"))
    depth = listed.agg(F.max(F.size(F.split(F.regexp_extract("key", "^[^/]*", 0), r"\.")))).first()[0] or 1  # no longer suffix of a host can be listed
    location = F.concat("host", "path")
    keys = F.array_distinct(F.concat(suffixes(F.col("host"), depth), F.array(location)))
    found = listed_by_cascade(rows, keys, location, listed, max_bytes, shard_hosts)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")
