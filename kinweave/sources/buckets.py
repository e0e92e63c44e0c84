"""A site store that grows by file: bitmaps in buckets by coordinate, so a lookup moves the sites that are looked up and
never the store.

The store is a folder of bucketed, sorted Parquet with a row a site. A later file's sites are added to the same buckets
after a look whether the store has one of them already; that look, like any lookup, reads the store where it lies and
shuffles the other side by the buckets' own hash. A session that hasn't written the store registers its folder anew: the
number of buckets is part of the folder's name.

A site has its bitmap, or with ``value`` 'pattern' the key of one that is kept elsewhere."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = ["chrom", "pos"]
BUCKETS = 64
VALUES = {"bits": "ARRAY<BIGINT>", "pattern": "STRING"}


def _table(path: str) -> str:
    return "kinweave_sites_" + hashlib.md5(path.encode()).hexdigest()[:16]


def _folder(path: str, buckets: int, value: str) -> str:
    return f"{path.rstrip('/')}/site_{value}_in_{buckets}_buckets"


def _put(rows: DataFrame, path: str, buckets: int, mode: str, value: str) -> None:
    # A bucket's rows come to one task and leave as one sorted file, with the buckets' hash.
    dealt = rows.select("chrom", "pos", value).repartition(buckets, *SITE)
    writer = dealt.write.mode(mode).format("parquet").option("path", _folder(path, buckets, value)).bucketBy(buckets, *SITE).sortBy(*SITE)
    writer.saveAsTable(_table(path))


def create_sites(bitmaps: DataFrame, path: str, buckets: int = BUCKETS, value: str = "bits") -> None:
    """A new store at ``path`` of (chrom int, pos long, bits); fails if the session has one there. Coordinates must
    differ; ``panel.drop_duplicate_sites`` sees to that within one file."""
    _put(bitmaps, path, buckets, "errorifexists", value)


def open_sites(spark: SparkSession, path: str, buckets: int = BUCKETS, value: str = "bits") -> DataFrame:
    """The store's rows; other sessions' stores are registered first."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_table(path)} (chrom INT, pos BIGINT, {value} {VALUES[value]}) USING parquet "
        f"CLUSTERED BY (chrom, pos) SORTED BY (chrom, pos) INTO {int(buckets)} BUCKETS LOCATION '{_folder(path, buckets, value)}'"
    )
    return spark.table(_table(path))


def append_sites(bitmaps: DataFrame, path: str, buckets: int = BUCKETS, repeated: str = "error", value: str = "bits") -> int:
    """Adds another file's sites; the number of sites that the store had already. If there are any, ``repeated`` says what
    happens: 'error' adds nothing and fails, 'skip' keeps the store's rows and adds the others."""
    spark = bitmaps.sparkSession
    if repeated not in ("error", "skip"):
        raise ValueError(f"repeated is 'error' or 'skip', not {repeated!r}")
    store = open_sites(spark, path, buckets, value).select(*SITE)
    known = bitmaps.select(*SITE).join(store, SITE, "left_semi")
    n = known.count()
    if n and repeated == "error":
        some = ", ".join(f"{r['chrom']}:{r['pos']}" for r in known.limit(3).collect())
        raise ValueError(f"{n} of the sites are in the store already: {some}")
    fresh = bitmaps.join(store, SITE, "left_anti") if n else bitmaps
    _put(fresh, path, buckets, "append", value)
    return n


def look_up(sites: DataFrame, path: str, buckets: int = BUCKETS, value: str = "bits") -> DataFrame:
    """sites (with chrom and pos) with the store's ``bits``: the store is read by bucket, without an exchange."""
    return sites.join(open_sites(sites.sparkSession, path, buckets, value), SITE)
