"""Tables that several jobs of one operator read: written once to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a session on one machine may lack it: there a new local folder
    becomes it; on a cluster, where executors and driver share no local folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: the lineage is cut and a lost executor loses
    nothing. The folders are named after the application, so a cluster's owner can clear them when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kinweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_text(col) -> F.Column:
    """CRC-32 of an id as text; the folds of the labelled rows are taken from it."""
    return F.crc32(col.cast("string").cast("binary"))
