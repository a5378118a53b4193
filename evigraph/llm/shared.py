"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Bytes 0x09-0x0D and 0x20 end a word; every other character belongs to one.
BLANK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. Where none is configured, one of this machine serves a local master; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = found.get() if found.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="evigraph-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    Shuffle files of earlier steps that nothing refers to any more go when the driver collects garbage, so it is asked to first.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evigraph/{label}-{uuid.uuid4().hex}"
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._evigraph_path = path
    return written


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` wrote, once all that is made of it is written too."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._evigraph_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few_rows(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spare_names(df: DataFrame, count: int) -> list[str]:
    """Names that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return list(islice((n for n in (f"evigraph_{i}" for i in itertools.count()) if n not in taken), count))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def native_words(text: Column) -> Column:
    """Words of a text as an array, by SQL functions only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
