"""Tables written between steps to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.model import ReconcileError


#: Of staged tables: ids and notes shrink to half of what the default codec leaves.
CODEC = "zstd"
#: Bytes that a broadcast of a staged table takes for each byte of its files: a row of an id, 1 to 3 bytes there, takes 80 to 170.
EXPANSION = 100


def shared_folder(spark: SparkSession) -> str:
    """Where no shared folder is configured, a session on one machine takes a temporary one; on a cluster that is an error, since
    executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ReconcileError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write and read back: cuts lineage and survives lost executors. ``by`` a column of few values, filters on it read only the
    folders of theirs."""
    path = staged_path(df, name, by)
    return opened(df.sparkSession, path, df.schema)


def staged_path(df: DataFrame, name: str, by: str | None = None) -> str:
    """Where ``stage`` has written a table."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("compression", CODEC).parquet(path)
    return path


def opened(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A staged table; a missing one is an AnalysisException at once."""
    sized(spark)
    return spark.read.schema(schema).parquet(path).select(schema.names)


def sized(spark: SparkSession) -> None:
    """Have the session judge tables by what they take in memory. By the bytes of their files, a table of a million ids passes for
    small, and each join that broadcasts it holds some 100 MB of the driver; one that really is small is still broadcast."""
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) < EXPANSION:
        spark.conf.set(factor, str(float(EXPANSION)))


def listing(spark: SparkSession, paths: list[str]) -> tuple:
    """Number, bytes, latest change and a hash of names, sizes and times of the files below ``paths``: one row, from the folders'
    listings alone. It is another one when a file is added, taken away, or written anew."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    one = F.xxhash64("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.bit_xor(one)).first())


def bucketed(df: DataFrame, key: str, name: str, then: Callable[[DataFrame], DataFrame] | None = None, dealt: bool = False) -> DataFrame:
    """``stage`` with the rows hashed by ``key`` into as many buckets as the session shuffles to, each sorted: joins on the key
    don't shuffle this side, and a filter on a few keys reads their buckets only.

    ``then`` works on the rows once they are dealt, so what it joins or groups by the key needs no shuffle of its own. ``dealt``:
    the rows come grouped by the key and are written as they lie."""
    spark = df.sparkSession
    sized(spark)
    unique = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(n, key)
    rows = then(rows) if then else rows
    rows.write.bucketBy(n, key).sortBy(key).option("compression", CODEC).option("path", f"{shared_folder(spark)}/{unique}").saveAsTable(unique)
    return spark.table(unique)
