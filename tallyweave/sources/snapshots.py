"""Snapshots: listing, binding, starting a run; and the pairs that the registered queries reconcile."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.model import ReconcileError, RunContext

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "events": "event_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_candidates(spark: SparkSession, root: str, source: str) -> list[str]:
    """Snapshot folders below ``root`` in any file system that Spark reads, sorted, without the source."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return sorted(n for n in names if n != source.rstrip("/").rpartition("/")[2])


def start_run(source: str, target: str, now: dt.datetime) -> RunContext:
    """Run id and time are minted once, on the driver."""
    return RunContext(source, target, now.strftime("GT-%Y%m%d-%H%M%S"), now.strftime("%Y-%m-%dT%H:%M:%S"))


def bind_target(context: RunContext, candidates: list[str]) -> str:
    """Fail before any write if the target is the source or isn't there."""
    if context.target not in candidates:
        raise ReconcileError(f"no snapshot named {context.target}")
    return context.target


def pieces(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as pieces: guid (table and key) and its columns."""
    key = F.col(KEYS[name])
    return read(spark, sf_dir, name).withColumn("guid", F.concat(F.lit(f"{name}-"), key.cast("string")))


def target_of(source: DataFrame, name: str, drop: int = 3) -> DataFrame:
    """The target half of a pair: the pieces whose key isn't divisible by ``drop``."""
    return source.where(F.col(KEYS[name]) % drop != 0)


def customer_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and two thirds of them with another segment where the key is divisible by five."""
    source = pieces(spark, sf_dir, "customer")
    edited = F.when(F.col("c_custkey") % 5 == 0, F.lit("EDITED")).otherwise(F.col("c_mktsegment"))
    return source, target_of(source, "customer").withColumn("c_mktsegment", edited)


def properties(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Typed facts (guid, field, vtype, s, n, b) of the given columns: strings, whole numbers or booleans."""
    null = {"s": "string", "n": "long", "b": "boolean"}
    slot = {"str": "s", "int": "n", "bool": "b"}
    facts = []
    for c, vtype in fields.items():
        values = [F.col(c).cast(t).alias(k) if slot[vtype] == k else F.lit(None).cast(t).alias(k) for k, t in null.items()]
        facts.append(F.struct(F.lit(c).alias("field"), F.when(F.col(c).isNull(), "null").otherwise(vtype).alias("vtype"), *values))
    return df.select("guid", F.explode(F.array(*facts)).alias("p")).select("guid", "p.*")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objects: the ownership tree region, nation, customer, orders."""
    levels = (("region", None, None), ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("orders", "o_custkey", "customer"))
    parts = []
    for name, owner, above in levels:
        of = F.concat(F.lit(f"{above}-"), F.col(owner).cast("string")) if owner else F.lit(None).cast("string")
        parts.append(pieces(spark, sf_dir, name).select("guid", F.lit(name).alias("category"), of.alias("owner_guid"), F.col(KEYS[name]).cast("long").alias("ord")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
