"""Presence tests and the three-step match: guid, remembered mapping, fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def presence(pieces: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """pieces with ``present``: whether the target has their keys. A null key is never present."""
    there = target.select(*keys).dropDuplicates(keys).withColumn("_there", F.lit(True))
    return pieces.join(there, keys, "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def first_by_fingerprint(target: DataFrame) -> DataFrame:
    """(fp, fp_guid, candidates): of targets (guid, fp, ord) with one fingerprint the first, and how many there were."""
    return target.groupBy("fp").agg(F.min_by("guid", F.struct("ord", "guid")).alias("fp_guid"), F.count("*").alias("candidates"))


def match(source: DataFrame, target: DataFrame, remap: DataFrame) -> DataFrame:
    """source (guid, fp) with target_guid and via: guid, identity_remap, fingerprint or none, in that order.

    target: guid, fp, ord; remap: source_guid, target_guid, which counts only while that target exists."""
    ids = target.select("guid").dropDuplicates()
    by_guid = ids.select("guid", F.col("guid").alias("_g"))
    by_map = remap.join(ids.select(F.col("guid").alias("target_guid")), "target_guid", "left_semi").select(F.col("source_guid").alias("guid"), F.col("target_guid").alias("_m")).dropDuplicates(["guid"])
    by_fp = first_by_fingerprint(target.where("fp IS NOT NULL")).select("fp", F.col("fp_guid").alias("_f"), "candidates")
    joined = source.join(by_guid, "guid", "left").join(by_map, "guid", "left").join(by_fp, "fp", "left")
    via = F.when(F.col("_g").isNotNull(), "guid").when(F.col("_m").isNotNull(), "identity_remap").when(F.col("_f").isNotNull(), "fingerprint").otherwise("none")
    out = joined.withColumn("via", via).withColumn("target_guid", F.coalesce("_g", "_m", "_f"))
    return out.withColumn("ambiguous", (F.col("via") == "fingerprint") & (F.col("candidates") > 1)).drop("_g", "_m", "_f", "candidates")


def new_guid(run_id: str, guid: str = "guid"):
    """A reproducible id of a piece that can't keep its own."""
    return F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("|", F.lit(run_id), F.col(guid)), 256), 1, 32))


def remap_of(created: DataFrame, run_id: str) -> DataFrame:
    """(source_guid, target_guid) of pieces that are created under a new id."""
    return created.select(F.col("guid").alias("source_guid"), new_guid(run_id).alias("target_guid"))


def rewired(refs: DataFrame, remap: DataFrame, target: DataFrame) -> DataFrame:
    """refs (from_guid, field, to_guid, ord) with both ends moved to their target ids; refs to what the target lacks go.

    What an end becomes, if the target has it, is worked out from remap and target alone. So references meet one table at either
    end, and new ids, the widest columns, come in after they were shuffled for the last time."""
    there = target.select(F.col("guid").alias("_t")).distinct()
    moved = remap.select(F.col("source_guid").alias("to_guid"), F.coalesce("target_guid", "source_guid").alias("_t"))
    ends = moved.join(there, "_t", "left_semi").select("to_guid", "_t")
    ends = ends.unionByName(there.select(F.col("_t").alias("to_guid"), "_t").join(moved.select("to_guid"), "to_guid", "left_anti"))
    short = F.when(F.col("_t") != F.col("to_guid"), F.col("_t"))  # null: stays
    kept = refs.join(ends.select("to_guid", short.alias("_t")), "to_guid")
    out = kept.join(remap.select(F.col("source_guid").alias("from_guid"), F.col("target_guid").alias("_f")), "from_guid", "left")
    return out.select(F.coalesce("_f", "from_guid").alias("from_guid"), "field", F.coalesce("_t", "to_guid").alias("to_guid"), "ord")


def unmatched_refs(refs: DataFrame, target: DataFrame) -> DataFrame:
    """refs whose end the target lacks: warnings, or errors where a piece can't do without."""
    return refs.join(target.select(F.col("guid").alias("to_guid")), "to_guid", "left_anti")


def slot_order(refs: DataFrame) -> DataFrame:
    """Slots of all templates in the order of the four kinds, then of the list; position from 1."""
    kind = F.expr("array_position(array('PrefixSlotsRS', 'SuffixSlotsRS', 'ProcliticSlotsRS', 'EncliticSlotsRS'), field)")
    order = Window.partitionBy("from_guid").orderBy(kind, "ord", "to_guid")
    return refs.withColumn("position", F.row_number().over(order))


def lexeme_first(allomorphs: DataFrame) -> DataFrame:
    """owner_field of allomorphs (guid, owner_guid, ord): the first of an entry is its lexeme form, others alternates."""
    first = Window.partitionBy("owner_guid").orderBy("ord", "guid")
    return allomorphs.withColumn("owner_field", F.when(F.row_number().over(first) == 1, "LexemeFormOA").otherwise("AlternateFormsOS"))


def first_sighting(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``, through a pre-aggregated minimum."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_b"))
    return best.select(key, *(F.col(f"_b.{c}").alias(c) for c in rest))
