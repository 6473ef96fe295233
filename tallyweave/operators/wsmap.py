"""Writing systems: scan, mismatches, candidates, choices and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.values import ws_rank
from tallyweave.model import ReconcileError


def scan(rows: DataFrame, ids: list[str], kind: str) -> DataFrame:
    """(ws_id, kind): the first id that isn't blank, kind vernacular unless told; rows without any id drop out."""
    ws = F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in ids))
    return rows.select(ws.alias("ws_id"), F.coalesce(F.col(kind), F.lit("vernacular")).alias("kind")).where("ws_id IS NOT NULL").distinct()


def mismatches(source: DataFrame, target: DataFrame) -> DataFrame:
    """Writing systems of the source that the target lacks by id."""
    return source.join(target.select("ws_id").distinct(), "ws_id", "left_anti")


def ranked_candidates(missing: DataFrame, target: DataFrame) -> DataFrame:
    """(ws_id, kind, candidates): all target ids, likest first, then by id. Every target id is a candidate of every missing
    one, so the target's ids travel as one list, as long as the answer's own."""
    ids = target.select("ws_id").distinct().agg(F.collect_list("ws_id").alias("_ids"), F.lit(1).alias("_all"))
    options = F.transform(F.coalesce("_ids", F.array().cast("array<string>")), lambda i: F.struct(ws_rank(F.col("ws_id"), i).alias("rank"), i.alias("id")))
    return missing.withColumn("_all", F.lit(1)).join(ids, "_all", "left").select("ws_id", "kind", F.array_sort(options).alias("candidates"))


def folded(mapping: DataFrame, choices: DataFrame) -> DataFrame:
    """(source_ws, kind, target_ws, created): the mapping, then choices on pairs that it lacks: map and create add one,
    skip adds nothing. Creating maps a writing system to its own id."""
    new = choices.where("choice <> 'skip'").join(mapping.select("source_ws", "kind"), ["source_ws", "kind"], "left_anti")
    target = F.when(F.col("choice") == "create", F.col("source_ws")).otherwise(F.col("target_ws"))
    added = new.groupBy("source_ws", "kind").agg(F.min(F.struct(target.alias("target_ws"), (F.col("choice") == "create").alias("created"))).alias("c")).select("source_ws", "kind", "c.*")
    return mapping.select("source_ws", "kind", "target_ws", "created").unionByName(added)


def shared_targets(mapping: DataFrame) -> DataFrame:
    """Targets that several sources map to: must be empty."""
    return mapping.groupBy("target_ws").agg(F.countDistinct("source_ws").alias("sources")).where("sources > 1")


def coverage(required: DataFrame, mapping: DataFrame, strict: bool = False) -> DataFrame:
    """(source_ws, kind, problem): required pairs that aren't mapped; if strict, also mapped pairs that nobody needs."""
    keys = ["source_ws", "kind"]
    need = required.select(F.col("ws_id").alias("source_ws"), "kind").distinct()
    missing = need.join(mapping, keys, "left_anti").withColumn("problem", F.lit("missing"))
    if not strict:
        return missing
    return missing.unionByName(mapping.select(*keys).distinct().join(need, keys, "left_anti").withColumn("problem", F.lit("extra")))


def require_complete(required: DataFrame, mapping: DataFrame, strict: bool = False) -> None:
    if n := coverage(required, mapping, strict).count():
        raise ReconcileError(f"the writing-system mapping has {n} gaps or extras")


def only_in_skipped(texts: DataFrame, skipped: DataFrame) -> DataFrame:
    """SKIP rows of pieces (guid, ws_id) all of whose texts are in skipped writing systems."""
    marked = texts.join(skipped.select("ws_id").distinct().withColumn("_s", F.lit(True)), "ws_id", "left")
    gone = marked.groupBy("guid").agg(F.every(F.coalesce("_s", F.lit(False))).alias("gone")).where("gone")
    return gone.select(F.col("guid").alias("source_guid"), F.lit("SKIP").alias("verb"), F.lit("unmapped_ws_user_chose_skip").alias("reason"))


def texts_of(props: DataFrame) -> DataFrame:
    """(guid, ws_id) of every text that isn't blank in facts by writing system."""
    entries = props.select("guid", F.explode(F.map_entries("ms")).alias("e")) if "ms" in props.columns else None
    if entries is None:
        return props.select("guid", F.lit(None).cast("string").alias("ws_id")).where("false")
    return entries.where(F.trim(F.coalesce("e.value", F.lit(""))) != "").select("guid", F.col("e.key").alias("ws_id"))


def in_target_systems(props: DataFrame, mapping: DataFrame, skipped: DataFrame) -> DataFrame:
    """Facts with the keys of texts by writing system moved to the target's; texts in skipped systems go, keys that nothing maps
    stay. Of two systems that map to one key the first by name counts; a fact that loses all its texts goes."""
    if "ms" not in props.columns:
        return props
    to = mapping.groupBy(F.col("source_ws").alias("ws")).agg(F.min("target_ws").alias("_to"))
    gone = skipped.select(F.col("ws_id").alias("ws")).distinct()
    entries = props.where("ms IS NOT NULL").select("guid", "field", F.explode("ms").alias("ws", "text")).join(gone, "ws", "left_anti").join(to, "ws", "left")
    first = entries.groupBy("guid", "field", F.coalesce("_to", "ws").alias("key")).agg(F.min_by("text", "ws").alias("text"))
    maps = first.groupBy("guid", "field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "text")))).alias("_ms"))
    joined = props.join(maps, ["guid", "field"], "left")
    kept = joined.where("ms IS NULL OR _ms IS NOT NULL OR size(ms) = 0")
    return kept.select(*(F.when(F.size("ms") == 0, F.col("ms")).otherwise(F.col("_ms")).alias("ms") if c == "ms" else F.col(c) for c in props.columns))


def lookup(mapping: DataFrame, source_ws: str) -> str | None:
    row = mapping.where(F.col("source_ws") == source_ws).select("target_ws").orderBy("target_ws").first()
    return row.target_ws if row else None
