"""Plan rows: what is to be done with each piece, and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.values import is_gold
from tallyweave.model import ReconcileError, Selection, Snapshot


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def plan_row(category: str | Column, verb: Column, reason: Column, detail: Column, target: Column, via: Column, owner: Column, parents: Column) -> list[Column]:
    c = F.lit(category) if isinstance(category, str) else category
    named = (verb, "verb"), (c, "category"), (F.col("guid"), "source_guid"), (target, "target_guid"), (via, "match_via"), (owner, "owner_guid"), (reason, "reason"), (detail, "detail"), (parents, "pulled_in_by")
    return [x.cast("array<string>" if n == "pulled_in_by" else "string").alias(n) for x, n in named]


def plan_pieces(pieces: DataFrame, category: str | Column, overwrite: bool = False, parents: Column | None = None) -> DataFrame:
    """Plan rows of pieces that know ``present`` (and catalog_id, owner_guid if they have them): gold is skipped first, then
    what is present is overwritten or skipped by the flag, and the rest is added under its own id."""
    gold = is_gold("catalog_id") if "catalog_id" in pieces.columns else F.lit(False)
    owner = F.col("owner_guid") if "owner_guid" in pieces.columns else F.lit(None)
    there = F.col("present")
    over = F.lit(overwrite)
    verb = F.when(gold, "SKIP").when(there & over, "OVERWRITE").when(there, "SKIP").otherwise("ADD")
    reason = F.when(gold, "gold_inviolable").when(there & ~over, "already_present_by_guid")
    detail = F.when(gold, F.concat(F.lit("catalog "), F.coalesce(F.col("catalog_id"), F.lit("")) if "catalog_id" in pieces.columns else F.lit(""))).when(there & ~over, F.concat(F.col("guid"), F.lit(" is in the target")))
    via = F.when(there & ~gold, "guid").otherwise("none")
    return pieces.select(*plan_row(category, verb, reason, detail, F.when(verb != "SKIP", F.col("guid")), via, owner, parents if parents is not None else F.array()))


def plan_by_identity(fields: DataFrame, target: DataFrame) -> DataFrame:
    """Custom fields are never created: SKIP by identity (owner_class, name, case counts) or as manual work."""
    there = target.select("owner_class", "name").distinct().withColumn("_there", F.lit(True))
    joined = fields.join(there, ["owner_class", "name"], "left")
    reason = F.when(F.col("_there"), "already_present_by_identity").otherwise("needs_manual")
    guid = F.concat_ws(":", F.lit("cf"), "owner_class", "name")
    return joined.select(F.lit("SKIP").alias("verb"), guid.alias("source_guid"), reason.alias("reason"), F.concat_ws(".", "owner_class", "name").alias("detail"))


def plan_wiring(pairs: DataFrame, target: DataFrame) -> DataFrame:
    """Reference wiring by pair (owner, value): malformed pairs are unsupported, known ones are skipped, the rest added."""
    there = target.select("owner", "value").distinct().withColumn("_there", F.lit(True))
    joined = pairs.join(there, ["owner", "value"], "left")
    bad = F.col("owner").isNull() | F.col("value").isNull()
    verb = F.when(bad | F.col("_there"), "SKIP").otherwise("ADD")
    reason = F.when(bad, "unsupported_lcm_type").when(F.col("_there"), "already_present_by_guid")
    return joined.select(verb.alias("verb"), F.concat_ws("::", "owner", "value").alias("source_guid"), reason.alias("reason"))


def plan_vertical(owners: DataFrame, templates: DataFrame, slots: DataFrame, selection: Selection) -> DataFrame:
    """Plan rows of owners, their templates and the templates' slots under one selection.

    owners: guid, present; templates: guid, owner_guid, present; slots: guid, template, ord, present. Closure on: all
    three levels, with the parent that pulled a piece in unless its category is selected. Closure off: each level by its
    category; a template whose owner or (if it has any) slots aren't selected is skipped as bare bones, and a slot needs
    its template planned."""
    pos, tpl, slt = (selection.on(c) for c in ("pos", "templates", "slots"))
    lit, on = F.lit, selection.closure and (pos or tpl or slt)
    if on or slt:
        counted = templates.withColumn("_slots", lit(None).cast("string"))
    else:  # skipped templates tell which of their slots aren't selected
        counted = templates.join(slots.groupBy(F.col("template").alias("guid")).agg(F.array_join(F.array_sort(F.collect_list("guid")), ", ").alias("_slots")), "guid", "left")
    none = F.array().cast("array<string>")
    parts = []
    if on or pos:
        parts.append(plan_pieces(owners, "pos", selection.overwrite, none if pos else F.array("guid")))
    if on or tpl:
        lacks_owner, lacks_slots = lit(not (on or pos)), lit(not (on or slt)) & F.col("_slots").isNotNull()
        bare = lacks_owner | lacks_slots
        kept = plan_pieces(counted.where(~bare), "templates", selection.overwrite, none if tpl else F.array("owner_guid"))
        why = F.concat_ws(", ", F.when(lacks_owner, F.col("owner_guid")), F.when(lacks_slots, F.col("_slots")))
        skipped = counted.where(bare).select(*plan_row("templates", lit("SKIP"), lit("bare_bones_missing_closure"), why, lit(None), lit("none"), F.col("owner_guid"), none))
        parts += [kept, skipped]
    if on or (pos and tpl and slt):
        once = slots.groupBy("guid").agg(F.min("template").alias("template"), F.min("ord").alias("ord"), F.max("present").alias("present"))
        parts.append(plan_pieces(once, "slots", selection.overwrite, none if slt else F.array("template")))
    return union(parts) if parts else plan_pieces(owners, "pos").where("false")


def lockstep(entries: DataFrame, senses: DataFrame, overwrite: bool) -> DataFrame:
    """Entries (guid, present) and senses (guid, owner_guid): a sense is overwritten or skipped with its entry, else added."""
    of = senses.join(entries.select(F.col("guid").alias("owner_guid"), "present"), "owner_guid")
    return plan_pieces(entries, "entry", overwrite).unionByName(plan_pieces(of, "sense", overwrite))


def full_row(rows: DataFrame, category: str) -> DataFrame:
    """Short plan rows (verb, source_guid, reason and maybe detail) with all columns of a plan."""
    own = rows.select(F.col("source_guid").alias("guid"), "verb", "reason", F.col("detail") if "detail" in rows.columns else F.lit(None).alias("detail"))
    target = F.when(F.col("verb") != "SKIP", F.col("guid"))
    return own.select(*plan_row(category, F.col("verb"), F.col("reason"), F.col("detail"), target, F.lit("none"), F.lit(None), F.array()))


def unresolved_skipped(plan: DataFrame, missing: DataFrame, verbs: tuple[str, ...] = ("ADD",)) -> DataFrame:
    """The plan with its rows of these verbs among ``missing`` (source_guid, reason, detail) turned into skips."""
    why = missing.select("source_guid", F.col("reason").alias("_reason"), F.col("detail").alias("_detail"))
    joined = plan.join(why, "source_guid", "left")
    hit = F.col("verb").isin(*verbs) & F.col("_reason").isNotNull()
    new = {"verb": F.lit("SKIP"), "reason": F.col("_reason"), "detail": F.col("_detail"), "target_guid": F.lit(None).cast("string")}
    return joined.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in plan.columns))


def first_planned(plan: DataFrame, category: str) -> DataFrame:
    """The first piece of a category that the plan (column ord) adds or overwrites: one row, or none."""
    rows = plan.where((F.col("category") == category) & (F.col("verb") != "SKIP"))
    return rows.agg(F.min_by("source_guid", F.struct("ord", "source_guid")).alias("source_guid")).where("source_guid IS NOT NULL")


def count_of(plan: DataFrame, category: str) -> int:
    return plan.where(F.col("category") == category).count()


def ordered_touched(plan: DataFrame) -> DataFrame:
    """(source_guid, ord): pieces in the order in which the plan first names them (column ord)."""
    return plan.groupBy("source_guid").agg(F.min("ord").alias("ord"))


def signature(rows: DataFrame) -> str:
    """A digest of a whole table whatever its order: count and sum of row hashes; maps count by their sorted entries."""
    column = lambda f: (F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`")).alias(f.name)
    row = F.to_json(F.struct(*(column(f) for f in sorted(rows.schema.fields, key=lambda f: f.name))), {"ignoreNullFields": "false"})
    r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}:{r.h}"


def snapshot_signature(side: Snapshot) -> str:
    """A digest of all tables of a snapshot; a committed version is its own."""
    if side.version is not None:
        return side.version
    tables = (side.objects, side.refs, side.props, side.custom_fields, side.residue, side.outbox)
    return " ".join("-" if t is None else signature(t) for t in tables)


def selection_signature(selection: Selection) -> str:
    picks = {k: sorted(v) for k, v in sorted(selection.picks.items())}
    return f"{sorted(selection.categories)} {selection.closure} {selection.overwrite} {selection.interactive} {selection.by_name} {picks}"


def check_unchanged(plan: DataFrame, agreed: str) -> None:
    """Refuse to apply a plan other than the one that was shown."""
    if (now := signature(plan)) != agreed:
        raise ReconcileError(f"the plan changed since its preview ({agreed} then, {now} now)")
