"""The target after a plan: survivors, updates and inserts, checked before they are published."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import residue
from tallyweave.model import ReconcileError, RunContext, Snapshot
from tallyweave.operators import conflicts
from tallyweave.operators.closure import dangling
from tallyweave.operators.matching import new_guid
from tallyweave.operators.planning import union
from tallyweave.sources.scratch import stage

#: Categories whose pieces get a new id; those that are no objects; the reference fields of templates.
RENAMED, NO_OBJECTS = ("msa", "allomorph"), ("custom_fields", "exception_features")
SLOT_FIELDS = ("PrefixSlotsRS", "SuffixSlotsRS", "ProcliticSlotsRS", "EncliticSlotsRS")
#: References between entries, wired after all entries exist; those whose end isn't there wait for a later run.
INTER_ENTRY = ("ComponentLexemesRS", "PrimaryLexemesRS", "TargetsRS")
#: What a reference that leads nowhere means for its piece, by field; others are warnings.
SEVERITY = {"SegmentsRC": "fatal", "StratumRA": "ignored", "SlotsRC": "dropped"}


def applied(source: DataFrame, target: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    """Target rows (guid, columns): added pieces come from the source, overwritten ones take its values where it has any,
    the rest stays. One full join on guid; ids of the plan's actions join it."""
    todo = plan.where("verb IN ('ADD', 'OVERWRITE')").select(F.col("source_guid").alias("guid")).distinct()
    new = source.join(todo, "guid", "left_semi").select("guid", *(F.col(c).alias(f"_{c}") for c in columns))
    both = target.select("guid", *columns).join(new, "guid", "full_outer")
    return both.select("guid", *(F.coalesce(f"_{c}", c).alias(c) for c in columns))


def duplicates(objects: DataFrame) -> DataFrame:
    """guids that occur more than once: must be empty."""
    return objects.groupBy("guid").count().where("count > 1")


def tagged(touched: DataFrame, run_id: str, source: str, timestamp: str) -> DataFrame:
    """residue (guid, class_name, existing) after tagging every touched piece."""
    tag = residue.serialize(F.lit(run_id), F.lit(source), F.lit(timestamp))
    return touched.withColumn("text", residue.carry(F.col("existing"), F.col("class_name"), tag))


@dataclass(frozen=True)
class Applied:
    """A target after a run: its tables, the texts that hold its tags (guid, text), old and new ids (source_guid, target_guid),
    notes (source_guid, field, to_guid, severity) on what could not be created or linked, references that wait for their end,
    what became of each plan row (the plan's columns, outcome, why), and the decisions that were applied (guid, field, resolution,
    prior_run_id, category)."""

    objects: DataFrame
    refs: DataFrame
    props: DataFrame
    residue: DataFrame
    remap: DataFrame
    notes: DataFrame
    outbox: DataFrame
    outcomes: DataFrame
    decided: DataFrame | None = None

    def snapshot(self, custom_fields: DataFrame) -> Snapshot:
        """The target that the next run starts from."""
        return Snapshot(self.objects, self.refs, self.props, custom_fields, self.residue, self.outbox)


def plan_remap(plan: DataFrame, run_id: str) -> DataFrame:
    """(source_guid, target_guid) of pieces that don't keep their id: those created anew, and those matched by likeness."""
    fresh = plan.where((F.col("verb") == "ADD") & F.col("category").isin(*RENAMED)).select("source_guid", new_guid(run_id, "source_guid").alias("target_guid"))
    return fresh.unionByName(plan.where("verb IN ('OVERWRITE', 'SKIP') AND target_guid <> source_guid").select("source_guid", "target_guid"))


def unmatched(refs: DataFrame, there: DataFrame) -> DataFrame:
    """Notes on refs whose end isn't ``there`` (guid)."""
    lost = refs.join(there.select(F.col("guid").alias("to_guid")), "to_guid", "left_anti")
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p)), F.col("field")), F.lit("warning"))
    return lost.select(F.col("from_guid").alias("source_guid"), "field", "to_guid", level.alias("severity"))


def created(plan: DataFrame, source: Snapshot, target: Snapshot) -> tuple[DataFrame, DataFrame]:
    """(objects, notes): pieces that the plan adds and that can be created, under their source ids.

    Values come with their feature. Phonemes go to the target's first phoneme set, without one they aren't created. A
    natural class needs all its phonemes, and every owned piece its owner; what fails takes along what it owns."""
    adds = plan.where((F.col("verb") == "ADD") & ~F.col("category").isin(*NO_OBJECTS)).select(F.col("source_guid").alias("guid"))
    own = source.objects.join(adds, "guid", "left_semi")
    features = own.where("category = 'inflection_features'").select(F.col("guid").alias("owner_guid"))
    values = source.of("inflection_features").join(features, "owner_guid", "left_semi").select(own.columns)
    rows = own.unionByName(values).dropDuplicates(["guid"]).join(target.objects.select("guid"), "guid", "left_anti")
    home = target.objects.where("class_name = 'PhPhonemeSet'").agg(F.min_by("guid", F.struct("ord", "guid")).alias("g")).first().g
    rows = rows.withColumn("owner_guid", F.when(F.col("category") == "phonemes", F.coalesce(F.lit(home), F.lit("no phoneme set"))).otherwise(F.col("owner_guid")))
    rows, notes = stage(rows.select(own.columns), "created"), []
    while True:
        there = target.objects.select("guid").unionByName(rows.select("guid"))
        orphans = dangling(rows, there).select(F.col("guid").alias("source_guid"), F.lit("owner").alias("field"), F.col("owner_guid").alias("to_guid"), F.lit("fatal").alias("severity"))
        links = source.refs.join(rows.select(F.col("guid").alias("from_guid")), "from_guid", "left_semi")
        lost = stage(orphans.unionByName(unmatched(links.where("field = 'SegmentsRC'"), there)), "lost")
        if lost.isEmpty():
            return rows, union([*notes, lost])
        notes.append(lost)
        rows = stage(rows.join(lost.select(F.col("source_guid").alias("guid")), "guid", "left_anti"), "created")


def _renamed(df: DataFrame, column: str, remap: DataFrame) -> DataFrame:
    """df with the ids in ``column`` moved to their new ones."""
    to = remap.select(F.col("source_guid").alias(column), F.col("target_guid").alias("_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).select(df.columns)


def with_owner_fields(new: DataFrame, target: Snapshot) -> DataFrame:
    """Of the new allomorphs of an entry that has none yet the first is the lexeme form, all others are alternates."""
    allomorphs = new.where("category = 'allomorph'")
    first = allomorphs.groupBy("owner_guid").agg(F.min_by("guid", F.struct("ord", "guid")).alias("guid"))
    first = first.join(target.of("allomorph").select("owner_guid"), "owner_guid", "left_anti").select("guid", F.lit("LexemeFormOA").alias("_first"))
    field = F.when(F.col("category") == "allomorph", F.coalesce("_first", F.lit("AlternateFormsOS"))).otherwise(F.col("owner_field"))
    return new.join(first, "guid", "left").withColumn("owner_field", field).select(new.columns)


def refs_after(plan: DataFrame, source: Snapshot, target: Snapshot, new: DataFrame, remap: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(refs, notes, outbox): the target's references, those of created pieces (``new``, under source ids), the slots of planned
    templates and overwritten analyses, and planned pairs; nothing is linked twice, and nothing to what isn't there (``there``: guid).

    References between entries come last: those of created and overwritten pieces, and those that earlier runs left waiting.
    The ones whose end is still missing go to the outbox, under target ids at their start and source ids at their end."""
    todo = lambda where: plan.where(where).select(F.col("source_guid").alias("from_guid"))
    of_new = source.refs.join(new.select(F.col("guid").alias("from_guid")), "from_guid", "left_semi")
    held = source.links(*SLOT_FIELDS).join(todo("category = 'templates' AND verb <> 'ADD' AND reason IS DISTINCT FROM 'bare_bones_missing_closure'"), "from_guid", "left_semi")
    again = source.links("SlotsRC").join(todo("category = 'msa' AND verb = 'OVERWRITE'"), "from_guid", "left_semi")
    between = source.links(*INTER_ENTRY).join(todo("category IN ('entry', 'sense') AND verb = 'OVERWRITE'"), "from_guid", "left_semi")
    pair = F.split("source_guid", "::")
    pairs = plan.where("category = 'exception_features' AND verb = 'ADD'").select(pair[0].alias("from_guid"), F.lit("ExceptionFeaturesOC").alias("field"), pair[1].alias("to_guid"), F.lit(0).cast("long").alias("ord"))
    asked = _renamed(union([of_new, held, again, between, pairs]).select("from_guid", "field", "to_guid", "ord"), "from_guid", remap)
    if target.outbox is not None:
        asked = asked.unionByName(target.outbox.select(asked.columns))
    wanted = _renamed(asked.withColumn("_was", F.col("to_guid")), "to_guid", remap)
    ends = wanted.join(there.select(F.col("guid").alias("from_guid")), "from_guid", "left_semi")
    linked = ends.join(there.select(F.col("guid").alias("to_guid")), "to_guid", "left_semi")
    cleared = _renamed(todo("category = 'msa' AND verb = 'OVERWRITE'"), "from_guid", remap).withColumn("field", F.lit("SlotsRC"))
    kept = target.refs.join(cleared, ["from_guid", "field"], "left_anti").select("from_guid", "field", "to_guid", "ord")
    added = linked.select(kept.columns).join(kept, ["from_guid", "field", "to_guid"], "left_anti").dropDuplicates(["from_guid", "field", "to_guid"])
    late = F.col("field").isin(*INTER_ENTRY)
    waiting = ends.where(late).join(there.select(F.col("guid").alias("to_guid")), "to_guid", "left_anti")
    outbox = waiting.select("from_guid", "field", F.col("_was").alias("to_guid"), "ord").dropDuplicates(["from_guid", "field", "to_guid"])
    return kept.unionByName(added.select(kept.columns)), unmatched(ends.where(~late), there), outbox


def outcomes(plan: DataFrame, done: DataFrame, failed: DataFrame, target: Snapshot, refs: DataFrame, remap: DataFrame) -> DataFrame:
    """The plan's rows with outcome (done, skipped, failed) and why: what the executor made of each, not what was planned.

    done: guids created, under source ids; failed: notes. A piece that fails says what it lacks; a pair is done once its
    reference is there, an overwrite if its piece was in the target."""
    why = failed.groupBy("source_guid").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "field", "to_guid"))), ", ").alias("_lacks"))
    pair = F.concat_ws("::", "from_guid", "to_guid")
    wired = refs.where("field = 'ExceptionFeaturesOC'").select(pair.alias("source_guid")).distinct().withColumn("_wired", F.lit(True))
    made = done.select(F.col("guid").alias("source_guid")).distinct().withColumn("_made", F.lit(True))
    here = target.objects.select(F.col("guid").alias("target_guid")).distinct().withColumn("_here", F.lit(True))
    joined = plan.join(why, "source_guid", "left").join(wired, "source_guid", "left").join(made, "source_guid", "left").join(here, "target_guid", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    good = F.when(F.col("verb") == "OVERWRITE", yes("_here")).when(F.col("category") == "exception_features", yes("_wired")).otherwise(yes("_made") | yes("_here"))
    outcome = F.when(F.col("verb") == "SKIP", "skipped").when(good, "done").otherwise("failed")
    reason = F.when(outcome == "failed", F.coalesce(F.concat(F.lit("lacks "), F.col("_lacks")), F.when(F.col("category") == "exception_features", "an end of the pair is missing").otherwise("it isn't there")))
    return joined.select(*plan.columns, outcome.alias("outcome"), reason.alias("why"))


def applied_snapshot(context: RunContext, plan: DataFrame, source: Snapshot, target: Snapshot, decisions: DataFrame | None = None, accept_priors: bool = False) -> Applied:
    """The target after a plan. Custom fields change nothing, overwritten slots only get their tag, overwritten pieces take
    the source's facts but for the decisions on them, and every touched piece is tagged: its class replaces the earlier tag or
    appends to the text that is there, and what isn't touched keeps its text. accept_priors: conflicts without a decision take
    that of the last run, if its tag tells one. Each table is worked out when it is asked for; who asks more than once stages it."""
    plan, remap = stage(plan, "plan"), stage(plan_remap(plan, context.run_id), "remap")
    new, failed = created(plan, source, target)
    objects = target.objects.unionByName(_renamed(with_owner_fields(new, target), "guid", remap).select(target.objects.columns))
    there = target.objects.select("guid").unionByName(_renamed(new.select("guid"), "guid", remap))
    refs, loose, outbox = refs_after(plan, source, target, new, remap, there)

    over = plan.where("verb = 'OVERWRITE'").select(F.col("source_guid").alias("guid"), "target_guid", "category")
    update = source.props.join(over.where("category <> 'slots'").select("guid", "target_guid"), "guid").withColumn("guid", F.col("target_guid")).select(source.props.columns)
    update = conflicts.without_equal_customs(update, target.props)
    log = decided = None
    results = outcomes(plan, new, failed, target, refs, remap)
    if decisions is not None or accept_priors:
        if decisions is not None:
            decisions = stage(decisions, "given")
            conflicts.require_unique(decisions)
        found = stage(conflicts.collected(plan, source, target).select("guid", "field", "l", "r"), "conflicts")  # nobody reads their texts
        decisions = stage(conflicts.with_priors(found, decisions, target.residue, accept_priors), "decisions")
        conflicts.require_decisions(found, decisions)
        resolved = stage(conflicts.apply_decisions(found, decisions, context.run_id).drop("value"), "decided")
        update = conflicts.decided_facts(update, resolved)
        log = conflicts.decision_log(decisions.join(found.select("guid", "field"), ["guid", "field"], "left_semi"))
        category = over.select(F.col("target_guid").alias("source_guid"), "category")
        skips = conflicts.interactive_skips(resolved).join(category, "source_guid")
        decided = resolved.select("guid", "field", "resolution").join(decisions.select("guid", "field", "prior_run_id"), ["guid", "field"]).join(category.withColumnRenamed("source_guid", "guid"), "guid")
        nothing = {c: F.lit(None).cast(t).alias(c) for c, t in plan.dtypes if c not in ("verb", "category", "source_guid", "reason", "detail")}
        results = results.unionByName(skips.select(*(nothing.get(c, F.col(c)) for c in plan.columns), F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("why")))
    born = _renamed(source.props.join(new.select("guid"), "guid", "left_semi"), "guid", remap)
    props = conflicts.source_wins(update, target.props)
    props = props.unionByName(conflicts.typed(born).select(props.columns))

    snaps = conflicts.typed(target.props).groupBy("guid").agg(F.map_from_entries(F.collect_list(F.struct("field", conflicts.plain("s", "n", "b", "arr", "ms")))).alias("fields"))
    classes = target.objects.select(F.col("guid").alias("target_guid"), "class_name")
    touched = over.join(classes, "target_guid").select(F.col("target_guid").alias("guid"), "class_name").distinct().join(snaps, "guid", "left")
    if log is not None:
        touched = touched.join(log, "guid", "left")
    snap = residue.snapshot_json(F.coalesce("fields", F.create_map().cast("map<string,string>")))
    stamp = residue.serialize(F.lit(context.run_id), F.lit(context.source), F.lit(context.started_at), snap, F.col("log") if log is not None else None)
    plain = residue.serialize(F.lit(context.run_id), F.lit(context.source), F.lit(context.started_at))
    there = target.residue.select("guid", F.col("text").alias("existing")) if target.residue is not None else None
    touched = touched.withColumn("existing", F.lit(None).cast("string")) if there is None else touched.join(there, "guid", "left")
    tags = touched.select("guid", residue.carry(F.col("existing"), F.col("class_name"), stamp).alias("text"))
    tags = tags.unionByName(_renamed(new.select("guid", "class_name"), "guid", remap).select("guid", residue.carry(F.lit(None).cast("string"), F.col("class_name"), plain).alias("text")))
    if there is not None:
        tags = stage(tags, "tags")
        tags = tags.unionByName(target.residue.select("guid", "text").join(tags.select("guid"), "guid", "left_anti"))
    return Applied(objects, refs, props, tags, remap, failed.unionByName(loose), outbox, results, decided)


def check_target(objects: DataFrame, refs: DataFrame | None = None, props: DataFrame | None = None) -> None:
    """Refuse a target that would be broken: ids and facts must be unique, owners and the ends of references there."""
    if not duplicates(objects).isEmpty():
        raise ReconcileError("a guid would occur twice")
    if "owner_guid" in objects.columns and not dangling(objects, objects).isEmpty():
        raise ReconcileError("a piece would have no owner")
    ids = objects.select("guid")
    if refs is not None:
        for end in ("from_guid", "to_guid"):
            if not refs.join(ids.select(F.col("guid").alias(end)), end, "left_anti").isEmpty():
                raise ReconcileError(f"a reference's {end} would lead nowhere")
    if props is not None:
        if not props.join(ids, "guid", "left_anti").isEmpty():
            raise ReconcileError("a fact would have no piece")
        if not props.groupBy("guid", "field").count().where("count > 1").isEmpty():
            raise ReconcileError("a field would have two facts")


def publish(objects: DataFrame, path: str) -> None:
    """Write a checked target to a new folder; readers are pointed at it afterwards, so a failure changes nothing.

    Ids must be unique, and every owner must be there (if the table has owners)."""
    check_target(objects)
    objects.write.mode("error").parquet(path)
