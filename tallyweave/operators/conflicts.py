"""Field conflicts, decisions on them, and the values that result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import residue
from tallyweave.functions.values import merge_eligible, merge_lists, merge_maps, merge_sets, merge_text
from tallyweave.model import ReconcileError, Snapshot

#: Categories whose overwritten pieces are asked about, one field at a time.
ASKED = ("pos", "entry", "sense", "allomorph")
#: Columns of a fact's value and their types: text, whole number, boolean, list or set of texts, texts by writing system.
TYPES = {"vtype": "string", "s": "string", "n": "long", "b": "boolean", "arr": "array<string>", "ms": "map<string,string>"}
VALUE = tuple(TYPES)


def typed(facts: DataFrame) -> DataFrame:
    """facts (guid, field, vtype and any of the value columns) with all value columns; those that it lacks are null."""
    return facts.select("guid", "field", *(F.col(c) if c in facts.columns else F.lit(None).cast(t).alias(c) for c, t in TYPES.items()))


def _value(side: str) -> Column:
    """What makes two values equal: sets without their order, maps as sorted entries."""
    c = lambda name: F.col(f"{side}.{name}")
    items = F.when(c("vtype") == "set", F.array_sort(c("arr"))).otherwise(c("arr"))
    return F.struct(c("vtype"), c("s"), c("n"), c("b"), items.alias("arr"), F.array_sort(F.map_entries(c("ms"))).alias("ms"))


def _sides(source: DataFrame, target: DataFrame) -> DataFrame:
    """Facts on both sides: key columns, l (target's value) and r (source's), typed."""
    r = typed(source).select("guid", "field", F.struct(*VALUE).alias("r"))
    return typed(target).select("guid", "field", F.struct(*VALUE).alias("l")).join(r, ["guid", "field"])


def shown(side: str) -> Column:
    """A value as text: lists and maps as JSON, maps with their keys in order."""
    return plain(*(f"{side}.{c}" for c in ("s", "n", "b", "arr", "ms")))


def differing(source: DataFrame, target: DataFrame, blank_is_none: bool = False) -> DataFrame:
    """guid, field, l (target's value), r (source's) of facts that both sides have and that differ; see ``conflicts``."""
    both = _sides(source, target).where(~_value("l").eqNullSafe(_value("r")))
    if blank_is_none:
        full = lambda side: (F.coalesce(F.col(f"{side}.s"), F.lit("-")) != "") & (F.coalesce(F.size(f"{side}.arr"), F.lit(-1)) != 0) & (F.coalesce(F.size(f"{side}.ms"), F.lit(-1)) != 0)
        both = both.where(full("l") & full("r"))
    return both


def _asked(both: DataFrame) -> list[Column]:
    return [F.col("guid"), F.col("field"), shown("l").alias("left_value"), shown("r").alias("right_value"), merge_eligible(F.col("l.vtype"), F.col("r.vtype")).alias("eligible")]


def conflicts(source: DataFrame, target: DataFrame, blank_is_none: bool = False) -> DataFrame:
    """guid, field, left_value (target), right_value (source), eligible, of facts that both sides have and that differ.

    Types count: the number 1 differs from true and from the text 1. A null value is a value; a missing field is no
    conflict. Lists differ by order, sets and texts by writing system don't. blank_is_none: a side that is the empty text, list
    or map asks nothing."""
    both = differing(source, target, blank_is_none)
    return both.select(*_asked(both))


def with_prior(found: DataFrame, prior: DataFrame) -> DataFrame:
    """conflicts with the earlier decision on the same field (guid, field, resolution), if there is one."""
    last = prior.select("guid", "field", F.col("resolution").alias("prior"))
    return found.join(last, ["guid", "field"], "left")


def plain(s: str, n: str, b: str, arr: str | None = None, ms: str | None = None) -> Column:
    """A typed value as text."""
    more = [F.to_json(F.col(arr)), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(ms)))))] if arr and ms else []
    return F.coalesce(F.col(s), F.col(n).cast("string"), F.col(b).cast("string"), *more).alias("value")


def collected(plan: DataFrame, source: Snapshot, target: Snapshot) -> DataFrame:
    """conflicts of the pieces that a plan overwrites, in the categories that are asked about, under their target ids; l and r
    are the typed values."""
    over = plan.where((F.col("verb") == "OVERWRITE") & F.col("category").isin(*ASKED)).select(F.col("source_guid").alias("guid"), "target_guid")
    new = typed(source.props).join(over, "guid").withColumn("guid", F.col("target_guid")).drop("target_guid")
    both = differing(new, typed(target.props).join(over.select(F.col("target_guid").alias("guid")), "guid", "left_semi"))
    return both.select(*_asked(both), "l", "r")


def _as(vtype: str | Column, **parts: Column) -> Column:
    """A typed value of the given columns; the others are null."""
    kind = F.lit(vtype) if isinstance(vtype, str) else vtype
    return F.struct(kind.alias("vtype"), *(parts[c].cast(t).alias(c) if c in parts else F.lit(None).cast(t).alias(c) for c, t in TYPES.items() if c != "vtype"))


def merged_value(run_id: str) -> Column:
    """l and r as one typed value: texts around a line that names the run, lists and sets without repeats, maps by key; of a
    pair with a scalar the source's; other pairs as both texts, those that are texts quoted."""
    l, r = F.col("l"), F.col("r")
    both = lambda *kinds: l.vtype.isin(*kinds) & (l.vtype == r.vtype)
    quoted = lambda side: F.when(F.col(f"{side}.vtype") == "str", F.concat(F.lit("'"), F.col(f"{side}.s"), F.lit("'"))).otherwise(shown(side))
    out = F.when(~merge_eligible(l.vtype, r.vtype), r).when(both("str"), _as("str", s=merge_text(l.s, r.s, run_id)))
    out = out.when(both("list"), _as("list", arr=merge_lists(l.arr, r.arr))).when(both("set"), _as("set", arr=merge_sets(l.arr, r.arr)))
    return out.when(both("map"), _as("map", ms=merge_maps(l.ms, r.ms, run_id))).otherwise(_as("str", s=merge_text(quoted("l"), quoted("r"), run_id)))


def custom_value(text: Column) -> Column:
    """A free text as a value of the target's type: a number or truth value if it is one, the entry of a map's first key, one
    item of a list; else a text."""
    kind = F.col("l.vtype")
    number, truth = text.try_cast("long"), text.try_cast("boolean")
    out = F.when((kind == "int") & number.isNotNull(), _as("int", n=number)).when((kind == "bool") & truth.isNotNull(), _as("bool", b=truth))
    first = F.array_min(F.map_keys("l.ms"))
    return out.when(kind.isin("list", "set"), _as(kind, arr=F.array(text))).when((kind == "map") & first.isNotNull(), _as("map", ms=F.create_map(first, text))).otherwise(_as("str", s=text))


def decided_facts(facts: DataFrame, decided: DataFrame) -> DataFrame:
    """Source facts after decisions (with their typed value v): kept and skipped fields leave, merged and edited ones carry their
    new value."""
    d = decided.select("guid", "field", F.col("resolution").alias("_how"), F.col("v").alias("_v"))
    joined = typed(facts).join(d, ["guid", "field"], "left").where("_how IS NULL OR _how NOT IN ('keep_target', 'skip')")
    new = F.coalesce(F.col("_how").isin("merge", "edit_custom"), F.lit(False))
    return joined.select("guid", "field", *(F.when(new, F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) for c in VALUE))


def interactive_skips(decided: DataFrame) -> DataFrame:
    """Short plan rows (verb, source_guid, reason, detail) of fields that a decision skipped."""
    return decided.where("skipped").select(F.lit("SKIP").alias("verb"), F.col("guid").alias("source_guid"), F.lit("interactive_skip").alias("reason"), F.col("field").alias("detail"))


def prior_decisions(residue_text: DataFrame) -> DataFrame:
    """(guid, field, resolution, custom_value, prior_run_id) out of tagged texts (guid, carrier, seq, text): of each piece the
    last text of carrier A, or of B where A has none, if it is a tag with a readable log."""
    parsed = residue.latest(residue_text.where("coalesce(text, '') <> ''")).select("guid", residue.parse(F.col("text"), "run_id", "merge").alias("p"))
    told = recalled(parsed.select("guid", F.col("p.merge").alias("log"), F.col("p.run_id").alias("prior_run_id")))
    return told.select("guid", "field", "resolution", "custom_value", "prior_run_id")


def accepted_priors(found: DataFrame, prior: DataFrame) -> DataFrame:
    """Decisions (guid, field, resolution, custom_value, prior_run_id) for conflicts that an earlier run decided: the same
    again, with the id of that run."""
    return found.select("guid", "field").join(prior, ["guid", "field"]).select("guid", "field", "resolution", "custom_value", "prior_run_id")


def without_equal_customs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source facts without the custom fields (Custom...) that the target has with an equal value."""
    l = typed(target).select("guid", "field", F.struct(*VALUE).alias("l"), F.lit(True).alias("_there"))
    joined = typed(source).select("guid", "field", F.struct(*VALUE).alias("r")).join(l, ["guid", "field"], "left")
    same = F.col("field").startswith("Custom") & F.coalesce(F.col("_there"), F.lit(False)) & _value("l").eqNullSafe(_value("r"))
    return joined.where(~same).select("guid", "field", "r.*").select("guid", "field", *(c for c in source.columns if c in VALUE))


def require_decisions(found: DataFrame, decisions: DataFrame) -> None:
    """Every conflict needs a decision before anything is written."""
    open_ones = found.join(decisions, ["guid", "field"], "left_anti")
    if n := open_ones.count():
        raise ReconcileError(f"{n} conflicts have no decision")


def require_unique(decisions: DataFrame) -> None:
    """A field can be decided once: two decisions on it are refused, whatever they say."""
    twice = decisions.groupBy("guid", "field").count().where("count > 1")
    if some := twice.limit(3).collect():
        raise ReconcileError(f"several decisions on one field, such as {[(r.guid, r.field) for r in some]}")


def apply_decisions(found: DataFrame, decisions: DataFrame, run_id: str) -> DataFrame:
    """conflicts with ``value`` and ``skipped``: take_source (also where none was made, and for merges of scalars),
    keep_target, merge, edit_custom (custom_value), skip (the target's value stays and the field is reported). Where found has
    the typed values l and r, v is the resulting one and ``value`` its text."""
    d = decisions.select("guid", "field", "resolution", "custom_value")
    joined = found.join(d, ["guid", "field"], "left")
    how = F.coalesce("resolution", F.lit("take_source"))
    merged = F.when(F.col("eligible"), merge_text(F.col("left_value"), F.col("right_value"), run_id)).otherwise(F.col("right_value"))
    if "l" in found.columns:
        v = F.when(how.isin("keep_target", "skip"), F.col("l")).when(how == "merge", merged_value(run_id)).when(how == "edit_custom", custom_value(F.col("custom_value"))).otherwise(F.col("r"))
        out = joined.select("guid", "field", how.alias("resolution"), (how == "skip").alias("skipped"), v.alias("v"))
        return out.select("guid", "field", "resolution", shown("v").alias("value"), "skipped", "v")
    value = F.when(how.isin("keep_target", "skip"), F.col("left_value")).when(how == "merge", merged).when(how == "edit_custom", F.col("custom_value")).otherwise(F.col("right_value"))
    return joined.select("guid", "field", how.alias("resolution"), value.alias("value"), (how == "skip").alias("skipped"))


def source_wins(source: DataFrame, target: DataFrame) -> DataFrame:
    """All facts after an overwrite: the source's where it has them, else the target's; with the value columns of either."""
    columns = [c for c in VALUE if c in source.columns or c in target.columns]
    r = typed(source).select("guid", "field", F.struct(*columns).alias("_r"), F.lit(True).alias("_has"))
    l = typed(target).select("guid", "field", F.struct(*columns).alias("_l"))
    both = l.join(r, ["guid", "field"], "full_outer")
    v = F.when(F.col("_has"), F.col("_r")).otherwise(F.col("_l"))
    return both.select("guid", "field", v.alias("v")).select("guid", "field", "v.*")


def merged_lists(target: DataFrame, source: DataFrame) -> DataFrame:
    """(guid, arr): union of the array fact of both sides, the target's order first."""
    both = target.select("guid", F.col("arr").alias("_l")).join(source.select("guid", F.col("arr").alias("_r")), "guid")
    return both.select("guid", merge_lists(F.col("_l"), F.col("_r")).alias("arr"))


def merged_any(both: DataFrame, run_id: str) -> DataFrame:
    """(guid, field, value) of facts with columns left_type, left_value, right_type, right_value, as text: equal types that
    can be merged are, other mergeable pairs become both texts in their quoted form, and scalars take the source's."""
    scalar = ~merge_eligible(F.col("left_type"), F.col("right_type"))
    quoted = lambda side: F.when(F.col(f"{side}_type") == "str", F.concat(F.lit("'"), F.col(f"{side}_value"), F.lit("'"))).otherwise(F.col(f"{side}_value"))
    same = (F.col("left_type") == "str") & (F.col("right_type") == "str")
    text = F.when(scalar, F.col("right_value")).when(same, merge_text(F.col("left_value"), F.col("right_value"), run_id)).otherwise(merge_text(quoted("left"), quoted("right"), run_id))
    return both.select("guid", "field", text.alias("value"))


def merged_maps(target: DataFrame, source: DataFrame, run_id: str) -> DataFrame:
    both = target.select("guid", F.col("ms").alias("_l")).join(source.select("guid", F.col("ms").alias("_r")), "guid")
    return both.select("guid", merge_maps(F.col("_l"), F.col("_r"), run_id).alias("ms"))


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last decision (guid, field, resolution) of a log ordered by ts, then seq; pre-aggregated, no sort of a group."""
    return log.groupBy("guid", "field").agg(F.max_by("resolution", F.struct("ts", "seq")).alias("resolution"))


def decision_log(decisions: DataFrame) -> DataFrame:
    """(guid, log): JSON list of a guid's decisions in order of field, nulls kept; fields are unique for a guid. prior_run_id is
    kept where decisions have it."""
    names = ["field", "resolution", "custom_value", *(c for c in ("prior_run_id",) if c in decisions.columns)]
    d = decisions.select("guid", F.struct(*names).alias("d"))
    listed = F.array_sort(F.collect_list("d"))
    return d.groupBy("guid").agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("log"))


def with_priors(found: DataFrame, decisions: DataFrame | None, residue_now: DataFrame | None, accept: bool) -> DataFrame:
    """Decisions (guid, field, resolution, custom_value, prior_run_id): those given, and if ``accept`` for open fields those that
    the last run left in the target's tags, with its id. A tag that can't be read decides nothing."""
    columns = ["guid", "field", "resolution", "custom_value", "prior_run_id"]
    nothing = F.lit(None).cast("string").alias("prior_run_id")
    given = None if decisions is None else decisions.select(*columns[:4], F.col("prior_run_id") if "prior_run_id" in decisions.columns else nothing)
    if not accept or residue_now is None:
        return given if given is not None else found.select("guid", "field", *(F.lit(None).cast("string").alias(c) for c in columns[2:])).where("false")
    texts = residue_now.select("guid", F.lit("A").alias("carrier"), F.lit(1).alias("seq"), "text")
    prior = accepted_priors(found, prior_decisions(texts)).select(*columns)
    return prior if given is None else given.unionByName(prior.join(given, ["guid", "field"], "left_anti"))


def recalled(residue: DataFrame) -> DataFrame:
    """(guid, field, resolution, custom_value) out of residue (guid, log): nothing where the log can't be read. Other columns of
    residue come along."""
    schema = "array<struct<field:string,resolution:string,custom_value:string>>"
    own = [c for c in residue.columns if c != "log"]
    rows = residue.select(*own, F.explode(F.from_json("log", schema)).alias("d"))
    return rows.where("d.field IS NOT NULL").select(*own, "d.*")


def refs_replaced(target: DataFrame, source: DataFrame, field: str, touched: DataFrame) -> DataFrame:
    """refs of the target with those of ``touched`` pieces and ``field`` cleared and taken from the source."""
    t = touched.select(F.col("guid").alias("from_guid")).distinct().withColumn("field", F.lit(field))
    return target.join(t, ["from_guid", "field"], "left_anti").unionByName(source.join(t, ["from_guid", "field"], "left_semi"))
