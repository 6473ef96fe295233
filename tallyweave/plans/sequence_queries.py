"""Registered queries on what runs do with each other's results: order, retraction, typed facts, outcomes, tags, late references,
writing systems. Their snapshots are derived from whole tables, each as small as its rule allows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import residue
from tallyweave.model import RunContext, Selection, Snapshot
from tallyweave.operators import apply, closure, conflicts, matching, planning, report, wsmap
from tallyweave.plans import run
from tallyweave.plans.registry import query
from tallyweave.sources.lexicon import name, source_snapshot, target_snapshot
from tallyweave.sources.scratch import stage
from tallyweave.sources.snapshots import read

C = F.col
FIRST = RunContext("src", "tgt", "GT-20260619-150000", "2026-06-19T15:00:00")
SECOND = RunContext("src", "tgt", "GT-20260620-150000", "2026-06-20T15:00:00")
TEXTS = "map<string,string>"


def _objects(df: DataFrame, category: str, class_name: str, guid, owner=None, ord=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(guid.alias("guid"), F.lit(category).alias("category"), F.lit(class_name).alias("class_name"), (none if owner is None else owner).alias("owner_guid"), none.alias("owner_field"), (F.lit(0) if ord is None else ord).cast("long").alias("ord"), none.alias("catalog_id"))


def _refs(df: DataFrame, field: str, start, end) -> DataFrame:
    return df.select(start.alias("from_guid"), F.lit(field).alias("field"), end.alias("to_guid"), F.lit(0).cast("long").alias("ord"))


def _facts(df: DataFrame, guid, field: str, vtype: str, **value) -> DataFrame:
    own = df.select(guid.alias("guid"), F.lit(field).alias("field"), F.lit(vtype).alias("vtype"), *(v.alias(k) for k, v in value.items()))
    return conflicts.typed(own)


def _no(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _snapshot(spark, objects: DataFrame, refs: DataFrame | None = None, props: DataFrame | None = None, tags: DataFrame | None = None) -> Snapshot:
    """Staged, since a run reads its sides many times."""
    put = lambda df, what: stage(df, what)
    refs = refs if refs is not None else _no(spark, "from_guid string, field string, to_guid string, ord long")
    props = props if props is not None else conflicts.typed(_no(spark, "guid string, field string, vtype string"))
    return Snapshot(put(objects, "objects"), put(refs, "refs"), put(props, "props"), _no(spark, "owner_class string, name string"), None if tags is None else put(tags, "tags"))


def _overwritten(s: Snapshot, t: Snapshot, category: str) -> DataFrame:
    return stage(planning.plan_pieces(matching.presence(s.of(category), t.of(category), ["guid"]), category, True), "plan")


# Order and retraction

@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), d AS (SELECT l_partkey AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
    n AS (SELECT 'supplier-' || s_suppkey AS guid, 2000000000 + s_suppkey AS rank, 2000000000 + s_suppkey AS m1, 0 AS m2, 0 AS later FROM supplier
    UNION ALL SELECT 'part-' || p_partkey, 1000000000 + p_partkey, coalesce(2000000000 + s, 1000000000 + p_partkey), 1000000000 + p_partkey, 0 FROM part LEFT JOIN d ON p = p_partkey
    UNION ALL SELECT 'orders-' || k, k, coalesce(2000000000 + max(s), k), coalesce(max_by(1000000000 + p, (s, p)), k), 1 FROM o LEFT JOIN lineitem ON l_orderkey = k LEFT JOIN d ON p = l_partkey GROUP BY k
    UNION ALL SELECT 'nation-' || n_nationkey, 3000000000 + n_nationkey, 9000000000, 3000000000 + n_nationkey, 0 FROM nation)
    SELECT guid, row_number() OVER (ORDER BY m1, m2, later, rank) - 1 AS place FROM n""")
def dependency_places(spark, sf):
    """Orders need their parts, parts their suppliers: the order in which ready pieces are taken by rank, here by kind and key.
    Nations form a cycle and come last."""
    kinds = (("orders", "o_orderkey", 0), ("part", "p_partkey", 1), ("supplier", "s_suppkey", 2), ("nation", "n_nationkey", 3))
    ranked = planning.union([read(spark, sf, t).select(name(t, k).alias("guid"), (C(k).cast("long") + i * 1_000_000_000).alias("rank")) for t, k, i in kinds])
    items = read(spark, sf, "lineitem")
    link = lambda a, b: items.select(a.alias("from_guid"), b.alias("to_guid"))
    ring = read(spark, sf, "nation").select(name("nation", "n_nationkey").alias("from_guid"), name("nation", (C("n_nationkey") + 1) % 25).alias("to_guid"))
    edges = planning.union([link(name("orders", "l_orderkey"), name("part", "l_partkey")), link(name("part", "l_partkey"), name("supplier", "l_suppkey")), ring])
    return closure.dependency_places(ranked, edges)


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice < 20000 AS bad, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prior FROM orders),
    f AS (SELECT k, prior, bad, coalesce(bool_or(bad) OVER (PARTITION BY c ORDER BY k), false) AS falls FROM o)
    SELECT 'orders-' || f.k AS source_guid, concat_ws(', ', CASE WHEN f.bad THEN 'bill-' || f.k END, CASE WHEN p.falls THEN 'orders-' || p.k END) AS detail FROM f LEFT JOIN f p ON f.prior = p.k WHERE f.falls""")
def retracted_chain(spark, sf):
    """Every order needs its customer's order before it, and a bill that small ones don't have: from the first small order of a
    customer on, all fall."""
    o = read(spark, sf, "orders")
    by = F.lag("o_orderkey").over(closure.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    own = stage(o.select(name("orders", "o_orderkey").alias("from_guid"), F.when(by.isNotNull(), F.concat(F.lit("orders-"), by.cast("string"))).alias("prior"), name("bill", "o_orderkey").alias("bill"), (C("o_totalprice") < 20000).alias("bad")), "orders")
    needs = own.where("prior IS NOT NULL").select("from_guid", C("prior").alias("to_guid")).union(own.select("from_guid", "bill"))
    target = own.where("NOT bad").select(C("bill").alias("guid"))
    return closure.retracted(needs, target, own.select(C("from_guid").alias("guid"))).select("source_guid", "detail")


_CLASSES = "classes AS (SELECT DISTINCT event_type AS e, user_id % 7 AS k, user_id AS u FROM events), lost AS (SELECT e, k, string_agg('phon-' || u, ', ' ORDER BY 'phon-' || u) AS why FROM classes WHERE k % 3 = 0 AND u % 3 = 0 GROUP BY ALL)"


@query(f"""WITH {_CLASSES},
    rules AS (SELECT event_id AS id, event_type AS e, user_id AS u, (SELECT lost.e FROM lost WHERE lost.e = event_type AND lost.k = user_id % 7) IS NOT NULL AS falls FROM events WHERE event_id % 3 = 0),
    needs AS (SELECT id, 'nc-' || e || '-' || u % 7 AS n FROM rules WHERE falls UNION ALL SELECT id, 'phon-' || u FROM rules WHERE u % 3 = 0 UNION ALL SELECT id, 'strat-click' FROM rules WHERE e = 'click'),
    rows AS (SELECT 'natural_classes' AS category, 'nc-' || e || '-' || k AS source_guid, why FROM (SELECT DISTINCT e, k FROM classes WHERE k % 3 = 0) LEFT JOIN lost USING (e, k)
    UNION ALL SELECT 'phonological_rules', 'rule-' || id, string_agg(n, ', ' ORDER BY n) FROM rules LEFT JOIN needs USING (id) GROUP BY id)
    SELECT category, CASE WHEN why IS NULL THEN 'ADD' ELSE 'SKIP' END AS verb, source_guid, why AS detail FROM rows""")
def run_needs_chain(spark, sf):
    """Rules also need the natural class of their sound: where a class falls for want of a phoneme, its rules fall too."""
    s, t = source_snapshot(spark, sf), target_snapshot(spark, sf)
    events = read(spark, sf, "events")
    more = _refs(events, "InputOS", name("rule", "event_id"), name("nc", "event_type", C("user_id") % 7))
    kinds = ("phonological_rules", "natural_classes", "phonemes", "strata")
    s = _snapshot(spark, s.of(*kinds), s.links("SegmentsRC", "StratumRA", "InputOS").unionByName(more))
    plan = run.plan_run(s, _snapshot(spark, t.of(*kinds)), Selection(frozenset({"phonological_rules", "natural_classes"})))
    return plan.where("reason IS DISTINCT FROM 'already_present_by_guid'").select("category", "verb", "source_guid", "detail")


# Facts, decisions and tags

def _customers(spark, sf, edited: bool) -> DataFrame:
    """Facts of all customers as entries: names by language, phones as a list, segments as a set, the nation's number."""
    c = read(spark, sf, "customer")
    c = c.where("c_custkey % 3 <> 0") if edited else c
    guid, half = name("entry", "c_custkey"), lambda a, b: a if edited else b
    return planning.union([
        _facts(c, guid, "Name", "map", ms=half(F.create_map(F.lit("en"), C("c_name"), F.lit("de"), F.lit("alt")), F.create_map(F.lit("en"), C("c_mktsegment"), F.lit("fr"), F.lit("neuf"))).cast(TEXTS)),
        _facts(c, guid, "Phones", "list", arr=half(F.array(name("tel", "c_custkey"), F.lit("0")), F.array(F.lit("1"), name("tel", "c_custkey")))),
        _facts(c, guid, "Segments", "set", arr=half(F.array(F.lit("z"), C("c_mktsegment")), F.array(C("c_mktsegment"), F.lit("z")))),
        _facts(c, guid, "Nation", "int", n=(C("c_nationkey") + half(F.lit(1), F.lit(0))).cast("long")),
        _facts(c, guid, "Mixed", half("str", "list"), **half({"s": C("c_mktsegment")}, {"arr": F.array("c_mktsegment")})),
    ])


def _entries(spark, sf, edited: bool) -> DataFrame:
    c = read(spark, sf, "customer")
    return _objects(c.where("c_custkey % 3 <> 0") if edited else c, "entry", "LexEntry", name("entry", "c_custkey"), ord=C("c_custkey"))


def _how(found: DataFrame) -> DataFrame:
    """Decisions by number of the piece: take, keep, merge, edit, skip."""
    k = F.regexp_extract("guid", "[0-9]+", 0).cast("long") % 5
    how = F.element_at(F.array(*map(F.lit, ("take_source", "keep_target", "merge", "edit_custom", "skip"))), (k + 1).cast("int"))
    return found.select("guid", "field", how.alias("resolution"), F.when(k == 3, "12").alias("custom_value"))


_LINE = "chr(10) || '--- merged GT-20260619-150000 ---' || chr(10)"
_TYPED = f"""c AS (SELECT *, c_custkey % 3 <> 0 AS there, c_custkey % 5 AS how FROM customer),
    v AS (SELECT c_custkey AS k, there, how, 'Name' AS field, '{{"en":"' || c_mktsegment || '","fr":"neuf"}}' AS r, '{{"de":"alt","en":"' || c_name || '"}}' AS l, '{{"de":"alt","en":"' || c_name || '\\n--- merged GT-20260619-150000 ---\\n' || c_mktsegment || '","fr":"neuf"}}' AS m, '{{"de":"12"}}' AS x FROM c
    UNION ALL SELECT c_custkey, there, how, 'Phones', '["1","tel-' || c_custkey || '"]', '["tel-' || c_custkey || '","0"]', '["tel-' || c_custkey || '","0","1"]', '["12"]' FROM c
    UNION ALL SELECT c_custkey, there, how, 'Segments', '["' || c_mktsegment || '","z"]', NULL, NULL, NULL FROM c
    UNION ALL SELECT c_custkey, there, how, 'Nation', c_nationkey::VARCHAR, (c_nationkey + 1)::VARCHAR, c_nationkey::VARCHAR, '12' FROM c
    UNION ALL SELECT c_custkey, there, how, 'Mixed', '["' || c_mktsegment || '"]', c_mktsegment, '''' || c_mktsegment || '''' || {_LINE} || '["' || c_mktsegment || '"]', '12' FROM c)"""


@query(f"""WITH {_TYPED} SELECT 'entry-' || k AS guid, field, CASE WHEN NOT there OR how = 0 OR l IS NULL THEN r WHEN how IN (1, 4) THEN l WHEN how = 2 THEN m ELSE x END AS value FROM v""")
def run_typed_values(spark, sf):
    """Facts of every type after a run with a decision on each conflict: lists and texts by language merge by their own rules."""
    s, t = _snapshot(spark, _entries(spark, sf, False), props=_customers(spark, sf, False)), _snapshot(spark, _entries(spark, sf, True), props=_customers(spark, sf, True))
    plan = _overwritten(s, t, "entry")
    done = apply.applied_snapshot(FIRST, plan, s, t, _how(conflicts.collected(plan, s, t)))
    return done.props.select("guid", "field", conflicts.plain("s", "n", "b", "arr", "ms"))


@query("""SELECT 'entry' AS category, count(*) FILTER (c_custkey % 3 = 0) AS added, count(*) FILTER (c_custkey % 3 <> 0) AS overwritten, 4 * count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 5 = 4) AS skipped, 0::BIGINT AS closure_pulled_in,
    4 * count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 5 = 4) AS interactive_skipped, 0::BIGINT AS failed, 4 * count(*) FILTER (c_custkey % 3 <> 0) AS interactive_resolved, 0::BIGINT AS carried_over FROM customer""")
def run_decided_report(spark, sf):
    """The report of that run: fields that a decision skipped are skips of their own."""
    s, t = _snapshot(spark, _entries(spark, sf, False), props=_customers(spark, sf, False)), _snapshot(spark, _entries(spark, sf, True), props=_customers(spark, sf, True))
    plan = _overwritten(s, t, "entry")
    done = apply.applied_snapshot(FIRST, plan, s, t, _how(conflicts.collected(plan, s, t)))
    return report.with_choices(report.by_outcome(done.outcomes), done.decided)


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 3 <> 0 AS there FROM customer)
    SELECT 'entry-' || k AS guid, 1 AS tags, 'GT-20260620-150000' AS run_id, CASE WHEN k % 5 = 0 THEN 0 ELSE 4 END AS carried, false AS prose FROM c WHERE there
    UNION ALL SELECT 'entry-' || k, 1, 'GT-20260620-150000', 0, false FROM c WHERE NOT there
    UNION ALL SELECT 'pos-' || n_nationkey, 2, 'GT-20260620-150000', 0, true FROM nation""")
def run_tags_of_two_runs(spark, sf):
    """Two runs in sequence, the second accepting the first's decisions: entries have the second's tag, with what they took over;
    parts of speech have both tags behind the prose that was there. Fields whose source was taken don't differ any more."""
    nations = _objects(read(spark, sf, "nation"), "pos", "PartOfSpeech", name("pos", "n_nationkey"))
    prose = nations.select("guid", F.lit("Prose.").alias("text"))
    s = _snapshot(spark, _entries(spark, sf, False).unionByName(nations), props=_customers(spark, sf, False))
    t = _snapshot(spark, _entries(spark, sf, True).unionByName(nations), props=_customers(spark, sf, True), tags=prose)
    plan = lambda target: stage(_overwritten(s, target, "entry").unionByName(_overwritten(s, target, "pos")), "plan")
    once = plan(t)
    open_how = _how(conflicts.collected(once, s, t)).withColumn("resolution", F.when(C("resolution") == "take_source", "take_source").otherwise("keep_target")).withColumn("custom_value", F.lit(None).cast("string"))
    first = apply.applied_snapshot(FIRST, once, s, t, open_how)
    between = _snapshot(spark, first.objects, first.refs, first.props, first.residue)
    second = apply.applied_snapshot(SECOND, plan(between), s, between, accept_priors=True)
    left, tag = second.residue.withColumn("tag", residue.parse(C("text"), "run_id", "merge")), C("tag")
    log = F.from_json(tag.merge, "array<struct<field:string,prior_run_id:string>>")
    carried = F.size(F.filter(F.coalesce(log, F.array().cast("array<struct<field:string,prior_run_id:string>>")), lambda d: d.prior_run_id == FIRST.run_id))
    return left.select("guid", (F.size(F.split("text", "GT\\|")) - 1).alias("tags"), tag.run_id.alias("run_id"), carried.alias("carried"), C("text").startswith("Prose.").alias("prose"))


# Outcomes, late references, writing systems

@query("""WITH c AS (SELECT DISTINCT event_type AS e, user_id % 7 AS k FROM events), l AS (SELECT DISTINCT event_type AS e, user_id % 7 AS k FROM events WHERE user_id % 3 = 0), u AS (SELECT DISTINCT user_id AS u FROM events)
    SELECT 'phonemes' AS category, 0::BIGINT AS added, count(*) FILTER (u % 3 <> 0) AS overwritten, 0::BIGINT AS skipped, count(*) FILTER (u % 3 = 0) AS failed FROM u
    UNION ALL SELECT 'natural_classes', count(*) FILTER (c.k % 3 = 0 AND l.k IS NULL), count(*) FILTER (c.k % 3 <> 0), 0, count(*) FILTER (c.k % 3 = 0 AND l.k IS NOT NULL) FROM c LEFT JOIN l USING (e, k)
    UNION ALL SELECT 'strata', count(DISTINCT event_type) FILTER (event_type = 'click'), count(DISTINCT event_type) FILTER (event_type <> 'click'), 0, 0 FROM events""")
def run_outcomes(spark, sf):
    """What became of a plan: without a phoneme set in the target no phoneme can be created, nor a class that needs one."""
    s, t = source_snapshot(spark, sf), target_snapshot(spark, sf)
    kinds = ("phonemes", "natural_classes", "strata")
    s, t = _snapshot(spark, s.of(*kinds), s.links("SegmentsRC")), _snapshot(spark, t.of(*kinds), t.links("SegmentsRC"))
    t = Snapshot(stage(t.objects.withColumn("owner_guid", F.lit(None).cast("string")), "objects"), t.refs, t.props, t.custom_fields)
    plan = run.plan_run(s, t, Selection(frozenset(kinds), overwrite=True))
    done = report.by_outcome(apply.applied_snapshot(FIRST, plan, s, t).outcomes)
    return done.select("category", "added", "overwritten", "skipped", "failed")


@query("""WITH c AS (SELECT c_custkey AS k, lead(c_custkey) OVER (ORDER BY c_custkey) AS n, c_custkey % 3 AS m FROM customer)
    SELECT 'first' AS run, 'waiting' AS state, 'entry-' || c.k AS from_guid, 'entry-' || c.n AS to_guid FROM c JOIN c d ON c.n = d.k WHERE c.m <> 0 AND d.m = 0
    UNION ALL SELECT 'first', 'linked', 'entry-' || c.k, 'entry-' || c.n FROM c JOIN c d ON c.n = d.k WHERE c.m <> 0 AND d.m <> 0
    UNION ALL SELECT 'second', 'linked', 'entry-' || k, 'entry-' || n FROM c WHERE n IS NOT NULL""")
def run_late_references(spark, sf):
    """Each entry refers to the next one. A first run brings two thirds of them, and what refers to the others waits; the second
    brings these."""
    s = _snapshot(spark, _entries(spark, sf, False), _refs(_next_customers(spark, sf), "ComponentLexemesRS", name("entry", "k"), name("entry", "n")))
    empty = _snapshot(spark, s.objects.where("false"))
    add = lambda where, target: planning.plan_pieces(matching.presence(s.objects.where(where), target.objects, ["guid"]), "entry")
    third = F.regexp_extract("guid", "[0-9]+", 0).cast("long") % 3 == 0
    first = apply.applied_snapshot(FIRST, add(~third, empty), s, empty)
    first = replace(first, objects=stage(first.objects, "objects"), refs=stage(first.refs, "refs"))
    again = Snapshot(first.objects, first.refs, s.props, s.custom_fields, None, stage(first.outbox, "outbox"))
    second = apply.applied_snapshot(SECOND, add(third, again), s, again)
    parts = [x.select(F.lit(r).alias("run"), F.lit(state).alias("state"), "from_guid", "to_guid") for r, d in (("first", first), ("second", second)) for state, x in (("linked", d.refs), ("waiting", d.outbox))]
    return planning.union(parts)


def _next_customers(spark, sf) -> DataFrame:
    """(k, n): each customer and the one of the next greater key, found in sorted ranges numbered one after the other."""
    at = closure.placed(read(spark, sf, "customer").select(C("c_custkey").cast("long").alias("k")), ["k"], "place")
    at = stage(at, "places")
    return at.join(at.select((C("place") - 1).alias("place"), C("k").alias("n")), "place").select("k", "n")


@query("""WITH d AS (SELECT doc_id AS k, CASE lang WHEN 'fr' THEN 'fra' ELSE lang END AS ws, lang, n_chars::VARCHAR AS n, doc_id % 4 = 0 AS two FROM documents)
    SELECT 'entry-' || k AS source_guid, CASE WHEN lang = 'de' AND NOT two THEN 'SKIP' ELSE 'ADD' END AS verb, CASE WHEN lang = 'de' AND NOT two THEN 'unmapped_ws_user_chose_skip' END AS reason,
        CASE WHEN lang = 'de' AND NOT two THEN NULL WHEN lang = 'de' THEN '{"en":"x"}' WHEN two AND ws < 'en' THEN '{"' || ws || '":"' || n || '","en":"x"}' WHEN two AND lang <> 'en' THEN '{"en":"x","' || ws || '":"' || n || '"}' ELSE '{"' || ws || '":"' || n || '"}' END AS texts FROM d""")
def run_writing_systems(spark, sf):
    """Documents as entries with a text in their language and every fourth one in English: French moves to another system, German
    is skipped, so entries that are German alone leave the plan."""
    d = read(spark, sf, "documents").where("doc_id IS NOT NULL")
    own = F.create_map(C("lang"), C("n_chars").cast("string"))
    texts = F.when((C("doc_id") % 4 == 0) & (C("lang") != "en"), F.map_concat(own, F.create_map(F.lit("en"), F.lit("x")))).otherwise(own)
    s = _snapshot(spark, _objects(d, "entry", "LexEntry", name("entry", "doc_id")), props=_facts(d, name("entry", "doc_id"), "Text", "map", ms=texts.cast(TEXTS)))
    systems = d.select(C("lang").alias("source_ws"), F.lit("vernacular").alias("kind")).distinct()
    choice = F.when(C("source_ws") == "de", "skip").when(C("source_ws") == "fr", "map").otherwise("create")
    choices = systems.select("source_ws", "kind", choice.alias("choice"), F.when(choice == "map", "fra").alias("target_ws"))
    mapping = wsmap.folded(_no(spark, "source_ws string, kind string, target_ws string, created boolean"), choices)
    skipped = choices.where("choice = 'skip'").select(C("source_ws").alias("ws_id"))
    empty = _snapshot(spark, s.objects.where("false"))
    plan = planning.plan_pieces(matching.presence(s.objects, empty.objects, ["guid"]), "entry")
    mute = wsmap.only_in_skipped(wsmap.texts_of(s.props), skipped).withColumn("detail", F.lit(None).cast("string"))
    plan = stage(planning.unresolved_skipped(plan, mute), "plan")
    mapped = Snapshot(s.objects, s.refs, stage(wsmap.in_target_systems(s.props, mapping, skipped), "mapped"), s.custom_fields)
    done = apply.applied_snapshot(FIRST, plan, mapped, empty)
    after = done.props.select(C("guid").alias("source_guid"), conflicts.plain("s", "n", "b", "arr", "ms").alias("texts"))
    return plan.select("source_guid", "verb", "reason").join(after, "source_guid", "left")


@query("""WITH u AS (SELECT DISTINCT l_partkey AS p FROM lineitem), a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem)
    SELECT 'pos' AS category, 'pos-' || n_nationkey AS source_guid, 'OVERWRITE' AS verb, 'pos-' || n_nationkey AS target_guid, 'guid' AS via FROM nation
    UNION ALL SELECT 'templates', 'tpl-' || s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN 'ADD' ELSE 'OVERWRITE' END, CASE WHEN s_suppkey % 3 = 0 THEN 't' ELSE '' END || 'tpl-' || s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'fingerprint' WHEN 1 THEN 'guid' ELSE 'none' END FROM supplier
    UNION ALL SELECT 'slots', 'slot-' || p, CASE WHEN p % 3 = 2 THEN 'ADD' ELSE 'OVERWRITE' END, CASE WHEN p % 3 = 0 THEN 't' ELSE '' END || 'slot-' || p, CASE p % 3 WHEN 0 THEN 'identity_remap' WHEN 1 THEN 'guid' ELSE 'none' END FROM u""")
def run_known_by_name(spark, sf):
    """A third of the templates stand in the target under other ids and are known by name and owner, a third of the slots by the ids
    that an earlier run gave them."""
    n, t, p = (read(spark, sf, x) for x in ("nation", "supplier", "part"))
    key = F.regexp_extract("guid", "[0-9]+", 0).cast("long")
    objects = planning.union([
        _objects(n, "pos", "PartOfSpeech", name("pos", "n_nationkey")),
        _objects(t, "templates", "MoInflAffixTemplate", name("tpl", "s_suppkey"), name("pos", "s_nationkey"), C("s_suppkey")),
        _objects(p, "slots", "MoInflAffixSlot", name("slot", "p_partkey"), name("pos", C("p_partkey") % 25), C("p_partkey")),
    ])
    links = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s = _snapshot(spark, objects, _refs(links, "PrefixSlotsRS", name("tpl", "l_suppkey"), name("slot", "l_partkey")), _facts(t, name("tpl", "s_suppkey"), "Name", "str", s=C("s_name")))
    moved = F.when((C("category") != "pos") & (key % 3 == 0), F.concat(F.lit("t"), C("guid"))).otherwise(C("guid"))
    there = s.objects.where((C("category") == "pos") | (key % 3 != 2)).withColumn("guid", moved)
    names = s.props.where(key % 3 != 2).withColumn("guid", F.when(key % 3 == 0, F.concat(F.lit("t"), C("guid"))).otherwise(C("guid")))
    target = _snapshot(spark, there, props=names)
    remembered = s.of("slots").where(key % 3 == 0).select(C("guid").alias("source_guid"), F.concat(F.lit("t"), C("guid")).alias("target_guid"))
    plan = run.plan_run(s, target, Selection(frozenset({"templates"}), overwrite=True, by_name=True), remembered=remembered)
    return plan.select("category", "source_guid", "verb", "target_guid", C("match_via").alias("via"))
