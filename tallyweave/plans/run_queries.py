"""Registered queries on whole snapshots: what a run plans and what it leaves behind, and the operators that only a run uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import residue, values
from tallyweave.model import APPLY_ORDER, CATEGORIES, RunContext, Selection
from tallyweave.operators import apply, closure, conflicts, layers, matching, planning, report, selection, wsmap
from tallyweave.plans import run
from tallyweave.plans.registry import query
from tallyweave.sources.lexicon import derived_pair, source_snapshot, staged_pair, target_snapshot
from tallyweave.sources.scratch import stage
from tallyweave.sources.snapshots import pieces, read, tree

RUN, TIME = "GT-20260619-150000", "2026-06-19T15:00:00"
C = F.col
CONTEXT = RunContext("src", "tgt", RUN, TIME)

#: The derived snapshots in SQL: items are allomorphs, m inflecting analyses with their slots on either side.
_MODEL = """items AS (SELECT l_orderkey AS k, l_linenumber AS n, min(o_custkey) AS c, min(l_suppkey) AS supp, min(l_returnflag) AS flag, min(l_linestatus) || (min(l_suppkey) % 10) AS form FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
    sl AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey)) AS has, coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_partkey % 3 <> 0)), []) AS kept FROM lineitem GROUP BY ALL),
    m AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 25 AS p, coalesce(has, []) AS has, coalesce(kept, []) AS kept FROM orders LEFT JOIN sl ON k = o_orderkey WHERE o_orderstatus <> 'P'),
    mm AS (SELECT s.k, s.c, min((t.k, 'tmsa-' || t.k))[2] AS t, count(t.k) > 1 AS several FROM m s LEFT JOIN m t ON s.c = t.c AND s.has = t.kept AND t.c % 3 <> 0 AND t.k % 5 <> 0 AND t.p % 4 <> 0 GROUP BY ALL),
    am AS (SELECT s.k, s.n, s.c, s.supp, min((t.k * 8 + t.n, 'tallo-' || t.k || '-' || t.n))[2] AS t, count(t.k) > 1 AS several FROM items s LEFT JOIN items t ON s.c = t.c AND s.form = t.form AND s.flag = t.flag AND t.flag <> 'R' AND t.c % 3 <> 0 AND t.k % 4 <> 1 GROUP BY ALL),
    q AS (SELECT DISTINCT c FROM m),
    env AS (SELECT supp, min(('entry-' || i.c, k * 8 + n, 'allo-' || k || '-' || n))[3] AS a FROM items i JOIN q ON q.c = i.c GROUP BY ALL)"""

#: Plan rows of the layer below all parts of speech: c category, v verb, g source, t target, w parents.
_LAYER = f"""{_MODEL},
    layer AS (SELECT 'entry' AS c, CASE WHEN c % 3 <> 0 THEN 'OVERWRITE' ELSE 'ADD' END AS v, 'entry-' || c AS g, 'entry-' || c AS t, 'pos-' || c % 25 AS w FROM q
    UNION ALL SELECT 'sense', CASE WHEN c % 3 <> 0 THEN 'OVERWRITE' ELSE 'ADD' END, 'sense-' || k, 'sense-' || k, 'entry-' || c FROM m
    UNION ALL SELECT 'msa', CASE WHEN t IS NULL THEN 'ADD' ELSE 'OVERWRITE' END, 'msa-' || k, coalesce(t, 'msa-' || k), 'sense-' || k FROM mm
    UNION ALL SELECT 'allomorph', CASE WHEN t IS NULL THEN 'ADD' ELSE 'OVERWRITE' END, 'allo-' || k || '-' || n, coalesce(t, 'allo-' || k || '-' || n), 'entry-' || c FROM am WHERE c IN (SELECT c FROM q)
    UNION ALL SELECT 'ph_environment', CASE WHEN supp % 3 <> 0 THEN 'OVERWRITE' ELSE 'ADD' END, 'env-' || supp, 'env-' || supp, a FROM env)"""


# What lies below a part of speech

@query(f"""WITH {_MODEL} SELECT 'entry-' || c AS entry, 'pos-' || p AS pos, count(*) AS senses FROM m WHERE p % 2 = 1 GROUP BY ALL""")
def layer_qualified_entries(spark, sf):
    """Entries with senses whose analysis inflects and points at an odd part of speech."""
    s = source_snapshot(spark, sf)
    odd = s.of("pos").where(F.regexp_extract("guid", "[0-9]+", 0).cast("int") % 2 == 1)
    return layers.analysed_senses(s, odd).groupBy("entry", "pos").agg(F.count("*").alias("senses"))


@query(f"""WITH {_LAYER} SELECT c AS category, v AS verb, g AS source_guid, t AS target_guid, w AS pulled_in_by FROM layer""")
def closure_layer_plan(spark, sf):
    """Closure below all parts of speech, overwriting; slots alone are selected."""
    s, t = derived_pair(spark, sf)
    plan = layers.plan_layer(s, t, s.of("pos"), Selection(frozenset({"slots"}), overwrite=True))
    return plan.select("category", "verb", "source_guid", "target_guid", F.array_join("pulled_in_by", ",").alias("pulled_in_by"))


@query(f"""WITH {_MODEL} SELECT 'msa-' || k AS guid, t AS target_guid, several AS ambiguous FROM mm""")
def msa_within_entry(spark, sf):
    s, t = derived_pair(spark, sf)
    return layers.within_entry(layers.msa_prints(s), layers.msa_prints(t)).select("guid", "target_guid", "ambiguous")


@query(f"""WITH {_MODEL} SELECT 'allo-' || k || '-' || n AS guid, t AS target_guid, several AS ambiguous FROM am""")
def allomorph_within_entry(spark, sf):
    s, t = derived_pair(spark, sf)
    return layers.within_entry(layers.allomorph_prints(s), layers.allomorph_prints(t), layers.ALIKE).select("guid", "target_guid", "ambiguous")


# Dependencies and collections

_EDGES = """edges AS (SELECT 'variant_types' AS fc, 'var-' || doc_id AS f, 'inflection_features' AS tc, 'val-quality-' || quality AS t, 'InflFeatsOA' AS field FROM labels WHERE quality IS NOT NULL
    UNION ALL SELECT 'variant_types', 'var-' || doc_id, 'inflection_features', 'val-toxic-' || toxic, 'InflFeatsOA' FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL
    UNION ALL SELECT DISTINCT 'natural_classes', 'nc-' || event_type || '-' || user_id % 7, 'phonemes', 'phon-' || user_id, 'SegmentsRC' FROM events
    UNION ALL SELECT 'phonological_rules', 'rule-' || event_id, 'strata', 'strat-' || event_type, 'StratumRA' FROM events
    UNION ALL SELECT 'phonological_rules', 'rule-' || event_id, 'phonemes', 'phon-' || user_id, 'InputOS' FROM events)"""


@query(f"""WITH {_EDGES} SELECT fc AS from_cat, f AS from_guid, tc AS to_cat, t AS to_guid, field FROM edges""")
def dependency_edges(spark, sf):
    return layers.dependency_edges(source_snapshot(spark, sf)).drop("ord")


@query("""SELECT DISTINCT 'stem-' || c_nationkey || '-' || c_mktsegment AS guid, 'pos-' || c_nationkey AS owner_guid FROM customer""")
def stem_names_flattened(spark, sf):
    return layers.owned_values(source_snapshot(spark, sf), "stem_names", "pos").select("guid", "owner_guid")


@query("""SELECT DISTINCT 'pos-' || doc_id % 25 AS owner, 'val-quality-' || quality AS value FROM labels WHERE quality IS NOT NULL""")
def exception_features_flattened(spark, sf):
    return layers.wired_pairs(source_snapshot(spark, sf), "pos", "ExceptionFeaturesOC")


@query("""SELECT DISTINCT (['LexEntry', 'LexSense', 'LexExampleSentence', 'MoForm'])[user_id % 5 + 1] AS owner_class, 'field-' || user_id % 40 AS name FROM events WHERE user_id % 5 < 4""")
def custom_fields_scanned(spark, sf):
    """Fields of one more class aren't scanned."""
    return selection.scanned_fields(source_snapshot(spark, sf).custom_fields).select("owner_class", "name")


@query("""SELECT 'templates' AS category, count(*) AS pieces FROM supplier UNION ALL SELECT 'phonemes', count(DISTINCT user_id) FROM events UNION ALL SELECT 'strata', count(DISTINCT event_type) FROM events
    UNION ALL SELECT 'ph_environment', count(*) FROM supplier UNION ALL SELECT 'phonological_rules', count(*) FROM events""")
def scans_by_category(spark, sf):
    scanned = selection.selected(source_snapshot(spark, sf).objects, ["templates", "phonemes", "strata", "ph_environment", "phonological_rules", "complex_form_types"])
    return scanned.groupBy("category").agg(F.count("*").alias("pieces"))


@query("""SELECT 'nation-' || n_nationkey AS guid, 0 AS depth, 'nation-' || n_nationkey AS root FROM nation WHERE n_regionkey <> 2
    UNION ALL SELECT 'customer-' || c_custkey, 1, 'nation-' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2
    UNION ALL SELECT 'orders-' || o_orderkey, 2, 'nation-' || n_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2""")
def closure_rooted_lists(spark, sf):
    """Nations of all regions but one as lists of possibilities, walked from their roots."""
    return closure.rooted(tree(spark, sf).select("guid", "owner_guid"), pieces(spark, sf, "nation").where("n_regionkey <> 2").select("guid"))


# Plans

_VERTICAL = """pt AS (SELECT n_nationkey AS n FROM nation), tt AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
    ts AS (SELECT DISTINCT l_partkey AS p, min('tpl-' || l_suppkey) OVER (PARTITION BY l_partkey) AS t FROM lineitem)"""
_REASON = "CASE v WHEN 'SKIP' THEN 'already_present_by_guid' END"
_RUN = f"""{_LAYER}, {_EDGES}, {_VERTICAL},
    rows AS (SELECT 'pos' AS c, CASE WHEN n % 4 <> 0 THEN 'SKIP' ELSE 'ADD' END AS v, 'pos-' || n AS g, 'pos-' || n AS w FROM pt
    UNION ALL SELECT 'templates', CASE WHEN k % 3 <> 0 AND n % 4 <> 0 THEN 'SKIP' WHEN k % 3 <> 0 THEN 'SKIP' ELSE 'ADD' END, 'tpl-' || k, 'pos-' || n FROM tt
    UNION ALL SELECT 'slots', CASE WHEN p % 3 <> 0 THEN 'SKIP' ELSE 'ADD' END, 'slot-' || p, '' FROM ts
    UNION ALL SELECT 'natural_classes', CASE WHEN k % 3 <> 0 THEN 'SKIP' ELSE 'ADD' END, 'nc-' || e || '-' || k, '' FROM (SELECT DISTINCT event_type AS e, user_id % 7 AS k FROM events)
    UNION ALL SELECT 'phonological_rules', CASE WHEN event_id % 3 <> 0 THEN 'SKIP' ELSE 'ADD' END, 'rule-' || event_id, '' FROM events
    UNION ALL SELECT 'variant_types', CASE WHEN doc_id % 3 <> 0 THEN 'SKIP' ELSE 'ADD' END, 'var-' || doc_id, '' FROM labels WHERE toxic IS DISTINCT FROM 1
    UNION ALL SELECT 'stem_names', CASE WHEN n % 4 <> 0 AND n % 3 <> 0 THEN 'SKIP' ELSE 'ADD' END, 'stem-' || n || '-' || s, '' FROM (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer)
    UNION ALL SELECT c, CASE WHEN v = 'OVERWRITE' THEN 'SKIP' ELSE v END, g, w FROM layer),
    lacks AS (SELECT f, string_agg(DISTINCT t, ', ' ORDER BY t) AS why FROM edges WHERE t LIKE 'phon-%' AND split_part(t, '-', 2)::BIGINT % 3 = 0 OR t IN ('strat-click', 'val-quality-1') GROUP BY f),
    p AS (SELECT c, CASE WHEN v = 'ADD' AND why IS NOT NULL THEN 'SKIP' ELSE v END AS v, CASE WHEN v = 'ADD' AND why IS NOT NULL THEN 'dependency_unresolved' WHEN v <> 'SKIP' THEN NULL WHEN c IN ('msa', 'allomorph') THEN 'already_present_by_identity' ELSE 'already_present_by_guid' END AS r,
        CASE WHEN v = 'ADD' THEN why END AS d, g, w FROM rows LEFT JOIN lacks ON f = g
    UNION ALL SELECT 'variant_types', 'SKIP', 'gold_inviolable', NULL, 'var-' || doc_id, '' FROM labels WHERE toxic = 1
    UNION ALL SELECT 'custom_fields', 'SKIP', CASE WHEN n % 3 <> 0 THEN 'already_present_by_identity' ELSE 'needs_manual' END, NULL, 'cf:' || o || ':field-' || n, ''
        FROM (SELECT DISTINCT (['LexEntry', 'LexSense', 'LexExampleSentence', 'MoForm'])[user_id % 5 + 1] AS o, user_id % 40 AS n FROM events WHERE user_id % 5 < 4)
    UNION ALL SELECT 'exception_features', CASE WHEN n % 4 <> 0 AND q <> 1 THEN 'SKIP' ELSE 'ADD' END, CASE WHEN n % 4 <> 0 AND q <> 1 THEN 'already_present_by_guid' END, NULL, 'pos-' || n || '::val-quality-' || q, ''
        FROM (SELECT DISTINCT doc_id % 25 AS n, quality AS q FROM labels WHERE quality IS NOT NULL))"""
CHOSEN = frozenset({"slots", "natural_classes", "phonological_rules", "variant_types", "stem_names", "custom_fields", "exception_features"})


@query(f"""WITH {_RUN} SELECT c AS category, v AS verb, g AS source_guid, r AS reason, CASE WHEN r = 'dependency_unresolved' THEN d END AS missing, w AS pulled_in_by FROM p""")
def run_plan(spark, sf):
    """A whole run without overwriting: closure pulls in what slots need, and pieces whose needs aren't met are skipped."""
    s, t = derived_pair(spark, sf)
    plan = run.plan_run(s, t, Selection(CHOSEN))
    missing = F.when(C("reason") == "dependency_unresolved", C("detail"))
    return plan.select("category", "verb", "source_guid", "reason", missing.alias("missing"), F.array_join("pulled_in_by", ",").alias("pulled_in_by"))


@query(f"""WITH {_RUN} SELECT c AS category, count(*) FILTER (v = 'ADD') AS added, 0::BIGINT AS overwritten, count(*) FILTER (v = 'SKIP') AS skipped, count(*) FILTER (v = 'ADD' AND w <> '') AS closure_pulled_in,
    0::BIGINT AS interactive_skipped, 0::BIGINT AS interactive_resolved, 0::BIGINT AS ws_mapped, 0::BIGINT AS ws_created, 0::BIGINT AS ws_skipped FROM p GROUP BY ALL""")
def run_report(spark, sf):
    """The report of that run, with the counters that nothing adds to."""
    s, t = derived_pair(spark, sf)
    return report.with_unused(report.by_category(run.plan_run(s, t, Selection(CHOSEN))))


# What a run leaves behind

MOVED = frozenset({"slots", "phonemes", "natural_classes", "phonological_rules", "strata", "inflection_features", "exception_features"})


_STEPS = "[" + ", ".join(f"'{c}'" for c in APPLY_ORDER) + "]"
_PLACES = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


@query(f"""WITH {_RUN} SELECT list_position({_STEPS}, c)::BIGINT AS step, c AS category, v AS verb, count(*) AS pieces FROM p GROUP BY ALL""")
def run_steps(spark, sf):
    """The same run by the steps in which it is carried out."""
    s, t = derived_pair(spark, sf)
    return report.by_step(run.plan_run(s, t, Selection(CHOSEN)))


@query(f"""WITH {_RUN} SELECT c AS category, g AS source_guid, r AS reason, row_number() OVER (ORDER BY coalesce(list_position({_PLACES}, c), 99), g, r) - 1 AS place FROM p WHERE v = 'SKIP'""")
def run_skips_in_order(spark, sf):
    """Its skips by category in order of declaration, id and reason, each with its place."""
    s, t = derived_pair(spark, sf)
    return report.placed_skips(run.plan_run(s, t, Selection(CHOSEN))).select("category", "source_guid", "reason", "place")


def _planned(spark, sf, pair=derived_pair):
    s, t = pair(spark, sf)
    return s, t, stage(run.plan_run(s, t, Selection(MOVED, overwrite=True)), "plan")


def _decisions(found):
    """Entries' conflicts decided in turn: take, keep, merge, edit."""
    k = F.regexp_extract("guid", "[0-9]+", 0).cast("int") % 4
    how = F.when(k == 0, "take_source").when(k == 1, "keep_target").when(k == 2, "merge").otherwise("edit_custom")
    return found.select("guid", "field", how.alias("resolution"), F.when(k == 3, "by hand").alias("custom_value"))


def _moved(spark, sf, decided=False):
    """Applying reads all tables of both sides many times, so they are written once."""
    s, t, plan = _planned(spark, sf, staged_pair)
    return t, apply.applied_snapshot(CONTEXT, plan, s, t, _decisions(conflicts.collected(plan, s, t)) if decided else None)


_NEW = "'new-' || substr(sha256('GT-20260619-150000|' || {}), 1, 32)"
_MSA, _ALLO = _NEW.format("'msa-' || k"), _NEW.format("'allo-' || k || '-' || n")
_AFTER = f"""{_LAYER}, nm AS (SELECT k, c, coalesce(t, {_MSA}) AS id, t IS NULL AS fresh FROM mm), na AS (SELECT k, n, c, supp, {_ALLO} AS id FROM am WHERE t IS NULL AND c IN (SELECT c FROM q)),
    one AS (SELECT c, min((k * 8 + n, 'allo-' || k || '-' || n))[1] AS o FROM na WHERE c NOT IN (SELECT c FROM items WHERE c % 3 <> 0 AND k % 4 <> 1) GROUP BY c)"""


@query(f"""WITH {_AFTER} SELECT 'pos-' || n_nationkey AS guid, 'pos' AS category, NULL AS owner_guid, NULL AS owner_field FROM nation WHERE n_nationkey % 4 = 0
    UNION ALL SELECT 'tpl-' || s_suppkey, 'templates', 'pos-' || s_nationkey, NULL FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT DISTINCT 'slot-' || l_partkey, 'slots', 'pos-' || l_partkey % 25, NULL FROM lineitem WHERE l_partkey % 3 = 0
    UNION ALL SELECT 'entry-' || c, 'entry', NULL, NULL FROM q WHERE c % 3 = 0 UNION ALL SELECT 'sense-' || k, 'sense', 'entry-' || c, NULL FROM m WHERE c % 3 = 0
    UNION ALL SELECT id, 'msa', 'entry-' || c, NULL FROM nm WHERE fresh
    UNION ALL SELECT id, 'allomorph', 'entry-' || na.c, CASE WHEN o IS NOT DISTINCT FROM k * 8 + n THEN 'LexemeFormOA' ELSE 'AlternateFormsOS' END FROM na LEFT JOIN one ON one.c = na.c
    UNION ALL SELECT 'env-' || supp, 'ph_environment', NULL, NULL FROM env WHERE supp % 3 = 0 UNION ALL SELECT 'strat-click', 'strata', NULL, NULL
    UNION ALL SELECT DISTINCT 'phon-' || user_id, 'phonemes', 'phset-1', NULL FROM events WHERE user_id % 3 = 0
    UNION ALL SELECT DISTINCT 'nc-' || event_type || '-' || user_id % 7, 'natural_classes', NULL, NULL FROM events WHERE user_id % 7 % 3 = 0
    UNION ALL SELECT 'rule-' || event_id, 'phonological_rules', NULL, NULL FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'val-quality-1', 'inflection_features', 'feat-quality', NULL""")
def run_created(spark, sf):
    """What a run creates: new ids for analyses and allomorphs, owners kept, phonemes in the first set of the target."""
    t, done = _moved(spark, sf)
    return done.objects.join(t.objects.select("guid"), "guid", "left_anti").select("guid", "category", "owner_guid", "owner_field")


@query(f"""WITH {_AFTER}, l AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem), tm AS (SELECT o_orderkey AS k, o_custkey % 25 AS p FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0),
    ti AS (SELECT * FROM items WHERE c % 3 <> 0 AND k % 4 <> 1), v AS (SELECT DISTINCT doc_id % 25 AS n, quality AS q FROM labels WHERE quality IS NOT NULL)
    SELECT DISTINCT (['PrefixSlotsRS', 'SuffixSlotsRS', 'ProcliticSlotsRS', 'EncliticSlotsRS'])[l_partkey % 4 + 1] AS field, 'tpl-' || l_suppkey AS from_guid, 'slot-' || l_partkey AS to_guid FROM lineitem
    UNION ALL SELECT 'SlotsRC', id, 'slot-' || p FROM nm JOIN l USING (k) GROUP BY id, p UNION ALL SELECT 'SlotsRC', 'tmsa-' || k, 'slot-' || l.p FROM tm JOIN l USING (k) WHERE l.p % 3 <> 0 AND 'tmsa-' || k NOT IN (SELECT id FROM nm)
    UNION ALL SELECT 'PartOfSpeechRA', id, 'pos-' || c % 25 FROM nm WHERE fresh UNION ALL SELECT 'PartOfSpeechRA', 'tmsa-' || k, 'pos-' || p FROM tm WHERE p % 4 <> 0
    UNION ALL SELECT 'MorphoSyntaxAnalysisRA', 'sense-' || k, id FROM nm WHERE c % 3 = 0 UNION ALL SELECT 'MorphoSyntaxAnalysisRA', 'sense-' || k, 'tmsa-' || k FROM tm
    UNION ALL SELECT 'PhoneEnvRC', id, 'env-' || supp FROM na UNION ALL SELECT 'PhoneEnvRC', 'tallo-' || k || '-' || n, 'env-' || supp FROM ti WHERE supp % 3 <> 0
    UNION ALL SELECT 'MorphTypeRA', id, 'mt-' || flag FROM na JOIN items USING (k, n) WHERE flag <> 'R' UNION ALL SELECT 'MorphTypeRA', 'tallo-' || k || '-' || n, 'mt-' || flag FROM ti WHERE flag <> 'R'
    UNION ALL SELECT DISTINCT 'SegmentsRC', 'nc-' || event_type || '-' || user_id % 7, 'phon-' || user_id FROM events WHERE user_id % 7 % 3 = 0 OR user_id % 3 <> 0
    UNION ALL SELECT 'StratumRA', 'rule-' || event_id, 'strat-' || event_type FROM events WHERE event_id % 3 = 0 OR event_type <> 'click'
    UNION ALL SELECT 'InputOS', 'rule-' || event_id, 'phon-' || user_id FROM events WHERE event_id % 3 = 0 OR user_id % 3 <> 0
    UNION ALL SELECT 'InflFeatsOA', 'var-' || doc_id, 'val-quality-' || quality FROM labels WHERE doc_id % 3 <> 0 AND quality <> 1
    UNION ALL SELECT 'InflFeatsOA', 'var-' || doc_id, 'val-toxic-' || toxic FROM labels WHERE doc_id % 3 <> 0 AND quality IS NOT NULL AND toxic IS NOT NULL
    UNION ALL SELECT 'ExceptionFeaturesOC', 'pos-' || n, 'val-quality-' || q FROM v""")
def run_refs(spark, sf):
    """All references after a run: rewired to new ids, slots of overwritten analyses replaced, memberships completed."""
    return _moved(spark, sf)[1].refs.select("field", "from_guid", "to_guid")


@query(f"""WITH {_AFTER} SELECT 'msa-' || k AS source_guid, id AS target_guid FROM nm UNION ALL SELECT 'allo-' || k || '-' || n, coalesce(t, {_ALLO}) FROM am WHERE c IN (SELECT c FROM q)""")
def run_remap(spark, sf):
    return apply.plan_remap(_planned(spark, sf)[2], RUN)


_ASKED = f"""{_MODEL}, asked AS (SELECT c_custkey AS c, c_mktsegment AS seg, (['take_source', 'keep_target', 'merge', 'edit_custom'])[c_custkey % 4 + 1] AS how FROM customer WHERE c_custkey IN (SELECT c FROM q) AND c_custkey % 3 <> 0 AND c_custkey % 5 = 0 AND c_mktsegment <> 'EDITED')"""


@query(f"""WITH {_ASKED} SELECT 'entry-' || c AS guid, 'CustomSegment' AS field, 'EDITED' AS left_value, seg AS right_value FROM asked""")
def run_conflicts(spark, sf):
    """Conflicts of what a run overwrites, in the categories that are asked about."""
    s, t, plan = _planned(spark, sf)
    return conflicts.collected(plan, s, t).select("guid", "field", "left_value", "right_value")


@query(f"""WITH {_ASKED} SELECT 'entry-' || c_custkey AS guid, CASE WHEN c_custkey IN (SELECT c FROM asked) THEN CASE how WHEN 'keep_target' THEN 'EDITED' WHEN 'merge' THEN 'EDITED' || chr(10) || '--- merged GT-20260619-150000 ---' || chr(10) || c_mktsegment WHEN 'edit_custom' THEN 'by hand' ELSE c_mktsegment END
        WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 AND c_custkey NOT IN (SELECT c FROM q) THEN 'EDITED' ELSE c_mktsegment END AS segment FROM customer LEFT JOIN asked ON c = c_custkey WHERE c_custkey % 3 <> 0 OR c_custkey IN (SELECT c FROM q)""")
def run_decided_values(spark, sf):
    """Segments of all entries after a run with decisions on every conflict."""
    return _moved(spark, sf, True)[1].props.where("field = 'CustomSegment'").select("guid", C("s").alias("segment"))


@query(f"""WITH {_ASKED}, e AS (SELECT c, seg, how FROM q LEFT JOIN asked USING (c))
    SELECT 'entry-' || c AS guid, 'src' AS source, CASE WHEN c % 3 <> 0 THEN CASE WHEN c % 5 = 0 THEN 'EDITED' ELSE c_mktsegment END END AS snapshot, how AS resolution FROM e JOIN customer ON c_custkey = c""")
def run_tags(spark, sf):
    """Tags of all touched entries, read back: overwritten ones hold the values before and the decisions."""
    tags = _moved(spark, sf, True)[1].residue.where("guid LIKE 'entry-%'").select("guid", residue.parse(C("text")).alias("p"))
    log = F.from_json("p.merge", "array<struct<field:string,resolution:string>>")[0]
    return tags.select("guid", "p.source", F.get_json_object("p.snap", "$.CustomSegment").alias("snapshot"), log.resolution.alias("resolution"))


@query("""SELECT field, severity, count(*) AS refs FROM (SELECT 'SegmentsRC' AS field, 'fatal' AS severity FROM (SELECT DISTINCT event_type, user_id FROM events WHERE user_id % 3 = 0)
    UNION ALL SELECT 'StratumRA', 'ignored' FROM events WHERE event_type = 'click'
    UNION ALL SELECT 'MorphTypeRA', 'warning' FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING min(l_returnflag) = 'R')) GROUP BY ALL""")
def refs_by_severity(spark, sf):
    """References of the source that the target alone couldn't hold, by what that means for their piece."""
    s, t = source_snapshot(spark, sf), target_snapshot(spark, sf)
    notes = apply.unmatched(s.links("SegmentsRC", "StratumRA", "MorphTypeRA"), t.objects)
    return notes.groupBy("field", "severity").agg(F.count("*").alias("refs"))


# Operators that a run uses

@query("""WITH b AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'int' WHEN event_id % 4 = 1 THEN 'str' ELSE 'float' END AS lt, CASE WHEN event_id % 3 = 0 THEN 'int' WHEN event_id % 3 = 1 THEN 'str' ELSE 'list' END AS rt, event_type AS l, user_id::VARCHAR AS r FROM events)
    SELECT event_id::VARCHAR AS guid, CASE WHEN lt = 'int' OR rt = 'int' THEN r WHEN lt = 'str' AND rt = 'str' THEN l || chr(10) || '--- merged GT-20260619-150000 ---' || chr(10) || r
        ELSE CASE WHEN lt = 'str' THEN '''' || l || '''' ELSE l END || chr(10) || '--- merged GT-20260619-150000 ---' || chr(10) || CASE WHEN rt = 'str' THEN '''' || r || '''' ELSE r END END AS value FROM b""")
def merge_mixed(spark, sf):
    """Types of both sides vary: texts merge, other mergeable pairs are quoted, scalars take the source's."""
    k = C("event_id")
    both = read(spark, sf, "events").select(
        k.cast("string").alias("guid"), F.lit("f").alias("field"), F.when(k % 4 == 0, "int").when(k % 4 == 1, "str").otherwise("float").alias("left_type"),
        F.when(k % 3 == 0, "int").when(k % 3 == 1, "str").otherwise("list").alias("right_type"), C("event_type").alias("left_value"), C("user_id").cast("string").alias("right_value"),
    )
    return conflicts.merged_any(both, RUN).select("guid", "value")


@query("""WITH d AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS e FROM events GROUP BY ALL), c AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0)
    SELECT c.user_id::VARCHAR AS guid, c.event_type AS field, CASE WHEN d.user_id % 3 <> 0 THEN e::VARCHAR END AS prior FROM c LEFT JOIN d USING (user_id, event_type)""")
def conflicts_with_prior(spark, sf):
    """Open fields with the last decision that an earlier run made on them, if any."""
    e = read(spark, sf, "events").withColumn("guid", C("user_id").cast("string")).withColumn("field", C("event_type"))
    log = e.where("user_id % 3 <> 0").select("guid", "field", C("event_id").cast("string").alias("resolution"), "ts", C("event_id").alias("seq"))
    return conflicts.with_prior(e.where("event_id % 2 = 0").select("guid", "field").distinct(), conflicts.latest_decisions(log))


@query("""WITH a AS (SELECT doc_id, doc_id % 3 <> 0 AS a, doc_id % 5 <> 0 AS b FROM documents)
    SELECT doc_id::VARCHAR AS guid, 'Comment' AS field, CASE WHEN a THEN 'keep_target' ELSE 'merge' END AS resolution, 'GT-20260619-150000' AS prior_run_id FROM a WHERE (a OR b) AND doc_id % 4 <> 0""")
def prior_from_tags(spark, sf):
    """Logs written into tags on two carriers and read back: carrier A goes before B; accepted for open conflicts."""
    d = read(spark, sf, "documents").select(C("doc_id").cast("string").alias("guid"), "doc_id")

    def tags(rows, carrier, how):
        log = conflicts.decision_log(rows.select("guid", F.lit("Comment").alias("field"), F.lit(how).alias("resolution"), F.lit(None).cast("string").alias("custom_value")))
        tag = residue.serialize(F.lit(RUN), F.lit("src"), F.lit(TIME), None, C("log"))
        kind = "LexEntry" if carrier == "A" else "PartOfSpeech"
        return log.select("guid", F.lit(carrier).alias("carrier"), F.lit(1).alias("seq"), residue.carry(F.lit("Prose."), F.lit(kind), tag).alias("text"))

    both = tags(d.where("doc_id % 3 <> 0"), "A", "keep_target").unionByName(tags(d.where("doc_id % 5 <> 0"), "B", "merge"))
    asked = d.where("doc_id % 4 <> 0").select("guid", F.lit("Comment").alias("field"))
    return conflicts.accepted_priors(asked, conflicts.prior_decisions(both)).drop("custom_value")


@query("""SELECT 'SKIP' AS verb, 'customer-' || c_custkey AS source_guid, 'interactive_skip' AS reason, 'c_mktsegment' AS detail FROM customer WHERE c_custkey % 4 = 0""")
def interactive_skips(spark, sf):
    found = pieces(spark, sf, "customer").select("guid", F.lit("c_mktsegment").alias("field"), F.lit("x").alias("left_value"), C("c_mktsegment").alias("right_value"), F.lit(True).alias("eligible"), "c_custkey")
    how = found.select("guid", "field", F.when(C("c_custkey") % 4 == 0, "skip").otherwise("take_source").alias("resolution"), F.lit(None).cast("string").alias("custom_value"))
    return conflicts.interactive_skips(conflicts.apply_decisions(found.drop("c_custkey"), how, RUN))


@query("""SELECT 'templates' AS category, 'supplier-' || arg_min(s_suppkey, -s_acctbal) AS source_guid FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT 'pos', 'nation-' || min(n_nationkey) FROM nation WHERE n_nationkey % 3 = 0""")
def first_in_plan(spark, sf):
    """The first template and part of speech that a plan adds; templates by balance, richest first."""
    def plan(name, category, order):
        own = pieces(spark, sf, name).withColumn("present", ~C("guid").rlike("x"))
        key = F.regexp_extract("guid", "[0-9]+", 0).cast("int")
        return planning.plan_pieces(own.withColumn("present", key % 3 != 0), category).join(own.select(C("guid").alias("source_guid"), order.alias("ord")), "source_guid")

    both = (("supplier", "templates", -C("s_acctbal")), ("nation", "pos", C("n_nationkey").cast("double")))
    return planning.union([planning.first_planned(plan(*x), x[1]).select(F.lit(x[1]).alias("category"), "source_guid") for x in both])


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS slot, l_partkey AS affix FROM lineitem), a AS (SELECT DISTINCT affix FROM p JOIN supplier ON s_suppkey = slot WHERE s_nationkey % 10 = 3)
    SELECT 'affix' AS kind, affix AS id FROM a UNION ALL SELECT DISTINCT 'template', s_nationkey::BIGINT FROM supplier WHERE s_nationkey % 10 = 3 UNION ALL SELECT 'known', s_nationkey::BIGINT FROM supplier GROUP BY ALL""")
def selection_from_picks(spark, sf):
    """Checked templates require their slots' affixes, and turn their category on."""
    slots = read(spark, sf, "supplier").select(C("s_nationkey").cast("long").alias("template"), C("s_suppkey").alias("slot"))
    bound = read(spark, sf, "lineitem").select(C("l_suppkey").alias("slot"), C("l_partkey").alias("affix")).distinct()
    picks = read(spark, sf, "nation").where("n_nationkey % 10 = 3").select(F.lit("template").alias("level"), C("n_nationkey").cast("long").alias("guid"))
    chosen, affixes, templates = selection.build_selection(slots, bound, bound.select("affix").where("false"), picks)
    assert chosen.on("templates") == (not templates.isEmpty())
    known = selection.all_templates(slots).select(F.lit("known").alias("kind"), C("template").alias("id"))
    return affixes.select(F.lit("affix").alias("kind"), C("affix").alias("id")).union(templates.select(F.lit("template"), "template")).union(known)


@query("""SELECT s_nationkey::BIGINT AS name, count(*) AS alike FROM supplier GROUP BY ALL""")
def fingerprint_names(spark, sf):
    """Suppliers told apart by one name each: how many print alike."""
    own = read(spark, sf, "supplier").select(long_of("s_nationkey").alias("name"), values.FINGERPRINTS["slots"](C("s_nationkey")).alias("fp"))
    return own.groupBy("fp").agg(F.min("name").alias("name"), F.count("*").alias("alike")).drop("fp")


def long_of(c):
    return C(c).cast("long")


@query("""SELECT row_number() OVER (ORDER BY CASE event_type WHEN 'click' THEN 9 WHEN 'view' THEN 3 WHEN 'purchase' THEN 18 WHEN 'signup' THEN 21 ELSE 23 END) AS step, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY ALL)""")
def apply_order_of_plan(spark, sf):
    """Counts of a plan in the fixed order of application; event types stand for categories."""
    named = {"click": "pos", "view": "phonemes", "purchase": "entry", "signup": "allomorph"}
    category = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in named.items() for x in p)), C("event_type")), F.lit("templates"))
    counts = read(spark, sf, "events").groupBy(category.alias("category")).agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, APPLY_ORDER)), C("category"))
    ordered = counts.agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "n"))).alias("x"))  # at most a row for each category
    return ordered.select(F.posexplode("x").alias("at", "r")).select((C("at") + 1).cast("long").alias("step"), "r.n")


@query("""SELECT DISTINCT lang AS source_ws, 'vernacular' AS kind, 'missing' AS problem FROM documents WHERE lang <> 'en' UNION ALL SELECT 'xx', 'vernacular', 'extra' FROM (SELECT count(*) FROM documents)""")
def ws_strict_coverage(spark, sf):
    """Languages against a mapping that has one of them and one that nothing needs."""
    need = read(spark, sf, "documents").select(C("lang").alias("ws_id"), F.lit("vernacular").alias("kind")).distinct()
    extra = need.agg(F.lit("xx").alias("ws_id"), F.lit("vernacular").alias("kind"))
    mapping = need.where("ws_id = 'en'").unionByName(extra).select(C("ws_id").alias("source_ws"), "kind", C("ws_id").alias("target_ws"), F.lit(False).alias("created"))
    return wsmap.coverage(need, mapping, strict=True).select("source_ws", "kind", "problem")


@query("""SELECT 'orders-' || k AS guid, string_agg(DISTINCT v, ',' ORDER BY v) AS arr FROM (SELECT l_orderkey AS k, l_suppkey::VARCHAR AS v FROM lineitem UNION ALL SELECT l_orderkey, l_partkey::VARCHAR FROM lineitem) GROUP BY k""")
def merge_set_union(spark, sf):
    """Sets of suppliers and of parts under one guid: their union, in order."""
    items = read(spark, sf, "lineitem").groupBy(F.concat(F.lit("orders-"), C("l_orderkey").cast("string")).alias("guid"))
    both = items.agg(*(F.collect_set(C(c).cast("string")).alias(c) for c in ("l_suppkey", "l_partkey")))
    return both.select("guid", F.array_join(values.merge_sets(C("l_suppkey"), C("l_partkey")), ",").alias("arr"))
