"""Registered queries: each applies one operator to snapshots derived from whole tables, beside equivalent DuckDB SQL.

A source is a table as given; its target is the part whose key isn't divisible by three, edited where a query says so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import residue, values
from tallyweave.model import Selection
from tallyweave.operators import apply, closure, conflicts, matching, planning, report, selection, wsmap
from tallyweave.plans import run_queries, sequence_queries  # noqa: F401  register their queries
from tallyweave.plans.registry import ORACLES, QUERIES, query
from tallyweave.sources.snapshots import customer_pair, pieces, properties, read, target_of, tree

__all__ = ["ORACLES", "QUERIES"]

RUN, TIME = "GT-20260619-150000", "2026-06-19T15:00:00"
C = F.col


def long(name: str):
    return C(name).cast("long").alias(name)


# Presence and plans

@query("""SELECT 'customer-' || c_custkey AS guid, c_custkey % 3 <> 0 AS present FROM customer""")
def presence_by_guid(spark, sf):
    s, t = customer_pair(spark, sf)
    return matching.presence(s, t, ["guid"]).select("guid", "present")


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'ADD' ELSE 'SKIP' END AS verb, 'customer-' || c_custkey AS source_guid,
    CASE WHEN c_custkey % 3 <> 0 THEN 'already_present_by_guid' END AS reason FROM customer""")
def plan_presence(spark, sf):
    s, t = customer_pair(spark, sf)
    return planning.plan_pieces(matching.presence(s, t, ["guid"]), "entry").select("verb", "source_guid", "reason")


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'ADD' ELSE 'OVERWRITE' END AS verb, 'customer-' || c_custkey AS source_guid,
    CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'guid' END AS match_via FROM customer""")
def plan_overwrite(spark, sf):
    s, t = customer_pair(spark, sf)
    return planning.plan_pieces(matching.presence(s, t, ["guid"]), "entry", overwrite=True).select("verb", "source_guid", "match_via")


@query("""SELECT 'part-' || p_partkey AS source_guid,
    CASE WHEN p_brand LIKE '%1' THEN 'SKIP' WHEN p_partkey % 3 <> 0 THEN 'SKIP' ELSE 'ADD' END AS verb,
    CASE WHEN p_brand LIKE '%1' THEN 'gold_inviolable' WHEN p_partkey % 3 <> 0 THEN 'already_present_by_guid' END AS reason,
    CASE WHEN p_brand LIKE '%1' THEN 'catalog ' || p_brand WHEN p_partkey % 3 <> 0 THEN 'part-' || p_partkey || ' is in the target' END AS detail
    FROM part""")
def plan_gold(spark, sf):
    s = pieces(spark, sf, "part").withColumn("catalog_id", F.when(C("p_brand").endswith("1"), C("p_brand")))
    known = matching.presence(s, target_of(s, "part"), ["guid"])
    return planning.plan_pieces(known, "gram_categories").select("source_guid", "verb", "reason", "detail")


@query("""WITH f AS (SELECT DISTINCT event_type AS o, 'Field' || user_id % 40 AS n FROM events),
    t AS (SELECT DISTINCT event_type AS o, CASE WHEN user_id % 2 = 0 THEN 'Field' ELSE 'field' END || user_id % 40 AS n FROM events WHERE user_id % 3 <> 0)
    SELECT 'SKIP' AS verb, 'cf:' || f.o || ':' || f.n AS source_guid,
    CASE WHEN t.o IS NULL THEN 'needs_manual' ELSE 'already_present_by_identity' END AS reason, f.o || '.' || f.n AS detail
    FROM f LEFT JOIN t ON f.o = t.o AND f.n = t.n""")
def plan_identity_pair(spark, sf):
    e = read(spark, sf, "events")
    number = (C("user_id") % 40).cast("string")
    s = e.select(C("event_type").alias("owner_class"), F.concat(F.lit("Field"), number).alias("name")).distinct()
    t = e.where(C("user_id") % 3 != 0).select(C("event_type").alias("owner_class"), F.concat(F.when(C("user_id") % 2 == 0, "Field").otherwise("field"), number).alias("name"))
    return planning.plan_by_identity(s, t)


@query("""SELECT 'supplier-' || s_suppkey AS guid, 'nation-' || s_nationkey AS owner_guid, s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AS present FROM supplier""")
def plan_scoped_presence(spark, sf):
    s = pieces(spark, sf, "supplier").withColumn("owner_guid", F.concat(F.lit("nation-"), C("s_nationkey").cast("string")))
    moved = F.when(C("s_suppkey") % 7 == 0, F.concat("owner_guid", F.lit("x"))).otherwise(C("owner_guid"))
    return matching.presence(s, target_of(s, "supplier").withColumn("owner_guid", moved), ["guid", "owner_guid"]).select("guid", "owner_guid", "present")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN quality END AS q FROM labels)
    SELECT CASE WHEN q IS NULL THEN 'SKIP' WHEN doc_id % 3 <> 0 THEN 'SKIP' ELSE 'ADD' END AS verb, concat_ws('::', doc_id::VARCHAR, q::VARCHAR) AS source_guid,
    CASE WHEN q IS NULL THEN 'unsupported_lcm_type' WHEN doc_id % 3 <> 0 THEN 'already_present_by_guid' END AS reason FROM p""")
def plan_pair_wiring(spark, sf):
    rows = read(spark, sf, "labels").select(C("doc_id").cast("string").alias("owner"), F.when(C("doc_id") % 11 != 0, C("quality").cast("string")).alias("value"), "doc_id")
    return planning.plan_wiring(rows.select("owner", "value"), rows.where("doc_id % 3 <> 0 AND value IS NOT NULL").select("owner", "value"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'ADD' WHEN c_custkey % 5 = 0 AND c_mktsegment <> 'EDITED' THEN 'OVERWRITE' ELSE 'SKIP' END AS verb, count(*) AS pieces
    FROM customer GROUP BY ALL""")
def reconcile_customers(spark, sf):
    """Pieces to add, those that differ to overwrite, and those that are equal."""
    s, t = customer_pair(spark, sf)
    fields = {"c_name": "str", "c_mktsegment": "str", "c_nationkey": "int"}
    changed = conflicts.conflicts(properties(s, fields), properties(t, fields)).select("guid").distinct()
    known = matching.presence(matching.presence(s, t, ["guid"]).withColumnRenamed("present", "there"), changed, ["guid"])
    verb = F.when(~C("there"), "ADD").when(C("present"), "OVERWRITE").otherwise("SKIP")
    return known.groupBy(verb.alias("verb")).agg(F.count("*").alias("pieces"))


def _lockstep(spark, sf, overwrite):
    s, _ = customer_pair(spark, sf)
    entries = matching.presence(s, target_of(s, "customer"), ["guid"]).select("guid", "present")
    senses = pieces(spark, sf, "orders").select("guid", F.concat(F.lit("customer-"), C("o_custkey").cast("string")).alias("owner_guid"))
    return planning.lockstep(entries, senses, overwrite)


@query("""SELECT 'entry' AS category, CASE WHEN c_custkey % 3 = 0 THEN 'ADD' ELSE 'OVERWRITE' END AS verb, 'customer-' || c_custkey AS source_guid FROM customer
    UNION ALL SELECT 'sense', CASE WHEN o_custkey % 3 = 0 THEN 'ADD' ELSE 'OVERWRITE' END, 'orders-' || o_orderkey FROM orders""")
def plan_lockstep(spark, sf):
    return _lockstep(spark, sf, True).select("category", "verb", "source_guid")


# Selection and picker

@query("""SELECT 'nation-' || n_nationkey AS guid, n_name FROM nation WHERE lower('NATION-' || n_nationkey) IN (SELECT DISTINCT 'nation-' || s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def select_picks(spark, sf):
    picks = read(spark, sf, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("NATION-"), C("s_nationkey").cast("string")).alias("guid"))
    return selection.picked(pieces(spark, sf, "nation"), picks).select("guid", "n_name")


def _inventory(spark, sf):
    """Nations as templates, suppliers as slots, the parts they deliver as affixes; parts never delivered are unbound."""
    l = read(spark, sf, "lineitem")
    slots = read(spark, sf, "supplier").select(C("s_nationkey").cast("long").alias("template"), C("s_suppkey").alias("slot"))
    bound = l.select(C("l_suppkey").alias("slot"), C("l_partkey").alias("affix")).distinct()
    parts = read(spark, sf, "part").select(C("p_partkey").alias("affix"))
    return slots, bound, parts.join(bound, "affix", "left_anti")


def _picks(spark, sf):
    level = lambda df, name, c: df.select(F.lit(name).alias("level"), C(c).cast("long").alias("guid"))
    return level(read(spark, sf, "nation").where("n_nationkey % 10 = 3"), "template", "n_nationkey").union(level(read(spark, sf, "supplier").where("s_suppkey % 17 = 5"), "slot", "s_suppkey")).union(level(read(spark, sf, "part").where("p_partkey % 50 = 7"), "affix", "p_partkey"))


@query("""SELECT DISTINCT p_partkey AS affix FROM part WHERE p_partkey % 50 = 7
    UNION SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 17 = 5 OR s_nationkey % 10 = 3""")
def expand_template_slot_affix(spark, sf):
    slots, bound, unbound = _inventory(spark, sf)
    return selection.required_affixes(slots, bound, unbound, _picks(spark, sf))


@query("""SELECT DISTINCT s_nationkey::BIGINT AS template FROM supplier WHERE s_nationkey % 10 = 3""")
def required_templates(spark, sf):
    return selection.required_templates(_inventory(spark, sf)[0], _picks(spark, sf))


@query("""SELECT p_partkey AS affix FROM part UNION SELECT l_partkey FROM lineitem""")
def all_affixes(spark, sf):
    _, bound, unbound = _inventory(spark, sf)
    return selection.all_affixes(bound, unbound)


@query("""SELECT o_custkey AS parent, bool_and(o_orderstatus <> 'P') AS checked FROM orders GROUP BY ALL""")
def picker_state(spark, sf):
    o = read(spark, sf, "orders")
    return selection.picker_state(o.select(C("o_custkey").alias("parent"), C("o_orderkey").alias("child"), (C("o_orderstatus") != "P").alias("checked")))


# Closure

@query("""SELECT 'region-' || r_regionkey AS guid, 0 AS depth, 'region-' || r_regionkey AS root FROM region
    UNION ALL SELECT 'nation-' || n_nationkey, 1, 'region-' || n_regionkey FROM nation
    UNION ALL SELECT 'customer-' || c_custkey, 2, 'region-' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'orders-' || o_orderkey, 3, 'region-' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def closure_tree_recursive(spark, sf):
    return closure.walk_tree(tree(spark, sf).select("guid", "owner_guid"))


def _graph(spark, sf):
    """A graph with cycles: orders need their parts, parts their suppliers, suppliers their nation, a nation the next one."""
    link = lambda df, a, x, b, y, pos: df.select(F.concat(F.lit(f"{a}-"), C(x).cast("string")).alias("from_guid"), F.concat(F.lit(f"{b}-"), y.cast("string")).alias("to_guid"), pos.cast("int").alias("pos"))
    l, s, n = (read(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    parts = link(l, "orders", "l_orderkey", "part", C("l_partkey"), C("l_linenumber"))
    makers = link(l, "part", "l_partkey", "supplier", C("l_suppkey"), C("l_suppkey"))
    return parts.union(makers).union(link(s, "supplier", "s_suppkey", "nation", C("s_nationkey"), F.lit(1))).union(link(n, "nation", "n_nationkey", "nation", (C("n_nationkey") + 1) % 25, F.lit(1)))


_GRAPH_SQL = """e AS (SELECT 'orders-' || l_orderkey AS f, 'part-' || l_partkey AS t FROM lineitem UNION ALL SELECT 'part-' || l_partkey, 'supplier-' || l_suppkey FROM lineitem
    UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey FROM supplier UNION ALL SELECT 'nation-' || n_nationkey, 'nation-' || (n_nationkey + 1) % 25 FROM nation),
    s AS (SELECT 'orders-' || o_orderkey AS g FROM orders)"""


def _seeds(spark, sf):
    return pieces(spark, sf, "orders").select("guid", C("o_orderkey").alias("ord"))


@query(f"""WITH RECURSIVE {_GRAPH_SQL}, d AS (SELECT DISTINCT f, t FROM e),
    w(g, level) AS (SELECT g, 0 FROM s UNION SELECT d.t, w.level + 1 FROM w JOIN d ON d.f = w.g WHERE w.level < 32)
    SELECT g AS guid, min(level) AS level FROM w GROUP BY ALL""")
def closure_bfs_levels(spark, sf):
    return closure.walk(_seeds(spark, sf), _graph(spark, sf), ranked=False).select("guid", C("level").cast("int").alias("level"))


@query(f"""WITH RECURSIVE {_GRAPH_SQL}, d AS (SELECT DISTINCT f, t FROM e), w(g) AS (SELECT g FROM s UNION SELECT d.t FROM w JOIN d ON d.f = w.g)
    SELECT e.t AS guid, e.f AS parent, count(*) AS times FROM e WHERE e.f IN (SELECT g FROM w) AND e.t NOT IN (SELECT g FROM s) GROUP BY ALL""")
def closure_pulled_in_by(spark, sf):
    seeds, edges = _seeds(spark, sf), _graph(spark, sf)
    found = closure.walked_with_parents(seeds, edges)
    return found.groupBy("guid", "parent").agg(F.count("*").alias("times"))


@query("""SELECT 'orders-' || o_orderkey AS guid, CASE WHEN n IS NULL THEN 0 END AS level FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey
    UNION ALL SELECT 'part-' || p_partkey, CASE WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem) THEN 0 END FROM part
    UNION ALL SELECT 'supplier-' || s_suppkey, NULL FROM supplier UNION ALL SELECT 'nation-' || n_nationkey, NULL FROM nation""")
def dependency_levels_behind_cycle(spark, sf):
    """With the suppliers' need of their nations, which form a cycle: all that lies behind it has no level."""
    nodes = planning.union([pieces(spark, sf, name).select("guid") for name in ("orders", "part", "supplier", "nation")])
    return closure.dependency_levels(nodes, _graph(spark, sf)).select("guid", C("level").cast("int").alias("level"))


@query("""WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders),
    p0 AS (SELECT l_partkey AS k, min((r, l_linenumber)) AS m FROM lineitem JOIN o ON o.k = l_orderkey GROUP BY ALL),
    p AS (SELECT k, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY m, 'part-' || k) - 1 AS r FROM p0),
    s0 AS (SELECT l_suppkey AS k, min((r, l_suppkey)) AS m FROM lineitem JOIN p ON p.k = l_partkey GROUP BY ALL),
    s AS (SELECT k, (SELECT count(*) FROM o) + (SELECT count(*) FROM p) + row_number() OVER (ORDER BY m, 'supplier-' || k) - 1 AS r FROM s0),
    n0 AS (SELECT s_nationkey AS k, min(r) AS m FROM supplier JOIN s ON s.k = s_suppkey GROUP BY ALL),
    n1 AS (SELECT n_nationkey AS k, min(((n_nationkey - n0.k + 25) % 25, n0.m)) AS a FROM nation, n0 GROUP BY ALL),
    n AS (SELECT k, 3 + a[1] AS level, (SELECT count(*) FROM o) + (SELECT count(*) FROM p) + (SELECT count(*) FROM s) + row_number() OVER (ORDER BY a) - 1 AS r FROM n1)
    SELECT 'orders-' || k AS guid, 0::INT AS level, r::BIGINT AS rank FROM o UNION ALL SELECT 'part-' || k, 1, r FROM p
    UNION ALL SELECT 'supplier-' || k, 2, r FROM s UNION ALL SELECT 'nation-' || k, level::INT, r FROM n""")
def closure_all_orders_ranks(spark, sf):
    """All orders as seeds, with the visit order. Nations follow one another, so each inherits its first ancestor's place."""
    return closure.walk(_seeds(spark, sf), _graph(spark, sf)).select("guid", C("level").cast("int").alias("level"), long("rank"))


@query(f"""WITH RECURSIVE {_GRAPH_SQL}, d AS (SELECT DISTINCT f, t FROM e), w(g) AS (SELECT g FROM s UNION SELECT d.t FROM w JOIN d ON d.f = w.g)
    SELECT e.t AS guid, e.f AS parent, count(*) AS times FROM e WHERE e.f IN (SELECT g FROM w) AND e.t NOT IN (SELECT g FROM s) GROUP BY ALL""")
def closure_all_pulled_in_by(spark, sf):
    seeds, edges = _seeds(spark, sf), _graph(spark, sf)
    found = closure.walked_with_parents(seeds, edges)
    return found.groupBy("guid", "parent").agg(F.count("*").alias("times"))


@query("""SELECT 'orders-' || o_orderkey AS guid, CASE WHEN n IS NULL THEN 0 ELSE 2 END AS level FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey
    UNION ALL SELECT 'part-' || p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 1 ELSE 0 END FROM part
    UNION ALL SELECT 'supplier-' || s_suppkey, 0 FROM supplier
    UNION ALL SELECT 'nation-' || n_nationkey, NULL FROM nation""")
def dependency_levels(spark, sf):
    """Nations form a cycle and have no level; suppliers' need of them is left out here."""
    nodes = None
    for name in ("orders", "part", "supplier", "nation"):
        own = pieces(spark, sf, name).select("guid")
        nodes = own if nodes is None else nodes.union(own)
    edges = _graph(spark, sf).where(~(C("from_guid").startswith("supplier-") & C("to_guid").startswith("nation-")))
    return closure.dependency_levels(nodes, edges).select("guid", C("level").cast("int").alias("level"))


def _vertical(spark, sf, chosen, closed):
    """All parts as slots."""
    n, s = pieces(spark, sf, "nation"), pieces(spark, sf, "supplier")
    owners = matching.presence(n, n.where("n_nationkey % 4 <> 0"), ["guid"]).select("guid", "present")
    templates = matching.presence(s, target_of(s, "supplier"), ["guid"]).select("guid", F.concat(F.lit("nation-"), C("s_nationkey").cast("string")).alias("owner_guid"), "present")
    p = pieces(spark, sf, "part")
    slots = matching.presence(p, target_of(p, "part"), ["guid"])
    suppliers = read(spark, sf, "supplier").count()
    slots = slots.select("guid", F.concat(F.lit("supplier-"), (C("p_partkey") % suppliers).cast("string")).alias("template"), C("p_partkey").cast("int").alias("ord"), "present")
    plan = planning.plan_vertical(owners, templates, slots, Selection(frozenset(chosen), closure=closed))
    return plan.select(F.lit(f"{'+'.join(sorted(chosen))}{'*' if closed else ''}").alias("run"), "verb", "category", "source_guid", "reason", "detail", F.array_join("pulled_in_by", ",").alias("pulled_in_by"))


@query("""WITH o AS (SELECT 'nation-' || n_nationkey AS g, n_nationkey % 4 <> 0 AS p FROM nation), t AS (SELECT 'supplier-' || s_suppkey AS g, 'nation-' || s_nationkey AS o, s_suppkey % 3 <> 0 AS p FROM supplier),
    s AS (SELECT 'part-' || p_partkey AS g, 'supplier-' || (p_partkey % (SELECT count(*) FROM supplier)) AS t, p_partkey % 3 <> 0 AS p FROM part),
    ts AS (SELECT t.*, (SELECT string_agg(s.g, ', ' ORDER BY s.g) FROM s WHERE s.t = t.g) AS slots FROM t),
    runs(run, a, b, c, m) AS (VALUES ('pos', 1, 0, 0, 0), ('templates', 0, 1, 0, 0), ('slots', 0, 0, 1, 0), ('pos+templates', 1, 1, 0, 0), ('slots+templates', 0, 1, 1, 0), ('pos+slots+templates', 1, 1, 1, 0), ('slots*', 0, 0, 1, 1)),
    bare AS (SELECT run, ts.*, concat_ws(', ', CASE WHEN a = 0 THEN o END, CASE WHEN c = 0 THEN slots END) AS why, a, b, c, m FROM runs, ts WHERE b = 1 AND m = 0)
    SELECT run, CASE WHEN p THEN 'SKIP' ELSE 'ADD' END AS verb, 'pos' AS category, g AS source_guid, CASE WHEN p THEN 'already_present_by_guid' END AS reason,
        CASE WHEN p THEN g || ' is in the target' END AS detail, CASE WHEN a = 0 THEN g ELSE '' END AS pulled_in_by FROM runs, o WHERE a = 1 OR m = 1
    UNION ALL SELECT run, 'SKIP', 'templates', g, 'bare_bones_missing_closure', why, '' FROM bare WHERE why <> ''
    UNION ALL SELECT run, CASE WHEN p THEN 'SKIP' ELSE 'ADD' END, 'templates', g, CASE WHEN p THEN 'already_present_by_guid' END, CASE WHEN p THEN g || ' is in the target' END, '' FROM bare WHERE why = ''
    UNION ALL SELECT run, CASE WHEN p THEN 'SKIP' ELSE 'ADD' END, 'templates', g, CASE WHEN p THEN 'already_present_by_guid' END, CASE WHEN p THEN g || ' is in the target' END, o FROM runs, t WHERE m = 1
    UNION ALL SELECT run, CASE WHEN p THEN 'SKIP' ELSE 'ADD' END, 'slots', g, CASE WHEN p THEN 'already_present_by_guid' END, CASE WHEN p THEN g || ' is in the target' END, '' FROM runs, s WHERE c = 1 AND (m = 1 OR a + b = 2)""")
def closure_off_bare_bones(spark, sf):
    """Closure off over the combinations of levels, and closure on with slots alone (marked *)."""
    runs = [("pos",), ("templates",), ("slots",), ("pos", "templates"), ("templates", "slots"), ("pos", "templates", "slots")]
    out = _vertical(spark, sf, ("slots",), True)
    for r in runs:
        out = out.unionByName(_vertical(spark, sf, r, False))
    return out


@query(ORACLES["closure_off_bare_bones"])
def closure_off_all_slots(spark, sf):
    """The same under the name that it had while the other took one part in twenty."""
    return closure_off_bare_bones(spark, sf)


@query("""SELECT 'orders-' || l_orderkey AS source_guid, 'SKIP' AS verb, 'dependency_unresolved' AS reason, string_agg(DISTINCT 'part-' || l_partkey, ', ' ORDER BY 'part-' || l_partkey) AS detail
    FROM lineitem WHERE l_partkey % 3 = 0 AND l_partkey % 2 <> 0 GROUP BY ALL""")
def unresolved_dependency(spark, sf):
    refs = read(spark, sf, "lineitem").select(F.concat(F.lit("orders-"), C("l_orderkey").cast("string")).alias("from_guid"), F.concat(F.lit("part-"), C("l_partkey").cast("string")).alias("to_guid"))
    parts = pieces(spark, sf, "part")
    return closure.unresolved(refs, target_of(parts, "part"), parts.where("p_partkey % 2 = 0"))


@query("""SELECT 'orders-' || o_orderkey AS guid, 'customer-' || o_custkey AS owner_guid FROM orders WHERE o_custkey % 3 = 0""")
def dangling_refs_check(spark, sf):
    children = pieces(spark, sf, "orders").select("guid", F.concat(F.lit("customer-"), C("o_custkey").cast("string")).alias("owner_guid"))
    return closure.dangling(children, customer_pair(spark, sf)[1]).select("guid", "owner_guid")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS o FROM orders UNION ALL SELECT c_custkey, c_custkey + 1000000000 FROM customer)
    SELECT 'customer-' || k AS source_guid, min(o) AS ord FROM p GROUP BY ALL""")
def ordered_distinct_touched(spark, sf):
    name = lambda c: F.concat(F.lit("customer-"), C(c).cast("string")).alias("source_guid")
    plan = read(spark, sf, "orders").select(name("o_custkey"), C("o_orderkey").alias("ord")).union(read(spark, sf, "customer").select(name("c_custkey"), (C("c_custkey") + 1_000_000_000).alias("ord")))
    return planning.ordered_touched(plan)


# Matching

def _matchable(spark, sf):
    """Orders with the fingerprint of their customer, status and date; target ids differ for every fourth."""
    s = pieces(spark, sf, "orders")
    s = s.withColumn("fp", values.fingerprint(C("o_custkey"), C("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    renamed = F.when(C("o_orderkey") % 4 == 0, F.concat(F.lit("t"), C("guid"))).otherwise(C("guid"))
    t = target_of(s, "orders").withColumn("guid", renamed).select("guid", "fp", C("o_orderkey").alias("ord"))
    remap = s.where("o_orderkey % 8 = 0").select(C("guid").alias("source_guid"), F.concat(F.lit("t"), C("guid")).alias("target_guid"))
    return s.select("guid", "fp"), t, remap


_MATCH_SQL = """WITH s AS (SELECT o_orderkey AS k, 'orders-' || o_orderkey AS g, o_custkey || '/' || o_orderstatus || '/' || strftime(o_orderdate, '%Y-%m-%d') AS fp FROM orders),
    t AS (SELECT k, CASE WHEN k % 4 = 0 THEN 't' ELSE '' END || g AS g, fp FROM s WHERE k % 3 <> 0),
    f AS (SELECT fp, arg_min(g, k) AS g, count(*) AS n FROM t GROUP BY ALL),
    m AS (SELECT s.g AS guid, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN s.g END AS a, CASE WHEN k % 8 = 0 AND k % 3 <> 0 THEN 't' || s.g END AS b, f.g AS c, n FROM s LEFT JOIN f USING (fp)),
    r AS (SELECT guid, coalesce(a, b, c) AS target_guid, CASE WHEN a IS NOT NULL THEN 'guid' WHEN b IS NOT NULL THEN 'identity_remap' WHEN c IS NOT NULL THEN 'fingerprint' ELSE 'none' END AS via, n FROM m)
    """


@query(_MATCH_SQL + "SELECT guid, target_guid, via, via = 'fingerprint' AND n > 1 AS ambiguous FROM r")
def match_three_step(spark, sf):
    return matching.match(*_matchable(spark, sf)).select("guid", "target_guid", "via", "ambiguous")


@query(_MATCH_SQL + "SELECT via, count(*) AS pieces FROM r GROUP BY ALL")
def match_via_counts(spark, sf):
    return matching.match(*_matchable(spark, sf)).groupBy("via").agg(F.count("*").alias("pieces"))


@query("""WITH o AS (SELECT l_orderkey AS k, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS slots FROM lineitem GROUP BY ALL),
    f AS (SELECT k, slots, o_orderstatus AS st, o_custkey % 100 AS w FROM o JOIN orders ON k = o_orderkey)
    SELECT 'orders-' || k AS guid, count(*) OVER (PARTITION BY slots, st, w) AS alike FROM f""")
def fingerprint_msa(spark, sf):
    """Orders as grammatical analyses with a set of slots; how many have one fingerprint."""
    slots = read(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.collect_set(C("l_suppkey").cast("string")).alias("slots"))
    o = pieces(spark, sf, "orders").join(slots, "o_orderkey")
    fp = values.msa_fingerprint(C("o_custkey") % 100, C("o_orderstatus"), F.lit(None), C("slots"))
    each = o.select("guid", fp.alias("fp"))
    return each.join(each.groupBy("fp").agg(F.count("*").alias("alike")), "fp").select("guid", "alike")


@query("""SELECT 'customer-' || c_custkey AS source_guid, 'new-' || substr(sha256('GT-20260619-150000|customer-' || c_custkey), 1, 32) AS target_guid FROM customer WHERE c_custkey % 3 = 0""")
def remap_new_ids(spark, sf):
    s, t = customer_pair(spark, sf)
    return matching.remap_of(s.join(t, "guid", "left_anti"), RUN)


@query("""SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'new-' || substr(sha256('GT-20260619-150000|orders-' || l_orderkey), 1, 32) ELSE 'orders-' || l_orderkey END AS from_guid,
    'SlotsRC' AS field, 'part-' || l_partkey AS to_guid, l_linenumber AS ord FROM lineitem WHERE l_partkey % 3 <> 0""")
def refs_rewired(spark, sf):
    refs = read(spark, sf, "lineitem").select(F.concat(F.lit("orders-"), C("l_orderkey").cast("string")).alias("from_guid"), F.lit("SlotsRC").alias("field"), F.concat(F.lit("part-"), C("l_partkey").cast("string")).alias("to_guid"), C("l_linenumber").cast("int").alias("ord"))
    created = pieces(spark, sf, "orders").where("o_orderkey % 3 = 0")
    return matching.rewired(refs, matching.remap_of(created, RUN), target_of(pieces(spark, sf, "part"), "part"))


@query("""SELECT 'part-' || l_partkey AS to_guid, count(*) AS refs FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY ALL""")
def refs_unmatched(spark, sf):
    refs = read(spark, sf, "lineitem").select(F.concat(F.lit("part-"), C("l_partkey").cast("string")).alias("to_guid"))
    return matching.unmatched_refs(refs, target_of(pieces(spark, sf, "part"), "part")).groupBy("to_guid").agg(F.count("*").alias("refs"))


_KINDS = ("PrefixSlotsRS", "SuffixSlotsRS", "ProcliticSlotsRS", "EncliticSlotsRS")


@query("""SELECT DISTINCT ON (f, t) f AS from_guid, t AS to_guid, position FROM (SELECT f, t, row_number() OVER (PARTITION BY f ORDER BY k, o, t) AS position FROM
    (SELECT DISTINCT 'orders-' || l_orderkey AS f, 'part-' || l_partkey AS t, l_partkey % 4 AS k, l_partkey AS o FROM lineitem))""")
def template_slot_order(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (C("l_partkey") % 4 + 1).cast("int"))
    refs = read(spark, sf, "lineitem").select(F.concat(F.lit("orders-"), C("l_orderkey").cast("string")).alias("from_guid"), kind.alias("field"), F.concat(F.lit("part-"), C("l_partkey").cast("string")).alias("to_guid"), C("l_partkey").alias("ord")).distinct()
    return matching.slot_order(refs).select("from_guid", "to_guid", long("position"))


@query("""SELECT 'orders-' || o_orderkey AS guid, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, 'orders-' || o_orderkey) = 1 THEN 'LexemeFormOA' ELSE 'AlternateFormsOS' END AS owner_field FROM orders""")
def lexeme_and_alternates(spark, sf):
    forms = pieces(spark, sf, "orders").select("guid", C("o_custkey").alias("owner_guid"), C("o_orderkey").alias("ord"))
    return matching.lexeme_first(forms).select("guid", "owner_field")


@query("""SELECT l_partkey AS env, min((l_orderkey, l_linenumber))[1] AS entry FROM lineitem GROUP BY ALL""")
def environments_first_sighting(spark, sf):
    rows = read(spark, sf, "lineitem").select(C("l_partkey").alias("env"), C("l_orderkey").alias("entry"), C("l_linenumber").alias("ord"))
    return matching.first_sighting(rows, "env", ["entry", "ord"]).select("env", "entry")


# Conflicts and merges

_FIELDS = {"c_name": "str", "c_mktsegment": "str", "c_nationkey": "int"}


def _facts(spark, sf):
    s, t = customer_pair(spark, sf)
    t = t.withColumn("c_nationkey", F.when(C("c_custkey") % 7 == 0, (C("c_nationkey") + 1) % 25).otherwise(C("c_nationkey")))
    return properties(s, _FIELDS), properties(t, _FIELDS)


_CONFLICT_SQL = """WITH c AS (SELECT 'customer-' || c_custkey AS guid, 'c_mktsegment' AS field, 'EDITED' AS left_value, c_mktsegment AS right_value, TRUE AS eligible FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 = 0 AND c_mktsegment <> 'EDITED'
    UNION ALL SELECT 'customer-' || c_custkey, 'c_nationkey', ((c_nationkey + 1) % 25)::VARCHAR, c_nationkey::VARCHAR, FALSE FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 = 0)
    """


@query(_CONFLICT_SQL + "SELECT * FROM c")
def conflict_fields(spark, sf):
    return conflicts.conflicts(*_facts(spark, sf))


@query(_CONFLICT_SQL + "SELECT field, eligible, count(*) AS conflicts FROM c GROUP BY ALL")
def conflict_merge_eligible(spark, sf):
    return conflicts.conflicts(*_facts(spark, sf)).groupBy("field", "eligible").agg(F.count("*").alias("conflicts"))


@query("""SELECT 'customer-' || c_custkey AS guid, f AS field FROM customer, (VALUES ('CustomSegment'), ('CustomNation'), ('Name')) v(f)
    WHERE NOT (c_custkey % 3 <> 0 AND (f = 'CustomNation' OR f = 'CustomSegment' AND (c_custkey % 5 <> 0 OR c_mktsegment = 'EDITED')))""")
def custom_dedupe(spark, sf):
    fields = {"CustomSegment": "str", "CustomNation": "int", "Name": "str"}
    s, t = (df.withColumnsRenamed({"c_mktsegment": "CustomSegment", "c_nationkey": "CustomNation", "c_name": "Name"}) for df in customer_pair(spark, sf))
    return conflicts.without_equal_customs(properties(s, fields), properties(t, fields)).select("guid", "field")


def _decisions(spark, sf):
    found = conflicts.conflicts(*_facts(spark, sf))
    key = F.regexp_extract("guid", "[0-9]+", 0).cast("long")
    how = F.element_at(F.array(*map(F.lit, ("take_source", "keep_target", "merge", "skip", "edit_custom"))), (key % 5 + 1).cast("int"))
    how = F.when(C("field") == "c_mktsegment", F.element_at(F.array(*map(F.lit, ("take_source", "keep_target", "merge", "skip", "edit_custom"))), (F.floor(key / 5) % 5 + 1).cast("int"))).otherwise(how)
    return found, found.where(key % 11 != 0).select("guid", "field", how.alias("resolution"), F.when(how == "edit_custom", "chosen").alias("custom_value"))


_DECISION_SQL = _CONFLICT_SQL.rstrip() + """, k AS (SELECT *, regexp_extract(guid, '[0-9]+')::BIGINT AS n FROM c),
    d AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'take_source' ELSE (['take_source', 'keep_target', 'merge', 'skip', 'edit_custom'])[CASE WHEN field = 'c_mktsegment' THEN n // 5 % 5 ELSE n % 5 END + 1] END AS resolution FROM k)
    """


@query(_DECISION_SQL + """SELECT guid, field, resolution, CASE resolution WHEN 'keep_target' THEN left_value WHEN 'skip' THEN left_value WHEN 'edit_custom' THEN 'chosen'
    WHEN 'merge' THEN CASE WHEN eligible THEN left_value || chr(10) || '--- merged GT-20260619-150000 ---' || chr(10) || right_value ELSE right_value END ELSE right_value END AS value, resolution = 'skip' AS skipped FROM d""")
def apply_decisions(spark, sf):
    found, d = _decisions(spark, sf)
    return conflicts.apply_decisions(found, d, RUN)


@query(_DECISION_SQL + """SELECT guid, count(*) AS decisions, string_agg(field || '=' || resolution, ';' ORDER BY field) AS listed FROM d WHERE n % 11 <> 0 GROUP BY ALL""")
def decision_log_round_trip(spark, sf):
    """Logs are written as JSON and read back."""
    back = conflicts.recalled(conflicts.decision_log(_decisions(spark, sf)[1]))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field", "resolution"))), ";")
    return back.groupBy("guid").agg(F.count("*").alias("decisions"), listed.alias("listed"))


@query("""WITH s AS (SELECT 'customer-' || c_custkey AS guid, field, v FROM customer, LATERAL (VALUES ('c_name', c_name), ('c_mktsegment', c_mktsegment)) x(field, v)),
    n AS (SELECT 'customer-' || c_custkey AS guid, 'c_nationkey' AS field, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 7 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END::VARCHAR AS v FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey % 3 <> 0)
    SELECT * FROM s UNION ALL SELECT * FROM n""")
def apply_source_wins(spark, sf):
    """The source lacks the nation of even customers, so the target's stays."""
    s, t = _facts(spark, sf)
    lacks = (C("field") == "c_nationkey") & (F.regexp_extract("guid", "[0-9]+", 0).cast("long") % 2 == 0)
    won = conflicts.source_wins(s.where(~lacks), t)
    return won.select("guid", "field", F.coalesce("s", C("n").cast("string")).alias("v"))


@query("""SELECT 'customer-' || c_custkey AS guid, 'EDITED' || chr(10) || '--- merged GT-20260619-150000 ---' || chr(10) || c_mktsegment AS merged FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 = 0""")
def merge_string(spark, sf):
    s, t = customer_pair(spark, sf)
    both = t.where("c_mktsegment = 'EDITED'").select("guid", C("c_mktsegment").alias("l")).join(s.select("guid", C("c_mktsegment").alias("r")), "guid")
    return both.select("guid", values.merge_text(C("l"), C("r"), RUN).alias("merged"))


def _arrays(spark, sf):
    l = read(spark, sf, "lineitem").select(F.concat(F.lit("orders-"), C("l_orderkey").cast("string")).alias("guid"), "l_partkey", "l_suppkey")
    arr = lambda c: F.array_sort(F.collect_list(C(c).cast("string"))).alias("arr")
    return l.groupBy("guid").agg(arr("l_suppkey")), l.groupBy("guid").agg(arr("l_partkey"))


@query("""WITH a AS (SELECT l_orderkey AS k, 1 AS side, l_suppkey::VARCHAR AS v FROM lineitem UNION ALL SELECT l_orderkey, 2, l_partkey::VARCHAR FROM lineitem),
    f AS (SELECT k, v, min(side) AS side FROM a GROUP BY ALL)
    SELECT 'orders-' || k AS guid, string_agg(v, ',' ORDER BY side, v) AS arr FROM f GROUP BY k""")
def merge_list_union(spark, sf):
    return conflicts.merged_lists(*_arrays(spark, sf)).select("guid", F.array_join("arr", ",").alias("arr"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_returnflag AS ws, max(l_suppkey)::VARCHAR AS v FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL), r AS (SELECT l_orderkey AS k, l_returnflag AS ws, max(l_partkey)::VARCHAR AS v FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY ALL),
    b AS (SELECT DISTINCT k FROM l INTERSECT SELECT DISTINCT k FROM r),
    m AS (SELECT coalesce(l.k, r.k) AS k, coalesce(l.ws, r.ws) AS ws, CASE WHEN l.v IS NULL THEN r.v WHEN r.v IS NULL THEN l.v ELSE l.v || chr(10) || '--- merged GT-20260619-150000 ---' || chr(10) || r.v END AS v FROM l FULL JOIN r ON l.k = r.k AND l.ws = r.ws)
    SELECT 'orders-' || k AS guid, string_agg(ws || '=' || v, ';' ORDER BY ws) AS ms FROM m WHERE k IN (SELECT k FROM b) GROUP BY k""")
def merge_map(spark, sf):
    """Return flags stand for writing systems."""
    def side(where: str, c: str) -> DataFrame:
        each = read(spark, sf, "lineitem").where(where).groupBy("l_orderkey", "l_returnflag").agg(F.max(c).cast("string").alias("v"))
        return each.groupBy(F.concat(F.lit("orders-"), C("l_orderkey").cast("string")).alias("guid")).agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "v"))).alias("ms"))

    merged = conflicts.merged_maps(side("l_linenumber % 2 = 0", "l_suppkey"), side("l_linenumber % 3 <> 0", "l_partkey"), RUN)
    return merged.select("guid", F.array_join(F.transform(F.array_sort(F.map_entries("ms")), lambda e: F.concat_ws("=", e.key, e.value)), ";").alias("ms"))


@query("""SELECT 'orders-' || l_orderkey AS from_guid, 'SlotsRC' AS field, CASE WHEN l_orderkey % 5 = 0 THEN 'part-' || l_partkey ELSE 'supplier-' || l_suppkey END AS to_guid FROM lineitem""")
def msa_refs_replaced(spark, sf):
    end = lambda table, c: F.concat(F.lit(f"{table}-"), C(c).cast("string")).alias("to_guid")
    l = read(spark, sf, "lineitem").withColumn("from_guid", F.concat(F.lit("orders-"), C("l_orderkey").cast("string"))).withColumn("field", F.lit("SlotsRC"))
    touched = pieces(spark, sf, "orders").where("o_orderkey % 5 = 0")
    return conflicts.refs_replaced(l.select("from_guid", "field", end("supplier", "l_suppkey")), l.select("from_guid", "field", end("part", "l_partkey")), "SlotsRC", touched)


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, event_id FROM events)
    SELECT user_id::VARCHAR AS guid, event_type AS field, event_id::VARCHAR AS resolution FROM e WHERE r = 1""")
def prior_recall(spark, sf):
    """Events as a log of decisions: the last one of each user and type."""
    log = read(spark, sf, "events").select(C("user_id").cast("string").alias("guid"), C("event_type").alias("field"), C("event_id").cast("string").alias("resolution"), "ts", C("event_id").alias("seq"))
    return conflicts.latest_decisions(log)


# Tags

def _tags(spark, sf):
    d = read(spark, sf, "documents")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_780_000_000) + C("doc_id") * 61), "yyyy-MM-dd'T'HH:mm:ss")
    run = F.when(C("doc_id") % 7 == 0, "GT-20200101-000000").otherwise(residue.run_id_of(stamp))
    source = F.concat(C("lang"), F.when(C("doc_id") % 13 == 0, "|x").otherwise(""))
    return d.select(C("doc_id").cast("string").alias("guid"), "doc_id", residue.serialize(run, source, stamp, F.when(C("doc_id") % 2 == 0, F.concat(F.lit("{\"k\": "), C("doc_id").cast("string"), F.lit("}")))).alias("tag"))


_TAG_SQL = """WITH d AS (SELECT doc_id, lang, to_timestamp(1780000000 + doc_id * 61) AT TIME ZONE 'UTC' AS t FROM documents),
    g AS (SELECT doc_id, lang, strftime(t, '%Y-%m-%dT%H:%M:%S') AS ts, strftime(t, 'GT-%Y%m%d-%H%M%S') AS run, '{"k": ' || doc_id || '}' AS snap FROM d),
    q AS (SELECT doc_id, lang, run, CASE WHEN doc_id % 7 <> 0 AND doc_id % 13 <> 0 THEN 'GT|' || run || '|' || lang || '|' || ts || CASE WHEN doc_id % 2 = 0 THEN '|snap=' || to_base64(encode(snap)) ELSE '' END END AS tag, ts, snap FROM g)
    """


@query(_TAG_SQL + "SELECT doc_id::VARCHAR AS guid, tag FROM q")
def residue_serialize(spark, sf):
    return _tags(spark, sf).select("guid", "tag")


@query(_TAG_SQL + """SELECT doc_id::VARCHAR AS guid, CASE WHEN tag IS NOT NULL THEN run END AS run_id, CASE WHEN tag IS NOT NULL THEN lang END AS source, CASE WHEN tag IS NOT NULL AND doc_id % 2 = 0 THEN snap END AS snap FROM q""")
def residue_parse_last(spark, sf):
    """Texts with prose and an older tag: the last tag counts."""
    old = residue.serialize(F.lit(RUN), F.lit("old"), F.lit(TIME))
    once = _tags(spark, sf).withColumn("text", residue.carry(F.lit("A note.\nMore."), F.lit("Other"), old))
    text = residue.carry(C("text"), F.lit("Other"), C("tag"))
    parsed = once.withColumn("p", F.when(C("tag").isNotNull(), residue.parse(text)))
    return parsed.select("guid", "p.run_id", "p.source", "p.snap")


@query("""WITH v AS (SELECT doc_id, (['GT|GT-20260619-150000|s|2026-06-19T15:00:00', 'GT|GT-20260619-150000|s', 'XX|GT-20260619-150000|s|2026-06-19T15:00:00', 'GT|GT-20260619-150001|s|2026-06-19T15:00:00', 'GT|GT-20260619-150000|s|2026-06-19T15:00:00|merge=e30=|snap=e30=',
        'GT|GT-20260619-150000|s|2026-06-19T15:00:00|snap=e30=|merge=e30=', 'GT|GT-20260619-150000|s|2026-06-19T15:00:00|other=1', ''])[doc_id % 8 + 1] AS t FROM documents)
    SELECT doc_id, doc_id % 8 IN (0, 5) AS accepted FROM v""")
def residue_reject(spark, sf):
    good = f"GT|{RUN}|s|{TIME}"
    forms = [good, f"GT|{RUN}|s", f"XX|{RUN}|s|{TIME}", f"GT|GT-20260619-150001|s|{TIME}", f"{good}|merge=e30=|snap=e30=", f"{good}|snap=e30=|merge=e30=", f"{good}|other=1", ""]
    text = F.element_at(F.array(*map(F.lit, forms)), (C("doc_id") % 8 + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", residue.parse(text).isNotNull().alias("accepted"))


@query(_TAG_SQL + """SELECT doc_id::VARCHAR AS guid, tag IS NOT NULL AND doc_id % 6 IN (0, 4) AS accepted FROM q""")
def residue_reject_rows(spark, sf):
    """Tags of all documents, spoilt in turn: a segment lost, another run id, an unknown segment, a log in its place, and one
    in front of the snapshot."""
    k, tag = C("doc_id") % 6, C("tag")
    text = F.when(k == 0, tag).when(k == 1, F.regexp_replace(tag, r"\|[^|]*$", "")).when(k == 2, F.regexp_replace(tag, r"\|GT-", "|GT-9")).when(k == 3, F.concat(tag, F.lit("|other=1")))
    text = text.when(k == 4, F.concat(tag, F.lit("|merge=e30="))).otherwise(F.concat(tag, F.lit("|merge=e30=|snap=e30=")))
    return _tags(spark, sf).select("guid", (residue.parse(text).isNotNull()).alias("accepted"))


@query("""SELECT 'customer-' || c_custkey AS guid, '{"name":"' || c_name || '","nation":' || c_nationkey || ',"none":null}' AS snapshot FROM customer""")
def residue_snapshot(spark, sf):
    """Encoded to base64 and decoded again; keys in order, nulls kept, types as text or number."""
    fields = F.struct(C("c_name").alias("name"), C("c_nationkey").alias("nation"), F.lit(None).cast("string").alias("none"))
    json = F.to_json(fields, {"ignoreNullFields": "false"})
    return pieces(spark, sf, "customer").select("guid", residue.decode(residue.encode(json)).alias("snapshot"))


@query("""SELECT 'orders-' || o_orderkey AS guid, CASE WHEN o_orderkey % 2 = 0 THEN 'GT|GT-20260619-150000|src|2026-06-19T15:00:00' WHEN o_orderkey % 3 = 0 THEN '[GT-Tag]: GT|GT-20260619-150000|src|2026-06-19T15:00:00'
    ELSE o_orderpriority || chr(10) || chr(10) || '[GT-Tag]: GT|GT-20260619-150000|src|2026-06-19T15:00:00' END AS text FROM orders""")
def residue_carriers(spark, sf):
    o = pieces(spark, sf, "orders").select("guid", F.when(C("o_orderkey") % 2 == 0, "LexEntry").otherwise("PartOfSpeech").alias("class_name"), F.when(C("o_orderkey") % 3 != 0, C("o_orderpriority")).alias("existing"))
    return apply.tagged(o, RUN, "src", TIME).select("guid", "text")


# Writing systems

def _systems(spark, sf):
    """Languages and sources of documents as writing systems."""
    d = read(spark, sf, "documents")
    s = wsmap.scan(d.select(F.concat_ws("-", "lang", "source").alias("a"), C("lang").alias("b"), F.when(C("source") == "src1", "analysis").alias("kind")), ["a", "b"], "kind")
    t = d.where("doc_id % 3 <> 0 AND source IN ('src0', 'src1', 'src2', 'src3')").select(F.concat_ws("-", "lang", "source").alias("ws_id")).distinct()
    return s, t


_WS_SQL = """WITH s AS (SELECT DISTINCT lang || '-' || source AS ws_id, CASE WHEN source = 'src1' THEN 'analysis' ELSE 'vernacular' END AS kind FROM documents),
    t AS (SELECT DISTINCT lang || '-' || source AS ws_id FROM documents WHERE doc_id % 3 <> 0 AND source IN ('src0', 'src1', 'src2', 'src3'))
    """


@query(_WS_SQL + "SELECT ws_id, kind FROM s WHERE ws_id NOT IN (SELECT ws_id FROM t)")
def ws_mismatch(spark, sf):
    return wsmap.mismatches(*_systems(spark, sf)).select("ws_id", "kind")


@query(_WS_SQL + """, r AS (SELECT s.ws_id, s.kind, t.ws_id AS id, CASE WHEN s.ws_id = t.ws_id THEN 0 WHEN split_part(s.ws_id, '-', 1) = split_part(t.ws_id, '-', 1) THEN 1 WHEN substr(s.ws_id, 1, 2) = substr(t.ws_id, 1, 2) THEN 2 ELSE 3 END AS rank FROM s, t WHERE s.ws_id NOT IN (SELECT ws_id FROM t))
    SELECT ws_id, kind, string_agg(rank || ':' || id, ',' ORDER BY rank, id) AS candidates FROM r GROUP BY ALL""")
def ws_candidates_ranked(spark, sf):
    s, t = _systems(spark, sf)
    found = wsmap.ranked_candidates(wsmap.mismatches(s, t), t)
    return found.select("ws_id", "kind", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c.rank.cast("string"), c.id)), ",").alias("candidates"))


def _choices(spark, sf):
    s, t = _systems(spark, sf)
    mapping = s.join(t, "ws_id", "left_semi").select(C("ws_id").alias("source_ws"), "kind", C("ws_id").alias("target_ws"), F.lit(False).alias("created"))
    n = F.length("ws_id") % 3
    choice = F.when(C("ws_id").startswith("de"), "skip").when(n == 0, "create").otherwise("map")
    return s, mapping, s.select(C("ws_id").alias("source_ws"), "kind", choice.alias("choice"), F.when(choice == "map", "en-src0").alias("target_ws"))


_CHOICE_SQL = _WS_SQL.rstrip() + """, m AS (SELECT ws_id AS source_ws, kind, ws_id AS target_ws, FALSE AS created FROM s WHERE ws_id IN (SELECT ws_id FROM t)),
    f AS (SELECT * FROM m UNION ALL SELECT ws_id, kind, CASE WHEN length(ws_id) % 3 = 0 THEN ws_id ELSE 'en-src0' END, length(ws_id) % 3 = 0 FROM s WHERE ws_id NOT IN (SELECT ws_id FROM t) AND ws_id NOT LIKE 'de%')
    """


@query(_CHOICE_SQL + "SELECT * FROM f")
def ws_fold_choices(spark, sf):
    _, mapping, choices = _choices(spark, sf)
    return wsmap.folded(mapping, choices)


@query(_CHOICE_SQL + "SELECT target_ws, count(DISTINCT source_ws) AS sources FROM f GROUP BY ALL HAVING count(DISTINCT source_ws) > 1")
def ws_one_to_one(spark, sf):
    _, mapping, choices = _choices(spark, sf)
    return wsmap.shared_targets(wsmap.folded(mapping, choices))


@query(_CHOICE_SQL + "SELECT ws_id AS source_ws, kind, 'missing' AS problem FROM s WHERE ws_id NOT IN (SELECT source_ws FROM f)")
def ws_coverage(spark, sf):
    s, mapping, choices = _choices(spark, sf)
    return wsmap.coverage(s, wsmap.folded(mapping, choices), strict=True).select("source_ws", "kind", "problem")


@query("""SELECT conv_id::VARCHAR AS source_guid, 'SKIP' AS verb, 'unmapped_ws_user_chose_skip' AS reason FROM conversations GROUP BY conv_id HAVING bool_and(role IN ('user', 'system'))""")
def ws_only_in_skipped(spark, sf):
    """Roles stand for writing systems: conversations that only have skipped ones."""
    texts = read(spark, sf, "conversations").select(C("conv_id").cast("string").alias("guid"), C("role").alias("ws_id"))
    return wsmap.only_in_skipped(texts, texts.where("ws_id IN ('user', 'system')").select("ws_id"))


# Reports and application

_LOCK_SQL = """WITH p AS (SELECT 'entry' AS category, c_custkey % 3 <> 0 AS present FROM customer UNION ALL SELECT 'sense', o_custkey % 3 <> 0 FROM orders),
    r AS (SELECT category, count(*) FILTER (NOT present) AS added, 0::BIGINT AS overwritten, count(*) FILTER (present) AS skipped, 0::BIGINT AS closure_pulled_in, 0::BIGINT AS interactive_skipped FROM p GROUP BY ALL)
    """


@query(_LOCK_SQL + "SELECT * FROM r")
def report_by_category(spark, sf):
    return report.by_category(_lockstep(spark, sf, False))


@query(_LOCK_SQL + "SELECT sum(added)::BIGINT AS added, sum(overwritten)::BIGINT AS overwritten, sum(skipped)::BIGINT AS skipped, 0::BIGINT AS closure_pulled_in, 0::BIGINT AS interactive_skipped FROM r")
def report_totals(spark, sf):
    return report.totals(report.by_category(_lockstep(spark, sf, False)))


@query("""SELECT 'part' AS category, 0::BIGINT AS accounted, count(*) AS enumerated FROM part""")
def report_invariant(spark, sf):
    """Counts against what was enumerated, with parts that no plan covers."""
    n = lambda name, t: read(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("category"), "n")
    return report.conservation(report.by_category(_lockstep(spark, sf, False)), n("entry", "customer").union(n("sense", "orders")).union(n("part", "part")))


@query("""SELECT DISTINCT CASE event_type WHEN 'click' THEN 'entry' ELSE event_type END AS category FROM events WHERE event_type <> 'click'""")
def report_empty_categories(spark, sf):
    chosen = read(spark, sf, "events").select(F.when(C("event_type") == "click", "entry").otherwise(C("event_type")).alias("category"))
    return report.empty_categories(chosen, report.by_category(_lockstep(spark, sf, False)))


@query("""SELECT 'customer-' || c_custkey AS guid, c_name, c_mktsegment FROM customer""")
def apply_plan(spark, sf):
    """With overwriting on, the new target equals the source."""
    s, t = customer_pair(spark, sf)
    plan = planning.plan_pieces(matching.presence(s, t, ["guid"]), "entry", overwrite=True)
    return apply.applied(s, t, plan, ["c_name", "c_mktsegment"])


@query("""SELECT 'SKIP' AS verb, count(*) AS pieces FROM customer""")
def idempotent_rerun(spark, sf):
    """A second run over the applied target adds nothing."""
    s, t = customer_pair(spark, sf)
    after = apply.applied(s, t, planning.plan_pieces(matching.presence(s, t, ["guid"]), "entry"), ["c_name"])
    return planning.plan_pieces(matching.presence(s, after, ["guid"]), "entry").groupBy("verb").agg(F.count("*").alias("pieces"))


@query("""SELECT l_orderkey || '/' || l_linenumber AS guid, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def unique_ids_check(spark, sf):
    return apply.duplicates(read(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("guid")))
