import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import residue, values
from tallyweave.model import ReconcileError, RunContext, Selection
from tallyweave.operators import apply, closure, conflicts, matching, planning, report, selection, wsmap
from tallyweave.plans import run
from tallyweave.sources import snapshots

C = F.col
RUN, TIME = "GT-20260619-150000", "2026-06-19T15:00:00"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "from_guid string, to_guid string, pos int")


def seeds(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "guid string, ord int")


def visited(df):
    return [r.guid for r in df.orderBy("rank").collect()]


def test_walk_visits_each_piece_once_in_order(spark):
    diamond = edges(spark, ("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"))
    assert visited(closure.walk(seeds(spark, "a"), diamond)) == ["a", "c", "b", "d"]
    assert visited(closure.walk(seeds(spark, "z", "b"), diamond)) == ["z", "b", "d", "a", "c"]
    assert visited(closure.walk(seeds(spark), diamond)) == []


def test_parents_repeat_with_edges_and_seeds_have_none(spark):
    e = edges(spark, ("a", "b"), ("a", "b"), ("b", "b"), ("b", "a"))
    s = seeds(spark, "a")
    rows = closure.pulled_in_by(closure.walk(s, e), s, e).collect()
    assert sorted((r.guid, r.parent) for r in rows) == [("b", "a"), ("b", "a"), ("b", "b")]


def test_dependency_order_takes_ready_pieces_by_rank():
    ranked = [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert closure.dependency_order(ranked, [("a", "c"), ("a", "b"), ("b", "d")]) == ["c", "d", "b", "a"]
    assert closure.dependency_order(ranked, [("a", "b"), ("b", "a")]) == ["c", "d", "a", "b"]
    with pytest.raises(ReconcileError):
        closure.dependency_order(ranked, [], most=3)


def test_levels_leave_cycles_out(spark):
    nodes = seeds(spark, "a", "b", "c", "x", "y")
    rows = closure.dependency_levels(nodes, edges(spark, ("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"))).collect()
    assert {r.guid: r.level for r in rows} == {"a": 2, "b": 1, "c": 0, "x": None, "y": None}


def test_levels_beyond_a_bound_are_refused_not_called_cycles(spark):
    nodes, chain = seeds(spark, "a", "b", "c"), edges(spark, ("a", "b"), ("b", "c"))
    with pytest.raises(ReconcileError):
        closure.dependency_levels(nodes, chain, most=2).collect()
    assert {r.guid: r.level for r in closure.dependency_levels(nodes, chain, most=3).collect()} == {"a": 2, "b": 1, "c": 0}
    looped = edges(spark, ("a", "b"), ("b", "a"))
    assert {r.guid: r.level for r in closure.dependency_levels(nodes, looped, most=1).collect()} == {"a": None, "b": None, "c": 0}


def test_fingerprints_take_null_as_empty_and_slots_as_a_set(spark):
    df = spark.createDataFrame([("o", None, ["b", "a", "a"]), ("o", "", ["a", "b"])], "o string, pos string, slots array<string>")
    fps = [r[0] for r in df.select(values.msa_fingerprint(C("o"), F.lit("X"), C("pos"), C("slots"))).collect()]
    assert fps[0] == fps[1]


def test_match_prefers_guid_then_memory_then_fingerprint(spark):
    target = spark.createDataFrame([("g1", "f1", 1), ("g2", "f2", 2), ("g3", "f2", 3)], "guid string, fp string, ord int")
    source = spark.createDataFrame([("g1", "f2"), ("s2", "f2"), ("s3", "f1"), ("s4", "no"), ("s5", None)], "guid string, fp string")
    remap = spark.createDataFrame([("s3", "g3"), ("s2", "gone")], "source_guid string, target_guid string")
    got = {r.guid: (r.target_guid, r.via, r.ambiguous) for r in matching.match(source, target, remap).collect()}
    assert got == {"g1": ("g1", "guid", False), "s2": ("g2", "fingerprint", True), "s3": ("g3", "identity_remap", False), "s4": (None, "none", False), "s5": (None, "none", False)}


def facts(spark, *rows):
    return spark.createDataFrame([(g, f, t, v if t == "str" else None, v if t == "int" else None, v if t == "bool" else None) for g, f, t, v in rows], "guid string, field string, vtype string, s string, n long, b boolean")


def test_conflicts_compare_types_and_ignore_missing_fields(spark):
    s = facts(spark, ("g", "a", "int", 1), ("g", "b", "str", "x"), ("g", "c", "str", "only"), ("g", "d", "null", None))
    t = facts(spark, ("g", "a", "bool", True), ("g", "b", "str", "x"), ("g", "d", "str", ""))
    got = {r.field: r.eligible for r in conflicts.conflicts(s, t).collect()}
    assert got == {"a": False, "d": False}
    assert [r.field for r in conflicts.conflicts(s, t, blank_is_none=True).collect()] == ["a"]


def test_every_conflict_needs_a_decision(spark):
    s, t = facts(spark, ("g", "a", "str", "new")), facts(spark, ("g", "a", "str", "old"))
    none = spark.createDataFrame([], "guid string, field string, resolution string, custom_value string")
    with pytest.raises(ReconcileError):
        run.interactive_values(s, t, none, RUN)
    assert run.interactive_values(s, t, None, RUN).first().value == "new"
    merge = spark.createDataFrame([("g", "a", "merge", None)], none.schema)
    assert run.interactive_values(s, t, merge, RUN).first().value == f"old\n--- merged {RUN} ---\nnew"


def test_merges_keep_left_order_and_pass_single_sides(spark):
    df = spark.createDataFrame([(["b", "a", "b"], ["c", "a"], {"en": "x", "fr": "y"}, {"en": "z", "de": "w"})], "l array<string>, r array<string>, m map<string,string>, n map<string,string>")
    row = df.select(values.merge_lists(C("l"), C("r")).alias("a"), values.merge_maps(C("m"), C("n"), RUN).alias("m")).first()
    assert row.a == ["b", "a", "c"]
    assert row.m == {"en": f"x\n--- merged {RUN} ---\nz", "fr": "y", "de": "w"}


TAGS = {
    f"GT|{RUN}|src|{TIME}": ("src", None, None),
    f"note\n\n[GT-Tag]: GT|{RUN}|one|{TIME}\n\n[GT-Tag]: GT|{RUN}|two|{TIME}\ntail": ("two", None, None),
    f"GT|{RUN}|src|{TIME}|snap=aGk=|merge=eW8=": ("src", "hi", "yo"),
    f"GT|{RUN}|src|{TIME}|merge=eW8=": ("src", None, "yo"),
    f"GT|{RUN}|src|{TIME}|snap=!!!": ("src", None, None),
    f"GT|{RUN}|src|{TIME}|merge=eW8=|snap=aGk=": None,
    f"GT|{RUN}|src|{TIME}|snap=aGk=|merge=eW8=|x": None,
    f"GT|{RUN}|src|2026-06-19T15:00:01": None,
    f"GT|{RUN}|src": None,
    "": None,
}


@pytest.mark.parametrize("text", TAGS)
def test_parse_tag(spark, text):
    p = spark.createDataFrame([(text,)], "t string").select(residue.parse(C("t")).alias("p")).first().p
    assert (p and (p.source, p.snap, p.merge)) == TAGS[text]


def test_tags_round_trip_long_text(spark):
    df = spark.createDataFrame([("é" * 400,)], "t string")
    tag = residue.serialize(F.lit(RUN), F.lit("s"), F.lit(TIME), C("t"), C("t"))
    p = df.select(residue.parse(residue.carry(F.lit("prose"), F.lit("Other"), tag)).alias("p")).first().p
    assert p.snap == p.merge == "é" * 400


def test_writing_systems(spark):
    rank = lambda a, b: spark.range(1).select(values.ws_rank(F.lit(a), F.lit(b))).first()[0]
    assert [rank("ko", "ko"), rank("ko-x", "ko-y"), rank("koh", "ko-y"), rank("en", "ko"), rank("k", "k")] == [0, 1, 2, 3, 0]
    required = spark.createDataFrame([("en", "vernacular")], "ws_id string, kind string")
    empty = spark.createDataFrame([], "source_ws string, kind string, target_ws string, created boolean")
    with pytest.raises(ReconcileError):
        wsmap.require_complete(required, empty)
    extra = spark.createDataFrame([("en", "vernacular", "en", False), ("fr", "vernacular", "fr", False)], empty.schema)
    wsmap.require_complete(required, extra)
    with pytest.raises(ReconcileError):
        wsmap.require_complete(required, extra, strict=True)


def test_selection_rules():
    with pytest.raises(ReconcileError):
        Selection(frozenset({"pos"}), interactive=True)
    with pytest.raises(ReconcileError):
        Selection(frozenset({"pos"}), picks={"slots": frozenset({"s"})})
    with pytest.raises(ReconcileError):
        Selection(frozenset({"affixes"}))
    with pytest.raises(ReconcileError):
        RunContext("a", "a", RUN, TIME)


def test_picks(spark):
    df = seeds(spark, "Verb", "noun")
    assert {r.guid for r in selection.picked(df, seeds(spark, "VERB").select("guid")).collect()} == {"Verb"}
    assert selection.picked(df, seeds(spark).select("guid")).count() == 2


def objects(spark, *rows):
    return spark.createDataFrame(rows, "guid string, category string, owner_guid string, catalog_id string")


def test_run_from_preview_to_publish(spark, tmp_path):
    source = objects(spark, ("p1", "pos", None, None), ("p2", "pos", None, ""), ("g", "gram_categories", None, "cat"), ("e1", "entry", "p1", None))
    target = objects(spark, ("p1", "pos", None, None), ("old", "pos", None, None))
    required = spark.createDataFrame([("en", "vernacular")], "ws_id string, kind string")
    mapping = spark.createDataFrame([], "source_ws string, kind string, target_ws string, created boolean")
    chosen = Selection(frozenset({"pos", "entry", "gram_categories"}))
    assert run.preview(source, target, chosen, required, mapping).needed.count() == 1
    shown = run.preview(source, target, chosen, required, mapping.union(spark.createDataFrame([("en", "vernacular", "en", False)], mapping.schema)))
    verbs = {r.source_guid: (r.verb, r.reason) for r in shown.plan.collect()}
    assert verbs == {"p1": ("SKIP", "already_present_by_guid"), "p2": ("ADD", None), "g": ("SKIP", "gold_inviolable"), "e1": ("ADD", None)}
    context = snapshots.start_run("a", "b", dt.datetime(2026, 6, 19, 15))
    assert context.run_id == RUN
    text = run.move(context, shown, source, target, ["category", "owner_guid", "catalog_id"], f"file://{tmp_path}/new")
    assert '"entry": {"added": 1' in text
    after = spark.read.parquet(f"file://{tmp_path}/new")
    assert {r.guid for r in after.collect()} == {"p1", "p2", "old", "e1"}
    again = planning.plan_pieces(matching.presence(source.where("category <> 'gram_categories'"), after, ["guid"]), "pos")
    assert again.where("verb = 'ADD'").isEmpty()
    counted = report.by_category(shown.plan)
    report.require_conserved(counted, source.groupBy("category").agg(F.count("*").alias("n")))
    assert "total" in report.to_text(counted)
    assert snapshots.list_candidates(spark, f"file://{tmp_path}", "a") == ["new"]


def test_stale_plans_and_broken_targets_are_refused(spark, tmp_path):
    plan = planning.plan_pieces(seeds(spark, "a").withColumn("present", F.lit(False)), "pos")
    agreed = planning.signature(plan)
    planning.check_unchanged(plan, agreed)
    with pytest.raises(ReconcileError):
        planning.check_unchanged(plan.union(plan), agreed)
    with pytest.raises(ReconcileError):
        apply.publish(objects(spark, ("x", "pos", "nobody", None)), f"file://{tmp_path}/bad")
    with pytest.raises(ReconcileError):
        apply.publish(objects(spark, ("x", "pos", None, None), ("x", "pos", None, None)), f"file://{tmp_path}/bad")


def test_steps_and_placed_skips(spark):
    """Steps follow the order of application, places the order of declaration; unknown categories come last, repeated skips count
    once, and an empty table gives none."""
    rows = [("slots", "ADD", "b", None, None), ("entry", "SKIP", "c", "needs_manual", None), ("entry", "SKIP", "c", "needs_manual", None), ("slots", "SKIP", "z", "needs_manual", None), ("slots", "SKIP", "a", "needs_manual", "x"), ("other", "SKIP", "a", None, None)]
    plan = spark.createDataFrame(rows, "category string, verb string, source_guid string, reason string, detail string")
    steps = {(r.category, r.verb): (r.step, r.pieces) for r in report.by_step(plan).collect()}
    assert steps[("entry", "SKIP")][1] == 2 and steps[("other", "SKIP")] == (None, 1)
    assert steps[("entry", "SKIP")][0] < steps[("slots", "ADD")][0] == steps[("slots", "SKIP")][0]
    placed = sorted((r.place, r.category, r.source_guid) for r in report.placed_skips(plan).collect())
    assert placed == [(0, "slots", "a"), (1, "slots", "z"), (2, "entry", "c"), (3, "other", "a")]
    assert [(r.category, r.source_guid) for r in report.skips(plan).collect()] == [x[1:] for x in placed]
    assert report.placed_skips(plan.limit(0)).count() == 0
