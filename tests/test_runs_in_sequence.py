"""Runs one after the other: typed facts, decisions, tags, outcomes, stale previews, commits, late references, writing systems."""

import json

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import residue
from tallyweave.model import OBJECTS, PROPS, REFS, RESIDUE, ReconcileError, RunContext, Selection, Snapshot
from tallyweave.operators import apply, conflicts, report, wsmap
from tallyweave.plans import run
from tallyweave.sources.store import Store

RUN, LATER = "GT-20260619-150000", "GT-20260620-150000"
FIRST = RunContext("src", "tgt", RUN, "2026-06-19T15:00:00")
SECOND = RunContext("src", "tgt", LATER, "2026-06-20T15:00:00")
DECISIONS = "guid string, field string, resolution string, custom_value string"


def fact(guid, field, value):
    """A row of PROPS whose type follows the value."""
    if isinstance(value, bool):
        return (guid, field, "bool", None, None, value, None, None)
    kinds = {str: ("str", 0), int: ("int", 1), list: ("list", 3), set: ("set", 3), dict: ("map", 4), type(None): ("null", 0)}
    vtype, at = kinds[type(value)]
    slots = [None] * 5
    slots[at] = sorted(value) if isinstance(value, set) else value
    return (guid, field, vtype, *slots)


def snapshot(spark, objects, refs=(), props=(), tags=None, outbox=None):
    """objects: guid, category, class, owner."""
    full = [(g, c, k, o, None, i, None) for i, (g, c, k, o) in enumerate(objects)]
    return Snapshot(
        spark.createDataFrame(full, OBJECTS), spark.createDataFrame([(a, f, b, i) for i, (a, f, b) in enumerate(refs)], REFS), spark.createDataFrame([fact(*p) for p in props], PROPS),
        spark.createDataFrame([], "owner_class string, name string"), None if tags is None else spark.createDataFrame(tags, RESIDUE), None if outbox is None else spark.createDataFrame(outbox, REFS),
    )


def nothing(spark):
    return spark.createDataFrame([], "ws_id string, kind string"), spark.createDataFrame([], "source_ws string, kind string, target_ws string, created boolean")


def shown(spark, s, t, *categories, **more):
    return run.preview(s, t, Selection(frozenset(categories), **{"overwrite": True, **more}), *nothing(spark))


def facts_of(props, guid):
    return {r.field: (r.vtype, r.s if r.s is not None else r.n if r.n is not None else r.b if r.b is not None else r.arr if r.arr is not None else r.ms) for r in props.where(F.col("guid") == guid).collect()}


POS, ENTRY = ("p", "pos", "PartOfSpeech", None), ("e", "entry", "LexEntry", None)
WORDS = (("se", "sense", "LexSense", "e"), ("m", "msa", "MoInflAffMsa", "e"))
LINKS = [("se", "MorphoSyntaxAnalysisRA", "m"), ("m", "PartOfSpeechRA", "p")]

SOURCE_FACTS = {"text": "new", "list": ["b", "c"], "set": {"b", "c"}, "names": {"en": "new", "fr": "neuf"}, "count": 7, "flag": True, "mixed": ["x"], "same list": ["u"], "only": ["s"], "scalar": 5, "edited": 1, "edited names": {"en": "b"}, "kept": ["k"], "left": "r", "CustomSet": {"2", "1"}, "none": None}
TARGET_FACTS = {"text": "old", "list": ["a", "b"], "set": {"d", "b"}, "names": {"en": "old", "de": "alt"}, "count": 8, "flag": False, "mixed": "old", "same list": ["u"], "here": {"en": "t"}, "scalar": "five", "edited": 2, "edited names": {"en": "a", "de": "c"}, "kept": ["l"], "left": "l", "CustomSet": {"1", "2"}, "none": "x"}
HOW = {"text": "merge", "list": "merge", "set": "merge", "names": "merge", "count": "merge", "flag": "take_source", "mixed": "merge", "scalar": "merge", "edited": "edit_custom", "edited names": "edit_custom", "kept": "keep_target", "left": "skip", "none": "take_source"}
CUSTOM = {"edited": "42", "edited names": "by hand"}
LINE = f"\n--- merged {RUN} ---\n"
AFTER = {
    "text": ("str", f"old{LINE}new"), "list": ("list", ["a", "b", "c"]), "set": ("set", ["b", "c", "d"]), "names": ("map", {"en": f"old{LINE}new", "fr": "neuf", "de": "alt"}), "count": ("int", 7), "flag": ("bool", True),
    "mixed": ("str", f"'old'{LINE}[\"x\"]"), "same list": ("list", ["u"]), "only": ("list", ["s"]), "here": ("map", {"en": "t"}), "scalar": ("int", 5), "edited": ("int", 42), "edited names": ("map", {"de": "by hand"}),
    "kept": ("list", ["l"]), "left": ("str", "l"), "CustomSet": ("set", ["1", "2"]), "none": ("null", None),
}


def lexicon(spark, facts, more=(), refs=(), **tables):
    return snapshot(spark, [POS, ENTRY, *WORDS, *more], [*LINKS, *refs], [("e", f, v) for f, v in facts.items()], **tables)


def decided(spark, how, custom=CUSTOM, guid="e"):
    return spark.createDataFrame([(guid, f, h, custom.get(f)) for f, h in how.items()], DECISIONS)


def test_facts_of_all_types_are_compared_merged_and_written(spark, tmp_path):
    s, t = lexicon(spark, SOURCE_FACTS), lexicon(spark, TARGET_FACTS)
    plan = shown(spark, s, t, "entry")
    asked = {r.field: (r.left_value, r.right_value, r.eligible) for r in conflicts.collected(plan.plan, s, t).collect()}
    assert set(asked) == set(HOW) and asked["names"] == ('{"de":"alt","en":"old"}', '{"en":"new","fr":"neuf"}', True) and asked["count"] == ("8", "7", False)
    text, done = run.move_snapshot(FIRST, plan, s, t, f"file://{tmp_path}/one", decided(spark, HOW))
    assert facts_of(spark.read.parquet(f"file://{tmp_path}/one/props"), "e") == AFTER
    entry = json.loads(text)["per_category"]["entry"]
    assert (entry["overwritten"], entry["skipped"], entry["interactive_skipped"], entry["interactive_resolved"], entry["carried_over"], entry["failed"], entry["ws_mapped"]) == (1, 1, 1, 13, 0, 0, 0)
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/one/skips").collect()] == [("entry", "e", "interactive_skip", "left")]
    snap = done.residue.where("guid = 'e'").select(residue.parse(F.col("text")).snap.alias("s")).first().s
    assert json.loads(snap)["names"] == '{"de":"alt","en":"old"}'
    _, won = run.move_snapshot(FIRST, plan, s, t, f"file://{tmp_path}/two")
    assert facts_of(won.props, "e")["list"] == ("list", ["b", "c"]) and facts_of(won.props, "e")["here"] == ("map", {"en": "t"})


def test_a_field_is_decided_once(spark, tmp_path):
    s, t = lexicon(spark, {"a": "new"}), lexicon(spark, {"a": "old"})
    twice = spark.createDataFrame([("e", "a", "take_source", None), ("e", "a", "merge", None)], DECISIONS)
    with pytest.raises(ReconcileError, match="several decisions"):
        run.move_snapshot(FIRST, shown(spark, s, t, "entry"), s, t, f"file://{tmp_path}/x", twice)


def test_tags_and_decisions_live_on_in_the_next_run(spark, tmp_path):
    s = lexicon(spark, {"a": "new", "b": ["n"]})
    t = lexicon(spark, {"a": "old", "b": ["o"]}, [("far", "entry", "LexEntry", None)], tags=[("p", "Prose that people wrote."), ("e", "an earlier text"), ("far", "left alone")])
    how = {"a": "keep_target", "b": "edit_custom"}
    _, first = run.move_snapshot(FIRST, shown(spark, s, t, "entry", "slots"), s, t, f"file://{tmp_path}/one", decided(spark, how, {"b": "by hand"}))
    texts = {r.guid: r.text for r in first.residue.collect()}
    assert texts["p"].startswith("Prose that people wrote.\n\n[GT-Tag]: GT|") and texts["e"].startswith("GT|") and texts["far"] == "left alone"
    again = first.snapshot(t.custom_fields)
    text, second = run.move_snapshot(SECOND, shown(spark, s, again, "entry", "slots"), s, again, f"file://{tmp_path}/two", accept_priors=True)
    assert facts_of(second.props, "e") == {"a": ("str", "old"), "b": ("list", ["by hand"])}
    entry = json.loads(text)["per_category"]["entry"]
    assert (entry["carried_over"], entry["interactive_resolved"]) == (2, 0)
    tags = {r.guid: r.text for r in second.residue.collect()}
    assert tags["p"].count("[GT-Tag]: ") == 2 and tags["p"].startswith("Prose that people wrote.") and tags["far"] == "left alone" and tags["e"].count("GT|") == 1
    log = json.loads(second.residue.where("guid = 'e'").select(residue.parse(F.col("text")).merge.alias("m")).first().m)
    assert {(d["field"], d["resolution"], d["prior_run_id"]) for d in log} == {("a", "keep_target", RUN), ("b", "edit_custom", RUN)}
    other = spark.createDataFrame([("e", "a", "take_source", None)], DECISIONS)  # a new decision goes before an old one
    _, third = run.move_snapshot(SECOND, shown(spark, s, again, "entry"), s, again, f"file://{tmp_path}/three", other, accept_priors=True)
    assert facts_of(third.props, "e") == {"a": ("str", "new"), "b": ("list", ["by hand"])}
    broken = Snapshot(again.objects, again.refs, again.props, again.custom_fields, again.residue.withColumn("text", F.lit("GT|no tag")))
    with pytest.raises(ReconcileError, match="no decision"):  # a tag that can't be read decides nothing
        run.move_snapshot(SECOND, shown(spark, s, broken, "entry"), s, broken, f"file://{tmp_path}/four", accept_priors=True)


def test_what_was_planned_and_what_was_done(spark, tmp_path):
    s = snapshot(spark, [("ph", "phonemes", "PhPhoneme", "set"), ("nc", "natural_classes", "PhNCSegments", None), ("nc2", "natural_classes", "PhNCSegments", None), ("st", "strata", "MoStratum", None), POS, ("f", "inflection_features", "FsClosedFeature", None), ("v", "inflection_features", "FsSymFeatVal", "f")],
                 [("nc", "SegmentsRC", "ph"), ("p", "ExceptionFeaturesOC", "v"), ("q", "ExceptionFeaturesOC", "v")])
    t = snapshot(spark, [("st", "strata", "MoStratum", None), POS])
    text, done = run.move_snapshot(FIRST, shown(spark, s, t, "phonemes", "natural_classes", "strata", "inflection_features", "exception_features"), s, t, f"file://{tmp_path}/x")
    got = {r.source_guid: (r.verb, r.outcome, r.why) for r in spark.read.parquet(f"file://{tmp_path}/x/outcomes").collect()}
    assert got["ph"] == ("ADD", "failed", "lacks owner no phoneme set") and got["nc"] == ("ADD", "failed", "lacks SegmentsRC ph")
    assert got["nc2"] == ("ADD", "done", None) and got["st"] == ("OVERWRITE", "done", None) and got["p::v"] == ("ADD", "done", None)
    counts = json.loads(text)["per_category"]
    assert (counts["natural_classes"]["added"], counts["natural_classes"]["failed"], counts["phonemes"]["added"], counts["phonemes"]["failed"]) == (1, 1, 0, 1)
    assert json.loads(text)["context"] == {"run_id": RUN, "source": "src", "target": "tgt", "started_at": "2026-06-19T15:00:00"} and json.loads(text)["mode"] == "move"
    assert list(counts) == ["inflection_features", "exception_features", "phonemes", "natural_classes", "strata"]
    with pytest.raises(ReconcileError, match="unaccounted"):
        report.require_conserved(report.by_outcome(done.outcomes), spark.createDataFrame([("strata", 2)], "category string, n long"))


def test_a_stale_preview_is_refused(spark, tmp_path):
    s, t = lexicon(spark, {"a": "new", "n": {"en": "x"}}), lexicon(spark, {"a": "old"})
    plan = shown(spark, s, t, "entry")
    changed = lexicon(spark, {"a": "older"})
    with pytest.raises(ReconcileError, match="target changed"):
        run.move_snapshot(FIRST, plan, s, changed, f"file://{tmp_path}/x")
    with pytest.raises(ReconcileError, match="source changed"):
        run.move_snapshot(FIRST, plan, lexicon(spark, {"a": "new", "n": {"en": "y"}}), t, f"file://{tmp_path}/x")
    with pytest.raises(ReconcileError, match="selection changed"):
        run.move_snapshot(FIRST, plan, s, t, f"file://{tmp_path}/x", selection=Selection(frozenset({"entry", "pos"}), overwrite=True))
    with pytest.raises(ReconcileError, match="mapping changed"):
        run.move_snapshot(FIRST, plan, s, t, f"file://{tmp_path}/x", mapping=spark.createDataFrame([("a", "v", "b", False)], "source_ws string, kind string, target_ws string, created boolean"))
    run.move_snapshot(FIRST, plan, s, t, f"file://{tmp_path}/x", selection=Selection(frozenset({"entry"}), overwrite=True), mapping=nothing(spark)[1])


def tables_of(s):
    return {"objects": s.objects, "refs": s.refs, "props": s.props, "custom_fields": s.custom_fields}


def test_a_commit_happens_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(ReconcileError, match="no snapshot"):
        store.read()
    t, s = lexicon(spark, {"a": "old"}), lexicon(spark, {"a": "new"}, [("e2", "entry", "LexEntry", None)])
    assert store.publish(tables_of(t), RUN, None) == 0
    broken = s.props.withColumn("s", F.when(F.col("guid") == "e", F.raise_error(F.lit("the executor died"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="the executor died"):
        store.publish(tables_of(s) | {"props": broken}, RUN, 0)
    assert store.versions() == [0] and facts_of(store.read().props, "e") == {"a": ("str", "old")} and store.read().objects.count() == 4
    assert len(store.recover()) == 1 and store.recover() == [] and store.read().objects.count() == 4
    with store.locked("one"):
        with pytest.raises(ReconcileError, match="locked by one"), store.locked("two"):
            pass
    with store.locked("two"):
        store.unlock("other")
        with pytest.raises(ReconcileError, match="locked by two"), store.locked("three"):
            pass
    before = store.read()
    plan = shown(spark, s, before, "entry")
    text, version = run.move_store(FIRST, plan, s, store)
    assert version == 1 and json.loads(text)["per_category"]["entry"]["overwritten"] == 1
    assert facts_of(before.props, "e") == {"a": ("str", "old")} and facts_of(store.read().props, "e") == {"a": ("str", "new")}
    assert store.read().residue.count() == 4 and store.table("outcomes").count() == store.table("outcomes", 1).count() > 0
    with pytest.raises(ReconcileError, match="target changed"):  # the preview was of version 0
        run.move_store(SECOND, plan, s, store)
    with pytest.raises(ReconcileError, match="another run"):
        store.publish(tables_of(s), LATER, 0)
    assert store.versions() == [0, 1] and store.recover() != []


def test_a_broken_target_is_not_published(spark):
    good = lexicon(spark, {"a": "x"})
    apply.check_target(good.objects, good.refs, good.props)
    for objects, refs, props, why in (
        (good.objects.union(good.objects), good.refs, good.props, "twice"), (good.objects.where("guid <> 'e'"), good.refs, good.props, "no owner"),
        (good.objects, good.refs.withColumn("to_guid", F.lit("?")), good.props, "to_guid"), (good.objects, good.refs, good.props.withColumn("guid", F.lit("?")), "no piece"), (good.objects, good.refs, good.props.union(good.props), "two facts"),
    ):
        with pytest.raises(ReconcileError, match=why):
            apply.check_target(objects, refs, props)


def test_references_between_entries_wait_for_their_end(spark, tmp_path):
    late = [("e2", "entry", "LexEntry", None), ("se2", "sense", "LexSense", "e2"), ("m2", "msa", "MoInflAffMsa", "e2"), ("e3", "entry", "LexEntry", None)]
    refs = [("se2", "MorphoSyntaxAnalysisRA", "m2"), ("m2", "PartOfSpeechRA", "p2"), ("e", "ComponentLexemesRS", "e2"), ("e", "PrimaryLexemesRS", "e3"), ("se", "TargetsRS", "m2")]
    s = lexicon(spark, {}, [*late, ("p2", "pos", "PartOfSpeech", None)], refs)
    t = snapshot(spark, [])
    _, first = run.move_snapshot(FIRST, run.preview(s, t, Selection(frozenset({"pos", "entry"}), picks={"pos": frozenset({"p"})}), *nothing(spark)), s, t, f"file://{tmp_path}/one")
    waiting = {(r.from_guid, r.field, r.to_guid) for r in first.outbox.collect()}
    assert waiting == {("e", "ComponentLexemesRS", "e2"), ("e", "PrimaryLexemesRS", "e3"), ("se", "TargetsRS", "m2")} and first.notes.count() == 0
    again = first.snapshot(t.custom_fields)
    _, second = run.move_snapshot(SECOND, run.preview(s, again, Selection(frozenset({"pos", "entry"}), picks={"pos": frozenset({"p2"})}), *nothing(spark)), s, again, f"file://{tmp_path}/two")
    new = {r.source_guid: r.target_guid for r in second.remap.collect()}
    linked = {(r.from_guid, r.field, r.to_guid) for r in second.refs.where("field IN ('ComponentLexemesRS', 'TargetsRS', 'PrimaryLexemesRS')").collect()}
    assert linked == {("e", "ComponentLexemesRS", "e2"), ("se", "TargetsRS", new["m2"])}
    assert {(r.from_guid, r.to_guid) for r in second.outbox.collect()} == {("e", "e3")}


def test_writing_systems_are_mapped_made_and_skipped_in_a_run(spark, tmp_path):
    more = [("e2", "entry", "LexEntry", None), ("se2", "sense", "LexSense", "e2"), ("m2", "msa", "MoInflAffMsa", "e2")]
    s = lexicon(spark, {"name": {"a": "one", "b": "two", "c": "three"}, "empty": {}, "gone": {"c": "three"}}, more, [("se2", "MorphoSyntaxAnalysisRA", "m2"), ("m2", "PartOfSpeechRA", "p")])
    s = Snapshot(s.objects, s.refs, s.props.union(spark.createDataFrame([fact("e2", "name", {"c": "only here", "a": " "})], PROPS)), s.custom_fields)
    t = snapshot(spark, [])
    required = spark.createDataFrame([(w, "vernacular") for w in "abc"], "ws_id string, kind string")
    empty = nothing(spark)[1]
    choices = spark.createDataFrame([("a", "vernacular", "map", "en"), ("b", "vernacular", "create", None), ("c", "vernacular", "skip", None)], "source_ws string, kind string, choice string, target_ws string")
    chosen = Selection(frozenset({"entry"}))
    assert run.preview(s, t, chosen, required, empty, choices.where("source_ws = 'a'")).needed.count() == 2
    plan = run.preview(s, t, chosen, required, empty, choices)
    rows = {r.source_guid: (r.verb, r.reason) for r in plan.plan.collect()}
    assert rows["e"] == ("ADD", None) and rows["e2"] == ("SKIP", "unmapped_ws_user_chose_skip")
    _, done = run.move_snapshot(FIRST, plan, s, t, f"file://{tmp_path}/x")
    assert facts_of(done.props, "e") == {"name": ("map", {"en": "one", "b": "two"}), "empty": ("map", {})}
    assert wsmap.in_target_systems(s.props.drop("ms"), empty, required).columns == [c for c in s.props.columns if c != "ms"]


def test_needs_fall_down_a_chain_in_a_run(spark):
    s = snapshot(spark, [("r", "phonological_rules", "PhRegularRule", None), ("r2", "phonological_rules", "PhRegularRule", None), ("nc", "natural_classes", "PhNCSegments", None)], [("r", "InputOS", "nc"), ("nc", "SegmentsRC", "nowhere"), ("r2", "StratumRA", "st")])
    t = snapshot(spark, [("st", "strata", "MoStratum", None)])
    plan = run.plan_run(s, t, Selection(frozenset({"phonological_rules", "natural_classes"})))
    assert {r.source_guid: (r.verb, r.detail) for r in plan.collect()} == {"r": ("SKIP", "nc"), "nc": ("SKIP", "nowhere"), "r2": ("ADD", None)}
