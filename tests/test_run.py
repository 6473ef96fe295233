"""Whole runs on small snapshots built by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import residue
from tallyweave.model import OBJECTS, PROPS, REFS, ReconcileError, RunContext, Selection, Snapshot
from tallyweave.operators import apply, closure, layers, matching, planning
from tallyweave.plans import run
from tallyweave.sources import snapshots

RUN, TIME = "GT-20260619-150000", "2026-06-19T15:00:00"
CONTEXT = RunContext("src", "tgt", RUN, TIME)


def snapshot(spark, objects, refs=(), props=(), fields=()):
    full = [(g, c, k, o, None, i, cat) for i, (g, c, k, o, cat) in enumerate(objects)]
    facts = [(g, f, "str", v, None, None) for g, f, v in props]
    columns = [x for x in PROPS.split(", ") if x.split()[0] not in ("arr", "ms")]
    return Snapshot(
        spark.createDataFrame(full, OBJECTS), spark.createDataFrame([(a, f, b, i) for i, (a, f, b) in enumerate(refs)], REFS),
        spark.createDataFrame(facts, ", ".join(columns)), spark.createDataFrame(list(fields), "owner_class string, name string"),
    )


def source(spark):
    objects = [
        ("p", "pos", "PartOfSpeech", None, None), ("t", "templates", "MoInflAffixTemplate", "p", None), ("s", "slots", "MoInflAffixSlot", "p", None),
        ("e", "entry", "LexEntry", None, None), ("se", "sense", "LexSense", "e", None), ("m", "msa", "MoInflAffMsa", "e", None), ("m2", "msa", "MoStemMsa", "e", None),
        ("a1", "allomorph", "MoAffixAllomorph", "e", None), ("a2", "allomorph", "MoAffixAllomorph", "e", None), ("env", "ph_environment", "PhEnvironment", None, None),
        ("e2", "entry", "LexEntry", None, None), ("ph", "phonemes", "PhPhoneme", "set", None), ("nc", "natural_classes", "PhNCSegments", None, None),
    ]
    refs = [("t", "PrefixSlotsRS", "s"), ("se", "MorphoSyntaxAnalysisRA", "m"), ("m", "PartOfSpeechRA", "p"), ("m", "SlotsRC", "s"), ("a1", "PhoneEnvRC", "env"), ("a2", "PhoneEnvRC", "env"), ("nc", "SegmentsRC", "ph")]
    return snapshot(spark, objects, refs, [("e", "Name", "new"), ("a1", "Form", "x"), ("a2", "Form", "y")])


def plan_of(spark, s, t, chosen, **more):
    return {(r.category, r.source_guid): r for r in run.plan_run(s, t, Selection(frozenset(chosen), **more)).collect()}


def test_closure_pulls_in_what_a_slot_needs(spark):
    empty = snapshot(spark, [])
    got = plan_of(spark, source(spark), empty, {"slots"})
    assert {k: r.verb for k, r in got.items()} == {(c, g): "ADD" for c, g in (("pos", "p"), ("templates", "t"), ("slots", "s"), ("entry", "e"), ("sense", "se"), ("msa", "m"), ("allomorph", "a1"), ("allomorph", "a2"), ("ph_environment", "env"))}
    assert {k[1]: list(r.pulled_in_by) for k, r in got.items()} == {"p": ["p"], "t": ["p"], "s": [], "e": ["p"], "se": ["e"], "m": ["se"], "a1": ["e"], "a2": ["e"], "env": ["a1"]}
    layer = plan_of(spark, source(spark), empty, {"sense"})  # the part of speech that owns the sense comes along, no template
    assert {k[1] for k in layer} == {"p", "e", "se", "m", "a1", "a2", "env"} and list(layer["pos", "p"].pulled_in_by) == ["p"]
    alone = plan_of(spark, source(spark), empty, {"sense", "ph_environment"}, closure=False)
    assert {k[1] for k in alone} == {"se", "env"} and list(alone["ph_environment", "env"].pulled_in_by) == []
    with pytest.raises(ReconcileError):
        run.plan_run(source(spark), empty, Selection(frozenset({"writing_systems_check"})))
    with pytest.raises(ReconcileError):
        run.for_category("affixes")


def test_needs_that_are_not_met(spark):
    s, target = source(spark), snapshot(spark, [])
    got = plan_of(spark, s, target, {"natural_classes"})
    assert (got["natural_classes", "nc"].verb, got["natural_classes", "nc"].reason, got["natural_classes", "nc"].detail) == ("SKIP", "dependency_unresolved", "ph")
    both = run.plan_run(s, target, Selection(frozenset({"natural_classes", "phonemes"})))
    assert {r.verb for r in both.collect()} == {"ADD"}
    objects, notes = apply.created(both, s, target)  # no phoneme set in the target, so no phoneme and no class of it
    assert objects.count() == 0
    assert {(r.source_guid, r.field, r.severity) for r in notes.collect()} == {("ph", "owner", "fatal"), ("nc", "SegmentsRC", "fatal")}
    sets = snapshot(spark, [("other", "phoneme_sets", "PhPhonemeSet", None, None), ("second", "phoneme_sets", "PhPhonemeSet", None, None)])
    assert {r.guid: r.owner_guid for r in apply.created(both, s, sets)[0].collect()} == {"ph": "other", "nc": None}


def test_a_snapshot_is_moved_twice(spark, tmp_path):
    s, t = source(spark), snapshot(spark, [("p", "pos", "PartOfSpeech", None, None)])
    required = spark.createDataFrame([], "ws_id string, kind string")
    mapping = spark.createDataFrame([], "source_ws string, kind string, target_ws string, created boolean")
    shown = run.preview(s, t, Selection(frozenset({"slots"}), overwrite=True), required, mapping)
    text, done = run.move_snapshot(CONTEXT, shown, s, t, f"file://{tmp_path}/first")
    assert '"msa": {"added": 1' in text
    after = {r.guid: r for r in done.objects.collect()}
    new = {r.source_guid: r.target_guid for r in done.remap.collect()}
    assert set(new) == {"m", "a1", "a2"} and after[new["a1"]].owner_field == "LexemeFormOA" and after[new["a2"]].owner_field == "AlternateFormsOS"
    refs = {(r.from_guid, r.field, r.to_guid) for r in done.refs.collect()}
    assert refs == {("t", "PrefixSlotsRS", "s"), ("se", "MorphoSyntaxAnalysisRA", new["m"]), (new["m"], "PartOfSpeechRA", "p"), (new["m"], "SlotsRC", "s"), (new["a1"], "PhoneEnvRC", "env"), (new["a2"], "PhoneEnvRC", "env")}
    assert {r.guid for r in done.residue.collect()} == set(after)
    tags = done.residue.select(residue.parse(F.col("text")).alias("p")).select("p.run_id").distinct().collect()
    assert [r.run_id for r in tags] == [RUN]

    edited = done.props.withColumn("s", F.when(F.col("field") == "Name", "old").otherwise(F.col("s")))
    again = Snapshot(done.objects, done.refs, edited, t.custom_fields)
    shown = run.preview(s, again, Selection(frozenset({"slots", "entry"}), overwrite=True), required, mapping)
    verbs = {r.source_guid: (r.verb, r.target_guid, r.match_via) for r in shown.plan.collect()}
    assert {v for v, _, _ in verbs.values()} == {"OVERWRITE"} and verbs["m"] == ("OVERWRITE", new["m"], "fingerprint") and verbs["a2"][1] == new["a2"]
    undecided = spark.createDataFrame([], "guid string, field string, resolution string, custom_value string")
    with pytest.raises(ReconcileError):
        run.move_snapshot(CONTEXT, shown, s, again, f"file://{tmp_path}/second", undecided)
    kept = spark.createDataFrame([("e", "Name", "keep_target", None)], undecided.schema)
    _, second = run.move_snapshot(CONTEXT, shown, s, again, f"file://{tmp_path}/third", kept)
    assert {r.guid for r in second.objects.collect()} == set(after)
    assert {(r.from_guid, r.field, r.to_guid) for r in second.refs.collect()} == refs
    assert second.props.where("guid = 'e'").first().s == "old" and second.remap.count() == 3
    assert spark.read.parquet(f"file://{tmp_path}/third/residue").count() == len(after)


def test_walks_are_as_deep_as_the_tree(spark):
    chain = [(f"n{i}", "x", "X", f"n{i - 1}" if i else None, None) for i in range(130)]
    got = closure.walk_tree(snapshot(spark, chain).objects.select("guid", "owner_guid"))
    assert {r.guid: (r.depth, r.root) for r in got.collect()} == {f"n{i}": (i, "n0") for i in range(130)}


def test_names_targets_and_first_pieces(spark):
    context = snapshots.start_run("a", "b", dt.datetime(2026, 6, 19, 15))
    assert snapshots.bind_target(context, ["b", "c"]) == "b"
    with pytest.raises(ReconcileError):
        snapshots.bind_target(context, ["c"])
    pieces = spark.createDataFrame([("x", False), ("y", False)], "guid string, present boolean")
    plan = planning.plan_pieces(pieces, "pos").withColumn("ord", F.when(F.col("source_guid") == "y", 1).otherwise(2))
    assert [r.source_guid for r in planning.first_planned(plan, "pos").collect()] == ["y"]
    assert planning.first_planned(plan, "slots").count() == 0 and planning.count_of(plan, "pos") == 2
    s = source(spark)
    assert {(r.from_guid, r.to_guid) for r in layers.dependency_edges(s).collect()} == {("nc", "ph")}
    assert matching.presence(s.of("pos"), s.of("pos"), ["guid"]).first().present


def test_pair_is_staged_once_while_its_tables_stay(spark, tmp_path):
    """A second call opens the same files; tables written anew, or staged folders that are gone, are derived again."""
    import shutil

    from tallyweave.sources import lexicon

    for t in lexicon.TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    files = lambda pair: {f for side in pair for f in side.refs.inputFiles()}
    first = lexicon.staged_pair(spark, str(tmp_path))
    rows = {tuple(r) for r in first[1].objects.collect()}
    assert files(lexicon.staged_pair(spark, str(tmp_path))) == files(first)
    spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").where("s_suppkey <> 1").toPandas().to_parquet(tmp_path / "supplier.parquet")
    changed = lexicon.staged_pair(spark, str(tmp_path))
    assert not files(changed) & files(first) and {tuple(r) for r in changed[1].objects.collect()} < rows
    gone = changed[0].refs.inputFiles()[0].removeprefix("file://").split("/field=")[0]
    shutil.move(gone, tmp_path / "elsewhere")
    again = lexicon.staged_pair(spark, str(tmp_path))
    assert not files(again) & files(changed) and again[0].refs.count() > 0
