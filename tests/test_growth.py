"""What a run writes and shuffles: narrow keys instead of ids, and no more of the plan than can change."""

from pyspark.sql import functions as F

from tallyweave.functions import residue
from tallyweave.model import RunContext, Selection, Snapshot
from tallyweave.operators import apply, closure, conflicts, layers, matching
from tallyweave.plans import run
from tallyweave.sources import lexicon
from tallyweave.sources.scratch import stage

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_derived_pair_writes_keys_and_holds_what_the_staged_pair_holds(spark):
    views, staged = lexicon.derived_pair(spark, SF), lexicon.staged_pair(spark, SF)
    for a, b in zip(views, staged, strict=True):
        for t in ("objects", "refs", "props", "custom_fields"):
            x, y = (getattr(side, t).select(sorted(getattr(side, t).columns)) for side in (a, b))
            assert x.count() == y.count() and x.exceptAll(y).isEmpty()
    kept = [schema for (_, _, what), (_, put) in lexicon._kept.items() if what == "narrow" for _, schema in put]
    assert kept and all(f.dataType.typeName() != "string" or f.name in ("flag", "status") for schema in kept for f in schema.fields)


def test_target_references_are_made_without_joining_ids(spark):
    """Only ends of another table are held against it; none of the joins is on an id."""
    target = lexicon.derived_pair(spark, SF)[1]
    assert "Join" not in plan_text(target.links("SlotsRC")) and "Join" not in plan_text(target.links("StratumRA", "InputOS", "MorphTypeRA"))


def test_target_lacks_references_to_what_its_tables_lack(spark, tmp_path):
    """Suppliers, parts and nations that are missing take along the references to them."""
    for t in lexicon.TABLES:
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        where = {"part": "p_partkey % 5 <> 0", "supplier": "s_suppkey <> 1", "nation": "n_nationkey <> 3", "orders": "o_orderkey % 7 <> 0"}.get(t)
        (rows.where(where) if where else rows).write.parquet(f"{tmp_path}/{t}.parquet")
    target = lexicon.derived_pair(spark, f"file://{tmp_path}")[1]
    for end in ("from_guid", "to_guid"):
        assert target.refs.join(target.objects.select(F.col("guid").alias(end)), end, "left_anti").isEmpty()
    assert target.links("SlotsRC").count() > 0


def test_only_categories_of_two_planners_are_grouped(spark):
    s, t = lexicon.derived_pair(spark, SF)
    plan = run.plan_run(s, t, Selection(frozenset({"slots", "ph_environment"})))
    assert plan.where("category = 'ph_environment'").count() == s.of("ph_environment").count()
    assert plan.groupBy("category", "source_guid").count().where("count > 1").isEmpty()
    assert "Join" not in plan_text(plan)  # nothing here has needs


def test_retraction_asks_plan_and_target_for_the_ends_alone(spark):
    ids = lambda *x: spark.createDataFrame([(g,) for g in x], "guid string")
    refs = spark.createDataFrame([("a", "x"), ("b", "a"), ("c", "y"), ("d", None), ("e", "c"), ("o", "x")], "from_guid string, to_guid string")
    want = {("a", "x"), ("b", "a")}
    for asking in (None, ids("a", "b", "c", "d", "e")):
        got = closure.retracted(refs, ids("y", "y", "z"), ids("a", "b", "c", "d", "e", "w"), asking).collect()
        assert {(r.source_guid, r.detail) for r in got} == want
    assert closure.among(ids("y", "y", "z"), ids("y", "q")).collect() == [("y",)]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_least_ranks_are_found_without_sorting_the_hits(spark):
    hits = spark.createDataFrame([("a", 7, 3), ("a", 5, 9), ("a", 5, -2), ("b", 6, None), ("b", 6, -4), ("c", 0, 8)], "to_guid string, rank long, pos int")
    for low, high in ((-4, 9), (-(1 << 62), 1 << 62)):  # one number, and pairs
        got = closure._first_met(hits, 8, low, high)
        assert {tuple(r) for r in got.collect()} == {("a", 5, -2), ("b", 6, None), ("c", 0, 8)}
    assert "SortAggregate" not in physical(closure._first_met(hits, 8, -4, 9))


def test_places_are_numbered_without_another_shuffle(spark):
    rows = spark.createDataFrame([(i * 37 % 101, str(i)) for i in range(100)], "k long, guid string")
    got = closure.placed(rows, ["k", "guid"], "place")
    assert [r.place for r in sorted(got.collect(), key=lambda r: (r.k, r.guid))] == list(range(100))
    assert "Window" not in physical(got) and "hashpartitioning" not in physical(got)


def test_needs_are_dealt_once_and_carry_ends_alone(spark):
    own = closure.bucketed(spark.createDataFrame([("a", 1), ("b", 2)], "guid string, r long"), "guid", "nodes")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("c", "b", 1), ("a", "q", 1), (None, "b", 1)], "from_guid string, to_guid string, pos int")
    needs = closure._needs(own, edges)
    assert sorted(tuple(r) for r in needs.select("from_guid", "to_guid").collect()) == [("a", "b"), ("c", "b")] and len(needs.columns) == 2
    levels = closure.dependency_levels(own.select("guid"), edges).collect()
    assert {(r.guid, r.level) for r in levels} == {("a", 1), ("b", 0)}


def test_references_meet_one_table_at_either_end(spark):
    """New ids of the starts come in by the last join; before, references carried them to the target."""
    refs = spark.createDataFrame([("a", "f", "x", 1), ("b", "f", "x", 2), ("a", "f", "y", 3), ("a", "f", "z", 4), ("b", "f", "w", 5), ("a", "f", None, 6)], "from_guid string, field string, to_guid string, ord int")
    remap = spark.createDataFrame([("a", "A"), ("x", "X"), ("z", "gone"), ("w", None)], "source_guid string, target_guid string")
    target = spark.createDataFrame([(g,) for g in ("X", "x", "y", "y", "z", "w")], "guid string")
    got = matching.rewired(refs, remap, target)
    assert sorted(tuple(r) for r in got.collect()) == [("A", "f", "X", 1), ("A", "f", "y", 3), ("b", "f", "X", 2), ("b", "f", "w", 5)]
    assert "LeftOuter" in plan_text(got).splitlines()[1]


def test_tags_are_cut_once_and_only_parts_that_are_asked_for_are_decoded(spark):
    merge = residue.encode(F.lit('[{"field":"f","resolution":"skip","custom_value":null}]'))
    run, time = F.lit("GT-20260619-150000"), F.lit("2026-06-19T15:00:00")
    tag = residue.serialize(run, F.lit("src"), time, F.lit("{}"), F.lit('[{"field":"f","resolution":"skip","custom_value":null}]'))
    rows = spark.range(6).select("id", tag.alias("tag"), merge.alias("merge"))
    texts = F.element_at(F.array(F.col("tag"), F.concat(F.lit("a\n\n[GT-Tag]: "), "tag", F.lit("\nb")), F.lit("GT|x"), F.lit(""), F.lit(None).cast("string"), F.concat_ws("|", F.lit("GT"), run, F.lit("s"), time, F.lit("snap=!"))), (F.col("id") + 1).cast("int"))
    rows = spark.createDataFrame(rows.select("id", texts.alias("text")).collect(), "id long, text string")
    few = rows.select("id", residue.parse(F.col("text"), "run_id", "merge").alias("p"))
    whole = rows.select("id", residue.parse(F.col("text")).alias("p"))
    assert few.schema["p"].dataType.names == ["run_id", "merge"]
    want = [(r.id, r.p and (r.p.run_id, r.p.merge)) for r in whole.orderBy("id").collect()]
    assert [(r.id, r.p and tuple(r.p)) for r in few.orderBy("id").collect()] == want and [bool(p) for _, p in want] == [True, True, False, False, False, True]
    assert physical(few).split("\n")[0].count("split(") <= 2 and want[0][1][1].startswith("[{")
    prior = conflicts.prior_decisions(rows.select(F.col("id").cast("string").alias("guid"), F.lit("A").alias("carrier"), F.lit(1).alias("seq"), "text"))
    assert sorted(tuple(r) for r in prior.collect()) == [(g, "f", "skip", None, "GT-20260619-150000") for g in ("0", "1")]
    assert "Join" not in plan_text(prior)


def _joins(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_ids_are_not_broadcast_by_the_size_of_their_files(spark):
    """Half a million ids take less than a megabyte on disk and some 80 in a broadcast; a table that is small stays one."""
    ids = spark.range(500_000).select(F.concat(F.lit("allo-"), "id", F.lit("-1")).alias("guid"))
    left, right = stage(ids, "ids"), stage(ids.withColumnRenamed("guid", "other"), "ids")
    assert left.join(right, left.guid == right.other, "left_semi").agg(F.count("*")).first()[0] == 500_000
    assert "BroadcastHashJoin" not in _joins(left.join(right, left.guid == right.other, "left_semi").agg(F.count("*")))
    few = stage(ids.limit(25), "few")
    assert "BroadcastHashJoin" in _joins(left.join(few, "guid", "left_semi").agg(F.count("*")))


def test_a_larger_estimate_of_the_session_stays(spark):
    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    try:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "1000.0")
        stage(spark.range(1), "one")
        assert float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1000
    finally:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", before)


def test_a_run_writes_no_references_that_nobody_asks_for(spark, monkeypatch):
    """Created objects alone are asked for: neither references nor the objects of the target are written."""
    names = []
    write = apply.stage
    monkeypatch.setattr(apply, "stage", lambda df, name, by=None: names.append(name) or write(df, name, by))
    s, t = lexicon.derived_pair(spark, SF)
    plan = run.plan_run(s, t, Selection(frozenset({"natural_classes", "strata"})))
    done = apply.applied_snapshot(RunContext("src", "tgt", "GT-20260619-150000", "2026-06-19T15:00:00"), plan, s, t)
    assert done.objects.join(t.objects.select("guid"), "guid", "left_anti").count() > 0
    assert "created" in names and not {"refs", "objects"} & set(names)


def test_allomorphs_are_filtered_before_their_prints(spark):
    s, _ = lexicon.derived_pair(spark, SF)
    some = s.of("allomorph").where("ord % 2 = 0").select("guid", "owner_guid", "ord")
    own = layers.allomorph_prints(s, some)
    assert own.count() == some.count() and own.exceptAll(layers.allomorph_prints(s)).isEmpty()


def test_allomorphs_travel_without_digests(spark):
    """They are matched by form and type, as by their fingerprints: nothing counts as an empty text, and types by their letters alone."""
    s, t = lexicon.derived_pair(spark, SF)
    short = layers.within_entry(layers.allomorph_prints(s), layers.allomorph_prints(t), layers.ALIKE).select("guid", "target_guid", "ambiguous")
    assert "sha2" not in plan_text(short)
    whole = layers.within_entry(layers.allomorph_prints(s), layers.allomorph_prints(t)).select("guid", "target_guid", "ambiguous")
    assert short.count() == whole.count() and short.exceptAll(whole).isEmpty()
