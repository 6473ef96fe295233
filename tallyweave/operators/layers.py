"""What lies below a part of speech: entries with their senses, analyses, allomorphs and environments; dependency edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.values import FINGERPRINTS
from tallyweave.model import Selection, Snapshot
from tallyweave.operators.conflicts import typed
from tallyweave.operators.matching import first_sighting, match, presence
from tallyweave.operators.planning import plan_pieces, plan_row, union
from tallyweave.sources.scratch import bucketed, stage

#: The class of analyses that inflecting affixes have, and the layer that closure pulls in below a part of speech.
INFLECTING = "MoInflAffMsa"
LAYER = ("entry", "sense", "msa", "allomorph", "ph_environment")
#: Reference fields of rules that name what they need: stratum, segments, contexts.
RULE_FIELDS = ("StratumRA", "MembersRS", "SegmentsRC", "FeaturesOA", "InputOS", "OutputOS")


def analysed_senses(source: Snapshot, poses: DataFrame) -> DataFrame:
    """(sense, entry, msa, pos): senses whose analysis is an inflecting one that points at one of ``poses`` (guid)."""
    senses = source.of("sense").select(F.col("guid").alias("sense"), F.col("owner_guid").alias("entry"))
    has = source.links("MorphoSyntaxAnalysisRA").select(F.col("from_guid").alias("sense"), F.col("to_guid").alias("msa"))
    kinds = source.of("msa").where(F.col("class_name") == INFLECTING).select(F.col("guid").alias("msa"))
    points = source.links("PartOfSpeechRA").select(F.col("from_guid").alias("msa"), F.col("to_guid").alias("pos"))
    points = points.join(poses.select(F.col("guid").alias("pos")).distinct(), "pos", "left_semi")
    return senses.join(has, "sense").join(kinds, "msa", "left_semi").join(points, "msa").select("sense", "entry", "msa", "pos")


def msa_prints(side: Snapshot) -> DataFrame:
    """(guid, owner_guid, ord, fp) of inflecting analyses: entry, class, part of speech and the set of slots."""
    own = side.of("msa").where(F.col("class_name") == INFLECTING).select("guid", "owner_guid", "class_name", "ord")
    pos = side.links("PartOfSpeechRA").groupBy(F.col("from_guid").alias("guid")).agg(F.min("to_guid").alias("pos"))
    slots = side.links("SlotsRC").groupBy(F.col("from_guid").alias("guid")).agg(F.collect_set("to_guid").alias("slots"))
    fp = FINGERPRINTS["msa"](F.lower("owner_guid"), F.col("class_name"), F.col("pos"), F.coalesce("slots", F.array().cast("array<string>")))
    return own.join(pos, "guid", "left").join(slots, "guid", "left").select("guid", "owner_guid", "ord", fp.alias("fp"))


def allomorph_prints(side: Snapshot, of: DataFrame | None = None) -> DataFrame:
    """(guid, owner_guid, ord, form, kind, fp) of allomorphs (all, or those ``of`` a table of guid, owner_guid, ord); fp is entry, form and
    morph type, and form and kind are what it is made of, where nothing counts as an empty text."""
    form = side.props.where("field = 'Form'").groupBy("guid").agg(F.min("s").alias("form"))
    kind = side.links("MorphTypeRA").groupBy(F.col("from_guid").alias("guid")).agg(F.min("to_guid").alias("kind"))
    own = side.of("allomorph").select("guid", "owner_guid", "ord") if of is None else of
    own = own.join(form, "guid", "left").join(kind, "guid", "left")
    parts = (F.coalesce("form", F.lit("")).alias("form"), F.coalesce(F.lower("kind"), F.lit("")).alias("kind"))
    return own.select("guid", "owner_guid", "ord", *parts, FINGERPRINTS["allomorph"](F.lower("owner_guid"), F.col("form"), F.col("kind")).alias("fp"))


#: Categories that are known by their name, and what else belongs to it: the owner, the class or nothing.
NAMED = {"gram_categories": None, "pos": None, "slots": "owner_guid", "templates": "owner_guid", "inflection_features": "class_name"}


def name_prints(side: Snapshot, category: str, default_ws: str = "en") -> DataFrame:
    """(guid, fp, ord) of a category's pieces that have a name (field Name: a text, or one by writing system, of which that in
    ``default_ws`` counts, else the first by system); fp is the registry's fingerprint of name, owner or class."""
    facts = typed(side.props).where("field = 'Name'")
    entries = F.array_sort(F.map_entries("ms"))
    text = F.coalesce("s", F.try_element_at("ms", F.lit(default_ws)), F.get(entries, F.lit(0))["value"])
    named = facts.select("guid", text.alias("name")).where("name IS NOT NULL AND trim(name) <> ''").groupBy("guid").agg(F.min("name").alias("name"))
    more = [F.lower(NAMED[category])] if NAMED[category] else []
    return side.of(category).join(named, "guid").select("guid", FINGERPRINTS[category](F.concat_ws("\u001f", "name", *more)).alias("fp"), "ord")


def known_by_name(plan: DataFrame, source: Snapshot, target: Snapshot, remap: DataFrame | None = None) -> DataFrame:
    """(category, source_guid, target_guid, via, ambiguous) of pieces that the plan would add though the target has them: under an
    id that an earlier run gave them (``remap``), or under the same name. Of targets of one name the first counts."""
    spark = plan.sparkSession
    remap = remap if remap is not None else spark.createDataFrame([], "source_guid string, target_guid string")
    parts = []
    for category in NAMED:
        adds = plan.where((F.col("verb") == "ADD") & (F.col("category") == category)).select(F.col("source_guid").alias("guid"))
        own = adds.join(name_prints(source, category).select("guid", "fp"), "guid", "left")
        ids = target.of(category).select("guid", "ord").join(name_prints(target, category).select("guid", "fp"), "guid", "left")
        found = match(own, ids, remap).where("via <> 'none'")
        parts.append(found.select(F.lit(category).alias("category"), F.col("guid").alias("source_guid"), "target_guid", "via", "ambiguous"))
    return union(parts)


def recognised(plan: DataFrame, known: DataFrame, overwrite: bool) -> DataFrame:
    """The plan with its pieces among ``known`` overwritten or skipped instead of added; either keeps the target's id, to which
    references to them lead."""
    k = known.select("category", "source_guid", F.col("target_guid").alias("_to"), F.col("via").alias("_via"))
    joined = plan.join(k, ["category", "source_guid"], "left")
    hit = F.col("_to").isNotNull() & (F.col("verb") == "ADD")
    new = {"verb": F.lit("OVERWRITE" if overwrite else "SKIP"), "target_guid": F.col("_to"), "match_via": F.col("_via")}
    if not overwrite:
        new |= {"reason": F.lit("already_present_by_identity"), "detail": F.concat(F.col("_to"), F.lit(" is alike"))}
    return joined.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in plan.columns))


#: What alike allomorphs of an entry have in common; it is shorter than its digest, and packs better.
ALIKE = ("form", "kind")


def within_entry(source_prints: DataFrame, target_prints: DataFrame, keys: tuple[str, ...] = ("fp",)) -> DataFrame:
    """source prints with target_guid (of those under the same entry that have the same keys the first, else null) and ambiguous. Digests
    travel as bytes, half as long as their text; none does where the keys are others."""
    packed = lambda p: p.withColumn("fp", F.unhex("fp")) if "fp" in keys else p.drop("fp")
    source_prints, target_prints = packed(source_prints), packed(target_prints)
    first = target_prints.groupBy("owner_guid", *keys).agg(F.min_by("guid", F.struct("ord", "guid")).alias("target_guid"), F.count("*").alias("_n"))
    joined = source_prints.join(first, ["owner_guid", *keys], "left")
    out = joined.withColumn("ambiguous", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_n")
    return out.withColumn("fp", F.lower(F.hex("fp"))) if "fp" in keys else out


def _matched_rows(matched: DataFrame, category: str, overwrite: bool, parents: Column) -> DataFrame:
    """Pieces that can't keep their id: those with a match are overwritten or skipped, others added."""
    there = F.col("target_guid").isNotNull()
    verb = F.when(there, "OVERWRITE" if overwrite else "SKIP").otherwise("ADD")
    reason = F.when(there & F.lit(not overwrite), "already_present_by_identity")
    detail = F.when(reason.isNotNull(), F.concat(F.col("target_guid"), F.lit(" is alike")))
    target = F.when(verb != "SKIP", F.coalesce("target_guid", "guid"))
    return matched.select(*plan_row(category, verb, reason, detail, target, F.when(there, "fingerprint").otherwise("none"), F.col("owner_guid"), parents))


def plan_layer(source: Snapshot, target: Snapshot, poses: DataFrame, selection: Selection) -> DataFrame | None:
    """Plan rows of all that lies below ``poses`` (guid): with closure on all five levels, else those that are selected.

    A sense follows its entry. Analyses and allomorphs are matched by fingerprint within their entry; an environment counts
    once, at its first sighting by entry, allomorph and place, with that allomorph as its parent."""
    wanted = [c for c in LAYER if selection.closure or selection.on(c)]
    if not wanted:
        return None
    senses = stage(analysed_senses(source, poses), "senses")
    entries = stage(senses.groupBy(F.col("entry").alias("guid")).agg(F.array_sort(F.collect_set("pos")).alias("poses")), "entries")
    there = presence(entries, target.of("entry"), ["guid"])
    none = F.array().cast("array<string>")
    parts = []
    if "entry" in wanted:
        parts.append(plan_pieces(there, "entry", selection.overwrite, none if selection.on("entry") else F.col("poses")))
    if "sense" in wanted:
        owned = senses.select(F.col("sense").alias("guid"), F.col("entry").alias("owner_guid")).distinct()
        owned = owned.join(there.select(F.col("guid").alias("owner_guid"), "present"), "owner_guid")
        parts.append(plan_pieces(owned, "sense", selection.overwrite, F.array("owner_guid")))
    if "msa" in wanted:
        of = senses.groupBy(F.col("msa").alias("guid")).agg(F.array_sort(F.collect_set("sense")).alias("senses"))
        parts.append(_matched_rows(within_entry(msa_prints(source).join(of, "guid"), msa_prints(target)), "msa", selection.overwrite, F.col("senses")))
    allomorphs = source.of("allomorph").join(entries.select(F.col("guid").alias("owner_guid")), "owner_guid", "left_semi").select("guid", "owner_guid", "ord")
    if {"allomorph", "ph_environment"} <= set(wanted):
        allomorphs = bucketed(allomorphs, "guid", "allomorphs")  # dealt by id once, for either
    if "allomorph" in wanted:
        prints = allomorph_prints(source, allomorphs)
        parts.append(_matched_rows(within_entry(prints, allomorph_prints(target), ALIKE), "allomorph", selection.overwrite, F.array("owner_guid")))
    if "ph_environment" in wanted:
        of = allomorphs.select(F.col("guid").alias("allomorph"), F.col("owner_guid").alias("entry"), F.col("ord").alias("at"))
        seen = source.links("PhoneEnvRC").select(F.col("from_guid").alias("allomorph"), F.col("to_guid").alias("guid"), "ord").join(of, "allomorph")
        first = first_sighting(seen, "guid", ["entry", "at", "allomorph", "ord"])
        parts.append(plan_pieces(presence(first, target.of("ph_environment"), ["guid"]), "ph_environment", selection.overwrite, F.array("allomorph")))
    return union(parts)


def _edges(refs: DataFrame, category: str, needed: Column) -> DataFrame:
    return refs.select(F.lit(category).alias("from_cat"), "from_guid", needed.alias("to_cat"), "to_guid", "field", "ord")


def variant_edges(side: Snapshot) -> DataFrame:
    """Variant types need the feature values of their constraint; plain entry types have none."""
    kinds = side.of("variant_types").where("class_name = 'LexEntryInflType'").select(F.col("guid").alias("from_guid"))
    return _edges(side.links("InflFeatsOA").join(kinds, "from_guid", "left_semi"), "variant_types", F.lit("inflection_features"))


def class_edges(side: Snapshot) -> DataFrame:
    """Natural classes of segments need their phonemes; those of features own what they hold."""
    kinds = side.of("natural_classes").where("class_name = 'PhNCSegments'").select(F.col("guid").alias("from_guid"))
    return _edges(side.links("SegmentsRC").join(kinds, "from_guid", "left_semi"), "natural_classes", F.lit("phonemes"))


def rule_edges(side: Snapshot) -> DataFrame:
    """Phonological rules need their stratum, and the segments and contexts of their sides."""
    rules = side.of("phonological_rules").select(F.col("guid").alias("from_guid"))
    needed = F.when(F.col("field") == "StratumRA", "strata").otherwise("phonemes")
    return _edges(side.links(*RULE_FIELDS).join(rules, "from_guid", "left_semi"), "phonological_rules", needed)


def dependency_edges(side: Snapshot) -> DataFrame:
    """All edges that categories with dependencies have; every other category has none."""
    return union([variant_edges(side), class_edges(side), rule_edges(side)])


def owned_values(side: Snapshot, category: str, owner_category: str) -> DataFrame:
    """Pieces of a category that lie in collections of their owners, flattened: (guid, owner_guid, ord)."""
    owners = side.of(owner_category).select(F.col("guid").alias("owner_guid"))
    return side.of(category).join(owners, "owner_guid", "left_semi").select("guid", "owner_guid", "ord")


def wired_pairs(side: Snapshot, owner_category: str, field: str) -> DataFrame:
    """(owner, value): references out of a collection of their owners, flattened to pairs."""
    owners = side.of(owner_category).select(F.col("guid").alias("from_guid"))
    return side.links(field).join(owners, "from_guid", "left_semi").select(F.col("from_guid").alias("owner"), F.col("to_guid").alias("value")).distinct()
