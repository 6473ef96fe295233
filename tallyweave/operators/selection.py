"""Selection: category and pick filters, and the picker's tree of templates, slots and affixes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.model import CUSTOM_OWNERS, Selection, Snapshot

#: Categories that make a run walk parts of speech and what lies below them.
WALKED = ("pos", "templates", "slots", "entry", "sense", "msa", "allomorph")


def walked_poses(source: Snapshot, selection: Selection) -> DataFrame | None:
    """Parts of speech to walk: none if no category below them is on, else those picked, else all."""
    if not any(map(selection.on, WALKED)):
        return None
    wanted = [(g,) for g in sorted(selection.picks.get("pos", ()))]
    return picked(source.of("pos"), source.objects.sparkSession.createDataFrame(wanted, "guid string"))


def scanned_fields(fields: DataFrame) -> DataFrame:
    """Custom fields (owner_class, name) of the owner classes that are scanned."""
    return fields.where(F.col("owner_class").isin(*CUSTOM_OWNERS)).distinct()


def build_selection(template_slots: DataFrame, slot_affixes: DataFrame, unbound: DataFrame, picks: DataFrame, extra: Iterable[str] = (), closure: bool = True) -> tuple[Selection, DataFrame, DataFrame]:
    """(selection, affixes, templates) of the picker: what its picks require, and templates on if there are any.

    Affixes have no planner, so their picks come back as a table beside the selection and turn no category on."""
    affixes = required_affixes(template_slots, slot_affixes, unbound, picks)
    templates = required_templates(template_slots, picks)
    on = frozenset(extra) | (frozenset({"templates"}) if not templates.isEmpty() else frozenset())
    return Selection(on, closure=closure), affixes, templates


def selected(df: DataFrame, categories: Iterable[str]) -> DataFrame:
    return df.where(F.col("category").isin(*categories))


def picked(pieces: DataFrame, picks: DataFrame, key: str = "guid") -> DataFrame:
    """Pieces whose key is picked, whatever the case; all of them if nothing is picked. picks: one column, ``key``."""
    if picks.isEmpty():
        return pieces
    wanted = picks.select(F.lower(F.col(key)).alias("_pick"))
    return pieces.join(wanted, F.lower(pieces[key]) == F.col("_pick"), "left_semi")


def required_affixes(template_slots: DataFrame, slot_affixes: DataFrame, unbound: DataFrame, picks: DataFrame) -> DataFrame:
    """affix: those checked, those of checked slots, those of the slots of checked templates; unknown ids are ignored."""
    of = lambda level, name: picks.where(F.col("level") == level).select(F.col("guid").alias(name)).distinct()
    slots = of("slot", "slot").union(template_slots.join(of("template", "template"), "template").select("slot")).distinct()
    known = slot_affixes.select("affix").union(unbound.select("affix")).distinct()
    return known.join(of("affix", "affix"), "affix", "left_semi").union(slot_affixes.join(slots, "slot", "left_semi").select("affix")).distinct()


def required_templates(template_slots: DataFrame, picks: DataFrame) -> DataFrame:
    checked = picks.where("level = 'template'").select(F.col("guid").alias("template"))
    return template_slots.select("template").distinct().join(checked, "template", "left_semi")


def all_affixes(slot_affixes: DataFrame, unbound: DataFrame) -> DataFrame:
    return slot_affixes.select("affix").union(unbound.select("affix")).distinct()


def picker_state(children: DataFrame) -> DataFrame:
    """(parent, checked) from (parent, child, checked): a parent is checked when all its children are."""
    return children.groupBy("parent").agg(F.every("checked").alias("checked"))


def all_templates(template_slots: DataFrame) -> DataFrame:
    return template_slots.select("template").distinct()
