"""Fingerprints, gold test, merges and writing-system likeness as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.model import UNMERGEABLE


def is_gold(catalog_id: str | Column) -> Column:
    """A piece with a catalog id is never touched."""
    return F.coalesce(F.col(catalog_id) if isinstance(catalog_id, str) else catalog_id, F.lit("")) != ""


def fingerprint(*parts: Column) -> Column:
    """A digest of the parts; a null part counts as empty, so nulls match each other. Arrays count as sets."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def as_set(values: Column) -> Column:
    return F.concat_ws("\u001e", F.array_sort(F.array_distinct(values)))


def msa_fingerprint(owner: Column, class_name: Column, pos: Column, slots: Column) -> Column:
    return fingerprint(F.lit("msa"), owner, class_name, F.lower(pos), as_set(slots))


def allomorph_fingerprint(owner: Column, form: Column, morph_type: Column) -> Column:
    return fingerprint(F.lit("allomorph"), owner, form, F.lower(morph_type))


def name_fingerprint(category: str, name: Column) -> Column:
    """For categories whose only identity besides the guid is a name."""
    return fingerprint(F.lit(category), name)


#: Category to a builder of its fingerprint.
FINGERPRINTS = {"msa": msa_fingerprint, "allomorph": allomorph_fingerprint} | {c: (lambda name, c=c: name_fingerprint(c, name)) for c in ("gram_categories", "pos", "slots", "templates", "inflection_features")}


def merge_eligible(left_type: Column, right_type: Column) -> Column:
    return ~left_type.isin(*UNMERGEABLE) & ~right_type.isin(*UNMERGEABLE)


def merge_text(left: Column, right: Column, run_id: str) -> Column:
    """Both texts around a line that names the run."""
    return F.concat(left, F.lit(f"\n--- merged {run_id} ---\n"), right)


def merge_lists(left: Column, right: Column) -> Column:
    """Left order, then what only the right has; no value twice."""
    return F.array_union(left, right)


def merge_sets(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_union(left, right))


def merge_maps(left: Column, right: Column, run_id: str) -> Column:
    """By key: one-sided entries pass, shared ones merge as texts."""
    return F.map_zip_with(left, right, lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge_text(a, b, run_id)))


def ws_rank(source: Column, target: Column) -> Column:
    """0 equal, 1 same language, 2 same first two letters, 3 other."""
    a, b = F.split(source, "-")[0], F.split(target, "-")[0]
    alike = (F.length(a) >= 2) & (F.length(b) >= 2) & (F.substring(a, 1, 2) == F.substring(b, 1, 2))
    return F.when(source == target, 0).when(a == b, 1).when(alike, 2).otherwise(3)
