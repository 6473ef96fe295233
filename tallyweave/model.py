"""Vocabularies and schemas of the data model. The lists are fixed values that results must share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Categories in order of declaration, which is the order of reports.
CATEGORIES = ("writing_systems_check", "gram_categories", "inflection_features", "custom_fields", "inflection_classes", "stem_names", "exception_features", "variant_types", "complex_form_types", "adhoc_rules", "compound_rules", "affixes", "slots", "templates", "pos", "entry", "sense", "msa", "allomorph", "ph_environment", "phonological_features", "phonemes", "natural_classes", "phonological_rules", "strata", "semantic_domains")
#: Categories that can be chosen but have no planner: asking for them is an error.
UNPLANNED = ("affixes", "adhoc_rules", "compound_rules")
#: Order in which categories are applied.
APPLY_ORDER = ("writing_systems_check", "phonological_features", "phonemes", "natural_classes", "ph_environment", "phonological_rules", "strata", "gram_categories", "pos", "inflection_features", "custom_fields", "inflection_classes", "stem_names", "exception_features", "variant_types", "complex_form_types", "semantic_domains", "entry", "sense", "msa", "allomorph", "slots", "templates")
SKIP_REASONS = ("unmapped_ws", "dependency_unresolved", "gold_inviolable", "guid_conflict_no_override", "unsupported_lcm_type", "bare_bones_missing_closure", "already_present_by_guid", "interactive_skip", "unmapped_ws_user_chose_skip", "needs_manual", "already_present_by_identity")
RESOLUTIONS = ("take_source", "keep_target", "merge", "skip", "edit_custom")
WS_CHOICES = ("map", "create", "skip")
#: Owner classes whose custom fields are scanned.
CUSTOM_OWNERS = ("LexEntry", "LexSense", "LexExampleSentence", "MoForm")
#: Value types that are never merged.
UNMERGEABLE = ("int", "bool", "null")

OBJECTS = "guid string, category string, class_name string, owner_guid string, owner_field string, ord int, catalog_id string"
PROPS = "guid string, field string, vtype string, s string, n long, b boolean, arr array<string>, ms map<string,string>"
REFS = "from_guid string, field string, to_guid string, ord int"
RESIDUE = "guid string, text string"
PLAN = "verb string, category string, source_guid string, target_guid string, match_via string, owner_guid string, reason string, detail string, pulled_in_by array<string>"


class ReconcileError(Exception):
    """A run that can't go on; the message says why."""


@dataclass(frozen=True)
class RunContext:
    """What a run is: two different snapshots, and one id and time for the whole run."""

    source: str
    target: str
    run_id: str
    started_at: str

    def __post_init__(self) -> None:
        if self.source == self.target:
            raise ReconcileError("source and target are the same snapshot")
        if not self.run_id.startswith("GT-"):
            raise ReconcileError("a run id starts with GT-")
        if "|" in self.source:
            raise ReconcileError("a source name can't hold the tag's separator")


@dataclass(frozen=True)
class Selection:
    """Which categories and picks a run covers. by_name: pieces that the target has neither under their id nor under one of
    ``remembered`` may be known there by their name."""

    categories: frozenset[str] = frozenset()
    closure: bool = True
    overwrite: bool = False
    interactive: bool = False
    picks: dict[str, frozenset[str]] = field(default_factory=dict)
    by_name: bool = False

    def __post_init__(self) -> None:
        if unknown := self.categories - set(CATEGORIES):
            raise ReconcileError(f"unknown categories: {sorted(unknown)}")
        if unplanned := self.categories & set(UNPLANNED):
            raise ReconcileError(f"no planner for: {sorted(unplanned)}")
        if missing := {k for k, v in self.picks.items() if v} - self.categories:
            raise ReconcileError(f"picks need their category: {sorted(missing)}")
        if self.interactive and not self.overwrite:
            raise ReconcileError("interactive merging needs overwriting")

    def on(self, category: str) -> bool:
        return category in self.categories


@dataclass(frozen=True)
class Snapshot:
    """One side of a run: objects, refs and props in the columns of OBJECTS, REFS and PROPS, custom fields (owner_class, name),
    and what earlier runs left: the texts that hold their tags (guid, text), and references between entries that still wait
    for their end (REFS; from_guid is here, to_guid is the source's id). version names a snapshot that a store has committed
    and that therefore can't change."""

    objects: DataFrame
    refs: DataFrame
    props: DataFrame
    custom_fields: DataFrame
    residue: DataFrame | None = None
    outbox: DataFrame | None = None
    version: str | None = None

    def of(self, *categories: str) -> DataFrame:
        return self.objects.where(self.objects.category.isin(*categories))

    def links(self, *fields: str) -> DataFrame:
        return self.refs.where(self.refs.field.isin(*fields))
