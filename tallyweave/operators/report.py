"""Counts by category, their checks, and their printed forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.model import APPLY_ORDER, CATEGORIES, ReconcileError, RunContext
from tallyweave.operators.closure import placed

COUNTS = ("added", "overwritten", "skipped", "closure_pulled_in", "interactive_skipped")
#: Counters of printed reports that nothing adds to.
UNUSED = ("interactive_resolved", "ws_mapped", "ws_created", "ws_skipped")


def by_category(plan: DataFrame) -> DataFrame:
    """One row for each category of the plan. Skips count once for each piece and reason."""
    unique = plan.where("verb <> 'SKIP'").unionByName(plan.where("verb = 'SKIP'").dropDuplicates(["category", "source_guid", "reason"]))
    is_verb = lambda v: F.count_if(F.col("verb") == v)
    pulled = F.count_if((F.col("verb") == "ADD") & (F.size("pulled_in_by") > 0))
    chosen = F.count_if((F.col("verb") == "SKIP") & (F.col("reason") == "interactive_skip"))
    return unique.groupBy("category").agg(*(x.alias(n) for x, n in zip((is_verb("ADD"), is_verb("OVERWRITE"), is_verb("SKIP"), pulled, chosen), COUNTS, strict=True)))


def by_outcome(outcomes: DataFrame) -> DataFrame:
    """``by_category`` of what was done (outcomes of ``apply.outcomes``), and ``failed``: plan rows that came to nothing. Skips
    count once for each piece, reason and field."""
    done = outcomes.where("outcome <> 'failed'")
    keys = ["category", "source_guid", "reason", F.when(F.col("reason") == "interactive_skip", F.col("detail")).alias("detail")]
    skips = done.where("verb = 'SKIP'").select(*keys).distinct()
    kept = done.where("verb <> 'SKIP'").select("category", "verb", F.size("pulled_in_by").alias("parents"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("bad"))
    rows = kept.unionByName(skips.select("category", F.lit("SKIP").alias("verb"), F.lit(0).alias("parents"), "reason", F.lit(0).alias("bad")))
    rows = rows.unionByName(outcomes.where("outcome = 'failed'").select("category", F.lit("NONE").alias("verb"), F.lit(0).alias("parents"), F.lit(None).cast("string").alias("reason"), F.lit(1).alias("bad")))
    is_verb = lambda v: F.count_if(F.col("verb") == v)
    counts = (is_verb("ADD"), is_verb("OVERWRITE"), is_verb("SKIP"), F.count_if((F.col("verb") == "ADD") & (F.col("parents") > 0)), F.count_if(F.col("reason") == "interactive_skip"))
    return rows.groupBy("category").agg(*(x.alias(n) for x, n in zip(counts, COUNTS, strict=True)), F.sum("bad").cast("long").alias("failed"))


def with_choices(report: DataFrame, decided: DataFrame | None) -> DataFrame:
    """The report with interactive_resolved and carried_over by category: fields whose decision was made in this run, and those
    that took an earlier run's. decided: category, prior_run_id for each field."""
    if decided is None:
        return report.select("*", *(F.lit(0).cast("long").alias(c) for c in ("interactive_resolved", "carried_over")))
    fresh = F.col("prior_run_id").isNull()
    counts = decided.groupBy("category").agg(F.count_if(fresh).alias("interactive_resolved"), F.count_if(~fresh).alias("carried_over"))
    return report.join(counts, "category", "left").na.fill(0, ["interactive_resolved", "carried_over"])


def with_unused(report: DataFrame) -> DataFrame:
    """The report with the counters that stay 0."""
    return report.select("*", *(F.lit(0).cast("long").alias(c) for c in UNUSED))


def totals(report: DataFrame) -> DataFrame:
    return report.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))


def conservation(report: DataFrame, enumerated: DataFrame) -> DataFrame:
    """Categories whose added + overwritten + skipped (+ failed, where the report has it) isn't what was enumerated (category,
    n): must be empty."""
    both = report.join(enumerated, "category", "full_outer")
    done = F.coalesce(F.col("added") + F.col("overwritten") + F.col("skipped") + (F.col("failed") if "failed" in report.columns else F.lit(0)), F.lit(0))
    return both.select("category", done.alias("accounted"), F.coalesce("n", F.lit(0)).alias("enumerated")).where("accounted <> enumerated")


def require_conserved(report: DataFrame, enumerated: DataFrame) -> None:
    if bad := [r.category for r in conservation(report, enumerated).limit(30).collect()]:
        raise ReconcileError(f"pieces unaccounted for in {sorted(bad)}")


def empty_categories(selected: DataFrame, report: DataFrame) -> DataFrame:
    """Selected categories that the plan has nothing of."""
    return selected.select("category").distinct().join(report.select("category"), "category", "left_anti")


def _ordered(report: DataFrame) -> list:
    return sorted(report.collect(), key=lambda r: CATEGORIES.index(r.category) if r.category in CATEGORIES else len(CATEGORIES))


def to_json(report: DataFrame, run_id: str, seconds: float, mode: str | None = None, context: RunContext | None = None) -> str:
    """At most a row for each category reaches the driver. Categories stand in order of declaration, counters that nothing
    adds to are 0; with a context the run's names and start come along. Skips and remaps are tables of any size and are
    written beside the report (``skips``, ``remaps``)."""
    counters = [*COUNTS, *(c for c in (*UNUSED, "failed", "carried_over") if c in report.columns)]
    rows = {r.category: {c: r[c] for c in counters} | {c: 0 for c in UNUSED if c not in counters} for r in _ordered(report)}
    out: dict[str, object] = {"mode": mode} if mode else {}
    if context is not None:
        out["context"] = {"run_id": context.run_id, "source": context.source, "target": context.target, "started_at": context.started_at}
    return json.dumps(out | {"run_id": run_id, "wall_clock_seconds": round(seconds, 3), "per_category": rows})


def category_rank(category: Column) -> Column:
    """The place of a category in order of declaration; unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), category)
    return F.when(place > 0, place).otherwise(len(CATEGORIES) + 1)


def skips(outcomes: DataFrame) -> DataFrame:
    """category, source_guid, reason, detail of all skips, once each, in order of category, id and reason."""
    rows = outcomes.where("verb = 'SKIP'").select("category", "source_guid", "reason", "detail").distinct()
    return rows.orderBy(category_rank(F.col("category")), "source_guid", "reason", "detail")


def placed_skips(outcomes: DataFrame) -> DataFrame:
    """``skips`` with their place from 0 in that order, as a table that keeps its order wherever it is written: sorted ranges are
    numbered one after the other, so no task sees more than its range."""
    rows = outcomes.where("verb = 'SKIP'").select("category", "source_guid", "reason", "detail").distinct()
    ranked = rows.withColumn("_rank", category_rank(F.col("category")))
    return placed(ranked, ["_rank", "source_guid", "reason", "detail"], "place").drop("_rank")


def by_step(plan: DataFrame) -> DataFrame:
    """step, category, verb, pieces: what a plan does, by the step (from 1) in which its categories are carried out. Categories
    without a step have none (null) and are reported all the same."""
    step = F.array_position(F.array(*map(F.lit, APPLY_ORDER)), F.col("category"))
    counts = plan.groupBy("category", "verb").agg(F.count("*").alias("pieces"))
    return counts.select(F.when(step > 0, step).alias("step"), "category", "verb", "pieces")


def remaps(remap: DataFrame) -> DataFrame:
    """source_guid, target_guid in order of the source's id."""
    return remap.select("source_guid", "target_guid").distinct().orderBy("source_guid", "target_guid")


def to_text(report: DataFrame) -> str:
    rows = _ordered(report)
    lines = ["  ".join(["category".ljust(24), *COUNTS])]
    lines += ["  ".join([r.category.ljust(24), *(str(r[c]).rjust(len(c)) for c in COUNTS)]) for r in rows]
    return "\n".join([*lines, "  ".join(["total".ljust(24), *(str(sum(r[c] for r in rows)).rjust(len(c)) for c in COUNTS)])])
