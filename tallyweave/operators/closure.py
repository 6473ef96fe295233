"""Closure over ownership and references, its visit order, and dependency levels."""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.model import ReconcileError
from tallyweave.operators.planning import union
from tallyweave.sources.scratch import bucketed, stage

#: Pieces of a level up to which their ids stand in the filters as literals.
LITERALS = 512
#: Partitions whose offsets are broadcast (16 MB at the utmost); those of more are joined.
MOST_PARTS = 1 << 20
#: Ids a partition up to which those that a level asks for are hashed (some 100 bytes each) instead of sorted with the edges.
HASHED = 2_000_000


def walk_tree(objects: DataFrame) -> DataFrame:
    """(guid, depth, root) of every object that a root owns; objects: guid, owner_guid. Level by level, each a join of the
    frontier with the objects, however deep the tree is."""
    owned = stage(objects.where("owner_guid IS NOT NULL").select("guid", "owner_guid"), "owned")
    level = stage(objects.where("owner_guid IS NULL").select("guid", F.lit(0).alias("depth"), F.col("guid").alias("root")), "tree")
    out = level
    for depth in count(1):
        above = level.select(F.col("guid").alias("owner_guid"), "root")
        level = stage(owned.join(above, "owner_guid").select("guid", F.lit(depth).alias("depth"), "root"), "tree")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        if depth % 50 == 49:
            out = stage(out, "tree")  # plans stay short


def rooted(objects: DataFrame, roots: DataFrame) -> DataFrame:
    """walk_tree of what ``roots`` (guid) own, for instance one list of possibilities; the roots have depth 0."""
    own = objects.join(roots.select("guid"), "guid", "left_anti").select("guid", "owner_guid").where("owner_guid IS NOT NULL")
    return walk_tree(own.unionByName(roots.select("guid", F.lit(None).cast("string").alias("owner_guid"))))


class Runs:
    """Rows by guid that grow level by level: bucketed tables, of which EIGHT of one size are merged into one, and up to HELD
    last rows that came in small lots. A row is rewritten a logarithmic number of times, and looking up ids shuffles none."""

    EIGHT, HELD = 8, 4096

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self.tiers: list[list[DataFrame]] = [[]]
        self.held: list[tuple] = []

    def add(self, rows: DataFrame) -> DataFrame:
        """Keep a table; gives it back as it was written."""
        run = bucketed(rows, "guid", "run")
        self._file(run, 0)
        return run

    def _file(self, run: DataFrame, tier: int) -> None:
        while len(self.tiers) <= tier:
            self.tiers.append([])
        self.tiers[tier].append(run)
        if len(self.tiers[tier]) >= self.EIGHT:
            whole, self.tiers[tier] = union(self.tiers[tier]), []
            self._file(bucketed(whole, "guid", "run"), tier + 1)

    def put(self, rows: list[tuple]) -> None:
        """Keep a few rows, guid first."""
        self.held += rows
        if len(self.held) > self.HELD:
            self.add(self.spark.createDataFrame(self.held, self.schema))
            self.held = []

    def tables(self) -> list[DataFrame]:
        return [*(r for tier in self.tiers for r in tier), *([self.spark.createDataFrame(self.held, self.schema)] if self.held else [])]

    def of(self, ids: list[str]) -> list[tuple]:
        """All rows of a few ids."""
        wanted = set(ids)
        found = [r for r in self.held if r[0] in wanted]
        runs = [r.where(F.col("guid").isin(ids)) for tier in self.tiers for r in tier]
        return found + ([tuple(r) for r in union(runs).collect()] if runs else [])

    def without(self, rows: DataFrame) -> DataFrame:
        """rows whose guid isn't here: shuffled once, and held against one table after the other."""
        for t in self.tables():
            rows = rows.join(t.select("guid"), "guid", "left_anti")
        return rows

    def touching(self, rows: DataFrame) -> list[DataFrame]:
        """The rows here of the guids in ``rows``, table by table."""
        ids = rows.select("guid")
        return [t.join(ids, "guid", "left_semi") for t in self.tables()]

    def all(self) -> DataFrame:
        return union(self.tables()) if self.tables() else self.spark.createDataFrame([], self.schema)


def few(rows: DataFrame) -> list[Row] | None:
    """The rows if they are at most LITERALS, else None."""
    head = rows.limit(LITERALS + 1).collect()
    return head if len(head) <= LITERALS else None


def hashed(ids: DataFrame, n: int) -> DataFrame:
    """n different ids as the side of a join that is held in memory, if a partition's share of them is small enough."""
    return ids.hint("shuffle_hash") if n <= HASHED * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ids


def walk(seeds: DataFrame, edges: DataFrame, ranked: bool = True) -> DataFrame:
    """(guid, level, rank): breadth-first closure of seeds (guid, ord) over edges (from_guid, to_guid, pos); without ``ranked``
    rank is null, and neither ord nor pos is asked for. Null ids are ignored.

    rank is the visit order: seeds in theirs; then by the first parent's rank and the place in its list. Edges are bucketed
    by their start, so a level joins them without shuffling them; a level of at most LITERALS pieces asks for these alone,
    which reads their buckets only, writes nothing and so costs what it reaches. What was seen is kept in ``Runs``. Cycles end
    because nothing is visited twice. Ranks of a wide level are numbered by range-partitioned sort."""
    return _walked(seeds, _by_start(edges, ["pos"] if ranked else []), ranked).all().select("guid", "level", "rank")


def _by_start(edges: DataFrame, more: list[str]) -> DataFrame:
    return bucketed(edges.select("from_guid", "to_guid", *more).where("from_guid IS NOT NULL AND to_guid IS NOT NULL"), "from_guid", "edges")


def _walked(seeds: DataFrame, table: DataFrame, ranked: bool) -> Runs:
    """What ``walk`` sees over edges that are bucketed by their start."""
    spark = table.sparkSession
    seen = Runs(spark, "guid string, level int, rank long")
    seeds = seeds.where("guid IS NOT NULL")
    no = F.lit(None).cast("long")
    if ranked:
        fresh = seeds.groupBy("guid").agg(F.min("ord").cast("long").alias("k1")).withColumn("k2", F.lit(0).cast("long"))
    else:
        fresh = seeds.select("guid").distinct().select("guid", no.alias("k1"), no.alias("k2"))
    bounds = table.agg(F.min("pos"), F.max("pos")).first() if ranked else None
    base, wide = 0, True
    for level in count():
        fresh = bucketed(fresh, "guid", "reached", dealt=True) if wide else fresh
        rows = few(fresh)
        if rows is not None:
            known = {r[0] for r in seen.of([r.guid for r in rows])} if level else set()
            order = sorted((r for r in rows if r.guid not in known), key=lambda r: (*((k is not None, k or 0) for k in (r.k1, r.k2)), r.guid.encode()))
            new = [(r.guid, level, base + i if ranked else None) for i, r in enumerate(order)]
            if not new:
                break
            seen.put(new)
            frontier = F.broadcast(spark.createDataFrame(new, seen.schema).select(F.col("guid").alias("from_guid"), "rank"))
            hits, n, wide = table.where(F.col("from_guid").isin([r[0] for r in new])).join(frontier, "from_guid"), len(new), False
        else:
            new = seen.without(fresh)
            new = _numbered(new, base, level) if ranked else new.select("guid", F.lit(level).alias("level"), no.alias("rank"))
            run = seen.add(new)
            n = run.count()
            if not n:
                break
            hits, wide = table.join(hashed(run.select(F.col("guid").alias("from_guid"), "rank"), n), "from_guid"), True
        base += n
        fresh = _first_met(hits, base, *bounds) if ranked else hits.select(F.col("to_guid").alias("guid")).distinct().select("guid", no.alias("k1"), no.alias("k2"))
    return seen


def _first_met(hits: DataFrame, ranks: int, low: int | None, high: int | None) -> DataFrame:
    """(guid, k1, k2): the least rank (below ``ranks``) that leads to each guid, and the least pos (low to high, null first)
    there. Both are one number where that fits a long, since a minimum of pairs would have all hits sorted."""
    guid = F.col("to_guid").alias("guid")
    span = 1 if low is None else high - low + 2
    if ranks * span >= 1 << 63:
        best = hits.groupBy(guid).agg(F.min(F.struct(F.col("rank").alias("k1"), F.col("pos").cast("long").alias("k2"))).alias("k"))
        return best.select("guid", "k.k1", "k.k2")
    at = F.coalesce(F.col("pos").cast("long") - F.lit(low or 0) + 1, F.lit(0)).cast("long")
    best = hits.groupBy(guid).agg(F.min(F.col("rank") * F.lit(span).cast("long") + at).alias("k"))
    k2 = F.col("k") % F.lit(span).cast("long")
    return best.select("guid", F.expr(f"k div {span}L").alias("k1"), F.when(k2 > 0, k2 - 1 + F.lit(low or 0)).cast("long").alias("k2"))


def _numbered(rows: DataFrame, base: int, level: int) -> DataFrame:
    """rows with rank = base + position by (k1, k2, guid)."""
    return placed(rows, ["k1", "k2", "guid"], "place").select("guid", F.lit(level).alias("level"), (F.lit(base) + F.col("place")).alias("rank"))


def placed(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """rows with their position from 0 in ``order``: sorted ranges, numbered as they are written, with the sizes of those before."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = stage(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_place", within), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each partition
    offsets = stage(sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")), "offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= MOST_PARTS else offsets.hint("merge")
    return parts.join(offsets, "_part").withColumn(column, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def pulled_in_by(visited: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(guid, parent, pos): every edge from a visited piece to one that isn't a seed; repeated edges stay repeated."""
    hits = edges.join(visited.select(F.col("guid").alias("from_guid")), "from_guid", "left_semi")
    return hits.join(seeds.select(F.col("guid").alias("to_guid")), "to_guid", "left_anti").select(F.col("to_guid").alias("guid"), F.col("from_guid").alias("parent"), "pos")


def walked_with_parents(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``pulled_in_by`` of all that ``walk`` visits from ``seeds`` (guid): the edges are bucketed by their start once, for both."""
    table = _by_start(edges, ["pos"])
    return pulled_in_by(_walked(seeds, table, False).all(), seeds, table)


def peeled(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(guid, level, top) of nodes (guid, r) that lie neither in nor behind a cycle of edges (from_guid needs to_guid).

    level is 0 for what needs nothing, else one more than the deepest need; top is the greatest r among a node and all that it
    needs, directly or not. Needs that a level fulfils are counted for those that have them; a node is next when its count is
    full. The needs are dealt once, by what is needed; what a node must count to is kept beside it. A wide level is one write of
    the level and one of its counts, a small one (LITERALS) none. More than ``most`` levels are refused."""
    own = bucketed(_once(nodes, "r"), "guid", "nodes", dealt=True)
    return _peeled(own, _needs(own, edges), most)


def _once(nodes: DataFrame, column: str) -> DataFrame:
    """(guid, column), one row of each guid."""
    return nodes.where("guid IS NOT NULL").groupBy("guid").agg(F.any_value(column).alias(column))


def _needs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The different edges that end at one of ``nodes`` (bucketed), bucketed by that end."""
    ends = hashed(nodes.select(F.col("guid").alias("to_guid")), nodes.count())
    within = lambda e: e.join(ends, "to_guid", "left_semi").groupBy("to_guid", "from_guid").agg(F.lit(1).alias("_one")).drop("_one")
    return bucketed(edges.select("from_guid", "to_guid").where("from_guid IS NOT NULL"), "to_guid", "needs", within)


def _peeled(nodes: DataFrame, table: DataFrame, most: int | None = None) -> DataFrame:
    """``peeled`` of nodes bucketed by guid and their ``_needs``."""
    spark = nodes.sparkSession
    totals = table.groupBy(F.col("from_guid").alias("guid")).agg(F.count("*").alias("total"))
    info = bucketed(nodes.select("guid", "r").join(totals, "guid", "left"), "guid", "totals")
    kind = nodes.schema["r"].dataType.simpleString()
    done, counts = Runs(spark, f"guid string, level int, top {kind}"), Runs(spark, f"guid string, n long, top {kind}")
    ready = info.where("total IS NULL").select("guid", F.col("r").alias("top"))
    small: list[tuple] | None = None
    for level in count():
        if small is None:
            run = bucketed(ready.select("guid", F.lit(level).alias("level"), "top"), "guid", "level")
            n = run.count()
            if not n:
                break
            done._file(run, 0)
            rows = few(run) if n <= LITERALS else None
            frontier = hashed(run.select(F.col("guid").alias("to_guid"), "top"), n)
        else:
            rows = [Row(guid=g, level=level, top=top) for g, top in small]
            if not rows:
                break
            done.put([(r.guid, level, r.top) for r in rows])
        if level == most:
            raise ReconcileError(f"pieces lie deeper than {most} levels")
        if rows is not None:
            few_rows = spark.createDataFrame([(r.guid, level, r.top) for r in rows], done.schema)
            frontier = F.broadcast(few_rows.select(F.col("guid").alias("to_guid"), "top"))
        own = table if rows is None else table.where(F.col("to_guid").isin([r.guid for r in rows]))
        hits = own.join(frontier, "to_guid").groupBy(F.col("from_guid").alias("guid")).agg(F.count("*").alias("n"), F.max("top").alias("top"))
        some = few(hits) if rows is not None else None
        if some is not None:
            ids = [r.guid for r in some]
            of = {r.guid: (r.r, r.total) for r in info.where(F.col("guid").isin(ids)).collect()} if ids else {}
            before: dict[str, list] = {}
            for g, n, top in counts.of(ids):
                before.setdefault(g, []).append((n, top))
            counts.put([(r.guid, r.n, r.top) for r in some])
            full = [r for r in some if r.guid in of and r.n + sum(n for n, _ in before.get(r.guid, ())) == of[r.guid][1]]
            small = [(r.guid, max([of[r.guid][0], r.top, *(top for _, top in before.get(r.guid, ()))])) for r in full]
            continue
        small = None
        hits = bucketed(hits, "guid", "hits", dealt=True)
        sums = hits
        if counts.tables():
            sums = union([hits, *counts.touching(hits)]).groupBy("guid").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        ready = info.join(sums, "guid").where("n = total").select("guid", F.greatest("r", "top").alias("top"))
        counts._file(hits, 0)
    return done.all()


def dependency_levels(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(guid, level): 0 for pieces that depend on nothing, else one more than their deepest dependency; null in or behind a
    cycle. More than ``most`` levels are refused."""
    own = bucketed(_once(nodes.select("guid", F.lit(0).alias("r")), "r"), "guid", "nodes", dealt=True)
    found = _peeled(own, _needs(own, edges), most).select("guid", "level")
    return own.select("guid").join(found, "guid", "left")


def dependency_places(ranked: DataFrame, edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(guid, place): the order of ``dependency_order`` for ranked (guid, rank) and edges (from_guid needs to_guid), at any size.

    Taking ready pieces by rank, all that has nothing above a rank within it and its needs comes before anything that has. So
    pieces are numbered by rank and guid, and sort by the greatest number among themselves and their needs, their top. Of the
    pieces of one top, the one that has this number comes first. Where no need is left among the others, they follow by number;
    where some are, a heap orders them, a task for each top; with more than ``most`` pieces and needs, they are taken apart by
    their own tops once more. Pieces in or behind cycles come last, by number. One range sort by these keys places all."""
    own = ranked.select("guid", F.col("rank").cast("long").alias("rank")).where("guid IS NOT NULL").groupBy("guid").agg(F.min("rank").alias("rank"))
    own = bucketed(placed(stage(own, "ranked"), ["rank", "guid"], "r").select("guid", "r"), "guid", "ranked")
    needs = _needs(own, edges)
    tops = own.join(_peeled(own, needs).select("guid", "top"), "guid", "left")
    work = stage(tops.select("guid", "r", "top", F.array("top").alias("key")), "work")
    at = lambda df, step, cyclic=0: df.select("guid", "r", "key", step.cast("long").alias("step"), F.lit(cyclic).alias("cyclic"))
    parts = [at(work.where("top IS NULL").withColumn("key", F.array().cast("array<bigint>")), F.lit(0), 1)]
    work = work.where("top IS NOT NULL")
    edges = _same_top(needs, work.where("top <> r"), "guid")
    while True:
        parts.append(at(work.where("top = r"), F.lit(0)))
        loads = edges.groupBy("top").agg(F.count("*").alias("needs"))
        sizes = work.where("top <> r").groupBy("top").agg(F.count("*").alias("pieces")).join(loads, "top", "left")
        sizes = stage(sizes.select("top", (F.col("pieces") + F.col("needs")).alias("load")), "loads")
        rest = stage(work.where("top <> r").join(sizes, "top"), "rest")
        parts.append(at(rest.where("load IS NULL"), F.lit(1)))
        pieces = rest.where(F.col("load") <= most)
        small = edges.join(sizes.where(F.col("load") <= most), "top", "left_semi").select("top", F.col("from_r").alias("r"), "to_r")
        heaps = pieces.select("top", "r", F.lit(None).cast("long").alias("to_r")).unionByName(small).groupBy("top").applyInPandas(_heap, "r long, step long")
        parts.append(at(pieces.join(heaps, "r"), F.col("step")))
        large = rest.where(F.col("load") > most)
        if large.isEmpty():
            break
        edges = edges.join(large.select("top").distinct(), "top", "left_semi").select("from_r", "to_r")
        text = lambda df, **c: df.select(*(F.col(a).cast("string").alias(b) for b, a in c.items()))
        tops = peeled(large.select(F.col("r").cast("string").alias("guid"), "r"), text(edges, from_guid="from_r", to_guid="to_r"))
        tops = tops.select(F.col("guid").cast("long").alias("r"), F.col("top").alias("_top"))
        work = stage(large.join(tops, "r").select("guid", "r", F.col("_top").alias("top"), F.concat("key", F.array("_top")).alias("key")), "work")
        edges = _same_top(edges, work.where("top <> r"), "r")
    return placed(union(parts), ["cyclic", "key", "step", "r"], "place").select("guid", "place")


def _same_top(edges: DataFrame, rest: DataFrame, end: str) -> DataFrame:
    """(top, from_r, to_r): different edges whose ends (their ``end``) lie among ``rest`` (guid, r, top) and share their top."""
    side = lambda c: rest.select(F.col(end).alias(f"{c}_{end}"), F.col("r").alias(f"_{c}"), F.col("top").alias(f"_{c}_top"))
    both = edges.join(side("to"), f"to_{end}").join(side("from"), f"from_{end}").where("_from_top = _to_top")
    return stage(both.select(F.col("_to_top").alias("top"), F.col("_from").alias("from_r"), F.col("_to").alias("to_r")).distinct(), "inner")


def _heap(rows: pd.DataFrame) -> pd.DataFrame:
    """Steps (from 1) of the pieces of one top."""
    of = rows.r[rows.to_r.isna()].astype("int64").tolist()
    needs = rows[rows.to_r.notna()]
    order = dependency_order([(r, r) for r in of], list(zip(needs.r.astype("int64").tolist(), needs.to_r.astype("int64").tolist(), strict=True)), len(of))
    return pd.DataFrame({"r": order, "step": range(1, len(order) + 1)})


def dependency_order(ranked: list[tuple[str, int]], edges: list[tuple[str, str]], most: int = 1_000_000) -> list[str]:
    """Dependencies first, ties by rank, pieces of cycles last by rank: an exact order for one plan's pieces.

    It needs a priority queue, so it works on a list; more than ``most`` pieces are refused (use dependency_levels)."""
    if len(ranked) > most:
        raise ReconcileError(f"{len(ranked)} pieces are too many for an exact order")
    rank = dict(ranked)
    needs: dict[str, set[str]] = {g: set() for g in rank}
    users: dict[str, list[str]] = {g: [] for g in rank}
    for user, need in edges:
        if user in rank and need in rank and need not in needs[user]:
            needs[user].add(need)
            users[need].append(user)
    heap = [(rank[g], g) for g in rank if not needs[g]]
    heapq.heapify(heap)
    out = []
    while heap:
        g = heapq.heappop(heap)[1]
        out.append(g)
        for user in users[g]:
            needs[user].discard(g)
            if not needs[user]:
                heapq.heappush(heap, (rank[user], user))
    placed = set(out)
    return out + sorted((g for g in rank if g not in placed), key=lambda g: (rank[g], g))


def unresolved(refs: DataFrame, target: DataFrame, planned: DataFrame) -> DataFrame:
    """SKIP rows of pieces with a reference that is neither in the target nor planned; the detail lists them in order."""
    known = target.select(F.col("guid").alias("to_guid")).union(planned.select(F.col("guid").alias("to_guid"))).distinct()
    missing = refs.join(known, "to_guid", "left_anti").distinct()
    return _unresolved_rows(missing)


def _unresolved_rows(missing: DataFrame) -> DataFrame:
    detail = F.array_join(F.array_sort(F.collect_set("to_guid")), ", ")
    return missing.groupBy(F.col("from_guid").alias("source_guid")).agg(detail.alias("detail")).select("source_guid", F.lit("SKIP").alias("verb"), F.lit("dependency_unresolved").alias("reason"), "detail")


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(guid), once each, of those in ``ids`` (staged, different) that rows (guid) hold: few ids are sent to the rows, which then
    aren't shuffled."""
    few_ids = F.broadcast(ids) if ids.count() <= MOST_PARTS else ids
    return rows.select("guid").join(few_ids, "guid", "left_semi").distinct()


def retracted(refs: DataFrame, target: DataFrame, planned: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """``unresolved`` to a fixed point: a planned piece that falls takes along the planned pieces that need it, and so on.

    What falls is what a walk reaches from the missing ends, needs taken backwards; pieces of a cycle that need nothing missing
    stay. The detail lists all that a piece needs and that is missing or has fallen. asking: those of ``planned`` that can need
    anything, if they are known. Target and plan are asked for the ends of needs alone, which are far fewer."""
    ends = lambda df, c: df.select(F.col("guid").alias(c))
    needs = refs.select("from_guid", "to_guid").distinct().join(ends(planned if asking is None else asking, "from_guid"), "from_guid", "left_semi")
    needs = stage(needs, "needs")
    needed = stage(needs.where("to_guid IS NOT NULL").select(F.col("to_guid").alias("guid")).distinct(), "needed")
    there = stage(among(target, needed), "there")
    lacking = stage(needed.join(there, "guid", "left_anti"), "lacking")
    missing = stage(lacking.join(among(planned, lacking), "guid", "left_anti").select("guid", F.lit(0).alias("ord")), "missing")
    open_needs = needs.join(there.select(F.col("guid").alias("to_guid")), "to_guid", "left_anti")
    if missing.isEmpty():
        return _unresolved_rows(open_needs.where("false"))
    back = open_needs.select(F.col("to_guid").alias("from_guid"), F.col("from_guid").alias("to_guid"), F.lit(0).alias("pos"))
    gone = stage(walk(missing, back, ranked=False).select("guid"), "fallen")
    return _unresolved_rows(open_needs.join(gone.select(F.col("guid").alias("to_guid")), "to_guid", "left_semi"))


def dangling(children: DataFrame, owners: DataFrame) -> DataFrame:
    """Children whose owner isn't there: must be empty before a publish."""
    return children.where("owner_guid IS NOT NULL").join(owners.select(F.col("guid").alias("owner_guid")), "owner_guid", "left_anti")
