"""Near-duplicate documents by a chosen-path join on word shingles.

In each of several independent trees, a document follows the path of minwise tokens that a hash function of the node
chooses among its shingles; two documents of similarity s stay together for d steps with probability about s**d. A
document rests at the first node of its path with at most SMALL documents (or at depth DEPTH), and the documents that
rest in one node are compared exhaustively by sketches. With ten trees, a pair of similarity 0.85 that parts only at
depth 1 is missed with probability 0.15**10, one that must go to depth 4 with 0.48**10. Sketches only propose: groups of
proposed links are then settled on full shingle sets. For other similarities the number of trees and the bar of the sketches
follow (``trees_for``, ``proposed_for``), so that recall is the same."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, lean, mix, slices, stage, starts_of, utf8, word_names
from .components import connected_components

WORDS, DEPTH, SMALL = 5, 4, 64
#: Links have at least so many hundredths of similarity; the chance that a pair at that bar which goes to the last level is
#: missed by all trees.
PERCENT, MISSED = 85, 6.3e-4
#: Slots of a sketch (16 bits each); a pair is proposed from a share of equal slots that lies so many deviations of that share
#: below the similarity of links.
SLOTS, DEVIATIONS = 64, 5.15
#: Bytes of shingle sets in one block of a group; a larger group is settled against a pivot first.
BLOCK_BYTES = 32 << 20
_U = np.uint64


def _seeds(first: int, n: int) -> np.ndarray:
    return mix(np.arange(first + 1, first + n + 1, dtype=_U) * _U(0xD1342543DE82EF95))


_SEEDS = _seeds(0, SLOTS)
#: Added to a word by its place in the shingle.
_PLACE = np.arange(1, WORDS + 1, dtype=_U) * MIX_A


def trees_for(percent: int) -> int:
    """10 at similarity 0.85, 14 at 0.8."""
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** DEPTH))) if percent < 100 else 1


def proposed_for(percent: int) -> float:
    """The share of equal slots from which a pair is proposed: 0.62 at similarity 0.85, 0.54 at 0.8."""
    s = percent / 100
    return s - DEVIATIONS * math.sqrt(s * (1 - s) / SLOTS)


def shingles(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, end to end, and how many each row has."""
    words, per = word_names(raw, offs)
    n = len(offs) - 1
    if not len(words):
        return np.zeros(0, _U), np.zeros(n, np.int64)
    run = np.zeros(len(words), _U)
    for i in range(min(WORDS, len(words))):
        run[: len(words) - i] += mix(words[i:] + _PLACE[i])
    run = mix(run)
    at = starts_of(per)
    parts, counts = [], np.zeros(n, np.int64)
    for i in np.flatnonzero(per):
        a, b = at[i], at[i + 1]
        if b - a >= WORDS:
            s = np.unique(run[a : b - WORDS + 1])
        else:  # the whole sequence is its one shingle; its length tells it from the five-word ones
            s = np.array([b - a], _U)
            for j in range(a, b):
                s = mix(s + words[j : j + 1])
        parts.append(s)
        counts[i] = len(s)
    return np.concatenate(parts), counts


def signatures(s: np.ndarray, counts: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Path keys (rows x trees*DEPTH, tree by tree) and sketches (rows x SLOTS) of rows that all have shingles."""
    at, n = starts_of(counts)[:-1], len(counts)
    sketch, keys = np.zeros((n, SLOTS), np.uint16), np.zeros((n, trees * DEPTH), np.int64)
    for i in range(SLOTS):
        low = np.minimum.reduceat((s ^ _SEEDS[i]) * MIX_A, at)
        sketch[:, i] = (mix(low) & _U(0xFFFF)).astype(np.uint16)
    for t, seed_of_tree in enumerate(_seeds(SLOTS, trees)):
        node = np.full(n, seed_of_tree)
        for d in range(DEPTH):
            seed = node[0] if d == 0 else np.repeat(node, counts)
            chosen = np.minimum.reduceat((s ^ seed) * MIX_A, at)
            node = mix(node * _U(3) + mix(chosen))
            keys[:, t * DEPTH + d] = node.view(np.int64)
    return keys, sketch


def _sets(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, mark, n_shingles, set_a, set_b (a 128-bit name of the set), keys, sketch of docs (doc_id, text, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw_all, offs_all = utf8(b.column(1))
            for lo, hi in slices(offs_all, 2 << 20):
                s, counts = shingles(raw_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo])
                some = np.flatnonzero(counts)
                names, n = np.zeros((2, hi - lo), np.int64), hi - lo
                keys, sketch = [None] * n, [None] * n
                if len(some):
                    at = starts_of(counts[some])[:-1]
                    names[0, some] = np.add.reduceat(mix(s), at).view(np.int64)
                    names[1, some] = np.add.reduceat(mix(s ^ _SEEDS[0]), at).view(np.int64)
                    k, z = signatures(s, counts[some], trees)
                    for row, i in enumerate(some):
                        keys[i], sketch[i] = k[row], z[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), b.column(2).slice(lo, n), pa.array(counts), pa.array(names[0]), pa.array(names[1]), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "mark", "n_shingles", "set_a", "set_b", "keys", "sketch"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, mark long, n_shingles long, set_a long, set_b long, keys array<long>, sketch binary")


def _join_labels(linked: np.ndarray) -> np.ndarray:
    """The least index that each row reaches in a boolean matrix of links."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        low = np.where(linked, label[None, :], len(label)).min(1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _propose(nodes: DataFrame, proposed: float) -> DataFrame:
    """Compare the documents of each node by sketches; a spanning forest of the proposed links, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            at = lists.offsets.to_numpy()
            flat = lists.values
            ids = flat.field("rep").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
            found = set()
            for lo, hi in zip(at, at[1:], strict=False):
                z = sketch[lo:hi]
                same = np.stack([(z == row).sum(1) for row in z]) if hi - lo < 512 else np.concatenate([(z[i : i + 64, None] == z[None]).sum(2) for i in range(0, hi - lo, 64)])
                label = _join_labels(same >= proposed * SLOTS)
                own = ids[lo:hi]
                found.update((int(own[r]), int(own[i])) for i, r in enumerate(label) if r != i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return nodes.mapInArrow(run, "a long, b long")


def _nodes(reps: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """members: the (rep, sketch) that rest in one small node, for all of two or more; and (rep, key, size) in large ones.

    Level by level, a pre-aggregated count tells small nodes from large ones; only documents of large ones go deeper.
    The paths travel without the sketches, which join the few rows that share a node."""
    paths = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("keys", t * DEPTH + 1, DEPTH)))
    flat = reps.select("rep", paths.alias("path")).select("rep", *(F.col("path")[d].alias(f"k{d}") for d in range(DEPTH)))
    rest = None
    for d in range(DEPTH):
        deeper = [f"k{x}" for x in range(d + 1, DEPTH)]
        sizes = flat.groupBy(f"k{d}").agg(F.count("*").alias("size")).where("size > 1")
        here = stage(flat.join(sizes, f"k{d}").select("rep", F.col(f"k{d}").alias("key"), "size", *deeper), "level")
        small = here.where(F.col("size") <= SMALL).select("rep", "key")
        rest = small if rest is None else rest.unionByName(small)
        flat = here.where(F.col("size") > SMALL)
        if d < DEPTH - 1:
            flat = flat.select("rep", *deeper)
    small = rest.join(reps.select("rep", "sketch"), "rep").groupBy("key").agg(F.collect_list(F.struct("rep", "sketch")).alias("members"))
    return small.where(F.size("members") > 1).select("members"), flat.select("rep", "key", "size")


def _against_pivots(large: DataFrame, reps: DataFrame, proposed: float) -> tuple[DataFrame, DataFrame]:
    """(links to pivots, lists of members to compare) of nodes that are large at the last level; large: rep, key, size.

    Every document of a node is held against one, its pivot. Those near it are one group already and needn't meet; only the
    others, dealt into parts of SMALL, meet all parts of their node. A node of near copies costs a row for each."""
    met = stage(large.join(reps.select("rep", "sketch"), "rep"), "large")
    pivots = stage(met.groupBy("key").agg(F.min_by(F.struct(F.col("rep").alias("pivot"), F.col("sketch").alias("other")), F.xxhash64("rep", "key")).alias("p")).select("key", "p.*"), "pivots")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (3, 5))
            close = (x == y).sum(1) >= proposed * SLOTS
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(close)], ["rep", "key", "size", "sketch", "pivot", "near"])

    held = met.join(pivots.hint("merge"), "key").select("rep", "key", "size", "sketch", "pivot", "other")
    held = stage(held.mapInArrow(near, "rep long, key long, size long, sketch binary, pivot long, near boolean"), "held")
    links = held.where("near AND rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    far = held.where("NOT near")
    parts = stage(far.groupBy("key").agg(F.ceil(F.count("*") / SMALL).cast("long").alias("u"), F.max(F.ceil(F.col("size") / SMALL)).cast("long").alias("v")), "parts")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    ours = far.join(parts, "key").select("key", dealt("u").alias("i"), every("v").alias("j"), "rep", "sketch")
    theirs = held.join(parts.hint("merge"), "key").select("key", every("u").alias("i"), dealt("v").alias("j"), "rep", "sketch")
    lists = ours.unionByName(theirs).groupBy("key", "i", "j").agg(F.collect_list(F.struct("rep", "sketch")).alias("members"))
    return links, lists.select("members")


def _proposals(reps: DataFrame, trees: int, proposed: float) -> DataFrame:
    """(a, b): links that join what the trees propose."""
    small, large = _nodes(reps, trees)
    links, lists = _against_pivots(large, reps, proposed)
    return _propose(small.unionByName(lists), proposed).unionByName(links)


def _group_links(sets: list[np.ndarray], side: np.ndarray | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that join what links of similarity >= percent / 100 join among ``sets``; side: only rows of different sides meet.

    Rows that are already joined are not compared again. A pair is skipped only if its sizes, or its distances to a row
    that both were held against (Jaccard distance is a metric), show that it can't link."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    root = np.arange(n)
    edges: list[tuple[int, int]] = []
    lower = np.zeros((n, 0))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    for p in range(n):
        todo = root != root[p]
        if side is not None:
            todo &= side != side[p]
        else:
            todo[:p] = False
        todo &= (100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p]))
        if lower.shape[1]:
            todo &= (np.abs(lower - lower[p]).max(1) <= 1 - percent / 100 + 1e-9)
        if not todo.any():
            continue
        if todo.sum() > n // 4 and lower.shape[1] < 16:  # a pivot: distances of all rows to it
            common = np.bincount(owner, np.isin(flat, sets[p], assume_unique=False), n).astype(np.int64)
            lower = np.hstack([lower, (1 - common / (size + size[p] - common))[:, None]])
            rows = np.flatnonzero(todo)
            inter = common[rows]
        else:
            rows = np.flatnonzero(todo)
            inter = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for q in rows])
        for q in rows[100 * inter >= percent * (size[rows] + size[p] - inter)]:
            if root[q] != root[p]:
                edges.append((p, int(q)))
                root[root == root[q]] = root[p]
    return edges


def _confirm(groups: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Settle each proposed group (rep, doc_id, mark, grp) on full shingle sets; (a, b) edges of the true links' forest."""
    texts = docs.join(groups.hint("merge"), ["doc_id", "mark"])  # groups grow with the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            reps = b.column(0).to_pylist()
            b = b.filter(pa.array([r != p for r, p in zip(reps, [last, *reps], strict=False)], pa.bool_()))  # repeated rows lie together
            last = reps[-1] if reps else last
            raw, offs = utf8(b.column(1))
            for lo, hi in slices(offs, 2 << 20):
                s, counts = shingles(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                at = starts_of(counts)
                sets = [s[a:z].tobytes() for a, z in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(8 * counts), pa.array(sets, pa.binary())], ["rep", "grp", "bytes", "shingles"])

    full = stage(texts.select("rep", "text", "grp").mapInArrow(lean(run), "rep long, grp long, bytes long, shingles binary"), "sets")
    parts = stage(full.groupBy("grp").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("long").alias("parts")), "parts")
    dealt = full.join(parts.hint("merge"), "grp").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rep")
        ids = g.rep.to_numpy()
        edges = _group_links([np.frombuffer(x, _U) for x in g.shingles], None, percent)
        return pd.DataFrame({"a": [ids[x] for x, _ in edges], "b": [ids[y] for _, y in edges]}, dtype="int64")

    alone = dealt.where("parts <= 1").select("grp", "rep", "shingles").groupBy("grp").applyInPandas(settle, "a long, b long")

    # a group of several blocks: all against a pivot; what the pivot links needn't meet, the others meet every block
    large = stage(dealt.where("parts > 1").select("grp", "part", "parts", "rep", "bytes", "shingles"), "blocks")
    if large.isEmpty():
        return alone
    pivots = large.groupBy("grp").agg(F.min("parts").alias("parts"), F.min_by(F.struct("rep", "shingles"), "rep").alias("p"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pivots = pivots.select("grp", every("parts").alias("part"), "p.*", F.lit(True).alias("pivot"))

    def linked(g: pd.DataFrame) -> pd.DataFrame:
        p = g[g["pivot"]].iloc[0]
        g = g[~g["pivot"]]
        own, size = np.frombuffer(p.shingles, _U), np.array([len(x) // 8 for x in g.shingles])
        common = np.array([len(np.intersect1d(own, np.frombuffer(x, _U), assume_unique=True)) for x in g.shingles])
        return pd.DataFrame({"a": g.rep, "b": p.rep, "ok": 100 * common >= percent * (size + len(own) - common)})

    with_pivots = large.select("grp", "part", "rep", "shingles", F.lit(False).alias("pivot")).unionByName(pivots.select("grp", "part", "rep", "shingles", "pivot"))
    held = stage(with_pivots.groupBy("grp", "part").applyInPandas(linked, "a long, b long, ok boolean"), "held")
    far = large.join(held.where("NOT ok").select(F.col("a").alias("rep")).hint("merge"), "rep")
    shares = stage(far.groupBy("grp").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("long").alias("u")), "shares")
    ours = far.join(shares, "grp").select("grp", F.pmod(F.xxhash64("rep"), F.col("u")).alias("i"), every("parts").alias("j"), F.lit(0).alias("side"), "rep", "shingles")
    theirs = large.join(shares.hint("merge"), "grp").select("grp", every("u").alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), "rep", "shingles")

    def across(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rep", "side"])
        ids = g.rep.to_numpy()
        edges = _group_links([np.frombuffer(x, _U) for x in g.shingles], g.side.to_numpy(), percent)
        return pd.DataFrame({"a": [ids[x] for x, _ in edges], "b": [ids[y] for _, y in edges]}, dtype="int64")

    met = ours.unionByName(theirs).groupBy("grp", "i", "j").applyInPandas(across, "a long, b long")
    return alone.unionByName(held.where("ok AND a <> b").select("a", "b")).unionByName(met)


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; documents link from a Jaccard similarity of percent / 100.

    Null or blank texts have no shingles, link with nothing and are kept. Documents of equal shingle sets are one node
    from the start, so groups of copies cost nothing later. Rows repeated under one id come back each; if their texts
    differ, each is a document of its own, linked by its own text. A null id gives a null component and kept false. Words
    may be of any length and bytes (see ``word_names``). Other columns are left out."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    sets = stage(_sets(rows, trees_for(percent)), "sets")
    some = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    names = ["n_shingles", "set_a", "set_b"]
    reps = some.groupBy(*names).agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.min_by("keys", "doc_id").alias("keys"), F.min_by("sketch", "doc_id").alias("sketch"))
    reps = stage(reps.select(F.monotonically_increasing_id().alias("rep"), *names, "at.*", "keys", "sketch"), "reps")
    groups = connected_components(_proposals(reps, trees_for(percent), proposed_for(percent))).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    groups = reps.select("rep", "doc_id", "mark").join(groups.hint("merge"), "rep")
    links = connected_components(_confirm(groups, rows.where("doc_id IS NOT NULL"), percent)).withColumnRenamed("node", "rep")
    linked = stage(reps.select("rep", "doc_id").join(links.hint("merge"), "rep"), "linked")
    least = stage(linked.groupBy("component").agg(F.min("doc_id").alias("of")), "least")
    linked = linked.select("rep", "component").join(least.hint("merge"), "component").select("rep", "of")
    known = reps.select(*names, "rep", "doc_id").join(linked, "rep", "left").select(*names, F.coalesce("of", "doc_id").alias("of"))
    out = sets.select("doc_id", *names).join(known, names, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
