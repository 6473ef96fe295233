"""Embedding near-duplicates: tiles compared along principal axes, leading dimensions first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components
from .vectors import blocked, by_length, dimension_steps, lists, matrix, rotations, suffix_norms, usable

#: Rows that are compared at once, tiles' width along an axis, and the leading axes along which tiles are cut.
TILE, WIDTH, AXES = 1024, 0.1, 6
#: Tiles hold so many times TILE rows: a row goes to a task with each tile that it may have a link to, whatever its size.
SLAB = 8
#: What places a vector: its leading axes, and the length of what the other axes hold.
PLACE = AXES + 1
FOUND = "kind int, a long, b long"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows to length 1; none is zero."""
    u = v / np.abs(v).max(1, initial=0.0)[:, None]
    return u / np.sqrt((u * u).sum(1))[:, None]


def turned(v: np.ndarray, turn: dict[int, np.ndarray]) -> np.ndarray:
    """Rows to length 1 along the axes of their length of vector."""
    return unit(v) @ turn[v.shape[1]] if v.shape[1] in turn else unit(v)


def places(r: np.ndarray) -> np.ndarray:
    """Of rows along their axes the leading components and the length of the rest. Two rows lie no nearer to each other than their
    places do, since lengths differ by no more than what they are the lengths of."""
    out = np.zeros((len(r), PLACE))
    out[:, : min(AXES, r.shape[1])] = r[:, :AXES]
    out[:, AXES] = np.sqrt((r[:, AXES:] ** 2).sum(1))
    return out


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dim, same (digest of label and vector), v of the vectors that can link; v stays in floats where it is given so."""
    single = dict(vectors.dtypes)[vector_col] == "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, v in by_length(b.column(2), np.flatnonzero(usable(b.column(2)))):
                v = v + 0.0  # no negative zeros
                some = np.abs(v).max(1, initial=0.0) > 0
                lo, v = lo[some], v[some]
                own = b.take(pa.array(lo))
                raw, n = memoryview(np.ascontiguousarray(v)).cast("B"), 8 * v.shape[1]
                same = [hashlib.sha256(f"{x}:".encode() + raw[i * n : (i + 1) * n]).digest() for i, x in enumerate(own.column(1).to_pylist())]
                columns = [own.column(0), own.column(1), pa.array(np.full(len(lo), v.shape[1])), pa.array(same, pa.binary()), lists(v.astype(np.float32) if single else v)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dim", "same", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL")
    return rows.mapInArrow(run, f"vec_id long, label string, dim long, same binary, v array<{'float' if single else 'double'}>")


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, largest components from 0.5 to below 1: the same cosines to the last bit, whose squares neither
    overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0.0))[1][:, None])


def links(x: np.ndarray, y: np.ndarray, turn: dict[int, np.ndarray], threshold: float, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of x and y with cosine >= threshold, by blocks of TILE rows in order of the leading axis; blocks whose boxes
    are too far apart don't meet. one: x and y are the same rows."""
    p, q = turned(x, turn), turned(y, turn)
    blocks = []
    for r in (p, q):
        order = np.argsort(r[:, 0], kind="stable")
        own = [order[at : at + TILE] for at in range(0, len(order), TILE)]
        at = places(r)
        blocks.append([(k, at[k].min(0), at[k].max(0)) for k in own])
    for m, (i, lo, hi) in enumerate(blocks[0]):
        for n, (j, low, high) in enumerate(blocks[1]):
            gap = np.maximum(np.maximum(lo - high, low - hi), 0.0)
            if one and n < m or (gap * gap).sum() > 2 - 2 * threshold + 1e-9:
                continue
            s, t = _block_links(x[i], y[j], p[i], q[j], threshold, one and m == n)
            yield i[s], j[t]


def _block_links(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold: partial sums over leading axes (p, q), dropped once the suffix norms bound the rest
    too low; what is left is decided by the cosine of the vectors as given (x, y). one: both sides are the same rows."""
    ps, qs = suffix_norms(p), suffix_norms(q)
    partial = np.zeros((len(p), len(q)))
    for lo, hi in dimension_steps(p.shape[1]):
        partial += p[:, lo:hi] @ q[:, lo:hi].T
        alive = partial + ps[:, hi][:, None] * qs[:, hi][None, :] >= threshold - 1e-9
        if not alive.any() or alive.sum() < alive.size / 100:
            break
    if one:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    keep_i, keep_j = [], []
    x, y = scaled(x), scaled(y)
    nx, ny = np.sqrt((x**2).sum(1)), np.sqrt((y**2).sum(1))
    for at in range(0, len(i), 1 << 17):
        s, t = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        ok = np.einsum("ij,ij->i", x[s], y[t]) / (nx[s] * ny[t]) >= threshold
        keep_i.append(s[ok])
        keep_j.append(t[ok])
    return np.concatenate(keep_i or [i]), np.concatenate(keep_j or [j])


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges enough to join what the pairs join: at most one for each row, by labels passed along the pairs."""
    names, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    s, t = at[: len(i)], at[len(i) :]
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, s, label[t])
        np.minimum.at(low, t, low[s])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(names[r]), int(n)) for r, n in zip(label, names, strict=True) if names[r] != n]


def _cells(tiles: DataFrame) -> DataFrame:
    """(label, dim, bins, cell): the fewest leading axes by which a cell has at most SLAB times TILE rows, or all AXES."""
    cells = stage(tiles.groupBy("label", "dim", "bins").agg(F.count("*").alias("n")), "cells")
    out = cells
    for d in range(1, AXES):
        out = out.withColumn(f"p{d}", F.slice("bins", 1, d))
        sums = cells.groupBy("label", "dim", F.slice("bins", 1, d).alias(f"p{d}")).agg(F.sum("n").alias(f"n{d}"))
        out = out.join(sums, ["label", "dim", f"p{d}"])
    cell = F.col("bins")
    for d in range(AXES - 1, 0, -1):
        cell = F.when(F.col(f"n{d}") <= SLAB * TILE, F.col(f"p{d}")).otherwise(cell)
    return out.select("label", "dim", "bins", F.array_join(cell.cast("array<string>"), ",").alias("cell"))


def _apart(lo: Column, hi: Column, low: Column, high: Column) -> Column:
    """The square of the distance of two boxes."""
    gap = lambda i: F.greatest(lo[i] - high[i], low[i] - hi[i], F.lit(0.0))
    return sum((gap(i) * gap(i) for i in range(1, PLACE)), gap(0) * gap(0))


def _near_tiles(tiles: DataFrame, threshold: float) -> DataFrame:
    """(label, dim, cell, salt, cell2, salt2) and both boxes (lo, hi, lo2, hi2): pairs of tiles whose boxes, by the places of what they
    hold, are near enough for a link.

    Unit vectors of that cosine lie no farther apart than sqrt(2 - 2 * threshold), and rotations keep distances. Tiles meet
    by their bin along the first axis; what is joined is a row for each tile, not for each vector."""
    ends = [F.array(*(f(F.col("place")[i]) for i in range(PLACE))).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    kinds = stage(tiles.groupBy("label", "dim", "cell", "salt").agg(F.min(F.col("bins")[0]).alias("bin"), *ends), "kinds")
    reach = int(np.ceil(np.sqrt(max(0.0, 2 - 2 * threshold)) / WIDTH + 1e-9))
    other = kinds.withColumnsRenamed({c: f"{c}2" for c in ("cell", "salt", "lo", "hi")})
    ours = kinds.withColumn("bin", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: o + F.col("bin"))))
    near = (_apart(*map(F.col, ("lo", "hi", "lo2", "hi2"))) <= 2 - 2 * threshold + 1e-9) & (F.struct("cell", "salt") <= F.struct(F.col("cell2").alias("cell"), F.col("salt2").alias("salt")))
    return ours.join(other, ["label", "dim", "bin"]).where(near).select("label", "dim", "cell", "salt", "cell2", "salt2", "lo", "hi", "lo2", "hi2")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Vectors link only within a label and length. Null or zero vectors, null or non-finite components, and null labels link
    with nothing: n_links 0, their own component, kept. Components may be as large or small as doubles go. A null id gives nulls and kept false. An id that is given twice
    counts the links of all its vectors, and joins what they link. Other columns are left out.

    Vectors of one label that are equal in every component are one node with a weight, so a popular vector costs no pairs.
    Tiles are bins along the leading principal axes, as many as it takes to hold at most SLAB times TILE rows, beyond AXES dealt
    by salt; only tiles whose boxes are near enough to hold a link meet, and of their rows those near enough to the other's box.
    Vectors alone travel, in floats if they are given so; what is worked out of them is worked out again where it is needed. A
    task sends a count for each vector and a spanning forest of its links, never all pairs."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    units = stage(unit_vectors(vectors, id_col, vector_col, label_col), "units")
    nodes = units.groupBy("same").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.min("label").alias("label"), F.min("dim").alias("dim"), F.min("v").alias("v"))

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in by_length(b.column(1), np.arange(b.num_rows)):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), lists(unit(v))], ["dim", "u"])

    turn = rotations(units.select("dim", "v").mapInArrow(norm, "dim long, u array<double>"), "u")

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in by_length(b.column(4), np.arange(b.num_rows)):
                place = places(turned(v, turn))
                bins = np.floor(place[:, :AXES] / WIDTH).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, lists(place), lists(bins)], [*b.schema.names, "place", "bins"])

    kind = dict(units.dtypes)["v"]
    schema = f"node long, weight long, label string, dim long, v {kind}, place array<double>, bins array<long>"
    tiles = stage(nodes.select("node", "weight", "label", "dim", "v").mapInArrow(rotate, schema), "rotated")
    tiles = tiles.join(_cells(tiles).hint("merge"), ["label", "dim", "bins"])
    tiles = stage(blocked(tiles, ["label", "dim", "cell"], "node", SLAB * TILE), "tiles")
    pairs = stage(_near_tiles(tiles, threshold), "pairs")
    keys = ["label", "dim", "cell", "salt", "cell2", "salt2"]
    columns = [F.col(c).alias(c) for c in (*keys, "node", "weight", "v")]  # apart from the other side's
    near = lambda lo, hi: _apart(F.col("place"), F.col("place"), F.col(lo), F.col(hi)) <= 2 - 2 * threshold + 1e-9
    left = tiles.join(pairs, ["label", "dim", "cell", "salt"]).where(near("lo2", "hi2")).select(columns)
    two = pairs.where("cell <> cell2 OR salt <> salt2")  # a tile meets itself in the rows of its left side
    right = tiles.withColumnRenamed("cell", "cell2").withColumnRenamed("salt", "salt2").join(two, ["label", "dim", "cell2", "salt2"]).where(near("lo", "hi")).select(columns)

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"kind": [], "a": [], "b": []}).astype("int64")
        one = key[2:4] == key[4:6]
        b = a if one else b
        if not len(a) or not len(b):
            return none
        x = matrix(a.v)
        found = list(links(x, x if one else matrix(b.v), turn, threshold, one))
        i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        if not len(i):
            return none
        an, bn, aw, bw = a.node.to_numpy(), b.node.to_numpy(), a.weight.to_numpy(), b.weight.to_numpy()
        counts = pd.concat([pd.Series(bw[j]).groupby(an[i]).sum(), pd.Series(aw[i]).groupby(bn[j]).sum()])
        edges = forest(an[i], bn[j])
        return pd.DataFrame({"kind": [0] * len(counts) + [1] * len(edges), "a": [*counts.index, *(e[0] for e in edges)], "b": [*counts, *(e[1] for e in edges)]}).astype("int64")

    found = stage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, FOUND), "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("linked"))
    groups = connected_components(found.where("kind = 1").select("a", "b"))
    known = nodes.select("same", "node", "weight").join(counts, "node", "left").join(groups, "node", "left")
    each = units.select("vec_id", "same").distinct().join(known, "same")
    each = each.select("vec_id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("of"))
    each = each.groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("of").alias("of"))
    out = rows.join(each, "vec_id", "left")
    component = F.coalesce("of", "vec_id")
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
