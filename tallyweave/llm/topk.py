"""Exact top-k inner products: norm-sorted candidates, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vectors import blocked, dimension_steps, matrix, rotations, suffix_norms, usable

#: Rows of a candidate block, of a query block, of a chunk within a block; candidates of greatest norm that set thresholds.
#: Small candidate blocks spread the work over tasks, large query blocks keep copies of candidates few.
BLOCK, QUERIES, CHUNK, HEAD = 1024, 4096, 512, 4096
HITS = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (integers floor(scale * x), as doubles), dim, norm; unusable vectors and null ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(usable(b.column(1)))
            ids, lists = b.column(0).filter(keep), b.column(1).filter(keep)
            v = np.floor(scale * lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(ids)), n)
            norm = np.sqrt(np.bincount(rows, v**2, len(ids)))
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(v)), pa.array(n.astype(np.int32)), pa.array(norm)], ["vec_id", "v", "dim", "norm"])

    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, "vec_id long, v array<double>, dim int, norm double")


def merge_best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: greatest score, then least id."""
    by = np.lexsort((ids, -score, row))
    row, ids, score = row[by], ids[by], score[by]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[keep], score[keep]


def scan_block(q: pd.DataFrame, c: pd.DataFrame, rotation: np.ndarray | None, k: int) -> pd.DataFrame:
    """The k best candidates of this block for each query, skipping what a bound shows to stay below its threshold."""
    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    c = c.sort_values(["norm", "vec_id"], ascending=[False, True])
    qv, cv, qid, cid = matrix(q.v), matrix(c.v), q.vec_id.to_numpy(), c.vec_id.to_numpy()
    d = qv.shape[1]
    qr, cr = (qv, cv) if rotation is None else (qv @ rotation, cv @ rotation)
    qs, cs, norms = suffix_norms(qr), suffix_norms(cr), c.norm.to_numpy()
    slack = 1e-9 * (1 + qs[:, 0].max() * norms[0])
    least = q.tau.to_numpy().astype(float)
    row, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(c), CHUNK):
        live = np.flatnonzero(qs[:, 0] * norms[lo] + slack >= least)
        if not len(live):
            break  # every later candidate is shorter
        hi = min(lo + CHUNK, len(c))
        partial = np.zeros((len(live), hi - lo))
        for a, b in dimension_steps(d):
            partial += qr[live, a:b] @ cr[lo:hi, a:b].T
            alive = partial + qs[live, b][:, None] * cs[lo:hi, b][None, :] + slack >= least[live][:, None]
            if b == d or alive.sum() < alive.size / 50:
                break
        i, j = np.nonzero(alive)
        exact = np.einsum("ij,ij->i", qv[live[i]], cv[lo + j])
        ok = (exact >= least[live[i]]) & (qid[live[i]] != cid[lo + j])
        row, ids, score = merge_best(np.concatenate((row, live[i][ok])), np.concatenate((ids, cid[lo + j][ok])), np.concatenate((score, exact[ok])), k)
        n = np.bincount(row, minlength=len(q))
        full = np.flatnonzero(n == k)
        least[full] = np.maximum(least[full], score[np.searchsorted(row, full, "right") - 1])
    return pd.DataFrame({"query_id": qid[row], "vec_id": ids, "score": score.astype("int64")})


def _scan(queries: DataFrame, candidates: DataFrame, turn: dict[int, np.ndarray], k: int) -> DataFrame:
    """Each query block meets each candidate block of its dimension whose greatest norm can still matter."""
    qb = queries.groupBy("dim", "qb").agg(F.min(F.col("tau") / F.greatest("norm", F.lit(1e-300))).alias("need"))
    cb = candidates.groupBy("dim", "cb").agg(F.max("norm").alias("top"))
    units = qb.join(cb, "dim").where(F.col("top") * (1 + 1e-9) >= F.col("need")).select("dim", "qb", "cb")
    own = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731  apart from the other side of the cogroup
    left = queries.join(units, ["dim", "qb"]).select(own("dim", "qb", "cb", "vec_id", "v", "tau"))
    right = candidates.join(units, ["dim", "cb"]).select(own("dim", "qb", "cb", "vec_id", "v", "norm"))
    keys = ["dim", "qb", "cb"]

    def block(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return scan_block(q, c, turn.get(int(key[0])), k)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, HITS)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k rows of greatest integer
    inner product, ties to the smaller id, its own row left out.

    Vectors meet only vectors of their length. Null, non-finite and null-component vectors and null ids take no part; an
    id that is given twice is two candidates and two queries with one answer. Blocks hold at most about BLOCK rows
    whatever the distribution of norms: bins of a few percent of norm, salted by size. The HEAD longest candidates are
    scanned first and give every query a threshold; the other blocks are scanned only for query blocks they can reach.
    Components must be such that the scores fit 53 bits."""
    rows = stage(quantized(vectors, id_col, vector_col, scale), "quantized")
    turn = rotations(rows)
    binned = rows.withColumn("bin", F.floor(F.log1p("norm") * 20).cast("long"))
    blocks = blocked(binned, ["dim", "bin"], "vec_id", BLOCK).withColumn("cb", F.concat_ws("/", "bin", "salt"))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    queries = blocked(asked, ["dim"], "vec_id", QUERIES).withColumnRenamed("salt", "qb")
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(0.0), 1 - F.lit(float(HEAD)) / F.col("n"))
    bounds = rows.join(counts, "dim").groupBy("dim").agg(F.percentile_approx("norm", F.array([F.lit(x / 1000) for x in range(1001)]), 2000).alias("q"), F.max(share).alias("share"))
    edge = bounds.select("dim", F.element_at("q", (F.floor(F.col("share") * 1000) + 1).cast("int")).alias("edge"))
    blocks = stage(blocks.join(edge, "dim").withColumn("head", F.col("norm") >= F.col("edge")), "blocks")
    first = stage(_scan(queries.withColumn("tau", F.lit(float("-inf"))), blocks.where("head"), turn, k), "head")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    tau = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    again = queries.join(tau, "vec_id", "left").withColumn("tau", F.coalesce("least", F.lit(float("-inf")))).drop("least")
    found = first.unionByName(_scan(again, blocks.where(~F.col("head")), turn, k))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
