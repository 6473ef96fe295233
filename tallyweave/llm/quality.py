"""Quality classifier: ridge regression on random Fourier features of document statistics, isotonically calibrated."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, stage, starts_of, utf8, word_hashes

#: Labelled rows used for fitting, at most; beyond it, those with the least hash of their id.
MAX_LABELLED = 500_000
#: Random features, ridge weight, bins of the calibration, and the score from which a document is accepted.
N_FOURIER, RIDGE, BINS, ACCEPT = 256, 1e-3, 512, 0.7
SEED = 7

#: Classes of bytes, in order: lower, upper, digit, space, line break or tab, stop, exclamation, bar, symbol, quote, above ASCII, rest.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".,;:", b"!?", b"|/\\_=<>", b"#$%&*@^~+", b"'\"()[]{}-`")
CLASS_OF = np.full(256, 11, np.int64)
CLASS_OF[128:] = 10
for _i, _c in enumerate(_CLASSES):
    CLASS_OF[list(_c)] = _i
N_STATS = 21


def statistics(text: pa.Array) -> np.ndarray:
    """A row of statistics for each whole text: shares of byte classes, word lengths, repetition, lines, size."""
    raw_all, offs_all = utf8(text)
    out = np.zeros((len(text), N_STATS))
    for lo, hi in slices(offs_all, 2 << 20):
        raw, offs = raw_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
        n, size = hi - lo, np.diff(offs)
        row = np.repeat(np.arange(n), size)
        shares = np.bincount(row * 12 + CLASS_OF[raw], minlength=12 * n).reshape(n, 12)
        words, length, per = word_hashes(raw, offs)
        of = np.repeat(np.arange(n), per)
        some, at = np.maximum(per, 1), starts_of(per)
        total, squares = np.bincount(of, length, n), np.bincount(of, length.astype(float) ** 2, n)
        mean = total / some
        inside = np.ones(len(words), bool)
        inside[at[:-1][per > 0]] = False
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & inside[1:]
        second = np.zeros(len(words), bool)
        second[2:] = (words[2:] == words[:-2]) & (of[2:] == of[:-2])
        key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
        x = out[lo:hi]
        x[:, :12] = shares / np.maximum(size, 1)[:, None]
        x[:, 12], x[:, 13] = mean, np.sqrt(np.maximum(squares / some - mean**2, 0))
        x[:, 14], x[:, 15] = np.bincount(of, again, n) / some, np.bincount(of, second, n) / some
        x[:, 16], x[:, 17] = distinct / some, np.bincount(of, length > 20, n) / some
        x[:, 18], x[:, 19] = np.log1p(size), np.log1p(per)
        x[:, 20] = np.log1p(shares[:, 4])
    return out


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``part`` gives for a batch; partitions send one array, which few tasks add up."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    few = rows.mapInArrow(lean(local), "s binary").repartition(4).mapInArrow(lean(merge), "s binary").collect()
    return np.sum([np.frombuffer(r.s) for r in few], axis=0) if few else np.zeros(size)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), N_STATS)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


@dataclass
class QualityModel:
    """A fitted classifier, a few hundred kB: it travels to the tasks in their closure."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, N_FOURIER))
        b = rng.uniform(0, 2 * np.pi, N_FOURIER)
        return np.hstack([np.sqrt(2 / N_FOURIER) * np.cos(x @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; within a level of the calibration the raw value still orders the documents."""
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.full(len(raw), 0.5)
        return 0.999 * level + 0.001 / (1 + np.exp(-8 * (raw - 0.5)))

    def transform(self, docs: DataFrame, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
        """All columns of docs and the score, in one pass; an earlier column of that name is replaced."""
        docs = docs.drop(score_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = self.score(statistics(b.column(b.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, score_col])

        schema = docs.select("*", F.lit(0.0).cast("double").alias(score_col)).schema
        for f in schema.fields:
            f.nullable = True
        return docs.mapInArrow(lean(run), schema)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each text, staged in the shared folder. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(b.column(1)).ravel()), N_STATS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(rows.mapInArrow(lean(run), "doc_id long, x array<double>"), "statistics")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fit on the labelled rows of ``stats`` that are not held out.

    Four fifths of them (by a hash of the id, which is no input of the score) give the normal equations, the last fifth
    the calibration. Labels other than 0 and 1 and rows without an id are left out; a label given twice counts twice.
    Without any labelled row, every score is 0.5."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)")
    rows = stats.join(marks.where(~held_out()), "doc_id").select("doc_id", "x", "y")
    rows = stage(rows, "labelled")
    n = rows.count()
    if n > MAX_LABELLED:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(n)) < MAX_LABELLED)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    inner, outer = rows.where(fold < 4), rows.where(fold == 4)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(1))
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    m = summed(inner, moments, 1 + 2 * N_STATS)
    k = max(m[0], 1)
    mean = m[1 : 1 + N_STATS] / k
    scale = np.sqrt(np.maximum(m[1 + N_STATS :] / k - mean**2, 0)) + 1e-6
    model = QualityModel(mean, scale, np.zeros(N_FOURIER + 1), np.zeros(0), np.zeros(0))
    d = N_FOURIER + 1

    def equations(b: pa.RecordBatch) -> np.ndarray:
        z, y = model.features(_matrix(b.column(1))), b.column(2).to_numpy().astype(float)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    e = summed(inner, equations, d * d + d)
    model.weights = np.linalg.solve(e[: d * d].reshape(d, d) + RIDGE * k / d * np.eye(d), e[d * d :]) if m[0] else model.weights

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((model.raw(_matrix(b.column(1))) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        y = b.column(2).to_numpy().astype(float)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    h = summed(outer, histogram, 2 * BINS)
    seen = np.flatnonzero(h[:BINS])
    model.knots = (seen + 0.5) / BINS * 2 - 0.5
    model.levels = isotonic((h[BINS:][seen] + 1e-9) / h[seen], h[seen])
    return model


def score_documents(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    accepted = (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", accepted)
