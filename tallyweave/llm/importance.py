"""Importance resampling: documents are drawn so that their features come near those of a target corpus.

Each feature (a run of words) falls into a bucket by its crc32; a bucket's gain is the log ratio of its shares in target and
corpus, and a document weighs the sum of its features' gains. Weight plus Gumbel noise gives a sample without replacement: the
highest scores win. The last of the winners is found by a distributed quickselect, without sorting what loses."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import slices, stage, starts_of, utf8

#: Bytes of text that are worked on at a time in a task.
SLICE = 4 << 20
#: Pivots of a round of the quickselect.
PIVOTS = 16
#: Partitions whose offsets are broadcast (16 MB at the utmost); those of more are joined.
MOST_PARTS = 1 << 20
#: Longer words are left to zlib, one by one.
LONG_WORD = 64

#: The table of the usual crc32 (polynomial 0xEDB88320), by its rule.
CRC = reduce(lambda c, _: np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1), range(8), np.arange(256, dtype=np.uint32))
#: Bytes of words: digits, letters in lower case, and all beyond ASCII.
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z in lower case, where each word begins, its length, and how many words each row has."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = np.append(IN_WORD[raw], False)
    edge = np.zeros(len(inside), bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1]))
    first = np.flatnonzero(inside & (~before | edge))
    length = np.flatnonzero(before & (~inside | edge)) - first
    return raw, first, length, np.diff(np.searchsorted(first, offs))


def crc_on(state: np.ndarray, raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 states (before the last inversion) after each has read its own stretch of ``raw``, a byte of all at a time."""
    order = np.argsort(-length, kind="stable")
    s, at, n = state[order], first[order], length[order]
    long = int(np.searchsorted(-n, -LONG_WORD, "left"))
    for i in range(long):
        s[i] = zlib.crc32(raw[at[i] : at[i] + n[i]], int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for i in range(int(n[long]) if len(n) > long else 0):
        live = long + int(np.searchsorted(-n[long:], -i, "left"))
        s[long:live] = CRC[(s[long:live] ^ raw[at[long:live] + i]) & 255] ^ (s[long:live] >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s
    return out


def feature_buckets(raw: np.ndarray, offs: np.ndarray, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features (runs of 1 to ``grams`` words joined by a space), the row of each, and the words of each row."""
    raw, first, length, counts = words(raw, offs)
    row = np.repeat(np.arange(len(counts)), counts)
    state = crc_on(np.full(len(first), 0xFFFFFFFF, np.uint32), raw, first, length)
    found, rows = [state], [row]
    for k in range(1, grams):
        fits = np.flatnonzero(row[k:] == row[: max(len(row) - k, 0)])
        state = state[fits]
        state = CRC[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8))
        whole = np.zeros(len(first), np.uint32)
        whole[fits] = state = crc_on(state, raw, first[fits + k], length[fits + k])
        found.append(state)
        rows.append(row[fits])
        state = whole
    return (np.concatenate(found) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets), np.concatenate(rows), counts


def bucket_counts(texts: DataFrame, grams: int = 1, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket (null texts have none).

    Each task sums what it reads and sends at most ``buckets`` rows, and so much goes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offs = utf8(batch.column(0))
            for lo, hi in slices(offs, SLICE):
                bucket = feature_buckets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], grams, buckets)[0]
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    own = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in own.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    t, s, n = target.astype(float), corpus.astype(float), len(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, grams: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words and weight (the sum of its features' gains) of every document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column(1))
            for lo, hi in slices(offs, SLICE):
                bucket, row, n = feature_buckets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], grams, len(gain))
                order = np.argsort(row, kind="stable") if grams > 1 else slice(None)
                size = np.bincount(row, minlength=hi - lo)
                at = starts_of(size)
                total = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in (size, n, total[at[1:]] - total[at[:-1]]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def gumbel(seed: int, key: Column) -> Column:
    """Thousandths of a Gumbel variate, rounded down, drawn by the sha256 of seed and key (a null key counts as empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _before(columns: list[str], key: Row) -> Column:
    """Rows that stand before ``key`` in the order of ``columns`` (none of them null)."""
    out = F.lit(False)
    for c in reversed(columns):
        out = (F.col(c) < key[c]) | ((F.col(c) == key[c]) & out)
    return out


def _at(columns: list[str], key: Row) -> Column:
    return reduce(Column.__and__, [F.col(c) == key[c] for c in columns])


def kth(rows: DataFrame, columns: list[str], k: int) -> Row:
    """The k-th (from 1) of rows in the order of ``columns``, which are not null and unique as a whole.

    Each round draws PIVOTS rows by a hash, counts exactly how many rows lie before, at and behind each of them, and goes
    on with the rows between the two pivots that enclose the k-th, written out anew. With PIVOTS rows or fewer left every one
    is a pivot, so it ends. Nothing but the pivots and their counts goes to the driver."""
    rows = rows.select(*columns)
    for turn in range(1_000):
        pivots = sorted(rows.orderBy(F.xxhash64(F.lit(turn), *columns), *columns).limit(PIVOTS).collect(), key=lambda r: tuple(r[c] for c in columns))
        if not pivots:
            break
        count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
        sums = rows.agg(*(count(_before(columns, p)).alias(f"l{i}") for i, p in enumerate(pivots)), *(count(_at(columns, p)).alias(f"e{i}") for i, p in enumerate(pivots))).first()
        low = high = None
        done = 0
        for i, p in enumerate(pivots):
            less, same = sums[f"l{i}"], sums[f"e{i}"]
            if less < k <= less + same:
                return p
            if less + same < k:
                low, done = p, less + same
            elif high is None:
                high = p
        if low is not None:
            rows = rows.where(~_before(columns, low) & ~_at(columns, low))
        if high is not None:
            rows = rows.where(_before(columns, high))
        rows, k = stage(rows, "between"), k - done
    raise ValueError("there are fewer rows than k")


def _ranked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with their rank (from 1) in the order of ``columns``: sorted ranges, numbered with the sizes of those before."""
    parts = stage(rows.repartitionByRange(*columns).withColumn("part", F.spark_partition_id()), "winners")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    offsets = stage(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= MOST_PARTS else offsets.hint("merge")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*columns))
    return parts.withColumn("place", place).join(offsets, "part").withColumn("rank", F.col("offset") + F.col("place")).drop("part", "place", "offset")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    grams: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: of the N documents with at least ``least_words`` words, the
    floor(percent * N / 100) highest scores are drawn and ranked from 1, ties to the smaller doc_id; others have no rank.

    Null and empty texts (in either table) have no words, weigh 0 and are never drawn while ``least_words`` is above 0. Rows
    that repeat an id are rows of their own with the same noise; among equal scores and ids the order of the rows in the
    input's partitions decides. A null id draws by the seed alone and stands after the others of its score. Other columns are
    left out, whatever their names. An empty corpus gives an empty result; with an empty target all shares are smoothing."""
    gain = gains(bucket_counts(target, grams, buckets, text_col), bucket_counts(docs, grams, buckets, text_col))
    scored = weighted(docs, gain, grams, id_col, text_col).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    keys = {"k_score": -F.col("score"), "k_null": F.col("doc_id").isNull().cast("int"), "k_id": F.coalesce("doc_id", F.lit(0)), "k_row": F.monotonically_increasing_id()}
    rows, order = stage(scored.withColumns(keys), "scored"), list(keys)
    fit = rows.where(F.col("n_words") >= least_words)
    k = percent * fit.count() // 100
    result = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return rows.select(*result, none)
    last = kth(fit, order, k)
    won = (F.col("n_words") >= least_words) & (_before(order, last) | _at(order, last))
    winners = _ranked(rows.where(won).select(*result, *order), order)
    return winners.select(*result, "rank").unionByName(rows.where(~won).select(*result, none))
