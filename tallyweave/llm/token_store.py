"""Token ids in Parquet list columns that can be read selectively.

Layout of a store: one Parquet folder, a file for each shard of ascending document ids. Columns: doc_id, shard, first
(ids of the shard before this document), n_tokens, ids (list of int). Ids are dictionary-encoded (a vocabulary fits one
dictionary page and packs to its bit width); doc_id, shard, first and n_tokens are delta-encoded (page version 2, no
dictionary). Row groups and pages are kept small, so the page indexes let a reader fetch few pages for a range of ids,
and metadata columns can be read without the ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stage, starts_of, utf8
from .tokens import encoder, vocabulary_path, with_end

SCHEMA = "doc_id long, shard int, first long, n_tokens int, ids array<int>"
#: Parquet settings of a store: bytes of a row group, bytes and rows of a page.
LAYOUT = {"parquet.block.size": 32 << 20, "parquet.page.size": 256 << 10, "parquet.page.row.count.limit": 2000}

#: Files of which the offsets are broadcast (16 MB at the utmost); those of more are joined.
SHARDS = 1 << 20


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them to ``path`` in ascending id order.

    Null or empty text gives the end id alone. Rows of one id keep together, ordered by text; a null id sorts first.
    Other columns are left out. An empty table gives an empty store. Range partitioning by id is the one shuffle."""
    vocabulary = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, first = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            text = batch.column(1)
            for lo, hi in slices(utf8(text)[1], 6 << 20):
                ids, n = with_end(*enc(text.slice(lo, hi - lo)), end_id)
                at = starts_of(n)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [batch.column(0).slice(lo, hi - lo), np.full(hi - lo, shard, np.int32), first + at[:-1], n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["doc_id", "shard", "first", "n_tokens", "ids"])
                first += int(at[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, SCHEMA).write
    for column in ("doc_id", "shard", "first", "n_tokens"):
        out = out.option(f"parquet.enable.dictionary#{column}", "false")
    for k, v in LAYOUT.items():
        out = out.option(k, v)
    out.option("parquet.writer.version", "v2").option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None, ids: bool = True) -> DataFrame:
    """doc_id, shard, start (ids of all documents before it), n_tokens, ids; the documents of first_id to last_id, if given.

    Bounds go down to the scan, where row groups and pages that hold none of them are skipped; without ``ids`` that column,
    nearly all of the store, isn't read (rows whose id is null are left out by bounds). Each shard's offset is the sum of
    those before it, from the small columns alone; that table has a row for each file and is broadcast up to SHARDS rows."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    for bound, test in ((first_id, F.col("doc_id") >= first_id), (last_id, F.col("doc_id") <= last_id)):
        rows = rows if bound is None else rows.where(test)
    offsets = stage(offsets, "offsets")
    joined = rows.join(F.broadcast(offsets) if offsets.count() <= SHARDS else offsets.hint("merge"), "shard")
    columns = ["doc_id", "shard", (F.col("offset") + F.col("first")).alias("start"), "n_tokens"]
    return joined.select(*columns, "ids") if ids else joined.select(*columns)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = tokens.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")
    return columns.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
