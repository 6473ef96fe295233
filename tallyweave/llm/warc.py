"""WARC archives with revisit records, their capture index, and the merge of index runs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

#: Payloads shorter than this are always stored whole.
MIN_REVISIT = 100
#: Records of one archive file, at most. A file also holds no more than one partition of the write, which Spark sizes by bytes.
FILE_RECORDS = 2_000
#: Compressed bytes that are inflated in one step.
STEP = 1 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, url_key string, ts string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long"
FIELDS = [x.split()[0] for x in INDEX.split(", ")]


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, size, first: the page whose record a copy refers to (null: none).

    The least page of each digest comes from a pre-aggregated minimum; a popular payload is one row there, and Spark can
    split its side of the join."""
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    binary = F.col("payload").cast("binary")
    p = p.withColumn("digest", F.sha2(binary, 256)).withColumn("size", F.octet_length("payload").cast("long"))
    ids = p.select("page_id", "digest", "size").where(F.col("size") >= MIN_REVISIT)
    shared = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return p.join(shared.hint("merge"), "digest", "left")  # payloads travel once, at any size


def records(c: DataFrame) -> DataFrame:
    """One string for each capture: its WARC record without the closing blank lines.

    Pages have no time of capture, so WARC-Date is one made of the page id: distinct, and the same in every run."""
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    date = F.date_format(F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) % 4_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    key = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(key(F.col("page_id")), F.lit("<urn:page:>"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.when(uri != "", F.concat(F.lit("WARC-Target-URI: "), uri)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), key(F.col("first")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    return c.withColumn("block", block).select(F.concat(head, F.lit(END), F.col("block")).alias("value"))


def write_warc(pages: DataFrame, path: str, **columns: str) -> None:
    """Write one record for each page to gzipped archives under ``path``.

    Null payload or url counts as empty; a null id is an unnamed record, which others may refer to only if no named one
    has the payload. Repeated rows make repeated records; the copies of the first page stay responses. Spark's text
    writer joins records with the blank lines that end each, so any store that Spark writes to will do."""
    out = records(captures(pages, **columns)).write.option("maxRecordsPerFile", FILE_RECORDS)
    out.option("lineSep", END).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then path and query; scheme, www and fragment dropped."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)", url)
    host, rest = m[1].lower().removeprefix("www."), m[2] or "/"
    return f"{','.join(reversed(host.split('.')))}){rest.lower()}"


class Inflated:
    """The bytes of a gzip file of any number of members, inflated as they are asked for."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.at, self.place = memoryview(data), 0, 0
        self.members, self.ready = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.members.eof:
            self.members = zlib.decompressobj(31)
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + STEP]
        self.at += len(piece)
        self.ready += self.members.decompress(piece, 8 * STEP)
        self.at -= len(self.members.unused_data if self.members.eof else self.members.unconsumed_tail)
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before ``mark``, which is passed; nothing at the end of the file."""
        seen = 0
        while (stop := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self._more():
                if self.ready:
                    raise ValueError(f"the archive ends within a record, at byte {self.place}")
                return b""
        out = self.take(stop)
        self.take(len(mark))
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self._more():
            pass
        if len(self.ready) < n:
            raise ValueError(f"the archive ends within a record, at byte {self.place}")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        self.place += n
        return out


def parse(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers (lower-case names), block, place and length (in bytes of the inflated archive) of each record, one in memory
    at a time."""
    source, end = Inflated(data), END.encode()
    while head := (place := source.place, source.until(end))[1]:
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {place}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        block = source.take(int(fields["content-length"]))
        if source.take(len(end)) != end:
            raise ValueError("a record doesn't end where its length says")
        yield fields, block, place, source.place - place


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").rstrip(">")
    return int(digits) if digits else None


def entry(file: str, head: dict[str, str], block: bytes, place: int, length: int) -> tuple:
    """The index line of a record; a response's payload is held against its length and digest."""
    cut = block.index(END.encode())
    http, payload = block[:cut], memoryview(block)[cut + len(END) :]
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    ts = re.sub(r"\D", "", head["warc-date"])
    return file, url_key(head.get("warc-target-uri", "")), ts, _number(head["warc-record-id"]), head["warc-type"], _number(head.get("warc-refers-to")), size, digest, place, length


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The capture index of the archives: a locally sorted run (url key, timestamp, page) for each file. A task holds one
    compressed file, one inflated record and the file's index lines; offset and length say where a record lies in the
    inflated archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = sorted((entry(name, *r) for r in parse(memoryview(content.as_buffer()))), key=order)
                if found:
                    yield pa.RecordBatch.from_pandas(_frame(found), preserve_index=False)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX)


def _frame(lines: list[tuple]):
    import pandas as pd

    return pd.DataFrame(lines, columns=FIELDS).astype({"page_id": "Int64", "refers_to": "Int64"})


def order(line: tuple) -> tuple:
    """Url key, timestamp, page; a missing page comes first."""
    return line[1], line[2], line[3] is not None, line[3] or 0


class LoserTree:
    """K-way merge of sorted runs: each inner node keeps the loser of its match, so the next line costs one path."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [0] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _next(self, i: int):
        line = next(self.runs[i], None)
        return None if line is None else (order(line), i, line)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head[2]
            win = self.winner
            self.heads[win] = self._next(win)
            node = (win + self.k) // 2
            while node >= 1:
                if self._less(self.losers[node], win):
                    self.losers[node], win = win, self.losers[node]
                node //= 2
            self.winner = win


def merge_index(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """Globally ordered capture history: partitions follow each other in url key and timestamp, and so do their rows.

    Range partitioning deals each file's run out by key; Spark sorts every run within its partition (spilling if need
    be) and the loser tree merges them. An index line has no payload, so what a task holds stays small. Many captures of
    one url still spread by timestamp and page."""
    keys = ["url_key", "ts", "page_id"]
    parts = index.repartitionByRange(partitions, *keys) if partitions else index.repartitionByRange(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            files = b.column(0).to_pylist()
            cuts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                runs.setdefault(files[lo], []).append(b.slice(lo, hi - lo))
        lines: list[tuple] = []
        for line in LoserTree([(tuple(r.values()) for b in bs for r in b.to_pylist()) for bs in runs.values()]):
            lines.append(line)
            if len(lines) == 20_000:
                yield pa.RecordBatch.from_pandas(_frame(lines), preserve_index=False)
                lines = []
        if lines:
            yield pa.RecordBatch.from_pandas(_frame(lines), preserve_index=False)

    return parts.sortWithinPartitions("file", *keys).mapInArrow(run, INDEX)


def archive(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder, read them back, and give their merged capture history."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return merge_index(read_index(spark, path))
