"""Minimum bin slack packing of tokenized documents into training sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, starts_of, utf8
from .tokens import encoder, vocabulary_path, with_end

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Remainders that wait for a window: windows are filled while more than this many wait.
POOL = 2048
#: Bytes of text that are encoded at once.
SLICE = 2 << 20


def subset_sum(lengths: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length (at most the given counts) to take so that their sum is the largest not above target.

    The bits of an integer are the sums reached; each length enters in lots of 1, 2, 4, ... of its count. The search
    ends once the target is reached; the choice is read back from the sums reached before each lot."""
    reached, full, lots = 1, (1 << (target + 1)) - 1, []
    for length in sorted(lengths, reverse=True):
        left, lot = min(lengths[length], target // length), 1
        while left > 0 and not reached >> target & 1:
            n = min(lot, left)
            lots.append((length, n, reached))
            reached |= (reached << (length * n)) & full
            left, lot = left - n, 2 * lot
        if reached >> target & 1:
            break
    best, taken = reached.bit_length() - 1, defaultdict(int)
    for length, n, before in reversed(lots):
        if not before >> best & 1:
            taken[length] += n
            best -= length * n
    return dict(taken)


class Packer:
    """Packs the pieces of one partition. Each window takes the longest remainder that waits and the multiset of others
    that comes closest to the capacity; what slack stays is filled by cutting one more remainder. The last window, if
    short, is cut into sequences of powers of two, which need no padding."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.waiting = self.tokens = 0
        self.rows: list[tuple] = []

    def place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        if n:
            self.pool[n].append(piece)
            self.waiting, self.tokens = self.waiting + 1, self.tokens + n

    def take(self, length: int) -> tuple:
        found = self.pool[length]
        piece = found.pop()
        if not found:
            del self.pool[length]
        self.waiting, self.tokens = self.waiting - 1, self.tokens - length
        return piece

    def cut(self, room: int) -> tuple:
        """A piece of at most ``room`` ids off the longest remainder."""
        doc, start, ids, total = self.take(max(self.pool))
        self.put((doc, start + room, ids[room:], total))
        return doc, start, ids[:room], total

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        c, total = self.capacity, len(ids)
        for at in range(0, total - c + 1, c):
            self.place([(doc, at, ids[at : at + c], total)])
        self.put((doc, total - total % c, ids[total - total % c :].copy(), total))
        while self.waiting > POOL and self.tokens >= c:
            self.window()

    def window(self) -> None:
        longest = self.take(max(self.pool))
        room, pieces = self.capacity - len(longest[2]), [longest]
        for length, n in subset_sum({k: len(v) for k, v in self.pool.items() if k <= room}, room).items():
            pieces += [self.take(length) for _ in range(n)]
            room -= n * length
        if room:
            pieces.append(self.cut(room))
        self.place(pieces)

    def finish(self) -> None:
        while self.tokens >= self.capacity:
            self.window()
        while self.tokens:
            room, pieces = 1 << (self.tokens.bit_length() - 1), []
            while room:
                pieces.append(self.cut(room))
                room -= len(pieces[-1][2])
            self.place(pieces)

    def emptied(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each input partition is packed by itself as it is scanned: no shuffle, and memory for one slice of texts and POOL
    remainders. sequence_id is the partition's number times 2**32 plus a running number. Null or empty text is the end
    id alone; repeated rows are packed each; a null id stays null; an empty table gives no piece. ``capacity`` must be a
    power of two, so that a full sequence and the last short ones need no padding."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(vocabulary), Packer(capacity, TaskContext.get().partitionId() << 32)

        def out() -> pa.RecordBatch:
            columns = zip(*packer.emptied(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns] or [pa.array([], pa.int64())] * len(FIELDS), FIELDS)

        for batch in batches:
            keys, text = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(utf8(text)[1], SLICE):
                ids, n = with_end(*enc(text.slice(lo, hi - lo)), end_id)
                ids, at = ids.astype("<u4"), starts_of(n)
                for i in range(hi - lo):
                    packer.add(keys[lo + i], ids[at[i] : at[i + 1]])
                yield out()
        packer.finish()
        yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), SCHEMA)
