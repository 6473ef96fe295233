"""Byte-level BPE with a file of ranks: whole texts to ids and ids to bytes.

The matches of a pattern are encoded each by itself. The different ones of a slice of texts are put into padded matrices by
length; in each round every row merges its leftmost pair of least rank, found by one argmin, and the matrix loses a column
and the rows that are done. Ranks of pairs come from a hash table in numpy arrays."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, concat_ranges, slices, starts_of, utf8

#: Rank of pairs that don't merge.
NONE = np.iinfo(np.int32).max
#: Widths of the matrices; longer matches are merged one by one.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48)
#: Matches that are encoded together, cells of a matrix, bytes of text at a time, characters from which a text is cut.
MATCHES, CELLS, SLICE, LONG_TEXT = 1 << 20, 1 << 21, 4 << 20, 1 << 22
#: Where a text can be cut whatever stands around: before a lone space between others, where a match always begins.
SAFE_CUT = r"(?<=\S) (?=\S)"


class PairTable:
    """Ranks by pair of ids: open addressing, all keys of a batch probed together."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(4 * len(rank) + 1).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, todo = self._key(left, right), np.arange(len(rank))
        slot = self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.ranks[slot[todo]] == NONE)
            at, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free[first]]
            self.keys[at], self.ranks[at] = keys[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * BASE
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids (none of them negative)."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.ranks[slot] != NONE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            s = slot[todo]
            hit = self.keys[s] == keys[todo]
            out[todo[hit]] = self.ranks[s[hit]]
            todo = todo[~hit & (self.ranks[s] != NONE)]
        return out


class ByteBPE:
    """A vocabulary read from lines of base64 bytes and rank; ids are the ranks. Every single byte needs one."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if lacking := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"no rank for bytes {lacking}")
        usual = pattern is None or pattern == public_tokenizers.PATTERN
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.cut = regex.compile(SAFE_CUT) if usual else None
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(u, v, r) for w, r in self.rank.items() for i in range(1, len(w)) if (u := self.rank.get(w[:i])) is not None and (v := self.rank.get(w[i:])) is not None]
        self.pairs = PairTable(*np.array(pairs or np.zeros((0, 3), int)).T.astype(np.int32))
        ids = np.array(list(self.rank.values()))
        length = np.zeros(int(ids.max()) + 1, np.int64)
        length[ids] = [len(w) for w in self.rank]
        self.length, self.first = length, starts_of(length)
        self.bytes = np.frombuffer(b"".join(sorted(self.rank, key=self.rank.get)), np.uint8)

    def _matrix(self, ids: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge the rows of a padded matrix (-1 behind each row's end): yields rows, their sizes and their ids end to end."""
        rows = np.arange(len(ids))
        there = ids[:, 1:] >= 0
        rank = np.full(there.shape, NONE, np.int32)
        rank[there] = self.pairs(ids[:, :-1][there], ids[:, 1:][there])
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                flat = ids[done]
                yield rows[done], size[done], flat[flat >= 0]
                live = ~done
                rows, ids, rank, size, at, best = rows[live], ids[live], rank[live], size[live], at[live], best[live]
                if not len(rows):
                    return
            column, n = np.arange(ids.shape[1] - 1), np.arange(len(rows))
            behind = column > at[:, None]
            ids = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[n, at] = best
            rank = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            size = size - 1
            for left in (at - 1, at):  # the two pairs that the new id is in
                ok = np.flatnonzero((left >= 0) & (left + 1 < size))
                new = self.pairs(ids[ok, left[ok]], ids[ok, left[ok] + 1])
                rank[ok, left[ok]] = new
            last = np.flatnonzero(at == size - 1)
            last = last[at[last] < rank.shape[1]]
            rank[last, at[last]] = NONE

    def _single(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row. All places of the least rank are merged at once, from the left, as far as no merge makes a pair
        of a lesser rank, which would have to go first."""
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            run = np.concatenate(([True], np.diff(at) != 1))
            start = at[np.flatnonzero(run)][np.cumsum(run) - 1]
            at = at[(at - start) % 2 == 0]  # of overlapping pairs every other
            pad = np.concatenate((ids, [-1, -1]))
            before = np.where(np.concatenate(([False], np.diff(at) == 2)), least, np.concatenate(([-1], ids))[at])
            lesser = np.zeros(len(at), bool)
            for x, y in ((before, np.full(len(at), least)), (np.full(len(at), least), pad[at + 2])):
                ok = (x >= 0) & (y >= 0)
                lesser[ok] |= self.pairs(x[ok], y[ok]) < least
            if lesser.any():
                at = at[: int(lesser.argmax()) + 1]
            gone = np.ones(len(ids), bool)
            gone[at + 1] = False
            ids[at] = least
            ids = ids[gone]
            rank = np.append(rank, NONE)[gone][:-1]
            new = at - np.arange(len(at))
            for left in (new - 1, new):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                rank[left] = self.pairs(ids[left], ids[left + 1])
        return ids

    def merged(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, end to end, of different matches, each of which is encoded by itself."""
        raw, offs = np.frombuffer(b"".join(matches), np.uint8), starts_of(np.fromiter(map(len, matches), np.int64, len(matches)))
        length, size = np.diff(offs), np.ones(len(matches), np.int64)
        whole = np.fromiter((self.rank.get(m, -1) for m in matches), np.int64, len(matches))
        known = np.flatnonzero(whole >= 0)
        parts = [(known, np.ones(len(known), np.int64), whole[known])]
        todo, low = np.flatnonzero(whole < 0), 0
        for width in WIDTHS:
            own = todo[(length[todo] > low) & (length[todo] <= width)]
            low = width
            for i in range(0, len(own), CELLS // width):
                some = own[i : i + CELLS // width]
                inside = np.arange(width) < length[some][:, None]
                ids = np.full(inside.shape, -1, np.int32)
                ids[inside] = self.of_byte[raw[concat_ranges(offs[some], length[some])]]
                parts += [(some[r], n, x) for r, n, x in self._matrix(ids, length[some])]
        for i in todo[length[todo] > low]:
            ids = self._single(self.of_byte[raw[offs[i] : offs[i + 1]]])
            parts.append((np.array([i]), np.array([len(ids)]), ids))
        for at, n, _ in parts:
            size[at] = n
        first = starts_of(size)
        out = np.zeros(first[-1], np.uint32)
        for at, n, ids in parts:
            out[concat_ranges(first[at], n)] = ids
        return size, out

    def _matches(self, text: str) -> Iterator[list[str]]:
        lo = 0
        while self.cut and len(text) - lo > LONG_TEXT and (m := self.cut.search(text, lo + LONG_TEXT)):
            yield self.pattern.findall(text, lo, m.start())
            lo = m.start()
        yield self.pattern.findall(text, lo) if lo else self.pattern.findall(text)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all rows end to end, and how many each row has; null is empty."""
        counts = np.zeros(len(text), np.int64)
        found: list[np.ndarray] = []
        words: list[str] = []
        of: list[tuple[int, int]] = []

        def flush() -> None:
            coded = pa.array(words, pa.string()).dictionary_encode()
            size, ids = self.merged(coded.dictionary.cast(pa.binary()).to_pylist())
            word = coded.indices.to_numpy(zero_copy_only=False)
            each = size[word]
            found.append(ids[concat_ranges(starts_of(size)[word], each)])
            rows, n = np.array(of).T
            np.add.at(counts, rows, np.diff(starts_of(each)[starts_of(n)]))
            words.clear()
            of.clear()

        for i, t in enumerate(text):
            for some in self._matches(t.as_py() or ""):
                words += some
                of.append((i, len(some)))
                if len(words) >= MATCHES:
                    flush()
        if of:
            flush()
        return np.concatenate(found) if found else np.zeros(0, np.uint32), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows end to end, and where each row's begin (and the last ends). An id without bytes is an error."""
        if len(ids) and (int(ids.max()) >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.length[ids]
        return self.bytes[concat_ranges(self.first[ids], n)], starts_of(n)[starts_of(counts)]


_codecs: dict[tuple[str, str | None], ByteBPE] = {}


def codec(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """One codec for each vocabulary, pattern and worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(path, pattern)
    return _codecs[path, pattern]


def _coded(batches: Iterator[pa.RecordBatch], path: str | None, pattern: str | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, ids and counts of slices of rows (key, text)."""
    bpe = codec(path, pattern)
    for batch in batches:
        for lo, hi in slices(utf8(batch.column(1))[1], SLICE):
            yield batch.column(0).slice(lo, hi - lo), *bpe.encode(batch.column(1).slice(lo, hi - lo))


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every whole text, as the ranks in ``path`` give them without special tokens.

    Null and empty texts have no ids; rows that repeat an id or have none are rows of their own; other columns are left
    out; an empty table gives an empty result. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, n in _coded(batches, path, pattern):
            lists = pa.ListArray.from_arrays(pa.array(starts_of(n).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n), lists], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decoded(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes of rows (doc_id, ids); a null list is empty. Cut-off ids may give bytes that are no whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            raw, at = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False), n)
            buffers = [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.BinaryArray.from_buffers(pa.binary(), len(n), buffers)], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids as little-endian unsigned 32-bit integers, sha256 of the bytes that they decode to;
    edge cases as in ``encoded``. Ids stay in the task that makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for keys, ids, n in _coded(batches, path, pattern):
            raw, at = bpe.decode(ids, n)
            ids, first = np.ascontiguousarray(ids, "<u4"), starts_of(n)
            digests = [[hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)] for x, cut in ((ids, first), (np.ascontiguousarray(raw), at))]
            yield pa.RecordBatch.from_arrays([keys, pa.array(n), *map(pa.array, digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
