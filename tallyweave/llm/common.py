"""Shared pieces: the scratch folder, staged tables and numpy views of Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_U = np.uint64
#: Multipliers of the 64-bit mixer and of the rolling hashes (odd, so invertible modulo 2**64).
MIX_A, MIX_B, BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is configured a session on one machine (tests) takes a temporary one; on a
    cluster that is an error, since executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hand_back() -> None:
    """Give memory that was freed back to the system, as far as the platform's allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, handing back what it freed after each batch that it gives and when it ends. Workers are kept for
    later tasks, and without this each one holds the most that it ever used, whatever the step at hand needs."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            hand_back()
        hand_back()

    return wrapped


def free_name(columns: list[str], name: str) -> str:
    """``name``, or that with as many underscores behind it as make it none of ``columns`` (case doesn't count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values end to end, and where each begins; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("" if not pa.types.is_binary(col.type) else b"").cast(pa.large_binary())
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, past last) of about ``most`` bytes; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> _U(30))
    x *= MIX_A
    x ^= x >> _U(27)
    x *= MIX_B
    x ^= x >> _U(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept for the life of the worker."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        inverse = pow(int(BASE), -1, 1 << 64)
        for name, b in (("up", int(BASE)), ("down", inverse)):
            p = np.full(n, _U(b))
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


#: A fixed random word for each byte value.
BYTE_WORD = mix(np.arange(1, 257, dtype=_U) * BASE)


def _word_edges(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words ``[^\\x20\\x09-\\x0D]+`` begin and end."""
    n = len(raw)
    inside = np.ones(n + 1, bool)
    inside[:n] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    inside[n] = False
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1]))
    return np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))


#: By number of bytes, which bits of a little-endian 64-bit word they fill.
_FILLED = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


def word_names(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each word (A-Z in lower case), and how many words each row has.

    Words of one length up to eight bytes have different names; those of up to 16 are two such words mixed, longer ones
    keyed digests of all their bytes, so no form of a word makes names meet."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, ends = _word_edges(raw, offs)
    length = ends - starts
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    low = np.ascontiguousarray(eight[starts]).view("<u8").ravel() & _FILLED[np.minimum(length, 8)]
    names = mix(low * BASE + MIX_A)
    wide = np.flatnonzero(length > 8)
    high = np.ascontiguousarray(eight[starts[wide] + 8]).view("<u8").ravel() & _FILLED[np.minimum(length[wide] - 8, 8)]
    names[wide] = mix(names[wide] + mix(high * BASE + MIX_B))
    for i in np.flatnonzero(length > 16):
        names[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, key=b"word").digest(), "little")
    return mix(names + length.astype(_U)), np.diff(np.searchsorted(starts, offs))


def word_hashes(raw: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: a hash of each, its length in bytes, and how many each row has."""
    n = len(raw)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, ends = _word_edges(raw, offs)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(BYTE_WORD[raw] * up[:n], out=total[1:])
    length = ends - starts
    words = mix((total[ends] - total[starts]) * down[starts] + length.astype(_U))
    counts = np.diff(np.searchsorted(starts, offs))
    return words, length, counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def concat_ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices first[i] .. first[i] + length[i] - 1, for all i in turn."""
    at = starts_of(length)
    return np.arange(at[-1]) + np.repeat(first - at[:-1], length)
