"""Removal of byte strings that occur more than once, by suffix arrays.

A string of LENGTH bytes is a window. Windows are dealt out by content: the leftmost least k-gram of a window (by hash) is
its anchor, so equal windows have equal anchors at equal places. Consecutive windows of one anchor form a unit, some 270
bytes. Anchors that occur once in all documents can't hold a repeated window and go no further. Equal units are counted, not
copied; the windows of a unit that occurs twice are all repeated. The different units of each remaining anchor are laid end
to end, a suffix array is built over them in two stages, and windows whose suffixes have a common prefix of LENGTH bytes
with a neighbour are repeated.

An anchor of more units than one array takes is dealt again, by more content: its windows are halved by the place of the
anchor, and those of a half are dealt by all bytes that they share. Units become equal or part company, so after a few
halvings, eight at the utmost, every group fits an array or is one unit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_WORD, concat_ranges, free_name, lean, mix, powers, slices, stage, starts_of, utf8

LENGTH, GRAM = 200, 64
#: Bytes handled at once in a pass over texts; bytes from which a suffix array takes no further group; units of one group in
#: one suffix array.
CHUNK, BLOCK, PART = 2 << 20, 256 << 10, 2048
_U = np.uint64
#: Low bits that hold a position while least k-grams are searched.
_AT = _U((1 << 24) - 1)
UNIT = "k1 long, k2 long, a long, c long, lead int, n int, s long"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def units(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, content hash, bytes before the anchor, windows, first window) of each unit of the rows."""
    n, wide = len(raw), LENGTH - GRAM + 1
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(BYTE_WORD[raw] * up[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    anchor = (sliding_min((gram & ~_AT) | np.arange(len(gram), dtype=_U), wide) & _AT).astype(np.int64)
    size = np.diff(offs)
    starts = concat_ranges(offs[:-1], np.maximum(size - LENGTH + 1, 0))
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    own = anchor[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(starts)))
    s = starts[at]
    content = mix((total[s + count - 1 + LENGTH] - total[s]) * down[s] + count.astype(_U))
    row = np.searchsorted(offs, s, "right") - 1
    return row, gram[own[at]].view(np.int64), content.view(np.int64), own[at] - s, count, s - offs[row]


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` bytes at least, in two stages.

    Suffixes smaller than their successors are sorted directly. The rest follow from one scan of the buckets of first
    bytes in ascending order: whenever a suffix stands, the one before it, if greater, is next in its own bucket."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    # a run of equal bytes takes the type of its last byte; the last suffix is greater than the empty one
    change = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    rises = np.append(t[change[:-1]] < t[change[:-1] + 1], False)
    small = np.repeat(rises, np.diff(np.concatenate(([-1], change))))
    direct = np.flatnonzero(small)
    direct = np.array(sorted(direct.tolist(), key=lambda i: text[i : i + depth]), np.int64)
    bounds = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1], np.int64))
    out = []

    def before(found: np.ndarray) -> np.ndarray:
        p = found[found > 0] - 1
        return p[~small[p]]

    for c in range(256):
        parts, level = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(level):  # those whose successor is in this bucket as well stand after all it follows from
            parts.append(level)
            p = before(level)
            level = p[t[p] == c]
        parts.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        p = before(bucket)
        p = p[t[p] > c]
        by = np.argsort(t[p], kind="stable")
        p, cuts = p[by], np.searchsorted(t[p][by], np.arange(257))
        for x in np.unique(t[p]).tolist():
            waiting[x].append(p[cuts[x] : cuts[x + 1]])
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it, up to ``most``; the first has 0."""
    t = np.frombuffer(text + bytes(most), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(t, most)
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 4096):
        a, b = order[lo - 1 : lo + 4095], order[lo : lo + 4096]
        differ = rows[a[: len(b)]] != rows[b]
        out[lo : lo + len(b)] = np.where(differ.any(1), differ.argmax(1), most)
    left = len(text) - np.maximum(order, np.roll(order, 1))
    return np.minimum(out, left)


def repeated(data: list[bytes], windows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the units occur twice or more, a unit counting ``weight`` times; and where each unit's windows begin
    among them."""
    text = b"".join(data)
    begin = starts_of(np.array([len(x) for x in data]))
    at = starts_of(windows)
    place = np.full(len(text), -1, np.int64)
    place[concat_ranges(begin[:-1], windows)] = np.arange(at[-1])
    order = suffix_array(text, LENGTH)
    order = order[place[order] >= 0]
    kind = np.cumsum(common_prefixes(text, order, LENGTH) < LENGTH) - 1
    classes = np.empty(at[-1], np.int64)
    classes[place[order]] = kind
    total = np.bincount(classes, np.repeat(weight, windows)) if at[-1] else np.zeros(0)
    return total[classes] >= 2, at


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs with two columns that name the row by id and text (without an id by two hashes of the text) and one that holds its
    text, under names that docs doesn't have. Rows that share a name have the same text, and so the same answer."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1 = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit(1), text))
    names = [free_name(docs.columns, x) for x in ("_suffix_k1", "_suffix_k2", "_suffix_text")]
    return docs.withColumns(dict(zip(names, (k1, F.xxhash64(text), text), strict=True))), names


#: A unit on its way to a suffix array: its group, the places of the anchor that the group's windows have (least and greatest),
#: bytes before the anchor, windows, copies, where it stands (row and first window; s is -1 once its windows are known to be
#: repeated), and its bytes.
PIECE = "g long, lo int, hi int, lead int, n int, weight long, k1 long, k2 long, s long, data binary"
SPAN = "k1 long, k2 long, start long, stop long"


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units cut in two by the place of the anchor, their group named by the bytes that all windows of the half share."""
    for b in batches:
        rows = {name: [] for name in (*b.schema.names, "h1", "h2")}
        for r in b.to_pylist():
            mid, lead, n = (r["lo"] + r["hi"]) // 2, r["lead"], r["n"]
            for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                least, most = max(lo, lead - n + 1), min(hi, lead)
                if least > most:
                    continue
                first = lead - most
                data = r["data"][first : first + most - least + LENGTH]
                shared = hashlib.blake2b(r["data"][lead - lo : lead + LENGTH - hi], digest_size=8, salt=bytes((lo, hi))).digest()
                whole = hashlib.blake2b(data, digest_size=16).digest()
                new = {"g": int.from_bytes(shared, "little", signed=True), "lo": lo, "hi": hi, "lead": most, "n": most - least + 1, "s": r["s"] + first if r["s"] >= 0 else -1, "data": data}
                new |= {"h1": int.from_bytes(whole[:8], "little", signed=True), "h2": int.from_bytes(whole[8:], "little", signed=True)}
                for name, values in rows.items():
                    values.append(new.get(name, r.get(name)))
        yield pa.RecordBatch.from_arrays([pa.array(v, b.schema.field(k).type if k in b.schema.names else pa.int64()) for k, v in rows.items()], list(rows))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over groups that lie together; the bytes that repeated windows cover, for units that have a place."""
    held: list[pa.RecordBatch] = []

    def emptied() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        n, s = t["n"].to_numpy().astype(np.int64), t["s"].to_numpy()
        hit, at = repeated(t["data"].to_pylist(), n, t["weight"].to_numpy())
        unit = np.repeat(np.arange(len(n)), n)
        hit &= s[unit] >= 0
        edge = np.ones(len(hit) + 1, bool)
        edge[1:-1] = (hit[1:] != hit[:-1]) | (unit[1:] != unit[:-1])
        cuts = np.flatnonzero(edge)
        runs = np.flatnonzero(hit[cuts[:-1]])
        first, last = cuts[runs], cuts[runs + 1] - 1
        of = unit[first]
        start, stop = (s[of] + x - at[of] for x in (first, last))
        return pa.RecordBatch.from_arrays([t["k1"].combine_chunks().take(pa.array(of)), t["k2"].combine_chunks().take(pa.array(of)), pa.array(start), pa.array(stop + LENGTH)], ["k1", "k2", "start", "stop"])

    size, last = 0, None
    for b in batches:
        keys = b.column(0).to_pylist()
        length = np.diff(utf8(b.column(9))[1])
        lo = 0
        for i, key in enumerate(keys):
            if key != last and size >= BLOCK:
                held.append(b.slice(lo, i - lo))
                yield emptied()
                lo, size = i, 0
            last, size = key, size + int(length[i])
        held.append(b.slice(lo))
    if sum(map(len, held)):
        yield emptied()


def _unsettled(kinds: DataFrame) -> DataFrame:
    """Units of groups that hold several, one of them without a copy: kinds with the number of units of its group."""
    groups = stage(kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.min("weight").alias("rarest")).where("kinds > 1 AND rarest = 1").select("g", "kinds"), "groups")
    return kinds.join(groups.hint("merge"), "g")


def _dealt_again(wide: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(pieces that fit suffix arrays, spans already known) of groups that are too large, halved until none is."""
    fit, spans, names = [], [], [x.split()[0] for x in PIECE.split(", ")]
    while not wide.isEmpty():
        halves = stage(wide.mapInArrow(lean(_halves), PIECE + ", h1 long, h2 long"), "halves")
        same = ["g", "h1", "h2", "lead", "n"]
        one = ("lo", "hi", "k1", "k2", "s", "data")
        kinds = halves.groupBy(*same).agg(F.sum("weight").alias("weight"), F.count("*").alias("met"), *(F.any_value(c).alias(c) for c in one))
        kinds = stage(kinds.withColumn("s", F.when(F.col("weight") == 1, F.col("s")).otherwise(-1)), "half-kinds")
        copies = halves.where("s >= 0").join(kinds.where("met > 1").select(*same).hint("merge"), same)
        spans.append(_covering(copies))
        left = stage(_unsettled(kinds).select(*names, "kinds"), "left")
        large = (F.col("kinds") > PART) & (F.col("lo") < F.col("hi"))
        fit.append(left.where(~large).select(*names))
        wide = left.where(large).select(*names)
    return fit, spans


def _covering(whole: DataFrame) -> DataFrame:
    """Spans of units all of whose windows are repeated."""
    return whole.select("k1", "k2", F.col("s").alias("start"), (F.col("s") + F.col("n") - 1 + LENGTH).alias("stop"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, spans): for each text that has any, the byte ranges that repeated windows cover. k1 is the id, k2 the text's
    xxhash64 (without an id k1 is a hash of the text, too)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(2))
            for lo, hi in slices(offs, CHUNK):
                span, begin = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                for a in range(0, max(1, len(span)), CHUNK):  # only a very long text takes more than one turn
                    if a == 0 and len(span) <= CHUNK:
                        row, anchor, content, lead, n, s = units(span, begin)
                    else:
                        piece = span[a : a + CHUNK + LENGTH - 1]
                        row, anchor, content, lead, n, s = units(piece, np.array([0, len(piece)]))
                    keys = [b.column(i).take(pa.array(row + lo)) for i in (0, 1)]
                    columns = [anchor, content, lead.astype(np.int32), n.astype(np.int32), s + a]
                    yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns)], ["k1", "k2", "a", "c", "lead", "n", "s"])

    rows, names = _keyed(docs, id_col, text_col)
    text = rows.select(*(F.col(x).alias(y) for x, y in zip(names, ("k1", "k2", "text"), strict=True)))
    all_units = stage(text.mapInArrow(lean(cut), UNIT), "units")
    # counts are written first, so that their join is one that Spark can split where an anchor is very common
    often = stage(all_units.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"), "anchors")
    found = stage(all_units.join(often.hint("merge"), "a"), "repeated-anchors")
    same = ["a", "c", "lead", "n"]
    kinds = found.groupBy(*same).agg(F.count("*").alias("weight"), F.min(F.struct("k1", "k2", "s")).alias("at"))
    kinds = stage(kinds.select(*same, "weight", "at.*"), "unit-kinds")
    spans = [_covering(found.join(kinds.where("weight > 1").select(*same).hint("merge"), same))]

    wanted = _unsettled(kinds.withColumnRenamed("a", "g"))
    place = F.when(F.col("weight") == 1, F.col("s")).otherwise(-1)
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "lead", "n", "weight", "s", place.alias("place"), "kinds")).alias("units"))
    texts = text.join(wanted.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "units")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            b = b.filter(pa.array([k != p for k, p in zip(keys, [last, *keys], strict=False)], pa.bool_()))  # of equal rows one is enough
            last = keys[-1] if keys else last
            raw, offs = utf8(b.column(2))
            lists = b.column(3)
            flat, each = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            col = {f: flat.field(f) for f in ("g", "lead", "n", "weight", "s", "place", "kinds")}
            at = np.repeat(offs[:-1], each) + col["s"].to_numpy()
            end = at + col["n"].to_numpy() - 1 + LENGTH
            data = pa.array([raw[x:y].tobytes() for x, y in zip(at, end, strict=True)], pa.binary())
            row = pa.array(np.repeat(np.arange(len(each)), each))
            lo, hi = (pa.array(np.full(len(at), x, np.int32)) for x in (0, LENGTH - GRAM))
            yield pa.RecordBatch.from_arrays([col["g"], lo, hi, col["lead"], col["n"], col["weight"], b.column(0).take(row), b.column(1).take(row), col["place"], data, col["kinds"]], [*(x.split()[0] for x in PIECE.split(", ")), "kinds"])

    fetched = stage(texts.mapInArrow(lean(fetch), PIECE + ", kinds long"), "fetched")
    fit, known = _dealt_again(fetched.where(F.col("kinds") > PART).drop("kinds"))
    fit = _union([fetched.where(F.col("kinds") <= PART).drop("kinds"), *fit])
    spans += [*known, fit.repartition("g").sortWithinPartitions("g").mapInArrow(lean(_sorted), SPAN)]
    return _union(spans).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _runs(offs: np.ndarray, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the maximal runs that the rows' spans cover, as places in the rows laid end to end."""
    each = np.where(spans.is_valid().to_numpy(zero_copy_only=False), np.diff(spans.offsets.to_numpy()), 0)
    row = np.repeat(np.arange(len(each)), each)
    flat = spans.flatten()
    apart = offs[:-1][row] + row  # a place between every two rows keeps their runs apart
    start, stop = (apart + flat.field(x).to_numpy() for x in ("start", "stop"))
    by = np.argsort(start, kind="stable")
    row, start, stop = row[by], start[by], np.maximum.accumulate(stop[by])
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(start)), bool), start[1:] > stop[:-1])))
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    row = row[first]
    return row, start[first] - row, stop[last] - row


def _cut(raw: np.ndarray, lo: int, hi: int, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """raw[lo:hi] without the runs."""
    return [raw[x:y] for x, y in zip([lo, *stop], [*start, hi], strict=True)]


def _inward(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without the UTF-8 characters that they cover in part."""
    follows = np.append((raw & 0xC0) == 0x80, False)
    for _ in range(3):
        start = start + follows[start]
        stop = stop - follows[stop]
    return start, np.maximum(start, stop)


def _joined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with its spans; the names of the columns that hold the text (null as empty) and the spans."""
    keyed, (k1, k2, text) = _keyed(docs, id_col, text_col)
    spans = free_name(keyed.columns, "_suffix_spans")
    found = repeated_spans(docs, id_col, text_col).toDF(k1, k2, spans)
    return keyed.join(found.hint("merge"), [k1, k2], "left"), text, spans


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes left, for each row.

    Each byte that a window covers goes if the window also starts anywhere else, judged on the input. Null text is empty;
    repeated rows are documents that repeat each other; a null id stays null; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(1))
            row, start, stop = _runs(offs, b.column(2))
            n = len(offs) - 1
            removed, spans = np.bincount(row, stop - start, n).astype(np.int64), np.bincount(row, minlength=n)
            cuts, digests = np.searchsorted(row, np.arange(n + 1)), []
            for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                h = hashlib.sha256()
                for part in _cut(raw, offs[i], offs[i + 1], start[x:y], stop[x:y]):
                    h.update(part)
                digests.append(h.hexdigest())
            columns = [pa.array(np.diff(offs)), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined, text, spans = _joined(docs, id_col, text_col)
    rows = joined.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(spans).alias("spans"))
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated windows cut out of the text. A character that a span covers in part stays whole; null text
    stays null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(at))
            row, start, stop = _runs(offs, b.column(len(names)))
            start, stop = _inward(raw, start, stop)
            n = len(offs) - 1
            kept = starts_of(np.diff(offs) - np.bincount(row, stop - start, n).astype(np.int64))
            left = np.concatenate([np.zeros(0, np.uint8), *_cut(raw, 0, len(raw), start, stop)])
            text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(kept), pa.py_buffer(left))
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pc.if_else(b.column(at).is_valid(), text, pa.scalar(None, pa.large_string())).cast(b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    joined, _, spans = _joined(docs, id_col, text_col)
    return joined.select(*names, spans).mapInArrow(lean(run), docs.schema)
