"""Repair of conversations: the cheapest edits that make the roles read ``(s?(ua)+)?``, found by weighted interval parsing.

The repair grammar is in Chomsky normal form. A symbol X(p, q) derives the spans that lead from place p to place q of the
pattern; X(p, q) -> X(p, r) X(r, q) are its binary rules, and a row alone derives by keeping, reroling or deleting it, closed
under insertions before and after it. A cell holds the least (cost, audit) of its symbol over a span. As every symbol is a pair
of places, any cut of a span gives the same cell, so one cut in the middle is enough, and spans are combined bottom-up by
length: 1, 2, 4 and so on, all conversations of a batch side by side.

Two audits of one span and cost are never prefixes of each other (equal edits cost the same), so the least audit of a whole is
made of the least audits of its parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Places of the pattern: at its start, behind s, behind u, behind a; which letter leads where.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Places where a conversation may end.
ENDS = (0, 3)
#: Costs of the edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: White space, which makes a text blank.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FAR = 1 << 50

INITIALS = "sua"
#: Faults by number; blank and duplicate rows must go.
SOUND, CUT_OFF, DUPLICATE, BLANK = range(4)


def _insertions() -> dict[tuple[int, int], str]:
    """Fewest insertions that lead from place to place (only u and a can be inserted)."""
    out = {(p, p): "" for p in range(4)}
    for _ in range(4):
        for (p, r), word in list(out.items()):
            for c in "ua":
                if (q := STEPS[c].get(r)) is not None and len(word) + 1 < len(out.get((p, q), "I" * 9)):
                    out[p, q] = word + "I"
    return out


CLOSURE = _insertions()
#: Symbols of the grammar that can derive anything, and their binary rules.
SYMBOLS = sorted({(p, q) for p, q in product(range(4), range(4)) if p == q or (p, q) in CLOSURE or (p, q) == (0, 1)})
NUMBER = {x: i for i, x in enumerate(SYMBOLS)}
RULES = {(p, q): [(NUMBER[p, r], NUMBER[r, q]) for r in range(4) if (p, r) in NUMBER and (r, q) in NUMBER] for p, q in SYMBOLS}


def _row_cells() -> tuple[np.ndarray, np.ndarray]:
    """Cells of a row alone, by initial (others last) and fault."""
    cost = np.full((4 * 4, len(SYMBOLS)), FAR)
    audit = np.full(cost.shape, b"", "S5")
    for k, (c, fault) in enumerate(product((*INITIALS, None), range(4))):
        edits = [(p, p, DELETE, "D") for p in range(4)]
        if fault in (SOUND, CUT_OFF):
            extra = TRUNCATED * (fault == CUT_OFF)
            edits += [(p, q, extra, "K") for p, q in STEPS.get(c, {}).items()]
            edits += [(p, q, REROLE + extra, "R") for x in "ua" for p, q in STEPS[x].items()]
        for (p, a), (b, q) in product(CLOSURE, CLOSURE):
            for x, y, price, letter in edits:
                if (x, y) == (a, b):
                    before, after, i = CLOSURE[p, a], CLOSURE[b, q], NUMBER[p, q]
                    new = (price + INSERT * len(before + after), (before + letter + after).encode())
                    cost[k, i], audit[k, i] = min((cost[k, i], audit[k, i]) if cost[k, i] < FAR else new, new)
    return cost, audit


ROW_COST, ROW_AUDIT = _row_cells()
Cells = tuple[np.ndarray, np.ndarray]


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of spans out of those of their halves: for each symbol the least (cost, audit) over its rules."""
    (lc, la), (rc, ra) = left, right
    cost = np.empty_like(lc)
    audit = np.empty(lc.shape, f"S{la.dtype.itemsize + ra.dtype.itemsize}")
    for symbol, rules in RULES.items():
        k = NUMBER[symbol]
        prices = np.stack([lc[:, i] + rc[:, j] for i, j in rules])
        cost[:, k] = np.minimum(prices.min(axis=0), FAR)
        for first, ((i, j), price) in enumerate(zip(rules, prices, strict=True)):
            text = np.strings.add(la[:, i], ra[:, j])
            if first:
                better = (price == cost[:, k]) & ((prices[:first].min(axis=0) > price) | (text < audit[:, k]))
                text = np.where(better, text, audit[:, k])
            audit[:, k] = text
    return cost, audit


def parsed(kind: np.ndarray, sizes: np.ndarray) -> list[Cells]:
    """The cells of each conversation's whole span, as arrays of one row; conversations have ``sizes`` rows of these kinds (at
    least one)."""
    out: list[Cells] = [(ROW_COST[:0], ROW_AUDIT[:0])] * len(sizes)
    cost, audit, of = ROW_COST[kind], ROW_AUDIT[kind], np.repeat(np.arange(len(sizes)), sizes)
    while len(of):
        first = np.concatenate(([True], of[1:] != of[:-1]))
        start = np.flatnonzero(first)
        place = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        single = first & np.append(first[1:], True)
        for i in np.flatnonzero(single):
            out[of[i]] = (cost[i : i + 1], audit[i : i + 1])
        head = np.flatnonzero((place % 2 == 0) & ~single)
        pair = head[(head + 1 < len(of)) & (of[np.minimum(head + 1, len(of) - 1)] == of[head])]
        rest = np.setdiff1d(head, pair, assume_unique=True)
        both = combined((cost[pair], audit[pair]), (cost[pair + 1], audit[pair + 1]))
        order = np.argsort(np.concatenate((pair, rest)), kind="stable")
        cost = np.concatenate((both[0], cost[rest]))[order]
        audit = np.concatenate((both[1], audit[rest].astype(both[1].dtype)))[order]
        of = of[np.concatenate((pair, rest))[order]]
    return out


class Conversation:
    """What has been read of one conversation: counts, and cells of the spans read so far, joined when two are of one length."""

    def __init__(self) -> None:
        self.faults = np.zeros(4, np.int64)
        self.illegal = self.distinct = 0
        self.low = self.high = self.last = None
        self.spans: list[tuple[int, Cells]] = []

    def add(self, turn: list[int | None], initial: np.ndarray, fault: np.ndarray, cells: Cells) -> None:
        """Rows in order; initial: places in INITIALS (others 3)."""
        known = [t for t in turn if t is not None]
        if known:
            self.distinct += len(set(known)) - (self.high == known[0])
            self.low = known[0] if self.low is None else self.low
            self.high = known[-1]
        self.faults += np.bincount(fault, minlength=4)
        row = initial if self.last is None else np.concatenate(([self.last], initial))
        self.illegal += int((~np.isin(row[:-1] * 4 + row[1:], LEGAL)).sum())
        self.last = int(row[-1])
        level = 0
        while self.spans and self.spans[-1][0] == level:
            cells, level = combined(self.spans.pop()[1], cells), level + 1
        self.spans.append((level, cells))

    def result(self) -> dict[str, int | str]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        out = {"gaps": gaps, "blank": int(self.faults[BLANK]), "duplicate": int(self.faults[DUPLICATE]), "truncated": int(self.faults[CUT_OFF]), "illegal": self.illegal, "cost": 0, "audit": ""}
        if self.spans:
            whole = self.spans[-1][1]
            for _, cells in self.spans[-2::-1]:
                whole = combined(cells, whole)
            best = min((int(whole[0][0, NUMBER[0, q]]), whole[1][0, NUMBER[0, q]]) for q in ENDS)
            out |= {"cost": best[0], "audit": best[1].decode()}
        return out


#: Pairs of neighbouring initials that are in order, as places in INITIALS.
LEGAL = [4 * INITIALS.index(x) + INITIALS.index(y) for x, y in ("su", "ua", "au")]
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: each row as the rule on crc32(conv_id:turn) leaves it, and how often (0 if it is
    dropped). Nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    body = F.when(k == 1, "").when(k == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    times = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    key = F.col("conv_id") if rows.schema["conv_id"].dataType.typeName() == "string" else F.col("conv_id").cast("long")
    return rows.select(key.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(k == 4, "user").otherwise(text("role")).alias("role"), body.alias("text"), times.cast("long").alias("times"))


def _described(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, times) without their texts: initial, fault (duplicates aside), digest; equal rows of
    one turn are one with their number."""
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), F.substring("role", 1, 1)) - 1, F.lit(3))
    initial = F.when(initial < 0, 3).otherwise(initial).cast("int")
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    keys = ["conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), initial.alias("initial"), fault.alias("fault")]
    return rows.groupBy(*keys).agg(F.sum("times").alias("times"))


def _read(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Conversations out of rows sorted by conversation and turn: conv_id, turn, initial, fault, first, times."""
    key, now, done = None, None, []

    def out() -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in done], kind), *(pa.array([r[f] for _, r in done], pa.int64()) for f in FIELDS), pa.array([r["audit"] for _, r in done], pa.string())]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *FIELDS, "audit"])

    for batch in batches:
        ids, turns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        initial, fault, first, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
        times = times.astype(np.int64)
        at = np.flatnonzero([i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))])
        ends = np.concatenate((at[1:], [len(ids)])).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), times)  # rows as often as they occur
        again = np.concatenate(([False], row[1:] == row[:-1]))[: len(row)]
        faults = np.where(fault[row] == BLANK, BLANK, np.where(again | ~first[row].astype(bool), DUPLICATE, fault[row]))
        cut = np.searchsorted(row, np.append(at, len(ids)))
        sizes = np.diff(cut)
        full = np.flatnonzero(sizes)
        cells = dict(zip(full, parsed(initial[row].astype(np.int64) * 4 + faults, sizes[full]), strict=True))
        for j, (a, b) in enumerate(zip(at, ends, strict=True)):
            if now is None or ids[a] != key:
                if now is not None:
                    done.append((key, now.result()))
                key, now = ids[a], Conversation()
            if sizes[j]:
                part = slice(cut[j], cut[j + 1])
                now.add([turns[i] for i in range(a, b) if times[i]], initial[row[part]].astype(np.int64), faults[part], cells[j])
        yield out()
    if now is not None:
        done.append((key, now.result()))
        yield out()


def diagnosed(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation in rows (conv_id, turn, role, text,
    times).

    Texts stay where they are: rows travel as initial, fault and digest. What makes a row a duplicate is found before the
    conversations are read, so a task holds one batch and the cells of one conversation, whose audits are as long as its
    result. Rows of one turn stand in order of role and digest."""
    order = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    described = _described(rows)
    there = described.where("times > 0").withColumn("first", F.row_number().over(order) == 1)
    gone = described.where("times = 0").withColumn("first", F.lit(False))
    sorted_rows = there.unionByName(gone).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    schema = f"conv_id {kind}, {', '.join(f'{f} long' for f in FIELDS)}, audit string"
    return sorted_rows.select("conv_id", "turn", "initial", "fault", "first", "times").mapInArrow(lambda b: _read(b, arrow), schema)


def _edit(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Repaired rows out of a stream in which each conversation's audit stands before its rows: conv_id, text, role, times
    (null for an audit). Each conversation begins with a row at -1 that holds its audit."""
    names = ["conv_id", "position", "edit", "role", "text"]
    out: list[tuple] = []
    key, audit, at, place, next_role = None, "", 0, 0, "user"

    def put(edit: str, role: str | None, text: str) -> None:
        """A row of the result under its role, or (None) under that which the pattern asks for."""
        nonlocal place, next_role
        role = next_role if role is None else role
        out.append((key, place, edit, role, text))
        place += 1
        if role[:1] != "s":
            next_role = "assistant" if role[:1] == "u" else "user"

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put("I", None, "")
            at += 1

    def emptied() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    for batch in batches:
        for k, text, role, times in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if times is None:
                key, audit, at, place, next_role = k, text, 0, 0, "user"
                out.append((key, -1, None, None, audit))
                inserted()
                continue
            for _ in range(times):
                letter = audit[at]
                at += 1
                if letter != "D":
                    put(letter, role if letter == "K" else None, text)
                inserted()
        yield emptied()


def _edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    heads = found.select("conv_id", F.lit(0).alias("head"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), F.col("audit").alias("text"), none("long").alias("times"))
    texts = rows.where("times > 0").select("conv_id", F.lit(1).alias("head"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "times")
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "digest")
    arrow = pa.string() if kind == "string" else pa.int64()
    return stream.select("conv_id", "text", "role", "times").mapInArrow(lambda b: _edit(b, arrow), f"conv_id {kind}, position long, edit string, role string, text string")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text: the rows of all conversations after the cheapest repair.

    rows: conv_id (long or string), turn, role, text, times (see ``damaged``; a row that occurs ``times`` times). A conversation
    of which nothing is left has no rows. Rows come in order within their conversation."""
    return _edited(rows, diagnosed(rows)).where("position >= 0")


def _hashed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's repaired rows, of which one at a time is looked at."""
    key, audit, digest, begun = None, "", None, False
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 3
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.string()), strict=True)], ["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for k, position, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if position == -1:
                if begun:
                    done.append((key, audit, digest.hexdigest()))
                key, audit, digest, begun = k, text, hashlib.sha256(), True
                continue
            digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
        yield out()
    if begun:
        done.append((key, audit, digest.hexdigest()))
        yield out()


def repair_report(conversations: DataFrame) -> DataFrame:
    """Every conversation (conv_id, turn, role, text) damaged by rule and repaired: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Null roles and texts count as one space, a null conv_id is a conversation of its own, null turns stand first and make no
    gaps. Rows of one turn stand in order of role, then of the text's digest; repeated rows are damaged alike. A
    conversation of which no row is left has zeros, an empty audit and the hash of nothing. Other columns are left out. An
    empty table gives an empty result. Texts are streamed through the task that hashes them, so a very long conversation
    costs time (its hash is one sequence), but no memory beyond its audit."""
    rows = damaged(conversations)
    found = stage(diagnosed(rows), "diagnosed")
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    hashes = _edited(rows, found).select("conv_id", "position", "role", "text").mapInArrow(lambda b: _hashed(b, arrow), f"conv_id {kind}, audit string, repaired_sha256 string")
    known = found.drop("audit").withColumn("_conv", F.col("conv_id")).drop("conv_id")
    return hashes.join(known, hashes.conv_id.eqNullSafe(known["_conv"])).select("conv_id", *FIELDS, "audit", "repaired_sha256")
