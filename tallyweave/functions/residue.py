"""Provenance tags as text: compose, check, parse, carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the tag's format.
MARKER, PREFIX, SEPARATOR = "[GT-Tag]: ", "GT", "|"
RUN_ID = "^GT-[0-9]{8}-[0-9]{6}$"
BASE64 = "^[A-Za-z0-9+/]*={0,2}$"
#: Classes whose tag replaces one field; others append to a text that people also write in.
REPLACING = ("LexEntry", "LexSense", "LexEntryRef", "LexEtymology", "LexExampleSentence", "LexPronunciation", "LexReference", "MoStemAllomorph", "MoAffixAllomorph", "MoAffixProcess", "MoStemMsa", "MoInflAffMsa", "MoDerivAffMsa", "MoUnclassifiedAffixMsa", "MoDerivStepMsa")


def run_id_of(timestamp: Column) -> Column:
    return F.date_format(F.try_to_timestamp(timestamp), "'GT-'yyyyMMdd-HHmmss")


def valid(run_id: Column, timestamp: Column) -> Column:
    """The id has its form and says the same time as the timestamp."""
    return F.coalesce(run_id.rlike(RUN_ID) & (run_id == run_id_of(timestamp)), F.lit(False))


def encode(text: Column) -> Column:
    """base64 on one line."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n]", "")


def decode(text: Column) -> Column:
    """The text of base64, null if it is none."""
    ok = text.rlike(BASE64) & (F.length(text) % 4 == 0)
    return F.when(ok, F.try_to_binary(text, F.lit("base64")).cast("string"))


def snapshot_json(fields: Column) -> Column:
    """A map as JSON with its keys in order and its nulls kept."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))), {"ignoreNullFields": "false"})


def serialize(run_id: Column, source: Column, timestamp: Column, snap: Column | None = None, merge: Column | None = None) -> Column:
    """GT|run|source|time[|snap=...][|merge=...]; null where the parts aren't valid or the source holds the separator."""
    extra = [F.concat(F.lit(f"{k}="), encode(v)) for k, v in (("snap", snap), ("merge", merge)) if v is not None]
    tag = F.concat_ws(SEPARATOR, F.lit(PREFIX), run_id, source, timestamp, *extra)
    return F.when(valid(run_id, timestamp) & ~source.contains(SEPARATOR), tag)


def parse(text: Column, *fields: str) -> Column:
    """struct(run_id, source, ts, snap, merge) of the last tag in ``text``, or null; with ``fields`` of these alone, so that bodies
    nobody asks for aren't decoded.

    The last marker's line counts, else the first line. Four to six segments; snap before merge, each at most once; any
    other segment or a bad id gives null. A body that is no base64 is null in an otherwise good tag."""
    line = F.trim(F.split(F.when(text.contains(MARKER), F.substring_index(text, MARKER, -1)).otherwise(text), "\n", 2)[0])
    body = lambda c, k: F.substring(c, len(k) + 2, 1 << 30)

    def tag(seg: Column) -> Column:
        n = F.size(seg)
        at = lambda i: F.get(seg, F.lit(i))
        fifth_snap, fifth_merge, sixth_merge = at(4).startswith("snap="), at(4).startswith("merge="), at(5).startswith("merge=")
        order = F.when(n == 4, True).when(n == 5, fifth_snap | fifth_merge).when(n == 6, fifth_snap & sixth_merge).otherwise(False)
        snap = F.when((n >= 5) & fifth_snap, body(at(4), "snap"))
        merge = F.when((n == 5) & fifth_merge, body(at(4), "merge")).when(n == 6, body(at(5), "merge"))
        parts = {"run_id": at(1), "source": at(2), "ts": at(3), "snap": decode(snap), "merge": decode(merge)}
        return F.when(order & (at(0) == PREFIX) & valid(at(1), at(3)), F.struct(*(parts[f].alias(f) for f in fields or parts)))

    return F.transform(F.array(F.split(line, r"\|")), tag)[0]  # a list of one, so that the line is cut once for all of its parts


def carry(existing: Column, class_name: Column, tag: Column) -> Column:
    """The text after tagging: replaced for some classes, else appended after a blank line, prose untouched."""
    marked = F.concat(F.lit(MARKER), tag)
    appended = F.when(F.coalesce(existing, F.lit("")) == "", marked).otherwise(F.concat(existing, F.lit("\n\n"), marked))
    return F.when(class_name.isin(*REPLACING), tag).otherwise(appended)


def latest(residue: DataFrame) -> DataFrame:
    """The last text of each guid (columns guid, carrier, seq, text); carrier A goes before B. Pre-aggregated, no sort of a
    group."""
    first = residue.groupBy("guid", "carrier").agg(F.max(F.struct("seq", "text")).alias("last"))
    best = first.groupBy("guid").agg(F.min_by("last", "carrier").alias("last"))
    return best.select("guid", "last.text")
