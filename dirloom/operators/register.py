"""Registrations: what becomes of each change, the versions they leave, deletion by query, and references between records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norm import ascii_upper, trim_blanks
from ..functions.shapes import is_email
from .binding import value_of
from .changes import spool_changes
from .timestamps import serial

#: Fixed: codes of refused changes.
NOT_UNIQUE, NOT_FOUND, OUTDATED = 324, 336, 325


def outcomes(spool: DataFrame) -> DataFrame:
    """(change_no, op, rid, code): what became of each usable change: 0 it took effect, 324 added though live, 336 changed or ended though absent.

    What is live before a change follows from the last add or del before it. A key's changes are
    cut into days: the last add or del of each day is carried over its days, then over the
    changes of each day, so that a key with very many changes is not sorted in one task.
    """
    order = F.struct("moment", "spool_seq", "change_no")
    said = spool_changes(spool.drop("payload")).withColumn("_o", order).withColumn("_day", F.expr("moment div 86400000000"))
    ends = F.when(F.col("op") != "mod", F.col("op"))
    days = said.where("op != 'mod'").groupBy("key", "_day").agg(F.max_by("op", "_o").alias("_last"))
    asked = said.select("key", "_day").distinct().join(days, ["key", "_day"], "left")
    carried = asked.withColumn("_start", F.last("_last", ignorenulls=True).over(Window.partitionBy("key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).select("key", "_day", "_start")
    within = Window.partitionBy("key", "_day").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    rows = said.join(carried, ["key", "_day"]).withColumn("_before", F.coalesce(F.last(ends, ignorenulls=True).over(within), F.col("_start")))
    was_live = F.coalesce(F.col("_before") == "add", F.lit(False))
    code = F.when((F.col("op") == "add") & was_live, NOT_UNIQUE).when((F.col("op") != "add") & ~was_live, NOT_FOUND).otherwise(0)
    return rows.select("change_no", "op", F.col("key").alias("rid"), code.alias("code"))


def outcome_counts(spool: DataFrame) -> DataFrame:
    """(op, code, n): how many changes of each kind ended how."""
    return outcomes(spool).groupBy("op", "code").agg(F.count("*").alias("n"))


def sender_faults(spool: DataFrame) -> DataFrame:
    """(spool_id, code): changes whose sender is no mail address."""
    return spool.where(~F.coalesce(is_email(F.trim("reg_email")), F.lit(False))).select("spool_id", F.lit(338).alias("code"))


def master_faults(spool: DataFrame, areas: DataFrame) -> DataFrame:
    """(spool_id, code): changes for areas this server is not master of (333) or does not know (340)."""
    own = areas.select(ascii_upper("auth_area").alias("_a"), "area_type").distinct()
    joined = spool.select("spool_id", ascii_upper("auth_area").alias("_a")).join(F.broadcast(own), "_a", "left")
    code = F.when(F.col("area_type").isNull(), 340).when(F.lower("area_type").isin("slave", "secondary"), 333)
    return joined.select("spool_id", code.alias("code")).where("code IS NOT NULL")


def modified(current: DataFrame, changes: DataFrame, key: str = "rid") -> DataFrame:
    """(key, code): a mod or del names the version it was made against; 336 if there is no such record, 325 if its version is another."""
    have = current.select(key, F.col("updated").alias("_now"), F.lit(True).alias("_has"))
    joined = changes.join(have, key, "left")
    same = F.coalesce(F.trim("updated") == F.trim("_now"), F.lit(False))
    return joined.select(*[c for c in changes.columns if c != "updated"], F.when(F.col("_has").isNull(), NOT_FOUND).when(~same, OUTDATED).otherwise(0).alias("code"))


def committed(current: DataFrame, adds: DataFrame, mods: DataFrame, gone: DataFrame, key: str = "rid") -> DataFrame:
    """The table after a batch: without what was modified or deleted, with what was added or modified. Each key may occur in one of the three once."""
    leave = mods.select(key).union(gone.select(key)).distinct()
    return current.join(leave, key, "leftanti").unionByName(adds).unionByName(mods)


def deleted_by(records: DataFrame, hits: DataFrame, key: str = "row_id") -> DataFrame:
    """``records`` without those a search found."""
    return records.join(hits.select(key), key, "leftanti")


def new_identifiers(adds: DataFrame, area: Column, order: str) -> DataFrame:
    """``adds`` with ``id``: unique in its area, made of the change's own number, so that a repeated run gives the same."""
    return adds.withColumn("id", F.concat_ws(".", F.col(order).cast("string"), area))


def stamped(df: DataFrame, at: Column) -> DataFrame:
    """``df`` with ``updated`` set to the 17-digit serial of a moment in microseconds."""
    return df.withColumn("updated", serial(at))


def next_serial(old: Column) -> Column:
    """The serial that follows a serial: its number plus one."""
    return F.lpad((old.cast("decimal(17,0)") + 1).cast("decimal(17,0)").cast("string"), 17, "0")


def newer(a: Column, b: Column) -> Column:
    """Whether one serial is later than another; they are texts of one width."""
    return a > b


def guarded_secret(scheme: Column, info: Column) -> Column:
    """A guardian's info as it is stored: that of the scheme crypt-pw as its SHA-256, others as given."""
    return F.when(ascii_upper(scheme) == "CRYPT-PW", F.sha2(info, 256)).otherwise(info)


def guardian_scheme(scheme: Column) -> Column:
    """The stored name of a scheme: pw for all spellings of a plain password."""
    return F.when(ascii_upper(scheme).isin("PW", "PASSWD", "PASSWORD"), "pw").otherwise(F.lower(scheme))


def references(records: DataFrame, defs: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, attr_id, target, found): every value of an attribute of type ID and whether some record has it as its rid, whatever the case."""
    kinds = defs.where("attr_type = 'ID'").select(F.col("class_name").alias("_c"), F.col("attr_id").alias("_i")).distinct()
    cells = records.select(key, "class_name", F.explode("av").alias("x")).select(key, "class_name", F.col("x.attr_id").alias("attr_id"), trim_blanks(F.col("x.value")).alias("target")).where("target != ''")
    asked = cells.join(F.broadcast(kinds), (F.col("class_name") == F.col("_c")) & (F.col("attr_id") == F.col("_i"))).select(key, "attr_id", "target", ascii_upper("target").alias("_t"))
    known = records.where("rid IS NOT NULL").select(ascii_upper(trim_blanks("rid")).alias("_t"), F.lit(True).alias("_k")).distinct()
    return asked.join(known, "_t", "left").select(key, "attr_id", "target", F.coalesce("_k", F.lit(False)).alias("found"))


def same_attribute(a: DataFrame, b: DataFrame, attr_id: int, key: str = "rid") -> DataFrame:
    """Keys of both frames whose records have an equal, non-empty value of an attribute, whatever the case."""
    left = a.select(key, ascii_upper(value_of(F.col("av"), attr_id)).alias("_v")).where("_v != ''")
    return left.join(b.select(key, ascii_upper(value_of(F.col("av"), attr_id)).alias("_v")), [key, "_v"]).select(key).distinct()


def result_lines(adds: DataFrame) -> DataFrame:
    """(id, line): what an add is answered with, its new ID and its Updated."""
    return adds.select("id", F.explode(F.array(F.concat_ws(":", F.lit("ID"), "id"), F.concat_ws(":", F.lit("Updated"), "updated"))).alias("line"))


def parsed_by(records: DataFrame, programs: Mapping[str, Callable[[list[tuple[str, str]]], list[tuple[str, str]] | None]]) -> DataFrame:
    """(rid, class_name, av) after each class's own program rewrote the record's (attribute, value) list; None refuses the record.

    Programs are Python functions that executors can import or unpickle; records of classes
    without one pass as they are. Attributes a program adds have no id.
    """
    shape = "rid string, class_name string, av array<struct<pos:int,attr_id:int,attr:string,value:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, cls, av in b.itertuples(index=False):
                program = programs.get(cls)
                if program is None or av is None:
                    out.append((rid, cls, av))
                    continue
                ids = {x["attr"]: x["attr_id"] for x in av}
                new = program([(x["attr"], x["value"]) for x in av])
                if new is not None:
                    out.append((rid, cls, [{"pos": i, "attr_id": ids.get(a), "attr": a, "value": v} for i, (a, v) in enumerate(new)]))
            yield pd.DataFrame(out, columns=["rid", "class_name", "av"])

    chosen = records.select("rid", "class_name", "av")
    touched = F.coalesce(F.col("class_name").isin(*programs), F.lit(False)) if programs else F.lit(False)
    return chosen.where(~touched).select("rid", "class_name", F.col("av").cast("array<struct<pos:int,attr_id:int,attr:string,value:string>>").alias("av")).union(chosen.where(touched).mapInPandas(run, shape))
