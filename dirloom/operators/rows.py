"""Separated text rows, taken apart into cells, checked by a table of rules, and loaded or set apart with a reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import ascii_lower, trim_blanks
from ..runtime import bounded

_MARK, _OTHER = "\x01", "\x02"  # neither is allowed in an ID or a name
FIELDS = ("id", "auth_area", "class_name", "attr_name", "value")


@dataclass(frozen=True)
class Rule:
    """What the cell in column ``col`` (0: the row itself, its value being the number of fields) must satisfy.

    ``test``: ``sound`` (the row keeps the quoting rule), ``count`` (it has ``pattern`` fields),
    ``regex`` (the value matches) or ``area`` (what follows the part that matches ``pattern`` is
    a known area). Rules apply in their order; the first one broken is the row's reason.
    """

    reason: str
    col: int
    test: str
    pattern: str = ""


RULES = (
    Rule("quoting", 0, "sound"),
    Rule("columns", 0, "count", "5"),
    Rule("id", 1, "area", r"\A[A-Za-z0-9_-]+\."),
    Rule("attr_name", 4, "regex", r"\A[A-Za-z][A-Za-z0-9-]*\z"),
)


def fields(raw: Column, sep: Column) -> Column:
    """Array of the fields of one row; null if the row breaks the quoting rule.

    Cut at its quotes, a row alternates between text outside (even) and inside (odd). An inner
    outside part is empty (a doubled quote) or begins and ends with the separator.
    """
    parts = F.split(F.regexp_replace(raw, r"\r\z", ""), '"', -1)
    last = F.size(parts) - 1

    def sound(p: Column, i: Column) -> Column:
        doubled = (p == "") & (i > 0) & (i < last)
        return (i % 2 == 1) | doubled | (((i == 0) | p.startswith(sep)) & ((i == last) | p.endswith(sep))) | ((p == "") & ((i == 0) | (i == last)))

    def plain(p: Column, i: Column) -> Column:
        clean = lambda x: F.replace(x, F.lit(_MARK), F.lit(_OTHER))
        outside = F.array_join(F.transform(F.split(p, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E")), -1), lambda x: clean(trim_blanks(x))), _MARK)
        return F.when(i % 2 == 1, clean(p)).when((p == "") & (i > 0) & (i < last), F.lit('"')).otherwise(outside)

    whole = F.forall(F.transform(parts, sound), lambda x: x) & (last % 2 == 0)
    return F.when(whole, F.split(F.array_join(F.transform(parts, plain), ""), _MARK, -1))


def taken_apart(rows: DataFrame) -> DataFrame:
    """(line_id, fields): each row's fields, null where quoting is broken. A null row is an empty one, a null separator a comma."""
    return rows.select("line_id", fields(F.coalesce("raw", F.lit("")), F.coalesce("sep", F.lit(","))).alias("fields"))


def cells(apart: DataFrame) -> DataFrame:
    """(line_id, col, value): one row per field, and column 0 with the number of fields (null: broken quoting)."""
    whole = F.array(F.when(F.col("fields").isNotNull(), F.size("fields").cast("string")))
    return apart.select("line_id", F.posexplode(F.concat(whole, F.coalesce("fields", F.array().cast("array<string>")))).alias("col", "value"))


def rule_table(like: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule_no, reason, col, test, pattern) of the rules in their order."""
    return F.broadcast(like.sparkSession.createDataFrame([(i, r.reason, r.col, r.test, r.pattern) for i, r in enumerate(rules)], "rule_no int, reason string, col int, test string, pattern string").coalesce(1))


def violations(apart: DataFrame, areas: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(line_id, rule_no, reason, col, value): every cell that breaks a rule.

    Cells meet the rules of their column in a join with the rule table; only columns that some
    rule names are exploded, and a cell is carried on only if it breaks its rule.
    """
    asked = sorted({r.col for r in rules})
    met = cells(apart).where(F.col("col").isin(*asked)).join(rule_table(apart, rules), "col")
    value, test, pattern = F.col("value"), F.col("test"), F.col("pattern")
    met = met.withColumn("_area", F.when((test == "area") & F.regexp_like(value, pattern), ascii_lower(F.regexp_replace(value, pattern, F.lit("")))))
    known = areas.where("auth_area IS NOT NULL").select(ascii_lower("auth_area").alias("_area"), F.lit(True).alias("_known")).distinct()
    met = met.join(bounded(known, by=areas), "_area", "left")
    # a row with broken quoting breaks that rule alone
    holds = F.when(test == "sound", value.isNotNull()).when(test == "count", F.coalesce(value == pattern, F.lit(True))).when(test == "area", F.col("_known").isNotNull()).otherwise(F.coalesce(F.regexp_like(value, pattern), F.lit(False)))
    return met.where(~holds).select("line_id", "rule_no", "reason", "col", "value")


def rejected(rows: DataFrame, areas: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(line_id, reason) of the rows that cannot be loaded: of each row's violations the first by rule.

    Rows with the same line_id are one row; null line_ids are one key.
    """
    broken = violations(taken_apart(rows), areas, rules)
    return broken.groupBy("line_id").agg(F.min(F.struct("rule_no", "reason")).alias("first")).select("line_id", F.col("first.reason").alias("reason"))


def loaded(rows: DataFrame, areas: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that can be loaded, as their five fields; the anti-join of all rows with the violations.

    Null fields do not occur: a missing value is an empty field. The result has the columns
    line_id and ``FIELDS``; other columns of ``rows`` are left behind. Rows without line_id are
    judged together.
    """
    apart = taken_apart(rows)
    broken = rejected(rows, areas, rules).select(F.col("line_id").alias("_bad"))
    clean = apart.join(broken, apart["line_id"].eqNullSafe(broken["_bad"]), "leftanti")
    return clean.select("line_id", *[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(FIELDS)])
