"""Checks of records and of the schema itself."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Attribute, Catalog, fold
from ..functions.norm import ascii_upper
from ..functions.shapes import hierarchical, java_pattern, within_area
from ..query.search import exact_key
from ..runtime import bounded

# fixed forms
EMAIL, HOST = r"^[^@\s]+@([A-Za-z0-9-]+\.)+[A-Za-z]+$", r"^[A-Za-z0-9]([A-Za-z0-9.-]*[A-Za-z0-9])?$"
IDENTIFIER, SERIAL = r"^[A-Za-z0-9][A-Za-z0-9_-]*$", r"^[0-9]{17}$"
#: Fixed: codes of what is wrong with a record.
REQUIRED, REPEATED, FORMAT = 322, 320, 321


def required_violations(records: DataFrame, defs: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, attr_name): required attributes that a record of the class has no non-empty value of. Base attributes, held outside ``av``, are not asked for."""
    need = defs.where("is_required AND attr_id > 6").groupBy(F.col("class_name").alias("_c")).agg(F.collect_list(F.struct("attr_id", "attr_name")).alias("_need"))
    rows = records.join(bounded(need, by=defs), F.col("class_name") == F.col("_c"))
    has = F.transform(F.filter("av", lambda x: F.coalesce(x["value"] != "", F.lit(False))), lambda x: x["attr_id"])
    missing = F.filter("_need", lambda n: ~F.array_contains(F.coalesce(has, F.array().cast("array<int>")), n["attr_id"]))
    return rows.select(key, F.explode(missing).alias("m")).select(key, F.col("m.attr_name").alias("attr_name"))


def repeat_violations(records: DataFrame, defs: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, attr_name, n): attributes that occur more than once in a record though they are neither repeatable nor multi-line."""
    once = defs.where("NOT is_repeatable AND NOT is_multi_line").select(F.col("class_name").alias("_c"), F.col("attr_id").alias("_i"), "attr_name")
    ids = F.transform("av", lambda x: x["attr_id"])
    tally = F.transform(F.array_distinct(ids), lambda i: F.struct(i.alias("id"), F.size(F.filter(ids, lambda j: j == i)).alias("n")))
    many = records.select(key, "class_name", F.explode(F.filter(tally, lambda t: t["n"] > 1)).alias("t"))
    joined = many.join(bounded(once, by=defs), (F.col("class_name") == F.col("_c")) & (F.col("t.id") == F.col("_i")))
    return joined.select(key, "attr_name", F.col("t.n").cast("bigint").alias("n"))


def format_violations(records: DataFrame, formats: dict[tuple[str, int], str], key: str = "row_id") -> DataFrame:
    """(key, attr_id, value): values that, in upper case, do not match their attribute's format. A format that cannot be compiled is met by all."""
    cells = records.select(key, "class_name", F.explode("av").alias("x")).select(key, "class_name", F.col("x.attr_id").alias("attr_id"), F.col("x.value").alias("value")).where("value IS NOT NULL")
    wrong = F.lit(False)
    for (cls, attr_id), pattern in formats.items():
        java = java_pattern(pattern)
        if java is not None:
            wrong = wrong | ((F.col("class_name") == cls) & (F.col("attr_id") == attr_id) & ~ascii_upper("value").rlike(java))
    return cells.where(wrong).select(key, "attr_id", "value")


def record_check(records: DataFrame, defs: DataFrame, formats: dict[tuple[str, int], str] | None = None, key: str = "row_id", all_faults: bool = True) -> DataFrame:
    """(key, code, attr_name): everything wrong with each record, or only the first by code and name."""
    found = required_violations(records, defs, key).select(key, F.lit(REQUIRED).alias("code"), "attr_name")
    found = found.union(repeat_violations(records, defs, key).select(key, F.lit(REPEATED).alias("code"), "attr_name"))
    if formats:
        names = defs.select("attr_id", "attr_name").distinct()
        found = found.union(format_violations(records, formats, key).join(bounded(names, by=defs), "attr_id").select(key, F.lit(FORMAT).alias("code"), "attr_name").distinct())
    if all_faults:
        return found
    return found.groupBy(key).agg(F.min(F.struct("code", "attr_name")).alias("f")).select(key, "f.code", "f.attr_name")


def primary_key(records: DataFrame, defs: DataFrame) -> Column:
    """Text of a record's primary-key values as the index has them, in order; null without any."""
    ids = [f"{r.class_name}/{r.attr_id}" for r in defs.where("is_primary_key").select("class_name", "attr_id").limit(100_000).collect()]
    own = F.filter("av", lambda x: F.concat(F.col("class_name"), F.lit("/"), x["attr_id"].cast("string")).isin(*ids) & F.coalesce(x["value"] != "", F.lit(False)))
    parts = F.array_sort(F.transform(own, lambda x: F.concat_ws("=", x["attr_id"].cast("string"), exact_key(x["value"]))))
    return F.when(F.size(parts) > 0, F.array_join(parts, "|"))


def key_duplicates(records: DataFrame, defs: DataFrame) -> DataFrame:
    """(auth_area, class_name, pk, n): primary keys that several records of one class and area share."""
    keyed = records.withColumn("pk", primary_key(records, defs)).where("pk IS NOT NULL")
    return keyed.groupBy("auth_area", "class_name", "pk").agg(F.count("*").alias("n")).where("n > 1")


def attribute_faults(a: Attribute, catalog: Catalog) -> list[str]:
    """Why an attribute cannot join its class: its name, a name twice, a key that is not required, or both several values and several lines."""
    faults = []
    if not re.match(r"^[A-Za-z][A-Za-z0-9-]*$", a.name):
        faults.append("name")
    taken = [n for b in catalog.attributes if b.class_name == a.class_name for n in b.names]
    if any(n in taken for n in a.names) or len(set(a.names)) < len(a.names):
        faults.append("taken")
    if a.is_primary_key and not a.is_required:
        faults.append("key not required")
    if a.is_repeatable and a.is_multi_line:
        faults.append("repeatable and multi-line")
    if any(b.attr_id == a.attr_id and fold(b.name) != fold(a.name) for b in catalog.attributes):
        faults.append("id")
    return faults


def schema_faults(defs: DataFrame) -> DataFrame:
    """(class_name, attr_name, fault): what breaks the rules in a declared schema: ``taken`` names, ``key not required``, ``repeatable and multi-line``."""
    names = defs.select("class_name", "attr_name", F.explode(F.concat(F.array("attr_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).withColumn("n", ascii_upper("n"))
    taken = names.groupBy("class_name", "n").agg(F.count("*").alias("k"), F.collect_set("attr_name").alias("who")).where("k > 1").select("class_name", F.explode("who").alias("attr_name"), F.lit("taken").alias("fault"))
    rules = {"key not required": F.col("is_primary_key") & ~F.col("is_required"), "repeatable and multi-line": F.col("is_repeatable") & F.col("is_multi_line")}
    for fault, test in rules.items():
        taken = taken.union(defs.where(test).select("class_name", "attr_name", F.lit(fault).alias("fault")))
    return taken.distinct()


def area_name_is_sound(c: Column) -> Column:
    """Whether a text can name an authority area: a dot, a domain under a known top domain or country, or a network with its length."""
    top = ascii_upper(F.substring_index(c, ".", -1))
    domain = c.rlike(r"^([A-Za-z0-9-]+\.)+[A-Za-z]+$") & (top.isin("EDU", "GOV", "COM", "NET", "ORG", "INT") | (F.length(top) == 2))
    return (c == ".") | domain | c.rlike(r"^[0-9a-fA-F.:]+/[0-9]+$")


def soa_faults(areas: DataFrame) -> DataFrame:
    """(auth_area, fault): start-of-authority data that is missing, zero or malformed."""
    zero = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
    tests = {"refresh": zero("refresh_interval"), "increment": zero("increment_interval"), "retry": zero("retry_interval"), "ttl": zero("time_to_live"), "serial": ~F.coalesce(F.col("serial_no").rlike(SERIAL), F.lit(False)), "hostmaster": ~F.coalesce(F.col("hostmaster").rlike(EMAIL), F.lit(False)), "primary": ~F.coalesce(F.col("primary_server").rlike(r"^[A-Za-z0-9.-]+:[0-9]+$"), F.lit(False)), "name": ~area_name_is_sound(F.col("auth_area"))}
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return areas.select("auth_area", F.explode(found).alias("fault"))


def referral_faults(records: DataFrame, key: str = "rid", referred: int = 42) -> DataFrame:
    """(key, referred): referrals whose delegated name does not lie in the area of the record itself."""
    named = records.where("lower(class_name) = 'referral'").select(key, "auth_area", F.explode(F.filter("av", lambda x: x["attr_id"] == referred)).alias("x"))
    named = named.select(key, "auth_area", F.col("x.value").alias("referred")).withColumn("_h", hierarchical("referred"))
    return named.where(~within_area(F.col("_h.kind"), F.col("_h.value"), "auth_area")).select(key, "referred")


def is_name(c: Column) -> Column:
    """Whether a text can name a class or an attribute."""
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def is_host_name(c: Column) -> Column:
    return F.coalesce(c.rlike(HOST), F.lit(False))


def is_port(c: Column) -> Column:
    """Whether a text is a port number."""
    return F.coalesce(c.rlike("^[0-9]{1,5}$") & c.try_cast("int").between(1, 65535), F.lit(False))


def is_serial(c: Column) -> Column:
    """Whether a text is a serial: 17 digits that begin with a real date and time."""
    at = F.concat(F.substr(c, F.lit(1), F.lit(4)), F.lit("-"), F.substr(c, F.lit(5), F.lit(2)), F.lit("-"), F.substr(c, F.lit(7), F.lit(2)), F.lit(" "), F.substr(c, F.lit(9), F.lit(2)), F.lit(":"), F.substr(c, F.lit(11), F.lit(2)), F.lit(":"), F.substr(c, F.lit(13), F.lit(2)))
    return F.coalesce(c.rlike(SERIAL) & at.try_cast("timestamp").isNotNull(), F.lit(False))


def is_path(c: Column) -> Column:
    """Whether a text can be a path: not empty, without control characters, and no step up."""
    return F.coalesce((c != "") & ~c.rlike(r"[\x00-\x1F\x7F]") & ~c.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))
