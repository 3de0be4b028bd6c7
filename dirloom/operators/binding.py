"""Untyped attribute rows and text blocks bound to the schema; typed records shown and written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ANONYMOUS
from ..functions.norm import ascii_upper, is_truthy, name_key, trim_blanks
from ..runtime import bounded
from .wide import ALIASES, name_table

RECORD = "rid string, auth_area string, class_name string, av array<struct<pos:int,attr_id:int,attr:string,value:string>>"


def attribute_ids(defs: DataFrame) -> DataFrame:
    """(class, name, attr_id, attr): every name and alias of every class, folded, with the attribute's id and proper name."""
    ids = defs.select(name_key("class_name").alias("class"), F.col("attr_name"), "attr_id")
    return name_table(defs).join(bounded(ids, by=defs), ["class", "attr_name"]).select("class", "name", "attr_id", F.col("attr_name").alias("attr"))


def bind(pairs: DataFrame, defs: DataFrame) -> DataFrame:
    """Typed records (rid, auth_area, class_name, av) of untyped attribute rows (rid, pos, attr_name, value).

    The class is what a record says under Class-Name or one of its fixed aliases, the area what it
    says under Auth-Area, the first by pos if it says several. Names are compared in lower case
    without outer blanks; attributes the class does not have and blank values are dropped;
    repeated rows count once. Auth-Area and Class-Name are put in front if they are missing.
    Records without a known class have no row. Values lose their outer blanks. ``av`` is ordered
    by pos, attr_id, value.
    """
    said = pairs.where("rid IS NOT NULL").select("rid", "pos", name_key("attr_name").alias("name"), trim_blanks("value").alias("value")).where("value != ''").distinct()
    head = lambda which: F.min(F.when(F.col("name").isin(*[n.lower() for n in ANONYMOUS[which]]), F.struct("pos", "value")))
    heads = said.groupBy("rid").agg(head("Class-Name").alias("c"), head("Auth-Area").alias("a")).select("rid", F.lower("c.value").alias("class"), F.col("a.value").alias("auth_area"))
    ids = attribute_ids(defs)
    known = ids.select("class").distinct()
    heads = heads.join(bounded(known, by=defs), "class", "leftsemi")
    typed = said.join(heads, "rid").join(bounded(ids, by=defs, times=ALIASES), ["class", "name"])
    av = F.array_sort(F.collect_set(F.struct(F.col("pos").cast("int").alias("pos"), F.col("attr_id").cast("int").alias("attr_id"), F.col("attr").alias("attr"), F.col("value").alias("value"))))
    rows = typed.groupBy("rid", "class", "auth_area").agg(av.alias("av"))
    return rows.select("rid", "auth_area", F.col("class").alias("class_name"), with_heads(F.col("av"), F.col("auth_area"), F.col("class")).alias("av"))


def with_heads(av: Column, area: Column, class_name: Column) -> Column:
    """An attribute array with Auth-Area, then Class-Name, in front unless it has them."""
    kind = "array<struct<pos:int,attr_id:int,attr:string,value:string>>"
    lead = lambda i, name, value: F.when(value.isNotNull() & ~F.exists(av, lambda x: x["attr_id"] == i), F.array(F.struct(F.lit(-1).alias("pos"), F.lit(i).alias("attr_id"), F.lit(name).alias("attr"), value.alias("value")))).otherwise(F.array().cast(kind))
    return F.concat(lead(2, "Auth-Area", area), lead(0, "Class-Name", class_name), av)


def value_of(av: Column, attr_id: int) -> Column:
    """The first value of an attribute, null if there is none."""
    return F.get(F.filter(av, lambda x: x["attr_id"] == attr_id), F.lit(0))["value"]


def values_of(av: Column, attr_id: int) -> Column:
    """All values of an attribute in their order."""
    return F.transform(F.filter(av, lambda x: x["attr_id"] == attr_id), lambda x: x["value"])


def multiplicity(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, attr_id, n): how often each attribute occurs in each record."""
    return records.select(key, F.explode(F.transform("av", lambda x: x["attr_id"])).alias("attr_id")).groupBy(key, "attr_id").agg(F.count("*").alias("n"))


def dump(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, line_no, line): a line ``class:Attribute:value`` per value, and an empty line behind each record."""
    line = F.transform("av", lambda x: F.concat_ws(":", F.col("class_name"), x["attr"], F.coalesce(x["value"], F.lit(""))))
    return records.select(key, F.posexplode(F.concat(line, F.array(F.lit("")))).alias("line_no", "line"))


def record_text(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, text): the record as ``Attribute:value`` lines and a separator line; empty values are left out."""
    lines = F.transform(F.filter("av", lambda x: F.coalesce(x["value"] != "", F.lit(False))), lambda x: F.concat_ws(":", x["attr"], x["value"]))
    return records.select(key, F.concat(F.array_join(lines, "\n"), F.lit("\n---\n")).alias("text"))


def is_private(av: Column) -> Column:
    """Whether a record says that it is private."""
    return is_truthy(value_of(av, 5))


def same_values(a: Column, b: Column) -> Column:
    """Whether two records have a value each for an attribute, equal whatever the ASCII case, and not empty."""
    return F.coalesce((a != "") & (ascii_upper(a) == ascii_upper(b)), F.lit(False))


def with_value(av: Column, attr_id: int, attr: str, value: Column) -> Column:
    """The array with one more value behind all others; a null or empty value adds nothing."""
    last = F.coalesce(F.array_max(F.transform(av, lambda x: x["pos"])), F.lit(-1))
    more = F.array(F.struct((last + 1).cast("int").alias("pos"), F.lit(attr_id).alias("attr_id"), F.lit(attr).alias("attr"), value.alias("value")))
    return F.when(F.coalesce(value != "", F.lit(False)), F.concat(av, more)).otherwise(av)


def without_attribute(av: Column, attr_id: int) -> Column:
    """The array without any value of an attribute."""
    return F.filter(av, lambda x: x["attr_id"] != attr_id)
