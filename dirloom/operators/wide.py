"""Entity-attribute-value rows reshaped into wide typed tables by characteristic sets.

Entities are grouped by the exact set of attributes they have (their signature). Each frequent
signature becomes a dense table without nulls; the tables of a class are united by name, missing
columns being null. Signatures too rare for a table of their own share one table per class with
the class's full set of columns; it holds exactly their rows, so nothing is lost or capped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import name_key, trim_blanks
from ..runtime import bounded, written

#: A signature gets a table of its own if at least this share of its class's entities has it, so a class has at most 1 / OWN_SHARE of them.
OWN_SHARE = 0.05
#: Names of one attribute that are reckoned with when a table of names is broadcast.
ALIASES = 16
_DAY = r"\A([0-9]{4})([-/]?)([0-9]{2})\2([0-9]{2})\z"


def converts(value: Column, kind: Column) -> Column:
    """Whether a trimmed value has the form of its kind."""
    real = value.rlike(_DAY) & ~value.startswith("0000") & F.regexp_replace(value, _DAY, "$1-$3-$4").try_cast("date").isNotNull()
    return F.when(kind == "integer", value.rlike(r"\A[+-]?[0-9]+\z")).when(kind == "date", real).when(kind == "boolean", value.rlike(r"(?i)\A(TRUE|YES|ON|FALSE|NO|OFF)\z")).otherwise(True)


def typed(value: Column, kind: str) -> Column:
    """A value that converts, as its type. Integers are decimals of up to 38 digits; longer ones are null."""
    if kind == "integer":
        return value.try_cast("decimal(38,0)")
    if kind == "date":
        return F.regexp_replace(value, _DAY, "$1-$3-$4").try_cast("date")
    return F.upper(value).isin("TRUE", "YES", "ON") if kind == "boolean" else value


def name_table(defs: DataFrame) -> DataFrame:
    """(class, name, attr_name, value_kind, many): every name and alias of every class, folded."""
    names = defs.select(name_key("class_name").alias("class"), "attr_name", "value_kind", (F.col("is_repeatable") | F.col("is_multi_line")).alias("many"), F.explode(F.concat(F.array("attr_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return names.select("class", name_key("n").alias("name"), "attr_name", "value_kind", "many").where("name IS NOT NULL").dropDuplicates(["class", "name"])


def cells(pairs: DataFrame, defs: DataFrame) -> DataFrame:
    """(rid, class, attr_name, values, seen): the typed cells of all entities, one row each.

    ``values`` are the distinct values that convert, in the order of their first pos. A cell is
    there if the entity has a non-blank value for the attribute; ``values`` is empty if none
    converts, that is if the cell is lost. Rows of one entity and name are pre-aggregated before
    anything is joined, so an entity with very many repeated rows costs no more than its values.
    """
    names = name_table(defs)
    heads = names.where("lower(attr_name) = 'class-name'").select("class", F.col("name").alias("_h"))
    spoken = names.select("name").distinct()
    said = pairs.select("rid", name_key("attr_name").alias("name"), trim_blanks("value").alias("v"), "pos").where("v != '' AND rid IS NOT NULL").join(bounded(spoken, by=defs, times=ALIASES), "name")
    distinct = said.groupBy("rid", "name", "v").agg(F.min("pos").alias("pos"))
    as_class = said.join(bounded(heads.select(F.col("_h").alias("name")).distinct(), by=defs, times=ALIASES), "name", "leftsemi").select("rid", "name", F.lower("v").alias("class"))
    classes = as_class.join(bounded(heads, by=defs, times=ALIASES), (as_class["class"] == heads["class"]) & (as_class["name"] == heads["_h"]), "leftsemi").select("rid", "class").distinct()
    of = distinct.join(classes, "rid").join(bounded(names, by=defs, times=ALIASES), ["class", "name"])
    ok = converts(F.col("v"), F.col("value_kind"))
    kept = F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "v"))))
    found = of.groupBy("rid", "class", "attr_name").agg(kept.alias("kept"))
    return found.select("rid", "class", "attr_name", F.array_distinct(F.transform("kept", lambda x: x["v"])).alias("values"))


def entities(pairs: DataFrame, defs: DataFrame) -> DataFrame:
    """(rid, class, sig, cells): each entity with its signature (its attribute names, sorted) and its cells by name."""
    rows = cells(pairs, defs).groupBy("rid", "class").agg(F.map_from_entries(F.collect_list(F.struct("attr_name", "values"))).alias("cells"))
    return rows.withColumn("sig", F.array_join(F.array_sort(F.map_keys("cells")), " "))


def _layout(defs: DataFrame) -> dict[str, list[tuple[str, str, bool]]]:
    """Columns of each class: (attr_name, value_kind, whether an array). The catalog is a table of declared attributes."""
    classes: dict[str, list[tuple[str, str, bool]]] = {}
    for r in defs.select(name_key("class_name").alias("class"), "attr_id", "attr_name", "value_kind", (F.col("is_repeatable") | F.col("is_multi_line")).alias("many")).orderBy("class", "attr_id").collect():
        columns = classes.setdefault(r["class"], [])
        if r["attr_name"] not in [c[0] for c in columns]:
            columns.append((r["attr_name"], r["value_kind"], bool(r["many"])))
    return classes


def _dense(rows: DataFrame, columns: list[tuple[str, str, bool]]) -> DataFrame:
    """One row per entity with exactly these columns, typed; ``lost`` names the cells that no value of theirs converts for."""
    def cell(name: str, kind: str, many: bool) -> Column:
        values = F.col("cells")[name]
        return (F.transform(values, lambda v: typed(v, kind)) if many else typed(F.get(values, F.lit(0)), kind)).alias(name)

    out = [cell(*c) for c in columns]
    gone = [F.when(F.size(F.col("cells")[name]) == 0, F.lit(name)) for name, kind, _ in columns if kind != "text"]
    lost = F.array_compact(F.array(*gone)) if gone else F.array().cast("array<string>")
    return rows.select("rid", *out, lost.alias("lost"))


def wide_tables(pairs: DataFrame, defs: DataFrame, own_share: float = OWN_SHARE) -> dict[str, DataFrame]:
    """For each class of ``defs`` the table with one row per entity and one typed column per attribute.

    Names, aliases and classes are compared in lower case without outer blanks; unknown names,
    blank and null values and rows without rid are left out. A single-valued attribute takes its
    first value (by pos) that converts, a repeatable or multi-line one all of them as an array.
    An entity that names two classes has a row in both. Columns ``rid`` and ``lost`` (names of
    the cells lost in typing) are added; attributes of these names are not allowed. Entities are
    written once, laid out by class and signature; the collected counts are those of at most
    1 / ``own_share`` signatures per class.
    """
    layout = _layout(defs)
    keyed = entities(pairs, defs)
    stored = written(keyed, "class")
    counts = stored.groupBy("class", "sig").agg(F.count("*").alias("n"))
    totals = counts.groupBy("class").agg(F.sum("n").alias("all"))
    frequent: dict[str, list[str]] = {}
    for r in counts.join(totals, "class").where(F.col("n") >= F.col("all") * own_share).select("class", "sig").collect():
        frequent.setdefault(r["class"], []).append(r["sig"])
    tables = {}
    for name, columns in layout.items():
        own = stored.where(F.col("class") == name)
        sigs = sorted(frequent.get(name, []))
        parts = [_dense(own.where(F.col("sig") == sig), [c for c in columns if c[0] in sig.split(" ")]) for sig in sigs]
        rest = own.where(~F.col("sig").isin(*sigs)) if sigs else own
        parts.append(_dense(rest, columns))
        united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reversed(parts))
        tables[name] = united.select("rid", *[f"`{c[0]}`" for c in columns], "lost")
    return tables


def lost(pairs: DataFrame, defs: DataFrame, own_share: float = OWN_SHARE) -> DataFrame:
    """(rid, attr_name) of the cells of the wide tables with some non-blank value of which none converts."""
    tables = [t.select("rid", F.explode("lost").alias("attr_name")) for t in wide_tables(pairs, defs, own_share).values()]
    if not tables:
        return pairs.sparkSession.createDataFrame([], "rid string, attr_name string")
    return reduce(DataFrame.union, tables).distinct()
