"""Full and incremental export of areas, and their replication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, fold
from ..functions.norm import ascii_upper
from ..query.lang import QueryError


def exported(records: DataFrame, area: str | None = None, classes: Mapping[str, Sequence[int]] | None = None, since: str | None = None, key: str = "row_id") -> DataFrame:
    """(key, line_no, line): ``class:Attribute:value`` of every value, in the record's order.

    ``area`` and ``classes`` (each with the ids of its attributes, none for all) choose what is
    exported; ``since`` a serial: then only records whose updated, compared as text, is not
    before it, none without. A record with no chosen attribute gives nothing. Guardians and
    private flags play no part.
    """
    rows = records if area is None else records.where(ascii_upper("auth_area") == fold(area))
    if since is not None:
        rows = rows.where(F.col("updated") >= since)
    chosen = F.col("av")
    if classes is not None:
        rows = rows.where(F.col("class_name").isin(*classes))
        ids = [f"{c}/{i}" for c, of in classes.items() for i in of]
        whole = [c for c, of in classes.items() if not of]
        chosen = F.filter("av", lambda x: F.col("class_name").isin(*whole) | F.concat(F.col("class_name"), F.lit("/"), x["attr_id"].cast("string")).isin(*ids))
    lines = F.transform(chosen, lambda x: F.concat_ws(":", F.col("class_name"), x["attr"], F.coalesce(x["value"], F.lit(""))))
    return rows.select(key, F.posexplode(lines).alias("line_no", "line"))


def plan_export(arguments: Sequence[str], catalog: Catalog) -> tuple[str, dict[str, list[int]] | None, str | None]:
    """Area, classes with attribute ids, and serial of an export line: ``area [class=c [attribute=a]...]... [serial]``.

    Errors are 338 without area or with a bad serial, 340 an unknown area, 333 one this server is
    not master of, 341 an unknown class, 320 an unknown attribute.
    """
    if not arguments:
        raise QueryError(338, "Invalid Directive Syntax")
    area = catalog.find_area(arguments[0])
    if area is None or arguments[0] == "0.0.0.0/0":
        raise QueryError(340, "Invalid Authority Area")
    if fold(area.kind) in ("SLAVE", "SECONDARY"):
        raise QueryError(333, "Not Master for Authority Area")
    classes: dict[str, list[int]] = {}
    since = current = None
    for word in arguments[1:]:
        tag, eq, value = word.partition("=")
        if not eq:
            if not (word.isdigit() and len(word) == 17):
                raise QueryError(338, "Invalid Directive Syntax")
            since = word
        elif fold(tag) == "CLASS":
            current = catalog.find_class(value)
            if current is None:
                raise QueryError(341, "Invalid Class")
            classes.setdefault(current, [])
        elif fold(tag) in ("ATTR", "ATTRIBUTE") and current:
            attribute = catalog.find_attribute(current, value)
            if attribute is None:
                raise QueryError(320, "Invalid Attribute")
            classes[current].append(attribute.attr_id)
        else:
            raise QueryError(338, "Invalid Directive Syntax")
    return area.name, classes or None, since


def due(replicas: DataFrame, now_us: int) -> DataFrame:
    """Replicas (auth_area, serial, refreshed_us, refresh, retry, failed) whose refresh interval, or after a failure retry interval, is over."""
    wait = F.when(F.col("failed"), F.col("retry")).otherwise(F.col("refresh")).cast("bigint") * 1_000_000
    return replicas.where(F.coalesce(F.col("refreshed_us") + wait <= now_us, F.lit(True)))


def stale(masters: DataFrame, replicas: DataFrame) -> DataFrame:
    """(auth_area, serial, master_serial): areas whose master has a later serial than the replica, or that have no replica yet; serials are compared as text."""
    m = masters.where("serial IS NOT NULL").select("auth_area", F.col("serial").alias("master_serial"))
    joined = m.join(replicas.select("auth_area", "serial"), "auth_area", "left")
    return joined.where(F.coalesce(F.col("master_serial") > F.col("serial"), F.lit(True))).select("auth_area", "serial", "master_serial")


def refreshed(replica: DataFrame, master: DataFrame, areas: DataFrame) -> DataFrame:
    """The replica with the named areas taken anew from the master and all others as they are."""
    which = areas.select("auth_area").distinct()
    return replica.join(which, "auth_area", "leftanti").unionByName(master.join(which, "auth_area", "leftsemi"))
