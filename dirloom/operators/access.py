"""Who may see what: guardians, private records and attributes, host lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions.norm import ascii_upper
from .binding import is_private, value_of, values_of

ID, GUARDIAN = 1, 4


@dataclass(frozen=True)
class Credentials:
    """What a session presents; without scheme and info it presents nothing. ``secure``: whether it asked for secure mode."""

    secure: bool = False
    scheme: str | None = None
    info: str | None = None

    @property
    def complete(self) -> bool:
        return bool(self.scheme) and bool(self.info)


def guardian_table(records: DataFrame, defs: DataFrame) -> DataFrame:
    """(id, scheme, info): the credentials of guardian records by their ID; of several with one ID the first by scheme and info."""
    ids = {r["attr_name"]: r["attr_id"] for r in defs.where("lower(class_name) = 'guardian' AND attr_name IN ('Guard-Scheme', 'Guard-Info')").select("attr_name", "attr_id").limit(2).collect()}
    found = records.where("lower(class_name) = 'guardian'").select(ascii_upper(F.coalesce(value_of(F.col("av"), ID), F.col("rid"))).alias("id"), value_of(F.col("av"), ids["Guard-Scheme"]).alias("scheme"), value_of(F.col("av"), ids["Guard-Info"]).alias("info"))
    return found.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("scheme", "info")).alias("g")).select("id", "g.scheme", "g.info")


def matches(scheme: Column, info: Column, who: Credentials) -> Column:
    """Whether credentials are those of a guardian: equal scheme whatever the case, equal info. Passwords are stored as their SHA-256 under the scheme crypt-pw."""
    if not who.complete:
        return F.lit(False)
    given = F.when(ascii_upper(scheme) == "CRYPT-PW", F.sha2(F.lit(who.info), 256)).otherwise(F.lit(who.info))
    return F.coalesce((ascii_upper(scheme) == ascii_upper(F.lit(who.scheme))) & (info == given), F.lit(False))


def permissions(records: DataFrame, defs: DataFrame, who: Credentials, area_guardians: DataFrame | None = None) -> DataFrame:
    """``records`` with ``permitted``: whether this session may change a record and see what is private in it.

    In order: secure mode with incomplete credentials may nothing; an unguarded record is open to
    all; else the credentials must be those of one of its guardians that exist, or of the area's,
    or, if the record names none that exists and is a guardian itself, its own. Outside secure
    mode a guarded record is closed. ``area_guardians`` is (auth_area, guardian).
    """
    cls, av = F.col("class_name"), F.col("av")
    own = F.transform(values_of(av, GUARDIAN), ascii_upper)
    if area_guardians is not None:
        of_area = area_guardians.groupBy(F.col("auth_area").alias("_aa")).agg(F.collect_set(ascii_upper("guardian")).alias("_ag"))
        rows = records.join(of_area, F.col("auth_area") == F.col("_aa"), "left").drop("_aa")
    else:
        rows = records.withColumn("_ag", F.lit(None).cast("array<string>"))
    rows = rows.withColumn("_own", own).withColumn("_named", F.array_distinct(F.concat("_own", F.coalesce("_ag", F.array().cast("array<string>")))))
    guardians = guardian_table(records, defs).withColumn("ok", matches(F.col("scheme"), F.col("info"), who))
    key = "_key"
    rows = rows.withColumn(key, F.xxhash64("rid", "class_name", "auth_area"))
    links = rows.select(key, "_own", F.explode("_named").alias("id")).join(guardians, "id")
    seen = links.groupBy(key).agg(F.max("ok").alias("_ok"), F.max(F.array_contains("_own", F.col("id"))).alias("_live"))
    rows = rows.join(seen, key, "left")
    is_guardian = F.lower(cls) == "guardian"
    guarded = is_guardian | (F.size("_named") > 0)
    self_id = ascii_upper(F.coalesce(value_of(av, ID), F.col("rid")))
    rows = rows.join(guardians.select(F.col("id").alias("_self"), F.col("ok").alias("_self_ok")), is_guardian & (self_id == F.col("_self")), "left")
    by_self = is_guardian & ~F.coalesce("_live", F.lit(False)) & F.coalesce("_self_ok", F.lit(False))
    granted = F.coalesce("_ok", F.lit(False)) | by_self
    permitted = F.when(F.lit(who.secure and not who.complete), F.lit(False)).when(~guarded, F.lit(True)).otherwise(F.lit(who.secure) & granted)
    return rows.withColumn("permitted", permitted).drop("_own", "_named", "_ag", key, "_ok", "_live", "_self", "_self_ok")


def visible(records: DataFrame, defs: DataFrame) -> DataFrame:
    """What a session sees of records that have ``permitted``: private records only with permission, else without their private attributes."""
    private = [f"{r[0]}/{r[1]}" for r in defs.where("is_private").select(F.lower("class_name"), "attr_id").distinct().limit(100_000).collect()]
    shown = records.where(F.col("permitted") | ~is_private(F.col("av")))
    cls = F.lower("class_name")
    public = F.filter("av", lambda x: ~F.concat(cls, F.lit("/"), x["attr_id"].cast("string")).isin(*private)) if private else F.col("av")
    return shown.withColumn("av", F.when(F.col("permitted"), F.col("av")).otherwise(public))


def stale_guardians(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, guardian): guardians that records name but that no guardian record has as its ID."""
    known = records.where("lower(class_name) = 'guardian'").select(ascii_upper(F.coalesce(value_of(F.col("av"), ID), F.col("rid"))).alias("id"))
    named = records.select(key, F.explode(F.array_distinct(values_of(F.col("av"), GUARDIAN))).alias("guardian")).withColumn("id", ascii_upper("guardian"))
    return named.join(known, "id", "leftanti").select(key, "guardian")


def host_matches(pattern: str, host: Column, address: Column) -> Column:
    """Whether a host meets a pattern: ALL, KNOWN, LOCAL, ``.suffix``, ``prefix.``, net/mask, [IPv6/length] or itself."""
    known = F.coalesce(host != "", F.lit(False))
    p = pattern.strip()
    up = p.upper()
    if up == "ALL":
        return F.lit(True)
    if up == "KNOWN":
        return known & F.coalesce(address != "", F.lit(False))
    if up == "LOCAL":
        return known & ~F.contains(host, F.lit("."))
    if p.startswith("["):
        inner = p.strip("[]").replace("]", "")
        return net.within(net.parse(address), net.parse(F.lit(inner)))
    if "/" in p:
        base, _, mask = p.partition("/")
        length = mask if "." not in mask else str(sum(bin(int(x)).count("1") for x in mask.split(".")))
        return net.within(net.parse(address), net.parse(F.lit(f"{base}/{length}")))
    if p.startswith("."):
        return F.coalesce(ascii_upper(host).endswith(up) & (F.length(host) > len(p)), F.lit(False))
    if p.endswith("."):
        return F.coalesce(address.startswith(p), F.lit(False))
    return F.coalesce(ascii_upper(host) == up, F.lit(False)) | F.coalesce(address == p, F.lit(False))


def list_matches(patterns: str, host: Column, address: Column) -> Column:
    """Whether a host meets a list of patterns; what stands behind EXCEPT is taken away, and so on."""
    words = patterns.replace(",", " ").split()
    at = next((i for i, w in enumerate(words) if w.upper() == "EXCEPT"), len(words))
    hit = F.lit(False)
    for w in words[:at]:
        hit = hit | host_matches(w, host, address)
    return hit & ~list_matches(" ".join(words[at + 1 :]), host, address) if words[at + 1 :] else hit


def allowed(hosts: DataFrame, allow: Sequence[str], deny: Sequence[str], host: str = "host", address: str = "address") -> DataFrame:
    """``hosts`` with ``allowed``: what the first list permits is permitted, of the rest what the second denies is denied, all else is permitted."""
    yes, no = F.lit(False), F.lit(False)
    for p in allow:
        yes = yes | list_matches(p, F.col(host), F.col(address))
    for p in deny:
        no = no | list_matches(p, F.col(host), F.col(address))
    return hosts.withColumn("allowed", yes | ~no)
