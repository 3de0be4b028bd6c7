"""Queries run over a frame of records.

The first term of each conjunction goes through the index keys of the record's attributes, the
others are checked against its values. All of it is one expression over the record's attribute
array: a search is a single narrow scan, filters reach the files, and nothing is shuffled but the
hits for their order. Each record is one row, so no hit comes twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, fold
from ..functions import net, phonetic
from ..functions.norm import ascii_upper, strip_control, trim_left, trim_right
from .lang import EXACT, PREFIX, Query, Term

#: Index kinds in the order in which they are searched.
KINDS = ("EXACT", "CIDR", "SOUNDEX")
DEFAULT_LIMIT, LIMIT_CEILING = 20, 2048


def exact_key(value: Column) -> Column:
    """A value as the exact index has it: no control characters, no outer white space, ASCII upper case."""
    return ascii_upper(trim_right(trim_left(strip_control(value))))


def compares(key: Column, term: Term) -> Column:
    """The comparison a term asks for; an empty value is in nothing."""
    v = F.lit(term.value)
    if term.compare == EXACT:
        return key == v
    return key.startswith(v) if term.compare == PREFIX else F.lit(bool(term.value)) & F.contains(key, v)


def _attrs(catalog: Catalog, term: Term, classes: tuple[str, ...], kind: str) -> list[str]:
    """``class/id`` of the attributes the term searches in an index of that kind. An ID attribute counts only if it is named."""
    out = []
    for a in catalog.attributes:
        named = term.attr is not None and catalog.find_attribute(a.class_name, term.attr) == a
        if a.class_name in classes and (named or (term.attr is None and a.attr_type != "ID")) and a.index_kind in (kind, "ALL"):
            out.append(f"{a.class_name}/{a.attr_id}")
    return out


def _of(class_name: Column, x: Column) -> Column:
    return F.concat(class_name, F.lit("/"), x["attr_id"].cast("string"))


def _none() -> Column:
    return F.array().cast("array<struct<kind:int,span:int,key:string,attr_id:int>>")


def _index_hits(term: Term, catalog: Catalog, classes: tuple[str, ...]) -> Column:
    """The record's index keys that the term meets: (kind, -length for networks, key, attr_id)."""
    cls, av = F.col("class_name"), F.col("av")

    def hits(kind: int, attrs: list[str], key, meets, span=None) -> Column:
        if not attrs:
            return _none()
        made = F.transform(F.filter(av, lambda x: _of(cls, x).isin(*attrs) & x["value"].isNotNull()), lambda x: F.struct(F.lit(kind).alias("kind"), (span(x["value"]) if span else F.lit(0)).cast("int").alias("span"), key(x["value"]).alias("key"), x["attr_id"].cast("int").alias("attr_id")))
        return F.filter(made, lambda h: F.coalesce(meets(h["key"]), F.lit(False)))

    parts = [hits(0, _attrs(catalog, term, classes, "EXACT"), exact_key, lambda k: compares(k, term))]
    if is_network(term.value):
        covers = covering(term.value)
        parts.append(hits(1, _attrs(catalog, term, classes, "CIDR"), lambda v: net.key(net.parse(exact_key(v))), lambda k: k.isin(*covers), lambda v: -net.parse(exact_key(v))["len"]))
    sound = _attrs(catalog, term, classes, "SOUNDEX")
    if sound and phonetic.can_be_phonetic(term.value) and (coded := phonetic.key_of(term.value)):
        said = F.transform(F.filter(av, lambda x: _of(cls, x).isin(*sound) & x["value"].isNotNull()), lambda x: F.struct(x["attr_id"].alias("attr_id"), x["value"].alias("value")))
        keys = _phonetic_keys(F.transform(said, lambda x: x["value"]))
        made = F.transform(F.arrays_zip(said.alias("s"), keys.alias("k")), lambda z: F.struct(F.lit(2).alias("kind"), F.lit(0).alias("span"), z["k"].alias("key"), z["s"]["attr_id"].cast("int").alias("attr_id")))
        parts.append(F.filter(made, lambda h: F.coalesce(compares(h["key"], Term(coded, None, term.compare)), F.lit(False))))
    return reduce(F.concat, parts) if len(parts) > 1 else parts[0]


def _phonetic_keys(values: Column) -> Column:
    @F.pandas_udf("array<string>")
    def coded(v: pd.Series) -> pd.Series:
        return v.map(lambda xs: [phonetic.key_of(x) for x in xs] if xs is not None else None)

    return coded(values)


def is_network(value: str) -> bool:
    """Whether a query value is a network in the sense of the index."""
    import re

    return bool(re.search(net.NETWORK, value)) and bool(covering(value))


def covering(value: str) -> list[str]:
    """Keys of all networks that contain or equal a value, the longest first; none if it is no network."""
    import ipaddress

    address, slash, length = value.rpartition("/") if "/" in value else (value, "", "")
    if "." in address and ":" not in address:
        address = ".".join(p.lstrip("0") or "0" for p in address.split("."))
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return []
    size = int(length) if slash and length.isdigit() else 0 if slash else ip.max_prefixlen
    if size > ip.max_prefixlen:
        return []
    nets = [ipaddress.ip_network((ip, n), strict=False) for n in range(size, -1, -1)]
    return [f"{n.network_address.packed.hex()}/{n.prefixlen}" for n in nets]


def residual(term: Term, catalog: Catalog, classes: tuple[str, ...]) -> Column:
    """Whether some value of the record meets a further term: plain comparison, whatever the index of the attribute."""
    ids = [f"{c}/{a.attr_id}" for c in classes if term.attr and (a := catalog.find_attribute(c, term.attr))]
    cls = F.col("class_name")
    ours = (lambda x: _of(cls, x).isin(*ids)) if ids else (lambda x: F.lit(term.attr is None))
    return F.exists("av", lambda x: ours(x) & F.coalesce(compares(ascii_upper(x["value"]), term), F.lit(False)))


@dataclass(frozen=True)
class Hits:
    """All matches of a query, each with its rank; nothing has run yet."""

    frame: DataFrame
    order: tuple[str, ...] = ("auth_area", "class_name", "term_no", "kind", "span", "key", "attr_id", "row_id")

    def first(self, limit: int) -> DataFrame:
        """The first ``limit`` records in the order of hits; 0 is no limit."""
        ranked = self.frame.orderBy(*self.order)
        return ranked.limit(limit) if limit else ranked

    def status(self, limit: int) -> DataFrame:
        """(code): 230 if there is no record, 330 if there are more than ``limit``, else 0. Looks at no more than one beyond the limit."""
        n = F.count("*")
        seen = self.frame.select("row_id").limit(limit + 1) if limit else self.frame.select("row_id")
        return seen.agg(F.when(n == 0, 230).when(F.lit(limit > 0) & (n > limit), 330).otherwise(0).alias("code"))


def search(records: DataFrame, catalog: Catalog, query: Query, area: str | None = None) -> Hits:
    """Records that meet the query, with term_no, kind (index), span, key and attr_id of their first hit.

    A query without class looks at every class but ``referral``. A conjunction is entered through
    the index of its first term; if that term's attribute has no index in a class, or the class
    has no such attribute, the conjunction finds nothing there. Records without attributes or
    class match nothing. Extra columns are kept.
    """
    classes = (query.class_name,) if query.class_name else tuple(c for c in catalog.classes if fold(c) != "REFERRAL")
    rows = records.where(F.col("class_name").isin(*classes))
    if area is not None:
        rows = rows.where(ascii_upper("auth_area") == fold(area))
    firsts = []
    for no, group in enumerate(query.terms):
        first, *rest = group
        keys = _index_hits(first, catalog, classes)
        best = F.array_min(keys)
        rank = F.when(best.isNotNull() & reduce(lambda a, b: a & b, [residual(t, catalog, classes) for t in rest], F.lit(True)), F.struct(F.lit(no).alias("term_no"), best["kind"].alias("kind"), best["span"].alias("span"), best["key"].alias("key"), best["attr_id"].alias("attr_id")))
        firsts.append(rank)
    found = rows.withColumn("_hit", F.coalesce(*firsts)).where("_hit IS NOT NULL")
    names = ("term_no", "kind", "span", "key", "attr_id")
    return Hits(found.select(*[c for c in records.columns if c not in names], *[F.col(f"_hit.{n}").alias(n) for n in names]))


def allowed_limit(asked: int, ceiling: int = LIMIT_CEILING) -> bool:
    """Whether a session may set that limit; without ceiling any that is not negative, else one from 1 to the ceiling."""
    return asked >= 0 if ceiling == 0 else 0 < asked <= ceiling
