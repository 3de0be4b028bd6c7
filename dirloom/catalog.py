"""The declared schema: authority areas, classes, attributes and their aliases.

Catalog tables are small by nature (a row per declared attribute) and are collected; everything
that scales with records stays in frames.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.norm import ascii_upper, on_off
from .runtime import table

_FOLD = str.maketrans(string.ascii_lowercase, string.ascii_uppercase)
#: Fixed: the attributes every class begins with, in the order of their ids.
BASE = ("Class-Name", "ID", "Auth-Area", "Updated", "Guardian", "Private", "TTL")
#: Fixed aliases under which an untyped record names its area, class and version.
ANONYMOUS = {"Auth-Area": ("AUTH-AREA", "AA"), "Class-Name": ("CLASS-NAME", "CN", "SCHEMA-NAME", "OBJECT-TYPE"), "Updated": ("UPDATED", "UP")}
#: Most declared attributes, or areas, a catalog may have; a larger one is no catalog.
MOST_ATTRIBUTES = 1_000_000


def fold(name: str) -> str:
    """A name in ASCII upper case, without outer blanks."""
    return name.strip().translate(_FOLD)


@dataclass(frozen=True)
class Attribute:
    class_name: str
    attr_id: int
    name: str
    aliases: tuple[str, ...] = ()
    index_kind: str = "NONE"
    attr_type: str = "TEXT"
    is_primary_key: bool = False
    is_required: bool = False
    is_repeatable: bool = False
    is_multi_line: bool = False
    is_hierarchical: bool = False
    is_private: bool = False
    format: str | None = None

    @property
    def names(self) -> tuple[str, ...]:
        return (fold(self.name), *map(fold, self.aliases))


@dataclass(frozen=True)
class Area:
    name: str
    kind: str = "master"
    serial: str | None = None
    guardians: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalog:
    """Names are resolved without regard to ASCII case, names before aliases."""

    attributes: tuple[Attribute, ...]
    areas: tuple[Area, ...] = ()
    class_aliases: Mapping[str, str] = field(default_factory=dict)

    @cached_property
    def classes(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(a.class_name for a in self.attributes))

    @cached_property
    def _classes(self) -> dict[str, str]:
        return {fold(k): v for k, v in self.class_aliases.items()} | {fold(c): c for c in self.classes}

    @cached_property
    def _attributes(self) -> dict[str, dict[str, Attribute]]:
        of: dict[str, dict[str, Attribute]] = {c: {} for c in self.classes}
        for alias in (True, False):
            for a in self.attributes:
                for n in a.names[1:] if alias else a.names[:1]:
                    of[a.class_name][n] = a
        return of

    def find_class(self, name: str) -> str | None:
        """The class of that name or alias."""
        return self._classes.get(fold(name))

    def find_area(self, name: str) -> Area | None:
        """The area of that name."""
        return next((a for a in self.areas if fold(a.name) == fold(name)), None)

    def find_attribute(self, class_name: str, name: str) -> Attribute | None:
        """The attribute of a class by name or alias."""
        return self._attributes.get(class_name, {}).get(fold(name))

    def has_attribute(self, name: str) -> bool:
        """Whether any class has an attribute of that name or alias."""
        return any(fold(name) in of for of in self._attributes.values())

    def by_id(self, class_name: str, attr_id: int) -> Attribute | None:
        """The attribute of a class by its id."""
        return next((a for a in self.attributes if a.class_name == class_name and a.attr_id == attr_id), None)

    def is_base(self, name: str) -> bool:
        """Whether an attribute is one that every class has."""
        return fold(name) in {fold(b) for b in BASE}

    def has_class_anywhere(self, name: str) -> bool:
        return self.find_class(name) is not None

    def next_attr_id(self) -> int:
        """The id a new attribute gets."""
        return max((a.attr_id for a in self.attributes), default=-1) + 1

    # changes give a new catalog

    def with_attribute(self, a: Attribute) -> Catalog:
        """With one more attribute; one that breaks a rule is left out."""
        from .operators.validate import attribute_faults

        return self if attribute_faults(a, self) else Catalog((*self.attributes, a), self.areas, self.class_aliases)

    def without_class(self, name: str) -> Catalog:
        gone = self.find_class(name)
        return Catalog(tuple(a for a in self.attributes if a.class_name != gone), self.areas, {k: v for k, v in self.class_aliases.items() if v != gone})

    def with_area(self, area: Area) -> Catalog:
        """With one more area; one with the name and kind of another is a duplicate and is left out."""
        dup = any(fold(a.name) == fold(area.name) and a.kind == area.kind for a in self.areas)
        return self if dup else Catalog(self.attributes, (*self.areas, area), self.class_aliases)

    def without_area(self, name: str) -> Catalog:
        return Catalog(self.attributes, tuple(a for a in self.areas if fold(a.name) != fold(name)), self.class_aliases)


def from_tables(areas: DataFrame | None, defs: DataFrame, class_aliases: Mapping[str, str] | None = None) -> Catalog:
    """The catalog of two tables in the shape of ``auth_areas`` and ``attr_defs``; nulls are the defaults. Searches need no areas."""
    rows = defs.where("class_name IS NOT NULL AND attr_id IS NOT NULL AND attr_name IS NOT NULL").limit(MOST_ATTRIBUTES + 1).collect()
    if len(rows) > MOST_ATTRIBUTES:
        raise ValueError("too many declared attributes for a catalog")
    rows.sort(key=lambda r: (r.class_name, r.local_id if r.local_id is not None else r.attr_id, r.attr_id))
    flags = ("is_primary_key", "is_required", "is_repeatable", "is_multi_line", "is_hierarchical", "is_private")
    attributes = tuple(Attribute(r.class_name, r.attr_id, r.attr_name, tuple(r.aliases or ()), r.index_kind or "NONE", r.attr_type or "TEXT", **{f: bool(r[f]) for f in flags}) for r in rows)
    if areas is None:
        return Catalog(attributes, (), dict(class_aliases or {}))
    own = areas.where("auth_area IS NOT NULL").select("auth_area", "area_type", "serial_no").limit(MOST_ATTRIBUTES + 1).collect()
    if len(own) > MOST_ATTRIBUTES:
        raise ValueError("too many areas for a catalog")
    own.sort(key=lambda r: r.auth_area)
    return Catalog(attributes, tuple(Area(r.auth_area, r.area_type or "master", r.serial_no) for r in own), dict(class_aliases or {}))


def load(spark: SparkSession, sf_dir: str, class_aliases: Mapping[str, str] | None = None) -> Catalog:
    """The catalog of a data directory."""
    return from_tables(table(spark, sf_dir, "auth_areas"), table(spark, sf_dir, "attr_defs"), class_aliases)


def aliases(defs: DataFrame) -> DataFrame:
    """(class_name, attr_id, attr_name, name): a row for every folded name of every attribute, its aliases included."""
    named = F.concat(F.array("attr_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return defs.select("class_name", "attr_id", "attr_name", F.explode(named).alias("n")).select("class_name", "attr_id", "attr_name", ascii_upper("n").alias("name"))


def attribute_directory(defs: DataFrame) -> DataFrame:
    """(attr_name, classes): every attribute with the classes that have it."""
    return defs.groupBy("attr_name").agg(F.array_join(F.array_sort(F.collect_set("class_name")), ",").alias("classes"))


def class_directory(records: DataFrame) -> DataFrame:
    """(class_name, areas): every class with the areas that hold records of it."""
    return records.where("class_name IS NOT NULL").select("class_name", "auth_area").distinct().groupBy("class_name").agg(F.array_join(F.array_sort(F.collect_list("auth_area")), ",").alias("areas"))


def schema_listing(defs: DataFrame) -> DataFrame:
    """(class_name, attr_name, property, value): what is declared of each attribute, one property a row; of its index only whether there is one."""
    kind = F.when(F.col("attr_type") == "SEE-ALSO", "See-Also").when(F.col("attr_type") == "ID", "ID").otherwise("Text")
    shown = {
        "attribute": F.col("attr_name"), "format": F.lit(""), "description": F.lit(""), "indexed": on_off(F.col("index_kind") != "NONE"), "required": on_off("is_required"), "multi-line": on_off("is_multi_line"),
        "repeatable": on_off("is_repeatable"), "hierarchical": on_off("is_hierarchical"), "private": on_off("is_private"), "type": kind, "primary": on_off("is_primary_key"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in shown.items()])).alias("p")
    return defs.select("class_name", "attr_name", pairs).select("class_name", "attr_name", "p.property", "p.value")


def class_listing(files: DataFrame) -> DataFrame:
    """(auth_area, class_name, version): the latest version of each class in each area."""
    padded = F.rpad(F.trim("class_version"), 17, "0")
    return files.groupBy("auth_area", "class_name").agg(F.max(padded).alias("version"))


def soa_listing(areas: DataFrame) -> DataFrame:
    """(auth_area, property, value): start-of-authority data of areas that have a serial."""
    shown = {"authority": F.col("auth_area"), "ttl": F.col("time_to_live").cast("string"), "serial": F.col("serial_no"), "refresh": F.col("refresh_interval").cast("string"), "increment": F.col("increment_interval").cast("string"), "retry": F.col("retry_interval").cast("string"), "hostmaster": F.col("hostmaster"), "primary": F.col("primary_server")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in shown.items()])).alias("p")
    return areas.where("serial_no IS NOT NULL AND serial_no != ''").select("auth_area", pairs).select("auth_area", "p.property", "p.value")


def name_collisions(names: Iterable[str]) -> dict[str, int]:
    """Folded names that occur more than once, with their counts."""
    seen: dict[str, int] = {}
    for n in names:
        seen[fold(n)] = seen.get(fold(n), 0) + 1
    return {n: k for n, k in seen.items() if k > 1}
