"""A session: settings, query lines and statements, each answered with a frame and a status code."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as cat
from .functions.shapes import split_arguments
from .operators import access, binding, export
from .operators.validate import EMAIL
from .query.lang import QueryError, check, parse
from .query.search import DEFAULT_LIMIT, LIMIT_CEILING, allowed_limit, search
from .runtime import table

log = logging.getLogger("dirloom")
#: Fixed protocol texts by code.
MESSAGES = {
    120: "Registration Deferred", 130: "Object not authoritative", 230: "No Objects Found", 300: "Not Compatible With Version", 320: "Invalid Attribute", 321: "Invalid Attribute Syntax",
    322: "Required Attribute Missing", 323: "Object Reference Not Found", 324: "Primary Key Not Unique", 325: "Failed to Update Outdated Object", 330: "Exceeded Max Objects Limit", 331: "Invalid Limit",
    332: "Nothing To Transfer", 333: "Not Master for Authority Area", 336: "Object Not Found", 338: "Invalid Directive Syntax", 340: "Invalid Authority Area", 341: "Invalid Class", 342: "Invalid Host/Port",
    350: "Invalid Query Syntax", 351: "Query Too Complex", 352: "Invalid Security Method", 353: "Authentication Failed", 400: "Directive Not Available", 401: "Not Authorized for Directive",
    402: "Unidentified Error", 420: "Registration Not Authorized", 436: "Invalid Display Format", 503: "Idle Time Exceeded",
}
#: The statements, their capability bits and their descriptions.
DIRECTIVES = {
    "class": (0x000001, "get meta-information for the class(es)"),
    "directive": (0x000002, "get server allowable directives"),
    "display": (0x000004, "sets/displays the display types"),
    "forward": (0x000008, "server forward boolean"),
    "holdconnect": (0x000010, "hold the connection boolean"),
    "limit": (0x000020, "displays and sets record hit limit"),
    "notify": (0x000040, "tell server of bad referral or data change"),
    "quit": (0x000080, "quit connection"),
    "register": (0x000100, "add/mod/delete record in server"),
    "schema": (0x000200, "get the schema of an object"),
    "security": (0x000400, "identify the authentication method"),
    "soa": (0x000800, "ask server's authority area"),
    "status": (0x001000, "server's status"),
    "xfer": (0x002000, "transfer data from the server"),
    "X": (0x004000, "extended directives"),
}


def message(code: int) -> str:
    """The line that reports a code; 0 is success."""
    return "%ok" if code == 0 else f"%error {code} {MESSAGES.get(code, '')}".rstrip()


def capabilities(enabled: dict[str, bool] | None = None) -> int:
    """The capability bits of all statements that are enabled, as one number."""
    bits = 0
    for name, (bit, _) in DIRECTIVES.items():
        if (enabled or {}).get(name, True):
            bits |= bit
    return bits


@dataclass(frozen=True)
class Settings:
    limit: int = DEFAULT_LIMIT
    ceiling: int = LIMIT_CEILING
    wildcard: bool = True
    substring: bool = False
    hold: bool = False
    forward: bool = False
    display: str = "dump"
    version: str = "V-1.5"
    who: access.Credentials = access.Credentials()
    contact: str = ""


@dataclass
class Answer:
    """Rows of an answer, if it has any, and a frame of one code."""

    rows: DataFrame | None
    status: DataFrame

    def lines(self) -> list[str]:
        """The status as it is printed; runs the query."""
        return [message(r["code"]) for r in self.status.limit(1).collect()]


@dataclass
class Session:
    """Statements and queries over one data directory's frames."""

    spark: SparkSession
    records: DataFrame
    areas: DataFrame
    defs: DataFrame
    files: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    enabled: dict[str, bool] = field(default_factory=dict)
    extensions: dict[str, Callable[[Session, list[str]], DataFrame]] = field(default_factory=dict)
    notices: list[tuple[str, str]] = field(default_factory=list)
    class_aliases: dict[str, str] = field(default_factory=dict)
    #: A registration that is being spooled: action, sender, lines.
    pending: tuple[str, str, list[str]] | None = None

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str) -> Session:
        """A session over the tables of a data directory."""
        return cls(spark, table(spark, sf_dir, "records"), table(spark, sf_dir, "auth_areas"), table(spark, sf_dir, "attr_defs"), table(spark, sf_dir, "class_files"))

    @property
    def catalog(self) -> cat.Catalog:
        if not hasattr(self, "_catalog"):
            self._catalog = cat.from_tables(self.areas, self.defs, self.class_aliases)
        return self._catalog

    def code(self, code: int) -> DataFrame:
        return self.spark.range(1).select(F.lit(code).alias("code"))

    def run(self, line: str) -> Answer:
        """Answers a line: a statement if it begins with a minus, else a query; while a registration is open, a line of it."""
        if self.pending and not line.lower().startswith("-register"):
            self.pending[2].append(line)
            return Answer(None, self.code(0))
        try:
            if line.startswith("-"):
                return self._directive(line[1:])
            query = parse(line, self.catalog)
            check(query, self.settings.wildcard, self.settings.substring)
            hits = search(self.records, self.catalog, query)
            # the limit counts hits, also those that are not shown in the end
            first = hits.first(self.settings.limit)
            order = list(hits.order)
            seen = access.permissions(first, self.defs, self.settings.who)
            return Answer(access.visible(seen, self.defs).orderBy(*order), hits.status(self.settings.limit))
        except QueryError as e:
            log.info("%s: %s", line, e)
            return Answer(None, self.code(e.code))

    def _directive(self, text: str) -> Answer:
        words = split_arguments(text)
        name, args = (words[0], words[1:]) if words else ("", [])
        if name.upper().startswith("X-"):
            ext = self.extensions.get(name[2:].lower())
            if ext is None:
                raise QueryError(400, "Directive Not Available")
            return Answer(ext(self, args), self.code(0))
        known = {d.lower(): d for d in (*DIRECTIVES, "hello")}.get(name.lower())
        if known is None or not self.enabled.get(known, True):
            raise QueryError(400, "Directive Not Available")
        return getattr(self, f"_do_{known.lower()}")(args)

    def _one_area(self, args: list[str]) -> cat.Area:
        if not args:
            raise QueryError(338, "Invalid Directive Syntax")
        area = self.catalog.find_area(args[0])
        if area is None:
            raise QueryError(340, "Invalid Authority Area")
        return area

    def _classes(self, names: list[str]) -> list[str]:
        found = [self.catalog.find_class(n) for n in names]
        if None in found:
            raise QueryError(341, "Invalid Class")
        return found

    def _do_class(self, args: list[str]) -> Answer:
        area = self._one_area(args)
        listing = cat.class_listing(self.files).where(F.col("auth_area") == area.name)
        wanted = self._classes(args[1:])
        return Answer(listing.where(F.col("class_name").isin(*wanted)) if wanted else listing, self.code(0))

    def _do_schema(self, args: list[str]) -> Answer:
        self._one_area(args)
        wanted = self._classes(args[1:])
        listing = cat.schema_listing(self.defs)
        return Answer(listing.where(F.col("class_name").isin(*wanted)) if wanted else listing, self.code(0))

    def _do_soa(self, args: list[str]) -> Answer:
        areas = [self._one_area([a]).name for a in args]
        listing = cat.soa_listing(self.areas)
        return Answer(listing.where(F.col("auth_area").isin(*areas)) if areas else listing, self.code(0))

    def _do_status(self, args: list[str]) -> Answer:
        s = self.settings
        shown = {"limit": str(s.limit), "holdconnect": "ON" if s.hold else "OFF", "forward": "ON" if s.forward else "OFF", "display": s.display, "contact": s.contact}
        rows = self.spark.createDataFrame([*shown.items()], "property string, value string")
        return Answer(rows.union(self.records.agg(F.lit("objects").alias("property"), F.count("*").cast("string").alias("value"))), self.code(0))

    def _do_directive(self, args: list[str]) -> Answer:
        names = {d.lower(): d for d in DIRECTIVES}
        if any(a.lower() not in names for a in args):
            raise QueryError(400, "Directive Not Available")
        chosen = [names[a.lower()] for a in args] or [d for d in DIRECTIVES if self.enabled.get(d, True)]
        return Answer(self.spark.createDataFrame([(d, DIRECTIVES[d][1]) for d in chosen], "name string, description string"), self.code(0))

    def _do_display(self, args: list[str]) -> Answer:
        if args and args[0].lower() != "dump":
            raise QueryError(436, "Invalid Display Format")
        return Answer(self.spark.createDataFrame([("dump", 0, "attribute and value pairs")], "name string, length int, description string"), self.code(0))

    def _do_limit(self, args: list[str]) -> Answer:
        if len(args) != 1 or not args[0].lstrip("+-").isdigit() or not allowed_limit(int(args[0]), self.settings.ceiling):
            raise QueryError(331, "Invalid Limit")
        self.settings = replace(self.settings, limit=int(args[0]))
        return Answer(None, self.code(0))

    def _flag(self, args: list[str], name: str) -> Answer:
        if len(args) != 1 or args[0].upper() not in ("ON", "OFF"):
            raise QueryError(338, "Invalid Directive Syntax")
        self.settings = replace(self.settings, **{name: args[0].upper() == "ON"})
        return Answer(None, self.code(0))

    def _do_holdconnect(self, args: list[str]) -> Answer:
        return self._flag(args, "hold")

    def _do_forward(self, args: list[str]) -> Answer:
        return self._flag(args, "forward")

    def _do_notify(self, args: list[str]) -> Answer:
        if len(args) < 2 or args[0].lower() not in ("badref", "recurref", "update", "inssec", "delsec"):
            raise QueryError(338, "Invalid Directive Syntax")
        self.notices.append((args[0].lower(), " ".join(args[1:])))
        return Answer(None, self.code(0))

    def _do_hello(self, args: list[str]) -> Answer:
        if not args or args[0].upper() not in ("V-1.0", "V-1.5"):
            raise QueryError(300, "Not Compatible With Version")
        self.settings = replace(self.settings, version=args[0].upper())
        return Answer(self.spark.createDataFrame([(f"{args[0].upper()}:{capabilities(self.enabled):06x}:00",)], "banner string"), self.code(0))

    def _do_security(self, args: list[str]) -> Answer:
        if [a.lower() for a in args] == ["off"]:
            self.settings = replace(self.settings, who=access.Credentials())
        elif len(args) >= 4 and args[0].lower() == "on" and args[1].lower() in ("request", "response"):
            self.settings = replace(self.settings, who=access.Credentials(True, args[2], " ".join(args[3:])))
        else:
            raise QueryError(338, "Invalid Directive Syntax")
        return Answer(None, self.code(0))

    def _do_register(self, args: list[str]) -> Answer:
        """``on ACTION SENDER`` opens a registration, ``off`` closes it and answers with it as a row of changes: action, reg_email, payload.

        Such rows, once they have their numbers and times, are what ``operators.changes`` replays.
        """
        words = [a.lower() for a in args]
        if words[:1] == ["on"] and len(args) == 3 and words[1] in ("add", "mod", "del") and not self.pending:
            if not re.fullmatch(EMAIL, args[2]):
                raise QueryError(338, "Invalid Directive Syntax")
            self.pending = (words[1], args[2], [])
            return Answer(None, self.code(0))
        if words == ["off"] and self.pending:
            (action, sender, lines), self.pending = self.pending, None
            marked = any(x.strip().upper() == "_NEW_" for x in lines)
            # an add is one record; a mod has the old one's name before the new one
            if not lines or (action == "add" and marked):
                raise QueryError(338, "Invalid Directive Syntax")
            if action == "mod" and not marked:
                raise QueryError(336, "Object Not Found")
            return Answer(self.spark.createDataFrame([(action, sender, "\n".join(lines))], "action string, reg_email string, payload string"), self.code(0))
        raise QueryError(338, "Invalid Directive Syntax")

    def _do_xfer(self, args: list[str]) -> Answer:
        area, classes, since = export.plan_export(args, self.catalog)
        rows = export.exported(self.records, area, classes, since)
        return Answer(rows, rows.limit(1).agg(F.when(F.count("*") == 0, 332).otherwise(0).alias("code")))

    def _do_quit(self, args: list[str]) -> Answer:
        return Answer(None, self.code(0))

    def _do_x(self, args: list[str]) -> Answer:
        raise QueryError(400, "Directive Not Available")

    def shown(self, rows: DataFrame, key: str = "row_id") -> DataFrame:
        """Records as the lines a client sees."""
        return binding.dump(rows, key)
