"""Timestamps of mixed notation and zone, normalised to one UTC serial.

A stamp is parsed with JVM expressions into a local time or a moment. Stamps that carry no
zone take the offset history of their source. The history is the source's declared zone;
where none is declared it is estimated: every candidate zone is laid over the source's
evidence (stamps that state their own offset, and zone-less stamps against the time they
were received) and the zone that fits best wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from functools import lru_cache
from itertools import chain
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.norm import trim_blanks
from ..runtime import bounded

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
LONG_MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
DAY_US, QUARTER_US, MIN_US = 86_400_000_000, 900_000_000, 60_000_000
#: Zone-less stamps count if receipt is nearer than this to their local time: a day and the widest offset.
NEAR_MIN = (24 + 14) * 60
#: More zones than there are.
ZONES = 1000
#: Likely histories for sources without a declared zone, besides those other sources declare.
CANDIDATE_ZONES = ("UTC", "Europe/London", "Europe/Berlin", "Europe/Helsinki", "Europe/Moscow", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney", "Pacific/Auckland", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Sao_Paulo")

_SHAPES = {  # date shapes; each is rewritten to year|month|day|rest
    "day": (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3|"),
    "second": (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4:$5:$6"),
    "serial": (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{3})$", "$1|$2|$3|$4:$5:$6.$7Z"),
    "iso": (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[T ](.*))?$", "$1|$3|$4|$5"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[T ](.+)$", "$1|$2|$3|$4"),
    "dmon": (r"^(\d{1,2})[- ./]([A-Z]{3,9})\.?[- ,./] ?(\d{4})(?:,? (.*))?$", "$3|$2|$1|$4"),
    "mond": (r"^([A-Z]{3,9})\.? (\d{1,2}),? (\d{4})(?:,? (.*))?$", "$3|$1|$2|$4"),
    "ctime": (r"^([A-Z]{3,9}) (\d{1,2}) (\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)( [A-Z]{2,5}| [+-]\d{4})? (\d{4})$", "$5|$1|$2|$3$4"),
}
_NUMERIC = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?:,? (.*))?$"
#: hour|minute|second|fraction|half of day|zone
_TIME = r"^(\d{1,2})(:?)(\d{2})(?:\2(\d{2})(?:[.,](\d+))?)?(?: ?([AP]M)(?![A-Z]))? ?(Z|(?:UTC|GMT)?[+-]\d{1,2}(?::?[0-5]\d)?|[A-Z]{2,5})?$"


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def serial(us: Column) -> Column:
    """17-digit UTC serial of a moment in microseconds; null outside the years 1 to 9999."""
    day = F.floor(us / F.lit(DAY_US).cast("decimal(20,0)")).cast("bigint")
    ms = F.floor(F.pmod(us, F.lit(DAY_US)) / 1000).cast("bigint")
    d = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    clock = (F.floor(ms / 3_600_000) * 10_000_000 + F.floor(ms / 60_000) % 60 * 100_000 + ms % 60_000).cast("bigint")
    return F.when(us.between(-719_162 * DAY_US, 2_932_897 * DAY_US - 1), F.concat(F.date_format(d, "yyyyMMdd"), F.lpad(clock.cast("string"), 9, "0")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` names it.

    Catalyst merges chained projections by substitution, which multiplies nested regular
    expressions; a lambda variable is never substituted.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _stamp(t: Column, order: Column) -> Column:
    """Struct (utc, local, off, abbr, named) of one upper-cased text; named: its zone is Z, UTC or GMT."""
    n = F.length(t)
    shaped = None
    for pattern, to in _SHAPES.values():
        step = F.regexp_replace(t, pattern, to)
        shaped = F.when(t.rlike(pattern), step) if shaped is None else shaped.when(t.rlike(pattern), step)
    mdy, dmy = F.regexp_replace(t, _NUMERIC, "$4|$1|$3|$5"), F.regexp_replace(t, _NUMERIC, "$4|$3|$1|$5")
    shaped = shaped.when(t.rlike(_NUMERIC), F.when(order == "MDY", mdy).otherwise(dmy))
    count = F.when(t.rlike(r"^[0-9]+$") & ~n.isin(8, 14, 17), F.when(n <= 11, _long(t) * 1_000_000).when(n <= 13, _long(t) * 1000).when(n <= 18, _long(t)))
    part = F.split(t, r"\.")
    fraction = F.when(t.rlike(r"^[0-9]{1,11}\.[0-9]+$"), _long(part[0]) * 1_000_000 + _long(F.rpad(F.substring(part[1], 1, 6), 6, "0")))
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(str(i + 1))) for i, k in enumerate(MONTHS)), *chain.from_iterable((F.lit(k), F.lit(str(i + 1))) for i, k in enumerate(LONG_MONTHS) if len(k) > 3), F.lit("SEPT"), F.lit("9"))

    def local(p: Column, q: Column) -> Column:
        hour = _long(q[0])
        hour = F.when(q[4] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(q[4] == "PM", 12).otherwise(0))
        whole = F.concat(p[0], F.lit("-"), F.coalesce(names[p[1]], p[1]), F.lit("-"), p[2], F.lit(" "), hour.cast("string"), F.lit(":"), q[1], F.lit(":"), F.when(q[2] == "", "0").otherwise(q[2]), F.lit("."), F.rpad(F.substring(q[3], 1, 6), 6, "0"), F.lit("Z"))
        return F.when(p[0] != "0000", F.unix_micros(whole.try_cast("timestamp")))

    def east(zone: Column) -> Column:
        cut = F.split(F.regexp_replace(zone, r"^([+-])(\d{1,2}):?(\d{2})?$", "$1|$2|$3"), r"\|", -1)
        minutes = _let(cut, lambda o: (_long(o[1]) * 60 + F.when(o[2] == "", F.lit(0)).otherwise(_long(o[2]))) * F.when(o[0] == "-", -1).otherwise(1))
        return F.when(zone.isin("Z", "UTC", "GMT", "UT"), F.lit(0)).when(zone.rlike(r"^[+-]"), minutes).cast("bigint")

    def timed(p: Column, q: Column) -> Column:
        zone = F.regexp_replace(q[5], r"^(?:UTC|GMT)(?=[+-])", "")
        return _let(zone, lambda z: F.struct(local(p, q).alias("local"), east(z).alias("off"), F.when(z.rlike(r"^[A-Z]{2,5}$") & ~z.isin("UTC", "GMT", "UT"), z).alias("abbr"), z.isin("Z", "UTC", "GMT", "UT").alias("named")))

    def clocked(p: Column) -> Column:
        def of(rest: Column) -> Column:
            clock = F.when(rest == "", F.lit("0|0|0|0||")).when(rest.rlike(_TIME), F.regexp_replace(rest, _TIME, "$1|$3|$4|$5|$6|$7"))
            return _let(F.split(clock, r"\|", -1), lambda q: timed(p, q))

        return _let(F.trim(p[3]), of)

    at = F.when(shaped.isNotNull(), _let(F.split(shaped, r"\|", -1), clocked))
    return _let(at, lambda s: F.struct(F.coalesce(count, fraction).alias("utc"), s["local"].alias("local"), s["off"].alias("off"), s["abbr"].alias("abbr"), s["named"].alias("named")))


def parse(df: DataFrame, stamp: str = "updated", order: str = "date_order") -> DataFrame:
    """``df`` with ``_stamp``: struct of ``utc`` (a moment in microseconds), or ``local`` with ``off`` (minutes) or ``abbr`` or neither.

    All are null for a text that names no moment (impossible dates, words, empty, null). ``order`` is the column that says whether all-numeric dates are DMY
    or MDY; null means DMY.
    """
    t = F.regexp_replace(F.upper(trim_blanks(stamp)), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"^(?:MON|TUES?|WED(?:NES)?|THU(?:RS)?|FRI|SAT(?:UR)?|SUN)(?:DAY)?,? (?=[A-Z0-9])", "")
    return df.withColumn("_stamp", _let(t, lambda x: _stamp(x, F.col(order))))


def _to_utc(local: Column, zone: Column) -> Column:
    """Moment of a local time: first occurrence when doubled, offset before when skipped."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))


def _holds(local: Column, off: Column, zone: Column) -> Column:
    """Whether a zone has that offset at that local time; on a doubled time both hold."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(local - off * MIN_US), zone)) == local


def _used_since_1990(name: str) -> Iterator[tuple[str, str, int]]:
    """(zone, abbreviation, minutes east of UTC) month by month; nothing for a zone that does not exist."""
    try:
        zone = ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError):
        return
    for year in range(1990, 2038):
        for month in range(1, 13):
            at = datetime(year, month, 15, 12, tzinfo=UTC).astimezone(zone)
            yield name, at.tzname().upper(), round(at.utcoffset().total_seconds() / 60)


def abbreviation_offsets(zones: list[str]) -> dict[tuple[str, str], int]:
    """Minutes east of UTC of each abbreviation that a zone itself has used since 1990; the last if there are several."""
    return {(z, abbr): minutes for name in zones for z, abbr, minutes in _used_since_1990(name)}


@lru_cache(maxsize=1)
def _zone_table() -> tuple[tuple[str, dict[str, list[int]]], ...]:
    """(zone, offsets by abbreviation, the last first) of every zone of the tz database."""
    table = []
    for name in sorted(available_timezones()):
        used: dict[str, list[int]] = {}
        for _, abbr, minutes in _used_since_1990(name):
            offsets = used.setdefault(abbr, [])
            if minutes in offsets:
                offsets.remove(minutes)
            offsets.insert(0, minutes)
        table.append((name, used))
    return tuple(table)


def zones(spark: SparkSession) -> DataFrame:
    """(zone, _used, place): the zones that Python and the JVM both know, some 600 rows; place: whether it names a place."""
    jvm = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    rows = [(z, used, "/" in z and not z.startswith(("Etc/", "SystemV/", "posix/", "right/"))) for z, used in _zone_table() if z in jvm]
    return F.broadcast(spark.createDataFrame(rows, "zone string, _used map<string, array<bigint>>, place boolean").coalesce(1))


def _known_sources(sources: DataFrame, source: str, known: DataFrame) -> DataFrame:
    """(source, tz_name, date_order), one row each; a zone that does not exist counts as none."""
    has = {c: F.first(c, ignorenulls=True).alias(c) if c in sources.columns else F.lit(None).cast("string").alias(c) for c in ("tz_name", "date_order")}
    once = sources.where(F.col(source).isNotNull()).groupBy(source).agg(F.min("tz_name").alias("tz_name"), *[has["date_order"]] * ("date_order" in sources.columns))
    if "date_order" not in sources.columns:
        once = once.withColumn("date_order", has["date_order"])
    real = known.select(F.col("zone").alias("_real"))
    return once.join(real, once["tz_name"] == F.col("_real"), "left").select(source, F.col("_real").alias("tz_name"), "date_order")


def _abbreviated(local: Column, abbr: Column, zone: Column) -> Column:
    """Offsets that ``abbr`` means in the zone (map ``_used``) at that local time, the largest first; on a doubled time both."""
    return F.sort_array(F.filter(F.coalesce(F.col("_used")[abbr], F.array().cast("array<bigint>")), lambda o: _holds(local, o, zone)), asc=False)


def _received_us(df: DataFrame, received: str) -> Column:
    """Receipt in microseconds since 1970; a time without zone means UTC, whatever the session's zone."""
    if df.schema[received].dataType.typeName() == "timestamp":
        return F.unix_micros(received)
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(`{received}` AS TIMESTAMP_NTZ))")


def estimate_zones(parsed: DataFrame, sources: DataFrame, source: str = "auth_area", received: str = "received_at", candidates: tuple[str, ...] = CANDIDATE_ZONES, slack_minutes: int = 5, support: int = 5, declared_weight: float = 1.0) -> DataFrame:
    """(source, zone, violations, evidence): for each source the offset history that fits the evidence best.

    Evidence is pre-aggregated per source, local quarter hour and stated offset before candidate
    zones are laid over it, so a source holding a third of all rows costs no more than its
    distinct quarters; zones change their offset on quarters only. A stamp with a stated offset
    violates a history that has another offset at that moment; a zone-less stamp violates one
    that puts it after it was received, and misfits one the more the longer before receipt it
    puts it, by up to half a violation at a day or more: a zone west of the true one makes stamps
    late, one east of it makes them early. Only zone-less stamps received within a day count.
    An abbreviation violates a history that does not use it at that time. Stamps marked Z, UTC or
    GMT say nothing about the writer and are no evidence; a numeric +00:00 is.

    A zone the source declares is itself evidence: it counts as ``declared_weight`` agreements
    for each observation. At 1.0 no observations can outweigh it, which is what a binding
    declaration means; a lower weight lets a source that contradicts its declaration most of the
    time be read by what its stamps show. ``violations`` of the chosen history are reported
    either way. Candidates are the listed zones and those that any source declares; for a source
    without declaration also every other zone, which must fit better by one violation and a
    twentieth of the evidence. An undeclared source with less than ``support`` evidence, or whose
    best history is violated by more than half of it, is read as UTC. Sources that are not in
    ``sources`` get no row.
    """
    known = zones(parsed.sparkSession)
    own = _known_sources(sources, source, known)
    # minutes between the local time and receipt, cut to what can matter
    local, off = F.col("_stamp.local"), F.col("_stamp.off")
    margin = F.floor((_received_us(parsed, received) - local) / F.lit(float(MIN_US)))
    said = parsed.where(~F.coalesce("_stamp.named", F.lit(False))).select(source, F.floor(local / F.lit(float(QUARTER_US))).cast("bigint").alias("quarter"), off.alias("off"), F.col("_stamp.abbr").alias("abbr"), F.when(off.isNull() & F.col("_stamp.abbr").isNull(), F.greatest(F.lit(-NEAR_MIN - 1), F.least(F.lit(NEAR_MIN + 1), margin))).cast("int").alias("margin"))
    seen = said.where(f"quarter IS NOT NULL AND (off IS NOT NULL OR abbr IS NOT NULL OR margin BETWEEN -{NEAR_MIN} AND {NEAR_MIN})").groupBy(source, "quarter", "off", "abbr", "margin").agg(F.count("*").alias("n"))

    likely = known.where(F.col("zone").isin(*candidates)).select("zone").union(own.where("tz_name IS NOT NULL").select("tz_name")).distinct()
    first = F.array_position(F.array(*map(F.lit, candidates)), F.col("zone"))
    ranked = likely.agg(F.array_sort(F.collect_list(F.struct(F.when(first > 0, first).otherwise(len(candidates) + 1).alias("o"), "zone"))).alias("l"))
    rest = known.where("place").agg(F.array_sort(F.collect_list(F.struct(F.lit(1 << 20).cast("bigint").alias("o"), "zone"))).alias("l"))
    short = own.select(source, "tz_name", F.explode(ranked.scalar()).alias("c"))
    wide = own.where("tz_name IS NULL").select(source, "tz_name", F.explode(rest.scalar()).alias("c"))
    tried = short.union(wide).groupBy(source, "tz_name", F.col("c.zone").alias("zone")).agg(F.min("c.o").alias("o"))

    # a source tries the likely zones, at most all there are
    laid = seen.join(bounded(tried, by=sources, times=ZONES), source).join(known, "zone")
    start = F.col("quarter") * QUARTER_US
    has = ((start - _to_utc(start, F.col("zone"))) / MIN_US).cast("bigint")
    wrong = F.when(F.col("off").isNotNull(), ~_holds(start, F.col("off"), F.col("zone"))).when(F.col("abbr").isNotNull(), F.size(_abbreviated(start, F.col("abbr"), F.col("zone"))) == 0).otherwise(F.col("margin") + has < -slack_minutes)
    late = F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("margin") + has) / F.lit(DAY_US / MIN_US)) / 2
    misfit = F.when(wrong, F.lit(1.0)).when(F.col("margin").isNotNull(), late).otherwise(0)
    # thousandths, so that the sum is exact in any order
    scored = laid.groupBy(source, "tz_name", "zone", "o").agg(F.sum(F.round(misfit * 1000).cast("bigint") * F.col("n")).alias("misfit"), F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("violations"), F.sum("n").alias("evidence"))
    declared = F.col("zone") == F.col("tz_name")
    handicap = F.when(declared, -F.col("evidence") * round(declared_weight * 1000)).when(F.col("o") >= 1 << 20, 1000 + F.col("evidence") * 50).otherwise(0)
    scored = scored.withColumn("misfit", F.col("misfit") + handicap)
    best = scored.groupBy(source, "tz_name").agg(F.min(F.struct("misfit", F.when(declared, -1).otherwise(F.col("o")).alias("o"), "zone", "violations", "evidence")).alias("b"))
    zone = F.when(F.col("tz_name").isNull() & ((F.col("b.violations") * 2 > F.col("b.evidence")) | (F.col("b.evidence") < support)), "UTC").otherwise(F.col("b.zone"))
    return best.select(source, zone.alias("zone"), F.col("b.violations").alias("violations"), F.col("b.evidence").alias("evidence"))


def normalise(df: DataFrame, sources: DataFrame, stamp: str = "updated", source: str = "auth_area", received: str = "received_at", declared_weight: float = 1.0) -> DataFrame:
    """``df`` with ``utc_us`` and ``updated_utc``, the moment its stamp names.

    The zone of a source is the history ``estimate_zones`` chooses for it. Null, empty and
    undecidable stamps give null. Milliseconds are cut, not rounded. A source that is null, or
    that neither declares a zone nor shows evidence, is read as UTC with DMY dates; so is one
    whose declared zone does not exist, unless its evidence shows another. A source listed twice
    counts once. Extra columns of ``df`` are kept; those of ``sources`` never clash with them. A
    word of letters after a time counts as an abbreviation; one that the zone never used has the
    zone's own offset. The input is read twice: once for the evidence, once for the result.
    """
    known = zones(df.sparkSession)
    own = _known_sources(sources, source, known).select(F.col(source).alias("_s"), F.col("tz_name").alias("_tz"), F.col("date_order").alias("_order"))
    parsed = parse(df.join(bounded(own, by=sources), df[source] == F.col("_s"), "left"), stamp, "_order")
    chosen = estimate_zones(parsed, sources, source, received, declared_weight=declared_weight).select(F.col(source).alias("_z"), F.col("zone").alias("_zone"))
    out = parsed.join(bounded(chosen, by=sources), F.col(source) == F.col("_z"), "left").withColumn("_zone", F.coalesce("_zone", "_tz", F.lit("UTC")))
    out = out.join(known.select(F.col("zone").alias("_n"), "_used"), F.col("_zone") == F.col("_n"), "left")
    local, abbr, zone = F.col("_stamp.local"), F.col("_stamp.abbr"), F.col("_zone")
    # what the abbreviation means at that time; one out of season keeps its last meaning
    meant = F.coalesce(F.get(_abbreviated(local, abbr, zone), F.lit(0)), F.get(F.col("_used")[abbr], F.lit(0)))
    minutes = F.coalesce(F.col("_stamp.off"), F.when(abbr.isNotNull(), meant))
    us = F.coalesce(F.col("_stamp.utc"), F.when(minutes.isNotNull(), local - minutes * MIN_US).when(local.isNotNull(), _to_utc(local, zone)))
    return out.withColumn("utc_us", us).withColumn("updated_utc", _let(F.col("utc_us"), serial)).drop("_s", "_tz", "_order", "_z", "_zone", "_n", "_used", "_stamp")
