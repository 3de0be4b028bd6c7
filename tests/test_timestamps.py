"""Timestamps against an independent reading with strptime and zoneinfo."""

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from dirloom.operators.timestamps import abbreviation_offsets, estimate_zones, normalise, parse

FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%d-%b-%Y %H:%M:%S", "%a %b %d %H:%M:%S %Y", "%B %d, %Y %H:%M:%S", "%Y-%m-%d", "%a, %d %b %Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%Y%m%dT%H%M%S"]


def by_hand(text, zone, order):
    """Serial of one stamp, or None."""
    if text is None:
        return None
    t = text.strip()
    tz = ZoneInfo(zone)
    local = utc = None
    if re.fullmatch(r"\d+", t):
        try:
            if len(t) == 17:
                utc = datetime.strptime(t[:14], "%Y%m%d%H%M%S") + timedelta(milliseconds=int(t[14:]))
            elif len(t) in (8, 14):
                local = datetime.strptime(t, "%Y%m%d%H%M%S" if len(t) == 14 else "%Y%m%d")
            else:
                us = int(t) * (10**6 if len(t) <= 11 else 1000 if len(t) <= 13 else 1)
                utc = datetime(1970, 1, 1) + timedelta(microseconds=us)
        except ValueError:
            return None
    elif m := re.fullmatch(r"(\d+)\.(\d+)", t):
        utc = datetime(1970, 1, 1) + timedelta(seconds=int(m[1]), microseconds=int((m[2] + "000000")[:6]))
    else:
        u = re.sub(r"\s+", " ", t.upper())
        offset = None
        if m := re.search(r"(?<=[\d.]) ?([+-])(\d\d):?(\d\d)$", u) if ":" in u or "T" in u else None:
            offset, u = (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3])), u[: m.start()].strip()
        elif m := re.search(r"(?<=\d)(Z| [A-Z]{3,4})$", u):
            abbr = m[1].strip()
            u = u[: m.start()]
            offset = 0 if abbr in ("Z", "UTC", "GMT") else abbreviation_offsets([zone])[zone, abbr]
        micro = 0
        if m := re.search(r"[.,](\d+)$", u):
            micro, u = int((m[1] + "000000")[:6]), u[: m.start()]
        numeric = [f"{a}{s}{b}{s}%Y {c}" for a, b in [("%m", "%d") if order == "MDY" else ("%d", "%m")] for s in "/.-" for c in ("%H:%M", "%I:%M:%S %p")]
        for f in (*FORMATS, *numeric):
            try:
                local = datetime.strptime(u, f) + timedelta(microseconds=micro)
                break
            except ValueError:
                pass
        if local and offset is not None:
            utc = local - timedelta(minutes=offset)
    if utc is None and local is not None:
        utc = local.replace(tzinfo=tz, fold=0).astimezone(UTC).replace(tzinfo=None)
    return utc and utc.strftime("%Y%m%d%H%M%S") .zfill(14)+ f"{utc.microsecond // 1000:03d}"


def test_against_hand_reading(spark, sf):
    records = spark.read.parquet(f"{sf}/records.parquet")
    areas = spark.read.parquet(f"{sf}/auth_areas.parquet")
    zone = {r.auth_area: (r.tz_name, r.date_order) for r in areas.collect()}
    rows = normalise(records, areas).select("row_id", "auth_area", "updated", "updated_utc").collect()
    wrong = [(r.updated, zone[r.auth_area], r.updated_utc, by_hand(r.updated, *zone[r.auth_area])) for r in rows if r.updated_utc != by_hand(r.updated, *zone[r.auth_area])]
    assert not wrong, wrong[:10]
    assert len(rows) == records.count()


@pytest.fixture
def areas(spark):
    return spark.createDataFrame([("b", "Europe/Berlin", "DMY"), ("n", "America/New_York", "MDY"), ("l", "Europe/London", "DMY")], "auth_area string, tz_name string, date_order string")


CASES = [
    ("b", "2015-10-25 02:30:00", "20151025003000000"),  # twice: the first
    ("b", "2015-10-25 02:30:00 CET", "20151025013000000"),  # the abbreviation says which
    ("b", "2015-03-29 02:30:00", "20150329013000000"),  # skipped: the offset before
    ("n", "3/8/2020 2:30:00 AM", "20200308073000000"),
    ("n", "02/03/2020 10:00", "20200203150000000"),
    ("b", "02/03/2020 10:00", "20200302090000000"),
    ("b", "2020-02-30", None),
    ("b", "2020-02-29 24:00", None),
    ("b", "2020-02-29 10:60", None),
    ("b", "13:00", None),
    ("b", "20200230101010000", None),
    ("b", "1500000000", "20170714024000000"),
    ("b", "1500000000.9999", "20170714024000999"),
    ("b", "1500000000123456", "20170714024000123"),
    ("b", " 20200101000000000\t", "20200101000000000"),
    ("b", "2020-01-01T00:00:00.9999999+01:00", "20191231230000999"),
    ("b", " 2020-01-01T00:00:00z", "20200101000000000"),
    ("b", "12:15 never", None),
    ("b", "", None),
    ("b", None, None),
    ("b", "0/0/0000 00:00", None),
    ("b", "99999999999999999999999999", None),
    ("x", "2020-01-01", "20200101000000000"),  # no such area: UTC
    (None, "2020-01-01", "20200101000000000"),
    ("b", "x" * 100_000, None),
    ("l", "1-JUL-2020 12:15:00 BST", "20200701111500000"),
    ("b", "12/01/2020 12:05:00 AM", "20200111230500000"),
    ("b", "12/01/2020 13:05:00 AM", None),
]


def test_cases(spark, areas):
    df = spark.createDataFrame([(i, a, t, None, "own") for i, (a, t, _) in enumerate(CASES)], "i int, auth_area string, updated string, received_at timestamp_ntz, tz_name string")
    got = {r.i: r for r in normalise(df, areas).collect()}
    assert len(got) == len(CASES)
    assert [(CASES[i][:2], got[i].updated_utc) for i in got if got[i].updated_utc != CASES[i][2]] == []
    assert got[0]["tz_name"] == "own"


def test_empty(spark, areas):
    df = spark.createDataFrame([], "auth_area string, updated string, received_at timestamp_ntz")
    assert normalise(df, areas).collect() == []


def test_zone_is_estimated_from_offsets_when_none_is_declared(spark, sf):
    records = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/records.parquet")
    areas = spark.read.parquet(f"{sf}/auth_areas.parquet")
    blind = areas.selectExpr("auth_area", "CAST(NULL AS STRING) AS tz_name", "date_order")
    found = {r.auth_area: r for r in estimate_zones(parse(records.join(areas, "auth_area")), blind).collect()}
    truth = {r.auth_area: r.tz_name for r in areas.collect()}
    strong = [a for a, r in found.items() if r.evidence >= 20 and r.violations < r.evidence]
    assert strong
    hit = sum(found[a].zone == truth[a] for a in strong)
    assert hit / len(strong) >= 0.9
