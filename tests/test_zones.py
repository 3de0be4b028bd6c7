"""Zones of sources that declare none."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from dirloom.operators.timestamps import estimate_zones, normalise, parse

START = datetime(2021, 1, 4, 9, 17, tzinfo=UTC)


def source(spark, stamps, declared=()):
    """Parsed stamps (text, received) of source ``s``, and the sources."""
    df = spark.createDataFrame([("s", t, r and r.replace(tzinfo=None)) for t, r in stamps], "auth_area string, updated string, received_at timestamp_ntz")
    areas = spark.createDataFrame([("s", None, "DMY"), *((f"d{i}", z, "DMY") for i, z in enumerate(declared))], "auth_area string, tz_name string, date_order string")
    return df, areas


def found(spark, stamps):
    df, areas = source(spark, stamps)
    return estimate_zones(parse(df.join(areas, "auth_area")), areas).first()


def zoneless(zone, lags, n=400, step=1171):
    at = [START + timedelta(minutes=step * i) for i in range(n)]
    return [(t.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), t + timedelta(minutes=lags[i % len(lags)])) for i, t in enumerate(at)]


def stated(zone, n, fmt="%Y-%m-%dT%H:%M:%S%:z", step=9_973):
    return [((START + timedelta(minutes=step * i)).astimezone(ZoneInfo(zone)).strftime(fmt), None) for i in range(n)]


def test_half_hour_zone_is_no_violation_of_itself(spark):
    r = found(spark, zoneless("Asia/Kolkata", [2, 5, 10]))
    assert (r.zone, r.violations) == ("Asia/Kolkata", 0)


def test_stamps_around_a_change_of_clocks_are_no_violations(spark):
    night = datetime(2020, 10, 24, 20, tzinfo=UTC)
    stamps = [((night + timedelta(minutes=15 * i)).astimezone(ZoneInfo("Europe/Berlin")).isoformat(), None) for i in range(40)]
    r = found(spark, stamps)
    assert (r.zone, r.violations, r.evidence) == ("Europe/Berlin", 0, 40)


def test_numeric_zero_is_evidence_and_few_foreign_stamps_are_not(spark):
    assert found(spark, stated("UTC", 25) + stated("Asia/Kolkata", 4)).zone == "UTC"
    assert found(spark, stated("Asia/Kolkata", 4)).zone == "UTC"
    assert found(spark, stated("UTC", 25, "%Y-%m-%dT%H:%M:%SZ") + stated("Asia/Kolkata", 6)).zone == "Asia/Kolkata"


def test_abbreviations_are_evidence(spark):
    stamps = [s for s in stated("America/Denver", 12, "%Y-%m-%d %H:%M:%S %Z")]
    r = found(spark, stamps)
    assert (r.zone, r.violations, r.evidence) == ("America/Denver", 0, 12)


def test_every_area_without_its_zone(spark, sf):
    records = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/records.parquet")
    areas = spark.read.parquet(f"{sf}/auth_areas.parquet")
    blind = areas.selectExpr("auth_area", "CAST(NULL AS STRING) AS tz_name", "date_order")
    truth = {r.auth_area: r.tz_name for r in areas.collect()}
    found = {r.auth_area: r.zone for r in estimate_zones(parse(records.join(areas, "auth_area")), blind).collect()}
    wrong = [(a, z, found.get(a)) for a, z in truth.items() if found.get(a, "UTC") != z]
    print("WRONG", len(wrong), len(truth), wrong)
    assert not [x for x in wrong if x[1] == "UTC"]
    assert len(wrong) <= 0.1 * len(truth)


def test_zones_are_found_by_receipt_alone(spark):
    zones = ["UTC", "Europe/London", "Europe/Berlin", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Sao_Paulo"]
    stamps = [(z, *s) for z in zones for s in zoneless(z, [2, 180, 45, 11, 90, 7, 130])]
    stamps += [("America/Denver", t, r - timedelta(hours=2)) for t, r in zoneless("America/Denver", [2], 5)]  # clocks that are wrong
    df = spark.createDataFrame([(z, t, r.replace(tzinfo=None)) for z, t, r in stamps], "auth_area string, updated string, received_at timestamp_ntz")
    areas = spark.createDataFrame([(z, None, "DMY") for z in zones], "auth_area string, tz_name string, date_order string")
    got = {r.auth_area: r.zone for r in estimate_zones(parse(df.join(areas, "auth_area")), areas).collect()}
    assert got == {z: z for z in zones}


def test_receipt_weeks_later_is_no_evidence(spark):
    assert found(spark, zoneless("America/New_York", [30_000, 90_000])) is None


def test_zones_outside_the_short_list(spark):
    for zone, declared in (("Asia/Kathmandu", ()), ("America/St_Johns", ()), ("America/Caracas", ("America/Caracas",))):
        df, areas = source(spark, [*stated(zone, 20), ("2021-07-01 12:00:00", None)], declared)
        got = {r.updated: r.updated_utc for r in normalise(df, areas).collect()}
        want = datetime(2021, 7, 1, 12, tzinfo=ZoneInfo(zone)).astimezone(UTC)
        assert got["2021-07-01 12:00:00"] == want.strftime("%Y%m%d%H%M%S000")


def test_length_loses_no_stamp(spark):
    texts = ["\t" * 90 + "2020-01-01 10:00" + "\r\n" * 20, "2020-01-01" + " " * 200 + "10:00", "1577872800." + "0" * 120, "2020-01-01 10:00:00." + "0" * 120, "x" * 100_000, "1" * 100_000]
    df, areas = source(spark, [(t, None) for t in texts])
    got = {r.updated: r.updated_utc for r in normalise(df, areas).collect()}
    assert [got[t] for t in texts] == ["20200101100000000"] * 4 + [None] * 2


def test_abbreviation_means_what_it_meant_then(spark):
    cases = [("2012-07-01 12:00:00 MSK", "20120701080000000"), ("2016-07-01 12:00:00 MSK", "20160701090000000"), ("2005-01-01 12:00:00 MSK", "20050101090000000"), ("2005-01-01 12:00:00 MSD", "20050101080000000"), ("2005-01-01 12:00:00 XYZ", "20050101090000000")]
    df = spark.createDataFrame([("m", t, None) for t, _ in cases], "auth_area string, updated string, received_at timestamp_ntz")
    areas = spark.createDataFrame([("m", "Europe/Moscow", "DMY")], "auth_area string, tz_name string, date_order string")
    got = {r.updated: r.updated_utc for r in normalise(df, areas).collect()}
    assert got == dict(cases)
