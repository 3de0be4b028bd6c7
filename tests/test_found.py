"""The registered queries against independent readings."""

import re

import __spark_entry__
from tests.test_timestamps import by_hand


def test_p1_found(spark, sf):
    records = spark.read.parquet(f"{sf}/records.parquet").collect()
    zone = {r.auth_area: (r.tz_name, r.date_order) for r in spark.read.parquet(f"{sf}/auth_areas.parquet").collect()}
    want = {(r.row_id, by_hand(r.updated, *zone[r.auth_area])) for r in records if r.updated is not None and not re.fullmatch(r"[0-9]{17}", r.updated)}
    want = {x for x in want if x[1] is not None}
    got = [tuple(r) for r in __spark_entry__.queries()["p1_found"](spark, sf).collect()]
    assert want and set(got) == want and len(got) == len(want)
    assert __spark_entry__.entry(spark).count() > 0
