"""Operators of the engine on hand-made cases: change feeds, drift, wide tables, manifests, access, export, registration."""

import random

import pytest

from dirloom.catalog import Area, Attribute, Catalog
from dirloom.operators import access, binding, changes, export, postings, register, rows, validate, versions, wide
from dirloom.operators.timestamps import normalise
from dirloom.query.lang import QueryError

AV = "array<struct<pos:int,attr_id:int,attr:string,value:string>>"


def played(feed, partial):
    """Plain replay of (key, at, seq, no, op, x, y)."""
    live, done = {}, set()
    for k, _, _, no, op, x, y in sorted((f for f in feed if f[0] is not None and f[4] in ("add", "mod", "del")), key=lambda f: f[:4]):
        if (k, no) in done:
            continue
        done.add((k, no))
        if op == "add" and k not in live:
            live[k] = (x, y)
        elif op == "mod" and k in live:
            live[k] = (x if x is not None else live[k][0], y if y is not None else live[k][1]) if partial else (x, y)
        elif op == "del":
            live.pop(k, None)
    return {(k, *v) for k, v in live.items()}


@pytest.mark.parametrize("partial", [False, True])
def test_replay_with_a_hot_key(spark, partial):
    """Half of all changes are one key's; repeats, other actions and null keys are among them."""
    rnd = random.Random(3)
    feed = []
    for no in range(3000):
        key = "hot" if no % 2 else rnd.choice(["a", "b", "c", None, "d"])
        f = (key, rnd.randint(0, 500), rnd.randint(0, 3), no, rnd.choices(["add", "mod", "del", "other"], [5, 8, 2, 1])[0], rnd.choice([None, f"x{no}"]), rnd.choice([None, no]))
        feed += [f] * rnd.choice([1, 1, 2])
    rnd.shuffle(feed)
    df = spark.createDataFrame(feed, "k string, at bigint, seq int, no bigint, op string, x string, y bigint").repartition(5)
    got = changes.replay(df, "k", ["at", "seq"], "no", "op", ["x", "y"], partial).collect()
    assert {tuple(r) for r in got} == played(feed, partial) and len(got) == len({r.k for r in got})


def test_replay_edges(spark):
    df = spark.createDataFrame([("k", None, 1, "add"), ("k", 1, 2, "del"), ("m", 1, 3, "mod"), (None, 1, 4, "add")], "k string, at bigint, no bigint, op string")
    assert changes.replay(df, "k", ["at"], "no", "op", ["no"]).collect() == []
    assert changes.replay(df.limit(0), "k", ["at"], "no", "op", ["no"]).collect() == []
    only = changes.replay(df.where("no = 1"), "k", ["at"], "no", "op", ["no"]).collect()
    assert [tuple(r) for r in only] == [("k", 1)]


def test_rows_edges(spark):
    """Null rows and separators, long rows, repeated rows, clashing columns, null areas, empty tables; every row is loaded or rejected."""
    areas = spark.createDataFrame([("A.com", "x"), (None, "x")], "auth_area string, raw string")
    data = [(1, None, ";"), (2, "1.a.com,a,b,N,v", None), (3, "1.a.com;a;b;N;" + "v" * 500_000, ";"), (4, "1.a.com|a|b|N|v", "|"), (4, "1.a.com|a|b|N|v", "|"), (5, '1.a.com\ta\tb\tN\t"x""y\n"', "\t"), (None, "bad", ";"), (6, "1.b.com;a;b;N;v", ";")]
    df = spark.createDataFrame([(*x, "own") for x in data], "line_id bigint, raw string, sep string, reason string")
    bad = {r.line_id: r.reason for r in rows.rejected(df, areas).collect()}
    assert bad == {1: "columns", None: "columns", 6: "id"}
    good = rows.loaded(df, areas).collect()
    assert sorted(r.line_id for r in good) == [2, 3, 4, 4, 5] and {r.value for r in good if r.line_id == 5} == {'x"y\n'}
    assert rows.rejected(df.limit(0), areas).collect() == [] and rows.loaded(df.limit(0), areas).collect() == []
    own = rows.Rule("value", 5, "regex", r"\Av+\z")
    assert {r.line_id for r in rows.rejected(df, areas, (*rows.RULES, own)).collect()} == {1, None, 5, 6}


DEFS = "class_name string, local_id int, attr_id int, attr_name string, aliases array<string>, is_primary_key boolean, is_required boolean, is_repeatable boolean, is_multi_line boolean, is_private boolean, index_kind string, attr_type string, value_kind string"


@pytest.fixture(scope="module")
def defs(spark):
    def d(c, i, n, aliases=(), kind="text", many=False, **f):
        g = {"is_primary_key": False, "is_required": False, "is_private": False, "index_kind": "NONE", "attr_type": "TEXT"} | f
        return (c, i, i, n, list(aliases), g["is_primary_key"], g["is_required"], many, False, g["is_private"], g["index_kind"], g["attr_type"], kind)

    base = [d(c, i, n, a, **f) for c in ("thing", "guardian") for i, n, a, f in ((0, "Class-Name", ("CN",), {}), (1, "ID", (), {}), (2, "Auth-Area", ("AA",), {}), (4, "Guardian", (), {"attr_type": "ID"}), (5, "Private", (), {"is_private": True}))]
    own = [d("thing", 10, "Size", ("SZ",), "integer"), d("thing", 11, "Made", (), "date"), d("thing", 12, "Tags", (), "text", True), d("thing", 13, "Good", (), "boolean"), d("thing", 14, "Counts", (), "integer", True), d("guardian", 20, "Guard-Scheme"), d("guardian", 21, "Guard-Info", is_private=True)]
    return spark.createDataFrame(base + own, DEFS)


def test_wide_tables(spark, defs):
    """Typed cells, arrays, lost cells; aliases, unknown names, nulls, repeated rows, a class per signature and a rare one."""
    rows_ = []
    for e in range(40):
        rid = f"e{e}"
        rows_ += [(rid, 0, "cn", " THING "), (rid, 1, "size", str(e))]
        if e % 2:
            rows_ += [(rid, 2, "Made", "2020-02-29"), (rid, 2, "Made", "2020-02-29")]
    rows_ += [("r", 0, "Class-Name", "thing"), ("r", 5, "SZ", " x "), ("r", 4, "Size", "y"), ("r", 3, "Counts", "1"), ("r", 2, "counts", "+2"), ("r", 6, "COUNTS", "z"), ("r", 7, "Tags", "b"), ("r", 8, "tags", "a"), ("r", 9, "Good", "yes"), ("r", 9, "Made", "2021-02-29"), ("r", 9, "Nope", "1"), ("r", 9, None, "1"), ("r", 9, "Made", None), (None, 1, "Size", "1"), ("q", 1, "Size", "1"), ("s", 0, "cn", "no-class")]
    pairs = spark.createDataFrame([(*r, "own") for r in rows_], "rid string, pos int, attr_name string, value string, class string")
    tables = wide.wide_tables(pairs, defs)
    t = {r.rid: r for r in tables["thing"].collect()}
    assert len(t) == 41 and int(t["e7"].Size) == 7 and str(t["e7"].Made) == "2020-02-29" and t["e6"].Made is None and t["e6"].lost == []
    r = t["r"]
    assert (r.Size, r.Made, r.Good, r.Tags, [int(x) for x in r.Counts]) == (None, None, True, ["b", "a"], [2, 1])
    assert {tuple(x) for x in wide.lost(pairs, defs).collect()} == {("r", "Size"), ("r", "Made")}
    assert {tuple(x) for x in wide.lost(pairs, defs, own_share=1.1).collect()} == {("r", "Size"), ("r", "Made")}
    assert tables["guardian"].count() == 0 and wide.lost(pairs.limit(0), defs).collect() == []


def test_drift(spark):
    """A rename with a type change, an addition, a removal, and what becomes of them in the one table; nulls, blanks and equal versions."""
    files = spark.createDataFrame([(1, "d", "20200101"), (2, "d", " 20200101000000 "), (3, "d", "20210101"), (4, None, "20210101"), (5, "d", None), (6, "d", "20220101")], "file_no bigint, db_dir string, class_version string")
    pairs = []
    for i in range(20):
        pairs += [(1 + i % 2, f"r{i}", 0, "Size ", str(i)), (1 + i % 2, f"r{i}", 1, "old", f"v{i}"), (1 + i % 2, f"r{i}", 2, "flag", "yes")]
        pairs += [(3, f"r{i}", 0, "volume", str(i) if i else "changed"), (3, f"r{i}", 1, "flag", "maybe" if i % 2 else "yes"), (3, f"r{i}", 2, "fresh", " ")]
        pairs += [(6, f"r{i}", 0, "volume", str(i)), (6, f"r{i}", 1, "flag", "yes")]
    pairs += [(3, None, 5, None, "x"), (3, "r1", 6, "volume", None), (99, "r1", 0, "size", "1"), (4, "r1", 0, "size", "1")]
    drift = versions.Drift(files, spark.createDataFrame(pairs, "file_no bigint, rid string, pos int, attr_name string, value string"))
    got = {tuple(r) for r in drift.report().collect()}
    a, b = "20210101" + "0" * 9, "20220101" + "0" * 9
    assert got == {("d", a, "renamed", "size", "volume"), ("d", a, "removed", "old", ""), ("d", a, "added", "", "fresh"), ("d", a, "retyped", "flag", "flag"), ("d", b, "removed", "fresh", ""), ("d", b, "retyped", "flag", "flag")}
    columns = {(r.ver[:4], r.name): (r.attr, r.type) for r in drift.columns().collect()}
    assert columns["2020", "size"] == ("volume", "integer") == columns["2022", "volume"] and columns["2020", "flag"] == ("flag", "text")
    table = drift.one_table()
    assert table.where("attr = 'volume'").count() == 60 and table.where("attr = 'volume' AND value_integer IS NOT NULL").count() == 59
    none = versions.Drift(files.limit(0), drift.pairs)
    assert none.report().collect() == [] and none.one_table().collect() == []


def test_flooding_settles():
    import numpy as np

    start = np.array([[0.1, 0.9], [0.4, 0.1]])
    score, rounds = versions.flood(start, ["text", "integer"], ["integer", "text"], [0, 1], [1, 0])
    assert rounds < versions.MOST_ROUNDS and score[0].argmax() == 1 and score[1].argmax() == 0


def test_zones_of_sources(spark):
    """A source listed twice, a zone that does not exist, a declaration outweighed, other session zones."""
    areas = spark.createDataFrame([("b", "Europe/Berlin", "DMY"), ("b", "Europe/Berlin", "DMY"), ("n", "No/Where", "DMY"), (None, "UTC", "DMY")], "auth_area string, tz_name string, date_order string")
    stamps = [("b", "2021-07-01T12:00:00-04:00")] * 30 + [("b", "2021-07-01 12:00:00"), ("n", "2021-07-01 12:00:00"), ("zz", "2021-07-01 12:00:00"), (None, "2021-07-01 12:00:00")]
    df = spark.createDataFrame([(i, a, t, None) for i, (a, t) in enumerate(stamps)], "row_id int, auth_area string, updated string, received_at timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r.row_id: r.updated_utc for r in normalise(df, areas).collect()}
            assert len(got) == 34 and [got[30], got[31], got[32], got[33]] == ["20210701100000000"] + ["20210701120000000"] * 3
            light = {r.row_id: r.updated_utc for r in normalise(df, areas, declared_weight=0.5).collect()}
            assert light[30] == "20210701160000000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_guardians(spark, defs):
    av = lambda *pairs: [(i, a, n, v) for i, (a, n, v) in enumerate(pairs)]
    data = [
        ("g.1", "a", "guardian", av((1, "ID", "G.1"), (20, "Guard-Scheme", "PW"), (21, "Guard-Info", "secret"))),
        ("g.2", "a", "guardian", av((20, "Guard-Scheme", "crypt-pw"), (21, "Guard-Info", "2bb80d537b1da3e38bd30361aa855686bde0eacd7162fef6a25fe97bf527a25b"))),
        ("t.1", "a", "thing", av((4, "Guardian", "g.1"), (5, "Private", "yes"))),
        ("t.2", "a", "thing", av((5, "Private", "ON"), (10, "Size", "1"))),
        ("t.3", "a", "thing", av((4, "Guardian", "g.9"))),
        ("t.4", "b", "thing", av((10, "Size", "2"))),
    ]
    df = spark.createDataFrame(data, f"rid string, auth_area string, class_name string, av {AV}")
    may = lambda who, of=None: {r.rid for r in access.permissions(df, defs, who, of).where("permitted").collect()}
    assert may(access.Credentials()) == {"t.2", "t.4"}
    assert may(access.Credentials(True)) == set()
    assert may(access.Credentials(True, "pw", "secret")) == {"t.2", "t.4", "t.1", "g.1"}
    assert may(access.Credentials(True, "crypt-pw", "secret")) == {"t.2", "t.4", "g.2"}
    assert may(access.Credentials(True, "pw", "wrong")) == {"t.2", "t.4"}
    of = spark.createDataFrame([("b", "g.1")], "auth_area string, guardian string")
    assert "t.4" not in may(access.Credentials(), of) and "t.4" in may(access.Credentials(True, "pw", "secret"), of)
    seen = {r.rid: [x.attr for x in r.av] for r in access.visible(access.permissions(df, defs, access.Credentials()), defs).collect()}
    assert "t.1" not in seen and seen["g.1"] == ["ID", "Guard-Scheme"] and seen["t.2"] == ["Private", "Size"]
    assert [tuple(r) for r in access.stale_guardians(df).collect()] == [("t.3", "g.9")]


def test_host_lists(spark):
    hosts = spark.createDataFrame([("a.b.com", "10.1.2.3"), ("local", "10.1.9.9"), ("", "fd00::1"), (None, None)], "host string, address string")

    def let_in(allow, deny):
        return [r.allowed for r in access.allowed(hosts, allow, deny).collect()]

    assert let_in([], []) == [True] * 4
    assert let_in([], ["ALL"]) == [False] * 4
    assert let_in([".b.com"], ["ALL"]) == [True, False, False, False]
    assert let_in(["LOCAL"], ["ALL"]) == [False, True, False, False]
    assert let_in(["KNOWN"], ["ALL"]) == [True, True, False, False]
    assert let_in(["ALL EXCEPT 10.1. EXCEPT local"], ["ALL"]) == [False, True, True, True]
    assert let_in(["[fd00::/16]"], ["ALL"]) == [False, False, True, False]
    assert let_in(["10.1.0.0/255.255.240.0"], ["ALL"]) == [True, True, False, False]


def test_binding_and_text(spark, defs):
    pairs = spark.createDataFrame([("r", 1, " cn", "Thing"), ("r", 2, "SIZE", " 5 "), ("r", 2, "Size", "5"), ("r", 3, "What", "x"), ("r", 4, "Tags", ""), ("s", 1, "AA", "a.com"), ("s", 2, "Object-Type", "thing"), ("t", 1, "Size", "1"), (None, 1, "CN", "thing")], "rid string, pos int, attr_name string, value string")
    got = {r.rid: r for r in binding.bind(pairs, defs.where("attr_id != 0").union(defs.where("attr_id = 0"))).collect()}
    assert [(x.attr, x.value) for x in got["r"].av] == [("Class-Name", "Thing"), ("Size", "5")] and got["r"].auth_area is None
    assert set(got) == {"r", "s"} and [(x.attr, x.value) for x in got["s"].av][:2] == [("Class-Name", "thing"), ("Auth-Area", "a.com")]
    text = binding.record_text(spark.createDataFrame([("r", [(0, 1, "A", "x"), (1, 2, "B", ""), (2, 3, "C", None), (3, 4, "D", "y:z")])], f"rid string, av {AV}")).first().text
    assert text == "A:x\nD:y:z\n---\n"


def test_manifests(spark):
    m = spark.createDataFrame([("a", "DATA", 1, 10, 1, False), ("b", "EXACT", 2, 20, 2, False), ("c", "EXACT", 4, 30, 3, True)], "name string, type string, file_no int, size bigint, num_recs bigint, locked boolean")
    assert [r.name for r in postings.files_of(m, "INDEX").collect()] == ["b"] and postings.files_of(m).count() == 2
    new = spark.createDataFrame([("d", "DATA", 0, 5, 5, False), ("a", "DATA", 0, 5, 5, False), ("e", "CIDR", 0, 5, 5, False)], m.schema)
    added = postings.add_files(m, new, locked=True)
    assert {(r.name, r.file_no, r.locked) for r in added.collect()} == {("a", 1, False), ("b", 2, False), ("c", 4, True), ("d", 5, True), ("e", 6, True)}
    assert {r.name for r in postings.delete_files(m, new).collect()} == {"b", "c"}
    assert {r.name: r.size for r in postings.modify_files(m, new).collect()} == {"a": 5, "b": 20, "c": 30}
    assert {r.name for r in postings.lock_files(m, new).where("locked").collect()} == {"a", "c"}
    freed = postings.lock_files(m, m, False)
    assert [tuple(r) for r in postings.repack(freed).collect()] == [("EXACT", 2, 5)] and postings.repack(freed, 25).collect() == []


def test_sorted_postings(spark, tmp_path, sf):
    found = postings.postings(spark.read.parquet(f"{sf}/records.parquet"), spark.read.parquet(f"{sf}/attr_defs.parquet"), ("EXACT", "CIDR"))
    postings.write_sorted(found, f"{tmp_path}/p", 4)
    back = spark.read.parquet(f"{tmp_path}/p")
    assert back.count() == found.count()
    import pyarrow.parquet as pq

    for f in (tmp_path / "p" / "index_kind=EXACT").glob("*.parquet"):
        keys = pq.read_table(f, columns=["key"])["key"].to_pylist()
        assert keys == sorted(keys, key=str.encode)
    line = spark.createDataFrame([("12:3:0:7:a:b",), ("x",)], "l string").select(postings.decode_index_line(F_col("l")).alias("d")).collect()
    assert tuple(line[0].d) == (12, 3, False, 7, "a:b") and line[1].d is None


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


CATALOG = Catalog((Attribute("thing", 10, "Size", ("SZ",), is_primary_key=True, is_required=True),), (Area("a.com"), Area("s.com", "slave"), Area("0.0.0.0/0")))


@pytest.mark.parametrize(("line", "code"), [("", 338), ("x.com", 340), ("0.0.0.0/0", 340), ("s.com", 333), ("a.com class=no", 341), ("a.com class=thing attr=no", 320), ("a.com 123", 338), ("a.com attr=Size", 338)])
def test_exports_that_are_refused(line, code):
    with pytest.raises(QueryError) as e:
        export.plan_export(line.split(), CATALOG)
    assert e.value.code == code


def test_exports_planned():
    assert export.plan_export("A.com class=Thing attr=sz 20200101000000000".split(), CATALOG) == ("a.com", {"thing": [10]}, "20200101000000000")
    assert export.plan_export(["a.com"], CATALOG) == ("a.com", None, None)


def test_replicas(spark):
    m = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1"), ("d", None)], "auth_area string, serial string")
    r = spark.createDataFrame([("a", "1"), ("b", "1")], "auth_area string, serial string")
    assert {x.auth_area for x in export.stale(m, r).collect()} == {"a", "c"}
    timers = spark.createDataFrame([("a", 0, 10, 5, False), ("b", 0, 10, 5, True), ("c", None, 10, 5, False)], "auth_area string, refreshed_us bigint, refresh int, retry int, failed boolean")
    assert {x.auth_area for x in export.due(timers, 7_000_000).collect()} == {"b", "c"}


def test_registration(spark):
    now = spark.createDataFrame([("1", "20200101000000000"), ("2", "20200101000000000")], "rid string, updated string")
    asked = spark.createDataFrame([("1", " 20200101000000000"), ("2", "20190101000000000"), ("3", "20200101000000000")], "rid string, updated string")
    assert {r.rid: r.code for r in register.modified(now, asked).collect()} == {"1": 0, "2": 325, "3": 336}
    row = lambda *x: spark.createDataFrame([*x], "rid string, updated string")
    after = register.committed(now, row(("9", "n")), row(("1", "m")), row(("2", "x")))
    assert {tuple(r) for r in after.collect()} == {("9", "n"), ("1", "m")}
    from pyspark.sql import functions as F

    one = spark.range(1).select(register.next_serial(F.lit("20191231235959999")).alias("n"), register.guardian_scheme(F.lit("PassWd")).alias("s"), register.guarded_secret(F.lit("Crypt-PW"), F.lit("secret")).alias("h"), register.guarded_secret(F.lit("pw"), F.lit("secret")).alias("p")).first()
    assert (one.n, one.s, one.p) == ("20191231235960000", "pw", "secret") and one.h.startswith("2bb80d53")
    people = spark.createDataFrame([("r", [(0, 7, "Name", "Ann")]), ("s", [(0, 7, "Name", "")])], f"rid string, av {AV}")
    others = spark.createDataFrame([("r", [(0, 7, "Name", "ANN")]), ("s", [(0, 7, "Name", "")])], f"rid string, av {AV}")
    assert [r.rid for r in register.same_attribute(people, others, 7).collect()] == ["r"]
    stamped = register.stamped(now, F.lit(0)).first()
    assert stamped.updated == "19700101000000000"
    ids = register.new_identifiers(now.withColumn("no", F.lit(5)), F.lit("a.com"), "no").first()
    assert ids.id == "5.a.com"


def test_schema_rules():
    a = Attribute("thing", 10, "Size", ("SZ",), is_primary_key=True, is_required=True)
    faults = lambda **k: validate.attribute_faults(Attribute(**({"class_name": "thing", "attr_id": 11, "name": "New"} | k)), CATALOG)
    assert faults() == [] and faults(name="1x") == ["name"] and faults(name="sz") == ["taken"] and faults(is_primary_key=True) == ["key not required"]
    assert faults(is_repeatable=True, is_multi_line=True) == ["repeatable and multi-line"] and faults(attr_id=10) == ["id"]
    bigger = CATALOG.with_attribute(Attribute("thing", CATALOG.next_attr_id(), "New", ("Size",)))
    assert bigger is CATALOG and len(CATALOG.with_attribute(Attribute("thing", 11, "New")).attributes) == 2
    assert CATALOG.with_area(Area("A.com")) is CATALOG and CATALOG.with_area(Area("A.com", "slave")).find_area("a.com") and CATALOG.without_area("A.COM").find_area("a.com") is None
    assert CATALOG.by_id("thing", 10) == a and CATALOG.is_base("ttl") and CATALOG.without_class("thing").classes == ()


def shouted(pairs):
    """A class's program: refuses records without Name, else shouts."""
    return [(a, v.upper()) for a, v in pairs] + [("New", "1")] if any(a == "Name" for a, _ in pairs) else None


def test_record_upkeep(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("r", "a", [(0, 7, "Name", "ann"), (3, 8, "Mail", "x")]), ("s", "a", [(0, 8, "Mail", "y")]), ("t", "b", [(0, 8, "Mail", "z")]), ("u", None, None)], f"rid string, class_name string, av {AV}")
    more = {r.rid: r.av for r in df.select("rid", binding.with_value(F.col("av"), 9, "Type", F.lit("I")).alias("av")).collect()}
    assert [tuple(x) for x in more["r"]][-1] == (4, 9, "Type", "I") and len(more["s"]) == 2 and more["u"] is None
    assert len(df.select(binding.with_value(F.col("av"), 9, "Type", F.lit("")).alias("av")).first().av) == 2
    assert [x.attr for x in df.select(binding.without_attribute(F.col("av"), 8).alias("av")).first().av] == ["Name"]
    got = {r.rid: r.av and [(x.attr_id, x.attr, x.value) for x in r.av] for r in register.parsed_by(df, {"a": shouted}).collect()}
    assert got == {"r": [(7, "Name", "ANN"), (8, "Mail", "X"), (None, "New", "1")], "t": [(8, "Mail", "z")], "u": None}
    adds = spark.createDataFrame([("1.a", "20200101000000000")], "id string, updated string")
    assert [r.line for r in register.result_lines(adds).collect()] == ["ID:1.a", "Updated:20200101000000000"]


def test_forms(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a-b", "h.x", "4321", "20200229010203004", "a/b"), ("-a", "-h", "0", "20210229010203004", "../b"), (None, None, None, None, None), ("", "", "70000", "2020", "a/../b")], "n string, h string, p string, s string, f string")
    got = df.select(validate.is_name(F.col("n")), validate.is_host_name(F.col("h")), validate.is_port(F.col("p")), validate.is_serial(F.col("s")), validate.is_path(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(True,) * 5] + [(False,) * 5] * 3
    referrals = spark.createDataFrame([("1", "a.com", "referral", [(0, 42, "R", "x.a.com"), (1, 42, "R", "b.com")]), ("2", "10.0.0.0/8", "referral", [(0, 42, "R", "10.1.0.0/16"), (1, 42, "R", "11.0.0.0/8")]), ("3", "a.com", "host", [(0, 42, "R", "b.com")])], f"rid string, auth_area string, class_name string, av {AV}")
    assert {tuple(r) for r in validate.referral_faults(referrals).collect()} == {("1", "b.com"), ("2", "11.0.0.0/8")}


def test_command_line(spark, sf, tmp_path, capsys):
    from dirloom.__main__ import main

    assert main(["search", sf, "contact Last-Name=no-such"]) == 0 and main(["search", sf, "-soa soldor.example.org"]) == 0
    out = capsys.readouterr().out
    assert "%error 230 No Objects Found" in out and "soldor.example.org:authority:soldor.example.org" in out
    assert main(["index", sf, f"{tmp_path}/i", "--kinds", "EXACT", "--files", "2"]) == 0 and spark.read.parquet(f"{tmp_path}/i").count() > 0
    assert main(["query", sf, "status_objects"]) == 0
