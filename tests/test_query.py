"""The query language and its execution on hand-made records."""

import pytest

from dirloom.catalog import Area, Attribute, Catalog
from dirloom.query import lang
from dirloom.query.search import search

CATALOG = Catalog(
    (
        Attribute("contact", 7, "Name", ("N",), "EXACT"), Attribute("contact", 9, "Type", (), "NONE"), Attribute("contact", 15, "Organization", (), "EXACT", "ID"), Attribute("contact", 20, "Nick", (), "SOUNDEX"),
        Attribute("network", 38, "IP-Network", (), "CIDR"), Attribute("network", 7, "Name", (), "EXACT"), Attribute("referral", 7, "Name", (), "EXACT"),
    ),
    (Area("a.com"),),
    {"person": "contact"},
)
AV = "array<struct<pos:int,attr_id:int,attr:string,value:string>>"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "a.com", "contact", [(0, 7, "Name", " Smith, John"), (1, 9, "Type", "I"), (2, 20, "Nick", "Knight")]),
        (2, "a.com", "contact", [(0, 7, "Name", "SMITH, Jane"), (1, 9, "Type", "R"), (2, 15, "Organization", "o.1")]),
        (3, "b.com", "network", [(0, 38, "IP-Network", "10.0.0.0/8"), (1, 7, "Name", "smithnet")]),
        (4, "b.com", "network", [(0, 38, "IP-Network", "10.1.0.0/16"), (1, 38, "IP-Network", "fd00::/32")]),
        (5, "a.com", "referral", [(0, 7, "Name", "smith")]),
        (6, "a.com", "contact", None), (7, None, None, [(0, 7, "Name", "smith")]), (8, "a.com", "contact", [(0, 7, "Name", None), (1, 7, "Name", "")]),
    ]
    return spark.createDataFrame(rows, f"row_id bigint, auth_area string, class_name string, av {AV}").selectExpr("*", "'own' AS key2")


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('contact Name="smith, john"', [1]), ("contact Name=smith*", [1, 2]), ("smith*", [1, 2, 3]), ("referral smith", [5]), ("person N=smith*", [1, 2]),
        ('contact Name=smith* AND Type="r"', [2]), ('Type="r"', []), ("Name=*jane", [2]), ("Name=smithnet OR Name=*john", [1, 3]), ('Name=smith* AND Type="i" OR Name=smithnet', [1, 3]),
        ("contact o.1", []), ("contact Organization=o.1", [2]), ("10.1.2.3", [4, 3]), ("network IP-Network=10.0.0.0/12", [3]), ("fd00::1", [4]), ("Nick=night", [1]), ("nite", []), ("knight", [1]), ("Name=nothing", []), ("contact Nick=Knight1", []),
    ],
)
def test_search(records, line, want):
    query = lang.parse(line, CATALOG)
    lang.check(query, substring=True)
    hits = search(records, CATALOG, query)
    assert [r.row_id for r in hits.first(0).collect()] == want or sorted(r.row_id for r in hits.first(0).collect()) == sorted(want)
    assert hits.status(0).first().code == (0 if want else 230)
    assert "key2" in hits.frame.columns


def test_networks_come_most_specific_first(records):
    hits = search(records, CATALOG, lang.parse("10.1.2.3", CATALOG))
    assert [r.row_id for r in hits.first(0).collect()] == [4, 3]
    assert [r.row_id for r in hits.first(1).collect()] == [4] and hits.status(1).first().code == 330


def test_area_and_empty(records):
    query = lang.parse("smith*", CATALOG)
    assert [r.row_id for r in search(records, CATALOG, query, "B.com").first(0).collect()] == [3]
    assert search(records.limit(0), CATALOG, query).first(0).collect() == []


@pytest.mark.parametrize("line", ["", "contact", "contact AND", "Name=", "Name=*", "*", "a AND", "OR a", "a b", "Name != ", "Name==a", "contact Type=Name"])
def test_no_queries(line):
    with pytest.raises(lang.QueryError) as e:
        lang.parse(line, CATALOG)
    assert e.value.code == 350


def test_parts():
    q = lang.parse('contact name="a b*" AND *c OR d', CATALOG)
    assert q.class_name == "contact"
    assert q.terms == ((lang.Term("A B", "NAME", lang.PREFIX), lang.Term("C", None, lang.SUBSTRING)), (lang.Term("D"),))
    assert lang.parse("name", CATALOG).terms == ((lang.Term("NAME"),),)
    assert [lang.status_of(x, CATALOG) for x in ("a", "a*", "*a", "Name != a")] == [0, 0, 351, 351]
    assert lang.status_of("a*", CATALOG, wildcard=False) == 351 and lang.status_of("*a*", CATALOG, substring=True) == 0
