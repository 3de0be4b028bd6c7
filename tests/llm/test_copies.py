"""Copies against a plain grouping, and the filters by themselves."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dirloom.llm import copies as c


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_p5_found(spark, sf):
    import __spark_entry__

    sf, groups = sf.replace("0.001", "0.01"), defaultdict(list)
    pk = {(r.class_name, r.attr_id) for r in rows(spark, sf, "attr_defs") if r.is_primary_key}
    for r in rows(spark, sf, "records"):
        key = sorted((x.attr_id, "".join(ch for ch in x.value.lower() if ch.isalnum())) for x in r.av if (r.class_name, x.attr_id) in pk and x.value is not None)
        groups[r.class_name, tuple(key)].append(r.row_id)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    got = [tuple(r) for r in __spark_entry__.queries()["p5_found"](spark, sf).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_values_are_compared_per_attribute(spark):
    defs = spark.createDataFrame([("c", 1, True), ("c", 2, True), ("c", 3, False)], "class_name string, attr_id int, is_primary_key boolean")
    av = [[(1, "A-b"), (2, "é")], [(2, "É!"), (1, "ab"), (3, "x")], [(1, "é"), (2, "ab")], [(1, "ab"), (2, "e")], [(1, "ab")], [(1, "ab"), (1, "ab"), (2, "é")]]
    df = spark.createDataFrame([(i, "c", x) for i, x in enumerate(av)], "row_id bigint, class_name string, av array<struct<attr_id int, value string>>")
    assert [tuple(r) for r in c.copy_pairs(df, defs).collect()] == [(0, 1)]


def test_edge_cases(spark):
    """Null classes, values and arrays, no primary key, empty and very long values, clashing columns, an empty table."""
    defs = spark.createDataFrame([("c", 1, True)], "class_name string, attr_id int, is_primary_key boolean")
    av = [None, [], [(1, None)], [(2, "x")], [(1, "")], [(1, "--")], [(1, "y" * 200_000)], [(1, "Y" * 200_000 + "!")]]
    data = [(i, "c", x, "k", True) for i, x in enumerate(av)] + [(8, None, [(1, "y")], "k", True), (9, "d", [(1, "y")], "k", True)]
    df = spark.createDataFrame(data, "row_id bigint, class_name string, av array<struct<attr_id int, value string>>, key string, maybe boolean")
    assert {tuple(r) for r in c.copies(df, defs).collect()} == {(i, i, 1) for i in (0, 1, 2, 3, 8, 9)} | {(4, 4, 2), (5, 4, 2), (6, 6, 2), (7, 6, 2)}
    assert c.copies(df.limit(0), defs).collect() == []


@pytest.mark.parametrize("most", [1 << 28, 1 << 17])
def test_a_hot_group_and_shards(spark, monkeypatch, most):
    """A third of all rows in one group; with a small ceiling the filter falls into shards."""
    monkeypatch.setattr(c, "MOST_BITS", most)
    n = 60_000
    df = spark.range(0, n, 1, 8).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, (F.col("id") % 1000).cast("string")).otherwise(F.concat(F.lit("u"), F.col("id"))).alias("key"))
    got = {r.row_id: (r.class_id, r.copies) for r in c.collapse(df, n).collect()}
    key = {i: "hot" if i % 3 == 0 else str(i % 1000) if i % 10 == 1 else f"u{i}" for i in range(n)}
    size, first = Counter(key.values()), {}
    for i in range(n):
        first.setdefault(key[i], i)
    assert got == {i: (first[key[i]], size[key[i]]) for i in range(n)}
    if most > n * c.BITS_PER_RECORD:
        marked = c.possible_repeats(df, n)
        singles = {i for i in range(n) if size[key[i]] == 1}
        kept = [r.row_id for r in marked.where("maybe").select("row_id").collect()]
        assert len(set(kept) & singles) < 0.02 * len(singles)
        assert len(kept) >= n - len(singles)
