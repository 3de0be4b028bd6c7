"""What the plans look like: pushed filters, pruned columns, no needless exchanges, no Python where none is meant; and what imports what."""

import re
from pathlib import Path

import dirloom
from dirloom import catalog as cat
from dirloom.plans import catalogue
from dirloom.query import lang
from dirloom.query.search import search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_is_one_narrow_scan(spark, sf):
    catalog = cat.load(spark, sf)
    hits = search(spark.read.parquet(f"{sf}/records.parquet"), catalog, lang.parse("contact Last-Name=quor* AND Type=i OR First-Name=nov*", catalog))
    text = plan(hits.frame.select("row_id", "key"))
    assert "Exchange" not in text and "Python" not in text and text.count("FileScan") == 1
    assert re.search(r"PushedFilters: \[[^\]]*class_name", text) and "received_at" not in text
    assert "TakeOrdered" in plan(hits.first(20))


def test_export_filters_are_pushed(spark, sf):
    text = plan(catalogue.QUERIES["xfer_incremental"](spark, sf))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(updated", text) and "Exchange" not in text


def test_no_cartesian_products(spark, sf):
    for name in ("cidr_containment_join", "cidr_longest_match", "domain_in_area", "domain_longest_suffix", "network_in_area", "p1_found", "p2_found", "p3_found"):
        text = plan(catalogue.QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_python_runs_only_where_it_must(spark, sf):
    without = set(catalogue.QUERIES) - {"p3_found", "p3_live_records", "p6_found", "p6_one_table", "phonetic_term", "phonetic_keys", "postings_phonetic", "register_replay", "p4_found", "p4_contacts"}
    for name in sorted(without):
        text = plan(catalogue.QUERIES[name](spark, sf))
        assert not re.search("ArrowEvalPython|MapInArrow|MapInPandas|FlatMapGroups|BatchEvalPython", text), name


def test_nothing_else_imports_the_subpackage_for_training_data():
    root = Path(dirloom.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f
