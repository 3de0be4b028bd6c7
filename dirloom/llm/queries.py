"""Queries over the operators for training data, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from .copies import copies, copy_pairs
from .packing import packed
from .passages import contained
from .prose import not_prose, statistics, text_types

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each further copy in ``records`` beside the first of its copies."""
    return copy_pairs(table(spark, sf_dir, "records"), table(spark, sf_dir, "attr_defs"))


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``records`` with the class of its copies and their number."""
    return copies(table(spark, sf_dir, "records"), table(spark, sf_dir, "attr_defs"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` assigned to containers of each capacity in ``containers``."""
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain 12 consecutive words of an item, with the item."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not natural prose."""
    return not_prose(table(spark, sf_dir, "documents"))


def p9_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the share of its characters in prose, lists, tables and junk, and its type."""
    types = text_types(table(spark, sf_dir, "documents"))
    return types.select("doc_id", "chars", *[types[t].cast("decimal(6,4)").alias(t) for t in ("prose", "list", "table", "junk")], "type")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of words, symbols, line ends and common words of every document."""
    return statistics(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"p5_found": p5_found, "p5_copies": p5_copies, "p7_packed": p7_packed, "p8_found": p8_found, "p9_found": p9_found, "p9_types": p9_types, "p9_statistics": p9_statistics}
_BARE = r"regexp_replace(lower(v.value), '[^\p{L}\p{M}\p{Nd}]', '', 'g')"
_KEYS = f"SELECT row_id, class_name, list_sort(list(k)) AS ks FROM (SELECT r.row_id, r.class_name, v.attr_id || ' ' || {_BARE} AS k FROM (SELECT row_id, class_name, unnest(av) AS v FROM records) r JOIN attr_defs d ON d.class_name = r.class_name AND d.attr_id = r.v.attr_id AND d.is_primary_key WHERE r.v.value IS NOT NULL) GROUP BY ALL"
_RUNS = r"SELECT DISTINCT {0}, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {0}, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {1}))"

#: Equivalents for DuckDB, where SQL can say them and ends in time.
ORACLES: dict[str, str] = {
    "p5_found": f"SELECT a AS row_id_a, row_id AS row_id_b FROM (SELECT row_id, min(row_id) OVER (PARTITION BY class_name, ks) AS a FROM ({_KEYS})) WHERE a <> row_id",
    "p8_found": f"SELECT DISTINCT d.doc_id, i.item_id FROM ({_RUNS.format('doc_id', 'documents')}) d JOIN ({_RUNS.format('item_id', 'eval_items')}) i ON i.run = d.run",
}
