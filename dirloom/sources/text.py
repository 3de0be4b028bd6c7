"""Record files and other line formats read as frames.

Files are read whole per record block through the text source's own record separator, so one file
may be as large as it likes: Spark splits it between separators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.norm import strip_control, trim_left, trim_right

#: Fixed: the line that parts records, or begins a new one in a change.
SEPARATOR, NEW = "---", "_NEW_"


def clean_line(c: Column) -> Column:
    """A line without control characters and outer white space."""
    return trim_right(trim_left(strip_control(c)))


def is_separator(c: Column) -> Column:
    """Whether a line parts two records: it begins with three dashes, or is the mark of a new record in any case."""
    return c.startswith(SEPARATOR) | (F.upper(c) == NEW)


def tag_and_value(line: Column) -> Column:
    """Struct (tag, value) of a line at its first colon, both trimmed; null for comments and lines without colon."""
    at = F.position(F.lit(":"), line)
    sound = ~line.startswith("#") & (at > 1)
    return F.when(sound, F.struct(clean_line(F.substr(line, F.lit(1), at - 1)).alias("tag"), clean_line(F.substr(line, at + 1)).alias("value")))


def three_parts(line: Column) -> Column:
    """Struct (first, second, value) of ``a:b:value``; null unless there are three, the first two not empty."""
    p = F.split(line, ":", 3)
    return F.when((F.size(p) == 3) & (clean_line(p[0]) != "") & (clean_line(p[1]) != ""), F.struct(clean_line(p[0]).alias("first"), clean_line(p[1]).alias("second"), clean_line(p[2]).alias("value")))


def files(spark: SparkSession, base: str, names: Sequence[str] | None = None, suffix: str | None = None) -> DataFrame:
    """Blocks of text between separator lines, from the named files of a folder or from all whose names end in a suffix, with the file of each."""
    reader = spark.read.option("lineSep", f"\n{SEPARATOR}")
    if suffix is not None:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    paths = [f"{base.rstrip('/')}/{n}" for n in names] if names is not None else [base]
    return reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("block"))


def record_blocks(spark: SparkSession, base: str, names: Sequence[str] | None = None, suffix: str | None = None) -> DataFrame:
    """(file, av): untyped records of record files."""
    blocks = files(spark, base, names, suffix)
    # the first block of a file has no rest of a separator before it
    fresh = blocks.withColumn("block", F.concat(F.lit("\n"), F.col("block")))
    lines = F.transform(F.split("block", "\n"), clean_line)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    first = F.transform(F.filter(body, lambda x: (x != "") & ~x.startswith("_") & ~is_separator(x)), tag_and_value)
    pairs = F.filter(first, lambda p: p.isNotNull() & (p["tag"] != ""))
    av = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["tag"].alias("name"), p["value"].alias("value")))
    return fresh.select("file", av.alias("av")).where(F.size("av") > 0)


def pairs_of(records: DataFrame, key: str) -> DataFrame:
    """(key, pos, attr_name, value): a row per value of untyped records, as ``operators.binding.bind`` reads them."""
    return records.select(key, F.explode("av").alias("x")).select(key, F.col("x.pos").alias("pos"), F.col("x.name").alias("attr_name"), F.col("x.value").alias("value"))


def payload_pairs(changes: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, av): the tag and value lines of change payloads; of a mod what stands before the mark of a new record is the old one and is left out."""
    lines = F.transform(F.split(payload, "\n"), clean_line)
    mark = F.array_position(F.transform(lines, lambda x: is_separator(x).cast("int")), F.lit(1))
    new = F.slice(lines, (mark + 1).cast("int"), F.greatest(F.size(lines) - mark.cast("int"), F.lit(0)))
    pairs = F.filter(F.transform(new, tag_and_value), lambda p: p.isNotNull())
    return changes.select(key, F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["tag"].alias("name"), p["value"].alias("value"))).alias("av"))


def read_response(lines: DataFrame, tag: str, order: str = "n", line: str = "line") -> DataFrame:
    """(order, data): what a master's answer says under a tag, up to the bare tag, ``%ok`` or ``%error``; the answer of one area is one group of ordered lines."""
    end = F.min(F.when((F.col(line) == f"%{tag}") | (F.col(line) == "%ok") | F.col(line).startswith("%error"), F.col(order)))
    stop = lines.agg(end.alias("e"))
    body = lines.where(F.col(line).startswith(f"%{tag} "))
    return body.where(F.coalesce(F.col(order) < stop.scalar(), F.lit(True))).select(order, F.substr(line, F.lit(len(tag) + 3)).alias("data"))
