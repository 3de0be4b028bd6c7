"""Postings: the index keys of all records, as a table sorted by key; manifests of files and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions.phonetic import phonetic_key
from ..query.search import exact_key
from ..runtime import bounded

COLUMNS = ("auth_area", "class_name", "index_kind", "key", "attr_id", "attr_type", "plen", "row_id")


def postings(records: DataFrame, defs: DataFrame, kinds: tuple[str, ...] = ("EXACT", "CIDR", "SOUNDEX")) -> DataFrame:
    """A row per index key: of every value whose attribute has an index of that kind, or ALL of them.

    Network keys are made of values that are networks only, phonetic ones of values with letters.
    ``plen`` is a network key's length. A value that occurs twice in a record is one posting; null
    and empty values have none. Kinds that are not asked for cost nothing.
    """
    indexed = defs.where("index_kind IN ('EXACT', 'CIDR', 'SOUNDEX', 'ALL')").select(F.col("class_name").alias("_class"), F.col("attr_id").alias("_id"), F.col("index_kind").alias("_kind"), "attr_type")
    cells = records.select("row_id", "auth_area", "class_name", F.explode("av").alias("x")).select("row_id", "auth_area", "class_name", F.col("x.attr_id").alias("attr_id"), exact_key(F.col("x.value")).alias("v")).where("v != ''")
    cells = cells.join(bounded(indexed, by=defs), (F.col("class_name") == F.col("_class")) & (F.col("attr_id") == F.col("_id")))
    parsed = net.parse(F.col("v"))
    keys = {"EXACT": F.col("v"), "CIDR": F.when(net.looks_like_network(F.col("v")) & parsed.isNotNull(), net.key(parsed)), "SOUNDEX": phonetic_key(F.col("v"))}
    made = []
    for kind in kinds:
        key = keys[kind]
        plen = F.when(F.lit(kind == "CIDR"), F.element_at(F.split(key, "/"), -1).cast("int"))
        made.append(cells.where(F.col("_kind").isin(kind, "ALL")).select("auth_area", "class_name", F.lit(kind).alias("index_kind"), key.alias("key"), "attr_id", "attr_type", plen.alias("plen"), "row_id"))
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out.where("key IS NOT NULL").distinct()


def write_sorted(found: DataFrame, path: str, files: int | None = None) -> None:
    """Postings as files that each hold a range of keys in order, so that a lookup reads a few row groups."""
    spread = found.repartitionByRange(files, "index_kind", "key", "attr_id") if files else found.repartitionByRange("index_kind", "key", "attr_id")
    spread.sortWithinPartitions("index_kind", "key", "attr_id").write.partitionBy("index_kind").parquet(path)


def fetch(found: DataFrame, records: DataFrame) -> DataFrame:
    """The records of postings: those are reduced to one row per record before the join."""
    wanted = found.groupBy("row_id").agg(F.min(F.struct("index_kind", "key", "attr_id")).alias("hit"))
    return records.join(wanted, "row_id")


def index_lines(found: DataFrame, records: DataFrame) -> DataFrame:
    """(index_kind, line): postings in the text form offset:file:deleted:attribute:key."""
    placed = found.join(records.select("row_id", "file_no", "rec_offset"), "row_id")
    return placed.select("index_kind", F.concat_ws(":", F.col("rec_offset").cast("string"), F.col("file_no").cast("string"), F.lit("0"), F.col("attr_id").cast("string"), "key").alias("line"))


def decode_index_line(line: Column) -> Column:
    """Struct (offset, file_no, deleted, attr_id, key) of an index line; the key may contain the separator."""
    p = F.split(line, ":", 5)
    return F.when(F.size(p) == 5, F.struct(p[0].try_cast("bigint").alias("offset"), p[1].try_cast("int").alias("file_no"), (p[2].try_cast("int") != 0).alias("deleted"), p[3].try_cast("int").alias("attr_id"), p[4].alias("key")))


def live(found: DataFrame) -> DataFrame:
    """Postings that are not marked as deleted."""
    return found.where(~F.coalesce("deleted", F.lit(False)))


def counts(found: DataFrame) -> DataFrame:
    """(class_name, index_kind, n): lines per index."""
    return found.groupBy("class_name", "index_kind").agg(F.count("*").alias("n"))


# manifests: (name, type, file_no, size, num_recs, locked)


def files_of(manifest: DataFrame, kind: str | None = None) -> DataFrame:
    """Unlocked files of a kind: DATA, an index kind, or INDEX for any of those."""
    of = F.lit(True) if kind is None else F.col("type") != "DATA" if kind == "INDEX" else F.col("type") == kind
    return manifest.where(~F.coalesce("locked", F.lit(False)) & of)


def add_files(manifest: DataFrame, new: DataFrame, locked: bool = False) -> DataFrame:
    """With more files, numbered on from the highest number in the order of their names; names that are there already are not added."""
    from pyspark.sql import Window

    fresh = new.join(manifest.select("name"), "name", "leftanti")
    top = manifest.agg(F.coalesce(F.max("file_no"), F.lit(0)).alias("top"))
    # a commit adds few files; its list fits one task by nature
    numbered = fresh.withColumn("file_no", (F.row_number().over(Window.orderBy("name")) + top.scalar()).cast("int")).withColumn("locked", F.lit(locked))
    return manifest.unionByName(numbered.select(*manifest.columns))


def delete_files(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the files of these names."""
    return manifest.join(gone.select("name"), "name", "leftanti")


def modify_files(manifest: DataFrame, changed: DataFrame) -> DataFrame:
    """With size and record count of these files replaced."""
    new = changed.select("name", F.col("size").alias("_size"), F.col("num_recs").alias("_n"), F.lit(True).alias("_has"))
    joined = manifest.join(new, "name", "left")
    return joined.select(*[F.when(F.col("_has"), F.col(n)).otherwise(F.col(c)).alias(c) if n else F.col(c) for c, n in ((c, {"size": "_size", "num_recs": "_n"}.get(c)) for c in manifest.columns)])


def lock_files(manifest: DataFrame, which: DataFrame, locked: bool = True) -> DataFrame:
    """With these files locked or unlocked."""
    marked = which.select("name", F.lit(True).alias("_m"))
    joined = manifest.join(marked, "name", "left")
    return joined.select(*[F.when(F.col("_m"), F.lit(locked)).otherwise(F.col("locked")).alias("locked") if c == "locked" else F.col(c) for c in manifest.columns])


def repack(manifest: DataFrame, most_bytes: int | None = None, holding: str = "") -> DataFrame:
    """(type, files, num_recs): index files to be merged into one per kind: kinds of which at least two are small enough and have ``holding`` in their name."""
    chosen = files_of(manifest, "INDEX").where(F.contains("name", F.lit(holding)))
    if most_bytes is not None:
        chosen = chosen.where(F.col("size") <= most_bytes)
    return chosen.groupBy("type").agg(F.count("*").alias("files"), F.sum("num_recs").alias("num_recs")).where("files >= 2")


def object_counts(files: DataFrame) -> DataFrame:
    """(auth_area, objects): records in the data files of each area; a null count is none."""
    return files.groupBy("auth_area").agg(F.coalesce(F.sum("num_recs"), F.lit(0)).cast("bigint").alias("objects"))
