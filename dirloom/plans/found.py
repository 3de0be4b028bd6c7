"""The registered queries: each runs an operator over the whole tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import live
from ..operators.rows import rejected
from ..operators.timestamps import normalise
from ..operators.versions import changes
from ..operators.wide import lost
from ..runtime import table
from . import oracle as o


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``records`` whose stamp names a moment but is not yet exactly a 17-digit serial."""
    records = table(spark, sf_dir, "records").select("row_id", "auth_area", "updated", "received_at")
    # rows that are serials already still are evidence of nothing: they name no local time
    loose = records.where(~F.col("updated").rlike(r"\A[0-9]{17}\z"))
    return normalise(loose, table(spark, sf_dir, "auth_areas")).where("updated_utc IS NOT NULL").select("row_id", "updated_utc")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``raw_rows`` that cannot be loaded, with the reason."""
    return rejected(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "auth_areas"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records live after all changes of ``spool``."""
    return live(table(spark, sf_dir, "spool"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the wide tables of ``av_pairs`` that are lost in typing."""
    return lost(table(spark, sf_dir, "av_pairs"), table(spark, sf_dir, "attr_defs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of attributes between the versions of each db_dir."""
    return changes(table(spark, sf_dir, "class_files"), table(spark, sf_dir, "file_pairs"))


_FIELD = "('(\"(?:[^\"]|\"\")*\"|[^\"' || s || ']*)')"
_BROKEN = f"NOT regexp_matches(r, '(?s)^' || {_FIELD} || '(?:[' || s || ']' || {_FIELD} || ')*$')"
_FIVE = f"('(?s)^' || {_FIELD} || '[' || s || ']' || {_FIELD} || '[' || s || ']' || {_FIELD} || '[' || s || ']' || {_FIELD} || '[' || s || ']' || {_FIELD} || '$')"


def _cell(i: int) -> str:
    raw = f"regexp_extract(r, {_FIVE}, {i})"
    return f"CASE WHEN starts_with({raw}, '\"') THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {o.trim(raw)} END"


_P2 = f"""WITH t AS (SELECT line_id, regexp_replace(coalesce(raw, ''), '\\r$', '') AS r, coalesce(sep, ',') AS s FROM raw_rows),
f AS (SELECT line_id, {_BROKEN} AS broken, regexp_matches(r, {_FIVE}) AS five, {_cell(1)} AS id, {_cell(4)} AS attr FROM t),
x AS (SELECT line_id, CASE WHEN broken THEN 'quoting' WHEN NOT five THEN 'columns' WHEN NOT (regexp_full_match(id, '(?s)[A-Za-z0-9_-]+\\..*') AND lower(regexp_replace(id, '^[^.]*\\.', '')) IN (SELECT lower(auth_area) FROM auth_areas)) THEN 'id' WHEN NOT regexp_full_match(attr, '[A-Za-z][A-Za-z0-9-]*') THEN 'attr_name' END AS reason FROM f)
SELECT line_id, reason FROM x WHERE reason IS NOT NULL"""

_CONVERTS = "CASE kind WHEN 'integer' THEN regexp_full_match(v, '[+-]?[0-9]+') WHEN 'boolean' THEN upper(v) IN ('TRUE', 'YES', 'ON', 'FALSE', 'NO', 'OFF') WHEN 'date' THEN regexp_full_match(v, '[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}') AND NOT starts_with(v, '0000') AND try_strptime(regexp_replace(v, '[-/]', '', 'g'), '%Y%m%d') IS NOT NULL ELSE true END"
_P4 = f"""WITH {o.BIND}, k AS (SELECT DISTINCT lower(class_name) AS class, attr_id, attr_name, value_kind AS kind FROM attr_defs),
c AS (SELECT b.rid, k.attr_name, b.value AS v, k.kind FROM bound b JOIN k ON k.class = b.class_name AND k.attr_id = b.attr_id WHERE k.kind <> 'text')
SELECT rid, attr_name FROM (SELECT rid, attr_name, {_CONVERTS} AS ok FROM c) GROUP BY ALL HAVING NOT bool_or(ok)"""

_HAS = "count(*) FILTER (WHERE v IS NOT NULL AND regexp_full_match(v, '{}'))"
_KIND = "CASE WHEN count(v) = 0 THEN NULL " + " ".join(f"WHEN {_HAS.format(p)} * 10 >= count(v) * 9 THEN '{k}'" for k, p in (("integer", "[+-]?[0-9]+"), ("date", "[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("boolean", "(?i)TRUE|YES|ON|FALSE|NO|OFF"))) + " ELSE 'text' END"
_P6 = f"""WITH f AS (SELECT file_no, db_dir, rpad({o.trim("class_version")}, 17, '0') AS ver FROM class_files WHERE db_dir IS NOT NULL AND class_version IS NOT NULL),
steps AS (SELECT * FROM (SELECT db_dir, ver AS prev, lead(ver) OVER (PARTITION BY db_dir ORDER BY ver) AS next FROM (SELECT DISTINCT db_dir, ver FROM f)) WHERE next IS NOT NULL),
said AS (SELECT f.db_dir, f.ver, p.rid, lower({o.trim("p.attr_name")}) AS name, nullif({o.trim("p.value")}, '') AS v FROM file_pairs p JOIN f ON f.file_no = p.file_no WHERE p.attr_name IS NOT NULL),
attrs AS (SELECT db_dir, ver, name, {_KIND} AS kind FROM said GROUP BY ALL),
gone AS (SELECT s.*, a.name FROM steps s JOIN attrs a ON a.db_dir = s.db_dir AND a.ver = s.prev WHERE NOT EXISTS (SELECT 1 FROM attrs b WHERE b.db_dir = s.db_dir AND b.ver = s.next AND b.name = a.name)),
came AS (SELECT s.*, a.name FROM steps s JOIN attrs a ON a.db_dir = s.db_dir AND a.ver = s.next WHERE NOT EXISTS (SELECT 1 FROM attrs b WHERE b.db_dir = s.db_dir AND b.ver = s.prev AND b.name = a.name)),
held AS (SELECT db_dir, ver, rid, name, list_sort(list_distinct(list(v))) AS vs FROM said WHERE v IS NOT NULL AND rid IS NOT NULL GROUP BY ALL),
before AS (SELECT g.db_dir, g.next, h.rid, g.name AS old, h.vs FROM gone g JOIN held h ON h.db_dir = g.db_dir AND h.ver = g.prev AND h.name = g.name WHERE EXISTS (SELECT 1 FROM said r WHERE r.db_dir = g.db_dir AND r.ver = g.next AND r.rid = h.rid)),
total AS (SELECT db_dir, next, old, count(*) AS n FROM before GROUP BY ALL),
same AS (SELECT b.db_dir, b.next, b.old, c.name AS new, count(*) AS k FROM before b JOIN came c ON c.db_dir = b.db_dir AND c.next = b.next JOIN held h ON h.db_dir = b.db_dir AND h.ver = b.next AND h.rid = b.rid AND h.name = c.name AND h.vs = b.vs GROUP BY ALL),
renamed AS (SELECT s.db_dir, s.next, s.old, s.new FROM same s JOIN total t ON t.db_dir = s.db_dir AND t.next = s.next AND t.old = s.old WHERE k * 5 >= n * 4)
SELECT db_dir, next AS class_version, 'renamed' AS change_kind, old AS old_name, new AS new_name FROM renamed
UNION ALL SELECT db_dir, next, 'removed', name, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.db_dir = g.db_dir AND r.next = g.next AND r.old = g.name)
UNION ALL SELECT db_dir, next, 'added', '', name FROM came g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.db_dir = g.db_dir AND r.next = g.next AND r.new = g.name)
UNION ALL SELECT s.db_dir, s.next, 'retyped', a.name, a.name FROM steps s JOIN attrs a ON a.db_dir = s.db_dir AND a.ver = s.prev JOIN attrs b ON b.db_dir = s.db_dir AND b.ver = s.next AND b.name = a.name WHERE a.kind IS NOT NULL AND b.kind IS NOT NULL AND a.kind <> b.kind"""

_P3 = f"WITH {o.CHANGES}, e AS (SELECT key, max(rn) AS ended FROM once WHERE op = 'del' GROUP BY key), s AS (SELECT o.* FROM once o LEFT JOIN e ON e.key = o.key WHERE o.rn > coalesce(e.ended, 0)), b AS (SELECT key, min(rn) AS begun FROM s WHERE op = 'add' GROUP BY key) SELECT s.key AS rid, arg_max(s.change_no, s.rn) AS change_no FROM s JOIN b ON b.key = s.key WHERE s.rn = b.begun OR (s.op = 'mod' AND s.rn > b.begun) GROUP BY s.key"

ORACLES = {"p2_found": _P2, "p3_found": _P3, "p4_found": _P4, "p6_found": _P6}
