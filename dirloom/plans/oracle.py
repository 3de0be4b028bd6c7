"""Pieces of SQL that the queries' equivalents for DuckDB share."""

from __future__ import annotations

LOW, UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space as the text helpers see it, and the six ASCII kinds of it.
BLANK, SPACE = r"[\t\n\x0B\f\r\x{85}\p{Z}]", r"[ \t\n\x0B\f\r]"


def upper(x: str) -> str:
    return f"translate({x}, '{LOW}', '{UP}')"


def trim(x: str, blank: str = BLANK) -> str:
    return f"regexp_replace({x}, '^{blank}+|{blank}+$', '', 'g')"


def key(x: str) -> str:
    """A value as the exact index has it."""
    control = f"regexp_replace({x}, '[\\x00-\\x08\\x0A-\\x1F\\x7F]', '', 'g')"
    return upper(trim(control, SPACE))


CELLS = "SELECT row_id, auth_area, class_name, x.pos AS pos, x.attr_id AS attr_id, x.attr AS attr, x.value AS value FROM (SELECT row_id, auth_area, class_name, unnest(av) AS x FROM records)"


def search(*terms: tuple[str, str], where: str = "true") -> str:
    """CTEs up to ``hits``: (row_id, auth_area, class_name, term_no, key) of records that meet one of the terms.

    A term is the condition on a cell ``c`` with definition ``d`` and key ``c.k``, and one on further cells of row ``c.row_id``.
    """
    parts = [f"SELECT c.row_id, {i} AS term_no, c.k AS key, c.attr_id FROM c JOIN attr_defs d ON d.class_name = c.class_name AND d.attr_id = c.attr_id WHERE d.index_kind IN ('EXACT', 'ALL') AND ({where}) AND ({first}) AND ({rest})" for i, (first, rest) in enumerate(terms)]
    return f"""c AS (SELECT *, {key("value")} AS k, {upper("value")} AS u FROM ({CELLS})),
found AS ({" UNION ALL ".join(parts)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY term_no, key, attr_id) AS n FROM found),
hits AS (SELECT r.row_id, s.auth_area, s.class_name, CAST(r.term_no AS INTEGER) AS term_no, r.key FROM ranked r JOIN records s ON s.row_id = r.row_id WHERE n = 1)"""


def hex_of(address: str) -> str:
    """Hexadecimal digits of an address without length, null if it is none."""
    octets = f"string_split({address}, '.')"
    four = f"CASE WHEN regexp_full_match({address}, '[0-9]{{1,9}}(\\.[0-9]{{1,9}}){{3}}') AND len(list_filter({octets}, lambda p: CAST(p AS INTEGER) > 255)) = 0 THEN array_to_string(list_transform({octets}, lambda p: lpad(lower(to_hex(CAST(p AS INTEGER))), 2, '0')), '') END"
    g = "[0-9a-f]{1,4}"
    low = f"lower({address})"
    left = f"list_filter(string_split(split_part({low}, '::', 1), ':'), lambda p: p <> '')"
    right = f"list_filter(string_split(split_part({low}, '::', 2), ':'), lambda p: p <> '')"
    gap = f"(8 - len({left}) - len({right}))"
    shape = f"(regexp_full_match({low}, '{g}(:{g}){{7}}') OR (regexp_full_match({low}, '({g}(:{g})*)?::({g}(:{g})*)?') AND {gap} > 0))"
    six = f"CASE WHEN {shape} THEN array_to_string(list_transform(list_concat(list_concat({left}, list_resize(CAST([] AS VARCHAR[]), greatest({gap}, 0), '0')), {right}), lambda p: lpad(p, 4, '0')), '') END"
    return f"coalesce({four}, {six})"


def masked(h: str, n: str) -> str:
    """The digits with all bits from ``n`` on cleared."""
    digit = f"substr({h}, CAST(({n}) // 4 + 1 AS BIGINT), 1)"
    part = f"CASE ({n}) % 4 WHEN 1 THEN translate({digit}, '0123456789abcdef', '0000000088888888') WHEN 2 THEN translate({digit}, '0123456789abcdef', '000044448888cccc') WHEN 3 THEN translate({digit}, '0123456789abcdef', '0022446688aaccee') ELSE '' END"
    return f"rpad(substr({h}, 1, CAST(({n}) // 4 AS BIGINT)) || {part}, CAST(length({h}) AS INTEGER), '0')"


def networks(source: str, value: str, keep: str) -> str:
    """A query for (keep, value, h, n) of the values of ``source`` that are networks."""
    gate = f"regexp_matches({value}, '^[a-fA-F0-9]+([.:][a-fA-F0-9]*)*(/[0-9]+)?$')"
    split = f"SELECT {keep}, {value} AS value, CASE WHEN contains({value}, '/') THEN regexp_replace({value}, '/[^/]*$', '') ELSE {value} END AS address, CASE WHEN contains({value}, '/') THEN try_cast(split_part({value}, '/', -1) AS INTEGER) END AS said FROM ({source}) WHERE {gate}"
    parsed = f"SELECT {keep}, value, said, {hex_of('address')} AS raw FROM ({split})"
    sized = f"SELECT {keep}, value, raw, coalesce(said, length(raw) * 4) AS n FROM ({parsed}) WHERE raw IS NOT NULL"
    return f"SELECT {keep}, value, {masked('raw', 'n')} AS h, CAST(n AS INTEGER) AS n FROM ({sized}) WHERE n <= length(raw) * 4"


def canonical(h: str, n: str) -> str:
    four = f"array_to_string(list_transform(range(4), lambda i: lpad(CAST(CAST('0x' || substr({h}, i * 2 + 1, 2) AS INTEGER) AS VARCHAR), 3, '0')), '.')"
    six = f"array_to_string(list_transform(range(8), lambda i: substr({h}, i * 4 + 1, 4)), ':')"
    return f"(CASE WHEN length({h}) = 8 THEN {four} ELSE {six} END || '/' || {n})"


#: CTEs up to ``bound``: (rid, auth_area, class_name, pos, attr_id, attr, value) of av_pairs bound to the schema.
BIND = f"""nm AS (SELECT DISTINCT lower(d.class_name) AS class, d.attr_id, d.attr_name, lower({trim("u.n")}) AS name FROM attr_defs d, (SELECT class_name AS cn, attr_id AS ai, unnest(list_concat([attr_name], coalesce(aliases, []))) AS n FROM attr_defs) u WHERE u.cn = d.class_name AND u.ai = d.attr_id),
said AS (SELECT DISTINCT rid, CAST(pos AS INTEGER) AS pos, lower({trim("attr_name")}) AS name, {trim("value")} AS v FROM av_pairs WHERE rid IS NOT NULL AND {trim("value")} <> ''),
cls AS (SELECT rid, lower(v) AS class FROM (SELECT rid, v, row_number() OVER (PARTITION BY rid ORDER BY pos NULLS FIRST, v) AS k FROM said WHERE name IN ('class-name', 'cn', 'schema-name', 'object-type')) WHERE k = 1),
ar AS (SELECT rid, v AS area FROM (SELECT rid, v, row_number() OVER (PARTITION BY rid ORDER BY pos NULLS FIRST, v) AS k FROM said WHERE name IN ('auth-area', 'aa')) WHERE k = 1),
heads AS (SELECT c.rid, c.class, a.area FROM cls c LEFT JOIN ar a ON a.rid = c.rid WHERE c.class IN (SELECT class FROM nm)),
bound AS (SELECT DISTINCT h.rid, h.area AS auth_area, h.class AS class_name, s.pos, n.attr_id, n.attr_name AS attr, s.v AS value FROM said s JOIN heads h ON h.rid = s.rid JOIN nm n ON n.class = h.class AND n.name = s.name)"""

#: CTEs up to ``once``: (change_no, moment, spool_seq, op, key, rn), each usable change of the spool once, numbered per key in order.
CHANGES = f"""said AS (SELECT spool_id, change_no, spool_seq, lower({trim("action")}) AS op, lower({trim("rid")}) AS key, upper({trim("updated")}) AS t FROM spool),
timed AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]{{17}}') THEN epoch_us(try_strptime(substr(t, 1, 14), '%Y%m%d%H%M%S')) + CAST(substr(t, 15, 3) AS BIGINT) * 1000 WHEN regexp_full_match(t, '[0-9]+') THEN try_cast(t AS BIGINT) * 1000 WHEN regexp_matches(t, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN epoch_us(try_cast(t AS TIMESTAMPTZ)) END AS moment FROM said WHERE op IN ('add', 'mod', 'del') AND key <> '' AND t <> ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY change_no ORDER BY spool_id) AS k FROM timed WHERE moment IS NOT NULL),
once AS (SELECT change_no, moment, spool_seq, op, key, row_number() OVER (PARTITION BY key ORDER BY moment, spool_seq NULLS FIRST, change_no) AS rn FROM numbered WHERE k = 1)"""
