"""Queries over the engine's own operators, with their equivalents for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as cat
from .. import session as ses
from ..functions import net, norm, shapes
from ..functions.phonetic import phonetic_key
from ..operators import access, binding, changes, export, postings, register, routing, rows, validate, versions, wide
from ..query import lang, search
from ..runtime import table
from . import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ALIASES = {"person": "contact"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is any."""

    def register_(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register_


def _hits(spark: SparkSession, d: str, line: str, substring: bool = False, area: str | None = None) -> search.Hits:
    catalog = cat.from_tables(None, table(spark, d, "attr_defs"), ALIASES)
    parsed = lang.parse(line, catalog)
    lang.check(parsed, substring=substring)
    return search.search(table(spark, d, "records"), catalog, parsed, area)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("row_id", "auth_area", "class_name", "term_no", "key")


HIT = "SELECT row_id, auth_area, class_name, term_no, key FROM hits"
NAMED = "d.attr_name = '{}' AND d.class_name = '{}'"
NETWORK_NAME, LAST_NAME, AS_NAME = NAMED.format("Network-Name", "network"), NAMED.format("Last-Name", "contact"), NAMED.format("AS-Name", "asn")


def _some(cell: str) -> str:
    return f"EXISTS (SELECT 1 FROM c e WHERE e.row_id = c.row_id AND {cell})"


# ---- search


@query(f"WITH {o.search((NETWORK_NAME + " AND c.k = 'LOMSUNDE-NET-73'", 'true'))} {HIT}")
def exact_term(spark: SparkSession, d: str) -> DataFrame:
    """network Network-Name=lomsunde-net-73"""
    return _shown(_hits(spark, d, "network Network-Name=lomsunde-net-73").first(0))


@query(f"WITH {o.search((LAST_NAME + " AND starts_with(c.k, 'QUOR')", 'true'))} {HIT}")
def prefix_term(spark: SparkSession, d: str) -> DataFrame:
    """contact Last-Name=quor*"""
    return _shown(_hits(spark, d, "contact Last-Name=quor*").first(0))


@query(f"WITH {o.search((AS_NAME + " AND contains(c.k, 'SUND')", 'true'))} {HIT}")
def substring_term(spark: SparkSession, d: str) -> DataFrame:
    """asn AS-Name=*sund, substrings being allowed"""
    return _shown(_hits(spark, d, "asn AS-Name=*sund", substring=True).first(0))


@query(f"WITH {o.search(("d.attr_type <> 'ID' AND c.class_name <> 'referral' AND starts_with(c.k, 'KEL-0')", 'true'), ("d.attr_type <> 'ID' AND c.class_name <> 'referral' AND starts_with(c.k, 'LOMSUNDE-NET')", 'true'))} {HIT}")
def any_attr_term(spark: SparkSession, d: str) -> DataFrame:
    """kel-0* OR lomsunde-net*, in every class and every index"""
    return _shown(_hits(spark, d, "kel-0* OR lomsunde-net*").first(0))


@query(f"WITH {o.search((LAST_NAME + " AND starts_with(c.k, 'QUOR')", _some("e.attr_id = 9 AND e.u = 'I'")))} {HIT}")
def and_residual(spark: SparkSession, d: str) -> DataFrame:
    """contact Last-Name=quor* AND Type=i: the second attribute has no index"""
    return _shown(_hits(spark, d, "contact Last-Name=quor* AND Type=i").first(0))


@query(f"WITH {o.search((LAST_NAME + " AND starts_with(c.k, 'QUOR')", 'true'), (NAMED.format('First-Name', 'contact') + " AND starts_with(c.k, 'NOV')", 'true'))} {HIT}")
def or_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """contact Last-Name=quor* OR First-Name=nov*: a record that meets both counts once"""
    return _shown(_hits(spark, d, "contact Last-Name=quor* OR First-Name=nov*").first(0))


@query(f"WITH {o.search((LAST_NAME + " AND starts_with(c.k, 'QUOR')", _some("e.attr_id = 9 AND e.u = 'R'")), (NAMED.format('First-Name', 'contact') + " AND starts_with(c.k, 'NOV')", _some("e.attr_id = 18 AND starts_with(e.u, 'HOSTMASTER')")))} {HIT}")
def dnf_mixed(spark: SparkSession, d: str) -> DataFrame:
    """contact Last-Name=quor* AND Type=\"r\" OR First-Name=nov* AND Updated-By=hostmaster*"""
    return _shown(_hits(spark, d, "contact Last-Name=quor* AND Type=\"r\" OR First-Name=nov* AND Updated-By=hostmaster*").first(0))


@query(f"WITH {o.search((LAST_NAME + " AND starts_with(c.k, 'SOL')", 'true'))} {HIT}")
def class_alias(spark: SparkSession, d: str) -> DataFrame:
    """person LN=sol*: class and attribute by their aliases"""
    return _shown(_hits(spark, d, "person LN=sol*").first(0))


@query(f"WITH {o.search(("d.attr_type <> 'ID' AND c.class_name <> 'referral' AND starts_with(c.k, 'ULNIX-')", 'true'))} {HIT}")
def classless_skips_referral(spark: SparkSession, d: str) -> DataFrame:
    """ulnix-*: without a class every class but referral is searched"""
    return _shown(_hits(spark, d, "ulnix-*").first(0))


@query(f"WITH {o.search(("d.attr_name = 'Organization' AND c.class_name = 'contact' AND starts_with(c.k, '1')", 'true'))} {HIT}")
def id_type_veto(spark: SparkSession, d: str) -> DataFrame:
    """contact 1* would meet references too; they have no index and count only when named, so that nothing is found through them"""
    hits = _hits(spark, d, "contact Organization=1*").first(0)
    return _shown(hits)


@query(f"WITH {o.search((LAST_NAME + " AND starts_with(c.k, 'SOL')", 'true'))} {HIT} ORDER BY auth_area, class_name, term_no, key, row_id LIMIT 20")
def hit_limit_first_n(spark: SparkSession, d: str) -> DataFrame:
    """contact Last-Name=sol*, the first 20 hits"""
    return _shown(_hits(spark, d, "contact Last-Name=sol*").first(search.DEFAULT_LIMIT))


def _status_sql(line: str, cond: str) -> str:
    return f"WITH {o.search((cond, 'true'))} SELECT '{line}' AS line, CAST(CASE WHEN count(*) = 0 THEN 230 WHEN count(*) > 20 THEN 330 ELSE 0 END AS INTEGER) AS code FROM hits"


STATUS_LINES = {"contact Last-Name=sol*": LAST_NAME + " AND starts_with(c.k, 'SOL')", "contact Last-Name=no-such-name": LAST_NAME + " AND c.k = 'NO-SUCH-NAME'", "network Network-Name=lomsunde-net-73": NETWORK_NAME + " AND c.k = 'LOMSUNDE-NET-73'"}


@query(" UNION ALL ".join(f"SELECT * FROM ({_status_sql(line, cond)})" for line, cond in STATUS_LINES.items()))
def limit_status(spark: SparkSession, d: str) -> DataFrame:
    """The code each of some queries ends with under the default limit"""
    parts = [_hits(spark, d, line).status(search.DEFAULT_LIMIT).select(F.lit(line).alias("line"), "code") for line in STATUS_LINES]
    return parts[0].union(parts[1]).union(parts[2])


GATE = {"contact Last-Name=quor*": 0, "contact Last-Name=*quor": 351, "contact Last-Name!=quor": 350, "contact Last-Name != quor": 351, "contact": 350, "contact Last-Name=*": 350, "Last-Name=quor AND": 350, '"street of x" OR quor': 0, "Last-Name != x": 351, "quor": 0, "Last-Name": 0, "a = b": 350}


@query(" UNION ALL ".join(f"SELECT '{line}' AS line, CAST({code} AS INTEGER) AS code" for line, code in GATE.items()))
def complexity_gate(spark: SparkSession, d: str) -> DataFrame:
    """The code each of some lines meets before anything is searched"""
    catalog = cat.load(spark, d)
    return spark.createDataFrame([(line, lang.status_of(line, catalog)) for line in GATE], "line string, code int")


@query()
def phonetic_term(spark: SparkSession, d: str) -> DataFrame:
    """organization Org-Name="wexbrook is zimsund": by sound"""
    return _shown(_hits(spark, d, 'organization Org-Name="wexbrukis zimsund"*').first(0))


@query()
def phonetic_keys(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, key): organizations' names by sound"""
    cells = table(spark, d, "records").where("class_name = 'organization'").select("row_id", binding.value_of(F.col("av"), 31).alias("v"))
    return cells.select("row_id", phonetic_key(F.col("v")).alias("key")).where("key IS NOT NULL")


# ---- postings

POSTED = f"WITH c AS (SELECT *, {o.key('value')} AS k FROM ({o.CELLS})), p AS (SELECT DISTINCT c.auth_area, c.class_name, c.k AS key, CAST(c.attr_id AS INTEGER) AS attr_id, c.row_id FROM c JOIN attr_defs d ON d.class_name = c.class_name AND d.attr_id = c.attr_id WHERE d.index_kind IN ('EXACT', 'ALL') AND c.k <> '')"


def _posted(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return postings.postings(table(spark, d, "records"), table(spark, d, "attr_defs"), kinds)


@query(f"{POSTED} SELECT auth_area, class_name, key, attr_id, row_id FROM p")
def postings_exact(spark: SparkSession, d: str) -> DataFrame:
    """The exact index of all records"""
    return _posted(spark, d, "EXACT").select("auth_area", "class_name", "key", "attr_id", "row_id")


@query(f"{POSTED} SELECT class_name, 'EXACT' AS index_kind, count(*) AS n FROM p GROUP BY class_name")
def postings_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the exact index per class"""
    return postings.counts(_posted(spark, d, "EXACT"))


@query()
def postings_phonetic(spark: SparkSession, d: str) -> DataFrame:
    """The phonetic index of all records"""
    return _posted(spark, d, "SOUNDEX").select("class_name", "key", "attr_id", "row_id")


NET_CELLS = f"SELECT row_id, class_name, attr_id, k FROM (SELECT *, {o.key('value')} AS k FROM ({o.CELLS})) q JOIN (SELECT class_name AS dc, attr_id AS di FROM attr_defs WHERE index_kind IN ('CIDR', 'ALL')) dd ON dc = class_name AND di = attr_id"


@query(f"SELECT DISTINCT row_id, CAST(attr_id AS INTEGER) AS attr_id, h || '/' || n AS key, n AS plen FROM ({o.networks(NET_CELLS, 'k', 'row_id, attr_id')})")
def postings_network(spark: SparkSession, d: str) -> DataFrame:
    """The network index of all records"""
    return _posted(spark, d, "CIDR").select("row_id", "attr_id", "key", "plen")


@query(f"{POSTED}, w AS (SELECT DISTINCT row_id FROM p WHERE starts_with(key, 'KELTA')) SELECT r.row_id, r.rid, r.class_name FROM records r JOIN w ON w.row_id = r.row_id")
def posting_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Records whose exact index has a key that begins with KELTA, fetched through the postings"""
    found = _posted(spark, d, "EXACT").where(F.col("key").startswith("KELTA"))
    return postings.fetch(found, table(spark, d, "records")).select("row_id", "rid", "class_name")


@query(f"{POSTED} SELECT 'EXACT' AS index_kind, r.rec_offset || ':' || r.file_no || ':0:' || p.attr_id || ':' || p.key AS line FROM p JOIN records r ON r.row_id = p.row_id")
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    """The exact index in its text form"""
    return postings.index_lines(_posted(spark, d, "EXACT"), table(spark, d, "records"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "class_files")
    return files.select(F.concat_ws("/", "db_dir", F.col("file_no").cast("string")).alias("name"), F.when(F.col("file_no") % 3 == 0, "DATA").otherwise("EXACT").alias("type"), F.col("file_no").cast("int").alias("file_no"), (F.coalesce("num_recs", F.lit(0)) * 100).cast("bigint").alias("size"), F.coalesce(F.col("num_recs"), F.lit(0)).cast("bigint").alias("num_recs"), (F.col("file_no") % 7 == 0).alias("locked"))


MANIFEST = "m AS (SELECT db_dir || '/' || file_no AS name, CASE WHEN file_no % 3 = 0 THEN 'DATA' ELSE 'EXACT' END AS type, CAST(file_no AS INTEGER) AS file_no, CAST(coalesce(num_recs, 0) * 100 AS BIGINT) AS size, CAST(coalesce(num_recs, 0) AS BIGINT) AS num_recs, file_no % 7 = 0 AS locked FROM class_files)"


@query(f"WITH {MANIFEST} SELECT type, count(*) AS files, CAST(sum(num_recs) AS BIGINT) AS num_recs FROM m WHERE NOT locked AND type <> 'DATA' AND size <= 3000 GROUP BY type HAVING count(*) >= 2")
def repack_counts(spark: SparkSession, d: str) -> DataFrame:
    """Small index files that would be merged, and their lines"""
    return postings.repack(_manifest(spark, d), 3000)


@query(f"WITH {MANIFEST} SELECT name, type, file_no, size, num_recs, CASE WHEN file_no % 5 = 0 THEN true ELSE locked END AS locked FROM m WHERE file_no % 11 <> 0")
def manifest_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """A manifest after some of its files were deleted and others locked"""
    m = _manifest(spark, d)
    left = postings.delete_files(m, m.where("file_no % 11 = 0"))
    return postings.lock_files(left, m.where("file_no % 5 = 0"))


@query("SELECT auth_area, CAST(coalesce(sum(num_recs), 0) AS BIGINT) AS objects FROM class_files GROUP BY auth_area")
def manifest_objects(spark: SparkSession, d: str) -> DataFrame:
    """Records in the data files of each area, by the manifest"""
    return postings.object_counts(table(spark, d, "class_files"))


# ---- networks and routing


def _cells(spark: SparkSession, d: str, *ids: int) -> DataFrame:
    cells = table(spark, d, "records").select("row_id", F.explode("av").alias("x")).where(F.col("x.attr_id").isin(*ids))
    return cells.select("row_id", F.col("x.pos").alias("pos"), search.exact_key(F.col("x.value")).alias("k")).where("k IS NOT NULL")


def _cells_sql(*ids: int) -> str:
    return f"SELECT row_id, pos, {o.key('value')} AS k FROM ({o.CELLS}) WHERE attr_id IN ({', '.join(map(str, ids))}) AND value IS NOT NULL"


@query(f"SELECT row_id, pos, {o.canonical('h', 'n')} AS network FROM ({o.networks(_cells_sql(26, 38), 'k', 'row_id, pos')})")
def network_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical text of every address and network"""
    parsed = _cells(spark, d, 26, 38).where(net.looks_like_network("k")).select("row_id", "pos", net.parse("k").alias("n")).where("n IS NOT NULL")
    return parsed.select("row_id", "pos", net.canonical(F.col("n")).alias("network"))


CLASSFUL = "CASE WHEN length(h) <> 8 THEN -1 ELSE CASE WHEN CAST('0x' || substr(h, 1, 2) AS INTEGER) < 128 THEN CASE WHEN substr(h, 3) = '000000' THEN 8 ELSE 32 END WHEN CAST('0x' || substr(h, 1, 2) AS INTEGER) < 192 THEN CASE WHEN substr(h, 5) = '0000' THEN 16 ELSE 32 END WHEN CAST('0x' || substr(h, 1, 2) AS INTEGER) < 224 THEN CASE WHEN substr(h, 7) = '00' THEN 24 ELSE 32 END ELSE 32 END END"
OCTETS = "CASE WHEN length(h) <> 8 THEN -1 WHEN h = '00000000' THEN 0 WHEN substr(h, 3) = '000000' THEN 8 WHEN substr(h, 5) = '0000' THEN 16 WHEN substr(h, 7) = '00' THEN 24 ELSE 32 END"


@query(f"SELECT row_id, pos, CAST({CLASSFUL} AS INTEGER) AS classful, CAST({OCTETS} AS INTEGER) AS octets, CASE WHEN n > 0 THEN {o.canonical(o.masked('h', 'n - 1'), '(n - 1)')} END AS wider, regexp_matches(k, '^[0-9]+.[0-9]+.[0-9]+.[0-9]/[0-9]+') AS strict FROM (SELECT row_id, pos, value AS k, h, n FROM ({o.networks(_cells_sql(26, 38), 'k', 'row_id, pos')}))")
def network_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Guessed lengths of every network, the network one bit wider, and the strict form"""
    parsed = _cells(spark, d, 26, 38).where(net.looks_like_network("k")).withColumn("n", net.parse("k")).where("n IS NOT NULL")
    n = F.col("n")
    return parsed.select("row_id", "pos", net.classful_length(n).alias("classful"), net.octet_length(n).alias("octets"), net.canonical(net.shortened(n)).alias("wider"), net.is_strict_cidr("k").alias("strict"))


HOSTS, NETS = o.networks(_cells_sql(26), "k", "row_id, pos"), o.networks(_cells_sql(38), "k", "row_id")
STORED = o.networks(f"SELECT k FROM ({_cells_sql(38)}) UNION SELECT auth_area FROM auth_areas", "k", "k")
COVERS = f"SELECT DISTINCT v.row_id || '.' || v.pos AS id, p.value AS network, p.n AS plen FROM ({o.networks(_cells_sql(26, 38), 'k', 'row_id, pos')}) v JOIN ({STORED}) p ON length(p.h) = length(v.h) AND p.n <= v.n AND {o.masked('v.h', 'p.n')} = p.h"


def _hosts(spark: SparkSession, d: str, *ids: int) -> DataFrame:
    return _cells(spark, d, *(ids or (26,))).select(F.concat_ws(".", F.col("row_id").cast("string"), F.col("pos").cast("string")).alias("id"), "k")


@query(COVERS)
def cidr_containment_join(spark: SparkSession, d: str) -> DataFrame:
    """Every stored network or area that contains an address of a host or a network"""
    stored = _cells(spark, d, 38).select("k").union(table(spark, d, "auth_areas").select("auth_area"))
    return routing.network_matches(_hosts(spark, d, 26, 38), stored, "k", "k", "id")


AREA_NETS = o.networks("SELECT auth_area FROM auth_areas WHERE auth_area IS NOT NULL", "auth_area", "auth_area")


@query(f"SELECT id, network, plen FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY plen DESC, network) AS k FROM (SELECT DISTINCT v.row_id || '.' || v.pos AS id, p.value AS network, p.n AS plen FROM ({HOSTS}) v JOIN ({AREA_NETS}) p ON length(p.h) = length(v.h) AND p.n <= v.n AND {o.masked('v.h', 'p.n')} = p.h)) WHERE k = 1")
def cidr_longest_match(spark: SparkSession, d: str) -> DataFrame:
    """The most specific area that holds each address of a host"""
    return routing.longest_network(_hosts(spark, d), table(spark, d, "auth_areas"), "k", "auth_area", "id")


@query(f"SELECT row_id, value AS network, n AS plen FROM ({NETS}) WHERE length(h) = 32 AND h || '/' || n IN (SELECT {o.masked('x.h', 'g.g')} || '/' || g.g FROM (SELECT 'fd0048b0700e30020000000000000000' AS h) x, range(0, 65) AS g(g))")
def cidr_cover(spark: SparkSession, d: str) -> DataFrame:
    """Stored networks that contain or equal fd00:48b0:700e:3002::/64"""
    asked = spark.range(1).select(F.lit("fd00:48b0:700e:3002::/64").alias("q"))
    found = routing.network_matches(asked, _cells(spark, d, 38), "q", "k", "q").select("network", "plen")
    return _cells(spark, d, 38).select("row_id", F.col("k").alias("network")).join(F.broadcast(found), "network").select("row_id", "network", "plen")


@query(f"SELECT v.row_id, a.value AS auth_area FROM ({o.networks(_cells_sql(26, 38), 'k', 'row_id')}) v JOIN ({AREA_NETS}) a ON length(a.h) = length(v.h) AND {o.masked('v.h', 'least(a.n, length(v.h) * 4)')} = a.h GROUP BY ALL")
def network_in_area(spark: SparkSession, d: str) -> DataFrame:
    """Areas that hold the start of each address and network"""
    nets = _cells(spark, d, 26, 38).where(net.looks_like_network("k")).select("row_id", net.parse("k").alias("n")).where("n IS NOT NULL")
    # a network counts by its address: it is asked for as if it were that address alone
    asked = nets.select("row_id", F.struct(F.col("n.af").alias("af"), F.col("n.hex").alias("hex"), (F.length("n.hex") * 4).alias("len")).alias("n")).select("row_id", net.canonical(F.col("n")).alias("v"))
    areas = table(spark, d, "auth_areas").select("auth_area")
    return routing.network_matches(asked, areas, "v", "auth_area", "row_id").select("row_id", F.col("network").alias("auth_area")).distinct()


DOMAIN_SHAPE = "regexp_matches({0}, '^(([.]?[a-zA-Z0-9-]+)+|.+([.][a-zA-Z0-9-]+)*[.][a-zA-Z]+)$|^[.]$')"
NET_SHAPE = "regexp_matches({0}, '^[a-fA-F0-9]+([.:][a-fA-F0-9]*)*(/[0-9]+)?$')"
MAIL_SHAPE = "regexp_matches({0}, '^(.+@[a-zA-Z0-9-]+([.][a-zA-Z0-9-]+)*[.][a-zA-Z]+)$')"


def _domains(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, 19, 25).select(F.concat_ws(".", F.col("row_id").cast("string"), F.col("pos").cast("string")).alias("id"), "k").where("k != ''")


DOMAINS = f"SELECT row_id || '.' || pos AS id, k FROM ({_cells_sql(19, 25)}) WHERE k <> ''"


@query(f"SELECT DISTINCT v.id, a.auth_area FROM ({DOMAINS}) v JOIN auth_areas a ON {DOMAIN_SHAPE.format('a.auth_area')} AND (ends_with(v.k, {o.upper('a.auth_area')}) OR a.auth_area = '.')")
def domain_in_area(spark: SparkSession, d: str) -> DataFrame:
    """Every area whose name a domain or host ends in"""
    values = _domains(spark, d).select("id", F.lit("domain").alias("kind"), F.col("k").alias("hvalue"))
    return routing.areas_holding(values, table(spark, d, "auth_areas"), "id")


@query(f"SELECT id, domain FROM (SELECT v.id, a.auth_area AS domain, row_number() OVER (PARTITION BY v.id ORDER BY length(a.auth_area) DESC, a.auth_area) AS n FROM (SELECT DISTINCT * FROM ({DOMAINS})) v JOIN auth_areas a ON {DOMAIN_SHAPE.format('a.auth_area')} AND NOT {NET_SHAPE.format('a.auth_area')} AND (v.k = {o.upper('a.auth_area')} OR ends_with(v.k, '.' || {o.upper('a.auth_area')}))) WHERE n = 1")
def domain_longest_suffix(spark: SparkSession, d: str) -> DataFrame:
    """The most specific area of whole labels for each domain or host"""
    return routing.longest_suffix(_domains(spark, d), table(spark, d, "auth_areas"), "k", "auth_area", "id")


TOP = "(upper(split_part(k, '.', -1)) IN ('EDU', 'GOV', 'COM', 'NET', 'ORG', 'MIL', 'INT') OR length(split_part(k, '.', -1)) = 2)"


@query(f"SELECT row_id || '.' || pos AS id, 'domain' AS kind, split_part(k, '@', -1) AS hvalue FROM ({_cells_sql(8)}) WHERE NOT {NET_SHAPE.format('k')} AND ({DOMAIN_SHAPE.format('k')} OR {MAIL_SHAPE.format('k')}) AND {TOP}")
def email_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """The domain each mail address stands for"""
    cells = _cells(spark, d, 8).select(F.concat_ws(".", F.col("row_id").cast("string"), F.col("pos").cast("string")).alias("id"), "k")
    return routing.hierarchical_values(cells, "k", "id")


def _bound(spark: SparkSession, d: str) -> DataFrame:
    return binding.bind(table(spark, d, "av_pairs"), table(spark, d, "attr_defs"))


REFERRED = f"SELECT q.rid || '.' || q.pos AS id, q.value AS referred, {o.trim('t.value')} AS target FROM (SELECT * FROM bound WHERE class_name = 'referral' AND attr_id = 42) q JOIN (SELECT * FROM bound WHERE class_name = 'referral' AND attr_id = 41) t ON t.rid = q.rid WHERE NOT {NET_SHAPE.format('q.value')} AND {DOMAIN_SHAPE.format('q.value')}"


@query(f"WITH {o.BIND}, f AS ({REFERRED}) SELECT DISTINCT v.id, a.auth_area, rtrim(t.target, '/') AS referral FROM f v JOIN auth_areas a ON {DOMAIN_SHAPE.format('a.auth_area')} AND ends_with({o.upper('v.referred')}, {o.upper('a.auth_area')}) JOIN f t ON {o.upper('t.referred')} = {o.upper('v.referred')}")
def down_referral(spark: SparkSession, d: str) -> DataFrame:
    """Where to ask for a host of each delegated domain: in the areas that hold it, by the most specific delegation"""
    named = _bound(spark, d).where("class_name = 'referral'").select("rid", F.explode(F.filter("av", lambda x: x["attr_id"] == 42)).alias("r"), binding.values_of(F.col("av"), 41).alias("t"))
    named = named.select(F.concat_ws(".", "rid", F.col("r.pos").cast("string")).alias("id"), F.col("r.value").alias("referred"), F.explode("t").alias("target")).where(shapes.is_domain_shape("referred") & ~net.looks_like_network("referred"))
    areas = table(spark, d, "auth_areas")
    delegated = named.select("id", F.lit("domain").alias("kind"), F.col("referred").alias("hvalue")).distinct()
    homes = routing.areas_holding(delegated, areas, "id").join(named, "id").select("auth_area", "referred", "target")
    values = named.select("id", F.lit("domain").alias("kind"), F.concat(F.lit("www."), "referred").alias("hvalue")).distinct()
    return routing.down_referrals(values, areas, homes, "id")


@query(f"SELECT v.id, 'ref://root.example.org:4321' AS referral FROM (SELECT DISTINCT id, k FROM ({DOMAINS})) v WHERE NOT EXISTS (SELECT 1 FROM auth_areas a WHERE {DOMAIN_SHAPE.format('a.auth_area')} AND (ends_with(v.k, {o.upper('a.auth_area')}) OR a.auth_area = '.'))")
def up_referral(spark: SparkSession, d: str) -> DataFrame:
    """Where to ask for domains that lie in no area"""
    values = _domains(spark, d).select("id", F.lit("domain").alias("kind"), F.col("k").alias("hvalue")).distinct()
    punts = spark.createDataFrame([("ref://root.example.org:4321/",)], "line string")
    return routing.up_referrals(values, table(spark, d, "auth_areas"), punts, "id")


# ---- records shown, guarded and checked


@query("SELECT row_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT row_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT row_id, list_append(list_transform(av, lambda x: class_name || ':' || x.attr || ':' || coalesce(x.value, '')), '') AS l FROM records))")
def av_explode(spark: SparkSession, d: str) -> DataFrame:
    """All records as the lines a client sees"""
    return binding.dump(table(spark, d, "records"), "row_id")


@query("SELECT row_id, array_to_string(list_transform(list_filter(av, lambda x: coalesce(x.value <> '', false)), lambda x: x.attr || ':' || x.value), chr(10)) || chr(10) || '---' || chr(10) AS text FROM records")
def record_text(spark: SparkSession, d: str) -> DataFrame:
    """All records as a record file has them"""
    return binding.record_text(table(spark, d, "records"), "row_id")


@query(f"WITH {o.BIND} SELECT rid, attr_id, attr, pos, value, class_name FROM bound")
def bound_records(spark: SparkSession, d: str) -> DataFrame:
    """Attribute rows bound to the schema"""
    cells = _bound(spark, d).select("rid", "class_name", F.explode("av").alias("x")).select("rid", F.col("x.attr_id").alias("attr_id"), F.col("x.attr").alias("attr"), F.col("x.pos").alias("pos"), F.col("x.value").alias("value"), "class_name")
    return cells.where("pos >= 0 OR pos IS NULL")


@query("SELECT row_id, CAST(attr_id AS INTEGER) AS attr_id, count(*) AS n FROM (SELECT row_id, unnest(av).attr_id AS attr_id FROM records) GROUP BY ALL")
def attribute_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """How often each record has each attribute"""
    return binding.multiplicity(table(spark, d, "records"), "row_id")


WHO = access.Credentials(True, "pw", "info-0")
GUARDIANS = f"""WITH {o.BIND}, v AS (SELECT rid, class_name, any_value(auth_area) AS auth_area FROM bound GROUP BY ALL),
g0 AS (SELECT b.rid, {o.upper("coalesce((SELECT value FROM bound i WHERE i.rid = b.rid AND i.attr_id = 1 ORDER BY pos NULLS FIRST, attr_id, attr, value LIMIT 1), b.rid)")} AS id FROM v b WHERE class_name = 'guardian'),
named AS (SELECT DISTINCT rid, {o.upper("value")} AS id FROM bound WHERE attr_id = 4)"""


@query(f"{GUARDIANS} SELECT v.rid, NOT (v.class_name = 'guardian' OR EXISTS (SELECT 1 FROM named n WHERE n.rid = v.rid)) AS permitted FROM v")
def guardian_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Which records a session without credentials may change"""
    return access.permissions(_bound(spark, d), table(spark, d, "attr_defs"), access.Credentials()).select("rid", "permitted")


@query()
def guardian_access(spark: SparkSession, d: str) -> DataFrame:
    """Which guarded records a session with some guardian's credentials may change"""
    records, defs = _bound(spark, d), table(spark, d, "attr_defs")
    return access.permissions(records, defs, WHO).select("rid", "class_name", "permitted")


@query(f"{GUARDIANS} SELECT DISTINCT b.rid, b.value AS guardian FROM bound b WHERE b.attr_id = 4 AND {o.upper('b.value')} NOT IN (SELECT id FROM g0)")
def stale_guardians(spark: SparkSession, d: str) -> DataFrame:
    """Guardians that are named but do not exist"""
    return access.stale_guardians(_bound(spark, d))


@query(f"""{GUARDIANS}, p AS (SELECT rid, arg_min({o.upper("value")}, pos) AS v FROM bound WHERE attr_id = 5 GROUP BY rid),
open AS (SELECT v.rid, v.class_name, NOT (v.class_name = 'guardian' OR EXISTS (SELECT 1 FROM named n WHERE n.rid = v.rid)) AS permitted FROM v)
SELECT DISTINCT b.rid, b.attr, b.value FROM bound b JOIN open q ON q.rid = b.rid LEFT JOIN p ON p.rid = b.rid WHERE (q.permitted OR NOT coalesce(p.v IN ('TRUE', 'YES', 'ON'), false)) AND (q.permitted OR b.attr NOT IN ('Guard-Info', 'Private'))""")
def dump_private_masked(spark: SparkSession, d: str) -> DataFrame:
    """What a session without credentials sees of all records"""
    defs = table(spark, d, "attr_defs")
    seen = access.visible(access.permissions(_bound(spark, d), defs, access.Credentials()), defs)
    cells = seen.select("rid", F.explode("av").alias("x")).where("x.pos >= 0 OR x.pos IS NULL")
    return cells.select("rid", F.col("x.attr").alias("attr"), F.col("x.value").alias("value")).distinct()


ALLOW, DENY = ("10.10.0.0/255.255.0.0, .example.org EXCEPT mx1.,.garsund.example.org",), ("10., [fd00::/16]",)


@query(f"SELECT row_id, pos, k AS address, {o.key('h')} AS host, (coalesce(k LIKE '10.10.%' AND regexp_full_match(k, '[0-9.]+'), false) OR coalesce(ends_with({o.key('h')}, '.EXAMPLE.ORG'), false)) AND NOT (coalesce(starts_with(k, 'mx1.'), false) OR coalesce(ends_with({o.key('h')}, '.GARSUND.EXAMPLE.ORG'), false)) OR NOT (starts_with(k, '10.') OR (starts_with(lower(k), 'fd00:') AND coalesce(p.h2, false))) AS allowed FROM (SELECT c.row_id, c.pos, c.k, (SELECT value FROM ({o.CELLS}) z WHERE z.row_id = c.row_id AND z.attr_id = 25 ORDER BY pos LIMIT 1) AS h FROM ({_cells_sql(26)}) c) q LEFT JOIN (SELECT row_id AS r2, pos AS p2, true AS h2 FROM ({HOSTS}) WHERE length(h) = 32) p ON p.r2 = q.row_id AND p.p2 = q.pos")
def host_acl(spark: SparkSession, d: str) -> DataFrame:
    """Which hosts two lists let in"""
    hosts = table(spark, d, "records").select("row_id", search.exact_key(binding.value_of(F.col("av"), 25)).alias("host"), F.explode(F.filter("av", lambda x: x["attr_id"] == 26)).alias("x"))
    hosts = hosts.select("row_id", F.col("x.pos").alias("pos"), search.exact_key(F.col("x.value")).alias("address"), "host").where("address IS NOT NULL")
    return access.allowed(hosts, ALLOW, DENY)


@query("SELECT r.row_id, d.attr_name FROM records r JOIN attr_defs d ON d.class_name = r.class_name AND d.is_required AND d.attr_id > 6 WHERE NOT list_contains(list_transform(list_filter(r.av, lambda x: coalesce(x.value <> '', false)), lambda x: x.attr_id), d.attr_id)")
def required_violations(spark: SparkSession, d: str) -> DataFrame:
    """Required attributes that records lack"""
    return validate.required_violations(table(spark, d, "records"), table(spark, d, "attr_defs"))


@query(f"SELECT c.row_id, d.attr_name, count(*) AS n FROM ({o.CELLS}) c JOIN attr_defs d ON d.class_name = c.class_name AND d.attr_id = c.attr_id AND NOT d.is_repeatable AND NOT d.is_multi_line GROUP BY ALL HAVING count(*) > 1")
def repeat_violations(spark: SparkSession, d: str) -> DataFrame:
    """Single-valued attributes that records have several times"""
    return validate.repeat_violations(table(spark, d, "records"), table(spark, d, "attr_defs"))


FORMATS = {("contact", 8): "^.+@.+$", ("organization", 36): "^[A-Z][A-Z]$", ("asn", 29): "^[0-9]+$", ("host", 25): "{(", ("network", 37): "^[A-Z0-9-]+$"}


@query(f"SELECT row_id, CAST(attr_id AS INTEGER) AS attr_id, value FROM ({o.CELLS}) WHERE value IS NOT NULL AND ((class_name = 'contact' AND attr_id = 8 AND NOT regexp_matches({o.upper('value')}, '^.+@.+$')) OR (class_name = 'organization' AND attr_id = 36 AND NOT regexp_matches({o.upper('value')}, '^[A-Z][A-Z]$')) OR (class_name = 'asn' AND attr_id = 29 AND NOT regexp_matches({o.upper('value')}, '^[0-9]+$')) OR (class_name = 'network' AND attr_id = 37 AND NOT regexp_matches({o.upper('value')}, '^[A-Z0-9-]+$')))")
def format_violations(spark: SparkSession, d: str) -> DataFrame:
    """Values that do not have their attribute's format"""
    return validate.format_violations(table(spark, d, "records"), FORMATS)


PK = f"SELECT auth_area, class_name, row_id, array_to_string(list_sort(list(k)), '|') AS pk FROM (SELECT c.auth_area, c.class_name, c.row_id, c.attr_id || '=' || {o.key('c.value')} AS k FROM ({o.CELLS}) c JOIN attr_defs d ON d.class_name = c.class_name AND d.attr_id = c.attr_id AND d.is_primary_key WHERE c.value <> '') GROUP BY ALL"


@query(f"SELECT auth_area, class_name, pk, count(*) AS n FROM ({PK}) GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Primary keys that several records of a class and area have"""
    return validate.key_duplicates(table(spark, d, "records"), table(spark, d, "attr_defs"))


@query(f"SELECT row_id, CAST(code AS INTEGER) AS code, attr_name FROM (SELECT row_id, 322 AS code, attr_name FROM ({ORACLES['required_violations']}) UNION ALL SELECT row_id, 320, attr_name FROM ({ORACLES['repeat_violations']}))")
def record_check(spark: SparkSession, d: str) -> DataFrame:
    """All that is wrong with each record"""
    return validate.record_check(table(spark, d, "records"), table(spark, d, "attr_defs"))


MAIL = "^[^@\\s]+@([A-Za-z0-9-]+\\.)+[A-Za-z]+$"


@query(f"SELECT auth_area, 'hostmaster' AS fault FROM auth_areas WHERE NOT coalesce(regexp_matches(hostmaster, '{MAIL}'), false) UNION ALL SELECT auth_area, 'serial' FROM auth_areas WHERE NOT coalesce(regexp_full_match(serial_no, '[0-9]{{17}}'), false) UNION ALL SELECT auth_area, k FROM (SELECT auth_area, unnest(['refresh', 'increment', 'retry', 'ttl']) AS k, unnest([refresh_interval, increment_interval, retry_interval, time_to_live]) AS v FROM auth_areas) WHERE coalesce(v <= 0, true) UNION ALL SELECT auth_area, 'primary' FROM auth_areas WHERE NOT coalesce(regexp_full_match(primary_server, '[A-Za-z0-9.-]+:[0-9]+'), false) UNION ALL SELECT auth_area, 'name' FROM auth_areas WHERE NOT (auth_area = '.' OR (regexp_full_match(auth_area, '([A-Za-z0-9-]+\\.)+[A-Za-z]+') AND (upper(split_part(auth_area, '.', -1)) IN ('EDU', 'GOV', 'COM', 'NET', 'ORG', 'INT') OR length(split_part(auth_area, '.', -1)) = 2)) OR regexp_full_match(auth_area, '[0-9a-fA-F.:]+/[0-9]+'))")
def soa_check(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with areas' start-of-authority data"""
    return validate.soa_faults(table(spark, d, "auth_areas"))


NAMES = "SELECT class_name, attr_name, unnest(list_concat([attr_name], coalesce(aliases, []))) AS n FROM attr_defs"


@query(f"SELECT DISTINCT class_name, attr_name, fault FROM (SELECT q.class_name, q.attr_name, 'taken' AS fault FROM ({NAMES}) q JOIN (SELECT class_name, upper(n) AS u FROM ({NAMES}) GROUP BY ALL HAVING count(*) > 1) t ON t.class_name = q.class_name AND t.u = upper(q.n) UNION ALL SELECT class_name, attr_name, 'key not required' FROM attr_defs WHERE is_primary_key AND NOT is_required UNION ALL SELECT class_name, attr_name, 'repeatable and multi-line' FROM attr_defs WHERE is_repeatable AND is_multi_line)")
def schema_check(spark: SparkSession, d: str) -> DataFrame:
    """What breaks the rules in the declared schema"""
    return validate.schema_faults(table(spark, d, "attr_defs"))


# ---- export, listings, counts


@query("SELECT row_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT row_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT row_id, list_transform(av, lambda x: class_name || ':' || x.attr || ':' || coalesce(x.value, '')) AS l FROM records))")
def xfer_full(spark: SparkSession, d: str) -> DataFrame:
    """All records of all areas, exported"""
    return export.exported(table(spark, d, "records"))


@query("SELECT row_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT row_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT row_id, list_transform(list_filter(av, lambda x: class_name = 'host' OR x.attr_id IN (7, 8)), lambda x: class_name || ':' || x.attr || ':' || coalesce(x.value, '')) AS l FROM records WHERE class_name IN ('contact', 'host')))")
def xfer_projected(spark: SparkSession, d: str) -> DataFrame:
    """Hosts, and names and addresses of contacts, exported"""
    return export.exported(table(spark, d, "records"), classes={"contact": [7, 8], "host": []})


@query("SELECT row_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT row_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT row_id, list_transform(av, lambda x: class_name || ':' || x.attr || ':' || coalesce(x.value, '')) AS l FROM records WHERE updated >= '20200101000000000'))")
def xfer_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Records changed since 2020, serials compared as text, exported"""
    return export.exported(table(spark, d, "records"), since="20200101000000000")


@query("SELECT auth_area, count(*) AS objects FROM records GROUP BY auth_area UNION ALL SELECT '*', count(*) FROM records")
def status_objects(spark: SparkSession, d: str) -> DataFrame:
    """Records per area and overall"""
    records = table(spark, d, "records")
    per = records.groupBy("auth_area").agg(F.count("*").alias("objects"))
    return per.union(per.agg(F.lit("*").alias("auth_area"), F.coalesce(F.sum("objects"), F.lit(0)).cast("bigint").alias("objects")))


@query("SELECT auth_area, class_name, max(rpad(trim(class_version), 17, '0')) AS version FROM class_files GROUP BY ALL")
def class_listing(spark: SparkSession, d: str) -> DataFrame:
    """Latest version of each class in each area"""
    return cat.class_listing(table(spark, d, "class_files"))


ON = "CASE WHEN {} THEN 'ON' ELSE 'OFF' END"


@query(f"SELECT class_name, attr_name, unnest(['attribute', 'format', 'description', 'indexed', 'required', 'multi-line', 'repeatable', 'hierarchical', 'private', 'type', 'primary']) AS property, unnest([attr_name, '', '', {ON.format("index_kind <> 'NONE'")}, {ON.format('is_required')}, {ON.format('is_multi_line')}, {ON.format('is_repeatable')}, {ON.format('is_hierarchical')}, {ON.format('is_private')}, CASE attr_type WHEN 'SEE-ALSO' THEN 'See-Also' WHEN 'ID' THEN 'ID' ELSE 'Text' END, {ON.format('is_primary_key')}]) AS value FROM attr_defs")
def schema_listing(spark: SparkSession, d: str) -> DataFrame:
    """Declared properties of all attributes"""
    return cat.schema_listing(table(spark, d, "attr_defs"))


@query("SELECT auth_area, unnest(['authority', 'ttl', 'serial', 'refresh', 'increment', 'retry', 'hostmaster', 'primary']) AS property, unnest([auth_area, CAST(time_to_live AS VARCHAR), serial_no, CAST(refresh_interval AS VARCHAR), CAST(increment_interval AS VARCHAR), CAST(retry_interval AS VARCHAR), hostmaster, primary_server]) AS value FROM auth_areas WHERE serial_no IS NOT NULL AND serial_no <> ''")
def soa_listing(spark: SparkSession, d: str) -> DataFrame:
    """Start-of-authority data of all areas"""
    return cat.soa_listing(table(spark, d, "auth_areas"))


@query("SELECT attr_name, array_to_string(list_sort(list_distinct(list(class_name))), ',') AS classes FROM attr_defs GROUP BY attr_name")
def attr_directory(spark: SparkSession, d: str) -> DataFrame:
    """All attributes with the classes that have them"""
    return cat.attribute_directory(table(spark, d, "attr_defs"))


@query("SELECT class_name, array_to_string(list_sort(list_distinct(list(auth_area))), ',') AS areas FROM records GROUP BY class_name")
def class_directory(spark: SparkSession, d: str) -> DataFrame:
    """All classes with the areas that have records of them"""
    return cat.class_directory(table(spark, d, "records"))


@query(f"SELECT class_name, CAST(attr_id AS INTEGER) AS attr_id, attr_name, {o.upper('n')} AS name FROM (SELECT class_name, attr_id, attr_name, unnest(list_concat([attr_name], coalesce(aliases, []))) AS n FROM attr_defs)")
def alias_directory(spark: SparkSession, d: str) -> DataFrame:
    """All names under which attributes are known"""
    return cat.aliases(table(spark, d, "attr_defs"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, CAST({bit} AS BIGINT) AS bit, '{text.replace("'", "''")}' AS description" for k, (bit, text) in ses.DIRECTIVES.items()) + f" UNION ALL SELECT '*', CAST({sum(bit for bit, _ in ses.DIRECTIVES.values())} AS BIGINT), 'all'")
def directive_listing(spark: SparkSession, d: str) -> DataFrame:
    """All statements with their capability bits, and all bits together"""
    own = spark.createDataFrame([(k, bit, text) for k, (bit, text) in ses.DIRECTIVES.items()], "name string, bit bigint, description string")
    return own.union(own.agg(F.lit("*"), F.bit_or("bit"), F.lit("all")))


@query(f"SELECT {o.upper('attr_name')} AS name, count(*) AS n FROM attr_defs GROUP BY 1 HAVING count(*) > 1")
def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Attribute names that several classes have"""
    return table(spark, d, "attr_defs").groupBy(norm.ascii_upper("attr_name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


# ---- registration and replication

LIVE = f"WITH {o.CHANGES}, e AS (SELECT key, max(rn) AS ended FROM once WHERE op = 'del' GROUP BY key), s AS (SELECT o.* FROM once o LEFT JOIN e ON e.key = o.key WHERE o.rn > coalesce(e.ended, 0)), b AS (SELECT key, min(rn) AS begun FROM s WHERE op = 'add' GROUP BY key), w AS (SELECT s.key, max(s.rn) AS rn FROM s JOIN b ON b.key = s.key WHERE s.rn = b.begun OR (s.op = 'mod' AND s.rn > b.begun) GROUP BY s.key)"


@query(f"{LIVE} SELECT o.key AS rid, o.change_no FROM once o JOIN w ON w.key = o.key AND w.rn = o.rn")
def register_replay(spark: SparkSession, d: str) -> DataFrame:
    """Records live after all changes, with the change whose content they hold"""
    return changes.live(table(spark, d, "spool"))


OUTCOME = f"WITH {o.CHANGES}, b AS (SELECT *, last_value(CASE WHEN op <> 'mod' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM once), r AS (SELECT change_no, op, key AS rid, CAST(CASE WHEN op = 'add' AND coalesce(before = 'add', false) THEN 324 WHEN op <> 'add' AND NOT coalesce(before = 'add', false) THEN 336 ELSE 0 END AS INTEGER) AS code FROM b)"


@query(f"{OUTCOME} SELECT change_no, op, rid, code FROM r")
def register_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What became of each change"""
    return register.outcomes(table(spark, d, "spool"))


@query(f"{OUTCOME} SELECT op, code, count(*) AS n FROM r GROUP BY ALL")
def register_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many changes ended how"""
    return register.outcome_counts(table(spark, d, "spool"))


@query(f"SELECT s.spool_id, CAST(CASE WHEN a.area_type IS NULL THEN 340 ELSE 333 END AS INTEGER) AS code FROM spool s LEFT JOIN auth_areas a ON {o.upper('a.auth_area')} = {o.upper('s.auth_area')} WHERE a.area_type IS NULL OR lower(a.area_type) IN ('slave', 'secondary')")
def register_masters(spark: SparkSession, d: str) -> DataFrame:
    """Changes for areas this server is not master of, or does not know"""
    return register.master_faults(table(spark, d, "spool"), table(spark, d, "auth_areas"))


@query(f"WITH {o.search((LAST_NAME + " AND starts_with(c.k, 'SOL')", 'true'))} SELECT r.row_id, r.class_name FROM records r WHERE r.row_id NOT IN (SELECT row_id FROM hits)")
def delete_by_query(spark: SparkSession, d: str) -> DataFrame:
    """All records but those that contact Last-Name=sol* finds"""
    hits = _hits(spark, d, "contact Last-Name=sol*").first(0)
    return register.deleted_by(table(spark, d, "records"), hits).select("row_id", "class_name")


@query("SELECT row_id, rid, 'old' AS copy FROM records WHERE auth_area NOT IN (SELECT auth_area FROM auth_areas WHERE serial_no > '20200101000000000') UNION ALL SELECT row_id, rid, 'new' FROM records WHERE auth_area IN (SELECT auth_area FROM auth_areas WHERE serial_no > '20200101000000000')")
def replica_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A replica in which areas with a serial after 2020 were taken anew"""
    records = table(spark, d, "records").select("row_id", "rid", "auth_area")
    areas = table(spark, d, "auth_areas").select("auth_area", F.col("serial_no").alias("serial"))
    stale = export.stale(areas, areas.withColumn("serial", F.lit("20200101000000000")))
    return export.refreshed(records.withColumn("copy", F.lit("old")), records.withColumn("copy", F.lit("new")), stale).select("row_id", "rid", "copy")


@query(f"SELECT c.row_id, CAST(c.attr_id AS INTEGER) AS attr_id, {o.trim('c.value')} AS target, k.r IS NOT NULL AS found FROM ({o.CELLS}) c JOIN attr_defs d ON d.class_name = c.class_name AND d.attr_id = c.attr_id AND d.attr_type = 'ID' LEFT JOIN (SELECT DISTINCT {o.upper(o.trim('rid'))} AS r FROM records WHERE rid IS NOT NULL) k ON k.r = {o.upper(o.trim('c.value'))} WHERE {o.trim('c.value')} <> ''")
def resolve_references(spark: SparkSession, d: str) -> DataFrame:
    """References of records to others and whether these exist"""
    return register.references(table(spark, d, "records"), table(spark, d, "attr_defs"))


@query("SELECT row_id, array_to_string(list_transform(list_filter(av, lambda x: x.attr_id = 32), lambda x: coalesce(x.value, '')), chr(10)) AS address FROM records WHERE len(list_filter(av, lambda x: x.attr_id = 32)) > 1")
def multiline_values(spark: SparkSession, d: str) -> DataFrame:
    """Street addresses of several lines, in order"""
    lines = F.transform(binding.values_of(F.col("av"), 32), lambda v: F.coalesce(v, F.lit("")))
    return table(spark, d, "records").where(F.size(lines) > 1).select("row_id", F.array_join(lines, "\n").alias("address"))


# ---- scalar functions


@query(f"SELECT DISTINCT row_id, pos, {o.upper('value')} AS up, translate(value, '{o.UP}', '{o.LOW}') AS low, {o.trim('value', o.SPACE)} AS trimmed, regexp_replace(value, '\\s+', ' ', 'g') AS compact, reverse(value) AS reversed, CAST(length(value) - length(replace(value, 'a', '')) AS INTEGER) AS n_a, replace(value, '-', '') AS undashed, ltrim(value, '(') AS unopened, rtrim(value, ')') AS unclosed, CAST(strpos({o.upper('value')}, 'SUND') AS INTEGER) AS at, starts_with({o.upper('value')}, 'KEL') AS begins, split_part(value, ' ', 1) AS first FROM ({o.CELLS}) WHERE value <> '' AND regexp_full_match(value, '[ -~]+')")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Text helpers over all values of printable ASCII"""
    cells = table(spark, d, "records").select("row_id", F.explode("av").alias("x")).select("row_id", F.col("x.pos").alias("pos"), F.col("x.value").alias("v")).where("v != ''").where(F.col("v").rlike(r"\A[ -~]+\z"))
    v = F.col("v")
    return cells.select("row_id", "pos", norm.ascii_upper(v).alias("up"), norm.ascii_lower(v).alias("low"), norm.trim_right(norm.trim_left(v)).alias("trimmed"), norm.compact_blanks(v).alias("compact"), F.reverse(v).alias("reversed"), norm.count_char(v, "a").alias("n_a"), norm.strip_char(v, "-").alias("undashed"), norm.strip_leading(v, "(").alias("unopened"), norm.strip_trailing(v, ")").alias("unclosed"), norm.find_folded(v, "SUND").alias("at"), norm.starts_folded(v, "kel").alias("begins"), F.get(norm.fields(v, " "), F.lit(0)).alias("first")).distinct()


@query(f"SELECT DISTINCT value AS v, {NET_SHAPE.format('value')} AS network, {DOMAIN_SHAPE.format('value')} AS domain, {MAIL_SHAPE.format('value')} AS mail, contains(value, '.') AS id, contains(value, '/') AS net_text FROM ({o.CELLS}) WHERE value IS NOT NULL AND attr_id IN (8, 19, 21, 25, 26, 38) AND regexp_full_match(value, '[ -~]*')")
def shape_functions(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of all addresses, names and networks of printable ASCII"""
    cells = table(spark, d, "records").select(F.explode("av").alias("x")).where("x.attr_id IN (8, 19, 21, 25, 26, 38)").select(F.col("x.value").alias("v")).where(F.col("v").rlike(r"\A[ -~]*\z"))
    return cells.select("v", net.looks_like_network("v").alias("network"), shapes.is_domain_shape("v").alias("domain"), shapes.is_email("v").alias("mail"), shapes.is_identifier("v").alias("id"), shapes.is_net_text("v").alias("net_text")).distinct()


@query("SELECT auth_area, regexp_extract(primary_server, '^([^:]*)', 1) AS host, regexp_extract(primary_server, ':([0-9]*)$', 1) AS port, lpad(CAST(CAST(serial_no AS DECIMAL(18,0)) + 1 AS VARCHAR), 17, '0') AS next_serial, serial_no > '20200101000000000' AS newer FROM auth_areas")
def serial_functions(spark: SparkSession, d: str) -> DataFrame:
    """Server addresses and serials of all areas"""
    url = shapes.url_parts(F.concat(F.lit("ref://"), F.col("primary_server")))
    return table(spark, d, "auth_areas").select("auth_area", url["host"].alias("host"), url["port"].alias("port"), register.next_serial(F.col("serial_no")).alias("next_serial"), register.newer(F.col("serial_no"), F.lit("20200101000000000")).alias("newer"))


# ---- what the problems' operators give besides their findings


@query()
def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Rows of raw_rows that can be loaded, as fields"""
    return rows.loaded(table(spark, d, "raw_rows"), table(spark, d, "auth_areas"))


@query()
def p3_live_records(spark: SparkSession, d: str) -> DataFrame:
    """The records live after all changes, with their content"""
    return changes.live_records(table(spark, d, "spool"))


@query()
def p4_contacts(spark: SparkSession, d: str) -> DataFrame:
    """The wide table of class contact"""
    return wide.wide_tables(table(spark, d, "av_pairs"), table(spark, d, "attr_defs"))["contact"]


@query()
def p6_one_table(spark: SparkSession, d: str) -> DataFrame:
    """One table over all versions of all classes"""
    return versions.Drift(table(spark, d, "class_files"), table(spark, d, "file_pairs")).one_table()
