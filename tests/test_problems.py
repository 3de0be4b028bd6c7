"""Problems 2, 3, 4 and 6 against readings row by row in plain Python."""

import re
from collections import defaultdict
from datetime import UTC, date, datetime, timedelta

import __spark_entry__
from dirloom.operators.rows import rejected


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def same(spark, sf, name, want):
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, sf).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want, (sorted(set(got) - want)[:5], sorted(want - set(got))[:5])


def taken_apart(raw, sep):
    """Fields of a row by a walk over its characters, or None."""
    raw, out, i = raw.removesuffix("\r"), [], 0
    while True:
        if raw[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(raw):
                    return None
                if raw[i] == '"' and raw[i + 1 : i + 2] == '"':
                    text, i = text + '"', i + 2
                elif raw[i] == '"':
                    i += 1
                    break
                else:
                    text, i = text + raw[i], i + 1
            out.append(text)
            if i < len(raw) and raw[i] != sep:
                return None
        else:
            j = raw.find(sep, i)
            j = len(raw) if j < 0 else j
            if '"' in raw[i:j]:
                return None
            out.append(raw[i:j].strip())
            i = j
        if i >= len(raw):
            return out
        i += 1


def reason(raw, sep, areas):
    f = taken_apart(raw or "", sep)
    if f is None:
        return "quoting"
    if len(f) != 5:
        return "columns"
    if not (m := re.fullmatch(r"[A-Za-z0-9_-]+\.(.*)", f[0], re.S)) or m[1].lower() not in areas:
        return "id"
    return None if re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", f[3]) else "attr_name"


def test_p2_found(spark, sf):
    areas = {r.auth_area.lower() for r in rows(spark, sf, "auth_areas")}
    want = {(r.line_id, x) for r in rows(spark, sf.replace("0.001", "0.01"), "raw_rows") if (x := reason(r.raw, r.sep, areas))}
    assert len({x for _, x in want}) == 4
    same(spark, sf.replace("0.001", "0.01"), "p2_found", want)


def test_p2_cases(spark):
    area = spark.createDataFrame([("A.com",)], "auth_area string")
    texts = ["1.a.COM;x;y;N;v", '"1.a.com";"a;""b";y;N;""', '"""";;;;', '1.a.com;x;y;"N";v\r', "1.a.com;x;y;N;v;", '1.a.com;x"y;z;N;v', ' "1.a.com";x;y;N;v', '"1.a.com" ;x;y;N;v', '" 1.a.com";x;y;N;v', " 1.a.com ;x;y;\tN ;v", "1.a.com;x;y;N;\r\r", '"1.a.com;x;y;N;v', "", "1.a.com;x;y;9;v", '"\x01";x;y;N;v', '"";"";"";"";""', '""";"";x;y;N;v']
    df = spark.createDataFrame([(i, t, ";") for i, t in enumerate(texts)], "line_id bigint, raw string, sep string")
    assert {tuple(r) for r in rejected(df, area).collect()} == {(i, x) for i, t in enumerate(texts) if (x := reason(t, ";", {"a.com"}))}


def test_p3_found(spark, sf):
    sf, once = sf.replace("0.001", "0.01"), {}
    for r in sorted(rows(spark, sf, "spool"), key=lambda r: r.spool_id):
        action, rid, u = ((x or "").strip().lower() for x in (r.action, r.rid, r.updated))
        if action in ("add", "mod", "del") and rid and u:
            if re.fullmatch(r"\d{17}", u):
                at = datetime.strptime(u[:14] + u[14:] + "000", "%Y%m%d%H%M%S%f").replace(tzinfo=UTC)
            elif u.isdigit():
                at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=int(u))
            else:
                at = datetime.fromisoformat(u.upper())
            once.setdefault(r.change_no, (at, r.spool_seq, r.change_no, action, rid))
    live = {}
    for _, _, no, action, rid in sorted(once.values()):
        if (rid in live) == (action != "add"):
            live[rid] = no
            if action == "del":
                del live[rid]
    same(spark, sf, "p3_found", set(live.items()))


def test_p4_found(spark, sf):
    sf, names, known = sf.replace("0.001", "0.01"), {}, defaultdict(dict)
    for r in rows(spark, sf, "attr_defs"):
        for n in (r.attr_name, *(r.aliases or ())):
            names[r.class_name.lower(), n.lower()] = (r.attr_name, r.value_kind)
    cells, classes = defaultdict(list), {}
    pairs = rows(spark, sf, "av_pairs")
    for r in pairs:
        if r.attr_name.strip().lower() in ("class-name", "cn", "object-type", "schema-name") and (r.value or "").strip():
            classes[r.rid] = r.value.strip().lower()

    def ok(v, kind):
        if kind == "integer":
            return re.fullmatch(r"[+-]?[0-9]+", v)
        if kind == "boolean":
            return v.upper() in ("TRUE", "YES", "ON", "FALSE", "NO", "OFF")
        if m := re.fullmatch(r"([0-9]{4})([-/]?)([0-9]{2})\2([0-9]{2})", v):
            try:
                return bool(date(int(m[1]), int(m[3]), int(m[4])))
            except ValueError:
                pass
        return False

    for r in pairs:
        name, kind = names.get((classes.get(r.rid), r.attr_name.strip().lower()), ("", "text"))
        if kind != "text" and (v := (r.value or "").strip()):
            cells[r.rid, name].append(bool(ok(v, kind)))
    same(spark, sf, "p4_found", {k for k, v in cells.items() if not any(v)})


def test_p6_found(spark, sf):
    sf = sf.replace("0.001", "0.01")
    ver = {r.file_no: (r.db_dir, r.class_version.strip().ljust(17, "0")) for r in rows(spark, sf, "class_files")}
    held = {v: defaultdict(list) for v in ver.values()}
    vals = {v: defaultdict(lambda: defaultdict(set)) for v in ver.values()}
    rids = defaultdict(set)
    for r in rows(spark, sf, "file_pairs"):
        v, n, x = ver[r.file_no], r.attr_name.strip().lower(), (r.value or "").strip()
        rids[v].add(r.rid)
        held[v][n] += [x] * bool(x)
        if x:
            vals[v][n][r.rid].add(x)

    def kind(xs):
        for k, p in (("integer", r"[+-]?[0-9]+"), ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("boolean", r"(?i)TRUE|YES|ON|FALSE|NO|OFF")):
            if sum(bool(re.fullmatch(p, x)) for x in xs) * 10 >= len(xs) * 9:
                return k
        return "text"

    want, order = set(), sorted(held)
    for a, b in zip(order, order[1:]):
        if a[0] != b[0]:
            continue
        gone, came, pairs = set(held[a]) - set(held[b]), set(held[b]) - set(held[a]), set()
        for o in gone:
            shared = [r for r in vals[a][o] if r in rids[b]]
            pairs |= {(o, n) for n in came if shared and sum(vals[a][o][r] == vals[b][n].get(r) for r in shared) * 5 >= len(shared) * 4}
        want |= {(*b, "renamed", o, n) for o, n in pairs} | {(*b, "removed", o, "") for o in gone - {o for o, _ in pairs}} | {(*b, "added", "", n) for n in came - {n for _, n in pairs}}
        want |= {(*b, "retyped", n, n) for n in set(held[a]) & set(held[b]) if held[a][n] and held[b][n] and kind(held[a][n]) != kind(held[b][n])}
    assert len({x[2] for x in want}) == 4
    same(spark, sf, "p6_found", want)
