"""Record files, configuration files, streams and sessions."""

from pyspark.sql import functions as F

from dirloom import session as ses
from dirloom.catalog import Area, Attribute
from dirloom.operators import binding
from dirloom.sources import config, text
from dirloom.streaming import feed


def test_record_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Name: Ann \nnote\n# no\nType:x:y\n---\n_Name: gone\n_Type: gone\n---\n\nName:Bob\x07\n---\n")
    (tmp_path / "two.txt").write_text("--- first\nName: Cid")
    (tmp_path / "three.dat").write_text("Name: Dan\n---\n")
    got = lambda **k: sorted([(x.name, x.value) for x in r.av] for r in text.record_blocks(spark, str(tmp_path), **k).collect())
    ann, bob, cid, dan = [("Name", "Ann"), ("Type", "x:y")], [("Name", "Bob")], [("Name", "Cid")], [("Name", "Dan")]
    assert got(suffix=".txt") == sorted([ann, bob, cid])
    assert got(names=["three.dat"]) == [dan]
    pairs = text.pairs_of(text.record_blocks(spark, str(tmp_path), names=["one.txt"]).withColumn("rid", F.lit("r")), "rid")
    assert {(r.attr_name, r.value) for r in pairs.collect()} == {("Name", "Ann"), ("Type", "x:y"), ("Name", "Bob")}


def test_round_trip(spark, tmp_path, sf):
    records = spark.read.parquet(f"{sf}/records.parquet").where("size(av) > 0")
    clean = records.select("row_id", F.expr("transform(filter(av, x -> x.value != '' AND x.value = trim(regexp_replace(x.value, '[\\\\s\\\\p{Cntrl}]+', ' '))), x -> x)").alias("av")).where("size(av) > 0")
    binding.record_text(clean, "row_id").select(F.expr("substr(text, 1, length(text) - 1)").alias("value")).write.text(f"{tmp_path}/r")
    back = text.record_blocks(spark, f"{tmp_path}/r")
    lines = lambda df, n: sorted("\n".join(f"{x[n]}:{x.value}" for x in r.av) for r in df.select("av").collect())
    assert lines(back, "name") == lines(clean, "attr")


def test_line_helpers(spark):
    df = spark.createDataFrame([(" a : b:c ",), ("#x:y",), ("plain",), (":v",), ("---x",), ("_new_",), ("a:b:c:d",)], "l string")
    rows = df.select(text.tag_and_value(F.col("l")).alias("t"), text.is_separator(F.col("l")).alias("s"), text.three_parts(F.col("l")).alias("p")).collect()
    assert [r.t and tuple(r.t) for r in rows[:4]] == [("a", "b:c"), None, None, None]
    assert [r.s for r in rows] == [False] * 4 + [True, True, False] and tuple(rows[6].p) == ("a", "b", "c:d") and rows[2].p is None
    changes = spark.createDataFrame([(1, "ID:1\nUpdated:2\n_NEW_\nName:x\nNote"), (2, "Name:y")], "change_no bigint, payload string")
    assert {r.change_no: [(x.name, x.value) for x in r.av] for r in text.payload_pairs(changes, "change_no").collect()} == {1: [("Name", "x")], 2: [("Name", "y")]}
    answer = spark.createDataFrame([(1, "%soa serial:1"), (2, "%soa ttl:5"), (3, "%other x"), (4, "%soa"), (5, "%soa late:1"), (6, "%ok")], "n int, line string")
    assert sorted(tuple(r) for r in text.read_response(answer, "soa").collect()) == [(1, "serial:1"), (2, "ttl:5")]


def test_configuration(tmp_path):
    attrs = [Attribute("host", 7, "Host-Name", ("HN",), "EXACT", is_required=True, is_primary_key=True, format="re: x"), Attribute("host", 8, "Addr", index_kind="CIDR", attr_type="ID")]
    config.write_all({"areas": config.areas_text([Area("a.com", "master", None, ("g.1",)), Area("b.com", "slave")]).replace("name: a.com\n", "name: a.com\nschema-file: schema\n"), "schema": "name: Host\nalias: machine\nattributedef: host.tmpl\n---\nalias: none\n", "host.tmpl": config.attributes_text(attrs), "main": config.settings_text({"max-hits": "5"})}, str(tmp_path))
    assert not list(tmp_path.glob("*.new"))
    cat = config.read_catalog(str(tmp_path), "areas")
    assert [a.name for a in cat.areas] == ["a.com", "b.com"] and cat.areas[0].guardians == ("g.1",)
    assert cat.attributes == tuple(attrs) and cat.find_class("MACHINE") == "host" and cat.find_attribute("host", "hn") == attrs[0]
    assert config.main_settings((tmp_path / "main").read_text()) == {"max-hits": "5"}
    assert config.punts("# c\n\n ref://h:1/ \n") == ["ref://h:1/"] and config.directives("class: on\nsoa: no\n") == {"class": True, "soa": False}
    assert config.extended_directives("command: Date\nprogram: p\n---\nx: y\n") == {"date": {"command": "Date", "program": "p"}}
    assert config.host_lists("d: 10. EXCEPT x\nALL\n") == ["10. EXCEPT x", "ALL"] and config.soa("serial-number: 1\n# x: y\n") == {"serial-number": "1"}


def test_stream_applies_each_change_once(spark, tmp_path, sf):
    spool = spark.read.parquet(f"{sf}/spool.parquet")
    source, log = f"{tmp_path}/in", f"{tmp_path}/log"
    spool.repartition(3).write.parquet(source)
    for _ in range(2):
        feed.start(feed.read_spool(spark, source, spool.schema), log, f"{tmp_path}/ck").awaitTermination(120)
    from dirloom.operators.changes import live

    got = {(r.rid, r.change_no) for r in feed.state(spark, log).collect()}
    assert got == {tuple(r) for r in live(spool).collect()} and got
    spool.limit(5).write.mode("append").parquet(source)
    feed.start(feed.read_spool(spark, source, spool.schema), log, f"{tmp_path}/ck").awaitTermination(120)
    assert {(r.rid, r.change_no) for r in feed.state(spark, log).collect()} == got
    hours = feed.counts_per_hour(feed.read_spool(spark, source, spool.schema, 100))
    q = hours.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM hours").first()[0] == spool.count() + 5


def test_session(spark, sf):
    s = ses.Session.open(spark, sf)
    code = lambda line: s.run(line).status.first().code
    assert code("-nope") == 400 and code("-limit 0") == 331 and code("-limit x") == 331 and code("-limit 3") == 0 and s.settings.limit == 3
    assert code("-soa no.area") == 340 and code("-class") == 338 and code("-schema soldor.example.org nothing") == 341
    assert s.run("-soa soldor.example.org").rows.count() == 8 and s.run("-schema soldor.example.org host").rows.select("class_name").distinct().count() == 1
    assert s.run("-class wextide.example.org").rows is not None and s.run("-directive").rows.count() == len(ses.DIRECTIVES) and code("-directive nope") == 400
    assert code("-display other") == 436 and code("-forward maybe") == 338 and code("-forward on") == 0 and s.settings.forward
    assert code("-security on request pw x") == 0 and s.settings.who.complete and code("-security off") == 0 and not s.settings.who.secure
    assert code("-notify update a b") == 0 and s.notices == [("update", "a b")] and code("-hello V-9") == 300 and s.run("-hello V-1.5 x").rows.count() == 1
    assert code("-xfer 10.19.0.0/16") == 333 and code("-xfer soldor.example.org class=host") in (0, 332) and code("-quit") == 0
    assert s.run("-status").rows.where("property = 'objects'").first().value == str(s.records.count())
    assert code("contact *") == 350 and code("contact Name=*x") == 351 and code("contact Last-Name=no-such") == 230
    answer = s.run("contact Last-Name=q* OR Last-Name=s*")
    assert answer.rows.count() <= 3 and answer.lines() == ["%error 330 Exceeded Max Objects Limit"]
    assert s.shown(answer.rows).where("line = ''").count() == answer.rows.count()
    s.extensions["date"] = lambda own, args: own.spark.createDataFrame([(" ".join(args),)], "line string")
    assert s.run("-X-date a b").rows.first().line == "a b" and code("-X-none") == 400
    assert code("-register off") == 338 and code("-register on put a@b.org") == 338 and code("-register on add nobody") == 338
    assert code("-register on add a@b.org") == 0 and code("Class-Name:host") == 0 and code("Host-Name:x") == 0
    assert tuple(s.run("-register off").rows.first()) == ("add", "a@b.org", "Class-Name:host\nHost-Name:x") and s.pending is None
    assert code("-register on mod a@b.org") == 0 and code("ID:1") == 0 and code("-register off") == 336
    assert ses.message(0) == "%ok" and ses.capabilities({"X": False}) == 0x3FFF


def test_workers_find_the_package(spark):
    from pathlib import Path

    import dirloom
    from dirloom.runtime import reachable

    root = str(Path(dirloom.__file__).parent.parent)
    for _ in range(2):
        reachable(spark)
    assert spark.sparkContext.environment["PYTHONPATH"].split(":").count(root) == 1
