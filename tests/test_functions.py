"""Columns of functions against Python's own libraries and hand-worked cases."""

import ipaddress
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dirloom.functions import net, norm, phonetic, shapes
from dirloom.query.search import covering

ADDRESSES = ["10.0.0.0/8", "010.001.002.003/24", "10.1.2.3", "10.1.2.3/33", "10.1.2", "256.1.1.1", "10.1.2.3/0", "::", "::1/128", "fd00:1a00::/32", "FD00:1A00:0:0:0:0:0:1/33", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", "fd00::/129", "abc", "", None, "10.1.2.3/x", "1:2:3:4:5:6:7::", "::ffff:0:0/95"]


def by_hand(text):
    """(family, digits, length) with the standard library."""
    if text is None:
        return None
    address, slash, length = text.rpartition("/") if "/" in text else (text, "", "")
    if re.fullmatch(r"\d+(\.\d+){1,3}", address):
        address = ".".join(str(int(p)) for p in address.split("."))
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return None
    n = int(length) if length.isdigit() else 0 if slash else ip.max_prefixlen
    if n > ip.max_prefixlen:
        return None
    n_ = ipaddress.ip_network((ip, n), strict=False)
    return ip.version, n_.network_address.packed.hex(), n


def test_networks(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ADDRESSES)], "i int, a string")
    rows = df.select("i", net.parse("a").alias("n"), net.canonical(net.parse("a")).alias("c"), net.key(net.parse("a")).alias("k"), net.covering_keys(net.parse("a")).alias("up")).collect()
    for r in rows:
        want = by_hand(ADDRESSES[r.i])
        assert (r.n and tuple(r.n)) == want, (ADDRESSES[r.i], r.n, want)
        if want and want[0] == 4:
            assert r.c == ".".join(f"{x:03d}" for x in bytes.fromhex(want[1])) + f"/{want[2]}"
        if want:
            assert r.up[::-1] == covering(ADDRESSES[r.i].lower() if want[0] == 6 else f"{ipaddress.ip_address(bytes.fromhex(want[1]))}/{want[2]}") and r.up[-1] == f"{want[1]}/{want[2]}"


def test_containment(spark):
    pairs = [("10.1.2.3", "10.0.0.0/8"), ("11.1.2.3", "10.0.0.0/8"), ("16.0.0.0/4", "16.0.0.0/8"), ("fd00::1", "fd00::/16"), ("10.1.2.3", "::/0"), ("10.1.2.3", "0.0.0.0/0"), (None, "10.0.0.0/8"), ("x", "10.0.0.0/8")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: (r.w, r.c) for r in df.select("i", net.within(net.parse("a"), net.parse("b")).alias("w"), net.compare(net.parse("a"), net.parse("b")).alias("c")).collect()}
    assert [got[i][0] for i in range(8)] == [True, False, True, True, False, True, False, False]
    assert [got[i][1] for i in range(6)] == [1, 1, 0, 1, -2, 1]


def test_lengths(spark):
    df = spark.createDataFrame([("10.0.0.0",), ("10.1.0.0",), ("128.1.0.0",), ("192.0.1.0",), ("0.0.0.0",), ("224.0.0.1",), ("fd00::",)], "a string")
    got = [tuple(r) for r in df.select(net.classful_length(net.parse("a")), net.octet_length(net.parse("a"))).collect()]
    assert got == [(8, 8), (32, 16), (16, 16), (24, 24), (8, 0), (32, 32), (-1, -1)]


def test_phonetic_codes():
    # worked out by hand from the rules of the code
    for word, want in {"Knight": "NFT", "Gnome": "NM", "Pneu": "N", "Aeon": "EN", "Wright": "RFT", "Whale": "WL", "Xavier": "SFR", "Thomas": "OMS", "Philip": "FLP", "school": "SKL", "science": "SNS", "church": "XRX", "Ciao": "X", "edge": "EJ", "vision": "FXN", "nation": "NXN", "Bob": "BB", "queen": "KN", "Zoe": "S", "": "", "123": "", "ox": "OK", "taxi": "TKI"}.items():
        assert phonetic.code(word) == want, (word, phonetic.code(word), want)
    assert phonetic.key_of("Knight-Thomas  Ltd.\x07") == "NFT OMS LTT"[: len("NFT OMS LTT")]
    assert phonetic.key_of(None) is None and phonetic.key_of("12 / 3") is None
    assert phonetic.can_be_phonetic("John Smith") and not phonetic.can_be_phonetic("John1") and not phonetic.can_be_phonetic("")
    assert all(len(phonetic.code(w)) <= phonetic.LONGEST for w in ("antidisestablishmentarianism", "x" * 50))


def test_phonetic_column(spark):
    df = spark.createDataFrame([("Knight",), (None,), ("1",)], "v string")
    assert [r[0] for r in df.select(phonetic.phonetic_key(F.col("v"))).collect()] == ["NFT", None, None]


def test_words_of_a_line():
    assert shapes.split_arguments("""a  "b c" 'd "e' {f g{ h""") == ["a", "b c", 'd "e', "f g", "h"]
    assert shapes.split_arguments("   ") == [] and shapes.split_arguments('"') == [""]


@given(st.text("ab{}\\[]^$.*+?()|-", max_size=8), st.text("ab{}.-", max_size=6))
def test_patterns_compile_or_are_none(pattern, text):
    java = shapes.java_pattern(pattern)
    if java is not None:
        re.search(java, text)


def test_patterns_and_formats(spark):
    assert shapes.java_pattern("a{2}") == r"a\{2\}" and shapes.java_pattern("[") is None and shapes.java_pattern("a\\") is None
    df = spark.createDataFrame([("a{2}",), ("aa",)], "v string")
    assert [r[0] for r in df.select(shapes.matches_format("v", "^A{2}$")).collect()] == [True, False]
    assert [r[0] for r in df.select(shapes.matches_format("v", "(")).collect()] == [True, True]
    assert re.sub("(b)(x)?", shapes.substitute(r"<&\1\2\&>"), "abc") == "a<bb&>c"


def test_hierarchical_values(spark):
    values = ["10.1.2.3/8", "a.com", "x@b.org", "a.longtld", "z.de", "plain", "b.c@d.e.net", "", None, "10.1.2"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.h and tuple(r.h) for r in df.select("i", shapes.hierarchical("v").alias("h")).collect()}
    assert [got[i] for i in range(10)] == [("network", "010.000.000.000/8"), ("domain", "a.com"), ("domain", "b.org"), None, ("domain", "z.de"), None, ("domain", "d.e.net"), None, None, None]


def test_domains(spark):
    df = spark.createDataFrame([("www.A.com", "a.COM"), ("xa.com", "a.com"), ("b.org", "."), ("a.com", "b.com"), (None, "a.com"), ("", ".")], "s string, d string")
    assert [r[0] for r in df.select(shapes.within_domain("s", "d")).collect()] == [True, True, True, False, False, False]
    one = df.select(shapes.suffixes(F.lit("a.b.c")).alias("s"), shapes.without_first_label(F.lit("a.b.c")).alias("w"), shapes.without_first_label(F.lit("c")).alias("n")).first()
    assert (one.s, one.w, one.n) == (["a.b.c", "b.c", "c"], "b.c", None)


def test_referral_lines(spark):
    df = spark.createDataFrame([("ref://h:1//", "a.com"), ("ref://h:1/Auth-Area=b", "a.com"), ("ref://h:1/", None)], "t string, a string")
    assert [r[0] for r in df.select(shapes.referral_line("t", "a")).collect()] == ["ref://h:1/auth-area=a.com", "ref://h:1/Auth-Area=b", "ref://h:1"]
    parts = spark.range(1).select(shapes.url_parts(F.lit("ref://h.x:43/p q")).alias("u"), shapes.url_parts(F.lit("h.x:43:tcp rest")).alias("o"), shapes.url_parts(F.lit("??")).alias("n")).first()
    assert tuple(parts.u) == ("ref", "h.x", "43", "p") and tuple(parts.o) == ("tcp", "h.x", "43", "rest") and parts.n is None


def test_text_helpers(spark):
    df = spark.createDataFrame([(" \tÉa b\x07\n ", True), (None, None)], "v string, b boolean")
    r = df.select(norm.trim_left("v").alias("l"), norm.trim_right("v").alias("r"), norm.ascii_upper("v").alias("u"), norm.strip_control("v").alias("c"), norm.count_blanks("v").alias("n"), norm.on_off("b").alias("o"), norm.true_false("b").alias("t"), norm.find_folded("v", "A B").alias("f"), norm.find_folded("v", "").alias("e")).collect()
    assert (r[0].l, r[0].r, r[0].u) == ("Éa b\x07\n ", " \tÉa b\x07", " \tÉA B\x07\n ")
    assert (r[0].c, r[0].n, r[0].o, r[0].t, r[0].f, r[0].e) == (" \tÉa b ", 5, "ON", "TRUE", 4, 0)
    assert (r[1].l, r[1].o, r[1].t) == (None, "OFF", "FALSE")
    flags = spark.createDataFrame([("on",), (" Yes ",), ("TRUE",), ("1",), (None,)], "v string")
    assert [x[0] for x in flags.select(norm.is_truthy("v")).collect()] == [True, True, True, False, False]


def test_paths():
    assert shapes.base_name("/a/b/c") == "c" and shapes.directory("/a/b/c") == "/a/b" and shapes.directory("c") == ""
    assert shapes.joined_path("/a", "b") == "/a/b" and shapes.joined_path("/a", "/b") == "/b" and shapes.joined_path("", "b") == "b"
