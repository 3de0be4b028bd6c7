"""IPv4 and IPv6 networks as Columns: parse, mask, compare, canonical text, containment keys.

A network is a struct (af, hex, len): family 4 or 6, the address masked to its length as 8 or 32
hexadecimal digits, and the length. Text of fixed width compares like the number it stands for
in either family, needs no 128-bit integers and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .norm import col, let

#: Fixed pattern: what may be looked up as a network.
NETWORK = r"^[a-fA-F0-9]+([.:][a-fA-F0-9]*)*(/[0-9]+)?$"
#: Fixed pattern: strict prefix notation; the dots are wild, as they always were.
STRICT_CIDR = r"^[0-9]+.[0-9]+.[0-9]+.[0-9]/[0-9]+"
_DIGITS = "0123456789abcdef"
#: The digits with only their first one, two or three bits kept.
_KEPT = {1: "0000000088888888", 2: "000044448888cccc", 3: "0022446688aaccee"}
_WIDTH = {4: 8, 6: 32}


def looks_like_network(c: Column | str) -> Column:
    """Whether a value may be searched as a network; a rough test of its characters."""
    return col(c).rlike(NETWORK)


def is_strict_cidr(c: Column | str) -> Column:
    """Whether a value begins like four numbers and a length."""
    return col(c).rlike(STRICT_CIDR)


def unpadded(c: Column | str) -> Column:
    """An IPv4 address without zero padding of its numbers; other text, or numbers above 255, stay as they are."""
    return let(_unpadded, col(c))


def _unpadded(v: Column) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda p: p.try_cast("int"))
    sound = v.rlike(r"^[0-9]+(\.[0-9]+){1,3}$") & F.forall(parts, lambda n: n.isNotNull() & (n <= 255))
    return F.when(sound, F.array_join(F.transform(parts, lambda n: n.cast("string")), ".")).otherwise(v)


def _hex4(address: Column) -> Column:
    parts = F.split(address, r"\.")
    sound = address.rlike(r"^[0-9]{1,9}(\.[0-9]{1,9}){3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(sound, F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0")), ""))


def _hex6(address: Column) -> Column:
    low = F.lower(address)
    halves = F.split(low, "::", -1)
    groups = lambda t: F.filter(F.split(t, ":", -1), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    gap = F.when(missing > 0, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>"))
    full = F.concat(left, gap, right)
    group = "[0-9a-f]{1,4}"
    whole = low.rlike(rf"^{group}(:{group}){{7}}$")
    short = (F.size(halves) == 2) & low.rlike(rf"^({group}(:{group})*)?::({group}(:{group})*)?$") & (missing > 0)
    return F.when(whole | short, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def masked(hexed: Column, length: Column) -> Column:
    """The digits of an address with all bits from ``length`` on cleared."""
    return let(_masked, hexed, length)


def _masked(hexed: Column, length: Column) -> Column:
    whole = F.floor(length / 4).cast("int")
    digit = F.substr(hexed, whole + 1, F.lit(1))
    part = F.lit("")
    for bits, kept in _KEPT.items():
        part = F.when(length % 4 == bits, F.translate(digit, _DIGITS, kept)).otherwise(part)
    return F.rpad(F.concat(F.substr(hexed, F.lit(1), whole), part), F.length(hexed), F.lit("0"))


def parse(c: Column | str) -> Column:
    """Struct (af, hex, len) of a network text, null if it is none.

    Without a length the whole address counts; a length beyond the family's is no network.
    Numbers may be padded with zeros. The address is masked to the length.
    """
    return let(_parse, col(c))


def _parse(v: Column) -> Column:
    slash = F.length(v) - F.length(F.substring_index(v, "/", -1))
    address = F.when(slash > 0, F.substr(v, F.lit(1), slash - 1)).otherwise(v)
    # text behind the slash that is no number counts as 0
    said = F.when(slash > 0, F.coalesce(F.substring_index(v, "/", -1).try_cast("int"), F.lit(0)))
    hexed = let(lambda plain: F.coalesce(_hex4(plain), let(_hex6, plain)), unpadded(address))
    return let(_net, hexed, said)


def _net(hexed: Column, said: Column) -> Column:
    most = F.length(hexed) * 4
    length = F.when(said >= 0, said).otherwise(most)
    af = F.when(most == 32, 4).otherwise(6)
    return F.when(hexed.isNotNull() & (length <= most), F.struct(af.cast("int").alias("af"), masked(hexed, length).alias("hex"), length.cast("int").alias("len")))


def canonical(net: Column) -> Column:
    """Canonical text: four three-digit numbers or eight four-digit groups, a slash and the length."""
    return let(_canonical, net)


def _canonical(net: Column) -> Column:
    h = net["hex"]
    four = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.lpad(F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10), 3, "0")), ".")
    six = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(h, i * 4 + 1, F.lit(4))), ":")
    return F.when(net.isNotNull(), F.concat(F.when(net["af"] == 4, four).otherwise(six), F.lit("/"), net["len"].cast("string")))


def key(net: Column) -> Column:
    """Text under which equal networks are equal."""
    return let(lambda n: F.concat_ws("/", n["hex"], n["len"].cast("string")), net)


def covering_keys(net: Column) -> Column:
    """Keys of every network that contains or equals this one, 33 or 129 at most: the side to explode for an equi-join."""
    return let(lambda v: F.transform(F.sequence(F.lit(0), v["len"]), lambda n: F.concat_ws("/", masked(v["hex"], n), n.cast("string"))), net)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by address; -2 for different families."""
    return F.when(a["af"] != b["af"], -2).when(a["hex"] < b["hex"], -1).when(a["hex"] > b["hex"], 1).otherwise(0)


def within(sub: Column, net: Column) -> Column:
    """Whether an address, masked to the network's length, is that network; a wider sub with the same start is within too."""
    return F.coalesce(let(lambda s, n: (s["af"] == n["af"]) & (masked(s["hex"], n["len"]) == n["hex"]), sub, net), F.lit(False))


def shortened(net: Column) -> Column:
    """The network one bit wider; null for length 0."""
    return let(lambda n: F.when(n["len"] > 0, F.struct(n["af"].alias("af"), masked(n["hex"], n["len"] - 1).alias("hex"), (n["len"] - 1).alias("len"))), net)


def classful_length(net: Column) -> Column:
    """Length of an IPv4 address by its class; 32 if it has host bits, -1 for IPv6."""
    first = F.conv(F.substr(net["hex"], F.lit(1), F.lit(2)), 16, 10).cast("int")
    by_class = F.when(first < 128, 8).when(first < 192, 16).when(first < 224, 24).otherwise(32)
    return F.when(net["af"] != 4, -1).when(masked(net["hex"], by_class) == net["hex"], by_class).otherwise(32)


def octet_length(net: Column) -> Column:
    """Length of an IPv4 address by its trailing zero octets; -1 for IPv6."""
    return F.when(net["af"] != 4, -1).otherwise(32 - F.length(F.regexp_extract(net["hex"], "((?:00)*)$", 1)) * 4)
