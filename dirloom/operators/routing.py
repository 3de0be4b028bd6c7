"""Which area a value belongs to, and where to ask next: longest match over networks and domains by equi-joins.

The value's side is exploded into its enclosing networks or its suffixes, a bounded number per
value, and joined by equality; there is no range join and no cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net, shapes
from ..functions.norm import ascii_upper
from ..runtime import bounded


def network_matches(values: DataFrame, networks: DataFrame, value: str, network: str, key: str) -> DataFrame:
    """(key, network, plen): every network that contains or equals each value; values that are no networks match none."""
    prefixes = networks.where(net.looks_like_network(network)).select(F.col(network).alias("network"), net.parse(network).alias("n")).where("n IS NOT NULL")
    prefixes = prefixes.select("network", net.key(F.col("n")).alias("k"), F.col("n.len").alias("plen")).distinct()
    asked = values.where(net.looks_like_network(value)).select(key, net.parse(value).alias("v")).where("v IS NOT NULL")
    exploded = asked.select(key, F.explode(net.covering_keys(F.col("v"))).alias("k"))
    return exploded.join(bounded(prefixes), "k").select(key, "network", "plen").distinct()


def longest_network(values: DataFrame, networks: DataFrame, value: str, network: str, key: str) -> DataFrame:
    """(key, network, plen): the most specific network of each value; of equal ones the first by text."""
    best = F.min(F.struct((-F.col("plen")).alias("o"), "network"))
    return network_matches(values, networks, value, network, key).groupBy(key).agg(best.alias("b")).select(key, F.col("b.network").alias("network"), (-F.col("b.o")).alias("plen"))


def longest_suffix(values: DataFrame, domains: DataFrame, value: str, domain: str, key: str) -> DataFrame:
    """(key, domain): the longest domain of which each value's labels end in; whole labels, whatever the case."""
    known = domains.where(shapes.is_domain_shape(domain) & ~net.looks_like_network(domain)).select(F.col(domain).alias("domain"), ascii_upper(domain).alias("k")).distinct()
    asked = values.where(F.col(value).isNotNull()).select(key, F.explode(shapes.suffixes(ascii_upper(value))).alias("k"))
    best = F.min(F.struct((-F.length("k")).alias("o"), "domain"))
    return asked.join(bounded(known), "k").groupBy(key).agg(best.alias("b")).select(key, F.col("b.domain").alias("domain"))


def hierarchical_values(values: DataFrame, value: str, key: str) -> DataFrame:
    """(key, kind, hvalue): networks and domains that values stand for; other values have no row."""
    return values.select(key, shapes.hierarchical(value).alias("h")).where("h IS NOT NULL").select(key, F.col("h.kind").alias("kind"), F.col("h.value").alias("hvalue"))


def areas_holding(values: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """(key, auth_area): every area a hierarchical value (kind, hvalue) lies in. Domain areas hold whatever ends in their text.

    Domain ends are no labels, so the exploded side is every end of the value, as many as it has
    characters; networks are exploded into their prefixes.
    """
    named = areas.where("auth_area IS NOT NULL").select("auth_area").distinct()
    nets = network_matches(values.where("kind = 'network'"), named, "hvalue", "auth_area", key).select(key, F.col("network").alias("auth_area"))
    ends = named.where(shapes.is_domain_shape("auth_area")).select("auth_area", ascii_upper("auth_area").alias("k"))
    domains = values.where("kind = 'domain' AND hvalue != ''").select(key, ascii_upper("hvalue").alias("d"))
    every = F.transform(F.sequence(F.lit(1), F.length("d")), lambda i: F.substr(F.col("d"), i))
    held = domains.select(key, F.explode(F.concat(every, F.array(F.lit(".")))).alias("k")).join(bounded(ends, by=areas), "k").select(key, "auth_area")
    return nets.union(held).distinct()


def down_referrals(values: DataFrame, areas: DataFrame, referrals: DataFrame, key: str) -> DataFrame:
    """(key, auth_area, referral): where to ask for a value that lies in an area which has delegated it.

    ``referrals`` (auth_area, referred, target) are the delegations of each area. In each area
    holding the value the most specific delegation that holds it counts: the value itself, then
    what is left as it is shortened, as long as that stays in the area.
    """
    held = areas_holding(values, areas, key).join(values.select(key, "kind", "hvalue"), key)
    parsed = net.parse("hvalue")
    steps = F.when(F.col("kind") == "network", F.transform(net.covering_keys(parsed), lambda k: F.struct((-F.element_at(F.split(k, "/"), -1).cast("int")).alias("o"), k.alias("k")))).otherwise(F.transform(shapes.suffixes(ascii_upper("hvalue")), lambda s: F.struct((-F.length(s)).alias("o"), s.alias("k"))))
    asked = held.select(key, "auth_area", "kind", F.explode(steps).alias("s")).select(key, "auth_area", "kind", "s.o", "s.k")
    # steps that leave the area are none
    area_net = net.parse("auth_area")
    inside = F.when(F.col("kind") == "network", -F.col("o") >= area_net["len"]).otherwise((F.col("auth_area") == ".") | F.endswith(F.col("k"), ascii_upper("auth_area")))
    asked = asked.where(F.coalesce(inside, F.lit(False)))
    known = referrals.where("referred IS NOT NULL AND target IS NOT NULL").select("auth_area", F.coalesce(F.when(net.looks_like_network("referred"), net.key(net.parse("referred"))), ascii_upper("referred")).alias("k"), F.col("target")).distinct()
    found = asked.join(known, ["auth_area", "k"])
    best = found.groupBy(key, "auth_area").agg(F.min("o").alias("o"))
    return found.join(best, [key, "auth_area", "o"]).select(key, "auth_area", shapes.referral_line("target", F.lit(None).cast("string")).alias("referral")).distinct()


def up_referrals(values: DataFrame, areas: DataFrame, punts: DataFrame, key: str, is_root: bool = False) -> DataFrame:
    """(key, referral): all upward referrals for values that lie in no area of this server; a root server has none."""
    outside = values.join(areas_holding(values, areas, key).select(key).distinct(), key, "leftanti").select(key)
    lines = punts.where(shapes.is_punt_reference("line")).select(shapes.referral_line("line", F.lit(None).cast("string")).alias("referral")).distinct()
    # a configured list, one array for all
    every = lines.agg(F.array_sort(F.collect_list("referral")).alias("l"))
    return outside.where(F.lit(not is_root)).select(key, F.explode(every.scalar()).alias("referral"))
