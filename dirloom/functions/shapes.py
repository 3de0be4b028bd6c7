"""Shapes of values: domains, mail addresses, identifiers, referrals, and the hierarchical value of a term."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import net
from .norm import ascii_upper, col, strip_trailing, trim_blanks

# fixed patterns and lists
DOMAIN = r"^(([.]?[a-zA-Z0-9-]+)+|.+([.][a-zA-Z0-9-]+)*[.][a-zA-Z]+)$|^[.]$"
EMAIL = r"^(.+@[a-zA-Z0-9-]+([.][a-zA-Z0-9-]+)*[.][a-zA-Z]+)$"
AUTH_AREA = r"^([.]?[a-zA-Z0-9-]+)+[.]?|([.:]?[a-fA-F0-9]+)+/[0-9]+$"
URL = r"^([a-zA-Z]+)://([a-zA-Z0-9-.]+):?([0-9]*)/?([^ \t]*)"
OLD_REFERRAL = r"^([a-zA-Z0-9-.]+):([0-9]+):([a-zA-Z]+)[ \t]*(.*)"
PUNT_URL = r"^([a-zA-Z]+)://([a-zA-Z0-9.-]+):?([0-9]*)/?(.*)"
PUNT_REFERRAL = r"^([a-zA-Z0-9.-]+):([0-9]*):([a-zA-Z]+)"
TOP_DOMAINS = ("EDU", "GOV", "COM", "NET", "ORG", "MIL", "INT")
# possessive repeats keep the nested ones from backtracking; what they match is the same
_DOMAIN = r"^(?:[.]?[a-zA-Z0-9-]++)++$|^.+[.][a-zA-Z]+$|^[.]$"


def is_domain_shape(c: Column | str) -> Column:
    """Whether a value has the form of a domain name."""
    return col(c).rlike(_DOMAIN)


def is_email(c: Column | str) -> Column:
    """Whether a value has the form of a mail address."""
    return col(c).rlike(r"^.+@(?:[a-zA-Z0-9-]+[.])+[a-zA-Z]+$")


def is_identifier(c: Column | str) -> Column:
    """Whether a value looks like an identifier: it has a dot."""
    return F.coalesce(F.contains(col(c), F.lit(".")), F.lit(False))


def is_net_text(c: Column | str) -> Column:
    """Whether a value roughly looks like a network: it has a slash."""
    return F.coalesce(F.contains(col(c), F.lit("/")), F.lit(False))


def is_domain_text(c: Column | str) -> Column:
    """Whether a value roughly looks like a domain: a dot, a known top domain or a country code."""
    return F.coalesce(F.contains(col(c), F.lit(".")) | ascii_upper(c).isin(*TOP_DOMAINS[:5]) | col(c).rlike("^[a-zA-Z]{2}$"), F.lit(False))


def hierarchical_domain(c: Column | str) -> Column:
    """The domain a value names or is mail for; null unless it ends in a known top domain or two characters."""
    v = col(c)
    top = F.substring_index(v, ".", -1)
    known = ascii_upper(top).isin(*TOP_DOMAINS) | (F.length(top) == 2)
    return F.when(known, F.substring_index(v, "@", -1))


def hierarchical(c: Column | str) -> Column:
    """Struct (kind, value): ``network`` with its canonical text or ``domain``; null if the value is neither."""
    v = col(c)
    parsed = net.parse(v)
    network = F.when(parsed.isNotNull(), F.struct(F.lit("network").alias("kind"), net.canonical(parsed).alias("value")))
    domain = hierarchical_domain(v)
    named = F.when(domain.isNotNull(), F.struct(F.lit("domain").alias("kind"), domain.alias("value")))
    return F.when(net.looks_like_network(v), network).when(is_domain_shape(v) | is_email(v), named)


def within_domain(sub: Column | str, domain: Column | str) -> Column:
    """Whether one name ends in the other, whatever the case; ``.`` holds all. Labels are no boundaries."""
    s, d = ascii_upper(sub), ascii_upper(domain)
    return F.coalesce((s != "") & is_domain_shape(domain) & (s.endswith(d) | (d == ".")), F.lit(False))


def within_area(kind: Column, value: Column, area: Column | str) -> Column:
    """Whether a hierarchical value lies in an authority area, a network or a domain."""
    a = col(area)
    inside = net.looks_like_network(a) & net.within(net.parse(value), net.parse(a))
    return F.coalesce(F.when(kind == "network", inside).when(kind == "domain", within_domain(value, a)), F.lit(False))


def without_first_label(c: Column | str) -> Column:
    """A domain without its leftmost label; null if it has one only."""
    v = col(c)
    return F.when(F.contains(v, F.lit(".")), F.regexp_replace(v, r"^[^.]*\.", ""))


def suffixes(c: Column | str) -> Column:
    """A domain and what is left as its labels are dropped one by one: the side to explode for an equi-join."""
    labels = F.split(col(c), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def referral_line(target: Column | str, area: Column | str) -> Column:
    """A referral's text: without trailing slashes, and with the area it is for unless it names one."""
    t = strip_trailing(trim_blanks(target), "/")
    named = F.contains(ascii_upper(t), F.lit("AUTH-AREA=")) | col(area).isNull() | (col(area) == "")
    return F.when(named, t).otherwise(F.concat(t, F.lit("/auth-area="), col(area)))


def url_parts(c: Column | str) -> Column:
    """Struct (protocol, host, port, path) of a referral URL, or of the older host:port:protocol form; null if neither."""
    v = col(c)
    take = lambda p, i: F.regexp_extract(v, p, i)
    parts = lambda p, a, b, x, y: F.struct(take(p, a).alias("protocol"), take(p, b).alias("host"), take(p, x).alias("port"), take(p, y).alias("path"))
    return F.when(v.rlike(URL), parts(URL, 1, 2, 3, 4)).when(v.rlike(OLD_REFERRAL), parts(OLD_REFERRAL, 3, 1, 2, 4))


def is_punt_reference(c: Column | str) -> Column:
    """Whether a line of an upward referral list is well formed."""
    return col(c).rlike(PUNT_URL) | col(c).rlike(PUNT_REFERRAL)


def split_arguments(line: str) -> list[str]:
    """Words of a command line; quotes of either kind and an opening brace keep blanks up to the same character again."""
    out, i = [], 0
    while i < len(line):
        while i < len(line) and line[i].isspace():
            i += 1
        if i >= len(line):
            break
        closing = line[i] if line[i] in "\"'{" else None
        i += closing is not None
        start = i
        while i < len(line) and (line[i] != closing if closing else not line[i].isspace()):
            i += 1
        out.append(line[start:i])
        i += 1
    return out


def java_pattern(pattern: str) -> str | None:
    """An old-style regular expression for Java: braces are plain characters, a backslash only takes away a meaning. Null if it is none."""
    out, i, in_set = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if in_set:
            first = out[-1] in ("[", "[^")
            out.append("\\" + c if c in "\\[&" else c)
            in_set = not (c == "]" and not first)
        elif c == "\\":
            i += 1
            if i >= len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif c == "[":
            out.append("[^" if pattern[i + 1 : i + 2] == "^" else "[")
            i += out[-1] == "[^"
            in_set = True
        else:
            out.append("\\" + c if c in "{}" else c)
        i += 1
    joined = "".join(out)
    if in_set:
        return None
    try:
        re.compile(joined)
    except re.error:
        return None
    return joined


def matches_format(c: Column | str, pattern: str) -> Column:
    """Whether a value, in upper case, matches an attribute's format; a format that cannot be compiled is met by every value."""
    java = java_pattern(pattern)
    return F.lit(True) if java is None else ascii_upper(c).rlike(java)


def substitute(template: str) -> Callable[[re.Match], str]:
    """What a substitution text makes of a match: ``&`` is all of it, ``\\1`` to ``\\9`` its groups."""

    def fill(m: re.Match) -> str:
        return re.sub(r"\\([0-9&\\])|&", lambda t: m[0] if t[0] == "&" or t[1] == "0" else t[1] if t[1] in "&\\" else (m[int(t[1])] or "") if int(t[1]) <= (m.re.groups or 0) else "", template)

    return fill


def base_name(path: str) -> str:
    """The last part of a path."""
    return path.rstrip("/").rpartition("/")[2]


def directory(path: str) -> str:
    """The path without its last part."""
    return path.rstrip("/").rpartition("/")[0] or ("/" if path.startswith("/") else "")


def joined_path(folder: str, path: str) -> str:
    """A path as seen from a folder: absolute paths stay."""
    return path if path.startswith("/") or not folder else f"{folder.rstrip('/')}/{path}"
