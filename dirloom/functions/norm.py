"""Text normalisation as Columns: blanks, ASCII folding, control characters."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` over values that are evaluated once each, however often it names them.

    Catalyst merges expressions by substitution, which multiplies nested ones; a lambda variable
    is never substituted.
    """
    given = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(given), lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), 1)


def trim_blanks(c: Column | str) -> Column:
    """Without outer white space of any kind (spaces, tabs, line ends, Unicode spaces)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+\z", "")


def ascii_upper(c: Column | str) -> Column:
    """Upper case of a-z only; other letters stay, as byte-wise comparison needs."""
    return F.translate(col(c), string.ascii_lowercase, string.ascii_uppercase)


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A-Z only."""
    return F.translate(col(c), string.ascii_uppercase, string.ascii_lowercase)


def name_key(c: Column | str) -> Column:
    """Key under which names are compared: lower case, no outer blanks."""
    return F.lower(trim_blanks(c))


def strip_control(c: Column | str) -> Column:
    """Without control characters other than tab."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0A-\x1F\x7F]", "")


def compact_blanks(c: Column | str) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(col(c), r"\s+", " ")


def count_char(c: Column | str, char: str) -> Column:
    """How often ``char`` occurs."""
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit(char), F.lit("")))


def on_off(c: Column | str) -> Column:
    """``ON`` or ``OFF`` for a boolean, ``OFF`` for null."""
    return F.when(col(c), F.lit("ON")).otherwise(F.lit("OFF"))


def true_false(c: Column | str) -> Column:
    """``TRUE`` or ``FALSE`` for a boolean, ``FALSE`` for null."""
    return F.when(col(c), F.lit("TRUE")).otherwise(F.lit("FALSE"))


def is_truthy(c: Column | str) -> Column:
    """Whether a flag text means yes: ON, YES or TRUE in any case."""
    return F.coalesce(ascii_upper(trim_blanks(c)).isin("ON", "YES", "TRUE"), F.lit(False))


def trim_left(c: Column | str) -> Column:
    """Without white space at the start (the six ASCII kinds)."""
    return F.regexp_replace(col(c), r"^[ \t\n\x0B\f\r]+", "")


def trim_right(c: Column | str) -> Column:
    """Without white space at the end (the six ASCII kinds)."""
    return F.regexp_replace(col(c), r"[ \t\n\x0B\f\r]+\z", "")


def strip_char(c: Column | str, char: str) -> Column:
    """Without any occurrence of ``char``."""
    return F.replace(col(c), F.lit(char), F.lit(""))


def strip_leading(c: Column | str, char: str) -> Column:
    """Without the run of ``char`` at the start."""
    return F.ltrim(col(c), F.lit(char))


def strip_trailing(c: Column | str, char: str) -> Column:
    """Without the run of ``char`` at the end."""
    return F.rtrim(col(c), F.lit(char))


def count_blanks(c: Column | str) -> Column:
    """How many characters are white space."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), r"\s", ""))


def find_folded(c: Column | str, needle: Column | str) -> Column:
    """1-based place of ``needle`` whatever the ASCII case, 0 if absent; an empty needle or text has no place."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.when((n == "") | (col(c) == ""), 0).otherwise(F.position(ascii_upper(n), ascii_upper(c)))


def same_folded(a: Column | str, b: Column | str) -> Column:
    """Equality whatever the ASCII case."""
    return ascii_upper(a) == ascii_upper(b)


def starts_folded(c: Column | str, prefix: Column | str) -> Column:
    """Prefix test whatever the ASCII case."""
    return ascii_upper(c).startswith(ascii_upper(F.lit(prefix) if isinstance(prefix, str) else prefix))


def fields(c: Column | str, sep: str, most: int = -1) -> Column:
    """Fields between one-character separators; with ``most`` the last one keeps the rest, separators included."""
    import re

    return F.split(col(c), re.escape(sep), most)
