"""Five-letter phonetic codes of words, and keys of values made of them.

The code is none of the built-in ones, so it is computed in Python, over Arrow batches and once
per distinct word of a batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 5
# fixed classes of letters
VOWELS, PLAIN, HARD, FRONT, KEEPS_GH = frozenset("AEIOU"), frozenset("FJLMNR"), frozenset("CGPST"), frozenset("EIY"), frozenset("BDH")
#: Fixed: first letters that are silent before certain second ones.
SILENT_STARTS = frozenset({"PN", "KN", "GN", "AE", "WR"})


def _start(word: str) -> str:
    if word[:2] in SILENT_STARTS:
        return word[1:]
    if word[:2] == "WH":
        return "W" + word[2:]
    return "S" + word[1:] if word[0] == "X" else word


@lru_cache(maxsize=100_000)
def code(word: str) -> str:
    """Code of one word by its ASCII letters; empty if it has none."""
    w = _start(letters) if (letters := re.sub("[^A-Z]", "", word.upper())) else ""
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    out, raw = "", -1
    for i, c in enumerate(w):
        if len(out) >= LONGEST:
            break
        if i == raw:
            out += c
            continue
        before, after, third = at(i - 1), at(i + 1), at(i + 2)
        if c == before and c != "C":
            continue
        if c in PLAIN:
            out += c
        elif c in VOWELS:
            out += c if i == 0 else ""
        elif c == "B":
            out += "B"
        elif c == "C":
            out += _c(i, before, after, third)
        elif c == "D":
            out += "J" if after == "G" and third in FRONT else "T"
        elif c == "G":
            out += _g(w, i, before, after, third)
        elif c == "H":
            out += "H" if before not in HARD and (before not in VOWELS or after in VOWELS) else ""
        elif c == "K":
            out += "" if before == "C" else "K"
        elif c == "P":
            out += "F" if after == "H" else "P"
        elif c == "Q":
            out += "K"
        elif c == "S":
            out += "X" if after == "H" or (after == "I" and third in ("O", "A")) else "S"
        elif c == "T":
            out += "X" if after == "I" and third in ("O", "A") else "O" if after == "H" else "" if after + third == "CH" else "T"
        elif c == "V":
            out += "F"
        elif c in "WY":
            out += c if after in VOWELS else ""
        elif c == "X":
            out += "S" if i == 0 else "K"
            raw = i + 1 if i else -1
        elif c == "Z":
            out += "S"
    return out[:LONGEST]


def _c(i: int, before: str, after: str, third: str) -> str:
    if before == "S" and after in FRONT:
        return ""
    if after == "I" and third == "A":
        return "X"
    if after in FRONT:
        return "S"
    if after == "H":
        return "K" if (i == 0 and third not in VOWELS) or before == "S" else "X"
    return "K"


def _g(w: str, i: int, before: str, after: str, third: str) -> str:
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    sounded = (after != "H" or third in VOWELS) and (after != "N" or (len(w) > i + 2 and w[i + 2 : i + 4] != "ED")) and (before != "D" or after not in FRONT)
    if sounded:
        return "J" if after in FRONT and third != "G" else "K"
    return "F" if after == "H" and at(i - 3) not in KEEPS_GH and at(i - 4) != "H" else ""


def key_of(value: str | None) -> str | None:
    """Codes of a value's words joined by blanks; what is no letter parts words, control characters vanish. Null if nothing is left."""
    if value is None:
        return None
    words = re.sub(r"[^A-Za-z\s]", " ", re.sub(r"[\x00-\x08\x0A-\x1F\x7F]", "", value)).split()
    return " ".join(c for c in map(code, words) if c) or None


def phonetic_key(c: Column) -> Column:
    """``key_of`` as a Column, over Arrow batches."""

    @F.pandas_udf("string")
    def coded(v: pd.Series) -> pd.Series:
        once = {x: key_of(x) for x in v.dropna().unique()}
        return v.map(once, na_action="ignore").astype(object).where(v.notna(), None)

    return coded(c)


def can_be_phonetic(value: str) -> bool:
    """Whether a query value may be searched by sound: letters and blanks only."""
    return bool(value) and bool(re.fullmatch(r"[A-Za-z\s]+", value))
