"""Per-line statistics of texts, and the kind of text they speak for: prose, list, table or junk.

Statistics are taken line by line with array operations over whole batches of texts. Thresholds
on them are labelling functions: each votes for a kind, against prose, or not at all, and each
errs. How often each votes what for lines of each kind is learned by expectation-maximization
from how the votes agree, over the counts of all vote patterns of the corpus; the result is every
pattern's posterior over the kinds. A text's share of a kind is that of its characters.

Fluency is measured without any list of words of a language: the most frequent words of the
corpus itself are its common words, and pairs of them that follow each other much more often
than chance are its idiom. Running text of any language in the corpus is made of such pairs;
lists, menus and words in random order are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

KINDS = ("prose", "list", "table", "dump", "noise", "menu", "repeat", "scramble")
#: The type of text each kind counts as.
TYPES = {"prose": ("prose",), "list": ("list",), "table": ("table", "dump"), "junk": ("noise", "menu", "repeat", "scramble")}
#: Size of the corpus's own list of common words; their pairs are at most its square.
COMMON = 2048
#: A pair is idiom if it is this many times as frequent as by chance, and makes up this share of all pairs (three at least).
LIFT, PAIR_SHARE, PAIR_LEAST = 2.0, 1e-5, 3
#: Code points that are taken apart at once.
CHUNK = 1_000_000
#: Words back to which a run of six words counts as said before.
REPEAT_SPAN = 64
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SYMBOL, _LOWER, _UPPER, _DIGIT, _BLANK = range(5)


@lru_cache(maxsize=1)
def _point_kinds() -> np.ndarray:
    """Symbol, lower-case (or caseless) letter, upper-case letter, digit or blank, for every code point."""
    of = np.zeros(0x110000, np.uint8)
    of[0x20000:0x40000] = _LOWER  # ideographs
    for c in range(0x20000):
        ch = chr(c)
        if ch.isspace() or c == 0xFEFF:
            of[c] = _BLANK
        elif ch.isdigit():
            of[c] = _DIGIT
        elif ch.isupper() or ch.istitle():
            of[c] = _UPPER
        elif ch.isalpha():
            of[c] = _LOWER
    return of


@lru_cache(maxsize=1)
def _lower_points() -> np.ndarray:
    """Each code point in lower case, where that is one code point."""
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):  # no letter beyond has a case
        s = chr(c).lower()
        if len(s) == 1:
            low[c] = ord(s)
    return low


class Text:
    """Texts set end to end: their points, lines and words. A word is what is between blanks, by its letters and digits in lower case."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        self.points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kind = _point_kinds()[self.points]
        newline = self.points == 10
        self.line_start = np.r_[0, np.flatnonzero(newline) + 1]
        self.line_end = np.r_[np.flatnonzero(newline), len(self.points)]
        self.line_text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.line_start, side="right")
        said = np.zeros(len(self.points) + 2, bool)
        said[1:-1] = self.kind != _BLANK
        edge = np.flatnonzero(said[1:] != said[:-1])
        self.token_start, self.token_end = edge[::2], edge[1::2]
        sound = (self.kind == _LOWER) | (self.kind == _UPPER) | (self.kind == _DIGIT)
        upto = np.r_[0, np.cumsum(sound)]
        length = upto[self.token_end] - upto[self.token_start]
        named = length > 0
        self.start, self.end, length = self.token_start[named], self.token_end[named], length[named]
        self.value = np.zeros(0, np.uint64)
        if len(length):
            first = np.cumsum(length) - length
            power = np.ones(int(length.max()), np.uint64)
            with np.errstate(over="ignore"):
                power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _MUL))
                weight = (_lower_points()[self.points[sound]].astype(np.uint64) + np.uint64(1)) * power[np.arange(int(length.sum())) - np.repeat(first, length)]
                value = np.add.reduceat(weight, first)
                self.value = (value ^ value >> np.uint64(31)) * _MIX
        self.line_of = np.cumsum(newline)  # of each code point but line ends
        self.line = self.line_of[self.start]
        self.text = self.line_text[self.line]

    def neighbours(self) -> np.ndarray:
        """For each word but the last whether the next one follows it in the text after a single blank or line end."""
        if len(self.start) < 2:
            return np.zeros(0, bool)
        return (self.start[1:] - self.end[:-1] == 1) & (self.text[1:] == self.text[:-1]) & (self.points[self.end[:-1]] != 9)

    def repeated(self) -> np.ndarray:
        """For each word whether the six words from it on were said at most ``REPEAT_SPAN`` words before, in the same text."""
        out = np.zeros(len(self.value), bool)
        if len(self.value) < 7:
            return out
        with np.errstate(over="ignore"):
            six = self.value[:-5].copy()
            for i in range(1, 6):
                six = six * _MUL + self.value[i : len(self.value) - 5 + i]
        order = np.argsort(six, kind="stable")
        order = order[self.text[order] == self.text[order + 5]]  # within one text
        same = (six[order][1:] == six[order][:-1]) & (order[1:] - order[:-1] <= REPEAT_SPAN) & (self.text[order[1:]] == self.text[order[:-1]])
        out[order[1:][same]] = True
        return out


class Idiom:
    """The common words of a corpus and their idiomatic pairs."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray) -> None:
        self.words = np.sort(words)
        self.good = np.zeros(len(words) ** 2, bool)
        self.good[pairs] = True

    def rank(self, value: np.ndarray) -> np.ndarray:
        """Place of each word among the common ones, -1 if it is none."""
        if not len(self.words):
            return np.full(len(value), -1)
        at = np.searchsorted(self.words, value).clip(max=len(self.words) - 1)
        return np.where(self.words[at] == value, at, -1)

    def pairs(self, text: Text, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each neighbouring pair of words the pair's number, -1 if a word is not common; and whether they are neighbours."""
        r, near = self.rank(text.value) if rank is None else rank, text.neighbours()
        both = near & (r[:-1] >= 0) & (r[1:] >= 0) if len(near) else near
        return np.where(both, r[:-1] * len(self.words) + r[1:], -1) if len(near) else np.zeros(0, int), near


#: What statistics ``lines`` gives of each line.
STATISTICS = ("chars", "letters", "upper", "digits", "symbols", "words", "common", "pairs", "both", "idiom", "fields", "colons", "items", "marked", "ended", "closed", "plain", "longest", "repeats", "alike")


def lines(text: Text, idiom: Idiom) -> pd.DataFrame:
    """The statistics of each line, blank ones left out, with the number of its text.

    chars: those that are no blanks; common, pairs, both, idiom: words that are common,
    neighbouring pairs of words, those of two common words, and idiomatic ones; fields: tabs, bars, commas and semicolons without blank
    behind, and gaps of two and more blanks inside the line; colons: those inside tokens; items:
    bars, slashes and angle quotes that stand alone, and such gaps; marked: the line begins like a list item; ended:
    words that end a
    sentence; closed: the line ends in punctuation; plain: words of letters, with one other character at most; longest: of the tokens;
    repeats: words said just before; alike: the line has the same marks in the same order, or the
    same number of them, as a neighbour.
    """
    p, kind, n = text.points, text.kind, len(text.line_start)

    def per(mask: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(mask)]
        return upto[text.line_end] - upto[text.line_start]

    def at_line(place: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(text.line_of[place], weights=weights, minlength=n)

    following = np.r_[kind[1:], np.uint8(_BLANK)]
    before = np.r_[np.uint8(_BLANK), kind[:-1]]
    tight = following != _BLANK
    tab = p == 9
    gap_at = text.token_end[:-1] if len(text.token_end) else text.token_end
    tokens = text.line_of[text.token_start]
    wide = (text.token_start[1:] - gap_at >= 2) & (tokens[1:] == tokens[:-1]) if len(gap_at) else np.zeros(0, bool)
    bars = p == ord("|")
    commas = ((p == ord(",")) | (p == ord(";"))) & (tight | (following == _BLANK) & (np.r_[p[1:], np.uint32(10)] == 10))
    alone = (bars | (p == ord("/")) | (p == 0xBB)) & ~tight & (before == _BLANK)

    rank = idiom.rank(text.value)
    pair, near = idiom.pairs(text, rank)
    good = np.zeros(len(pair), bool)
    good[pair >= 0] = idiom.good[pair[pair >= 0]]
    word_line = text.line

    def by_word(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at[mask], minlength=n)

    # a line's first token says whether it is marked: a bullet, a box, or a short number or letter with a dot or bracket
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, int)
    fs, fe = text.token_start[first], text.token_end[first]
    size = fe - fs
    head, tail = p[fs], p[(fe - 1).clip(0)]
    inner = np.zeros(len(first), bool)
    inner[size == 2] = np.isin(kind[fs[size == 2]], (_LOWER, _UPPER, _DIGIT))
    three = (size == 3) | (size == 4)
    inner[three] = (kind[fs[three]] == _DIGIT) & (kind[fs[three] + 1] == _DIGIT)
    dashes = (size == 2) & (head == ord("-")) & (tail == ord("-"))
    bullet = dashes | (size == 1) & np.isin(head, [ord(c) for c in "-*+•·–—◦▪‣o"]) | (head == ord("[")) & (size <= 3) | inner & np.isin(tail, [ord(c) for c in ".)"]) | (head == ord("(")) & (tail == ord(")")) & (size <= 4)
    alone_in_line = np.r_[np.diff(tokens) != 0, True][first] if len(first) else np.zeros(0, bool)
    marked = np.zeros(n, bool)
    marked[tokens[first]] = bullet & ~alone_in_line

    last = p[(text.end - 1).clip(0)] if len(text.end) else np.zeros(0, np.uint32)
    last2 = p[(text.end - 2).clip(0)] if len(text.end) else last
    closing = np.isin(last, [ord(c) for c in "\"'”’»)"])
    ends = np.isin(np.where(closing, last2, last), [ord(c) for c in ".?!"])
    before_end = kind[(text.end - 2).clip(0)] if len(text.end) else np.zeros(0, np.uint8)
    ends &= np.isin(before_end, (_LOWER, _UPPER, _DIGIT)) & ((text.end - text.start) > 2)
    ends &= ~np.isin(text.start, fs[bullet & ~alone_in_line])  # the number of a list item ends nothing
    letters = np.r_[0, np.cumsum((kind == _LOWER) | (kind == _UPPER))]
    plain = (letters[text.end] - letters[text.start]) >= np.maximum(1, text.end - text.start - 1)

    fields = at_line(np.flatnonzero(tab | bars | commas)) + (at_line(text.token_start[1:][wide]) if len(gap_at) else 0)
    slash = np.r_[p[1:], np.uint32(10)] == ord("/")
    colons = per((p == ord(":")) & tight & (before != _BLANK) & ~slash)
    length = text.token_end - text.token_start
    longest = np.zeros(n, int)
    np.maximum.at(longest, tokens, length)
    last_token = np.flatnonzero(np.r_[tokens[1:] != tokens[:-1], True]) if len(tokens) else np.zeros(0, int)
    closed = np.zeros(n, bool)
    closed[tokens[last_token]] = np.isin(p[text.token_end[last_token] - 1], [ord(c) for c in ".,;:!?…\"'”’»)"])
    out = pd.DataFrame({
        "text": text.line_text, "chars": per(kind != _BLANK), "letters": per((kind == _LOWER) | (kind == _UPPER)), "upper": per(kind == _UPPER), "digits": per(kind == _DIGIT), "symbols": per(kind == _SYMBOL),
        "words": np.bincount(word_line, minlength=n), "common": by_word(rank >= 0, word_line), "pairs": by_word(near, word_line[1:]), "both": by_word(pair >= 0, word_line[1:]), "idiom": by_word(good, word_line[1:]), "fields": fields, "colons": colons,
        "items": at_line(np.flatnonzero(alone)) + (at_line(text.token_start[1:][wide]) if len(gap_at) else 0), "marked": marked, "ended": by_word(ends, word_line), "closed": closed, "plain": by_word(plain, word_line), "longest": longest, "repeats": by_word(text.repeated(), word_line),
    })
    out = out[out["chars"] > 0].reset_index(drop=True)
    shape = out["fields"].to_numpy() * 64 + out["colons"].to_numpy()
    same = np.zeros(len(out) + 1, bool)
    same[1:-1] = (shape[1:] == shape[:-1]) & (shape[1:] >= 2 * 1) & (out["text"].to_numpy()[1:] == out["text"].to_numpy()[:-1]) if len(out) > 1 else False
    out["alike"] = same[1:] | same[:-1]
    return out


def _around(x: pd.DataFrame, *names: str) -> list[np.ndarray]:
    """Sums of statistics over each line and its two neighbours in the same text."""
    text = x["text"].to_numpy()
    near = text[1:] == text[:-1]
    sums = []
    for name in names:
        v = x[name].to_numpy().astype(float)
        s = v.copy()
        s[1:] += np.where(near, v[:-1], 0)
        s[:-1] += np.where(near, v[1:], 0)
        sums.append(s)
    return sums


#: Labelling functions: name, and for each of its votes (0 is none) the kinds it speaks for at first.
FUNCTIONS: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("fluent", (("prose",), ("list", "table", "dump", "noise"))),
    ("few common words", (("list", "table", "dump", "noise"),)),
    ("marked", (("list",),)),
    ("fields", (("table",), ("table", "menu"))),
    ("colons", (("dump",),)),
    ("symbols", (("noise",), ("table", "dump", "noise"))),
    ("digits", (("table", "dump"),)),
    ("long tokens", (("noise",), ("table", "dump", "noise"))),
    ("repeated", (("repeat",),)),
    ("sentence end", (("prose",),)),
    ("few plain words", (("list", "table", "dump", "noise"),)),
    ("alike", (("table", "dump"),)),
    ("items", (("menu",),)),
    ("short line", (("list",),)),
    ("scrambled", (("scramble",),)),
)


def votes(x: pd.DataFrame) -> np.ndarray:
    """The vote of each labelling function (columns, as in ``FUNCTIONS``) on each line: 0 none, else the number of what it says."""
    c = {k: x[k].to_numpy() for k in STATISTICS}
    chars, words = np.maximum(c["chars"], 1), np.maximum(c["words"], 1)
    idiom, pairs, both, near_words, near_common = _around(x, "idiom", "pairs", "both", "words", "common")
    fluency3 = idiom / np.maximum(pairs, 1)
    # a line of few pairs is judged with its neighbours
    fluency = np.where(c["pairs"] >= 5, c["idiom"] / np.maximum(c["pairs"], 1), fluency3)
    text = x["text"].to_numpy()
    n_texts = int(text.max()) + 1 if len(text) else 0
    over = np.bincount(text, weights=c["repeats"], minlength=n_texts) / np.maximum(1, np.bincount(text, weights=c["words"], minlength=n_texts))
    mean = c["chars"] / words
    short = (c["chars"] <= 40) & (c["words"] <= 4)
    (beside,) = _around(x.assign(_short=short & (c["ended"] == 0)), "_short")

    def dense(marks: np.ndarray) -> np.ndarray:
        return marks * 8 >= words

    def say(*tests: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint8)
        for i, test in reversed([*enumerate(tests, 1)]):
            out[test] = i
        return out

    return np.stack([
        say((pairs >= 2) & (fluency >= 0.45) | (fluency >= 0.15) & (idiom >= 0.8 * both), (near_words >= 4) & (fluency <= 0.25)),
        say((c["words"] >= 2) & (c["common"] / words <= 0.35)),
        say(c["marked"]),
        say((c["fields"] >= 3) & dense(c["fields"]), (c["fields"] == 2) & dense(c["fields"])),
        say((c["colons"] >= 2) & dense(c["colons"])),
        say(c["symbols"] / chars > 0.45, c["symbols"] / chars > 0.2),
        say(c["digits"] / chars > 0.25),
        say((c["longest"] >= 40) | (c["words"] == 0), mean > 14),
        say((c["repeats"] / words >= 0.5) | (over[text] >= 0.4)),
        say(c["ended"] > 0),
        say((c["words"] >= 2) & (c["plain"] / words <= 0.25)),
        say(c["alike"]),
        say((c["items"] >= 1) & (words <= 4.5 * (c["items"] + 1))),
        say(short & (beside >= 2) & (c["ended"] == 0)),
        say((near_words >= 8) & (pairs >= 6) & (near_common >= 0.75 * near_words) & (fluency3 <= 0.35)),
    ], 1)


#: What the first belief in a function weighs against the lines, as a share of them.
STRENGTH = 0.1
#: Functions on layout may err, but not more often than this: the share of lines of other kinds on which they vote is held below it.
LAYOUT = {"marked": 0.003, "fields": 0.003, "colons": 0.003, "repeated": 0.003, "items": 0.001, "scrambled": 0.003}
_BASES = np.array([len(says) + 1 for _, says in FUNCTIONS], np.int64)
_PLACES = np.cumprod(np.r_[1, _BASES[:-1]])


def patterns(v: np.ndarray) -> np.ndarray:
    """Each line's votes as one number."""
    return v.astype(np.int64) @ _PLACES


def learn(pattern: np.ndarray, count: np.ndarray, strength: float = STRENGTH, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the kinds for each vote pattern, and each function's learned accuracy, by expectation-maximization.

    A line has one kind; given it, functions vote independently. First each function is taken to
    vote for the kinds it names 25 times as often as for others; that belief stays as a prior
    worth ``strength`` of the lines, so that kinds keep their meaning. Accuracy is the chance that
    a vote of the function speaks for the line's kind.
    """
    k = len(KINDS)
    v = pattern[:, None] // _PLACES % _BASES
    weight = count.astype(float)
    prior, belief = np.full(k, 1 / k), []
    for j, (_, says) in enumerate(FUNCTIONS):
        b = np.full((k, _BASES[j]), 0.02)
        b[:, 0] = 0.5
        for i, kinds in enumerate(says, 1):
            b[[KINDS.index(x) for x in kinds], i] = 0.5
        belief.append(b / b.sum(1, keepdims=True))
    chance = [b.copy() for b in belief]
    total = max(weight.sum(), 1.0)
    last = None
    for _ in range(rounds):
        log = np.log(prior) + sum(np.log(c[:, v[:, j]]).T for j, c in enumerate(chance))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        if last is not None and np.abs(post - last).max() < 1e-6:
            break
        last = post
        mass = post * weight[:, None]
        prior = (mass.sum(0) + strength * total / k) / (total * (1 + strength))
        for j, c in enumerate(chance):
            got = np.stack([np.bincount(v[:, j], weights=mass[:, x], minlength=_BASES[j]) for x in range(k)])
            chance[j] = got + strength * total / k * belief[j]
            chance[j] /= chance[j].sum(1, keepdims=True)
            for i, kinds in enumerate(FUNCTIONS[j][1], 1):
                other = [x for x in range(k) if KINDS[x] not in kinds]
                chance[j][other, i] = np.minimum(chance[j][other, i], LAYOUT.get(FUNCTIONS[j][0], 1.0))
            chance[j][:, 0] = 1 - chance[j][:, 1:].sum(1)
    right = []
    for j, (_, says) in enumerate(FUNCTIONS):
        cast = prior[:, None] * chance[j][:, 1:]
        fit = np.array([[KINDS[x] in kinds for kinds in says] for x in range(k)])
        right.append(float((cast * fit).sum() / cast.sum()))
    # lines on which no function votes have nothing against them
    post[pattern == 0] = np.eye(k)[KINDS.index("prose")]
    return post, np.array(right)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the rows that have a text, some ``CHUNK`` code points at a time; a text is never cut."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not text:
                continue
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


class _Counts:
    """Numbers and how often each came, added up where they are."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        v, n = np.unique(values, return_counts=True)
        self.parts.append((v, n))
        self.size += len(v)
        if self.size > 2_000_000 and len(self.parts) > 8:
            self.merge()

    def merge(self) -> None:
        v, at = np.unique(np.concatenate([v for v, _ in self.parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in self.parts])).astype(np.int64)
        self.parts, self.size = [(v, n)], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            v, n = self.parts[0]
            for i in range(0, len(v), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["v", "n"])


def idiom(docs: DataFrame) -> Idiom:
    """The common words and idiomatic pairs of a corpus, counted over all of it in two scans.

    What comes to the driver is the model: ``COMMON`` words, and pairs of which each makes up
    ``PAIR_SHARE`` of all, so that there are at most 1 / ``PAIR_SHARE`` of them.
    """
    source = docs.select("doc_id", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for _, texts in _chunks(batches):
            counts.add(Text(texts).value)
        yield from counts.batches()

    top = source.mapInArrow(words, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "v").limit(COMMON).collect()
    common = Idiom(np.array([r["v"] for r in top], np.int64).view(np.uint64), np.zeros(0, int))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for _, texts in _chunks(batches):
            code, _ = common.pairs(Text(texts))
            counts.add(code[code >= 0].astype(np.int64))
        yield from counts.batches()

    width = max(1, len(common.words))
    seen = source.mapInArrow(pairs, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n"))
    # cut, for it is read four times and Python stages are never shared
    seen = cut(seen.select("v", "n", F.expr(f"v div {width}").alias("a"), F.expr(f"v % {width}").alias("b")))
    total = seen.agg(F.sum("n").alias("all"))
    # marginals of at most COMMON rows each
    first, second = seen.groupBy("a").agg(F.sum("n").alias("na")), seen.groupBy("b").agg(F.sum("n").alias("nb"))
    joined = seen.join(F.broadcast(first), "a").join(F.broadcast(second), "b").withColumn("all", total.scalar())
    good = joined.where((F.col("n") >= PAIR_LEAST) & (F.col("n") >= F.col("all") * PAIR_SHARE) & (F.col("n") * F.col("all") >= F.col("na") * F.col("nb") * LIFT)).select("v")
    return Idiom(common.words, np.array([r["v"] for r in good.collect()], np.int64))


def statistics(docs: DataFrame, model: Idiom | None = None) -> DataFrame:
    """Per document: chars (no blanks), lines, words, mean_word, symbol_ratio, digit_ratio, closed_lines, marked_lines, common_words, idiom_pairs.

    Ratios are shares of the document's chars, lines, words and neighbouring pairs of words; all
    but the counts are null where there is nothing to divide by. Blank lines do not count. A null
    or blank text has a row of zeros and nulls. One row per row of ``docs``.
    """
    model = model or idiom(docs)
    names = ("chars", "lines", "words", "sound", "symbols", "digits", "closed", "marked", "common", "pairs", "idiom")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            x = lines(Text(texts), model)
            x["lines"], x["sound"] = 1, x["letters"] + x["digits"]
            sums = [np.bincount(x["text"], weights=x[k], minlength=len(ids)).astype(np.int64) for k in names]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, sums)], names=["doc_id", *names])

    sums = docs.select("doc_id", "text").mapInArrow(measure, "doc_id bigint, " + ", ".join(f"{k} bigint" for k in names))
    blank = docs.where("text IS NULL OR text = ''").select("doc_id", *[F.lit(0).cast("bigint").alias(k) for k in names])
    share = lambda a, b, name: F.try_divide(F.col(a), F.col(b)).alias(name)
    return sums.union(blank).select("doc_id", "chars", "lines", "words", share("sound", "words", "mean_word"), share("symbols", "chars", "symbol_ratio"), share("digits", "chars", "digit_ratio"), share("closed", "lines", "closed_lines"), share("marked", "lines", "marked_lines"), share("common", "words", "common_words"), share("idiom", "pairs", "idiom_pairs"))


def _posteriors(group: pd.DataFrame) -> pd.DataFrame:
    post, _ = learn(group["pattern"].to_numpy(), group["lines"].to_numpy())
    return pd.DataFrame({"pattern": group["pattern"].to_numpy(), **{t: post[:, [KINDS.index(k) for k in kinds]].sum(1) for t, kinds in TYPES.items()}})


def text_types(docs: DataFrame, model: Idiom | None = None) -> DataFrame:
    """(doc_id, chars, prose, list, table, junk, type): posterior share of each type in a document's characters, and the largest.

    Whole texts are read line by line; documents of null or blank text have no row. Rows with the
    same doc_id are one document. Votes are cut once to the shared folder, a few numbers per
    document; there are at most as many vote patterns as the functions have votes, some 166,000,
    and expectation-maximization runs over their counts.
    """
    model = model or idiom(docs)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            x = lines(Text(texts), model)
            if x.empty:
                continue
            x["pattern"], x["lines"] = patterns(votes(x)), 1
            got = x.groupby(["text", "pattern"], sort=False, as_index=False)[["lines", "chars"]].sum()
            yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t in got["text"]], pa.int64()), *(pa.array(got[k].to_numpy(np.int64)) for k in ("pattern", "lines", "chars"))], names=["doc_id", "pattern", "lines", "chars"])

    cast = cut(docs.select("doc_id", "text").mapInArrow(vote, "doc_id bigint, pattern bigint, lines bigint, chars bigint"))
    counts = cast.groupBy("pattern").agg(F.sum("lines").alias("lines"))
    post = counts.groupBy().applyInPandas(_posteriors, "pattern bigint, " + ", ".join(f"{t} double" for t in TYPES))
    shares = cast.join(F.broadcast(post), "pattern").groupBy("doc_id").agg(F.sum("chars").alias("chars"), *[(F.sum(F.col("chars") * F.col(t)) / F.sum("chars")).alias(t) for t in TYPES])
    most = F.greatest(*TYPES)
    kind = F.coalesce(*[F.when(F.col(t) == most, F.lit(t)) for t in TYPES])
    return shares.withColumn("type", kind)


def not_prose(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents more than half of whose characters belong to lists, tables or junk."""
    return text_types(docs).where("prose < 0.5").select("doc_id")
