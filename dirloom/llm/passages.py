"""Passages of held-out items in a corpus, by Wu-Manber search over words.

Every run of ``RUN`` words of an item is a pattern. A table over blocks of two words says how far
a window may be moved on when it ends in that block: positions at which no pattern can end are
never looked at. Where the shift is zero, the patterns that end in the block are found by their
suffix's hash and compared word by word. Documents are searched side by side, whole, where they
are; nothing of the corpus is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RUN = 12  # words of a pattern
#: Words of items searched for in one scan; more items take further scans.
BLOCK_WORDS = 2_000_000
#: Code points that are taken apart at once.
CHUNK = 1_500_000
_SHIFT_BITS = 20
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def folded(text: str) -> str:
    """Lower case, with the letters that upper case makes equal."""
    return text.lower().replace("ß", "ss").replace("i̇", "i").replace("ς", "σ")


class Words:
    """The words of texts set end to end: a hash of each, the text it is in, and where it is."""

    def __init__(self, texts: list[str]) -> None:
        low = [folded(t) for t in texts]
        self.joined = "\n".join(low)
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = _word_points()[points]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), self.start, side="right")
        self.value = np.zeros(0, np.uint64)
        if len(self.start):
            # value of a word: its code points weighted by powers of an odd constant
            length = self.end - self.start
            first = np.cumsum(length) - length
            power = np.ones(int(length.max()), np.uint64)
            with np.errstate(over="ignore"):
                power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _MUL))
                weight = (points[inside[1:-1]].astype(np.uint64) + np.uint64(1)) * power[np.arange(length.sum()) - np.repeat(first, length)]
                value = np.add.reduceat(weight, first)
                self.value = (value ^ value >> np.uint64(31)) * _MIX

    def words(self, first: int, n: int) -> tuple[str, ...]:
        return tuple(self.joined[a:b] for a, b in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True))

    def blocks(self) -> np.ndarray:
        """Hash of the two words that end at each word."""
        with np.errstate(over="ignore"):
            return self.value ^ (np.r_[np.uint64(0), self.value[:-1]] * _MUL >> np.uint64(7))


class Patterns:
    """Tables for the patterns of some items; items of fewer than ``RUN`` words have none."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        w = Words([t for _, t in items])
        blocks = w.blocks()
        # a block that no pattern has lets the window move on by all but one of its words
        self.shift = np.full(1 << _SHIFT_BITS, RUN - 1, np.uint8)
        self.bucket: dict[int, dict[int, list[tuple[tuple[str, ...], set[int]]]]] = {}
        last = np.flatnonzero(w.text[RUN - 1 :] == w.text[: len(w.text) - RUN + 1]) + RUN - 1 if len(w.text) >= RUN else np.zeros(0, int)
        for back in range(RUN - 1):
            np.minimum.at(self.shift, self.slot(blocks[last - back]), back)
        for end in last.tolist():
            words = w.words(end - RUN + 1, RUN)
            prefixes = self.bucket.setdefault(int(blocks[end]), {})
            same = prefixes.setdefault(int(w.value[end - RUN + 1]), [])
            item = items[int(w.text[end])][0]
            for known, ids in same:
                if known == words:
                    ids.add(item)
                    break
            else:
                same.append((words, {item}))

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)

    def search(self, texts: list[str]) -> set[tuple[int, int]]:
        """(text, item) of all texts that hold a pattern of the item."""
        w, found = Words(texts), set()
        if len(w.value) < RUN:
            return found
        blocks = w.blocks()
        slots = self.slot(blocks)
        n = np.bincount(w.text, minlength=len(texts))
        stop = np.cumsum(n)
        at, stop = (stop - n + RUN - 1)[n >= RUN], stop[n >= RUN]  # last word of each text's first window
        while len(at):
            move = self.shift[slots[at]].astype(np.int64)
            for end in at[move == 0].tolist():
                for words, ids in self.bucket.get(int(blocks[end]), {}).get(int(w.value[end - RUN + 1]), ()):
                    if w.words(end - RUN + 1, RUN) == words:
                        found |= {(int(w.text[end]), i) for i in ids}
            at = at + np.maximum(move, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        return found


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded number of characters."""
    block: list[tuple[int, str]] = []
    size, most = 0, BLOCK_WORDS * 6
    for r in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), once each: the document holds ``RUN`` consecutive words of the item.

    A word is a longest run of letters and digits; case, punctuation and blanks do not count. A
    passage that several items share reports all of them. Null texts hold nothing; an item listed
    in several rows is found by any of them. Items come to the driver in blocks of bounded size,
    each block scans the documents once.
    """
    shape, found = "doc_id bigint, item_id bigint", None
    for block in _item_blocks(items):
        tables = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            patterns = Patterns(tables.value)

            def out(ids: list, texts: list) -> pa.RecordBatch:
                hits = sorted({(ids[t], i) for t, i in patterns.search(texts)})
                return pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], names=["doc_id", "item_id"])

            for b in batches:
                ids, texts, size = [], [], 0
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if doc is None or not text:
                        continue
                    ids.append(doc)
                    texts.append(text)
                    size += len(text)
                    if size >= CHUNK:
                        yield out(ids, texts)
                        ids, texts, size = [], [], 0
                if texts:
                    yield out(ids, texts)

        part = docs.select("doc_id", "text").mapInArrow(scan, shape)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], shape) if found is None else found.distinct()
