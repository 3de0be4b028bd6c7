"""Texts assigned to containers of fixed capacity with minimum bin slack.

Each partition tokenises its texts and packs them window by window. In a window the longest text
left opens a container; the rest of it is filled by the multiset of lengths left that comes
closest to the capacity, found by dynamic programming over bitsets of reachable sums and traced
back to how many of each length it takes. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: The pattern that splits text before the merges of the rank files; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of one window. A window leaves at most one container with more room than necessary.
WINDOW = 20_000
SHAPE = "container_kind string, container_id bigint, doc_id bigint, first_token int, n_tokens int"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The file of a public vocabulary of byte-pair ranks; ``folder`` defaults to where this machine keeps them."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"
    path = Path(folder) / name
    if not path.is_file():
        raise FileNotFoundError(f"no vocabulary at {path}")
    return str(path)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE of a rank file; no text is a special token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes as near below ``room`` as any multiset of ``counts`` does.

    ``reach`` has bit s set if some multiset of the lengths so far sums to s. Each length is
    taken in powers of two of its count, one bitset per step kept for the way back. The search
    ends as soon as the room can be filled to the last token.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            out[length] = out.get(length, 0) + take
            best -= length * take
    return out


def fill(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers of (item, first token, tokens). An item longer than the capacity fills containers of its own, its rest is an item like others; empty items join the first container."""
    done: list[list[tuple[int, int, int]]] = []
    held: dict[int, list[tuple[int, int]]] = {}
    empty = []
    for i, n in enumerate(lengths):
        if not n:
            empty.append((i, 0, 0))
            continue
        at = 0
        while n - at > capacity:
            done.append([(i, at, capacity)])
            at += capacity
        held.setdefault(n - at, []).append((i, at))
    counts = {k: len(v) for k, v in held.items()}
    order = sorted(counts, reverse=True)
    while order:
        longest = order[0]
        take = {longest: 1}
        counts[longest] -= 1
        for k, n in closest(counts, capacity - longest).items():
            take[k] = take.get(k, 0) + n
            counts[k] -= n
        done.append([(*held[k].pop(), k) for k, n in take.items() for _ in range(n)])
        for k in [k for k in take if not counts[k]]:
            del counts[k]
            order.remove(k)
    if empty:
        done[:1] = [empty + (done[0] if done else [])]
    return done


def packed(docs: DataFrame, containers: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """(container_kind, container_id, doc_id, first_token, n_tokens): where the tokens of each text are, for every kind of container.

    A text is in one piece unless it is longer than the capacity; then it is cut into pieces that
    fill containers, and a rest. Texts are whole, of any length. A null text counts as empty; an
    empty text is a piece of 0 tokens. Rows that repeat are packed as often as they occur. The
    number of a container is unique in its kind. Kinds with null or non-positive capacity get no
    container; of a kind listed twice the largest capacity counts. No more than a thousand kinds
    are expected, they are collected. ``vocabulary`` is the path of a rank file that every
    executor can read.
    """
    path = vocabulary or vocabulary_path()
    rows = containers.where("container_kind IS NOT NULL AND capacity > 0").groupBy("container_kind").agg({"capacity": "max"}).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    kinds = sorted((r[0], r[1]) for r in rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        base = TaskContext.get().partitionId() << 33
        used = dict.fromkeys((k for k, _ in kinds), 0)
        ids: list[int | None] = []
        lengths: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, capacity in kinds:
                filled = fill(lengths, capacity)
                flat = [(base + used[kind] + c, ids[i], at, n) for c, pieces in enumerate(filled) for i, at, n in pieces]
                used[kind] += len(filled)
                for i in range(0, len(flat), 50_000):
                    number, doc, at, n = zip(*flat[i : i + 50_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(doc), pa.string()), pa.array(number, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["container_kind", "container_id", "doc_id", "first_token", "n_tokens"])
            ids.clear()
            lengths.clear()

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc)
                lengths.append(len(encode(text)) if text else 0)
                if len(ids) >= window:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(pack, SHAPE)
