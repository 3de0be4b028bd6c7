"""Packing: the filling step against all sums, every token placed once, and little room left."""

import itertools
import random

from dirloom.llm import packing as p


def test_closest_is_the_best_of_all_sums():
    rnd = random.Random(1)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(0, 5))}
        room = rnd.randint(0, 60)
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        take = p.closest(counts, room)
        assert sum(k * n for k, n in take.items()) == best
        assert all(0 < n <= counts[k] for k, n in take.items())


def test_nothing_is_lost_or_split_without_need():
    rnd = random.Random(2)
    lengths = [rnd.choice([0, 1, 7, 50, 99, 100, 101, 250, rnd.randint(1, 90)]) for _ in range(500)]
    done = p.fill(lengths, 100)
    assert all(sum(n for _, _, n in c) <= 100 for c in done)
    parts = {}
    for c in done:
        for i, at, n in c:
            parts.setdefault(i, []).append((at, n))
    assert sorted(parts) == list(range(500))
    for i, cut in parts.items():
        cut.sort()
        assert [a for a, _ in cut] == list(itertools.accumulate([0] + [n for _, n in cut[:-1]]))
        assert sum(n for _, n in cut) == lengths[i]
        assert len(cut) == max(1, -(-lengths[i] // 100))
    assert p.fill([], 10) == [] and p.fill([0], 10) == [[(0, 0, 0)]]


def test_p7_packed(spark, sf):
    from collections import defaultdict

    from dirloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {r.container_kind: r.capacity for r in spark.read.parquet(f"{sf}/containers.parquet").collect()}
    encode = p.tokenizer(p.vocabulary_path()).encode_ordinary
    tokens = {i: len(encode(t or "")) for i, t in texts.items()}
    used, placed = defaultdict(int), defaultdict(int)
    for r in QUERIES["p7_packed"](spark, sf).collect():
        used[r.container_kind, r.container_id] += r.n_tokens
        placed[r.container_kind, r.doc_id] += r.n_tokens
    assert placed == {(k, i): n for k in size for i, n in tokens.items()}
    for kind, capacity in size.items():
        fills = [n for (k, _), n in used.items() if k == kind]
        least = -(-sum(tokens.values()) // capacity)
        assert max(fills) <= capacity and len(fills) <= least + max(1, 0.01 * least), (kind, len(fills), least)


def test_edge_cases(spark):
    """Null and empty texts, repeated rows, kinds with null and non-positive capacities or listed twice, no containers, an empty table."""
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (3, "one two", "x"), (None, "a", "x")], "doc_id bigint, text string, container_kind string")
    boxes = spark.createDataFrame([("k", 1), ("k", 4), ("none", None), ("zero", 0), (None, 3)], "container_kind string, capacity int")
    got = p.packed(docs, boxes).collect()
    assert {r.container_kind for r in got} == {"k"}
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert p.packed(docs, boxes.limit(0)).collect() == [] and p.packed(docs.limit(0), boxes).collect() == []
    one = spark.createDataFrame([(1, "word " * 30_000)], "doc_id bigint, text string")
    cut = p.packed(one, spark.createDataFrame([("k", 1000)], "container_kind string, capacity int")).collect()
    assert sum(r.n_tokens for r in cut) == len(p.tokenizer(p.vocabulary_path()).encode_ordinary("word " * 30_000))
