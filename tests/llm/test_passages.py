"""Passages against a plain search of all runs."""

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from dirloom.llm import passages as p


def word_list(t):
    return "".join(ch if ch.isalnum() else " " for ch in p.folded(t)).split()


def plain(texts, items):
    runs = defaultdict(set)
    for i, t in items:
        w = word_list(t)
        for k in range(len(w) - p.RUN + 1):
            runs[tuple(w[k : k + p.RUN])].add(i)
    out = set()
    for d, t in enumerate(texts):
        w = word_list(t)
        out |= {(d, i) for k in range(len(w) - p.RUN + 1) for i in runs.get(tuple(w[k : k + p.RUN]), ())}
    return out


def test_p8_found(spark, sf):
    from dirloom.llm.queries import QUERIES

    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()]
    want = {(docs[d].doc_id, i) for d, i in plain([r.text or "" for r in docs], items)}
    got = [tuple(r) for r in QUERIES["p8_found"](spark, sf).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


WORD = st.sampled_from(["a", "B", "a-b", "é", "STRASSE", "straße", "x1", "."])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(WORD, max_size=40), max_size=4), st.lists(st.lists(WORD, min_size=10, max_size=30), min_size=1, max_size=3))
def test_against_all_runs(texts, items):
    texts, items = [" ".join(t) for t in texts], [(i % 2, " ".join(t)) for i, t in enumerate(items)]
    assert p.Patterns(items).search(texts) == plain(texts, items)


def test_a_run_is_found_at_every_place():
    item = [f"w{i}" for i in range(30)]
    cases = [(a, s, n, q) for a in range(14) for s in (0, 7, 18) for n in (11, 12) for q in (0, 3)]
    texts = [" ".join(["x"] * a + item[s : s + n] + ["y"] * q) for a, s, n, q in cases]
    assert {d for d, _ in p.Patterns([(1, " ".join(item))]).search(texts)} == {d for d, c in enumerate(cases) if c[2] == 12}


def test_edge_cases(spark, monkeypatch):
    """Null and empty texts, items too short, shared passages, an item in two rows, blocks of items, very long texts, empty tables."""
    twelve = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "pre, " + twelve.upper().replace(" ", " - ") + "!", 0), (4, "z " * 300_000 + twelve, 0), (3, twelve, 0), (None, twelve, 0), (5, twelve.replace("w5", "w5 v"), 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, twelve), (11, "a " + twelve + " b"), (12, "short"), (13, None), (None, twelve), (10, "other words here")], "item_id bigint, text string")
    want = {(3, 10), (3, 11), (4, 10), (4, 11)}
    assert sorted(map(tuple, p.contained(docs, items).collect())) == sorted(want)
    monkeypatch.setattr(p, "BLOCK_WORDS", 1)
    assert {tuple(r) for r in p.contained(docs, items).collect()} == want
    assert p.contained(docs.limit(0), items).collect() == [] and p.contained(docs, items.limit(0)).collect() == []
