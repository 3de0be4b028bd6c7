"""Types of text: hand-made texts among a corpus, the learning by itself, and edge cases."""

import numpy as np

from dirloom.llm import prose as p

PROSE = [
    "The help page says that an asterisk at the end of a word matches any ending, but not for networks.",
    "No change needed here.",
    "Closed.",
    "the help page says that an asterisk at the end of a word matches any ending but not for networks",
    "THE HELP PAGE SAYS THAT AN ASTERISK AT THE END\nOF A WORD MATCHES ANY ENDING, BUT NOT FOR NETWORKS.",
    "> Whoever changes a host must quote the version that was read,\n> or else the change is refused.",
    "Wer einen Eintrag ändert, muss die Fassung nennen, die er zuvor\ngelesen hat.",
]
OTHER = [
    "a) how to ask for a referral\nb) old and new Fax\nc) list of all hosts in garvane.example.com\nd) not in the host index",
    "| a | b | how to ask for a host |\n|---|---|---|\n| 1 | 20010203 | - |\n| 3 | x | 7 |",
    "7,20010203,-,10.0.0.0/20\n9,,ns1.garza.example.com,5\n12,Phone,Fax,-",
    "532:4:0:7:MX33.ISTERLEN.EXAMPLE.COM\n1064:3:1:10:DB15.GARNIX.EXAMPLE.ORG",
    "tSaLszv945/Edmt3CleFni3upXTjxVWT6jkOaLhbBYfhFwLCCXg3qr6lNo2Hm2sB\n0cbhh0biaOqVlfTGFdTrmiM+EeMsT40PCXCJmHHZDNEKeqzbwfoQqC/qFJwCYKhF",
    "ok ok ok ok ok ok ok ok ok\nok ok ok ok ok ok ok ok ok ok ok ok",
    "########################\n------------------------\n========================",
    "Home | Print | Login\nNext » Previous » Share\nBack to the list | Help | A-Z",
    "not long on be the seconds old the and of was to in that before from a by\nthe of is were and for not at its about them to which only but so it",
]


def test_types_of_texts(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    mine = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(PROSE + OTHER)], "doc_id bigint, text string")
    types = {r.doc_id: r for r in p.text_types(docs.union(mine)).collect()}
    got = [types[-1 - i].prose >= 0.5 for i in range(len(PROSE + OTHER))]
    assert got == [True] * len(PROSE) + [False] * len(OTHER), [t for t, g, w in zip(PROSE + OTHER, got, [True] * len(PROSE) + [False] * len(OTHER), strict=True) if g != w]
    assert all(abs(r.prose + r.list + r.table + r.junk - 1) < 1e-9 for r in types.values())
    assert len(types) == docs.count() + len(PROSE + OTHER)


def test_accuracies_are_learned():
    """Votes drawn from known accuracies: the posterior finds the kinds, the learned accuracies are near the true ones."""
    rng = np.random.default_rng(0)
    n, kinds = 40_000, rng.choice(3, 40_000, p=[0.6, 0.2, 0.2])  # prose, list, table
    votes = np.zeros((n, len(p.FUNCTIONS)), np.uint8)
    names = [f[0] for f in p.FUNCTIONS]
    for name, kind, vote, hit, miss in (("fluent", 0, 1, 0.9, 0.1), ("sentence end", 0, 1, 0.7, 0.02), ("marked", 1, 1, 0.8, 0.001), ("short line", 1, 1, 0.5, 0.05), ("fields", 2, 1, 0.9, 0.001), ("alike", 2, 1, 0.6, 0.02)):
        votes[:, names.index(name)] = np.where(rng.random(n) < np.where(kinds == kind, hit, miss), vote, 0)
    pattern, inverse, count = np.unique(p.patterns(votes), return_inverse=True, return_counts=True)
    post, accuracy = p.learn(pattern, count)
    spoken = pattern[inverse] > 0
    assert (post[inverse].argmax(1) == kinds)[spoken].mean() > 0.95
    assert accuracy[names.index("fields")] > 0.95 and 0.8 < accuracy[names.index("fluent")] < 0.97
    assert np.array_equal(votes, (pattern[inverse][:, None] // p._PLACES % p._BASES).astype(np.uint8))


def test_lines_by_hand():
    x = p.lines(p.Text(["One two,  three.\n\n- item 7\na|b|c", "", "x:y:z http://h/"]), p.Idiom(np.zeros(0, np.uint64), np.zeros(0, int)))
    assert x["text"].tolist() == [0, 0, 0, 2]
    assert x["words"].tolist() == [3, 2, 1, 2] and x["chars"].tolist() == [13, 6, 5, 14]
    assert x["marked"].tolist() == [False, True, False, False] and x["ended"].tolist() == [1, 0, 0, 0]
    assert x["fields"].tolist() == [1, 0, 2, 0] and x["colons"].tolist() == [0, 0, 0, 2]
    assert x["closed"].tolist() == [True, False, False, False] and x["common"].sum() == 0


def test_repeats_are_near_and_in_one_text():
    text = p.Text(["a b c d e f a b c d e f", "a b c d e f"])
    assert text.repeated().nonzero()[0].tolist() == [6]


def test_edge_cases(spark):
    """Null, empty and blank texts, a very long line, repeated rows, clashing columns, an empty table."""
    df = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, " \n\t\n", 0.0), (4, "word " * 200_000, 0.0), (5, "A sentence here.", 0.0), (5, "A sentence here.", 0.0)], "doc_id bigint, text string, prose double")
    types = {r.doc_id: r for r in p.text_types(df).collect()}
    assert sorted(types) == [4, 5] and types[4].type == "junk" and types[5].type == "prose" and types[5].chars == 28
    stats = {r.doc_id: r for r in p.statistics(df).collect()}
    assert sorted(stats) == [1, 2, 3, 4, 5]
    assert (stats[3].chars, stats[3].mean_word, stats[1].words) == (0, None, 0) and stats[4].words == 200_000
    assert (stats[5].words, stats[5].mean_word, stats[5].closed_lines) == (3, 13 / 3, 1.0)
    assert p.text_types(df.limit(0)).collect() == [] and p.not_prose(df.limit(0)).collect() == []
