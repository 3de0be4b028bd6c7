"""Attributes of a class from version to version: what was added, removed, renamed or retyped, and one table over all.

Renames are found by similarity flooding. Each step from a version to the next one gives a pair
of schema graphs (class, attributes, types, order in the record); the scores of attribute pairs
start from their names and from how far their values agree in the records of both versions, and
are propagated along the edges both graphs have until they settle. Everything that grows with
the data is aggregated before; a graph has a node per attribute, so a group is as large as a
schema, not as its table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norm import name_key, trim_blanks
from ..runtime import bounded, counted, cut
from .wide import typed

#: Fixed forms of the types; a type needs nine tenths of the values.
FORMS = {"integer": r"\A[+-]?[0-9]+\z", "date": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "boolean": r"(?i)\A(TRUE|YES|ON|FALSE|NO|OFF)\z"}
#: A pair is a candidate if its score is at least this share of the best that either attribute has.
RELATIVE = 0.3
#: Scores count as settled when none moves by more than this in a round.
SETTLED, MOST_ROUNDS = 1e-3, 500


def _kind(n: Column, **of: Column) -> Column:
    """The type that nine tenths of ``n`` values have; null if there are none."""
    kind = None
    for name, k in of.items():
        kind = F.when(k * 10 >= n * 9, name) if kind is None else kind.when(k * 10 >= n * 9, name)
    return F.when(n > 0, kind.otherwise("text"))


def _bigrams(s: str) -> set[str]:
    s = f" {s} "
    return {s[i : i + 2] for i in range(len(s) - 1)}


def _alike(a: str, b: str) -> float:
    x, y = _bigrams(a), _bigrams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def flood(start: np.ndarray, old_kinds: list, new_kinds: list, old_order: list[int], new_order: list[int]) -> tuple[np.ndarray, int]:
    """Settled scores of all attribute pairs of two schema graphs, and the rounds it took.

    Pairs are joined by the edges both graphs have: class to attribute, attribute to type, and
    attribute to the next one in the record. An edge passes on a share of its pair's score, the
    smaller the more edges of its label the pair has.
    """
    n, m = start.shape
    to = np.zeros((len(set(old_kinds)), n)), np.zeros((len(set(new_kinds)), m))
    for table, kinds in zip(to, (old_kinds, new_kinds), strict=True):
        for i, k in enumerate(sorted(set(kinds), key=str)):
            table[i, [j for j, x in enumerate(kinds) if x == k]] = 1
    same = np.array([[1.0 if a == b else 0.0 for b in sorted(set(new_kinds), key=str)] for a in sorted(set(old_kinds), key=str)])
    share = np.outer(to[0].sum(1), to[1].sum(1))
    o, p = np.argsort(old_order, kind="stable"), np.argsort(new_order, kind="stable")
    score, kinds, root = start.copy(), same.copy(), 1.0
    for rounds in range(1, MOST_ROUNDS + 1):
        s, t, r = start + score, same + kinds, 1.0 + root
        next_ = np.zeros_like(s)
        inner = s[np.ix_(o, p)]
        moved = np.zeros_like(inner)
        moved[:-1, :-1] += inner[1:, 1:]
        moved[1:, 1:] += inner[:-1, :-1]
        next_[np.ix_(o, p)] = moved / 2
        s2 = s + to[0].T @ (t / share) @ to[1] + r / (n * m) + next_
        t2 = t + to[0] @ s @ to[1].T / share
        r2 = r + s.sum() / (n * m)
        top = max(s2.max(), t2.max(), r2)
        s2, t2, r2 = s2 / top, t2 / top, r2 / top
        moved_by = max(np.abs(s2 - score).max(), np.abs(t2 - kinds).max(), abs(r2 - root))
        score, kinds, root = s2, t2, r2
        if moved_by < SETTLED:
            break
    return score, rounds


def _match(group: pd.DataFrame) -> pd.DataFrame:
    """Candidate correspondences of one step; its rows are the attributes (side old or new) and the agreements (side both)."""
    old = group[group["side"] == "old"].sort_values("name")
    new = group[group["side"] == "new"].sort_values("name")
    none = pd.DataFrame({"db_dir": [], "next": [], "old": [], "new": [], "score": [], "rounds": []}).astype({"db_dir": str, "next": str, "old": str, "new": str, "score": float, "rounds": int})
    if old.empty or new.empty:
        return none
    a, b = old["name"].tolist(), new["name"].tolist()
    at, to = {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
    start = np.array([[1.0 if x == y else 0.5 * _alike(x, y) for y in b] for x in a])
    for x, y, share in group.loc[group["side"] == "both", ["name", "other", "share"]].itertuples(index=False):
        start[at[x], to[y]] = max(start[at[x], to[y]], share)
    score, rounds = flood(start, old["kind"].tolist(), new["kind"].tolist(), old["place"].tolist(), new["place"].tolist())
    # names in both versions correspond to themselves; the rest is matched among itself
    gone, came = [i for i, x in enumerate(a) if x not in to], [j for j, y in enumerate(b) if y not in at]
    if not gone or not came:
        return none
    left = score[np.ix_(gone, came)]
    relative = np.maximum(left / left.max(1, keepdims=True), left / left.max(0, keepdims=True))
    pick = [(a[gone[i]], b[came[j]], float(left[i, j])) for i, j in zip(*np.nonzero(relative >= RELATIVE), strict=True)]
    return pd.DataFrame({"db_dir": group["db_dir"].iloc[0], "next": group["next"].iloc[0], "old": [x[0] for x in pick], "new": [x[1] for x in pick], "score": [x[2] for x in pick], "rounds": rounds})


class Drift:
    """The versions of all db_dirs, their attributes and the correspondences between neighbours.

    A version is padded with zeros to 17 digits; files of a db_dir with equal versions belong
    together. Names count in lower case without outer blanks, values without outer blanks; rows
    without name are left out, files without version or db_dir too. Of the values of a record
    only the set counts. Repeated rows weigh in a type's nine tenths as often as they occur.
    """

    def __init__(self, files: DataFrame, pairs: DataFrame) -> None:
        ver = F.rpad(trim_blanks("class_version"), 17, "0").alias("ver")
        self.files = files.select("file_no", "db_dir", ver).where("db_dir IS NOT NULL AND ver IS NOT NULL")
        self.pairs = pairs
        steps = self.files.select("db_dir", "ver").distinct().withColumn("next", F.lead("ver").over(Window.partitionBy("db_dir").orderBy("ver")))
        self.steps = cut(steps.where("next IS NOT NULL").withColumnRenamed("ver", "prev").withColumn("step", F.monotonically_increasing_id()))
        self.attrs = cut(self._attributes())
        old = self.steps.join(self.attrs.withColumnRenamed("ver", "prev"), ["db_dir", "prev"])
        new = self.steps.join(self.attrs.withColumnRenamed("ver", "next"), ["db_dir", "next"])
        self.old, self.new = old, new
        key = ["step", "db_dir", "next", "prev", "name"]
        both = old.select(*key, F.col("kind").alias("was"), F.lit(True).alias("o")).join(new.select(*key, F.col("kind").alias("now"), F.lit(True).alias("n")), key, "full")
        self.both = cut(both)
        # steps in which names went and others came; in all others there is nothing to match
        self.torn = cut(both_sides(self.both))
        self.agreement = cut(self._agreement())
        self.renamed = cut(self._renamed())

    def _named(self, *columns: str) -> DataFrame:
        """Pairs with a name: file_no, name, v (null if blank) and further columns."""
        return self.pairs.select("file_no", name_key("attr_name").alias("name"), F.nullif(trim_blanks("value"), F.lit("")).alias("v"), *columns).where("name IS NOT NULL")

    def _attributes(self) -> DataFrame:
        """(db_dir, ver, name, kind, place), summed up per file before anything is joined."""
        has = lambda p: F.count_if(F.col("v").rlike(p))
        per_file = self._named("pos").groupBy("file_no", "name").agg(F.count("v").alias("n"), *[has(p).alias(k) for k, p in FORMS.items()], F.sum("pos").alias("pos"), F.count("pos").alias("of"))
        place = F.try_divide(F.sum("pos"), F.sum("of")).cast("double")
        kind = _kind(F.sum("n"), **{k: F.sum(k) for k in FORMS})
        return per_file.join(bounded(self.files), "file_no").groupBy("db_dir", "ver", "name").agg(kind.alias("kind"), place.alias("place"))

    def said(self) -> DataFrame:
        """All named pairs with their db_dir and version; a blank value is null."""
        return self._named("rid", "pos").join(bounded(self.files), "file_no").drop("file_no")

    def _agreement(self) -> DataFrame:
        """(db_dir, next, old, new, k, n): of n records of both versions with a value under old, k have the same under new.

        Only values under names that went or came are gathered, as a digest per record and name,
        and only where a version lost a name and gained another.
        """
        gone = self.both.where("n IS NULL").select("step", "db_dir", F.col("prev").alias("ver"), "name", F.lit("old").alias("side"))
        came = self.both.where("o IS NULL").select("step", "db_dir", F.col("next").alias("ver"), "name", F.lit("new").alias("side"))
        torn = self.torn
        names = cut(gone.union(came).join(torn, "step", "leftsemi").join(self.files, ["db_dir", "ver"]).select("file_no", "name", "step", "side"))
        values = self._named("rid").where("v IS NOT NULL AND rid IS NOT NULL").join(counted(names), ["file_no", "name"]).select("step", "side", "rid", "name", "v").distinct()
        h = F.xxhash64("v")
        digest = values.groupBy("step", "side", "rid", "name").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.sum(F.xxhash64("v", F.lit("+")).cast("decimal(20,0)")).alias("s"))
        digest = cut(digest)
        old, new = digest.where("side = 'old'").withColumnRenamed("name", "old"), digest.where("side = 'new'").withColumnRenamed("name", "new")
        later = cut(self.steps.join(torn, "step", "leftsemi").select("step", "db_dir", F.col("next").alias("ver")).join(self.files, ["db_dir", "ver"]).select("file_no", "step"))
        rids = self.pairs.where("rid IS NOT NULL AND attr_name IS NOT NULL").select("file_no", "rid").distinct().join(counted(later), "file_no").select("step", "rid").distinct()
        before = old.join(rids, ["step", "rid"], "leftsemi")
        total = before.groupBy("step", "old").agg(F.count("*").alias("n"))
        same = before.join(new, ["step", "rid", "least", "most", "size", "x", "s"]).groupBy("step", "old", "new").agg(F.count("*").alias("k"))
        return same.join(total, ["step", "old"]).join(self.steps, "step").select("db_dir", "next", "old", "new", "k", "n")

    def candidates(self) -> DataFrame:
        """(db_dir, next, old, new, score, rounds): correspondences that the flooding selects between names of one version only.

        Each step is a group; they are spread over as many tasks as a shuffle has, since they are
        small in bytes but not in work.
        """
        null = F.lit(None)
        sides = [d.select("db_dir", "next", F.lit(side).alias("side"), "name", null.cast("string").alias("other"), null.cast("double").alias("share"), F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("place", F.lit(0.0)).alias("place")) for side, d in (("old", self.old), ("new", self.new)) for d in (d.join(self.torn, "step", "leftsemi"),)]
        agreed = self.agreement.select("db_dir", "next", F.lit("both").alias("side"), F.col("old").alias("name"), F.col("new").alias("other"), (F.col("k") / F.col("n")).alias("share"), null.cast("string").alias("kind"), null.cast("double").alias("place"))
        tasks = int(self.pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return sides[0].union(sides[1]).union(agreed).repartition(tasks, "db_dir", "next").groupBy("db_dir", "next").applyInPandas(_match, "db_dir string, next string, old string, new string, score double, rounds int")

    def _renamed(self) -> DataFrame:
        """Candidates whose values agree in at least four fifths of the records."""
        return self.candidates().join(self.agreement.where("k * 5 >= n * 4"), ["db_dir", "next", "old", "new"]).select("db_dir", "next", "old", "new", "score")

    def report(self) -> DataFrame:
        """(db_dir, class_version, change_kind, old_name, new_name): each change between neighbouring versions."""
        row = lambda kind, o, n: ["db_dir", F.col("next").alias("class_version"), F.lit(kind).alias("change_kind"), o.alias("old_name"), n.alias("new_name")]
        none = F.lit("")
        gone = self.both.where("n IS NULL").withColumnRenamed("name", "old")
        came = self.both.where("o IS NULL").withColumnRenamed("name", "new")
        parts = [
            self.renamed.select(*row("renamed", F.col("old"), F.col("new"))),
            gone.join(self.renamed, ["db_dir", "next", "old"], "leftanti").select(*row("removed", F.col("old"), none)),
            came.join(self.renamed, ["db_dir", "next", "new"], "leftanti").select(*row("added", none, F.col("new"))),
            self.both.where("o AND n AND was != now").select(*row("retyped", F.col("name"), F.col("name"))),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def columns(self) -> DataFrame:
        """(db_dir, ver, name, attr, type): the one name and type each attribute of each version has in the table over all versions.

        An attribute keeps the name of its latest version; of several renames the one with the
        best score is followed, one to one. Its type is the one that all versions have, else text.
        """
        shape = "db_dir string, ver string, name string, attr string, type string"
        nodes = self.attrs.select("db_dir", "ver", "name", F.lit(None).cast("string").alias("new"), F.lit(None).cast("double").alias("score"), "kind")
        links = self.renamed.select("db_dir", F.col("next").alias("ver"), F.col("old").alias("name"), "new", "score", F.lit(None).cast("string").alias("kind"))
        return nodes.union(links).groupBy("db_dir").applyInPandas(_one_name, shape)

    def one_table(self) -> DataFrame:
        """(db_dir, class_version, rid, pos, attr, type, value, value_integer, value_date, value_boolean): all pairs of all versions, cast and united.

        Blank values are left out; a value that does not have its attribute's type stays in
        ``value`` and is null in the typed column.
        """
        named = self.said().where("v IS NOT NULL").join(self.columns(), ["db_dir", "ver", "name"])
        cast = {k: F.when((F.col("type") == k) & F.col("v").rlike(p), typed(F.col("v"), k)).alias(f"value_{k}") for k, p in FORMS.items()}
        return named.select("db_dir", F.col("ver").alias("class_version"), "rid", "pos", "attr", "type", F.col("v").alias("value"), *cast.values())


def both_sides(both: DataFrame) -> DataFrame:
    """(step) of the steps that have a name of either version only."""
    return both.groupBy("step").agg(F.max(F.col("n").isNull()).alias("g"), F.max(F.col("o").isNull()).alias("c")).where("g AND c").select("step")


def _one_name(group: pd.DataFrame) -> pd.DataFrame:
    """Names of one db_dir carried from version to version; backwards, so that the latest name is the attribute's."""
    nodes, links = group[group["new"].isna()], group[group["new"].notna()]
    kinds = {(v, n): k for v, n, k in nodes[["ver", "name", "kind"]].itertuples(index=False)}
    by_ver: dict[str, list[str]] = {}
    for v, n in kinds:
        by_ver.setdefault(v, []).append(n)
    attr: dict[tuple[str, str], str] = {}
    later: str | None = None
    for v in sorted(by_ver, reverse=True):
        to: dict[str, str] = {n: n for n in by_ver[v] if later is not None and n in by_ver[later]}
        if later is not None:
            taken: set[str] = set()
            for o, n, _ in sorted(links.loc[links["ver"] == later, ["name", "new", "score"]].itertuples(index=False), key=lambda x: (-x[2], x[0], x[1])):
                if o not in to and n not in taken:
                    to[o] = n
                    taken.add(n)
        for n in sorted(by_ver[v]):
            attr[v, n] = attr[later, to[n]] if n in to else _free(n, v, attr)
        later = v
    types: dict[str, set] = {}
    for key, a in attr.items():
        if isinstance(kinds[key], str):
            types.setdefault(a, set()).add(kinds[key])
    rows = [(group["db_dir"].iloc[0], v, n, a, next(iter(types[a])) if len(types.get(a, ())) == 1 else "text") for (v, n), a in attr.items()]
    return pd.DataFrame(rows, columns=["db_dir", "ver", "name", "attr", "type"])


def _free(name: str, ver: str, attr: dict[tuple[str, str], str]) -> str:
    """``name``, or with its version if another attribute of a later version has that name already."""
    return f"{name}@{ver}" if name in attr.values() else name


def changes(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(db_dir, class_version, change_kind, old_name, new_name) between neighbouring versions."""
    return Drift(files, pairs).report()
