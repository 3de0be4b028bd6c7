"""A change feed of adds, mods and dels, replayed in order to the state it leaves.

Changes are range-partitioned by key and order, sorted within partitions and run through a
state machine that streams over Arrow batches. A key with very many changes is cut by the range
partitioning into segments that follow each other in time; a segment is replayed once for a key
that is absent before it and once for one that is live, and the segments' outcomes are then
chained per key. So no task has to hold, or even to read, all changes of a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import trim_blanks
from .timestamps import MIN_US, parse

#: How the end of a segment follows from its start.
SAME, DEAD, LIVE = "same", "dead", "live"




class _Segment:
    """Outcome of a run of changes of one key, for either state before it.

    ``dead``: the overlay of columns if the key was absent before (None: absent after).
    ``live``: the overlay over the content before (None: absent after); ``base`` tells whether
    the content before still shines through.
    """

    __slots__ = ("key", "dead", "live", "base", "last")

    def __init__(self, key: str) -> None:
        self.key, self.dead, self.live, self.base, self.last = key, None, {}, True, None

    def apply(self, action: str, content: dict, partial: bool) -> None:
        if action == "add":
            if self.dead is None:
                self.dead = dict(content)
            if self.live is None:
                self.live, self.base = dict(content), False
        elif action == "del":
            self.dead = self.live = None
            self.base = False
        else:
            if self.dead is not None:
                self.dead = self.dead | {k: v for k, v in content.items() if v is not None} if partial else dict(content)
            if self.live is not None:
                if partial:
                    self.live = self.live | {k: v for k, v in content.items() if v is not None}
                else:
                    self.live, self.base = dict(content), False


def replay(changes: DataFrame, key: str, order: Sequence[str], sequence: str, action: str, columns: Sequence[str], partial: bool = False) -> DataFrame:
    """(key, columns...): the state after all changes, one row per live key.

    ``order`` are the columns that order the changes of a key, ``sequence`` identifies a change:
    one that was already applied (the same order and sequence again) is skipped. ``action`` is
    add, mod or del; others have no effect. An add of a live key, a mod or del of an absent one
    is refused. A mod replaces the content, or with ``partial`` only those columns it gives
    (null: not given). Rows with null key are dropped; null order values come first; of changes
    that tie in order the smaller sequence comes first. ``columns`` must not clash with ``key``.
    An empty feed gives no rows. Repeats that do not agree in ``order`` must be removed before.
    """
    cols = list(dict.fromkeys(columns))
    kept = changes.where(F.col(key).isNotNull() & F.col(action).isin("add", "mod", "del"))
    rank = F.struct(*[F.col(c) for c in order], F.col(sequence))
    kept = kept.select(F.col(key).cast("string").alias("_k"), rank.alias("_o"), F.col(action).alias("_a"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    sorted_ = kept.repartitionByRange("_k", "_o").sortWithinPartitions("_k", "_o")
    # a repeat has the same key, order and sequence, so it is in the same partition, right behind
    numbered = sorted_.select("_k", F.spark_partition_id().alias("_p"), F.xxhash64("_o").alias("_s"), F.col("_a"), *[f"_c{i}" for i in range(len(cols))])
    types = [kept.schema[f"_c{i}"].dataType.simpleString() for i in range(len(cols))]
    n = len(cols)

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list) -> pa.RecordBatch:
            data = {"_k": [s.key for s, _ in done], "_p": [p for _, p in done], "_dl": [s.dead is not None for s, _ in done], "_ll": [s.live is not None for s, _ in done], "_b": [s.base for s, _ in done]}
            for side in ("dead", "live"):
                for i in range(n):
                    data[f"_{side}{i}"] = [(getattr(s, side) or {}).get(i) for s, _ in done]
            return pa.RecordBatch.from_pydict(data, schema=schema)

        schema = None
        seg, done, part = None, [], 0
        for b in batches:
            if schema is None:
                kinds = [b.schema.field(4 + i).type for i in range(n)]
                schema = pa.schema([("_k", pa.string()), ("_p", pa.int32()), ("_dl", pa.bool_()), ("_ll", pa.bool_()), ("_b", pa.bool_()), *((f"_{side}{i}", kinds[i]) for side in ("dead", "live") for i in range(n))])
            keys, parts, seqs, acts, *content = (c.to_pylist() for c in b.columns)
            for at, k in enumerate(keys):
                if seg is None or seg.key != k:
                    if seg is not None:
                        done.append((seg, part))
                        if len(done) >= 10_000:
                            yield out(done)
                            done = []
                    seg, part = _Segment(k), parts[at]
                if seg.last == seqs[at]:
                    continue
                seg.last = seqs[at]
                seg.apply(acts[at], {i: c[at] for i, c in enumerate(content)}, partial)
        if seg is not None:
            done.append((seg, part))
        if done:
            yield out(done)

    shape = ", ".join(["_k string", "_p int", "_dl boolean", "_ll boolean", "_b boolean", *(f"_{side}{i} {t}" for side in ("dead", "live") for i, t in enumerate(types))])
    segments = numbered.mapInArrow(machine, shape)

    # chain the segments of a key in the order of their partitions; most keys have one, none more than there are partitions
    def content(s, side: str):
        return [s[f"_{side}{i}"] for i in range(n)]

    parts = F.array_sort(F.collect_list(F.struct("_p", *[c for c in segments.columns if c not in ("_k", "_p")])))
    chained = segments.groupBy("_k").agg(parts.alias("_segs"))
    nothing = F.struct(F.lit(False).alias("on"), *[F.lit(None).cast(t).alias(f"c{i}") for i, t in enumerate(types)])

    def follow(state, s):
        when_live = [F.coalesce(s[f"_live{i}"], F.when(s["_b"], state[f"c{i}"])) for i in range(n)]
        pick = lambda i: F.when(state["on"], when_live[i]).otherwise(s[f"_dead{i}"])
        return F.struct(F.when(state["on"], s["_ll"]).otherwise(s["_dl"]).alias("on"), *[pick(i).alias(f"c{i}") for i in range(n)])

    state = chained.select(F.col("_k").alias(key), F.aggregate("_segs", nothing, follow).alias("_end"))
    return state.where("_end.on").select(key, *[F.col(f"_end.c{i}").alias(c) for i, c in enumerate(cols)])


def spool_changes(spool: DataFrame) -> DataFrame:
    """(change_no, key, moment, spool_seq, op, and spool's payload): the usable changes of a spool, each once.

    Keys and actions are compared in lower case without outer blanks. The moment is that of a
    17-digit serial, of an ISO time with offset, or of epoch milliseconds. Rows without key or
    moment, or with another action, are left out; of repeats of a change_no the one that arrived
    first (by spool_id) stays. Null change_nos are one change. A null spool_seq comes first.
    """
    t = trim_blanks("updated")
    payload = ["payload"] if "payload" in spool.columns else []
    said = spool.select("spool_id", "change_no", "spool_seq", F.lower(trim_blanks("action")).alias("op"), F.lower(trim_blanks("rid")).alias("key"), t.alias("updated"), F.lit(None).cast("string").alias("date_order"), *payload)
    said = parse(said.where("op IN ('add', 'mod', 'del') AND key != '' AND updated != ''"))
    s, text = F.col("_stamp"), F.col("updated")
    # digits that are no serial are milliseconds, however many; a time needs its offset
    digits = F.when(F.length("updated") == 17, s["local"]).otherwise(text.try_cast("bigint") * 1000)
    moment = F.when(text.rlike(r"\A[0-9]+\z"), digits).when(s["off"].isNotNull(), s["local"] - s["off"] * MIN_US)
    said = said.withColumn("moment", moment).where("moment IS NOT NULL").select("change_no", "spool_id", "moment", "spool_seq", "op", "key", *payload)
    return said.groupBy("change_no").agg(F.min_by(F.struct("moment", "spool_seq", "op", "key", *payload), "spool_id").alias("c")).select("change_no", "c.*")


def live(spool: DataFrame) -> DataFrame:
    """(rid, change_no) of the records live after all changes of a spool, with the change whose content they hold."""
    once = spool_changes(spool.drop("payload"))
    return replay(once.withColumnRenamed("key", "rid"), "rid", ["moment", "spool_seq"], "change_no", "op", ["change_no"])


def live_records(spool: DataFrame) -> DataFrame:
    """(rid, change_no, payload): the table itself after all changes; the payload is fetched for the winners only."""
    won = live(spool).withColumnRenamed("change_no", "_no")
    return won.join(spool_changes(spool).select("change_no", "payload"), F.col("_no").eqNullSafe(F.col("change_no"))).select("rid", "change_no", "payload")
