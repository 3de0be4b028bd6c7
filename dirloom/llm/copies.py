"""Records that differ in writing alone, found without shuffling those that cannot have a copy.

Each partition marks the hashes of its canonical records in a Bloom filter of two bit arrays:
positions seen once, and positions seen again. The partitions' filters are merged segment by
segment in a distributed job; a position that two partitions have seen has been seen again. Only
records all of whose positions have been seen again are possible repeats. They are shuffled and
grouped exactly; all others are emitted as singletons where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

SEGMENT_BITS = 1 << 16  # positions of one hash lie in one segment, addressed by 16 bits each
POSITIONS = 4
#: Filter bits per record, and the most bits one broadcast filter may have (32 MB); above, the hashes are split into shards.
BITS_PER_RECORD, MOST_BITS = 16, 1 << 28
#: Groups with at least this share of all records are joined by broadcast (at most 1 / HOT_SHARE of them), the others by shuffle.
HOT_SHARE = 0.001


def bare(value: Column) -> Column:
    """Letters with their accents and digits, in lower case."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{M}\p{Nd}]", "")


def record_key(records: DataFrame, defs: DataFrame) -> DataFrame:
    """(row_id, key): the class and the bare primary-key values per attribute, in whatever order they were written; null without any value."""
    keys = defs.where("is_primary_key").groupBy(F.col("class_name").alias("_class")).agg(F.collect_set("attr_id").alias("_pk"))
    # one row per declared class
    joined = records.join(F.broadcast(keys), records["class_name"] == F.col("_class"), "left")
    own = F.filter("av", lambda x: F.array_contains("_pk", x["attr_id"]) & x["value"].isNotNull())
    parts = F.array_sort(F.transform(own, lambda x: F.concat_ws(" ", x["attr_id"].cast("string"), bare(x["value"]))))
    return joined.select("row_id", F.when(F.size(parts) > 0, F.concat_ws("|", F.concat(F.array(F.col("class_name")), parts))).alias("key"))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's filter: (seg, packed bits seen once, packed bits seen again) of the segments it touches."""
    segs: dict[int, list[np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for keys in ([*segs][i : i + 256] for i in range(0, len(segs), 256)):
            made = []
            for s in keys:
                once = np.zeros(SEGMENT_BITS, bool)
                again = np.zeros(SEGMENT_BITS, bool)
                for pos in segs[s]:
                    at, n = np.unique(pos, return_counts=True)
                    again[at] |= once[at] | (n > 1)
                    once[at] = True
                made.append((s, np.packbits(once).tobytes(), np.packbits(again).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.binary())], names=["seg", "once", "again"])
        segs.clear()

    held = 0
    for b in batches:
        seg, h = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(seg):
            continue
        order = np.argsort(seg, kind="stable")
        seg, h = seg[order], h[order].astype(np.uint64)
        # the distinct positions of each record
        pos = np.stack([(h >> np.uint64(16 * i)).astype(np.uint16) for i in range(POSITIONS)], 1)
        pos.sort(1)
        fresh = np.ones_like(pos, bool)
        fresh[:, 1:] = pos[:, 1:] != pos[:, :-1]
        cuts = np.flatnonzero(np.diff(seg)) + 1
        for s, p, f in zip(seg[np.r_[0, cuts]], np.split(pos, cuts), np.split(fresh, cuts), strict=True):
            segs.setdefault(int(s), []).append(p[f])
        held += len(seg)
        if held >= 4_000_000:  # a filter of what was seen so far goes on; the merge adds the next one to it
            yield from flush()
            held = 0
    yield from flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of all partitions, sorted by segment, merged: the words of the positions seen again."""
    last, once, again = None, None, None

    def out() -> pa.RecordBatch:
        words = np.packbits(np.unpackbits(again), bitorder="little").view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([words.tolist()], pa.list_(pa.int64()))], names=["seg", "words"])

    for b in batches:
        for s, o, a in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            o, a = np.frombuffer(o, np.uint8), np.frombuffer(a, np.uint8)
            if s != last:
                if last is not None:
                    yield out()
                last, once, again = s, o.copy(), a.copy()
            else:
                again |= a | (once & o)
                once |= o
    if last is not None:
        yield out()


def _size(rows: int) -> tuple[int, int]:
    """(shards, segments of each): a power of two of segments that gives every record its bits."""
    want = max(1, -(-rows * BITS_PER_RECORD // SEGMENT_BITS))
    most = MOST_BITS // SEGMENT_BITS
    return -(-want // most), min(most, 1 << (want - 1).bit_length())


def possible_repeats(keyed: DataFrame, rows: int) -> DataFrame:
    """``keyed`` with ``maybe``: false if no other row has the same key; true for all rows whose key comes twice, and few others.

    ``rows`` sizes the filter; a wrong size costs shuffle, not correctness. Null keys are never
    repeats. Beyond ``MOST_BITS`` the hashes fall into shards with a filter each.
    """
    shards, segments = _size(rows)
    hashed = keyed.withColumn("_h1", F.xxhash64("key")).withColumn("_h2", F.xxhash64("key", F.lit("+")))
    hashed = hashed.withColumn("_shard", F.pmod(F.shiftright("_h1", 32), F.lit(shards))).withColumn("_seg", F.pmod(F.col("_h1"), F.lit(segments)))
    out = []
    for shard in range(shards):
        mine = hashed.where(F.col("_shard") == shard)
        partial = mine.where("key IS NOT NULL").select("_seg", "_h2").mapInArrow(_seen, "seg bigint, once binary, again binary")
        # cut, for it is read more than once and Python stages are never shared
        merged = cut(partial.repartition("seg").sortWithinPartitions("seg").mapInArrow(_merged, "seg bigint, words array<bigint>"))
        # at most MOST_BITS bits in all
        tested = mine.join(F.broadcast(merged), F.col("_seg") == F.col("seg"), "left")
        hit = F.lit(True)
        for i in range(POSITIONS):
            at = F.shiftrightunsigned("_h2", 16 * i).bitwiseAND(F.lit(SEGMENT_BITS - 1)).cast("int")
            hit = hit & (F.getbit(F.get("words", F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1)
        out.append(tested.withColumn("maybe", F.col("key").isNotNull() & F.coalesce(hit, F.lit(False))).drop("_h1", "_h2", "_shard", "_seg", "seg", "words"))
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def _grouped(marked: DataFrame, rows: int) -> DataFrame:
    """(row_id, class_id, copies) of the possible repeats, grouped exactly.

    They are cut to the shared folder once, the keys as SHA-256. Groups that hold a thousandth of
    all rows or more are joined by broadcast, since there are at most a thousand of them, so that
    no task gets all rows of a hot group.
    """
    maybe = cut(marked.where("maybe").select("row_id", F.unhex(F.sha2("key", 256)).alias("key")))
    groups = maybe.groupBy("key").agg(F.min("row_id").alias("class_id"), F.count("*").alias("copies"))
    hot = groups.where(F.col("copies") >= max(1000.0, rows * HOT_SHARE))
    split = maybe.join(F.broadcast(hot), "key", "left")
    of_hot = split.where("copies IS NOT NULL").select("row_id", "class_id", "copies")
    cold = split.where("copies IS NULL").select("row_id", "key").join(groups, "key").select("row_id", "class_id", "copies")
    return of_hot.union(cold)


def collapse(keyed: DataFrame, rows: int) -> DataFrame:
    """(row_id, class_id, copies): each row with the smallest row_id of its copies and their number, itself included.

    Keys are compared by their SHA-256. Rows with null key are nobody's copy.
    """
    marked = possible_repeats(keyed, rows)
    single = marked.where(~F.col("maybe")).select("row_id", F.col("row_id").alias("class_id"), F.lit(1).cast("bigint").alias("copies"))
    return single.union(_grouped(marked, rows))


def copies(records: DataFrame, defs: DataFrame) -> DataFrame:
    """(row_id, class_id, copies) of ``records``: rows of one class with the same primary-key values, writing aside, are copies.

    One row per input row. Values are compared by letters, with their accents, and digits; their
    order and the record's other attributes do not count, how many there are does. Null values
    are left out; a record without any primary-key value is nobody's copy.
    """
    return collapse(record_key(records, defs), records.count())


def copy_pairs(records: DataFrame, defs: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): each further copy beside the first of its copies."""
    rows = records.count()
    found = _grouped(possible_repeats(record_key(records, defs), rows), rows)
    return found.where("row_id != class_id").select(F.col("class_id").alias("row_id_a"), F.col("row_id").alias("row_id_b"))
