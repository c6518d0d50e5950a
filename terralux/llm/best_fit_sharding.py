"""Sharding by best-fit decreasing bin packing of indivisible groups, planned over counts of sizes.

Rows with equal texts are one group and share a shard. A group's size is the sum of its rows' sizes
(UTF-8 bytes of the text plus ``ROW_BYTES``), summed before the shuffle, so that a group with a third
of all rows travels as one number per task. The plan sees only how many groups there are of each
size: n different sizes take n * n / 2 bytes of text at least, so it holds less than
sqrt(2 * bytes) counts, 0.25 million for 30 GB. Sizes enter in descending order; a group takes the
shard with the least room that still holds it, found in a balanced tree of rooms. Groups of one size
fill a shard as long as they fit, which is what best fit does group by group, so a size costs one
step a shard. Groups then take the planned places by their rank in that order, from their rank
among the groups of their size and salt and the sums before it. No size and no group meets in one task.

With ``capacity`` the number of shards is what best fit needs; a group above it has a shard of its own. With
``shards`` the capacity is the least, up to the steps of the search, for which the groups fit; groups
above the mean of what is left have a shard of their own first, so the others stay nearly equal.

A null text is an empty one: size ``ROW_BYTES``, all of them one group. Repeated rows and rows without id
are rows of their own. Groups of equal size go by their hash; different texts of equal 64-bit hash
become one group, which keeps every promise. An empty table gives an empty result. Carried columns may have
any name; those called ``size``, ``shard`` or ``slot`` are replaced when shards are written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralux.llm.common import cut, group_ranks

SHARDS = 24
ROW_BYTES = 8
#: Groups of one size that are numbered together, on average, if all have this size.
SALT_ROWS = 4_000
#: Halvings of the step between the largest capacity that is too small and the least that suffices.
HALVINGS = 3
#: Rows of a written shard that make one file.
FILE_ROWS = 1_000_000


class Rooms:
    """Room left in each open shard, in order: a treap on (room, shard) with hashed priorities."""

    def __init__(self):
        self._root: list | None = None

    @staticmethod
    def _priority(shard: int) -> int:
        return (shard + 1) * 0x9E3779B97F4A7C15 % 2**64

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return b if a is None else a
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, room: int, shard: int) -> None:
        left, right = self._split(self._root, (room, shard))
        self._root = self._merge(self._merge(left, [(room, shard), None, None, self._priority(shard)]), right)

    def remove(self, room: int, shard: int) -> None:
        left, rest = self._split(self._root, (room, shard))
        _, right = self._split(rest, (room, shard + 1))
        self._root = self._merge(left, right)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Least room of ``size`` or more, and its shard; the smaller number among equals."""
        node, found = self._root, None
        while node is not None:
            if node[0][0] >= size:
                node, found = node[1], node[0]
            else:
                node = node[2]
        return found


@dataclass
class Plan:
    """Runs of groups in descending order of size: the first place of each and its shard."""

    shards: int = 0
    places: int = 0
    starts: list[int] = field(default_factory=list)
    targets: list[int] = field(default_factory=list)

    def put(self, n: int, shard: int) -> None:
        self.starts.append(self.places)
        self.targets.append(shard)
        self.places += n


def fit(sizes: Sequence[int], counts: Sequence[int], capacity: int, most: int | None = None, plan: Plan | None = None) -> Plan | None:
    """Best-fit decreasing of ``counts`` groups of each of the descending ``sizes``; None beyond ``most`` shards."""
    plan, rooms = plan or Plan(), Rooms()
    for size, left in zip(sizes, counts, strict=True):
        while left:
            found = rooms.tightest(size)
            if found is None:
                if most is not None and plan.shards == most:
                    return None
                room, shard = max(capacity, size), plan.shards
                plan.shards += 1
            else:
                room, shard = found
                rooms.remove(room, shard)
            n = min(left, room // size)
            plan.put(n, shard)
            left -= n
            if room > n * size:
                rooms.add(room - n * size, shard)
    return plan


def fit_evenly(sizes: Sequence[int], counts: Sequence[int], shards: int) -> Plan:
    """``shards`` shards of the least capacity that the search finds."""
    sizes, counts = list(sizes), list(counts)
    plan, rest = Plan(), sum(s * c for s, c in zip(sizes, counts, strict=True))
    k = 0
    while k < len(sizes) and shards - plan.shards > 1 and sizes[k] * (shards - plan.shards) >= rest:
        plan.put(1, plan.shards)
        plan.shards += 1
        rest -= sizes[k]
        counts[k] -= 1
        k += not counts[k]
    sizes, counts = sizes[k:], counts[k:]

    def attempt(slack: int) -> Plan | None:
        begun = Plan(plan.shards, plan.places, list(plan.starts), list(plan.targets))
        return fit(sizes, counts, -(-rest // (shards - plan.shards)) + slack, shards, begun)

    low, high = 0, 1
    best = attempt(0)
    if best is None:
        while (best := attempt(high)) is None:
            low, high = high, 2 * high
        for _ in range(HALVINGS):
            middle = (low + high) // 2
            if middle > low and (better := attempt(middle)) is not None:
                best, high = better, middle
            else:
                low = middle
    return best


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def assign_shards(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (the carried columns), ``size``, ``shard`` and ``slot``, gapless from 0 in each shard.

    Give either ``shards`` or ``capacity`` (in bytes, with ``shards=None``).
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    base = cut(
        docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), text_size(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key")),
        "sizes",
    )
    groups = cut(base.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    histogram = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    sizes, counts = (histogram.column(c).to_numpy() for c in ("bytes", "n"))
    order = np.argsort(-sizes)
    sizes, counts = sizes[order], counts[order]
    listed = sizes.tolist(), counts.tolist()
    plan = fit(*listed, capacity) if shards is None else fit_evenly(*listed, shards)
    known = base.sparkSession.sparkContext.broadcast(
        (-sizes, np.cumsum(counts) - counts, np.array(plan.starts, dtype=np.int64), np.array(plan.targets, dtype=np.int32))
    )

    salted = groups.withColumn("salt", F.pmod("key", F.lit(-(-int(counts.sum()) // SALT_ROWS) or 1)))
    salts = salted.groupBy("bytes", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("bytes").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shifts = salts.select("bytes", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(W.partitionBy("bytes", "salt").orderBy("key")) - 1
    ranked = salted.withColumn("local_rank", within).join(shifts, ["bytes", "salt"]).select("key", "bytes", (F.col("shift") + F.col("local_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descending, first, starts, targets = known.value
        for batch in batches:
            size, rank = (batch.column(k).to_numpy() for k in (1, 2))
            at = first[np.searchsorted(descending, -size)] + rank
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(targets[np.searchsorted(starts, at, side="right") - 1])], ["key", "shard"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(plan.shards, dtype=np.int64)
        for batch in batches:
            shard = batch.column(2).to_numpy()
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=plan.shards)
            local = np.empty(len(shard), dtype=np.int64)
            local[order] = group_ranks(counts) + np.repeat(seen, counts)
            seen += counts
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(local), pa.array(np.full(len(shard), part))], ["row", "size", "shard", "local_slot", "part"])

    placed = ranked.mapInArrow(place, "key long, shard int")
    dealt = base.join(placed, "key").select("row", "size", "shard")
    row_type = base.schema["row"].dataType.simpleString()
    numbered = cut(dealt.mapInArrow(number, f"row {row_type}, size long, shard int, local_slot long, part long"), "shards")
    parts = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return numbered.join(offsets, ["shard", "part"]).select("row", "size", "shard", (F.col("before") + F.col("local_slot")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int | None = SHARDS, capacity: int | None = None, text: str = "text") -> DataFrame:
    """Writes whole rows as Parquet, a folder per shard, in slot order and in files of ``FILE_ROWS`` rows; returns the written table."""
    out = assign_shards(docs, shards, capacity, text, docs.columns)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "shard", "slot")]
    rows = out.select(*kept, "size", "shard", "slot", F.expr(f"slot div {FILE_ROWS}").alias("_file"))
    files = rows.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file")
    files.write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def sharded(docs: DataFrame) -> DataFrame:
    """Every document's shard under the law of equal bytes."""
    named = docs.select(F.col("doc_id").cast("long"), "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = assign_shards(named, carry=("doc_id", "text_crc32"))
    return out.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
