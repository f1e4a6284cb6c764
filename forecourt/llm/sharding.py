"""Shards of nearly equal size from groups that must stay together.

Best fit by descending size: a group goes to the shard with the least remaining capacity
that still takes it.  Shards have one fixed capacity, the smallest for which the wanted
number of shards is enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from forecourt.workspace import stored

SHARDS = 24
#: A group of at least this share of a shard is placed by itself; smaller ones are bundled up
#: to this share first.  It bounds what the last step places, whatever the number of groups.
BUNDLE_SHARE = 1 / 500
#: Bytes that every row takes besides its text.
ROW_BYTES = 8
_TASK_GROUPS = 500_000


class Remaining:
    """Open bins by remaining capacity, in a balanced tree.

    A treap: nodes are ordered by (capacity, bin) from left to right, and by rank from the
    root down.  A node's rank is a hash of its bin's number, so the tree is balanced whatever
    the capacities are, and the same on every run: finding, removing and adding a bin takes
    logarithmic time.  The root hangs to the right of ``top``.
    """

    def __init__(self) -> None:
        self.top: list = [None, None, None, None]

    def add(self, free: int, number: int) -> None:
        key, rank = (free, number), _rank(number)
        hook, side = self.top, _HIGH
        at = hook[side]
        while at is not None and at[_RANK] > rank:
            hook, side = at, _HIGH if at[_KEY] < key else _LOW
            at = hook[side]
        node = hook[side] = [key, rank, None, None]
        # What hung here is cut along the key: lower bins go to the left, the others to the right.
        lower, higher = (node, _LOW), (node, _HIGH)
        while at is not None:
            if at[_KEY] < key:
                lower[0][lower[1]] = at
                lower, at = (at, _HIGH), at[_HIGH]
            else:
                higher[0][higher[1]] = at
                higher, at = (at, _LOW), at[_LOW]
        lower[0][lower[1]] = higher[0][higher[1]] = None

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        found, hook, side = None, self.top, _HIGH
        while (at := hook[side]) is not None:
            if at[_KEY][0] >= size:
                found = (hook, side)
                hook, side = at, _LOW
            else:
                hook, side = at, _HIGH
        if found is None:
            return None
        hook, side = found
        key, _, low, high = hook[side]
        while low is not None and high is not None:
            if low[_RANK] > high[_RANK]:
                hook[side] = low
                hook, side, low = low, _HIGH, low[_HIGH]
            else:
                hook[side] = high
                hook, side, high = high, _LOW, high[_LOW]
        hook[side] = high if low is None else low
        return key

    def depth(self) -> int:
        """Levels of the tree."""
        level, deep = [self.top[_HIGH]], 0
        while level := [node for node in level if node is not None]:
            level = [child for node in level for child in (node[_LOW], node[_HIGH])]
            deep += 1
        return deep


_KEY, _RANK, _LOW, _HIGH = range(4)


def _rank(number: int) -> int:
    """A number spread over 64 bits, no two alike."""
    mixed = (number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return (mixed ^ mixed >> 32) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF


def best_fit_decreasing(sizes: np.ndarray, capacity: int, most: int | None = None) -> np.ndarray | None:
    """Bin of every item; a larger item than ``capacity`` gets a bin of its own.

    Equal sizes keep their order.  None if more than ``most`` bins are needed.
    """
    bins = np.empty(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    open_bins, made = Remaining(), 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        found = open_bins.take(size)
        if found is None:
            if most is not None and made == most:
                return None
            found, made = (max(capacity, size), made), made + 1
        bins[i] = found[1]
        if found[0] > size:
            open_bins.add(found[0] - size, found[1])
    return bins


def fixed_capacity(sizes: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """The least capacity found for which ``shards`` bins are enough, and the bins.

    Halving the interval between the mean of what the oversized items leave and a capacity
    that surely suffices; the number of trials grows with the logarithm of the sizes only.
    """
    if not len(sizes):
        return 0, np.empty(0, np.int64)
    rest, left = np.sort(sizes)[::-1], shards
    while left > 1 and len(rest) and rest[0] * left > rest.sum():
        rest, left = rest[1:], left - 1  # an item above the mean fills a shard by itself
    low = max(1, -(-int(rest.sum()) // left)) if len(rest) else 1
    high, best = low, best_fit_decreasing(sizes, low, shards)
    step = max(1, low // 4096)
    while best is None:
        low, high = high + 1, high + step
        step *= 2
        best = best_fit_decreasing(sizes, high, shards)
    while high - low > high // 100_000:
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle, shards)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return high, best


def _bundled(groups: DataFrame, capacity: int, rows: int) -> DataFrame:
    """``group`` and ``bundle``: small groups, best-fitted within tasks to bundles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("bytes", "descending"), ("group", "ascending"), ("crc", "ascending")])
        bins = best_fit_decreasing(table.column("bytes").to_numpy(), capacity)
        bundle = pa.array((np.int64(TaskContext.get().partitionId() + 1) << 32) + bins)
        for batch in table.append_column("bundle", bundle).combine_chunks().to_batches(max_chunksize=10_000):
            yield batch

    tasks = max(1, -(-rows // _TASK_GROUPS))
    schema = groups.select("*", F.lit(0).cast("bigint").alias("bundle")).schema
    return groups.repartition(tasks).mapInArrow(run, schema)


def shards_by_bytes(
    docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", row_bytes: int = ROW_BYTES,
    bundle_share: float = BUNDLE_SHARE,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row of ``docs``.

    Equal texts are a group and share a shard; a group's size is that of all its rows.
    Groups of ``bundle_share`` of a shard or more (at most ``shards`` / ``bundle_share`` of
    them) are placed one by one, smaller ones in bundles, so the last step sees a bounded
    number of items and its result is a table of that size.  Texts are grouped by their
    64-bit hash, checksum and length.  NULL texts are one group, of ``row_bytes`` a row;
    repeated rows are rows of their own; an empty table gives no rows.  Slots count from 0
    in each shard.
    """
    spark = docs.sparkSession
    body = F.col(text)
    read = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + row_bytes).cast("bigint").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("group"),
    )
    rows = stored(read, "sized")
    groups = rows.groupBy("group", F.col("text_crc32").alias("crc"), F.col("size").alias("one")).agg(F.sum("size").alias("bytes"))
    groups = stored(groups, "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    limit = max(1, int(total["bytes"] / shards * bundle_share))
    large = groups.filter(F.col("bytes") >= limit)
    small = groups.filter(F.col("bytes") < limit)
    bundled = _bundled(small, limit, total["n"])
    # A large group is a bundle by itself; its number is negative.
    alone = large.withColumn("bundle", -F.monotonically_increasing_id() - 1)
    placed = stored(alone.unionByName(bundled), "bundles")
    items = placed.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "bundle").toArrow()
    numbers, sizes = items.column("bundle").to_numpy(), items.column("bytes").to_numpy()
    _, bins = fixed_capacity(sizes, shards)
    table = pa.table({"bundle": pa.array(numbers, pa.int64()), "shard": pa.array(bins, pa.int64())})
    shard_of = spark.createDataFrame(table).withColumn("shard", F.col("shard").cast("int"))
    # At most shards / bundle_share large groups, twice as many bundles, and one per task.
    assigned = placed.join(F.broadcast(shard_of), "bundle").select(
        F.col("group").alias("g"), F.col("crc").alias("c"), F.col("one").alias("s"), "shard"
    )
    same = (F.col("group") == F.col("g")) & (F.col("text_crc32") == F.col("c")) & (F.col("size") == F.col("s"))
    sharded = rows.join(assigned, same).select("doc_id", "size", "text_crc32", "shard")
    return with_slots(sharded)


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: gapless numbers from 0 within each ``shard`` (this runs a job).

    Rows are numbered where they lie, by partition and shard, written, and moved up by what
    the partitions before hold of the shard; no shard is gathered in one task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            shards = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            local = np.empty(len(shards), np.int64)
            for s in np.unique(shards).tolist():
                mine = shards == s
                start = counts.get(s, 0)
                counts[s] = start + int(mine.sum())
                local[mine] = np.arange(start, counts[s])
            parts = pa.array(np.full(len(shards), part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(local)], names=[*batch.schema.names, "part_", "local_"])

    schema = rows.select("*", F.lit(0).alias("part_"), F.lit(0).cast("bigint").alias("local_")).schema
    placed = stored(rows.mapInArrow(run, schema), "placed")
    sizes = placed.groupBy("shard", "part_").agg(F.max("local_").alias("top"))
    before = Window.partitionBy("shard").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition and shard.
    starts = sizes.select("shard", "part_", F.coalesce(F.sum(F.col("top") + 1).over(before), F.lit(0)).alias("start_"))
    joined = placed.join(F.broadcast(starts), ["shard", "part_"])
    return joined.withColumn("slot", F.col("start_") + F.col("local_")).drop("part_", "local_", "start_")
