"""Shards by best-fit-decreasing bin packing of groups that must stay together.

Groups larger than a set share of a shard are packed one by one. Smaller ones are first thrown
together by hash into a fixed number of bundles. Either kind has a bounded number whatever the size of
the data, so the packing itself sees a short list; documents find their shard by two small tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.llm.common import stored

#: Bundles per shard. Groups over that part of a shard are packed alone, at most as many per shard.
GRAIN = 1024
#: Rows of a shard that are numbered together.
NUMBERED = 4096


class Capacities:
    """A balanced tree (a treap) of remaining capacities; finds the tightest that is large enough."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def add(self, key: tuple[int, int]) -> None:
        small, large = self._split(self.root, key)
        weight = hashlib.blake2b(repr(key).encode(), digest_size=8).digest()
        self.root = self._merge(self._merge(small, [key, weight, None, None]), large)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and give the smallest key of at least ``least``; None if there is none."""
        small, large = self._split(self.root, (least, -1))
        if large is None:
            self.root = small
            return None
        node = large
        while node[2] is not None:
            node = node[2]
        rest = self._split(large, (node[0][0], node[0][1] + 1))[1]
        self.root = self._merge(small, rest)
        return node[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Nodes below the key, and from it on."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> Iterator[int]:
    """The bin of each size, given in falling order; a new bin is opened only if no open one fits.

    A size over the capacity gets a bin of its own.
    """
    open_bins, opened = Capacities(), 0
    for size in sizes:
        found = open_bins.take(size)
        if found is None:
            found, opened = (max(capacity, size), opened), opened + 1
        yield found[1]
        open_bins.add((found[0] - size, found[1]))


def pack(sizes: list[int], bins: int) -> list[int]:
    """Bins 0 to ``bins - 1`` for sizes in falling order, with the smallest capacity that is found to do."""
    total, largest = sum(sizes), max(sizes, default=0)
    low = max(-(-total // bins), largest)
    high, packed = low, None
    while packed is None:
        placed = list(best_fit_decreasing(sizes, high))
        packed = placed if max(placed, default=0) < bins else None
        high = high if packed else high + max(1, total // (bins * GRAIN))
    while high - low > max(1, total // (bins * GRAIN * 16)):
        middle = (low + high) // 2
        placed = list(best_fit_decreasing(sizes, middle))
        if max(placed, default=0) < bins:
            high, packed = middle, placed
        else:
            low = middle
    return packed


def group_key(text: Column) -> Column:
    """Equal texts have equal keys; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def shards(sized: DataFrame, bins: int = 8) -> DataFrame:
    """Add ``shard`` to rows with ``size`` (at least 1) and ``group_key``; a group stays together.

    Loads differ as little as the packing of whole groups allows: a group of more than an even share
    makes its shard that large. An empty table gives no rows.
    """
    spark = sized.sparkSession
    groups = stored(sized.groupBy("group_key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    grains = bins * GRAIN
    bundle = F.pmod(F.xxhash64("group_key"), F.lit(grains)).cast("int")
    large = F.col("bytes") * grains > total
    alone = groups.where(large)
    bundles = groups.where(~large).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    # at most `grains` of each kind
    items = [(r.bytes, r.group_key, None) for r in alone.collect()]
    items += [(r.bytes, None, r.bundle) for r in bundles.collect()]
    items.sort(key=lambda i: (-i[0], i[1] or b"", -1 if i[2] is None else i[2]))
    placed = pack([i[0] for i in items], bins)
    by_key = [(bytes(i[1]), b) for i, b in zip(items, placed) if i[1] is not None]
    by_bundle = [(i[2], b) for i, b in zip(items, placed) if i[1] is None]
    keyed = spark.createDataFrame(by_key, "group_key binary, own int")
    thrown = spark.createDataFrame(by_bundle, "bundle int, shared int")
    found = sized.withColumn("bundle", bundle).join(F.broadcast(keyed), "group_key", "left")
    found = found.join(F.broadcast(thrown), "bundle", "left")
    return found.withColumn("shard", F.coalesce("own", "shared")).drop("bundle", "own", "shared")


def slots(sharded: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``, numbering the rows of each ``shard`` from 0 without a gap.

    Rows are dealt by a hash of ``order`` into parts that are numbered by themselves; rows alike in
    all of ``order`` take neighbouring numbers.
    """
    rows = sharded.count()
    part = F.pmod(F.xxhash64(*order), F.lit(-(-rows // NUMBERED) or 1)).cast("int")
    parted = sharded.withColumn("part", part)
    sizes = parted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = sizes.select("shard", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    numbered = parted.withColumn("place", place).join(offsets, ["shard", "part"])
    return numbered.withColumn("slot", (F.col("before") + F.col("place")).cast("long")).drop("part", "place", "before")
