"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key in one
task. Here the order axis is cut into blocks: each block is summarised with an
ordinary (map-side combined) aggregate, the summaries - one row per key and
block - are scanned per key, and the result is carried into a window over
(key, block). No task ever sees more than one block of one key in full.

Blocks have a fixed width on the axis, which suits a dense order such as the offsets of a log;
for a sparse or uneven one give blocks of equal rows (:mod:`iolens.functions.blocks`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.functions.blocks import Blocks, block_of

BLOCK_ROWS = 1 << 20  # width of a block on the (integral) order axis

_BLOCK = "__block"
_CARRY = "__carry_"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, Column]],
    inclusive: bool = False,
    block_rows: int | Blocks = BLOCK_ROWS,
) -> DataFrame:
    """Add running ``max``, non-null ``last`` or ``count`` columns per key.

    ``columns`` maps an output name to ``(how, value)``. The frame is all rows
    of the key before the current one in ``order``, plus the row itself when
    ``inclusive``. ``order[0]`` must be integral; it places the blocks.
    """
    position = F.struct(*order)
    summaries = {
        "max": lambda v: F.max(v),
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), position)),
        "count": lambda v: F.count(v),
    }
    scans = {
        "max": lambda v: F.max(v),
        "last": lambda v: F.last(v, ignorenulls=True),
        "count": lambda v: F.count(v),
    }
    merges = {
        "max": lambda carried, local: F.greatest(carried, local),
        "last": lambda carried, local: F.coalesce(local, carried),
        "count": lambda carried, local: F.coalesce(carried, F.lit(0)) + local,
    }

    blocked = df.withColumn(_BLOCK, block_of(F.col(order[0]), block_rows))
    before = (
        Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = blocked.groupBy(*keys, _BLOCK).agg(
        *[summaries[how](value).alias(name) for name, (how, value) in columns.items()]
    )
    carried = carried.select(
        *keys,
        _BLOCK,
        *[
            (F.sum(name) if how == "count" else scans[how](F.col(name)))
            .over(before)
            .alias(_CARRY + name)
            for name, (how, _) in columns.items()
        ],
    )
    inside = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        blocked.join(carried, [*keys, _BLOCK])
        .select(
            *df.columns,
            *[
                merges[how](F.col(_CARRY + name), scans[how](value).over(inside)).alias(name)
                for name, (how, value) in columns.items()
            ],
        )
    )


def asof_last(
    probes: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    block_rows: int | Blocks = BLOCK_ROWS,
) -> DataFrame:
    """Left as-of lookup: the last non-null of each value at or before a probe.

    An update at the same position as a probe is seen by it.
    """
    extra = [c for c in probes.columns if c not in (*keys, *order)]
    typed = {f.name: f.dataType for f in probes.schema.fields}
    left = probes.select(
        *keys, *order, F.lit(1).alias("__src"), *extra,
        *[F.lit(None).cast(updates.schema[v].dataType).alias("__in_" + v) for v in values],
    )
    right = updates.select(
        *keys, *order, F.lit(0).alias("__src"),
        *[F.lit(None).cast(typed[c]).alias(c) for c in extra],
        *[F.col(v).alias("__in_" + v) for v in values],
    )
    scanned = running(
        left.unionByName(right),
        keys,
        [*order, "__src"],
        {v: ("last", F.col("__in_" + v)) for v in values},
        inclusive=True,
        block_rows=block_rows,
    )
    return scanned.where("__src = 1").select(*keys, *order, *extra, *values)
