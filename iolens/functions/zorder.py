"""A Z-order over several text columns: rows that are near in any of them come near each other."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens.functions.blocks import rank_among

BITS = 4  # of each column's rank
_BYTES = 7  # of a text, after what all texts of the column begin with


def z_order(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> tuple[DataFrame, str]:
    """``df`` with one more column, by which to sort, and its name.

    A column's values are ranked by equal shares of the rows, so a frequent value takes several ranks' room and
    rare ones share one; the bits of all ranks are interleaved. Ranks follow the order of the texts, so the
    sort leaves small ranges of every column in each part. Two aggregates find the borders, ``2 ** bits`` a column;
    give the input stored.
    """
    ends = df.agg(*[f(F.coalesce(c, F.lit(""))).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    shared = [len(os.path.commonprefix([(ends[f"a{i}"] or "").encode(), (ends[f"b{i}"] or "").encode()])) for i in range(len(columns))]
    keyed = df.withColumns({f"__k{i}": _prefix(F.col(c), skip) for i, (c, skip) in enumerate(zip(columns, shared))})
    shares = [n / (1 << bits) for n in range(1, 1 << bits)]
    found = keyed.agg(*[F.percentile_approx(f"__k{i}", shares, 10_000).alias(f"p{i}") for i in range(len(columns))]).first()
    z = F.lit(0).cast("bigint")
    for i in range(len(columns)):
        rank = rank_among(F.col(f"__k{i}"), sorted(set(found[f"p{i}"] or [])))
        for bit in range(bits):
            z = z + F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("bigint"), bit * len(columns) + i)
    return keyed.withColumn("__z", z).drop(*[f"__k{i}" for i in range(len(columns))]), "__z"


def _prefix(text: Column, skip: int) -> Column:
    """Some bytes of a text as a number in the order of the texts."""
    digits = F.hex(F.encode(F.coalesce(text, F.lit("")), "utf-8"))
    return F.conv(F.rpad(F.substring(digits, 2 * skip + 1, 2 * _BYTES), 2 * _BYTES, "0"), 16, 10).cast("bigint")
