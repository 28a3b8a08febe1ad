"""Blocks of an order axis: of a fixed width, or with about as many rows each wherever the rows are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BORDERS = 255  # quantiles found at most; parts between them are cut evenly


@dataclass(frozen=True)
class Blocks:
    """Parts of an axis between borders, each cut into ``cuts`` blocks of one width.

    ``borders`` includes both ends of the axis; what is beyond them belongs to the first and last part.
    """

    borders: Sequence[int]
    cuts: int = 1

    def of(self, order: Column) -> Column:
        part = rank_among(order, self.borders[1:-1])
        if self.cuts == 1:
            return part.cast("bigint")
        ends = F.array(*[F.lit(b).cast("bigint") for b in self.borders])
        low, high = F.element_at(ends, part + 1), F.element_at(ends, part + 2)
        cut = F.floor((order - low) / F.greatest(high - low, F.lit(1)) * self.cuts)
        return part * self.cuts + F.least(F.greatest(cut, F.lit(0)), F.lit(self.cuts - 1)).cast("bigint")


def equal_blocks(df: DataFrame, order: str, rows: int) -> Blocks:
    """Blocks of about ``rows`` rows of ``df``, by sampled quantiles of its integral ``order`` column.

    One aggregate over that column; a null order counts for nothing. However sparse the axis and wherever
    the rows crowd on it, a block stays within a small factor of ``rows``, but for rows of one place.
    """
    shares = [n / (_BORDERS + 1) for n in range(1, _BORDERS + 1)]
    found = df.agg(F.count(order), F.min(order), F.max(order), F.percentile_approx(order, shares, 10 * _BORDERS)).first()
    count, low, high, borders = found
    parts = min(_BORDERS + 1, -(-count // rows))
    if parts <= 1:
        return Blocks([low or 0, high or 0])
    inner = sorted({borders[n * (_BORDERS + 1) // parts - 1] for n in range(1, parts)})
    return Blocks([low, *inner, high], -(-count // (parts * rows)))


def block_of(order: Column, blocks: int | Blocks) -> Column:
    """The block of a place; a number stands for blocks of that width from 0."""
    return blocks.of(order) if isinstance(blocks, Blocks) else F.floor(order / F.lit(blocks))


def rank_among(key: Column, borders: Sequence[int], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted borders are below the key, by halving."""
    high = len(borders) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key > borders[middle], rank_among(key, borders, middle + 1, high)).otherwise(rank_among(key, borders, low, middle))
