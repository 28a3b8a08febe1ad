"""The ranked view: derived groups as a table, its order and its pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens.schema import DERIVED

# Events the detailed view leaves out, and its smallest shown value.
HIDDEN = ("load", "load_eff", "read_bytes", "write_bytes", "iops", "bytes")
SHOWN_FROM = 2


def _tags(derived: DataFrame) -> list[str]:
    return [c for c in derived.columns if c not in (*DERIVED, "events")]


def _shown() -> Column:
    return F.map_filter(
        "events",
        lambda e, v: (v >= SHOWN_FROM) & ~e.contains("[usec") & ~e.isin(*HIDDEN, "nclients"),
    )


def top_view(
    derived: DataFrame, detailed: bool = False, events: Sequence[str] | None = None
) -> DataFrame:
    """Tags and the derived values; ``detailed`` adds a column for each of ``events``.

    A column holds values of 2 or more, and 0 where a row has none. Where the
    names are not known beforehand, :func:`top_events` has the same in rows.
    """
    columns = [*_tags(derived), *DERIVED]
    if not detailed:
        return derived.select(*columns)
    if events is None:
        raise ValueError("name the events of the detailed view, or take top_events")
    shown = _shown()
    return derived.select(*columns, *[F.coalesce(shown[e], F.lit(0.0)).alias(e) for e in events])


def top_events(derived: DataFrame) -> DataFrame:
    """The detailed view in rows: tags, derived values, event and its value of 2 or more."""
    return derived.select(*_tags(derived), *DERIVED, F.explode(_shown()).alias("event", "value"))


def rank(view: DataFrame, by: str = "load_eff") -> DataFrame:
    """Largest first, missing values last, ties in tag order."""
    return view.orderBy(F.col(by).desc_nulls_last(), *_tags(view))


def page(
    view: DataFrame, by: str = "load_eff", offset: int = 0, limit: int = 20, total: bool = False
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the ranked view.

    Each task keeps its first ``offset + limit`` rows; nothing is sorted whole.
    ``total`` adds the row count of the view, which computes it a second time.
    """
    rows = rank(view, by).offset(offset).limit(limit)
    if not total:
        return rows
    return rows.withColumn("total", view.agg(F.count(F.lit(1)).alias("n")).scalar())
