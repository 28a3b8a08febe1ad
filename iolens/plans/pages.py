"""The history pages as compositions of history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from iolens.operators.history import (
    bucket_sum_by_host,
    bucket_sum_by_tag,
    focus_tag,
    in_range,
    job_extent,
    latest_active_share,
)


def overview(
    df: DataFrame, width: str = "1m", tag: str = "jid", event: str = "load_eff"
) -> dict[str, DataFrame]:
    """Share of each tag per host, and the heat map of all hosts."""
    return {
        "shares": latest_active_share(df, tag, event),
        "heat_map": bucket_sum_by_host(df, width, event),
    }


def host_page(
    df: DataFrame, host: str, width: str = "1m", tag: str = "jid", event: str = "load_eff"
) -> dict[str, DataFrame]:
    """Share of each tag on one host, and its stacked series."""
    return {
        "shares": latest_active_share(df, tag, event, host),
        "series": bucket_sum_by_tag(df, width, tag, event, host),
    }


def job_detail(
    df: DataFrame, jid: str, width: str = "30m", event: str = "nclients", host: str | None = None
) -> DataFrame:
    """Series of one job against all others over the job's life, first row included.

    The job's extent is a scalar subquery, so the bounds reach the scan of the
    second pass and it stays one plan.
    """
    extent = job_extent(df, jid)
    rows = in_range(
        df,
        extent.select("first_time").scalar(),
        extent.select("last_time").scalar(),
        include_start=True,
    )
    return focus_tag(bucket_sum_by_tag(rows, width, "jid", event, host), "jid", jid)
