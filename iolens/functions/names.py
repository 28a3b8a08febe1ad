"""Column functions over names, units and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from iolens.schema import UNKNOWN

# Display unit of each event; every other event counts per second.
UNITS = {
    "load": "#cores",
    "load_eff": "#cores",
    "bytes": "MB/s",
    "read_bytes": "MB/s",
    "write_bytes": "MB/s",
    "nclients": "#",
    "iops": "#/s",
}
DEFAULT_UNIT = "#/s"

# Fixed value: a target name ends in a device suffix such as "-OST0000".
TARGET_SUFFIX = 8


def _column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fs_name(target: str | Column) -> Column:
    """File system of a storage target: its name without the device suffix."""
    name = _column(target)
    keep = F.length(name) - TARGET_SUFFIX
    return F.when(keep >= 0, name.substr(F.lit(1), keep)).otherwise(F.lit(UNKNOWN))


def short_host(host: str | Column) -> Column:
    """Label before the first dot."""
    return F.substring_index(_column(host), ".", 1)


def unit_of(event: str | Column) -> Column:
    pairs = [F.lit(x) for pair in UNITS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[_column(event)], F.lit(DEFAULT_UNIT))


def natural_key(name: str | Column) -> Column:
    """Sort key that orders n1, n2, n10; numbers of any length compare by value."""

    def piece(token: Column) -> Column:
        digits = F.regexp_replace(token, "^0+(?=[0-9])", "")
        return F.when(
            token.rlike("^[0-9]"),
            F.struct(F.lit(0).alias("text"), F.length(digits).alias("size"), digits.alias("token")),
        ).otherwise(
            F.struct(F.lit(1).alias("text"), F.lit(0).alias("size"), token.alias("token"))
        )

    return F.transform(
        F.regexp_extract_all(_column(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), piece
    )


def epoch_seconds(ntz: str | Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    t = _column(ntz)
    whole = F.unix_date(F.to_date(t)).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return whole.cast("double") + F.date_part(F.lit("SECOND"), t).cast("double")


def local_time(time: str | Column, zone: str, source_zone: str = "UTC") -> Column:
    """Zone-less wall-clock time of ``zone`` for a UTC zone-less timestamp."""
    return F.convert_timezone(F.lit(source_zone), F.lit(zone), _column(time))
