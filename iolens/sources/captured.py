"""Jobs over captured counter files: rows of (host, time, path, line_no, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed formats. A stats line is "key N" or "key N samples [unit]", the latter
# optionally with min, max and sum; ":" also ends a key. The cpu line is "cpu "
# and up to ten counters, of which seven are named.
_KEY = r"^([^ :\t\x0B\f\r]+)[ :\t\x0B\f\r]"
_STATS_LINE = _KEY + r"\s*([0-9]+)(?:\s*samples\s*(\S+)(?:\s+[0-9]+\s+[0-9]+\s+([0-9]+))?)?"
CPU_EVENTS = ("user", "nice", "system", "idle", "iowait", "irq", "softirq")


def parse_stats_text(lines: DataFrame) -> DataFrame:
    """One row per counter: ``key`` = count, and ``key_[unit]`` = sum where a sum is given."""
    keep = [c for c in lines.columns if c != "line"]
    # all four groups in one match; a line that does not match stays in one piece
    cut = F.split(F.regexp_replace("line", _STATS_LINE + ".*$", "$1\n$2\n$3\n$4"), "\n")
    parsed = (
        lines.select(*keep, cut.alias("__cut"))
        .where((F.size("__cut") == 4) & (F.get("__cut", F.lit(0)) != "snapshot_time"))
        .select(
            *keep,
            *[
                F.get("__cut", F.lit(i)).alias(n)
                for i, n in enumerate(("__key", "__n", "__unit", "__sum"))
            ],
        )
    )
    count = F.struct(F.col("__key").alias("key"), F.col("__n").try_cast("bigint").alias("value"))
    total = F.struct(
        F.concat_ws("_", "__key", "__unit").alias("key"),
        F.col("__sum").try_cast("bigint").alias("value"),
    )
    rows = F.when(F.col("__sum") == "", F.array(count)).otherwise(F.array(count, total))
    return parsed.select(*keep, F.inline(rows))


def stats_maps(counters: DataFrame, keys: tuple[str, ...] = ("host", "time", "path")) -> DataFrame:
    """Counters of one captured file as a ``stats`` map; a repeated key keeps its last line."""
    last = counters.groupBy(*keys, "key").agg(F.max_by("value", "line_no").alias("value"))
    return last.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("stats")
    )


def parse_cpu_text(lines: DataFrame) -> DataFrame:
    """Counters of the first cpu line per (host, time); 0 where it is short or absent."""
    is_cpu = F.col("line").startswith("cpu ")
    first = lines.groupBy("host", "time").agg(
        F.min_by(F.when(is_cpu, F.col("line")), F.when(is_cpu, F.col("line_no"))).alias("__line")
    )
    numbers = F.split(F.trim(F.regexp_extract("__line", r"^cpu((?:\s+[0-9]+)*)", 1)), r"\s+")
    return first.withColumn("__n", numbers).select(
        "host",
        "time",
        *[
            F.coalesce(F.get("__n", F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint")).alias(name)
            for i, name in enumerate(CPU_EVENTS)
        ],
    )
