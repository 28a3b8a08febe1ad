"""Node files and job listings as mapping tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions.hostlists import expand_hosts
from iolens.schema import IDLE


def load_node_map(lines: DataFrame, three_col: bool = False) -> DataFrame:
    """``(hostname, nid, system)`` from lines ``nid hostname``; other lines are dropped.

    The system is the second dot label of the host name. ``three_col`` also takes
    ``nid fqdn hostname`` lines, with the fqdn's label where the host has none.
    """
    words = F.split(F.trim("line"), r"\s+")
    split = lines.withColumn("__w", words)

    def label(name):
        return F.get(F.split(name, r"\."), F.lit(1))

    second, third = F.get("__w", F.lit(1)), F.get("__w", F.lit(2))
    two = F.size("__w") == 2
    hostname, system, width = second, label(second), two
    if three_col:
        three = F.size("__w") == 3
        hostname = F.when(three, third).otherwise(second)
        system = F.when(three, F.coalesce(label(third), label(second))).otherwise(label(second))
        width = two | three
    keep = [c for c in lines.columns if c != "line"]
    return (
        split.where(width)
        .select(
            *keep, hostname.alias("hostname"), F.get("__w", F.lit(0)).alias("nid"),
            system.alias("system"),
        )
        .where("system is not null")
    )


def load_job_table(jobs: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hostname, jid, uid)`` of every inventory or job host, and the rejected rows.

    ``jobs`` is ``(line_no, line)`` with lines ``jobid user name hostlist``,
    ``inventory`` is ``(line_no, line)`` with one host expression per line. All
    inventory hosts are idle first; then the last job line naming a host wins.
    """
    words = F.split(F.trim("line"), r"\s+")
    split = jobs.select("line_no", "line", words.alias("__w"))
    good = split.where(F.size("__w") >= 4).select(
        F.lit(1).alias("priority"), "line_no",
        F.get("__w", F.lit(0)).alias("jid"), F.get("__w", F.lit(1)).alias("uid"),
        F.get("__w", F.lit(3)).alias("expr"),
    )
    idle = inventory.select(
        F.lit(0).alias("priority"), "line_no",
        F.lit(IDLE).alias("jid"), F.lit(IDLE).alias("uid"), F.col("line").alias("expr"),
    )
    expanded = expand_hosts(
        idle.unionByName(good), "expr", ["priority", "line_no", "jid", "uid"],
        allow_duplicates=True,
    )
    table = (
        expanded.where("host is not null")
        .groupBy(F.col("host").alias("hostname"))
        .agg(F.max_by(F.struct("jid", "uid"), F.struct("priority", "line_no")).alias("__last"))
        .select("hostname", "__last.jid", "__last.uid")
    )
    short = split.where(F.size("__w") < 4).select(
        F.lit(1).alias("priority"), "line_no", F.lit("too few columns").alias("error")
    )
    bad = expanded.where("error is not null").select("priority", "line_no", "error")
    return table, short.unionByName(bad)
