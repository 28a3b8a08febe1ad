"""Host state, node map and the tags they give to data entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions.blocks import Blocks
from iolens.functions.names import fs_name
from iolens.functions.scans import BLOCK_ROWS, asof_last, running
from iolens.schema import ORDER, UNKNOWN
from iolens.sources.reports import classify_messages

_ATTRIBUTES = ("time", "system", "jid", "uid", "obdclass")
_LOOKED_UP = ("system", "jid", "uid")
Keep = Callable[[DataFrame], DataFrame]


def host_state(messages: DataFrame, asof: int | None = None) -> DataFrame:
    """Per host the last arrived non-missing time, system, jid, uid and obdclass.

    One aggregate with map-side combine, so a host with most of the messages
    costs no more than the others. Job and user start as unknown.
    """
    if asof is not None:
        messages = messages.where(F.col("arrival_seq") <= asof)
    position = F.struct(*ORDER)
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in _ATTRIBUTES
    ]
    return (
        messages.groupBy("hostname")
        .agg(*last)
        .fillna(UNKNOWN, ["jid", "uid"])
    )


def host_state_history(messages: DataFrame, block_rows: int | Blocks = BLOCK_ROWS) -> DataFrame:
    """The state of the host after each of its messages."""
    plain = messages.select("hostname", *ORDER, *[F.col(c).alias("__" + c) for c in _ATTRIBUTES])
    return (
        running(
            plain, ["hostname"], ORDER,
            {c: ("last", F.col("__" + c)) for c in _ATTRIBUTES},
            inclusive=True, block_rows=block_rows,
        )
        .select("hostname", *ORDER, *_ATTRIBUTES)
        .fillna(UNKNOWN, ["jid", "uid"])
    )


def node_map(messages: DataFrame, asof: int | None = None) -> DataFrame:
    """Per node id the last host mapped to it, with that host's current tags."""
    if asof is not None:
        messages = messages.where(F.col("arrival_seq") <= asof)
    nodes = (
        classify_messages(messages)
        .where("kind = 'node'")
        .groupBy("nid")
        .agg(F.max_by("hostname", F.struct(*ORDER)).alias("hostname"))
    )
    state = host_state(messages).select("hostname", *_LOOKED_UP)
    return nodes.join(state, "hostname").select(
        "nid", F.col("hostname").alias("client"), *_LOOKED_UP
    )


def _tagged(entries: DataFrame) -> DataFrame:
    """Fill the defaults of looked-up tags and name the file system."""
    has_client = F.col("client_nid").isNotNull()
    tags = {
        "client": F.coalesce("client", "client_nid"),
        **{c: F.coalesce(c, F.lit(UNKNOWN)) for c in _LOOKED_UP},
        "fid": F.coalesce(fs_name("target"), F.lit(UNKNOWN)),
    }
    return entries.withColumns({c: F.when(has_client, v) for c, v in tags.items()})


def tag_entries(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tag entries from one node map, the same for all of them.

    A left join on the node id. Spark broadcasts the map while it is below its
    own size limit; beyond that it shuffles, and splits a hot node id at run time.
    """
    return _tagged(entries.join(nodes.withColumnRenamed("nid", "client_nid"), "client_nid", "left"))


def asof_tags(
    clients: DataFrame,
    messages: DataFrame,
    block_rows: int | Blocks = BLOCK_ROWS,
    keep: Keep = lambda df: df,
) -> DataFrame:
    """``client_nid, *ORDER, client, system, jid, uid`` as known when each report arrived.

    Two as-of lookups, node id to host and host to tags, on the distinct (node id,
    report) pairs. Each reads its input twice; ``keep`` may hold on to it.
    """
    nodes = (
        classify_messages(messages)
        .where("kind = 'node'")
        .select(F.col("nid").alias("client_nid"), *ORDER, F.col("hostname").alias("client"))
    )
    named = keep(asof_last(keep(clients), nodes, ["client_nid"], ORDER, ["client"], block_rows))
    updates = messages.select(F.col("hostname").alias("client"), *ORDER, *_LOOKED_UP).where(
        "system is not null or jid is not null or uid is not null"
    )
    return asof_last(
        named.where("client is not null"), updates, ["client"], ORDER, list(_LOOKED_UP), block_rows
    )


def tag_entries_asof(
    entries: DataFrame,
    messages: DataFrame,
    block_rows: int | Blocks = BLOCK_ROWS,
    clients: DataFrame | None = None,
) -> DataFrame:
    """Tag each entry with the mapping known when its report arrived.

    ``clients`` gives the (node id, report) pairs where they can be had without the
    entries (:func:`iolens.sources.reports.clients_of`). The wide entries are shuffled
    for the join back; :func:`tags_by_report` spares that.
    """
    if clients is None:
        clients = entries.where("client_nid is not null").select("client_nid", *ORDER).distinct()
    elif "entry_from" in clients.columns:
        clients = clients.select("client_nid", *ORDER).distinct()
    return _tagged(entries.join(asof_tags(clients, messages, block_rows), ["client_nid", *ORDER], "left"))


def tags_by_report(tags: DataFrame) -> DataFrame:
    """``*ORDER, tags``: one map per report, or piece of one, from node id to tags, no longer than that."""
    pair = F.struct("client_nid", F.struct("client", *_LOOKED_UP))
    place = [*ORDER, *[c for c in ("entry_from",) if c in tags.columns]]
    return tags.groupBy(*place).agg(F.map_from_entries(F.collect_list(pair)).alias("tags"))


def tag_from_report(entries: DataFrame) -> DataFrame:
    """Tag entries that carry their report's map in ``tags``."""
    own = F.col("tags")[F.col("client_nid")]
    return _tagged(entries.withColumns({c: own[c] for c in ("client", *_LOOKED_UP)}).drop("tags"))
