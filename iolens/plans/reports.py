"""Whole plans from messages to tag groups and to the ranked view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions.blocks import Blocks, equal_blocks
from iolens.operators.groups import derive_events, filter_groups, group_rates
from iolens.operators.rates import (
    STEP,
    accept_samples,
    aggregate_with_load,
    coalesce_ticks,
    newest_samples,
    rates,
    rates_of_placed,
    steps_of,
)
from iolens.operators.tagging import asof_tags, node_map, tag_from_report, tags_by_report
from iolens.operators.view import rank, top_view
from iolens.schema import ORDER, TAGS
from iolens.sources.reports import (
    BLOCK,
    carried_between,
    classify_messages,
    clients_of,
    explode_entries,
    last_before,
    mappings_of,
    messages_between,
    pieces_of,
    samples_of,
    with_pieces,
)
from iolens.sources.shared import kept


def groups_from_entries(
    tagged: DataFrame, samples: DataFrame | None = None, tags: Sequence[str] = TAGS
) -> DataFrame:
    """Tagged entries to tag groups with the server's load on each."""
    return aggregate_with_load(rates(tagged, samples), tags)


#: Rows of a block of an ordered scan, on average.
BLOCK_ROWS = 1 << 20


def tags_of(messages: DataFrame, mode: str = "asof", blocks: Blocks | None = None) -> DataFrame:
    """``client_nid, *ORDER`` and tags of the clients of every report, or of every piece of it."""
    if mode == "asof":
        return asof_tags(clients_of(messages), messages, **({"block_rows": blocks} if blocks else {}), keep=kept)
    if mode == "latest":
        nodes = node_map(messages).withColumnRenamed("nid", "client_nid")
        return clients_of(messages).join(nodes, "client_nid")
    raise ValueError(f"unknown tagging mode: {mode!r}")


def tagged_reports(
    messages: DataFrame, accepted: DataFrame, mode: str = "asof", blocks: Blocks | None = None
) -> DataFrame:
    """Tagged entries of the accepted samples, with what rates need to match them.

    Tags and places are found on narrow rows and joined to the pieces of the reports; the
    counters move once as such, and once as entries to those of their client. A row has the
    tags of its own piece only, however many clients the report has.
    """
    messages = with_pieces(messages)
    piece = [*ORDER, "entry_from"]
    steps = pieces_of(messages).join(steps_of(accepted), ["host", *ORDER])
    steps = steps.join(tags_by_report(tags_of(messages, mode, blocks)), piece, "left")
    samples = messages.where("data is not null").join(
        steps.withColumnRenamed("host", "hostname"), ["hostname", *piece]
    )
    return tag_from_report(explode_entries(samples, *STEP, "tags"))


def groups_from_messages(
    messages: DataFrame,
    mode: str = "asof",
    tags: Sequence[str] = TAGS,
    every: float | None = None,
    first: int | None = None,
    last: int | None = None,
    lookback: int = BLOCK,
    block: int = BLOCK,
    carry: DataFrame | None = None,
) -> DataFrame:
    """All tag groups of a feed.

    Samples, mappings and reports each read the messages, so give it stored ones
    (:func:`iolens.sources.reports.store_messages`), not the text. ``every`` keeps only the
    last report of a host in each tick of so many seconds. ``first`` and ``last`` give the
    groups of the reports that arrived in between, from that part of the store and
    ``lookback`` arrivals before it; hosts that were silent for longer go on from their last
    accepted report, so the rows are those of the feed up to ``last``. With the store's ``carry``
    (:func:`iolens.sources.reports.read_carry`) nothing before the block of ``first`` is read but that and
    one report of each host; ticks of ``every`` seconds are not in it.
    """
    if carry is not None and every is None:
        first, last = first or 0, (1 << 63) - 1 if last is None else last
        messages = kept(carried_between(messages, carry, first, last, block), "range")
    elif first is not None or last is not None:
        first, last = first or 0, (1 << 63) - 1 if last is None else last
        narrow = samples_of(messages.where(F.col("arrival_seq") <= last))
        if every is not None:
            narrow = coalesce_ticks(narrow, every)
        older = last_before(messages, narrow, first - lookback, block)
        messages = messages_between(messages, first, last, lookback, block).unionByName(older)
    samples = samples_of(messages)
    if every is not None:
        samples = coalesce_ticks(samples, every)
    # a report has some clients and a host many reports: the same borders serve all scans
    blocks = equal_blocks(samples, "arrival_seq", BLOCK_ROWS)
    entries = tagged_reports(messages, accept_samples(samples, block_rows=blocks), mode, blocks)
    return aggregate_with_load(rates_of_placed(entries, first), tags)


def current_groups(
    messages: DataFrame, mode: str = "latest", tags: Sequence[str] = TAGS
) -> DataFrame:
    """Tag groups of every server's last accepted sample, from stored messages.

    Only the last two reports of a server are read whole and go on to the tagging
    and rate steps, so their cost does not grow with the length of the feed.
    """
    newest = newest_samples(samples_of(messages))
    messages = with_pieces(classify_messages(messages))
    places = pieces_of(messages).join(newest, ["host", *ORDER], "left_semi").withColumnRenamed("host", "hostname")
    # on the keys of the join that follows, so that the reports move once
    recent = messages.join(places, ["hostname", *ORDER, "entry_from"], "left_semi")
    told = recent.unionByName(mappings_of(messages))
    return aggregate_with_load(rates_of_placed(tagged_reports(told, newest, mode)), tags)


def top_report(
    groups: DataFrame,
    level: str = "j",
    by: str = "load_eff",
    detailed: bool = False,
    totals: str = "filtered",
    events: Sequence[str] | None = None,
    **filters: str | None,
) -> DataFrame:
    """The ranked view of tag groups: filter, group, derive, rank.

    ``totals='all'`` shares the load among all groups before filtering.
    """
    if totals == "all":
        derived = filter_groups(derive_events(group_rates(groups, level)), **filters)
    else:
        derived = derive_events(group_rates(groups, level, **filters))
    return rank(top_view(derived, detailed, events), by)
