"""What a running feed has to remember, as three steps on Spark's own state store.

The messages become small events, which go from node id to host, from host to its
tags, and at last to the host that reported; the reports go to the last step only. Node ids and
hosts are dealt over a fixed number of keys, so that a step handles many of them at once; it keeps
one row for each: the host of a node id, the tags of a host. The last step keeps the parts by
clients of the last accepted report of a server.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from iolens.schema import ORDER
from iolens.sources.reports import classify_messages

# workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAGS_OF_CLIENT = ("system", "jid", "uid")
_EVENT = {
    "what": "string", "arrival_seq": "bigint", "msg_idx": "int", "host": "string", "nid": "string",
    "client": "string", "system": "string", "jid": "string", "uid": "string", "time": "double",
    "obdclass": "string", "lane": "int", "report": "string",
}
_EVENTS = ", ".join(f"{c} {t}" for c, t in _EVENT.items())
REPORTS = (
    "host string, arrival_seq bigint, msg_idx int, time double, prev_time double, number int, "
    "obdclass string, report string, tags string"
)
_KEYS = 512  # keys that names are dealt over; fixed, as a name stays with its key
_LANES = 64  # further keys, for events that a step only hands on
PARTS = 32  # parts of a server's reports, each with its own state; fixed, as a client stays in its part


def part_of(client_nid: Column, stats_type: Column | None = None) -> Column:
    """The part that has a client's entries; those of the cpu are in the first."""
    part = F.coalesce(F.pmod(F.hash(client_nid), F.lit(PARTS)), F.lit(0))
    return part if stats_type is None else F.when(stats_type == "cpu", 0).otherwise(part)


def events_of(messages: DataFrame, reports: bool = True, others: bool = True) -> DataFrame:
    """The events of each message; ``reports`` are those with entries.

    ``node`` maps a node id, ``tell`` has tags of a host, ``sample`` is a part of a report with its
    entries, numbered by ``at``, as JSON text, and ``ask`` is one client of a report whose tags are looked up.
    Every report has all parts, empty ones too, so each of them can tell which reports are accepted.
    """
    df = classify_messages(messages)
    order = {c: F.col(c) for c in ORDER}

    def event(what: str, **own: Column) -> Column:
        given = {"what": F.lit(what), **order, **own}
        return F.struct(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in _EVENT.items()])

    name = F.col("hostname")
    sample = (F.col("kind") == "sample") & F.col("time").isNotNull()
    told = F.coalesce(*TAGS_OF_CLIENT).isNotNull()
    node = F.when(F.col("kind") == "node", event("node", nid=F.col("nid"), client=name))
    tell = F.when(told, event("tell", client=name, **{c: F.col(c) for c in TAGS_OF_CLIENT}))
    fields = ("stats_type", "target", "client_nid", "server_nid", "stats")
    numbered = F.transform("data", lambda e, i: F.struct(part_of(e["client_nid"], e["stats_type"]).alias("lane"), F.struct(i.alias("at"), *[e[f].alias(f) for f in fields]).alias("e")))

    def report(part: Column) -> Column:
        own = F.transform(F.filter(numbered, lambda x: x["lane"] == part), lambda x: x["e"])
        return event("sample", host=name, time=F.col("time"), obdclass=F.col("obdclass"), lane=part, report=F.to_json(own))

    parts = F.when(sample, F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), report))
    clients = F.filter(F.array_distinct(F.col("data.client_nid")), lambda n: n.isNotNull())
    asks = F.when(sample, F.transform(clients, lambda n: event("ask", host=name, nid=n, lane=part_of(n))))
    none = F.array().cast(f"array<struct<{_EVENTS.replace(' ', ':').replace(',:', ',')}>>")
    small = [F.array_compact(F.array(node, tell)), F.coalesce(asks, none)] if others else []
    return df.select(F.inline(F.concat(*small, *([F.coalesce(parts, none)] if reports else []))))


def _key_of(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(_KEYS)).cast("int")


def _told_client() -> Column:
    """The tags of a client as a member of a JSON object."""
    text = F.to_json(F.create_map(F.coalesce("nid", F.lit("")), F.struct("client", *TAGS_OF_CLIENT)))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def reports_with_tags(messages: DataFrame, repeat_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Accepted reports of a stream with their clients' tags, each host's after the one it goes on from.

    Of every host with a new accepted report a batch has the last one before as ``number`` 0, unless there is
    none, and the new ones from 1 on. ``report`` and ``tags`` are JSON texts. A report comes in ``PARTS`` rows by its
    clients, and so is its state: no row or key of a step has to hold a whole one. A host that has sent nothing
    accepted for ``repeat_ms`` has its last two reports put out again; one that was silent for ``idle_ms`` is forgotten.
    """
    timed = "ProcessingTime" if repeat_ms or idle_ms else "None"
    what = F.col("what")
    to_node = F.when(what == "tell", _KEYS + F.pmod("arrival_seq", F.lit(_LANES)).cast("int")).otherwise(_key_of("nid"))
    named = (
        events_of(messages, reports=False).withColumn("key", to_node).groupBy("key")
        .transformWithStateInPandas(HostOfNode(), _EVENTS, "Append", "None")
    )
    tagged = (
        named.where("client is not null").withColumn("key", _key_of("client")).groupBy("key")
        .transformWithStateInPandas(TagsOfHost(), _EVENTS, "Append", "None")
    )
    # a report is wide: it meets its tags in the last step, without going through those before
    tagged = tagged.withColumn("report", _told_client()).unionByName(events_of(messages, others=False))
    return tagged.groupBy("host", "lane").transformWithStateInPandas(
        ReportsInOrder(repeat_ms, idle_ms), REPORTS, "Append", timed
    )


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The events of a key; at one place what tells comes before what asks."""
    parts = list(rows)
    events = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    place = events["what"].map({"node": 0, "tell": 0, "ask": 1, "sample": 2})
    return events.iloc[np.lexsort((place, *[events[c] for c in reversed(ORDER)]))]


class _LastKnown(StatefulProcessor):
    """Gives the events that ask the last value of each column told of their name before them, and keeps the last ones."""

    name: str
    columns: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", ", ".join(f"{c} string" for c in ("name", *self.columns)))

    def handleInputRows(self, key, rows, timerValues):
        if key[0] >= _KEYS:
            for part in rows:
                yield part[list(_EVENT)]
            return
        known = {name: values for name, *values in self.known.get()}
        none, asked, answers, changed = [None] * len(self.columns), [], [], False
        events = _in_order(rows)
        # plain values: most keys have few rows, for which pandas takes longer to set out than to work
        told = zip(*[events[c].tolist() for c in self.columns])
        for at, (what, name, values) in enumerate(zip(events["what"].tolist(), events[self.name].tolist(), told)):
            before = known.get(name, none)
            if what == "ask":
                asked.append(at)
                answers.append(before)
                continue
            now = [b if v is None or v != v else v for v, b in zip(values, before)]
            if now != before:
                known[name], changed = now, True
        if changed:
            self.known.put([(name, *values) for name, values in known.items()])
        out = events.iloc[asked][list(_EVENT)]
        for column, values in zip(self.columns, zip(*answers)):
            out[column] = pd.Series(values, out.index, dtype=object)
        yield out

    def close(self) -> None:
        pass


class HostOfNode(_LastKnown):
    """The host that a node id was last mapped to when a report arrived."""

    name, columns = "nid", ("client",)


class TagsOfHost(_LastKnown):
    """The tags last told of a client when a report arrived."""

    name, columns = "client", TAGS_OF_CLIENT


_KEPT = "arrival_seq bigint, msg_idx int, time double, obdclass string, report string"


class ReportsInOrder(StatefulProcessor):
    """Accepts the reports of a host that are newer than all before, and keeps its part of the last one."""

    def __init__(self, repeat_ms: int | None, idle_ms: int | None):
        self.repeat_ms, self.idle_ms = repeat_ms, idle_ms
        self.wait_ms = min([w for w in (repeat_ms, idle_ms) if w], default=None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"{_KEPT}, tags string, seen_ms bigint")
        self.before = handle.getValueState("before", _KEPT)

    def handleInputRows(self, key, rows, timerValues):
        events = _in_order(rows)
        asks = events[events["what"] == "ask"]
        tags = asks.groupby(list(ORDER), sort=False)["report"].agg(",".join).to_dict()
        samples = events[events["what"] == "sample"]
        start = self.last.get()
        accepted = [] if start is None else [tuple(start[:6])]
        top = None if start is None else start[2]
        for seq, idx, time, cls, report in zip(*[samples[c] for c in (*ORDER, "time", "obdclass", "report")]):
            if top is None or time > top:
                top = time
                told = "{" + tags.get((seq, idx), "") + "}"
                accepted.append((seq, idx, time, None if pd.isna(cls) else cls, report, told))
        new = len(accepted) - (start is not None)
        if not new:
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.wait_ms else 0
        self.last.update((*accepted[-1], now))
        if self.repeat_ms and len(accepted) > 1:
            self.before.update(accepted[-2][:5])
        if self.wait_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(now + self.wait_ms)
        yield _rows(key[0], accepted, 1 if start is None else 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.last.exists():
            return
        now, last = timerValues.getCurrentProcessingTimeInMs(), self.last.get()
        if self.idle_ms and now - last[6] >= self.idle_ms:
            self.last.clear()
            self.before.clear()
            return
        self.handle.registerTimer(now + self.wait_ms)
        if self.repeat_ms and self.before.exists():
            yield _rows(key[0], [(*self.before.get(), None), tuple(last[:6])], 0)

    def close(self) -> None:
        pass


def _rows(host: str, accepted: list[tuple], first: int) -> pd.DataFrame:
    """Rows of ``REPORTS`` of one host."""
    frame = pd.DataFrame(accepted, columns=[*ORDER, "time", "obdclass", "report", "tags"])
    frame["host"], frame["prev_time"] = host, frame["time"].shift()
    frame["number"] = range(first, first + len(frame))
    return frame[[c.split()[0] for c in REPORTS.split(", ")]]
