"""Report messages: reading, parsing, classification and flattening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.schema import MESSAGE_SCHEMA, ORDER


def read_reports(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """Rows ``(arrival_seq, msg)`` from text files of ``arrival_seq<TAB>message`` lines.

    The sequence is the position in the feed (a log offset, say). Any other
    source works too once it yields these two columns. Lines without a sequence
    keep a null one and are left to :func:`parse_reports` to reject.
    """
    reader = (spark.readStream if streaming else spark.read).options(**options)
    parts = F.split("value", "\t", 2)
    return reader.text(path).select(
        F.get(parts, F.lit(0)).try_cast("bigint").alias("arrival_seq"),
        F.get(parts, F.lit(1)).alias("msg"),
    )


_MESSAGE = MESSAGE_SCHEMA.removeprefix("array<struct<").removesuffix(">>")
STORED = f"arrival_seq bigint, msg_idx int, entry_from int, {_MESSAGE}"

# Every field as text, objects and arrays included: a field of an odd type then spoils no other.
_FIELDS = ("hostname", "time", "obdclass", "nid", "system", "jid", "uid", "data")
_BAD = "__bad"
_ELEMENT = ", ".join(f"{f} string" for f in (*_FIELDS, _BAD))
_ENTRY_FIELDS = ("stats_type", "target", "client_nid", "server_nid")
_ENTRY = ", ".join(f"{f} string" for f in (*_ENTRY_FIELDS, "stats"))


def _elements(lines: DataFrame) -> DataFrame:
    """One row per element of each text: an object by itself, or the elements of an array."""
    text = F.col("msg")
    numbered = F.col("arrival_seq").isNotNull()
    listed = F.when(numbered & text.startswith("["), F.from_json(text, "array<string>"))
    single = F.when(numbered & text.startswith("{"), F.array(text))
    # an array of strings is null for a text that is no JSON; an empty array holds no report
    reason = F.when(numbered & text.startswith("[") & listed.isNull(), "bad json").otherwise("not a report")
    return lines.select(
        "arrival_seq", "msg",
        F.posexplode_outer(F.coalesce(listed, single)).alias("msg_idx", "__text"),
        reason.alias("__reason"),
    )


ENTRIES = f"array<struct<{', '.join(f'{f}: string' for f in _ENTRY_FIELDS)}, stats: map<string,string>>>"


def _whole_entries(data: Column) -> Column:
    """All entries of a JSON text at once, and that text where some entry is odd."""
    text = F.concat(F.lit('{"data":'), data, F.lit("}"))
    return F.from_json(text, f"data {ENTRIES}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD})


def _entries_of(data: Column) -> Column:
    """Data entries of their JSON text, each by itself; what is no object among them is left out."""
    texts = F.filter(F.from_json(data, "array<string>"), lambda t: t.startswith("{"))
    parsed = F.transform(texts, lambda t: F.from_json(t, _ENTRY))
    return F.transform(
        parsed,
        lambda e: F.struct(
            *[e[f].alias(f) for f in _ENTRY_FIELDS],
            F.from_json(e["stats"], "map<string,string>").alias("stats"),
        ),
    )


def parse_reports(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a feed into messages and rejects.

    Messages carry ``arrival_seq, msg_idx`` and the report fields. Rejects are
    ``(arrival_seq, msg, reason)``. Every element of a text is in one of them: a
    text that is no object or array, bad JSON, an element that is no object or
    has no host name, a time or data that does not parse, and data without a time.
    """
    parsed = _elements(lines).withColumn(
        "__m", F.when(F.col("__text").startswith("{"), F.from_json("__text", _ELEMENT, {"columnNameOfCorruptRecord": _BAD}))
    )
    time = F.trim("__m.time").try_cast("double")
    listed = F.col("__m.data").startswith("[")
    parsed = parsed.withColumn("__whole", F.when(listed, _whole_entries(F.col("__m.data"))))
    plain = F.filter("__whole.data", lambda e: e.isNotNull())
    data = F.when(listed, F.when(F.col(f"__whole.{_BAD}").isNull(), plain).otherwise(_entries_of(F.col("__m.data"))))
    reason = (
        F.when(F.col("msg_idx").isNull(), F.col("__reason"))
        .when(F.col("__m").isNull(), "not a report")
        .when(F.col(f"__m.{_BAD}").isNotNull(), "bad json")
        .when(F.col("__m.hostname").isNull(), "no hostname")
        .when(F.col("__m.time").isNotNull() & (time.isNull() | F.isnan(time)), "bad time")
        .when(F.col("__m.data").isNotNull() & data.isNull(), "bad data")
        .when(F.col("__m.data").isNotNull() & time.isNull(), "no time")
    )
    judged = parsed.withColumns({"__time": time, "__data": data, "reason": reason})
    plain = [F.col(f"__m.{f}").alias(f) for f in _FIELDS if f not in ("time", "data")]
    messages = judged.where("reason is null").select(
        "arrival_seq", "msg_idx", plain[0], F.col("__time").alias("time"), *plain[1:], F.col("__data").alias("data")
    )
    rejects = judged.where("reason is not null").select("arrival_seq", "msg", "reason")
    return messages, rejects


def classify_messages(messages: DataFrame) -> DataFrame:
    """Add ``kind``: a sample has data; else a node message has a node id; else host tags only."""
    if "kind" in messages.columns:
        return messages
    return messages.withColumn(
        "kind",
        F.when(F.col("data").isNotNull(), F.lit("sample"))
        .when(F.col("nid").isNotNull(), F.lit("node"))
        .otherwise(F.lit("host")),
    )


BLOCK = 1 << 20  # arrivals that are stored together
PIECE = 256  # entries of a report in one stored row, at most
_DEALT = 16  # parts of a block that are written by themselves
_ROW_GROUP = 16 << 20  # bytes that a reader or writer of the store holds of a file


def in_pieces(messages: DataFrame, most: int = PIECE) -> DataFrame:
    """The messages with at most ``most`` entries in a row; ``entry_from`` is the number of a row's first entry.

    A report has an entry for each client of its server. Its rows go through all steps by themselves, so
    none of them holds a whole report. Messages without data have a null there.
    """
    size = F.array_size("data")
    begin = F.col("entry_from") if "entry_from" in messages.columns else F.lit(0)
    last = F.coalesce(F.greatest(F.floor((size - 1) / most), F.lit(0)), F.lit(0)).cast("int")
    at = F.col("__piece") * most
    rows = messages.withColumn("__piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = {
        "entry_from": F.when(F.col("data").isNotNull(), F.coalesce(begin, F.lit(0)) + at).cast("int"),
        "data": F.when(size > most, F.slice("data", at + 1, F.lit(most))).otherwise(F.col("data")),
    }
    return rows.withColumns(pieces).drop("__piece")


def with_pieces(messages: DataFrame) -> DataFrame:
    """Messages that were never split are their own and only piece."""
    return messages if "entry_from" in messages.columns else messages.withColumn("entry_from", F.lit(0))


def store_messages(messages: DataFrame, path: str, load: str = "0", block: int = BLOCK) -> DataFrame:
    """Add parsed messages to a store, split by load, arrival block and kind, and read it back.

    The JSON is parsed once, and the steps that follow read what they need: a range of
    arrivals, node messages by themselves, or the samples' times, hosts and clients
    without the counters. A load that is stored again replaces itself and no other.
    A large report is stored in several rows (:func:`in_pieces`).
    """
    number = F.floor(F.col("arrival_seq") / block).cast("bigint")
    rows = classify_messages(in_pieces(messages)).withColumn("block", number)
    # the messages of a block come from few tasks, so that it has few files; no sampling, which would parse all twice
    dealt = rows.repartition("block", "kind", F.floor(F.pmod("arrival_seq", F.lit(block)) * _DEALT / block))
    writer = dealt.write.mode("overwrite").option("parquet.block.size", _ROW_GROUP)
    writer.partitionBy("block", "kind").parquet(f"{path}/load={load}")
    spark = messages.sparkSession
    told = spark.read.schema(f"{STORED}, block bigint, kind string").parquet(f"{path}/load={load}")
    carried = carry_of(told).repartition("block")
    carried.write.mode("overwrite").partitionBy("block").parquet(f"{path}/{CARRY}/load={load}")
    return read_messages(spark, path)


CARRY = "_carry"  # readers of the messages pass over folders that begin so
_TOLD = ("system", "jid", "uid")


def carry_of(messages: DataFrame) -> DataFrame:
    """What each block leaves to those after it, one row per node, host and tag: ``block, what, time`` and a message.

    Of ``what``, ``node`` is the last host of a node id, ``tag`` the last value of a host's tag, and ``sample`` the place
    of the host's report of the latest time, the earliest to arrive of those. Counters are not read.
    """
    place, none = F.struct(*ORDER), F.lit(None).cast("string")
    df = classify_messages(messages)
    ranked = F.struct("time", *[(-F.col(c)).alias(c) for c in ORDER])
    hosts = df.where("hostname is not null").groupBy("block", "hostname").agg(
        F.max(F.when((F.col("kind") == "sample") & F.col("time").isNotNull(), ranked)).alias("__sample"),
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(*ORDER, c))).alias(f"__{c}") for c in _TOLD],
    )
    empty = {"nid": none, **{c: none for c in _TOLD}, "time": F.lit(None).cast("double")}

    def row(what: str, order: Sequence[Column], **own: Column) -> Column:
        names = [f.alias(c) for c, f in zip(ORDER, order)]
        return F.struct(F.lit(what).alias("what"), *names, *[v.alias(c) for c, v in (empty | own).items()])

    tags = [F.when(F.col(f"__{c}").isNotNull(), row("tag", [F.col(f"__{c}")[o] for o in ORDER], **{c: F.col(f"__{c}")[c]})) for c in _TOLD]
    last = F.col("__sample")
    sample = F.when(last.isNotNull(), row("sample", [-last[o] for o in ORDER], time=last["time"]))
    of_hosts = hosts.select("block", "hostname", F.inline(F.array_compact(F.array(*tags, sample))))
    nodes = df.where("kind = 'node'").groupBy("block", "nid").agg(F.max_by("hostname", place).alias("hostname"), F.max(place).alias("__at"))
    of_nodes = nodes.select("block", "hostname", "nid", F.lit("node").alias("what"), *[F.col("__at")[c].alias(c) for c in ORDER])
    return of_hosts.unionByName(of_nodes, allowMissingColumns=True)


def read_carry(spark: SparkSession, path: str) -> DataFrame:
    """What the blocks of a store leave to later ones, for ranges of :func:`carried_between`."""
    fields = "hostname string, what string, arrival_seq bigint, msg_idx int, nid string, system string, jid string, uid string, time double"
    return spark.read.schema(f"{fields}, load string, block bigint").parquet(f"{path}/{CARRY}")


def carried_between(messages: DataFrame, carry: DataFrame, first: int, last: int, block: int = BLOCK) -> DataFrame:
    """All that the reports that arrived from ``first`` to ``last`` need of a store.

    These are the messages of the range, the mappings as they were before it, and the last accepted report of each
    host. Before the range only the block it begins in is read; of all blocks before that one their carry.
    """
    seq, edge, place = F.col("arrival_seq"), first // block, F.struct(*ORDER)
    df = classify_messages(messages)
    near = df.where((F.col("block") >= edge) & (F.col("block") <= last // block) & (seq >= first) & (seq <= last))
    begun = df.where((F.col("block") == edge) & (seq < first))
    old = carry.where(F.col("block") < edge)
    # one row per node id, and per host and tag, however many blocks there are
    nodes = old.where("what = 'node'").groupBy("nid").agg(F.max_by("hostname", place).alias("hostname"), F.max(place).alias("__at"))
    nodes = nodes.select("nid", "hostname", F.lit("node").alias("kind"), *[F.col("__at")[c].alias(c) for c in ORDER])
    told = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in _TOLD])
    tags = old.where("what = 'tag'").groupBy("hostname", told.alias("__told")).agg(F.max(F.struct(*ORDER, *_TOLD)).alias("__last"))
    tags = tags.select("hostname", F.lit("host").alias("kind"), "__last.*")
    known = nodes.unionByName(tags, allowMissingColumns=True)

    ranked = F.struct("time", *[(-F.col(c)).alias(c) for c in ORDER])
    seen = samples_of(begun).select(F.col("host").alias("hostname"), *ORDER, "time")
    seen = seen.unionByName(old.where("what = 'sample'").select("hostname", *ORDER, "time"))
    newest = seen.groupBy("hostname").agg(F.max(ranked).alias("__last"))
    places = newest.select("hostname", *[(-F.col("__last")[c]).cast(t).alias(c) for c, t in df.select(*ORDER).dtypes])
    places = places.withColumn("block", F.floor(F.col("arrival_seq") / block).cast("bigint"))
    # the joined side is split by block, so only blocks with such a report are read; their tags are among the mappings
    reports = df.where((F.col("kind") == "sample") & (F.col("block") <= edge) & (seq < first))
    reports = reports.join(places, ["hostname", *ORDER, "block"], "left_semi")
    reports = reports.withColumns({c: F.lit(None).cast("string") for c in _TOLD}).select(df.columns)
    before = mappings_of(begun).unionByName(known, allowMissingColumns=True).select(df.columns)
    return near.unionByName(before).unionByName(reports)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{STORED}, load string, block bigint, kind string").parquet(path)


def messages_between(
    messages: DataFrame, first: int, last: int, lookback: int = BLOCK, block: int = BLOCK
) -> DataFrame:
    """What the reports that arrived from ``first`` to ``last`` need of a store.

    All mappings up to then, and samples from ``lookback`` arrivals before. Of the older ones
    :func:`last_before` has those that hosts go on from.
    """
    seq = F.col("arrival_seq")
    df = classify_messages(messages).where(seq <= last)
    near, far = seq >= first - lookback, seq < first - lookback
    if "block" in df.columns:
        edge = (first - lookback) // block
        df = df.where(F.col("block") <= last // block)
        near, far = near & (F.col("block") >= edge), far & (F.col("block") <= edge)
    return df.where(near).unionByName(mappings_of(df.where(far)))


def last_before(messages: DataFrame, samples: DataFrame, first: int, block: int = BLOCK) -> DataFrame:
    """The reports of each host's last accepted one of ``samples`` that arrived before ``first``.

    They are found on narrow rows: the last accepted is the earliest arrival of the latest time.
    """
    place = F.struct("time", *[(-F.col(c)).alias(c) for c in ORDER])
    newest = samples.where(F.col("arrival_seq") < first).groupBy("host").agg(F.max(place).alias("__last"))
    places = newest.select(F.col("host").alias("hostname"), *[(-F.col("__last")[c]).cast(t).alias(c) for c, t in samples.select(*ORDER).dtypes])
    df, keys = classify_messages(messages).where("kind = 'sample'").where(F.col("arrival_seq") < first), ["hostname", *ORDER]
    if "block" in df.columns:
        places, keys = places.withColumn("block", F.floor(F.col("arrival_seq") / block).cast("bigint")), [*keys, "block"]
    # their tags are among the mappings
    tags = {c: F.lit(None).cast("string") for c in ("system", "jid", "uid")}
    return df.join(places, keys, "left_semi").withColumns(tags).select(df.columns)


def mappings_of(messages: DataFrame) -> DataFrame:
    """The messages that tell of nodes or tags, without their data; same columns."""
    df = classify_messages(messages)
    told = df.where("kind <> 'sample' or coalesce(system, jid, uid) is not null")
    return told.withColumns(
        {
            "data": F.lit(None).cast(df.schema["data"].dataType),
            "kind": F.when(F.col("kind") == "sample", "host").otherwise(F.col("kind")),
        }
    )


_LARGEST = (1 << 63) - 1


def counter(value: str | Column) -> Column:
    """64-bit value of a counter's text; fractions are cut, larger values stop at the
    largest, and other text is 0."""
    v = F.col(value) if isinstance(value, str) else value
    real = v.try_cast("double")
    return F.coalesce(
        v.try_cast("bigint"),
        F.when(real >= float(_LARGEST), F.lit(_LARGEST)).when(real <= -float(_LARGEST), F.lit(-_LARGEST - 1)),
        real.try_cast("bigint"),
        F.lit(0).cast("bigint"),
    )


def unique_keys(stats: Column) -> Column:
    """A map in which each key of the text has its last value."""
    pairs = F.map_entries(stats)
    later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
    last = F.map_from_entries(F.filter(pairs, lambda p, i: ~later(p, i)))
    keys = F.map_keys(stats)
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), last).otherwise(stats)


def _samples(messages: DataFrame) -> DataFrame:
    return classify_messages(messages).where("kind = 'sample' and time is not null")


def samples_of(messages: DataFrame) -> DataFrame:
    """The (host, arrival, time) of every message with data, empty data included."""
    samples = _samples(messages)
    if "entry_from" in messages.columns:
        samples = samples.where("entry_from = 0")
    return samples.select(F.col("hostname").alias("host"), *ORDER, "time")


def pieces_of(messages: DataFrame) -> DataFrame:
    """The distinct (host, arrival, ``entry_from``) of the samples, without their data."""
    return _samples(messages).select(F.col("hostname").alias("host"), *ORDER, "entry_from").distinct()


def clients_of(messages: DataFrame) -> DataFrame:
    """The distinct (client_nid, arrival) of the samples, by piece where they are in pieces; reads that field of the data only."""
    clients = F.array_distinct(F.col("data.client_nid"))
    place = [*ORDER, *[c for c in ("entry_from",) if c in messages.columns]]
    return (
        _samples(messages)
        .select(*place, F.explode(clients).alias("client_nid"))
        .where("client_nid is not null")
    )


def explode_entries(messages: DataFrame, *along: str) -> DataFrame:
    """One row per data entry with its index; ``stats`` becomes ``map<string,bigint>``.

    ``along`` names columns of the message to repeat on its entries. Entries that have
    their index with them, as ``at``, keep it.
    """
    numbered = "at" in messages.schema["data"].dataType.elementType.names
    begin = F.col("entry_from") if "entry_from" in messages.columns else F.lit(0)
    return (
        _samples(messages)
        .select(
            F.col("hostname").alias("host"), *ORDER, "time", "obdclass", *along, begin.alias("__from"),
            F.posexplode("data").alias("__at", "__e"),
        )
        .select(
            "host", *ORDER, "time", "obdclass", *along,
            (F.col("__e.at") if numbered else F.col("__from") + F.col("__at")).alias("entry_idx"),
            "__e.stats_type", "__e.target", "__e.client_nid",
            F.transform_values(unique_keys(F.col("__e.stats")), lambda _, v: counter(v)).alias("stats"),
        )
    )


def flatten_raw(messages: DataFrame) -> DataFrame:
    """Raw table rows: message tags x entry x event, cumulative values, UTC time."""
    return (
        classify_messages(messages)
        .where("kind = 'sample'")
        .select(
            F.timestamp_seconds("time").alias("time"),
            "hostname", "obdclass", "nid", "jid", "uid",
            F.explode("data").alias("__e"),
        )
        .select(
            "time", "hostname", "obdclass", "nid", "jid", "uid",
            "__e.target", "__e.client_nid", "__e.server_nid", "__e.stats_type",
            F.explode(unique_keys(F.col("__e.stats"))).alias("event_name", "__v"),
        )
        .withColumn("value", F.col("__v").try_cast("double"))
        .drop("__v")
    )


def migrate_raw(raw: DataFrame, derive_fid: bool = False) -> DataFrame:
    """Raw table rows in the compact layout; ``fid`` is null unless derived from the target."""
    from iolens.functions.names import fs_name

    fid = fs_name("target") if derive_fid else F.lit(None).cast("string")
    return raw.select(
        "time", "hostname", fid.alias("fid"), "jid", "uid",
        F.col("client_nid").alias("client"), "event_name", "value",
    )
