"""Schemas, sentinels and grouping levels shared by all operators."""

UNKNOWN = "*"  # tag never learnt
IDLE = "-"  # host known to run no job

# One report is a JSON object, or an array of them. Counters stay text so that
# 64-bit values survive parsing; they are cast where they are used.
MESSAGE_SCHEMA = (
    "array<struct<hostname string, time double, obdclass string, nid string, "
    "system string, jid string, uid string, data array<struct<stats_type string, "
    "target string, client_nid string, server_nid string, stats map<string,string>>>>>"
)

# Arrival order of a message: position of its report in the feed, then its
# position inside the report when that is an array.
ORDER = ("arrival_seq", "msg_idx")

TAGS = ("system", "fid", "jid", "uid")
SERVER_CLASSES = ("mds", "oss")

# Grouping levels of the ranked view; the server is always part of the group.
LEVELS = {
    "f": ("system", "fid"),
    "u": ("system", "fid", "uid"),
    "j": ("system", "fid", "jid", "uid"),
    "c": ("system", "fid", "client", "jid", "uid"),
    "s": ("system",),
    "n": (),
}

DERIVED = ("nclients", "load", "load_eff", "iops", "bytes")

HISTORY_COLUMNS = ("time", "host", "system", "fid", "jid", "uid", "client", "event", "value")
