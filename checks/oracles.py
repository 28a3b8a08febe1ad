"""DuckDB statements that give the same rows as the queries."""

from __future__ import annotations

from checks import tables as T
from iolens.schema import LEVELS

ORACLES: dict[str, str] = {}


def _with(*parts: str, select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select


# --- counters: rates, groups, derived events ---------------------------------

COUNTERS = f"""
counters as ({T.duck(T.COUNTERS)}),
long as ({T.duck(T.COUNTER_EVENTS)}),
cpu as ({T.duck(T.CPU)}),
times as (
  select host, time, lag(time) over (partition by host order by time) as prev
  from (select host, time from long union select host, time from cpu)),
entry as (
  select *, row_number() over (partition by host, time order by client_nid, target) as idx
  from (select distinct host, time, stats_type, client_nid, target, client, system, jid, uid, fid from long)),
matched as (
  select n.*, t.prev from entry n join times t using (host, time)
  join entry o on o.host = n.host and o.time = t.prev and o.client_nid = n.client_nid and o.target = n.target),
rated as (
  select m.*, l.ev as event,
         cast(greatest(coalesce(l.val - o.val, 0), 0) as double) * (1.0 / (m.time - m.prev)) as value
  from matched m
  join long l on l.host = m.host and l.time = m.time and l.client_nid = m.client_nid and l.target = m.target
  left join long o on o.host = m.host and o.time = m.prev and o.client_nid = m.client_nid
                  and o.target = m.target and o.ev = l.ev),
cpu_rated as (
  select n.host, n.time, cast(greatest(n.val - o.val, 0) as double) * (1.0 / (n.time - t.prev)) as rate
  from cpu n join times t using (host, time) join cpu o on o.host = n.host and o.time = t.prev),
base as (
  select host as server, cast(time as bigint) as time, system, fid, client, jid, uid, event, value from rated
  union all
  select host, cast(time as bigint), system, fid, client, jid, uid, 'nclients',
         case when row_number() over (partition by host, time, client_nid order by idx) = 1 then 1.0 else 0.0 end
  from matched),
loads as (select host as server, cast(time as bigint) as time, rate from cpu_rated)"""


def _tags(tags) -> str:
    return "".join(f"{t}, " for t in tags)


def _groups(tags, load=True, name="g", where="true") -> str:
    keys = f"server, time, {_tags(tags)}"
    rows = f"select {keys} event, sum(value) as value from base where {where} group by all"
    if load:
        rows += (
            f" union all select distinct {keys} 'load', rate from base join loads using (server, time)"
            f" where {where}"
        )
    return f"{name} as ({rows})"


_UNCOUNTED = (
    "(contains(event, '[usec') or event in ('read_bytes', 'write_bytes', 'nclients', 'bytes', 'iops'))"
)


def _derived(tags, name="d", source="g") -> str:
    keys = f"server, time, {_tags(tags)}"
    share = lambda c: (
        f"case when sum({c}) over w > 0 then {c} * (1.0 / sum({c}) over w) else 0.0 end"
    )
    counted = (
        "(case when sum(iops) over w > 0 then 1 else 0 end + case when sum(bytes) over w > 0 then 1 else 0 end)"
    )
    return f"""{name} as (
  select *, case when {counted} > 0 then load * ({share('iops')} + {share('bytes')}) / {counted} end as load_eff
  from (select {keys} sum(case when event = 'nclients' then value else 0 end) as nclients,
               coalesce(max(case when event = 'load' then value end), 0.0) * 0.01 as load,
               sum(case when not {_UNCOUNTED} and not contains(event, '[bytes') and event <> 'load' then value else 0 end) as iops,
               sum(case when not {_UNCOUNTED} and contains(event, '[bytes') then value else 0 end) * (1.0 / 1048576) as bytes
        from {source} group by all)
  window w as (partition by server, time))"""


_DERIVED = ", ".join(f"round({c}, 6) as {c}" for c in ("nclients", "load", "load_eff", "iops", "bytes"))
J = LEVELS["j"]


def _top(tags, where="true", order="", source="d") -> str:
    return _with(
        COUNTERS, _groups(tags, where=where), _derived(tags),
        select=f"select server, time, {_tags(tags)} {_DERIVED} from {source} {order}",
    )


def _group_rows(tags, where="true", load=True) -> str:
    return _with(
        COUNTERS, _groups(tags, load, where=where),
        select=f"select server, time, {_tags(tags)} event, round(value, 6) as value from g",
    )


LATE = f"late as ({T.duck(T.LATE_SAMPLES)})"
ORACLES["accept_samples"] = _with(LATE, select="""
select host, arrival_seq, time, prev_time from (
  select *, max(time) over (partition by host order by arrival_seq
                            rows between unbounded preceding and 1 preceding) as prev_time from late)
where prev_time is null or time > prev_time""")
ORACLES["coalesce_ticks"] = _with(LATE, select="""
select host, max(arrival_seq) as arrival_seq, arg_max(time, arrival_seq) as time
from late group by host, floor(time / 3600.0)""")
ORACLES["rates"] = _with(COUNTERS, select="""
select host as server, cast(time as bigint) as time, stats_type, client_nid, target, event, value as rate from rated
union all select host, cast(time as bigint), 'cpu', null, null, 'system', rate from cpu_rated
union all select host, cast(time as bigint), 'cpu', null, null, 'user', rate * 2 from cpu_rated""")
ORACLES["aggregate_by_tags"] = _group_rows(J, load=False)
ORACLES["nclients"] = _with(COUNTERS, _groups(J), select=f"""
select server, time, {_tags(J)} value as nclients from g where event = 'nclients'""")
ORACLES["attach_load"] = _with(COUNTERS, _groups(J), select=f"""
select server, time, {_tags(J)} value as load from g where event = 'load'""")
ORACLES["aggregate_with_load"] = _group_rows(J)
ORACLES["host_snapshot"] = _with(COUNTERS, _groups(J), select=f"""
select server, time, {_tags(J)} event, round(value, 6) as value from g
where (server, time) in (select server, max(time) from g group by server)""")
for _name, _level in LEVELS.items():
    ORACLES[f"group_{_name}"] = _group_rows(_level)


def _levels() -> str:
    parts, selects = [COUNTERS], []
    for name, tags in LEVELS.items():
        parts.append(_groups(tags, name=f"g_{name}"))
        columns = ", ".join(t if t in tags else f"null as {t}" for t in LEVELS["c"])
        selects.append(
            f"select '{name}' as level, server, time, {columns}, event, round(value, 6) as value from g_{name}"
        )
    return _with(*parts, select=" union all ".join(selects))


ORACLES["group_levels"] = _levels()
ORACLES["filter_user"] = _top(J, "uid = 'u3'")
ORACLES["filter_job"] = _top(J, "jid = 'j4'")
ORACLES["filter_server"] = _top(J, "server = 'oss1'")
ORACLES["filter_client"] = _top(LEVELS["c"], "client = 'c5'")
ORACLES["filter_compat"] = _top(LEVELS["f"])
ORACLES["own_rows"] = _group_rows(J, "uid = 'u2'")
ORACLES["derive_events"] = _with(COUNTERS, _groups(J), select=f"""
select server, time, {_tags(J)} event,
       round(case when contains(event, '[bytes') then value * (1.0 / 1048576) else value end, 6) as value
from g where event not in ('nclients', 'load')""")
ORACLES["load_eff"] = _with(
    COUNTERS, _groups(LEVELS["u"]), _derived(LEVELS["u"]),
    select="select server, time, system, fid, uid, round(load_eff, 6) as load_eff from d",
)
ORACLES["top_summary"] = _top(J)
_SHOWN = {"click": "click", "error": "error", "purchase": "purchase", "signup": "signup", "view": "view"}
ORACLES["top_detailed"] = _with(COUNTERS, _groups(()), _derived(()), select=f"""
select d.server, d.time, {_DERIVED.replace('round(', 'round(d.')}, {', '.join(
    f"max(case when g.event = '{e}' and g.value >= 2 then g.value else 0.0 end) as {a}" for e, a in _SHOWN.items())},
  round(max(case when g.event = 'read_bytes_[bytes]' and g.value * (1.0 / 1048576) >= 2 then g.value * (1.0 / 1048576) else 0.0 end), 6) as read_mb,
  round(max(case when g.event = 'write_bytes_[bytes]' and g.value * (1.0 / 1048576) >= 2 then g.value * (1.0 / 1048576) else 0.0 end), 6) as write_mb
from d join g using (server, time)
group by d.server, d.time, d.nclients, d.load, d.load_eff, d.iops, d.bytes""")
ORACLES["rank_load_eff"] = _top(LEVELS["s"], order="order by load_eff desc nulls last")
ORACLES["page"] = _with(COUNTERS, _groups(()), _derived(()), select=f"""
select * from (select server, time, {_DERIVED}, (select count(*) from d) as total from d
               order by d.bytes desc nulls last, server, time limit 20 offset 20)""")
ORACLES["totals_all"] = _with(COUNTERS, _groups(J), _derived(J), select=f"""
select server, time, {_tags(J)} {_DERIVED} from d where uid = 'u3'""")
ORACLES["to_history"] = _with(COUNTERS, _groups(J), _derived(J), select=f"""
select time, server as host, system, fid, jid, uid, '*' as client, event, round(value, 6) as value from (
  select time, server, {_tags(J)} event,
         case when contains(event, '[bytes') then value * (1.0 / 1048576) else value end as value
  from g where event not in ('nclients', 'load')
  union all select time, server, {_tags(J)} unnest(['nclients', 'load', 'load_eff', 'iops', 'bytes']),
                   unnest([nclients, load, load_eff, iops, bytes]) from d)
where value > 0""")

# --- history -------------------------------------------------------------------

H = f"h as ({T.duck(T.HISTORY)})"
R = f"h as ({T.duck(T.RECENT)})"
_RANGE = "time > timestamp '2024-01-05 06:30:00' and time <= timestamp '2024-01-08 18:00:00'"


def _h(select: str) -> str:
    return _with(H, select=select)


def _r(select: str) -> str:
    return _with(R, select=select)


def _bucket(width: str, keys: str, event: str) -> str:
    return (
        f"select time_bucket(interval '{width}', time) as t, {keys}, sum(value) as value from h"
        f" where event = '{event}' group by all"
    )


def _filled(width: str, keys: str, value: str, where: str = "true") -> str:
    return f"""
b as (select time_bucket(interval '{width}', time) as t, {keys}, {value} as value
      from h where {_RANGE} and {where} group by all),
f as (select s.t, {keys}, coalesce(b.value, 0.0) as value
      from (select k.*, unnest(generate_series(time_bucket(interval '{width}', timestamp '2024-01-05 06:30:00'),
                                               timestamp '2024-01-08 18:00:00', interval '{width}')) as t
            from (select distinct {keys} from b) k) s left join b using (t, {keys}))"""


ORACLES["recent_rows"] = _h("""
select * from (select * from h order by time desc, host, system, fid, jid, uid, client, event, value limit 10)""")
ORACLES["in_range"] = _r(f"select * from h where {_RANGE}")
ORACLES["last_interval"] = _r("""
select * from h where time > timestamp '2024-01-07 18:00:00' and time <= timestamp '2024-01-08 18:00:00'""")
ORACLES["bucket_sum_by_tag"] = _h(
    f"select * replace (round(value, 6) as value) from ({_bucket('1 day', 'host, system, uid', 'iops')})")
ORACLES["bucket_sum_by_tag_host"] = _r(f"""
select * replace (round(value, 6) as value) from ({_bucket('30 minutes', 'host, system, jid', 'load_eff')})
where host = 'srv3.cluster'""")
ORACLES["gapfill_avg"] = _with(
    R, _filled("1 hour", "host, system, uid, jid, event", "avg(value)"),
    select="select * replace (round(value, 6) as value) from f")
ORACLES["gapfill_last"] = _with(
    R, _filled("30 minutes", "host, system, event", "arg_max(value, struct_pack(t := time, v := value))"), select="select * from f")
ORACLES["distinct_dims"] = _h("""
select distinct 'system' as dim, system as value from h union all select distinct 'host', host from h
union all select distinct 'event', event from h""")
_UID = f"s as ({_bucket('1 day', 'host, system, uid', 'bytes')})"
ORACLES["focus_tag"] = _with(H, _UID, select="""
select t, host, system, case when uid = 'u7' then uid else '*' end as uid, round(sum(value), 6) as value
from s group by all""")
ORACLES["pivot_series"] = _with(H, f"s as ({_bucket('1 day', 'host, system, fid', 'bytes')})", select="""
select t, host, system, sum(value) filter (fid = 'fsF') as "fsF", sum(value) filter (fid = 'fsO') as "fsO"
from s group by all""")
ORACLES["axis_limit"] = _with(H, _UID, select="""
select system, host, round(max(value) * 1.1, 6) as "limit" from s group by all""")
ORACLES["axis_limit_stacked"] = _with(H, _UID, select="""
select system, host, round(max(value) * 1.1, 6) as "limit"
from (select t, system, host, sum(value) as value from s group by all) group by all""")
ORACLES["latest_active_share"] = _h("""
select jid, host, system, time, round(value, 6) as value, round(total, 6) as total,
       round(value / total, 6) as share, round(value / total * 2 * pi(), 6) as angle
from (select *, sum(value) over (partition by host, time) as total from h
      where event = 'load_eff' and (host, time) in (
        select host, max(time) from h where event = 'nclients' and value > 0 group by host))""")
ORACLES["bucket_sum_by_host"] = _h(f"select * from ({_bucket('1 day', 'host', 'open')})")
ORACLES["colour_range"] = _h(
    f"select min(value) as low, max(value) as high from ({_bucket('1 day', 'host', 'open')})")
ORACLES["bucket_width"] = _with(H, _UID, select="""
select case when count(*) = 2 then date_diff('second', min(t), max(t)) end as seconds
from (select distinct t from s order by t limit 2)""")
ORACLES["job_extent"] = _h("""
select min(time) as first_time, max(time) as last_time from h where jid = 'j77'""")
ORACLES["job_detail"] = _r("""
select time_bucket(interval '30 minutes', time) as t, host, system,
       case when jid = 'j7' then jid else '*' end as jid, round(sum(value), 6) as value
from h where event = 'nclients' and time >= (select min(time) from h where jid = 'j7')
  and time <= (select max(time) from h where jid = 'j7') group by all""")
ORACLES["with_units"] = _h("""
select event, case event when 'load_eff' then '#cores' when 'bytes' then 'MB/s' when 'nclients' then '#'
              else '#/s' end as unit, count(*) as n from h group by all""")
ORACLES["raw_lookup"] = _h("""
select * from h where time > timestamp '1998-12-04' and host = 'srv0.cluster' and event in ('open', 'bytes')""")
ORACLES["host_prefix"] = _h("select host, count(*) as n from h where host like 'srv1%' group by host")
ORACLES["host_total_overlay"] = _with(H, _UID, select="""
select t, host, system, uid, round(value, 6) as value,
       round(sum(value) over (partition by t, host), 6) as total from s""")
ORACLES["host_rate_series"] = _with(
    R, _filled("1 hour", "host, system, uid, jid, event", "arg_max(value, struct_pack(t := time, v := value))", "event = 'load_eff'"),
    select="select t, host, round(sum(value), 6) as value from f group by all")
ORACLES["local_time"] = _r("""
select time at time zone 'UTC' at time zone 'America/Chicago' as local, host, event, value from h""")
ORACLES["short_host"] = _h("select split_part(host, '.', 1) as name, count(*) as n from h group by all")

# --- messages and tags -----------------------------------------------------------

M = f"m as ({T.duck(T.MESSAGES)})"
_RAW = """select cast(time as bigint) as time, hostname, obdclass, nid, jid, uid, target, client_nid,
       cast(null as varchar) as server_nid, 'oss' as stats_type, ev as event_name, cast(val as double) as value
from m where kind = 'sample'"""
STATE = """
state as (select hostname, arg_max(time, arrival_seq) filter (time is not null) as time,
                 arg_max(system, arrival_seq) filter (system is not null) as system,
                 coalesce(arg_max(jid, arrival_seq) filter (jid is not null), '*') as jid,
                 coalesce(arg_max(uid, arrival_seq) filter (uid is not null), '*') as uid,
                 arg_max(obdclass, arrival_seq) filter (obdclass is not null) as obdclass
          from m group by hostname),
nodes as (select nid, arg_max(hostname, arrival_seq) as hostname from m where kind = 'node' group by nid),
node_map as (select nid, hostname as client, system, jid, uid from nodes join state using (hostname))"""
ORACLES["migrate_raw"] = _with(M, select=f"""
select time, hostname, cast(null as varchar) as fid, jid, uid, client_nid as client, event_name, value from ({_RAW})""")
ORACLES["flatten_raw"] = _with(M, select=_RAW)
_SPOILT = """spoilt as (
  select *, case when arrival_seq % 17 = 3 then 'not a report' when arrival_seq % 19 = 5 then 'bad json'
                 when arrival_seq % 23 = 7 then 'no hostname' when arrival_seq % 29 = 4 then 'mixed'
                 when kind <> 'sample' or arrival_seq % 31 = 6 then 'plain'
                 when arrival_seq % 37 = 8 then 'bad data' when arrival_seq % 41 = 9 then 'no time'
                 when arrival_seq % 43 = 10 then 'bad time' else 'plain' end as how,
         arrival_seq % 5 = 2 and not (kind = 'sample' and arrival_seq % 31 = 6) as twice from m)"""
ORACLES["parse_reports"] = _with(M, _SPOILT, select="""
select arrival_seq,
       cast(unnest(case when how = 'mixed' then [1] when twice then [0, 1] else [0] end) as int) as msg_idx,
       hostname, time, nid, system, jid, uid, case when kind = 'sample' then 1 end as entries, null as reason
from spoilt where how in ('plain', 'mixed')
union all
select arrival_seq, null, null, null, null, null, null, null, null, unnest(
         case when how = 'mixed' then ['not a report', 'not a report', 'not a report'] else [how] end)
from spoilt where how <> 'plain'""")
ORACLES["classify_messages"] = _with(M, select="select arrival_seq, hostname, kind from m")
ORACLES["explode_entries"] = _with(M, select="""
select hostname as host, arrival_seq, time, 0 as entry_idx, client_nid, target, ev as event, val as value
from m where kind = 'sample'""")
ORACLES["host_state"] = _with(M, STATE, select="select * from state")
ORACLES["host_state_history"] = _with(M, select="""
select hostname, arrival_seq, last_value(system ignore nulls) over w as system,
       coalesce(last_value(jid ignore nulls) over w, '*') as jid, coalesce(last_value(uid ignore nulls) over w, '*') as uid
from m window w as (partition by hostname order by arrival_seq rows between unbounded preceding and current row)""")
ORACLES["node_map"] = _with(M, STATE, select="select * from node_map")
ORACLES["tag_entries_latest"] = _with(M, STATE, select="""
select arrival_seq, client_nid, coalesce(n.client, client_nid) as client, coalesce(n.system, '*') as system,
       coalesce(n.jid, '*') as jid, coalesce(n.uid, '*') as uid, split_part(target, '-', 1) as fid
from m left join node_map n on n.nid = m.client_nid where kind = 'sample'""")
ORACLES["tag_entries_asof"] = _with(
    M,
    """named as (select s.arrival_seq, s.client_nid, s.target, n.hostname as client
                 from (select * from m where kind = 'sample') s
                 asof left join (select * from m where kind = 'node') n
                 on s.client_nid = n.nid and s.arrival_seq >= n.arrival_seq)""",
    *[
        f"""with_{c} as (select p.*, u.{c} from {prev} p asof left join (select * from m where {c} is not null) u
                         on p.client = u.hostname and p.arrival_seq >= u.arrival_seq)"""
        for c, prev in (("system", "named"), ("jid", "with_system"), ("uid", "with_jid"))
    ],
    select="""
select arrival_seq, client_nid, coalesce(client, client_nid) as client, coalesce(system, '*') as system,
       coalesce(jid, '*') as jid, coalesce(uid, '*') as uid, split_part(target, '-', 1) as fid from with_uid""")
ORACLES["tag_entries_asof_sparse"] = ORACLES["tag_entries_asof"]
ORACLES["fs_name"] = _with(M, select="""
select left(target, length(target) - 8) as fid, count(*) as n from m where kind = 'sample' group by all""")

# --- text, mapping tables, host lists ------------------------------------------------

_PATTERN = r"^([^ :\t]+)[ :\t]+(\d+)(?: samples (\S+)(?: \d+ \d+ (\d+))?)?"
STATS = f"""
lines as ({T.duck(T.STATS_LINES)}),
p as (select host, time, line_no, regexp_extract(line, '{_PATTERN}', 1) as k,
             try_cast(regexp_extract(line, '{_PATTERN}', 2) as bigint) as n,
             regexp_extract(line, '{_PATTERN}', 3) as unit,
             try_cast(regexp_extract(line, '{_PATTERN}', 4) as bigint) as total
      from lines),
stats as (select host, time, line_no, k as key, n as value from p where k not in ('', 'snapshot_time')
          union all select host, time, line_no, concat(k, '_', unit), total from p where total is not null)"""
ORACLES["parse_stats_text"] = _with(STATS, select="select host, line_no, key, value from stats")
ORACLES["stats_maps"] = _with(STATS, select="""
select host, time, key, arg_max(value, line_no) as value from stats group by all""")
ORACLES["parse_cpu_text"] = f"""
select host, time, coalesce(arg_min(l_partkey, line_no) filter (l_linenumber % 3 = 1), 0) as "user",
       case when count(*) filter (l_linenumber % 3 = 1) > 0 then 7 else 0 end as nice,
       coalesce(arg_min(l_suppkey, line_no) filter (l_linenumber % 3 = 1), 0) as system,
       case when count(*) filter (l_linenumber % 3 = 1) > 0 then 900 else 0 end as idle,
       case when count(*) filter (l_linenumber % 3 = 1) > 0 then 11 else 0 end as iowait,
       case when count(*) filter (l_linenumber % 3 = 1) > 0 then 2 else 0 end as irq, 0 as softirq
from (select *, concat('h', l_orderkey % 4) as host, cast(l_orderkey as double) as time,
             ((l_partkey * 8 + l_linenumber) * 10000 + l_suppkey) * 64 + cast(l_quantity as bigint) as line_no from lineitem)
group by all"""
ORACLES["load_node_map"] = """
select c_custkey as line_no, concat('c', c_custkey, '.sys', c_nationkey, '.org') as hostname,
       concat('10.2.0.', c_custkey) as nid, concat('sys', c_nationkey) as system
from customer where c_custkey % 10 not in (4, 5)"""
ORACLES["load_job_table"] = """
with runs as (
  select 1 as priority, o_orderkey as line_no, cast(o_orderkey as varchar) as jid,
         concat('u', o_custkey % 40) as uid, unnest(range(o_custkey, o_custkey + o_orderkey % 5 + 1)) as n
  from orders where o_orderkey % 50 <> 3
  union all select 0, c_custkey, '-', '-', unnest(range(c_custkey, c_custkey + 2)) from customer)
select concat('h', n) as hostname, arg_max(jid, priority * 1000000000 + line_no) as jid,
       arg_max(uid, priority * 1000000000 + line_no) as uid
from runs group by n"""
ORACLES["expand_hosts"] = """
with good as (select * from part where p_partkey % 20 <> 7)
select distinct job, host, null as error from (
  select p_partkey as job, concat('n', lpad(cast(unnest(range(p_size, p_size + p_partkey % 5 + 1)) as varchar), 3, '0')) as host from good
  union all select p_partkey, concat('d', p_size % 7) from good
  union all select p_partkey, concat('r', r, 'x', x)
            from (select p_partkey, p_size, unnest([1, 2]) as r from good) a,
                 lateral (select unnest([p_size, 99, 100, 101]) as x) b)
union all select p_partkey, null, 'start > stop' from part where p_partkey % 20 = 7"""
ORACLES["collapse_hosts"] = """
with h as (select distinct l_orderkey % 500 as job, l_suppkey as n from lineitem),
i as (select *, n - row_number() over (partition by job order by n) as run from h),
r as (select job, run, min(n) as low, max(n) as high from i group by all),
t as (select job, count(*) = 1 and min(low) = max(high) as single,
             string_agg(case when low = high then cast(low as varchar) else concat(low, '-', high) end, ',' order by low) as plain,
             string_agg(case when low = high then lpad(cast(low as varchar), 4, '0')
                             else concat(lpad(cast(low as varchar), 4, '0'), '-', lpad(cast(high as varchar), 4, '0')) end,
                        ',' order by low) as padded
      from r group by job)
select job, case when single then concat('n', plain, ',p', padded, ',r[1-2]x', plain)
                 else concat('n[', plain, '],p[', padded, '],r[1-2]x[', plain, ']') end as hostlist,
       case when job % 50 = 7 then 'forbidden character' end as error
from t"""
ORACLES["natural_sort"] = """
select cast(l_linenumber as varchar) as part, concat('n', l_suppkey, 'x', l_linenumber) as host,
       row_number() over (partition by l_linenumber order by l_suppkey) as place
from (select distinct l_suppkey, l_linenumber from lineitem)"""
ORACLES["expand_tasks_per_node"] = """
with good as (select p_partkey as job, p_size, p_partkey % 4 as r from part where p_partkey % 20 <> 7)
select job, unnest(range(r)) as node_idx, p_size as tasks, null as error from good
union all select job, r, p_size % 7, null from good
union all select job, r + unnest([1, 2]), 8, null from good
union all select p_partkey, null, null, 'bad task list syntax' from part where p_partkey % 20 = 7"""

# --- whole feeds, the stored table, streams -------------------------------------------

# Each report is tagged with the client's job after its report before.
FEED = f"""{COUNTERS},
seen as (select distinct client_nid, cast((time - 1704067200) / 16384 as bigint) as k, client, system, uid from entry),
told as (
  select m.* exclude (client, system, jid, uid), coalesce(s.client, m.client_nid) as client,
         coalesce(s.system, '*') as system, case when s.k is null then '*' else concat('j', s.k % 5) end as jid,
         coalesce(s.uid, '*') as uid
  from (select *, cast((time - 1704067200) / 16384 as bigint) as k from matched) m
  asof left join seen s on m.client_nid = s.client_nid and m.k > s.k),
feed as (
  select t.client, t.system, t.jid, t.uid, t.idx, r.* exclude (client, system, jid, uid, idx)
  from told t join rated r using (host, time, client_nid, target)),
feed_base as (
  select host as server, cast(time as bigint) as time, system, fid, client, jid, uid, event, value from feed
  union all
  select host, cast(time as bigint), system, fid, client, jid, uid, 'nclients',
         case when row_number() over (partition by host, time, client_nid order by idx) = 1 then 1.0 else 0.0 end
  from told)"""


def _feed_groups(tags, where="true"):
    return _groups(tags, where=where).replace("from base", "from feed_base")


_LAST = "(server, time) in (select host, cast(max(time) as bigint) from times group by host)"
ORACLES["reports_to_groups"] = _with(FEED, _feed_groups(J), select=f"""
select server, time, {_tags(J)} event, round(value, 6) as value from g""")
_ARRIVAL = "(time - 1704067200) // 16384 * 8 + cast(right(server, 1) as int)"
ORACLES["reports_to_groups_range"] = _with(FEED, _feed_groups(J), select=f"""
select server, time, {_tags(J)} event, round(value, 6) as value from g where {_ARRIVAL} between 400 and 640""")
_END = "(select (max(time) - 1704067200) // 16384 * 8 + 8 from g)"
ORACLES["reports_to_groups_tenth"] = _with(FEED, _feed_groups(J), select=f"""
select server, time, {_tags(J)} event, round(value, 6) as value from g
where {_ARRIVAL} between {_END} * 6 // 10 and {_END} * 7 // 10 - 1""")
# Only the last sample of each tick of a host counts; node messages stay as they are.
_TICK_SAMPLES = f"""
all_counters as ({T.duck(T.COUNTERS)}),
all_cpu as ({T.duck(T.CPU)}),
counted as (
  select host, max(time) as time from (select host, time from all_counters union select host, time from all_cpu)
  group by host, floor(time / 40000.0)),
counters as (select * from all_counters where (host, time) in (from counted)),
cpu as (select * from all_cpu where (host, time) in (from counted)),"""
_TICKS = FEED.replace(f"counters as ({T.duck(T.COUNTERS)}),", _TICK_SAMPLES, 1).replace(
    f"\ncpu as ({T.duck(T.CPU)}),", "", 1
).replace("client, system, uid from entry)", "client, system, uid from all_counters)")
ORACLES["reports_to_groups_ticks"] = _with(_TICKS, _feed_groups(J), select=f"""
select server, time, {_tags(J)} event, round(value, 6) as value from g""")
ORACLES["current_top"] = _with(
    FEED, _feed_groups(LEVELS["u"], _LAST), _derived(LEVELS["u"]),
    select=f"select server, time, {_tags(LEVELS['u'])} {_DERIVED} from d order by iops desc nulls last",
)
ORACLES["write_history"] = ORACLES["to_history"]
_STORED = f"stored as ({ORACLES['to_history']}), dated as (select *, cast(to_timestamp(time) at time zone 'UTC' as date) as date from stored)"
ORACLES["compact_history"] = _with(_STORED, select="""
select date, date < date '2024-01-12' as compacted, count(*) as n, round(sum(value), 3) as total from dated group by all""")
ORACLES["storage_report"] = _with(_STORED, select="""
select date, count(*) as n, true as sized, min(time) as first_time, max(time) as last_time from dated group by date""")
ORACLES["stream_rates"] = _with(FEED, select="""
select host as server, cast(time as bigint) as time, client_nid, target, client, system, jid, uid, fid, event, value as rate
from feed
union all
select host, cast(time as bigint), null, null, null, null, null, null, null, e, rate * f
from cpu_rated, (values ('system', 1), ('user', 2)) v(e, f)""")
_CUTS = """cuts as (select max(seq) + 1 as span from (
                  select max(arrival_seq) as seq from cpu union all
                  select max(arrival_seq) + 4 from cpu where host = 'oss1' union all
                  select max(arrival_seq) + 20 from cpu where host = 'oss2' union all
                  select max(cast(k * 8 + 4 as bigint)) from seen))"""
_EXPORTED = f"""
select part, time, server as host, system, fid, jid, uid, '*' as client, event, round(value, 6) as value from (
  select time, server, {_tags(J)} event,
         case when contains(event, '[bytes') then value * (1.0 / 1048576) else value end as value
  from g where event not in ('nclients', 'load')
  union all select time, server, {_tags(J)} unnest(['nclients', 'load', 'load_eff', 'iops', 'bytes']),
                   unnest([nclients, load, load_eff, iops, bytes]) from d) join last using (server, time)
where value > 0"""
# Each micro-batch exports the last report of every server in it.
ORACLES["export_stream"] = _with(
    FEED, _CUTS,
    """last as (select cast(floor(arrival_seq * 3 / span) as int) as part, host as server, cast(max(time) as bigint) as time
               from cpu, cuts group by all)""",
    _feed_groups(J, "(server, time) in (select server, time from last)"), _derived(J),
    select=f"select * exclude part from ({_EXPORTED})")
# Each micro-batch exports the last report of every server so far; oss2 is silent in the last.
ORACLES["export_stream_repeat"] = _with(
    FEED, _CUTS,
    """last as (select part, host as server, cast(max(time) as bigint) as time
               from cpu, cuts, (values (0), (1), (2)) parts(part)
               where floor(arrival_seq * 3 / span) <= part and (host <> 'oss2' or floor(arrival_seq * 3 / span) < 2)
               group by all)""",
    _feed_groups(J, "(server, time) in (select server, time from last)"), _derived(J), select=_EXPORTED)
ORACLES["stream_buckets"] = _r("""
select cast(epoch(time_bucket(interval '1 hour', time)) as bigint) as t, host, event, round(sum(value), 6) as value
from h group by all""")
ORACLES["stream_buckets_late"] = ORACLES["stream_buckets"]

# --- the stored table ------------------------------------------------------------------

_STORED_RANGE = "time > epoch(timestamp '2024-01-05 06:30:00') and time <= epoch(timestamp '2024-01-08 18:00:00')"
ORACLES["stored_in_range"] = _with(_STORED, select=f"select * exclude (date) from dated where {_STORED_RANGE}")
ORACLES["stored_gapfill"] = _with(_STORED, f"""
b as (select time // 21600 as n, host, event, sum(value) as value from stored where {_STORED_RANGE} group by all),
k as (select distinct host, event from b)""", select="""
select s.n * 21600 as t, host, event, round(coalesce(b.value, 0.0), 3) as value
from (select *, unnest(range(cast(epoch(timestamp '2024-01-05 06:00:00') as bigint) // 21600,
                             cast(epoch(timestamp '2024-01-08 18:00:00') as bigint) // 21600 + 1)) as n from k) s
left join b using (n, host, event)""")
ORACLES["compaction_report"] = _with(_STORED, select="""
select date, true as before, date < date '2024-01-12' as after from dated group by date""")
ORACLES["stored_raw_lookup"] = ORACLES["packed_raw_lookup"] = _r("""
select * from h where time > timestamp '2024-01-05' and host = 'srv2.cluster' and event in ('nclients', 'load_eff')""")
ORACLES["stored_distinct_dims"] = ORACLES["distinct_dims"].replace(H, R)
ORACLES["stored_active_share"] = ORACLES["latest_active_share"].replace(H, R)
ORACLES["stored_job_extent"] = _r("select min(time) as first_time, max(time) as last_time from h where jid = 'j7'")
ORACLES["stored_recent_rows"] = ORACLES["recent_rows"].replace(H, R)
ORACLES["packed_rows"] = _r("select * replace (round(value, 6) as value) from h")
ORACLES["packed_gapfill"] = ORACLES["gapfill_avg"]
ORACLES["packed_job_detail"] = ORACLES["job_detail"]
ORACLES["total_bytes"] = "select true as sized"
ORACLES["compact_again"] = "select 0 as new_files"

# --- pages -----------------------------------------------------------------------------

ORACLES["overview_shares"] = ORACLES["latest_active_share"]
ORACLES["overview_heat_map"] = _r(
    f"select * replace (round(value, 6) as value) from ({_bucket('1 minute', 'host', 'load_eff')})")
ORACLES["host_page_shares"] = f"select * from ({ORACLES['latest_active_share']}) where host = 'srv2.cluster'"
ORACLES["host_page_series"] = _r(f"""
select * replace (round(value, 6) as value) from ({_bucket('1 minute', 'host, system, jid', 'load_eff')})
where host = 'srv2.cluster'""")
_SHOWN_BY_UNIT = """case when contains(event, '[bytes') then value * (1.0 / 1048576) else value end"""
ORACLES["top_events"] = _with(COUNTERS, _groups(()), _derived(()), select=f"""
select d.server, d.time, {_DERIVED.replace('round(', 'round(d.')}, g.event, round({_SHOWN_BY_UNIT}, 6) as value
from d join g using (server, time)
where {_SHOWN_BY_UNIT} >= 2 and not contains(event, '[usec')
  and event not in ('load', 'load_eff', 'read_bytes', 'write_bytes', 'iops', 'bytes', 'nclients')""")
