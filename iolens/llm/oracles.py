"""The queries as DuckDB SQL, where SQL can say them."""

ORACLES: dict[str, str] = {}

#: Lower-cased words of a text; they hold neither a space nor an ASCII sign.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_decontamination"] = f"""
with items as (
    select item_id, {_WORDS} as w from benchmark where item_id is not null and text is not null
), windows as (
    select distinct item_id, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as run
    from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from items where len(w) > 0)
), docs as (
    select row_number() over () as r, doc_id, {_WORDS} as w from documents
), found as (
    select d.r, d.i, s.size, x.item_id
    from (select r, w, unnest(range(1, len(w) + 1)) as i from docs) d
    cross join (select distinct size from windows) s
    join windows x on x.size = s.size and x.run = array_to_string(d.w[d.i : d.i + s.size - 1], ' ')
    where d.i + s.size - 1 <= len(d.w)
), hit as (
    select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from found) group by r
), named as (
    select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct r, cast(item_id as varchar) as id from found) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""


def _cutoffs() -> str:
    from iolens.llm.quality_rules import RULES

    return ", ".join(f"('{r.name}', {r.cutoffs}, {r.low!r}, {r.step!r})" for r in RULES)


_BLANK = r"[ \t\n\x0B\f\r]"
_NO_BLANK = r"[^ \t\n\x0B\f\r]+"


def quality_sql(source: str = "documents", columns: str = "") -> str:
    """Rows of ``source`` with the counts, ``base_failed`` and ``kept``; a chain of ``with`` parts."""
    from iolens.llm.quality_rules import ERROR, MOSTLY_BAD, RISK, RULES, STRATA

    level = ERROR / (len(RULES) * (len(STRATA) + 1))
    share = RISK / len(RULES)
    strata = ", ".join(f"'{s}'" for s in STRATA)
    measured = ", ".join(
        f"cast(least({r.cutoffs}, greatest(0, ceil((({r.measure}) - ({r.low!r}::double)) / {r.step!r}::double))) as int) "
        f"as bin_{r.name}"
        for r in RULES
    )
    bins = " union all ".join(
        f"select r, doc_id, stratum, base_failed, '{r.name}' as rule, bin_{r.name} as bin from q_rules" for r in RULES
    )
    passed = " and ".join(
        f"not exists (select 1 from q_cut c where c.stratum = q_rules.stratum and c.rule = '{r.name}' "
        f"and q_rules.bin_{r.name} > c.cutoff)"
        for r in RULES
    )
    return f"""
q_words as (
    select *, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '{_NO_BLANK}') as w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{_NO_BLANK}')) as l
    from {source}
), q_window as (
    select r, i, array_to_string(w[i : i + 7], ' ') as run
    from (select r, w, unnest(range(1, len(w) - 6)) as i from q_words where len(w) >= 8)
), q_repeat as (
    select r, count(distinct p) as n_repeat_words
    from (select r, unnest(range(i, i + 8)) as p
          from (select r, i, count(*) over (partition by r, run) as n from q_window) where n > 1)
    group by r
), q_counts as (
    select q_words.*, cast(len(w) as bigint) as n_words,
           cast(length(array_to_string(w, '')) as bigint) as word_chars,
           cast(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
           cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
           coalesce(n_repeat_words, 0) as n_repeat_words,
           cast(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as bigint) as n_stutter
    from q_words left join q_repeat using (r)
), q_rules as (
    select *, case when lang in ({strata}) then lang else 'other' end as stratum,
           n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {measured}
    from q_counts
), q_labels as (
    select doc_id, max(quality) as quality from labels where doc_id is not null group by doc_id
    having max(quality) is not null
), q_bins as (
    select stratum, rule, bin, quality = 1 as good,
           ('0x' || substr(md5(cast(doc_id as varchar)), 1, 4))::int % 3 <> 0 as holdout
    from ({bins}) join q_labels using (doc_id) where not base_failed
), q_sums as (
    select stratum, b.rule, g.cutoff,
           count(*) filter (good and holdout) as n,
           count(*) filter (good and holdout and bin > g.cutoff) as k,
           count(*) filter (good and not holdout and bin > g.cutoff) as fit_good,
           count(*) filter (not good and not holdout and bin > g.cutoff) as fit_bad
    from q_bins b
    join (select rule, unnest(range(cutoffs + 1)) as cutoff
          from (values {_cutoffs()}) t(rule, cutoffs, low, step)) g on g.rule = b.rule
    group by all
), q_tested as (
    select *, max(p) over (partition by stratum, rule order by cutoff desc) <= {level!r} as certified
    from (select *, case when k >= n * {share!r} then 1 else
              list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                  + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) end as p
          from q_sums)
), q_cut as (
    select stratum, rule, arg_max(cutoff, fit_bad * 1000 + cutoff) as cutoff from q_tested
    where certified and fit_bad > 0 and fit_bad >= {MOSTLY_BAD!r} * (fit_bad + fit_good) group by all
), q_judged as (
    select *, not base_failed and {passed} as kept from q_rules
)"""


ORACLES["op7_quality_rules"] = f"""
with {quality_sql()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from q_judged
"""


def _site_lines() -> str:
    from iolens.llm.site_lines import BREAKS, CERTAINTY, HIDDEN, RATIO, TAGS

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    flat = "regexp_replace(coalesce(html, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"
    plain = f"regexp_replace({flat}, {quoted(HIDDEN)}, ' ', 'g')"
    plain = f"regexp_replace({plain}, {quoted(BREAKS)}, chr(10), 'g')"
    plain = f"regexp_replace({plain}, {quoted(TAGS)}, '', 'g')"
    return f"""
with listed as (
    select row_number() over () as r, page_id,
           nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') as host,
           list_filter(list_transform(string_split({plain}, chr(10)),
                       lambda s: trim(regexp_replace(s, ' +', ' ', 'g'))), lambda s: s <> '') as lines
    from pages
), totals as (
    select host, count(*) as pages from listed where host is not null group by host
), common as (
    select host, line from (select host, unnest(list_distinct(lines)) as line from listed)
    join totals using (host) group by host, line, pages 
    having count(*) > {RATIO} * pages
       and (count(*) - {RATIO} * pages) * (count(*) - {RATIO} * pages) > {CERTAINTY**2 * RATIO * (1 - RATIO)!r}::double * pages
), numbered as (
    select r, host, generate_subscripts(lines, 1) as i, unnest(lines) as line from listed
), kept as (
    select r, count(*) as n_kept, string_agg(line, chr(10) order by i) as text
    from numbered n where not exists (select 1 from common c where c.host = n.host and c.line = n.line) group by r
)
select page_id, host, coalesce(n_kept, 0) as n_kept, len(lines) - coalesce(n_kept, 0) as n_dropped,
       coalesce(text, '') as text
from listed left join kept using (r)
"""


ORACLES["op8_site_lines"] = _site_lines()

def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, a bit at a time, lowest bit of each byte first."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda s: list_transform(range(8), lambda j: (ascii(s) >> j) & 1)))"
    step = "lambda c, b: xor(c >> 1, case when (xor(c, b) & 1) = 1 then 3988292384 else 0 end)"
    return f"xor(list_reduce(list_prepend(4294967295, cast({bits} as bigint[])), {step}), 4294967295)"


def _row_hash(*fields: str) -> str:
    parts = ", ".join(f"coalesce(strlen(cast({f} as varchar)) || ':' || cast({f} as varchar), '-')" for f in fields)
    return f"sha256(concat({parts}))"


ORACLES["op12_merkle_manifest"] = f"""
with recursive leaves as (
    select row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n,
           doc_id, lang, leaf, case when {_crc32("cast(doc_id as varchar)")} % 7 = 0 then changed else leaf end as changed
    from (select *, {_row_hash("doc_id", "source", "lang", "n_chars", "text")} as leaf,
                 {_row_hash("doc_id", "source", "lang", "n_chars + 1", "text")} as changed from documents)
), tree as (
    select lang, 0 as level, i, n, leaf as hash from leaves
    union all
    select lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' order by i)) from tree where n > 1
    group by lang, level, n, i // 2
), subroots as (
    select lang, hash, level as height, row_number() over (order by lang nulls first) - 1 as t, count(*) over () as n
    from tree where n = 1
), upper as (
    select 0 as level, t as i, n, hash from subroots
    union all
    select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' order by i)) from upper where n > 1 group by level, n, i // 2
), climb as (
    select l.lang, l.i as leaf_i, l.doc_id, l.leaf, s.hash as subroot, s.t, s.height, 0 as level, l.i, l.changed as up, '' as proof
    from leaves l join subroots s on s.lang is not distinct from l.lang
    union all
    select c.lang, c.leaf_i, c.doc_id, c.leaf, c.subroot, c.t, c.height, c.level + 1, c.i // 2,
           case when o.hash is null then sha256(c.up) when c.i % 2 = 1 then sha256(o.hash || c.up) else sha256(c.up || o.hash) end,
           c.proof || coalesce(o.hash, '')
    from climb c left join tree o on o.lang is not distinct from c.lang and o.level = c.level and o.i = xor(c.i, 1)
    where c.level < c.height
), top as (
    select lang, leaf_i, doc_id, leaf, subroot, 0 as level, t as i, up, proof from climb where level = height
    union all
    select c.lang, c.leaf_i, c.doc_id, c.leaf, c.subroot, c.level + 1, c.i // 2,
           case when o.hash is null then sha256(c.up) when c.i % 2 = 1 then sha256(o.hash || c.up) else sha256(c.up || o.hash) end,
           c.proof || coalesce(o.hash, '')
    from top c left join upper o on o.level = c.level and o.i = xor(c.i, 1)
    where c.level < (select max(level) from upper)
)
select doc_id, leaf, subroot, hash as root, sha256(proof) as proof_sha256, up as folded_root, up = hash as verified
from top, (select level as last, hash from upper where n = 1) where level = last
"""

#: Mixing solves for its rates by iteration and the last stage tokenizes; SQL can say neither.
PIPELINE_SQL = None
