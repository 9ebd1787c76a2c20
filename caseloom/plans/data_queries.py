"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.intervals import officer_spells, periods_and_gaps
from caseloom.operators.nested import flatten_bodies
from caseloom.operators.timestamps import _FORMS, _PARTS, ABBREVIATIONS, CANDIDATE_ZONES, MONTHS, estimate_zones, parse_written_time, to_instants, written_records
from caseloom.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    spells = officer_spells(table(spark, d, "appointments"), table(spark, d, "officers"))
    return periods_and_gaps(spells).withColumnRenamed("entity", "officer_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return to_instants(written_records(table(spark, d, "media_item"), table(spark, d, "fetch_record")), table(spark, d, "feed"))


def p6_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone that the evidence alone gives each feed, beside the declared one."""
    feeds = table(spark, d, "feed").select("feed", F.col("zone_name").alias("declared"), "day_first")
    records = written_records(table(spark, d, "media_item"), table(spark, d, "fetch_record")).join(F.broadcast(feeds), "feed", "left")
    zones = estimate_zones(parse_written_time(records, "written", "day_first"))
    named = F.element_at("history", -1)["zone_name"].alias("zone_name")
    return zones.join(F.broadcast(feeds), "feed", "left").select("feed", named, F.size("history").cast("bigint").alias("n_zones"), "declared", "violations", "evidence")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_bodies(table(spark, d, "fetch_record"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _instants_sql() -> str:
    """The forms, months and zones are the operator's; what they mean is worked out by the database."""
    names = "[" + ", ".join(_quoted(p) for p in _PARTS) + "]"
    form = " ".join(f"when regexp_matches(s, {_quoted(p)}) then {_quoted(n)}" for n, p in _FORMS.items())
    parts = " ".join(f"when {_quoted(n)} then regexp_extract(s, {_quoted(p)}, {names})" for n, p in _FORMS.items())
    months = "map {" + ", ".join(f"{_quoted(x)}: {k}" for k, v in MONTHS.items() for x in v.split()) + "}"
    zones = "map {" + ", ".join(f"{_quoted(k)}: {v}" for k, v in ABBREVIATIONS.items()) + "}"
    return f"""with r as (select 'media_item' as record_kind, media_id as record_id, published as w, feed from media_item union all select 'fetch_record', fetch_id, retrieved_at, feed from fetch_record),
    s as (select distinct record_kind, record_id, trim(regexp_replace(w, '[\\s\\p{{Z}}]+', ' ', 'g')) as s, zone_name, coalesce(day_first, true) as df from r left join feed using (feed) where w is not null),
    p as (select *, case {form} end as form from s), g as (select *, case form {parts} end as g from p),
    d as (select *, case when form in ('iso', 'compact') then try_cast(g.a as int) when form = 'numeric' and length(g.c) = 2 then try_cast(g.c as int) + case when try_cast(g.c as int) < 69 then 2000 else 1900 end else try_cast(g.c as int) end as y,
    case when form in ('iso', 'compact') then try_cast(g.b as int) when form = 'numeric' then try_cast(case when df then g.b else g.a end as int) when form = 'day_name' then {months}[lower(g.b)] else {months}[lower(g.a)] end as m,
    case when form in ('iso', 'compact') then try_cast(g.c as int) when form = 'numeric' then try_cast(case when df then g.a else g.b end as int) when form = 'day_name' then try_cast(g.a as int) else try_cast(g.b as int) end as d,
    case when g.hour = '' then 0 when g.half = '' then try_cast(g.hour as int) when try_cast(g.hour as int) between 1 and 12 then try_cast(g.hour as int) % 12 + case when lower(g.half) = 'p' then 12 else 0 end end as h,
    coalesce(try_cast(nullif(g.minute, '') as int), 0) as mi, coalesce(try_cast(nullif(g.second, '') as int), 0) as se, cast(rpad(substr(g.fraction, 1, 6), 6, '0') as int) as us, nullif(replace(upper(g.zone), '−', '-'), '') as z, regexp_replace(g.zone, '[^0-9]', '', 'g') as zd from g),
    l as (select *, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, m, d, h, mi, se) as timestamp) + to_microseconds(us) as t, z is not null and regexp_matches(z, '^[+-][0-9]') as signed,
    try_cast(case when length(zd) = 3 then substr(zd, 1, 1) else substr(zd, 1, 2) end as int) as zh, case when length(zd) <= 2 then 0 else try_cast(right(zd, 2) as int) end as zm from d),
    o as (select *, case when signed and zh <= 18 and zm < 60 then (zh * 60 + zm) * case when starts_with(z, '-') then -1 else 1 end when not signed then {zones}[z] end as off,
    coalesce(case when g.region in ({", ".join(_quoted(z) for z in CANDIDATE_ZONES)}) then g.region end, zone_name, 'UTC') as zone from l),
    u as (select *, timezone(zone, t) as moment from o where off is null and z is null and t is not null)
    select record_kind, record_id, epoch_us(t) - off::bigint * 60000000 as utc_micros from o where off is not null and t is not null
    union select record_kind, record_id, epoch_us(case when timezone(zone, moment - interval 1 hour) = t then moment - interval 1 hour else moment end) from u
    union select record_kind, record_id, case when length(s) <= 11 then s::bigint * 1000000 when length(s) <= 14 then s::bigint * 1000 when length(s) = 19 then s::bigint // 1000 else s::bigint end
    from p where form is null and regexp_full_match(s, '-?[0-9]+') and (length(s) between 9 and 17 or length(s) = 19)"""


_BODIES = """with r as (select distinct fetch_id, case when json_valid(body) then body::json end as j from fetch_record where fetch_id is not null),
b as (select fetch_id, case when json_type(j) <> 'VARCHAR' then j when json_valid(j->>'$') then (j->>'$')::json end as j from r),
o as (select fetch_id, j from b where json_type(j) = 'OBJECT'),
g as (select fetch_id, case json_type(j->'$.pages') when 'ARRAY' then from_json(j->'$.pages', '["json"]') when 'OBJECT' then [j->'$.pages'] end as g from o),
l as (select fetch_id, 1 as k, 0 as page, j->'$.items' as x from o union all
  select fetch_id, 2, i, g[i]->'$.items' from (select fetch_id, g, unnest(range(1, len(g) + 1)) as i from g) where json_type(g[i]) = 'OBJECT' union all
  select fetch_id, 3, 0, j->'$.casefile.officers' from o where json_type(j->'$.casefile') = 'OBJECT'),
s as (select *, case json_type(x) when 'ARRAY' then json_array_length(x)::bigint when 'OBJECT' then 1 else 0 end as n from l),
f as (select *, coalesce(sum(n) over (partition by fetch_id order by k, page rows between unbounded preceding and 1 preceding), 0)::bigint as off from s),
e as (select fetch_id, off + p as item_pos, case json_type(x) when 'ARRAY' then json_extract(x, '$[' || p || ']') else x end as e from (select *, unnest(range(n)) as p from f where n > 0)),
v as (select fetch_id, item_pos, e, e->'$.former_names' as c from e where json_type(e) = 'OBJECT'),
h as (select fetch_id, item_pos, q as child_pos, case json_type(c) when 'ARRAY' then json_extract(c, '$[' || q || ']') else c end as h
  from (select *, unnest(range(case json_type(c) when 'ARRAY' then json_array_length(c)::bigint when 'OBJECT' then 1 else 0 end)) as q from v))
select distinct fetch_id, item_pos, -1::bigint as child_pos, case when json_type(e->'$.name') in ('ARRAY', 'OBJECT') then '' else coalesce(e->>'$.name', '') end as name,
  case when json_type(e->'$.appointed_on') in ('ARRAY', 'OBJECT') then '' else coalesce(e->>'$.appointed_on', '') end as appointed_on,
  case when json_type(e->'$.links.officer.appointments') in ('ARRAY', 'OBJECT') then '' else coalesce(e->>'$.links.officer.appointments', '') end as officer_path from v
union all select distinct fetch_id, item_pos, child_pos, case when json_type(h->'$.name') in ('ARRAY', 'OBJECT') then '' else coalesce(h->>'$.name', '') end, '', '' from h where json_type(h) = 'OBJECT'"""

QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p6_zones": p6_zones, "p7_found": p7_found}
ORACLES = {"p6_found": _instants_sql(), "p7_found": _BODIES}
