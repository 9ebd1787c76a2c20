"""Queries of the screening operators, each beside its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.operators import evidence as E
from caseloom.operators.vectors import top_matches
from caseloom.operators.wording import listed_terms
from caseloom.sources.tables import table

AS_OF = dt.date(2026, 1, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CATEGORIES = ("misconduct", "insolvency", "regulatory", "litigation", "sanctions")


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _as_of() -> Column:
    return F.lit(AS_OF)


@_query(
    """select distinct media_id, case when regexp_full_match(b, '[0-9]{6,8}') then lpad(b, 8, '0') when regexp_full_match(b, '[A-Z]{2}[0-9]{6}') then b end as number
    from (select media_id, upper(regexp_replace(company_number, '\\s+', '', 'g')) as b from media_item)"""
)
def registry_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_item").select("media_id", X.company_number(F.col("company_number")).alias("number")).distinct()


@_query(
    """with q as (select distinct appointed_to.company_name as query from appointments where appointed_to.company_name is not null),
    k as (select query, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) as k, upper(regexp_replace(query, '\\s+', '', 'g')) as b from q),
    c as (select trim(regexp_replace(lower(company_name), '[^a-z0-9]+', ' ', 'g')) as k, count(distinct company_number) as n, min(company_number) as one from company_profile group by 1)
    select query, case when regexp_full_match(b, '[0-9]{6,8}|[A-Z]{2}[0-9]{6}') then 'number' when n is null then 'empty' when n = 1 then 'single' else 'ambiguous' end as outcome,
    case when regexp_full_match(b, '[0-9]{6,8}') then lpad(b, 8, '0') when regexp_full_match(b, '[A-Z]{2}[0-9]{6}') then b when n = 1 then one end as company_number, coalesce(n, 0) as n_candidates
    from k left join c using (k)"""
)
def resolve_titles(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "appointments").select(F.col("appointed_to.company_name").alias("query")).where("query is not null")
    return E.resolve_titles(asked, table(spark, d, "company_profile").select(F.col("company_name").alias("title"), "company_number"))


_TOKENS = """list_sort(list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '),
    lambda t: t <> '' and t not in ('mr','mrs','ms','miss','mx','dr','prof','sir','dame','lord','lady')))"""


@_query(f"select distinct officer_row_id, array_to_string({_TOKENS.format(c='name')}, ' ') as tokens from officers")
def person_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "officers").select("officer_row_id", F.array_join(X.name_tokens(F.col("name")), " ").alias("tokens")).distinct()


@_query(
    """select distinct officer_row_id, nullif(regexp_extract(trim(links.officer.appointments), '^/officers/([^/]+)/appointments/?$', 1), '') as officer_id,
    case when date_of_birth.month between 1 and 12 then printf('%04d-%02d', date_of_birth.year, date_of_birth.month) when date_of_birth.year is not null then printf('%04d', date_of_birth.year) end as born
    from officers"""
)
def officer_links(spark: SparkSession, d: str) -> DataFrame:
    born = X.birth_text(F.col("date_of_birth.year"), F.col("date_of_birth.month"))
    return table(spark, d, "officers").select("officer_row_id", X.officer_id(F.col("links.officer.appointments")).alias("officer_id"), born.alias("born")).distinct()


@_query(
    """select distinct officer_row_id, case when contains(name, ',') then trim(split_part(name, ',', 1)) end as last_name,
    case when contains(name, ',') then trim(substr(name, strpos(name, ',') + 1)) end as first_name,
    case when contains(name, ',') then trim(trim(substr(name, strpos(name, ',') + 1)) || ' ' || trim(split_part(name, ',', 1)))
    else trim(regexp_replace(name, '^((mr|mrs|ms|miss|mx|dr|prof|sir|dame|lord|lady)\\.*\\s+)+', '', 'i')) end as full_name from officers where name is not null"""
)
def person_parts(spark: SparkSession, d: str) -> DataFrame:
    name, comma = F.col("name"), F.col("name").contains(",")
    last, rest = F.trim(F.split_part("name", F.lit(","), F.lit(1))), F.trim(F.expr("substr(name, instr(name, ',') + 1)"))
    plain = F.trim(F.regexp_replace(name, rf"(?i)^(({'|'.join(X.HONORIFICS)})\.*\s+)+", ""))
    return (
        table(spark, d, "officers").where("name is not null")
        .select("officer_row_id", F.when(comma, last).alias("last_name"), F.when(comma, rest).alias("first_name"), F.when(comma, F.trim(F.concat_ws(" ", rest, last))).otherwise(plain).alias("full_name"))
        .distinct()
    )


_HEAD = "'^[A-Za-z][A-Za-z0-9+.-]*://"


@_query(
    f"""select distinct media_id, regexp_replace(lower(regexp_extract(trim(url), {_HEAD}([^/?#]*)', 1)), '^www\\.', '') as domain,
    lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(regexp_extract(trim(url), {_HEAD}[^/?#]*([^?#]*)', 1), '/+$', '')
    || regexp_extract(trim(url), '^[^?#]*(\\?[^#]*)', 1) as url_key from media_item where url is not null"""
)
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media_item").where("url is not null")
    return m.select("media_id", X.source_domain(F.col("url")).alias("domain"), X.url_key(F.col("url")).alias("url_key")).distinct()


@_query(
    """select distinct media_id, case when length(t) > 80 then substr(t, 1, 77) || '...' else t end as shown
    from (select media_id, coalesce(nullif(snippet, ''), nullif(title, '')) as t from media_item)"""
)
def shown_snippets(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce(F.nullif("snippet", F.lit("")), F.nullif("title", F.lit("")))
    return table(spark, d, "media_item").select("media_id", X.shorten(t, 80).alias("shown")).distinct()


_SLUG = """coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(company_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24), '-+$', ''), ''), 'company')"""


@_query(
    f"""with c as (select distinct company_number, {_SLUG} as base from company_profile),
    k as (select *, row_number() over (partition by base order by company_number) as k from c)
    select company_number, case when k = 1 then base else base || '-' || k end as slug, base || '-' || lower(company_number) as case_dir from k"""
)
def case_slugs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "company_profile").select("company_number", X.slug(F.col("company_name"), 24).alias("base")).distinct()
    named = E.unique_names(c, "base", "company_number", "slug")
    return named.select("company_number", "slug", F.concat("base", F.lit("-"), F.lower("company_number")).alias("case_dir"))


@_query(
    """select distinct fetch_id, sha256(coalesce(url, '') || '?' || coalesce(array_to_string(list_sort(list_transform(map_entries(params), lambda e: e.key || '=' || coalesce(e.value, ''))), '&'), '')) as cache_key
    from fetch_record"""
)
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    whole = F.concat(F.coalesce("url", F.lit("")), F.lit("?"), F.coalesce(F.array_join(pairs, "&"), F.lit("")))
    return table(spark, d, "fetch_record").select("fetch_id", F.sha2(whole, 256).alias("cache_key")).distinct()


@_query(
    """select distinct fetch_id, array_to_string(list_sort(list_filter(map_keys(params), lambda k: not regexp_matches(k, '(?i)(key|token|secret|auth|password)'))), ',') as kept,
    len(list_filter(map_keys(params), lambda k: regexp_matches(k, '(?i)(key|token|secret|auth|password)'))) as n_redacted from fetch_record where params is not null"""
)
def redact_params(spark: SparkSession, d: str) -> DataFrame:
    kept = X.safe_params(F.col("params"))
    f = table(spark, d, "fetch_record").where("params is not null")
    return f.select("fetch_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"), (F.size("params") - F.size(kept)).cast("bigint").alias("n_redacted")).distinct()


@_query(
    """select distinct company_number, greatest(0, year(date '2026-01-01') - year(date_of_creation) - cast(strftime(date '2026-01-01', '%m%d') < strftime(date_of_creation, '%m%d') as int)) as full_years,
    array_to_string(list_filter([registered_office_address.address_line_1, registered_office_address.address_line_2, registered_office_address.locality, registered_office_address.postal_code, registered_office_address.country],
    lambda x: x is not null and x <> ''), ', ') as office from company_profile where date_of_creation is not null and registered_office_address is not null"""
)
def company_display(spark: SparkSession, d: str) -> DataFrame:
    a = "registered_office_address"
    lines = F.array(*(F.col(f"{a}.{c}") for c in ("address_line_1", "address_line_2", "locality", "postal_code", "country")))
    office = F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), ", ")
    c = table(spark, d, "company_profile").where("date_of_creation is not null and registered_office_address is not null")
    return c.select("company_number", X.full_years(F.col("date_of_creation"), _as_of()).alias("full_years"), office.alias("office")).distinct()


@_query(
    """select company_number, count(*) filter (resigned_on is null) as n_current, count(*) filter (resigned_on >= date '2026-01-01' - cast(round_even(2 * 365.25, 0) as int)) as n_lookback,
    count(*) filter (resigned_on >= date '2026-01-01' - 365) as n_last_year,
    count(*) filter (resigned_on >= date '2026-01-01' - 365) >= greatest(2, count(*) filter (resigned_on is null) / 2.0) as wholesale
    from (select distinct company_number, officer_row_id, resigned_on from officers) group by company_number"""
)
def officer_turnover(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "officers").select("company_number", "officer_row_id", "resigned_on").distinct()
    back = F.date_sub(_as_of(), F.bround(F.lit(2 * 365.25), 0).cast("int"))
    year = F.count_if(F.col("resigned_on") >= F.date_sub(_as_of(), 365))
    now = F.count_if(F.col("resigned_on").isNull())
    return o.groupBy("company_number").agg(
        now.alias("n_current"), F.count_if(F.col("resigned_on") >= back).alias("n_lookback"), year.alias("n_last_year"), (year >= F.greatest(F.lit(2.0), now / 2)).alias("wholesale")
    )


_ELSEWHERE = """now as (select distinct company_number, officer_row_id, name, nullif(regexp_extract(trim(links.officer.appointments), '^/officers/([^/]+)/appointments/?$', 1), '') as officer_id
    from officers where resigned_on is null),
    held as (select distinct officer_id, upper(regexp_replace(appointed_to.company_number, '\\s+', '', 'g')) as other_number, appointed_to.company_name as other_name
    from appointments where resigned_on is null and appointed_to.company_number is not null),
    elsewhere as (select * from now join held using (officer_id) where other_number <> company_number and regexp_full_match(other_number, '[0-9]{8}|[A-Z]{2}[0-9]{6}'))"""


@_query(
    f"""with {_ELSEWHERE} select company_number, other_number, min(other_name) as other_name, string_agg(distinct name, '; ' order by name) as holders, count(distinct name) as n_holders
    from elsewhere group by 1, 2 having count(distinct name) >= 2"""
)
def coappointment_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = E.shared_companies(E.current_elsewhere(table(spark, d, "officers"), table(spark, d, "appointments")))
    return s.withColumn("n_holders", F.col("n_holders").cast("bigint"))


@_query(
    f"""with {_ELSEWHERE}, shown as (select distinct officer_row_id, coalesce(nullif(trim(other_name), ''), 'unnamed company') || ' (' || other_number || ')' as shown from elsewhere),
    n as (select officer_row_id, count(*) as n_other from shown group by 1)
    select distinct officer_row_id, company_number, coalesce(n_other, 0) as n_other from now left join n using (officer_row_id)"""
)
def appointment_fanout(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "officers")
    return E.appointment_fanout(o, E.current_elsewhere(o, table(spark, d, "appointments")))


_OF = f"""o as (select distinct officer_row_id, {_TOKENS.format(c='name')} as t, date_of_birth.month as m, date_of_birth.year as y, resigned_on is null as active from officers where name is not null)"""
_SU = f"""s as (select distinct result_id, {_TOKENS.format(c='subject')} as t, try_cast(nullif(regexp_extract(birth_date, '^(\\d{{4}})', 1), '') as int) as y,
    try_cast(nullif(regexp_extract(birth_date, '^\\d{{4}}-(\\d{{2}})', 1), '') as int) as m from sanctions_result where query_schema = 'Person' and subject is not null)"""


def _identities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "officers").where("name is not null").select(
        "officer_row_id", X.name_tokens(F.col("name")).alias("t"), F.col("date_of_birth.month").alias("m"), F.col("date_of_birth.year").alias("y"), F.col("resigned_on").isNull().alias("active")
    ).distinct()
    s = table(spark, d, "sanctions_result").where("query_schema = 'Person' and subject is not null").select(
        "result_id", X.name_tokens(F.col("subject")).alias("t"), F.nullif(F.regexp_extract("birth_date", r"^(\d{4})", 1), F.lit("")).try_cast("int").alias("sy"),
        F.nullif(F.regexp_extract("birth_date", r"^\d{4}-(\d{2})", 1), F.lit("")).try_cast("int").alias("sm"),
    ).distinct()
    return o, s


@_query(f"with {_OF}, {_SU} select result_id, min(officer_row_id) as officer_row_id, count(*) as n_rows from o join s on o.t = s.t and o.y = s.y and o.m = s.m group by result_id")
def person_identity_merge(spark: SparkSession, d: str) -> DataFrame:
    o, s = _identities(spark, d)
    met = s.join(o, (o.t == s.t) & (F.col("y") == F.col("sy")) & (F.col("m") == F.col("sm")))
    return met.groupBy("result_id").agg(F.min("officer_row_id").alias("officer_row_id"), F.count(F.lit(1)).alias("n_rows"))


@_query(
    f"""with {_OF}, {_SU}, c as (select result_id, o.y = s.y and o.m = s.m as same, active from o join s on o.t = s.t),
    r as (select result_id, max(case when same and active then 4 when same then 3 when not same then 1 else 2 end) as k from c group by 1)
    select result_id, case k when 4 then 'strong_active' when 3 then 'strong_past' when 2 then 'name_only' else 'mismatch' end as tier from r"""
)
def match_tiers(spark: SparkSession, d: str) -> DataFrame:
    o, s = _identities(spark, d)
    same = (F.col("y") == F.col("sy")) & (F.col("m") == F.col("sm"))
    tier = E.match_tier(same, F.col("active"))
    rank = F.create_map(*(F.lit(x) for kv in (("strong_active", 4), ("strong_past", 3), ("name_only", 2), ("mismatch", 1)) for x in kv))
    c = s.join(o.withColumnRenamed("t", "ot"), F.col("t") == F.col("ot")).select("result_id", tier.alias("tier"))
    return c.groupBy("result_id").agg(F.max_by("tier", rank[F.col("tier")]).alias("tier"))


@_query(
    """select result_id, max(top_score) as top_score, case when bool_or(coalesce(matched, false) or coalesce(top_score >= 0.7, false)) then 'matched' when max(top_score) is not null then 'below' else 'none' end as outcome,
    array_to_string(list_sort(list_distinct(flatten(list(datasets)))), ',') as datasets from sanctions_result group by result_id"""
)
def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    hit = F.bool_or(F.coalesce("matched", F.lit(False)) | F.coalesce(F.col("top_score") >= 0.7, F.lit(False)))
    outcome = F.when(hit, "matched").when(F.max("top_score").isNotNull(), "below").otherwise("none")
    sets = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("datasets")))), ",")
    return table(spark, d, "sanctions_result").groupBy("result_id").agg(F.max("top_score").alias("top_score"), outcome.alias("outcome"), sets.alias("datasets"))


@_query(
    """with k as (select company_number, result_id, row_number() over (partition by company_number order by result_id) as k from
    (select distinct query_schema as company_number, result_id // 1000 as shard, result_id from sanctions_result)), j as (select * from k)
    select company_number as query_schema, result_id, 'q' || lpad(cast(k as varchar), cast(greatest(3, length(cast(k as varchar))) as int), '0') as query_id, (k - 1) // 100 as batch from j"""
)
def batch_ids(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "sanctions_result").select("query_schema", "result_id").distinct()
    k = E.running_total(r.withColumn("g", F.coalesce("query_schema", F.lit(""))), "g", "result_id", F.lit(1), "before")
    return k.select("query_schema", "result_id", F.format_string("q%03d", F.col("before") + 1).alias("query_id"), F.floor(F.col("before") / 100).alias("batch"))


_MEDIA = """m as (select distinct media_id, upper(regexp_replace(company_number, '\\s+', '', 'g')) as company, category, url,
    lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
    || regexp_extract(trim(url), '^[^?#]*(\\?[^#]*)', 1) as k from media_item where company_number is not null and url is not null and category is not null),
    t as (select * from (select *, row_number() over (partition by company, category order by media_id) as r from m) where r <= 5),
    u as (select * from (select *, row_number() over (partition by company, k order by category, media_id) as r2 from t) where r2 = 1)"""


def _media(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media_item").where("company_number is not null and url is not null and category is not null")
    m = m.select("media_id", F.upper(F.regexp_replace("company_number", r"\s+", "")).alias("company"), "category", "url", X.url_key(F.col("url")).alias("k")).distinct()
    return E.first_n(m, ["company", "category"], ["media_id"], 5)


@_query(f"with {_MEDIA} select company, category, media_id, k as url_key from u")
def media_topn_dedup(spark: SparkSession, d: str) -> DataFrame:
    seen = E.first_seen(_media(spark, d), ["company", "k"], ["category", "media_id"])
    return seen.select("company", "category", "media_id", F.col("k").alias("url_key"))


@_query(
    f"""with {_MEDIA}, c as (select unnest(['misconduct','insolvency','regulatory','litigation','sanctions']) as category), f as (select distinct company from m),
    n as (select company, category, count(*) as n_raw from t group by 1, 2), q as (select company, category, count(*) as n_dedup, string_agg(cast(media_id as varchar), ',' order by media_id) as ids from u group by 1, 2)
    select company, category, coalesce(n_raw, 0) as n_raw, coalesce(n_dedup, 0) as n_dedup, coalesce(ids, '') as evidence from f cross join c left join n using (company, category) left join q using (company, category)"""
)
def media_categories(spark: SparkSession, d: str) -> DataFrame:
    top = _media(spark, d)
    seen = E.first_seen(top, ["company", "k"], ["category", "media_id"])
    m = table(spark, d, "media_item").where("company_number is not null and url is not null and category is not null")
    every = m.select(F.upper(F.regexp_replace("company_number", r"\s+", "")).alias("company")).distinct().withColumn("category", F.explode(F.array(*(F.lit(c) for c in CATEGORIES))))
    raw = top.groupBy("company", "category").agg(F.count(F.lit(1)).alias("n_raw"))
    ids = F.array_join(F.slice(F.array_sort(F.collect_list("media_id")), 1, 5), ",")
    own = seen.groupBy("company", "category").agg(F.count(F.lit(1)).alias("n_dedup"), ids.alias("ids"))
    j = every.join(raw, ["company", "category"], "left").join(own, ["company", "category"], "left")
    return j.select("company", "category", F.coalesce("n_raw", F.lit(0)).alias("n_raw"), F.coalesce("n_dedup", F.lit(0)).alias("n_dedup"), F.coalesce("ids", F.lit("")).alias("evidence"))


@_query(
    """with p as (select distinct company_number, company_name, previous_company_names as n from company_profile),
    s as (select company_number, company_name as name from p union all select company_number, x.name from (select company_number, company_name, unnest(n) as x from p) where x.name is not null and x.name <> company_name),
    c as (select unnest(['misconduct','insolvency','regulatory','litigation','sanctions']) as category)
    select company_number, category, '"' || name || '" ' || category as query, count(*) as n from s cross join c where name is not null group by all"""
)
def media_queries(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "company_profile").select("company_number", "company_name", F.col("previous_company_names").alias("n")).distinct()
    own = p.select("company_number", F.col("company_name").alias("name"))
    old = p.select("company_number", "company_name", F.explode("n").alias("x")).where("x.name <> company_name").select("company_number", F.col("x.name").alias("name"))
    q = own.unionByName(old).where("name is not null").withColumn("category", F.explode(F.array(*(F.lit(c) for c in CATEGORIES))))
    return q.groupBy("company_number", "category", F.concat(F.lit('"'), "name", F.lit('" '), "category").alias("query")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    """select source, count(distinct doc_id) as total, cast(ceil(count(distinct doc_id) / 100.0) as bigint) as pages, least(count(distinct doc_id), 300) as retrieved, count(distinct doc_id) > 300 as truncated
    from documents where source is not null group by source"""
)
def page_accounting(spark: SparkSession, d: str) -> DataFrame:
    return E.paged(table(spark, d, "documents").where("source is not null"), "source", "doc_id", 100, 3)


@_query(
    """with l as (select user_id, max(ts) as ts from events group by 1) select user_id, strftime(ts, '%Y-%m-%d %H:%M UTC') as stored_at, ts < timestamp '2024-01-31 00:00:00' - interval 1 day as expired from l"""
)
def cache_latest_ttl(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))  # noqa: E741
    edge = F.lit(dt.datetime(2024, 1, 30)).cast("timestamp_ntz")
    return l.select("user_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("stored_at"), (F.col("ts") < edge).alias("expired"))


@_query(
    """select user_id, max(n) as most_in_window from (select user_id, count(*) over (partition by user_id order by ts range between interval 299 seconds preceding and current row) as n from events) group by 1"""
)
def throttle_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts").withColumn("n", F.expr("count(*) over (partition by user_id order by ts range between interval 299 seconds preceding and current row)"))
    return e.groupBy("user_id").agg(F.max("n").alias("most_in_window"))


@_query(
    """with b as (select company_number, doc_id, length(text) as n, coalesce(sum(length(text)) over (partition by company_number order by doc_id rows between unbounded preceding and 1 preceding), 0) as before
    from documents where company_number is not null and text is not null)
    select company_number, doc_id, greatest(0, least(n, 6000 - before)) as kept, n - greatest(0, least(n, 6000 - before)) as dropped from b"""
)
def char_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("company_number is not null and text is not null").select("company_number", "doc_id", F.length("text").cast("bigint").alias("n"))
    run = E.running_total(docs, "company_number", "doc_id", F.col("n"), "before")
    kept = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("n"), F.lit(6000) - F.col("before")))
    return run.select("company_number", "doc_id", kept.alias("kept"), (F.col("n") - kept).alias("dropped"))


_FOLD = "replace(lower(trim(regexp_replace(translate({c}, '‘’‚‛“”„‟‐‑‒–—―−', '''''''''\"\"\"\"-------'), '[\\s\\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss')"


@_query(
    f"""select distinct media_id, {_FOLD.format(c='title')} as claim, contains({_FOLD.format(c='snippet')}, {_FOLD.format(c='title')})
    and len(string_split({_FOLD.format(c='title')}, ' ')) >= 2 as verified from media_item where title is not null and snippet is not null"""
)
def quote_verification(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media_item").where("title is not null and snippet is not null")
    claim = X.fold_for_match(F.col("title"))
    ok = F.contains(X.fold_for_match(F.col("snippet")), claim) & (F.size(F.split(claim, " ")) >= 2)
    return m.select("media_id", claim.alias("claim"), ok.alias("verified")).distinct()


@_query(
    """with w as (select doc_id, t, string_split_regex(t, '[^\\p{L}\\p{N}_]+') as w from (select doc_id, lower(regexp_replace(text, 'https?://\\S+', ' ', 'g')) as t from documents where text is not null)),
    n as (select doc_id, len(list_filter(w, lambda x: x in ('fraud', 'liar', 'lying', 'crook', 'criminal', 'scam', 'nominee'))) + len(regexp_extract_all(replace(t, ' ', '  '), '(?:^|[^\\p{L}\\p{N}_])tax\\s+refund(?:$|[^\\p{L}\\p{N}_])')) as n_hits from w)
    select * from n where n_hits > 0"""
)
def vocabulary_gate(spark: SparkSession, d: str) -> DataFrame:
    hits = listed_terms(F.col("text"), ("fraud", "liar", "lying", "crook", "criminal", "scam", "tax refund", "nominee"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(hits).cast("bigint").alias("n_hits")).where("n_hits > 0")


@_query(
    """select doc_id, unnest(regexp_extract_all(text, 'href="([^"]+)"', 1)) as href, generate_subscripts(regexp_extract_all(text, 'href="([^"]+)"', 1), 1) - 1 as pos from documents where text is not null"""
)
def html_links(spark: SparkSession, d: str) -> DataFrame:
    hrefs = F.regexp_extract_all("text", F.lit(r'href="([^"]+)"'), F.lit(1))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(hrefs).alias("pos", "href")).select("doc_id", "href", F.col("pos").cast("bigint").alias("pos"))


@_query(
    """with p as (select distinct company_number, page_id, 'site ' || coalesce(nullif(path, ''), '/') as label, text from site_page where text is not null and text <> '' and company_number is not null)
    select company_number, label, count(*) as n_pages, length(string_agg(text, chr(10) order by page_id)) as n_chars from p group by 1, 2"""
)
def section_map(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "site_page").where("text is not null and text <> '' and company_number is not null")
    p = p.select("company_number", "page_id", F.concat(F.lit("site "), F.coalesce(F.nullif("path", F.lit("")), F.lit("/"))).alias("label"), F.length("text").alias("n"), F.xxhash64("text").alias("h")).distinct()
    # The joined text's length without joining it: what is joined with line feeds needs one fewer than its parts.
    return p.groupBy("company_number", "label").agg(F.count(F.lit(1)).alias("n_pages"), (F.sum("n") + F.count(F.lit(1)) - 1).alias("n_chars"))


@_query(
    """with y as (select doc_id, company_number, cast(unnest(regexp_extract_all(text, '(?:[Tt]rading began|[Ww]e started|[Ff]ounded|[Ee]stablished) in (1[89]\\d\\d|20\\d\\d)', 1)) as int) as y from documents where text is not null),
    c as (select company_number, min(date_of_creation) as c from company_profile group by 1)
    select doc_id, y as claimed_year, year(c) as created_year, count(*) as n from y join c using (company_number) where y < year(c) group by all"""
)
def origin_year(spark: SparkSession, d: str) -> DataFrame:
    years = F.regexp_extract_all("text", F.lit(r"(?:[Tt]rading began|[Ww]e started|[Ff]ounded|[Ee]stablished) in (1[89]\d\d|20\d\d)"), F.lit(1))
    y = table(spark, d, "documents").where("text is not null").select("doc_id", "company_number", F.explode(years).alias("y")).withColumn("claimed_year", F.col("y").cast("int"))
    c = table(spark, d, "company_profile").groupBy("company_number").agg(F.year(F.min("date_of_creation")).alias("created_year"))
    return y.join(c, "company_number").where("claimed_year < created_year").groupBy("doc_id", "claimed_year", "created_year").agg(F.count(F.lit(1)).alias("n"))


@_query(
    """select result_id, array_to_string(list_sort(list_intersect(s, ['eu_fsf', 'gb_hmt_sanctions', 'un_sc', 'us_ofac_sdn'])), ',') as listed,
    array_to_string(list_sort(list_filter(s, lambda x: not list_contains(['eu_fsf', 'gb_hmt_sanctions', 'un_sc', 'us_ofac_sdn'], x))), ',') as others
    from (select result_id, list_distinct(flatten(list(datasets))) as s from sanctions_result where datasets is not null group by 1)"""
)
def dataset_sets(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*(F.lit(x) for x in ("eu_fsf", "gb_hmt_sanctions", "un_sc", "us_ofac_sdn")))
    s = table(spark, d, "sanctions_result").where("datasets is not null").groupBy("result_id").agg(F.flatten(F.collect_list("datasets")).alias("s"))
    return s.select("result_id", F.array_join(F.array_sort(F.array_intersect("s", known)), ",").alias("listed"), F.array_join(F.array_sort(F.array_except("s", known)), ",").alias("others"))


@_query(
    """select coalesce(case when s in ('administration', 'liquidation', 'receivership', 'insolvency-proceedings', 'voluntary-arrangement') then 'insolvency'
    when s in ('dissolved', 'closed', 'converted-closed', 'removed') then 'ended' when s = 'active' then 'active' else 'other' end, 'other') as family, count(*) as n
    from (select company_number, max(lower(trim(company_status))) as s from company_profile group by 1) group by 1"""
)
def status_families(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "company_profile").groupBy("company_number").agg(F.max(F.lower(F.trim("company_status"))).alias("s"))
    family = (
        F.when(F.col("s").isin("administration", "liquidation", "receivership", "insolvency-proceedings", "voluntary-arrangement"), "insolvency")
        .when(F.col("s").isin("dissolved", "closed", "converted-closed", "removed"), "ended").when(F.col("s") == "active", "active").otherwise("other")
    )
    return c.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    """select c_custkey, count(*) filter (o_orderstatus = 'O') as n_open, count(*) filter (o_orderstatus = 'F') as n_done, count(*) filter (o_orderstatus = 'P') as n_part
    from customer left join orders on o_custkey = c_custkey group by 1"""
)
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(*(F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("O", "n_open"), ("F", "n_done"), ("P", "n_part"))))
    j = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return j.select("c_custkey", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_open", "n_done", "n_part")))


@_query(
    """with r as (select *, row_number() over (partition by appointment_id order by retrieved_at desc, officer_id desc, appointed_on desc, resigned_on desc) as k
    from (select distinct appointment_id, retrieved_at, officer_id, appointed_on, resigned_on from appointments))
    select appointment_id, officer_id, cast(appointed_on as varchar) as appointed_on, cast(resigned_on as varchar) as resigned_on from r where k = 1"""
)
def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "appointments").select("appointment_id", "retrieved_at", "officer_id", "appointed_on", "resigned_on")
    v = E.latest(a, "appointment_id", "retrieved_at")
    return v.select("appointment_id", "officer_id", F.col("appointed_on").cast("string").alias("appointed_on"), F.col("resigned_on").cast("string").alias("resigned_on"))


@_query(
    """select company_number, array_to_string(list_sort(list_distinct(list_transform(previous_company_names, lambda x: x.name))), '; ') as names, len(previous_company_names) as n
    from (select distinct company_number, previous_company_names from company_profile) where len(previous_company_names) > 0"""
)
def previous_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "company_profile").select("company_number", "previous_company_names").distinct().where(F.size("previous_company_names") > 0)
    names = F.array_sort(F.array_distinct(F.transform("previous_company_names", lambda x: x["name"])))
    return c.select("company_number", F.array_join(names, "; ").alias("names"), F.size("previous_company_names").cast("bigint").alias("n"))


@_query(
    """with v as (select result_id, round_even(max(top_score), 2) as s from sanctions_result where top_score is not null and not isnan(top_score) group by 1)
    select s as score, count(*) as n from v group by 1"""
)
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "sanctions_result").where("top_score is not null and not isnan(top_score)").groupBy("result_id").agg(F.bround(F.max("top_score"), 2).alias("s"))
    return v.groupBy(F.col("s").alias("score")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    """with v as (select vec_id, embedding, label from embeddings where vec_id % 50 = 0), p as (select v.vec_id as query_id, e.vec_id, round(list_cosine_similarity(cast(v.embedding as double[]), cast(e.embedding as double[])), 6) as score
    from v, embeddings e where v.vec_id <> e.vec_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from p)
    select query_id, vec_id, score, case when score >= 0.4 then 'matched' else 'near' end as outcome from r where k <= 5"""
)
def vector_matches(spark: SparkSession, d: str) -> DataFrame:
    return top_matches(table(spark, d, "embeddings"), 5).withColumn("outcome", F.when(F.col("score") >= 0.4, "matched").otherwise("near"))


_SPANS = """with a as (select * from (select *, row_number() over (partition by appointment_id order by retrieved_at desc) as k from appointments) where k = 1),
    s as (select officer_id, appointed_on as s, resigned_on as e from a union all
    select nullif(regexp_extract(trim(links.officer.appointments), '^/officers/([^/]+)/appointments/?$', 1), ''), appointed_on, resigned_on from officers),
    v as (select officer_id, s, coalesce(e, date '9999-12-30') as e from s where officer_id is not null and s is not null and (e is null or e >= s)),
    r as (select *, max(e) over (partition by officer_id order by s, e rows between unbounded preceding and 1 preceding) as reach from v),
    i as (select *, sum(case when reach is null or s > reach + 1 then 1 else 0 end) over (partition by officer_id order by s, e rows unbounded preceding) as g from r),
    p as (select officer_id, g, min(s) as s, max(e) as e from i group by 1, 2),
    l as (select *, lag(e) over (partition by officer_id order by s) as b from p)
    select officer_id, 'period' as span_kind, strftime(s, '%Y-%m-%d') as first_day, case when e = date '9999-12-30' then 'open' else strftime(e, '%Y-%m-%d') end as last_day from l
    union all select officer_id, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(s - 1, '%Y-%m-%d') from l where b is not null"""
ORACLES["p4_found"] = _SPANS
