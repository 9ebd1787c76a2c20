"""Queries of the operators over listings, pages, people and claims, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.operators import claims as C
from caseloom.operators import evidence as E
from caseloom.operators import listings as L
from caseloom.operators import pages as G
from caseloom.operators import people as P
from caseloom.operators import wording as W
from caseloom.operators.timestamps import settle
from caseloom.plans.screening import _FOLD, _TOKENS, AS_OF, _query
from caseloom.sources import casefiles as S
from caseloom.sources.tables import table

#: Terms of the queries: the listed ones, and two that the tables' texts have.
WATCHED = (*W.TERMS, "nominee", "tax refund")
_WORDS = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
_URLS = "regexp_replace({c}, 'https?://\\S+', ' ', 'g')"


def _bare(c: str) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


# -- listings


@_query(
    """with o as (select o_custkey as resource, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 3 + 1 as page, case when o_orderstatus <> 'P' then o_orderpriority end as key,
    count(*) over (partition by o_custkey) as n from orders),
    r as (select *, case when page = 1 then n + resource % 3 when page % 2 = 1 then n end as said from o where page <= 3),
    w as (select resource, page, count(*) as fresh from (select resource, key, min(page) as page from r where key is not null group by 1, 2) group by 1, 2),
    p as (select resource, page, max(said) as said, count(*) as received from r group by 1, 2),
    s as (select p.*, coalesce(fresh, 0) as fresh, last_value(said ignore nulls) over (partition by resource order by page) as total from p left join w using (resource, page)),
    t as (select *, sum(fresh) over (partition by resource order by page) as got from s),
    u as (select *, page > 1 and fresh = 0 as stuck, (page > 1 and fresh = 0) or coalesce(got >= total, false) as stops from t),
    v as (select *, coalesce(bool_or(stops) over (partition by resource order by page rows between unbounded preceding and 1 preceding), false) as earlier from u),
    e as (select resource, count(*) as pages_read, sum(received)::bigint as received, max(got)::bigint as retrieved, arg_max(total, page) as total, bool_or(stops) as stopped, bool_or(stuck) as did_not_advance,
    bool_or(not stops and received < 3) as server_clamped from v where not earlier group by 1)
    select resource, pages_read, received, retrieved, total, retrieved < total as truncated, retrieved < total and not stopped as hit_page_cap, server_clamped, did_not_advance,
    case when retrieved >= total then 'complete' when not stopped then 'page cap' when did_not_advance then 'no advance' else 'early end' end as cause from e"""
)
def page_walks(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders as listings of three a page, open ones being no objects and priorities the items' keys."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("key"))
    n = o.groupBy(F.col("o_custkey").alias("resource")).agg(F.count(F.lit(1)).alias("n"))
    k = E.running_total(o, "o_custkey", "o_orderkey", F.lit(1), "before").withColumn("page", (F.floor(F.col("before") / 3) + 1).cast("int"))
    pages = k.groupBy(F.col("o_custkey").alias("resource"), "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "key"))), lambda x: x["key"]).alias("items"))
    said = F.when(F.col("page") == 1, F.col("n") + F.col("resource") % 3).when(F.col("page") % 2 == 1, F.col("n"))
    return L.walk_pages(pages.join(n, "resource").withColumn("total", said), 3, 3, keyed=True)


@_query(
    """with b as (select distinct fetch_id, name, body from fetch_record where json_valid(body) and json_type(body) = 'OBJECT')
    select fetch_id, name, array_to_string(list_sort(list_filter(json_keys(body), lambda k: k <> 'items')), ',') as top_level, coalesce(try_cast(body->>'$.active_count' as int), json_array_length(body->'$.items'))::int as n_active from b"""
)
def listing_heads(spark: SparkSession, d: str) -> DataFrame:
    """What a body says beside its items, and how many are active: the register's own count, else the items'."""
    b = table(spark, d, "fetch_record").select("fetch_id", "name", "body").distinct().withColumn("v", F.try_parse_json("body"))
    b = b.where(F.col("v").isNotNull() & F.ltrim("body").startswith("{"))
    keys = F.array_join(F.array_sort(F.filter(F.json_object_keys("body"), lambda k: k != "items")), ",")
    n = F.coalesce(F.try_variant_get("v", "$.active_count", "int"), F.json_array_length(F.get_json_object("body", "$.items")))
    return b.select("fetch_id", "name", keys.alias("top_level"), n.alias("n_active"))


@_query(
    """select distinct company_number, 'profile,officers,filing-history' || case when coalesce(trim(links.charges), '') <> '' then ',charges' else '' end as resources,
    case when coalesce(trim(links.charges), '') <> '' then 'linked' else 'not_linked' end as charges_state from company_profile"""
)
def link_gates(spark: SparkSession, d: str) -> DataFrame:
    """The resources that a company's profile links: only those are read."""
    linked = F.coalesce(F.trim("links.charges"), F.lit("")) != ""
    resources = F.concat(F.lit("profile,officers,filing-history"), F.when(linked, ",charges").otherwise(""))
    return table(spark, d, "company_profile").select("company_number", resources.alias("resources"), F.when(linked, "linked").otherwise("not_linked").alias("charges_state")).distinct()


@_query(
    """select distinct fetch_id, regexp_extract(url, '^[a-z]+://[^/]+/company/([^/?#]+)', 1) as company_number, regexp_extract(url, '/([^/?#]+)/?$', 1) as resource,
    case when regexp_matches(url, 'filing|charges') then 'total_count' else 'total_results' end as total_key from fetch_record where url is not null"""
)
def fetch_resources(spark: SparkSession, d: str) -> DataFrame:
    """Which resource of which company a fetch asked for, and the key that its listing's total stands under."""
    u = F.col("url")
    total = F.when(u.rlike("filing|charges"), "total_count").otherwise("total_results")
    return table(spark, d, "fetch_record").where("url is not null").select(
        "fetch_id", F.regexp_extract(u, "^[a-z]+://[^/]+/company/([^/?#]+)", 1).alias("company_number"), F.regexp_extract(u, "/([^/?#]+)/?$", 1).alias("resource"), total.alias("total_key")
    ).distinct()


@_query(
    """select distinct media_id, coalesce(nullif(url, ''), json_object('category', coalesce(category, ''), 'title', coalesce(title, ''))::varchar) as item_key from media_item"""
)
def item_keys(spark: SparkSession, d: str) -> DataFrame:
    whole = F.struct(F.coalesce("category", F.lit("")).alias("category"), F.coalesce("title", F.lit("")).alias("title"))
    return table(spark, d, "media_item").select("media_id", L.item_key(F.col("url"), whole).alias("item_key")).distinct()


@_query(
    """select distinct event_id, case when json_type(props, '$.k') = 'VARCHAR' then nullif(props->>'$.k', '') end as release_name, coalesce(nullif(event_type, ''), 'none') as event_type from events"""
)
def release_names(spark: SparkSession, d: str) -> DataFrame:
    """The first of several keys of a JSON object that holds a text, or an object with a name."""
    return table(spark, d, "events").select("event_id", S.first_name(F.col("props"), ("release", "dataset_release", "k")).alias("release_name"), L.first_of(F.col("event_type"), F.lit("none")).alias("event_type")).distinct()


@_query(
    """with l as (select feed, fetch_id, max(from_cache) as from_cache, max(coalesce(length(body), 0)) as n from fetch_record where status = 200 group by 1, 2)
    select coalesce(feed, '') as feed, count(*) as n_entries, count(*) filter (from_cache) as n_from_cache, sum(n)::bigint as n_chars from l group by 1"""
)
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.cache_stats(table(spark, d, "fetch_record"))


# -- resolving


@_query(
    """with q as (select distinct appointed_to.company_name as query from appointments where appointed_to.company_name is not null),
    k as (select query, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) as k, upper(regexp_replace(query, '\\s+', '', 'g')) as b from q),
    c as (select distinct trim(regexp_replace(lower(company_name), '[^a-z0-9]+', ' ', 'g')) as t, company_number, company_name from company_profile),
    h as (select distinct query, k.k, t, company_number, company_name from k left join c on split_part(k.k, ' ', 1) || ' ' || split_part(k.k, ' ', 2) = split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 2)),
    g as (select query, count(company_number) as n, count(*) filter (k = t) as e, min(company_number) as only_one, min(company_number) filter (k = t) as same from h group by 1)
    select query, case when regexp_full_match(b, '[0-9]{6,8}|[A-Z]{2}[0-9]{6}') then 'number' when n = 0 then 'empty' when n = 1 then 'single' when e = 1 then 'exact' else 'ambiguous' end as outcome,
    case when regexp_full_match(b, '[0-9]{6,8}') then lpad(b, 8, '0') when regexp_full_match(b, '[A-Z]{2}[0-9]{6}') then b when n = 1 then only_one when e = 1 then same end as company_number, n as n_candidates,
    case when not regexp_full_match(b, '[0-9]{6,8}|[A-Z]{2}[0-9]{6}') and n > 1 and e = 1 then n - 1 else 0 end as set_aside from g join k using (query)"""
)
def resolve_search(spark: SparkSession, d: str) -> DataFrame:
    """Typed company names against a search whose hits are the companies of the same first two words."""
    start = lambda c: F.substring_index(F.concat(X.title_key(c), F.lit(" ")), " ", 2)
    asked = table(spark, d, "appointments").select(F.col("appointed_to.company_name").alias("query")).where("query is not null").distinct()
    found = table(spark, d, "company_profile").select(F.col("company_name").alias("title"), "company_number").distinct()
    return E.resolve_hits(asked.withColumn("k", start(F.col("query"))).join(found.withColumn("k", start(F.col("title"))), "k", "left").drop("k"))


@_query(
    """with l as (select distinct s_nationkey as n, s_name, l_orderkey from lineitem join supplier on s_suppkey = l_suppkey)
    select n as company_number, l_orderkey as other_number, string_agg(s_name, '; ' order by s_name) as holders, count(*) as n_holders from l group by 1, 2 having count(*) >= 2"""
)
def shared_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders that at least two suppliers of one nation share: the overlap of appointments, on tables where it fires."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("company_number"), F.col("s_name").alias("name"))
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_orderkey").alias("other_number")).join(s, "s_suppkey")  # noqa: E741
    shared = E.shared_companies(l.withColumn("other_name", F.lit(None).cast("string")))
    return shared.select("company_number", "other_number", "holders", F.col("n_holders").cast("bigint").alias("n_holders"))


# -- people

_OWNERS = f"""w as (select distinct result_id as owner_id, subject as name, try_cast(nullif(regexp_extract(birth_date, '^(\\d{{4}})', 1), '') as int) as y,
    try_cast(nullif(regexp_extract(birth_date, '^\\d{{4}}-(\\d{{2}})', 1), '') as int) as m, {_TOKENS.format(c='subject')} as t from sanctions_result where contains(kind, 'psc') and subject is not null),
    f as (select {_TOKENS.format(c='name')} as t, date_of_birth.month as m, date_of_birth.year as y, min(officer_row_id) as merged_officer from officers
    where resigned_on is null and date_of_birth.month is not null and date_of_birth.year is not null group by 1, 2, 3),
    j as (select owner_id, name, y, m, merged_officer from w left join f using (t, m, y))"""


def _owners(spark: SparkSession, d: str) -> DataFrame:
    """Owners among the screened subjects; the tables name no company for them, so all are of one."""
    born = lambda p: F.nullif(F.regexp_extract("birth_date", p, 1), F.lit("")).try_cast("int")
    w = table(spark, d, "sanctions_result").where(F.col("kind").contains("psc") & F.col("subject").isNotNull())
    owners = w.select(F.col("result_id").alias("owner_id"), F.lit("").alias("company_number"), F.col("subject").alias("name"), born(r"^(\d{4})").alias("year"), born(r"^\d{4}-(\d{2})").alias("month"))
    return P.merge_owners(owners, _current(spark, d).withColumn("company_number", F.lit("")))


def _current(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "officers").where("resigned_on is null")
    return o.select("officer_row_id", "company_number", "name", F.col("date_of_birth.year").alias("year"), F.col("date_of_birth.month").alias("month")).distinct()


@_query(f"with {_OWNERS} select owner_id, name, merged_officer from j")
def merged_owners(spark: SparkSession, d: str) -> DataFrame:
    """Owners who are officers too, and those who aren't (null)."""
    return _owners(spark, d).select("owner_id", "name", "merged_officer")


_BORN = "case when {m} between 1 and 12 then printf('%04d-%02d', {y}, {m}) when {y} is not null then printf('%04d', {y}) end"


@_query(
    f"""with {_OWNERS}, s as (select distinct company_number, 0 as r, 0::bigint as own, 'company' as kind, company_name as name, null::varchar as birth from company_profile
    union all select distinct company_number, 1, officer_row_id, case when officer_row_id in (select merged_officer from j where merged_officer is not null) then 'officer and psc' else 'officer' end, name,
    {_BORN.format(y='date_of_birth.year', m='date_of_birth.month')} from officers where resigned_on is null
    union all select distinct '', 2, owner_id, 'psc', name, {_BORN.format(y='y', m='m')} from j where merged_officer is null),
    k as (select *, row_number() over (partition by company_number order by r, own, name nulls first) as ord from s)
    select company_number, ord, 'q' || lpad(ord::varchar, greatest(3, length(ord::varchar))::int, '0') as query_id, kind, name, birth from k"""
)
def screening_subjects(spark: SparkSession, d: str) -> DataFrame:
    companies = table(spark, d, "company_profile").select("company_number", F.col("company_name").alias("name"))
    return P.screening_subjects(companies, _current(spark, d), _owners(spark, d))


@_query(
    f"""with h as (select result_id as ord, min(subject) as name, min(query_schema) as q, min(birth_date) as b, max(retrieved_at) as seen from sanctions_result where subject is not null group by 1),
    x as (select *, {_TOKENS.format(c='name')} as t, try_cast(b || '-01' as date) as born, case when ord % 7 <> 0 then seen::date + ((ord % 5 - 2) * 200)::int end as until from h),
    p as (select distinct officer_row_id as person_id, {_TOKENS.format(c='name')} as t, starts_with(lower(coalesce(officer_role, '')), 'corporate') as corporate, date_of_birth.year as y, date_of_birth.month as m from officers),
    c as (select p.*, x.*, row_number() over (partition by person_id order by x.ord) as k from p join x on p.t = x.t),
    n as (select person_id, count(*) as n_candidates from c group by 1),
    f as (select *, case when year(born) = y and month(born) = m then case when until >= date '2026-01-01' then 4 when until is not null then 3 else 2 end
    when not (year(born) = y and month(born) = m) then 1 else 2 end as r from c where k <= 5 and (q = 'Company') = corporate),
    b as (select person_id, count(*) as n_followed, max(r) as r from f group by 1)
    select person_id, coalesce(n_candidates, 0) as n_candidates, coalesce(n_followed, 0) as n_followed, case r when 4 then 'strong_active' when 3 then 'strong_expired' when 2 then 'name_only' when 1 then 'mismatch' else 'none' end as tier
    from (select distinct person_id from p) left join n using (person_id) left join b using (person_id)"""
)
def disqualification_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Officers against the screened subjects as a register of disqualifications."""
    o = table(spark, d, "officers").select(
        F.col("officer_row_id").alias("person_id"), "name", F.lower(F.coalesce("officer_role", F.lit(""))).startswith("corporate").alias("corporate"),
        F.col("date_of_birth.year").alias("year"), F.col("date_of_birth.month").alias("month"), F.lit(None).cast("string").alias("number"),
    ).distinct()
    r = table(spark, d, "sanctions_result").where("subject is not null").groupBy("result_id").agg(
        F.min("subject").alias("name"), F.min("query_schema").alias("q"), F.min("birth_date").alias("b"), F.max("retrieved_at").alias("at")
    )
    link = F.concat(F.lit("/disqualified-officers/"), F.when(F.col("q") == "Company", "corporate").otherwise("natural"), F.lit("/"), F.col("result_id").cast("string"))
    until = F.when(F.col("result_id") % 7 != 0, F.date_add(F.col("at").cast("date"), ((F.col("result_id") % 5 - 2) * 200).cast("int")))
    r = r.select("result_id", "name", link.alias("link"), P.iso_date(F.concat("b", F.lit("-01"))).alias("birth_date"), F.lit(None).cast("string").alias("number"), F.array(until).alias("until"))
    hits = r.select(X.name_tokens(F.col("name")).alias("name_tokens"), F.col("result_id").alias("ord"), "link")
    return P.disqualification_tiers(o, hits, r.drop("result_id"), AS_OF).drop("link")


@_query(
    """with a as (select distinct officer_id, appointed_to.company_name as company_name, appointed_on as s, resigned_on as e from appointments where officer_id is not null and appointed_to.company_name is not null)
    select officer_id, company_name, string_agg(coalesce(s::varchar, 'unknown start') || ' to ' || coalesce(e::varchar, 'unknown end'), '; ' order by s nulls first, e nulls first) as windows,
    count(*) filter (e is null or e >= date '2026-01-01') as n_current, case when count(*) filter (e is null or e >= date '2026-01-01') > 0 then 0 else count(*) end as n_expired from a group by 1, 2"""
)
def service_windows(spark: SparkSession, d: str) -> DataFrame:
    """An officer's windows in a company as text, and how many are current or, with none current, expired."""
    a = table(spark, d, "appointments").select("officer_id", F.col("appointed_to.company_name").alias("company_name"), F.struct(F.col("appointed_on").alias("from_day"), F.col("resigned_on").alias("until_day")).alias("w"))
    g = a.where("officer_id is not null and company_name is not null").groupBy("officer_id", "company_name").agg(F.array_sort(F.collect_set("w")).alias("w"))
    now, past = P.permission_counts(F.transform("w", lambda w: w["until_day"]), AS_OF)
    return g.select("officer_id", "company_name", P.window_text(F.col("w")).alias("windows"), now.cast("bigint").alias("n_current"), past.cast("bigint").alias("n_expired"))


@_query(
    """select company_number, array_to_string(list_sort(list_distinct(list(lower(trim(officer_role))))), ',') as roles, count(distinct officer_row_id) filter (starts_with(lower(officer_role), 'corporate')) as n_corporate,
    count(distinct officer_row_id) filter (resigned_on is null) as n_active from officers where officer_role is not null group by 1"""
)
def role_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "officers").where("officer_role is not null")
    count = lambda c: F.count_distinct(F.when(c, F.col("officer_row_id")))
    return o.groupBy("company_number").agg(
        F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("officer_role")))), ",").alias("roles"),
        count(F.lower("officer_role").startswith("corporate")).alias("n_corporate"), count(F.col("resigned_on").isNull()).alias("n_active"),
    )


@_query(
    """with k as (select query_schema, result_id, row_number() over (partition by query_schema order by result_id) as k from (select distinct query_schema, result_id from sanctions_result where query_schema is not null)),
    s as (select result_id, max(top_score) as top_score, count(*) as n_answers from sanctions_result group by 1)
    select query_schema, 'q' || lpad(k::varchar, greatest(3, length(k::varchar))::int, '0') as query_id, result_id, top_score, n_answers from k join s using (result_id)"""
)
def match_responses(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and the answers to them, by the query's id."""
    r = table(spark, d, "sanctions_result").where("query_schema is not null")
    k = E.running_total(r.select("query_schema", "result_id").distinct(), "query_schema", "result_id", F.lit(1), "before")
    asked = k.select("query_schema", "result_id", F.format_string("q%03d", F.col("before") + 1).alias("query_id"))
    # An answer names its query alone, so its id is looked up by place before the two sides meet.
    answers = r.join(asked, ["query_schema", "result_id"]).groupBy("query_schema", "query_id").agg(F.max("top_score").alias("top_score"), F.count(F.lit(1)).alias("n_answers"))
    return asked.join(answers, ["query_schema", "query_id"]).select("query_schema", "query_id", "result_id", "top_score", "n_answers")


# -- claims

_SAID = """c as (select distinct upper(regexp_replace(company_number, '\\s+', '', 'g')) as company, media_id as ord, case when media_id % 3 = 0 or snippet is null then title else split_part(snippet, '.', 1) end as text, category as source from media_item where company_number is not null and category is not null and title is not null),
    s as (select company, source, string_agg(snippet, chr(10) order by media_id, snippet) as section from (select distinct upper(regexp_replace(company_number, '\\s+', '', 'g')) as company, category as source, media_id, snippet from media_item
    where company_number is not null and category is not null and snippet is not null) group by 1, 2),
    r as (select company, ord, source, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) as claim from (select *, row_number() over (partition by company order by ord, source, text) as k from c) where k <= 25),
    u as (select * from (select *, row_number() over (partition by company, source, claim order by ord) as k from r where claim <> '') where k = 1),"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Titles and beginnings of media items as claims about a company, checked against the snippets of its items of the same category."""
    m = table(spark, d, "media_item").where("company_number is not null and category is not null")
    m = m.select(_bare("company_number").alias("company"), F.col("media_id").alias("ord"), "title", F.col("category").alias("source"), "snippet")
    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "snippet"))), lambda x: x["snippet"]), "\n")
    sections = m.where("snippet is not null").groupBy("company", "source").agg(text.alias("text"))
    said = F.when((F.col("ord") % 3 == 0) | F.col("snippet").isNull(), F.col("title")).otherwise(F.split_part("snippet", F.lit("."), F.lit(1)))
    return C.checked_claims(m.where("title is not null").select("company", "ord", said.alias("text"), "source"), sections)


_STATES = f"""t as (select company, ord, u.source, claim, case when section is null or {_FOLD.format(c='claim')} = '' or not contains({_FOLD.format(c='section')}, {_FOLD.format(c='claim')}) then 'dropped'
    when len(string_split({_FOLD.format(c='claim')}, ' ')) < 2 then 'thin' else 'kept' end as state from u left join s using (company, source))"""


@_query(
    f"""with {_SAID} {_STATES} select *, case when state = 'kept' then printf('CLM-%03d', row_number() over (partition by company, state order by ord, source, claim)) end as claim_id from t"""
)
def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)


@_query(
    f"""with {_SAID} {_STATES} select company, count(*) filter (state = 'kept') as kept, count(*) filter (state = 'dropped') as dropped, count(*) filter (state = 'thin') as dropped_thin from t group by 1"""
)
def claim_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.claim_counts(_checked(spark, d))


_FINDINGS = "f as (select s_suppkey as id, s_name as evidence from supplier union all select s_suppkey, 'nation ' || s_nationkey from supplier where s_suppkey % 2 = 0)"


@_query(
    f"""with a as (select l_orderkey as c, l_returnflag as k, min({{'o': l_linenumber, 'b': [l_suppkey, l_partkey % 200]}}) as a from lineitem group by 1, 2), {_FINDINGS},
    e as (select c, k, unnest(a.b) as id, generate_subscripts(a.b, 1) as pos from a), m as (select * from e left join f using (id))
    select c as "case", k as claim, count(distinct pos) as n_basis, count(*) filter (evidence is null) as n_unknown, coalesce(string_agg(evidence, '; ' order by pos, evidence), '') as evidence from m group by 1, 2"""
)
def basis_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as assessments, whose supplier and part name the findings they rest on."""
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("claim"), F.col("l_linenumber").alias("ord"), F.array("l_suppkey", F.col("l_partkey") % 200).alias("basis"))
    s = table(spark, d, "supplier")
    f = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("evidence")).unionByName(
        s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("evidence"))
    )
    return C.basis_evidence(a, f).withColumn("evidence", F.array_join("evidence", "; "))


@_query(
    """with l as (select l_orderkey, min({'o': l_linenumber, 's': l_linestatus}) as a from lineitem where l_discount > 0.05 group by 1)
    select o_orderkey as "case", o_orderkey as claim, case when o_orderstatus = 'P' then 'not checkable' else coalesce(a.s, 'unverified') end as status, o_orderstatus <> 'P' and a is not null as assessed
    from orders left join l on l_orderkey = o_orderkey"""
)
def claims_backfilled(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("case"), F.col("o_orderkey").alias("claim"), (F.col("o_orderstatus") != "P").alias("checkable"))
    a = table(spark, d, "lineitem").where("l_discount > 0.05").select(
        F.col("l_orderkey").alias("case"), F.col("l_orderkey").alias("claim"), F.struct("l_linenumber", "l_linestatus").alias("ord"), F.col("l_linestatus").alias("status")
    )
    return C.back_filled(claims, a)


@_query(
    f"""select distinct company_number, company_name from company_profile where {_FOLD.format(c='company_name')} in
    (select {_FOLD.format(c='appointed_to.company_name')} from appointments where appointed_to.company_name is not null)"""
)
def reverified_names(spark: SparkSession, d: str) -> DataFrame:
    """Companies whose name stands in the appointments as well."""
    names = table(spark, d, "appointments").select(F.col("appointed_to.company_name").alias("held"))
    return C.reverified(table(spark, d, "company_profile").select("company_number", "company_name").distinct(), names, "company_name", "held")


@_query(
    """with n as (select distinct company_number, company_name, coalesce(list_transform(previous_company_names, lambda x: x.name), []) as old from company_profile)
    select company_number, array_to_string(list_sort(list_distinct(list_filter(list_prepend(company_name, old), lambda x: x is not null and x <> ''))), '; ') as texts from n"""
)
def exemption_texts(spark: SparkSession, d: str) -> DataFrame:
    """The names of a company that prose may hold whatever words they contain, each once."""
    n = table(spark, d, "company_profile").select("company_number", "company_name", F.coalesce(F.transform("previous_company_names", lambda x: x["name"]), F.array().cast("array<string>")).alias("old")).distinct()
    every = F.array_distinct(F.filter(F.concat(F.array("company_name"), "old"), lambda x: x.isNotNull() & (x != "")))
    return n.select("company_number", F.array_join(F.array_sort(every), "; ").alias("texts"))


@_query(
    """select stage, id, n from (select 1 as stage, company_number as id, count(distinct officer_row_id) as n from officers group by 2
    union all select 2, result_id::varchar, count(*) from sanctions_result group by 2 union all select 3, upper(regexp_replace(company_number, '\\s+', '', 'g')), count(distinct media_id) from media_item where company_number is not null group by 2)"""
)
def findings_bag(spark: SparkSession, d: str) -> DataFrame:
    """What the stages found, one after the other, nothing merged."""
    a = table(spark, d, "officers").groupBy(F.col("company_number").alias("id")).agg(F.count_distinct("officer_row_id").alias("n"))
    b = table(spark, d, "sanctions_result").groupBy(F.col("result_id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    m = table(spark, d, "media_item").where("company_number is not null")
    c = m.groupBy(_bare("company_number").alias("id")).agg(F.count_distinct("media_id").alias("n"))
    stages = [df.select(F.lit(i).alias("stage"), "id", "n") for i, df in enumerate((a, b, c), 1)]
    return stages[0].unionByName(stages[1]).unionByName(stages[2])


# -- pages and prose


@_query(
    r"""select doc_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '(<[^>]*>)[\s\p{Z}]+(<[a-zA-Z/])', '\1\2', 'g'), '</?(p|div|br|li|ul|ol|h[1-6])\b[^>]*>', chr(10), 'gi'), '<[a-zA-Z/!][^>]*>', '', 'g'), '\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as page_text from documents"""
)
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """The visible text of every document read as a page."""
    return table(spark, d, "documents").select("doc_id", G.page_text("text").alias("page_text"))


@_query(
    """with l as (select doc_id, regexp_extract_all(text, '<a href="([^"]+)"', 1) as h from documents where text is not null)
    select doc_id, unnest(h) as href, generate_subscripts(h, 1) - 1 as pos, unnest(h) as target from l"""
)
def document_links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.lit("https://site.example/about/us").alias("url"), "text")
    return G.linked_pages(docs, "doc_id", "url", "text")


@_query(
    """with p as (select distinct company_number, page_id, trim(url) as u from site_page where company_number is not null and url is not null),
    e as (select company_number, min(u) as entry from p group by 1),
    x as (select company_number, page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host, regexp_extract(entry, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as own,
    coalesce(nullif(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') as path, coalesce(nullif(regexp_extract(entry, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') as home from p join e using (company_number))
    select company_number, url from (select company_number, scheme || '://' || host || path as url, row_number() over (partition by company_number, path order by page_id) as k from x
    where scheme in ('http', 'https') and lower(host) = lower(own) and path <> home and regexp_matches(lower(path), 'about|company|team')) where k = 1"""
)
def about_pages(spark: SparkSession, d: str) -> DataFrame:
    """Of every site the pages about the company, its first address being the entry."""
    p = table(spark, d, "site_page").where("company_number is not null and url is not null").select("company_number", "page_id", F.trim("url").alias("url")).distinct()
    entry = p.groupBy("company_number").agg(F.min("url").alias("entry"))
    return G.about_pages(p.join(entry, "company_number"), "company_number", "entry", "url", "page_id")


@_query(
    """with l as (select doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]'), lambda x: trim(regexp_replace(x, '[\\s\\x0B\\x{85}\\p{Z}]+', ' ', 'g'))), lambda x: x <> '') as lines
    from documents where source = 'deck_pages' and text is not null)
    select doc_id, len(lines) as n_lines, md5(array_to_string(lines, chr(10))) as cleaned from l"""
)
def deck_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("source = 'deck_pages' and text is not null").select("doc_id", G.clean_lines(F.col("text")).alias("t"))
    return t.select("doc_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("bigint").alias("n_lines"), F.md5("t").alias("cleaned"))


@_query(
    f"""with w as (select doc_id, {_WORDS.format(c=f"replace({_URLS.format(c='text')}, 'a nominee director', ' ')")} as w, replace(lower({_URLS.format(c='text')}), ' ', '  ') as t from documents where text is not null),
    n as (select doc_id, len(list_filter(w, lambda x: list_contains({[t for t in WATCHED if ' ' not in t]}, x))) + len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:con\\s+artist|tax\\s+refund)(?:$|[^\\p{{L}}\\p{{N}}_])')) as n_hits from w)
    select * from n where n_hits > 0"""
)
def open_terms(spark: SparkSession, d: str) -> DataFrame:
    """How many listed terms every document has outside its company's names and one stock quotation."""
    names = table(spark, d, "company_profile").groupBy("company_number").agg(F.min("company_name").alias("company_name"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "company_number").join(names, "company_number", "left")
    quotes = F.filter(F.array(F.col("company_name"), F.lit("a nominee director")), lambda q: q.isNotNull())
    hits = docs.select("doc_id", F.size(W.gate(F.col("text"), quotes, WATCHED)).cast("bigint").alias("n_hits"))
    return hits.where("n_hits > 0")


@_query(
    r"""with t as (select doc_id, text as t, chr(10) || coalesce(text, '') || chr(10) as x from documents where source = 'memo_archive'),
p as (select *, strpos(x, chr(10) || '## Media' || chr(10)) as b from t), q as (select *, case when b > 0 then strpos(substr(x, b + 1), chr(10) || '## ') end as l from p),
r as (select doc_id, t, case when l > 0 then b - 1 end as region_begin, case when l > 0 then b - 1 + l end as region_end from q),
h as (select *, regexp_extract_all(replace(lower(case when region_begin is null then coalesce(t, '') else substr(t, 1, region_begin) || ' ' || replace(substr(t, region_begin + 1, region_end - region_begin), 'nominee director', ' ') || ' ' || substr(t, region_end + 1) end), ' ', '  '), '(?:^|[^\p{L}\p{N}_])(fraud|fraudulent|fraudster|lying|liar|lied|criminal|crime|scam|sham|dishonest|dishonesty|deceit|deceitful|crook|con\s+artist|nominee|tax\s+refund)(?:$|[^\p{L}\p{N}_])', 1) as h from r)
select doc_id, region_begin, region_end, array_to_string(list_transform(h, lambda x: regexp_replace(x, '\s+', ' ', 'g')), ',') as hits from h"""
)
def memo_regions(spark: SparkSession, d: str) -> DataFrame:
    """Where a memo's section on media stands, and the listed terms outside its quotations."""
    docs = table(spark, d, "documents").where("source = 'memo_archive'").select("doc_id", "text")
    quotes, none = F.array(F.lit("nominee director")), F.array().cast("array<string>")
    g = docs.select("doc_id", W.memo_gate(F.col("text"), quotes, none, "## Media", ("",), WATCHED).alias("g"))
    return g.select("doc_id", "g.region_begin", "g.region_end", F.array_join("g.hits", ",").alias("hits"))


_VERBS = "operated?s?|operating|traded?s?|trading|started|starting|founded|established|incorporated|formed|launched|launching|began|begun"
#: A verb that a denial stands shortly before is struck out.
_STRUCK = "regexp_replace({c}, '((?:^|[^\\p{{L}}\\p{{N}}_])(?:not|never|no longer|stopped|ceased|without)[^\\p{{L}}\\p{{N}}_](?:.{{0,40}}?[^\\p{{L}}\\p{{N}}_])?)(?:" + _VERBS + ")([^\\p{{L}}\\p{{N}}_])', '\\1-\\2', 'g')"
_ORIGINS = f"""t as (select doc_id, company_number, {_STRUCK.format(c=_STRUCK.format(c=_FOLD.format(c='text')))} as t from documents where text is not null),
    y as (select doc_id, company_number, list_sort(list_distinct(list_filter(list_transform(list_concat(
    regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:operat(?:e[ds]?|ing)|trad(?:e[ds]?|ing)|start(?:ed|ing))(?: operations)? (?:since|from) (?:(?:\\d{{1,2}} )?[a-z]{{3,9}} )?(\\d{{4}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1),
    regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:founded|established|incorporated|formed|launched|launching|began|begun)(?: operations| trading)?(?: in| on)? (?:(?:\\d{{1,2}} )?[a-z]{{3,9}} )?(\\d{{4}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1),
    regexp_extract_all(t, '^since (?:(?:\\d{{1,2}} )?[a-z]{{3,9}} )?(\\d{{4}})', 1)), lambda x: x::int), lambda x: x between 1800 and 2099))) as years from t)"""


@_query(f"with {_ORIGINS} select doc_id, array_to_string(years, ',') as years from y where len(years) > 0")
def origin_years(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", W.origin_years(F.col("text")).alias("y")).where(F.size("y") > 0).select("doc_id", F.array_join("y", ",").alias("years"))


@_query(
    f"""with {_ORIGINS}, c as (select company_number, min(date_of_creation) as c from company_profile where date_of_creation is not null group by 1)
    select doc_id, list_min(list_filter(years, lambda x: x < year(c))) as claimed_year, c::varchar as incorporated_on from y join c using (company_number) where len(list_filter(years, lambda x: x < year(c))) > 0"""
)
def origin_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that give their company an origin before its incorporation: the earliest such year."""
    docs = settle(table(spark, d, "documents").where("text is not null").select("doc_id", "company_number", "text"), years=W.origin_years(F.col("text")))
    y = docs.select("doc_id", "company_number", F.explode("years").alias("y"))
    c = table(spark, d, "company_profile").where("date_of_creation is not null").groupBy("company_number").agg(F.min("date_of_creation").alias("c"))
    early = y.join(c, "company_number").where(F.col("y") < F.year("c"))
    return early.groupBy("doc_id", "c").agg(F.min("y").alias("claimed_year")).select("doc_id", "claimed_year", F.col("c").cast("string").alias("incorporated_on"))


@_query(
    """with p as (select distinct company_number, page_id, 'site ' || coalesce(nullif(path, ''), '/') as label, text from site_page where text is not null and text <> '' and company_number is not null)
    select company_number, label, md5(string_agg(text, chr(10) order by page_id, text)) as section from p group by 1, 2"""
)
def section_texts(spark: SparkSession, d: str) -> DataFrame:
    """A site's sections by label, pages of one label joined in order."""
    p = table(spark, d, "site_page").where("text is not null and text <> '' and company_number is not null")
    p = p.select("company_number", F.concat(F.lit("site "), F.coalesce(F.nullif("path", F.lit("")), F.lit("/"))).alias("label"), F.col("page_id").alias("ord"), "text")
    return S.sections(p, "company_number").select("company_number", "label", F.md5("text").alias("section"))


# -- forms


@_query(
    """select distinct media_id, case when regexp_full_match(trim(company_number), '[A-Za-z0-9]{1,10}') then lower(trim(company_number)) end as valid_number, replace(title, '|', '\\|') as cell,
    case when regexp_full_match(trim(published), '\\d{4}-\\d{2}-\\d{2}') then try_cast(trim(published) as date)::varchar end as published_on, regexp_replace(regexp_replace(trim(coalesce(snippet, '')), '^```[a-zA-Z]*\\s*', ''), '\\s*```$', '') as plain,
    coalesce(nullif(snippet, ''), nullif(title, '')) as content from media_item"""
)
def plain_forms(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that may name a folder, cells with their bars escaped, ISO days, text without a fence, and the first text that isn't empty."""
    return table(spark, d, "media_item").select(
        "media_id", X.folder_number(F.col("company_number")).alias("valid_number"), X.escape_bars(F.col("title")).alias("cell"), P.iso_date(F.col("published")).cast("string").alias("published_on"),
        X.without_fence(F.coalesce("snippet", F.lit(""))).alias("plain"), L.first_of(F.col("snippet"), F.col("title")).alias("content"),
    ).distinct()


@_query(
    """select distinct fetch_id, '{' || coalesce(array_to_string(list_sort(list_transform(map_entries(params), lambda e: '"' || e.key || '":"' || coalesce(e.value, '') || '"')), ','), '') || '}' as params from fetch_record where params is not null"""
)
def canonical_params(spark: SparkSession, d: str) -> DataFrame:
    """A fetch's parameters as JSON that doesn't depend on their order."""
    return table(spark, d, "fetch_record").where("params is not null").select("fetch_id", X.canonical_json(F.col("params")).alias("params")).distinct()


@_query(
    """select doc_id, regexp_extract(text, 'Page (\\d+)', 1) as marker, regexp_extract(text, '(?:^|\\n)## ([^\\n]+)', 1) as first_heading from documents where text is not null and regexp_matches(text, 'Page \\d+|(?:^|\\n)## ')"""
)
def markers(spark: SparkSession, d: str) -> DataFrame:
    """What stands behind a marker in a text: a page's number, a version, a heading."""
    t = table(spark, d, "documents").where("text is not null").where(F.col("text").rlike(r"Page \d+|(?:^|\n)## "))
    return t.select("doc_id", X.marked(F.col("text"), r"Page (\d+)").alias("marker"), X.marked(F.col("text"), r"(?:^|\n)## ([^\n]+)").alias("first_heading"))
