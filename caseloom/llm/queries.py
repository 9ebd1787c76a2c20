"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.matching import matches
from caseloom.llm.mixing import marginals, mix, shares
from caseloom.llm.pagebody import body_lines
from caseloom.llm.places import places, same_place
from caseloom.llm.stuffed import stuffed_pages
from caseloom.llm.tokens import token_ids
from caseloom.llm.variants import name_members, name_variants
from caseloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return body_lines(table(spark, d, "site_page"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return same_place(table(spark, d, "company_profile"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return matches(table(spark, d, "officers"), table(spark, d, "sanctions_result")).select("officer_row_id", "result_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants(table(spark, d, "officers"), table(spark, d, "appointments"))


def p2_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of every company with an address: as many rows as companies."""
    return places(table(spark, d, "company_profile"))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of every entry's name and of every appointment's company name."""
    return name_members(table(spark, d, "officers"), table(spark, d, "appointments"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, and how often each is taken."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source should have, and has, in the mix."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_target")
    return shares(mix(documents, targets), documents, targets)


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the mix by source, language and topic, as raked and as taken."""
    return marginals(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matched rows with the marginal probability of the match, to four places."""
    found = matches(table(spark, d, "officers"), table(spark, d, "sanctions_result"))
    return found.select("officer_row_id", "result_id", F.round("confidence", 4).alias("confidence"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p2_places": p2_places, "p5_found": p5_found, "p5_members": p5_members, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_marginals": p9_marginals, "p3_matches": p3_matches, "p10_found": p10_found}
#: Stuffed pages by the database's own expressions: other words, links and shapes than the operator's, the same pages.
_STUFFED = r"""with l as (select doc_id, unnest(string_split_regex(text, '[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]+')) as l from documents where text is not null),
s as (select doc_id, trim(unnest(string_split(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(l, '[\s\p{Z}]+', ' ', 'g')), '([\p{L}\p{N}%)\]"”’»]{2}[.?…]+["”’»)]*) ', '\1' || chr(10), 'g'), '(!) (\p{Lu})', '\1' || chr(10) || '\2', 'g'), '([。！？।])', '\1' || chr(10), 'g'), chr(10)))) as s from l),
w as (select doc_id, s, list_filter(string_split_regex(lower(s), '[^\p{L}\p{M}\p{N}@_]+'), lambda x: x <> '') as w, len(list_filter(string_split(s, ' '), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) as n,
  len(regexp_extract_all(s, '(?i)https?://|www\.')) + len(list_filter(string_split(s, ' '), lambda x: regexp_matches(x, '^[^\p{L}\p{N}]*[\p{L}\p{N}@-]{2,}(\.[\p{L}\p{N}@-]{2,})+[^\p{L}\p{N}]*$') and regexp_matches(x, '\p{L}{2}'))) as links,
  len(regexp_extract_all(s, '\p{N}{4}-\p{N}{2}-\p{N}{2}|\p{N}{1,2}[./]\p{N}{1,2}[./]\p{N}{4}|\p{N}{1,2}\.? \p{L}{3,10} \p{N}{4}')) as dates, len(regexp_extract_all(s, '[£$€¥] ?\p{N}')) as prices, len(regexp_extract_all(s, '[A-Z]{2,4}\p{N}{2,}|\p{N}{5,}')) as codes,
  length(s) - length(translate(s, '|/;,•·»›#=~>', '')) as seps, length(s) - length(replace(s, '#', '')) as tags, regexp_matches(s, '[.?…:;。！？।]["”’»)]*$') as ends, regexp_matches(s, '!["”’»)]*$') as calls from s where s <> ''),
p as (select *, len(w) - 1 - len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as again from w),
q as (select *, case when calls then again <= 0 else ends end and n between 3 and 70 and seps < 0.35 * n and again < 0.25 * len(w) as prose from p),
k as (select *, case when regexp_matches(s, '^(\[\d+\]|\(\d+\)|\d+[.)]|\^\d+) ?(https?://|www\.)') then 'fact' when links > 0 and not (prose and n > 12 * links) then 'link' when not prose and dates > 0 then 'fact' when not prose and prices > 0 and codes > 0 then 'product'
  when not prose and codes >= 0.25 * n then 'fact' when prose then 'sentence' when tags >= 3 and tags >= 0.3 * n or n >= 8 and (seps >= 0.2 * n or len(list_distinct(w)) < 0.8 * len(w)) or n >= 25 or n >= 5 and length(s) >= 13 * n then 'keyword' else 'heading' end as kind,
  regexp_replace(regexp_replace(regexp_replace(s, '(\p{Lu}[\p{L}\p{M}\p{N}''’_@-]* ?)+', 'W', 'g'), '\p{N}[\p{N}.,:%/-]*', '9', 'g'), '\p{Ll}[\p{L}\p{M}\p{N}''’_@-]*', 'w', 'g') as shape from q),
g as (select doc_id, kind, case when kind = 'sentence' then shape else '' end as shape, count(*) as n, sum(length(s)) as chars, count(*) filter (again > 0) as again from k group by all),
d as (select doc_id, sum(chars) as chars, sum(chars) filter (kind in ('link', 'product', 'keyword')) as listed, sum(chars) filter (kind = 'sentence' and n >= 3) as letters,
  coalesce(sum(again) filter (kind = 'sentence' and n >= 3) >= 0.3 * sum(n) filter (kind = 'sentence' and n >= 3), false) as phrased from g group by 1)
select doc_id from d where coalesce(listed, 0) + case when phrased then coalesce(letters, 0) else 0 end > 0.5 * chars"""
#: The others can't be put into SQL over whole tables; tests hold them against libraries, brute force or held-out rows.
ORACLES: dict[str, str] = {"p10_found": _STUFFED}
