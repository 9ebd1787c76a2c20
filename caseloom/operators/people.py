"""People of a company: who is the same person, who is to be screened, and what a disqualification record says of one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions import text as X


def merge_owners(owners: DataFrame, officers: DataFrame) -> DataFrame:
    """owners (owner_id, company_number, name, year, month), officers (officer_row_id, company_number, name, year, month) -> owners with merged_officer.

    One person is an owner and an officer of one company with the same words in
    the name and equal, present month and year of birth: the first such officer.
    merged_officer is null for an owner that is no officer. Repeated rows count once.
    """
    named = lambda df: df.withColumn("tokens", X.name_tokens(F.col("name")))
    first = named(officers).where("month is not null and year is not null").groupBy("company_number", "tokens", "month", "year").agg(F.min("officer_row_id").alias("merged_officer"))
    return named(owners.distinct()).join(first, ["company_number", "tokens", "month", "year"], "left").select(*owners.columns, "merged_officer")


def screening_subjects(companies: DataFrame, officers: DataFrame, owners: DataFrame) -> DataFrame:
    """(company_number, ord, query_id, kind, name, birth): the company, its current officers, then its owners that are no officers; numbered in that order.

    companies (company_number, name), officers as in merge_owners, current ones
    only, owners merged by merge_owners. An officer who is an owner too is 'officer and psc'.
    """
    both = owners.where("merged_officer is not null").select(F.col("merged_officer").alias("officer_row_id")).distinct().withColumn("owns", F.lit(True))
    none = F.lit(None).cast("string")
    a = companies.select("company_number", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("own"), F.lit("company").alias("kind"), "name", none.alias("birth")).distinct()
    birth = X.birth_text(F.col("year"), F.col("month")).alias("birth")
    kind = F.when(F.col("owns"), "officer and psc").otherwise("officer").alias("kind")
    b = officers.join(both, "officer_row_id", "left").select("company_number", F.lit(1).alias("rank"), F.col("officer_row_id").alias("own"), kind, "name", birth).distinct()
    c = owners.where("merged_officer is null and name is not null").select("company_number", F.lit(2).alias("rank"), F.col("owner_id").alias("own"), F.lit("psc").alias("kind"), "name", birth).distinct()
    k = F.row_number().over(Window.partitionBy("company_number").orderBy("rank", "own", "name"))
    every = a.unionByName(b).unionByName(c).withColumn("ord", k.cast("bigint"))
    return every.select("company_number", "ord", F.format_string("q%03d", "ord").alias("query_id"), "kind", "name", "birth")


def iso_date(c: Column) -> Column:
    """A date written YYYY-MM-DD that exists; null for anything else."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))


def window_text(windows: Column) -> Column:
    """ARRAY<STRUCT<from_day DATE, until_day DATE>> as 'from to until; ...'."""
    day = lambda c, none: F.coalesce(c.cast("string"), F.lit(none))
    return F.array_join(F.transform(windows, lambda w: F.concat(day(w["from_day"], "unknown start"), F.lit(" to "), day(w["until_day"], "unknown end"))), "; ")


def permission_counts(permissions: Column, as_of: dt.date) -> tuple[Column, Column]:
    """(current, expired) permissions of an ARRAY<DATE> of expiry dates, null standing for no end; expired ones count only where none is current."""
    current = F.size(F.filter(permissions, lambda p: p.isNull() | (p >= F.lit(as_of))))
    return current, F.when(current > 0, 0).otherwise(F.greatest(F.size(permissions), F.lit(0)))


def disqualification_tiers(people: DataFrame, hits: DataFrame, details: DataFrame, as_of: dt.date, most: int = 5) -> DataFrame:
    """What the disqualification register says of each person: person_id, n_candidates, n_followed, tier, link.

    people (person_id, name, corporate, year, month, number); hits (name_tokens,
    title order ord, link); details (link, name, birth_date DATE, number, until
    ARRAY<DATE>). Candidates are the hits of the same words; of the first `most`
    of them those are followed whose link says that they are of the person's
    kind. tier: strong_active, strong_expired, name_only, mismatch, the best of
    the records, the first of equals; none without a record that fits.
    """
    asked = people.withColumn("tokens", X.name_tokens(F.col("name")))
    candidates = asked.select("person_id", "tokens", "corporate").join(hits.select(F.col("name_tokens").alias("tokens"), "ord", "link"), "tokens")
    k = F.row_number().over(Window.partitionBy("person_id").orderBy("ord", "link"))
    n = candidates.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    company, natural = F.col("link").contains("/corporate/"), F.col("link").contains("/natural/")
    followed = candidates.withColumn("k", k).where(F.col("k") <= most).where((company != natural) & (company == F.col("corporate")))
    known = details.select("link", X.name_tokens(F.col("name")).alias("held"), "birth_date", F.col("number").alias("held_number"), "until")
    met = followed.join(asked.select("person_id", "year", "month", "number"), "person_id").join(known, "link")
    born = (F.month("birth_date") == F.col("month")) & (F.year("birth_date") == F.col("year"))
    numbered = F.upper(F.trim("number")) == F.upper(F.trim("held_number"))
    same = F.when(F.col("corporate"), F.when((F.trim("number") != "") & (F.trim("held_number") != ""), numbered)).otherwise(born)
    dated = F.filter("until", lambda d: d.isNotNull())
    strong = F.when(F.exists(dated, lambda d: d >= F.lit(as_of)), 4).when(F.size(dated) > 0, 3).otherwise(2)
    rank = F.when(same, strong).when(~same, 1).otherwise(2)
    ranked = met.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_followed"), F.max(F.when(F.col("held") == F.col("tokens"), F.struct(rank.alias("rank"), (-F.col("k")).alias("first"), F.col("link")))).alias("best")
    )
    name = F.when(F.col("best.rank") == 4, "strong_active").when(F.col("best.rank") == 3, "strong_expired").when(F.col("best.rank") == 2, "name_only").when(F.col("best.rank") == 1, "mismatch").otherwise("none")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return people.select("person_id").distinct().join(n, "person_id", "left").join(ranked, "person_id", "left").select("person_id", zero("n_candidates"), zero("n_followed"), name.alias("tier"), F.col("best.link").alias("link"))
