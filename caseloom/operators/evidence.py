"""Relational operators over the registry's evidence tables.

Every operator takes and gives DataFrames, declares its columns, and takes its
reference day as a parameter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions import text as X


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest order; of equals, the greatest row. Nulls sort first. Aggregates before it shuffles."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_v"))
    return best.select(key, F.col(f"_v.{order}").alias(order), *(F.col(f"_v.{c}").alias(c) for c in rest))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each combination of keys in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each combination of keys; each partition keeps only n per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def unique_names(df: DataFrame, base: str, order: str, out: str) -> DataFrame:
    """base, base-2, base-3 ... in order, one name per row, no name twice.

    A base that itself ends in a number may be what another one becomes; only
    bases of which that is true are named one after the other, as many together
    as have the same beginning, all others by their rank.
    """
    k = F.row_number().over(Window.partitionBy(base).orderBy(order))
    ranked = F.when(k == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), k.cast("string")))
    root = F.regexp_replace(base, r"(-\d+)+$", "")
    marked = df.withColumn("_root", root)
    clash = marked.groupBy("_root").agg(F.count_distinct(base).alias("_n")).where("_n > 1").select("_root")
    schema = df.schema.add(out, "string")

    def one_by_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_root").sort_values([order, base]).reset_index(drop=True)
        taken: set[str] = set()
        following: dict[str, int] = {}
        names = []
        for b in pdf[base]:
            n, name = following.get(b, 2), b
            while name in taken:
                name, n = f"{b}-{n}", n + 1
            following[b] = n
            taken.add(name)
            names.append(name)
        return pdf.assign(**{out: names})

    alone = marked.join(clash, "_root", "left_anti").drop("_root").withColumn(out, ranked)
    return alone.unionByName(marked.join(clash, "_root", "left_semi").groupBy("_root").applyInPandas(one_by_one, schema))


def running_total(df: DataFrame, group: str, key: str, size: Column, out: str, width: int = 1_000) -> DataFrame:
    """Sum of size over the group's rows of a smaller integer key, in two levels.

    Blocks of width keys are summed first, so a group that holds most rows is
    spread over its blocks: no task gets more than one block of rows. Null keys
    and groups are left out; rows of one key come in no fixed order.
    """
    blocked = df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).withColumns({"_size": size, "_block": F.floor(F.col(key) / width)})
    sums = blocked.groupBy(group, "_block").agg(F.sum("_size").alias("_sum"))
    over = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(group, "_block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return blocked.join(before, [group, "_block"]).withColumn(out, total).drop("_size", "_block", "_before")


def resolve_titles(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query) x (title, company_number) -> query, outcome, company_number, n_candidates.

    A query shaped like a number is direct. Else candidates are the rows of
    equal title: one is single, more than one ambiguous, none empty.
    """
    asked = queries.select("query").distinct().withColumns({"number": X.company_number(F.col("query")), "k": X.title_key(F.col("query"))})
    titles = candidates.select(X.title_key(F.col("title")).alias("k"), "company_number").distinct()
    held = titles.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("company_number").alias("only"))
    j = asked.join(held, "k", "left")
    n = F.coalesce("n", F.lit(0))
    outcome = F.when(F.col("number").isNotNull(), "number").when(n == 0, "empty").when(n == 1, "single").otherwise("ambiguous")
    number = F.when(F.col("number").isNotNull(), F.col("number")).when(n == 1, F.col("only"))
    return j.select("query", outcome.alias("outcome"), number.alias("company_number"), n.alias("n_candidates"))


def resolve_hits(hits: DataFrame) -> DataFrame:
    """(query, title, company_number), title null for a query without a hit -> query, outcome, company_number, n_candidates, set_aside.

    A query shaped like a number is direct. A lone candidate is taken whatever
    its title; of several, the only one of the same title, the others being set
    aside. Repeated candidates count once.
    """
    h = hits.distinct().withColumn("exact", X.title_key(F.col("title")) == X.title_key(F.col("query")))
    g = h.groupBy("query").agg(
        F.count("company_number").alias("n"), F.count_if("exact").alias("n_exact"), F.min("company_number").alias("only"), F.min(F.when(F.col("exact"), F.col("company_number"))).alias("same")
    )
    number, n = X.company_number(F.col("query")), F.col("n")
    outcome = F.when(number.isNotNull(), "number").when(n == 0, "empty").when(n == 1, "single").when(F.col("n_exact") == 1, "exact").otherwise("ambiguous")
    taken = F.when(number.isNotNull(), number).when(n == 1, F.col("only")).when(F.col("n_exact") == 1, F.col("same"))
    aside = F.when(number.isNull() & (n > 1) & (F.col("n_exact") == 1), n - 1).otherwise(0)
    return g.select("query", outcome.alias("outcome"), taken.alias("company_number"), n.alias("n_candidates"), aside.cast("bigint").alias("set_aside"))


def current_elsewhere(officers: DataFrame, appointments: DataFrame) -> DataFrame:
    """Current appointments, in other companies, of a company's current officers: company_number, officer_row_id, name, other_number, other_name."""
    now = officers.where("resigned_on is null").select("company_number", "officer_row_id", "name", X.officer_id(F.col("links.officer.appointments")).alias("officer_id")).distinct()
    held = appointments.where("resigned_on is null").select(
        "officer_id", X.company_number(F.col("appointed_to.company_number")).alias("other_number"), F.col("appointed_to.company_name").alias("other_name")
    ).where("other_number is not null").distinct()
    return now.join(held, "officer_id").where("other_number <> company_number").select("company_number", "officer_row_id", "name", "other_number", "other_name")


def shared_companies(elsewhere: DataFrame) -> DataFrame:
    """Other companies in which at least two differently named officers of one company sit; the holders sorted."""
    g = elsewhere.groupBy("company_number", "other_number").agg(F.array_sort(F.collect_set("name")).alias("h"), F.min("other_name").alias("other_name"))
    return g.where(F.size("h") >= 2).select("company_number", "other_number", "other_name", F.array_join("h", "; ").alias("holders"), F.size("h").alias("n_holders"))


def appointment_fanout(officers: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """Per current officer, how many other companies as displayed; officers without any are kept with 0."""
    shown = elsewhere.select("officer_row_id", F.concat(F.coalesce(X.blank_to_null(F.col("other_name")), F.lit("unnamed company")), F.lit(" ("), "other_number", F.lit(")")).alias("shown"))
    n = shown.distinct().groupBy("officer_row_id").agg(F.count(F.lit(1)).alias("n_other"))
    now = officers.where("resigned_on is null").select("officer_row_id", "company_number").distinct()
    return now.join(n, "officer_row_id", "left").select("officer_row_id", "company_number", F.coalesce("n_other", F.lit(0)).alias("n_other"))


def match_tier(same_date: Column, active: Column) -> Column:
    """Three-valued: strong_active or strong_past where the dates agree, mismatch where they differ, name_only where one is unknown."""
    return F.when(same_date & active, "strong_active").when(same_date, "strong_past").when(~same_date, "mismatch").otherwise("name_only")


def paged(df: DataFrame, group: str, key: str, per_page: int, cap: int) -> DataFrame:
    """How reading each group by pages would end: total, pages, retrieved, truncated."""
    n = df.groupBy(group).agg(F.count_distinct(key).alias("total"))
    pages = F.ceil(F.col("total") / per_page)
    got = F.least(F.col("total"), F.lit(per_page * cap).cast("bigint"))
    return n.select(group, "total", pages.cast("bigint").alias("pages"), got.alias("retrieved"), (got < F.col("total")).alias("truncated"))
