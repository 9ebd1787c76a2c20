"""Listings read page by page: what a walk over them would retrieve, and why it stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def item_key(code: Column, item: Column) -> Column:
    """An item's own code, or the whole item as JSON where it has none."""
    return F.coalesce(F.nullif(code, F.lit("")), F.to_json(item))


def walk_pages(pages: DataFrame, max_pages: int, per_page: int, keyed: bool, stop_without_total: bool = False) -> DataFrame:
    """(resource, page from 1, total, items ARRAY<STRING>) -> one row per resource: how reading it ends.

    items are keys of the page's elements in order, null for an element that is
    no object: it counts as received, but isn't retrieved. total is what the page
    says, or null; the last one seen holds. keyed: items count once by key, and a
    later page without a new one ends the walk. The walk also ends on an empty
    page, when as many as the total are there, and, if stop_without_total, when
    no page has told one. Columns: resource, pages_read, received, retrieved,
    total, truncated, hit_page_cap, server_clamped, did_not_advance, cause.
    What is shuffled by resource are keys and counts, and windows run over at
    most max_pages rows of one resource.
    """
    read = pages.where(F.col("page").between(1, max_pages))
    items = read.select("resource", "page", F.explode("items").alias("key")).where("key is not null")
    if keyed:
        new = items.groupBy("resource", "key").agg(F.min("page").alias("page")).groupBy("resource", "page").agg(F.count(F.lit(1)).alias("new"))
    else:
        new = items.groupBy("resource", "page").agg(F.count(F.lit(1)).alias("new"))
    said = read.groupBy("resource", "page").agg(F.max("total").alias("said"), F.max(F.size("items")).alias("received"))
    upto = Window.partitionBy("resource").orderBy("page")
    so_far = said.join(new, ["resource", "page"], "left").withColumns({"new": F.coalesce("new", F.lit(0)), "total": F.last("said", True).over(upto)})
    so_far = so_far.withColumn("retrieved", F.sum("new").over(upto))
    stuck = (F.col("page") > 1) & (F.col("new") == 0) if keyed else F.lit(False)
    stops = stuck | (F.col("received") == 0) | F.coalesce(F.col("retrieved") >= F.col("total"), F.lit(False))
    if stop_without_total:
        stops = stops | F.col("total").isNull()
    ended = so_far.withColumns({"stuck": stuck, "stops": stops}).withColumn("earlier", F.coalesce(F.max("stops").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    done = ended.where(~F.col("earlier")).groupBy("resource").agg(
        F.count(F.lit(1)).alias("pages_read"), F.sum("received").alias("received"), F.max("retrieved").alias("retrieved"), F.max_by("total", "page").alias("total"),
        F.bool_or("stops").alias("stopped"), F.bool_or("stuck").alias("did_not_advance"), F.bool_or(~F.col("stops") & (F.col("received") < per_page)).alias("server_clamped"),
    )
    truncated = F.coalesce(F.col("retrieved") < F.col("total"), F.lit(False))
    capped = truncated & ~F.col("stopped")
    cause = F.when(~truncated, "complete").when(capped, "page cap").when(F.col("did_not_advance"), "no advance").otherwise("early end")
    return done.select(
        "resource", "pages_read", "received", "retrieved", "total", truncated.alias("truncated"), capped.alias("hit_page_cap"), "server_clamped", "did_not_advance", cause.alias("cause")
    )
