"""Claims against the text they quote, the findings they rest on, and the evidence they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions import text as X


def checked_claims(claims: DataFrame, sections: DataFrame, most: int = 25) -> DataFrame:
    """claims (company, ord, text, source), sections (company, source, text) -> (company, ord, source, claim, state, claim_id).

    The first `most` claims of a company are read. Blank ones have no row, an
    exact repeat of text and source neither. state: kept, dropped where the
    section of that source doesn't contain the claim (case, quotes, dashes and
    blanks apart), thin where it is one word. Kept ones are numbered in order.
    The join is by company and source; containment is tested on what meets.
    """
    own = Window.partitionBy("company")
    first = Window.partitionBy("company", "source", "claim").orderBy("ord")
    read = claims.distinct().withColumn("k", F.row_number().over(own.orderBy("ord", "source", "text"))).where(F.col("k") <= most)
    read = read.select("company", "ord", "source", X.collapse_space(F.col("text")).alias("claim")).where("claim <> ''")
    read = read.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("folded", X.fold_for_match(F.col("claim")))
    # A section is folded once, before it meets its claims.
    held = sections.select("company", "source", X.fold_for_match(F.col("text")).alias("section"))
    met = read.join(held, ["company", "source"], "left")
    inside = F.coalesce((F.col("folded") != "") & F.contains("section", "folded"), F.lit(False))
    state = F.when(~inside, "dropped").when(F.size(F.split("folded", " ")) < 2, "thin").otherwise("kept")
    out = met.select("company", "ord", "source", "claim", state.alias("state"))
    k = F.row_number().over(Window.partitionBy("company", "state").orderBy("ord", "source", "claim"))
    return out.withColumn("claim_id", F.when(F.col("state") == "kept", F.format_string("CLM-%03d", k)))


def claim_counts(checked: DataFrame) -> DataFrame:
    """How many claims of each company were kept, dropped, and dropped as thin."""
    of = lambda s: F.count_if(F.col("state") == s)
    return checked.groupBy("company").agg(of("kept").alias("kept"), of("dropped").alias("dropped"), of("thin").alias("dropped_thin"))


def basis_evidence(assessments: DataFrame, findings: DataFrame) -> DataFrame:
    """assessments (case, claim, ord, basis ARRAY<id>), findings (id, evidence STRING) -> (case, claim, n_basis, n_unknown, evidence ARRAY<STRING>).

    Of several assessments of a claim the first holds. Evidence comes in the
    order of the basis; an id that several findings bear gives all of them, an
    unknown one none.
    """
    first = assessments.groupBy("case", "claim").agg(F.min(F.struct("ord", "basis")).alias("a")).select("case", "claim", F.col("a.basis").alias("basis"))
    asked = first.select("case", "claim", F.posexplode_outer("basis").alias("pos", "id"))
    met = asked.join(findings.select("id", "evidence"), "id", "left")
    held = F.collect_list(F.when(F.col("evidence").isNotNull(), F.struct("pos", "evidence")))
    return met.groupBy("case", "claim").agg(
        F.count_distinct(F.when(F.col("id").isNotNull(), F.col("pos"))).alias("n_basis"),
        F.count_if(F.col("id").isNotNull() & F.col("evidence").isNull()).alias("n_unknown"),
        F.transform(F.array_sort(held), lambda x: x["evidence"]).alias("evidence"),
    )


def back_filled(claims: DataFrame, assessments: DataFrame) -> DataFrame:
    """claims (case, claim, checkable), assessments (case, claim, ord, status) -> (case, claim, status, assessed): every claim, in its first assessment's status.

    A checkable claim without one is 'unverified', another 'not checkable'.
    """
    first = assessments.groupBy("case", "claim").agg(F.min_by("status", "ord").alias("given"))
    status = F.when(~F.col("checkable"), "not checkable").otherwise(F.coalesce("given", F.lit("unverified")))
    return claims.distinct().join(first, ["case", "claim"], "left").select("case", "claim", status.alias("status"), (F.col("checkable") & F.col("given").isNotNull()).alias("assessed"))


def reverified(texts: DataFrame, evidence: DataFrame, text: str, held: str) -> DataFrame:
    """The rows of texts whose text stands in the evidence as well, case, quotes, dashes and blanks apart."""
    known = evidence.select(X.fold_for_match(F.col(held)).alias("_k")).where("_k <> ''").distinct()
    return texts.withColumn("_k", X.fold_for_match(F.col(text))).join(known, "_k", "left_semi").drop("_k")
