"""Companies at one place, whose addresses are written differently.

Addresses are taken apart; then rewrites are mined from addresses that agree
elsewhere: of two values of one slot (street, town, postcode, kind of street,
word before a unit's number) that stand with the same anchor (the other parts),
the rarer becomes a rewrite of the more frequent if that is statistically
significant, by a log likelihood ratio of how often they meet and by how
unlikely their likeness is. All addresses are normalised again with the rewrites
and rematched, until no new rewrite appears. Parts that an address lacks are
then filled from the addresses of its postcode, or of its street and town.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.addressparts import BUILDINGS, STREET_TYPES, UNIT_WORDS, parts_of
from caseloom.llm.names import is_short_for, osa
from caseloom.llm.spread import spread
from caseloom.session import cut

#: Least evidence, in nats, for a rewrite; least share of a value's meetings that are with its normal form.
EVIDENCE, SHARE = 6.0, 0.5
#: Rewrites of words for kinds of street and of units that one round takes up, the best supported; the others have their turn in the next rounds.
WORD_REWRITES = 5_000
_FULL_WORDS = sorted(STREET_TYPES | UNIT_WORDS)
_PARTS = ("number", "unit", "postcode", "street", "kind", "town", "pair", "before_1", "before_2")
_STRUCT = T.StructType([T.StructField(p, T.StringType()) for p in _PARTS])


def company_addresses(profiles: DataFrame) -> DataFrame:
    """company_number and the lines of its address, of the version retrieved last."""
    a = "registered_office_address"
    lines = F.struct("retrieved_at", F.col(f"{a}.address_line_1").alias("l1"), F.col(f"{a}.address_line_2").alias("l2"), F.col(f"{a}.locality").alias("loc"), F.col(f"{a}.postal_code").alias("pc"))
    latest = profiles.where("company_number is not null").groupBy("company_number").agg(F.max(lines).alias("v"))
    return latest.select("company_number", "v.l1", "v.l2", "v.loc", "v.pc")


def take_apart(lines: DataFrame, rewrites: dict[str, str]) -> DataFrame:
    """lines (id, l1, l2, loc, pc) -> id and the parts; addresses without text are left out."""

    @F.pandas_udf(_STRUCT)
    def parse(l1: pd.Series, l2: pd.Series, loc: pd.Series, pc: pd.Series) -> pd.DataFrame:
        none = (None,) * len(_PARTS)
        return pd.DataFrame([parts_of(*x, rewrites) or none for x in zip(l1, l2, loc, pc, strict=True)], columns=list(_PARTS))

    return lines.select("id", parse("l1", "l2", "loc", "pc").alias("p")).select("id", "p.*").where("number is not null")


@F.pandas_udf(T.DoubleType())
def _unlikeness(slot: pd.Series, rare: pd.Series, frequent: pd.Series) -> pd.Series:
    """Nats against two different values being as alike as these by chance; 0 if they aren't alike."""

    def one(s: str, a: str, b: str) -> float:
        edits = osa(a, b, 2)
        short = min(len(a), len(b))
        if s == "postcode":
            return 8.0 if edits == 1 and len(a) == len(b) else 0.0
        if edits == 1 and short >= 4:
            return 8.0
        if edits == 2 and short >= 7:
            return 6.0
        return 4.0 if s in ("kind", "unit_word") and (is_short_for(a, b) or (len(a) == 1 and b[0] == a)) else 0.0

    return pd.Series([one(*x) for x in zip(slot, rare, frequent, strict=True)], dtype="float64")


_unlikeness = _unlikeness.asNondeterministic()


def slot_values(parts: DataFrame) -> DataFrame:
    """(slot, anchor, value) of every address: each part beside the other parts that pin it down."""
    slots = (
        ("street", "postcode <> '' and number <> ''", "'s1', postcode, number", "street"),
        ("street", "town <> '' and number <> '' and kind <> ''", "'s2', town, kind, number, unit", "street"),
        ("town", "postcode <> '' and street <> ''", "'t1', postcode, street", "town"),
        ("postcode", "street <> '' and town <> ''", "'p1', street, town, kind", "postcode"),
        ("postcode", "street <> '' and number <> '' and kind <> ''", "'p2', street, kind, number, unit", "postcode"),
        ("kind", "postcode <> '' and street <> ''", "'k1', postcode, street", "kind"),
        ("kind", "town <> '' and street <> ''", "'k2', town, street", "kind"),
        ("unit_word", "postcode <> '' and pair <> ''", "'u1', postcode, pair", "before_1"),
        ("unit_word", "postcode <> '' and pair <> ''", "'u2', postcode, pair", "before_2"),
    )
    cells = ", ".join(f"named_struct('slot', '{slot}', 'anchor', if({given}, concat_ws('|', {by}), null), 'value', {value})" for slot, given, by, value in slots)
    cells = f"array({cells})"
    return parts.selectExpr(f"inline({cells})").where("anchor is not null and value <> '' and not value rlike '^[0-9]+[a-z]?$'")


def mine(parts: DataFrame) -> DataFrame:
    """(slot, value, normal, evidence): the significant rewrites that these parts give.

    In each anchor only the most frequent value (of words for kinds and units,
    the full words) meets the others, so meetings are linear in the addresses. A kind of street or unit word is rewritten to a
    full word only, and a full word never is.
    """
    seen = slot_values(parts).groupBy("slot", "anchor", "value").agg(F.count(F.lit(1)).alias("n"))
    seen = cut(seen)
    overall = seen.groupBy("slot", "value").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("anchors"))
    seen = seen.join(overall, ["slot", "value"])
    full = F.col("value").isin(*_FULL_WORDS)
    worded = F.col("slot").isin("kind", "unit_word")
    hubs = seen.where(~worded).groupBy("slot", "anchor").agg(F.max(F.struct("total", F.col("value").alias("v"))).alias("hub"))
    spelled = seen.where(~worded).join(hubs, ["slot", "anchor"]).where("value <> hub.v").select("slot", "value", "anchors", "total", F.col("hub.v").alias("normal"), F.col("hub.total").alias("b"))
    # The full words of an anchor are a few of a fixed list, so all of them meet its other words.
    fulls = seen.where(worded & full).groupBy("slot", "anchor").agg(F.collect_set(F.struct(F.col("value").alias("v"), F.col("total").alias("t"))).alias("fulls"))
    words = seen.where(worded & ~full & ~F.col("value").isin(*sorted(BUILDINGS))).join(fulls, ["slot", "anchor"])
    words = words.select("slot", "value", "anchors", "total", F.explode("fulls").alias("f")).select("slot", "value", "anchors", "total", F.col("f.v").alias("normal"), F.col("f.t").alias("b"))
    met = spelled.unionByName(words)
    pairs = met.groupBy("slot", "value", "normal").agg(
        F.count(F.lit(1)).alias("meetings"), F.first("anchors").alias("a"), F.first("b").alias("b"), F.first("total").alias("own")
    )
    sizes = overall.groupBy("slot").agg(F.sum("anchors").alias("all_anchors"))
    scored = pairs.join(F.broadcast(sizes), "slot").withColumn("alike", _unlikeness("slot", "value", "normal"))
    met_share = F.col("meetings") / F.col("a")
    chance = F.least(F.col("b") / F.col("all_anchors"), F.lit(0.9))
    ratio = F.col("meetings") * F.log(F.greatest(met_share / chance, F.lit(1.0)))
    evidence = F.col("alike") + F.least(ratio, F.lit(20.0))
    # A word before units may stand for another that it isn't like, if they meet often.
    unlike = (F.col("slot") == "unit_word") & (F.col("meetings") >= 3) & (met_share >= SHARE) & (ratio >= EVIDENCE / 2)
    enough = scored.withColumn("evidence", evidence).where(
        unlike | ((F.col("evidence") >= EVIDENCE) & (F.col("alike") > 0) & ((met_share >= SHARE) | worded))
    )
    best = enough.groupBy("slot", "value").agg(F.max(F.struct((F.col("alike") > 0).cast("int").alias("like"), "meetings", "evidence", "normal", "b", "own")).alias("m"))
    return best.select("slot", "value", F.col("m.normal").alias("normal"), F.col("m.evidence").alias("evidence"), F.col("m.meetings").alias("meetings"))


def apply_rewrites(parts: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Street, town and postcode rewritten, by joins: their rewrites grow with the corpus."""
    for slot in ("street", "town", "postcode"):
        own = rewrites.where(F.col("slot") == slot).select(F.col("value").alias(slot), F.col("normal").alias("_new"))
        parts = parts.join(own, slot, "left").withColumn(slot, F.coalesce("_new", slot)).drop("_new")
    return parts.select("id", *_PARTS)


def normalise(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts after all rewrites, the rewrites), by mining and rematching until nothing new appears."""
    words: dict[str, str] = {}
    mined: DataFrame | None = None
    parts = cut(take_apart(lines, words))
    spark = lines.sparkSession
    while True:
        new = cut(mine(parts))
        taken = spark.createDataFrame([(k,) for k in words], "value string")
        worded = new.where("slot in ('kind', 'unit_word')").join(taken, "value", "left_anti").orderBy(F.desc("meetings"), "value").limit(WORD_REWRITES).collect()
        fresh = {r.value: r.normal for r in worded}
        others = new.where("slot not in ('kind', 'unit_word')")
        # A rewrite counts as new only once, so the rounds end.
        others = cut(others if mined is None else others.join(mined, ["slot", "value", "normal"], "left_anti"))
        some = not others.isEmpty()
        if not fresh and not some:
            break
        words |= fresh
        mined = others if mined is None else mined.unionByName(others)
        if fresh:  # words decide what is street and what is unit, so all is taken apart anew
            parts = take_apart(lines, dict(words))
            parts = cut(apply_chain(parts, mined))
        else:
            parts = cut(apply_rewrites(parts, others))
    table = spark.createDataFrame([("word", k, v) for k, v in sorted(words.items())], "slot string, value string, normal string")
    return parts, table if mined is None else table.unionByName(mined.select("slot", "value", "normal"))


def apply_chain(parts: DataFrame, mined: DataFrame) -> DataFrame:
    """Apply rewrites mined in several rounds: of one value the last found, then what that is rewritten to, and once more."""
    one = cut(mined.groupBy("slot", "value").agg(F.max(F.struct("meetings", "evidence", "normal")).alias("m")).select("slot", "value", F.col("m.normal").alias("normal")))
    for _ in range(2):
        parts = apply_rewrites(parts, one)
    return parts


def fill(parts: DataFrame) -> DataFrame:
    """Street, kind and town as the postcode's other addresses have them; without postcode, kind and town by street and town, or street alone.

    A street stays as written where it isn't like the postcode's. What has only
    one possible value is filled, what has several is not.
    """
    def usual(by: list[str], value: str, out: str, rows: DataFrame) -> DataFrame:
        counts = rows.where(F.col(value) != "").groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(*by).agg(F.max(F.struct("n", value)).alias("m")).select(*by, F.col(f"m.{value}").alias(out))

    def only(by: list[str], value: str, out: str, rows: DataFrame) -> DataFrame:
        held = rows.where(F.col(value) != "").groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        return held.where("lo = hi").select(*by, F.col("lo").alias(out))

    typed = parts.withColumn("kind", F.when(F.col("kind").isin(*sorted(STREET_TYPES)), F.col("kind")).otherwise(""))
    coded = typed.where("postcode <> ''")
    snapped = coded.join(usual(["postcode"], "street", "usual_street", coded), "postcode", "left")
    alike = (F.levenshtein("street", "usual_street") <= F.when(F.length("usual_street") >= 7, 3).otherwise(2)) | F.col("usual_street").startswith(F.concat("street", F.lit(" ")))
    snapped = snapped.withColumn("street", F.when(alike | (F.col("street") == ""), F.coalesce("usual_street", "street")).otherwise(F.col("street"))).drop("usual_street")
    by = ["postcode", "street"]
    snapped = snapped.join(usual(by, "kind", "k", snapped), by, "left").join(usual(by, "town", "t", snapped), by, "left")
    snapped = cut(snapped.withColumns({"kind": F.coalesce("k", "kind"), "town": F.coalesce("t", "town")}).drop("k", "t"))
    bare = typed.where("postcode = ''")
    by = ["street", "town"]
    bare = bare.join(only(by, "kind", "k", snapped), by, "left").withColumn("kind", F.when(F.col("kind") == "", F.coalesce("k", F.lit(""))).otherwise(F.col("kind"))).drop("k")
    # A misspelt town of a street that stands in one town only is what the coded ones have.
    by = ["street", "kind"]
    bare = bare.join(only(by, "town", "t", snapped), by, "left").withColumn(
        "town", F.when((F.col("town") == "") | (F.levenshtein("town", "t") <= 2), F.coalesce("t", "town")).otherwise(F.col("town"))
    ).drop("t")
    return snapped.select("id", *_PARTS).unionByName(bare.select("id", *_PARTS))


def places(profiles: DataFrame) -> DataFrame:
    """(company_number, place): the place is one text of street, kind, town, number and unit.

    Companies without an address, or whose address names no street and number, have no row.
    """
    companies = cut(company_addresses(profiles))
    lines = companies.withColumn("id", F.xxhash64("l1", "l2", "loc", "pc"))
    distinct = cut(spread(lines.select("id", "l1", "l2", "loc", "pc").dropDuplicates(["id"]), "id"))
    parts, _ = normalise(distinct)
    filled = fill(parts).where("street <> '' and number <> ''")
    town = F.when(F.col("town") != "", F.col("town")).otherwise(F.col("postcode"))
    keyed = filled.select("id", F.concat_ws("|", "street", "kind", town, "number", "unit").alias("place"))
    return lines.select("company_number", "id").join(keyed, "id").select("company_number", "place")


def same_place(profiles: DataFrame) -> DataFrame:
    """company_number_a, company_number_b of all companies at one place, the smaller first."""
    at = places(profiles)
    other = at.select(F.col("company_number").alias("company_number_b"), "place")
    pairs = at.select(F.col("company_number").alias("company_number_a"), "place").join(other, "place")
    return pairs.where("company_number_a < company_number_b").select("company_number_a", "company_number_b")
