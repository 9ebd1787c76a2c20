"""Timestamps of many written forms as one instant.

Text is taken apart by a few anchored patterns, all in the JVM. An offset in
the text holds. What is left is local time: its zone is the feed's declared
one, and for feeds without one that of the offset history that violates the
feed's own evidence least. A history is a zone of a list for every quarter;
going over to another zone costs CHANGE_COST violations. Evidence is: an item
can't be published after it was fetched; offsets written as numbers agree with
the zone's (an offset of zero counts half, since any feed may write UTC, and
the letter Z tells nothing); and a local time between two neighbours of its sequence whose instants are known
and lie close together lies between them. Only undeclared feeds are estimated.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Month names of four languages by number.
MONTHS = {
    1: "jan january januar jän jänner janvier janv enero ene",
    2: "feb february februar février fevrier févr febrero",
    3: "mar march märz mär maerz mrz mars marzo",
    4: "apr april avril avr abril abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet juil julio",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre",
    10: "oct october oktober okt octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dezember dez décembre decembre déc diciembre dic",
}
# Zone abbreviations by offset in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "ACST": 570,
    "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EDT": -240, "AST": -240, "EST": -300, "CDT": -300, "CST": -360, "MDT": -360, "MST": -420, "PDT": -420, "PST": -480,
}
# Zones an undeclared feed may be in.
CANDIDATE_ZONES = (
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Athens", "Europe/Moscow", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo",
    "Australia/Perth", "Australia/Sydney", "Pacific/Auckland", "America/New_York", "America/Chicago", "America/Denver",
    "America/Los_Angeles", "America/Sao_Paulo", "America/St_Johns", "Asia/Kathmandu",
)

#: Violations (two points each) that a change of zone within a history must save, and ids of a sequence's block, in which neighbours are looked for.
CHANGE_COST, BLOCK_IDS = 8, 1024
#: Neighbours in a sequence are close if their instants are so many microseconds apart at most.
CLOSE = 48 * 3_600_000_000

_CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"\s?((?:Z|[A-Za-z]{2,4}|[+\-−]\d{1,2}:?\d{0,2}))?(?:\[([A-Za-z_/+\-0-9]+)\])?"
_HALF = r"(?:\s?([AaPp])\.?[Mm]\.?)?"
#: Each pattern gives year, month, day (numbers or a name), hour, minute, second, fraction, half of day, zone, region.
_FORMS = {
    "iso": rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt, ]\s?{_CLOCK}{_HALF}{_ZONE})?$",
    "compact": r"^(\d{4})(\d{2})(\d{2})(?:[Tt ]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?()" + _ZONE + ")?$",
    "numeric": rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}})(?:,?\s{_CLOCK}{_HALF}(?:\s?Uhr)?{_ZONE})?$",
    "day_name": rf"^(?:\p{{L}}+\.?,?\s)?(\d{{1,2}})(?:st|nd|rd|th)?[.\s-]{{1,2}}(?:de\s)?(\p{{L}}+)\.?[,\s-]{{1,2}}(?:de\s)?(\d{{4}})(?:,?\s(?:at\s|um\s|à\s)?{_CLOCK}{_HALF}(?:\s?Uhr)?{_ZONE})?$",
    "name_day": rf"^(?:\p{{L}}+,\s)?(\p{{L}}+)\.?\s(\d{{1,2}})(?:st|nd|rd|th)?,?\s(\d{{4}})(?:,?\s(?:at\s)?{_CLOCK}{_HALF}{_ZONE})?$",
}
_PARTS = ("a", "b", "c", "hour", "minute", "second", "fraction", "half", "zone", "region")


def _map(pairs: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def settle(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a one-row generator, which the optimiser doesn't merge with what is built on them: each is computed once."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in cols.items())))))


def _null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def parse_written_time(df: DataFrame, text: str, day_first: str) -> DataFrame:
    """Add local_time TIMESTAMP_NTZ, offset_minutes BIGINT, offset_is_number BOOLEAN, region STRING, epoch_micros BIGINT.

    epoch_micros is set for counts since 1970 (seconds, or with three, six or
    nine more digits), else local_time is set where the text names a calendar
    time that exists; all are null otherwise, also for null text. A null
    day_first counts as true. Two-digit years below 69 are in this century.
    """
    s = F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    out = settle(df, _s=s)
    form = F.when(F.col("_s").isNull(), None)
    for name, pattern in _FORMS.items():
        form = form.when(F.col("_s").rlike(pattern), F.lit(name))
    out = settle(out, _form=form)
    parts = F.when(F.col("_form").isNull(), None)
    for name, pattern in _FORMS.items():
        parts = parts.when(
            F.col("_form") == name, F.struct(*(F.regexp_extract("_s", pattern, i + 1).alias(p) for i, p in enumerate(_PARTS)))
        )
    out = settle(out, _p=parts)
    p = {k: _null_if_blank(F.col(f"_p.{k}")) for k in _PARTS}
    months = _map({n: k for k, names in MONTHS.items() for n in names.split()})
    first = F.coalesce(F.col(day_first), F.lit(True))
    named = lambda c: F.try_element_at(months, F.lower(c))
    num = lambda c: c.try_cast("int")
    short = F.when(F.length(p["c"]) == 2, num(p["c"]) + F.when(num(p["c"]) < 69, 2000).otherwise(1900)).otherwise(num(p["c"]))
    pick = lambda y, n, d, m: (
        F.when(F.col("_form").isin("iso", "compact"), y).when(F.col("_form") == "numeric", n).when(F.col("_form") == "day_name", d).otherwise(m)
    )
    year = pick(num(p["a"]), short, num(p["c"]), num(p["c"]))
    month = pick(num(p["b"]), F.when(first, num(p["b"])).otherwise(num(p["a"])), named(p["b"]), named(p["a"]))
    day = pick(num(p["c"]), F.when(first, num(p["a"])).otherwise(num(p["b"])), num(p["a"]), num(p["b"]))
    hour = num(p["hour"])
    half = F.lower(p["half"])
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    hour = F.when(p["hour"].isNull(), 0).otherwise(hour)
    out = settle(out, _year=year, _month=month, _day=day, _hour=hour)
    second = F.coalesce(num(p["second"]), F.lit(0))
    micro = F.rpad(F.substring(F.coalesce(p["fraction"], F.lit("")), 1, 6), 6, "0").cast("int")
    whole = F.try_make_timestamp_ntz(F.col("_year"), F.col("_month"), F.col("_day"), F.col("_hour"), F.coalesce(num(p["minute"]), F.lit(0)), F.lit(0).cast("decimal(16,6)"))
    local = F.when(second < 60, F.timestamp_add("SECOND", second, whole))
    local = F.timestamp_add("MICROSECOND", micro, local)
    z = F.upper(p["zone"])
    signed = F.regexp_replace(z, "−", "-").rlike(r"^[+-]\d")
    digits = F.regexp_replace(z, r"[^0-9]", "")
    hh = F.when(F.length(digits) <= 2, num(digits)).otherwise(num(F.substring(digits, 1, 2)))
    hh = F.when(F.length(digits) == 3, num(F.substring(digits, 1, 1))).otherwise(hh)
    mm = F.when(F.length(digits) <= 2, 0).otherwise(num(F.right(digits, F.lit(2))))
    offset = F.when(signed & (hh <= 18) & (mm < 60), (hh * 60 + mm) * F.when(z.startswith("+"), 1).otherwise(-1)).when(
        ~signed, F.try_element_at(_map(ABBREVIATIONS), z)
    )
    unknown_zone = z.isNotNull() & offset.isNull()
    n = F.length("_s")
    count = F.when(F.col("_s").rlike(r"^-?\d+$"), F.col("_s").try_cast("bigint"))
    micros = (
        F.when(n.between(9, 11), count * 1_000_000).when(n.between(12, 14), count * 1_000).when(n.between(15, 17), count).when(n == 19, F.expr("_s").try_cast("bigint") / 1_000)
    ).cast("bigint")
    return settle(
        out,
        epoch_micros=F.when(F.col("_form").isNull(), micros),
        local_time=F.when(~unknown_zone, local),
        offset_minutes=offset.cast("bigint"),
        offset_is_number=signed,
        region=F.when(p["region"].isin(*CANDIDATE_ZONES), p["region"]),
    ).drop("_s", "_form", "_p", "_year", "_month", "_day", "_hour")


def ntz_micros(c: Column) -> Column:
    """Microseconds since 1970-01-01T00:00 of a TIMESTAMP_NTZ, whatever the session's zone."""
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def zone_micros(zone: Column, local: Column) -> Column:
    """The instant of local time in a zone: the first of an hour that occurs twice; a skipped time moves on by what was skipped."""
    return ntz_micros(F.convert_timezone(zone, F.lit("UTC"), local))


def quarter(c: Column) -> Column:
    return (F.year(c) * 4 + F.quarter(c) - 1).cast("int")


def estimate_zones(parsed: DataFrame) -> DataFrame:
    """Records of parse_written_time with feed, record_kind, record_id, ingested_at -> (feed, history, violations, evidence).

    violations are in points, two for each but one for an offset of zero. history is a list of (from_quarter, zone_name), from_quarter counting
    quarters since year 0; a time before the first one has the first one's zone.
    Of histories with equally few violations, the first zone in the list holds.
    Feeds whose records give no evidence at all have no row. What is shuffled
    are counters by feed, quarter and zone; neighbours are looked for in blocks
    of BLOCK_IDS ids, so no task gets a whole feed.
    """
    zones = F.array(*(F.struct(F.lit(i).cast("int").alias("ord"), F.lit(z).alias("zone_name")) for i, z in enumerate(CANDIDATE_ZONES)))
    own = ntz_micros(F.col("local_time")) - F.col("offset_minutes") * 60_000_000
    timed = parsed.where("feed is not null and (local_time is not null or epoch_micros is not null)").select(
        "feed", "record_kind", "record_id", "local_time", "offset_is_number", (F.coalesce("offset_minutes", F.lit(1)) == 0).alias("offset_zero"), ntz_micros(F.col("ingested_at")).alias("ingested"), F.coalesce("epoch_micros", own).alias("known")
    )
    block = Window.partitionBy("feed", "record_kind", F.floor(F.col("record_id") / BLOCK_IDS)).orderBy("record_id", "known", "local_time")
    timed = timed.withColumns(
        {
            "earlier": F.last("known", True).over(block.rowsBetween(Window.unboundedPreceding, -1)),
            "later": F.first("known", True).over(block.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    asked = timed.where("local_time is not null and (known is null or offset_is_number)").select("*", F.explode(zones).alias("z"))
    asked = settle(asked, utc=zone_micros(F.col("z.zone_name"), F.col("local_time")))
    utc, bare = F.col("utc"), F.col("known").isNull()
    close = (F.col("later") - F.col("earlier")).between(0, CLOSE)
    wrong = F.when(bare, (utc > F.col("ingested")) | (close & ~utc.between(F.col("earlier"), F.col("later")))).otherwise(utc != F.col("known"))
    wrong = F.coalesce(wrong, F.coalesce(bare & (utc > F.col("ingested")), F.lit(False)))
    counts = asked.groupBy("feed", quarter(F.col("local_time")).alias("quarter"), F.col("z.ord").alias("ord")).agg(
        F.sum(F.when(wrong, F.when(F.col("offset_zero"), 1).otherwise(2)).otherwise(0)).alias("violations"), F.count(F.lit(1)).alias("evidence")
    )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """One feed's history, by dynamic programming over its quarters: at most as many rows as quarters of 10,000 years times zones."""
        table = pdf.pivot(index="quarter", columns="ord", values="violations").sort_index()
        cost = table.to_numpy()
        best, came = cost[0].astype(float), np.zeros(cost.shape, int)
        for t in range(1, len(cost)):
            cheapest = int(best.argmin())
            change = best[cheapest] + CHANGE_COST < best
            came[t] = np.where(change, cheapest, np.arange(cost.shape[1]))
            best = np.where(change, best[cheapest] + CHANGE_COST, best) + cost[t]
        path = [int(best.argmin())]
        for t in range(len(cost) - 1, 0, -1):
            path.append(int(came[t][path[-1]]))
        path.reverse()
        history = [{"from_quarter": int(q), "zone_name": CANDIDATE_ZONES[z]} for i, (q, z) in enumerate(zip(table.index, path, strict=True)) if i == 0 or z != path[i - 1]]
        wrong = int(cost[np.arange(len(path)), path].sum())
        return pd.DataFrame({"feed": [pdf["feed"].iloc[0]], "history": [history], "violations": [wrong], "evidence": [int(pdf["evidence"].sum()) // cost.shape[1]]})

    return counts.groupBy("feed").applyInPandas(choose, "feed string, history array<struct<from_quarter: int, zone_name: string>>, violations bigint, evidence bigint")


def zone_at(history: Column, local: Column) -> Column:
    """The zone that a history of estimate_zones has at a local time; null without a history."""
    begun = F.filter(history, lambda h: h["from_quarter"] <= quarter(local))
    return F.coalesce(F.try_element_at(begun, F.lit(-1)), F.try_element_at(history, F.lit(1)))["zone_name"]


def to_instants(records: DataFrame, feeds: DataFrame) -> DataFrame:
    """(record_kind, record_id, written, feed, ingested_at) -> (record_kind, record_id, utc_micros).

    feeds (feed, zone_name, day_first) is a fixed short list of sources, and is
    broadcast; a feed it lacks, or without a zone, gets the estimated one, or
    UTC where there is no evidence. Text that names no valid time gives no row.
    """
    known = F.broadcast(feeds.select("feed", F.col("zone_name").alias("declared"), "day_first").dropDuplicates(["feed"]))
    read = records.select("record_kind", "record_id", "written", "feed", "ingested_at").join(known, "feed", "left")
    declared, left = (parse_written_time(read.where(f"declared is {x} null"), "written", "day_first") for x in ("not", ""))
    # Only records of undeclared feeds are shuffled to their history.
    told = left.join(estimate_zones(left).select("feed", "history"), "feed", "left").withColumn("declared", zone_at(F.col("history"), F.col("local_time")))
    columns = ["record_kind", "record_id", "epoch_micros", "local_time", "offset_minutes", "region", "declared"]
    zoned = declared.select(*columns).unionByName(told.select(*columns))
    zone = F.coalesce("region", "declared", F.lit("UTC"))
    micros = F.coalesce(
        "epoch_micros", ntz_micros(F.col("local_time")) - F.col("offset_minutes") * 60_000_000, zone_micros(zone, F.col("local_time"))
    )
    return zoned.select("record_kind", "record_id", micros.alias("utc_micros")).where("utc_micros is not null").distinct()


def written_records(media: DataFrame, fetches: DataFrame) -> DataFrame:
    """The two tables' written times as one list; fetch records have no later ingestion time of their own."""
    a = media.select(F.lit("media_item").alias("record_kind"), F.col("media_id").alias("record_id"), F.col("published").alias("written"), "feed", "ingested_at")
    b = fetches.select(
        F.lit("fetch_record").alias("record_kind"), F.col("fetch_id").alias("record_id"), F.col("retrieved_at").alias("written"), "feed",
        F.lit(None).cast("timestamp_ntz").alias("ingested_at"),
    )
    return a.unionByName(b)
