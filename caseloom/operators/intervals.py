"""Continuous periods and gaps of day intervals, by compressed run bitmaps.

A day number splits into (shard, word, bit): 64 days a word, 64 words (4,096
days) a shard. A spell becomes at most two partial words, one bit set of whole
words per shard it crosses, and, when it has no end, one tail mark. bit_or
unites them with map-side combine, so what is shuffled per entity and shard is
bounded by the calendar, however many spells an entity has. Set runs come out
of each bitmap by bit arithmetic; runs that touch over words and shards are
joined in a window whose partitions are bounded by the calendar as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Day number that stands for "no end"; beyond any date.
OPEN_DAY = 1 << 40
_WHOLE_WORDS, _TAIL = -1, -2


def _mask(lo: str, hi: str) -> str:
    return f"(shiftleft(-1L, cast({lo} as int)) & shiftrightunsigned(-1L, cast(63 - ({hi}) as int)))"


def spell_bitmaps(spells: DataFrame) -> DataFrame:
    """(entity, first_day DATE, last_day DATE or null) -> (entity, shard, word, mask, tail_from).

    Rows without entity or start, or whose end lies before their start, do not count.
    """
    s = spells.select(
        "entity",
        F.unix_date("first_day").cast("bigint").alias("s"),
        F.unix_date("last_day").cast("bigint").alias("e"),
    ).where("entity is not null and s is not null and (e is null or e >= s)")
    s = s.withColumns({"ws": F.expr("shiftright(s, 6)"), "we": F.expr("shiftright(e, 6)")})
    cell = "named_struct('shard', {shard}, 'word', cast({word} as int), 'mask', {mask}, 'tail_from', {tail})"

    def partial(word: str, lo: str, hi: str) -> str:
        return cell.format(shard=f"shiftright({word}, 6)", word=f"({word}) & 63", mask=_mask(lo, hi), tail="cast(null as bigint)")

    whole = cell.format(
        shard="b", word=str(_WHOLE_WORDS), tail="cast(null as bigint)",
        mask=_mask("if(b = shiftright(ws + 1, 6), (ws + 1) & 63, 0)", "if(b = shiftright(we - 1, 6), (we - 1) & 63, 63)"),
    )
    tail = cell.format(shard="0L", word=str(_TAIL), mask="0L", tail="s")
    cells = f"""case
        when e is null then array({tail})
        when ws = we then array({partial('ws', 's & 63', 'e & 63')})
        when we = ws + 1 then array({partial('ws', 's & 63', '63')}, {partial('we', '0', 'e & 63')})
        else array_union(array({partial('ws', 's & 63', '63')}, {partial('we', '0', 'e & 63')}),
                         transform(sequence(shiftright(ws + 1, 6), shiftright(we - 1, 6)), b -> {whole}))
    end"""
    return (
        s.selectExpr("entity", f"inline({cells})")
        .groupBy("entity", "shard", "word")
        .agg(F.expr("bit_or(mask)").alias("mask"), F.min("tail_from").alias("tail_from"))
    )


def bitmap_runs(bitmaps: DataFrame) -> DataFrame:
    """Set runs of each bitmap: (entity, s, e) in day numbers."""
    at = "filter(sequence(0, 63), i -> (shiftright({bits}, i) & 1L) = 1L)"
    starts = at.format(bits="(mask & ~shiftleft(mask, 1))")
    ends = at.format(bits="(mask & ~shiftrightunsigned(mask, 1))")
    runs = f"""case
        when word = {_TAIL} then array(named_struct('s', tail_from, 'e', {OPEN_DAY}L))
        when word = {_WHOLE_WORDS} then zip_with({starts}, {ends}, (a, b) ->
            named_struct('s', (shard * 64 + a) * 64, 'e', (shard * 64 + b) * 64 + 63))
        else zip_with({starts}, {ends}, (a, b) ->
            named_struct('s', (shard * 64 + word) * 64 + a, 'e', (shard * 64 + word) * 64 + b))
    end"""
    return bitmaps.selectExpr("entity", f"inline({runs})")


def _day(c: Column) -> Column:
    return F.when(c >= OPEN_DAY, F.lit("open")).otherwise(F.date_format(F.date_from_unix_date(c.cast("int")), "yyyy-MM-dd"))


def periods_and_gaps(spells: DataFrame) -> DataFrame:
    """(entity, first_day, last_day) -> (entity, span_kind, first_day, last_day), days as text.

    A null last_day is without end; spells that share a day or follow each other
    on the next day are continuous. An entity without a valid spell has no rows;
    an empty input gives an empty result. Repeated rows change nothing.
    """
    runs = bitmap_runs(spell_bitmaps(spells))
    w = Window.partitionBy("entity").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("reach", reach).withColumn(
        "island", F.sum(F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1), 1).otherwise(0)).over(w)
    )
    periods = islands.groupBy("entity", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = periods.withColumn("before", F.lag("e").over(Window.partitionBy("entity").orderBy("s"))).selectExpr(
        "entity",
        """inline(filter(array(
            named_struct('span_kind', 'period', 's', s, 'e', e),
            named_struct('span_kind', 'gap', 's', before + 1, 'e', s - 1)), x -> x.s is not null))""",
    )
    return spans.select("entity", "span_kind", _day(F.col("s")).alias("first_day"), _day(F.col("e")).alias("last_day"))


def officer_spells(appointments: DataFrame, officers: DataFrame) -> DataFrame:
    """Spells of each officer id: the latest version of every appointment, and the register entries whose link names the officer."""
    latest = (
        appointments.select("appointment_id", "officer_id", "appointed_on", "resigned_on", "retrieved_at")
        .groupBy("appointment_id")
        .agg(F.max(F.struct("retrieved_at", "officer_id", "appointed_on", "resigned_on")).alias("v"))
        .select(F.col("v.officer_id").alias("entity"), F.col("v.appointed_on").alias("first_day"), F.col("v.resigned_on").alias("last_day"))
    )
    entries = officers.select(
        F.nullif(F.regexp_extract(F.trim("links.officer.appointments"), r"^/officers/([^/]+)/appointments/?$", 1), F.lit("")).alias("entity"),
        F.col("appointed_on").alias("first_day"),
        F.col("resigned_on").alias("last_day"),
    )
    return latest.unionByName(entries)
