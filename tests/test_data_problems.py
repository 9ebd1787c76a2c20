"""The general data problems against plain Python."""

import datetime as dt
import json
import re
from collections import defaultdict
from zoneinfo import ZoneInfo

import duckdb
import pytest

from pyspark.sql import functions as F

from caseloom.operators import nested, timestamps
from caseloom.operators.intervals import periods_and_gaps
from caseloom.plans import data_queries

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain_spans(spells):
    by = defaultdict(list)
    for entity, s, e in spells:
        if entity is not None and s is not None and (e is None or e >= s):
            by[entity].append((s, e or dt.date.max))
    out = []
    for entity, spans in by.items():
        done = []
        for s, e in sorted(spans):
            if done and (done[-1][1] == dt.date.max or s <= done[-1][1] + dt.timedelta(1)):
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        for i, (s, e) in enumerate(done):
            out.append((entity, "period", s.isoformat(), "open" if e == dt.date.max else e.isoformat()))
            if i:
                out.append((entity, "gap", (done[i - 1][1] + dt.timedelta(1)).isoformat(), (s - dt.timedelta(1)).isoformat()))
    return sorted(out)


def test_periods_of_the_tables(spark):
    con = duckdb.connect()
    spells = con.execute(
        f"""select officer_id, appointed_on, resigned_on from (select *, row_number() over (partition by appointment_id order by retrieved_at desc) k
            from '{SF}/appointments.parquet') where k = 1
            union all select regexp_extract(links.officer.appointments, '^/officers/([^/]+)/appointments', 1), appointed_on, resigned_on
            from '{SF}/officers.parquet' where links.officer.appointments is not null"""
    ).fetchall()
    assert rows(data_queries.p4_found(spark, SF)) == plain_spans([s for s in spells if s[0]])


def test_periods_of_edge_cases(spark):
    d = dt.date
    spells = [
        ("a", d(1969, 12, 31), d(1970, 1, 1)), ("a", d(1970, 1, 2), d(1970, 1, 2)), ("a", d(1970, 1, 4), d(2001, 5, 5)),
        ("b", d(1900, 1, 1), d(1900, 1, 1)), ("b", d(2100, 1, 1), None), ("b", d(2150, 1, 1), d(2151, 1, 1)),
        ("c", d(2000, 1, 2), d(2000, 1, 1)), ("c", None, d(2000, 1, 1)), (None, d(2000, 1, 1), None),
        ("d", d(1990, 3, 3), d(2020, 3, 3)), ("d", d(1990, 3, 3), d(2020, 3, 3)), ("d", d(2001, 1, 1), d(2002, 1, 1)),
    ]
    schema = "entity string, first_day date, last_day date"
    got = rows(periods_and_gaps(spark.createDataFrame(spells, schema)))
    assert got == plain_spans(spells)
    assert rows(periods_and_gaps(spark.createDataFrame([], schema))) == []


def test_instants_by_zoneinfo(spark):
    """ISO forms of the table, by the standard library."""
    con = duckdb.connect()
    feeds = {f: z for f, z in con.execute(f"select feed, zone_name from '{SF}/feed.parquet'").fetchall()}
    want = {}
    for key, text, feed in con.execute(f"select media_id, published, feed from '{SF}/media_item.parquet' where published is not null").fetchall():
        if re.fullmatch(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?)?", text):
            try:
                t = dt.datetime.fromisoformat(text)
            except ValueError:
                want[key] = None
                continue
            if t.tzinfo is None:  # fold=0 is the first of two, and moves a skipped time on
                t = t.replace(tzinfo=ZoneInfo(feeds[feed])).astimezone(dt.UTC)
            want[key] = (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
    got = {r.record_id: r.utc_micros for r in data_queries.p6_found(spark, SF).where("record_kind = 'media_item'").collect()}
    assert len(want) > 300
    assert {k: got.get(k) for k in want} == want


@pytest.mark.parametrize(
    ("text", "feed", "want"),
    [
        ("31/02/2024", "uk", None), ("03/04/2024 10:00", "uk", "2024-04-03T09:00:00"), ("03/04/2024 10:00", "us", "2024-03-04T15:00:00"),
        ("2.29.20 06.33", "us", "2020-02-29T11:33:00"), ("19. August 2019 02:28 Uhr", "de", "2019-08-19T00:28:00"),
        ("11. März 2022 15:10 Uhr", "de", "2022-03-11T14:10:00"), ("27 October 2024, 01:30", "uk", "2024-10-27T00:30:00"),
        ("31 March 2024, 01:30", "uk", "2024-03-31T01:30:00"), ("10 Mar 2024 01:37 EST", "us", "2024-03-10T06:37:00"),
        ("March 23, 2023 12:11 AM", "us", "2023-03-23T04:11:00"), ("  2019/01/18 12:16:21+0000 ", "us", "2019-01-18T12:16:21"),
        ("2018-12-11T18:50:49+01:00[Europe/London]", "uk", "2018-12-11T17:50:49"), ("20201019T180543Z", "us", "2020-10-19T18:05:43"),
        ("Thu, 21 Dec 2017 13:29:03 -0500", "uk", "2017-12-21T18:29:03"), ("1563031159", "us", "2019-07-13T15:19:19"),
        ("1564518560849", "us", "2019-07-30T20:29:20.849000"), ("2020-08-22", "de", "2020-08-21T22:00:00"), ("last week", "uk", None),
        ("n.d.", "uk", None), ("", "uk", None), (None, "uk", None), ("2024-13-01", "uk", None), ("2024-01-01T25:00:00", "uk", None),
        ("2024-05-05T10:00:00", "none", "2024-05-05T10:00:00"), ("3-Jul-2024 05:33", "us", "2024-07-03T09:33:00"), ("x" * 5000, "uk", None),
        ("2024-05-05T10:00:00", None, "2024-05-05T10:00:00"),
    ],
)
def test_written_forms(spark, text, feed, want):
    if not hasattr(test_written_forms, "made"):
        params = next(m for m in test_written_forms.pytestmark if m.name == "parametrize").args[1]
        feeds = spark.createDataFrame(
            [("uk", "Europe/London", True), ("us", "America/New_York", False), ("de", "Europe/Berlin", True)], "feed string, zone_name string, day_first boolean"
        )
        data = [("media_item", i, t, f, None) for i, (t, f, _) in enumerate(params)]
        made = timestamps.to_instants(
            spark.createDataFrame(data, "record_kind string, record_id bigint, written string, feed string, ingested_at timestamp_ntz"), feeds
        )
        test_written_forms.made = {params[r.record_id][:2]: r.utc_micros for r in made.collect()}
    micros = test_written_forms.made.get((text, feed))
    assert (None if micros is None else (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)).isoformat()) == want


def test_undeclared_zone_is_estimated(spark):
    base = dt.datetime(2024, 1, 5, 12, 0)
    data = []
    for i in range(80):
        local = base + dt.timedelta(days=4 * i)
        off = ZoneInfo("America/New_York").utcoffset(local)
        hours = int(off.total_seconds() // 3600)
        data.append(("media_item", i, local.isoformat() + (f"-{-hours:02d}:00" if i % 2 else ""), "x", local - off + dt.timedelta(minutes=5)))
    df = spark.createDataFrame(data, "record_kind string, record_id bigint, written string, feed string, ingested_at timestamp_ntz")
    feeds = spark.createDataFrame([("y", "UTC", True)], "feed string, zone_name string, day_first boolean")
    got = {r.record_id: r.utc_micros for r in timestamps.to_instants(df, feeds).collect()}
    assert all((dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=got[i])) == data[i][4] - dt.timedelta(minutes=5) for i in range(80))


def plain_nested(key, body):
    out = []
    try:
        j = json.loads(body)
        while isinstance(j, str):
            j = json.loads(j)
    except (ValueError, TypeError):
        return out
    if not isinstance(j, dict):
        return out
    say = lambda v: v if isinstance(v, str) else ""
    lists = [j.get("items")]
    pages = j.get("pages")
    lists += [p.get("items") for p in (pages if isinstance(pages, list) else [pages]) if isinstance(p, dict)]
    if isinstance(j.get("casefile"), dict):
        lists.append(j["casefile"].get("officers"))
    at = 0
    for items in lists:
        items = [items] if isinstance(items, dict) else items if isinstance(items, list) else []
        for e in items:
            if isinstance(e, dict):
                link = e.get("links")
                link = link.get("officer") if isinstance(link, dict) else None
                out.append((key, at, -1, say(e.get("name")), say(e.get("appointed_on")), say(link.get("appointments")) if isinstance(link, dict) else ""))
                former = e.get("former_names")
                former = [former] if isinstance(former, dict) else former if isinstance(former, list) else []
                out += [(key, at, k, say(f.get("name")), "", "") for k, f in enumerate(former) if isinstance(f, dict)]
            at += 1
    return out


def test_nested_rows_of_the_table(spark):
    bodies = duckdb.connect().execute(f"select distinct fetch_id, body from '{SF}/fetch_record.parquet' where body is not null").fetchall()
    want = sorted({r for k, b in bodies for r in plain_nested(k, b)})
    assert len(want) > 1000
    assert rows(data_queries.p7_found(spark, SF)) == want


TRICKY = [
    '{"items":[{"name":"a\\\\\\"}{[,:","appointed_on":null},[{"name":"no"}],{"links":{"officer":{"appointments":"/x"}},"former_names":[1,{"name":"f"}]}]}',
    '{"items":{"name":"one","former_names":{"name":"g"}}}', '{"items":[]}', "[]", "null", '""', "", "{", '{"items":[{"name":"x"}', "nul", '"\\"x\\""',
    '{"it\\u0065ms":[{"n\\u0061me":"esc\\u00e9 \\ud83d\\ude00"}]}', '{"items":[{"name":"p"},{"name":"q"}],"items":[{"name":"last"}]}',
    ' { "pages" : [ {"items":[ {"name":"1"} , 2 ]}, 7, {"items":[{"name":"3"}]} ] } ', '{"items":[{"items":[{"name":"deep"}],"name":"top"}]}',
    '{"casefile":{"officers":[null,{"name":"z","links":[{"officer":{"appointments":"no"}}]}]}}', '"{\\"items\\":[{\\"name\\":\\"in\\"}]}"',
    '{"items":[NaN]}', '{"items":[{"name":"' + "long " * 100_000 + '"}]}', "\\", '{"a":"\\\\"}',
]


def test_nested_rows_of_tricky_bodies():
    got = sorted(nested.nested_rows(list(range(len(TRICKY))), [b.encode() for b in TRICKY]))
    assert got == sorted(r for i, b in enumerate(TRICKY) for r in plain_nested(i, b) if "NaN" not in b)
    assert nested.nested_rows([], []) == []


def test_nested_rows_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "{}", "y"), (2, TRICKY[0], "z"), (2, TRICKY[0], "z")], "fetch_id bigint, body string, name string")
    assert rows(nested.flatten_bodies(df)) == sorted(plain_nested(2, TRICKY[0]))


def test_zones_of_undeclared_feeds(spark):
    media, fetches, feeds = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("media_item", "fetch_record", "feed"))
    records = timestamps.written_records(media, fetches)
    blank = feeds.withColumn("zone_name", F.lit(None).cast("string"))
    assert rows(timestamps.to_instants(records, blank)) == rows(timestamps.to_instants(records, feeds))
    zones = data_queries.p6_zones(spark, SF).collect()
    assert len(zones) == 8 and all(r.zone_name == r.declared and r.n_zones == 1 for r in zones)


def test_a_feed_that_changes_its_zone_and_one_known_by_its_sequence_alone(spark):
    made, want = [], {}
    for i in range(400):
        day = dt.datetime(2020, 1, 1, 9) + dt.timedelta(days=4 * i)
        zone = ZoneInfo("Europe/Berlin" if day < dt.datetime(2022, 1, 1) else "America/New_York")
        local = day.replace(tzinfo=zone)
        made.append(("moving", i, local.isoformat() if i % 2 else day.isoformat()))
        want["moving", i] = int(local.timestamp() * 1_000_000)
    for i in range(300):
        at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=20 * i)
        text = at.strftime("%Y-%m-%dT%H:%M:%SZ") if i % 2 else at.astimezone(ZoneInfo("Asia/Tokyo")).strftime("%Y-%m-%d %H:%M")
        made.append(("ordered", 1_000 + i, text))
        want["ordered", 1_000 + i] = int(at.timestamp() * 1_000_000)
    df = spark.createDataFrame(made, "feed string, record_id bigint, written string").withColumns({"record_kind": F.lit("x"), "ingested_at": F.lit(None).cast("timestamp_ntz")})
    feeds = spark.createDataFrame([], "feed string, zone_name string, day_first boolean")
    got = {r.record_id: r.utc_micros for r in timestamps.to_instants(df, feeds).collect()}
    wrong = [k for k, v in want.items() if got[k[1]] != v]
    assert len([k for k in wrong if k[0] == "ordered"]) == 0 and len(wrong) <= 2, wrong


def test_times_of_any_length(spark):
    far = "Wednesday, " + " " * 200 + "5 March 2025 at 10:00" + " " * 100 + "UTC"
    df = spark.createDataFrame([("x", 1, far, "f"), ("x", 2, "5 March 2025 " * 5000, "f"), ("x", 3, None, None)], "record_kind string, record_id bigint, written string, feed string")
    df = df.withColumn("ingested_at", F.lit(None).cast("timestamp_ntz"))
    feeds = spark.createDataFrame([], "feed string, zone_name string, day_first boolean")
    assert rows(timestamps.to_instants(df, feeds)) == [("x", 1, 1741168800000000)]
