"""Case files and feeds."""

import datetime as dt
import json

import pytest

from caseloom.sources import casefiles
from caseloom.streaming import feeds


def test_envelopes_and_log(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "n", "url": "u", "params": {"q": "1", "api_key": "s"}, "status": 200, "body": "{}"}, indent=1))
    (tmp_path / "b.json").write_text("{not json")
    df = casefiles.read_envelopes(spark, str(tmp_path))
    assert sorted((r.name is None, r.status) for r in df.collect()) == [(False, 200), (True, None)]
    log = casefiles.fetch_log(df.where("name is not null").selectExpr("1L as fetch_id", "*")).first()
    assert log.params == {"q": "1"}


def test_latest_responses(spark):
    rows = [(1, "u", {"a": "1", "b": "2"}, 200, "old"), (2, "u", {"b": "2", "a": "1"}, 200, "new"), (3, "u", None, 500, "bad"), (4, None, None, 200, None)]
    df = spark.createDataFrame(rows, "fetch_id bigint, url string, params map<string,string>, status int, body string")
    assert sorted(r.fetch_id for r in casefiles.latest_responses(df).collect()) == [2, 4]


def test_cases_are_not_overwritten_unasked(spark, tmp_path):
    df = spark.createDataFrame([("1", "green"), ("2", "red")], "company_number string, level string")
    path = str(tmp_path / "out")
    casefiles.write_cases(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        casefiles.write_cases(df, path)
    casefiles.write_cases(df, path, overwrite=True)
    assert spark.read.json(path).count() == 2


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    spark.createDataFrame([("k", "a", t), ("k", "a", t), ("j", "a", t + dt.timedelta(seconds=400))], "k string, who string, ts timestamp").write.parquet(src)
    stream = lambda: spark.readStream.schema("k string, who string, ts timestamp").parquet(src)
    q = feeds.fresh_items(stream(), "k", "ts").writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from fresh").first()[0] == 2
    q = feeds.sends_per_window(stream(), "who", "ts").writeStream.format("memory").queryName("sends").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("select n from sends").collect()) == [1, 2]
