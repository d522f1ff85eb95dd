"""Sinks, filters from a page's parameters, and periods in SQL and in plain dates."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F
from tally.functions import periods
from tally.operators import review
from tally.operators.ledger import Filters
from tally.sources import sinks


def test_csv_opens_safely(spark, tmp_path):
    rows = [(1, "=1+1"), (2, 'say "hi", all'), (3, "two\nlines"), (4, None), (5, "+966"), (6, "plain")]
    sinks.write_csv(spark.createDataFrame(rows, "id int, note string").coalesce(1), str(tmp_path / "out"))
    raw = next(Path(tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert raw == '﻿id,note\r\n1,\'=1+1\r\n2,"say ""hi"", all"\r\n3,"two\nlines"\r\n4,\r\n5,\'+966\r\n6,plain\r\n'


def test_json_keeps_nulls_and_a_dump_its_order(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 5), (3, "a", 7)], "id int, received_at string, x int")
    sinks.write_json(rows.coalesce(1), str(tmp_path / "out"))
    assert '{"id":2,"received_at":"b","x":null}' in next(Path(tmp_path / "out").glob("part-*")).read_text()


def test_a_dump_is_stamped_only_if_whole(spark, tmp_path):
    at, now = dt.datetime(2026, 5, 1, 9), dt.datetime(2026, 6, 1)
    rows = spark.createDataFrame([(2, "b", at + dt.timedelta(hours=1), 1, "x"), (1, "a", at, 0, "x"), (3, "c", at, None, "x")], "id int, body string, received_at timestamp, attempts int, secret string")
    settings = spark.createDataFrame([("Asia/Riyadh", None)], "timezone string, last_export_at timestamp")
    for limit, truncated in ((2, True), (3, True), (4, False)):
        got, after = sinks.export_raw(rows, settings, str(tmp_path / f"out{limit}"), now, limit, "json")
        assert got is truncated and [r["last_export_at"] for r in after.collect()] == [None if truncated else now]
        dumped = spark.read.json(str(tmp_path / f"out{limit}")).collect()
        assert [r["id"] for r in dumped] == ["1", "3", "2"][:limit] and dumped[0]["received_at"] == "2026-05-01T09:00:00Z"
        assert set(dumped[0].asDict()) == set(sinks.DUMP_COLUMNS)
    assert sinks.raw_dump(rows.limit(0)).columns == list(sinks.DUMP_COLUMNS)


def test_filters_from_parameters():
    good = Filters.from_params({"grain": "cycle", "period": "1997-07-30", "minimum": "10.5", "internal": "hide", "manual": "1", "first": "", "other": "x"})
    assert (good.grain, good.period, good.minimum, good.internal, good.manual, good.issues) == ("cycle", dt.date(1997, 7, 30), 10.5, "hide", True, ())
    assert good.scope() == ("cycle_start", dt.date(1997, 7, 25), dt.date(1997, 7, 25))
    bad = Filters.from_params({"grain": "year", "minimum": "-1", "first": "1997-13-01", "type": "gift"})
    assert set(bad.issues) == {"grain", "minimum", "first", "type"}
    turned = Filters.from_params({"first": "1997-08-01", "last": "1997-07-01"})
    assert turned.scope() == ("local_day", dt.date(1997, 7, 1), dt.date(1997, 8, 1))


def test_periods_agree_in_sql_and_plain_dates(spark):
    periods.register_sql(spark)
    days = spark.range(1500).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("d"))
    rows = days.select("d", F.expr("period_start(d)").alias("a"), F.expr("period_end(d)").alias("b"), F.expr("week_start(d)").alias("w"), F.expr("local_date(CAST(d AS TIMESTAMP_NTZ) + INTERVAL 22 HOURS)").alias("l"), F.expr("effective_cycle(CAST(d AS TIMESTAMP_NTZ), NULL)").alias("e")).collect()
    for r in rows:
        assert (r["a"], r["b"]) == periods.bounds("cycle", r["d"]) and r["w"] == periods.bounds("week", r["d"])[0]
        assert r["l"] == r["d"] + dt.timedelta(days=1) and r["e"] == r["a"]
    assert periods.stepped("cycle", dt.date(2024, 1, 3), 2) == dt.date(2024, 2, 25) and periods.stepped("week", dt.date(2024, 1, 3), -1) == dt.date(2023, 12, 24)
    assert periods.reanchored("week", dt.date(2024, 1, 30), dt.date(2024, 2, 8)) == dt.date(2024, 2, 4)
    assert periods.reanchored("cycle", dt.date(2024, 1, 30), dt.date(2024, 6, 8)) == dt.date(2024, 1, 25)


def test_salary_cycles(spark):
    rows = spark.createDataFrame([("01/05", dt.date(2026, 12, 28)), ("07/27", dt.date(2026, 7, 20))], "due string, got date")
    assert [r[0] for r in rows.select(periods.salary_cycle("due", "got")).collect()] == [dt.date(2026, 12, 25), dt.date(2026, 7, 25)]
    snapped = rows.select(periods.snapped_cycle("got")).collect()
    assert [r[0] for r in snapped] == [dt.date(2026, 12, 25), dt.date(2026, 7, 25)]


def test_a_rule_from_a_transaction():
    assert review.rule_of({"merchant_raw": " Shop ", "category_id": 3}) == {"match": [{"field": "merchant_raw", "operator": "equals", "value": "Shop"}], "actions": {"set_category": 3}}
    assert review.rule_of({"biller": "Water"})["match"][0]["field"] == "biller" and review.rule_of({"merchant_raw": ""}) is None
