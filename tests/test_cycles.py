"""Totals by salary cycle over a stream: told at a cycle's end, amended by what comes late."""

from __future__ import annotations

import datetime as dt
import random

from tally.functions import periods
from tally.operators import metrics
from tally.streaming import cycles

SCHEMA = "transaction_id long, direction string, type string, state string, is_internal boolean, excluded boolean, amount decimal(14,2), local_day date, cycle_start date, note string"


def _leg(k, day, amount, direction="debit", kind="purchase", **other):
    return {"transaction_id": k, "direction": direction, "type": kind, "state": "posted", "is_internal": False, "excluded": False, "amount": amount, "local_day": day, "cycle_start": periods.cycle_of(day) if day else None} | other


def _stream(spark, folder):
    """Takes the rows given as one batch."""
    (folder / "in").mkdir()

    def run(name, *legs):
        spark.createDataFrame([{c.split()[0]: leg.get(c.split()[0]) for c in SCHEMA.split(", ")} for leg in legs], SCHEMA.replace("decimal(14,2)", "double")).selectExpr("* EXCEPT (amount)", "CAST(amount AS DECIMAL(14,2)) AS amount").coalesce(1).write.parquet(str(folder / "in" / name))
        rows = spark.readStream.schema(SCHEMA).parquet(str(folder / "in/*"))
        cycles.run(rows, str(folder / "out"), str(folder / "state"), once=True).awaitTermination()

    return run


def test_cycles_are_told_and_amended(spark, tmp_path):
    """A cycle waits a week after its end, is told once, and a leg that comes later amends it and is in late."""
    run, out = _stream(spark, tmp_path), str(tmp_path / "out")
    day = lambda m, d: dt.date(2026, m, d)
    told = lambda: {(str(r["cycle_start"]), float(r["expense"]), float(r["earned"]), r["legs"], r["late_legs"]) for r in cycles.told_cycles(spark, out).collect()}
    run("a", _leg(1, day(7, 20), 10.25), _leg(2, day(7, 25), 4.0), _leg(3, day(7, 31), 900.0, "credit", "income"))
    assert told() == set()  # the cycle that ended on 24 July waits until 31 July is over
    run("b", _leg(4, day(7, 24), 1.5), _leg(5, day(8, 1), 7.0, is_internal=True))
    assert told() == {("2026-06-25", 11.75, 0.0, 2, 0)}
    run("c", _leg(6, day(7, 1), 2.0), _leg(7, None, 3.0), _leg(8, day(8, 2), 5.0, "credit", "income", cycle_start=day(6, 25)))
    assert told() == {("2026-06-25", 13.75, 5.0, 4, 2)}
    assert {r["transaction_id"] for r in spark.read.parquet(f"{out}/late").collect()} == {6, 7, 8}
    run("d", _leg(9, day(12, 1), 1.0))
    assert told() == {("2026-06-25", 13.75, 5.0, 4, 2), ("2026-07-25", 4.0, 900.0, 3, 0)}
    flow = {r["bucket"]: (r["earned"], r["passive"], r["expense"]) for r in cycles.flow_so_far(spark, out).collect()}
    assert flow == {"2026-06-25": (5.0, 0.0, 13.75), "2026-07-25": (900.0, 0.0, 4.0), "2026-11-25": (0.0, 0.0, 1.0)}


def test_a_batch_again_and_any_order(spark, tmp_path):
    """Legs in any order and batches that run again give the sums of all legs at once; an empty batch moves nothing."""
    rng, out = random.Random(4), str(tmp_path / "out")
    legs = [_leg(k, dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(400)), rng.randrange(1, 10**6) / 100, *rng.choice([("debit", "purchase"), ("credit", "income"), ("credit", "profit"), ("debit", "card_payment")])) for k in range(300)]
    rows = spark.createDataFrame([{c.split()[0]: leg.get(c.split()[0]) for c in SCHEMA.split(", ")} for leg in legs], SCHEMA.replace("decimal(14,2)", "double")).selectExpr("* EXCEPT (amount)", "CAST(amount AS DECIMAL(14,2)) AS amount").cache()
    write = cycles.write_cycles(out)
    for number in range(4):
        for _ in range(1 + number % 2):
            write(rows.where(f"transaction_id % 3 = {number}"), number)
    whole = {tuple(r) for r in metrics.flow_by_bucket(rows, "cycle").collect()}
    assert {tuple(r) for r in cycles.flow_so_far(spark, out).collect()} == whole and len(whole) > 12
    late, amended = spark.read.parquet(f"{out}/late").count(), cycles.told_cycles(spark, out).agg({"late_legs": "sum"}).first()[0]
    assert late == amended > 0
