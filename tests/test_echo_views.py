"""Echoes over views of time: edges change nothing, and rows are small."""

from __future__ import annotations

import datetime as dt
import random

from tally.operators import linking

AT = dt.datetime(2026, 3, 1)
SCHEMA = "message_id long, institution string, ts timestamp_ntz, account string, direction string, amount decimal(14,2)"


def _legs(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(k, inst, AT + dt.timedelta(seconds=s), account, direction, Decimal(5)) for k, inst, s in rows for account, direction in (("a", "debit"), ("b", "credit"))], SCHEMA)


def test_echoes_over_views(spark):
    """Twelve hours with messages on and about the edges of views: as one pass in time order."""
    rng = random.Random(2)
    edges = [k * 4800 + x for k in range(9) for x in (-601, -600, -301, -300, -299, -1, 0, 1, 299, 300, 301, 599, 600, 601)]
    rows = [(k, rng.choice("XYZ"), s % 43_200) for k, s in enumerate(edges + [rng.randrange(43_200) for _ in range(250)])]
    kept, wanted = [], set()
    for k, inst, s in sorted(rows, key=lambda r: (r[2], r[0])):
        of = next((x for x in kept if x[1] != inst and s - x[2] <= 300), None)
        if of:
            wanted.add((of[0], k))
        else:
            kept.append((k, inst, s))
    assert {tuple(r) for r in linking.echoes(_legs(spark, rows)).collect()} == wanted


def test_rows_are_small(spark, monkeypatch):
    """What is sorted and joined has the digest of a message's legs; before, all their text."""
    seen, plain = [], linking.settled
    monkeypatch.setattr(linking, "settled", lambda df: seen.append(df.schema) or plain(df))
    linking.echoes(_legs(spark, [(k, "XY"[k % 2], 60 * k) for k in range(10)])).collect()
    assert seen[0]["signature"].dataType.simpleString() == "binary"
