import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from tally.functions import forms, text
from tally.operators import linking, parser
from tally.streaming import ingest

AT = dt.datetime(2026, 7, 20, 14, 30)
OWNED = [("SAIB", "1111", "current"), ("SAIB", "2222", "savings"), ("AlRajhiBank", "0256", "card"), ("STC Bank", "318", "stc")]


@pytest.fixture(scope="module")
def parse(spark):
    def run(*messages, **options):
        raw = spark.createDataFrame([(k, *m) for k, m in enumerate(messages)], "id long, sender string, body string, received_at timestamp_ntz")
        return parser.parsed_messages(raw, spark.createDataFrame(OWNED, "sender string, value string, account string"), **options).orderBy("id").collect()

    return run


def test_forms_match_texts_made_from_them(spark):
    """A text built from each form is read as that form with the same values."""
    values = {n: "12.50" for n in ("amount", "balance", "fee", "original", "converted", "vat")} | {n: "1234" for n in ("card", "to", "from", "counterparty_account")} | {"reference": "R1", "currency": "USD", "rate": "3.75", "country": "US", "invoice": "77", "due": "07/25", "date": "20/7/26 14:00", "clock": "14:00"}
    rows = []
    for form in forms.FORMS:
        body = form.text
        for name in form.parts()[1]:
            body = body.replace("{" + name + "}", values.get(name, "Some Name"))
        rows.append((form.id, form.sender, body))
    df = spark.createDataFrame(rows, "id string, sender string, norm string")
    df = df.withColumn("number", forms.form_number(F.col("norm"), F.col("sender")))
    got = {r["id"]: r for r in df.withColumn("f", forms.form_values(F.col("norm"), F.col("number"))).collect()}
    for form in forms.FORMS:
        assert forms.FORMS[got[form.id]["number"]].id == form.id
        assert got[form.id]["f"] == {n: values.get(n, "Some Name") for n in form.parts()[1]}


def test_outcomes(parse):
    rows = parse(
        ("SAIB", "حوالة صادرة: بين حساباتك\nمن: X1111\nمبلغ: SAR 50\nإلى: X2222\nفي: 07-20 14:00", AT),
        ("SAIB", "قيد راتب دائن 9,000.00 SAR في 13:00 20-07\nحساب 1111 تاريخ استحقاق 07/25", AT),
        ("AlRajhiBank", "OTP 1234 for 99 SAR", AT),
        ("Zid", "شراء", AT),
        ("AlRajhiBank", "شراء انترنت بSAR 20\nعبر0256;visa\nلShop\nرصيد: 5 SAR\n21/7/26 14:00", AT),
        ("AlRajhiBank", "شراء انترنت بSAR 20\nعبر0256;visa\nلShop\nرصيد: 5 SAR\n1/7/26 14:00", AT),
        ("SAIB", None, AT),
    )
    assert [r["status"] for r in rows] == ["parsed", "parsed", "ignored", "ignored", "needs_review", "needs_review", "needs_review"]
    assert [(x["account"], x["direction"], x["is_internal"]) for x in rows[0]["legs"]] == [("current", "debit", True), ("savings", "credit", True)]
    assert rows[1]["cycle_start"] == dt.date(2026, 7, 25)  # the due date, not the day of payment
    assert rows[4]["error"] == "date: after received_at" and rows[5]["error"] == "date: too far before received_at"


def test_backfill_and_new_year(parse):
    old = parse(("AlRajhiBank", "شراء انترنت بSAR 20\nعبر0256;visa\nلShop\nرصيد: 5 SAR\n1/7/26 14:00", AT), backfill=True)
    assert old[0]["status"] == "parsed"
    turn = parse(("SAIB", "حوالة صادرة: بين حساباتك\nمن: 1111\nمبلغ: SAR 50\nالى: 2222\nفي: 12-31 23:50", dt.datetime(2027, 1, 1, 0, 10)))
    assert turn[0]["posted_at"] == dt.datetime(2026, 12, 31, 23, 50)


def test_shapes_ignore_amounts_and_merchants(spark):
    bodies = ["شراء\nلدى: Shop One\nمبلغ: 10.00 SAR", "شراء\nلدى: Other\nمبلغ: 7 ر.س", "شراء\nمن: Other\nمبلغ: 7 SAR"]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string").select("k", text.shape_hash(text.normalized(F.col("b"))).alias("h")).orderBy("k").collect()
    assert rows[0]["h"] == rows[1]["h"] != rows[2]["h"]


def _legs(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(k, rng.choice(["wallet_topup", "purchase"]), str(rng.randrange(2)), float(rng.randrange(2) + 1), AT + dt.timedelta(seconds=rng.randrange(4000)), False) for k in range(80)]
    return rows, spark.createDataFrame(rows, "id long, kind string, card string, amount double, ts timestamp_ntz, is_internal boolean")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_topups_equal_brute_force(spark, seed):
    rows, df = _legs(spark, seed)
    taken, expected = set(), set()
    for t in sorted((r for r in rows if r[1] == "wallet_topup"), key=lambda r: (r[4], r[0])):
        fit = [p for p in rows if p[1] == "purchase" and p[0] not in taken and p[2:4] == t[2:4] and abs(p[4] - t[4]) <= dt.timedelta(minutes=5)]
        if fit:
            best = min(fit, key=lambda p: (abs(p[4] - t[4]), p[4], p[0]))
            taken.add(best[0])
            expected.add((t[0], best[0]))
    for rows_a_block in (1, 7, linking.BLOCK_ROWS):  # cut in every slot, now and then, not at all
        assert {tuple(r) for r in linking.topup_pairs(df, block_rows=rows_a_block).collect()} == expected
    linked = linking.linked_topups(df, spark.createDataFrame([("0",), ("1",)], "card string"))
    assert linked.count() == 80 and linked.where("kind = 'wallet_topup' AND NOT is_internal").isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_echoes_equal_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    told = [(k, rng.choice("ABC"), AT + dt.timedelta(seconds=rng.randrange(3000)), float(rng.randrange(2))) for k in range(60)]
    legs = [(f"{k}{d}", k, i, ts, account, d, a) for k, i, ts, a in told for account, d in (("x", "debit"), ("y", "credit"))]
    df = spark.createDataFrame(legs, "id string, message_id long, institution string, ts timestamp_ntz, account string, direction string, amount double")
    kept, expected = [], set()
    for m in sorted(told, key=lambda m: (m[2], m[0])):
        first = next((k for k in kept if k[3] == m[3] and k[1] != m[1] and m[2] - k[2] <= dt.timedelta(minutes=5)), None)
        expected.add((first[0], m[0])) if first else kept.append(m)
    pairs = linking.echoes(df)
    assert {tuple(r) for r in pairs.collect()} == expected
    assert linking.superseded_legs(df, pairs).count() == 2 * len(expected)


def test_chains_across_blocks_are_as_one_pass_has_them(spark):
    """Purchases midway between top-ups: each choice hangs on the one before, along the whole chain and over every edge of a block."""
    rows = [(k, "purchase" if k % 2 else "wallet_topup", "0", 1.0, AT + dt.timedelta(seconds=50 * k), False) for k in range(160)]
    df = spark.createDataFrame(rows, "id long, kind string, card string, amount double, ts timestamp_ntz, is_internal boolean")
    assert {tuple(r) for r in linking.topup_pairs(df, block_rows=10).collect()} == {(k, k + 1) for k in range(0, 160, 2)}


def test_a_long_chain_of_echoes(spark):
    """Two institutions that tell of everything by turns: the first's are kept along the whole chain, found in a few rounds."""
    told = [(k, "AB"[k % 2], AT + dt.timedelta(seconds=70 * k)) for k in range(400)]
    legs = [(f"{k}{d}", k, i, ts, account, d, 5.0) for k, i, ts in told for account, d in (("x", "debit"), ("y", "credit"))]
    df = spark.createDataFrame(legs, "id string, message_id long, institution string, ts timestamp_ntz, account string, direction string, amount double")
    expected = {(max(k - 3, 0), k) for k in range(1, 400, 2)}
    assert {tuple(r) for r in linking.echoes(df).collect()} == expected
    odd = spark.createDataFrame([(f"{k}{d}", k, i, ts, account, d, 5.0) for k, i, ts in ((1, None, AT), (2, "A", AT), (2, "A", AT), (3, "B", AT), (4, None, None)) for account, d in (("x", "debit"), ("y", "credit"))], df.schema)
    assert {tuple(r) for r in linking.echoes(odd).collect()} == {(1, 3)}
    assert linking.echoes(odd.limit(0)).isEmpty() and linking.topup_pairs(_legs(spark, 1)[1].limit(0)).isEmpty()


def test_stream_writes_each_message_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    one = {"id": "1", "sender": "SAIB", "body": "حوالة صادرة: بين حساباتك\nمن: 1111\nمبلغ: SAR 50\nالى: 2222\nفي: 07-20 14:00", "received_at": "2026-07-20T11:30:00Z"}
    (source / "a.json").write_text(json.dumps(one) + "\n" + json.dumps(one | {"id": "2"}) + "\n")
    owned = spark.createDataFrame(OWNED, "sender string, value string, account string")

    def run():
        ingest.run(ingest.message_stream(spark, str(source)), owned, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()

    run()
    (source / "b.json").write_text(json.dumps(one | {"id": "3"}) + "\n")
    run()
    assert spark.read.parquet(str(tmp_path / "out/messages")).count() == 1
    assert {(r["account"], float(r["amount"])) for r in spark.read.parquet(str(tmp_path / "out/legs")).collect()} == {("current", 50.0), ("savings", 50.0)}


def test_a_second_run_links_nothing_anew(spark):
    """A top-up that has its purchase takes no other, and a purchase that comes late finds a top-up that waited."""
    row = lambda k, kind, seconds: (k, kind, "0256", 12.0, AT + dt.timedelta(seconds=seconds), False)
    schema, cards = "id long, kind string, card string, amount double, ts timestamp_ntz, is_internal boolean", spark.createDataFrame([("0256",)], "card string")
    first = linking.linked_topups(spark.createDataFrame([row(1, "wallet_topup", 0), row(2, "purchase", 10), row(3, "purchase", 20), row(4, "wallet_topup", 4000)], schema), cards)
    state = {r["id"]: (r["is_internal"], r["transfer_group"]) for r in first.collect()}
    assert state == {1: (True, "tg-1"), 2: (True, "tg-1"), 3: (False, None), 4: (True, None)}
    assert {r["id"]: (r["is_internal"], r["transfer_group"]) for r in linking.linked_topups(first, cards).collect()} == state
    late = first.unionByName(spark.createDataFrame([row(5, "purchase", 4100)], schema), allowMissingColumns=True)
    again = {r["id"]: (r["is_internal"], r["transfer_group"]) for r in linking.linked_topups(late, cards).collect()}
    assert again == state | {4: (True, "tg-4"), 5: (True, "tg-4")}


def test_strict_pairs_of_equal_amounts(spark):
    """Seven legs of one amount in seven minutes: three transfers, and a bill that pairs with none."""
    at = lambda m: dt.datetime(2026, 8, 9, 21, m)
    rows = [(1, "transfer", "savings", "debit", 113.0, at(38), "current"), (2, "transfer", "current", "credit", 113.0, at(38), "savings"), (3, "bill_payment", "current", "debit", 113.0, at(39), None), (4, "transfer", "wallet", "debit", 113.0, at(44), "current"), (5, "transfer", "current", "credit", 113.0, at(44), "wallet"), (6, "transfer", "current", "debit", 113.0, at(45), "savings"), (7, "transfer", "savings", "credit", 113.0, at(45), "current")]
    legs = spark.createDataFrame(rows, "id long, kind string, account string, direction string, amount double, ts timestamp_ntz, counterparty string")
    assert {tuple(r) for r in linking.strict_pairs(legs).collect()} == {(1, 2), (4, 5), (6, 7)}


def test_stream_links_legs_of_different_batches(spark, tmp_path):
    """A top-up and its purchase, and two banks' words on one transfer, come in different batches; a third run changes nothing."""
    source = tmp_path / "in"
    source.mkdir()
    topup = {"id": "1", "sender": "barq app", "body": "إضافة أموال\n50 ر.س\nالبطاقة: 0256 , مدى\n2026-07-20 14:00", "received_at": "2026-07-20T11:01:00Z"}
    purchase = {"id": "2", "sender": "AlRajhiBank", "body": "شراء عبر نقاط البيع\nبطاقة:0256 ;مدى\nلدى:Wallet\nمبلغ:50 SR\nرصيد:1,000.50 SAR\n20/7/26 14:02", "received_at": "2026-07-20T11:03:00Z"}
    long = {"id": "3", "sender": "AlRajhiBank", "body": "x" * 4001, "received_at": "2026-07-20T11:03:00Z"}
    owned = spark.createDataFrame([("AlRajhiBank", "0256", "card"), ("barq app", "0256", "card")], "sender string, value string, account string")

    def run(name, *rows):
        (source / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        ingest.run(ingest.message_stream(spark, str(source)), owned, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
        return {r["raw_message_id"]: (r["is_internal"], r["transfer_group"]) for r in ingest.current_legs(spark, str(tmp_path / "out")).collect()}

    first = run("a.json", topup, long)
    assert first == {"1": (True, None)}
    second = run("b.json", purchase)
    group = second["1"][1]
    assert group and second == {"1": (True, group), "2": (True, group)}
    assert run("c.json", topup | {"id": "4"}, topup | {"id": "5", "received_at": "2026-07-20T12:30:00Z"})["2"] == (True, group)


def test_counter_legs(parse):
    """A card's payment comes out of the account that funds it, a redeemed cashback out of its wallet."""
    paid = ("AlRajhiBank", "بطاقة فيزا:سداد بSAR 300\nعبر0256;فيزا\nرصيد: 5 SAR\n20/7/26 14:00", AT)
    redeemed = ("AlRajhiBank", "استرداد نقدي إلى البطاقة:\nتم استرداد و اضافة 12.5 SAR مبلغ الاسترداد النقدي الى رصيد بطاقتك 0256", AT)
    legs = lambda r: [(x["account"], x["direction"], x["is_internal"], float(x["amount"])) for x in r["legs"]]
    rows = parse(paid, redeemed, funding_account="current")
    assert legs(rows[0]) == [("card", "credit", True, 300.0), ("current", "debit", True, 300.0)]
    assert legs(rows[1]) == [("card", "credit", True, 12.5), ("cashback_wallet", "debit", True, 12.5)]
    assert legs(parse(paid)[0]) == [("card", "credit", False, 300.0)]
    assert (rows[0]["snapshot"]["account"], float(rows[0]["snapshot"]["balance"])) == ("card", 5.0)


def test_weekly_spend_of_a_stream(spark, tmp_path):
    """Weeks are told when they are over; a leg that comes within the time for late ones still counts."""
    schema = "account string, direction string, is_internal boolean, amount double, posted_at timestamp"
    leg = lambda day, amount, direction="debit": {"account": "a", "direction": direction, "is_internal": False, "amount": amount, "posted_at": f"2026-07-{day:02d}T12:00:00Z"}
    source = tmp_path / "legs"
    source.mkdir()
    stream = ingest.weekly_spend(spark.readStream.schema(schema).json(str(source)))
    for name, rows in (("a", [leg(6, 10.0), leg(7, 5.0, "credit"), leg(13, 1.0)]), ("b", [leg(8, 2.5)]), ("c", [leg(27, 4.0)]), ("d", [leg(28, 4.0)])):
        (source / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["week"], r["spent"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (dt.date(2026, 7, 5), 12.5) in got and (dt.date(2026, 7, 12), 1.0) in got


def _stream(spark, folder, **options):
    """Runs the stream over what lies in folder/in; rows are added as a file of their own."""
    owned = spark.createDataFrame(OWNED, "sender string, value string, account string")
    (folder / "in").mkdir(exist_ok=True)

    def run(name, *rows):
        (folder / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        ingest.run(ingest.message_stream(spark, str(folder / "in")), owned, str(folder / "out"), str(folder / "state"), once=True, **options).awaitTermination()

    return run


def _newest(folder):
    return str(max(folder.iterdir(), key=lambda p: int(p.name.removeprefix("batch="))))


def _moved(k, day=20, amount=50):
    return {"id": str(k), "sender": "SAIB", "body": f"حوالة صادرة: بين حساباتك\nمن: 1111\nمبلغ: SAR {amount}\nالى: 2222\nفي: 07-{day} 14:00", "received_at": f"2026-07-{day}T11:{k % 60:02d}:00Z"}


def test_a_message_that_fails_is_tried_thrice(spark, tmp_path):
    """One bad message of twelve holds up no other, waits twice, then has failed; what is sent again is not taken anew."""

    def parse(rows, *args, **options):
        made = parser.parsed_messages(rows, *args, **options)
        return made.withColumn("error", F.when(F.contains("body", F.lit("SAR 666")), F.raise_error(F.lit("no such amount"))).otherwise(F.col("error")))

    run = _stream(spark, tmp_path, parse=parse)
    messages = lambda: {r["id"]: (r["status"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out/messages")).collect()}
    waiting = lambda: [(r["id"], r["status"], r["attempts"] in (1, 2), "no such amount" in r["last_error"]) for r in spark.read.parquet(_newest(tmp_path / "out/queue")).collect()]
    bad = _moved(5, amount=666)
    run("a.json", *(_moved(k) for k in range(10, 21)), bad)
    assert set(messages()) == {str(k) for k in range(10, 21)} and waiting() == [("5", "pending", True, True)]
    run("b.json", _moved(30), bad | {"id": "99"})
    run("c.json", _moved(31))
    found = messages()
    assert found["5"][0] == "failed" and "no such amount" in found["5"][1] and waiting() == []
    assert [r["attempts"] for r in spark.read.parquet(str(tmp_path / "out/messages")).where("id = '5'").collect()] == [3]
    assert {s for k, (s, _) in found.items() if k != "5"} == {"parsed"} and len(found) == 14
    assert spark.read.parquet(str(tmp_path / "out/legs")).count() == 26
    run("e.json", bad | {"id": "100"})
    assert set(messages()) == set(found)


def test_parts_that_fail_whole_are_put_off(spark, tmp_path, monkeypatch):
    """When all messages fail, a batch spends its jobs and no more; what it did not look at counts no attempt."""
    monkeypatch.setattr(ingest, "HALVINGS", 3)

    def broken(rows, *args, **options):
        return parser.parsed_messages(rows, *args, **options).withColumn("error", F.raise_error(F.lit("broken")).cast("string"))

    _stream(spark, tmp_path, parse=broken)("a.json", *(_moved(k) for k in range(20)))
    rows = spark.read.parquet(_newest(tmp_path / "out/queue")).collect()
    assert sorted(int(r["id"]) for r in rows) == list(range(20)) and {r["status"] for r in rows} == {"pending"} and min(r["attempts"] for r in rows) == 0
    _stream(spark, tmp_path)("b.json", _moved(40))
    assert spark.read.parquet(str(tmp_path / "out/messages")).where("status = 'parsed'").count() == 21


def test_no_message_is_too_late(spark, tmp_path):
    """One that arrived long before those of an earlier batch is parsed, one that tells of a time days before its arrival is in review."""
    run = _stream(spark, tmp_path)
    run("a.json", _moved(1, day=20), _moved(2, day=21))
    run("b.json", _moved(3, day=21) | {"received_at": "2026-07-21T23:00:00Z"})
    run("c.json", _moved(4, day=11), _moved(5, day=17) | {"received_at": "2026-07-20T19:00:00Z"})
    run("d.json", _moved(4, day=11) | {"id": "6"})
    found = {r["id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out/messages")).collect()}
    assert found == {"1": "parsed", "2": "parsed", "3": "parsed", "4": "parsed", "5": "needs_review"}


def test_no_code_is_written(spark, tmp_path):
    """No column of any folder holds a digit of a one-time code."""
    run = _stream(spark, tmp_path)
    run("a.json", {"id": "1", "sender": "AlRajhiBank", "body": "رمز التحقق: 778899 لمبلغ ٥٠ SAR", "received_at": "2026-07-20T11:30:00Z"}, {"id": "2", "sender": "SAIB", "body": "OTP 778899 to login", "received_at": "2026-07-20T11:31:00Z"}, _moved(3))
    stored = spark.read.parquet(str(tmp_path / "out/messages"))
    assert {(r["id"], r["body"], r["norm"]) for r in stored.where("id < 3").collect()} == {(k, parser.REDACTED, parser.REDACTED) for k in "12"}
    for folder in ("messages", "legs", "snapshots", "links", "recent", "queue"):
        if (tmp_path / "out" / folder).exists():
            rows = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out" / folder)).drop("body_hash", "shape")
            assert not any("778899" in str(r) for r in rows.collect()), folder


def test_a_batch_reads_no_history(spark, tmp_path):
    """Batches after the first give the same when all but the last days' state and the day of arrival is gone."""
    import shutil

    run = _stream(spark, tmp_path)
    topup = {"id": "1", "sender": "barq app", "body": "إضافة أموال\n50 ر.س\nالبطاقة: 0256 , مدى\n2026-07-20 14:00", "received_at": "2026-07-20T11:01:00Z"}
    run("a.json", _moved(7, day=10), _moved(8, day=11))
    run("b.json", _moved(9, day=19), topup)
    old = {r["id"] for r in spark.read.parquet(_newest(tmp_path / "out/recent")).select("raw_message_id").withColumnRenamed("raw_message_id", "id").collect()}
    assert old == {"1", "9"}  # legs of ten days before are no state
    for name in ("messages/day=2026-07-10", "messages/day=2026-07-11", "messages/day=2026-07-19", "legs", "links", "snapshots"):
        shutil.rmtree(tmp_path / "out" / name, ignore_errors=True)
    purchase = {"id": "2", "sender": "AlRajhiBank", "body": "شراء عبر نقاط البيع\nبطاقة:0256 ;مدى\nلدى:Wallet\nمبلغ:50 SR\nرصيد:1,000.50 SAR\n20/7/26 14:02", "received_at": "2026-07-20T11:03:00Z"}
    owned = OWNED + [("barq app", "0256", "card")]
    (tmp_path / "in/c.json").write_text(json.dumps(purchase) + "\n" + json.dumps(topup | {"id": "3"}) + "\n")
    ingest.run(ingest.message_stream(spark, str(tmp_path / "in")), spark.createDataFrame(owned, "sender string, value string, account string"), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    links = {r["id"]: (r["is_internal"], r["transfer_group"]) for r in spark.read.parquet(str(tmp_path / "out/links")).collect()}
    assert len(links) == 2 and len({g for _, g in links.values()}) == 1 and all(i for i, _ in links.values())
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out/messages")).collect()} == {"1", "2"}
    assert not (tmp_path / "out/recent/batch=0").exists()
