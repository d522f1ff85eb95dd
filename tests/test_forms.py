"""Forms that people derive from a message, shapes of messages, and fields read by their labels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tally.functions import derive, text
from tally.functions import forms as M

RECEIPT = "رسوم خدمة\nالقيمة 812.05 SAR\nالمتبقي 96.10\nالمتجر NORTH PIER BOOKS\n2025-11-03 09:41"
FOUND = {"amount": "812.05", "balance": "96.10", "merchant": "NORTH PIER BOOKS", "date": "2025-11-03 09:41"}


def _made(body=RECEIPT, kind="purchase", direction="debit", date=M.ISO, account="wallet", **marks):
    """A form of the receipt; a mark given as None is left out."""
    marks = {k: v for k, v in (FOUND | marks).items() if v is not None}
    return derive.derived_form("N1", "barq app", body, marks, kind, direction, date=date, account=account)


def test_marks_become_fields_and_the_rest_stays():
    form = _made()
    first, price, left, shop, when = form.text.split("\n")
    assert (first, price, left, shop, when) == ("رسوم خدمة", "القيمة {amount} SAR", "المتبقي {balance}", "المتجر {merchant}", "{date}")


@pytest.mark.parametrize("shop,price", [("A", "1"), ("OLD MILL & SONS", "40,000.99"), ("7 DAYS", "0.05")])
def test_a_form_reads_what_differs_in_its_fields_only(shop, price):
    sent = RECEIPT.replace("NORTH PIER BOOKS", shop).replace("812.05", price)
    assert derive.values_of(_made(), sent) == FOUND | {"merchant": shop, "amount": price}
    for other in ("x\n" + sent, sent + "\nx", sent.replace("المتبقي", "رصيد"), sent.replace("\n", " ")):
        assert derive.values_of(_made(), other) is None


def test_a_mark_has_one_place():
    """It must stand in the text, once, and apart from the other marks; without an amount there is no form."""
    with pytest.raises(derive.NotDerivable):
        _made(merchant="SOUTH PIER")
    with pytest.raises(derive.NotDerivable):
        _made(body=RECEIPT + "\n812.05")
    with pytest.raises(derive.NotDerivable):
        _made(merchant="96.10")
    with pytest.raises(derive.NotDerivable):
        _made(amount=None)
    with pytest.raises(derive.NotDerivable):
        _made(weather="SAR")


@pytest.mark.parametrize("wrong", [{"kind": ""}, {"direction": "up"}, {"account": None}])
def test_a_form_says_what_it_books(wrong):
    with pytest.raises(derive.NotDerivable):
        _made(**wrong)


STORED = "id string, sender string, kind string, direction string, date string, text string, account string, shape string, created_at int"


def test_rows_that_are_no_form_are_left_out(spark):
    good = derive.as_row(_made(), "s", 2)
    wrong = ({"text": "{unknown} {amount}"}, {"text": "{amount} {amount}"}, {"text": "{amount} {x"}, {"text": "no field"}, {"text": None}, {"direction": "up"}, {"date": "week w"}, {"sender": None})
    rows = [good, good | {"id": "A", "created_at": 1, "date": None}, *(good | {"id": f"W{k}"} | change for k, change in enumerate(wrong))]
    kept = derive.form_index(spark.createDataFrame(rows, STORED)).select("form.id", "lines", "line", "words").orderBy("place").collect()
    assert [tuple(r) for r in kept] == [("A", 5, 1, "رسومخدمة"), ("N1", 5, 1, "رسومخدمة")]


def test_each_text_is_read_by_the_first_form_that_fits(spark):
    """Forms of signs and of no line of their own among them; against each form's own pattern, tried in the order they were made."""
    rows = [
        M.Form("later", "s", "purchase", "debit", None, "Paid (a+b) $5\nsum {amount} SAR\nat {merchant}", None, True),
        M.Form("first", "s", "purchase", "debit", None, "Paid (a+b) $5\nsum {amount} SAR\nat {merchant}", None, True),
        M.Form("fields", "s", "purchase", "debit", None, "sum {amount} SAR\nat {merchant}", None, True),
        M.Form("other", "t", "purchase", "debit", None, "sum {amount} SAR\nat {merchant}", None, True),
        M.Form("two", "s", "purchase", "debit", None, "{merchant} {amount}\nbalance of [you] {balance}\nthe end.", None, True),
    ]
    made = {f.id: n for n, f in zip((4, 1, 2, 3, 5), rows)}
    forms = sorted(rows, key=lambda f: made[f.id])
    texts = ["Paid (a+b) $5\nsum 7.50 SAR\nat Old Mill", "Paid  (a+b)  $5\nsum 7 SAR\nat  X", "Paid aab $5\nsum 7 SAR\nat X", "sum 1,000 SAR\nat Y", "sum 1,000 SAR\nat Y\nmore", "Cafe 12\nbalance of [you] 3.5\nthe end.", "Cafe 12\nbalance of y 3.5\nthe end.", ""]
    asked = [(s, t) for s in "stu" for t in texts] * 2 + [("s", None), (None, texts[0])]
    stored = spark.createDataFrame([derive.as_row(f, "x", made[f.id]) for f in rows], STORED)
    found = derive.form_matches(spark.createDataFrame(asked, "sender string, norm string"), stored)
    expected = {}
    for sender, norm in asked:
        read = next(((f.id, v) for f in forms if norm and f.sender == sender and (v := derive.values_of(f, norm)) is not None), None)
        if read:
            expected[sender, norm] = read
    got = found.select("sender", "norm", "form.id", "said").collect()
    assert len(got) == len(expected) and {(r[0], r[1]): (r[2], r[3]) for r in got} == expected and len(expected) == 5
    assert derive.form_matches(spark.createDataFrame([], "sender string, norm string"), stored).isEmpty() and derive.form_matches(spark.createDataFrame(asked, "sender string, norm string"), stored.limit(0)).isEmpty()


def test_five_thousand_forms(spark):
    """They are a table, so that a plan stays the same however many there are; each message meets those that have one of its lines."""
    forms = spark.range(5000).select(F.concat(F.lit("F"), F.col("id")).alias("id"), F.lit("s").alias("sender"), F.lit("purchase").alias("kind"), F.lit("debit").alias("direction"), F.lit(None).cast("string").alias("date"), F.concat(F.lit("notice no. "), F.col("id"), F.lit("\nsum {amount} SAR\nat {merchant}")).alias("text"), F.lit("wallet").alias("account"), F.lit("x").alias("shape"), F.col("id").cast("int").alias("created_at"))
    k = F.col("id") % 6000
    texts = spark.range(20000).select(F.lit("s").alias("sender"), F.concat(F.lit("notice no. "), k, F.lit("\nsum "), F.col("id"), F.lit(" SAR\nat X"), k).alias("norm"))
    found = derive.form_matches(texts, forms)
    got = found.select(F.substring("form.id", 2, 9).cast("int").alias("k"), F.col("said.amount").cast("int").alias("sum"), F.col("said.merchant").alias("shop"))
    assert got.count() == 15000 + 2000 and got.where("k <> sum % 6000 OR shop <> concat('X', k)").isEmpty()


#: Message -> its shape.
SHAPES = {
    "Receipt\nSum 88.25 SAR to Tea-House & Co": "Receipt T # SAR T",
    "شراء\nبطاقة:XX1111;مدى\nمبلغ 1,000.00 SAR": "شراء بطاقة X # مدي مبلغ # SAR",
    "المبلغ 5\nالرصيد 6": "مبلغ # رصيد #",
    "Xbox **12": "Xbox X #",
    "a1b2": "a # b #",
    "": "",
    " ;,. ": "",
}


def test_shapes(spark):
    rows = spark.createDataFrame([(k, body) for k, body in enumerate(SHAPES)], "k int, body string")
    got = rows.select("k", text.shape_text(text.normalized(rows["body"])).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == list(SHAPES.values())


#: Text -> what stands after "من", and the amount by the labels.
LABELS = {
    "من: 1111 \nمبلغ: SAR 50": ("1111", 50.0),
    "مبلغ：1,250.5\nمن 7\nمن 8": ("7", 1250.5),
    "اجمالي 90\nالمبلغ: 80 SAR\nمن": (None, 90.0),
    "بطاقة:4455\nعملية بSAR 20": (None, 20.0),
    "المبلغ: لاحقا\nبقيمة 3": (None, 3.0),
    "لا شيء": (None, None),
    "": (None, None),
}


def test_labels(spark):
    rows = spark.createDataFrame([(k, body) for k, body in enumerate(LABELS)], "k int, t string")
    got = rows.select("k", text.labelled(F.col("t"), "من").alias("who"), text.labelled_amount(F.col("t")).cast("double").alias("amount")).orderBy("k").collect()
    assert [(r["who"], r["amount"]) for r in got] == list(LABELS.values())


def test_a_topup_states_its_amount_bare(spark):
    rows = spark.createDataFrame([("شحن\n1,500.25 SAR\nالبطاقة: 0256 , x",), ("شحن\nنقاط 5 SAR",)], "t string")
    made = text.wallet_topup(F.col("t"))
    assert [(r[0] and float(r[0]), r[1]) for r in rows.select(made["amount"], made["card"]).collect()] == [(1500.25, "0256"), (None, None)]
