"""Two salary cycles as one run: messages in, through the stream, to totals, net worth, balances and links."""

from __future__ import annotations

import datetime as dt
import functools
import json

import pytest
from pyspark.sql import functions as F

from tally.operators import metrics, parser, view
from tally.operators import predicates as P
from tally.streaming import ingest

RAJHI, SAIB, BARQ = "AlRajhiBank", "SAIB", "barq app"
OWNED = [(RAJHI, "4417", "card"), (BARQ, "4417", "card"), (SAIB, "5801", "current"), (SAIB, "5802", "savings")]
LIMIT, OPENING = 14000.0, 12000.0


class Story:
    """The messages in order; the balances that card and wallet print are kept here."""

    def __init__(self):
        self.messages, self.card, self.wallet = [], OPENING, 0.0

    def told(self, sender, at, body):
        self.messages.append({"id": str(len(self.messages) + 1), "sender": sender, "body": body, "received_at": (at - dt.timedelta(hours=3) + dt.timedelta(seconds=50)).strftime("%Y-%m-%dT%H:%M:%SZ"), "at": at})

    def salary(self, at, amount, due):
        self.told(SAIB, at, f"قيد راتب دائن {amount:,.2f} SAR في {at:%H:%M} {at:%d-%m}\nحساب 99xx5801 تاريخ استحقاق {due}")

    def profit(self, at, amount):
        self.told(SAIB, at, f"ايداع أرباح شهر {at.month} لحساب البركة الادخاري\nبقيمة SAR {amount}\nفي حساب XX5802\nبتاريخ {at:%m-%d %H:%M}")

    def saved(self, at, amount):
        self.told(SAIB, at, f"حوالة صادرة: بين حساباتك\nمن: XX5801\nمبلغ: SAR {amount}\nالى: XX5802\nفي: {at:%m-%d %H:%M}")

    def bill(self, at, amount, biller):
        self.told(SAIB, at, f"مدفوعات سداد\nمن: XX5801\nمبلغ: SAR {amount}\nالجهة: {biller}\nالخدمة: دفع\nرقم الفاتورة: 70015\nفي: {at:%m-%d %H:%M}")

    def shop(self, at, amount, merchant):
        self.card -= amount
        self.told(RAJHI, at, f"شراء عبر نقاط البيع\nبطاقة:4417 ;مدى\nلدى:{merchant}\nمبلغ:{amount:,.2f} SR\nرصيد:{self.card:,.2f} SAR\n{at.day}/{at.month}/{at:%y %H:%M}")

    def online(self, at, amount, merchant):
        self.card -= amount
        self.told(RAJHI, at, f"شراء إنترنت بـSR {amount}\nعبر4417;مدى\nلـ{merchant}\nرصيد:{self.card:.2f} SR\n{at.day}/{at.month}/{at:%y %H:%M}")

    def abroad(self, at, converted, fee, merchant):
        self.card -= converted + fee
        self.told(RAJHI, at, f"شراء انترنت\nبطاقة: 4417 ;مدى\nمبلغ: 21 EUR ({converted:.2f} ريال)\nلدى: {merchant}\nرسوم وضريبة: {fee:.2f} SAR\nسعر الصرف~ 4.1\nإجمالي المبلغ المستحق: {converted + fee:.2f} SAR\nدولة: PT\nرصيد: {self.card:.2f} SAR\n{at.day}/{at.month}/{at:%y %H:%M}")

    def settled(self, at, amount):
        self.card += amount
        self.told(RAJHI, at, f"بطاقة فيزا:سداد بـSR {amount}\nعبر4417;فيزا\nرصيد:{self.card:.2f} SR\n{at.day}/{at.month}/{at:%y %H:%M}")

    def cashback(self, at, amount):
        self.told(RAJHI, at, f"بطاقة ائتمانية استرجاع نقدي :\nتم إضافة {amount} ريال إلى محفظة الاسترجاع النقدي")

    def redeemed(self, at, amount):
        self.card += amount
        self.told(RAJHI, at, f"استرداد نقدي إلى البطاقة:\nتم استرداد و إضافة {amount} ريال مبلغ الاسترداد النقدي إلى رصيد بطاقتك 4417")

    def filled(self, at, amount):
        """The wallet tells first, the card two minutes later."""
        self.wallet += amount
        self.told(BARQ, at, f"إضافة أموال\n{amount} ر.س\nالبطاقة: 4417 , مدى\n{at:%Y-%m-%d %H:%M}")
        self.shop(at + dt.timedelta(minutes=2), amount, "Wallet load")

    def from_wallet(self, at, amount, shop, online=False):
        self.wallet -= amount
        told = f"شراء انترنت\nمدى {amount} SAR\nالرصيد {self.wallet:.2f}\nب: {shop}\nحساب: 90\n" if online else f"شراء نقاط بيع\nمدى {amount} SAR\nرصيد {self.wallet:.2f}\nلدى {shop}\n"
        self.told(BARQ, at, f"{told}{at:%Y-%m-%d %H:%M}")


def story():
    s, at = Story(), lambda m, d, h=12, n=0: dt.datetime(2026, m, d, h, n)
    s.salary(at(6, 25, 9, 5), 12500.00, "06/25")
    s.saved(at(6, 25, 10), 5000)
    for k, amount in enumerate((42.10, 18.75, 63.00)):
        s.shop(at(6, 26 + k, 13, 7 * k), amount, f"Corner {k}")
    s.told(SAIB, at(6, 28, 9), "كلمة مرور لمرة واحدة\nرمز: 5150\nمبلغ: SAR 140")
    s.bill(at(6, 28, 9, 2), 140, "Water works")
    s.filled(at(6, 30, 8), 120)
    s.from_wallet(at(7, 1, 20), 61.49, "Juice bar")
    for k, amount in enumerate((27.44, 55.00, 31.20)):
        s.online(at(7, 2 + k, 18, 11 * k), amount, f"Web {k}")
    s.told(BARQ, at(7, 5), "رمز التحقق :600613\nالخدمة: حوالة")
    s.told("Zid", at(7, 6), "خصم على كل شراء هذا الاسبوع")
    s.cashback(at(7, 7), 10.80)
    s.settled(at(7, 9), 700)
    s.told("Riyad Bank", at(7, 10), "شراء عبر نقاط البيع\nمبلغ:31 SR")
    for k, amount in enumerate((80.80, 46.00, 60.00)):
        s.shop(at(7, 12 + k, 21, 3), amount, f"Market {k}")
    s.profit(at(7, 15, 6), 171.36)
    s.told(SAIB, at(7, 17), "Your purchase of SAR 44 was fine")
    s.salary(at(7, 23, 9, 5), 13120.45, "07/25")  # the 25th is a Saturday
    first = len(s.messages)
    s.saved(at(7, 25, 11), 4800)
    s.told(RAJHI, at(7, 26), "رمز التحقق 8118 لـ: دفع بـ: 71 ريال")
    for k, amount in enumerate((71.25, 12.66, 150.00)):
        s.shop(at(7, 27 + k, 14, 9), amount, f"Corner {k}")
    s.redeemed(at(7, 30, 15), 75.00)
    s.told(BARQ, at(7, 30, 16), "تم تفعيل خدمة الدفع")
    s.filled(at(8, 1, 7), 200)
    s.from_wallet(at(8, 2), 64.50, "Bakery")
    s.from_wallet(at(8, 3), 35.50, "Tickets", online=True)
    s.told(RAJHI, at(8, 4), "شراء عبر نقاط البيع\nبطاقة:4417\nمبلغ:12 SR")
    s.bill(at(8, 5), 260, "Power works")
    s.told("Salla", at(8, 6), "عرض جديد")
    for k, amount in enumerate((95.00, 44.00, 20.00)):
        s.online(at(8, 7 + k, 19, 6), amount, f"Web {k}")
    s.cashback(at(8, 11), 11.39)
    s.told(SAIB, at(8, 12), "كلمة مرور لمرة واحدة\nرمز: 2718\nمبلغ: SAR 9")
    s.settled(at(8, 13), 813)
    s.abroad(at(8, 14, 22), 86.10, 1.90, "Museum shop")
    s.profit(at(8, 15, 6), 195.48)
    s.told(BARQ, at(8, 16), "رمز التحقق :141421\nالخدمة: شراء")
    s.told(RAJHI, at(8, 17), "سحب بلا تفاصيل\nصراف")
    for k, amount in enumerate((88.00, 130.00)):
        s.shop(at(8, 18 + k, 17), amount, f"Market {k}")
    return s, first


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Each cycle's messages are one batch; five of them are sent twice, in the same batch or in the next."""
    folder = tmp_path_factory.mktemp("cycles")
    s, first = story()
    rows = [{k: v for k, v in m.items() if k != "at"} for m in s.messages]
    again = lambda *at: [rows[k] | {"id": f"again-{k}"} for k in at]
    (folder / "in").mkdir()
    owned = spark.createDataFrame(OWNED, "sender string, value string, account string")
    parse = functools.partial(parser.parsed_messages, funding_account="current")
    for name, some in (("a.json", rows[:first] + again(0, 3)), ("b.json", rows[first:] + again(5, first - 1, first + 2))):
        (folder / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in some))
        ingest.run(ingest.message_stream(spark, str(folder / "in")), owned, str(folder / "out"), str(folder / "state"), once=True, parse=parse, backfill=True).awaitTermination()
    legs = ingest.current_legs(spark, str(folder / "out")).cache()
    return s, spark.read.parquet(str(folder / "out/messages")).collect(), legs, spark.read.parquet(str(folder / "out/snapshots")).collect()


def _flow(legs):
    """Flow by cycle of the canonical relation over the stream's legs."""
    utc = F.convert_timezone(F.lit("Asia/Riyadh"), F.lit("UTC"), "posted_at")
    tx = legs.withColumns({"posted_at": utc, "account_id": F.col("account"), "cycle_override": F.col("cycle_start"), "state": F.lit("posted"), "excluded": F.lit(False), "merchant_id": F.lit(None).cast("long"), "category_id": F.lit(None).cast("int")})
    splits = legs.sparkSession.createDataFrame([], "transaction_id string, n int, category_id int, amount decimal(14,2)")
    return {r["bucket"]: tuple(round(r[c], 2) for c in ("expense", "earned", "passive")) for r in metrics.flow_by_bucket(view.categorized_amounts(tx, splits), "cycle").collect()}


def test_outcomes_of_all_messages(run):
    s, messages, _, _ = run
    assert len(s.messages) == len(messages) == 50
    count = lambda status: sum(m["status"] == status for m in messages)
    assert [count(x) for x in ("parsed", "ignored", "needs_review", "failed")] == [38, 8, 4, 0]
    assert sorted(m["kind"] for m in messages if m["status"] == "ignored") == ["notification"] + ["otp"] * 5 + ["promo"] * 2


def test_totals_of_both_cycles(run):
    """An early salary funds the cycle of its due date; a linked top-up is no spending, and would be without its link."""
    flow = _flow(run[2])
    assert flow == {"2026-06-25": (625.78, 12500.00, 182.16), "2026-07-25": (1058.91, 13120.45, 206.87)}
    assert [round(100 * (e + p - x) / (e + p), 1) for x, e, p in (flow[k] for k in sorted(flow))] == [95.1, 92.1]
    purchases = (F.col("kind") == "purchase") & F.col("is_internal")
    assert round(sum(x for x, _, _ in _flow(run[2].withColumn("is_internal", F.col("is_internal") & ~purchases)).values()), 2) == 2004.69


def test_balances_and_links(run):
    """What moved is income without spending; card and wallet come to what they last reported; both top-ups have their purchase."""
    s, _, legs, snapshots = run
    moved = {r["account"]: float(r["moved"]) for r in legs.groupBy("account").agg(F.sum(P.signed_amount()).alias("moved")).collect()}
    assert round(sum(moved.values()), 2) == round(26009.48 - 1684.69, 2) == 24324.79
    last = lambda account: float(max((x for x in snapshots if x["account"] == account), key=lambda x: x["as_of"])["balance"])
    assert round(OPENING + moved["card"], 2) == last("card") == 12144.80 and round(LIMIT - last("card"), 2) == 1855.20
    assert round(moved["barq"], 2) == last("barq") == 158.51
    groups = legs.where("transfer_group IS NOT NULL").groupBy("transfer_group").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.bool_and("is_internal").alias("inside")).collect()
    assert [(r["kinds"], r["inside"]) for r in groups] == [(["purchase", "wallet_topup"], True)] * 2
