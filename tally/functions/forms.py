"""Message forms: how each bank words a movement, as lines with {fields}, compiled to one Java pattern each."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d[\d,]*(?:\.\d+)?"
#: What a field matches; any other is free text up to the end of its line.
SHAPES = {
    **dict.fromkeys(("amount", "balance", "fee", "original", "converted", "vat"), NUMBER),
    **dict.fromkeys(("card", "to", "from", "counterparty_account", "reference"), r"\S+?"),
    "currency": "[A-Z]{3}",
    "rate": r"[\d.]+",
    "country": r"\S+",
    "invoice": r"\d+",
    "due": r"\d\d/\d\d",
    "date": r"\d.*?",
    "clock": r"\d\d:\d\d",
}


@dataclass(frozen=True)
class Form:
    """text is in normal form; account names the account that the sender implies; date is a Spark datetime pattern.

    A form that was derived from one message is whole: it fits messages from their first character to their last.
    """

    id: str
    sender: str
    kind: str
    direction: str
    date: str | None
    text: str
    account: str | None = None
    whole: bool = False

    def parts(self) -> tuple[str, list[str]]:
        """The pattern and the field of each of its groups; a blank stands for any number of them."""
        names, out = [], []
        for literal, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", self.text):
            out.append(re.sub(r"(?:\\ )+| +", "[ ]*", re.escape(literal).replace("\\\n", "\n")))
            if name:
                names.append(name)
                out.append(f"({SHAPES.get(name, '.+?')})")
        edges = (r"\A", r"\z") if self.whole else ("^", "$" if self.text.endswith("}") else "")
        return "(?md)" + edges[0] + "".join(out) + edges[1], names

    def anchor(self) -> str:
        """The longest word of the form itself: a text without it is not of this form, whatever its blanks and fields are."""
        return max(re.split(r"\{\w+\}|\s+", self.text), key=len)


# The banks' wordings, after normalisation.
DMY, YMD, ISO, DASHED, MONTH_FIRST, DAY_FIRST = "d/M/yy H:mm", "yy/M/d H:mm", "yyyy-M-d H:mm", "d-M-yyyy H:mm", "M-d H:mm", "d-M H:mm"
DATES = (DMY, YMD, ISO, DASHED, MONTH_FIRST, DAY_FIRST)
RAJHI, SAIB, BARQ, STC = "AlRajhiBank", "SAIB", "barq app", "STC Bank"
FORMS = (
    Form("AR-01", RAJHI, "transfer", "credit", YMD, "حوالة داخلية واردة بSAR {amount}\nل{to}\nمن{from};{counterparty}\n{date}"),
    Form("AR-02", RAJHI, "purchase", "debit", DMY, "شراء عبر نقاط البيع\nبطاقة: {card} ;{scheme}\nلدي: {merchant}\nمبلغ: {amount} SAR\nرصيد: {balance} SAR\n{date}"),
    Form("AR-03", RAJHI, "purchase", "debit", DMY, "شراء انترنت بSAR {amount}\nعبر{card};{scheme}\nل{merchant}\nرصيد: {balance} SAR\n{date}"),
    Form("AR-04", RAJHI, "purchase", "debit", DMY, "شراء انترنت\nبطاقة: {card} ;{scheme}\nمبلغ: {original} {currency} ({converted} SAR)\nلدي: {merchant}\nرسوم وضريبة: {fee} SAR\nسعر الصرف~ {rate}\nاجمالي المبلغ المستحق: {amount} SAR\nدولة: {country}\nرصيد: {balance} SAR\n{date}"),
    Form("AR-05", RAJHI, "card_payment", "credit", DMY, "بطاقة فيزا:سداد بSAR {amount}\nعبر{card};فيزا\nرصيد: {balance} SAR\n{date}"),
    Form("AR-06", RAJHI, "cashback_accrual", "credit", None, "بطاقة ايتمانية استرجاع نقدي :\nتم اضافة {amount} SAR الي محفظة الاسترجاع النقدي", "cashback_wallet"),
    Form("AR-07", RAJHI, "cashback_redeem", "credit", None, "استرداد نقدي الي البطاقة:\nتم استرداد و اضافة {amount} SAR مبلغ الاسترداد النقدي الي رصيد بطاقتك {card}"),
    Form("SA-01", SAIB, "transfer", "credit", MONTH_FIRST, "حوالة واردة: محلية (مقبوله)\nمن: {from}\n{counterparty}\nعبر: {bank}\nمبلغ: SAR {amount}\nالي: {to}\nفي: {date}"),
    Form("SA-02", SAIB, "transfer", "debit", MONTH_FIRST, "حوالة صادرة: بين حساباتك\nمن: {from}\nمبلغ: SAR {amount}\nالي: {to}\nفي: {date}"),
    Form("SA-03", SAIB, "transfer", "debit", MONTH_FIRST, "حوالة محلية\nالمصرف {bank}\nالمبلغ SAR {amount}\nمن {from}\nالي: {counterparty}\nالي {to}\nالرسوم SAR {fee}\nفي {date}"),
    Form("SA-04", SAIB, "salary", "credit", DAY_FIRST, "قيد راتب داين {amount} SAR في {clock} {date}\nحساب {to} تاريخ استحقاق {due}"),
    Form("SA-05", SAIB, "profit", "credit", MONTH_FIRST, "ايداع ارباح شهر {month} لحساب البركة الادخاري\nبقيمة SAR {amount}\nفي حساب {to}\nبتاريخ {date}"),
    Form("SA-06", SAIB, "bill_payment", "debit", MONTH_FIRST, "مدفوعات {payer}\nمن: {from}\nمبلغ: SAR {amount}\nالجهة: {biller}\nالخدمة: {service}\nرقم الفاتورة: {invoice}\nفي: {date}"),
    Form("BQ-01", BARQ, "wallet_topup", "credit", ISO, "اضافة اموال\n{amount} SAR\nالبطاقة: {card} , {scheme}\n{date}", "barq"),
    Form("BQ-02", BARQ, "transfer", "credit", ISO, "حوالة واردة داخلية\n{amount} SAR\nحساب المرسل: {from}\n{date}", "barq"),
    Form("BQ-03", BARQ, "transfer", "debit", ISO, "حوالة صادرة محلية\nمبلغ {amount} SAR\nرسوم {fee} SAR\nالي {counterparty}\nبنك{bank}\nلحساب {to}\n{date}", "barq"),
    Form("BQ-04", BARQ, "transfer", "debit", ISO, "حوالة صادرة داخلية\nالمبلغ: {amount} SAR\nالي : {to}\n{date}", "barq"),
    Form("BQ-05", BARQ, "purchase", "debit", ISO, "شراء نقاط بيع\nمدي {amount} SAR\nرصيد {balance}\nلدي{merchant}\n{date}", "barq"),
    Form("BQ-06", BARQ, "purchase", "debit", ISO, "شراء انترنت\nمدي {amount} SAR\nالرصيد {balance}\nب: {merchant}\nحساب: {card}\n{date}", "barq"),
    Form("BQ-07", BARQ, "purchase", "debit", ISO, "شراء نقاط البيع دولية\n{scheme}\nالمبلغ {original} {currency} ({amount} SAR) الصرف ≈ {rate}\nالرصيد {balance}\nلدي: {merchant}\n{date}", "barq"),
    Form("BQ-08", BARQ, "purchase", "debit", ISO, "شراء انترنت\n{scheme} {original} {currency} ({amount} SAR)\nرصيد {balance}\nلدي {merchant}\n{date}", "barq"),
    Form("ST-01", STC, "transfer", "debit", DMY, "حوالة داخلية صادرة\nب: {amount} SAR\nالي: {counterparty}\nالي: {counterparty_account}\nفي: {date}", "stc"),
    Form("ST-02", STC, "transfer", "debit", DMY, "دفع قطة\nمبلغ: {amount} SAR\nالي: {counterparty}\nفي: {date}", "stc"),
    Form("ST-03", STC, "transfer", "credit", DMY, "حوالة داخلية واردة\nب: {amount} SAR\nمن: {counterparty}\nمن: {counterparty_account}\nفي: {date}", "stc"),
    Form("ST-04", STC, "transfer", "credit", DMY, "استلام قطة\nمبلغ: {amount} SAR\nمن: {counterparty}\nفي: {date}", "stc"),
    Form("ST-05", STC, "transfer", "credit", DASHED, "حوالة واردة (سريع)\n{amount} SAR\nمن {counterparty}\nمن بنك {bank}\nحساب {from}\n{date}\nمرجع {reference}", "stc"),
    Form("ST-06", STC, "purchase", "debit", DMY, "عملية انترنت\nب: {amount} SAR\nمن: {merchant}\nبطاقة: {card}\nفي: {date}"),
    Form("ST-07", STC, "purchase", "debit", DMY, "شراء Apple Pay\nمن: {card}\nب: {amount} SAR\nمن: {merchant}\nفي: {date}"),
    Form("ST-08", STC, "purchase", "debit", DMY, "شراء انترنت\nعبر: {card}, {scheme}\nب: {converted} SAR\nمن: {merchant}\nرسوم تحويل العملات: {fx_fee}\nضريبة القيمة المضافة: {vat} SAR\nرسوم العملية: {fee} SAR\nاجمالي المبلغ المستحق: {amount} SAR\nالرصيد المتبقي: {balance} SAR\nالدولة: {country}\nفي: {date}"),
)

# Fixed values: (kind, effect, patterns); the first that occurs decides. Patterns are read over the normal form.
CLASSES = (
    ("otp", "none", ["رمز التحقق", "كلمة مرور لمرة واحدة", "لا تشارك الرمز", r"رمز:\s*\d", r"\bOTP\b", "verification code", "Account Code is", "one[- ]time (?:pass|code)"]),
    ("notification", "none", ["New beneficiary activated", "تم اعادة تعيين كلمة المرور", "تم تفعيل خدمة", "تفعيل خدمة تسجيل الدخول", "بصمة (?:الوجه|الاصبع)"]),
    ("declined", "none", ["لم تتم", "مرفوض", "غير كافي", "رصيد غير كاف", "فشل", "declined", "insufficient"]),
    ("statement", "statement", ["كشف حساب", "الحد الادنى للسداد", "statement", "minimum due"]),
    ("balance_alert", "snapshot", [r"\A\s*رصيد(?:ك)?\s*[:：]?\s*[\d.,]+\s*SAR\s*\z"]),
    ("bill_payment", "ledger", [r"مدفوعات\s+\S+", "سداد فاتورة", "رقم الفاتورة", r"\bSADAD\b"]),
    ("cashback_redeem", "ledger", ["استرداد نقدي الي البطاقة"]),
    ("cashback_accrual", "ledger", ["استرجاع نقدي"]),
    ("profit", "ledger", ["ايداع ارباح", "ارباح شهر", "عايد"]),
    ("salary", "ledger", ["قيد راتب", "راتب دائن", r"\bراتب\b"]),
    ("card_payment", "ledger", [r"بطاقة فيزا\s*[:：]\s*سداد", "سداد بـ"]),
    ("transfer", "ledger", ["حوالة", "اضافة اموال", "دفع قطة", "استلام قطة"]),
    ("purchase", "ledger", ["شراء", "عملية انترنت", "نقاط البيع", "نقاط بيع"]),
    ("withdrawal", "ledger", ["سحب نقدي", "صراف"]),
)
PROMOTERS = ("Salla", "Virgin-AD", "ITHRA", "SAB", "iisal", "Zid", "Apple")
TYPES = {"purchase": "purchase", "withdrawal": "withdrawal", "transfer": "transfer", "transfer_in": "transfer", "card_payment": "card_payment", "bill_payment": "bill_payment", "salary": "income", "profit": "profit", "cashback_accrual": "profit", "cashback_redeem": "transfer", "wallet_topup": "transfer", "fee": "fee", "refund": "refund"}


def ledger_type(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), kind), F.lit("purchase"))


def classified(norm: Column, sender: Column, senders: tuple[str, ...]) -> Column:
    """struct(kind, effect): what a message is and what may come of it; no unknown sender reaches the ledger. Plain words are looked for as they are, without a pattern."""
    gated = lambda kind, effect: F.when(sender.isin(*PROMOTERS), _verdict("promo", "none")).when(~sender.isin(*senders) & (sender != ""), _verdict(kind, "review")).otherwise(_verdict(kind, effect)) if effect == "ledger" else _verdict(kind, effect)
    found, low = None, F.lower(norm)
    for kind, effect, patterns in CLASSES:
        plain = [p for p in patterns if p == re.escape(p).replace("\\ ", " ")]
        hits = [F.contains(low, F.lit(p.lower())) for p in plain]
        if len(plain) < len(patterns):
            hits.append(norm.rlike("(?mdiuU)" + "|".join(f"(?:{p})" for p in patterns if p not in plain)))
        hit = reduce(Column.__or__, hits)
        found = F.when(hit, gated(kind, effect)) if found is None else found.when(hit, gated(kind, effect))
    return found.when(sender.isin(*PROMOTERS), _verdict("promo", "none")).otherwise(_verdict("unknown", "review"))


def _verdict(kind: str, effect: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(effect).alias("effect"))


def form_number(norm: Column, sender: Column, forms: tuple[Form, ...] = FORMS) -> Column:
    """Which form of its sender a text has, the first in order; null if none. A pattern is tried only on texts that have the form's longest word."""
    by_sender: dict[str, list[int]] = {}
    for k, form in enumerate(forms):
        by_sender.setdefault(form.sender, []).append(k)
    out = None
    for name, numbers in by_sender.items():
        own = None
        for k in numbers:
            hit = F.contains(norm, F.lit(forms[k].anchor())) & norm.rlike(forms[k].parts()[0])
            own = F.when(hit, F.lit(k)) if own is None else own.when(hit, F.lit(k))
        out = F.when(sender == name, own) if out is None else out.when(sender == name, own)
    return out


def _around(pattern: str) -> str:
    """The pattern with whatever stands before and after it, so that one replacement leaves its groups alone."""
    return r"(?d)\A[\s\S]*?" + pattern + r"[\s\S]*\z"


def form_values(norm: Column, number: Column, forms: tuple[Form, ...] = FORMS) -> Column:
    """A map from field to string of what a text of that form says. One pass of the form's pattern over the whole text."""
    values, names = None, []
    for k, form in enumerate(forms):
        pattern, fields = form.parts()
        names.append(F.array(*map(F.lit, fields)))
        groups = F.split(F.regexp_replace(norm, _around(pattern), "\u0001".join(f"${g + 1}" for g in range(len(fields)))), "\u0001")
        values = F.when(number == k, groups) if values is None else values.when(number == k, groups)
    return F.map_from_arrays(F.get(F.array(*names), number), F.transform(values, lambda x: F.trim(x)))
