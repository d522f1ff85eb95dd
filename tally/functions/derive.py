"""New message forms: derived from one message whose values a person marked, proven on it, stored as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.forms import DATES, NUMBER, SHAPES, Form
from tally.functions.text import _normal

#: What can be marked in a message; numbers are compared as amounts, accounts by their last digits.
AMOUNTS, ACCOUNTS = ("amount", "balance", "fee"), ("card", "from", "to")
FIELDS = (*AMOUNTS, *ACCOUNTS, "date", "merchant", "counterparty", "biller")


class NotDerivable(ValueError):
    """Why no form can be made of a message and its marks."""


def _meaning(name: str, value: str) -> str:
    if name in AMOUNTS:
        found = re.search(NUMBER, value.replace(" ", ""))
        return f"{float(found[0].replace(',', '')):.2f}" if found else ""
    return re.sub(r"\D", "", value)[-4:] if name in ACCOUNTS else value.strip()


def derived_form(id: str, sender: str, body: str, marks: dict[str, str], kind: str, direction: str, date: str | None = None, account: str | None = None) -> Form:
    """The form of a message: its own text with the marked values as fields.

    Each value must stand in the text just once and apart from the others: a value that could be meant twice is refused
    rather than guessed. An amount is needed, a date where a date pattern is given, and an account, either by a
    card or account number or by name. The form is proven: it must read the marked values out of its own message.
    """
    marks = {name: _normal(value) for name, value in marks.items() if value and value.strip()}
    text = _normal(body)
    if direction not in ("debit", "credit") or not kind:
        raise NotDerivable("a form has a kind and is a debit or a credit")
    if unknown := set(marks) - set(FIELDS):
        raise NotDerivable(f"no such field: {', '.join(sorted(unknown))}")
    if "amount" not in marks:
        raise NotDerivable("a transaction has an amount")
    if date and date not in DATES:
        raise NotDerivable(f"no such date pattern: {date}")
    if date and "date" not in marks:
        raise NotDerivable("a date pattern needs a marked date")
    if not account and not set(marks) & set(ACCOUNTS):
        raise NotDerivable("the message names no account, so one must be given")
    if "{" in text or "}" in text:
        raise NotDerivable("the text holds a brace")
    places = []
    for name, value in marks.items():
        if (n := len(re.findall(f"(?={re.escape(value)})", text))) != 1:
            raise NotDerivable(f"{name} occurs {n} times in the message")
        places.append((text.index(value), text.index(value) + len(value), name))
    places.sort()
    if any(a[1] > b[0] for a, b in zip(places, places[1:])):
        raise NotDerivable("two values overlap")
    out, at = [], 0
    for start, stop, name in places:
        out += [text[at:start], "{" + name + "}"]
        at = stop
    form = Form(id, sender, kind, direction, date, "".join([*out, text[at:]]), account, whole=True)
    read = values_of(form, body)
    if read is None or any(_meaning(k, read[k]) != _meaning(k, v) for k, v in marks.items()):
        raise NotDerivable("the form doesn't read its own message back")
    return form


def values_of(form: Form, body: str) -> dict[str, str] | None:
    """What one message says by a form; None if it isn't of that form."""
    pattern, names = form.parts()
    found = re.search(pattern.replace("(?md)", "(?m)").replace(r"\z", r"\Z"), _normal(body))
    return None if found is None else {name: found[k + 1].strip() for k, name in enumerate(names)}


def as_row(form: Form, shape: str, created_at) -> dict:
    """A form as it is stored."""
    return {"id": form.id, "sender": form.sender, "kind": form.kind, "direction": form.direction, "date": form.date, "text": form.text, "account": form.account, "shape": shape, "created_at": created_at}


def _whole(norm: Column) -> Column:
    """A text's lines without blanks, as forms compare them."""
    return F.transform(F.split(norm, "\n"), lambda line: F.replace(line, F.lit(" "), F.lit("")))


def form_index(stored: DataFrame) -> DataFrame:
    """(sender, lines, line, words, place, pattern, groups, fields, form) of each row of stored that is a form.

    A form covers a message from end to end and no field crosses a line, so both have as many lines, and a line of the form
    without a field stands in the message at the same place, but for blanks. The longest such line is what the form is looked
    up by; a form that has none is looked up by its number of lines (line 0). place is the order in which forms were made. Rows
    with an unknown direction, field or date pattern, without an amount, with a field given twice or a loose brace are left out.
    """
    names = F.regexp_extract_all("text", F.lit(r"\{(\w+)\}"), F.lit(1))
    known = F.array(*(F.lit(n) for n in sorted({*SHAPES, *FIELDS})))
    sound = F.col("direction").isin("debit", "credit") & F.array_contains("fields", "amount") & (F.size(F.array_distinct("fields")) == F.size("fields")) & (F.size(F.array_except("fields", known)) == 0) & (F.col("date").isNull() | F.col("date").isin(*DATES))
    braces = F.regexp_replace("text", r"\{\w+\}", "").rlike(r"[{}]")
    rows = stored.where("text IS NOT NULL AND sender IS NOT NULL").where(~braces).withColumn("fields", names).where(sound)
    escaped = F.regexp_replace("text", r"([^\p{L}\p{N}_{} \n])", r"\\$1")
    pattern = F.regexp_replace(escaped, " +", "[ ]*")
    shape = lambda field: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SHAPES.items() for x in kv)), field), F.lit(".+?"))
    pattern = F.aggregate("fields", pattern, lambda out, field: F.replace(out, F.concat(F.lit("{"), field, F.lit("}")), F.concat(F.lit("("), shape(field), F.lit(")"))))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(F.when(line.contains("{"), -1).otherwise(F.length(F.replace(line, F.lit(" "), F.lit("")))).alias("size"), (-i).alias("order"), F.replace(line, F.lit(" "), F.lit("")).alias("words")))
    best = F.array_max(lines)
    literal = best["size"] > 0
    groups = F.array_join(F.transform(F.sequence(F.lit(1), F.size("fields")), lambda g: F.concat(F.lit("$"), g.cast("string"))), "\u0001")
    return rows.select(
        "sender",
        F.size(F.split("text", "\n")).alias("lines"),
        F.when(literal, 1 - best["order"]).otherwise(0).alias("line"),
        F.when(literal, best["words"]).otherwise("").alias("words"),
        F.struct("created_at", "id").alias("place"),
        F.concat(F.lit(r"(?md)\A"), pattern, F.lit(r"\z")).alias("pattern"),
        groups.alias("groups"),
        "fields",
        F.struct("id", "kind", "direction", "account", "date").alias("form"),
    )


def form_matches(texts: DataFrame, stored: DataFrame, by: str | None = None, parts: int = 1) -> DataFrame:
    """(sender, norm, form, said) for the texts (sender, norm) that a stored form fits: the first made one, and what it reads.

    Each line of a text is looked up among the forms' own lines, so that a text meets only the forms that have one of
    its lines at its place, however many forms there are. A text of null, or of no form, has no row; equal texts have one.
    With by, a column that numbers the texts, the result is (by, form, said), in so many parts. All messages of a form have the line
    it is looked up by, so forms are copied parts times and each copy meets a part of the texts.
    """
    names = [by] if by else ["sender", "norm"]
    asked = texts.select(by, "sender", "norm") if by else texts.select("sender", "norm").distinct()
    asked = asked.withColumn("all", _whole(F.col("norm")))
    keys = F.concat(F.array(F.struct(F.lit(0).alias("line"), F.lit("").alias("words"))), F.transform("all", lambda line, i: F.struct((i + 1).alias("line"), line.alias("words"))))
    met = asked.select(*asked.columns[:-1], F.size("all").alias("lines"), F.explode(keys).alias("__key")).select(*asked.columns[:-1], "lines", "__key.*")
    met = met.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
    copies = form_index(stored).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = met.join(copies, ["sender", "lines", "line", "words", "part"])
    said = F.transform(F.split(F.regexp_replace("norm", F.col("pattern"), F.col("groups")), "\u0001"), lambda x: F.trim(x))
    fit = met.where(F.rlike("norm", F.col("pattern"))).select(*names, "place", F.struct("form", F.map_from_arrays("fields", said).alias("said")).alias("m"))
    fit = fit.repartition(parts, by) if by else fit
    return fit.groupBy(*names).agg(F.min_by("m", "place").alias("m")).select(*names, "m.*")
