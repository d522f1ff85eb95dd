"""From raw messages to classified, dated and resolved ledger legs: DataFrame functions over message forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions import forms as M
from tally.functions import periods, text
from tally.functions.derive import form_matches
from tally.operators.lineage import once, settled

LEDGER_KINDS = ("purchase", "withdrawal", "transfer", "card_payment", "bill_payment", "salary", "profit", "cashback_accrual", "cashback_redeem")

#: Columns of the result; those of raw by these names are replaced.
MADE = ("norm", "language", "shape", "status", "kind", "form", "error", "posted_at", "cycle_start", "details", "snapshot", "legs")


def said(field: str) -> Column:
    return F.try_element_at("f", F.lit(field))


def posted_at(raw: Column, clock: Column, number: Column, received: Column, forms=M.FORMS) -> Column:
    """The printed local time: a missing year is that of the most recent past; null where the text is no date of its form.

    received and the result are wall clocks in the bank's zone (timestamp without zone).
    """
    printed = F.when(clock.isNotNull(), F.concat_ws(" ", raw, clock)).otherwise(raw)
    out = None
    for pattern in dict.fromkeys(f.date for f in forms if f.date):
        which = number.isin(*(k for k, f in enumerate(forms) if f.date == pattern))
        if "y" in pattern:
            value = F.try_to_timestamp(printed, F.lit(pattern)).cast("timestamp_ntz")
        else:
            dated = lambda year: F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), printed), F.lit("yyyy " + pattern)).cast("timestamp_ntz")
            value = F.when(dated(F.year(received)) > received, dated(F.year(received) - 1)).otherwise(dated(F.year(received)))
        out = F.when(which, value) if out is None else out.when(which, value)
    return out


def parsed_messages(raw: DataFrame, identifiers: DataFrame, funding_account: str | None = None, cashback_account: str = "cashback_wallet", backfill: bool = False, forms=M.FORMS, stored: DataFrame | None = None) -> DataFrame:
    """One row for each row of raw (id, sender, body, received_at in the bank's zone) with its outcome.

    status is parsed, ignored or needs_review, with kind, form, error, posted_at, cycle, snapshot and legs (account,
    direction, is_internal, amount). identifiers has sender, value and account, each pair of the first two once, value
    __default__ for messages that name none; these are one owner's own accounts, a few a sender. Null bodies need a review. stored has forms that people made (derive.as_row); they are joined, by an index
    over their lines, to the messages that none of forms fits, and the first made one that fits decides.
    """
    days = 400 if backfill else 3
    rows = raw.withColumns({"sender": text.canonical_sender(F.col("sender")), "norm": text.normalized(F.coalesce("body", F.lit("")))})
    rows = once(rows, "sender").withColumn("verdict", M.classified(F.col("norm"), F.col("sender"), text.SENDERS))
    rows = once(rows, "verdict")
    booked = (F.col("verdict.effect") == "snapshot") | (F.col("verdict.effect") == "ledger") & F.col("verdict.kind").isin(*LEDGER_KINDS)
    rows = once(rows.withColumn("number", F.when(booked, M.form_number(F.col("norm"), F.col("sender"), forms))), "number")
    rows = once(rows.withColumn("f", F.when(F.col("number").isNotNull(), M.form_values(F.col("norm"), F.col("number"), forms))), "f")
    column = lambda name: F.get(F.array(*(F.lit(getattr(f, name)) for f in forms)), F.col("number"))
    rows = rows.withColumns({"form": column("id"), "form_kind": column("kind"), "direction": column("direction"), "hint": column("account"), "dated": column("date").isNotNull()})
    printed = posted_at(said("date"), said("clock"), F.col("number"), F.col("received_at"), forms)
    if stored is not None:
        rows = settled(rows.withColumn("__row", F.monotonically_increasing_id()).hint("rebalance", "id"))
        # written parts are of one size, and the joined ones as many: what a task holds does not grow with the input
        parts = max(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = form_matches(rows.where(booked & F.col("number").isNull()), stored, "__row", parts).withColumnsRenamed({"__row": "__number", "form": "__form", "said": "__said"})
        rows = rows.repartition(parts, "__row").join(found, F.col("__row") == F.col("__number"), "left")
        own = F.col("number").isNotNull()
        either = {name: F.coalesce(F.col(name), F.col(f"__form.{field}")) for name, field in (("form", "id"), ("form_kind", "kind"), ("direction", "direction"))}
        rows = rows.withColumns(either | {"hint": F.when(own, F.col("hint")).otherwise(F.col("__form.account")), "dated": F.when(own, F.col("dated")).otherwise(F.col("__form.date").isNotNull()), "f": F.coalesce("f", "__said")})
        rows = rows.withColumn("stored_date", F.array_position(F.array(*map(F.lit, M.DATES)), F.col("__form.date")) - 1).withColumn("number", F.when(own, F.col("number")).when(F.col("__form").isNotNull(), -1))
        by_date = tuple(M.Form("", "", "", "", pattern, "") for pattern in M.DATES)
        printed = F.when(F.col("number") >= 0, printed).otherwise(posted_at(said("date"), said("clock"), F.col("stored_date"), F.col("received_at"), by_date))
        rows = rows.drop("__row", "__number", "__form", "__said")
    rows = rows.withColumn("printed_at", F.when(F.col("dated"), printed).otherwise(F.col("received_at")))
    # one map a sender: the planner traces a join key to its source, and that of a parsed field is a very long expression
    known = identifiers.groupBy(F.col("sender").alias("__s")).agg(F.map_from_entries(F.collect_set(F.struct("value", "account"))).alias("known"))
    rows = rows.join(F.broadcast(known), F.col("sender") == F.col("__s"), "left").drop("__s")
    owner = lambda value: F.try_element_at("known", value)
    rows = rows.withColumns({f"{name}_owner": owner(text.last_digits(said(name))) for name in ("card", "from", "to")} | {"default_owner": owner(F.lit("__default__"))})
    rows = rows.withColumns({"account": F.coalesce("hint", "card_owner", "from_owner", "to_owner", "default_owner"), "amount": text.amount(said("amount")), "balance": text.amount(said("balance"))})
    rows = once(rows, "printed_at", "from_owner", "to_owner", "account")

    effect, too_old = F.col("verdict.effect"), F.col("printed_at") < F.col("received_at") - F.expr(f"INTERVAL {days} DAYS")
    error = (
        F.when(effect == "review", F.when(F.col("verdict.kind") == "unknown", "classified but not actionable").otherwise("unrecognised sender"))
        .when((effect != "none") & (effect != "snapshot") & ~F.col("verdict.kind").isin(*LEDGER_KINDS), F.concat(F.lit("unhandled class "), "verdict.kind"))
        .when((effect != "none") & F.col("number").isNull(), "no template matched")
        .when(F.col("number").isNotNull() & F.col("printed_at").isNull(), "date: not a date")
        .when(F.col("number").isNotNull() & (F.col("printed_at") > F.col("received_at")), "date: after received_at")
        .when(F.col("number").isNotNull() & too_old, "date: too far before received_at")
        .when(F.col("number").isNotNull() & F.col("account").isNull(), "unresolved account")
    )
    rows = rows.withColumn("error", error)
    rows = rows.withColumn("status", F.when(effect == "none", "ignored").when(F.col("error").isNotNull(), "needs_review").otherwise("parsed"))
    rows = once(rows, "error", "status")

    done = F.col("status") == "parsed"
    giver = F.coalesce("from_owner", F.when(F.col("direction") == "debit", F.col("hint")))
    taker = F.coalesce("to_owner", F.when(F.col("direction") == "credit", F.col("hint")))
    leg = lambda account, direction, internal: F.struct(account.alias("account"), direction.alias("direction"), F.lit(internal).alias("is_internal"), F.col("amount"), F.when(account == F.col("account"), F.col("balance")).alias("balance"))
    debit, credit = F.lit("debit"), F.lit("credit")
    legs = F.when((F.col("form_kind") == "transfer") & giver.isNotNull() & taker.isNotNull() & (giver != taker), F.array(leg(giver, debit, True), leg(taker, credit, True)))
    if funding_account:
        legs = legs.when(F.col("form_kind") == "card_payment", F.array(leg(F.col("account"), credit, True), leg(F.lit(funding_account), debit, True)))
    legs = legs.when(F.col("form_kind") == "cashback_redeem", F.array(leg(F.col("account"), credit, True), leg(F.lit(cashback_account), debit, True))).otherwise(F.array(leg(F.col("account"), F.col("direction"), False)))

    # a salary's due date names its cycle; one printed in December for January is due next year
    due = F.split(said("due"), "/")
    late = ((F.month("printed_at") == 12) & (due[0] == "01")).cast("int")
    dated = F.concat_ws("-", (F.year("printed_at") + late).cast("string"), due[0], F.get(due, F.lit(1)))
    anchor = F.coalesce(F.when(F.col("form_kind") == "salary", F.try_to_timestamp(dated, F.lit("yyyy-MM-dd"))).cast("date"), F.to_date("printed_at"))
    return rows.select(
        *(c for c in raw.columns if c not in MADE),
        "norm",
        text.language(F.col("norm")).alias("language"),
        text.shape_hash(F.col("norm")).alias("shape"),
        "status",
        F.when(F.col("number").isNotNull(), F.col("form_kind")).otherwise(F.col("verdict.kind")).alias("kind"),
        "form",
        "error",
        F.when(done, F.col("printed_at")).alias("posted_at"),
        F.when(done, periods.period_start(anchor)).alias("cycle_start"),
        F.when(done, F.struct(text.last_digits(said("card")).alias("card_last4"), said("merchant").alias("merchant"), said("biller").alias("biller"), text.last_digits(said("counterparty_account")).alias("counterparty_account"), text.amount(said("fee")).alias("fee_amount"), said("currency").alias("original_currency"))).alias("details"),
        F.when(done & F.col("balance").isNotNull(), F.struct("account", "balance")).alias("snapshot"),
        F.when(done, legs).alias("legs"),
    )


def ledger_legs(parsed: DataFrame) -> DataFrame:
    """One row a leg; its id derives from message, account and direction, so that a rerun writes the same rows.

    Only parsed messages have legs. They are told by the leg, not by the status before: a filter below would repeat
    all that a status and its legs are made of.
    """
    legs = parsed.select(F.col("id").alias("raw_message_id"), "sender", "posted_at", "cycle_start", "kind", M.ledger_type(F.col("kind")).alias("type"), "details", F.explode_outer("legs").alias("leg")).where("leg IS NOT NULL")
    key = F.sha2(F.concat_ws("|", F.col("raw_message_id").cast("string"), "leg.account", "leg.direction"), 256)
    return legs.select(key.alias("id"), "raw_message_id", "sender", "posted_at", "cycle_start", "kind", "type", "details.*", "leg.*")


def snapshots(parsed: DataFrame) -> DataFrame:
    """(account, balance, source, as_of, raw_message_id) of every message that states a balance."""
    stated = parsed.select("id", "posted_at", F.explode_outer(F.array("snapshot")).alias("s")).where("s IS NOT NULL")  # told by the element, as in ledger_legs
    return stated.select("s.account", "s.balance", F.lit("sms").alias("source"), F.col("posted_at").alias("as_of"), F.col("id").alias("raw_message_id"))


def totals(legs: DataFrame) -> DataFrame:
    """Income, spending and the change of net worth that legs make: what is credited raises it, on a card as well."""
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    part = lambda when: F.coalesce(F.sum(F.when(when, F.col("amount"))), F.lit(0)).cast("double")
    return legs.agg(part(F.col("kind").isin("salary", "profit", "cashback_accrual")).alias("income"), part(F.col("kind").isin("purchase", "bill_payment") & ~F.col("is_internal")).alias("expense"), F.coalesce(F.sum(signed), F.lit(0)).cast("double").alias("net_worth_delta"))


#: Fixed value: what is kept of a one-time code's message.
REDACTED = "[redacted: otp]"


def redacted(parsed: DataFrame) -> DataFrame:
    """A one-time code is not kept: where one is recognised, the body and its normal form are replaced before anything is written.

    The shape has no digits, and the hash that tells repeats is one-way; nothing else is derived from such a message.
    """
    code = (F.col("status") == "ignored") & (F.col("kind") == "otp")
    return parsed.withColumns({name: F.when(code, F.lit(REDACTED)).otherwise(F.col(name)) for name in ("body", "norm")})


def attempted(messages: DataFrame, failed: Column, error: Column, most: int = 3) -> DataFrame:
    """Failures count up and go back to pending, after so many to failed."""
    tries = F.col("attempts") + 1
    return messages.withColumns({"status": F.when(failed, F.when(tries >= most, "failed").otherwise("pending")).otherwise(F.col("status")), "attempts": F.when(failed, tries).otherwise(F.col("attempts")), "last_error": F.when(failed, F.substring(error, 1, 2000)).otherwise(F.col("last_error"))})
