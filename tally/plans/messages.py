"""Queries on messages: events worded as bank messages, parsed back into legs, deduplicated, queued and linked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions import text
from tally.operators import linking, parser, queue
from tally.plans.registry import query
from tally.sources import sinks
from tally.sources import tables as S

IDENTIFIERS = [("AlRajhiBank", "0256", "rajhi_card"), ("SAIB", "1111", "saib_current"), ("SAIB", "2222", "saib_savings"), ("SAIB", "__default__", "saib_current")]

# The words of each case by event_id % 8: {a} amount, {d} printed date.
CASES = (
    ("AlRajhiBank", "شراء عبر نقاط البيع\nبطاقة:0256 ;مدى\nلدى:Corner Shop\nمبلغ:{a} SR\nرصيد:1,000.50 SAR\n{d}", "d/M/yy HH:mm"),
    ("barq app", "إضافة أموال\n{a} ر.س\nالبطاقة: 0256 , مدى\n{d}", "yyyy-MM-dd HH:mm"),
    ("SAIB", "حوالة صادرة: بين حساباتك\nمن: XX1111\nمبلغ: SAR {a}\nإلى: XX2222\nفي: {d}", "MM-dd HH:mm"),
    ("saib", "مدفوعات فلان\nمن: 1111\nمبلغ: SAR {a}\nالجهة: Water\nالخدمة: Supply\nرقم الفاتورة: 123\nفي: {d}", "MM-dd HH:mm"),
    ("AlRajhiBank", "رمز التحقق: 4455 لمبلغ {a} SAR {d}", "d/M/yy HH:mm"),
    ("Nobody", "شراء بمبلغ {a} SAR {d}", "d/M/yy HH:mm"),
    ("SAIB", "ايداع أرباح شهر يناير لحساب البركة الادخاري\nبقيمة SAR {a}\nفي حساب 2222\nبتاريخ {d}", "MM-dd HH:mm"),
    ("AlRajhiBank", "شراء بطريقة جديدة {a} SAR\n{d}", "d/M/yy HH:mm"),
)


def messages(spark, d: str) -> DataFrame:
    """Each event as a message that arrives two minutes after the minute it prints."""
    rows = S.table(spark, d, "events").select("event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("at"), F.col("value").cast("decimal(14,2)").alias("amount"))
    case, pick = (F.col("event_id") % len(CASES)).cast("int"), lambda k: F.array(*(F.lit(c[k]) for c in CASES))
    printed = None
    for k, (_, _, pattern) in enumerate(CASES):
        value = F.date_format("at", pattern)
        printed = F.when(case == k, value) if printed is None else printed.when(case == k, value)
    body = F.replace(F.replace(F.get(pick(1), case), F.lit("{a}"), F.col("amount").cast("string")), F.lit("{d}"), printed)
    return rows.select(F.col("event_id").alias("id"), F.get(pick(0), case).alias("sender"), body.alias("body"), (F.col("at") + F.expr("INTERVAL 2 MINUTES")).alias("received_at"))


def parsed(spark, d: str) -> DataFrame:
    return parser.parsed_messages(messages(spark, d), spark.createDataFrame(IDENTIFIERS, "sender string, value string, account string"))


_M = "m AS (SELECT event_id AS id, event_id % 8 AS c, date_trunc('minute', ts) AS mt, CAST(value AS DECIMAL(14,2)) AS amount FROM events)"
_STATUS = "CASE WHEN c = 4 THEN 'ignored' WHEN c IN (5, 7) THEN 'needs_review' ELSE 'parsed' END"
_KIND = "['purchase', 'wallet_topup', 'transfer', 'bill_payment', 'otp', 'purchase', 'profit', 'purchase'][c + 1]"


@query(
    "message_outcomes",
    f"""WITH {_M} SELECT id, {_STATUS} AS status, {_KIND} AS kind, ['AR-02', 'BQ-01', 'SA-02', 'SA-06', NULL, NULL, 'SA-05', NULL][c + 1] AS form, CASE c WHEN 5 THEN 'unrecognised sender' WHEN 7 THEN 'no template matched' END AS error,
CASE WHEN c NOT IN (4, 5, 7) THEN strftime(mt, '%Y-%m-%d %H:%M') END AS posted_at, CASE WHEN c NOT IN (4, 5, 7) THEN {S.cycle_sql('mt::DATE')} END::VARCHAR AS cycle_start, CASE WHEN c IN (4, 5, 7) THEN NULL WHEN c = 2 THEN 2 ELSE 1 END::BIGINT AS legs, CASE WHEN c = 0 THEN 1000.5 END::DOUBLE AS reported FROM m""",
)
def message_outcomes(spark, d):
    return parsed(spark, d).select("id", "status", "kind", "form", "error", F.date_format("posted_at", "yyyy-MM-dd HH:mm").alias("posted_at"), F.col("cycle_start").cast("string"), F.when(F.col("legs").isNotNull(), F.size("legs")).cast("long").alias("legs"), F.col("snapshot.balance").cast("double").alias("reported"))


@query(
    "message_legs",
    f"""WITH {_M}, l AS (SELECT id, c, amount, unnest(CASE c WHEN 0 THEN [('rajhi_card', 'debit', false)] WHEN 1 THEN [('barq', 'credit', false)] WHEN 2 THEN [('saib_current', 'debit', true), ('saib_savings', 'credit', true)] WHEN 3 THEN [('saib_current', 'debit', false)] WHEN 6 THEN [('saib_savings', 'credit', false)] ELSE [] END) AS leg FROM m)
SELECT sha256(id || '|' || leg[1] || '|' || leg[2]) AS id, id AS raw_message_id, leg[1] AS account, leg[2] AS direction, leg[3] AS is_internal, amount::DOUBLE AS amount, ['purchase', 'transfer', 'transfer', 'bill_payment', NULL, NULL, 'profit'][c + 1] AS type, CASE c WHEN 0 THEN 'Corner Shop' END AS merchant, CASE c WHEN 3 THEN 'Water' END AS biller FROM l""",
)
def message_legs(spark, d):
    return parser.ledger_legs(parsed(spark, d)).select("id", "raw_message_id", "account", "direction", "is_internal", F.col("amount").cast("double"), "type", "merchant", "biller")


@query(
    "message_status_counts",
    f"WITH {_M}, s AS (SELECT {_STATUS} AS status, c FROM m) SELECT count(*) AS messages, count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'ignored') AS ignored, count(*) FILTER (status = 'needs_review') AS needs_review, round(count(*) FILTER (status = 'parsed') / nullif(count(*) FILTER (status <> 'ignored'), 0), 6) AS parse_rate FROM s",
)
def message_status_counts(spark, d):
    return queue.status_counts(parsed(spark, d))


@query("parked_shapes", f"WITH {_M} SELECT CASE c WHEN 5 THEN 'Nobody' ELSE 'AlRajhiBank' END AS sender, count(*) AS messages, max(mt + INTERVAL 2 MINUTE)::VARCHAR AS newest, min(mt + INTERVAL 2 MINUTE)::VARCHAR AS oldest FROM m WHERE c IN (5, 7) GROUP BY c")
def parked_shapes(spark, d):
    """Messages that wait for a review by their shape: one kind of wording is one row."""
    found = queue.parked_shapes(parsed(spark, d).where("status = 'needs_review'"))
    return found.select("sender", "messages", F.col("newest").cast("string"), F.col("oldest").cast("string"))


@query("parked_members", f"WITH {_M} SELECT id, CASE c WHEN 5 THEN 'Nobody' ELSE 'AlRajhiBank' END AS sender, count(*) OVER (PARTITION BY c) AS messages FROM m WHERE c IN (5, 7)")
def parked_members(spark, d):
    """The messages of each parked group, by their ids."""
    return queue.parked_members(parsed(spark, d).where("status = 'needs_review'")).select("id", "sender", "messages")


@query("message_redaction", f"WITH {_M} SELECT c, count(*) AS n, count(*) FILTER (c = 4) AS redacted, 0::BIGINT AS codes_left FROM m GROUP BY c")
def message_redaction(spark, d):
    """What is stored of one-time codes: no column of any row still holds the code 4455."""
    rows = parser.redacted(parsed(spark, d))
    left = F.contains(F.to_json(F.struct(*(c for c in rows.columns if c not in ("id", "shape")))), F.lit("4455")) & F.contains("body", F.lit("رمز"))
    return rows.groupBy((F.col("id") % 8).alias("c")).agg(F.count("*").alias("n"), F.count_if((F.col("body") == parser.REDACTED) & (F.col("norm") == parser.REDACTED)).alias("redacted"), F.count_if((F.col("kind") == "otp") & (left | F.contains("norm", F.lit("4455")))).alias("codes_left"))


_RAW = "r AS (SELECT event_id AS id, event_type AS sender, props AS body, ts AS received_at FROM events UNION ALL SELECT event_id + 1000000000, event_type, props, date_trunc('minute', ts) FROM events WHERE event_id % 50 = 0)"


def _resubmitted(spark, d):
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("sender"), F.col("props").alias("body"), F.col("ts").alias("received_at"))
    return rows.unionByName(rows.where("id % 50 = 0").withColumns({"id": F.col("id") + 1_000_000_000, "received_at": F.date_trunc("minute", "received_at").cast(rows.schema["received_at"].dataType)}))


@query(
    "idempotent_append",
    f"WITH {_RAW}, h AS (SELECT *, sha256(sender || '|' || body || '|' || strftime(received_at, '%Y-%m-%d %H:%M')) AS body_hash FROM r), stored AS (SELECT DISTINCT body_hash FROM h WHERE id % 4 = 0) SELECT body_hash, min(id) AS id FROM h ANTI JOIN stored USING (body_hash) GROUP BY body_hash",
)
def idempotent_append(spark, d):
    """Of messages that come again the first stays, and none that is stored already."""
    rows = queue.hashed(_resubmitted(spark, d))
    return queue.new_messages(rows, rows.where("id % 4 = 0").select("body_hash")).select("body_hash", "id")


_QUEUE = "q AS (SELECT event_id AS id, ts AS received_at, ['pending', 'processing', 'parsed', 'failed', 'processing'][event_id % 5 + 1] AS status, event_id % 4 AS attempts, TIMESTAMP '2024-01-31 00:00:00' - to_minutes(event_id % 25) AS last_attempt_at FROM events)"
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _queued(spark, d):
    k = F.col("event_id")
    status = F.get(F.array(*map(F.lit, ("pending", "processing", "parsed", "failed", "processing"))), (k % 5).cast("int"))
    return S.table(spark, d, "events").select(k.alias("id"), F.col("ts").alias("received_at"), status.alias("status"), (k % 4).alias("attempts"), (F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(mins=(k % 25).cast("int"))).alias("last_attempt_at"))


@query("claimed_messages", f"WITH {_QUEUE} SELECT id, status, received_at::VARCHAR AS received_at FROM q WHERE status = 'pending' OR (status = 'processing' AND last_attempt_at < {_NOW} - INTERVAL 10 MINUTE) ORDER BY q.received_at, id LIMIT 50")
def claimed_messages(spark, d):
    """The 50 that the next tick takes: the limit is the feature."""
    return queue.claimed(_queued(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select("id", "status", F.col("received_at").cast("string"))


@query("exhausted_messages", f"WITH {_QUEUE} SELECT id, CASE WHEN status = 'processing' AND attempts >= 3 AND last_attempt_at < {_NOW} - INTERVAL 10 MINUTE THEN 'failed' ELSE status END AS status FROM q")
def exhausted_messages(spark, d):
    return queue.parked_exhausted(_queued(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select("id", "status")


@query(
    "text_fields",
    r"""SELECT doc_id, CASE WHEN regexp_matches(t, '[\x{0600}-\x{06FF}]') THEN 'ar' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language, contains(t, 'SAR') OR contains(t, 'SR') AS states_currency,
CASE WHEN length(regexp_replace(s, '[^0-9]', '', 'g')) >= 3 THEN right(regexp_replace(s, '[^0-9]', '', 'g'), 4) END AS last_digits, TRY_CAST(nullif(replace(regexp_extract(replace(s, ' ', ''), '[0-9][0-9,]*(?:\.[0-9]+)?'), ',', ''), '') AS DECIMAL(14,2))::DOUBLE AS amount
FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') || ' ' || doc_id || ',000.50 end' AS s FROM documents)""",
)
def text_fields(spark, d):
    t, s = F.coalesce("text", F.lit("")), F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.col("doc_id").cast("string"), F.lit(",000.50 end"))
    return S.table(spark, d, "documents").select("doc_id", text.language(t).alias("language"), text.states_currency(t).alias("states_currency"), text.last_digits(s).alias("last_digits"), text.amount(s).cast("double").alias("amount"))


def _legs(spark, d):
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "wallet_topup").otherwise("purchase")
    return S.table(spark, d, "events").select(k.alias("id"), kind.alias("kind"), (F.col("user_id") % 5).cast("string").alias("card"), F.floor("value").cast("decimal(14,2)").alias("amount"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(False).alias("is_internal"))


_CANDIDATES = "l AS (SELECT event_id AS id, event_id % 3 = 0 AS topup, user_id % 5 AS card, floor(value) AS amount, ts FROM events)"


@query(
    "topup_links",
    f"""WITH RECURSIVE {_CANDIDATES}, t AS (SELECT *, row_number() OVER (PARTITION BY card, amount ORDER BY ts, id) AS k FROM l WHERE topup),
g AS (SELECT DISTINCT card, amount, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS topup_id, NULL::BIGINT AS purchase_id FROM t
 UNION ALL SELECT card, amount, k, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, id, p FROM (SELECT g.card, g.amount, g.k + 1 AS k, g.used, t.id, first(p.id ORDER BY abs(epoch_us(p.ts) - epoch_us(t.ts)), p.ts, p.id) AS p FROM g JOIN t ON t.card = g.card AND t.amount = g.amount AND t.k = g.k + 1
   LEFT JOIN l p ON NOT p.topup AND p.card = t.card AND p.amount = t.amount AND abs(epoch_us(p.ts) - epoch_us(t.ts)) <= 300000000 AND NOT list_contains(g.used, p.id) GROUP BY g.card, g.amount, g.k, g.used, t.id))
SELECT topup_id, purchase_id FROM g WHERE purchase_id IS NOT NULL""",
)
def topup_links(spark, d):
    """Each top-up's purchase, one to one and nearest first, in the order of the top-ups."""
    return linking.topup_pairs(_legs(spark, d))


@query("topup_unlinked_expense", f"WITH {_CANDIDATES} SELECT count(*) FILTER (topup) AS topups, sum(amount) FILTER (NOT topup)::DOUBLE AS expense FROM l")
def topup_unlinked_expense(spark, d):
    """What spending would read without any link."""
    return _legs(spark, d).agg(F.count_if(F.col("kind") == "wallet_topup").alias("topups"), F.sum(F.when(F.col("kind") == "purchase", F.col("amount"))).cast("double").alias("expense"))


@query(
    "echoed_transfers",
    """WITH RECURSIVE m AS (SELECT event_id AS id, event_type AS inst, user_id % 5 AS acc, floor(value / 10) AS amount, ts, row_number() OVER (PARTITION BY user_id % 5, floor(value / 10) ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT DISTINCT acc, amount, 0::BIGINT AS k, []::STRUCT(id BIGINT, inst VARCHAR, ts TIMESTAMP)[] AS kept, NULL::BIGINT AS kept_id, NULL::BIGINT AS echo_id FROM m
 UNION ALL SELECT acc, amount, k, CASE WHEN f IS NULL THEN list_append(kept, {'id': id, 'inst': inst, 'ts': ts}) ELSE kept END, f, CASE WHEN f IS NOT NULL THEN id END FROM (SELECT g.acc, g.amount, m.k, m.id, m.inst, m.ts::TIMESTAMP AS ts, g.kept, list_filter(g.kept, lambda x: x.inst <> m.inst AND epoch_us(m.ts) - epoch_us(x.ts) <= 300000000)[1].id AS f FROM g JOIN m ON m.acc = g.acc AND m.amount = g.amount AND m.k = g.k + 1))
SELECT kept_id, echo_id FROM g WHERE echo_id IS NOT NULL""",
)
def echoed_transfers(spark, d):
    """Messages that tell of a transfer once more, and the first that did."""
    legs = F.array(F.struct(F.lit("a").alias("account"), F.lit("debit").alias("direction")), F.struct(F.col("user_id").cast("string").alias("account"), F.lit("credit").alias("direction")))
    rows = S.table(spark, d, "events").withColumn("user_id", F.col("user_id") % 5).select(F.col("event_id").alias("message_id"), F.col("event_type").alias("institution"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.floor(F.col("value") / 10).cast("decimal(14,2)").alias("amount"), F.explode(legs).alias("leg"))
    return linking.echoes(rows.select("message_id", "institution", "ts", "amount", "leg.*"))


@query(
    "strict_transfer_pairs",
    """WITH RECURSIVE l AS (SELECT event_id AS id, event_id % 2 AS side, user_id % 4 AS acc, floor(value / 20) AS amount, (user_id + event_id // 2) % 4 AS named, ts FROM events WHERE event_id % 7 <> 0),
c AS (SELECT o.id AS out_id, i.id AS in_id, abs(epoch_us(o.ts) - epoch_us(i.ts)) AS gap FROM l o JOIN l i ON o.side = 0 AND i.side = 1 AND o.amount = i.amount AND o.acc <> i.acc AND (o.named = i.acc OR i.named = o.acc) AND abs(epoch_us(o.ts) - epoch_us(i.ts)) <= 300000000),
g AS (SELECT out_id, in_id, gap, false AS sure FROM c UNION ALL SELECT out_id, in_id, gap, s FROM (SELECT *, bool_or(s) OVER (PARTITION BY out_id) AS x, bool_or(s) OVER (PARTITION BY in_id) AS y FROM (SELECT *, row_number() OVER (PARTITION BY out_id ORDER BY gap, out_id, in_id) = 1 AND row_number() OVER (PARTITION BY in_id ORDER BY gap, out_id, in_id) = 1 AS s FROM g WHERE NOT sure)) WHERE s OR NOT (x OR y))
SELECT out_id, in_id FROM g WHERE sure""",
)
def strict_transfer_pairs(spark, d):
    """Transfers whose two sides name each other's account, nearest in time first; bills (each seventh event) pair with none."""
    k = F.col("event_id")
    rows = S.table(spark, d, "events").select(k.alias("id"), F.when(k % 7 == 0, "bill_payment").otherwise("transfer").alias("kind"), F.when(k % 2 == 0, "debit").otherwise("credit").alias("direction"), (F.col("user_id") % 4).cast("string").alias("account"), F.floor(F.col("value") / 20).cast("decimal(14,2)").alias("amount"), ((F.col("user_id") + F.floor(k / 2)) % 4).cast("string").alias("counterparty"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return linking.strict_pairs(rows)


@query("failed_attempts", f"WITH {_QUEUE}, a AS (SELECT *, id % 3 = 0 AS bad FROM q) SELECT id, CASE WHEN bad THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN bad THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN bad THEN 2000 END::BIGINT AS error_chars FROM a")
def failed_attempts(spark, d):
    """What is kept of failures: their count, and the first 2000 characters of the error."""
    rows = _queued(spark, d).withColumn("last_error", F.lit(None).cast("string"))
    found = parser.attempted(rows, F.col("id") % 3 == 0, F.repeat(F.lit("error "), F.lit(500)))
    return found.select("id", "status", "attempts", F.length("last_error").cast("long").alias("error_chars"))


@query("requeued_messages", f"WITH {_QUEUE}, s AS (SELECT *, CASE id % 4 WHEN 0 THEN 'a' ELSE 'b' END AS shape FROM q) SELECT id, CASE WHEN shape = 'a' AND status IN ('needs_review', 'failed') THEN 'pending' ELSE status END AS status, CASE WHEN shape = 'a' AND status IN ('needs_review', 'failed') THEN 0 ELSE attempts END AS attempts FROM s")
def requeued_messages(spark, d):
    rows = _queued(spark, d).withColumn("shape", F.when(F.col("id") % 4 == 0, "a").otherwise("b"))
    return queue.requeued(rows, "a").select("id", "status", "attempts")


@query("dismissed_messages", "WITH q AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'needs_review' ELSE 'parsed' END AS status FROM events) SELECT id, CASE WHEN id % 3 = 0 AND status = 'needs_review' THEN CASE WHEN id % 9 = 0 THEN 'needs_review' ELSE 'ignored' END ELSE status END AS status, CASE WHEN id % 3 = 0 AND id % 9 <> 0 AND status = 'needs_review' THEN 'user' END AS ignored_reason FROM q")
def dismissed_messages(spark, d):
    """A third is dismissed, a third of these is restored; parsed ones stay."""
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "needs_review").otherwise("parsed").alias("status"), F.lit(None).cast("string").alias("ignored_reason"))
    gone = queue.dismissed(rows, rows.where("id % 3 = 0").select("id"))
    return queue.dismissed(gone, rows.where("id % 9 = 0").select("id"), restore=True)


@query(
    "labelled_amounts",
    r"SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 1234.5 + event_id % 10 WHEN 1 THEN 12 + event_id % 10 WHEN 2 THEN 7.25 END::DOUBLE AS amount FROM events",
)
def labelled_amounts(spark, d):
    """A grand total is taken before a subtotal, which is before a fee."""
    k = F.col("event_id")
    total, sub = (k % 10 + 1234).cast("string"), (k % 10 + 12).cast("string")
    body = F.when(k % 4 == 0, F.concat(F.lit("amount: 3\ntotal due: "), F.regexp_replace(total, r"^(\d)", "$1,"), F.lit(".5"))).when(k % 4 == 1, F.concat(F.lit("fee 1\namount "), sub)).when(k % 4 == 2, "fee: 7.25 SAR").otherwise("nothing")
    return S.table(spark, d, "events").select(k.alias("id"), text.labelled_amount(body, ["total due", "amount", "fee"]).cast("double").alias("amount"))


_CASH = "سحب نقدي\nالقيمة {a} SAR\nالجهاز {m}\n{d}"


@query(
    "derived_form_parse",
    f"WITH {_M} SELECT id, 'BQ-NEW' AS form, amount::DOUBLE AS amount, 'GATE ' || (id % 9) AS merchant, strftime(mt, '%Y-%m-%d %H:%M') AS posted_at FROM m",
)
def derived_form_parse(spark, d):
    """A form derived from one message of a new kind, stored and loaded, reads all others of that kind."""
    from tally.functions import derive
    from tally.functions import forms as M

    body = _CASH.replace("{a}", "630.25").replace("{m}", "HARBOUR GATE").replace("{d}", "2025-11-03 09:41")
    form = derive.derived_form("BQ-NEW", "barq app", body, {"amount": "630.25", "merchant": "HARBOUR GATE", "date": "2025-11-03 09:41"}, "withdrawal", "debit", M.ISO, "barq")
    stored = spark.createDataFrame([derive.as_row(form, "s", 1), derive.as_row(form, "s", 2) | {"id": "BAD", "text": "no {field"}], "id string, sender string, kind string, direction string, date string, text string, account string, shape string, created_at int")
    rows = messages(spark, d).withColumn("sender", F.lit("barq app"))
    printed = F.date_format(F.col("received_at") - F.expr("INTERVAL 2 MINUTES"), "yyyy-MM-dd HH:mm")
    amount = S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").cast("decimal(14,2)").cast("string").alias("a"))
    text_ = F.replace(F.replace(F.replace(F.lit(_CASH), F.lit("{a}"), F.col("a")), F.lit("{m}"), F.concat(F.lit("GATE "), (F.col("id") % 9).cast("string"))), F.lit("{d}"), printed)
    rows = rows.join(amount, "id").withColumn("body", text_).drop("a")
    found = parser.parsed_messages(rows, spark.createDataFrame(IDENTIFIERS, "sender string, value string, account string"), stored=stored)
    return found.select("id", "form", F.get("legs", F.lit(0))["amount"].cast("double").alias("amount"), F.col("details.merchant").alias("merchant"), F.date_format("posted_at", "yyyy-MM-dd HH:mm").alias("posted_at"))


@query("message_snapshots", f"WITH {_M} SELECT id AS raw_message_id, 'rajhi_card' AS account, 1000.5::DOUBLE AS balance, 'sms' AS source, strftime(mt, '%Y-%m-%d %H:%M') AS as_of FROM m WHERE c = 0")
def message_snapshots(spark, d):
    """The balances that messages state."""
    found = parser.snapshots(parsed(spark, d))
    return found.withColumns({"balance": F.col("balance").cast("double"), "as_of": F.date_format("as_of", "yyyy-MM-dd HH:mm")})


@query("message_totals", f"WITH {_M} SELECT coalesce(sum(amount) FILTER (c = 6), 0)::DOUBLE AS income, coalesce(sum(amount) FILTER (c IN (0, 3)), 0)::DOUBLE AS expense, coalesce(sum(CASE WHEN c IN (1, 6) THEN amount WHEN c IN (0, 3) THEN -amount END), 0)::DOUBLE AS net_worth_delta FROM m")
def message_totals(spark, d):
    return parser.totals(parser.ledger_legs(parsed(spark, d)))


@query(
    "label_extraction",
    f"WITH {_M} SELECT id, amount::DOUBLE AS amount, CASE c WHEN 3 THEN '1111' END AS account, CASE c WHEN 3 THEN 'Water' END AS biller, CASE c WHEN 3 THEN '123' END AS invoice, CASE c WHEN 1 THEN '0256' END AS card FROM m WHERE c IN (1, 3)",
)
def label_extraction(spark, d):
    """Bills and top-ups read by the labels of their lines, without any form."""
    rows = messages(spark, d).where("id % 8 IN (1, 3)").withColumn("norm", text.normalized(F.col("body")))
    bill, topup, is_bill = text.bill_payment(F.col("norm")), text.wallet_topup(F.col("norm")), F.col("id") % 8 == 3
    return rows.select("id", F.when(is_bill, bill["amount"]).otherwise(topup["amount"]).cast("double").alias("amount"), F.when(is_bill, bill["from"]).alias("account"), F.when(is_bill, bill["biller"]).alias("biller"), F.when(is_bill, bill["invoice"]).alias("invoice"), F.when(~is_bill, topup["card"]).alias("card"))


@query(
    "raw_message_dump",
    f"""WITH {_QUEUE} SELECT q.id::VARCHAR AS id, e.event_type AS sender, e.props AS body, strftime(q.received_at, '%Y-%m-%dT%H:%M:%SZ') AS received_at, NULL::VARCHAR AS device_sent_at, NULL::VARCHAR AS ingested_at, NULL::VARCHAR AS body_hash, q.status, NULL::VARCHAR AS processed_at, q.attempts::BIGINT AS attempts,
strftime(q.last_attempt_at, '%Y-%m-%dT%H:%M:%SZ') AS last_attempt_at, NULL::VARCHAR AS last_error, NULL::VARCHAR AS ignored_reason, NULL::VARCHAR AS classification, NULL::VARCHAR AS language, NULL::VARCHAR AS shape_hash, NULL::VARCHAR AS template_id, NULL::VARCHAR AS parse_method, NULL::VARCHAR AS llm_response
FROM q JOIN events e ON e.event_id = q.id ORDER BY q.received_at, q.id LIMIT 200000""",
)
def raw_message_dump(spark, d):
    """All 19 columns of the dump, oldest first; the limit of 200,000 is the dump's own."""
    texts = S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("sender"), F.col("props").alias("body"))
    return sinks.raw_dump(_queued(spark, d).join(texts, "id"))
