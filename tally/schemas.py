"""Value sets and types of the ledger, as the queries and assertions use them."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)

# The names that stored rows hold.
DIRECTIONS = ("debit", "credit")
TRANSACTION_TYPES = ("purchase", "withdrawal", "transfer", "card_payment", "loan_payment", "fee", "refund", "income", "profit", "bill_payment", "adjustment")

RAW_MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("sender", T.StringType(), False),
        T.StructField("body", T.StringType(), False),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("device_id", T.StringType()),
    ]
)
