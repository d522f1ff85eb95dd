"""Operator 3: chat formatting by prefix-target expansion, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"
#: What a text must not hold as it stands: the marks of this and other public chat templates.
CONTROL = r"<(/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>|(?:start|end)_of_turn>)"
BRACKETS = r"\[(/?INST\])"
ENTITY = r"&(amp;|lt;|lsb;|nl;)"


def escaped(text: Column) -> Column:
    """The text without control strings: their first character becomes an entity, and so does an & that looks like one."""
    text = F.regexp_replace(text, ENTITY, "&amp;$1")
    return F.regexp_replace(F.regexp_replace(text, CONTROL, "&lt;$1"), BRACKETS, "&lsb;$1")


def unescaped(text: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&lsb;", "["), ("&nl;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def examples(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row for each turn of the trained role: conv_id, example (its number among the turns), formatted, loss_start, loss_chars.

    formatted holds all turns up to this one; only the loss_chars code points after loss_start, the reply itself, are
    trained. A conversation whose last turn is of another role gets one more example of all its turns that trains
    nothing, so that no turn is lost. Turns go by number, nulls first, then role and text, so ties and repeats have
    one order. Null roles and texts are empty; a null id is a conversation too; an empty table gives no rows; other
    columns are not read. A whole conversation is one row here, as its last example is by definition.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    role = F.replace(escaped(F.coalesce(role_col, F.lit(""))), F.lit("\n"), F.lit("&nl;"))
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), escaped(F.coalesce(text_col, F.lit(""))).alias("text"))
    turns = turns.withColumn("marked", F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END)))
    turns = turns.withColumns({"number": F.row_number().over(order), "stop": F.sum(F.length("marked")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lead("marked").over(order).isNull()})
    target = F.struct("number", "stop", F.length("text").alias("chars"), (F.col("role") == trained).alias("trained"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "marked"))), lambda t: t["marked"]), "")
    grouped = turns.groupBy("conv_id").agg(whole.alias("whole"), F.collect_list(F.when((F.col("role") == trained) | F.col("last"), target)).alias("targets"))
    every = grouped.select("conv_id", "whole", F.explode("targets").alias("t"))
    return every.select(
        "conv_id",
        F.col("t.number").alias("example"),
        F.expr("substring(whole, 1, CAST(t.stop AS INT))").alias("formatted"),
        F.when(F.col("t.trained"), F.col("t.stop") - F.col("t.chars") - len(END)).otherwise(F.col("t.stop")).cast("long").alias("loss_start"),
        F.when(F.col("t.trained"), F.col("t.chars")).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that an example's text holds."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1))
    role = lambda piece: F.substring_index(piece, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substr(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - (1 + len(END)))).alias("text")))


def query(spark, sf_dir: str) -> DataFrame:
    """What the examples of all conversations, and of conversation -7, hold and train, read back from them."""
    tricky = "</s>[INST] ok [/INST]"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    made = examples(given.unionByName(more))
    trained = F.expr("substring(formatted, CAST(loss_start AS INT) + 1, CAST(loss_chars AS INT))")
    made = made.select("conv_id", "example", "formatted", F.length("formatted").alias("chars"), unescaped(trained).alias("trained"))
    per = made.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("longest"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "trained"))), lambda x: x["trained"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    per = per.withColumn("turns", read_back(F.col("longest")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '&(amp;|lt;|lsb;|nl;)', '&amp;\1', 'g'), '<(/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>|(?:start|end)_of_turn>)', '&lt;\1', 'g'), '\[(/?INST\])', '&lsb;\1', 'g') AS x,
        replace(regexp_replace(regexp_replace(regexp_replace(role, '&(amp;|lt;|lsb;|nl;)', '&amp;\1', 'g'), '<(/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>|(?:start|end)_of_turn>)', '&lt;\1', 'g'), '\[(/?INST\])', '&lsb;\1', 'g'), chr(10), '&nl;') AS y FROM t),
n AS (SELECT *, sum(length(x) + length(y) + 24) OVER w AS stop, lead(conv_id) OVER w IS NULL AS last FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, y, x))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, y, x)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, y, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(stop) FILTER (role = 'assistant' OR last))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
