"""Legs that describe one movement: wallet top-ups with their purchases, and echoes of a transfer."""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.operators.lineage import settled
from tally.operators.pairing import nearest_in_time

WINDOW_SECONDS = 300
#: Rows of one card and amount that a task pairs at a time.
BLOCK_ROWS = 20_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _blocks(rows: DataFrame, keys: list[str], reach: int, block_rows: int) -> DataFrame:
    """(keys, slot, n, block, opens, closes, joined): the block of each slot of 2 * reach microseconds that has rows, and the block's bounds; n counts the slot's rows.

    Blocks of a key are numbered in time. One ends before a slot without rows, which no pair crosses, or when it is full; joined says
    whether the block before it ends where this one begins. Blocks that no top-up and purchase could share are left out.
    """
    order, long = Window.partitionBy(*keys).orderBy("slot"), 2 * reach
    slots = rows.groupBy(*keys, "slot").agg(F.count("*").alias("n"), F.count_if("is_topup").alias("topups"))
    slots = slots.withColumn("apart", (F.col("slot") - F.coalesce(F.lag("slot").over(order), F.col("slot") - 2) > 1).cast("int"))
    slots = slots.withColumn("run", F.sum("apart").over(order))
    run = Window.partitionBy(*keys, "run")
    both = (F.sum("topups").over(run) > 0) & (F.sum("topups").over(run) < F.sum("n").over(run))
    slots = slots.withColumn("both", both).withColumn("fill", F.floor((F.sum("n").over(run.orderBy("slot")) - F.col("n")) / block_rows)).where("both")
    slots = slots.withColumn("block", F.dense_rank().over(Window.partitionBy(*keys).orderBy("run", "fill")))
    block = Window.partitionBy(*keys, "block")
    slots = slots.withColumns({"opens": F.min("slot").over(block) * long, "closes": (F.max("slot").over(block) + 1) * long, "joined": F.min("fill").over(block) > F.min("fill").over(run)})
    return slots.select(*keys, "slot", "n", "block", "opens", "closes", "joined")


def topup_pairs(legs: DataFrame, seconds: int = WINDOW_SECONDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(topup_id, purchase_id): each top-up in order of (ts, id) with the nearest free purchase of the same card and cents.

    legs has id, kind, card, amount, ts and is_internal. Equally near purchases go by (ts, id). Nothing is paired twice.
    Legs without a card or an amount are left out: they have nothing to match on. So are those that have a
    transfer_group already, if legs has that column, so that a second run over a grown table takes nothing anew.

    A busy card and amount is cut into blocks of time that are paired side by side. What a block's top-ups take beyond its
    edge the next block must leave: blocks that were told otherwise are paired again, until what each was told is what the block
    before it takes. Then all is as one pass in time order would have it, whatever the number of rounds.
    """
    if "transfer_group" in legs.columns:
        legs = legs.where("transfer_group IS NULL")
    reach, keys = seconds * 1_000_000, ["card", "cents"]
    rows = legs.where("kind IN ('wallet_topup', 'purchase') AND card IS NOT NULL AND amount IS NOT NULL AND ts IS NOT NULL AND NOT (kind = 'purchase' AND is_internal)")
    at = _micros(F.col("ts"))
    rows = rows.select("id", (F.col("kind") == "wallet_topup").alias("is_topup"), "card", F.round(F.col("amount") * 100).cast("long").alias("cents"), at.alias("at"), F.floor(at / (2 * reach)).alias("slot"))
    blocks = settled(_blocks(rows, keys, reach, block_rows))
    known = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_or("joined"), F.lit(False)).alias("cut")).first()
    cut, tasks = known["cut"], 1 + known["n"] // block_rows
    dealt = rows.join(blocks.drop("n"), [*keys, "slot"])
    if cut:
        near_start, near_end = (F.col("at") < F.col("opens") + reach) & F.col("joined"), F.col("at") >= F.col("closes") - reach
        seen_by = F.when(F.col("is_topup"), F.array("block")).otherwise(F.array_compact(F.array(F.col("block"), F.when(near_start, F.col("block") - 1), F.when(near_end, F.col("block") + 1))))
        dealt = settled(dealt.select("id", "is_topup", *keys, "at", near_end.alias("at_edge"), F.col("block").alias("home"), F.explode(seen_by).alias("block")))
        starts = blocks.where("joined").select(*keys, "block").distinct()
        dealt = dealt.join(starts.withColumn("joins", F.lit(True)), [*keys, "block"], "left").where("home >= block OR joins").drop("joins", "home")
    else:
        dealt = dealt.select("id", "is_topup", *keys, "at", F.lit(False).alias("at_edge"), "block")
    card, kind = (dealt.schema[c].dataType.simpleString() for c in ("card", "id"))

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values([*keys, "block", "at", "id"]), []
        told = zip(*(group[c].tolist() for c in (*keys, "block", "at", "id", "is_topup", "taken")))
        for block, some in groupby(told, key=lambda row: row[:3]):
            some = list(some)
            free = [row[3:5] for row in some if not row[5] and not row[6]]
            for moment, topup in (row[3:5] for row in some if row[5]):
                after = bisect_left(free, (moment,))
                near = [(moment - free[after - 1][0], bisect_left(free, (free[after - 1][0],)))] if after else []
                near += [(free[after][0] - moment, after)] if after < len(free) else []
                if near and min(near)[0] <= reach:
                    out.append((*block, topup, *free.pop(min(near)[1])))
        return pd.DataFrame(out, columns=["card", "cents", "block", "topup_id", "at", "purchase_id"])

    def paired(some: DataFrame) -> DataFrame:
        return some.groupBy(F.pmod(F.xxhash64(*keys, "block"), F.lit(tasks)).alias("task")).applyInPandas(pair, f"card {card}, cents long, block int, topup_id {kind}, at long, purchase_id {kind}")

    pairs = paired(dealt.withColumn("taken", F.lit(False)))
    if not cut:
        return pairs.select("topup_id", "purchase_id")
    pairs = settled(pairs)
    edges = blocks.select(*keys, "block", "closes").distinct()
    told = pairs.select(*keys, "block", "purchase_id").limit(0)
    while True:
        takes = pairs.join(edges, [*keys, "block"]).where(F.col("at") >= F.col("closes") - reach).select(*keys, (F.col("block") + 1).alias("block"), "purchase_id").join(starts, [*keys, "block"], "left_semi")
        takes = settled(takes)
        one = [*keys, "block", "purchase_id"]
        again = settled(takes.join(told, one, "left_anti").union(told.join(takes, one, "left_anti")).select(*keys, "block").distinct())
        if again.isEmpty():
            return pairs.select("topup_id", "purchase_id")
        left = takes.select(*keys, "block", F.col("purchase_id").alias("id"), F.lit(True).alias("taken"))
        redone = dealt.join(again, [*keys, "block"], "left_semi").join(left, [*keys, "block", "id"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)) & ~F.col("is_topup"))
        pairs, told = settled(pairs.join(again, [*keys, "block"], "left_anti").unionByName(paired(redone))), takes


def linked_topups(legs: DataFrame, owned_cards: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """legs with is_internal and transfer_group: pairs share a group; a top-up of an owned card is internal even alone.

    Running it again, also after more legs came, changes no pair that was made before.
    """
    mine = legs.join(owned_cards.select("card").distinct(), "card", "left_semi")
    pairs = topup_pairs(mine, seconds)
    group = F.concat(F.lit("tg-"), F.col("topup_id").cast("string"))
    members = pairs.select(F.col("topup_id").alias("__id"), group.alias("__group")).unionByName(pairs.select(F.col("purchase_id").alias("__id"), group.alias("__group")))
    owned = owned_cards.select(F.col("card").alias("__card")).distinct()
    out = legs.join(members, F.col("id") == F.col("__id"), "left").join(owned, F.col("card") == F.col("__card"), "left")
    internal = F.col("is_internal") | F.col("__group").isNotNull() | ((F.col("kind") == "wallet_topup") & F.col("__card").isNotNull())
    return out.withColumns({"is_internal": internal, "transfer_group": F.col("__group")}).select(*legs.columns, "transfer_group") if "transfer_group" not in legs.columns else out.withColumns({"is_internal": internal, "transfer_group": F.coalesce("__group", "transfer_group")}).select(*legs.columns)


def _reached(roots: DataFrame, jump: DataFrame) -> DataFrame:
    """All (me) that the pointers of jump (me, next) reach from the roots: their length doubles each round, so a chain takes its logarithm."""
    reached, jump = settled(roots), settled(jump)
    while True:
        more = settled(reached.join(jump, "me").select(F.col("next").alias("me")))
        if more.isEmpty():
            return reached
        reached = settled(reached.union(more))
        on = jump.select(F.col("me").alias("next"), F.col("next").alias("__then"))
        jump = settled(jump.join(on, "next").select("me", F.col("__then").alias("next")))


def echoes(legs: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(kept_id, echo_id) of messages: two institutions' descriptions of one movement between two accounts.

    legs has message_id, institution, ts, account, direction and amount. Only messages of exactly two legs and a time count. In
    order of (ts, id) a message is an echo of the first kept one of another institution within the window, else kept. A null
    institution counts as one more.

    All kept messages within a window of the last one are of its institution (another's would have made it an echo). So
    which is kept next follows from the last kept alone: the next of its institution or the first beyond the window,
    whichever comes first. The kept ones are what these pointers reach from the messages that have none in the window before them.
    Time is cut into views of 16 windows; only what lies near a view's edge is seen in the next one too, and a signature is its digest.
    """
    reach = seconds * 1_000_000
    long = 16 * reach
    cents = F.round(F.col("amount") * 100).cast("long")
    told = legs.where("ts IS NOT NULL").groupBy(F.col("message_id").alias("id"), F.coalesce(F.col("institution").cast("string"), F.lit("")).alias("institution"), _micros(F.col("ts")).alias("at")).agg(F.array_sort(F.collect_list(F.struct("account", "direction", cents.alias("cents")))).alias("legs"))
    rows = told.where(F.size("legs") == 2).select(F.unhex(F.md5(F.to_json("legs"))).alias("signature"), F.struct("at", "id", "institution").alias("me"), "institution", "at", F.floor(F.col("at") / long).alias("slot"))
    within = F.col("at") - F.col("slot") * long
    place = lambda k, when=F.lit(True): F.when(when, F.struct((F.col("slot") + k).alias("view"), F.lit(k == 0).alias("own")))
    earlier, later = place(-1, within < 2 * reach), place(1, within >= long - reach)
    seen_in = lambda *places: F.explode(F.array_compact(F.array(place(0), *places))).alias("v")
    view = rows.select("signature", "me", "institution", "at", "slot", seen_in(earlier, later)).select("*", "v.*").drop("v")
    order = Window.partitionBy("signature", "view").orderBy("me")
    before, after = F.lag("at").over(order), F.lead("at").over(order)
    view = view.withColumns({"first": F.coalesce(F.col("at") - before > reach, F.lit(True)), "alone": F.coalesce(F.col("at") - before > reach, F.lit(True)) & F.coalesce(after - F.col("at") > reach, F.lit(True))})
    target = F.struct("me", "first")
    same = F.lead(target).over(Window.partitionBy("signature", "view", "institution").orderBy("me"))
    beyond = F.min(target).over(Window.partitionBy("signature", "view").orderBy("at").rangeBetween(reach + 1, 2 * reach))
    view = view.withColumns({"same": same, "beyond": beyond}).where("own AND NOT alone")
    following = F.when(F.col("same.me.at") - F.col("at") <= reach, F.col("same")).otherwise(F.col("beyond"))
    nodes = settled(view.select("signature", "me", "at", "slot", "first", F.when(~following["first"], following["me"]).alias("next")))
    kept = _reached(nodes.where("first").select("me"), nodes.where("next IS NOT NULL").select("me", "next"))
    marked = nodes.join(kept.withColumn("kept", F.lit(True)), "me", "left").select("signature", "me", "at", "slot", F.col("kept").isNotNull().alias("kept"), seen_in(later)).select("*", "v.*")
    since = Window.partitionBy("signature", "view").orderBy("at").rangeBetween(-reach, 0)
    first = F.min(F.when(F.col("kept"), F.col("me"))).over(since)
    return marked.withColumn("of", first).where("own AND NOT kept").select(F.col("of.id").alias("kept_id"), F.col("me.id").alias("echo_id"))


def superseded_legs(legs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(leg_id, superseded_by): an echo's leg yields to the kept message's leg of the same account and direction."""
    kept = legs.select(F.col("message_id").alias("kept_id"), "account", "direction", F.col("id").alias("superseded_by"))
    return legs.join(pairs, legs["message_id"] == pairs["echo_id"]).join(kept, ["kept_id", "account", "direction"]).select(F.col("id").alias("leg_id"), "superseded_by")


def strict_pairs(legs: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(out_id, in_id): transfers matched one to one on cents and opposite direction, where either side names the other's account.

    legs has id, kind, account, direction, amount, ts and counterparty (the owned account that the message names, null if
    none). Only transfers pair, never with their own account. The nearest in time pair first, ties by the ids, until no
    candidate is left; ids are unique. A debit and a credit of one amount have a list in common if the debit names the credit's account, or
    the credit the debit's, so pairing.nearest_in_time needs no table of candidates.
    """
    cents = F.round(F.col("amount") * 100).cast("long")
    rows = legs.where("kind = 'transfer' AND amount IS NOT NULL AND ts IS NOT NULL AND account IS NOT NULL AND id IS NOT NULL").select("id", "account", "direction", "counterparty", cents.cast("string").alias("key"), _micros(F.col("ts")).alias("at")).distinct()
    named = lambda role, account: F.concat(F.lit(role), F.col(account).cast("string"))
    other = F.col("counterparty") != F.col("account")  # a leg that names its own account names no other side
    side = lambda which, own, names: rows.where(F.col("direction") == which).select("id", "key", "at", F.lit(None).cast("long").alias("low"), F.array_compact(F.array(named(own, "account"), F.when(other, named(names, "counterparty")))).alias("lists"))
    reach = seconds * 1_000_000
    given = side("debit", "of ", "to ").withColumns({"until": F.lit(reach).cast("long"), "high": F.lit(None).cast("long")})
    return nearest_in_time(given, side("credit", "to ", "of "), reach, both_ways=True)
