"""Preference pairs: the common turns of two conversations become the prompt, the rest of each a
completion whose assistant turns are to be learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<turn: bigint, role: string, text: string>"


def render(turns: Column) -> Column:
    """The turns as text: ``<|role|>``, a line feed, the turn, a line feed."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def learned(turns: Column, role: str = "assistant") -> Column:
    """start:end of the turns of ``role`` in the rendered text (code points, line feed included)."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"]) + 1
        mine = F.when(t["role"] == role, F.array(F.concat_ws(":", start, end))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(s["out"], mine).alias("out"))

    return F.aggregate(turns, state, step, lambda s: F.array_join(s["out"], ","))


def pairs(turns: DataFrame) -> DataFrame:
    """One row for each pair of ``turns`` (pair_id, chosen, conv_id, turn, role, text): pair_id,
    chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask and
    status.

    ``chosen`` tells the two sides apart.  status is 'pair', 'identical' (no turn differs, both
    completions are empty) or 'unpaired' (one side is missing; all its turns are its completion).
    Masks list the spans of a completion to learn from.  Turns are in the order of turn, role, text,
    which decides ties; repeated rows count once; long texts are rendered whole; null roles and texts are empty; rows without a pair_id or turn belong
    to no pair and are left out; other columns are ignored; an empty table gives an empty result."""
    rows = turns.filter("pair_id is not null and turn is not null and chosen is not null")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda on: F.sort_array(F.collect_set(F.when(F.col("chosen") == on, turn)))
    both = rows.groupBy("pair_id").agg(
        F.min(F.when(F.col("chosen"), F.col("conv_id"))).alias("chosen_id"), F.min(F.when(~F.col("chosen"), F.col("conv_id"))).alias("rejected_id"), side(True).alias("a"), side(False).alias("b")
    )
    same = lambda i: (F.get("a", i)["role"] == F.get("b", i)["role"]) & (F.get("a", i)["text"] == F.get("b", i)["text"])
    shorter = F.least(F.size("a"), F.size("b"))
    first = F.when(shorter > 0, F.aggregate(F.sequence(F.lit(0), shorter - 1), F.lit(0), lambda k, i: F.when((k == i) & same(i), k + 1).otherwise(k))).otherwise(0)
    both = both.withColumn("n", first)
    rest = lambda c: F.when(F.size(c) > F.col("n"), F.slice(c, F.col("n") + 1, F.size(c))).otherwise(F.array().cast(f"array<{TURN}>"))
    both = both.select("pair_id", "chosen_id", "rejected_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("x"), rest("b").alias("y"), (shorter == 0).alias("lone"))
    status = F.when(F.col("lone"), "unpaired").when((F.size("x") == 0) & (F.size("y") == 0), "identical").otherwise("pair")
    return both.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(F.col("x")).alias("chosen"), render(F.col("y")).alias("rejected"),
        learned(F.col("x")).alias("chosen_mask"), learned(F.col("y")).alias("rejected_mask"), status.alias("status"),
    )


def grafted(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """Pairs of turns from conversations without judgements: each one's last turn of ``role`` is chosen
    over the last such turn of another one, put in the same place.

    The other one is the conversation whose number differs in the last bit, so each meets one other.
    Of several such turns in one place the last by text counts; what stands beside or after it is
    left out; conversations without such a turn give no pair, and without a partner that has one
    their pair lacks its rejected side; rows without conv_id or turn belong to none; a null text is
    empty."""
    turns = conversations.filter("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    last = turns.filter(F.col("role") == role).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last")).select("conv_id", F.col("last.turn").alias("at"), F.col("last.text").alias("reply"))
    partner = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("conv_id").alias("other"), F.col("reply").alias("theirs"))
    both = last.join(partner, "conv_id", "left")
    sides = F.filter(
        F.array(F.struct(F.lit(True).alias("chosen"), F.col("conv_id").alias("of"), F.col("reply").alias("said")), F.struct(F.lit(False).alias("chosen"), F.col("other").alias("of"), F.col("theirs").alias("said"))),
        lambda s: s["of"].isNotNull(),
    )
    both = both.select(F.col("conv_id").alias("pair_id"), "at", F.explode(sides).alias("s")).select("pair_id", "at", "s.*")
    replies = both.select("pair_id", "chosen", F.col("of").alias("conv_id"), F.col("at").alias("turn"), F.lit(role).alias("role"), F.col("said").alias("text"))
    before = both.join(turns.withColumnRenamed("conv_id", "pair_id"), "pair_id").filter(F.col("turn") < F.col("at"))
    return replies.unionByName(before.select("pair_id", "chosen", F.col("of").alias("conv_id"), "turn", "role", "text"))
