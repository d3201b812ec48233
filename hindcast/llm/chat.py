"""Preference formatting of chat conversations, with DataFrame functions only.

A pair holds a chosen and a rejected conversation. Turns are compared by role
and text; the longest common prefix is rendered once as the prompt, and what
follows on each side is rendered as its completion. Each completion comes with
the spans (code points from its start, end exclusive) that a trainer learns
from: the texts of assistant turns with their end marks. Role headers and other
roles' turns are masked.

Order and nulls: turns stand by number (null first), then role and text, so
equal numbers and repeated rows have one defined order. A null text renders as
empty and a null role as `unknown`; null equals null in the comparison. A pair
with one side missing has an empty completion there and no shared turns. If one
side is the beginning of the other, its completion is empty; equal sides share
all turns and both are empty. Rows with a null pair or an unknown side are left
out. `<|` in a text or role is written `< |`, so that none can close a turn; in a
role `|>` is written `| >` too, and a line end is a space, so that it stays in its header.

All turns of one conversation become one string, which is the result itself;
nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import table

LEARNED_ROLE = "assistant"
TURN_END = "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(TURN_END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """`start-stop` of each learned stretch, joined by commas."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        first = done["at"] + F.length(_header(t))
        stop = first + F.length(_body(t))
        span = F.concat(first.cast("string"), F.lit("-"), stop.cast("string"))
        learned = F.when(t["role"] == LEARNED_ROLE, F.array(span)).otherwise(F.array().cast("array<string>"))
        return F.struct(stop.cast("long").alias("at"), F.concat(done["spans"], learned).alias("spans"))

    return F.aggregate(turns, start, step, lambda done: F.array_join(done["spans"], ","))


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (`chosen` or `rejected`), turn, role, text. One row a pair."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    role = F.translate(F.coalesce(F.col("role"), F.lit("unknown")), "\n\r", "  ")
    for mark in ("<|", "|>"):
        role = F.replace(role, F.lit(mark), F.lit(" ".join(mark)))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    of = {s: F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))).alias(f"_{s}") for s in ("chosen", "rejected")}
    known = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin(*of))
    pairs = known.groupBy("pair_id").agg(*of.values())
    chosen, rejected = F.col("_chosen"), F.col("_rejected")
    equal = F.zip_with(
        chosen, rejected, lambda x, y: F.struct(x["role"].alias("r"), x["text"].alias("t")).eqNullSafe(F.struct(y["role"].alias("r"), y["text"].alias("t")))
    )
    shared = F.when(F.array_contains(equal, F.lit(False)), F.array_position(equal, F.lit(False)) - 1).otherwise(F.size(chosen)).cast("int")
    pairs = pairs.withColumn("n_shared", shared)
    tail = {s: F.slice(c, F.col("n_shared") + 1, F.greatest(F.size(c), F.lit(1))) for s, c in (("chosen", chosen), ("rejected", rejected))}
    return pairs.select(
        "pair_id",
        F.col("n_shared").cast("long").alias("n_shared"),
        F.size(chosen).cast("long").alias("n_chosen"),
        F.size(rejected).cast("long").alias("n_rejected"),
        _rendered(F.slice(chosen, F.lit(1), F.col("n_shared"))).alias("prompt"),
        *[_rendered(tail[s]).alias(s) for s in tail],
        *[_spans(tail[s]).alias(f"{s}_spans") for s in tail],
    )


def with_other_answers(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations, for tables without rated answers.

    Chosen is the conversation itself. Rejected is the same conversation with
    its last assistant turn replaced by the last assistant turn of the
    conversation with the next id (the smallest id follows an id without one).
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    answers = turns.filter(F.col("role") == LEARNED_ROLE)
    last = answers.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("_last"))
    last = last.select("conv_id", F.col("_last.turn").alias("_turn"), F.col("_last.text").alias("_text"))
    following = last.select((F.col("conv_id") - 1).alias("conv_id"), F.lit(True).alias("_follows"), F.col("_text").alias("_other"))
    first = last.agg(F.min_by("_text", "conv_id").alias("_first"))
    # One row.
    plan = last.drop("_text").join(following, "conv_id", "left").join(F.broadcast(first))
    plan = plan.select("conv_id", "_turn", F.when(F.col("_follows"), F.col("_other")).otherwise(F.col("_first")).alias("_other"))
    joined = turns.join(plan, "conv_id", "left")
    replaced = F.when((F.col("role") == LEARNED_ROLE) & F.col("turn").eqNullSafe(F.col("_turn")), F.col("_other")).otherwise(F.col("text"))
    # One row for either side, without reading the table twice.
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), replaced.alias("text"))
    )
    return joined.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("_s")).select("pair_id", "turn", "role", "_s.*")


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_preferences(with_other_answers(table(spark, sf_dir, "conversations")))
