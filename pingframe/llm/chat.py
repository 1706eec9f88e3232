"""Preference formatting: a shared prompt from the longest common turn prefix, and paired completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

#: Marks around a turn: "<|role|>\ntext<|end|>\n".
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: The role whose words are learned, its closing mark included.
LEARNED = "assistant"

_TURN = "struct<turn:bigint,role:string,text:string>"


def turns_of(chats: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): the turns of a conversation in order, one row each.

    Order is turn (nulls first), then role, then text, so repeated or unnumbered
    turns have a fixed place; they are turns like others.  A conversation is one
    row, as a rendered example is one string.
    """
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return chats.groupBy(key).agg(F.array_sort(F.collect_list(one)).cast(f"array<{_TURN}>").alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    """Turns as one string; a null role or text is empty."""
    return F.array_join(F.transform(turns, _rendered), "")


def mask(turns: Column, learned: str = LEARNED) -> Column:
    """array of (from, to): the code points of render(turns) that count for the loss: the learned role's texts with their closing marks."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(_rendered(turn))
        begin = state["at"] + F.length(F.coalesce(turn["role"], F.lit(""))) + len(OPEN) + len(MIDDLE)
        span = F.array(F.struct(begin.cast("long").alias("from"), (end - 1).cast("long").alias("to")))       # the line break after the mark is not learned
        return F.struct(end.cast("long").alias("at"), F.when(F.coalesce(turn["role"] == learned, F.lit(False)), F.concat(state["spans"], span))
                        .otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns: role and text equal, nulls equal to nulls."""
    same = F.zip_with(chosen, rejected, lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    both = F.slice(same, F.lit(1), F.least(F.size(chosen), F.size(rejected)))
    first = F.array_position(both, False)
    return F.when(first == 0, F.size(both)).otherwise(first - 1).cast("int")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", learned: str = LEARNED) -> DataFrame:
    """Add n_prompt, prompt, and completion and mask of both sides to rows that hold two arrays of turns (role, text).

    The longest common prefix of turns is rendered once as prompt and never
    learned; what follows is rendered per side, with the code points of the
    learned role's words as mask.  A side that ends with the prefix has an empty
    completion and mask; a null side counts as one without turns.  Equal sides
    share everything.  All columns stay; those named like the results are replaced.
    """
    pairs = pairs.drop("n_prompt", "prompt", *[f"{side}_{x}" for side in ("chosen", "rejected") for x in ("completion", "mask")])
    a, b = spare(pairs, "_a", "_b")
    none = F.array().cast(f"array<{_TURN}>")
    out = pairs.withColumns({a: F.coalesce(chosen, none), b: F.coalesce(rejected, none)})
    out = out.withColumn("n_prompt", common_turns(F.col(a), F.col(b)))
    rest = {side: F.slice(F.col(c), F.col("n_prompt") + 1, F.size(c)) for side, c in (("chosen", a), ("rejected", b))}
    out = out.withColumn("prompt", render(F.slice(F.col(a), F.lit(1), F.col("n_prompt"))))
    for side, turns in rest.items():
        out = out.withColumns({f"{side}_completion": render(turns), f"{side}_mask": mask(turns, learned)})
    return out.drop(a, b)


def swapped_replies(chats: DataFrame, key: str = "conv_id", learned: str = LEARNED, **names: str) -> DataFrame:
    """(key, chosen, rejected): every conversation, and itself up to its last reply with the last reply of its neighbour instead.

    Conversations 2k and 2k + 1 are neighbours: a reply to another conversation
    is the rejected one.  Without a neighbour, or if it never replies, the
    rejected side ends before the reply; a conversation without reply is
    rejected as a whole.  Null ids are left out: they name no conversation.
    """
    chats = chats.where(F.col(key).isNotNull())
    talks = turns_of(chats, key, **names)
    last = F.array_position(F.reverse(F.transform("turns", lambda t: F.coalesce(t["role"] == learned, F.lit(False)))), True)       # 0: never
    at = F.when(last == 0, 0).otherwise(F.size("turns") - last + 1).cast("int")
    talks = talks.withColumn("at", at).withColumn("reply", F.when(F.col("at") > 0, F.slice("turns", F.col("at"), F.lit(1))))
    two = talks.groupBy(F.floor(F.col(key) / 2).alias("_pair")).agg(F.collect_list(F.struct(F.col(key).alias("id"), "turns", "at", "reply")).alias("both"))   # 2 rows at most
    side = two.select("both", F.explode("both").alias("me"))
    other = F.get(F.filter("both", lambda x: x["id"] != F.col("me.id")), F.lit(0))["reply"]
    before = F.slice(F.col("me.turns"), F.lit(1), F.greatest(F.col("me.at") - 1, F.lit(0)))
    return side.select(F.col("me.id").alias(key), F.col("me.turns").alias("chosen"),
                       F.when(F.col("me.at") > 0, F.concat(before, F.coalesce(other, F.array().cast(f"array<{_TURN}>")))).alias("rejected"))
