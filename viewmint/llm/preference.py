"""Preference formatting of paired conversations, in DataFrame functions only.

A pair's chosen and rejected conversation share a longest common prefix of
turns.  It is rendered once, as the prompt; what follows in either is rendered
as that side's completion, with a mask that trains on what the assistant says
and on nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The chat template's parts and the role that is trained on.
HEAD, NECK, TAIL = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations_of(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): each conversation's turns in order, as an array.

    Ties of ``turn`` are ordered by role and text, null turns first; a null
    role or text counts as empty.  A row with a null key belongs to no
    conversation with others: it is one of its own.  Repeated rows stay
    repeated turns, texts may be of any length, and other columns are ignored.
    A conversation is one row, as it is one training example.  An empty table
    gives an empty result.
    """
    entry = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def said(ordered: Column) -> Column:
        return F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")

    own = turns.where(F.col(key).isNotNull()).groupBy(key).agg(said(F.sort_array(F.collect_list(entry))))
    return own.unionByName(turns.where(F.col(key).isNull()).select(key, said(F.array(entry))))


def replies_as_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, chosen, rejected) of every conversation of ``turns``.

    The chosen side is the whole conversation.  The rejected side has the same
    turns but for the assistant's last one, whose text is a worse reply: what
    the assistant last said before it in other words, or nothing if it never
    did.  Turns behind the last reply follow it on both sides.  A conversation
    without an assistant turn is chosen whole, against itself.  Nulls, ties and
    repeated rows are as in :func:`conversations_of`.
    """
    whole = conversations_of(turns, key)
    spoken = F.filter(
        F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull()
    )
    found = whole.select(key, "turns", F.try_element_at(spoken, F.lit(-1)).alias("_last"))
    reply = F.get("turns", F.col("_last"))["text"]
    others = F.filter("turns", lambda t, i: (t["role"] == TRAINED) & (t["text"] != reply) & (i < F.col("_last")))
    worse = F.coalesce(F.try_element_at(others, F.lit(-1))["text"], F.lit(""))
    changed = F.transform(
        "turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("_last"), worse).otherwise(t["text"]).alias("text"))
    )
    return found.select(key, F.col("turns").alias("chosen"), changed.alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(
        F.slice(a, F.lit(1), shorter),
        F.slice(b, F.lit(1), shorter),
        lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]),
    )
    differs = F.array_position(same, False)
    return F.when(differs == 0, shorter).otherwise(differs - 1).cast("int")


def rendered(turns: Column) -> Column:
    parts = F.transform(
        turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(NECK), t["text"], F.lit(TAIL))
    )
    return F.array_join(parts, "")


def loss_mask(turns: Column) -> Column:
    """Runs ``flag:characters`` over :func:`rendered`, joined by commas.

    Of an assistant turn the text and the end mark are trained on (flag 1);
    template heads and all other turns are not (flag 0).
    """
    head = len(HEAD) + len(NECK)
    runs = F.transform(
        turns,
        lambda t: F.when(
            t["role"] == TRAINED,
            F.concat(
                F.lit("0:"),
                (F.length(t["role"]) + head).cast("string"),
                F.lit(",1:"),
                (F.length(t["text"]) + len(TAIL)).cast("string"),
            ),
        ).otherwise(
            F.concat(F.lit("0:"), (F.length(t["role"]) + F.length(t["text"]) + head + len(TAIL)).cast("string"))
        ),
    )
    return F.array_join(runs, ",")


def format_preferences(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """``pairs`` (key, chosen, rejected: arrays of (role, text)) -> training rows.

    Null arrays of turns count as empty.  All turns are rendered, whatever
    their length: in the prompt or in the completions.  Equal sides have empty
    completions.  ``usable`` is false where a pair has nothing to prefer: a
    completion in which the assistant says nothing.  A pair is one row;
    repeated rows stay repeated; other columns are ignored; an empty table
    gives an empty result.

    Returns ``key, n_prompt_turns, prompt, chosen, chosen_mask, rejected,
    rejected_mask, usable``.
    """
    kind = "array<struct<role:string,text:string>>"
    sides = pairs.select(
        key,
        *[F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(f"_{c}") for c in ("chosen", "rejected")],
    ).withColumn("n_prompt_turns", common_turns(F.col("_chosen"), F.col("_rejected")))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_prompt_turns") + 1, F.size(side))

    def says(turns: Column) -> Column:
        return F.exists(turns, lambda t: (t["role"] == TRAINED) & (t["text"] != ""))

    return sides.select(
        key,
        "n_prompt_turns",
        rendered(F.slice("_chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        rendered(rest("_chosen")).alias("chosen"),
        loss_mask(rest("_chosen")).alias("chosen_mask"),
        rendered(rest("_rejected")).alias("rejected"),
        loss_mask(rest("_rejected")).alias("rejected_mask"),
        (says(rest("_chosen")) & says(rest("_rejected"))).alias("usable"),
    )
