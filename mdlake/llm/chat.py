"""Preference formatting: a shared prompt and two masked completions.

Chosen and rejected conversations are compared turn by turn. Their longest
common prefix of turns is rendered once, as the prompt; what is left of each
is rendered as its completion, with the spans of characters that a loss may
count: the assistant's texts and their end marks, not headers or others' turns.

All in DataFrame functions: turns of a conversation are gathered in one row, as
the rendered text is one value.

Defined cases: turns are ordered by number, then role and text, so ties and
repeated turns have one order; a null role or text is an empty one and equals
only its like; a conversation without its partner has an empty prompt, its own
completion and a null other; two equal conversations have empty completions; a
null identifier makes no pair; an empty table gives no rows; marks inside a
text are broken up, so that they start no turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a turn: header before the role, after it, and the turn's end.
OPEN, CLOSE, END = "<|turn:", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: the ordered turns of each conversation, ``array<struct<role, text>>``."""
    one = F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(one))
    return (
        conversations.where(F.col(conv_id).isNotNull())
        .groupBy(F.col(conv_id).alias("conv_id"))
        .agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rendered(turn_list: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(
        F.transform(turn_list, lambda t: F.concat(F.lit(OPEN), _plain(t["role"]), F.lit(CLOSE), _plain(t["text"]), F.lit(END))), ""
    )


def loss_spans(turn_list: Column) -> Column:
    """``array<struct<start, end>>``: characters of the rendered turns that a loss may count."""
    head = lambda t: F.length(_plain(t["role"])) + len(OPEN) + len(CLOSE)
    body = lambda t: F.length(_plain(t["text"])) + len(END)
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head(t)
        end = begin + body(t)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turn_list, start, step, lambda acc: acc["spans"])


def preference_rows(pairs: DataFrame) -> DataFrame:
    """Format ``pairs`` of arrays ``chosen, rejected`` (null where there is
    none): adds ``n_prompt_turns, prompt, chosen_text, chosen_spans,
    rejected_text, rejected_spans`` and drops the arrays."""
    both = pairs.withColumn("n_prompt_turns", F.coalesce(common_turns(F.col("chosen"), F.col("rejected")), F.lit(0)))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c), F.lit(0)))
    return (
        both.withColumn("prompt", rendered(F.slice(F.coalesce("chosen", "rejected"), F.lit(1), F.col("n_prompt_turns"))))
        .withColumns({"chosen": rest("chosen"), "rejected": rest("rejected")})
        .withColumns({f"{c}_{n}": f(F.col(c)) for c in ("chosen", "rejected") for n, f in (("text", rendered), ("spans", loss_spans))})
        .drop("chosen", "rejected")
    )


def pair_up(turn_rows: DataFrame, pair_id: Column, is_chosen: Column) -> DataFrame:
    """``pair_id, chosen, rejected`` from rows of :func:`turns`: each pair has
    at most one of either kind, or else the smallest ``conv_id`` of them."""
    kind = lambda ok: F.min_by(F.when(ok, F.col("turns")), F.when(ok, F.col("conv_id")))
    return turn_rows.groupBy(pair_id.alias("pair_id")).agg(kind(is_chosen).alias("chosen"), kind(~is_chosen).alias("rejected"))
