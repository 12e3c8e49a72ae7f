"""Preference formatting of chosen and rejected conversations.

The turns both conversations begin with are rendered once, as the prompt; what
follows on either side is a completion.  A completion's mask names the stretches a
model is trained on, in code points: what the assistant says, with the end mark, and
no headers or other roles.

Defined results: turns are ordered by number, then role and text, so ties and
repeated rows have one order; a null role or text is empty; turns without
conversation are left out, as is a pair without its other side; equal conversations
have empty completions and ``identical`` set; an empty table gives no rows; only the
named columns are read, so other columns may have any names.  A pair's turns become
one row, as its rendering does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import let, whole

TRAINED_ROLE = "assistant"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))))


def _mask(turns: Column) -> Column:
    """Start and end of each trained stretch of the rendered turns."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.char_length(_header(t))
        end = start + F.char_length(t["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end"))).cast(kind)
        trained = t["role"] == TRAINED_ROLE
        spans = F.when(trained, F.concat(a["spans"], span)).otherwise(a["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def format_preferences(
    turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per pair from the turns of both sides; ``chosen`` tells the sides apart."""
    turn = F.struct(
        F.col(turn_col).alias("turn"), whole(F.col(role_col)).alias("role"), whole(F.col(text_col)).alias("text")
    )
    placed = turns.select(pair.alias("pair_id"), chosen.alias("chosen"), turn.alias("turn"))
    placed = placed.where(F.col("pair_id").isNotNull() & F.col("chosen").isNotNull())
    side = lambda is_chosen: F.array_sort(
        F.collect_list(F.when(F.col("chosen") == is_chosen, F.col("turn")))
    )
    both = placed.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    both = both.where((F.size("c") > 0) & (F.size("r") > 0))
    says = lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    differs = F.zip_with("c", "r", lambda x, y: ~F.coalesce(says(x, y), F.lit(False)))
    longest = F.greatest(F.size("c"), F.size("r"))
    shared = let(
        F.array_position(differs, F.lit(True)),
        lambda at: F.when(at > 0, at - 1).otherwise(longest).cast("int"),
    )
    cut = both.withColumn("shared", shared)
    rest = lambda side: F.slice(side, F.col("shared") + 1, F.size(side))
    cut = cut.select(
        "pair_id",
        F.slice("c", F.lit(1), F.col("shared")).alias("prompt_turns"),
        rest("c").alias("c"),
        rest("r").alias("r"),
    )
    long = lambda c: F.size(c).cast("long")
    return cut.select(
        "pair_id",
        long("prompt_turns").alias("n_prompt_turns"),
        long("c").alias("n_chosen_turns"),
        long("r").alias("n_rejected_turns"),
        _rendered(F.col("prompt_turns")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"),
    )


def mask_text(mask: Column) -> Column:
    return F.concat_ws(
        ",", F.transform(mask, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    )
