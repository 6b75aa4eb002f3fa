"""Chat formatting: each dialogue once for every participant, with that speaker as the assistant.

The result has a row for each message and perspective: the message as it is rendered, whether it counts
towards the loss, and where it stands in the rendered dialogue. Positions come from running sums in two steps
(over parts of a dialogue, then within a part), so that no task holds a whole dialogue. They are worked out from
lengths alone; the texts are shuffled once, to meet their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that give instructions and take no part; they stay what they are in every perspective.
NARRATORS = ("system",)
#: What stands after a message.
END = "<|end|>\n"
#: Turns that one part of a dialogue spans.
PART_TURNS = 256


def perspectives(turns: DataFrame, dialogue: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """(dialogue, perspective, turn, role, name, content, rendered, mask, start, length) for every message and participant.

    perspective is a participant of the dialogue (a speaker who is no narrator). The own messages have role
    assistant, no name and mask 1, those of others role user, the speaker as name and mask 0, narrators' messages
    role system and mask 0. rendered is `<|role name|>\\ncontent<|end|>\\n`; start counts the code points
    rendered before it. Messages stand in the order of turn; equal turns in the order of speaker and of the text's digest. Null
    turns come first. A null text is empty, a null speaker takes part under the name `unknown`, null dialogues
    form one dialogue. A dialogue of narrators alone has no perspective and so no rows. Result rows are messages times
    participants by nature: a dialogue's, and those of all rows without a dialogue together. Running sums are split into
    parts of PART_TURNS turns; messages that share one part (all null turns of a dialogue do) are summed in one task.
    """
    texts = turns.select(
        F.col(dialogue).alias("_d"), F.col(turn).alias("_t"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("_s"), F.coalesce(F.col(text), F.lit("")).alias("_x")
    ).withColumn("_h", F.unhex(F.substring(F.sha2("_x", 256), 1, 32)))
    named = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in (F.col("_d"), F.col("_t"), F.col("_s"), F.hex("_h"))])
    key = F.unhex(F.md5(named))  # 16 bytes for a message
    said = texts.select("_d", "_t", "_s", "_h", F.char_length("_x").cast("long").alias("_n"))  # no texts from here on
    cast = said.where(~F.col("_s").isin(*narrators)).select(F.col("_d").alias("_dd"), F.col("_s").alias("perspective")).distinct()
    seen = said.join(cast, F.col("_d").eqNullSafe(F.col("_dd"))).drop("_dd")
    own, narrates = F.col("_s") == F.col("perspective"), F.col("_s").isin(*narrators)
    seen = seen.select(
        "*",
        F.when(narrates, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.when(~own & ~narrates, F.col("_s")).alias("name"),
        F.when(own & ~narrates, F.lit(1)).otherwise(F.lit(0)).alias("mask"),
    )
    seen = seen.withColumn("length", F.col("_n") + F.char_length(_head()) + len(END)).withColumn("_part", F.floor(F.coalesce(F.col("_t"), F.lit(-(1 << 40))) / PART_TURNS))
    parts = seen.groupBy("_d", "perspective", "_part").agg(F.sum("length").alias("_sum"))
    before = Window.partitionBy("_d", "perspective").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_d").alias("_pd"), F.col("perspective").alias("_pp"), F.col("_part").alias("_q"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    part = ("_d", "perspective", "_part")
    within = Window.partitionBy(*part).orderBy(F.col("_t").asc_nulls_first(), "_s", "_h").rowsBetween(Window.unboundedPreceding, -1)
    again = Window.partitionBy(*part, "_t", "_s", "_h").orderBy("_n")
    placed = seen.withColumn("_own", F.coalesce(F.sum("length").over(within), F.lit(0))).withColumn("_copy", F.row_number().over(again))
    joined = placed.join(parts, F.col("_d").eqNullSafe(F.col("_pd")) & (F.col("perspective") == F.col("_pp")) & (F.col("_part") == F.col("_q")))
    views = joined.select(key.alias("_k"), "_copy", F.struct("perspective", "role", "name", "mask", (F.col("_before") + F.col("_own")).alias("start"), "length").alias("_v"))
    views = views.groupBy("_k", "_copy").agg(F.collect_list("_v").alias("_views"))  # one for each participant
    numbered = texts.withColumn("_k", key).withColumn("_copy", F.row_number().over(Window.partitionBy("_k").orderBy("_h")))
    shown = numbered.join(views, ["_k", "_copy"]).select("_d", "_t", "_x", F.inline("_views"))
    rendered = F.concat(_head(), F.col("_x"), F.lit(END))
    return shown.select(F.col("_d").alias(dialogue), "perspective", F.col("_t").alias(turn), "role", "name", F.col("_x").alias("content"), rendered.alias("rendered"), "mask", "start", "length")


def _head() -> Column:
    """What stands before a message: its role and, where there is one, its speaker's name."""
    return F.concat(F.lit("<|"), F.concat_ws(" ", "role", "name"), F.lit("|>\n"))
