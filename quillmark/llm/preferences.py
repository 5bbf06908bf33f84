"""Chat formatting of preference pairs: the longest common turn prefix once as prompt, then both completions with loss masks.

Turns are aligned by (pair, turn), so that no task needs a whole conversation before the last step, which builds the row of a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def body(text: Column) -> Column:
    return F.concat(text, F.lit("<|end|>\n"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """Rows (pair_id, side, turn, role, text) -> one row per pair that has both sides.

    side is "chosen" or "rejected"; other sides, and rows without pair_id or turn, are left out. A null role or text is
    empty. Of several rows for one turn of a side the smallest (role, text) counts, so repeated rows change nothing. Turns of
    equal number are compared; the prompt ends before the first number at which role or text differ or one side has no turn.
    Result: pair_id, n_prompt_turns, prompt, and for each side its rendered completion, its number of turns and its mask:
    per turn `header length:body length:trained`, comma-joined, where trained is 1 for assistant turns, of which the body
    (text and end mark) counts for the loss. Identical conversations give two empty completions.
    """
    t = turns.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')")
    row = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    aligned = t.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("side") == "chosen", row)).alias("c"), F.min(F.when(F.col("side") == "rejected", row)).alias("r"))
    same = F.coalesce((F.col("c.role") == F.col("r.role")) & (F.col("c.text") == F.col("r.text")), F.lit(False))
    cut = aligned.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("cut"), F.count("c").alias("nc"), F.count("r").alias("nr")).where("nc > 0 and nr > 0").select("pair_id", "cut")
    a = aligned.join(cut, "pair_id").withColumn("shared", F.col("cut").isNull() | (F.col("turn") < F.col("cut")))

    def part(x: str, shared: bool) -> Column:
        keep = F.col("shared") == shared
        trained = (F.col(f"{x}.role") == TRAINED_ROLE).cast("int")
        h, b = header(F.col(f"{x}.role")), body(F.col(f"{x}.text"))
        mask = F.concat_ws(":", F.length(h), F.length(b), trained)
        return F.array_sort(F.collect_list(F.when(keep & F.col(x).isNotNull(), F.struct("turn", F.concat(h, b).alias("s"), mask.alias("m")))))

    g = a.groupBy("pair_id").agg(part("c", True).alias("p"), part("c", False).alias("c"), part("r", False).alias("r"))
    joined = lambda x, f, sep="": F.array_join(F.transform(F.col(x), lambda y: y[f]), sep)
    return g.select("pair_id", F.size("p").cast("long").alias("n_prompt_turns"), joined("p", "s").alias("prompt"), joined("c", "s").alias("chosen"), F.size("c").cast("long").alias("n_chosen_turns"), joined("c", "m", ",").alias("chosen_mask"), joined("r", "s").alias("rejected"), F.size("r").cast("long").alias("n_rejected_turns"), joined("r", "m", ",").alias("rejected_mask"))


def pairs_from_conversations(conv: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: (pair_id, side, turn, role, text).

    Conversation 2k is the chosen one of pair k. The rejected one is the same up to before its last assistant turn, which
    conversation 2k + 1's last assistant turn replaces; what follows it is left out. Pairs of which a conversation is missing or
    has no assistant turn give no rows.
    """
    c = conv.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    last = c.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    pair = F.expr("conv_id div 2 - if(conv_id < 0 and conv_id % 2 <> 0, 1, 0)")
    mine = last.where("conv_id % 2 = 0").select(pair.alias("pair_id"), "conv_id", F.col("last.turn").alias("cut"))
    other = last.where("conv_id % 2 <> 0").select(pair.alias("pair_id"), F.col("last.text").alias("answer"))
    pairs = mine.join(other, "pair_id")
    t = c.join(pairs, "conv_id")
    chosen = t.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    before = t.where("turn < cut").select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    swapped = pairs.select("pair_id", F.lit("rejected").alias("side"), F.col("cut").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), F.col("answer").alias("text"))
    return chosen.unionByName(before).unionByName(swapped)
