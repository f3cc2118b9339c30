"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns of a pair is rendered once, as the prompt;
what follows on either side is a completion with the spans that a model is
to learn from: the contents of assistant turns.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks around a turn (fixed values), and the role whose contents are learned.
OPEN, MIDDLE, CLOSE, LEARNED = "<|im_start|>", "\n", "<|im_end|>\n", "assistant"


def rendered(turns: Column) -> Column:
    """Turns as one string; null roles and texts are empty."""
    return F.array_join(F.transform(turns, turn), "")


def turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def learned_spans(pairs: DataFrame, side: str) -> DataFrame:
    """``chosen_id``, ``rejected_id`` and ``side``: the half-open spans, in characters of the rendered turns, of the contents of assistant turns.

    One row per turn and a running length of the pair; it keeps the pairs' partitioning, so nothing is shuffled.
    """
    key = ("chosen_id", "rejected_id")
    turns = pairs.select(*key, F.posexplode(side).alias("n", "t"))
    upto = F.coalesce(F.sum(F.length(turn(F.col("t")))).over(Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (upto + F.length(F.concat(F.lit(OPEN), F.coalesce("t.role", F.lit("")), F.lit(MIDDLE)))).cast("int")
    placed = turns.withColumn("start", start).where(F.col("t.role") == LEARNED)
    span = F.struct("start", (F.col("start") + F.length(F.coalesce("t.text", F.lit("")))).cast("int").alias("stop"))
    return placed.groupBy(*key).agg(F.array_sort(F.collect_list(span)).alias(f"{side}_spans"))


def common_turns(one: Column, other: Column) -> Column:
    """Number of leading turns with equal roles and texts."""
    both = F.least(F.size(one), F.size(other))
    same = F.zip_with(one, other, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(F.slice(same, 1, both), False)
    return F.when(differs == 0, both).otherwise(differs - 1).cast("int")


def preference_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair (``chosen_id``, ``rejected_id``) whose conversations both have turns: ``n_prompt_turns``, ``prompt``, ``chosen``,
    ``rejected``, ``chosen_spans`` and ``rejected_spans`` (what to learn from), and ``usable`` (both completions have such a span).

    Turns are in the order of ``turn``, of equal ones of role and text, nulls first; repeated rows are one turn
    (combined before the shuffle) and rows without ``conv_id`` are left out.  Pairs with a null or missing side are
    left out, repeated pairs are one.  Equal conversations have empty completions.
    """
    wanted = pairs.select("chosen_id", "rejected_id").where("chosen_id is not null and rejected_id is not null").distinct()
    sides = wanted.select("chosen_id", "rejected_id", F.inline(F.array(F.struct(F.col("chosen_id").alias("conv_id"), F.lit(True).alias("is_chosen")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit(False).alias("is_chosen")))))
    turns = conversations.select("conv_id", F.struct("turn", "role", "text").alias("t")).where("conv_id is not null")
    side = lambda flag: F.array_sort(F.collect_set(F.when(F.col("is_chosen") == flag, F.col("t"))))
    both = turns.join(sides, "conv_id").groupBy("chosen_id", "rejected_id").agg(side(True).alias("c"), side(False).alias("r")).where("size(c) > 0 and size(r) > 0")
    rest = lambda name: F.slice(F.col(name), F.col("n") + 1, F.size(name))
    cut = both.withColumn("n", common_turns(F.col("c"), F.col("r"))).select("chosen_id", "rejected_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("prompt"), rest("c").alias("chosen"), rest("r").alias("rejected"))
    met = cut
    for name in ("chosen", "rejected"):
        met = met.join(learned_spans(cut, name), ["chosen_id", "rejected_id"], "left")
    spans = {f"{x}_spans": F.coalesce(f"{x}_spans", F.array().cast("array<struct<start:int,stop:int>>")) for x in ("chosen", "rejected")}
    done = met.withColumns({x: rendered(F.col(x)) for x in ("prompt", "chosen", "rejected")} | spans)
    return done.select("chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected", *spans).withColumn("usable", F.expr("size(chosen_spans) > 0 and size(rejected_spans) > 0"))


def tagged(conv_id: Column, made: bool = False) -> Column:
    """An id of its own for a side: that of a conversation as it is, or of one made from it, which no conversation has."""
    return F.struct(conv_id.alias("id"), F.lit(made).alias("made"))


def tagged_turns(conversations: DataFrame) -> DataFrame:
    """The turns of conversations as they are, by tagged ids; those without an id are left out."""
    return conversations.where("conv_id is not null").select(tagged(F.col("conv_id")).alias("conv_id"), "turn", "role", "text")


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """Each conversation of an even id (a whole number) as the chosen side of the one after it, by tagged ids."""
    even = conversations.select("conv_id").where("conv_id % 2 = 0").distinct()
    return even.select(tagged(F.col("conv_id")).alias("chosen_id"), tagged(F.col("conv_id") + 1).alias("rejected_id"))


def other_endings(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs that share their beginning: the turns of made sides, and the pairs, all by tagged ids.

    The chosen side is a conversation with an assistant turn, the rejected one, made from it, has the same turns up to
    the last of the assistant, and in its place the text of the last one of the next conversation.  Ids are any whole numbers.  Conversations
    whose successor is missing or has no such turn, and those without an id, have no pair.
    """
    turn = F.struct("turn", "role", "text")
    last = conversations.where(F.col("role") == LEARNED).groupBy("conv_id").agg(F.max(turn).alias("last"))
    ends = last.join(last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other")), "conv_id")
    rejected = tagged(F.col("conv_id"), True).alias("conv_id")
    begins = conversations.join(ends, "conv_id").where(turn < F.col("last")).select(rejected, "turn", "role", "text")
    changed = ends.select(rejected, "last.turn", F.lit(LEARNED).alias("role"), F.col("other").alias("text"))
    return begins.unionByName(changed), ends.select(tagged(F.col("conv_id")).alias("chosen_id"), tagged(F.col("conv_id"), True).alias("rejected_id"))
