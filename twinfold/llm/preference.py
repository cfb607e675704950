"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common turn prefix of the two is rendered once as the prompt; what follows it in each is a
completion, in which only the assistant's turns carry loss: masks are lists of character spans.
Each conversation's turns are gathered once, in order; a pair's two lists are compared place by place, so no
conversation is compared but with its partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.plans.storage import join_facts

#: Pairs of one chosen conversation that meet it in one place; one with more of them is dealt to several, with its turns.
PAIRS = 100

#: A rendered turn.
BEFORE, BETWEEN, AFTER = "<|", "|>\n", "\n<|end|>\n"


def star_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learner: str = "assistant", with_counts: bool = False) -> DataFrame:
    """Rows (pair_id, chosen, rejected[, n_pairs]): among conversations with the same first turn, the one with most characters by
    the learner (of equals the smallest id) is chosen against each other one. A group of n gives n - 1 pairs, n_pairs.

    A null role or text counts as empty; rows without a conversation or number are left out; identical rows count once, of different rows with the first number the one with the
    smallest digest is the first turn. An empty table gives no pairs; very long turns are compared by a 256-bit digest. Other columns are ignored."""
    rows = turns.where(F.col(conv).isNotNull() & F.col(turn).isNotNull())
    chars = F.when(F.col(role) == learner, F.length(F.coalesce(text, F.lit("")))).otherwise(0)
    said = rows.select(F.col(conv).alias("c"), F.col(turn).alias("first"), chars.alias("chars"), F.sha2(F.concat_ws("\x00", F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))), 256).alias("head")).distinct()
    facts = said.groupBy("c").agg(F.min("first").alias("first"), F.sum("chars").cast("bigint").alias("score"))
    heads = said.groupBy("c", "first").agg(F.min("head").alias("head"))
    known = facts.join(heads, ["c", "first"]).select("c", "score", "head")
    best = known.groupBy("head").agg(F.max(F.struct("score", (-F.col("c")).alias("low"))).alias("m"), F.count("*").alias("n")).select("head", (-F.col("m.low")).alias("chosen"), (F.col("n") - 1).alias("n_pairs"))
    return join_facts(known, best, ["head"]).where("c <> chosen").select(F.col("c").alias("pair_id"), "chosen", F.col("c").alias("rejected"), *(["n_pairs"] * with_counts))


def stale_replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learner: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(pairs, turns), pairs as of star_pairs(), for conversations without a partner: each, up to the learner's last turn, is chosen against itself with
    that turn's text replaced by that of the learner's turn before (empty if there is none). The rejected one's id is -1 - id.
    Turns are numbered anew in the order of (turn, role, text), identical rows once, so those of one number stay apart.

    Nulls as in star_pairs(); a conversation in which the learner says nothing gives no pair, an empty table none. Other columns are ignored."""
    rows = turns.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint"))
    said = rows.where(F.col("role") == learner)
    before = said.withColumn("stale", F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn")))
    last = before.groupBy("conv_id").agg(F.max(F.struct("turn", "stale")).alias("m")).select("conv_id", F.col("m.turn").alias("end"), "m.stale")
    up_to = rows.join(last, "conv_id").where(F.col("turn") <= F.col("end"))
    swapped = F.when(F.col("turn") == F.col("end"), F.col("stale")).otherwise(F.col("text"))
    other = (-1 - F.col("conv_id")).alias("conv_id")
    both = up_to.select("conv_id", "turn", "role", "text").unionByName(up_to.select(other, "turn", "role", swapped.alias("text")))
    return last.select((-1 - F.col("conv_id")).alias("pair_id"), F.col("conv_id").alias("chosen"), (-1 - F.col("conv_id")).alias("rejected"), F.lit(1).cast("bigint").alias("n_pairs")), both


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEFORE), role, F.lit(BETWEEN), text, F.lit(AFTER))


def preference_rows(pairs: DataFrame, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learner: str = "assistant") -> DataFrame:
    """Rows (pair_id, chosen, rejected, n_prompt_turns, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask).

    turns of a conversation are ordered by their number; a null role or text counts as empty; rows with the same number are
    turns one after another by (role, text), identical ones once; rows without a conversation or number are left out, pairs with an unknown conversation too.
    A mask lists [start, end) in characters of the completion, one span for each of the learner's turns, from its text to its end mark.
    Equal conversations give two empty completions. No pairs or no turns give no rows; a very long turn is rendered whole in its pair's row. Other columns are
    ignored, but n_pairs of pairs: how many have the same chosen one, which is counted otherwise and only deals the work.
    """
    said = turns.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("no"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    whole = said.distinct().groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("no", F.struct("role", "text").alias("said")))).alias("s"))
    whole = whole.select("conv", F.transform("s", lambda x: x["said"]).alias("turns"))
    if "n_pairs" not in pairs.columns:
        pairs = join_facts(pairs, pairs.groupBy("chosen").agg(F.count("*").alias("n_pairs")), ["chosen"])
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("rejected"), F.greatest(F.lit(1), F.ceil(F.col("n_pairs") / PAIRS))).cast("int"))
    met = dealt.select("chosen", "share").distinct().join(whole.select(F.col("conv").alias("chosen"), F.col("turns").alias("a")), "chosen")
    wide = dealt.join(whole.select(F.col("conv").alias("rejected"), F.col("turns").alias("b")), "rejected").join(met, ["chosen", "share"])
    least = F.least(F.size("a"), F.size("b"))
    wide = wide.withColumn("differ", F.array_position(F.transform(F.arrays_zip("a", "b"), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False))), False).cast("int"))
    wide = wide.withColumn("k", F.when(F.col("differ") > 0, F.col("differ") - 1).otherwise(least))

    def shown(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda t: _rendered(t["role"], t["text"])), "")

    def rest(of: str) -> Column:
        return F.slice(F.col(of), F.col("k") + 1, F.greatest(F.size(of) - F.col("k"), F.lit(0)))

    lead = len(BEFORE) + len(BETWEEN)
    step = "struct(acc.at + length(t.role) + length(t.text) + {whole} AS at, if(t.role = '{learner}', array_append(acc.spans, array(acc.at + {lead} + length(t.role), acc.at + {lead} + length(t.role) + length(t.text) + {end})), acc.spans) AS spans)"
    step = step.format(whole=lead + len(AFTER), lead=lead, end=len(AFTER), learner=learner.replace("\\", "\\\\").replace("'", "\\'"))

    def mask(of: str) -> Column:
        return F.expr(f"aggregate({of}, struct(0 AS at, cast(array() AS array<array<int>>) AS spans), (acc, t) -> {step}).spans")

    wide = wide.withColumns({"prompt": shown(F.slice("a", F.lit(1), F.col("k"))), "rest_a": rest("a"), "rest_b": rest("b")})
    return wide.select("pair_id", "chosen", "rejected", F.col("k").cast("bigint").alias("n_prompt_turns"), "prompt", shown(F.col("rest_a")).alias("chosen_text"), shown(F.col("rest_b")).alias("rejected_text"), mask("rest_a").alias("chosen_mask"), mask("rest_b").alias("rejected_mask"))
