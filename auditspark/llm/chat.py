"""Chat formatting after cumulative-snapshot collapse.

A logged conversation is often a snapshot of one that went on. Turns are gathered by conversation, in one shuffle of their
texts; each turn's prefix has a rolling 128-bit hash, the running exclusive-or of hashes of (position, role, text). Only
hashes go on: a conversation whose whole hash is that of a proper prefix of another is dropped by an anti-join, equal ones
keep the smallest id, and what is left is rendered where it was gathered.

Nulls and odd input: turns are ordered by turn (null first), role, text; repeated rows (all four values equal) count once;
turns of one number and role but different texts are different turns; a null role or text differs from an empty one when
compared and is rendered as empty; rows with a null conv_id form one conversation of that id, which is the last of equal
ones; very long texts are hashed and rendered whole, one conversation being one row; an empty table gives an empty result;
more columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def _gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the different turns of each conversation in order."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, n_turns, n_copies) of the conversations that no longer one continues."""
    whole_rows = _gathered(turns)
    state = lambda x: [x["role"].isNull(), F.coalesce(x["role"], F.lit("")), x["text"].isNull(), F.coalesce(x["text"], F.lit(""))]
    hashes = F.transform("turns", lambda x, i: F.struct(F.xxhash64(i, *state(x)).alias("a"), F.xxhash64(F.lit("second"), i, *state(x)).alias("b")))
    each = whole_rows.select("conv_id", F.size("turns").alias("n_turns"), F.posexplode(hashes).alias("i", "h")).select("conv_id", "n_turns", (F.col("i") + 1).alias("pos"), "h.a", "h.b")
    run = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = each.select("conv_id", "n_turns", "pos", F.bit_xor("a").over(run).alias("h1"), F.bit_xor("b").over(run).alias("h2"))
    prefixes = cut(prefixes, "chat-prefixes")
    whole = prefixes.filter("pos = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("z"), "conv_id")).alias("first"), F.count("*").alias("n_copies"))
    longer = prefixes.filter("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    kept = whole.join(longer, ["n_turns", "h1", "h2"], "left_anti").select(F.col("first.conv_id").alias("kept_id"), "n_turns", "n_copies")
    return whole_rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).drop("kept_id")


def format_chats(turns: DataFrame, open_role: str = "<|", close_role: str = "|>\n", end_turn: str = "<|end|>\n") -> DataFrame:
    """conv_id, n_turns, n_copies (equal logged conversations), rendered (the conversation as one text)."""
    line = lambda x: F.concat(F.lit(open_role), F.coalesce(x["role"], F.lit("")), F.lit(close_role), F.coalesce(x["text"], F.lit("")), F.lit(end_turn))
    return maximal_conversations(turns).select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", line), "").alias("rendered"))
