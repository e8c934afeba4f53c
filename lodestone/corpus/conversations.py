"""X8: conversations put together from their turns, with checks of their structure.

Turns of a conversation are ordered by their number. Of rows with the same number the one with the least role and text (nulls first) is
taken, and the others are counted as repeated. A conversation is put together in parts of PART numbers, so that one of any length spreads over
many tasks, and what happens at the border of two parts is found from their ends alone. A turn is out of order if its role may
not follow the one before: system or user may start, user follows system and assistant, assistant follows user.

Rows without a conversation belong to none and are left out. Rows without a turn number can't be placed: they are counted in n_unplaced of
the summary. A null role is out of order and shown as "?"; a null text is shown empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, table

#: Turn numbers of a part.
PART = 1_000
_FOLLOWS = "(({0} IS NULL AND {1} IN ('system', 'user')) OR ({0} IN ('system', 'assistant') AND {1} = 'user') OR ({0} = 'user' AND {1} = 'assistant'))"


def parts(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, first_turn, last_turn, n_turns, n_repeated, n_missing (numbers that no turn has, since the turn before the
    part), n_role_breaks and transcript (a line "role: text" for each turn). turns has conv_id, turn, role and text."""
    known = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    single = known.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("said"), F.count(F.lit(1)).alias("n"))
    single = single.select("conv_id", F.expr(f"(turn - pmod(turn, {part})) div {part}").alias("part"), F.struct("turn", F.coalesce("said.role", F.lit("?")).alias("role"), F.coalesce("said.text", F.lit("")).alias("text")).alias("x"), "n")
    held = single.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.sum("n").alias("n"))
    held = held.select("conv_id", "part", "xs", "n", F.size("xs").alias("size"), F.expr("xs[0].turn").alias("first_turn"), F.expr("xs[size(xs) - 1].turn").alias("last_turn"), F.expr("xs[size(xs) - 1].role").alias("last_role"))
    before = Window.partitionBy("conv_id").orderBy("part")
    held = held.withColumns({"from_turn": F.lag("last_turn").over(before), "from_role": F.lag("last_role").over(before)})
    broken = f"size(filter(xs, (x, i) -> NOT coalesce({_FOLLOWS.format('IF(i = 0, from_role, xs[i - 1].role)', 'x.role')}, false)))"
    return held.select(
        "conv_id", "part", "first_turn", "last_turn",
        F.col("size").cast("bigint").alias("n_turns"),
        (F.col("n") - F.col("size")).alias("n_repeated"),
        F.expr("last_turn - coalesce(from_turn, first_turn - 1) - size").alias("n_missing"),
        F.expr(broken).cast("bigint").alias("n_role_breaks"),
        F.expr("array_join(transform(xs, x -> concat(x.role, ': ', x.text)), '\n')").alias("transcript"),
    )


def summary(turns: DataFrame, part: int = PART) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, n_repeated, n_missing, n_role_breaks, n_unplaced, and sound (none of these faults,
    and it starts with turn 0)."""
    sums = parts(turns, part).groupBy("conv_id").agg(F.min("first_turn").alias("first_turn"), *(F.sum(c).alias(c) for c in ("n_turns", "n_repeated", "n_missing", "n_role_breaks")))
    lost = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count_if(F.col("turn").isNull()).alias("n_unplaced"))
    both = lost.join(sums, "conv_id", "left").fillna(0, ["n_turns", "n_repeated", "n_missing", "n_role_breaks"])
    sound = "n_repeated = 0 AND n_missing = 0 AND n_role_breaks = 0 AND n_unplaced = 0 AND first_turn = 0"
    return both.select("conv_id", "n_turns", "n_repeated", "n_missing", "n_role_breaks", "n_unplaced", F.coalesce(F.expr(sound), F.lit(False)).alias("sound"))


_SINGLE = """
WITH single AS (
  SELECT conv_id, turn, count(*) AS n, arg_min(struct_pack(r := coalesce(role, '?'), x := coalesce(text, '')), struct_pack(r := role IS NOT NULL, a := coalesce(role, ''), t := text IS NOT NULL, b := coalesce(text, ''))) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
placed AS (
  SELECT *, said.r AS role, lag(said.r) OVER w AS from_role, lag(turn) OVER w AS from_turn FROM single WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
judged AS (SELECT *, coalesce((from_role IS NULL AND role IN ('system', 'user')) OR (from_role IN ('system', 'assistant') AND role = 'user') OR (from_role = 'user' AND role = 'assistant'), false) AS follows FROM placed)
"""
_COUNTS = "count(*) AS n_turns, sum(n - 1)::BIGINT AS n_repeated, sum(turn - coalesce(from_turn, turn - 1) - 1)::BIGINT AS n_missing, count(*) FILTER (WHERE NOT follows) AS n_role_breaks"


@query(
    "x8_conversations",
    _SINGLE + f"SELECT conv_id, turn // {PART} AS part, min(turn) AS first_turn, max(turn) AS last_turn, {_COUNTS}, string_agg(role || ': ' || said.x, chr(10) ORDER BY turn) AS transcript FROM judged GROUP BY 1, 2",
)
def conversations(spark, sf_dir):
    return parts(table(spark, sf_dir, "conversations"))


@query(
    "x8_conversation_summary",
    _SINGLE
    + f"""
, sums AS (SELECT conv_id, min(turn) AS first_turn, {_COUNTS} FROM judged GROUP BY 1),
lost AS (SELECT conv_id, count(*) FILTER (WHERE turn IS NULL) AS n_unplaced FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1)
SELECT conv_id, coalesce(n_turns, 0) AS n_turns, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_missing, 0) AS n_missing, coalesce(n_role_breaks, 0) AS n_role_breaks, n_unplaced,
  coalesce(n_repeated = 0 AND n_missing = 0 AND n_role_breaks = 0 AND n_unplaced = 0 AND first_turn = 0, false) AS sound
FROM lost LEFT JOIN sums USING (conv_id)""",
)
def conversation_summary(spark, sf_dir):
    return summary(table(spark, sf_dir, "conversations"))
