"""Preference formatting: one prompt and two masked completions for a pair of conversations.

The turns that a chosen and a rejected conversation begin with in common are
rendered once, as the prompt; what follows in each is its completion. The mask of
a completion lists the spans, in code points of the completion, that a loss should
count: the texts of the assistant's turns and the marks that end them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.functions.arrays import once, running
from gazetta.llm.common import table

#: Marks around a turn: before the role, between role and text, after the text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Role whose texts are learned.
LEARNED = "assistant"
#: Bits in which the conversation that lends its answer differs.
SEED = 1


def _turns(chosen: bool) -> Column:
    """Turns of one side as an array in order; rows that repeat a turn number follow by role and text."""
    own = F.when(F.col("chosen") == chosen, F.struct("turn", "role", "text"))
    return F.transform(F.array_sort(F.collect_list(own)), lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(MIDDLE), x["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """start:end of the learned texts with their closing mark, comma-joined."""

    def spans(turns: Column) -> Column:
        ends = running(F.transform(turns, lambda x: F.length(x["role"]) + F.length(x["text"]) + len(OPEN) + len(MIDDLE) + len(CLOSE)))
        told = F.zip_with(turns, ends, lambda x, end: F.when(x["role"] == LEARNED, F.concat_ws(":", end - F.length(x["text"]) - len(CLOSE), end)))
        return F.array_join(F.filter(told, lambda x: x.isNotNull()), ",")

    return once(turns, spans)


def formatted(turns: DataFrame) -> DataFrame:
    """One row for each pair of turns (pair_id, chosen boolean, turn, role, text).

    pair_id, n_chosen, n_rejected, n_common (turns), prompt, chosen, rejected
    (texts) and chosen_mask, rejected_mask. Null roles and texts count as empty.
    Where one conversation begins the other, its completion is empty; without a
    common turn, and where a side is missing, the prompt is empty. Rows without a
    pair_id or side are left out; an empty table gives no rows; other columns are
    ignored. A conversation becomes one text, so its turns meet in one row.
    """
    return paired(turns.where("pair_id IS NOT NULL AND chosen IS NOT NULL").groupBy("pair_id").agg(_turns(True).alias("a"), _turns(False).alias("b")))


def paired(pairs: DataFrame) -> DataFrame:
    """What `formatted` tells of each row of pairs (pair_id, a, b: arrays of role and text)."""
    shorter = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", F.lit(1), shorter), F.slice("b", F.lit(1), shorter), lambda x, y: x == y)
    pairs = pairs.withColumn("n", F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, shorter.cast("long")).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    pairs = pairs.select("pair_id", "n", "a", F.size("a").cast("long").alias("n_chosen"), F.size("b").cast("long").alias("n_rejected"), rest("a").alias("x"), rest("b").alias("y"))
    return pairs.select("pair_id", "n_chosen", "n_rejected", F.col("n").cast("long").alias("n_common"), _rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"), _rendered(F.col("x")).alias("chosen"), _rendered(F.col("y")).alias("rejected"), _mask(F.col("x")).alias("chosen_mask"), _mask(F.col("y")).alias("rejected_mask"))


def corrupted(conversations: DataFrame, seed: int = SEED) -> DataFrame:
    """pair_id, a and b of each conversation (conv_id, turn, role, text): itself, and with another one's answer.

    The rejected side has the turns before the last learned one, and in its place
    the last learned text of the conversation whose conv_id differs in the bits of
    seed; without such a text it ends before. A conversation without a learned turn
    is both sides. Rows that repeat a turn number follow by role and text; rows
    without a conv_id are left out.
    """
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("pair_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    last = F.max(F.when((F.col("t.role") == LEARNED) & F.col("t.turn").isNotNull(), F.struct("t.turn", "t.text")))
    own = own.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias("turns"), last.alias("last"))
    others = own.where("last IS NOT NULL").select(F.col("pair_id").bitwiseXOR(seed).alias("pair_id"), F.col("last.text").alias("other"))
    own = own.join(others.hint("merge"), "pair_id", "left")
    plain = lambda turns: F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    answer = F.when(F.col("other").isNull(), F.expr("cast(array() as array<struct<role:string,text:string>>)")).otherwise(F.array(F.struct(F.lit(LEARNED).alias("role"), F.col("other").alias("text"))))
    before = plain(F.filter("turns", lambda x: x["turn"] < F.col("last.turn")))
    return own.select("pair_id", plain(F.col("turns")).alias("a"), F.when(F.col("last").isNull(), plain(F.col("turns"))).otherwise(F.concat(before, answer)).alias("b"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is preferred to itself with another one's last answer."""
    return paired(corrupted(table(spark, sf_dir, "conversations")))


ORACLE_SQL = {
    "op5_preference": r"""
WITH given AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
final AS (SELECT pair_id, max(turn) AS turn FROM given WHERE role = 'assistant' GROUP BY pair_id),
answer AS (SELECT pair_id, turn, max(text) AS text FROM given JOIN final USING (pair_id, turn) WHERE role = 'assistant' GROUP BY pair_id, turn),
sides AS (
  SELECT true AS is_chosen, pair_id, turn, role, text FROM given
  UNION ALL SELECT false, g.pair_id, g.turn, g.role, g.text FROM given g LEFT JOIN answer w ON w.pair_id = g.pair_id WHERE w.pair_id IS NULL OR g.turn < w.turn
  UNION ALL SELECT false, w.pair_id, w.turn, 'assistant', o.text FROM answer w JOIN answer o ON o.pair_id = xor(w.pair_id, 1)),
t AS (SELECT pair_id, is_chosen, role, text, row_number() OVER (PARTITION BY pair_id, is_chosen ORDER BY turn, role, text) AS k FROM sides),
c AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k,
         a.role IS NOT NULL AND b.role IS NOT NULL AND a.role = b.role AND a.text = b.text AS same,
         a.role AS a_role, a.text AS a_text, b.role AS b_role, b.text AS b_text
  FROM (SELECT * FROM t WHERE is_chosen) a FULL JOIN (SELECT * FROM t WHERE NOT is_chosen) b ON a.pair_id = b.pair_id AND a.k = b.k),
p AS (
  SELECT *, coalesce(min(CASE WHEN NOT same THEN k END) OVER (PARTITION BY pair_id), 1 + max(k) OVER (PARTITION BY pair_id)) AS stop,
         '<|im_start|>' || a_role || chr(10) || a_text || '<|im_end|>' || chr(10) AS a,
         '<|im_start|>' || b_role || chr(10) || b_text || '<|im_end|>' || chr(10) AS b
  FROM c),
m AS (
  SELECT *, sum(CASE WHEN k >= stop THEN length(a) ELSE 0 END) OVER w AS a_end, sum(CASE WHEN k >= stop THEN length(b) ELSE 0 END) OVER w AS b_end
  FROM p WINDOW w AS (PARTITION BY pair_id ORDER BY k))
SELECT pair_id, count(a) AS n_chosen, count(b) AS n_rejected, max(stop) - 1 AS n_common,
       coalesce(string_agg(CASE WHEN k < stop THEN a END, '' ORDER BY k), '') AS prompt,
       coalesce(string_agg(CASE WHEN k >= stop THEN a END, '' ORDER BY k), '') AS chosen,
       coalesce(string_agg(CASE WHEN k >= stop THEN b END, '' ORDER BY k), '') AS rejected,
       coalesce(string_agg(CASE WHEN k >= stop AND a_role = 'assistant' THEN (a_end - length(a_text) - 11)::BIGINT || ':' || a_end::BIGINT END, ',' ORDER BY k), '') AS chosen_mask,
       coalesce(string_agg(CASE WHEN k >= stop AND b_role = 'assistant' THEN (b_end - length(b_text) - 11)::BIGINT || ':' || b_end::BIGINT END, ',' ORDER BY k), '') AS rejected_mask
FROM m GROUP BY pair_id"""
}
QUERIES = {"op5_preference": op5_preference}
