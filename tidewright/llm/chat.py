"""Preference formatting of conversations, with DataFrame operations only.

A pair is a chosen and a rejected conversation, each a list of turns. Their longest common prefix of turns (same role, same text)
is rendered once, as the prompt; what follows on each side is a completion. Spans of a completion, in code points, say
which of it is trained on: the texts of assistant turns with their closing marks. All else is masked.

Turns are rendered as <|role|>, a line feed, the text, <|end|> and a line feed. Marks inside a text stay as they are.

neighbours() makes pairs of a table that holds none. It drops turns after a conversation's last answer from both sides, conversations
without an answer, and turns whose conv_id is null, as they belong to no conversation. preferences() drops pairs whose sides are equal, as they prefer nothing.

Defined cases: null roles and texts count as empty; turns are ordered by number, equal numbers by role and text, and counted
anew; repeated rows are turns of their own; if one side is a prefix of the other, its completion is empty; a pair with one side
only has that side's turns as completion and an empty other one; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import or_empty, table


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def numbered(turns: DataFrame, by: list[str]) -> DataFrame:
    """role and text without nulls, and pos, the place of a turn among those of its conversation."""
    turns = turns.select(*by, "turn", or_empty("role").alias("role"), or_empty("text").alias("text"))
    order = Window.partitionBy(*by).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.withColumn("pos", F.row_number().over(order) - 1).drop("turn")


def preferences(sides: DataFrame) -> DataFrame:
    """sides: pair_id, side ("chosen" or "rejected"), pos, role, text. One row per pair: n_shared, prompt, chosen, rejected, chosen_spans and rejected_spans ("start:end", comma-joined)."""
    at = F.struct("pos", "role", "text")
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, at)))
    pairs = sides.groupBy("pair_id").agg(of("chosen").alias("c"), of("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    pairs = pairs.withColumn("n_shared", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int"))
    text = lambda turns: F.array_join(F.transform(turns, lambda x: render(x["role"], x["text"])), "")
    pairs = pairs.withColumn("prompt", text(F.slice("c", F.lit(1), F.col("n_shared"))))
    for side, short in (("chosen", "c"), ("rejected", "r")):
        rest = F.slice(short, F.col("n_shared") + 1, F.greatest(F.size(short) - F.col("n_shared"), F.lit(0)))
        pairs = pairs.withColumn(f"__{short}", rest).withColumns({side: text(F.col(f"__{short}")), f"{side}_spans": spans(F.col(f"__{short}"))})
    return pairs.where("size(c) != n_shared or size(r) != n_shared").select("pair_id", "n_shared", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")


def spans(turns: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["role"]) + 5
        end = begin + F.length(x["text"]) + 7
        own = F.when(x["role"] == "assistant", F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(a["out"], own).alias("out"))

    return F.array_join(F.aggregate(turns, start, step)["out"], ",")


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs from a table of conversations without preferences: the rejected side of each is its own turns up to and with the last answer,
    whose text is that of the last answer of the conversation whose number differs in the lowest bit (without one, none)."""
    turns = numbered(turns.where(F.col("conv_id").isNotNull()), ["conv_id"])
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("pos").alias("last"), F.max_by("text", "pos").alias("answer"))
    other = answers.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer").alias("other"))
    turns = turns.join(answers.drop("answer").join(other, "conv_id", "left"), "conv_id").where("pos <= last")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "pos", "role", "text")
    rejected = turns.where("pos < last or other is not null")
    rejected = rejected.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "pos", "role", F.when(F.col("pos") == F.col("last"), F.col("other")).otherwise(F.col("text")).alias("text"))
    return chosen.union(rejected)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(neighbours(table(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), answers AS (
  SELECT conv_id, max(pos) AS last, arg_max(text, pos) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id
), c AS (
  SELECT t.*, last FROM t JOIN answers USING (conv_id) WHERE pos <= last
), r AS (
  SELECT c.conv_id, role, pos, CASE WHEN pos = c.last THEN o.answer ELSE text END AS text
  FROM c LEFT JOIN answers o ON o.conv_id = xor(c.conv_id, 1) WHERE pos < c.last OR o.conv_id IS NOT NULL
), prefix AS (
  SELECT c.conv_id, coalesce(min(CASE WHEN r.pos IS NULL OR r.role <> c.role OR r.text <> c.text THEN c.pos END), count(*)) AS n_shared
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.pos = c.pos GROUP BY c.conv_id
), sides AS (
  SELECT 'c' AS side, conv_id, pos, role, text FROM c UNION ALL SELECT 'r', conv_id, pos, role, text FROM r
), shown AS (
  SELECT s.*, n_shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
         coalesce(sum(CASE WHEN pos >= n_shared THEN length(role) + length(text) + 13 ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sides s JOIN prefix USING (conv_id)
), joined AS (
  SELECT conv_id, n_shared, side,
         string_agg(CASE WHEN pos < n_shared THEN shown ELSE '' END, '' ORDER BY pos) AS prompt,
         string_agg(CASE WHEN pos >= n_shared THEN shown ELSE '' END, '' ORDER BY pos) AS completion,
         coalesce(string_agg(CASE WHEN pos >= n_shared AND role = 'assistant' THEN CAST(CAST(place + length(role) + 5 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(place + length(role) + length(text) + 12 AS BIGINT) AS VARCHAR) END, ',' ORDER BY pos), '') AS spans
  FROM shown GROUP BY conv_id, n_shared, side
)
SELECT a.conv_id AS pair_id, CAST(a.n_shared AS INTEGER) AS n_shared, a.prompt, a.completion AS chosen, coalesce(b.completion, '') AS rejected,
       a.spans AS chosen_spans, coalesce(b.spans, '') AS rejected_spans
FROM (SELECT * FROM joined WHERE side = 'c') a LEFT JOIN (SELECT * FROM joined WHERE side = 'r') b USING (conv_id)
WHERE a.completion <> '' OR coalesce(b.completion, '') <> ''
"""
