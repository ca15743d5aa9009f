"""Preference data from conversations, in DataFrame functions only.

Chosen and rejected conversations are compared turn by turn. The longest common prefix of turns is rendered once, as the
prompt; the rest of each side is a completion, of which only what the assistant says is trained on. Everything stays at
one row per turn, so a long conversation is never gathered into one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turn(role: Column, text: Column) -> Column:
    """A turn; a null role is `user`, a null text empty."""
    return F.struct(F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def paired_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both sides of every turn (pair_id, turn, chosen, rejected) of two tables (pair_id, turn, role, text), in one
    grouping. Repeated rows count once, of several different ones the least stays. Rows without a pair or turn belong to
    no conversation."""
    def side(rows: DataFrame, good: bool) -> DataFrame:
        turn = _turn(F.col("role"), F.col("text"))
        return rows.where("pair_id is not null and turn is not null").select(
            "pair_id", "turn", *[(turn if kept else F.lit(None).cast("struct<role:string,text:string>")).alias(name)
                                 for name, kept in (("chosen", good), ("rejected", not good))])

    return (side(chosen, True).unionByName(side(rejected, False)).groupBy("pair_id", "turn")
            .agg(F.min("chosen").alias("chosen"), F.min("rejected").alias("rejected")))


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of preference pairs from two tables (pair_id, turn, role, text); see `rendered_turns`."""
    return rendered_turns(paired_turns(chosen, rejected))


def rendered_turns(paired: DataFrame) -> DataFrame:
    """Rendered turns of preference pairs from both sides of their turns, as `paired_turns` gives them.

    Columns: pair_id, part (prompt, chosen, rejected), turn, role, rendered, train_from and train_to: the characters of
    `rendered` that are trained on, none if equal. Turns are compared by their number; the common prefix ends before
    the first number at which one side differs or has no turn. Pairs whose sides are equal teach nothing and give no
    rows, as do pairs that only one table has. Very long texts are rendered whole.
    """
    same = F.col("chosen").eqNullSafe(F.col("rejected"))
    both = paired.select("pair_id", "turn", "chosen", same.alias("_same"),
                         F.when(~same, F.col("rejected")).alias("rejected"))  # an equal text travels once
    cut = (both.groupBy("pair_id").agg(
        F.min(F.when(~F.col("_same"), F.col("turn"))).alias("cut"), F.count("chosen").alias("_good"),
        F.count_if(F.col("_same") | F.col("rejected").isNotNull()).alias("_bad"))
        .where("cut is not null and _good > 0 and _bad > 0").select("pair_id", "cut"))

    def part(name: str, turn: Column) -> Column:
        return F.struct(F.lit(name).alias("part"), turn.alias("said"))

    other = F.when(F.col("_same"), F.col("chosen")).otherwise(F.col("rejected"))
    parts = (F.when(F.col("turn") < F.col("cut"), F.array(part("prompt", F.col("chosen"))))
             .otherwise(F.array(part("chosen", F.col("chosen")), part("rejected", other))))
    rows = both.join(cut, "pair_id").select("pair_id", "turn", F.explode(parts).alias("_part")).select(
        "pair_id", "_part.part", "turn", "_part.said").where("said is not null")
    head = F.concat(F.lit("<|"), F.col("said.role"), F.lit("|>\n"))
    trained = (F.col("part") != "prompt") & (F.col("said.role") == "assistant")
    return rows.select(
        "pair_id", "part", "turn", F.col("said.role").alias("role"),
        F.concat(head, F.col("said.text"), F.lit("\n")).alias("rendered"),
        F.when(trained, F.length(head)).otherwise(0).alias("train_from"),
        F.when(trained, F.length(head) + F.length("said.text")).otherwise(0).alias("train_to"))


def examples(turns: DataFrame) -> DataFrame:
    """One row (pair_id, prompt, chosen, rejected) per pair with whole strings, for consumers whose examples fit a row."""
    def text(part: str) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "rendered"))))
        return F.array_join(F.transform(held, lambda t: t["rendered"]), "").alias(part)

    return turns.groupBy("pair_id").agg(text("prompt"), text("chosen"), text("rejected"))


def _swaps(rows: DataFrame) -> DataFrame:
    """(pair_id, at, other): the last assistant turn of each conversation and the reply of the one with the next id."""
    last = (rows.where("role = 'assistant'").groupBy("pair_id")
            .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("reply")))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("reply.text").alias("other"))
    return last.select("pair_id", F.col("reply.turn").alias("at")).join(other, "pair_id", "left")


def _conversations(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").alias("pair_id"), "turn", "role", "text")


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations: chosen is a conversation as it is; rejected has the text of its last
    assistant turn replaced by that of the conversation with the next id, or no such turn if there is none."""
    rows = _conversations(conversations)
    rejected = rows.join(_swaps(rows), "pair_id", "left")
    replaced = (F.col("turn") == F.col("at")) & (F.col("role") == "assistant")
    rejected = rejected.where(~F.coalesce(replaced & F.col("other").isNull(), F.lit(False))).select(
        "pair_id", "turn", "role", F.when(replaced, F.col("other")).otherwise(F.col("text")).alias("text"))
    return rows, rejected


def paired_replies(conversations: DataFrame) -> DataFrame:
    """`paired_turns` of `swapped_replies` in one grouping: the swapped reply meets its turn there, so the conversations
    are neither joined nor sent twice."""
    rows = _conversations(conversations)
    said = _turn(F.col("role"), F.col("text"))
    kept = F.when(F.coalesce(F.col("role") != "assistant", F.lit(True)), said)
    turns = rows.select("pair_id", "turn", said.alias("chosen"), kept.alias("kept"), F.lit(None).cast("string").alias("other"),
                        F.lit(False).alias("at"))
    nothing = F.lit(None).cast("struct<role:string,text:string>")
    swaps = _swaps(rows).select("pair_id", F.col("at").alias("turn"), nothing.alias("chosen"), nothing.alias("kept"), "other",
                                F.lit(True).alias("at"))
    found = turns.unionByName(swaps).groupBy("pair_id", "turn").agg(
        F.min("chosen").alias("chosen"), F.min("kept").alias("kept"), F.max("other").alias("other"), F.max("at").alias("at"))
    swapped = F.when(F.col("other").isNotNull(), _turn(F.lit("assistant"), F.col("other")))
    return found.select("pair_id", "turn", "chosen", F.when(F.col("at"), F.least("kept", swapped)).otherwise(
        F.col("chosen")).alias("rejected"))


ORACLE = """
WITH c AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT pair_id, max(turn) AS final_turn FROM c WHERE role = 'assistant' GROUP BY 1),
reply AS (SELECT pair_id, max(coalesce(text, '')) AS said FROM c JOIN last USING (pair_id) WHERE turn = final_turn AND role = 'assistant'
          GROUP BY 1),
r AS (SELECT c.pair_id, turn, role, CASE WHEN turn = final_turn AND role = 'assistant' THEN said ELSE text END AS text
      FROM c LEFT JOIN last USING (pair_id) LEFT JOIN reply n ON n.pair_id = c.pair_id + 1
      WHERE NOT coalesce(turn = final_turn AND role = 'assistant' AND said IS NULL, false)),
a AS (SELECT pair_id, turn, min({'role': coalesce(role, 'user'), 'text': coalesce(text, '')}) AS t FROM c GROUP BY 1, 2),
b AS (SELECT pair_id, turn, min({'role': coalesce(role, 'user'), 'text': coalesce(text, '')}) AS t FROM r GROUP BY 1, 2),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.turn, b.turn) AS turn, a.t AS good, b.t AS bad
      FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.turn = b.turn),
cuts AS (SELECT pair_id, min(CASE WHEN good IS DISTINCT FROM bad THEN turn END) AS cut FROM j GROUP BY 1
         HAVING cut IS NOT NULL AND count(good) > 0 AND count(bad) > 0),
parts AS (SELECT pair_id, 'prompt' AS part, turn, good AS t FROM j JOIN cuts USING (pair_id) WHERE turn < cut
          UNION ALL SELECT pair_id, 'chosen', turn, good FROM j JOIN cuts USING (pair_id) WHERE turn >= cut AND good IS NOT NULL
          UNION ALL SELECT pair_id, 'rejected', turn, bad FROM j JOIN cuts USING (pair_id) WHERE turn >= cut AND bad IS NOT NULL)
SELECT pair_id, part, turn, t.role AS role, '<|' || t.role || '|>' || chr(10) || t.text || chr(10) AS rendered,
       CAST(CASE WHEN part <> 'prompt' AND t.role = 'assistant' THEN length(t.role) + 5 ELSE 0 END AS int) AS train_from,
       CAST(CASE WHEN part <> 'prompt' AND t.role = 'assistant' THEN length(t.role) + 5 + length(t.text) ELSE 0 END AS int)
           AS train_to
FROM parts"""
