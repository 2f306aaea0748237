"""Preference pairs of conversations as one prompt and two completions with loss masks.

A pair has a chosen and a rejected conversation. The turns that both begin with, role and text alike, are
rendered once as the prompt; what follows in each is its completion. A completion's mask covers the
assistant's texts and end marks, nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn: ``start role line text end line``."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    trained_role: str = "assistant"

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.start), F.coalesce(role, F.lit("")), F.lit("\n"))

    def body(self, text: Column) -> Column:
        return F.concat(F.coalesce(text, F.lit("")), F.lit(f"{self.end}\n"))


def conversations_of(turns: DataFrame, by: list[str]) -> DataFrame:
    """One row per key with ``turns`` (turn, role, text) in order; equal numbers go by role, then text.

    A conversation becomes one row here, because its rendering is one value; it is as large as that.
    """
    turn = F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in (("turn", "long"), ("role", "string"), ("text", "string"))])
    return turns.groupBy(*by).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _same(a: Column, b: Column) -> Column:
    return a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])


def _rendered(turns: Column, template: ChatTemplate) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(template.head(x["role"]), template.body(x["text"]))), "")


def _mask(turns: Column, template: ChatTemplate) -> Column:
    """[start, end) character spans of a rendering that count for the loss."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(template.head(x["role"]))
        end = start + F.length(template.body(x["text"]))
        span = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(x["role"] == template.trained_role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(turns, zero, step)["spans"]


def preference_format(pairs: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Adds n_shared, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask to rows of pairs.

    ``chosen`` and ``rejected`` are arrays of (turn, role, text); null counts as empty. ``n_shared`` is the
    length of the longest common turn prefix (turn numbers aside; a null text equals only a null
    text). Equal conversations give two empty completions. The two arrays are dropped, other columns
    stay, those with the new names are replaced.
    """
    new = ["n_shared", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask"]
    kept = [c for c in pairs.columns if c not in (*new, "chosen", "rejected")]
    empty = F.array().cast(TURN)
    out = pairs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.col("chosen").cast(TURN), empty).alias("_c"),
        F.coalesce(F.col("rejected").cast(TURN), empty).alias("_r"),
    )
    shorter = F.least(F.size("_c"), F.size("_r"))
    differing = F.filter(
        F.transform(F.col("_c"), lambda x, i: F.when(_same(x, F.get("_r", i)) & (i < F.size("_r")), F.lit(None)).otherwise(i)),
        lambda i: i.isNotNull(),
    )
    out = out.withColumn("n_shared", F.least(shorter, F.coalesce(F.get(differing, F.lit(0)), shorter)))
    rest = {c: F.slice(F.col(c), F.col("n_shared") + 1, F.greatest(F.size(c) - F.col("n_shared"), F.lit(0))) for c in ("_c", "_r")}
    out = out.withColumns({"_prompt": F.slice("_c", F.lit(1), F.col("n_shared")), "_c": rest["_c"], "_r": rest["_r"]})
    return out.select(
        *kept,
        F.col("n_shared").cast("long").alias("n_shared"),
        _rendered(F.col("_prompt"), template).alias("prompt"),
        _rendered(F.col("_c"), template).alias("chosen_text"),
        _rendered(F.col("_r"), template).alias("rejected_text"),
        _mask(F.col("_c"), template).alias("chosen_mask"),
        _mask(F.col("_r"), template).alias("rejected_mask"),
    )


def stale_reply_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) for every conversation with at least one assistant turn.

    The table has no preferences, so the rejected side answers the last question with a stale reply: the
    conversation up to its last assistant turn, whose text is that of the assistant turn before it; if
    there is none, the text is empty. The chosen side is the conversation up to the same turn.
    """
    whole = conversations_of(turns, ["conv_id"]).withColumn(
        "_replies",
        F.filter(
            F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull()
        ),
    ).where(F.size("_replies") > 0)
    last = F.element_at("_replies", -1)
    whole = whole.withColumn("_last", last).withColumn(
        "_stale",
        F.when(F.size("_replies") > 1, F.get("turns", F.get("_replies", F.size("_replies") - 2))["text"]).otherwise(F.lit("")),
    )
    chosen = F.slice("turns", F.lit(1), F.col("_last") + 1)
    rejected = F.concat(
        F.slice("turns", F.lit(1), F.col("_last")),
        F.array(
            F.struct(
                F.get("turns", F.col("_last"))["turn"].alias("turn"),
                F.lit("assistant").alias("role"),
                F.col("_stale").alias("text"),
            )
        ),
    )
    return whole.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = preference_format(stale_reply_pairs(turns))

    def digest(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias(spans)

    return out.select(
        "conv_id", "n_shared", "prompt", "chosen_text", "rejected_text", digest("chosen_mask"), digest("rejected_mask")
    )


OP8_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, text FROM conversations
), replies AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM t WHERE role = 'assistant'
), ends AS (
  SELECT a.conv_id, a.i AS last, coalesce(a.text, '') AS good,
         CASE WHEN b.conv_id IS NULL THEN '' ELSE b.text END AS stale_raw, a.text AS good_raw
  FROM replies a LEFT JOIN replies b ON b.conv_id = a.conv_id AND b.back = 2 WHERE a.back = 1
), shared AS (
  SELECT *, good_raw IS NOT DISTINCT FROM stale_raw AS same, coalesce(stale_raw, '') AS stale FROM ends
), heads AS (
  SELECT s.conv_id, coalesce(string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.i), '') AS prompt
  FROM shared s LEFT JOIN t ON t.conv_id = s.conv_id AND t.i < s.last + CAST(s.same AS INTEGER) GROUP BY s.conv_id
)
SELECT conv_id, CAST(last + CAST(same AS INTEGER) AS BIGINT) AS n_shared, prompt,
       CASE WHEN same THEN '' ELSE '<|im_start|>assistant' || chr(10) || good || '<|im_end|>' || chr(10) END AS chosen_text,
       CASE WHEN same THEN '' ELSE '<|im_start|>assistant' || chr(10) || stale || '<|im_end|>' || chr(10) END AS rejected_text,
       CASE WHEN same THEN '' ELSE '22-' || CAST(22 + length(good) + 10 AS VARCHAR) END AS chosen_mask,
       CASE WHEN same THEN '' ELSE '22-' || CAST(22 + length(stale) + 10 AS VARCHAR) END AS rejected_mask
FROM shared JOIN heads USING (conv_id)
"""

QUERIES = {"op8_preference_format": (op8_preference_format, OP8_SQL)}
