"""Line-first cleaning: rules drop single lines, then documents that lost too much text go.

Everything is a DataFrame expression; a document is judged within its own row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Words that part the entries of a menu.
SEPARATORS = ("|", "»", "›", "·", "•", ">", "/")

#: Phrases of notices and menus; a line of up to ``boilerplate_words`` words that has one fails.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use of cookies",
    "uses cookies",
    "accept cookies",
    "enable javascript",
    "is licensed under",
    "released under the",
    "copyright (c)",
    "lorem ipsum",
    "click here",
    "read more",
    "sign up",
    "log in",
    "subscribe to",
    "share this",
    "back to top",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds. Shares are of a line's words unless said otherwise."""

    symbol_share: float = 0.3  # characters of SYMBOLS per word, above which a line is clutter
    mark_share: float = 0.3  # "!" and "?" per word, above which a line shouts
    capital_share: float = 0.7  # capitals among a line's letters
    capital_words: int = 4
    distinct_share: float = 0.34  # distinct words, below which a line repeats itself
    distinct_words: int = 10
    separators: int = 2  # menu separators standing alone between entries
    open_end_words: int = 3  # shorter lines must end like a sentence
    boilerplate_words: int = 30
    least_kept: float = 0.5  # share of a document's characters that must survive


def _count(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words_of(text: Column) -> Column:
    """The words of a text; an empty array if it has none."""
    bare = _trimmed(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def judged_lines(lines: Column, rules: LineRules) -> Column:
    """For each line its text, the length without outer white space, and whether it meets the
    punctuation, navigation and boilerplate rules; lines without words do. Each step is kept in a
    struct, so no measure is taken twice."""
    bare = F.transform(lines, lambda x: F.struct(x.alias("line"), _trimmed(x).alias("bare")))
    split = F.transform(bare, lambda x: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), F.split(x["bare"], GAP).alias("words")))
    sized = F.transform(
        split,
        lambda x: F.struct(
            x["line"].alias("line"),
            x["bare"].alias("bare"),
            x["words"].alias("words"),
            F.size(x["words"]).alias("n"),
            F.length(F.regexp_replace(x["bare"], r"\P{Lu}+", "")).alias("capitals"),
        ),
    )
    return F.transform(
        sized,
        lambda x: F.struct(x["line"].alias("line"), F.length(x["bare"]).alias("chars"), _passes(x, rules).alias("passes")),
    )


def _passes(x: Column, rules: LineRules) -> Column:
    bare, words, n = x["bare"], x["words"], x["n"]
    letters = F.length(F.regexp_replace(bare, r"\P{L}+", ""))
    punctuation = (
        (_count(bare, SYMBOLS) <= rules.symbol_share * n)
        & (_count(bare, "!?") <= F.greatest(F.lit(2), rules.mark_share * n))
        & ((n < rules.capital_words) | (x["capitals"] == 0) | (x["capitals"] <= rules.capital_share * letters))
        & ((n >= rules.open_end_words) | bare.rlike(r"[.!?:;…。\"'”’»)\]]$"))
    )
    others = words
    for separator in SEPARATORS:
        others = F.array_remove(others, separator)
    menu = bare.rlike(f"[{''.join(SEPARATORS)}]") & (n - F.size(others) >= rules.separators)
    navigation = ~menu & ((n < rules.distinct_words) | (F.size(F.array_distinct(words)) >= rules.distinct_share * n))
    phrase = bare.rlike("(?i)" + "|".join(re.escape(text) for text in BOILERPLATE))
    boilerplate = ~((n <= rules.boilerplate_words) & phrase)
    return (bare == "") | (punctuation & navigation & boilerplate)


def _repeated_words(docs: DataFrame, words: str) -> DataFrame:
    """Adds ``n_repeat_words``: words inside three-word windows that occur at least twice in the text.

    Windows are compared by 64-bit hashes; among a text's 20,000 windows two different ones agree with
    a probability of 1e-11.
    """
    n = F.size(words)
    docs = docs.withColumn(
        "_windows",
        F.when(
            n > 3,
            F.slice(
                F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), n - 2
            ),
        ),
    )
    # Only texts with an equal pair of windows are sorted.
    docs = docs.withColumn(
        "_sorted",
        F.when(
            F.size("_windows") > F.size(F.array_distinct("_windows")),
            F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("w"), i.alias("i")))),
        ),
    )

    def twice(x: Column, i: Column) -> Column:
        same = [F.coalesce(F.get("_sorted", j)["w"] == x["w"], F.lit(False)) for j in (i - 1, i + 1)]
        return same[0] | same[1]

    docs = docs.withColumn("_places", F.transform(F.filter("_sorted", twice), lambda x: x["i"]))
    covered = F.array_distinct(
        F.concat("_places", F.transform("_places", lambda i: i + 1), F.transform("_places", lambda i: i + 2))
    )
    out = docs.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_places").isNotNull(), F.size(covered)), F.lit(0)).cast("long"))
    return out.drop("_windows", "_sorted", "_places")


def judged(docs: DataFrame, text_column: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows with measures, ``cleaned`` text and verdicts.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long),
    ``base_failed``, ``cleaned`` (the text without the lines that fail; null stays null),
    ``n_lines_removed``, ``kept_share`` (characters of the passing lines among those of all lines, line
    ends and outer white space aside) and ``kept``. Columns of these names are replaced, all others
    stay. A null or empty text has no words, so it fails. A line that occurs again in the text counts
    towards the loss each time it fails.
    """
    added = [
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "cleaned",
        "n_lines_removed",
        "kept_share",
        "kept",
    ]
    names = [c for c in docs.columns if c not in added or c == text_column]
    text = F.col("_row")[text_column].cast("string")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")).select(
        "_row",
        words_of(text).alias("_words"),
        F.split(text, "\n", -1).alias("_lines"),
        F.coalesce(F.length(F.regexp_replace(text, GAP, "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(_count(text, SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
    )
    out = _repeated_words(out, "_words").withColumn("n_words", F.size("_words").cast("long")).drop("_words")
    out = out.withColumn("_judged", judged_lines(F.col("_lines"), rules))
    out = out.withColumn(
        "_filled", F.transform(F.filter("_judged", lambda x: x["chars"] > 0), lambda x: x["line"])
    ).withColumn("_good", F.filter("_judged", lambda x: x["passes"]))

    def chars(column: str) -> Column:
        return F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + x["chars"]), F.lit(0).cast("long"))

    out = (
        out.withColumn("n_dup_lines", F.coalesce(F.size("_filled") - F.size(F.array_distinct("_filled")), F.lit(0)).cast("long"))
        .withColumn("_all", chars("_judged"))
        .withColumn("_passing", chars("_good"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept_share", F.when(F.col("_all") > 0, F.col("_passing") / F.col("_all")).otherwise(F.lit(0.0)))
    )
    return out.select(
        *[F.col("_row")[c].alias(c) for c in names if c not in added],
        *[
            {
                "cleaned": F.array_join(F.transform("_good", lambda x: x["line"]), "\n").alias("cleaned"),
                "n_lines_removed": F.coalesce(F.size("_lines") - F.size("_good"), F.lit(0)).cast("long").alias("n_lines_removed"),
                "kept": (~F.col("base_failed") & (F.col("kept_share") >= rules.least_kept)).alias("kept"),
            }.get(c, F.col(c))
            for c in added
        ],
    )


def keep_good(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with their cleaned texts; ``n_chars`` follows the text."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), "text")
    out = judged(whole, rules=rules)
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    row = F.struct(*[new.get(c, F.col("_whole")[c]).alias(c) for c in docs.columns])
    # As a filter this would be moved below the projections and work out all measures again for each use.
    return out.select(F.inline(F.when(F.col("kept"), F.array(row))))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines_removed",
        F.round("kept_share", 6).alias("kept_share"),
    )


_PHRASES = " OR ".join(f"contains(lower(bare), '{x}')" for x in BOILERPLATE)
_SEPARATORS = ", ".join(f"'{x}'" for x in SEPARATORS)

OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
              - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines
  FROM d
), windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
), measured AS (
  SELECT doc_id, bare, string_split_regex(bare, '[\\x20\\x09-\\x0D]+') AS lw,
         len(string_split_regex(bare, '[\\x20\\x09-\\x0D]+')) AS n,
         length(regexp_replace(bare, '\\P{{L}}+', '', 'g')) AS letters,
         length(regexp_replace(bare, '\\P{{Lu}}+', '', 'g')) AS capitals
  FROM lines
), verdicts AS (
  SELECT doc_id, length(bare) AS chars, bare = '' OR (
         len(regexp_extract_all(bare, '[#*$%&|<>]')) <= 0.3 * n
         AND len(regexp_extract_all(bare, '[!?]')) <= greatest(2, 0.3 * n)
         AND (n < 4 OR capitals <= 0.7 * letters)
         AND (n >= 3 OR regexp_matches(bare, '[.!?:;…。"''”’»)\\]]$'))
         AND len(list_filter(lw, lambda x: x IN ({_SEPARATORS}))) < 2
         AND (n < 10 OR len(list_distinct(lw)) >= 0.34 * n)
         AND NOT (n <= 30 AND ({_PHRASES}))) AS passes
  FROM measured
), loss AS (
  SELECT doc_id, count(*) FILTER (NOT passes) AS gone, sum(chars) AS total, coalesce(sum(chars) FILTER (passes), 0) AS left_over
  FROM verdicts GROUP BY doc_id
), all_of AS (
  SELECT b.*, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_lines_removed,
         CASE WHEN coalesce(total, 0) > 0 THEN CAST(left_over AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS share
  FROM base b LEFT JOIN repeats USING (doc_id) LEFT JOIN loss USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND share >= 0.5 AS kept,
       n_lines_removed, round(share, 6) AS kept_share
FROM all_of
"""

QUERIES = {"op5_quality_rules": (op5_quality_rules, OP5_SQL)}
