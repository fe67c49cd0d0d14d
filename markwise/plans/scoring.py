"""Scoring queries over attempts.

An attempt is a line item: the order is the question, the priority its category
and the line number the option shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.functions import parse
from markwise.operators import score
from markwise.plans.catalog import Query, rounded, table

TRUTH = "CASE {k} % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END"


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """question_no, shuff_idx, prediction, truth; an open line has no prediction."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_no"),
        (F.col("l_linenumber") - 1).alias("shuff_idx"),
        F.expr("CASE WHEN l_quantity < 49 THEN l_returnflag END").alias("prediction"),
        F.expr(TRUTH.format(k="l_orderkey")).alias("truth"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_no"),
        F.col("o_orderpriority").alias("category"),
        F.expr(TRUTH.format(k="o_orderkey")).alias("truth"),
        (F.lit(2) + F.col("o_orderkey") % 4).alias("n_options"),
    )


def tallies(spark: SparkSession, sf: str, shuffles: int | None) -> DataFrame:
    """Attempts are reduced to one row per question before the join."""
    rows = score.filter_shuffles(attempts(spark, sf), shuffles)
    return score.tally(rows).join(questions(spark, sf), "question_no")


ATTEMPTS_SQL = f"""
attempts AS (
  SELECT l_orderkey AS question_no, l_linenumber - 1 AS shuff_idx,
         coalesce(CASE WHEN l_quantity < 49 THEN l_returnflag END, '') AS prediction,
         {TRUTH.format(k='l_orderkey')} AS truth
  FROM lineitem),
questions AS (
  SELECT o_orderkey AS question_no, o_orderpriority AS category,
         {TRUTH.format(k='o_orderkey')} AS truth, 2 + o_orderkey % 4 AS n_options
  FROM orders)"""

TALLIES_SQL = ATTEMPTS_SQL + """,
tallies AS (
  SELECT q.question_no, q.category, q.truth, q.n_options,
         count(*) FILTER (WHERE a.prediction = a.truth) AS correct,
         count(*) FILTER (WHERE a.prediction <> a.truth) AS incorrect
  FROM attempts a JOIN questions q USING (question_no)
  WHERE {where} GROUP BY ALL)"""

MODES_SQL = """
SELECT coalesce(category, 'micro_avg') AS category, count(*) AS n_questions,
       round(100.0 * avg((incorrect = 0)::INT), 6) AS strict,
       round(100.0 * avg((correct > incorrect)::INT), 6) AS majority,
       round(100.0 * avg((correct > 0)::INT), 6) AS any
FROM tallies GROUP BY GROUPING SETS ((category), ())"""


def score_modes(spark, sf):
    out = score.score(tallies(spark, sf, 3))
    return rounded(out.select("category", "n_questions", "strict", "majority", "any"))


def score_all_shuffles(spark, sf):
    out = score.score(tallies(spark, sf, None))
    return rounded(out.select("category", "n_questions", "strict", "majority", "any"))


def chance_levels(spark, sf):
    out = score.score(tallies(spark, sf, None))
    return rounded(out.select("category", "n_questions", "random_chance", "freq_chance"))


CHANCE_SQL = """
, labelled AS (
  SELECT category, truth, n_options FROM tallies
  UNION ALL SELECT 'micro_avg', truth, n_options FROM tallies),
freq AS (
  SELECT category, max(n) AS top FROM (
    SELECT category, truth, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY ALL)
SELECT l.category, count(*) AS n_questions,
       round(avg(100.0 / n_options), 6) AS random_chance,
       round(100.0 * max(f.top) / count(*), 6) AS freq_chance
FROM labelled l JOIN freq f ON f.category = l.category GROUP BY l.category"""


def binary_accuracy(spark, sf):
    """Documents with a quality label: is the text long? Yes / no."""
    rows = (
        table(spark, sf, "labels")
        .join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(
            F.col("doc_id").alias("question_no"),
            F.expr("CASE WHEN n_chars > 2000 THEN 'A' ELSE 'B' END").alias("prediction"),
            F.expr("CASE WHEN quality = 1 THEN 'A' ELSE 'B' END").alias("truth"),
            F.expr("CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END").alias("raw_truth"),
        )
    )
    rows = score.binary_category(rows).withColumn("n_options", F.lit(2))
    per_question = score.tally(
        rows, ["question_no"], first=["category", "truth", "n_options"], ordinal="question_no"
    )
    return rounded(
        score.score(per_question).select("category", "n_questions", "strict", "freq_chance")
    )


BINARY_SQL = """
WITH r AS (
  SELECT CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS category,
         (n_chars > 2000) = (quality = 1) AS ok
  FROM labels JOIN documents USING (doc_id))
SELECT coalesce(category, 'micro_avg') AS category, count(*) AS n_questions,
       round(100.0 * avg(ok::INT), 6) AS strict,
       round(CASE WHEN category IS NULL THEN
         100.0 * greatest(count(*) FILTER (WHERE category = 'yes'),
                          count(*) FILTER (WHERE category = 'no')) / count(*)
         ELSE 100.0 END, 6) AS freq_chance
FROM r GROUP BY GROUPING SETS ((category), ())"""


def scripted_responses(spark, sf) -> DataFrame:
    """Every turn of every conversation, dressed as one of five answer formats."""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.expr(RESPONSE).alias("response"),
    )


LETTER = "substr('ABCDE', CAST((conv_id + turn) % 5 AS INT) + 1, 1)"
RESPONSE = f"""CASE (conv_id + turn) % 6
  WHEN 0 THEN text
  WHEN 1 THEN concat('{{"answer": "', {LETTER}, '"}}')
  WHEN 2 THEN concat('  {{"explanation": "', substr(role, 1, 4), '", "answer": "', {LETTER}, '"}} ')
  WHEN 3 THEN concat('<think>A or B?</think> ', {LETTER}, '. because')
  WHEN 4 THEN concat('{LETTER[:0]}the part is ', {LETTER}, ' here')
  ELSE concat({LETTER}, '. Part 3') END"""
RESPONSES_SQL = f"WITH r AS (SELECT conv_id, turn, {RESPONSE} AS response FROM conversations)"
STRIP_SQL = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _parsed(key):
    def build(spark, sf):
        return scripted_responses(spark, sf).select(
            "conv_id", "turn", parse.parse_answer(F.col("response"), key).alias("label")
        )

    return build


def _letter_sql(source: str) -> str:
    json_part = (
        r"""'^(?:`*json\s*)*\{\s*(?:"explanation"\s*:\s*".*?"\s*,\s*)?"answer"\s*:\s*["'']*([A-Z])'"""
    )
    x = STRIP_SQL.format(x=source)
    return (
        f"coalesce(nullif(regexp_extract({x}, {json_part}, 1), ''), "
        rf"""regexp_extract({x}, '^["'']*([A-Z])["''.]*', 1))"""
    )


PARSE_STANDARD_SQL = f"{RESPONSES_SQL} SELECT conv_id, turn, {_letter_sql('response')} AS label FROM r"
PARSE_THINK_SQL = f"""{RESPONSES_SQL}, t AS (
  SELECT conv_id, turn, CASE WHEN strpos(response, '</think>') > 0
    THEN substr(response, strpos(response, '</think>') + 8) ELSE response END AS response FROM r)
SELECT conv_id, turn, {_letter_sql('response')} AS label FROM t"""
PARSE_CAPITAL_SQL = rf"""{RESPONSES_SQL}
SELECT conv_id, turn, coalesce(nullif(regexp_extract(response,
         '(?:^|[^\pL\pN_])([A-Z])(?:$|[^\pL\pN_])', 1), ''),
       {STRIP_SQL.format(x='response')}) AS label FROM r"""
PARSE_JSON_SQL = rf"""{RESPONSES_SQL}, b AS (
  SELECT *, nullif(regexp_extract(response, '(?s)\{{.*\}}', 0), '') AS block FROM r)
SELECT conv_id, turn, CASE WHEN json_valid(block)
       THEN trim(coalesce(json_extract_string(block, '$.answer'), ''))
       ELSE {STRIP_SQL.format(x='response')} END AS label FROM b"""
PARSE_DOT_SQL = rf"""{RESPONSES_SQL}
SELECT conv_id, turn, {STRIP_SQL.format(x="split_part(response, '.', 1)")} AS label FROM r"""
PARSE_END_SQL = rf"""{RESPONSES_SQL}
SELECT conv_id, turn, coalesce(
  nullif(regexp_extract({STRIP_SQL.format(x='response')},
    '^(?:`*json\s*)?\{{\s*"answer"\s*:\s*["'']*([A-Z])', 1), ''),
  regexp_extract({STRIP_SQL.format(x='response')}, '^["'']*([A-Z])["''.]*(?:\n|$)', 1)) AS label FROM r"""


def parse_first_capital(spark, sf):
    return scripted_responses(spark, sf).select(
        "conv_id", "turn", parse.first_capital(F.col("response")).alias("label")
    )


MODEL_KEY = """CASE conv_id % 4 WHEN 0 THEN 'qwen_2_5_vl_hf' WHEN 1 THEN 'qwen_3_vl_hf'
  WHEN 2 THEN 'perceptionlm' ELSE 'gemini' END"""


def score_mixed_models(spark, sf):
    """One pass over a table that mixes model families: parse, then count labels."""
    rows = scripted_responses(spark, sf).select(
        "conv_id", F.expr(MODEL_KEY).alias("model_key"), "response", F.expr(LETTER).alias("kept")
    )
    label = parse.scored_label(F.col("response"), F.col("kept"), F.col("model_key"))
    return rows.groupBy("model_key", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


MIXED_SQL = f"""{RESPONSES_SQL}, p AS (
  SELECT {MODEL_KEY} AS model_key, {LETTER} AS kept, response, conv_id,
    CASE WHEN strpos(response, '</think>') > 0
      THEN substr(response, strpos(response, '</think>') + 8) ELSE response END AS tail FROM r)
SELECT model_key, CASE model_key WHEN 'gemini' THEN kept
  WHEN 'perceptionlm' THEN {STRIP_SQL.format(x="split_part(response, '.', 1)")}
  WHEN 'qwen_3_vl_hf' THEN {_letter_sql('tail')} ELSE {_letter_sql('response')} END AS label,
  count(*) AS n FROM p GROUP BY ALL"""

QUERIES = {
    "score_modes": Query(
        score_modes, f"WITH {TALLIES_SQL.format(where='shuff_idx < 3')}{MODES_SQL}"
    ),
    "score_all_shuffles": Query(
        score_all_shuffles, f"WITH {TALLIES_SQL.format(where='true')}{MODES_SQL}"
    ),
    "chance_levels": Query(
        chance_levels, f"WITH {TALLIES_SQL.format(where='true')}{CHANCE_SQL}"
    ),
    "binary_accuracy": Query(binary_accuracy, BINARY_SQL),
    "parse_standard": Query(_parsed("qwen_2_5_vl_hf"), PARSE_STANDARD_SQL),
    "parse_think": Query(_parsed("qwen_3_vl_hf"), PARSE_THINK_SQL),
    "parse_end_anchored": Query(_parsed("video_llava"), PARSE_END_SQL),
    "parse_before_dot": Query(_parsed("perceptionlm"), PARSE_DOT_SQL),
    "parse_json_answer": Query(_parsed("genfs"), PARSE_JSON_SQL),
    "parse_first_capital": Query(parse_first_capital, PARSE_CAPITAL_SQL),
    "score_mixed_models": Query(score_mixed_models, MIXED_SQL),
}
