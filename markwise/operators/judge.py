"""Agent outcomes against a baseline model on the same questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_baseline(responses: DataFrame, ordinal: str, key: str = "question_no") -> DataFrame:
    """First baseline row of every question: one aggregation, no window."""
    return responses.groupBy(key).agg(
        F.min_by(F.struct("prediction", "truth"), ordinal).alias("_base")
    ).select(key, F.col("_base.prediction").alias("base_prediction"), F.col("_base.truth").alias("base_truth"))


def outcomes(agent: DataFrame, baseline: DataFrame, key: str = "question_no") -> DataFrame:
    """One row per agent question with its outcome flags.

    ``agent``: key, has_result, has_qinfo, ok, result, truth, abstain_label.
    A missing result is a failure and never looked up in the baseline; an
    executed result without question info is left out of every count but the
    baseline's.
    """
    joined = agent.join(baseline, key, "left")
    looked_up = F.col("has_result") & F.col("base_truth").isNotNull()
    base_wrong = looked_up & ~F.col("base_prediction").eqNullSafe(F.col("base_truth"))
    failed = ~F.col("has_result") | ~F.col("ok")
    judged = ~failed & F.col("has_qinfo")
    abstained = judged & F.col("result").eqNullSafe(F.col("abstain_label")) & F.col("abstain_label").isNotNull()
    right = judged & ~abstained & F.col("result").eqNullSafe(F.col("truth"))
    return joined.withColumns(
        {
            "is_failed": failed,
            "is_abstain": abstained,
            "is_correct": right,
            "is_incorrect": judged & ~abstained & ~right,
            "is_counted": failed | judged,
            "baseline_wrong": base_wrong,
            "baseline_seen": looked_up,
            "is_overlap": right & looked_up & ~base_wrong,
            "is_recovered": right & base_wrong,
        }
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def judge(judged: DataFrame) -> DataFrame:
    """The one-row report over :func:`outcomes`.

    Rates are over all questions, ``baseline_accuracy`` included: there, questions
    the agent never answered count as right. ``baseline_accuracy_answered`` is
    over the questions that were looked up.
    """
    n = F.count(F.lit(1))
    count = {
        "num_total": "is_counted",
        "num_correct": "is_correct",
        "num_incorrect": "is_incorrect",
        "num_abstain": "is_abstain",
        "num_failed_code": "is_failed",
        "num_overlap": "is_overlap",
        "error_count": "baseline_wrong",
        "error_recovery_count": "is_recovered",
    }
    wrong, seen = F.count_if("baseline_wrong"), F.count_if("baseline_seen")
    return judged.agg(
        *[F.count_if(flag).alias(name) for name, flag in count.items()],
        _rate(F.count_if("is_correct"), n).alias("accuracy"),
        _rate(F.count_if("is_abstain"), n).alias("abstain_rate"),
        _rate(F.count_if("is_failed"), n).alias("fail_rate"),
        _rate(n - wrong, n).alias("baseline_accuracy"),
        _rate(seen - wrong, seen).alias("baseline_accuracy_answered"),
        _rate(F.count_if("is_recovered"), wrong).alias("error_recovery_rate"),
    )


def judge_breakdown(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correct and overlapping answers counted by each key on its own.

    One pass: every row is expanded to one (dimension, value) pair per key.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys])
    return (
        judged.filter("is_correct")
        .select(F.explode(pairs).alias("_p"), "is_overlap")
        .groupBy("_p.dimension", "_p.value")
        .agg(F.count(F.lit(1)).alias("num_correct"), F.count_if("is_overlap").alias("num_overlap"))
    )
