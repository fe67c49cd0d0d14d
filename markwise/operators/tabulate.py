"""Many runs in one table: strict scores, labels of the setting, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.operators.bootstrap import bootstrap_trials, confidence_interval
from markwise.operators.score import MICRO, is_correct, score, tally

# Columns of the report and the patterns of the setting labels.
RESULT_COLUMNS = ("micro_avg", "temporal_ord", "temporal_loc", "tracking", "mating")
PROMPT_TYPE = r"^(sep|concat|collage|videorefer)"
VIDEO_TYPE = r"(keyframe|trimmed|videorefer)"


def setting_label(setting: Column, pattern: str, default: str = "unknown") -> Column:
    """First match of the pattern in the setting name, else the default."""
    found = F.regexp_extract(setting, pattern, 0)
    return F.when(found != "", found).otherwise(F.lit(default))


def tabulate(
    responses: DataFrame,
    runs: DataFrame,
    categories: Sequence[str] = RESULT_COLUMNS[1:],
    iters: int = 100_000,
    n_sample: int = 50,
    seed: int = 42,
    ci_respects_shuffle: bool = False,
) -> DataFrame:
    """One row per ``model_setting`` key, sorted; of runs with equal keys the last counts.

    ``responses``: run_id, question_no, shuff_idx, category, video_id,
    prediction, truth, n_options. Scores use each run's first ``num_shuffles``
    shuffles; the interval uses all rows unless told otherwise.
    """
    first = responses.join(runs.select("run_id", "num_shuffles"), "run_id")
    counted = first.filter(F.col("shuff_idx") < F.col("num_shuffles"))
    per_question = tally(
        counted, ["run_id", "question_no"], first=["category", "truth", "n_options"], ordinal="shuff_idx"
    )
    strict = (
        score(per_question, by=["run_id"])
        .groupBy("run_id")
        .pivot("category", [MICRO, *categories])
        .agg(F.first("strict"))
    )
    outcome = (counted if ci_respects_shuffle else responses).withColumn(
        "ci", is_correct(F.col("prediction"), F.col("truth")).cast("int")
    )
    interval = confidence_interval(
        bootstrap_trials(outcome, "video_id", ["ci"], n_sample=n_sample, iters=iters, seed=seed), ["ci"]
    )
    rows = runs.join(strict, "run_id").join(interval, "run_id").select(
        F.concat_ws("_", "model_name", "setting").alias("result_key"),
        "run_id",
        F.col("model_name").alias("model"),
        setting_label(F.col("setting"), PROMPT_TYPE).alias("prompt_type"),
        setting_label(F.col("setting"), VIDEO_TYPE).alias("video_type"),
        MICRO, *categories, "ci_low", "ci_mean", "ci_high",
    )
    kept = [c for c in rows.columns if c not in ("result_key",)]
    return (
        rows.groupBy("result_key")
        .agg(F.max_by(F.struct(*kept), "run_id").alias("_row"))
        .select("result_key", "_row.*")
        .orderBy("result_key")
    )


def seed_summary(scores: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over the seeds of a model and setting."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return scores.groupBy(*by).agg(*aggs)
