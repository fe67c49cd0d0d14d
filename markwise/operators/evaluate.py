"""A whole evaluation: answers read from files, parsed, tallied and reported."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.functions import parse
from markwise.operators import score
from markwise.sources import readers

#: The rows of a report, in their order.
CATEGORIES = (score.MICRO, "temporal_ord", "temporal_loc", "tracking", "mating")
BINARY_CATEGORIES = (score.MICRO, "yes", "no")


def evaluate(
    spark: SparkSession, model: str, path: str | None = None, paths: str | Iterable[str] | None = None,
    n_shuffles: int | None = None, binary: bool = False, categories: Sequence[str] | None = None,
) -> DataFrame:
    """The report of all answers below the given path or paths, one row per category in the report's order.

    ``model`` names the parser of its answers. ``n_shuffles`` keeps the first option shuffles of
    each question. With ``binary`` the true answer, yes or no, is the category.
    A question's category, truth and number of options come from its first answer in
    file and line order. Other categories than the report's count in the micro row only; a
    category of the report that no question has is an error.
    """
    rows = readers.attempts(readers.read_responses(spark, path=path, paths=paths))
    rows = score.filter_shuffles(rows, n_shuffles).withColumn(
        "prediction", parse.scored_label(F.col("response_text"), F.col("post_processed_response"), F.lit(model))
    )
    if binary:
        rows = score.binary_category(rows)
    tallies = score.tally(rows, first=["category", "truth", "n_options"], ordinal="ordinal")
    order = categories or (BINARY_CATEGORIES if binary else CATEGORIES)
    return score.score(tallies, strict_schema=True, categories=order)
