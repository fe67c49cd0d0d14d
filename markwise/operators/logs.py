"""Structured agent logs: flattening, stage transitions, names and media types."""

from __future__ import annotations

import mimetypes
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.operators import ordered
from markwise.operators.ordered import lay_out

ENTRY = """text string, record struct<
  extra: struct<stage: string, event: string, file_path: string, mime: string, meta: string>,
  function: string, message: string, time: struct<repr: string>>"""

# Suffixes shown as text when their media type is unknown.
TEXT_SUFFIXES = (".py", ".json", ".md", ".yaml", ".yml", ".txt", ".log")
LABEL_LENGTH = 60


def _given(text: Column) -> Column:
    return F.when(text != "", text)


def flatten_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row per valid JSON line: stage, action, timestamp, message, file_path, mime, meta."""
    rows = lines.filter(F.try_parse_json(F.trim(line)).isNotNull()).withColumn(
        "_e", F.from_json(line, ENTRY)
    )
    record, text = F.col("_e.record"), F.col("_e.text")
    extra = record["extra"]
    return rows.withColumns(
        {
            "stage": F.coalesce(_given(extra["stage"]), F.lit("unknown")),
            "action": F.coalesce(_given(extra["event"]), record["function"], F.lit("")),
            "timestamp": F.coalesce(
                _given(record["time"]["repr"]), F.split_part(F.coalesce(text, F.lit("")), F.lit(" | "), F.lit(1))
            ),
            "message": F.coalesce(_given(record["message"]), text, F.lit("")),
            "file_path": extra["file_path"],
            "mime": infer_mime(extra["file_path"], extra["mime"]),
            "meta": F.coalesce(extra["meta"], F.lit("{}")),
        }
    ).drop("_e", line)


def infer_mime(path: Column, declared: Column) -> Column:
    """Declared type first, else by suffix from the standard table, else text for known suffixes."""
    types = F.create_map(*[F.lit(x) for pair in sorted(mimetypes.types_map.items()) for x in pair])
    packed = "|".join(s.lstrip(".") for s in mimetypes.encodings_map)
    bare = F.regexp_replace(path, rf"(?i)\.({packed})$", "")
    suffix = F.lower(F.regexp_extract(bare, r"(\.[^./]+)$", 1))
    by_suffix = F.coalesce(types[suffix], F.when(suffix.isin(*TEXT_SUFFIXES), F.lit("text/plain")))
    return F.coalesce(_given(declared), F.when(path != "", by_suffix))


def transition_label() -> Column:
    """The action of the event, else its message, cut to the label's length."""
    text = F.coalesce(_given(F.col("action")), F.col("message"), F.lit(""))
    return F.when(
        F.length(text) > LABEL_LENGTH, F.concat(F.substring(text, 1, LABEL_LENGTH), F.lit("…"))
    ).otherwise(text)


def stage_transitions(
    events: DataFrame, by: Sequence[str], order: Sequence[str], slice_rows: int | None = None
) -> DataFrame:
    """Consecutive events of different stage: ``from_stage, to_stage, label``."""
    laid = lay_out(events, by, order, slice_rows).scan(from_stage=ordered.lag(F.col("stage")))
    moved = (F.col("from_stage") != F.col("stage")) & (F.col("from_stage") != "")
    return laid.rows().filter(moved).select(
        *by, *order, "from_stage", F.col("stage").alias("to_stage"), transition_label().alias("label")
    )


def transition_weights(transitions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often each transition occurs."""
    return transitions.groupBy(*by, "from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"))


def slug(name: Column) -> Column:
    """Identifier of a stage name."""
    trimmed = F.trim(name)
    base = F.regexp_replace(F.when(trimmed == "", F.lit("unknown")).otherwise(trimmed), r"(?U)\W+", "_")
    base = F.regexp_replace(base, r"^_+|_+$", "")
    base = F.when(base == "", F.lit("stage")).otherwise(base)
    return F.when(base.rlike(r"^\d"), F.concat(F.lit("_"), base)).otherwise(base)


def stage_ids(events: DataFrame, ordinal: str, stage: str = "stage") -> DataFrame:
    """Distinct stages with unique identifiers; later ones get ``_2``, ``_3`` ...

    Works on the distinct names, found by aggregation. A numbered name that is
    itself another stage's name is numbered once more.
    """
    names = events.groupBy(stage).agg(F.min(ordinal).alias("_seen"))
    for column in ("_base", "stage_id"):
        base = slug(F.col(stage)) if column == "_base" else F.col("_base")
        placed = lay_out(names.withColumn("_try", base), ["_try"], ["_seen"]).scan(_rank=ordered.ordinal())
        named = F.when(F.col("_rank") == 0, F.col("_try")).otherwise(
            F.concat_ws("_", "_try", F.col("_rank") + 1)
        )
        names = placed.rows().withColumn(column, named).drop("_try", "_rank")
    return names.select(stage, "stage_id")
