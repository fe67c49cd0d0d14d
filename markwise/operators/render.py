"""Questions to conversations, and conversations to chat messages or plain text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.functions.ids import recipe_key
from markwise.operators import ordered
from markwise.operators.ordered import lay_out

OPEN = "???"  # placeholder of a message that the question fills


def render(
    questions: DataFrame, templates: DataFrame, base: str, custom: Mapping[str, str] | None = None,
    recipe: Mapping | None = None,
) -> DataFrame:
    """One row per message: conv_id, qid, question_no, pos, type, tag, content.

    ``questions``: qid, question_no, question_category, qstr, media_dir, video,
    first_prompt, last_prompt. ``templates``: template, pos, type, tag, content.
    ``custom`` names the template of a category, all others use ``base``. The
    conversation id joins question id, template and the hash of the recipe.
    """
    name = F.lit(base)
    for category, template in (custom or {}).items():
        name = F.when(F.col("question_category") == category, F.lit(template)).otherwise(name)
    path = lambda file: F.concat_ws("/", "media_dir", file)
    # one row per template: its few messages as an array
    bodies = templates.groupBy("template").agg(
        F.array_sort(F.collect_list(F.struct("pos", "type", "tag", "content"))).alias("_body")
    )
    rows = (
        questions.withColumn("template", name)
        .join(bodies, "template", "left")
        .withColumn(
            "_body",
            F.coalesce("_body", F.raise_error(F.concat(F.lit("no template "), "template")).cast(bodies.schema["_body"].dataType)),
        )
        .withColumn("_m", F.explode("_body"))
    )
    tag = F.col("_m.tag")
    content = (
        F.when(F.col("_m.type") == "video", path("video"))
        .when(tag == "visual_prompt", path("first_prompt"))
        .when(tag == "jumbled_visual_prompt", path("last_prompt"))
        .when(tag == "question", F.col("qstr"))
        .otherwise(F.col("_m.content"))
    )
    filled = F.when(content != OPEN, content).otherwise(
        F.raise_error(F.concat(F.lit("nothing fills the message "), tag)).cast("string")
    )
    key = F.concat_ws("_", "qid", "template", F.lit(recipe_key(dict(recipe or {}))))
    return rows.select(
        key.alias("conv_id"), "qid", "question_no", F.col("_m.pos").alias("pos"), F.col("_m.type").alias("type"),
        tag.alias("tag"), filled.alias("content"),
    )


def message_runs(
    parts: DataFrame, by: Sequence[str], order: Sequence[str], role: str = "role", slice_rows: int | None = None
) -> DataFrame:
    """Consecutive parts of one role form a message: adds ``message_idx, part_idx``."""
    opens = F.col("_before").isNull() | (F.col("_before") != F.col(role))
    laid = (
        lay_out(parts, by, order, slice_rows)
        .scan(_before=ordered.lag(F.col(role)), _at=ordered.ordinal())
        .then(lambda d: d.withColumn("_open", opens.cast("int")))
        .scan(
            _no=ordered.running_sum(F.col("_open")),
            _from=ordered.last_value(F.when(F.col("_open") == 1, F.col("_at"))),
        )
    )
    return laid.rows().withColumns(
        {"message_idx": F.col("_no") - 1, "part_idx": F.col("_at") - F.col("_from")}
    ).drop("_before", "_at", "_open", "_no", "_from")


def to_chat(
    conversation: DataFrame,
    by: Sequence[str] = ("conv_id",),
    system: bool = True,
    marks: Mapping[str, str] | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Messages in long form: by, message_idx, part_idx, role, type, content.

    The task instruction becomes a system message and comes first; with
    ``system=False`` it stays a user part. ``marks`` (``video``, ``prompt``,
    ``first``, ``second``) are texts put before media; first and second are used
    when the conversation has a second prompt.
    """
    is_task = F.col("tag") == "task_instruction"
    rows = conversation.withColumn(
        "role", F.when(is_task, F.lit("system")).otherwise(F.lit("user")) if system else F.lit("user")
    ).withColumn("_front", (F.col("role") == "user").cast("int"))
    part = F.struct(F.lit(1).alias("at"), F.col("type"), F.col("content"))
    parts = F.array(part)
    if marks:
        second = conversation.filter(F.col("tag") == "jumbled_visual_prompt").select(*by).distinct()
        rows = rows.join(second.withColumn("_two", F.lit(True)), list(by), "left")
        mark = F.when(F.col("type") == "video", F.lit(marks["video"])).when(
            F.col("type") == "image",
            F.when(F.col("_two") & (F.col("tag") == "visual_prompt"), F.lit(marks["first"]))
            .when(F.col("_two"), F.lit(marks["second"]))
            .otherwise(F.lit(marks["prompt"])),
        )
        marked = F.struct(F.lit(0).alias("at"), F.lit("text").alias("type"), mark.alias("content"))
        parts = F.when(mark.isNotNull(), F.array(marked, part)).otherwise(parts)
    long = rows.select(*by, "_front", "pos", "role", F.explode(parts).alias("_p")).select(
        *by, "_front", "pos", F.col("_p.at").alias("_at0"), "role", "_p.type", "_p.content"
    )
    out = message_runs(long, by, ["_front", "pos", "_at0"], slice_rows=slice_rows)
    return out.select(*by, "message_idx", "part_idx", "role", "type", "content")


def to_text(
    parts: DataFrame, by: Sequence[str], order: Sequence[str], max_chars: int, content: str = "content", sep: str = "",
    slice_rows: int | None = None,
) -> DataFrame:
    """Ordered text of each conversation: by, chunk_no, text.

    The text comes in numbered chunks: a part belongs to the chunk of its first
    character, at ``max_chars`` a chunk. Their concatenation is the whole text,
    so no row grows with the data and none is cut.
    """
    first = F.col("_at") == 0
    piece = F.when(first, F.col(content)).otherwise(F.concat(F.lit(sep), F.col(content)))
    laid = (
        lay_out(parts.filter(F.col(content).isNotNull()), by, order, slice_rows)
        .scan(_at=ordered.ordinal())
        .then(lambda d: d.withColumn("_piece", piece))
        .then(lambda d: d.filter(F.length("_piece") > 0))
        .scan(_offset=ordered.running_sum(F.length("_piece").cast("long"), exclusive=True))
    )
    items = F.struct(*order, "_piece")
    return (
        laid.rows()
        .groupBy(*by, F.floor(F.col("_offset") / max_chars).alias("chunk_no"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda s: s["_piece"]), "").alias("text"))
    )


def split_media(conversation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text parts and media parts."""
    is_text = F.col("type").isin("text", "text_file")
    return conversation.filter(is_text), conversation.filter(~is_text)


def inline_files(conversation: DataFrame, files: DataFrame) -> DataFrame:
    """Content of ``text_file`` parts read from ``files`` (path, content); a missing one is an error."""
    known = files.select(F.col("path").alias("_path"), F.col("content").alias("_content"))
    out = conversation.join(
        known, (F.col("type") == "text_file") & (F.col("content") == F.col("_path")), "left"
    )
    missing = F.raise_error(F.concat(F.lit("no text file "), "content")).cast("string")
    text = F.when(F.col("type") == "text_file", F.coalesce("_content", missing)).otherwise(F.col("content"))
    return out.withColumn("content", text).drop("_path", "_content")
