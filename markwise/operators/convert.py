"""Questions rewritten for a model that refers to objects by mask tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.functions.rle import empty_runs
from markwise.operators.sampling import with_position

# The texts around a converted question, and raw options left alone.
PREFIX = "<video>\nThis question is about the following objects in the video: "
SUFFIX = "\nAnswer with the option's letter from the given choices directly."
PLAIN = ('"none"', '"yes"', '"no"')


def zip_by_position(
    a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """i-th row of ``a`` with i-th row of ``b``; unequal counts are an error."""
    keys = list(by)
    left = with_position(a, keys, order_a, "_pos")
    right = with_position(b, keys, order_b, "_pos")
    both = left.withColumn("_a", F.lit(True)).join(right.withColumn("_b", F.lit(True)), [*keys, "_pos"], "full_outer")
    paired = F.col("_a") & F.col("_b")
    check = F.when(paired, F.col("_pos")).otherwise(F.raise_error(F.lit("the two sides differ in length")).cast("long"))
    return both.withColumn("position", check).drop("_a", "_b", "_pos")


def pair_one_to_one(a: DataFrame, b: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Rows of both sides with equal key; an unmatched or repeated key is an error."""
    other = [c for c in b.columns if c != key]
    clash = (set(a.columns) & set(b.columns)) - {key}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer")
    if strict:
        counts = both.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        both = both.join(counts, key)
        bad = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_n") > 1)
        fail = F.raise_error(F.concat(F.lit("not exactly one partner for "), F.col(key))).cast("int")
        both = both.withColumn("_a", F.when(bad, fail).otherwise(F.col("_a"))).filter("_a = 1").drop("_n")
    else:
        both = both.filter("_a = 1 AND _b = 1")
    return both.select(*a.columns, *other)


def object_token(part: Column, suffix: str | Column = "") -> Column:
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.lit("<object"), part, suffix, F.lit(">"))


def replace_mentions(raw: Column, parts: Column, suffix: Column) -> Column:
    """``Part 3`` of the given ids to its token; other ids stay."""
    pieces = F.split(raw, r"\bPart\s+(?=\d)")
    head = F.get(pieces, F.lit(0))

    def piece(p: Column) -> Column:
        number = F.regexp_extract(p, r"^(\d+)\b", 1)
        token = F.concat(object_token(number, suffix), F.regexp_replace(p, r"^\d+", ""))
        return F.when(F.array_contains(parts, number), token).otherwise(F.concat(F.lit("Part "), p))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece)
    return F.concat(head, F.array_join(rest, ""))


def object_tokens(answer: Column, kind: Column, tracking: Column) -> Column:
    """Option text with object tokens; tracking marks the two images A and B."""
    first = F.get(answer, F.lit(0))
    one = object_token(F.get(first, F.lit(0)), F.when(tracking, F.lit("B")).otherwise(F.lit("")))
    listed = F.array_join(F.transform(first, lambda p: object_token(p)), ", ")
    no_list = F.raise_error(F.lit("list options are not supported for tracking questions")).cast("string")
    pairs = F.array_join(
        F.transform(
            answer,
            lambda e: F.when(
                tracking,
                F.concat(object_token(F.get(e, F.lit(0)), "A"), F.lit(" matches "), object_token(F.get(e, F.lit(1)), "B")),
            ).otherwise(
                F.concat(object_token(F.get(e, F.lit(0))), F.lit(" and "), object_token(F.get(e, F.lit(1))))
            ),
        ),
        ", ",
    )
    return (
        F.when(kind == "str", one)
        .when(kind == "list", F.when(tracking, no_list).otherwise(listed))
        .otherwise(pairs)
    )


def convert_options(questions: DataFrame) -> DataFrame:
    """Options, truth and text with object tokens.

    Input: question_category, kind, raw_qstr, query_parts (array), correct_idx
    and options (array of idx, raw_json, label, text, full_text, answer; answer
    is null for none, yes/no and combined options, which keep their text).
    """
    tracking = F.col("question_category") == "tracking"
    digits = lambda o: (F.col("kind") != "str") | F.get(F.get(o["answer"], F.lit(0)), F.lit(0)).rlike(r"^\d+$")
    touched = lambda o: o["answer"].isNotNull() & ~o["raw_json"].isin(*PLAIN) & digits(o)
    words = lambda o: F.when(touched(o), object_tokens(o["answer"], F.col("kind"), tracking)).otherwise(o["text"])
    full = lambda o: F.when(o["answer"].isNotNull() & ~o["raw_json"].isin(*PLAIN),
                            F.concat(o["label"], F.lit(". "), words(o))).otherwise(o["full_text"])
    suffix = F.when(tracking, F.lit("A")).otherwise(F.lit(""))
    out = questions.withColumns(
        {
            "raw_qstr": replace_mentions(F.col("raw_qstr"), F.col("query_parts"), suffix),
            "options": F.transform(
                "options",
                lambda o: F.struct(
                    o["idx"].alias("idx"), o["raw_json"].alias("raw_json"), o["label"].alias("label"),
                    words(o).alias("text"), full(o).alias("full_text"), o["answer"].alias("answer"),
                ),
            ),
        }
    )
    lines = F.array_join(F.transform("options", lambda o: o["full_text"]), "\n")
    return out.withColumns(
        {
            "qstr": F.concat(F.col("raw_qstr"), F.lit("\nOptions:\n"), lines),
            "correct_option": F.get(F.filter("options", lambda o: o["idx"] == F.col("correct_idx")), F.lit(0)),
        }
    )


def referred_objects(questions: DataFrame) -> DataFrame:
    """Distinct (question_no, frame_pos, part_id) a question or its options mention."""
    tracking = F.col("question_category") == "tracking"
    ref = lambda pos, part: F.struct(pos.alias("frame_pos"), part.alias("part_id"))
    asked = F.transform("query_parts", lambda p: ref(F.lit(0), p))
    used = F.filter("options", lambda o: o["answer"].isNotNull() & ~o["raw_json"].isin(*PLAIN))
    single_pos = F.when(tracking & (F.col("kind") == "str"), 1).otherwise(0)
    flat = F.flatten(
        F.transform(
            used,
            lambda o: F.flatten(
                F.transform(
                    o["answer"],
                    lambda e: F.transform(
                        e,
                        lambda p, i: ref(
                            F.when(tracking & (F.col("kind") == "listoflist"), i).otherwise(single_pos), p
                        ),
                    ),
                )
            ),
        )
    )
    return questions.select("question_no", F.explode(F.concat(asked, flat)).alias("_r")).select(
        "question_no", "_r.frame_pos", "_r.part_id"
    ).distinct()


def convert_prompt_masks(questions: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prompt masks of every question frame, and the visibility issues.

    ``questions`` also has video_id and frame_idx (array); ``masks``: video_id,
    frame_idx, part_id, h, w, runs, already under the ids shown. The second frame
    of a tracking question only gets the parts it refers to; one without a mask
    gets an empty mask of the frame's size. That, and a part referred to in the
    first frame that has no mask, is an issue.
    """
    frames = questions.select(
        "question_no", "question_category", "video_id",
        F.posexplode("frame_idx").alias("frame_pos", "frame_idx"),
    )
    sizes = masks.groupBy("video_id", "frame_idx").agg(F.first("h").alias("_h"), F.first("w").alias("_w"))
    missing = F.raise_error(F.lit("no masks for a prompt frame")).cast("int")
    frames = frames.join(sizes, ["video_id", "frame_idx"], "left").withColumn("_h", F.coalesce("_h", missing))
    second = (F.col("question_category") == "tracking") & (F.col("frame_pos") == 1)
    referred = referred_objects(questions)
    all_parts = frames.filter(~second).join(
        masks.select("video_id", "frame_idx", "part_id", "runs"), ["video_id", "frame_idx"]
    )
    wanted = frames.filter(second).join(referred, ["question_no", "frame_pos"]).join(
        masks.select("video_id", "frame_idx", "part_id", "runs"), ["video_id", "frame_idx", "part_id"], "left"
    )
    mark = F.when(F.col("question_category") != "tracking", F.lit("")).when(
        F.col("frame_pos") == 0, F.lit("A")
    ).otherwise(F.lit("B"))
    rows = all_parts.unionByName(wanted).select(
        "question_no", "frame_pos", "frame_idx", "part_id",
        F.coalesce("runs", empty_runs(F.col("_h"), F.col("_w"))).alias("runs"),
        F.col("runs").isNull().alias("is_missing"),
        F.concat(object_token(F.col("part_id"), mark), F.lit("<region>")).alias("region_text"),
    )
    unseen = (
        frames.filter((F.col("question_category") == "tracking") & (F.col("frame_pos") == 0))
        .join(referred, ["question_no", "frame_pos"])
        .join(masks.select("video_id", "frame_idx", "part_id"), ["video_id", "frame_idx", "part_id"], "left_anti")
    )
    cols = ["question_no", "frame_pos", "part_id"]
    issues = rows.filter("is_missing").select(*cols).unionByName(unseen.select(*cols))
    return rows, issues


def with_mask_list(questions: DataFrame, prompt_masks: DataFrame) -> DataFrame:
    """Question text that lists its mask regions.

    A question shows the parts of one or two frames of one furniture, which
    bounds the list.
    """
    regions = prompt_masks.groupBy("question_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("frame_pos", "part_id", "region_text"))),
                lambda s: s["region_text"],
            ),
            ", ",
        ).alias("_regions")
    )
    return questions.join(regions, "question_no", "left").withColumn(
        "qstr",
        F.concat(F.lit(PREFIX), F.coalesce("_regions", F.lit("")), F.lit(".\n"), "qstr", F.lit(SUFFIX)),
    ).drop("_regions")
