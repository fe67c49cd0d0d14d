"""Sub-sampling, re-indexing and clip chunking of ordered frames."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.operators import ordered
from markwise.operators.ordered import lay_out


def with_position(
    df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "global_idx",
    size: str | None = None, slice_rows: int | None = None,
) -> DataFrame:
    """Add the dense 0-based position per key and, if named, the key's row count."""
    scans = {out: ordered.ordinal()}
    if size:
        scans[size] = ordered.group_size()
    return lay_out(df, by, order, slice_rows).scan(**scans).rows()


def subsample(
    df: DataFrame,
    skip: int,
    forced: Column | None = None,
    retain: Sequence[int] = (),
    index: str = "global_idx",
    size: str | None = None,
    valid: Column | None = None,
) -> DataFrame:
    """Keep every ``skip``-th row, forced rows and the listed positions.

    A negative position counts from the end and needs the ``size`` column.
    Rows that are not ``valid`` use up a position but are never kept.
    """
    if skip < 1:
        raise ValueError("skip must be at least 1")
    keep = F.col(index) % skip == 0
    if forced is not None:
        keep = keep | F.coalesce(forced, F.lit(False))
    front = [i for i in retain if i >= 0]
    back = [i for i in retain if i < 0]
    if front:
        keep = keep | F.col(index).isin(front)
    if back:
        keep = keep | (F.col(index) - F.col(size)).isin(back)
    return df.filter(keep if valid is None else keep & valid)


def prompt_frame(prompt_idx: str = "prompt_frame_idx", frame_idx: str = "frame_idx") -> Column:
    """The row is its own prompt frame; two missing indices count as equal."""
    return F.col(prompt_idx).eqNullSafe(F.col(frame_idx))


def row_at(df: DataFrame, i: int, index: str = "global_idx", size: str | None = None) -> DataFrame:
    """The row at position ``i`` of every key; negative counts from the end."""
    at = F.lit(i) if i >= 0 else F.col(size) + i
    return df.filter(F.col(index) == at)


def row_slice(
    df: DataFrame, start: int | None = None, stop: int | None = None, index: str = "global_idx",
    size: str | None = None,
) -> DataFrame:
    """Positions ``[start:stop]`` with the usual sequence rules, step 1."""
    keep = F.lit(True)
    for bound, lower in ((start, True), (stop, False)):
        if bound is None:
            continue
        edge = F.lit(bound) if bound >= 0 else F.greatest(F.lit(0), F.col(size) + bound)
        keep = keep & ((F.col(index) >= edge) if lower else (F.col(index) < edge))
    return df.filter(keep)


def select_frames(
    df: DataFrame, index: str = "frame_idx", *, indices: Sequence[int] | None = None, start: int = 0,
    step: int = 1, n: int | None = None, stop: int | None = None,
) -> DataFrame:
    """Frames by explicit indices, else by start and step with a count or a stop."""
    if indices is not None:
        return df.filter(F.col(index).isin(sorted({i for i in indices if i >= 0})))
    if step <= 0:
        raise ValueError("step must be positive")
    keep = (F.col(index) >= start) & ((F.col(index) - start) % step == 0)
    if n is not None:
        keep = keep & (F.col(index) < start + n * step)
    elif stop is not None:
        keep = keep & (F.col(index) < stop)
    return df.filter(keep)


def _picked(i: Column, n: Column, k: int, mode: str) -> Column:
    """Position of the i-th of k samples among n rows, in double arithmetic."""
    if mode == "linspace":
        step = (n - 1) / F.lit(float(max(k - 1, 1)))
        return F.when(i == k - 1, n - 1 if k > 1 else F.lit(0)).otherwise(F.floor(i * step))
    if mode == "centre":
        return F.floor(n / F.lit(float(k)) * (i + 0.5))
    if mode == "stride":
        return F.floor(i * (n / F.least(n, F.lit(k))))
    raise ValueError(f"unknown mode {mode!r}")


def sample_positions(
    sizes: DataFrame, by: Sequence[str], k: int, mode: str = "linspace", size: str = "n",
    preserve_first: int = 0,
) -> DataFrame:
    """``sample_no, global_idx`` for every key; a position may occur more than once.

    ``preserve_first`` rows are always taken and the rest is sampled after them
    with the remaining budget.
    """
    rest = F.greatest(F.col(size) - preserve_first, F.lit(0))
    budget = max(k - preserve_first, 0)
    count = F.lit(budget)
    if mode == "stride":  # a float range may be one longer than asked
        count = F.ceil(rest / (rest / F.least(rest, F.lit(budget))))
    drawn = sizes.filter(rest > 0).select(
        *by,
        F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("_i"),
        rest.alias("_rest"),
    ) if budget else None
    out = None
    if drawn is not None:
        out = drawn.select(
            *by,
            (F.col("_i") + preserve_first).cast("long").alias("sample_no"),
            (_picked(F.col("_i"), F.col("_rest"), budget, mode) + preserve_first)
            .cast("long").alias("global_idx"),
        )
    if preserve_first:
        kept = F.least(F.col(size), F.lit(preserve_first)).cast("int")
        first = sizes.select(*by, F.explode(F.sequence(F.lit(0), kept - 1)).alias("_i"))
        place = F.col("_i").cast("long")
        first = first.select(*by, place.alias("sample_no"), place.alias("global_idx"))
        out = first if out is None else first.unionByName(out)
    return out


def sample_uniform(
    df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, mode: str = "linspace",
    preserve_first: int = 0, slice_rows: int | None = None,
) -> DataFrame:
    """``k`` evenly spread rows per key, with ``sample_no`` and ``global_idx``.

    A key with fewer rows than samples repeats rows, as an integer linspace does.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    wanted = sample_positions(sizes, by, k, mode, preserve_first=preserve_first)
    placed = with_position(df, by, order, slice_rows=slice_rows)
    return placed.join(wanted, [*by, "global_idx"])


def sample_with_forced(
    df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, forced: Column,
    keep_forced: bool = True, slice_rows: int | None = None,
) -> DataFrame:
    """Uniform sample and forced rows together, in order: all forced rows, filled up to ``k`` with uniform ones.

    With ``keep_forced=False`` both are cut to the first ``k`` rows, which may
    lose late rows, forced ones too.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    wanted = sample_positions(sizes, by, k).select(*by, "global_idx").distinct()
    wanted = wanted.withColumn("_uniform", F.lit(True))
    placed = with_position(df, by, order, slice_rows=slice_rows).withColumn(
        "_forced", F.coalesce(forced, F.lit(False))
    )
    both = placed.join(wanted, [*by, "global_idx"], "left").filter("_forced OR _uniform")
    first = F.when(F.col("_forced"), 0).otherwise(1) if keep_forced else F.lit(0)
    ranked = lay_out(both.withColumn("_first", first), by, ["_first", "global_idx"], slice_rows).scan(
        _place=ordered.ordinal()
    ).rows()
    keep = F.col("_place") < k
    if keep_forced:
        keep = keep | F.col("_forced")
    return ranked.filter(keep).drop("_first", "_place", "_forced", "_uniform")


def chunk(
    df: DataFrame, max_frames: int = 256, overlap: int = 1, overlap_in_budget: bool = False,
    index: str = "global_idx", size: str = "n",
) -> DataFrame:
    """Cut frames into clips; each clip starts with the last frames before it.

    Adds ``clip_idx``, ``clip_pos`` and ``is_overlap``. Either the overlap comes
    on top of ``max_frames``, or (``overlap_in_budget``) later clips only bring
    ``max_frames - overlap`` new frames. A row finds its clips from its own
    position and the key's row count: no shuffle.
    """
    overlap = min(max(overlap, 0), max_frames - 1)
    step = max_frames - overlap if overlap_in_budget else max_frames
    lead = max_frames - step  # frames the first clip has more than a step
    idx, clip = F.col(index), F.col("clip_idx")
    own = F.greatest(F.floor((idx - lead) / F.lit(step)), F.lit(0)).cast("long")
    last = F.greatest(own, F.floor((idx - lead + overlap) / F.lit(step)).cast("long"))
    fresh_from = F.when(clip == 0, F.lit(0)).otherwise(clip * step + lead)
    return (
        df.withColumn("_own", own)
        .withColumn("clip_idx", F.explode(F.sequence(F.col("_own"), last)))
        .filter(fresh_from < F.col(size))
        .withColumns(
            {
                "is_overlap": clip > F.col("_own"),
                "clip_pos": (idx - fresh_from + F.when(clip == 0, 0).otherwise(overlap)).cast("long"),
            }
        )
        .drop("_own")
    )


def predict_clips(counts: DataFrame, max_frames: int = 256, overlap: int = 0, size: str = "n") -> DataFrame:
    """Upper bound of the clip count: ``ceil(n / (max_frames - overlap))``."""
    overlap = min(max(overlap, 0), max_frames - 1)
    return counts.withColumn(
        "predicted_clips", F.ceil(F.col(size) / F.lit(max_frames - overlap)).cast("long")
    )


def stitch(clips: DataFrame, max_frames: int = 256, overlap: int = 1) -> DataFrame:
    """One frame stream from clips: leading overlap rows of later clips dropped.

    Adds ``frame_idx``; for clips whose overlap is on top of the budget.
    """
    fresh = clips.filter((F.col("clip_idx") == 0) | (F.col("clip_pos") >= overlap))
    shift = F.when(F.col("clip_idx") == 0, F.lit(0)).otherwise(F.lit(overlap))
    return fresh.withColumn(
        "frame_idx", (F.col("clip_idx") * max_frames + F.col("clip_pos") - shift).cast("long")
    )


def check_complete(tracks: DataFrame, expected: DataFrame, by: Sequence[str], size: str = "n") -> DataFrame:
    """Stored rows against expected frames per track: ``stored, expected, complete``."""
    stored = tracks.groupBy(*by).agg(F.count(F.lit(1)).alias("stored"))
    return expected.select(*by, F.col(size).alias("expected")).join(stored, list(by), "left").select(
        *by, "expected", F.coalesce("stored", F.lit(0)).alias("stored"),
        (F.coalesce("stored", F.lit(0)) == F.col("expected")).alias("complete"),
    )


def plan_prompts(questions: DataFrame, video: str = "video_id", frames: str = "frame_idx",
                 ordinal: str = "ordinal", owner: str = "question_no") -> DataFrame:
    """Distinct ``(video, frame)`` prompts; the first question that asks owns one."""
    return (
        questions.select(video, F.explode(frames).alias("frame"), ordinal, owner)
        .groupBy(video, "frame")
        .agg(F.min_by(owner, ordinal).alias("owner"))
    )


def keep_sets(questions: DataFrame, video: str = "video_id", frames: str = "frame_idx") -> DataFrame:
    """Distinct frames to keep per video, in long form."""
    return questions.select(video, F.explode(frames).alias("frame")).distinct()


def restrict_keys(
    df: DataFrame, key: str, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows whose key matches the include list, or does not match the exclude list.

    Entries are exact names or globs, repeated ones count once. Also returns the
    include entries that matched nothing. Giving both lists is an error.
    """
    if include and exclude:
        raise ValueError("give include or exclude, not both")
    entries = list(dict.fromkeys(include or exclude or ()))
    nothing = df.sparkSession.createDataFrame([], "entry string")
    if not entries:
        return df, nothing
    names = df.select(F.col(key).alias("_name")).filter("_name IS NOT NULL").distinct()
    pairs = matches(names, "_name", entries)
    matched = pairs.select(F.col("_name").alias(key)).distinct()
    if exclude:
        return df.filter(F.col(key).isNotNull()).join(matched, key, "left_anti").select(*df.columns), nothing
    missing = _entry_table(df.sparkSession, [(e,) for e in entries], "entry string").join(pairs, "entry", "left_anti")
    return df.join(matched, key, "left_semi").select(*df.columns), missing


def _entry_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of given entries; one local relation, however many there are."""
    names = [field.split()[0] for field in schema.split(", ")]
    return spark.createDataFrame(pd.DataFrame(list(rows), columns=names), schema)


def matches(names: DataFrame, name: str, entries: Sequence[str]) -> DataFrame:
    """(``name``, entry) of all distinct names that an entry names or, as a glob, covers.

    Exact entries are an equality join. A glob is filed under its literal start or, where it starts with a wildcard, under its
    longest literal piece, and meets only the names that have that text there; the pattern is tested on those. Globs of
    wildcards alone are patterns over all names.
    """
    spark, plain, filed, free = names.sparkSession, [], [], []
    for entry in entries:
        pieces = re.split(r"[*?]", entry)
        anchor = pieces[0] or max(pieces, key=len)
        if len(pieces) == 1:
            plain.append((entry, entry))
        elif anchor:
            filed.append((entry, anchor, not pieces[0], glob_pattern(entry)))
        else:
            free.append(entry)
    found = names.join(_entry_table(spark, plain, f"{name} string, entry string"), name).select(name, "entry")
    for inner in (False, True):
        own = [(entry, anchor, pattern) for entry, anchor, at, pattern in filed if at == inner]
        if not own:
            continue
        lengths = F.array(*(F.lit(n) for n in sorted({len(anchor) for _, anchor, _ in own})))
        size = F.length(name)
        cut = names.withColumn("_n", F.explode(F.filter(lengths, lambda n: n <= size)))
        if inner:
            cut = cut.withColumn("_at", F.explode(F.sequence(F.lit(1), size - F.col("_n") + 1)))
        cut = cut.select(name, F.substr(name, F.col("_at") if inner else F.lit(1), F.col("_n")).alias("_anchor")).distinct()
        near = cut.join(_entry_table(spark, own, "entry string, _anchor string, _pattern string"), "_anchor")
        found = found.unionByName(near.filter(F.regexp_like(name, F.col("_pattern"))).select(name, "entry"))
    for entry in free:
        found = found.unionByName(names.filter(F.col(name).rlike(glob_pattern(entry))).select(name, F.lit(entry).alias("entry")))
    return found


def glob_pattern(entry: str) -> str:
    """Anchored regular expression of a glob."""
    marks = {"*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(marks.get(ch) or re.escape(ch) for ch in entry) + "$"


def segment_positions(
    sizes: DataFrame, by: Sequence[str], k: int, fps: Column, size: str = "n",
    bound_start: Column | None = None, bound_end: Column | None = None, first_idx: int = 0,
) -> DataFrame:
    """Centres of ``k`` equal segments, optionally inside a time bound in seconds."""
    lo = F.lit(float(first_idx))
    hi = (F.col(size) - 1).cast("double")
    if bound_start is not None:
        lo = F.greatest(lo, F.rint(bound_start * fps))
    if bound_end is not None:
        hi = F.least(hi, F.rint(bound_end * fps))
    width = (F.col("_hi") - F.col("_lo")) / k
    return (
        sizes.withColumns({"_lo": lo, "_hi": hi})
        .select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample_no"))
        .select(
            *by, F.col("sample_no").cast("long").alias("sample_no"),
            F.floor(F.col("_lo") + width / 2 + F.rint(width * F.col("sample_no")))
            .cast("long").alias("global_idx"),
        )
    )
