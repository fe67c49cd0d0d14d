"""Scans of JSON lines, JSON documents, YAML folders, CSV manifests and listings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from markwise.functions.rle import decode_counts
from markwise.functions.text import natural_key
from markwise.operators import ordered
from markwise.operators.logs import flatten_events
from markwise.operators.sampling import with_position
from markwise.operators.score import with_question_ids
from markwise.sources import schemas

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)"
#: Spark writes local files with one slash or with three.
_LOCAL = r"^([A-Za-z][A-Za-z0-9+.-]*):///"


def _one_slash(uri: str) -> str:
    return re.sub(_LOCAL, r"\1:/", uri)


def response_paths(path: str | None = None, paths: str | Iterable[str] | None = None) -> list[str]:
    """One path, or several (also comma-separated); blanks are dropped."""
    if (path is None) == (paths is None):
        raise ValueError("give exactly one of path and paths")
    if path is not None:
        return [path]
    given = [paths] if isinstance(paths, str) else list(paths)
    found = [p.strip() for text in given for p in str(text).split(",") if p.strip()]
    if not found:
        raise ValueError("no response path given")
    return found


def numbered_lines(
    spark: SparkSession, paths: str | Sequence[str], slice_rows: int | None = None
) -> DataFrame:
    """Text lines with ``path, file_no, line_no``.

    A file given twice comes twice.
    ``file_no`` is the place of the given path; files of one given folder or
    pattern share it and are told apart by ``path``, in natural order. A line's number comes from the start of its split and its place there, so large files
    are still read in parallel.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    # Files are listed for each given path; all of them are one scan, and each line meets the places of its file.
    places = [(uri, i) for i, p in enumerate(given) for uri in map(_one_slash, spark.read.text(p).inputFiles())]
    names = [re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(uri)) for uri in dict.fromkeys(uri for uri, _ in places)]
    lines = spark.read.text(names or given).select(
        "value",
        F.regexp_replace("_metadata.file_path", _LOCAL, "$1:/").alias("_uri"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    lines = lines.join(spark.createDataFrame(places, "_uri string, file_no int"), "_uri").select(
        "value", F.regexp_replace(F.url_decode("_uri"), _SCHEME, "").alias("path"), "_block", "_row", "file_no"
    )
    return with_position(lines, ["file_no", "path"], ["_block", "_row"], "line_no", slice_rows=slice_rows).drop("_block", "_row")


def read_responses(
    spark: SparkSession, path: str | None = None, paths: str | Iterable[str] | None = None
) -> DataFrame:
    """Answers in file and line order; ``response`` may be a text or an object."""
    lines = numbered_lines(spark, response_paths(path, paths)).filter(F.trim("value") != "")
    rows = lines.select("file_no", "path", "line_no", F.from_json("value", schemas.RESPONSE, {"mode": "FAILFAST"}).alias("r"))
    is_object = F.col("response_raw").startswith("{") & F.try_parse_json("response_raw").isNotNull()
    part = lambda field: F.get_json_object("response_raw", f"$.{field}")
    question = F.from_json("r.question", schemas.QUESTION)
    return (
        rows.select(
            "file_no", "path", "line_no", "r.conv_id", question.alias("question"), F.col("r.response").alias("response_raw"),
            "r.post_processed_response",
        )
        .withColumn(
            "response_text",
            F.when(is_object & part("response").isNotNull(), part("response")).otherwise(F.col("response_raw")),
        )
        .withColumn("thoughts", F.when(is_object, F.from_json(part("thoughts"), "array<string>")))
        .withColumn("relevance", F.when(is_object, F.from_json(part("relevance_scores"), "map<string, double>")))
    )


def attempts(responses: DataFrame) -> DataFrame:
    """Columns the scorer needs, from read responses."""
    truth = F.col("question.question.correct_option.label")
    raw = F.col("question.question.correct_option.raw")
    return with_question_ids(
        responses.select(
            "file_no", "path", "line_no", F.col("question.qid_flat").alias("qid_flat"),
            F.col("question.question_category").alias("category"), F.col("question.video_id").alias("video_id"),
            truth.alias("truth"), F.col("question.question.num_options").alias("n_options"),
            F.coalesce(F.get_json_object(raw, "$"), raw).alias("raw_truth"),
            "response_text", "post_processed_response",
        )
    ).withColumn("ordinal", F.struct("file_no", natural_key(F.col("path")).alias("file_key"), "path", "line_no"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file: frame_idx as array, options as ordered array."""
    raw = spark.read.schema(schemas.QUESTION).json(path)
    frames = F.when(F.col("frame_idx").startswith("["), F.from_json("frame_idx", "array<int>")).otherwise(
        F.array(F.col("frame_idx").cast("int"))
    )
    options = F.array_sort(
        F.transform(
            F.map_entries("question.options"),
            lambda e: F.struct(
                e["key"].cast("int").alias("idx"), e["value"]["raw"].alias("raw_json"),
                e["value"]["label"].alias("label"), e["value"]["text"].alias("text"),
                e["value"]["full_text"].alias("full_text"),
            ),
        )
    )
    return raw.withColumns({"frame_idx": frames, "options": options})


def _yaml_rows(batches: Iterator[pd.DataFrame], build) -> Iterator[pd.DataFrame]:
    import yaml

    for pdf in batches:
        rows = [row for path, text in zip(pdf["path"], pdf["content"]) for row in build(path, yaml.safe_load(text))]
        yield pd.DataFrame(rows) if rows else pd.DataFrame()


def _read_yaml(spark: SparkSession, path: str, glob: str, build, schema: str) -> DataFrame:
    """Small YAML documents to rows, one task per group of files."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .load(path).select("path", F.decode("content", "UTF-8").alias("content"))
    )
    names = StructType.fromDDL(schema).names
    fill = lambda row: {name: row.get(name) for name in names}

    def convert(batches):
        for pdf in _yaml_rows(batches, lambda p, doc: map(fill, build(p, doc))):
            yield pdf if len(pdf) else pd.DataFrame(columns=names)

    return files.mapInPandas(convert, schema)


def _answer(raw) -> tuple[str, list[list[str]]]:
    """Kind and typed form of a raw answer."""
    if not isinstance(raw, list):
        return "str", [[str(raw)]]
    if raw and isinstance(raw[0], list):
        return "listoflist", [[str(x) for x in part] for part in raw]
    return "list", [[str(x) for x in raw]]


def _as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def flat_map(value) -> dict | None:
    """A map, or a list of maps of which later ones win."""
    if value is None:
        return None
    merged = {}
    for part in _as_list(value):
        merged.update(part)
    return {str(k): str(v) for k, v in merged.items()}


def _source_question(path: str, doc: dict) -> Iterator[dict]:
    answers = [_answer(option["raw"]) for option in doc["options"]]
    kinds = [kind for kind, typed in answers if typed != [["none"]]]
    params = doc.get("question_params") or {}
    yield {
        "question_no": path.rsplit("/", 1)[-1].split(".")[0],
        **{c: doc.get(c) for c in ("category", "name", "question_category", "template_type")},
        "video_id": str(doc["video_id"]),
        "frame_idx": [int(i) for i in _as_list(doc["frame_idx"])],
        "question_params": {k: [str(x) for x in _as_list(v)] for k, v in params.items()},
        "kind": kinds[0] if kinds else "str",
        "options": [typed for _, typed in answers],
        "correct_idx": [int(i) for i in _as_list(doc["correct_option"]["idx"])],
        "jumble_map": flat_map(doc.get("jumble_map")),
        "part_id_mapping": flat_map((doc.get("metadata") or {}).get("part_id_mapping")),
    }


def read_source_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question annotations, one YAML file each; order by ``question_order``."""
    rows = _read_yaml(spark, path, "*.yaml", _source_question, schemas.SOURCE_QUESTION)
    return rows.withColumn("question_order", F.col("question_no").try_cast("int"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Conversation templates: the messages of each YAML file in order."""

    def messages(file: str, doc: list) -> Iterator[dict]:
        name = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for pos, message in enumerate(doc):
            yield {"template": name, "pos": pos, **{c: message.get(c) for c in ("type", "tag", "content")}}

    return _read_yaml(spark, path, "*.yaml", messages, schemas.TEMPLATE)


def discover_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs with responses, described by their configuration.

    A run is a folder that has ``responses.jsonl`` and ``config.yaml``; folders
    named after the model that is configured elsewhere need no configuration.
    """
    run_of = F.element_at(F.split("path", "/"), -2)
    have = (
        spark.read.format("binaryFile").option("pathGlobFilter", "responses.jsonl")
        .option("recursiveFileLookup", "true").load(path).select(run_of.alias("run_id")).distinct()
    )

    def config(file: str, doc: dict) -> Iterator[dict]:
        run = file.rsplit("/", 2)[-2]
        model = doc.get("model") or {}
        yield {
            "run_id": run, "model_name": model.get("model_name", run),
            "model_key": model.get("_target_", "..").split(".")[-2],
            "setting": str(doc.get("media_cache_dir", run)).rstrip("/").rsplit("/", 1)[-1],
            "num_shuffles": int(doc.get("num_shuffles", 1) or 1), "seed": doc.get("seed"),
        }

    configured = _read_yaml(spark, path, "config.yaml", config, schemas.RUN)
    fixed = F.col("run_id").contains("videorefer")
    special = have.filter(fixed).select(
        "run_id", F.lit("videorefer").alias("model_name"), F.lit("videorefer").alias("model_key"),
        F.lit("videorefer_videorefer").alias("setting"), F.lit(1).alias("num_shuffles"),
        F.lit(None).cast("int").alias("seed"),
    )
    return configured.filter(~fixed).join(have, "run_id", "left_semi").unionByName(special)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Mask documents (frame -> part -> compressed mask), JSON files named after their video.

    A file is read in pieces that end where a frame's masks do (``}}``, which no mask contains), so a video of any length is
    cut into splits and a row holds a frame or two. Documents with white space between those brackets are read whole. Several documents may
    follow each other in a file.
    """
    pieces = spark.read.option("lineSep", "}}").text(path).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]+$", 1).alias("video_id"),
        F.regexp_replace("value", r"^[\s,{}]+", "").alias("piece"),
    ).filter("piece <> ''")
    count = lambda sign: F.length("piece") - F.length(F.replace("piece", F.lit(sign), F.lit("")))
    closed = F.concat(F.lit("{"), "piece", F.repeat(F.lit("}"), (count("{") - count("}") + 1).cast("int")))
    frames = pieces.select("video_id", F.from_json(closed, schemas.MASK_DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    return frames.select("video_id", F.explode("d").alias("frame", "parts")).select(
        "video_id", F.col("frame").cast("int").alias("frame_idx"), F.explode("parts").alias("part_id", "m")
    ).select(
        "video_id", "frame_idx", "part_id", F.col("m.size")[0].alias("h"), F.col("m.size")[1].alias("w"),
        decode_counts("m.counts").alias("runs"),
    )


def read_annotations(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Furniture annotations as three tables: part, part_edge (both ways), part_similar.

    A file is one document, or with ``lines`` every line is one, so that many furnitures need few files. A document may
    name its furniture (``furniture_id``); else the file's name does.
    """
    schema = """furniture_id string, annotated_semantics map<string, string>, annotated_part_graph map<string, array<string>>,
      annotated_similar_parts map<string, array<string>>"""
    named = F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]+$", 1)
    docs = spark.read.text(path, wholetext=not lines).select(named.alias("_file"), F.from_json("value", schema).alias("d"))
    docs = docs.select(F.coalesce("d.furniture_id", "_file").alias("furniture_id"), "d")
    part = docs.select("furniture_id", F.explode("d.annotated_semantics").alias("part_id", "semantics"))

    def links(column: str) -> DataFrame:
        one = docs.select("furniture_id", F.explode(column).alias("src", "near")).select(
            "furniture_id", "src", F.explode("near").alias("dst")
        )
        back = one.select("furniture_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
        return one.unionByName(back).distinct()

    return {
        "part": part,
        "part_edge": links("d.annotated_part_graph"),
        "part_similar": links("d.annotated_similar_parts"),
    }


def read_keyframes(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Key-frame times; the line number is the key-frame index, the file name the video."""
    lines = numbered_lines(spark, path)
    return lines.filter(F.trim("value") != "").select(
        F.regexp_extract("path", r"([^/]+?)(?:_frames_metadata)?\.[^./]+$", 1).alias("video_id"),
        F.col("line_no").alias("keyframe_idx"),
        F.from_json("value", "frame_time double")["frame_time"].alias("frame_time"),
    )


def read_manifest(spark: SparkSession, path: str, schema: str = schemas.MANIFEST) -> DataFrame:
    """Sub-sampled frame manifest; the sentinel -1 becomes null."""
    rows = spark.read.schema(schema).csv(path, header=True)
    nullable = [c for c in schemas.MANIFEST_NULLABLE if c in rows.columns]
    return rows.withColumns({c: F.when(F.col(c) != -1, F.col(c)) for c in nullable})


def read_jsonl_stream(
    spark: SparkSession, path: str, schema: str, skip_errors: bool = True, glob: str = "clip_*.jsonl",
    slice_rows: int | None = None,
) -> DataFrame:
    """A folder of ``clip_<n>.jsonl`` files as one stream in numeric file order.

    Adds file_no, local_line and global_idx, which count every line. A blank or
    broken line keeps its index but has a null ``record``; without
    ``skip_errors`` a broken line is an error. An empty folder is an error.
    """
    number = F.regexp_extract("path", r"_(\d+)\.[^/]*$", 1).cast("int")
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
    ).withColumn("file_no", number)
    if lines.isEmpty():
        raise FileNotFoundError(f"no {glob} with lines below {path}")
    per_file = with_position(lines, ["file_no"], ["_block", "_row"], "local_line", slice_rows=slice_rows)
    counts = per_file.groupBy("file_no").agg(F.count(F.lit(1)).alias("_n"))
    starts = ordered.lay_out(counts, [], ["file_no"]).scan(
        _start=ordered.running_sum(F.col("_n"), exclusive=True)
    ).rows().drop("_n")
    valid = F.try_parse_json("value").isNotNull()
    parsed = F.when(valid, F.from_json("value", schema))
    if not skip_errors:
        broken = F.raise_error(F.concat(F.lit("broken line: "), "value")).cast(StructType.fromDDL(schema))
        parsed = F.when(F.trim("value") == "", F.lit(None)).when(valid, F.from_json("value", schema)).otherwise(broken)
    return per_file.join(starts, "file_no").select(
        "file_no", "local_line", (F.col("_start") + F.col("local_line")).alias("global_idx"), parsed.alias("record")
    )


def read_events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Structured log files, flattened, with their line order."""
    return flatten_events(numbered_lines(spark, path).filter(F.trim("value") != ""))


def media_inventory(spark: SparkSession, path: str, glob: str = "*.mp4") -> DataFrame:
    """Media files below a folder: media_id (name without suffix), path, length. Contents stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.regexp_replace(name, r"(_frames_metadata)?\.[^.]+$", "").alias("media_id"), "path", "length"
    )


def read_agent_runs(spark: SparkSession, path: str) -> DataFrame:
    """Agent folders: the stored result and question info of every question, where present."""
    number = lambda: F.element_at(F.split("path", "/"), -2)

    def documents(name: str, column: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path)
        return files.select(number().alias("question_no"), F.decode("content", "UTF-8").alias(column))

    results, infos = documents("execution_result.json", "_r"), documents("qinfo.json", "_q")
    r = F.from_json("_r", "ok boolean, result string, error string")
    q = F.from_json("_q", schemas.QUESTION)
    abstain = F.filter(F.map_values("q.question.options"), lambda o: o["raw"] == "abstain")
    return results.join(infos, "question_no", "full_outer").withColumns({"r": r, "q": q}).select(
        "question_no", F.col("_r").isNotNull().alias("has_result"), F.col("_q").isNotNull().alias("has_qinfo"),
        F.coalesce("r.ok", F.lit(False)).alias("ok"), "r.result", "r.error",
        F.col("q.question.correct_option.label").alias("truth"), F.get(abstain, F.lit(0))["label"].alias("abstain_label"),
        F.col("q.video_id").alias("video_id"), F.col("q.question_category").alias("category"),
        F.col("q.furniture_name").alias("furniture_name"),
    )
