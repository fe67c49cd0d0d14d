"""Source, sink and streaming queries: rows are written to scratch and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise.functions import parse, rle
from markwise.operators import evaluate, sampling, score
from markwise.plans.catalog import Query, micros, rounded, table
from markwise.plans.runs import LOG_LINE, LOG_SQL_TEXT, TRANSITIONS_SQL
from markwise.plans.scoring import ATTEMPTS_SQL, LETTER, RESPONSES_SQL, RESPONSE, _letter_sql
from markwise.plans.timelines import FRAMES_SQL
from markwise.session import scratch_path, shared_dir
from markwise.sources import readers, sinks
from markwise.streaming import live


def _response_lines(spark, sf):
    """Conversation turns as answer records, with nested question objects."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(RESPONSE).alias("text"), F.expr(LETTER).alias("letter"))
    question = F.struct(
        F.concat_ws("/", F.lit("mating"), F.lit("1part"), F.lit("0"), F.lit("Chair"), F.lit("v"), F.col("conv_id"), F.col("turn")).alias("qid_flat"),
        F.lit("mating").alias("question_category"), F.concat(F.lit("v"), F.col("conv_id") % 7).alias("video_id"),
        F.struct(F.lit(5).alias("num_options"), F.struct(F.lit("A").alias("label")).alias("correct_option")).alias("question"),
    )
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("conv_id"), question.alias("question"),
        F.col("text").alias("response"), F.col("letter").alias("post_processed_response"),
    )


def source_responses(spark, sf):
    """Answers written as JSON lines, scanned, parsed and tallied."""
    path = scratch_path(spark, "responses")
    _response_lines(spark, sf).write.json(path)
    rows = readers.attempts(readers.read_responses(spark, path=path))
    rows = rows.withColumn("prediction", parse.parse_answer(F.col("response_text"), "openai_gpt"))
    return score.tally(rows, ["question_no"], first=["category", "n_options"], ordinal="ordinal")


SOURCE_RESPONSES_SQL = f"""{RESPONSES_SQL}
SELECT CAST(conv_id AS VARCHAR) AS question_no, count(*) FILTER (WHERE {_letter_sql('response')} = 'A') AS correct,
  count(*) FILTER (WHERE {_letter_sql('response')} <> 'A') AS incorrect, 'mating' AS category, 5 AS n_options
FROM r GROUP BY conv_id"""


def append_responses(spark, sf):
    """Answers appended in two steps by run, then read as one set."""
    path = scratch_path(spark, "ledger")
    rows = _response_lines(spark, sf).select(
        F.col("question.video_id").alias("run_id"), "conv_id", "post_processed_response"
    )
    first = F.col("post_processed_response") < "C"
    sinks.append_rows(rows.filter(first), path)
    sinks.append_rows(rows.filter(~first), path)
    back = spark.read.schema("conv_id string, post_processed_response string, run_id string").json(path)
    return back.groupBy("run_id", "post_processed_response").agg(F.count(F.lit(1)).alias("n"))


APPEND_SQL = f"""SELECT 'v' || (conv_id % 7) AS run_id, {LETTER} AS post_processed_response, count(*) AS n
FROM conversations GROUP BY ALL"""


def source_questions(spark, sf):
    """Parts as question documents, written as JSON lines and scanned: frames as a number or a list, options in their order."""
    option = lambda i, raw: F.struct(raw.alias("raw"), F.lit("ABC"[i]).alias("label"), F.concat(F.lit("t"), raw).alias("text"), F.concat(F.lit("ABC"[i] + ". t"), raw).alias("full_text"))
    raws = [F.col("p_size").cast("string"), F.col("p_brand"), F.lit("none")]
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("qid"), F.lit("mating").alias("question_category"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("["), "p_size", F.lit(", 7]"))).alias("frame_idx"),
        F.struct(F.create_map(*(x for i in (2, 0, 1) for x in (F.lit(str(i)), option(i, raws[i])))).alias("options")).alias("question"),
    )
    path = scratch_path(spark, "questions")
    rows.write.json(path)
    back = readers.read_questions(spark, path)
    return back.select("qid", F.array_join("frame_idx", ",").alias("frames"), F.inline("options"))


SOURCE_QUESTIONS_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS qid, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ',7' END AS frames,
  CAST(i AS INTEGER) AS idx, raw AS raw_json, chr(CAST(65 + i AS INTEGER)) AS label, 't' || raw AS text, chr(CAST(65 + i AS INTEGER)) || '. t' || raw AS full_text
FROM (SELECT p_partkey, p_size, i, CASE i WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_brand ELSE 'none' END AS raw FROM part, range(3) r(i))"""


def source_masks(spark, sf):
    """Orders as mask documents: a supplier is a video, an order a frame, a line a mask; written, scanned in pieces and decoded."""
    size, filled = F.lit(64), F.col("l_quantity").cast("int")
    runs = F.array(F.col("l_linenumber").cast("int"), filled, size * size - F.col("l_linenumber").cast("int") - filled)
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("video"), F.col("l_orderkey").cast("string").alias("frame"), F.col("l_linenumber").cast("string").alias("part"),
        "l_linenumber", filled.alias("filled"), rle.encode_counts(runs).alias("counts"),
    ).dropDuplicates(["video", "frame", "part"])
    mask = F.struct(F.array(size, size).alias("size"), "counts")
    frames = rows.groupBy("video", "frame").agg(F.map_from_entries(F.collect_list(F.struct("part", mask))).alias("parts"))
    # A video's frames are documents that follow each other: one for a whole video would be a row that grows with the table.
    documents = frames.select(F.to_json(F.create_map("frame", "parts")).alias("value"))
    path = scratch_path(spark, "masks")
    documents.write.text(path)
    back = readers.read_masks(spark, path)
    return back.groupBy("frame_idx").agg(
        F.count(F.lit(1)).alias("n_masks"), F.sum(F.element_at("runs", 1)).alias("start"), F.sum(F.size("runs")).alias("n_runs")
    )


SOURCE_MASKS_SQL = """
SELECT CAST(l_orderkey AS INTEGER) AS frame_idx, count(*) AS n_masks, CAST(sum(l_linenumber) AS BIGINT) AS start, count(*) * 3 AS n_runs
FROM (SELECT DISTINCT l_suppkey % 20 AS video, l_orderkey, l_linenumber FROM lineitem) GROUP BY ALL"""


def source_keyframes(spark, sf):
    """Event times as a key-frame file: the line number is the key-frame."""
    path = scratch_path(spark, "keyframes")
    times = table(spark, sf, "events").select("event_id", (micros(F.col("ts")) / 1e6).alias("frame_time"))
    shared_dir(spark)  # where the checkpoint goes: the one task that writes the file finds its rows sorted
    times.sort("event_id").checkpoint().coalesce(1).select(F.to_json(F.struct("frame_time")).alias("value")).write.text(path)
    return rounded(readers.read_keyframes(spark, path).select("keyframe_idx", "frame_time"))


SOURCE_KEYFRAMES_SQL = """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS keyframe_idx, round(epoch_us(ts) / 1e6, 6) AS frame_time FROM events"""


def report_file(spark, sf):
    """The score report in a fixed order of categories, written as CSV and read back."""
    wanted = ["micro_avg", "5-LOW", "1-URGENT", "3-MEDIUM"]
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_no"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("truth"),
        F.lit(3).alias("n_options"), (F.col("o_totalprice") > 150_000).cast("long").alias("correct"), (F.col("o_totalprice") <= 150_000).cast("long").alias("incorrect"),
    )
    report = score.score(rows, strict_schema=True, categories=wanted)
    path = scratch_path(spark, "report")
    sinks.write_report(report.select("report_order", "category", "n_questions", "strict"), path)
    back = spark.read.schema("report_order int, category string, n_questions long, strict double").csv(path, header=True)
    return rounded(back)


REPORT_SQL = """
WITH s AS (SELECT coalesce(o_orderpriority, 'micro_avg') AS category, count(*) AS n_questions, round(100.0 * avg((o_totalprice > 150000)::INT), 6) AS strict
  FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ()))
SELECT CAST(i AS INTEGER) AS report_order, category, n_questions, strict
FROM (VALUES (0, 'micro_avg'), (1, '5-LOW'), (2, '1-URGENT'), (3, '3-MEDIUM')) w(i, category) JOIN s USING (category)"""


def converted_files(spark, sf):
    """Converted questions and those with issues, written beside each other and read back."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("question_no"), "p_brand", "p_size")
    path = scratch_path(spark, "converted")
    sinks.write_converted(rows, rows.filter("p_size > 25").union(rows.filter("p_size > 40")), path)
    issues = spark.read.schema("question_no string").json(f"{path}/issues").withColumn("n_issues", F.lit(1))
    back = spark.read.schema(rows.schema).json(f"{path}/questions")
    return back.join(issues, "question_no", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))


CONVERTED_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS question_no, p_brand, p_size, (p_size > 25)::INT AS n_issues FROM part"


def manifest_csv(spark, sf):
    """Events as a frame manifest: written with -1 for null and read back."""
    rows = table(spark, sf, "events").select("user_id", "event_id", micros(F.col("ts")).alias("t"), "event_type")
    placed = sampling.with_position(rows, ["user_id"], ["t", "event_id"], "pos")
    prompt = F.col("event_type") == "purchase"
    manifest = placed.select(
        F.col("event_id").cast("int").alias("original_frame_idx"), F.col("pos").cast("int").alias("subsampled_frame_idx"),
        (F.col("t") / 1e6).alias("timestamp_sec"), prompt.alias("is_prompt_frame"),
        F.when(prompt, F.col("pos").cast("int")).alias("prompt_frame_idx"),
        F.when(prompt, F.col("event_id").cast("int")).alias("keyframe_idx"),
        F.when(prompt, F.col("t") / 1e6).alias("prompt_frame_timestamp_sec"),
    )
    path = scratch_path(spark, "manifest")
    sinks.write_manifest_csv(manifest, path)
    return rounded(readers.read_manifest(spark, path))


MANIFEST_CSV_SQL = f"""
WITH {FRAMES_SQL}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS INTEGER) AS pos,
  event_type = 'purchase' AS b FROM frames)
SELECT CAST(event_id AS INTEGER) AS original_frame_idx, pos AS subsampled_frame_idx, round(t / 1e6, 6) AS timestamp_sec,
  b AS is_prompt_frame, CASE WHEN b THEN pos END AS prompt_frame_idx, CASE WHEN b THEN CAST(event_id AS INTEGER) END AS keyframe_idx,
  CASE WHEN b THEN round(t / 1e6, 6) END AS prompt_frame_timestamp_sec FROM p"""


def track_files(spark, sf):
    """Events as a track written by user and clip of 16 frames; rows per stored clip."""
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", micros(F.col("ts")).alias("t"), F.lit(0).alias("prompt_frame_idx")
    )
    placed = sampling.with_position(rows, ["user_id"], ["t", "event_id"], "frame_idx")
    path = scratch_path(spark, "tracks")
    sinks.write_tracks(
        placed.select(F.expr("user_id div 100").alias("video_id"), "prompt_frame_idx", "frame_idx", "event_id"), path, 16
    )
    back = spark.read.parquet(path)
    return back.groupBy(F.col("video_id").cast("long").alias("video_id"), F.col("clip_idx").cast("long").alias("clip_idx")).agg(
        F.count(F.lit(1)).alias("n"), F.max("frame_idx").alias("last_frame")
    )


TRACK_SQL = f"""
WITH {FRAMES_SQL}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS f FROM frames)
SELECT user_id // 100 AS video_id, f // 16 AS clip_idx, count(*) AS n, max(f) AS last_frame FROM p GROUP BY ALL"""


def log_files(spark, sf):
    """Log lines written as text, scanned with their line order and flattened."""
    path = scratch_path(spark, "log")
    table(spark, sf, "events").select(F.expr(LOG_LINE).alias("value")).write.text(path)
    flat = readers.read_events(spark, path)
    return flat.select(
        "stage", "action", "timestamp", "message", "file_path", "mime", F.get_json_object("meta", "$.k").cast("long").alias("k")
    )


LOG_FILES_SQL = f"SELECT * EXCLUDE (event_id, user_id) FROM ({LOG_SQL_TEXT})"


# --- whole evaluations --------------------------------------------------------------------

KINDS = "substr('temporal_ord temporal_loc tracking     mating       other        ', CAST(conv_id % 5 AS INT) * 13 + 1, 13)"
TRUTHS = "substr('ABC', CAST(conv_id % 3 AS INT) + 1, 1)"


def _evaluated(binary):
    def build(spark, sf):
        rows = table(spark, sf, "conversations")
        rows = rows.select("conv_id", "turn", F.expr(RESPONSE).alias("text"), F.expr(LETTER).alias("letter"), F.trim(F.expr(KINDS)).alias("kind"), F.expr(TRUTHS).alias("truth"))
        correct = F.struct(F.col("truth").alias("label"), F.when(F.col("conv_id") % 2 == 0, "Yes").otherwise("No").alias("raw"))
        question = F.struct(
            F.concat_ws("/", F.lit("q"), "conv_id", "turn").alias("qid_flat"), F.col("kind").alias("question_category"),
            F.struct((F.lit(2) + F.col("conv_id") % 4).alias("num_options"), correct.alias("correct_option")).alias("question"),
        )
        lines = rows.select(
            "turn", F.concat_ws("-", "conv_id", "turn").alias("conv_id"), question.alias("question"), F.col("text").alias("response"),
            F.col("letter").alias("post_processed_response"),
        )
        paths = [scratch_path(spark, "answers") for _ in range(2)]
        for k, path in enumerate(paths):
            lines.filter(F.col("turn") % 2 == k).drop("turn").write.json(path)
        if binary:
            return rounded(evaluate.evaluate(spark, "gemini", paths=paths, n_shuffles=1, binary=True))
        return rounded(evaluate.evaluate(spark, "openai_gpt", paths=",".join(paths), n_shuffles=2))

    return build


def _evaluate_sql(label, shuffles, kind, order):
    places = ", ".join(f"({i}, '{c}')" for i, c in enumerate(order))
    return f"""{RESPONSES_SQL},
a AS (SELECT conv_id, {label} AS label, {kind} AS category, {TRUTHS} AS truth, 2 + conv_id % 4 AS n_options FROM r WHERE turn < {shuffles}),
q AS (SELECT conv_id, category, truth, n_options, count(*) FILTER (WHERE label = truth) AS c, count(*) FILTER (WHERE label <> truth) AS w FROM a GROUP BY ALL),
b AS (SELECT * FROM q UNION ALL SELECT conv_id, 'micro_avg', truth, n_options, c, w FROM q),
f AS (SELECT category, max(n) AS most FROM (SELECT category, truth, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL),
o(report_order, category) AS (VALUES {places})
SELECT category, count(*) AS n_questions, round(100.0 * count(*) FILTER (WHERE w = 0) / count(*), 6) AS strict,
  round(100.0 * count(*) FILTER (WHERE c > w) / count(*), 6) AS majority, round(100.0 * count(*) FILTER (WHERE c > 0) / count(*), 6) AS "any",
  round(avg(100.0 / n_options), 6) AS random_chance, round(100.0 * any_value(most) / count(*), 6) AS freq_chance, report_order
FROM b JOIN f USING (category) JOIN o USING (category) GROUP BY category, report_order ORDER BY report_order"""


EVALUATE_SQL = _evaluate_sql(_letter_sql("response"), 2, f"trim({KINDS})", evaluate.CATEGORIES)
EVALUATE_BINARY_SQL = _evaluate_sql(LETTER, 1, "CASE WHEN conv_id % 2 = 0 THEN 'yes' ELSE 'no' END", evaluate.BINARY_CATEGORIES)


def source_annotations(spark, sf):
    """Suppliers as annotated furniture: their parts, and links from a part to the orders that hold it; written as documents and scanned."""
    part = F.concat_ws("-", "l_suppkey", "l_partkey")
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", part.alias("part"), F.concat_ws("-", "l_suppkey", F.col("l_partkey") % 5).alias("near"),
        F.concat(F.lit("role "), F.col("l_partkey") % 7).alias("role"),
    )
    parts = rows.groupBy("l_suppkey", "part").agg(F.first("role").alias("role"), F.collect_set("near").alias("near"))
    pairs = lambda c: F.map_from_entries(F.collect_list(F.struct("part", c)))
    documents = parts.groupBy("l_suppkey").agg(F.to_json(F.struct(
        F.col("l_suppkey").cast("string").alias("furniture_id"), pairs("role").alias("annotated_semantics"), pairs("near").alias("annotated_part_graph"), pairs("near").alias("annotated_similar_parts"),
    )).alias("value"))
    path = scratch_path(spark, "furniture")
    documents.select("value").write.text(path)
    found = readers.read_annotations(spark, path, lines=True)
    return found["part_edge"].select("src", "dst").join(found["part"].select(F.col("part_id").alias("src"), "semantics"), "src", "left")


SOURCE_ANNOTATIONS_SQL = """
WITH l AS (SELECT DISTINCT l_suppkey || '-' || l_partkey AS part, l_suppkey || '-' || (l_partkey % 5) AS near, 'role ' || (l_partkey % 7) AS role FROM lineitem),
e AS (SELECT part AS src, near AS dst FROM l UNION SELECT near, part FROM l)
SELECT src, dst, role AS semantics FROM e LEFT JOIN (SELECT DISTINCT part, role FROM l) p ON p.part = e.src"""


def subsample_valid(spark, sf):
    """Every third event of a user; events without much value use up their place. Kept events are counted, so each has a new index."""
    rows = sampling.with_position(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])
    kept = sampling.subsample(rows, 3, valid=F.col("value") > 20)
    return sampling.with_position(kept, ["user_id"], ["global_idx"], "idx", size="n").select("user_id", "event_id", "global_idx", "idx", "n")


SUBSAMPLE_VALID_SQL = """
WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS global_idx FROM events)
SELECT user_id, event_id, global_idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n
FROM p WHERE global_idx % 3 = 0 AND value > 20"""


def answer_objects(spark, sf):
    """The JSON object with the answer inside each turn's text, trailing commas removed."""
    said = F.expr(f"""concat('About ', role, ': {{"turn": ', turn, ', "answer": "', {LETTER}, '",}}', ' I think')""")
    found = parse.json_object_with_answer(said)
    return table(spark, sf, "conversations").select("conv_id", "turn", found.alias("found"))


ANSWER_OBJECTS_SQL = f"""SELECT conv_id, turn, '{{"turn": ' || turn || ', "answer": "' || {LETTER} || '"}}' AS found FROM conversations"""


# --- streaming ----------------------------------------------------------------------------


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stream_scoreboard(spark, sf):
    """Line items as answers that arrive; repeats of (order, line) count once."""
    lines = _stream(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_no"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_returnflag").alias("conv_id"),
        F.col("l_returnflag").alias("prediction"),
        F.expr("CASE l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END").alias("truth"),
    )
    path = live.run_to_end(spark, lambda p, c: live.scoreboard_stream(lines, p, c, dims=()), "scoreboard")
    return live.scoreboard(spark, path, dims=())


STREAM_SCORE_SQL = """
WITH d AS (SELECT DISTINCT l_orderkey AS question_no, l_linenumber, l_returnflag,
  CASE l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS truth FROM lineitem)
SELECT question_no, count(*) FILTER (WHERE l_returnflag = truth) AS correct,
  count(*) FILTER (WHERE l_returnflag <> truth) AS incorrect FROM d GROUP BY question_no"""


def _event_stream(spark, sf):
    return _stream(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"),
        F.expr("CASE WHEN value > 50 THEN props ELSE '' END").alias("action"),
        F.expr("concat(event_type, ' ', repeat(props, 8))").alias("message"),
    )


def _windows(slide):
    def build(spark, sf):
        events = _event_stream(spark, sf)
        path = live.run_to_end(
            spark, lambda p, c: live.window_stream(events, p, c, length="1 hour", slide=slide), "windows"
        )
        out = live.latest(spark, path, ["window_start", "stage"])
        return out.select(F.unix_micros("window_start").alias("window_start"), "stage", "n")

    return build


WINDOW_SQL = """
SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, event_type AS stage, count(*) AS n
FROM events GROUP BY ALL"""
SLIDING_SQL = """
SELECT CAST(epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) - k * 1800000000 AS BIGINT) AS window_start, event_type AS stage,
  count(*) AS n FROM events, range(2) r(k) GROUP BY ALL"""


def stream_transitions(spark, sf):
    events = _event_stream(spark, sf).withColumn("t", F.unix_micros("ts"))
    path = live.run_to_end(
        spark, lambda p, c: live.transition_stream(events, p, c, order=["t", "event_id"]), "transitions"
    )
    moves = spark.read.parquet(f"{path}/moves")
    return moves.select(F.col("run_id").alias("user_id"), "event_id", "t", "from_stage", "to_stage", "label")


def stream_late_transitions(spark, sf):
    """Events that come twice, each time up to eight minutes out of order, in six files read one by one."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("event_type").alias("stage"), F.expr("CASE WHEN value > 50 THEN props ELSE '' END").alias("action"),
        F.expr("concat(event_type, ' ', repeat(props, 8))").alias("message"),
    )
    low, high = events.agg(F.min("t"), F.max("t")).first()
    delay = lambda turn: F.pmod(F.xxhash64("event_id", F.lit(turn)), F.lit(480_000_000))
    comes = events.withColumn("comes", F.explode(F.array(*(F.col("t") + delay(turn) for turn in range(2)))))
    comes = comes.withColumn("file", F.least(F.lit(5), F.floor((F.col("comes") - low) * 6 / (high - low + 1)))).drop("comes")
    path = scratch_path(spark, "late")
    for file in range(6):
        comes.filter(F.col("file") == file).drop("file").coalesce(1).write.parquet(f"{path}/{file}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    out = live.run_to_end(spark, lambda p, c: live.ordered_transition_stream(stream, p, c, order=["t", "event_id"], keep_hours=24 * 365 * 100), "ordered")
    return spark.read.parquet(out).select(F.col("run_id").alias("user_id"), "event_id", "t", "from_stage", "to_stage", "label")


#: Ten minutes before the last event, in whole milliseconds.
LATE_SQL = f"""SELECT * FROM ({TRANSITIONS_SQL})
WHERE t <= (SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 FROM events)"""


def stream_sessions(spark, sf):
    """Sessions of each user that the watermark has closed."""
    events = _event_stream(spark, sf)
    path = live.run_to_end(spark, lambda p, c: live.session_stream(events, p, c), "sessions")
    rows = spark.read.parquet(path)
    return rows.select(
        F.col("run_id").alias("user_id"), F.unix_micros("session_start").alias("session_start"),
        F.unix_micros("session_end").alias("session_end"), "n",
    )


SESSIONS_SQL = """
WITH s AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
g AS (SELECT *, sum((p IS NULL OR t - p >= 21600000000)::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM s),
r AS (SELECT user_id, min(t) AS session_start, max(t) + 21600000000 AS session_end, count(*) AS n FROM g GROUP BY user_id, k)
SELECT * FROM r WHERE session_end <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)"""

QUERIES = {
    "source_responses": Query(source_responses, SOURCE_RESPONSES_SQL),
    "append_responses": Query(append_responses, APPEND_SQL),
    "manifest_csv": Query(manifest_csv, MANIFEST_CSV_SQL),
    "track_files": Query(track_files, TRACK_SQL),
    "log_files": Query(log_files, LOG_FILES_SQL),
    "source_questions": Query(source_questions, SOURCE_QUESTIONS_SQL),
    "source_masks": Query(source_masks, SOURCE_MASKS_SQL),
    "source_keyframes": Query(source_keyframes, SOURCE_KEYFRAMES_SQL),
    "report_file": Query(report_file, REPORT_SQL),
    "evaluate_files": Query(_evaluated(False), EVALUATE_SQL),
    "evaluate_binary": Query(_evaluated(True), EVALUATE_BINARY_SQL),
    "source_annotations": Query(source_annotations, SOURCE_ANNOTATIONS_SQL),
    "subsample_valid": Query(subsample_valid, SUBSAMPLE_VALID_SQL),
    "answer_objects": Query(answer_objects, ANSWER_OBJECTS_SQL),
    "converted_files": Query(converted_files, CONVERTED_SQL),
    "stream_scoreboard": Query(stream_scoreboard, STREAM_SCORE_SQL),
    "stream_windows": Query(_windows(None), WINDOW_SQL),
    "stream_sliding_windows": Query(_windows("30 minutes"), SLIDING_SQL),
    "stream_transitions": Query(stream_transitions, TRANSITIONS_SQL),
    "stream_late_transitions": Query(stream_late_transitions, LATE_SQL),
    "stream_sessions": Query(stream_sessions, SESSIONS_SQL),
}
