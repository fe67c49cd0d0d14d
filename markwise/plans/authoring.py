"""Question construction, rendering and conversion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise.functions import ids, text
from markwise.operators import convert, media, questions, render
from markwise.operators.sampling import with_position
from markwise.operators.score import with_question_ids
from markwise.plans.catalog import Query, micros, table
from markwise.plans.shapes import FRAME, GRAPH_SQL, edges, frame_parts
from markwise.plans.timelines import FRAMES_SQL
from markwise.session import spread

# --- generators over the part graph of the nations -------------------------------------

TWO_PARTS = "Are Part ' || x || ' and Part ' || y || ' connected in the fully-assembled furniture?"


def make_2part(spark, sf):
    out = questions.make_2part(frame_parts(spark, sf), edges(spark, sf), FRAME, "size_h2l", 3)
    checked = questions.validate_questions(out)
    return checked.select(
        "frame_idx", "qid", "qstr", F.col("correct_option.label").alias("label"),
        F.col("correct_option.text").alias("answer"), F.size("violations").alias("n_violations"),
    )


MAKE_2PART_SQL = f"""
WITH {GRAPH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY area DESC, k) AS rk FROM fp),
p AS (SELECT a.frame_idx, a.part_id AS pa, b.part_id AS pb,
    'mating/2parts/' || a.frame_idx || '/' || a.part_id || '/' || b.part_id AS qid,
    EXISTS (SELECT 1 FROM edges e WHERE e.src = a.part_id AND e.dst = b.part_id) AS edge
  FROM r a JOIN r b ON b.frame_idx = a.frame_idx AND a.rk < b.rk
  QUALIFY row_number() OVER (PARTITION BY a.frame_idx ORDER BY a.area + b.area DESC, a.rk, b.rk) <= 3),
h AS (SELECT *, substr(md5('42|swap|' || qid), 1, 1) < '8' AS swap,
    md5('42|s|' || qid || '|"Yes"') < md5('42|s|' || qid || '|"No"') AS yes_first FROM p),
q AS (SELECT *, CASE WHEN swap THEN pb ELSE pa END AS x, CASE WHEN swap THEN pa ELSE pb END AS y FROM h)
SELECT frame_idx, qid, '{TWO_PARTS}' || chr(10) || 'Options:' || chr(10)
    || CASE WHEN yes_first THEN 'A. Yes' || chr(10) || 'B. No' ELSE 'A. No' || chr(10) || 'B. Yes' END || chr(10) AS qstr,
  CASE WHEN edge = yes_first THEN 'A' ELSE 'B' END AS label, CASE WHEN edge THEN 'Yes' ELSE 'No' END AS answer,
  0 AS n_violations FROM q"""


def two_part_options(spark, sf):
    """Every option of yes/no questions about a frame, one row each, with the choice to abstain."""
    out = questions.make_2part(
        frame_parts(spark, sf), edges(spark, sf), FRAME, "size_h2l", 3, template_type="2parts_frame", add_abstain=True
    )
    rows = out.select("qid", "num_options", F.inline("options"))
    return rows.select("qid", "num_options", "idx", "label", "text", "full_text", "raw_json", "is_correct", F.array_join("answers", ",").alias("answers"))


TWO_PART_OPTIONS_SQL = f"""
WITH {GRAPH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY area DESC, k) AS rk FROM fp),
p AS (SELECT 'mating/2parts_frame/' || a.frame_idx || '/' || a.part_id || '/' || b.part_id AS qid,
    EXISTS (SELECT 1 FROM edges e WHERE e.src = a.part_id AND e.dst = b.part_id) AS edge
  FROM r a JOIN r b ON b.frame_idx = a.frame_idx AND a.rk < b.rk
  QUALIFY row_number() OVER (PARTITION BY a.frame_idx ORDER BY a.area + b.area DESC, a.rk, b.rk) <= 3),
h AS (SELECT *, md5('42|s|' || qid || '|"Yes"') < md5('42|s|' || qid || '|"No"') AS yes_first FROM p),
o AS (SELECT qid, idx, edge, CASE WHEN idx = 2 THEN NULL WHEN (idx = 0) = yes_first THEN 'Yes' ELSE 'No' END AS word FROM h, range(3) t(idx))
SELECT qid, 3 AS num_options, CAST(idx AS INTEGER) AS idx, chr(CAST(65 + idx AS INTEGER)) AS label,
  coalesce(word, 'Not sure') AS text, chr(CAST(65 + idx AS INTEGER)) || '. ' || coalesce(word, 'Not sure') AS full_text,
  coalesce('"' || lower(word) || '"', '"abstain"') AS raw_json,
  coalesce((word = 'Yes') = edge, false) AS is_correct, coalesce('"' || word || '"', '') AS answers FROM o"""


def make_1part(spark, sf):
    out = questions.make_1part(
        frame_parts(spark, sf), edges(spark, sf), FRAME, "subasm", 3, randomize_options=False
    )
    checked = questions.validate_questions(out)
    return checked.select(
        "frame_idx", "part_id", "raw_qstr", F.size("correct").alias("n_correct"),
        F.size("incorrect").alias("n_incorrect"), "num_options", F.size("violations").alias("n_violations"),
        (F.col("correct_option.raw_json") == questions.NONE).alias("none_is_right"),
        F.size("correct_option.answers").alias("n_named"),
    )


MAKE_1PART_SQL = f"""
WITH {GRAPH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY subasm_size, k) AS rk FROM fp),
c AS (SELECT a.frame_idx, a.part_id, CAST(count(e.src) AS INTEGER) AS n_correct,
    CAST(count(*) - 1 - count(e.src) AS INTEGER) AS n_incorrect
  FROM r a JOIN fp b ON b.frame_idx = a.frame_idx LEFT JOIN edges e ON e.src = a.part_id AND e.dst = b.part_id
  WHERE a.rk <= 3 GROUP BY ALL)
SELECT frame_idx, part_id,
  'Out of the given options, which part will Part ' || part_id || ' be directly connected to during the assembly video?' AS raw_qstr,
  n_correct, n_incorrect, 4 AS num_options, 0 AS n_violations, n_correct = 0 AS none_is_right,
  CASE WHEN n_correct <= 1 THEN n_correct ELSE least(n_correct, 3) END AS n_named
FROM c WHERE n_correct + n_incorrect >= 2"""


def find_edges(spark, sf):
    out = questions.make_find_edges(
        frame_parts(spark, sf), edges(spark, sf), FRAME, randomize_options=False
    )
    checked = questions.validate_questions(out)
    return checked.select(
        "frame_idx", F.size("correct").alias("n_correct"), F.size("incorrect").alias("n_incorrect"),
        "num_options", F.size("violations").alias("n_violations"),
        F.size("correct_option.answers").alias("n_named"),
    )


FIND_EDGES_SQL = f"""
WITH {GRAPH_SQL}, c AS (
  SELECT a.frame_idx, CAST(count(e.src) AS INTEGER) AS n_correct,
    CAST(count(*) - count(e.src) AS INTEGER) AS n_incorrect
  FROM fp a JOIN fp b ON b.frame_idx = a.frame_idx AND a.k < b.k
  LEFT JOIN edges e ON e.src = a.part_id AND e.dst = b.part_id GROUP BY ALL)
SELECT frame_idx, n_correct, n_incorrect, 4 AS num_options, 0 AS n_violations,
  CASE WHEN n_correct <= 1 THEN n_correct ELSE least(n_correct, 3) END AS n_named
FROM c WHERE n_correct + n_incorrect >= 2"""


def _roles(spark, sf):
    """Nations with a role named after their region; supplier names give the second role."""
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")
    )
    return nation.select(
        F.lit("world").alias("furniture_id"), F.col("n_nationkey").cast("string").alias("part_id"),
        F.expr("concat('Left ', r_name, ' leg, rear  frame ', n_nationkey % 4)").alias("semantics"),
    )


ROLES_SQL = r"""roles AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS part_id, lower(r_name) || ' leg' AS role FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'frame ' || (n_nationkey % 4) FROM nation)"""


def role_index(spark, sf):
    """Roles of the parts by name, type and brand, positional words erased."""
    parts = table(spark, sf, "part").select(
        F.col("p_brand").alias("furniture_id"), F.col("p_partkey").alias("part_id"),
        F.expr("concat('Front ', p_name, ',  left rear ', p_type, ' , ', p_name)").alias("semantics"),
    )
    return questions.role_index(parts, ["furniture_id"])


ROLE_SQL = """SELECT DISTINCT p_brand AS furniture_id, p_partkey AS part_id, lower(unnest([p_name, p_type])) AS role FROM part"""


def role_sizes(spark, sf):
    """Mean line count of the suppliers' nations per order and role."""
    parts = frame_parts(spark, sf).select("frame_idx", "part_id", "subasm_size")
    roles = questions.role_index(_roles(spark, sf), ["furniture_id"]).select("part_id", "role")
    return questions.role_sizes(roles, parts, ["frame_idx"]).withColumn("mean_size", F.round("mean_size", 6))


ROLE_SIZES_SQL = f"""WITH {GRAPH_SQL}, {ROLES_SQL}
SELECT frame_idx, role, round(avg(subasm_size), 6) AS mean_size, min(subasm_size) AS min_size, count(*) AS n_parts
FROM fp JOIN roles USING (part_id) GROUP BY ALL"""


def role_questions(spark, sf):
    roles = questions.role_index(_roles(spark, sf), ["furniture_id"])
    out = questions.make_role_questions(
        roles, frame_parts(spark, sf), FRAME, category=F.lit("Atlas"), randomize_options=False
    )
    checked = questions.validate_questions(out)
    return checked.select(
        "frame_idx", "role", "raw_qstr", F.size("correct").alias("n_correct"),
        F.size("incorrect").alias("n_incorrect"), "num_options", F.size("violations").alias("n_violations"),
    )


ROLE_QUESTIONS_SQL = f"""
WITH {GRAPH_SQL}, {ROLES_SQL},
big AS (SELECT frame_idx, count(*) AS n FROM fp GROUP BY 1 HAVING count(*) > 2),
m AS (SELECT frame_idx, role, avg(subasm_size) AS mean, min(subasm_size) AS least FROM fp JOIN roles USING (part_id) GROUP BY ALL),
c AS (SELECT b.frame_idx, n, role, least FROM big b JOIN (SELECT DISTINCT role FROM roles) ON true
  LEFT JOIN m USING (frame_idx, role)
  QUALIFY row_number() OVER (PARTITION BY b.frame_idx ORDER BY coalesce(mean, 0), role) <= 3),
s AS (SELECT c.frame_idx, c.role, n, CAST(count(f.part_id) AS INTEGER) AS n_correct FROM c
  LEFT JOIN (SELECT * FROM fp JOIN roles USING (part_id)) f
    ON f.frame_idx = c.frame_idx AND f.role = c.role AND f.subasm_size = c.least GROUP BY ALL)
SELECT frame_idx, role, 'Out of the given options, which part will form the ' || role || ' of the fully-assembled Atlas?' AS raw_qstr,
  n_correct, CAST(n - n_correct AS INTEGER) AS n_incorrect, 4 AS num_options, 0 AS n_violations FROM s"""

# --- annotated questions ------------------------------------------------------------------


def annotated(spark, sf):
    """A part is a question: which of four neighbours of its size comes last?"""
    four = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.array(F.array(
        (F.col("p_size") * 4 + i).cast("string"))))
    return spread(table(spark, sf, "part"), "p_partkey").select(
        F.format_string("%06d", "p_partkey").alias("question_no"), F.col("p_brand").alias("category"),
        F.col("p_type").alias("name"), F.col("p_brand").alias("video_id"),
        F.array(F.col("p_size").cast("int")).alias("frame_idx"), F.lit("temporal_loc").alias("question_category"),
        F.lit("1part_order_last").alias("template_type"),
        F.create_map(F.lit("query_part"), F.array(F.col("p_partkey").cast("string"))).alias("question_params"),
        F.lit("str").alias("kind"), four.alias("options"), F.array((F.col("p_partkey") % 4).cast("int")).alias("correct_idx"),
    )


def annotated_questions(spark, sf):
    out = questions.validate_questions(questions.to_questions(annotated(spark, sf)))
    return out.select(
        "question_no", "qid", "qid_flat", "prompt_img_fn", "qstr", F.col("correct_option.label").alias("label"),
        F.col("correct_option.text").alias("answer"), F.size("violations").alias("n_violations"),
    )


ANNOTATED_SQL = """
WITH q AS (SELECT *, printf('%06d', p_partkey) AS question_no,
    'temporal_loc/1part_order_last/0/' || p_brand || '/' || p_brand || '/' || printf('%06d', p_partkey) AS qid_flat FROM part),
o AS (SELECT *, sha256(qid_flat) AS qid, list_sort(list_transform(range(4), lambda i: struct_pack(
      h := md5('42|s|' || sha256(qid_flat) || '|"' || (p_size * 4 + i) || '"'), v := p_size * 4 + i))) AS opts FROM q),
t AS (SELECT *, list_position(list_transform(opts, lambda s: s.v), p_size * 4 + p_partkey % 4) AS pos FROM o)
SELECT question_no, qid, qid_flat, 'prompt_' || printf('%03d', p_size) || '_q' || question_no || '.jpg' AS prompt_img_fn,
  'Which highlighted part is the last to connect (brought in direct physical contact) to Part ' || p_partkey
    || ' in the video?' || chr(10) || 'Options:' || chr(10) || list_aggregate(list_transform(opts,
      lambda s, i: substr('ABCD', i, 1) || '. Part ' || s.v || chr(10)), 'string_agg', '') AS qstr,
  substr('ABCD', pos, 1) AS label, 'Part ' || (p_size * 4 + p_partkey % 4) AS answer, 0 AS n_violations FROM t"""


def validate_broken(spark, sf):
    """Every question with its stored answer moved to the option after it: what the checks say."""
    good = questions.to_questions(annotated(spark, sf))
    moved = F.get("options", (F.col("correct_option.idx") + 1) % F.col("num_options"))
    out = questions.validate_questions(good.withColumn("correct_option", moved))
    valid, quarantined = questions.split_valid(out)
    return quarantined.select("question_no", F.array_join("violations", ",").alias("violations"))


BROKEN_SQL = "SELECT printf('%06d', p_partkey) AS question_no, 'one_other_correct,truth_not_correct' AS violations FROM part"


def shuffle_options(spark, sf):
    source = table(spark, sf, "part").select(
        "p_partkey", F.array("p_brand", "p_type", F.concat(F.lit("x "), "p_name")).alias("options"),
        F.array((F.col("p_partkey") % 3).cast("int"), F.lit(0)).alias("correct_idx"),
    )
    out = questions.shuffle_options(source, 6)
    return out.select(
        "p_partkey", "shuffle_idx", F.array_join("options", "|").alias("options"),
        F.array_join("correct_idx", ",").alias("correct_idx"),
    )


SHUFFLE_SQL = """
WITH perms(shuffle_idx, a, b, c) AS (VALUES (0,0,1,2),(1,0,2,1),(2,1,0,2),(3,1,2,0),(4,2,0,1),(5,2,1,0)),
p AS (SELECT p_partkey, [p_brand, p_type, 'x ' || p_name] AS o FROM part)
SELECT p_partkey, CAST(shuffle_idx AS BIGINT) AS shuffle_idx, o[a+1] || '|' || o[b+1] || '|' || o[c+1] AS options,
  (list_position([a, b, c], CAST(p_partkey % 3 AS INTEGER)) - 1) || ',' || (list_position([a, b, c], 0) - 1) AS correct_idx
FROM p, perms"""


def shuffled_questions(spark, sf):
    """Two option orders per annotated question; ids carry the shuffle number."""
    rows = questions.shuffle_options(annotated(spark, sf), 2)
    out = questions.to_questions(rows)
    return out.select("question_no", "shuffle_idx", "qid_flat", "qid", F.col("correct_option.raw_json").alias("truth"))


SHUFFLED_SQL = """
WITH q AS (SELECT p_size, p_partkey, CAST(s AS BIGINT) AS shuffle_idx, printf('%06d', p_partkey) AS question_no FROM part, range(2) r(s)),
f AS (SELECT *, 'temporal_loc/1part_order_last/0/' || p_brand || '/' || p_brand || '/' || question_no || '/' || shuffle_idx AS qid_flat
  FROM q JOIN (SELECT p_partkey, p_brand FROM part) USING (p_partkey))
SELECT question_no, shuffle_idx, qid_flat, sha256(qid_flat) AS qid, '"' || (p_size * 4 + p_partkey % 4) || '"' AS truth FROM f"""


def scrambled_text(spark, sf):
    """Part ids permuted in the text and the masks of every question, for two seeds."""
    q = table(spark, sf, "part").select(
        F.col("p_partkey").alias("question_no"),
        F.concat(F.lit("Is Part "), "p_partkey", F.lit(" on Part "), "p_size", F.lit(", not "), "p_size", F.lit("?")).alias("qstr"),
    )
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("question_no"),
        F.explode(F.array_distinct(F.array(F.col("p_partkey").cast("string"), F.col("p_size").cast("string")))).alias("part_id"),
    )
    mapping = rows.withColumn("seed", F.explode(F.array(F.lit(101), F.lit(202)))).withColumn(
        "display_id", (F.col("part_id").cast("long") + F.col("seed")).cast("string")
    )
    text_rows, mask_rows = questions.scramble(q, rows, mapping)
    shown = mask_rows.groupBy("seed", "question_no").agg(F.sum(F.col("part_id").cast("long")).alias("id_sum"))
    return text_rows.join(shown, ["seed", "question_no"])


SCRAMBLE_SQL = """
SELECT seed, p_partkey AS question_no, 'Is Part ' || (p_partkey + seed) || ' on Part ' || (p_size + seed) || ', not ' || p_size || '?' AS qstr,
  CAST(CASE WHEN p_partkey = p_size THEN p_partkey + seed ELSE p_partkey + p_size + 2 * seed END AS BIGINT) AS id_sum
FROM part, (VALUES (101), (202)) s(seed)"""

# --- rendering ------------------------------------------------------------------------------

RECIPE = {"pipeline": ["video", "visual_prompt", "separate"]}


def render_conversation(spark, sf):
    """Document questions rendered with templates taken from the first turns of the conversations."""
    first = table(spark, sf, "conversations").groupBy("role").agg(F.min_by("text", F.struct("conv_id", "turn")).alias("content"))
    shape = F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(a).alias("type"), F.lit(b).alias("tag"))
        for i, (a, b) in enumerate((("video", "video"), ("image", "visual_prompt"), ("text", "task_instruction"), ("text", "question")))
    ]))
    templates = first.select(F.col("role").alias("template"), "content", shape.alias("m")).select(
        "template", "m.pos", "m.type", "m.tag",
        F.when(F.col("m.tag") == "task_instruction", F.col("content")).otherwise(F.lit("???")).alias("content"),
    )
    docs = table(spark, sf, "documents").select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("qid"), F.col("doc_id").alias("question_no"),
        F.col("lang").alias("question_category"), F.md5("text").alias("qstr"), F.lit("media").alias("media_dir"),
        F.concat("doc_id", F.lit(".mp4")).alias("video"), F.concat("source", F.lit(".jpg")).alias("first_prompt"),
        F.lit("last.jpg").alias("last_prompt"),
    )
    out = render.render(docs, templates, "user", {"en": "assistant"}, RECIPE)
    return out.select("conv_id", "question_no", "pos", "type", "tag", F.md5("content").alias("content_md5"))


RENDER_SQL = f"""
WITH f AS (SELECT role AS template, arg_min(text, (conv_id, turn)) AS content FROM conversations GROUP BY role),
d AS (SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS qid, CASE WHEN lang = 'en' THEN 'assistant' ELSE 'user' END AS template FROM documents),
m(pos, type, tag) AS (VALUES (0,'video','video'),(1,'image','visual_prompt'),(2,'text','task_instruction'),(3,'text','question'))
SELECT qid || '_' || template || '_{ids.recipe_key(RECIPE)}' AS conv_id, doc_id AS question_no, pos, type, tag,
  md5(CASE tag WHEN 'video' THEN 'media/' || doc_id || '.mp4' WHEN 'visual_prompt' THEN 'media/' || source || '.jpg'
      WHEN 'question' THEN md5(text) ELSE content END) AS content_md5
FROM d JOIN f USING (template), m"""


def chat_messages(spark, sf):
    """Turns of equal role in a row become one message."""
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.length("text") % 3 == 0, F.lit("user")).otherwise(F.col("role")).alias("role")
    )
    return render.message_runs(rows, ["conv_id"], ["turn"])


CHAT_SQL = """
WITH r AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'user' ELSE role END AS role FROM conversations),
o AS (SELECT *, (lag(role) OVER w IS DISTINCT FROM role)::INT AS op FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT *, CAST(sum(op) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS message_idx FROM o)
SELECT conv_id, turn, role, message_idx, row_number() OVER (PARTITION BY conv_id, message_idx ORDER BY turn) - 1 AS part_idx FROM m"""


def chat_parts(spark, sf):
    """System first, marks before media, the rest in one user message."""
    turns = table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("pos"), F.md5("text").alias("content"),
        F.expr("CASE WHEN turn = 1 THEN 'image' WHEN turn = 2 AND conv_id % 2 = 0 THEN 'image' ELSE 'text' END").alias("type"),
        F.expr("""CASE WHEN turn = 0 THEN 'task_instruction' WHEN turn = 1 THEN 'visual_prompt'
                  WHEN turn = 2 AND conv_id % 2 = 0 THEN 'jumbled_visual_prompt' ELSE 'question' END""").alias("tag"),
    )
    marks = {"video": "Video", "prompt": "Image", "first": "Image A", "second": "Image B"}
    return render.to_chat(turns, marks=marks)


CHAT_PARTS_SQL = """
WITH t AS (SELECT conv_id, turn AS pos, md5(text) AS content,
    CASE WHEN turn = 1 OR (turn = 2 AND conv_id % 2 = 0) THEN 'image' ELSE 'text' END AS type,
    CASE WHEN turn = 0 THEN 'system' ELSE 'user' END AS role,
    bool_or(turn = 2 AND conv_id % 2 = 0) OVER (PARTITION BY conv_id) AS two FROM conversations),
p AS (SELECT conv_id, pos, 1 AS a, role, type, content FROM t UNION ALL
  SELECT conv_id, pos, 0, role, 'text', CASE WHEN NOT two THEN 'Image' WHEN pos = 1 THEN 'Image A' ELSE 'Image B' END FROM t WHERE type = 'image')
SELECT conv_id, CAST(role = 'user' AS BIGINT) * (bool_or(role = 'system') OVER (PARTITION BY conv_id))::BIGINT AS message_idx,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY pos, a) - 1 AS part_idx, role, type, content FROM p"""


def flatten_text(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return render.to_text(turns, ["conv_id"], ["turn"], max_chars=200, sep="\n").select(
        "conv_id", "chunk_no", F.length("text").alias("n"), F.md5("text").alias("hash")
    )


FLATTEN_SQL = """
WITH p AS (
  SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN text ELSE chr(10) || text END AS piece
  FROM conversations WHERE text IS NOT NULL),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM p WHERE length(piece) > 0),
t AS (SELECT conv_id, CAST(before // 200 AS BIGINT) AS chunk_no, string_agg(piece, '' ORDER BY turn) AS t FROM o GROUP BY ALL)
SELECT conv_id, chunk_no, CAST(length(t) AS INTEGER) AS n, md5(t) AS hash FROM t"""


def qid_hash(spark, sf):
    """Path ids of the orders, their hashes, and the parts read back from the path."""
    path = ids.question_path(
        F.lit("mating"), F.lit("1part"), F.lit(0), F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderkey"),
        F.lit(0),
    )
    params = F.create_map(
        F.lit("status"), F.col("o_orderstatus"), F.lit("order"), F.col("o_orderkey").cast("string"), F.lit("a b"), F.lit('"q"')
    )
    rows = table(spark, sf, "orders").select(
        "o_orderkey", path.alias("qid_flat"), ids.content_key(ids.canonical_json(params)).alias("media_key")
    )
    return with_question_ids(rows).withColumn("qid", F.sha2("qid_flat", 256))


QID_SQL = r"""
WITH p AS (SELECT *, 'mating/1part/0/' || o_orderpriority || '/' || o_custkey || '/' || o_orderkey || '/0' AS qid_flat FROM orders)
SELECT o_orderkey, qid_flat, sha256(qid_flat) AS qid, split_part(qid_flat, '/', 6) AS question_no, 0 AS shuff_idx,
  sha256('{"a b": "\"q\"", "order": "' || o_orderkey || '", "status": "' || o_orderstatus || '"}') AS media_key FROM p"""

# --- media recipes ------------------------------------------------------------------------------


def _manifest(spark, sf):
    """Events of a user in order are the frames of its video; its first two errors are the prompts."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("conv_id"), "event_id", micros(F.col("ts")).alias("t"), "event_type"
    )
    placed = with_position(rows, ["conv_id"], ["t", "event_id"], "pos")
    frames = placed.select("conv_id", "pos", F.concat(F.lit("f"), "event_id").alias("ref"))
    errors = with_position(
        placed.filter("event_type = 'error'").select("conv_id", "pos", "event_id"), ["conv_id"], ["pos"], "prompt_no"
    )
    prompts = errors.select(
        "conv_id", "prompt_no", F.col("pos").alias("frame_idx"), F.concat(F.lit("p"), "event_id").alias("ref")
    )
    return frames, prompts


MANIFEST_SQL = FRAMES_SQL + """,
m AS (SELECT user_id AS conv_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS pos FROM frames),
pr AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS no FROM m WHERE event_type = 'error')"""


def recipe_concat(spark, sf):
    frames, prompts = _manifest(spark, sf)
    steps = [
        ("embed", lambda m: media.embed(m, prompts), {"component": "embed"}),
        ("concat", lambda m: media.concat(m, prompts), {"component": "concat", "vid_first": False}),
        ("add_frame_idx", lambda m: media.number_frames(m, zero_index=False), {"component": "add_frame_idx"}),
    ]
    return media.run_recipe(frames, steps).drop("media_key")


CONCAT_SQL = f"""
WITH {MANIFEST_SQL}, a AS (
  SELECT m.conv_id, 0 AS part, m.pos AS k, CASE WHEN pr.no IS NULL THEN 'f' ELSE 'p' END || m.event_id AS ref
  FROM m LEFT JOIN pr ON pr.event_id = m.event_id
  UNION ALL SELECT conv_id, -1, -no, 'p' || event_id FROM pr)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) - 1 AS pos, ref,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS VARCHAR) AS frame_label FROM a"""


def recipe_collage(spark, sf):
    """Collages of the users whose key is not in the cache of odd users."""
    frames, prompts = _manifest(spark, sf)
    steps = [("collage", lambda m: media.collage(m, prompts, "right"), {"component": "collage", "pos": "right"})]
    built = media.run_recipe(frames.filter("conv_id % 2 = 1"), steps)
    out = media.run_recipe(frames, steps, cache=built)
    return out.select("conv_id", "pos", F.array_join("parts", "+").alias("parts"))


COLLAGE_SQL = f"""
WITH {MANIFEST_SQL}, l AS (SELECT conv_id, string_agg('+p' || event_id, '' ORDER BY no) AS p FROM pr GROUP BY 1)
SELECT m.conv_id, pos, 'f' || event_id || coalesce(p, '') AS parts FROM m LEFT JOIN l USING (conv_id) WHERE m.conv_id % 2 = 0"""


def relevant_frames(spark, sf):
    """Frames inside the spans a purchase rates; users without purchases keep all."""
    frames, _ = _manifest(spark, sf)
    frames = frames.withColumn("frame_idx", F.col("pos")).select("conv_id", "frame_idx", "ref")
    scores = table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").alias("conv_id"), (F.col("value") / 20).alias("score"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN cast(get_json_object(props, '$.k') as string) ELSE concat(cast(get_json_object(props, '$.k') as int), '-', cast(get_json_object(props, '$.k') as int) + 2) END").alias("span"),
    )
    return media.relevant_frames(frames, scores, ["conv_id"], threshold=4, offset=2).select("conv_id", "frame_idx")


RELEVANT_SQL = f"""
WITH {MANIFEST_SQL}, s AS (SELECT user_id AS conv_id, CAST(json_extract(props, '$.k') AS BIGINT) AS lo,
    CAST(json_extract(props, '$.k') AS BIGINT) + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 2 END AS hi, value / 20 >= 4 AS good
  FROM events WHERE event_type = 'purchase'),
k AS (SELECT m.conv_id, m.pos, CASE WHEN m.conv_id IN (SELECT conv_id FROM s) THEN
    EXISTS (SELECT 1 FROM s WHERE s.conv_id = m.conv_id AND good AND hi >= 2 AND m.pos BETWEEN greatest(lo, 2) AND hi)
    ELSE m.pos >= 2 END AS keep FROM m)
SELECT conv_id, pos AS frame_idx FROM k WHERE keep
  OR conv_id IN (SELECT conv_id FROM k GROUP BY conv_id HAVING NOT bool_or(keep))"""

# --- conversion ------------------------------------------------------------------------------


def _token_questions(spark, sf):
    """Parts as questions in three shapes; brands decide tracking."""
    one = lambda e: F.expr(f"array(array(cast({e} as string)))")
    pair = lambda a, b: F.expr(f"array(array(cast({a} as string), cast({b} as string)))")
    answer = lambda i: F.when(F.col("kind") == "str", one(f"p_size + {i}")).otherwise(pair(f"p_size + {i}", "p_partkey"))
    label = lambda i: F.lit("ABC"[i])
    option = lambda i: F.struct(
        F.lit(i).alias("idx"), F.lit("[]").alias("raw_json"), label(i).alias("label"), F.lit("old").alias("text"),
        F.lit("old").alias("full_text"), answer(i).alias("answer"),
    )
    rows = table(spark, sf, "part").withColumn(
        "kind", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'str' WHEN 1 THEN 'list' ELSE 'listoflist' END")
    )
    none = F.struct(
        F.lit(2).alias("idx"), F.lit('"none"').alias("raw_json"), F.lit("C").alias("label"), F.lit("None of these").alias("text"),
        F.lit("C. None of these").alias("full_text"), F.expr("cast(null as array<array<string>>)").alias("answer"),
    )
    return rows.select(
        F.col("p_partkey").alias("question_no"), "kind", "p_size", F.col("p_brand").alias("video_id"),
        F.expr("CASE WHEN p_partkey % 3 <> 1 AND p_size % 2 = 0 THEN 'tracking' ELSE 'mating' END").alias("question_category"),
        F.concat(F.lit("Where is Part "), "p_size", F.lit(" and Part "), F.col("p_size") + 1, F.lit("?")).alias("raw_qstr"),
        F.array(F.col("p_size").cast("string")).alias("query_parts"), F.lit(0).alias("correct_idx"),
        F.array(option(0), option(1), none).alias("options"),
        F.expr("CASE WHEN p_partkey % 3 <> 1 AND p_size % 2 = 0 THEN array(1, 2) ELSE array(1) END").alias("frame_idx"),
    )


def convert_tokens(spark, sf):
    out = convert.convert_options(_token_questions(spark, sf))
    return out.select("question_no", "qstr", F.col("correct_option.text").alias("answer"))


CONVERT_SQL = """
WITH q AS (SELECT p_partkey AS question_no, p_size AS s, p_partkey % 3 AS k, p_partkey % 3 <> 1 AND p_size % 2 = 0 AS tr FROM part),
t AS (SELECT *, list_transform([0, 1], lambda i: CASE
    WHEN k = 0 THEN '<object' || (s + i) || CASE WHEN tr THEN 'B' ELSE '' END || '>'
    WHEN k = 1 THEN '<object' || (s + i) || '>, <object' || question_no || '>'
    WHEN tr THEN '<object' || (s + i) || 'A> matches <object' || question_no || 'B>'
    ELSE '<object' || (s + i) || '> and <object' || question_no || '>' END) AS o FROM q)
SELECT question_no, 'Where is <object' || s || CASE WHEN tr THEN 'A' ELSE '' END || '> and Part ' || (s + 1) || '?' || chr(10) || 'Options:'
  || chr(10) || 'A. ' || o[1] || chr(10) || 'B. ' || o[2] || chr(10) || 'C. None of these' AS qstr, o[1] AS answer FROM t"""


def _token_masks(spark, sf):
    """Masks of two frames per brand: the sizes of its parts of even and of odd key."""
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("video_id"), F.expr("cast(1 + p_partkey % 2 as int)").alias("frame_idx"),
        F.col("p_size").cast("string").alias("part_id"), F.lit(4).alias("h"), F.lit(4).alias("w"),
    ).distinct().withColumn("runs", F.array(F.lit(0), F.lit(16)))


def convert_masks(spark, sf):
    """Prompt-mask rows and issues per question."""
    rows, issues = convert.convert_prompt_masks(_token_questions(spark, sf), _token_masks(spark, sf))
    a = rows.groupBy("question_no").agg(
        F.count(F.lit(1)).alias("n_masks"), F.count_if("is_missing").alias("n_empty"),
        F.count_if(F.col("region_text").contains("B>")).alias("n_second"),
    )
    b = issues.groupBy("question_no").agg(F.count(F.lit(1)).alias("n_issues"))
    return a.join(b, "question_no", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0).cast("long")))


CONVERT_MASKS_SQL = """
WITH q AS (SELECT p_partkey AS q, p_brand AS v, p_size AS s, p_partkey % 3 AS k, p_partkey % 3 <> 1 AND p_size % 2 = 0 AS tr FROM part),
m AS (SELECT DISTINCT p_brand AS v, 1 + p_partkey % 2 AS f, p_size AS p FROM part),
ref AS (SELECT DISTINCT q, v, tr, pos, p FROM (
  SELECT q, v, tr, 0 AS pos, s AS p FROM q
  UNION ALL SELECT q, v, tr, CASE WHEN k = 0 AND tr THEN 1 ELSE 0 END, s + i FROM q, range(2) r(i)
  UNION ALL SELECT q, v, tr, CASE WHEN k = 2 AND tr THEN 1 ELSE 0 END, q FROM q WHERE k > 0)),
rows AS (SELECT q.q, false AS miss, false AS second FROM q JOIN m ON m.v = q.v AND m.f = 1
  UNION ALL SELECT ref.q, m.p IS NULL, true FROM ref LEFT JOIN m ON m.v = ref.v AND m.f = 2 AND m.p = ref.p WHERE tr AND pos = 1),
iss AS (SELECT q FROM rows WHERE miss UNION ALL
  SELECT ref.q FROM ref WHERE tr AND pos = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.v = ref.v AND m.f = 1 AND m.p = ref.p))
SELECT q AS question_no, count(*) AS n_masks, count(*) FILTER (WHERE miss) AS n_empty, count(*) FILTER (WHERE second) AS n_second,
  coalesce((SELECT count(*) FROM iss WHERE iss.q = rows.q), 0) AS n_issues FROM rows GROUP BY q"""


def positional_pairs(spark, sf):
    """i-th document of a source with i-th page of equally many pages: orders against orders."""
    o = table(spark, sf, "orders")
    by_price = o.select("o_orderstatus", F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("pa"))
    by_key = o.select("o_orderstatus", F.col("o_orderkey").alias("b"))
    return convert.zip_by_position(by_price, by_key, ["pa", "a"], ["b"], ["o_orderstatus"]).select(
        "o_orderstatus", "position", "a", "b"
    )


POSITIONAL_SQL = """
SELECT x.o_orderstatus, x.i AS position, x.o_orderkey AS a, y.o_orderkey AS b FROM
 (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) x
 JOIN (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i FROM orders) y
 ON x.o_orderstatus = y.o_orderstatus AND x.i = y.i"""


def media_pairs(spark, sf):
    """Orders and customers' first orders paired one to one by key."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("bal"))
    return convert.pair_one_to_one(a, b, "id")


MEDIA_PAIRS_SQL = "SELECT c_custkey AS id, c_mktsegment, round(c_acctbal, 2) AS bal FROM customer"


def text_marks(spark, sf):
    """Scalar helpers over the line items: time marks, labels, fractions, strides."""
    seconds = (F.col("l_extendedprice") / 10).cast("double")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"),
        text.time_mark(seconds).alias("mark"), text.adorn(text.label(F.col("l_linenumber")), "double_parent").alias("label"),
        text.sheet_label(F.col("l_partkey")).alias("sheet"),
        F.round(text.fraction(F.concat_ws(":", F.col("l_partkey"), F.col("l_linenumber"))), 6).alias("rate"),
        text.capped_stride(F.col("l_partkey"), F.col("l_linenumber"), 500).cast("long").alias("stride"),
    )


MARKS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price,
  '[' || printf('%02d', CAST(floor(floor(l_extendedprice / 10) / 60) AS BIGINT)) || ':' || printf('%02d', CAST(floor(l_extendedprice / 10) AS BIGINT) % 60) || ']' AS mark,
  '(' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', l_linenumber + 1, 1) || ')' AS label,
  CASE WHEN l_partkey >= 702 THEN chr(CAST(65 + (l_partkey - 702) // 676 AS INT)) ELSE '' END
   || CASE WHEN l_partkey >= 26 THEN chr(CAST(65 + ((l_partkey // 26) - 1) % 26 AS INT)) ELSE '' END
   || chr(CAST(65 + l_partkey % 26 AS INT)) AS sheet,
  round(l_partkey / l_linenumber, 6) AS rate,
  CASE WHEN l_partkey > 500 THEN greatest(CAST(ceil((l_partkey - l_linenumber) / (500 - l_linenumber)) AS BIGINT), 1) ELSE 1 END AS stride
FROM lineitem"""



def natural_order(spark, sf):
    """Natural sort keys of the parts' file names."""
    name = F.concat(F.upper("p_name"), F.lit("_"), "p_partkey", F.lit(".Mp4"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.natural_key(name), "|").alias("key"))


NATURAL_SQL = "SELECT p_partkey, p_name || '_|' || lpad(CAST(p_partkey AS VARCHAR), 20, '0') || '|.mp|' || lpad('4', 20, '0') AS key FROM part"

QUERIES = {
    "natural_order": Query(natural_order, NATURAL_SQL),
    "two_part_options": Query(two_part_options, TWO_PART_OPTIONS_SQL),
    "make_2part": Query(make_2part, MAKE_2PART_SQL),
    "make_1part": Query(make_1part, MAKE_1PART_SQL),
    "find_edges": Query(find_edges, FIND_EDGES_SQL),
    "role_index": Query(role_index, ROLE_SQL),
    "role_sizes": Query(role_sizes, ROLE_SIZES_SQL),
    "role_questions": Query(role_questions, ROLE_QUESTIONS_SQL),
    "annotated_questions": Query(annotated_questions, ANNOTATED_SQL),
    "validate_options": Query(validate_broken, BROKEN_SQL),
    "shuffle_options": Query(shuffle_options, SHUFFLE_SQL),
    "shuffled_questions": Query(shuffled_questions, SHUFFLED_SQL),
    "scrambled_parts": Query(scrambled_text, SCRAMBLE_SQL),
    "render_conversation": Query(render_conversation, RENDER_SQL),
    "chat_messages": Query(chat_messages, CHAT_SQL),
    "chat_parts": Query(chat_parts, CHAT_PARTS_SQL),
    "flatten_text": Query(flatten_text, FLATTEN_SQL),
    "qid_hash": Query(qid_hash, QID_SQL),
    "recipe_concat": Query(recipe_concat, CONCAT_SQL),
    "recipe_collage": Query(recipe_collage, COLLAGE_SQL),
    "relevant_frames": Query(relevant_frames, RELEVANT_SQL),
    "convert_tokens": Query(convert_tokens, CONVERT_SQL),
    "convert_masks": Query(convert_masks, CONVERT_MASKS_SQL),
    "positional_pairs": Query(positional_pairs, POSITIONAL_SQL),
    "media_pairs": Query(media_pairs, MEDIA_PAIRS_SQL),
    "text_marks": Query(text_marks, MARKS_SQL),
}
