"""Ledger, bootstrap, tabulation, judge, log and packing queries."""

from __future__ import annotations

import mimetypes

from pyspark.sql import functions as F

from markwise.operators import bootstrap, judge, ledger, logs, packing, score, tabulate
from markwise.plans.catalog import Query, micros, rounded, table
from markwise.plans.scoring import TRUTH

ITERS = 100_000


# --- ledger -------------------------------------------------------------------

def resume_pending(spark, sf):
    """User turns without an assistant answer in the next turn."""
    turns = table(spark, sf, "conversations")
    key = F.concat_ws("-", "conv_id", F.col("turn")).alias("work_id")
    asked = turns.filter("role = 'user'").select(key, "conv_id", "turn", F.length("text").cast("long").alias("n"))
    done = turns.filter("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("work_id"), (F.length("text") > 200).alias("ok")
    )
    return ledger.pending(asked, done, key="work_id", ok=F.col("ok"))


PENDING_SQL = """
SELECT concat_ws('-', u.conv_id, u.turn) AS work_id, u.conv_id, u.turn, length(u.text) AS n
FROM conversations u WHERE role = 'user' AND NOT EXISTS (
  SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id
    AND a.turn = u.turn + 1 AND length(a.text) > 200)"""


def resume_override(spark, sf):
    """As above for all turns, rerunning conversations that mention a question mark."""
    turns = table(spark, sf, "conversations")
    work = turns.select(F.concat_ws("-", "conv_id", "turn").alias("work_id"), "conv_id", "turn")
    done = turns.filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("work_id"))
    again = turns.filter(F.contains("text", F.lit("?"))).select("conv_id")
    return ledger.pending(work, done, "work_id", override=again, override_key="conv_id")


OVERRIDE_SQL = """
SELECT concat_ws('-', conv_id, turn) AS work_id, conv_id, turn FROM conversations
WHERE role <> 'assistant' OR conv_id IN (SELECT conv_id FROM conversations WHERE contains(text, '?'))"""


def upsert_override(spark, sf):
    """Documents keyed by length: the first of a length gives way to the newest page of it."""
    old = table(spark, sf, "documents").select(
        F.col("n_chars").alias("k"), F.col("doc_id").alias("ord"), F.md5("text").alias("body")
    )
    new = table(spark, sf, "pages").select(
        F.length("html").cast("long").alias("k"), F.col("page_id").alias("ord"), F.md5("html").alias("body")
    )
    return ledger.upsert(old, new, "k", "ord", insert_missing=True)


UPSERT_SQL = """
WITH old AS (SELECT n_chars AS k, doc_id AS ord, md5(text) AS body FROM documents),
new AS (SELECT length(html) AS k, page_id AS ord, md5(html) AS body FROM pages),
newest AS (SELECT k, arg_max(body, ord) AS body FROM new GROUP BY k),
first AS (SELECT k, min(ord) AS ord FROM old GROUP BY k)
SELECT o.k, o.ord, CASE WHEN f.ord IS NOT NULL AND n.k IS NOT NULL THEN n.body ELSE o.body END AS body
FROM old o LEFT JOIN first f ON f.k = o.k AND f.ord = o.ord LEFT JOIN newest n ON n.k = o.k
UNION ALL SELECT k, ord, body FROM new WHERE k NOT IN (SELECT k FROM old)"""


def metadata_upsert(spark, sf):
    """Benchmark items put among the documents; clashes in id or content are removed."""
    store = table(spark, sf, "documents").select(
        F.col("doc_id").alias("qid"), F.md5("text").alias("hash"), F.col("n_chars").alias("n")
    )
    fresh = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.md5("text").alias("hash"), F.length("text").cast("long").alias("n")
    )
    return ledger.upsert_by_any_key(store, fresh, ["qid", "hash"], override=True)


METADATA_SQL = """
WITH s AS (SELECT doc_id AS qid, md5(text) AS hash, n_chars AS n FROM documents),
f AS (SELECT item_id AS qid, md5(text) AS hash, length(text) AS n FROM benchmark)
SELECT * FROM s WHERE qid NOT IN (SELECT qid FROM f) AND hash NOT IN (SELECT hash FROM f)
UNION ALL SELECT * FROM f"""


def cached_lookup(spark, sf):
    """Documents looked up among the labelled ones by text or length: the first wins."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.md5("text").alias("h"), F.col("n_chars").alias("k"), F.col("doc_id").alias("owner")
    )
    items = table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "h", "k", "owner")
    return ledger.cached_lookup(docs, items.withColumnRenamed("doc_id", "ord"), ["h", "k"], "ord", ["owner"])


CACHED_SQL = """
WITH d AS (SELECT doc_id, md5(text) AS h, n_chars AS k FROM documents),
c AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM labels)),
a AS (SELECT h, min(doc_id) AS o FROM c GROUP BY h), b AS (SELECT k, min(doc_id) AS o FROM c GROUP BY k)
SELECT d.*, coalesce(least(a.o, b.o), d.doc_id) AS owner, coalesce(a.o, b.o) IS NOT NULL AS cache_hit
FROM d LEFT JOIN a ON a.h = d.h LEFT JOIN b ON b.k = d.k"""


def stub_predictions(spark, sf):
    """A deterministic predictor over the pending turns, in Arrow batches."""

    def answer(batches):
        for pdf in batches:
            yield pdf.assign(label=pdf["n"].map(lambda n: "ABCD"[n % 4]))

    return ledger.predict(
        resume_pending(spark, sf), answer, "work_id string, conv_id long, turn long, n long, label string"
    )


PREDICT_SQL = f"SELECT *, substr('ABCD', CAST(n % 4 AS INT) + 1, 1) AS label FROM ({PENDING_SQL})"


# --- bootstrap and tabulation -----------------------------------------------------

def _outcomes(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_custkey").alias("video_id"),
        (F.col("o_totalprice") > 250_000).cast("int").alias("human"),
        (F.col("o_orderstatus") == "F").cast("int").alias("model"),
    )


def _bootstrap(iters):
    def build(spark, sf):
        trials = bootstrap.bootstrap_trials(_outcomes(spark, sf), "video_id", ["human", "model"], iters=iters)
        return rounded(bootstrap.confidence_interval(trials, ["human", "model", "gap"]))

    return build


def _draw_sql(iters: int) -> str:
    """CTE ``d``: cluster index of each draw, by the operator's mix."""
    p, parts = bootstrap.PRIME, []
    parts.append(
        f"x0 AS (SELECT s.c, i, CAST(i * 50 + j + 42 AS BIGINT) % {p} AS x0 FROM (SELECT DISTINCT c FROM p) s, range({iters}) a(i), range(50) b(j))"
    )
    for r, key in enumerate(bootstrap.ROUND_KEYS):
        keep = "c, i" + (", x2" if r == 2 else "")
        parts.append(f"a{r} AS (SELECT {keep}, (x{r} * {key} + 42) % {p} AS a FROM x{r})")
        parts.append(f"b{r} AS (SELECT {keep}, a, (a * a) % {p} AS b FROM a{r})")
        parts.append(f"x{r + 1} AS (SELECT {keep}, (a * ((b * b) % {p})) % {p} AS x{r + 1} FROM b{r})")
    parts.append(f"d AS (SELECT c, i, (x2 * {p} + x3) % c AS idx FROM x3)")
    return ",\n".join(parts)


def _ci_sql(cols):
    return ", ".join(
        f"round(100 * quantile_cont({c}, 0.025), 6) AS {c}_low, round(100 * avg({c}), 6) AS {c}_mean, "
        f"round(100 * quantile_cont({c}, 0.975), 6) AS {c}_high" for c in cols
    )


BOOTSTRAP_SQL = f"""
WITH o AS (SELECT o_orderpriority AS run_id, o_custkey AS video_id, (o_totalprice > 250000)::INT AS human,
                  (o_orderstatus = 'F')::INT AS model FROM orders),
t AS (SELECT run_id, video_id, sum(human) AS human, sum(model) AS model, count(*) AS n FROM o GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY video_id) - 1 AS idx,
             count(*) OVER (PARTITION BY run_id) AS c FROM t),
{_draw_sql(ITERS)},
r AS (SELECT run_id, i, sum(human) / sum(n) AS human, sum(model) / sum(n) AS model
      FROM d JOIN p USING (c, idx) GROUP BY run_id, i),
g AS (SELECT *, human - model AS gap FROM r)
SELECT run_id, {_ci_sql(['human', 'model', 'gap'])} FROM g GROUP BY run_id"""

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SETTING = """CASE {r} % 5 WHEN 0 THEN 'sep_media_first_keyframe' WHEN 1 THEN 'concat_vp_first_trimmed'
  WHEN 2 THEN 'collage_vp_left_keyframe' WHEN 3 THEN 'only_image_first' ELSE 'videorefer_run' END"""


def _run_rows(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("run_id"), F.col("l_orderkey").alias("question_no"),
        (F.col("l_linenumber") - 1).alias("shuff_idx"), F.col("l_returnflag").alias("prediction"),
        F.expr(TRUTH.format(k="l_orderkey")).alias("truth"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_no"), F.col("o_orderpriority").alias("category"),
        F.col("o_custkey").alias("video_id"), F.lit(4).alias("n_options"),
    )
    return lines.join(orders, "question_no")


def _runs(spark, sf):
    return table(spark, sf, "supplier").select((F.col("s_suppkey") % 10).alias("run_id")).distinct().select(
        "run_id",
        F.expr("concat('model', run_id % 2 * (run_id % 5))").alias("model_name"),
        F.expr(SETTING.format(r="run_id")).alias("setting"),
        F.expr("1 + run_id % 4").cast("int").alias("num_shuffles"),
    )


def tabulate_runs(spark, sf):
    out = tabulate.tabulate(
        _run_rows(spark, sf), _runs(spark, sf), PRIORITIES, iters=ITERS, n_sample=50
    )
    return rounded(out)


TABULATE_SQL = f"""
WITH runs AS (SELECT run_id, 'model' || CAST(run_id % 2 * (run_id % 5) AS VARCHAR) AS model,
    {SETTING.format(r='run_id')} AS setting, 1 + run_id % 4 AS shuffles
  FROM (SELECT DISTINCT s_suppkey % 10 AS run_id FROM supplier)),
a AS (SELECT l_suppkey % 10 AS run_id, l_orderkey AS q, l_linenumber - 1 AS sh,
    l_returnflag = {TRUTH.format(k='l_orderkey')} AS ok, o_orderpriority AS category, o_custkey AS video
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT a.run_id, category, q, bool_and(ok) AS strict FROM a JOIN runs USING (run_id)
  WHERE sh < shuffles GROUP BY ALL),
m AS (SELECT run_id, round(100.0 * avg(strict::INT), 6) AS micro_avg, {", ".join(
    f"round(100.0 * avg(strict::INT) FILTER (WHERE category = '{c}'), 6) AS " + '"' + c + '"' for c in PRIORITIES)}
  FROM s GROUP BY run_id),
t AS (SELECT run_id, video, sum(ok::INT) AS k, count(*) AS n FROM a GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY video) - 1 AS idx,
             count(*) OVER (PARTITION BY run_id) AS c FROM t),
{_draw_sql(ITERS)},
r AS (SELECT run_id, i, sum(k) / sum(n) AS ci FROM d JOIN p USING (c, idx) GROUP BY run_id, i),
ci AS (SELECT run_id, {_ci_sql(['ci'])} FROM r GROUP BY run_id)
SELECT model || '_' || setting AS result_key, run_id, model,
  coalesce(nullif(regexp_extract(setting, '^(sep|concat|collage|videorefer)', 0), ''), 'unknown') AS prompt_type,
  coalesce(nullif(regexp_extract(setting, '(keyframe|trimmed|videorefer)', 0), ''), 'unknown') AS video_type,
  m.* EXCLUDE (run_id), ci.* EXCLUDE (run_id)
FROM runs JOIN m USING (run_id) JOIN ci USING (run_id)
QUALIFY row_number() OVER (PARTITION BY model || '_' || setting ORDER BY run_id DESC) = 1"""


def seed_summary(spark, sf):
    """Each seed is a run; mean and deviation of the strict score per setting."""
    rows = _run_rows(spark, sf)
    tallies = score.tally(rows, ["run_id", "question_no"], ["category", "truth", "n_options"], "shuff_idx")
    scores = score.score(tallies, by=["run_id"]).filter("category = 'micro_avg'")
    named = scores.join(_runs(spark, sf), "run_id")
    return rounded(tabulate.seed_summary(named, ["setting"], ["strict"]))


SEED_SQL = f"""
WITH a AS (SELECT l_suppkey % 10 AS run_id, l_orderkey AS q, bool_and(l_returnflag = {TRUTH.format(k='l_orderkey')}) AS ok
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
s AS (SELECT run_id, 100.0 * avg(ok::INT) AS strict FROM a GROUP BY run_id)
SELECT {SETTING.format(r='run_id')} AS setting, count(*) AS n_runs, round(avg(strict), 6) AS strict_mean,
  round(stddev_samp(strict), 6) AS strict_sd FROM s GROUP BY 1"""


# --- judge ------------------------------------------------------------------------

def _judged(spark, sf):
    """Agent = first line of an order, baseline = its second lines, in part order."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_no"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_returnflag", "l_linestatus",
    )
    ordinal = F.struct("l_partkey", "l_suppkey", "l_extendedprice")
    first = lines.filter("l_linenumber = 1").groupBy("question_no").agg(
        F.min_by(F.struct("l_returnflag", "l_linestatus"), ordinal).alias("a")
    )
    base = judge.first_baseline(
        lines.filter("l_linenumber = 2").select(
            "question_no", F.col("l_returnflag").alias("prediction"),
            F.expr(TRUTH.format(k="question_no")).alias("truth"), ordinal.alias("ord"),
        ),
        "ord",
    )
    agent = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_no"), "o_orderpriority", "o_custkey",
        (F.col("o_totalprice") > 20_000).alias("has_qinfo"), F.expr(TRUTH.format(k="o_orderkey")).alias("truth"),
    ).join(first, "question_no", "left").select(
        "*",
        F.col("a").isNotNull().alias("has_result"),
        F.coalesce(F.col("a.l_linestatus") == "F", F.lit(False)).alias("ok"),
        F.col("a.l_returnflag").alias("result"),
        F.when(F.col("truth") != "N", F.lit("N")).alias("abstain_label"),
    ).drop("a")
    return judge.outcomes(agent, base)


JUDGED_SQL = f"""
WITH f AS (SELECT l_orderkey AS q, l_returnflag AS result, l_linestatus = 'F' AS ok FROM lineitem WHERE l_linenumber = 1
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1),
b AS (SELECT l_orderkey AS q, l_returnflag AS base FROM lineitem WHERE l_linenumber = 2
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1),
j AS (SELECT o.*, {TRUTH.format(k='o_orderkey')} AS truth, f.result, f.q IS NOT NULL AS has, coalesce(ok, false) AS ok,
    b.base, o_totalprice > 20000 AS info
  FROM orders o LEFT JOIN f ON f.q = o_orderkey LEFT JOIN b ON b.q = o_orderkey),
k AS (SELECT *, NOT (has AND ok) AS failed, has AND ok AND info AS judged,
    has AND ok AND info AND truth <> 'N' AND result = 'N' AS abstain, has AND base IS NOT NULL AS seen,
    has AND base IS NOT NULL AND base <> truth AS wrong FROM j),
o AS (SELECT *, judged AND NOT abstain AND result = truth AS hit FROM k)"""


def judge_recovery(spark, sf):
    return rounded(judge.judge(_judged(spark, sf)))


JUDGE_SQL = JUDGED_SQL + """
SELECT count(*) FILTER (WHERE failed OR judged) AS num_total, count(*) FILTER (WHERE hit) AS num_correct,
  count(*) FILTER (WHERE judged AND NOT abstain AND NOT hit) AS num_incorrect,
  count(*) FILTER (WHERE abstain) AS num_abstain, count(*) FILTER (WHERE failed) AS num_failed_code,
  count(*) FILTER (WHERE hit AND seen AND NOT wrong) AS num_overlap, count(*) FILTER (WHERE wrong) AS error_count,
  count(*) FILTER (WHERE hit AND wrong) AS error_recovery_count,
  round(100.0 * num_correct / count(*), 6) AS accuracy, round(100.0 * num_abstain / count(*), 6) AS abstain_rate,
  round(100.0 * num_failed_code / count(*), 6) AS fail_rate,
  round(100.0 * (count(*) - error_count) / count(*), 6) AS baseline_accuracy,
  round(100.0 * (count(*) FILTER (WHERE seen) - error_count) / count(*) FILTER (WHERE seen), 6) AS baseline_accuracy_answered,
  round(100.0 * error_recovery_count / error_count, 6) AS error_recovery_rate FROM o"""


def judge_breakdown(spark, sf):
    return judge.judge_breakdown(_judged(spark, sf), ["o_orderpriority", "o_custkey"])


BREAKDOWN_SQL = JUDGED_SQL + """
SELECT d AS dimension, v AS value, count(*) AS num_correct, count(*) FILTER (WHERE seen AND NOT wrong) AS num_overlap
FROM (SELECT 'o_orderpriority' AS d, o_orderpriority AS v, seen, wrong FROM o WHERE hit
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), seen, wrong FROM o WHERE hit) GROUP BY ALL"""


# --- logs and packing -----------------------------------------------------------------

def _log_lines(spark, sf):
    """Events written as structured log lines; errors are cut short and do not parse."""
    return table(spark, sf, "events").select("event_id", "user_id", F.expr(LOG_LINE).alias("value"))


LOG_LINE = """CASE WHEN event_type = 'error' THEN '{"record": {"extra":'
  ELSE concat('{"text": "', event_id, ' | note", "record": {"extra": {"stage": "',
    CASE WHEN value < 20 THEN '' ELSE event_type END,
    '", "file_path": "out/', event_id, CASE WHEN value < 50 THEN '.PNG' ELSE '.yml' END, '", "meta": ', props,
    '}, "function": "', event_type, '", "message": "m', user_id, '"}}') END"""


def log_flatten(spark, sf):
    flat = logs.flatten_events(_log_lines(spark, sf))
    return flat.withColumn("k", F.get_json_object("meta", "$.k").cast("long")).drop("meta")


LOG_SQL = """
SELECT event_id, user_id, CASE WHEN value < 20 THEN 'unknown' ELSE event_type END AS stage, event_type AS action,
  CAST(event_id AS VARCHAR) AS timestamp, 'm' || user_id AS message,
  'out/' || event_id || CASE WHEN value < 50 THEN '.PNG' ELSE '.yml' END AS file_path,
  CASE WHEN value < 50 THEN 'image/png' ELSE {yml} END AS mime,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_type <> 'error'"""
LOG_SQL_TEXT = LOG_SQL.format(yml=f"'{mimetypes.types_map.get('.yml', 'text/plain')}'")


def _stages(spark, sf):
    return table(spark, sf, "events").select(
        "user_id", "event_id", micros(F.col("ts")).alias("t"), F.col("event_type").alias("stage"),
        F.expr("CASE WHEN value > 50 THEN props ELSE '' END").alias("action"),
        F.expr("concat(event_type, ' ', repeat(props, 8))").alias("message"),
    )


def stage_transitions(spark, sf):
    return logs.stage_transitions(_stages(spark, sf), ["user_id"], ["t", "event_id"])


TRANSITIONS_SQL = """
WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type AS to_stage,
  CASE WHEN value > 50 THEN props ELSE event_type || ' ' || repeat(props, 8) END AS x,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_stage FROM events)
SELECT user_id, event_id, t, from_stage, to_stage,
  CASE WHEN length(x) > 60 THEN substr(x, 1, 60) || '…' ELSE x END AS label FROM s WHERE from_stage <> to_stage"""


def transition_weights(spark, sf):
    return logs.transition_weights(stage_transitions(spark, sf))


WEIGHTS_SQL = f"SELECT from_stage, to_stage, count(*) AS n FROM ({TRANSITIONS_SQL}) GROUP BY ALL"


def stage_names(spark, sf):
    """Part names and their upper-case twins as stages that share an identifier."""
    names = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"),
        F.expr("CASE WHEN p_size < 10 THEN replace(p_name, ' ', '-') WHEN p_size < 20 THEN concat('7 ', p_name) ELSE p_name END").alias("stage"),
    )
    return logs.stage_ids(names, "ord")


STAGE_SQL = r"""
WITH n AS (SELECT CASE WHEN p_size < 10 THEN replace(p_name, ' ', '-') WHEN p_size < 20 THEN '7 ' || p_name
    ELSE p_name END AS stage, min(p_partkey) AS seen FROM part GROUP BY 1),
b AS (SELECT stage, seen, CASE WHEN regexp_matches(stage, '^\d') THEN '_' ELSE '' END || regexp_replace(stage, '\W+', '_', 'g') AS base FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seen) AS k FROM b)
SELECT stage, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS stage_id FROM r"""


def _conversations(spark, sf):
    """Odd parts as stored conversations, every third one (as it is asked next) as a fresh one."""
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("conv_id"), F.concat_ws("/", F.lit("q"), F.expr("p_partkey div 7"), "p_brand").alias("qid_flat"),
        F.col("p_size").alias("size"), F.col("p_partkey").alias("ordinal"),
    )
    fresh = rows.filter("conv_id % 3 = 0").withColumn("qid_flat", F.concat_ws("/", F.lit("q"), F.expr("(conv_id + 1) div 7"), F.lit("new")))
    return rows.filter("conv_id % 2 = 1").drop("ordinal"), fresh


def _upsert_conversations(override, part):
    def build(spark, sf):
        return ledger.upsert_conversations(*_conversations(spark, sf), override=override)[part]

    return build


CONVERSATIONS_SQL = """old AS (SELECT p_partkey AS conv_id, 'q/' || (p_partkey // 7) || '/' || p_brand AS qid_flat, p_size AS size, p_partkey // 7 AS f
  FROM part WHERE p_partkey % 2 = 1),
new AS (SELECT p_partkey AS conv_id, 'q/' || ((p_partkey + 1) // 7) || '/new' AS qid_flat, p_size AS size, p_partkey AS ordinal, (p_partkey + 1) // 7 AS f
  FROM part WHERE p_partkey % 3 = 0)"""
CLASH_SQL = f"""WITH {CONVERSATIONS_SQL}
SELECT conv_id, qid_flat, size, ordinal, conv_id % 2 = 1 AS clash, conv_id % 2 = 0 AS stored, CAST(0 AS BIGINT) AS n_replaced FROM new"""
CLASH_STORE_SQL = f"""WITH {CONVERSATIONS_SQL}
SELECT conv_id, qid_flat, size FROM old UNION ALL SELECT conv_id, qid_flat, size FROM new WHERE conv_id % 2 = 0"""
OVERRIDE_CLASH_SQL = f"""WITH {CONVERSATIONS_SQL}, kept AS (SELECT * FROM old WHERE f NOT IN (SELECT f FROM new)),
m AS (SELECT *, ordinal = max(ordinal) OVER (PARTITION BY f) AS stored, conv_id IN (SELECT conv_id FROM kept) AS clash FROM new)
SELECT conv_id, qid_flat, size, ordinal, clash, stored,
  CASE WHEN stored THEN (SELECT count(*) FROM old WHERE old.f = m.f) + clash::INT ELSE 0 END AS n_replaced FROM m"""


def pack_batches_cut(spark, sf):
    """All documents as one key, cut into slices of 64 rows that are packed side by side."""
    docs = table(spark, sf, "documents").select(F.lit("all").alias("source"), "doc_id", "n_chars")
    return packing.pack_batches(docs, ["source"], ["doc_id"], "n_chars", 8192, slice_rows=64)


def pack_batches(spark, sf):
    """Documents of a source packed in id order into batches of 8192 characters."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return packing.pack_batches(docs, ["source"], ["doc_id"], "n_chars", 8192)


PACK_SQL = """
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
p AS (SELECT source, doc_id, n_chars, k, n_chars AS fill, CAST(0 AS BIGINT) AS batch_no FROM d WHERE k = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.n_chars, d.k, CASE WHEN fill + d.n_chars > 8192 THEN d.n_chars ELSE fill + d.n_chars END,
    batch_no + (fill + d.n_chars > 8192)::BIGINT
  FROM p JOIN d ON d.source = p.source AND d.k = p.k + 1)
SELECT source, doc_id, n_chars, batch_no FROM p"""

QUERIES = {
    "resume_pending": Query(resume_pending, PENDING_SQL),
    "resume_override": Query(resume_override, OVERRIDE_SQL),
    "upsert_override": Query(upsert_override, UPSERT_SQL),
    "metadata_upsert": Query(metadata_upsert, METADATA_SQL),
    "cached_lookup": Query(cached_lookup, CACHED_SQL),
    "stub_predictions": Query(stub_predictions, PREDICT_SQL),
    "bootstrap_ci": Query(_bootstrap(ITERS), BOOTSTRAP_SQL),
    "tabulate_runs": Query(tabulate_runs, TABULATE_SQL),
    "seed_summary": Query(seed_summary, SEED_SQL),
    "judge_recovery": Query(judge_recovery, JUDGE_SQL),
    "judge_breakdown": Query(judge_breakdown, BREAKDOWN_SQL),
    "log_flatten": Query(
        log_flatten,
        LOG_SQL_TEXT,
    ),
    "stage_transitions": Query(stage_transitions, TRANSITIONS_SQL),
    "transition_weights": Query(transition_weights, WEIGHTS_SQL),
    "stage_names": Query(stage_names, STAGE_SQL),
    "pack_batches": Query(pack_batches, PACK_SQL),
    "pack_batches_cut": Query(pack_batches_cut, PACK_SQL.replace("SELECT source, doc_id, n_chars, row", "SELECT 'all' AS source, doc_id, n_chars, row").replace("PARTITION BY source ", "")),
    "conversation_clash": Query(_upsert_conversations(False, 1), CLASH_SQL),
    "conversation_insert": Query(_upsert_conversations(False, 0), CLASH_STORE_SQL),
    "conversation_override": Query(_upsert_conversations(True, 1), OVERRIDE_CLASH_SQL),
}
