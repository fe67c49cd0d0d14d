"""Time-axis queries: a user is a video, an event is a frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise.operators import intervals, sampling, timeline
from markwise.plans.catalog import Query, micros, rounded, table

HOUR = 3_600_000_000
USER = ["user_id"]


def frames(spark, sf):
    return table(spark, sf, "events").select(
        "user_id", "event_id", micros(F.col("ts")).alias("t"), "event_type", "value"
    )


FRAMES_SQL = "frames AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type, value FROM events)"


def _views(spark, sf):
    """Views of each user with their position."""
    rows = frames(spark, sf).filter("event_type = 'view'").select(*USER, "event_id", "t")
    return sampling.with_position(rows, USER, ["t", "event_id"], "view_idx").select(*USER, "t", "view_idx")


def _purchases(spark, sf):
    return frames(spark, sf).filter("event_type = 'purchase'").select(
        *USER, F.col("event_id").alias("purchase_id"), F.col("t").alias("wanted")
    )


VIEWS_SQL = FRAMES_SQL + """,
views AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS view_idx
          FROM frames WHERE event_type = 'view'),
asked AS (SELECT user_id, event_id AS purchase_id, t AS wanted FROM frames WHERE event_type = 'purchase')"""


def _asof(mode):
    def build(spark, sf):
        out = timeline.asof_index(
            _views(spark, sf), _purchases(spark, sf), USER, "t", "view_idx", "wanted", "purchase_id",
            mode=mode, on_empty="null",
        )
        return out.select(*USER, "purchase_id", "matched_idx", "matched_ts")

    return build


ASOF_SQL = f"WITH {VIEWS_SQL}," + """
f AS (SELECT a.*, v.view_idx AS f_idx, v.t AS f_t FROM asked a ASOF LEFT JOIN
      (SELECT user_id, t, max(view_idx) AS view_idx FROM views GROUP BY ALL) v
      ON a.user_id = v.user_id AND a.wanted >= v.t),
c AS (SELECT f.*, v.view_idx AS c_idx, v.t AS c_t FROM f ASOF LEFT JOIN
      (SELECT user_id, t, min(view_idx) AS view_idx FROM views GROUP BY ALL) v
      ON f.user_id = v.user_id AND f.wanted <= v.t)
SELECT user_id, purchase_id, {idx} AS matched_idx, {at} AS matched_ts FROM c"""
LATER = "(f_t IS NULL OR c_t - wanted < wanted - f_t)"


def gap_list(spark, sf):
    return timeline.find_gaps(frames(spark, sf), USER, "t", ["event_id"], delta=6 * HOUR)


GAPS_SQL = f"""
WITH {FRAMES_SQL}, s AS (
  SELECT user_id, t AS gap_start, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap_end
  FROM frames)
SELECT * FROM s WHERE gap_end - gap_start > {6 * HOUR}"""


def time_compaction(spark, sf):
    out = timeline.compact_time(frames(spark, sf), USER, "t", ["event_id"], delta=6 * HOUR)
    return out.select(*USER, "event_id", "compact_ts")


COMPACT_SQL = f"""
WITH {FRAMES_SQL}, s AS (
  SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS step FROM frames)
SELECT user_id, event_id, CAST(t - min(t) OVER (PARTITION BY user_id)
  - sum(CASE WHEN step > {6 * HOUR} THEN step ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS compact_ts
FROM s"""


def gap_trim(spark, sf):
    """Clicks and errors that fall strictly inside a pause between purchases."""
    rows = frames(spark, sf)
    bought = rows.filter("event_type = 'purchase'")
    gaps = timeline.find_gaps(bought, USER, "t", ["event_id"], delta=24 * HOUR)
    others = rows.filter("event_type <> 'purchase'").select(*USER, "event_id", "t", "event_type")
    return timeline.drop_in_gaps(others, gaps, USER, "t", "event_id")


TRIM_SQL = f"""
WITH {FRAMES_SQL}, g AS (
  SELECT user_id, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS e
  FROM frames WHERE event_type = 'purchase')
SELECT user_id, event_id, t, event_type FROM frames f WHERE event_type <> 'purchase'
  AND NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = f.user_id AND e - s > {24 * HOUR} AND s < f.t AND f.t < e)"""


def _spans(spark, sf):
    """Each event keeps its user busy for ``value`` times ten minutes."""
    return frames(spark, sf).select(
        *USER, F.col("t").alias("start"), (F.col("t") + F.round(F.col("value") * 600).cast("long") * 1_000_000).alias("end")
    )


def merged_spans(spark, sf):
    return intervals.merge_intervals(
        intervals.normalise_intervals(_spans(spark, sf), eps=0), USER, eps=0
    )


MERGED_SQL = FRAMES_SQL + """,
spans AS (SELECT user_id, t AS "start", t + CAST(round(value * 600) AS BIGINT) * 1000000 AS "end" FROM frames),
reach AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end"
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE "end" > "start"),
isl AS (SELECT *, sum((reach IS NULL OR "start" > reach)::INT)
        OVER (PARTITION BY user_id ORDER BY "start", "end") AS island FROM reach),
merged AS (SELECT user_id, min("start") AS "start", max("end") AS "end" FROM isl GROUP BY user_id, island)"""


def inverted_spans(spark, sf):
    """Idle time of each user between 0 and one day after the last event."""
    totals = frames(spark, sf).groupBy(*USER).agg((F.max("t") + 240 * HOUR).alias("total"))
    return intervals.invert_intervals(merged_spans(spark, sf), totals, USER, "total", eps=0)


INVERT_SQL = f"""
WITH {MERGED_SQL}, totals AS (SELECT user_id, max(t) + {240 * HOUR} AS total FROM frames GROUP BY ALL),
cuts AS (SELECT user_id, "end" AS a, "start" AS o FROM merged
  UNION ALL SELECT user_id, 0, -1 FROM totals),
n AS (SELECT c.user_id, a, coalesce(lead(o) OVER (PARTITION BY c.user_id ORDER BY o), total) AS b
  FROM cuts c JOIN totals t ON t.user_id = c.user_id)
SELECT user_id, a AS "start", b AS "end" FROM n WHERE b > a"""


def kept_ranges(spark, sf):
    """Time of each user outside the busy spans, without the first ten days and, for even users, the time from day 50 on."""
    totals = frames(spark, sf).groupBy(*USER).agg(F.min("t").alias("_from"), F.max("t").alias("_to"))
    base = totals.select(*USER, "_from", (F.col("_to") - F.col("_from") + 240 * HOUR).alias("total"))
    spans = _spans(spark, sf).join(base, USER).select(*USER, (F.col("end") - F.col("_from")).alias("start"), (F.col("start") - F.col("_from")).alias("end"))
    return intervals.kept_ranges(
        spans, base, USER, "total", F.lit(240 * HOUR), F.when(F.col("user_id") % 2 == 0, F.lit(1200 * HOUR)), eps=0
    )


KEPT_SQL = f"""
WITH {FRAMES_SQL}, base AS (SELECT user_id, min(t) AS t0, max(t) - min(t) + {240 * HOUR} AS total FROM frames GROUP BY ALL),
cut AS (SELECT user_id, least(greatest(a, 0), total) AS a, least(greatest(b, 0), total) AS b FROM (
  SELECT f.user_id, total, t - t0 AS a, t - t0 + CAST(round(value * 600) AS BIGINT) * 1000000 AS b FROM frames f JOIN base USING (user_id)
  UNION ALL SELECT user_id, total, 0, {240 * HOUR} FROM base
  UNION ALL SELECT user_id, total, least({1200 * HOUR}, total), greatest({1200 * HOUR}, total) FROM base WHERE user_id % 2 = 0)),
ends AS (SELECT user_id, b AS at FROM cut WHERE b > a UNION SELECT user_id, 0 FROM base),
gap AS (SELECT e.user_id, e.at AS a, coalesce((SELECT min(c.a) FROM cut c WHERE c.user_id = e.user_id AND c.b > c.a AND c.b > e.at), total) AS b
  FROM ends e JOIN base USING (user_id))
SELECT user_id, a AS "start", b AS "end" FROM gap WHERE b > a"""


def look_up_keyframes(spark, sf):
    """Orders ask for the n-th view of a user among every second event; some users have none, some numbers come twice."""
    kept = frames(spark, sf).withColumn("keyframe_idx", F.col("event_id") % 11)
    kept = sampling.with_position(kept.filter("event_id % 2 = 0"), USER, ["t", "event_id"], "frame_pos")
    users = F.col("o_custkey") % 150
    asked = table(spark, sf, "orders").select(users.cast("bigint").alias("user_id"), (F.col("o_orderkey") % 11).alias("keyframe_idx"), "o_orderkey")
    out = timeline.look_up_keyframes(
        asked, kept, USER, "keyframe_idx", "frame_pos", F.col("event_type") == "view", on_problem="null"
    )
    return out.select("o_orderkey", "user_id", "keyframe_idx", "frame_pos", "problem")


LOOK_UP_SQL = f"""
WITH {FRAMES_SQL}, k AS (SELECT user_id, event_id % 11 AS keyframe_idx, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS pos
  FROM frames WHERE event_id % 2 = 0),
n AS (SELECT user_id, keyframe_idx, count(*) AS n, min(pos) AS pos FROM k WHERE event_type = 'view' GROUP BY ALL)
SELECT o_orderkey, CAST(o_custkey % 150 AS BIGINT) AS user_id, o_orderkey % 11 AS keyframe_idx, CASE WHEN n = 1 THEN pos END AS frame_pos,
  CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' END AS problem
FROM orders LEFT JOIN n ON n.user_id = o_custkey % 150 AND n.keyframe_idx = o_orderkey % 11"""


def keep_windows(spark, sf):
    """Events inside the merged spans of purchases, with their offset in the span."""
    rows = frames(spark, sf)
    spans = rows.filter("event_type = 'purchase'").select(
        *USER, F.col("t").alias("start"), (F.col("t") + 12 * HOUR).alias("end")
    )
    merged = intervals.merge_intervals(spans, USER, eps=0)
    tagged = timeline.assign_interval(
        rows.select(*USER, "event_id", "t"), merged, USER, "t", "event_id", "start", "end"
    )
    return tagged.filter("start IS NOT NULL").select(
        *USER, "event_id", F.col("start").alias("window_start"), (F.col("t") - F.col("start")).alias("offset_us")
    )


KEEP_SQL = f"""
WITH {FRAMES_SQL}, spans AS (
  SELECT user_id, t AS s, t + {12 * HOUR} AS e FROM frames WHERE event_type = 'purchase'),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans),
i AS (SELECT *, sum((m IS NULL OR s > m)::INT) OVER (PARTITION BY user_id ORDER BY s) AS g FROM r),
w AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, g)
SELECT f.user_id, event_id, s AS window_start, t - s AS offset_us
FROM frames f JOIN w ON w.user_id = f.user_id AND t >= s AND t < e"""


def exclusive_match(spark, sf):
    """Purchases take the next unused view, one each."""
    out = timeline.match_exclusive(
        _purchases(spark, sf), _views(spark, sf), USER, "t", "view_idx", "wanted", "purchase_id"
    )
    return out.select(*USER, "purchase_id", "matched_idx")


EXCLUSIVE_SQL = f"WITH {VIEWS_SQL}," + """
c AS (SELECT a.*, v.view_idx AS c_idx FROM asked a ASOF JOIN
      (SELECT user_id, t, min(view_idx) AS view_idx FROM views GROUP BY ALL) v
      ON a.user_id = v.user_id AND a.wanted <= v.t),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY wanted, purchase_id) AS k FROM c),
m AS (SELECT user_id, purchase_id, max(c_idx - k) OVER (PARTITION BY user_id ORDER BY wanted, purchase_id) + k AS matched_idx FROM k)
SELECT m.* FROM m JOIN (SELECT user_id, max(view_idx) AS last FROM views GROUP BY ALL) l
  ON l.user_id = m.user_id WHERE matched_idx <= last"""


def increasing_repair(spark, sf):
    """Whole hours of each user's events made strictly increasing."""
    rows = frames(spark, sf).select(*USER, "event_id", "t", F.expr(f"t div {HOUR}").alias("hour"))
    out = timeline.strictly_increasing(rows, USER, ["t", "event_id"], "hour", "repaired")
    return out.select(*USER, "event_id", "repaired")


INCREASING_SQL = f"""
WITH {FRAMES_SQL}, k AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM frames)
SELECT user_id, event_id,
  max(t // {HOUR} - k) OVER (PARTITION BY user_id ORDER BY t, event_id) + k AS repaired FROM k"""


def between_frames(spark, sf):
    """Events of the first ten days of January, half-open."""
    start = 1_704_067_200_000_000
    return timeline.frames_between(frames(spark, sf), "t", start, delta=240 * HOUR).select(
        *USER, "event_id", "t"
    )


BETWEEN_SQL = f"""WITH {FRAMES_SQL} SELECT user_id, event_id, t FROM frames
WHERE t >= 1704067200000000 AND t < 1704067200000000 + {240 * HOUR}"""


def time_bounds(spark, sf):
    out = timeline.frame_time_bounds(frames(spark, sf), USER, "value", "event_id")
    return rounded(out)


BOUNDS_SQL = f"""WITH {FRAMES_SQL} SELECT user_id, round(arg_min(value, event_id), 6) AS first_ts,
  round(arg_max(value, event_id), 6) AS last_ts FROM frames GROUP BY user_id"""


def raw_frame_map(spark, sf):
    """Every view, as a key-frame request, mapped to its raw event."""
    rows = frames(spark, sf)
    key = _views(spark, sf)
    asked = key.select(
        *USER, "view_idx", F.concat_ws("-", "user_id", "view_idx").alias("request_id")
    )
    placed = sampling.with_position(rows.select(*USER, "event_id", "t"), USER, ["t", "event_id"], "raw_idx")
    out = timeline.map_to_raw(
        asked, key, placed.withColumn("t", F.col("t").cast("double")), USER, "request_id",
        "view_idx", "t", "t", "raw_idx",
    )
    return out.select(*USER, "view_idx", F.col("matched_idx").alias("raw_idx"))


RAW_SQL = f"WITH {VIEWS_SQL}," + """
p AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS raw_idx FROM frames)
SELECT v.user_id, view_idx, min(raw_idx) AS raw_idx FROM views v JOIN p ON p.user_id = v.user_id AND p.t = v.t
GROUP BY ALL"""

# --- sub-sampling -----------------------------------------------------------

PLACED_SQL = FRAMES_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS global_idx,
                  count(*) OVER (PARTITION BY user_id) AS n FROM frames)"""


def _placed(spark, sf):
    return sampling.with_position(
        frames(spark, sf).select(*USER, "event_id", "t", "event_type"), USER, ["t", "event_id"], size="n"
    )


def subsample_keep(spark, sf):
    """Every fourth event, all purchases and the last event; then re-indexed."""
    kept = sampling.subsample(
        _placed(spark, sf), 4, F.col("event_type") == "purchase", retain=[-1], size="n"
    )
    out = sampling.with_position(kept, USER, ["t", "event_id"], "subsampled_idx")
    return out.select(*USER, "event_id", "global_idx", "subsampled_idx")


SUBSAMPLE_SQL = f"""
WITH {PLACED_SQL}
SELECT user_id, event_id, global_idx,
  row_number() OVER (PARTITION BY user_id ORDER BY global_idx) - 1 AS subsampled_idx
FROM placed WHERE global_idx % 4 = 0 OR event_type = 'purchase' OR global_idx = n - 1"""


def logical_slice(spark, sf):
    """Rows [2:-3] of each user's stream."""
    return sampling.row_slice(_placed(spark, sf), 2, -3, size="n").select(*USER, "event_id", "global_idx")


SLICE_SQL = f"""WITH {PLACED_SQL} SELECT user_id, event_id, global_idx FROM placed
WHERE global_idx >= 2 AND global_idx < n - 3"""


def stepped_frames(spark, sf):
    return sampling.select_frames(_placed(spark, sf), "global_idx", start=3, step=5, n=6).select(
        *USER, "event_id", "global_idx"
    )


STEPPED_SQL = f"""WITH {PLACED_SQL} SELECT user_id, event_id, global_idx FROM placed
WHERE global_idx >= 3 AND (global_idx - 3) % 5 = 0 AND global_idx < 33"""


def _sampled(mode, preserve=0):
    def build(spark, sf):
        out = sampling.sample_uniform(
            frames(spark, sf).select(*USER, "event_id", "t"), USER, ["t", "event_id"], 16, mode, preserve
        )
        return out.select(*USER, "event_id", "sample_no", "global_idx")

    return build


def _sample_sql(position: str, count: str = "16", preserve: int = 0) -> str:
    rest, head = f"(n - {preserve})", ""
    if preserve:
        head = f" UNION ALL SELECT user_id, i, i FROM sizes, range({preserve}) r(i) WHERE i < n"
    return f"""
WITH {PLACED_SQL}, sizes AS (SELECT user_id, count(*) AS n FROM frames GROUP BY ALL),
wanted AS (SELECT user_id, i + {preserve} AS sample_no, CAST({position.format(n=rest)} AS BIGINT) + {preserve} AS global_idx
  FROM sizes, range(64) r(i) WHERE i < {count.format(n=rest)} AND {rest} > 0{head})
SELECT p.user_id, event_id, sample_no, global_idx FROM placed p JOIN wanted USING (user_id, global_idx)"""




def linspace_sql(k: int) -> str:
    return "CASE WHEN i = %d THEN {n} - 1 ELSE floor(i * (({n} - 1) / CAST(%d AS DOUBLE))) END" % (k - 1, k - 1)


def _forced(keep_forced: bool):
    def build(spark, sf):
        out = sampling.sample_with_forced(
            frames(spark, sf).select(*USER, "event_id", "t", "event_type"), USER, ["t", "event_id"], 16,
            F.col("event_type") == "purchase", keep_forced=keep_forced,
        )
        return out.select(*USER, "event_id", "global_idx")

    build.__doc__ = "Sixteen spread events and all purchases" + ("." if keep_forced else ", cut to the first sixteen.")
    return build


FORCED_SQL = f"""
WITH {PLACED_SQL}, sizes AS (SELECT user_id, count(*) AS n FROM frames GROUP BY ALL),
wanted AS (SELECT DISTINCT user_id, CAST({linspace_sql(16).format(n='n')} AS BIGINT) AS global_idx FROM sizes, range(16) r(i)),
u AS (SELECT p.*, row_number() OVER (PARTITION BY p.user_id ORDER BY p.global_idx) AS place
  FROM placed p LEFT JOIN wanted w ON w.user_id = p.user_id AND w.global_idx = p.global_idx
  WHERE event_type = 'purchase' OR w.user_id IS NOT NULL)
SELECT user_id, event_id, global_idx FROM u WHERE place <= 16"""

KEPT_FORCED_SQL = FORCED_SQL.replace(
    "ORDER BY p.global_idx", "ORDER BY event_type <> 'purchase', p.global_idx"
).replace("SELECT p.*,", "SELECT p.*, event_type = 'purchase' AS bought,").replace("place <= 16", "place <= 16 OR bought")


def segment_sample(spark, sf):
    """Centres of eight segments of each user's stream."""
    sizes = frames(spark, sf).groupBy(*USER).agg(F.count(F.lit(1)).alias("n"))
    return sampling.segment_positions(sizes, USER, 8, F.lit(1.0))


SEGMENT_SQL = f"""
WITH {FRAMES_SQL}, sizes AS (SELECT user_id, CAST(count(*) - 1 AS DOUBLE) / 8 AS w FROM frames GROUP BY ALL)
SELECT user_id, i AS sample_no, CAST(floor(w / 2 + round_even(w * i, 0)) AS BIGINT) AS global_idx
FROM sizes, range(8) r(i)"""


def _chunks(in_budget):
    def build(spark, sf):
        out = sampling.chunk(_placed(spark, sf), 16, 3, in_budget)
        return out.select(*USER, "event_id", "clip_idx", "clip_pos", "is_overlap")

    return build


CHUNK_SQL = f"""
WITH {PLACED_SQL}, clips AS (
  SELECT user_id, event_id, global_idx, c AS clip_idx,
    CASE WHEN c = 0 THEN 0 ELSE c * {{step}} + {{lead}} END AS fresh
  FROM placed, LATERAL (SELECT unnest(range(0, n // {{step}} + 2)) AS c)
  WHERE global_idx >= CASE WHEN c = 0 THEN 0 ELSE c * {{step}} + {{lead}} - 3 END
    AND global_idx < (c + 1) * {{step}} + {{lead}}
    AND CASE WHEN c = 0 THEN 0 ELSE c * {{step}} + {{lead}} END < n)
SELECT user_id, event_id, clip_idx,
  global_idx - fresh + CASE WHEN clip_idx = 0 THEN 0 ELSE 3 END AS clip_pos, global_idx < fresh AS is_overlap
FROM clips"""


def stitched(spark, sf):
    """Chunk, stitch back, and compare with what was expected per user."""
    placed = _placed(spark, sf)
    tracks = sampling.stitch(sampling.chunk(placed, 16, 3), 16, 3)
    expected = frames(spark, sf).groupBy(*USER).agg(F.count(F.lit(1)).alias("n"))
    checked = sampling.check_complete(tracks, expected, USER)
    bounds = sampling.predict_clips(expected, 16, 3).select(*USER, "predicted_clips")
    same = tracks.groupBy(*USER).agg(F.count_if(F.col("frame_idx") == F.col("global_idx")).alias("in_place"))
    return checked.join(bounds, USER).join(same, USER)


STITCH_SQL = f"""WITH {FRAMES_SQL} SELECT user_id, count(*) AS expected, count(*) AS stored, true AS complete,
  CAST(ceil(count(*) / 13.0) AS BIGINT) AS predicted_clips, count(*) AS in_place FROM frames GROUP BY user_id"""


def _asked_frames(spark, sf):
    """Each event asks for the frames of its own and the next day."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("ordinal"),
        F.col("event_id").alias("question_no"),
        F.expr("array(dayofyear(ts), dayofyear(ts) + 1)").alias("frame_idx"),
    )


def prompt_plan(spark, sf):
    return sampling.plan_prompts(_asked_frames(spark, sf))


PROMPT_SQL = """
WITH q AS (SELECT user_id AS video_id, event_id, unnest([dayofyear(ts), dayofyear(ts) + 1]) AS frame FROM events)
SELECT video_id, CAST(frame AS INTEGER) AS frame, min(event_id) AS owner FROM q GROUP BY ALL"""


def keep_set(spark, sf):
    return sampling.keep_sets(_asked_frames(spark, sf))


KEEPSET_SQL = """
SELECT DISTINCT user_id AS video_id, CAST(unnest([dayofyear(ts), dayofyear(ts) + 1]) AS INTEGER) AS frame FROM events"""


def key_restriction(spark, sf):
    """Pages of the wanted hosts, and how many wanted hosts have none."""
    pages = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host")
    )
    kept, missing = sampling.restrict_keys(pages, "host", include=["m.*.example.net", "www.*", "nobody.org"])
    found = kept.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(missing.select(F.col("entry").alias("host"), F.lit(0).cast("long").alias("n")))


RESTRICT_SQL = r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
e(entry, pat) AS (VALUES ('m.*.example.net', '^m\.[^/]*\.example\.net$'), ('www.*', '^www\.[^/]*$'), ('nobody.org', '^nobody\.org$'))
SELECT host, count(*) AS n FROM h WHERE EXISTS (SELECT 1 FROM e WHERE regexp_matches(host, pat)) GROUP BY host
UNION ALL SELECT entry, 0 FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE regexp_matches(host, pat))"""

QUERIES = {
    "asof_floor": Query(_asof("floor"), ASOF_SQL.format(idx="coalesce(f_idx, c_idx)", at="coalesce(f_t, c_t)")),
    "asof_ceil": Query(_asof("ceil"), ASOF_SQL.format(idx="coalesce(c_idx, f_idx)", at="coalesce(c_t, f_t)")),
    "asof_nearest": Query(
        _asof("nearest"),
        ASOF_SQL.format(
            idx=f"CASE WHEN {LATER} THEN c_idx ELSE (SELECT min(view_idx) FROM views w WHERE w.user_id = c.user_id AND w.t = f_t) END",
            at=f"CASE WHEN {LATER} THEN c_t ELSE f_t END",
        ),
    ),
    "gap_list": Query(gap_list, GAPS_SQL),
    "time_compaction": Query(time_compaction, COMPACT_SQL),
    "gap_trim": Query(gap_trim, TRIM_SQL),
    "merge_intervals": Query(merged_spans, f"WITH {MERGED_SQL} SELECT * FROM merged"),
    "invert_intervals": Query(inverted_spans, INVERT_SQL),
    "kept_ranges": Query(kept_ranges, KEPT_SQL),
    "look_up_keyframes": Query(look_up_keyframes, LOOK_UP_SQL),
    "keep_windows": Query(keep_windows, KEEP_SQL),
    "exclusive_match": Query(exclusive_match, EXCLUSIVE_SQL),
    "increasing_repair": Query(increasing_repair, INCREASING_SQL),
    "frames_between": Query(between_frames, BETWEEN_SQL),
    "frame_time_bounds": Query(time_bounds, BOUNDS_SQL),
    "raw_frame_map": Query(raw_frame_map, RAW_SQL),
    "subsample_keep": Query(subsample_keep, SUBSAMPLE_SQL),
    "logical_slice": Query(logical_slice, SLICE_SQL),
    "stepped_frames": Query(stepped_frames, STEPPED_SQL),
    "uniform_sample": Query(_sampled("linspace"), _sample_sql(linspace_sql(16))),
    "prefix_sample": Query(_sampled("linspace", 2), _sample_sql(linspace_sql(14), "14", 2)),
    "centre_sample": Query(_sampled("centre"), _sample_sql("floor({n} / 16.0::DOUBLE * (i + 0.5::DOUBLE))")),
    "stride_sample": Query(
        _sampled("stride"),
        _sample_sql(
            "floor(i * ({n} / CAST(least({n}, 16) AS DOUBLE)))",
            "ceil({n} / ({n} / CAST(least({n}, 16) AS DOUBLE)))",
        ),
    ),
    "segment_sample": Query(segment_sample, SEGMENT_SQL),
    "uniform_forced": Query(_forced(False), FORCED_SQL),
    "uniform_forced_kept": Query(_forced(True), KEPT_FORCED_SQL),
    "clip_chunks_a": Query(_chunks(False), CHUNK_SQL.format(step=16, lead=0)),
    "clip_chunks_b": Query(_chunks(True), CHUNK_SQL.format(step=13, lead=3)),
    "stitch_clips": Query(stitched, STITCH_SQL),
    "prompt_plan": Query(prompt_plan, PROMPT_SQL),
    "keep_set": Query(keep_set, KEEPSET_SQL),
    "key_restriction": Query(key_restriction, RESTRICT_SQL),
}
