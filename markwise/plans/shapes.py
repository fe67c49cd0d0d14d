"""Mask, graph and colour queries.

A vector's 64 signs are an 8 x 8 mask; ten neighbouring vectors share a frame.
In the part graph the nations are the parts of one piece of furniture, those of
a region are connected, and an order shows the nations of its suppliers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise.functions import rle
from markwise.operators import colours, graph, masks
from markwise.plans.catalog import Query, rounded, table
from markwise.session import spread

FRAME = ["frame_idx"]


def mask_rows(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id div 10").alias("frame_idx"), F.col("vec_id").alias("part_id"),
        F.lit(8).alias("h"), F.lit(8).alias("w"),
        rle.runs_from_bits(F.transform("embedding", lambda x: (x > 0).cast("int"))).alias("runs"),
    )


MASKS_SQL = """masks AS (SELECT vec_id // 10 AS frame_idx, vec_id AS part_id, embedding AS e,
  len(list_filter(embedding, lambda x: x > 0)) AS area FROM embeddings)"""


def mask_visibility(spark, sf):
    return masks.visible_parts(mask_rows(spark, sf), 0.5).select("frame_idx", "part_id", "area")


def candidate_frames(spark, sf):
    return masks.candidate_frames(mask_rows(spark, sf), FRAME, min_parts=4, min_area=32)


def mask_iou(spark, sf):
    rows = mask_rows(spark, sf)
    return rounded(masks.overlapping_masks(rows, rows, FRAME, iou_threshold=0.4, once=True))


IOU_SQL = f"""
WITH {MASKS_SQL}, p AS (
  SELECT a.frame_idx, a.part_id AS part_id_a, b.part_id AS part_id_b, a.area AS x, b.area AS y,
    len(list_filter(range(1, 65), lambda i: a.e[i] > 0 AND b.e[i] > 0)) AS overlap
  FROM masks a JOIN masks b ON a.frame_idx = b.frame_idx AND a.part_id < b.part_id)
SELECT frame_idx, part_id_a, part_id_b, overlap, round(overlap / (x + y - overlap), 6) AS iou
FROM p WHERE overlap / (x + y - overlap) >= 0.4"""


def _boxes(spark, sf):
    """Each customer as a rectangle in a full HD frame of eight."""
    rows = spread(table(spark, sf, "customer"), "c_custkey").select(
        F.expr("c_custkey div 8").alias("frame_idx"), F.col("c_custkey").alias("part_id"), F.lit(1080).alias("h"), F.lit(1920).alias("w"),
        F.expr("cast(c_custkey * 37 % 300 as int)").alias("x"), F.expr("cast(c_nationkey * 17 % 200 as int)").alias("y"),
        F.expr("cast(300 + floor(abs(c_acctbal)) % 900 as int)").alias("dx"), F.expr("cast(200 + floor(abs(c_acctbal)) % 500 as int)").alias("dy"),
    )
    columns = "flatten(array_repeat(array(dy, h - dy), dx - 1))"
    return rows.withColumn("runs", F.expr(f"concat(array(x * h + y), {columns}, array(dy, h * w - (x + dx - 1) * h - y - dy))"))


def mask_iou_hd(spark, sf):
    """Rectangles of one full HD frame that share at least half of their union."""
    rows = _boxes(spark, sf).select("frame_idx", "part_id", "h", "w", "runs")
    return rounded(masks.overlapping_masks(rows, rows, FRAME, iou_threshold=0.5, once=True))


IOU_HD_SQL = """
WITH m AS (SELECT c_custkey // 8 AS frame_idx, c_custkey AS part_id, c_custkey * 37 % 300 AS x, c_nationkey * 17 % 200 AS y,
    CAST(300 + floor(abs(c_acctbal)) % 900 AS BIGINT) AS dx, CAST(200 + floor(abs(c_acctbal)) % 500 AS BIGINT) AS dy FROM customer),
p AS (SELECT a.frame_idx, a.part_id AS part_id_a, b.part_id AS part_id_b, a.dx * a.dy + b.dx * b.dy AS total,
    greatest(0, least(a.x + a.dx, b.x + b.dx) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.dy, b.y + b.dy) - greatest(a.y, b.y)) AS overlap
  FROM m a JOIN m b ON a.frame_idx = b.frame_idx AND a.part_id < b.part_id)
SELECT frame_idx, part_id_a, part_id_b, overlap, round(overlap / (total - overlap), 6) AS iou FROM p WHERE overlap / (total - overlap) >= 0.5"""


def rle_round_trip(spark, sf):
    """Compressed counts written and read back; area and run count stay."""
    packed = mask_rows(spark, sf).withColumn("counts", rle.encode_counts("runs"))
    back = packed.withColumn("back", rle.decode_counts("counts"))
    return back.select(
        "part_id", rle.mask_area(F.col("back")).alias("area"), (F.col("back") == F.col("runs")).alias("same")
    )


def _supplier_masks(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("part_id"), F.col("l_linenumber").alias("frame"),
    ).withColumn("is_last", F.col("frame") > 3)


def _remap(direction):
    def build(spark, sf):
        mapping = table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("part_id"),
            F.when(F.col("s_acctbal") > 0, F.col("s_suppkey") * 3 + 1).alias("display_id"),
        ).filter("display_id IS NOT NULL")
        out = masks.remap_parts(_supplier_masks(spark, sf), mapping, direction, applies="is_last")
        return out.groupBy("part_id", "is_last").agg(F.count(F.lit(1)).alias("n"))

    return build


REMAP_SQL = """
WITH m AS (SELECT s_suppkey AS part_id, s_suppkey * 3 + 1 AS display_id FROM supplier WHERE s_acctbal > 0),
r AS (SELECT l_linenumber > 3 AS is_last, CASE WHEN l_linenumber > 3 THEN m.{new} ELSE l_suppkey END AS part_id
  FROM lineitem LEFT JOIN m ON m.{old} = l_suppkey)
SELECT part_id, is_last, count(*) AS n FROM r WHERE part_id IS NOT NULL GROUP BY ALL"""

# --- part graph -----------------------------------------------------------------


def edges(spark, sf):
    """Nations of one region are connected."""
    nation = table(spark, sf, "nation").select(
        F.lit("world").alias("furniture_id"), F.col("n_nationkey").cast("string").alias("part_id"),
        F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("g"),
    )
    a = nation.select("furniture_id", F.col("part_id").alias("src"), F.col("k").alias("ka"), "g")
    b = nation.select("furniture_id", F.col("part_id").alias("dst"), F.col("k").alias("kb"), "g")
    return a.join(b, ["furniture_id", "g"]).filter("ka <> kb").select("furniture_id", "src", "dst")


def frame_parts(spark, sf):
    """Nations of the suppliers of an order's lines; their area is the summed quantity."""
    supplier = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("part_id")
    )
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")
    )
    return (
        lines.join(supplier, "l_suppkey")
        .groupBy(F.col("l_orderkey").alias("frame_idx"), "part_id")
        .agg(F.sum("q").cast("long").alias("area"), F.sum("n").alias("subasm_size"))
        .withColumn("furniture_id", F.lit("world"))
    )


GRAPH_SQL = """
edges AS (SELECT CAST(a.n_nationkey AS VARCHAR) AS src, CAST(b.n_nationkey AS VARCHAR) AS dst,
    a.n_nationkey AS ka, b.n_nationkey AS kb
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
fp AS (SELECT l_orderkey AS frame_idx, CAST(s_nationkey AS VARCHAR) AS part_id, s_nationkey AS k,
    CAST(sum(l_quantity) AS BIGINT) AS area, count(*) AS subasm_size
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"""


def visible_edges(spark, sf):
    return graph.visible_edges(frame_parts(spark, sf), edges(spark, sf), FRAME).select("frame_idx", "src", "dst")


VISIBLE_SQL = f"""WITH {GRAPH_SQL}
SELECT a.frame_idx, e.src, e.dst FROM fp a JOIN edges e ON e.src = a.part_id AND ka < kb
JOIN fp b ON b.frame_idx = a.frame_idx AND b.part_id = e.dst"""


def non_edges(spark, sf):
    return graph.non_edges(frame_parts(spark, sf), edges(spark, sf), FRAME).select("frame_idx", "src", "dst")


NON_EDGES_SQL = f"""WITH {GRAPH_SQL}
SELECT a.frame_idx, a.part_id AS src, b.part_id AS dst FROM fp a JOIN fp b ON b.frame_idx = a.frame_idx AND a.k < b.k
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.part_id AND e.dst = b.part_id)"""


def part_neighbours(spark, sf):
    """How many visible parts of each shown part are connected to it, and how many not."""
    rows = graph.with_neighbours(frame_parts(spark, sf), edges(spark, sf), FRAME)
    return rows.select(
        "frame_idx", "part_id", F.size("connected").alias("n_connected"), F.size("unconnected").alias("n_unconnected")
    )


NEIGHBOURS_SQL = f"""WITH {GRAPH_SQL}, c AS (
  SELECT a.frame_idx, a.part_id, CAST(count(e.src) AS INTEGER) AS n_connected, CAST(count(*) AS INTEGER) AS n
  FROM fp a JOIN fp b ON b.frame_idx = a.frame_idx
  LEFT JOIN edges e ON e.src = a.part_id AND e.dst = b.part_id GROUP BY ALL)
SELECT frame_idx, part_id, n_connected, n - 1 - n_connected AS n_unconnected FROM c"""


def graph_symmetry(spark, sf):
    """Edges seen from both sides, and asymmetric ones among supplier-customer routes."""
    routes = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
        .join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .select(F.lit("world").alias("furniture_id"), F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst"))
        .distinct()
    )
    return graph.asymmetric_edges(routes).select("src", "dst")


SYMMETRY_SQL = """
WITH r AS (SELECT DISTINCT l_suppkey AS src, o_custkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT src, dst FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.src = r.dst AND b.dst = r.src)"""


def clean_pairs(spark, sf):
    """Pairs (supplier, part) of each line as reported ends; known ends are the suppliers."""
    pairs = table(spark, sf, "lineitem").select(
        F.lit("all").alias("g"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 500).alias("dst")
    )
    known = table(spark, sf, "supplier").select(F.lit("all").alias("g"), F.col("s_suppkey").alias("part_id"))
    return graph.clean_pairs(pairs, known, ["g"]).select("src", "dst")


CLEAN_SQL = """
SELECT DISTINCT least(l_suppkey, l_partkey % 500) AS src, greatest(l_suppkey, l_partkey % 500) AS dst FROM lineitem
WHERE l_suppkey <> l_partkey % 500 AND l_partkey % 500 IN (SELECT s_suppkey FROM supplier)
  AND l_suppkey IN (SELECT s_suppkey FROM supplier)"""


def _picked(strategy):
    def build(spark, sf):
        return graph.pick_parts(frame_parts(spark, sf), FRAME, strategy, 3).select("frame_idx", "part_id", "pick")

    return build


PICK_SQL = f"""WITH {GRAPH_SQL}, r AS (SELECT frame_idx, part_id,
  row_number() OVER (PARTITION BY frame_idx ORDER BY {{by}}, k) - 1 AS pick FROM fp)
SELECT * FROM r WHERE pick < 3"""


def picked_pairs(spark, sf):
    return graph.pick_pairs(frame_parts(spark, sf), FRAME, "size_h2l", 3).select(
        "frame_idx", "part_a", "part_b", "pick"
    )


PAIRS_SQL = f"""WITH {GRAPH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY area DESC, k) AS rk FROM fp),
p AS (SELECT a.frame_idx, a.part_id AS part_a, b.part_id AS part_b,
  row_number() OVER (PARTITION BY a.frame_idx ORDER BY a.area + b.area DESC, a.rk, b.rk) - 1 AS pick
  FROM r a JOIN r b ON b.frame_idx = a.frame_idx AND a.rk < b.rk)
SELECT * FROM p WHERE pick < 3"""

# --- colours --------------------------------------------------------------------

def _colours(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("label"), F.col("vec_id").alias("ord"),
        *[F.round((F.col("embedding")[i].cast("double") + 1) / 2, 6).alias(c) for i, c in enumerate("rgb")],
    )


def _maxmin(metric):
    def build(spark, sf):
        cand = _colours(spark, sf)
        means = cand.groupBy("label").agg(*[F.round(F.avg(c), 6).alias(c) for c in "rgb"])
        refs = means.unionByName(means.withColumn("label", ((F.col("label") + 1) % 10).cast("int")))
        out = colours.maxmin_pick(cand, refs, ["label"], "ord", metric)
        return rounded(out.select("label", "ord", "min_distance"), 5)

    return build


def maxmin_rounds(spark, sf):
    """Three colours one after the other, each far from the references and the earlier picks."""
    cand = _colours(spark, sf)
    means = cand.groupBy("label").agg(*[F.round(F.avg(c), 6).alias(c) for c in "rgb"])
    out = colours.maxmin_pick(cand, means, ["label"], "ord", "lab", rounds=3, candidate_block=64)
    return rounded(out.select("label", "round", "ord", "min_distance"), 5)


def _lab_sql(p):
    lin = lambda c: f"CASE WHEN {p}.{c} <= 0.04045 THEN {p}.{c} / 12.92 ELSE pow(({p}.{c} + 0.055) / 1.055, 2.4) END"
    rows = (
        ("x", (0.412453, 0.357580, 0.180423), 0.95047),
        ("y", (0.212671, 0.715160, 0.072169), 1.0),
        ("z", (0.019334, 0.119193, 0.950227), 1.08883),
    )
    axes = []
    for name, row, white in rows:
        t = "(" + " + ".join(f"{w} * ({lin(c)})" for c, w in zip("rgb", row)) + f") / {white}"
        axes.append(f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0 / 3.0) ELSE 7.787 * ({t}) + 16.0 / 116.0 END AS {name}")
    return ", ".join(axes)


COLOUR_SQL = """c AS (SELECT label AS g, vec_id AS ord, round((CAST(embedding[1] AS DOUBLE) + 1) / 2, 6) AS r,
  round((CAST(embedding[2] AS DOUBLE) + 1) / 2, 6) AS g2, round((CAST(embedding[3] AS DOUBLE) + 1) / 2, 6) AS b FROM embeddings),
cc AS (SELECT g AS grp, ord, r, g2 AS g, b FROM c),
m AS (SELECT grp, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM cc GROUP BY grp),
refs AS (SELECT * FROM m UNION ALL SELECT (grp + 1) % 10, r, g, b FROM m)"""
MAXMIN_LAB_SQL = f"""
WITH {COLOUR_SQL}, cl AS (SELECT grp, ord, {_lab_sql('cc')} FROM cc), rl AS (SELECT grp, {_lab_sql('refs')} FROM refs),
d AS (SELECT cl.grp, ord, min(sqrt(pow(116 * (cl.y - rl.y), 2) + pow(500 * ((cl.x - cl.y) - (rl.x - rl.y)), 2)
   + pow(200 * ((cl.y - cl.z) - (rl.y - rl.z)), 2))) AS dist FROM cl JOIN rl ON rl.grp = cl.grp GROUP BY ALL)
SELECT CAST(grp AS INTEGER) AS label, ord, round(dist, 5) AS min_distance FROM d
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY dist DESC, ord) = 1"""
_LAB_DISTANCE = """sqrt(pow(116 * (p.y - q.y), 2) + pow(500 * ((p.x - p.y) - (q.x - q.y)), 2)
   + pow(200 * ((p.y - p.z) - (q.y - q.z)), 2))"""


def _rounds_sql(n):
    steps = [
        f"""p{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY dist DESC, ord) = 1),
d{i + 1} AS (SELECT p.grp, p.ord, p.x, p.y, p.z, least(p.dist, {_LAB_DISTANCE}) AS dist FROM d{i} p JOIN p{i} q ON q.grp = p.grp)"""
        for i in range(n)
    ]
    rows = " UNION ALL ".join(f"SELECT grp, {i} AS round, ord, dist FROM p{i}" for i in range(n))
    return f"""
WITH {COLOUR_SQL}, cl AS (SELECT grp, ord, {_lab_sql('cc')} FROM cc), rl AS (SELECT grp, {_lab_sql('m')} FROM m),
d0 AS (SELECT p.grp, p.ord, p.x, p.y, p.z, min({_LAB_DISTANCE}) AS dist FROM cl p JOIN rl q ON q.grp = p.grp GROUP BY ALL),
{", ".join(steps)}
SELECT CAST(grp AS INTEGER) AS label, CAST(round AS INTEGER) AS round, ord, round(dist, 5) AS min_distance FROM ({rows})"""


_LUM = " + ".join(
    f"{w} * (CASE WHEN {{p}}.{c} <= 0.03928 THEN {{p}}.{c} / 12.92 ELSE pow(({{p}}.{c} + 0.055) / 1.055, 2.4) END)"
    for c, w in zip("rgb", (0.2126, 0.7152, 0.0722))
)
MAXMIN_WCAG_SQL = f"""
WITH {COLOUR_SQL}, cl AS (SELECT grp, ord, {_LUM.format(p='cc')} AS l FROM cc), rl AS (SELECT grp, {_LUM.format(p='refs')} AS l FROM refs),
d AS (SELECT cl.grp, ord, min((greatest(cl.l, rl.l) + 0.05) / (least(cl.l, rl.l) + 0.05)) AS dist FROM cl JOIN rl ON rl.grp = cl.grp GROUP BY ALL)
SELECT CAST(grp AS INTEGER) AS label, ord, round(dist, 5) AS min_distance FROM d
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY dist DESC, ord) = 1"""

QUERIES = {
    "mask_visibility": Query(
        mask_visibility, f"WITH {MASKS_SQL} SELECT frame_idx, part_id, area FROM masks WHERE area / 64 > 0.5"
    ),
    "candidate_frames": Query(
        candidate_frames,
        f"WITH {MASKS_SQL} SELECT frame_idx, count(*) AS n_parts FROM masks WHERE area > 32 GROUP BY 1 HAVING count(*) >= 4",
    ),
    "mask_iou": Query(mask_iou, IOU_SQL),
    "mask_iou_hd": Query(mask_iou_hd, IOU_HD_SQL),
    "rle_round_trip": Query(
        rle_round_trip, f"WITH {MASKS_SQL} SELECT part_id, area, true AS same FROM masks"
    ),
    "remap_forward": Query(_remap("forward"), REMAP_SQL.format(old="part_id", new="display_id")),
    "remap_inverse": Query(_remap("inverse"), REMAP_SQL.format(old="display_id", new="part_id")),
    "visible_edges": Query(visible_edges, VISIBLE_SQL),
    "non_edges": Query(non_edges, NON_EDGES_SQL),
    "part_neighbours": Query(part_neighbours, NEIGHBOURS_SQL),
    "graph_symmetry": Query(graph_symmetry, SYMMETRY_SQL),
    "clean_pairs": Query(clean_pairs, CLEAN_SQL),
    "pick_parts_area": Query(_picked("size_h2l"), PICK_SQL.format(by="area DESC")),
    "pick_parts_subassembly": Query(_picked("subasm"), PICK_SQL.format(by="subasm_size")),
    "pick_pairs": Query(picked_pairs, PAIRS_SQL),
    "maxmin_pick_lab": Query(_maxmin("lab"), MAXMIN_LAB_SQL),
    "maxmin_pick_rounds": Query(maxmin_rounds, _rounds_sql(3)),
    "maxmin_pick_contrast": Query(_maxmin("wcag"), MAXMIN_WCAG_SQL),
}
