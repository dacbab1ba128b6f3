"""Queries over cameras: how they agree along edges, how they lie to each other, where tracks come and go, how corrections do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cameras as C
from ..operators.quantiles import exact_quantiles
from ..sources.views import BANK, bank, table
from .links import MAT
from .registry import query

_LINES = """pts AS (SELECT 'c' || (o_custkey % 6) AS camera_id, 'e' || (l_suppkey % 23 + (o_custkey % 6) * 9) AS edge, l_extendedprice::DOUBLE / 50 AS u, l_quantity::DOUBLE * 20 AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
cam AS (SELECT 'c' || k AS camera_id, 1.0 + k / 10.0 AS a, k / 100.0 AS b, 5.0 * k AS c, 0.9 AS d, 1e-4 * k AS p FROM (SELECT DISTINCT o_custkey % 6 AS k FROM orders)),
edges AS (SELECT 'e' || s_suppkey AS edge, s_suppkey * 10.0 AS x1, s_suppkey * 3.0 AS y1, s_suppkey * 10.0 + s_suppkey % 4 * 300 AS x2, s_suppkey * 3.0 + s_suppkey % 4 * 200 AS y2 FROM supplier),
g AS (SELECT *, (a * u + b * v + c) / (p * u + 1) AS x, (b * u + d * v) / (p * u + 1) AS y FROM pts JOIN cam USING (camera_id) JOIN edges USING (edge) WHERE u BETWEEN 0 AND 1500 AND v BETWEEN 0 AND 900),
err AS (SELECT camera_id, edge, sqrt(power(x - (x1 + t * (x2 - x1)), 2) + power(y - (y1 + t * (y2 - y1)), 2)) AS e
  FROM (SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) END AS t FROM g))"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    k, n = F.col("o_custkey") % 6, F.col("s_suppkey").cast("double")
    name = lambda c, p: F.concat(F.lit(p), c.cast("string"))
    points = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(name(k, "c").alias("camera_id"), name(F.col("l_suppkey") % 23 + k * 9, "e").alias("edge"), (F.col("l_extendedprice").cast("double") / 50).alias("u"), (F.col("l_quantity").cast("double") * 20).alias("v"))
    k2 = F.col("k").cast("double")
    h = F.array(1.0 + k2 / 10, k2 / 100, 5.0 * k2, k2 / 100, F.lit(0.9), F.lit(0.0), 1e-4 * k2, F.lit(0.0), F.lit(1.0))
    cams = o.select(k.alias("k")).distinct().select(name(F.col("k"), "c").alias("camera_id"), h.alias("h"), F.lit(1500).alias("width"), F.lit(900).alias("height"))
    edges = s.select(name(F.col("s_suppkey"), "e").alias("edge"), (n * 10).alias("x1"), (n * 3).alias("y1"), (n * 10 + F.col("s_suppkey") % 4 * 300).alias("x2"), (n * 3 + F.col("s_suppkey") % 4 * 200).alias("y2"))
    return C.edge_errors(points, cams, edges)


@query(f"""WITH {_LINES}, k AS (SELECT camera_id, edge, count(*) AS n FROM err GROUP BY 1, 2), cams AS (SELECT DISTINCT camera_id FROM k),
sh AS (SELECT a.camera_id AS ca, b.camera_id AS cb, edge, a.n AS na, b.n AS nb FROM k a JOIN k b USING (edge) WHERE a.camera_id < b.camera_id),
m AS (SELECT ca, cb, count(*) AS n_samples, round_even(avg(e), 4) AS mean_m, round_even(quantile_cont(e, 0.95), 4) AS p95_m, round_even(max(e), 4) AS max_m FROM sh JOIN err ON err.edge = sh.edge AND err.camera_id IN (ca, cb) WHERE na >= 2 AND nb >= 2 GROUP BY 1, 2)
SELECT a.camera_id AS camera_a, b.camera_id AS camera_b, (SELECT count(*) FROM sh WHERE ca = a.camera_id AND cb = b.camera_id) AS shared_edges, coalesce(n_samples, 0) AS n_samples, mean_m, p95_m, max_m
FROM cams a JOIN cams b ON a.camera_id < b.camera_id LEFT JOIN m ON ca = a.camera_id AND cb = b.camera_id""")
def camera_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well six cameras, each with its own map to the ground, agree on the edges that they share; some share none."""
    return C.pair_agreement(_errors(spark, sf_dir))


_PARTS = """rows_ AS (SELECT 'c' || (user_id % 12) AS camera_id, tracklet_id, frame_index, x_m * 0.1 + user_id % 12 * 8 AS x, y_m * 0.1 + user_id % 4 * 6 AS y FROM bank WHERE x_m IS NOT NULL AND y_m IS NOT NULL AND x_m < 60 + user_id % 5 * 40),
box AS (SELECT camera_id, min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9 FROM rows_ GROUP BY 1)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    b = bank(spark, sf_dir).filter((F.col("x_m") < 60 + u % 5 * 40) & F.col("y_m").isNotNull())
    return b.select(F.concat(F.lit("c"), (u % 12).cast("string")).alias("camera_id"), "tracklet_id", "frame_index", (F.col("x_m") * 0.1 + u % 12 * 8).alias("x_m"), (F.col("y_m") * 0.1 + u % 4 * 6).alias("y_m"))


@query(f"""WITH {BANK}, {_PARTS}, p AS (SELECT a.camera_id AS camera_a, b.camera_id AS camera_b, greatest(a.x0, b.x0) AS lx, least(a.x9, b.x9) AS hx, greatest(a.y0, b.y0) AS ly, least(a.y9, b.y9) AS hy,
  greatest(1e-6, (a.x9 - a.x0) * (a.y9 - a.y0)) AS sa, greatest(1e-6, (b.x9 - b.x0) * (b.y9 - b.y0)) AS sb FROM box a JOIN box b ON a.camera_id < b.camera_id),
q AS (SELECT *, CASE WHEN lx < hx AND ly < hy THEN (hx - lx) * (hy - ly) / least(sa, sb) ELSE 0 END AS share, sqrt(power(greatest(0, lx - hx), 2) + power(greatest(0, ly - hy), 2)) AS gap FROM p)
SELECT camera_a, camera_b, CASE WHEN share > 0.1 THEN 'overlap' WHEN gap < 2 THEN 'adjacent' ELSE 'separated' END AS relation, round(share, 6) AS share, round(gap, 6) AS gap_m FROM q""")
def camera_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.relations(C.extents(_parts(spark, sf_dir))).withColumn("share", F.round("share", 6)).withColumn("gap_m", F.round("gap_m", 6))


@query(f"""WITH {BANK}, {_PARTS}, o AS (SELECT *, row_number() OVER (PARTITION BY camera_id, tracklet_id ORDER BY frame_index) AS i, count(*) OVER (PARTITION BY camera_id, tracklet_id) AS n FROM rows_),
t AS (SELECT camera_id, tracklet_id, max(x) FILTER (i = 1) AS ax, max(y) FILTER (i = 1) AS ay, max(x) FILTER (i = 5) AS bx, max(y) FILTER (i = 5) AS by_, max(x) FILTER (i = n - 4) AS cx, max(y) FILTER (i = n - 4) AS cy, max(x) FILTER (i = n) AS dx, max(y) FILTER (i = n) AS dy FROM o WHERE n >= 5 GROUP BY 1, 2),
s AS (SELECT camera_id, tracklet_id, 'entry' AS side, ax AS x, ay AS y, bx - ax AS vx, by_ - ay AS vy FROM t UNION ALL SELECT camera_id, tracklet_id, 'exit', dx, dy, dx - cx, dy - cy FROM t)
SELECT camera_id, tracklet_id, side, round(x, 6) AS x, round(y, 6) AS y, round(CASE WHEN sqrt(vx * vx + vy * vy) > 0.01 THEN vx / sqrt(vx * vx + vy * vy) ELSE 0 END, 6) AS dir_x, round(CASE WHEN sqrt(vx * vx + vy * vy) > 0.01 THEN vy / sqrt(vx * vx + vy * vy) ELSE 0 END, 6) AS dir_y
FROM s JOIN box USING (camera_id) WHERE least(abs(x - x0), abs(x - x9), abs(y - y0), abs(y - y9)) < 1""")
def boundary_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tracks come into what a camera sees, and where they leave it."""
    rows = _parts(spark, sf_dir)
    out = C.boundary_vectors(rows, C.extents(rows))
    return out.select("camera_id", "tracklet_id", "side", *(F.round(c, 6).alias(c) for c in ("x", "y", "dir_x", "dir_y")))


_CANDIDATES = {"identity": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], "moved": [[1.0, 0.0, 12.0], [0.0, 1.0, -4.0]], "turned": [[0.98, -0.05, 3.0], [0.05, 0.98, -6.0]]}
_CORRECTED = " UNION ALL ".join(f"SELECT '{n}' AS candidate, {float(20 * sum((m[i][j] - (i == j)) ** 2 for i in range(2) for j in range(3)))!r} AS same, *, {m[0][0]} * x_m + {m[0][1]} * y_m + {m[0][2]} AS x, {m[1][0]} * x_m + {m[1][1]} * y_m + {m[1][2]} AS y FROM pl" for n, m in _CANDIDATES.items())
_ENDS = list(zip(MAT, [*MAT[1:], MAT[0]], strict=True))
_ODD = " + ".join(f"(CASE WHEN ({p[1]} > y) <> ({q[1]} > y) AND x < {q[0] - p[0]}.0 * (y - {p[1]}) / {q[1] - p[1]}.0 + {p[0]} THEN 1 ELSE 0 END)" for p, q in _ENDS)


def _segment(x1: str, y1: str, x2: str, y2: str) -> str:
    t = f"greatest(0.0, least(1.0, ((x - {x1}) * ({x2} - {x1}) + (y - {y1}) * ({y2} - {y1})) / (power({x2} - {x1}, 2) + power({y2} - {y1}, 2))))"
    return f"sqrt(power(x - ({x1} + {t} * ({x2} - {x1})), 2) + power(y - ({y1} + {t} * ({y2} - {y1})), 2))"


_NEAREST = "least(" + ", ".join(_segment(*(f"{float(v)}" for v in (*p, *q))) for p, q in _ENDS) + ")"


@query(f"""WITH {BANK}, pl AS (SELECT camera_id, x_m, y_m, ['line', 'inside', 'outside'][detection_id % 3 + 1] AS kind FROM bank WHERE x_m IS NOT NULL AND y_m IS NOT NULL),
c AS ({_CORRECTED}), d AS (SELECT *, ({_ODD}) % 2 = 1 AS ins, {_NEAREST} AS edge, {_segment("(x_m - 5)", "y_m", "(x_m + 5)", "(y_m + 2)")} AS line FROM c)
SELECT camera_id, candidate, round(sum(CASE WHEN kind = 'line' THEN 2.0 * line * line WHEN kind = 'inside' AND NOT ins THEN 0.5 * edge * edge WHEN kind = 'outside' AND ins THEN 0.25 * edge * edge ELSE 0 END) + any_value(same), 4) AS cost,
  round(coalesce(avg(ins::INT) FILTER (kind = 'inside'), 0), 6) AS inside_share, round(coalesce(avg(line) FILTER (kind = 'line'), 0), 6) AS line_m FROM d GROUP BY 1, 2""")
def correction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three corrections of each camera would cost; a third of the places each are of lines, inner and outer ones."""
    kind = F.element_at(F.array(F.lit("line"), F.lit("inside"), F.lit("outside")), (F.col("detection_id") % 3 + 1).cast("int"))
    x, y = F.col("x_m"), F.col("y_m")
    rows = bank(spark, sf_dir).select("camera_id", "x_m", "y_m", kind.alias("kind"), (x - 5).alias("lx1"), y.alias("ly1"), (x + 5).alias("lx2"), (y + 2).alias("ly2"))
    out = C.correction_scores(rows, MAT, _CANDIDATES, (2.0, 0.5, 0.25, 20.0), ["camera_id"])
    return out.select("camera_id", "candidate", F.round("cost", 4).alias("cost"), F.round("inside_share", 6).alias("inside_share"), F.round("line_m", 6).alias("line_m"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice::DOUBLE, 0.05), 6) AS low, round(median(l_extendedprice::DOUBLE), 6) AS middle, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 6) AS high FROM lineitem GROUP BY 1, 2")
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of six groups that together hold all lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"))
    out = exact_quantiles(rows, ["l_returnflag", "l_linestatus"], "price", {"low": 0.05, "middle": 0.5, "high": 0.95})
    return out.select("l_returnflag", "l_linestatus", "n", *(F.round(c, 6).alias(c) for c in ("low", "middle", "high")))
