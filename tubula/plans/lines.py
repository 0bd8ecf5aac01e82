"""Queries of the coordinate functions and of the operators on ordered points."""

from __future__ import annotations

import math


from pyspark.sql import functions as F

from tubula.functions import geom as G
from tubula.operators import polyline as P
from tubula.plans.registry import ORACLES, query
from tubula.plans.views import ARC, CLOUD, EVT, PTS, W, cloud, events_line, points, table

K = ["case_id", "cell_id", "point_idx"]


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


#: A 4 x 4 affine of each case, by customer: spacing, flips and origin.
def affine(c: str = "case_id"):
    k = F.col(c)
    flip_x, flip_y = F.when(k % 3 > 0, -0.4).otherwise(0.4), F.when(k % 3 > 1, -0.5).otherwise(0.5)
    z = F.lit(0.0)
    return F.array(flip_x, z, z, (k % 10).cast("double"), z, flip_y, z, (k % 7).cast("double"), z, z, F.lit(0.8), (k % 5).cast("double"), z, z, z, F.lit(1.0))


AFF = "CASE WHEN case_id % 3 > 0 THEN -0.4 ELSE 0.4 END::DOUBLE AS sx, CASE WHEN case_id % 3 > 1 THEN -0.5 ELSE 0.5 END::DOUBLE AS sy, 0.8::DOUBLE AS sz, (case_id % 10)::DOUBLE AS ox, (case_id % 7)::DOUBLE AS oy, (case_id % 5)::DOUBLE AS oz"


@query("q2_3_1_ijk_ras", f"WITH {PTS}, a AS (SELECT *, {AFF} FROM points) SELECT case_id, cell_id, point_idx, round(sx * x + ox, 6) AS rx, round(sy * y + oy, 6) AS ry, round(sz * z + oz, 6) AS rz, CAST(trunc((x + 0.05 - ox) / sx) AS INTEGER) AS ti, CAST(trunc((z + 0.05 - oz) / sz) AS INTEGER) AS tk, round((y - oy) / sy, 6) AS fj FROM a")
def ijk_ras(spark, d):
    p = points(spark, d).join(_cases(spark, d), "case_id")
    ras, back, exact = G.to_ras(*G.vec(), F.col("a")), G.to_ijk(tuple(c + 0.05 for c in G.vec()), F.col("a"), "trunc"), G.to_ijk(G.vec(), F.col("a"))
    return p.select(*K, *(F.round(c, 6).alias(n) for n, c in zip(("rx", "ry", "rz"), ras, strict=True)), back[0].alias("ti"), back[2].alias("tk"), F.round(exact[1], 6).alias("fj"))


CASES = f"SELECT c_custkey AS case_id, {AFF.replace('case_id', 'c_custkey')} FROM customer"


def _cases(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("case_id")).withColumn("a", affine())


@query("q2_3_2_orientation_code", f"WITH c AS ({CASES}) SELECT case_id, CASE WHEN sx > 0 THEN 'R' ELSE 'L' END || CASE WHEN sy > 0 THEN 'A' ELSE 'P' END || 'S' AS code FROM c")
def orientation_code(spark, d):
    return _cases(spark, d).select("case_id", G.axis_codes(F.col("a")).alias("code"))


@query("q2_3_3_lpi_corner", f"WITH c AS ({CASES}) SELECT case_id, round(CASE WHEN sx < 0 THEN ox + sx * 511 ELSE ox END, 6) AS x, round(CASE WHEN sy < 0 THEN oy + sy * 511 ELSE oy END, 6) AS y, round(oz, 6) AS z FROM c")
def lpi_corner(spark, d):
    c = G.lpi_corner(F.col("a"), F.lit(512), F.lit(512))
    return _cases(spark, d).select("case_id", *(F.round(v, 6).alias(n) for n, v in zip("xyz", c, strict=True)))


@query("q2_3_4_voxel_volume", f"WITH c AS ({CASES}) SELECT case_id, round(abs(sx * sy * sz), 6) AS volume, round(abs(sz) * 300, 6) AS span FROM c")
def voxel_volume(spark, d):
    return _cases(spark, d).select("case_id", F.round(G.voxel_volume(F.col("a")), 6).alias("volume"), F.round(G.si_span(F.col("a"), F.lit(300)), 6).alias("span"))


@query("q2_3_5_orientation_convert", f"WITH {PTS}, a AS (SELECT *, {AFF} FROM points) SELECT case_id, cell_id, point_idx, CAST(CASE WHEN sx > 0 THEN x ELSE 511 - x END AS BIGINT) AS i, CAST(CASE WHEN sy > 0 THEN round(y) ELSE 511 - round(y) END AS BIGINT) AS j, CAST(round(z) AS BIGINT) AS k FROM a")
def orientation_convert(spark, d):
    p = points(spark, d).join(_cases(spark, d).withColumn("code", G.axis_codes(F.col("a"))), "case_id")
    out = G.flip_indices(F.col("x"), F.round("y"), F.round("z"), F.lit(512), F.lit(512), F.col("code"))
    return p.select(*K, *(c.cast("bigint").alias(n) for n, c in zip("ijk", out, strict=True)))


@query("q2_3_6_rotation_about_centre", f"WITH {PTS}, c AS (SELECT case_id, cell_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY 1, 2) SELECT p.case_id, p.cell_id, point_idx, round(my - y + mx, 6) AS rx, round(x - mx + my, 6) AS ry, round(z, 6) AS rz FROM points p JOIN c USING (case_id, cell_id)")
def rotation_about_centre(spark, d):
    p = points(spark, d)
    c = p.groupBy("case_id", "cell_id").agg(*(F.avg(n).alias(f"m{n}") for n in "xyz"))
    turn = F.array(*map(F.lit, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    m = p.join(c, ["case_id", "cell_id"]).withColumn("a", G.affine_about(turn, G.vec("m")))
    return m.select(*K, *(F.round(v, 6).alias(f"r{n}") for n, v in zip("xyz", G.to_ras(*G.vec(), F.col("a")), strict=True)))


@query("q2_3_7_distance", f"WITH {ARC} SELECT case_id, cell_id, point_idx, round(sqrt(x * x + y * y + z * z), 6) AS norm, round(step, 6) AS step FROM arcs")
def distance(spark, d):
    return points(spark, d).withColumn("step", P.step_length()).select(*K, F.round(G.norm(G.vec()), 6).alias("norm"), *r6("step"))


@query("q2_3_8_unit_vector", f"WITH {PTS}, n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM points) SELECT case_id, cell_id, point_idx, round(CASE WHEN n > 1e-6 THEN x / n ELSE 0 END, 6) AS ux, round(CASE WHEN n > 1e-6 THEN y / n ELSE 0 END, 6) AS uy, round(CASE WHEN n > 1e-6 THEN z / n ELSE 0 END, 6) AS uz FROM n")
def unit_vector(spark, d):
    return points(spark, d).select(*K, *(F.round(c, 6).alias(f"u{n}") for n, c in zip("xyz", G.unit(G.vec()), strict=True)))


@query("q2_3_9_spherical_angles", f"""WITH {PTS}, v AS (SELECT *, x - 25 AS a, y - 5 AS b, z - 50 AS c FROM points), f AS (SELECT *, sqrt(a * a + b * b) AS flat FROM v)
SELECT case_id, cell_id, point_idx, round(sqrt(a * a + b * b + c * c), 6) AS module,
 round(CASE WHEN abs(c) < 1e-5 THEN CASE WHEN abs(a) > 1e-5 OR abs(b) > 1e-5 THEN 0.0 END ELSE sign(c) * pi() / 2 - atan(flat / c) END, 6) AS polar,
 round(CASE WHEN NOT (abs(a) < 1e-5 AND abs(b) < 1e-5) THEN sign(b) * acos(greatest(-1.0, least(1.0, a / nullif(flat, 0)))) END, 6) AS azimuth FROM f""")
def spherical_angles(spark, d):
    p = points(spark, d)
    out = G.spherical((F.col("x") - 25, F.col("y") - 5, F.col("z") - 50))
    return p.select(*K, *(F.round(c, 6).alias(n) for n, c in zip(("module", "polar", "azimuth"), out, strict=True)))


@query("q2_3_11_cosine_similarity", f"WITH {CLOUD} SELECT a.node_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM cloud a JOIN cloud b ON b.node_id = a.node_id + 1")
def cosine_similarity(spark, d):
    c = cloud(spark, d)
    b = c.select((F.col("node_id") - 1).alias("node_id"), F.col("embedding").alias("other"))
    return c.join(b, "node_id").select("node_id", F.round(G.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("q2_3_12_one_hot", "SELECT p_partkey, CAST((p_partkey % 14 = 3)::INT + (p_partkey % 14 = 3 AND p_size > 25)::INT AS INTEGER) AS rcca, CAST((p_partkey % 14 = 13)::INT - (p_size < 10)::INT AS INTEGER) AS ba, CAST(1 + (p_partkey % 14 = 3 AND p_size > 25)::INT - (p_size < 10)::INT AS INTEGER) AS total FROM part")
def one_hot(spark, d):
    p = table(spark, d, "part")
    name = F.array(*map(F.lit, G.CLASSES))[(F.col("p_partkey") % 14).cast("int")]
    high, counter = F.when((F.col("p_partkey") % 14 == 3) & (F.col("p_size") > 25), F.array(F.lit("RCCA"))).otherwise(F.array().cast("array<string>")), F.when(F.col("p_size") < 10, F.array(F.lit("BA"))).otherwise(F.array().cast("array<string>"))
    v = p.withColumn("v", G.type_vector(F.array(name), high, counter))
    return v.select("p_partkey", F.col("v")[3].alias("rcca"), F.col("v")[13].alias("ba"), F.aggregate("v", F.lit(0), lambda a, b: a + b).alias("total"))


@query("q2_3_13_type_code", "SELECT p_partkey, CASE WHEN p_partkey % 16 < 14 THEN p_partkey % 16 END AS code FROM part")
def type_code(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.try_element_at(F.array(*map(F.lit, G.CLASSES)), (F.col("p_partkey") % 16 + 1).cast("int")).alias("name"))
    return p.select("p_partkey", G.type_code(F.col("name")).alias("code"))


@query("q2_3_14_plane_projection", f"WITH {PTS}, n AS (SELECT *, 0.6::DOUBLE AS nx, 0.0::DOUBLE AS ny, 0.8::DOUBLE AS nz FROM points) SELECT case_id, cell_id, point_idx, round(y, 6) AS u, round(-0.8 * x + 0.6 * z, 6) AS v FROM n")
def plane_projection(spark, d):
    u, v = G.project_2d(G.vec(), (F.lit(0.0),) * 3, (F.lit(3.0), F.lit(0.0), F.lit(4.0)))
    return points(spark, d).select(*K, F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("q2_3_16_root_centred_position", f"WITH {PTS} SELECT case_id, cell_id, point_idx, {', '.join(f'round(({n} - first_value({n}) OVER w) / 100, 8) AS {n}' for n in 'xyz')} FROM points WINDOW w AS (PARTITION BY case_id ORDER BY radius DESC, cell_id, point_idx)")
def root_centred_position(spark, d):
    p = points(spark, d)
    root = p.groupBy("case_id").agg(F.min_by(F.struct(*"xyz"), F.struct(-F.col("radius"), "cell_id", "point_idx")).alias("o"))
    return p.join(root, "case_id").select(*K, *(F.round((F.col(n) - F.col(f"o.{n}")) / 100, 8).alias(n) for n in "xyz"))


@query("q2_3_17_sinusoidal_position", f"WITH {PTS} SELECT case_id, cell_id, point_idx, round(sin(point_idx), 6) AS s0, round(cos(point_idx), 6) AS c0, round(sin(point_idx / 100.0), 6) AS s1, round(cos(point_idx / 100.0), 6) AS c1 FROM points")
def sinusoidal_position(spark, d):
    v = points(spark, d).withColumn("v", G.sinusoidal(F.col("point_idx").cast("double"), 4))
    return v.select(*K, *(F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate(("s0", "c0", "s1", "c1"))))


@query("q2_4_1_cumulative_length", f"WITH {ARC} SELECT case_id, cell_id, point_idx, round(arc, 6) AS arc FROM arcs")
def cumulative_length(spark, d):
    return P.arc_length(points(spark, d)).select(*K, *r6("arc"))


@query("q2_4_1b_event_length", f"WITH {EVT}, s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM evt WINDOW w AS {W}) SELECT case_id, point_idx, round(sum(step) OVER (PARTITION BY case_id ORDER BY point_idx ROWS UNBOUNDED PRECEDING), 4) AS arc FROM s")
def event_length(spark, d):
    return P.arc_length(events_line(spark, d)).select("case_id", "point_idx", F.round("arc", 4).alias("arc"))


def _grad(c: str) -> str:
    return f"CASE WHEN lag({c}) OVER w IS NOT NULL AND lead({c}) OVER w IS NOT NULL THEN (lead({c}) OVER w - lag({c}) OVER w) / 2 ELSE coalesce(lead({c}) OVER w - {c}, {c} - lag({c}) OVER w, 0) END"


GRAD = f"{PTS}, g AS (SELECT *, {', '.join(f'{_grad(n)} AS g{n}' for n in 'xyz')} FROM points WINDOW w AS {W}), m AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS gn FROM g), tan AS (SELECT *, {', '.join(f'g{n} / CASE WHEN gn < 1e-12 THEN 1 ELSE gn END AS t{n}' for n in 'xyz')} FROM m)"


@query("q2_4_2_gradient", f"WITH {GRAD} SELECT case_id, cell_id, point_idx, {s6('gx', 'gy', 'gz')} FROM tan")
def gradient(spark, d):
    return points(spark, d).select(*K, *(F.round(P.gradient(F.col(n)), 6).alias(f"g{n}") for n in "xyz"))


@query("q2_4_3_tangent", f"WITH {GRAD} SELECT case_id, cell_id, point_idx, {s6('tx', 'ty', 'tz')} FROM tan")
def tangent(spark, d):
    return P.tangents(points(spark, d)).select(*K, *r6("tx", "ty", "tz"))


def _dots(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{n} * {b}{n}" for n in "xyz") + ")"


def _mirrored(a: str, v: str, out: str) -> str:
    """a reflected at the plane across v; a itself if v is about zero."""
    return ", ".join(f"CASE WHEN {_dots(v, v)} < 1e-20 THEN {a}{n} ELSE {a}{n} - {v}{n} * (2 * {_dots(v, a)} / nullif({_dots(v, v)}, 0)) END AS {out}{n}" for n in "xyz")


AXIS = ("CASE WHEN abs(tx) >= 0.9 THEN 0.0 ELSE 1.0 END", "CASE WHEN abs(tx) >= 0.9 THEN 1.0 ELSE 0.0 END")
FRAMES = f"""{GRAD}, s0 AS (SELECT *, -tz * {AXIS[1]} AS ux, tz * {AXIS[0]} AS uy, tx * {AXIS[1]} - ty * {AXIS[0]} AS uz FROM tan WHERE point_idx = 0),
fr AS (SELECT case_id, cell_id, point_idx, x, y, z, tx, ty, tz, {', '.join(f"coalesce(u{n} / nullif(sqrt({_dots('u', 'u')}), 0), 0) AS n{n}" for n in 'xyz')} FROM s0
 UNION ALL SELECT case_id, cell_id, point_idx, x, y, z, tx, ty, tz, {', '.join(f"CASE WHEN {_dots('v', 'v')} < 1e-20 THEN n{n} ELSE coalesce(k{n} / nullif(sqrt({_dots('k', 'k')}), 0), k{n}) END" for n in 'xyz')}
 FROM (SELECT *, {_mirrored('l', 'w', 'k')} FROM (SELECT *, {', '.join(f't{n} - o{n} AS w{n}' for n in 'xyz')} FROM (SELECT *, {_mirrored('n', 'v', 'l')}, {_mirrored('q', 'v', 'o')} FROM
  (SELECT t.case_id, t.cell_id, t.point_idx, t.x, t.y, t.z, t.tx, t.ty, t.tz, fr.nx, fr.ny, fr.nz, fr.tx AS qx, fr.ty AS qy, fr.tz AS qz, t.x - fr.x AS vx, t.y - fr.y AS vy, t.z - fr.z AS vz FROM fr JOIN tan t ON t.case_id = fr.case_id AND t.cell_id = fr.cell_id AND t.point_idx = fr.point_idx + 1) f0) f1) f2) f3),
bn AS (SELECT *, ty * nz - tz * ny AS bx, tz * nx - tx * nz AS by_, tx * ny - ty * nx AS bz FROM fr)"""


@query("q2_4_4_parallel_transport", f"WITH RECURSIVE {FRAMES} SELECT case_id, cell_id, point_idx, {', '.join(f'round({n}, 5) AS {n}' for n in ('nx', 'ny', 'nz', 'bx', 'bz'))}, round(by_, 5) AS \"by\" FROM bn")
def parallel_transport(spark, d):
    return P.transported_frames(P.tangents(points(spark, d))).select(*K, *(F.round(n, 5).alias(n) for n in ("nx", "ny", "nz", "bx", "by", "bz")))


@query("q2_4_5_local_curvature")
def local_curvature(spark, d):
    return P.local_curvature(points(spark, d)).select(*K, *r6("local_curvature", "local_torsion"))


@query("q2_4_6_curve_curvature", f"WITH {GRAD}, k AS (SELECT *, {', '.join(f'{_grad(chr(116) + n)} AS k{n}' for n in 'xyz')} FROM tan WINDOW w AS {W}) SELECT case_id, cell_id, point_idx, round(sqrt(kx * kx + ky * ky + kz * kz), 6) AS curvature FROM k")
def curve_curvature(spark, d):
    return P.curve_curvature(P.tangents(points(spark, d))).select(*K, *r6("curvature"))


@query("q2_4_6b_curve_torsion", f"WITH RECURSIVE {FRAMES}, dv AS (SELECT *, {_grad('bx')} AS d0, {_grad('by_')} AS d1, {_grad('bz')} AS d2 FROM bn WINDOW w AS {W}) SELECT case_id, cell_id, point_idx, round(-(d0 * nx + d1 * ny + d2 * nz), 5) AS torsion FROM dv")
def curve_torsion(spark, d):
    return P.curve_torsion(P.transported_frames(P.tangents(points(spark, d)))).select(*K, F.round("torsion", 5).alias("torsion"))


@query("q2_4_7_angle_of_curvature", f"WITH {GRAD}, a AS (SELECT *, coalesce(degrees(acos(greatest(-1, least(1, tx * lag(tx) OVER w + ty * lag(ty) OVER w + tz * lag(tz) OVER w)))), 0) AS turn FROM tan WINDOW w AS {W}) SELECT case_id, cell_id, point_idx, round(turn, 3) AS turn, round(sum(turn) OVER (PARTITION BY case_id, cell_id ORDER BY point_idx ROWS UNBOUNDED PRECEDING), 3) AS turn_sum FROM a")
def angle_of_curvature(spark, d):
    return P.turn_angle(P.tangents(points(spark, d))).select(*K, F.round("turn", 3).alias("turn"), F.round("turn_sum", 3).alias("turn_sum"))


def _filtered(weights: list[float], index: str) -> str:
    """Weighted sum around each event: the weights as a table, ``index`` gives the row that each one falls on."""
    table = ", ".join(f"({i - len(weights) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(weights))
    return f"WITH {EVT}, k(o, w) AS (VALUES {table}), n AS (SELECT case_id, point_idx, count(*) OVER (PARTITION BY case_id) AS n FROM evt), h AS (SELECT case_id, point_idx, w, {index} AS pos FROM n CROSS JOIN k) SELECT h.case_id, h.point_idx, round(sum(w * y), 5) AS smooth FROM h JOIN evt ON evt.case_id = h.case_id AND evt.point_idx = pos GROUP BY ALL"


GAUSS = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]
MIRROR = "CASE WHEN (point_idx + o) % (2 * n) >= 0 THEN (point_idx + o) % (2 * n) ELSE (point_idx + o) % (2 * n) + 2 * n END"


@query("q2_4_8_savgol_smooth", _filtered(P.savgol_weights(50, 3), "greatest(0, least(n - 1, point_idx + o))"))
def savgol_smooth(spark, d):
    return P.savgol_smooth(events_line(spark, d), "y", "smooth").select("case_id", "point_idx", F.round("smooth", 5).alias("smooth"))


@query("q2_4_9_gaussian_smooth", _filtered([w / sum(GAUSS) for w in GAUSS], f"CASE WHEN {MIRROR} < n THEN {MIRROR} ELSE 2 * n - 1 - ({MIRROR}) END"))
def gaussian_smooth(spark, d):
    return P.gaussian_smooth(events_line(spark, d), "y", "smooth").select("case_id", "point_idx", F.round("smooth", 5).alias("smooth"))


#: Peaks of the smoothed values by self joins: plateaus, the nearest higher rows, prominences, and where half of it is crossed.
PEAKS = f"""WITH sm AS ({ORACLES['q2_4_9_gaussian_smooth']}), rw AS (SELECT case_id, point_idx, smooth AS v, row_number() OVER w AS r, CASE WHEN smooth = lag(smooth) OVER w THEN 0 ELSE 1 END AS c FROM sm WINDOW w AS (PARTITION BY case_id ORDER BY point_idx)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY case_id ORDER BY r) AS run FROM rw), g AS (SELECT case_id, run, any_value(v) AS v, min(r) AS a, max(r) AS b FROM rn GROUP BY ALL),
t AS (SELECT case_id, v AS top, (a + b) // 2 AS peak FROM g WINDOW w AS (PARTITION BY case_id ORDER BY run) QUALIFY lag(v) OVER w < v AND lead(v) OVER w < v AND v >= 0.03),
rc AS (SELECT t.case_id, peak, top, coalesce(max(r) FILTER (r < peak AND v > top), 0) AS lft, coalesce(min(r) FILTER (r > peak AND v > top), 1 << 30) AS rgt FROM t JOIN rw USING (case_id) GROUP BY ALL),
pr AS (SELECT rc.case_id, peak, top, lft, rgt, top - greatest(min(v) FILTER (r <= peak), min(v) FILTER (r >= peak)) AS prominence FROM rc JOIN rw ON rw.case_id = rc.case_id AND r > lft AND r < rgt GROUP BY rc.case_id, peak, top, lft, rgt),
sd AS (SELECT pr.case_id, peak, top, prominence, top - prominence / 2 AS lev, max(r) FILTER (r <= peak AND v <= top - prominence / 2) AS lo, min(r) FILTER (r >= peak AND v <= top - prominence / 2) AS hi, min(r) AS fst, max(r) AS lst FROM pr JOIN rw ON rw.case_id = pr.case_id AND r > lft AND r < rgt GROUP BY pr.case_id, peak, top, prominence),
wd AS (SELECT sd.*, coalesce(hi - (lev - h.v) / (h1.v - h.v), lst) - coalesce(lo + (lev - l.v) / (l1.v - l.v), fst) AS width FROM sd LEFT JOIN rw l ON l.case_id = sd.case_id AND l.r = lo LEFT JOIN rw l1 ON l1.case_id = sd.case_id AND l1.r = lo + 1 LEFT JOIN rw h ON h.case_id = sd.case_id AND h.r = hi LEFT JOIN rw h1 ON h1.case_id = sd.case_id AND h1.r = hi - 1),
pk AS (SELECT wd.case_id, rw.point_idx, r, top AS value, prominence, width FROM wd JOIN rw ON rw.case_id = wd.case_id AND r = peak WHERE width >= 3)"""


def _smoothed(spark, d):
    return P.gaussian_smooth(events_line(spark, d), "y", "smooth").withColumn("smooth", F.round("smooth", 5))


@query("q2_4_10_peak_detection", f"{PEAKS} SELECT case_id, point_idx, round(value, 6) AS value, round(prominence, 6) AS prominence, round(width, 6) AS width FROM pk")
def peak_detection(spark, d):
    return P.peaks(_smoothed(spark, d), "smooth", 0.03, 3).select("case_id", "point_idx", *r6("value", "prominence", "width"))


@query("q2_4_11_curve_ids", f"{PEAKS}, nx AS (SELECT case_id, r AS a, lead(r) OVER (PARTITION BY case_id ORDER BY r) AS b FROM pk), ct AS (SELECT nx.case_id, arg_min(r, (v, r)) AS r FROM nx JOIN rw ON rw.case_id = nx.case_id AND r > a AND r < b GROUP BY nx.case_id, a) SELECT rw.case_id, point_idx, CAST(count(ct.r) OVER (PARTITION BY rw.case_id ORDER BY rw.r) AS BIGINT) AS curve_id FROM rw LEFT JOIN ct ON ct.case_id = rw.case_id AND ct.r = rw.r")
def curve_ids(spark, d):
    return P.curve_ids(_smoothed(spark, d), "smooth", 0.03, 3).select("case_id", "point_idx", "curve_id")


@query("q2_4_12_first_local_minimum", f"""WITH {EVT}, a AS (SELECT *, {_grad('y')} AS d1 FROM evt WINDOW w AS {W}), b AS (SELECT *, {_grad('d1')} AS d2, lead(d1) OVER w AS nx FROM a WINDOW w AS {W}),
c AS (SELECT *, min(y) OVER (PARTITION BY case_id) AS low FROM b WHERE d1 <= 0 AND nx > 0 AND d2 > 0 AND y < 20) SELECT case_id, min(point_idx) AS point_idx, round(arg_min(y, point_idx), 6) AS value FROM c WHERE y <= low + 5 GROUP BY 1""")
def first_local_minimum(spark, d):
    return P.first_local_minimum(events_line(spark, d), "y").select("case_id", "point_idx", *r6("value"))


@query("q2_4_13_flag_after_transition", f"WITH {EVT}, t AS (SELECT case_id, min(point_idx) AS at0 FROM evt WHERE y > 100 GROUP BY 1) SELECT case_id, point_idx, CASE WHEN point_idx > at0 THEN 1 ELSE 0 END AS after FROM evt LEFT JOIN t USING (case_id)")
def flag_after_transition(spark, d):
    e = events_line(spark, d)
    at = e.filter("y > 100").groupBy("case_id", "cell_id").agg(F.min("point_idx").alias("point_idx"))
    return P.flag_after(e, at).select("case_id", "point_idx", "after")


@query("q2_4_14_longest_run", f"""WITH {EVT}, p AS (SELECT *, y > 20 AS p FROM evt), c AS (SELECT *, CASE WHEN p = lag(p) OVER w THEN 0 ELSE 1 END AS ch FROM p WINDOW w AS {W}),
r AS (SELECT *, sum(ch) OVER (PARTITION BY case_id ORDER BY point_idx) AS run FROM c), g AS (SELECT case_id, run, min(point_idx) AS start, max(point_idx) AS "end", count(*) AS n FROM r WHERE p GROUP BY 1, 2)
SELECT case_id, start, "end", n FROM g QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, start) = 1""")
def longest_run(spark, d):
    return P.longest_run(events_line(spark, d), F.col("y") > 20).select("case_id", "start", "end", "n")


@query("q2_4_15_trim_tail", f"WITH {PTS}, l AS (SELECT *, max(CASE WHEN blanking <> 1 THEN point_idx END) OVER (PARTITION BY case_id, cell_id) AS last FROM points) SELECT case_id, cell_id, point_idx FROM l WHERE point_idx <= last")
def trim_tail(spark, d):
    return P.trim_tail(points(spark, d), "blanking").select(*K)


@query("q2_4_16_label_transition", f"WITH {EVT}, f AS (SELECT case_id, min(CASE WHEN contains(class_name, 'click') THEN point_idx END) AS point_idx, min(point_idx) AS first FROM evt GROUP BY 1) SELECT case_id, point_idx FROM f WHERE point_idx IS NOT NULL AND point_idx <> first")
def label_transition(spark, d):
    return P.label_transition(events_line(spark, d), "class_name", "click", strict=False).select("case_id", "point_idx")


@query("q2_4_17_nearest_point_on_line", f"WITH {PTS}, m AS (SELECT *, sqrt((x - 25) * (x - 25) + (y - 5) * (y - 5) + (z - 30) * (z - 30)) AS dd FROM points) SELECT case_id, cell_id, arg_min(point_idx, dd) AS point_idx, round(min(dd), 6) AS distance FROM m GROUP BY 1, 2")
def nearest_point_on_line(spark, d):
    p = points(spark, d)
    marks = p.select("case_id").distinct().select("case_id", F.lit("m").alias("label"), F.lit(25.0).alias("x"), F.lit(5.0).alias("y"), F.lit(30.0).alias("z"))
    return P.nearest_index(p, marks).select("case_id", "cell_id", "point_idx", *r6("distance"))


@query("q2_4_18_window_mask", f"WITH {ARC}, c AS (SELECT *, max(arc) OVER (PARTITION BY case_id, cell_id) / 2 AS centre FROM arcs) SELECT case_id, cell_id, point_idx, arc >= centre - 25.0 / 4 AND arc <= centre + 75.0 / 4 AS inside FROM c")
def window_mask(spark, d):
    p = P.arc_length(points(spark, d))
    return P.span_mask(p, p.groupBy("case_id", "cell_id").agg((F.max("arc") / 2).alias("centre"))).select(*K, "inside")


def _end(h: str, h2: str, m: str, m2: str) -> str:
    d = f"(((2 * {h} + {h2}) * {m} - {h} * {m2}) / ({h} + {h2}))"
    return f"CASE WHEN sign({d}) <> sign({m}) THEN 0 WHEN sign({m}) <> sign({m2}) AND abs({d}) > 3 * abs({m}) THEN 3 * {m} ELSE {d} END"


@query("q2_4_19_pchip", f"""WITH {EVT}, st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM evt WINDOW w AS {W}), k0 AS (SELECT case_id, cell_id, point_idx, x, y, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS m FROM evt WHERE point_idx % 3 = 0 WINDOW w AS {W}),
k1 AS (SELECT *, lag(h) OVER w AS h0, lag(m) OVER w AS m0, lead(h) OVER w AS h2, lead(m) OVER w AS m2, lag(h, 2) OVER w AS hb, lag(m, 2) OVER w AS mb FROM k0 WINDOW w AS {W}),
k2 AS (SELECT *, CASE WHEN h0 IS NULL THEN {_end('h', 'h2', 'm', 'm2')} WHEN h IS NULL THEN {_end('h0', 'hb', 'm0', 'mb')} WHEN m0 * m > 0 THEN (3 * h + 3 * h0) / nullif((2 * h + h0) / nullif(m0, 0) + (h + 2 * h0) / nullif(m, 0), 0) ELSE 0 END AS s FROM k1),
k3 AS (SELECT case_id, cell_id, point_idx, struct_pack(x := x, y := y, s := s, x2 := lead(x) OVER w, y2 := lead(y) OVER w, s2 := lead(s) OVER w) AS p FROM k2 WINDOW w AS {W}),
k4 AS (SELECT * FROM k3 WHERE p.x2 IS NOT NULL), r AS (SELECT e.*, k4.p AS own FROM evt e LEFT JOIN k4 USING (case_id, cell_id, point_idx)),
f AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY case_id, cell_id ORDER BY point_idx ROWS UNBOUNDED PRECEDING), first_value(own IGNORE NULLS) OVER (PARTITION BY case_id, cell_id ORDER BY point_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r), t AS (SELECT *, q.x2 - q.x AS h, (x - q.x) / (q.x2 - q.x) AS t FROM f)
SELECT case_id, point_idx, round((2 * t * t * t - 3 * t * t + 1) * q.y + (t * t * t - 2 * t * t + t) * h * q.s + (3 * t * t - 2 * t * t * t) * q.y2 + (t * t * t - t * t) * h * q.s2, 4) AS fit FROM t""")
def pchip(spark, d):
    e = P.arc_length(events_line(spark, d))
    return P.pchip(e, "x", "y", F.col("point_idx") % 3 == 0, "fit").select("case_id", "point_idx", F.round("fit", 4).alias("fit"))


@query("q2_4_20_bulb_span", f"""WITH {ARC}, c AS (SELECT *, max(arc) OVER (PARTITION BY case_id, cell_id) / 2 AS centre, avg(radius) OVER (PARTITION BY case_id, cell_id) AS mr FROM arcs),
r AS (SELECT *, CASE WHEN arc >= centre - 25.0 / 4 AND arc <= centre + 75.0 / 4 THEN abs(radius - mr) END AS res FROM c),
b AS (SELECT *, min(CASE WHEN res > 0.5 THEN point_idx END) OVER (PARTITION BY case_id, cell_id) AS a0, max(CASE WHEN res > 0.2 THEN point_idx END) OVER (PARTITION BY case_id, cell_id) AS b0 FROM r)
SELECT case_id, cell_id, point_idx, coalesce(point_idx >= a0 AND point_idx <= b0 + 1, false) AS bulb FROM b""")
def bulb_span(spark, d):
    p = P.arc_length(points(spark, d))
    m = P.span_mask(p, p.groupBy("case_id", "cell_id").agg((F.max("arc") / 2).alias("centre")))
    mean = p.groupBy("case_id", "cell_id").agg(F.avg("radius").alias("mr"))
    return P.bulb_mask(m.join(mean, ["case_id", "cell_id"]).withColumn("res", F.col("radius") - F.col("mr")), "res", "inside").select(*K, "bulb")


@query("q2_4_21_resample_linear", f"""WITH {ARC}, c AS (SELECT case_id, cell_id, max(arc) AS len, count(*) AS n FROM arcs GROUP BY 1, 2), nx AS (SELECT *, lead(arc) OVER w AS arc2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(radius) OVER w AS r2 FROM arcs WINDOW w AS {W}),
pc AS (SELECT *, row_number() OVER (PARTITION BY case_id, cell_id ORDER BY arc DESC, point_idx DESC) = 1 AS fin FROM nx WHERE arc2 > arc),
g AS (SELECT case_id, cell_id, len, CAST(ceil(len / 5) AS BIGINT) AS k, unnest(range(CAST(ceil(len / 5) AS BIGINT) + 1)) AS i FROM c WHERE len > 5 AND n >= 2), s AS (SELECT *, len * i / k AS s FROM g),
j AS (SELECT s.case_id, s.cell_id, CAST(i AS INTEGER) AS point_idx, least(1.0, (s - arc) / (arc2 - arc)) AS t, pc.* EXCLUDE (case_id, cell_id, point_idx) FROM s JOIN pc USING (case_id, cell_id) WHERE s >= arc AND (s < arc2 OR fin))
SELECT case_id, cell_id, point_idx, floor((x + t * (x2 - x)) * 1e6 + 0.5) / 1e6 AS x, floor((y + t * (y2 - y)) * 1e6 + 0.5) / 1e6 AS y, floor((z + t * (z2 - z)) * 1e6 + 0.5) / 1e6 AS z, floor((greatest(0.0, radius + t * (r2 - radius))) * 1e6 + 0.5) / 1e6 AS radius FROM j
UNION ALL SELECT p.case_id, p.cell_id, point_idx, floor((x) * 1e6 + 0.5) / 1e6, floor((y) * 1e6 + 0.5) / 1e6, floor((z) * 1e6 + 0.5) / 1e6, floor((radius) * 1e6 + 0.5) / 1e6 FROM points p JOIN c USING (case_id, cell_id) WHERE NOT (len > 5 AND n >= 2)""")
def resample_linear(spark, d):
    return P.resample_linear(points(spark, d), 5.0).select(*K, *((F.floor(F.col(n) * 1e6 + 0.5) / 1e6).alias(n) for n in ("x", "y", "z", "radius")))


@query("q2_4_22_neighbour_points", f"WITH {PTS} SELECT case_id, cell_id, point_idx, CAST(count(*) OVER (PARTITION BY case_id, cell_id ORDER BY point_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS INTEGER) AS n, min(point_idx) OVER (PARTITION BY case_id, cell_id ORDER BY point_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS first FROM points")
def neighbour_points(spark, d):
    return P.neighbour_points(points(spark, d)).select(*K, F.size("near").alias("n"), F.array_min("near").alias("first"))


@query("q2_4_23_mean_step", f"WITH {ARC}, s AS (SELECT *, CASE WHEN lag(x) OVER w IS NOT NULL THEN step END AS st FROM arcs WINDOW w AS {W}) SELECT case_id, cell_id, point_idx, round(avg(st) OVER (PARTITION BY case_id, cell_id ORDER BY point_idx ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 6) AS mean_step FROM s")
def mean_step(spark, d):
    return P.mean_step(points(spark, d)).select(*K, *r6("mean_step"))


@query("q2_4_24_fill_from_neighbour", f"""WITH {EVT}, v AS (SELECT *, CASE WHEN y < 50 THEN y END AS v FROM evt) SELECT case_id, point_idx,
 round(coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY point_idx ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY point_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS y FROM v""")
def fill_from_neighbour(spark, d):
    e = events_line(spark, d).withColumn("y", F.when(F.col("y") < 50, F.col("y")).otherwise(float("nan")))
    return P.fill_invalid(e, "y").select("case_id", "point_idx", *r6("y"))


PAST = "OVER (PARTITION BY case_id ORDER BY point_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("q2_4_25_outlier_clean", f"""WITH {EVT}, a AS (SELECT *, abs(y - lag(y) OVER w) AS b, abs(lead(y) OVER w - y) AS c, count(*) OVER (PARTITION BY case_id) AS n, CAST(row_number() OVER w AS DOUBLE) AS r FROM evt WINDOW w AS {W}), o AS (SELECT *, (coalesce(b, c) + coalesce(c, b)) / 2 AS apart FROM a),
p AS (SELECT *, coalesce(n >= 4 AND apart > 1.5 * avg(apart) OVER (PARTITION BY case_id), false) AS outlier FROM o), g AS (SELECT *, CASE WHEN NOT outlier THEN struct_pack(r := r, v := y) END AS g FROM p),
h AS (SELECT *, last_value(g IGNORE NULLS) {PAST} AS p1, first_value(g IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY point_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM g), i AS (SELECT *, CASE WHEN NOT outlier THEN struct_pack(p := p1) END AS pair FROM h), j AS (SELECT *, (last_value(pair IGNORE NULLS) {PAST}).p AS p2 FROM i),
l AS (SELECT *, p2.v * (r - p1.r) * (r - q.r) / ((p2.r - p1.r) * (p2.r - q.r)) + p1.v * (r - p2.r) * (r - q.r) / ((p1.r - p2.r) * (p1.r - q.r)) + q.v * (r - p2.r) * (r - p1.r) / ((q.r - p2.r) * (q.r - p1.r)) AS lag3 FROM j)
SELECT case_id, point_idx, outlier, round(CASE WHEN outlier THEN coalesce(lag3, y) ELSE y END, 5) AS y FROM l""")
def outlier_clean(spark, d):
    return P.clean_outliers(events_line(spark, d), "y").select("case_id", "point_idx", "outlier", F.round("y", 5).alias("y"))
