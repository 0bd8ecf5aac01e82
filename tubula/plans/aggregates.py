"""Queries of the aggregates over segments, masks and score tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tubula.operators import quality as Q
from tubula.operators import segments as S
from tubula.operators import voxels as V
from tubula.operators.polyline import KEYS
from tubula.plans.lines import r6
from tubula.plans.registry import ORACLES, query
from tubula.plans.views import ARC, NODES, PTS, SCORES, TREE, VOX, W, labels_sql, points, scores, table, tree, tree_nodes, voxels

C = "case_id, cell_id"
#: Ends of a cell by the blanking rule: first lowest and last highest index of rows that aren't blanked, else of all.
ENDS = f"""{ARC}, e AS (SELECT {C}, coalesce(min(CASE WHEN blanking < 0.5 THEN point_idx END), min(point_idx)) AS pi, coalesce(max(CASE WHEN blanking < 0.5 THEN point_idx END), max(point_idx)) AS di FROM points GROUP BY ALL),
ends AS (SELECT e.*, p.x AS px, p.y AS py, p.z AS pz, p.radius AS pr, q.x AS qx, q.y AS qy, q.z AS qz, q.radius AS qr FROM e JOIN points p ON p.case_id = e.case_id AND p.cell_id = e.cell_id AND p.point_idx = pi JOIN points q ON q.case_id = e.case_id AND q.cell_id = e.cell_id AND q.point_idx = di)"""
TORT = f"""{ARC}, t AS (SELECT {C}, max(arc) AS length, sqrt(pow(arg_min(x, point_idx) - arg_max(x, point_idx), 2) + pow(arg_min(y, point_idx) - arg_max(y, point_idx), 2) + pow(arg_min(z, point_idx) - arg_max(z, point_idx), 2)) AS chord FROM arcs GROUP BY ALL)"""


def _stat(f: str, c: str = "2 * radius") -> str:
    return f"coalesce({f}(CASE WHEN blanking < 0.5 THEN {c} END), {f}({c}))"


@query("segment_summary", f"WITH {TORT} SELECT {C}, round(length, 6) AS length, round(1 - chord / nullif(length, 0), 6) AS tortuosity, round(mean_diameter, 6) AS mean_diameter, round(std_diameter, 6) AS std_diameter FROM t JOIN (SELECT {C}, {_stat('avg')} AS mean_diameter, {_stat('stddev_pop')} AS std_diameter FROM points GROUP BY ALL) USING ({C})")
def segment_summary(spark, d):
    p = points(spark, d)
    return S.tortuosity(p).join(S.diameter_stats(p), KEYS).select(*KEYS, *r6("length", "tortuosity", "mean_diameter", "std_diameter"))


@query("q2_5_1_segment_length", f"WITH {ARC} SELECT {C}, round(max(arc), 6) AS length FROM arcs GROUP BY ALL")
def segment_length(spark, d):
    return S.segment_length(points(spark, d)).select(*KEYS, *r6("length"))


@query("q2_5_2_diameter_stats", f"WITH {PTS} SELECT {C}, round({_stat('avg')}, 6) AS mean_diameter, round({_stat('stddev_pop')}, 6) AS std_diameter, round({_stat('min')}, 6) AS min_diameter, round({_stat('max')}, 6) AS max_diameter, round({_stat('min')} / {_stat('max')}, 6) AS min_max_ratio FROM points GROUP BY ALL")
def diameter_stats(spark, d):
    return S.diameter_stats(points(spark, d)).select(*KEYS, *r6("mean_diameter", "std_diameter", "min_diameter", "max_diameter", "min_max_ratio"))


@query("q2_5_4_end_nodes", f"WITH {ENDS} SELECT {C}, pi AS proximal, di AS distal, round(2 * pr, 6) AS proximal_diameter, round(2 * qr, 6) AS distal_diameter FROM ends")
def end_nodes(spark, d):
    p = points(spark, d)
    return S.end_nodes(p).select(*KEYS, F.col("proximal.point_idx").alias("proximal"), F.col("distal.point_idx").alias("distal")).join(S.end_diameters(p).select(*KEYS, *r6("proximal_diameter", "distal_diameter")), KEYS)


@query("q2_5_6_tortuosity_index", f"WITH {TORT} SELECT {C}, round(1 - chord / nullif(length, 0), 6) AS tortuosity FROM t")
def tortuosity_index(spark, d):
    return S.tortuosity(points(spark, d)).select(*KEYS, *r6("tortuosity"))


@query("q2_5_7_bending_length", f"""WITH {ENDS}, o AS (SELECT p.case_id, p.cell_id, p.x, p.y, p.z, px, py, pz, qx - px AS dx, qy - py AS dy, qz - pz AS dz FROM points p JOIN ends USING ({C})), t AS (SELECT *, ((x - px) * dx + (y - py) * dy + (z - pz) * dz) / nullif(dx * dx + dy * dy + dz * dz, 0) AS t FROM o)
SELECT {C}, round(coalesce(max(sqrt(pow(x - px - t * dx, 2) + pow(y - py - t * dy, 2) + pow(z - pz - t * dz, 2))), 0), 5) AS bending_length FROM t GROUP BY ALL""")
def bending_length(spark, d):
    return S.bending_length(points(spark, d)).select(*KEYS, F.round("bending_length", 5).alias("bending_length"))


#: Nodes with the radius as curvature and an angle made of y as polar: enough to test the sums.
def _curved(spark, d):
    return points(spark, d).withColumn("curvature", F.col("radius") / 4).withColumn("polar", F.col("y") / 10)


@query("q2_5_8_curvature_sums", f"WITH {PTS}, k AS (SELECT *, radius / 4 AS k, row_number() OVER {W} AS r FROM points) SELECT {C}, round(sum(CASE WHEN r > 1 THEN k ELSE 0 END), 6) AS cumulative_curvature, round(sum(k * k), 6) AS curvature_energy FROM k GROUP BY ALL")
def curvature_sums(spark, d):
    return S.curvature_sums(_curved(spark, d)).select(*KEYS, *r6("cumulative_curvature", "curvature_energy"))


@query("q2_5_10_polar_features", f"WITH {PTS}, k AS (SELECT *, abs(y / 10 - lag(y / 10) OVER {W}) AS a FROM points) SELECT {C}, round(least(pi() / 2, min(y / 10)), 6) AS min_polar, round(coalesce(sum(a), 0), 6) AS polar_variation FROM k GROUP BY ALL")
def polar_features(spark, d):
    return S.polar_features(_curved(spark, d)).select(*KEYS, *r6("min_polar", "polar_variation"))


@query("q2_3_10_direction_angles", f"""WITH {ENDS}, v AS (SELECT *, qx - px AS a, qy - py AS b, qz - pz AS c FROM ends), n AS (SELECT *, sqrt(a * a + b * b + c * c) AS n, sqrt(a * a + b * b) AS f FROM v)
SELECT {C}, round(CASE WHEN n > 0 THEN pi() / 2 - acos(greatest(-1, least(1, c / nullif(n, 0)))) ELSE 0 END, 6) AS polar, round(CASE WHEN f > 0 THEN sign(b) * acos(greatest(-1, least(1, a / nullif(f, 0)))) ELSE 0 END, 6) AS azimuth FROM n""")
def direction_angles(spark, d):
    return S.segment_direction(points(spark, d)).select(*KEYS, *r6("polar", "azimuth"))


@query("q2_5_12_partial_segment", f"WITH {ARC}, b AS (SELECT *, lag(arc) OVER {W} AS before FROM arcs) SELECT {C}, point_idx, round(arc, 6) AS arc FROM b WHERE before IS NULL OR before < 50")
def partial_segment(spark, d):
    return S.partial_segment(points(spark, d), 50).select(*KEYS, "point_idx", *r6("arc"))


def _part(name: str, keep: str, size: str) -> str:
    """Tortuosity of a stretch of a cell's points: rows that are kept, and the length from the stretch's own end."""
    chord = " + ".join(f"pow(arg_min({v}, point_idx) - arg_max({v}, point_idx), 2)" for v in "xyz")
    return f"{name} AS (SELECT {C}, 1 - sqrt({chord}) / nullif(max({size}), 0) AS t FROM b WHERE {keep} GROUP BY ALL)"


@query("q2_5_13_partial_features", f"""WITH {ARC}, r AS (SELECT *, max(arc) OVER (PARTITION BY {C}) - arc AS back FROM arcs), b AS (SELECT *, lag(arc) OVER {W} AS prev, lag(back) OVER (PARTITION BY {C} ORDER BY point_idx DESC) AS before FROM r),
l10 AS (SELECT {C}, {_stat('avg')} AS d10 FROM b WHERE before IS NULL OR before < 10 GROUP BY ALL), l5 AS (SELECT {C}, {_stat('avg')} AS d5 FROM b WHERE before IS NULL OR before < 5 GROUP BY ALL),
{_part('f50', 'prev IS NULL OR prev < 50', 'arc')}, {', '.join(_part(f't{n}', f'before IS NULL OR before < {n}', 'back') for n in (10, 20, 30))}
SELECT l5.case_id, l5.cell_id, round(d5, 6) AS diameter_last_5, round(d10, 6) AS diameter_last_10, round(f50.t, 6) AS tortuosity_first_50, round(t10.t, 6) AS tortuosity_last_10, round(t20.t, 6) AS tortuosity_last_20, round(t30.t, 6) AS tortuosity_last_30
FROM l5 JOIN l10 USING ({C}) JOIN f50 USING ({C}) JOIN t10 USING ({C}) JOIN t20 USING ({C}) JOIN t30 USING ({C})""")
def partial_features(spark, d):
    out = S.partial_features(points(spark, d))
    return out.select(*KEYS, *r6(*(c for c in out.columns if c not in KEYS)))


def _joined(*names: str) -> str:
    return " JOIN ".join(f"({ORACLES[n]}) o{i}" + (f" USING ({C})" if i else "") for i, n in enumerate(names))


FEATURES = ["length", "tortuosity", "mean_diameter", "std_diameter", "min_diameter", "max_diameter", "min_max_ratio", "proximal_diameter", "distal_diameter", "bending_length", "cumulative_curvature", "curvature_energy", "min_polar", "polar_variation", "polar", "azimuth", "diameter_last_5", "diameter_last_10", "tortuosity_first_50", "tortuosity_last_10", "tortuosity_last_20", "tortuosity_last_30"]


@query("q2_5_14_segment_features", f"SELECT {C}, {', '.join(FEATURES)} FROM {_joined('q2_5_1_segment_length', 'q2_5_6_tortuosity_index', 'q2_5_2_diameter_stats', 'q2_5_4_end_nodes', 'q2_5_7_bending_length', 'q2_5_8_curvature_sums', 'q2_5_10_polar_features', 'q2_3_10_direction_angles', 'q2_5_13_partial_features')}")
def segment_features(spark, d):
    out = S.segment_features(_curved(spark, d))
    return out.select(*KEYS, *(F.round(c, 5 if c == "bending_length" else 6).alias(c) for c in FEATURES))


@query("q2_5_15_pair_features", f"""WITH {PTS}, n AS (SELECT *, y / 10 AS polar, x / 50 AS azimuth, row_number() OVER {W} > 1 AS inn FROM points), pr AS (SELECT case_id, cell_id AS l, lead(cell_id) OVER (PARTITION BY case_id ORDER BY cell_id) AS r FROM (SELECT DISTINCT {C} FROM points))
SELECT pr.case_id, l AS "left", r AS "right", round(max(CASE WHEN a.inn AND b.inn THEN acos(greatest(-1, least(1, cos(a.polar) * cos(a.azimuth) * cos(b.polar) * cos(b.azimuth) + cos(a.polar) * sin(a.azimuth) * cos(b.polar) * sin(b.azimuth) + sin(a.polar) * sin(b.polar)))) END), 5) AS angle,
 round(max(CASE WHEN abs(degrees(a.polar)) < 50 AND abs(degrees(b.polar)) < 50 THEN acos(greatest(-1, least(1, cos(a.azimuth) * cos(b.azimuth) + sin(a.azimuth) * sin(b.azimuth)))) END), 5) AS azimuth_difference, round(max(abs(a.polar - b.polar)), 5) AS polar_difference
FROM pr JOIN n a ON a.case_id = pr.case_id AND a.cell_id = l JOIN n b ON b.case_id = pr.case_id AND b.cell_id = r GROUP BY ALL""")
def pair_features(spark, d):
    from pyspark.sql import Window

    p = points(spark, d)
    w = Window.partitionBy(*KEYS).orderBy("point_idx")
    n = p.select(*KEYS, "point_idx", (F.col("y") / 10).alias("polar"), (F.col("x") / 50).alias("azimuth"), (F.row_number().over(w) > 1).alias("inner"))
    pairs = p.select(*KEYS).distinct().withColumn("right", F.lead("cell_id").over(Window.partitionBy("case_id").orderBy("cell_id"))).filter("right is not null").select("case_id", F.col("cell_id").alias("left"), "right")
    return S.pair_features(n, pairs).select("case_id", "left", "right", *(F.round(c, 5).alias(c) for c in ("angle", "azimuth_difference", "polar_difference")))


@query("q2_5_16_contact_point", f"""WITH {PTS}, g AS (SELECT {C}, min(point_idx) AS i0, max(point_idx) AS i1 FROM points GROUP BY ALL), en AS (SELECT p.* FROM points p JOIN g USING ({C}) WHERE point_idx IN (i0, i1)), pr AS (SELECT case_id, cell_id AS l, lead(cell_id) OVER (PARTITION BY case_id ORDER BY cell_id) AS r FROM g)
SELECT pr.case_id, l AS "left", r AS "right", round((a.x + b.x) / 2, 6) AS x, round((a.y + b.y) / 2, 6) AS y, round((a.z + b.z) / 2, 6) AS z, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS gap
FROM pr JOIN en a ON a.case_id = pr.case_id AND a.cell_id = l JOIN en b ON b.case_id = pr.case_id AND b.cell_id = r
QUALIFY row_number() OVER (PARTITION BY pr.case_id, l, r ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), a.point_idx, b.point_idx) = 1""")
def contact_point(spark, d):
    from pyspark.sql import Window

    p = points(spark, d)
    pairs = p.select(*KEYS).distinct().withColumn("right", F.lead("cell_id").over(Window.partitionBy("case_id").orderBy("cell_id"))).filter("right is not null").select("case_id", F.col("cell_id").alias("left"), "right")
    return S.contact_point(p, pairs).select("case_id", "left", "right", *r6("x", "y", "z", "gap"))


AXES = list(zip("xyz", "ras", strict=True))


@query("q2_5_17_labelling_features", f"""WITH {ARC}, f AS (SELECT *, {', '.join(f'first_value({v}) OVER {W} AS {v}0' for v in 'xyz')} FROM arcs), w AS (SELECT *, sqrt(pow(x - x0, 2) + pow(y - y0, 2) + pow(z - z0, 2)) AS off FROM f),
g AS (SELECT {C}, count(*) AS points, avg(radius) AS mean_radius, min(radius) AS min_radius, max(radius) AS max_radius, max(arc) AS len, arg_min(radius, point_idx) AS fr, arg_max(radius, point_idx) AS lr, {', '.join(f'arg_min({v}, point_idx) AS a{n}, arg_max({v}, point_idx) AS b{n}, coalesce(arg_min({v}, point_idx) FILTER (off >= 10), arg_max({v}, point_idx)) AS d{n}, avg({v}) AS m{n}' for v, n in AXES)} FROM w GROUP BY ALL),
h AS (SELECT *, sqrt(pow(br - ar, 2) + pow(ba - aa, 2) + pow(bs - "as", 2)) AS chord, sqrt(pow(dr - ar, 2) + pow(da - aa, 2) + pow(ds - "as", 2)) AS away FROM g)
SELECT {C}, points, round(mean_radius, 6) AS mean_radius, round(fr, 6) AS first_radius, round(lr, 6) AS last_radius, round(CASE WHEN lr > 1e-6 THEN fr / lr ELSE 0 END, 6) AS radius_ratio, round(min_radius, 6) AS min_radius, round(max_radius, 6) AS max_radius, round(chord, 6) AS chord, round(CASE WHEN chord > 1e-6 THEN chord / nullif(len, 0) ELSE 0 END, 6) AS straightness,
 {', '.join(f'round(CASE WHEN chord > 1e-6 THEN (b{n} - "a{n}") / chord ELSE 0 END, 6) AS direction_{n}, round(CASE WHEN away > 1e-6 THEN (d{n} - "a{n}") / away ELSE 0 END, 6) AS departure_{n}, round("a{n}", 6) AS first_{n}, round(b{n}, 6) AS last_{n}, floor(m{n} * 1e5 + 0.5) / 1e5 AS mean_{n}' for _, n in AXES)} FROM h""".replace(" AS as,", ' AS "as",'))
def labelling_features(spark, d):
    out = S.cell_features(points(spark, d))
    means = ["mean_r", "mean_a", "mean_s"]
    return out.select(*KEYS, "points", *r6(*(c for c in out.columns if c not in (*KEYS, "points", *means))), *((F.floor(F.col(c) * 1e5 + 0.5) / 1e5).alias(c) for c in means))


def _masks(spark, d):
    v = voxels(spark, d)
    return v.filter("flag = 'A'").drop("flag"), v.filter("flag = 'R'").drop("flag")


@query("q2_5_20_bounding_box", f"WITH {VOX} SELECT case_id, {', '.join(f'{f}({n}) AS {n}_{f}' for n in 'ijk' for f in ('min', 'max'))} FROM vox WHERE flag = 'A' GROUP BY 1")
def bounding_box(spark, d):
    return V.bounding_box(_masks(spark, d)[0])


@query("q2_5_21_volume_check", f"""WITH {VOX}, b AS (SELECT case_id, count(*) * 40.0::DOUBLE AS volume, (max(i) - min(i)) * (max(j) - min(j)) * (max(k) - min(k)) * 40.0::DOUBLE AS box FROM vox WHERE flag = 'A' GROUP BY 1)
SELECT case_id, volume, box, CASE WHEN volume < 3.5e4 THEN 'volume' WHEN box < 2.5e6 THEN 'box too small' WHEN box > 3.5e7 THEN 'box too large' WHEN volume < 4e4 AND box < 4e6 THEN 'volume and box' END AS problem FROM b""")
def volume_check(spark, d):
    a = _masks(spark, d)[0]
    return V.volume_check(a, a.select("case_id").distinct().withColumn("volume_mm3", F.lit(40.0)))


@query("q2_5_22_component_sizes", f"WITH RECURSIVE {VOX}, {labels_sql('abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) <= 1')}, c AS (SELECT case_id, component, count(*) AS n FROM labels GROUP BY ALL HAVING count(*) >= 2) SELECT case_id, component, n, CAST(row_number() OVER w AS INTEGER) AS place FROM c WINDOW w AS (PARTITION BY case_id ORDER BY n DESC, component) QUALIFY row_number() OVER w <= 5")
def component_sizes(spark, d):
    return V.component_filter(V.voxel_components(_masks(spark, d)[0], 6), 2, 5)


@query("q2_5_23_component_centroid", f"WITH {VOX} SELECT case_id, k AS component, count(*) AS n, round(avg(i), 6) AS i, round(avg(j), 6) AS j FROM vox WHERE flag = 'A' GROUP BY 1, 2")
def component_centroid(spark, d):
    return V.centroids(_masks(spark, d)[0].withColumn("component", F.col("k"))).select("case_id", "component", "n", *r6("i", "j"))


DICE = f"WITH {VOX}, a AS (SELECT * FROM vox WHERE flag = 'A'), b AS (SELECT * FROM vox WHERE flag = 'R'), f AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.k, b.k) AS k, a.i AS ai, b.i AS bi FROM a FULL JOIN b ON a.case_id = b.case_id AND a.i = b.i AND a.j = b.j AND a.k = b.k)"


@query("q2_5_24_dice", f"{DICE} SELECT case_id, round(2.0 * count(CASE WHEN ai IS NOT NULL AND bi IS NOT NULL THEN 1 END) / (count(ai) + count(bi)), 6) AS dice FROM f GROUP BY 1")
def dice(spark, d):
    return V.dice(*_masks(spark, d)).select("case_id", *r6("dice"))


@query("q2_5_25_dice_per_slice", f"{DICE} SELECT case_id, k, round(2.0 * count(CASE WHEN ai IS NOT NULL AND bi IS NOT NULL THEN 1 END) / (count(ai) + count(bi)), 6) AS dice FROM f GROUP BY 1, 2")
def dice_per_slice(spark, d):
    return V.dice(*_masks(spark, d), ["k"]).select("case_id", "k", *r6("dice"))


@query("q2_6_19_best_slice_join", f"{DICE}, s AS (SELECT case_id, k, 2.0 * count(CASE WHEN ai IS NOT NULL AND bi IS NOT NULL THEN 1 END) / (count(ai) + count(bi)) AS dice FROM f GROUP BY 1, 2), c AS (SELECT case_id, k AS cut FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY dice DESC, k) = 1) SELECT v.case_id, i, j, k FROM vox v JOIN c USING (case_id) WHERE (flag = 'A' AND k <= cut) OR (flag = 'R' AND k > cut)")
def best_slice_join(spark, d):
    return V.stitch(*_masks(spark, d))


@query("q2_2_6_threshold_mask", f"WITH {SCORES} SELECT item_id, fold, class FROM scores WHERE score >= 0.05")
def threshold_mask(spark, d):
    return V.threshold(scores(spark, d).withColumnRenamed("score", "value"), 0.05).select("item_id", "fold", "class")


@query("q2_2_7_top_cut", f"WITH {VOX}, a AS (SELECT *, round_even(min(i) OVER w + 0.9 * (max(i) OVER w - min(i) OVER w), 0) AS t FROM vox WHERE flag = 'A' WINDOW w AS (PARTITION BY case_id)) SELECT case_id, i, j, k FROM a WHERE i < t")
def top_cut(spark, d):
    a = _masks(spark, d)[0].select("case_id", F.col("k").alias("i"), "j", F.col("i").alias("k"))
    return V.cut_top(a).select("case_id", F.col("k").alias("i"), "j", F.col("i").alias("k"))


@query("q2_2_8_crop_box", f"WITH {VOX} SELECT case_id, i - 10 AS i, j - 2 AS j, k - 1 AS k FROM vox WHERE flag = 'A' AND i BETWEEN 10 AND 30 AND j BETWEEN 2 AND 8 AND k BETWEEN 1 AND 6")
def crop_box(spark, d):
    a = _masks(spark, d)[0]
    limits = {"i_min": 10, "i_max": 30, "j_min": 2, "j_max": 8, "k_min": 1, "k_max": 6}
    return V.crop(a, a.select("case_id").distinct().withColumns({k: F.lit(v) for k, v in limits.items()}))


@query("q2_2_9_inside_box", f"WITH {PTS} SELECT {C}, count(*) >= 5 AND bool_and(x BETWEEN 1 AND 48 AND y BETWEEN 0 AND 10 AND z BETWEEN 0 AND 90) AS valid FROM points GROUP BY ALL")
def inside_box(spark, d):
    p = points(spark, d)
    limits = {"x_min": 1, "x_max": 48, "y_min": 0, "y_max": 10, "z_min": 0, "z_max": 90}
    return V.inside_box(p, p.select("case_id").distinct().withColumns({k: F.lit(v) for k, v in limits.items()}))


@query("q2_7_5_voxel_components", f"WITH RECURSIVE {VOX}, {labels_sql('true')} SELECT case_id, i, j, k, component FROM labels")
def voxel_components(spark, d):
    return V.voxel_components(_masks(spark, d)[0], 26).select("case_id", "i", "j", "k", "component")


SOFT = f"{SCORES}, m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY item_id, fold)) AS e FROM scores), p AS (SELECT item_id, fold, class, e / sum(e) OVER (PARTITION BY item_id, fold) AS prob FROM m)"


@query("q2_5_28_softmax", f"WITH {SOFT} SELECT item_id, fold, class, round(prob, 6) AS prob FROM p")
def softmax(spark, d):
    return Q.softmax(scores(spark, d), ["item_id", "fold"]).select("item_id", "fold", "class", *r6("prob"))


@query("q2_5_26_argmax_class", f"WITH {SCORES} SELECT item_id, fold, class, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY item_id, fold ORDER BY score DESC, class) = 1")
def argmax_class(spark, d):
    return Q.argmax(scores(spark, d), ["item_id", "fold"], "score").select("item_id", "fold", "class", *r6("score"))


@query("q2_5_27_ensemble_vote", f"WITH {SOFT}, a AS (SELECT item_id, class, avg(prob) AS prob FROM p GROUP BY ALL) SELECT item_id, class, round(prob, 6) AS prob FROM a QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY prob DESC, class) = 1")
def ensemble_vote(spark, d):
    return Q.ensemble_vote(Q.softmax(scores(spark, d), ["item_id", "fold"]), ["item_id"]).select("item_id", "class", *r6("prob"))


@query("q2_5_29_ensemble_mean_std", f"WITH {SOFT} SELECT item_id, class, round(avg(prob), 6) AS mean, round(stddev_pop(prob), 6) AS std FROM p GROUP BY ALL")
def ensemble_mean_std(spark, d):
    return Q.ensemble_stats(Q.softmax(scores(spark, d), ["item_id", "fold"]), ["item_id", "class"]).select("item_id", "class", *r6("mean", "std"))


@query("q2_5_30_edge_to_node_weight", f"WITH {TREE}, e AS (SELECT case_id, src AS node, length FROM tree UNION ALL SELECT case_id, dst, length FROM tree WHERE dst <> src) SELECT case_id, node, round(avg(length), 6) AS weight FROM e GROUP BY ALL")
def edge_to_node_weight(spark, d):
    return S.node_weight(tree(spark, d).withColumnRenamed("length", "weight")).select("case_id", "node", *r6("weight"))


ORDER_SQL = f"{NODES}, g AS (SELECT case_id, class_name, avg(node_id) AS m, count(*) AS n FROM nodes GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY m, class_name) AS place FROM g)"


def _order(spark, d):
    return S.class_order(tree_nodes(spark, d).withColumn("hierarchy", F.col("node_id")))


@query("q2_5_31_class_order", f"WITH {ORDER_SQL} SELECT case_id, class_name, round(m, 6) AS mean_level, n, CAST(place AS INTEGER) AS place FROM o")
def class_order(spark, d):
    return _order(spark, d).select("case_id", "class_name", *r6("mean_level"), "n", "place")


@query("q2_5_32_small_class_merge", f"WITH {ORDER_SQL} SELECT case_id, class_name, last_value(CASE WHEN n >= 7 OR place = 1 THEN class_name END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS merged FROM o")
def small_class_merge(spark, d):
    return S.merge_small(_order(spark, d), 7).select("case_id", "class_name", "merged")


@query("q2_7_26_segment_graph", f"WITH {ORDER_SQL}, l AS (SELECT case_id, class_name AS \"left\", lead(class_name) OVER (PARTITION BY case_id ORDER BY place) AS \"right\" FROM o) SELECT * FROM l WHERE \"right\" IS NOT NULL")
def segment_graph(spark, d):
    from tubula.operators.graph import segment_graph as f

    return f(_order(spark, d))


@query("q2_5_33_displacement_stats", f"WITH {ARC} SELECT class_name AS label, round(avg(step), 6) AS mean, round(max(step), 6) AS largest, count(*) AS n FROM arcs GROUP BY 1")
def displacement_stats(spark, d):
    from tubula.operators.polyline import step_length

    return Q.displacement_stats(points(spark, d).withColumn("displacement", step_length()).withColumnRenamed("class_name", "label")).select("label", *r6("mean", "largest"), "n")


@query("q2_5_36_polygon_area", f"WITH {PTS}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM points WINDOW w AS {W}), a AS (SELECT {C}, abs(sum(x * y2 - x2 * y)) / 2 AS area FROM n GROUP BY ALL) SELECT {C}, round(area, 5) AS area, round(sqrt(area / pi()), 5) AS radius FROM a")
def polygon_area(spark, d):
    ring = points(spark, d).select(*KEYS, F.col("point_idx").alias("idx"), F.col("x").alias("u"), F.col("y").alias("v"))
    return S.polygon_area(ring, KEYS).select(*KEYS, *(F.round(c, 5).alias(c) for c in ("area", "radius")))


@query("q2_5_38_ovality", "SELECT p_partkey, round(CASE WHEN p_size - 1 = 0 THEN 1.0 ELSE p_retailprice / 1000 / (p_size - 1) END, 9) AS ovality FROM part")
def ovality(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.ovality(F.col("p_retailprice") / 1000, F.col("p_size").cast("double") - 1), 9).alias("ovality"))


@query("q2_5_37_min_enclosing_circle")
def min_enclosing_circle(spark, d):
    p = points(spark, d).select("case_id", F.col("x").alias("u"), F.col("y").alias("v"))
    return S.enclosing_circle(p, ["case_id"]).select("case_id", *r6("cu", "cv", "radius"))
