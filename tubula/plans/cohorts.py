"""Queries of sources, cohort joins, checks, nearest-neighbour joins and graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tubula.operators import cleaning as K
from tubula.operators import graph as G
from tubula.operators import nearest as N
from tubula.operators import quality as Q
from tubula.operators import segments as S
from tubula.operators.polyline import KEYS
from tubula.plans.lines import r6
from tubula.plans.registry import ORACLES, query
from tubula.plans.views import ARC, CLOUD, NODES, PTS, TREE, cloud, points, table, tree, tree_nodes
from tubula.sources import cohort as S1
from tubula.streaming.incremental import apply_per_case, errors

C = "case_id, cell_id"
SIDES = ["left", "R", "esquerra", "Dreta", "x"]
#: The cohort: customers, side by market segment; files: line items of a case by ship mode flag.
COHORT = "cohort AS (SELECT c_custkey AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'r' END AS side, c_acctbal AS balance FROM customer)"
FILES = "files AS (SELECT DISTINCT o_custkey AS case_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'mask' WHEN o_orderpriority LIKE '2%' THEN 'marks' WHEN o_orderpriority LIKE '3%' THEN 'line' ELSE 'other' END AS name FROM orders)"


def _cohort(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 3 == 0, "l").when(F.col("c_custkey") % 3 == 1, "r").alias("side"), F.col("c_acctbal").alias("balance"))


def _files(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.when(p == "1", "mask").when(p == "2", "marks").when(p == "3", "line").otherwise("other").alias("name")).distinct()


@query("q2_1_3_points_round_trip", f"WITH {PTS} SELECT {C}, point_idx, round(x, 6) AS x, round(radius, 6) AS radius FROM points")
def points_round_trip(spark, d):
    return S1.explode_segments(S1.collect_segments(points(spark, d))).select(*KEYS, "point_idx", *r6("x", "radius"))


@query("q2_1_4_segments_from_points", f"WITH {PTS} SELECT {C}, string_agg(CAST(round(x * 100) AS BIGINT) || '/' || CAST(round(radius * 100) AS BIGINT), ' ' ORDER BY point_idx) AS line FROM points GROUP BY ALL")
def segments_from_points(spark, d):
    return S1.collect_segments(points(spark, d)).select(*KEYS, F.array_join(F.zip_with("coords", "radii", lambda c, r: F.concat_ws("/", F.round(c[0] * 100).cast("long").cast("string"), F.round(r * 100).cast("long").cast("string"))), " ").alias("line"))


@query("q2_1_6_landmark_markups", "WITH o AS (SELECT o_custkey AS case_id, o_orderpriority AS label, CAST(round(o_totalprice) AS BIGINT) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT case_id, string_agg(n || ':' || CASE WHEN label LIKE '1%' THEN 'Endpoint-' || n ELSE label END || ':' || x, ';' ORDER BY n) AS marks FROM o GROUP BY 1")
def landmark_markups(spark, d):
    label = F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("idx"), label.alias("label"), F.round("o_totalprice").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    marks = F.from_json("markups", "controlPoints array<struct<id:string,label:string,position:array<double>>>")["controlPoints"]
    text = F.transform(marks, lambda m: F.concat_ws(":", m["id"], m["label"], m["position"][0].cast("long").cast("string")))
    return S1.landmarks_to_markups(o).select("case_id", F.array_join(text, ";").alias("marks"))


@query("q2_1_7_natural_order", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS place FROM part")
def natural_order(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit("case"), F.col("p_partkey").cast("string"), F.lit(".ext")).alias("name"))
    return p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(S1.natural_key(F.col("name")))).alias("place"))


EXPECTED = {"mask": ["mask"], "marks": ["marks"], "line": ["line"]}
INV = f"{COHORT}, {FILES}, inv AS (SELECT c.case_id, coalesce(bool_or(name = 'mask'), false) AS mask, coalesce(bool_or(name = 'marks'), false) AS marks, coalesce(bool_or(name = 'line'), false) AS line FROM cohort c LEFT JOIN files f ON f.case_id = c.case_id GROUP BY 1)"


@query("q2_1_8_case_inventory", f"WITH {INV} SELECT *, CASE WHEN NOT mask THEN 'mask' WHEN NOT marks THEN 'marks' WHEN NOT line THEN 'line' END AS problem FROM inv")
def case_inventory(spark, d):
    return S1.case_inventory(_cohort(spark, d), _files(spark, d), EXPECTED, ["mask", "marks", "line"])


@query("q2_1_9_first_existing", f"WITH {FILES} SELECT case_id, CASE min(CASE name WHEN 'line' THEN 1 WHEN 'mask' THEN 2 END) WHEN 1 THEN 'line' ELSE 'mask' END AS name FROM files WHERE name IN ('line', 'mask') GROUP BY 1")
def first_existing(spark, d):
    return S1.first_existing(_files(spark, d), ["line", "mask"])


@query("q2_1_10_pathway_export", f"WITH {NODES} SELECT case_id, string_agg(CAST(x AS BIGINT) || '/' || CAST(radius AS BIGINT), ' ' ORDER BY node_id) AS line FROM nodes GROUP BY 1")
def pathway_export(spark, d):
    e = S1.export_points(tree_nodes(spark, d).withColumn("weight", F.col("radius")))
    return e.select("case_id", F.array_join(F.zip_with("points", "weights", lambda p, w: F.concat_ws("/", p[0].cast("long").cast("string"), w.cast("long").cast("string"))), " ").alias("line"))


@query("q2_2_10_case_selection", f"WITH {COHORT} SELECT case_id FROM cohort WHERE balance > 0 AND case_id NOT IN (SELECT o_custkey FROM orders)")
def case_selection(spark, d):
    c = _cohort(spark, d)
    return S1.select_cases(c, c.filter("balance > 0"), _files(spark, d)).select("case_id")


@query("q2_2_11_side_alias", "SELECT c_custkey AS case_id, CASE c_custkey % 5 WHEN 0 THEN 'l' WHEN 1 THEN 'r' WHEN 2 THEN 'l' WHEN 3 THEN 'r' END AS side FROM customer")
def side_alias(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.array(*map(F.lit, SIDES))[(F.col("c_custkey") % 5).cast("int")].alias("s"))
    return c.select("case_id", S1.side_alias(F.col("s")).alias("side"))


@query("q2_2_12_mode_rule", "SELECT c_custkey AS case_id, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'configured' END, CASE WHEN c_custkey % 5 = 0 THEN 'existing' END, CASE WHEN c_custkey % 3 = 0 THEN 'intracranial' END, CASE WHEN c_acctbal / 10 >= 250 THEN 'extracranial' ELSE 'intracranial' END) AS mode FROM customer")
def mode_rule(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("case_id"), F.when(k % 7 == 0, "configured").alias("configured"), F.when(k % 5 == 0, "existing").alias("existing"), F.when(k % 3 == 0, "scan_INTRA.nii").otherwise("scan.nii").alias("file_name"), (F.col("c_acctbal") / 10).alias("coverage"))
    return S1.detect_mode(c).select("case_id", "mode")


@query("q2_2_1_drop_duplicate_points", f"WITH {ARC}, s AS (SELECT *, row_number() OVER (PARTITION BY {C} ORDER BY point_idx) AS r FROM arcs) SELECT {C}, point_idx FROM s WHERE r = 1 OR step >= 5")
def drop_duplicate_points(spark, d):
    return K.drop_close_points(points(spark, d), 5.0).select(*KEYS, "point_idx")


ENDS_SQL = f"g AS (SELECT {C}, count(*) AS n, {', '.join(f'arg_min({v}, point_idx) AS {v}, arg_max({v}, point_idx) AS {v}2' for v in 'xyz')} FROM points GROUP BY ALL)"


@query("q2_2_2_drop_short_cells", f"WITH {PTS}, {ENDS_SQL} SELECT {C}, n FROM g WHERE n >= 2 AND sqrt(pow(x2 - x, 2) + pow(y2 - y, 2) + pow(z2 - z, 2)) >= 25")
def drop_short_cells(spark, d):
    return K.drop_degenerate_cells(points(spark, d), 25.0).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query("q2_2_3_remove_high_thin_cells", f"WITH {PTS}, c AS (SELECT case_id, min(z) AS lo, max(z) AS hi FROM points GROUP BY 1), m AS (SELECT {C}, avg(z) AS mz, avg(radius) AS mr FROM points GROUP BY ALL) SELECT m.case_id, cell_id FROM m JOIN c USING (case_id) WHERE NOT (mz > lo + 0.75 * (hi - lo) AND mr < 3)")
def remove_high_thin_cells(spark, d):
    return K.remove_high_thin(points(spark, d), 0.75, 3.0).select(*KEYS).distinct()


@query("q2_2_4_start_filter", f"WITH {PTS}, {ENDS_SQL}, o AS (SELECT case_id, arg_min(x, cell_id) AS ox, arg_min(y, cell_id) AS oy, arg_min(z, cell_id) AS oz FROM g GROUP BY 1) SELECT g.case_id, cell_id, n FROM g JOIN o USING (case_id) WHERE sqrt(pow(x - ox, 2) + pow(y - oy, 2) + pow(z - oz, 2)) <= 20")
def start_filter(spark, d):
    return K.filter_from_start(points(spark, d), 20.0).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query("q2_2_5_far_start_filter", f"WITH {PTS}, {ENDS_SQL} SELECT {C} FROM g WHERE n > 2 AND sqrt(pow(x - 25, 2) + pow(y - 5, 2) + pow(z - 40, 2)) <= 30")
def far_start_filter(spark, d):
    return K.clean_cells(points(spark, d), (25.0, 5.0, 40.0)).select(*KEYS).distinct()


FEATS = "feats AS (SELECT o_custkey AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'l' ELSE 'r' END || '-occlusion' AS path_id, sum(o_totalprice) AS length FROM orders GROUP BY ALL)"


def _feats(spark, d):
    side = F.when(F.col("o_orderkey") % 2 == 0, "l").otherwise("r")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id"), F.concat(side, F.lit("-occlusion")).alias("path_id")).agg(F.sum("o_totalprice").alias("length"))


@query("q2_6_1_collect_features", f"WITH {COHORT}, {FEATS} SELECT c.case_id, side, round(f.length, 4) AS length, round(g.length, 4) AS length_ica FROM cohort c JOIN feats f ON f.case_id = c.case_id AND f.path_id = side || '-occlusion' LEFT JOIN (SELECT case_id, replace(path_id, 'occlusion', 'ica') AS path_id, length FROM feats WHERE length > 500000) g ON g.case_id = c.case_id AND g.path_id = side || '-ica'")
def collect_features(spark, d):
    f = _feats(spark, d)
    ica = f.filter("length > 500000").withColumn("path_id", F.replace("path_id", F.lit("occlusion"), F.lit("ica")))
    return Q.collect_features(_cohort(spark, d), f, ica).select("case_id", "side", F.round("length", 4).alias("length"), F.round("length_ica", 4).alias("length_ica"))


@query("q2_6_2_not_collected", f"WITH {FILES}, {FEATS} SELECT DISTINCT case_id FROM files WHERE case_id NOT IN (SELECT case_id FROM feats WHERE path_id LIKE 'l%')")
def not_collected(spark, d):
    return Q.not_collected(_files(spark, d), _feats(spark, d).filter("path_id like 'l%'"))


@query("q2_6_3_skip_done", f"WITH {COHORT} SELECT case_id FROM cohort WHERE case_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def skip_done(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.lit("a").alias("settings"), (F.col("o_orderstatus") == "F").alias("complete"))
    return Q.pending(_cohort(spark, d).withColumn("settings", F.lit("a")), runs).select("case_id")


@query("q2_6_4_dedup_cases", "SELECT o_custkey AS case_id, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def dedup_cases(spark, d):
    return Q.first_rows(table(spark, d, "orders").withColumnRenamed("o_custkey", "case_id"), ["case_id"], ["o_orderkey"]).select("case_id", "o_orderkey")


@query("q2_6_5_propagate_cell_features", f"WITH {ARC}, g AS (SELECT {C}, max(arc) AS length FROM arcs GROUP BY ALL) SELECT p.case_id, p.cell_id, point_idx, round(length, 6) AS length FROM points p JOIN g USING ({C})")
def propagate_cell_features(spark, d):
    p = points(spark, d)
    return p.join(S.segment_length(p), KEYS).select(*KEYS, "point_idx", *r6("length"))


@query("q2_6_6_cell_label_lookup", f"WITH {PTS} SELECT {C}, arg_max(class_name, point_idx) AS class_name FROM points GROUP BY ALL")
def cell_label_lookup(spark, d):
    return K.cell_labels(points(spark, d))


GAP = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("q2_6_8_consolidate_points", f"WITH {CLOUD}, p AS (SELECT a.node_id AS i, b.node_id AS j FROM cloud a JOIN cloud b ON {GAP} <= 4), l AS (SELECT i, min(j) AS target FROM p GROUP BY 1) SELECT j AS node_id, arg_max(target, p.i) AS target FROM p JOIN l ON l.i = p.i GROUP BY 1")
def consolidate_points(spark, d):
    return N.consolidate(cloud(spark, d), "node_id", 4.0).select("node_id", "target")


@query("q2_6_9_radius_graph", f"WITH {CLOUD}, e AS (SELECT a.node_id AS src, b.node_id AS dst, {GAP} AS distance FROM cloud a JOIN cloud b ON a.node_id <> b.node_id AND {GAP} <= 10) SELECT src, dst, round(distance, 6) AS distance FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY distance, dst) <= 10")
def radius_graph(spark, d):
    return N.radius_graph(cloud(spark, d), "node_id", 10.0, 10).select("src", "dst", *r6("distance"))


@query("q2_6_10_nearest_in_set", f"WITH {CLOUD} SELECT a.node_id, arg_min(b.node_id, {GAP}) AS other, round(min({GAP}), 6) AS distance FROM cloud a JOIN cloud b ON a.label % 2 = 0 AND b.label % 2 = 1 GROUP BY 1")
def nearest_in_set(spark, d):
    c = cloud(spark, d)
    return N.nearest_in_set(c.filter("label % 2 = 0"), c.filter("label % 2 = 1").withColumnRenamed("node_id", "other"), "node_id", "other", 4.0).select("node_id", "other", *r6("distance"))


@query("q2_4_26_nearest_attribute", f"WITH {CLOUD}, n AS (SELECT a.node_id, arg_min(b.label, {GAP}) AS label FROM cloud a JOIN cloud b ON a.label % 2 = 0 AND b.label % 2 = 1 GROUP BY 1) SELECT * FROM n")
def nearest_attribute(spark, d):
    c = cloud(spark, d)
    return N.nearest_attribute(c.filter("label % 2 = 0").drop("label"), c.filter("label % 2 = 1").withColumnRenamed("node_id", "other"), "node_id", "other", "label", 4.0).select("node_id", "label")


@query("q2_6_12_merge_close_points", f"WITH RECURSIVE {CLOUD}, near AS (SELECT a.node_id AS i, b.node_id AS j FROM cloud a JOIN cloud b ON a.node_id <> b.node_id AND {GAP} <= 3), reach AS (SELECT node_id AS i, node_id AS j FROM cloud UNION SELECT r.i, n.j FROM reach r JOIN near n ON n.i = r.j), own AS (SELECT i, min(j) AS node FROM reach GROUP BY 1) SELECT node AS cluster, count(*) AS n, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(z), 5) AS z FROM own JOIN cloud ON node_id = i GROUP BY 1")
def merge_close_points(spark, d):
    return N.cluster_points(cloud(spark, d), "node_id", 3.0).select("cluster", "n", *(F.round(c, 5).alias(c) for c in "xyz"))


@query("q2_6_7_contract_close_points", f"WITH RECURSIVE {CLOUD}, near AS (SELECT a.node_id AS i, b.node_id AS j FROM cloud a JOIN cloud b ON a.node_id <> b.node_id AND {GAP} <= 2), reach AS (SELECT node_id AS i, node_id AS j FROM cloud UNION SELECT r.i, n.j FROM reach r JOIN near n ON n.i = r.j), own AS (SELECT i, min(j) AS node FROM reach GROUP BY 1) SELECT i AS node_id, node FROM own")
def contract_close_points(spark, d):
    return N.contract(cloud(spark, d), "node_id", 2.0).select("node_id", "node")


@query("q2_6_14b_distance_beyond", f"WITH {CLOUD} SELECT a.node_id, round(min({GAP}), 6) AS distance FROM cloud a JOIN cloud b ON b.label = 0 WHERE a.label = 1 GROUP BY 1")
def distance_beyond(spark, d):
    c = cloud(spark, d)
    return N.distance_to_mask(c.filter("label = 1"), c.filter("label = 0"), "node_id", None).select("node_id", *r6("distance"))


@query("q2_6_14_distance_to_mask", f"WITH {CLOUD} SELECT a.node_id, round(least(50.0, coalesce(min({GAP}), 50.0)), 6) AS distance FROM cloud a LEFT JOIN cloud b ON b.label = 0 WHERE a.label = 1 GROUP BY 1")
def distance_to_mask(spark, d):
    c = cloud(spark, d)
    return N.distance_to_mask(c.filter("label = 1"), c.filter("label = 0"), "node_id").select("node_id", *r6("distance"))


@query("q2_6_13_sample_volume", f"WITH {PTS}, vx AS (SELECT l_suppkey % 5 AS v, CAST(round(l_quantity) AS INTEGER) AS i, CAST(round(l_discount * 100) AS INTEGER) AS j, max(l_tax) AS value FROM lineitem GROUP BY ALL) SELECT {C}, point_idx, round(value, 6) AS value FROM points p LEFT JOIN vx ON v = case_id % 5 AND i = CAST(trunc(x) AS INTEGER) AND j = CAST(round(y) AS INTEGER)")
def sample_volume(spark, d):
    lines = table(spark, d, "lineitem")
    vx = lines.groupBy((F.col("l_suppkey") % 5).alias("case_id"), F.round("l_quantity").cast("int").alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("j")).agg(F.max("l_tax").alias("value")).withColumn("k", F.lit(0))
    p = points(spark, d).select((F.col("case_id") % 5).alias("case_id"), F.col("case_id").alias("own"), "cell_id", "point_idx", F.col("x").cast("int").alias("i"), F.round("y").cast("int").alias("j"), F.lit(0).alias("k"))
    return N.sample_volume(p, vx).select(F.col("own").alias("case_id"), "cell_id", "point_idx", *r6("value"))


@query("q2_6_20_landmark_pairs", f"WITH {FILES} SELECT a.case_id, 'p' AS path_id, a.case_id + 0.5::DOUBLE AS ax, 2.0 * a.case_id::DOUBLE AS bx FROM files a JOIN files b USING (case_id) WHERE a.name = 'mask' AND b.name = 'line'")
def landmark_pairs(spark, d):
    marks = _files(spark, d).select("case_id", F.col("name").alias("label"), F.when(F.col("name") == "mask", F.col("case_id") + 0.5).otherwise(F.col("case_id") * 2.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return Q.landmark_pairs(marks, spark.createDataFrame([("p", "mask", "line")], "path_id string, a string, b string")).select("case_id", "path_id", "ax", "bx")


@query("q2_7_3_degree", f"WITH {TREE}, e AS (SELECT case_id, src AS n FROM tree UNION ALL SELECT case_id, dst FROM tree) SELECT case_id, n AS node_id, count(*) AS degree FROM e GROUP BY ALL")
def degree(spark, d):
    return G.degree(tree(spark, d))


def _forest(spark, d):
    """The trees without their upper edges: several components."""
    return tree(spark, d).filter("src >= 6")


@query("q2_7_4_connected_components", f"WITH RECURSIVE {TREE}, {NODES}, up AS (SELECT case_id, node_id, node_id AS anc FROM nodes UNION ALL SELECT up.case_id, up.node_id, t.src FROM up JOIN tree t ON t.case_id = up.case_id AND t.dst = up.anc AND t.src >= 6) SELECT case_id, node_id, min(anc) AS component FROM up GROUP BY ALL")
def connected_components(spark, d):
    return G.components(tree_nodes(spark, d), _forest(spark, d))


@query("q2_7_6_small_component_filter", f"WITH RECURSIVE {TREE}, {NODES}, up AS (SELECT case_id, node_id, node_id AS anc FROM nodes UNION ALL SELECT up.case_id, up.node_id, t.src FROM up JOIN tree t ON t.case_id = up.case_id AND t.dst = up.anc AND t.src >= 6), c AS (SELECT case_id, node_id, min(anc) AS component FROM up GROUP BY ALL) SELECT case_id, node_id, component FROM c QUALIFY count(*) OVER (PARTITION BY case_id, component) >= 5")
def small_component_filter(spark, d):
    return G.drop_small(G.components(tree_nodes(spark, d), _forest(spark, d))).select("case_id", "node_id", "component")


LEVELS = f"WITH RECURSIVE {TREE}, lv AS (SELECT DISTINCT case_id, CAST(0 AS BIGINT) AS node_id, 0 AS level, CAST(NULL AS BIGINT) AS parent, 0.0::DOUBLE AS acc, '0' AS path FROM tree UNION ALL SELECT t.case_id, t.dst, level + 1, t.src, acc + t.length, path || ' ' || t.dst FROM lv JOIN tree t ON t.case_id = lv.case_id AND t.src = lv.node_id)"


@query("q2_7_8_bfs_hierarchy", f"{LEVELS} SELECT case_id, node_id, level, parent FROM lv")
def bfs_hierarchy(spark, d):
    t = tree(spark, d)
    return G.bfs_levels(t, t.select("case_id").distinct().withColumn("node_id", F.lit(0).cast("bigint"))).select("case_id", "node_id", "level", "parent")


@query("q2_7_10_accumulated_length", f"{LEVELS} SELECT case_id, node_id, round(acc, 6) AS acc FROM lv")
def accumulated_length(spark, d):
    t = tree(spark, d)
    return G.bfs_levels(t, t.select("case_id").distinct().withColumn("node_id", F.lit(0).cast("bigint")), "length").select("case_id", "node_id", *r6("acc"))


@query("q2_7_11_line_graph", f"WITH {TREE} SELECT DISTINCT a.case_id, a.dst AS a, b.dst AS b FROM tree a JOIN tree b ON a.case_id = b.case_id AND a.dst < b.dst AND (a.src = b.src OR a.dst = b.src OR a.src = b.dst)")
def line_graph(spark, d):
    return G.line_graph(tree(spark, d).withColumn("edge_id", F.col("dst")))


@query("q2_7_12_find_root", f"WITH {TREE}, {NODES}, e AS (SELECT case_id, src AS n FROM tree UNION ALL SELECT case_id, dst FROM tree), g AS (SELECT case_id, n FROM e GROUP BY ALL HAVING count(*) = 1) SELECT case_id, node_id FROM nodes JOIN g USING (case_id) WHERE n = node_id QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY radius DESC, node_id) = 1")
def find_root(spark, d):
    return G.find_root(tree_nodes(spark, d), G.degree(tree(spark, d)))


@query("q2_7_9_start_node_rules", f"WITH {TREE}, {NODES}, e AS (SELECT case_id, src AS n FROM tree UNION ALL SELECT case_id, dst FROM tree), g AS (SELECT case_id, n FROM e GROUP BY ALL HAVING count(*) = 1), h AS (SELECT *, min(z) OVER (PARTITION BY case_id) AS lo, max(z) OVER (PARTITION BY case_id) AS hi FROM nodes) SELECT h.case_id, node_id FROM h JOIN g ON g.case_id = h.case_id AND n = node_id WHERE z <= lo + 0.6 * (hi - lo) QUALIFY row_number() OVER (PARTITION BY h.case_id ORDER BY x DESC, node_id) = 1")
def start_node_rules(spark, d):
    return G.start_nodes(tree_nodes(spark, d), G.degree(tree(spark, d)))


@query("q2_7_13_root_to_leaf_paths", f"{LEVELS} SELECT case_id, node_id AS leaf, path FROM lv WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.case_id = lv.case_id AND t.src = lv.node_id)")
def root_to_leaf_paths(spark, d):
    t = tree(spark, d)
    return G.root_to_leaf_paths(t, t.select("case_id").distinct().withColumn("node_id", F.lit(0).cast("bigint"))).select("case_id", "leaf", F.array_join("path", " ").alias("path"))


@query("q2_7_1_cell_graph", f"WITH RECURSIVE {PTS}, {ENDS_SQL}, en AS (SELECT case_id, cell_id * 2 AS e, x, y, z FROM g UNION ALL SELECT case_id, cell_id * 2 + 1, x2, y2, z2 FROM g), near AS (SELECT a.case_id, a.e AS i, b.e AS j FROM en a JOIN en b ON a.case_id = b.case_id AND a.e <> b.e AND {GAP} <= 1), reach AS (SELECT case_id, e AS i, e AS j FROM en UNION SELECT r.case_id, r.i, n.j FROM reach r JOIN near n ON n.case_id = r.case_id AND n.i = r.j), node AS (SELECT case_id, i, min(j) AS node FROM reach GROUP BY ALL) SELECT g.case_id, cell_id, s.node AS src, t.node AS dst, n FROM g JOIN node s ON s.case_id = g.case_id AND s.i = cell_id * 2 JOIN node t ON t.case_id = g.case_id AND t.i = cell_id * 2 + 1")
def cell_graph(spark, d):
    return G.cell_graph(points(spark, d), 1.0)


@query("q2_7_2_dense_graph", f"WITH {ARC}, l AS (SELECT *, lag(point_idx) OVER (PARTITION BY {C} ORDER BY point_idx) AS src_idx FROM arcs) SELECT {C}, src_idx, point_idx AS dst_idx, round(step, 6) AS length FROM l WHERE src_idx IS NOT NULL")
def dense_graph(spark, d):
    return G.dense_graph(points(spark, d)).select(*KEYS, "src_idx", "dst_idx", *r6("length"))


@query("q2_7_29_neighbour_mean", f"WITH {TREE}, {NODES}, e AS (SELECT case_id, src AS n, dst AS m FROM tree UNION SELECT case_id, dst, src FROM tree) SELECT e.case_id, n AS node_id, round(avg(radius), 6) AS radius FROM e JOIN nodes ON nodes.case_id = e.case_id AND node_id = m GROUP BY ALL")
def neighbour_mean(spark, d):
    return G.neighbour_mean(tree_nodes(spark, d), tree(spark, d), "radius").select("case_id", "node_id", *r6("radius"))


@query("q2_7_24_merge_degree_2", f"WITH {TREE}, e AS (SELECT case_id, dst AS cell_id, src AS n FROM tree UNION ALL SELECT case_id, dst, dst FROM tree) SELECT case_id, n AS node, min(cell_id) AS a, max(cell_id) AS b FROM e GROUP BY case_id, n HAVING count(*) = 2 AND min(cell_id) <> max(cell_id)")
def merge_degree_2(spark, d):
    return G.merge_degree_2(tree(spark, d).withColumn("cell_id", F.col("dst")))


@query("q2_7_25_unify_models", "WITH s AS (SELECT l_returnflag AS model, max(l_linenumber) + 1 AS size FROM lineitem GROUP BY 1), o AS (SELECT model, coalesce(sum(size) OVER (ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s) SELECT model, CAST(l_linenumber + off AS BIGINT) AS group_id, count(*) AS n FROM lineitem JOIN o ON l_returnflag = model GROUP BY ALL")
def unify_models(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("group_id"))
    return G.union_with_offsets(m).groupBy("model", F.col("group_id").cast("bigint").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))


@query("q2_7_23_split_at_branches", f"WITH {PTS}, p AS (SELECT *, string_agg(x || ',' || y || ',' || z, '|') OVER (PARTITION BY {C} ORDER BY point_idx ROWS UNBOUNDED PRECEDING) AS pre FROM points), s AS (SELECT case_id, pre, count(*) AS sharing FROM p GROUP BY ALL), j AS (SELECT p.*, sharing FROM p JOIN s USING (case_id, pre)), c AS (SELECT *, CASE WHEN sharing <> lag(sharing) OVER (PARTITION BY {C} ORDER BY point_idx) THEN 1 ELSE 0 END AS ch FROM j) SELECT {C}, point_idx, sharing, CAST(sum(ch) OVER (PARTITION BY {C} ORDER BY point_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS piece FROM c")
def split_at_branches(spark, d):
    return G.split_at_branches(points(spark, d)).select(*KEYS, "point_idx", "sharing", "piece")


@query("q2_6_22_split_by_radius_peak", f"WITH {ARC}, l AS (SELECT *, max(arc) OVER (PARTITION BY {C}) AS len FROM arcs), t AS (SELECT {C}, arg_max(point_idx, (radius, -point_idx)) FILTER (arc >= len / 4 AND arc <= 3 * len / 4) AS pk FROM l GROUP BY ALL) SELECT {C}, point_idx, CASE WHEN len > 100 AND point_idx > pk THEN 1 ELSE 0 END AS half FROM l JOIN t USING ({C})")
def split_by_radius_peak(spark, d):
    return G.split_at_peak(points(spark, d), 100.0).select(*KEYS, "point_idx", "half")


@query("q2_11_12_reindex_nodes", f"WITH {NODES} SELECT case_id, node_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY node_id) - 1 AS INTEGER) AS index FROM nodes WHERE radius > 3")
def reindex_nodes(spark, d):
    return G.reindex(tree_nodes(spark, d).filter("radius > 3")).select("case_id", "node_id", "index")


@query("q2_11_13_rescale_levels", f"WITH {NODES} SELECT case_id, node_id, node_id - min(node_id) OVER (PARTITION BY case_id, class_name) AS hierarchy, max(node_id) OVER (PARTITION BY case_id, class_name) - min(node_id) OVER (PARTITION BY case_id, class_name) AS max_hierarchy FROM nodes")
def rescale_levels(spark, d):
    return G.rescale_levels(tree_nodes(spark, d).withColumn("hierarchy", F.col("node_id")), ["case_id", "class_name"]).select("case_id", "node_id", "hierarchy", "max_hierarchy")


RANGES = [("length", 15.0, 400000.0), ("balance", 0.0, 9000.0)]


def _wide(spark, d):
    f = _feats(spark, d).groupBy("case_id").agg(F.sum("length").alias("length"))
    return _cohort(spark, d).select("case_id", "balance").join(f, "case_id", "left")


@query("q2_8_1_range_findings", f"WITH {COHORT}, w AS (SELECT case_id, balance, (SELECT sum(o_totalprice) FROM orders WHERE o_custkey = case_id) AS length FROM cohort) SELECT case_id, 'length' AS feature, round(length, 4) AS value FROM w WHERE length < 15 OR length > 400000 UNION ALL SELECT case_id, 'balance', round(balance, 4) FROM w WHERE balance < 0 OR balance > 9000")
def range_findings(spark, d):
    r = Q.range_findings(_wide(spark, d), spark.createDataFrame(RANGES, "feature string, low double, high double"))
    return r.select("case_id", "feature", F.round("value", 4).alias("value"))


def _long(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("case_id"), F.col("event_type").alias("feature"), "value")


@query("q2_8_2_mad_outliers", "WITH m AS (SELECT event_type, median(value) AS md FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT value) > 2), a AS (SELECT e.event_type, median(abs(value - md)) AS mad FROM events e JOIN m USING (event_type) GROUP BY 1) SELECT event_id AS case_id, e.event_type AS feature, round(value, 6) AS value, round(0.6745 * (value - md) / mad, 5) AS z FROM events e JOIN m USING (event_type) JOIN a USING (event_type) WHERE mad > 0 AND abs(0.6745 * (value - md) / mad) > 3.5")
def mad_outliers(spark, d):
    return Q.mad_outliers(_long(spark, d)).select("case_id", "feature", *r6("value"), F.round("z", 5).alias("z"))


@query("q2_8_3_missing_outputs", f"WITH {COHORT}, {FILES} SELECT case_id, n AS name FROM cohort, (VALUES ('mask'), ('line')) v(n) WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.case_id = cohort.case_id AND f.name = n)")
def missing_outputs(spark, d):
    return Q.missing_outputs(_cohort(spark, d), _files(spark, d), ["mask", "line"])


@query("q2_8_4_min_nodes", f"WITH {PTS} SELECT {C}, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 5")
def min_nodes(spark, d):
    return Q.min_size(points(spark, d), KEYS, 5)


def _per_case(spark, d):
    """One row per case: a bounded group for functions over cases."""
    return points(spark, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


@query("q2_8_5_error_log", f"WITH {PTS} SELECT case_id, 'error: fewer than 40 points' AS error FROM points GROUP BY 1 HAVING count(*) < 40")
def error_log(spark, d):
    def check(part: pd.DataFrame) -> pd.DataFrame:
        if part["n"].iloc[0] < 40:
            raise ValueError("fewer than 40 points")
        return part[["case_id", "n"]]

    return errors(apply_per_case(_per_case(spark, d), check, "case_id long, n long"))


@query("q2_10_2_per_case_udf", f"WITH {PTS} SELECT case_id, count(*) AS n, CAST(NULL AS VARCHAR) AS error FROM points GROUP BY 1")
def per_case_udf(spark, d):
    return apply_per_case(_per_case(spark, d), lambda part: part[["case_id", "n"]], "case_id long, n long")


@query("q2_5_34_availability", f"WITH {INV} SELECT 'mask' AS artefact, count_if(mask) AS present, count(mask) AS applicable, string_agg(CASE WHEN NOT mask THEN case_id END, ' ' ORDER BY case_id) AS missing FROM inv UNION ALL SELECT 'marks', count_if(marks), count(marks), string_agg(CASE WHEN NOT marks THEN case_id END, ' ' ORDER BY case_id) FROM inv UNION ALL SELECT 'line', count_if(line), count(line), string_agg(CASE WHEN NOT line THEN case_id END, ' ' ORDER BY case_id) FROM inv")
def availability(spark, d):
    inv = S1.case_inventory(_cohort(spark, d), _files(spark, d), EXPECTED, ["mask", "marks", "line"])
    return Q.availability(inv, ["mask", "marks", "line"]).select("artefact", "present", "applicable", F.array_join("missing", " ").alias("missing"))


RUN = "run AS (SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'O' THEN 'processed' WHEN 'P' THEN 'skipped' ELSE 'failed' END AS outcome FROM orders)"


def _run(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(status == "O", "done").when(status == "P", "skipped").otherwise(F.concat(F.lit("error: "), "o_orderpriority")).alias("status"))


@query("q2_5_35_run_summary", f"WITH {RUN} SELECT count(*) AS cases, count(*) FILTER (outcome = 'processed') AS processed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, round(count(*) FILTER (outcome = 'processed') / count(*) FILTER (outcome <> 'skipped'), 6) AS share FROM run")
def run_summary(spark, d):
    return Q.run_summary(_run(spark, d)).select("cases", "processed", "skipped", "failed", *r6("share"))


@query("q2_5_35b_run_outcomes", f"WITH {RUN} SELECT case_id, outcome FROM run")
def run_outcomes(spark, d):
    return Q.run_outcomes(_run(spark, d))


@query("q2_9_3_distinct_types", f"WITH {NODES} SELECT case_id, array_to_string(list_sort(list(DISTINCT class_name)), ',') AS types FROM nodes WHERE class_name <> 'Brand#1' GROUP BY 1")
def distinct_types(spark, d):
    return tree_nodes(spark, d).filter("class_name <> 'Brand#1'").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("class_name")), ",").alias("types"))


@query("q2_9_4_edge_union", f"WITH {TREE} SELECT case_id, src, dst FROM tree WHERE dst % 2 = 0 UNION SELECT case_id, src, dst FROM tree WHERE dst % 3 = 0")
def edge_union(spark, d):
    t = tree(spark, d).select("case_id", "src", "dst")
    return t.filter("dst % 2 = 0").unionByName(t.filter("dst % 3 = 0")).distinct()


@query("q2_9_5_case_difference", f"WITH {COHORT} SELECT case_id FROM cohort EXCEPT SELECT o_custkey FROM orders")
def case_difference(spark, d):
    return _cohort(spark, d).select("case_id").subtract(table(spark, d, "orders").select("o_custkey"))


@query("q2_9_5b_case_intersection", f"WITH {COHORT} SELECT case_id FROM cohort INTERSECT SELECT o_custkey FROM orders")
def case_intersection(spark, d):
    return _cohort(spark, d).select("case_id").intersect(table(spark, d, "orders").select("o_custkey"))


@query("q2_9_1_top_k_components", f"WITH {NODES}, g AS (SELECT case_id, class_name AS component, count(*) AS n FROM nodes GROUP BY ALL) SELECT case_id, component, n FROM g QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, component) <= 3")
def top_k_components(spark, d):
    from tubula.operators.voxels import component_filter

    return component_filter(tree_nodes(spark, d).withColumn("component", F.col("class_name")), 1, 3).select("case_id", "component", "n")


@query("q2_11_16_stage_done", f"WITH {FILES} SELECT case_id, coalesce(bool_or(name = 'mask'), false) AND bool_or(name IN ('line', 'marks')) AS done FROM files GROUP BY 1")
def stage_done(spark, d):
    return Q.stage_done(_files(spark, d), [["mask"], ["line", "marks"]])


@query("q2_11_17_findings_report", f"SELECT 1 AS rank, 'range' AS kind, case_id, feature, round(value, 4) AS value FROM ({ORACLES['q2_8_1_range_findings']}) UNION ALL SELECT 2, 'outlier', case_id, feature, round(value, 4) FROM ({ORACLES['q2_8_2_mad_outliers']})")
def findings_report(spark, d):
    r = Q.range_findings(_wide(spark, d), spark.createDataFrame(RANGES, "feature string, low double, high double"))
    return Q.findings_report(r, Q.mad_outliers(_long(spark, d))).withColumn("value", F.round("value", 4))


@query("q2_3_15_normalize", "WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_id AS case_id, round(CASE WHEN e.event_type LIKE 'c%' THEN (value - m) / sd ELSE (value - lo) / (hi - lo) END, 6) AS normal FROM events e JOIN s USING (event_type)")
def normalize(spark, d):
    long = _long(spark, d)
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")).withColumn("rule", F.when(F.col("feature").like("c%"), "zscore").otherwise("minmax"))
    return Q.normalize(long, stats).select("case_id", *r6("normal"))


@query("q2_5_19_nearest_to_class", f"WITH {NODES} SELECT a.case_id, arg_min(a.node_id, ({GAP}, a.node_id)) AS node_id, round(min({GAP}), 6) AS distance FROM nodes a JOIN nodes b ON a.case_id = b.case_id AND a.class_name = 'Brand#11' AND b.class_name = 'Brand#22' GROUP BY 1")
def nearest_to_class(spark, d):
    return N.nearest_to_class(tree_nodes(spark, d), "Brand#11", "Brand#22").select("case_id", "node_id", *r6("distance"))


def bridges_sql(rounds: int) -> str:
    """Bridges as SQL: components by climbing to the top, then so many rounds of all pairs between what was
    attached and the rest, one after the other."""
    near = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
    rank = "CASE WHEN a.class_name = b.class_name THEN 0 WHEN a.class_name = 'Brand#11' AND b.class_name = 'Brand#22' THEN 1 ELSE 2 END"
    sql = f"WITH RECURSIVE {TREE}, {NODES}, up AS (SELECT case_id, node_id, node_id AS anc FROM nodes UNION ALL SELECT up.case_id, up.node_id, t.src FROM up JOIN tree t ON t.case_id = up.case_id AND t.dst = up.anc AND t.src >= 6), lab AS (SELECT * FROM nodes JOIN (SELECT case_id, node_id, min(anc) AS component FROM up GROUP BY ALL) USING (case_id, node_id)), in0 AS MATERIALIZED (SELECT case_id, component FROM lab WHERE node_id = 6)"
    for i in range(1, rounds + 1):
        sql += f""", b{i} AS MATERIALIZED (SELECT a.case_id, a.component, min(({rank}, {near}, a.node_id, b.node_id)) AS m FROM lab a JOIN lab b ON b.case_id = a.case_id AND {near} <= 70
 WHERE (a.case_id, a.component) NOT IN (SELECT * FROM in{i - 1}) AND (b.case_id, b.component) IN (SELECT * FROM in{i - 1}) GROUP BY 1, 2), in{i} AS MATERIALIZED (SELECT * FROM in{i - 1} UNION ALL SELECT case_id, component FROM b{i})"""
    return sql + ", bridge AS (" + " UNION ALL ".join(f"SELECT case_id, component, m FROM b{i}" for i in range(1, rounds + 1)) + ")"


#: Rounds that the bridges of these trees take at most, with one to spare (a box of 50 x 97 x 100 has few hops of 70).
BRIDGES = bridges_sql(3)


@query("q2_7_22_join_components", f"{BRIDGES} SELECT case_id, m[3] AS src, m[4] AS dst, round(m[2], 6) AS distance FROM bridge")
def join_components(spark, d):
    nodes = tree_nodes(spark, d)
    return G.join_components(nodes, _forest(spark, d), {"Brand#11": "Brand#22"}, F.col("node_id") == 6).select("case_id", "src", "dst", *r6("distance"))
