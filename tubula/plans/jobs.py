"""Queries of pathways, vessels and composed jobs, and of operators on files, landmarks and voxels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tubula.functions.geom import to_ras
from tubula.functions.runtime import cut_lineage, shared_dir
from tubula.operators import graph as G
from tubula.operators import nearest as N
from tubula.operators import polyline as P
from tubula.operators import quality as Q
from tubula.operators import segments as S
from tubula.operators import vessels as A
from tubula.operators import voxels as V
from tubula.operators.polyline import KEYS
from tubula.plans.aggregates import FEATURES
from tubula.plans.cohorts import BRIDGES
from tubula.plans.lines import GAUSS, _grad, r6
from tubula.plans.registry import ORACLES, query
from tubula.plans.views import ANATOMY, ARC, CLOUD, NODES, PTS, TREE, VESSELS, VOX, anatomy, cloud, events_line, labels_sql, points, table, tree, tree_nodes, voxels
from tubula.sources import cohort as S1
from tubula.streaming.incremental import run_incremental

C = "case_id, cell_id"


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


@query("q2_1_1_read_cohort", "SELECT CAST(c_custkey AS VARCHAR) AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'r' END AS side, c_mktsegment AS segment FROM customer")
def read_cohort(spark, d):
    side = F.when(F.col("c_custkey") % 3 == 0, " Left").when(F.col("c_custkey") % 3 == 1, "dreta").otherwise("?")
    path = _folder(spark)
    S1.write_table(table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("Patient"), side.alias("Side"), F.col("c_mktsegment").alias("segment")), path, "csv")
    return S1.read_cohort(spark, path, ["case", "patient"], ["side"])


@query("q2_1_2_write_feature_table", "SELECT o_custkey AS case_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def write_feature_table(spark, d):
    path = _folder(spark)
    f = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    S1.write_table(f, path, "csv")
    return spark.read.schema("case_id long, n long, total double").csv(path, header=True)


@query("q2_1_5_landmark_reader", "SELECT o_orderkey AS case_id, o_orderpriority AS label, CASE WHEN o_orderkey % 2 = 0 THEN -1.0 ELSE 1.0 END * o_custkey AS x, CASE WHEN o_orderkey % 2 = 0 THEN -2.0 ELSE 2.0 END AS y, 3.0::DOUBLE AS z FROM orders")
def landmark_reader(spark, d):
    o, path = table(spark, d, "orders"), _folder(spark)
    at = F.array(F.col("o_custkey").cast("double"), F.lit(2.0), F.lit(3.0))
    marked = F.to_json(F.struct(F.col("o_orderkey").alias("case_id"), F.array(F.struct(F.lit("LPS").alias("coordinateSystem"), F.array(F.struct(F.col("o_orderpriority").alias("label"), at.alias("position"))).alias("controlPoints"))).alias("markups")))
    flat = F.concat(F.lit('{"'), F.col("o_orderpriority"), F.lit('": '), F.to_json(at), F.lit("}"))
    rows = o.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 2 == 0, marked).otherwise(flat).alias("json"))
    rows.write.parquet(path)
    return S1.parse_landmarks(spark.read.parquet(path))


ORDERED = f"WITH RECURSIVE {ANATOMY}, leaf AS (SELECT case_id, dst AS leaf, cell_id AS c FROM aedges e WHERE NOT EXISTS (SELECT 1 FROM aedges f WHERE f.case_id = e.case_id AND f.src = e.dst)), up AS (SELECT case_id, leaf, c, c AS last, CAST(c AS VARCHAR) AS cells FROM leaf UNION ALL SELECT case_id, leaf, CAST(floor((c - 1) / 2.0) AS BIGINT), last, CAST(floor((c - 1) / 2.0) AS BIGINT) || ' ' || cells FROM up WHERE c > 0)"


def _paths(spark, d):
    nodes, edges = anatomy(spark, d)
    return nodes, edges, G.root_to_leaf_paths(edges, nodes.filter("node_id = 0").select("case_id", "node_id"))


@query("q2_7_14_path_cells", f"{ORDERED} SELECT case_id, leaf, cells FROM up WHERE c = 0")
def path_cells(spark, d):
    _, edges, paths = _paths(spark, d)
    return G.path_cells(paths, edges).select("case_id", "leaf", F.array_join("cells", " ").alias("cells"))


PATHS = f"{ORDERED}, chain AS (SELECT case_id, leaf, cells, last FROM up WHERE c = 0), own AS (SELECT up.case_id, up.leaf, bool_or(artificial) AS artificial, sum(CASE WHEN e.cell_id = up.last THEN length ELSE 0 END) AS last_length FROM up JOIN aedges e ON e.case_id = up.case_id AND e.cell_id = up.c AND e.dst <= CASE WHEN up.c = up.last THEN up.leaf ELSE e.dst END GROUP BY ALL), ptab AS (SELECT chain.*, artificial, last_length, class_name AS last_type FROM chain JOIN own USING (case_id, leaf) JOIN vessel ON i = last % 13)"


@query("q2_7_14b_path_table", f"{PATHS} SELECT case_id, leaf, cells, last_type, artificial, round(last_length, 6) AS last_length FROM ptab")
def path_table(spark, d):
    _, edges, paths = _paths(spark, d)
    return A.path_table(paths, edges).select("case_id", "leaf", F.array_join("cells", " ").alias("cells"), "last_type", "artificial", *r6("last_length"))


@query("q2_7_15_path_dedup", f"{PATHS}, merged AS (SELECT *, last_length AS ll, regexp_replace(cells, ' ?[0-9]+$', '') AS head, CASE WHEN last % 2 = 0 THEN 'even' ELSE 'odd' END AS lt FROM ptab) SELECT case_id, leaf FROM merged QUALIFY row_number() OVER (PARTITION BY case_id, head, lt ORDER BY artificial, ll DESC, leaf) = 1")
def path_dedup(spark, d):
    _, edges, paths = _paths(spark, d)
    t = A.path_table(paths, edges).withColumn("last_type", F.when(F.element_at("cells", -1) % 2 == 0, "even").otherwise("odd"))
    return G.path_dedup(t).select("case_id", "leaf")


SLOTS = ["other", *VESSELS]


def _vector(classes: str, high: str, counter: str) -> str:
    c, h, k = classes.split(), high.split(), counter.split()
    return "[" + ", ".join(str(int(s in c) + int(s in h) - int(s in k)) for s in SLOTS) + "]"


CONFIGS = "configs(config, wanted) AS (VALUES " + ", ".join(f"('{n}', {_vector(*v)})" for n, *v in A.PATHWAYS) + ")"
MATCH = f"{PATHS}, {CONFIGS}, kinds AS (SELECT DISTINCT up.case_id, up.leaf, vessel.class_name FROM up JOIN vessel ON i = up.c % 13), vec AS (SELECT case_id, leaf, [{', '.join(f'max(CASE WHEN class_name = {chr(39)}{s}{chr(39)} THEN 1 ELSE 0 END)' for s in SLOTS)}] AS v FROM kinds GROUP BY ALL), scored AS (SELECT vec.case_id, config, vec.leaf, list_dot_product(v::DOUBLE[], wanted::DOUBLE[]) / (sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) * sqrt(list_dot_product(wanted::DOUBLE[], wanted::DOUBLE[]))) - CASE WHEN artificial THEN 0.15 ELSE 0 END AS score FROM vec JOIN ptab USING (case_id, leaf) CROSS JOIN configs), bestp AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY case_id, config ORDER BY score DESC, leaf) = 1)"


@query("q2_7_16_pathway_match", f"{MATCH} SELECT case_id, config, round(score, 6) AS score FROM bestp")
def pathway_match(spark, d):
    _, edges, paths = _paths(spark, d)
    return G.match_pathways(A.path_table(paths, edges), A.pathway_configs(spark)).select("case_id", "config", *r6("score"))


NEAR = f"WITH RECURSIVE {ANATOMY}, onp AS (SELECT case_id, node_id FROM anodes WHERE node_id <= 8), grow AS (SELECT case_id, node_id, 0.0::DOUBLE AS away FROM onp UNION SELECT g.case_id, e.dst, g.away + e.length FROM grow g JOIN aedges e ON e.case_id = g.case_id AND e.src = g.node_id WHERE g.away + e.length <= 15)"


def _subgraph(spark, d):
    nodes, edges = anatomy(spark, d)
    return nodes, edges, G.pathway_subgraph(nodes, edges, nodes.filter("node_id <= 8").select("case_id", "node_id"))


@query("q2_7_17_pathway_subgraph", f"{NEAR} SELECT case_id, node_id, min(away) = 0 AS on_path FROM grow GROUP BY ALL")
def pathway_subgraph(spark, d):
    return _subgraph(spark, d)[2]


@query("q2_7_18_path_filter", f"WITH {ANATOMY} SELECT case_id, src, dst FROM aedges WHERE src <= 8 AND dst <= 8")
def path_filter(spark, d):
    _, edges, sub = _subgraph(spark, d)
    return G.path_only(sub, edges).select("case_id", "src", "dst")


#: Cells of the anatomy as chains of nodes, from their upper end.
CELLS = "chains AS (SELECT case_id, cell_id, src AS node_id FROM aedges e WHERE NOT EXISTS (SELECT 1 FROM aedges f WHERE f.case_id = e.case_id AND f.cell_id = e.cell_id AND f.dst = e.src) UNION ALL SELECT case_id, cell_id, dst FROM aedges)"
ALONG = f"{CELLS}, ctr AS (SELECT case_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM anodes WHERE class_name = 'AA' GROUP BY 1), lng AS (SELECT h.*, row_number() OVER (PARTITION BY h.case_id, cell_id ORDER BY h.node_id) - 1 AS up, count(*) OVER (PARTITION BY h.case_id, cell_id) - row_number() OVER (PARTITION BY h.case_id, cell_id ORDER BY h.node_id) AS down, sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2)) AS away FROM chains h JOIN anodes a ON a.case_id = h.case_id AND a.node_id = h.node_id JOIN ctr ON ctr.case_id = h.case_id), walk AS (SELECT case_id, cell_id, node_id, CASE WHEN first_value(away) OVER (PARTITION BY case_id, cell_id ORDER BY up) <= first_value(away) OVER (PARTITION BY case_id, cell_id ORDER BY down) THEN up ELSE down END AS hierarchy FROM lng QUALIFY count(*) OVER (PARTITION BY case_id, cell_id) >= 3)"


@query("q2_7_19_single_vessel", f"WITH {ANATOMY}, {ALONG} SELECT case_id, cell_id, node_id, CAST(hierarchy AS INTEGER) AS hierarchy FROM walk")
def single_vessel(spark, d):
    return A.single_vessel(*anatomy(spark, d), "cell_id")


def _gap(p: str, q: str) -> str:
    """Least distance between the ends of two candidates."""
    return "least(" + ", ".join("sqrt(" + " + ".join(f"pow({p}.{e}{v} - {q}.{f}{v}, 2)" for v in "xyz") + ")" for e in "st" for f in "st") + ")"


def _nearest(k: int, before: str) -> str:
    """The choice of a vessel by the nearness to another one, on top of the choices before."""
    name, other = A.NEAREST_TO[k]
    return f"near{k} AS (SELECT c.* FROM scored_c c JOIN {before} o ON o.case_id = c.case_id AND o.name = '{other}' AND o.n >= 3 WHERE c.name = '{name}' QUALIFY row_number() OVER (PARTITION BY c.case_id ORDER BY {_gap('c', 'o')}, c.n DESC, c.root) = 1), pick{k} AS (SELECT * FROM {before} WHERE NOT (name = '{name}' AND case_id IN (SELECT case_id FROM near{k})) UNION ALL SELECT * FROM near{k})"


def _from_aim(e: str) -> str:
    """Distance of an end from the centre of AA, for AA itself from the origin."""
    return "coalesce(sqrt(" + " + ".join(f"pow({e}{v} - CASE WHEN name = 'AA' THEN 0 ELSE m{v} END, 2)" for v in "xyz") + "), 0)"


#: Chains of cells of one class (no two children of a cell have its class), their choice by case and class, and the walk.
CHOICE = f"""{ANATOMY}, own_cells AS (SELECT DISTINCT case_id, cell_id AS c FROM aedges),
kin AS (SELECT case_id, c, c AS root FROM own_cells WHERE c = 0 OR CAST(floor((c - 1) / 2.0) AS BIGINT) % 13 <> c % 13 UNION ALL SELECT k.case_id, q.c, k.root FROM kin k JOIN own_cells q ON q.case_id = k.case_id AND q.c IN (2 * k.c + 1, 2 * k.c + 2) AND q.c % 13 = k.c % 13),
mem AS (SELECT k.case_id, k.root, e.dst AS node_id, e.length FROM kin k JOIN aedges e ON e.case_id = k.case_id AND e.cell_id = k.c UNION ALL SELECT case_id, root, CASE WHEN root = 0 THEN 0 ELSE 8 * CAST(floor((root - 1) / 2.0) AS BIGINT) + 8 END, 0.0 FROM kin WHERE c = root),
spot AS (SELECT m.*, v.class_name AS name, x, y, z, radius, a.hierarchy AS lv FROM mem m JOIN anodes a USING (case_id, node_id) JOIN vessel v ON i = root % 13),
cand AS (SELECT case_id, name, root, count(*) AS n, sum(length) AS len, avg(radius) AS rad, {', '.join(f'{f}({v}, lv) AS {e}{v}' for e, f in (('s', 'arg_min'), ('t', 'arg_max')) for v in 'xyz')}, arg_min(node_id, lv) AS a_id, arg_max(node_id, lv) AS b_id, min(lv) AS low, max(lv) AS high FROM spot GROUP BY ALL),
scored_c AS (SELECT *, CASE WHEN name <> 'LCCA' THEN n WHEN count(*) FILTER (len > 50) OVER w > 1 THEN CASE WHEN len > 50 THEN rad ELSE -1 END ELSE len END AS score FROM cand WINDOW w AS (PARTITION BY case_id, name)),
plain AS (SELECT * FROM scored_c QUALIFY row_number() OVER (PARTITION BY case_id, name ORDER BY score DESC, root) = 1),
{_nearest(0, 'plain')}, {_nearest(1, 'pick0')}, {_nearest(2, 'pick1')},
aim AS (SELECT case_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM anodes WHERE class_name = 'AA' GROUP BY 1),
turned AS (SELECT p.*, ({_from_aim('t')}, b_id) < ({_from_aim('s')}, a_id) AS turn FROM pick2 p LEFT JOIN aim USING (case_id) WHERE n >= 3),
one AS (SELECT case_id, name AS class_name, node_id, CASE WHEN turn THEN high - lv ELSE lv - low END AS hierarchy FROM turned JOIN spot USING (case_id, name, root))"""
CHAINED = f"""{CHOICE}, chn(chain, class_name, part, parts) AS (VALUES {', '.join(f"('{k}', '{c}', {i}, {len(v)})" for k, v in A.CHAINS.items() for i, c in enumerate(v))}),
cm AS (SELECT case_id, chain, part, parts, node_id, hierarchy FROM one JOIN chn USING (class_name)), whole_c AS (SELECT case_id, chain FROM cm GROUP BY case_id, chain, parts HAVING count(DISTINCT part) = parts),
joint AS (SELECT case_id, src AS n, dst AS m FROM aedges UNION ALL SELECT case_id, dst, src FROM aedges UNION ALL SELECT case_id, node_id, node_id FROM anodes), touch AS (SELECT DISTINCT j.case_id FROM joint j JOIN one b ON b.case_id = j.case_id AND b.node_id = n AND b.class_name = 'BT' JOIN one l ON l.case_id = j.case_id AND l.node_id = m AND l.class_name = 'LCCA'),
cmo AS (SELECT cm.* FROM cm JOIN whole_c USING (case_id, chain) WHERE chain <> 'BT-LCA' OR case_id IN (SELECT case_id FROM touch)),
shifts AS (SELECT case_id, chain, part, coalesce(sum(max(hierarchy) + 1) OVER (PARTITION BY case_id, chain ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM cmo GROUP BY case_id, chain, part),
conc AS (SELECT case_id, chain AS class_name, part, node_id, hierarchy + shift AS hierarchy FROM cmo JOIN shifts USING (case_id, chain, part) QUALIFY row_number() OVER (PARTITION BY case_id, chain, node_id ORDER BY part) = 1)"""


@query("q2_7_19b_vessel_choice", f"WITH RECURSIVE {CHOICE} SELECT case_id, class_name, node_id, CAST(hierarchy AS INTEGER) AS hierarchy FROM one")
def vessel_choice(spark, d):
    return A.single_vessel(*anatomy(spark, d))


@query("q2_7_20_chain_order", f"WITH {ANATOMY}, {CELLS} SELECT case_id, cell_id, node_id, CAST(row_number() OVER (PARTITION BY case_id, cell_id ORDER BY node_id) - 1 AS INTEGER) AS place FROM chains")
def chain_order(spark, d):
    _, edges = anatomy(spark, d)
    one = edges.select((F.col("case_id") * 1_000_000 + F.col("cell_id")).alias("case_id"), "src", "dst")
    return A.chain_order(one).select(F.floor(F.col("case_id") / 1_000_000).alias("case_id"), (F.col("case_id") % 1_000_000).alias("cell_id"), "node_id", "place")


@query("q2_9_2_sort_components", f"WITH {NODES}, g AS (SELECT case_id, p_size % 7 AS component, count(*) AS n, avg(p_retailprice % 100) AS height FROM (SELECT p_partkey % 10 AS case_id, * FROM part) GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, component) = 1 AS main FROM g) SELECT case_id, component, n, round(height, 6) AS height, CAST(row_number() OVER (PARTITION BY case_id ORDER BY main DESC, height, component) AS INTEGER) AS place FROM m")
def sort_components(spark, d):
    n = tree_nodes(spark, d)
    return A.sort_components(n, n.select("case_id", "node_id", (F.col("x") % 7).cast("int").alias("component"))).select("case_id", "component", "n", *r6("height"), "place")


@query("q2_7_7_remote_component_filter", f"WITH {NODES}, p AS (SELECT *, CAST(x AS INTEGER) AS component, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM nodes WINDOW w AS (PARTITION BY case_id)), q AS (SELECT *, avg(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) OVER (PARTITION BY case_id) AS mean FROM p), c AS (SELECT case_id, component, sqrt(pow(avg(x) - any_value(mx), 2) + pow(avg(y) - any_value(my), 2) + pow(avg(z) - any_value(mz), 2)) AS distance, any_value(mean) AS mean FROM q GROUP BY ALL) SELECT case_id, component, round(distance, 5) AS distance FROM c WHERE distance > 0.8 * mean")
def remote_component_filter(spark, d):
    return G.remote_components(tree_nodes(spark, d).withColumn("component", F.col("x").cast("int")), 0.8).select("case_id", "component", F.round("distance", 5).alias("distance"))


@query("q2_7_8b_hierarchy", f"""WITH RECURSIVE {TREE}, {NODES}, forest AS (SELECT * FROM tree WHERE src >= 6), up AS (SELECT case_id, node_id, node_id AS anc, 0 AS level FROM nodes UNION ALL SELECT up.case_id, up.node_id, t.src, level + 1 FROM up JOIN forest t ON t.case_id = up.case_id AND t.dst = up.anc),
top AS (SELECT case_id, node_id, min(anc) AS root, max(level) AS depth FROM up GROUP BY ALL), size AS (SELECT case_id, root, max(depth) + 1 AS n FROM top GROUP BY ALL)
SELECT case_id, root AS component, n FROM size WHERE n = 1""")
def hierarchy(spark, d):
    n, e = tree_nodes(spark, d), tree(spark, d).filter("src >= 6")
    levels, _ = G.hierarchy(n, e, G.first_nodes(n))
    c = G.components(n, e)
    return levels.join(c, ["case_id", "node_id"]).groupBy("case_id", "component").agg((F.max("level") - F.min("level") + 1).alias("n")).filter("n = 1")


@query("q2_7_9b_lowest_ends", f"WITH {TREE}, {NODES}, e AS (SELECT case_id, src AS n FROM tree UNION ALL SELECT case_id, dst FROM tree), g AS (SELECT case_id, n FROM e GROUP BY ALL HAVING count(*) = 1) SELECT h.case_id, h.case_id AS component, node_id FROM nodes h JOIN g ON g.case_id = h.case_id AND n = node_id QUALIFY row_number() OVER (PARTITION BY h.case_id ORDER BY z, node_id) = 1")
def lowest_ends(spark, d):
    n = tree_nodes(spark, d)
    return G.lowest_ends(n, G.degree(tree(spark, d)), n.select("case_id", "node_id", F.col("case_id").alias("component")))


@query("q2_7_2b_contracted_graph", f"WITH {PTS}, k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY cell_id, point_idx) AS a FROM points), nm AS (SELECT *, min(a) OVER (PARTITION BY case_id, x, round(y, 6), z) AS node FROM k), e AS (SELECT case_id, cell_id, lag(node) OVER (PARTITION BY case_id, cell_id ORDER BY point_idx) AS s, node AS t FROM nm), u AS (SELECT DISTINCT case_id, least(s, t) AS s, greatest(s, t) AS t FROM e WHERE s IS NOT NULL AND s <> t) SELECT case_id, count(*) AS edges, (SELECT count(DISTINCT n) FROM (SELECT case_id AS c, s AS n FROM u UNION ALL SELECT case_id, t FROM u) v WHERE v.c = u.case_id) AS nodes FROM u GROUP BY 1")
def contracted_graph(spark, d):
    nodes, edges = G.contracted_graph(points(spark, d), 1e-6)
    n = nodes.groupBy("case_id").agg(F.count(F.lit(1)).alias("nodes"))
    return edges.groupBy("case_id").agg(F.count(F.lit(1)).alias("edges")).join(n, "case_id")


@query("q2_7_24b_merged_cells", f"WITH RECURSIVE {TREE}, t AS (SELECT case_id, dst AS cell_id, src, dst FROM tree), e AS (SELECT case_id, cell_id, src AS n FROM t UNION ALL SELECT case_id, cell_id, dst FROM t), p AS (SELECT case_id, min(cell_id) AS a, max(cell_id) AS b FROM e GROUP BY case_id, n HAVING count(*) = 2 AND min(cell_id) <> max(cell_id)), two AS (SELECT * FROM p UNION ALL SELECT case_id, b, a FROM p), reach AS (SELECT case_id, cell_id AS i, cell_id AS j FROM t UNION SELECT r.case_id, i, b FROM reach r JOIN two ON two.case_id = r.case_id AND two.a = j) SELECT case_id, i AS cell_id, min(j) AS merged FROM reach GROUP BY ALL")
def merged_cells(spark, d):
    return G.merge_cells(tree(spark, d).withColumn("cell_id", F.col("dst")))


@query("q2_6_11_snap_landmarks", f"""WITH {CLOUD}, g AS (SELECT a.node_id AS i, b.node_id AS j, b.label AS l, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS gap, b.x AS bx FROM cloud a JOIN cloud b ON a.label = 0 AND b.label IN (1, 2)),
br AS (SELECT i, arg_min(bx, (gap, j)) AS bx FROM g WHERE l = 1 AND gap <= 6 GROUP BY 1), ln AS (SELECT i, arg_min(bx, (gap, j)) AS bx FROM g WHERE l = 2 AND gap <= 6 GROUP BY 1)
SELECT CAST(node_id AS VARCHAR) AS label, round(coalesce(br.bx, ln.bx, x), 5) AS x, CASE WHEN br.bx IS NOT NULL THEN 'branch' WHEN ln.bx IS NOT NULL THEN 'line' ELSE 'none' END AS how FROM cloud LEFT JOIN br ON br.i = node_id LEFT JOIN ln ON ln.i = node_id WHERE label = 0""")
def snap_landmarks(spark, d):
    c = cloud(spark, d)
    part = lambda k: c.filter(F.col("label") == k).select("case_id", F.col("node_id").alias("point_id"), *"xyz")
    marks = c.filter("label = 0").select("case_id", F.col("node_id").cast("string").alias("label"), *"xyz")
    return N.snap_landmarks(marks, part(2), part(1), 6.0).select("label", F.round("x", 5).alias("x"), "how")


MIRROR = "w AS (SELECT o_orderkey AS case_id, 50.0::DOUBLE AS mid, o_custkey % 100 AS lx, 3.0::DOUBLE AS ly, 4.0::DOUBLE AS lz, o_orderkey % 100 AS rx, 5.0::DOUBLE AS ry, 9.0::DOUBLE AS rz, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 40 END AS l_distance, o_custkey % 40 AS r_distance FROM orders), f AS (SELECT *, coalesce(l_distance BETWEEN 3.7 AND 28.5, false) AS gl, coalesce(r_distance BETWEEN 3.1 AND 31.1, false) AS gr FROM w)"


@query("q2_6_15_mirror_correction", f"WITH {MIRROR}, m AS (SELECT *, NOT gl AND gr AND sqrt(pow(2 * mid - rx - lx, 2) + 29) > 5 AS fl, NOT gr AND gl AND sqrt(pow(2 * mid - lx - rx, 2) + 29) > 5 AS fr FROM f) SELECT case_id, CAST(CASE WHEN fl THEN 2 * mid - rx ELSE lx END AS DOUBLE) AS lx, CASE WHEN fl THEN ry ELSE ly END AS ly, CASE WHEN fl THEN rz ELSE lz END AS lz, CAST(CASE WHEN fr THEN 2 * mid - lx ELSE rx END AS DOUBLE) AS rx, CASE WHEN fr THEN ly ELSE ry END AS ry, CASE WHEN fr THEN lz ELSE rz END AS rz, fl OR fr AS mirrored FROM m")
def mirror_correction(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wide = table(spark, d, "orders").select(k.alias("case_id"), F.lit(50.0).alias("mid"), (c % 100).cast("double").alias("lx"), F.lit(3.0).alias("ly"), F.lit(4.0).alias("lz"), (k % 100).cast("double").alias("rx"), F.lit(5.0).alias("ry"), F.lit(9.0).alias("rz"), F.when(k % 5 > 0, (k % 40).cast("double")).alias("l_distance"), (c % 40).cast("double").alias("r_distance"))
    return Q.mirror_fix(wide, (16.1, 6.2), (17.1, 7.0))


GRID = f"{VOX}, mask AS (SELECT DISTINCT case_id, i, j, k FROM vox WHERE flag = 'A')"


def _mask(spark, d):
    return voxels(spark, d).filter("flag = 'A'").select("case_id", "i", "j", "k")


def _marks(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 40 = 1")
    return o.select((F.col("o_orderkey") % 5).alias("case_id"), F.col("o_orderkey").cast("string").alias("label"), *((F.col("o_custkey") % n).cast("int").alias(v) for v, n in (("i", 50), ("j", 11), ("k", 9))))


MARKS = "mk AS (SELECT o_orderkey % 5 AS case_id, CAST(o_orderkey AS VARCHAR) AS label, CAST(o_custkey % 50 AS INTEGER) AS i, CAST(o_custkey % 11 AS INTEGER) AS j, CAST(o_custkey % 9 AS INTEGER) AS k FROM orders WHERE o_orderkey % 40 = 1)"


@query("q2_6_16_keep_or_relocate", f"WITH {GRID}, {MARKS} SELECT mk.case_id, label, CASE WHEN m.i IS NULL THEN mk.i + 1 ELSE mk.i END AS i, mk.j, mk.k, m.i IS NOT NULL AS inside FROM mk LEFT JOIN mask m ON m.case_id = mk.case_id AND m.i = mk.i AND m.j = mk.j AND m.k = mk.k")
def keep_or_relocate(spark, d):
    m = _marks(spark, d)
    return V.keep_or_relocate(m, m.withColumn("i", F.col("i") + 1), _mask(spark, d))


MOVED = f"""WITH RECURSIVE {VOX}, {MARKS}, {labels_sql('true')}, win AS (SELECT mk.case_id, label, r, component, pow(avg(l.i) - any_value(mk.i), 2) + pow(avg(l.j) - any_value(mk.j), 2) + pow(avg(l.k) - any_value(mk.k), 2) AS gap, avg(l.i) AS ci, avg(l.j) AS cj, avg(l.k) AS ck
 FROM mk CROSS JOIN range(1, 6) t(r) JOIN labels l ON l.case_id = mk.case_id AND abs(l.i - mk.i) <= 5 * r AND abs(l.j - mk.j) <= 5 * r AND abs(l.k - mk.k) <= 5 * r GROUP BY mk.case_id, label, r, component), best AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY case_id, label ORDER BY r, gap, component) = 1)
SELECT mk.case_id, label, round(coalesce(ci, i), 6) AS i, round(coalesce(cj, j), 6) AS j, round(coalesce(ck, k), 6) AS k, ci IS NOT NULL AS moved FROM mk LEFT JOIN best USING (case_id, label)"""


@query("q2_6_17_relocate_to_component", MOVED)
def relocate_to_component(spark, d):
    return V.relocate_to_component(_marks(spark, d), _mask(spark, d)).select("case_id", "label", *r6("i", "j", "k"), "moved")


#: Spacing, mirrored axes and size of the images of the five masks: RAS, LAS and LPS.
SLAB = "img AS (SELECT c AS case_id, 0.43::DOUBLE * (1 + c % 2) AS s, CASE WHEN c % 3 = 0 THEN 1 ELSE -1 END AS sx, CASE WHEN c % 3 = 2 THEN -1 ELSE 1 END AS sy, c % 3 AS o FROM range(5) t(c))"
ENTRIES = f"""WITH RECURSIVE {GRID}, {MARKS}, {SLAB}, low AS (SELECT case_id, i, j FROM mask WHERE k = 0), reach AS (SELECT case_id, i, j, i AS ri, j AS rj FROM low UNION SELECT r.case_id, r.i, r.j, l.i, l.j FROM reach r JOIN low l ON l.case_id = r.case_id AND abs(l.i - ri) <= 1 AND abs(l.j - rj) <= 1),
comp AS (SELECT case_id, i, j, min(ri * 1099511627776 + rj * 1048576) AS component FROM reach GROUP BY ALL), cen AS (SELECT case_id, component, sx * s * avg(i) + 1 AS x, sy * s * avg(j) + 2 AS y, 0.4::DOUBLE + 3 AS z FROM comp JOIN img USING (case_id) GROUP BY case_id, component, s, sx, sy HAVING count(*) >= abs(round_even(5 * 0.07385254 / (sx * sy * s * s * 0.4), 0))),
ends AS (SELECT case_id, CAST(label AS BIGINT) AS end_id, sx * s * i + 1 + CAST(label AS BIGINT) % 7 * 0.013 AS x, sy * s * j + 2 AS y, 0.4::DOUBLE * k + 3 AS z FROM mk JOIN img USING (case_id)),
near AS (SELECT c.case_id, component, end_id, row_number() OVER (PARTITION BY c.case_id, component ORDER BY sqrt(pow(c.x - e.x, 2) + pow(c.y - e.y, 2) + pow(c.z - e.z, 2)), end_id) AS r FROM cen c JOIN ends e ON c.case_id = e.case_id AND sqrt(pow(c.x - e.x, 2) + pow(c.y - e.y, 2) + pow(c.z - e.z, 2)) < 3),
fin AS (SELECT e.case_id, e.end_id, m.component, x, y, z FROM ends e LEFT JOIN (SELECT case_id, end_id, min(component) AS component FROM near WHERE r = 1 GROUP BY ALL) m ON m.case_id = e.case_id AND m.end_id = e.end_id WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.case_id = e.case_id AND n.end_id = e.end_id AND r > 1)
 UNION ALL SELECT case_id, NULL, component, x, y, z FROM cen c WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.case_id = c.case_id AND n.component = c.component)),
num AS (SELECT f.*, row_number() OVER (PARTITION BY case_id ORDER BY end_id IS NULL, end_id, component) - 1 AS p, sqrt(pow(x - (sx * s * CASE WHEN o = 0 THEN 150 ELSE 350 END * 0.43 / s + 1), 2) + pow(y - (sy * s * CASE WHEN o = 2 THEN 12 ELSE 0 END + 2), 2) + pow(z - 3, 2)) AS gap FROM fin f JOIN img USING (case_id)),
st AS (SELECT case_id, arg_min(p, (gap, p)) AS b FROM num GROUP BY 1)
SELECT case_id, CAST(CASE WHEN p = b THEN 0 WHEN p = 0 THEN b ELSE p END AS INTEGER) AS place, end_id, component, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM num JOIN st USING (case_id)"""


@query("q2_6_18_slab_match", ENTRIES)
def slab_match(spark, d):
    c, zero = F.col("case_id"), F.lit(0.0)
    s = 0.43 * (1 + c % 2)
    sx, sy = F.when(c % 3 == 0, s).otherwise(-s), F.when(c % 3 == 2, -s).otherwise(s)
    affine = F.array(sx, zero, zero, F.lit(1.0), zero, sy, zero, F.lit(2.0), zero, zero, F.lit(0.4), F.lit(3.0), zero, zero, zero, F.lit(1.0))
    images = spark.range(5).select(F.col("id").alias("case_id")).withColumns({"affine": affine, "size_y": F.lit(12)})
    mark = _marks(spark, d).withColumn("end_id", F.col("label").cast("long")).join(images, "case_id")
    x, y, z = to_ras(F.col("i"), F.col("j"), F.col("k"), F.col("affine"))
    ends = mark.select("case_id", "end_id", (x + F.col("end_id") % 7 * 0.013).alias("x"), y.alias("y"), z.alias("z"))
    return V.entry_points(_mask(spark, d), ends, images, 5, 3.0).select("case_id", "place", "end_id", "component", *r6(*"xyz"))


@query("q2_6_21_chain_concat", f"WITH {ANATOMY}, t AS (SELECT case_id, node_id, hierarchy, CASE WHEN node_id <= 8 THEN 0 WHEN node_id <= 12 THEN 1 ELSE 2 END AS part FROM anodes WHERE node_id <= 20), s AS (SELECT case_id, part, sum(max(hierarchy) + 1) OVER (PARTITION BY case_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shift FROM t GROUP BY 1, 2) SELECT t.case_id, t.part, node_id, CAST(hierarchy + coalesce(shift, 0) AS BIGINT) AS hierarchy FROM t JOIN s USING (case_id, part)")
def chain_concat(spark, d):
    n = anatomy(spark, d)[0].filter("node_id <= 20").withColumn("part", F.when(F.col("node_id") <= 8, 0).when(F.col("node_id") <= 12, 1).otherwise(2))
    return G.concat_chain(n.select("case_id", "part", "node_id", "hierarchy")).withColumn("hierarchy", F.col("hierarchy").cast("long"))


@query("q2_6_21b_chained_vessels", f"WITH RECURSIVE {CHAINED} SELECT case_id, class_name, CAST(part AS INTEGER) AS part, node_id, CAST(hierarchy AS BIGINT) AS hierarchy FROM conc")
def chained_vessels(spark, d):
    nodes, edges = anatomy(spark, d)
    return A.chained_vessels(cut_lineage(A.single_vessel(nodes, edges)), edges).withColumn("hierarchy", F.col("hierarchy").cast("long"))


BESIDE = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
#: Origins of classes (their nodes nearest to AA), the arch's type, and the edges around what is next to an origin.
ARCH = f"""{ANATOMY}, apex AS (SELECT case_id, max(z + radius) AS apex FROM anodes WHERE class_name = 'AA' GROUP BY 1), to_aa AS (SELECT a.case_id, a.class_name, a.node_id, a.z, a.radius, a.hierarchy, min({BESIDE}) AS gap FROM anodes a JOIN anodes b ON a.case_id = b.case_id AND b.class_name = 'AA' WHERE a.class_name <> 'AA' GROUP BY ALL),
org AS (SELECT * FROM to_aa WHERE gap < 100 QUALIFY row_number() OVER (PARTITION BY case_id, class_name ORDER BY gap, node_id) = 1),
arch AS (SELECT c.case_id, CASE WHEN apex > 0 AND abs(apex - b.z) / (2 * l.radius) >= 2 THEN 3 WHEN apex > 0 AND abs(apex - b.z) / (2 * l.radius) >= 1 THEN 2 ELSE 1 END AS arch_type FROM (SELECT DISTINCT case_id FROM anodes) c LEFT JOIN apex USING (case_id) LEFT JOIN org b ON b.case_id = c.case_id AND b.class_name = 'BT' LEFT JOIN org l ON l.case_id = c.case_id AND l.class_name = 'LCCA'),
two AS (SELECT case_id, src AS n, dst AS m, class_name, artificial FROM aedges UNION ALL SELECT case_id, dst, src, class_name, artificial FROM aedges),
contact AS (SELECT DISTINCT org.case_id, org.class_name AS a, f.class_name AS b FROM org JOIN two e ON e.case_id = org.case_id AND e.n = org.node_id JOIN two f ON f.case_id = e.case_id AND f.n = e.m AND NOT f.artificial)"""
PAIRS = [("LCCA", "BT"), ("RSA", "AA"), ("RVA", "RSA"), ("LVA", "LCCA")]


@query("q2_5_18_arch_type", f"WITH {ARCH} SELECT case_id, arch_type FROM arch")
def arch_type(spark, d):
    return S.arch_type(anatomy(spark, d)[0])


@query("q2_7_21_contact_flags", f"WITH {ARCH} SELECT c.case_id, p.a, p.b, EXISTS (SELECT 1 FROM contact k WHERE k.case_id = c.case_id AND k.a = p.a AND k.b = p.b) AS touches FROM (SELECT DISTINCT case_id FROM anodes) c, (VALUES {', '.join(map(str, PAIRS))}) AS p(a, b)")
def contact_flags(spark, d):
    nodes, edges = anatomy(spark, d)
    return G.contacts(nodes, edges, PAIRS)


@query("q2_11_9_anatomy_row", f"WITH {ARCH} SELECT case_id, arch_type, EXISTS (SELECT 1 FROM contact k WHERE k.case_id = arch.case_id AND k.a = 'LCCA' AND k.b = 'BT') AS bovine, EXISTS (SELECT 1 FROM contact k WHERE k.case_id = arch.case_id AND k.a = 'RSA' AND k.b = 'AA') AND coalesce(r.hierarchy < l.hierarchy, false) AS arsa FROM arch LEFT JOIN (SELECT case_id, hierarchy FROM org WHERE class_name = 'RSA') r USING (case_id) LEFT JOIN (SELECT case_id, hierarchy FROM org WHERE class_name = 'LSA') l USING (case_id)")
def anatomy_row(spark, d):
    return A.anatomy_row(*anatomy(spark, d))


@query("q2_11_10_all_pathways", f"{MATCH}, deduped AS (SELECT * FROM ptab QUALIFY row_number() OVER (PARTITION BY case_id, regexp_replace(cells, ' ?[0-9]+$', ''), last_type ORDER BY artificial, last_length DESC, leaf) = 1), pick AS (SELECT s.* FROM scored s JOIN deduped USING (case_id, leaf) QUALIFY row_number() OVER (PARTITION BY s.case_id, config ORDER BY score DESC, s.leaf) = 1), pathn AS (SELECT case_id, config, leaf AS node_id FROM pick UNION SELECT p.case_id, p.config, e.src FROM pathn p JOIN aedges e ON e.case_id = p.case_id AND e.dst = p.node_id), side AS (SELECT case_id, config, node_id, 0.0::DOUBLE AS away FROM pathn UNION SELECT g.case_id, g.config, e.dst, g.away + e.length FROM side g JOIN aedges e ON e.case_id = g.case_id AND e.src = g.node_id WHERE g.away + e.length <= 15), cnt AS (SELECT case_id, config, count(DISTINCT node_id) AS nodes, count(DISTINCT CASE WHEN away = 0 THEN node_id END) AS on_path FROM side GROUP BY ALL) SELECT case_id, config, leaf, round(score, 6) AS score, nodes, on_path FROM pick JOIN cnt USING (case_id, config)")
def all_pathways(spark, d):
    nodes, edges = anatomy(spark, d)
    best, sub = A.all_pathways(nodes, edges, nodes.filter("node_id = 0").select("case_id", "node_id"), A.pathway_configs(spark))
    n = sub.groupBy("case_id", "config").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("on_path").alias("on_path"))
    return best.join(n, ["case_id", "config"]).select("case_id", "config", "leaf", *r6("score"), "nodes", "on_path")


@query("q2_11_14_pathway_types", f"WITH {ANATOMY}, t AS (SELECT case_id, node_id % 5 AS config, class_name FROM anodes) SELECT case_id, config, string_agg(DISTINCT class_name, ' ' ORDER BY class_name) AS types, CAST(count(DISTINCT class_name) AS INTEGER) AS ones FROM t GROUP BY ALL")
def pathway_types(spark, d):
    n = anatomy(spark, d)[0].withColumn("config", F.col("node_id") % 5)
    return A.pathway_types(n, ["case_id", "config"]).select("case_id", "config", F.array_join("types", " ").alias("types"), F.aggregate("vector", F.lit(0), lambda a, b: a + b).alias("ones"))


def _features(ctes: str, rows: str) -> str:
    """The 22 features of other points (with the radius as curvature and y as polar, see q2_5_14_segment_features)."""
    return ORACLES["q2_5_14_segment_features"].replace(f"WITH {PTS}", f"WITH RECURSIVE {ctes}, points AS ({rows})")


def _own_locals(nodes):
    """Nodes with local features of their own, as the oracles have them."""
    return nodes.withColumns({"curvature": F.col("radius") / 4, "polar": F.col("y") / 10})


def _rounded(f):
    return f.select(*KEYS, *(F.round(c, 5 if c == "bending_length" else 6).alias(c) for c in FEATURES))


@query("q2_11_7_features_by_cell", _features(f"{ANATOMY}, {ALONG}", "SELECT walk.case_id, cell_id, CAST(walk.hierarchy AS INTEGER) AS point_idx, x, y, z, radius, 0 AS blanking FROM walk JOIN anodes a ON a.case_id = walk.case_id AND a.node_id = walk.node_id"))
def features_by_cell(spark, d):
    nodes, edges = anatomy(spark, d)
    return _rounded(A.features_by_cell(_own_locals(nodes), edges))


@query("q2_11_8_features_by_vessel", _features(CHAINED, "SELECT case_id, v.class_name AS cell_id, CAST(v.hierarchy AS INTEGER) AS point_idx, x, y, z, radius, 0 AS blanking FROM (SELECT case_id, class_name, node_id, hierarchy FROM one UNION ALL SELECT case_id, class_name, node_id, hierarchy FROM conc) v JOIN anodes USING (case_id, node_id) QUALIFY count(*) OVER (PARTITION BY case_id, v.class_name) >= 3"))
def features_by_vessel(spark, d):
    nodes, edges = anatomy(spark, d)
    return _rounded(A.features_by_vessel(_own_locals(nodes), edges))


STEP = "sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2))"


#: Neighbourhoods of both accesses in rows, nested gradients by windows and filling from upstream by recursion.
NEAR_GRAD = lambda c: f"CASE WHEN lag(ord) OVER g IS NULL THEN lead({c}) OVER g - {c} WHEN lead(ord) OVER g IS NULL THEN {c} - lag({c}) OVER g ELSE (lead({c}) OVER g - lag({c}) OVER g) / 2 END"
PER_NODE = ("mean_step", "curvature", "torsion", "module", "polar", "azimuth")
BOTH_ACCESSES = f"""WITH RECURSIVE {TREE}, {NODES},
te AS (SELECT DISTINCT case_id, src, dst, dst % 4 = 0 AS artificial FROM tree WHERE src <> dst), ta AS (SELECT * FROM te UNION ALL SELECT case_id, dst, src, artificial FROM te),
begin AS (SELECT case_id, 'femoral' AS access, min(src) AS node_id FROM te GROUP BY 1 UNION ALL SELECT case_id, 'radial', max(dst) FROM te GROUP BY 1),
lv AS (SELECT case_id, access, node_id, 0 AS level, CAST(NULL AS BIGINT) AS parent, CAST(0 AS DOUBLE) AS acc FROM begin
 UNION ALL SELECT l.case_id, access, t.dst, level + 1, l.node_id, acc + sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) FROM lv l JOIN ta t ON t.case_id = l.case_id AND t.src = l.node_id AND t.dst IS DISTINCT FROM l.parent JOIN nodes a ON a.case_id = l.case_id AND a.node_id = t.src JOIN nodes b ON b.case_id = l.case_id AND b.node_id = t.dst),
nb AS (SELECT l.case_id, l.access, l.node_id AS n, l.level AS ln, v.node_id AS v, v.level AS lvl, count(*) OVER (PARTITION BY l.case_id, l.access, l.node_id) AS deg FROM lv l JOIN ta t ON t.case_id = l.case_id AND t.src = l.node_id AND NOT artificial JOIN lv v ON v.case_id = l.case_id AND v.access = l.access AND v.node_id = t.dst),
nn AS (SELECT a.*, b.v AS w, b.lvl AS lw, b.deg AS dv, row_number() OVER (PARTITION BY a.case_id, a.access, a.n, a.lvl < a.ln ORDER BY a.v) AS place FROM (SELECT *, row_number() OVER (PARTITION BY case_id, access, n, lvl < ln ORDER BY v) AS side FROM nb) a LEFT JOIN nb b ON b.case_id = a.case_id AND b.access = a.access AND b.n = a.v AND b.v <> a.n),
hop AS (SELECT *, dense_rank() OVER (PARTITION BY case_id, access, n ORDER BY lvl >= ln, v) AS near FROM nn),
pick AS (SELECT *, row_number() OVER (PARTITION BY case_id, access, n ORDER BY CASE WHEN lvl < ln THEN lw > lvl ELSE false END, w) AS nth FROM hop WHERE near = 1 AND deg <> 2 AND (lvl < ln AND w IS NOT NULL OR lvl > ln AND lw > lvl)),
spots AS (SELECT DISTINCT case_id, access, n, deg, CASE WHEN lvl < ln THEN -2 * side + 1 ELSE 2 * side - 1 END AS ord, v AS at FROM hop WHERE deg = 2
 UNION ALL SELECT case_id, access, n, deg, CASE WHEN lvl < ln THEN -2 * side ELSE 2 * side END, w FROM hop WHERE deg = 2 AND (SELECT count(*) FROM nb b WHERE b.case_id = hop.case_id AND b.access = hop.access AND b.n = hop.v) = 2 AND (lvl < ln AND lw < lvl OR lvl > ln AND lw > lvl)
 UNION ALL SELECT DISTINCT case_id, access, n, deg, CASE WHEN deg = 1 AND lvl < ln THEN -1 ELSE 1 END, v FROM hop WHERE deg <> 2 AND near = 1
 UNION ALL SELECT case_id, access, n, deg, CASE WHEN deg = 1 AND lvl < ln THEN -2 ELSE 2 END, w FROM pick WHERE nth = 1
 UNION ALL SELECT DISTINCT case_id, access, n, deg, 0, n FROM nb),
pts AS (SELECT s.case_id, access, n, ord, x, y, z, count(*) OVER (PARTITION BY s.case_id, access, n) AS size, row_number() OVER (PARTITION BY s.case_id, access, n ORDER BY ord) - 1 AS i FROM spots s JOIN nodes p ON p.case_id = s.case_id AND p.node_id = s.at),
g1 AS (SELECT *, {NEAR_GRAD("x")} AS rx, {NEAR_GRAD("y")} AS ry, {NEAR_GRAD("z")} AS rz, sqrt(pow(x - lag(x) OVER g, 2) + pow(y - lag(y) OVER g, 2) + pow(z - lag(z) OVER g, 2)) AS step FROM pts WHERE size >= 3 WINDOW g AS (PARTITION BY case_id, access, n ORDER BY ord)),
g2 AS (SELECT *, nullif(sqrt(rx * rx + ry * ry + rz * rz), 0) AS speed, rx / speed AS tx, ry / speed AS ty, rz / speed AS tz FROM g1),
g3 AS (SELECT *, ({NEAR_GRAD("tx")}) / speed AS sx, ({NEAR_GRAD("ty")}) / speed AS sy, ({NEAR_GRAD("tz")}) / speed AS sz FROM g2 WINDOW g AS (PARTITION BY case_id, access, n ORDER BY ord)),
g4 AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS k, sx / nullif(k, 0) AS ux, sy / nullif(k, 0) AS uy, sz / nullif(k, 0) AS uz, ty * uz - tz * uy AS bx, tz * ux - tx * uz AS by_, tx * uy - ty * ux AS bz FROM g3),
g5 AS (SELECT *, -(({NEAR_GRAD("bx")}) * ux + ({NEAR_GRAD("by_")}) * uy + ({NEAR_GRAD("bz")}) * uz) / speed AS tor FROM g4 WINDOW g AS (PARTITION BY case_id, access, n ORDER BY ord)),
loc AS (SELECT case_id, access, n, avg(step) AS mean_step, max(k) FILTER (WHERE CASE WHEN size = 3 THEN i = 1 ELSE ord = 0 END) AS curvature, max(tor) FILTER (WHERE CASE WHEN size = 3 THEN i = 1 ELSE ord = 0 END) AS torsion, arg_max(x, ord) - arg_min(x, ord) AS dx, arg_max(y, ord) - arg_min(y, ord) AS dy, arg_max(z, ord) - arg_min(z, ord) AS dz FROM g5 GROUP BY ALL),
own AS (SELECT l.*, mean_step, curvature, torsion, sqrt(dx * dx + dy * dy + dz * dz) AS module, CASE WHEN abs(dz) < 1e-5 THEN CASE WHEN abs(dx) > 1e-5 OR abs(dy) > 1e-5 THEN 0 END ELSE sign(dz) * pi() / 2 - atan(sqrt(dx * dx + dy * dy) / dz) END AS polar, CASE WHEN abs(dx) >= 1e-5 OR abs(dy) >= 1e-5 THEN sign(dy) * acos(greatest(-1, least(1, dx / sqrt(dx * dx + dy * dy)))) END AS azimuth FROM lv l LEFT JOIN loc o ON o.case_id = l.case_id AND o.access = l.access AND o.n = l.node_id),
root AS (SELECT case_id, access, {", ".join(f"arg_min({c}, CAST(level AS BIGINT) * 1000000000 + node_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in PER_NODE)} FROM own GROUP BY ALL),
filled AS (SELECT o.case_id, o.access, o.node_id, level, acc, {", ".join(f"CAST(coalesce(o.{c}, r.{c}) AS DOUBLE) AS {c}" for c in PER_NODE)} FROM own o JOIN root r ON r.case_id = o.case_id AND r.access = o.access WHERE parent IS NULL
 UNION ALL SELECT o.case_id, o.access, o.node_id, o.level, o.acc, {", ".join(f"CAST(coalesce(o.{c}, f.{c}) AS DOUBLE)" for c in PER_NODE)} FROM filled f JOIN own o ON o.case_id = f.case_id AND o.access = f.access AND o.parent = f.node_id)
SELECT case_id, access, node_id, level, round(acc, 5) + 0.0 AS accumulated, {", ".join(f"round(coalesce({c}, 0), 5) + 0.0 AS {c}" for c in PER_NODE)} FROM filled"""


@query("q2_11_6b_local_graph_features", BOTH_ACCESSES)
def local_graph_features(spark, d):
    edges = tree(spark, d).filter("src <> dst").select("case_id", "src", "dst", (F.col("dst") % 4 == 0).alias("artificial")).distinct()
    ends = edges.groupBy("case_id").agg(F.min("src").alias("femoral"), F.max("dst").alias("radial"))
    starts = ends.unpivot("case_id", ["femoral", "radial"], "access", "node_id")
    rows = A.local_graph_features(tree_nodes(spark, d), edges, starts)
    return rows.select("case_id", "access", "node_id", "level", *((F.round(c, 5) + 0.0).alias(c) for c in ("accumulated", *PER_NODE)))


@query("q2_11_6_local_features", f"WITH {ARC}, vx AS (SELECT case_id, CAST(trunc(x) AS INTEGER) AS i, CAST(trunc(y) AS INTEGER) AS j, CAST(trunc(z) AS INTEGER) AS k, max(radius) AS value FROM points GROUP BY ALL) SELECT p.case_id, cell_id, point_idx, round(arc, 5) AS accumulated, round(value, 5) AS value FROM arcs p LEFT JOIN vx ON vx.case_id = p.case_id AND i = CAST(trunc(x) AS INTEGER) AND j = CAST(trunc(y) AS INTEGER) AND k = CAST(trunc(z) AS INTEGER)")
def local_features(spark, d):
    p = points(spark, d)
    vx = p.groupBy("case_id", *(F.col(n).cast("int").alias(i) for i, n in zip("ijk", "xyz", strict=True))).agg(F.max("radius").alias("value"))
    return A.local_features(p, vx).select(*KEYS, "point_idx", F.round("accumulated", 5).alias("accumulated"), F.round("value", 5).alias("value"))


def _lines(spark, d):
    """Anatomy chains as paths of points with classes: the chain of cells 0, 1, 3 of each tree."""
    nodes, _ = anatomy(spark, d)
    on = nodes.filter("node_id <= 16 or node_id between 25 and 32")
    place = F.when(F.col("node_id") >= 25, F.col("node_id") - 8).otherwise(F.col("node_id")).cast("int")
    return on.select("case_id", F.lit(0).cast("bigint").alias("cell_id"), place.alias("point_idx"), *"xyz", "radius", "class_name")


LINE = f"{ANATOMY}, ln AS (SELECT case_id, CAST(0 AS BIGINT) AS cell_id, CAST(CASE WHEN node_id >= 25 THEN node_id - 8 ELSE node_id END AS INTEGER) AS point_idx, x, y, z, radius, class_name FROM anodes WHERE node_id <= 16 OR node_id BETWEEN 25 AND 32)"
GLOBAL = ["tortuosity", "length", "mean_diameter", "std_diameter", "min_polar", "polar", "azimuth"]
HOT = "[" + ", ".join(f"max(CASE WHEN class_name = '{s}' THEN 1 ELSE 0 END)" for s in SLOTS) + "]"


@query("q2_7_27_global_row", f"WITH {LINE}, f AS ({_features(LINE, 'SELECT *, 0 AS blanking FROM ln')}), v AS (SELECT {C}, array_to_string({HOT}, ' ') AS vector FROM ln GROUP BY ALL) SELECT {C}, CAST(case_id % 2 AS INTEGER) AS side, {', '.join(GLOBAL)}, vector FROM f JOIN v USING ({C})")
def global_row(spark, d):
    g = A.global_row(_own_locals(_lines(spark, d)), (F.col("case_id") % 2).cast("int"))
    return g.select(*KEYS, "side", *r6(*GLOBAL), F.array_join("vector", " ").alias("vector"))


#: Local features that the vector's slots are compared with.
LOCAL = {"polar": "y / 10", "azimuth": "x / 50", "curvature": "radius / 4", "torsion": "z / 100", "blanking": "point_idx % 2", "value": "x * 2", "accumulated": "z * 3"}


@query("q2_7_28_node_vector", f"WITH {LINE}, v AS (SELECT {C}, point_idx, [x, y, z, 2 * radius, {', '.join(LOCAL.values())}, {', '.join(f'CASE WHEN class_name = {chr(39)}{s}{chr(39)} THEN 1 ELSE 0 END' for s in SLOTS)}]::DOUBLE[] AS v FROM ln) SELECT {C}, point_idx, CAST(slot - 1 AS INTEGER) AS slot, round(v[slot], 6) AS value FROM v, range(1, len(v) + 1) t(slot)")
def node_vector(spark, d):
    p = _lines(spark, d).withColumns({k: F.expr(v) for k, v in LOCAL.items()})
    return A.node_vector(p).select(*KEYS, "point_idx", F.posexplode("vector").alias("slot", "value")).select(*KEYS, "point_idx", "slot", *r6("value"))


@query("q2_11_11_access_rows", f"WITH {LINE} SELECT {C}, count(*) AS nodes, count(DISTINCT class_name) AS segments, count(DISTINCT class_name) - 1 AS edges FROM ln GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT class_name) > 1")
def access_rows(spark, d):
    rows, segments, edges, dense = A.access_rows(_lines(spark, d), F.lit(0))
    count = lambda df, name: df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name))
    return rows.select(*KEYS).join(count(dense, "nodes"), KEYS).join(count(segments, "segments"), KEYS).join(count(edges, "edges"), KEYS)


@query("q2_7_26b_segment_graph_features")
def segment_graph_features(spark, d):
    _, edges = A.segment_graph_features(A.local_features(_lines(spark, d).withColumn("blanking", F.lit(0))))
    return edges.select(*KEYS, "left", "right", *(F.round(c, 4).alias(c) for c in ("angle", "azimuth_difference", "polar_difference")))


@query("q2_11_1_path_features")
def path_features(spark, d):
    p = points(spark, d)
    box = p.select("case_id").distinct().select("case_id", *(F.lit(0.0).alias(f"corner_{n}") for n in "xyz"), F.lit(60.0).alias("size_x"), F.lit(20.0).alias("size_y"), F.lit(90.0).alias("size_z"))
    _, f = A.path_features(p, box, 5.0)
    return f.select(*KEYS, *(F.round(c, 4).alias(c) for c in f.columns if c not in KEYS))


@query("q2_11_2_path_geometry")
def path_geometry(spark, d):
    return A.path_geometry(events_line(spark, d), 20).select("case_id", "point_idx", *(F.round(c, 4).alias(c) for c in ("arc", "curvature", "smooth_curvature", "turn_sum")), "curve_id")


RINGS = f"""WITH {PTS}, o AS (SELECT o_custkey AS case_id, o_orderkey, CAST(row_number() OVER w - 1 AS INTEGER) AS point_idx, CAST(row_number() OVER w - 1 AS DOUBLE) AS x, o_totalprice / 1e5 AS y, o_orderkey % 13 / 5.0::DOUBLE AS z, 2.0::DOUBLE AS radius FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
g AS (SELECT *, {', '.join(f'{_grad(n)} AS g{n}' for n in 'xyz')} FROM o WINDOW w AS (PARTITION BY case_id ORDER BY point_idx)), t AS (SELECT * REPLACE (coalesce(nullif(gx, 0), 1) AS gx) FROM g),
b AS (SELECT *, sqrt(gx * gx + gy * gy) AS h, sqrt(gx * gx + gy * gy + gz * gz) AS l FROM t),
r AS (SELECT b.case_id, b.point_idx, p.point_idx AS idx, ((p.x - b.x) * gy - (p.y - b.y) * gx) / h AS u, (((p.x - b.x) * gx + (p.y - b.y) * gy) * gz / h - (p.z - b.z) * h) / l AS v FROM b JOIN points p ON p.cell_id = b.o_orderkey),
ar AS (SELECT case_id, point_idx, sqrt(abs(sum(u * v2 - u2 * v)) / 2 / pi()) AS ce FROM (SELECT *, coalesce(lead(u) OVER q, first_value(u) OVER q) AS u2, coalesce(lead(v) OVER q, first_value(v) OVER q) AS v2 FROM r WINDOW q AS (PARTITION BY case_id, point_idx ORDER BY idx)) GROUP BY ALL),
two AS (SELECT a.case_id, a.point_idx, (a.u + b.u) / 2 AS cu, (a.v + b.v) / 2 AS cv FROM r a JOIN r b ON a.case_id = b.case_id AND a.point_idx = b.point_idx AND a.idx <= b.idx),
three AS (SELECT a.case_id, a.point_idx, a.u, a.v, b.u - a.u AS bu, b.v - a.v AS bv, c.u - a.u AS du, c.v - a.v AS dv FROM r a JOIN r b ON a.case_id = b.case_id AND a.point_idx = b.point_idx AND a.idx < b.idx JOIN r c ON a.case_id = c.case_id AND a.point_idx = c.point_idx AND b.idx < c.idx),
cand AS (SELECT * FROM two UNION ALL SELECT case_id, point_idx, u + (dv * (bu * bu + bv * bv) - bv * (du * du + dv * dv)) / (2 * (bu * dv - bv * du)), v + (bu * (du * du + dv * dv) - du * (bu * bu + bv * bv)) / (2 * (bu * dv - bv * du)) FROM three WHERE bu * dv - bv * du <> 0),
far AS (SELECT cand.case_id, cand.point_idx, cu, cv, max(sqrt(pow(u - cu, 2) + pow(v - cv, 2))) AS cc FROM cand JOIN r ON r.case_id = cand.case_id AND r.point_idx = cand.point_idx GROUP BY ALL),
cc AS (SELECT case_id, point_idx, min(cc) AS cc FROM far GROUP BY ALL)
SELECT o.case_id, CAST(0 AS BIGINT) AS cell_id, o.point_idx, round(coalesce(ce, radius), 4) AS radius_ce, round(coalesce(cc, radius), 4) AS radius_cc, round(CASE WHEN coalesce(cc, radius) < 1e-9 THEN 1 ELSE radius / coalesce(cc, radius) END, 4) AS ovality FROM o LEFT JOIN ar USING (case_id, point_idx) LEFT JOIN cc USING (case_id, point_idx)"""


def _ringed(spark, d):
    """A customer's orders as a line, and the line items of each order as the ring around its point."""
    w = P.Window.partitionBy("o_custkey").orderBy("o_orderkey")
    at = F.row_number().over(w) - 1
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.lit(0).cast("bigint").alias("cell_id"), "o_orderkey", at.alias("point_idx"), at.cast("double").alias("x"), (F.col("o_totalprice") / 1e5).alias("y"), (F.col("o_orderkey") % 13 / 5.0).alias("z"), F.lit(2.0).alias("radius"))
    ring = points(spark, d).select(F.col("cell_id").alias("o_orderkey"), F.col("point_idx").alias("idx"), *"xyz").join(o.select(*KEYS, "point_idx", "o_orderkey"), "o_orderkey")
    return o.drop("o_orderkey"), ring.drop("o_orderkey")


@query("q2_11_2b_section_radii", RINGS)
def section_radii(spark, d):
    line, ring = _ringed(spark, d)
    lone = F.coalesce(F.nullif(F.col("tx"), F.lit(0.0)), F.lit(1.0))  # a line of one point looks along x
    r = A.section_radii(cut_lineage(P.tangents(line).withColumn("tx", lone)), ring)
    return r.select(*KEYS, "point_idx", *(F.round(c, 4).alias(c) for c in ("radius_ce", "radius_cc", "ovality")))


@query("q2_11_3_carotid_profile")
def carotid_profile(spark, d):
    e = events_line(spark, d).withColumn("radius", 2 + F.col("y") / 10)
    marks = e.filter("point_idx = 5 and case_id % 2 = 0").select("case_id", *"xyz")
    return A.carotid_profile(e, marks, part="click", width=1e6).select("case_id", "point_idx", "inside", "bulb", *(F.round(c, 3).alias(c) for c in ("fit",)))


GAUSS5 = ", ".join(f"({i - len(GAUSS) // 2}, {w / sum(GAUSS)!r}::DOUBLE)" for i, w in enumerate(GAUSS))
SKULL = f"""WITH {LINE}, {NODES}, away AS (SELECT l.case_id, point_idx, least(50.0, min(sqrt(pow(l.x - m.x, 2) + pow(l.y - m.y, 2) + pow(l.z - m.z, 2)))) AS distance FROM ln l JOIN nodes m ON m.case_id = l.case_id AND m.node_id % 9 = 0 GROUP BY ALL), ns AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id ORDER BY point_idx) - 1 AS i FROM away), k(o, w) AS (VALUES {GAUSS5}),
h AS (SELECT case_id, point_idx, w, CASE WHEN (i + o + 2 * n) % (2 * n) < n THEN (i + o + 2 * n) % (2 * n) ELSE 2 * n - 1 - (i + o + 2 * n) % (2 * n) END AS pos FROM ns CROSS JOIN k), sm AS (SELECT h.case_id, h.point_idx, sum(w * distance) AS smooth FROM h JOIN ns ON ns.case_id = h.case_id AND ns.i = pos GROUP BY ALL),
d1 AS (SELECT *, {_grad('smooth')} AS d FROM sm WINDOW w AS (PARTITION BY case_id ORDER BY point_idx)), d2 AS (SELECT *, {_grad('d')} AS dd, lead(d) OVER w AS nx FROM d1 WINDOW w AS (PARTITION BY case_id ORDER BY point_idx)), c AS (SELECT *, min(smooth) OVER (PARTITION BY case_id) AS low FROM d2 WHERE d <= 0 AND nx > 0 AND dd > 0 AND smooth < 20), mn AS (SELECT case_id, min(point_idx) AS cutoff FROM c WHERE smooth <= low + 5 GROUP BY 1)
SELECT sm.case_id, CAST(0 AS BIGINT) AS cell_id, sm.point_idx, round(distance, 5) AS distance, round(smooth, 5) AS smooth, CASE WHEN sm.point_idx > cutoff THEN 1 ELSE 0 END AS after FROM sm JOIN away USING (case_id, point_idx) LEFT JOIN mn USING (case_id)"""


@query("q2_11_5_skull_transition", SKULL)
def skull_transition(spark, d):
    p = _lines(spark, d)
    mask = tree_nodes(spark, d).filter("node_id % 9 = 0").select("case_id", *"xyz")
    return A.skull_transition(p, mask).select(*KEYS, "point_idx", *(F.round(c, 5).alias(c) for c in ("distance", "smooth")), "after")


@query("q2_11_5b_transition_points", SKULL[:SKULL.rindex("SELECT sm.case_id")] + "SELECT l.case_id, CAST(0 AS BIGINT) AS cell_id, l.point_idx, l.x, l.y, l.z, CAST(round_even((l.x - 1) / 0.5, 0) AS INTEGER) AS i, CAST(round_even((l.y - 2) / -0.5, 0) AS INTEGER) AS j, CAST(round_even((l.z - 3) / 0.7::DOUBLE, 0) AS INTEGER) AS k FROM ln l JOIN mn ON mn.case_id = l.case_id AND mn.cutoff = l.point_idx")
def transition_points(spark, d):
    p = _lines(spark, d)
    mask = tree_nodes(spark, d).filter("node_id % 9 = 0").select("case_id", *"xyz")
    affine = F.array(*map(F.lit, (0.5, 0.0, 0.0, 1.0, 0.0, -0.5, 0.0, 2.0, 0.0, 0.0, 0.7, 3.0, 0.0, 0.0, 0.0, 1.0)))
    images = p.select("case_id").distinct().withColumn("affine", affine)
    return A.transition_points(A.skull_transition(p, mask), images).select(*KEYS, "point_idx", *"xyz", *"ijk")


@query("q2_11_4_bulb_landmark", "WITH t AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'LCA' ELSE 'RCA' END AS vessel, o_custkey % 7 AS m FROM orders) SELECT case_id, vessel, CAST(CASE WHEN m > 1 THEN m ELSE case_id END AS DOUBLE) AS x, CASE WHEN m > 1 THEN 'landmark' ELSE 'transition' END AS how FROM t")
def bulb_landmark(spark, d):
    k, m = F.col("o_orderkey"), (F.col("o_custkey") % 7).cast("double")
    o = table(spark, d, "orders").select(k.alias("case_id"), F.when(k % 2 == 0, "LCA").otherwise("RCA").alias("vessel"), F.when(k % 2 == 0, "l-bulb").otherwise("r-bulb").alias("label"), m.alias("m"))
    turns = o.select("case_id", "vessel", F.col("case_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    marks = o.filter("m <> 1").select("case_id", "label", F.col("m").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return Q.bulb_landmark(turns, marks, {"LCA": "l-bulb", "RCA": "r-bulb"}).select("case_id", "vessel", "x", "how")


CORNER = "img AS (SELECT s_suppkey AS case_id, s_suppkey % 3 AS o, 0.3 + (s_suppkey % 5) / 10.0::DOUBLE AS s, s_acctbal / 100 AS t, 100 + s_suppkey % 400 AS size_y FROM supplier)"


@query("q2_11_15_reference_corner", f"WITH {CORNER}, c AS (SELECT *, CASE WHEN o = 0 THEN 150 ELSE 350 END * 0.43::DOUBLE / s AS i, CASE WHEN o = 2 THEN size_y ELSE 0 END AS j FROM img) SELECT case_id, round(CASE WHEN o = 0 THEN s ELSE -s END * i + t, 6) AS x, round(CASE WHEN o = 2 THEN -s ELSE s END * j + 2 * t, 6) AS y, round(3 * t, 6) AS z FROM c")
def reference_corner(spark, d):
    k, t = F.col("s_suppkey"), F.col("s_acctbal") / 100
    s, zero = F.lit(0.3) + (k % 5) / 10.0, F.lit(0.0)
    across, along = F.when(k % 3 == 0, s).otherwise(-s), F.when(k % 3 == 2, -s).otherwise(s)
    affine = F.array(across, zero, zero, t, zero, along, zero, 2 * t, zero, zero, s, 3 * t, zero, zero, zero, F.lit(1.0))
    return Q.reference_corner(table(spark, d, "supplier").select(k.alias("case_id"), affine.alias("affine"), (100 + k % 400).alias("size_y"))).select("case_id", *r6(*"xyz"))


@query("q2_10_1_incremental_cases", "SELECT o_custkey AS case_id, o_orderkey AS settings, round(o_totalprice * 2, 2) AS v FROM orders")
def incremental_cases(spark, d):
    base = _folder(spark)
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("settings"), F.col("o_totalprice").alias("v"))
    for part in (o.filter("settings % 2 = 0"), o):  # the second intake brings the first one's cases again
        part.write.mode("append").parquet(f"{base}/in")
        run_incremental(spark, f"{base}/in", "case_id long, settings long, v double", f"{base}/out", f"{base}/checkpoint", lambda df: df.withColumn("v", F.round(F.col("v") * 2, 2)), ["case_id", "settings"])
    return spark.read.parquet(f"{base}/out").select("case_id", "settings", "v")


@query("q2_4_21b_resample_cubic")
def resample_cubic(spark, d):
    return P.resample_cubic(points(spark, d), 5.0).select(*KEYS, "point_idx", *(F.round(c, 4).alias(c) for c in ("x", "y", "z", "radius")))


POSITION = ["first_r", "first_a", "first_s", "last_r", "last_a", "last_s", "mean_r", "mean_a", "mean_s"]


@query("q2_3_16b_root_centred_cells", f"WITH {PTS}, g AS (SELECT {C}, avg(radius) AS mean_radius, {', '.join(f'arg_min({v}, point_idx) AS first_{n}, arg_max({v}, point_idx) AS last_{n}, avg({v}) AS mean_{n}' for v, n in zip('xyz', 'ras'))} FROM points GROUP BY ALL), r AS (SELECT case_id, arg_max(first_r, (mean_radius, -cell_id)) AS o_r, arg_max(first_a, (mean_radius, -cell_id)) AS o_a, arg_max(first_s, (mean_radius, -cell_id)) AS o_s FROM g GROUP BY 1) SELECT g.case_id, cell_id, {', '.join(f'floor(({c} - o_{c[-1]}) * 1e4 + 0.50031) / 1e6 AS {c}' for c in POSITION)} FROM g JOIN r USING (case_id)")
def root_centred_cells(spark, d):
    f = S.cell_features(points(spark, d))
    root = f.groupBy("case_id").agg(F.max_by(F.struct("first_r", "first_a", "first_s"), F.struct("mean_radius", -F.col("cell_id"))).alias("o")).select("case_id", *(F.col(f"o.first_{n}").alias(f"root_{n}") for n in "ras"))
    return S.root_centred(f, root).select(*KEYS, *((F.floor(F.col(c) * 1e6 + 0.50031) / 1e6).alias(c) for c in POSITION))


@query("q2_3_15b_centre_and_vector_norm", "WITH s AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), v AS (SELECT user_id, sqrt(sum(value * value)) AS len FROM events GROUP BY 1) SELECT event_id AS case_id, round(value - m, 6) AS centred, round(value / nullif(len, 0), 6) AS unit FROM events e JOIN s USING (event_type) JOIN v USING (user_id)")
def centre_and_vector_norm(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("case_id"), F.col("event_type").alias("feature"), "value", "user_id")
    stats = e.groupBy("feature").agg(F.avg("value").alias("mean"), F.lit(None).cast("double").alias("std"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"), F.lit("center").alias("rule"))
    return Q.vector_norm(Q.normalize(e, stats), ["user_id"], "value", "unit").select("case_id", F.round("normal", 6).alias("centred"), *r6("unit"))


@query("q2_7_22b_attached_nodes", f"{BRIDGES} SELECT case_id, node_id FROM lab WHERE (case_id, component) IN (SELECT * FROM in3)")
def attached_nodes(spark, d):
    nodes, edges = tree_nodes(spark, d), tree(spark, d).filter("src >= 6")
    main = F.col("node_id") == 6
    bridges = G.join_components(nodes, edges, {"Brand#11": "Brand#22"}, main)
    return G.attached_nodes(nodes, edges, bridges, main)[0].select("case_id", "node_id")
