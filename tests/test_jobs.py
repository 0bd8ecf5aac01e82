"""Cleaning, pathways, vessels and composed jobs on small hand-made inputs; every oracle is valid SQL."""

from __future__ import annotations

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tubula.functions.geom import CLASSES
from tubula.operators import cleaning, graph, polyline, quality, segments, vessels
from tubula.plans import load
from tubula.sources import cohort

P = "case_id long, cell_id long, point_idx int, x double, y double, z double, radius double, blanking int, class_name string"
N = "case_id long, node_id long, class_name string, x double, y double, z double, radius double, hierarchy int"
E = "case_id long, src long, dst long, cell_id long, class_name string, length double, artificial boolean"
DIR = "/root/testdata/sf0.001"


def line(spark, pts, cell=0, radii=None, names=None):
    return spark.createDataFrame([(0, cell, i, *map(float, p), float((radii or [1] * len(pts))[i]), 0, (names or ["AA"] * len(pts))[i]) for i, p in enumerate(pts)], P)


def test_every_oracle_runs():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    queries, oracles = load()
    assert set(oracles) <= set(queries)
    for name, sql in oracles.items():
        try:
            con.execute(f"EXPLAIN {sql}")
        except duckdb.Error as e:
            raise AssertionError(name) from e


NEW = ["q2_11_6b_local_graph_features", "q2_7_22_join_components", "q2_6_18_slab_match", "q2_11_5b_transition_points", "q2_2_4_start_filter", "q2_7_1_cell_graph", "q2_7_17_pathway_subgraph", "q2_7_19b_vessel_choice", "q2_11_8_features_by_vessel", "q2_7_28_node_vector", "q2_11_15_reference_corner", "q2_11_9_anatomy_row", "q2_11_11_access_rows", "q2_5_14_segment_features", "q2_10_1_incremental_cases", "q2_4_21_resample_linear"]


@pytest.mark.parametrize("name", NEW)
def test_queries_agree_with_their_oracle(spark, name):
    con = duckdb.connect()
    for t in "orders lineitem part customer supplier".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    queries, oracles = load()
    df = queries[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.execute(oracles[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got, want = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key), sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert got == want


def test_cleaning(spark):
    p = line(spark, [(0, 0, 0), (0, 0, 0.00001), (1, 0, 0)]).unionByName(line(spark, [(5, 5, 5), (6, 6, 6), (5, 5, 5)], 1)).unionByName(line(spark, [(5, 0, 0), (5, 1, 0)], 2)).unionByName(line(spark, [(0, 0, 0)], 3))
    assert [r["point_idx"] for r in cleaning.drop_close_points(p.filter("cell_id = 0")).orderBy("point_idx").collect()] == [0, 2]
    # cell 2 returns to the same x, not to the same place; cell 1 is closed; cell 3 has one point
    assert {r["cell_id"] for r in cleaning.drop_degenerate_cells(p).collect()} == {0, 2}
    assert {r["cell_id"] for r in cleaning.filter_from_start(p).collect()} == {0, 3}
    assert {r["cell_id"] for r in cleaning.clean_cells(p, (0.0, 0.0, 0.0), 6.0).collect()} == {0}
    high = line(spark, [(0, 0, 0), (0, 0, 100)], 0, [5, 5]).unionByName(line(spark, [(0, 0, 99), (0, 0, 98)], 1, [1, 1])).unionByName(line(spark, [(0, 0, 99), (0, 0, 98)], 2, [3, 3]))
    assert {r["cell_id"] for r in cleaning.remove_high_thin(high).collect()} == {0, 2}


def test_landmarks_of_both_forms(spark):
    flat, marked = json.dumps({"a": [1, 2, 3]}), json.dumps({"markups": [{"coordinateSystem": "LPS", "controlPoints": [{"label": "b", "position": [1, 2, 3]}]}]})
    rows = cohort.parse_landmarks(spark.createDataFrame([(1, flat), (2, marked), (3, "nothing")], "case_id long, json string")).orderBy("case_id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 1, 2, 3), (2, "b", -1, -2, 3)]


def test_mirrored_points_take_all_coordinates(spark):
    schema = "case_id long, mid double, lx double, ly double, lz double, rx double, ry double, rz double, l_distance double, r_distance double"
    rows = [(1, 50.0, 40.0, 0.0, 0.0, 60.0, 9.0, 9.0, 99.0, 17.0), (2, 50.0, 40.0, 0.0, 0.0, 60.0, 1.0, 1.0, 99.0, 17.0), (3, 50.0, None, None, None, 60.0, 1.0, 2.0, None, 17.0)]
    got = {r["case_id"]: r for r in quality.mirror_fix(spark.createDataFrame(rows, schema), (16.1, 6.2), (17.1, 7.0)).collect()}
    assert (got[1]["lx"], got[1]["ly"], got[1]["lz"], got[1]["mirrored"]) == (40, 9, 9, True)  # x stays, the move is in space
    assert not got[2]["mirrored"] and (got[3]["lx"], got[3]["ly"], got[3]["lz"]) == (40, 1, 2)


def test_cubic_resampling_reproduces_cubics(spark):
    s = [0, 1, 2.5, 3, 4.5, 6, 7, 9]
    f = lambda t: 1 + 0.3 * t - 0.05 * t * t + 0.01 * t**3
    got = polyline.resample_cubic(line(spark, [(t, 0, 0) for t in s], radii=[f(t) for t in s]), 0.7).orderBy("point_idx").collect()
    assert len(got) == math.ceil(9 / 0.7) + 1
    assert all(r["x"] == pytest.approx(9 * i / 13) and r["radius"] == pytest.approx(f(r["x"])) for i, r in enumerate(got))
    ring = [(5 * math.cos(t / 10), 5 * math.sin(t / 10), 0) for t in range(40)]
    rows = polyline.resample_cubic(line(spark, ring), 0.2).collect()
    assert all(math.hypot(r["x"], r["y"]) == pytest.approx(5, abs=2e-3) for r in rows)
    # three points: a parabola; repeated points and short cells
    rows = polyline.resample_cubic(line(spark, [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 0, 0)], radii=[1, 2, 2, 1]), 0.5).orderBy("point_idx").collect()
    assert [(r["x"], r["radius"]) for r in rows] == [(0, 1), (0.5, 1.5), (1, 2), (1.5, 1.5), (2, 1)]
    assert polyline.resample_cubic(line(spark, [(0, 0, 0), (0.1, 0, 0)]), 1.0).count() == 2


def test_torsion_of_a_helix(spark):
    r, c = 4.0, 1.5
    pts = [(r * math.cos(t), r * math.sin(t), c * t) for t in (4 * math.pi * k / 399 for k in range(400))]
    whole = polyline.local_curvature(line(spark, pts), 200).filter("point_idx = 200").first()
    assert whole["local_curvature"] == pytest.approx(r / (r * r + c * c), abs=0.01) and whole["local_torsion"] == pytest.approx(c / (r * r + c * c), abs=0.01)


def chain(spark):
    """AA 0-1-2, BT 2-3-4-5, RCCA 5-6-7-8, LCCA 3-9-10-11, a detached piece 20-21."""
    names = {0: "AA", 1: "AA", 2: "AA", **dict.fromkeys((3, 4, 5), "BT"), **dict.fromkeys((6, 7, 8), "RCCA"), **dict.fromkeys((9, 10, 11), "LCCA"), 20: "other", 21: "other"}
    nodes = [(0, n, c, float(n), 0.0, float(n), 1.0, n) for n, c in names.items()]
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (3, 9), (9, 10), (10, 11), (20, 21)]
    cell = {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: 3, 10: 3, 11: 3, 21: 4}
    edges = [(0, a, b, cell[b], names[b], 1.0, b == 9) for a, b in pairs]
    return spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)


def test_vessels_and_chains(spark):
    nodes, edges = chain(spark)
    one = vessels.single_vessel(nodes, edges.filter("class_name <> 'other'"))
    got = {c: [r["node_id"] for r in one.filter(F.col("class_name") == c).orderBy("hierarchy").collect()] for c in ("AA", "BT", "RCCA", "LCCA")}
    assert got == {"AA": [0, 1, 2], "BT": [2, 3, 4, 5], "RCCA": [5, 6, 7, 8], "LCCA": [3, 9, 10, 11]}
    parts = spark.createDataFrame([(0, "RCCA", 5, 0), (0, "RCCA", 6, 1), (0, "RICA", 6, 0), (0, "RICA", 7, 1), (0, "BT", 4, 0), (0, "BT", 5, 1), (0, "LCCA", 30, 0), (0, "LCCA", 31, 1), (0, "LICA", 31, 0), (0, "LICA", 32, 1)], "case_id long, class_name string, node_id long, hierarchy int")
    chained = vessels.chained_vessels(parts, edges)
    rca = {c: [r["node_id"] for r in chained.filter(F.col("class_name") == c).orderBy("hierarchy").collect()] for c in ("RCA", "LCA", "BT-RCA", "BT-LCA")}
    assert rca == {"RCA": [5, 6, 7], "LCA": [30, 31, 32], "BT-RCA": [4, 5, 6, 7], "BT-LCA": []}  # BT doesn't touch LCCA
    f = {r["cell_id"]: r for r in vessels.features_by_vessel(nodes, edges).collect()}
    assert set(f) == {"AA", "BT", "RCCA", "LCCA"} and f["AA"]["length"] == pytest.approx(2 * math.sqrt(2)) and f["BT"]["tortuosity"] == pytest.approx(0, abs=1e-9)
    assert [r["place"] for r in vessels.chain_order(edges.filter("cell_id = 2")).orderBy("node_id").collect()] == [0, 1, 2, 3]


def test_pathways(spark):
    nodes, edges = chain(spark)
    start = spark.createDataFrame([(0, 0)], "case_id long, node_id long")
    table = {r["leaf"]: r for r in vessels.path_table(graph.root_to_leaf_paths(edges, start), edges).collect()}
    assert table[8]["cells"] == [0, 1, 2] and table[8]["types"] == ["AA", "BT", "RCCA"] and not table[8]["artificial"] and table[8]["last_length"] == 3
    assert table[11]["cells"] == [0, 1, 3] and table[11]["artificial"] and sum(table[11]["vector"]) == 3
    best, sub = vessels.all_pathways(nodes, edges, start, vessels.pathway_configs(spark), 1.0)
    by = {r["config"]: r["leaf"] for r in best.collect()}
    assert len(by) == 8 and by["femoral right anterior"] == 8
    own = {r["node_id"]: r["on_path"] for r in sub.filter("config = 'femoral right anterior'").collect()}
    assert own == {**dict.fromkeys(range(9), True), 9: False}
    wanted = {r["config"]: r["wanted"] for r in vessels.pathway_configs(spark).collect()}["femoral right anterior"]
    assert [wanted[CLASSES.index(c)] for c in ("AA", "BT", "RCCA", "RICA", "RSA", "LCCA")] == [1, 1, 2, 2, -1, 0]


def test_levels_go_on_in_further_components(spark):
    nodes, edges = chain(spark)
    levels, leveled = graph.hierarchy(nodes, edges, spark.createDataFrame([(0, 0)], "case_id long, node_id long"))
    got = {r["node_id"]: r["level"] for r in levels.collect()}
    assert got[8] == 8 and got[11] == 6 and got[20] == 9 and got[21] == 10
    assert {(r["src"], r["dst"]): r["level"] for r in leveled.collect()}[(20, 21)] == 9


def test_bridges_join_components(spark):
    nodes, edges = chain(spark)
    main = F.col("class_name") == "AA"
    bridges = graph.join_components(nodes, edges, {"BT": "AA"}, main)
    assert [(r["src"], r["dst"]) for r in bridges.collect()] == [(20, 11)]
    kept, joined = graph.attached_nodes(nodes, edges, bridges, main)
    assert kept.count() == 14 and joined.filter("artificial").count() >= 1
    far = graph.join_components(nodes, edges, {}, main, 3.0)
    assert far.count() == 0 and graph.attached_nodes(nodes, edges, far, main)[0].count() == 12


def test_contraction_and_merged_cells(spark):
    p = line(spark, [(0, 0, 0), (1, 0, 0)]).unionByName(line(spark, [(2, 0, 0), (1.004, 0, 0)], 1)).unionByName(line(spark, [(2.004, 0, 0), (3, 0, 0)], 2)).unionByName(line(spark, [(3, 0, 0), (4, 1, 0)], 3)).unionByName(line(spark, [(3, 0, 0), (4, -1, 0)], 4))
    cells = graph.cell_graph(p)  # ends on both sides of any rounding border are one node
    got = {r["cell_id"]: (r["src"], r["dst"]) for r in cells.collect()}
    assert got[0][1] == got[1][1] and got[1][0] == got[2][0] and got[2][1] == got[3][0] == got[4][0]
    merged = {r["cell_id"]: r["merged"] for r in graph.merge_cells(cells).collect()}
    assert merged == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    whole = graph.merged_points(p, cells).filter("cell_id = 0").orderBy("point_idx").collect()
    assert [round(r["x"]) for r in whole] == [0, 1, 2, 3]
    nodes, edges = graph.contracted_graph(p)
    assert nodes.count() == 6 and edges.count() == 5 and sorted(r["node_id"] for r in nodes.collect()) == list(range(6))


def test_segment_features_equal_the_single_operators(spark):
    pts = [(math.cos(t / 5) * 9, math.sin(t / 5) * 9, t) for t in range(60)]
    p = line(spark, pts, radii=[1 + (k % 7) / 5 for k in range(60)]).withColumn("blanking", F.when(F.col("point_idx").between(0, 3), 1).otherwise(0)).withColumns({"curvature": F.col("radius") / 4, "polar": F.col("x") / 10})
    row = segments.segment_features(p).first()
    for part in (segments.tortuosity(p), segments.diameter_stats(p), segments.end_diameters(p), segments.bending_length(p), segments.curvature_sums(p), segments.polar_features(p), segments.segment_direction(p), segments.partial_features(p)):
        want = part.first().asDict()
        assert all(row[k] == pytest.approx(v) for k, v in want.items() if k in row), want


def test_carotid_profile_and_skull_transition(spark):
    radii = [2 + (1.5 if 20 <= k < 28 else 0) for k in range(60)]
    p = line(spark, [(k, 0, 0) for k in range(60)], radii=radii, names=["LCCA"] * 24 + ["LICA"] * 36)
    none = spark.createDataFrame([], "case_id long, x double, y double, z double")
    rows = {r["point_idx"]: r for r in vessels.carotid_profile(p, none).collect()}
    assert rows[0]["centre"] == 24 and {k for k, r in rows.items() if r["bulb"]} == set(range(20, 29)) and rows[24]["fit"] == pytest.approx(2)
    mark = spark.createDataFrame([(0, 30.2, 0.0, 0.0)], "case_id long, x double, y double, z double")
    assert vessels.carotid_profile(p, mark).first()["centre"] == 30
    mask = spark.createDataFrame([(0, 40.0, 5.0, 0.0)], "case_id long, x double, y double, z double")
    after = [r["point_idx"] for r in vessels.skull_transition(p, mask).filter("after = 1").orderBy("point_idx").collect()]
    assert after and after[-1] == 59 and abs(after[0] - 40) <= 3
    both = vessels.carotid_profile(p, none, skull=mask)
    assert {"bulb", "smooth", "after"} <= set(both.columns) and sorted(r["point_idx"] for r in both.filter("after = 1").collect()) == after


def test_access_rows(spark):
    pts = [(k, k % 3, 2 * k) for k in range(12)]
    p = line(spark, pts, names=["AA"] * 4 + ["BT"] * 4 + ["RCCA"] * 4).unionByName(line(spark, pts[:5], 1)).unionByName(line(spark, pts, 2))
    rows, seg, edges, dense = vessels.access_rows(p, F.lit(1))
    r = rows.collect()
    assert [x["cell_id"] for x in r] == [0] and r[0]["side"] == 1 and sum(r[0]["vector"]) == 3  # too short, and of one class
    assert [x["class_name"] for x in seg.orderBy("place").collect()] == ["AA", "BT", "RCCA"] and "min_diameter" not in seg.columns
    assert {(x["left"], x["right"]) for x in edges.collect()} == {("AA", "BT"), ("BT", "RCCA")} and dense.count() == 12 and len(dense.first()["vector"]) == 25


def test_medians_are_exact(spark):
    import random
    import statistics

    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 1)) for _ in range(5001)] + [("b", float(rng.randrange(3))) for _ in range(2000)] + [("c", 7.0)] * 9 + [("d", float(k)) for k in range(10)] + [("e", None), ("f", 1.0), ("f", 2.0)]
    got = {r["feature"]: r for r in quality.medians(spark.createDataFrame(rows, "feature string, value double")).collect()}
    for k in "abcdf":
        own = [v for f, v in rows if f == k]
        assert got[k]["median"] == statistics.median(own) and got[k]["n"] == len(own) and got[k]["varied"] == (len(set(own)) > 2)
    assert "e" not in got


def test_points_move_to_components(spark):
    from tubula.operators import voxels

    mask = spark.createDataFrame([(0, 5, 5, 5), (0, 6, 5, 5), (0, 20, 5, 5)], "case_id long, i int, j int, k int")
    points = spark.createDataFrame([(0, "a", 3, 5, 5), (0, "b", 14, 5, 5), (0, "c", 200, 0, 0), (1, "a", 3, 5, 5)], "case_id long, label string, i int, j int, k int")
    got = {(r["case_id"], r["label"]): (r["i"], r["j"], r["k"], r["moved"]) for r in voxels.relocate_to_component(points, mask).collect()}
    assert got == {(0, "a"): (5.5, 5, 5, True), (0, "b"): (20, 5, 5, True), (0, "c"): (200, 0, 0, False), (1, "a"): (3, 5, 5, False)}


def test_entries_of_the_lowest_slice(spark):
    from tubula.operators import voxels

    rows = [(c, i, 0, 0) for c in (0, 1) for i in range(3)] + [(0, 50, 50, 0), (0, 9, 9, 4), (0, 20, 0, 0), (0, 21, 0, 0)]
    ends = spark.createDataFrame([(0, 7, 3.0, 0.0, 1.0), (0, 8, 16.0, 0.0, 1.0), (0, 5, 150.0, 0.0, 0.0), (1, 9, 99.0, 0.0, 0.0)], "case_id long, end_id long, x double, y double, z double")
    affine = [0.43, 0, 0, 0, 0, 0.43, 0, 0, 0, 0, 0.4, 0, 0, 0, 0, 1]
    images = spark.createDataFrame([(c, [float(v) for v in affine], 60) for c in (0, 1)], "case_id long, affine array<double>, size_y int")
    got = {(r["case_id"], r["place"]): (r["end_id"], round(r["x"], 3)) for r in voxels.entry_points(spark.createDataFrame(rows, "case_id long, i int, j int, k int"), ends, images, 2, 12.0).collect()}
    # end 7 is the nearest of both entries of case 0, and 8 goes; 7 is nearer to the corner (64.5 along x) than 5, and starts
    assert {k[1]: v for k, v in got.items() if k[0] == 0} == {0: (7, 3.0), 1: (5, 150.0)}
    assert {v for k, v in got.items() if k[0] == 1} == {(9, 99.0), (None, 0.43)}  # a missing end is added
    assert got[1, 0] == (9, 99.0)  # 34.5 from the corner, the other 64

    lps = spark.createDataFrame([(0, [-0.43, 0.0, 0.0, 0.0, 0.0, -0.43, 0.0, 0.0, 0.0, 0.0, 0.4, 0.0, 0.0, 0.0, 0.0, 1.0], 60)], images.schema)
    two = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, -150.0, -25.0, 0.0)], ends.schema)
    none = spark.createDataFrame([], "case_id long, i int, j int, k int")
    assert [r["end_id"] for r in voxels.entry_points(none, two, lps).orderBy("place").collect()] == [2, 1]  # the start changes places with the first


def test_section_radii(spark):
    p = polyline.tangents(line(spark, [(0, 0, k) for k in range(4)], radii=[2, 2, 2, 3]))
    square = [(0, 0, 1, i, x, y, 1.0) for i, (x, y) in enumerate([(2.0, 2.0), (-2.0, 2.0), (-2.0, -2.0), (2.0, -2.0)])]
    tilted = [(0, 0, 2, i, x, y, 2.0 + x) for i, (x, y) in enumerate([(3.0, 0.0), (0.0, 1.0), (-3.0, 0.0), (0.0, -1.0)])]
    rings = spark.createDataFrame([*square, *tilted, (0, 0, 0, 0, 0.0, 0.0, 0.0)], "case_id long, cell_id long, point_idx int, idx int, x double, y double, z double")
    got = {r["point_idx"]: (r["radius_ce"], r["radius_cc"], r["ovality"]) for r in vessels.section_radii(p, rings).collect()}
    assert got[1] == pytest.approx((4 / math.sqrt(math.pi), math.sqrt(8), 2 / math.sqrt(8)))
    assert got[2] == pytest.approx((math.sqrt(6 / math.pi), 3, 2 / 3))  # seen across the line
    assert got[0] == (0, 0, 1) and got[3] == (3, 3, 1)  # a ring of one point; no ring
    assert {"radius_cc", "curve_id"} <= set(vessels.path_geometry(p.select(*line(spark, [(0, 0, 0)]).columns), 5, sections=rings).columns)


def test_bridges_equal_all_pairs(spark):
    import random

    rng = random.Random(8)
    nodes = [(c, 10 * k + i, rng.choice(["AA", "BT", "LSA", None]), x + i * 3.0, y, z, 1.0, 0) for c in (0, 1) for k in range(12) for x, y, z in [[rng.uniform(0, 110) for _ in range(3)]] for i in range(rng.randrange(1, 6))]
    edges = [(c, n, n + 1, 0, "AA", 1.0, False) for c, n, *_ in nodes if (c, n + 1) in {(r[0], r[1]) for r in nodes}]
    parent = {"BT": "AA", "LSA": "BT"}
    got = graph.join_components(spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E), parent, F.col("node_id") < 10, 45.0)
    want, joined = set(), {(c, 0) for c in (0, 1)}
    while True:
        best = {}
        for a in nodes:
            for b in nodes:
                if a[0] == b[0] and (a[0], a[1] // 10) not in joined and (b[0], b[1] // 10) in joined and (d := math.dist(a[3:6], b[3:6])) <= 45:
                    rank = 0 if a[2] and a[2] == b[2] else 1 if b[2] and parent.get(a[2]) == b[2] else 2
                    key = a[0], a[1] // 10
                    best[key] = min(best.get(key, (9,)), (rank, d, a[1], b[1]))
        if not best:
            break
        want |= {(k[0], m[2], m[3]) for k, m in best.items()}
        joined |= set(best)
    assert {(r["case_id"], r["src"], r["dst"]) for r in got.collect()} == want
    assert len(want) > 8


def test_medians_of_wide_brackets(spark):
    import random
    import statistics

    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randrange(3))) for _ in range(2000)] + [("c", 7.0)] * 500 + [("d", 10.0 ** rng.uniform(-200, 200)) for _ in range(2001)] + [("e", v) for v in (0.0, 1.0) for _ in range(300)]
    got = {r["feature"]: r["median"] for r in quality.medians(spark.createDataFrame(rows, "feature string, value double"), reach=0.2, most=20, steps=16).collect()}
    assert got == {k: statistics.median([v for f, v in rows if f == k]) for k in "abcde"}
