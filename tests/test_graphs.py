"""Graph, voxel, nearest-neighbour and cohort operators on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tubula.operators import graph as G
from tubula.operators import nearest as N
from tubula.operators import quality as Q
from tubula.operators import segments as S
from tubula.operators import vessels as A
from tubula.operators import voxels as V
from tubula.operators.components import star_components
from tubula.sources import cohort as C
from tubula.streaming.incremental import apply_per_case, run_incremental

E = "case_id long, src long, dst long"


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(c, rng.randrange(60), rng.randrange(60)) for c in (0, 1) for _ in range(45)]
    got = {(r["case_id"], r["node"]): r["component"] for r in star_components(spark.createDataFrame(edges, E), ["case_id"]).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for c, a, b in edges:
        p, q = find((c, a)), find((c, b))
        root[max(p, q)] = min(p, q)
    assert got == {(c, n): find((c, n))[1] for c, n in {(c, v) for c, a, b in edges if a != b for v in (a, b)}}


def test_components_of_nothing_and_of_a_long_path(spark):
    assert star_components(spark.createDataFrame([], E), ["case_id"]).count() == 0
    path = spark.createDataFrame([(0, k, k + 1) for k in range(200)], E)
    assert {r["component"] for r in star_components(path, ["case_id"]).collect()} == {0}


def test_levels_of_a_fork(spark):
    e = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 1, 3), (0, 3, 4)], E)
    start = spark.createDataFrame([(0, 0)], "case_id long, node_id long")
    assert {r["node_id"]: r["level"] for r in G.bfs_levels(e, start).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3}
    assert {(r["leaf"], tuple(r["path"])) for r in G.root_to_leaf_paths(e, start).collect()} == {(2, (0, 1, 2)), (4, (0, 1, 3, 4))}


def test_star_gives_a_triangle(spark):
    e = spark.createDataFrame([(0, 0, 1, 10), (0, 0, 2, 11), (0, 0, 3, 12)], E + ", edge_id long")
    assert {(r["a"], r["b"]) for r in G.line_graph(e).collect()} == {(10, 11), (10, 12), (11, 12)}


def test_voxel_components_and_dice(spark):
    v = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 1), (0, 5, 5, 5)], "case_id long, i int, j int, k int")
    assert V.voxel_components(v, 26).select("component").distinct().count() == 2
    assert V.voxel_components(v, 6).select("component").distinct().count() == 3
    assert V.dice(v, v).first()["dice"] == 1


def test_nearest_search_grows_until_it_finds(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (1, 1, 0.0, 0.0, 0.0)], "case_id long, a long, x double, y double, z double")
    b = spark.createDataFrame([(0, 7, 90.0, 0.0, 0.0), (0, 8, 0.0, 95.0, 0.0)], "case_id long, b long, x double, y double, z double")
    rows = N.nearest_in_set(a, b, "a", "b", 2.0).collect()
    assert [(r["case_id"], r["b"], r["distance"]) for r in rows] == [(0, 7, 90.0)]


def test_enclosing_circle(spark):
    import math

    pts = spark.createDataFrame([(0, 1 + 3 * math.cos(t), -2 + 3 * math.sin(t)) for t in range(50)], "g long, u double, v double")
    r = S.enclosing_circle(pts, ["g"], 60).first()
    assert abs(r["radius"] - 3) < 0.05 and abs(r["cu"] - 1) < 0.1


ARCH_NODES = "case_id long, node_id long, class_name string, x double, y double, z double, radius double, hierarchy int, blanking int"
ARCH_EDGES = "case_id long, src long, dst long, class_name string, artificial boolean"


def arches(spark, *variants):
    """For each variant a case: arch 0-1-2 with BT 3, LCCA 4, RSA 5 and LSA 6; apex 12 with its radius."""
    nodes, edges = [], []
    for case, v in enumerate(variants):
        first, lsa = v.get("rsa_first", False), v.get("lsa", True)
        nodes += [(case, 0, "AA", 0.0, 0.0, 0.0, 2.0, 0, 0), (case, 1, "AA", 0.0, 5.0, 8.0, 2.0, 1, 0), (case, 2, "AA", 0.0, 10.0, 10.0, 2.0, 2, 0), (case, 3, "BT", v.get("bt_x", 1.0), 5.0, v.get("bt_z", 6.0), 1.5, 2, 0), (case, 4, "LCCA", 1.0, 9.0, 10.0, 2.0, 3, v.get("blanked", 0)), (case, 5, "RSA", 1.0, 5.0, 8.5, 1.0, 1 if first else 5, 0)]
        edges += [(case, 0, 1, "AA", False), (case, 1, 2, "AA", False), (case, 1, 3, "BT", v.get("artificial", False)), (case, 3 if v.get("bovine") else 2, 4, "LCCA", False), (case, 1, 5, "AA" if first else "RSA", False)]
        if lsa:
            nodes.append((case, 6, "LSA", 0.0, 8.0, 8.0, 1.0, 5 if first else 1, 0))
            edges.append((case, 2, 6, "LSA", False))
    return spark.createDataFrame(nodes, ARCH_NODES), spark.createDataFrame(edges, ARCH_EDGES)


def test_arch_type(spark):
    # the apex, 12, less the origin of BT, in diameters of LCCA at its origin
    variants = [({"bt_z": z}, want) for z, want in ((11.0, 1), (6.0, 2), (2.0, 3), (8.0, 2), (4.0, 3))]
    variants += [({"bt_z": 2.0, "bt_x": 500.0}, 1), ({"bt_z": 2.0, "blanked": 1}, 1), ({"bt_z": 2.0}, 1)]
    nodes = arches(spark, *(v for v, _ in variants))[0].filter("not (case_id = 7 and node_id = 3)")
    assert [r["arch_type"] for r in S.arch_type(nodes).orderBy("case_id").collect()] == [want for _, want in variants]


def test_anatomy_of_origins(spark):
    variants = [{}, {"bovine": True}, {"bovine": True, "artificial": True}, {"rsa_first": True}, {"lsa": False}, {"rsa_first": True, "lsa": False}]
    rows = A.anatomy_row(*arches(spark, *variants)).orderBy("case_id").collect()
    assert [r["bovine"] for r in rows] == [False, True, False, False, False, False] and [r["arsa"] for r in rows] == [False, False, False, True, False, False]


def test_reference_corner(spark):
    def at(code, size=512.0, s=0.86):
        x, y = (1 if code[0] == "R" else -1) * s, (1 if code[1] == "A" else -1) * s
        rows = [(1, [x, 0.0, 0.0, 7.0, 0.0, y, 0.0, 8.0, 0.0, 0.0, 1.0, 9.0, 0.0, 0.0, 0.0, 1.0], size)]
        return tuple(Q.reference_corner(spark.createDataFrame(rows, "case_id long, affine array<double>, size_y double")).first())[1:]

    assert at("RAS") == pytest.approx((7 + 75 * 0.86, 8, 9)) and at("LAS") == pytest.approx((7 - 175 * 0.86, 8, 9)) and at("LPS") == pytest.approx((7 - 175 * 0.86, 8 - 512 * 0.86, 9))
    with pytest.raises(Exception, match="orientation"):
        at("RPS")


def test_components_and_chains_of_large_cases(spark):
    import random

    rng = random.Random(8)
    pairs = [("a", rng.randrange(k), k, float(rng.randint(1, 5))) for k in range(1, 70) if rng.random() > 0.2] + [("b", k, k + 1, 1.0) for k in range(20)] + [("b", 30, 31, 1.0)]
    edges = spark.createDataFrame(pairs, "case_id string, src long, dst long, length double")
    nodes = spark.createDataFrame([("a", k) for k in range(72)], "case_id string, node_id long")
    assert sorted(G.components(nodes, edges).collect()) == sorted(G.components(nodes, edges, 0).collect())
    names = ("case_id", "component", "node_id", "place", "n", "length")
    near, far = ([tuple(r) for r in sorted(A.longest_chains(edges, k).select(*names).collect())] for k in (None, 0))
    assert near == far and {(r[1], r[4], r[5]) for r in near if r[0] == "b"} == {(0, 21, 20.0), (30, 2, 1.0)}


def test_choice_among_candidates(spark):
    p = lambda x: (float(x), 0.0, 0.0)
    rows = [("BT", 0, 10, 30.0, 5.0, p(0), p(30)), ("RCCA", 1, 9, 80.0, 3.0, p(31), p(100)), ("RCCA", 2, 50, 200.0, 3.0, p(500), p(700)), ("RICA", 3, 4, 40.0, 2.0, p(101), p(140)), ("RICA", 4, 90, 90.0, 2.0, p(700), p(800))]
    rows += [("LCCA", 5, 60, 90.0, 2.0, p(-10), p(-90)), ("LCCA", 6, 30, 60.0, 4.0, p(-200), p(-260)), ("LCCA", 7, 99, 49.0, 9.0, p(-300), p(-340)), ("LICA", 8, 5, 30.0, 1.0, p(-261), p(-290)), ("LICA", 9, 6, 30.0, 1.0, p(-199), p(-170)), ("LICA", 10, 99, 99.0, 9.0, p(-95), p(-99)), ("LVA", 11, 2, 9.0, 1.0, p(0), p(9)), ("RVA", 12, 5, 9.0, 1.0, p(0), p(9)), ("RVA", 13, 5, 9.0, 1.0, p(0), p(9))]
    end = "struct<x: double, y: double, z: double>"
    cand = spark.createDataFrame([(0, *r) for r in rows], f"case_id long, name string, component long, n int, length double, radius double, a {end}, b {end}")
    got = {r["name"]: r["component"] for r in A.choose_candidates(cand).collect()}
    # the widest of the long LCCA; RCCA and RICA next to their neighbour; LICA as near at both: most nodes; too few nodes: none
    assert got == {"BT": 0, "RCCA": 1, "RICA": 3, "LCCA": 6, "LICA": 9, "RVA": 12}
    alone = {r["name"]: r["component"] for r in A.choose_candidates(cand.filter("name <> 'BT' and component not in (5, 6)")).collect()}
    assert alone == {"RCCA": 2, "RICA": 4, "LCCA": 7, "LICA": 8, "RVA": 12}


def test_mirrored_landmarks(spark):
    rows = [(0, 0.0, -20.0, 20.0, 17.0, 16.0), (1, 0.0, -90.0, 20.0, 99.0, 16.0), (2, 0.0, -90.0, 90.0, 99.0, 99.0), (3, 0.0, None, 20.0, None, 16.0)]
    got = {r["case_id"]: (r["lx"], r["mirrored"]) for r in Q.mirror_fix(spark.createDataFrame(rows, "case_id long, mid double, lx double, rx double, l_distance double, r_distance double"), (16.1, 7.0), (17.1, 6.2)).collect()}
    assert got == {0: (-20.0, False), 1: (-20.0, True), 2: (-90.0, False), 3: (-20.0, True)}


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Patient,Side,age\n12.0,Left,3\n1.05,dreta,4\n7,?,5\n")
    rows = C.read_cohort(spark, str(tmp_path / "c.csv"), ["case", "patient"], ["side"]).collect()
    assert [(r["case_id"], r["side"]) for r in rows] == [("12", "l"), ("1.05", "r"), ("7", None)]
    (tmp_path / "m.json").write_text('{"markups": [{"coordinateSystem": "LPS", "controlPoints": [{"label": "a", "position": [1, 2, 3]}]}]}')
    r = C.read_landmarks(spark, str(tmp_path / "m.json")).first()
    assert (r["label"], r["x"], r["y"], r["z"]) == ("a", -1.0, -2.0, 3.0)
    names = spark.createDataFrame([("a10",), ("a9",), ("b1",)], "n string").orderBy(C.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in names] == ["a9", "a10", "b1"]


def test_failed_cases_do_not_stop_the_others(spark):
    def f(part):
        if part["case_id"].iloc[0] == 1:
            raise ValueError("bad")
        return part[["case_id", "v"]]

    rows = apply_per_case(spark.createDataFrame([(0, 1.0), (1, 2.0)], "case_id long, v double"), f, "case_id long, v double").collect()
    assert {(r["case_id"], r["error"]) for r in rows} == {(0, None), (1, "error: bad")}


def test_incremental_intake_processes_each_case_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.createDataFrame([(0, 1.0), (1, 2.0)], "case_id long, v double").write.parquet(src)
    for _ in range(2):
        run_incremental(spark, src, "case_id long, v double", out, ck, lambda d: d.withColumn("w", F.col("v") * 2), ["case_id"])
    spark.createDataFrame([(1, 9.0), (2, 3.0)], "case_id long, v double").write.mode("append").parquet(src)
    run_incremental(spark, src, "case_id long, v double", out, ck, lambda d: d.withColumn("w", F.col("v") * 2), ["case_id"])
    assert sorted((r["case_id"], r["w"]) for r in spark.read.parquet(out).collect()) == [(0, 2.0), (1, 4.0), (2, 6.0)]


def test_intake_reads_only_the_buckets_of_its_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    take = lambda rows: (spark.createDataFrame(rows, "case_id long, v double").write.mode("append").parquet(src), run_incremental(spark, src, "case_id long, v double", out, ck, lambda d: d, ["case_id"], 8))
    take([(k, 1.0) for k in range(40)])
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(3).cast("long")), F.lit(8))).first()[0]
    spoilt = 0
    for file in (tmp_path / "out_keys").rglob("*.parquet"):
        if f"_bucket={bucket}/" not in str(file):
            file.write_bytes(b"not parquet")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            spoilt += 1
    take([(3, 2.0), (3, 3.0)])  # known, and no other bucket is opened
    assert spoilt > 0 and spark.read.parquet(out).filter("v > 1").count() == 0
