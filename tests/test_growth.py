"""Steps whose memory, disk or shuffle once grew faster than their input."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from tubula.functions import geom
from tubula.operators import graph as G
from tubula.operators import nearest as N
from tubula.operators import polyline as P
from tubula.operators import segments as S
from tubula.operators import vessels as A
from tubula.streaming.incremental import apply_per_case


def _file(df, path):
    """Only of files does Spark know a size."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def _chain(spark, path, n=12):
    edges = spark.createDataFrame([(1, i, i + 1, i // 3, "AA", 1.0 + i, i == 5) for i in range(n)], "case_id long, src long, dst long, cell_id long, class_name string, length double, artificial boolean")
    paths = spark.createDataFrame([(1, n, list(range(n + 1)))], "case_id long, leaf long, path array<long>")
    return _file(edges, path / "edges"), _file(paths, path / "paths")


def test_path_tables_broadcast_no_edges(spark, tmp_path):
    edges, paths = _chain(spark, tmp_path)
    for df in (A.path_table(paths, edges), G.path_cells(paths, edges)):
        assert "Broadcast" not in df._jdf.queryExecution().toString()
        assert df.first()["cells"] == [0, 1, 2, 3]


def test_side_branches_broadcast_no_nodes_or_edges(spark, tmp_path):
    edges, _ = _chain(spark, tmp_path)
    nodes = edges.select("case_id", F.col("dst").alias("node_id"))
    on = spark.createDataFrame([(1, 3), (1, 4)], "case_id long, node_id long")
    hints = []
    real = F.broadcast
    G.F.broadcast = lambda df: hints.append(df.columns) or real(df)
    try:
        got = {r["node_id"]: r["on_path"] for r in G.pathway_subgraph(nodes, edges, on, 11.0).collect()}
    finally:
        G.F.broadcast = real
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False, 6: False} and hints and all("away" in h for h in hints)


def test_points_on_a_voxel_bound_stay_on_their_side(spark):
    rows = [(z, oz, sx, sy) for z, oz in ((58.35, 0), (4.95, 1), (52.95, 1), (42.95, 3), (26.35, 4)) for sx in (0.4, -0.4) for sy in (0.5, -0.5)]
    df = spark.createDataFrame(rows, "z double, oz int, sx double, sy double")
    zero = F.lit(0.0)
    affine = F.array(F.col("sx"), zero, zero, zero, zero, F.col("sy"), zero, zero, zero, zero, F.lit(0.8), F.col("oz").cast("double"), zero, zero, zero, F.lit(1.0))
    k = geom.to_ijk((zero, zero, F.col("z") + 0.05), affine, "trunc")[2]
    for r in df.withColumn("k", k).collect():
        assert r["k"] == int((r["z"] + 0.05 - r["oz"]) / 0.8)


def test_contraction_compares_places_not_their_points(spark, monkeypatch):
    rng = random.Random(5)
    spots = [tuple(rng.choice((-1.0, -0.0, 0.0, 0.25, 1.0)) + rng.choice((0.0, 0.0, 0.01, 0.02)) for _ in range(3)) for _ in range(60)] + [(0.25, 0.25, 0.25)] * 50
    rows = [(k % 2, 3 * k, *p) for k, p in enumerate(spots)] + [(0, 901, None, 0.0, 0.0), (0, 902, None, 0.0, 0.0), (1, 903, float("nan"), 0.0, 0.0), (1, 905, float("nan"), 0.0, 0.0)]
    pairs, real = [], N.star_components
    monkeypatch.setattr(N, "star_components", lambda e, keys: pairs.append(e.count()) or real(e, keys))
    got = {(r["case_id"], r["end"]): r["node"] for r in N.contract(spark.createDataFrame(rows, "case_id long, end long, x double, y double, z double"), "end", 0.01 + 1e-12).collect()}
    close = lambda p, q: None not in p + q and sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5 <= 0.01 + 1e-12
    want, places = {}, {(c, tuple(abs(v) if v == 0 else v for v in p)) for c, _, *p in rows if None not in p and p[0] == p[0]}
    for case, end, *p in sorted(rows, key=lambda r: r[1]):
        todo = [] if (case, end) in want else [(end, p)]
        while todo:
            at, q = todo.pop()
            if (case, at) not in want:
                want[case, at] = end
                todo += [(e, o) for c, e, *o in rows if c == case and close(q, o)]
    assert got == want
    assert pairs == [sum(a < b and a[0] == b[0] and close(a[1], b[1]) for a in places for b in places)]


def test_linear_resampling_takes_one_exchange(spark, tmp_path):
    rows = [(1, c, i, float(i * i % 7), float(i), float(c), 1.0 + i) for c in range(3) for i in range(2 + 4 * c)] + [(2, 9, 0, 0.0, 0.0, 0.0, 1.0)]
    df = P.resample_linear(_file(spark.createDataFrame(rows, "case_id long, cell_id long, point_idx int, x double, y double, z double, radius double"), tmp_path / "points"), 1.5)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["cell_id"], r["point_idx"]): (r["x"], r["y"], r["z"], r["radius"]) for r in df.collect()}
    want = {(0, 0): (0.0, 0.0, 0.0, 1.0), (9, 0): (0.0, 0.0, 0.0, 1.0), (0, 1): (1.0, 1.0, 0.0, 2.0)}
    for c in (1, 2):
        own = [r[3:] for r in rows if r[1] == c]
        arc = list(itertools.accumulate((math.dist(a[:3], b[:3]) for a, b in itertools.pairwise(own)), initial=0.0))
        k = math.ceil(arc[-1] / 1.5)
        for i in range(k + 1):
            at = arc[-1] * i / k
            j = max(j for j in range(len(own) - 1) if arc[j] <= at)
            t = min(1.0, (at - arc[j]) / (arc[j + 1] - arc[j]))
            want[c, i] = tuple(a + t * (b - a) for a, b in zip(own[j], own[j + 1]))
    assert got.keys() == want.keys() and all(max(abs(a - b) for a, b in zip(got[k], want[k])) < 1e-12 for k in want)


def test_bridging_halves_cubes_and_broadcasts_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    # six components of each case in one space, on places that repeat, so that distances tie; a seventh lies too far off
    nodes = [(c, k, rng.choice(("A", "B", "C", None)), *(float(rng.randrange(24)) * 0.5 for _ in range(3))) for c in range(2) for k in range(180)]
    nodes += [(0, 190, "A", 99.0, 0.0, 0.0), (0, 191, "A", None, 0.0, 0.0)]
    edges = [(c, k, k + 6) for c in range(2) for k in range(174)]
    held, plans, real = [], [], G.cut_lineage
    monkeypatch.setattr(N, "MET_PAIRS", 40)

    def cut(df):
        plans.append(df._jdf.queryExecution().toString())
        out = real(df)
        if "a_n" in out.columns and "nearest" not in out.columns:
            held.append(out.count())
        return out

    monkeypatch.setattr(G, "cut_lineage", cut)
    monkeypatch.setattr(N, "cut_lineage", cut)
    frames = _file(spark.createDataFrame(nodes, "case_id long, node_id long, class_name string, x double, y double, z double"), tmp_path / "nodes"), _file(spark.createDataFrame(edges, "case_id long, src long, dst long"), tmp_path / "edges")
    got = {(r["case_id"], r["src"], r["dst"], round(r["distance"], 9)) for r in G.join_components(*frames, {"A": "B"}, F.col("node_id") == 0, 3.0).collect()}
    want = set()
    for case in range(2):
        inside = {n[1]: n for n in nodes if n[0] == case and n[1] < 180 and n[1] % 6 == 0}
        for part in range(1, 6):
            own = [n for n in nodes if n[0] == case and n[1] < 180 and n[1] % 6 == part]
            rank = lambda a, b: 0 if a == b and a is not None else 1 if (a, b) == ("A", "B") else 2
            best = min((rank(n[2], m[2]), math.dist(n[3:], m[3:]), n[1], m[1]) for n in own for m in inside.values() if math.dist(n[3:], m[3:]) <= 3.0)
            want.add((case, best[2], best[3], round(best[1], 9)))
    assert got == want
    assert not any("Broadcast" in p for p in plans)
    assert held and max(held) < 2 * 150 * 30 / 3


def test_origins_compare_few_of_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, 1000 * c + k, name, *(rng.randrange(60) * 0.25 for _ in range(3))) for c in range(2) for k, name in enumerate(["AA"] * 300 + ["BT"] * 300 + ["RSA"] * 40)]
    rows += [(0, 900, "LSA", 70.0, 0.0, 0.0), (0, 901, "LSA", None, 0.0, 0.0), (3, 5, "BT", 0.0, 0.0, 0.0)]
    held, real = [], N.cut_lineage if hasattr(N, "cut_lineage") else None
    monkeypatch.setattr(N, "MET_PAIRS", 2000, raising=False)
    monkeypatch.setattr(N, "cut_lineage", lambda df: held.append(real(df)) or held[-1], raising=False)
    frame = spark.createDataFrame(rows, "case_id long, node_id long, class_name string, x double, y double, z double")
    met = []
    close = N.closest_pairs
    monkeypatch.setattr(N, "closest_pairs", lambda a, b, radius: met.append(radius) or close(a, b, radius))
    got = {(r["case_id"], r["class_name"]): (r["node_id"], r["distance"]) for r in N.origins(frame, ["BT", "RSA", "LSA"], "AA").collect()}
    want = {}
    for case, name in ((0, "BT"), (0, "RSA"), (0, "LSA"), (1, "BT"), (1, "RSA")):
        near = min((math.dist(a[3:], b[3:]), a[1]) for a in rows for b in rows if a[0] == b[0] == case and a[2] == name and b[2] == "AA" and a[3] is not None)
        want[case, name] = (near[1], near[0])
    assert got == want and met == [16.0, 64.0]


def test_cases_are_dealt_to_all_tasks(spark):
    rows = [(c, v) for c in [*range(40), None] for v in (1, 2 if c is None or c % 3 else None, 3)]
    df = spark.createDataFrame(rows, "case_id long, v long").repartition(1)

    def total(part):
        if part["case_id"].iloc[0] == 7:
            raise ValueError("seven")
        return part.assign(n=len(part), kind=str(part["v"].dtype))[["case_id", "n", "kind"]].head(1)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        out = apply_per_case(df, total, "case_id long, n long, kind string")
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
        got = {(r["case_id"], r["n"], r["kind"], r["error"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(c, 3, "int64" if c is None or c % 3 else "float64", None) for c in [*range(40), None] if c != 7} | {(7, None, None, "error: seven")}


def test_curvature_takes_batches_of_rows(spark):
    rows = [(1, c, i, math.cos(i / 3), math.sin(i / 3), i * 0.2 * c) for c in range(3) for i in range(9)] + [(1, 5, i, 1.0, 2.0, 3.0) for i in range(4)] + [(1, 6, 0, 1.0, 2.0, 3.0)]
    df = P.local_curvature(spark.createDataFrame(rows, "case_id long, cell_id long, point_idx int, x double, y double, z double"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()

    def grad(v):
        return [v[min(i + 1, len(v) - 1)] - v[max(i - 1, 0)] if i in (0, len(v) - 1) else (v[i + 1] - v[i - 1]) / 2 for i in range(len(v))]

    for r in df.collect():
        own = [p[3:] for p in rows if p[1] == r["cell_id"]][max(r["point_idx"] - 2, 0) : r["point_idx"] + 3]
        at = 1 if r["point_idx"] == 0 else len(own) - 2 if r["point_idx"] == len([p for p in rows if p[1] == r["cell_id"]]) - 1 else min(r["point_idx"], 2)
        if r["cell_id"] > 4:
            assert r["local_curvature"] is None and r["local_torsion"] is None
            continue
        g = [grad([p[k] for p in own]) for k in range(3)]
        speed = [math.hypot(*(c[i] for c in g)) for i in range(len(own))]
        t = [[v / s for v, s in zip(c, speed)] for c in g]
        bend = [grad(c)[at] / speed[at] for c in t]
        assert abs(math.hypot(*bend) - r["local_curvature"]) < 1e-12


def test_partial_features_take_one_exchange(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, c, i, rng.uniform(0, 20), rng.uniform(0, 9), float(i % 2), rng.uniform(1, 4), int(rng.random() < 0.3)) for c in range(6) for i in range(1 + 2 * c)]
    points = _file(spark.createDataFrame(rows, "case_id long, cell_id long, point_idx int, x double, y double, z double, radius double, blanking int"), tmp_path / "points")
    df = S.partial_features(points)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r["cell_id"]: r for r in df.collect()}
    assert got.keys() == set(range(6))
    for name, length, start in (("first_50", 50, True), ("last_10", 10, False), ("last_20", 20, False), ("last_30", 30, False)):
        for r in S.tortuosity(S.partial_segment(points, length, start).drop("arc")).collect():
            one = got[r["cell_id"]][f"tortuosity_{name}"]
            assert (one is None and r["tortuosity"] is None) or abs(one - r["tortuosity"]) < 1e-12
    for n in (5, 10):
        for r in S.partial_segment(points, n, False).groupBy("cell_id").agg(S.unblanked(F.avg, 2 * F.col("radius")).alias("d")).collect():
            assert abs(got[r["cell_id"]][f"diameter_last_{n}"] - r["d"]) < 1e-12


def _cells(spark, seed=5, n=40):
    """Cells of 1 to 17 points, one of them long, some points repeated, some without a place or radius."""
    rng = random.Random(seed)
    rows = []
    for cell in range(n):
        for i in range(150 if cell == 7 else rng.randrange(1, 18)):
            at = rows[-1][3:6] if i and rng.random() < 0.1 else [rng.uniform(0, 9) for _ in range(3)]
            rows.append((cell % 3, cell, i, *(at if cell % 10 != 9 or i != 2 else (None, 1.0, 2.0)), None if cell % 10 == 8 and i == 1 else rng.uniform(1, 2)))
    return spark.createDataFrame(rows, "case_id long, cell_id long, point_idx int, x double, y double, z double, radius double")


def _small_batches(spark, make):
    """Rows of make(), once with batches that cut cells and once without."""
    got = []
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got.append(sorted(map(tuple, make().collect()), key=lambda r: r[:3]))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1]
    return got[1]


def test_splines_take_no_array_of_a_cell(spark):
    cells = _cells(spark)
    plan = P.resample_cubic(cells, 0.5)._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "collect_list" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange ") == 1
    rows = _small_batches(spark, lambda: P.resample_cubic(cells, 0.5))
    own = {}
    for r in rows:
        own.setdefault(r[1], []).append(r)
    given = {}
    for r in cells.orderBy("cell_id", "point_idx").collect():
        given.setdefault(r["cell_id"], []).append(r)
    assert own.keys() == given.keys()
    for cell, before in given.items():
        length = sum(math.dist(a[3:6], b[3:6]) for a, b in itertools.pairwise(before) if None not in (*a[3:6], *b[3:6]))
        after = own[cell]
        assert len(after) == (math.ceil(length / 0.5) + 1 if length > 0.5 else len(before))
        assert [r[2] for r in after] == list(range(len(after))) and after[0][3:] == tuple(before[0][3:]) and after[-1][3:] == tuple(before[-1][3:])


def test_frames_take_no_array_of_a_cell(spark):
    cells = P.tangents(_cells(spark)).withColumn("name", F.lit("AA"))
    plan = P.transported_frames(cells)._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "collect_list" not in plan and "Join" not in plan
    rows = _small_batches(spark, lambda: P.transported_frames(cells))
    assert len(rows) == cells.count() and all(r[10] == "AA" for r in rows)
    at = {r[:2]: [] for r in rows}
    for r in rows:
        at[r[:2]].append(r)
    dots = lambda a, b: sum(p * q for p, q in zip(a, b))
    mirror = lambda a, v: a if dots(v, v) < 1e-20 else [p - 2 * dots(v, a) / dots(v, v) * q for p, q in zip(a, v)]
    for cell in at.values():
        if any(c is None for r in cell for c in r[3:6]):
            continue
        for a, b in itertools.pairwise(cell):
            v = [q - p for p, q in zip(a[3:6], b[3:6])]
            want = a[11:14]
            if dots(v, v) >= 1e-20:
                want = mirror(mirror(a[11:14], v), [q - p for p, q in zip(mirror(a[7:10], v), b[7:10])])
                size = math.sqrt(dots(want, want))
                want = [c / size if size else c for c in want]
            assert all(abs(p - q) < 1e-9 for p, q in zip(want, b[11:14]))


def test_local_features_collect_no_points(spark):
    plan = A.local_features(_cells(spark))._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "min_by" not in plan


def test_circles_of_small_groups_take_no_jobs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, rng.uniform(-5, 5), rng.uniform(-5, 5)) for g in range(30) for _ in range(1 + g * g)] + [(50, 1.0, 2.0)] * 9 + [(51, float(i), 0.0) for i in range(9)] + [(52, None, 1.0), (None, 1.0, 1.0)]
    pts = spark.createDataFrame(rows, "g int, u double, v double")
    key = lambda df: {r["g"]: (r["cu"], r["cv"], r["radius"]) for r in df.collect()}
    large = key(S.enclosing_circle(pts, ["g"], most=0))
    mixed = key(S.enclosing_circle(pts, ["g"], most=100))
    monkeypatch.setattr(S, "_circles_by_rounds", None)  # small groups need no rounds of jobs
    small = _small_batches(spark, lambda: S.enclosing_circle(pts, ["g"]))
    small = {r[0]: r[1:] for r in small}
    assert small.keys() == large.keys() == mixed.keys() == {*range(30), 50, 51} and small[50] == (1.0, 2.0, 0.0) and small[51] == (4.0, 0.0, 4.0)
    for g, want in large.items():
        for got in (small[g], mixed[g]):
            assert all(abs(a - b) < 1e-5 for a, b in zip(got, want))


def test_few_neighbours_in_a_dense_cloud(spark, monkeypatch):
    rng = random.Random(9)
    at = [(0, rng.gauss(0, 0.5), rng.gauss(0, 0.5), rng.gauss(0, 0.5)) for _ in range(900)] + [(0, rng.uniform(-30, 30), rng.uniform(-30, 30), 0.0) for _ in range(100)]
    at += [(0, 0.1, 0.2, 0.3)] * 40 + [(1, 1.0, 1.0, 1.0), (1, 2.0, 1.0, 1.0), (1, None, 1.0, 1.0), (2, 5.0, 5.0, 5.0)]
    rows = [(c, 7 * i % len(at), x, y, z) for i, (c, x, y, z) in enumerate(at)]
    assert len({r[1] for r in rows}) == len(rows)
    nodes = spark.createDataFrame(rows, "case_id long, node_id long, x double, y double, z double")
    met, real = [], N.within

    def counted(a, b, *more):
        out = real(a, b, *more)
        met.append(out.count())
        return out

    monkeypatch.setattr(N, "within", counted)
    placed = [r for r in rows if r[2] is not None]
    for loops in (False, True):
        got = sorted(map(tuple, N.radius_graph(nodes, "node_id", 10.0, 5, loops).collect()))
        want = []
        for a in placed:
            near = sorted((math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2), b[1]) for b in placed if a[0] == b[0] and (loops or a[1] != b[1]))
            want += [(a[0], a[1], dst, d) for d, dst in near[:5] if d <= 10]
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, sorted(want)))
    assert 0 < sum(met) < 200 * 2 * len(rows)  # all pairs within the radius: over 800,000 each time
    assert N.radius_graph(nodes.filter("x > 1e9"), "node_id", 10.0, 5).count() == 0


def test_resampled_paths_stay_in_their_tasks(spark, monkeypatch):
    cells = _cells(spark)
    images = cells.select("case_id").distinct().select("case_id", *(F.lit(0.0).alias(f"corner_{n}") for n in "xyz"), *(F.lit(9.0).alias(f"size_{n}") for n in "xyz"))
    stored, real = [], A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: stored.append(df) or real(df))
    local, features = A.path_features(cells, images, 0.5)
    for df in (local, features):
        made, given = df._jdf.queryExecution().executedPlan().toString().split("Generate explode", 1)
        assert "Exchange" not in made and given.count("MapInArrow") == 1
    assert not stored
    rows = local.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.max("accumulated").alias("length")).collect()
    got = {r["cell_id"]: r["length"] for r in features.collect()}
    assert len(got) > 30 and got.keys() == {r["cell_id"] for r in rows if r["n"] > 2} and all(abs(got[r["cell_id"]] - r["length"]) < 1e-9 for r in rows if r["n"] > 2)


def test_pieces_make_the_same_points_in_parts(spark):
    cells = _cells(spark)
    points = lambda pieces: sorted(map(tuple, P.grid_points(pieces).collect()), key=lambda r: r[:3])
    whole, parts = P.spline_pieces(cells, 0.05), P.spline_pieces(cells, 0.05, 7)
    assert whole.count() <= 2 * cells.count() < parts.count() and parts.agg(F.max("made")).first()[0] == 7
    assert points(whole) == points(parts)


def test_curvature_by_columns_is_that_of_the_definition(spark):
    cells = _cells(spark, 6, 60).union(spark.createDataFrame([(1, 99, i, float("nan") if i == 3 else float(i), float(i * i), 1.0, 1.0) for i in range(8)], "case_id long, cell_id long, point_idx int, x double, y double, z double, radius double"))
    want = {r[:3]: r[3] for r in map(tuple, P.local_curvature(cells).select("case_id", "cell_id", "point_idx", "local_curvature").collect())}
    df = P.near_curvature(cells)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r[:3]: r[3] for r in map(tuple, df.select("case_id", "cell_id", "point_idx", "curvature").collect())}
    assert got.keys() == want.keys() and all(repr(got[k]) == repr(want[k]) for k in want) and {None} < {*want.values()}
