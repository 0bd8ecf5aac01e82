"""Local features of both accesses over one graph, against a walk of each node in plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tubula.operators import vessels

NAMES = ["mean_step", "curvature", "torsion", "module", "polar", "azimuth"]


def brute(pos: dict, edges: list, start: int) -> dict:
    """Features of the nodes that the start leads to, one at a time; None where undefined before filling."""
    every, real = {n: set() for n in pos}, {n: set() for n in pos}
    for a, b, artificial in edges:
        for u, v in ((a, b), (b, a)):
            every[u].add(v)
            if not artificial:
                real[u].add(v)
    level, parent, acc, queue = {start: 0}, {start: None}, {start: 0.0}, [start]
    while queue:
        n = queue.pop(0)
        for v in sorted(every[n]):
            if v not in level:
                level[v], parent[v], acc[v] = level[n] + 1, n, acc[n] + math.dist(pos[n], pos[v])
                queue.append(v)
    up = lambda n, but=None: sorted(v for v in real[n] if level[v] < level[n] and v != but)
    down = lambda n, but=None: sorted(v for v in real[n] if level[v] > level[n] and v != but)
    out = {}
    for n in level:
        near, at = sorted(real[n], key=lambda v: v), 1
        if len(near) == 2:
            above, below = [], []
            for v in up(n):
                above = (up(v, n)[:1] if len(real[v]) == 2 else []) + [v] + above
            for v in down(n):
                below += [v] + (down(v, n)[:1] if len(real[v]) == 2 else [])
            line = above + [n] + below
            at = 1 if len(line) == 3 else len(above)
        elif near:
            first = (up(n) + near)[0]
            climb = level[first] < level[n]
            rest = (up(first, n) or sorted(real[first] - {n})) if climb else down(first, n)
            line = [n, first, *rest[:1]]
            if len(near) == 1 and climb:
                line.reverse()
        else:
            line = []
        row = dict.fromkeys(NAMES)
        if len(line) >= 3:
            p = np.array([pos[v] for v in line], float)
            row["mean_step"] = sum(np.linalg.norm(p[1:] - p[:-1], axis=1)) / (len(p) - 1)
            with np.errstate(all="ignore"):
                r = np.gradient(p, axis=0)
                speed = np.linalg.norm(r, axis=1)[:, None]
                t = r / speed
                s = np.gradient(t, axis=0) / speed
                k = np.linalg.norm(s, axis=1)[:, None]
                normal = s / k
                torsion = -(np.gradient(np.cross(t, normal), axis=0) / speed * normal).sum(1)
            row["curvature"], row["torsion"] = float(k[at, 0]), float(torsion[at])
            x, y, z = p[-1] - p[0]
            row["module"] = math.sqrt(x * x + y * y + z * z)
            row["polar"] = (0.0 if abs(x) > 1e-5 or abs(y) > 1e-5 else None) if abs(z) < 1e-5 else math.copysign(math.pi / 2, z) - math.atan(math.hypot(x, y) / z)
            row["azimuth"] = None if abs(x) < 1e-5 and abs(y) < 1e-5 else float(np.sign(y)) * math.acos(x / math.hypot(x, y))
        out[n] = {c: None if v is None or not math.isfinite(v) else v for c, v in row.items()} | {"level": level[n], "accumulated": acc[n]}
    whole = {n: dict(row) for n, row in out.items()}
    for n in out:
        for c in NAMES:
            at = n
            root = min((v for v in out if out[v][c] is not None), key=lambda v: (level[v], v), default=None)
            while at is not None and out[at][c] is None:
                at = parent[at]
            source = at if at is not None else root
            whole[n][c] = 0.0 if source is None else out[source][c]
    return whole


def test_both_accesses_against_plain_walks(spark):
    rng = random.Random(11)
    nodes, edges, starts, want = [], [], [], {}
    for case in (1, 2, 3):
        pos, own = {0: (0.0, 0.0, 0.0)}, []
        for n in range(1, 60):
            parent = n - 1 if rng.random() < 0.8 else rng.randrange(n)
            straight = case == 3 and n < 20
            pos[n] = tuple(c + (1.0 if straight and i == 2 else 0.0 if straight else rng.uniform(-3, 3)) for i, c in enumerate(pos[parent]))
            own.append((parent, n, rng.random() < 0.08))
        nodes += [(case, n, *p, 1.0 + n, "AA") for n, p in pos.items()]
        edges += [(case, *e) for e in own]
        for access, node in (("femoral", 0), ("radial", 59)):
            starts.append((case, access, node))
            want |= {(case, access, n): row for n, row in brute(pos, own, node).items()}
    frame = vessels.local_graph_features(
        spark.createDataFrame(nodes, "case_id long, node_id long, x double, y double, z double, radius double, class_name string"),
        spark.createDataFrame(edges, "case_id long, src long, dst long, artificial boolean"),
        spark.createDataFrame(starts, "case_id long, access string, node_id long"),
        spark.createDataFrame([(1, 0, 0, 0, 7.0)], "case_id long, i int, j int, k int, value double"),
    )
    got = {(r["case_id"], r["access"], r["node_id"]): r for r in frame.collect()}
    assert got.keys() == want.keys() and got[1, "radial", 0]["value"] == 7.0 and got[2, "femoral", 5]["radius"] == 6.0
    for k, row in want.items():
        for c in (*NAMES, "level", "accumulated"):
            assert got[k][c] == pytest.approx(row[c], rel=1e-6, abs=1e-6), (k, c)


def test_no_starts_and_lone_edges(spark):
    nodes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 3.0, 4.0, 0.0)], "case_id long, node_id long, x double, y double, z double")
    edges = spark.createDataFrame([(1, 0, 1, None)], "case_id long, src long, dst long, artificial boolean")
    starts = spark.createDataFrame([(1, "femoral", 0)], "case_id long, access string, node_id long")
    rows = {r["node_id"]: r for r in vessels.local_graph_features(nodes, edges, starts).collect()}
    assert rows[1]["accumulated"] == 5.0 and all(rows[n][c] == 0.0 for n in (0, 1) for c in NAMES)
    assert vessels.local_graph_features(nodes, edges, starts.limit(0)).count() == 0


def _hubs(rng):
    """Graphs with hubs, cycles, lone edges and places that repeat: nodes, edges, starts and their features."""
    nodes, edges, starts, want = [], [], [], {}
    for case in (1, 2):
        pos = {n: tuple(float(rng.randrange(4)) for _ in range(3)) for n in range(40)}
        own = [(20, n, n % 9 == 0) for n in range(21, 34)] + [(n, n + 1, n == 5) for n in range(20)] + [(34, 35, False), (35, 36, False), (36, 39, True)]
        own += [(3, 11, False), (33, 15, False)] if case == 1 else []  # of odd length: no node has two parents
        nodes += [(case, n, *p) for n, p in pos.items()]
        edges += [(case, *e) for e in own] + [(case, 4, 4, False), (case, 1, 0, False)]
        for access, node in (("femoral", 0), ("radial", 33), ("other", 35)):
            starts.append((case, access, node))
            want |= {(case, access, n): row for n, row in brute(pos, own, node).items()}
    return nodes, edges, starts, want


@pytest.mark.parametrize("limit", [None, 0])
def test_hubs_and_cycles_without_arrays_of_neighbours_or_broadcasts(spark, tmp_path, monkeypatch, limit):
    nodes, edges, starts, want = _hubs(random.Random(3))
    frames = []
    for name, rows, schema in (("n", nodes, "case_id long, node_id long, x double, y double, z double"), ("e", edges, "case_id long, src long, dst long, artificial boolean"), ("s", starts, "case_id long, access string, node_id long")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    held, kept = [], vessels.cut_lineage
    monkeypatch.setattr(vessels, "cut_lineage", lambda df: held.append(df) or kept(df))
    df = vessels.local_graph_features(*frames) if limit is None else vessels.local_graph_features(*frames, limit=limit)
    got = {(r["case_id"], r["access"], r["node_id"]): r for r in df.collect()}
    assert got.keys() == want.keys()
    for k, row in want.items():
        for c in (*NAMES, "level", "accumulated"):
            assert got[k][c] == pytest.approx(row[c], rel=1e-6, abs=1e-6), (k, c)
    assert not any(kind.startswith("array") for f in held for _, kind in f.dtypes)
    if limit is None:
        assert not any("Broadcast" in f._jdf.queryExecution().toString() for f in [df, *held])
