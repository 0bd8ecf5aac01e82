"""Analytic cases of the coordinate functions and of the operators on ordered points."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tubula.functions import geom as G
from tubula.operators import polyline as P
from tubula.operators import segments as S

SCHEMA = "case_id long, cell_id long, point_idx int, x double, y double, z double, radius double, blanking int"


def line(spark, pts, radii=None, blank=None, cell=0):
    return spark.createDataFrame([(0, cell, i, *map(float, p), float(radii[i]) if radii else 1.0, blank[i] if blank else 0) for i, p in enumerate(pts)], SCHEMA)


def test_spherical_angles(spark):
    rows = [(0.0, 0.0, 2.0), (3.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, -1.0, 0.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = {tuple(r[:3]): r[3:] for r in df.select("x", "y", "z", *G.spherical(G.vec())).collect()}
    assert got[rows[0]] == pytest.approx((2, math.pi / 2, None)) or (got[rows[0]][1] == pytest.approx(math.pi / 2) and got[rows[0]][2] is None)
    assert got[rows[1]][1] == 0 and got[rows[1]][2] == 0
    assert got[rows[2]][2] == pytest.approx(math.pi / 4) and got[rows[3]][2] == pytest.approx(-math.pi / 4)
    assert got[rows[4]][1] is None and got[rows[4]][2] is None


def test_lpi_corner_and_orientation_error(spark):
    base = [1.0, 0, 0, 5, 0, 1, 0, -7, 0, 0, 1, 3, 0, 0, 0, 1]
    flips = {(1, 1): (5, -7, 3), (-1, 1): (-4, -7, 3), (-1, -1): (-4, -18, 3)}
    for (sx, sy), want in flips.items():
        a = list(map(float, base))
        a[0], a[5] = float(sx), float(sy)
        df = spark.createDataFrame([(a,)], "a array<double>")
        assert tuple(df.select(*G.lpi_corner(F.col("a"), F.lit(10), F.lit(12))).first()) == want
    a[0], a[5], a[10] = 1.0, 1.0, -1.0
    with pytest.raises(Exception, match="orientation"):
        spark.createDataFrame([(a,)], "a array<double>").select(*G.lpi_corner(F.col("a"), F.lit(10), F.lit(12))).collect()


def test_circle_has_constant_curvature_and_no_torsion(spark):
    pts = [(5 * math.cos(t), 5 * math.sin(t), 0) for t in (k * math.pi / 2 / 49 for k in range(50))]
    rows = P.local_curvature(line(spark, pts)).filter("point_idx between 3 and 45").collect()
    assert all(r["local_curvature"] == pytest.approx(0.2, abs=0.01) and abs(r["local_torsion"]) < 1e-6 for r in rows) and len(rows) == 43


def test_helix(spark):
    pts = [(4 * math.cos(t), 4 * math.sin(t), 1.5 * t) for t in (k * 0.05 for k in range(200))]
    rows = P.local_curvature(line(spark, pts)).filter("point_idx between 5 and 190").collect()
    assert all(r["local_curvature"] == pytest.approx(4 / 18.25, abs=0.01) and r["local_torsion"] == pytest.approx(1.5 / 18.25 * 2 / 3, abs=0.005) for r in rows)  # five points see two thirds of it


def test_resampling_keeps_ends_and_short_lines(spark):
    pts = [(k, 0, 0) for k in range(10)]
    rows = sorted(P.resample_linear(line(spark, pts, list(range(10))), 2.0).collect(), key=lambda r: r["point_idx"])
    assert [round(r["x"], 6) for r in rows] == [0, 1.8, 3.6, 5.4, 7.2, 9] and rows[0]["radius"] == 0 and rows[-1]["radius"] == 9
    short = P.resample_linear(line(spark, [(0, 0, 0), (0.5, 0, 0)]).unionByName(line(spark, [(1, 1, 1)], cell=1)), 2.0)
    assert short.count() == 3


def test_bent_line(spark):
    p = line(spark, [(0, 0, 0), (3, 0, 0), (3, 4, 0)])
    r = S.tortuosity(p).first()
    assert r["length"] == 7 and r["tortuosity"] == pytest.approx(1 - 5 / 7)
    assert S.bending_length(line(spark, [(0, 0, 0), (1, 2, 0), (2, 0, 0)])).first()["bending_length"] == pytest.approx(2)


def test_diameters_and_ends_respect_blanking(spark):
    r = S.diameter_stats(line(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)], [1, 2, 10], [0, 0, 1])).first()
    assert (r["mean_diameter"], r["max_diameter"], r["min_diameter"]) == (3, 4, 2)
    assert S.diameter_stats(line(spark, [(0, 0, 0), (1, 0, 0)], [1, 3], [1, 1])).first()["mean_diameter"] == 4
    p = line(spark, [(k, 0, 0) for k in range(4)], blank=[1, 0, 0, 1])
    r = S.end_nodes(p).first()
    assert (r["proximal"]["point_idx"], r["distal"]["point_idx"]) == (1, 2)
    r = S.end_nodes(p, blanked=False).first()
    assert (r["proximal"]["point_idx"], r["distal"]["point_idx"]) == (0, 3)


def test_smoothing_reproduces_polynomials_inside(spark):
    p = line(spark, [(k, 0, 0) for k in range(80)]).withColumn("v", 2 + 0.5 * F.col("x") - 0.01 * F.col("x") * F.col("x"))
    rows = P.savgol_smooth(p, "v", "s", 21, 3).filter("point_idx between 12 and 66").collect()
    assert all(r["s"] == pytest.approx(r["v"], abs=1e-9) for r in rows)
    flat = P.gaussian_smooth(p.withColumn("v", F.lit(3.0)), "v", "s").collect()
    assert all(r["s"] == pytest.approx(3) for r in flat)


def test_frames_are_orthonormal_and_straight_lines_keep_them(spark):
    pts = [(math.cos(t), math.sin(t), 0.3 * t) for t in (k * 0.1 for k in range(40))]
    rows = P.transported_frames(P.tangents(line(spark, pts))).collect()
    for r in rows:
        n, t = [r[f"n{c}"] for c in "xyz"], [r[f"t{c}"] for c in "xyz"]
        assert sum(a * a for a in n) == pytest.approx(1) and sum(a * b for a, b in zip(n, t)) == pytest.approx(0, abs=0.02)
    straight = P.transported_frames(P.tangents(line(spark, [(0, 0, k) for k in range(5)]))).collect()
    assert {(r["nx"], r["ny"], r["nz"]) for r in straight} == {(0.0, 1.0, 0.0)}


def test_peaks_and_pchip(spark):
    v = [math.exp(-((k - 20) ** 2) / 50) + 0.5 * math.exp(-((k - 60) ** 2) / 50) for k in range(90)]
    p = line(spark, [(k, 0, 0) for k in range(90)], v)
    assert sorted(r["point_idx"] for r in P.peaks(p, "radius", 0.03, 5).collect()) == [20, 60]
    assert [r["point_idx"] for r in P.peaks(p, "radius", 0.7, 5).collect()] == [20]
    assert {r["curve_id"] for r in P.curve_ids(p, "radius", 0.03, 5).collect()} == {0, 1}
    rows = P.pchip(p, "x", "radius", F.col("point_idx") % 2 == 0, "fit").filter("point_idx % 2 = 0").collect()
    assert all(r["fit"] == pytest.approx(r["radius"]) for r in rows)
    with pytest.raises(Exception, match="fewer than four"):
        P.pchip(p.filter("point_idx < 3"), "x", "radius", F.lit(True), "fit").collect()


def test_peak_places_by_brute_force():
    rng = np.random.default_rng(5)

    def brute(v, height, width):
        out, k, n = [], 0, len(v)
        while k < n:
            b = k
            while b + 1 < n and v[b + 1] == v[k]:
                b += 1
            if 0 < k and b < n - 1 and v[k - 1] < v[k] > v[b + 1] and v[k] >= height:
                p, top = (k + b) // 2, v[k]
                i = j = p
                while i - 1 >= 0 and v[i - 1] <= top:
                    i -= 1
                while j + 1 < n and v[j + 1] <= top:
                    j += 1
                prominence = top - max(v[i : p + 1].min(), v[p : j + 1].min())
                level = top - prominence / 2
                lo, hi = p, p
                while lo >= i and v[lo] > level:
                    lo -= 1
                while hi <= j and v[hi] > level:
                    hi += 1
                left = lo + (level - v[lo]) / (v[lo + 1] - v[lo]) if lo >= i else i
                right = hi - (level - v[hi]) / (v[hi - 1] - v[hi]) if hi <= j else j
                if right - left >= width:
                    out.append((p, prominence, right - left))
            k = b + 1
        return out

    for n in (0, 1, 2, 3, 5, 40, 300):
        for digits in (0, 1, 6):
            v = np.round(rng.normal(size=n).cumsum(), digits)
            got = list(zip(*P.peak_places(v, -1.0, 1.5), strict=True))
            want = brute(v, -1.0, 1.5)
            assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1:] for g in got], [w[1:] for w in want])
