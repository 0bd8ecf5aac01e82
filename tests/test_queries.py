"""Registered queries without a DuckDB counterpart, on small tables against brute force."""

from __future__ import annotations

import collections
import datetime
import itertools
import random

import pytest

from tubula.plans import load

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"


def lines(spark, path, n, seed, top=50):
    """Random line items and their orders as Parquet; the rows."""
    rng = random.Random(seed)
    rows = [(k // 4, k, k % 7, k % 4, float(rng.randrange(1, top + 1)), 1000.0 * rng.randrange(1, 90), rng.randrange(11) / 100, rng.randrange(9) / 100, rng.choice("ANR"), "F", datetime.date(1995, 1, 1)) for k in range(n)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 5, "1-URGENT") for k in range(n // 4 + 1)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return rows


def flood(mask, near):
    """Component of each voxel (case, i, j, k): the smallest voxel that can be reached."""
    out = {}
    for v in sorted(mask):
        todo = [] if v in out else [v]
        while todo:
            at = todo.pop()
            if at in mask and at not in out:
                out[at] = v
                todo += [(at[0], at[1] + a, at[2] + b, at[3] + c) for a, b, c in near]
    return out


def test_components_of_the_whole_mask(spark, tmp_path):
    rows = lines(spark, tmp_path, 2400, 11)
    mask = {(r[2] % 5, round(r[4]), round(r[6] * 100), round(r[7] * 100)) for r in rows if r[8] == "A"}
    number = lambda v: v[1] * (1 << 40) + v[2] * (1 << 20) + v[3]
    near = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s)]
    want = flood(mask, near)
    got = {tuple(r[:4]): r["component"] for r in load()[0]["q2_7_5_voxel_components"](spark, str(tmp_path)).collect()}
    assert got == {v: number(c) for v, c in want.items()} and len(set(want.values())) > 5
    six = collections.Counter(flood(mask, [s for s in near if sum(map(abs, s)) == 1]).values())
    want = []
    for case in {v[0] for v in mask}:
        own = sorted(((-n, number(c)) for c, n in six.items() if c[0] == case and n >= 2))[:5]
        want += [(case, c, -n, place) for place, (n, c) in enumerate(own, 1)]
    got = load()[0]["q2_5_22_component_sizes"](spark, str(tmp_path)).select("case_id", "component", "n", "place").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_circles_equal_the_exact_ones(spark, tmp_path):
    rows = lines(spark, tmp_path, 240, 12)
    cases = collections.defaultdict(set)
    for r in rows:
        cases[r[0] % 5].add((r[4], r[6] * 100))
    for r in load()[0]["q2_5_37_min_enclosing_circle"](spark, str(tmp_path)).collect():
        pts = [complex(*p) for p in cases.pop(r["case_id"])]
        centres = [(a + b) / 2 for a, b in itertools.combinations(pts, 2)]
        for a, b, c in itertools.combinations(pts, 3):
            b, c = b - a, c - a
            if cross := (b.conjugate() * c).imag:
                centres.append(a + 1j * (abs(b) ** 2 * c - abs(c) ** 2 * b) / (-2 * cross))
        radius, centre = min(((max(abs(p - m) for p in pts), m) for m in centres), key=lambda x: x[0])
        assert (r["radius"], r["cu"], r["cv"]) == (pytest.approx(radius, rel=1e-5), pytest.approx(centre.real, abs=0.01), pytest.approx(centre.imag, abs=0.01))
    assert not cases
