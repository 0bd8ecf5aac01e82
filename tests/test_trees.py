"""Levels and paths within a task and by pointer jumping, against plain searches."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tubula.functions import runtime
from tubula.operators import graph as G
from tubula.operators import trees as T

EDGE = "case_id string, src long, dst long, length double"


def around(edges):
    near = collections.defaultdict(lambda: collections.defaultdict(list))
    for c, a, b, w in edges:
        if a != b:
            near[c, a][b].append(w)
            near[c, b][a].append(w)
    return near


def levels(edges, starts):
    near, out = around(edges), {(c, n): (0, None, 0.0) for c, n in starts}
    front = list(out)
    while front:
        new = {}
        for c, n in front:
            for m, ws in near[c, n].items():
                if (c, m) not in out:
                    had = new.get((c, m))
                    mine = (n, out[c, n][2] + min(ws))
                    new[c, m] = mine if had is None else min(had, mine)
        out |= {k: (out[k[0], p][0] + 1, p, acc) for k, (p, acc) in new.items()}
        front = list(new)
    return sorted((*k, *v) for k, v in out.items())


def paths(edges, starts):
    near, out = around(edges), []

    def go(c, path):
        for m in near[c, path[-1]]:
            if m not in path:
                if len(near[c, m]) == 1:
                    out.append((c, m, [*path, m]))
                go(c, [*path, m])

    for c, n in starts:
        go(c, [n])
    return sorted(out)


def forest(rng, case, n, chance=0.1):
    return [(case, rng.randrange(k), k, rng.randint(1, 9) / 1.0) for k in range(1, n) if rng.random() > chance]


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple(str(x) if x is None else x for x in r[:2]))


@pytest.mark.parametrize("limit", [None, 0])
def test_levels_and_paths_of_forests(spark, limit):
    rng = random.Random(4)
    edges = forest(rng, "a", 60) + forest(rng, "b", 40, 0) + [("c", 5, 3, 1.0), ("c", 3, 9, 2.0)] + [("star", 0, k, 1.0) for k in range(1, 30)]
    starts = [("a", 0), ("b", 17), ("c", 3), ("star", 4), ("none", 8)]
    frame, begin = spark.createDataFrame(edges, EDGE), spark.createDataFrame(starts, "case_id string, node_id long")
    assert got(G.bfs_levels(frame, begin, "length", limit).select("case_id", "node_id", "level", "parent", "acc")) == levels(edges, starts)
    assert got(G.root_to_leaf_paths(frame, begin, limit).select("case_id", "leaf", "path")) == paths(edges, starts)


@pytest.mark.parametrize("limit", [None, 0])
def test_cycles_and_several_starts(spark, limit):
    edges = [("a", k, (k + 1) % 7, 1.0 + k) for k in range(7)] + [("a", 3, 20, 2.0), ("a", 20, 21, 1.0), ("a", 21, 21, 5.0), ("b", 1, 2, 1.0), ("b", 2, 3, 4.0), ("b", 3, 4, 1.0)]
    starts = [("a", 0), ("b", 1), ("b", 4)]
    frame, begin = spark.createDataFrame(edges, EDGE), spark.createDataFrame(starts, "case_id string, node_id long")
    assert got(G.bfs_levels(frame, begin, "length", limit).select("case_id", "node_id", "level", "parent", "acc")) == levels(edges, starts)
    assert got(G.root_to_leaf_paths(frame.filter("src <> dst"), begin, limit).select("case_id", "leaf", "path")) == paths(edges, starts)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    n = 4000
    order = list(range(n))
    random.Random(1).shuffle(order)
    frame = spark.createDataFrame([("a", order[k], order[k + 1], 1.0) for k in range(n - 1)], EDGE)
    begin = spark.createDataFrame([("a", order[0])], "case_id string, node_id long")
    rounds = []
    kept = runtime.stored
    monkeypatch.setattr(T, "stored", lambda df, name: (rounds.append(name), kept(df, name))[1])
    rows = {r["node_id"]: (r["level"], r["acc"]) for r in G.bfs_levels(frame, begin, "length", 0).collect()}
    assert rows == {v: (k, float(k)) for k, v in enumerate(order)}
    assert rounds.count("jumps") <= 15 + 2  # two lists, with their first rows
    assert G.bfs_levels(frame, begin, "length").agg(F.max("level")).first()[0] == n - 1
    path = G.root_to_leaf_paths(frame, begin).collect()
    assert len(path) == 1 and path[0]["path"] == order


def test_tours_broadcast_no_nodes_or_arcs_and_find_components_once(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    edges, starts = forest(rng, "a", 30) + forest(rng, "b", 20, 0), [("a", 0), ("b", 7)]
    frames = []
    for name, rows, schema in (("edges", edges, EDGE), ("starts", starts, "case_id string, node_id long")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    held, stars, kept, star = [], [], T.stored, T.star_components
    monkeypatch.setattr(T, "stored", lambda df, name: held.append(df) or kept(df, name))
    monkeypatch.setattr(T, "star_components", lambda e, keys: stars.append(keys) or star(e, keys))
    found = G.root_to_leaf_paths(*frames, 0)
    assert got(found.select("case_id", "leaf", "path")) == paths(edges, starts)
    assert len(stars) == 1
    # only the short lists of cases may be sent to all tasks
    for df in [found, *held]:
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            assert not re.search(r"BroadcastHashJoin .*\b(node|node_id|src|dst|next|root|component|block)#", line), line
