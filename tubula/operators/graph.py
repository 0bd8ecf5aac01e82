"""Graph operators on nodes (case_id, node_id, ...) and undirected edges (case_id, src, dst, ...).
Walks from start nodes are in ``trees``; other iterations are joins over a frontier whose lineage is cut every round."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubula.functions.geom import cosine, dist, vec
from tubula.functions.runtime import cut_lineage, discard, spread
from tubula.operators.components import star_components
from tubula.operators.polyline import KEYS, order
from tubula.operators.trees import walk_components, walk_levels, walk_paths

#: Rows of a frontier that may be broadcast (some 20 MB).
FRONT_ROWS = 100_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, other columns kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(*rest, "src", "dst").unionByName(edges.select(*rest, F.col("dst").alias("src"), F.col("src").alias("dst")))


def degree(edges: DataFrame) -> DataFrame:
    """Degree of every node that has an edge."""
    return both_ways(edges.select("case_id", "src", "dst")).groupBy("case_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def components(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Smallest node of each node's component. Large cases take star steps, the others one exchange (see ``trees``)."""
    c = walk_components(edges, limit)
    return nodes.select("case_id", "node_id").join(spread(c), ["case_id", "node_id"], "left").select("case_id", "node_id", F.coalesce("component", "node_id").alias("component"))


def drop_small(labels: DataFrame, least: int = 5) -> DataFrame:
    """Nodes of components with at least ``least`` nodes."""
    big = labels.groupBy("case_id", "component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return labels.join(big.select("case_id", "component"), ["case_id", "component"], "left_semi")


def remote_components(placed: DataFrame, factor: float = 2.5) -> DataFrame:
    """Components whose centre is farther from the case's centre than ``factor`` times the mean distance
    of its nodes: case_id, component, distance. placed: case_id, node_id, component, x, y, z."""
    w = Window.partitionBy("case_id")
    p = placed.withColumns({f"m{n}": F.avg(n).over(w) for n in "xyz"})
    xyz = lambda s: tuple(F.col(s + n) for n in "xyz")
    p = p.withColumn("d", dist(xyz(""), xyz("m"))).withColumn("mean", F.avg("d").over(w))
    c = p.groupBy("case_id", "component").agg(*(F.avg(n).alias(n) for n in "xyz"), *(F.first(f"m{n}").alias(f"m{n}") for n in "xyz"), F.first("mean").alias("mean"))
    return c.withColumn("distance", dist(xyz(""), xyz("m"))).filter(F.col("distance") > factor * F.col("mean")).select("case_id", "component", "distance")


def bfs_levels(edges: DataFrame, start: DataFrame, weight: str | None = None, limit: int | None = None) -> DataFrame:
    """Levels from start nodes (case_id, node_id): case_id, node_id, level, parent (the smallest node of
    the level before, NULL at the start) and acc, the sum of ``weight`` along the parents. ``limit``: edges of a case
    that one task walks (see ``trees``)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return walk_levels(edges.select("case_id", "src", "dst", w.alias("w")), start, _level_by_level, limit)


def _level_by_level(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Levels of graphs that no task can hold and that have cycles: one round a level."""
    two = cut_lineage(both_ways(edges.select("case_id", "src", "dst", "w")))
    front = cut_lineage(start.select("case_id", "node_id", F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("parent"), F.lit(0.0).alias("acc")))
    seen = front
    for level in itertools.count(1):
        step = front.join(two, (front["node_id"] == two["src"]) & (front["case_id"] == two["case_id"])).select(front["case_id"], F.col("dst").alias("node_id"), F.struct(F.col("src").alias("parent"), (F.col("acc") + F.col("w")).alias("acc")).alias("p"))
        new = step.groupBy("case_id", "node_id").agg(F.min("p").alias("p")).join(seen.select("case_id", "node_id"), ["case_id", "node_id"], "left_anti")
        front = cut_lineage(new.select("case_id", "node_id", F.lit(level).alias("level"), "p.parent", "p.acc"))
        if not front.limit(1).count():
            return seen
        seen = cut_lineage(seen.unionByName(front)) if level % 8 == 0 else seen.unionByName(front)


def start_nodes(nodes: DataFrame, degrees: DataFrame, part: float = 0.6) -> DataFrame:
    """The rightmost end node in the lowest ``part`` of each case's height: case_id, node_id."""
    low, high = (f("z").over(Window.partitionBy("case_id")) for f in (F.min, F.max))
    ends = nodes.withColumn("_limit", low + part * (high - low)).join(degrees.filter("degree = 1"), ["case_id", "node_id"]).filter("z <= _limit")
    return ends.groupBy("case_id").agg(F.max_by("node_id", F.struct(F.col("x"), -F.col("node_id"))).alias("node_id"))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """The node with the smallest id of each case."""
    return nodes.groupBy("case_id").agg(F.min("node_id").alias("node_id"))


def lowest_ends(nodes: DataFrame, degrees: DataFrame, labels: DataFrame) -> DataFrame:
    """The lowest end node of each component: case_id, component, node_id."""
    ends = nodes.join(degrees.filter("degree = 1").select("case_id", "node_id"), ["case_id", "node_id"], "left_semi").join(labels, ["case_id", "node_id"])
    return ends.groupBy("case_id", "component").agg(F.min_by("node_id", F.struct("z", "node_id")).alias("node_id"))


def line_graph(edges: DataFrame, key: str = "edge_id") -> DataFrame:
    """Edges as nodes; two are linked when they share an end: case_id, a < b."""
    ends = edges.select("case_id", key, F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    other = ends.withColumnRenamed(key, "b")
    return ends.withColumnRenamed(key, "a").join(other, ["case_id", "node"]).filter("a < b").select("case_id", "a", "b").distinct()


def find_root(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """The widest end node of each case, the smallest id on ties."""
    return nodes.join(degrees.filter("degree = 1"), ["case_id", "node_id"]).groupBy("case_id").agg(F.max_by("node_id", F.struct("radius", -F.col("node_id"))).alias("node_id"))


def root_to_leaf_paths(edges: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """All simple paths from the start to other end nodes: case_id, leaf, path (array of nodes). Trees have one for
    each end; a graph with cycles may have very many. ``limit``: edges of a case that one task walks."""
    return walk_paths(edges, start, _node_by_node, limit)


def _node_by_node(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Paths of graphs that no task can hold and that have cycles: they grow by one node a round."""
    two = cut_lineage(both_ways(edges.select("case_id", "src", "dst")).distinct())
    leaf = degree(edges).filter("degree = 1").select("case_id", F.col("node_id").alias("last"), F.lit(True).alias("_leaf"))
    front = cut_lineage(start.select("case_id", F.array("node_id").alias("path")))
    done = None
    while True:
        f = front.withColumn("src", F.element_at("path", -1))
        grown = cut_lineage(f.join(two, ["case_id", "src"]).filter("not array_contains(path, dst)").select("case_id", F.array_append("path", F.col("dst")).alias("path")))
        if not grown.limit(1).count():
            break
        ended = grown.withColumn("last", F.element_at("path", -1)).join(leaf, ["case_id", "last"]).select("case_id", F.col("last").alias("leaf"), "path")
        done = ended if done is None else done.unionByName(ended)
        front = grown
    return done if done is not None else front.filter(F.lit(False)).select("case_id", F.lit(0).cast("bigint").alias("leaf"), "path")


def path_cells(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells that a path runs through, in order, each run once: case_id, leaf, cells (array). edges: with cell_id."""
    steps = paths.select("case_id", "leaf", F.posexplode("path").alias("i", "src")).withColumn("dst", F.lead("src").over(Window.partitionBy("case_id", "leaf").orderBy("i"))).filter("dst is not null")
    w = Window.partitionBy("case_id", "leaf").orderBy("i")
    own = steps.join(spread(both_ways(edges.select("case_id", "src", "dst", "cell_id"))), ["case_id", "src", "dst"]).withColumn("_new", F.coalesce(F.col("cell_id") != F.lag("cell_id").over(w), F.lit(True))).filter("_new")
    g = own.groupBy("case_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("i", "cell_id"))).alias("s"))
    return g.select("case_id", "leaf", F.transform("s", lambda s: s["cell_id"]).alias("cells"))


def path_dedup(paths: DataFrame) -> DataFrame:
    """Of paths with the same cells but the last, and the same last type, the one without artificial
    edges, then with the longer last cell: paths has case_id, leaf, cells, last_type, artificial, last_length."""
    w = Window.partitionBy("case_id", "_head", "last_type").orderBy(F.col("artificial").cast("int"), F.desc("last_length"), "leaf")
    return paths.withColumn("_head", F.slice("cells", 1, F.greatest(F.size("cells") - 1, F.lit(0)))).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_head")


def match_pathways(paths: DataFrame, configs: DataFrame, penalty: float = 0.15) -> DataFrame:
    """Best path for each configuration by cosine of type vectors, less a penalty for paths with an
    artificial edge: case_id, config, leaf, score. configs (config, wanted) is a short list that the driver
    reads; every path meets every one of it."""
    few = [F.struct(F.lit(r["config"]).alias("config"), F.array(*map(F.lit, r["wanted"])).alias("wanted")) for r in configs.select("config", "wanted").collect()]
    j = paths.withColumn("_c", F.explode(F.array(*few))).select("*", "_c.config", "_c.wanted").drop("_c").withColumn("score", cosine(F.col("vector"), F.col("wanted")) - F.when(F.col("artificial"), penalty).otherwise(0.0))
    return j.groupBy("case_id", "config").agg(F.max_by("leaf", F.struct(F.col("score"), -F.col("leaf"))).alias("leaf"), F.max("score").alias("score"))


def pathway_subgraph(nodes: DataFrame, edges: DataFrame, path_nodes: DataFrame, reach: float = 15.0, more: list[str] = ()) -> DataFrame:
    """Nodes of the chosen path (case_id, node_id) and of side branches up to ``reach`` mm from it:
    case_id, node_id, on_path. edges: with length. more: further columns that tell paths of a case apart."""
    keys = ["case_id", *more, "node_id"]
    two = cut_lineage(both_ways(edges.select("case_id", "src", "dst", "length"))).withColumnRenamed("src", "node_id")
    on = path_nodes.select(*keys, F.lit(0.0).alias("away")).distinct().join(spread(nodes.select("case_id", "node_id")), ["case_id", "node_id"], "left_semi")
    own = cut_lineage(on)
    front = own
    while True:
        near = (F.broadcast(front) if front.count() <= FRONT_ROWS else spread(front)).join(two, ["case_id", "node_id"])
        j = near.select("case_id", *more, F.col("dst").alias("node_id"), (F.col("away") + F.col("length")).alias("away")).filter(F.col("away") <= reach)
        best = j.groupBy(*keys).agg(F.min("away").alias("away")).join(spread(own.withColumnRenamed("away", "_had")), keys, "left")
        front = cut_lineage(best.filter(F.col("_had").isNull() | (F.col("away") < F.col("_had"))).select(*keys, "away"))
        if not front.limit(1).count():
            return own.select(*keys[:-1], "node_id", (F.col("away") == 0).alias("on_path"))
        own = cut_lineage(own.unionByName(front).groupBy(*keys).agg(F.min("away").alias("away")))


def path_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are flagged (nodes: case_id, node_id, on_path)."""
    on = nodes.filter("on_path").select("case_id", "node_id")
    e = edges.join(on.withColumnRenamed("node_id", "src"), ["case_id", "src"], "left_semi")
    return e.join(on.withColumnRenamed("node_id", "dst"), ["case_id", "dst"], "left_semi")


def cell_graph(points: DataFrame, eps: float = 1e-2) -> DataFrame:
    """One edge per cell between its ends; ends within ``eps`` of each other, also through others, are one
    node, named by its smallest end (twice the cell's number, plus 1 for its last point): case_id, cell_id,
    src, dst, n. cell_id is a whole number."""
    from tubula.operators.nearest import contract

    ends = points.groupBy(*KEYS).agg(F.min_by(F.struct(*"xyz"), "point_idx").alias("a"), F.max_by(F.struct(*"xyz"), "point_idx").alias("b"), F.count(F.lit(1)).alias("n"))
    ends = cut_lineage(ends)
    each = ends.select("case_id", F.explode(F.array(F.struct((F.col("cell_id") * 2).alias("end"), F.col("a").alias("p")), F.struct((F.col("cell_id") * 2 + 1).alias("end"), F.col("b").alias("p")))).alias("e")).select("case_id", "e.end", "e.p.*")
    node = cut_lineage(contract(each, "end", eps))
    side = lambda k, name: spread(node.select("case_id", F.col("end").alias(k), F.col("node").alias(name)))
    named = ends.withColumns({"_a": F.col("cell_id") * 2, "_b": F.col("cell_id") * 2 + 1}).join(side("_a", "src"), ["case_id", "_a"]).join(side("_b", "dst"), ["case_id", "_b"])
    return named.select(*KEYS, "src", "dst", "n")


def dense_graph(points: DataFrame) -> DataFrame:
    """Edges between consecutive points: case_id, cell_id, src_idx, dst_idx, length."""
    p = points.withColumns({f"_{n}": F.lag(n).over(order()) for n in ("point_idx", "x", "y", "z")}).filter("_point_idx is not null")
    return p.select(*KEYS, F.col("_point_idx").alias("src_idx"), F.col("point_idx").alias("dst_idx"), dist(tuple(F.col(n) for n in "xyz"), tuple(F.col(f"_{n}") for n in "xyz")).alias("length"))


def contracted_graph(points: DataFrame, eps: float = 1e-2) -> tuple[DataFrame, DataFrame]:
    """Nodes (case_id, node_id from 0, class_name, x, y, z, radius) and edges (case_id, src, dst, cell_id, class_name,
    length) of all points: points within ``eps`` are one node with the first one's values, edges join
    consecutive points, nodes without an edge are dropped. points: with class_name and a whole-number cell_id."""
    from tubula.operators.nearest import contract

    at = F.row_number().over(Window.partitionBy("case_id").orderBy("cell_id", "point_idx")).cast("long")
    numbered = cut_lineage(points.withColumn("at", at))
    name = cut_lineage(contract(numbered, "at", eps).select("case_id", F.col("at").alias("_at"), "node"))
    joined = numbered.join(spread(name), (numbered["case_id"] == name["case_id"]) & (numbered["at"] == name["_at"])).select(numbered["*"], "node")
    before = joined.withColumns({"_src": F.lag("node").over(order()), **{f"_{n}": F.lag(n).over(order()) for n in "xyz"}})
    length = dist(tuple(F.col(n) for n in "xyz"), tuple(F.col(f"_{n}") for n in "xyz"))
    raw = before.filter("_src is not null and _src <> node").select("case_id", F.col("_src").alias("src"), F.col("node").alias("dst"), "cell_id", "class_name", length.alias("length"))
    edges = cut_lineage(raw.groupBy("case_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min(F.struct("cell_id", "class_name", "length")).alias("e")).select("case_id", "src", "dst", "e.*"))
    used = both_ways(edges.select("case_id", "src", "dst")).select("case_id", F.col("src").alias("node")).distinct()
    kept = numbered.join(spread(used.withColumnRenamed("node", "at")), ["case_id", "at"]).select("case_id", F.col("at").alias("node_id"), "class_name", *"xyz", "radius")
    return reindexed(kept, edges)


def reindexed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with node ids made compact, 0..n-1 for each case in the order of the old ones."""
    new = cut_lineage(reindex(nodes))
    side = lambda old, name: spread(new.select("case_id", F.col("node_id").alias(old), F.col("index").cast("long").alias(name)))
    rest = [c for c in edges.columns if c not in ("case_id", "src", "dst")]
    moved = edges.withColumnsRenamed({"src": "_s", "dst": "_d"}).join(side("_s", "src"), ["case_id", "_s"]).join(side("_d", "dst"), ["case_id", "_d"])
    return new.drop("node_id").withColumnRenamed("index", "node_id").withColumn("node_id", F.col("node_id").cast("long")), moved.select("case_id", "src", "dst", *rest)


def reindex(nodes: DataFrame) -> DataFrame:
    """Adds index: 0..n-1 in node order for each case."""
    return nodes.withColumn("index", F.row_number().over(Window.partitionBy("case_id").orderBy("node_id")) - 1)


def rescale_levels(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Levels less the smallest one of their key; adds max_hierarchy, the largest one after that."""
    w = Window.partitionBy(*keys)
    return nodes.withColumns({"hierarchy": F.col("hierarchy") - F.min("hierarchy").over(w), "max_hierarchy": F.max("hierarchy").over(w) - F.min("hierarchy").over(w)})


def hierarchy(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels of all nodes: breadth-first from the start node of each case; each component that it doesn't
    reach goes on, in the order of its smallest node, one above the highest level so far, from its lowest
    end node (its smallest node if it has none). Edges get the smaller level of their ends."""
    label = cut_lineage(components(nodes, edges))
    first = start.select("case_id", "node_id").join(label, ["case_id", "node_id"]).select("case_id", "component", "node_id", F.lit(0).alias("_main"))
    ends = nodes.join(degree(edges).filter("degree = 1"), ["case_id", "node_id"], "left").join(label, ["case_id", "node_id"])
    low = ends.groupBy("case_id", "component").agg(F.coalesce(F.min_by("node_id", F.when(F.col("degree").isNotNull(), F.struct("z", "node_id"))), F.min("node_id")).alias("node_id"))
    starts = cut_lineage(first.unionByName(low.join(first, ["case_id", "component"], "left_anti").withColumn("_main", F.lit(1))))
    levels = bfs_levels(edges, starts.select("case_id", "node_id")).join(label, ["case_id", "node_id"])
    size = levels.groupBy("case_id", "component").agg((F.max("level") + 1).alias("n")).join(starts.select("case_id", "component", "_main"), ["case_id", "component"])
    before = Window.partitionBy("case_id").orderBy("_main", "component").rowsBetween(Window.unboundedPreceding, -1)
    shift = size.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = cut_lineage(levels.join(shift.select("case_id", "component", "shift"), ["case_id", "component"]).select("case_id", "node_id", (F.col("level") + F.col("shift")).cast("int").alias("level"), "parent"))
    side = lambda k: own.select("case_id", F.col("node_id").alias(k), F.col("level").alias(f"_{k}"))
    leveled = edges.join(side("src"), ["case_id", "src"]).join(side("dst"), ["case_id", "dst"]).withColumn("level", F.least("_src", "_dst")).drop("_src", "_dst")
    return own, leveled


def attached_nodes(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, main: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that are in one component with a main node once the bridges are edges, and the edges between them
    with the bridges (flagged artificial); what nothing joined is left out."""
    rest = [c for c in edges.columns if c not in ("case_id", "src", "dst")]
    all_edges = edges.withColumn("artificial", F.lit(False)).unionByName(bridges.select("case_id", "src", "dst", F.col("distance").alias("length"), F.lit(True).alias("artificial")) if "length" in rest else bridges.select("case_id", "src", "dst", F.lit(True).alias("artificial")), allowMissingColumns=True)
    label = cut_lineage(components(nodes, all_edges).join(spread(nodes), ["case_id", "node_id"]).withColumn("_main", main))
    kept = label.filter("_main").select("case_id", "component").distinct()
    own = label.join(spread(kept), ["case_id", "component"], "left_semi").select(*nodes.columns)
    return own, all_edges.join(spread(own.select("case_id", F.col("node_id").alias("src"))), ["case_id", "src"], "left_semi")


def merge_cells(cells: DataFrame) -> DataFrame:
    """Chains of cells that meet at ends no other cell touches, as one: case_id, cell_id, merged (the smallest
    cell of its chain)."""
    pairs = merge_degree_2(cells)
    c = star_components(pairs.select("case_id", F.col("a").alias("src"), F.col("b").alias("dst")), ["case_id"])
    return cells.select("case_id", "cell_id").join(c.select("case_id", F.col("node").alias("cell_id"), "component"), ["case_id", "cell_id"], "left").select("case_id", "cell_id", F.coalesce("component", "cell_id").alias("merged"))


def merged_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points of the chains of merge_cells as one line each: the chain is walked from the end with the smaller
    name, cells that run against it are reversed, and a shared end appears once. cells: case_id, cell_id,
    src, dst of cell_graph. Returns points with cell_id = merged; closed chains are left as they are."""
    own = cut_lineage(cells.join(merge_cells(cells), ["case_id", "cell_id"]))
    chain = F.struct("case_id", "merged")
    walk = own.select(chain.alias("case_id"), "cell_id", "src", "dst")
    ends = degree(walk).filter("degree = 1").groupBy("case_id").agg(F.min("node_id").alias("node_id"))
    key = F.concat_ws("|", F.col("case_id.case_id").cast("string"), F.col("case_id.merged").cast("string"))
    level = bfs_levels(walk.select(key.alias("case_id"), "src", "dst"), ends.select(key.alias("case_id"), "node_id"))
    at = lambda k: level.select(F.col("case_id").alias("_k"), F.col("node_id").alias(k), F.col("level").alias(f"_{k}"))
    placed = own.withColumn("_k", F.concat_ws("|", F.col("case_id").cast("string"), F.col("merged").cast("string"))).join(at("src"), ["_k", "src"]).join(at("dst"), ["_k", "dst"])
    turn = placed.select("case_id", "cell_id", "merged", F.least("_src", "_dst").alias("_place"), (F.col("_src") > F.col("_dst")).alias("_back"))
    rows = points.join(turn, ["case_id", "cell_id"]).withColumn("_i", F.when(F.col("_back"), -F.col("point_idx")).otherwise(F.col("point_idx")))
    first = F.row_number().over(Window.partitionBy("case_id", "cell_id").orderBy("_i"))
    kept = rows.withColumn("_r", first).filter("_place = 0 or _r > 1")
    place = F.row_number().over(Window.partitionBy("case_id", "merged").orderBy("_place", "_i")) - 1
    out = kept.withColumn("point_idx", place).withColumn("cell_id", F.col("merged")).select(*points.columns)
    closed = points.join(turn.select("case_id", "cell_id"), ["case_id", "cell_id"], "left_anti")
    return out.unionByName(closed)


def contact_flags(nodes: DataFrame, edges: DataFrame, a: str, b: str, reference: str = "AA") -> DataFrame:
    """Whether class a begins at class b: of the nodes next to the origin of a (its node nearest to the reference class) one
    has an edge of class b that isn't artificial. edges: with class_name and artificial. Returns case_id, touches."""
    return contacts(nodes, edges, [(a, b)], reference).select("case_id", "touches")


def contacts(nodes: DataFrame, edges: DataFrame, pairs: list[tuple[str, str]], reference: str = "AA", begins: DataFrame | None = None) -> DataFrame:
    """contact_flags of several pairs of classes at once, whose origins are sought in one pass: case_id, a, b, touches. begins:
    the origins of the first classes, if they are known."""
    from tubula.operators.nearest import origins

    begins = origins(nodes, sorted({a for a, _ in pairs}), reference) if begins is None else begins
    wanted = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))).alias("p")
    two = both_ways(edges.select("case_id", "src", "dst", "class_name", "artificial"))
    first = begins.select("case_id", F.col("node_id").alias("src"), F.col("class_name").alias("a"))
    beside = two.join(spread(first), ["case_id", "src"]).select("case_id", "a", F.col("dst").alias("src")).distinct()
    hit = two.filter(~F.col("artificial")).join(spread(beside), ["case_id", "src"]).select("case_id", "a", F.col("class_name").alias("b")).distinct().withColumn("_t", F.lit(True))
    each = nodes.select("case_id").distinct().select("case_id", wanted).select("case_id", "p.a", "p.b")
    return each.join(spread(hit), ["case_id", "a", "b"], "left").select("case_id", "a", "b", F.coalesce("_t", F.lit(False)).alias("touches"))


def join_components(nodes: DataFrame, edges: DataFrame, parent: dict[str, str], main: Column, radius: float = 70.0) -> DataFrame:
    """Bridges (case_id, src, dst, distance) from components without a main node to the nearest node of
    the attached part: of the same class first, then of the parent class, then any, at most ``radius``
    apart. One set-based pass a round, until no further component joins; each component gets one bridge.
    Components that nothing joins have none (see ``attached_nodes``). A round meets only what the one before
    attached, as whatever lies near to earlier nodes has been joined. Nodes without
    coordinates join nothing; a missing class is like no other."""
    from tubula.operators.nearest import closest_pairs, spots

    whole = spread(nodes).join(spread(components(nodes, edges)), ["case_id", "node_id"]).withColumn("_main", main)
    label = cut_lineage(whole.select("case_id", "node_id", "component", *"xyz", "_main", F.coalesce("class_name", F.lit("")).alias("class_name")))
    fresh = label.filter("_main").select("case_id", "component").distinct()
    placed = label.dropna(subset=[*"xyz"]).drop("_main")
    outside = placed.join(spread(fresh), ["case_id", "component"], "left_anti")
    own, empty = F.col("class_name"), F.col("class_name") == ""
    ways = [(outside_key, inside_key) for outside_key, inside_key in (
        (F.when(~empty, own), F.when(~empty, own)),
        (F.try_element_at(F.create_map(*(F.lit(v) for kv in parent.items() for v in kv)), own), own) if parent else (None, None),
        (F.lit(""), F.lit("")),
    ) if outside_key is not None]
    bridges, old = None, []
    while True:
        inside = cut_lineage(placed.join(spread(fresh), ["case_id", "component"], "left_semi"))
        rest, found = outside, []
        for mine, theirs in ways:
            found.append(closest_pairs(spots(rest, mine, "component"), spots(inside, theirs), radius))
            rest = rest.join(spread(found[-1].select("case_id", "component")), ["case_id", "component"], "left_anti")
        new = cut_lineage(reduce(DataFrame.unionByName, found))
        discard(inside, *found)
        if not new.limit(1).count():
            discard(new, *old)
            break
        bridges = new if bridges is None else bridges.unionByName(new)
        fresh = new.select("case_id", "component")
        outside = cut_lineage(outside.join(spread(fresh), ["case_id", "component"], "left_anti"))
        discard(*old)
        old = [outside]
    discard(label)
    none = edges.filter(F.lit(False)).select("case_id", "src", "dst", F.lit(0.0).alias("distance"))
    return bridges.select("case_id", "src", "dst", "distance") if bridges is not None else none


def split_at_branches(points: DataFrame) -> DataFrame:
    """Adds piece: cells of a case that share their first points are cut where they part. A point's prefix
    is named by its index and two running sums of 64-bit hashes of all (index, point) up to it; a piece is a stretch shared by the same number of cells."""
    own = F.xxhash64("point_idx", *"xyz").cast("decimal(38,0)"), F.xxhash64(F.lit(1), "point_idx", *"xyz").cast("decimal(38,0)")
    prefix = F.struct("point_idx", *(F.sum(h).over(order().rowsBetween(Window.unboundedPreceding, 0)).alias(f"h{i}") for i, h in enumerate(own)))
    p = points.withColumn("_p", prefix)
    shared = p.groupBy("case_id", "_p").agg(F.count(F.lit(1)).alias("sharing"), F.min("cell_id").alias("owner"))
    j = p.join(shared, ["case_id", "_p"])
    change = F.coalesce(F.col("sharing") != F.lag("sharing").over(order()), F.lit(False)).cast("int")
    return j.withColumn("_c", change).withColumn("piece", F.sum("_c").over(order().rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_c")


def merge_degree_2(cells: DataFrame) -> DataFrame:
    """Pairs of cells that meet at an end no other cell touches: case_id, node, a, b. cells: case_id,
    cell_id, src, dst (any comparable ends)."""
    ends = cells.select("case_id", "cell_id", F.explode(F.array("src", "dst")).alias("node"))
    g = ends.groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("a"), F.max("cell_id").alias("b"))
    return g.filter("n = 2 and a <> b").select("case_id", "node", "a", "b")


def union_with_offsets(models: DataFrame) -> DataFrame:
    """Ids of branch tables (model, group_id, ...) made unique: each model's ids are shifted by the sum
    of the sizes of the id ranges before it."""
    sizes = models.groupBy("model").agg((F.max("group_id") + 1).alias("size"))
    offset = sizes.withColumn("offset", F.coalesce(F.sum("size").over(Window.orderBy("model").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return models.join(offset.select("model", "offset"), "model").withColumn("group_id", F.col("group_id") + F.col("offset")).drop("offset")


def segment_graph(order: DataFrame) -> DataFrame:
    """Edges between classes that follow each other in order: case_id, left, right."""
    w = Window.partitionBy("case_id").orderBy("place")
    return order.withColumn("right", F.lead("class_name").over(w)).filter("right is not null").select("case_id", F.col("class_name").alias("left"), "right")


def neighbour_mean(values: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """Mean of a feature over the linked ones: case_id, node_id, column. edges: case_id, src, dst."""
    two = both_ways(edges.select("case_id", "src", "dst")).distinct()
    v = values.select("case_id", F.col("node_id").alias("dst"), column)
    return two.join(v, ["case_id", "dst"]).groupBy("case_id", F.col("src").alias("node_id")).agg(F.avg(column).alias(column))


def concat_chain(parts: DataFrame) -> DataFrame:
    """One vessel after another: parts (case_id, part, node_id, hierarchy); levels go on after the highest
    one before, a node that two parts share stays with the first."""
    w = Window.partitionBy("case_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = parts.groupBy("case_id", "part").agg((F.max("hierarchy") + 1).alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(w), F.lit(0)))
    first = Window.partitionBy("case_id", "node_id").orderBy("part")
    j = parts.join(size.select("case_id", "part", "shift"), ["case_id", "part"]).withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    return j.select("case_id", "part", "node_id", (F.col("hierarchy") + F.col("shift")).alias("hierarchy"))


def split_at_peak(points: DataFrame, limit: float) -> DataFrame:
    """Adds half: cells longer than ``limit`` are cut at the widest point of the middle half (0 up to it, 1 after)."""
    from tubula.operators.polyline import arc_length

    w = Window.partitionBy(*KEYS)
    p = arc_length(points).withColumn("_len", F.max("arc").over(w))
    middle = (F.col("arc") >= F.col("_len") / 4) & (F.col("arc") <= 3 * F.col("_len") / 4)
    at = F.max(F.when(middle, F.struct(F.col("radius").alias("r"), (-F.col("point_idx")).alias("i")))).over(w)
    p = p.withColumn("_at", -at.getField("i"))
    return p.withColumn("half", F.when((F.col("_len") > limit) & (F.col("point_idx") > F.col("_at")), 1).otherwise(0)).drop("_len", "_at", "arc")
