"""Vessels and pathways: chains of one class or cell, named paths and the jobs made of them. Nodes have case_id,
node_id, class_name, x, y, z, radius and hierarchy; edges have case_id, src, dst, cell_id, class_name, length
and artificial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tubula.functions.geom import CLASSES, dist, project_2d, spherical, to_ijk, type_code, type_vector, vec
from tubula.functions.runtime import cut_lineage, discard, spread
from tubula.operators import graph as G
from tubula.operators import polyline as P
from tubula.operators import segments as S
from tubula.operators.around import FILLED, case_features
from tubula.operators.polyline import KEYS
from tubula.operators.trees import CASE_EDGES, walk_chains

#: Access, side and circulation of the eight catheter pathways, the classes in their order, those that count twice
#: and those that count against: fixed values.
PATHWAYS = [
    ("femoral right anterior", "AA BT RCCA RICA", "RCCA RICA", "RSA"),
    ("femoral right posterior", "AA BT RSA RVA BA", "RVA", "LVA"),
    ("femoral left anterior", "AA LCCA LICA", "LCCA LICA", ""),
    ("femoral left posterior", "AA LSA LVA BA", "LVA", "RVA"),
    ("radial right anterior", "RSA RCCA RICA", "RCCA RICA", "BT"),
    ("radial right posterior", "RSA RVA BA", "RVA", "LVA"),
    ("radial left anterior", "RSA BT LCCA LICA", "LCCA LICA", ""),
    ("radial left posterior", "RSA BT LSA LVA BA", "LVA", "RVA"),
]
#: Vessels that are made of others, one after the other: fixed values.
CHAINS = {"RCA": ["RCCA", "RICA"], "LCA": ["LCCA", "LICA"], "BT-RCA": ["BT", "RCCA", "RICA"], "BT-LCA": ["BT", "LCCA", "LICA"]}


def pathway_configs(spark: SparkSession) -> DataFrame:
    """The eight configurations with their wanted type vectors: config, wanted."""
    rows = spark.createDataFrame(PATHWAYS, "config string, classes string, high string, counter string")
    words = lambda c: F.split(c, " ")
    return rows.select("config", type_vector(words("classes"), words("high"), words("counter")).alias("wanted"))


def chain_order(edges: DataFrame) -> DataFrame:
    """Walk order of path graphs from the end with the smaller id: case_id, node_id, place."""
    ends = G.degree(edges).filter("degree = 1").groupBy("case_id").agg(F.min("node_id").alias("node_id"))
    return G.bfs_levels(edges, ends).select("case_id", "node_id", F.col("level").alias("place"))


def sort_components(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Components (labels: case_id, node_id, component) of each case by mean height, the largest one first:
    case_id, component, n, height, place."""
    g = nodes.join(labels, ["case_id", "node_id"]).groupBy("case_id", "component").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("height"))
    main = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n"), "component")) == 1
    ranked = g.withColumn("_main", main)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("_main"), "height", "component"))).drop("_main")


def path_table(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """What paths (case_id, leaf, path) run through: cells in order, their distinct types in order, the last
    type, whether an edge is artificial, the length inside the last cell, and the type vector."""
    w = Window.partitionBy("case_id", "leaf").orderBy("i")
    steps = paths.select("case_id", "leaf", F.posexplode("path").alias("i", "src")).withColumn("dst", F.lead("src").over(w)).filter("dst is not null")
    two = G.both_ways(edges.select("case_id", "src", "dst", "cell_id", "class_name", "length", "artificial"))
    own = steps.join(spread(two), ["case_id", "src", "dst"])
    g = own.groupBy("case_id", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("i", "cell_id", "class_name"))).alias("s"), F.bool_or("artificial").alias("artificial"),
        F.max_by("cell_id", "i").alias("_last"), F.max_by("class_name", "i").alias("last_type"),
    )
    last = own.join(spread(g.select("case_id", "leaf", F.col("_last").alias("cell_id"))), ["case_id", "leaf", "cell_id"]).groupBy("case_id", "leaf").agg(F.sum("length").alias("last_length"))
    new = lambda s, i: (i == 0) | (s["cell_id"] != F.col("s")[F.greatest(i - 1, F.lit(0))]["cell_id"])
    cells = F.transform(F.filter("s", new), lambda s: s["cell_id"])
    types = F.array_distinct(F.transform("s", lambda s: s["class_name"]))
    return g.join(spread(last), ["case_id", "leaf"]).select("case_id", "leaf", cells.alias("cells"), types.alias("types"), "last_type", "artificial", "last_length", type_vector(types).alias("vector"))


def all_pathways(nodes: DataFrame, edges: DataFrame, start: DataFrame, configs: DataFrame, reach: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """The best path of each case for each configuration (case_id, config, leaf, score), and its nodes with
    those of side branches up to ``reach`` (case_id, config, node_id, on_path). start: case_id, node_id."""
    paths = cut_lineage(G.root_to_leaf_paths(edges, start))
    best = cut_lineage(G.match_pathways(G.path_dedup(path_table(paths, edges)), configs))
    on = best.select("case_id", "config", "leaf").join(spread(paths), ["case_id", "leaf"]).select("case_id", "config", F.explode("path").alias("node_id"))
    return best, G.pathway_subgraph(nodes, edges, on, reach, ["config"])


def longest_chains(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """The chain with the most nodes of every component of edges (case_id, src, dst, length), by three walks: from any
    node to the farthest one, from there to the other end, and back. A node is on the chain if both distances add up
    to its length; where cycles leave a choice, the smallest node of each place counts. Returns case_id, component
    (its smallest node), node_id, place, n (nodes of the chain) and length. ``limit``: edges that one task walks."""
    edges = edges.select("case_id", F.col("src").cast("long"), F.col("dst").cast("long"), F.col("length").cast("double").alias("w"))
    return walk_chains(edges, _chains_of_large_cases, limit)


def _chains_of_large_cases(edges: DataFrame) -> DataFrame:
    """The same three walks as jobs."""
    edges = cut_lineage(edges)
    label = G.components(G.both_ways(edges).select("case_id", F.col("src").alias("node_id")).distinct(), edges, 0)
    label = cut_lineage(label.select(F.struct("case_id", "component").alias("case_id"), "node_id"))
    own = cut_lineage(edges.withColumn("_c", F.col("case_id")).join(label.select(F.col("case_id.case_id").alias("_c"), F.col("node_id").alias("src"), F.col("case_id").alias("_k")), ["_c", "src"]).select(F.col("_k").alias("case_id"), "src", "dst", "w"))
    farthest = lambda levels: cut_lineage(levels.groupBy("case_id").agg(F.max_by("node_id", F.struct("level", -F.col("node_id"))).alias("node_id")))
    first = farthest(G.bfs_levels(own, own.groupBy("case_id").agg(F.min(F.least("src", "dst")).alias("node_id"))))
    there = cut_lineage(G.bfs_levels(own, first, "w"))
    back = G.bfs_levels(own, farthest(there)).select("case_id", "node_id", F.col("level").alias("_back"))
    far = there.groupBy("case_id").agg(F.max("level").alias("_far"), F.max_by("acc", F.struct("level", -F.col("node_id"))).alias("_length"))
    on = there.join(back, ["case_id", "node_id"]).join(far, "case_id").filter(F.col("level") + F.col("_back") == F.col("_far"))
    chain = on.groupBy("case_id", F.col("level").alias("place")).agg(F.min("node_id").alias("node_id"), (F.first("_far") + 1).alias("n"), F.first("_length").alias("length"))
    return chain.select("case_id.case_id", "case_id.component", "node_id", "place", "n", "length")


#: Vessels that are chosen by the nearness of their ends to those of another one, which is chosen before: fixed values.
NEAREST_TO = [("RCCA", "BT"), ("RICA", "RCCA"), ("LICA", "LCCA")]
#: Length (mm) from which several candidates for LCCA are told apart by their width: fixed value.
LONG_LCCA = 50.0


def choose_candidates(candidates: DataFrame, least: int = 3, nearest: list[tuple[str, str]] = NEAREST_TO) -> DataFrame:
    """One candidate for each name of each case. candidates: case_id, name, component, n, length, radius (mean), a, b (ends:
    x, y, z). RCCA is the one whose ends come nearest to an end of BT, RICA and LICA to their side's CCA (most nodes on
    ties; without that vessel, or with fewer than ``least`` nodes in it, as any other). Of several LCCA longer than
    50 mm the widest one counts, otherwise the longest. Any other name takes the most nodes. Last ties go to the
    smallest component. Returns case_id, name, component; those of fewer than ``least`` nodes are left out."""
    each = Window.partitionBy("case_id", "name")
    lcca = F.when(F.count_if(F.col("length") > LONG_LCCA).over(each) > 1, F.when(F.col("length") > LONG_LCCA, F.col("radius")).otherwise(-1.0)).otherwise(F.col("length"))
    scored = candidates.withColumn("_score", F.when(F.col("name") == "LCCA", lcca).otherwise(F.col("n").cast("double")))
    best = lambda df, rank: df.groupBy("case_id", "name").agg(F.min_by("component", rank).alias("component"))
    chosen = best(scored, F.struct(-F.col("_score"), "component"))
    end = lambda c: tuple(F.col(f"{c}.{n}") for n in "xyz")
    for name, other in nearest:
        chosen = cut_lineage(chosen)
        ref = chosen.filter(F.col("name") == other).join(candidates.filter(F.col("n") >= least), ["case_id", "name", "component"]).select("case_id", F.col("a").alias("_a"), F.col("b").alias("_b"))
        gap = F.least(*(dist(end(p), end(q)) for p in ("a", "b") for q in ("_a", "_b")))
        near = best(candidates.filter(F.col("name") == name).join(ref, "case_id"), F.struct(gap, -F.col("n"), "component"))
        chosen = chosen.join(near.select("case_id", "name"), ["case_id", "name"], "left_anti").unionByName(near)
    return chosen.join(candidates.filter(F.col("n") >= least).select("case_id", "name", "component"), ["case_id", "name", "component"], "left_semi")


def single_vessel(nodes: DataFrame, edges: DataFrame, by: str = "class_name", least: int = 3) -> DataFrame:
    """One chain of nodes for each value of an edge column (class_name or cell_id) of each case. Every component of its
    edges is a candidate with its longest chain; ``choose_candidates`` takes one. The chain goes from its end nearest
    to the centre of the AA nodes, AA itself from its end nearest to the origin (smallest id on ties and without AA).
    Chains of fewer than ``least`` nodes are left out: case_id, the column, node_id, hierarchy (from 0)."""
    name = F.col(by).cast("string") if by != "class_name" else F.col(by)
    own = edges.filter(F.col(by).isNotNull()).select(F.struct("case_id", name.alias("name")).alias("case_id"), "src", "dst", "length")
    chains = cut_lineage(longest_chains(own).select("case_id.*", "component", "node_id", "place", "n", "length"))
    placed = cut_lineage(chains.join(nodes.select("case_id", "node_id", *"xyz", "radius"), ["case_id", "node_id"]))
    at = F.struct("node_id", *"xyz")
    ends = cut_lineage(placed.groupBy("case_id", "name", "component", "n", "length").agg(F.min_by(at, "place").alias("a"), F.max_by(at, "place").alias("b"), F.avg("radius").alias("radius")))
    chosen = choose_candidates(ends, least, NEAREST_TO if by == "class_name" else []).join(ends, ["case_id", "name", "component"])
    centre = nodes.filter("class_name = 'AA'").groupBy("case_id").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    is_aa = (F.col("name") == "AA") & F.lit(by == "class_name")
    goal = tuple(F.when(is_aa, 0.0).otherwise(F.col(f"m{c}")) for c in "xyz")
    away = lambda e: F.struct(F.coalesce(dist(tuple(F.col(f"{e}.{c}") for c in "xyz"), goal), F.lit(0.0)), F.col(f"{e}.node_id"))
    turned = chosen.join(centre, "case_id", "left").select("case_id", "name", "component", (away("b") < away("a")).alias("_turn"))
    place = F.when(F.col("_turn"), F.col("n") - 1 - F.col("place")).otherwise(F.col("place")).cast("int")
    return chains.join(turned, ["case_id", "name", "component"]).select("case_id", F.col("name").cast(edges.schema[by].dataType).alias(by), "node_id", place.alias("hierarchy"))


def chained_vessels(vessels: DataFrame, edges: DataFrame) -> DataFrame:
    """Vessels made of others (RCA, LCA, BT-RCA, BT-LCA) where all their parts are there, and, for BT with a left
    artery, where an edge joins the two: case_id, class_name, part, node_id, hierarchy. vessels: of single_vessel."""
    table = F.array(*(F.struct(F.lit(k).alias("chain"), F.lit(c).alias("class_name"), F.lit(i).alias("part"), F.lit(len(v)).alias("of")) for k, v in CHAINS.items() for i, c in enumerate(v)))
    own = vessels.withColumn("_t", F.explode(F.filter(table, lambda t: t["class_name"] == F.col("class_name")))).select("case_id", F.col("_t.chain").alias("class_name"), F.col("_t.part").alias("part"), F.col("_t.of").alias("of"), "node_id", "hierarchy")
    full = own.groupBy("case_id", "class_name", "of").agg(F.countDistinct("part").alias("n")).filter("n = of").select("case_id", "class_name")
    side = lambda c, end: vessels.filter(F.col("class_name") == c).select("case_id", F.col("node_id").alias(end))
    shared = side("BT", "src").join(side("LCCA", "dst"), ["case_id"]).filter("src = dst").select("case_id")
    touch = G.both_ways(edges.select("case_id", "src", "dst")).join(side("BT", "src"), ["case_id", "src"]).join(side("LCCA", "dst"), ["case_id", "dst"]).select("case_id").unionByName(shared).distinct()
    full = full.filter("class_name <> 'BT-LCA'").unionByName(full.filter("class_name = 'BT-LCA'").join(touch, "case_id", "left_semi"))
    own = own.join(full, ["case_id", "class_name"], "left_semi").withColumn("_c", F.col("case_id")).withColumn("case_id", F.struct("case_id", "class_name"))
    chained = G.concat_chain(own.select("case_id", "part", "node_id", "hierarchy"))
    return chained.select("case_id.case_id", "case_id.class_name", "part", "node_id", "hierarchy")


def vessel_points(vessels: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """Chains as ordered points: case_id, cell_id (the chain's name), point_idx, coordinates and what nodes have besides."""
    rest = [c for c in nodes.columns if c not in ("case_id", "node_id", "hierarchy", by)]
    return vessels.join(nodes.select("case_id", "node_id", *rest), ["case_id", "node_id"]).select("case_id", F.col(by).alias("cell_id"), F.col("hierarchy").alias("point_idx"), "node_id", *rest)


def _directed(points: DataFrame) -> DataFrame:
    """Adds polar and azimuth of the direction between the points up to two before and after each one."""
    at = F.struct(*"xyz")
    first, last = (F.coalesce(f(at, 2).over(P.order()), f(at, 1).over(P.order()), at) for f in (F.lag, F.lead))
    _, polar, azimuth = spherical(vec("_away"))
    return points.withColumns({f"_away{n}": last[n] - first[n] for n in "xyz"}).withColumns({"polar": polar, "azimuth": azimuth}).drop(*(f"_away{n}" for n in "xyz"))


def local_features(points: DataFrame, voxels: DataFrame | None = None) -> DataFrame:
    """Local features of ordered points: polar and azimuth of the local direction, local curvature and
    torsion, mean step, accumulated length, and the value of the voxel that holds the point (voxels: case_id,
    i, j, k, value). Artificial rows (a boolean column, if there) aren't neighbours of any; they come back
    with NULL features."""
    own = points.filter("not artificial") if "artificial" in points.columns else points
    done = P.local_curvature(P.mean_step(P.arc_length(_directed(own))))  # Python last: its rows lose their exchange
    done = done.select(*(c for c in done.columns if c != "mean_step"), "mean_step")
    done = done.withColumnsRenamed({"local_curvature": "curvature", "local_torsion": "torsion", "arc": "accumulated"})
    if voxels is not None:
        at = done.withColumns({i: F.col(n).cast("int") for i, n in zip("ijk", "xyz", strict=True)})
        done = at.join(voxels.select("case_id", *"ijk", "value"), ["case_id", *"ijk"], "left").drop(*"ijk")
    if "artificial" not in points.columns:
        return done
    return done.unionByName(points.filter("artificial"), allowMissingColumns=True)


def _neighbourhoods(keyed: DataFrame) -> DataFrame:
    """Adds _pts, the ordered neighbourhood of each node, and _at, the node's place in it. keyed: case_id, node_id, level,
    x, y, z, degree and the neighbours that count (array _near of structs node_id, level, x, y, z, degree, around: both at
    degree 2, else the first one upstream or the first one; around is what lies beyond, without the node itself, of many
    the two smallest nodes and the smallest ones upstream and downstream)."""
    up = lambda a, level: F.filter(a, lambda v: v["level"] < level)
    down = lambda a, level: F.filter(a, lambda v: v["level"] > level)
    point = lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"))
    one = lambda a: F.transform(F.slice(a, 1, 1), point)
    own = F.array(F.struct("x", "y", "z"))
    level, near = F.col("level"), F.col("_near")
    # degree 2: up to two nodes either way; the second one counts only where the first has degree 2, too
    beyond = lambda v, pick: F.when(v["degree"] == 2, one(pick(v["around"], v["level"]))).otherwise(F.array().cast("array<struct<x:double,y:double,z:double>>"))
    above = F.flatten(F.transform(F.reverse(up(near, level)), lambda v: F.concat(beyond(v, up), F.array(point(v)))))
    below = F.flatten(F.transform(down(near, level), lambda v: F.concat(F.array(point(v)), beyond(v, down))))
    middle = F.concat(above, own, below)
    # ends and branches: the node, the nearest node (upstream if there is one) and one more beyond it
    first = F.coalesce(F.get(up(near, level), F.lit(0)), F.get(near, F.lit(0)))
    upstream = first["level"] < level
    climbing = up(first["around"], first["level"])
    more = F.when(upstream, F.when(F.size(climbing) > 0, one(climbing)).otherwise(one(first["around"]))).otherwise(one(down(first["around"], first["level"])))
    short = F.concat(own, F.array(point(first)), more)
    end = F.when(upstream, F.reverse(short)).otherwise(short)
    df = keyed.withColumn("_pts", F.when(F.col("degree") == 2, middle).when(F.col("degree") == 1, end).when(F.col("degree") > 2, short))
    df = df.withColumn("_at", F.when(F.size("_pts") == 3, 1).otherwise(F.size(above)))
    return df.withColumn("_pts", F.when(F.size("_pts") >= 3, F.col("_pts"))).drop("_near")


def local_graph_features(nodes: DataFrame, edges: DataFrame, starts: DataFrame, voxels: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Local features of every node of a graph for several accesses at once. nodes: case_id, node_id, x, y, z and more that
    stays; edges: case_id, src, dst, artificial; starts: case_id, access (text without a colon), node_id, one start for
    each case and access. Returns nodes' columns, access, level, accumulated (length from the start, artificial edges
    included), mean_step, curvature, torsion, module, polar, azimuth and, with voxels (case_id, i, j, k, value), value
    (these replace columns of nodes that have their names);
    a row for each access and each node that its start leads to.

    Cases of at most ``limit`` edges (those that one task may hold, see ``trees``) take one exchange; of larger ones, accesses are walked
    in one pass, as cases of their own, and neighbourhoods come from joins. A node's neighbourhood leaves artificial edges out: an end
    and the next two nodes; up to two nodes either way of a node of degree 2 (the second only past a node of degree 2);
    a branch, its upstream node and one beyond (a branch without an upstream node: its smallest neighbour and one beyond).
    Ties go to the smallest node_id. What is undefined takes the value of the nearest node upstream that has one, at
    the start of the first node (by level, then node_id) that has one, else 0; a missing voxel isn't undefined."""
    kind = dict(nodes.dtypes)["case_id"]
    place = dist(tuple(F.col(f"a.{n}") for n in "xyz"), tuple(F.col(f"b.{n}") for n in "xyz"))
    at = spread(nodes.select("case_id", "node_id", *"xyz"))
    measured = cut_lineage(edges.filter("src <> dst").select("case_id", "src", "dst", F.coalesce("artificial", F.lit(False)).alias("artificial")).alias("e").join(at.alias("a"), (F.col("a.case_id") == F.col("e.case_id")) & (F.col("a.node_id") == F.col("e.src"))).join(at.alias("b"), (F.col("b.case_id") == F.col("e.case_id")) & (F.col("b.node_id") == F.col("e.dst"))).select("e.*", place.alias("length"), *(F.col(f"{end}.{n}").cast("double").alias(f"{end}{n}") for end in "ab" for n in "xyz")))
    begins = starts.select("case_id", "access", "node_id").dropDuplicates(["case_id", "access"])
    large = measured.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (CASE_EDGES if limit is None else limit)).select("case_id")
    large = cut_lineage(large) if large.limit(1).count() else None
    rows = measured.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")}).unionByName(begins.select("case_id", F.col("node_id").cast("long").alias("src"), "access"), allowMissingColumns=True)
    rows = rows if large is None else rows.join(large, "case_id", "left_anti")
    simple = measured.schema["case_id"].dataType.simpleString()
    df = rows.groupBy("case_id").applyInArrow(case_features, f"case_id {simple}, access string, node_id long, level int, accumulated double, {', '.join(f'{c} double' for c in FILLED)}")
    if large is not None:
        few = lambda t: t.join(large, "case_id", "left_semi")
        df = df.unionByName(_features_of_large_cases(at, few(measured), few(begins), kind))
    df = df.join(spread(nodes.drop("access", "level", "accumulated", "value" if voxels is not None else "access", *FILLED)), ["case_id", "node_id"])
    if voxels is not None:
        df = df.withColumns({i: F.col(n).cast("int") for i, n in zip("ijk", "xyz", strict=True)}).join(spread(voxels.select("case_id", *"ijk", "value")), ["case_id", *"ijk"], "left").drop(*"ijk")
    return df


def _features_of_large_cases(at: DataFrame, measured: DataFrame, begins: DataFrame, kind: str) -> DataFrame:
    """Local features by joins; ``at``: case_id, node_id, x, y, z."""
    key = F.concat("access", F.lit(":"), F.col("case_id").cast("string"))
    walked = measured.join(begins.select("case_id", "access"), "case_id").select(key.alias("case_id"), "src", "dst", "length", "artificial")
    levels = G.bfs_levels(walked, begins.select(key.alias("case_id"), "node_id"), "length").withColumnRenamed("acc", "accumulated")
    access = F.substring_index(F.col("_key"), ":", 1)
    case = F.expr("substring(_key, locate(':', _key) + 1)").cast(kind)
    placed = cut_lineage(levels.withColumnRenamed("case_id", "_key").withColumns({"case_id": case, "access": access}).join(at, ["case_id", "node_id"]))
    real = G.both_ways(walked.filter("not artificial").select(F.col("case_id").alias("_key"), "src", "dst")).distinct()
    # of what a node sees, however much: the two smallest nodes and the smallest ones of the lowest and of the highest level.
    # Neighbours are at most a level apart, so these are the smallest ones upstream and downstream, where there are any
    seen = real.join(spread(placed.select("_key", F.col("node_id").alias("dst"), F.struct("node_id", "level", *"xyz").alias("v"))), ["_key", "dst"])
    seen = seen.withColumn("_r", F.row_number().over(Window.partitionBy("_key", "src").orderBy("dst")))
    nth = lambda i: F.max(F.when(F.col("_r") == i, F.col("v")))
    low, high = F.min_by("v", F.struct("v.level", "v.node_id")), F.max_by("v", F.struct(F.col("v.level"), -F.col("v.node_id")))
    around = cut_lineage(seen.groupBy("_key", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), nth(1).alias("_first"), nth(2).alias("_second"), low.alias("_low"), high.alias("_high")))
    ends = placed.join(spread(around), ["_key", "node_id"], "left")
    upstream = F.when(F.col("_low.level") < F.col("level"), F.col("_low")).otherwise(F.col("_first"))
    # two hops: the one or two neighbours that count, with what they see but the node
    chosen = F.filter(F.when(F.col("degree") == 2, F.array("_first", "_second")).otherwise(F.array(upstream)), lambda v: v.isNotNull())
    picked = ends.select("_key", "node_id", F.explode(chosen).alias("v")).withColumn("_to", F.col("v.node_id"))
    picked = picked.join(spread(around.select("_key", F.col("node_id").alias("_to"), "degree", F.array("_first", "_second", "_low", "_high").alias("_around"))), ["_key", "_to"])
    beyond = F.array_sort(F.array_distinct(F.filter("_around", lambda v: v.isNotNull() & (v["node_id"] != F.col("node_id")))))
    near = F.struct("v.node_id", "v.level", "v.x", "v.y", "v.z", "degree", beyond.alias("around"))
    hop = picked.groupBy("_key", "node_id").agg(F.sort_array(F.collect_list(near)).alias("_near"))
    df = _neighbourhoods(ends.drop("_first", "_second", "_low", "_high").join(spread(hop), ["_key", "node_id"], "left"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_pts") - 1), lambda i: dist(tuple(F.col("_pts")[i - 1][n] for n in "xyz"), tuple(F.col("_pts")[i][n] for n in "xyz")))
    total = F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)
    module, polar, azimuth = spherical(tuple(F.element_at("_pts", -1)[n] - F.get("_pts", F.lit(0))[n] for n in "xyz"))
    df = df.withColumns({"mean_step": F.when(F.size("_pts") >= 3, total / (F.size("_pts") - 1)), "module": module, "polar": polar, "azimuth": azimuth}).withColumnRenamed("_key", "key")
    df = P.nested_gradients(df).withColumnsRenamed({"local_curvature": "curvature", "local_torsion": "torsion"})
    return _filled(df.select("key", "case_id", "access", "node_id", "level", "parent", "accumulated", *FILLED))


def _filled(df: DataFrame) -> DataFrame:
    """Undefined features by the nearest valid node upstream: each round doubles how far up a node has looked."""
    valid = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    df = cut_lineage(df.withColumns({c: valid(c) for c in FILLED}))
    first = df.groupBy("key").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("level", "node_id"))).alias(f"_{c}") for c in FILLED))
    df = df.join(first, "key").withColumns({c: F.when(F.col("parent").isNull(), F.coalesce(c, f"_{c}")).otherwise(F.col(c)) for c in FILLED}).drop(*(f"_{c}" for c in FILLED))
    df = cut_lineage(df.withColumn("_up", F.col("parent")))
    open_ = F.col("_up").isNotNull() & F.expr(" or ".join(f"{c} is null" for c in FILLED))
    while df.filter(open_).limit(1).count():
        above = df.select("key", F.col("node_id").alias("_up"), F.col("_up").alias("_next"), *(F.col(c).alias(f"_{c}") for c in FILLED))
        before, df = df, cut_lineage(df.join(spread(above), ["key", "_up"], "left").withColumns({c: F.coalesce(c, f"_{c}") for c in FILLED}).withColumn("_up", F.col("_next")).drop("_next", *(f"_{c}" for c in FILLED)))
        discard(before)
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in FILLED}).drop("_up", "key", "parent")


def features_of_chains(points: DataFrame, least: int = 3) -> DataFrame:
    """The 22 features of every chain of at least ``least`` points; the local features that they need are added where missing."""
    counted = points.withColumn("_n", F.count(F.lit(1)).over(P.whole())).filter(F.col("_n") >= least).drop("_n")
    counted = counted if "blanking" in counted.columns else counted.withColumn("blanking", F.lit(0))
    if "artificial" in counted.columns and "curvature" not in counted.columns:
        return S.segment_features(local_features(counted))
    return S.segment_features(counted if "curvature" in counted.columns else P.near_curvature(_directed(counted)))


def features_by_cell(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Segment features for every cell of the edges; cells of fewer than three nodes give none."""
    return features_of_chains(vessel_points(single_vessel(nodes, edges, "cell_id"), nodes, "cell_id"))


def features_by_vessel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Segment features for every vessel class and for the vessels chained of them; cell_id is the vessel's name."""
    one = cut_lineage(single_vessel(nodes, edges.filter("class_name <> 'other'")))
    return features_of_chains(vessel_points(one.unionByName(chained_vessels(one, edges).drop("part")), nodes, "class_name"))


def anatomy_row(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Arch type, bovine flag and ARSA flag: case_id, arch_type, bovine, arsa. Bovine: the LCCA's origin touches BT. ARSA: the
    RSA's origin touches AA, and its level is below that of the LSA's origin; without an LSA there is none."""
    from tubula.operators.nearest import origins

    begins = cut_lineage(origins(nodes, ["BT", "LCCA", "RSA", "LSA"], "AA"))
    touch = G.contacts(nodes, edges, [("LCCA", "BT"), ("RSA", "AA")], begins=begins)
    flag = lambda a, name: touch.filter(F.col("a") == a).select("case_id", F.col("touches").alias(name))
    at = spread(nodes.select("case_id", "node_id", "hierarchy")).join(spread(begins.select("case_id", "node_id", F.col("class_name").alias("_c"))), ["case_id", "node_id"])
    levels = at.groupBy("case_id").agg(*(F.max(F.when(F.col("_c") == c, F.col("hierarchy"))).alias(n) for c, n in (("RSA", "_r"), ("LSA", "_l"))))
    arch = S.arch_type(nodes, None if "blanking" in nodes.columns else begins)
    j = arch.join(flag("LCCA", "bovine"), "case_id").join(flag("RSA", "_touches"), "case_id").join(levels, "case_id", "left")
    return j.select("case_id", "arch_type", "bovine", (F.col("_touches") & F.coalesce(F.col("_r") < F.col("_l"), F.lit(False))).alias("arsa"))


def pathway_types(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct type names (without other), their codes and the vector with one slot for each class."""
    g = nodes.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("class_name") != "other", F.col("class_name")))).alias("types"))
    return g.select(*keys, "types", F.transform("types", type_code).alias("codes"), type_vector(F.col("types")).alias("vector"))


def global_row(points: DataFrame, side: Column) -> DataFrame:
    """Features of whole paths (ordered points with class_name), blanking cleared: keys, side (right 0, left 1),
    the seven global features, and the type vector."""
    f = features_of_chains(points.withColumn("blanking", F.lit(0)), 2)
    names = ["tortuosity", "length", "mean_diameter", "std_diameter", "min_polar", "polar", "azimuth"]
    return f.select(*KEYS, side.alias("side"), *names).join(pathway_types(points, KEYS).select(*KEYS, "vector"), KEYS)


def node_vector(points: DataFrame) -> DataFrame:
    """Dense vector of each node (25 slots): position, diameter, polar, azimuth, curvature, torsion, blanking, intensity (the
    column value of local_features, 0 without a volume), accumulated length and the class's slots; undefined values are 0."""
    intensity = F.col("value") if "value" in points.columns else F.lit(0.0)
    values = [*(F.col(n) for n in "xyz"), 2 * F.col("radius"), *(F.col(n) for n in ("polar", "azimuth", "curvature", "torsion", "blanking")), intensity, F.col("accumulated")]
    slots = type_vector(F.array("class_name"))
    return points.select(*KEYS, "point_idx", F.concat(F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values)), F.transform(slots, lambda v: v.cast("double"))).alias("vector"))


#: Segment features that the nodes of a segment graph leave out: fixed values.
NOT_IN_SEGMENTS = ("min_diameter", "max_diameter", "proximal_diameter", "distal_diameter", "min_max_ratio", "bending_length", "cumulative_curvature", "tortuosity_first_50", "polar_variation")


def segment_graph_features(points: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Chain of classes along each path (points with class_name and local features): segments (keys, class_name,
    place, features) and edges between those that follow each other (keys, left, right, pair features)."""
    path = F.struct(*KEYS)
    order = S.merge_small(S.class_order(points.select(path.alias("case_id"), "class_name", F.col("point_idx").alias("hierarchy"))), least)
    named = points.withColumn("_p", path).join(order.select(F.col("case_id").alias("_p"), "class_name", "merged"), ["_p", "class_name"])
    seg = named.select(F.col("_p").alias("case_id"), F.col("merged").alias("cell_id"), *(c for c in points.columns if c not in (*KEYS, "class_name")))
    seg = seg if "blanking" in seg.columns else seg.withColumn("blanking", F.lit(0))
    feats = S.segment_features(seg)
    places = order.filter("class_name = merged").select("case_id", F.col("class_name").alias("cell_id"), "place")
    kept = [c for c in feats.columns if c not in NOT_IN_SEGMENTS and c not in KEYS]
    nodes = feats.join(places, KEYS).select("case_id.*", F.col("cell_id").alias("class_name"), "place", *kept)
    pairs = G.segment_graph(places.withColumnRenamed("cell_id", "class_name"))
    inner = F.lag("point_idx").over(P.order()).isNotNull() & F.lead("point_idx").over(P.order()).isNotNull()
    both = S.pair_features(seg.withColumn("inner", inner).select(*KEYS, "point_idx", "polar", "azimuth", "inner"), pairs)
    return nodes, pairs.join(both, ["case_id", "left", "right"], "left").select("case_id.*", "left", "right", "angle", "azimuth_difference", "polar_difference")


def access_rows(points: DataFrame, side: Column, least: int = 10, voxels: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows for access models of paths (ordered points with class_name): global rows, segments, segment edges
    and dense node vectors. Paths of fewer than ``least`` points or without a segment edge are left out. voxels: volume
    that intensities are read from (see local_features)."""
    full = points.withColumn("blanking", F.lit(0)).withColumn("_n", F.count(F.lit(1)).over(P.whole())).filter(F.col("_n") >= least).drop("_n")
    local = cut_lineage(local_features(full, voxels))
    segments, edges = segment_graph_features(local)
    good = edges.select(*KEYS).distinct()
    keep = lambda df: df.join(good, KEYS, "left_semi")
    return keep(global_row(local, side)), keep(segments), edges, keep(node_vector(local))


def path_features(points: DataFrame, images: DataFrame, step: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Named paths (points; images: case_id, corner_x.., size_x..): the order is reversed, points are shifted by
    the image's corner, paths that leave the image are dropped, the rest is resampled. Returns its local
    features and its segment features without blanking. Neither is stored, and what resampling makes stays in the task that
    makes it: only the pieces of splines are dealt out, which are no more than the points."""
    last = F.max("point_idx").over(P.whole())
    moved = points.withColumn("point_idx", last - F.col("point_idx")).join(images, "case_id").withColumns({n: F.col(n) - F.col(f"corner_{n}") for n in "xyz"})
    ok = F.lit(True)
    for n in "xyz":
        ok = ok & F.col(n).between(0, F.col(f"size_{n}"))
    inside = moved.withColumn("_in", F.every(ok).over(P.whole())).filter("_in").select(*KEYS, "point_idx", *"xyz", "radius")
    rows = P.grid_points(P.spline_pieces(inside, step).repartition(*KEYS))
    return local_features(rows), features_of_chains(rows)


def section_radii(points: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds radius_ce (of the circle of the section's area), radius_cc (of the smallest circle around it) and ovality
    (radius / radius_cc, 1 where that is 0) to points with tangents. sections: keys, point_idx, idx and x, y, z of the ring of
    each point, seen in the plane across the tangent. Points without a ring take their own radius for both."""
    at = [*KEYS, "point_idx"]
    centre = points.select(*at, *(F.col(n).alias(f"_{n}") for n in "xyz"), *(F.col(f"t{n}") for n in "xyz"))
    u, v = project_2d(vec(), vec("_"), vec("t"))
    ring = cut_lineage(sections.select(*at, "idx", *"xyz").dropna().join(centre, at).select(*at, "idx", u.alias("u"), v.alias("v")))
    area = S.polygon_area(ring, at).select(*at, F.col("radius").alias("radius_ce"))
    around = S.enclosing_circle(ring, at, tolerance=1e-9).select(*at, F.col("radius").alias("radius_cc"))
    j = points.join(area, at, "left").join(around, at, "left").withColumns({n: F.coalesce(n, "radius") for n in ("radius_ce", "radius_cc")})
    return j.withColumn("ovality", S.ovality(F.col("radius"), F.col("radius_cc")))


def path_geometry(points: DataFrame, window: int = 50, height: float = 0.03, width: float = 10, sections: DataFrame | None = None) -> DataFrame:
    """Curvature, torsion, distance along the line, smoothed curvature, turning angles and curve ids for each point; with
    sections (see section_radii) the radii of these first."""
    lines = P.tangents(P.arc_length(points))
    lines = lines if sections is None else section_radii(cut_lineage(lines), sections)
    framed = P.curve_torsion(P.transported_frames(P.turn_angle(P.curve_curvature(lines))))
    smooth = P.savgol_smooth(framed, "curvature", "smooth_curvature", window)
    return P.curve_ids(cut_lineage(smooth), "smooth_curvature", height, width)


def carotid_profile(points: DataFrame, landmarks: DataFrame, label: str = "class_name", part: str = "ICA", width: float = 25.0, skull: DataFrame | None = None) -> DataFrame:
    """Profile of carotid lines: the centre is the point nearest to the case's landmark (case_id, x, y, z), or
    the label's transition where there is none; radii outside a span around it are interpolated through it,
    and the bulb is where the radius exceeds that. Adds arc, centre, inside, fit, residual and bulb; lines
    without a centre or with fewer than four rows outside the span keep 0. With a skull mask, skull_transition's columns
    come on top."""
    p = P.arc_length(points)
    near = P.nearest_index(p, landmarks.withColumn("label", F.lit("m"))).select(*KEYS, F.col("point_idx").alias("_l"))
    turn = P.label_transition(p, label, part, strict=False).select(*KEYS, F.col("point_idx").alias("_t"))
    at = p.join(near, KEYS, "left").join(turn, KEYS, "left").filter(F.col("point_idx") == F.coalesce("_l", "_t")).select(*KEYS, F.col("arc").alias("centre"))
    spanned = P.span_mask(p, at, width)
    enough = F.col("centre").isNotNull() & (F.count_if(~F.col("inside")).over(P.whole()) >= 4)
    usable = spanned.withColumn("_ok", enough)
    fitted = P.pchip(usable.filter("_ok"), "arc", "radius", ~F.col("inside"), "fit").withColumn("residual", F.col("radius") - F.col("fit"))
    done = P.bulb_mask(fitted, "residual", "inside")
    rest = usable.filter("not _ok").withColumns({"fit": F.lit(0.0), "residual": F.lit(0.0), "bulb": F.lit(False)})
    out = done.unionByName(rest).drop("_ok")
    return out if skull is None else skull_transition(cut_lineage(out), skull)


def skull_transition(points: DataFrame, mask: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Distance from each point to the mask (case_id, x, y, z), smoothed, and after: 1 beyond the first local
    minimum. Adds distance, smooth and after; lines without a minimum have 0 throughout."""
    from tubula.operators.nearest import distance_to_mask

    key = points.withColumn("_id", F.struct("cell_id", "point_idx"))
    away = cut_lineage(distance_to_mask(key, mask, "_id").select("case_id", "_id.cell_id", "_id.point_idx", "distance"))
    smooth = P.gaussian_smooth(points.join(away, [*KEYS, "point_idx"]), "distance", "smooth", sigma)
    return P.flag_after(smooth, P.first_local_minimum(smooth, "smooth"))


def transition_points(flagged: DataFrame, images: DataFrame) -> DataFrame:
    """Where each line of skull_transition passes into the skull: keys, point_idx, x, y, z, and the voxel i, j, k of the image
    (case_id, affine of 16 values) nearest to that. Lines without a transition have no row."""
    at = P.first_local_minimum(flagged, "smooth").select(*KEYS, "point_idx")
    j = flagged.select(*KEYS, "point_idx", *"xyz").join(at, [*KEYS, "point_idx"]).join(images.select("case_id", "affine"), "case_id")
    return j.select(*KEYS, "point_idx", *"xyz", *(c.alias(n) for n, c in zip("ijk", to_ijk(vec(), F.col("affine"), "round"), strict=True)))
