"""Nearest-neighbour and radius joins on points (case_id, ..., x, y, z). Points go into cubes as wide as
the search radius, and only the 27 cubes around a point are met, so no join compares all pairs."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubula.functions.geom import dist, vec
from tubula.functions.runtime import cut_lineage, discard, spread
from tubula.operators.components import star_components

#: Pairs of nodes that closest_pairs compares rather than halve their cubes again, and halvings at most.
MET_PAIRS = 4_000_000
HALVINGS = 24


def cube(c: Column, size: float) -> Column:
    return F.floor(c / size)


def _around(df: DataFrame, size: float) -> DataFrame:
    """Each row once for each of the 27 cubes around it."""
    shifts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    return df.withColumn("_s", shifts).withColumns({f"_c{n}": cube(F.col(n), size) + F.col(f"_s.{m}") for n, m in zip("xyz", "ijk", strict=True)}).drop("_s")


def _touched(df: DataFrame, radius: float, size: float) -> DataFrame:
    """Each row once for each cube of width ``size`` that the ball around it touches."""
    for n in "xyz":
        reach = F.lit(radius * (1 + 1e-9)) + F.abs(F.col(n)) * 1e-15
        df = df.withColumn(f"_c{n}", F.explode(F.sequence(cube(F.col(n) - reach, size), cube(F.col(n) + reach, size))))
    return df


def within(a: DataFrame, b: DataFrame, radius: float, wide: int | None = None) -> DataFrame:
    """Pairs of rows of a and b of one case at most ``radius`` apart: case_id, struct columns a and b, distance. ``wide``: cubes
    as many times as wide as the radius; a row of a then goes to the cubes that its ball touches, to 1.4 of them for 16
    instead of 27, which pays where few points lie within a cube."""
    size = radius * (wide or 1)
    left = (_touched(a, radius, size) if wide else _around(a, radius)).select("case_id", "_cx", "_cy", "_cz", F.struct(*(c for c in a.columns if c != "case_id")).alias("a"))
    right = b.withColumns({f"_c{n}": cube(F.col(n), size) for n in "xyz"}).select("case_id", "_cx", "_cy", "_cz", F.struct(*(c for c in b.columns if c != "case_id")).alias("b"))
    gap = dist(*(tuple(F.col(f"{s}.{n}") for n in "xyz") for s in "ab"))
    return left.join(right, ["case_id", "_cx", "_cy", "_cz"]).withColumn("distance", gap).filter(F.col("distance") <= radius).drop("_cx", "_cy", "_cz")


def nearest_in_set(a: DataFrame, b: DataFrame, key: str, other: str, radius: float, growth: float = 4.0) -> DataFrame:
    """For each row of a (case_id, key, x, y, z) the nearest row of b of its case (the smallest ``other``
    on ties): case_id, key, other, distance. Rows that find nothing within the radius try again with
    one ``growth`` times as wide, until all have one; rows of cases without b, and rows without
    coordinates, are left out."""
    a, b = a.dropna(subset=[*"xyz"]), b.dropna(subset=[*"xyz"])
    rest, found = a.join(b.select("case_id").distinct(), "case_id", "left_semi"), []
    a, b = a.select("case_id", key, *"xyz"), b.select("case_id", other, *"xyz")
    rest = rest.select("case_id", key, *"xyz")
    while True:
        hit = within(rest, b, radius).groupBy("case_id", F.col(f"a.{key}").alias(key)).agg(F.min(F.struct(F.col("distance"), F.col(f"b.{other}").alias(other))).alias("m"))
        found.append(cut_lineage(hit.select("case_id", key, f"m.{other}", "m.distance")))
        rest = cut_lineage(rest.join(found[-1].select("case_id", key), ["case_id", key], "left_anti"))
        if not rest.limit(1).count():
            break
        radius *= growth
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def radius_graph(nodes: DataFrame, key: str, radius: float, k: int | None = None, loops: bool = False) -> DataFrame:
    """Edges (case_id, src, dst, distance) from each node to those within the radius, at most the k nearest (the smallest
    ``dst`` on ties). With k, nodes begin with a radius in which they have about k others, and only those that find fewer
    try again with twice that, up to the radius: what is compared grows with the nodes, however many lie within it."""
    if k is not None:
        return _nearest_few(nodes.select("case_id", key, *"xyz"), key, radius, k, loops)
    e = within(nodes.select("case_id", key, *"xyz"), nodes.select("case_id", key, *"xyz"), radius).select("case_id", F.col(f"a.{key}").alias("src"), F.col(f"b.{key}").alias("dst"), "distance")
    return e if loops else e.filter("src <> dst")


#: Times that a radius may be halved before the first round of the nearest few.
FINEST = 16


def _first_radius(own: DataFrame, radius: float, few: int) -> float:
    """The largest of radius, radius / 2, ... in whose cubes a place meets no more than ``few`` others on average."""
    level = F.explode(F.sequence(F.lit(0), F.lit(FINEST)))
    cubes = own.withColumn("_l", level).groupBy("case_id", "_l", *(F.floor(F.col(n) / radius * F.pow(F.lit(2.0), "_l")).alias(f"_c{n}") for n in "xyz")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    met = cubes.groupBy("_l").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("met"))
    found = met.agg(F.min(F.when(F.col("met") <= few, F.col("_l"))).alias("l"), F.count(F.lit(1)).alias("n")).first()
    return radius / 2 ** (FINEST if found["l"] is None and found["n"] else found["l"] or 0)


def _nearest_few(nodes: DataFrame, key: str, radius: float, k: int, loops: bool) -> DataFrame:
    """Nodes at one place see the same: a place has its smallest keys, as many as a node can need, and looks once for all."""
    need = k if loops else k + 1  # a node finds itself, too
    nodes = nodes.dropna(subset=[*"xyz"])
    at = Window.partitionBy("case_id", *"xyz")
    members = cut_lineage(nodes.withColumns({"spot": F.min(key).over(at), "_k": F.row_number().over(at.orderBy(key))}))
    own = cut_lineage(members.filter(F.col("_k") <= need).groupBy("case_id", "spot").agg(*(F.min(n).alias(n) for n in "xyz"), F.sort_array(F.collect_list(key)).alias("keys")))
    reach, rest, found = _first_radius(own, radius, need), own.select("case_id", "spot", *"xyz"), []
    best = Window.partitionBy("case_id", "spot").orderBy("distance", "dst")
    while True:
        reach = min(reach, radius)
        pairs = within(rest, own.select("case_id", "keys", *"xyz"), reach).select("case_id", "a.spot", "distance", F.explode("b.keys").alias("dst"))
        few = pairs.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= need)
        hit = cut_lineage(few.groupBy("case_id", "spot").agg(F.sort_array(F.collect_list(F.struct("distance", "dst"))).alias("near")))
        done = F.size("near") >= need if reach < radius else F.lit(True)
        found.append(hit.filter(done).select("case_id", "spot", "near"))
        left = hit.filter(~done).select("case_id", "spot")
        if reach == radius or not left.limit(1).count():
            break
        rest, reach = cut_lineage(own.select("case_id", "spot", *"xyz").join(left, ["case_id", "spot"], "left_semi")), 2 * reach
    others = F.col("near") if loops else F.filter("near", lambda e: e["dst"] != F.col(key))
    rows = members.select("case_id", key, "spot").join(spread(reduce(DataFrame.unionByName, found)), ["case_id", "spot"])
    return rows.select("case_id", F.col(key).alias("src"), F.explode(F.slice(others, 1, k)).alias("e")).select("case_id", "src", "e.dst", "e.distance")


def nearest_attribute(points: DataFrame, reference: DataFrame, key: str, other: str, attribute: str, radius: float) -> DataFrame:
    """Copy an attribute from the nearest point of another set."""
    near = nearest_in_set(points, reference, key, other, radius)
    return near.join(reference.select("case_id", other, attribute), ["case_id", other]).select("case_id", key, attribute, "distance")


def consolidate(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Each point to the smallest key within the radius, as its highest neighbour sees it: case_id, key, target."""
    pairs = within(points.select("case_id", key, *"xyz"), points.select("case_id", key, *"xyz"), radius).select("case_id", F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j"))
    low = pairs.groupBy("case_id", "i").agg(F.min("j").alias("target"))
    return pairs.join(low, ["case_id", "i"]).groupBy("case_id", F.col("j").alias(key)).agg(F.max_by("target", "i").alias("target"))


def cluster_points(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Components of the graph of points within the radius, and their mean positions: case_id, cluster, n, x, y, z."""
    e = radius_graph(points, key, radius)
    c = star_components(e.select("case_id", "src", "dst"), ["case_id"])
    own = points.join(c.select("case_id", F.col("node").alias(key), "component"), ["case_id", key], "left").withColumn("cluster", F.coalesce("component", key))
    return own.groupBy("case_id", "cluster").agg(F.count(F.lit(1)).alias("n"), *(F.avg(n).alias(n) for n in "xyz"))


def contract(points: DataFrame, key: str, eps: float) -> DataFrame:
    """Points within eps of each other, also through others, become one: case_id, key, node (the smallest key). Points at
    the same place are one before any are compared; each place goes to the few cubes, 16 times as wide as eps, that it touches."""
    placed = reduce(lambda p, q: p & q, (F.col(n).isNotNull() & ~F.isnan(n) for n in "xyz"))
    same = Window.partitionBy("case_id", *(F.when(placed, F.col(n)) for n in "xyz"), F.when(~placed, F.col(key)))
    spots = cut_lineage(points.select("case_id", key, *"xyz", F.min(key).over(same).alias("spot"), placed.alias("placed")))
    own = spots.filter((F.col(key) == F.col("spot")) & F.col("placed")).select("case_id", key, *"xyz")
    near = within(own, own, eps, 16).select("case_id", F.col(f"a.{key}").alias("src"), F.col(f"b.{key}").alias("dst")).filter("src < dst")
    c = star_components(near, ["case_id"]).select("case_id", F.col("node").alias("spot"), "component")
    return spots.join(spread(c), ["case_id", "spot"], "left").select("case_id", key, F.coalesce("component", "spot").alias("node"))


def spots(df: DataFrame, key: Column, *more: str) -> DataFrame:
    """The places of nodes that have a key, each with its smallest node."""
    return df.withColumn("key", key).filter(F.col("key").isNotNull()).groupBy("case_id", *more, "key", *"xyz").agg(F.min("node_id").alias("node"))


def closest_pairs(outside: DataFrame, inside: DataFrame, radius: float) -> DataFrame:
    """The closest pair of each component (case_id, component, src, dst, distance, and x, y, z of src; smallest src, then dst on ties) at most ``radius`` apart. outside (case_id,
    component, key, x, y, z, node) meets inside (the same without component) of its key. Pairs of cubes, at first as wide as the
    radius, go on to halves of these if their bounds come within the radius and no farther than what another pair of the component is
    sure to hold, until few pairs of nodes are left in them: a component that fills space keeps a few pairs a cube."""
    shifts = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("xyz", s, strict=True))) for s in itertools.product((-1, 0, 1), repeat=3)))
    outside, inside = cut_lineage(outside), cut_lineage(inside)
    sides = [(outside, ["case_id", "component", "key"], "a"), (inside, ["case_id", "key"], "b")]

    def boxes(df: DataFrame, keys: list[str], s: str, halved: int) -> DataFrame:
        width = radius * (1 + 1e-9) / 2**halved
        at = F.struct(*(cube(F.col(n), width).alias(n) for n in "xyz")).alias(s)
        bounds = (f(n).alias(f"{s}{e}_{n}") for n in "xyz" for f, e in ((F.min, "low"), (F.max, "high")))
        return df.groupBy(*keys, at).agg(*bounds, F.count(F.lit(1)).alias(f"{s}_n"))

    nearest = sum((F.pow(F.greatest(F.col(f"alow_{n}") - F.col(f"bhigh_{n}"), F.col(f"blow_{n}") - F.col(f"ahigh_{n}"), F.lit(0.0)), 2) for n in "xyz"), F.lit(0.0))
    farthest = sum((F.pow(F.greatest(F.col(f"ahigh_{n}") - F.col(f"blow_{n}"), F.col(f"bhigh_{n}") - F.col(f"alow_{n}")), 2) for n in "xyz"), F.lit(0.0))
    slack, of = 1e-9 * radius * radius, ["case_id", "component"]
    pairs = None
    for halved in range(HALVINGS + 1):
        a, b = (boxes(*side, halved) for side in sides)
        if pairs is None:
            joined = a.withColumn("_s", F.explode(shifts)).withColumn("b", F.struct(*((F.col(f"a.{n}") + F.col(f"_s.{n}")).alias(n) for n in "xyz"))).join(spread(b), ["case_id", "key", "b"])
        else:
            up = lambda s: F.struct(*(F.call_function("shiftright", F.col(f"{s}.{n}"), F.lit(1)).alias(n) for n in "xyz"))
            a, b = (df.withColumn(f"_{s}", up(s)) for df, s in ((a, "a"), (b, "b")))
            parents = pairs.select(*of, "key", F.col("a").alias("_a"), F.col("b").alias("_b"))
            joined = parents.join(spread(a), [*of, "key", "_a"]).join(spread(b), ["case_id", "key", "_b"])
        met = joined.select(*of, "key", "a", "b", "a_n", "b_n", (nearest - slack).alias("nearest"), (farthest + slack).alias("farthest")).filter(F.col("nearest") <= radius * radius)
        met = cut_lineage(met)
        discard(pairs)
        pairs = met
        size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("a_n") * F.col("b_n")), F.lit(0))).first()
        if size(met)[1] <= MET_PAIRS:
            break
        sure = met.filter(F.col("farthest") <= radius * radius).groupBy(*of).agg(F.min("farthest").alias("sure"))
        pairs = cut_lineage(met.join(spread(sure), of, "left").filter(F.col("sure").isNull() | (F.col("nearest") <= F.col("sure"))).drop("nearest", "farthest", "sure"))
        discard(met)
        boxed, few = size(pairs)
        if few <= 4 * boxed:
            break
    width = radius * (1 + 1e-9) / 2**halved
    mine, theirs = (df.select(*keys, F.struct(*(cube(F.col(n), width).alias(n) for n in "xyz")).alias(s), *(F.col(n).alias(f"{p}{n}") for n in "xyz"), F.col("node").alias(end)) for (df, keys, s), p, end in zip(sides, ("", "m_"), ("src", "dst"), strict=True))
    gap = pairs.select(*of, "key", "a", "b").join(spread(mine), [*of, "key", "a"]).join(spread(theirs), ["case_id", "key", "b"]).withColumn("distance", dist(vec(), vec("m_"))).filter(F.col("distance") <= radius)
    best = cut_lineage(gap.groupBy(*of).agg(F.min(F.struct("distance", "src", "dst", *"xyz")).alias("m")).select(*of, "m.src", "m.dst", "m.distance", *(f"m.{n}" for n in "xyz")))
    discard(outside, inside, pairs)
    return best


def nearest_to_classes(nodes: DataFrame, names: list[str], reference: str, radius: float = 16.0) -> DataFrame:
    """The node of each named class that is nearest to any node of another class: case_id, class_name, node_id, x, y, z,
    distance (smallest id on ties). Classes that find nothing within the radius try again with one four times as wide."""
    none = nodes.dropna(subset=[*"xyz"])
    near = cut_lineage(spots(none.filter(F.col("class_name") == reference), F.lit("")))
    rest = spots(none.filter(F.col("class_name").isin(names)).withColumnRenamed("class_name", "component"), F.lit(""), "component")
    rest, found = cut_lineage(rest.join(spread(near.select("case_id").distinct()), "case_id", "left_semi")), []
    while rest.limit(1).count():
        found.append(closest_pairs(rest, near, radius))
        before, rest = rest, cut_lineage(rest.join(spread(found[-1].select("case_id", "component")), ["case_id", "component"], "left_anti"))
        discard(before)
        radius *= 4
    found = found or [closest_pairs(rest, near, radius)]
    return reduce(DataFrame.unionByName, found).select("case_id", F.col("component").alias("class_name"), F.col("src").alias("node_id"), *"xyz", "distance")


def nearest_to_class(nodes: DataFrame, name: str, reference: str, radius: float = 16.0) -> DataFrame:
    """The node of one class that is nearest to any node of another: case_id, node_id, x, y, z, distance."""
    return nearest_to_classes(nodes, [name], reference, radius).drop("class_name")


def origins(nodes: DataFrame, names: list[str], reference: str, most: float = 100.0) -> DataFrame:
    """Where classes begin: their nodes nearest to any of the reference class, less than ``most`` away (smallest id on ties):
    case_id, class_name, node_id, x, y, z, distance."""
    return nearest_to_classes(nodes, names, reference).filter(F.col("distance") < most)


def origin(nodes: DataFrame, name: str, reference: str, most: float = 100.0) -> DataFrame:
    """Where a class begins (see origins)."""
    return origins(nodes, [name], reference, most).drop("class_name")


def snap_landmarks(landmarks: DataFrame, line: DataFrame, branches: DataFrame, radius: float, wide: list[str] = (), factor: float = 1.5) -> DataFrame:
    """Each landmark (case_id, label, x, y, z) to the nearest branch point within the radius (times
    ``factor`` for the labels in ``wide``), else to the nearest line point within it, else unchanged:
    case_id, label, x, y, z, how. line and branches: case_id, point_id, x, y, z."""
    limit = F.when(F.col("a.label").isin(*wide), radius * factor).otherwise(radius) if wide else F.lit(radius)
    branch = within(landmarks, branches, radius * factor).filter(F.col("distance") <= limit)
    best = lambda d, s: d.groupBy("case_id", F.col("a.label").alias("label")).agg(F.min_by(F.struct(*(F.col(f"b.{n}").alias(n) for n in "xyz")), F.struct("distance", "b.point_id")).alias(s))
    j = landmarks.join(best(branch, "branch"), ["case_id", "label"], "left").join(best(within(landmarks, line, radius), "line"), ["case_id", "label"], "left")
    how = F.when(F.col("branch").isNotNull(), "branch").when(F.col("line").isNotNull(), "line").otherwise("none")
    return j.select("case_id", "label", *(F.coalesce(f"branch.{n}", f"line.{n}", n).alias(n) for n in "xyz"), how.alias("how"))


def distance_to_mask(points: DataFrame, mask: DataFrame, key: str, most: float | None = 50.0) -> DataFrame:
    """Distance from each point to the nearest mask point (case_id, x, y, z), at most ``most``; cubes of a
    quarter of it are tried first, and points without a hit take the full radius. Without ``most`` the distance is exact however
    far the mask is, by a search that widens; it is NULL where the case has no mask."""
    p = points.select("case_id", key, *"xyz")
    if most is None:
        far = nearest_in_set(p, mask.select("case_id", *"xyz").withColumn("_one", F.lit(1)), key, "_one", 12.5)
        return p.select("case_id", key).join(far.select("case_id", key, "distance"), ["case_id", key], "left")
    m = mask.select("case_id", *"xyz").withColumn("_one", F.lit(1))
    low = lambda r, d: within(r, m, d).groupBy("case_id", F.col(f"a.{key}").alias(key)).agg(F.min("distance").alias("distance"))
    near = cut_lineage(low(p, most / 4))
    far = low(p.join(near, ["case_id", key], "left_anti"), most)
    return p.select("case_id", key).join(near.unionByName(far), ["case_id", key], "left").select("case_id", key, F.coalesce("distance", F.lit(most)).alias("distance"))


def sample_volume(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """Value of the voxel that holds each point (indices i, j, k of the point, NULL outside): adds value."""
    return points.join(voxels.select("case_id", "i", "j", "k", "value"), ["case_id", "i", "j", "k"], "left")
