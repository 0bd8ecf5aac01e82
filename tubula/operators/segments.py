"""Aggregates over the points or nodes of a segment: length, diameters, ends, tortuosity, curvature
sums, feature rows. Keys default to (case_id, cell_id); blanked rows (blanking >= 0.5) are left out
where a segment has others. Undefined values are NULL."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubula.functions.cells import by_size, in_groups, numbers, padded
from tubula.functions.geom import clamp, direction_angles, dist, dot, norm, sub, unit, vec
from tubula.functions.runtime import spread
from tubula.operators.polyline import KEYS, order, arc_length



def _open() -> Column:
    return F.col("blanking") < 0.5


def unblanked(agg, value: Column) -> Column:
    """The aggregate over rows that aren't blanked, or over all rows if there are none."""
    return F.coalesce(agg(F.when(_open(), value)), agg(value))


def segment_length(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sum of the step lengths."""
    return arc_length(points).groupBy(*keys).agg(F.max("arc").alias("length"))


def diameter_stats(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean, population deviation, smallest and largest diameter, and the ratio of the last two."""
    d = 2 * F.col("radius")
    out = points.groupBy(*keys).agg(unblanked(F.avg, d).alias("mean_diameter"), unblanked(F.stddev_pop, d).alias("std_diameter"), unblanked(F.min, d).alias("min_diameter"), unblanked(F.max, d).alias("max_diameter"))
    return out.withColumn("min_max_ratio", F.try_divide("min_diameter", "max_diameter"))


def end_nodes(points: DataFrame, level: str = "point_idx", keys: list[str] = KEYS, blanked: bool = True) -> DataFrame:
    """Proximal = first of the lowest level, distal = last of the highest level, among rows that aren't
    blanked (all rows if there are none): struct columns proximal and distal."""
    row = F.struct(F.col(level).alias("level"), "point_idx", *"xyz", "radius")
    low = F.struct(F.col(level).alias("level"), F.col("point_idx"))
    pick = lambda f: F.coalesce(f(row, F.when(_open(), low)), f(row, low)) if blanked else f(row, low)
    return points.groupBy(*keys).agg(pick(F.min_by).alias("proximal"), pick(F.max_by).alias("distal"))


def end_diameters(points: DataFrame) -> DataFrame:
    return end_nodes(points).select(*KEYS, (2 * F.col("proximal.radius")).alias("proximal_diameter"), (2 * F.col("distal.radius")).alias("distal_diameter"))


def tortuosity(points: DataFrame) -> DataFrame:
    """1 - chord / length, NULL for length 0."""
    a = arc_length(points).groupBy(*KEYS).agg(F.max("arc").alias("length"), F.min_by(F.struct(*"xyz"), "point_idx").alias("p"), F.max_by(F.struct(*"xyz"), "point_idx").alias("q"))
    chord = dist(tuple(F.col(f"p.{n}") for n in "xyz"), tuple(F.col(f"q.{n}") for n in "xyz"))
    return a.select(*KEYS, "length", chord.alias("chord"), (1 - chord / F.nullif("length", F.lit(0.0))).alias("tortuosity"))


def bending_length(points: DataFrame) -> DataFrame:
    """Largest distance of a point to the line through the ends; 0 if the ends coincide."""
    ends = end_nodes(points)
    j = points.join(ends, KEYS)
    p, q = (tuple(F.col(f"{e}.{n}") for n in "xyz") for e in ("proximal", "distal"))
    d = sub(q, p)
    size = F.nullif(dot(d, d), F.lit(0.0))
    t = dot(sub(vec(), p), d) / size
    off = norm(tuple(a - (b + t * c) for a, b, c in zip(vec(), p, d, strict=True)))
    return j.groupBy(*KEYS).agg(F.coalesce(F.max(off), F.lit(0.0)).alias("bending_length"))


def curvature_sums(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sum of curvature after the proximal node (found without blanking) and sum of its squares."""
    first = F.min(F.struct("point_idx")).over(Window.partitionBy(*keys))["point_idx"]
    return nodes.withColumn("_f", F.col("point_idx") == first).groupBy(*keys).agg(F.sum(F.when(~F.col("_f"), F.col("curvature")).otherwise(0.0)).alias("cumulative_curvature"), F.sum(F.col("curvature") * F.col("curvature")).alias("curvature_energy"))


def polar_features(nodes: DataFrame) -> DataFrame:
    """Smallest polar angle, at most pi / 2, and the sum of its successive differences."""
    apart = F.abs(F.col("polar") - F.lag("polar").over(order()))
    return nodes.withColumn("_d", apart).groupBy(*KEYS).agg(F.least(F.lit(math.pi / 2), F.min("polar")).alias("min_polar"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("polar_variation"))


def segment_direction(points: DataFrame) -> DataFrame:
    """Polar angle and azimuth from the proximal to the distal node."""
    polar, azimuth = direction_angles(*(tuple(F.col(f"{e}.{n}") for n in "xyz") for e in ("proximal", "distal")))
    return end_nodes(points).select(*KEYS, polar.alias("polar"), azimuth.alias("azimuth"))


def partial_segment(points: DataFrame, length: float, start: bool = True) -> DataFrame:
    """Points from one end up to the first one at which the length reaches ``length``. Keeps arc, counted from that end."""
    a = arc_length(points)
    if not start:
        a = a.withColumn("arc", F.max("arc").over(Window.partitionBy(*KEYS)) - F.col("arc"))
    w = order() if start else Window.partitionBy(*KEYS).orderBy(F.desc("point_idx"))
    return a.withColumn("_before", F.lag("arc").over(w)).filter(F.col("_before").isNull() | (F.col("_before") < length)).drop("_before")


def partial_features(points: DataFrame) -> DataFrame:
    """Mean diameter of the last 5 and 10 mm, tortuosity of the first 50 and the last 10, 20, 30 mm (parts as partial_segment
    cuts them), by one ordering of the points and one aggregation."""
    p = arc_length(points).withColumns({"_back": F.max("arc").over(Window.partitionBy(*KEYS)) - F.col("arc"), "_before": F.lag("arc").over(order())})
    p = p.withColumn("_next", F.lead("_back").over(order()))
    last = lambda n: F.coalesce(F.col("_next") < n, F.lit(True))
    xyz, i, d = F.struct(*"xyz"), F.col("point_idx"), 2 * F.col("radius")
    parts = {"first_50": (F.coalesce(F.col("_before") < 50, F.lit(True)), "arc"), **{f"last_{n}": (last(n), "_back") for n in (10, 20, 30)}}
    found = [c for name, (keep, size) in parts.items() for c in (F.max(F.when(keep, F.col(size))).alias(f"_{name}_l"), F.min_by(xyz, F.when(keep, i)).alias(f"_{name}_a"), F.max_by(xyz, F.when(keep, i)).alias(f"_{name}_b"))]
    tails = [F.coalesce(F.avg(F.when(last(n) & _open(), d)), F.avg(F.when(last(n), d))).alias(f"diameter_last_{n}") for n in (5, 10)]
    g = p.groupBy(*KEYS).agg(*tails, *found)
    chord = lambda name: dist(*(tuple(F.col(f"_{name}_{e}.{n}") for n in "xyz") for e in "ab"))
    return g.select(*KEYS, "diameter_last_5", "diameter_last_10", *((1 - chord(name) / F.nullif(F.col(f"_{name}_l"), F.lit(0.0))).alias(f"tortuosity_{name}") for name in parts))


def segment_features(nodes: DataFrame) -> DataFrame:
    """The 22 features of each segment in one row, by one ordering of the points and one aggregation. nodes:
    points with curvature, polar and blanking."""
    w, all_rows = order(), Window.partitionBy(*KEYS)
    at = F.struct(*"xyz", "radius")
    pick = lambda f: F.coalesce(f(at, F.when(_open(), F.col("point_idx"))).over(all_rows), f(at, F.col("point_idx")).over(all_rows))
    p = arc_length(nodes).withColumns({"_p": pick(F.min_by), "_q": pick(F.max_by), "_back": F.max("arc").over(all_rows) - F.col("arc"), "_apart": F.abs(F.col("polar") - F.lag("polar").over(w)), "_before": F.lag("arc").over(w)})
    p = p.withColumn("_next", F.lead("_back").over(w))
    a, b = (tuple(F.col(f"{e}.{n}") for n in "xyz") for e in ("_p", "_q"))
    line = sub(b, a)
    t = dot(sub(vec(), a), line) / F.nullif(dot(line, line), F.lit(0.0))
    off = norm(tuple(v - (c + t * g) for v, c, g in zip(vec(), a, line, strict=True)))
    d, xyz, i = 2 * F.col("radius"), F.struct(*"xyz"), F.col("point_idx")
    last = lambda n: F.coalesce(F.col("_next") < n, F.lit(True))
    parts = {"first_50": F.coalesce(F.col("_before") < 50, F.lit(True)), **{f"last_{n}": last(n) for n in (10, 20, 30)}}
    among = lambda name, keep, size: [F.max(F.when(keep, F.col(size))).alias(f"_{name}_l"), F.min_by(xyz, F.when(keep, i)).alias(f"_{name}_a"), F.max_by(xyz, F.when(keep, i)).alias(f"_{name}_b")]
    tail = lambda n: F.coalesce(F.avg(F.when(last(n) & _open(), d)), F.avg(F.when(last(n), d))).alias(f"diameter_last_{n}")
    g = p.groupBy(*KEYS).agg(
        *among("all", F.lit(True), "arc"), *(c for name, keep in parts.items() for c in among(name, keep, "arc" if name == "first_50" else "_back")), tail(5), tail(10),
        unblanked(F.avg, d).alias("mean_diameter"), unblanked(F.stddev_pop, d).alias("std_diameter"), unblanked(F.min, d).alias("min_diameter"), unblanked(F.max, d).alias("max_diameter"),
        F.first("_p").alias("_p"), F.first("_q").alias("_q"), F.coalesce(F.max(off), F.lit(0.0)).alias("bending_length"),
        F.sum(F.when(F.col("_before").isNotNull(), F.col("curvature")).otherwise(0.0)).alias("cumulative_curvature"), F.sum(F.col("curvature") * F.col("curvature")).alias("curvature_energy"),
        F.least(F.lit(math.pi / 2), F.min("polar")).alias("min_polar"), F.coalesce(F.sum("_apart"), F.lit(0.0)).alias("polar_variation"),
    )
    chord = lambda name: dist(*(tuple(F.col(f"_{name}_{e}.{n}") for n in "xyz") for e in "ab"))
    bent = lambda name: 1 - chord(name) / F.nullif(F.col(f"_{name}_l"), F.lit(0.0))
    polar, azimuth = direction_angles(a, b)
    return g.select(
        *KEYS, F.col("_all_l").alias("length"), bent("all").alias("tortuosity"), "mean_diameter", "std_diameter", "min_diameter", "max_diameter", F.try_divide("min_diameter", "max_diameter").alias("min_max_ratio"),
        (2 * F.col("_p.radius")).alias("proximal_diameter"), (2 * F.col("_q.radius")).alias("distal_diameter"), "bending_length", "cumulative_curvature", "curvature_energy", "min_polar", "polar_variation",
        polar.alias("polar"), azimuth.alias("azimuth"), "diameter_last_5", "diameter_last_10", *(bent(name).alias(f"tortuosity_{name}") for name in parts),
    )


def cell_features(points: DataFrame, departure: float = 10.0) -> DataFrame:
    """24 features of each cell: radii, chord, direction, direction of departure (to the first point at
    least ``departure`` away from the start, else the last one), count, ends, mean position."""
    first = F.min_by(F.struct(*"xyz", "radius"), "point_idx")
    last = F.max_by(F.struct(*"xyz", "radius"), "point_idx")
    p = arc_length(points).withColumn("_f", F.first(F.struct(*"xyz")).over(order())).withColumn("_a", dist(vec(), tuple(F.col(f"_f.{n}") for n in "xyz")))
    away = F.min_by(F.struct(*"xyz"), F.when(F.col("_a") >= departure, F.col("point_idx")))
    g = p.groupBy(*KEYS).agg(
        F.avg("radius").alias("mean_radius"), F.min("radius").alias("min_radius"), F.max("radius").alias("max_radius"), F.max("arc").alias("length"), F.count(F.lit(1)).alias("points"),
        first.alias("a"), last.alias("b"), F.coalesce(away, F.max_by(F.struct(*"xyz"), "point_idx")).alias("d"), *(F.avg(n).alias(f"mean_{n}") for n in "xyz"),
    )
    a, b, d = (tuple(F.col(f"{s}.{n}") for n in "xyz") for s in "abd")
    chord = dist(a, b)
    direction, departing = unit(sub(b, a)), unit(sub(d, a))
    return g.select(
        *KEYS, "mean_radius", F.col("a.radius").alias("first_radius"), F.col("b.radius").alias("last_radius"), F.when(F.col("b.radius") > 1e-6, F.col("a.radius") / F.nullif("b.radius", F.lit(0.0))).otherwise(0.0).alias("radius_ratio"), "min_radius", "max_radius",
        chord.alias("chord"), F.when(chord > 1e-6, chord / F.nullif("length", F.lit(0.0))).otherwise(0.0).alias("straightness"),
        *(c.alias(f"direction_{n}") for n, c in zip("ras", direction, strict=True)), *(c.alias(f"departure_{n}") for n, c in zip("ras", departing, strict=True)), "points",
        *(c.alias(f"first_{n}") for n, c in zip("ras", a, strict=True)), *(c.alias(f"last_{n}") for n, c in zip("ras", b, strict=True)), *(F.col(f"mean_{n}").alias(f"mean_{m}") for n, m in zip("xyz", "ras", strict=True)),
    )


def root_centred(features: DataFrame, roots: DataFrame, scale: float = 100.0) -> DataFrame:
    """The nine position features of cells (first, last, mean; r, a, s) less the case's root position, by
    ``scale``. roots: case_id, root_r, root_a, root_s, one row a case."""
    own = [f"{k}_{n}" for k in ("first", "last", "mean") for n in "ras"]
    j = features.join(roots, "case_id")
    return j.select(*(((F.col(c) - F.col(f"root_{c[-1]}")) / scale).alias(c) if c in own else F.col(c) for c in features.columns))


def pair_features(nodes: DataFrame, pairs: DataFrame, flat: float = 50.0) -> DataFrame:
    """Largest angle, azimuth and polar difference between nodes of two segments. nodes: case_id, cell_id,
    point_idx, polar, azimuth, inner (not an end); pairs: case_id, left, right. Nodes of one pair meet
    all of the other's, as the definition says; a segment has some hundred nodes at most. Angles take
    inner nodes; azimuths nodes whose polar angle is below ``flat`` degrees."""
    side = lambda s: nodes.select("case_id", F.col("cell_id").alias(s), *(F.col(c).alias(f"{s[0]}_{c}") for c in ("polar", "azimuth", "inner")))
    j = pairs.join(side("left"), ["case_id", "left"]).join(side("right"), ["case_id", "right"])
    v = lambda s: (F.cos(f"{s}_polar") * F.cos(f"{s}_azimuth"), F.cos(f"{s}_polar") * F.sin(f"{s}_azimuth"), F.sin(f"{s}_polar"))
    level = (F.abs(F.degrees("l_polar")) < flat) & (F.abs(F.degrees("r_polar")) < flat)
    return j.groupBy("case_id", "left", "right").agg(
        F.max(F.when(F.col("l_inner") & F.col("r_inner"), F.acos(clamp(dot(v("l"), v("r")))))).alias("angle"),
        F.max(F.when(level, F.acos(clamp(F.cos("l_azimuth") * F.cos("r_azimuth") + F.sin("l_azimuth") * F.sin("r_azimuth"))))).alias("azimuth_difference"),
        F.max(F.abs(F.col("l_polar") - F.col("r_polar"))).alias("polar_difference"),
    )


def contact_point(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Midpoint of the closest pair of ends of two segments. pairs: case_id, left, right."""
    ends = end_nodes(points, blanked=False).select(*KEYS, F.explode(F.array("proximal", "distal")).alias("e")).select("case_id", "cell_id", "e.*")
    side = lambda s: ends.select("case_id", F.col("cell_id").alias(s), F.struct("point_idx", *"xyz").alias(f"{s[0]}e"))
    j = pairs.join(side("left"), ["case_id", "left"]).join(side("right"), ["case_id", "right"])
    p, q = (tuple(F.col(f"{s}e.{n}") for n in "xyz") for s in "lr")
    best = j.withColumn("gap", dist(p, q)).withColumn("mid", F.struct(*(((a + b) / 2).alias(n) for n, a, b in zip("xyz", p, q, strict=True))))
    return best.groupBy("case_id", "left", "right").agg(F.min_by("mid", F.struct("gap", "le.point_idx", "re.point_idx")).alias("m"), F.min("gap").alias("gap")).select("case_id", "left", "right", "m.x", "m.y", "m.z", "gap")


def polygon_area(ring: DataFrame, keys: list[str]) -> DataFrame:
    """Area of a planar ring (keys, idx, u, v) and the radius of the circle of that area."""
    w = Window.partitionBy(*keys).orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    area = F.abs(F.sum(F.col("u") * F.col("_v") - F.col("_u") * F.col("v"))) / 2
    return ring.withColumns({"_u": nxt("u"), "_v": nxt("v")}).groupBy(*keys).agg(area.alias("area")).withColumn("radius", F.sqrt(F.col("area") / math.pi))


#: Points of a group up to which one task finds its circle; larger groups take rounds of jobs.
CIRCLE_POINTS = 10_000


def enclosing_circle(points: DataFrame, keys: list[str], rounds: int = 60, tolerance: float = 1e-6, most: int | None = None) -> DataFrame:
    """Smallest circle around planar points (keys, u, v), all groups at once: each round adds the farthest
    point to the at most three points that hold the circle and takes the smallest circle around these. Its
    radius is never above the answer, the farthest distance never below; a group is done when they differ by less
    than ``tolerance`` of the radius, and fails if that takes more than so many rounds. Groups of at most ``most`` points
    (default CIRCLE_POINTS) go through their rounds in one task, many at a time; a round of larger ones is a job that
    meets only those not done. Points without a key or without both coordinates don't count."""
    from tubula.functions.runtime import cut_lineage

    most = CIRCLE_POINTS if most is None else most
    points = points.select(*keys, F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).dropna(subset=["u", "v"])
    points = cut_lineage(points.filter(" and ".join(f"`{k}` is not null" for k in keys)))
    large = cut_lineage(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*keys))
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    run = lambda rows, begin: _circles(rows, begin, keys, rounds, tolerance)
    few = lambda df: in_groups(df, keys, [], run, f"{kinds}, cu double, cv double, radius double")
    if not large.limit(1).count():
        return few(points)
    rest = cut_lineage(points.join(large, keys, "left_semi").distinct())
    return few(points.join(large, keys, "left_anti")).unionByName(_circles_by_rounds(rest, keys, rounds, tolerance))


def _circles_by_rounds(points: DataFrame, keys: list[str], rounds: int, tolerance: float) -> DataFrame:
    from tubula.functions.runtime import cut_lineage

    own = points.groupBy(*keys).agg(F.min(F.struct("u", "v")).alias("a")).select(*keys, *(F.col("a").alias(n) for n in ("a", "b", "c")), F.col("a.u").alias("cu"), F.col("a.v").alias("cv"), F.lit(0.0).alias("least"))
    held, done = ("a", "b", "c", "cu", "cv", "least"), []
    for _ in range(rounds + 1):
        away = points.join(own, keys).withColumn("d", F.hypot(F.col("u") - F.col("cu"), F.col("v") - F.col("cv")))
        g = cut_lineage(away.groupBy(*keys).agg(*(F.first(n).alias(n) for n in held), F.max_by(F.struct("u", "v"), F.struct("d", "u", "v")).alias("f"), F.max("d").alias("radius")))
        open_ = F.col("radius") > F.col("least") * (1 + tolerance)
        done.append(g.filter(~open_).select(*keys, "cu", "cv", "radius"))
        if not g.filter(open_).limit(1).count():
            return reduce(DataFrame.unionByName, done)
        own = g.filter(open_).select(*keys, _smallest_circle(("a", "b", "c", "f")).alias("s")).select(*keys, *(f"s.{n}" for n in held))
    raise RuntimeError("enclosing circles did not settle")


def _circles(rows: pa.Table, begin: np.ndarray, keys: list[str], rounds: int, tolerance: float) -> Iterator[pa.Table]:
    """The rounds of enclosing_circle for all groups of a batch."""
    u, v = (numbers(rows, n)[0] for n in "uv")
    sizes, out = np.diff(begin), np.empty((len(begin) - 1, 3))
    for group in by_size(sizes):
        at = padded(begin[group], sizes[group])
        x, y = u[at], v[at]
        low = x.min(1)
        first = np.stack([low, np.where(x == low[:, None], y, np.inf).min(1)], 1)
        held, centre, least = np.repeat(first[:, None], 3, 1), first, np.zeros(len(group))
        for turn in range(rounds + 1):
            away = np.hypot(x - centre[:, :1], y - centre[:, 1:])
            radius = away.max(1)
            open_ = ~(radius <= least * (1 + tolerance))
            out[group[~open_]] = np.column_stack([centre, radius])[~open_]
            if not open_.any():
                break
            x, y, away, group, held = x[open_], y[open_], away[open_], group[open_], held[open_]
            far = away == away.max(1)[:, None]
            right = np.where(far, x, -np.inf).max(1)
            top = np.where(far & (x == right[:, None]), y, -np.inf).max(1)
            centre, least, held = _circle_of_four(np.concatenate([held, np.stack([right, top], 1)[:, None]], 1))
        else:
            raise RuntimeError("enclosing circles did not settle")
    groups = rows.select(keys).take(pa.array(begin[:-1]))
    yield pa.table([*groups.columns, *(pa.array(out[:, i]) for i in range(3))], [*keys, "cu", "cv", "radius"])


def _circle_of_four(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest circles around four points each, as _smallest_circle: centres, radii and the points on them."""
    found = []
    with np.errstate(all="ignore"):
        for on in [*combinations(range(4), 2), *combinations(range(4), 3)]:
            a, b, c = p[:, on[0]], p[:, on[1]], p[:, on[-1]]
            if len(on) == 2:
                centre, flat = (a + b) / 2, np.zeros(len(p), bool)
            else:
                (bu, bv), (du, dv) = (b - a).T, (c - a).T
                b2, d2, twice = bu * bu + bv * bv, du * du + dv * dv, 2 * (bu * dv - bv * du)
                centre, flat = np.stack([a[:, 0] + (dv * b2 - bv * d2) / twice, a[:, 1] + (bu * d2 - du * b2) / twice], 1), twice == 0
            gap = np.hypot(p[..., 0] - centre[:, :1], p[..., 1] - centre[:, 1:]).max(1)
            found.append((np.where(flat | np.isnan(gap), np.inf, gap), centre, np.stack([a, b, c], 1)))
    least, centre, on = np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), np.stack([f[2] for f in found], 1)
    best, each = np.lexsort((centre[..., 1], centre[..., 0], least), axis=1)[:, 0], np.arange(len(p))
    return centre[each, best], least[each, best], on[each, best]


def _smallest_circle(names: tuple[str, ...]) -> Column:
    """Smallest circle around a few points (structs u, v): of the circles on two or three of them, the
    centre whose farthest point is nearest. Struct of least (radius), cu, cv and the points a, b, c on it."""
    u, v = (lambda n: F.col(f"{n}.u")), (lambda n: F.col(f"{n}.v"))
    found = []
    for on in [*combinations(names, 2), *combinations(names, 3)]:
        p, q, r = on[0], on[1], on[-1]
        if len(on) == 2:
            cu, cv = (u(p) + u(q)) / 2, (v(p) + v(q)) / 2
        else:
            bu, bv, du, dv = u(q) - u(p), v(q) - v(p), u(r) - u(p), v(r) - v(p)
            b2, d2, twice = bu * bu + bv * bv, du * du + dv * dv, 2 * (bu * dv - bv * du)
            cu, cv = u(p) + F.try_divide(dv * b2 - bv * d2, twice), v(p) + F.try_divide(bu * d2 - du * b2, twice)
        far = F.greatest(*(F.hypot(u(n) - cu, v(n) - cv) for n in names))
        found.append(F.struct(F.coalesce(far, F.lit(float("inf"))).alias("least"), cu.alias("cu"), cv.alias("cv"), *(F.col(n).alias(k) for n, k in zip((p, q, r), "abc", strict=True))))
    return F.array_min(F.array(*found))


def ovality(inner: Column, outer: Column) -> Column:
    """Inscribed / enclosing radius, 1 when the enclosing radius is 0."""
    return F.when(outer == 0, 1.0).otherwise(F.try_divide(inner, outer))


def arch_type(nodes: DataFrame, begins: DataFrame | None = None) -> DataFrame:
    """1, 2 or 3 for each case: how far the origin of BT lies below the apex of AA (highest node plus its radius), against
    the diameter of LCCA at its origin: below 1, below 2, or more; 1 when a part is missing or the apex isn't above 0.
    Origins are the nodes nearest to any AA node, less than 100 mm away; blanked ones (column blanking, if there)
    don't count. nodes: case_id, node_id, class_name, x, y, z, radius. begins: origins of BT and LCCA, if they are known."""
    from tubula.operators.nearest import origins

    seen = nodes.filter("class_name = 'AA' or blanking = 0") if "blanking" in nodes.columns else nodes
    begins = origins(seen, ["BT", "LCCA"], "AA") if begins is None else begins
    apex = nodes.filter("class_name = 'AA'").groupBy("case_id").agg(F.max(F.col("z") + F.col("radius")).alias("apex"))
    bt = begins.filter("class_name = 'BT'").select("case_id", F.col("z").alias("origin"))
    wide = spread(nodes.select("case_id", "node_id", (2 * F.col("radius")).alias("diameter"))).join(spread(begins.filter("class_name = 'LCCA'").select("case_id", "node_id")), ["case_id", "node_id"]).select("case_id", "diameter")
    j = nodes.select("case_id").distinct().join(apex, "case_id", "left").join(bt, "case_id", "left").join(wide, "case_id", "left")
    ratio = F.when(F.col("apex") > 0, F.abs(F.col("apex") - F.col("origin")) / F.nullif("diameter", F.lit(0.0)))
    return j.select("case_id", F.when(ratio >= 2, 3).when(ratio >= 1, 2).otherwise(1).alias("arch_type"))


def class_order(nodes: DataFrame) -> DataFrame:
    """Mean level of each class and its place in that order."""
    g = nodes.groupBy("case_id", "class_name").agg(F.avg("hierarchy").alias("mean_level"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("mean_level", "class_name")))


def merge_small(order: DataFrame, least: int = 3) -> DataFrame:
    """Classes with fewer than ``least`` nodes go to the class before them in order; the first one stays."""
    w = Window.partitionBy("case_id").orderBy("place")
    big = F.when((F.col("n") >= least) | (F.col("place") == 1), F.col("class_name"))
    return order.withColumn("merged", F.last(big, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def node_weight(edges: DataFrame) -> DataFrame:
    """Mean weight of a node's incident edges. edges: case_id, src, dst, weight (the last one of both directions wins)."""
    one = edges.groupBy("case_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("weight", F.struct("src", "dst")).alias("weight"))
    ends = one.select("case_id", "weight", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    return ends.groupBy("case_id", "node").agg(F.avg("weight").alias("weight"))
