"""Operators on ordered points (case_id, cell_id, point_idx, x, y, z, ...): windows over one ordering,
so that a chain of them needs one exchange and one sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tubula.functions.cells import by_size, column, in_groups, numbers, padded
from tubula.functions.geom import Vec, clamp, cross, dist, dot, norm, sub, vec

KEYS = ["case_id", "cell_id"]


def order() -> WindowSpec:
    """A cell's points in their order: the one ordering that all windows here share."""
    return Window.partitionBy(*KEYS).orderBy("point_idx")


def whole() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def up_to() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def after() -> WindowSpec:
    return order().rowsBetween(Window.currentRow, Window.unboundedFollowing)


def _lag(p: Vec, n: int = 1) -> Vec:
    return tuple(F.lag(c, n).over(order()) for c in p)


def step_length(p: Vec | None = None) -> Column:
    """Distance from the point before, 0 at the start."""
    p = p or vec()
    return F.coalesce(dist(p, _lag(p)), F.lit(0.0))


def arc_length(points: DataFrame) -> DataFrame:
    """Adds arc: length along the cell from its first point."""
    return points.withColumn("_step", step_length()).withColumn("arc", F.sum("_step").over(up_to())).drop("_step")


def gradient(c: Column) -> Column:
    """Central difference inside, one-sided at both ends, 0 for a single point."""
    before, after = F.lag(c).over(order()), F.lead(c).over(order())
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).otherwise(F.coalesce(after - c, c - before, F.lit(0.0)))


def tangents(points: DataFrame) -> DataFrame:
    """Adds tx, ty, tz: the unit gradient of the position; the gradient itself where it is shorter than 1e-12."""
    g = points.withColumns({f"_g{n}": gradient(F.col(n)) for n in "xyz"})
    size = norm(vec("_g"))
    return g.withColumns({f"t{n}": F.col(f"_g{n}") / F.when(size < 1e-12, 1.0).otherwise(size) for n in "xyz"}).drop(*(f"_g{n}" for n in "xyz"))


def turn_angle(points: DataFrame) -> DataFrame:
    """Adds turn (degrees between a tangent and the one before, 0 at the start) and turn_sum. Needs tangents."""
    t = vec("t")
    angle = F.coalesce(F.degrees(F.acos(clamp(dot(t, _lag(t))))), F.lit(0.0))
    return points.withColumn("turn", angle).withColumn("turn_sum", F.sum("turn").over(up_to()))


def curve_curvature(points: DataFrame) -> DataFrame:
    """Adds curvature: length of the gradient of the tangent, for each index. Needs tangents."""
    return points.withColumns({f"_d{n}": gradient(F.col(f"t{n}")) for n in "xyz"}).withColumn("curvature", norm(vec("_d"))).drop("_dx", "_dy", "_dz")


def transported_frames(points: DataFrame) -> DataFrame:
    """Adds nx..nz and bx..bz: rotation-minimising normals and binormals by double reflection. A task takes a step
    along all cells of a batch at once. Needs tangents."""
    kind = StructType([*points.schema.fields, *(StructField(f"n{n}", DoubleType()) for n in "xyz")])
    out = in_groups(points, KEYS, ["point_idx"], _frames, kind)
    return out.withColumns(dict(zip(("bx", "by", "bz"), cross(vec("t"), vec("n")), strict=True)))


def _frames(rows: pa.Table, begin: np.ndarray) -> Iterator[pa.Table]:
    columns = [numbers(rows, c) for c in ("x", "y", "z", "tx", "ty", "tz")]
    value, null = np.stack([c[0] for c in columns], 1), np.logical_or.reduce([c[1] for c in columns])
    out, gone, sizes = np.empty((rows.num_rows, 3)), np.zeros(rows.num_rows, bool), np.diff(begin)
    for own in by_size(sizes):
        at = padded(begin[own], sizes[own])
        inside = np.arange(at.shape[1]) < sizes[own][:, None]
        out[at[inside]] = _transported(value[:, :3], value[:, 3:], null, at)[inside]
        gone[at[inside]] = np.broadcast_to(null[at].any(1)[:, None], at.shape)[inside]
    yield pa.table([*rows.columns, *(column(out[:, i], gone) for i in range(3))], [*rows.column_names, "nx", "ny", "nz"])


def _transported(p: np.ndarray, t: np.ndarray, null: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Normals along each line of row numbers. A point at the place of the one before keeps its normal, as padding does."""
    dots = lambda a, b: (a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2])[:, None]

    def mirror(a: np.ndarray, v: np.ndarray) -> np.ndarray:
        """a reflected at the plane across v; a itself if v is about zero."""
        c = dots(v, v)
        return np.where(c < 1e-20, a, a - v * (2 * dots(v, a) / c))

    def to_unit(a: np.ndarray) -> np.ndarray:
        size = np.sqrt(dots(a, a))
        return np.where(size == 0, a, a / size)

    with np.errstate(all="ignore"):
        here, along = p[at[:, 0]], t[at[:, 0]]
        steep = np.abs(along[:, 0]) >= 0.9
        axis = np.stack([np.where(steep, 0.0, 1.0), np.where(steep, 1.0, 0.0), np.zeros(len(at))], 1)
        normal = np.stack([along[:, 1] * axis[:, 2] - along[:, 2] * axis[:, 1], along[:, 2] * axis[:, 0] - along[:, 0] * axis[:, 2], along[:, 0] * axis[:, 1] - along[:, 1] * axis[:, 0]], 1)
        size = np.sqrt(dots(normal, normal))
        normal = np.where((size == 0) | (np.isnan(size) & null[at[:, 0]][:, None]), 0.0, normal / size)
        out = np.empty((*at.shape, 3))
        out[:, 0] = normal
        for i in range(1, at.shape[1]):
            there, next_ = p[at[:, i]], t[at[:, i]]
            v1 = there - here
            v2 = next_ - mirror(along, v1)
            normal = np.where(dots(v1, v1) < 1e-20, normal, to_unit(mirror(mirror(normal, v1), v2)))
            out[:, i], here, along = normal, there, next_
    return out


def curve_torsion(points: DataFrame) -> DataFrame:
    """Adds torsion: minus the gradient of the binormal along the normal. Needs transported_frames."""
    g = points.withColumns({f"_d{n}": gradient(F.col(f"b{n}")) for n in "xyz"})
    return g.withColumn("torsion", -dot(vec("_d"), vec("n"))).drop("_dx", "_dy", "_dz")


def local_curvature(points: DataFrame, reach: int = 2) -> DataFrame:
    """Adds local_curvature and local_torsion from the points around each one (``reach`` to either side, with
    two the 3 to 5 points of the definition), by nested gradients; torsion is NULL where curvature is 0 and
    for cells of fewer than three points both are NULL. Nested gradients need seven points for a helix's
    whole torsion; of five they see two thirds."""
    if reach > 4:  # one array instead of very many columns
        near = F.collect_list(F.struct("point_idx", "x", "y", "z")).over(order().rowsBetween(-reach, reach))
        before, later = (F.count(F.lit(1)).over(order().rowsBetween(*r)) for r in ((-reach, -1), (1, reach)))
        df = points.withColumns({"_pts": near, "_before": before, "_later": later})
        return nested_gradients(df.withColumn("_at", F.when(F.col("_before") == 0, 1).when(F.col("_later") == 0, F.size("_pts") - 2).otherwise(F.col("_before"))))
    around = _around(reach)
    df = points.withColumns({f"_p{i}": c for i, c in enumerate(around)})
    both = F.arrow_udf(_curved_around, "curvature double, torsion double")(*(F.col(f"_p{i}") for i in range(len(around))))
    return _with_both(df.withColumn("_both", both))


def _around(reach: int) -> list[Column]:
    """The points (structs x, y, z) from ``reach`` before to ``reach`` after each one; NULL beyond the ends."""
    at = F.struct(*(F.col(n).cast("double").alias(n) for n in "xyz"))
    return [*(F.lag(at, i).over(order()) for i in range(reach, 0, -1)), at, *(F.lead(at, i).over(order()) for i in range(1, reach + 1))]


def near_curvature(points: DataFrame) -> DataFrame:
    """Adds curvature, that of local_curvature with a reach of two, by columns alone. Rows that a Python function returns are
    no longer known to lie by cells, so that what follows deals them out anew; here they stay where they are. Columns whose
    names begin with an underscore go."""
    rows = points.withColumns({f"_n{i}": c for i, c in enumerate(_around(2))})
    a, b, c, d, e = (tuple(F.col(f"_n{i}.{k}") for k in "xyz") for i in range(5))
    there = [F.col(f"_n{i}").isNotNull() for i in range(5)]
    half = lambda p, q: tuple((y - x) / 2 for x, y in zip(p, q, strict=True))
    pick = lambda inner, begin, end: [F.when(~there[1], y).when(~there[3], z).otherwise(x) for x, y, z in zip(inner, begin, end, strict=True)]
    beyond = lambda k, far, one: tuple(F.when(there[k], x).otherwise(y) for x, y in zip(far, one, strict=True))
    # gradients at three points: this one and its neighbours, or the three at a cell's end; one-sided where nothing lies beyond
    sides = {"p": pick(beyond(0, half(a, c), sub(c, b)), sub(d, c), sub(b, a)), "m": pick(half(b, d), half(c, e), half(a, c)), "q": pick(beyond(4, half(c, e), sub(d, c)), sub(e, d), sub(c, b))}
    rows = rows.withColumns({f"_{s}{k}": v for s, at in sides.items() for k, v in zip("xyz", at, strict=True)})
    rows = rows.withColumns({f"_v{s}": F.nullif(norm(vec(f"_{s}")), F.lit(0.0)) for s in sides})
    bend = tuple((F.col(f"_q{k}") / F.col("_vq") - F.col(f"_p{k}") / F.col("_vp")) / 2 / F.col("_vm") for k in "xyz")
    rows = rows.withColumns({f"_b{k}": v for k, v in zip("xyz", bend, strict=True)}).withColumn("curvature", norm(vec("_b")))
    return rows.drop(*(x for x in rows.columns if x.startswith("_")))


def nested_gradients(df: DataFrame) -> DataFrame:
    """Adds local_curvature and local_torsion at place _at (from 0) of the ordered array _pts (structs with x, y, z);
    columns whose names begin with an underscore go. Fewer than three points give NULL. Batches of rows are computed at once."""
    both = F.arrow_udf(_curved, "curvature double, torsion double")(*(F.col(f"_pts.{k}").cast("array<double>") for k in "xyz"), F.col("_at").cast("int"))
    return _with_both(df.withColumn("_both", both))


def _with_both(df: DataFrame) -> DataFrame:
    out = df.withColumn("local_curvature", F.col("_both.curvature")).withColumn("local_torsion", F.col("_both.torsion"))
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def _curved(x: pa.Array, y: pa.Array, z: pa.Array, at: pa.Array) -> pa.Array:
    """Curvature and torsion at one place of each row's points."""
    size = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(size.max(initial=0)), 3)
    inside = np.arange(width) < size[:, None]

    def spread_out(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = c.flatten()
        value, null = np.zeros((len(x), width)), ~inside
        value[inside], null[inside] = flat.fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
        return value, null

    return curved_lines([spread_out(c) for c in (x, y, z)], size, place)


def _curved_around(*around: pa.Array) -> pa.Array:
    """Curvature and torsion at the middle one of the points around each row; at a cell's ends at the second or last but one."""
    reach = len(around) // 2
    there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in around], 1)
    size, before = there.sum(1), there[:, :reach].sum(1)
    place = np.where(before == 0, 1, np.where(size - 1 == before, size - 2, before))
    width = max(len(around), 3)
    at = np.minimum(np.arange(width) + (reach - before)[:, None], len(around) - 1)
    inside = np.arange(width) < size[:, None]

    def moved(i: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [c.flatten()[i] for c in around]
        value = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in parts], 1)
        null = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in parts], 1)
        return np.where(inside, np.take_along_axis(value, at, 1), 0.0), np.take_along_axis(null, at, 1) | ~inside

    return curved_lines([moved(i) for i in range(3)], size, place)


def curved_lines(places: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray, place: np.ndarray) -> pa.Array:
    """Curvature and torsion at one place of each line of points. A value goes with a flag that says that it is undefined
    (NULL), as NaN stands for itself."""
    rows, width = places[0][0].shape
    last = np.maximum(size - 1, 0)

    def grad(c: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v, null = c
        out, gone, each = np.empty_like(v), null.copy(), np.arange(rows)
        out[:, 1:-1], gone[:, 1:-1] = (v[:, 2:] - v[:, :-2]) / 2, null[:, 2:] | null[:, :-2]
        out[:, 0], gone[:, 0] = v[:, 1] - v[:, 0], null[:, 1] | null[:, 0]
        before = np.maximum(last - 1, 0)
        out[each, last], gone[each, last] = v[each, last] - v[each, before], null[each, last] | null[each, before]
        return out, gone

    def over(c: tuple[np.ndarray, np.ndarray], d: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return c[0] / d[0], c[1] | d[1] | (d[0] == 0)

    def size_of(c: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.sqrt(c[0][0] * c[0][0] + c[1][0] * c[1][0] + c[2][0] * c[2][0]), c[0][1] | c[1][1] | c[2][1]

    with np.errstate(all="ignore"):
        r = [grad((v, null | (size < 3)[:, None])) for v, null in places]
        speed = size_of(r)
        t = [over(c, speed) for c in r]
        s = [over(grad(c), speed) for c in t]
        k = size_of(s)
        n = [over(c, k) for c in s]
        b = [grad((t[i][0] * n[j][0] - t[j][0] * n[i][0], t[i][1] | n[j][1] | t[j][1] | n[i][1])) for i, j in ((1, 2), (2, 0), (0, 1))]
        turn = over((b[0][0] * n[0][0] + b[1][0] * n[1][0] + b[2][0] * n[2][0], np.logical_or.reduce([c[1] for c in (*b, *n)])), speed)
    there = (place >= 0) & (place < size)
    pick = lambda c, sign: pa.array(sign * c[0][np.arange(rows), np.clip(place, 0, width - 1)], pa.float64(), mask=c[1][np.arange(rows), np.clip(place, 0, width - 1)] | ~there)
    return pa.StructArray.from_arrays([pick(k, 1.0), pick(turn, -1.0)], ["curvature", "torsion"])


def mean_step(points: DataFrame) -> DataFrame:
    """Adds mean_step: mean length of the steps among a point and its two neighbours to either side."""
    return points.withColumn("_step", dist(vec(), _lag(vec()))).withColumn("mean_step", F.avg("_step").over(order().rowsBetween(-1, 2))).drop("_step")


def savgol_weights(window: int, order: int) -> list[float]:
    """Smoothing weights of a Savitzky-Golay filter; an even window reaches one row further back."""
    x = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(x.astype(float), order + 1, increasing=True))[0].tolist()


def weighted_window(points: DataFrame, column: str, out: str, weights: list[float], edges: str = "nearest") -> DataFrame:
    """Weighted sum over rows around each one; beyond the ends values are repeated (nearest) or mirrored
    with the end value twice (reflect). One ordered array for each cell."""
    back = len(weights) // 2
    n = F.size("_v")

    def value(i: Column) -> Column:
        if edges == "nearest":
            return F.col("_v")[F.greatest(F.lit(0), F.least(n - 1, i))]
        m = F.pmod(i, 2 * n)
        return F.col("_v")[F.when(m < n, m).otherwise(2 * n - 1 - m)]

    cells = points.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("point_idx", F.col(column).cast("double").alias("v")))).alias("_s")).withColumn("_v", F.transform("_s", lambda s: s["v"]))
    w = F.array(*map(F.lit, weights))
    smooth = F.transform("_s", lambda s, i: F.struct(s["point_idx"].alias("point_idx"), F.aggregate(F.transform(w, lambda k, j: k * value(i + j - back)), F.lit(0.0), lambda a, b: a + b).alias(out)))
    rows = cells.select(*KEYS, F.explode(smooth).alias("z")).select(*KEYS, "z.point_idx", f"z.{out}")
    return points.join(rows, [*KEYS, "point_idx"])


def savgol_smooth(points: DataFrame, column: str, out: str, window: int = 50, order: int = 3) -> DataFrame:
    """Savitzky-Golay filter with repeated ends."""
    return weighted_window(points, column, out, savgol_weights(window, order))


def gaussian_smooth(points: DataFrame, column: str, out: str, sigma: float = 2.0, truncate: float = 4.0) -> DataFrame:
    """Gaussian filter with mirrored ends."""
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return weighted_window(points, column, out, (w / w.sum()).tolist(), "reflect")


class _Spans:
    """Minima and maxima of all stretches of 2^k values, so that a search or a range query takes a logarithm of steps; all
    queries of a cell go at once."""

    def __init__(self, v: np.ndarray):
        self.low, self.high = [v], [v]
        while 2 * (step := 1 << (len(self.low) - 1)) <= len(v):
            for table, f in ((self.low, np.minimum), (self.high, np.maximum)):
                table.append(f(table[-1][:-step], table[-1][step:]))

    def nearest(self, at: np.ndarray, bound: np.ndarray, left: bool, higher: bool) -> np.ndarray:
        """First place left or right of ``at`` whose value is above (or, if not ``higher``, at most) the bound; -1 or the
        number of values where there is none."""
        n, edge = len(self.low[0]), (at if left else at + 1).copy()
        for k in reversed(range(len(self.low))):
            step = 1 << k
            begin = edge - step if left else edge
            ok = begin >= 0 if left else begin + step <= n
            at_ = np.where(ok, begin, 0)
            skip = ok & (self.high[k][at_] <= bound if higher else self.low[k][at_] > bound)
            edge = np.where(skip, begin if left else begin + step, edge)
        return edge - 1 if left else edge

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Smallest value of each stretch begin..end - 1, which isn't empty."""
        k = np.frexp(end - begin)[1] - 1
        out = np.empty(len(begin))
        for level in np.unique(k):
            own = k == level
            out[own] = np.minimum(self.low[level][begin[own]], self.low[level][end[own] - (1 << int(level))])
        return out


def peak_places(v: np.ndarray, height: float, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of peaks in a line of values, their prominences and widths at half prominence."""
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, int)
    last = np.append(first[1:], len(v)) - 1
    top = v[first]
    inner = np.flatnonzero((top[1:-1] > top[:-2]) & (top[1:-1] > top[2:]) & (top[1:-1] >= height)) + 1
    peak, top = (first[inner] + last[inner]) // 2, top[inner]
    if not len(peak):
        return peak, top, top
    spans = _Spans(v)
    left, right = (spans.nearest(peak, top, side, True) for side in (True, False))
    prominence = top - np.maximum(spans.least(left + 1, peak + 1), spans.least(peak, right))
    level = top - prominence / 2
    lo, hi = (spans.nearest(peak, level, side, False) for side in (True, False))
    cross = lambda at, to: (level - v[at]) / (v[to] - v[at])
    with np.errstate(invalid="ignore", divide="ignore"):
        begin = np.where(lo > left, lo + cross(np.maximum(lo, 0), lo + 1), left + 1)
        end = np.where(hi < right, hi - cross(np.minimum(hi, len(v) - 1), hi - 1), right - 1)
    wide = end - begin >= width
    return peak[wide], prominence[wide], (end - begin)[wide]


def _ordered(cell: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A cell's rows in order and their values; rows without one are lower than any."""
    cell = cell.sort_by("point_idx")
    v = np.array(cell.column("v").fill_null(-np.inf).to_numpy(), float)
    return cell, np.where(np.isnan(v), -np.inf, v)


def peaks(points: DataFrame, column: str, height: float, width: float) -> DataFrame:
    """Rows that are local maxima (the middle of a plateau) of at least ``height`` whose width at half
    prominence is at least ``width``: keys, point_idx, value, prominence, width. The nearest higher row
    on either side bounds the search, inside a cell; positions count rows. One exchange: each cell's line is searched
    by range tables, n log n for n rows whatever its peaks; rows without a value are lower than any."""
    rows = points.select(*KEYS, "point_idx", F.col(column).cast("double").alias("v"))

    def run(cell: pa.Table) -> pa.Table:
        cell, v = _ordered(cell)
        at, prominence, wide = peak_places(v, height, width)
        found = cell.take(pa.array(at))
        return pa.table([*(found.column(k) for k in (*KEYS, "point_idx")), pa.array(v[at]), pa.array(prominence), pa.array(wide)], [*KEYS, "point_idx", "value", "prominence", "width"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in (*KEYS, "point_idx"))
    return rows.groupBy(*KEYS).applyInArrow(run, f"{kinds}, value double, prominence double, width double")


def curve_ids(points: DataFrame, column: str, height: float = 0.03, width: float = 10) -> DataFrame:
    """Adds curve_id: a cell is cut at the smallest value between consecutive peaks (the first on ties)."""
    rows = points.select(*KEYS, "point_idx", F.col(column).cast("double").alias("v"))

    def run(cell: pa.Table) -> pa.Table:
        cell, v = _ordered(cell)
        at = peak_places(v, height, width)[0]
        cut = np.zeros(len(v), np.int64)
        # two peaks have at least one row between them
        cut[[a + 1 + int(np.argmin(v[a + 1 : b])) for a, b in zip(at[:-1], at[1:])]] = 1
        return pa.table([*(cell.column(k) for k in (*KEYS, "point_idx")), pa.array(np.cumsum(cut))], [*KEYS, "point_idx", "curve_id"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in (*KEYS, "point_idx"))
    return points.join(rows.groupBy(*KEYS).applyInArrow(run, f"{kinds}, curve_id long"), [*KEYS, "point_idx"])


def first_local_minimum(points: DataFrame, column: str, limit: float = 20.0, slack: float = 5.0) -> DataFrame:
    """For each cell the first local minimum (the derivative turns from falling, the second derivative is
    positive) below ``limit`` that is within ``slack`` of the lowest such one: keys, point_idx, value."""
    d = points.withColumn("_d", gradient(F.col(column))).withColumn("_dd", gradient(F.col("_d")))
    hit = d.filter((F.col("_d") <= 0) & (F.col("_next") > 0)) if "_next" in d.columns else d.withColumn("_next", F.lead("_d").over(order())).filter((F.col("_d") <= 0) & (F.col("_next") > 0))
    hit = hit.filter((F.col("_dd") > 0) & (F.col(column) < limit)).withColumn("_low", F.min(column).over(whole())).filter(F.col(column) <= F.col("_low") + slack)
    return hit.groupBy(*KEYS).agg(F.min("point_idx").alias("point_idx"), F.min_by(column, "point_idx").alias("value"))


def flag_after(points: DataFrame, at: DataFrame) -> DataFrame:
    """Adds after: 1 for points after their cell's index in ``at`` (keys, point_idx), else 0."""
    limits = at.select(*KEYS, F.col("point_idx").alias("_at"))
    return points.join(limits, KEYS, "left").withColumn("after", F.when(F.col("point_idx") > F.col("_at"), 1).otherwise(0)).drop("_at")


def longest_run(points: DataFrame, predicate: Column) -> DataFrame:
    """The longest run of rows for which the predicate holds (the first on ties): keys, start, end, n."""
    p = points.select(*KEYS, "point_idx", F.coalesce(predicate, F.lit(False)).alias("p"))
    runs = p.withColumn("change", F.when(F.col("p") == F.lag("p").over(order()), 0).otherwise(1)).withColumn("run", F.sum("change").over(up_to())).filter("p")
    sizes = runs.groupBy(*KEYS, "run").agg(F.min("point_idx").alias("start"), F.max("point_idx").alias("end"), F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*KEYS).orderBy(F.desc("n"), "start")
    return sizes.withColumn("k", F.row_number().over(best)).filter("k = 1").select(*KEYS, "start", "end", "n")


def trim_tail(points: DataFrame, flag: str) -> DataFrame:
    """Drop the rows at a cell's end whose flag is 1."""
    last = F.max(F.when(F.col(flag) != 1, F.col("point_idx"))).over(whole())
    return points.withColumn("_last", last).filter(F.col("point_idx") <= F.col("_last")).drop("_last")


def label_transition(points: DataFrame, label: str, part: str, strict: bool = True) -> DataFrame:
    """First index whose label contains ``part``: keys, point_idx. With strict, cells where no row, every
    row, or the first row matches are an error; otherwise they are left out."""
    hit = F.col(label).contains(part)
    found = points.groupBy(*KEYS).agg(F.min(F.when(hit, F.col("point_idx"))).alias("point_idx"), F.min("point_idx").alias("first"))
    bad = F.col("point_idx").isNull() | (F.col("point_idx") == F.col("first"))
    if strict:
        return found.select(*KEYS, F.when(bad, F.raise_error(F.lit("a cell has no transition")).cast("int")).otherwise(F.col("point_idx")).alias("point_idx"))
    return found.filter(~bad).select(*KEYS, "point_idx")


def nearest_index(points: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Index of each cell's point closest to the case's landmark (case_id, label, x, y, z), the first on ties."""
    marks = landmarks.select("case_id", "label", *(F.col(n).alias(f"m{n}") for n in "xyz"))
    j = points.join(marks, "case_id").withColumn("distance", dist(vec(), vec("m")))
    return j.groupBy(*KEYS, "label").agg(F.min_by("point_idx", F.struct("distance", "point_idx")).alias("point_idx"), F.min("distance").alias("distance"))


def span_mask(points: DataFrame, centres: DataFrame, width: float = 25.0) -> DataFrame:
    """Adds inside: whether arc lies from a quarter of ``width`` before to three quarters after the
    centre's arc (keys, centre)."""
    return points.join(centres, KEYS, "left").withColumn("inside", F.coalesce((F.col("arc") >= F.col("centre") - width / 4) & (F.col("arc") <= F.col("centre") + 3 * width / 4), F.lit(False)))


def pchip(points: DataFrame, x: str, y: str, keep: Column, out: str) -> DataFrame:
    """Adds ``out``: monotone cubic interpolation of y over x through the kept rows, extended beyond them
    by the first and last piece. Cells with fewer than four kept rows are an error."""
    kept = points.filter(keep).select(*KEYS, "point_idx", F.col(x).alias("_x"), F.col(y).alias("_y"))
    kept = kept.withColumns({"_h": F.lead("_x").over(order()) - F.col("_x"), "_m": (F.lead("_y").over(order()) - F.col("_y")) / (F.lead("_x").over(order()) - F.col("_x"))})
    kept = kept.withColumns({"_h0": F.lag("_h").over(order()), "_m0": F.lag("_m").over(order()), "_h2": F.lead("_h").over(order()), "_m2": F.lead("_m").over(order()), "_hb": F.lag("_h", 2).over(order()), "_mb": F.lag("_m", 2).over(order()), "_n": F.count(F.lit(1)).over(whole())})
    w1, w2 = 2 * F.col("_h") + F.col("_h0"), F.col("_h") + 2 * F.col("_h0")
    inner = F.when(F.col("_m0") * F.col("_m") > 0, (w1 + w2) / F.nullif(w1 / F.nullif(F.col("_m0"), F.lit(0.0)) + w2 / F.nullif(F.col("_m"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)

    def end(h: str, h2: str, m: str, m2: str) -> Column:
        d = ((2 * F.col(h) + F.col(h2)) * F.col(m) - F.col(h) * F.col(m2)) / (F.col(h) + F.col(h2))
        return F.when(F.signum(d) != F.signum(F.col(m)), 0.0).when((F.signum(F.col(m)) != F.signum(F.col(m2))) & (F.abs(d) > 3 * F.abs(F.col(m))), 3 * F.col(m)).otherwise(d)

    slope = F.when(F.col("_h0").isNull(), end("_h", "_h2", "_m", "_m2")).when(F.col("_h").isNull(), end("_h0", "_hb", "_m0", "_mb")).otherwise(inner)
    kept = kept.withColumn("_s", F.when(F.col("_n") < 4, F.raise_error(F.lit("fewer than four rows to interpolate")).cast("double")).otherwise(slope))
    kept = kept.withColumns({"_x2": F.lead("_x").over(order()), "_y2": F.lead("_y").over(order()), "_s2": F.lead("_s").over(order())})
    piece = kept.filter("_x2 is not null").select(*KEYS, "point_idx", F.struct("_x", "_y", "_s", "_x2", "_y2", "_s2").alias("_piece"))
    rows = points.join(piece, [*KEYS, "point_idx"], "left")
    rows = rows.withColumn("_piece", F.coalesce(F.last("_piece", ignorenulls=True).over(up_to()), F.first("_piece", ignorenulls=True).over(after())))
    g = lambda n: F.col(f"_piece.{n}")
    h = g("_x2") - g("_x")
    t = (F.col(x) - g("_x")) / h
    value = (2 * t * t * t - 3 * t * t + 1) * g("_y") + (t * t * t - 2 * t * t + t) * h * g("_s") + (3 * t * t - 2 * t * t * t) * g("_y2") + (t * t * t - t * t) * h * g("_s2")
    return rows.withColumn(out, value).drop("_piece")


def bulb_mask(points: DataFrame, residual: str, inside: str, proximal: float = 0.5, distal: float = 0.2, extend: int = 1) -> DataFrame:
    """Adds bulb: from the first row inside the span whose residual exceeds ``proximal`` to the last one
    that exceeds ``distal``, and ``extend`` rows more."""
    r = F.when(F.col(inside), F.abs(F.col(residual)))
    place = F.row_number().over(order())
    df = points.withColumn("_r", place)
    first = F.min(F.when(r > proximal, F.col("_r"))).over(whole())
    last = F.max(F.when(r > distal, F.col("_r"))).over(whole())
    df = df.withColumns({"_a": first, "_b": last})
    return df.withColumn("bulb", F.coalesce((F.col("_r") >= F.col("_a")) & (F.col("_r") <= F.col("_b") + extend), F.lit(False))).drop("_r", "_a", "_b")


def resample_linear(points: DataFrame, step: float) -> DataFrame:
    """ceil(L / step) + 1 points at equal arc steps with both ends kept, coordinates and radius between
    neighbours in proportion. Cells of length <= step or fewer than two points are unchanged."""
    nxt = {f"_{c}2": F.lead(c).over(order()) for c in ("arc", "x", "y", "z", "radius")}
    lines = arc_length(points.select(*KEYS, "point_idx", *"xyz", "radius")).withColumns({**nxt, "_len": F.max("arc").over(whole()), "_n": F.count(F.lit(1)).over(whole())})
    longer = F.coalesce((F.col("_len") > step) & (F.col("_n") >= 2), F.lit(False))
    arc, after, count = F.col("arc"), F.col("_arc2"), F.ceil(F.col("_len") / step)
    grid = F.when(F.coalesce(after > arc, F.lit(False)), _grid(arc, after, F.col("_len"), count))
    rows = lines.withColumns({"_longer": longer, "_i": F.explode(F.when(longer, grid).otherwise(F.array(F.lit(None).cast("bigint"))))})
    t = F.least(F.lit(1.0), (F.col("_len") * F.col("_i") / count - arc) / (after - arc))
    value = lambda c: F.col(c) + t * (F.col(f"_{c}2") - F.col(c))
    own = lambda made, c: F.when(F.col("_longer"), made).otherwise(F.col(c)).alias(c)
    return rows.select(*KEYS, own(F.col("_i").cast("int"), "point_idx"), *(own(value(c), c) for c in "xyz"), own(F.greatest(F.lit(0.0), value("radius")), "radius"))


def _grid(low: Column, high: Column, length: Column, count: Column) -> Column:
    """Numbers i, of 0..count, of the grid points at length * i / count that lie on the piece from ``low`` up to ``high``; the last
    piece of a line has its end, too. Pieces follow each other without gaps, so each number is in one of them."""
    at = lambda i: length * i / count
    first, last = F.greatest(F.floor(low / length * count) - 1, F.lit(0)), F.least(F.ceil(high / length * count) + 1, count)
    return F.filter(F.sequence(first.cast("bigint"), last.cast("bigint")), lambda i: (at(i) >= low) & ((at(i) < high) | (high >= length)))


def resample_cubic(points: DataFrame, step: float) -> DataFrame:
    """As resample_linear, by the interpolating spline through a cell's points over their arc length: cubic
    (not-a-knot) with four points or more, a parabola with three, a straight line with two; the radius is
    a cubic with four points or more, linear otherwise, and not below 0. Points that repeat the one before
    are left out of the fit. Cells of length <= step, and those whose length isn't finite, are unchanged. The slopes at the
    points come from a tridiagonal system; a task solves those of all cells of a batch at once."""
    return grid_points(spline_pieces(points, step))


PLACE = ["x", "y", "z", "radius"]
#: Grid points of one row of pieces at most.
MADE = 10_000
#: What a piece's lost says besides, a bit for each column of PLACE, which of its cell's columns have a NULL: the radius goes straight.
STRAIGHT = 1 << len(PLACE)


def spline_pieces(points: DataFrame, step: float, most: int = MADE) -> DataFrame:
    """What resample_cubic makes its points of, in rows of about the same number as the given ones: keys, point_idx (of the
    first point), made (number of points), lost, and of a piece of a spline its arc length (low, wide), the whole length and
    count of steps of its cell, places and slopes at its beginning and end (x, x_2, x_d, x_d2 ..). Rows that stay as they are,
    and a line's ends, have made 1 and no low."""
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in KEYS)
    rows = points.select(*KEYS, F.col("point_idx").cast("int").alias("point_idx"), *(F.col(c).cast("double").alias(c) for c in PLACE))
    schema = f"{kinds}, point_idx int, {', '.join(f'{c} double' for c in PLACE)}, {', '.join(f'{c} {t}' for c, t in PIECE.items())}"
    return in_groups(rows, KEYS, ["point_idx"], lambda rows, begin: _splines(rows, begin, step, most), schema)


#: Columns that only pieces have.
PIECE = {"made": "int", "lost": "int", "low": "double", "wide": "double", "length": "double", "count": "bigint"} | {f"{c}{end}": "double" for end in ("_2", "_d", "_d2") for c in PLACE}


def grid_points(pieces: DataFrame) -> DataFrame:
    """The points of spline_pieces, made in place: rows stay in the exchange that they are in."""
    rows = pieces.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("made") - 1)))
    rows = rows.withColumn("point_idx", (F.col("point_idx") + F.col("_i")).cast("int"))
    rows = rows.withColumn("_t", (F.col("length") * F.col("point_idx") / F.col("count") - F.col("low")) / F.col("wide"))
    t, h, kept = F.col("_t"), F.col("wide"), F.col("low").isNull()
    lost = lambda bit: F.col("lost").bitwiseAND(bit) != 0

    def spline(c: str) -> Column:
        v0, v1, d0, d1 = (F.col(f"{c}{end}") for end in ("", "_2", "_d", "_d2"))
        return (2 * t * t * t - 3 * t * t + 1) * v0 + (t * t * t - 2 * t * t + t) * h * d0 + (3 * t * t - 2 * t * t * t) * v1 + (t * t * t - t * t) * h * d1

    made = {c: spline(c) for c in PLACE}
    made["radius"] = F.when(lost(STRAIGHT), F.col("radius") + t * (F.col("radius_2") - F.col("radius"))).otherwise(made["radius"])
    rows = rows.withColumns({f"_{c}": v for c, v in made.items()})
    gone = {c: lost(1 << q) & F.isnan(f"_{c}") for q, c in enumerate(PLACE)}
    value = {c: F.when(~gone[c], F.col(f"_{c}")) for c in "xyz"} | {"radius": F.when(gone["radius"], 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_radius")))}
    return rows.select(*KEYS, "point_idx", *(F.when(kept, F.col(c)).otherwise(value[c]).alias(c) for c in PLACE))


def _rows(keys: pa.Table, point_idx: np.ndarray, places: list[pa.Array], made: np.ndarray, **piece: np.ndarray) -> pa.Table:
    """Rows of spline_pieces."""
    n, kinds = keys.num_rows, {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    rest = {"made": made} | piece
    columns = [pa.array(rest[c], kinds[t]) if c in rest else pa.nulls(n, kinds[t]) for c, t in PIECE.items()]
    return pa.table([*keys.columns, pa.array(point_idx, pa.int32()), *places, *columns], [*KEYS, "point_idx", *PLACE, *PIECE])


def _splines(rows: pa.Table, begin: np.ndarray, step: float, most: int) -> Iterator[pa.Table]:
    columns, sizes = [numbers(rows, c) for c in PLACE], np.diff(begin)
    value, null = np.stack([c[0] for c in columns], 1), np.stack([c[1] for c in columns], 1)
    short = np.ones(rows.num_rows, bool)
    for own in by_size(sizes):
        at, size = padded(begin[own], sizes[own]), sizes[own]
        steps = np.zeros(at.shape)
        d = value[at[:, 1:], :3] - value[at[:, :-1], :3]
        with np.errstate(all="ignore"):
            steps[:, 1:] = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
        hole = null[:, :3].any(1)[at]
        steps[:, 1:][hole[:, 1:] | hole[:, :-1]] = 0.0  # the distance to a point without a place counts as 0
        arc = np.cumsum(steps, 1)
        kept = np.concatenate([np.ones((len(own), 1), bool), arc[:, 1:] > arc[:, :-1]], 1) & (np.arange(at.shape[1]) < size[:, None])
        longer = np.isfinite(arc[:, -1]) & (arc[:, -1] > step) & (kept.sum(1) >= 2)
        if not longer.any():
            continue
        cells, kept, n = at[longer], kept[longer], kept[longer].sum(1)
        short[cells[np.arange(cells.shape[1]) < size[longer][:, None]]] = False
        ends = np.stack([cells[:, 0], cells[:, -1]], 1)
        line, knot = np.nonzero(kept)
        row, s, first = cells[line, knot], arc[longer][line, knot], np.concatenate([[0], np.cumsum(n)[:-1]])
        for group in by_size(n):
            yield from _pieces(rows, value, null, row, s, first[group], n[group], ends[group], arc[longer][group, -1], step, most)
    if short.any():
        kept = rows.filter(pa.array(short))
        places = [kept.column(c).combine_chunks() for c in PLACE]
        yield _rows(kept.select(KEYS), kept.column("point_idx").to_numpy(), places, np.ones(kept.num_rows, np.int64))


def _pieces(rows: pa.Table, value: np.ndarray, null: np.ndarray, row: np.ndarray, s: np.ndarray, first: np.ndarray, n: np.ndarray, ends: np.ndarray, length: np.ndarray, step: float, most: int) -> Iterator[pa.Table]:
    """Ends and pieces of splines through n rows each, which begin at ``first`` of row and s (place in arc length)."""
    at = padded(first, n)
    v, arc, gone = value[row[at]], s[at], null[row[at]].any(1)
    d = _slopes(arc, v, n)
    count = np.ceil(length / step).astype(np.int64)
    lost = gone @ (1 << np.arange(len(PLACE))) + np.where(n < 4, STRAIGHT, 0)
    for end, number in ((ends[:, 0], np.zeros(len(n), np.int64)), (ends[:, 1], count)):
        yield _rows(rows.select(KEYS).take(pa.array(end)), number, [column(value[end, q], null[end, q]) for q in range(len(PLACE))], np.ones(len(n), np.int64))
    # pieces, and the first grid point of each, between a line's ends
    cell, i = np.nonzero(np.arange(at.shape[1] - 1) < n[:, None] - 1)
    low = arc[cell, i]
    begin = np.maximum(np.ceil(low / length[cell] * count[cell]).astype(np.int64) - 1, 0)
    for _ in range(2):
        begin += length[cell] * begin / count[cell] < low
    after = np.where(i == n[cell] - 2, count[cell], np.append(begin[1:], 0))
    begin, after = np.maximum(begin, 1), np.minimum(after, count[cell])
    parts = np.maximum(-((begin - after) // most), 0)
    p = np.repeat(np.arange(len(cell)), parts)
    begin = begin[p] + most * (np.arange(len(p)) - np.repeat(np.cumsum(parts) - parts, parts))
    made = np.minimum(after[p] - begin, most)
    c, j = cell[p], i[p]
    bounds = {f"{name}{end}": x[c, j + k, q] for end, x, k in (("_2", v, 1), ("_d", d, 0), ("_d2", d, 1)) for q, name in enumerate(PLACE)}
    keys = rows.select(KEYS).take(pa.array(ends[c, 0]))
    yield _rows(keys, begin, [pa.array(v[c, j, q]) for q in range(len(PLACE))], made, lost=lost[c], low=arc[c, j], wide=arc[c, j + 1] - arc[c, j], length=length[c], count=count[c], **bounds)


def _slopes(arc: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Slopes of the splines at their points: lines of points, values in four columns, n points a line."""
    out, wide = np.zeros(v.shape), arc.shape[1]
    with np.errstate(all="ignore"):
        h = np.diff(arc, axis=1)
        m = np.diff(v, axis=1) / h[..., None]
        two, three, more = (np.flatnonzero(x) for x in (n == 2, n == 3, n >= 4))
        out[two] = m[two][:, :1]
        if len(three):
            h0, h1, m0, m1 = h[three, 0, None], h[three, 1, None], m[three, 0], m[three, 1]
            bend = np.where(np.arange(4) < 3, (m1 - m0) / (h0 + h1), 0.0)
            out[three, 0], out[three, 1], out[three, 2] = m0 - bend * h0, m0 + bend * h0, m1 + bend * h1
        if len(more):
            # rows a d[i-1] + b d[i] + c d[i+1] = r, not-a-knot at both ends; eliminated forwards, solved backwards
            h, m, n, each = h[more], m[more], n[more], np.arange(len(more))
            h0, h1 = h[:, 0, None], h[:, 1, None]
            c, r = np.zeros((len(more), wide)), np.zeros((len(more), wide, 4))
            c[:, 0] = ((h0 + h1) / h1)[:, 0]
            r[:, 0] = ((h0 + 2 * (h0 + h1)) * h1 * m[:, 0] + h0 * h0 * m[:, 1]) / (h0 + h1) / h1
            for i in range(1, wide - 1):
                a, b = h[:, i], 2 * (h[:, i - 1] + h[:, i])
                w = (b - a * c[:, i - 1])[:, None]
                right = 3 * (h[:, i, None] * m[:, i - 1] + h[:, i - 1, None] * m[:, i])
                c[:, i], r[:, i] = h[:, i - 1] / w[:, 0], (right - a[:, None] * r[:, i - 1]) / w
            last = n - 1
            g0, g1 = h[each, last - 1, None], h[each, last - 2, None]
            k0, k1 = m[each, last - 1], m[each, last - 2]
            right = (g0 * g0 * k1 + (2 * (g0 + g1) + g0) * g1 * k0) / (g0 + g1)
            w = g1 - (g0 + g1) * c[each, last - 1, None]
            d = np.zeros((len(more), wide, 4))
            d[each, last] = (right - (g0 + g1) * r[each, last - 1]) / w
            for i in range(wide - 2, -1, -1):
                d[:, i] = np.where((i < last)[:, None], r[:, i] - c[:, i, None] * d[:, i + 1], d[:, i])
            out[more] = d
    return out


def neighbour_points(points: DataFrame) -> DataFrame:
    """Adds near: indices of a point and up to two neighbours to either side."""
    return points.withColumn("near", F.collect_list("point_idx").over(order().rowsBetween(-2, 2)))


def fill_invalid(points: DataFrame, column: str) -> DataFrame:
    """Replace NULL, NaN and infinite values by the last valid value before, at the start by the next one, else 0."""
    c = F.col(column).cast("double")
    valid = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return points.withColumn("_v", valid).withColumn(column, F.coalesce("_v", F.last("_v", ignorenulls=True).over(up_to()), F.first("_v", ignorenulls=True).over(after()), F.lit(0.0))).drop("_v")


def clean_outliers(points: DataFrame, column: str, factor: float = 1.5, least: int = 4) -> DataFrame:
    """Points of cells with at least ``least`` rows whose mean difference to their neighbours exceeds
    ``factor`` times the cell's mean difference get the parabola through the three nearest good rows
    around them (two before, one after); where those are missing, the value stays."""
    c = F.col(column)
    before, after = F.lag(c).over(order()), F.lead(c).over(order())
    apart = (F.coalesce(F.abs(c - before), F.abs(after - c)) + F.coalesce(F.abs(after - c), F.abs(c - before))) / 2
    df = points.withColumn("_apart", apart).withColumn("_n", F.count(F.lit(1)).over(whole())).withColumn("_r", F.row_number().over(order()).cast("double"))
    df = df.withColumn("outlier", F.coalesce((F.col("_n") >= least) & (F.col("_apart") > factor * F.avg("_apart").over(whole())), F.lit(False)))
    good = F.when(~F.col("outlier"), F.struct(F.col("_r").alias("r"), c.alias("v")))
    past = order().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_g", good).withColumn("_p1", F.last("_g", ignorenulls=True).over(past)).withColumn("_q", F.first("_g", ignorenulls=True).over(order().rowsBetween(1, Window.unboundedFollowing)))
    df = df.withColumn("_pair", F.when(F.col("_g").isNotNull(), F.struct("_p1"))).withColumn("_p2", F.last("_pair", ignorenulls=True).over(past)["_p1"])
    r = F.col("_r")
    a, b, d = F.col("_p2"), F.col("_p1"), F.col("_q")
    lagrange = (
        a["v"] * (r - b["r"]) * (r - d["r"]) / ((a["r"] - b["r"]) * (a["r"] - d["r"])) + b["v"] * (r - a["r"]) * (r - d["r"]) / ((b["r"] - a["r"]) * (b["r"] - d["r"])) + d["v"] * (r - a["r"]) * (r - b["r"]) / ((d["r"] - a["r"]) * (d["r"] - b["r"]))
    )
    return df.withColumn(column, F.when(F.col("outlier"), F.coalesce(lagrange, c)).otherwise(c)).drop("_apart", "_n", "_r", "_g", "_pair", "_q", "_p1", "_p2")
