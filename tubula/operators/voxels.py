"""Operators on sparse voxels (case_id, i, j, k, value): only the foreground has rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubula.functions.geom import dist, to_ras
from tubula.operators.components import star_components

IJK = ["case_id", "i", "j", "k"]


def threshold(voxels: DataFrame, t: float) -> DataFrame:
    """Voxels whose value is at least t, as a mask of ones."""
    return voxels.filter(F.col("value") >= t).withColumn("value", F.lit(1.0))


def bounding_box(voxels: DataFrame) -> DataFrame:
    """Smallest and largest index of each axis."""
    return voxels.groupBy("case_id").agg(*(f(n).alias(f"{n}_{s}") for n in "ijk" for f, s in ((F.min, "min"), (F.max, "max"))))


def cut_top(voxels: DataFrame, part: float = 0.9) -> DataFrame:
    """Drop voxels above ``part`` of the foreground's height (index >= the rounded limit)."""
    low, high = (f("k").over(Window.partitionBy("case_id")) for f in (F.min, F.max))
    return voxels.withColumn("_t", F.bround(low + part * (high - low))).filter(F.col("k") < F.col("_t")).drop("_t")


def crop(voxels: DataFrame, box: DataFrame) -> DataFrame:
    """Voxels inside each case's box (case_id, i_min, i_max, ...), indices counted from its corner."""
    j = voxels.join(box, "case_id")
    for n in "ijk":
        j = j.filter(F.col(n).between(F.col(f"{n}_min"), F.col(f"{n}_max"))).withColumn(n, F.col(n) - F.col(f"{n}_min"))
    return j.select(*voxels.columns)


def inside_box(points: DataFrame, images: DataFrame, least: int = 5) -> DataFrame:
    """Whether a cell has at least ``least`` points and all lie in the image's box (case_id, x_min, x_max, ...)."""
    ok = F.lit(True)
    for n in "xyz":
        ok = ok & F.col(n).between(F.col(f"{n}_min"), F.col(f"{n}_max"))
    return points.join(images, "case_id").groupBy("case_id", "cell_id").agg((F.bool_and(ok) & (F.count(F.lit(1)) >= least)).alias("valid"))


def voxel_edges(voxels: DataFrame, connectivity: int = 26) -> DataFrame:
    """Edges between neighbouring voxels, by ids made of their indices: case_id, src, dst."""
    shifts = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0) and (connectivity == 26 or abs(i) + abs(j) + abs(k) == 1)]
    moved = voxels.withColumn("_s", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("abc", s, strict=True))) for s in shifts))))
    other = moved.select("case_id", voxel_id().alias("src"), (F.col("i") + F.col("_s.a")).alias("i"), (F.col("j") + F.col("_s.b")).alias("j"), (F.col("k") + F.col("_s.c")).alias("k"))
    return other.join(voxels.select(*IJK, voxel_id().alias("dst")), IJK).select("case_id", "src", "dst")


def voxel_id() -> Column:
    """One number for an index of up to 2**20 on each axis."""
    return F.col("i").cast("bigint") * (1 << 40) + F.col("j").cast("bigint") * (1 << 20) + F.col("k")


def voxel_components(voxels: DataFrame, connectivity: int = 26) -> DataFrame:
    """Adds component, the smallest id (see voxel_id) of a voxel's connected component."""
    c = star_components(voxel_edges(voxels, connectivity), ["case_id"]).withColumnRenamed("node", "_id")
    return voxels.withColumn("_id", voxel_id()).join(c, ["case_id", "_id"], "left").withColumn("component", F.coalesce("component", "_id")).drop("_id")


def component_filter(labels: DataFrame, least: int = 1, k: int | None = None) -> DataFrame:
    """Components of at least ``least`` voxels, the k largest: case_id, component, n, place."""
    w = Window.partitionBy("case_id").orderBy(F.desc("n"), "component")
    c = labels.groupBy("case_id", "component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).withColumn("place", F.row_number().over(w))
    return c if k is None else c.filter(F.col("place") <= k)


def centroids(labels: DataFrame) -> DataFrame:
    """Mean index of each component."""
    return labels.groupBy("case_id", "component").agg(F.count(F.lit(1)).alias("n"), *(F.avg(n).alias(n) for n in "ijk"))


def dice(a: DataFrame, b: DataFrame, by: list[str] = ()) -> DataFrame:
    """Overlap 2 |A and B| / (|A| + |B|) of two masks for each case (and slice)."""
    keys = ["case_id", *by]
    both = a.select(*IJK).distinct().withColumn("_a", F.lit(1)).join(b.select(*IJK).distinct().withColumn("_b", F.lit(1)), IJK, "full")
    return both.groupBy(*keys).agg((2.0 * F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / (F.count("_a") + F.count("_b"))).alias("dice"))


def stitch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two masks at the slice of the best overlap (the first on ties): slices up to it from a, those above from b."""
    best = dice(a, b, ["k"]).groupBy("case_id").agg(F.min_by("k", F.struct(-F.col("dice"), F.col("k"))).alias("_cut"))
    low = a.select(*IJK).distinct().join(best, "case_id").filter("k <= _cut")
    high = b.select(*IJK).distinct().join(best, "case_id").filter("k > _cut")
    return low.unionByName(high).drop("_cut")


def volume_check(voxels: DataFrame, images: DataFrame) -> DataFrame:
    """Volume and box volume in mm3 against the limits: case_id, volume, box, problem (the first failing
    rule, NULL if none). images: case_id, volume_mm3 (of one voxel)."""
    box = bounding_box(voxels)
    n = voxels.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    j = n.join(box, "case_id").join(images, "case_id")
    v, b = F.col("_n") * F.col("volume_mm3"), (F.col("i_max") - F.col("i_min")) * (F.col("j_max") - F.col("j_min")) * (F.col("k_max") - F.col("k_min")) * F.col("volume_mm3")
    problem = F.when(v < 3.5e4, "volume").when(b < 2.5e6, "box too small").when(b > 3.5e7, "box too large").when((v < 4e4) & (b < 4e6), "volume and box")
    return j.select("case_id", v.alias("volume"), b.alias("box"), problem.alias("problem"))


def keep_or_relocate(points: DataFrame, relocated: DataFrame, mask: DataFrame) -> DataFrame:
    """Points (case_id, label, i, j, k) inside the mask stay; others take the relocated index of their label."""
    inside = points.join(mask.select(*IJK).distinct().withColumn("_in", F.lit(True)), IJK, "left")
    new = relocated.select("case_id", "label", *(F.col(n).alias(f"_{n}") for n in "ijk"))
    return inside.join(new, ["case_id", "label"], "left").select("case_id", "label", *(F.when(F.col("_in"), F.col(n)).otherwise(F.coalesce(f"_{n}", n)).alias(n) for n in "ijk"), F.coalesce("_in", F.lit(False)).alias("inside"))


def relocate_to_component(points: DataFrame, voxels: DataFrame, window: int = 5, rounds: int = 5) -> DataFrame:
    """Move a point (case_id, label, i, j, k) to the centroid of the nearest component among the voxels in
    a window around it; the window grows by its own size for points that find none, ``rounds`` times at
    most, then the point stays: case_id, label, i, j, k, moved."""
    from tubula.functions.runtime import cut_lineage

    labelled = cut_lineage(voxel_components(voxels.select(*IJK).distinct()))
    rest, found = points.select("case_id", "label", *"ijk"), None
    for r in range(1, rounds + 1):
        size = window * r
        cell = lambda n, size=size: F.floor(F.col(n) / size)
        own = rest.select("case_id", "label", *(F.col(n).alias(f"p{n}") for n in "ijk"), *(F.explode(F.array(*(F.floor(F.col(n) / size) + d for d in (-1, 0, 1)))).alias(f"c{n}") for n in "i"))
        for n in "jk":
            own = own.withColumn(f"c{n}", F.explode(F.array(*(F.floor(F.col(f"p{n}") / size) + d for d in (-1, 0, 1)))))
        near = own.join(labelled.withColumns({f"c{n}": cell(n) for n in "ijk"}), ["case_id", "ci", "cj", "ck"])
        for n in "ijk":
            near = near.filter(F.abs(F.col(n) - F.col(f"p{n}")) <= size)
        c = near.groupBy("case_id", "label", "pi", "pj", "pk", "component").agg(*(F.avg(n).alias(n) for n in "ijk"))
        gap = sum(((F.col(n) - F.col(f"p{n}")) * (F.col(n) - F.col(f"p{n}")) for n in "ijk"), F.lit(0.0))
        hit = cut_lineage(c.groupBy("case_id", "label").agg(F.min_by(F.struct(*"ijk"), F.struct(gap, "component")).alias("m")).select("case_id", "label", *(F.col(f"m.{n}").alias(n) for n in "ijk"), F.lit(True).alias("moved")))
        found = hit if found is None else found.unionByName(hit)
        rest = cut_lineage(rest.join(hit.select("case_id", "label"), ["case_id", "label"], "left_anti"))
    return found.unionByName(rest.select("case_id", "label", *(F.col(n).cast("double").alias(n) for n in "ijk"), F.lit(False).alias("moved")))


#: Volume (mm3) of the voxels that the least size of an entry is stated for: a fixed value.
ENTRY_VOXEL = 0.07385254


def entry_points(voxels: DataFrame, ends: DataFrame, images: DataFrame, least: int = 500, radius: float = 30.0) -> DataFrame:
    """Ends of the arch checked against the image's lowest slice (k = 0). Expected entries are the centroids of its components of
    at least ``least`` voxels of 0.43 x 0.43 x 0.4 mm, scaled to the image's voxels, one voxel above the slice. Of the given ends
    (case_id, end_id, x, y, z) nearer than ``radius`` to an entry only the nearest stays (the smallest end_id on ties); an
    end that another entry turns away goes even if it is the nearest of this one. An entry without an end gets one.
    The start is the end nearest to the image's reference corner and changes places with the first. images: case_id, affine of 16
    values, size_y. Returns case_id, place (0 is the start), end_id (NULL if added), component, x, y, z."""
    from tubula.operators.nearest import within
    from tubula.operators.quality import reference_corner

    floor = voxel_components(voxels.filter("k = 0").select(*IJK).distinct())
    a = F.col("affine")
    enough = F.col("n") >= F.abs(F.bround(least * ENTRY_VOXEL / (a[0] * a[5] * a[10])))
    c = centroids(floor).join(images.select("case_id", "affine"), "case_id").filter(enough)
    entries = c.select("case_id", "component", *(v.alias(n) for n, v in zip("xyz", to_ras(F.col("i"), F.col("j"), F.lit(1.0), a), strict=True)))
    near = within(entries, ends.select("case_id", "end_id", *"xyz"), radius).filter(F.col("distance") < radius)
    choice = near.select("case_id", F.col("a.component").alias("component"), F.col("b.end_id").alias("end_id"), F.row_number().over(Window.partitionBy("case_id", "a.component").orderBy("distance", "b.end_id")).alias("_r"))
    away = choice.filter("_r > 1").select("case_id", "end_id").distinct()
    own = choice.filter("_r = 1").groupBy("case_id", "end_id").agg(F.min("component").alias("component"))
    kept = ends.select("case_id", "end_id", *"xyz").join(away, ["case_id", "end_id"], "left_anti").join(own, ["case_id", "end_id"], "left")
    added = entries.join(choice, ["case_id", "component"], "left_anti").withColumn("end_id", F.lit(None).cast(ends.schema["end_id"].dataType))
    corner = reference_corner(images).select("case_id", *(F.col(n).alias(f"c{n}") for n in "xyz"))
    w = Window.partitionBy("case_id")
    placed = kept.unionByName(added).withColumn("_i", F.row_number().over(w.orderBy(F.col("end_id").isNull(), "end_id", "component")) - 1).join(corner, "case_id")
    gap = dist(tuple(F.col(n) for n in "xyz"), tuple(F.col(f"c{n}") for n in "xyz"))
    start = placed.withColumn("_s", F.min_by("_i", F.struct(gap, "_i")).over(w))
    place = F.when(F.col("_i") == F.col("_s"), 0).when(F.col("_i") == 0, F.col("_s")).otherwise(F.col("_i"))
    return start.select("case_id", place.alias("place"), "end_id", "component", *"xyz")
