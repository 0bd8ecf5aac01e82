"""Cohort joins, checks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubula.functions.geom import axis_codes, dist, to_ras
from tubula.functions.runtime import cut_lineage, discard


def collect_features(cohort: DataFrame, features: DataFrame, long_features: DataFrame) -> DataFrame:
    """Cohort rows (case_id, side) with the features (case_id, path_id, ...) of their side's path, and
    those of the side's long path where there are any, renamed with _ica."""
    own = cohort.withColumn("path_id", F.concat(F.col("side"), F.lit("-occlusion")))
    more = long_features.select("case_id", F.col("path_id").alias("_long"), *(F.col(c).alias(f"{c}_ica") for c in long_features.columns if c not in ("case_id", "path_id")))
    return own.join(features, ["case_id", "path_id"]).withColumn("_long", F.concat(F.col("side"), F.lit("-ica"))).join(more, ["case_id", "_long"], "left").drop("_long")


def not_collected(files: DataFrame, features: DataFrame) -> DataFrame:
    return files.select("case_id").distinct().join(features, "case_id", "left_anti")


def pending(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Cases (case_id, settings) without a complete run of equal settings. runs: case_id, settings, complete."""
    return cases.join(runs.filter("complete").select("case_id", "settings"), ["case_id", "settings"], "left_anti")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def range_findings(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values outside plausible ranges (feature, low, high): case_id, feature, value, low, high. Text
    that isn't a number counts as missing."""
    names = [c for c in df.columns if c != "case_id"]
    long = df.select("case_id", *(F.col(c).cast("string").try_cast("double").alias(c) for c in names)).unpivot("case_id", names, "feature", "value")
    return long.join(ranges, "feature").filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).select("case_id", "feature", "value", "low", "high")


def medians(long: DataFrame, key: str = "feature", value: str = "value", reach: float = 1e-3, most: int = 50_000, steps: int = 200) -> DataFrame:
    """Exact medians of the values of each key, with bounded state: approximate quantiles just below and above the middle bracket
    the median (their rank error is a tenth of ``reach``), and values below the bracket are counted. While more than
    ``most`` values lie inside the bracket of any key, ``steps`` quantiles of these narrow it, to about 4 / steps of them a
    round whatever their distribution; repeated values at its ends count as one. Only what a bracket holds then is put in
    order. Returns the key, n, median and varied (whether there are more than two distinct values)."""
    v = F.col(value)
    long = long.select(key, value).filter(v.isNotNull())
    first = long.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.percentile_approx(v, F.array(F.lit(0.5 - reach), F.lit(0.5 + reach)), F.lit(int(10 / reach))).alias("_q"))
    state = _counted(long, first.select(key, "n", "_min", "_max", F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high")), key, v)
    while state.filter(F.col("_inside") > most).limit(1).count():
        wide = F.col("_inside") > most
        narrow = _counted(long, _narrower(long, state.filter(wide), key, v, steps), key, v)
        old, state = state, cut_lineage(narrow.unionByName(state.filter(~wide)))
        discard(old, narrow)
    own = long.join(state, key).filter(v.between(F.col("_low"), F.col("_high")))
    ranked = own.groupBy(key, "n", "varied", "_below", v.alias("_v")).agg(F.count(F.lit(1)).alias("_m")).withColumn("_upto", F.col("_below") + F.sum("_m").over(Window.partitionBy(key).orderBy("_v")))
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    low, high = _middle_ranks()
    return ranked.groupBy(key, "n", "varied").agg(((at(low) + at(high)) / 2).alias("median"))


def _middle_ranks() -> tuple[Column, Column]:
    """The two middle ranks of n values, from 1; the same one for odd n."""
    return F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1


def _counted(long: DataFrame, brackets: DataFrame, key: str, v: Column) -> DataFrame:
    """Brackets with the number of values below, at the lower end, and strictly inside, stored."""
    low, high, held = F.col("_low"), F.col("_high"), [c for c in brackets.columns if c not in (key, "_low", "_high")]
    bounds = cut_lineage(brackets)
    counts = [F.count_if(v < low).alias("_below"), F.count_if(v == low).alias("_at"), F.count_if((v > low) & (v < high)).alias("_inside"), F.bool_or((v > F.col("_min")) & (v < F.col("_max"))).alias("varied")]
    out = cut_lineage(long.join(bounds.drop("varied"), key).groupBy(key).agg(*(F.first(c).alias(c) for c in held if c != "varied"), F.first(low).alias("_low"), F.first(high).alias("_high"), *counts))
    discard(bounds)
    return out


def _narrower(long: DataFrame, state: DataFrame, key: str, v: Column, steps: int) -> DataFrame:
    """Narrower brackets of keys: the quantiles of what lies inside that surround the middle ranks."""
    inside = long.join(state, key).filter((v > F.col("_low")) & (v < F.col("_high")))
    grid = inside.groupBy(key).agg(F.percentile_approx(v, F.array(*(F.lit(i / steps) for i in range(steps + 1))), F.lit(10 * steps)).alias("_q"))
    low, high = ((rank - F.col("_below") - F.col("_at")) / F.col("_inside") * steps for rank in _middle_ranks())
    under, over = F.floor(low).cast("int") - 1, F.ceil(high).cast("int") + 1
    new_low = F.when(under > 0, F.get("_q", F.least(under, F.lit(steps)))).otherwise(F.col("_low"))
    new_high = F.when(over < steps, F.get("_q", F.greatest(over, F.lit(1)))).otherwise(F.col("_high"))
    return state.join(grid, key).select(key, "n", "_min", "_max", new_low.alias("_l"), new_high.alias("_high")).withColumnRenamed("_l", "_low")


def mad_outliers(long: DataFrame, limit: float = 3.5, least: int = 8, flagged: DataFrame | None = None) -> DataFrame:
    """Modified z-scores .6745 (x - median) / MAD beyond the limit, for features with at least ``least``
    values, more than two distinct ones and MAD > 0, without findings that are flagged already."""
    long = long.filter("value is not null")
    m = medians(long).filter((F.col("n") >= least) & F.col("varied")).select("feature", "median")
    j = long.join(m, "feature")
    mad = medians(j.select("feature", F.abs(F.col("value") - F.col("median")).alias("value"))).select("feature", F.col("median").alias("mad")).filter("mad > 0")
    out = j.join(mad, "feature").withColumn("z", 0.6745 * (F.col("value") - F.col("median")) / F.col("mad")).filter(F.abs("z") > limit).select("case_id", "feature", "value", "z")
    return out.join(flagged.select("case_id", "feature"), ["case_id", "feature"], "left_anti") if flagged is not None else out


def missing_outputs(cases: DataFrame, files: DataFrame, expected: list[str]) -> DataFrame:
    """Expected names that a case doesn't have."""
    want = cases.select("case_id", F.explode(F.array(*map(F.lit, expected))).alias("name"))
    return want.join(files.select("case_id", "name"), ["case_id", "name"], "left_anti")


def min_size(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys with at least n rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)


def availability(report: DataFrame, artefacts: list[str]) -> DataFrame:
    """For each artefact: present, applicable (not NULL), and the missing cases in order."""
    long = report.select("case_id", *artefacts).unpivot("case_id", artefacts, "artefact", "there")
    return long.groupBy("artefact").agg(F.count_if("there").alias("present"), F.count("there").alias("applicable"), F.array_sort(F.collect_list(F.when(~F.col("there"), F.col("case_id")))).alias("missing"))


def run_outcomes(results: DataFrame) -> DataFrame:
    """What became of each case (case_id, status): case_id, outcome. A status that begins with "error" is failed, "skipped" is
    skipped, any other and none is processed."""
    status = F.lower(F.coalesce(F.col("status"), F.lit("")))
    return results.select("case_id", F.when(status.startswith("error"), "failed").when(status == "skipped", "skipped").otherwise("processed").alias("outcome"))


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of a run in one row: cases, processed, skipped, failed, and the share of those not skipped that didn't fail (NULL
    if all were skipped). The cases themselves are the rows of run_outcomes."""
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    g = run_outcomes(results).agg(F.count(F.lit(1)).alias("cases"), *(is_(k).alias(k) for k in ("processed", "skipped", "failed")))
    return g.withColumn("share", F.try_divide("processed", F.col("processed") + F.col("failed")))


def findings_report(ranges: DataFrame, outliers: DataFrame) -> DataFrame:
    """Findings of both kinds, range first: rank, kind, case_id, feature, value."""
    a = ranges.select(F.lit(1).alias("rank"), F.lit("range").alias("kind"), "case_id", "feature", "value")
    b = outliers.select(F.lit(2).alias("rank"), F.lit("outlier").alias("kind"), "case_id", "feature", "value")
    return a.unionByName(b)


def stage_done(files: DataFrame, required: list[list[str]]) -> DataFrame:
    """Whether a case has one name of every list."""
    return files.groupBy("case_id").agg(F.every(F.lit(True)).alias("_t"), *(F.bool_or(F.col("name").isin(*own)).alias(f"_r{i}") for i, own in enumerate(required))).select("case_id", _all([F.col(f"_r{i}") for i in range(len(required))]).alias("done"))


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def normalize(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Values of features by the rule in the statistics table (feature, mean, std, min, max, rule; one row a
    feature): zscore, minmax, center, or none."""
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    m = F.try_divide(F.col("value") - F.col("min"), F.col("max") - F.col("min"))
    return long.join(stats, "feature").withColumn("normal", F.when(F.col("rule") == "zscore", z).when(F.col("rule") == "minmax", m).when(F.col("rule") == "center", F.col("value") - F.col("mean")).otherwise(F.col("value"))).select(*long.columns, "normal")


def vector_norm(long: DataFrame, keys: list[str], value: str = "value", out: str = "unit") -> DataFrame:
    """Adds ``out``: values divided by the length of the vector that all values of a key make, NULL if that is 0."""
    size = long.groupBy(*keys).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_size"))
    return long.join(size, keys).withColumn(out, F.try_divide(F.col(value), F.col("_size"))).drop("_size")


def softmax(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Adds prob: softmax of score over the rows of a key."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col("score") - F.max("score").over(w))
    return scores.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def argmax(scores: DataFrame, keys: list[str], score: str = "prob") -> DataFrame:
    """The class with the highest score of each key, the first on ties."""
    return scores.groupBy(*keys).agg(F.max_by("class", F.struct(F.col(score), -F.col("class"))).alias("class"), F.max(score).alias(score))


def ensemble_vote(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Class with the highest mean probability over folds."""
    return argmax(scores.groupBy(*keys, "class").agg(F.avg("prob").alias("prob")), keys)


def ensemble_stats(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.groupBy(*keys).agg(F.avg("prob").alias("mean"), F.stddev_pop("prob").alias("std"))


def displacement_stats(df: DataFrame) -> DataFrame:
    """Mean and largest displacement by label."""
    return df.groupBy("label").agg(F.avg("displacement").alias("mean"), F.max("displacement").alias("largest"), F.count(F.lit(1)).alias("n"))


def mirror_fix(wide: DataFrame, left: tuple[float, float], right: tuple[float, float], least: float = 5.0) -> DataFrame:
    """Plausibility of a paired landmark: the side's distance must lie within two deviations of its mean.
    wide: case_id, mid, lx, ly, lz, rx, ry, rz, l_distance, r_distance (y and z may be left out of all). A bad
    side takes the other point mirrored at the plane x = mid if that is good and the point is missing or
    moves more than ``least``."""
    axes = [n for n in "xyz" if f"l{n}" in wide.columns]
    good = lambda c, m: F.coalesce(F.col(c).between(m[0] - 2 * m[1], m[0] + 2 * m[1]), F.lit(False))
    gl, gr = good("l_distance", left), good("r_distance", right)
    point = lambda s: tuple(F.col(f"{s}{n}") if n in axes else F.lit(0.0) for n in "xyz")
    mirrored = lambda p: (2 * F.col("mid") - p[0], p[1], p[2])
    moved = lambda new, old: F.coalesce(dist(new, old) > least, F.lit(True))
    ml, mr = mirrored(point("r")), mirrored(point("l"))
    fl, fr = ~gl & gr & moved(ml, point("l")), ~gr & gl & moved(mr, point("r"))
    pick = lambda flag, new, s: [F.when(flag, v).otherwise(F.col(f"{s}{n}")).alias(f"{s}{n}") for v, n in zip(new, "xyz", strict=True) if n in axes]
    return wide.select("case_id", *pick(fl, ml, "l"), *pick(fr, mr, "r"), (fl | fr).alias("mirrored"))


def landmark_pairs(landmarks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Named paths (path_id, a, b) of the cases that have both landmarks."""
    side = lambda s: landmarks.select("case_id", F.col("label").alias(s), *(F.col(n).alias(f"{s}{n}") for n in "xyz"))
    return pairs.join(side("a"), "a").join(side("b"), ["case_id", "b"])


def bulb_landmark(transitions: DataFrame, landmarks: DataFrame, names: dict[str, str]) -> DataFrame:
    """The bulb landmark of each vessel, or the vessel's label transition where it is missing or at the
    origin: case_id, vessel, x, y, z, how. transitions: case_id, vessel, x, y, z."""
    table = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
    m = landmarks.filter("not (x = 0 and y = 0 and z = 0)").select("case_id", F.col("label").alias("_l"), F.struct(*"xyz").alias("_m"))
    j = transitions.withColumn("_l", F.try_element_at(table, F.col("vessel"))).join(m, ["case_id", "_l"], "left")
    return j.select("case_id", "vessel", *(F.coalesce(F.col(f"_m.{n}"), F.col(n)).alias(n) for n in "xyz"), F.when(F.col("_m").isNotNull(), "landmark").otherwise("transition").alias("how"))


#: Voxel of the reference corner on the first axis for an image of RAS, LAS or LPS, and the spacing (mm) that it holds for:
#: fixed values.
CORNER_VOXEL, CORNER_SPACING = {"RAS": 150.0, "LAS": 350.0, "LPS": 350.0}, 0.43


def reference_corner(images: DataFrame) -> DataFrame:
    """Point near the far end of the arch in the lowest slice of each image (case_id, affine of 16 values, size_y): a number of
    voxels along the first axis that goes with the orientation, scaled to the image's spacing, and for LPS the far side
    of the second axis. Other orientations are an error. Returns case_id, x, y, z."""
    code = axis_codes(F.col("affine"))
    factor = F.abs(F.lit(CORNER_SPACING) / F.col("affine")[0])
    i = F.lit(None).cast("double")
    for name, voxel in CORNER_VOXEL.items():
        i = F.when(code == name, F.lit(voxel) * factor).otherwise(i)
    i = F.coalesce(i, F.raise_error(F.concat(F.lit("orientation "), code)).cast("double"))
    j = F.when(code == "LPS", F.col("size_y").cast("double")).otherwise(0.0)
    return images.select("case_id", *(c.alias(n) for n, c in zip("xyz", to_ras(i, j, F.lit(0.0), F.col("affine")), strict=True)))
