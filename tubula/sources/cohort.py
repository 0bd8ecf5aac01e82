"""Readers and writers of cohort tables, landmarks and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean_id(c: Column) -> Column:
    """Ids as text without a trailing ".0"."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def read_cohort(spark: SparkSession, path: str, id_aliases: list[str], side_aliases: list[str]) -> DataFrame:
    """A CSV table with one row per case; the id and side columns are found under any of their names."""
    df = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in df.columns}
    found = [next((names[a.lower()] for a in aliases if a.lower() in names), None) for aliases in (id_aliases, side_aliases)]
    if found[0] is None:
        raise ValueError(f"none of the id columns {id_aliases} is there")
    side = side_alias(F.col(found[1])) if found[1] else F.lit(None).cast("string")
    rest = [c for c in df.columns if c not in found]
    return df.select(clean_id(F.col(found[0])).alias("case_id"), side.alias("side"), *rest)


def side_alias(c: Column) -> Column:
    """Free-text side to l or r, unknown to NULL."""
    words = {"l": ("left", "l", "esquerra"), "r": ("right", "r", "dreta")}
    table = F.create_map(*(F.lit(v) for k, own in words.items() for w in own for v in (w, k)))
    return F.try_element_at(table, F.lower(F.trim(c)))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a feature table or report as Parquet or CSV."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """Landmark files, one JSON text each (see parse_landmarks): case_id (the file's name), label, x, y, z."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("case_id"), F.col("value").alias("json"))
    return parse_landmarks(texts)


def parse_landmarks(texts: DataFrame) -> DataFrame:
    """Landmarks of JSON texts (case_id, json) of either form: {label: [x, y, z]}, or markups with control
    points, which are turned to RAS where they are given in LPS. Texts of neither form give no rows."""
    schema = "markups array<struct<coordinateSystem:string,controlPoints:array<struct<label:string,position:array<double>>>>>"
    m = texts.withColumn("_m", F.from_json("json", schema)["markups"])
    marked = m.filter("_m is not null").select("case_id", F.explode("_m").alias("m")).select("case_id", F.col("m.coordinateSystem").alias("cs"), F.explode("m.controlPoints").alias("p")).select("case_id", "cs", "p.label", "p.position")
    flat = m.filter("_m is null").select("case_id", F.explode(F.from_json("json", "map<string,array<double>>")).alias("label", "position")).select("case_id", F.lit(None).cast("string").alias("cs"), "label", "position")
    flip = F.when(F.col("cs") == "LPS", -1.0).otherwise(1.0)
    p = F.col("position")
    return marked.unionByName(flat).filter(F.size("position") == 3).select("case_id", "label", (flip * p[0]).alias("x"), (flip * p[1]).alias("y"), p[2].alias("z"))


def landmarks_to_markups(df: DataFrame) -> DataFrame:
    """Landmarks (case_id, idx, label, x, y, z) as one JSON text per case; ids count from 1, a missing
    label becomes Endpoint-n."""
    point = F.struct("idx", F.struct(F.col("n").cast("string").alias("id"), F.coalesce("label", F.concat(F.lit("Endpoint-"), F.col("n"))).alias("label"), F.array("x", "y", "z").alias("position")).alias("p"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("idx"))
    g = df.withColumn("n", n).groupBy("case_id").agg(F.array_sort(F.collect_list(point)).alias("s"))
    return g.select("case_id", F.to_json(F.struct(F.transform("s", lambda s: s["p"]).alias("controlPoints"))).alias("markups"))


def explode_segments(segments: DataFrame) -> DataFrame:
    """Arrays of a cell (coords, radii) to one row per point."""
    z = segments.select("case_id", "cell_id", F.posexplode(F.arrays_zip("coords", "radii")).alias("point_idx", "z"))
    return z.select("case_id", "cell_id", "point_idx", *(F.col("z.coords")[i].alias(n) for i, n in enumerate("xyz")), F.col("z.radii").alias("radius"))


def collect_segments(points: DataFrame) -> DataFrame:
    """Points back to one row per cell with ordered arrays. A cell has a bounded number of points."""
    g = points.groupBy("case_id", "cell_id").agg(F.array_sort(F.collect_list(F.struct("point_idx", F.array(*(F.col(n) for n in "xyz")).alias("c"), "radius"))).alias("s"))
    return g.select("case_id", "cell_id", F.transform("s", lambda s: s["c"]).alias("coords"), F.transform("s", lambda s: s["radius"]).alias("radii"))


def natural_key(c: Column) -> Column:
    """A text that sorts names by the numbers in them: every run of digits is padded to 20."""
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def case_inventory(cases: DataFrame, files: DataFrame, expected: dict[str, list[str]], order: list[str]) -> DataFrame:
    """For each case a boolean per artefact (any of its names exists) and the first missing one in order."""
    g = files.groupBy("case_id").agg(*(F.bool_or(F.col("name").isin(*names)).alias(k) for k, names in expected.items()))
    j = cases.join(g, "case_id", "left").select("case_id", *(F.coalesce(k, F.lit(False)).alias(k) for k in expected))
    problem = F.lit(None).cast("string")
    for k in reversed(order):
        problem = F.when(~F.col(k), k).otherwise(problem)
    return j.withColumn("problem", problem)


def first_existing(files: DataFrame, priority: list[str]) -> DataFrame:
    """The file of each case whose name comes first in the list."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("name"))
    return files.filter(rank > 0).groupBy("case_id").agg(F.min_by("name", rank).alias("name"))


def export_points(nodes: DataFrame) -> DataFrame:
    """Point and weight lists of each case in node order."""
    g = nodes.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("node_id", F.array(*(F.col(n) for n in "xyz")).alias("p"), "weight"))).alias("s"))
    return g.select("case_id", F.transform("s", lambda s: s["p"]).alias("points"), F.transform("s", lambda s: s["weight"]).alias("weights"))


def detect_mode(cases: DataFrame, span: float = 250.0) -> DataFrame:
    """Mode of a case: configured, else that of existing outputs, else a hint in the file name, else by
    the scan's extent. cases: case_id, configured, existing, file_name, coverage."""
    hint = F.when(F.lower("file_name").contains("intra"), "intracranial").when(F.lower("file_name").contains("extra"), "extracranial")
    return cases.withColumn("mode", F.coalesce("configured", "existing", hint, F.when(F.col("coverage") >= span, "extracranial").when(F.col("coverage") < span, "intracranial")))


def select_cases(df: DataFrame, only: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """Rows of the cases in ``only`` (if given) that aren't in ``skip``."""
    df = df.join(only.select("case_id").distinct(), "case_id", "left_semi") if only is not None else df
    return df.join(skip.select("case_id").distinct(), "case_id", "left_anti") if skip is not None else df
