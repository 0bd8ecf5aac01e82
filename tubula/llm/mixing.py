"""Operator 7: mix sources to target weights by entropy balancing, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the total number
of words; a target stops at ``CAP`` times its source's words and the excess is shared by weight again,
which is one water level over the sources, found by windows over the table of sources.

Rates: within a source the rates w of its texts are those closest to 1 in relative entropy, between 0
and ``CAP``, whose words sum to the target. The convex dual has one variable for each source, and
w = min(CAP, exp(lambda * words / mean words)). Newton steps, kept inside a bracket, solve all sources
at once; each step is one aggregation over the histogram (source, words) of the corpus.

Copies: whole copies of a text are floor(w), and some texts get one more. How many of a cell (texts of
a source with about the same size) do is found from the longest to the shortest cell, carrying what is
over or short on, so that a source ends within half of its shortest text from its target wherever
the short texts can make up for it. Which texts of a cell do follows from hashes of the ids.

Defined results: a null text has no words, a text without words has rate 1, one copy and takes nothing;
a null source is a source of its own; rows that repeat count as texts of their own; the result doesn't
depend on the order or partitioning of rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tubula.llm.common import WORD, read, stored

CAP = 3
#: Sizes up to here are cells of their own; beyond, a cell spans half a per cent. So a source has about
#: 4,000 cells at most, whatever the corpus is.
EXACT, SPAN = 512, 0.005
#: Texts that one window partition of a cell should hold.
SALT_ROWS = 1000
TOLERANCE, MOST_STEPS = 1e-9, 80


def source_targets(sizes: DataFrame) -> DataFrame:
    """key, source_size, texts, target for each source of sizes (key, size). The windows run over one
    row for each source."""
    sources = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("texts"))
    order = Window.orderBy("key")
    all_rows = Window.partitionBy()
    weighed = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("limit", F.col("source_size") * CAP)
    level_order = Window.orderBy(F.col("limit") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(level_order), F.lit(0))
    level = (F.sum("source_size").over(all_rows) - before("limit")) / (F.sum("weight").over(all_rows) - before("weight"))
    levels = weighed.withColumn("level", level)
    fits = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level"))
    return levels.withColumn("level", F.max(fits).over(all_rows)).select(
        "key", "source_size", "texts", F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double"))).alias("target")
    )


def _rate(tilt: Column, x: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(tilt * x, F.lit(math.log(CAP)))))


def solve_tilts(hist: DataFrame, sources: DataFrame) -> DataFrame:
    """key, tilt, full: the dual variable of each source; full marks targets at the cap. hist: key, size, n."""
    x = F.col("size") * F.col("texts") / F.col("source_size")
    state = stored(
        sources.filter("source_size > 0").select(
            "key", "source_size", "texts", "target", (F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)).alias("full"), F.log(F.col("target") / F.col("source_size")).alias("tilt"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        ),
        "mix-tilts",
    )
    for _ in range(MOST_STEPS):
        rate = _rate(F.col("tilt"), x)
        reached = hist.join(state.select("key", "source_size", "texts", "tilt"), "key").groupBy("key").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("sum"), F.sum(F.when(rate < CAP, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope")
        )
        now = state.join(reached, "key").withColumn("off", F.col("target") - F.col("sum"))
        now = now.withColumn("low", F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") <= 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") + F.try_divide("off", "slope")
        middle = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        inside = newton.isNotNull() & F.coalesce(newton > F.col("low"), F.lit(True)) & F.coalesce(newton < F.col("high"), F.lit(True)) & (F.abs(newton - F.col("tilt")) < 4)
        done = F.abs("off") <= TOLERANCE * F.col("target")
        state = stored(
            now.withColumn("next", F.when(done | F.col("full"), F.col("tilt")).when(inside, newton).otherwise(middle)).select("key", "source_size", "texts", "target", "full", F.col("next").alias("tilt"), "low", "high", (done | F.col("full")).alias("done")),
            "mix-tilts",
        )
        if not state.filter("not done").limit(1).count():
            break
    else:
        raise RuntimeError("the dual did not converge")
    return state.select("key", "tilt", "full")


def _extras(cells: DataFrame) -> DataFrame:
    """Extra copies of each cell (key, cell, base, n, part, mean): a fold over the cells of a source
    from the longest to the shortest that carries the difference in words on. A source has a bounded
    number of cells."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("mean", "cell", "base", "n", "part"))))
    start = F.struct(F.lit(0.0).alias("over"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        want = acc["over"] + c["n"] * c["part"] * c["mean"]
        extra = F.greatest(F.lit(0), F.least(c["n"], F.round(want / c["mean"]).cast("bigint")))
        return F.struct((want - extra * c["mean"]).alias("over"), F.concat(acc["out"], F.array(extra)).alias("out"))

    folded = cells.groupBy("key").agg(ordered.alias("cells")).withColumn("out", F.aggregate("cells", start, step)["out"])
    return folded.select("key", F.explode(F.arrays_zip("cells", "out")).alias("z")).select("key", "z.cells.cell", "z.cells.base", "z.cells.n", F.col("z.out").alias("extras"))


def mix_sources(docs: DataFrame, rows: bool = False) -> DataFrame:
    """docs: doc_id, text, source. Returns doc_id, size, source_size, target, taken, copies, rate, one
    row per input row. rows: docs have a row_id (long), which comes back."""
    own = ["row_id"] if rows else []
    sizes = stored(
        docs.select(F.col("doc_id").cast("long"), *own, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "mix-sizes",
    )
    sources = stored(source_targets(sizes), "mix-sources")
    hist = stored(sizes.filter("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    tilts = stored(solve_tilts(hist, sources), "mix-tilts")
    x = F.col("size") * F.col("texts") / F.col("source_size")
    rate = F.when(F.col("full"), F.lit(float(CAP))).otherwise(_rate(F.col("tilt"), x))
    cell = F.when(F.col("size") <= EXACT, F.col("size")).otherwise(F.floor(F.log(F.col("size").cast("double")) / SPAN))
    rates = stored(hist.join(sources, "key").join(tilts, "key").select("key", "size", "n", rate.alias("rate"), cell.alias("cell")).withColumn("base", F.floor("rate")), "mix-rates")
    cells = rates.groupBy("key", "cell", "base").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * (F.col("rate") - F.col("base")) * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("part"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean")
    )
    extras = stored(_extras(cells).withColumn("salts", F.ceil(F.col("n") / SALT_ROWS)), "mix-extras")

    placed = sizes.join(rates.select("key", "size", "rate", "cell", "base"), ["key", "size"], "left").join(extras, ["key", "cell", "base"], "left")
    placed = placed.withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.pmod("h", "salts"))
    each = placed.filter("size > 0").groupBy("key", "cell", "base", "salt").agg(F.count(F.lit(1)).alias("m"))
    first = F.coalesce(F.sum("m").over(Window.partitionBy("key", "cell", "base").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.select("key", "cell", "base", "salt", first.alias("first"))
    rank = F.row_number().over(Window.partitionBy("key", "cell", "base", "salt").orderBy("h", "doc_id", *own, "size"))
    extra = (F.expr("((first + rank) * extras) div n") - F.expr("((first + rank - 1) * extras) div n")).cast("long")
    ranked = placed.filter("size > 0").withColumn("rank", rank).join(starts, ["key", "cell", "base", "salt"]).withColumn("copies", F.col("base") + extra)
    both = ranked.select("doc_id", *own, "key", "size", "rate", "copies").unionByName(sizes.filter("size = 0").select("doc_id", *own, "key", "size", F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies")))
    return both.join(sources.select("key", "source_size", "target"), "key").select("doc_id", *own, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return mix_sources(read(spark, sf_dir, "documents"))
