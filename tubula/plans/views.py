"""Canonical inputs made of the supplied tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Order = cell, customer = case, line items in a total order = points."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    numbered = lines.withColumn("point_idx", F.row_number().over(w) - 1)
    return numbered.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("case_id"), F.col("l_orderkey").alias("cell_id"), "point_idx", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"),
        (1 + F.col("l_tax") * 50).alias("radius"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("blanking"), F.col("o_orderpriority").alias("class_name"),
    )


PTS = f"""points AS (SELECT o.o_custkey AS case_id, l.l_orderkey AS cell_id,
 CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {', '.join('l.' + c for c in LINE_ORDER)}) - 1 AS INTEGER) AS point_idx,
 l.l_quantity AS x, l.l_discount * 100 AS y, l.l_extendedprice / 1000 AS z, 1 + l.l_tax * 50 AS radius,
 CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS blanking, o.o_orderpriority AS class_name
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
#: The window of a cell's points, and points with step and arc length.
W = "(PARTITION BY case_id, cell_id ORDER BY point_idx)"
ARC = f"""{PTS}, steps AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0) AS step
 FROM points WINDOW w AS {W}), arcs AS (SELECT *, sum(step) OVER (PARTITION BY case_id, cell_id ORDER BY point_idx ROWS UNBOUNDED PRECEDING) AS arc FROM steps)"""


def events_line(spark: SparkSession, d: str) -> DataFrame:
    """Long lines: a user's events in order of time; x = seconds since the first one, y = value."""
    e = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.lit(0).cast("bigint").alias("cell_id"), "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), F.col("value"))
    w = Window.partitionBy("case_id").orderBy("s", "event_id")
    return e.select("case_id", "cell_id", (F.row_number().over(w) - 1).alias("point_idx"), (F.col("s") - F.first("s").over(w)).alias("x"), F.col("value").alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("radius"), F.lit(0).alias("blanking"), F.col("event_type").alias("class_name"))


EVT = """evt AS (SELECT user_id AS case_id, CAST(0 AS BIGINT) AS cell_id, CAST(row_number() OVER w - 1 AS INTEGER) AS point_idx,
 epoch_us(ts) / 1e6 - first_value(epoch_us(ts) / 1e6) OVER w AS x, value AS y, 0.0::DOUBLE AS z, 1.0::DOUBLE AS radius, 0 AS blanking, event_type AS class_name
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id))"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Ten trees of parts: edges from each node to its parent. case_id, src, dst, length."""
    p = table(spark, d, "part").filter("p_partkey >= 10").select((F.col("p_partkey") % 10).alias("case_id"), F.floor(F.col("p_partkey") / 10).alias("node"), F.col("p_retailprice").alias("price"))
    return p.filter("node > 0").select("case_id", F.floor((F.col("node") - 1) / 2).alias("src"), F.col("node").alias("dst"), (F.col("price") % 7 + 1).alias("length"))


TREE = """tree AS (SELECT p_partkey % 10 AS case_id, CAST(floor((floor(p_partkey / 10) - 1) / 2) AS BIGINT) AS src, CAST(floor(p_partkey / 10) AS BIGINT) AS dst, p_retailprice % 7 + 1 AS length FROM part WHERE p_partkey >= 20
 UNION ALL SELECT p_partkey % 10, CAST(0 AS BIGINT), CAST(floor(p_partkey / 10) AS BIGINT), p_retailprice % 7 + 1 FROM part WHERE p_partkey BETWEEN 10 AND 19)"""


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the trees with a position, radius and class."""
    return table(spark, d, "part").select((F.col("p_partkey") % 10).alias("case_id"), F.floor(F.col("p_partkey") / 10).alias("node_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), (F.col("p_retailprice") % 100).alias("z"), (F.col("p_size") % 11 + 1).cast("double").alias("radius"), F.col("p_brand").alias("class_name"))


NODES = """nodes AS (SELECT p_partkey % 10 AS case_id, CAST(floor(p_partkey / 10) AS BIGINT) AS node_id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 97 AS DOUBLE) AS y, p_retailprice % 100 AS z, CAST(p_size % 11 + 1 AS DOUBLE) AS radius, p_brand AS class_name FROM part)"""


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """Two masks by flag (A, R) on a grid of 50 x 11 x 9."""
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("case_id"), F.round("l_quantity").cast("int").alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("j"), F.round(F.col("l_tax") * 100).cast("int").alias("k"), F.col("l_returnflag").alias("flag")).distinct()


VOX = "vox AS (SELECT DISTINCT l_suppkey % 5 AS case_id, CAST(round(l_quantity) AS INTEGER) AS i, CAST(round(l_discount * 100) AS INTEGER) AS j, CAST(round(l_tax * 100) AS INTEGER) AS k, l_returnflag AS flag FROM lineitem)"


def labels_sql(near: str) -> str:
    """Components of the voxels of flag A as SQL (labels: case_id, i, j, k, id, component), by spreading the smallest id; ``near`` says
    which of a and b are neighbours. Follows WITH RECURSIVE and VOX."""
    return f"""m AS MATERIALIZED (SELECT DISTINCT case_id, i, j, k, i * 1099511627776 + j * 1048576 + k AS id FROM vox WHERE flag = 'A'),
nb AS MATERIALIZED (SELECT a.case_id, a.id, b.id AS other FROM m a JOIN m b ON a.case_id = b.case_id AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 AND b.k BETWEEN a.k - 1 AND a.k + 1 AND {near}),
spread(case_id, id, component) USING KEY (case_id, id) AS (SELECT case_id, id, id FROM m UNION SELECT nb.case_id, nb.other, min(l.component) FROM spread l JOIN nb ON nb.case_id = l.case_id AND nb.id = l.id JOIN recurring.spread o ON o.case_id = nb.case_id AND o.id = nb.other GROUP BY nb.case_id, nb.other HAVING min(l.component) < min(o.component)),
labels AS MATERIALIZED (SELECT * FROM m JOIN spread USING (case_id, id))"""


def cloud(spark: SparkSession, d: str) -> DataFrame:
    """Point cloud: the first three values of the embeddings, times 100."""
    return table(spark, d, "embeddings").select(F.lit(0).cast("bigint").alias("case_id"), F.col("vec_id").alias("node_id"), *((F.col("embedding")[i].cast("double") * 100).alias(n) for i, n in enumerate("xyz")), F.col("label"), "embedding")


CLOUD = "cloud AS (SELECT CAST(0 AS BIGINT) AS case_id, vec_id AS node_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z, label, embedding FROM embeddings)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Ten class scores of each vector: elements 1 to 10; fold = id % 5, item = id / 5."""
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 5).alias("item_id"), (F.col("vec_id") % 5).alias("fold"), F.posexplode(F.slice("embedding", 1, 10)).alias("class", "s")).select("item_id", "fold", "class", F.col("s").cast("double").alias("score"))


SCORES = "scores AS (SELECT CAST(floor(vec_id / 5) AS BIGINT) AS item_id, vec_id % 5 AS fold, CAST(c AS INTEGER) AS class, CAST(embedding[c + 1] AS DOUBLE) AS score FROM embeddings, range(10) t(c))"


#: Vessel classes without other, in the order of their codes: what the chains of the anatomy view are called.
VESSELS = ["AA", "BT", "RCCA", "LCCA", "RSA", "LSA", "RVA", "LVA", "RICA", "LICA", "RECA", "LECA", "BA"]


def anatomy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ten vessel trees made of the parts: chains of eight edges (cells) that branch in two;
    the level of a node is its distance from node 0."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("case_id"), F.floor(F.col("p_partkey") / 10).alias("n"), "p_size", "p_partkey", "p_retailprice")
    c = F.greatest(F.floor((F.col("n") - 1) / 8), F.lit(0))
    r = F.col("n") - 8 * F.col("c")
    name = F.array(*map(F.lit, VESSELS))[(F.col("c") % len(VESSELS)).cast("int")]
    depth = F.length(F.bin(F.col("c") + 1)) - 1
    p = p.withColumn("c", c).withColumn("r", r).withColumn("class_name", name)
    nodes = p.select("case_id", F.col("n").alias("node_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), (F.col("p_retailprice") % 100).alias("z"), (F.col("p_size") % 11 + 1).cast("double").alias("radius"), "class_name", F.when(F.col("n") == 0, 0).otherwise(8 * depth + F.col("r")).cast("int").alias("hierarchy"))
    parent = F.when(F.col("r") > 1, F.col("n") - 1).when(F.col("c") == 0, F.lit(0)).otherwise(8 * F.floor((F.col("c") - 1) / 2) + 8)
    edges = p.filter("n > 0").select("case_id", parent.cast("long").alias("src"), F.col("n").alias("dst"), F.col("c").alias("cell_id"), "class_name", (F.col("p_retailprice") % 7 + 1).alias("length"), (F.col("p_partkey") % 37 == 0).alias("artificial"))
    return nodes, edges


ANATOMY = f"""vessel(i, class_name) AS (VALUES {', '.join(f"({i}, '{v}')" for i, v in enumerate(VESSELS))}),
raw AS (SELECT p_partkey % 10 AS case_id, CAST(floor(p_partkey / 10) AS BIGINT) AS n, p_size, p_partkey, p_retailprice FROM part),
cells AS (SELECT *, greatest(CAST(floor((n - 1) / 8.0) AS BIGINT), 0) AS c FROM raw),
placed AS (SELECT cells.*, n - 8 * c AS r, class_name FROM cells JOIN vessel ON i = c % 13),
anodes AS (SELECT case_id, n AS node_id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 97 AS DOUBLE) AS y, p_retailprice % 100 AS z, CAST(p_size % 11 + 1 AS DOUBLE) AS radius, class_name, CAST(CASE WHEN n = 0 THEN 0 ELSE 8 * (length(bin(c + 1)) - 1) + r END AS INTEGER) AS hierarchy FROM placed),
aedges AS (SELECT case_id, CASE WHEN r > 1 THEN n - 1 WHEN c = 0 THEN 0 ELSE 8 * CAST(floor((c - 1) / 2.0) AS BIGINT) + 8 END AS src, n AS dst, c AS cell_id, class_name, p_retailprice % 7 + 1 AS length, p_partkey % 37 = 0 AS artificial FROM placed WHERE n > 0)"""
