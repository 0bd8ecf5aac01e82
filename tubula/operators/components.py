"""Connected components of an edge list by alternating large-star and small-star steps.

A star step needs each node's smallest neighbour. The neighbours of a node come sorted to one task, so
the first one is the smallest: a step is one exchange and one sort, neighbours stream through, and no
list of them is ever built."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubula.functions.runtime import discard, stored


def _star(keys: list[str], large: bool):
    """One star step over rows (keys..., a, b) sorted by all of them. Large: each larger neighbour of a is
    tied to the smallest node around a. Small: a and its neighbours, all smaller, are tied to the smallest.
    A row with a = b says that the batch held a node that is neither the middle nor a tip of a star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low, before = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "a")]
            a, b = columns[-1], batch.column("b").to_numpy(zero_copy_only=False)
            fresh = np.zeros(len(a), bool)
            for c in columns:
                fresh[1:] |= c[1:] != c[:-1]
            fresh[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
            twice = ~fresh & (b == np.concatenate([[before], b[:-1]]))
            firsts = np.concatenate([[low], b[fresh]])
            m = np.minimum(firsts[np.cumsum(fresh)], a)
            last, low, before = [c[-1] for c in columns], firsts[-1], b[-1]
            if large:
                row, x = np.flatnonzero(~twice & (b > a)), b
                loose = np.flatnonzero((m < a) & (b != m))[:1]
                row, left = np.concatenate([row, loose]), np.concatenate([x[row], a[loose]])
                right = np.concatenate([m[row[: len(row) - len(loose)]], a[loose]])
            else:
                near, own = np.flatnonzero(~twice & (b != m)), np.flatnonzero(fresh)
                row, left = np.concatenate([near, own]), np.concatenate([b[near], a[own]])
                right = m[row]
            if len(row):
                kept = [batch.column(k).take(pa.array(row)) for k in keys]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(left, pa.int64()), pa.array(right, pa.int64())], [*keys, "a", "b"])

    return run


def star_components(edges: DataFrame, keys: list[str] | None = None, max_rounds: int = 100) -> DataFrame:
    """Components of undirected edges (keys..., src, dst; nodes are whole numbers), separately for each
    value of the keys.

    Returns keys..., node, component (the smallest node of its component) for every node that has an
    edge to another node. Each round is two exchanges; the number of rounds grows with the logarithm of
    the longest path. Self loops, repeated edges and edges with a null end or key don't matter.
    """
    keys = keys or []
    order = [*keys, "a", "b"]
    pairs = edges.select(*keys, F.greatest("src", "dst").cast("long").alias("a"), F.least("src", "dst").cast("long").alias("b"), "src", "dst").dropna(subset=[*keys, "src", "dst"]).filter("a <> b").select(order)
    schema = pairs.schema
    done = None
    for _ in range(max_rounds):
        both = pairs.select(*keys, F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(*keys, "e.a", "e.b")
        sort = lambda df: df.repartition(*[F.col(c) for c in order[:-1]]).sortWithinPartitions(*order)
        last, done = done, stored(sort(both).mapInArrow(_star(keys, True), schema), "components")
        discard(last)
        if not done.filter("a = b").limit(1).count():
            break
        pairs = sort(done.filter("a <> b")).mapInArrow(_star(keys, False), schema)
    else:
        raise RuntimeError("components did not settle")
    return done.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(done.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct())
