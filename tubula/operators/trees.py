"""Walks from start nodes: levels, parents, sums along them, and root-to-leaf paths.

Graphs of at most ``CASE_EDGES`` edges are walked whole, each in the task that its case is dealt to: one exchange, whatever
their depth. Larger ones are never gathered. If they are forests, their Euler tours are ranked by pointer jumping: the
arc after (u, v) is (v, w), w being v's next neighbour after u, so the tour of a tree is a list, and doubling the
pointers ranks it in a logarithmic number of rounds. An arc that comes before its opposite leads down, which gives
parents; jumping over parents carries levels and sums. A node's subtree is an interval of the tour, so "on the path
to this leaf" is an interval test; intervals are cut into dyadic blocks, which makes it an equi-join. What is large
and has cycles (or two starts in one tree) goes on level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tubula.functions.runtime import discard, spread, stored
from tubula.operators.components import star_components

#: Edges of a case that one task may hold (64 MB as they come). 720,000 edges took 0.3 GB to walk and 0.5 GB with their paths.
CASE_EDGES = 1_000_000


def arcs(edges: DataFrame, *rest: str) -> DataFrame:
    """Each edge in both directions; loops are left out."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    return edges.filter("src <> dst").select("case_id", both, *rest).select("case_id", "e.src", "e.dst", *rest)


class Walk:
    """A case's graph with places instead of node ids; starts that have no edge are nodes, too."""

    def __init__(self, rows: pa.Table):
        edge = rows.column("dst").is_valid()
        begin = np.unique(rows.column("src").filter(pc.invert(edge)).to_numpy())
        arcs_ = rows.select(["src", "dst", "w"]).filter(edge)
        src, dst, w = arcs_.column("src").to_numpy(), arcs_.column("dst").to_numpy(), arcs_.column("w").fill_null(np.nan).to_numpy()
        self.names = np.unique(np.concatenate([src, dst, begin]))
        a, b = np.searchsorted(self.names, src), np.searchsorted(self.names, dst)
        order = np.lexsort((w, b, a))
        self.src, self.dst, self.w = a[order], b[order], w[order]
        self.first = np.searchsorted(self.src, np.arange(len(self.names) + 1))
        self.starts = np.searchsorted(self.names, begin)

    def levels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level (-1 where no start leads), place of the parent (-1 at starts) and sum, breadth first; of several parents
        the smallest one counts, of several edges to it the lightest."""
        level, parent, total = np.full(len(self.names), -1), np.full(len(self.names), -1), np.zeros(len(self.names))
        front, depth = self.starts, 0
        level[front] = 0
        while len(front):
            depth += 1
            size = self.first[front + 1] - self.first[front]
            arc = np.repeat(self.first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            arc = arc[level[self.dst[arc]] < 0]
            # front is in order, so parents come in order, and the stable sort keeps that for each child
            arc = arc[np.argsort(self.dst[arc], kind="stable")]
            child = self.dst[arc]
            keep = np.ones(len(arc), bool)
            keep[1:] = child[1:] != child[:-1]
            arc, front = arc[keep], child[keep]
            level[front], parent[front], total[front] = depth, self.src[arc], total[self.src[arc]] + self.w[arc]
        return level, parent, total

    def components(self) -> np.ndarray:
        """Place of the smallest node of each node's component."""
        label = np.arange(len(self.names))
        while True:
            new = label.copy()
            np.minimum.at(new, self.src, label[self.dst])
            np.minimum.at(new, label[self.src], label[self.dst])
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def chains(self) -> tuple[np.ndarray, ...]:
        """The chain with the most nodes of each component: its component, node, place, number of nodes and length."""
        label = self.components()

        def farthest(level: np.ndarray) -> np.ndarray:
            order = np.lexsort((np.arange(len(level)), -level, label))
            return order[np.concatenate([[True], label[order][1:] != label[order][:-1]])] if len(order) else order

        self.starts = np.unique(label)
        self.starts = np.sort(farthest(self.levels()[0]))
        level, _, total = self.levels()
        end = farthest(level)
        self.starts = np.sort(end)
        back = self.levels()[0]
        most, length = np.zeros(len(label), int), np.zeros(len(label))
        most[label[end]], length[label[end]] = level[end], total[end]
        on = np.flatnonzero(level + back == most[label])
        on = on[np.lexsort((on, level[on], label[on]))]
        own, place = label[on], level[on]
        keep = np.concatenate([[True], (own[1:] != own[:-1]) | (place[1:] != place[:-1])]) if len(on) else np.zeros(0, bool)
        on, own, place = on[keep], own[keep], place[keep]
        return self.names[own], self.names[on], place, most[own] + 1, length[own]

    def paths(self) -> Iterator[tuple[int, list[int]]]:
        """Simple paths from each start to the other ends (nodes with one edge), by depth-first search."""
        edges = np.bincount(self.src, minlength=len(self.names))
        near = [list(dict.fromkeys(self.dst[self.first[v] : self.first[v + 1]].tolist())) for v in range(len(self.names))]
        for start in self.starts.tolist():
            path, on, todo = [start], {start}, [iter(near[start])]
            while todo:
                nxt = next((v for v in todo[-1] if v not in on), None)
                if nxt is None:
                    todo.pop()
                    on.discard(path.pop())
                    continue
                path.append(nxt)
                on.add(nxt)
                todo.append(iter(near[nxt]))
                if edges[nxt] == 1:
                    yield nxt, path


def _nullable(kind: pa.DataType) -> pa.DataType:
    """A case may be a struct; its fields may be NULL in what comes back."""
    return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def named(case, n: int, kind: pa.DataType) -> pa.Array:
    """A case's id in n rows."""
    return pa.array([case] * n, _nullable(kind))


def _case_levels(rows: pa.Table) -> pa.Table:
    walk = Walk(rows)
    level, parent, total = walk.levels()
    at = np.flatnonzero(level >= 0)
    up = pa.array(np.where(parent[at] < 0, 0, walk.names[np.maximum(parent[at], 0)]), mask=parent[at] < 0)
    case = rows.column("case_id")
    return pa.table({"case_id": named(case[0].as_py(), len(at), case.type), "node_id": walk.names[at], "level": pa.array(level[at], pa.int32()), "parent": up, "acc": total[at]})


def _case_paths(rows: pa.Table) -> pa.Table:
    walk = Walk(rows)
    names = walk.names.tolist()
    found = [(names[leaf], [names[v] for v in path]) for leaf, path in walk.paths()]
    case = rows.column("case_id")
    return pa.table({"case_id": named(case[0].as_py(), len(found), case.type), "leaf": pa.array([x for x, _ in found], pa.int64()), "path": pa.array([p for _, p in found], pa.list_(pa.int64()))})


def _case_components(rows: pa.Table) -> pa.Table:
    walk = Walk(rows)
    case = rows.column("case_id")
    return pa.table({"case_id": named(case[0].as_py(), len(walk.names), case.type), "node_id": walk.names, "component": walk.names[walk.components()]})


def _case_chains(rows: pa.Table) -> pa.Table:
    component, node, place, n, length = Walk(rows).chains()
    case = rows.column("case_id")
    return pa.table({"case_id": named(case[0].as_py(), len(node), case.type), "component": component, "node_id": node, "place": pa.array(place, pa.int32()), "n": pa.array(n, pa.int32()), "length": length})


def _split(edges: DataFrame, start: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the cases that one task may hold (case_id, src, dst, w: arcs, and starts with a NULL dst), and the cases
    with more edges than ``limit`` (None if there are none)."""
    rows = arcs(edges.select("case_id", F.col("src").cast("long"), F.col("dst").cast("long"), "w"), "w").unionByName(start.select("case_id", F.col("node_id").cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("w")).distinct())
    large = edges.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("case_id")
    if not large.limit(1).count():
        return rows, None
    large = stored(large, "large-cases")
    return rows.join(large, "case_id", "left_anti"), large


def _jumped(list_: DataFrame, sums: list[str], keys: list[str]) -> DataFrame:
    """Pointer jumping over rows (keys..., node, next, sums...): each sum becomes the one over the row and all that
    follow it. A round doubles the pointers twice."""
    once = lambda df: df.alias("a").join(spread(df.select(*keys, F.col("node").alias("next"), F.col("next").alias("_next"), *(F.col(s).alias(f"_{s}") for s in sums))), [*keys, "next"], "left").select(*keys, "node", F.col("_next").alias("next"), *((F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums))
    done = stored(list_, "jumps")
    while done.filter("next is not null").limit(1).count():
        last, done = done, stored(once(once(done)), "jumps")
        discard(last)
    return done


def euler_tour(edges: DataFrame, start: DataFrame, trees: DataFrame) -> DataFrame:
    """Forests (case_id, src, dst, w) with at most one start (case_id, node_id) in each tree: the arcs of trees that have
    one, with their place in its tour: case_id, root, src, dst, w, place (from 0). trees: the component of each node and of
    others (case_id, node, component)."""
    both = arcs(edges, "w")
    label = spread(trees.select("case_id", F.col("node").alias("src"), "component"))
    root = label.join(start.select("case_id", F.col("node_id").alias("src")).distinct(), ["case_id", "src"]).select("case_id", "component", F.col("src").alias("root"))
    around = Window.partitionBy("case_id", "src").orderBy("dst")
    own = both.join(label, ["case_id", "src"]).join(spread(root), ["case_id", "component"])
    own = stored(own.withColumns({"after": F.lead("dst").over(around), "lowest": F.min("dst").over(Window.partitionBy("case_id", "src"))}), "tour-arcs")
    name = F.struct("src", "dst")
    # after (u, v) comes (v, w): what v's row for u says; the tour ends where it would come to the root's first arc again
    turn = own.select("case_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.when(F.col("after").isNotNull(), F.col("after")).otherwise(F.when(F.col("src") != F.col("root"), F.col("lowest"))).alias("to"))
    listed = own.join(spread(turn), ["case_id", "src", "dst"]).select("case_id", name.alias("node"), F.when(F.col("to").isNotNull(), F.struct(F.col("dst").alias("src"), F.col("to").alias("dst"))).alias("next"), F.lit(1).cast("long").alias("behind"))
    ranked = _jumped(listed, ["behind"], ["case_id"])
    total = own.groupBy("case_id", "root").agg(F.count(F.lit(1)).alias("_n"))
    placed = own.join(spread(ranked.select("case_id", "node.*", "behind")), ["case_id", "src", "dst"]).join(spread(total), ["case_id", "root"])
    return stored(placed.select("case_id", "root", "src", "dst", "w", (F.col("_n") - F.col("behind")).alias("place")), "tour")


def subtrees(tour: DataFrame) -> DataFrame:
    """Nodes below the roots with the interval of the tour in which their subtree lies: case_id, root, parent, node_id,
    w, low, high."""
    back = tour.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("place").alias("high"))
    return tour.join(spread(back), ["case_id", "src", "dst"]).filter("place < high").select("case_id", "root", F.col("src").alias("parent"), F.col("dst").alias("node_id"), "w", F.col("place").alias("low"), "high")


def _tour_levels(tour: DataFrame, start: DataFrame) -> DataFrame:
    below = stored(subtrees(tour), "tour-below")
    up = below.select("case_id", F.col("node_id").alias("node"), F.when(F.col("parent") != F.col("root"), F.col("parent")).alias("next"), F.lit(1).alias("level"), F.col("w").alias("acc"))
    done = _jumped(up, ["level", "acc"], ["case_id"]).select("case_id", F.col("node").alias("node_id"), F.col("level").cast("int"), "acc")
    found = done.join(spread(below.select("case_id", "node_id", "parent")), ["case_id", "node_id"]).select("case_id", "node_id", "level", "parent", "acc")
    return found.unionByName(start.select("case_id", F.col("node_id").cast("long"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("acc")).distinct())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with the dyadic blocks that make up their interval [low, high]: block = 2^62 / size + place / size, roughly:
    the number of a cell in the binary tree over places."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (batch.column(c).to_numpy() + np.int64(1 << 40) for c in ("low", "high"))
        right = right + 1
        row, block, alive = [], [], np.arange(batch.num_rows)
        while len(alive):
            odd = alive[left[alive] & 1 == 1]
            row.append(odd)
            block.append(left[odd].copy())
            left[odd] += 1
            odd = alive[right[alive] & 1 == 1]
            right[odd] -= 1
            row.append(odd)
            block.append(right[odd].copy())
            left[alive] >>= 1
            right[alive] >>= 1
            alive = alive[left[alive] < right[alive]]
        own = np.concatenate(row)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own)) for c in batch.schema.names), pa.array(np.concatenate(block))], [*batch.schema.names, "block"])


def _tour_paths(tour: DataFrame) -> DataFrame:
    """Paths of trees: nodes and leaves meet where a leaf's place lies in a node's interval; arrays are built once."""
    below = stored(subtrees(tour), "tour-below")
    schema = below.select("case_id", "root", "node_id", "low", "high").schema
    nodes = below.select(*schema.names).mapInArrow(_blocks, schema.add("block", "long"))
    leaves = below.filter("high = low + 1").select("case_id", "root", F.col("node_id").alias("leaf"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.call_function("shiftright", F.col("low") + F.lit(1 << 40), k))).alias("block"))
    met = nodes.join(spread(leaves), ["case_id", "root", "block"]).groupBy("case_id", "root", "leaf").agg(F.array_sort(F.collect_list(F.struct("low", "node_id"))).alias("p"))
    return met.select("case_id", "leaf", F.concat(F.array("root"), F.transform("p", lambda x: x["node_id"])).alias("path"))


def _kinds(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases that are forests with one start a tree at most, the others (both: case_id), and the component of each node."""
    label = stored(star_components(edges.select("case_id", "src", "dst"), ["case_id"]), "kinds")
    nodes = label.groupBy("case_id").agg((F.count(F.lit(1)) - F.countDistinct("component")).alias("bound"))
    many = label.join(spread(start.select("case_id", F.col("node_id").alias("node")).distinct()), ["case_id", "node"]).groupBy("case_id", "component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("case_id").distinct()
    n = edges.filter("src <> dst").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    forest = stored(n.join(nodes, "case_id").filter("n = bound").select("case_id").join(many, "case_id", "left_anti"), "forests")
    return forest, n.select("case_id").join(forest, "case_id", "left_anti"), label


def walk_levels(edges: DataFrame, start: DataFrame, slow, limit: int | None = None) -> DataFrame:
    """Levels from start nodes. edges: case_id, src, dst, w; ``slow``: (edges, start) -> levels, level by level, for what is
    large and no forest. Returns case_id, node_id, level, parent, acc."""
    kind = edges.schema["case_id"].dataType.simpleString()
    rows, large = _split(edges, start, CASE_EDGES if limit is None else limit)
    schema = f"case_id {kind}, node_id long, level int, parent long, acc double"
    out = rows.groupBy("case_id").applyInArrow(_case_levels, schema)
    if large is None:
        return out
    own, begin = (df.join(large, "case_id", "left_semi") for df in (edges, start))
    forest, rest, label = _kinds(own, begin)
    pick = lambda df, cases: df.join(cases, "case_id", "left_semi")
    out = out.unionByName(_tour_levels(euler_tour(pick(own, forest), pick(begin, forest), label), pick(begin, forest)))
    return out.unionByName(slow(pick(own, rest), pick(begin, rest))) if rest.limit(1).count() else out


def walk_paths(edges: DataFrame, start: DataFrame, slow, limit: int | None = None) -> DataFrame:
    """Simple paths from the start nodes to other end nodes: case_id, leaf, path. ``slow`` as for walk_levels."""
    kind = edges.schema["case_id"].dataType.simpleString()
    edges = edges.select("case_id", "src", "dst", F.lit(1.0).alias("w"))
    rows, large = _split(edges, start, CASE_EDGES if limit is None else limit)
    out = rows.groupBy("case_id").applyInArrow(_case_paths, f"case_id {kind}, leaf long, path array<long>")
    if large is None:
        return out
    own, begin = (df.join(large, "case_id", "left_semi") for df in (edges, start))
    forest, rest, label = _kinds(own, begin)
    pick = lambda df, cases: df.join(cases, "case_id", "left_semi")
    out = out.unionByName(_tour_paths(euler_tour(pick(own, forest), pick(begin, forest), label)))
    return out.unionByName(slow(pick(own, rest), pick(begin, rest))) if rest.limit(1).count() else out


def _no_start(edges: DataFrame) -> DataFrame:
    return edges.select("case_id", F.col("src").alias("node_id")).limit(0)


def walk_components(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Components of edges (case_id, src, dst): case_id, node_id, component (its smallest node)."""
    kind = edges.schema["case_id"].dataType.simpleString()
    edges = edges.select("case_id", "src", "dst", F.lit(1.0).alias("w"))
    rows, large = _split(edges, _no_start(edges), CASE_EDGES if limit is None else limit)
    out = rows.groupBy("case_id").applyInArrow(_case_components, f"case_id {kind}, node_id long, component long")
    if large is None:
        return out
    stars = star_components(edges.join(large, "case_id", "left_semi").select("case_id", "src", "dst"), ["case_id"])
    return out.unionByName(stars.withColumnRenamed("node", "node_id"))


def walk_chains(edges: DataFrame, slow, limit: int | None = None) -> DataFrame:
    """Longest chain of every component of edges (case_id, src, dst, w): case_id, component, node_id, place, n, length. ``slow``:
    edges -> chains by distributed walks, for large cases."""
    kind = edges.schema["case_id"].dataType.simpleString()
    rows, large = _split(edges, _no_start(edges), CASE_EDGES if limit is None else limit)
    out = rows.groupBy("case_id").applyInArrow(_case_chains, f"case_id {kind}, component long, node_id long, place int, n int, length double")
    return out if large is None else out.unionByName(slow(edges.join(large, "case_id", "left_semi")))
