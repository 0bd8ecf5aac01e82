"""Local features of a whole case's nodes, for cases that one task may hold: levels, neighbourhoods of up to five points and
what comes from upstream, with numpy over all nodes of the case at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tubula.functions.cells import numbers
from tubula.operators.polyline import curved_lines
from tubula.operators.trees import Walk, named

#: Local features that a node takes from others where they are undefined.
FILLED = ["mean_step", "curvature", "torsion", "module", "polar", "azimuth"]
#: Nodes whose neighbourhoods a task holds at a time.
NODES = 20_000


class Around:
    """Neighbours over real edges, by places of nodes; -1 is none."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, nodes: int):
        src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        new = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))[: len(src)]
        self.src, self.dst = src[new], dst[new]
        begin = np.searchsorted(self.src, np.arange(nodes + 1))
        self.degree = np.diff(begin)
        padded = np.append(self.dst, [-1, -1])
        self.first = np.where(self.degree > 0, padded[begin[:-1]], -1)
        self.second = np.where(self.degree > 1, padded[begin[:-1] + 1], -1)

    def smallest(self, which: np.ndarray) -> np.ndarray:
        """Each node's smallest neighbour of the arcs that ``which`` takes."""
        out, at = np.full(len(self.degree), -1), np.flatnonzero(which)
        own = self.src[at]
        new = np.append(True, own[1:] != own[:-1])[: len(at)]
        out[own[new]] = self.dst[at[new]]
        return out

    def other(self, v: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The smallest neighbour of v but the node itself."""
        return np.where(self.first[v] == node, self.second[v], self.first[v])

    def lines(self, up: np.ndarray, down: np.ndarray, level: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ordered neighbourhood of each of the nodes, five places wide, its size (0 below three) and the node's place. up, down:
        each node's smallest neighbour upstream and downstream."""
        slots, degree = np.full((len(nodes), 9), -1), self.degree[nodes]
        two = np.flatnonzero(degree == 2)
        n = nodes[two]
        slots[two, 4] = n
        for v, far, near, later, last in ((self.first[n], 2, 3, 5, 6), (self.second[n], 0, 1, 7, 8)):
            w = np.where(self.degree[v] == 2, self.other(v, n), -1)
            above, below = level[v] < level[n], level[v] > level[n]
            slots[two, near], slots[two, later] = np.where(above, v, -1), np.where(below, v, -1)
            slots[two, far] = np.where(above & (level[w] < level[v]), w, -1)
            slots[two, last] = np.where(below & (level[w] > level[v]), w, -1)
        rest = np.flatnonzero((degree == 1) | (degree > 2))
        n = nodes[rest]
        climbs = up[n] >= 0
        v = np.where(climbs, up[n], self.first[n])
        more = np.where(climbs, np.where(up[v] >= 0, up[v], self.other(v, n)), down[v])
        turned = climbs & (degree[rest] == 1)
        slots[rest, 0], slots[rest, 1], slots[rest, 2] = np.where(turned, more, n), v, np.where(turned, n, more)
        there = slots >= 0
        size, before = there.sum(1), there[:, :4].sum(1)
        line = np.take_along_axis(slots, np.argsort(~there, axis=1, kind="stable"), 1)[:, :5]
        return line, np.where(size < 3, 0, size), np.where(size == 3, 1, before)


def _angles(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Module, polar angle and azimuth as ``geom.spherical`` has them, NaN where undefined."""
    flat = np.sqrt(x * x + y * y)
    wide = (np.abs(x) > 1e-5) | (np.abs(y) > 1e-5)
    polar = np.where(np.abs(z) < 1e-5, np.where(wide, 0.0, np.nan), np.sign(z) * np.pi / 2 - np.arctan(flat / z))
    none = (np.abs(x) < 1e-5) & (np.abs(y) < 1e-5)
    return np.sqrt(x * x + y * y + z * z), polar, np.where(none, np.nan, np.sign(y) * np.arccos(np.clip(x / flat, -1, 1)))


def _filled(own: np.ndarray, level: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Undefined features (a line each) by the nearest defined ones upstream; ``up``: the parents' columns, -1 at the start."""
    own = np.where(np.isfinite(own), own, np.nan)
    order = np.argsort(level, kind="stable")
    for c in own:
        found = order[~np.isnan(c[order])]
        start = np.flatnonzero((up < 0) & np.isnan(c))
        c[start] = c[found[0]] if len(found) else np.nan
    while (open_ := np.flatnonzero((up >= 0) & np.isnan(own).any(0))).size:
        above = up[open_]
        new = np.where(np.isnan(own[:, open_]), own[:, above], own[:, open_])
        further = up[above]
        own[:, open_], up[open_] = new, further
    return np.where(np.isnan(own), 0.0, own)


def _own(around: Around, places: list[tuple[np.ndarray, np.ndarray]], up: np.ndarray, down: np.ndarray, level: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Features (a line each) of the nodes at these places, from their own neighbourhoods."""
    line, size, place = around.lines(up, down, level, at)
    inside = np.arange(5) < size[:, None]
    with np.errstate(all="ignore"):
        x, y, z = points = [np.where(inside, value[line], 0.0) for value, _ in places]
        nulls = [~inside | null[line] for _, null in places]
        bends = curved_lines(list(zip(points, nulls, strict=True)), size, place)
        steps = np.zeros(len(at))
        for i in range(1, 5):
            dx, dy, dz = (c[:, i] - c[:, i - 1] for c in points)
            steps += np.where(inside[:, i], np.sqrt(dx * dx + dy * dy + dz * dz), 0.0)
        last = np.maximum(size - 1, 0)[:, None]
        ends = [np.take_along_axis(c, last, 1)[:, 0] - c[:, 0] for c in (x, y, z)]
        own = np.stack([steps / last[:, 0], *(f.fill_null(np.nan).to_numpy(zero_copy_only=False) for f in bends.flatten()), *_angles(*ends)])
    own[:, size < 3] = np.nan
    return own


def case_features(rows: pa.Table) -> pa.Table:
    """Features of a case's nodes for all of its accesses. rows: edges (src, dst, artificial, length, ends ax to bz), and starts
    with a NULL dst (src, access)."""
    edge = rows.column("dst").is_valid()
    edges, starts = rows.filter(edge), rows.filter(pc.invert(edge))
    src, dst = (edges.column(c).to_numpy() for c in ("src", "dst"))
    begin = starts.column("src").to_numpy()
    w = numbers(edges, "length")[0] if edges.num_rows else np.zeros(0)
    none = pa.nulls(len(begin), pa.float64())
    walk = Walk(pa.table({"src": np.concatenate([src, dst, begin]), "dst": pa.chunked_array([pa.array(dst), pa.array(src), pa.nulls(len(begin), pa.int64())]), "w": pa.chunked_array([pa.array(w), pa.array(w), none])}))
    a, b = np.searchsorted(walk.names, src), np.searchsorted(walk.names, dst)
    places = []
    for n in "xyz":
        value, null = np.full(len(walk.names), np.nan), np.ones(len(walk.names), bool)
        for end, at in (("a", a), ("b", b)):
            if len(at):
                value[at], null[at] = numbers(edges, f"{end}{n}")
        places.append((value, null))
    real = ~edges.column("artificial").to_numpy() if edges.num_rows else np.zeros(0, bool)
    around = Around(a[real], b[real], len(walk.names))
    case, out = rows.column("case_id"), []
    for access, start in zip(starts.column("access").to_pylist(), begin, strict=True):
        walk.starts = np.searchsorted(walk.names, [start])
        level, parent, total = walk.levels()
        at = np.flatnonzero(level >= 0)
        up, down = (around.smallest(w) for w in (level[around.dst] < level[around.src], level[around.dst] > level[around.src]))
        own = np.concatenate([np.zeros((len(FILLED), 0)), *(_own(around, places, up, down, level, at[i : i + NODES]) for i in range(0, len(at), NODES))], 1)
        own = _filled(own, level[at], np.where(parent[at] < 0, -1, np.searchsorted(at, parent[at])))
        out.append(pa.table({"case_id": named(case[0].as_py(), len(at), case.type), "access": pa.array([access]).take(pa.array(np.zeros(len(at), int))), "node_id": walk.names[at], "level": pa.array(level[at], pa.int32()), "accumulated": total[at], **dict(zip(FILLED, own, strict=True))}))
    if out:
        return pa.concat_tables(out)
    empty = pa.array([], pa.float64())
    return pa.table({"case_id": named(None, 0, case.type), "access": pa.array([], pa.string()), "node_id": pa.array([], pa.int64()), "level": pa.array([], pa.int32()), "accumulated": empty, **dict.fromkeys(FILLED, empty)})
