"""Density clustering (HDBSCAN) over blocks of space: exact, and no task sees all points.

1. Equal points become one with a weight.  A k-d tree of a bounded sample cuts space into at most ``BLOCKS`` blocks;
   what is known of all blocks everywhere is their bounding boxes.
2. A point's core distance is that of its ``size``-th nearest point.  It is searched for in the point's block; then the point
   visits the blocks whose boxes are nearer than what it has found.
3. The minimum spanning tree of the mutual reachability comes by Borůvka rounds.  A block joins its own components
   as long as nothing outside can be nearer; what is left of them is joined by rounds over all blocks, in which only points
   visit that may have an edge as light as their component's best so far.
4. A point's reach is the edge by which its component comes to have ``size`` points.  Blocks find it for what doesn't
   depend on other blocks; the rest, along their borders, is found tree by tree.  An edge that comes after the reach of both its ends
   splits two clusters; without these edges the tree falls into the leaves of the condensed tree.
5. The splits, a row each, and sums for each cluster reach the driver, which selects the clusters of most stability.

The work grows with the points times the blocks that balls of core distance meet: few in few dimensions, many in many.

Points of very many dimensions, few of them other than 0, come as pairs of dimension and value (``Space``).  Then boxes are
made in ``AXES`` dimensions only: no two points are nearer than their boxes, as before, but more boxes are visited.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParameterError
from .shared import Tables, tables

#: Blocks at most, points a block should have, and points of which the tree of blocks is made.
BLOCKS, POINTS_IN_BLOCK, SAMPLE = 1024, 2000, 20_000
#: Points that are compared with as many others at once.
LEAF = 128
#: Dimensions of the boxes of points given by dimension and value, and the least share of points that a cut leaves on a side of those.
AXES, LEAST_SIDE = 32, 1 / 8
#: Splits of two clusters at most; more are an error.
MOST_SPLITS = 1_000_000
#: Distances below this count as this where their reciprocals are summed.
LEAST_DISTANCE = 1e-9
NO_ID = np.iinfo(np.int64).max
NOISE = -1


# space


def coordinates(column: Iterable) -> np.ndarray:
    rows = list(column)
    return np.stack(rows).astype(float) if rows else np.zeros((0, 1))


class Rows:
    """Points by their coordinates other than 0, in order of dimension, and in ``box`` by those that boxes are made of."""

    def __init__(self, start: np.ndarray, dim: np.ndarray, value: np.ndarray, box: np.ndarray):
        self.start, self.dim, self.value, self.box = start, dim, value, box
        self.of = np.repeat(np.arange(len(start) - 1), np.diff(start))

    def __len__(self) -> int:
        return len(self.start) - 1

    def __getitem__(self, rows) -> Rows:
        rows = np.arange(len(self))[rows]
        size = self.start[rows + 1] - self.start[rows]
        start = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1])
        return Rows(start, self.dim[at], self.value[at], self.box[rows])

    def squares(self) -> np.ndarray:
        return np.bincount(self.of, self.value**2, minlength=len(self))

    def shares(self) -> np.ndarray:
        """A hash of each point in [0, 1)."""
        h = self.dim.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ self.value.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        total = np.zeros(len(self), np.uint64)
        np.add.at(total, self.of, h ^ h >> np.uint64(31))
        return (total >> np.uint64(11)) / 2.0**53

    def dense(self, dims: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self), len(dims)))
        out[self.of, np.searchsorted(dims, self.dim)] = self.value
        return out


class Space:
    """How a column of points is read: as all coordinates, or with ``axes`` as pairs of dimension and value, boxes being made in these axes."""

    def __init__(self, axes: np.ndarray | None = None):
        self.axes = axes

    def points(self, column: Iterable) -> np.ndarray | Rows:
        if self.axes is None:
            return coordinates(column)
        rows = [np.asarray(r, float) for r in column]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        dim, value, start = flat[::2].astype(np.int64), flat[1::2].copy(), np.r_[0, np.cumsum([len(r) // 2 for r in rows], dtype=np.int64)]
        out = Rows(start, dim, value, np.zeros((len(rows), len(self.axes))))
        if len(self.axes):  # none where only distances are asked for
            at = np.minimum(np.searchsorted(self.axes, dim), len(self.axes) - 1)
            own = self.axes[at] == dim
            out.box[out.of[own], at[own]] = value[own]
        return out

    def cuttable(self, column: Iterable) -> np.ndarray:
        """Coordinates by which points are dealt to blocks; with ``axes`` the last one is a hash, for points that these don't tell apart."""
        x = self.points(column)
        return x if self.axes is None else np.column_stack([x.box, x.shares()])


def boxed(x: np.ndarray | Rows) -> np.ndarray:
    """The coordinates that boxes are made of."""
    return x.box if isinstance(x, Rows) else x


def widest_axes(points: DataFrame) -> np.ndarray:
    """The ``AXES`` dimensions of most variance of points (x) given by dimension and value; any one if all points are 0."""
    n = points.count()
    pairs = points.filter(F.size("x") > 0).select(F.inline(F.transform(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2)), lambda i: F.struct(F.get("x", i).cast("long").alias("d"), F.get("x", i + 1).alias("v")))))
    spread = pairs.groupBy("d").agg((F.sum(F.col("v") * F.col("v")) / n - F.pow(F.sum("v") / n, 2)).alias("s"))
    return np.sort(np.array([r["d"] for r in spread.orderBy(F.desc("s"), "d").limit(AXES).collect()] or [0], np.int64))


class Cuts:
    """A k-d tree: which block a point falls into.

    ``even``: the last dimension is a hash, which cuts where every other one would leave little on a side.
    """

    def __init__(self, sample: np.ndarray, blocks: int, even: bool = False):
        self.dim, self.cut, self.child, self.block = [-1], [0.0], [(0, 0)], [0]
        held, count = {0: sample}, 1
        while count < blocks and held:
            node = max(held, key=lambda n: len(held[n]))
            x = held.pop(node)
            spread = x.max(0) - x.min(0) if len(x) else np.zeros(1)
            dims = [*np.argsort(-spread[:-1], kind="stable"), len(spread) - 1] if even else [int(spread.argmax())]
            for d in dims:
                if not spread[d] > 0:
                    continue
                values = x[:, d]
                cut = float(np.median(values))
                if cut >= values.max():
                    cut = float(values[values < values.max()].max())
                if d == dims[-1] or min((values <= cut).mean(), (values > cut).mean()) >= LEAST_SIDE:
                    break
            else:
                continue
            left, right = len(self.dim), len(self.dim) + 1
            self.dim[node], self.cut[node], self.child[node] = d, cut, (left, right)
            self.dim += [-1, -1]
            self.cut += [0.0, 0.0]
            self.child += [(0, 0), (0, 0)]
            self.block += [self.block[node], count]
            held[left], held[right] = x[values <= cut], x[values > cut]
            count += 1

    def of(self, x: np.ndarray) -> np.ndarray:
        dim, cut, child, at = np.array(self.dim), np.array(self.cut), np.array(self.child), np.zeros(len(x), int)
        while len(x) and (dim[at] >= 0).any():
            inner = np.flatnonzero(dim[at] >= 0)
            node = at[inner]
            at[inner] = child[node, (x[inner, dim[node]] > cut[node]).astype(int)]
        return np.array(self.block)[at]


class Boxes:
    """Bounding boxes of numbered sets of points."""

    def __init__(self, number: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.number, self.low, self.high = number, low, high

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.number, self.low, self.high

    def distance(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From each of the boxes (low, high) to each of these: no two points of them are nearer."""
        out = np.zeros((len(low), len(self.low)))
        for d in range(low.shape[1]):
            out += np.maximum(0.0, np.maximum(self.low[None, :, d] - high[:, d, None], low[:, d, None] - self.high[None, :, d])) ** 2
        return np.sqrt(out)


def leaves_of(x: np.ndarray | Rows) -> list[np.ndarray]:
    """Rows of x in groups of ``LEAF`` or fewer neighbours."""
    x = boxed(x)
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        d = int((x[rows].max(0) - x[rows].min(0)).argmax())
        order = rows[np.argsort(x[rows, d], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return out


def boxes_of(x: np.ndarray | Rows, groups: list[np.ndarray]) -> Boxes:
    x = boxed(x)
    return Boxes(np.arange(len(groups)), np.stack([x[g].min(0) for g in groups]), np.stack([x[g].max(0) for g in groups]))


def distances(a: np.ndarray | Rows, b: np.ndarray | Rows) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    if isinstance(a, Rows):
        for i in range(0, len(a), LEAF):
            for j in range(0, len(b), LEAF):
                out[i : i + LEAF, j : j + LEAF] = _squares_apart(a[i : i + LEAF], b[j : j + LEAF])
        return np.sqrt(out)
    for d in range(a.shape[1]):
        out += (a[:, d, None] - b[None, :, d]) ** 2
    return np.sqrt(out)


def _squares_apart(a: Rows, b: Rows) -> np.ndarray:
    """Squared distances: of points without a common dimension from their squares, of others by dimensions in order; the same in any group."""
    out = a.squares()[:, None] + b.squares()[None]
    common = np.intersect1d(a.dim, b.dim)
    if len(common):
        i, j = np.unique(a.of[np.isin(a.dim, common)]), np.unique(b.of[np.isin(b.dim, common)])
        a, b = a[i], b[j]
        dims = np.union1d(a.dim, b.dim)
        x, y = a.dense(dims), b.dense(dims)
        apart = np.zeros((len(i), len(j)))
        for d in range(len(dims)):
            apart += (x[:, d, None] - y[None, :, d]) ** 2
        meet = (x != 0).astype(float) @ (y != 0).astype(float).T > 0
        out[np.ix_(i, j)] = np.where(meet, apart, out[np.ix_(i, j)])
    return out


# searches within a block


def nearest(q: np.ndarray | Rows, within: np.ndarray, x: np.ndarray | Rows, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each q distances and weights of its ``size`` nearest of the points x, inf where there are fewer or none ``within``."""
    dist, weight = np.full((len(q), size), np.inf), np.zeros((len(q), size), np.int64)
    groups = leaves_of(x)
    boxes = boxes_of(x, groups)
    for rows in leaves_of(q):
        apart = boxes.distance(boxed(q)[rows].min(0)[None], boxed(q)[rows].max(0)[None])[0]
        for j in np.argsort(apart, kind="stable"):
            if apart[j] > np.minimum(within[rows], dist[rows, -1]).max():
                break
            d = np.hstack([dist[rows], distances(q[rows], x[groups[j]])])
            w = np.hstack([weight[rows], np.broadcast_to(g[groups[j]], (len(rows), len(groups[j])))])
            first = np.argsort(d, axis=1, kind="stable")[:, :size]
            dist[rows], weight[rows] = np.take_along_axis(d, first, 1), np.take_along_axis(w, first, 1)
    return dist, weight


def core_of(dist: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Distance at which the nearest ones weigh ``size``; inf if they don't."""
    enough = np.cumsum(np.where(np.isfinite(dist), weight, 0), 1) >= size
    return np.where(enough.any(1), dist[np.arange(len(dist)), enough.argmax(1)], np.inf)


class Lightest:
    """The lightest edge of each component, ties by the smaller and then the larger id of its ends."""

    def __init__(self, bound: np.ndarray):
        n = len(bound)
        self.w, self.lo, self.hi, self.to = bound.astype(float), np.full(n, NO_ID), np.full(n, NO_ID), np.full(n, -1)

    def offer(self, comp: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray, to: np.ndarray) -> None:
        order = np.lexsort((hi, lo, w, comp))
        order = order[np.r_[True, comp[order][1:] != comp[order][:-1]]]
        c, w, lo, hi, to = comp[order], w[order], lo[order], hi[order], to[order]
        better = (w < self.w[c]) | ((w == self.w[c]) & ((lo < self.lo[c]) | ((lo == self.lo[c]) & (hi < self.hi[c]))))
        c = c[better]
        self.w[c], self.lo[c], self.hi[c], self.to[c] = w[better], lo[better], hi[better], to[better]


def lightest_edges(q: dict, p: dict, bound: np.ndarray) -> Lightest:
    """Of each component of q the lightest edge to a point of p in another one, if not heavier than its ``bound``."""
    best = Lightest(bound)
    groups = leaves_of(p["x"])
    boxes = boxes_of(p["x"], groups)
    alone = np.array([p["comp"][r[0]] if (p["comp"][r] == p["comp"][r[0]]).all() else -1 for r in groups])
    for rows in leaves_of(q["x"]):
        apart = boxes.distance(boxed(q["x"])[rows].min(0)[None], boxed(q["x"])[rows].max(0)[None])[0]
        for j in np.argsort(apart, kind="stable"):
            limit = best.w[q["comp"][rows]]
            if apart[j] > limit.max():
                break
            i = rows[(np.maximum(apart[j], q["core"][rows]) <= limit) & (q["comp"][rows] != alone[j])]
            if not len(i):
                continue
            r = groups[j]
            w = np.maximum(np.maximum(distances(q["x"][i], p["x"][r]), q["core"][i, None]), p["core"][None, r])
            w[q["comp"][i, None] == p["comp"][None, r]] = np.inf
            least = w.min(1)
            ok = np.isfinite(least) & (least <= best.w[q["comp"][i]])
            if not ok.any():
                continue
            i, w, least = i[ok], w[ok], least[ok]
            ties = w == least[:, None]
            lo = np.where(ties, np.minimum(q["id"][i, None], p["id"][None, r]), NO_ID)
            first = lo.min(1)
            hi = np.where(ties & (lo == first[:, None]), np.maximum(q["id"][i, None], p["id"][None, r]), NO_ID)
            best.offer(q["comp"][i], least, first, hi.min(1), p["comp"][r[hi.argmin(1)]])
    return best


def roots_of(parent: np.ndarray) -> np.ndarray:
    """Roots of a forest of pointers, in which two may point at each other."""
    at = np.arange(len(parent))
    parent = np.where((parent[parent] == at) & (at < parent), at, parent)
    while not (parent[parent] == parent).all():
        parent = parent[parent]
    return parent


def joined_inside(p: dict, outside: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Components of a block's points by edges that are lighter than any to a point outside, and these edges."""
    comp, edges = np.arange(len(p["id"])), {}
    while True:
        n = int(comp.max()) + 1
        best = lightest_edges(p | {"comp": comp}, p | {"comp": comp}, np.full(n, np.inf))
        beyond = np.full(n, np.inf)
        np.minimum.at(beyond, comp, outside)
        sure = np.flatnonzero((best.to >= 0) & (best.w < beyond))
        if not len(sure):
            return comp, list(edges.values())
        for c in sure:
            edges[best.lo[c], best.hi[c]] = (best.w[c], best.lo[c], best.hi[c])
        parent = np.arange(n)
        parent[sure] = best.to[sure]
        _, comp = np.unique(roots_of(parent)[comp], return_inverse=True)


def reach_inside(ids: np.ndarray, g: np.ndarray, core: np.ndarray, edges: list[tuple], leaving: dict[int, tuple], size: int) -> tuple[list[tuple | None], np.ndarray]:
    """Reach of the points of a block (none where other blocks matter) and the components of those without one.

    ``edges`` (w, lo, hi) of the spanning tree inside the block, ``leaving``: the lightest edge of a point to another block.
    """
    last = (np.inf, -1, -1)
    at = {int(k): j for j, k in enumerate(ids)}
    parent, weight, stuck = list(range(len(ids))), g.astype(int).tolist(), [False] * len(ids)
    away = [leaving.get(int(k), last) for k in ids]
    reach = [(float(c), -1, -1) if w >= size else None for c, w in zip(core, weight, strict=True)]
    members = {j: [j] for j in range(len(ids)) if weight[j] < size}

    def root(j: int) -> int:
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        return j

    for edge in sorted(edges):
        a, b = root(at[edge[1]]), root(at[edge[2]])
        small = [j for j in (a, b) if weight[j] < size]
        held = [j for j in small if stuck[j] or away[j] < edge]
        if not small:
            continue
        if held:  # what comes first for one of them lies outside; the other waits for it, unless it is large
            for j in small if len(small) == 2 else held:
                stuck[j] = True
            continue
        parent[b] = a
        weight[a] += weight[b]
        away[a] = min(away[a], away[b])
        moved = members.pop(a, []) + members.pop(b, [])
        if weight[a] >= size:
            for j in moved:
                reach[j] = edge
        else:
            members[a] = moved
    node = ids.copy()
    for rows in members.values():
        node[rows] = ids[rows].min()
    return reach, node


def reach_among(weight: dict[int, int], arcs: list[tuple], size: int) -> dict[int, tuple]:
    """Reach of each node of a tree; ``arcs`` (edge, node, other node or none, the reach of an end that has one) in order.

    What joins a point or a component of known reach has the later of this reach and the edge that joins.
    """
    parent, held, members, known = {n: n for n in weight}, dict(weight), {n: [n] for n in weight}, {}
    out: dict[int, tuple] = {}

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    def settle(n: int, reach: tuple) -> None:
        known[n] = reach
        out.update(dict.fromkeys(members.pop(n), reach))

    for edge, node, other, reach in arcs:
        a = root(node)
        if other is None:
            if a not in known:
                settle(a, max(edge, reach))
            continue
        b = root(other)
        if a in known and b in known:
            continue
        if a in known or b in known:
            a, b = (a, b) if a in known else (b, a)
            settle(b, max(edge, known[a]))
            continue
        parent[b] = a
        held[a] += held[b]
        members[a] += members.pop(b)
        if held[a] >= size:
            settle(a, edge)
    return out


# over all blocks


def _block(ids: Column | str) -> Column:
    return F.shiftright(ids, 32).cast("int")


def _frame(columns: dict) -> pd.DataFrame:
    return pd.DataFrame(columns)


def points_with_cores(points: DataFrame, size: int, keep: Tables, space: Space = Space()) -> tuple[DataFrame, "Boxes"]:  # noqa: B008
    """id, b (block), x, g, core and out (distance to the nearest other box) of the distinct points (x, g); and the boxes.

    A block is one group: it has about ``POINTS_IN_BLOCK`` points, or a share of 1 / ``BLOCKS`` of very many.
    """
    spark = points.sparkSession
    sparse = space.axes is not None

    @F.pandas_udf("array<double>")
    def cuttable(x: pd.Series) -> pd.Series:
        return pd.Series(list(space.cuttable(x)) if len(x) else [], dtype=object)

    some = points.orderBy(F.xxhash64("x")).limit(SAMPLE)
    sample = coordinates(r["x"] for r in some.select(cuttable("x").alias("x") if sparse else "x").collect())
    n, width = points.count(), sample.shape[1]
    cuts = Cuts(sample, int(min(BLOCKS, max(1, -(-n // POINTS_IN_BLOCK)))), sparse)

    @F.pandas_udf("int")
    def block(x: pd.Series) -> pd.Series:
        return pd.Series(cuts.of(space.cuttable(x)) if len(x) else [], dtype="int32")

    dealt = points.withColumn("b", block("x"))

    def number(part: pd.DataFrame) -> pd.DataFrame:
        x = space.points(part.x)
        order = np.array(sorted(range(len(x)), key=lambda j: tuple(part.x.iloc[j]))) if sparse else np.lexsort(x.T[::-1])
        x, raw, g, b = x[order], part.x.iloc[order], part.g.to_numpy()[order], int(part.b.iloc[0])
        dist, weight = nearest(x, np.full(len(x), np.inf), x, g, size)
        return _frame({"id": (b << 32) + np.arange(len(x)), "b": b, "x": list(raw), "g": g, "core": core_of(dist, weight, size), "dist": list(dist), "weight": list(weight)})

    numbered = keep.keep(dealt.groupBy("b").applyInPandas(number, "id long, b int, x array<double>, g long, core double, dist array<double>, weight array<long>"))
    at, width = (cuttable("x"), width - 1) if sparse else (F.col("x"), width)
    ends = numbered.select("b", at.alias("x")).groupBy("b").agg(*(f(F.get("x", F.lit(d))).alias(f"{n}{d}") for d in range(width) for n, f in (("a", F.min), ("z", F.max)))).orderBy("b").collect()  # at most BLOCKS
    boxes = Boxes(np.array([r["b"] for r in ends]), *(np.array([[r[f"{n}{d}"] for d in range(width)] for r in ends]) for n in "az"))

    visits = visiting(numbered.select("id", "b", "x", F.col("core").alias("within")), boxes, space)

    def visit(part: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(guests):
            return _frame({"id": [], "d": [], "w": []})
        dist, weight = nearest(space.points(guests.x), guests.within.to_numpy(), space.points(part.x), part.g.to_numpy(), size)
        found = np.isfinite(dist) & (dist <= guests.within.to_numpy()[:, None])
        return _frame({"id": np.broadcast_to(guests.id.to_numpy()[:, None], dist.shape)[found], "d": dist[found], "w": weight[found]})

    met = numbered.select("b", "x", "g").groupBy("b").cogroup(visits.groupBy("b")).applyInPandas(visit, "id long, d double, w long")
    met = met.groupBy("id").agg(F.collect_list(F.struct("d", "w")).alias("met"))  # at most ``size`` for each block visited
    own = F.transform(F.arrays_zip("dist", "weight"), lambda s: F.struct(s["dist"].alias("d"), s["weight"].alias("w")))
    every = F.filter(F.array_sort(F.concat(own, F.coalesce("met", F.array().cast("array<struct<d: double, w: bigint>>")))), lambda s: s["w"] > 0)
    start = F.struct(F.lit(0).cast("long").alias("w"), F.lit(float("inf")).alias("d"))
    core = F.aggregate(every, start, lambda a, s: F.when(a["w"] >= size, a).otherwise(F.struct((a["w"] + s["w"]).alias("w"), s["d"].alias("d"))), lambda a: F.when(a["w"] >= size, a["d"]).otherwise(F.lit(float("inf"))))
    shared = spark.sparkContext.broadcast(boxes.arrays())

    @F.pandas_udf("double")
    def out(x: pd.Series, b: pd.Series) -> pd.Series:
        every = Boxes(*shared.value)
        if not len(x) or len(every.number) < 2:
            return pd.Series(np.full(len(x), np.inf))
        at = boxed(space.points(x))
        apart = np.concatenate([every.distance(at[k : k + 256], at[k : k + 256]) for k in range(0, len(at), 256)])
        apart[every.number[None] == b.to_numpy()[:, None]] = np.inf
        return pd.Series(apart.min(1))

    return keep.keep(numbered.join(met, "id", "left").select("id", "b", "x", "g", core.alias("core"), out("x", "b").alias("out"))), boxes


def visiting(rows: DataFrame, boxes: Boxes, space: Space) -> DataFrame:
    """``rows`` (id, b, x, within, ..) once for each other block whose box is ``within`` reach, with b that block."""
    shared = rows.sparkSession.sparkContext.broadcast(boxes.arrays())

    @F.pandas_udf("array<int>")
    def to(x: pd.Series, b: pd.Series, within: pd.Series) -> pd.Series:
        every, found = Boxes(*shared.value), []
        for k in range(0, len(x), 256):
            at = boxed(space.points(x[k : k + 256]))
            near = every.distance(at, at) <= within[k : k + 256].to_numpy()[:, None]
            near &= every.number[None] != b[k : k + 256].to_numpy()[:, None]
            found += [every.number[r] for r in near]
        return pd.Series(found, dtype=object)

    out = rows.withColumn("b", F.explode(to("x", "b", "within")))
    return out.select(*(F.col(c).alias(c) for c in out.columns))  # columns of their own beside those of ``rows``


_POINT = "id long, b int, x array<double>, g long, core double, comp long"
_EDGE = "w double, lo long, hi long"


def _arrays(part: pd.DataFrame, comps: np.ndarray, space: Space) -> dict:
    return {"x": space.points(part.x), "core": part.core.to_numpy(), "id": part.id.to_numpy(), "comp": np.searchsorted(comps, part.comp.to_numpy())}


def _found(best: Lightest, comps: np.ndarray) -> pd.DataFrame:
    rows = best.to >= 0
    return _frame({"comp": comps[rows], "w": best.w[rows], "lo": best.lo[rows], "hi": best.hi[rows], "other": comps[best.to[rows]]})


def spanning_tree(points: DataFrame, boxes: Boxes, keep: Tables, space: Space = Space()) -> DataFrame:  # noqa: B008
    """w, lo, hi: the edges of a minimum spanning tree of the mutual reachability of ``points`` (id, b, x, g, core, out)."""

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        p = {"x": space.points(part.x), "core": part.core.to_numpy(), "id": part.id.to_numpy()}
        comp, edges = joined_inside(p, part.out.to_numpy())
        first = np.full(int(comp.max()) + 1, NO_ID)
        np.minimum.at(first, comp, p["id"])
        rows = part[["id", "b", "x", "g", "core"]].assign(comp=first[comp], w=np.nan, lo=0, hi=0)
        made = _frame({"id": -1, "b": rows.b.iloc[0], "x": None, "g": 0, "core": np.nan, "comp": -1, "w": [e[0] for e in edges], "lo": [e[1] for e in edges], "hi": [e[2] for e in edges]})
        return pd.concat([rows, made], ignore_index=True) if edges else rows

    both = keep.keep(points.groupBy("b").applyInPandas(inside, f"{_POINT}, {_EDGE}"))
    edges, at = both.filter("id < 0").select("w", "lo", "hi"), both.filter("id >= 0").select("id", "b", "x", "g", "core", "comp")
    spark = points.sparkSession
    schema = "comp long, w double, lo long, hi long, other long"

    def own(part: pd.DataFrame) -> pd.DataFrame:
        comps = np.unique(part.comp.to_numpy())
        p = _arrays(part, comps, space)
        return _found(lightest_edges(p, p, np.full(len(comps), np.inf)), comps)

    def met(part: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(guests):
            return _frame({"comp": [], "w": [], "lo": [], "hi": [], "other": []})
        comps = np.unique(np.r_[part.comp.to_numpy(), guests.comp.to_numpy()])
        q, bound = _arrays(guests, comps, space), np.full(len(comps), -np.inf)
        bound[q["comp"]] = guests.within.to_numpy()
        return _found(lightest_edges(q, _arrays(part, comps, space), bound), comps)

    while not at.select("comp").distinct().limit(2).count() < 2:
        found = keep.keep(at.groupBy("b").applyInPandas(own, schema))
        # a component that fills its blocks alone gets a bound from one point of each block
        some = at.groupBy("b").agg(F.min(F.struct("id", "x", "core", "comp")).alias("p")).select("p.*").collect()  # at most BLOCKS
        x, core, comp = space.points(r["x"] for r in some), np.array([r["core"] for r in some]), np.array([r["comp"] for r in some])
        w = np.maximum(np.maximum(distances(x, x), core[:, None]), core[None])
        w[comp[:, None] == comp[None]] = np.inf
        rough = [(int(c), float(v)) for c, v in zip(comp, w.min(1), strict=True) if np.isfinite(v)]
        bounds = found.select("comp", "w").unionByName(spark.createDataFrame(rough, "comp long, w double"))
        bounds = keep.keep(bounds.groupBy("comp").agg(F.min("w").alias("within")))
        guests = at.join(bounds, "comp").filter("core <= within").select("id", "b", "x", "core", "comp", "within")
        more = at.groupBy("b").cogroup(visiting(guests, boxes, space).groupBy("b")).applyInPandas(met, schema)
        best = found.unionByName(more).groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e"))
        best = keep.keep(best.select("comp", "e.*"))
        edges = edges.unionByName(best.select("w", "lo", "hi").distinct())
        at = keep.keep(at.join(_roots(best.select("comp", F.col("other").alias("to")), keep), "comp").drop("comp").withColumnRenamed("root", "comp").select("id", "b", "x", "g", "core", "comp"))
    return keep.keep(edges)


def _roots(pointers: DataFrame, keep: Tables) -> DataFrame:
    """comp, root of a forest of pointers (comp, to), in which two may point at each other: jumps that double in length."""
    back = pointers.select(F.col("comp").alias("to"), F.col("to").alias("back"))
    known = pointers.join(back, "to", "left")
    at = keep.keep(known.select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root")))
    while True:
        further = at.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        jumped = keep.keep(at.join(further, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if jumped.filter("moved").isEmpty():
            return at
        at = jumped.select("comp", "root")


def _by_block(edges: DataFrame) -> DataFrame:
    """Edges (b, v, w, lo, hi): those inside block b with v -1, others for each end v."""
    a, z = _block("lo"), _block("hi")
    row = lambda b, v: F.struct(b.alias("b"), v.cast("long").alias("v"), "w", "lo", "hi")
    return edges.select(F.inline(F.when(a == z, F.array(row(a, F.lit(-1)))).otherwise(F.array(row(a, F.col("lo")), row(z, F.col("hi"))))))


def reaches(points: DataFrame, edges: DataFrame, size: int, keep: Tables) -> DataFrame:
    """id, t: the edge (w, lo, hi) by which a point's component comes to weigh ``size``, edges taken in order.

    A point that weighs so much by itself has its core distance and no ends.  What is open after the blocks' own
    work, components that touch other blocks before they are large, is done by trees of such components: small
    ones along the borders, unless ``size`` is above what a block holds.
    """

    def inside(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        inner, leaving = [], {}
        for v, *edge in zip(*(own[c].tolist() for c in ("v", "w", "lo", "hi")), strict=True):
            if v < 0:
                inner.append(tuple(edge))
            else:
                leaving[v] = min(leaving.get(v, tuple(edge)), tuple(edge))
        reach, node = reach_inside(part.id.to_numpy(), part.g.to_numpy(), part.core.to_numpy(), inner, leaving, size)
        w, lo, hi = ([None if r is None else r[k] for r in reach] for k in range(3))
        return _frame({"id": part.id.to_numpy(), "g": part.g.to_numpy(), "w": pd.array(w, "Float64"), "lo": pd.array(lo, "Int64"), "hi": pd.array(hi, "Int64"), "node": node})

    found = points.select("id", "b", "g", "core").groupBy("b").cogroup(_by_block(edges).groupBy("b")).applyInPandas(inside, "id long, g long, w double, lo long, hi long, node long")
    found = keep.keep(found.select("id", "g", "node", F.when(F.col("w").isNotNull(), F.struct("w", "lo", "hi")).alias("t")))
    done = found.filter("t is not null").select("id", "t")
    left = found.filter("t is null").select("id", "g", "node")
    where = keep.keep(left.select("id", "node", "g"))  # what blocks couldn't tell, as nodes of a forest
    if where.isEmpty():
        return done
    at = lambda c: where.select(F.col("id").alias(c), F.col("node").alias(f"{c}_node"))
    known = lambda c: done.select(F.col("id").alias(c), F.col("t").alias(f"{c}_t"))
    open_ = edges.join(at("lo"), "lo", "left").join(at("hi"), "hi", "left").filter("lo_node is not null or hi_node is not null")
    open_ = keep.keep(open_.join(known("lo"), "lo", "left").join(known("hi"), "hi", "left"))
    links = open_.filter("lo_node <> hi_node").select(F.greatest("lo_node", "hi_node").alias("comp"), F.least("lo_node", "hi_node").alias("to"))
    tree = _forest(links, where.select(F.col("node").alias("id")).distinct(), keep)
    name = lambda c: tree.select(F.col("id").alias(c), F.col("leaf").alias("tree"))
    nodes = where.groupBy("node").agg(F.sum("g").alias("g")).join(name("node"), "node")
    arcs = open_.filter("lo_node is null or hi_node is null or lo_node <> hi_node").select(
        "w", "lo", "hi", F.coalesce("lo_node", "hi_node").alias("node"), F.when(F.col("lo_node").isNotNull(), F.col("hi_node")).alias("other"), F.coalesce("lo_t", "hi_t").alias("t")
    )
    arcs = arcs.join(name("node"), "node").select("tree", "node", "other", "w", "lo", "hi", F.col("t.w").alias("tw"), F.col("t.lo").alias("tlo"), F.col("t.hi").alias("thi"))

    def among(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(own.w.tolist(), own.lo.tolist(), own.hi.tolist(), own.node.tolist(), own.other.tolist(), own.tw.tolist(), own.tlo.tolist(), own.thi.tolist(), strict=True), key=lambda r: r[:3])
        arcs = [(r[:3], r[3], None if r[4] != r[4] or r[4] is None else int(r[4]), (r[5], int(r[6]), int(r[7])) if r[5] == r[5] and r[5] is not None else None) for r in rows]
        found = reach_among(dict(zip(part.node.tolist(), part.g.tolist(), strict=True)), arcs, size)
        return _frame({"node": list(found), **{c: [v[k] for v in found.values()] for k, c in enumerate(("w", "lo", "hi"))}})

    rest = keep.keep(nodes.groupBy("tree").cogroup(arcs.groupBy("tree")).applyInPandas(among, "node long, w double, lo long, hi long"))
    return done.unionByName(where.join(rest, "node").select("id", F.struct("w", "lo", "hi").alias("t")))


def connected(points: DataFrame, edges: DataFrame, keep: Tables) -> DataFrame:
    """id, leaf: the components of a forest: each block joins its own edges, then what these make is joined."""

    def inside(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(part.id.to_numpy())
        parent = np.arange(len(ids))
        for a, b in zip(*(np.searchsorted(ids, own[own.v < 0][c].to_numpy()) for c in ("lo", "hi")), strict=True):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            parent[max(a, b)] = min(a, b)
        while not (parent[parent] == parent).all():
            parent = parent[parent]
        return _frame({"id": ids, "leaf": ids[parent]})

    at = keep.keep(points.select("id", "b").groupBy("b").cogroup(_by_block(edges).groupBy("b")).applyInPandas(inside, "id long, leaf long"))
    to = lambda c: at.select(F.col("id").alias(c), F.col("leaf").alias(f"{c}_leaf"))
    links = edges.filter(_block("lo") != _block("hi")).join(to("lo"), "lo").join(to("hi"), "hi")
    root = _forest(links.select(F.greatest("lo_leaf", "hi_leaf").alias("comp"), F.least("lo_leaf", "hi_leaf").alias("to")), at.select(F.col("leaf").alias("id")).distinct(), keep)
    return at.join(root.select(F.col("id").alias("leaf"), F.col("leaf").alias("root")), "leaf").select("id", F.col("root").alias("leaf"))


def _forest(links: DataFrame, ids: DataFrame, keep: Tables) -> DataFrame:
    """id, leaf: the components that ``links`` (comp, to: a smaller id) make of ``ids``, named by their smallest."""
    at, left = keep.keep(ids.select("id", F.col("id").alias("leaf"))), keep.keep(links)
    while not left.isEmpty():
        step = keep.keep(left.groupBy("comp").agg(F.min("to").alias("to")))
        # pointers fall, so they end at ids that don't point on
        ends = step.select(F.col("to").alias("comp")).join(step.select("comp"), "comp", "left_anti").distinct().select("comp", F.col("comp").alias("to"))
        root = _roots(step.unionByName(ends), keep)
        at = keep.keep(at.join(root.select(F.col("comp").alias("leaf"), "root"), "leaf", "left").select("id", F.coalesce("root", "leaf").alias("leaf")))
        named = lambda c: root.select(F.col("comp").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = left.join(named("comp"), "comp", "left").join(named("to"), "to", "left").select(F.coalesce("comp_root", "comp").alias("a"), F.coalesce("to_root", "to").alias("z"))
        left = keep.keep(moved.filter("a <> z").select(F.greatest("a", "z").alias("comp"), F.least("a", "z").alias("to")).distinct())
    return at


# the condensed tree


class Condensed:
    """Clusters of a condensed tree: leaves first, then what splits join, each above its parts; the last is the root.

    ``parent`` and ``top`` (the distance at which a cluster becomes a part of its parent).  Edges of one distance
    count at once: a leaf whose ``least`` reach is the distance at which it is joined isn't a cluster, and its
    points are ``home`` in what it joins.
    """

    def __init__(self, leaves: np.ndarray, least: np.ndarray, splits: list[tuple[float, int, int]]):
        self.leaves, self.home = leaves, np.arange(len(leaves))
        self.parent, self.top, self.parts = [-1] * len(leaves), [np.inf] * len(leaves), [[] for _ in leaves]
        owner = list(range(len(leaves)))
        cluster = list(range(len(leaves)))  # of each root of ``owner``

        def root(j: int) -> int:
            while owner[j] != j:
                owner[j] = j = owner[owner[j]]
            return j

        rows = sorted((w, int(np.searchsorted(leaves, a)), int(np.searchsorted(leaves, b))) for w, a, b in splits)
        k = 0
        while k < len(rows):
            w, parts = rows[k][0], {}
            while k < len(rows) and rows[k][0] == w:  # all splits of one distance at once
                a, b = root(rows[k][1]), root(rows[k][2])
                parts[a] = parts.pop(a, [cluster[a]]) + parts.pop(b, [cluster[b]])
                owner[b] = a
                k += 1
            for a, every in parts.items():
                none = [c for c in every if c < len(leaves) and least[c] >= w]
                below = [c for c in every if c not in none]
                if len(below) > 1:
                    new = len(self.parent)
                    for c in below:
                        self.parent[c], self.top[c] = new, w
                    self.parent.append(-1)
                    self.top.append(np.inf)
                    self.parts.append(below)
                else:
                    new = below[0] if below else none[0]
                self.home[none] = new
                cluster[a] = new

    def chosen(self, weight: np.ndarray, fallen: np.ndarray, epsilon: float) -> np.ndarray:
        """Label of each cluster or ``NOISE``: of what lies in a selected cluster, by size.

        ``weight`` and ``fallen``: points that fall out of a cluster, and the sum of their reciprocal reaches.
        """
        n = len(self.parent)
        rate = np.where(np.isinf(self.top), 0.0, 1 / np.maximum(self.top, LEAST_DISTANCE))
        size, below, selected = weight.astype(float).copy(), np.zeros(n), np.zeros(n, bool)
        for c in range(n):  # parts come before what they are parts of
            stable = fallen[c] - weight[c] * rate[c]
            for part in self.parts[c]:
                size[c] += size[part]
                stable += size[part] * (rate[part] - rate[c])
            inner = sum(below[p] for p in self.parts[c])
            selected[c] = self.parent[c] >= 0 and (not self.parts[c] or stable >= inner)
            below[c] = stable if selected[c] else inner
        if epsilon > 0:
            for c in np.flatnonzero(self._outermost(selected)):
                if self.top[c] < epsilon:
                    while self.top[c] <= epsilon and self.parent[self.parent[c]] >= 0:
                        c = self.parent[c]
                selected[c] = True
        outer = self._outermost(selected)
        order = sorted(np.flatnonzero(outer), key=lambda c: (-size[c], self._first(c)))
        label = np.full(n, NOISE)
        label[order] = np.arange(len(order))
        for c in range(n - 1, -1, -1):
            if self.parent[c] >= 0 and label[self.parent[c]] >= 0:
                label[c] = label[self.parent[c]]
        return label

    def _first(self, c: int) -> int:
        while self.parts[c]:
            c = min(self.parts[c])
        return c

    def _outermost(self, selected: np.ndarray) -> np.ndarray:
        out, covered = selected.copy(), np.zeros(len(selected), bool)
        for c in range(len(selected) - 1, -1, -1):
            p = self.parent[c]
            covered[c] = p >= 0 and (covered[p] or selected[p])
        return out & ~covered


def places(leaves: np.ndarray, home: np.ndarray, parent: np.ndarray, top: np.ndarray, leaf: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The cluster that each point (leaf, reach) falls out of: the smallest that still is one at its reach."""
    at = home[np.searchsorted(leaves, leaf)]
    while True:
        up = (top[at] <= t) & (parent[at] >= 0)
        if not up.any():
            return at
        at = np.where(up, parent[at], at)


class DensityModel:
    """The condensed tree of points: ``labels`` for any epsilon."""

    def __init__(self, placed: DataFrame | None, tree: Condensed | None):
        self.placed, self.tree = placed, tree
        if tree is not None:
            sums = placed.groupBy("cluster").agg(F.sum("g").alias("g"), F.sum(F.col("g") / F.greatest("t", F.lit(LEAST_DISTANCE))).alias("r")).collect()
            self.weight, self.fallen = np.zeros(len(tree.parent)), np.zeros(len(tree.parent))
            for r in sums:
                self.weight[r["cluster"]], self.fallen[r["cluster"]] = r["g"], r["r"]

    def labels(self, points: DataFrame, epsilon: float = 0.0) -> DataFrame:
        """x, label (-1: noise) of the distinct points."""
        if self.tree is None:
            return points.select("x", F.lit(NOISE).alias("label"))
        chosen = self.tree.chosen(self.weight, self.fallen, epsilon)

        @F.pandas_udf("int")
        def label(cluster: pd.Series) -> pd.Series:
            return pd.Series(chosen[cluster.to_numpy()] if len(cluster) else [], dtype="int32")

        return self.placed.select("x", label("cluster").alias("label"))


def density_model(points: DataFrame, size: int, keep: Tables, sparse: bool = False) -> DensityModel:
    """The condensed tree of weighted distinct points (x, g) for clusters of ``size`` or more; placed points stay in ``keep``.

    ``sparse``: x holds dimension and value in turn, in order of dimension, of the coordinates other than 0.
    """
    if isinstance(size, bool) or not isinstance(size, int) or size < 2:
        raise ParameterError(f"min_cluster_size is 2 or more, got {size!r}")
    if (points.agg(F.sum("g").alias("g")).first()["g"] or 0) < size:
        return DensityModel(None, None)
    with tables(points.sparkSession) as work:
        space = Space(widest_axes(points)) if sparse else Space()
        at, boxes = points_with_cores(points, size, work, space)
        edges = spanning_tree(at, boxes, work, space)
        reach = work.keep(reaches(at, edges, size, work))
        of = lambda c: reach.select(F.col("id").alias(c), F.col("t").alias(f"{c}_t"))
        marked = work.keep(edges.join(of("lo"), "lo").join(of("hi"), "hi").withColumn("split", F.struct("w", "lo", "hi") > F.greatest("lo_t", "hi_t")))
        leaf = work.keep(connected(at, marked.filter("not split").select("w", "lo", "hi"), work))
        name = lambda c: leaf.select(F.col("id").alias(c), F.col("leaf").alias(f"{c}_leaf"))
        splits = marked.filter("split").join(name("lo"), "lo").join(name("hi"), "hi").select("w", "lo_leaf", "hi_leaf").limit(MOST_SPLITS + 1).collect()
        if len(splits) > MOST_SPLITS:
            raise ParameterError(f"more than {MOST_SPLITS} splits of clusters: raise min_cluster_size")
        names = np.unique([v for r in splits for v in (r["lo_leaf"], r["hi_leaf"])]).astype(np.int64) if splits else np.zeros(0, np.int64)
        if not splits:
            return DensityModel(None, None)
        rows = work.keep(at.select("id", "x", "g").join(reach.select("id", F.col("t.w").alias("t")), "id").join(leaf, "id"))
        least = {r["leaf"]: r["t"] for r in rows.groupBy("leaf").agg(F.min("t").alias("t")).collect()}  # a row more than splits
        tree = Condensed(names, np.array([least[v] for v in names.tolist()]), [tuple(r) for r in splits])
        shared = points.sparkSession.sparkContext.broadcast((tree.leaves, tree.home, np.array(tree.parent), np.array(tree.top)))

        @F.pandas_udf("int")
        def cluster(leaf: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series(places(*shared.value, leaf.to_numpy(), t.to_numpy()) if len(leaf) else [], dtype="int32")

        placed = keep.keep(rows.select("x", "g", "t", cluster("leaf", "t").alias("cluster")))
    return DensityModel(placed, tree)


def density_points(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    """Weighted distinct points of an array, for tests and small data."""
    return spark.createDataFrame([([float(v) for v in r],) for r in rows], "x array<double>").groupBy("x").agg(F.count(F.lit(1)).alias("g"))
