"""Density clustering over many small blocks against a walk down the dense single-linkage tree."""

import numpy as np
import pytest

from trailspark import Stream
from trailspark.errors import ParameterError
from trailspark.plans import density, learned
from trailspark.plans.shared import tables


def brute(x, size, epsilon=0.0):
    """Labels by splitting the whole set at its longest edges; -1 is noise."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, size - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, best, source, edges = np.zeros(n, bool), m[0].copy(), np.zeros(n, int), []
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[j], int(source[j]), j))
        inside[j] = True
        nearer = m[j] < best
        best, source = np.where(nearer, m[j], best), np.where(nearer, j, source)
    clusters = []

    def rate(w):
        return 1 / max(w, density.LEAST_DISTANCE)

    def parts(points, edges, below):
        name = {p: p for p in points}

        def root(a):
            while name[a] != a:
                a = name[a]
            return a

        for w, a, b in edges:
            if w < below:
                name[root(a)] = root(b)
        out = {}
        for p in points:
            out.setdefault(root(p), []).append(p)
        return list(out.values())

    todo = [(list(range(n)), edges, None, 0.0)]
    while todo:
        points, edges, parent, birth = todo.pop()
        own = {"birth": birth, "parent": parent, "fallen": {}, "parts": [], "size": len(points)}
        clusters.append(own)
        me = len(clusters) - 1
        if parent is not None:
            clusters[parent]["parts"].append(me)
        while True:
            w = max((e[0] for e in edges), default=0.0)
            groups = parts(points, edges, w)
            large = [g for g in groups if len(g) >= size]
            own["fallen"].update({p: rate(w) for g in groups if len(g) < size or not edges for p in g})
            inner = lambda g: [e for e in edges if e[0] < w and e[1] in set(g)]  # noqa: B023, E731
            if not edges or len(large) != 1:
                break
            points, edges = large[0], inner(large[0])
        if edges and len(large) > 1:
            own["split"] = rate(w)
            todo += [(g, inner(g), me, rate(w)) for g in large]
    selected = set()

    def walk(c):
        own = clusters[c]
        stable = sum(v - own["birth"] for v in own["fallen"].values()) + sum(clusters[k]["size"] * (own["split"] - own["birth"]) for k in own["parts"])
        below = sum(map(walk, own["parts"]))
        if own["parent"] is not None and (not own["parts"] or stable >= below):
            selected.add(c)
            return stable
        return below

    def above(c):
        while c is not None:
            yield c
            c = clusters[c]["parent"]

    walk(0)
    outer = lambda cs: {c for c in cs if not any(p in cs for p in list(above(c))[1:])}
    chosen = outer(selected)
    if epsilon:
        lifted = set()
        for c in chosen:
            if 1 / clusters[c]["birth"] < epsilon:
                while 1 / clusters[c]["birth"] <= epsilon and clusters[clusters[c]["parent"]]["parent"] is not None:
                    c = clusters[c]["parent"]
            lifted.add(c)
        chosen = outer(lifted)
    labels = np.full(n, -1)
    for c, own in enumerate(clusters):
        for p in above(c):
            if p in chosen:
                labels[list(own["fallen"])] = p
    return labels


def alike(a, b):
    """The same noise, and the same clusters by other names."""
    there, back = {}, {}
    return ((a < 0) == (b < 0)).all() and all(there.setdefault(i, j) == j and back.setdefault(j, i) == i for i, j in zip(a.tolist(), b.tolist(), strict=True))


def blobs(rng):
    return np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.3, 140), ((3, 3), 0.2, 90), ((3.6, 2.2), 0.15, 70), ((-4, 2), 1.0, 120))] + [rng.uniform(-8, 8, (80, 2))])


def solved(x, size):
    """Reaches and the tree of points in one block, without Spark."""
    n, ids, g = len(x), np.arange(len(x)), np.ones(len(x), int)
    core = density.core_of(*density.nearest(x, np.full(n, np.inf), x, g, size), size)
    _, edges = density.joined_inside({"x": x, "core": core, "id": ids}, np.full(n, np.inf))
    return core, edges, *density.reach_inside(ids, g, core, edges, {}, size)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(density, "POINTS_IN_BLOCK", 130)
    monkeypatch.setattr(density, "LEAF", 16)


def test_blocks_agree_with_brute_force(spark, small_blocks):
    x = blobs(np.random.default_rng(0))
    assert len(x) == 500
    with tables(spark) as keep:
        points = keep.keep(density.density_points(spark, x))
        assert len({r["b"] for r in density.points_with_cores(points, 8, keep)[0].select("b").distinct().collect()}) == 4
        model = density.density_model(points, 8, keep)
        for epsilon in (0.0, 0.5, 2.0):
            got = {tuple(r["x"]): r["label"] for r in model.labels(points, epsilon).collect()}
            labels, expected = np.array([got[tuple(r)] for r in x.tolist()]), brute(x, 8, epsilon)
            assert alike(labels, expected) and 1 < len(set(labels.tolist())) and (labels < 0).any()


def test_ties_over_blocks(spark, small_blocks):
    x = np.unique(np.random.default_rng(3).integers(0, 40, (420, 2)).astype(float), axis=0)
    with tables(spark) as keep:
        points = keep.keep(density.density_points(spark, x))
        got = {tuple(r["x"]): r["label"] for r in density.density_model(points, 6, keep).labels(points).collect()}
    assert alike(np.array([got[tuple(r)] for r in x.tolist()]), brute(x, 6))


@pytest.mark.parametrize("seed", range(6))
def test_tree_in_one_block(seed):
    rng = np.random.default_rng(seed)
    x = [blobs(rng), rng.normal(size=(200, 3)), np.cumsum(rng.exponential(1, 200))[:, None], np.unique(rng.integers(0, 9, (300, 3)), axis=0).astype(float)][seed % 4]
    size = 3 + seed
    core, edges, reach, _ = solved(x, size)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(core, np.sort(d, 1)[:, size - 1]) and len(edges) == len(x) - 1
    name = list(range(len(x)))

    def root(a):
        while name[a] != a:
            a = name[a]
        return a

    splits = [e for e in edges if e > max(reach[e[1]], reach[e[2]])]
    for e in edges:
        if e not in splits:
            name[root(e[1])] = root(e[2])
    leaf, t = np.array([root(j) for j in range(len(x))]), np.array([r[0] for r in reach])
    names = np.unique(leaf)
    tree = density.Condensed(names, np.array([t[leaf == v].min() for v in names]), [(w, leaf[a], leaf[b]) for w, a, b in splits])
    at = density.places(tree.leaves, tree.home, np.array(tree.parent), np.array(tree.top), leaf, t)
    n = len(tree.parent)
    labels = tree.chosen(np.bincount(at, minlength=n), np.bincount(at, 1 / t, minlength=n), 0.0)[at]
    assert alike(labels, brute(x, size))


def test_no_block_holds_all(spark):
    rng = np.random.default_rng(1)
    cuts = density.Cuts(rng.normal(size=(3000, 4)), 16)
    counts = np.bincount(cuts.of(rng.normal(size=(20_000, 4))), minlength=16)
    assert len(counts) == 16 and counts.max() < 3 * counts.mean()
    assert len(set(density.Cuts(np.ones((50, 2)), 8).of(np.ones((5, 2))))) == 1  # equal points can't be cut


def test_weights_count_as_copies(spark):
    x = [[0.0]] * 6 + [[1.0]] * 5 + [[9.0]] * 7 + [[4.0]]
    with tables(spark) as keep:
        points = keep.keep(density.density_points(spark, np.array(x)))
        got = {r["x"][0]: r["label"] for r in density.density_model(points, 5, keep).labels(points).collect()}
        assert got[4.0] == -1 and len({got[0.0], got[1.0], got[9.0]} - {-1}) == 3
        few = keep.keep(density.density_points(spark, np.array([[0.0], [1.0]])))
        assert {r["label"] for r in density.density_model(few, 5, keep).labels(few).collect()} == {-1}


def test_density_clusters_of_paths(spark):
    rows = [(u, e, 60 * k) for u in range(40) for k, e in enumerate(["a"] * (1 + u % 2) + ["b"] * (9 if u % 2 else 2))] + [(99, "a", 60 * k) for k in range(40)]
    s = Stream.from_dataframe(spark.createDataFrame(rows, "user_id int, event string, timestamp long"))
    features = [{"metric": "event_count", "metric_args": {"event": "a"}}, {"metric": "event_count", "metric_args": {"event": "b"}}]
    out = s.cluster_analysis_data(features, method="hdbscan", method_args={"min_cluster_size": [3, 5], "cluster_selection_epsilon": [0.0, 0.1]})
    assert [p["min_cluster_size"] for p in out["silhouette"]["params"]] == [3, 3, 5, 5] and out["silhouette"]["silhouette"][0] == pytest.approx(1.0)
    assert out["best_params"]["method"] == "hdbscan" and out["best_params"]["method_args"] == {"min_cluster_size": 3, "cluster_selection_epsilon": 0.0}
    saved = s.add_clusters("c", features, **out["best_params"]).df.select("user_id", "c").distinct().collect()
    by = {r["user_id"]: r["c"] for r in saved}
    assert by[99] == "noise" and {by[u] for u in range(0, 40, 2)} | {by[u] for u in range(1, 40, 2)} == {"cluster_0", "cluster_1"} and by[0] != by[1]
    sizes = {r["level"]: r["value"] for r in out["overview"].filter("metric = 'segment_size'").collect()}
    assert sizes == {"cluster_0": 20.0, "cluster_1": 20.0, "noise": 1.0}
    for bad in ({"method": "hdbscan", "method_args": {"n_clusters": 3}}, {"method": "kmeans", "method_args": {"min_cluster_size": 3}}, {"method": "hdbscan", "method_args": {"min_cluster_size": 1}}, {"method": "hdbscan", "method_args": {"cluster_selection_epsilon": -1}}):
        with pytest.raises(ParameterError):
            s.cluster_analysis_data(features, **bad)


def test_silhouette_of_many_features():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (300, 60)), rng.normal(4, 1, (300, 60))])
    labels = np.repeat([0, 1], 300)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    a = np.array([d[i, labels == labels[i]].sum() / 299 for i in range(600)])
    b = np.array([d[i, labels != labels[i]].mean() for i in range(600)])
    assert learned.silhouette(x, labels) == pytest.approx(((b - a) / np.maximum(a, b)).mean())


@pytest.mark.parametrize("seed, blocks, size", [(0, 4, 5), (1, 9, 12), (2, 30, 25), (3, 60, 7), (4, 300, 4)])
def test_reaches_over_borders(seed, blocks, size):
    """Blocks first, then trees of what they leave open, also where a cluster needs more points than a block has."""
    rng = np.random.default_rng(seed)
    x = np.unique(np.concatenate([blobs(rng), rng.integers(-9, 9, (150, 2))]), axis=0)
    core, edges, expected, _ = solved(x, size)
    block = density.Cuts(x, blocks).of(x)
    reach, node = [None] * len(x), np.arange(len(x))
    for b in np.unique(block):
        ids = np.flatnonzero(block == b)
        inner = [e for e in edges if block[e[1]] == b == block[e[2]]]
        leaving = {}
        for e in edges:
            for v in e[1:]:
                if block[e[1]] != block[e[2]] and block[v] == b:
                    leaving[v] = min(leaving.get(v, e), e)
        found, nodes = density.reach_inside(ids, np.ones(len(ids), int), core[ids], inner, leaving, size)
        for j, r, k in zip(ids, found, nodes, strict=True):
            reach[j], node[j] = r, k
    open_ = [j for j, r in enumerate(reach) if r is None]
    assert open_ and all(r is None or r == expected[j] for j, r in enumerate(reach))
    weight = {}
    for j in open_:
        weight[node[j]] = weight.get(node[j], 0) + 1
    arcs = []
    for e in sorted(edges):
        a, b = (node[v] if reach[v] is None else None for v in e[1:])
        if a is not None and b is not None and a != b:
            arcs.append((e, a, b, None))
        elif (a is None) != (b is None):
            arcs.append((e, b if a is None else a, None, reach[e[1]] or reach[e[2]]))
    rest = density.reach_among(weight, arcs, size)
    assert all(rest[node[j]] == expected[j] for j in open_)
