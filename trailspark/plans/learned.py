"""Distributions of metrics and clusters of paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..schema import MISSING
from .density import NOISE, Rows, Space, density_model, distances
from .quantiles import quantiles
from .shared import Tables, tables
from .tools import complement_distance

#: Points of which a silhouette is computed; it compares all pairs of them.
SILHOUETTE_POINTS = 2000


def parse_range(value) -> list[int]:
    """Numbers of clusters: 3, '3', '3-8', '[3,5]', '3,5' or a list."""
    if isinstance(value, int) and not isinstance(value, bool):
        return [value]
    if isinstance(value, (list, tuple)):
        return [int(v) for v in value]
    text = str(value).strip().strip("[]")
    if "-" in text:
        a, b = (int(x) for x in text.split("-"))
        return list(range(a, b + 1))
    return [int(x) for x in text.split(",")]


def scaled(values: DataFrame, features: list[str], scaler: str | None) -> DataFrame:
    """Features with missing values as 0, scaled by statistics of all paths (one row, broadcast)."""
    rows = values.withColumns({f"__f{k}": F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for k, f in enumerate(features)})
    if scaler is None:
        return rows
    if scaler not in ("minmax", "std"):
        raise ParameterError(f"scaler is minmax, std or None, got {scaler!r}")
    low, span = (F.min, lambda c: F.max(c) - F.min(c)) if scaler == "minmax" else (F.avg, F.stddev_pop)
    stats = rows.agg(*(x for k in range(len(features)) for x in (low(f"__f{k}").alias(f"__a{k}"), span(f"__f{k}").alias(f"__b{k}"))))
    rows = rows.join(F.broadcast(stats))
    out = rows.withColumns({f"__f{k}": F.coalesce(F.try_divide(F.col(f"__f{k}") - F.col(f"__a{k}"), F.col(f"__b{k}")), F.lit(0.0)) for k in range(len(features))})
    return out.drop(*(f"__{x}{k}" for k in range(len(features)) for x in "ab"))


def sparse_points(entries: DataFrame, keys: list[str], scaler: str | None, keep: Tables) -> DataFrame:
    """keys, __x of the entries (keys, feature, v) of paths: number and scaled value of the features that aren't 0, in turn.

    A feature that a path has no entry of is 0 there, and none that some path lacks is negative, so 0 stays 0.
    """
    entries = keep.keep(entries)
    paths = entries.filter("feature is null").count()
    all_ = F.col("n") == paths
    stats = entries.filter("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    stats = stats.select("feature", F.when(all_, F.col("a")).otherwise(F.lit(0.0)).alias("a"), "b", F.row_number().over(Window.orderBy("feature")).cast("double").alias("i"))
    value = F.col("v") if scaler is None else F.coalesce(F.try_divide(F.col("v") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0))
    rows = entries.join(keep.keep(stats), "feature").select(*keys, "i", value.alias("v")).unionByName(entries.filter("feature is null").select(*keys, F.lit(None).cast("double").alias("i"), "v"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("i").isNotNull() & (F.col("v") != 0), F.struct("i", "v"))))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(pairs, lambda p: F.array(p["i"], p["v"]))).alias("__x"))


def silhouette(points: np.ndarray | Rows, labels: np.ndarray) -> float | None:
    """Mean Euclidean silhouette; None with fewer than two clusters."""
    names = np.unique(labels)
    if len(names) < 2 or len(names) >= len(points):
        return None
    d = distances(points, points)
    sums = np.stack([d[:, labels == n].sum(1) for n in names], 1)
    sizes = np.array([(labels == n).sum() for n in names])
    own = np.searchsorted(names, labels)
    at = np.arange(len(points))
    inside = sums[at, own] / np.maximum(1, sizes[own] - 1)
    means = sums / sizes
    means[at, own] = np.inf
    outside = means.min(1)
    s = np.where(sizes[own] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0)
    return float(s.mean())


def _weights(x: np.ndarray, h: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Nonnegative weights w of the parts ``h`` for each row of x, x near w h: multiplicative updates of each row by itself."""
    w = np.full((len(x), len(h)), max(1e-9, float(x.mean())) if x.size else 1.0)
    target, gram = x @ h.T, h @ h.T
    for _ in range(rounds):
        w *= target / np.maximum(w @ gram, 1e-12)
    return w


def nmf(rows: DataFrame, inputs: list[str], parts: int, rounds: int = 12, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """H (parts x features) of nonnegative rows near W H, and ``rows`` with W in a column ``__w``.

    The sides take turns.  Given H, each row has its weights by itself; given all weights, H needs only the
    sums W'W and W'X, one aggregate of a row.
    """
    k = len(inputs)
    scale = rows.agg(*(F.avg(c).alias(c) for c in inputs)).first()
    level = np.array([float(scale[c] or 0.0) for c in inputs])
    h = np.abs(np.random.default_rng(seed).normal(1.0, 0.5, (parts, k))) * (level + 1e-3)

    def weighted(h: np.ndarray) -> DataFrame:
        @F.pandas_udf("array<double>")
        def weights(x: pd.Series) -> pd.Series:
            return pd.Series(list(_weights(np.stack(x), h))) if len(x) else pd.Series([], dtype=object)

        return rows.withColumn("__w", weights(F.array(*inputs)))

    w = lambda i: F.get("__w", F.lit(i))
    for _ in range(rounds):
        sums = weighted(h).agg(*(F.sum(w(i) * w(j)).alias(f"g{i}_{j}") for i in range(parts) for j in range(parts)), *(F.sum(w(i) * F.col(c)).alias(f"x{i}_{j}") for i in range(parts) for j, c in enumerate(inputs))).first()
        gram = np.array([[float(sums[f"g{i}_{j}"] or 0.0) for j in range(parts)] for i in range(parts)])
        cross = np.array([[float(sums[f"x{i}_{j}"] or 0.0) for j in range(k)] for i in range(parts)])
        for _ in range(20):
            h = h * cross / np.maximum(gram @ h, 1e-12)
    return h, weighted(h)


#: Methods and their arguments with defaults.
METHODS: dict[str, dict] = {"kmeans": {"n_clusters": "3-8"}, "hdbscan": {"min_cluster_size": 5, "cluster_selection_epsilon": 0.0}}


def method_grid(method: str, method_args: dict | None) -> list[dict]:
    """The points of the grid that a method's arguments span: each may be a list, whole numbers a range too."""
    if method not in METHODS:
        raise ParameterError(f"method is one of {sorted(METHODS)}, got {method!r}")
    if unknown := sorted(set(method_args or {}) - set(METHODS[method])):
        owners = {a: m for m, args in METHODS.items() for a in args}
        raise ParameterError(f"unknown method_args of {method}: " + ", ".join(f"{a!r}" + (f" belongs to the {owners[a]!r} method" if a in owners else "") for a in unknown))
    args = METHODS[method] | {k: v for k, v in (method_args or {}).items() if v is not None}
    if method == "kmeans":
        numbers = parse_range(args["n_clusters"])
        if min(numbers) < 1:
            raise ParameterError(f"n_clusters is 1 or more, got {args['n_clusters']!r}")
        return [{"n_clusters": k} for k in numbers]
    sizes, epsilons = parse_range(args["min_cluster_size"]), args["cluster_selection_epsilon"]
    epsilons = [float(e) for e in (epsilons if isinstance(epsilons, (list, tuple)) else [epsilons])]
    if min(sizes) < 2 or min(epsilons) < 0:
        raise ParameterError("min_cluster_size is 2 or more, cluster_selection_epsilon 0 or more")
    return [{"min_cluster_size": k, "cluster_selection_epsilon": e} for k in sizes for e in epsilons]


def cluster_paths(values: DataFrame, keys: list[str], features: list[str] | None, method: str = "kmeans", method_args: dict | None = None, scaler: str | None = "minmax", nmf_components=None, seed: int = 42, select: dict | None = None) -> tuple[DataFrame, dict]:
    """keys and cluster (cluster_0, .., noise) of the best point of the grid by silhouette, or of the one that ``select`` names; and what was tried.

    The labels are a written table.  Paths of equal features are one point for the density method.  Without ``features``
    values are entries (keys, feature, v), which the density method takes if it is given no scaler but ``minmax`` and no components.
    """
    own, spark = method_grid(method, method_args), values.sparkSession
    many_parts = isinstance(nmf_components, (list, tuple))
    points = [q | ({} if p is None else {"nmf_components": p}) for p in (nmf_components if many_parts else [nmf_components]) for q in own]
    wanted = [j for j, p in enumerate(points) if select is not None and all(p.get(k) == v for k, v in select.items())]
    if select is not None and len(wanted) != 1:
        raise ParameterError(f"select names {len(wanted)} points of the grid, not one: {select!r}")
    sparse = features is None
    inputs = [f"__f{k}" for k in range(len(features or ()))]
    scores: list[float | None] = []
    made: dict = {}
    with tables(spark) as keep:
        rows = sparse_points(values, keys, scaler, keep) if sparse else keep.keep(scaled(values, features, scaler).select(*keys, *inputs))
        vectors: dict = {}
        models: dict = {}

        def labelled(p: int | None, point: dict) -> DataFrame:
            """keys, __x and __k."""
            if method == "kmeans":
                x = vectors[p][1].withColumn("__v", array_to_vector("__x"))
                return KMeans(k=point["n_clusters"], seed=seed, featuresCol="__v", predictionCol="__k").fit(x).transform(x).drop("__v")
            size = point["min_cluster_size"]
            distinct = vectors[p][2]
            if (p, size) not in models:
                models[p, size] = density_model(distinct, size, keep, sparse)
            labels = models[p, size].labels(distinct, point["cluster_selection_epsilon"]).withColumnRenamed("label", "__k").withColumnRenamed("x", "__x")
            return vectors[p][1].join(labels, "__x")

        for point in points:
            p = point.get("nmf_components")
            if p not in vectors:
                h, weighted = nmf(rows, inputs, p, seed=seed) if p else (None, rows)
                x = keep.keep(weighted if sparse else weighted.select(*keys, (F.col("__w") if p else F.array(*inputs)).alias("__x")))
                vectors[p] = (h, x, keep.keep(x.groupBy(F.col("__x").alias("x")).agg(F.count(F.lit(1)).alias("g"))) if method != "kmeans" else None)
            fitted = labelled(p, point)
            sample = fitted.filter(F.col("__k") != NOISE).orderBy(F.xxhash64(*keys, F.lit(seed))).limit(SILHOUETTE_POINTS).select("__x", "__k").collect()
            scores.append(silhouette(Space(np.zeros(0, int) if sparse else None).points(r["__x"] for r in sample), np.array([r["__k"] for r in sample])) if sample else None)
            made[len(scores) - 1] = fitted
        known = [j for j, x in enumerate(scores) if x is not None]
        best = max(known, key=lambda j: scores[j]) if known else 0
        chosen = wanted[0] if wanted else best
        point = points[chosen]
        name = F.when(F.col("__k") == NOISE, F.lit("noise")).otherwise(F.concat(F.lit("cluster_"), F.col("__k").cast("string"))).alias("cluster")
        args = {k: v for k, v in point.items() if k != "nmf_components"}
        info: dict = {
            "silhouette": {"params": points, "silhouette": scores, "best_index": best, "selected_index": chosen}, "n_clusters": point.get("n_clusters"),
            "best_params": {"method": method, "method_args": args, "scaler": scaler, **{k: v for k, v in point.items() if k == "nmf_components"}}, "nmf": None,
        }
        if (p := point.get("nmf_components")) is not None:
            means = made[chosen].groupBy(name).agg(*(F.avg(F.get("__x", F.lit(i))).alias(f"w{i}") for i in range(p))).collect()
            info["nmf"] = {"features": features, "H_matrix": vectors[p][0].tolist(), "W_cluster_means": {r["cluster"]: [r[f"w{i}"] for i in range(p)] for r in sorted(means)}}
        labels = Tables(spark).keep(made[chosen].select(*keys, name))
    return labels, info


#: Distinct values up to which a metric is discrete; ratio of positive values and skewness above which it is
#: shown in logarithms; most bins; points of a density, and the share of the range beyond either end that they cover.
DISCRETE, LOG_RATIO, LOG_SKEW, MOST_BINS, DENSITY_POINTS, DENSITY_MARGIN = 10, 1000, 3.0, 50, 1000, 0.1


def bin_edges(n: int, low: float, high: float, q25: float, q75: float) -> np.ndarray:
    """Equal bins of the smaller of the Freedman-Diaconis and the Sturges width, or ``MOST_BINS`` where these are more."""
    if low == high:
        return np.array([low - 0.5, high + 0.5])
    sturges, diaconis = (high - low) / (np.log2(n) + 1), 2 * (q75 - q25) / n ** (1 / 3)
    width = min(sturges, diaconis) if diaconis > 0 else sturges
    return np.linspace(low, high, min(MOST_BINS, int(np.ceil((high - low) / width))) + 1)


def density(counts: DataFrame, facts: dict[str, tuple[float, float, float, int]]) -> dict[str, list[list[float]]]:
    """[x, y] of the Gaussian kernel density of each level (Scott's width), from ``counts`` (level, x, n).

    ``facts``: least and greatest value, deviation and size of a level.  Each task sums up its values; a
    level's points, a fixed number, reach the driver.
    """
    grid, width = {}, {}
    for level, (low, high, sd, n) in facts.items():
        if n > 1 and sd > 0:
            pad = (high - low) * DENSITY_MARGIN
            grid[level], width[level] = np.linspace(low - pad, high + pad, DENSITY_POINTS), sd * n**-0.2
    if not grid:
        return {}

    def sums(parts):
        total = {level: np.zeros(DENSITY_POINTS) for level in grid}
        for part in parts:
            for level, rows in part[part.level.isin(list(grid))].groupby("level"):
                for at in range(0, len(rows), 1000):
                    z = (grid[level][:, None] - rows.x.to_numpy()[at : at + 1000]) / width[level]
                    total[level] += np.exp(-0.5 * z * z) @ rows.n.to_numpy()[at : at + 1000]
        for level, y in total.items():
            yield pd.DataFrame({"level": level, "i": np.arange(DENSITY_POINTS), "y": y})

    rows = counts.select("level", "x", "n").mapInPandas(sums, "level string, i int, y double").groupBy("level", "i").agg(F.sum("y").alias("y")).collect()
    out = {level: np.zeros(DENSITY_POINTS) for level in grid}
    for r in rows:
        out[r["level"]][r["i"]] = r["y"]
    return {level: [grid[level].tolist(), (y / (facts[level][3] * width[level] * np.sqrt(2 * np.pi))).tolist()] for level, y in out.items()}


def distribution(values: DataFrame, column: str, level_col: str, levels: list[str] | None = None, by_value: bool = False) -> dict:
    """Histogram, density, mean and median of a metric for each level, on shared bins; of two levels also their distance.

    Only bins, points and quantiles reach the driver.  With ``log`` all but the raw values are of their
    logarithms, zeros taken as half of the least positive value.  ``by_value``: a bin for each distinct value,
    however many there are.
    """
    v = F.col(f"`{column}`").cast("double")
    level = F.coalesce(F.col(level_col).cast("string"), F.lit(MISSING))
    rows = values.select(level.alias("level"), v.alias("v")).filter("v is not null")
    if levels is not None:
        rows = rows.filter(F.col("level").isin(*levels))
    positive = F.when(F.col("v") > 0, F.col("v"))
    stats = rows.agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), F.min(positive).alias("p"), F.count_distinct("v").alias("d"), F.skewness("v").alias("s")).first()
    if stats["a"] is None:
        return {"levels": {}, "discrete": True, "log": False, "edges": []}
    discrete = by_value or stats["d"] <= DISCRETE
    log = not discrete and stats["a"] >= 0 and (stats["b"] / (stats["p"] or 1.0) > LOG_RATIO or (stats["s"] or 0) > LOG_SKEW)
    rows = rows.withColumn("x", F.log10(F.when(F.col("v") > 0, F.col("v")).otherwise(F.lit(stats["p"] / 2))) if log else F.col("v"))
    if discrete:
        distinct = sorted(r["x"] for r in rows.select("x").distinct().collect())  # at most DISCRETE, or a bin for each is asked for
        edges = np.array([distinct[0] - 0.5, *(x + 0.5 for x in distinct)])
    else:
        f = rows.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
        edges = bin_edges(stats["n"], f["a"], f["b"], *quantiles(rows, [], F.col("x"), [0.25, 0.75]).first()["q"])
    if by_value:
        bins = rows.sparkSession.createDataFrame(list(enumerate(distinct)), "cell int, x double")
        binned, cell = rows.join(F.broadcast(bins), "x"), F.col("cell")
    else:
        inner = F.array(*(F.lit(float(e)) for e in edges[1:-1]))
        binned, cell = rows, F.size(F.filter(inner, lambda e: e <= F.col("x"))) if len(edges) > 2 else F.lit(0)
    counts = binned.groupBy("level", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    bars_of: dict[str, list[int]] = {}
    for r in counts:
        bars_of.setdefault(r["level"], [0] * (len(edges) - 1))[r["cell"]] = r["n"]
    moments = {r["level"]: r for r in rows.groupBy("level").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("a"), F.max("x").alias("b")).collect()}
    medians = {r["level"]: r["q"][0] for r in quantiles(rows, ["level"], F.col("x"), [0.5]).collect()}
    curves = {} if discrete else density(rows.groupBy("level", "x").agg(F.count(F.lit(1)).alias("n")), {k: (m["a"], m["b"], m["sd"] or 0.0, m["n"]) for k, m in moments.items()})
    out: dict = {"discrete": discrete, "log": log, "edges": edges.tolist(), "levels": {}}
    for name, m in sorted(moments.items()):
        out["levels"][name] = {"mean": m["mean"], "median": medians[name], "size": m["n"], "histogram": bars_of[name], "density": curves.get(name)}
    if levels is not None and len(out["levels"]) == 2:
        out["distance"] = complement_distance(rows.select("level", F.col("x").alias("v"))).first()["value"]
    return out
