"""Isolation forest grown level by level over distributed rows.

A tree's sample is a fixed share of all rows and may be far too large for one
task, so no tree is ever given its rows. Each level is one pass: tasks walk
their rows down the trees grown so far and report count and range per open
leaf and feature; the few open leaves are split on the driver. Rows take part
in a tree by a hash of their key. A tree's height is the logarithm of its
sample, so its nodes are bounded by the sample, and the sample by ``MOST_ROWS``
unless ``sample_size`` says otherwise. Leaves cut off at that height enter the
path length with the usual correction for their size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from alertmill.operators.ordered import feature_quantiles, quantiles
from alertmill.operators.resample import hashed_uniform
from alertmill.session import settle

#: Rows of a tree at most, so that nodes do not grow with the table.
MOST_ROWS = 1 << 14


def height(psi: int) -> int:
    """The height at which a tree over ``psi`` rows stops."""
    return max(1, math.ceil(math.log2(psi)))


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


@dataclass
class Tree:
    """One tree as parallel node lists; ``feature`` -1 marks a leaf."""

    seed: int
    rate: float
    allowed: tuple[int, ...]
    skip_fold: int = -1
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    size: list[int] = field(default_factory=lambda: [0])
    open: set[int] = field(default_factory=lambda: {0})

    def walk(self, x: np.ndarray) -> np.ndarray:
        """Node of every row; the right child follows the left one."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(max(self.depth)):
            f = feature[at]
            moving = np.flatnonzero(f >= 0)
            if not len(moving):
                break
            node = at[moving]
            at[moving] = left[node] + (x[moving, f[moving]] > cut[node])
        return at

    def split(self, node: int, f: int, cut: float) -> None:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = f, cut, first
        for child in (first, first + 1):
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(-1)
            self.depth.append(self.depth[node] + 1)
            self.size.append(0)
            self.open.add(child)


def _leaf_stats(trees: list[Tree], d: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [f"x{i}" for i in range(d)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = [np.zeros(len(t.feature), dtype=np.int64) for t in trees]
        lo = [np.full((len(t.feature), d), np.inf) for t in trees]
        hi = [np.full((len(t.feature), d), -np.inf) for t in trees]
        is_open = [np.isin(np.arange(len(t.feature)), list(t.open)) for t in trees]
        for pdf in batches:
            x, key, fold = pdf[names].to_numpy(dtype=float), pdf["key"].to_numpy(), pdf["fold"].to_numpy()
            for i, t in enumerate(trees):
                if not t.open:
                    continue
                taken = (hashed_uniform(key, t.seed) < t.rate) & (fold != t.skip_fold)
                part = x[taken]
                at = t.walk(part)
                live = np.flatnonzero(is_open[i][at])
                order = live[np.argsort(at[live], kind="stable")]
                if not len(order):
                    continue
                part, at = part[order], at[order]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                nodes = at[starts]
                n[i][nodes] += np.diff(np.r_[starts, len(at)])
                lo[i][nodes] = np.minimum(lo[i][nodes], np.minimum.reduceat(part, starts, axis=0))
                hi[i][nodes] = np.maximum(hi[i][nodes], np.maximum.reduceat(part, starts, axis=0))
        for i, t in enumerate(trees):
            nodes = np.array(sorted(t.open), dtype=np.int64)
            nodes = nodes[n[i][nodes] > 0] if len(nodes) else nodes
            if len(nodes):
                out = {"tree": i, "node": nodes, "n": n[i][nodes]}
                out |= {f"lo{j}": lo[i][nodes, j] for j in range(d)} | {f"hi{j}": hi[i][nodes, j] for j in range(d)}
                yield pd.DataFrame(out)

    return run


def grow(rows: DataFrame, trees: list[Tree], d: int, max_depth: int) -> list[Tree]:
    """Split every open leaf until it is pure, constant or at the height limit.

    ``rows``: key (64-bit), fold, x0..x{d-1}; read once per level.
    """
    cols = [f"lo{j} double" for j in range(d)] + [f"hi{j} double" for j in range(d)]
    schema = "tree int, node long, n long, " + ", ".join(cols)
    rngs = [np.random.default_rng([t.seed, 7]) for t in trees]
    for level in range(max_depth + 1):
        if not any(t.open for t in trees):
            break
        stats = (
            rows.mapInPandas(_leaf_stats(trees, d), schema)
            .groupBy("tree", "node")
            .agg(
                F.sum("n").alias("n"),
                *[F.min(f"lo{j}").alias(f"lo{j}") for j in range(d)],
                *[F.max(f"hi{j}").alias(f"hi{j}") for j in range(d)],
            )
            .toArrow()
            .to_pandas()
            .sort_values(["tree", "node"])
        )
        lo = stats[[f"lo{j}" for j in range(d)]].to_numpy()
        hi = stats[[f"hi{j}" for j in range(d)]].to_numpy()
        for t in trees:
            t.open = set()
        for r, (tree, node, n) in enumerate(zip(stats["tree"], stats["node"], stats["n"], strict=True)):
            t = trees[tree]
            t.size[node] = int(n)
            usable = [f for f in t.allowed if hi[r, f] > lo[r, f]]
            if level < max_depth and n > 1 and usable:
                f = usable[int(rngs[tree].integers(len(usable)))]
                t.split(int(node), f, float(rngs[tree].uniform(lo[r, f], hi[r, f])))
    return trees


@dataclass
class IsolationForest:
    """A fitted forest; scores are negative, lower means more anomalous."""

    features: list[str]
    trees: list[Tree]
    sample_size: float

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        features: Sequence[str],
        id_col: str,
        n_trees: int = 100,
        sample_fraction: float = 0.7,
        sample_size: int | None = None,
        feature_fraction: float = 0.6,
        max_depth: int | None = None,
        seed: int = 42,
    ) -> IsolationForest:
        rows = settle(numbered(df, features, id_col), "forest")
        n = rows.count()
        psi = max(2, min(sample_size, n) if sample_size else min(int(sample_fraction * n), MOST_ROWS))
        trees = plan_trees(len(features), n_trees, psi / max(n, 1), feature_fraction, seed)
        limit = max_depth or height(psi)
        return cls(list(features), grow(rows, trees, len(features), limit), psi)

    def score_array(self, x: np.ndarray, n_trees: int | None = None) -> np.ndarray:
        trees = self.trees[:n_trees]
        total = np.zeros(len(x))
        for t in trees:
            path = np.array(t.depth) + expected_path(np.array(t.size, dtype=float))
            total += path[t.walk(x)]
        return -np.power(2.0, -total / max(len(trees), 1) / float(expected_path(np.array([self.sample_size]))[0] or 1.0))

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Add the score; the node tables travel as one broadcast of bounded size."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            return pd.Series(model.value.score_array(np.column_stack([c.to_numpy(dtype=float) for c in cols])))

        return df.withColumn(out, score(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features]))


def numbered(df: DataFrame, features: Sequence[str], id_col: str, fold: str | None = None) -> DataFrame:
    return df.select(
        F.xxhash64(F.col(id_col)).alias("key"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)],
    )


def plan_trees(
    d: int, n_trees: int, rate: float, feature_fraction: float, seed: int, skip_fold: int = -1
) -> list[Tree]:
    rng = np.random.default_rng([seed, skip_fold + 1])
    width = max(1, int(feature_fraction * d))
    return [
        Tree(
            seed=int(rng.integers(1, 2**31)),
            rate=rate,
            allowed=tuple(int(f) for f in sorted(rng.choice(d, width, replace=False))),
            skip_fold=skip_fold,
        )
        for _ in range(n_trees)
    ]


# The tuning grid.
TREES_GRID = (100, 150, 200, 300, 500)
FEATURE_GRID = (0.6, 0.8, 1.0)
SAMPLE_GRID = (0.70, 0.85, 1.00)


#: Rows that the trees of a tuning run draw from; the scores of a setting are taken over all rows.
TUNING_ROWS = 1 << 12
#: Bytes of node tables that one scoring pass broadcasts at most, unless a single forest is larger.
PASS_BYTES = 1 << 26
_NODE_BYTES = 28
_UNIT = ["feature_fraction", "sample_fraction", "fold"]


def tune(
    df: DataFrame,
    features: Sequence[str],
    id_col: str,
    fold: str = "fold",
    trees_grid: Sequence[int] = TREES_GRID,
    feature_grid: Sequence[float] = FEATURE_GRID,
    sample_grid: Sequence[float] = SAMPLE_GRID,
    k_sigma: float = 2.0,
    seed: int = 42,
    most_rows: int = TUNING_ROWS,
) -> DataFrame:
    """Choose the structure on normal rows alone.

    For each setting the held-out score of every fold gives mean - 2 sd; the
    objective is the mean over folds less their deviation. Smaller forests are
    prefixes of larger ones, so trees are grown once per (feature, sample, fold).

    Trees draw from the ``most_rows`` rows of smallest digest, which every task
    gets; each task grows its share of the trees of all settings at once and
    returns them as rows. All rows are then scored by the forests that have not
    seen their fold, in passes whose node tables fit ``PASS_BYTES``; a task
    returns sums per setting only.
    """
    spark = df.sparkSession
    names = [f"x{i}" for i in range(len(features))]
    rows = settle(numbered(df, features, id_col, fold), "tuning")
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    pool = rows.orderBy(F.xxhash64("key", F.lit(seed)), *names).limit(most_rows).toArrow().to_pandas()
    plan = [
        (ff, sf, f, i, t.seed, list(t.allowed))
        for ff in feature_grid
        for sf in sample_grid
        for f in folds
        for i, t in enumerate(plan_trees(len(features), max(trees_grid), sf, ff, seed, skip_fold=f))
    ]
    unit = "feature_fraction double, sample_fraction double, fold int"
    asked = spark.createDataFrame(plan, f"{unit}, tree int, seed long, allowed array<int>")
    tasks = max(spark.sparkContext.defaultParallelism, len(plan) // 512)
    grown = settle(
        asked.repartition(tasks, *_UNIT, "tree").mapInPandas(
            _grow_in_task(spark.sparkContext.broadcast(pool), names),
            f"{unit}, tree int, psi long, feature array<int>, cut array<double>, left array<int>, path array<double>",
        ),
        "trees",
    )
    sizes = grown.groupBy(*_UNIT).agg(F.sum(F.size("feature")).alias("nodes")).orderBy(*_UNIT).collect()
    parts = [
        rows.join(F.broadcast(units.select("fold").distinct()), "fold", "left_semi").mapInPandas(
            _held_out(forests, list(trees_grid), names),
            f"{unit}, n_trees int, n long, s double, q double",
        )
        for units, forests in _passes(spark, grown, sizes)
    ]
    if not parts:
        return spark.createDataFrame([], _TUNED)
    sums = settle(functools.reduce(DataFrame.unionByName, parts), "held_out")
    mean, square = F.sum("s") / F.sum("n"), F.sum("q") / F.sum("n")
    deviation = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    lcb = sums.groupBy(*_UNIT, "n_trees").agg((mean - k_sigma * deviation).alias("lcb"))
    grid = lcb.groupBy("n_trees", "feature_fraction", "sample_fraction").agg(
        F.avg("lcb").alias("mean"), F.stddev_pop("lcb").alias("std")
    )
    return settle(
        grid.select(
            "n_trees",
            "feature_fraction",
            "sample_fraction",
            F.round("mean", 5).alias("mean_lcb"),
            F.round("std", 5).alias("std_lcb"),
            F.round(F.col("mean") - F.col("std"), 5).alias("objective"),
        ),
        "tuned",
    )


_TUNED = "n_trees int, feature_fraction double, sample_fraction double, mean_lcb double, std_lcb double, objective double"


def grow_whole(x: np.ndarray, allowed: Sequence[int], limit: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree over rows held in memory, all nodes of a level at once.

    Node lists: feature (-1 in leaves), cut, left child (the right one follows)
    and path, the expected path length of a row that ends there.
    """
    allowed = np.asarray(allowed)
    feature, cut, left, path = [np.empty(0, t) for t in (np.int32, float, np.int32, float)]
    parts, at, width = x[:, allowed], np.zeros(len(x), dtype=np.int64), 1
    for depth in range(limit + 1):
        order = np.argsort(at, kind="stable")
        parts, at = parts[order], at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        n = np.diff(np.r_[starts, len(at)])
        lo, hi = np.minimum.reduceat(parts, starts), np.maximum.reduceat(parts, starts)
        usable = hi > lo
        parted = usable.any(axis=1) & (n > 1) & (depth < limit)
        j = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
        node = np.arange(width)
        u = rng.random(width)
        low, high = lo[node, j], hi[node, j]
        where = np.minimum(low + u * (high - low), np.nextafter(high, -np.inf))
        first = len(feature) + width + 2 * (np.cumsum(parted) - parted)
        feature = np.r_[feature, np.where(parted, allowed[j], -1)].astype(np.int32)
        cut = np.r_[cut, np.where(parted, where, 0.0)]
        left = np.r_[left, np.where(parted, first, -1)].astype(np.int32)
        path = np.r_[path, depth + expected_path(n)]
        if not parted.any():
            break
        live = parted[at]
        parts, at = parts[live], at[live]
        right = parts[np.arange(len(at)), j[at]] > where[at]
        width = 2 * int(parted.sum())
        at = 2 * (np.cumsum(parted) - parted)[at] + right
    return {"feature": feature, "cut": cut, "left": left, "path": path}


def _grow_in_task(pool: Broadcast, names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, fold, key = pool.value[names].to_numpy(dtype=float), pool.value["fold"].to_numpy(), pool.value["key"].to_numpy()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                seen = np.flatnonzero(fold != r.fold)
                seen = seen if len(seen) else np.arange(len(x))
                psi = max(1, int(r.sample_fraction * len(seen)))
                taken = seen[np.argsort(hashed_uniform(key[seen], r.seed), kind="stable")[:psi]]
                tree = grow_whole(x[taken], r.allowed, height(max(psi, 2)), np.random.default_rng([r.seed, 7]))
                out.append((r.feature_fraction, r.sample_fraction, r.fold, r.tree, max(psi, 2), *tree.values()))
            if out:
                yield pd.DataFrame(out, columns=[*_UNIT, "tree", "psi", "feature", "cut", "left", "path"])

    return run


def _passes(spark: SparkSession, grown: DataFrame, sizes: list[Row]) -> Iterator[tuple[DataFrame, Broadcast]]:
    """Forests by fold, as many to a pass as fit ``PASS_BYTES``: their units and the broadcast forests."""
    share = np.cumsum([r["nodes"] * _NODE_BYTES for r in sizes]) // PASS_BYTES
    for p in np.unique(share):
        picked = [tuple(r[c] for c in _UNIT) for r, s in zip(sizes, share, strict=True) if s == p]
        units = spark.createDataFrame(picked, "feature_fraction double, sample_fraction double, fold int")
        trees = grown.join(F.broadcast(units), _UNIT).orderBy(*_UNIT, "tree").toArrow().to_pandas()
        forests: dict[int, list] = {}
        for (ff, sf, f), rows in trees.groupby(_UNIT):
            nodes = [tuple(np.asarray(v) for v in t) for t in zip(*[rows[c] for c in ("feature", "cut", "left", "path")], strict=True)]
            forests.setdefault(int(f), []).append((ff, sf, int(rows["psi"].iloc[0]), nodes))
        yield units, spark.sparkContext.broadcast(forests)


def path_lengths(x: np.ndarray, nodes: tuple[np.ndarray, ...]) -> np.ndarray:
    """Expected path length of every row in one tree of ``grow_whole``."""
    feature, cut, left, path = nodes
    at = np.zeros(len(x), dtype=np.int64)
    moving = np.arange(len(x))
    while len(moving := moving[feature[at[moving]] >= 0]):
        node = at[moving]
        at[moving] = left[node] + (x[moving, feature[node]] > cut[node])
    return path[at]


def _held_out(forests: Broadcast, sizes: list[int], names: list[str]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x = part[names].to_numpy(dtype=float)
                for ff, sf, psi, trees in forests.value.get(int(fold), []):
                    total, norm = np.zeros(len(x)), float(expected_path(np.array([psi]))[0])
                    for i, nodes in enumerate(trees, 1):
                        total += path_lengths(x, nodes)
                        if i in sizes:
                            score = -np.power(2.0, -total / i / norm)
                            now = np.array([len(x), score.sum(), (score * score).sum()])
                            acc[ff, sf, fold, i] = acc.get((ff, sf, fold, i), 0.0) + now
        if acc:
            yield pd.DataFrame(
                [(*unit, int(v[0]), v[1], v[2]) for unit, v in acc.items()], columns=[*_UNIT, "n_trees", "n", "s", "q"]
            )

    return run


def best_setting(grid: DataFrame, flat: float = 0.005) -> DataFrame:
    """The largest objective; on a flat top the least spread among equal objectives first."""
    return grid.orderBy(F.col("objective").desc(), F.col("std_lcb").asc(), "n_trees", "feature_fraction", "sample_fraction").limit(1)


def empirical_threshold(calibration: DataFrame, score: str = "score", target: float = 0.02) -> float:
    """The score below which ``target`` of the calibration rows fall."""
    return quantiles(calibration, [], score, {"t": target}).first()["t"]


def flag_rates(df: DataFrame, keys: Sequence[str], threshold: float, score: str = "score") -> DataFrame:
    """Share of rows under the threshold per partition of the data."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(score) < threshold, 1.0).otherwise(0.0)).alias("rate")
    )


def diagnostics(df: DataFrame, score: str = "score", cls: str = "attack_type", k_sigma: float = 2.0) -> DataFrame:
    """Rates at mean - 2 sd and at the 2nd percentile of normals, and distance of class means."""
    normal = df.filter(F.col(cls) == "normal")
    m = normal.agg(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sd")).first()
    lcb = m["mu"] - k_sigma * m["sd"]
    p2 = empirical_threshold(normal, score)
    return df.groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(score) < lcb, 1.0).otherwise(0.0)).alias("rate_lcb"),
        F.avg(F.when(F.col(score) < p2, 1.0).otherwise(0.0)).alias("rate_p2"),
        (F.lit(m["mu"]) - F.avg(score)).alias("separation"),
    )


def pseudo_normals(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), contamination: float = 0.28, euclidean: bool = False
) -> DataFrame:
    """Add ``outlyingness`` and ``pseudo_normal`` without labels.

    Distance to the median: mean of |x - median| / MAD, or Euclidean in the
    packet variant. Rows up to the (1 - contamination) percentile count as
    normal.
    """
    ks = list(keys) or ["_one"]
    rows = df if keys else df.withColumn("_one", F.lit(0))
    med = _wide(feature_quantiles(rows, features, {"q": 0.5}, ks), ks, features, "_med_")
    rows = rows.join(med, ks)
    if euclidean:
        total = sum((F.pow(F.col(f) - F.col(f"_med_{f}"), F.lit(2.0)) for f in features), F.lit(0.0))
        rows = rows.withColumn("outlyingness", F.sqrt(total))
    else:
        away = rows.select(*ks, *[F.abs(F.col(f) - F.col(f"_med_{f}")).alias(f) for f in features])
        mad = _wide(feature_quantiles(away, features, {"q": 0.5}, ks), ks, features, "_mad_")
        rows = rows.join(mad, ks)
        parts = (F.abs(F.col(f) - F.col(f"_med_{f}")) / (F.col(f"_mad_{f}") + 1e-9) for f in features)
        rows = rows.withColumn("outlyingness", sum(parts, F.lit(0.0)) / len(features))
    rows = rows.drop(*[f"_{p}_{f}" for p in ("med", "mad") for f in features])
    cut = quantiles(rows, ks, "outlyingness", {"_cut": 1 - contamination})
    out = rows.join(cut, ks).withColumn("pseudo_normal", F.col("outlyingness") <= F.col("_cut"))
    return out.drop("_cut", "_one")


def _wide(long: DataFrame, keys: Sequence[str], features: Sequence[str], prefix: str) -> DataFrame:
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("q"))).alias(f"{prefix}{f}") for f in features]
    )


def target_forest(
    df: DataFrame,
    features: Sequence[str],
    id_col: str,
    contamination: float = 0.28,
    euclidean: bool = False,
    seed: int = 42,
) -> IsolationForest:
    """Forest of one foreign dataset, fitted to its pseudo-normal rows."""
    kept = pseudo_normals(df, features, (), contamination, euclidean).filter("pseudo_normal")
    if euclidean:
        return IsolationForest.fit(kept, features, id_col, 200, sample_size=256, feature_fraction=1.0, seed=seed)
    return IsolationForest.fit(kept, features, id_col, 150, sample_size=64, feature_fraction=0.8, seed=seed)
