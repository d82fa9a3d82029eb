"""Bootstrap replicates by Poisson weights.

Drawing n rows with replacement gives each row a Poisson(1) count in the
limit. The count of a row in a replicate is a pure function of the row's key
and the replicate, so no replicate is ever materialised, rows are not
multiplied, and a task that runs again draws the same counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.operators.ordered import quantiles, spread
from alertmill.operators.stats import hedges_g
from alertmill.session import settle

_POISSON_CDF = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(14)])


def hashed_uniform(keys: np.ndarray, streams: np.ndarray | int) -> np.ndarray:
    """Uniform draws in [0, 1) from 64-bit keys and stream numbers by integer mixing."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.asarray(streams).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


def poisson_weights(keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) counts, rows x replicates, that depend on row key and replicate only."""
    u = hashed_uniform(keys[:, None], (replicates + 1 + 1_000_003 * seed)[None, :])
    return np.searchsorted(_POISSON_CDF, u, side="right").astype(float)


def replicate_moments(
    df: DataFrame, features: Sequence[str], cls: str, id_col: str, replicates: int = 200, seed: int = 42
) -> DataFrame:
    """Weighted count, mean and sample variance per (replicate, class, feature).

    One pass: each task keeps running sums for all replicates and emits them
    once; the shuffle carries replicates x classes x features rows per task.
    """
    names = list(features)
    centre = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in names]).first()
    mid = np.array([centre[f] or 0.0 for f in names])
    reps = np.arange(replicates)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[object, np.ndarray] = {}
        for pdf in batches:
            for c, part in pdf.groupby("cls"):
                x = part[names].to_numpy(dtype=float) - mid
                seen = ~np.isnan(x)
                x = np.where(seen, x, 0.0)
                w = poisson_weights(part["key"].to_numpy(), reps, seed).T
                now = np.stack([w @ seen.astype(float), w @ x, w @ (x * x)])
                acc[c] = acc[c] + now if c in acc else now
        for c, (n, s, q) in acc.items():
            b, f = np.indices(n.shape)
            yield pd.DataFrame(
                {
                    "replicate": b.ravel(),
                    "cls": c,
                    "feature": np.array(names)[f.ravel()],
                    "n": n.ravel(),
                    "s": s.ravel(),
                    "q": q.ravel(),
                }
            )

    rows = df.select(
        F.xxhash64(F.col(id_col)).alias("key"),
        F.col(cls).cast("string").alias("cls"),
        *[F.col(f).cast("double").alias(f) for f in names],
    )
    parts = rows.mapInPandas(sums, "replicate int, cls string, feature string, n double, s double, q double")
    total = parts.groupBy("replicate", "cls", "feature").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")
    )
    return total.select(
        "replicate",
        "cls",
        "feature",
        "n",
        (F.col("s") / F.col("n")).alias("mean"),
        F.when(F.col("n") > 1, (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("var"),
    )


def selection_stability(
    df: DataFrame, features: Sequence[str], id_col: str, replicates: int = 200, k: int = 8, seed: int = 42
) -> DataFrame:
    """Share of replicates in which a feature is among the ``k`` largest effects."""
    m = replicate_moments(df, features, "label", id_col, replicates, seed)
    side = {
        c: F.max(F.when(F.col("cls") == c, F.struct("n", "mean", "var"))).alias(f"c{c}") for c in ("1", "0")
    }
    wide = m.groupBy("replicate", "feature").agg(*side.values())
    g = hedges_g(*[F.col(f"{c}.{x}") for c in ("c1", "c0") for x in ("n", "mean", "var")])
    place = F.row_number().over(
        Window.partitionBy("replicate").orderBy(F.col("g").desc(), "feature")
    )
    top = wide.withColumn("g", F.coalesce(g, F.lit(0.0))).withColumn("place", place)
    return top.groupBy("feature").agg(F.avg(F.when(F.col("place") <= k, 1.0).otherwise(0.0)).alias("frequency"))


#: Rows of a task: a row costs a draw per replicate, so tasks are cut by rows, not by bytes.
PART_ROWS = 16_384
#: Draws of a step, which stays in the cache of a core.
STEP_DRAWS = 32_768

_CUTS = np.array([int(np.ceil(c * 2.0**53)) for c in _POISSON_CDF], dtype=np.uint64)


def _coarse_counts() -> np.ndarray:
    """The count by the upper 16 bits of a draw; -1 where the lower bits decide."""
    low = np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)
    least, most = (np.searchsorted(_CUTS, m, side="right") for m in (low, low + np.uint64((1 << 37) - 1)))
    return np.where(least == most, least, -1).astype(np.float32)


_COARSE = _coarse_counts()


def _places(flags: bytes) -> list[int]:
    """Where a few of many flags are set; a byte search skips the rest faster than numpy does."""
    found, at = [], flags.find(1)
    while at >= 0:
        found.append(at)
        at = flags.find(1, at + 1)
    return found


def drawn(keys: np.ndarray, replicates: np.ndarray, seed: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The counts of ``poisson_weights`` step by step: a slice of the replicates, and replicates x rows as floats.

    The last mixing leaves the upper bits as they are, and nearly always they
    alone give the count. The next step overwrites the array.
    """
    keys = keys.astype(np.uint64)
    step = max(1, STEP_DRAWS // max(len(keys), 1))
    made = np.empty((2, step, len(keys)), np.uint64)
    counts = np.empty((step, len(keys)), np.float32)
    with np.errstate(over="ignore"):
        streams = (replicates + 1 + 1_000_003 * seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(0, len(replicates), step):
            at = slice(i, min(i + step, len(replicates)))
            x, t, w = made[0, : at.stop - i], made[1, : at.stop - i], counts[: at.stop - i]
            np.add(streams[at, None], keys[None, :], out=x)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                np.right_shift(x, np.uint64(shift), out=t)
                np.bitwise_xor(x, t, out=x)
                np.multiply(x, np.uint64(factor), out=x)
            np.right_shift(x, np.uint64(48), out=t)
            np.take(_COARSE, t.view(np.int64), out=w, mode="clip")
            unsure = _places((w < 0).tobytes())
            if unsure:
                v = x.reshape(-1)[unsure]
                w.reshape(-1)[unsure] = np.searchsorted(_CUTS, (v ^ (v >> np.uint64(31))) >> np.uint64(11), side="right")
            yield at, w


def replicate_metrics(
    df: DataFrame,
    weight_key: str,
    p: str = "p",
    y: str = "y",
    replicates: int = 1000,
    seed: int = 42,
    threshold: float = 0.5,
) -> DataFrame:
    """AUC, average precision, TPR and FPR of every replicate.

    Rows that share ``weight_key`` (a block) are drawn together; use the row id
    for independent draws. Rows are cut by score into parts of even size, and a
    score with many rows over several parts. A first pass sums the weights of
    each cell: a score that parts share, or the rest of a part. The sums of
    earlier cells are then handed to each cell. That settles a cell of one
    score; for the others a second pass finishes their share of the curves.
    Scores that are not known count as one, above all others. A replicate
    without one of the classes yields NULL.
    """
    rows = settle(
        df.select(
            F.xxhash64(F.col(weight_key)).alias("key"),
            F.coalesce(F.col(p).cast("double"), F.lit(float("nan"))).alias("p"),
            F.col(y).cast("int").alias("y"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "drawn_rows",
    )
    parts = max(1, -(-rows.count() // PART_ROWS))
    rows = spread(rows, [], ["p", "_at"], parts).select("key", "p", "y", "_part")
    cells = _cells(rows)
    by_part = rows.repartition(parts, "_part")
    sums = by_part.groupBy("_part").applyInPandas(
        _cell_sums(cells, replicates, seed, threshold),
        "cell int, _part int, replicate int, w1 double, w0 double, d double, f double",
    )
    totals = settle(
        sums.groupBy("cell", "replicate").agg(F.min("_part").alias("_part"), *[F.sum(c).alias(c) for c in ("w1", "w0", "d", "f")]),
        "cell_sums",
    )
    earlier = Window.partitionBy("replicate").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "*",
        F.coalesce(F.sum("w1").over(earlier), F.lit(0.0)).alias("before1"),
        F.coalesce(F.sum("w0").over(earlier), F.lit(0.0)).alias("before0"),
    )
    mixed = offsets.filter("cell % 2 = 1").select("_part", "replicate", "before1", "before0")
    unsettled = totals.filter("cell % 2 = 1").select("_part").distinct()
    curve = (
        rows.join(F.broadcast(unsettled), "_part", "left_semi")
        .repartition(parts, "_part")
        .groupBy("_part")
        .cogroup(mixed.repartition(parts, "_part").groupBy("_part"))
        .applyInPandas(_cell_curves(cells, seed), "replicate int, wins double, ap double")
    )
    upto0, upto1 = F.col("before0") + F.col("w0"), F.col("before1") + F.col("w1")
    single = offsets.filter("cell % 2 = 0").select(
        "replicate",
        (F.col("w1") * (F.col("before0") + F.col("w0") / 2.0)).alias("wins"),
        F.when(upto0 + upto1 > 0, F.col("w0") * upto0 / (upto0 + upto1)).otherwise(0.0).alias("ap"),
    )
    sums = curve.unionByName(single).groupBy("replicate").agg(F.sum("wins").alias("wins"), F.sum("ap").alias("ap"))
    rates = totals.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("w1", "w0", "d", "f")])
    both = (F.col("w1") > 0) & (F.col("w0") > 0)
    return rates.join(sums, "replicate").select(
        "replicate",
        F.when(both, F.col("wins") / (F.col("w1") * F.col("w0"))).alias("auc"),
        F.when(both, F.col("ap") / F.col("w0")).alias("auprc"),
        F.when(both, F.col("d") / F.col("w0")).alias("tpr"),
        F.when(both, F.col("f") / F.col("w1")).alias("fpr"),
    )


def _same(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return (a == b) | ((a != a) & (b != b))


def _cells(rows: DataFrame) -> dict[int, tuple[int | None, int | None, int]]:
    """Of each part the cells of its least score, its greatest, and those between; None where a score has no cell of its own.

    Cells are numbered upwards by score, those of one score evenly.
    """
    place = lambda v: (v != v, 0.0 if v != v else v)
    spans = {
        r["_part"]: (place(r["lo"]), place(r["hi"]))
        for r in rows.groupBy("_part").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    }
    held = Counter(v for span in spans.values() for v in set(span))
    alone = {v for lo, hi in spans.values() for v in (lo, hi) if held[v] > 1 or lo == hi}
    numbers = {v: 2 * i for i, v in enumerate(sorted({v for span in spans.values() for v in span}))}
    return {
        part: (numbers[lo] if lo in alone else None, numbers[hi] if hi in alone else None, numbers[lo] + 1)
        for part, (lo, hi) in spans.items()
    }


def _part_rows(pdf: pd.DataFrame, cells: dict[int, tuple[int | None, int | None, int]]) -> tuple[np.ndarray, ...]:
    """Scores, labels and keys of a part by score, and the cell of each row."""
    score, y, keys = (pdf.sort_values("p")[c].to_numpy() for c in ("p", "y", "key"))
    low, high, rest = cells[int(pdf["_part"].iloc[0])]
    own = np.full(len(score), rest)
    for cell, edge in ((low, score[0]), (high, score[-1])):
        if cell is not None:
            own[_same(score, edge)] = cell
    return score, y, keys, own


def _cell_sums(cells: dict, replicates: int, seed: int, threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    reps = np.arange(replicates)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score, y, keys, own = _part_rows(pdf, cells)
        low, found = score < threshold, np.unique(own)
        kinds = [y == 1, y == 0, (y == 0) & low, (y == 1) & low]
        masks = np.stack([(own == c) & k for c in found for k in kinds]).astype(np.float32)
        sums = np.zeros((replicates, len(masks)))
        for i in range(0, len(keys), PART_ROWS):
            for at, w in drawn(keys[i : i + PART_ROWS], reps, seed):
                sums[at] += w @ masks[:, i : i + PART_ROWS].T
        out = [
            pd.DataFrame(
                {
                    "cell": c,
                    "_part": pdf["_part"].iloc[0],
                    "replicate": reps,
                    **{name: sums[:, 4 * j + k] for k, name in enumerate(("w1", "w0", "d", "f"))},
                }
            )
            for j, c in enumerate(found)
        ]
        return pd.concat(out)

    return run


_LOWER = (1 << 32) - 1


def _cell_curves(cells: dict, seed: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(offsets):
            return pd.DataFrame({"replicate": [], "wins": [], "ap": []})
        *columns, own = _part_rows(pdf, cells)
        score, y, keys = (c[own % 2 == 1] for c in columns)
        offsets = offsets.sort_values("replicate")
        reps, b1, b0 = (offsets[c].to_numpy() for c in ("replicate", "before1", "before0"))
        starts = np.flatnonzero(np.r_[True, ~_same(score[1:], score[:-1])])
        ends, attacked = np.r_[starts[1:], len(score)], np.logical_or.reduceat(y == 0, starts)
        starts, ends = starts[attacked], ends[attacked]
        # both classes in one running sum, attacks in the lower half; only scores with attacks add to the curves
        unit = np.where(y == 1, 1 << 32, np.where(y == 0, 1, 0))
        wins, ap = np.empty(len(reps)), np.empty(len(reps))
        for at, w in drawn(keys, reps, seed):
            c = np.zeros((len(w), len(score) + 1), np.int64)
            np.cumsum(w.astype(np.int64) * unit, axis=1, out=c[:, 1:])
            full = c.take(ends, axis=1)
            here = full - c.take(starts, axis=1)
            neg, normal, upto1 = (here & _LOWER).astype(float), c[:, -1:] >> 32, full >> 32
            cum0 = (full & _LOWER) + b0[at, None]
            higher = (normal - upto1) + (here >> 32) / 2.0
            wins[at] = b0[at] * normal[:, 0] + (neg * higher).sum(axis=1)
            ap[at] = (neg * cum0 / np.maximum(cum0 + upto1 + b1[at, None], 1.0)).sum(axis=1)
        return pd.DataFrame({"replicate": reps, "wins": wins, "ap": ap})

    return run


def _chunks(replicates: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    step = max(1, int(4_000_000 // max(rows, 1)))
    for i in range(0, len(replicates), step):
        yield replicates[i : i + step]


METRICS = ["auc", "auprc", "tpr", "fpr"]


def bootstrap_interval(replicated: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Percentile interval, mean and deviation of every metric over the valid replicates."""
    long = settle(replicated, "replicates").unpivot(["replicate"], METRICS, "metric", "value").filter("value IS NOT NULL")
    spans = quantiles(long, ["metric"], "value", {"ci_lo": alpha / 2, "ci_hi": 1 - alpha / 2})
    stats = long.groupBy("metric").agg(
        F.count("value").alias("n_valid"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_boot")
    )
    return stats.join(spans, "metric")


def user_metric_replicates(
    df: DataFrame,
    metric_fn: Callable[[np.ndarray, np.ndarray, np.ndarray], float],
    id_col: str,
    p: str = "p",
    y: str = "y",
    replicates: int = 200,
    seed: int = 42,
) -> DataFrame:
    """Replicates of a caller's ``metric_fn(scores, labels, weights)``.

    The function sees the distinct (score, label) pairs of the table, exact as
    they are, with the summed weights of a replicate. Pairs are merged inside
    the tasks and again by a grouped sum before a replicate is evaluated.
    """
    reps = np.arange(replicates)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = pdf.groupby(["p", "y"], sort=False, dropna=False).ngroup().to_numpy()
            first = np.unique(cell, return_index=True)[1]
            scores, labels, keys = (pdf[c].to_numpy() for c in ("p", "y", "key"))
            for chunk in _chunks(reps, len(pdf)):
                w = poisson_weights(keys, chunk, seed)
                for j, b in enumerate(chunk):
                    total = np.bincount(cell, weights=w[:, j], minlength=len(first))
                    live = total > 0
                    yield pd.DataFrame({"replicate": b, "p": scores[first][live], "y": labels[first][live], "w": total[live]})

    label = F.when(F.col(y) == 1, 1).otherwise(0)
    rows = df.select(F.xxhash64(F.col(id_col)).alias("key"), F.col(p).cast("double").alias("p"), label.alias("y"))
    cells = rows.mapInPandas(sums, "replicate int, p double, y int, w double")
    cells = cells.groupBy("replicate", "p", "y").agg(F.sum("w").alias("w"))

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        value = metric_fn(pdf["p"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({"replicate": [pdf["replicate"].iloc[0]], "value": [float(value)]})

    return cells.groupBy("replicate").applyInPandas(evaluate, "replicate int, value double")
