"""Exact nearest neighbours by pivot cells, and the local outlier factor on top.

Reference rows are grouped by their nearest pivot. A query first searches its
own cell; the distance to its k-th hit there rules out every cell whose nearest
possible point is farther. Cells are cut into chunks of bounded size on both
sides, so a crowded cell is spread over many tasks. The other cells are packed
into blocks of bounded size; a query goes once to each block with a cell in its
reach. A task only emits the k best hits of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.session import settle

CHUNK = 4096
MAX_PIVOTS = 1024
#: Rows of a side that a task of the second search gets at most, and parts that a side is cut into at least.
BLOCK, LEAST_BLOCKS = 16_384, 8
#: Distances that are held at once.
TILE = 1 << 19


def _pivots(refs: DataFrame, wanted: int) -> np.ndarray:
    """A bounded number of reference rows, taken in hash order."""
    rows = refs.orderBy(F.xxhash64("ref_id"), "ref_id").limit(min(wanted, MAX_PIVOTS)).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(sq, 0.0))


def _assign(df: DataFrame, pivots: np.ndarray, id_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _distances(np.stack(pdf["v"].to_numpy()), pivots)
            at = d.argmin(axis=1)
            yield pdf.assign(cell=at, away=d[np.arange(len(at)), at])

    return df.select(id_col, "v").mapInPandas(run, f"{id_col} long, v array<double>, cell int, away double")


def _closest(
    queries: np.ndarray, refs: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray, same: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``queries``, ids of ``refs`` and distances: at least the k best pairs of each query no farther than ``limit``.

    ``same``: ids of the queries, where a reference of the same id does not count.
    """
    sizes, found = (refs * refs).sum(1), []
    width = max(1, min(len(refs), TILE // 64))
    step = max(1, TILE // width)
    for i in range(0, len(queries), step):
        part = queries[i : i + step]
        norms, twice = (part * part).sum(1), 2.0 * part
        # a little wider, since different squares may have the same root
        most = np.square(limit[i : i + step]) * (1.0 + 1e-14)
        for j in range(0, len(refs), width):
            sq = norms[:, None] + sizes[None, j : j + width]
            sq -= twice @ refs[j : j + width].T
            if same is not None:
                sq[same[i : i + step, None] == ids[None, j : j + width]] = np.inf
            near = sq <= most[:, None]
            if np.count_nonzero(near) > 4 * k * len(part) and sq.shape[1] > k:
                tight = np.maximum(np.partition(sq, k - 1, axis=1)[:, k - 1], 0.0) * (1.0 + 1e-14)
                most = np.fmin(most, tight)
                near = sq <= most[:, None]
            at = np.flatnonzero(near)
            r, c = np.divmod(at, sq.shape[1])
            found.append((r + i, ids[j + c], np.sqrt(np.maximum(sq.reshape(-1)[at], 0.0))))
    rows, hits, dist = (np.concatenate(x) for x in zip(*found, strict=True))
    real = np.isfinite(dist)
    return rows[real], hits[real], dist[real]


def _first(rows: np.ndarray, hits: np.ndarray, dist: np.ndarray, k: int, ids: np.ndarray) -> pd.DataFrame:
    """The k best pairs of each row, ties by id."""
    order = np.lexsort((hits, dist, rows))
    rows, hits, dist = rows[order], hits[order], dist[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    top = place < k
    return pd.DataFrame({"query_id": ids[rows[top]], "ref_id": hits[top], "dist": dist[top]})


def _chunked(df: DataFrame, sizes: DataFrame, id_col: str, name: str) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.col(f"{name}_n") / CHUNK))
    return df.join(sizes, "cell").withColumn(f"{name}_chunk", F.pmod(F.xxhash64(id_col), n).cast("int"))


def _search(queries: DataFrame, refs: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """k best hits of every (query, cell) pair; ``queries`` carry the cell to search."""
    q_sizes = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("q_n"))
    r_sizes = refs.groupBy("cell").agg(F.count(F.lit(1)).alias("r_n"))
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / CHUNK)).cast("int")
    q = _chunked(queries, q_sizes, "query_id", "q").join(r_sizes, "cell")
    q = q.withColumn("r_chunk", F.explode(F.sequence(F.lit(0), pieces("r_n") - 1)))
    r = _chunked(refs, r_sizes, "ref_id", "r").join(q_sizes, "cell")
    r = r.withColumn("q_chunk", F.explode(F.sequence(F.lit(0), pieces("q_n") - 1)))
    keys = ["cell", "q_chunk", "r_chunk"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "ref_id": [], "dist": []})
        qi = a["query_id"].to_numpy()
        everywhere = np.full(len(qi), np.inf)
        found = _closest(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), b["ref_id"].to_numpy(), k, everywhere, qi if skip_self else None)
        return _first(*found, k, qi)

    return (
        q.select(*keys, "query_id", "v")
        .groupBy(*keys)
        .cogroup(r.select(*keys, "ref_id", "v").groupBy(*keys))
        .applyInPandas(run, "query_id long, ref_id long, dist double")
    )


def _packed(sizes: dict[int, int], cells: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of each cell, the place of its first chunk among all, and the block of each chunk.

    A cell of more than ``most`` rows is cut into chunks; chunks fill a block up to ``most`` rows.
    """
    chunks = np.array([max(1, -(-sizes.get(c, 0) // most)) for c in range(cells)])
    first = np.r_[0, np.cumsum(chunks)[:-1]]
    blocks, block, held = [], 0, 0
    for c in range(cells):
        for _ in range(chunks[c]):
            share = -(-sizes.get(c, 0) // int(chunks[c]))
            if held and held + share > most:
                block, held = block + 1, 0
            held += share
            blocks.append(block)
    return chunks, first, np.array(blocks)


def _elsewhere(asked: DataFrame, placed: DataFrame, centres: np.ndarray, radius: np.ndarray, sizes: dict[int, int], k: int) -> DataFrame:
    """k best hits of every query in each block of cells that it reaches, its own cell left out.

    ``asked``: query_id, v, cell, bound (null where the own cell has fewer than k).
    """
    rows = sum(sizes.values())
    chunks, first, blocks = _packed(sizes, len(centres), max(1, min(BLOCK, -(-rows // LEAST_BLOCKS))))
    asks = asked.count()
    pieces = max(1, -(-asks // max(1, min(BLOCK, -(-asks // LEAST_BLOCKS)))))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _distances(np.stack(pdf["v"].to_numpy()), centres)
            limit = pdf["bound"].fillna(np.inf).to_numpy()[:, None]
            reach = (d - radius[None, :] <= limit + 1e-9) & np.isfinite(radius)[None, :]
            reach[np.arange(len(pdf)), pdf["cell"].to_numpy()] = False
            # cells of the chunks, block by block
            cell = np.repeat(np.arange(len(chunks)), chunks)
            goes = np.logical_or.reduceat(reach[:, cell], np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]), axis=1)
            i, b = np.nonzero(goes)
            if not len(i):
                continue
            lists = pd.Series([np.flatnonzero(r) for r in reach])
            yield pd.DataFrame(
                {
                    "query_id": pdf["query_id"].to_numpy()[i],
                    "v": pdf["v"].to_numpy()[i],
                    "bound": limit[i, 0],
                    "cells": lists.to_numpy()[i],
                    "block": b,
                }
            )

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            yield pdf.assign(block=blocks[first[cell] + pdf.pop("hashed").to_numpy() % chunks[cell]])

    piece = F.pmod(F.xxhash64("query_id", F.lit("piece")), F.lit(pieces)).cast("int")
    q = asked.select("query_id", "v", "cell", "bound").mapInPandas(
        others, "query_id long, v array<double>, bound double, cells array<int>, block int"
    )
    r = placed.select("ref_id", "v", "cell", F.pmod(F.xxhash64("ref_id"), F.lit(1 << 40)).alias("hashed")).mapInPandas(
        dealt, "ref_id long, v array<double>, cell int, block int"
    )
    r = r.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "ref_id": [], "dist": []})
        qi, qv, limit = a["query_id"].to_numpy(), np.stack(a["v"].to_numpy()), a["bound"].to_numpy()
        ri, rv, cell = b["ref_id"].to_numpy(), np.stack(b["v"].to_numpy()), b["cell"].to_numpy()
        reach = np.zeros((len(qi), len(centres)), bool)
        reach[np.repeat(np.arange(len(qi)), a["cells"].str.len()), np.concatenate(a["cells"].to_numpy())] = True
        found = []
        for c in np.unique(cell):
            mine, there = np.flatnonzero(reach[:, c]), np.flatnonzero(cell == c)
            if len(mine):
                rows, hits, dist = _closest(qv[mine], rv[there], ri[there], k, limit[mine])
                found.append((mine[rows], hits, dist))
        if not found:
            return pd.DataFrame({"query_id": [], "ref_id": [], "dist": []})
        return _first(*(np.concatenate(x) for x in zip(*found, strict=True)), k, qi)

    tasks = pieces * (int(blocks[-1]) + 1)
    keys = ["block", "piece"]
    return (
        q.withColumn("piece", piece)
        .repartition(tasks, *keys)
        .groupBy(*keys)
        .cogroup(r.repartition(tasks, *keys).groupBy(*keys))
        .applyInPandas(run, "query_id long, ref_id long, dist double")
    )


def _best(hits: DataFrame, k: int) -> DataFrame:
    top = F.slice(F.array_sort(F.collect_list(F.struct("dist", "ref_id"))), 1, k)
    return hits.groupBy("query_id").agg(top.alias("near"))


def nearest(queries: DataFrame, refs: DataFrame, k: int, pivots: int = 64, skip_self: bool = False) -> DataFrame:
    """The k nearest references of every query: ``near`` array of (dist, ref_id), ties by id.

    ``queries``: query_id long, v array<double>; ``refs``: ref_id long, v.
    """
    centres = _pivots(refs, pivots)
    placed = settle(_assign(refs, centres, "ref_id"), "cells")
    radius, sizes = np.full(len(centres), -np.inf), {}
    for r in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], sizes[r["cell"]] = r["r"], r["n"]
    asked = settle(_assign(queries, centres, "query_id"), "asked")
    own = settle(_search(asked.select("query_id", "v", "cell"), placed, k, skip_self), "own_hits")
    bound = own.groupBy("query_id").agg(F.sort_array(F.collect_list("dist")).alias("ds"))
    bound = bound.select("query_id", F.when(F.size("ds") >= k, F.element_at("ds", k)).alias("bound"))

    more = _elsewhere(asked.join(bound, "query_id", "left"), placed, centres, radius, sizes, k)
    return _best(own.unionByName(more), k)


def reference_densities(refs: DataFrame, k: int = 20, pivots: int = 64) -> tuple[DataFrame, DataFrame]:
    """The neighbours of the references among themselves and their densities, to be used for several sets of queries."""
    among = settle(nearest(refs.withColumnRenamed("ref_id", "query_id"), refs, k, pivots, skip_self=True), "among")
    return among, settle(_density(among, among), "density")


def local_outlier_factor(
    queries: DataFrame, refs: DataFrame, k: int = 20, pivots: int = 64, known: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Novelty score of each query: minus the local outlier factor, lower is more anomalous.

    ``known``: the ``reference_densities`` of the same references.
    """
    among, density = known or reference_densities(refs, k, pivots)
    near = settle(nearest(queries, refs, k, pivots), "near")
    lrd = density.select(F.col("query_id").alias("ref_id"), F.col("lrd").alias("ref_lrd"))
    mine = _density(near, among)
    hits = near.select("query_id", F.inline("near")).join(lrd, "ref_id")
    around = hits.groupBy("query_id").agg(F.avg("ref_lrd").alias("around"))
    return around.join(mine, "query_id").select("query_id", (-F.col("around") / F.col("lrd")).alias("score"))


def _density(near: DataFrame, among: DataFrame) -> DataFrame:
    """Inverse mean reachability distance of each query."""
    kdist = among.select(F.col("query_id").alias("ref_id"), F.element_at("near", -1)["dist"].alias("kdist"))
    hits = near.select("query_id", F.inline("near")).join(kdist, "ref_id")
    return hits.groupBy("query_id").agg((1.0 / (F.avg(F.greatest("dist", "kdist")) + 1e-10)).alias("lrd"))
