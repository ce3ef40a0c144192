"""An inverted-file index of vectors: cells around coarse centres, and exact top-k that reads only the cells that can matter.

Vectors are kept at unit length in a table with a folder for each cell, so a search reads no other cell's files. For a query q,
a cell's centre c and a vector v of the cell, angle(q, v) is at least angle(q, c) less the largest angle of the cell, so a cell
whose bound stays below a query's k-th best cosine holds none of its results. A first pass reads each query's nearest cell,
which gives that cosine; a second one reads the other cells that are left, for the queries that they are left for. Products of
vectors and queries are matrix products in the tasks; no pair leaves a task but the k best of each query.

Where vectors have no structure (random directions in many dimensions) no exact bound can leave a cell out; the search then reads
all of them and is still right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_path, written

#: Cells at most, vectors a cell should have, rounds of centring; bounds of what is broadcast (cells x dimensions).
CELLS, PER_CELL, ROUNDS = 4096, 1000, 2
#: Parts that one cell's vectors are written in, so that a cell with most of them isn't one task; buckets in which tasks' results meet first.
PARTS, BUCKETS = 16, 64
SLACK = 1e-9


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(column: pa.Array) -> np.ndarray:
    rows = rows_of(column)
    size = np.linalg.norm(rows, axis=1)
    return rows / np.where(size > 0, size, 1)[:, None]


def matrix(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that have a direction."""
    v = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def nearest(df: DataFrame, centres: np.ndarray, digits: int | None = None) -> DataFrame:
    """(id, cell, score) of a table (id, v): the number and dot product of the nearest of a bounded set of unit centres, the first of those equal to so many digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = rows_of(batch["v"]) @ centres.T
                best = (score if digits is None else np.round(score, digits)).argmax(1)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(best.astype(np.int32)), pa.array(score[np.arange(len(best)), best])], names=["id", "cell", "score"])

    return df.mapInArrow(run, "id long, cell int, score double")


@dataclass
class Index:
    """cells: a table (id, v, cell), foldered by cell; centres and radius (largest angle) of the cells by number."""

    cells: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def centred(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres moved to the mean direction of the vectors nearest to them; sums are partial in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centres)
        for batch in batches:
            if batch.num_rows:
                v = unit_rows(batch["v"])
                np.add.at(total, (v @ centres.T).argmax(1), v)
        used = np.flatnonzero(np.abs(total).sum(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, centres.shape[1])), pa.array(np.tile(np.arange(centres.shape[1]), len(used))), pa.array(total[used].ravel())], names=["cell", "i", "s"])

    moved = centres.copy()
    for r in rows.mapInArrow(run, "cell long, i long, s double").groupBy("cell", "i").agg(F.sum("s").alias("s")).collect():
        moved[r["cell"], r["i"]] = r["s"]
    size = np.linalg.norm(moved, axis=1)
    return moved / np.where(size > 0, size, 1)[:, None]


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> Index:
    """The index of all vectors of one length; null, zero and broken ones have no direction and are left out.

    The first centres are the vectors with the smallest hashes of their ids, moved ROUNDS times.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vector_col)
    n = rows.count()
    wanted = max(1, min(CELLS, n, cells or -(-n // PER_CELL)))
    first = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()]
    centres = np.array(first, float) if first else np.zeros((1, 1))
    size = np.linalg.norm(centres, axis=1)
    centres = centres / np.where(size > 0, size, 1)[:, None]
    for _ in range(ROUNDS if n else 0):
        centres = centred(rows, centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = unit_rows(batch["v"])
                score = v @ centres.T
                best = score.argmax(1)
                yield pa.RecordBatch.from_arrays([batch["id"], matrix(v), pa.array(best.astype(np.int32)), pa.array(score[np.arange(len(best)), best])], names=["id", "v", "cell", "near"])

    path = shared_path(spark, "vector-cells")
    table = rows.mapInArrow(placed, "id long, v array<double>, cell int, near double")
    table.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(PARTS))).write.partitionBy("cell").parquet(path)
    stored = spark.read.schema("id long, v array<double>, near double, cell int").parquet(path)
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in stored.groupBy("cell").agg(F.min("near").alias("near"), F.count("*").alias("n")).collect():
        radius[r["cell"]], sizes[r["cell"]] = np.arccos(np.clip(r["near"], -1, 1)), r["n"]
    return Index(stored, centres, radius, sizes)


def best_in(cells: DataFrame, queries: np.ndarray, of_cell: dict[int, list[int]], k: int, floor: float, digits: int) -> DataFrame:
    """(query, id, score, bucket): each task's k best of the queries that want a cell, over the given cells alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v, cell = batch["id"].to_numpy(), unit_rows(batch["v"]), batch["cell"].to_numpy()
            for c in np.unique(cell).tolist():
                asked, mine = np.array(of_cell[c]), cell == c
                score = np.round(np.clip(v[mine] @ queries[asked].T, 0, 1), digits)
                for column, q in enumerate(asked.tolist()):
                    old, own = found.get(q, (np.zeros(0, np.int64), np.zeros(0))), score[:, column]
                    over = own > floor
                    i, s = np.concatenate([old[0], ids[mine][over]]), np.concatenate([old[1], own[over]])
                    top = np.lexsort((i, -s))[:k]
                    found[q] = i[top], s[top]
        if found:
            sizes = [len(i) for i, _ in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(found)), sizes)), pa.array(np.concatenate([i for i, _ in found.values()])), pa.array(np.concatenate([s for _, s in found.values()]))], names=["query", "id", "score"])

    wanted = cells.where(F.col("cell").isin(list(of_cell))).select("id", "v", "cell")
    return wanted.mapInArrow(run, "query long, id long, score double").withColumn("bucket", F.spark_partition_id() % BUCKETS)


def merged(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query of tasks' results, in two steps."""
    order = [F.desc("score"), F.asc("id")]
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query", "bucket").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "id", "score", "rank")


def search(index: Index, queries: DataFrame, k: int, floor: float = 0.0, digits: int = 6, block: int = 1000) -> tuple[DataFrame, list[dict]]:
    """(query_id, id, score, rank), exact: the k best cosines over the floor, rounded, the smallest id among equals; and what was read.

    queries: a stated set (query_id, query), in blocks of this many, which are the rows the driver holds at once. The report has,
    for each block, its queries, the cells of the index, cells read, and vectors met (a vector counts for each query that it met).
    """
    spark, reports, out = queries.sparkSession, [], None
    asked = written(clean(queries, "query_id", "query").withColumnRenamed("id", "query_id"), "vector-queries")
    passes = max(1, -(-asked.count() // block))
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).orderBy("query_id").collect()
        if not part:
            continue
        q = np.array([r["v"] for r in part], float)
        q /= np.linalg.norm(q, axis=1)[:, None]
        away = np.arccos(np.clip(q @ index.centres.T, -1, 1))
        reach = np.cos(np.clip(away - index.radius, 0, np.pi)) + SLACK
        reach[:, index.sizes == 0] = -2
        first = np.where(index.sizes > 0, away, 9).argmin(1)
        of_cell: dict[int, list[int]] = {}
        for i, c in enumerate(first.tolist()):
            of_cell.setdefault(c, []).append(i)
        near = written(merged(best_in(index.cells, q, of_cell, k, floor, digits), k).withColumn("bucket", F.lit(-1)).select("query", "id", "score", "bucket"), "nearest-cells")
        least = np.full(len(q), floor)
        for r in near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect():
            least[r["query"]] = r["s"]
        more = reach >= least[:, None] - 10.0**-digits
        more[np.arange(len(q)), first] = False
        rest = {int(c): np.flatnonzero(more[:, c]).tolist() for c in np.flatnonzero(more.any(0))}
        rows = near.unionByName(best_in(index.cells, q, rest, k, floor, digits)) if rest else near
        ids = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(part)], "query long, query_id long")
        found = merged(rows, k).join(F.broadcast(ids), "query").select("query_id", "id", "score", "rank")
        out = found if out is None else out.unionByName(found)
        met = int(index.sizes[first].sum() + (more * index.sizes).sum())
        reports.append({"queries": len(part), "cells": int((index.sizes > 0).sum()), "cells_read": len(set(of_cell) | set(rest)), "vectors_met": met, "all_pairs": int(len(part) * index.sizes.sum())})
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, score double, rank int")
    return out, reports
