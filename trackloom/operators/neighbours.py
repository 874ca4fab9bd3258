"""Nearest vectors by an inverted-file index: cells round centres, probed by distance, compared block against block.

The index is a table of blocks (cell, part, ids, labels, matrix) and a small one of cells (cell, centre, radius), both
written in the shared folder; every vector is in it. Searching asks the ``probe`` nearest cells first. For exact results the
distance of the k-th neighbour found then rules cells out: a vector of a cell is no nearer than the distance to the
centre less the cell's radius; all cells that this leaves are asked. In that step blocks of queries meet the index by broadcast,
slice by slice, and pass on what is no farther than the bound, so the cells that a query asks add nothing to what is shuffled.
A crowded cell is many blocks, never one task's group.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.features import unit
from trackloom.sources.shared import materialize

#: Vectors that centres are fitted on, cells at most, vectors of a block and queries of one.
FIT_ROWS, MOST_CELLS, BLOCK, QUERIES = 20_000, 4096, 1024, 256
#: Blocks of the index that are broadcast at once.
SLICE = 128


@dataclass
class Index:
    """``blocks``: (cell, part, ids, labels, matrix); ``centres``: a row a cell; ``radius``: the largest distance in each cell."""

    blocks: DataFrame
    centres: np.ndarray
    radius: np.ndarray


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 1))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)))


def _centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centres of a bounded sample: k-means from its first distinct rows."""
    centres = np.unique(sample, axis=0, return_index=True)[1]
    centres = sample[np.sort(centres)[:k]]
    for _ in range(rounds):
        cell = _distances(sample, centres).argmin(1)
        n = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest_cell(centres: np.ndarray):
    @F.pandas_udf("cell int, far double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x = _rows(v)
        if not len(x):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "far": pd.Series(dtype="float64")})
        d = _distances(x, centres)
        return pd.DataFrame({"cell": d.argmin(1).astype("int32"), "far": d.min(1)})

    return nearest


def _whole(vectors: DataFrame) -> DataFrame:
    """Without null and empty embeddings, unknown numbers in them, and those of length zero."""
    e = F.col("embedding")
    return vectors.where(e.isNotNull() & F.exists(e, lambda x: x != 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)))


def build_index(labelled: DataFrame, cells: int | None = None) -> Index:
    """The index of ``labelled`` (vec_id, label, embedding). Centres come from k-means on at most FIT_ROWS vectors with the
    smallest id hashes; every vector is indexed. Null or empty embeddings aren't; a vector of length zero isn't either."""
    rows = _whole(labelled).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), unit(F.col("embedding")).alias("v"))
    rows = materialize(rows, "units")
    n = rows.count()
    if not n:
        return Index(rows.sparkSession.createDataFrame([], "cell int, part long, ids array<long>, labels array<long>, matrix binary"), np.zeros((0, 1)), np.zeros(0))
    k = min(cells or max(1, round(math.sqrt(n))), MOST_CELLS, n)
    centres = _centres(np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect()]), k)
    placed = materialize(rows.withColumn("at", _nearest_cell(centres)("v")).select("id", "label", "v", "at.cell", "at.far"), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    radius = np.full(len(centres), -np.inf)
    for r in sizes.collect():  # a row a cell
        radius[r.cell] = r.radius
    parts = sizes.select("cell", F.ceil(F.col("n") / BLOCK).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "label", "v")).alias("of"))
    return Index(materialize(blocks.select("cell", "part", F.col("of.id").alias("ids"), F.col("of.label").alias("labels"), _packed(F.col("of.v")).alias("matrix")), "blocks"), centres, radius)


def _packed(lists: Column) -> Column:
    """Lists of vectors as matrices, row after row."""

    @F.pandas_udf("binary")
    def pack(vs: pd.Series) -> pd.Series:
        return vs.map(lambda x: np.stack([np.asarray(v, float) for v in x]).tobytes())

    return pack(lists)


def _asked_cells(index: Index, probe: int):
    """The ``probe`` nearest cells of each vector."""
    centres, radius = index.centres, index.radius

    @F.pandas_udf("array<int>")
    def asked(v: pd.Series) -> pd.Series:
        x = _rows(v)
        if not len(x):
            return pd.Series([], dtype=object)
        d = _distances(x, centres)
        d[:, ~np.isfinite(radius)] = np.inf
        first = np.argsort(d, axis=1, kind="stable")[:, :probe]
        return pd.Series([row[np.isfinite(d[i, row])].tolist() for i, row in enumerate(first)])

    return asked


def _compared(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(id, near, label, sim): the ``k`` nearest of each asked block to each query (id, v, cells), itself left out."""
    asked = queries.withColumn("cell", F.explode("cells"))
    counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    groups = asked.join(F.broadcast(counts), "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("q_part")).agg(F.collect_list(F.struct("id", "v")).alias("of"))
    packed = groups.select("cell", F.col("of.id").alias("q_ids"), _packed(F.col("of.v")).alias("q_matrix"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_matrix, ids, labels, matrix in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_matrix", "ids", "labels", "matrix"))):
                q, x = np.array(q_ids), np.array(ids)
                sim = np.round(np.frombuffer(q_matrix).reshape(len(q), -1) @ np.frombuffer(matrix).reshape(len(x), -1).T, 9)
                sim[q[:, None] == x] = -np.inf
                by_id = np.argsort(x, kind="stable")  # ties go to the smaller id
                best = by_id[np.argsort(-sim[:, by_id], axis=1, kind="stable")[:, :k]]
                found = np.take_along_axis(sim, best, axis=1)
                row, col = np.nonzero(np.isfinite(found))
                at = best[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(x[at]), pa.array([labels[i] for i in at], pa.int64()), pa.array(found[row, col])], ["id", "near", "label", "sim"])

    met = packed.join(index.blocks, "cell").select("q_ids", "q_matrix", "ids", "labels", "matrix")
    return met.mapInArrow(run, "id long, near long, label long, sim double")


def _within(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(id, near, label, sim): of each block of the index the ``k`` nearest to each query (id, v, least) that are no farther than
    the known cosine ``least`` (null: all), itself left out. Cells that the bound rules out aren't compared."""
    centres, radius = index.centres, index.radius

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, least, q_matrix, cell, ids, labels, matrix in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "least", "q_matrix", "cell", "ids", "labels", "matrix"))):
                q, x, known = np.array(q_ids), np.array(ids), np.array([-2.0 if v is None else v for v in least])
                u = np.frombuffer(q_matrix).reshape(len(q), -1)
                far = _distances(u, centres[cell : cell + 1])[:, 0] - radius[cell]
                asks = np.flatnonzero(far <= np.sqrt(np.maximum(0, 2 - 2 * known)) + 1e-6)
                sim = u[asks] @ np.frombuffer(matrix).reshape(len(x), -1).T
                row, at = np.nonzero(sim >= known[asks][:, None] - 2e-9)
                found, row = np.round(sim[row, at], 9), asks[row]
                kept = (found >= known[row]) & (q[row] != x[at])
                row, at, found = row[kept], at[kept], found[kept]
                order = np.lexsort((x[at], -found, row))  # ties go to the smaller id
                row, at, found = row[order], at[order], found[order]
                few = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, at, found = row[few], at[few], found[few]
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(x[at]), pa.array([labels[i] for i in at], pa.int64()), pa.array(found)], ["id", "near", "label", "sim"])

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // BLOCK)))).alias("q_part")).agg(F.collect_list(F.struct("id", "v", "least")).alias("of"))
    packed = materialize(groups.select(F.col("of.id").alias("q_ids"), F.col("of.least").alias("least"), _packed(F.col("of.v")).alias("q_matrix")).repartition(parts), "asking")
    slices = max(1, -(-index.blocks.count() // SLICE))
    met = [packed.crossJoin(F.broadcast(index.blocks.where(F.pmod(F.xxhash64("cell", "part"), F.lit(slices)) == n))) for n in range(slices)]
    return reduce(DataFrame.unionByName, met).mapInArrow(run, "id long, near long, label long, sim double")


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "near"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def nearest(vectors: DataFrame, index: Index, k: int, probe: int = 4, exact: bool = True) -> DataFrame:
    """(id, place, near, label, sim): the ``k`` nearest indexed vectors by cosine of each of ``vectors`` (vec_id, embedding), itself
    left out; cosines to nine digits, ties to the smaller id. Without ``exact`` only the ``probe`` nearest cells are asked."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = _whole(vectors).select(F.col("vec_id").cast("long").alias("id"), unit(F.col("embedding")).alias("v"))
    queries = materialize(queries.repartition(parts, "id"), "queries")
    if not len(index.centres):
        return spark.createDataFrame([], "id long, near long, label long, sim double, place int")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # a row holds two blocks
    first = _compared(queries.withColumn("cells", _asked_cells(index, probe)("v")), index, k)
    first = _first(first, k)
    if not exact:
        return materialize(first, "first-neighbours")
    least = first.where(F.col("place") == k).select("id", F.col("sim").alias("least"))
    asking = materialize(queries.join(least, "id", "left"), "bounded")
    return _first(_within(asking, index, k), k)


def vote(neighbours: DataFrame) -> DataFrame:
    """(vec_id, label): the label with the largest summed cosine among the neighbours; ties to the larger label."""
    votes = neighbours.groupBy("id", "label").agg(F.round(F.sum("sim"), 6).alias("votes"))
    return votes.groupBy(F.col("id").alias("vec_id")).agg(F.max_by("label", F.struct("votes", "label")).alias("label"))


def knn_vote(vectors: DataFrame, labelled: DataFrame, k: int = 5, exact: bool = True) -> DataFrame:
    """The label that the ``k`` nearest labelled vectors vote for, for every vector that has neighbours."""
    return vote(nearest(vectors, build_index(labelled), k, exact=exact))
