"""Nearest vectors by coarse cells: every vector belongs to the cell of its nearest centroid, and a query looks into the cells that can matter.

Centroids are fitted on a bounded sample (``sample`` rows in the order of a hash of the id, a documented bound); every
row is indexed. A cell knows its radius, the largest angle between its centroid and a member. Angles obey the triangle
inequality, so no member of a cell is nearer to a query than the query's angle to the centroid less the radius. Exact
search asks the nearest cells first and then those whose bound is below the k-th
angle found; approximate search stops after the nearest ``probes`` cells.

Vectors travel once, when the index is written; a search joins (cell, query) with the index by cell. A large cell is dealt over
parts, each of which returns its k best, so what is shuffled is k rows a query, cell and part.
Tasks compare and send in pieces of bounded size, so their memory grows neither with the vectors nor with the cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.retrieval import HELD_SCORES, QUERY_BLOCK, ROW_BLOCK, first_of_each, ranked, reaching
from docspark.plans.staging import stage

#: Vectors of a cell that one task compares with the cell's queries.
PART_ROWS = 1 << 14
#: Routes (a query's vector and a cell) that a task sends at a time.
ROUTE_ROWS = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def fit_centroids(vectors: DataFrame, cells: int, id_: str, vector: str, sample: int = 20_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means over at most ``sample`` vectors."""
    rows = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(F.lit(seed), id_).alias("__h")).orderBy("__h").limit(sample).collect()
    if not rows:
        return np.zeros((0, 1))
    x = _unit(np.array([r[vector] for r in rows], np.float64))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[at : at + ROW_BLOCK] @ c.T).argmax(1) for at in range(0, len(x), ROW_BLOCK)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.linalg.norm(sums, axis=1) == 0
        c = np.where(empty[:, None], c, _unit(sums))
    return c


@dataclass
class VectorIndex:
    """centroids; radii and number of parts by cell; rows: id, vector (unit), cell, part, staged."""

    centroids: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    rows: DataFrame
    id_: str
    vector: str


def build_index(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = 20_000) -> VectorIndex:
    """Index of every vector that is not null; by default as many cells as the square root of their number, 4096 at most."""
    held = vectors.where(F.col(vector).isNotNull()).select(id_, vector)
    spark, n = vectors.sparkSession, held.count()
    c = fit_centroids(held, cells or max(1, min(4096, int(n**0.5))), id_, vector, sample)
    shared, kind = spark.sparkContext.broadcast(c), dict(vectors.dtypes)[id_]

    def assigned(batches):
        for batch in batches:
            for at in range(0, len(batch), ROW_BLOCK):
                own = batch.iloc[at : at + ROW_BLOCK]
                x = _unit(np.stack(own[vector].to_numpy()).astype(np.float64))
                angle = _angles(x, shared.value)
                cell = angle.argmin(1)
                yield pd.DataFrame({id_: own[id_], vector: list(x), "cell": cell, "angle": angle[np.arange(len(x)), cell]})

    rows = held.mapInPandas(assigned, f"{id_} {kind}, {vector} array<double>, cell int, angle double")
    rows = stage(rows, "vector-cells")
    counts = {r["cell"]: (r["far"], r["n"]) for r in rows.groupBy("cell").agg(F.max("angle").alias("far"), F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    radii = np.array([counts[k][0] if k in counts else -1.0 for k in range(len(c))])
    parts = np.array([-(-counts[k][1] // PART_ROWS) if k in counts else 0 for k in range(len(c))], int)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(id_), _by_cell(parts)).cast("int"))
    return VectorIndex(c, radii, parts, dealt.drop("angle"), id_, vector)


def _by_cell(numbers: np.ndarray) -> Column:
    """The number of a row's cell."""
    return F.get(F.array(*[F.lit(int(x)) for x in numbers]) if len(numbers) else F.array(F.lit(0)), F.col("cell"))


def _probe(index: VectorIndex, asked: DataFrame, k: int, query_id: str, blocks: int) -> DataFrame:
    """(query_id, id, score): the k best of each query in each part of the cells that it asks. ``asked``: query_id, __v (unit), cell.

    A task holds one part of a cell and one of ``blocks`` shares of the queries; a part is sent once for each share.
    """
    kinds = dict(asked.dtypes) | {index.id_: dict(index.rows.dtypes)[index.id_]}
    id_, vector = index.id_, index.vector

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({query_id: [], id_: [], "score": []})
        vectors, ids, out = np.stack(x[vector].to_numpy()), x[id_].to_numpy(), []
        step = max(1, HELD_SCORES // len(ids))
        for at in range(0, len(q), step):
            names = q[query_id].to_numpy()[at : at + step]
            scores = np.round(np.stack(q["__v"].to_numpy()[at : at + step]) @ vectors.T, 6)
            # Only what reaches the k-th score is put in order.
            row, place = reaching(scores, k, np.full(len(names), -np.inf))
            row, place = first_of_each(row, ids[place], scores[row, place], k, place)
            out.append(pd.DataFrame({query_id: names[row], id_: ids[place], "score": scores[row, place]}))
        return pd.concat(out)

    left = asked.withColumn("part", F.explode(F.sequence(F.lit(0), _by_cell(index.parts) - 1))).withColumn("block", F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int"))
    right = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInPandas(best, f"{query_id} {kinds[query_id]}, {index.id_} {kinds[index.id_]}, score double")


def nearest(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", probes: int = 8, exact: bool = True) -> DataFrame:
    """(query_id, id, score, rank): cosine top-k of each query, as ``retrieval.dense_topk`` gives it, or of its ``probes`` nearest cells only."""
    spark, shared = queries.sparkSession, queries.sparkSession.sparkContext.broadcast((index.centroids, index.radii))
    kind = dict(queries.dtypes)[query_id]

    def routed(near: bool):
        """Each query with the ``probes`` cells nearest to it, or with the others whose bound is within its ``__reach``."""

        def run(batches):
            centroids, radii = shared.value
            for batch in batches:
                for at in range(0, len(batch), ROW_BLOCK):
                    own = batch.iloc[at : at + ROW_BLOCK]
                    x = _unit(np.stack(own[vector].to_numpy()).astype(np.float64))
                    angle = _angles(x, centroids)
                    angle[:, radii < 0] = np.inf
                    wanted = np.isfinite(angle)
                    first = np.zeros_like(wanted)
                    np.put_along_axis(first, np.argsort(angle, axis=1)[:, :probes], True, 1)
                    if near:
                        wanted &= first
                    else:
                        reach = own["__reach"].fillna(np.inf).to_numpy(np.float64)
                        wanted &= ~first & (angle - radii <= reach[:, None])
                    q, cell = np.nonzero(wanted)
                    for part in range(0, len(q), ROUTE_ROWS):
                        of = q[part : part + ROUTE_ROWS]
                        yield pd.DataFrame({query_id: own[query_id].to_numpy()[of], "__v": list(x[of]), "cell": cell[part : part + ROUTE_ROWS]})

        return run

    wanted = queries.where(F.col(vector).isNotNull()).select(query_id, vector)
    if not len(index.centroids):
        return ranked(spark.createDataFrame([], f"{query_id} {kind}, {index.id_} {dict(index.rows.dtypes)[index.id_]}, score double"), query_id, index.id_, k)
    schema = f"{query_id} {kind}, __v array<double>, cell int"
    blocks = max(1, -(-wanted.select(query_id).distinct().count() // QUERY_BLOCK))
    first = stage(_probe(index, wanted.mapInPandas(routed(True), schema), k, query_id, blocks), "nearest-cells")
    if not exact:
        return ranked(first, query_id, index.id_, k)
    top = first.withColumn("__n", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), index.id_)))
    # Without k found so far any cell may matter. Scores are rounded, and so may tie beyond the sixth digit.
    reach = top.where(F.col("__n") == k).select(query_id, F.acos(F.greatest(F.lit(-1.0), F.col("score") - 1e-6)).alias("__reach"))
    rest = wanted.join(reach, query_id, "left").mapInPandas(routed(False), schema)
    return ranked(first.unionByName(_probe(index, rest, k, query_id, blocks)), query_id, index.id_, k)


def recall(found: DataFrame, truth: DataFrame, query_id: str, id_: str) -> float:
    """Share of the true neighbours that were found."""
    true = truth.select(query_id, id_).distinct()
    return true.join(found.select(query_id, id_).distinct(), [query_id, id_], "left_semi").count() / max(1, true.count())
