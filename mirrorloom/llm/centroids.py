"""Centroid clustering by delta Lloyd rounds on whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, ship
from .vectors import matrix, squared_distances, whole_vectors

CLUSTERS, ROUNDS, DIM, SCALE = 40, 5, 64, 256


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x and its squared distance; of equal ones the smaller number.

    ``owner`` and ``distance`` hold for the centroids before (-1: none yet), ``changed`` marks those that differ since.
    A vector whose owner stayed meets only the changed ones, as the others were no nearer before; one whose
    owner moved meets them all.
    """
    owner, distance = owner.astype(np.int32), distance.astype(np.int64)
    everywhere = (owner < 0) | changed[owner]
    at = np.flatnonzero(everywhere)
    if len(at):
        d = squared_distances(x[at], centroids)
        owner[at] = d.argmin(axis=1)
        distance[at] = d.min(axis=1)
    at, moved = np.flatnonzero(~everywhere), np.flatnonzero(changed)
    if len(at) and len(moved):
        d = squared_distances(x[at], centroids[moved])
        new, least = moved[d.argmin(axis=1)], d.min(axis=1)
        better = (least < distance[at]) | ((least == distance[at]) & (new < owner[at]))
        owner[at[better]], distance[at[better]] = new[better], least[better]
    return owner, distance


def _assign(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The written table of the next assignments: id, v, owner, distance, and the owner before as ``was``."""
    schema = T.StructType([f for f in state.schema.fields if f.name in ("id", "v")] + [T.StructField("owner", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("was", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                was = batch.column("owner").to_numpy()
                owner, distance = nearest(matrix(batch.column("v")), was, batch.column("distance").to_numpy(), centroids, changed)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(owner), pa.array(distance), pa.array(was)], ["id", "v", "owner", "distance", "was"])

    return materialize(state.select("id", "v", "owner", "distance").mapInArrow(assign, schema), "assigned")


def _transfers(state: DataFrame, dim: int) -> DataFrame:
    """What each centroid gained (+) and lost (-) in the last round: c, n, s0, s1, ...; one row a vector and side that changed hands."""
    sides = F.array(F.struct(F.col("owner").alias("c"), F.lit(1).alias("n")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("n")))
    moved = state.filter("owner <> was").select("v", F.explode(sides).alias("side")).filter("side.c >= 0")
    return moved.select("side.c", F.col("side.n").cast("long").alias("n"), *[(F.col("side.n") * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dim)])


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "2:") -> DataFrame:
    """One row per kept vector: id_col, cluster, distance, cluster_inertia, inertia, centroid (array of long).

    Kept are vectors of exactly ``dim`` components, none null or non-finite; others (null, too short, empty) have no row.
    Components are floor(scale * x), all arithmetic is exact. The first centroids are the k vectors with the smallest
    SHA-256 of ``seed`` and the identifier (a null one counts as empty text; repeated identifiers go in
    order of their vectors); of fewer than k vectors all are. Each round assigns all vectors to the nearest (equal distances: the smaller
    number) and moves each centroid that has any to the floor of their mean; at last they are assigned once more.
    Repeated rows count and are returned each; an empty table gives no rows; other columns of the table aren't read, so none can clash.

    Delta rounds: assignments and the sums by centroid are written to the shared folder. A round compares only what
    can have changed (see ``nearest``), and adds up signed transfers of the vectors that changed hands, by
    centroid in each task first. The driver holds the k centroids and nothing that grows with the vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = whole_vectors(vectors, {"id": id_col}, vec_col, scale, dim)
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(len(start), dim)
    changed = np.ones(len(start), bool)
    state = kept.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long")})
    named = [f"s{i}" for i in range(dim)]
    old, sums = kept, None
    for r in range(rounds + 1):
        state = _assign(state, centroids, changed)
        forget(old)
        old = state
        if r == rounds:
            break
        gained = _transfers(state, dim)
        added = (gained if sums is None else gained.unionByName(sums)).groupBy("c").agg(*[F.sum(c).alias(c) for c in ("n", *named)])
        added = materialize(added, "sums")
        if sums is not None:
            forget(sums)
        sums = added
        moved = centroids.copy()
        for row in sums.filter("n > 0").collect():  # k rows at most
            moved[row.c] = [row[c] // row.n for c in named]
        changed, centroids = (moved != centroids).any(axis=1), moved
        if not changed.any():  # no later round would change anything
            break
    if sums is not None:
        forget(sums)
    totals = state.groupBy("owner").agg(F.sum("distance").alias("d")).collect()  # k rows at most
    rows = [(t.owner, t.d, sum(x.d for x in totals), centroids[t.owner].tolist()) for t in totals]
    about = spark.createDataFrame(rows, "owner int, cluster_inertia long, inertia long, centroid array<long>")
    joined = state.join(F.broadcast(about), "owner")
    return joined.select(F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid")

