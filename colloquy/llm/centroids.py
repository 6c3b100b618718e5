"""Clusters of vectors around centroids: plain Lloyd in whole numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table
from .vectors import digest, finite, floor_means, scaled, squared_distances

CENTROIDS = 40
ROUNDS = 5
SCALE = 256
COMPONENTS = 64
#: What is hashed with an id to choose the first centroids.
SEED = 2

OUTPUT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _blocks(frames: Iterator[pd.DataFrame], held: object) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Frames with the nearest centroid of each row, the lower of equally near ones, and its distance."""
    centers = held.value
    for frame in frames:
        if not len(frame):
            continue
        x = np.concatenate(frame["v"].to_numpy()).astype(np.int64).reshape(len(frame), -1)
        apart = squared_distances(x, centers)
        nearest = apart.argmin(axis=1)
        yield frame.assign(distance=apart[np.arange(len(x)), nearest]), x, nearest


def _sums(held: object) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One row for each centroid that a partition has vectors of: their number and their sum."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros_like(held.value), np.zeros(len(held.value), np.int64)
        for _, x, nearest in _blocks(frames, held):
            np.add.at(sums, nearest, x)
            counts += np.bincount(nearest, minlength=len(counts))
        there = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": there, "n": counts[there], "total": list(sums[there])})

    return run


def _assigned(held: object) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, _, nearest in _blocks(frames, held):
            yield pd.DataFrame({"id": frame["id"], "cluster": nearest.astype(np.int32), "distance": frame["distance"]})

    return run


def next_centroids(vectors: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The centroids after one round over `vectors` (`v`). Partitions add up their own vectors, so what
    is shuffled and what comes to the driver are at most as many rows as there are centroids, for each
    partition and in all."""
    held = vectors.sparkSession.sparkContext.broadcast(centers)
    parts = vectors.select("v").mapInPandas(_sums(held), "cluster int, n long, total array<long>")
    totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(centers.shape[1])]
    sums, counts = np.zeros_like(centers), np.zeros(len(centers), np.int64)
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        counts[row[0]], sums[row[0]] = row[1], row[2:]
    held.unpersist()
    return floor_means(sums, counts, centers)


def cluster(df: DataFrame, id_col: str, vector: str, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS, seed: int = SEED) -> DataFrame:
    """One row for each vector of `components` components, none null or non-finite: `id_col`, `cluster`
    (its centroid's number), `distance` (squared), `cluster_inertia`, `inertia` (distances summed over the
    cluster and over all), `centroid_sha256` (of the centroid's components).

    Components become floor(scale * x). The first centroids are the k vectors whose ids have the least
    SHA-256 of `seed:id`, of equal ids the least vectors; a vector with a null id is none. There are fewer
    where there are fewer vectors. Each of `rounds` rounds assigns every vector to the nearest centroid, of
    equally near ones the lower, and moves each centroid that has vectors to their floored mean.

    Other vectors (null, of another length, with a null or non-finite component) have no row. Repeated
    rows each have theirs. No vectors, or none with an id, give an empty result. Further columns are
    ignored. A component beyond `vectors.LARGEST` after scaling is an error.
    """
    if id_col.lower() in OUTPUT:
        raise ValueError(f"{id_col} is a column of the result")
    spark, id_type = df.sparkSession, df.schema[id_col].dataType
    kept = df.filter(F.coalesce(F.size(vector) == components, F.lit(False)) & finite(F.col(vector)))
    # Ids travel as text: pandas would make floating-point numbers of whole ones beside nulls.
    vectors = materialize(kept.select(F.col(id_col).cast("string").alias("id"), scaled(F.col(vector), scale).alias("v")), "centroids-vectors")
    first = vectors.filter("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256), "v").limit(k).collect()
    schema = "id string, cluster int, distance long"
    if first:
        centers = np.array([r.v for r in first], np.int64)
        for _ in range(rounds):
            centers = next_centroids(vectors, centers)
        held = spark.sparkContext.broadcast(centers)
        rows = materialize(vectors.mapInPandas(_assigned(held), schema), "centroids-rows")
        held.unpersist()
    else:
        centers, rows = np.zeros((0, components), np.int64), spark.createDataFrame([], schema)
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # As many rows as there are centroids.
    facts = spark.createDataFrame([(i, s, sum(inertia.values()), digest(centers[i])) for i, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("id").cast(id_type).alias(id_col), *OUTPUT)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components with their clusters."""
    return cluster(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _sql() -> str:
    """The rounds written out one after the other."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, v FROM kept ORDER BY 1 LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM (SELECT vec_id, k.v, c,
 CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept k CROSS JOIN c{i} m)) WHERE r = 1)""")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT c, list(m ORDER BY j) AS v FROM (SELECT c, j, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
 FROM (SELECT c, unnest(v) AS x, unnest(range({COMPONENTS})) AS j FROM a{i}) GROUP BY c, j) GROUP BY c)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(s.v, o.v) AS v FROM c{i} o LEFT JOIN s{i} s USING (c))")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
 CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} m USING (c)"""


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
ORACLE_SQL = {"op12_centroid_clustering": _sql()}
