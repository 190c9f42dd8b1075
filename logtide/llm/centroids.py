"""Centroid clustering of vectors by Lloyd's rounds over distinct vectors.

Each vector becomes whole numbers, floor(64 x).  Equal ones are grouped once, with their multiplicity; the rounds run on the groups alone: a task
assigns its groups to centroids by one matrix product and returns, for each centroid, the weighted whole-number sums of its components, so that
the new centroids (floor of sum by count) do not depend on how the rows are dealt.  Then the groups' assignments are joined back to the ids.  Groups
with more than a thousandth of all vectors, so fewer than a thousand, are joined by broadcast: no task meets a common vector's rows.

What reaches the driver are 16 starting vectors and 16 sums of 64 components a round.  Vectors are grouped exactly and joined back by 128 bits of hash, taken
as exact.

Cases:  a vector that is null, has not exactly 64 components, or has one that is null or not finite is left out; a component of 131,072 or more either way is an
error (its distances would not be exact); with fewer than 16 vectors there are as many centroids; repeated rows are vectors each; a null vec_id never starts a
centroid but is assigned; starts of equal ids follow their components; of equally near centroids the smaller number counts; no vectors give no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
LIMIT = 1 << 23
"""Whole components stay below this, so that products of vectors are exact in doubles."""
COMMON = 1000
"""A group with more than one in so many vectors is joined by broadcast."""
GROUP_COLUMNS = "q array<int>, n long, cluster int, distance long"


def quantised(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, q) of the vectors (vec_id, embedding) that count."""
    e = F.col("embedding")
    sound = (F.size(e) == size) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    whole = lambda x: F.floor(x.cast("double") * SCALE)
    checked = lambda x: F.when(F.abs(whole(x)) < LIMIT, whole(x).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))
    return vectors.where(e.isNotNull()).where(sound).select("vec_id", F.transform(e, checked).alias("q"))


def groups(kept: DataFrame) -> DataFrame:
    """(q, n): distinct vectors with their multiplicity, as a table."""
    return saved(kept.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")


def starts(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors of least hash of their ids."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id is not null").select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(0)
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each row's nearest centroid."""
    products = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    distance = (x * x).sum(axis=1)[:, None] - 2 * products + (centroids * centroids).sum(axis=1)[None, :]
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(x)), best]


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, n = _matrix(batch), batch.column(1).to_numpy()
            if not len(x):
                continue
            cluster, _ = nearest(x, centroids)
            for c in np.unique(cluster):
                own = cluster == c
                sums[c] += n[own] @ x[own]
                counts[c] += n[own].sum()
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = distinct.select("q", "n").mapInArrow(run, "cluster long, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Groups with cluster and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(_matrix(batch), centroids)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(run, GROUP_COLUMNS)


def _identity(q: Column) -> list[Column]:
    return [F.xxhash64(q).alias("h1"), F.xxhash64(F.lit(1), q).alias("h2")]


def joined(kept: DataFrame, clustered: DataFrame, total: int) -> DataFrame:
    """(vec_id, cluster, distance) of each vector, by the group that it belongs to."""
    ids = kept.select("vec_id", *_identity(F.col("q")))
    found = clustered.select(*_identity(F.col("q")), "n", "cluster", "distance")
    often = F.col("n") * COMMON > total
    common = F.broadcast(found.where(often).drop("n"))  # fewer than COMMON rows
    by_broadcast = ids.join(common, ["h1", "h2"])
    others = ids.join(common.select("h1", "h2"), ["h1", "h2"], "left_anti").join(found.where(~often).drop("n"), ["h1", "h2"])
    return by_broadcast.unionByName(others).select("vec_id", "cluster", "distance")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """(vec_id, cluster, distance) of the vectors that count, the centroids, and each cluster's inertia."""
    kept = quantised(vectors, size)
    distinct, centroids = groups(kept), starts(kept, k)
    if not len(centroids):
        return kept.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, {}
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    clustered = assigned(distinct, centroids)
    rows = clustered.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("distance")).alias("inertia")).collect()  # a row a centroid
    return joined(kept, clustered, sum(r.n for r in rows)), centroids, {r.cluster: r.inertia for r in rows}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids, inertia = cluster(read(spark, sf_dir, "embeddings"))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in enumerate(digest)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """Assignment and means, round by round."""
    parts = [
        f"""k AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM k WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS (SELECT rid, vec_id, q, c, d FROM (SELECT rid, vec_id, k.q, c, list_sum(list_transform(list_zip(k.q, c{i}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM k, c{i})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if i < ROUNDS:
            parts.append(f"""m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM (SELECT c, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT c, unnest(q) AS v, unnest(range({SIZE})) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
c{i + 1} AS (SELECT * FROM m{i} UNION ALL SELECT * FROM c{i} WHERE c NOT IN (SELECT c FROM m{i}))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a{ROUNDS}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{ROUNDS}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{ROUNDS}.q, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = a{ROUNDS}.c"""
