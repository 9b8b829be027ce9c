"""Centroid clustering in whole numbers, by equal-average equal-variance search.

A vector's component becomes floor(scale * x). Centroids are sorted by the sum of their components, and each vector
scans outward from where its own sum stands. With k components, sums S and deviations V (the length of what is left
when the mean is taken from each component), the squared distance is at least (S - S')^2 / k and at least
(S - S')^2 / k + (V - V')^2. The first bound ends the scan, since later centroids lie further out; the second skips a
centroid; what is left is measured exactly in integers. Both tests leave room for rounding, so none that is nearest or
ties with it is lost.

Each round is one pass over the table: tasks give a count and a vector of sums for each centroid, and the next centroids
are exact floors of the means. Only centroids (a number set by a parameter) reach the driver, and they go to the tasks
with the function. All sums are whole numbers, so results don't depend on how rows are dealt.

Vectors that are null, of another length, or hold null or non-finite components take no part and have no row; nor have
those with a component beyond LARGEST in size after scaling, whose distances don't fit a long. Repeated rows are
vectors of their own. A null vec_id takes part, but starts no centroid; of equal hashes the smaller vector comes first.
With fewer vectors than centroids each starts one; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Largest size of a scaled component: squared distances over 64 components then fit a long.
LARGEST = 1 << 27
#: Vectors searched at once.
ROWS = 4_096
#: Relative room for rounding in the bounds.
ROOM = 1e-12


@dataclass(frozen=True)
class Settings:
    clusters: int = 16
    rounds: int = 3
    components: int = 64
    scale: int = 64
    seed: int = 1


def sums_and_deviations(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the rows, and the lengths of the rows less their means (relative error near 1e-15)."""
    k, s = x.shape[1], x.sum(axis=1)
    return s, np.sqrt(((k * x - s[:, None]).astype(float) ** 2).sum(axis=1)) / k


class Search:
    """Nearest centroids of whole-number vectors; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        sums, deviations = sums_and_deviations(centroids)
        self.order = np.argsort(sums, kind="stable")
        self.centroids, self.sums, self.deviations = centroids[self.order], sums[self.order], deviations[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and squared distances, and how many distances were measured."""
        n, k = x.shape
        s, v = sums_and_deviations(x)
        right = np.searchsorted(self.sums, s)
        left = right - 1
        low, high = np.r_[self.sums, 0], np.r_[self.sums, 0]
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.order))
        open_, measured = np.arange(n), 0
        while open_.size:
            at_left, at_right = left[open_], right[open_]
            below = np.where(at_left >= 0, s[open_] - low[at_left], np.inf)
            above = np.where(at_right < len(self.order), high[np.minimum(at_right, len(self.order))] - s[open_], np.inf)
            goes_left = below <= above
            at, gap = np.where(goes_left, at_left, at_right), np.minimum(below, above)
            most = best[open_] * (1 + ROOM)
            by_mean = gap * gap / k * (1 - ROOM)
            going = by_mean <= most
            going &= np.isfinite(gap)
            open_, at, goes_left, by_mean, most = open_[going], at[going], goes_left[going], by_mean[going], most[going]
            left[open_] -= goes_left
            right[open_] += ~goes_left
            theirs, own = self.deviations[at], v[open_]
            apart = np.maximum(np.abs(own - theirs) - ROOM * (own + theirs), 0)
            near = by_mean + apart * apart * (1 - ROOM) <= most
            who, c = open_[near], at[near]
            measured += len(who)
            d = ((x[who] - self.centroids[c]) ** 2).sum(axis=1)
            wins = (d < best[who]) | ((d == best[who]) & (self.order[c] < number[who]))
            best[who[wins]], number[who[wins]] = d[wins], self.order[c[wins]]
        return number, best, measured


def scaled(batch: pa.RecordBatch, how: Settings) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_id and whole-number vectors of a batch (vec_id, embedding of valid rows), ROWS at a time."""
    lists = batch.column(1)
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), how.components)
    for i in range(0, len(x), ROWS):
        yield batch.column(0).slice(i, ROWS), np.floor(how.scale * x[i : i + ROWS].astype(float)).astype(np.int64)


def valid(vectors: DataFrame, how: Settings = Settings()) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    largest = LARGEST / how.scale
    return vectors.select("vec_id", e.alias("embedding")).where((F.size("embedding") == how.components) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < largest)))


def _starts(rows: DataFrame, how: Settings) -> np.ndarray:
    """The first centroids: vectors with the smallest hash of seed and vec_id, in that order."""
    hash_ = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").select(hash_.alias("h"), "embedding").orderBy("h", "embedding").limit(how.clusters).collect()
    return np.floor(how.scale * np.array([r["embedding"] for r in first], float).reshape(len(first), how.components)).astype(np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray, how: Settings) -> np.ndarray:
    """Each centroid's exact floor of its vectors' mean; one without vectors stays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, sums = Search(centroids), np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            for _, x in scaled(batch, how):
                number, *_ = search.nearest(x)
                counts += np.bincount(number, minlength=len(centroids))
                np.add.at(sums, number, x)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = rows.mapInArrow(work, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place")
    out = centroids.copy()
    for r in cells.agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def assign(vectors: DataFrame, centroids: np.ndarray, how: Settings = Settings()) -> DataFrame:
    """vec_id, cluster int, distance long of the vectors that take part, by centroids as rows of whole numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            for ids, x in scaled(batch, how):
                number, distance, _ = search.nearest(x)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    schema = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return valid(vectors, how).mapInArrow(work, schema)


def fit(vectors: DataFrame, how: Settings = Settings()) -> np.ndarray:
    """Centroids as rows of whole numbers, after all rounds."""
    rows = valid(vectors, how)
    centroids = _starts(rows, how)
    for _ in range(how.rounds if len(centroids) else 0):
        centroids = _moved(rows, centroids, how)
    return centroids


def clusters(vectors: DataFrame, how: Settings = Settings()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of its components joined by commas)."""
    import hashlib

    centroids = fit(vectors, how)
    if not len(centroids):
        # Without a start no vector has a centroid.
        none = valid(vectors, how).where("false")
        return none.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]))
    rows = written(assign(vectors, centroids, how), "clusters")
    each = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # As many rows as there are clusters.
    facts = rows.sparkSession.createDataFrame([(c, each[c], sum(each.values()), digest[c]) for c in sorted(each)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(how: Settings = Settings()) -> str:
    """The same by plain search over all centroids."""
    k = how.components
    parts = [
        f"""v AS (SELECT vec_id, x FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({how.scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
             WHERE len(embedding) = {k} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{how.seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {how.clusters}))"""
    ]
    for r in range(how.rounds + 1):
        parts.append(
            f"""a{r} AS (SELECT vec_id, x, c, d FROM (SELECT vec_id, v.x, c, list_sum(list_transform(range({k}), lambda i: (v.x[i + 1] - c{r}.x[i + 1]) ** 2))::BIGINT AS d FROM v, c{r})
             QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        )
        if r < how.rounds:
            parts.append(
                f"""m{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(range({k})) AS i, unnest(x) AS x FROM a{r}) GROUP BY c, i),
c{r + 1} AS (SELECT c, coalesce(moved.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{r} GROUP BY c) AS moved USING (c))"""
            )
    last = how.rounds
    return f"""WITH {', '.join(parts)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{last}.x, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (c)"""


SQL = _sql()
