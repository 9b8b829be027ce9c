"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The trees are grown on a bounded sample (`sample_rows` rows with the smallest hash of vec_id); every row is then put
into its leaf of every tree, whatever the size of the table. For inner products, each vector gets one more component
that makes all equally long; queries have 0 there. A query walks all trees through one shared priority queue, by the
squared distances to the planes that it is on the wrong side of, until the leaves it has reached hold `enough` vectors
(with repeats from several trees).

How many are enough is measured: of `probes` sampled rows the exact k nearest are found among all rows (one pass over
the table with these as a broadcast query set), and `enough` is the least number with which the walk reaches `recall`
of them. So clustered vectors are searched in a few leaves, and vectors without any structure, where no index helps, in
most of them.

Queries are dealt into blocks of about `block`, rows into `parts` by a hash of vec_id, whatever their leaves: leaves of
any size, of equal vectors too, fall into all parts alike. Each pair of a block and a part is a group: its rows pass in
order of leaves, each leaf is scored against the queries of the block that reached it, exactly, in double precision on
the original vectors, and the k best of each query so far are all that is held. A row's leaves of all trees meet in one
part, so repeats go there. A group gives at most k rows a query, so what the groups give is `parts` times k a query,
however large the table and however many leaves are reached. Their best k are the result.

Counts of leaves are the only thing gathered besides the sample and the probes' neighbours; the sample bounds their
number.

Rows with a null vec_id, and vectors that are null, empty, zero, or hold null or non-finite components, take no part,
nor do vectors of another length than the most frequent one (of equally frequent ones, the longest). Rows that repeat
vec_id are one vector: the one that sorts first. Ties go to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import small_batches, written


@dataclass(frozen=True)
class Settings:
    k: int = 20
    trees: int = 4
    leaf_rows: int = 128
    sample_rows: int = 20_000
    recall: float = 0.95
    probes: int = 200
    block: int = 8_192
    parts: int = 12
    seed: int = 7


class Forest:
    """Inner nodes have a plane and two children; a child below 0 is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, how: Settings):
        rng = np.random.default_rng(how.seed)
        self.normals, self.offsets, self.children, self.roots, self.leaves, self.first_leaves = [], [], [], [], 0, []
        for _ in range(how.trees):
            self.first_leaves.append(self.leaves)
            self.roots.append(self._grow(sample, np.arange(len(sample)), how, rng))
        width = sample.shape[1]
        self.normals = np.array(self.normals).reshape(-1, width)
        self.offsets = np.array(self.offsets)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample, rows, how, rng) -> int:
        """Grow a tree with a stack of open nodes; returns the root."""
        root: list[int] = [0]
        stack = [(rows, root, 0)]
        while stack:
            rows, parent, side = stack.pop()
            plane = self._plane(sample, rows, rng) if len(rows) > how.leaf_rows else None
            if plane is None:
                parent[side] = self._leaf()
                continue
            normal, offset, left = plane
            parent[side] = len(self.children)
            mine = [0, 0]
            self.normals.append(normal)
            self.offsets.append(offset)
            self.children.append(mine)
            stack += [(rows[left], mine, 0), (rows[~left], mine, 1)]
        return root[0]

    @staticmethod
    def _plane(sample, rows, rng):
        for _ in range(8):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            size = np.linalg.norm(normal)
            if size > 1e-12:
                normal = normal / size
                offset = -float(normal @ (a + b)) / 2
                left = sample[rows] @ normal + offset > 0
                if 0.03 < left.mean() < 0.97:
                    return normal, offset, left
        return None

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, np.int64)
            while len(open_rows := np.flatnonzero(at >= 0)):
                node = at[open_rows]
                margin = np.einsum("ij,ij->i", x[open_rows], self.normals[node]) + self.offsets[node]
                at[open_rows] = self.children[node, np.where(margin > 0, 0, 1)]
            out[:, t] = -1 - at
        return out

    def walks(self, x: np.ndarray, counts: list[int], enough: float) -> Iterator[list[int]]:
        """The leaves that each query reaches, in that order, by one priority queue over all trees."""
        children = self.children.tolist()
        for some in np.array_split(x, max(1, len(x) // 512)):
            for margin in some @ self.normals.T + self.offsets:
                queue = [(0.0, root) for root in self.roots]
                heapq.heapify(queue)
                margin, found, total = margin.tolist(), [], 0
                while queue and total < enough:
                    far, node = heapq.heappop(queue)
                    if node < 0:
                        found.append(-1 - node)
                        total += counts[-1 - node]
                        continue
                    left, right = children[node]
                    away = margin[node] * margin[node]
                    on_left = margin[node] > 0
                    heapq.heappush(queue, (far if on_left else far + away, left))
                    heapq.heappush(queue, (far + away if on_left else far, right))
                yield found


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, array<float> if it is that and else array<double>."""
    e = F.col("embedding")
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0.0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"))
    best = sizes.agg(F.max(F.struct("rows", "n"))["n"].alias("n")).first()["n"]
    return rows.where(F.size("embedding") == F.lit(best)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """The k best of rows for each query, by exact score and then id: positions, ids and scores."""
    for start in range(0, len(queries), 256):
        rough = queries[start : start + 256] @ rows.T
        for i, scores in enumerate(rough, start):
            scores[ids == query_ids[i]] = -np.inf
            n = min(k, len(ids) - 1)
            limit = np.partition(scores, len(ids) - n)[len(ids) - n] if 0 < n < len(ids) else -np.inf
            slack = 1e-9 * max(1.0, abs(limit)) if np.isfinite(limit) else 0
            chosen = np.flatnonzero((scores >= limit - slack) & (scores > -np.inf))
            exact = (rows[chosen] * queries[i]).sum(axis=1)  # the same sum wherever a row stands: equal vectors tie
            order = np.lexsort((ids[chosen], -exact))[:k]
            yield i, ids[chosen[order]], exact[order]


def _enough(placed: DataFrame, probes: np.ndarray, probe_ids: np.ndarray, forest: Forest, counts: list[int], how: Settings) -> float:
    """The least number of vectors (with repeats) after which the walks of the probes have reached `recall` of their
    exact neighbours among all rows."""
    shared = placed.sparkSession.sparkContext.broadcast((probes, probe_ids))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, query_ids = shared.value
        for batch in batches:
            if len(batch):
                ids, leaves, out = batch["vec_id"].to_numpy(), batch["leaves"].to_numpy(), []
                at = pd.Series(np.arange(len(ids)), ids)
                for i, best, exact in best_of(queries, query_ids, _matrix(batch["embedding"]), ids, how.k):
                    if len(best):
                        out.append(pd.DataFrame({"probe": i, "vec_id": best, "score": exact, "leaves": list(leaves[at[best].to_numpy()])}))
                if out:
                    yield pd.concat(out)

    near = placed.mapInPandas(scan, "probe int, vec_id long, score double, leaves array<int>")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= how.k).select("probe", "leaves").toPandas()
    sizes, needs = np.array(counts), []
    for i, walk in enumerate(forest.walks(np.column_stack([probes, np.zeros(len(probes))]), counts, np.inf)):
        reached = np.full(len(sizes), np.inf)
        reached[walk] = np.cumsum(sizes[walk])
        needs += [reached[leaves].min() for leaves in near.loc[near["probe"] == i, "leaves"]]
    least = how.trees * (how.k + 1)
    return max(least, sorted(needs)[-(-int(how.recall * 1000) * len(needs) // 1000) - 1]) if needs else least


class _Best:
    """The k best rows met so far of each query of a block, by exact score and then id; a row met again counts once."""

    PENDING = 1 << 20

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.least = np.full(len(ids), -np.inf)  # a query's k-th score
        none = np.empty(0, np.int64)
        self.held, self.pending, self.size = (none, none, np.empty(0)), [], 0

    def add(self, who: np.ndarray, rows: np.ndarray, row_ids: np.ndarray) -> None:
        """Offer rows to the queries at the places `who`."""
        asking = self.queries[who]
        step = max(1, self.PENDING // len(who))
        for low in range(0, len(rows), step):
            some, some_ids = rows[low : low + step], row_ids[low : low + step]
            least = self.least[who]
            slack = np.where(np.isfinite(least), 1e-9 * np.maximum(1.0, np.abs(least)), 0.0)
            i, j = np.nonzero(asking @ some.T >= (least - slack)[:, None])
            other = self.ids[who[i]] != some_ids[j]
            i, j = i[other], j[other]
            exact = np.empty(len(i))
            for at in range(0, len(i), 1 << 16):  # the same sum wherever a row stands: equal vectors tie
                exact[at : at + (1 << 16)] = (some[j[at : at + (1 << 16)]] * asking[i[at : at + (1 << 16)]]).sum(axis=1)
            self.pending.append((who[i], some_ids[j], exact))
            self.size += len(i)
            if self.size >= self.PENDING:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores of the best."""
        who, ids, scores = map(np.concatenate, zip(self.held, *self.pending))
        order = np.lexsort((ids, -scores, who))
        who, ids, scores = who[order], ids[order], scores[order]
        again = np.zeros(len(who), bool)
        again[1:] = (who[1:] == who[:-1]) & (ids[1:] == ids[:-1])
        who, ids, scores = who[~again], ids[~again], scores[~again]
        first = np.searchsorted(who, who)
        rank = np.arange(len(who)) - first
        kth = rank == self.k - 1
        self.least[who[kth]] = scores[kth]
        best = rank < self.k
        self.held, self.pending, self.size = (who[best], ids[best], scores[best]), [], 0
        return self.held


def _search(k: int):
    """The function of batches that scores parts. A part's queries (with the leaves they want) come first, then its rows
    by leaf; a part gives at most k rows a query."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, asked, best, wanting = None, [], None, {}

        def begin():
            both = pd.concat(asked)
            who = np.repeat(np.arange(len(both)), [len(w) for w in both["wanted"]])
            leaves = np.concatenate(both["wanted"].to_list())
            order = np.argsort(leaves, kind="stable")
            names, first = np.unique(leaves[order], return_index=True)
            return _Best(_matrix(both["embedding"]), both["vec_id"].to_numpy(), k), dict(zip(names.tolist(), np.split(who[order], first[1:])))

        def end():
            if best is not None:
                who, ids, scores = best.settle()
                yield pd.DataFrame({"query_id": best.ids[who], "vec_id": ids, "score": scores})

        for batch in batches:
            keys = batch["part"].to_numpy()
            for some in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(keys)) + 1):
                if not len(some):
                    continue
                mine = batch.iloc[some]
                if mine["part"].iloc[0] != at:
                    yield from end()
                    at, asked, best = mine["part"].iloc[0], [], None
                is_query = (mine["leaf"] < 0).to_numpy()
                if is_query.any():
                    asked.append(mine[is_query])
                mine = mine[~is_query]
                if not len(mine) or not asked:
                    continue
                if best is None:
                    best, wanting = begin()
                leaves, rows, ids = mine["leaf"].to_numpy(), _matrix(mine["embedding"]), mine["vec_id"].to_numpy()
                for one in np.split(np.arange(len(leaves)), np.flatnonzero(np.diff(leaves)) + 1):
                    who = wanting.get(int(leaves[one[0]]))
                    if who is not None:
                        best.add(who, rows[one], ids[one])
        yield from end()

    return work


def neighbours(vectors: DataFrame, is_query, how: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (a column of vec_id) holds."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(usable(vectors), "vectors")
    kind = rows.schema["embedding"].dataType.simpleString()
    longest = rows.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m")).first()["m"]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample_rows).toPandas()
    grown = _matrix(sample["embedding"])

    def level(x: np.ndarray) -> np.ndarray:
        """One more component, so that all are equally long."""
        return np.column_stack([x, np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0))])

    forest = spark.sparkContext.broadcast(Forest(level(grown), how))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["leaves"] = list(forest.value.leaves_of(level(_matrix(batch["embedding"]))).astype(np.int32))
                yield batch[["vec_id", "embedding", "leaves"]]

    placed = written(rows.mapInPandas(place, f"vec_id long, embedding {kind}, leaves array<int>"), "placed")
    sizes = {r["leaf"]: r["n"] for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    counts = [sizes.get(i, 0) for i in range(forest.value.leaves)]
    enough = _enough(placed, grown[: how.probes], sample["vec_id"].to_numpy()[: how.probes], forest.value, counts, how)
    shared = spark.sparkContext.broadcast(counts)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["embedding"])
                wanted = [np.sort(np.array(found, np.int32)) for found in forest.value.walks(np.column_stack([x, np.zeros(len(x))]), shared.value, enough)]
                yield pd.DataFrame({"vec_id": batch["vec_id"], "embedding": batch["embedding"], "wanted": wanted})

    asked = written(rows.where(is_query).mapInPandas(walk, f"vec_id long, embedding {kind}, wanted array<int>"), "walked")
    blocks = max(1, -(-asked.count() // how.block))
    own = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = (F.col("q") * how.parts + F.col("r")).alias("part")
    left = asked.withColumn("q", own(blocks, 1)).withColumn("r", each(how.parts)).select(part, F.lit(-1).alias("leaf"), "vec_id", "embedding", "wanted")
    right = placed.select("vec_id", "embedding", F.explode("leaves").alias("leaf"), own(how.parts, 2).alias("r")).withColumn("q", each(blocks)).select(part, "leaf", "vec_id", "embedding", F.lit(None).cast("array<int>").alias("wanted"))
    dealt = left.unionByName(right).repartition("part").sortWithinPartitions("part", "leaf")
    scored = dealt.mapInPandas(_search(how.k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
