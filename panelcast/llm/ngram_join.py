"""N-gram Jaccard join by T-occurrence search.

A document's set is its distinct 3-word shingles (64-bit hashes); two documents link when 100 * intersection >= 90 *
union. The result is the components of the links.

1. Documents with equal sets are one class, and its smallest doc_id stands for it.
2. Candidates, exactly: two linked sets, the smaller of size a, differ in at most a / 9 shingles. For a band of sizes
   with at most k differences, the hash space is cut into k + 2 + k // 32 parts. Linked sets agree in more parts than
   either has empty ones, so they share the signature of a part that is not empty. The rare sets with that many empty
   parts also give their prefix (in hash order) as signatures. A part is about seven shingles, so a passage that many
   documents share makes no candidates by itself. Signatures that two classes share give candidate clusters.
3. In each cluster, T-occurrence search over the inverted lists of the whole sets: shingles that occur in the same
   documents are one weighted list; the short lists of a query are merged with a heap (by counting, if they hold
   more than HEAP elements), and documents that can reach the bound are looked up in the long lists by binary search
   (DivideSkip). What reaches the required
   overlap links. Documents that are known to be in the query's component need no lookup.
4. Clusters of more than BLOCK documents are split: first all are held against the cluster's pivot, in blocks; then
   only those that are not in the pivot's component are queries, against each block. Links that are left out join
   documents of one component.

Words are runs of non-white space (ASCII) of the whole text with A-Z lowered. A text with one or two words has that
sequence as its one shingle; null and empty texts have an empty set and are linked with nothing. Rows without
doc_id are searched for nothing and stand alone. Rows that repeat a doc_id are one document with several texts: it links
with whatever any of them links with; each row is returned, with the size of its own set. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, pieces, shingle_hashes, utf8, word_hashes
from .common import small_batches, written
from .graph import components

WORDS = 3
#: Documents of a cluster that one task searches at once.
BLOCK = 1_500
#: Elements that are merged with a heap; more are counted into an array.
HEAP = 256
BATCH_BYTES = 1 << 19
#: Sets below this size link only with equal ones.
LEAST = 9
_BANDS = [LEAST]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(_BANDS[-1] * 3 // 2)
BANDS = np.array(_BANDS)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text of a string column."""
    data, starts = utf8(column)
    for a, b in pieces(starts, BATCH_BYTES):
        local = starts[a : b + 1] - starts[a]
        words, _, _, first = word_hashes(data[starts[a] : starts[b]], local)
        grams = shingle_hashes(words, WORDS) if len(words) >= WORDS else np.zeros(0, np.uint64)
        for i, j in zip(first[:-1], first[1:]):
            if j - i >= WORDS:
                one = np.sort(grams[i : j - WORDS + 1])
                keep = np.ones(len(one), bool)
                np.not_equal(one[1:], one[:-1], out=keep[1:])
                yield one[keep]
            elif j > i:
                yield shingle_hashes(words[i:j], int(j - i))
            else:
                yield np.zeros(0, np.uint64)


def _set_key(grams: np.ndarray) -> bytes:
    return np.array([mix(grams).sum(dtype=np.uint64), mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def signatures(grams: np.ndarray) -> np.ndarray:
    """What a set shares with each set that it links with, unless both are equal."""
    n = len(grams)
    if n < LEAST:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(BANDS, n, "right")) - 1
    out = []
    spread = mix(grams)
    for band in (own, own - 1):
        if band < 0 or (band < own and 10 * (BANDS[own] - 1) < 9 * n):
            continue  # no set of that band is large enough to link with this one
        k = int(BANDS[band + 1] - 1) // 9
        parts = k + 2 + k // 32
        part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        tag = np.uint64(band + 1) << np.uint64(40)
        out.append(mix(np.add.reduceat(spread, first) + mix(part[first] + tag)))
        if parts - len(first) >= parts - k:
            prefix = grams[: n - -(-9 * n // 10) + 1]
            out.append(mix(prefix ^ mix(np.array([tag + np.uint64(1 << 39)]))))
    return np.concatenate(out)


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, signatures (as 64-bit numbers) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signs = [], [], []
            for grams in shingle_sets(batch.column(1)):
                sizes.append(len(grams))
                keys.append(_set_key(grams))
                signs.append(signatures(grams))
            ends = pa.array(np.cumsum([0, *map(len, signs)], dtype=np.int32))
            flat = pa.array(np.concatenate([*signs, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, flat)],
                names=["doc_id", "n_shingles", "set_key", "signatures"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_shingles long, set_key binary, signatures array<long>")


def _merged(lists: list[np.ndarray], weights: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of any of the lists, with the weight of the lists that hold them."""
    if sum(map(len, lists)) > HEAP:
        total = np.bincount(np.concatenate(lists), np.repeat(weights, [len(x) for x in lists]), n).astype(np.int64)
        return np.flatnonzero(total), total[total > 0]
    docs, sums = [], []
    for d, w in heapq.merge(*([(d, w) for d in x.tolist()] for x, w in zip(lists, weights))):
        if docs and docs[-1] == d:
            sums[-1] += w
        else:
            docs.append(d)
            sums.append(w)
    return np.array(docs, np.int64), np.array(sums, np.int64)


def search(sets: list[np.ndarray], queries: list[int]) -> np.ndarray:
    """For each set a representative of its component, by the links between the queries and all sets."""
    n = len(sets)
    component = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(grams, kind="stable")  # keeps each list in order of its documents
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    length = np.diff([*first, len(grams)])
    shared = length > 1
    if not shared.any():
        return component
    # Equal lists are one list with a weight.
    sign = np.add.reduceat(mix(owner.astype(np.uint64) + np.uint64(1)), first)
    _, one, weight = np.unique(sign[shared], return_index=True, return_counts=True)
    begin, size = first[shared][one], length[shared][one]
    lists = [owner[b : b + s] for b, s in zip(begin.tolist(), size.tolist())]
    weights = weight.tolist()
    of: list[list[int]] = [[] for _ in range(n)]
    for k in np.argsort(size, kind="stable").tolist():
        for d in lists[k].tolist():
            of[d].append(k)  # each document's lists, shortest first
    asked = np.zeros(n, bool)
    for q in queries:
        asked[q] = True  # later queries needn't look at this one
        mine, a = of[q], int(sizes[q])
        need = -(-9 * a // 10)
        # Long lists: as many of the longest as have too little weight to reach the bound by themselves.
        split, light = len(mine), 0
        while split and light + weights[mine[split - 1]] < need:
            split -= 1
            light += weights[mine[split]]
        if not split:
            continue
        docs, both = _merged([lists[k] for k in mine[:split]], [weights[k] for k in mine[:split]], n)
        b = sizes[docs]
        keep = (both + light >= need) & (10 * np.minimum(a, b) >= 9 * np.maximum(a, b)) & (component[docs] != component[q]) & ~asked[docs]
        docs, both, b, left = docs[keep], both[keep], b[keep], light
        for k in reversed(mine[split:]):  # the longest first: the likeliest to hold a candidate
            open_still = 100 * (both + left) >= 90 * (a + b - both - left)
            if not open_still.all():
                docs, both, b = docs[open_still], both[open_still], b[open_still]
            if not len(docs):
                break
            left -= weights[k]
            at = np.searchsorted(lists[k], docs)
            at[at == len(lists[k])] = 0
            both = both + weights[k] * (lists[k][at] == docs)
        for d in docs[100 * both >= 90 * (a + b - both)].tolist():
            component[component == component[d]] = component[q]
    return component


def _linked(groups: DataFrame) -> DataFrame:
    """(cluster, block, doc_id, is_query, text) to edges (u, v): each document that isn't the smallest of its component
    in the block, with that one. A task gets whole blocks, in order, and holds one at a time."""

    def block(rows: pd.DataFrame) -> list[tuple[int, int]]:
        rows = rows.drop_duplicates(["doc_id", "text"])
        ids = rows["doc_id"].tolist()
        component = search(list(shingle_sets(pa.array(rows["text"], pa.large_string()))), np.flatnonzero(rows["is_query"]).tolist())
        if len(set(ids)) < len(ids):  # several texts of one document: their components are one
            one: dict[int, int] = {}
            for i, k in enumerate(ids):
                component[component == component[i]] = component[one.setdefault(k, i)]
        least: dict[int, int] = {}
        for i, r in zip(ids, component.tolist()):
            least[r] = min(i, least.get(r, i))
        return [(i, least[r]) for i, r in zip(ids, component.tolist()) if least[r] != i]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            key = batch["cluster"].to_numpy() * np.int64(1_000_003) + batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(batch)]
            edges = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.iloc[a:b]
                if rest and (rest[0]["cluster"].iat[0] != part["cluster"].iat[0] or rest[0]["block"].iat[0] != part["block"].iat[0]):
                    edges += block(pd.concat(rest))
                    rest = []
                rest.append(part)
            yield pd.DataFrame(edges, columns=["u", "v"], dtype="int64")
        if rest:
            yield pd.DataFrame(block(pd.concat(rest)), columns=["u", "v"], dtype="int64")

    return (
        groups.repartition("cluster", "block")
        .sortWithinPartitions("cluster", "block", F.desc("is_query"), "doc_id")
        .mapInPandas(work, "u long, v long")
    )


def _block(blocks) -> Column:
    return F.pmod(F.xxhash64("doc_id"), blocks)


def _large_links(members: DataFrame, stars: DataFrame, texts: DataFrame) -> DataFrame:
    """members of large clusters (cluster, doc_id, blocks) to (node, component) of those that link."""
    columns = ["cluster", "block", "doc_id", "is_query", "text"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    # The pivot is the one with the most shared signatures, by the candidate edges at both ends.
    ends = stars.select(F.col("u").alias("doc_id"), "n").union(stars.select(F.col("v").alias("doc_id"), "n"))
    counted = ends.join(members, "doc_id").groupBy("cluster", "doc_id", "blocks").agg(F.sum("n").alias("n"))
    pivots = written(counted.groupBy("cluster", "blocks").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("doc_id")), "pivots")
    once = members.select("cluster", _block(F.col("blocks")).alias("block"), "doc_id", F.lit(False).alias("is_query"))
    everywhere = pivots.select("cluster", every("blocks").alias("block"), "doc_id", F.lit(True).alias("is_query"))
    links = written(_linked(once.unionByName(everywhere).hint("merge").join(texts, "doc_id").select(*columns)), "pivot-links")
    # The pivot was the only query, so every document of an edge is in its component.
    with_pivot = links.select(F.col("u").alias("doc_id")).union(links.select("v")).union(pivots.select("doc_id")).distinct()
    outside = written(members.join(with_pivot, "doc_id", "left_anti"), "outside")
    if not outside.isEmpty():
        # Blocks of queries against blocks of documents, so that a task holds two blocks at most.
        per = outside.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("query_blocks"))
        task = (F.col("i") * F.col("query_blocks") + F.col("j")).alias("block")
        again = outside.join(per, "cluster").select("cluster", "doc_id", "query_blocks", _block(F.col("query_blocks")).alias("j"), every("blocks").alias("i")).select("cluster", task, "doc_id", F.lit(True).alias("is_query"))
        there = members.join(per, "cluster").select("cluster", "doc_id", "query_blocks", _block(F.col("blocks")).alias("i"), every("query_blocks").alias("j")).select("cluster", task, "doc_id", F.lit(False).alias("is_query"))
        links = links.unionByName(_linked(again.unionByName(there).hint("merge").join(texts, "doc_id").select(*columns)))
    return components(links)


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row of docs with its class, and (node, component) of the classes that link."""
    small_batches(docs.sparkSession)
    every = written(set_table(docs), "sets")
    sets = every.drop("signatures")
    # Equal sets have equal signatures, so any one's will do: the arrays are dealt by class once, at every size.
    filled = every.where("doc_id IS NOT NULL AND n_shingles > 0")
    signed = written(filled.groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures")), "classes")
    classes = signed.drop("signatures")
    marks = signed.select(F.col("class_id").alias("doc_id"), F.explode("signatures").alias("s"))
    shared = marks.groupBy("s").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("w")).where("v < w").select("s", "v")
    # By sort-merge at every size: whether a small run would broadcast depended on which stage ended first.
    stars = written(marks.hint("merge").join(shared, "s").where("doc_id > v").groupBy(F.col("doc_id").alias("u"), "v").agg(F.count("*").alias("n")), "candidates")
    clusters = written(components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    large = written(clusters.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("cluster", F.ceil(F.col("size") / BLOCK).alias("blocks")), "large-clusters")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    small = clusters.join(large, "cluster", "left_anti").select("cluster", F.lit(0).alias("block"), "doc_id", F.lit(True).alias("is_query"))
    # In a cluster of one block, the edges are the components.
    links = written(_linked(small.hint("merge").join(texts, "doc_id").select("cluster", "block", "doc_id", "is_query", "text")), "links")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if not large.isEmpty():
        found = found.unionByName(_large_links(written(clusters.join(large, "cluster"), "large-members"), stars, texts))
    rows = sets.join(classes, ["set_key", "n_shingles"], "left")
    several = filled.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a < b").select("doc_id")
    if not several.isEmpty():  # a document with several texts is in the classes of all of them
        own = rows.join(several, "doc_id", "left_semi").where("class_id IS NOT NULL").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v"))
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(own))
    return rows, found


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_id (the smallest doc_id of the same set)."""
    rows, links = classes_and_links(docs)
    out = rows.join(links.withColumnRenamed("node", "class_id"), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: the one with the smallest doc_id of each group, and every one without doc_id."""
    gone = groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
