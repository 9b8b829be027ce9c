"""Fuzzy repeated passages by collinear chaining.

1. Seeds: of each WINDOW neighbouring shingles of K words, the one with the smallest hash. Two texts that share a run
   of WINDOW + K - 1 words share a seed there. About one seed for each two and a half words.
2. Seeds of one document only go. Each other occurrence is joined with the seed's home, its first
   document (smallest doc_id): a star, so a passage in very many documents makes no pairs among them.
3. The matches of a document and a home document are chained: from the left, a Fenwick tree over the home's places
   gives the best chain that ends before a match in both texts, at a cost for the gap between them. Chains are read
   off from the best one down.
4. Each chain, of one seed or more, is aligned: from seed to seed by the edit distance of the words in the gaps. A chain
   that falls short of the similarity is split: its longest part that has it counts, then the longest ones of what is
   left on either side. Beyond the ends of a part, up to MARGIN words are aligned: it ends where words less five times
   the edits are most, or, if it is too short so, at the furthest equal words that leave it the similarity. Passages of
   LEAST_WORDS words or more with similarity of 0.8 or more are reported, once for each document, home and place.
   At first only chains are aligned that don't lie within another chain of their document: a near copy has its passage
   with the first copy, and needs none with each of the others that some of its seeds occur in first.
5. Seeds that then lie in no reported passage get more homes: their own, if it was left out so; and, since the first
   document with a seed may share no more than that seed, the first document with it and another shared one within
   LEAST_WORDS words after it, for each such pair, and the first with all shared seeds of such a stretch. These
   matches are chained and aligned as the others.

What is certain: a run of LEAST_WORDS + 2 * (K + WINDOW) equal words in two documents is reported for the later one, with a home
that holds LEAST_WORDS words of it at least, whatever other documents hold parts of it: the first document with all
seeds of such a stretch. Passages that differ are found by the seeds that are left between the differences.

Words are runs of non-white space (ASCII), A-Z lowered, of the whole text. Null or empty texts and rows without
doc_id have no passages. Rows that repeat a doc_id with different texts are texts of their own; equal ones are one.
Passages that repeat within one document only aren't reported. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import pieces, shingle_hashes, utf8, word_hashes
from .common import small_batches, written

K, WINDOW = 5, 4
#: What a seed adds to a chain, and the cost of a word of gap (on either side).
GAIN, GAP = 8.0, 0.05
#: A passage needs so many words and such a similarity.
LEAST_WORDS, SIMILARITY = 30, 0.8
#: Half the band in which long gaps are aligned at first, beside the difference of their lengths.
BAND = 16
BATCH_BYTES = 1 << 19


def minimizers(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts' hashes laid end to end, so many for each: (text, place) of the smallest of each WINDOW hashes in a row
    (the first of equal ones); of fewer, the smallest."""
    room = np.where(counts > 0, np.maximum(counts, WINDOW), 0)
    starts = np.cumsum(room) - room
    texts = np.repeat(np.arange(len(room)), room)
    # Texts of fewer are filled up; of equal hashes the first counts, which is never a filling.
    filled = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
    filled[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(len(hashes))] = hashes
    n = max(0, len(filled) - WINDOW + 1)
    least, nearest = filled[:n], np.zeros(n, np.int64)
    for j in range(1, WINDOW):
        nearest = np.where(filled[j : j + n] < least, j, nearest)
        least = np.minimum(least, filled[j : j + n])
    places = np.arange(n) + nearest
    places = places[texts[:n] == texts[WINDOW - 1 :]] if n else places
    places = places[np.append(True, places[1:] != places[:-1])[: len(places)]]
    return texts[places], places - starts[texts[places]]


def thinned(hashes: np.ndarray, texts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one shingle follows itself (a word over and over), each WINDOWth place, and what tells these apart, so that
    such a run matches another along one diagonal: which are kept, and what is added to their hashes."""
    follows = np.append(False, (hashes[1:] == hashes[:-1]) & (texts[1:] == texts[:-1]) & (at[1:] == at[:-1] + 1))[: len(at)]
    every = np.arange(len(at))
    of_run = every - np.maximum.accumulate(np.where(follows, 0, every)) if len(at) else every
    keep = of_run % WINDOW == 0
    return keep, of_run[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def words_of_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    data, starts = utf8(column)
    for a, b in pieces(starts, BATCH_BYTES):
        words, _, _, first = word_hashes(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        for i, j in zip(first[:-1], first[1:]):
            yield words[i:j]


def seeds(docs: DataFrame) -> DataFrame:
    """(doc, seed, place) of each document's seeds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            owners, hashes, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for a, b in pieces(starts, BATCH_BYTES):
                words, _, _, first = word_hashes(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                if len(words) < K:
                    continue
                # The shingles of all texts at once, without those that reach into the next text.
                text = np.repeat(np.arange(b - a), np.diff(first))
                grams = shingle_hashes(words, K)[text[: len(text) - K + 1] == text[K - 1 :]]
                counts = np.maximum(np.diff(first) - K + 1, 0)
                text, at = minimizers(grams, counts)
                found = grams[(np.cumsum(counts) - counts)[text] + at]
                keep, nth_of_run = thinned(found, text, at)
                owners.append(text[keep] + a)
                hashes.append((found[keep] + nth_of_run).view(np.int64))
                places.append(at[keep].astype(np.int32))
            docs_of = batch.column(0).take(pa.array(np.concatenate(owners)))
            yield pa.RecordBatch.from_arrays([docs_of, pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places))], names=["doc", "seed", "place"])

    return docs.mapInArrow(work, "doc long, seed long, place int")


class Fenwick:
    """Largest value of a prefix, with who has it."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def before(self, at: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while at > 0:
            if self.best[at] > out:
                out = self.best[at]
            at &= at - 1
        return out


def chains(places: list[int], homes: list[int]) -> list[list[int]]:
    """Matches (place, home place), sorted by place: chains, best first; no match in two."""
    n = len(places)
    # In order in both texts, and no gap that costs what a seed adds: the best chain is that of all.
    if all(p < q and h < g and GAP * (q - p + g - h) <= 0.9 * GAIN for p, q, h, g in zip(places, places[1:], homes, homes[1:])):
        return [list(range(n))]
    ranks = sorted(set(homes))
    tree = Fenwick(len(ranks))
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and places[j] == places[i]:  # matches of one place can't follow each other
            rank = bisect_left(ranks, homes[j])
            value, who = tree.before(rank)
            gain = value - GAP * (places[j] + homes[j])
            score[j], back[j] = (GAIN + gain, who) if who >= 0 and gain > 0 else (GAIN, -1)
            j += 1
        for m in range(i, j):
            tree.put(bisect_left(ranks, homes[m]), (score[m] + GAP * (places[m] + homes[m]), m))
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: (-score[m], m)):
        chain, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = back[at]
        if chain:
            out.append(chain[::-1])
    return out


def _chained(matches: DataFrame) -> DataFrame:
    """(doc, home, place, home_place) to chains, and to the seeds in them as arrays. Matches may be repeated."""
    schema = "doc long, home long, start int, stop int, home_start int, home_stop int, n_seeds int, steady boolean, places array<int>, homes array<int>"

    def pair(doc: int, home: int, places: list[int], homes: list[int]) -> Iterator[tuple]:
        for c in chains(places, homes) if len(places) > 1 else [[0]]:
            a, b = c[0], c[-1]
            # All seeds at one distance, and none more than K words after the one before: the words agree between them.
            steady = all(homes[m] - places[m] == homes[a] - places[a] for m in c) and all(places[n] - places[m] <= K for m, n in zip(c, c[1:]))
            yield doc, home, places[a], places[b] + K, homes[a], homes[b] + K, len(c), steady, [] if steady else [places[m] - places[a] for m in c], [] if steady else [homes[m] - homes[a] for m in c]

    names = ["doc", "home", "start", "stop", "home_start", "home_stop", "n_seeds", "steady", "places", "homes"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rest = None, ([], [])
        before = None
        for batch in batches:
            doc, home, place, there = (batch[c].to_numpy() for c in ("doc", "home", "place", "home_place"))
            same = np.zeros(len(batch), bool)
            same[1:] = (doc[1:] == doc[:-1]) & (home[1:] == home[:-1]) & (place[1:] == place[:-1]) & (there[1:] == there[:-1])
            if len(batch):
                same[0] = before == (doc[0], home[0], place[0], there[0])
                before = (doc[-1], home[-1], place[-1], there[-1])
            doc, home, place, there = (x[~same] for x in (doc, home, place, there))
            places, homes = place.tolist(), there.tolist()
            cuts = [0, *(np.flatnonzero((doc[1:] != doc[:-1]) | (home[1:] != home[:-1])) + 1).tolist(), len(doc)]
            out: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if key != (doc[a], home[a]):
                    if key is not None:
                        out += pair(*key, *rest)
                    key, rest = (int(doc[a]), int(home[a])), ([], [])
                rest[0].extend(places[a:b])
                rest[1].extend(homes[a:b])
            yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame(list(pair(*key, *rest)), columns=names)

    return matches.repartition("doc", "home").sortWithinPartitions("doc", "home", "place", "home_place").mapInPandas(work, schema)


def edits(a: np.ndarray, b: np.ndarray, limit: int | None = None) -> int:
    """Edit distance of two word sequences: equal ends go first; short rests cell by cell, long ones in a band around
    the diagonal, which is widened until it holds a best path. If the distance is over limit, more than limit."""
    n = min(len(a), len(b))
    if len(a) == len(b) and (wrong := int(np.count_nonzero(a != b))) <= 2:
        return wrong  # at one length, an insertion needs a deletion too
    same = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b = a[same:], b[same:]
    n = min(len(a), len(b))
    same = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    if len(a) * len(b) <= 400:
        one, two = a.tolist(), b.tolist()
        row = list(range(len(two) + 1))
        for i, x in enumerate(one, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(two, 1):
                corner, row[j] = row[j], min(corner + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]
    most = len(a) if limit is None else min(limit, len(a))
    if len(a) - len(b) > most:
        return most + 1
    band = BAND + len(a) - len(b)
    while (found := _banded(a, b, band)) > band and band <= most:
        band *= 2
    return min(found, len(a)) if limit is None or found <= band else max(found, limit + 1)


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The least edits of the paths within a band around the diagonal; exact if that is no more than its half width."""
    width = 2 * band + 1
    offsets = np.arange(width)
    far = len(a) + len(b) + 1
    row = np.abs(offsets - band).astype(np.int64)
    row[offsets < band] = far
    padded = np.concatenate([np.zeros(band, b.dtype), b, np.zeros(max(0, len(a) - len(b)) + band + 1, b.dtype)])
    for i in range(1, len(a) + 1):
        # Cell k of the row is place j = i - band + k of b.
        j = i - band + offsets
        cost = (padded[i - 1 : i - 1 + width] != a[i - 1]).astype(np.int64)
        here = np.minimum(np.where((j >= 1) & (j <= len(b)), row + cost, far), np.append(row[1:], far) + 1)
        here[j == 0] = i
        here[(j < 0) | (j > len(b))] = far
        row = np.minimum.accumulate(here - offsets) + offsets
        row[(j < 0) | (j > len(b))] = far
    return int(row[len(b) - len(a) + band])


def gap_edits(one: bytes, two: bytes, places, homes) -> list[int]:
    """Edits between two stretches of 32-bit words, from each matched seed to the next (places from the stretches'
    starts): each gap is aligned by itself, and most are equal. A gap that no part can bridge isn't aligned."""
    out = []
    most = max(places[-1] - places[0], homes[-1] - homes[0]) + K
    for p, q, h, g in zip(places[:-1], places[1:], homes[:-1], homes[1:]):
        a, b = one[4 * p : 4 * q], two[4 * h : 4 * g]
        if a == b:
            out.append(0)
        elif 5 * abs(q - p - g + h) > most:
            out.append(max(q - p, g - h))
        else:
            out.append(edits(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), most // 5 + 1))
    return out


def parts(places: list[int], homes: list[int], wrong: list[int]) -> list[tuple[int, int]]:
    """Of a chain's seeds, with the edits from each to the next: (first, last) of the longest part with at most an edit
    for five words, then those of the rest on its left and right."""
    # Words less five times the edits, up to each seed: a part has the similarity if this is no smaller at its end.
    worth = [0]
    for k, e in enumerate(wrong):
        worth.append(worth[-1] + max(places[k + 1] - places[k], homes[k + 1] - homes[k]) - 5 * e)
    out, todo = [], [(0, len(places) - 1)]
    while todo:
        low, high = todo.pop()
        if low > high:
            continue
        if worth[high] - worth[low] + K >= 0:
            out.append((low, high))
            continue
        # A start is of use only if no seed before it has as small a worth; ends are tried from the right.
        starts = [low]
        for k in range(low + 1, high + 1):
            if worth[k] < worth[starts[-1]]:
                starts.append(k)
        best = (0, low, low)
        for a in range(high, low - 1, -1):
            while starts and starts[-1] > a:
                starts.pop()
            while starts and worth[a] - worth[starts[-1]] + K >= 0:
                best = max(best, (places[a] - places[starts[-1]] + homes[a] - homes[starts[-1]], starts[-1], a))
                starts.pop()
        _, first, last = best
        out.append((first, last))
        todo += [(low, first - 1), (last + 1, high)]
    return sorted(out)


NAMES = ["doc_id", "start", "stop", "home_id", "home_start", "home_stop", "n_seeds", "edits", "similarity"]
#: Words beyond a chain's ends that are aligned, in a band of SLACK on either side of the diagonal.
MARGIN, SLACK = 32, 8
#: Stretches of one document that a row asks for, about.
REQUESTS = 1_000


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop, home_id, home_start, home_stop (words, stop exclusive), n_seeds, edits and similarity."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc IS NOT NULL")
    repeated = rows.groupBy("doc").count().where("count > 1").select("doc")
    several = not repeated.limit(1).isEmpty()
    if several:  # texts of one doc_id go by numbers of their own
        names = written(rows.join(repeated, "doc", "left_semi").select(F.xxhash64("doc", "text").alias("key"), F.col("doc").alias("name")).distinct(), "repeated-ids")
        own = rows.join(repeated, "doc", "left_semi").select(F.xxhash64("doc", "text").alias("doc"), "text").dropDuplicates(["doc"])
        rows = rows.join(repeated, "doc", "left_anti").unionByName(own)
    # By windows, so that the many seeds that occur once are shuffled once and never written.
    by_seed = Window.partitionBy("seed")
    shared = seeds(rows).withColumn("first", F.min("doc").over(by_seed)).withColumn("last", F.max("doc").over(by_seed)).where("first < last")
    # A document's first occurrence meets the home's first, its second the second, and so on: a text that says the same
    # over and over has one chain with another such text.
    nth = F.row_number().over(Window.partitionBy("seed", "doc").orderBy("place"))
    there = F.sort_array(F.collect_list(F.when(F.col("doc") == F.col("first"), F.col("place"))).over(by_seed))
    shared = shared.withColumn("nth", nth).withColumn("there", there)
    shared = shared.select("doc", "seed", "place", F.struct(F.col("first").alias("doc"), F.element_at("there", F.least("nth", F.size("there"))).alias("place")).alias("h"))
    shared = written(shared, "seed-matches")
    chained = _chained(shared.where("h.doc < doc").select("doc", F.col("h.doc").alias("home"), "place", F.col("h.place").alias("home_place")))
    before = Window.partitionBy("doc").orderBy("start", F.desc("stop"), "home", "home_start").rowsBetween(Window.unboundedPreceding, -1)
    chained = written(chained.withColumn("inner", F.coalesce(F.max("stop").over(before) >= F.col("stop"), F.lit(False))), "chains")
    found = written(_aligned(rows, chained.where("NOT inner").drop("inner")), "passages")
    more = written(_further(shared, found, chained.where("inner").select("doc", "home").distinct()), "further-matches")
    if not more.isEmpty():
        found = found.unionByName(_aligned(rows, written(_chained(more), "chains"))).distinct()
    if several:
        for column in ("doc_id", "home_id"):
            found = found.join(names.select(F.col("key").alias(column), "name"), column, "left").withColumn(column, F.coalesce("name", column)).drop("name")
    return found.select(*NAMES)


def _further(shared: DataFrame, found: DataFrame, left_out: DataFrame) -> DataFrame:
    """(doc, home, place, home_place): for seeds in no reported passage of their document, their own home if it is
    left_out (doc, home), the first document with the seed and each shared seed in the stretch after it, and the first
    with all of them."""
    spans = found.select("doc_id", "start", "stop").distinct()
    within = (F.col("doc") == F.col("doc_id")) & (F.col("place") >= F.col("start")) & (F.col("place") + K <= F.col("stop"))
    # A seed's first document has no earlier one to be matched with; it is a home only.
    opened = written(shared.where("h.doc < doc").join(spans, within, "left_anti"), "open-seeds")
    wanted = opened.select("seed", F.lit(True).alias("wanted")).distinct()
    reach = LEAST_WORDS - K + WINDOW
    by_place = Window.partitionBy("doc").orderBy("place")
    # Lists are made only of what lies within the reach of a wanted seed, and only those meet the open seeds.
    near = shared.select("doc", "seed", "place").join(wanted, "seed", "left").withColumn("from", F.max(F.when(F.col("wanted"), F.col("place"))).over(by_place)).where(F.col("place") - F.col("from") <= reach)
    stretches = near.withColumn("ahead", F.collect_list(F.struct("place", "seed")).over(by_place.rangeBetween(0, reach))).where("wanted AND size(ahead) > 1").select("doc", "seed", "place", "ahead")
    stretches = stretches.join(opened.select("doc", "place", F.lit(True).alias("open")), ["doc", "place"], "left")
    pairs = F.transform(F.slice("ahead", 2, LEAST_WORDS), lambda x: F.struct(F.xxhash64("seed", x["seed"]).alias("key"), x["place"].alias("other")))
    whole = F.struct(F.xxhash64(F.transform("ahead", lambda x: F.struct(x["seed"], x["place"] - F.col("place")))).alias("key"), F.col("place").alias("other"))
    keyed = written(stretches.select("doc", "place", "open", F.inline(F.concat(pairs, F.array(whole)))), "pairs-of-seeds")
    homes = keyed.groupBy("key").agg(F.min(F.struct("doc", "place", "other")).alias("h"), F.max("doc").alias("last"), F.max("open").alias("any_open")).where("any_open AND h.doc < last").select("key", "h")
    met = keyed.where("open").join(homes, "key").where("h.doc < doc")
    both = F.array(F.struct("place", F.col("h.place").alias("home_place")), F.struct(F.col("other").alias("place"), F.col("h.other").alias("home_place")))
    own = opened.select("doc", F.col("h.doc").alias("home"), "place", F.col("h.place").alias("home_place")).join(left_out, ["doc", "home"], "left_semi")
    return met.select("doc", F.col("h.doc").alias("home"), F.inline(both)).unionByName(own).distinct()


def lengthened(one: list[np.ndarray], two: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of word sequences, and each number of words of the first: the most that words less five times the
    edits can be at a pair of equal words there (very small if there is none), the words of the second, the edits."""
    n, most = len(one), max([0, *map(len, one)])
    a, b = np.full((n, most), 1 << 33, np.int64), np.full((n, most + 2 * SLACK), 1 << 34, np.int64)
    for k, (x, y) in enumerate(zip(one, two)):
        a[k, : len(x)] = x
        y = y[: most + SLACK]
        b[k, SLACK : SLACK + len(y)] = y
    offsets = np.arange(2 * SLACK + 1, dtype=np.int32)
    row = np.tile(np.where(offsets >= SLACK, offsets - SLACK, 1 << 20).astype(np.int32), (n, 1))
    worth, words, wrong = np.zeros((n, most + 1), np.int32), np.zeros((n, most + 1), np.int32), np.zeros((n, most + 1), np.int32)
    each, far = np.arange(n), np.full((n, 1), 1 << 20, np.int32)
    for i in range(1, most + 1):
        # Column k of the row is place j = i - SLACK + k of the second; the fillings are equal to nothing.
        j = i - SLACK + offsets
        same = b[:, i - 1 : i - 1 + len(offsets)] == a[:, i - 1 : i]
        here = np.minimum(row + ~same, np.concatenate([row[:, 1:], far], axis=1) + 1)
        row = np.minimum.accumulate(here - offsets, axis=1) + offsets
        value = np.where(same, np.maximum(i, j) - 5 * row, -(1 << 24))
        best = value.argmax(axis=1)
        worth[:, i], words[:, i], wrong[:, i] = value[each, best], j[best], row[each, best]
    return worth, words, wrong


def _chain_parts(r) -> list[tuple]:
    """The parts of a chain: the words before and after (nearest first) of both texts, start, stop, home_start,
    home_stop, n_seeds, edits."""
    number = lambda x: np.frombuffer(x, np.uint32)
    before, after = (number(r.one_left), number(r.two_left)), (number(r.one_right), number(r.two_right))
    if r.steady:
        return [(before[0][::-1], before[1][::-1], *after, r.start, r.stop, r.home_start, r.home_stop, r.n_seeds, 0)]
    places, homes = r.places.tolist(), r.homes.tolist()
    wrong = gap_edits(r.one_inner, r.two_inner, places, homes)
    one = np.concatenate([before[0], number(r.one_inner), after[0]])
    two = np.concatenate([before[1], number(r.two_inner), after[1]])
    n, m = len(before[0]), len(before[1])
    out = []
    for i, j in parts(places, homes, wrong):
        p, q, h, g = places[i], places[j] + K, homes[i], homes[j] + K
        left = one[max(0, n + p - MARGIN) : n + p][::-1], two[max(0, m + h - MARGIN) : m + h][::-1]
        right = one[n + q : n + q + MARGIN], two[m + g : m + g + MARGIN]
        out.append((*left, *right, r.start + p, r.start + q, r.home_start + h, r.home_start + g, j - i + 1, sum(wrong[i:j])))
    return out


def _spans(cuts: list[tuple]) -> list[tuple | None]:
    """(start, stop, home_start, home_stop, n_seeds, edits, similarity) of each part that is a passage, with its ends."""
    out: list[tuple | None] = []
    for low in range(0, len(cuts), 1000):
        some = cuts[low : low + 1000]
        left, right = lengthened([c[0] for c in some], [c[1] for c in some]), lengthened([c[2] for c in some], [c[3] for c in some])
        start, stop, home_start, home_stop, n_seeds, wrong = np.array([c[4:] for c in some], np.int64).T

        def spans(k, a, b):
            s, t, h, g = start[k] - a, stop[k] + b, home_start[k] - left[1][k, a], home_stop[k] + right[1][k, b]
            e = wrong[k] + left[2][k, a] + right[2][k, b]
            similarity = 1 - e / np.maximum(t - s, g - h)
            good = (np.minimum(t - s, g - h) >= LEAST_WORDS) & (similarity >= SIMILARITY)
            for j, *span, x in zip(*(v[good].tolist() for v in (k, s, t, h, g, n_seeds[k], e, similarity))):
                found[j] = (*span, round(x, 6))
            return good

        found: list[tuple | None] = [None] * len(some)
        each = np.arange(len(some))
        rest = each[~spans(each, left[0].argmax(axis=1), right[0].argmax(axis=1))]
        if len(rest):
            total = left[0][rest][:, :, None] + right[0][rest][:, None, :] + (np.maximum(stop - start, home_stop - home_start) - 5 * wrong)[rest].astype(np.int32)[:, None, None]
            far = np.add.outer(np.arange(total.shape[1], dtype=np.int16), np.arange(total.shape[2], dtype=np.int16))
            a, b = np.divmod(np.where(total >= 0, far, np.int16(-1)).reshape(len(rest), -1).argmax(axis=1), total.shape[2])
            long = (stop - start)[rest] + a + b >= LEAST_WORDS
            spans(rest[long], a[long], b[long])
        out += found
    return out


def _aligned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The passages of chains, which are written. Of a steady chain only the margins at its ends are needed."""
    low = lambda c: F.greatest(F.col(c) - MARGIN, F.lit(0))
    ends = lambda doc, a, b: found.select(F.col(doc).alias("doc"), low(a).alias("a"), (F.col(b) + MARGIN).alias("b"), "steady", F.col(a).alias("from"), F.col(b).alias("to"))
    wanted = ends("doc", "start", "stop").unionByName(ends("home", "home_start", "home_stop")).distinct()
    # A document that is home to very many is read in several rows, REQUESTS stretches or so in each.
    parts = wanted.groupBy("doc").agg(F.ceil(F.count("*") / REQUESTS).alias("parts"))
    dealt = wanted.join(parts, "doc").groupBy("doc", F.pmod(F.xxhash64("a", "b", "from", "to"), "parts").alias("part"))
    asked = rows.join(dealt.agg(F.collect_list(F.struct("a", "b", "steady", "from", "to")).alias("asked")), "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = {c: [] for c in ("doc", "from", "to", "steady", "left", "inner", "right")}
            for i, words in enumerate(words_of_rows(batch.column(1))):
                small, doc = words.astype(np.uint32).tobytes(), batch.column(0)[i].as_py()
                for w in batch.column(2)[i].as_py():
                    start, stop = w["from"], w["to"]
                    frame["doc"].append(doc)
                    frame["from"].append(start)
                    frame["to"].append(stop)
                    frame["steady"].append(w["steady"])
                    frame["left"].append(small[4 * w["a"] : 4 * start])
                    frame["inner"].append(b"" if w["steady"] else small[4 * start : 4 * stop])
                    frame["right"].append(small[4 * stop : 4 * w["b"]])
            yield pa.RecordBatch.from_pydict(frame, schema=pa.schema([("doc", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("steady", pa.bool_()), ("left", pa.binary()), ("inner", pa.binary()), ("right", pa.binary())]))

    words = written(asked.select("doc", "text", "asked").mapInArrow(cut, "doc long, from int, to int, steady boolean, left binary, inner binary, right binary"), "stretches")
    one = words.select("doc", F.col("from").alias("start"), F.col("to").alias("stop"), "steady", F.struct("left", "inner", "right").alias("one"))
    two = words.select(F.col("doc").alias("home"), F.col("from").alias("home_start"), F.col("to").alias("home_stop"), "steady", F.struct("left", "inner", "right").alias("two"))
    both = found.join(one, ["doc", "start", "stop", "steady"]).join(two, ["home", "home_start", "home_stop", "steady"])
    both = both.select("doc", "home", "start", "stop", "home_start", "home_stop", "n_seeds", "steady", "places", "homes", *[F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in ("one", "two") for y in ("left", "inner", "right")])

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts, owners = [], []
            for r in batch.itertuples(index=False):
                mine = _chain_parts(r)
                cuts += mine
                owners += [(r.doc, r.home)] * len(mine)
            seen: dict[tuple, set[tuple]] = {}
            for owner, span in zip(owners, _spans(cuts)):
                if span is not None:
                    seen.setdefault(owner, set()).add(span)
            out = []
            for (doc, home), spans in seen.items():
                # From the longest down: one that lies within another isn't a passage of its own.
                kept: list[tuple] = []
                for v in sorted(spans, key=lambda v: (v[0] - v[1], v)):
                    if not any(w[0] <= v[0] and v[1] <= w[1] and w[2] <= v[2] and v[3] <= w[3] for w in kept):
                        kept.append(v)
                out += [(doc, s, t, home, h, g, n, e, x) for s, t, h, g, n, e, x in kept]
            yield pd.DataFrame(out, columns=NAMES)

    return both.mapInPandas(align, "doc_id long, start int, stop int, home_id long, home_start int, home_stop int, n_seeds int, edits int, similarity double").distinct()
