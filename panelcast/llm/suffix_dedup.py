"""Exact substring dedup by suffix sorting: remove each byte covered by a WINDOW-byte string that occurs elsewhere, and
report the bytes covered by a shorter string, of SHORT bytes, that does.

Equal strings of SHORT bytes have the same anchor: the substring of CORE bytes inside with the smallest hash (the
leftmost of equal ones). A WINDOW-byte string goes by the anchor of its first SHORT bytes. So

1. each document is cut into runs of window starts with one anchor: an occurrence (anchor hash, hash of all bytes that
   these windows cover, place), about one for each 65 bytes. Counts by anchor drop what occurs once.
2. Occurrences that cover the same bytes are repeated as a whole; how many there are doesn't matter, so large groups
   of copies are counts.
3. Where one anchor has several different surroundings, the distinct ones are suffix-sorted. What stands right of an
   anchor is sorted once and then stands for itself as one symbol with the anchor, so suffixes are the places up to
   the anchor. Neighbours in that order that agree in SHORT or WINDOW bytes are repeated. Suffix sorting groups
   suffixes by their Lyndon prefixes, from the highest group down, along pointers to the previous smaller group, and
   then reads off each group's order: linear, and no renaming by recursion.
4. An anchor with more than LARGE distinct surroundings is narrowed first: its windows are taken apart by where the
   anchor lies in them, STEP places together, for either length by itself, and the bytes that all windows of such a
   class share are a longer anchor. Then 2 and 3 hold again. What still has more than LARGE distinct surroundings (they differ in the outermost
   bytes only) goes another exact way: its windows, STEP at most for each, are counted by hash.

Texts are UTF-8 bytes; matches don't cross documents; null text is empty. What is shorter than WINDOW bytes keeps all.
Rows that repeat doc_id and text are documents of their own (each holds the other's text) and get equal results. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Substrings, mix, pieces, utf8
from .common import small_batches, written

WINDOW, SHORT, CORE = 400, 256, 128
#: Distinct surroundings of one anchor that are suffix-sorted together; places that a narrowed class spans.
LARGE, STEP = 500, 16
BATCH_BYTES = 1 << 19
#: Symbols that are suffix-sorted at once, about.
SORTED_AT_ONCE = 100_000
#: Bytes of one document that are looked at at once; places in it fit into PLACE_BITS.
PIECE, PLACE_BITS = 1 << 19, 20


def suffix_array(text: list[int]) -> list[int]:
    """The order of the suffixes of a text whose last symbol is smaller than all others."""
    n = len(text)
    by_symbol = np.argsort(np.asarray(text), kind="stable")
    symbols = np.asarray(text)[by_symbol]
    firsts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])).tolist()
    # A group is known by the place in the order where it starts, so groups compare as these numbers.
    group, members, end_of, start_at = [0] * n, {}, {}, [0] * (n + 1)
    for first, end in zip(firsts, [*firsts[1:], n]):
        own = by_symbol[first:end].tolist()
        members[first], end_of[first], start_at[end] = own, end, first
        for i in own:
            group[i] = first
    smaller = [-1] * n
    end = n
    while end > 0:
        here = start_at[end]
        pointed: dict[int, int] = {}
        for i in members.pop(here):
            if group[i] != here:
                continue  # it has moved up since
            j = i - 1
            while j >= 0 and group[j] >= here:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        # What has more pointers is larger; within a number of pointers each group is split by itself.
        levels: dict[int, dict[int, list[int]]] = {}
        for j, times in pointed.items():
            levels.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(levels, reverse=True):
            for old, moved in levels[times].items():
                old_end = end_of[old]
                new = old_end - len(moved)
                if new != old:
                    for j in moved:
                        group[j] = new
                    members[new], end_of[new], end_of[old] = moved, old_end, new
                    start_at[old_end], start_at[new] = new, old
        end = here
    order, free, placed = [0] * n, {}, bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    for at in range(n):
        i = order[at] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            to = free.get(g, g)
            order[to], free[g], placed[i] = i, to + 1, 1
            i = smaller[i]
    return order


def _anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor over texts laid end to end: first and last window start, anchor place and hash."""
    none = np.zeros(0, np.int64)
    if len(data) < SHORT:
        return none, none, none, none.view(np.uint64)
    substrings = Substrings(data)
    at = np.arange(len(data) - CORE + 1)
    hashes = mix(substrings.between(at, at + CORE))
    mask = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~mask) | at.astype(np.uint64)
    width = SHORT - CORE + 1
    padded = np.full(-(-len(keys) // width) * width, ~np.uint64(0))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - SHORT + 1
    place = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & mask).astype(np.int64)
    ends = np.repeat(starts[1:], np.diff(starts))[:windows]
    whole = np.arange(windows) + SHORT <= ends  # the others cross into the next text
    new = np.ones(windows, bool)
    new[1:] = (place[1:] != place[:-1]) | (whole[1:] & ~whole[:-1])
    first = np.flatnonzero(new & whole)
    stop = new | ~whole
    stops = np.append(np.flatnonzero(stop), windows)
    last = stops[np.searchsorted(stops, first, "right")] - 1
    m = place[first]
    return first, last, m, hashes[m]


def occurrences_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """As _anchors, for documents of any length (long ones in overlapping pieces, a run cut by an edge joined); with the
    end of the bytes that a run's windows cover, within the document, and the hash of these bytes."""
    if len(data) <= PIECE:
        first, last, m, core = _anchors(data, starts)
    else:
        assert len(starts) == 2
        runs: list[list[int]] = []
        for p in range(0, len(data) - SHORT + 1, PIECE // 2):
            part = data[p : p + PIECE // 2 + SHORT - 1]
            for f, e, at, h in zip(*(x.tolist() for x in _anchors(part, np.array([0, len(part)])))):
                if runs and runs[-1][2] == at + p:
                    runs[-1][1] = e + p
                else:
                    runs.append([f + p, e + p, at + p, h])
        first, last, m, core = (np.array(x, t) for x, t in zip(zip(*runs), (np.int64, np.int64, np.int64, np.uint64)))
    stop = np.minimum(last + WINDOW, starts[np.searchsorted(starts, first, "right")])
    covered, a = np.empty(len(first), np.uint64), 0
    while a < len(first):  # a bounded stretch of bytes at once
        b = max(a + 1, int(np.searchsorted(stop, first[a] + PIECE, "right")))
        substrings = Substrings(data[first[a] : stop[b - 1]])
        covered[a:b] = substrings.between(first[a:b] - first[a], stop[a:b] - first[a])
        a = b
    shape = (m - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64) << np.uint64(16) | (stop - first).astype(np.uint64)
    return first, last, m, core, stop, mix(covered + mix(shape))


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's key: doc_id and 64 bits of a hash of its text; without doc_id, 60 bits of another hash stand for it."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    of_text = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.when(doc_id.isNull(), of_text).otherwise(doc_id).alias("id"), F.xxhash64(text).alias("sum"), text.alias("text"))


def occurrences(keyed: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(2))
            for a, b in pieces(starts, BATCH_BYTES):
                local = starts[a : b + 1] - starts[a]
                first, last, m, core, stop, covered = occurrences_of(data[starts[a] : starts[b]], local)
                row = np.searchsorted(local, first, "right") - 1
                at = local[row]
                rows = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(core.view(np.int64)), pa.array(covered.view(np.int64)),
                        *(pa.array((x - at).astype(np.int32)) for x in (first, last, m, stop)),
                    ],
                    names=["id", "sum", "core", "covered", "first", "last", "m", "stop"],
                )

    return keyed.select("id", "sum", "text").mapInArrow(work, "id long, sum long, core long, covered long, first int, last int, m int, stop int")


def repeated_windows(segments: list[tuple[bytes, int, int, int]]) -> dict[int, list[list[int]]]:
    """segments: the bytes, the anchor's place in them, the last window start, and a number for the anchor's bytes. By
    window length, SHORT and WINDOW: the window starts of each segment whose bytes also start elsewhere in these
    segments."""
    tails = [(number, data[m + CORE :]) for data, m, _, number in segments]
    rank = {tail: k for k, tail in enumerate(sorted(set(tails)))}
    text: list[int] = []
    starts = np.empty(len(segments), np.int64)
    for k, ((data, m, _, _), tail) in enumerate(zip(segments, tails)):
        starts[k] = len(text)
        text += [b + 2 for b in data[:m]]
        text += (300 + rank[tail], 1)
    text.append(0)
    order = np.array(suffix_array(text))
    k = np.searchsorted(starts, order, "right") - 1
    place = order - starts[k]
    usable = (place <= np.array([min(s[1], s[2]) for s in segments])[k]) & (order < len(text) - 1)
    found: dict[int, list[list[int]]] = {}
    for size in (SHORT, WINDOW):
        mine = found[size] = [[] for _ in segments]
        fits = usable & (place + size <= np.array([len(s[0]) for s in segments])[k])
        last, before = (-1, -1), None
        for s, p in zip(k[fits].tolist(), place[fits].tolist()):
            window = segments[s][3], segments[s][0][p : p + size]
            if window == before:
                if last[0] >= 0:
                    mine[last[0]].append(last[1])
                mine[s].append(p)
                last = (-1, -1)
            else:
                last = (s, p)
            before = window
    return found


def _runs(places: list[int], size: int) -> list[tuple[int, int]]:
    """Spans that windows of that size at these places cover."""
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], p + size))
        else:
            out.append((p, p + size))
    return out


def _sorted_segments(segments: DataFrame) -> DataFrame:
    """(core, covered, alone, m, last, bytes) to relative spans (core, covered, start, end, long) of the surroundings
    that occur once. Rows of an anchor are side by side; several anchors are sorted together."""
    schema = "core long, covered long, start int, end int, long boolean"

    def solve(rows: list[tuple]) -> pd.DataFrame:
        numbers: dict[int, int] = {}
        found = repeated_windows([(bytes(r[5]), r[3], r[4], numbers.setdefault(r[0], len(numbers))) for r in rows])
        out = [(r[0], r[1], a, b, size == WINDOW) for size, each in found.items() for r, places in zip(rows, each) if r[2] for a, b in _runs(places, size)]
        return pd.DataFrame(out, columns=["core", "covered", "start", "end", "long"]).astype({"core": "int64", "covered": "int64", "start": "int32", "end": "int32", "long": "bool"})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch[c] for c in ("core", "covered", "alone", "m", "last", "bytes"))):
                if size >= SORTED_AT_ONCE and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[3] + 2
        if rows:
            yield solve(rows)

    return segments.repartition("core").sortWithinPartitions("core", "covered").mapInPandas(work, schema)


def _cut_out(wanted: DataFrame) -> DataFrame:
    """Rows with text and segments array<struct<core, covered, alone, many, first, last, m, stop>> to the segments'
    bytes, with places from their start."""
    schema = "core long, covered long, alone boolean, many boolean, m int, last int, bytes binary"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, segments in zip(batch["text"], batch["segments"]):
                data = text.encode()
                for s in segments:
                    first = s["first"]
                    out.append((s["core"], s["covered"], s["alone"], s["many"], s["m"] - first, s["last"] - first, data[first : s["stop"]]))
            yield pd.DataFrame(out, columns=["core", "covered", "alone", "many", "m", "last", "bytes"])

    return wanted.mapInPandas(work, schema)


def _narrowed(segments: DataFrame) -> DataFrame:
    """Segments of anchors with very many surroundings, taken apart: (core, covered) of the narrow class, the
    segment it is from, the place of its bytes in there, the old anchor's place in them, and the bytes."""
    schema = "core long, covered long, from_core long, from_covered long, from_alone boolean, place int, m int, last int, bytes binary"

    def number(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"|".join(parts), digest_size=8).digest(), "little", signed=True)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for core, covered, alone, m, far, data in zip(*(batch[c] for c in ("core", "covered", "alone", "m", "last", "bytes"))):
                for size in (SHORT, WINDOW):
                    end = min(far, len(data) - size)
                    for kind in range((m - end) // STEP, m // STEP + 1) if end >= 0 else ():
                        first, last = max(0, m - (kind * STEP + STEP - 1)), min(end, m - kind * STEP)
                        shared = data[max(0, m - kind * STEP) : m - (kind * STEP + STEP - 1) + size]
                        own = data[first : last + size]
                        tag = b"%d %d %d" % (core, size, kind)
                        out.append((number(tag, shared), number(tag, b"%d %d" % (m - first, last - first), own), core, covered, alone, first, m - first, last - first, own))
            yield pd.DataFrame(out, columns=["core", "covered", "from_core", "from_covered", "from_alone", "place", "m", "last", "bytes"])

    return segments.mapInPandas(work, schema)


def _crowded(segments: DataFrame) -> DataFrame:
    """(core, covered, start, end, long) of the repeated windows in segments of anchors with very many surroundings, for
    those that occur once."""
    narrow = written(_narrowed(segments), "narrowed")
    anchors = written(narrow.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "narrow-anchors")
    again = narrow.join(anchors, "core")
    kinds = again.groupBy("core", "covered").agg(F.count("*").alias("n"), F.min(F.struct("m", "last", "bytes")).alias("one"))
    kinds = written(kinds, "narrow-surroundings")
    mixed = kinds.groupBy("core").agg(F.count("*").alias("distinct")).where("distinct > 1")
    each = kinds.join(mixed, "core").select("core", "covered", (F.col("n") == 1).alias("alone"), "one.m", "one.last", "one.bytes", "distinct")
    found = _sorted_segments(each.where(F.col("distinct") <= LARGE))
    by_hash = written(_windows(each.where(F.col("distinct") > LARGE)), "windows")
    twice = by_hash.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    more = by_hash.where("alone").join(twice, "hash").select("core", "covered", F.col("place").alias("start"), (F.col("place") + F.when(F.col("long"), WINDOW).otherwise(SHORT)).alias("end"), "long")
    whole = _both(kinds.where("n > 1").select("core", "covered", F.lit(0).alias("start"), F.col("one.last").alias("last"), F.length("one.bytes").alias("stop")), "core", "covered")
    spans = written(found.unionByName(more).unionByName(whole), "narrow-spans")
    back = narrow.where("from_alone").select("core", "covered", "from_core", "from_covered", "place").join(spans, ["core", "covered"])
    return back.select(F.col("from_core").alias("core"), F.col("from_covered").alias("covered"), (F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("end")).alias("end"), "long")


def _both(whole: DataFrame, *keys: str) -> DataFrame:
    """Of runs of windows (start, last, stop) that are repeated as a whole: what the windows of either length cover."""
    short = F.struct("start", (F.col("last") + SHORT).alias("end"), F.lit(False).alias("long"))
    long = F.struct("start", F.col("stop").alias("end"), F.lit(True).alias("long"))
    return whole.select(*keys, F.inline(F.when(F.col("stop") - F.col("start") >= WINDOW, F.array(short, long)).otherwise(F.array(short))))


def _windows(segments: DataFrame) -> DataFrame:
    """Of segments of anchors with very many: each window's hash, (core, covered, alone, place, long, hash)."""
    schema = "core long, covered long, alone boolean, place int, long boolean, hash binary"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for core, covered, alone, last, data in zip(*(batch[c] for c in ("core", "covered", "alone", "last", "bytes"))):
                size = len(data) - last
                for p in range(last + 1):  # STEP at most
                    out.append((core, covered, alone, p, size == WINDOW, hashlib.blake2b(data[p : p + size], digest_size=16).digest()))
            yield pd.DataFrame(out, columns=["core", "covered", "alone", "place", "long", "hash"])

    return segments.mapInPandas(work, schema)


def spans(docs: DataFrame) -> DataFrame:
    """(id, sum, spans): of each document with repeated bytes, array<struct<start, end, long>> that may overlap; long
    ones are covered by repeated strings of WINDOW bytes, the others by ones of SHORT bytes."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    every = written(occurrences(keyed), "occurrences")
    cores = written(every.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "anchors")
    again = written(every.join(cores, "core"), "repeated-anchors")
    place = F.struct("id", "sum", "first", "last", "m", "stop")
    kinds = again.groupBy("core", "covered").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    kinds = written(kinds, "surroundings")
    mixed = kinds.groupBy("core").agg(F.count("*").alias("distinct")).where("distinct > 1")
    # Surroundings that occur once and have no other kind beside them can't be: their anchor occurs twice.
    wanted = (
        kinds.join(mixed, "core")
        .groupBy("at.id", "at.sum")
        .agg(F.collect_list(F.struct("core", "covered", (F.col("n") == 1).alias("alone"), (F.col("distinct") > LARGE).alias("many"), "at.first", "at.last", "at.m", "at.stop")).alias("segments"))
    )
    texts = keyed.select("id", "sum", "text").dropDuplicates(["id", "sum"]) if _repeats(keyed) else keyed.select("id", "sum", "text")
    cut = written(_cut_out(texts.join(wanted, ["id", "sum"]).select("text", "segments")), "segments")
    found = _sorted_segments(cut.where("NOT many").select("core", "covered", "alone", "m", "last", "bytes"))
    more = _crowded(cut.where("many").select("core", "covered", "alone", "m", "last", "bytes"))
    partly = written(found.unionByName(more), "partly-repeated")
    whole = _both(again.join(kinds.where("n > 1").select("core", "covered"), ["core", "covered"]).select("id", "sum", F.col("first").alias("start"), "last", "stop"), "id", "sum")
    parts = partly.join(kinds.where("n = 1").select("core", "covered", "at"), ["core", "covered"]).select("at.id", "at.sum", (F.col("at.first") + F.col("start")).alias("start"), (F.col("at.first") + F.col("end")).alias("end"), "long")
    return whole.unionByName(parts).groupBy("id", "sum").agg(F.collect_list(F.struct("start", "end", "long")).alias("spans"))


def _repeats(keyed: DataFrame) -> bool:
    return not keyed.groupBy("id").count().where("count > 1").limit(1).isEmpty()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def strip(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, n_repeated and n_repeats (bytes and maximal runs covered by
    repeated strings of SHORT bytes, most of them kept), removed (the maximal runs that go) and kept (the bytes left)."""
    removed = written(spans(docs), "spans")
    joined = _keyed(docs).join(removed, ["id", "sum"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, n_repeats long, removed array<struct<start:int,end:int>>, kept binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = ["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "n_repeats"]
        kinds = pa.schema([*((n, pa.int64()) for n in numbers), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])
        for batch in batches:
            data, starts = utf8(batch.column(1))
            for a, b in pieces(starts, BATCH_BYTES):
                out = []
                for i in range(a, b):
                    own = data[starts[i] : starts[i + 1]].tobytes()
                    found = batch.column(2)[i].as_py() or ()
                    gone = _merged([(s["start"], s["end"]) for s in found if s["long"]])
                    seen = _merged([(s["start"], s["end"]) for s in found if not s["long"]])
                    edges = [0, *(x for s in gone for x in s), len(own)]
                    kept = b"".join(own[p:q] for p, q in zip(edges[::2], edges[1::2]))
                    out.append((batch.column(0)[i].as_py(), len(own), len(own) - len(kept), len(gone), sum(q - p for p, q in seen), len(seen), [{"start": p, "end": q} for p, q in gone], kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return joined.mapInArrow(work, schema)


def digests(docs: DataFrame) -> DataFrame:
    return strip(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated", "n_repeats")
