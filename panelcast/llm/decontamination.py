"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII bytes. A window is `window` consecutive words
of an item; an item with fewer words is one window as a whole. The automaton's letters are words, not characters: each
distinct word of the items has a code, and a document is read once as the string of its words' codes, with one code for
all words that no item has. It reports every window that ends at a word; the words inside are hit, and runs of hit
words are mapped back to code-point offsets in the original text.

The items reach the tasks by broadcast, in pieces of at most `piece` windows. What is broadcast at once is bounded by
`block_windows`: the windows are counted first, and a larger benchmark is dealt by hash into several blocks. The text
is then scanned once for each block; hits of the blocks meet by a digest of the text (only hit texts are shuffled, equal
ones once), and are joined back to all rows.

Null and empty texts have no words and no hits. Repeated rows are answered one by one, a null doc_id included. Items
with the same item_id count once; a null item_id counts as ''. Items without words have no window. Other columns are
not read. An empty benchmark leaves every document clean, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, small_batches

#: A word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same rule for UTF-8 bytes: lower-cased, and a space where no word goes on.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Code of words that no item has, and the first code of those that one has (beyond the surrogates).
OTHER, FIRST = "\0", 0x10000


@dataclass(frozen=True)
class Settings:
    window: int = 10
    piece: int = 1_000
    block_windows: int = 200_000


class Windows:
    """The automaton of one block of items, given as (item_id, words) pieces."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        import ahocorasick

        self.codes: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, words in pieces:
            coded = "".join([self.codes.setdefault(w, chr(FIRST + len(self.codes))) for w in words])
            for i in range(max(len(words) - window, 0) + 1):
                owners.setdefault(coded[i : i + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for coded, items in owners.items():
            self.automaton.add_word(coded, (len(coded), items))
        self.empty = not owners
        self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (end exclusive) of all occurrences, and the items that have them."""
        if self.empty:
            return [], set()
        code, ranges, items = self.codes.get, [], set()
        for end, (n, owners) in self.automaton.iter("".join([code(w, OTHER) for w in words])):
            ranges.append((end + 1 - n, end + 1))
            items |= owners
        return ranges, items


_BUILT: dict[str, Windows] = {}


def _windows(block: tuple, window: int) -> Windows:
    """The automaton of a broadcast block, once in each Python worker; that of another block makes room for it."""
    name, pieces_ = block
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(pieces_.value, window)
    return _BUILT[name]


def merged(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Disjoint, maximal ranges that cover the same words, as rows (start, end) in order."""
    if not len(ranges):
        return np.zeros((0, 2), np.int64)
    r = np.array(ranges, np.int64)
    r = r[np.argsort(r[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    new = np.r_[True, r[1:, 0] > reach[:-1]]
    return np.c_[r[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(r) - 1]]]


def offsets(raw: bytes, runs: np.ndarray) -> list[dict[str, int]]:
    """Code-point offsets in the original text of runs of words."""
    word = np.frombuffer(raw.translate(TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    starts, ends = points[edges[::2]], points[edges[1::2]]
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in runs]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False)
RANGES = T.ArrayType(T.ArrayType(T.LongType(), False), False)
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType(), False)), T.StructField("spans", SPANS)]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _reports(ids: pa.Array, rows: list) -> pa.RecordBatch:
    """Rows of (words, ranges, items, raw) as doc_id and FOUND."""
    out = []
    for n, ranges, items, raw in rows:
        runs = merged(ranges)
        out.append((n, int((runs[:, 1] - runs[:, 0]).sum()), sorted(items), offsets(raw, runs) if len(runs) else []))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["doc_id", *(f.name for f in FOUND)])


def pieces(benchmark: DataFrame, how: Settings = Settings()) -> DataFrame:
    """item_id string, words array, windows long: parts of items that overlap by a window less one word."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - how.window, F.lit(0))
    part = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.floor(last / how.piece).cast("int"))).alias("part"))
    cut = part.select("item_id", "part", F.slice("words", F.col("part") * how.piece + 1, how.piece + how.window - 1).alias("words"))
    return cut.withColumn("windows", F.greatest(F.size("words") - how.window + 1, F.lit(1)).cast("long"))


def _blocks(benchmark: DataFrame, how: Settings) -> list:
    """Names and broadcast lists of (item_id, words), each of about how.block_windows windows; at least one, maybe
    empty. The driver holds one list at a time."""
    spark, parts = benchmark.sparkSession, pieces(benchmark, how)
    total = parts.agg(F.sum("windows")).first()[0] or 0
    n = max(1, -(-total // how.block_windows))
    out = []
    for b in range(n):
        mine = parts.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(n)) == b).select("item_id", "words").collect()
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast([(r["item_id"], [w.encode() for w in r["words"]]) for r in mine])))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, how: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items array<string> (in order), spans array<struct<start, end>>
    (hit runs as code points of the original text, end exclusive)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *FOUND])
    blocks, window = _blocks(benchmark, how), how.window
    if len(blocks) == 1:
        only = blocks[0]

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _windows(only, window)
            for batch in batches:
                found = []
                for raw in _texts(batch.column(1)):
                    words = raw.translate(TABLE).split()
                    found.append((len(words), *windows.find(words), raw))
                yield _reports(batch.column(0), found)

        return rows.mapInArrow(whole, schema)
    hits = None
    for k, block in enumerate(blocks):
        part = rows.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text").mapInArrow(_finder(block, window), T.StructType([T.StructField("digest", T.StringType()), T.StructField("ranges", RANGES), T.StructField("items", FOUND[2].dataType)])).withColumn("block", F.lit(k))
        hits = part if hits is None else hits.unionByName(part)
    once = hits.groupBy("digest", "block").agg(F.first("ranges").alias("ranges"), F.first("items").alias("items"))
    together = once.groupBy("digest").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).join(together, "digest", "left").select("doc_id", "text", "ranges", "items")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield _reports(batch.column(0), [(len(raw.translate(TABLE).split()), ranges or [], items or [], raw) for raw, ranges, items in found])

    return joined.mapInArrow(report, schema)


def _finder(block, window: int):
    """A function of batches (digest, text) to the rows of those that this block of items hits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(block, window)
        for batch in batches:
            digests, ranges, items = [], [], []
            for digest, raw in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                found, owners = windows.find(raw.translate(TABLE).split())
                if found:
                    digests.append(digest)
                    ranges.append(merged(found).tolist())
                    items.append(sorted(owners))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(ranges, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], names=["digest", "ranges", "items"])

    return work


def digests(docs: DataFrame, benchmark: DataFrame, how: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 of the items joined by commas, contaminated, and spans."""
    return scan(docs, benchmark, how).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


_LOWER = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + WORD + "')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_LOWER.format('text')} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_LOWER.format('text')} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x
      FROM (SELECT item_id, unnest(list_transform(range(greatest(len(w) - 10, 0) + 1), lambda i: w[i + 1 : i + 10])) AS x FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS x
      FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, s.n, i FROM s JOIN v USING (x, n)),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM h),
r AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS z FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p) GROUP BY doc_id, run),
e AS (SELECT doc_id, i, 1 + sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS z, length(word) AS n
      FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word, unnest(g[1 : len(w)]) AS gap
            FROM (SELECT doc_id, w, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS g FROM d WHERE doc_id IN (SELECT doc_id FROM p)))),
o AS (SELECT r.doc_id, string_agg((x.z - x.n)::BIGINT || ':' || y.z::BIGINT, ',' ORDER BY r.a) AS spans, sum(r.z - r.a) AS n_hit
      FROM r JOIN e AS x ON x.doc_id = r.doc_id AND x.i = r.a JOIN e AS y ON y.doc_id = r.doc_id AND y.i = r.z - 1 GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)
"""
