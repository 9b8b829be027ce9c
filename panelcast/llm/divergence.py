"""Source divergence audit: how far the word counts of sources of one language lie apart.

Counts become whole-number rates p = 1 + floor(1e9 * (count + 1) / (N + V)) for V kept terms and N occurrences of them,
and f = floor((p - q)^2 / q) tells how far a group's p lies from another's q. For two sources of a language, f summed
over all kept terms depends only on the joint table of their counts: how many terms have count a here and b there.

All joint tables come from products of one-hot level columns. The terms of a language are dealt by hash into blocks of
about `cells` (term, source) cells. Within a block each pair of (source, count level), level 0 included, is an indicator
column over the block's terms; the columns times their transpose, in tiles of at most about `columns` columns and
`terms` rows, give all joint tables of the tile. Their entries are whole numbers below 2^24, so the products of single
precision are exact; the entries above 0 are priced by f in 64-bit integers. Blocks give one partial sum for each pair
of sources, which Spark adds. Terms are taken in order of their total counts, so that the many rare ones, with few
levels, share large tiles.

Words are counted in the scan, batch by batch, so what is shuffled follows vocabulary and not text. A language's list
of sources goes to each of its blocks; memory and output of a block grow with the square of the number of sources, as
the result does. Nothing is collected.

Null text, lang and source are ''. Every row is a document, repeated ones and null doc_ids too. A group without kept
terms has no rows of part `term`, and a pair value by the rates of absent terms; a language without kept terms has pair
values of 0, one with a single source no pairs. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written

#: Rule of terms for UTF-8 bytes: A-Z lower-cased, a space where no term goes on.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    least_documents: int = 3
    top: int = 200
    cells: int = 200_000
    columns: int = 1_024
    terms: int = 4_096
    #: Distinct terms that a task holds before it passes its counts on.
    held: int = 200_000


def _counting(how: Settings):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def given() -> pa.RecordBatch:
            lang, source, term, n, documents = [], [], [], [], []
            for (a, b), (words, seen) in counts.items():
                size = len(words) + 1  # the last row is the group's own
                lang += [a] * size
                source += [b] * size
                term += [*words, None]
                n += [*words.values(), 0]
                documents += [*map(seen.__getitem__, words), 0]
            counts.clear()
            # Views of bytes as text: nothing is decoded, so that odd bytes do no harm.
            texts = [pa.array(c, pa.binary()).view(pa.string()) for c in (lang, source, term)]
            return pa.RecordBatch.from_arrays([*texts, pa.array(n, pa.int64()), pa.array(documents, pa.int64())], names=["lang", "source", "term", "n", "documents"])

        for batch in batches:
            for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns)):
                words, documents = counts.setdefault((lang or b"", source or b""), (Counter(), Counter()))
                found = (text or b"").translate(TABLE).split()
                words.update(found)
                documents.update(set(found))
            if sum(len(words) for words, _ in counts.values()) >= how.held:
                yield given()
        yield given()

    return work


def term_counts(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """lang, source, term, n (occurrences), documents; a row with a null term for each group."""
    small_batches(docs.sparkSession)
    columns = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    parts = columns.mapInArrow(_counting(how), "lang string, source string, term string, n long, documents long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _rate(count: str, of: str, terms: str) -> Column:
    return F.expr(f"1 + (cast({SCALE} AS decimal(12,0)) * cast({count} + 1 AS decimal(20,0))) div nullif({of} + {terms}, 0)")


def joint_values(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], zero: np.ndarray, terms: int, order: np.ndarray, widest: np.ndarray, how: Settings) -> np.ndarray:
    """Sums of f over a block's terms, for each pair of its sources. levels: of each source, its terms (numbers below
    `terms`), their counts and their rates; zero: each source's rate of an absent term; order: the terms by total count;
    widest: these totals, which bound the count levels."""
    sources, place = len(levels), np.empty(terms, np.int64)
    place[order] = np.arange(terms)
    ranked = []
    for which, counts, rates in levels:
        at = place[which]
        by = np.argsort(at)
        ranked.append((at[by], counts[by], rates[by]))
    out = np.zeros((sources, sources), np.int64)
    tile = min(sources, max(how.columns // 4, 1))
    start = 0
    while start < terms:
        most = how.columns // tile - 1
        small = int(np.searchsorted(widest, most, side="right"))
        stop = min(terms, start + how.terms, small if small > start else start + max(most, 1))
        sides = [_columns(ranked[a : a + tile], zero[a : a + tile], start, stop) for a in range(0, sources, tile)]
        for i, (x, of_x, p) in enumerate(sides):
            for j, (y, of_y, q) in enumerate(sides):
                table = x.T @ y
                a, b = np.nonzero(table)
                price = (p[a] - q[b]) ** 2 // q[b]
                np.add.at(out, (i * tile + of_x[a], j * tile + of_y[b]), price * table[a, b].astype(np.int64))
        start = stop
    return out


def _columns(levels, zero: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicators (terms by columns), and each column's source and rate, for the terms from start to stop."""
    codes, rates, owners, cells, width = [], [], [], [], 0
    for g, (at, counts, p) in enumerate(levels):
        a, b = np.searchsorted(at, (start, stop))
        distinct, first, code = np.unique(counts[a:b], return_index=True, return_inverse=True)
        cells.append((at[a:b] - start, width + 1 + code, width))
        rates.append(np.r_[zero[g], p[a:b][first]])
        owners.append(np.full(len(distinct) + 1, g))
        width += len(distinct) + 1
    x = np.zeros((stop - start, width), np.float32)
    for rows, columns, absent in cells:
        x[:, absent] = 1
        x[rows, absent] = 0
        x[rows, columns] = 1
    return x, np.concatenate(owners), np.concatenate(rates)


def _block_values(how: Settings):
    """Of a block's rows (lang, block, source, term, n, total, p; null term: a source and its rate of absent terms), lang,
    source, item, value."""

    def work(table: pa.Table) -> pa.Table:
        absent = table.filter(pc.is_null(table["term"]))
        sources = absent["source"].cast(pa.binary()).to_pylist()
        number = {s: i for i, s in enumerate(sources)}
        cells = table.filter(pc.is_valid(table["term"]))
        code = cells["term"].cast(pa.binary()).combine_chunks().dictionary_encode()
        which = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.fromiter((number[s] for s in cells["source"].cast(pa.binary()).to_pylist()), np.int64, len(cells))
        counts, rates, totals = (cells[c].to_numpy() for c in ("n", "p", "total"))
        terms = len(code.dictionary)
        total = np.zeros(terms, np.int64)
        total[which] = totals
        order = np.argsort(total, kind="stable")
        by = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[by], np.arange(len(sources) + 1))
        levels = [(which[by[a:b]], counts[by[a:b]], rates[by[a:b]]) for a, b in zip(ends, ends[1:])]
        values = joint_values(levels, absent["p"].to_numpy(), terms, order, total[order], how)
        own, other = np.nonzero(~np.eye(len(sources), dtype=bool))
        names = pa.array(sources, pa.binary()).view(pa.string())
        lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(own), np.int32)), absent["lang"].combine_chunks().slice(0, 1)).dictionary_decode()
        return pa.table({"lang": lang, "source": names.take(pa.array(own)), "item": names.take(pa.array(other)), "value": values[own, other]})

    return work


def audit(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows hold f summed over all kept terms against each other source of
    the language, `term` rows the terms that a source has more often than its language, with f against the language."""
    cells = written(term_counts(docs, how), "term-counts")
    occurring = cells.where("term IS NOT NULL")
    totals = occurring.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents")).where(F.col("documents") >= how.least_documents).drop("documents")
    kept = written(occurring.drop("documents").join(totals, ["lang", "term"]), "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("lang_n"))
    terms = kept.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    names = cells.where("term IS NULL").select("lang", "source")
    groups = written(
        names.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(of_lang.join(terms, "lang"), "lang", "left").na.fill(0, ["group_n", "cells", "lang_n", "terms"]),
        "divergence-groups",
    )
    blocks = F.greatest(F.ceil(F.col("cells") / how.cells), F.lit(1)).cast("int")
    rated = kept.join(groups, ["lang", "source"]).withColumn("p", _rate("n", "group_n", "terms"))
    own = rated.select("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "source", "term", "n", "total", "p")
    everywhere = groups.select("lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.coalesce(_rate("0", "group_n", "terms"), F.lit(1)).alias("p"))
    parts = own.unionByName(everywhere).groupBy("lang", "block").applyInArrow(_block_values(how), "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    more = rated.withColumn("q", _rate("total", "lang_n", "terms")).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", place).unionByName(more.withColumn("part", F.lit("term")).withColumn("rank", place).where(F.col("rank") <= how.top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


SQL = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
k AS (SELECT lang, source, term, count(*) AS c FROM w JOIN t USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM t GROUP BY 1),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN k USING (lang, source) GROUP BY 1, 2),
p AS (SELECT n.lang, n.source, t.term, coalesce(k.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(k.c, 0) + 1)) // (n.n + v.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (t.c + 1)) // (v.n + v.v)::HUGEINT AS q
      FROM n JOIN t USING (lang) JOIN v USING (lang) LEFT JOIN k ON k.lang = n.lang AND k.source = n.source AND k.term = t.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
