"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions.

The leaves of a tree (by default domain, language, source) hold documents; every node has a weight among its
siblings. A token budget goes down the tree: at each node it is filled into the children in proportion to their
weights, none beyond what its subtree can give (its tokens times max_epochs). What a short child leaves goes to its
siblings first; only what the whole subtree can't take is left to the siblings of its parent, and so on up. Within a
leaf, documents are taken in epochs: whole epochs first, and of the next one the longest prefix, in an order seeded
by (seed, epoch, doc_id), that stays within the leaf's tokens.

Sizes: the tree is counted with partial aggregation and has a row per leaf. The prefix of a leaf is found by sums
over 4,096 ranges of the order key; only the one range that holds the cut is sorted, so that a leaf with a third of
all rows needs no large task. Texts are not shuffled.

Null or empty text has no tokens; such documents go with any whole epoch and with a prefix that reaches them. A null
level counts as the empty name. Rows without doc_id are ordered under the empty id; repeated rows are documents of
their own. If there are no tokens at all, nothing is taken. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

RANGES = 4096


@dataclass(frozen=True)
class Mixture:
    """budget: tokens per 1,000 tokens of input; levels: (name, column, weight) from the root down, as SQL."""

    budget_per_mille: int = 800
    max_epochs: int = 2
    seed: int = 17
    levels: tuple[tuple[str, str, str], ...] = (
        ("domain", "concat('domain', coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS INT), 0) % 4)", "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 ELSE 2 END"),
        ("language", "coalesce(lang, '')", "CASE language WHEN 'en' THEN 5 WHEN '' THEN 1 ELSE 3 END"),
        ("source_name", "coalesce(source, '')", "CASE WHEN source_name = '' THEN 1 ELSE 2 END"),
    )

    def names(self) -> list[str]:
        return [name for name, _, _ in self.levels]


def n_tokens(text: Column) -> Column:
    """Words, as what stands between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _with_levels(docs: DataFrame, how: Mixture) -> DataFrame:
    return docs.select("doc_id", "text", *[F.expr(sql).alias(name) for name, sql, _ in how.levels])


def _order(epoch: Column, how: Mixture) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(how.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _range(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def budgets(counted: DataFrame, how: Mixture) -> DataFrame:
    """(levels…, n_tokens) to one row per leaf: leaf_tokens, target, whole epochs, next epoch, and the rest for it."""
    names = how.names()
    leaves = counted.groupBy(*names).agg(F.sum("n_tokens").alias("leaf_tokens"))
    leaves = written(leaves, "leaves")  # a row per leaf from here on
    leaves = leaves.withColumns({f"w_{name}": F.expr(weight).cast("double") for name, _, weight in how.levels})
    whole = F.sum("leaf_tokens").over(Window.partitionBy(F.lit(0)))
    leaves = leaves.withColumn("given", (F.floor(whole * how.budget_per_mille / 1000)).cast("double"))
    for k, name in enumerate(names):
        parent, node = names[:k], names[: k + 1]
        over_parent = Window.partitionBy(F.lit(0), *parent)
        children = leaves.groupBy(*node).agg((F.sum("leaf_tokens") * how.max_epochs).cast("double").alias("can"), F.max(f"w_{name}").alias("w"), F.max("given").alias("given"))
        ordered = over_parent.orderBy(F.try_divide("can", "w").asc_nulls_last(), *node)
        before = F.coalesce(F.sum("can").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        from_here = F.sum("w").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        children = children.withColumn("full", (F.col("w") > 0) & ((F.col("given") - before) * F.col("w") >= F.col("can") * from_here))
        left = F.col("given") - F.sum(F.when(F.col("full"), F.col("can")).otherwise(0.0)).over(over_parent)
        open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(over_parent)
        share = F.when(F.col("full"), F.col("can")).otherwise(F.coalesce(F.try_divide(left * F.col("w"), open_weight), F.lit(0.0)))
        leaves = leaves.drop("given").join(children.select(*node, share.alias("given")), node)
    target = F.floor(F.col("given") + 1e-6).cast("long")
    full = F.coalesce(F.floor(F.try_divide(target, F.col("leaf_tokens"))), F.lit(0)).cast("int")
    return leaves.select(*names, "leaf_tokens", target.alias("target"), full.alias("full_epochs"), (target - full * F.col("leaf_tokens")).alias("rest"))


def plan(docs: DataFrame, how: Mixture = Mixture()) -> tuple[DataFrame, DataFrame]:
    """The leaves' plan and the count table (doc_id, levels…, n_tokens). The plan adds to budgets() the cut: ranges
    below cut_range are in the prefix, room is what is left of the rest for the range at the cut."""
    names = how.names()
    counted = written(_with_levels(docs, how).select("doc_id", *names, n_tokens(F.col("text")).alias("n_tokens")), "token-counts")
    leaves = written(budgets(counted, how), "leaf-budgets")
    sums = (
        counted.join(leaves.select(*names, "full_epochs"), names)
        .groupBy(*names, _range(_order(F.col("full_epochs"), how)).alias("range")).agg(F.sum("n_tokens").alias("in_range"))
    )
    reach = F.sum("in_range").over(Window.partitionBy(*names).orderBy("range"))
    cut = (
        sums.withColumn("reach", reach).join(leaves, names)
        .where(F.col("reach") <= F.col("rest"))
        .groupBy(*names).agg(F.max("range").alias("last"), F.max("reach").alias("used"))
    )
    # The range at the cut is the first one after `last` that holds documents.
    first_out = sums.withColumn("reach", reach).join(leaves, names).where(F.col("reach") > F.col("rest")).groupBy(*names).agg(F.min("range").alias("cut_range"))
    out = leaves.join(cut, names, "left").join(first_out, names, "left").select(
        *names, "leaf_tokens", "target", "full_epochs",
        F.coalesce("cut_range", F.lit(RANGES)).alias("cut_range"),
        (F.col("rest") - F.coalesce("used", F.lit(0))).alias("room"),
    )
    return written(out, "leaf-plan"), counted


def _at_cut(counted: DataFrame, leaves: DataFrame, how: Mixture) -> DataFrame:
    """The documents in the ranges at the cuts, with whether the prefix reaches them."""
    names = how.names()
    key = _order(F.col("full_epochs"), how)
    here = counted.join(leaves, names).withColumn("key", key).where(_range(F.col("key")) == F.col("cut_range"))
    reach = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return here.withColumn("more", (reach <= F.col("room")).cast("int"))


def copies(docs: DataFrame, how: Mixture = Mixture()) -> DataFrame:
    """One row per document: doc_id, levels…, n_tokens, target (of its leaf) and copies (how often it is taken)."""
    names = how.names()
    leaves, counted = plan(docs, how)
    at = _range(_order(F.col("full_epochs"), how))
    clear = counted.join(leaves, names).where(at != F.col("cut_range")).withColumn("more", (at < F.col("cut_range")).cast("int"))
    both = clear.select(*counted.columns, "target", "full_epochs", "more").unionByName(_at_cut(counted, leaves, how).select(*counted.columns, "target", "full_epochs", "more"))
    some = F.col("target") > 0
    return both.select("doc_id", *names, "n_tokens", "target", F.when(some, F.col("full_epochs") + F.col("more")).otherwise(0).alias("copies"))


def mixed(docs: DataFrame, how: Mixture = Mixture()) -> DataFrame:
    """The documents taken, all their columns, once for each epoch that takes them. Of the texts, only the documents
    in the ranges at the cuts (about one in 4,096) are joined with a decision; the others are filtered in place."""
    names = how.names()
    leaves, counted = plan(docs, how)
    keys = [f"__{name}" for name in names]
    planned = leaves.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("target").alias("__target"), F.col("full_epochs").alias("__full"), F.col("cut_range").alias("__cut"))
    placed = docs.withColumns({k: F.expr(sql) for k, (_, sql, _) in zip(keys, how.levels)}).join(planned, keys)
    placed = placed.where(F.col("__target") > 0).withColumn("__at", _range(_order(F.col("__full"), how)))
    clear = placed.where(F.col("__at") != F.col("__cut")).withColumn("__n", F.col("__full") + (F.col("__at") < F.col("__cut")).cast("int"))
    # Repeated rows at a cut share the count of their doc_id and size: the least of them.
    decided = _at_cut(counted, leaves, how).groupBy(F.col("doc_id").alias("__id"), F.col("n_tokens").alias("__size")).agg(F.min("more").alias("__more"))
    there = placed.where(F.col("__at") == F.col("__cut")).withColumn("__words", n_tokens(F.col("text")))
    cut = there.join(decided, there["doc_id"].eqNullSafe(decided["__id"]) & (there["__words"] == decided["__size"])).withColumn("__n", F.col("__full") + F.col("__more"))
    every = clear.select(*docs.columns, "__n").unionByName(cut.select(*docs.columns, "__n")).where("__n > 0")
    return every.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def _sql(how: Mixture = Mixture()) -> str:
    names = how.names()
    levels = how.levels
    ctes = [
        "d AS (SELECT doc_id, " + ", ".join(f"{sql} AS {name}" for name, sql, _ in levels) + r", len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents)",
        f"l0 AS (SELECT {', '.join(names)}, sum(n_tokens)::BIGINT AS leaf_tokens, " + ", ".join(f"max({w})::DOUBLE AS w_{name}" for name, _, w in levels) + f", floor(sum(sum(n_tokens)) OVER () * {how.budget_per_mille} / 1000)::DOUBLE AS given FROM d GROUP BY {', '.join(names)})",
    ]
    for k, name in enumerate(names):
        node, parent = ", ".join(names[: k + 1]), ", ".join(["1", *names[:k]])
        part = f"PARTITION BY {parent}"
        order = f"{part} ORDER BY can / nullif(w, 0) NULLS LAST, {node}"
        ctes += [
            f"c{k} AS (SELECT {node}, (sum(leaf_tokens) * {how.max_epochs})::DOUBLE AS can, max(w_{name}) AS w, max(given) AS given FROM l{k} GROUP BY {node})",
            f"f{k} AS (SELECT *, w > 0 AND (given - coalesce(sum(can) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w >= can * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM c{k})",
            f"g{k} AS (SELECT {node}, CASE WHEN is_full THEN can ELSE coalesce((given - sum(CASE WHEN is_full THEN can ELSE 0 END) OVER ({part})) * w / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}), 0), 0) END AS given FROM f{k})",
            f"l{k + 1} AS (SELECT l{k}.* EXCLUDE (given), g{k}.given FROM l{k} JOIN g{k} USING ({node}))",
        ]
    last = len(names)
    keys = ", ".join(names)
    ctes += [
        f"t AS (SELECT *, floor(given + 1e-6)::BIGINT AS target FROM l{last})",
        "u AS (SELECT *, CASE WHEN leaf_tokens = 0 THEN 0 ELSE target // leaf_tokens END AS full_epochs FROM t)",
        f"o AS (SELECT d.*, target, full_epochs, target - full_epochs * leaf_tokens AS rest, md5('{how.seed}:' || full_epochs || ':' || doc_id) AS k FROM d JOIN u USING ({keys}))",
        f"p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS more FROM o)",
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, {keys}, n_tokens, target, CASE WHEN target > 0 THEN full_epochs + more::INT ELSE 0 END AS copies FROM p"


SQL = _sql()
