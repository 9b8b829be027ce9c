r"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three kinds of candidates are found by pattern (leftmost, not overlapping, per kind; letters of the key in either
case): `assign`, a key word with a value of 6 or more characters; `access`, an access key id of 20 or more; `hex`, 24
or more hex digits. The secret itself (the value) is hashed, and each hash is counted over the corpus: in how many
repositories and by how many owners does it occur? A value of one owner in few repositories looks like that owner's
live credential; one that several owners carry is a copied example. Live values get a further span of kind `live`
(the value alone), so the spans of a document are its base spans and the live ones.

Positions count code points, the end is exclusive. Null text counts as empty. Rows without owner or repository are
counted under the empty name. Rows may repeat: each is scanned, and repeats don't add owners. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

#: Kind, pattern, group that holds the secret, its least length, in the order of the contract.
KINDS = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Runs of hex digits are everywhere; only long enough ones are looked for first.
LEAST = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: A value is live if one owner has it, in at most this many repositories.
LIVE_REPOSITORIES = 1

FOUND = "array<struct<gap:int,size:int,secret:int,hash:string>>"


def _found(text: Column, kind: str) -> Column:
    """The kind's matches, each with the length of the gap before it, its own, the secret's, and the secret's hash."""
    _, pattern, group, _ = next(k for k in KINDS if k[0] == kind)
    p = F.lit(pattern)
    parts = F.split(text, pattern, -1)
    whole, value = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    one = F.transform(
        F.arrays_zip(F.slice(parts, F.lit(1), F.size(whole)).alias("gap"), whole.alias("all"), value.alias("value")),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"),
            F.length(x["all"]).alias("size"),
            F.length(x["value"]).alias("secret"),
            F.sha2(x["value"], 256).alias("hash"),
        ),
    )
    return F.when(text.rlike(LEAST[kind]), one).otherwise(F.array().cast(FOUND)).cast(FOUND)


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied and most_owners (the
    largest number of owners that one of its values has).

    repository and owner are columns of docs; by default, the source owns, and each of its languages is a repository.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    owner = name(F.col("source")) if owner is None else name(owner)
    repository = F.concat_ws("/", name(F.col("source")), name(F.col("lang"))) if repository is None else name(repository)
    text = F.coalesce(F.col("text"), F.lit(""))
    # Secrets are kept as hashes only. The row number is fixed by being written.
    rows = written(
        docs.select("doc_id", owner.alias("owner"), repository.alias("repository"), *[_found(text, k).alias(k) for k, *_ in KINDS])
        .withColumn("row", F.monotonically_increasing_id()),
        "secret-matches",
    )
    each = None
    for order, (kind, _, _, least) in enumerate(KINDS):
        part = rows.select(
            "row", "owner", "repository", F.lit(kind).alias("kind"), F.lit(order).alias("kind_order"), F.lit(least).alias("least"), F.posexplode(kind).alias("i", "m")
        )
        each = part if each is None else each.unionByName(part)
    before = Window.partitionBy("row", "kind_order").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(before).cast("int")
    spans = written(
        each.withColumn("end", end)
        .where(F.col("m.secret") >= F.col("least"))
        .select("row", "owner", "repository", "kind", "kind_order", (F.col("end") - F.col("m.size")).alias("start"), "end", (F.col("end") - F.col("m.secret")).alias("secret_start"), F.col("m.hash").alias("hash")),
        "secret-spans",
    )
    # Ownership frequency: repeats within a repository go before the shuffle, so a secret in a third of all rows
    # reaches the count as one row for each repository and task.
    frequency = (
        spans.select("hash", "owner", "repository").distinct()
        .groupBy("hash", "owner").agg(F.count("*").alias("n"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    )
    # A hash is looked up once per row and value, not by every copy in one task: the adaptive skew join splits it.
    judged = spans.join(frequency, "hash").withColumn("live", (F.col("owners") == 1) & (F.col("repositories") <= LIVE_REPOSITORIES))
    text_of = lambda kind, start: F.concat_ws(":", kind, start.cast("string"), F.col("end").cast("string"))
    live = judged.where("live").select("row", F.col("secret_start").alias("start"), F.lit(len(KINDS)).alias("kind_order"), "end", text_of(F.lit("live"), F.col("secret_start")).alias("span")).distinct()
    span = F.struct("start", "kind_order", "end", "span")
    base = judged.groupBy("row").agg(
        *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k, *_ in KINDS],
        F.collect_list(F.struct("start", "kind_order", "end", text_of(F.col("kind"), F.col("start")).alias("span"))).alias("base"),
        F.sum(F.when(F.col("live"), 1).otherwise(0)).alias("n_live"),
        F.sum(F.when(F.col("live"), 0).otherwise(1)).alias("n_copied"),
        F.max("owners").alias("most_owners"),
    )
    added = live.groupBy("row").agg(F.collect_list(span).alias("added"))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x["span"]), ",")
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,span:string>>")
    out = rows.select("row", "doc_id").join(base, "row", "left").join(added, "row", "left")
    base_spans, more = F.coalesce("base", none), F.coalesce("added", none)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(T.LongType()).alias(c)
    return out.select(
        "doc_id",
        *[count(f"n_{k}") for k, *_ in KINDS],
        F.sha2(joined(base_spans), 256).alias("base_sha256"),
        joined(F.concat(base_spans, more)).alias("spans"),
        count("n_live"),
        count("n_copied"),
        count("most_owners"),
    )


def _sql() -> str:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, owner, repository, '{kind}' AS kind, {order} AS kind_order, {least} AS least,
            unnest(range(len(m))) + 1 AS i, unnest(m) AS whole, unnest(v) AS secret, unnest(g[1:len(m)]) AS gap
            FROM (SELECT doc_id, owner, repository, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v,
                         string_split_regex(text, '{p}') AS g FROM d)"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
e AS ({' UNION ALL '.join(parts)}),
f AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind_order ORDER BY i) AS "end" FROM e),
s AS (SELECT doc_id, owner, repository, kind, kind_order, ("end" - length(whole))::BIGINT AS start, "end"::BIGINT AS "end",
             ("end" - length(secret))::BIGINT AS secret_start, sha256(secret) AS hash FROM f WHERE length(secret) >= least),
q AS (SELECT hash, count(DISTINCT owner) AS owners, count(DISTINCT owner || '|' || repository) AS repositories FROM s GROUP BY 1),
j AS (SELECT s.*, owners, owners = 1 AND repositories <= {LIVE_REPOSITORIES} AS live FROM s JOIN q USING (hash)),
x AS (SELECT doc_id, start, kind_order, "end", kind || ':' || start || ':' || "end" AS span, TRUE AS base, live, owners FROM j
      UNION ALL SELECT DISTINCT doc_id, secret_start, {len(KINDS)}, "end", 'live:' || secret_start || ':' || "end", FALSE, NULL::BOOLEAN, NULL::BIGINT FROM j WHERE live)
SELECT d.doc_id,
  {', '.join(f"count(*) FILTER (WHERE base AND kind_order = {i}) AS n_{k}" for i, (k, *_) in enumerate(KINDS))},
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind_order, "end") FILTER (WHERE base), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind_order, "end"), '') AS spans,
  count(*) FILTER (WHERE base AND live) AS n_live, count(*) FILTER (WHERE base AND NOT live) AS n_copied,
  coalesce(max(owners), 0) AS most_owners
FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id
"""


SQL = _sql()
