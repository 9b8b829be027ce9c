"""Queries on panels: contracts, calendar, preprocessing, windows, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, contracts, ensemble, preprocess, splits, tuning, windows
from ..operators.contracts import Roles
from ..sources.fixtures import panel
from .common import oracle, panel_sql, rounded, sessions_sql

N, S, E, U = (panel_sql(n) for n in ("nation_day", "segment_day", "event_hour", "user_day"))
QUERIES, SQL = {}, {}


def query(sql: str | None = None, *doubles: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = oracle(sql, *doubles)
        return f

    return register


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return contracts.repeated_keys(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_linenumber")


@query(f"SELECT asset_id, count(DISTINCT kind) + max(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) AS kind FROM ({U}) AS p GROUP BY 1 HAVING count(DISTINCT kind) + max(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) > 1")
def varying_static(spark, d):
    return contracts.varying_static(panel(spark, d, "user_day"), ["kind"])


def _kinds(df):
    """The ids of a panel that is known to have few."""
    return [r[0] for r in df.select("asset_id").distinct().orderBy("asset_id").collect()]


@query(f"WITH p AS ({E}), g AS (SELECT * FROM (SELECT DISTINCT date FROM p) CROSS JOIN (SELECT DISTINCT asset_id FROM p)) SELECT date, asset_id, ret, asset_id AS ticker FROM g LEFT JOIN p USING (date, asset_id)", "ret")
def wide_long_roundtrip(spark, d):
    long = panel(spark, d, "event_hour")
    return rounded(calendar.wide_to_long(calendar.long_to_wide(long, _kinds(long))))


@query(f"WITH p AS ({N}), s AS ({sessions_sql('p')}), g AS (SELECT asset_id, session AS date FROM (SELECT DISTINCT asset_id FROM p) CROSS JOIN s) SELECT asset_id, date, level / lag(level) OVER (PARTITION BY asset_id ORDER BY date) - 1 AS ret FROM g LEFT JOIN p USING (asset_id, date)", "ret")
def calendar_reindex_returns(spark, d):
    p = panel(spark, d, "nation_day").drop("ret")
    return rounded(calendar.simple_returns(calendar.reindex(p, calendar.sessions_of(p))).drop("level"))


@query(f"WITH p AS ({S}), s AS ({sessions_sql('p')}), g AS (SELECT asset_id, session AS date FROM (SELECT DISTINCT asset_id FROM p) CROSS JOIN s), r AS (SELECT asset_id, date, level / lag(level) OVER (PARTITION BY asset_id ORDER BY date) - 1 AS ret FROM g LEFT JOIN p USING (asset_id, date)) SELECT asset_id, date, ret FROM r WHERE date IN (SELECT date FROM r GROUP BY 1 HAVING count(ret) = count(*))", "ret")
def complete_dates_returns(spark, d):
    p = panel(spark, d, "segment_day").drop("ret")
    return rounded(calendar.simple_returns(calendar.reindex(p, calendar.sessions_of(p)), drop_missing=True).drop("level"))


@query(f"WITH p AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), s AS ({sessions_sql('p')}) SELECT date, (SELECT min(session) FROM s WHERE session > date) AS next_session FROM p")
def next_session(spark, d):
    dates = spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("date"))
    return calendar.next_session(dates, calendar.sessions_of(dates))


SCALER = f"SELECT asset_id, 'ret' AS feature, avg(ret) AS mean, var_pop(ret) AS variance, CASE WHEN var_pop(ret) = 0 THEN 1 ELSE sqrt(var_pop(ret)) END AS scale FROM ({N}) AS p GROUP BY 1"


@query(SCALER, "mean", "variance", "scale")
def scaler_state(spark, d):
    return rounded(preprocess.fit_scaler(panel(spark, d, "nation_day"), ["ret"]))


@query(f"SELECT asset_id, date, (ret - mean) / scale AS ret FROM ({N}) AS p JOIN ({SCALER}) AS s USING (asset_id)", "ret")
def scaled_panel(spark, d):
    p = panel(spark, d, "nation_day").select("asset_id", "date", "ret")
    return rounded(preprocess.scale(p, preprocess.fit_scaler(p, ["ret"]), ["ret"]))


@query(f"SELECT asset_id, date, ret FROM ({N}) AS p", "ret")
def unscaled_roundtrip(spark, d):
    p = panel(spark, d, "nation_day").select("asset_id", "date", "ret")
    state = preprocess.fit_scaler(p, ["ret"])
    return rounded(preprocess.unscale(preprocess.scale(p, state, ["ret"]), state, ["ret"]))


VOCAB = f"""SELECT "column", token_key, split_part(token_key, '::', 1) AS value_type, split_part(token_key, '::', 2) AS value, row_number() OVER (PARTITION BY "column" ORDER BY token_key) + 1 AS token_id FROM (
  SELECT DISTINCT 'kind' AS "column", 'str::' || kind AS token_key FROM ({U}) AS p WHERE kind IS NOT NULL
  UNION SELECT DISTINCT 'asset_id', 'int::' || asset_id FROM ({U}) AS p) AS k"""


def _vocabulary(p):
    return preprocess.fit_vocabulary(p, ["kind", "asset_id"])


@query(VOCAB)
def vocab_state(spark, d):
    return _vocabulary(panel(spark, d, "user_day"))


@query(f'SELECT "column", count(*) + 2 AS size FROM ({VOCAB}) AS v GROUP BY 1')
def vocab_sizes(spark, d):
    return preprocess.vocabulary_sizes(_vocabulary(panel(spark, d, "user_day")), ["kind", "asset_id"])


ENCODED = f"""WITH v AS ({VOCAB}) SELECT coalesce(a.token_id, 1) AS asset_id, p.asset_id AS id, date, CASE WHEN kind IS NULL THEN 0 ELSE coalesce(k.token_id, 1) END AS kind FROM ({U}) AS p
  LEFT JOIN v AS k ON k."column" = 'kind' AND k.value = kind LEFT JOIN v AS a ON a."column" = 'asset_id' AND a.value = CAST(p.asset_id AS VARCHAR)"""


@query(ENCODED)
def encoded_panel(spark, d):
    p = panel(spark, d, "user_day").select("asset_id", F.col("asset_id").alias("id"), "date", "kind")
    return preprocess.encode(p, _vocabulary(p), ["asset_id", "kind"])


@query(f"WITH v AS ({VOCAB}) SELECT asset_id, date, CASE WHEN kind IS NULL THEN NULL WHEN kind IN (SELECT value FROM v WHERE \"column\" = 'kind') THEN kind ELSE '[UNK]' END AS kind FROM ({U}) AS p")
def decoded_panel(spark, d):
    p = panel(spark, d, "user_day").select("asset_id", "date", "kind")
    v = _vocabulary(p)
    return preprocess.decode(preprocess.encode(p, v, ["kind"]), v, ["kind"])


@query(f"WITH v AS ({VOCAB}), s AS (SELECT asset_id, avg(ret) AS m, CASE WHEN var_pop(ret) = 0 THEN 1 ELSE sqrt(var_pop(ret)) END AS s FROM ({U}) AS p GROUP BY 1) SELECT p.asset_id, date, (ret - m) / s AS ret, CASE WHEN kind IS NULL THEN 0 ELSE coalesce(token_id, 1) END AS kind FROM ({U}) AS p JOIN s USING (asset_id) LEFT JOIN v ON \"column\" = 'kind' AND value = kind", "ret")
def bundle_transform(spark, d):
    p = panel(spark, d, "user_day").select("asset_id", "date", "ret", "kind")
    # Events of no user have no scaler, but their kinds count.
    of_users = p.where("asset_id IS NOT NULL")
    return rounded(preprocess.apply_bundle(of_users, preprocess.fit_scaler(of_users, ["ret"]), ["ret"], _vocabulary(p), ["kind"]))


ROLES = Roles(targets=("ret",), dynamic=("ret",))


def _cells(w):
    """Windows by position, so that both engines show them as rows."""
    x = w.select("asset_id", "forecast_start_date", "forecast_end_date", F.posexplode(F.arrays_zip("x_ret", "x_ret_mask")).alias("position", "c"), F.get("y", F.lit(0)).alias("y_first"), F.element_at("y", -1).alias("y_last"), F.size("y").alias("n_y"))
    return x.select("asset_id", "forecast_start_date", "forecast_end_date", "position", F.col("c.x_ret").alias("x"), F.col("c.x_ret_mask").alias("observed"), "y_first", "y_last", "n_y")


def _windows_sql(source: str, in_steps: int, horizon: int, out_steps: int, next_step: bool = False, by: str = "") -> str:
    length = in_steps + 1 if next_step else in_steps + horizon + out_steps - 1
    y0, ny = (1, in_steps) if next_step else (in_steps + horizon - 1, out_steps)
    start = y0 + ny if next_step else y0 + 1
    return f"""SELECT {by} asset_id, ds[{start}] AS forecast_start_date, ds[{y0 + ny}] AS forecast_end_date, rs[1:{in_steps}] AS x, rs[{y0 + 1}:{y0 + ny}] AS y FROM (
      SELECT {by} asset_id, list(date) OVER w AS ds, list(ret) OVER w AS rs FROM ({source}) AS p WINDOW w AS (PARTITION BY {by} asset_id ORDER BY date ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)) AS f WHERE len(ds) = {length}"""


def _cells_sql(w: str) -> str:
    return f"SELECT asset_id, forecast_start_date, forecast_end_date, CAST(position - 1 AS INTEGER) AS position, x[position] AS x, x[position] IS NOT NULL AS observed, y[1] AS y_first, y[-1] AS y_last, CAST(len(y) AS INTEGER) AS n_y FROM (SELECT *, unnest(range(1, len(x) + 1)) AS position FROM ({w}) AS w) AS c"


@query(_cells_sql(_windows_sql(E, 8, 2, 3)), "x", "y_first", "y_last")
def windows_tail(spark, d):
    return rounded(_cells(windows.make_windows(panel(spark, d, "event_hour"), ROLES, 8, 2, 3)))


@query(_cells_sql(_windows_sql(E, 6, 1, 1, True)), "x", "y_first", "y_last")
def windows_next_step(spark, d):
    # Few assets with long histories: in chunks of rows.
    return rounded(_cells(windows.make_windows(panel(spark, d, "event_hour"), ROLES, 6, mode="next_step", chunk=200)))


SMALL = _windows_sql(S, 4, 1, 1)
SUMMED = "SELECT asset_id, forecast_start_date, forecast_end_date, list_sum(x) AS x_sum, y[1] AS y FROM"


def _summed(w):
    total = F.aggregate("x_ret", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return w.select("asset_id", "forecast_start_date", "forecast_end_date", F.when(F.exists("x_ret", lambda v: v.isNotNull()), total).alias("x_sum"), F.get("y", F.lit(0)).alias("y"))


def _small(spark, d):
    return windows.make_windows(panel(spark, d, "segment_day"), ROLES, 4)


@query(f"WITH w AS ({SMALL}) {SUMMED} w WHERE forecast_start_date IN (SELECT forecast_start_date FROM w GROUP BY 1 HAVING count(DISTINCT asset_id) = (SELECT count(DISTINCT asset_id) FROM w))", "x_sum", "y")
def align_truncate(spark, d):
    return rounded(_summed(windows.align_truncate(_small(spark, d))))


@query(f"WITH w AS ({SMALL}), t AS (SELECT forecast_start_date, arg_min(forecast_end_date, asset_id) AS e FROM w GROUP BY 1), g AS (SELECT * FROM t CROSS JOIN (SELECT DISTINCT asset_id FROM w)) SELECT asset_id, forecast_start_date, coalesce(forecast_end_date, e) AS forecast_end_date, CASE WHEN x IS NULL THEN 0 ELSE list_sum(x) END AS x_sum, CASE WHEN x IS NULL THEN 0 ELSE y[1] END AS y FROM g LEFT JOIN w USING (forecast_start_date, asset_id)", "x_sum", "y")
def align_pad(spark, d):
    return rounded(_summed(windows.align_pad(_small(spark, d), 0.0)))


@query(f"WITH w AS ({SMALL}) {SUMMED} w WHERE forecast_start_date NOT IN (SELECT forecast_start_date FROM w WHERE len(list_filter(list_concat(x, y), lambda v: v IS NULL)) > 0)", "x_sum", "y")
def drop_incomplete_dates(spark, d):
    return rounded(_summed(windows.drop_incomplete(_small(spark, d))))


DATES = f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ({S}) AS p) AS q"


def _dates(spark, d):
    return splits.date_index(panel(spark, d, "segment_day"))


@query(f"SELECT 0 AS fold, date, CASE WHEN i < n - greatest(1, floor(n * 0.2)) THEN 'train' ELSE 'val' END AS split FROM ({DATES}) AS q")
def split_holdout(spark, d):
    return splits.holdout(_dates(spark, d), 0.2)


EXPANDING = f"SELECT fold, date, CASE WHEN i < (n // 5) * (fold + 1) THEN 'train' ELSE 'val' END AS split FROM ({DATES}) AS q CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS fold) AS f WHERE i < (n // 5) * (fold + 2)"


@query(EXPANDING)
def split_expanding(spark, d):
    return splits.expanding(_dates(spark, d), 4)


@query(f"SELECT fold, date, CASE WHEN i < (n // 5) * (fold + 1) THEN 'train' ELSE 'val' END AS split FROM ({DATES}) AS q CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS fold) AS f WHERE i < (n // 5) * (fold + 2) AND i >= greatest(0, (n // 5) * (fold + 1) - 90)")
def split_walk_forward(spark, d):
    return splits.walk_forward(_dates(spark, d), 4, 90)


@query(f"SELECT fold, split, asset_id, 'ret' AS feature, avg(ret) AS mean, var_pop(ret) AS variance, CASE WHEN var_pop(ret) = 0 THEN 1 ELSE sqrt(var_pop(ret)) END AS scale FROM ({S}) AS p JOIN ({EXPANDING}) AS f USING (date) WHERE split = 'train' GROUP BY 1, 2, 3", "mean", "variance", "scale")
def fold_scalers(spark, d):
    p = panel(spark, d, "segment_day")
    rows = splits.in_folds(p, splits.expanding(splits.date_index(p), 4)).where("split = 'train'")
    return rounded(preprocess.fit_scaler(rows, ["ret"], by=["fold", "split"]))


#: Windows inside each slice of each fold, on the scale of the fold's training rows.
SLICES = f"""WITH f AS ({EXPANDING}), r AS (SELECT fold, split, asset_id, date, ret FROM ({S}) AS p JOIN f USING (date)),
  s AS (SELECT fold, asset_id, avg(ret) AS m, CASE WHEN var_pop(ret) = 0 THEN 1 ELSE sqrt(var_pop(ret)) END AS s FROM r WHERE split = 'train' GROUP BY 1, 2)
  SELECT fold, split, asset_id, date, (ret - m) / s AS ret FROM r JOIN s USING (fold, asset_id)"""


@query(f"SELECT fold, split, asset_id, forecast_start_date, forecast_end_date, list_sum(x) AS x_sum, x[1] AS x_first, y[1] AS y FROM ({_windows_sql(SLICES, 10, 2, 1, by='fold, split,')}) AS w", "x_sum", "x_first", "y")
def fold_windows(spark, d):
    p = panel(spark, d, "segment_day")
    w = splits.fold_windows(p, splits.expanding(splits.date_index(p), 4), ROLES, 10, 2, scaled=["ret"])
    total = F.when(F.exists("x_ret", lambda v: v.isNotNull()), F.aggregate("x_ret", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))))
    return rounded(w.select("fold", "split", "asset_id", "forecast_start_date", "forecast_end_date", total.alias("x_sum"), F.get("x_ret", F.lit(0)).alias("x_first"), F.get("y", F.lit(0)).alias("y")))


@query(f"SELECT asset_id, date, max(ret) AS ret, CASE WHEN date <= DATE '1999-12-31' THEN 'train' ELSE 'val' END AS part FROM ({N}) AS p GROUP BY 1, 2", "ret")
def train_val_union(spark, d):
    p = panel(spark, d, "nation_day").select("asset_id", "date", "ret")
    train = p.where("date <= DATE '1999-12-31'").withColumn("part", F.lit("train"))
    val = p.where("date >= DATE '1999-06-01'").withColumn("part", F.lit("val"))
    return rounded(preprocess.train_then_val(train, val))


def _hash_sql(seed: int, kind: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:{kind}:' || {" || ':' || ".join(parts)}), 1, 15) AS BIGINT)"


def bags_sql(source: str, estimators: int, fraction: float, seed: int) -> str:
    """(estimator, date, bag) of date draws with replacement."""
    return f"""SELECT e.estimator, q.date, CASE WHEN x.i IS NULL THEN 'oob' ELSE 'in' END AS bag
      FROM (SELECT CAST(unnest(range({estimators})) AS INTEGER) AS estimator) AS e CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ({source}) AS p) AS u) AS q
      LEFT JOIN (SELECT DISTINCT estimator, {_hash_sql(seed, 'date', 'estimator', 'draw')} % n AS i
        FROM (SELECT estimator, n, unnest(range(1, greatest(1, CAST(round_even(n * {fraction}, 0) AS BIGINT)) + 1)) AS draw
          FROM (SELECT CAST(unnest(range({estimators})) AS INTEGER) AS estimator) AS k CROSS JOIN (SELECT count(DISTINCT date) AS n FROM ({source}) AS p) AS c) AS d) AS x ON x.estimator = e.estimator AND x.i = q.i"""


def subspace_sql(source: str, estimators: int, fraction: float, seed: int) -> str:
    """(estimator, asset_id) of asset draws without replacement."""
    return f"""SELECT estimator, asset_id FROM (SELECT estimator, asset_id, n, row_number() OVER (PARTITION BY estimator ORDER BY {_hash_sql(seed, 'asset', 'estimator', 'asset_id')}, asset_id) AS r
      FROM (SELECT CAST(unnest(range({estimators})) AS INTEGER) AS estimator) AS k CROSS JOIN (SELECT asset_id, count(*) OVER () AS n FROM (SELECT DISTINCT asset_id FROM ({source}) AS p) AS u) AS a) AS t
      WHERE r <= greatest(1, CAST(round_even(n * {fraction}, 0) AS BIGINT))"""


BAG_SCALER = "SELECT estimator, asset_id, 'ret' AS feature, avg(ret) AS mean, var_pop(ret) AS variance, CASE WHEN var_pop(ret) = 0 THEN 1 ELSE sqrt(var_pop(ret)) END AS scale FROM ({rows}) AS r GROUP BY 1, 2"


@query(f"SELECT estimator, date, bag FROM ({bags_sql('SELECT CAST(o_orderdate AS DATE) AS date FROM orders', 8, 0.8, 3)}) AS b")
def bag_membership(spark, d):
    return splits.bootstrap_dates(_dates(spark, d), 8, 0.8, seed=3)


#: A trial for each hundred dates, picked by hashes.
@query(f"SELECT id AS trial_number, [8, 16, 32, 64][{_hash_sql(11, 'trial', 'id', chr(39) + 'width' + chr(39))} % 4 + 1] AS width, ['sum', 'mean'][{_hash_sql(11, 'trial', 'id', chr(39) + 'pool' + chr(39))} % 2 + 1] AS pool, n_dates FROM (SELECT unnest(range(n_dates // 100)) AS id, n_dates FROM (SELECT count(*) AS n_dates FROM ({DATES}) AS q) AS c) AS t")
def random_trials(spark, d):
    n = _dates(spark, d).count()
    return tuning.random_trials(spark, {"width": [8, 16, 32, 64], "pool": ["sum", "mean"]}, n // 100, seed=11).withColumn("n_dates", F.lit(n).cast("long"))


@query(f"SELECT estimator, date FROM (SELECT unnest(range(2)) AS estimator) AS e CROSS JOIN ({DATES}) AS q WHERE i % 2 <> estimator")
def out_of_bag_dates(spark, d):
    dates = _dates(spark, d)
    bags = dates.join(spark.range(2).select(F.col("id").cast("int").alias("estimator")), F.col("date_idx") % 2 == F.col("estimator"))
    return splits.out_of_bag(dates, bags, 2)


@query(subspace_sql(N, 8, 0.5, 3))
def bag_assets(spark, d):
    return splits.asset_subspace(panel(spark, d, "nation_day"), 8, 0.5, seed=3)


@query(BAG_SCALER.format(rows=f"SELECT estimator, asset_id, ret FROM ({S}) AS p JOIN ({bags_sql(S, 6, 0.8, 3)}) AS b USING (date) JOIN ({subspace_sql(S, 6, 0.6, 3)}) AS a USING (estimator, asset_id) WHERE bag = 'in'"), "mean", "variance", "scale")
def bag_scaler(spark, d):
    p = panel(spark, d, "segment_day")
    bags = splits.bootstrap_dates(splits.date_index(p), 6, 0.8, seed=3)
    return rounded(ensemble.bag_scalers(p, bags, ["ret"], splits.asset_subspace(p, 6, 0.6, seed=3)))


@query(f"""WITH b AS ({bags_sql(S, 6, 0.8, 3)}), s AS ({BAG_SCALER.format(rows=f"SELECT estimator, asset_id, ret FROM ({S}) AS p JOIN b USING (date) WHERE bag = 'in'")})
  SELECT estimator, bag, asset_id, count(*) AS n_windows, avg((y[1] - mean) / scale) AS mean_y FROM ({SMALL}) AS w JOIN b ON b.date = forecast_start_date JOIN s USING (estimator, asset_id) GROUP BY 1, 2, 3""", "mean_y")
def bag_windows(spark, d):
    p = panel(spark, d, "segment_day")
    bags = splits.bootstrap_dates(splits.date_index(p), 6, 0.8, seed=3)
    state = ensemble.bag_scalers(p, bags, ["ret"])
    w = ensemble.bag_windows(_small(spark, d), bags)
    scaled = windows.scale_windows(w, state, by=["estimator"], target="ret")
    return rounded(scaled.groupBy("estimator", "bag", "asset_id").agg(F.count("*").alias("n_windows"), F.avg(F.get("y", F.lit(0))).alias("mean_y")))
