"""Reports as one chain: forecasts of several panels and methods are stored, read again, judged, ranked and set in tables; and panels loaded from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomcast.functions import metrics, stats
from loomcast.operators import binning, design, kernel
from loomcast.operators.estimators import PanelData, TreeModel
from loomcast.plans import queries as Q
from loomcast.plans.queries import H, PD, PM, _rounded, query
from loomcast.sources import loader, tables, tsf
from loomcast.sources.panels import PANELS, panel, panel_sql, read

#: The benchmark's panels and baselines.
DATASETS, METHODS = ("pm", "pd", "ph", "pw"), ("naive", "snaive", "mean")


# --- the stored benchmark ---------------------------------------------------------------------------------------------------------


def _mean_forecast(p: DataFrame, horizon: int) -> DataFrame:
    r = p.withColumn("r", F.row_number().over(design.back()) - 1)
    past = r.where(F.col("r") >= horizon).groupBy("series").agg(F.avg("y").alias("pred"))
    return r.where(F.col("r") < horizon).join(past, "series").select("series", (F.lit(horizon) - F.col("r")).cast("int").alias("h"), F.col("y").alias("actual"), "pred")


def _computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, method, series, h, actual, pred, scale)."""
    out = None
    for name in DATASETS:
        season, horizon = PANELS[name][6], PANELS[name][7]
        p = panel(spark, sf_dir, name)
        scales = design.seasonal_scale(p, horizon, season)
        for method, rows in (("naive", design.naive(p, horizon)), ("snaive", design.naive(p, horizon, season)), ("mean", _mean_forecast(p, horizon))):
            rows = rows.join(scales, "series").select(F.lit(name).alias("dataset"), F.lit(method).alias("method"), "series", "h", "actual", "pred", "scale")
            out = rows if out is None else out.unionByName(rows)
    return out


_STORES: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's forecasts, written once a session, one folder a dataset."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = tables.fresh_path(spark, "benchmark")
        tables.store_forecasts(_computed(spark, sf_dir), path)
        _STORES[key] = path
    return spark.read.parquet(_STORES[key])


def _series_errors(spark, sf_dir) -> DataFrame:
    e = F.avg(F.abs(F.col("actual") - F.col("pred")))
    return stored(spark, sf_dir).groupBy("dataset", "method", "series").agg(e.alias("mae"), F.first("scale").alias("scale")).withColumn("mase", F.try_divide("mae", F.when(F.col("scale") > 0, F.col("scale"))))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, method, value): the mean scaled error."""
    return _series_errors(spark, sf_dir).groupBy("dataset", "method").agg(F.round(F.avg("mase"), 6).alias("value"))


def _dataset_sql(n: str) -> str:
    s, h = PANELS[n][6], PANELS[n][7]
    pair = lambda method, place: f"SELECT '{n}' AS dataset, '{method}' AS method, a.series, CAST({h} - a.r AS INTEGER) AS h, a.y AS actual, b.y AS pred FROM {n}r a JOIN {n}r b ON a.series = b.series AND b.r = {place} WHERE a.r < {h}"
    return f"""{panel_sql(n)}, {n}r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY index DESC) - 1 AS r FROM {n}),
{n}f AS ({pair('naive', h)} UNION ALL {pair('snaive', f'{h + s - 1} - ({h} - a.r - 1) % {s}')} UNION ALL
 SELECT '{n}', 'mean', a.series, CAST({h} - a.r AS INTEGER), a.y, b.m FROM {n}r a JOIN (SELECT series, avg(y) AS m FROM {n}r WHERE r >= {h} GROUP BY series) b ON a.series = b.series WHERE a.r < {h}),
{n}d AS (SELECT series, abs(y - lag(y, {s}) OVER w) AS s, abs(y - lag(y, 1) OVER w) AS o FROM {n}r WHERE r >= {h} WINDOW w AS (PARTITION BY series ORDER BY index)),
{n}s AS (SELECT '{n}' AS dataset, series, CASE WHEN avg(s) > 0 THEN avg(s) ELSE avg(o) END AS scale FROM {n}d GROUP BY series)"""


_FA = ", ".join(_dataset_sql(n) for n in DATASETS) + f", fa AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM {n}f' for n in DATASETS)}) JOIN ({' UNION ALL '.join(f'SELECT * FROM {n}s' for n in DATASETS)}) USING (dataset, series))"
_ER = f"{_FA}, er AS MATERIALIZED (SELECT dataset, method, series, avg(abs(actual - pred)) / nullif(any_value(scale), 0) AS mase FROM fa GROUP BY ALL)"
_RES = f"{_ER}, res AS MATERIALIZED (SELECT dataset, method, round(avg(mase), 6) AS value FROM er GROUP BY ALL)"
_RANKS = f"{_RES}, rk AS (SELECT method, avg(r) AS mean_rank FROM (SELECT method, rank() OVER (PARTITION BY dataset ORDER BY value) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2.0 AS r FROM res) GROUP BY method)"


@query(f"WITH {_RES} SELECT * FROM res")
def benchmark_results(spark, sf_dir):
    return results(spark, sf_dir)


@query(f"WITH {_RANKS} SELECT method, round(mean_rank, 6) AS mean_rank FROM rk")
def avg_ranks(spark, sf_dir):
    return _rounded(stats.average_ranks(results(spark, sf_dir)))


@query(f"WITH {_RANKS} SELECT round(12.0 * 4 / (count(*) * (count(*) + 1)) * (sum(mean_rank * mean_rank) - count(*) * (count(*) + 1) * (count(*) + 1) / 4), 6) AS chi2, round(2.343 * sqrt(count(*) * (count(*) + 1) / 24.0), 6) AS cd FROM rk")
def friedman_cd(spark, sf_dir):
    return _rounded(stats.friedman(stats.average_ranks(results(spark, sf_dir)), len(DATASETS), stats.CRITICAL[len(METHODS)]))


@query(f"WITH {_RANKS} SELECT method, round(mean_rank, 6) AS mean_rank, mean_rank <= (SELECT min(mean_rank) FROM rk) + 2.343 * sqrt(3 * 4 / 24.0) AS in_band FROM rk")
def rank_band(spark, sf_dir):
    return _rounded(stats.band(stats.average_ranks(results(spark, sf_dir)), len(DATASETS)))


# --- per horizon --------------------------------------------------------------------------------------------------------------------


def _per_horizon(spark, sf_dir, method: str, name: str) -> DataFrame:
    e = F.try_divide(F.abs(F.col("actual") - F.col("pred")), F.when(F.col("scale") > 0, F.col("scale")))
    return stored(spark, sf_dir).where(F.col("method") == method).groupBy("dataset", "h").agg(F.median(e).alias(name))


def horizon_ratios(spark, sf_dir) -> DataFrame:
    """(dataset, h, rel): the seasonal method's median error over the naive one's; only horizons that both have, and finite ratios."""
    both = _per_horizon(spark, sf_dir, "naive", "base").join(_per_horizon(spark, sf_dir, "snaive", "both"), ["dataset", "h"]).dropna()
    return both.select("dataset", "h", metrics.finite(F.try_divide("both", "base")).alias("rel")).dropna()


_REL = f"{_FA}, ph_ AS (SELECT dataset, method, h, median(abs(actual - pred) / nullif(scale, 0)) AS e FROM fa GROUP BY ALL), rel AS (SELECT a.dataset, a.h, b.e / a.e AS rel FROM ph_ a JOIN ph_ b ON a.dataset = b.dataset AND a.h = b.h AND a.method = 'naive' AND b.method = 'snaive' WHERE a.e <> 0 AND b.e IS NOT NULL), sl AS (SELECT dataset, regr_slope(rel, h) AS slope FROM rel GROUP BY dataset)"


@query(f"WITH {_REL} SELECT dataset, h, round(rel, 6) AS rel FROM rel")
def horizon_ratio(spark, sf_dir):
    return _rounded(horizon_ratios(spark, sf_dir))


@query(f"WITH {_REL} SELECT dataset, round(slope, 6) AS slope, CAST(sign(slope) AS INTEGER) AS sign FROM sl")
def slope_signs(spark, sf_dir):
    return _rounded(stats.slopes(horizon_ratios(spark, sf_dir)))


@query(f"WITH {_REL}, c AS (SELECT count(*) FILTER (slope < 0) AS a, count(*) FILTER (slope >= 0) AS b FROM sl) SELECT a AS n_neg, b AS n_pos, round(least(1.0, 2 * (SELECT sum(factorial(CAST(a + b AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(a + b - i AS INTEGER)))) FROM range(0, least(a, b) + 1) t(i)) / power(2, a + b)), 6) AS p FROM c")
def slope_sign_test(spark, sf_dir):
    return _rounded(stats.sign_counts(stats.slopes(horizon_ratios(spark, sf_dir))))


# --- tables -------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_RES} SELECT a.dataset, a.method, round((a.value - b.value) / b.value * 100, 6) AS rel_pct FROM res a JOIN res b ON a.dataset = b.dataset AND b.method = 'naive'")
def rel_to_base(spark, sf_dir):
    return _rounded(stats.relative_to_base(results(spark, sf_dir), "naive"))


_WIDE = ", ".join(f"max(value) FILTER (method = '{m}') AS {m}" for m in METHODS)


@query(f"WITH {_RES} SELECT dataset, {_WIDE} FROM res GROUP BY dataset")
def wide_table(spark, sf_dir):
    return stats.wide(results(spark, sf_dir), list(METHODS))


@query(f"WITH {_RES}, a AS (SELECT dataset, {_WIDE} FROM res GROUP BY dataset) SELECT a.dataset, a.naive, a.snaive, b.mean FROM a LEFT JOIN a b ON a.dataset = b.dataset AND b.dataset IN ('pm', 'pw')")
def wide_compare(spark, sf_dir):
    """Left joins of one study's table with another's, which lacks some datasets."""
    own = stats.wide(results(spark, sf_dir), ["naive", "snaive"])
    other = results(spark, sf_dir).where(F.col("dataset").isin("pm", "pw") & (F.col("method") == "mean")).select("dataset", F.col("value").alias("mean"))
    return own.join(other, "dataset", "left")


@query(f"WITH {_RES} SELECT dataset, naive AS base, snaive AS deriv, CASE WHEN dataset IN ('pm', 'pd') THEN mean ELSE naive END AS seas, snaive AS both FROM (SELECT dataset, {_WIDE} FROM res GROUP BY dataset)")
def variant_fill(spark, sf_dir):
    """Variants that a dataset lacks take the values of what they go back to."""
    wide = stats.wide(results(spark, sf_dir), list(METHODS)).withColumnsRenamed({"naive": "base", "snaive": "deriv"})
    wide = wide.withColumns({"seas": F.when(F.col("dataset").isin("pm", "pd"), F.col("mean")), "both": F.lit(None).cast("double")}).drop("mean")
    return wide.withColumns({"seas": F.coalesce("seas", "base"), "both": F.coalesce("both", "deriv")})


# means of a few values of six digits may end in a 5: a small number more keeps them from being rounded either way
@query(f"WITH {_RES} SELECT coalesce(method, 'ALL') AS method, round(avg(value) + 1e-9, 6) AS mean, round(median(value) + 1e-9, 6) AS med FROM res GROUP BY ROLLUP (method)")
def method_rollup(spark, sf_dir):
    return _rounded(results(spark, sf_dir).rollup("method").agg((F.avg("value") + 1e-9).alias("mean"), (F.median("value") + 1e-9).alias("med")).withColumn("method", F.coalesce("method", F.lit("ALL"))))


@query(f"WITH {_RES}, w AS (SELECT a.method, a.value / b.value AS ratio FROM res a JOIN res b ON a.dataset = b.dataset AND b.method = 'naive' WHERE a.method <> 'naive') SELECT coalesce(method, 'OVERALL') AS method, CAST(count(*) FILTER (ratio < 1) AS BIGINT) AS wins, count(*) AS n, round(avg(ratio), 6) AS mean_ratio FROM w GROUP BY ROLLUP (method)")
def win_counts(spark, sf_dir):
    """Wins over the base method and mean ratios to it, by method and over all."""
    rel = stats.relative_to_base(results(spark, sf_dir), "naive").where("method <> 'naive'").withColumn("ratio", 1 + F.col("rel_pct") / 100)
    return _rounded(rel.rollup("method").agg(F.count_if(F.col("ratio") < 1).alias("wins"), F.count("*").alias("n"), F.avg("ratio").alias("mean_ratio")).withColumn("method", F.coalesce("method", F.lit("OVERALL"))))


_CELL = lambda m: f"CASE WHEN {m} IS NULL THEN '--' WHEN {m} = least(naive, snaive, mean) THEN '\\textbf{{' || format('{{:.3f}}', {m}) || '}}' ELSE format('{{:.3f}}', {m}) END"


@query(f"WITH {_RES} SELECT dataset, dataset || ' & ' || {_CELL('naive')} || ' & ' || {_CELL('snaive')} || ' & ' || {_CELL('mean')} || ' \\\\' AS line FROM (SELECT dataset, {_WIDE} FROM res GROUP BY dataset)")
def typeset_rows(spark, sf_dir):
    """Table rows through a text file and back."""
    path = tables.fresh_path(spark, "rows")
    lines = tables.table_lines(stats.wide(results(spark, sf_dir), list(METHODS)), "dataset", list(METHODS))
    lines.select("line").write.text(path)
    return spark.read.text(path).select(F.substring_index("value", " & ", 1).alias("dataset"), F.col("value").alias("line"))


@query(f"WITH {_ER} SELECT dataset, method, round(avg(mase), 6) AS mean, round(median(mase), 6) AS median, round(stddev_pop(mase), 6) AS std FROM er WHERE dataset = 'pm' GROUP BY ALL")
def robust_stats(spark, sf_dir):
    rows, out = _series_errors(spark, sf_dir).where("dataset = 'pm'"), None
    for m in METHODS:
        one = metrics.robust(rows.where(F.col("method") == m), "mase").select(F.lit("pm").alias("dataset"), F.lit(m).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


_PERIOD = "CAST((h - 1) // 3 + 1 AS INTEGER)"
_PRED = "greatest(round_even(pred, 0), 0.0)"


@query(f"""WITH {_FA}, e AS (SELECT method, series, {_PERIOD} AS horizon_period, sqrt(avg((actual - {_PRED}) ** 2)) AS r, avg(200 * abs(actual - {_PRED}) / greatest(0.6, abs(actual) + abs({_PRED}) + 0.1)) AS s, avg(abs(actual - {_PRED})) / nullif(any_value(scale), 0) AS m FROM fa WHERE dataset = 'pm' GROUP BY ALL),
k AS ({' UNION ALL '.join(f"SELECT method, horizon_period, '{t}' AS type, '{a}' AS agg, {f}({c}) AS value FROM e GROUP BY ALL" for t, c in (("msMAPE", "s"), ("MASE", "m"), ("RMSE", "r")) for a, f in (("mean", "avg"), ("median", "median")))})
SELECT method, horizon_period, type, agg, round(value, 5) AS value FROM k WHERE method <> 'mean' UNION ALL SELECT 'absent', 0, t, a, NULL FROM (SELECT unnest(['msMAPE', 'MASE', 'RMSE']) AS t), (SELECT unnest(['mean', 'median']) AS a)""")
def report_from_files(spark, sf_dir):
    """Judged from the stored forecasts, in two parts of the horizon; a method without a file has rows without a value."""
    rows = stored(spark, sf_dir).where("dataset = 'pm'")
    return _rounded(metrics.report(rows, rows.select("series", "scale").distinct(), ["naive", "snaive", "absent"], H, 2, True).fillna(0, "horizon_period"), 5)


@query(f"WITH {_ER}, v AS (SELECT method, mase, row_number() OVER (PARTITION BY method ORDER BY mase) - 1 AS place, count(*) OVER (PARTITION BY method) AS n FROM er WHERE mase IS NOT NULL), dr AS (SELECT method, n, k, unnest(range(0, n)) AS j FROM (SELECT DISTINCT method, n, unnest(range(0, 2000)) AS k FROM v)), mm AS (SELECT d.method, k, avg(mase) AS m FROM dr d JOIN v ON v.method = d.method AND v.place = CAST('0x' || substr(md5(d.method || ':' || k || ':' || j || ':0'), 1, 8) AS BIGINT) % d.n GROUP BY ALL) SELECT method, round((SELECT avg(mase) FROM v WHERE v.method = mm.method), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM mm GROUP BY method")
def bootstrap_ci(spark, sf_dir):
    return _rounded(stats.bootstrap_by_digest(_series_errors(spark, sf_dir), "method", "mase", 2000))


@query(f"WITH {_RES} SELECT dataset, method, value FROM res WHERE dataset IN ('pm', 'pd') AND method NOT LIKE '%mean%'")
def selected_datasets(spark, sf_dir):
    return results(spark, sf_dir).where(F.col("dataset").isin("pm", "pd") & ~F.col("method").contains("mean"))


@query(f"WITH {_RES} SELECT dataset, method FROM res a WHERE EXISTS (SELECT 1 FROM res b WHERE b.dataset = a.dataset AND b.method = 'snaive' AND b.value < 1)")
def available_pairs(spark, sf_dir):
    """What has a counterpart in another store."""
    r = results(spark, sf_dir)
    return r.join(r.where("method = 'snaive' AND value < 1").select("dataset"), "dataset", "left_semi").select("dataset", "method")


@query(f"WITH {_RES} SELECT DISTINCT dataset FROM res")
def dedupe_keys(spark, sf_dir):
    r = results(spark, sf_dir)
    return r.unionByName(r).dropDuplicates(["dataset"]).select("dataset")


@query(f"WITH {_RES} SELECT dataset, method FROM res WHERE NOT (dataset IN ('pm', 'ph') AND method <> 'mean')")
def resume_pending(spark, sf_dir):
    """What a stopped run has left to do."""
    path, r = tables.fresh_path(spark, "log"), results(spark, sf_dir)
    tables.append_new(r.where("dataset IN ('pm', 'ph') AND method <> 'mean'"), path, ["dataset", "method"])
    return tables.pending(r.select("dataset", "method"), path, ["dataset", "method"])


@query(f"WITH {_RES} SELECT * FROM res")
def keyed_append(spark, sf_dir):
    """Two runs that overlap leave one row a key."""
    path, r = tables.fresh_path(spark, "log"), results(spark, sf_dir)
    for part in (r.where("dataset IN ('pm', 'ph')"), r.where("dataset <> 'pd'"), r, r):
        tables.append_new(part, path, ["dataset", "method"])
    return spark.read.parquet(path).select("dataset", "method", "value")


@query(f"WITH {_RES} SELECT string_agg(method || chr(9), '' ORDER BY method) AS value FROM res WHERE dataset = 'pm'")
def tab_list(spark, sf_dir):
    path = tables.fresh_path(spark, "list")
    tables.write_list(results(spark, sf_dir).where("dataset = 'pm'"), "method", path)
    return spark.read.text(path)


# --- gaps between history and forecast ----------------------------------------------------------------------------------------------


def gaps(spark: SparkSession, sf_dir: str, least: int = 20, top: int = 3) -> DataFrame:
    """(dataset, series, gap, place): distance of the first forecast from the last training value in training deviations, the ``top`` least of each dataset.

    Series with less training history than twice the horizon or ``least``, or without variation, are left out.
    """
    first, out = stored(spark, sf_dir).where("method = 'mean' AND h = 1").select("dataset", "series", F.col("pred").alias("f0")), None
    for name in DATASETS:
        h = PANELS[name][7]
        r = panel(spark, sf_dir, name).withColumn("r", F.row_number().over(design.back())).where(F.col("r") > h)
        own = r.groupBy("series").agg(F.count("*").alias("n"), F.stddev_pop("y").alias("sd"), F.max_by("y", "index").alias("last")).where((F.col("n") >= max(2 * h, least)) & (F.col("sd") > 0))
        own = own.select(F.lit(name).alias("dataset"), "series", "sd", "last")
        out = own if out is None else out.unionByName(own)
    scored = out.join(first, ["dataset", "series"]).withColumn("gap", F.round(F.abs(F.col("f0") - F.col("last")) / F.col("sd"), 6))
    place = F.row_number().over(W.partitionBy("dataset").orderBy("gap", "series"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select("dataset", "series", "gap", "place")


_GAPS = f"{_FA}, gp AS ({' UNION ALL '.join(f'''SELECT '{n}' AS dataset, series, count(*) AS n, stddev_pop(y) AS sd, arg_max(y, index) AS last, {max(2 * PANELS[n][7], 20)} AS least FROM {n}r WHERE r >= {PANELS[n][7]} GROUP BY series''' for n in DATASETS)}), gq AS (SELECT dataset, series, round(abs(pred - last) / sd, 6) AS gap FROM gp JOIN fa USING (dataset, series) WHERE method = 'mean' AND h = 1 AND n >= least AND sd > 0), gr AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY gap, series) AS INTEGER) AS place FROM gq)"


@query(f"WITH {_GAPS} SELECT * FROM gr WHERE place <= 3")
def top_gap_per_dataset(spark, sf_dir):
    return gaps(spark, sf_dir)


@query(f"WITH {_GAPS} SELECT dataset, series, gap FROM gr WHERE place = 1 ORDER BY gap, dataset LIMIT 3")
def gap_picks(spark, sf_dir):
    """The least gaps overall, one series a dataset."""
    return gaps(spark, sf_dir, top=1).orderBy("gap", "dataset").limit(3).select("dataset", "series", "gap")


# --- cross-validation log -----------------------------------------------------------------------------------------------------------

_CELLS = [(k, 1.0, a, b) for k in (1, 2, 4, 8) for a in (0.0, 0.5) for b in (0.0, 0.2)]


def cv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, depth, decay, lam, beta, err) of rolling origins on the daily panel: means of the last ``depth`` values, mixed with the mean of all and the last."""
    p = panel(spark, sf_dir, "pd").select("series", "index", "y")
    rows = design.cv_folds(p, 5, 3).join(p, ["series", "index"])
    r = F.row_number().over(W.partitionBy("fold", "series").orderBy(F.col("index").desc()))
    train = rows.where("part = 'train'").withColumn("r", r).groupBy("fold", "series")
    train = train.agg(F.avg("y").alias("m"), F.max_by("y", "index").alias("l"), *[F.avg(F.when(F.col("r") <= k, F.col("y"))).alias(f"m_{k}") for k in (1, 2, 4, 8)])
    cell = lambda k, d, a, b: F.struct(F.lit(k).alias("depth"), F.lit(d).alias("decay"), F.lit(a).alias("lam"), F.lit(b).alias("beta"), ((1 - a - b) * F.col(f"m_{k}") + a * F.col("m") + b * F.col("l")).alias("pred"))
    test = rows.where("part = 'test'").join(train, ["fold", "series"]).select("fold", "y", F.explode(F.array(*[cell(*c) for c in _CELLS])).alias("c"))
    return test.groupBy("fold", "c.depth", "c.decay", "c.lam", "c.beta").agg(F.round(F.avg(F.abs(F.col("y") - F.col("c.pred"))), 6).alias("err"))


_CV = f"""{PD}, rr AS (SELECT series, index, y, row_number() OVER (PARTITION BY series ORDER BY index DESC) - 1 AS r, count(*) OVER (PARTITION BY series) AS n FROM pd),
ff AS (SELECT rr.*, fold FROM rr, (SELECT unnest(range(0, 5)) AS fold) WHERE n - (5 - fold) * 3 >= 1),
tr AS (SELECT fold, series, avg(y) AS m, arg_max(y, index) AS l, {', '.join(f'avg(y) FILTER (r < (5 - fold) * 3 + {k}) AS m_{k}' for k in (1, 2, 4, 8))} FROM ff WHERE r >= (5 - fold) * 3 GROUP BY ALL),
ce AS ({' UNION ALL '.join(f"SELECT ff.fold, {k} AS depth, {d}::DOUBLE AS decay, {a}::DOUBLE AS lam, {b}::DOUBLE AS beta, abs(y - ((1 - {a!r}::DOUBLE - {b!r}::DOUBLE) * m_{k} + {a!r}::DOUBLE * m + {b!r}::DOUBLE * l)) AS e FROM ff JOIN tr USING (fold, series) WHERE r // 3 = 4 - fold" for k, d, a, b in _CELLS)}),
lg AS MATERIALIZED (SELECT CAST(fold AS INTEGER) AS fold, depth, decay, lam, beta, round(avg(e), 6) AS err FROM ce GROUP BY ALL), g AS MATERIALIZED (SELECT depth, decay, lam, beta, round(avg(err) + 1e-9, 6) AS err FROM lg GROUP BY ALL)"""
_VARIANT = "CASE WHEN lam = 0 AND beta = 0 THEN 'base' WHEN beta = 0 THEN 'deriv' WHEN lam = 0 THEN 'seas' ELSE 'both' END"


@query(f"WITH {_CV} SELECT * FROM lg")
def cv_log_rows(spark, sf_dir):
    """Through a CSV file and back."""
    path = tables.fresh_path(spark, "cv")
    cv_log(spark, sf_dir).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="fold int, depth int, decay double, lam double, beta double, err double")


def _cells(spark, sf_dir) -> DataFrame:
    return cv_log_rows(spark, sf_dir).groupBy("depth", "decay", "lam", "beta").agg(F.round(F.avg("err") + 1e-9, 6).alias("err"))


@query(f"WITH {_CV} SELECT * FROM g ORDER BY err, depth, decay, lam, beta LIMIT 1")
def cv_best_params(spark, sf_dir):
    """Picked from the log, through a JSON file and back."""
    path = tables.fresh_path(spark, "best")
    tables.write_json(_cells(spark, sf_dir).orderBy("err", "depth", "decay", "lam", "beta").limit(1), path)
    return spark.read.schema("depth int, decay double, lam double, beta double, err double").json(path)


@query(f"WITH {_CV} SELECT variant, depth, err FROM (SELECT *, {_VARIANT} AS variant, row_number() OVER (PARTITION BY {_VARIANT} ORDER BY err, depth, decay, lam, beta) AS r FROM g) WHERE r = 1")
def cv_variant_pick(spark, sf_dir):
    rows = _cells(spark, sf_dir).withColumn("variant", F.expr(_VARIANT))
    return rows.withColumn("r", F.row_number().over(W.partitionBy("variant").orderBy("err", "depth", "decay", "lam", "beta"))).where("r = 1").select("variant", "depth", "err")


@query(f"WITH {_CV} SELECT depth, 1.0::DOUBLE AS w_0, lam AS w_1, beta AS w_2, err FROM g")
def parse_weights(spark, sf_dir):
    """Group weights that a log holds as text."""
    text = _cells(spark, sf_dir).select("depth", F.concat(F.lit("[1.0, "), "lam", F.lit(", "), "beta", F.lit("]")).alias("weights"), "err")
    w = F.from_json("weights", "array<double>")
    return text.select("depth", *[w[k].alias(f"w_{k}") for k in range(3)], "err")


# --- small operators ----------------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, round(stddev_samp(l_extendedprice) / avg(l_extendedprice) * 100, 6) AS cv, round(sqrt(avg(l_quantity * l_quantity) - avg(l_quantity) ** 2), 6) AS std FROM lineitem GROUP BY 1")
def variation(spark, sf_dir):
    """The coefficient of variation, and a deviation out of count, sum and sum of squares."""
    q = F.col("l_quantity").cast("double")
    sums = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.stddev_samp("l_extendedprice") / F.avg("l_extendedprice") * 100).alias("cv"), F.count(q).alias("n"), F.sum(q).alias("s1"), F.sum(q * q).alias("s2"))
    return _rounded(sums.select("l_returnflag", "cv", F.sqrt(F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2).alias("std")))


@query(f"WITH {_FA} SELECT series, round(100 * avg(abs(pred - actual) / (greatest(abs(actual) + abs(pred) + 0.5, 0.5) / 2)), 5) AS msmape FROM fa WHERE dataset = 'pm' AND method = 'snaive' AND h = {H} GROUP BY series")
def msmape_sweep(spark, sf_dir):
    return _rounded(metrics.msmape_sweep(stored(spark, sf_dir).where("dataset = 'pm' AND method = 'snaive'"), last_only=True), 5)


@query(f"WITH {_FA} SELECT round(avg(200 * abs(actual - pred) / greatest(0.6, abs(actual) + abs(pred) + 0.1)), 5) AS msmape FROM fa WHERE method = 'naive'")
def msmape_all(spark, sf_dir):
    return _rounded(metrics.msmape_of(stored(spark, sf_dir).where("method = 'naive'")), 5)


_PW = panel_sql("pw")


@query(f"WITH {_PW}, k AS (SELECT series, index, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, y, cov, row_number() OVER (PARTITION BY series ORDER BY index DESC) <= 4 AS is_test FROM pw WINDOW w AS (PARTITION BY series ORDER BY index)), k2 AS (SELECT * FROM k WHERE lag_2 IS NOT NULL), m AS (SELECT series, CASE WHEN avg(lag_1) = 0 THEN 1 ELSE avg(lag_1) END AS m, avg(cov) AS c FROM k2 WHERE NOT is_test GROUP BY series) SELECT series, index, round(lag_1 / m, 6) AS lag_1, round(lag_2 / m, 6) AS lag_2, round(y / m, 6) AS ahead_0, round(cov / nullif(c, 0), 6) AS cov FROM k2 JOIN m USING (series)")
def normalize_external(spark, sf_dir):
    """Lags and targets over their mean, a covariate over its own."""
    rows = design.tail_split(design.lag_lead(panel(spark, sf_dir, "pw"), 2, 1, keep=("cov",)), 4)
    return _rounded(design.normalized(rows, rows.where("NOT is_test"), ["lag_1", "lag_2", "ahead_0"], ["cov"]).select("series", "index", "lag_1", "lag_2", "ahead_0", "cov"))


@query(f"WITH {PM}, k AS (SELECT series, index, lag(y, 1) OVER w AS lag_1, y AS a0, lead(y, 1) OVER w AS a1, lead(y, 2) OVER w AS a2, lead(y, 3) OVER w AS a3 FROM pm WINDOW w AS (PARTITION BY series ORDER BY index)) SELECT series, index, lag_1, a0 AS ahead_0, a1 - a0 AS der_1_ahead_1, a2 - a1 AS der_1_ahead_2, (a2 - a1) - (a1 - a0) AS der_2_ahead_2 FROM k WHERE lag_1 IS NOT NULL AND a2 IS NOT NULL")
def extended_derivatives(spark, sf_dir):
    """As many orders of differences as steps and more: further steps are made for them."""
    rows = design.derivatives(design.lag_lead(panel(spark, sf_dir, "pm"), 1, 3), 3, 2)
    return rows.select("series", "index", "lag_1", "ahead_0", "der_1_ahead_1", "der_1_ahead_2", "der_2_ahead_2")


@query("WITH e AS (SELECT l_returnflag AS p, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1), c AS (SELECT p, CAST(least(floor((l_quantity - lo) / (hi - lo) * 64), 63) AS INTEGER) AS bin, CAST(min(l_quantity) AS DOUBLE) AS a, CAST(max(l_quantity) AS DOUBLE) AS z, count(*) AS n FROM lineitem JOIN e ON p = l_returnflag GROUP BY 1, 2), s AS (SELECT p, CAST(bin AS INTEGER) AS bin FROM e, (SELECT unnest(range(0, 64)) AS bin)) SELECT s.p, s.bin, last_value(a IGNORE NULLS) OVER w AS bin_min, last_value(z IGNORE NULLS) OVER w AS bin_max, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (p, bin) WINDOW w AS (PARTITION BY s.p ORDER BY s.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def equal_width_edges(spark, sf_dir):
    return binning.equal_width_edges(read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("p"), F.col("l_quantity").alias("v")), 64)


@query("WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), c AS (SELECT CAST(least(floor((l_quantity - lo) / (hi - lo) * 7), 6) AS INTEGER) AS bin, l_quantity AS v FROM lineitem, e) SELECT v.bin, m.m AS value, count(*) AS n FROM c v JOIN (SELECT bin, CAST(min(v) AS DOUBLE) AS m FROM c GROUP BY bin) m ON m.bin = v.bin GROUP BY ALL")
def bin_values(spark, sf_dir):
    """Values out of bin numbers again, by a list of the bins' least values."""
    rows = binning.equal_width(read(spark, sf_dir, "lineitem").select(F.lit(0).alias("p"), F.col("l_quantity").cast("double").alias("v")), 7)
    edges = rows.groupBy("bin").agg(F.min("v").alias("lo")).agg(F.map_from_entries(F.collect_list(F.struct("bin", "lo"))).alias("values"))  # seven entries
    return rows.join(F.broadcast(edges)).groupBy("bin", F.element_at("values", F.col("bin")).alias("value")).agg(F.count("*").alias("n"))


@query(f"WITH {PM} SELECT series, index, CAST(row_number() OVER (PARTITION BY series ORDER BY CAST(y - 100000 AS FLOAT) + 0, index) AS INTEGER) AS place FROM pm")
def ordered_places(spark, sf_dir):
    """A stable order of values in single precision; ties, and zeros of either sign, go by position."""
    key = (F.col("y") - 100000).cast("float") + F.lit(0).cast("float")
    return panel(spark, sf_dir, "pm").select("series", "index", F.row_number().over(W.partitionBy("series").orderBy(key, "index")).alias("place"))


@query()
def feature_draws(spark, sf_dir):
    """Draws of features by the twister, as a table."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(kernel.drawn_features(5489, 10, 4, 6))], "draw int, features array<int>")


@query(f"WITH {_FA} SELECT 'T' || dense_rank() OVER (ORDER BY series) AS series, h, pred AS value FROM fa WHERE dataset = 'pm' AND method = 'snaive'")
def matrix_file(spark, sf_dir):
    """Forecasts through a text file of one line a series, whose series have no names."""
    path, rows = tables.fresh_path(spark, "matrix"), stored(spark, sf_dir).where("dataset = 'pm' AND method = 'snaive'")
    wide = tables.wide_forecasts(rows, H).orderBy("series").select(F.concat_ws(" ", *[F.col(f"h_{h}").cast("string") for h in range(1, H + 1)]).alias("value"))
    wide.coalesce(1).write.text(path)  # one line a series of one panel
    return tables.read_matrix(spark, path).select("series", F.col("h").cast("int").alias("h"), "value")


@query(f"WITH {_RES} SELECT CAST(seed AS INTEGER) AS seed, dataset, method, value FROM res, (SELECT unnest([7, 11]) AS seed) WHERE seed = 7 OR dataset <> 'ph'")
def seed_files(spark, sf_dir):
    """Result files of several seeds; the seed is in a file's name."""
    path, r = tables.fresh_path(spark, "seeds"), results(spark, sf_dir)
    tables.write_csv_file(r, path, "run_7.csv")
    tables.write_csv_file(r.where("dataset <> 'ph'"), path, "run_11.csv")
    return tables.read_seeds(spark, f"{path}/*.csv", "dataset string, method string, value double").select("seed", "dataset", "method", "value")


@query(f"WITH {_ER} SELECT series, round(mase, 5) AS mase FROM er WHERE dataset = 'pm' AND method = 'snaive'")
def mase_of_history(spark, sf_dir):
    """The scale out of each series' training rows alone."""
    p = panel(spark, sf_dir, "pm")
    history = design.tail_split(p, H).where("NOT is_test")
    return _rounded(metrics.mase_of_history(stored(spark, sf_dir).where("dataset = 'pm' AND method = 'snaive'").drop("scale"), history, PANELS["pm"][6]), 5)


@query(f"{Q._grown_sql('pm', 8, 3, 5)} SELECT h, round(mse + 1e-9, 6) AS mse FROM ({' UNION ALL '.join(f'SELECT {k + 1} AS h, avg((ahead_{k} - m_ahead_{k}) ** 2) AS mse FROM g0leaves JOIN g0nodes ON node_id = node' for k in range(3))})")
def model_score(spark, sf_dir):
    """An estimator's squared errors by step, on the rows it was fitted on."""
    rows = Q.supervised(spark, sf_dir).where("NOT is_test")
    model = TreeModel(PanelData(3, 3, 1, 12, ("sin_season", "cos_season")), 0.5, (1.0, 0.5, 0.2), max_depth=3, min_leaf=5, bins=8).fit(rows)
    return model.score(model.predict(rows)).select("h", F.round(F.col("mse") + 1e-9, 6).alias("mse"))


# --- panels from files --------------------------------------------------------------------------------------------------------------


def _loaded(spark: SparkSession, sf_dir: str, name: str, frequency: str, covariate: bool = False) -> DataFrame:
    path, p = tables.fresh_path(spark, "collection"), panel(spark, sf_dir, name)
    own = p.withColumn("series", F.concat(F.lit("T_"), "series"))
    if covariate:
        own = own.select("series", "index", "timestamp", "y").unionByName(p.select(F.concat(F.lit("C_"), "series").alias("series"), "index", "timestamp", F.col("cov").alias("y")))
    tsf.write_tsf(own, path, frequency, PANELS[name][7], start=True)
    return loader.load_panel(spark, path)[0]


def _load_query(key: str, name: str, frequency: str, covariate: bool = False) -> None:
    def f(spark, sf_dir):
        return _loaded(spark, sf_dir, name, frequency, covariate)

    f.__name__ = key
    query(f"WITH {panel_sql(name)} SELECT 'T_' || series AS series, index, timestamp, y{', cov AS C' if covariate else ''}, season_index FROM {name}")(f)


_load_query("load_hourly", "ph", "hourly")
_load_query("load_weekly_covariate", "pw", "weekly", True)
_load_query("load_monthly", "pm", "monthly")
_load_query("load_quarterly", "pq", "quarterly")
_load_query("load_yearly", "py", "yearly")


@query(f"WITH {PM} SELECT series AS unique_id, CAST(TIMESTAMP '1900-01-01' + to_months(CAST(index AS INTEGER)) AS TIMESTAMP) AS ds, y FROM pm")
def long_frame(spark, sf_dir):
    """Series without a start begin in 1900."""
    path = tables.fresh_path(spark, "collection")
    tsf.write_tsf(panel(spark, sf_dir, "pm"), path, "monthly", H)
    table, meta = tsf.read_tsf(spark, path)
    return loader.long_frame(table, meta["frequency"])

