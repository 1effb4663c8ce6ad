"""All queries of the forecasting library by name; each is a thin use of an operator on series made from the tables."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quandrel.functions.calendar import calendar_features, feature_columns
from quandrel.functions.freq import Freq
from quandrel.functions.quantiles import LEVELS
from quandrel.functions.transform import Transform, yeo_johnson, yeo_johnson_inverse
from quandrel.operators import calibrate, compare, forecast, metrics, predictors, series
from quandrel.operators.backtest import Backtest, fold, rolling_folds
from quandrel.plans.sql import ORACLES
from quandrel.sources import energy, rates, store, tables
from quandrel.sources.tables import BDAY, DAY, HOUR

__all__ = ["ORACLES", "QUERIES"]
EVENT_LEADS, DAY_LEADS = (1, 6, 24), (1, 7)
CHOSEN_EVENTS = ["click", "purchase"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def r(c: Column | str, d: int = 6) -> Column:
    return F.round(c, d)


def at(text: str) -> Column:
    return F.lit(datetime.fromisoformat(text)).cast("timestamp_ntz")


def quantile_rows(forecasts: DataFrame, decimals: int = 6) -> DataFrame:
    rows = forecast.explode_quantiles(forecasts.filter("q is not null"), LEVELS)
    return rows.select("item_id", "timestamp", "lead_time", "quantile", r("pred", decimals).alias("pred"))


# events, hourly ---------------------------------------------------------------------------------------------------------
def event_forecasts(spark, d) -> tuple[DataFrame, DataFrame]:
    s = tables.events_hourly(spark, d)
    return s, predictors.RollingQuantiles(leads=EVENT_LEADS, last_n=100).predict(s)


def event_aligned(spark, d) -> DataFrame:
    s, f = event_forecasts(spark, d)
    return forecast.align(f, s, HOUR)


def event_crps(spark, d) -> DataFrame:
    return metrics.crps_rows(event_aligned(spark, d), LEVELS, max(EVENT_LEADS))


def series_duplicates(spark, d):
    rows = tables.table(spark, d, "events").select(F.col("event_type").alias("item_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"))
    return series.duplicates(rows)


def continuity_gaps(spark, d):
    before, after = series.split_by_time(tables.orders_rows(spark, d), datetime(1998, 1, 1))
    return series.continuity_gaps(before, after, DAY)


def wide_to_long(spark, d):
    wide = tables.lineitem_rows(spark, d).groupBy("timestamp").pivot("item_id", ["A", "N", "R"]).agg(F.first("target"))
    return series.wide_to_long(wide, ["A", "N", "R"])


def dedupe_first(spark, d):
    orders = tables.table(spark, d, "orders")
    first = series.dedupe_first(orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey").join(orders.groupBy("o_custkey").agg(F.count("*").alias("n_all")), "o_custkey")


def fx_align(spark, d):
    rows = tables.orders_rows(spark, d).filter(F.weekday("timestamp") < 5)
    stem = F.concat(F.lit("DEX"), F.substring("item_id", 3, 2), F.when(F.col("item_id") < "3", "US").otherwise("CA"))
    named = rows.withColumn("item_id", stem).withColumn("target", rates.upright(F.col("target"), F.col("item_id")))
    return rates.aligned(named).select(rates.symbol_of(F.col("item_id")).alias("symbol"), "timestamp", r("target", 9).alias("target"))


def split_roles(spark, d):
    year = pd.DateOffset(years=1)
    return series.split_roles(tables.orders_daily(spark, d), fold(datetime(1999, 1, 1), pd.DateOffset(years=3), year, year)).select("item_id", "timestamp", "role")


def split_by_time(spark, d):
    before, after = series.split_by_time(tables.orders_daily(spark, d), datetime(1998, 6, 1))
    both = before.withColumn("after", F.lit(False)).unionByName(after.withColumn("after", F.lit(True)))
    return both.groupBy("after").agg(F.count("*").alias("n"), F.count("target").alias("n_known"))


def drop_null_items(spark, d):
    """All orders by priority, without the priority whose targets are masked."""
    return series.drop_null_items(tables.orders_daily(spark, d).withColumn("target", F.when(~F.startswith("item_id", F.lit("1")), F.col("target"))))


def context_tail(spark, d):
    before, after = series.split_by_time(tables.orders_daily(spark, d), datetime(2001, 1, 1))
    return series.with_context(after, before, 30)


def common_items(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("item_id"), "l_shipdate")
    return series.common_items(rows.filter(F.col("l_shipdate") < at("1995-03-01")), rows.filter(F.col("l_shipdate") >= at("2001-06-01")))


def seasonal_fc(spark, d):
    return quantile_rows(predictors.SeasonalQuantiles(leads=(1, 24), freq=HOUR).predict(tables.events_hourly(spark, d)))


def walk_forecasts(s: DataFrame) -> DataFrame:
    model = predictors.RandomWalk(leads=DAY_LEADS)
    return model.predict(s, model.fit(s.filter(F.col("timestamp") < at("1999-01-01"))))


def bday_leads(spark, d):
    s = tables.orders_bday(spark, d)
    return forecast.align(forecast.over_leads(s.select("item_id", "timestamp"), (1, 3, 5, 12)), s, BDAY).select("item_id", "timestamp", "lead_time", "prediction_date", "target")


def wide_horizon(spark, d):
    wide = forecast.wide_horizon(event_aligned(spark, d), 6, LEVELS)
    return wide.select("item_id", "timestamp", *(r(c).alias(c) for c in wide.columns if c[0] == "q"), "prediction_date", "target")


def trajectory(spark, d):
    s, f = event_forecasts(spark, d)
    rows = forecast.trajectory(forecast.align(f, s, HOUR), s, HOUR, start=-30, context=24)
    return rows.select("item_id", "at", "kind", "target", *(r(c).alias(c) for c in ("low", "median", "high")))


def level_rows(table: DataFrame) -> DataFrame:
    return table.withColumn("value", r("value"))


# lineitem, daily --------------------------------------------------------------------------------------------------------
def line_forecasts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = tables.lineitem_daily(spark, d)
    f = predictors.RollingQuantiles(leads=DAY_LEADS, last_n=50, freq=DAY).predict(s)
    return s, f, forecast.align(f, s, DAY)


def eqc_offsets(spark, d):
    offsets = calibrate.EmpiricalOffset(large=True).fit(line_forecasts(spark, d)[2]).withColumnRenamed("offsets", "q")
    return forecast.explode_quantiles(offsets, LEVELS).select("item_id", "lead_time", "quantile", r("pred").alias("offset_value"))


def calibrated(spark, d, post, decimals=6):
    _, f, aligned = line_forecasts(spark, d)
    return quantile_rows(post.apply(f, post.fit(aligned)), decimals)


def gauss_rows(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    return calibrate.GaussianCalibration().rows(line_forecasts(spark, d)[2])


def standardise_stats(spark, d):
    scale = gauss_rows(spark, d)[1]
    return scale.select("item_id", "lead_time", r("y_mean").alias("y_mean"), r("y_std").alias("y_std"))


def centred_std(spark, d):
    return gauss_rows(spark, d)[0].select("item_id", "lead_time", "timestamp", r("sigma", 6).alias("sigma"))


def ols_init(spark, d):
    rows, _, keys = gauss_rows(spark, d)
    return calibrate.GaussianCalibration().start(rows, keys).select(*keys, *(r(c, 5).alias(c) for c in "abcd"))


def gauss_nll(spark, d):
    rows, _, keys = gauss_rows(spark, d)
    lines = calibrate.GaussianCalibration().start(rows, keys)
    mu, sigma = F.col("a") + F.col("b") * F.col("m"), F.col("c") + F.col("d") * F.col("spread")
    return rows.join(lines, keys).groupBy(*keys).agg(r(calibrate.negative_log_likelihood(F.col("y"), mu, sigma), 3).alias("nll"))


def transformed(t: Transform):
    def query(spark, d):
        rows = tables.lineitem_daily(spark, d).withColumn("z", t.forward(F.col("target")))
        return rows.select("item_id", "timestamp", r("z", 6).alias("z"), r(t.inverse(F.col("z")), 3).alias("back"))

    return query


def yeo_johnson_fixed(spark, d):
    rows = tables.lineitem_daily(spark, d).withColumn("z", yeo_johnson((F.col("target") - 100000) / 1000, F.lit(0.25)))
    return rows.select("item_id", "timestamp", r("z", 6).alias("z"), r(yeo_johnson_inverse(F.col("z"), F.lit(0.25)), 6).alias("back"))


def window_rows(make, name):
    return lambda spark, d: make(tables.orders_daily(spark, d)).select("item_id", "timestamp", F.posexplode(name).alias("pos", "value"))


def sample_quantiles(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("item_id"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("timestamp"), F.col("l_linenumber").alias("lead_time"), F.col("l_extendedprice").alias("value"))
    return quantile_rows(predictors.sample_quantiles(rows, LEVELS, large=True))


def calendar_query(spark, d):
    rows = calendar_features(tables.events_rows(spark, d).withColumn("lead_time", F.lit(6)), HOUR)
    return rows.select("item_id", "timestamp", "target", *(F.col(c) if c in ("delta_hour", "delta_weekday") else r(c).alias(c) for c in feature_columns() if c != "target"))


def custom_model_fc(spark, d):
    leads = (1, 24)
    model = predictors.ContextModel(predictors.quantiles_of_context(LEVELS, leads), leads=leads, length=48, chunk=500)
    return quantile_rows(model.predict(tables.events_hourly(spark, d))).filter("pred is not null")


def calendar_qr_fc(spark, d):
    s = tables.lineitem_daily(spark, d)
    model = predictors.CalendarRegression(leads=(7,), freq=DAY, levels=(0.1, 0.5, 0.9))
    f = model.predict(s, model.fit(s.filter(F.col("timestamp") < at("2000-01-01")))).filter("q is not null")
    return forecast.explode_quantiles(f, (0.1, 0.5, 0.9)).select("item_id", "timestamp", "lead_time", "quantile", r("pred").alias("pred"))


# orders, daily: three models --------------------------------------------------------------------------------------------
def model_aligned(spark, d) -> DataFrame:
    s = tables.orders_daily(spark, d)
    named = {"roll30": predictors.RollingQuantiles(leads=DAY_LEADS, last_n=30).predict(s), "roll100": predictors.RollingQuantiles(leads=DAY_LEADS, last_n=100).predict(s), "walk": walk_forecasts(s)}
    rows = None
    for name, f in named.items():
        f = f.withColumn("model", F.lit(name))
        rows = f if rows is None else rows.unionByName(f)
    return forecast.align(rows, s, DAY)


def model_crps(spark, d) -> DataFrame:
    return metrics.crps_rows(model_aligned(spark, d), LEVELS, max(DAY_LEADS), ["model"])


def model_mean(spark, d) -> DataFrame:
    return compare.model_crps(model_crps(spark, d)).filter("lead_time is null")


def crps_by_period(spark, d):
    return compare.rounded(compare.crps_by_period(model_crps(spark, d), [datetime(1997, 1, 1), datetime(1999, 7, 1)]), 2)


def pairs(spark, d) -> DataFrame:
    return compare.paired(model_crps(spark, d), "roll30", "walk")


def break_test(spark, d):
    out = compare.break_test(pairs(spark, d), datetime(1999, 1, 1), ["lead_time"])
    return out.select("lead_time", "n0", "n1", r("before", 2).alias("before"), r("change", 2).alias("change"), r("se", 2).alias("se"), r("t").alias("t"))


def backtest_rows(spark, d, folds):
    """The train window of a fold doesn't shorten what its forecasts look back at."""
    run = Backtest(predictors.RollingQuantiles(leads=DAY_LEADS, last_n=30, freq=DAY), {"eqc": calibrate.EmpiricalOffset()}, DAY)
    out = run.run_folds(tables.lineitem_daily(spark, d), folds)
    return out.select("fold_id", "model", "item_id", "timestamp", "lead_time", r(F.col("q")[0]).alias("q10"), r(F.col("q")[4]).alias("q50"), r(F.col("q")[8]).alias("q90"))


YEAR = pd.DateOffset(years=1)
FOLDS = rolling_folds(datetime(1999, 1, 1), datetime(2001, 6, 1), YEAR, None, YEAR)
SHORT_TRAIN = rolling_folds(datetime(1999, 1, 1), datetime(2000, 1, 1), YEAR, pd.DateOffset(days=370), YEAR)


def calibrated_on(source: str):
    """The first fold, calibrated on its train rows, or on its train and val rows."""
    def query(spark, d):
        run = Backtest(predictors.RollingQuantiles(leads=DAY_LEADS, last_n=30, freq=DAY), {"eqc": calibrate.EmpiricalOffset()}, DAY, calibration=source)
        out = run.run(tables.lineitem_daily(spark, d), FOLDS[0])
        return out.select("model", "item_id", "timestamp", "lead_time", r(F.col("q")[0]).alias("q10"), r(F.col("q")[4]).alias("q50"), r(F.col("q")[8]).alias("q90"))

    return query


# views, filters and files -----------------------------------------------------------------------------------------------
def factorized(spark, d):
    coded, mapping = series.factorize(tables.orders_rows(spark, d), PRIORITIES)
    return coded.join(F.broadcast(mapping), "item_id")


def chosen_scores(spark, d):
    """Scores of two items and two leads: filters of a metric."""
    return metrics.crps_table(metrics.crps_rows(metrics.chosen(event_aligned(spark, d), CHOSEN_EVENTS, [6, 24]), LEVELS, max(EVENT_LEADS))).withColumn("crps", r("crps"))


def replaced_horizon(spark, d):
    s = tables.orders_daily(spark, d)
    short = predictors.RollingQuantiles(leads=DAY_LEADS, last_n=30).predict(s)
    return quantile_rows(forecast.put(short, predictors.RollingQuantiles(leads=(7, 14), last_n=100).predict(s), ["lead_time"]))


def stored_forecasts(spark, d):
    s, root = tables.lineitem_daily(spark, d), store.scratch_folder(spark, "runs")
    for run, n in (("short", 20), ("long", 50)):
        f = predictors.RollingQuantiles(leads=DAY_LEADS, last_n=n, freq=DAY).predict(s)
        store.save(f.withColumn("model", F.lit("roll")), root, "forecasts", run)
    return store.discovered(spark, root).filter("q is not null").select("key", "item_id", "timestamp", "lead_time", r(F.col("q")[4]).alias("q50"))


def eqc_reapplied(spark, d):
    """Offsets written as a run's parameters, and applied as they are read back."""
    _, f, aligned = line_forecasts(spark, d)
    post, root = calibrate.EmpiricalOffset(), store.scratch_folder(spark, "runs")
    store.save(post.fit(aligned), root, "params", "first")
    return quantile_rows(post.apply(f, store.params_of(spark, root, "first")))


def stored_report(spark, d):
    root = store.scratch_folder(spark, "runs")
    store.save_report(spark, root, "first", {"leads": list(DAY_LEADS)}, model_mean(spark, d).select("model", "crps"))
    leads = ",".join(map(str, store.load_config(spark, root, "first")["leads"]))
    return store.load(spark, root, "metrics").select("run", "model", r("crps").alias("crps"), F.lit(leads).alias("leads"))


def energy_files(spark, d):
    """Daily sums written as wide CSVs in two folders, whose columns stand in different orders, and read as energy files."""
    root = store.scratch_folder(spark, "energy")
    shown = [F.coalesce(F.format_number(c, 6), F.lit("-")).alias(c) for c in ("A", "N", "R")]
    wide = tables.lineitem_rows(spark, d).groupBy("timestamp").pivot("item_id", ["A", "N", "R"]).agg(F.first("target"))
    before, after = series.split_by_time(wide, datetime(1998, 1, 1))
    for name, rows, columns in (("1", before, shown), ("2", after, shown[::-1])):
        start = F.date_format("timestamp", energy.TIME_FORMAT).alias("Start date")
        rows.select(start, F.lit("x").alias("End date"), *columns).write.option("sep", ";").option("header", True).csv(f"{root}/{name}")
    s, mapping, _ = energy.energy_series(spark, [f"{root}/1", f"{root}/2"])
    return s.join(F.broadcast(mapping), "item_id").select("item_id", "name", "timestamp", r("target").alias("target"))


def rate_files(spark, d):
    """Sums by priority on weekdays as one CSV a pair, some blank, some inverse, read as a folder of rates."""
    root = store.scratch_folder(spark, "rates")
    stem = F.concat(F.lit("DEX"), F.substring("item_id", 3, 2), F.when(F.col("item_id") < "3", "US").otherwise("CA"))
    rows = tables.orders_rows(spark, d).filter(F.weekday("timestamp") < 5)
    shown = F.when(F.day("timestamp") == 13, F.lit(".")).otherwise(F.col("target").cast("decimal(20,6)").cast("string"))
    rows.select(stem.alias("stem"), F.date_format("timestamp", "yyyy-MM-dd").alias("observation_date"), shown.alias("value")).repartition("stem").write.partitionBy("stem").option("header", True).csv(f"{root}/parts")
    files = store.Files(spark, root)
    for folder in (x for x in files.names(f"{root}/parts") if x.startswith("stem=")):  # five pairs
        for k, part in enumerate(x for x in files.names(f"{root}/parts/{folder}") if x.endswith(".csv")):
            files.fs.rename(files.path(f"{root}/parts/{folder}/{part}"), files.path(f"{root}/{folder.removeprefix('stem=')}.csv"))
    s, mapping, _ = rates.rate_series(spark, root)
    return s.join(F.broadcast(mapping), "item_id").select("name", "timestamp", r("target", 9).alias("target"))


def calibration_counts(spark, d):
    """Optimality of quantile regression lines: rows below a line are at most its share, those below or on it at least."""
    aligned = line_forecasts(spark, d)[2]
    post = calibrate.QuantileRegressionCalibration()
    rows = calibrate.calibration_rows(aligned).join(post.fit(aligned), ["item_id", "lead_time"])
    each = rows.select("item_id", "lead_time", F.posexplode(F.zip_with("q", "line", lambda x, c: F.col("target") - c[0] - c[1] * x)).alias("i", "gap"))
    return optimality(each, 2)


def optimality(each: DataFrame, p: int) -> DataFrame:
    """(item_id, lead_time, quantile, n, optimal) of residuals ``gap`` by level i, for lines of ``p`` coefficients."""
    scale = F.col("scale") * 1e-4
    sizes = each.groupBy("item_id", "lead_time", "i").agg(F.stddev_pop("gap").alias("scale"))
    counts = each.join(sizes, ["item_id", "lead_time", "i"]).groupBy("item_id", "lead_time", "i").agg(F.count("*").alias("n"), F.count(F.when(F.col("gap") < -scale, 1)).alias("below"), F.count(F.when(F.col("gap") <= scale, 1)).alias("upto"))
    level = (F.col("i") + 1) / 10
    good = (F.col("below") <= F.col("n") * level + p) & (F.col("upto") >= F.col("n") * level - p)
    return counts.select("item_id", "lead_time", F.round(level, 1).alias("quantile"), "n", good.alias("optimal"))


def likelihood_gain(spark, d):
    """Rows, and whether the fitted normal law is as likely as the lines that the fit starts from."""
    post = calibrate.GaussianCalibration()
    aligned = line_forecasts(spark, d)[2]
    rows, _, keys = post.rows(aligned)
    nll = calibrate.negative_log_likelihood(F.col("y"), F.col("a") + F.col("b") * F.col("m"), F.col("c") + F.col("d") * F.col("spread"))
    of = lambda lines, name: rows.join(lines.select(*keys, *"abcd"), keys).groupBy(*keys).agg(nll.alias(name), F.count("*").alias(f"n_{name}"))
    both = of(post.start(rows, keys), "first").join(of(post.fit(aligned), "best"), keys)
    return both.select(*keys, F.col("n_best").alias("n"), (F.col("best") <= F.col("first") + 1e-6).alias("as_likely"))


def boosting_gain(spark, d):
    """Pinball loss of the constant quantile on the calibration rows, and whether boosted stumps lose less on them."""
    aligned = line_forecasts(spark, d)[2]
    rows, post = calibrate.calibration_rows(aligned), calibrate.BoostedCalibration(rounds=10)
    fitted = post.fit(aligned)
    loss = lambda gap, a: F.when(gap >= 0, gap * a).otherwise(gap * (a - 1))
    step = lambda s: F.when(F.get("q", s[0].cast("int")) <= s[1], s[2]).otherwise(s[3])
    boosted = F.zip_with("base", "stumps", lambda b, trees: F.aggregate(trees, b, lambda total, s: total + step(s)))
    each = rows.join(fitted, ["item_id", "lead_time"]).select("item_id", "lead_time", "target", F.posexplode(F.arrays_zip(F.col("base").alias("base"), boosted.alias("now"))).alias("i", "x"))
    level = (F.col("i") + 1) / 10
    sums = each.groupBy("item_id", "lead_time", "i").agg(F.avg(loss(F.col("target") - F.col("x.base"), level)).alias("first"), F.avg(loss(F.col("target") - F.col("x.now"), level)).alias("best"))
    return sums.select("item_id", "lead_time", F.round(level, 1).alias("quantile"), r("first", 3).alias("base_loss"), (F.col("best") < F.col("first")).alias("improved"))


def calendar_counts(spark, d):
    """Optimality of the calendar regression's lines on the rows that it was fitted to."""
    train = tables.lineitem_daily(spark, d).filter(F.col("timestamp") < at("2000-01-01"))
    model = predictors.CalendarRegression(leads=(7,), freq=DAY)
    f = model.predict(train, model.fit(train)).filter("q is not null")
    log = lambda c: F.ln(c + model.epsilon)  # noqa: E731  the scale of the fit; sorted quantiles are kept apart from crossings by the counts' slack
    each = forecast.align(f, train, DAY).filter("target is not null").select("item_id", "lead_time", F.posexplode(F.transform("q", lambda x: log(F.col("target")) - log(x))).alias("i", "gap"))
    return optimality(each, len(model.features) + 1)


def power_likelihood(spark, d):
    """The profile log-likelihood of fitted Yeo-Johnson powers."""
    rows = tables.lineitem_rows(spark, d).withColumn("target", F.col("target") / 100000)
    fitted = Transform("yeo-johnson").fit(rows, ["item_id"])
    z = yeo_johnson(F.col("target"), F.col("lmbda"))
    sums = rows.join(fitted, "item_id").groupBy("item_id").agg((-F.count("*") / 2 * F.ln(F.var_pop(z)) + (F.first("lmbda") - 1) * F.sum(F.signum("target") * F.log1p(F.abs("target")))).alias("l"), F.first("mean").alias("mean"))
    return sums.select("item_id", r("l", 2).alias("log_likelihood"))


def stretch(spark, d):
    return series.random_stretch(tables.orders_daily(spark, d), 40, 11)


def supplier_rolling(spark, d):
    q = predictors.rolling_quantiles(tables.lineitem_rows(spark, d, "l_suppkey"), ["item_id"], (0.1, 0.5, 0.9), 20)
    return q.select("item_id", "timestamp", *(r(F.col("q")[i]).alias(n) for i, n in enumerate(("q10", "q50", "q90"))))


def supplier_crps(spark, d):
    """Scores of raw and calibrated forecasts of a series a supplier: forecast, calibration and scores that grow with the tables."""
    model, post = predictors.RollingQuantiles(leads=(7,), last_n=20, freq=DAY), calibrate.EmpiricalOffset()
    raw = model.of_known(tables.lineitem_rows(spark, d, "l_suppkey"), tables.lineitem_span(spark, d))
    corrected = post.apply(raw.withColumn("raw", F.col("q")), post.fit(raw))
    named = F.array(F.struct(F.lit("raw").alias("model"), F.col("raw").alias("q")), F.struct(F.lit("eqc").alias("model"), F.col("q").alias("q")))
    both = corrected.select("item_id", "timestamp", "lead_time", "target", F.inline(named))
    # the origins of the last seven days have no target, so there is nothing to trim
    scores = metrics.crps_table(metrics.crps_rows(both, LEVELS, None, ["model"]), ["model"])
    return scores.select("model", "item_id", "lead_time", r("crps", 4).alias("crps"))


QUERIES = {
    "series_grid": tables.events_hourly,
    "series_duplicates": series_duplicates,
    "series_extent": lambda spark, d: series.extent(tables.orders_rows(spark, d)),
    "continuity_gaps": continuity_gaps,
    "wide_to_long": wide_to_long,
    "dedupe_first": dedupe_first,
    "fx_align": fx_align,
    "split_roles": split_roles,
    "split_by_time": split_by_time,
    "drop_null_items": drop_null_items,
    "context_tail": context_tail,
    "last_row": lambda spark, d: series.tail(tables.events_hourly(spark, d), 1),
    "common_items": common_items,
    "roll_quantile_fc": lambda spark, d: quantile_rows(event_forecasts(spark, d)[1]),
    "seasonal_fc": seasonal_fc,
    "random_walk_fc": lambda spark, d: quantile_rows(walk_forecasts(tables.orders_daily(spark, d)), 2),
    "bday_leads": bday_leads,
    "aligned_forecasts": lambda spark, d: event_aligned(spark, d).select("item_id", "timestamp", "lead_time", "prediction_date", r(F.col("q")[4]).alias("q50"), "target"),
    "wide_horizon": wide_horizon,
    "trajectory": trajectory,
    "crps_rows": lambda spark, d: event_crps(spark, d).filter("crps is not null").withColumn("crps", r("crps")),
    "crps_item_lead": lambda spark, d: metrics.crps_table(event_crps(spark, d)).withColumn("crps", r("crps")),
    "crps_mean": lambda spark, d: metrics.crps_table(event_crps(spark, d), mean_leads=True, mean_items=True).withColumn("crps", r("crps")),
    "crps_by_lead": lambda spark, d: metrics.crps_table(event_crps(spark, d), mean_items=True).withColumn("crps", r("crps")),
    "crps_by_time": lambda spark, d: metrics.crps_over_time(event_crps(spark, d), window=24).withColumn("crps", r("crps")),
    "pinball_table": lambda spark, d: level_rows(metrics.level_table(metrics.pinball_scores(event_aligned(spark, d), LEVELS), mean_row=True)),
    "coverage_table": lambda spark, d: level_rows(metrics.level_table(metrics.coverage(event_aligned(spark, d), LEVELS))),
    "reliability": lambda spark, d: level_rows(metrics.coverage(event_aligned(spark, d), LEVELS)),
    "pit_values": lambda spark, d: metrics.pit_values(event_aligned(spark, d), LEVELS).withColumn("pit", r("pit")),
    "pit_hist": lambda spark, d: metrics.pit_histogram(metrics.pit_values(event_aligned(spark, d), LEVELS), 8, ["lead_time"]),
    "eqc_offsets": eqc_offsets,
    "eqc_apply": lambda spark, d: calibrated(spark, d, calibrate.EmpiricalOffset()),
    "standardise_stats": standardise_stats,
    "centred_std": centred_std,
    "ols_init": ols_init,
    "gauss_nll": gauss_nll,
    "transform_log": transformed(Transform("log", 1e6)),
    "transform_asinh": transformed(Transform("arcsinh")),
    "yeo_johnson_fixed_lambda": yeo_johnson_fixed,
    "context_windows": window_rows(lambda s: predictors.context_windows(s, 5), "context"),
    "future_windows": window_rows(lambda s: predictors.future_windows(s, 3), "future"),
    "sample_quantiles": sample_quantiles,
    "calendar_features": calendar_query,
    "shifted_label": lambda spark, d: forecast.shifted_label(tables.events_rows(spark, d), (1, 6), HOUR),
    "custom_model_fc": custom_model_fc,
    "model_crps_table": lambda spark, d: compare.rounded(compare.model_crps(model_crps(spark, d), "roll30"), 6),
    "model_pinball_table": lambda spark, d: level_rows(compare.model_levels(metrics.pinball_scores(model_aligned(spark, d), LEVELS, ["model"]), "roll30", mean_row=True)),
    "model_coverage_table": lambda spark, d: level_rows(compare.model_levels(metrics.coverage(model_aligned(spark, d), LEVELS, ["model"]))),
    "model_rank": lambda spark, d: compare.rounded(compare.ranked(model_mean(spark, d), "crps"), 6),
    "model_side_by_side": lambda spark, d: compare.rounded(compare.side_by_side(metrics.crps_table(model_crps(spark, d), ["model"], mean_items=True), ["lead_time"], "crps", ["roll30", "roll100", "walk"]), 6),
    "crps_models_over_time": lambda spark, d: compare.rounded(compare.model_crps_over_time(model_crps(spark, d), 30, "roll30"), 6),
    "crps_by_period": crps_by_period,
    "paired_diff": lambda spark, d: compare.rounded(pairs(spark, d).filter("a is not null and b is not null"), 4),
    "break_test": break_test,
    "backtest_train_window": lambda spark, d: backtest_rows(spark, d, SHORT_TRAIN),
    "backtest_single": lambda spark, d: backtest_rows(spark, d, FOLDS[:1]),
    "backtest_rolling": lambda spark, d: backtest_rows(spark, d, FOLDS),
    "supplier_rolling": supplier_rolling,
    "supplier_crps": supplier_crps,
    "backtest_on_train": calibrated_on("train"),
    "backtest_on_train_val": calibrated_on("train_val"),
    "factorized": factorized,
    "chosen_scores": chosen_scores,
    "lead_times": lambda spark, d: forecast.lead_times(event_forecasts(spark, d)[1]),
    "replaced_horizon": replaced_horizon,
    "stored_forecasts": stored_forecasts,
    "eqc_reapplied": eqc_reapplied,
    "stored_report": stored_report,
    "energy_files": energy_files,
    "rate_files": rate_files,
    "random_stretch": stretch,
    "transform_none": transformed(Transform("none")),
    "power_likelihood": power_likelihood,
    "qr_optimality": calibration_counts,
    "calendar_optimality": calendar_counts,
    "mle_likelihood": likelihood_gain,
    "gb_improvement": boosting_gain,
    "qr_calibrated": lambda spark, d: calibrated(spark, d, calibrate.QuantileRegressionCalibration()),
    "mle_calibrated": lambda spark, d: calibrated(spark, d, calibrate.GaussianCalibration()),
    "gb_calibrated": lambda spark, d: calibrated(spark, d, calibrate.BoostedCalibration()),
    "calendar_qr_fc": calendar_qr_fc,
}
