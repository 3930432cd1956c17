"""Queries over runs: performance, factors, validation, universe, machine learning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventalpha.functions.normal import best_of
from eventalpha.operators import joins as J
from eventalpha.operators import ml as ML
from eventalpha.operators import perf as P
from eventalpha.operators import quality as Q
from eventalpha.operators import risk as R
from eventalpha.operators import sweeps as SW
from eventalpha.operators import universe as U
from eventalpha.operators import validation as V
from eventalpha.operators.folds import Fold
from eventalpha.plans.base import events, factors, filings, prices, query, returns, scored, signals, table, ticker, universe
from eventalpha.plans.signal_queries import rounded

# Returns of the runs, scaled so that compounding stays in range.
_RUNS = "runs AS (SELECT run_id, date, ret / 40 AS ret FROM rets)"


def runs(spark, d):
    return returns(spark, d).withColumn("ret", F.col("ret") / 40)


_RM = f"""{_RUNS}, eqd AS (SELECT run_id, date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY run_id ORDER BY date)) AS equity FROM runs),
    ddn AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY run_id ORDER BY date), 1) - 1 AS drawdown FROM eqd),
    rm AS (SELECT run_id, count(*) AS n, exp(sum(ln(1 + ret))) - 1 AS total_return, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS cagr, stddev_samp(ret) * sqrt(252) AS volatility, avg(ret - 0.02 / 252) / stddev_samp(ret - 0.02 / 252) * sqrt(252) AS sharpe,
      avg(ret - 0.02 / 252) * sqrt(252) / stddev_samp(ret - 0.02 / 252) FILTER (ret - 0.02 / 252 < 0) AS sortino, max(ret) AS best_day, min(ret) AS worst_day, count(*) FILTER (ret > 0) / count(*) AS positive_days, least(min(drawdown), 0) AS max_drawdown,
      coalesce(avg(drawdown) FILTER (drawdown < 0), 0) AS avg_drawdown FROM ddn GROUP BY run_id)"""


@query(f", {_RM} SELECT run_id, CAST(n AS BIGINT) AS n, round(total_return, 5) AS total_return, round(cagr, 5) AS cagr, round(volatility, 6) AS volatility, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(best_day, 6) AS best_day, round(worst_day, 6) AS worst_day, round(positive_days, 6) AS positive_days, round(max_drawdown, 6) AS max_drawdown, round(avg_drawdown, 6) AS avg_drawdown, round(cagr / abs(max_drawdown), 5) AS calmar FROM rm", "rets")
def return_metrics(spark, d):
    m = P.return_metrics(runs(spark, d))
    return m.select([F.round(c, 5 if c in ("total_return", "cagr", "calmar") else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query(f", {_RM} SELECT run_id, date, round(drawdown, 6) AS drawdown FROM ddn", "rets")
def drawdowns(spark, d):
    return rounded(R.drawdowns(runs(spark, d)).select("run_id", "date", "drawdown"))


_MOM = f"""{_RUNS}, mom AS (SELECT run_id, count(*) AS n, avg(ret - 0.02 / 252) / stddev_samp(ret - 0.02 / 252) AS sr, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM runs GROUP BY run_id)"""


@query(f""", {_MOM}, q AS (SELECT run_id, quantile_cont(ret, 0.05) AS var95, quantile_cont(ret, 0.01) AS var99 FROM runs GROUP BY run_id)
    SELECT r.run_id, round(var95, 6) AS var95, round(var99, 6) AS var99, round(avg(ret) FILTER (ret <= var95), 6) AS cvar95, round(avg(ret) FILTER (ret <= var99), 6) AS cvar99, round(stddev_samp(ret) FILTER (ret < 0), 6) AS downside, round(any_value(skew), 5) AS skew, round(any_value(kurt), 4) AS kurt
    FROM runs r JOIN q USING (run_id) JOIN mom USING (run_id) GROUP BY r.run_id, var95, var99""", "rets")
def risk_metrics(spark, d):
    m = P.risk_metrics(runs(spark, d))
    return m.select([F.round(c, {"skew": 5, "kurt": 4}.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query(f""", {_RUNS}, s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY date) - row_number() OVER (PARTITION BY run_id, sign(ret) ORDER BY date) AS isl FROM runs), g AS (SELECT run_id, sign(ret) AS sg, isl, count(*) AS n FROM s GROUP BY ALL)
    SELECT run_id, CAST(coalesce(max(n) FILTER (sg = 1), 0) AS BIGINT) AS max_wins, CAST(coalesce(max(n) FILTER (sg = -1), 0) AS BIGINT) AS max_losses FROM g GROUP BY run_id""", "rets")
def streaks(spark, d):
    return P.streaks(runs(spark, d))


_LAGS = ", ".join(f"lag(ret, {k}) OVER w AS l{k}" for k in range(1, 21))
_RHO = " + ".join(f"coalesce(corr(ret, l{k}), 0) * {252 - k}" for k in range(1, 21))


@query(f""", {_RUNS}, lg AS (SELECT run_id, ret, {_LAGS} FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY date)), x AS (SELECT run_id, avg(ret - 0.02 / 252) / stddev_samp(ret - 0.02 / 252) AS sr, 252 + 2 * ({_RHO}) AS den FROM lg GROUP BY run_id)
    SELECT run_id, round(CASE WHEN den > 0 THEN 252 / sqrt(greatest(den, 1e-12)) ELSE sqrt(252) END * sr, 5) AS lo_sharpe FROM x""", "rets")
def lo_sharpe(spark, d):
    return rounded(P.lo_sharpe(runs(spark, d)), 5)


@query(f", {_MOM} SELECT run_id, round(CASE WHEN n >= 30 THEN sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) ELSE 0 END, 5) AS z FROM mom", "rets")
def psr(spark, d):
    return P.psr(runs(spark, d)).select("run_id", F.round("z", 5).alias("z"))


@query()
def psr_probability(spark, d):
    return P.psr(runs(spark, d))


@query()
def dsr(spark, d):
    return P.dsr(runs(spark, d), 10)


def trades(spark, d):
    """A buy or sell for each strong signal, at the price of its day."""
    k = F.col("event_id")
    s = signals(spark, d).select("event_id", "ticker", "date", ((k * 31 % 9) - 4).alias("shares")).filter("shares <> 0")
    return s.withColumn("price", (k * 17 % 100 + 50).cast("double")).withColumn("value", F.col("shares") * F.col("price"))


_TR = "tr AS (SELECT event_id, ticker, date, event_id * 31 % 9 - 4 AS shares, CAST(event_id * 17 % 100 + 50 AS DOUBLE) AS price FROM sigs WHERE event_id * 31 % 9 <> 4)"

_FOLD = f"""{_TR}, seq AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date, event_id) AS n FROM tr),
    f(ticker, n, p, e, r) AS (SELECT ticker, n, CAST(shares AS DOUBLE), price, CAST(NULL AS DOUBLE) FROM seq WHERE n = 1 UNION ALL
      SELECT s.ticker, s.n, CASE WHEN f.p = 0 THEN s.shares WHEN sign(f.p) = sign(s.shares) THEN f.p + s.shares WHEN abs(s.shares) >= abs(f.p) THEN 0 ELSE f.p + s.shares END,
        CASE WHEN f.p = 0 THEN s.price WHEN sign(f.p) = sign(s.shares) THEN (f.p * f.e + s.shares * s.price) / (f.p + s.shares) WHEN abs(s.shares) >= abs(f.p) THEN 0 ELSE f.e END,
        CASE WHEN f.p <> 0 AND sign(f.p) <> sign(s.shares) THEN sign(f.p) * (s.price - f.e) / f.e END FROM f JOIN seq s ON s.ticker = f.ticker AND s.n = f.n + 1),
    trets AS (SELECT ticker, n, r AS trade_return FROM f WHERE r IS NOT NULL)"""


def closed(spark, d):
    return P.trade_returns(trades(spark, d), ["ticker"], ["date", "event_id"])


@query(f", {_FOLD} SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY n) - 1 AS INTEGER) AS nth, round(trade_return, 6) AS trade_return FROM trets", "sigs")
def trade_returns(spark, d):
    return rounded(closed(spark, d))


@query(f""", {_FOLD} SELECT ticker, CAST(count(*) AS BIGINT) AS n_trades, round(count(*) FILTER (trade_return > 0) / count(*), 6) AS win_rate, round(sum(trade_return) FILTER (trade_return > 0) / abs(sum(trade_return) FILTER (trade_return < 0)), 6) AS profit_factor, round(avg(trade_return), 6) AS avg_return,
    round(avg(trade_return) FILTER (trade_return > 0), 6) AS avg_win, round(avg(trade_return) FILTER (trade_return < 0), 6) AS avg_loss, round(max(trade_return), 6) AS largest_win, round(min(trade_return), 6) AS largest_loss, round(avg(trade_return) FILTER (trade_return > 0) / abs(avg(trade_return) FILTER (trade_return < 0)), 6) AS win_loss_ratio FROM trets GROUP BY ticker""", "sigs")
def trade_stats(spark, d):
    return rounded(P.trade_stats(closed(spark, d), ["ticker"]))


@query(f", {_TR} SELECT ticker, round(avg(date_diff('day', date, x)), 6) AS avg_duration FROM (SELECT ticker, date, lead(date) OVER w AS x, row_number() OVER w AS n FROM tr WINDOW w AS (PARTITION BY ticker ORDER BY date, event_id)) WHERE n % 2 = 1 AND x IS NOT NULL GROUP BY ticker", "sigs")
def trade_durations(spark, d):
    return rounded(P.trade_durations(trades(spark, d), ["ticker"], ["date", "event_id"]))


@query(f", {_TR} SELECT ticker, CAST(count(*) AS BIGINT) AS n_trades, sum(abs(shares * price)) AS traded, round(avg(abs(shares * price)), 6) AS avg_trade, round(sum(abs(shares * price)) / 1e6, 8) AS turnover FROM tr GROUP BY ticker", "sigs")
def trading_metrics(spark, d):
    m = P.trading_metrics(trades(spark, d), 1e6, ["ticker"])
    return m.withColumn("avg_trade", F.round("avg_trade", 6)).withColumn("turnover", F.round("turnover", 8))


_BENCH = "bm AS (SELECT date, mkt AS bench FROM factors)"


def bench(spark, d):
    return factors(spark, d).select("date", F.col("mkt").alias("bench"))


@query(f""", {_RUNS}, {_BENCH}, j AS (SELECT r.*, bench, ret - bench AS x FROM runs r JOIN bm USING (date)), g AS (SELECT run_id, count(*) AS n, covar_samp(ret, bench) / var_samp(bench) AS beta, avg(ret) AS m, avg(bench) AS b, stddev_samp(x) * sqrt(252) AS te, avg(x) * 252 AS ax, corr(ret, bench) AS c FROM j GROUP BY run_id)
    SELECT run_id, CAST(n AS BIGINT) AS n, round(beta, 5) AS beta, round(te, 6) AS tracking_error, round(c, 6) AS correlation, round(m * 252 - (0.02 + beta * (b * 252 - 0.02)), 5) AS alpha, round(ax / te, 5) AS information_ratio FROM g""", "rets factors")
def benchmark_metrics(spark, d):
    m = P.benchmark_metrics(runs(spark, d), bench(spark, d))
    return m.select([F.round(c, 5 if c in ("beta", "alpha", "information_ratio") else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


_MONTHS = ", ".join(f"round(exp(sum(ln(1 + ret)) FILTER (month(date) = {m})) - 1, 6) AS m{m}" for m in range(1, 13))


@query(f", {_RUNS} SELECT run_id, CAST(year(date) AS INTEGER) AS year, {_MONTHS} FROM runs GROUP BY run_id, year(date)", "rets")
def monthly_returns(spark, d):
    return rounded(P.monthly_returns(runs(spark, d)))


@query(f""", {_RUNS} SELECT run_id, date, CASE WHEN count(*) OVER w >= 63 THEN round(coalesce(avg(ret - 0.02 / 252) OVER w / stddev_samp(ret - 0.02 / 252) OVER w, 0) * sqrt(252), 5) END AS rolling_sharpe FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""", "rets")
def rolling_sharpe(spark, d):
    return P.rolling_sharpe(runs(spark, d)).select("run_id", "date", F.round("rolling_sharpe", 5).alias("rolling_sharpe"))


@query(f""", {_RUNS}, pt(point) AS (VALUES (CAST(0.01 AS DOUBLE)), (0.05), (0.25), (0.5), (0.75), (0.95), (0.99)), q AS (SELECT run_id, CAST(count(*) FILTER (ret > 0) AS BIGINT) AS n_up, CAST(count(*) FILTER (ret < 0) AS BIGINT) AS n_down, CAST(count(*) FILTER (ret = 0) AS BIGINT) AS n_flat, quantile_cont(ret, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS v FROM runs GROUP BY run_id)
    SELECT run_id, n_up, n_down, n_flat, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS point, round(unnest(v), 6) AS value FROM q""", "rets")
def return_distribution(spark, d):
    return rounded(P.return_distribution(runs(spark, d)))


@query(f""", {_RM} SELECT run_id, 'returns' AS section, metric, round(value, 5) AS value FROM (UNPIVOT (SELECT run_id, sharpe, volatility, positive_days FROM rm) ON sharpe, volatility, positive_days INTO NAME metric VALUE value)
    UNION ALL SELECT run_id, 'streaks' AS section, 'max_wins' AS metric, CAST(max(n) AS DOUBLE) AS value FROM (SELECT run_id, sg, isl, count(*) AS n FROM (SELECT run_id, sign(ret) AS sg, row_number() OVER (PARTITION BY run_id ORDER BY date) - row_number() OVER (PARTITION BY run_id, sign(ret) ORDER BY date) AS isl FROM runs) GROUP BY ALL HAVING sg = 1) GROUP BY run_id""", "rets")
def tear_sheet(spark, d):
    r = runs(spark, d)
    sheet = P.tear_sheet({"returns": P.return_metrics(r).select("run_id", "sharpe", "volatility", "positive_days"), "streaks": P.streaks(r).select("run_id", "max_wins")})
    return sheet.withColumn("value", F.round("value", 5))


def with_factors(spark, d):
    return runs(spark, d).join(factors(spark, d), "date")


@query(f", {_RUNS} SELECT run_id, round(regr_intercept(ret, mkt), 7) AS alpha, round(regr_slope(ret, mkt), 5) AS beta, round(regr_r2(ret, mkt), 7) AS r2, CAST(count(*) AS BIGINT) AS n FROM runs JOIN factors USING (date) GROUP BY run_id", "rets factors")
def factor_regression(spark, d):
    m = P.factor_regression(with_factors(spark, d), ["mkt"])
    return m.select("run_id", F.round("alpha", 7).alias("alpha"), F.round(F.get("betas", F.lit(0)), 5).alias("beta"), F.round("r2", 7).alias("r2"), "n")


@query()
def factor_regression_full(spark, d):
    return P.factor_regression(with_factors(spark, d), ["mkt", "smb", "hml", "mom"])


@query()
def factor_hac(spark, d):
    return P.factor_hac(with_factors(spark, d), ["mkt", "smb", "hml", "mom"])


@query(f", {_RUNS} SELECT run_id, round(avg(ret) * 252, 6) AS alpha_annual, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) AS t, CAST(count(*) AS BIGINT) AS n FROM runs GROUP BY run_id", "rets")
def simple_alpha(spark, d):
    return rounded(P.simple_alpha(runs(spark, d)))


@query("SELECT date, mkt, smb FROM factors WHERE date BETWEEN '2024-06-01' AND '2026-06-01'", "factors")
def factors_load(spark, d):
    from eventalpha.sources.tables import factor_table

    f = factors(spark, d)
    percent = f.select(F.col("date").alias("Date "), (F.col("mkt") * 100).alias(" Mkt-RF"), (F.col("smb") * 100).alias("SMB"))
    momentum = f.select(F.col("date").alias("Date"), (F.col("mom") * 100).alias("Mom"))
    out = factor_table(percent, momentum, "2024-06-01", "2026-06-01")
    return out.select("date", F.round("mkt_rf", 8).alias("mkt"), F.round("smb", 8).alias("smb"))


# --- validation ---

_FOLDS = """folds AS (SELECT CAST(k AS INTEGER) AS fold, DATE '2024-02-01' AS train_start, DATE '2024-02-01' + 360 + CAST(k * 180 AS INTEGER) AS train_end, DATE '2024-02-01' + 365 + CAST(k * 180 AS INTEGER) AS test_start, DATE '2024-02-01' + 455 + CAST(k * 180 AS INTEGER) AS test_end
    FROM range(0, 40) t(k) WHERE DATE '2024-02-01' + 455 + CAST(k * 180 AS INTEGER) <= DATE '2029-12-31')"""


def folds(spark):
    return V.windows(spark, "2024-02-01", "2029-12-31", step_months=6)


@query(f", {_FOLDS}, span AS (SELECT min(date) AS a, max(date) AS b FROM rets) SELECT f.* FROM folds f, span WHERE test_start <= b", "rets")
def wf_windows(spark, d):
    last = returns(spark, d).agg(F.max("date")).first()[0]
    return folds(spark).filter(F.col("test_start") <= F.lit(last))


_ASSIGN = f"""{_RUNS}, {_FOLDS}, asg AS (SELECT r.*, fold, 'train' AS split FROM runs r JOIN folds ON date >= train_start AND date < train_end UNION ALL SELECT r.*, fold, 'test' FROM runs r JOIN folds ON date >= test_start AND date < test_end),
    okf AS (SELECT fold FROM asg GROUP BY fold HAVING count(*) FILTER (split = 'train') >= 10 AND count(*) FILTER (split = 'test') >= 5), asf AS (SELECT * FROM asg WHERE fold IN (SELECT fold FROM okf))"""


def assigned(spark, d):
    return V.assign(runs(spark, d), folds(spark))


@query(f", {_ASSIGN} SELECT fold, split, CAST(count(*) AS BIGINT) AS n, min(date) AS first, max(date) AS last FROM asf GROUP BY ALL", "rets")
def wf_assign(spark, d):
    return assigned(spark, d).groupBy("fold", "split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


# Signals with the return of their ticker on their date.
COMPONENTS = ["intensity", "pre_event_sentiment", "event_confidence"]
ENTER = 0.2
_WFR = f"""{_FOLDS}, wfr AS (SELECT event_id, s.ticker, s.date, intensity, pre_event_sentiment, event_confidence, ret / 40 AS ret FROM sigs s JOIN rets r ON r.run_id = s.ticker AND r.date = s.date),
    was AS (SELECT r.*, fold, 'train' AS split FROM wfr r JOIN folds ON date >= train_start AND date < train_end UNION ALL SELECT r.*, fold, 'test' FROM wfr r JOIN folds ON date >= test_start AND date < test_end),
    wok AS (SELECT * FROM was WHERE fold IN (SELECT fold FROM was GROUP BY fold HAVING count(*) FILTER (split = 'train') >= 10 AND count(*) FILTER (split = 'test') >= 5)),
    wiv AS (SELECT fold, {', '.join(f"CASE WHEN count(*) >= 20 THEN 1 / greatest(coalesce(var_samp({c}), 1), 1e-6) ELSE 1 END AS {c}" for c in COMPONENTS)} FROM wok WHERE split = 'train' GROUP BY fold),
    wts AS (SELECT fold, {', '.join(f"{c} / ({' + '.join(COMPONENTS)}) AS {c}" for c in COMPONENTS)} FROM wiv),
    wsc AS (SELECT o.fold, split, date, ret, {' + '.join(f'o.{c} * w.{c}' for c in COMPONENTS)} AS score FROM wok o JOIN wts w ON o.fold = w.fold),
    wdy AS (SELECT fold, split, date, count(*) AS n, avg(sign(score) * ret) AS ret FROM wsc WHERE abs(score) >= {ENTER} GROUP BY ALL),
    weq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY fold, split ORDER BY date)) AS e FROM wdy),
    wdd AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY fold, split ORDER BY date), 1) - 1 AS dd FROM weq),
    wsp AS (SELECT fold, {', '.join(f"coalesce(avg(ret) FILTER (split = '{x}') / nullif(stddev_samp(ret) FILTER (split = '{x}'), 0), 0) * sqrt(252) AS {x}_sharpe, coalesce(sum(n) FILTER (split = '{x}'), 0) AS {x}_n_trades, coalesce(exp(sum(ln(1 + ret)) FILTER (split = '{x}')) - 1, 0) AS {x}_return, coalesce(least(min(dd) FILTER (split = '{x}'), 0), 0) AS {x}_max_drawdown" for x in ('train', 'test'))} FROM wdd GROUP BY fold),
    wfo AS (SELECT *, CASE WHEN abs(train_sharpe) < 0.001 THEN 0 ELSE test_sharpe / train_sharpe END AS overfit_ratio FROM wsp WHERE test_n_trades > 0)"""


def walked(spark, d):
    """Rows of each fold, and weights fitted on their training part."""
    r = runs(spark, d).withColumnRenamed("run_id", "ticker")
    s = signals(spark, d).select("event_id", "ticker", "date", *COMPONENTS)
    rows = V.assign(s.join(r, ["ticker", "date"]), folds(spark))
    return rows, V.train_weights(rows, COMPONENTS)


def walked_metrics(spark, d):
    rows, weights = walked(spark, d)
    return V.fold_metrics(V.backtest(rows, weights, COMPONENTS, ENTER))


@query(f", {_WFR} SELECT fold, {', '.join(f'round({c}, 8) AS {c}' for c in COMPONENTS)} FROM wts", "sigs rets")
def wf_weights(spark, d):
    return rounded(walked(spark, d)[1], 8)


_WFC = [f"{x}_{c}" for x in ("train", "test") for c in ("sharpe", "return", "max_drawdown")]


@query(f", {_WFR} SELECT fold, {', '.join(f'round({c}, 5) AS {c}' for c in _WFC)}, CAST(train_n_trades AS BIGINT) AS train_n_trades, CAST(test_n_trades AS BIGINT) AS test_n_trades, round(overfit_ratio, 4) AS overfit_ratio FROM wfo", "sigs rets")
def wf_metrics(spark, d):
    m = walked_metrics(spark, d)
    return m.select("fold", *[F.round(c, 5).alias(c) for c in _WFC], "train_n_trades", "test_n_trades", F.round("overfit_ratio", 4).alias("overfit_ratio"))


# The greatest of n normal draws, and the normal distribution, which DuckDB lacks: by table and by integration.
_BEST = ", ".join(f"({n}, CAST({best_of(n)!r} AS DOUBLE))" for n in range(2, 41))
_CDF = "(SELECT 0.5 + sum(exp(-t * t / 2)) * abs({z}) / 2000 / sqrt(2 * pi()) * sign({z}) FROM (SELECT (i + 0.5) / 2000 * abs({z}) AS t FROM range(2000) r(i)))"


@query(f""", {_WFR}, ag AS (SELECT count(*) AS folds, avg(train_sharpe) AS mean_train_sharpe, avg(test_sharpe) AS mean_sharpe, coalesce(stddev_samp(test_sharpe), 0) AS std_sharpe, min(test_sharpe) AS min_sharpe, max(test_sharpe) AS max_sharpe,
      count(*) FILTER (test_sharpe > 0) / count(*) AS profitable, avg(overfit_ratio) FILTER (train_sharpe <> 0) AS overfit_ratio, sum(test_n_trades) AS n_trades FROM wfo), bst(n, best) AS (VALUES {_BEST}),
    az AS (SELECT ag.*, mean_sharpe / (std_sharpe / sqrt(folds)) AS psr_z, (mean_sharpe - std_sharpe * best) / (std_sharpe / sqrt(folds)) AS dsr_z FROM ag JOIN bst ON n = folds),
    ap AS (SELECT *, {_CDF.format(z='psr_z')} AS p, {_CDF.format(z='dsr_z')} AS q FROM az)
    SELECT CAST(folds AS BIGINT) AS folds, round(mean_train_sharpe, 5) AS mean_train_sharpe, round(mean_sharpe, 5) AS mean_sharpe, round(std_sharpe, 5) AS std_sharpe, round(min_sharpe, 5) AS min_sharpe, round(max_sharpe, 5) AS max_sharpe, round(profitable, 5) AS profitable,
      round(overfit_ratio, 4) AS overfit_ratio, CAST(n_trades AS BIGINT) AS n_trades, round(psr_z, 5) AS psr_z, round(dsr_z, 5) AS dsr_z, round(p, 4) AS probabilistic_sharpe, round(q, 4) AS deflated_sharpe,
      mean_sharpe > 0 AND overfit_ratio > 0.4 AND profitable >= 0.5 AND q >= 0.9 AS passes FROM ap""", "sigs rets")
def wf_aggregate(spark, d):
    places = {"overfit_ratio": 4, "probabilistic_sharpe": 4, "deflated_sharpe": 4}
    out = V.aggregate(walked_metrics(spark, d))
    return out.select([F.round(c, places.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_SWEEP = """lv(threshold) AS (VALUES (CAST(0.2 AS DOUBLE)), (0.4), (0.6), (0.8)), sw AS (SELECT threshold, count(*) AS n_signals, avg(raw_score) / stddev_samp(raw_score) AS sharpe FROM lv JOIN scored ON event_confidence >= threshold GROUP BY threshold)"""


def swept(spark, d):
    s = SW.with_thresholds(scored(spark, d), [0.2, 0.4, 0.6, 0.8], "event_confidence")
    return s.groupBy("threshold").agg(F.count("*").alias("n_signals"), (F.avg("raw_score") / F.stddev_samp("raw_score")).alias("sharpe"))


@query(f""", {_SWEEP}, p AS (SELECT coalesce((SELECT threshold FROM sw WHERE n_signals >= 500 ORDER BY sharpe DESC, threshold LIMIT 1), (SELECT threshold FROM sw ORDER BY 0.6 * sharpe + 0.4 * least(n_signals / 500, 1) DESC, threshold LIMIT 1)) AS best)
    SELECT threshold, CAST(n_signals AS BIGINT) AS n_signals, round(sharpe, 6) AS sharpe, round(sharpe / n_signals, 9) AS sharpe_per_signal, threshold = best AS chosen FROM sw, p""", "scored")
def threshold_sweep(spark, d):
    m = swept(spark, d)
    best = SW.pick_threshold(m, 500).first()[0]
    return m.select("threshold", "n_signals", F.round("sharpe", 6).alias("sharpe"), F.round(F.col("sharpe") / F.col("n_signals"), 9).alias("sharpe_per_signal"), (F.col("threshold") == best).alias("chosen"))


_CMP = f"""{_RM}, lm AS (UNPIVOT (SELECT run_id, sharpe, volatility, max_drawdown FROM rm) ON sharpe, volatility, max_drawdown INTO NAME metric VALUE value)"""


def long_metrics(spark, d):
    return P.tear_sheet({"x": P.return_metrics(runs(spark, d)).select("run_id", "sharpe", "volatility", "max_drawdown")}).drop("section")


@query(f", {_CMP} SELECT metric, round(a.value, 6) AS a, round(b.value, 6) AS b, round(b.value - a.value, 6) AS delta, round((b.value - a.value) / abs(a.value), 5) AS change FROM lm a JOIN lm b USING (metric) WHERE a.run_id = 'T01' AND b.run_id = 'T02'", "rets")
def compare_runs(spark, d):
    c = SW.compare_runs(long_metrics(spark, d), "T01", "T02")
    return c.select("metric", *[F.round(x, 5 if x == "change" else 6).alias(x) for x in ("a", "b", "delta", "change")])


@query(f""", {_CMP}, rl(metric, kind, okv, warn) AS (VALUES ('sharpe', 'min', 0.5, 0), ('max_drawdown', 'min', -0.1, -0.15), ('volatility', 'max', 0.1, 0.2)) SELECT run_id, metric, round(value, 6) AS value,
    CASE WHEN (kind = 'min' AND value >= okv) OR (kind = 'max' AND value <= okv) THEN 'PASS' WHEN (kind = 'min' AND value >= warn) OR (kind = 'max' AND value <= warn) THEN 'WARN' ELSE 'FAIL' END AS status FROM lm JOIN rl USING (metric)""", "rets")
def result_checks(spark, d):
    return rounded(Q.check_results(long_metrics(spark, d), [("sharpe", "min", 0.5, 0), ("max_drawdown", "min", -0.1, -0.15), ("volatility", "max", 0.1, 0.2)]))


@query("""SELECT run_id, stage, CAST(nth AS INTEGER) AS nth, CAST(n AS BIGINT) AS n, round(n / lag(n) OVER (PARTITION BY run_id ORDER BY nth), 6) AS share FROM (SELECT filing_type AS run_id, 'filings' AS stage, 0 AS nth, count(*) AS n FROM filings GROUP BY 1
    UNION ALL SELECT filing_type, 'events', 1, count(*) FROM evts GROUP BY 1 UNION ALL SELECT filing_type, 'signals', 2, count(*) FROM evts WHERE event_date >= DATE '2024-01-15' GROUP BY 1)""", "filings evts")
def funnel(spark, d):
    by = lambda df: df.withColumnRenamed("filing_type", "run_id")
    e = by(events(spark, d))
    return rounded(V.funnel({"filings": by(filings(spark, d)), "events": e, "signals": e.filter("event_date >= date'2024-01-15'")}))


@query(f", {_ASSIGN} SELECT fold, split, round(avg(ret), 9) AS mean, CAST(count(*) AS BIGINT) AS n FROM asf GROUP BY ALL", "rets")
def udf_fold(spark, d):
    mean = Fold(lambda: (0, 0.0), lambda s, rows: (s[0] + len(rows), s[1] + float(rows["ret"].sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: [(s[1] / s[0], s[0])])
    return V.per_fold(assigned(spark, d).select("fold", "split", "ret"), mean, "mean double, n long").withColumn("mean", F.round("mean", 9))


# --- universe ---

_TIERED = """tu AS (SELECT ticker, CASE WHEN cap > 9000 THEN 'VERY HIGH' WHEN cap > 8000 THEN 'HIGH' WHEN cap > 5000 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM universe)"""


def tiered(spark, d):
    cap = F.col("cap")
    return universe(spark, d).select("ticker", F.when(cap > 9000, "VERY HIGH").when(cap > 8000, "HIGH").when(cap > 5000, "MEDIUM").otherwise("LOW").alias("tier"))


def constituents(spark):
    return spark.range(20).select(ticker(F.col("id")).alias("ticker"))


@query(f", {_TIERED} SELECT DISTINCT ticker FROM tu WHERE tier IN ('VERY HIGH', 'HIGH') AND ticker < 'T20'", "universe")
def universe_tier(spark, d):
    return U.tier(tiered(spark, d), constituents(spark), "HIGH")


@query("SELECT member_id, ticker FROM (SELECT * REPLACE (CASE WHEN member_id % 10 = 0 THEN NULL ELSE cap END AS cap) FROM universe) WHERE (cap IS NULL OR (cap >= 1000 AND cap <= 8000)) AND sector NOT IN ('ASIA')", "universe")
def universe_filter(spark, d):
    u = universe(spark, d).withColumn("cap", F.when(F.col("member_id") % 10 != 0, F.col("cap")))
    return U.by_criteria(u, 1000, 8000, ("ASIA",)).select("member_id", "ticker")


@query("""SELECT DISTINCT t FROM (SELECT replace(upper(trim(concat(' ', left(replace(category, ' ', '.'), CAST(member_id % 6 AS INTEGER)), ' '))), '.', '-') AS t FROM universe) WHERE regexp_matches(replace(t, '-', ''), '^[A-Z]{1,5}$') AND length(t) <= 6""", "universe")
def ticker_clean(spark, d):
    raw = F.concat(F.lit(" "), F.left(F.replace("category", F.lit(" "), F.lit(".")), (F.col("member_id") % 6).cast("int")), F.lit(" "))
    return universe(spark, d).select(U.clean_ticker(raw).alias("t")).filter("t is not null").distinct()


@query("SELECT sector, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT ticker) AS BIGINT) AS n_tickers, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM universe GROUP BY ROLLUP (sector)", "universe")
def sector_breakdown(spark, d):
    return U.breakdown(universe(spark, d))


@query(f", {_TIERED} SELECT ticker FROM tu WHERE tier <> 'LOW' EXCEPT SELECT ticker FROM tu WHERE tier = 'VERY HIGH'", "universe")
def universe_except(spark, d):
    t = tiered(spark, d)
    return U.only_in(t.filter("tier <> 'LOW'"), t.filter("tier = 'VERY HIGH'"))


# --- machine learning ---

# All dimensions of the vectors, and one that nearly repeats the first.
DIMENSIONS = 64
FEATURES = [f"f{i}" for i in range(DIMENSIONS + 1)]
_FEAT = f"ft AS (SELECT vec_id, label, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}' for i in range(DIMENSIONS))}, CAST(embedding[1] AS DOUBLE) * 2 + CAST(embedding[2] AS DOUBLE) / 10 AS f{DIMENSIONS} FROM embeddings)"
_LONG = f"{_FEAT}, lf AS (UNPIVOT ft ON {', '.join(FEATURES)} INTO NAME feature VALUE x)"


def features(spark, d):
    e = lambda i: F.get("embedding", i).cast("double")
    cols = [e(i).alias(f"f{i}") for i in range(DIMENSIONS)] + [(e(0) * 2 + e(1) / 10).alias(f"f{DIMENSIONS}")]
    return table(spark, d, "embeddings").select("vec_id", "label", *cols)


@query("SELECT event_id, CASE WHEN intensity > 0.2 THEN 2 WHEN intensity < -0.2 THEN 0 ELSE 1 END AS label FROM sigs", "sigs")
def labels(spark, d):
    return signals(spark, d).select("event_id", ML.return_label(F.col("intensity"), -0.2, 0.2).alias("label"))


@query(f"WITH {_LONG}, r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY label) + (count(*) OVER (PARTITION BY feature, label) - 1) / 2 AS ry FROM lf) SELECT feature, round(abs(corr(rx, ry)), 6) AS score FROM r GROUP BY feature ORDER BY score DESC, feature LIMIT 5")
def select_corr(spark, d):
    return rounded(ML.select_by_correlation(features(spark, d), FEATURES, "label", 5, "spearman"))


@query(f"WITH {_LONG} SELECT feature, round(var_samp(x), 6) AS score FROM lf GROUP BY feature HAVING var_samp(x) >= 0.001 ORDER BY var_samp(x) DESC, feature LIMIT 5")
def select_variance(spark, d):
    return rounded(ML.select_by_variance(features(spark, d), FEATURES, 5, 0.001))


@query(f"""WITH {_LONG}, own AS (SELECT feature, abs(corr(x, label)) AS s FROM lf GROUP BY feature), pr AS (SELECT a.feature AS a, b.feature AS b FROM lf a JOIN lf b USING (vec_id) WHERE CAST(a.feature[2:] AS INTEGER) < CAST(b.feature[2:] AS INTEGER) GROUP BY 1, 2 HAVING abs(corr(a.x, b.x)) > 0.8),
    los AS (SELECT CASE WHEN x.s >= y.s THEN pr.b ELSE pr.a END AS feature FROM pr JOIN own x ON x.feature = pr.a JOIN own y ON y.feature = pr.b) SELECT feature, round(s, 6) AS score FROM own WHERE feature NOT IN (SELECT feature FROM los)""")
def select_collinear(spark, d):
    return rounded(ML.drop_collinear(features(spark, d), FEATURES, "label"))


@query(f"""WITH {_LONG}, b AS (SELECT feature, label, ntile(5) OVER (PARTITION BY feature ORDER BY x, vec_id) AS bx FROM lf), j AS (SELECT feature, bx, label, count(*) AS n FROM b GROUP BY ALL),
    m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bx) AS nx, sum(n) OVER (PARTITION BY feature, label) AS ny FROM j) SELECT feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS score FROM m GROUP BY feature ORDER BY score DESC, feature LIMIT 5""")
def select_mi(spark, d):
    return rounded(ML.select_by_mutual_information(features(spark, d), FEATURES, "label", 5))


@query()
def select_rf(spark, d):
    return spark.createDataFrame(ML.select_by_forest(features(spark, d), FEATURES, "label", 5), "feature string, importance double")


@query(f"""WITH {_LONG}, p AS (SELECT feature, abs(corr(x, label)) AS s FROM lf GROUP BY feature), c AS (SELECT feature FROM p ORDER BY s DESC, feature LIMIT 20), v AS (SELECT feature FROM lf GROUP BY feature HAVING var_samp(x) >= 0.001 ORDER BY var_samp(x) DESC, feature LIMIT 20)
    SELECT feature, CAST(2 AS BIGINT) AS votes, round(s, 6) AS score FROM p WHERE feature IN (SELECT feature FROM c) AND feature IN (SELECT feature FROM v) ORDER BY s DESC, feature LIMIT 8""")
def select_vote(spark, d):
    f = features(spark, d)
    every = ML.select_by_correlation(f, FEATURES, "label", len(FEATURES))
    chosen = [ML.select_by_correlation(f, FEATURES, "label", 20), ML.select_by_variance(f, FEATURES, 20, 0.001)]
    return rounded(ML.vote(chosen, every, 2, 8))


@query()
def select_rfe(spark, d):
    """Ranking of all features by recursive elimination down to nine, eight a round."""
    return ML.eliminate(features(spark, d), FEATURES, "label", 9, 8)


@query()
def class_importance(spark, d):
    f = features(spark, d).withColumn("label", (F.col("label") % 3).cast("int"))
    return ML.fit(f, FEATURES).importances()


@query()
def classify(spark, d):
    """Accuracy of each model on held-out rows, a fifth by a hash of the id."""
    f = features(spark, d).withColumn("label", (F.col("label") % 3).cast("int")).withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(5)))
    train, test = f.filter("fold <> 0").drop("fold"), f.filter("fold = 0").drop("fold")
    out = None
    for kind in ("forest", "bayes", "perceptron", "svm"):
        a = ML.accuracy(ML.predict(ML.fit(train, FEATURES, kind=kind), test)).withColumn("model", F.lit(kind))
        out = a if out is None else out.unionByName(a)
    return out


@query()
def ts_cv(spark, d):
    f = features(spark, d).withColumn("label", (F.col("label") % 3).cast("int"))
    return ML.time_series_cv(f, FEATURES, ["vec_id"], 3)


_VOTES = "vt AS (SELECT vec_id, m, (vec_id * (m + 3) + label) % 3 AS prediction, [0.5, 0.3, 0.25][m + 1] AS weight FROM embeddings, range(3) t(m))"


@query(f"WITH {_VOTES}, g AS (SELECT vec_id, prediction, sum(CAST(weight * 100 AS INTEGER)) AS w FROM vt GROUP BY ALL) SELECT vec_id, CAST(arg_max(prediction, (w, -prediction)) AS INTEGER) AS prediction FROM g GROUP BY vec_id")
def ensemble_vote(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("m"))
    p = e.select("vec_id", ((F.col("vec_id") * (F.col("m") + 3) + F.col("label")) % 3).cast("int").alias("prediction"), F.get(F.array(F.lit(50), F.lit(30), F.lit(25)), F.col("m")).alias("weight"))
    return ML.ensemble_vote(p, "vec_id")


@query("""WITH p AS (SELECT label % 3 AS label, (vec_id + label) % 3 AS prediction FROM embeddings), g AS (SELECT label, count(*) FILTER (prediction = 0) AS p0, count(*) FILTER (prediction = 1) AS p1, count(*) FILTER (prediction = 2) AS p2 FROM p GROUP BY label),
    h AS (SELECT *, [p0, p1, p2][label + 1] AS hit, [sum(p0) OVER (), sum(p1) OVER (), sum(p2) OVER ()][label + 1] AS called FROM g), r AS (SELECT CAST(label AS INTEGER) AS label, CAST(p0 AS BIGINT) AS p0, CAST(p1 AS BIGINT) AS p1, CAST(p2 AS BIGINT) AS p2, hit / (p0 + p1 + p2) AS recall, hit / called AS precision FROM h)
    SELECT label, p0, p1, p2, round(recall, 6) AS recall, round(precision, 6) AS precision, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM r""")
def confusion(spark, d):
    p = table(spark, d, "embeddings").select((F.col("label") % 3).alias("label"), ((F.col("vec_id") + F.col("label")) % 3).alias("prediction"))
    return rounded(ML.confusion(p, [0, 1, 2]))
