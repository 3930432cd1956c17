"""Performance statistics of many runs at once: returns are (run_id, date, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import carried
from .ranks import grouped_percentiles
from .risk import drawdowns

DAYS, RISK_FREE = 252, 0.02


def _excess() -> Column:
    return F.col("ret") - RISK_FREE / DAYS


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def return_metrics(returns: DataFrame) -> DataFrame:
    """Total return, growth, volatility, Sharpe, Sortino, Calmar, best, worst and positive days."""
    year = F.sqrt(F.lit(float(DAYS)))
    x, r = _excess(), F.col("ret")
    dd = drawdowns(returns).groupBy("run_id").agg(F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"), F.coalesce(F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))), F.lit(0.0)).alias("avg_drawdown"))
    m = returns.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), (F.exp(F.sum(F.ln(1 + r))) - 1).alias("total_return"), (F.exp(F.sum(F.ln(1 + r)) * DAYS / F.count(F.lit(1))) - 1).alias("cagr"),
        (F.stddev_samp(r) * year).alias("volatility"), _ratio(F.avg(x) * year, F.stddev_samp(x)).alias("sharpe"), _ratio(F.avg(x) * year, F.stddev_samp(F.when(x < 0, x))).alias("sortino"),
        F.max(r).alias("best_day"), F.min(r).alias("worst_day"), (F.count_if(r > 0) / F.count(F.lit(1))).alias("positive_days"),
    )
    return m.join(dd, "run_id").withColumn("calmar", _ratio(F.col("cagr"), F.abs("max_drawdown")))


def moments(returns: DataFrame) -> DataFrame:
    """run_id, n, sr (daily), skew and kurt, bias-corrected; kurt is not in excess of 3."""
    x = _excess()
    n = F.col("n").cast("double")
    m = returns.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), _ratio(F.avg(x), F.stddev_samp(x)).alias("sr"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"))
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3
    return m.filter("n > 3").select("run_id", "n", "sr", skew.alias("skew"), kurt.alias("kurt"))


def risk_metrics(returns: DataFrame) -> DataFrame:
    r = F.col("ret")
    points = grouped_percentiles(returns, ["run_id"], "ret", [0.05, 0.01]).select("run_id", F.get("_p", F.lit(0)).alias("var95"), F.get("_p", F.lit(1)).alias("var99"))
    tails = returns.join(points, "run_id").groupBy("run_id", "var95", "var99").agg(
        F.avg(F.when(r <= F.col("var95"), r)).alias("cvar95"), F.avg(F.when(r <= F.col("var99"), r)).alias("cvar99"), F.coalesce(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0)).alias("downside"))
    return tails.join(moments(returns).select("run_id", "skew", "kurt"), "run_id", "left")


def streaks(returns: DataFrame) -> DataFrame:
    """Longest runs of gains and of losses, as gaps and islands."""
    w = Window.partitionBy("run_id").orderBy("date")
    side = F.signum("ret")
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("run_id", "_s").orderBy("date"))
    runs = returns.withColumn("_s", side).withColumn("_i", island).groupBy("run_id", "_s", "_i").agg(F.count(F.lit(1)).alias("n"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("_s") == s, F.col("n"))), F.lit(0))
    return runs.groupBy("run_id").agg(longest(1).alias("max_wins"), longest(-1).alias("max_losses"))


def lo_sharpe(returns: DataFrame, lags: int = 20) -> DataFrame:
    """Sharpe annualised with autocorrelations: one window for all lags, then one aggregation."""
    w = Window.partitionBy("run_id").orderBy("date")
    df = returns.select("run_id", "ret", *[F.lag("ret", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    x = _excess()
    rho = [F.coalesce(F.nanvl(F.corr("ret", f"l{k}"), F.lit(0.0)), F.lit(0.0)) * (DAYS - k) for k in range(1, lags + 1)]
    g = df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), _ratio(F.avg(x), F.stddev_samp(x)).alias("sr"), sum(rho, F.lit(0.0)).alias("rho"))
    d = DAYS + 2 * F.col("rho")
    eta = F.when(d > 0, DAYS / F.sqrt(F.greatest(d, F.lit(1e-12)))).otherwise(F.sqrt(F.lit(float(DAYS))))
    return g.select("run_id", F.when(F.col("n") >= lags + 2, eta * F.col("sr")).otherwise(F.lit(0.0)).alias("lo_sharpe"))


def psr_z(returns: DataFrame, benchmark: Column | float = 0.0, least: int = 30) -> DataFrame:
    """run_id, z of the probabilistic Sharpe ratio against an annual benchmark; 0 for short runs."""
    b = (F.lit(benchmark) if isinstance(benchmark, float) else benchmark) / F.sqrt(F.lit(float(DAYS)))
    sr = F.col("sr")
    d = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    z = (sr - b) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(d, F.lit(1e-12)))
    return moments(returns).withColumn("z", F.when((F.col("n") >= least) & (d > 0), z).otherwise(F.lit(0.0)))


def psr(returns: DataFrame, benchmark: float = 0.0) -> DataFrame:
    from eventalpha.functions.normal import normal_cdf

    return psr_z(returns, benchmark).select("run_id", "z", normal_cdf("z").alias("psr"))


def dsr(returns: DataFrame, trials: int) -> DataFrame:
    """Probabilistic Sharpe against the best that ``trials`` skill-less tries would show."""
    from eventalpha.functions.normal import best_of, normal_cdf

    if trials <= 1:
        return psr(returns).withColumnRenamed("psr", "dsr")
    top = best_of(trials)
    sr = F.col("sr")
    v = F.greatest(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr, F.lit(1e-6)) / (F.col("n") - 1)
    bench = F.sqrt(v) * top * F.sqrt(F.lit(float(DAYS)))
    return psr_z(returns, bench).select("run_id", "z", normal_cdf("z").alias("dsr"))


def trade_returns(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Return of every (partial) close against the average entry price; trades: shares, price; nth in order of the
    name's closes. Positions are carried along each name's trades (see ``folds.carried``), so a name's trades
    are spread over tasks and no task holds more than one position. What goes beyond closing a position opens none."""

    def step(state: tuple[float, float], trade: tuple) -> tuple[tuple[float, float], tuple | None]:
        held, entry = state
        shares, price = trade
        if shares is None or price is None or shares == 0:
            return state, None
        if held == 0:
            return (shares, price), None
        if (held > 0) == (shares > 0):
            return (held + shares, (held * entry + shares * price) / (held + shares)), None
        gain = ((price - entry) / entry * (1 if held > 0 else -1),) if entry > 0 else None
        return ((0.0, 0.0) if abs(shares) >= abs(held) else (held + shares, entry)), gain

    rows = trades.withColumns({c: F.col(c).cast("double") for c in ("shares", "price")})
    return carried(rows, by, order, ["shares", "price"], (0.0, 0.0), step, "trade_return double")


def trade_stats(trade_returns_: DataFrame, by: list[str]) -> DataFrame:
    r = F.col("trade_return")
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    won, lost = F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.coalesce(F.sum(loss), F.lit(0.0)))
    return trade_returns_.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), (F.count(win) / F.count(F.lit(1))).alias("win_rate"),
        F.when(lost > 0, won / lost).when(won > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("profit_factor"),
        F.avg(r).alias("avg_return"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"), F.max(r).alias("largest_win"), F.min(r).alias("largest_loss"),
        F.coalesce(F.avg(win) / F.abs(F.avg(loss)), F.lit(0.0)).alias("win_loss_ratio"),
    )


def trade_durations(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Days between the first and second, third and fourth, ... trade of a name, averaged."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = trades.withColumn("_n", F.row_number().over(w)).withColumn("_x", F.lead("date").over(w)).filter("_n % 2 = 1 and _x is not null")
    return d.groupBy(*by).agg(F.avg(F.datediff("_x", "date")).alias("avg_duration"))


def trading_metrics(trades: DataFrame, mean_value: float, by: list[str]) -> DataFrame:
    v = F.abs("value")
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), F.sum(v).alias("traded"), F.avg(v).alias("avg_trade"), (F.sum(v) / mean_value).alias("turnover"))


def benchmark_metrics(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """benchmark: (date, bench). Beta, Jensen's alpha, information ratio, tracking error, correlation."""
    j = returns.join(benchmark, "date")
    x = F.col("ret") - F.col("bench")
    g = j.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), _ratio(F.covar_samp("ret", "bench"), F.var_samp("bench")).alias("beta"), F.avg("ret").alias("_m"), F.avg("bench").alias("_b"),
        (F.stddev_samp(x) * F.sqrt(F.lit(float(DAYS)))).alias("tracking_error"), (F.avg(x) * DAYS).alias("_x"), F.corr("ret", "bench").alias("correlation"))
    alpha = F.col("_m") * DAYS - (RISK_FREE + F.col("beta") * (F.col("_b") * DAYS - RISK_FREE))
    return g.withColumn("alpha", alpha).withColumn("information_ratio", _ratio(F.col("_x"), F.col("tracking_error"))).drop("_m", "_b", "_x")


def monthly_returns(returns: DataFrame) -> DataFrame:
    """run_id, year and one column for each month (m1..m12)."""
    r = returns.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    p = r.groupBy("run_id", "year").pivot("month", list(range(1, 13))).agg(F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1)
    return p.select("run_id", "year", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])


def rolling_sharpe(returns: DataFrame, days: int = 63) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("date").rowsBetween(-(days - 1), 0)
    x = _excess()
    return returns.withColumn("rolling_sharpe", F.when(F.count("ret").over(w) >= days, _ratio(F.avg(x).over(w) * F.sqrt(F.lit(float(DAYS))), F.stddev_samp(x).over(w))))


def return_distribution(returns: DataFrame, points: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """run_id, point, value and the counts by sign."""
    r = F.col("ret")
    g = returns.groupBy("run_id").agg(F.count_if(r > 0).alias("n_up"), F.count_if(r < 0).alias("n_down"), F.count_if(r == 0).alias("n_flat"))
    g = g.join(grouped_percentiles(returns, ["run_id"], "ret", list(points)).withColumnRenamed("_p", "v"), "run_id")
    return g.select("run_id", "n_up", "n_down", "n_flat", F.posexplode("v").alias("i", "value")).withColumn("point", F.get(F.array(*[F.lit(p) for p in points]), F.col("i"))).drop("i")


def tear_sheet(sections: dict[str, DataFrame]) -> DataFrame:
    """(run_id, section, metric, value) of all double and long columns of each section."""
    out = None
    for name, df in sections.items():
        cols = [c for c, t in df.dtypes if c != "run_id" and t in ("double", "bigint", "int")]
        part = df.select("run_id", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["run_id"], cols, "metric", "value").withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def factor_sums(joined: DataFrame, factors: list[str], y: str = "ret", by: str = "run_id") -> DataFrame:
    """The entries of X'X and X'y (X with a leading 1), and y'y, by run: one aggregation."""
    x = [F.lit(1.0), *[F.col(f) for f in factors]]
    k = len(x)
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x[i] * x[j]) for i in range(k) for j in range(k)]).alias("xx"), F.array(*[F.sum(c * F.col(y)) for c in x]).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("y"))


def factor_regression(joined: DataFrame, factors: list[str], y: str = "ret", by: str = "run_id") -> DataFrame:
    """run_id, alpha, alpha_annual, betas, r2, adj_r2, n. Only a (k+1) x (k+1) system for each run
    goes to Python."""
    import numpy as np
    import pandas as pd

    k = len(factors)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            a, b = np.array(row.xx).reshape(k + 1, k + 1), np.array(row.xy)
            c = np.linalg.lstsq(a, b, rcond=None)[0]
            total = row.yy - row.y**2 / row.n
            r2 = 1 - (row.yy - c @ b) / total if total else 0.0
            adj = 1 - (1 - r2) * (row.n - 1) / (row.n - k - 1) if row.n > k + 1 else 0.0
            out.append((getattr(row, by), float(c[0]), float(c[0] * DAYS), [float(v) for v in c[1:]], float(r2), float(adj), int(row.n)))
        return pd.DataFrame(out, columns=[by, "alpha", "alpha_annual", "betas", "r2", "adj_r2", "n"])

    sums = factor_sums(joined, factors, y, by)
    return sums.mapInPandas(lambda it: (solve(p) for p in it), f"{by} string, alpha double, alpha_annual double, betas array<double>, r2 double, adj_r2 double, n long")


def factor_hac(joined: DataFrame, factors: list[str], y: str = "ret", by: str = "run_id", max_lag: int = 12) -> DataFrame:
    """Newey-West standard errors and t values of the regression: (run_id, term, coef, se, t, p).

    Residuals and scores are columns; the products of scores with their lags are summed in Spark;
    Python gets one small matrix for each run and lag."""
    import numpy as np
    import pandas as pd

    from eventalpha.functions.normal import t_two_sided

    k = len(factors) + 1
    fit = factor_regression(joined, factors, y, by).select(by, "alpha", "betas")
    x = [F.lit(1.0), *[F.col(f) for f in factors]]
    fitted = F.col("alpha") + sum((F.get("betas", F.lit(i)) * F.col(f) for i, f in enumerate(factors)), F.lit(0.0))
    scored = joined.join(fit, by).withColumn("_e", F.col(y) - fitted).select(by, "date", *[(c * F.col("_e")).alias(f"s{i}") for i, c in enumerate(x)])
    w = Window.partitionBy(by).orderBy("date")
    lagged = scored.select("*", *[F.lag(f"s{i}", lag).over(w).alias(f"s{i}_{lag}") for lag in range(1, max_lag + 1) for i in range(k)])
    name = lambda i, lag: f"s{i}" if lag == 0 else f"s{i}_{lag}"
    products = [F.array(*[F.coalesce(F.sum(F.col(f"s{i}") * F.col(name(j, lag))), F.lit(0.0)) for i in range(k) for j in range(k)]).alias(f"g{lag}") for lag in range(max_lag + 1)]
    meat = lagged.groupBy(by).agg(*products)
    terms = ["alpha", *factors]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            inv = np.linalg.pinv(np.array(row.xx).reshape(k, k))
            coef = inv @ np.array(row.xy)
            lags = min(max_lag, int(4 * (row.n / 100) ** (2 / 9)))
            s = np.array(row.g0).reshape(k, k)
            for lag in range(1, lags + 1):
                g = np.array(getattr(row, f"g{lag}")).reshape(k, k)
                s = s + (1 - lag / (lags + 1)) * (g + g.T)
            se = np.sqrt(np.maximum(np.diag(inv @ s @ inv), 0))
            for term, c, e in zip(terms, coef, se):
                t = c / e if e else 0.0
                out.append((getattr(row, by), term, float(c), float(e), float(t), t_two_sided(float(t), int(row.n) - k)))
        return pd.DataFrame(out, columns=[by, "term", "coef", "se", "t", "p"])

    return factor_sums(joined, factors, y, by).join(meat, by).mapInPandas(lambda it: (solve(p) for p in it), f"{by} string, term string, coef double, se double, t double, p double")


def simple_alpha(returns: DataFrame) -> DataFrame:
    """Mean x 252 and its t value, where factors overlap too little."""
    n = F.count(F.lit(1))
    return returns.groupBy("run_id").agg((F.avg("ret") * DAYS).alias("alpha_annual"), _ratio(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(n.cast("double"))).alias("t"), n.alias("n"))
