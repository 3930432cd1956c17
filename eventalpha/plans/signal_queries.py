"""Queries over signals, portfolios, books and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventalpha.operators import book as B
from eventalpha.operators import joins as J
from eventalpha.operators import market as M
from eventalpha.operators import portfolio as PO
from eventalpha.operators import risk as R
from eventalpha.operators import scoring as S
from eventalpha.plans.base import grade, posts, posts_text, prices, query, returns, scored, sectors, signals, ticker, weights
from eventalpha.plans.event_queries import _GRID, latest_on_grid


def rounded(df, places=6, but=()):
    return df.select([F.round(c, places).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


def rounded8(df):
    return rounded(df, 8)


_VOL = "least(ln(1 + volume_ratio) / ln(10), 1)"
_RAW = f"""CASE WHEN abs(intensity) > 0.01 THEN sign(intensity) ELSE 0 END * (CAST(0.2 AS DOUBLE) * event_confidence + CAST(0.4 AS DOUBLE) * abs(intensity) + CAST(0.25 AS DOUBLE) * {_VOL} + CAST(0.15 AS DOUBLE) * least(duration_days / 7, 1))
    * CASE WHEN abs(intensity) > 0.01 AND sign(pre_event_sentiment) = sign(intensity) THEN CAST(1.1 AS DOUBLE) ELSE 1 END"""


@query(f"SELECT event_id, round({_RAW}, 6) AS raw_score FROM sigs", "sigs")
def raw_score(spark, d):
    return signals(spark, d).select("event_id", F.round(S.raw_score(), 6).alias("raw_score"))


@query("""SELECT event_id, round(least(0.25 * event_confidence + 0.3 * abs(intensity) + 0.2 * least(volume_ratio / 2, 1) + 0.25 * least(n_posts / 30, 1)
    + CASE WHEN n_sources >= 3 AND source_agreement >= 0.8 THEN 0.2 WHEN n_sources >= 2 AND source_agreement >= 0.5 THEN 0.1 ELSE 0 END, 1), 6) AS confidence FROM sigs""", "sigs")
def signal_confidence(spark, d):
    return signals(spark, d).select("event_id", F.round(S.confidence(), 6).alias("confidence"))


@query("SELECT event_id FROM sigs WHERE (n_posts >= 5 AND volume_ratio >= 0.5 AND abs(intensity) >= 0.1 AND event_confidence >= 0.2) OR n_posts = 0", "sigs")
def signal_filters(spark, d):
    return S.filter_signals(signals(spark, d), False, 5, 0.5, 0.1, 0.2).select("event_id")


def _rank_sql(src: str, by: str, out: str) -> str:
    """The quantile rule by explicit bin edges (the operator works with integer ranks)."""
    return f"""{out}0 AS (SELECT *, count(*) OVER d AS n, rank() OVER (d ORDER BY raw_score) - 1 AS a, count(*) OVER (PARTITION BY {by}, raw_score) AS t, quantile_cont(raw_score, 0.3333) OVER d AS p33, quantile_cont(raw_score, 0.6667) OVER d AS p67,
        row_number() OVER (d ORDER BY raw_score, event_id) AS rn FROM {src} WINDOW d AS (PARTITION BY {by})),
    {out}1 AS (SELECT *, max(CASE WHEN {' OR '.join(f'(5 * a <= {k} * (n - 1) AND {k + 1} * (n - 1) <= 5 * (a + t - 1))' for k in range(5))} THEN 1 ELSE 0 END) OVER (PARTITION BY {by}) AS clash FROM {out}0),
    {out}2 AS (SELECT * EXCLUDE (n, a, t, p33, p67, rn, clash), CAST(CASE WHEN n >= 5 THEN CASE WHEN clash = 1 THEN 3 ELSE greatest(1, (5 * a + n - 2) // (n - 1)) END WHEN n >= 3 THEN CASE WHEN raw_score <= p33 THEN 1 WHEN raw_score >= p67 THEN 5 ELSE 3 END
        WHEN n = 2 THEN CASE WHEN rn = 1 THEN 1 ELSE 5 END ELSE CASE WHEN raw_score > 0 THEN 5 WHEN raw_score < 0 THEN 1 ELSE 3 END END AS INTEGER) AS q FROM {out}1),
    {out} AS (SELECT * EXCLUDE (q), CASE WHEN (q = 5 AND raw_score < 0) OR (q = 1 AND raw_score > 0) THEN 3 ELSE q END AS quintile FROM {out}2)"""


_RANKED = _rank_sql("scored", "date", "ranked")


@query(f", {_RANKED} SELECT event_id, date, quintile FROM ranked", "scored")
def cross_sectional_rank(spark, d):
    return S.quintiles(scored(spark, d), ["date"]).select("event_id", "date", "quintile")


@query("""SELECT event_id, round(z, 5) AS z_score, round(tanh(z), 5) AS signal FROM (SELECT event_id, CASE WHEN count(*) OVER d > 1 THEN (raw_score - avg(raw_score) OVER d) / (stddev_samp(raw_score) OVER d + 1e-6) ELSE 2 * raw_score END AS z
    FROM scored WINDOW d AS (PARTITION BY date))""", "scored")
def zscore_signal(spark, d):
    return S.zscores(scored(spark, d), ["date"]).select("event_id", F.round("z_score", 5).alias("z_score"), F.round("signal", 5).alias("signal"))


@query("""SELECT event_id, CAST(CASE WHEN raw_score <= e[1] THEN 1 WHEN raw_score <= e[2] THEN 2 WHEN raw_score <= e[3] THEN 3 WHEN raw_score <= e[4] THEN 4 ELSE 5 END AS INTEGER) AS quintile
    FROM scored, (SELECT quantile_cont(raw_score, [0.2, 0.4, 0.6, 0.8]) AS e FROM scored)""", "scored")
def global_quintile(spark, d):
    return S.global_quintile(scored(spark, d)).select("event_id", "quintile")


@query("""SELECT event_id, CASE WHEN count(*) OVER w >= 20 THEN round((raw_score - avg(raw_score) OVER w) / (stddev_samp(raw_score) OVER w + 1e-6), 5) END AS rolling_z FROM scored
    WINDOW w AS (PARTITION BY ticker ORDER BY date, event_id ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""", "scored")
def rolling_zscore(spark, d):
    return S.rolling_zscore(scored(spark, d), ["ticker"], ["date", "event_id"]).select("event_id", F.round("rolling_z", 5).alias("rolling_z"))


_PARTS = f"""parts AS (SELECT event_id, date, ticker, category, event_confidence AS event_severity, abs(intensity) AS intensity, {_VOL} AS volume, least(duration_days / 7, 1) AS duration, (event_id * 61 % 201 - 100) / 1000 AS r FROM sigs)"""


def parts(spark, d):
    s, c = signals(spark, d), S.components()
    return s.select("event_id", "date", "ticker", "category", *[v.alias(k) for k, v in c.items()], ((F.col("event_id") * 61 % 201 - 100) / 1000).alias("r"))


NAMES = ["event_severity", "intensity", "volume", "duration"]


@query(f""", {_PARTS}, last AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY category ORDER BY date DESC, event_id) <= 252),
    v AS (SELECT category, {', '.join(f'1 / greatest(var_samp({c}), 1e-6) AS {c}' for c in NAMES)} FROM last GROUP BY category)
    SELECT category, component, round(x / sum(x) OVER (PARTITION BY category), 6) AS weight FROM (UNPIVOT v ON {', '.join(NAMES)} INTO NAME component VALUE x)""", "sigs")
def inv_variance_weights(spark, d):
    last = S.recent(parts(spark, d), [F.desc("date"), F.col("event_id")], 252, ["category"])
    return rounded(S.inverse_variance_weights(last, NAMES, ["category"]))


@query(f""", {_PARTS}, v AS (SELECT category, {', '.join(f'abs(corr({c}, r)) AS {c}' for c in NAMES)} FROM parts GROUP BY category)
    SELECT category, component, round(x / sum(x) OVER (PARTITION BY category), 5) AS weight FROM (UNPIVOT v ON {', '.join(NAMES)} INTO NAME component VALUE x)""", "sigs")
def corr_weights(spark, d):
    return rounded(S.correlation_weights(parts(spark, d), NAMES, "r", ["category"]), 5)


@query("SELECT date, ticker, round(CASE WHEN sum(abs(weight)) OVER (PARTITION BY date) > 0 THEN abs(weight) / sum(abs(weight)) OVER (PARTITION BY date) ELSE 1 / count(*) OVER (PARTITION BY date) END, 8) AS weight FROM weights", "weights")
def normalize_weights(spark, d):
    return rounded8(S.normalize(weights(spark, d).withColumn("weight", F.abs("weight")), ["date"]))


# --- portfolios ---

_QP = """qp0 AS (SELECT *, CASE quintile WHEN 5 THEN 1 WHEN 1 THEN -1 END AS side FROM {src} WHERE quintile IN (1, 5)),
    qp1 AS (SELECT *, least(count(*) FILTER (side = 1) OVER (PARTITION BY {by}), count(*) FILTER (side = -1) OVER (PARTITION BY {by})) AS m, row_number() OVER (PARTITION BY {by}, side ORDER BY event_confidence DESC, event_id) AS r FROM qp0),
    qp AS (SELECT *, side * 0.5 / m AS weight FROM qp1 WHERE r <= m)"""


def quintile_book(spark, d):
    return PO.quintile_portfolio(S.quintiles(scored(spark, d), ["date"]), ["date"], best="event_confidence")


@query(f", {_RANKED}, {_QP.format(src='ranked', by='date')} SELECT date, ticker, event_id, round(weight, 8) AS weight FROM qp", "scored")
def quintile_portfolio(spark, d):
    return quintile_book(spark, d).select("date", "ticker", "event_id", F.round("weight", 8).alias("weight"))


@query(f", {_GRID}, {_rank_sql('book', 'grid_date', 'regrid')}, {_QP.format(src='regrid', by='grid_date')} SELECT grid_date AS date, ticker, event_id, round(weight, 8) AS weight FROM qp", "scored")
def rolling_portfolio(spark, d):
    ranked = S.quintiles(latest_on_grid(spark, d), ["grid_date"])
    return PO.quintile_portfolio(ranked, ["grid_date"], best="event_confidence").select(F.col("grid_date").alias("date"), "ticker", "event_id", F.round("weight", 8).alias("weight"))


def _scaled(src: str, by: str, target: str, keep: str) -> str:
    return f"""SELECT {keep}, CASE WHEN weight > 0 THEN weight * {target} / sum(weight) FILTER (weight > 0) OVER (PARTITION BY {by}) WHEN weight < 0 THEN weight * {target} / -sum(weight) FILTER (weight < 0) OVER (PARTITION BY {by}) ELSE 0 END AS weight FROM {src}"""


_MW = "mw AS (SELECT * FROM weights WHERE weight <> 0)"


def mw(spark, d):
    return weights(spark, d).filter("weight <> 0")


@query(f", {_MW} SELECT date, ticker, round(weight, 8) AS weight FROM ({_scaled('mw', 'date', '0.5', 'date, ticker')})", "weights")
def zscore_portfolio(spark, d):
    return rounded8(PO.zscore_portfolio(mw(spark, d).withColumn("z_score", F.col("weight")), ["date"]).select("date", "ticker", "weight"))


@query(f", {_MW}, c AS (SELECT date, ticker, greatest(least(weight, 0.01), -0.01) AS weight FROM mw) SELECT date, ticker, round(weight, 8) AS weight FROM ({_scaled('c', 'date', '0.5', 'date, ticker')})", "weights")
def position_limits(spark, d):
    return rounded8(PO.position_limits(mw(spark, d), ["date"], 0.01))


@query(f""", {_MW}, s0 AS (SELECT m.*, coalesce(sector, 'UNMAPPED') AS sector FROM mw m LEFT JOIN sectors USING (ticker)),
    s1 AS (SELECT *, 0.1 * sum(abs(weight)) OVER (PARTITION BY date) AS lim, sum(weight) OVER (PARTITION BY date, sector) AS net, sum(weight) FILTER (weight > 0) OVER (PARTITION BY date, sector) AS up, sum(weight) FILTER (weight < 0) OVER (PARTITION BY date, sector) AS dn FROM s0),
    s2 AS (SELECT date, ticker, sector, CASE WHEN abs(net) > lim AND sign(weight) = sign(net) THEN weight * greatest(0, 1 - (net - sign(net) * lim) / CASE WHEN net > 0 THEN up ELSE dn END) ELSE weight END AS weight FROM s1)
    SELECT date, ticker, sector, round(weight, 8) AS weight FROM ({_scaled('s2', 'date', '0.5', 'date, ticker, sector')})""", "weights sectors")
def sector_neutral(spark, d):
    w = J.lookup(mw(spark, d), sectors(spark, d), "ticker", "sector")
    return rounded8(PO.sector_neutral(w, ["date"]).select("date", "ticker", "sector", "weight"))


_PAIRS = """pairs AS (SELECT coalesce(t.date, c.date) AS date, coalesce(t.ticker, c.ticker) AS ticker, coalesce(t.weight, 0) AS target, coalesce(c.weight, 0) AS current
    FROM weights t FULL JOIN (SELECT CAST(date + INTERVAL 1 MONTH AS DATE) AS date, ticker, weight FROM weights) c ON t.date = c.date AND t.ticker = c.ticker)"""


@query(f""", {_PAIRS}, t AS (SELECT *, sum(abs(target - current)) OVER (PARTITION BY date) / 2 AS turn FROM pairs)
    SELECT * FROM (SELECT date, ticker, round(CASE WHEN turn <= 0.05 THEN target ELSE current + 0.05 / turn * (target - current) END, 8) AS weight FROM t) WHERE weight <> 0""", "weights")
def turnover_shrink(spark, d):
    w = weights(spark, d)
    pairs = J.outer_weights(w, w.withColumn("date", F.add_months("date", 1)), ["date", "ticker"])
    return rounded8(PO.turnover_shrink(pairs, ["date"], 0.05).select("date", "ticker", "weight")).filter("weight <> 0")


@query("""SELECT date, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (weight > 0) AS BIGINT) AS n_long, CAST(count(*) FILTER (weight < 0) AS BIGINT) AS n_short, round(coalesce(sum(weight) FILTER (weight > 0), 0), 8) AS long, round(coalesce(sum(weight) FILTER (weight < 0), 0), 8) AS short,
    round(sum(weight), 8) AS net, round(sum(abs(weight)), 8) AS gross, round(avg(abs(weight)), 8) AS mean_abs FROM weights GROUP BY ROLLUP (date)""", "weights")
def portfolio_stats(spark, d):
    return rounded8(PO.portfolio_stats(weights(spark, d)))


@query(f""", k AS (SELECT event_id, date, raw_score * event_confidence * 0.25 AS weight FROM scored WHERE abs(raw_score) >= 0.3) SELECT event_id, date, round(weight, 8) AS weight FROM ({_scaled('k', 'date', '1', 'event_id, date')})""", "scored")
def kelly_sizes(spark, d):
    return rounded8(PO.kelly_sizes(scored(spark, d), ["date"]).select("event_id", "date", "weight"))


_ADV = "adv AS (SELECT ticker, avg(close * volume) AS adv_value FROM prices GROUP BY ticker)"


def adv(spark, d):
    return prices(spark, d).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("adv_value"))


@query(f", {_MW}, {_ADV} SELECT date, ticker, round(CASE WHEN adv_value IS NULL THEN weight ELSE weight * least(1, adv_value * 0.05 / (abs(weight) * 1e6)) END, 8) AS weight FROM mw LEFT JOIN adv USING (ticker)", "weights prices")
def liquidity_cap(spark, d):
    return rounded8(PO.liquidity_cap(mw(spark, d), adv(spark, d), 1e6).select("date", "ticker", "weight"))


_CORR = """rc AS (SELECT a.run_id AS ticker, b.run_id AS other, corr(a.ret, b.ret) AS corr, count(*) AS n FROM rets a JOIN rets b ON a.date = b.date AND a.run_id < b.run_id GROUP BY ALL HAVING count(*) >= 20)"""


def corrs(spark, d):
    return M.return_correlations(returns(spark, d).withColumnRenamed("run_id", "ticker"))


@query(f", {_CORR} SELECT ticker, other, round(corr, 5) AS corr, CAST(n AS BIGINT) AS n FROM rc", "rets")
def return_correlations(spark, d):
    return rounded(corrs(spark, d), 5)


@query(f""", {_CORR}, {_MW}, h(halted) AS (VALUES ('T01'), ('T05')), bp AS (SELECT ticker, other AS halted FROM rc WHERE abs(corr) > 0.02 UNION ALL SELECT other, ticker FROM rc WHERE abs(corr) > 0.02),
    nr AS (SELECT ticker, count(*) AS k FROM bp JOIN h USING (halted) GROUP BY ticker)
    SELECT date, ticker, round(CASE WHEN ticker IN ('T01', 'T05') THEN 0 ELSE weight * pow(0.5, coalesce(k, 0)) END, 8) AS weight FROM mw LEFT JOIN nr USING (ticker)""", "rets weights")
def halt_adjust(spark, d):
    halted = spark.range(2).select(ticker(F.col("id") * 4 + 1).alias("ticker"))
    return rounded8(PO.halt_adjust(mw(spark, d), halted, corrs(spark, d), 0.02).select("date", "ticker", "weight"))


# --- books ---

_CAL = """cal AS (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM prices WHERE date >= (SELECT min(date) FROM scored) AND date <= (SELECT max(date) + 28 FROM scored)) GROUP BY date_trunc('week', date))"""


def calendar(spark, d):
    return B.rebalance_calendar(scored(spark, d), prices(spark, d))


@query(f", {_CAL} SELECT date FROM cal", "scored prices")
def rebalance_calendar(spark, d):
    return calendar(spark, d)


@query("SELECT event_id, date FROM scored WHERE date BETWEEN (SELECT min(date) FROM prices) AND (SELECT max(date) FROM prices)", "scored prices")
def signals_in_range(spark, d):
    return B.signals_in_range(scored(spark, d), prices(spark, d)).select("event_id", "date")


_POS = f"""ent AS (SELECT DISTINCT ticker, date FROM scored WHERE abs(raw_score) >= 0.5), ord AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM ent),
    walk(ticker, n, date, entry, opens) AS (SELECT ticker, n, date, date, true FROM ord WHERE n = 1 UNION ALL
      SELECT o.ticker, o.n, o.date, CASE WHEN o.date >= w.entry + 49 THEN o.date ELSE w.entry END, o.date >= w.entry + 49 FROM walk w JOIN ord o ON o.ticker = w.ticker AND o.n = w.n + 1),
    pos0 AS (SELECT ticker, entry FROM walk WHERE opens), {_CAL},
    pos AS (SELECT p.ticker, p.entry, (SELECT min(date) FROM cal WHERE cal.date >= p.entry + 49) AS exit FROM pos0 p)"""


def entries(spark, d):
    return scored(spark, d).filter("abs(raw_score) >= 0.5").select("ticker", "date")


def intervals(spark, d):
    return B.exit_on_calendar(B.position_intervals(entries(spark, d), 49), calendar(spark, d))


@query(f", {_POS} SELECT ticker, entry, exit FROM pos", "scored prices")
def position_intervals(spark, d):
    return intervals(spark, d)


@query("""SELECT ticker, date, round(CASE WHEN count(lr) OVER w >= 5 AND stddev_samp(lr) OVER w > 0 THEN stddev_samp(lr) OVER w ELSE 0.02 END, 6) AS vol FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM prices)
    WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)""", "prices")
def realized_vol(spark, d):
    return rounded(M.realized_vol(prices(spark, d)).select("ticker", "date", "vol"))


_SLIP = """sl AS (SELECT *, CASE WHEN count(lr) OVER w >= 5 AND stddev_samp(lr) OVER w > 0 THEN stddev_samp(lr) OVER w ELSE 0.02 END AS vol, avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS adv_value
    FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM prices) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))"""


@query(f", {_SLIP} SELECT ticker, date, round(least(greatest(0.0005 + 0.1 * vol * sqrt(least(greatest(1000 / adv_value, 1e-6), 1)), 0), 0.02), 6) AS rate FROM sl", "prices")
def slippage(spark, d):
    p = M.with_adv(M.realized_vol(prices(spark, d))).withColumn("notional", F.lit(1000.0))
    return rounded(M.slippage(p).select("ticker", "date", "rate"))


_LEG = """leg AS (SELECT m.date, m.ticker, m.weight, p.close, m.weight * 100000 / p.close AS want FROM (SELECT * FROM weights WHERE weight <> 0) m ASOF JOIN prices p ON m.ticker = p.ticker AND m.date >= p.date),
    legs AS (SELECT *, CASE WHEN round_even(want, 0) = 0 AND abs(want) >= 0.5 THEN sign(want) ELSE round_even(want, 0) END AS shares FROM leg WHERE close > 0)"""


def legs(spark, d):
    asof = M.price_asof(mw(spark, d), prices(spark, d)).withColumnRenamed("close_asof", "price")
    return B.trade_legs(asof, 100000.0)


@query(f", {_LEG} SELECT date, ticker, CAST(shares AS BIGINT) AS shares, round(shares * close, 6) AS value FROM legs WHERE shares <> 0", "weights prices")
def trade_legs(spark, d):
    return rounded(legs(spark, d).select("date", "ticker", "shares", "value"), 6)


@query(f""", {_POS}, pv AS (SELECT *, CASE WHEN date_diff('day', DATE '2020-01-01', entry) % 2 = 0 THEN -1000 ELSE 1000 END AS value FROM pos WHERE exit IS NOT NULL)
    SELECT c.date, round(sum(-value * CASE WHEN ticker = 'T03' THEN 0.2 ELSE 0.03 END) / 252, 6) AS cost FROM pv JOIN (SELECT DISTINCT date FROM prices) c ON c.date >= entry AND c.date < exit WHERE value < 0 GROUP BY c.date""", "scored prices")
def borrow_cost(spark, d):
    v = F.when(F.datediff("entry", F.lit("2020-01-01").cast("date")) % 2 == 0, F.lit(-1000.0)).otherwise(F.lit(1000.0))
    return rounded(B.borrow_cost(intervals(spark, d).filter("exit is not null").withColumn("value", v), prices(spark, d), overrides={"T03": 0.2}))


@query(f""", {_POS}, pv AS (SELECT *, CASE WHEN date_diff('day', DATE '2020-01-01', entry) % 2 = 0 THEN -10 ELSE 10 END AS shares FROM pos WHERE exit IS NOT NULL)
    SELECT p.date, round(coalesce(sum(shares * close) FILTER (shares > 0), 0), 6) AS long, round(coalesce(-sum(shares * close) FILTER (shares < 0), 0), 6) AS short, round(sum(shares * close), 6) AS value
    FROM pv JOIN prices p ON p.ticker = pv.ticker AND p.date >= entry AND p.date < exit GROUP BY p.date""", "scored prices")
def daily_mtm(spark, d):
    v = F.when(F.datediff("entry", F.lit("2020-01-01").cast("date")) % 2 == 0, F.lit(-10)).otherwise(F.lit(10))
    return rounded(B.mark_to_market(intervals(spark, d).filter("exit is not null").withColumn("shares", v), prices(spark, d)))


_BOOKED = """bw AS (SELECT run_id AS ticker, date, ((date_diff('day', DATE '2020-01-01', date) + CAST(right(run_id, 1) AS INTEGER)) % 5 - 2) / 10 AS weight, ret / 5 AS ret FROM rets)"""


def booked(spark, d):
    r = returns(spark, d).select(F.col("run_id").alias("ticker"), "date", (F.col("ret") / 5).alias("ret"))
    w = r.select("ticker", "date", (((F.datediff("date", F.lit("2020-01-01").cast("date")) + F.right("ticker", F.lit(1)).cast("int")) % 5 - 2) / 10).alias("weight"))
    return B.book_returns(w, r, 0.0001)


@query(f""", {_BOOKED}, b AS (SELECT date, sum(weight * ret) - 0.0001 * sum(abs(weight)) AS ret FROM bw GROUP BY date) SELECT date, round(ret, 6) AS ret, round(ln(exp(sum(ln(1 + ret)) OVER (ORDER BY date))), 4) AS log_equity FROM b""", "rets")
def book_returns(spark, d):
    return booked(spark, d).select("date", F.round("ret", 6).alias("ret"), F.round(F.ln("equity"), 4).alias("log_equity"))


@query("""SELECT ticker, date, n < 100 OR close >= m AS bull, CAST(CASE WHEN n < 100 OR close >= m THEN 1 ELSE 0.5 END AS DOUBLE) AS overlay FROM (SELECT *, count(*) OVER w AS n, avg(close) OVER w AS m FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))""", "prices")
def sma_regime(spark, d):
    return B.sma_regime(prices(spark, d)).select("ticker", "date", "bull", "overlay")


# --- risk ---


@query(f""", {_MW}, r1 AS (SELECT date, ticker, greatest(least(weight, 0.03), -0.03) * CASE WHEN count(*) OVER (PARTITION BY date) < 10 THEN 0.8 ELSE 1 END AS weight FROM mw),
    r2 AS (SELECT date, ticker, weight * CASE WHEN sum(abs(weight)) OVER (PARTITION BY date) > 0.3 THEN 0.3 / sum(abs(weight)) OVER (PARTITION BY date) ELSE 1 END AS weight FROM r1),
    r3 AS (SELECT *, sum(weight) FILTER (weight > 0) OVER (PARTITION BY date) AS l, -sum(weight) FILTER (weight < 0) OVER (PARTITION BY date) AS s FROM r2)
    SELECT date, ticker, round(weight * least(l, s) / CASE WHEN weight > 0 THEN l ELSE s END, 8) AS weight FROM r3 WHERE l > 0 AND s > 0""", "weights")
def risk_controls(spark, d):
    return rounded8(R.risk_controls(mw(spark, d), ["date"], 0.03, 10, 0.3).select("date", "ticker", "weight"))


@query("""SELECT run_id, date, round(CASE WHEN n >= 20 AND v > 0 THEN greatest(least(0.1 / v * greatest(0.5, (1 + tanh(m * 252 / v)) / 2), 3), 0.3) ELSE 1 END, 6) AS scaler
    FROM (SELECT run_id, date, count(*) OVER w AS n, stddev_samp(ret) OVER w * sqrt(252) AS v, avg(ret) OVER w AS m FROM rets WINDOW w AS (PARTITION BY run_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""", "rets")
def vol_target(spark, d):
    return rounded(R.vol_target(returns(spark, d)).select("run_id", "date", "scaler"))


_DD = """eq AS (SELECT run_id, date, ret / 40 AS ret, exp(sum(ln(1 + ret / 40)) OVER (PARTITION BY run_id ORDER BY date)) AS equity FROM rets),
    dd AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY run_id ORDER BY date), 1) - 1 AS drawdown, equity / max(equity) OVER (PARTITION BY run_id ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 AS dd252 FROM eq)"""


def calm(spark, d):
    return returns(spark, d).withColumn("ret", F.col("ret") / 40)


@query(f""", {_DD} SELECT run_id, date, CASE WHEN drawdown >= 0 THEN 0 WHEN drawdown >= CAST(-0.05 AS DOUBLE) THEN 15 WHEN drawdown >= CAST(-0.1 AS DOUBLE) THEN 45 WHEN drawdown >= CAST(-0.15 AS DOUBLE) THEN 90
    WHEN drawdown >= CAST(-0.2 AS DOUBLE) THEN 180 WHEN drawdown >= CAST(-0.3 AS DOUBLE) THEN 365 ELSE 730 END AS days, CASE WHEN drawdown >= 0 THEN 0 WHEN drawdown >= CAST(-0.3 AS DOUBLE) THEN 365 ELSE 730 END AS days_legacy FROM dd""", "rets")
def recovery_days(spark, d):
    dd = R.drawdowns(calm(spark, d))
    return dd.select("run_id", "date", R.recovery_days(F.col("drawdown")).alias("days"), R.recovery_days(F.col("drawdown"), legacy=True).alias("days_legacy"))


@query(f""", {_DD} SELECT run_id, round(greatest(least(avg(ret) / stddev_samp(ret) * sqrt(252) / 2, 2), 0.5), 6) AS leverage FROM dd GROUP BY run_id""", "rets")
def optimal_leverage(spark, d):
    sharpe = F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0))
    return calm(spark, d).groupBy("run_id").agg(F.round(R.optimal_leverage(sharpe), 6).alias("leverage"))


@query(f", {_DD} SELECT run_id, date, round(CASE WHEN drawdown < -0.1 THEN greatest(1 - (abs(drawdown) - 0.1) / 0.1, 0.5) ELSE 1 END, 5) AS scale FROM dd", "rets")
def drawdown_scale(spark, d):
    return rounded(R.drawdown_scale(R.drawdowns(calm(spark, d))).select("run_id", "date", "scale"), 5)


@query(f""", {_DD}, th AS (SELECT run_id, quantile_cont(drawdown, [0.75, 0.5, 0.25, 0.05]) FILTER (drawdown < 0) AS t FROM dd GROUP BY run_id)
    SELECT run_id, CAST(count(*) FILTER (e = 1) AS BIGINT) AS full_days, round(avg(e), 4) AS mean_exposure, round(any_value(t)[4], 5) AS deepest FROM (SELECT dd.run_id, t, CASE WHEN drawdown < t[4] THEN 0.5 WHEN drawdown < t[3] THEN 0.7 WHEN drawdown < t[2] THEN 0.85 WHEN drawdown < t[1] THEN 0.95 ELSE 1 END AS e FROM dd JOIN th USING (run_id)) GROUP BY run_id""", "rets")
def adaptive_drawdown(spark, d):
    dd = R.drawdowns(calm(spark, d))
    j = dd.join(R.adaptive_thresholds(dd), "run_id").withColumn("e", R.exposure(F.col("drawdown"), F.col("thresholds")))
    return j.groupBy("run_id").agg(F.count_if(F.col("e") == 1).alias("full_days"), F.round(F.avg("e"), 4).alias("mean_exposure"), F.round(F.first(F.element_at("thresholds", 4)), 5).alias("deepest"))


@query(f", {_DD} SELECT run_id, date, dd252 <= -0.25 OR coalesce(stddev_samp(ret) OVER (PARTITION BY run_id ORDER BY date ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) * sqrt(252) > 0.5, false) AS halt FROM dd", "rets")
def halt_flag(spark, d):
    return R.halt_flag(calm(spark, d)).select("run_id", "date", "halt")


@query("""SELECT m.date, m.ticker, round(CASE WHEN (b.close / a.close - 1) * sign(m.weight) < -0.1 THEN 0 ELSE m.weight END, 8) AS weight FROM (SELECT * FROM weights WHERE weight <> 0) m ASOF JOIN prices a ON m.ticker = a.ticker AND m.date >= a.date
    ASOF JOIN (SELECT ticker, date - 30 AS date, close FROM prices) b ON m.ticker = b.ticker AND m.date >= b.date""", "weights prices")
def stop_loss(spark, d):
    p = prices(spark, d)
    a = M.price_asof(mw(spark, d), p).withColumnRenamed("close_asof", "entry_price")
    b = M.price_asof(a, p.withColumn("date", F.date_sub("date", 30))).withColumnRenamed("close_asof", "price").filter("entry_price is not null and price is not null")
    return rounded8(R.stop_loss(b).select("date", "ticker", "weight"))


@query("""SELECT run_id, round(q * sqrt(10), 6) AS var, round(avg(ret) FILTER (ret <= q), 6) AS es FROM (SELECT run_id, ret, quantile_cont(ret, 0.05) OVER (PARTITION BY run_id) AS q FROM rets) GROUP BY run_id, q""", "rets")
def var_es(spark, d):
    return rounded(R.var_es(returns(spark, d), horizon=10))


_BASE = "bl AS (SELECT ticker, count(*) / greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)), 1) AS base_volume, avg(sentiment) AS base_sentiment FROM posts GROUP BY ticker HAVING count(*) >= 20)"


@query(f", {_BASE} SELECT ticker, round(base_volume, 6) AS base_volume, round(base_sentiment, 6) AS base_sentiment FROM bl", "posts")
def scandal_baseline(spark, d):
    return rounded(R.scandal_baselines(posts(spark, d)))


KEYWORDS = [("the", "E"), ("que", "S"), ("und", "G"), ("license", "G"), ("secret", "S")]
_KW = ", ".join(f"('{t}', '{c}', {i})" for i, (t, c) in enumerate(KEYWORDS))
_SCAND = f"""{_BASE}, kw(term, cat, nth) AS (VALUES {_KW}), sw AS (SELECT p.*, (SELECT arg_min(struct_pack(t := kw.term, c := kw.cat), kw.nth) FROM kw WHERE contains(lower(p.text), kw.term)) AS k FROM posts_text p WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOURS),
    sg AS (SELECT ticker, count(*) AS n_posts, avg(sentiment) AS s, count(DISTINCT k) AS n_keywords, count(DISTINCT k.t) FILTER (k.c = 'E') AS e, count(DISTINCT k.t) FILTER (k.c = 'S') AS sn, count(DISTINCT k.t) FILTER (k.c = 'G') AS g FROM sw GROUP BY ticker HAVING count(*) >= 10),
    sj AS (SELECT sg.*, round(n_posts / greatest(coalesce(base_volume, 10), 1), 9) AS spike, round(s - coalesce(base_sentiment, 0), 9) AS crash FROM sg LEFT JOIN bl USING (ticker)),
    sp AS (SELECT *, CASE WHEN spike > 10 THEN 8 WHEN spike > 5 THEN 5 WHEN spike > 2.5 THEN 2 ELSE 0 END + CASE WHEN crash < -0.8 THEN 8 WHEN crash < -0.5 THEN 5 WHEN crash < -0.3 THEN 2 ELSE 0 END + CASE WHEN n_keywords >= 5 THEN 4 WHEN n_keywords >= 2 THEN 2 ELSE 0 END AS pts FROM sj),
    sc AS (SELECT *, CASE WHEN pts >= 16 THEN 'CRITICAL' WHEN pts >= 10 THEN 'HIGH' WHEN pts >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN e >= sn AND e >= g THEN 'E' WHEN sn >= g THEN 'S' ELSE 'G' END AS category FROM sp)"""


@query(f", {_SCAND} SELECT ticker, CAST(n_posts AS BIGINT) AS n_posts, round(spike, 6) AS volume_spike, round(crash, 6) AS sentiment_crash, CAST(n_keywords AS INTEGER) AS n_keywords, severity, category FROM sc WHERE severity <> 'LOW' OR n_keywords > 0", "posts_text")
def scandals(spark, d):
    p = posts_text(spark, d)
    return rounded(R.scandals(p, R.scandal_baselines(posts(spark, d)), KEYWORDS, "2024-01-20 00:00:00"))


@query("""SELECT ticker, max(ts + to_hours(h)) AS until, CAST(max(c) AS DOUBLE) AS exposure_cut FROM (SELECT ticker, ts, CASE severity WHEN 'CRITICAL' THEN 48 WHEN 'HIGH' THEN 24 WHEN 'MEDIUM' THEN 12 END AS h, CASE severity WHEN 'CRITICAL' THEN 0.5 WHEN 'HIGH' THEN 0.25 ELSE 0 END AS c FROM graded) WHERE h IS NOT NULL
    GROUP BY ticker HAVING max(ts + to_hours(h)) > TIMESTAMP '2024-01-30 12:00:00'""", "graded")
def halts(spark, d):
    s = posts(spark, d).select("ticker", "ts", grade(F.col("sentiment")).alias("severity"))
    return R.halts(s, "2024-01-30 12:00:00")


_REG = """w0 AS (SELECT run_id, date, ret / 10 AS ret, row_number() OVER (PARTITION BY run_id ORDER BY date) AS n FROM rets),
    w1 AS (SELECT *, sum(ret) OVER s AS r, stddev_samp(ret) OVER s * sqrt(252) AS v, stddev_samp(ret) OVER l * sqrt(252) AS lv, avg(ret) OVER s AS m, stddev_samp(ret) OVER s AS sd, corr(x, ret) OVER s AS c FROM (SELECT *, (n * 37 % 101 - 50) / 100 AS x FROM w0)
      WINDOW s AS (PARTITION BY run_id ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), l AS (PARTITION BY run_id ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
    w2 AS (SELECT *, CASE WHEN n < 63 THEN 'NORMAL' WHEN r < -0.15 AND v > 0.3 THEN 'CRISIS' WHEN r > 0.1 THEN 'TREND_UP' WHEN r < -0.1 THEN 'TREND_DOWN' WHEN n < 252 THEN 'NORMAL' WHEN v / lv > 1.5 THEN 'HIGH_VOLATILITY' WHEN v / lv < 0.6 THEN 'LOW_VOLATILITY' ELSE 'NORMAL' END AS regime,
      CASE WHEN n >= 63 THEN coalesce(m / sd, 0) * sqrt(252) END AS sharpe FROM w1),
    w3 AS (SELECT *, CASE WHEN count(sharpe) OVER h >= 10 AND stddev_pop(sharpe) OVER h >= 0.001 THEN (sharpe - avg(sharpe) OVER h) / stddev_pop(sharpe) OVER h ELSE 0 END AS sharpe_z,
      CASE WHEN n >= 63 AND c IS NOT NULL THEN (atanh(CAST(0.5 AS DOUBLE)) - atanh(greatest(least(c, 0.99), -0.99))) / sqrt(2 / 60) ELSE 0 END AS corr_z FROM w2 WINDOW h AS (PARTITION BY run_id ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"""


def tenth(spark, d):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("run_id").orderBy("date"))
    return returns(spark, d).withColumn("ret", F.col("ret") / 10).withColumn("x", (n * 37 % 101 - 50) / 100)


@query(f", {_REG} SELECT run_id, date, regime FROM w2", "rets")
def regimes(spark, d):
    return R.regimes(tenth(spark, d)).select("run_id", "date", "regime")


@query(f", {_REG} SELECT run_id, date, round(sharpe, 5) AS sharpe, round(sharpe_z, 4) AS sharpe_z FROM w3", "rets")
def sharpe_degradation(spark, d):
    return R.sharpe_degradation(tenth(spark, d)).select("run_id", "date", F.round("sharpe", 5).alias("sharpe"), F.round("sharpe_z", 4).alias("sharpe_z"))


@query(f", {_REG} SELECT run_id, date, round(corr_z, 4) AS corr_z FROM w3", "rets")
def corr_breakdown(spark, d):
    return R.correlation_breakdown(tenth(spark, d), 0.5).select("run_id", "date", F.round("corr_z", 4).alias("corr_z"))


@query(f""", {_REG}, w4 AS (SELECT *, coalesce(lag(regime) OVER (PARTITION BY run_id ORDER BY date), 'NORMAL') AS previous FROM w3),
    w5 AS (SELECT *, list_filter([CASE WHEN sharpe_z < -2 THEN 'sharpe' END, CASE WHEN corr_z > 5 THEN 'correlation' END, CASE WHEN regime <> previous THEN 'regime' END], lambda x: x IS NOT NULL) AS a FROM w4)
    SELECT run_id, date, previous, regime, array_to_string(a, ',') AS affected, round(least(least(abs(sharpe_z) / 4, 0.3) + least(abs(corr_z) / 4, 0.3) + least(len(a) / 6, 0.3) + 0.1, 1), 4) AS confidence FROM w5 WHERE len(a) > 0""", "rets")
def regime_changes(spark, d):
    df = R.correlation_breakdown(R.sharpe_degradation(R.regimes(tenth(spark, d))), 0.5)
    return R.regime_changes(df, 2.0, 5.0).withColumn("confidence", F.round("confidence", 4))
