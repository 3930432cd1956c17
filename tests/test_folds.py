"""Distributed folds, blocked correlations and walk-forward against plain versions."""

import datetime
import random

import numpy as np
import pytest

from eventalpha.operators import market as M
from eventalpha.operators import perf as P
from eventalpha.operators import validation as V
from eventalpha.operators.folds import Fold, carried, merged
from eventalpha.operators.ranks import grouped_percentiles

DAY0 = datetime.date(2024, 1, 1)


def by_hand(trades):
    held = entry = 0.0
    out = []
    for shares, price in trades:
        if held == 0:
            held, entry = shares, price
        elif held * shares > 0:
            entry = (held * entry + shares * price) / (held + shares)
            held += shares
        else:
            out.append((price - entry) / entry * np.sign(held))
            held, entry = (0.0, 0.0) if abs(shares) >= abs(held) else (held + shares, entry)
    return out


@pytest.mark.parametrize("hold", [0.5, 0.95])
def test_trades_of_a_hot_name_over_many_parts(spark, hold):
    rng = random.Random(int(hold * 100))
    rows = []
    for name, n in (("hot", 900), ("a", 30), ("b", 1), ("c", 40)):
        # With hold near 1 a position stays open over whole parts, so seeds must travel.
        rows += [(name, i, float(rng.randint(1, 9) if rng.random() < hold else -rng.randint(1, 9)), float(rng.randint(50, 150))) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, n long, shares double, price double").repartition(7)
    got = P.trade_returns(df, ["ticker"], ["n"])
    expected = {t: by_hand([r[2:] for r in rows if r[0] == t]) for t in {r[0] for r in rows}}
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.ticker, r.nth)):
        assert r.nth == len(found.setdefault(r.ticker, []))
        found[r.ticker].append(r.trade_return)
    assert {t: pytest.approx(v) for t, v in expected.items() if v} == found


def test_state_that_never_resets_is_carried_over_every_part(spark):
    rows = [("x", i, i % 7) for i in range(500)] + [(None, i, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, n long, v long").repartition(5)
    step = lambda s, row: (s + row[0], (s + row[0],))
    got = sorted((r.nth, r.total) for r in carried(df, ["k"], ["n"], ["v"], 0, step, "total long", parts=16).collect() if r.k == "x")
    sums = np.cumsum([i % 7 for i in range(500)]).tolist()
    assert got == list(enumerate(sums))
    assert carried(df.limit(0), ["k"], ["n"], ["v"], 0, step, "total long").count() == 0


def test_merged_states(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["p", "q", None]), rng.randint(0, 2), rng.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, g int, v double").repartition(9)
    # Mean and variance by pairwise merging, and more than one row a group.
    update = lambda s, f: join(s, (len(f), float(f["v"].mean()), float(((f["v"] - f["v"].mean()) ** 2).sum())))

    def join(a, b):
        n = a[0] + b[0]
        apart = b[1] - a[1]
        return (n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n)

    fold = Fold(lambda: (0, 0.0, 0.0), update, join, lambda s: [("mean", s[1]), ("var", s[2] / s[0])])
    got = {(r.k, r.g, r.what): r.value for r in merged(df, ["k", "g"], fold, "what string, value double").collect()}
    assert len(got) == 18
    for k in ("p", "q", None):
        for g in range(3):
            v = [r[2] for r in rows if r[:2] == (k, g)]
            assert got[k, g, "mean"] == pytest.approx(np.mean(v)) and got[k, g, "var"] == pytest.approx(np.var(v))
    assert merged(df.limit(0), ["k", "g"], fold, "what string, value double").count() == 0


def test_blocked_correlations_with_missing_dates(spark):
    rng = random.Random(5)
    rows = [(f"T{t}", DAY0 + datetime.timedelta(d), 100 + rng.gauss(0, 1) + t * d / 50) for t in range(7) for d in range(60) if rng.random() < 0.8]
    rows += [("flat", DAY0 + datetime.timedelta(d), 1.0) for d in range(60)] + [("few", DAY0 + datetime.timedelta(d), d * 1.0) for d in range(5)] + [("T0", DAY0 + datetime.timedelta(99), None)]
    df = spark.createDataFrame(rows, "ticker string, date date, ret double")
    got = {(r.ticker, r.other): (r.corr, r.n) for r in M.return_correlations(df, 20, block=3, days=7).collect()}
    series = {}
    for t, d, x in rows:
        if x is not None:
            series.setdefault(t, {})[d] = x
    expected = {}
    for a in series:
        for b in series:
            both = sorted(set(series[a]) & set(series[b]))
            if a < b and len(both) >= 20:
                x, y = ([s[d] for d in both] for s in (series[a], series[b]))
                expected[a, b] = (None if np.std(x) == 0 or np.std(y) == 0 else pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9), len(both))
    assert got == expected


@pytest.fixture
def walk(spark):
    rng = random.Random(8)
    rows = [(i, DAY0 + datetime.timedelta(i), rng.gauss(0, 0.5), rng.gauss(0, 2.0), rng.gauss(0, 0.01)) for i in range(540)]
    return spark.createDataFrame(rows, "id int, date date, a double, b double, ret double"), V.windows(spark, "2024-01-01", "2025-06-20", train_months=6, step_months=3), rows


def test_weights_come_from_training_rows_only(spark, walk):
    from pyspark.sql import functions as F

    df, folds, rows = walk
    own = V.assign(df, folds)
    weights = {r.fold: (r.a, r.b) for r in V.train_weights(own, ["a", "b"]).collect()}
    first = [r for r in rows if r[1] < DAY0 + datetime.timedelta(180)]
    inverse = [1 / np.var([r[k] for r in first], ddof=1) for k in (2, 3)]
    assert weights[0] == pytest.approx(tuple(x / sum(inverse) for x in inverse))
    # Other values from the first test window on leave the first fold's weights as they are.
    later = df.withColumns({c: F.when(F.col("date") >= F.lit(DAY0 + datetime.timedelta(185)), F.col(c) * 100 + 3).otherwise(F.col(c)) for c in ("a", "b")})
    changed = {r.fold: (r.a, r.b) for r in V.train_weights(V.assign(later, folds), ["a", "b"]).collect()}
    assert changed[0] == weights[0] and changed[max(changed)] != weights[max(weights)]


def test_fold_metrics_by_hand(spark, walk):
    df, folds, rows = walk
    own = V.assign(df, folds)
    weights = V.train_weights(own, ["a", "b"], "correlation")
    got = {r.fold: r for r in V.fold_metrics(V.backtest(own, weights, ["a", "b"], 0.3)).collect()}
    w = {r.fold: (r.a, r.b) for r in weights.collect()}
    for f in folds.collect():
        for split, low, high in (("train", f.train_start, f.train_end), ("test", f.test_start, f.test_end)):
            picked = [(np.sign(x) * r[4]) for r in rows if low <= r[1] < high and abs(x := r[2] * w[f.fold][0] + r[3] * w[f.fold][1]) >= 0.3]
            equity = np.cumprod(1 + np.array(picked))
            r = got[f.fold].asDict()
            assert r[f"{split}_n_trades"] == len(picked)
            assert r[f"{split}_sharpe"] == pytest.approx(np.mean(picked) / np.std(picked, ddof=1) * 252**0.5)
            assert r[f"{split}_return"] == pytest.approx(equity[-1] - 1)
            assert r[f"{split}_max_drawdown"] == pytest.approx(min(0, (equity / np.maximum(np.maximum.accumulate(equity), 1) - 1).min()))
        assert got[f.fold].overfit_ratio == pytest.approx(got[f.fold].test_sharpe / got[f.fold].train_sharpe)


def test_aggregate_probabilities(spark):
    from statistics import NormalDist

    sharpes = [0.5, 1.5, -0.2, 0.9]
    m = spark.createDataFrame([(i, 1.0, s, 3, 0.1, s) for i, s in enumerate(sharpes)], "fold int, train_sharpe double, test_sharpe double, test_n_trades long, test_return double, overfit_ratio double")
    r = V.aggregate(m).first()
    mean, std, cdf, inv = np.mean(sharpes), np.std(sharpes, ddof=1), NormalDist().cdf, NormalDist().inv_cdf
    best = (1 - 0.5772156649) * inv(1 - 1 / 4) + 0.5772156649 * inv(1 - 1 / (4 * np.e))
    assert r.probabilistic_sharpe == pytest.approx(cdf(mean / (std / 2)))
    assert r.deflated_sharpe == pytest.approx(cdf((mean - std * best) / (std / 2)))
    assert (r.folds, r.n_trades, r.profitable, r.passes) == (4, 12, 0.75, False)
    one = V.aggregate(m.limit(1)).first()
    assert (one.probabilistic_sharpe, one.deflated_sharpe) == (1.0, 0.5)


@pytest.mark.parametrize("whole", [50, 10_000])
def test_grouped_percentiles(spark, whole):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [("big", rng.gauss(0, 1)) for _ in range(4000)] + [("ties", float(rng.randint(0, 3))) for _ in range(900)] + [("one", 2.5), (None, 1.0), (None, 3.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {r.k: (r._n, r._p) for r in grouped_percentiles(df, ["k"], "v", shares, whole).collect()}
    want = {r.k: (r.n, r.p) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("p")).filter("n > 0").collect()}
    assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str))  # to the last digit
    assert grouped_percentiles(df.limit(0), ["k"], "v", shares).count() == 0
