"""Hand-computed values, invariants, edge frames and plan shapes."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from eventalpha.functions import lexicon as L
from eventalpha.functions import text as X
from eventalpha.functions.normal import t_two_sided
from eventalpha.operators import book as B
from eventalpha.operators import features as FE
from eventalpha.operators import joins as J
from eventalpha.operators import market as M
from eventalpha.operators import portfolio as PO
from eventalpha.operators import posts as P
from eventalpha.operators import risk as R
from eventalpha.operators import scoring as S
from eventalpha.operators import validation as V
from eventalpha.operators import words as W

D = dt.date(2024, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def scored(spark, rows):
    return spark.createDataFrame([(i, f"T{i}", day(d), s, 0.5) for i, (d, s) in enumerate(rows)], "event_id long, ticker string, date date, raw_score double, event_confidence double")


@pytest.mark.parametrize("conf, intensity, vr, dur, pre, want", [(0.5, 0.4, 3.0, 5, 0.0, 0.5177), (0.5, -0.4, 3.0, 5, 0.0, -0.5177), (0.8, 1.0, 10.0, 7, 0.0, 0.96), (0.9, 0.005, 3.0, 5, 0.0, 0.0), (0.8, 1.0, 10.0, 7, 0.2, 1.056)])
def test_raw_score(spark, conf, intensity, vr, dur, pre, want):
    df = spark.createDataFrame([(conf, intensity, vr, dur, pre)], "event_confidence double, intensity double, volume_ratio double, duration_days int, pre_event_sentiment double")
    assert df.select(S.raw_score()).first()[0] == pytest.approx(want, abs=1e-3)


def by_sorting(scores):
    """The quantile rule from explicit edges, in fractions."""
    from fractions import Fraction as Q

    n, xs = len(scores), sorted(scores)
    if n == 1:
        out = [5 if scores[0] > 0 else 1 if scores[0] < 0 else 3]
    elif n == 2:
        first = 0 if scores[0] <= scores[1] else 1
        out = [1 if i == first else 5 for i in range(2)]
    elif n < 5:
        at = lambda p: xs[int(p * (n - 1))] + (p * (n - 1) - int(p * (n - 1))) * ((xs[min(int(p * (n - 1)) + 1, n - 1)]) - xs[int(p * (n - 1))])
        out = [1 if s <= at(0.3333) else 5 if s >= at(0.6667) else 3 for s in scores]
    else:
        edges = []
        for k in range(6):
            p = Q(k * (n - 1), 5)
            low = int(p)
            edges.append(Q(xs[low]) + (p - low) * (Q(xs[min(low + 1, n - 1)]) - Q(xs[low])))
        if len(set(edges)) < 6:
            out = [3] * n
        else:
            out = [max(1, next(k for k in range(1, 6) if Q(s) <= edges[k])) if s > edges[0] else 1 for s in scores]
    return [3 if (q == 5 and s < 0) or (q == 1 and s > 0) else q for q, s in zip(out, scores)]


def test_quintiles_against_edges(spark):
    random.seed(5)
    dates = [[random.randint(-6, 6) / 8 for _ in range(n)] for n in [1, 1, 2, 2, 3, 4, 5, 6, 6, 11, 11, 16, 16, 21, 30, 30] for _ in range(6)]
    rows = [(d, s) for d, scores in enumerate(dates) for s in scores]
    got = {}
    for r in S.quintiles(scored(spark, rows), ["date"]).orderBy("event_id").collect():
        got.setdefault((r.date - D).days, []).append(r.quintile)
    assert got == {d: by_sorting(s) for d, s in enumerate(dates)}


def test_zscores_of_one_and_many(spark):
    z = {r.event_id: r for r in S.zscores(scored(spark, [(0, 0.4), (1, 0.1), (1, 0.3)]), ["date"]).collect()}
    assert z[0].z_score == pytest.approx(0.8) and z[0].signal == pytest.approx(math.tanh(0.8))
    assert z[1].z_score == pytest.approx(-z[2].z_score)


def test_book_is_neutral_and_one_sided_dates_are_empty(spark):
    rows = [(0, s) for s in (0.9, 0.5, 0.3, -0.3, -0.5, -0.9)] + [(1, 0.5)]
    p = PO.quintile_portfolio(S.quintiles(scored(spark, rows), ["date"]), ["date"], best="event_confidence")
    w = [r.weight for r in p.filter(F.col("date") == day(0)).collect()]
    assert sum(w) == pytest.approx(0) and sum(map(abs, w)) == pytest.approx(1)
    assert p.filter(F.col("date") == day(1)).count() == 0


def test_limits_scope_and_sector_clamp(spark):
    w = spark.createDataFrame([(0, "A", 0.9, "x"), (0, "B", 0.1, "y"), (0, "C", -0.5, "x"), (1, "A", 0.2, "x")], "g int, ticker string, weight double, sector string")
    by_date = {(r.g, r.ticker): r.weight for r in PO.position_limits(w, ["g"], 0.1).collect()}
    assert by_date[0, "A"] == pytest.approx(0.25) and by_date[1, "A"] == pytest.approx(0.5)
    frame = {(r.g, r.ticker): r.weight for r in PO.position_limits(w, [], 0.1).collect()}
    assert frame[1, "A"] == pytest.approx(0.5 / 3)
    s = PO.sector_neutral(w.filter("g = 0"), ["g"], 0.1, None)
    net = {r.sector: r.n for r in s.groupBy("sector").agg(F.sum("weight").alias("n")).collect()}
    assert net["x"] == pytest.approx(0.15)


def test_turnover_at_and_over_budget(spark):
    pairs = spark.createDataFrame([("A", 0.5, 0.0), ("B", 0.0, 0.5)], "ticker string, target double, current double")
    assert {r.ticker: r.weight for r in PO.turnover_shrink(pairs, [], 0.5).collect()} == {"A": 0.5}
    assert {r.ticker: r.weight for r in PO.turnover_shrink(pairs, [], 0.25).collect()} == {"A": 0.25, "B": 0.25}


def test_interval_join_edges_and_brute_force(spark):
    at = dt.datetime(2024, 1, 20)
    us = dt.timedelta(microseconds=1)
    stamps = [at, at + dt.timedelta(days=3), at + dt.timedelta(days=3) + us, at - dt.timedelta(days=10), at - dt.timedelta(days=10) - us]
    random.seed(2)
    posts = [(i, "A", t) for i, t in enumerate(stamps)] + [(100 + i, random.choice("AB"), at + dt.timedelta(hours=random.randint(-900, 900))) for i in range(300)]
    events = [(1, "A", at.date()), (2, "A", at.date() + dt.timedelta(days=5)), (3, "B", at.date()), (4, "C", at.date())]
    p = spark.createDataFrame(posts, "post_id long, ticker string, ts timestamp_ntz")
    e = spark.createDataFrame(events, "event_id long, ticker string, event_date date")
    joined = J.interval_join(p, e, 10, 3)
    want = {(ev, pid) for ev, k, day_ in events for pid, t, ts in posts if k == t and dt.timedelta(days=-10) <= ts - dt.datetime.combine(day_, dt.time()) <= dt.timedelta(days=3)}
    rows = [(r.event_id, r.post_id) for r in joined.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert {p for e_, p in rows if e_ == 1 and p < 100} == {0, 1, 3}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_interval_join_meets_lists_of_events(spark):
    """Events of a ticker and date reach the join as lists of bounded length, and each comes out with each post once."""
    at = dt.datetime(2024, 1, 20)
    p = spark.createDataFrame([(i, "A", at + dt.timedelta(hours=i)) for i in range(100)], "post_id long, ticker string, ts timestamp_ntz")
    e = spark.range(9000).select(F.col("id").alias("event_id"), F.lit("A").alias("ticker"), F.lit(at.date()).alias("event_date"))
    e = e.union(e.filter("event_id = 7")).union(e.select("event_id", F.lit("B"), "event_date")).union(e.select("event_id", F.lit(None), "event_date"))
    sizes = J.listed(e.filter("ticker = 'A'"), ["ticker", "event_date"]).select(F.size("_listed")).collect()
    assert len(sizes) == 3 and sum(n for n, in sizes) == 9001 and max(n for n, in sizes) < 1.2 * J.LISTED
    joined = J.interval_join(p, e, 10, 3, digits=6)
    assert set(joined.columns) == {"ticker", "post_id", "ts", "event_id", "event_date", "days", "day"}
    assert joined.count() == 73 * 9001 and joined.filter("event_id = 7").count() == 146
    assert {(r.post_id, r.days) for r in joined.filter("event_id = 8").collect()} == {(i, round(i / 24, 6)) for i in range(73)}


def test_interval_join_rows_of_a_list_recur_post_by_post(spark):
    """Rows come out by day and list, so that a column of events written from them repeats itself."""
    at = dt.datetime(2024, 1, 20)
    random.seed(3)
    p = spark.createDataFrame([(i, random.choice("AB"), at + dt.timedelta(hours=random.randint(-200, 70))) for i in range(600)], "post_id long, ticker string, ts timestamp_ntz")
    e = spark.createDataFrame([(i, "AB"[i % 2], (at + dt.timedelta(days=i // 2 % 3)).date()) for i in range(24)], "event_id long, ticker string, event_date date")
    rows = [r[:] for r in J.interval_join(p.repartition(7), e, 10, 3).select("ticker", "day", "event_date", "post_id").collect()]
    blocks = [k for k, before in zip(rows, [None, *rows]) if before is None or k[:3] != before[:3]]
    assert len(rows) > 6000 and len(blocks) == len({r[:3] for r in rows}) < 90


def test_asof_before_first_on_gap_and_null(spark):
    prices = spark.createDataFrame([("A", day(5), 10.0), ("A", day(7), None), ("A", day(9), 12.0)], "ticker string, date date, close double")
    ask = spark.createDataFrame([(1, "A", day(1)), (2, "A", day(5)), (3, "A", day(8)), (4, "A", day(30)), (5, "Z", day(9))], "id long, ticker string, date date")
    got = {r.id: r.close_asof for r in M.price_asof(ask, prices).collect()}
    assert got == {1: None, 2: 10.0, 3: 10.0, 4: 12.0, 5: None}


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    rows = [("b", 1, "Hello World"), ("a", 2, " hello world"), ("a", 3, "other")]
    df = spark.createDataFrame(rows, "source string, id long, text string")
    once = P.dedup_text(df, [F.col("source"), F.col("id")])
    assert {r.id for r in once.collect()} == {2, 3}
    assert P.dedup_text(once, [F.col("source"), F.col("id")]).count() == 2


def test_detection_rules(spark):
    lex = L.load([("E", "negative", "fine"), ("E", "negative", "Oil Spill"), ("G", "positive", "award"), ("E", "negative", "fine")])
    assert len(lex) == 3
    rows = [("An oil spill; a FINE.",), ("define refined",), (None,), ("award fine",)]
    got = [(r.num_matches, r.category, r.sentiment) for r in L.detect(spark.createDataFrame(rows, "text string"), lex).collect()]
    assert got == [(2, "E", "negative"), (0, None, None), (0, None, None), (2, "E", "negative")]


def loop(text, weights, shifters, negators, terminators, window=5):
    left, mod, out = 0, 1.0, []
    for w in text.lower().split():
        w = w.strip(".,!?;:")
        if w in negators:
            left = window
            continue
        if w in shifters:
            mod *= shifters[w]
            continue
        if w in weights:
            out.append(weights[w] * mod * (-0.8 if left > 0 else 1))
            mod = 1.0
        left = max(left - 1, 0)
        if any(t in w for t in terminators):
            left = 0
    return out


def test_rule_sentiment_against_a_loop(spark):
    random.seed(4)
    vocab = ["good", "bad", "not", "very", "slightly", "but", "distribution", "a", "b", "good,", "never."]
    texts = [" ".join(random.choice(vocab) for _ in range(random.randint(0, 18))) for _ in range(400)]
    args = ({"good": 0.8, "bad": -0.7}, {"very": 1.5, "slightly": 0.5}, ("not", "never"), ("but",))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", L.rule_sentiment(F.col("text"), *args).alias("s"))
    for r in df.collect():
        want = loop(texts[r.i], *args)
        assert r.s.n == len(want)
        assert r.s.score == pytest.approx(max(-1, min(1, sum(want) / len(want))) if want else 0.0)


def test_ranks_tiles_and_percentiles(spark):
    from eventalpha.operators import ranks as RA

    rng = random.Random(4)
    rows = [(i, rng.choice([rng.random(), 0.5, float(i % 7)])) for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    got = {r.id: r._rank for r in RA.with_rank(df, ["v", "id"]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    from pyspark.sql.window import Window

    for n, tiles in ((1003, 5), (7, 5), (3, 5), (10, 5)):
        r = spark.range(n).withColumn("a", RA.tile(F.col("id"), n, tiles)).withColumn("b", F.ntile(tiles).over(Window.orderBy("id")))
        assert not r.filter("a <> b").count()
    shares = [0.0, 0.2, 0.5, 0.77, 1.0]
    with_nulls = df.withColumn("v", F.when(F.col("id") % 10 > 0, F.col("v")))
    for frame in (df, with_nulls, df.limit(1), df.limit(4)):
        want = frame.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0]
        n, found = RA.percentiles(frame, "v", shares)
        assert n == frame.filter("v is not null").count() and found == pytest.approx(want or [])
    assert RA.percentiles(df.limit(0), "v", shares) == (0, [])


def test_truncation_and_sections(spark):
    row = spark.createDataFrame([("ab cd. efgh ijkl",)], "t string").select(
        X.truncate_sentence(F.col("t"), 6), X.truncate_word(F.col("t"), 12), X.item_sections(F.lit("Item 1.01 A\nx\nITEM 1.01  B\n y \n"))).first()
    assert row[0] == "ab cd." and row[1] == "ab cd. efgh"
    assert [(s.item, s.title, s.content) for s in row[2]] == [("1.01", "A", "x"), ("1.01", "B", "y")]


def test_reaction_without_posts_and_counts(spark):
    e = spark.createDataFrame([(1, "A", day(10)), (2, "B", day(10))], "event_id long, ticker string, event_date date")
    ts = lambda n: dt.datetime.combine(day(n), dt.time(12))
    p = spark.createDataFrame([(i, "A", ts(n), 0.5, 1, 10, 100, 0.5) for i, n in enumerate((8, 10, 11))], "post_id long, ticker string, ts timestamp_ntz, sentiment double, retweets long, likes long, followers long, quality double")
    f = {r.event_id: r for r in FE.with_defaults(e, FE.reaction_features(p, e)).collect()}
    assert (f[1].n_posts, f[1].n_pre, f[1].n_post) == (3, 1, 2) and f[1].intensity == pytest.approx(0.5)
    assert f[1].volume_ratio == pytest.approx(math.log1p(2)) and f[2].volume_ratio == 1.0 and f[2].n_posts == 0


def test_positions_do_not_overlap(spark):
    random.seed(1)
    entries = [(t, day(random.randint(0, 300))) for t in "AB" for _ in range(60)]
    got = {}
    for r in B.position_intervals(spark.createDataFrame(entries, "ticker string, date date"), 49).orderBy("ticker", "entry").collect():
        got.setdefault(r.ticker, []).append(r.entry)
    for t in "AB":
        want = []
        for d in sorted({d for k, d in entries if k == t}):
            if not want or d >= want[-1] + dt.timedelta(days=49):
                want.append(d)
        assert got[t] == want


def test_exposure_ladder_and_legacy(spark):
    th = F.array(*[F.lit(x) for x in (-0.1, -0.15, -0.2, -0.25)])
    df = spark.createDataFrame([(x,) for x in (0.0, -0.05, -0.12, -0.17, -0.22, -0.3)], "dd double")
    assert [r[0] for r in df.select(R.exposure(F.col("dd"), th)).collect()] == [1.0, 1.0, 0.95, 0.85, 0.7, 0.5]
    assert [r[0] for r in df.select(R.exposure(F.col("dd"), th, legacy=True)).collect()] == [1.0, 0.95, 0.95, 0.95, 0.95, 0.5]


def test_folds_keep_order_and_embargo(spark):
    f = V.windows(spark, "2020-01-01", "2023-01-01").orderBy("fold").collect()
    assert len(f) >= 4 and len({r.train_start for r in f}) == 1
    assert all((r.test_start - r.train_end).days >= 5 and r.test_end > r.test_start for r in f)
    assert all(b.train_end > a.train_end for a, b in zip(f, f[1:])) and f[-1].test_end <= dt.date(2023, 1, 1)


def test_word_scores_count_a_word_once_per_document(spark):
    df = spark.createDataFrame([(["a", "a", "b"], 1.0), (["a"], 3.0), (["b", "c"], 5.0)], "w array<string>, r double")
    got = {r.word: (r.n_docs, r.corr) for r in W.word_correlations(df, "w", "r", 1).collect()}
    sd = math.sqrt(8 / 3)
    assert got["a"] == (2, pytest.approx((2 - 3) / sd)) and got["c"] == (1, pytest.approx(2 / sd))


def test_probabilistic_and_deflated_sharpe(spark):
    """Against the published formulas on numpy arrays."""
    from statistics import NormalDist

    import numpy as np

    from eventalpha.operators import perf as PE

    rng = np.random.default_rng(3)
    runs = {"a": rng.normal(0.001, 0.01, 300), "b": np.r_[rng.normal(0.0, 0.02, 90), -0.2, 0.1], "short": rng.normal(0.01, 0.01, 20)}
    df = spark.createDataFrame([(k, day(i), float(x)) for k, v in runs.items() for i, x in enumerate(v)], "run_id string, date date, ret double")
    phi = NormalDist()
    got_p, got_d = ({r.run_id: r for r in f.collect()} for f in (PE.psr(df), PE.dsr(df, 10)))
    for k, x in runs.items():
        n, e = len(x), x - 0.02 / 252
        sr = e.mean() / e.std(ddof=1)
        z = (x - x.mean()) / x.std()
        skew = (z**3).mean() * math.sqrt(n * (n - 1)) / (n - 2)
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((z**4).mean() - 3) + 6) + 3
        spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
        top = (1 - 0.5772156649) * phi.inv_cdf(1 - 1 / 10) + 0.5772156649 * phi.inv_cdf(1 - 1 / (10 * math.e))
        best = math.sqrt(max(spread, 1e-6) / (n - 1)) * top
        for got, bench in ((got_p[k].psr, 0.0), (got_d[k].dsr, best)):
            want = 0.5 if n < 30 else phi.cdf((sr - bench) * math.sqrt(n - 1) / math.sqrt(spread))
            assert got == pytest.approx(want, abs=2e-6)
    assert got_d["a"].dsr < got_p["a"].psr


def test_factor_regression_with_newey_west_errors(spark):
    import numpy as np

    from eventalpha.operators import perf as PE

    rng = np.random.default_rng(5)
    n = 250
    f = rng.normal(0, 0.01, (n, 2))
    noise = rng.normal(0, 0.005, n)
    y = 0.0004 + f @ np.array([0.8, -0.3]) + noise + 0.6 * np.r_[0, noise[:-1]]
    df = spark.createDataFrame([("r", day(i), float(y[i]), float(f[i, 0]), float(f[i, 1])) for i in range(n)], "run_id string, date date, ret double, mkt double, smb double")
    x = np.c_[np.ones(n), f]
    inv = np.linalg.inv(x.T @ x)
    coef = inv @ x.T @ y
    e = y - x @ coef
    s, lags = (x * e[:, None]).T @ (x * e[:, None]), int(4 * (n / 100) ** (2 / 9))
    for lag in range(1, lags + 1):
        g = (x[lag:] * e[lag:, None]).T @ (x[:-lag] * e[:-lag, None])
        s += (1 - lag / (lags + 1)) * (g + g.T)
    se = np.sqrt(np.diag(inv @ s @ inv))
    got = {r.term: r for r in PE.factor_hac(df, ["mkt", "smb"]).collect()}
    for i, term in enumerate(("alpha", "mkt", "smb")):
        assert (got[term].coef, got[term].se, got[term].t) == (pytest.approx(coef[i]), pytest.approx(se[i], rel=1e-6), pytest.approx(coef[i] / se[i], rel=1e-6))
        assert got[term].p == pytest.approx(t_two_sided(coef[i] / se[i], n - 3))
    whole = PE.factor_regression(df, ["mkt", "smb"]).first()
    assert list(whole.betas) == pytest.approx(coef[1:].tolist()) and whole.alpha == pytest.approx(coef[0])
    assert whole.r2 == pytest.approx(1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())))


def test_t_probability():
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "event_id long, ticker string, date date, raw_score double, event_confidence double")
    q = S.zscores(S.quintiles(empty, ["date"]), ["date"])
    assert PO.quintile_portfolio(q, ["date"], best="event_confidence").count() == 0


def posts_and_events(spark, seed, days=25):
    """Few posts a day, some at midnight, at the same instant or without sentiment, days of one post and of none."""
    rng, posts = random.Random(seed), []
    for name in "AB":
        for d in range(days):
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                ts = dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=rng.choice([0, 0, 5, 23]))
                posts.append((len(posts), name, ts, None if rng.random() < 0.1 else rng.randrange(-100, 101) / 100))
    rng.shuffle(posts)
    events = [(i, rng.choice("ABC"), day(rng.randrange(days + 9))) for i in range(60)]
    return posts, events


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_before_events_against_brute_force(spark, seed):
    posts, events = posts_and_events(spark, seed)
    p = spark.createDataFrame(posts, "post_id long, ticker string, ts timestamp_ntz, sentiment double")
    e = spark.createDataFrame(events, "event_id long, ticker string, event_date date")
    trend, acceleration, sums = {}, {}, {}
    for key, name, date in events:
        end = dt.datetime.combine(date, dt.time())
        near = sorted((ts, i, s) for i, n, ts, s in posts if n == name and end - dt.timedelta(days=7) <= ts < end)
        if near:
            xy = [(x, s) for x, (_, _, s) in enumerate(near) if s is not None]
            mean = [sum(v) / len(xy) for v in zip(*xy)]
            square = sum((x - mean[0]) ** 2 for x, _ in xy)
            trend[key] = sum((x - mean[0]) * (s - mean[1]) for x, s in xy) / square if square else 0.0
            s = [s for _, _, s in near]
            d2 = [c - 2 * b + a for a, b, c in zip(s, s[1:], s[2:]) if None not in (a, b, c)]
            acceleration[key] = sum(d2) / len(d2) if d2 else 0.0
            sums[key] = (len(near), sum(i for _, i, _ in near))
    assert {r.event_id: r.trend for r in FE.sentiment_trend(p, e).collect()} == pytest.approx(trend, abs=1e-9)
    assert {r.event_id: r.acceleration for r in FE.sentiment_acceleration(p, e).collect()} == pytest.approx(acceleration, abs=1e-9)
    assert {r.event_id: (r.n, r.ids) for r in FE.window_sums(p, e, {"ids": F.col("post_id")}).collect()} == sums


def test_events_of_a_date_share_their_window(spark):
    """Posts meet no event; the sums of a ticker and date do."""
    posts, _ = posts_and_events(spark, 4)
    p = spark.createDataFrame(posts, "post_id long, ticker string, ts timestamp_ntz, sentiment double")
    e = spark.range(5000).select(F.col("id").alias("event_id"), F.lit("A").alias("ticker"), F.lit(day(12)).alias("event_date"))
    for out in (FE.sentiment_trend(p, e), FE.sentiment_acceleration(p, e), FE.window_sums(p, e, {})):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        top = plan[: plan.index("Aggregate")]
        assert "event_id" in top and "post_id" not in top and "sentiment" not in top
        assert out.count() == 5000


def test_rolling_zscore_against_brute_force(spark):
    """Blocks of the lookback, null scores, long constant runs, and no frame that moves over its rows one by one."""
    rng = random.Random(5)
    rows = [(i, "AB"[i % 5 == 0], day(i // 3), None if rng.random() < 0.1 else 0.07 if 100 < i < 160 else rng.randrange(-100, 101) / 100) for i in range(260)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "event_id long, ticker string, date date, raw_score double")
    for lookback, least in ((20, 8), (7, 2)):
        want = {}
        for name in "AB":
            own = [r for r in rows if r[1] == name]
            for at, (key, _, _, s) in enumerate(own):
                seen = [x for _, _, _, x in own[max(0, at - lookback) : at] if x is not None]
                want[key] = None
                if len(seen) >= least and s is not None:
                    mean = sum(seen) / len(seen)
                    std = math.sqrt(sum((x - mean) ** 2 for x in seen) / (len(seen) - 1))
                    want[key] = (s - mean) / (std + 1e-6)
        out = S.rolling_zscore(df, ["ticker"], ["date", "event_id"], lookback=lookback, least=least)
        got = {r.event_id: r.rolling_z for r in out.collect()}
        assert got.keys() == want.keys() and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, rel=1e-6, abs=1e-6)
        assert f"-{lookback}, -1" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.columns == [*df.columns, "rolling_z"]


def test_relevance_of_shared_texts(spark, tmp_path):
    """Hits of a text, searched once, give what its posts' whole texts give; texts do not pass the join."""
    from eventalpha.plans import text_queries as TQ
    from eventalpha.plans.base import posts, posts_text

    rng = random.Random(6)
    words = ["the", "of", "und", "and", "THE", "t03", "T07", "xt11y", "other", "le", "que", "der", "therefore", "x" * 30]
    texts = [None, "", "   ", " t03", "and  ", *[" ".join(rng.choices(words, k=rng.choice([2, 5, 30]))) for _ in range(40)]]
    spark.createDataFrame([(i + (i > 20), t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    i = F.col("id")
    spark.range(1500).select(i.alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), F.when(i % 97 != 5, i * 31 % 1013).alias("user_id"), F.lit("a").alias("event_type"),
        (i % 90).cast("double").alias("value"), F.lit('{"k": 3}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    whole = posts_text(spark, str(tmp_path)).withColumn("text", F.concat(F.when(F.col("post_id") % 3 == 0, F.concat("ticker", F.lit(" "))).otherwise(""), "text"))
    want = L.relevance(whole, TQ.GROUPS).select("post_id", "relevance", "relevance_category", F.length(F.trim("text")).alias("n_chars"))
    shared = TQ.relevant_posts(spark, str(tmp_path)).select("post_id", "relevance", "relevance_category", "n_chars")
    assert sorted(shared.collect()) == sorted(want.collect()) and shared.count() == posts(spark, str(tmp_path)).count()
    for name in ("relevance", "post_quality", "news_quality", "message_quality"):
        out = getattr(TQ, name)(spark, str(tmp_path))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "text#" not in plan[: plan.index("Join")]
