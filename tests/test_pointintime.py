"""Point-in-time word scores and event features against a plain version, and against the future."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventalpha.operators import pointintime as PIT
from eventalpha.sources import tables as ST

DAY0 = datetime.date(2024, 3, 1)
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def day(n):
    return DAY0 + datetime.timedelta(n)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    docs = [(i, day(rng.randint(0, 20)), [rng.choice(WORDS) for _ in range(rng.randint(0, 12))], rng.gauss(0, 0.05)) for i in range(120)]
    docs += [(500, day(3), None, 0.01), (501, None, ["alpha"], 0.5), (502, day(3), ["alpha"], None)]
    posts = [(i, rng.choice("AB"), datetime.datetime.combine(day(rng.randint(0, 24)), datetime.time(rng.randint(0, 23))), rng.choice([-0.4, 0.05, 0.3]), rng.randint(0, 130)) for i in range(300)]
    events = [(i, rng.choice("ABC"), day(rng.choice([0, 5, 12, 13, 22])), "8-K" if i % 2 else None) for i in range(14)]
    return docs, posts, events


def frames(spark, docs, posts, events):
    d = spark.createDataFrame(docs, "doc_id long, date date, w array<string>, r double").withColumn("text", F.concat_ws(" ", "w"))
    return d, spark.createDataFrame(posts, "post_id long, ticker string, ts timestamp_ntz, sentiment double, doc_id long"), spark.createDataFrame(events, "event_id long, ticker string, event_date date, kind string")


def scores_by_hand(docs, as_of, least):
    known = [(set(w or []), r) for _, at, w, r in docs if at is not None and r is not None and at < as_of]
    if not known:
        return {}
    every = [r for _, r in known]
    out = {}
    for x in WORDS:
        own = [r for w, r in known if x in w]
        if len(own) >= least:
            out[x] = (len(own), (np.mean(own) - np.mean(every)) / np.std(every))
    return out


def features(spark, docs, posts, events):
    d, p, e = frames(spark, docs, posts, events)
    scores = PIT.score_table(d, "w", "r", "date", [x[2] for x in events], 3)
    words = PIT.word_features(p, d.filter("w is not null"), "w", e, scores, threshold=0.2)
    terms = PIT.term_features(p, d, ["ALPHA", "eta th"], ["beta"], e)
    none = e.select("event_id", F.lit(1).alias("n"))
    return scores, PIT.feature_matrix(e, none, words, terms, {"is_8k": "8-K"}, "kind")


def test_scores_as_of_each_date(spark, tables):
    docs, posts, events = tables
    got = {(r.as_of, r.word): (r.n_docs, pytest.approx(r["corr"], abs=1e-9)) for r in features(spark, *tables)[0].collect()}
    assert got == {(at, w): s for at in {e[2] for e in events} for w, s in scores_by_hand(docs, at, 3).items()}


def test_features_by_hand(spark, tables):
    docs, posts, events = tables
    texts = {i: w for i, _, w, _ in docs}
    got = {r.event_id: r for r in features(spark, *tables)[1].collect()}
    assert len(got) == len(events)
    for i, ticker, at, kind in events:
        scores = {w: s for w, (_, s) in scores_by_hand(docs, at, 3).items()}
        near = [p for p in posts if p[1] == ticker and at - datetime.timedelta(7) <= p[2].date() < at and p[4] in texts]
        words = [w for p in near for w in texts[p[4]]]
        assert got[i].word_score == pytest.approx(sum(scores.get(w, 0) for w in words) / len(words) if words else 0.0)
        assert got[i].n_best_words == sum(scores.get(w, 0) > 0.2 for w in words) and got[i].n_worst_words == sum(scores.get(w, 0) < -0.2 for w in words)
        for side, sign in (("positive", 1), ("negative", -1)):
            held = [w for p in near if sign * p[3] > 0.1 for w in set(texts[p[4]])]
            assert got[i][f"best_{side}"] == sum(scores.get(w, 0) > 0.2 for w in held) and got[i][f"worst_{side}"] == sum(scores.get(w, 0) < -0.2 for w in held)
        joined = [" ".join(texts[p[4]]) for p in near]
        up = any("alpha" in t for t in joined) + any("eta th" in t for t in joined)
        down = int(any("beta" in t for t in joined))
        assert (got[i].dict_positive, got[i].dict_negative) == (up, down)
        assert got[i].dict_polarity == pytest.approx((up - down) / (up + down) if up + down else 0.0)
        assert got[i].dict_subjectivity == pytest.approx((up + down) / max(len(words), 1))
        assert got[i].is_8k == (kind == "8-K")


def rounded(df):
    return sorted(tuple(round(x, 9) for x in r) for r in df.collect())


def test_nothing_comes_from_the_future(spark, tables):
    docs, posts, events = tables
    as_of = day(13)
    early = [e for e in events if e[2] <= as_of]
    changed = [(i, at, [*(w or []), "alpha", "eta", "theta"], 9.0) if at is not None and at >= as_of and i > 130 else (i, at, w, (r or 0) + 1 if at is not None and at >= as_of else r) for i, at, w, r in docs]
    changed += [(900 + i, as_of, ["alpha"], 5.0) for i in range(40)]
    later = [(i, t, ts, -s if ts.date() >= as_of else s, k) for i, t, ts, s, k in posts] + [(999, "A", datetime.datetime.combine(as_of, datetime.time()), 1.0, 5)]
    before = rounded(features(spark, docs, posts, early)[1])
    assert rounded(features(spark, changed, later, early)[1]) == before
    assert rounded(features(spark, changed, later, events)[1]) != rounded(features(spark, *tables)[1])


def test_empty_tables(spark, tables):
    _, _, events = tables
    got = features(spark, [], [], events)[1].collect()
    assert len(got) == len(events) and all(r.word_score == 0.0 and r.dict_positive == 0 for r in got)


def test_posts_do_not_meet_words(spark, tables):
    """Rows joined of many posts of one long text: its words once for a date, not once for a post's ticker and day."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, day(0), words, 0.01 * i) for i in range(4)]
    posts = [(i, f"T{i % 40}", datetime.datetime.combine(day(i // 40 % 7), datetime.time()), 0.3, 0) for i in range(1120)]
    d, p, e = frames(spark, docs, posts, [(i, f"T{i}", day(7), None) for i in range(40)])
    scores = PIT.score_table(d, "w", "r", "date", [day(7)], 1)
    out = PIT.word_features(p, d, "w", e, scores)
    rows = out.collect()
    assert len(rows) == 40 and all(r.n_best_words == r.n_worst_words == r.best_positive == 0 and r.word_score == pytest.approx(0.0, abs=1e-9) for r in rows)

    def most(plan):
        own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows") else []
        inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        children = plan.children()
        return max([0, *own, *[most(x) for x in inner], *[most(children.apply(i)) for i in range(children.size())]])

    assert 0 < most(out._jdf.queryExecution().executedPlan()) <= 4 * 400


def test_words_are_not_moved_where_scores_are_many(spark, monkeypatch):
    """Scores that the planner would not send to all tasks, in several portions: what is shuffled is a row for a text, date and portion."""
    words = [[f"w{(i * 7 + k) % 500}" for k in range(400)] for i in range(40)]
    docs = [(i, day(i % 5), w, 0.01 * i) for i, w in enumerate(words)]
    posts = [(i, "A", datetime.datetime.combine(day(i % 9), datetime.time()), 0.3, i % 40) for i in range(200)]
    d, p, e = frames(spark, docs, posts, [(i, "A", day(5 + i), None) for i in range(5)])
    scores = PIT.score_table(d, "w", "r", "date", [day(5 + i) for i in range(5)], 1)
    few = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in PIT.word_features(p, d, "w", e, scores).collect())
    written = f"{ST.scratch(spark, 'scores')}"
    scores.write.parquet(written)
    scores, before = spark.read.parquet(written), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(PIT, "PORTION", 1000, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = PIT.word_features(p, d, "w", e, scores)
        got = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == few and len(got) == 5

    def moved(plan):
        own = [plan.metrics().get("shuffleRecordsWritten").get().value()] if plan.metrics().contains("shuffleRecordsWritten") else []
        inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        children = plan.children()
        return max([0, *own, *[moved(x) for x in inner], *[moved(children.apply(i)) for i in range(children.size())]])

    # 16,000 words and 80,000 with dates; the scores, 2,500, are dealt out by word before they are sent.
    assert 0 < moved(out._jdf.queryExecution().executedPlan()) <= 3 * 40 * 5 * 4 < 16_000
