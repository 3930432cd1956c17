"""Filings to portfolio weights in one plan: the library's operators end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventalpha.functions import lexicon as L
from eventalpha.operators import features as FE
from eventalpha.operators import portfolio as PO
from eventalpha.operators import scoring as S
from eventalpha.plans.base import filings, posts, query
from eventalpha.plans.event_queries import _AROUND
from eventalpha.plans.signal_queries import _QP, _RAW, _rank_sql, _scaled
from eventalpha.plans.text_queries import HITS, LEXICON


def detected_events(spark: SparkSession, d: str) -> DataFrame:
    found = L.detect(filings(spark, d), LEXICON).filter("num_matches > 0")
    kept = found.filter(F.col("confidence") >= L.type_threshold(F.col("filing_type"), 0.2))
    return kept.select(F.col("filing_id").alias("event_id"), "ticker", F.col("date").alias("event_date"), F.col("confidence").alias("event_confidence"), "category")


_SIGNALS = f"""{HITS}, picked AS (SELECT filing_id AS event_id, ticker, date AS event_date, confidence AS event_confidence, category FROM det
      WHERE num_matches > 0 AND confidence >= CASE WHEN filing_type IN ('10-K', '10-Q') THEN 0.6 ELSE 0.2 END),
    {_AROUND.replace("JOIN evts e", "JOIN picked e")},
    reacted AS (SELECT p.event_id, ticker, event_date AS date, category, event_confidence, intensity, CASE WHEN n_post = 0 THEN 1 WHEN n_pre < 3 THEN ln(1 + n_post) ELSE n_post / n_pre END AS volume_ratio,
      coalesce(duration_days, 0) AS duration_days, CASE WHEN n_pre < 3 THEN 0 ELSE pre END AS pre_event_sentiment FROM picked p JOIN reac r ON p.event_id = r.event_id),
    rated AS (SELECT *, round({_RAW}, 6) AS raw_score FROM reacted), {_rank_sql("rated", "date", "ranked")},
    zs AS (SELECT *, CASE WHEN count(*) OVER d > 1 THEN (raw_score - avg(raw_score) OVER d) / (stddev_samp(raw_score) OVER d + 1e-6) ELSE 2 * raw_score END AS z FROM ranked WINDOW d AS (PARTITION BY date)),
    {_QP.format(src="zs", by="date")}, lim AS (SELECT * REPLACE (greatest(least(weight, 0.1), -0.1) AS weight) FROM qp)"""


@query(f""", {_SIGNALS} SELECT date, ticker, event_id, category, raw_score, quintile, round(z, 5) AS z_score, round(tanh(z), 5) AS signal, round(weight, 8) AS weight
    FROM ({_scaled("lim", "date", "0.5", "date, ticker, event_id, category, raw_score, quintile, z")})""", "posts filings")
def signal_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Events in filings, reactions in posts, signed scores, quintiles and z-scores by date, weights.
    Scores are rounded, so that events with the same posts tie whatever the order of a sum."""
    events = detected_events(spark, d)
    reactions = FE.with_defaults(events, FE.reaction_features(posts(spark, d), events))
    scored = reactions.withColumn("raw_score", F.round(S.raw_score(), 6)).withColumn("date", F.col("event_date"))
    ranked = S.zscores(S.quintiles(S.filter_signals(scored), ["date"]), ["date"])
    book = PO.quintile_portfolio(ranked, ["date"], best="event_confidence")
    limited = PO.position_limits(book, ["date"], 0.1)
    places = {"z_score": 5, "signal": 5, "weight": 8}
    return limited.select("date", "ticker", "event_id", "category", "raw_score", "quintile", *[F.round(c, n).alias(c) for c, n in places.items()])
