"""Corpus analytics: maturity, readiness, principals, audits, win rates, telemetry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import scoring


def maturity(facts: DataFrame, domain: str, weight: Column, least: int = vocab.MATURITY_LEAST) -> DataFrame:
    """AGG7-8: the mean weight of a domain's facts, at most 1; 0 for fewer than `least` facts."""
    mean = F.when(F.count("*") < least, 0.0).otherwise(F.least(F.lit(1.0), F.sum(weight) / F.count("*")))
    out = facts.groupBy(domain).agg(F.count("*").alias("facts"), mean.alias("score"))
    return out.withColumn("state", F.when(F.col("score") >= vocab.LIVE_AT, "LIVE").when(F.col("score") >= vocab.WARM_AT, "warm").otherwise("cold"))


def fact_weight(provenance: Column, outcome: Column, source: Column, families: Column, confirmations: Column, age: Column, rate: float = vocab.MATURITY_RATE) -> Column:
    """AGG7: one fact's share."""
    decay = F.when(provenance.isin(*vocab.NO_DECAY), 1.0).otherwise(F.exp(-rate * age))
    cross = F.when(families >= 2, vocab.CROSS_MODEL).otherwise(1.0)
    return F.greatest(F.lit(1), confirmations) * decay * scoring.lookup(provenance, vocab.PROVENANCE_WEIGHT, vocab.UNKNOWN_PROVENANCE) * scoring.lookup(outcome, vocab.OUTCOME_MODIFIER, 1.0) * cross * scoring.lookup(source, vocab.SOURCE_RELIABILITY, 1.0)


def readiness(scores: DataFrame, domains: DataFrame, domain: str, needed: Mapping[str, tuple[float, int]], default: tuple[float, int]) -> DataFrame:
    """AGG9: READY, MARGINAL (0.8 of both) or NOT READY for every domain of the vocabulary, with or without facts."""
    out = domains.join(scores, domain, "left").na.fill({"facts": 0, "score": 0.0})
    score = scoring.lookup(F.col(domain), {k: v[0] for k, v in needed.items()}, default[0])
    count = scoring.lookup(F.col(domain), {k: float(v[1]) for k, v in needed.items()}, float(default[1]))
    out = out.withColumn("need_score", score).withColumn("need_facts", count.cast("long"))
    ready = (F.col("score") >= F.col("need_score")) & (F.col("facts") >= F.col("need_facts"))
    close = (F.col("score") >= 0.8 * F.col("need_score")) & (F.col("facts") >= 0.8 * F.col("need_facts"))
    return out.withColumn("state", F.when(ready, "READY").when(close, "MARGINAL").otherwise("NOT READY"))


def principal_states(facts: DataFrame, principals: str, a: str, b: str) -> DataFrame:
    """AGG10: who has confirmed a fact: both, one, or neither."""
    has = lambda x: F.array_contains(principals, x)
    return facts.withColumn("state", F.when(has(a) & has(b), "both").when(has(a), "a_only").when(has(b), "b_only").otherwise("neither"))


def win_rates(outcomes: DataFrame, scope: str, success: str) -> DataFrame:
    """AGG13: a null scope is the empty one."""
    return outcomes.groupBy(F.coalesce(F.col(scope), F.lit("")).alias("scope")).agg(F.count("*").alias("n"), F.sum(success).cast("long").alias("wins"), F.round(F.sum(success) / F.count("*"), 6).alias("rate"))


def int_percentile(column: str, p: float) -> Column:
    """AGG15: linear interpolation, cut to an integer; 0 for no rows."""
    return F.coalesce(F.floor(F.percentile(column, p)).cast("long"), F.lit(0))


def score_rates(rows: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """AGG6: whole percents of the rows with each flag."""
    n = F.count("*")
    return rows.agg(n.alias("n"), *[F.floor(F.count_if(c) * 100 / n).cast("long").alias(k) for k, c in flags.items()])
