"""Scoring expressions: term weights, decay, vectors, ages."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import vocab


def lookup(key: Column, table: Mapping[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def tfidf(tf: Column, df: Column, n: Column) -> Column:
    """MTH1; 0 without counts."""
    return F.when((tf > 0) & (df > 0) & (n > 0), tf * F.log(n / df)).otherwise(0.0)


def bm25_idf(df: Column, n: Column) -> Column:
    """MTH2: what a term is worth."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_share(tf: Column, length: Column, mean: Column, k1: float = vocab.BM25_K1, b: float = vocab.BM25_B) -> Column:
    """MTH2: how much of it a text gets."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def bm25(tf: Column, df: Column, n: Column, length: Column, mean: Column, k1: float = vocab.BM25_K1, b: float = vocab.BM25_B) -> Column:
    """MTH2: one term's share."""
    return bm25_idf(df, n) * bm25_share(tf, length, mean, k1, b)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def age_days(seen: Column, as_of: Column, unknown: float = 30.0) -> Column:
    """DTM1."""
    return F.coalesce((micros(as_of) - micros(seen)) / F.lit(86_400_000_000.0), F.lit(unknown))


def recency(provenance: Column, fact_type: Column, age: Column, rate: float = vocab.DECAY_RATE) -> Column:
    """MTH5: live facts fade three times as fast, structural ones and records never."""
    return F.when(fact_type == "live", F.exp(-rate * vocab.LIVE_FACTOR * age)).when(provenance.isin(*vocab.NO_DECAY) | (fact_type == "structural"), 1.0).otherwise(F.exp(-rate * age))


def half_life(days: Column, half: float = vocab.HALF_LIFE) -> Column:
    """MTH4: after `days`."""
    return F.exp(-math.log(2) / half * days)


def confirmation_share(count: Column) -> Column:
    """Logarithmic, 1 from seven confirmations."""
    return F.least(F.log2(F.greatest(F.lit(1), count) + 1), F.lit(3.0)) / 3.0


def dot(a: Column, b: Column) -> Column:
    """MTH7, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rrf(rank: Column, weight: float = 1.0, k: int = vocab.RRF_K) -> Column:
    """MTH10: ranks from 0; nothing for what isn't ranked."""
    return F.coalesce(F.lit(weight) / (rank + k), F.lit(0.0))


def band(working: Column) -> Column:
    """PRJ18."""
    out = F.lit(vocab.BANDS[-1][0])
    for name, top in reversed(vocab.BANDS[:-1]):
        out = F.when(working < top, name).otherwise(out)
    return out


def format_age(seconds: Column) -> Column:
    """DTM2: s under 90, m under 5400, else XhYYm."""
    s = seconds.cast("long")
    minutes = F.floor(s / 60).cast("long")
    return F.when(s < 90, F.concat(s.cast("string"), F.lit("s"))).when(s < 5400, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.format_string("%dh%02dm", F.floor(s / 3600).cast("long"), F.pmod(minutes, F.lit(60))))
