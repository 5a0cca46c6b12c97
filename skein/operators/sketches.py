"""Sketches that are stored by day and united for any span: distinct counts and quantiles with a stated error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers (a relative error of 1.04 / sqrt(2^12) = 1.6 %); size of quantile sketches (a rank error of about 1.3 %).
REGISTERS, QUANTILES = 12, 200


def daily(rows: DataFrame, day: Column, distinct: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG4, AGG15, AGG18: a row a day (and keys): n, a sketch of the distinct values of a column, a sketch of another's quantiles. As many rows as days, however many come in."""
    return rows.groupBy(day.alias("day"), *keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, REGISTERS).alias("distinct"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILES).alias("values"))


def spans(days: DataFrame, span: Column, quantiles: tuple[float, ...] = (0.5, 0.9), keys: tuple[str, ...] = ()) -> DataFrame:
    """A row a span of days: n, distinct (estimated), quantiles (values whose rank is about that). Only the stored sketches are read."""
    united = days.groupBy(span.alias("span"), *keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.kll_merge_agg_double("values").alias("v"))
    return united.select("span", *keys, "n", "distinct", F.array(*[F.kll_sketch_get_quantile_double("v", F.lit(q)) for q in quantiles]).alias("quantiles"))
