"""Scalar expressions on literal rows."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import scoring, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'timestamp' if isinstance(v, datetime.datetime) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_tokens_and_chunks(spark):
    assert one(spark, text.estimate_tokens(F.col("t")), t="abc") == 1
    assert one(spark, text.estimate_tokens(F.col("t")), t="a" * 41) == 10
    assert one(spark, text.words(F.col("t")), t="Größe, naïve-ish  x_1!") == ["größe", "naïve", "ish", "x_1"]
    short = "two  words"
    assert one(spark, text.chunks(F.col("t")), t=short) == [short]
    assert [len(c.split()) for c in one(spark, text.chunks(F.col("t")), t=" ".join(["w"] * 341))] == [170, 170, 1]


@pytest.mark.parametrize("t, noise", [("Let me read the file", True), ("x" * 38 + " let me see why", True), ("x" * 39 + " let me see why", False), ("etcd needs three members", False)])
def test_noise_bound(spark, t, noise):
    assert one(spark, text.is_noise(F.col("t")), t=t) is noise


def test_classifiers(spark):
    assert one(spark, text.boost(F.col("t"), F.lit(0.9)), t="we Decided so") == 1.0
    assert one(spark, text.is_finding(F.col("t")), t="seen CVE-2024 here")
    steps = "1. check\n2. run\n3. verify\nit failed once"
    assert one(spark, text.steps(F.col("t")), t=steps) == ["check", "run", "verify"]
    assert one(spark, text.is_procedure(F.col("t")), t=steps)
    assert not one(spark, text.is_procedure(F.col("t")), t="1. check\n2. run failed")
    assert one(spark, text.confidence(F.col("t"), F.lit("x")), t="I think it might be so") == 0.25
    assert one(spark, text.confidence(F.col("t"), F.lit("storage")), t="plain") == 0.45
    assert one(spark, text.seeded_score(F.col("t")), t="an outage of the runbook") == 0.8


def test_domains(spark):
    assert one(spark, text.tag_domains(F.col("t"), vocab.DOMAIN_KEYWORDS), t="DNS and vault tls") == ["networking", "security"]
    assert one(spark, text.best_domain(F.col("t"), vocab.DOMAIN_KEYWORDS), t="DNS and vault tls") == "security"
    assert one(spark, text.best_domain(F.col("t"), vocab.DOMAIN_KEYWORDS), t="nothing here") == "general"


def test_redaction(spark):
    got = one(spark, text.redact(F.col("t")), t="token = abcdef123 and ghp_abcdefgh1 " + "x" * 700)
    assert got.startswith("token=[REDACTED] and [REDACTED] ") and got.endswith(" chars]")


def test_hashes(spark):
    import hashlib

    for t in ("", "abc", "é"):
        assert one(spark, text.md5_mod(F.col("t")), t=t) == int(hashlib.md5(t.encode()).hexdigest(), 16) % 100
        assert one(spark, text.fact_key(F.col("t")), t=t) == hashlib.sha256(t.encode()).hexdigest()[:16]


def test_globs(spark):
    for glob, path, hit in (("src/**/*.py", "src/a/b/c.py", True), ("src/**/*.py", "src/c.py", True), ("src/*.py", "src/a/c.py", False), ("a?c", "abc", True)):
        assert one(spark, F.col("t").rlike(text.glob_pattern(glob)), t=path) is hit
    assert text.glob_specificity("src/**/x.py") == 1.5 and text.glob_specificity("**") == 0.5


def test_decay(spark):
    assert one(spark, scoring.recency(F.col("p"), F.lit("live"), F.lit(10.0)), p="finding") == pytest.approx(math.exp(-0.6))
    assert one(spark, scoring.recency(F.col("p"), F.lit("structural"), F.lit(10.0)), p="automated") == 1.0
    assert one(spark, scoring.recency(F.col("p"), F.lit("operational"), F.lit(10.0)), p="automated") == pytest.approx(math.exp(-0.2))
    assert one(spark, scoring.age_days(F.col("a"), F.lit("2024-01-03").cast("timestamp")), a=datetime.datetime(2024, 1, 1)) == 2.0


@pytest.mark.parametrize("s, want", [(89, "89s"), (90, "1m"), (5399, "89m"), (5400, "1h30m"), (7261, "2h01m")])
def test_age_text(spark, s, want):
    assert one(spark, scoring.format_age(F.col("s")), s=s) == want


def test_bands(spark):
    assert [one(spark, scoring.band(F.col("w")), w=w) for w in (0, 40_000, 149_999, 250_000)] == ["GREEN", "YELLOW", "ORANGE", "BLACK"]


def test_let_computes_once(spark):
    """A chunk's words are split once: a text of many words doesn't take longer than its size."""
    import time

    small, large = ((spark.createDataFrame([(" ".join(["word"] * n),)], "t string").select(F.size(text.chunks(F.col("t")))), n) for n in (20_000, 320_000))
    small[0].collect()
    began = time.time()
    assert large[0].first()[0] == -(-large[1] // 170)
    assert time.time() - began < 20
