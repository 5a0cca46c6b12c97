"""Personal data against the plain patterns, on odd rows and on texts that make patterns slow or deep."""

import hashlib
import random
import re
import time

import regex
from pyspark.sql import functions as F

from skein.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def confirmed(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    """Every plain pattern over the text, failing matches dropped."""
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if confirmed(kind, m[0])]
    return sorted(spans)


def expected(text):
    spans = base(text)
    counts = [sum(s[3] == kind for s in spans) for kind in PLAIN]
    return (*counts, hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest())


def got(df):
    return [(r["doc_id"], (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in pii.digest(df).collect()]


def strange_texts():
    rng = random.Random(5)
    alphabet = "a1@.+- ()%_9Z0\n😀é"
    texts = [None, "", " ", "a@b", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0256.1.1.1 000255.0.0.0", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "1" * 30, "+1 (743) 555-3824 ext", "+1() 2", "é😀 x@y.zz 😀 +49 30 901820", "x@y.z" * 3, "a@b.c.@d.e", "00000000000000"]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]


def test_base_equals_plain_patterns(spark):
    texts = strange_texts()
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(1, "x@y.zz"), (1, "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("found0", F.lit("x"))
    by = {}
    for key, value in got(df):
        by.setdefault(key, []).append(value)
    want = {}
    for key, text in rows:
        want.setdefault(key, []).append(expected(text))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    assert pii.digest(df.limit(0)).count() == 0


def test_query_on_documents(spark):
    from skein.llm.queries import op12_pii

    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op12_pii(spark, folder).collect()}
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in texts:
        mine = rows[r["doc_id"]]
        assert (mine["n_email"], mine["n_ip"], mine["n_card"], mine["n_phone"], mine["base_sha256"]) == expected(r["text"])
        spans = [f"{s[3]}:{s[0]}:{s[2]}" for s in base(r["text"])]
        assert [s for s in mine["spans"].split(",") if s.split(":")[0] in PLAIN] == spans


def test_long_runs_take_linear_time(spark):
    n = 300_000
    texts = ["1" * n, "1 " * n, "a" * n, "a@" * n, "a." * n, "a@b.c " * (n // 6), "1.1" * n, "+1" + "(" * n, "A" * n, "AB12" * n, "x@y" + ".z" * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    rows = dict(got(df))
    assert time.time() - began < 120
    assert rows[5] == expected(texts[5]) and rows[10] == expected(texts[10]) and rows[0] == expected("") and rows[3] == expected("")


def test_checksums_and_words_decide(spark):
    texts = {
        "iban": "pay to GB82 WEST 1234 5698 7654 32.",
        "no iban": "pay to GB83 WEST 1234 5698 7654 32.",
        "id": "her social security number is 123-45-6789",
        "no id": "part 123-45-6789 of the list",
        "against": "the ssn of order 123-45-6789",
        "pass": "Reisepass C01234567 gültig",
        "born": "né(e): naissance 1984-02-29",
        "date": "released on 1984-02-29",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    found = {r["doc_id"]: [(s["kind"], s["value"], s["score"]) for s in r["spans"]] for r in pii.find(df).collect()}
    assert found["iban"] == [("iban", "GB82 WEST 1234 5698 7654 32", 0.85)]
    assert found["id"] == [("national_id", "123-45-6789", 0.65)] and found["pass"] == [("passport", "C01234567", 0.55)] and found["born"] == [("birth_date", "1984-02-29", 0.55)]
    assert [found[k] for k in ("no iban", "no id", "against", "date")] == [[]] * 4
    scored = spark.createDataFrame([(1, "call +49 30 9018200"), (2, "version +49 30 9018200")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"][0]["score"] for r in pii.find(scored).collect()} == {1: 0.95, 2: 0.25}  # base ones stay


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 17, 1000):
        row = spark.range(1).select(pii.running_sums(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("s")).first()
        assert row["s"] == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_only_functions_of_the_engine(spark):
    df = pii.digest(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_mod97_equals_arithmetic(spark):
    rng = random.Random(2)
    values = ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"] + ["DE" + "".join(rng.choice("0123456789AZ") for _ in range(20)) for _ in range(300)]

    def plain(v):
        v = regex.sub(" ", "", v)
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.mod97(F.col("v")).alias("ok")).collect()
    assert all(r["ok"] == plain(r["v"]) for r in rows) and rows[0]["ok"]
