"""The index of postings against rankings that read all texts; how much of it the bounds leave; when it is made anew."""

import random

from skein.operators import postings, retrieval

COLUMNS = ("qid", "id", "score", "rank")


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def plain(docs, queries, k):
    scored = retrieval.bm25(docs, queries, "doc_id", "qid")
    return rows(retrieval.top_k(scored.selectExpr("qid", "id", "round(score, 6) as score"), k))


def corpus(spark, n=300):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["é", "ü"]
    text = lambda most: " ".join(rng.choice(words[: rng.choice([5, 20, 62])]) for _ in range(rng.randrange(most)))
    docs = [(k, text(80), f"l{k % 3}") for k in range(n)] + [(1000 + k, "w1 w2 w3", "l0") for k in range(30)] + [(2000, None, "l0"), (2001, "", None), (2002, "...", "l1")]
    queries = [(k, text(8)) for k in range(25)] + [(90, ""), (91, None), (92, "w1 w1 w2"), (93, "nowhere")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(queries, "qid long, text string")


def test_best_equals_all(spark):
    docs, queries = corpus(spark)
    for size, first, k in ((1, 1, 3), (4, 2, 400)):
        index = postings.build(docs, "doc_id", like=("lang",), size=size, buckets=4)
        assert rows(postings.best(index, queries, "qid", k, first=first)) == plain(docs, queries, k)
    assert postings.best(index, queries.limit(0), "qid", 3).count() == 0
    empty = postings.build(docs.limit(0), "doc_id", buckets=2)
    assert empty.texts == 0 and postings.best(empty, queries, "qid", 3).count() == 0


def test_matches_equal_a_reading(spark):
    docs, queries = corpus(spark)
    index = postings.build(docs, "doc_id", buckets=4)
    mine, read = postings.matches(index, queries, "qid"), retrieval.matches(docs, queries, "doc_id", "qid")
    for a, b, columns in zip(mine, read, (["id", "term", "tf", "length"], ["qid", "term", "times"], ["n", "mean"]), strict=True):
        assert sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))
    df = {r["term"]: r["df"] for r in index.terms(spark).collect()}
    assert df == {r["term"]: r["n"] for r in read[0].groupBy("term").count().withColumnRenamed("count", "n").collect()} | {k: v for k, v in df.items() if k not in {r["term"] for r in read[1].collect()}}


def test_bounds_leave_few_blocks(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    index = postings.of(docs, "doc_id", like=("lang",))
    read, every = postings.read_share(index, spark.read.parquet(f"{folder}/benchmark.parquet"), "item_id", 3)
    assert read < every / 2  # of a hundred texts a language twenty-four blocks of four are read first


def test_index_is_made_once_for_the_same_files(spark, tmp_path):
    docs, _ = corpus(spark, 20)
    path = str(tmp_path / "d")
    docs.write.parquet(path)
    first = postings.of(spark.read.parquet(path), "doc_id")
    assert postings.of(spark.read.parquet(path), "doc_id") == first
    assert postings.of(spark.read.parquet(path).where("doc_id < 5"), "doc_id").texts == 5
    docs.write.mode("append").parquet(path)
    assert postings.of(spark.read.parquet(path), "doc_id") != first


def test_lookups_shuffle_no_postings(spark):
    docs, _ = corpus(spark, 20)
    blocks = postings.build(docs, "doc_id", buckets=4).blocks(spark)
    assert "Exchange" not in blocks.hint("merge").join(blocks.select("term", "block"), ["term", "block"])._jdf.queryExecution().executedPlan().toString()
