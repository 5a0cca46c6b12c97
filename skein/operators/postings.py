"""A persisted inverted index: blocks of postings with upper bounds, and exact top lists that score only blocks that can matter.

Texts of like length (and like values of further columns) share a block of about `SIZE` texts, so the largest share that a
word has in a block says much about all of it. One table is written, bucketed by block: (term, block, ids, tfs, lengths), and a row of
term _WHOLE a block for its texts. Shares of BM25 and their upper bounds follow from it at the lookup, where only asked words' rows are left, and so does what a
word is worth: no word's number of texts is joined to all its postings.

`matches` hands the postings of a query set to the rankings of `retrieval`, which then read no text. `best` scores fewer texts, for
another look at the bounds: it pays where bounds leave few blocks, so where texts that share a block resemble each other. Texts
without such structure leave a quarter of the blocks of four (`read_share`), and then scoring all postings is as fast.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import scoring, text
from skein.operators.retrieval import _WHOLE, dealt, query_terms, top_k
from skein.sources.writers import scratch, shuffles_removed, written

#: Texts a block; buckets of the table at least; blocks of each query that are scored first; what rounding may hide.
SIZE, BUCKETS, FIRST, SLACK = 4, 16, 24, 1e-6


@dataclass(frozen=True)
class Index:
    name: str
    texts: int
    mean: float
    buckets: int

    def by_block(self, spark: SparkSession) -> DataFrame:
        """term, block, ids, tfs, lengths, shares; all rows of a block are in one task."""
        wide = [F.col(c).cast("array<bigint>").alias(c) for c in ("tfs", "lengths")]
        share = F.zip_with("tfs", "lengths", lambda tf, length: scoring.bm25_share(tf, length, F.lit(self.mean)))
        return spark.table(f"{self.name}_blocks").where(F.col("term") != _WHOLE).select("term", "block", "ids", *wide, share.alias("shares"))

    def blocks(self, spark: SparkSession) -> DataFrame:
        """The same bucketed by (term, block), for joins with pairs of both. It is made when first asked for: rankings go by block and need no second copy."""
        name = f"{self.name}_pairs"
        if not spark.catalog.tableExists(name):
            with shuffles_removed(spark):
                rows = self.by_block(spark).repartition(self.buckets, "term", "block").write.option("path", scratch(spark, "postings-pairs"))
                rows.format("parquet").bucketBy(self.buckets, "term", "block").sortBy("term", "block").saveAsTable(name)
        return spark.table(name)

    def bounds(self, spark: SparkSession) -> DataFrame:
        """term, block, n, top."""
        return self.by_block(spark).select("term", "block", F.size("shares").cast("long").alias("n"), F.array_max("shares").alias("top"))

    def terms(self, spark: SparkSession) -> DataFrame:
        """term, df."""
        return spark.table(f"{self.name}_blocks").where(F.col("term") != _WHOLE).select("term", F.size("ids").cast("long").alias("n")).groupBy("term").agg(F.sum("n").alias("df"))


def build(docs: DataFrame, id_col: str, text_col: str = "text", like: tuple[str, ...] = (), tokens: Callable[[Column], Column] = text.words, size: int = SIZE, buckets: int | None = None) -> Index:
    """Writes the index of the texts (each id once). A null text is in no block and isn't counted; an empty one is counted. like: columns whose values share blocks.

    Texts are dealt out by block as they are, and split, counted and gathered where they then are: no word or posting moves. A block is known by
    a text's length in characters, which goes with that in words. Buckets grow with the texts unless they are given.
    """
    spark = docs.sparkSession
    folder, name = scratch(spark, "postings"), f"postings_{uuid.uuid4().hex}"
    wide = F.floor(F.log2(F.length(text_col) + 1) * 4).cast("int")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(wide, *like).alias("kind"), F.col(text_col).alias("text"))
    kinds = written(rows.groupBy("kind").agg(F.count("*").alias("texts"), F.ceil(F.count("*") / size).alias("parts")), f"{folder}/kinds")
    buckets = buckets or max(BUCKETS, dealt(kinds.agg(F.sum("texts")).first()[0] or 0))
    block = F.xxhash64("kind", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")
    split = rows.join(kinds, "kind").select("id", "text", block).repartition(buckets, "block").select("block", "id", tokens(F.col("text")).alias("w")).where("w is not null")
    each = split.select("block", "id", F.size("w").alias("length"), F.explode(F.array_append("w", F.lit(_WHOLE))).alias("term"))
    counted = each.groupBy("block", "id", "term").agg(F.count("*").cast("int").alias("tf"), F.first("length").alias("length"))
    # a block holds about `size` texts
    gathered = counted.groupBy("term", "block").agg(F.collect_list(F.struct("id", "tf", "length")).alias("p"))
    made = gathered.select("term", "block", *[F.col(f"p.{c}").alias(m) for c, m in (("id", "ids"), ("tf", "tfs"), ("length", "lengths"))])
    with shuffles_removed(spark):
        made.write.option("path", f"{folder}/blocks").format("parquet").bucketBy(buckets, "block").sortBy("term", "block").saveAsTable(f"{name}_blocks")
    lengths = spark.table(f"{name}_blocks").where(F.col("term") == _WHOLE).select(F.explode("lengths").alias("length"))
    total = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).first()
    return Index(name, total["n"], float(total["mean"]), buckets)


_BUILT: dict = {}


def of(docs: DataFrame, id_col: str, text_col: str = "text", like: tuple[str, ...] = ()) -> Index:
    """The index of a table of files: made once a session for the same files, sizes and times; made anew if any of them changed.

    Rows that don't come straight from files are indexed each time.
    """
    spark = docs.sparkSession
    if not docs.inputFiles():
        return build(docs, id_col, text_col, like)
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, docs.semanticHash(), frozenset(tuple(f) for f in files), id_col, text_col, like)
    if key not in _BUILT or not spark.catalog.tableExists(f"{_BUILT[key].name}_blocks"):
        _BUILT[key] = build(docs, id_col, text_col, like)
    return _BUILT[key]


def matches(index: Index, queries: DataFrame, query_id: str, text_col: str = "text", tokens: Callable[[Column], Column] = text.words) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `retrieval.matches` gives, out of the index: no text is read."""
    spark = queries.sparkSession
    wanted = query_terms(queries, query_id, text_col, tokens)
    held = index.by_block(spark).join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")  # terms of the stated questions
    posts = held.select("term", F.inline(F.arrays_zip("ids", "tfs", "lengths"))).toDF("term", "id", "tf", "length")
    size = spark.range(1).select(F.lit(index.texts).cast("long").alias("n"), F.lit(index.mean).alias("mean"))
    # dealt out by id, so that pairs of texts and questions are summed where they are made
    return posts.select("id", "term", "tf", "length").repartition(dealt(index.texts), "id"), wanted, size


def _asked(index: Index, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (term, block, ...) of the words of the stated questions, by block as they are stored, and beside each question that asks for them: worth."""
    held = rows.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    worth = F.col("times") * scoring.bm25_idf(F.col("df"), F.lit(index.texts))
    return held.join(F.broadcast(wanted.select("qid", "term", worth.alias("worth"))), "term")


def _summed(asked: DataFrame) -> DataFrame:
    """qid, id, score of blocks beside their questions, where they are: a text stands in one block."""
    each = asked.select("qid", "block", "worth", F.inline(F.arrays_zip("ids", "shares"))).toDF("qid", "block", "worth", "id", "share")
    return each.groupBy("qid", "block", "id").agg(F.sum(F.col("worth") * F.col("share")).alias("score")).drop("block")


def scored(index: Index, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """qid, id, score of all texts of the pairs' (qid, block) blocks with a word of the query; some blocks a query."""
    return _summed(_asked(index, index.by_block(wanted.sparkSession), wanted).join(F.broadcast(pairs.select("qid", "block")), ["qid", "block"], "left_semi"))


def bounded(index: Index, queries: DataFrame, query_id: str, text_col: str = "text", tokens: Callable[[Column], Column] = text.words) -> tuple[DataFrame, DataFrame]:
    """qid, block, most: no text of the block scores more for the query. And the queries' words with their numbers of texts, written once."""
    spark = queries.sparkSession
    path = scratch(spark, "bounded")
    terms = query_terms(queries, query_id, text_col, tokens)
    held = index.bounds(spark).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    wanted = written(terms.join(held.groupBy("term").agg(F.sum("n").alias("df")), "term"), path)
    return _asked(index, index.bounds(spark), wanted).groupBy("qid", "block").agg(F.sum(F.col("worth") * F.col("top")).alias("most")), wanted


def best(index: Index, queries: DataFrame, query_id: str, k: int, text_col: str = "text", tokens: Callable[[Column], Column] = text.words, places: int = 6, first: int = FIRST) -> DataFrame:
    """RET9, AGG3: qid, id, score, rank: exactly the k best texts of each query by rounded BM25, ties by id.

    The `first` most promising blocks of a query are scored; the k-th best of their texts is a score that the list has at
    least, so blocks that are bounded below it are never scored. Bounds and scores are summed where a block's postings are: only a list's candidates move.
    """
    most, wanted = bounded(index, queries, query_id, text_col, tokens)
    spark, path = queries.sparkSession, scratch(queries.sparkSession, "first")
    at = Window.partitionBy("qid").orderBy(F.desc("most"), "block")
    early = written(most.withColumn("n", F.row_number().over(at)).where(F.col("n") <= first).drop("n"), f"{path}/early")
    found = scored(index, early, wanted).withColumn("score", F.round("score", places))
    least = written(top_k(found, k).where(F.col("rank") == k).select("qid", F.col("score").alias("least")), f"{path}/least")  # a row a query
    asked = _asked(index, index.by_block(spark), wanted).withColumn("most", F.sum(F.col("worth") * F.array_max("shares")).over(Window.partitionBy("qid", "block")))
    open_ = asked.join(F.broadcast(least), "qid", "left").where(F.col("least").isNull() | (F.col("most") + SLACK + 10.0**-places >= F.col("least")))
    return top_k(_summed(open_).withColumn("score", F.round("score", places)), k)


def read_share(index: Index, queries: DataFrame, query_id: str, k: int) -> tuple[int, int]:
    """How many (query, block) pairs `best` scores, and how many there are: what the bounds are worth."""
    most, wanted = bounded(index, queries, query_id)
    at = Window.partitionBy("qid").orderBy(F.desc("most"), "block")
    ranked = most.withColumn("n", F.row_number().over(at))
    early = ranked.where(F.col("n") <= FIRST)
    least = top_k(scored(index, early, wanted), k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    out = ranked.join(least, "qid", "left").agg(F.count("*").alias("all"), F.count_if((F.col("n") <= FIRST) | F.col("least").isNull() | (F.col("most") + SLACK >= F.col("least"))).alias("read")).first()
    return out["read"], out["all"]
