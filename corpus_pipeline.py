"""The corpus pipeline: language ID, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets; all but the last
return the columns of docs, whatever other columns there are. A stage works on all rows that its
predecessor kept and judges each row on its own, so rows with a null or repeated doc_id stay or go one by one.
Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import language, ngram_join, packing, quality
from skein.llm.common import materialize, table
from skein.llm.queries import tokenizer_file

#: A text goes if the probability that it is of the better kind is below this.
QUALITY = 0.3


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, and the key's name: doc_id where it is a number, never null and never repeated; else a new column, fixed by writing the table."""
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        counted = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
        if counted.where("n > 1 or doc_id is null").isEmpty():
            return docs, "doc_id"
    row = _fresh(docs, "row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _keep(docs: DataFrame, row: str, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs whose key is among the chosen (a column of keys); of them the columns."""
    return docs.join(chosen.toDF(row), row, "left_semi").select(*[F.col(f"`{c}`") for c in columns])


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a probability of 0.5 or more.

    A null or empty text, or one without a letter, goes. A null lang or source is no evidence, and a null lang
    isn't learnt from; without any lang all documents go. An empty table gives no rows.
    """
    columns, model = docs.columns, language.fit_text_model(docs, "lang")
    docs, row = _keyed(docs)
    told = language.identify(docs, model, id_col=row, host_col="source").where("accepted")
    return _keep(docs, row, told.select(row), columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives QUALITY or more; each row gets its own score.

    A null or empty text has a score too. Labels of a null doc_id or a null quality aren't learnt from; without
    labels all stay. An empty table gives no rows.
    """
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    own = _fresh(docs, "score")
    return quality.score(docs, net, score_col=own).where(F.col(own) >= QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id (a null one is last).

    Rows that repeat an id are compared each; null and empty texts, and texts without words, all stay. An empty table gives no rows.
    """
    columns, (docs, row) = docs.columns, _keyed(docs)
    members = ngram_join.ngram_components(docs, id_col=row).select(F.col("doc_id").alias("key"), "component_id")
    if row == "doc_id":
        return _keep(docs, row, members.where("key = component_id").select("key"), columns)
    own = members.join(docs.select(F.col(row).alias("key"), F.col("doc_id").alias("id")), "key")
    first = own.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first"))
    return _keep(docs, row, first.select("first.key"), columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token sequences, a row a piece. A null text is an empty one (one token); an empty table gives no rows."""
    return packing.pack(packing.encode_pieces(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [("language ID", identified), ("quality classifier", good), ("n-gram Jaccard join", distinct), ("best-fit packing", packed)]

#: SQL can't express the classifiers or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
