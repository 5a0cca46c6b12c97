"""Evaluation sets and their scores: evidence by text, rankings of units, cases with required terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import scoring, text

#: Words of an item that are looked up together; letters by which a term is looked up.
_WORDS, _GRAM = 4, 5
_SPACE = r"[ \t\n\f\r]+"


def _run_keys(words: Column) -> Column:
    """Hashes of all runs of _WORDS words."""
    return text.let(words, lambda w: F.when(F.size(w) >= _WORDS, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (_WORDS - 1)), lambda k: F.xxhash64(F.array_join(F.slice(w, k, _WORDS), " "))))))


def holders(docs: DataFrame, items: DataFrame, item_id: str, text_col: str = "text") -> DataFrame:
    """qid, holders: how many texts hold an item's whole text.

    A text that holds an item has the item's inner words as whole words: runs of them meet by equality, and
    only what meets is compared letter by letter. Items of few words are counted one by one in a scan. Null texts hold nothing; a null item has no holders.
    """
    wanted = items.select(F.col(item_id).alias("qid"), F.col(text_col).alias("wanted")).withColumn("w", F.split("wanted", _SPACE))
    long = F.size("w") >= _WORDS + 2
    # the words after the first, of which the last isn't used
    keyed = wanted.where(long).select("qid", "wanted", F.xxhash64(F.array_join(F.slice("w", 2, _WORDS), " ")).alias("k"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("t"))
    met = rows.select("row", "t", F.explode(_run_keys(F.split("t", _SPACE))).alias("k")).join(keyed, "k")
    held = met.where(F.col("t").contains(F.col("wanted"))).select("row", "qid").distinct().groupBy("qid").agg(F.count("*").alias("n"))
    out = wanted.select("qid").join(held, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("holders"))
    few = wanted.where(~long & F.col("wanted").isNotNull()).select("qid", "wanted").collect()  # of the stated query set
    if not few:
        return out
    counts = docs.agg(*[F.count_if(F.col(text_col).contains(r["wanted"])).alias(f"c{k}") for k, r in enumerate(few)])
    listed = counts.select(F.explode(F.array(*[F.struct(F.lit(r["qid"]).alias("qid"), F.col(f"c{k}").alias("holders")) for k, r in enumerate(few)])).alias("x")).select("x.*")
    return out.join(listed.select("qid"), "qid", "left_anti").unionByName(listed)


def relevant(facts: DataFrame, cases: DataFrame, least: int = 2) -> DataFrame:
    """RET8: qid, id, hits: facts (id, text) that hold `least` of a case's terms (qid, terms; lower-cased, without spaces) in their text.

    A term may begin and end within a word. Distinct words of all facts are searched once, by their runs of letters that
    begin a term; facts then find terms by their words.
    """
    terms = cases.select("qid", F.explode(F.array_distinct("terms")).alias("term")).where("term != ''")
    sizes = sorted(r["n"] for r in terms.select(F.least(F.length("term"), F.lit(_GRAM)).alias("n")).distinct().collect())  # at most _GRAM
    if not sizes:
        return facts.select(F.lit(None).cast(dict(cases.dtypes)["qid"]).alias("qid"), "id", F.lit(0).cast("long").alias("hits")).limit(0)
    words = facts.select("id", F.explode(F.array_distinct(text.plain_words(F.col("text")))).alias("word"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda k: F.substring(F.col("word"), k, F.lit(n)))
    pieces = [F.when(F.length("word") >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    keyed = terms.select("term", F.substring("term", 1, _GRAM).alias("gram")).distinct()
    found = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*pieces))).alias("gram")).join(keyed, "gram").where(F.col("word").contains(F.col("term"))).select("word", "term").distinct()
    hits = words.join(found, "word").select("id", "term").distinct().join(terms, "term").groupBy("qid", "id").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= least)


def export_set(found: DataFrame, cases: DataFrame) -> DataFrame:
    """SNK12: a row a case and relevant fact (of `relevant`), with how many the case has; cases without any have one row of nulls."""
    counted = found.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    return cases.join(counted, "qid", "left").na.fill(0, ["n_relevant"]).join(found.select("qid", F.col("id").alias("relevant_id")), "qid", "left")


def score_cases(outputs: DataFrame, cases: DataFrame) -> DataFrame:
    """RET21: passes and warnings of outputs (qid, text) against cases (qid, required, anti, min_hits); entries are counted by their marks."""
    held = lambda terms: text.let(F.lower("text"), lambda low: F.filter(terms, lambda t: low.contains(F.lower(t))))
    rows = outputs.join(cases, "qid").withColumn("hits", held(F.col("required"))).withColumn("anti_hits", held(F.col("anti")))
    marks = F.size(F.regexp_extract_all("text", F.lit(r"\n<!-- "), 0)).cast("long")
    return rows.select("qid", (F.size("hits") >= F.col("min_hits")).alias("passed"), "hits", F.array_except("required", "hits").alias("missing"), "anti_hits", marks.alias("entries"), (F.size("anti_hits") > 0).alias("warned"))


def rank_hybrid(units: DataFrame, questions: DataFrame, cosines: DataFrame | None = None) -> DataFrame:
    """RET10: qid, unit, session, score, rank of each question's own units (qid, unit, session, text) by 0.3 tfidf + 0.7 BM25, blended with the cosine.

    Frequencies count within a question's units. Units that share nothing score 0 and rank last, by unit.
    """
    from skein.operators import retrieval

    asked = questions.select("qid", F.explode(text.words(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    split = units.select("qid", "unit", "session", text.plain_words(F.col("text")).alias("w"))
    size = split.groupBy("qid").agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    each = split.select("qid", "unit", F.size("w").alias("length"), F.explode("w").alias("term"))
    counts = each.groupBy("qid", "unit", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = counts.groupBy("qid", "term").agg(F.count("*").alias("df"))
    posts = counts.join(df, ["qid", "term"]).join(size, "qid").join(asked, ["qid", "term"], "left")
    decision = F.when(F.col("term").isin(*vocab.DECISION_WORDS), scoring.tfidf(F.col("tf"), F.col("df"), F.col("n"))).otherwise(0.0)
    bm25 = F.coalesce(scoring.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.greatest(F.col("mean"), F.lit(1.0))) * F.col("times"), F.lit(0.0))
    summed = posts.groupBy("qid", "unit").agg((vocab.TFIDF_SHARE * F.sum(decision) + vocab.BM25_SHARE * F.sum(bm25)).alias("score"))
    rows = split.select("qid", "unit", "session").join(summed, ["qid", "unit"], "left").na.fill(0.0, ["score"])
    if cosines is not None:
        rows = rows.join(cosines.select("qid", "unit", "cosine"), ["qid", "unit"], "left").withColumn("score", retrieval.blend(F.col("score"), F.col("cosine"))).drop("cosine")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "unit")).cast("long"))


#: Stands for the unit itself among its words; no tokeniser gives it.
_WHOLE = ""


def rank_shared(units: DataFrame, questions: DataFrame, places: int = 6) -> DataFrame:
    """RET10, WIN18: qid, session, rank: every session by its best unit, scored as `rank_hybrid` does, where all questions are asked of the same units (unit, session, text).

    Units are split and counted once, and dealt out by session: their pairs with the questions are scored and the best of a session is taken where they
    are made, so only a row a question and session moves. Equal scores go by unit, then by session.
    """
    from skein.operators import retrieval

    asked = retrieval.query_terms(questions, "qid", "text").unionByName(questions.select("qid", F.lit(_WHOLE).alias("term"), F.lit(0).cast("long").alias("times")).distinct())
    words = asked.sparkSession.createDataFrame([(w,) for w in vocab.DECISION_WORDS], "term string")
    vocabulary = asked.select("term").unionByName(words).distinct()  # of the stated questions
    split = units.select("unit", "session", text.plain_words(F.col("text")).alias("w")).repartition(retrieval.dealt(units.count()), "session")
    each = split.select("session", "unit", F.size("w").alias("length"), F.explode(F.array_append(F.coalesce("w", F.array().cast("array<string>")), F.lit(_WHOLE))).alias("term"))
    counts = each.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("session", "unit", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    size = counts.where(F.col("term") == _WHOLE).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    posts = counts.join(F.broadcast(counts.groupBy("term").agg(F.count("*").alias("df"))), "term").join(F.broadcast(size))
    said = F.when(F.col("term").isin(*vocab.DECISION_WORDS), scoring.tfidf(F.col("tf"), F.col("df"), F.col("n")))
    weight = scoring.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.greatest(F.col("mean"), F.lit(1.0)))
    weighted = posts.select("session", "unit", "term", F.sum(said).over(Window.partitionBy("session", "unit")).alias("decided"), F.when(F.col("term") != _WHOLE, weight).otherwise(0.0).alias("w"))
    found = weighted.join(F.broadcast(asked), "term").groupBy("qid", "session", "unit").agg(F.first("decided").alias("decided"), F.sum(F.col("w") * F.col("times")).alias("found"))
    score = F.round(vocab.TFIDF_SHARE * F.coalesce("decided", F.lit(0.0)) + vocab.BM25_SHARE * F.col("found"), places)
    best = found.groupBy("qid", "session").agg(F.min(F.struct((-score).alias("s"), F.col("unit").alias("u"))).alias("b"))
    return best.select("qid", "session", F.row_number().over(Window.partitionBy("qid").orderBy("b.s", "b.u", "session")).cast("long").alias("rank"))


def ranked_sessions(ranked: DataFrame) -> DataFrame:
    """WIN18: of ranked units (qid, session, rank) each session once, in order of its best unit."""
    first = ranked.groupBy("qid", "session").agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("first", "session")).cast("long")).drop("first")


def session_scores(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """WIN17, SET5, AGG23: reciprocal rank, hit and recall of ranked sessions (qid, session, rank) against gold ones (qid, session)."""
    total = gold.groupBy("qid").agg(F.count("*").alias("gold"))
    own = ranked.join(gold, ["qid", "session"]).groupBy("qid").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("found"))
    found = F.coalesce("found", F.lit(0))
    return total.join(own, "qid", "left").select("qid", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (found > 0).cast("int").alias("hit"), (found / F.col("gold")).alias("recall"))
