"""What a task is given: facts by a blend of keyword and vector scores with factors, memory files by type, within a budget.

A task table (qid, text) is the stated query set: all its scores come from one pass over the facts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import scoring, text
from skein.operators import retrieval
from skein.sources.writers import scratch, written

#: Words that say nothing about a file.
FILE_STOP = tuple(
    """a an the is it in on at to for of and or but not with from by as be was were been are this that these those i we
    you they do does did will would could should can may might have has had new all any each every some no up out about
    just into over after before between through during such than then what when where which who how more most very also only like
    make use get set need want try fix run check look see""".split()
)
#: Types of memory files: how many of each, and the least cosine.
FILE_TYPES = {"feedback": (3, 0.30), "domain": (2, 0.40), "project": (1, 0.50), "user": (1, 0.30), "reference": (1, 0.40)}
FILE_LEAST, FILE_KEYWORD_LEAST, FILE_COSINE_LEAST, HARD_FACTOR = 1.0, 3.0, 0.20, 1.5


def cap_boost(score: Column, boost: Column, cap: float | None) -> Column:
    """MTH8: without a cap the score as it is; else what repetition adds is at most the cap (1 at least)."""
    if cap is None:
        return score
    most = max(1.0, cap)
    return F.when((boost > 1.0) & (boost > most), score * most / boost).otherwise(score)


def stored_factor(stored: Column) -> Column:
    """RET3: of a stored score over 0.35."""
    return F.when(stored > vocab.STORED_LEAST, vocab.STORED_BASE + vocab.STORED_SLOPE * stored).otherwise(1.0)


def fact_factor(fact_type: Column, review: Column) -> Column:
    """RET3: by a fact's type and its state of review."""
    return scoring.lookup(F.coalesce(fact_type, F.lit("observation")), vocab.TYPE_FACTOR, 1.0) * scoring.lookup(F.coalesce(review, F.lit("auto")), vocab.REVIEW_WEIGHT, 1.0)


def question_factor(phrases: Column, names: Column, found: Column) -> Column:
    """RET3, TXT3-4: up to 30 % for the question's quoted phrases in the fact, up to 20 % for its names of infrastructure; found: which of all questions' are in it."""
    share = lambda xs: F.when(F.size(xs) == 0, 0.0).otherwise(F.size(F.filter(xs, lambda x: F.array_contains(found, x))) / F.size(xs))
    return (1 + vocab.PHRASE_SHARE * share(phrases)) * (1 + vocab.ENTITY_SHARE * share(names))


def cross_agent(facts: DataFrame, digest: str, agent: str) -> DataFrame:
    """JN25: digests that two agents or more hold."""
    return facts.groupBy(digest).agg(F.count_distinct(agent).alias("agents")).where("agents >= 2")


def decision_scores(facts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """MTH3, AGG2: id, tfidf over the decision words of each fact; facts without one are left out."""
    words = F.filter(text.plain_words(F.col(text_col)), lambda w: w.isin(*vocab.DECISION_WORDS))
    posts = facts.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))  # a row a decision word
    size = facts.agg(F.count("*").alias("n"))
    return posts.join(F.broadcast(df), "term").join(F.broadcast(size)).groupBy("id").agg(F.sum(scoring.tfidf(F.col("tf"), F.col("df"), F.col("n"))).alias("tfidf"))


def score_facts(facts: DataFrame, tasks: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None, skills: Mapping[str, tuple[str, ...]] = {}, cap: float | None = None) -> DataFrame:
    """RET1-4: qid, id, score, tokens, digest (a number that facts of equal text share) of every fact that shares a word with a task.

    facts: id, domain, text, fact_type, stored, review, agent, gap_days (days between first and last sight). tasks: qid, text.
    vectors: of facts (id, v; several rows a fact for its chunks, the best counts) and of tasks (qid, qv). skills: keyword -> domains that a task with it favours.
    Texts go by id to where their pairs are made, and what else a fact has goes there as numbers; no pair moves.
    """
    keyword = retrieval.bm25(facts, tasks, "id", "qid", tokens=text.plain_words, figures=retrieval.corpus_figures(facts, tasks, "qid", tokens=text.plain_words))
    asked = tasks.select("qid", text.quoted_any(F.col("text")).alias("phrases"), text.entity_names(F.col("text")).alias("names"), _favoured(F.col("text"), skills).alias("favoured"))
    named = asked.select(F.explode(F.array_union("phrases", "names")).alias("x")).agg(F.collect_set("x").alias("named"))  # one row of the stated questions
    read = facts.join(F.broadcast(named)).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    # most questions name nothing: then no text is read for them
    there = F.when(F.size("named") == 0, F.array().cast("array<string>")).otherwise(text.let(F.lower("text"), lambda low: F.filter("named", lambda x: low.contains(x))))
    numbers = written(read.select("id", "domain", "fact_type", "stored", "review", "agent", "gap_days", "digest", text.estimate_tokens(F.col("text")).alias("tokens"), there.alias("found")), scratch(facts.sparkSession, "facts"))
    copies = numbers.groupBy("digest").agg(F.min("id").alias("first"))
    own = numbers.join(cross_agent(numbers, "digest", "agent"), "digest", "left").join(copies, "digest", "left").withColumn("digest", F.col("first")).join(decision_scores(facts, "id", "text"), "id", "left")
    if vectors is not None:
        own = own.join(vectors[0].groupBy("id").agg(F.collect_list("v").alias("vs")), "id", "left")  # a fact's chunks
        own_vectors = vectors[1].join(F.broadcast(tasks.select("qid")), "qid", "left_semi").groupBy("qid").agg(F.collect_list("qv").alias("qvs"))  # of the stated questions
        asked = asked.join(own_vectors, "qid", "left")
        cosine = F.array_max(F.flatten(F.transform("vs", lambda v: F.transform("qvs", lambda q: scoring.dot(v, q)))))
    else:
        cosine = F.lit(None).cast("double")
    # into the parts of the pairs, so that these stay whatever the number of shuffle partitions
    own = own.repartition(retrieval.dealt(numbers.count()), "id")
    rows = keyword.withColumnRenamed("score", "bm25").join(own, "id").join(F.broadcast(asked), "qid")  # the stated questions
    factor = question_factor(F.col("phrases"), F.col("names"), F.col("found"))
    factor = factor * scoring.half_life(F.greatest(F.lit(0.0), F.coalesce("gap_days", F.lit(0.0)))) * fact_factor(F.col("fact_type"), F.col("review"))
    factor = factor * F.when(F.array_contains("favoured", F.col("domain")), vocab.SKILL_FACTOR).otherwise(1.0)
    repeated = stored_factor(F.coalesce("stored", F.lit(0.0))) * F.when(F.col("agents").isNotNull(), vocab.CROSS_AGENT).otherwise(1.0)
    base = vocab.TFIDF_SHARE * F.coalesce("tfidf", F.lit(0.0)) + vocab.BM25_SHARE * F.col("bm25")
    rows = rows.select("qid", "id", base.alias("base"), factor.alias("factor"), repeated.alias("repeated"), cosine.alias("cosine"), "tokens", "digest")
    score = retrieval.blend(F.col("base"), F.col("cosine")) * F.col("factor") * F.col("repeated")
    return rows.select("qid", "id", cap_boost(score, F.col("repeated"), cap).alias("score"), "tokens", "digest")


def _favoured(task: Column, skills: Mapping[str, tuple[str, ...]]) -> Column:
    none = F.array().cast("array<string>")
    hits = [F.when(F.lower(task).contains(k), F.array(*[F.lit(d) for d in domains])).otherwise(none) for k, domains in skills.items()]
    return F.array_distinct(F.concat(*hits)) if hits else none


def inject(scored: DataFrame, budget: int, bootstrap: str | None = None, used: int = 0) -> DataFrame:
    """RET1, RET12, SRT1, WIN12: what each task is given: of equal texts the best placed, by score per token, within the budget.

    bootstrap: a boolean column; facts of a young domain are exempt from floors and budget. used: tokens that handoffs and notes have
    taken from the budget before.
    """
    return retrieval.select_within(scored, max(0, budget - used), exempt=bootstrap, same="digest")


def file_scores(files: DataFrame, tasks: DataFrame, stop: tuple[str, ...] = FILE_STOP) -> DataFrame:
    """RET11: qid, id, type, hard, score of memory files (id, type, name, description, body) by a task's words.

    Frequencies count in whole files; a hard gate is worth half as much again.
    """
    asked = tasks.select("qid", F.explode(F.array_except(F.array_distinct(text.words(F.col("text"))), F.array(*[F.lit(x) for x in stop]))).alias("term"))
    whole = text.plain_words(F.concat_ws(" ", "name", "description", "body"))
    tokens = files.select("id", whole.alias("w")).select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    posts = tokens.join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    size = files.agg(F.count("*").alias("n"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1) + 0.5)
    weighed = posts.join(df, "term").join(F.broadcast(size)).select("id", "term", (idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("length") / 200))).alias("w"))
    summed = weighed.join(asked, "term").groupBy("qid", "id").agg(F.sum("w").alias("w"))
    hard = F.lower("description").contains("hard gate") | (F.col("type").isin("feedback", "domain") & F.col("body").contains("HARD GATE"))
    out = summed.join(files.select("id", "type", hard.alias("hard")), "id")
    return out.select("qid", "id", "type", "hard", F.when(F.col("hard"), F.col("w") * HARD_FACTOR).otherwise(F.col("w")).alias("score"))


def gate_files(scored: DataFrame, cosines: DataFrame | None = None, types: Mapping[str, tuple[int, float]] = FILE_TYPES) -> DataFrame:
    """RET11: the best files of each type a task, by rank: below the least cosine a file goes, a hard gate only below 0.2.

    Without vectors only keyword scores over 3 stay. Hard gates among feedback aren't counted against its share.
    """
    least = scoring.lookup(F.col("type"), {k: v for k, (_, v) in types.items()}, 1.0)
    most = scoring.lookup(F.col("type"), {k: float(n) for k, (n, _) in types.items()}, 0.0)
    if cosines is None:
        rows = scored.where(F.col("score") > FILE_KEYWORD_LEAST)
    else:
        c, s = F.col("cosine"), F.col("score")
        rows = scored.join(cosines.select("qid", "id", "cosine"), ["qid", "id"], "left").where(c.isNull() | (c >= least) | (F.col("hard") & (c >= FILE_COSINE_LEAST)))
        near = F.when(c < least, 0.2 * s + 0.8 * c * c * 40).otherwise(0.3 * s + 0.7 * c * c * 60)
        rows = rows.withColumn("score", F.when(c.isNull(), s * 0.5).otherwise(near)).drop("cosine")
    exempt = F.col("hard") & (F.col("type") == "feedback")
    counted = F.row_number().over(Window.partitionBy("qid", "type", exempt).orderBy(F.col("score").desc(), "id"))
    kept = rows.withColumn("_n", counted).where(exempt | (F.col("_n") <= most)).where(F.col("score") > FILE_LEAST)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("qid", "type").orderBy(F.col("score").desc(), "id")).cast("long")).drop("_n")


def sops(scopes: DataFrame, files: DataFrame) -> DataFrame:
    """RET20: the procedures (name, text) that a task's scopes (qid, scope) name."""
    named = scopes.where(F.col("scope").startswith("scope:")).select("qid", F.substring("scope", 7, 1024).alias("name"))
    return named.join(files, "name").select("qid", "name", text.estimate_tokens(F.trim("text")).alias("tokens"))


def recommend(scored: DataFrame, most: int = 5) -> DataFrame:
    """RET18, SRT8: the best skills (of routing.skill_scores) that aren't always loaded and score at all."""
    good = scored.where((F.col("gate") != "always") & (F.col("score") > 0))
    first = good.orderBy(F.desc("score"), "name").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "name")).cast("long"))  # `most` rows


def prime(skills: DataFrame, session_type: str, allowed: tuple[str, ...]) -> DataFrame:
    """RET18: the skill of a session's type, if it is allowed, and what it loads along: name, part (`guide` or `also`), body."""
    own = skills.where((F.col("name") == session_type.lower().strip()) & F.col("name").isin(*allowed))
    also = own.select(F.explode("also_load").alias("name")).join(skills.select("name", "body"), "name")
    return own.select("name", F.lit("guide").alias("part"), "body").unionByName(also.select("name", F.lit("also").alias("part"), "body"))
