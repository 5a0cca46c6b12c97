"""Skills and routing: scores by paths, terms and gates; greedy selection; where a question belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators.retrieval import dealt

PATH_POINTS, TERM_POINTS, BODY_POINTS, HARD_FLOOR, HARD_FACTOR = 10.0, 3.0, 0.5, 0.5, 1.5


def skill_scores(skills: DataFrame, terms: Column, files: DataFrame | None = None) -> DataFrame:
    """RET13: score per token and the signal behind it.

    skills: name, gate, tokens, trigger, description, domain, body, globs (array of struct(pattern, specificity) with
    patterns of text.glob_pattern). terms: the context's words. files: path. Each file counts with its most specific glob.
    """
    path_score = skills.select("name", F.lit(0.0).alias("path_score")).limit(0) if files is None else None
    if files is not None:
        each = skills.select("name", F.explode("globs").alias("g")).join(files.select("path"), F.regexp_like(F.col("path"), F.col("g.pattern")))
        path_score = each.groupBy("name", "path").agg(F.max("g.specificity").alias("s")).groupBy("name").agg(F.sum("s").alias("path_score"))
    out = skills.join(path_score, "name", "left").na.fill(0.0, ["path_score"])
    front = F.array_distinct(F.concat(text.words(F.coalesce("trigger", F.lit(""))), text.words(F.coalesce("description", F.lit(""))), text.words(F.translate(F.coalesce("domain", F.lit("")), "-", " "))))
    own, body = F.size(F.array_intersect(terms, front)), F.size(F.array_intersect(terms, F.array_distinct(text.words(F.col("body")))))
    hard = F.col("gate").isin("hard", "mandate")
    base = F.col("path_score") * PATH_POINTS + own * TERM_POINTS + body * BODY_POINTS
    score = F.when(F.col("gate") == "always", F.lit(float("inf"))).otherwise(F.when(hard, F.greatest(base, F.lit(HARD_FLOOR)) * HARD_FACTOR).otherwise(base) / F.greatest(F.lit(1), F.col("tokens")))
    signal = F.when(F.col("gate") == "always", "always").when(F.col("path_score") > 0, "path-glob").when(hard & (own == 0) & (body == 0), "gate-floor").when(own > 0, "keyword").when(body > 0, "body-keyword").otherwise("none")
    return out.withColumn("score", score).withColumn("signal", signal)


def select_skills(scored: DataFrame, budget: int, also: str = "also_load") -> DataFrame:
    """RET14, JN24: always-gated skills, then by score while the budget lasts (what doesn't fit is skipped, zero ends it), then one hop of what those load.

    scored: name, score, tokens, also_load; a skill library is small, so the fold takes one row.
    """
    always = scored.where(F.isnan("score") | (F.col("score") == float("inf"))).select("name", F.lit("always").alias("why"), "tokens")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name", F.col("tokens").cast("long").alias("tokens"))))
    listed = scored.where((F.col("score") > 0) & (F.col("score") != float("inf"))).agg(rows.alias("rows"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<string>").alias("names"))
    step = lambda a, x: F.when(x["tokens"] <= a["left"], F.struct((a["left"] - x["tokens"]).alias("left"), F.concat(a["names"], F.array(x["name"])).alias("names"))).otherwise(a)
    fold = listed.select(F.aggregate("rows", start, step).alias("f"))
    chosen = fold.select(F.explode("f.names").alias("name"), F.col("f.left").alias("left"))
    picked = chosen.join(scored, "name").select("name", F.lit("score").alias("why"), "tokens")
    hop = chosen.join(scored, "name").select(F.explode(also).alias("name"), "left").distinct().join(scored.select("name", "tokens"), "name").join(chosen.select("name"), "name", "left_anti")
    fits = hop.where(F.col("tokens") <= F.col("left")).select("name", F.lit("also").alias("why"), "tokens")
    return always.unionByName(picked).unionByName(fits.join(always.select("name"), "name", "left_anti"))


def pick_handoff(handoffs: DataFrame, terms: Column, as_of, hours: int = 48, most_tokens: int = 3000) -> DataFrame:
    """RET19: the newest handoff of the last hours whose skill is named in the task."""
    at = F.col("at").cast("timestamp")
    fresh = handoffs.where((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(at) < hours * 3600) & (F.col("tokens") <= most_tokens) & F.arrays_overlap(terms, text.words(F.col("skill"))))
    return fresh.orderBy(F.desc("at"), "name").limit(1)


#: Letters by which a word and what holds it meet.
GRAM = 4


def holders_of(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (term, word) where the term, of GRAM letters or more, stands anywhere in the word: they meet by the term's first letters, then it is looked for."""
    starts = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda k: F.substr(F.col("word"), k, F.lit(GRAM)))
    pieces = words.where(F.length("word") >= GRAM).select("word", F.explode(F.array_distinct(starts)).alias("gram"))
    return pieces.join(terms.select("term", F.substring("term", 1, GRAM).alias("gram")), "gram").where(F.col("word").contains(F.col("term"))).select("term", "word")


def corpus_domains(facts: DataFrame, questions: DataFrame, most_terms: int = 10, most_facts: int = 20) -> DataFrame:
    """RET17, JN10: by the facts that hold one of a question's words of four letters and more, anywhere in them: the most frequent domain among the best `most_facts`.

    questions: qid, text; facts: id, domain, text, score. A word without spaces stands in a text if it stands in one of the text's words.
    Each fact looks up the words' first letters, of the stated questions, in its own words, in place; of the facts that hold a word only the
    best `most_facts` can be among a question's best, and only those move.
    """
    words = F.slice(F.array_distinct(F.filter(text.words(F.col("text")), lambda w: F.length(w) >= GRAM)), 1, most_terms)
    asked = questions.select("qid", F.explode(words).alias("term"))
    terms = F.broadcast(asked.select("term").distinct().withColumn("gram", F.substring("term", 1, GRAM)))  # of the stated questions
    split = facts.select("id", "domain", "score", text.plain_words(F.col("text")).alias("w")).repartition(dealt(facts.count()), "id")
    each = split.select("id", "domain", "score", F.explode(F.array_distinct("w")).alias("word")).where(F.length("word") >= GRAM)
    starts = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda k: F.substr(F.col("word"), k, F.lit(GRAM)))
    met = each.select("*", F.explode(F.array_distinct(starts)).alias("gram")).join(terms, "gram").where(F.col("word").contains(F.col("term")))
    held = met.groupBy("id", "term").agg(F.first("domain").alias("domain"), F.first("score").alias("score"))
    first = lambda rows, key: rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))).where(F.col("n") <= most_facts).drop("n")
    best = first(first(held, "term").join(asked, "term").select("qid", "id", "domain", "score").distinct(), "qid")
    votes = best.groupBy("qid", "domain").agg(F.count("*").alias("votes"))
    return votes.groupBy("qid").agg(F.min(F.struct((-F.col("votes")).alias("v"), "domain")).alias("b")).select("qid", F.col("b.domain").alias("domain"), (-F.col("b.v")).alias("votes"))


def suggest(questions: DataFrame, keyword: DataFrame, entity: DataFrame, corpus: DataFrame, hint: Column | None = None) -> DataFrame:
    """RET16: the first of keyword, entity, corpus and hint that has an answer; each: qid, domain."""
    out = questions.select("qid")
    for name, signal in (("keyword", keyword), ("entity", entity), ("corpus", corpus)):
        out = out.join(signal.select("qid", F.col("domain").alias(name)), "qid", "left")
    last = hint if hint is not None else F.lit(None).cast("string")
    source = F.when(F.col("keyword").isNotNull(), "keyword").when(F.col("entity").isNotNull(), "entity").when(F.col("corpus").isNotNull(), "corpus").when(last.isNotNull(), "hint").otherwise("none")
    return out.select("qid", F.coalesce("keyword", "entity", "corpus", last).alias("domain"), source.alias("by"))
