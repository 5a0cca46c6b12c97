"""Line operators over markdown and other line texts: outlines, lints, duplicate bullets, divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import vocab
from skein.sources.writers import scratch

#: Claims of a word that are paired with as many others at once.
PART = 2048


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 1), line."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("at", "line")).select("id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def outline(rows: DataFrame, heading: Column, fence: Column | None = None) -> DataFrame:
    """WIN14-15, LNT10: the heading that each line stands under, and whether it is in a code fence."""
    so_far = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("heading", F.last(heading, ignorenulls=True).over(so_far))
    return out if fence is None else out.withColumn("fenced", F.sum(fence.cast("int")).over(so_far) % 2 == 1)


def long_lines(rows: DataFrame, warn: int, error: int) -> DataFrame:
    """LNT1-2, PRJ23: lines over a threshold, links not counted."""
    size = F.length(F.regexp_replace("line", r"\[[^\]]*\]\([^)]*\)", "")).cast("long")
    return rows.withColumn("size", size).where(F.col("size") > warn).withColumn("status", F.when(F.col("size") > error, "RED").otherwise("YELLOW"))


def repeated_openings(rows: DataFrame, words: int = 6) -> DataFrame:
    """WIN16, LNT11: lines whose first words stood at the beginning of an earlier line of the text; first_line is where."""
    parts = F.filter(F.split(F.lower("line"), r"[ \t\r\f]+"), lambda x: x != "")
    keyed = rows.withColumn("parts", parts).where(F.size("parts") >= words).withColumn("opening", F.array_join(F.slice("parts", 1, words), " "))
    return keyed.withColumn("first_line", F.min("line_no").over(Window.partitionBy("id", "opening"))).where(F.col("line_no") > F.col("first_line")).select("id", "line_no", "first_line", "opening")


def duplicate_pairs(tokens: DataFrame, most_df: int = vocab.DUPLICATE_DF) -> DataFrame:
    """LNT3, JN12: pairs of bullets that cite the same rare identifiers.

    tokens: bullet, token, strong (boolean). A token of more than most_df bullets is common vocabulary, so a token makes few pairs.
    """
    once = tokens.distinct()
    rare = once.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df").between(2, most_df)).select("token")
    own = once.join(rare, "token")
    pairs = own.select("token", "strong", F.col("bullet").alias("a")).join(own.select("token", F.col("bullet").alias("b")), "token").where("a < b")
    counted = pairs.groupBy("a", "b").agg(F.count_if("strong").alias("strong"), F.count_if(~F.col("strong")).alias("weak"))
    kind = F.when(F.col("strong") >= vocab.DUPLICATE_STRONG, "same-ids").when((F.col("strong") >= 1) & (F.col("weak") >= vocab.DUPLICATE_MIXED), "same-id+symbols").when(F.col("weak") >= vocab.DUPLICATE_WEAK, "same-symbols")
    return counted.withColumn("kind", kind).where("kind is not null")


def divergence(left: DataFrame, right: DataFrame, path: str, digest: str) -> DataFrame:
    """JN17, SET2, SNK13: what became of each path between two trees."""
    a, b = left.select(F.col(path).alias("path"), F.col(digest).alias("l")), right.select(F.col(path).alias("path"), F.col(digest).alias("r"))
    state = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(F.col("l") == F.col("r"), "same").otherwise("differs")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def overlapping(claims: DataFrame, key: str, holder: str, tokens: Column, part: int = PART) -> DataFrame:
    """JN16, PRJ28: pairs of claims by different holders on different resources with a significant word in common.

    Words of one claim can't be shared and go first. A word's claims are cut into parts of about `part`, and each pair of parts is a join of its
    own, so a word that all claims have is no task's alone. A pair is given at the least word that it shares, with all of them counted, so pairs go
    through no exchange (but for keys that repeat).
    """
    spark, path = claims.sparkSession, scratch(claims.sparkSession, "claims")
    claims.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("k"), F.col(holder).alias("h"), F.array_distinct(tokens).alias("ts")).where("k is not null").write.parquet(path)
    rows = spark.read.parquet(path)
    each = rows.select("r", "k", "h", F.explode("ts").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    work = held.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    own = each.join(held, "token").groupBy("r").agg(F.first("k").alias("k"), F.first("h").alias("h"), F.collect_list(F.struct("token", "n")).alias("x"))
    placed = own.select("r", "k", "h", F.col("x.token").alias("ts"), F.explode("x").alias("x")).withColumn("parts", F.ceil(F.col("x.n") / part).cast("long"))
    mine, other = F.pmod(F.xxhash64("r"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    a = placed.select(F.col("x.token").alias("token"), mine.alias("pa"), other.alias("pb"), F.col("k").alias("a"), F.col("h").alias("ha"), F.col("ts").alias("ta"))
    b = placed.select(F.col("x.token").alias("token"), other.alias("pa"), mine.alias("pb"), F.col("k").alias("b"), F.col("h").alias("hb"), F.col("ts").alias("tb"))
    tasks, on = int(min(4096, work // (2 * part * part) + 1)), ["token", "pa", "pb"]
    met = a.repartition(tasks, *on).hint("merge").join(b.repartition(tasks, *on), on).where("a < b and ha != hb")
    alone = (F.size("ta") == 1) | (F.size("tb") == 1)
    both = F.array_intersect("ta", "tb")
    pairs = met.where(alone | (F.array_min(both) == F.col("token"))).select("a", "b", F.when(alone, 1).otherwise(F.size(both)).cast("long").alias("shared"))
    if rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return pairs
    return pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def significant(resource: Column, stop: tuple[str, ...] = vocab.CLAIM_STOPWORDS) -> Column:
    """PRJ28."""
    body = F.lower(F.regexp_extract(resource, r"(?s)^(?:[^:]*:)?(.*)$", 1))
    return F.filter(F.split(body, r"[-_:./ \t\n]+"), lambda t: (F.length(t) >= 4) & ~t.isin(*stop))
