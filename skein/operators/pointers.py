"""Pointers of index files: what they name, whether it is there, and what may be evicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PATH = r"((?:[\w.-]+/)*[\w.-]+\.md)"


def pointers(lines: DataFrame) -> DataFrame:
    """TXT23-24, LNT5: id, line_no, target, anchor: paths of markdown files after an arrow, in backticks or in a link, each once a line.

    An anchor (§name) binds to the nearest pointer before it (JN22).
    """
    found = F.regexp_extract_all("line", F.lit(_PATH + r"(?:`|\))?(?:\s*§\s*([\w -]+))?"), 0)
    each = lines.select("id", "line_no", F.explode(found).alias("raw"))
    target, anchor = F.regexp_extract("raw", _PATH, 1), F.nullif(F.trim(F.regexp_extract("raw", r"§\s*([\w -]+)", 1)), F.lit(""))
    return each.select("id", "line_no", target.alias("target"), anchor.alias("anchor")).groupBy("id", "line_no", "target").agg(F.max("anchor").alias("anchor"))


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """LNT4: `ok`, `unqualified` (one file of that name elsewhere), `ambiguous` (several) or `dangling`. files: path."""
    names = files.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only"))
    out = found.join(files.select(F.col("path").alias("exact")), F.col("target") == F.col("exact"), "left").join(names, F.substring_index("target", "/", -1) == F.col("name"), "left")
    qualified = F.col("target").contains("/")
    state = F.when(F.col("exact").isNotNull(), "ok").when(F.col("n").isNull() | qualified, "dangling").when(F.col("n") > 1, "ambiguous").otherwise("unqualified")
    return out.select("id", "line_no", "target", "anchor", state.alias("state"), F.when(state == "unqualified", F.col("only")).otherwise(F.col("exact")).alias("path"))


def anchor_missing(resolved: DataFrame, texts: DataFrame) -> DataFrame:
    """TXT26, LNT5: pointers whose anchor's words don't all begin a word of a heading or bold line of the target. texts: path, text."""
    heads = F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)^(?:#+\s.*|.*\*\*.*\*\*.*)$"), 0), " ")
    hay = F.filter(F.split(F.lower(heads), r"[^a-z0-9]+"), lambda x: x != "")
    out = resolved.where("anchor is not null and path is not null").join(texts.select("path", hay.alias("hay")), "path")
    want = F.filter(F.split(F.lower("anchor"), r"[^a-z0-9]+"), lambda x: x != "")
    return out.where(~F.forall(want, lambda w: F.exists("hay", lambda h: h.startswith(w)))).select("id", "line_no", "target", "anchor")


def signature(line: Column) -> Column:
    """TXT22, TXT25: backticked, bold, compound and numbered identifiers of four characters and more."""
    code = F.regexp_extract_all(line, F.lit("`([^`]+)`"), 1)
    bold = F.regexp_extract_all(line, F.lit(r"\*\*([^*]+)\*\*"), 1)
    compound = F.regexp_extract_all(line, F.lit(r"\b([a-zA-Z0-9]+(?:[-_.][a-zA-Z0-9]+)+)\b"), 1)
    refs = F.regexp_extract_all(line, F.lit(r"(#\d{2,4})\b"), 1)
    low = F.transform(F.concat(code, bold, compound, refs), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(low, lambda x: (F.length(x) >= 4) | x.startswith("#")))


def evictable(bullets: DataFrame, found: DataFrame, texts: DataFrame, least_hits: int = 2, least_share: float = 0.5) -> DataFrame:
    """PRJ29, JN27, LNT6: bullets that aren't pinned, end in a pointer, and whose identifiers stand in the files it names.

    bullets: id, line_no, line; found: of `resolve`; texts: path, text.
    """
    homes = found.where("path is not null").join(texts, "path").groupBy("id", "line_no").agg(F.lower(F.concat_ws("\n", F.collect_list("text"))).alias("home"))
    out = bullets.withColumn("tokens", signature(F.col("line"))).join(homes, ["id", "line_no"], "left")
    hits = F.size(F.filter("tokens", lambda t: F.coalesce(F.col("home").contains(t), F.lit(False))))
    pinned = F.lower("line").contains("[pin]") | F.col("line").contains("📌")
    trailing = F.col("line").rlike(r"→[^→]*\.md[^→]{0,40}$")
    return out.select("id", "line_no", hits.alias("hits"), F.size("tokens").alias("tokens"), (~pinned & trailing & (hits >= least_hits) & (hits >= F.size("tokens") * least_share)).alias("evict"))


def roll(lines: DataFrame, evict: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK9: lines that stay, and lines for the archive."""
    gone = evict.where("evict").select("id", "line_no")
    return lines.join(gone, ["id", "line_no"], "left_anti"), lines.join(gone, ["id", "line_no"], "left_semi")
