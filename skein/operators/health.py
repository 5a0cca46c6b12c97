"""Findings about a folder of notes in one relation, and what is done about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import text

#: Bytes of the index from which it is warned about, and is an error; kinds of findings that stand in a report of drift.
BYTE_WARN, BYTE_ERROR = 16 * 1024, 20 * 1024
FINDING = ("path", "line_no", "check", "level", "detail")


def status(count: Column, warn: Column, error: Column) -> Column:
    """PRJ23: RED from the error on, YELLOW from the warning on, else GREEN."""
    return F.when(count >= error, "RED").when(count >= warn, "YELLOW").otherwise("GREEN")


def sizes(notes: DataFrame, limits: DataFrame) -> DataFrame:
    """LNT8: path, lines, bytes, status of notes (path, text); limits: kind, warn, error; a note's kind is its folder, or `root`.

    A kind without limits has those of `other`.
    """
    kind = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("root")
    lines = F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).cast("long")
    rows = notes.select("path", kind.alias("kind"), F.when(F.col("text") == "", 0).otherwise(lines).alias("lines"), F.octet_length("text").cast("long").alias("bytes"))
    own = limits.select("kind", "warn", "error")
    other = own.where("kind = 'other'").select(F.col("warn").alias("w"), F.col("error").alias("e"))  # one row
    joined = rows.join(F.broadcast(own), "kind", "left").join(F.broadcast(other))  # limits: a row a kind
    return joined.select("path", "lines", "bytes", status(F.col("lines"), F.coalesce("warn", "w"), F.coalesce("error", "e")).alias("status"))


def finding(rows: DataFrame, check: str, level: Column, detail: Column, path: Column | None = None, line: Column | None = None) -> DataFrame:
    """Rows of one check in the common form."""
    return rows.select((path if path is not None else F.col("path")).alias("path"), (line if line is not None else F.lit(None)).cast("long").alias("line_no"), F.lit(check).alias("check"), level.alias("level"), detail.alias("detail"))


def health(sized: DataFrame, index: str, *others: DataFrame) -> DataFrame:
    """LNT8: all findings as one relation: notes over their limits, the index over its budget of bytes, and other checks' rows (of `finding`)."""
    over = finding(sized.where("status != 'GREEN'"), "lines", F.col("status"), F.col("lines").cast("string"))
    heavy = sized.where((F.col("path") == index) & (F.col("bytes") >= BYTE_WARN))
    out = over.unionByName(finding(heavy, "bytes", F.when(F.col("bytes") >= BYTE_ERROR, "RED").otherwise("YELLOW"), F.col("bytes").cast("string")))
    for rows in others:
        out = out.unionByName(rows)
    return out


def misplaced(lines: DataFrame, domains: Mapping[str, Sequence[str]] = vocab.DOMAIN_KEYWORDS) -> DataFrame:
    """LNT9: line_no, domain, line of bullets in the common note that name a domain's keyword: the first domain; universal rules stay."""
    bare = F.trim("line")
    rows = lines.select("line_no", bare.alias("line")).where(F.col("line").startswith("-") | F.col("line").startswith("*"))
    rows = rows.withColumn("domain", text.first_domain(F.col("line"), domains, default="")).where("domain != ''")
    return rows.where(~text.any_of(F.lower("line"), vocab.UNIVERSAL)).select("line_no", "domain", F.substring("line", 1, 100).alias("line"))


def drift_report(findings: DataFrame, day: Column) -> DataFrame:
    """LNT12: the findings of a dated report: name, path, line_no, check, detail; no rows where all is well."""
    return findings.select(F.concat(F.lit("drift-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".md")).alias("name"), "path", "line_no", "check", "detail")
