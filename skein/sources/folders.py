"""Markdown folders, configuration trees, registries and listings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """SRC20-21: file, stem, head (the front matter's text, null without one), body."""
    whole = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True)
    front = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    has = F.col("value").rlike(front)
    return whole.select(F.input_file_name().alias("file"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("stem"), F.when(has, F.regexp_extract("value", front, 1)).alias("head"), F.when(has, F.regexp_extract("value", front, 2)).otherwise(F.col("value")).alias("body"))


def front_matter(docs: DataFrame, *fields: str) -> DataFrame:
    """Scalar fields of a front matter, as text."""
    return docs.select("*", *[F.nullif(F.trim(F.regexp_extract("head", rf"(?m)^{f}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)), F.lit("")).alias(f) for f in fields])


def bullets(docs: DataFrame) -> DataFrame:
    """SRC33: the `- ` lines of each file; the stem is the domain."""
    return docs.select(F.col("stem").alias("domain"), F.posexplode(F.split("body", "\n")).alias("line_no", "line")).where(F.col("line").startswith("- ")).select("domain", "line_no", F.trim(F.substring("line", 3, 1 << 20)).alias("fact_text"))


def yaml_leaves(docs: DataFrame, most_chars: int = 50_000) -> DataFrame:
    """SRC18: file, key path and value of every leaf of YAML documents (file, value), within a budget of characters a file.

    Values under secret-looking keys and templates are left out. YAML has no built-in reader, hence Arrow batches of pandas.
    """
    from skein.vocab import SENSITIVE_KEY

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import yaml

        secret = re.compile(SENSITIVE_KEY)

        def leaves(node, path):
            if isinstance(node, dict):
                for k, v in node.items():
                    if not secret.search(str(k)):
                        yield from leaves(v, f"{path}.{k}" if path else str(k))
            elif isinstance(node, list):
                for k, v in enumerate(node):
                    yield from leaves(v, f"{path}[{k}]")
            elif node is not None and "{{" not in str(node):
                yield path, str(node)

        for b in batches:
            rows = []
            for file, value in zip(b["file"], b["value"], strict=True):
                try:
                    parsed, used = yaml.safe_load(value), 0
                except yaml.YAMLError:
                    continue
                for place, (path, leaf) in enumerate(leaves(parsed, "")):
                    used += len(path) + len(leaf)
                    if used > most_chars:
                        break
                    rows.append((file, place, path, leaf))
            yield pd.DataFrame(rows, columns=["file", "place", "path", "leaf"])

    return docs.select("file", "value").mapInPandas(run, "file string, place long, path string, leaf string")


def aliases(lines: DataFrame) -> DataFrame:
    """SRC19: alias and function definitions of shell files, with the addresses they hold."""
    name = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*alias\s+([\w.-]+)=", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*(?:function\s+)?([\w.-]+)\s*\(\)", 1), F.lit("")))
    return lines.withColumn("name", name).where("name is not null").withColumn("addresses", F.regexp_extract_all("line", F.lit(r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"), 1))


def included(lines: DataFrame, home: str = "/root") -> DataFrame:
    """SRC19: file, target of the lines that include another file (`source x`, `. x`): relative paths start at the file's folder, ~ and $HOME at home."""
    said = F.regexp_extract(F.trim("line"), r"^(?:source|\.)\s+(.*)$", 1)
    path = F.replace(F.replace(said, F.lit("$HOME"), F.lit(home)), F.lit("~"), F.lit(home))
    folder = F.regexp_extract("file", r"^(.*/)[^/]*$", 1)
    return lines.where(said != "").select("file", F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)).alias("target"))


def walk(roots: DataFrame, edges: DataFrame, source: str = "file", target: str = "target", most_rounds: int = 1000) -> DataFrame:
    """SRC19: what is reached from the roots along edges, each once, with its least depth: file, depth.

    Breadth first: a round joins the newest files with the edges and leaves out what was reached before, so a cycle ends. Each
    round is a table in the shared folder; there are as many as the longest way is long, and the driver only learns whether one is empty.
    """
    from skein.sources.writers import scratch

    spark = roots.sparkSession
    path = scratch(spark, "walk")
    kind = dict(edges.dtypes)[target]
    schema = f"file {kind}"
    roots.select(F.col(source).cast(kind).alias("file")).distinct().write.parquet(f"{path}/depth=0")
    steps = edges.where(F.col(target).isNotNull()).select(F.col(source).alias("_from"), F.col(target).alias("file")).distinct()
    steps.write.parquet(f"{path}-edges")
    steps = spark.read.schema(f"_from {dict(steps.dtypes)['_from']}, file {kind}").parquet(f"{path}-edges")
    for depth in range(1, most_rounds + 1):
        newest = spark.read.schema(schema).parquet(f"{path}/depth={depth - 1}")
        known = spark.read.schema(f"{schema}, depth long").parquet(path)
        new = newest.select(F.col("file").alias("_at")).join(steps, F.col("_at") == F.col("_from")).select("file").distinct()
        new.join(known.select("file"), "file", "left_anti").write.parquet(f"{path}/depth={depth}")
        if spark.read.schema(schema).parquet(f"{path}/depth={depth}").isEmpty():
            return known
    raise RuntimeError(f"no end after {most_rounds} rounds")


def alias_facts(lines: DataFrame, roots: DataFrame, blocked: tuple[str, ...] = (), home: str = "/root") -> DataFrame:
    """SRC19: file, name, fact_text, depth of the aliases and functions in the root files and all that they include, each file once."""
    line = F.trim("line")
    body = r"^alias\s+([^=]+)=['\"]?([^'\"]+)['\"]?$"
    alias, command = F.trim(F.regexp_extract(line, body, 1)), F.trim(F.regexp_extract(line, body, 2))
    function = F.regexp_extract(line, r"^([a-zA-Z0-9_-]+)\s*\(\)\s*\{", 1)
    address = F.regexp_extract(command, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0)
    told = F.concat(F.lit("Alias '"), alias, F.lit("' executes: "), command, F.when(address != "", F.concat(F.lit(" (IP: "), address, F.lit(")"))).otherwise(""))
    defined = F.concat(F.lit("Function '"), function, F.lit("' is defined in "), F.substring_index("file", "/", -1))
    rows = lines.where(~line.startswith("#")).select("file", F.when(alias != "", alias).otherwise(function).alias("name"), F.when(alias != "", told).otherwise(defined).alias("fact_text"))
    rows = rows.where((F.col("name") != "") & ~F.col("name").isin(*blocked) if blocked else F.col("name") != "")
    return rows.join(walk(roots, included(lines, home)), "file")


def fingerprints(spark: SparkSession, path: str, exclude: tuple[str, ...] = (".git", "__pycache__", "node_modules")) -> DataFrame:
    """SRC29, PRJ27: path below the root and sha-256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").split("://")[-1]
    relative = F.substring_index("path", root + "/", -1)
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("digest")).where(~F.exists(F.split("path", "/"), lambda x: x.isin(*exclude)))


def cold_files(listing: DataFrame, as_of, hours: float = 4.0, least_bytes: int = 0) -> DataFrame:
    """SRC13-15: files not touched for `hours` and large enough; listing has `_metadata`'s fields."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("file_modification_time")
    return listing.where((age >= hours * 3600) & (F.col("file_size") >= least_bytes))


def merge_registries(*sources: DataFrame, key: str) -> DataFrame:
    """SRC22-23, SRC28: rows of several registries; of a key the first source's row stays."""
    tagged = [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_source"))).where("_n = 1").drop("_n", "_source")


def revert_pairs(commits: DataFrame) -> DataFrame:
    """SRC31: commits that revert another by subject, and fixes within 48 hours of the feature before them (time ascending: DEF20). commits: repo, sha, at, subject."""
    subject = F.regexp_extract("subject", r'^Revert "(.*)"$', 1)
    back = commits.where(F.col("subject").startswith("Revert ")).select("repo", F.col("sha").alias("by"), F.lit("revert").alias("kind"), subject.alias("s"), F.col("at").alias("then"))
    reverted = back.join(commits.select("repo", "sha", F.col("subject").alias("s"), "at"), ["repo", "s"]).where("at < then").select("repo", "kind", "by", "sha")
    w = Window.partitionBy("repo").orderBy("at", "sha").rowsBetween(Window.unboundedPreceding, -1)
    feature = F.last(F.when(F.col("subject").startswith("feat"), F.struct("sha", "at")), ignorenulls=True).over(w)
    fixes = commits.withColumn("f", feature).where(F.col("subject").startswith("fix") & (F.unix_seconds(F.col("at").cast("timestamp")) - F.unix_seconds(F.col("f.at").cast("timestamp")) <= 48 * 3600))
    return reverted.unionByName(fixes.select("repo", F.lit("fix_after_feat").alias("kind"), F.col("sha").alias("by"), F.col("f.sha").alias("sha")))
