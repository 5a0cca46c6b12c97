"""Pruning of transcript entries, and records out of markdown bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import text
from skein.operators import extraction


def is_binary(value: Column) -> Column:
    """TXT10: over three tenths of the first 4096 characters are control characters."""
    head = F.substring(value, 1, 4096)
    return (F.length(head) > 0) & (F.length(F.regexp_replace(head, r"[^\p{Cc}\x{FFFD}]|[\t\n\r]", "")) > F.length(head) * 0.3)


def strip_value(value: Column, most: int = 2000) -> Column:
    """TXT11: images, documents of markup and binary give placeholders; a longer rest keeps its head and tail."""
    size, half = F.length(value).cast("string"), most // 2
    mark = lambda kind: F.concat(F.lit(f"[{kind} stripped: "), size, F.lit(" bytes]"))
    cut = F.concat(F.substring(value, 1, half), F.lit("\n...\n[stripped "), (F.length(value) - 2 * half).cast("string"), F.lit(" bytes]\n...\n"), F.right(value, F.lit(half)))
    image = F.substring(value, 1, 200).rlike(r"(?i)data:image/[a-z]+;base64,")
    return F.when(image, mark("image")).when(text.is_html(value), mark("HTML response")).when(is_binary(value), mark("binary content")).when(F.length(value) > most, cut).otherwise(value)


def strip_entries(entries: DataFrame, most: int = 2000) -> DataFrame:
    """TXT12: blocks (type, text, is_error) of each entry are pruned; errors and summaries stay whole."""
    keep = lambda b: F.coalesce(b["is_error"], F.lit(False)) | F.col("is_summary")
    pruned = F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), F.when(keep(b), b["text"]).otherwise(strip_value(b["text"], most)).alias("text"), b["is_error"].alias("is_error")))
    return entries.withColumn("blocks", pruned)


#: What tells an incident and an architecture, classes of failures, and domains by tag.
INCIDENT_WORDS = ("incident", "debugging", "postmortem", "outage", "failure", "broke", "crash", "cascade", "recovery", "fix", "broken")
ARCHITECTURE_WORDS = ("architecture", "design", "deployment", "platform", "stack", "pipeline", "build", "deploy", "setup", "integration")
FAILURE_CLASSES = {
    "networking": ("dns", "mtu", "route", "tunnel", "overlay", "proxy", "cni", "ingress", "loadbalancer", "endpoint"),
    "storage": ("pvc", "s3", "volume", "disk", "mount", "persistent", "csi"),
    "compute": ("oom", "cpu", "memory", "gpu", "containerd", "sandbox", "cgroup"),
    "control_plane": ("etcd", "apiserver", "kubelet", "scheduler", "quorum", "kube-proxy"),
    "observability": ("prometheus", "grafana", "loki", "otel", "alert", "metric", "scrape"),
    "security": ("oauth", "cert", "tls", "rbac", "token"),
}
TAG_DOMAINS = {
    "networking": ("networking", "dns", "cni"),
    "storage": ("storage",),
    "observability": ("observability", "monitoring", "prometheus", "grafana"),
    "security": ("security", "authentication", "oauth"),
    "agent": ("ai", "agent", "llm", "claude", "gemini"),
}


def record_type(title: Column, tags: Column, body: Column) -> Column:
    """PRJ26: incident or architecture, by how many words of each stand among the tags, in the title or in the body's first 2000 characters; a tie is an incident."""
    own = F.struct(F.lower(F.coalesce(title, F.lit(""))).alias("title"), F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower).alias("tags"), F.lower(F.substring(body, 1, 2000)).alias("body"))

    def votes(x: Column) -> Column:
        count = lambda words: sum(((F.array_contains(x["tags"], w) | x["title"].contains(w) | x["body"].contains(w)).cast("int") for w in words), F.lit(0))
        return F.when(count(INCIDENT_WORDS) >= count(ARCHITECTURE_WORDS), "incident").otherwise("architecture")

    return text.let(own, votes)


def failure_class(body: Column) -> Column:
    """PRJ26: the class with most words in the body, ties in order; `unknown` without any."""
    return text.best_domain(body, FAILURE_CLASSES, default="unknown")


def tag_domain(tags: Column) -> Column:
    """PRJ26: the first domain with a tag; `infrastructure` without any."""
    own = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    return text.let(own, lambda t: F.coalesce(*[F.when(F.arrays_overlap(t, F.array(*[F.lit(w) for w in words])), F.lit(name)) for name, words in TAG_DOMAINS.items()], F.lit("infrastructure")))


def complexity(body: Column) -> Column:
    """PRJ26: by headings: a cascade from four acts or eight sections, multi-step from two or four, else simple."""
    acts = F.size(F.regexp_extract_all(body, F.lit(r"(?m)^#{1,3}\s+Act\s+\d"), 0))
    sections = F.size(F.regexp_extract_all(body, F.lit(r"(?m)^#{1,3}\s+"), 0))
    return text.let(F.struct(acts.alias("a"), sections.alias("s")), lambda n: F.when((n["a"] >= 4) | (n["s"] >= 8), "cascade").when((n["a"] >= 2) | (n["s"] >= 4), "multi-step").otherwise("simple"))


def records(docs: DataFrame, title: str | None = None, tags: str | None = None) -> DataFrame:
    """TXT15-17, PRJ26: stem, kind, failure class, domain, complexity, objective, bold items and an incident's families of each markdown body."""
    b = F.col("body")
    head = F.col(title) if title else F.lit(None).cast("string")
    labels = F.col(tags) if tags else F.lit(None).cast("array<string>")
    return docs.select("stem", record_type(head, labels, b).alias("kind"), failure_class(b).alias("failure_class"), tag_domain(labels).alias("domain"), complexity(b).alias("complexity"), extraction.objective(b).alias("objective"), extraction.bold_items(b).alias("terms"), *[extraction.items(b, patterns, hints=hints).alias(name) for name, (patterns, hints) in vocab.INCIDENT_FAMILIES.items()])
