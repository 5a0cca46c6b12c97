"""Text expressions: tokens, chunks, classifiers, redaction. Column in, Column out; all JVM-side."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein import vocab


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: an expression that is named twice is otherwise evaluated twice, within a lambda each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def estimate_tokens(text: Column) -> Column:
    """TXT5: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def words(text: Column) -> Column:
    """TXT7: lower-cased words, punctuation as space; letters and digits of any script."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_ \t\n\f\r]", " "), r"[ \t\n\f\r]+"), lambda x: x != "")


def plain_words(text: Column) -> Column:
    """Runs of non-space characters, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\f\r]+"), lambda x: x != "")


def router_tokens(text: Column) -> Column:
    """TXT8."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][-a-z0-9_.]*"), 0)


def chunks(text: Column, size: int = vocab.CHUNK_WORDS) -> Column:
    """TXT6: windows of `size` words; a text of no more is one chunk, unchanged."""
    parts = F.filter(F.split(text, r"[ \t\n\f\r]+"), lambda x: x != "")

    def cut(p: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda k: F.array_join(F.slice(p, k * size + 1, size), " "))
        return F.when(F.size(p) <= size, F.array(text)).otherwise(windows)

    return let(parts, cut)


def any_of(text: Column, needles: Sequence[str]) -> Column:
    """Whether any needle is a substring."""
    out = F.lit(False)
    for x in needles:
        out = out | text.contains(x)
    return out


def boost(text: Column, base: Column) -> Column:
    """PRJ2: 0.15 more, up to 1, for a decision word."""
    return F.when(any_of(F.lower(text), vocab.DECISION_WORDS), F.least(F.lit(1.0), base + 0.15)).otherwise(base)


def is_finding(text: Column, patterns: Sequence[str] = vocab.FINDING_PATTERNS) -> Column:
    """PRJ3."""
    return text.rlike("(?i)(" + "|".join(patterns) + ")")


def steps(text: Column) -> Column:
    """PRJ4: the numbered lines' texts; only a line feed ends a line."""
    return F.regexp_extract_all(text, F.lit("(?md)" + vocab.STEP), 1)


def is_procedure(text: Column) -> Column:
    """PRJ4: three numbered lines or more, and a word of failure."""
    return (F.size(steps(text)) >= vocab.PROCEDURE_STEPS) & any_of(F.lower(text), vocab.FAILURE_WORDS)


def procedure(text: Column) -> Column:
    """PRJ4: struct of trigger, steps, resolution (the last step) and complete; null where there is none."""
    head = F.substring(text, 1, vocab.TRIGGER_SPAN)
    named = [F.trim(F.regexp_extract(head, p, 1)) for p in vocab.TRIGGERS]
    trigger = F.coalesce(*[F.when(head.rlike(p), F.when(t != "", t).otherwise(F.lit(vocab.NO_TRIGGER))) for p, t in zip(vocab.TRIGGERS, named, strict=True)], F.lit(vocab.NO_TRIGGER))
    complete = text.rlike("(?i)(?:" + "|".join(vocab.RESOLUTIONS) + ")")

    def build(found: Column) -> Column:
        ok = (F.size(found) >= vocab.PROCEDURE_STEPS) & any_of(F.lower(text), vocab.FAILURE_WORDS)
        return F.when(ok, F.struct(trigger.alias("trigger"), found.alias("steps"), F.element_at(found, -1).alias("resolution"), complete.alias("complete")))

    return let(steps(text), build)


def procedure_score(found: Column, base: Column) -> Column:
    """PRJ5: a whole procedure is worth 0.70 at least, one without an end 0.50."""
    least = F.when(found["complete"], vocab.PROCEDURE_SCORE).otherwise(vocab.PROCEDURE_PARTIAL)
    return F.when(found.isNull(), base).otherwise(F.greatest(base, least))


def is_noise(text: Column, command: str | None = None) -> Column:
    """PRJ10: a boilerplate opening, planning prose that begins within the first 40 characters, or a reviewer's verdict.

    command: the review tool's name, whose verbs (`<command> reject`) are verdicts too.
    """
    head = F.substring(text, 1, vocab.NOISE_SPAN)
    # [0, 40) of the clause's start: what stands before it has at most 39 characters
    early = F.substring(text, 1, vocab.NARRATION_SPAN).rlike(r"(?is)^.{0,%d}%s" % (vocab.NARRATION_START - 1, vocab.NARRATION))
    terms = "|".join([*vocab.VERDICT_TERMS, *([vocab.VERDICT_VERBS % re.escape(command)] if command else [])])
    verdict = head.rlike("(?is)" + vocab.VERDICT_QUOTED) | (text.rlike("(?i)" + vocab.VERDICT_OPENER) & text.rlike("(?i)(?:" + terms + ")"))
    return head.rlike("(?i)(" + "|".join(vocab.NOISE_HEADS) + ")") | early | verdict


def seeded_score(text: Column) -> Column:
    """PRJ11: the best class of the first 500 characters."""
    head = F.lower(F.substring(text, 1, vocab.SEED_SPAN))
    return F.greatest(F.lit(vocab.SEED_DEFAULT), *[F.when(head.rlike(p), F.lit(s)).otherwise(F.lit(0.0)) for p, s in vocab.SEED_PATTERNS])


def confidence(text: Column, domain: Column) -> Column:
    """PRJ12; hedges are matched in any case (the reference's capital-I ones never match: DEF6)."""
    hedges = let(F.lower(text), lambda low: sum((low.rlike(p).cast("int") for p in vocab.HEDGES), F.lit(0)))
    unsure = let(hedges, lambda n: F.when(n >= 2, 0.25).when(n == 1, 0.40))
    return F.when(text.rlike("(" + "|".join(vocab.OBSERVED) + ")"), 0.85).otherwise(F.coalesce(unsure, F.when(domain.isin(*vocab.STATE_DOMAINS), 0.45).otherwise(0.50)))


def domain_hits(text: Column, domains: Mapping[str, Sequence[str]], whole_short: bool = False) -> Column:
    """Array of (domain, hits, keywords) for all domains, in order; whole_short: keywords of up to 3 letters must be tokens."""

    def count(low: Column, tokens: Column | None) -> Column:
        rows = []
        for name, keys in domains.items():
            found = [F.array_contains(tokens, k) if tokens is not None and len(k) <= 3 else low.contains(k) for k in keys]
            rows.append(F.struct(F.lit(name).alias("domain"), sum((x.cast("int") for x in found), F.lit(0)).alias("hits"), F.lit(len(keys)).alias("keywords")))
        return F.array(*rows)

    if whole_short:
        return let(F.struct(F.lower(text).alias("low"), router_tokens(text).alias("tokens")), lambda x: count(x["low"], x["tokens"]))
    return let(F.lower(text), lambda low: count(low, None))


def found_domains(hits: Column) -> Column:
    """PRJ7: of domain_hits, the names with a keyword in the text, in order."""
    return F.transform(F.filter(hits, lambda d: d["hits"] > 0), lambda d: d["domain"])


def top_domain(hits: Column, default: str = "general") -> Column:
    """PRJ8: of domain_hits, the name with most distinct keywords; ties by order."""
    best = F.array_max(F.transform(hits, lambda d: d["hits"]))
    first = let(best, lambda most: F.element_at(F.filter(hits, lambda d: d["hits"] == most), 1)["domain"])
    return F.when(best > 0, first).otherwise(F.lit(default))


def tag_domains(text: Column, domains: Mapping[str, Sequence[str]]) -> Column:
    """PRJ7: names of the domains with a keyword in the text, in order."""
    return let(domain_hits(text, domains), found_domains)


def best_domain(text: Column, domains: Mapping[str, Sequence[str]], default: str = "general") -> Column:
    """PRJ8: most distinct keywords; ties by order."""
    return let(domain_hits(text, domains), lambda hits: top_domain(hits, default))


def first_domain(text: Column, domains: Mapping[str, Sequence[str]], default: str = "general") -> Column:
    """MUT4: the first domain, in order, with any keyword in the text."""
    return let(F.lower(text), lambda low: F.coalesce(*[F.when(any_of(low, keys), F.lit(name)) for name, keys in domains.items()], F.lit(default)))


def quoted(text: Column) -> Column:
    """TXT2: phrases of 3 to 60 characters between double quotes."""
    return F.regexp_extract_all(text, F.lit('"([^"]{3,60})"'), 1)


def phrase_share(phrases: Column, text: Column) -> Column:
    """TXT3: the share of phrases that the text contains."""
    low = F.lower(text)
    return F.when(F.size(phrases) == 0, 0.0).otherwise(F.size(F.filter(phrases, lambda p: low.contains(F.lower(p)))) / F.size(phrases))


def quoted_any(text: Column) -> Column:
    """TXT2: phrases of 3 to 60 characters between single or between double quotes, trimmed and lower-cased; single ones first."""
    found = F.concat(F.regexp_extract_all(text, F.lit("'([^']{3,60})'"), 1), F.regexp_extract_all(text, F.lit('"([^"]{3,60})"'), 1))
    return F.filter(F.transform(found, lambda p: F.lower(F.trim(p))), lambda p: F.length(p) >= 3)


def entity_names(text: Column) -> Column:
    """TXT4: names of infrastructure in a question, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(vocab.ENTITY_NAMES), 0)


def redact(text: Column, most: int = vocab.REDACT_MOST) -> Column:
    """TXT18: secrets masked, assignments keep their key, cut to `most` characters."""
    for p in vocab.SECRET_PATTERNS:
        text = F.regexp_replace(text, p, vocab.REDACTED)
    text = F.regexp_replace(text, vocab.SECRET_ASSIGNMENT, "$1=" + vocab.REDACTED)
    return let(text, lambda masked: shorten(masked, most))


def shorten(text: Column, most: int) -> Column:
    """At most `most` characters, and how many more there were."""
    more = F.length(text) - most
    return F.when(more > 0, F.concat(F.substring(text, 1, most), F.lit("…[+"), more.cast("string"), F.lit(" chars]"))).otherwise(text)


def canonical_json(value: Column) -> Column:
    """HSH3: JSON text with sorted keys and without spaces; what isn't JSON stays as it is."""
    return _json_text(value, F.lit(False))


def masked_json(value: Column) -> Column:
    """TXT18: canonical JSON in which the values of keys that sound secret are masked at any depth."""
    return _json_text(value, F.lit(True))


@F.pandas_udf(StringType())
def _json_text(values: pd.Series, mask: pd.Series) -> pd.Series:
    # nested JSON has no built-in form of this, hence Arrow batches
    secret = re.compile(vocab.SENSITIVE_KEY)

    def masked(x):
        if isinstance(x, dict):
            return {k: vocab.REDACTED if secret.search(k) else masked(v) for k, v in x.items()}
        return [masked(v) for v in x] if isinstance(x, list) else x

    def text(value, hide):
        if value is None:
            return None
        try:
            parsed = json.loads(value)
        except ValueError:
            return value
        return json.dumps(masked(parsed) if hide else parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([text(v, m) for v, m in zip(values, mask, strict=True)], dtype=object)


def state_change(text: Column) -> Column:
    """PRJ22: a verb of a change of state."""
    return text.rlike(r"(?i)\b(" + "|".join(vocab.STATE_CHANGES) + r")\b")


def display_id(uuid: Column, tags: Sequence[str] = ("mined-extra-", "mined-")) -> Column:
    """PRJ21: eight characters of an id, after the tag it may begin with."""
    known = F.coalesce(uuid, F.lit("?"))
    out = F.substring(known, 1, 8)
    for tag in reversed(tags):
        out = F.when(known.startswith(tag), F.concat(F.lit(tag), F.substring(known, len(tag) + 1, 8))).otherwise(out)
    return out


def principal(agent: Column, groups: Mapping[str, str], default: str) -> Column:
    """PRJ16: an agent's group."""
    return F.coalesce(*[F.when(agent == name, F.lit(group)) for name, group in groups.items()], F.lit(default))


def session_threshold(origin: Column, agent: Column) -> Column:
    """PRJ17: bytes that a session must have."""
    base = F.lower(F.replace(agent, F.lit("-agent"), F.lit("")))
    of_agent = F.coalesce(*[F.when(base == name, F.lit(size)) for name, size in vocab.SESSION_BYTES.items()], F.lit(vocab.OTHER_BYTES))
    return F.when(origin == "local", F.lit(vocab.LOCAL_BYTES)).otherwise(of_agent).cast("long")


def tool_target(name: Column, inputs: Column) -> Column:
    """PRJ20: what a tool call is about: a command's first 160 characters, a file, else 120 characters of the canonical input (JSON text)."""
    field = lambda k: F.coalesce(F.get_json_object(inputs, f"$.{k}"), F.lit(""))
    return F.when(name == "Bash", F.substring(field("command"), 1, 160)).when(name.isin("Edit", "Write", "Read", "NotebookEdit"), field("file_path")).otherwise(F.substring(canonical_json(inputs), 1, 120))


def clarified_intents(content: Column) -> Column:
    """PRJ15: JSON texts with an objective and constraints, open questions or escalations; those in code fences, else bare ones.

    A list in a fence gives its members. Returns an array of JSON texts.
    """
    fenced = F.regexp_extract_all(content, F.lit(r"(?s)```(?:json)?\s*([\[{][^`]+?[\]}])\s*```"), 1)
    bare = F.regexp_extract_all(content, F.lit(r'(?s)\{[^{}]*"objective"\s*:[^{}]+\}'), 0)

    def accepted(texts: Column) -> Column:
        # variants of objects and of lists of objects, side by side
        each = F.transform(texts, lambda t: F.try_parse_json(t))
        members = F.transform(each, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
        wanted = lambda v: F.try_variant_get(v, "$.objective", "variant").isNotNull() & (F.try_variant_get(v, "$.constraints", "variant").isNotNull() | F.try_variant_get(v, "$.open_questions", "variant").isNotNull() | F.try_variant_get(v, "$.escalate_if", "variant").isNotNull())
        return F.transform(F.filter(F.flatten(members), lambda v: v.isNotNull() & wanted(v)), lambda v: F.to_json(v))

    return let(accepted(fenced), lambda found: F.when(F.size(found) > 0, found).otherwise(accepted(bare)))


def newest_date(line: Column, section: Column) -> Column:
    """PRJ30: the newest date in a line: whole ones, and month-days of the section's year (of the year before, if their month is later than the section's); null without a section."""
    full = F.transform(F.regexp_extract_all(line, F.lit(r"(\d{4}-\d{2}-\d{2})"), 1), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    rest = F.regexp_replace(line, r"\d{4}-\d{2}-\d{2}", " ")
    short = F.regexp_extract_all(rest, F.lit(r"\b(\d{2}-\d{2})\b"), 1)
    year = lambda d: F.year(section) - F.when(F.substring(d, 1, 2).cast("int") > F.month(section), 1).otherwise(0)
    dated = F.transform(short, lambda d: F.try_to_date(F.concat_ws("-", year(d).cast("string"), d), "yyyy-MM-dd"))
    return F.when(section.isNotNull(), F.array_max(F.filter(F.concat(full, dated), lambda d: d.isNotNull())))


def without_front_key(text: Column, key: str) -> Column:
    """TXT27: the text without a top-level key of its front matter and the indented lines under it; all else is left as it is."""
    front = F.regexp_extract(text, r"(?s)\A(---[ \t]*\n.*?\n)---[ \t]*(?:\n|\z)", 1)
    rest = F.substring(text, F.length(front) + 1, F.length(text))
    cleaned = F.regexp_replace(front, r"(?m)^" + re.escape(key) + r"[ \t]*:[^\n]*\n(?:[ \t][^\n]*\n)*", "")
    return F.when(front == "", text).otherwise(F.concat(cleaned, rest))


def strip_html(html: Column) -> Column:
    """TXT9-11: markup off, entities of space folded, runs of space to one."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\f\r]+", " "))


def is_html(text: Column) -> Column:
    """TXT9: 500 characters and more that begin as a document, or have a head and a body in the first 2000."""
    return (F.length(text) >= 500) & (text.rlike(r"(?i)\A\s*<(!DOCTYPE|html)\b") | F.substring(text, 1, 2000).rlike(r"(?is)<head\b.*<body\b"))


def md5_mod(text: Column, modulus: int = 100) -> Column:
    """PRJ6: the md5 as a 128-bit number modulo a small one, digit by digit."""
    digits = F.transform(F.split(F.md5(text.cast("binary")), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: (a * 16 + d) % modulus)


def fact_key(text: Column, *, lower: bool = False, size: int = 16) -> Column:
    """HSH2: the first hex digits of a text's sha-256."""
    return F.substring(F.sha2((F.lower(text) if lower else text).cast("binary"), 256), 1, size)


def clean_markdown(text: Column) -> Column:
    """TXT13: without bullet or quote signs, number, bold, link with its target, and code marks."""
    for pattern, new in ((r"(?U)^[*\->]+\s*", ""), (r"(?U)^\d+\.\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)(?:\{[^}]*\})?", "$1"), ("`([^`]+)`", "$1")):
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def section(text: Column, header: str) -> Column:
    """TXT1: the body of a numbered section, up to the next numbered capital."""
    return F.trim(F.regexp_extract(text, r"(?s)\d+\.\s+" + header + r"[^\n]*\n(.*?)(?=\n\d+\.\s+[A-Z]|\z)", 1))


def glob_pattern(glob: str) -> str:
    """TXT19: a glob with ** (any depth), * and ? (within a segment) as a regular expression for rlike."""
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out.append("(?:[^/]+/)*")
            k += 3
        elif glob.startswith("**", k):
            out.append(".*")
            k += 2
        else:
            c = glob[k]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".^$+{}[]()|\\" else c)
            k += 1
    return "^" + "".join(out) + "$"


def glob_specificity(glob: str) -> float:
    """TXT20: literal segments, less half a point for each **; 0.5 at least."""
    parts = [x for x in glob.split("/") if x]
    return max(0.5, sum(not any(c in x for c in "*?[") for x in parts) - 0.5 * sum(x == "**" for x in parts))
