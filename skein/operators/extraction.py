"""Records out of markdown: lines folded into headed sections, families of items, objectives and bold items. Columns of functions, within a row.

What a line needs to know of the lines before it - the heading above it, whether a fence is open - comes from running sums and maxima
that double their reach each pass, so a body of n lines costs n log n, and nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import text

#: Breaks between lines, as a text has them.
BREAKS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
HEADING, FENCE = r"^#{1,3}\s+(.+)", "```"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def lines(body: Column) -> Column:
    """The lines of a text; a break at its end begins none."""
    parts = F.split(F.coalesce(body, F.lit("")), BREAKS, -1)
    return text.let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step folded over an array's first 1, 2, 3, ... values; step is a sum, a maximum or alike. Each pass takes in what ends a power of two before."""

    def passes(given: Column) -> Column:
        reaches = F.filter(F.array(*[F.lit(1 << k) for k in range(24)]), lambda reach: reach < F.size(given))
        return F.aggregate(reaches, given, lambda so_far, reach: F.transform(so_far, lambda x, k: F.when(k >= reach, step(F.get(so_far, k - reach), x)).otherwise(x)))

    return text.let(values, passes)


def _headings(rows: Column) -> Column:
    """Of each line the place of the last heading at or before it, -1 for none."""
    at = F.transform(rows, lambda line, k: F.when(line.rlike(HEADING), k).otherwise(F.lit(-1)))
    return running(at, F.greatest)


def under(rows: Column, hints: tuple[str, ...]) -> Column:
    """The lines below headings with one of the words, without the headings; all lines if there is no such heading."""

    def chosen(line: Column, k: Column, heads: Column) -> Column:
        head = F.when(F.get(heads, k) >= 0, F.lower(strip(F.regexp_extract(F.get(rows, F.get(heads, k)), HEADING, 1)))).otherwise(F.lit(""))
        return (F.get(heads, k) != k) & text.any_of(head, hints)

    def narrowed(heads: Column) -> Column:
        marked = F.transform(rows, lambda line, k: F.struct(line.alias("line"), chosen(line, k, heads).alias("in")))
        return F.transform(F.filter(marked, lambda x: x["in"]), lambda x: x["line"])

    own = text.let(_headings(rows), narrowed)
    return text.let(own, lambda found: F.when(F.size(found) > 0, found).otherwise(rows))


clean = text.clean_markdown


def _open_fences(rows: Column) -> Column:
    """Of each line how many fence lines stand at or before it."""
    return running(F.transform(rows, lambda line: strip(line).startswith(FENCE).cast("int")), lambda a, b: a + b)


def items(body: Column, patterns: tuple[str, ...], most: int = 6, hints: tuple[str, ...] = ()) -> Column:
    """TXT14: the first `most` distinct lines with one of the patterns, cleaned: outside fences, no tables, images or headings, of 15 letters
    and more; of one over 180 letters the first sentence. hints: only below headings with such a word, if there are any."""

    def wanted(x: Column) -> Column:
        line = x["line"]
        prose = (line != "") & ~line.startswith("|") & ~line.startswith("![") & ~line.rlike(r"(?U)^#{1,3}\s+") & ~line.startswith(FENCE)
        return prose & (x["fences"] % 2 == 0) & F.lower(line).rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))

    def cut(item: Column) -> Column:
        sentence = F.regexp_extract(item, r"^([^.!?]+[.!?])", 1)
        return F.when(F.length(item) <= 180, item).when(F.length(sentence) > 20, strip(sentence)).otherwise(F.substring(item, 1, 150))

    def found(rows: Column) -> Column:
        marked = text.let(_open_fences(rows), lambda fences: F.transform(rows, lambda line, k: F.struct(strip(line).alias("line"), F.get(fences, k).alias("fences"))))
        cleaned = F.filter(F.transform(F.filter(marked, wanted), lambda x: clean(x["line"])), lambda item: F.length(item) >= 15)
        return F.slice(F.array_distinct(F.transform(cleaned, cut)), 1, most)

    own = lines(body)
    return text.let(text.let(own, lambda rows: under(rows, hints)) if hints else own, found)


def objective(body: Column) -> Column:
    """TXT15: of the first forty lines' first four paragraphs the first sentence of 31 to 199 letters that begins one of 30 letters and more."""
    start = F.struct(F.lit(False).alias("fence"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, line: Column) -> Column:
        fence, heading, bare = strip(line).startswith(FENCE), line.rlike(r"(?U)^#{1,3}\s+"), strip(line)
        ends = acc["fence"] | heading | (bare == "")
        done = F.when(ends & (acc["now"] != ""), F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
        now = F.when(ends, "").when(acc["now"] == "", bare).otherwise(F.concat(acc["now"], F.lit(" "), bare))
        kept = F.struct(acc["fence"].alias("fence"), now.alias("now"), done.alias("done"))
        return F.when(fence, F.struct((~acc["fence"]).alias("fence"), acc["now"].alias("now"), acc["done"].alias("done"))).otherwise(kept)

    paragraphs = F.aggregate(F.slice(lines(body), 1, 40), start, step, lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))
    prose = F.filter(F.transform(F.slice(paragraphs, 1, 4), clean), lambda p: F.length(p) >= 30)
    told = F.filter(F.transform(prose, lambda p: F.regexp_extract(p, r"^([^.!?]+[.!?])", 1)), lambda s: (F.length(s) > 30) & (F.length(s) < 200))
    return F.coalesce(strip(F.get(told, F.lit(0))), F.lit(vocab.NO_OBJECTIVE))


def bold_items(body: Column, headings: tuple[str, ...] = vocab.ANTI_PATTERN_HEADINGS, most: int = 6) -> Column:
    """TXT16: the first `most` bold texts of five letters and more below headings with one of the words, with what follows on the line, if that is under 130 letters."""
    pattern = r"\*\*([^*]+)\*\*([^*\n]*)"

    def sections(rows: Column) -> Column:
        """Contents below fitting headings, each for itself: a bold text doesn't go over a heading."""
        starts = F.concat(F.array(F.lit(-1)), F.filter(F.transform(rows, lambda line, k: F.when(line.rlike(HEADING), k)), lambda k: k.isNotNull()), F.array(F.size(rows)))

        def contents(marks: Column) -> Column:
            spans = F.transform(F.slice(marks, 1, F.size(marks) - 1), lambda at, n: F.struct(at.alias("at"), F.get(marks, n + 1).alias("end")))
            fit = F.filter(spans, lambda s: (s["at"] >= 0) & text.any_of(F.lower(strip(F.regexp_extract(F.get(rows, s["at"]), HEADING, 1))), headings))
            return F.transform(fit, lambda s: F.array_join(F.slice(rows, s["at"] + 2, s["end"] - s["at"] - 1), "\n"))

        return text.let(starts, contents)

    def named(content: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), 1).alias("bold"), F.regexp_extract_all(content, F.lit(pattern), 2).alias("rest"))
        own = F.transform(pairs, lambda x: F.struct(F.regexp_replace(strip(x["bold"]), r"\.+$", "").alias("bold"), clean(F.regexp_replace(strip(x["rest"]), r"^[. ]+", "")).alias("rest")))
        whole = F.transform(F.filter(own, lambda x: F.length(x["bold"]) >= 5), lambda x: F.when((x["rest"] != "") & (F.length(x["rest"]) < 130), F.concat(x["bold"], F.lit(" ("), x["rest"], F.lit(")"))).otherwise(x["bold"]))
        return F.transform(whole, lambda item: F.when(F.length(item) > 200, F.substring(item, 1, 150)).otherwise(item))

    return F.slice(F.flatten(F.transform(text.let(lines(body), sections), named)), 1, most)


def incident(docs: DataFrame, body: str = "body", families: Mapping = vocab.INCIDENT_FAMILIES) -> DataFrame:
    """TXT17: the columns of docs and the families of items of each body, as arrays."""
    return docs.select("*", *[items(F.col(body), patterns, hints=hints).alias(name) for name, (patterns, hints) in families.items()])


def quoted(item: Column) -> Column:
    """An item as a double-quoted YAML text; what only stands for one stays bare."""
    escaped = F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(item.startswith("# TODO"), item).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def incident_yaml(rows: DataFrame, families: Mapping = vocab.INCIDENT_FAMILIES) -> Column:
    """TXT17: an incident's record as YAML text, of rows of `incident` with title, slug, date, author, complexity, failure_class."""
    head = F.concat_ws("\n", F.concat(F.lit('title: "'), "title", F.lit('"')), F.concat(F.lit("slug: "), "slug"), F.concat(F.lit("date: "), F.substring("date", 1, 10)), F.lit("type: incident"), F.concat(F.lit("author: "), "author"), F.lit("reviewed_by:"), F.concat(F.lit("source: /posts/"), "slug", F.lit("/")), F.lit("confidence: observed"), F.concat(F.lit("complexity: "), "complexity"), F.concat(F.lit("failure_class: "), "failure_class"), F.lit(""))
    order = ("mechanism", "symptom", "root_cause", "fix", "prevention", "anti_patterns")
    parts = []
    for name in [n for n in order if n in families]:
        listed = F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(F.lit(vocab.NO_ITEM)))
        parts.append(F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(listed, lambda x: F.concat(F.lit("  - "), quoted(x))), "\n"), F.lit("\n")))
    return F.concat_ws("\n", head, *parts)
