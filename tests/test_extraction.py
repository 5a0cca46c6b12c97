"""Records out of markdown against a plain fold over lines, on random bodies, and shapes that have to come out."""

import random
import re

from pyspark.sql import functions as F

from skein import vocab
from skein.operators import extraction


def clean(s):
    for p, new in ((r"^[*\->]+\s*", ""), (r"^\d+\.\s+", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\[([^\]]+)\]\([^)]+\)(?:\{[^}]*\})?", r"\1"), ("`([^`]+)`", r"\1")):
        s = re.sub(p, new, s)
    return s.strip()


def headed(body):
    """heading (None before the first) and lines."""
    out = [(None, [])]
    for line in body.splitlines():
        m = re.match(r"#{1,3}\s+(.+)", line)
        if m:
            out.append((m[1].strip(), []))
        else:
            out[-1][1].append(line)
    return out


def items(body, patterns, most=6, hints=()):
    rows = body.splitlines()
    if hints:
        rows = [x for h, own in headed(body) for x in own if h and any(w in h.lower() for w in hints)] or rows
    found, fences = [], 0
    for line in map(str.strip, rows):
        if line.startswith("```"):
            fences += 1
        elif fences % 2 == 0 and line and not re.match(r"\||!\[|#{1,3}\s+", line) and any(re.search(p, line.lower()) for p in patterns):
            item = clean(line)
            if len(item) < 15:
                continue
            if len(item) > 180:
                m = re.match(r"[^.!?]+[.!?]", item)
                item = m[0].strip() if m and len(m[0]) > 20 else item[:150]
            if item not in found:
                found.append(item)
    return found[:most]


def objective(body):
    fences, paragraphs = 0, [[]]
    for line in body.splitlines()[:40]:
        if line.strip().startswith("```"):
            fences += 1
        elif fences % 2 or re.match(r"#{1,3}\s+", line) or not line.strip():
            paragraphs.append([])
        else:
            paragraphs[-1].append(line.strip())
    for p in [" ".join(x) for x in paragraphs if x][:4]:
        m = re.match(r"[^.!?]+[.!?]", clean(p)) if len(clean(p)) >= 30 else None
        if m and 30 < len(m[0]) < 200:
            return m[0].strip()
    return vocab.NO_OBJECTIVE


def bold_items(body, words=vocab.ANTI_PATTERN_HEADINGS, most=6):
    out = []
    for h, own in headed(body):
        if h and any(w in h.lower() for w in words):
            for m in re.finditer(r"\*\*([^*]+)\*\*([^*\n]*)", "\n".join(own)):
                name, rest = m[1].strip().rstrip("."), clean(m[2].strip().lstrip(". "))
                if len(name) >= 5:
                    item = f"{name} ({rest})" if rest and len(rest) < 130 else name
                    out.append(item[:150] if len(item) > 200 else item)
    return out[:most]


def bodies(n=400):
    rng = random.Random(9)
    pieces = ["# Fix and lessons", "## After", "#### not a heading", "#nor this", "### Failure **modes**", "```", "``` python", "", "  ", "| a | **Fix it** |", "![fix](x)", "- **check** the `fix` of [disk](http://x){a}", "1. restart the stuck node again", "> never trust it at all", "short fix", "The outage had a root cause that nobody saw. Then more.", "x" * 170 + " fix the thing that is very long", "Because of a race condition. " + "y" * 190, "**Silent retries.** hid the real cause", "**bold over", "a line** and more", "**Tiny** no", "a timeout; " + "word " * 40, "We added a gate to prevent it", "\tindented error line here", "Timing was everything here, wasn't it? Yes."]
    return [None, "", "\n", "one line without an end"] + ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(30))) + rng.choice(["", "\n"]) for _ in range(n)]


def test_all_equal_a_plain_fold(spark):
    texts = bodies()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(4)
    out = extraction.incident(df).withColumn("objective", extraction.objective(F.col("body"))).withColumn("bold", extraction.bold_items(F.col("body")))
    for r in out.collect():
        body = r["body"] or ""
        assert r["objective"] == objective(body), body
        assert r["bold"] == bold_items(body), body
        for name, (patterns, hints) in vocab.INCIDENT_FAMILIES.items():
            assert r[name] == items(body, patterns, hints=hints), (name, body)


def test_running_and_lines(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 3, 9, 100)], "v array<long>")
    for r in df.select("v", extraction.running(F.col("v"), lambda a, b: a + b).alias("s")).collect():
        assert r["s"] == [k * (k + 1) // 2 for k in range(len(r["v"]))]
    texts = ["", "a", "a\n", "\n", "a\r\nb\rc\x0bd e\x85f\n\n", "\n\na"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", extraction.lines(F.col("t")).alias("l")).collect():
        assert r["l"] == r["t"].splitlines()


def test_yaml(spark):
    import yaml

    df = spark.createDataFrame([("T", "s", "2024-01-02T03", "me", "simple", "storage", 'The disk "a\\b" failed in the rack.\n')], "title string, slug string, date string, author string, complexity string, failure_class string, body string")
    rows = extraction.incident(df)
    got = yaml.safe_load(rows.select(extraction.incident_yaml(rows).alias("y")).first()["y"])
    assert got["symptom"] == ['The disk "a\\b" failed in the rack.'] and got["fix"] == [None] and got["source"] == "/posts/s/" and str(got["date"]) == "2024-01-02"
