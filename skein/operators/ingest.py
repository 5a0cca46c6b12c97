"""From sessions to facts: mining, staging, promotion and what decides when a session is looked at again.

Sessions are tables of blocks (session, seq, kind, text); every step is a projection, a window within a
session or an aggregate by key, so no session is held as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import text

#: Words of an error; sizes and counts that mining keeps to.
ERROR_WORDS = ("error", "failed", "exception", "panic", "traceback")
BLOCK_CHARS, RESULT_CHARS, USER_CHARS, LEAST_SCORE, LEAST_BYTES, REGROWN = 150, 100, 30, 0.50, 10_000, 3
PER_SECTION, USERS, REQUESTS, BULLET, REQUEST, RESULT, FACT_LINE, FACT_CHARS = 12, 8, 3, 300, 200, 800, 80, 500
#: Sections that are worth a review.
SIGNAL = ("key_concepts", "errors_fixes", "pending_tasks")


def _strip(column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def mine(blocks: DataFrame, base: Column) -> DataFrame:
    """MUT18: session, section, place, bullet of the blocks worth keeping; sessions without a concept or an error have none.

    blocks: session, seq, kind (assistant, tool_result, user), text. base: a block's score before boosts.
    """
    body = F.when(F.col("kind") == "tool_result", F.col("text")).otherwise(_strip("text"))
    rows = blocks.select("session", "seq", "kind", body.alias("text"), base.alias("base"))
    boosted = text.boost(F.col("text"), F.col("base"))
    finding = F.when(text.is_finding(F.col("text")), F.greatest(boosted, F.lit(vocab.FINDING_SCORE))).otherwise(boosted)
    score = text.let(text.procedure(F.col("text")), lambda p: text.procedure_score(p, finding))
    wrong = text.any_of(F.lower("text"), ERROR_WORDS)
    spoken = (F.col("kind") == "assistant") & (F.length("text") >= BLOCK_CHARS) & ~text.is_noise(F.col("text"))
    section = (
        F.when(spoken & (score >= LEAST_SCORE), F.when(wrong, "errors_fixes").otherwise("key_concepts"))
        .when((F.col("kind") == "tool_result") & (F.length("text") >= RESULT_CHARS) & wrong, "errors_fixes")
        .when((F.col("kind") == "user") & (F.length("text") > USER_CHARS), "primary_request")
    )
    kept = rows.withColumn("section", section).where("section is not null")
    place = F.row_number().over(Window.partitionBy("session", "section").orderBy("seq"))
    most = F.when(F.col("section") == "primary_request", REQUESTS).otherwise(PER_SECTION)
    first = kept.withColumn("place", place).where(F.col("place") <= most)
    size = F.when(F.col("section") == "primary_request", REQUEST).otherwise(BULLET)
    cut = F.when(F.col("kind") == "tool_result", F.substring("text", 1, RESULT)).otherwise(F.col("text"))
    out = first.select("session", "section", F.col("place").cast("long").alias("place"), F.substring(cut, F.lit(1), size).alias("bullet"))
    # only sessions with a concept or an error are staged
    signal = F.max(F.col("section") != "primary_request").over(Window.partitionBy("session"))
    return out.withColumn("_s", signal).where("_s").drop("_s")


def sections(bullets: DataFrame) -> DataFrame:
    """MUT18: session, section, body: a section's bullets in order, as markdown (at most PER_SECTION each)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "bullet"))), lambda x: F.concat(F.lit("- "), x["bullet"]))
    return bullets.groupBy("session", "section").agg(F.array_join(listed, "\n").alias("body"))


def promote_mined(bodies: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """MUT4: facts of the lines of concepts and errors: fact_key, domain, fact_text, session, score, provenance and weight.

    bodies: session, section, body. A line of FACT_LINE characters and more that is no noise is a fact.
    """
    line = _strip(F.regexp_replace(_strip("line"), r"^[- ]+", ""))
    rows = bodies.where(F.col("section").isin("key_concepts", "errors_fixes")).select("session", "section", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).withColumn("line", line)
    good = rows.where((F.length("line") >= FACT_LINE) & ~text.is_noise(F.col("line")))
    key = text.fact_key(F.concat("session", F.lit(":"), F.substring("line", 1, 200)))
    facts = good.select(key.alias("fact_key"), text.first_domain(F.col("line"), domains).alias("domain"), F.substring("line", 1, FACT_CHARS).alias("fact_text"), "session", text.seeded_score(F.col("line")).alias("score"), "section", "line_no")
    once = facts.groupBy("fact_key").agg(F.min_by(F.struct("domain", "fact_text", "session", "score"), F.struct("section", "line_no")).alias("f"), F.count("*").alias("confirmations"))
    return once.select("fact_key", "f.*", "confirmations", F.lit("auto-mined").alias("provenance"), F.lit("operational").alias("fact_type"), F.lit(0.7).alias("injection_weight"))


def promote_events(events: DataFrame, outcome: Column | None = None) -> DataFrame:
    """MUT5: facts of typed events (type, subject, body, fact_key, session): a decision's subject and description, or a tool's first 300 characters."""
    subject, body = F.trim(F.coalesce("subject", F.lit(""))), F.trim(F.coalesce("body", F.lit("")))
    decision = F.when(body != "", F.concat(F.lit("[decision] "), subject, F.lit(": "), body)).otherwise(F.concat(F.lit("[decision] "), subject))
    output = F.trim(F.substring(F.coalesce("body", F.lit("")), 1, 300))
    tool = F.concat(F.lit("[tool:"), F.coalesce("subject", F.lit("unknown")), F.lit("]"))
    found = F.when(output != "", F.concat(tool, F.lit(" "), output)).otherwise(tool)
    is_decision = F.col("type") == "decision"
    fact = F.when(is_decision, decision).otherwise(found)
    return events.select("session", F.coalesce("fact_key", text.fact_key(fact)).alias("fact_key"), fact.alias("fact_text"), F.when(is_decision, 0.6).otherwise(0.4).alias("score"), (outcome if outcome is not None else F.lit(None).cast("string")).alias("outcome"))


def promote_intents(messages: DataFrame, default: str = "extra") -> DataFrame:
    """PRJ15, MUT6: facts of clarified intents in messages (session, text): key, domain, text and score."""
    each = messages.select("session", F.explode(text.clarified_intents(F.col("text"))).alias("intent"))
    kind = "struct<objective:string,constraints:array<string>,context_refs:array<string>>"
    rows = each.select("session", F.from_json("intent", kind).alias("d")).select("session", F.trim("d.objective").alias("objective"), "d.constraints", "d.context_refs").where("objective != ''")
    named = F.transform(F.filter("context_refs", lambda r: r.startswith("domain/")), lambda r: F.trim(F.element_at(F.split(F.replace(F.substring(r, 8, 4096), F.lit(".md"), F.lit("")), "#"), 1)))
    domain = F.coalesce(F.try_element_at(F.filter(named, lambda n: (n != "") & ~n.contains("/")), F.lit(1)), F.lit(default))
    listed = F.array_join(F.slice("constraints", 1, 3), "; ")
    body = F.concat(F.lit("[distillation] "), F.col("objective"), F.when(F.size("constraints") > 0, F.concat(F.lit("\nconstraints: "), listed)).otherwise(""))
    return rows.select("session", text.fact_key(F.col("objective"), lower=True).alias("fact_key"), domain.alias("domain"), body.alias("fact_text"), F.lit(0.75).alias("score"), F.lit("distillation").alias("provenance"))


def to_mine(sessions: DataFrame, compacted: DataFrame, staged: DataFrame) -> DataFrame:
    """MUT17, STR6: sessions (session, bytes) that weren't compacted, are large enough, and are new or at least three times as large as when they were mined.

    staged: session, mined_bytes.
    """
    large = sessions.where(F.col("bytes") >= LEAST_BYTES).join(compacted.select("session").distinct(), "session", "left_anti")
    seen = large.join(staged.select("session", "mined_bytes"), "session", "left")
    grown = F.col("mined_bytes").isNull() | (F.col("mined_bytes") <= 0) | (F.col("bytes") >= F.col("mined_bytes") * REGROWN)
    return seen.where(grown).select("session", "bytes", F.when(F.col("mined_bytes").isNull(), "new").otherwise("grown").alias("why"))


def scan_extra(blocks: DataFrame, summaries: DataFrame, known: DataFrame, base: Column) -> tuple[DataFrame, DataFrame]:
    """SRC17: of a second folder's sessions that aren't known: facts of intents in answers, and the mined bullets of those
    that have neither a summary nor an intent.

    blocks as of `mine`; summaries, known: session.
    """
    new = blocks.join(known.select("session").distinct(), "session", "left_anti")
    intents = promote_intents(new.where("kind = 'assistant'"))
    rest = new.join(summaries.select("session").distinct(), "session", "left_anti").join(intents.select("session").distinct(), "session", "left_anti")
    return intents, mine(rest, base)


def restage(staged: DataFrame, scanned: DataFrame) -> DataFrame:
    """MUT16: staged summaries after a scan (both: uuid, content_hash, body; staged also reviewed): new ones are added, changed ones
    take the new body and are to be reviewed again."""
    s, n = staged.alias("s"), scanned.alias("n")
    changed = F.col("n.uuid").isNotNull() & (F.col("s.uuid").isNull() | ~F.col("s.content_hash").eqNullSafe(F.col("n.content_hash")))
    pick = lambda c: F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    state = F.when(F.col("s.uuid").isNull(), "new").when(changed, "updated").otherwise("kept")
    reviewed = F.when(changed, F.lit(False)).otherwise(F.col("s.reviewed")).alias("reviewed")
    return s.join(n, F.col("s.uuid") == F.col("n.uuid"), "full_outer").select(F.coalesce("s.uuid", "n.uuid").alias("uuid"), pick("content_hash"), pick("body"), reviewed, state.alias("state"))


def resolve_prefix(staged: DataFrame, prefix: str) -> DataFrame:
    """MUT15: the one row whose uuid begins so; of several the one that isn't reviewed, if there is just one; else none."""
    hits = staged.where(F.lower("uuid").startswith(prefix.lower()))
    count = hits.agg(F.count("*").alias("n"), F.count_if(~F.col("reviewed")).alias("open"))  # one row
    return hits.join(F.broadcast(count)).where("n = 1 or (open = 1 and not reviewed)").drop("n", "open") if len(prefix) >= 4 else hits.limit(0)


def mark_reviewed(staged: DataFrame, prefix: str, at) -> DataFrame:
    """MUT15: the staged rows with the one that a prefix means marked; an ambiguous or short prefix changes nothing."""
    hit = resolve_prefix(staged, prefix).select(F.col("uuid").alias("_u"))
    out = staged.join(F.broadcast(hit), F.col("uuid") == F.col("_u"), "left")  # one row
    mine = F.col("_u").isNotNull() & ~F.col("reviewed")
    return out.withColumn("reviewed_at", F.when(mine, F.lit(at).cast("timestamp")).otherwise(F.lit(None).cast("timestamp"))).withColumn("reviewed", F.col("reviewed") | F.col("_u").isNotNull()).drop("_u")


def staged_names(entries: DataFrame) -> DataFrame:
    """SNK1: the file name of a staged entry (timestamp, uuid, reviewed, body): safe letters only, so it can't leave its folder; and whether its text tells a change of state."""
    stamp = F.regexp_replace(F.regexp_replace(F.substring(F.coalesce("timestamp", F.lit("unknown")), 1, 19), ":", "-"), "[^0-9A-Za-z_-]", "-")
    short = F.regexp_replace(F.substring("uuid", 1, 8), "[^0-9A-Za-z]", "")
    name = F.concat(stamp, F.lit("_"), F.when(short == "", "nouuid").otherwise(short), F.lit(".json"))
    return entries.withColumn("name", name).withColumn("state_change", F.when(~F.col("reviewed"), text.state_change(F.coalesce("body", F.lit("")))))


def has_signal(section: Column, body: Column) -> Column:
    """PRJ14: whether a section is one of the signal sections and not empty."""
    return section.isin(*SIGNAL) & (F.coalesce(body, F.lit("")) != "")


def review_order(summaries: DataFrame, most: int = 50) -> DataFrame:
    """SRT5: the next `most` unreviewed summaries with their place: changes of state first, those with signal next, then by time.

    summaries: uuid, signal, state_change, timestamp, reviewed.
    """
    order = [~F.col("state_change"), ~F.col("signal"), F.col("timestamp"), F.col("uuid")]
    first = summaries.where(~F.col("reviewed")).orderBy(*order).limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # `most` rows


def domain_counts(bodies: DataFrame, domains: Mapping[str, Sequence[str]], key: str, text_col: str) -> DataFrame:
    """AGG1: how many entries have a keyword of each domain."""
    each = bodies.select(key, F.explode(text.tag_domains(F.col(text_col), domains)).alias("domain"))
    return each.groupBy("domain").agg(F.count("*").alias("entries"))


def rename(docs: DataFrame, old: str, new: str, text_col: str = "text") -> DataFrame:
    """MUT19: an agent's name replaced in every text, as it is and capitalised; `changed` tells where."""
    body = F.replace(F.replace(F.col(text_col), F.lit(old), F.lit(new)), F.lit(old.capitalize()), F.lit(new.capitalize()))
    return docs.withColumn("changed", F.col(text_col) != body).withColumn(text_col, body)
