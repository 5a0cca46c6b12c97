"""Claims, tasks, findings and the curation of facts over the driver's tables: orders are claims, tasks and findings, customers sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import vocab
from skein.functions import scoring, text
from skein.operators import curation, facts, ingest, pool

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

NOW = "2000-01-01 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"

#: An order is a claim of its customer's session on the order; finished ones are released.
_CLAIMS = """c AS (SELECT 'r' || o_orderkey AS resource, 's' || o_custkey AS session_id, o_custkey AS pid, o_orderdate AS created_at, (o_orderkey % 400) * 86400 AS ttl_sec, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS released_at, o_orderpriority AS note FROM orders)"""


def _claims(orders):
    text_of = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    released = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp"))
    return orders.select(text_of("r", "o_orderkey").alias("resource"), text_of("s", "o_custkey").alias("session_id"), F.col("o_custkey").alias("pid"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_orderkey") % 400 * 86400).alias("ttl_sec"), released.alias("released_at"), F.lit(None).cast("string").alias("released_reason"), F.col("o_orderpriority").alias("note"))


@query(f"""WITH {_CLAIMS} SELECT resource, CASE WHEN c_custkey IS NOT NULL AND c_custkey % 5 = 0 THEN 'holder-dead' WHEN ttl_sec > 0 AND epoch({_NOW}) - epoch(created_at) > ttl_sec THEN 'expired' END AS void
FROM c LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON pid = c_custkey WHERE released_at IS NULL""")
def void_claims(orders, customer):
    """CRD2, PRJ24, JN15: open claims and why they don't hold; a process that isn't listed isn't dead."""
    alive = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") % 5 != 0).alias("alive"))
    return pool.active_claims(_claims(orders), NOW, alive).select("resource", "void")


@query(f"WITH {_CLAIMS} SELECT resource, CASE WHEN released_at IS NULL AND session_id LIKE '%7' THEN 'steal' END AS reason, CASE WHEN released_at IS NULL AND session_id LIKE '%7' THEN {_NOW} ELSE released_at END AS released_at FROM c")
def released_claims(orders):
    """CRD3: claims of some sessions are taken from them, whoever holds them."""
    return pool.release(_claims(orders), F.col("session_id").endswith("7"), NOW, "steal").select("resource", F.col("released_reason").alias("reason"), "released_at")


@query(f"WITH {_CLAIMS} SELECT 'handoff:' || resource AS id, note AS title, resource, 'open' AS status, 's7' AS created_by FROM c WHERE session_id = 's7' AND released_at IS NULL")
def handed_off(orders):
    """CRD9: a session's open claims as tasks."""
    return pool.handoff_tasks(_claims(orders), "s7", NOW).select("id", "title", "resource", "status", "created_by")


@query(f"""WITH {_CLAIMS}, s AS (SELECT 's' || c_custkey AS session_id FROM customer WHERE c_custkey % 3 <> 0)
SELECT 'session' AS kind, s.session_id AS name, count(resource) AS claims FROM s LEFT JOIN c ON c.session_id = s.session_id AND released_at IS NULL GROUP BY ALL
UNION ALL SELECT 'orphan', resource, 1 FROM c WHERE released_at IS NULL AND session_id NOT IN (SELECT session_id FROM s)""")
def session_roster(orders, customer):
    """CRD7, JN15: live sessions with their claims, and claims of sessions that are gone."""
    live, orphans = pool.roster(customer.where("c_custkey % 3 != 0").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("session_id")), _claims(orders))
    out = live.select(F.lit("session").alias("kind"), F.col("session_id").alias("name"), F.col("claims").cast("long").alias("claims"))
    return out.unionByName(orphans.select(F.lit("orphan").alias("kind"), F.col("resource").alias("name"), F.lit(1).cast("long").alias("claims")))


@query(f"""
WITH t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'taken' ELSE 'done' END AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'P' THEN 'other' END AS taken_by, CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS pid FROM orders),
d AS (SELECT id, CASE WHEN status = 'taken' AND pid % 4 = 0 THEN 'open' ELSE status END AS status, created_at, CASE WHEN NOT coalesce(status = 'taken' AND pid % 4 = 0, false) THEN taken_by END AS taken_by FROM t)
SELECT id, CASE WHEN id = first THEN 'taken' ELSE status END AS status, CASE WHEN id = first THEN 'me' ELSE taken_by END AS taken_by FROM d, (SELECT arg_min(id, (created_at, id)) AS first FROM d WHERE status = 'open')""")
def pool_tasks(orders, customer):
    """CRD5: tasks of dead processes are open again, then the oldest open one is taken."""
    held = F.col("o_orderstatus") == "P"
    status = F.when(F.col("o_orderstatus") == "O", "open").when(held, "taken").otherwise("done")
    tasks = orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(held, "other").alias("taken_by"), F.lit(None).cast("timestamp").alias("taken_at"), F.when(held, F.col("o_custkey")).alias("taken_pid"))
    again = pool.reopen_dead(tasks, customer.select(F.col("c_custkey").alias("taken_pid"), (F.col("c_custkey") % 4 != 0).alias("alive")))
    return pool.take_first(again, "me", NOW).select("id", "status", "taken_by")


@query(f"""
SELECT id, CASE WHEN starts_with(id, p1) AND n1 = 1 THEN 'kept' ELSE 'new' END AS status, CASE WHEN starts_with(id, p1) AND n1 = 1 THEN 'me' END AS reviewer, CASE WHEN starts_with(id, p1) AND n1 = 1 THEN {_NOW} END AS updated_at
FROM (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS id FROM orders), (SELECT md5('7')[1:20] AS p1), (SELECT count(*) AS n1 FROM orders WHERE starts_with(md5(CAST(o_orderkey AS VARCHAR)), md5('7')[1:20]))""")
def reviewed_findings(orders):
    """CRD4, MUT7: a long prefix means one finding; a short one means many, and changes nothing."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = orders.select(F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("id"), F.lit("new").alias("status"), none("string").alias("reviewer"), none("timestamp").alias("updated_at"))
    from hashlib import md5

    one = md5(b"7").hexdigest()[:20]
    return pool.review_findings(pool.review_findings(rows, one, "kept", "me", NOW), one[:1], "dropped", "you", NOW)


@query("""
WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS synced_at FROM orders WHERE o_orderkey % 4 <> 0), r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'pull' AS way, id FROM r WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT 'push', id FROM l WHERE synced_at IS NULL AND id NOT IN (SELECT id FROM r)""")
def synced(orders):
    """CRD8: what another host has and what it lacks, by id."""
    local = orders.where("o_orderkey % 4 != 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("synced_at"))
    pull, push = pool.sync(local, orders.where("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("id")))
    return pull.select(F.lit("pull").alias("way"), "id").unionByName(push.select(F.lit("push").alias("way"), "id"))


@query("""
SELECT o_custkey AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey""")
def latest_states(orders):
    """MUT7-8: the newest state of each key."""
    rows = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return pool.latest_state(rows, "id", "at").select("id", "status")


@query("""
WITH p AS (SELECT p_partkey AS pid, p_partkey // 3 AS parent FROM part), m AS (SELECT max(pid) AS pid FROM p)
SELECT 'p' || pid AS session, pid FROM (SELECT pid // CAST(pow(3, k) AS BIGINT) AS pid, k FROM m, (SELECT unnest(range(0, 24)) AS k)) JOIN part ON p_partkey = pid WHERE pid > 1 AND pid % 4 <> 0 ORDER BY k LIMIT 1""")
def nearest_session(part):
    """CRD10: the living session nearest above a process, by the chain of parents."""
    processes = part.select(F.col("p_partkey").alias("pid"), F.floor(F.col("p_partkey") / 3).cast("long").alias("parent"))
    chain = curation.ancestry(processes, processes.agg(F.max("pid").alias("pid")))
    registry = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("session"), F.col("p_partkey").alias("pid"), (F.col("p_partkey") % 4 != 0).alias("alive"))
    return curation.own_session(registry, chain).select("session", "pid")


_STATUS = "CASE toxic WHEN 1 THEN 'rejected' WHEN 0 THEN CASE quality WHEN 1 THEN 'confirmed' END END"


def _facts(documents, labels):
    rows = documents.join(labels, "doc_id", "left")
    outcome = F.when(F.col("toxic") == 1, "rejected").when((F.col("toxic") == 0) & (F.col("quality") == 1), "confirmed")
    gone = F.when(F.col("doc_id") % 7 == 0, F.lit(NOW).cast("timestamp"))
    return rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), "text", outcome.alias("outcome"), gone.alias("tombstoned_at"), F.col("source").alias("cluster"))


@query(f"SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0 AND coalesce({_STATUS}, '') <> 'rejected'")
def live_facts(documents, labels):
    """PRJ25: neither tombstoned nor rejected."""
    return facts.live(_facts(documents, labels)).select("id")


@query("""
SELECT source, position, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = doc_id AND o_orderstatus <> 'F') THEN 'exists' ELSE 'inserted' END AS state
FROM (SELECT doc_id, lang AS source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position FROM documents)""")
def reconciled_sources(documents, orders):
    """MUT12: curated lists against the store; a tombstoned fact is gone, and inserted again."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1).cast("long")
    rows = documents.select("doc_id", F.col("lang").alias("source"), place.alias("position"), "text")
    keys = rows.join(orders, F.col("doc_id") == F.col("o_orderkey")).select(F.concat_ws(":", F.lit("reconcile"), "source", F.col("position").cast("string")).alias("fact_key"), F.when(F.col("o_orderstatus") == "F", F.lit(NOW).cast("timestamp")).alias("tombstoned_at"))
    return curation.reconcile(rows.drop("doc_id"), keys, promote=True)[0].select("source", "position", "state")


@query(f"SELECT o_orderkey AS id, o_orderstatus = 'O' AND o_orderkey % 6 <> 0 AND epoch({_NOW}) - epoch(o_orderdate) > 30 * 86400 AS expired FROM orders")
def expired_facts(orders):
    """STR5: live facts that weren't seen for thirty days; others and tombstoned ones aren't touched."""
    rows = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "live").otherwise("operational").alias("fact_type"), F.col("o_orderdate").cast("timestamp").alias("last_seen"), F.when(F.col("o_orderkey") % 6 == 0, F.lit(NOW).cast("timestamp")).alias("tombstoned_at"))
    return curation.expire(rows, F.lit(NOW).cast("timestamp"), 30).select("id", "expired")


@query(f"SELECT o_orderkey AS id FROM orders WHERE epoch({_NOW}) - epoch(o_orderdate) < 86400 * 100")
def fresh_cache(orders):
    """STR5: a cache's rows for as long as they last."""
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return curation.cached(rows, F.lit(NOW).cast("timestamp"), 86400 * 100).select("id")


@query("SELECT a.doc_id AS id, a.doc_id * 3 + 1 AS conflict_with, md5(b.text[1:120]) AS text_md5 FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id * 3 + 1 WHERE a.doc_id % 2 = 0")
def conflict_texts(documents):
    """JN19: each pending fact with the text it is in conflict with; null where that fact is gone."""
    rows = documents.select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 2 == 0, "pending").otherwise("auto").alias("review_state"), (F.col("doc_id") * 3 + 1).alias("conflict_with"))
    return curation.conflicts(rows).select("id", "conflict_with", F.md5(F.col("conflict_text").cast("binary")).alias("text_md5"))


@query("SELECT source AS \"cluster\", count(*) AS count FROM documents WHERE doc_id % 7 <> 0 GROUP BY source HAVING count(*) > 1 ORDER BY count(*) DESC, source LIMIT 5")
def contested_keys(documents, labels):
    """SRT9: the five keys that most live facts share."""
    return curation.contested(_facts(documents, labels), "cluster")


@query("""
WITH a AS (SELECT o_custkey AS qid, o_orderkey % 50 AS id, 0 AS tier, -max(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey AS qid, o_orderkey % 50 AS id, 1 AS tier, -max(o_totalprice) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.qid = b.qid AND a.id = b.id))
SELECT qid, id, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, s, id) AS place FROM u) WHERE place <= 5""")
def evidence_lists(orders):
    """SET7: linked facts first, then matched ones that aren't among them, five a question."""
    rows = orders.select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 50).alias("id"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    return curation.evidence(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus != 'F'"), 5)


@query("""
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'P')) AS findings_open, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS pool_open, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 1) AS pool_taken, (SELECT count(*) FROM customer) AS sessions""")
def status_row(orders, customer):
    """AGG26: open findings, open and taken tasks, sessions."""
    found = orders.select(F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "reviewing").otherwise("closed").alias("status"))
    tasks = orders.select(F.when(F.col("o_orderkey") % 3 == 0, "open").when(F.col("o_orderkey") % 3 == 1, "taken").otherwise("done").alias("status"))
    return curation.status_counts(found, tasks, customer)


@query("SELECT c_mktsegment AS harness, count(*) AS sessions FROM customer GROUP BY 1")
def harness_sessions(customer):
    """AGG26: live sessions by harness."""
    return curation.harness_counts(customer.select(F.col("c_mktsegment").alias("harness")))


@query("SELECT doc_id AS id, contains(text, 'the') OR contains(text, 'The') AS changed, md5(replace(replace(text, 'the', 'der'), 'The', 'Der')) AS text_md5 FROM documents")
def renamed_texts(documents):
    """MUT19: a name and its capitalised form, in all texts."""
    out = ingest.rename(documents.select(F.col("doc_id").alias("id"), "text"), "the", "der")
    return out.select("id", "changed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""
SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 10 = 0 THEN 30.0 ELSE (epoch_us({_NOW}) - epoch_us(o_orderdate)) / 86400000000.0 END, 6) AS days, round(exp(-ln(2) / 90.0 * (o_orderkey % 365)), 9) AS factor FROM orders""")
def fact_ages(orders):
    """DTM1, MTH4: ages in days, thirty where none is known; half the weight after ninety."""
    at = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp"))
    return orders.select(F.col("o_orderkey").alias("id"), F.round(scoring.age_days(at, F.lit(NOW).cast("timestamp")), 6).alias("days"), F.round(scoring.half_life((F.col("o_orderkey") % 365).cast("double")), 9).alias("factor"))


@query(f"""
SELECT c_custkey AS id, CASE lower(c_mktsegment) WHEN 'building' THEN 'builders' ELSE 'shared' END AS grp,
  CAST(CASE WHEN c_nationkey % 2 = 0 THEN {vocab.LOCAL_BYTES} ELSE CASE lower(c_mktsegment) {" ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.SESSION_BYTES.items())} ELSE {vocab.OTHER_BYTES} END END AS BIGINT) AS bytes FROM customer""")
def agent_groups(customer):
    """PRJ16-17: an agent's group, and the bytes that its session must have."""
    agent = F.lower("c_mktsegment")
    return customer.select(F.col("c_custkey").alias("id"), text.principal(agent, {"building": "builders"}, "shared").alias("grp"), text.session_threshold(F.when(F.col("c_nationkey") % 2 == 0, "local").otherwise("cluster"), agent).alias("bytes"))


@query(r"""
SELECT doc_id AS id, [x for x in regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_ \t\n\f\r]', ' ', 'g'), '[ \t\n\f\r]+') if x <> ''].len() AS words, len(regexp_extract_all(lower(text), '[a-z0-9][-a-z0-9_.]*')) AS routed,
  md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9][-a-z0-9_.]*'), ' ')) AS routed_md5 FROM documents""")
def tokenised(documents):
    """TXT7, TXT8: words of any script, and the router's tokens."""
    routed = text.router_tokens(F.col("text"))
    return documents.select(F.col("doc_id").alias("id"), F.size(text.words(F.col("text"))).cast("long").alias("words"), F.size(routed).cast("long").alias("routed"), F.md5(F.array_join(routed, " ").cast("binary")).alias("routed_md5"))


@query("""
SELECT page_id AS id, 'mined-' || md5(url)[1:8] AS label, md5(url) LIKE '%dead%' AS changed FROM pages""")
def shown_labels(pages):
    """PRJ21-22: ids as they are shown; texts that tell of a change of state."""
    uuid = F.concat(F.lit("mined-"), F.md5(F.col("url").cast("binary")))
    told = F.when(F.md5(F.col("url").cast("binary")).contains("dead"), "the old node was decommissioned").otherwise("nothing happened")
    return pages.select(F.col("page_id").alias("id"), text.display_id(uuid).alias("label"), text.state_change(told).alias("changed"))
