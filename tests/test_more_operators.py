"""Routing, pool, pointers, pruning and graph operators on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import bloat, graph, markdown, pointers, pool, routing

NOW = dt.datetime(2024, 1, 2)


def test_skills(spark):
    glob = lambda *ps: [(text.glob_pattern(p), text.glob_specificity(p)) for p in ps]
    rows = [
        ("a", "always", 10, "", "", "", "", [], []),
        ("p", "reference", 10, "", "", "", "", glob("src/**/*.py", "**"), ["d"]),
        ("k", "reference", 10, "etcd backup", "", "", "restore", [], []),
        ("h", "hard", 10, "", "", "", "", [], []),
        ("d", "reference", 10, "", "", "", "", [], []),
    ]
    skills = spark.createDataFrame(rows, "name string, gate string, tokens long, trigger string, description string, domain string, body string, globs array<struct<pattern:string,specificity:double>>, also_load array<string>")
    files = spark.createDataFrame([("src/x/y.py",)], "path string")
    terms = F.array(F.lit("etcd"), F.lit("restore"))
    scored = routing.skill_scores(skills, terms, files)
    got = {r["name"]: (round(r["score"], 4), r["signal"]) for r in scored.collect()}
    assert got == {"a": (float("inf"), "always"), "p": (0.5, "path-glob"), "k": (0.35, "keyword"), "h": (0.075, "gate-floor"), "d": (0.0, "none")}
    chosen = {r["name"]: r["why"] for r in routing.select_skills(scored, 35).collect()}
    assert chosen == {"a": "always", "p": "score", "k": "score", "h": "score"}
    assert {r["name"] for r in routing.select_skills(scored, 45).collect()} == {"a", "p", "k", "h", "d"}


def test_routing(spark):
    facts = spark.createDataFrame([(1, "net", "route table changed", 0.5), (2, "net", "route flaps", 0.4), (3, "sto", "route to disk", 0.9)], "id long, domain string, text string, score double")
    asked = spark.createDataFrame([(1, "which route failed"), (2, "zzzz")], "qid long, text string")
    corpus = routing.corpus_domains(facts, asked)
    assert [tuple(r) for r in corpus.collect()] == [(1, "net", 2)]
    none = corpus.limit(0)
    got = {r["qid"]: (r["domain"], r["by"]) for r in routing.suggest(asked, none, none, corpus, F.lit("hint")).collect()}
    assert got == {1: ("net", "corpus"), 2: ("hint", "hint")}


def test_handoff(spark):
    rows = spark.createDataFrame([("old", "etcd", dt.datetime(2023, 12, 1), 10), ("new", "etcd ops", dt.datetime(2024, 1, 1), 10), ("big", "etcd", NOW, 9000)], "name string, skill string, at timestamp, tokens long")
    assert [r["name"] for r in routing.pick_handoff(rows, F.array(F.lit("etcd")), NOW).collect()] == ["new"]


def test_claims_and_pool(spark):
    claims = spark.createDataFrame([("r1", "s1", 1, NOW - dt.timedelta(hours=5), 3600, None, None, "n1"), ("r2", "s2", 2, NOW, 3600, None, None, "n2"), ("r3", "s1", 3, NOW, 3600, None, None, "n3")], "resource string, session_id string, pid long, created_at timestamp, ttl_sec long, released_at timestamp, released_reason string, note string")
    alive = spark.createDataFrame([(3, False)], "pid long, alive boolean")
    assert {r["resource"]: r["void"] for r in pool.active_claims(claims, NOW, alive).collect()} == {"r1": "expired", "r2": None, "r3": "holder-dead"}
    freed = pool.release(claims, F.col("resource") == "r1", NOW, "steal")
    assert freed.where("released_at is not null").count() == 1
    assert sorted(r["id"] for r in pool.handoff_tasks(freed, "s1", NOW).collect()) == ["handoff:r3"]
    live, orphans = pool.roster(spark.createDataFrame([("s1",), ("s9",)], "session_id string"), claims)
    assert {r["session_id"]: r["claims"] for r in live.collect()} == {"s1": 2, "s9": 0} and [r["resource"] for r in orphans.collect()] == ["r2"]


def test_tasks(spark):
    rows = [("b", "open", NOW, None, None, None), ("a", "open", NOW, None, None, None), ("c", "taken", NOW, "x", NOW, 7)]
    tasks = spark.createDataFrame(rows, "id string, status string, created_at timestamp, taken_by string, taken_at timestamp, taken_pid long")
    assert {r["id"]: r["taken_by"] for r in pool.take_first(tasks, "me", NOW).collect()} == {"a": "me", "b": None, "c": "x"}
    dead = spark.createDataFrame([(7, False)], "taken_pid long, alive boolean")
    assert {r["id"]: r["status"] for r in pool.reopen_dead(tasks, dead).collect()} == {"a": "open", "b": "open", "c": "open"}


def test_findings_and_sync(spark):
    rows = spark.createDataFrame([("abc", "new", None, None, None), ("abd", "new", None, None, NOW)], "id string, status string, reviewer string, updated_at timestamp, synced_at timestamp")
    assert {r["id"]: r["status"] for r in pool.review_findings(rows, "abc", "ok", "me", NOW).collect()} == {"abc": "ok", "abd": "new"}
    assert {r["status"] for r in pool.review_findings(rows, "ab", "ok", "me", NOW).collect()} == {"new"}
    pull, push = pool.sync(rows, rows.where("id = 'abd'").withColumn("id", F.lit("xyz")))
    assert [r["id"] for r in pull.collect()] == ["xyz"] and [r["id"] for r in push.collect()] == ["abc"]


def test_pointers(spark):
    lines = markdown.lines(spark.createDataFrame([(1, "- fixed `etcd-lease` and **quorum loss** #42 → domain/net.md §Lease rules\n- see net.md and gone.md\n- a.md [pin] → domain/net.md")], "id long, text string"), "id", "text")
    files = spark.createDataFrame([("domain/net.md",), ("x/a.md",), ("y/a.md",)], "path string")
    found = pointers.resolve(pointers.pointers(lines), files)
    assert sorted((r["line_no"], r["target"], r["state"]) for r in found.collect()) == [(1, "domain/net.md", "ok"), (2, "gone.md", "dangling"), (2, "net.md", "unqualified"), (3, "a.md", "ambiguous"), (3, "domain/net.md", "ok")]
    texts = spark.createDataFrame([("domain/net.md", "# Leases\nthe etcd-lease after quorum loss")], "path string, text string")
    assert [r["anchor"] for r in pointers.anchor_missing(found, texts).collect()] == ["Lease rules"]
    evict = pointers.evictable(lines, found, texts)
    assert {r["line_no"]: r["evict"] for r in evict.collect()} == {1: True, 2: False, 3: False}
    stay, gone = pointers.roll(lines, evict)
    assert (stay.count(), gone.count()) == (2, 1)


def test_pruning(spark):
    rows = [(False, [("tool_result", "data:image/png;base64," + "x" * 5000, False), ("tool_result", "y" * 5000, True), ("text", "<html>" + "a" * 600, None), ("text", "ok", None)])]
    entries = spark.createDataFrame(rows, "is_summary boolean, blocks array<struct<type:string,text:string,is_error:boolean>>")
    got = [b["text"] for b in bloat.strip_entries(entries).first()["blocks"]]
    assert got[0] == "[image stripped: 5022 bytes]" and len(got[1]) == 5000 and got[2] == "[HTML response stripped: 606 bytes]" and got[3] == "ok"
    long = " ".join(f"word{k}" for k in range(900))
    cut = bloat.strip_entries(spark.createDataFrame([(False, [("text", long, None)])], entries.schema)).first()["blocks"][0]["text"]
    assert cut.startswith(long[:1000]) and cut.endswith(long[-1000:]) and f"[stripped {len(long) - 2000} bytes]" in cut


def test_graph(spark):
    docs = spark.createDataFrame([(1, "the web-api runs on k8s-1 and web-api uses block-fast"), (2, "nothing")], "id long, text string")
    assert sorted((r["subject"], r["predicate"], r["object"]) for r in graph.relations(docs, "id", "text").collect()) == [("web-api", "runs_on", "k8s-1"), ("web-api", "uses_storage", "block-fast")]
    links, edges, dropped = graph.index_new(docs, docs.where("id = 2").select("id"), "id", "text", {"svc": r"\b(web-api)\b", "node": r"\b(k8s-\d+)\b"})
    assert links.count() == 2 and [tuple(r) for r in edges.collect()] == [("node:k8s-1", "mentioned_with", "svc:web-api", 1, 1)] and dropped.count() == 0
    triples = spark.createDataFrame([("svc:web-api", "runs_on", "node:k8s-1", NOW, None)], "subject string, predicate string, object string, valid_from timestamp, valid_to timestamp")
    names = links.select("entity_id", F.substring_index("entity_id", ":", -1).alias("name"))
    assert [r["dir"] for r in graph.find(names, triples, "K8S").collect()] == ["in"]
    closed = graph.invalidate(triples, "svc:web-api", "runs_on", "node:k8s-1", dt.datetime(2024, 2, 1))
    assert graph.find(names, closed, "k8s", dt.datetime(2024, 3, 1)).count() == 0


def test_pairs_keep_to_the_window_and_the_bound(spark):
    """Brute force over the mentions: the first eight by pattern and offset, at most 300 characters apart."""
    import itertools
    import random
    import re

    rng = random.Random(4)
    words = [f"svc{k}" for k in range(12)] + [f"n-{k:02}" for k in range(12)]
    texts = [(k, " ".join(rng.choice([*words, "x" * rng.randint(1, 90)]) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    patterns = {"svc": r"svc\d+", "node": r"(n-\d\d)", "skill": r"svc(3)\b"}
    edges, dropped = graph.pair_up(graph.mentions(spark.createDataFrame(texts, "id long, text string"), "id", "text", patterns))
    want, left = {}, {}
    for i, t in texts:
        seen = {}
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                name = m[1] if m.groups() else m[0]
                seen.setdefault(f"{kind}:{name}", (kind, m.start()))
        own = [(e, kind, at) for e, (kind, at) in seen.items() if kind != "skill"]
        if len(own) > 8:
            left[i] = len(own) - 8
        for (a, ka, pa), (b, kb, pb) in itertools.combinations(own[:8], 2):
            if abs(pa - pb) <= 300:
                key = (min(a, b), "co_occurs_with" if ka == kb else "mentioned_with", max(a, b))
                want[key] = want.get(key, 0) + 1
    assert {tuple(r)[:3]: r["weight"] for r in edges.collect()} == want
    assert {r["id"]: r["dropped"] for r in dropped.collect()} == left


def test_related_by_pairs_equals_brute_force(spark, monkeypatch):
    import collections
    import math
    import random

    rng = random.Random(8)
    docs = {d: {rng.randrange(60) for _ in range(rng.choice([0, 1, 3, 6, 25]))} for d in range(90)}
    links = spark.createDataFrame([(d, e, e % 4 == 0) for d, es in docs.items() for e in es], "d long, e long, weak boolean")
    held = {d: es for d, es in docs.items() if es}
    df = collections.Counter(e for es in held.values() for e in es)
    idf = {e: math.log(len(held) / n) for e, n in df.items() if 1 < n <= max(2, int(len(held) * 0.2))}
    want = {}
    for a, es in held.items():
        found = []
        for b, other in held.items():
            shared = {e for e in es & other if e in idf}
            if a != b and len(shared) >= 2 and any(e % 4 for e in shared):
                found.append((-round(sum(idf[e] for e in shared) / math.log2(2 + len(other)), 6), b, len(shared)))
        for rank, (_, b, n) in enumerate(sorted(found)[:4], 1):
            want[a, b] = (rank, n)
    for wide in (64, 4):
        monkeypatch.setattr(graph, "WIDE", wide)
        got = {(r["source"], r["target"]): (r["rank"], r["shared"]) for r in graph.related(links, "d", "e", weak="weak").collect()}
        assert got == want


def test_texts_that_hold_items(spark):
    """Items within words, of few words, empty and null, against `in`."""
    from skein.operators import evaluation

    items = ["one two three four five six", "two", "a b", "", None, "xx yy zz ww vv uu tt", "three four five six seven eight nine"]
    texts = ["zero one two three four five six seven eight nine", "pone two three four five sixty", "one  two three four five six", None, "", "xx yy zz ww vv uu t", "a b a b", "one two three four five six one two three four five six"]
    rows = spark.createDataFrame(list(enumerate(items)), "item long, text string")
    got = {r["qid"]: r["holders"] for r in evaluation.holders(spark.createDataFrame([(t,) for t in texts], "text string"), rows, "item").collect()}
    assert got == {k: sum(t is not None and x is not None and x in t for t in texts) for k, x in enumerate(items)}


def test_prefixes_and_reviews_of_nothing(spark):
    from skein.operators import curation, ingest

    empty = spark.createDataFrame([], "uuid string, reviewed boolean")
    assert ingest.mark_reviewed(empty, "abcd", NOW).count() == 0
    assert ingest.mine(spark.createDataFrame([], "session string, seq long, kind string, text string"), F.lit(0.5)).count() == 0
    assert curation.ancestry(spark.createDataFrame([], "pid long, parent long"), spark.createDataFrame([(5,)], "pid long")).collect()[0]["pid"] == 5
