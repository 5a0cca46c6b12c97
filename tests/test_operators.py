"""Operators on literal rows, with the reference's behaviour families."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from skein.operators import analytics, facts, graph, markdown, retrieval, sequences
from skein.plans import fact_store, knowledge, ranking


def test_merge_keeps_order_of_ids(spark):
    rows = spark.createDataFrame([(3, "k", ["b"]), (1, "k", ["a", "b"]), (2, "x", ["c"])], "id long, key string, agents array<string>")
    got = {r["key"]: (r["id"], r["confirmations"], r["agents"]) for r in facts.merge_duplicates(rows, "key", "id", ["agents"]).collect()}
    assert got == {"k": (1, 2, ["a", "b"]), "x": (2, 1, ["c"])}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 5)], "k string, v long, n long")
    new = spark.createDataFrame([("a", 2, 1), ("b", 3, 1)], "k string, v long, n long")
    got = {r["k"]: (r["v"], r["n"], r["status"]) for r in facts.upsert(old, new, "k", ["v"], [], ["n"]).collect()}
    assert got == {"a": (2, 6, "updated"), "b": (3, 1, "inserted")}


def test_contradiction_needs_one_negation(spark):
    old = spark.createDataFrame([(1, "d", "the etcd cluster runs three members today"), (2, "d", "etcd cluster runs three members removed")], "id long, domain string, text string")
    new = spark.createDataFrame([(9, "d", "etcd cluster runs three members removed")], "id long, domain string, text string")
    assert [tuple(r) for r in facts.contradictions(new, old).collect()] == [(9, 1, 1)]


def test_contradictions_of_short_words_in_all_languages(spark):
    benchmark = spark.createDataFrame([(9, "the etcd node runs with six cores and disk")], "item_id long, text string")
    texts = [(1, "etcd node runs six cores disk", "de"), (23, "etcd node runs six cores disk", "de"), (27, "etcd node runs six cores", "en"), (3, "the with and was on of at etcd node runs", "en"), (47, "the with and of etcd node", "en")]
    documents = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert [tuple(r) for r in fact_store.contradictions_all(benchmark, documents).collect()] == [(9, 23, 2)]


def test_demotion_is_monotone(spark):
    rows = spark.createDataFrame([(1, "c", 5, True, 0.5, "auto"), (2, "c", 1, True, 0.4, "auto"), (3, "d", 2, False, 0.3, "auto"), (4, "d", 1, False, 0.9, "confirmed")], "id long, cluster string, confirmations long, verified boolean, score double, review_state string")
    got = {r["id"]: (r["state"], r["tier"]) for r in facts.demote(rows).collect()}
    assert got == {1: ("auto", 0), 2: ("pending", 2), 3: ("pending", 1), 4: ("confirmed", 0)}


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 10.0, 60), (1, 2, 9.0, 60), (1, 3, 1.0, 30), (1, 4, 0.0, 1)], "qid long, id long, score double, tokens long")
    assert [(r["place"], r["id"]) for r in retrieval.select_within(rows, 100, least_priority=0.0).orderBy("place").collect()] == [(1, 1), (2, 3)]


def brute_fold(rows, budget, most=8):
    """rows: (id, score, tokens) of one question."""
    left, kept = budget, []
    for i, score, tokens in sorted(rows, key=lambda r: (-r[1] / r[2], r[0])):
        if tokens <= left and score > 0 and len(kept) < most:
            left, kept = left - tokens, [*kept, i]
    return kept


def test_budget_equals_the_fold_over_all_rows(spark):
    rng = random.Random(5)
    rows = [(q, i, float(rng.randrange(0, 50)), rng.randrange(1, 40)) for q in range(6) for i in range(400)]
    df = spark.createDataFrame(rows, "qid long, id long, score double, tokens long")
    for budget in (3, 60, 1000):
        got = collections.defaultdict(list)
        for r in retrieval.select_within(df, budget, least_priority=0.0).orderBy("qid", "place").collect():
            got[r["qid"]].append(r["id"])
        assert dict(got) == {q: brute_fold([r[1:] for r in rows if r[0] == q], budget) for q in range(6)}


def test_bm25_budget_reads_all_matches_once(spark):
    texts = [(k, "etcd " * 30 + f"word{k} " * 600) for k in range(150)] + [(200, "etcd short"), (201, "etcd short"), (202, "etcd other"), (203, "nothing")]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "etcd")], "item_id long, text string")
    score = {r["id"]: round(r["score"], 6) for r in retrieval.bm25(documents, benchmark, "doc_id", "item_id").collect()}
    want = brute_fold([(k, score[k], max(1, len(t) // 4)) for k, t in texts if k in score and k != 201], 8000)
    assert {200, 202} <= set(want)
    assert [r["id"] for r in ranking.bm25_budget(documents, benchmark).orderBy("place").collect()] == want


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "qid long, id long, rank long")
    gold = spark.createDataFrame([(1, 6), (1, 9), (2, 1)], "qid long, id long")
    got = {r["qid"]: (r["reciprocal_rank"], r["hit"], r["recall"]) for r in retrieval.ranking_metrics(ranked, gold, 3).collect()}
    assert got == {1: (0.5, 1, 0.5), 2: (0.0, 0, 0.0)}


def test_majority_prefers_strong_values(spark):
    rows = spark.createDataFrame([("e", "general"), ("e", "general"), ("e", "a"), ("f", "general"), ("g", "b"), ("g", "a")], "e string, d string")
    assert {r["e"]: r["d"] for r in graph.majority(rows, "e", "d", weak="general").collect()} == {"e": "a", "f": "general", "g": "a"}


def test_triples_with_null_dates(spark):
    old = spark.createDataFrame([("a", "p", "b", None)], "s string, p string, o string, f string")
    new = spark.createDataFrame([("a", "p", "b", None), ("a", "p", "b", "2024")], "s string, p string, o string, f string")
    assert graph.add_triples(old, new, ["s", "p", "o", "f"]).count() == 2


def test_full_timeline_has_all_edges_of_both_ends(spark):
    at = dt.datetime(2024, 1, 5)
    lines = spark.createDataFrame([(7, k, at + dt.timedelta(days=31 * (k % 5)), "F") for k in range(200, 400)] + [(3, 7, at, "O"), (3, 8, at, "O")], "l_suppkey long, l_partkey long, l_shipdate timestamp, l_linestatus string")
    got = [(r["dir"], r["other"], r["valid_from"]) for r in knowledge.full_timeline(lines).collect()]
    assert sorted(x[1] for x in got if x[0] == "out") == list(range(200, 400)) and [x[1] for x in got if x[0] == "in"] == [3]
    assert [x[2] for x in got] == sorted(x[2] for x in got)


def test_error_runs(spark):
    rows = spark.createDataFrame([(1, 1, True, "x"), (1, 2, True, "x"), (1, 3, False, "x"), (1, 4, True, "x"), (1, 5, True, "y"), (1, 6, True, ""), (1, 7, True, "")], "s long, at long, bad boolean, on string")
    got = {r["at"]: r["run"] for r in sequences.error_runs(rows, "s", ["at"], F.col("bad"), F.col("on")).collect()}
    assert got == {1: 1, 2: 2, 4: 1, 5: 1, 6: 1, 7: 1}


def test_turns(spark):
    rows = spark.createDataFrame([(1, 1, "r1", 0), (1, 2, "r1", 50), (1, 3, "r2", 90), (1, 4, "r2", 0)], "s long, at long, req string, fill long")
    got = [(r["turn"], r["total"], r["floor"], r["working"]) for r in sequences.turns(rows, "s", ["at"], F.col("req"), F.col("fill")).orderBy("at").collect()]
    assert got == [(1, 0, 0, 0), (1, 50, 50, 0), (2, 90, 50, 40), (2, 90, 50, 40)]


def test_reverts(spark):
    rows = spark.createDataFrame([("f", 1, "a", "b"), ("f", 2, "b", "c"), ("f", 3, "b", "a"), ("g", 4, "b", "a")], "file string, at long, old string, new string")
    assert [r["at"] for r in sequences.reverts(rows, ["file"], "at", "old", "new").collect()] == [3]


def test_leases(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("r", 1, 7, at(0)), ("r", 2, 8, at(50)), ("r", 3, 7, at(90)), ("r", 4, 8, at(150)), ("r", 5, 8, at(300))], "resource string, id long, holder long, at timestamp")
    got = [(r["id"], r["won"], r["holder"]) for r in sequences.replay_leases(rows, 100).orderBy("id").collect()]
    assert got == [(1, True, 7), (2, False, 7), (3, True, 7), (4, False, 7), (5, True, 8)]


def test_cursor_stops_at_overflow(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    events = spark.createDataFrame([(1, k, at(k)) for k in range(1, 9)], "u long, id long, ts timestamp")
    cursors = spark.createDataFrame([(1, at(0))], "u long, cursor timestamp")
    assert tuple(sequences.deltas(events, cursors, "u", "ts", "id").first()) == (1, 6, at(6), True)


def test_maturity_needs_enough_facts(spark):
    rows = spark.createDataFrame([("a",)] * 19 + [("b",)] * 20, "d string")
    got = {r["d"]: r["score"] for r in analytics.maturity(rows, "d", F.lit(0.5)).collect()}
    assert got == {"a": 0.0, "b": 0.5}


def test_lines(spark):
    docs = spark.createDataFrame([(1, "# A\none two three four five six seven\n# B\n```\nOne two three four five six eight\n```")], "id long, text string")
    rows = markdown.lines(docs, "id", "text")
    out = markdown.outline(rows, F.when(F.col("line").startswith("# "), F.col("line")), F.col("line").startswith("```")).orderBy("line_no").collect()
    assert [r["heading"] for r in out] == ["# A", "# A", "# B", "# B", "# B", "# B"]
    assert [r["fenced"] for r in out] == [False, False, False, True, True, False]
    assert [(r["line_no"], r["first_line"]) for r in markdown.repeated_openings(rows).collect()] == [(5, 2)]


def test_duplicate_bullets(spark):
    rows = spark.createDataFrame([(1, "#12", True), (2, "#12", True), (1, "#34", True), (2, "#34", True), (3, "#12", True), (4, "#12", True)], "bullet long, token string, strong boolean")
    assert markdown.duplicate_pairs(rows).count() == 0  # #12 is in four bullets: common
    assert [r["kind"] for r in markdown.duplicate_pairs(rows.where("bullet < 3")).collect()] == ["same-ids"]


def test_divergence(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "p string, h string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "p string, h string")
    assert {r["path"]: r["state"] for r in markdown.divergence(a, b, "p", "h").collect()} == {"x": "same", "y": "differs", "z": "only_left", "w": "only_right"}
