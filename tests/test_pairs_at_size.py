"""Pairs by a word that all claims have, and results by calls of one id: nothing lists or moves more than it gives."""

import random

from pyspark.sql import functions as F

from skein.operators import degradation, markdown


def test_overlapping_counts_each_pair_once_in_parts_of_a_common_word(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(4), ["all", *rng.sample(["u", "v", "w"], rng.randrange(3)), f"own{k}"]) for k in range(60)] + [(7, 1, ["all", "u"]), (None, 2, ["all"]), (61, None, ["all"]), (62, 1, None)]
    for some in (rows, rows[:60]):
        want = {}
        for ka, ha, ta in some:
            for kb, hb, tb in some:
                if None not in (ka, kb, ha, hb, ta, tb) and ka < kb and ha != hb and set(ta) & set(tb):
                    want[ka, kb] = want.get((ka, kb), 0) + len(set(ta) & set(tb))
        df = spark.createDataFrame(some, "k long, h long, t array<string>")
        got = markdown.overlapping(df, "k", "h", F.col("t"), part=8)
        assert sorted(map(tuple, got.collect())) == sorted((a, b, n) for (a, b), n in want.items())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" not in plan and "pa" in plan


def test_results_meet_their_call_without_a_join(spark):
    call = lambda k, i, f: (str(k), "assistant", i, "Edit", f, True)
    result = lambda k, i: (str(k), "user", i, None, None, False)
    lines = [(1, call(1, "x", "f1")), (2, result(2, "x")), (3, call(3, "x", "f2")), (4, result(4, "x")), (5, result(5, "x")), (6, result(6, "y")), (7, call(7, "y", "f3")), (8, result(8, None))]
    block = "array<struct<type:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"
    data = []
    for seq, (_, kind, i, name, f, is_call) in lines:
        b = ("tool_use", i, name, '{"file_path": "%s"}' % f, None, None, None) if is_call else ("tool_result", None, None, None, i, True, "r")
        data.append(("s", "s", seq, kind, is_call, 0, 0, 0, [b]))
    df = spark.createDataFrame(data, f"session string, stem string, seq long, type string, main boolean, turn long, working long, total long, blocks {block}")
    got = degradation.tool_results(df)
    assert {r["seq"]: (r["tool"], r["target"]) for r in got.collect()} == {2: ("Edit", "f1"), 4: ("Edit", "f2"), 5: ("Edit", "f2"), 6: ("", ""), 8: ("", "")}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_by_blocks_equals_all_pairs(spark):
    """Ties, copies of ids, null, short, empty and odd vectors; no pair of single rows is joined where all vectors are plain."""
    from skein.operators import retrieval

    rng = random.Random(6)
    plain = [(k, [rng.randrange(-3, 4) / 4 for _ in range(3)], rng.choice([1, 2, 3, None])) for k in range(300)]
    odd = [(1000, None, 1), (1001, [1.0, None, 2.0], 2), (1002, [1.0], 2), (1003, [], 3), (1100, [float("nan"), 1.0, 0.0], 1), (1200, None, 2), (7, [0.5, 0.5, 0.5], 1)]
    for rows in (plain, plain + odd, odd[:1]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
        asked = df.where("vec_id % 100 = 0")
        q = asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
        scored = df.join(q, F.col("vec_id") != F.col("qid")).select("qid", F.col("vec_id").alias("id"), "label", F.round(retrieval.scoring.dot(F.col("embedding"), F.col("qv")), 6).alias("score"))
        by = lambda r: repr(tuple(r))
        for k in (3, 50, 1000):
            want = retrieval.top_k(scored.drop("label"), k).where("qid < 1100")
            assert sorted(map(by, retrieval.nearest(df, asked, k).where("qid < 1100").collect())) == sorted(map(by, want.collect()))
        want = retrieval.max_pool(scored, "label").collect()
        assert sorted(map(by, retrieval.best_of_groups(df, asked, "label").collect())) == sorted(map(by, want))
    df = spark.createDataFrame(plain, "vec_id long, embedding array<double>, label long")
    plan = retrieval.nearest(df, df.where("vec_id % 100 = 0"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def test_pairs_of_texts_and_questions_are_summed_where_they_are_made(spark):
    from skein.operators import postings, retrieval

    docs = spark.createDataFrame([(k, f"common w{k % 5} w{k % 7}") for k in range(90)], "id long, text string")
    asked = spark.createDataFrame([(1, "common w1"), (2, "w2 w6 common common")], "qid long, text string")
    for shared in (retrieval.matches(docs, asked, "id", "qid"), postings.matches(postings.build(docs, "id"), asked, "qid")):
        for df in (retrieval.bm25(docs, asked, "id", "qid", shared=shared), retrieval.keyword_share(docs, asked, "id", "qid", shared=shared)):
            assert df.count() == 180
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in plan.splitlines() if "hashpartitioning(qid" in x and ", id#" in x]


def test_cooccurrence_in_parts_that_grow_with_the_rows(spark, monkeypatch):
    from skein.operators import graph

    rng = random.Random(8)
    rows = [(rng.choice([None, *range(20)]), rng.choice([None, *range(15)])) for _ in range(300)]
    want = {}
    for g in range(20):
        own = sorted({m for x, m in rows if x == g}, key=lambda m: (m is not None, m or 0))[:8]
        for a in own:
            for b in own:
                if None not in (a, b) and a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    monkeypatch.setattr(graph, "ROWS", 50)
    got = graph.cooccurrence(spark.createDataFrame(rows, "g long, m long"), "g", "m")
    assert {(r["subject"], r["object"]): r["weight"] for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == 6 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_related_compares_classes_so_copies_add_no_pairs(spark, monkeypatch):
    """Texts with the same entities and size in many copies, in parts of two rows, against brute force; pairs don't grow with the copies."""
    import collections
    import math

    from skein.operators import graph

    rng = random.Random(12)
    sets = [frozenset(rng.sample(range(40), rng.choice([1, 2, 3, 5, 9]))) for _ in range(25)]
    seen, joined = [], graph._joined
    monkeypatch.setattr(graph, "PART", 2)

    def counting(left, right, key, by, least=1):
        met, n = joined(left, right, key, by, least)
        seen.append(met.where("a != b").count())
        return met, n

    monkeypatch.setattr(graph, "_joined", counting)
    for copies in (1, 4):
        docs = {d + 25 * c: sets[d] for d in range(25) for c in range(copies)}
        df = collections.Counter(e for es in docs.values() for e in es)
        idf = {e: math.log(len(docs) / n) for e, n in df.items() if 1 < n <= max(2, int(len(docs) * 0.2))}
        want = set()
        for a, es in docs.items():
            found = []
            for b, other in docs.items():
                shared = {e for e in es & other if e in idf}
                if a != b and len(shared) >= 2 and any(e % 3 for e in shared):
                    found.append((-round(sum(idf[e] for e in shared) / math.log2(2 + len(other)), 6), b, len(shared)))
            want |= {(a, b, n, -s, rank) for rank, (s, b, n) in enumerate(sorted(found)[:4], 1)}
        rows = [(d, e, e % 3 == 0) for d, es in docs.items() for e in es]
        for wide in (64, 4):
            monkeypatch.setattr(graph, "WIDE", wide)
            got = graph.related(spark.createDataFrame(rows, "d long, e long, weak boolean"), "d", "e", weak="weak").collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
    few, many = seen[0], seen[len(seen) // 2]
    assert many <= 25 * 24 * 36  # of classes, not of their hundred texts
    assert few > 0


def test_facts_that_hold_a_word_move_only_if_they_can_be_among_the_best(spark):
    from skein.operators import routing

    rng = random.Random(3)
    words = ["alphabet", "betas", "gammaray", "deltas", "x", "epsilonic", "ßtraßen"]
    facts = [(k, rng.choice(["a", "b", "c"]), " ".join(rng.sample(words, 3)) if k % 9 else None, k % 7) for k in range(200)]
    asked = [(1, "beta gamma"), (2, "phab x epsilon"), (3, "nothing"), (4, None), (5, "traß delta")]
    df = routing.corpus_domains(spark.createDataFrame(facts, "id long, domain string, text string, score long"), spark.createDataFrame(asked, "qid long, text string"), most_facts=5)
    want = {}
    for q, t in asked:
        terms = [w for w in (t or "").split() if len(w) >= 4]
        held = sorted((-s, i, d) for i, d, body, s in facts if body and any(w in body for w in terms))[:5]
        counts = {d: sum(x[2] == d for x in held) for *_, d in held}
        if counts:
            want[q] = min((-n, d) for d, n in counts.items())
    assert {r["qid"]: (-r["votes"], r["domain"]) for r in df.collect()} == want
    assert "WindowGroupLimit [term" in _plan(df)


def test_contradictions_are_counted_where_their_pairs_are_made(spark):
    from skein import vocab
    from skein.operators import facts

    rng = random.Random(4)
    words = [f"w{k}" for k in range(14)]
    text = lambda: " ".join(rng.sample([*words, vocab.NEGATIONS[0], vocab.NEGATIONS[1]], rng.randrange(3, 12)))
    rows = [[(k, rng.choice(["d", "e", None]), text() if k % 11 else None) for k in range(n)] for n in (40, 120)]
    new, old = (spark.createDataFrame(r, "id long, domain string, text string") for r in rows)
    want = {}
    for a, da, ta in rows[0]:
        hits = []
        for b, db, tb in rows[1]:
            if da is not None and da == db and ta and tb:
                wa, wb = set(ta.split()) - set(vocab.CONTRADICTION_STOP), set(tb.split()) - set(vocab.CONTRADICTION_STOP)
                if len(wa & wb) >= 5 and bool(wa & set(vocab.NEGATIONS)) != bool(wb & set(vocab.NEGATIONS)):
                    hits.append(b)
        if hits:
            want[a] = (min(hits), len(hits))
    df = facts.contradictions(new, old)
    assert want and {r["new_id"]: (r["conflict_with"], r["conflicts"]) for r in df.collect()} == want
    assert not [x for x in _plan(df).splitlines() if "hashpartitioning(" in x and "old_id" in x and "new_id" in x] and "SortMergeJoin" not in _plan(df)


def test_sessions_are_ranked_by_units_that_stay_where_they_are(spark):
    """Against `rank_hybrid` asked once a question; only a row a question and session moves by question."""
    from skein import vocab
    from skein.operators import evaluation

    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", *vocab.DECISION_WORDS[:3], "delta"]
    body = lambda k: None if k % 13 == 5 else "" if k % 13 == 6 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
    units = spark.createDataFrame([(k, k // 4, body(k)) for k in range(80)], "unit long, session long, text string")
    asked = spark.createDataFrame([(1, "alpha beta alpha"), (2, "gamma " + vocab.DECISION_WORDS[0]), (3, "nowhere"), (4, None)], "qid long, text string")
    own = evaluation.rank_hybrid(units.crossJoin(asked.select("qid")), asked).withColumn("score", F.round("score", 6))
    want = {}
    for r in own.collect():
        want.setdefault(r["qid"], {}).setdefault(r["session"], []).append((-r["score"], r["unit"]))
    df = evaluation.rank_shared(units, asked)
    got = {(r["qid"], r["rank"]): r["session"] for r in df.collect()}
    assert got == {(q, n): s for q, ss in want.items() for n, (_, s) in enumerate(sorted((min(us), s) for s, us in ss.items()), 1)}
    assert not [x for x in _plan(df).splitlines() if "hashpartitioning(qid" in x and "unit#" in x]


def test_rankings_of_questions_make_no_index(spark, monkeypatch):
    from skein.operators import postings
    from skein.plans import ranking

    monkeypatch.setattr(postings, "build", None)
    docs = spark.createDataFrame([(k, f"common w{k % 5}", "en") for k in range(30)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "w1"), (2, "w2 common")], "item_id long, text string")
    vectors = spark.createDataFrame([(k, [k / 10, 1.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert ranking.hybrid_fusion(docs, asked, vectors).where("qid = 1").count() == 6 + 4


def test_blocks_are_bounded_and_scored_where_they_are(spark):
    from skein.operators import postings

    docs = spark.createDataFrame([(k, f"common w{k % 5} w{k % 7}") for k in range(90)], "id long, text string")
    asked = spark.createDataFrame([(1, "common w1"), (2, "w2 w6 common common")], "qid long, text string")
    index = postings.build(docs, "id")
    most, wanted = postings.bounded(index, asked, "qid")
    for df in (most, postings.scored(index, most, wanted), postings.best(index, asked, "qid", 3)):
        assert not [x for x in _plan(df).splitlines() if "hashpartitioning(qid" in x and ("id#" in x.split("qid#", 1)[1] or "block#" in x)]
    assert postings.best(index, asked, "qid", 3).count() == 6
