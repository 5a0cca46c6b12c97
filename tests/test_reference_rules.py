"""Rules that have to hold exactly: contradictions, budgets with exempt facts, words within words; against plain Python."""

import random
import re

from skein import vocab
from skein.operators import facts, injection, routing

STOP = set(vocab.CONTRADICTION_STOP)


def evidence(text):
    return set(re.sub(r"[^\w\s-]", "", text.lower()).split()) - STOP


def test_contradictions_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "node-7", "it's", "x_y", "the", "was", "rolled-back", "Broken!", "offline", "épée", "rack", "disk", "cache", "a"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(16)))
    new = [(k, rng.choice("ab"), text()) for k in range(60)] + [(900, "a", None), (901, "a", "")]
    old = [(k, rng.choice("ab"), text()) for k in range(80)] + [(900, "a", None), (901, None, text())]
    want = {}
    for i, domain, t in new:
        hits = [j for j, d, u in old if d == domain and t and u and len(evidence(t) & evidence(u)) >= 5 and bool(evidence(t) & set(vocab.NEGATIONS)) != bool(evidence(u) & set(vocab.NEGATIONS))]
        if hits:
            want[i] = (min(hits), len(hits))
    schema = "id long, domain string, text string"
    got = facts.contradictions(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()
    assert want and {r["new_id"]: (r["conflict_with"], r["conflicts"]) for r in got} == want


def test_hyphens_make_one_word(spark):
    rows = lambda *texts: spark.createDataFrame([(k, "d", t) for k, t in enumerate(texts)], "id long, domain string, text string")
    plain = "the ingest worker of cluster seven writes parquet files nightly"
    assert facts.contradictions(rows(plain + " was rolled-back today"), rows(plain)).count() == 1
    assert facts.contradictions(rows(plain + " was rolled back today"), rows(plain)).count() == 0


def plain_inject(rows, budget, most=vocab.INJECT_ROWS, least=vocab.INJECT_LEAST_PRIORITY):
    """rows of one task: (id, score, tokens, digest, young)."""
    left, seen, out = budget, set(), []
    for i, score, tokens, digest, young in sorted(rows, key=lambda r: (-r[1] / r[2], r[0])):
        if not young and (tokens > left or score <= 0 or score / tokens < least):
            continue
        if digest in seen:
            continue
        seen.add(digest)
        out.append((i, tokens))
        left -= tokens
        if left <= 0 and not young or len(out) >= most:
            break
    return out


def test_inject_equals_the_plain_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for q in range(60):
        own = []
        for k in range(rng.randrange(40)):
            digest = rng.randrange(25)
            tokens = 1 + (digest * 37 + q) % rng.choice([30, 60])
            own.append((q * 1000 + k, round(rng.uniform(-1, 20), 3), tokens, f"d{digest}", rng.random() < 0.15))
        rows += [(q, *r) for r in own]
        want[q] = [(n, *x) for n, x in enumerate(plain_inject(own, 100), 1)]
    df = spark.createDataFrame(rows, "qid long, id long, score double, tokens long, digest string, young boolean")
    got = {q: [] for q in want}
    for r in injection.inject(df, 100, bootstrap="young").orderBy("qid", "place").collect():
        got[r["qid"]].append((r["place"], r["id"], r["tokens"]))
    assert got == want
    assert injection.inject(df, 100, used=100).count() == 0
    exempt = spark.createDataFrame([(1, 1, 5.0, 3000, "a", True), (1, 2, 9.0, 100, "b", False)], df.schema)
    assert sorted(r["id"] for r in injection.inject(exempt, 2000, bootstrap="young").collect()) == [1, 2]


def test_terms_stand_anywhere_in_words(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms, words = {make(rng.randrange(4, 7)) for _ in range(40)}, {make(rng.randrange(1, 30)) for _ in range(200)}
    got = routing.holders_of(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {tuple(r) for r in got} == {(t, w) for t in terms for w in words if t in w} and len(got) == len({tuple(r) for r in got})
