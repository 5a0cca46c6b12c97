"""Built-in entities: the automaton against a scan by one pattern a kind, on random texts."""

import random
import re

from skein import vocab
from skein.operators import graph


def service_pattern():
    """All names as one alternation, with a look ahead after guarded ones."""
    names = [re.escape(n) + (rf"(?!\s+(?:{'|'.join(vocab.SERVICE_GUARDS[n])}))" if n in vocab.SERVICE_GUARDS else "") for n in vocab.SERVICES]
    return re.compile(rf"\b(?:{'|'.join(names)})\b", re.I)


def scan(body):
    out = {}
    for kind in vocab.ENTITY_KINDS:
        p = service_pattern() if kind == "service" else re.compile(vocab.ENTITY_FORMS[kind], re.I)
        for m in p.finditer(body):
            name = (next((g for g in m.groups() if g), "") if m.groups() else m[0]).lower().strip()
            if name and name not in vocab.ENTITY_STOP:
                out.setdefault((kind, vocab.ENTITY_ALIASES.get(name, name)), m.start())
    return [(f"{k}:{n}", place, at) for place, ((k, n), at) in enumerate(out.items(), 1)]


def texts(n=600):
    rng = random.Random(6)
    parts = [*vocab.SERVICES, "Grafana", "GRAFANA  Loki", "grafana alloys", "docker\thub", "docker hubs", "Docker", "postgreſ", "K3s", "in namespace the", "into namespace prod-1", "kubectl get pods -n web", "--namespace=x1", "k8s-r1-web-gpu-01", "a-b-c-01", "OOMKilled", "quorum loss", "CVE-2024-1234", "llama-3-70b", "pvc-1-2b", "İ", "é", "_", "-", ".", "\n", "x"]
    return [None, ""] + [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_built_in_mentions_equal_a_scan(spark):
    rows = list(enumerate(texts()))
    got = {}
    for r in graph.built_in_mentions(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", "text").orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["entity_id"], r["place"], r["first_at"]))
    assert got == {k: scan(t) for k, t in rows if t and scan(t)}


def test_all_names_are_found():
    automaton = graph.service_automaton(vocab.SERVICES)
    for name in vocab.SERVICES:
        assert graph.services_in(f"the {name.upper()}, x{name}", automaton) == [(4, name.upper())]


def test_mentions_need_no_exchange(spark):
    df = graph.mentions(spark.createDataFrame([(1, "a b a")], "id long, text string"), "id", "text", {"x": "[ab]"}, {"b": "a"}, ("c",))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["entity_id"], r["place"], r["first_at"]) for r in df.collect()] == [("x:a", 1, 0)]
