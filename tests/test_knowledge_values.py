"""Topics, weak labels, relations and properties by value."""

import math
import random
import re
from collections import Counter

import numpy as np

from tomeforge.functions.rules import PROPERTIES, STOP_WORDS
from tomeforge.operators import entities


def test_taxonomy_by_value(spark):
    """Members are with their nearest centre, the centre is the mean of their TF-IDF vectors, and terms are its strongest."""
    rnd = random.Random(1)
    topics = ["fire burn flame heat ash smoke".split(), "water wave deep sea salt tide".split(), "stone rock hill mine iron ore".split()]
    rows = [(f"n{k}", [" ".join(rnd.choices(topics[k % 3], k=12)), "de " + " ".join(rnd.choices(topics[k % 3], k=5))]) for k in range(36)]
    members, terms = entities.discover_taxonomy(spark.createDataFrame(rows, "name string, contexts array<string>"), k=3, features=1000)
    cluster = {r["name"]: r.cluster_id for r in members.collect()}
    assert len(set(cluster.values())) == 3 and all(cluster[f"n{k}"] == cluster[f"n{k % 3}"] for k in range(36))
    docs = {}
    for name, contexts in rows:
        kept = [w for w in " ".join(contexts).split() if w not in STOP_WORDS]
        docs[name] = Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])
    df = Counter(t for d in docs.values() for t in d)
    vocabulary = sorted(t for t, n in df.items() if 2 <= n <= 0.8 * 36)
    idf = {t: math.log(37 / (df[t] + 1)) for t in vocabulary}
    vectors = {n: np.array([d[t] * idf[t] for t in vocabulary]) for n, d in docs.items()}
    vectors = {n: v / np.linalg.norm(v) for n, v in vectors.items()}
    for r in terms.collect():
        centre = np.mean([v for n, v in vectors.items() if cluster[n] == r.cluster_id], axis=0)
        weight = dict(zip(vocabulary, centre))
        best = sorted(vocabulary, key=lambda t: -weight[t])[:10]
        assert np.allclose([weight[t] for t in r.terms], [weight[t] for t in best]) and len(set(r.terms)) == 10
    labels = {r.cluster_id: (r.label, r.terms) for r in entities.name_clusters(terms).collect()}
    assert all(labels[r.cluster_id] == ("_".join(r.terms[:3]), r.terms[:8]) for r in terms.collect())
    idle = spark.createDataFrame([(1, ["de", "a o"]), (2, ["de", "mar", "o sol", "de a", "ar"])], "cluster_id int, terms array<string>")
    assert [(r.cluster_id, r.label) for r in entities.name_clusters(idle).collect()] == [(2, "mar_o sol_ar")]


def test_weak_spans_by_loops(spark):
    """Terms and names, the longest first wherever they overlap."""
    rnd = random.Random(2)
    words = ["Goblin", "Rei", "goblin", "rei", "de", "Fogo", "fogo", "Bola", "é", "ROSA", "x"]
    docs = {k: " ".join(rnd.choices(words, k=rnd.randrange(0, 25))) for k in range(60)} | {99: None}
    terms = {"M": ["goblin rei", "goblin"], "S": ["bola de fogo", "fogo", "rei goblin"]}
    got = {}
    for r in entities.weak_spans(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), terms).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.label))
    patterns = [(k, re.compile("|".join(rf"\b{re.escape(t)}\b" for t in sorted(ts, key=len, reverse=True)), re.I)) for k, ts in terms.items()] + [("NAME", re.compile(entities.NAME))]
    overlaps = 0
    for k, text in docs.items():
        every = [(m.start(), m.end(), label) for label, p in patterns for m in p.finditer(text or "")]
        left, taken = list(every), []
        while left:
            best = max(left, key=lambda s: (s[1] - s[0], -s[0], -every.index(s)))
            taken.append(best)
            left = [s for s in left if s[1] <= best[0] or s[0] >= best[1]]
        overlaps += len(every) - len(taken)
        assert sorted(got.get(k, [])) == sorted(taken)
    assert overlaps > 50 and any(label == "NAME" for some in got.values() for *_, label in some)


def test_every_relation_pattern(spark):
    sides = [("is_a", "Goblin é um tipo de monstro."), ("is_a", "Orcs são criaturas."), ("cost_pm", "Raio custa 3 PM"), ("cost_pm", "Luz gasta 2 PM"), ("cost_pm", "custo: 5 PM"), ("requires", "Voo requer Magia 2."),
             ("requires", "Salto necessita Força."), ("school", "escola: Negra."), ("element", "elemento: fogo."), ("weakness", "Troll é fraco contra fogo."), ("effect", "Veneno causa dano."), ("effect", "Garra inflige dor.")]
    want = [("Goblin", "monstro"), ("Orcs", "criaturas"), ("Raio", "3"), ("Luz", "2"), ("e4", "5"), ("Voo", "Magia 2"), ("Salto", "Força"), ("e7", "Negra"), ("e8", "fogo"), ("Troll", "fogo"), ("Veneno", "dano"), ("Garra", "dor")]
    rows = spark.createDataFrame([(f"e{k}", [text]) for k, (_, text) in enumerate(sides)], "name string, contexts array<string>")
    found = {(r.src, r.relation, r.dst) for r in entities.extract_relations(rows).collect()}
    assert {(a, relation, b) for (relation, _), (a, b) in zip(sides, want)} <= found
    plus = spark.createDataFrame([("x", ["Voo necessita Magia+2."])], "name string, contexts array<string>")
    assert entities.extract_relations(plus).count() == 0  # a plus sign is no part of what is needed


def test_every_property_pattern(spark):
    samples = {
        "magia": {"cost_pm": "custa 3 PM", "school": "escola: Negra", "element": "elemento: fogo", "duration": "duração: um turno", "range": "alcance: longo", "damage": "causa 2d6 + 1 de"},
        "item": {"preco_pe": "vale 10 PE", "bonus": "bônus: +2"},
    }
    rows = [(f"{kind}{key}", kind, [text]) for kind, keys in samples.items() for key, text in keys.items()]
    found = {(r["name"], r.key): r.value for r in entities.infer_properties(spark.createDataFrame(rows, "name string, type string, contexts array<string>")).collect()}
    for kind, keys in samples.items():
        for key, text in keys.items():
            assert found[f"{kind}{key}", key] == re.search(PROPERTIES[kind][key], text)[1].strip()


def test_taxonomy_reads_texts_for_counts_and_vectors_alone(spark):
    """Nothing that holds words is kept in memory or read again by the fits: members come from written vectors."""
    rows = [(f"n{i}", ["fogo chama calor brasa" if i % 2 else "gelo neve frio vento"]) for i in range(40)] + [("one", ["rare"]), ("none", [])]
    members, terms = entities.discover_taxonomy(spark.createDataFrame(rows, "name string, contexts array<string>"), k=2)
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    assert "terms" not in plan and "contexts" not in plan
    got = {r.name: r.cluster_id for r in members.collect()}
    assert set(got) == {r[0] for r in rows[:-1]} and len({got[f"n{i}"] for i in range(0, 40, 2)}) == len({got[f"n{i}"] for i in range(1, 40, 2)}) == 1 and got["n0"] != got["n1"]
    assert {t for r in terms.collect() for t in r.terms} == {"fogo", "chama", "calor", "brasa", "fogo chama", "chama calor", "calor brasa", "gelo", "neve", "frio", "vento", "gelo neve", "neve frio", "frio vento"}
