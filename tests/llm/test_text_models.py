import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from tomeforge.llm import langid, toxicity
from tomeforge.llm.common import id_hash

SF = "/root/testdata/sf0.01"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def part(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def plain_posteriors(emit, trans):
    """Forward-backward word by word."""
    n, k = emit.shape
    ahead, behind = np.empty((n, k)), np.ones((n, k))
    state = np.full(k, 1 / k)
    for t in range(n):
        state = (state @ trans) * emit[t]
        ahead[t] = state = state / state.sum()
    for t in range(n - 2, -1, -1):
        behind[t] = trans @ (emit[t + 1] * behind[t + 1])
        behind[t] /= behind[t].sum()
    found = ahead * behind
    return found / found.sum(axis=1, keepdims=True)


def test_posteriors_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    lengths, k = np.array([1, 5, 31, 32, 33, 64, 100, 1, 200, 2000]), 3
    emit, trans = rng.random((lengths.sum(), k)) + 0.01, rng.random((k, k)) + 0.1
    got, at = langid.posteriors(emit, lengths, trans), 0
    for n in lengths:
        e = emit[at : at + n]
        paths = {(): 1.0}
        if n <= 5:  # by listing all paths
            start = np.full(k, 1 / k) @ trans
            for t in range(n):
                paths = {(*p, s): w * (trans[p[-1], s] if p else start[s]) * e[t, s] for p, w in paths.items() for s in range(k)}
            want = np.array([[sum(w for p, w in paths.items() if p[t] == s) for s in range(k)] for t in range(n)])
            assert np.allclose(want / want.sum(axis=1, keepdims=True), got[at : at + n])
        assert np.allclose(got[at : at + n], plain_posteriors(e, trans), atol=1e-12)
        at += n


def test_language_held_out_accuracy_and_code_switching():
    docs = rows("documents")
    train = [d for d in docs if part(d["doc_id"], 4) != 2 and len(d["text"]) <= langid.MAX_CHARS][:350]
    model = langid.fit([d["text"] for d in train], [d["lang"] for d in train], rounds=40)
    tagger = langid.Tagger(model)
    held = [d for d in docs if part(d["doc_id"], 4) == 2]
    found = tagger.predict([d["text"] for d in held])
    assert np.mean([a == d["lang"] for (a, _), d in zip(found, held)]) > 0.97
    switched = ("the and of that with this " * 5 + "der die und nicht eine von " * 5).split()
    words = tagger.words([switched])[0].argmax(axis=1)
    assert model.langs[words[2]] == "en" and model.langs[words[-3]] == "de"


def test_language_features_and_lexicon():
    lexicon = langid.lexicons(["Le chat", "le chien", "der Hund", "der Mann le", "der"], [1, 1, 0, 0, 0])
    assert lexicon == {"le": [1], "der": [0]}
    owner, feature = langid.hashed_features(["le", "x"], lexicon)
    assert [(o, f - (1 << langid.BUCKET_BITS)) for o, f in zip(owner.tolist(), feature.tolist()) if f >= 1 << langid.BUCKET_BITS] == [(0, 1)]
    # "<le>": 3 pairs, 2 threes, the affixes "<le>" of four once; "<x>": 2 pairs, 1 three
    assert np.bincount(owner).tolist() == [1 + 3 + 2 + 1, 3]


def test_language_query(spark):
    """Held-out accuracy of the whole query, and its rows by the model alone."""
    docs = rows("documents")
    got = {r.doc_id: r for r in langid.op2_language_id(spark, SF).collect()}
    assert len(got) == len(docs) and all(r.held_out == (part(i, 4) == 2) for i, r in got.items())
    held = [d for d in docs if part(d["doc_id"], 4) == 2 and d["lang"]]
    assert np.mean([got[d["doc_id"]].lang_pred == d["lang"] for d in held]) >= 0.99
    table = spark.read.parquet(f"{SF}/documents.parquet")
    tagger = langid.Tagger(langid.train(table, id_hash() % 4 != 2))
    for d, (lang, score) in zip(docs, tagger.predict([d["text"] for d in docs])):
        assert got[d["doc_id"]].lang_pred == lang and abs(got[d["doc_id"]].score - score) < 1e-6


def test_language_train_with_repeated_ids(spark):
    many = [(1, f"the and of number {w}", "en") for w in "abcdefghij" * 40] + [(2, "der die das und", "de"), (3, None, "de"), (None, "el los que", "es")]
    model = langid.train(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "es"] or model.langs == ["de", "en"]


def test_language_edge_cases(spark):
    model = langid.fit(["the and of"] * 3, ["en"] * 3, rounds=2)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 ²", "x"), (4, "the " * 5000 + "q" * 3000, "x"), (4, "the", "x")], "doc_id long, text string, lang_pred string")
    got = {(r.doc_id, (r.text or "")[:5]): (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert [got[k][0] for k in sorted(got)] == ["und", "und", "und", "en", "en"]
    assert langid.predict(df.limit(0), model).count() == 0
    empty = langid.train(df.limit(0).withColumnRenamed("lang_pred", "lang"))
    assert langid.Tagger(empty).predict(["abc"])[0][0] == "und"


def test_toxicity_held_out(spark):
    texts = {d["doc_id"]: d["text"] for d in rows("documents")}
    labels = {x["doc_id"]: x["toxic"] for x in rows("labels")}
    train = [i for i in labels if part(i, 3) != 1]
    model = toxicity.fit([texts[i] for i in train], [labels[i] for i in train])
    score = model.scorer()
    held = [i for i in labels if part(i, 3) == 1]
    toxic, clean = ([score(texts[i]) for i in held if labels[i] == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.8  # pairwise AUC on a very small training set
    assert np.mean(np.array(clean) >= toxicity.THRESHOLD) < 0.03
    long = "idiot " * 100_000
    assert score(long) > score("") and score(None) == score("")
    text = "Good day, you " + "é idiot 日本 " * 200
    whole = score(text)
    for piece in (5, 64, 1000):  # pieces add no n-gram and lose none
        toxicity.PIECE = piece
        assert score(text) == whole
    toxicity.PIECE = 1 << 18


def test_toxicity_score_by_hand():
    """The score is the logistic of the bias and the weights of the text's distinct n-grams."""
    model = toxicity.fit(["you idiot", "an idiot", "good day", "fine day"], [1, 1, 0, 0])
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    for text in ("idiot day", "", "aaaa"):
        line = f" {text} "
        grams = {line[k : k + n] for n in (3, 4, 5) for k in range(len(line) - n + 1)}
        buckets = {int(b) for g in grams for b in toxicity.ngram_buckets(np.array([ord(c) for c in g], np.uint32))}
        z = model.bias + sum(weight.get(b, 0) for b in buckets)
        assert abs(model.scorer()(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_query(spark):
    docs, labels = rows("documents"), {x["doc_id"]: x["toxic"] for x in rows("labels")}
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    score = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"), id_hash() % 3 != 1).scorer()
    for d in docs:
        r = got.pop(d["doc_id"])
        assert r.held_out == (part(d["doc_id"], 3) == 1) and r.score == score(d["text"]) and r.predicted == int(r.score >= 0.7)
    assert not got


def test_toxicity_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot", "a"), (2, "good day", "b"), (2, "good day", "b"), (3, None, None), (None, "", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_toxicity_of_repeated_and_conflicting_labels(spark):
    """Any number of copies of a label or document changes nothing; of conflicting labels the toxic one counts."""
    texts = {k: f"you stupid idiot number {k}" if k % 4 == 0 else f"a fine day in the garden number {k}" for k in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in texts], "doc_id long, toxic int")
    many = labels.unionByName(spark.createDataFrame([(0, 1)] * 4000 + [(4, 0), (None, 1)], "doc_id long, toxic int"))
    copies = docs.unionByName(spark.createDataFrame([(1, texts[1])] * 4000, "doc_id long, text string"))
    one, other = toxicity.train(docs, labels), toxicity.train(copies, many)
    assert (one.buckets == other.buckets).all() and (one.weights == other.weights).all() and one.bias == other.bias
    assert other.scorer()("you stupid idiot") > toxicity.THRESHOLD > other.scorer()("a fine day")


def test_queries_on_held_out_rows(spark):
    """Both classifiers against rows that they did not learn from, at ten times the documents of the other tests.

    About half of the labels there mark texts without a single insult as toxic, so those with one count as found or missed.
    """
    large = "/root/testdata/sf0.1"
    docs = {x["doc_id"]: x for x in pq.read_table(f"{large}/documents.parquet", columns=["doc_id", "lang", "text"]).to_pylist()}
    toxic = {x["doc_id"]: x["toxic"] for x in pq.read_table(f"{large}/labels.parquet").to_pylist()}
    insult = re.compile(r"idiot|moron|loser|pathetic|worthless|stupid", re.I)
    rows_ = [r for r in toxicity.op6_toxicity(spark, large).collect() if r.held_out and r.doc_id in toxic]
    bad = [r.predicted for r in rows_ if toxic[r.doc_id] == 1 and insult.search(docs[r.doc_id]["text"])]
    good = [r.predicted for r in rows_ if toxic[r.doc_id] == 0]
    assert len(bad) > 50 and np.mean(bad) > 0.9 and np.mean(good) < 0.01
    found = [(r.lang_pred, docs[r.doc_id]["lang"]) for r in langid.op2_language_id(spark, large).collect() if r.held_out and docs[r.doc_id]["lang"] and len(docs[r.doc_id]["text"] or "") > 20]
    assert len(found) > 1000 and np.mean([a == b for a, b in found]) > 0.97
