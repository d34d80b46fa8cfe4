"""Best pairs from tiles are those of all pairs, ties, copies and odd rows included, and no pair is shuffled that can't be among them."""

import math

import numpy as np
from pyspark.sql import functions as F

from tomeforge.operators import indexes, retrieval, tiles


def test_best_equals_sorting_all():
    rng = np.random.default_rng(5)
    query, place, ids = rng.integers(0, 7, 4000), rng.integers(0, 60, 4000) / 8, rng.permutation(4000)
    best = tiles.Best(7, 5)
    for at in range(0, 4000, 300):
        best.add(query[at : at + 300], place[at : at + 300], ids[at : at + 300])
    for q in range(7):
        want = sorted(zip(place[query == q], ids[query == q], strict=True))[:5]
        assert sorted(zip(best.place[best.query == q], best.ids[best.query == q], strict=True))[:5] == want
    assert len(best.ids) <= 7 * 10


def test_vectors_with_copies_and_odd_rows(spark, monkeypatch):
    """Copies tie by id over blocks and tiles; a vector without a distance comes last."""
    monkeypatch.setattr(tiles, "ROWS", 16)
    monkeypatch.setattr(tiles, "TILE", 3)
    rng = np.random.default_rng(2)
    data = [[1.0, 0.0, 0.5]] * 30 + rng.integers(-4, 4, (60, 3)).astype(float).tolist() + [[0.0, 0.0, 0.0], None, [1.0, None, 2.0], [1.0, 2.0]]
    vectors = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 9 = 0 AND vec_id < 91").selectExpr("vec_id AS query_id", "embedding")
    whole = [(k, v) for k, v in enumerate(data) if v and len(v) == 3 and None not in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    size = lambda a: math.sqrt(dot(a, a)) or 1.0
    near = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.knn(asked, vectors, 12).collect()}
    like = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.cosine_rank(asked, vectors, 12).collect()}
    for q, a in [(k, v) for k, v in whole if k % 9 == 0]:
        far = sorted((round(sum((x - y) ** 2 for x, y in zip(a, v, strict=True)), 6), k) for k, v in whole)
        cos = sorted((-round(dot(a, v) / size(a) / size(v), 6), k) for k, v in whole)
        assert [near[q, n] for n in range(1, 13)] == [k for _, k in far[:12]]
        assert [like[q, n] for n in range(1, 13)] == [k for _, k in cos[:12]]
    last = [r.vec_id for r in retrieval.knn(asked.where("query_id = 0"), vectors, 100).orderBy("rank").collect()]
    assert last[-3:] == [91, 92, 93] and len(last) == len(data)


def test_words_are_counted_once_a_document(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["b"])], "k int, w array<string>")
    got = rows.select("k", F.inline(tiles.counted_words(F.col("w")))).collect()
    assert sorted((r.k, r.term or "", r.tf, r.dl) for r in got) == [(1, "", 0, 3), (1, "a", 1, 3), (1, "b", 2, 3), (2, "", 0, 0), (4, "", 0, 1), (4, "b", 1, 1)]


def test_no_pair_of_document_and_query_is_shuffled(spark, tmp_path):
    """300 documents share a word with each of 40 queries: a task returns its best alone, with scores of all."""
    docs = spark.createDataFrame([(k, "x " * (k % 7 + 1) + "y" * (k % 3)) for k in range(300)], "doc_id int, text string").repartition(3)
    queries = spark.createDataFrame([(k, "x y" if k % 2 else "x yy zz") for k in range(40)], "query_id int, query string")
    indexes.build_postings(docs, str(tmp_path / "p"))
    rows = indexes.search_postings(queries, str(tmp_path / "p"), 4)
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 160
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    df = {w: sum(w in t for t in texts.values()) for w in ("x", "y", "yy")}
    idf = {w: math.log(300 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, avgdl = sum(idf.values()) / 3, sum(map(len, texts.values())) / 300
    part = lambda w, t: (idf[w] if idf[w] >= 0 else 0.25 * mean) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
    want = sorted((-round(sum(part(w, t) for w in ("x", "y") if w in t), 6), k) for k, t in texts.items())[:4]
    got = rows.where("query_id = 1").orderBy("rank").collect()
    assert [(-r.score, r.doc_id) for r in got] == want


def test_bm25_of_pairs_in_parts(spark, monkeypatch):
    """Odd ids, copies and queries in many tiles: the ranks are those of all pairs, which no join makes."""
    monkeypatch.setattr(tiles, "PAIRS", 64)
    monkeypatch.setattr(tiles, "DOCS", 16)
    monkeypatch.setattr(tiles, "TILE", 5)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9))) for _ in range(120)]
    data = [(None if k % 40 == 7 else f"d{k % 110}", t) for k, t in enumerate(texts)] + [("none", None)]
    queries = [(k, " ".join(rng.choice(list("abcdefghz"), 4))) for k in range(23)] + [(99, "")]
    docs, asked = spark.createDataFrame(data, "doc_id string, text string"), spark.createDataFrame(queries, "query_id int, query string")
    rows = retrieval.bm25(asked, docs, 6)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    words = [t.split() for t in texts]
    df = {w: sum(w in t for t in words) for t in words for w in t}
    n, avgdl = len(texts), sum(map(len, words)) / len(texts)  # a null text is no document
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    for q, query in queries:
        scores: dict = {}
        for (key, _), t in zip(data, words, strict=False):
            shared = [w for w in query.split() if w in t]
            if shared:
                scores.setdefault(key, []).append((len(t), shared, t))
        # rows of one id and one length count as one document
        total = {}
        for key, held in scores.items():
            tf: dict = {}
            for dl, shared, t in held:
                for w in set(shared):
                    tf[dl, w] = tf.get((dl, w), 0) + t.count(w)
            total[key] = sum(query.split().count(w) * (idf[w] if idf[w] >= 0 else 0.25 * mean) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * dl / avgdl)) for (dl, w), c in tf.items())
        want = sorted((-round(s, 6), key is not None, key or "") for key, s in total.items())[:6]
        got = [(-r.score, r.doc_id is not None, r.doc_id or "") for r in rows.where(F.col("query_id") == q).orderBy("rank").collect()]
        assert [g[1:] for g in got] == [w[1:] for w in want] and all(abs(g[0] - w[0]) < 2e-6 for g, w in zip(got, want, strict=True))
