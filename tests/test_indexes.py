"""Stored indexes give the rows of the operators that read everything."""

import re

import numpy as np
import pytest

from tomeforge.operators import indexes, retrieval


def test_stored_postings_equal_bm25(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a a"), (3, None), (4, ""), (5, "b c d e e e"), (6, "a b")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "e e z"), (3, ""), (4, "d")], "query_id int, query string")
    indexes.build_postings(docs, str(tmp_path / "p"))
    got, want = indexes.search_postings(queries, str(tmp_path / "p"), 3), retrieval.bm25(queries, docs, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    one = indexes.search_postings(queries.where("query_id = 4"), str(tmp_path / "p"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|=)", plan)) == 2  # of words and postings the bucket of its word alone
    indexes.build_postings(docs.limit(0), str(tmp_path / "none"))
    assert indexes.search_postings(queries, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [16])
def test_cells_find_neighbours_and_read_little(spark, tmp_path, size):
    """On vectors with clusters: nine of ten exact neighbours from a tenth of the vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, size)) * 4
    data = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, size))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id int, embedding array<float>")
    queries = vectors.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding")
    path = str(tmp_path / "v")
    indexes.build_cells(vectors, path, cells=64)
    assert spark.read.parquet(f"{path}/codes").count() == 6000
    share = indexes.read_share(queries, path, 4).first().share
    found = {(r.query_id, r.vec_id): r.similarity for r in indexes.search_cells(queries, path, k=10, probes=4).collect()}
    exact = {(r.query_id, r.vec_id): r.similarity for r in retrieval.knn(queries, vectors, 10).collect()}
    recall = len(found.keys() & exact.keys()) / len(exact)
    assert recall >= 0.9 and share <= 0.1, (recall, share)
    assert all(abs(found[x] - exact[x]) < 1e-6 for x in found.keys() & exact.keys())
    all_cells = indexes.search_cells(queries, path, k=10, probes=64, again=20).collect()
    assert len({(r.query_id, r.vec_id) for r in all_cells} & exact.keys()) >= 0.99 * len(exact)
