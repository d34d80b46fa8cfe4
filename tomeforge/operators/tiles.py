"""The best of all pairs of two tables, in tiles: blocks of rows meet tiles of queries, and a task keeps the best of each query.

Rows and queries are packed by Spark, so that a pair of a block and a tile is one row of
a join and one matrix product. What a product shows to be among the best is computed
again in a fixed order, so that equal rows have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Queries of a tile, rows of a block of vectors, documents of a block, and words of a tile's queries.
TILE, ROWS, DOCS, WORDS = 1024, 1024, 256, 16384
#: Pairs of words, and of documents and queries, that are held at once.
PAIRS = 1 << 21
#: Scores are ranked when rounded to six places: what may round to the same stays.
ROUNDING = 1.1e-6


def packed(df: DataFrame, by: str, n: int, name: str, number: str, *keys: str) -> DataFrame:
    """(*keys, number, name): rows without ``keys`` as arrays, dealt to ``n`` of them by a hash of ``by``."""
    items = F.collect_list(F.struct(*[c for c in df.columns if c not in keys])).alias(name)
    return df.groupBy(*keys, F.pmod(F.xxhash64(by), F.lit(n)).cast("int").alias(number)).agg(items)


class Best:
    """The ``k`` smallest (place, id) of each query so far, and all that may round to the last one's place."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.bound = n, k, np.full(n, np.inf)
        self.query, self.place, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, query: np.ndarray, place: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is not None:
            query, place, ids = np.concatenate([self.query, query]), np.concatenate([self.place, place]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, place, query))
        query, place, ids = query[order], place[order], ids[order]
        at = np.arange(len(query))
        new = np.concatenate([[True], (query[1:] != query[:-1]) | (place[1:] != place[:-1])])[: len(query)]
        equal = at - np.maximum.accumulate(np.where(new, at, 0)) < self.k  # of equal places, the k smallest ids
        query, place, ids = query[equal], place[equal], ids[equal]
        full = np.flatnonzero(np.bincount(query, minlength=self.n) >= self.k)
        last = place[np.searchsorted(query, full) + self.k - 1]
        self.bound[full] = last + ROUNDING + 1e-14 * np.abs(last)
        keep = place <= self.bound[query]
        self.query, self.place, self.ids = query[keep], place[keep], ids[keep]

    def limits(self, rough: np.ndarray, slack: float) -> np.ndarray:
        """For each query the largest rough place (queries x rows) of what may be among its best."""
        bound = self.bound.copy()
        fresh = np.flatnonzero(np.isinf(bound))
        if len(fresh) and rough.shape[1] > self.k:
            bound[fresh] = np.partition(rough[fresh], self.k - 1, axis=1)[:, self.k - 1] + ROUNDING + slack
        return bound + slack


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def in_turn(products: Iterator[np.ndarray]) -> np.ndarray:
    """The sum, component after component, as a fold over arrays makes it."""
    return reduce(np.add, products)


class Distance:
    """Squared distance of queries (query_id, q) and rows (id, embedding)."""

    def __init__(self, q: pa.Array):
        self.q = matrix(q)
        self.squares = (self.q**2).sum(axis=1)

    def meet(self, embedding: pa.Array) -> None:
        self.v = matrix(embedding)
        squares = (self.v**2).sum(axis=1)
        self.rough = self.squares[:, None] + squares - 2 * self.q @ self.v.T
        self.slack = 1e-12 * (self.squares.max() + squares.max())

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return in_turn((self.q[i, c] - self.v[j, c]) ** 2 for c in range(self.q.shape[1]))


class Cosine:
    """Cosine of queries and rows, negative, so that the best is smallest; a zero vector has length 1."""

    def __init__(self, q: pa.Array):
        self.q = matrix(q)
        self.nq = self.length(self.q)

    @staticmethod
    def length(m: np.ndarray) -> np.ndarray:
        n = np.sqrt(in_turn(m[:, c] * m[:, c] for c in range(m.shape[1])))
        return np.where(n == 0, 1.0, n)

    def meet(self, embedding: pa.Array) -> None:
        self.v = matrix(embedding)
        self.nv = self.length(self.v)
        self.rough, self.slack = -(self.q @ self.v.T) / self.nq[:, None] / self.nv, 1e-12

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return -in_turn(self.q[i, c] * self.v[j, c] for c in range(self.q.shape[1])) / self.nq[i] / self.nv[j]


class Coded:
    """Squared distance of what queries have beyond a centre and coded rows (id, code, scale, square)."""

    def __init__(self, q: pa.Array):
        self.q = matrix(q)
        self.squares = in_turn(self.q[:, c] * self.q[:, c] for c in range(self.q.shape[1]))

    def meet(self, code: pa.Array, scale: pa.Array, square: pa.Array) -> None:
        self.v, self.scale, self.square = matrix(code), scale.to_numpy(), square.to_numpy()
        self.rough = self.square - 2 * self.scale * (self.q @ self.v.T) + self.squares[:, None]
        self.slack = 1e-12 * (self.squares.max() + self.square.max())

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.square[j] - 2 * self.scale[j] * in_turn(self.q[i, c] * self.v[j, c] for c in range(self.q.shape[1])) + self.squares[i]


class Bm25:
    """Scores of queries (query_id, words of (term, weight)) and documents, negative; documents without a word of a query are infinitely far.

    Only words that a document and a query share are multiplied, added in the order of the tile's terms.
    """

    slack = 0.0

    def __init__(self, words: pa.Array):
        term, weight = words.flatten().flatten()
        self.terms, self.n = pc.unique(term), len(words)
        at = pc.index_in(term, self.terms).to_numpy()
        order = np.argsort(at, kind="stable")
        self.query = np.repeat(np.arange(self.n), pc.list_value_length(words).to_numpy())[order]
        self.weight, self.asked = weight.to_numpy()[order], np.bincount(at, minlength=len(self.terms))
        self.start = np.cumsum(self.asked) - self.asked

    def meet(self, doc: np.ndarray, n: int, at: np.ndarray, part: np.ndarray) -> None:
        """Parts of words ``at`` of ``n`` documents."""
        times = self.asked[at]
        pair = np.repeat(self.start[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        key = self.query[pair] * n + np.repeat(doc, times)
        score = np.bincount(key, self.weight[pair] * np.repeat(part, times), self.n * n)
        score[np.bincount(key, minlength=self.n * n) == 0] = -np.inf
        self.rough = -score.reshape(self.n, n)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.rough[i, j]


def best_of(pairs: DataFrame, measure, met, k: int, query_type: str, id_type: str) -> DataFrame:
    """(query_id, id, place, cell): the best ``k`` in each partition of ``pairs`` (cell, tile, asked, rows), for each cell and query.

    ``met`` lets a measure meet the rows of a block in parts, and gives the ids of each.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                cell, tile = (batch.column(c)[row].as_py() for c in range(2))
                if (cell, tile) not in tiles:
                    ids, given = batch.column(2)[row].values.flatten()
                    tiles[cell, tile] = ids.take(pa.array(np.arange(len(ids)))), measure(given), Best(len(ids), k)
                _, scores, best = tiles[cell, tile]
                for ids in met(scores, batch.column(3)[row].values.flatten()):
                    i, j = np.nonzero((scores.rough <= best.limits(scores.rough, scores.slack)[:, None]) & np.isfinite(scores.rough))
                    if len(i):
                        best.add(i, scores.exact(i, j), ids[j])
        for (cell, _), (ids, _, best) in tiles.items():
            if best.ids is not None:
                columns = [ids.take(pa.array(best.query)), pa.array(best.ids), pa.array(best.place), pa.array(np.full(len(best.ids), cell), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "place", "cell"])

    return pairs.select("cell", "tile", "asked", "rows").mapInArrow(found, f"query_id {query_type}, id {id_type}, place double, cell int")


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def nearest(queries: DataFrame, rows: DataFrame, measure, k: int, row_bytes: int, n_rows: int, cells: int = 1) -> DataFrame:
    """(query_id, id, place, cell): candidates for the ``k`` best rows (id, and what the measure meets) of queries (query_id, q), by a task's share.

    The best by rounded place and id are among them. Tiles of queries go along in
    broadcast blocks, each a pass over ``n_rows`` rows. If both sides have a ``cell``, queries
    meet the rows of theirs alone, and the best are those of a cell.
    """

    def meet(scores, columns: list[pa.Array]) -> Iterator[np.ndarray]:
        for at in range(0, len(columns[0]), ROWS):
            ids, *given = [c.slice(at, ROWS) for c in columns]
            scores.meet(*given)
            yield ids.to_numpy(zero_copy_only=False)

    keys = ["cell"] if "cell" in rows.columns else []
    size = max(1, min(TILE, common.BROADCAST_BYTES // row_bytes))
    tiles = packed(queries, "query_id", -(-max(1, queries.count()) // (size * cells)), "asked", "tile", *keys)
    packs = packed(rows, "id", -(-max(1, n_rows) // (ROWS * cells)), "rows", "block", *keys).drop("block")
    parts = [packs.join(part, "cell") if keys else packs.crossJoin(part).withColumn("cell", F.lit(0)) for part in common.blocks(tiles, "tile", size * row_bytes)]
    return best_of(reduce(DataFrame.unionByName, parts), measure, meet, k, type_of(queries, "query_id"), type_of(rows, "id"))


def bm25_scores(weights: DataFrame, words: DataFrame, k: int, docs: int, avgdl: float, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score): candidates for the ``k`` best of ``docs`` documents for each query, by a task's share.

    ``weights`` (query_id, term, weight) are those of a stated query set, ``words`` (doc_id,
    dl, term, tf) the words of documents that it asks for. The best by rounded score and
    id are among the candidates.
    """

    def meet(scores, columns: list[pa.Array]) -> Iterator[np.ndarray]:
        doc_id, dl, term, tf = columns
        at = pc.index_in(term, scores.terms)
        here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        at = at.take(pa.array(here)).to_numpy()
        dl, tf = dl.to_numpy()[here], tf.to_numpy()[here]
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        ids, doc = np.unique(doc_id.to_numpy(zero_copy_only=False)[here], return_inverse=True)
        order = np.lexsort((at, doc))
        doc, at, part = doc[order], at[order], part[order]
        # as many documents at once as make PAIRS pairs of words, and of documents and queries
        ends = np.cumsum(np.bincount(doc, scores.asked[at], len(ids))) + scores.n * np.arange(1, len(ids) + 1)
        first = 0
        while first < len(ids):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            some = slice(*np.searchsorted(doc, [first, last]))
            scores.meet(doc[some] - first, last - first, at[some], part[some])
            yield ids[first:last]
            first = last

    asked = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("words"))
    n = weights.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    tiles = packed(asked, "query_id", max(1, -(-n.queries // TILE), -(-n.words // WORDS)), "asked", "tile")
    packs = packed(words.select("doc_id", "dl", "term", "tf"), "doc_id", -(-max(1, docs) // DOCS), "rows", "block").drop("block")
    parts = [packs.crossJoin(part).withColumn("cell", F.lit(0)) for part in common.blocks(tiles, "tile", WORDS * 64)]
    found = best_of(reduce(DataFrame.unionByName, parts), Bm25, meet, k, type_of(weights, "query_id"), type_of(words, "doc_id"))
    return found.select("query_id", F.col("id").alias("doc_id"), (-F.col("place")).alias("score"))


def counted_words(words: Column) -> Column:
    """(term, tf, dl) of each distinct word of an array with the number of all, and one with a null term; null for null.

    The length stands in each of them, so that rows made of them carry no array along.
    """

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy().astype(np.int64)
            coded = batch.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            key, n = np.unique(np.repeat(np.arange(len(batch)), lengths) * size + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(key, size)
            rows = np.flatnonzero(batch.is_valid().to_numpy(zero_copy_only=False))
            row = np.concatenate([row, rows])
            order = np.argsort(row, kind="stable")
            code = pa.array(np.concatenate([code, np.zeros(len(rows), np.int64)])[order], mask=np.arange(len(row))[order] >= len(key))
            tf = np.concatenate([n, np.zeros(len(rows), np.int64)])[order]
            items = pa.StructArray.from_arrays([coded.dictionary.take(code), pa.array(tf.astype(np.int32)), pa.array(lengths[row[order]].astype(np.int32))], ["term", "tf", "dl"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=batch.is_null())

    return F.arrow_udf(counted, "array<struct<term: string, tf: int, dl: int>>")(words)
