"""Exact top-k search by inner product, in tiles.

The queries go in blocks of bounded size to all tasks, a pass over the vectors for each
block. A task takes its shard of the vectors batch by batch: each tile is a matrix
product of up to ``TILE`` queries and a batch, of which only what can still enter a
query's list is selected. The lists of all shards are merged in a tree of ``FAN``
lists a node. Products are exact: of whole numbers in doubles where no sum can leave
their exact range, else of Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, shared_dir, small_batches, table

K, SCALE, TILE, FAN = 10, 1024, 1024, 16
#: Bytes of the queries of a block, which all tasks hold.
BLOCK_BYTES = 16 << 20
LISTS = "slot int, query_id long, copies long, own long, part int, best array<struct<place: long, nameless: boolean, vec_id: long>>"


def whole_numbers(vectors: pa.Array, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of floor(scale * x)) for each number of components; null vectors and those with null or non-finite ones are left out."""
    lists = vectors.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)  # nulls as NaN
    ends = np.cumsum(np.maximum(lengths, 0))
    starts = ends - np.maximum(lengths, 0)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = (lengths >= 0) & (odd[ends] == odd[starts])
    for size in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == size))
        yield rows, np.floor(flat[starts[rows][:, None] + np.arange(size)] * scale)


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of whole numbers in a type in which their products are exact."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return a, b
    as_int = np.vectorize(int, otypes=[object])
    return (as_int(a) if a.size else a), (as_int(b) if b.size else b)


def longs(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; what does not fit fails."""
    return scores.astype(np.int64)  # of Python's integers, those that are too large raise OverflowError


class Lists:
    """The best (score, id) so far of each query of one tile, higher scores first, then smaller ids, then rows without id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.used = np.zeros(len(queries), np.int64)
        self.scores, self.ids = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k), np.int64)
        self.nameless = np.zeros((len(queries), k), bool)

    def add(self, vectors: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        """Meet vectors, which are in the order of their ids."""
        a, b = exact(self.queries, vectors)
        scores = a @ b.T
        scores = longs(scores) if scores.dtype == object else scores
        row, column = self._select(scores)
        if not len(row):
            return
        old, place = np.nonzero(np.arange(self.k) < self.used[:, None])
        touched = np.zeros(len(self.queries), bool)
        touched[row] = True
        old, place = old[touched[old]], place[touched[old]]
        query = np.concatenate([old, row])
        score = np.concatenate([self.scores[old, place], longs(scores[row, column])])
        name = np.concatenate([self.ids[old, place], ids[column]])
        lost = np.concatenate([self.nameless[old, place], nameless[column]])
        order = np.lexsort((name, lost, ~score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, rank = order[rank < self.k], query[rank < self.k], rank[rank < self.k]
        self.scores[query, rank], self.ids[query, rank], self.nameless[query, rank] = score[order], name[order], lost[order]
        self.used[touched] = np.bincount(query, minlength=len(self.used))[touched]

    def _select(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of what may enter the lists, at most k of each row; of equal scores the first columns."""
        k, full = self.k, self.used == self.k
        least = np.where(full, self.scores[:, -1], np.iinfo(np.int64).min)
        keep = scores >= least[:, None]
        many = np.flatnonzero(keep.sum(axis=1) > k)
        if len(many):
            some = scores[many]
            bound = np.partition(some, some.shape[1] - k, axis=1)[:, -k][:, None]
            above, ties = some > bound, some == bound
            room = k - above.sum(axis=1, keepdims=True)
            keep[many] = above | ties & (np.cumsum(ties, axis=1) <= room)
        return np.nonzero(keep)

    def arrays(self) -> pa.Array:
        """The lists as arrays of (inverted score, whether the row has no id, id), so that they sort upwards."""
        filled = np.arange(self.k) < self.used[:, None]
        lost = self.nameless[filled]
        entries = [pa.array(~self.scores[filled]), pa.array(lost), pa.array(self.ids[filled], mask=lost)]
        values = pa.StructArray.from_arrays(entries, ["place", "nameless", "vec_id"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.used)]), pa.int32()), values)


def shard_lists(vectors: DataFrame, block: pa.Table, k: int, scale: int, own: bool) -> DataFrame:
    """The best k of each shard (partition) of ``vectors`` for each query of a block (query_id, embedding, copies): ``LISTS``."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)  # of bounded size

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, part = shared.value, TaskContext.get().partitionId()
        tiles: dict[int, list[tuple[np.ndarray, Lists]]] = {}
        for slots, matrix in whole_numbers(queries["embedding"].combine_chunks(), scale):
            tiles[matrix.shape[1]] = [(slots[at : at + TILE], Lists(matrix[at : at + TILE], k)) for at in range(0, len(slots), TILE)]
        for batch in batches:
            nameless = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column(0), 0).to_numpy()
            for rows, matrix in whole_numbers(batch.column(1), scale):
                order = np.lexsort((ids[rows], nameless[rows]))
                rows, matrix = rows[order], matrix[order]
                for _, lists in tiles.get(matrix.shape[1], []):
                    lists.add(matrix, ids[rows], nameless[rows])
        for slots, lists in (tile for some in tiles.values() for tile in some):
            a, b = exact(lists.queries, lists.queries)
            asked, itself = queries.take(slots), longs((a * b).sum(axis=1)) if own else np.zeros(len(slots), np.int64)
            columns = [pa.array(slots, pa.int32()), *[asked[c].combine_chunks() for c in ("query_id", "copies")], pa.array(itself, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(slots), part), pa.int32()), lists.arrays()], ["slot", "query_id", "copies", "own", "part", "best"])

    return vectors.mapInArrow(met, LISTS)


def tree_merged(lists: DataFrame, k: int, shards: int) -> DataFrame:
    """The best k of each query: lists of ``FAN`` shards become one, level by level."""
    while True:
        best = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k)
        shards = -(-shards // FAN)
        lists = lists.groupBy("slot", "query_id", "copies", "own", F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(best.alias("best"))
        if shards <= 1:
            return lists


def search(queries: DataFrame, vectors: DataFrame, k: int = K, scale: int = SCALE, own: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors, of floor(scale * x).

    Both tables have ``vec_id`` and ``embedding``; other columns play no part. Ties go
    to the smaller vec_id, rows without one come last among them. Vectors that are
    null or hold null or non-finite components are left out, on either side; a query
    meets vectors of as many components as it has. ``own``: the queries are rows of
    ``vectors``, and each leaves out its own row, but not others that share its id.
    Queries that are there more than once are asked once and answered as often; a
    query with fewer than k vectors gets all. Empty tables give no rows, and a product
    beyond 64 bits, with ``own`` also that of a query and itself, fails the job. Blocks
    of queries are written, so that a lost executor costs no more than its block's tasks.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    k_found = k + own
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding").where("embedding is not null").groupBy("query_id", "embedding").agg(F.count("*").alias("copies"))
    path = shared_dir(spark)
    shards = vectors.rdd.getNumPartitions()
    with scratch(spark):
        asked = materialize(asked.withColumn("deal", F.xxhash64("query_id", "embedding")))
        size = asked.agg(F.sum(8 * F.size("embedding") + 32)).first()[0] or 0
        blocks = -(-size // block_bytes)
        for number in range(blocks):
            block = asked.where(F.pmod("deal", F.lit(blocks)) == number).drop("deal").toArrow()
            lists = shard_lists(vectors, block, k_found, scale, own)
            tree_merged(lists, k_found, shards).select("query_id", "copies", "own", "best").write.mode("append").parquet(path)
    schema = "query_id long, copies long, own long, best array<struct<place: long, nameless: boolean, vec_id: long>>"
    found = spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
    best = F.col("best")
    if own:
        itself = F.struct(F.bitwise_not("own").alias("place"), F.lit(False).alias("nameless"), F.col("query_id").alias("vec_id"))
        at = F.array_position(best, itself)
        best = F.when(at > 0, F.concat(F.slice(best, F.lit(1), at - 1), F.slice(best, at + 1, F.lit(k_found)))).otherwise(F.slice(best, 1, k))
    rows = found.select("query_id", "copies", F.posexplode(best).alias("rank", "hit"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", F.bitwise_not("hit.place").alias("score"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.where("vec_id % 100 = 0"), vectors, own=True)


QUERIES = {"op11_topk_search": op11_topk_search}
ORACLES = {
    "op11_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10
    """
}
