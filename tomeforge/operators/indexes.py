"""Stored indexes: postings of words, and cells of vectors with residual codes, each built once and read in part."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vector import squared_distance
from . import tiles
from .common import first_by, small
from .retrieval import B, FLOOR, K1, bm25_ranks

#: Folders that postings are dealt to by a hash of the word; a search reads those of its words.
BUCKETS = 64
#: Vectors of the sample for each cell.
SAMPLE = 256
#: Tasks that the postings of a bucket are dealt to, so that no frequent word lies with one.
PARTS = 8


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_postings(docs: DataFrame, path: str) -> None:
    """Write the postings (bucket, term, doc_id, tf, dl) of docs (doc_id, text), sorted by word in each bucket, the words' idf, and one row for all.

    Each document is read once for its words; counts of words come from the postings.
    Null texts are no documents, empty ones have no words.
    """
    spark = docs.sparkSession
    words = docs.where("text is not null").select("doc_id", tiles.counted_words(tokens(F.col("text"))).alias("words"))
    lengths = docs.where("text is not null").select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.sum("dl").alias("length"))
    rows = words.select("doc_id", F.inline("words")).where("term is not null").select("doc_id", "dl", "term", "tf", _bucket("term").alias("bucket"))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    whole = lengths.select("n", (F.greatest("length", F.lit(1)) / F.nullif("n", F.lit(0))).alias("avgdl"))
    idf = stored.groupBy("bucket", "term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole.select("n")))  # one row
    idf = idf.select("bucket", "term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    idf.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/words")
    mean = spark.read.schema(idf.schema).parquet(f"{path}/words").agg(F.coalesce(F.avg("idf"), F.lit(0.0)).alias("mean"))
    whole.crossJoin(F.broadcast(mean)).write.parquet(f"{path}/whole")  # one row


def search_postings(queries: DataFrame, path: str, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the rows of ``retrieval.bm25`` from stored postings, of which the buckets of the queries' words are read."""
    spark = queries.sparkSession
    whole = spark.read.parquet(f"{path}/whole").first()
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).withColumn("bucket", _bucket("term"))
    if not whole or not whole.n:
        return asked.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
    words, postings = (spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(buckets or [-1])) for name in ("words", "postings"))
    idf = F.when(F.col("idf") < 0, FLOOR * whole.mean).otherwise(F.col("idf"))
    weights = asked.join(words, ["bucket", "term"]).select("query_id", "term", (F.col("times") * idf).alias("weight"))
    found = postings.join(small(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    return bm25_ranks(tiles.bm25_scores(weights, found, k, whole.n, whole.avgdl, K1, B), k)


def fit_centres(vectors: DataFrame, cells: int, seed: int = 1) -> DataFrame:
    """(cell, centre): k-means over a sample of at most ``SAMPLE`` vectors a cell, the first by a hash of their id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(SAMPLE * cells)
    model = KMeans(k=cells, seed=seed, featuresCol="v").fit(sample.select(array_to_vector("embedding").alias("v")))
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")


def nearest_cells(centres: DataFrame, n: int) -> Callable[[Column], Column]:
    """A column function: the ``n`` nearest cells of a vector, nearest first. Centres go along as one matrix, cells x components."""
    rows = centres.orderBy("cell").collect()  # as many as cells
    shared = centres.sparkSession.sparkContext.broadcast(np.array([r.centre for r in rows]))

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matrix = shared.value
        squares = (matrix**2).sum(axis=1)
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            order = np.argsort(squares - 2 * flat @ matrix.T, axis=1, kind="stable")[:, :n]
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel(), pa.int32()))

    return F.arrow_udf(found, "array<int>")


def build_cells(vectors: DataFrame, path: str, cells: int = 64, seed: int = 1) -> None:
    """Write the cells of vectors (vec_id, embedding): centres, codes and the vectors, the last two in a folder for each cell.

    A code is what the vector has beyond its centre, in 127ths of its largest component,
    with the square of its length. Vectors are all of one length and not null.
    """
    spark = vectors.sparkSession
    fit_centres(vectors, cells, seed).write.parquet(f"{path}/centres")
    centres = spark.read.parquet(f"{path}/centres")
    placed = vectors.select("vec_id", "embedding").withColumn("cell", nearest_cells(centres, 1)(F.col("embedding"))[0])
    placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/vectors")  # a large cell is dealt to eight tasks
    rest = spark.read.parquet(f"{path}/vectors").join(F.broadcast(centres), "cell")  # as many rows as cells
    rest = rest.withColumn("beyond", F.zip_with("embedding", "centre", lambda a, b: a.cast("double") - b))
    scale = F.greatest(F.array_max(F.transform("beyond", lambda x: F.abs(x))), F.lit(1e-30)) / 127
    rest = rest.withColumn("scale", scale).withColumn("code", F.transform("beyond", lambda x: F.round(x / F.col("scale")).cast("tinyint")))
    square = F.col("scale") * F.col("scale") * F.aggregate("code", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    rest.select("cell", "vec_id", "code", "scale", square.alias("square")).write.partitionBy("cell").parquet(f"{path}/codes")


def probed(queries: DataFrame, path: str, probes: int) -> DataFrame:
    """(query_id, q, cell, beyond): the nearest cells of each query, and what it has beyond their centres."""
    centres = queries.sparkSession.read.parquet(f"{path}/centres")
    asked = queries.select("query_id", F.col("embedding").alias("q")).withColumn("cell", F.explode(nearest_cells(centres, probes)(F.col("q"))))
    return asked.join(F.broadcast(centres), "cell").select("query_id", "q", "cell", F.zip_with("q", "centre", lambda a, b: a.cast("double") - b).alias("beyond"))


def search_cells(queries: DataFrame, path: str, k: int = 10, probes: int = 4, again: int = 4) -> DataFrame:
    """(query_id, vec_id, similarity, rank): approximate nearest vectors, as ``retrieval.knn`` ranks them.

    Codes of the ``probes`` nearest cells give distances; the best ``again`` * k of each
    query are compared exactly by their vectors, read from these cells alone.
    """
    spark = queries.sparkSession
    asked = probed(queries, path, probes)
    codes = spark.read.parquet(f"{path}/codes").select("cell", F.col("vec_id").alias("id"), "code", "scale", "square")
    size = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    cells = spark.read.parquet(f"{path}/centres").count()
    rough = tiles.nearest(asked.select("cell", "query_id", "beyond"), codes, tiles.Coded, again * k, 64 + 8 * size, codes.count(), cells)
    best = first_by(rough, ["query_id"], F.col("place"), F.col("id"), n=again * k).select("query_id", "cell", F.col("id").alias("vec_id"))
    best = best.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    exact = best.join(spark.read.parquet(f"{path}/vectors"), ["cell", "vec_id"]).select("query_id", "vec_id", F.round(squared_distance(F.col("q"), F.col("embedding")), 6).alias("d"))
    ranked = first_by(exact, ["query_id"], F.col("d"), F.col("vec_id"), n=k, rank="rank")
    return ranked.select("query_id", "vec_id", F.round(1 / (1 + F.col("d")), 6).alias("similarity"), "rank")


def read_share(queries: DataFrame, path: str, probes: int) -> DataFrame:
    """One row, ``share``: of all vectors, those whose codes a query reads, on average."""
    sizes = queries.sparkSession.read.parquet(f"{path}/codes").groupBy("cell").agg(F.count("*").alias("n"))
    read = probed(queries, path, probes).select("query_id", "cell").join(sizes, "cell", "left").groupBy("query_id").agg(F.sum("n").alias("n"))
    return read.agg(F.avg("n").alias("n")).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all")))).select((F.col("n") / F.col("all")).alias("share"))  # one row each
