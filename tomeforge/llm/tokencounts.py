"""Token counts of documents in flat token files that have no index.

A file is token ids of 16 bits, one after the other, an end-of-document id after
each document. Blocks of a file are searched apart; a prefix scan over the blocks
gives each its first document's number and the tokens that this document left in
earlier blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_batches, table, tiktoken_encoder, token_bytes
from .files import Committed, locate

END, BLOCK = 50256, 8 << 20


def write_flat(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Write the tokens of (doc_id, text) as one flat file for each partition; (file, ordinal, doc_id) of what was written.

    Null and empty texts give the end id alone. Partitions without rows write no file. An ``end`` that is an id of the
    rank file, or ids beyond 16 bits, fail the job.
    """
    import public_tokenizers

    small_batches(docs.sparkSession)
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = tiktoken_encoder(path, pattern), token_bytes(path, pattern)
        if end < len(known) and known[end].is_valid or max(end, len(known) - 1) >= 1 << 16:
            raise ValueError("the end id must be free, and all ids within 16 bits")
        name, ordinal = f"part-{TaskContext.get().partitionId():06d}.u16", 0
        file = Committed(folder, name)
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        with file as stream:
            while batch is not None:
                ends, ids = encoder(batch.column(1))
                stream.write(np.insert(ids, ends[1:], end).astype("<u2").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], ["file", "ordinal", "doc_id"])
                ordinal += n
                batch = next(batches, None)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "file string, ordinal long, doc_id long"))


def scan(spark: SparkSession, folder: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in the flat files below ``folder``.

    ``n_tokens`` leaves the end id out; tokens after the last end id are a document
    with ``ended`` false; ``block`` is in bytes and even. Empty files and folders
    without files give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.u16").load(folder).select("path", "length").where("length > 0")
    blocks = files.select("path", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("block", "offset"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number, offset in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                system, at = locate(path)
                with system.open_input_file(at) as file:
                    ids = np.frombuffer(file.read_at(block, offset), "<u2")
                ends = np.flatnonzero(ids == end)
                last = int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([last], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    ["path", "block", "n", "last", "ends"],
                )

    found = materialize(blocks.repartition("path", "block").mapInArrow(search, "path string, block int, n long, last long, ends array<long>"))
    order = Window.partitionBy("path").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("path", "block", "n", "last", F.size("ends").alias("docs"))
    slim = slim.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    slim = slim.select(
        "path",
        "block",
        "base",
        F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("before"),
        (F.coalesce(F.max(F.col("base") + F.col("last")).over(earlier), F.lit(-1)) + 1).alias("open"),  # where the document that enters the block begins
        F.lead("block").over(order).isNull().alias("final"),
    )
    rows = found.join(slim, ["path", "block"])
    stops = F.transform("ends", lambda x: x + F.col("base"))
    starts = F.concat(F.array("open"), F.transform(stops, lambda x: x + 1))
    left = F.col("base") + F.col("n")  # the file's end, for its final block
    stops = F.when(F.col("final") & (F.element_at(starts, -1) < left), F.concat(stops, F.array(left))).otherwise(stops)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "before", F.size("ends").alias("full"), F.posexplode(F.arrays_zip(F.slice(starts, 1, F.size(stops)).alias("start"), stops.alias("stop"))).alias("k", "d"))
    return rows.select(
        "file",
        (F.col("before") + F.col("k")).cast("long").alias("ordinal"),
        F.col("d.start").alias("start"),
        (F.col("d.stop") - F.col("d.start")).alias("n_tokens"),
        (F.col("k") < F.col("full")).alias("ended"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    written = write_flat(table(spark, sf_dir, "documents"), folder)
    if written.isEmpty():
        return written.select("doc_id", F.col("ordinal").alias("n_tokens"))
    return scan(spark, folder).join(written, ["file", "ordinal"]).select("doc_id", "n_tokens")


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
