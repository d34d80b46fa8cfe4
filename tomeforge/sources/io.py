"""Sources and sinks: pages, chunks, queries, vectors, logs and review files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, content string, source string, page int, book_title string, section string, section_title string, content_type string, extra map<string,string>"
QUERY = "query_id long, query string, category string, targets array<string>"
SECTION, CONTENT_TYPE = "Desconhecida", "texto"


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Substitution rules (pattern, replacement), one a line of a JSON-lines file, in the order of their ``place``."""
    rows = spark.read.schema("place int, pattern string, replacement string").json(path)
    return [(r.pattern, r.replacement) for r in rows.orderBy("place").collect()]  # rules written by hand


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; a local one only where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tomeforge-")
    return f"{root.rstrip('/')}/tomeforge-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own and read back: its lineage ends in files. They stay until the folder is cleared."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_dir(spark: SparkSession) -> Iterator[str]:
    """A new shared folder that is deleted at the end of the block."""
    path = work_dir(spark)
    try:
        yield path
    finally:
        delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like ``written``, whose tables are deleted at the end of the block."""
    with scratch_dir(spark) as root:
        n = 0

        def keep(df: DataFrame) -> DataFrame:
            nonlocal n
            path, n = f"{root}/{n}", n + 1
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        yield keep


def read_pages(spark: SparkSession, path: str, schema: str = "path string, page int, text string") -> DataFrame:
    """Pages from JSON lines below ``path``, folders within folders too; ``broken`` holds lines that can't be read."""
    reader = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    return reader.option("recursiveFileLookup", "true").json(path)


def page_counts(pages: DataFrame) -> DataFrame:
    """Readable and broken lines."""
    broken = F.col("broken").isNotNull() & F.coalesce(F.length("path") >= 0, F.lit(True))  # Spark wants another column read beside it
    return pages.agg(F.count_if(~broken).alias("pages"), F.count_if(broken).alias("skipped"))


def enrich_metadata(df: DataFrame) -> DataFrame:
    """From ``path``: source (file name), book_title (its stem with spaces), and defaults of page, section and content_type."""
    name = F.element_at(F.split("path", "/"), -1)
    given = set(df.columns)
    return df.withColumns(
        {
            "source": name,
            "page": F.coalesce(F.col("page") if "page" in given else F.lit(None).cast("int"), F.lit(0)),
            "book_title": F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[_-]", " "),
            "section": F.coalesce(F.col("section") if "section" in given else F.lit(None).cast("string"), F.lit(SECTION)),
            "content_type": F.coalesce(F.col("content_type") if "content_type" in given else F.lit(None).cast("string"), F.lit(CONTENT_TYPE)),
        }
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from Parquet, or from a JSON array."""
    return spark.read.schema(CHUNK).json(path, multiLine=True) if path.endswith(".json") else spark.read.parquet(path)


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str, fields: dict[str, Column]) -> None:
    """JSON lines with a fixed list of fields, each with its default where the column is absent or null."""
    chosen = [F.coalesce(F.col(name), default).alias(name) if name in df.columns else default.alias(name) for name, default in fields.items()]
    df.select(*chosen).write.mode("overwrite").json(path)


def write_review(df: DataFrame, path: str, columns: list[str]) -> None:
    """A subset of columns as CSV with a header, to look through by hand."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def feedback_rows(df: DataFrame) -> DataFrame:
    """Feedback as it is stored: a rating of -1, 0 or 1, and chunks, scores and flags as JSON text."""
    return df.select(
        "id",
        "ts",
        "query",
        "response",
        F.greatest(F.lit(-1), F.least(F.lit(1), F.col("user_rating"))).alias("user_rating"),
        F.to_json(F.transform("chunks_used", lambda c: F.struct(c["source"].alias("source"), c["page"].alias("page")))).alias("chunks_used"),
        F.to_json("rerank_scores").alias("rerank_scores"),
        F.to_json("validation_flags").alias("validation_flags"),
    )


def append_feedback(df: DataFrame, path: str) -> None:
    feedback_rows(df).write.mode("append").parquet(path)


def append_responses(df: DataFrame, path: str) -> None:
    """Questions, answers, their metrics (struct) as JSON text and the list of sources."""
    df.select("ts", "question", "answer", F.to_json("metrics").alias("metrics"), "sources").write.mode("append").parquet(path)


def write_vectors(df: DataFrame, path: str, model_id: str) -> None:
    """Replace the vectors of one model; an empty input is refused."""
    if df.isEmpty():
        raise ValueError("no vectors to write")
    rows = df.select("chunk_id", "embedding", F.lit(model_id).alias("model_id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(path)


def read_vectors(spark: SparkSession, path: str, model_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if model_id is None else df.where(F.col("model_id") == model_id)


def append_vectors(df: DataFrame, path: str, model_id: str) -> None:
    """Add the vectors of chunks that the model's table does not hold."""
    held = read_vectors(df.sparkSession, path, model_id).select("chunk_id")
    rows = df.join(held, "chunk_id", "left_anti").select("chunk_id", "embedding", F.lit(model_id).alias("model_id"))
    rows.write.mode("append").partitionBy("model_id").parquet(path)


def missing_vectors(df: DataFrame, held: DataFrame) -> DataFrame:
    """Rows whose chunk has no vector yet."""
    return df.join(held.select("chunk_id"), "chunk_id", "left_anti")


def vector_inventory(vectors: DataFrame, expected: list[str]) -> DataFrame:
    """(model_id, vectors, present) of expected and found models."""
    wanted = vectors.sparkSession.createDataFrame([(x,) for x in expected], "model_id string")
    counts = vectors.groupBy("model_id").agg(F.count("*").alias("vectors"))
    both = wanted.join(counts, "model_id", "full")
    return both.select("model_id", F.coalesce("vectors", F.lit(0)).alias("vectors"), (F.coalesce("vectors", F.lit(0)) > 0).alias("present"))


def read_queries(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Queries from a JSON array; with ``n``, the list is repeated up to n queries."""
    df = spark.read.schema(QUERY).json(path, multiLine=True)
    return df if n is None else repeat_to(df, "query_id", n)


def repeat_to(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows in the order of ``key``, repeated as often as makes ``n``."""
    have = df.count()
    if not have:
        return df.withColumn("copy", F.lit(0)).limit(0)
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // have))))
    return copies.orderBy("copy", key).limit(n)
