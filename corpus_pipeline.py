"""The corpus pipeline: stages that filter and encode documents, each on what the one before kept.

A stage takes any columns beside doc_id and text, of any name, and returns them all;
columns that it makes for itself have names that begin with two underscores. Null ids, ids that
stand on several rows and repeated rows are rows like any other, except that of rows
which are near copies, or the same, one stays. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm import bpe, decontaminate, langid, simhash, toxicity
from tomeforge.llm.common import delete, id_hash, materialize, scratch, shared_dir, small_batches, table

#: Least mean posterior of the language that a document is kept for: mixtures without a majority are below.
LEAST_LANGUAGE_SCORE = 0.5
#: Most rows of a list of marks that goes to all executors (about 100 bytes each); a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{name.replace('`', '``')}`") for name in df.columns]


def has_lang(df: DataFrame) -> bool:
    return "lang" in map(str.lower, df.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity is below the threshold; null and empty texts are scored as empty ones."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_hash() % 3 != 1)
    return toxicity.score(docs, model, out="__score").where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which one language has at least ``LEAST_LANGUAGE_SCORE``, and give it to those without ``lang``.

    Texts without letters have no language and go. Where no row has a ``lang``, or the
    table has no such column, no language can be learned: only those texts go then.
    """
    small_batches(spark)
    known = docs if has_lang(docs) else docs.withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(known, id_hash() % 4 != 2)
    if model.langs == [langid.UNKNOWN]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model, lang="__lang", score="__lang_score")
    found = found.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__lang_score") >= LEAST_LANGUAGE_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "__lang")).select(columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by SimHash: the one with the least id, of rows that share it the least digest.

    A row without id counts as the least. A row is known by its id and the digest of
    all its columns, so that rows which share an id or have none stand or fall with
    their own group. Texts stay where they are: only marks of the rows that go, and of
    survivors that are there more than once, are joined to them.
    """
    small_batches(spark)
    digest = F.unhex(F.sha2(F.to_json(F.struct(*columns(docs))), 256))
    keyed = docs.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__digest": digest})
    with scratch(spark):
        rows = materialize(simhash.fingerprints(keyed.select("__key", "__digest", "text"), out="__fp").select("__key", "__digest", "__fp"))
        copies = rows.groupBy("__fp", "__key", "__digest").count()
        nodes = materialize(copies.groupBy(F.col("__fp").alias("fp")).agg(F.min(F.struct("__key", "__digest")).alias("least")))
        named = materialize(simhash.rooted(nodes))
        kept = named.join(named.groupBy("root").agg(F.min("least").alias("kept")), "root").select(F.col("fp").alias("__fp"), "kept")
        marks = copies.join(kept, "__fp").withColumn("__stays", F.struct("__key", "__digest") == F.col("kept"))
        marks = materialize(marks.where("not __stays or count > 1").select("__key", "__digest", "__stays"), keep=True)
    marked = keyed.join(F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks, ["__key", "__digest"], "left")
    out = marked.where("__stays is null").select(columns(docs))
    if not marks.where("__stays").isEmpty():
        again = marked.where("__stays").dropDuplicates(["__key", "__digest"])
        out = out.unionByName(again.select(columns(docs)))
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and lang (null, if there is none) with the token ids of the text, their number and digest and that of the decoded bytes."""
    small_batches(spark)
    docs = docs if has_lang(docs) else docs.withColumn("lang", F.lit(None).cast("string"))
    return bpe.digests(docs, "doc_id", "lang", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_level_bpe", encode),
]

#: Learned models and digests of token ids are beyond SQL; tests/llm/test_pipeline.py checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written goes once the next one is written; the last stage's input stays for its result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
