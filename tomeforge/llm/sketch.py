"""Document fingerprints by threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Sketches
of parts are merged by set union, and the share of the smaller sketch that is in the
other one estimates containment, however unequal the documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WORDS, SCALE = 5, 4
#: Bytes of text in a range of documents, and rows of one text that go through a range each.
RANGE_BYTES, COPIES = 256 << 20, 10_000
NEXT = "doc_id long, text string, next_text string"
COMPARED = pa.schema({"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()})
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def sketch_of(text: str | None, words: int = WORDS, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes below 2^64 / scale of the lower-cased word shingles.

    A text of fewer words is one shingle, one without words the empty shingle. Where
    no hash is below the threshold the least one is kept, so that no sketch is empty.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = SPLIT.findall((text or "").lower().encode())
    if len(found) <= words:
        return np.array([digest(b" ".join(found))], np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    hashes = np.fromiter([digest(line[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64, len(starts))
    kept = hashes[hashes < np.uint64((1 << 64) // scale)] if scale > 1 else hashes
    return np.unique(kept) if len(kept) else hashes.min(keepdims=True)


#: Sketches of the texts seen last in this Python worker, as a text is often another row's next one.
_recent: dict[tuple, np.ndarray] = {}


def remembered(text: str | None, words: int, scale: int) -> np.ndarray:
    """The sketch of a text; the last 2,000 texts of up to 10,000 characters are remembered."""
    text = text or ""
    if len(text) > 10_000:
        return sketch_of(text, words, scale)
    key = (text, words, scale)
    if key not in _recent:
        if len(_recent) >= 2000:
            for old in list(_recent)[:1000]:
                del _recent[old]
        _recent[key] = sketch_of(text, words, scale)
    return _recent[key]


def sketch(df: DataFrame, *texts: str, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Add ``<text>_sketch`` (array<long>, the hashes' 64 bits) for each text column; nulls are empty texts.

    Other columns stay; columns already named like the new ones are replaced.
    """

    @F.arrow_udf("array<long>")
    def sketched(batch: pa.Array) -> pa.Array:
        parts = [remembered(x.as_py(), words, scale).view(np.int64) for x in batch]
        ends = np.cumsum([0] + [len(x) for x in parts])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))

    one = sketched.asNondeterministic()
    return df.withColumns({f"{name}_sketch": one(F.col(f"`{name}`")) for name in texts})  # all in one Python worker


def digits(hashes: Column) -> Column:
    """A sketch as one string, 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that is in the other one."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def merge(df: DataFrame, key: str, hashes: str) -> DataFrame:
    """(key, hash): the union of the sketches of each key, one row a hash, so that no key is gathered."""
    return df.select(key, F.explode(hashes).alias("hash")).distinct()


def ranges_of(place: np.ndarray, tie: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range of each row, whether it is the first of its range), by the first rows (place, tie) of all ranges, ascending."""
    places, ties = bounds
    low, high = np.searchsorted(places, place, "left"), np.searchsorted(places, place, "right")
    found = high - 1
    for k in np.unique(low[low < high]).tolist():  # places at which ranges begin
        rows = np.flatnonzero((low == k) & (low < high))
        found[rows] = k - 1 + np.searchsorted(ties[k : high[rows[0]]], tie[rows], "right")
    return found, (places[found] == place) & (ties[found] == tie)


def with_next(docs: DataFrame, rows_a_range: int | None = None, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = NEXT) -> DataFrame:
    """(doc_id, text, next_text), or what ``then`` makes of batches of it, by its schema, in the worker that pairs them: next_text is that of the next document in descending doc_id order, after the last the first.

    Null texts become empty. Rows of one id are in the order of their texts' hashes,
    null ids come last; other columns are left out. The order is cut into ranges of
    about ``RANGE_BYTES`` of text, or ``rows_a_range`` rows if that is given, found by a
    range shuffle of ids and hashes alone, so that a repeated id is dealt over several
    ranges; two numbers for each range are shared with all tasks. The first row of each range also
    goes to the range before it: every range has all successors, no task more than
    its range, and texts are shuffled once. A row that is there more than
    ``COPIES`` (or ``rows_a_range``) times goes that way once; the others are followed by their like.
    """
    spark = docs.sparkSession
    small_batches(spark)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.bitwise_not(doc_id), F.lit((1 << 63) - 1)).alias("place"),  # ascending, as ids descend
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
    )
    copies_a_range = rows_a_range or COPIES
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    many = rows.groupBy("place", "tie").count().where(F.col("count") > copies_a_range).select("place", "tie").collect()
    copies = None
    if many:  # at most one for each ``copies_a_range`` rows
        listed = F.broadcast(spark.createDataFrame(many, "place long, tie long"))
        once = rows.join(listed, ["place", "tie"], "left_semi").groupBy("place", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("n"))
        blocks = once.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1, F.lit(copies_a_range).cast("long"))).alias("first"))
        last = F.least(F.col("first") + copies_a_range - 1, F.col("n") - 1)
        copies = blocks.repartition("doc_id", "first").select("doc_id", "text", F.col("text").alias("next_text"), F.explode(F.sequence("first", last)).alias("k")).drop("k")
        rows = rows.join(listed, ["place", "tie"], "left_anti").select(rows.columns).unionByName(once.select(rows.columns))
    wanted = -(-n // rows_a_range) if rows_a_range else -(-size // RANGE_BYTES)
    parts = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                break

    # two numbers for each range
    heads = rows.select("place", "tie").repartitionByRange(parts, "place", "tie").sortWithinPartitions("place", "tie").mapInArrow(first, "place long, tie long")
    bounds = np.array(sorted(tuple(x) for x in heads.collect()), np.int64).reshape(-1, 2).T
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("array<int>")
    def ranges(place: pa.Array, tie: pa.Array) -> pa.Array:
        """The range of a row, and that before it if the row is its range's first."""
        found, first = ranges_of(place.to_numpy(), tie.to_numpy(), shared.value)
        sizes = 1 + first.astype(np.int64)
        values = np.repeat(found, sizes)
        ends = np.cumsum(sizes)
        values[ends[first] - 1] = (found[first] - 1) % shared.value.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))

    placed = rows.select("*", F.posexplode(ranges("place", "tie")).alias("guest", "range"))
    placed = placed.repartitionById(max(1, bounds.shape[1]), F.col("range")).sortWithinPartitions("guest", "place", "tie").select("doc_id", "text", "guest")

    then = then or (lambda batch: batch)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, guest in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if held:
                    out.append((*held, text))
                held = None if guest else (doc_id, text)
            columns = list(zip(*out)) or [[], [], []]
            yield then(pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "text", "next_text"]))

    found = placed.mapInArrow(follow, schema)
    if copies is None:
        return found
    return found.unionByName(copies.mapInArrow(lambda batches: map(then, batches), schema))


def edited(df: DataFrame) -> DataFrame:
    """Add ``edited``: the text with its last half replaced by as much of the start of ``next_text``."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))


def compare_next(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of (doc_id, text, next_text) the fingerprints of text and edited text, and the likeness of the text's to the edited and the next text's."""
    columns: dict[str, list] = {name: [] for name in COMPARED.names[1:]}
    for text, follow in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        half = len(text) // 2
        changed = text[: len(text) - half] + follow[:half]
        own, other, after = (remembered(x, WORDS, SCALE) for x in (text, changed, follow))
        near = [len(np.intersect1d(own, x, assume_unique=True)) / min(len(own), len(x)) for x in (other, after)]
        hexed = [x.astype(">u8").tobytes().hex() for x in (own, other)]
        for name, value in zip(columns, (len(text), sha256(changed.encode()).hexdigest(), *hexed, *near)):
            columns[name].append(value)
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, COMPARED.field(name).type) for name, x in columns.items())], schema=COMPARED)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), then=compare_next, schema=schema)


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLES: dict[str, str] = {}
