"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import decimals, joined, table, tiktoken_encoder, token_bytes


def _rank_file(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def runs_of(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Length of each list (0 where null), and all values."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


def encoded_batch(texts: pa.Array, path: str, pattern: str) -> pa.ListArray:
    ends, values = tiktoken_encoder(path, pattern)(texts)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def decoded_batch(ids: pa.ListArray, path: str, pattern: str) -> pa.BinaryArray:
    known = token_bytes(path, pattern)
    lengths, flat = runs_of(ids)
    if len(flat) and (flat.null_count or pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(known)):
        raise ValueError("an id is outside the rank file")
    values = known.take(flat)
    if values.null_count:
        raise ValueError("an id is outside the rank file")
    ends, data = joined(lengths, values)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add the token ids of ``text`` as ``ids`` (array<int>).

    With the public pattern every text is cut at boundaries that no match crosses, so
    a text of any length is encoded in small chunks and frequent chunks only once;
    with another pattern texts are encoded whole. No special tokens. Null and empty
    texts give an empty array; equal texts give equal ids; other columns stay, a
    column already named like ``ids`` is replaced; an empty table stays empty.
    """
    path, pattern = _rank_file(path, pattern)

    @F.arrow_udf("array<int>")
    def encoded(batch: pa.Array) -> pa.Array:
        return encoded_batch(batch, path, pattern)

    return df.withColumn(ids, encoded.asNondeterministic()(F.col(f"`{text}`")))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add the raw bytes of ``ids`` as ``decoded`` (binary).

    Bytes are joined as they are, valid UTF-8 or not. A null or empty array gives
    empty bytes; a null id or one outside the rank file fails the job.
    """
    path, pattern = _rank_file(path, pattern)

    @F.arrow_udf("binary")
    def raw(batch: pa.Array) -> pa.Array:
        return decoded_batch(batch, path, pattern)

    return df.withColumn(decoded, raw.asNondeterministic()(F.col(f"`{ids}`")))


def hex_digests(ends: np.ndarray, data: memoryview, less: int = 0) -> pa.Array:
    """SHA-256 of each run of bytes, without its last ``less`` ones."""
    return pa.array([sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string())


def digests(df: DataFrame, *columns: str) -> DataFrame:
    """n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of each row's ``text``, after ``columns`` (``ids``, if named).

    Texts are encoded and the ids decoded as by ``encode`` and ``decode``, but in one
    Python worker, so that neither ids nor bytes go through the JVM in between.
    """
    path, pattern = _rank_file(None, None)
    parts = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if "ids" in columns else {})

    @F.arrow_udf(f"struct<{', '.join(f'{name}: {kind}' for name, kind in parts.items())}>")
    def coded(batch: pa.Array) -> pa.Array:
        ids = encoded_batch(batch, path, pattern)
        lengths, flat = runs_of(ids)
        raw = decoded_batch(ids, path, pattern)
        ends = np.frombuffer(raw.buffers()[1], np.int32)[: len(raw) + 1]
        found = [pa.array(lengths, pa.int64()), hex_digests(*joined(lengths, decimals(1 << 16).take(flat)), 1), hex_digests(ends, memoryview(raw.buffers()[2]))]
        return pa.StructArray.from_arrays([*found, ids][: len(parts)], list(parts))

    rows = df.select(*[c for c in columns if c != "ids"], coded.asNondeterministic()(F.col("text")).alias("__coded"))
    return rows.select(*[F.col("__coded.ids") if c == "ids" else F.col(f"`{c}`") for c in columns], "__coded.n_tokens", "__coded.ids_sha256", "__coded.decoded_sha256")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {"op1_bpe_roundtrip": op1_bpe_roundtrip}
ORACLES: dict[str, str] = {}
