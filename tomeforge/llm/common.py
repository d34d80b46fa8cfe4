"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import base64
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 1,000 rows: with texts of megabytes, 10,000 would not fit a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="tomeforge-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_root()
    return f"{root.rstrip('/')}/tomeforge-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialize`` writes in this block at its end, but for those it was told to keep."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in replicated files.

    The table goes with the ``scratch`` block around it, with ``keep`` only with the
    next outer one; without such a block it stays until the folder is cleared.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_hash(column: str = "doc_id") -> Column:
    """crc32 of the id as text, which splits rows into training and held-out parts."""
    return F.crc32(F.col(column).cast("string"))


# Two kinds of cuts never fall inside a match of public_tokenizers.PATTERN: before ASCII
# white space that follows a character which is not white space, as every alternative
# holds white space only at its start and the look-ahead of white-space runs looks
# forwards; and between an ASCII letter or digit and ASCII punctuation other than the
# apostrophe, which no alternative holds together.
_WHITE, _WORD, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"\t\n\x0b\x0c\r ")] = _WHITE
_KIND[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _WORD
_KIND[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = _MARK
_CUT = np.zeros(16, bool)
_CUT[[_WHITE, _WORD << 2 | _WHITE, _MARK << 2 | _WHITE, _WORD << 2 | _MARK]] = True


def safe_cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorted places to cut UTF-8 bytes at: ``bounds``, where texts begin and end, and every safe place between."""
    kind = _KIND[data]
    mark = np.zeros(len(data) + 1, bool)
    mark[1:-1] = _CUT[kind[:-1] << 2 | kind[1:]]
    cuts = np.flatnonzero(mark)
    odd = cuts[data[cuts - 1] >= 0x80]  # the character before may be white space beyond ASCII
    odd = odd[odd > 1]
    one, two, three = data[odd - 1], data[odd - 2], data[np.maximum(odd - 3, 0)]
    white = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    white |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    white |= (three == 0xE2) & (two == 0x81) & (one == 0x9F) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    mark[odd[white]] = False
    mark[bounds] = True
    return np.flatnonzero(mark)


def runs(lengths: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of all runs (start, length), one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return values[at]


class Encoder:
    """Token ids of whole texts.

    Texts are cut at safe places; of each batch, every distinct chunk is looked up
    once, and the new ones are encoded together as one string: a chunk that begins
    with white space parts from the one before it by itself, others are set off by
    a line feed, whose id is left out, and those that end in white space are alone. As each id stands for a known number of
    bytes, the ids are cut at the chunks' lengths. Known chunks are kept up to
    ``limit`` chunks and 16 MB. With ``whole``, for tokenizers whose matches the cuts
    may cross, texts are encoded as they are.
    """

    def __init__(self, encode: Callable[[str], list[int]], sizes: np.ndarray, whole: bool = False, limit: int = 500_000):
        self.encode, self.sizes, self.whole, self.limit = encode, sizes, whole, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.lengths, self.held = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32), 0

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places where the texts' ids begin and the last ends, all ids); null texts are empty."""
        if self.whole:
            parts = [np.array(self.encode(x or ""), np.int32) for x in texts.to_pylist()]
            return np.cumsum([0, *map(len, parts)]), np.concatenate([*parts, np.empty(0, np.int32)])
        texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        bounds = (offsets - offsets[0]).astype(np.int64)
        if not bounds[-1]:
            return np.zeros(len(bounds), np.int64), np.empty(0, np.int32)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        cuts = safe_cuts(data, bounds)
        found, sizes = [], [np.zeros(1, np.int64)]
        for at in range(0, len(cuts) - 1, 1 << 19):
            some = self._chunks(data, cuts[at : at + (1 << 19) + 1].astype(np.int32))
            sizes.append(some[0])
            found.append(some[1])
        ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
        return ends[np.searchsorted(cuts, bounds)], np.concatenate(found)

    def _chunks(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of the chunks between the cuts."""
        if len(self.known) > self.limit or self.held > 16 << 20:
            self._forget()
        chunks = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        words = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = np.arange(len(new)) + len(self.starts)
            self._learn([words[k] for k in new.tolist()])
        slots = slots[chunks.indices.to_numpy()]
        lengths = self.lengths[slots]
        return lengths, runs(lengths, self.starts[slots], self.ids)

    def _learn(self, words: list[bytes]) -> None:
        white = [_KIND[word[0]] == _WHITE if word[0] < 128 else word.decode()[0].isspace() for word in words]
        pieces = [word if w else b"\n" + word for word, w in zip(words, white)]
        apart = 1 - np.array(white, np.int64)
        alone = [k for k, word in enumerate(words) if (word[-1] <= 32 or word[-1] >= 128) and word.decode()[-1].isspace()]
        own = {}
        for k in alone:  # white space at a text's end would run into the next piece
            own[k], pieces[k], apart[k] = np.array(self.encode(words[k].decode()), np.int32), b"", 0
        ids = np.array(self.encode(b"".join(pieces).decode()), np.int32)
        sizes = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        cuts = np.searchsorted(ends, sizes)
        if ends[-1] != sizes[-1] or not np.array_equal(ends[cuts], sizes):
            raise ValueError("a token crosses a chunk's end: this tokenizer needs whole texts")
        starts = np.concatenate([[0], cuts[:-1]]) + apart
        lengths = cuts - starts
        for k, part in own.items():
            starts[k], lengths[k] = len(ids), len(part)
            ids = np.concatenate([ids, part])
        self.known.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.held += sum(map(len, words))
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])


_loaded: dict = {}


def tiktoken_encoding(path: str, pattern: str):
    """The rank file as a tiktoken encoding, loaded once per Python worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def token_bytes(path: str, pattern: str) -> pa.Array:
    """The bytes of each id of a rank file, loaded once per Python worker; null for ids that it lacks."""
    key = (path, pattern, "bytes")
    if key not in _loaded:
        encoding = tiktoken_encoding(path, pattern)
        found = [None] * (encoding.max_token_value + 1)
        for token in encoding.token_byte_values():
            found[encoding.encode_single_token(token)] = token
        _loaded[key] = pa.array(found, pa.binary())
    return _loaded[key]


def decimals(n: int) -> pa.Array:
    """Each number below ``n`` in decimal digits with a comma, made once per Python worker."""
    if ("decimals", n) not in _loaded:
        _loaded["decimals", n] = pa.array([b"%d," % i for i in range(n)], pa.binary())
    return _loaded["decimals", n]


def joined(lengths: np.ndarray, pieces: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Runs of binary pieces put together: places where each run begins and the last ends, and the bytes."""
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = sizes[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])]
    return ends, memoryview(pieces.buffers()[2] or b"")


def tiktoken_encoder(path: str, pattern: str) -> Encoder:
    """An encoder over tiktoken, one per Python worker. Texts are cut for the public pattern only."""
    key = (path, pattern, "encoder")
    if key not in _loaded:
        import public_tokenizers

        sizes = pc.fill_null(pc.binary_length(token_bytes(path, pattern)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        _loaded[key] = Encoder(tiktoken_encoding(path, pattern).encode_ordinary, sizes, pattern != public_tokenizers.PATTERN)
    return _loaded[key]


def json_encoder(path: str) -> Encoder:
    """An encoder over a tokenizers file, one per Python worker; special tokens are ordinary text inside documents.

    Texts are cut only for byte-level tokenizers that normalise nothing, add no space
    and split by the public pattern, as the byte-level pre-tokenizer does.
    """
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        rules = json.loads(tokenizer.to_str())
        before = rules.get("pre_tokenizer") or {}
        plain = not rules.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        sizes = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())])

        def encode(text: str) -> list[int]:
            return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

        _loaded[path] = Encoder(encode, sizes, not plain)
    return _loaded[path]


def id_type(size: int) -> str:
    """The unsigned little-endian type that holds all ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"
