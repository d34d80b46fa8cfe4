"""Token ids in wavelet-matrix shards.

A shard file holds the ids of consecutive documents as bit-planes of their Huffman
codes, so that a shard takes about as many bits as the ids' entropy. Each plane has
one bit of every id whose code goes that deep; the next one has those with a zero
bit before those with a one. Codes are dealt so that the ids which end at a plane
stand behind all others, sorted by id, and need no bits any more. Counts of ones
before every 512 bits give rank, and a search over them gives select. Access,
counting and occurrence lookup need the file alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_type, json_encoder, materialize, shared_dir, small_batches, table
from .files import Committed

MAGIC, HEAD = b"WVLT2\0\0\0", struct.Struct("<8sQQQQIB3x")
END, SHARD_TOKENS, SAMPLE, DEEPEST = 2, 4_000_000, 512, 32


@dataclass
class Plane:
    bits: np.ndarray  # packed bytes, first bit lowest
    ranks: np.ndarray  # ones before every SAMPLE bits, and all
    zeros: int

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i // SAMPLE
        have = self.ranks[block].astype(np.int64)
        rest = i - block * SAMPLE
        lane = np.arange(SAMPLE // 8)
        at = np.minimum(block[:, None] * (SAMPLE // 8) + lane, len(self.bits) - 1)
        keep = (np.clip(rest[:, None] - lane * 8, 0, 8)).astype(np.uint8)
        mask = ((1 << keep.astype(np.uint16)) - 1).astype(np.uint8)
        return have + np.bitwise_count(self.bits[at] & mask).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        low, high = np.zeros_like(k), np.full_like(k, len(self.bits) * 8 - 1)
        while (low < high).any():
            middle = (low + high) // 2
            ones = self.rank(middle + 1)
            enough = (ones if one else middle + 1 - ones) > k
            high, low = np.where(enough, middle, high), np.where(enough, low, middle + 1)
        return low


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of symbols by their counts (all above 0), at most ``DEEPEST``."""
    if len(counts) < 2:
        return np.ones(len(counts), np.uint8)
    n, order = len(counts), np.argsort(counts, kind="stable")
    weight, parent = counts[order].tolist() + [0] * (n - 1), [0] * (2 * n - 1)
    leaf, node = 0, n
    for new in range(n, 2 * n - 1):  # leaves and inner nodes both come in ascending weight
        for _ in range(2):
            if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                least, leaf = leaf, leaf + 1
            else:
                least, node = node, node + 1
            weight[new] += weight[least]
            parent[least] = new
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    found = np.empty(n, np.uint8)
    found[order] = depth[:n]
    return found if found.max() <= DEEPEST else code_lengths(counts // 2 + 1)


def deal_codes(lengths: np.ndarray) -> np.ndarray:
    """A code for each symbol, its first bit the highest of 32.

    The prefixes of a plane stand in the plane's own order, by their bits from the
    last to the first; the symbols that end there get the last of them.
    """
    codes, inner = np.zeros(len(lengths), np.uint32), np.zeros(1, np.uint64)
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        prefixes = np.concatenate([inner << np.uint64(1), inner << np.uint64(1) | np.uint64(1)])
        ending = np.flatnonzero(lengths == depth)
        inner = prefixes[: len(prefixes) - len(ending)]
        codes[ending] = prefixes[len(inner) :] << np.uint64(32 - depth)
    return codes


class WaveletMatrix:
    """Rank, select and access over an array of ids.

    ``symbols`` are the distinct ids, ascending, with their code ``lengths`` and ``counts``.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, counts: np.ndarray, planes: list[Plane]):
        self.symbols, self.lengths, self.counts, self.planes = symbols, lengths, counts, planes
        self.codes = deal_codes(lengths)
        #: Ids that a plane's order holds behind those that go on, and their number, by plane.
        self.ending = [np.flatnonzero(lengths == depth) for depth in range(1, len(planes) + 1)]
        self.sizes = self._sizes(lengths, counts)
        self.n = int(counts.sum())

    @staticmethod
    def _sizes(lengths: np.ndarray, counts: np.ndarray) -> list[int]:
        """Bits of each plane, and 0 after the last."""
        ended = np.bincount(lengths, counts, 1).astype(np.int64)
        return (int(counts.sum()) - np.cumsum(ended)).tolist()

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        lengths = code_lengths(counts)
        by_id = np.zeros(int(symbols.max(initial=0)) + 1, np.uint32)
        by_id[symbols] = deal_codes(lengths)
        left, planes = by_id[ids], []
        for size in cls._sizes(lengths, counts)[1:]:
            on = left.view(np.int32) < 0
            planes.append(cls._plane(np.packbits(on, bitorder="little"), len(left)))
            left = np.concatenate([np.compress(~on, left), np.compress(on, left)])[:size] << np.uint32(1)
        return cls(symbols, lengths, counts, planes)

    @staticmethod
    def _plane(bits: np.ndarray, n: int) -> Plane:
        padded = np.zeros(-(-len(bits) // (SAMPLE // 8)) * (SAMPLE // 8) or SAMPLE // 8, np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, SAMPLE // 64).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        return Plane(padded, ranks, n - int(ranks[-1]))

    def to_bytes(self) -> Iterator[bytes]:
        for plane in self.planes:
            yield from (plane.bits.tobytes(), plane.ranks.tobytes())

    @classmethod
    def from_buffer(cls, symbols: np.ndarray, lengths: np.ndarray, counts: np.ndarray, data: memoryview) -> WaveletMatrix:
        planes, at = [], 0
        for n in cls._sizes(lengths, counts)[:-1]:
            blocks = max(1, -(-n // SAMPLE))
            bits = np.frombuffer(data, np.uint8, blocks * SAMPLE // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", blocks + 1, at)
            at += ranks.nbytes
            planes.append(Plane(bits, ranks, n - int(ranks[-1])))
        return cls(symbols, lengths, counts, planes)

    def tokens(self) -> np.ndarray:
        """All ids in order, plane by plane from the deepest."""
        kind = np.dtype(id_type(int(self.symbols.max(initial=0)) + 1))
        ids = np.empty(0, kind)
        for k in range(len(self.planes) - 1, -1, -1):
            plane, ending = self.planes[k], self.ending[k]
            ids = np.concatenate([ids, np.repeat(self.symbols[ending].astype(kind), self.counts[ending])])
            on = np.unpackbits(plane.bits, count=self.sizes[k], bitorder="little").view(bool)
            above = np.empty_like(ids)
            above[np.flatnonzero(~on)] = ids[: plane.zeros]
            above[np.flatnonzero(on)] = ids[plane.zeros :]
            ids = above
        return ids

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given positions."""
        at = np.asarray(at, np.int64)
        found, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        for k, plane in enumerate(self.planes):
            ones = plane.rank(at)
            bit = plane.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
            at = np.where(bit, plane.zeros + ones, at - ones)
            done = at >= self.sizes[k + 1]
            ending = self.ending[k]
            place = np.searchsorted(np.cumsum(self.counts[ending]), at[done] - self.sizes[k + 1], "right")
            found[open_[done]] = self.symbols[ending[place]]
            at, open_ = at[~done], open_[~done]
        return found

    def _symbol(self, token: int) -> int | None:
        k = int(np.searchsorted(self.symbols, token))
        return k if k < len(self.symbols) and self.symbols[k] == token else None

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id from start up to stop."""
        k = self._symbol(token)
        if k is None:
            return 0
        ends = np.array([start, self.n if stop is None else stop], np.int64)
        for depth in range(int(self.lengths[k])):
            plane = self.planes[depth]
            ones = plane.rank(ends)
            ends = plane.zeros + ones if int(self.codes[k]) >> 31 - depth & 1 else ends - ones
        return int(ends[1] - ends[0])

    def find(self, token: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of an id; k must be below its count."""
        s, k = self._symbol(token), np.asarray(k, np.int64)
        if s is None or len(k) and (k.min() < 0 or k.max() >= self.counts[s]):
            raise IndexError("no such occurrence")
        depth = int(self.lengths[s])
        ending = self.ending[depth - 1]
        at = k + self.sizes[depth] + int(self.counts[ending[ending < s]].sum())
        for level in range(depth - 1, -1, -1):
            plane = self.planes[level]
            at = plane.select(at - plane.zeros, True) if int(self.codes[s]) >> 31 - level & 1 else plane.select(at, False)
        return at


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, end: int = END) -> list[bytes]:
    """A shard file: head; null flags, ids and token numbers of the documents and the ids' code table, deflated; planes."""
    matrix = WaveletMatrix.build(ids)
    flags = np.array([x is None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    columns = [flags, np.diff(names, prepend=0), lengths.astype("<i8"), np.diff(matrix.symbols, prepend=0).astype("<u4"), matrix.lengths, matrix.counts.astype("<u4")]
    directory = compress(b"".join(x.tobytes() for x in columns), 1)
    return [HEAD.pack(MAGIC, len(doc_ids), len(ids), len(matrix.symbols), len(directory), end, len(matrix.planes)), directory, *matrix.to_bytes()]


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, token numbers and the matrix of a shard file.

    A file of another kind, a cut one, and one in which a document doesn't end with the end id, as looked up in the
    matrix, raise ValueError.
    """
    if len(data) < HEAD.size or not data.startswith(MAGIC):
        raise ValueError("not a shard file")
    _, docs, n, distinct, size, end, depth = HEAD.unpack_from(data)
    columns, at = [], 0
    try:
        directory = decompress(memoryview(data)[HEAD.size : HEAD.size + size])
        for kind, k in (("u1", docs), ("<i8", docs), ("<i8", docs), ("<u4", distinct), ("u1", distinct), ("<u4", distinct)):
            columns.append(np.frombuffer(directory, kind, k, at))
            at += columns[-1].nbytes
        flags, names, lengths, symbols, codes, counts = columns
        matrix = WaveletMatrix.from_buffer(np.cumsum(symbols, dtype=np.int64), codes, counts.astype(np.int64), memoryview(data)[HEAD.size + size :])
        whole = matrix.n == n == lengths.sum() and len(matrix.planes) == depth and (matrix.access(np.cumsum(lengths) - 1) == end).all()
    except Exception as problem:
        raise ValueError("a damaged shard file") from problem
    if not whole:
        raise ValueError("a damaged shard file")
    return [None if f else x for f, x in zip(flags.tolist(), np.cumsum(names).tolist())], lengths, matrix


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode (doc_id, text) and write shards in ascending doc_id order; (part, shard, name, n_tokens) of each.

    Documents are dealt by ranges of doc_id, nulls first, then the hash of the text, then
    the place of the row, so that neither one id nor equal rows go to one task; a shard
    ends after the document that reaches ``shard_tokens``. Null and empty texts give the
    end id alone; repeated rows are documents each. An empty table writes nothing. A
    code table serves vocabularies of any size.
    """
    import public_tokenizers

    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = json_encoder(path)
        kind = id_type(max(len(encoder.sizes), end + 1))
        part, shard = TaskContext.get().partitionId(), 0
        names: list = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{shard:06d}.wvm"
            with Committed(folder, name) as stream:
                for piece in pack(names, np.concatenate(counts), np.concatenate(parts), end):
                    stream.write(piece)
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([name]), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["part", "shard", "name", "n_tokens"])

        for batch in batches:
            ends, ids = encoder(batch.column(1))
            ids = np.insert(ids.astype(kind), ends[1:], end)
            ends = ends + np.arange(len(ends))
            doc_ids, done = batch.column(0).to_pylist(), 0
            while done < len(doc_ids):
                # up to the first document with which the shard is full
                last = min(len(doc_ids), max(done + 1, int(np.searchsorted(ends, ends[done] + shard_tokens - size))))
                names += doc_ids[done:last]
                counts.append(np.diff(ends[done : last + 1]))
                parts.append(ids[ends[done] : ends[last]])
                size += len(parts[-1])
                if size >= shard_tokens:
                    yield close()
                    shard, size, names, counts, parts = shard + 1, 0, [], [], []
                done = last
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(rows.mapInArrow(write, "part int, shard int, name string, n_tokens long"))


def starts(shards: DataFrame) -> DataFrame:
    """Add the tokens of all earlier shards as ``base``: summed over parts, then inside each part."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return shards.join(parts, "part").select("name", (F.col("part_base") + F.col("inner")).alias("base"))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(name, doc_id, offset, n_tokens, ids_crc32) of every document, from the shard files alone.

    A foreign or damaged file fails the job.
    """
    small_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, lengths, matrix = unpack(content.as_py())
                data = memoryview(matrix.tokens().astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                offsets = ends - lengths
                sums = [crc32(data[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), ends.tolist())]
                columns = [pa.array([path.rsplit("/", 1)[1]] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(offsets), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["name", "doc_id", "offset", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    return files.mapInArrow(read, "name string, doc_id long, offset long, n_tokens long, ids_crc32 long")


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    shards = write_shards(table(spark, sf_dir, "documents"), folder)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    bases = materialize(starts(shards))
    read = read_shards(spark, folder).join(bases, "name")
    return read.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op10_wavelet_shards": op10_wavelet_shards}
ORACLES: dict[str, str] = {}
