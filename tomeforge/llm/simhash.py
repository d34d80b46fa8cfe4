"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most three bits agree in one of four blocks of
16 bits. Each distinct fingerprint is dealt four times, with each block rotated to
the top, and goes to the group of its Gray range: the fingerprints whose Gray ranks
share their first bits, as many bits as make groups of about ``GROUP``. Inside a
group they are sorted by Gray rank; runs of them become leaves, leaves become upper
nodes, and each node holds the bits that all its members share beyond those its
parent holds. Pairs of nodes are followed from the top: each level adds the
differences in the bits it fixes to those accumulated above, and a pair of whole
groups is pruned once they exceed the limit, or lie in the block that must agree.
Blocks that more than ``HOT`` fingerprints share are dealt again by blocks of their
remaining bits, so that no task gets an unbounded group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table
from .graph import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LEAF, FAN, GROUP, HOT = 16, 8, 2048, 4096
#: Widths of the blocks that the levels of groups fix: 4 x 16 bits, then 4 x 12 of the other 48, then 4 x 9 of the other 36.
LEVELS = (16, 12, 9)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the 64-bit SimHash of the three-word shingles as ``out`` (long).

    A-Z are lower-cased; fewer than three words are one shingle; repeats count; a
    bit is set if over half of the hashes have it. Null, empty and white-space
    texts give 0.
    """

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        digest = xxhash.xxh64_intdigest

        def one(text) -> int:
            words = WORDS.findall((text or "").encode().lower())
            if len(words) > 3:
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-3] + 1]).tolist()
                hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, ends[2:].tolist())], np.uint64, len(words) - 2)
            elif words:
                hashes = np.array([digest(b" ".join(words), 42)], np.uint64)
            else:
                return 0
            ones = np.zeros(64, np.int64)
            for at in range(0, len(hashes), 1 << 16):
                part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])

        for batch in batches:
            yield pa.array([one(x.as_py()) for x in batch], pa.int64())

    return df.withColumn(out, simhash.asNondeterministic()(F.col(f"`{text}`")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over codes in Gray order: levels of (pattern, mask, own mask), level 0 the codes themselves.

    ``mask`` marks the bits that all members of a node share and ``pattern`` has their
    values; ``own`` marks those that its parent doesn't fix yet.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        pattern, mask = self.codes, np.full(len(codes), ~np.uint64(0))
        self.levels, self.fans, fan = [], [], LEAF
        while len(pattern) > 1:
            starts = np.arange(0, len(pattern), fan)
            shared = np.bitwise_and.reduceat(mask, starts)
            shared &= np.bitwise_and.reduceat(pattern, starts) | ~np.bitwise_or.reduceat(pattern, starts)
            self.levels.append((pattern, mask, mask & ~np.repeat(shared, fan)[: len(mask)]))
            self.fans.append(fan)
            pattern, mask, fan = pattern[starts] & shared, shared, FAN
        self.levels.append((pattern, mask, mask))
        #: Pairs of nodes that were looked at so far, by level.
        self.visited = [0] * len(self.levels)

    def near(self, limit: int, same: int = 0, budget: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions i < j whose codes differ in at most ``limit`` bits, none of them in ``same``, in bounded chunks."""
        top, same = len(self.levels) - 1, np.uint64(same)
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint8))]
        while stack:
            level, a, b, apart = stack.pop()
            if level == 0:
                yield a, b
                continue
            fan = self.fans[level - 1]
            step = max(1, budget // (fan * fan))
            if len(a) > step:
                stack += [(level, a[x : x + step], b[x : x + step], apart[x : x + step]) for x in range(0, len(a), step)]
                continue
            pattern, mask, own = self.levels[level - 1]
            i, j = np.divmod(np.arange(fan * fan), fan)
            left, right = (a[:, None] * fan + i).ravel(), (b[:, None] * fan + j).ravel()
            keep = np.flatnonzero((left <= right if level > 1 else left < right) & (right < len(pattern)) & (left < len(pattern)))
            left, right, apart = left[keep], right[keep], apart[keep // (fan * fan)]
            self.visited[level - 1] += len(left)
            # bits that both nodes fix, but not both their parents
            new = (own[left] & mask[right]) | (mask[left] & own[right])
            new &= pattern[left] ^ pattern[right]
            apart = apart + np.bitwise_count(new)
            keep = (apart <= limit) & (new & same == 0)
            stack.append((level - 1, left[keep], right[keep], apart[keep]))


def spanning_links(codes: np.ndarray, limit: int, same: int = 0) -> list[tuple[int, int]]:
    """Links within ``limit`` bits, none in ``same``, that join all codes they connect: at most len(codes) - 1."""
    index = GrayIndex(codes)
    root = np.arange(len(codes))
    found = []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    for a, b in index.near(limit, same):
        while (root[root] != root).any():
            root[:] = root[root]
        apart = root[a] != root[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((x, y))
    codes = index.codes.view(np.int64)
    return [(int(codes[x]), int(codes[y])) for x, y in found]


def links(fps: DataFrame, limit: int = 3, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fp`` values within ``limit`` (at most 3) bits of each other."""
    if limit > 3:
        raise ValueError("four blocks find up to three differing bits")
    rest = fps.select(F.lit("").alias("path"), F.col("fp").alias("code"))
    size = fps.count()  # of the largest group to be dealt
    done, fixed = [], 0
    for level, width in enumerate(LEVELS):
        dealt = _deal(rest, fixed, width)
        fixed += width
        # groups of one block's values would be smaller than need be: take Gray ranges of about ``group`` codes
        spare = width - min(width, max(0, (size // group).bit_length()))
        ranges = dealt.withColumn("key", F.concat_ws(".", "path", F.shiftrightunsigned("value", spare).cast("string")))
        sizes = dealt.groupBy("path", "value").count().where(F.col("count") > hot)
        sizes = materialize(sizes)
        biggest = sizes.agg(F.max("count")).first()[0]
        if level + 1 == len(LEVELS) or not biggest:
            done.append(ranges)
            break
        marked = ranges.join(sizes, ["path", "value"], "left")
        done.append(marked.where("count is null").select(ranges.columns))
        rest = materialize(marked.where("count is not null").select(F.concat_ws(".", "path", F.col("value").cast("string")).alias("path"), "code"))
        size = biggest
    return _joined(done, limit)


def _deal(groups: DataFrame, fixed: int, width: int) -> DataFrame:
    rest = 64 - fixed
    whole = (1 << rest) - 1 if rest < 64 else -1
    body = F.col("code").bitwiseAND(F.lit(whole))
    head = F.col("code").bitwiseAND(F.lit(~whole))

    def turned(k: int):
        cut = k * width
        if not cut:
            return F.col("code")
        return head.bitwiseOR(F.shiftleft(body, cut).bitwiseAND(F.lit(whole))).bitwiseOR(F.shiftrightunsigned(body, rest - cut))

    choices = F.array(*[F.struct(F.lit(k).alias("k"), turned(k).alias("code")) for k in range(4)])
    dealt = groups.select("path", F.explode(choices).alias("d"))
    value = F.shiftrightunsigned(F.col("d.code"), rest - width).bitwiseAND(F.lit((1 << width) - 1))
    return dealt.select(
        F.concat_ws(".", F.expr("nullif(path, '')"), F.col("d.k").cast("string")).alias("path"),
        value.alias("value"),
        F.col("d.code").alias("code"),
    )


def _joined(parts: list[DataFrame], limit: int) -> DataFrame:
    groups = parts[0]
    for part in parts[1:]:
        groups = groups.unionByName(part)

    def unturn(code: int, turns: list[int]) -> int:
        fixed = sum(LEVELS[: len(turns)])
        for level in reversed(range(len(turns))):
            fixed -= LEVELS[level]
            rest, cut = 64 - fixed, turns[level] * LEVELS[level]
            whole = (1 << rest) - 1
            body = code & whole
            code = (code & ~whole) | (body >> cut) | ((body << (rest - cut)) & whole)
        return code - (1 << 64) if code >> 63 else code

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: str, codes: list[np.ndarray]) -> Iterator[tuple[int, int]]:
            turns = [int(x) for x in key.split(".")[::2]]
            fixed = sum(LEVELS[: len(turns)])
            codes = np.concatenate(codes).view(np.uint64)
            if len(codes) > 1:
                for a, b in spanning_links(codes, limit, (1 << 64) - (1 << 64 - fixed)):
                    yield unturn(a & (1 << 64) - 1, turns), unturn(b & (1 << 64) - 1, turns)

        def table_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

        key, held, rows = None, [], []
        for batch in batches:
            codes = batch.column("code").to_numpy()
            keys = batch.column("key").dictionary_encode()
            numbers, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                name = names[numbers[start]]
                if name != key:
                    if key is not None:
                        rows += found(key, held)
                    key, held = name, []
                held.append(codes[start:end])
            if len(rows) > 50_000:
                yield table_of(rows)
                rows = []
        if key is not None:
            rows += found(key, held)
        if rows:
            yield table_of(rows)

    dealt = groups.select("key", "code").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(search, "a long, b long")


def rooted(nodes: DataFrame, limit: int = 3) -> DataFrame:
    """Add ``root``, the least ``fp`` reachable over links, to a table of distinct ``fp``."""
    roots = components(links(nodes.select("fp"), limit))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", limit: int = 3) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable over links.

    Copies share a fingerprint and are one node, so that a group of any size costs
    one row in the search. Rows without words have fingerprint 0 and are linked like
    any other. Repeated rows stay; a null id never becomes a component's id unless
    the component has no other; an empty table stays empty. Other columns are left
    out: join them by id.
    """
    with scratch(df.sparkSession):
        rows = fingerprints(df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).select("doc_id", "fp")
        rows = materialize(rows, keep=True)
        nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
        named = materialize(rooted(nodes, limit))
        ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = materialize(named.join(ids, "root").select("fp", "component_id"), keep=True)
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_components": op7_simhash_components}
ORACLES: dict[str, str] = {}
