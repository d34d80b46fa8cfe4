"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A text that holds a passage of m characters with at most k edits shares at least
m - q + 1 - k q of its q-grams, and all of them lie on diagonals at most k apart.
Shared q-grams are counted in bands of 2D diagonals that start every D >= k + 1
diagonals, so that one band holds them all; bands that reach the bound become
regions, and a banded alignment of the passage decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

Q = 8
ERROR_RATE = 0.1
#: Characters of passages that one task holds at a time; a larger benchmark is searched in several slices.
SLICE_CHARS = 4_000_000
TABLE_BITS = 21
SCHEMA = "doc_id long, item_id long, edits int, start int, end int"


def normal(text: str | None) -> str:
    """Lower-cased, with one space for every run of white space."""
    return " ".join((text or "").lower().split())


def qgram_codes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each position."""
    value, n = codes.astype(np.uint64), 1
    prime = 1_099_511_628_211
    while n < Q:  # from n-grams to 2n-grams
        value = value[:-n] * np.uint64(pow(prime, n, 1 << 64)) + value[n:]
        n *= 2
    return value


def budget(m: int, rate: float) -> int:
    """Edits allowed in a passage of m characters: its share, but no more than leave one shared q-gram certain."""
    return max(0, min(int(rate * m), (m - Q) // Q))


@dataclass
class Passages:
    """The passages of one slice with their q-gram table."""

    ids: list[int | None]
    texts: list[str]
    rate: float

    def __post_init__(self):
        self.short = [i for i, x in enumerate(self.texts) if len(x) < Q]
        self.codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in self.texts]
        sizes = np.array([len(x) for x in self.texts], np.int64)
        self.edits = np.array([budget(m, self.rate) for m in sizes.tolist()], np.int64)
        self.least = np.maximum(1, sizes - Q + 1 - self.edits * Q)
        self.width = (1 << np.ceil(np.log2(self.edits + 1)).astype(np.int64)).clip(16)
        grams = [qgram_codes(x) if len(x) >= Q else np.empty(0, np.uint64) for x in self.codes]
        item = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        place = np.concatenate([np.arange(len(x)) for x in grams] + [np.empty(0, np.int64)])
        gram = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(gram, kind="stable")
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.able = np.zeros(1 << TABLE_BITS, bool)
        self.able[self._slot(self.gram)] = True

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def regions(self, texts: list[str], pairs: int = 1 << 21) -> Iterator[tuple[int, int, int, int]]:
        """(text, passage, first diagonal, last diagonal) of bands that reach the bound, adjacent ones merged.

        A diagonal is the position in the text minus that in the passage.
        """
        if not len(self.gram):
            return
        joined = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(joined) < Q:
            return
        starts = np.cumsum([0] + [len(x) + 1 for x in texts])
        gram = qgram_codes(joined)
        at = np.flatnonzero(self.able[self._slot(gram)])
        near = np.searchsorted(self.gram, gram[at]).clip(max=len(self.gram) - 1)
        same = self.gram[near] == gram[at]
        at, near = at[same], near[same]
        which = np.searchsorted(starts, at, "right") - 1
        keys, counts = [], []
        many = self.count[near]
        ends = np.cumsum(many)
        cut = 0
        while cut < len(at):  # bounded slices of pairs, so that repetitive texts fit too
            to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + pairs, "right")))
            n = many[cut:to]
            own = np.repeat(np.arange(cut, to), n)
            hit = np.repeat(self.first[near[cut:to]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = self.item[hit]
            diagonal = at[own] - starts[which[own]] - self.place[hit] + len_shift
            band = diagonal // self.width[item]
            base = (which[own].astype(np.int64) * len(self.texts) + item) << 32
            key, count = np.unique(np.concatenate([base + band, base + band - 1]), return_counts=True)
            keys.append(key)
            counts.append(count)
            cut = to
        if not keys:
            return
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts))
        pair = key >> 32
        key = key[total >= self.least[pair % len(self.texts)]]
        if not len(key):
            return
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key) != 1) + 1, [len(key)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            text, item = divmod(int(key[a] >> 32), len(self.texts))
            width = int(self.width[item])
            low, high = int(key[a] & 0xFFFFFFFF), int(key[b - 1] & 0xFFFFFFFF)
            yield text, item, low * width - len_shift, (high + 2) * width - 1 - len_shift

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, passage, edits, start, end) of the best occurrence of each passage in each text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, low, high in self.regions(texts):
            found = align(self.codes[item], texts[text], low, high, int(self.edits[item]), self.texts[item])
            if found and (text, item) not in best or found and found < best[text, item]:
                best[text, item] = found
        for item in self.short:
            for text, whole in enumerate(texts):
                if self.texts[item] and (at := whole.find(self.texts[item])) >= 0:
                    best[text, item] = (0, at, at + len(self.texts[item]))
        for (text, item), (edits, start, end) in best.items():
            yield text, item, edits, start, end


#: Keeps diagonals, which start below zero, positive.
len_shift = 1 << 30


def align(passage: np.ndarray, text: str, low: int, high: int, limit: int, wanted: str) -> tuple[int, int, int] | None:
    """Fewest edits that turn the passage into a part of the text along diagonals low to high, with its start and end.

    Edits above ``limit`` give None. Only cells at most ``limit`` diagonals outside the region are filled.
    """
    low, high = max(low - limit, -len(passage)), min(high + limit, len(text))
    begin, stop = max(0, low), min(len(text), high + len(passage) + limit + 1)
    at = text.find(wanted, begin, stop)
    if at >= 0:
        return 0, at, at + len(wanted)
    width = high - low + 1
    if width < 1:
        return None
    codes = np.frombuffer(text[begin:stop].encode("utf-32-le", "surrogatepass"), np.uint32)
    lane = np.arange(width)
    far = len(passage) + limit + 1
    # row i, lane d: the passage's first i characters against the text up to low + d + i
    cost = np.where((low + lane >= 0) & (low + lane <= len(text)), 0, far)
    origin = low + lane
    for i, code in enumerate(passage.tolist(), 1):
        end = low + lane + i
        inside = (end >= max(1, begin + 1)) & (end <= min(len(text), begin + len(codes)))
        letter = np.zeros(width, np.uint32)
        letter[inside] = codes[end[inside] - 1 - begin]
        keep = np.where(inside, cost + (letter != code), far)
        drop = np.append(cost[1:], far) + 1  # a character of the passage is missing
        drop[(end < 0) | (end > len(text))] = far
        take = drop < keep
        value, source = np.where(take, drop, keep), np.where(take, np.append(origin[1:], 0), origin)
        # characters of the text in between: the least of value - lane so far
        slope = value - lane
        run = np.minimum.accumulate(slope)
        place = np.maximum.accumulate(np.where(slope == run, lane, 0))
        cost, origin = np.minimum(run + lane, far), source[place]
        if cost.min() > limit:
            return None
    d = int(cost.argmin())
    return (int(cost[d]), max(0, int(origin[d])), low + d + len(passage)) if cost[d] <= limit else None


def _loaded(passages: list[tuple[int | None, str]], rate: float) -> Passages:
    items = [(i, x) for i, x in ((i, normal(x)) for i, x in passages) if x]
    return Passages([i for i, _ in items], [x for _, x in items], rate)


def _found(held: Passages, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, passage, edits, start, end) over a batch of texts, searched in parts of about half a million characters."""
    part: list[str] = []
    first = size = 0
    for k in range(len(texts) + 1):
        if k == len(texts) or size > 1 << 19:
            for found in held.find(part):
                yield (found[0] + first, *found[1:])
            part, first, size = [], k, 0
        if k < len(texts):
            part.append(normal(texts[k].as_py()))
            size += len(part[-1])


def search(docs: DataFrame, passages: list[tuple[int | None, str]], rate: float = ERROR_RATE) -> DataFrame:
    """Occurrences of a bounded list of passages in ``docs`` (doc_id, text)."""
    made: dict = {}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "p" not in made:
            made["p"] = _loaded(passages, rate)
        held: Passages = made["p"]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            columns = list(zip(*[(ids[t], held.ids[i], e, a, b) for t, i, e, a, b in _found(held, batch.column(1))])) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "edits", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(found, SCHEMA)


def holds(passages: list[tuple[int | None, str]], rate: float = ERROR_RATE):
    """A column function: whether a text holds a passage of a bounded list."""
    made: dict = {}

    @F.arrow_udf("boolean")
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if "p" not in made:
            made["p"] = _loaded(passages, rate)
        for batch in batches:
            found = np.zeros(len(batch), bool)
            found[[t for t, *_ in _found(made["p"], batch)]] = True
            yield pa.array(found)

    return held.asNondeterministic()


def slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct passages in lists of about ``SLICE_CHARS`` characters, dealt by a hash."""
    items = benchmark.select("item_id", "text").where("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // SLICE_CHARS)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted({(x.item_id, x.text) for x in part.toLocalIterator()}, key=str)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the best occurrence of each passage in each document.

    Both sides are lower-cased and their white space is made single spaces; start and
    end count characters of that form. A passage is found with up to ``rate`` of its
    characters edited, but with no more edits than leave one of its q-grams whole for
    certain: at a tenth and q-grams of 8, passages of 10 to 15 characters unedited, of 20
    to 23 with one edit and of 30 and 31 with two; one shorter than ``Q`` only unedited. Null and empty
    passages and texts match nothing; null ids stay null; repeated documents match
    each on its own, repeated passages once; other columns are left out. The
    benchmark goes to the tasks in slices of ``SLICE_CHARS`` characters, each with its
    own pass over the documents, so that no task holds more, whatever its size.
    """
    small_batches(docs.sparkSession)
    found = None
    for passages in slices(benchmark):
        some = search(docs, passages, rate)
        found = some if found is None else found.unionByName(some)
    return found if found is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows, with all their columns, whose text holds no passage of the benchmark; null ids and repeated rows are rows like others.

    Each row is decided where it is, without a shuffle. Of a benchmark of several
    slices, what one slice leaves is written before the next one is searched.
    """
    small_batches(docs.sparkSession)
    for k, passages in enumerate(slices(benchmark)):
        docs = (materialize(docs) if k else docs).where(~holds(passages, rate)(F.col("text")))
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES: dict[str, str] = {}
