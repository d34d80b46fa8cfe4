"""Language of code-switched text by a linear-chain conditional random field over words.

Emission scores of a word come from its affixes, its inner n-grams and the learned
lexicons that hold it, one of each language; transitions between languages are learned. Forward-
backward gives every word a distribution over the languages, whose mean over the
text decides its language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_hash, table

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the fit: rows per language, characters of a row that may be drawn, words of a training sequence.
PER_LANG, MAX_CHARS, SEQUENCE = 120, 4000, 64
BUCKET_BITS = 17
SEGMENT = 32
UNKNOWN = "und"


def hashed_features(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, feature) of every feature of every word.

    Features are the 2- and 3-grams of the word between its end marks and the
    prefixes and suffixes of up to four letters with their mark, all hashed; and,
    behind the buckets, one for each language whose lexicon has the word.
    """
    codes = np.frombuffer("".join([f"<{word}>" for word in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    is_start, is_end = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    is_start[ends - sizes] = True
    is_end[ends - 1] = True
    prime, spread, shift = np.uint32(16777619), np.uint32(2654435761), np.uint32(32 - BUCKET_BITS)
    known = [(k, lang) for k, word in enumerate(words) for lang in lexicon.get(word, ())]
    owners = [np.array([k for k, _ in known], np.int64)]
    features = [np.array([(1 << BUCKET_BITS) + lang for _, lang in known], np.uint32)]
    value = codes
    for n in range(2, 6):
        if len(codes) < n:
            break
        value = value[:-1] * prime + codes[n - 1 :]
        inside = owner[: 1 - n] == owner[n - 1 :]
        if n > 3:
            inside &= is_start[: 1 - n] | is_end[n - 1 :]
        owners.append(owner[: 1 - n][inside])
        features.append(((value[inside] + np.uint32(n)) * spread) >> shift)
    return np.concatenate(owners), np.concatenate(features)


def messages(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of many sequences laid end to end, each scaled to sum 1.

    ``emit`` (words x languages) and ``trans`` are positive weights. Each sequence is
    cut into segments of ``SEGMENT`` words; products of each segment's transfer
    matrices carry the messages over its ends, so that the number of steps follows
    the segment length and the longest sequence divided by it, not all words.
    """
    n, k = emit.shape
    if not n:
        return np.empty((0, k)), np.empty((0, k))
    segs = -(-lengths // SEGMENT)
    seg_seq = np.repeat(np.arange(len(lengths)), segs)
    first = np.cumsum(segs) - segs
    inner = np.arange(len(seg_seq)) - first[seg_seq]
    start = (np.cumsum(lengths) - lengths)[seg_seq] + inner * SEGMENT
    size = np.minimum(SEGMENT, lengths[seg_seq] - inner * SEGMENT)
    s = len(seg_seq)
    by_size = np.argsort(-size, kind="stable")  # the segments that still run at a step come first
    running = np.searchsorted(-size[by_size], -np.arange(SEGMENT), "left")
    e = np.zeros((SEGMENT, s, k))
    for t in range(SEGMENT):
        e[t, : running[t]] = emit[start[by_size[: running[t]]] + t]

    product = np.broadcast_to(np.eye(k), (s, k, k)).copy()
    for t in range(SEGMENT):
        r = running[t]
        product[:r] = (product[:r].reshape(-1, k) @ trans).reshape(-1, k, k) * e[t, :r, None, :]
        if t % 8 == 7:  # eight steps stay far from the smallest double
            product /= product.sum(axis=(1, 2), keepdims=True)
    product /= product.sum(axis=(1, 2), keepdims=True)
    transfer = np.empty_like(product)
    transfer[by_size] = product
    before, after = np.full((s, k), 1.0 / k), np.full((s, k), 1.0 / k)
    order = np.argsort(-segs, kind="stable")
    sorted_segs = -segs[order]
    for j in range(1, int(segs.max())):
        at = first[order[: np.searchsorted(sorted_segs, -j, "left")]] + j
        x = (before[at - 1][:, None, :] @ transfer[at - 1])[:, 0]
        before[at] = x / x.sum(axis=1, keepdims=True)
    for j in range(int(segs.max()) - 1, 0, -1):
        at = first[order[: np.searchsorted(sorted_segs, -j, "left")]] + j
        x = (transfer[at] @ after[at][:, :, None])[:, :, 0]
        after[at - 1] = x / x.sum(axis=1, keepdims=True)

    alpha, beta = np.empty((n, k)), np.empty((n, k))
    state = before[by_size]
    for t in range(SEGMENT):
        r = running[t]
        x = (state[:r] @ trans) * e[t, :r]
        state[:r] = x / x.sum(axis=1, keepdims=True)
        alpha[start[by_size[:r]] + t] = state[:r]
    state = after[by_size]
    for t in range(SEGMENT - 1, -1, -1):
        r = running[t]
        beta[start[by_size[:r]] + t] = state[:r]
        x = (state[:r] * e[t, :r]) @ trans.T
        state[:r] = x / x.sum(axis=1, keepdims=True)
    return alpha, beta


def posteriors(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Distribution over the languages for each word."""
    alpha, beta = messages(emit, lengths, trans)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Languages, feature weights (features x languages), transitions, and the languages whose lexicon has a word."""

    langs: list[str]
    weights: np.ndarray
    trans: np.ndarray
    lexicon: dict[str, list[int]]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Sum of the feature weights of each word, one column for each language."""
        found = [np.empty((0, self.weights.shape[1]), np.float32)]
        for at in range(0, len(words), 1 << 14):  # features of so many words are held at a time
            some = words[at : at + (1 << 14)]
            owner, feature = hashed_features(some, self.lexicon)
            found.append(np.stack([np.bincount(owner, self.weights[feature, a], len(some)) for a in range(self.weights.shape[1])], axis=1).astype(np.float32))
        return np.concatenate(found)


def lexicons(texts: list[str], labels: list[int]) -> dict[str, list[int]]:
    """Languages in at least two of whose texts a word occurs."""
    seen: Counter = Counter()
    for text, label in zip(texts, labels):
        seen.update((word, label) for word in set(WORD.findall((text or "").lower())))
    found = defaultdict(list)
    for (word, label), n in sorted(seen.items()):
        if n >= 2:
            found[word].append(label)
    return dict(found)


class Tagger:
    """Language and score of texts; keeps the emissions of distinct words, until they are over ``limit``."""

    def __init__(self, model: Model, limit: int = 250_000):
        self.model, self.limit = model, limit
        self.trans = np.exp(model.trans - model.trans.max())
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(model.langs)), np.float32)

    def words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Distribution over the languages for each word of each text."""
        if len(self.known) > self.limit:
            self.known, self.table = {}, self.table[:0]
        flat = list(chain.from_iterable(texts))
        if not flat:
            return [np.empty((0, len(self.model.langs)))] * len(texts)
        new = list(set(flat).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.table = np.concatenate([self.table, self.model.emissions(new)])
        scores = self.table[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]
        lengths = np.array([len(x) for x in texts], np.int64)
        emit = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64)) + 1e-30
        return np.split(posteriors(emit, lengths[lengths > 0], self.trans), np.cumsum(lengths)[:-1])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = []
        split = [WORD.findall((x or "").lower()) for x in texts]
        for words, gamma, text in zip(split, self.words(split), texts):
            if not words or not (any(map(str.isalpha, words)) or any(map(str.isalpha, text))):
                found.append((UNKNOWN, 0.0))
                continue
            mean = gamma.mean(axis=0)
            found.append((self.model.langs[int(mean.argmax())], min(1.0, float(mean.max()))))
        return found


def fit(texts: list[str], langs: list[str], rounds: int = 60, seed: int = 2) -> Model:
    """Fit weights and transitions on sequences that switch between labelled texts."""
    names = sorted(set(langs))
    k = len(names)
    if not k:
        return Model([UNKNOWN], np.zeros(((1 << BUCKET_BITS) + 1, 1), np.float32), np.zeros((1, 1)), {})
    rng = np.random.default_rng(seed)
    pools = defaultdict(list)
    for text, lang in zip(texts, langs):
        pools[names.index(lang)] += WORD.findall((text or "").lower())
    pools = {a: b for a, b in pools.items() if b}
    words, gold = [], []
    at = dict.fromkeys(pools, 0)
    while at:  # spans of 4 to 40 words in turn from random languages, until all pools are used
        a = sorted(at)[rng.integers(len(at))]
        n = int(rng.integers(4, 41))
        span = pools[a][at[a] : at[a] + n]
        words += span
        gold += [a] * len(span)
        at[a] += n
        if at[a] >= len(pools[a]):
            del at[a]
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    lexicon = lexicons(texts, [names.index(lang) for lang in langs])
    owner, bucket = hashed_features(list(distinct), lexicon) if distinct else (np.empty(0, np.int64),) * 2
    used, feature = np.unique(bucket, return_inverse=True)
    number, gold = np.array([distinct[w] for w in words], np.int64), np.array(gold, np.int64)
    weights, trans = np.zeros((len(used), k)), np.eye(k)
    lengths = np.array([min(SEQUENCE, len(words) - x) for x in range(0, len(words), SEQUENCE)], np.int64)
    follows = np.arange(len(words)) % SEQUENCE > 0
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[np.flatnonzero(follows) - 1], gold[follows]), 1)
    m = [np.zeros_like(weights), np.zeros_like(trans)]
    v = [np.zeros_like(weights), np.zeros_like(trans)]
    for step in range(1, rounds + 1 if words else 1):
        scores = np.stack([np.bincount(owner, weights[feature, a], len(distinct)) for a in range(k)], axis=1)[number]
        emit = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
        move = np.exp(trans)
        alpha, beta = messages(emit, lengths, move)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        pairs = alpha[np.flatnonzero(follows) - 1][:, :, None] * move * (emit * beta)[follows][:, None, :]
        pairs = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        error = gamma
        error[np.arange(len(words)), gold] -= 1
        by_word = np.stack([np.bincount(number, error[:, a], len(distinct)) for a in range(k)], axis=1)
        g = np.stack([np.bincount(feature, by_word[owner, a], len(used)) for a in range(k)], axis=1) / len(words)
        grads = [g + 1e-6 * weights, (pairs - gold_pairs) / len(words)]
        for i, (x, g) in enumerate(zip((weights, trans), grads)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g**2
            x -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    table_of = np.zeros(((1 << BUCKET_BITS) + k, k), np.float32)
    table_of[used] = weights
    return Model(names, table_of, trans, lexicon)


def train(docs: DataFrame, usable: Column | None = None) -> Model:
    """Fit on at most ``PER_LANG`` ids of each language, drawn by a hash of their id, with one text each.

    Rows without language, and those longer than ``MAX_CHARS``, are not drawn; of
    several rows with one id and language the least text counts. Without rows the
    model knows no language.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") <= MAX_CHARS) & F.col("text").rlike(r"\p{L}"))
    if usable is not None:
        known = known.where(usable)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(2)).alias("draw"))
    ids = ids.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= PER_LANG).select("doc_id", "lang").distinct()
    drawn = known.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"])  # PER_LANG rows a language
    rows = sorted((x.doc_id, x.lang, x.text) for x in drawn.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect())
    return fit([x[2] for x in rows], [x[1] for x in rows])


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its mean posterior.

    Null texts and texts without a letter get ``und`` and 0; repeated rows get equal
    results; columns already named like the outputs are replaced.
    """
    made: dict = {}

    @F.arrow_udf("struct<lang:string,score:double>")
    def tagged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if "t" not in made:
            made["t"] = Tagger(model)
        for batch in batches:
            found: list[tuple[str, float]] = []
            held, size = [], 0
            for x in batch:
                held.append(x.as_py())
                size += len(held[-1] or "")
                if size > 1 << 19:
                    found += made["t"].predict(held)
                    held, size = [], 0
            found += made["t"].predict(held) if held else []
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    tagged_df = df.withColumn("__tagged", tagged.asNondeterministic()(F.col(f"`{text}`")))
    return tagged_df.withColumn(lang, F.col("__tagged.lang")).withColumn(score, F.col("__tagged.score")).drop("__tagged")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"), id_hash() % 4 != 2)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (id_hash() % 4 == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
