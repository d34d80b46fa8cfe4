"""Entities, properties, relations and clusters found in chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import FRAGMENTS, HINTS, ITEM_KINDS, NOT_NAMES, PHANTOMS, PHRASE_WORDS, PROPERTIES, RELATIONS, STATS, STOP_WORDS
from ..functions.text import tokens
from ..sources.io import written
from .common import draw, dropped_in_turn, first_by

NAME = r"[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][\wáàâãéêíóôõúç'-]+"
PATTERNS = [rf"({NAME}(?:\s+{NAME}){{0,3}}) (?:é|is|est|ist|es) (?:um|uma|a|an|un|une|ein|eine)\b", rf"^({NAME}(?:\s+{NAME}){{0,3}}):", rf"^[•*-]\s*({NAME}(?:\s+{NAME}){{0,3}})", r"\b([A-ZÁÉÍÓÚÇ]{4,}(?:\s+[A-ZÁÉÍÓÚÇ]{2,}){0,3})\b", rf"\b({NAME}(?:\s+{NAME}){{1,3}})\b"]
TYPES = ["monstro", "magia", "vantagem", "pericia", "item"]
#: Weights of a rule's place: content, section, other.
WEIGHTS = {"content": 5, "section": 3, "secondary": 2}


#: Found names that a Python worker holds before it hands them on, by count and by characters.
SLICE_ROWS, SLICE_CHARACTERS = 4096, 1 << 22


def _slice(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)], names)


def entity_candidates(chunks: DataFrame, patterns: list[str] = PATTERNS, before: int = 20, after: int = 60, offsets: bool = False) -> DataFrame:
    """(chunk_id, name, pos, context): names by patterns, each once a chunk, with text around it; with ``offsets`` (first, last) of that text instead. Offsets need Python."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p, re.M) for p in patterns]
        for batch in batches:
            types = [batch.schema.field(0).type, pa.string(), pa.int32(), *([pa.int32()] * 2 if offsets else [pa.string()])]
            rows, held = [], 0
            for i in range(batch.num_rows):  # one text at a time leaves the batch, and names leave in slices
                chunk, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                seen = set()
                for match in (m for p in compiled for m in p.finditer(text)):
                    name = " ".join(match[1].split())
                    if name not in seen:
                        seen.add(name)
                        first, last = max(0, match.start() - before), match.end() + after
                        rows.append((chunk, name, match.start(1), *((first, last) if offsets else (text[first:last],))))
                        held += len(name) + (0 if offsets else last - first)
                        if len(rows) == SLICE_ROWS or held > SLICE_CHARACTERS:
                            yield _slice(rows, names, types)
                            rows, held = [], 0
            yield _slice(rows, names, types)

    kind = dict(chunks.dtypes)["chunk_id"]
    names = ["chunk_id", "name", "pos", *(("first", "last") if offsets else ("context",))]
    return chunks.select("chunk_id", "content").mapInArrow(find, f"chunk_id {kind}, name string, pos int, " + ("first int, last int" if offsets else "context string"))


def is_fragment(name: Column, blocked: list[str] = NOT_NAMES, patterns: list[str] = FRAGMENTS) -> Column:
    """Names that are no entities: blocked ones, fragments, and those over 40 characters with fewer than two capitalised words."""
    capitals = F.size(F.filter(F.split(name, r"\s+"), lambda w: w.rlike(r"^\p{Lu}")))
    bad = (F.trim(name) == "") | name.isin(*blocked or [""]) | ((F.length(name) > 40) & (capitals < 2))
    for p in patterns:
        bad = bad | name.rlike(p.replace("(?i)", "(?iu)"))
    return bad


def drop_fragments(df: DataFrame, **rules) -> DataFrame:
    return df.where(~is_fragment(F.col("name"), **rules))


def score_chunks(chunks: DataFrame, rules: dict[str, list[tuple[str, str]]], more: list[Column] = ()) -> DataFrame:
    """(chunk_id, <type>_score…): for each type the weights of its rules (place, pattern) that match, once for each chunk; ``more`` columns, of ``hint_columns`` say, in the same pass."""

    def total(of: list[tuple[str, str]]) -> Column:
        score = F.lit(0)
        for place, pattern in of:
            text = F.col("section") if place == "section" else F.col("content")
            score = score + F.when(text.rlike(f"(?iu){pattern}"), WEIGHTS[place]).otherwise(0)
        return score

    return chunks.select("chunk_id", *[total(of).alias(f"{kind}_score") for kind, of in rules.items()], *more)


def hint_columns(hints: dict[str, str] = HINTS, stats: str = STATS, most: int = 8) -> list[Column]:
    """Of a chunk's content whether each hint's pattern is in it, and as ``stats`` its first stats in one text, null if it has none."""
    found = F.slice(F.regexp_extract_all("content", F.lit(stats), F.lit(0)), 1, most)
    held = [F.coalesce(F.col("content").rlike(pattern), F.lit(False)).alias(name) for name, pattern in hints.items()]
    return [*held, F.nullif(F.array_join(found, " "), F.lit("")).alias("stats")]


def aggregate_entities(candidates: DataFrame, scores: DataFrame, kinds: list[str], contexts: int = 5, chunks: DataFrame | None = None) -> DataFrame:
    """(name, mentions, contexts, sources, <type>_score…, <hint>…, stats): one row a name; first contexts in the order of chunks.

    Sources are the distinct values of a ``source`` column of the scores (a book and
    page, say), else the chunks. Boolean columns of the scores are hints, true for a
    name if they are for any of its chunks; of a ``stats`` column the first text by
    chunk stays. Candidates and scores are made once and written, then read by both
    aggregates: that of the sums and that of the first contexts. Candidates with offsets
    instead of contexts keep that table small; the few contexts come from ``chunks``.
    """
    both = written(candidates).join(written(scores), "chunk_id")  # else a chunk's patterns are searched again for each of its names
    given = dict(scores.dtypes)
    sums = [F.sum(f"{k}_score").alias(f"{k}_score") for k in kinds]
    hints = [F.bool_or(name).alias(name) for name, kind in given.items() if kind == "boolean"]
    stats = [F.min_by("stats", F.when(F.col("stats").isNotNull(), F.col("chunk_id"))).alias("stats")] if "stats" in given else []
    source = "source" if "source" in given else "chunk_id"
    totals = both.groupBy("name", F.col(source).alias("__source")).agg(F.count("*").alias("n"), *sums, *hints, *stats, *([F.min(F.when(F.col("stats").isNotNull(), F.col("chunk_id"))).alias("at")] if stats else []))
    merged = [F.sum(f"{k}_score").alias(f"{k}_score") for k in kinds] + [F.bool_or(name).alias(name) for name, kind in given.items() if kind == "boolean"]
    totals = totals.groupBy("name").agg(F.sum("n").alias("mentions"), F.count("*").alias("sources"), *merged, *([F.min_by("stats", "at").alias("stats")] if stats else []))
    place = ["name", "chunk_id", "pos", *(["context"] if chunks is None else ["first", "last"])]
    first = first_by(both.select(place), ["name"], F.col("chunk_id"), F.col("pos"), n=contexts, rank="p")  # bounded before anything is collected
    if chunks is not None:
        first = first.join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("context", F.substring("content", F.col("first") + 1, F.col("last") - F.col("first")))
    first = first.select("name", "p", F.substring("context", 1, 300).alias("context"))
    held = first.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", F.col("context").alias("c")))), lambda x: x["c"]).alias("contexts"))
    return totals.join(held, "name")


def entity_sources(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, source): each distinct source of a name, as rows, so that no name is gathered."""
    return candidates.join(chunks.select("chunk_id", "source"), "chunk_id").select("name", "source").distinct()


def resolve_type(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Add type and confidence: best score 8 high, 5 medium, 3 with a lead of 2 promoted, 2 unknown, else generic; ties by the order of ``kinds``."""
    ordered = F.array_sort(F.array(*[F.struct((-F.col(f"{k}_score")).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]))
    top, second = -ordered[0]["s"], -ordered[1]["s"]
    sure = (top >= 5) | ((top >= 3) & (top - second >= 2))
    kind = F.when(sure, ordered[0]["k"]).when(top >= 2, "desconhecido").otherwise("generico")
    level = F.when(top >= 8, "alta").when(top >= 5, "media").when(sure, "promovida").otherwise("baixa")
    return df.withColumns({"type": kind, "confidence": level})


def boost_scores(df: DataFrame, forced: str, names: list[str], known: str, kind: str = "magia", rivals: tuple[str, ...] = ("monstro", "item")) -> DataFrame:
    """Add 20 to the score of ``kind`` and clear its rivals' for names in a list or that match ``forced``; add 10 where ``known`` matches."""
    sure = F.lower("name").isin(*[n.lower() for n in names] or [""]) | F.col("name").rlike(forced)
    more = F.when(sure, 20).when(F.col("name").rlike(known), 10).otherwise(0)
    return df.withColumns({f"{kind}_score": F.col(f"{kind}_score") + more} | {f"{r}_score": F.when(sure, 0).otherwise(F.col(f"{r}_score")) for r in rivals})


def proper_noun_score(name: Column, idle: list[str] = PHRASE_WORDS) -> Column:
    """0 to 5: a word in capitals; a capitalised word; a hyphen or several words that aren't all idle; a word that isn't idle; several words or a capitalised one."""
    words = F.split(F.trim(name), r"\s+")
    several, real = F.size(words) >= 2, F.exists(words, lambda w: ~F.lower(w).isin(*idle))
    signs = [
        F.exists(words, lambda w: (F.length(w) >= 2) & (w == F.upper(w)) & (w != F.lower(w))),
        F.exists(words, lambda w: (F.length(w) >= 2) & w.rlike(r"^\p{Lu}")),
        F.contains(name, F.lit("-")) | several & real,
        real,
        several | words[0].rlike(r"^\p{Lu}"),
    ]
    total = F.lit(0)
    for sign in signs:
        total = total + sign.cast("int")
    return F.when(F.length(F.trim(name)) < 2, 0).otherwise(total)


def post_rules(df: DataFrame, critical: dict[str, str] = {}, promotions: list[tuple[str, str]] = (), item_kinds: list[str] = ITEM_KINDS) -> DataFrame:  # noqa: B006
    """Corrections of ``type`` in order; ``review`` tells which rule changed it.

    Critical names (lower case) get their type and keep it. Spells with stats or without
    evidence, monsters without a proper noun and items named by their kind alone become
    unknown; unknown names that match a promotion (pattern, type) get its type.
    """
    given = F.create_map(*[F.lit(x) for pair in critical.items() for x in pair]) if critical else F.lit(None).cast("map<string,string>")
    forced, kind, words = given[F.lower("name")], F.col("type"), F.split(F.lower(F.trim("name")), r"\s+")
    stats = F.exists("contexts", lambda c: c.rlike(r"\bF\d+[-,\s]*H\d+"))
    evidence = F.exists("contexts", lambda c: c.rlike(r"(?iu)escola|elemento|custa?\b|\bPMs?\b"))
    generic = words[0].isin(*item_kinds) & ((F.size(words) == 1) | ((F.size(words) == 2) & words[1].isin("de", "do", "da", "e", "ou")))
    reason = F.when(forced.isNotNull(), F.when(forced != kind, "critical"))
    reason = reason.when((kind == "magia") & stats, "spell_with_stats").when((kind == "magia") & ~evidence, "spell_without_evidence")
    reason = reason.when((kind == "monstro") & (proper_noun_score(F.col("name")) < 2), "monster_without_proper_noun").when((kind == "item") & generic, "generic_item")
    unknown = forced.isNull() & (reason.isNotNull() | (kind == "desconhecido"))
    promoted = F.lit(None).cast("string")
    for pattern, wanted in reversed(promotions):
        promoted = F.when(F.col("name").rlike(pattern), wanted).otherwise(promoted)
    promoted = F.when(unknown, promoted)
    out = F.coalesce(forced, promoted, F.when(reason.isNotNull(), "desconhecido"), kind)
    return df.withColumns({"type": out, "review": F.when(promoted.isNotNull(), "promoted").otherwise(reason)})


def min_mentions(df: DataFrame, limits: dict[str, int], default: int = 2) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return df.where(F.col("mentions") >= F.coalesce(known[F.col("type")], F.lit(default)))


def type_histogram(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """(type, n, alert): counts of each type, "low" or "high" outside its bounds; bounded types without rows count 0."""
    limits = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in bounds.items()], "type string, least long, most long")
    rows = df.groupBy("type").agg(F.count("*").alias("n")).join(limits, "type", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("type", "n", F.when(F.col("n") < F.col("least"), "low").when(F.col("n") > F.col("most"), "high").alias("alert"))


def audit_entities(df: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, verdict): expectations (name, type or null for "must not exist") held against entities (name, type)."""
    rows = expected.select("name", F.col("type").alias("want")).join(df.select("name", F.col("type").alias("got")), "name", "left")
    verdict = F.when(F.col("want").isNull(), F.when(F.col("got").isNull(), "ok").otherwise("unwanted")).when(F.col("got").isNull(), "absent").when(F.col("want") == F.col("got"), "ok").otherwise("wrong_type")
    return rows.select("name", verdict.alias("verdict"))


def classify_entities(df: DataFrame, stop_words: list[str] = STOP_WORDS, sure: int = 4) -> DataFrame:
    """Add ``reason``: why an entity (name, mentions, contexts) is suspect, null if valid; names of ``sure`` mentions are valid unless stop words."""
    words = tokens(F.col("name"))
    idle = F.forall(words, lambda w: w.isin(*stop_words))
    reason = F.when(idle, "stopword").when(F.col("mentions") >= sure, None)
    reason = reason.when((F.length("name") < 3) | (F.length("name") > 60), "size").when(F.col("name").rlike(r"\d{3,}|[^\p{L}\p{N}\s'-]"), "pattern")
    reason = reason.when(~F.col("name").rlike(r"^\p{Lu}"), "proper_noun").when(F.size("contexts") == 0, "context")
    return df.withColumn("reason", reason)


def clean_entities(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the number of suspects by reason."""
    return classified.where("reason is null"), classified.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def cap_entities(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` most mentioned."""
    return df.orderBy(F.desc("mentions"), "name").limit(n)


def weak_spans(df: DataFrame, terms: dict[str, list[str]], name_pattern: str = NAME, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, label): dictionary terms and one name pattern, longest first, no overlaps, from left to right."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [(kind, re.compile("|".join(rf"\b{re.escape(t)}\b" for t in sorted(ts, key=len, reverse=True)), re.I)) for kind, ts in terms.items()] + [("NAME", re.compile(name_pattern))]
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text].fillna("")):
                spans = sorted(((m.start(), m.end(), kind) for kind, p in found for m in p.finditer(t)), key=lambda s: (s[0] - s[1], s[0]))
                taken: list[tuple[int, int, str]] = []
                used = bytearray(len(t))
                for a, b, kind in spans:
                    if not any(used[a:b]):
                        used[a:b] = b"\1" * (b - a)
                        taken.append((a, b, kind))
                rows += [(k, *s) for s in sorted(taken)]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "label"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(label, f"`{key}` {kind}, start int, end int, label string")


def rollup_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entities, by_label): spans (key, start, label, text) of a chunk in order, and distinct texts by label."""
    rows = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "text", "label"))).alias("s"))
    by = F.map_from_entries(F.transform(F.array_distinct(F.transform("s", lambda x: x["label"])), lambda lab: F.struct(lab, F.array_distinct(F.transform(F.filter("s", lambda x: x["label"] == lab), lambda x: x["text"])))))
    return rows.select(key, F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"))).alias("entities"), by.alias("by_label"))


def infer_properties(entities: DataFrame, rules: dict[str, dict[str, str]] = PROPERTIES, phantoms: str = PHANTOMS, most: int = 50) -> DataFrame:
    """(name, key, value, evidence): properties by the patterns of an entity's type; the first context that has one wins.

    Contexts that state a rule are left out. Values of page numbers or over ``most``
    characters don't count; spaces are squeezed, and a stray "a" before a number goes.
    """
    rows = entities.select("name", "type", F.posexplode("contexts").alias("pos", "context")).where(~F.col("context").rlike(phantoms.replace("(?i)", "(?iu)")))
    every = [F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), F.trim(F.regexp_extract("context", pattern.replace("(?i)", "(?iu)"), 1)).alias("value")) for kind, keys in rules.items() for key, pattern in keys.items()]
    found = rows.select("name", "type", "pos", "context", F.inline(F.array(*every))).where((F.col("kind") == F.col("type")) & F.length("value").between(1, most))
    found = found.where(~F.col("value").rlike(r"(?i)^\s*(?:pg\.?|pág\.?)\s*\d+\s*$"))
    value = F.regexp_replace(F.regexp_replace("value", r"(?i)^a\s+(\d+)$", "$1"), r"\s+", " ")
    return first_by(found, ["name", "key"], F.col("pos")).select("name", "key", value.alias("value"), F.col("context").alias("evidence"))


def extract_relations(entities: DataFrame, patterns: list[tuple[str, str]] = RELATIONS) -> DataFrame:
    """(src, relation, dst, evidence): edges by patterns with groups for source and target, or for the target of the entity itself; each edge once, the first context's."""
    rows = entities.select("name", F.posexplode("contexts").alias("pos", "context"))

    def matches(relation: str, pattern: str) -> Column:
        pattern = pattern.replace("(?i)", "(?iu)")
        dst = F.regexp_extract_all("context", F.lit(pattern), F.lit(re.compile(pattern).groups))
        src = F.regexp_extract_all("context", F.lit(pattern), F.lit(1)) if re.compile(pattern).groups > 1 else F.transform(dst, lambda _: F.col("name"))
        return F.transform(F.arrays_zip(src.alias("a"), dst.alias("b")), lambda z: F.struct(F.lit(relation).alias("relation"), z["a"].alias("a"), z["b"].alias("b")))

    parts = F.flatten(F.array(*[matches(*item) for item in patterns]))
    squeeze = lambda c: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 80)
    found = rows.select("name", "pos", "context", F.inline(parts)).select(squeeze(F.col("a")).alias("src"), "relation", squeeze(F.col("b")).alias("dst"), F.col("context").alias("evidence"), "pos")
    kept = found.where(((F.length("src") >= 2) & (F.length("dst") >= 2)) | ((F.col("relation") == "cost_pm") & (F.length("src") >= 2)))
    return first_by(kept, ["src", "relation", "dst"], F.col("pos"), F.col("evidence")).drop("pos")


#: Vectors of a task.
VECTORS = 8000


def discover_taxonomy(entities: DataFrame, k: int = 10, features: int = 500, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(members (name, cluster_id), terms (cluster_id, terms)): TF-IDF of joined contexts, unigrams and bigrams, k-means; the ten strongest terms of each centre.

    Only the ``features`` most frequent terms and the k centres come to the driver. Terms are
    counted before the shuffle, and the vectors written, ``VECTORS`` to a task, so that
    the fits read these instead of texts.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, Normalizer, StopWordsRemover

    words = tokens(F.array_join("contexts", " "))
    docs = entities.select("name", words.alias("w")).where(F.size("w") > 0)
    n = docs.count()
    k = k if n >= k else max(1, n // 2)
    prepared = NGram(n=2, inputCol="kept", outputCol="pairs").transform(StopWordsRemover(inputCol="w", outputCol="kept", stopWords=STOP_WORDS).transform(docs)).withColumn("terms", F.concat("kept", "pairs"))
    struct = lambda all, df: lambda t: F.struct(t.alias("term"), F.lit(all).alias("n"), F.lit(df).alias("df"))
    each = prepared.select(F.inline(F.concat(F.transform("terms", struct(1, 0)), F.transform(F.array_distinct("terms"), struct(0, 1)))))
    counts = each.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= 0.8 * n))
    vocabulary = [r.term for r in counts.orderBy(F.desc("n"), "term").limit(features).collect()]
    vectorizer = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="tf")
    vectors = written(vectorizer.transform(prepared).select("name", "tf")).repartition(n // VECTORS + 1, "name")
    model = Pipeline(stages=[IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="v"), KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster_id")]).fit(vectors)
    members = model.transform(vectors).select("name", "cluster_id")
    centres = model.stages[2].clusterCenters()
    rows = [(i, t, float(x)) for i, c in enumerate(centres) for t, x in zip(vocabulary, c) if x > 0]
    weights = entities.sparkSession.createDataFrame(rows, "cluster_id int, term string, weight double")
    top = first_by(weights, ["cluster_id"], F.desc("weight"), F.col("term"), n=10, rank="p")
    return members, top.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "term"))), lambda x: x["term"]).alias("terms"))


def name_clusters(terms: DataFrame, stop_words: list[str] = STOP_WORDS, keep: int = 8) -> DataFrame:
    """(cluster_id, label, terms): labels of the first three terms with a word that counts; clusters of stop words alone go."""
    real = F.filter("terms", lambda t: F.exists(F.split(t, " "), lambda w: ~w.isin(*stop_words)))
    return terms.select("cluster_id", F.array_join(F.slice(real, 1, 3), "_").alias("label"), F.slice("terms", 1, keep).alias("terms")).where("label <> ''")


def merge_clusters(members: DataFrame, share: float = 0.7) -> DataFrame:
    """(cluster_id, merged): in the order of clusters, each one left over takes in all later ones whose overlap with it is ``share`` of the smaller one."""
    members = members.select("cluster_id", "entity").distinct()
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    pairs = members.join(members.withColumnRenamed("cluster_id", "other"), "entity").where("other < cluster_id").groupBy("cluster_id", "other").agg(F.count("*").alias("common"))
    both = pairs.join(sizes, "cluster_id").join(sizes.select(F.col("cluster_id").alias("other"), F.col("n").alias("m")), "other")
    near = written(both.where(F.col("common") >= share * F.least("n", "m")).select(F.col("other").alias("early"), F.col("cluster_id").alias("late")))
    gone = dropped_in_turn(near)
    kept = near.join(gone.withColumnRenamed("late", "early"), "early", "left_anti")  # by those that stay themselves
    into = kept.groupBy(F.col("late").alias("cluster_id")).agg(F.min("early").alias("into"))
    return sizes.join(into, "cluster_id", "left").select("cluster_id", F.coalesce("into", "cluster_id").alias("merged"))


def property_completeness(entities: DataFrame, properties: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """(type, completeness): mean share of the expected keys that entities of a type have."""
    wanted = entities.sparkSession.createDataFrame([(t, k) for t, ks in expected.items() for k in ks], "type string, key string")
    rows = entities.select("name", "type").join(F.broadcast(wanted), "type").join(properties.select("name", "key").distinct().withColumn("has", F.lit(1)), ["name", "key"], "left")
    each = rows.groupBy("type", "name").agg(F.avg(F.coalesce("has", F.lit(0))).alias("share"))
    return each.groupBy("type").agg(F.round(F.avg("share"), 6).alias("completeness"))


def isolated_entities(entities: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """The least connected entities, with at most one edge as its source."""
    counts = edges.groupBy(F.lower("src").alias("k")).agg(F.count("*").alias("edges"))
    rows = entities.join(counts, F.lower("name") == F.col("k"), "left").select("name", F.coalesce("edges", F.lit(0)).alias("edges"))
    return rows.where("edges <= 1").orderBy("edges", "name").limit(n)


def cluster_issues(clusters: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(cluster_id, issue): clusters of fewer than two members or whose first three terms are stop words."""
    idle = F.forall(F.slice("terms", 1, 3), lambda t: t.isin(*stop_words))
    return clusters.select("cluster_id", F.when(F.col("members") < 2, "small").when(idle, "stop_words").alias("issue")).where("issue is not null")


def knowledge_report(classified: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: entities, valid, suspect, precision, relations and clusters."""
    counts = classified.agg(F.count("*").alias("entities"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("suspect"))
    counts = counts.withColumn("precision", F.round(1 - F.col("suspect") / F.col("entities"), 6))
    return counts.crossJoin(edges.agg(F.count("*").alias("relations"))).crossJoin(clusters.agg(F.count_distinct("cluster_id").alias("clusters")))


def coverage_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, present)."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", (F.col("rows") > 0).alias("present")) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def span_examples(entities: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """(name, text, start, end, label): contexts that hold the name, cut to 512 characters, ``n`` of them at random."""
    rows = entities.select("name", F.col("type").alias("label"), F.posexplode("contexts").alias("pos", "text")).withColumn("text", F.substring("text", 1, 512))
    at = F.position(F.lower("name"), F.lower("text"))
    found = rows.withColumn("at", at).where("at > 0")
    return found.orderBy(draw("name", "pos", seed=seed), "name", "pos").limit(n).select("name", "text", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("name")).alias("end"), "label")


#: Bytes of names that one automaton holds; a larger table is searched in several passes.
NAME_BYTES = 8 << 20


def same_length_lower(text: str) -> str:
    """Lower case, except for the few letters whose lower case is longer, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def longest_starts(names: list[tuple[str, str]]) -> Callable[[str], dict[int, tuple[int, str]]]:
    """A search for the longest name (lower-cased, name) that begins at each place of a text."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for low, name in names:
        machine.add_word(low, (len(low), name))
    if names:
        machine.make_automaton()

    def search(text: str) -> dict[int, tuple[int, str]]:
        found: dict[int, tuple[int, str]] = {}
        for end, (size, name) in machine.iter(same_length_lower(text)) if names else ():
            start = end - size + 1
            if size > found.get(start, (0, ""))[0]:
                found[start] = size, name
        return found

    return search


def mention_pieces(text: str, found: dict[int, tuple[int, str]]) -> list[dict]:
    """The text in pieces, left to right: at each place the longest name that begins there, and the text between."""
    pieces, done = [], 0
    for start in sorted(found):
        size, name = found[start]
        if start >= done:
            if start > done:
                pieces.append({"start": done, "piece": text[done:start], "name": None})
            pieces.append({"start": start, "piece": text[start : start + size], "name": name})
            done = start + size
    if done < len(text):
        pieces.append({"start": done, "piece": text[done:], "name": None})
    return pieces


def mention_search(shared: Broadcast, last: bool) -> Callable:
    """The search for one part of the names: (text, places found so far) to pieces if it is the last part, else to all places."""

    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        find = longest_starts(shared.value)
        for texts, before in batches:
            out = []
            for text, known in zip(texts.to_pylist(), before.to_pylist()):
                found = find(text or "")
                for start, x in known or ():
                    if x["size"] > found.get(start, (0, ""))[0]:
                        found[start] = x["size"], x["name"]
                out.append(mention_pieces(text or "", found) if last else [(start, {"size": n, "name": name}) for start, (n, name) in found.items()])
            entry = pa.struct([("start", pa.int32()), ("piece", pa.string()), ("name", pa.string())])
            yield pa.array(out, pa.list_(entry) if last else pa.map_(pa.int32(), pa.struct([("size", pa.int32()), ("name", pa.string())])))

    return search


def link_mentions(df: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name_bytes: int = NAME_BYTES) -> DataFrame:
    """(key, place, start, piece, name): every text cut into mentions of catalogue names and the text between them, which has no name.

    From left to right the longest name of two characters or more at each place is
    taken, whatever the case; of names alike but for it the first by alphabet. The
    pieces of a text put together are the text; null and empty texts have none. Names
    go to the tasks as automata of at most ``name_bytes``, dealt by a hash of the name,
    each a pass over the texts that keeps the longest name of every place.
    """
    kept, pieces = "map<int,struct<size:int,name:string>>", "array<struct<start:int,piece:string,name:string>>"
    named = names.select(F.lower("name").alias("low"), "name").where(F.length("low") >= 2).groupBy("low").agg(F.min("name").alias("name"))
    size = named.agg(F.sum(F.octet_length("low") + F.octet_length("name") + 64)).first()[0] or 0
    parts = max(1, -(-size // name_bytes))
    rows = df.select(key, F.col(text).alias("text"), F.lit(None).cast(kept).alias("found"))
    for part in range(parts):
        some = [(r.low, r["name"]) for r in named.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == part).collect()]  # of bounded size
        shared, last = df.sparkSession.sparkContext.broadcast(some), part == parts - 1
        rows = rows.withColumn("found", F.arrow_udf(mention_search(shared, last), pieces if last else kept)("text", "found"))
        rows = rows if last else written(rows)
    return rows.select(key, F.posexplode("found").alias("place", "x")).select(key, "place", "x.*")
