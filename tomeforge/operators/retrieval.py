"""Retrieval for whole tables of queries: BM25, vectors, fusion, reranking and structured search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, tokens
from ..functions.vector import dot, norm, squared_distance
from ..plugins import lexical_overlap
from ..sources.io import written
from . import tiles
from .common import first_by, meet_all, prioritised, small

K1, B, FLOOR = 1.5, 0.75, 0.25


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 of each query (query_id, query) over docs (doc_id, text).

    Two passes over the documents: one for the frequencies of all words, combined
    before the shuffle and written, from which lengths and the mean idf come as numbers;
    one for the words of queries alone, of which blocks of documents meet tiles of queries,
    so that no pair of a document and a query is shuffled but the best of a task. A
    negative idf becomes a quarter of the mean idf over all words.
    """

    def rows(of) -> Column:
        """Structs made of a document's words, which the lambda's variable holds so that they are found once."""
        return F.inline(F.flatten(F.transform(F.array(tokens(F.col("text"))), of)))

    def counted(w: Column) -> Column:
        """A row for each distinct word, and one for the document with its length."""
        each = F.transform(F.array_distinct(w), lambda x: F.struct(x.alias("term"), F.lit(0).alias("length")))
        return F.concat(each, F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size(w).alias("length"))))

    frequency = written(docs.select(rows(counted)).groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length")))
    whole = frequency.where("term is null").first()
    n, avgdl = (whole.df, max(whole.length, 1) / whole.df) if whole else (0, 1.0)
    idf = frequency.where("term is not null").select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf")).first()[0] or 0.0
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weights = asked.join(idf, "term").select("query_id", "term", (F.col("times") * F.when(F.col("idf") < 0, FLOOR * mean).otherwise(F.col("idf"))).alias("weight"))
    used = asked.select("term").distinct()
    found = docs.select("doc_id", rows(lambda w: F.transform(w, lambda x: F.struct(F.size(w).alias("dl"), x.alias("term"))))).join(small(used), "term", "left_semi")
    tf = found.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    scores = tiles.bm25_scores(weights, tf.where("doc_id is not null"), k, n, avgdl, K1, B)
    if not docs.where("doc_id is null").isEmpty():  # which count as one
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
        scores = scores.unionByName(tf.where("doc_id is null").join(small(weights), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")))
    return bm25_ranks(scores, k)


def bm25_ranks(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of unrounded scores."""
    scored = scores.select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return first_by(scored, ["query_id"], F.desc("score"), F.col("doc_id"), n=k, rank="rank")


def _vector_bytes(queries: DataFrame) -> int:
    return 64 + 8 * (queries.agg(F.max(F.size("embedding"))).first()[0] or 0)


def _best_pairs(queries: DataFrame, vectors: DataFrame, k: int, measure, score) -> DataFrame:
    """(query_id, vec_id, place): pairs among which the best ``k`` of each query are, by tiles; vectors of another length or without finite components by ``score`` of all."""
    size = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    row_bytes = 64 + 8 * size
    fit = F.coalesce((F.size("embedding") == max(size, 1)) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    vectors, queries = vectors.select("vec_id", "embedding"), queries.select("query_id", "embedding")
    n, odd = vectors.agg(F.count("*"), F.count_if(~fit)).first()
    rows, asked = vectors.where(fit), queries.where(fit)
    found = tiles.nearest(asked.select("query_id", "embedding"), rows.select(F.col("vec_id").alias("id"), "embedding"), measure, k, row_bytes, n).select("query_id", F.col("id").alias("vec_id"), "place")
    all_of = lambda v, q: meet_all(v, q.select("query_id", F.col("embedding").alias("q")), "query_id", row_bytes).select("query_id", "vec_id", score(F.col("q"), F.col("embedding")).alias("place"))
    if odd:
        found = found.unionByName(all_of(vectors.where(~fit), queries))
    if not queries.where(~fit).isEmpty():
        found = found.unionByName(all_of(rows, queries.where(~fit)))
    return found


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, similarity, rank): nearest vectors by squared distance; similarity is 1 / (1 + d).

    Exact: every vector meets every query of the stated set, which is broadcast in
    blocks within the bound, in tiles; a task returns its best of each query. For query
    sets as large as the vectors use :func:`knn_cells`.
    """
    return _nearest_ranks(_best_pairs(queries, vectors, k, tiles.Distance, squared_distance), k)


def _nearest_ranks(pairs: DataFrame, k: int) -> DataFrame:
    scored = pairs.select("query_id", "vec_id", F.round("place", 6).alias("d"))
    ranked = first_by(scored, ["query_id"], F.col("d").asc_nulls_last(), F.col("vec_id"), n=k, rank="rank")
    return ranked.select("query_id", "vec_id", F.round(1 / (1 + F.col("d")), 6).alias("similarity"), "rank")


def knn_cells(queries: DataFrame, vectors: DataFrame, k: int = 10, cells: int = 64, probes: int = 4, seed: int = 1) -> DataFrame:
    """Approximate nearest vectors: k-means cells fitted on a bounded sample, an equi-join on the ``probes`` nearest cells.

    The sample is at most 256 vectors a cell; all vectors are dealt to cells, and each cell's candidates are compared exactly.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(256 * cells)
    model = KMeans(k=cells, seed=seed, featuresCol="v").fit(sample.select(array_to_vector("embedding").alias("v")))
    centres = F.array(*[F.struct(F.lit(i).alias("cell"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for i, c in enumerate(model.clusterCenters())])

    def nearest(vector: Column, n: int) -> Column:
        ordered = F.sort_array(F.transform(centres, lambda s: F.struct(squared_distance(s["c"], vector).alias("d"), s["cell"].alias("cell"))))
        return F.transform(F.slice(ordered, 1, n), lambda x: x["cell"])

    placed = vectors.withColumn("cell", nearest(F.col("embedding"), 1)[0])
    asked = queries.select("query_id", "embedding", F.explode(nearest(F.col("embedding"), probes)).alias("cell"))
    rows = placed.select("cell", F.col("vec_id").alias("id"), "embedding")
    found = tiles.nearest(asked, rows, tiles.Distance, k, _vector_bytes(queries), vectors.count(), cells)
    return _nearest_ranks(found.select("query_id", F.col("id").alias("vec_id"), "place"), k)


def cosine_rank(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, cosine, rank); a zero vector has length 1."""
    length = lambda c: F.when(norm(c) == 0, 1.0).otherwise(norm(c))
    pairs = _best_pairs(queries, vectors, k, tiles.Cosine, lambda q, v: -(dot(q, v) / length(q) / length(v)))
    scored = pairs.select("query_id", "vec_id", F.round(-F.col("place"), 6).alias("cosine"))
    return first_by(scored, ["query_id"], F.desc("cosine"), F.col("vec_id"), n=k, rank="rank")


def aggregate_hits(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, doc_id, sem, bm25): best of each kind over all variants of a query; a missing kind is 0."""
    rows = semantic.select("query_id", "doc_id", F.col("score").alias("sem"), F.lit(None).cast("double").alias("bm25"))
    rows = rows.unionByName(lexical.select("query_id", "doc_id", F.lit(None).cast("double").alias("sem"), F.col("score").alias("bm25")))
    return rows.groupBy("query_id", "doc_id").agg(F.coalesce(F.max("sem"), F.lit(0.0)).alias("sem"), F.coalesce(F.max("bm25"), F.lit(0.0)).alias("bm25"))


def minmax(df: DataFrame, *columns: str, key: str = "query_id") -> DataFrame:
    """Scale columns to 0..1 inside each query; equal values become 0.5."""
    w = Window.partitionBy(key)
    for c in columns:
        low, high = F.min(c).over(w), F.max(c).over(w)
        df = df.withColumn(c, F.when(high == low, 0.5).otherwise((F.col(c) - low) / (high - low)))
    return df


def fuse(hits: DataFrame, weight: float = 0.7, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): weighted sum of the scaled scores."""
    score = F.round(weight * F.col("sem") + (1 - weight) * F.col("bm25"), 6)
    scored = minmax(hits, "sem", "bm25").select("query_id", "doc_id", score.alias("score"))
    return first_by(scored, ["query_id"], F.desc("score"), F.col("doc_id"), n=k or 1 << 30, rank="rank")


def cut(ranked: DataFrame, candidates: int, k: int) -> DataFrame:
    """Twice the candidates first, then the final k."""
    return ranked.where(F.col("rank") <= 2 * candidates).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, k: int, scorer=lexical_overlap, enabled: bool = True) -> DataFrame:
    """(…, rerank_score, final_rank): pairs (query_id, query, doc_id, text, rank) by a pair scorer.

    A query with one candidate gets 1; without reranking all get 0.5 in their order.
    """
    alone = F.count("*").over(Window.partitionBy("query_id")) == 1
    score = F.when(alone, 1.0).otherwise(F.round(scorer(F.col("query"), F.col("text")), 6)) if enabled else F.lit(0.5)
    scored = candidates.withColumn("rerank_score", score)
    return first_by(scored, ["query_id"], F.desc("rerank_score"), F.col("rank"), F.col("doc_id"), n=k, rank="final_rank")


def retrieve(variants: DataFrame, docs: DataFrame, vectors: DataFrame, query_vectors: DataFrame, candidates: int = 20, k: int = 5) -> DataFrame:
    """Variants (query_id, variant_no, query) to final ranks: BM25 and vectors of all variants, fused and reranked."""
    asked = variants.select(F.struct("query_id", "variant_no").alias("query_id"), "query")
    lexical = bm25(asked, docs, candidates).select(F.col("query_id.query_id").alias("query_id"), "doc_id", "score")
    semantic = knn(query_vectors, vectors, candidates).select("query_id", F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    fused = fuse(aggregate_hits(semantic, lexical), k=2 * candidates)
    first = variants.where("variant_no = 0").select("query_id", "query")
    return rerank(fused.join(first, "query_id").join(docs.select("doc_id", "text"), "doc_id"), k)


def retrieve_weighted(terms: DataFrame, vectors: DataFrame, docs: DataFrame, queries: DataFrame, candidates: int = 20, k: int = 5) -> DataFrame:
    """Expanded terms (query_id, term_no, term, weight, embedding) by vectors (vec_id = doc_id, embedding), then reranked.

    A document has its best similarity times the term's weight over all terms of a query.
    """
    asked = terms.groupBy(F.col("term").alias("query_id")).agg(F.first("embedding").alias("embedding"))  # each term once
    near = knn(asked, vectors, candidates).select(F.col("query_id").alias("term"), F.col("vec_id").alias("doc_id"), "similarity")
    scored = near.join(terms.select("query_id", "term", "weight"), "term")
    best = scored.groupBy("query_id", "doc_id").agg(F.max(F.round(F.col("similarity") * F.col("weight"), 6)).alias("score"))
    ranked = first_by(best, ["query_id"], F.desc("score"), F.col("doc_id"), n=candidates, rank="rank")
    return rerank(ranked.join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id"), k)


def overlap_rank(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): documents by the share of the query's distinct words that they hold, over all that hold any."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("words"))
    asked = asked.select("query_id", F.size("words").alias("n"), F.explode("words").alias("w"))
    held = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    shared = held.join(small(asked), "w").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("m"))
    return first_by(shared.select("query_id", "doc_id", F.round(F.col("m") / F.col("n"), 6).alias("score")), ["query_id"], F.desc("score"), F.col("doc_id"), n=k, rank="rank")


def name_search(names: DataFrame, rows: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(query_id, item, score, source): table rows by name (0.98 exact, 0.85 partial, two a name), and hits (query_id, doc_id, text, d) that hold the name or two of its words (0.95 / (1 + d))."""
    from .tables import find_by_name

    found = find_by_name(rows, names.select(F.col("name").alias("query")))
    found = first_by(found, ["query"], F.desc("exact"), F.col("row_id"), n=2).join(names.withColumnRenamed("name", "query"), "query")
    structured = found.select("query_id", F.col("row_id").cast("string").alias("item"), F.when(F.col("exact"), 0.98).otherwise(0.85).alias("score"), F.lit("table_rows").alias("source"))
    words = F.filter(tokens(F.col("name")), lambda w: F.length(w) > 2)
    both = hits.join(names, "query_id")
    shared = F.size(F.array_intersect(words, tokens(F.col("text"))))
    matched = both.where(F.contains(F.lower("text"), F.lower("name")) | (shared >= 2))
    vector = matched.select("query_id", F.col("doc_id").cast("string").alias("item"), F.round(0.95 / (1 + F.col("d")), 6).alias("score"), F.lit("vector_db").alias("source"))
    best = structured.unionByName(vector).groupBy("query_id", "item", "source").agg(F.max("score").alias("score"))
    return first_by(best, ["query_id"], F.desc("score"), F.col("source"), F.col("item"), n=k)


def structured_search(queries: DataFrame, rows: DataFrame, routes: dict[str, list[str]], k: int) -> DataFrame:
    """(query_id, row_id, score): rows of the kind a query's keywords ask for.

    A row whose name has a word of the query scores 0.95 (two rows a word); others of
    the kind fill up to ``k`` with 0.5 + 0.4 times the share of words in their name.
    """
    kind = F.coalesce(*[F.when(F.exists(tokens(F.col("query")), lambda w: w.isin(*keys)), F.lit(name)) for name, keys in routes.items()])
    asked = queries.select("query_id", kind.alias("table_type"), F.filter(F.array_distinct(tokens(F.col("query"))), lambda w: F.length(w) > 2).alias("words")).where("table_type is not null")
    named = rows.select("row_id", "table_type", F.array_distinct(tokens(F.col("nome"))).alias("name_words"))
    hits = asked.select("query_id", "table_type", F.size("words").alias("n"), F.explode("words").alias("w")).join(named.select("row_id", "table_type", F.explode("name_words").alias("w")), ["table_type", "w"])
    exact = first_by(hits, ["query_id", "w"], F.col("row_id"), n=2).select("query_id", "row_id", F.lit(0.95).alias("score"))
    share = hits.groupBy("query_id", "row_id", "n").agg(F.count("*").alias("m")).select("query_id", "row_id", F.round(0.5 + 0.4 * F.col("m") / F.col("n"), 6).alias("score"))
    fill = first_by(named, ["table_type"], F.col("row_id"), n=k).join(asked, "table_type").select("query_id", "row_id", F.lit(0.5).alias("score"))
    best = prioritised([exact, share, fill], ["query_id", "row_id"], F.desc("score")).drop("priority")
    return first_by(best, ["query_id"], F.desc("score"), F.col("row_id"), n=k)


def infer_entities(queries: DataFrame, names: DataFrame, patterns: list[str]) -> DataFrame:
    """(query_id, entities): texts that question patterns capture and catalogue names whose words the query holds, sorted."""
    caught = F.flatten(F.array(*[F.regexp_extract_all(F.lower("query"), F.lit(p), F.lit(1)) for p in patterns]))
    by_pattern = queries.select("query_id", F.explode(caught).alias("entity")).select("query_id", F.trim("entity").alias("entity")).where("entity <> ''")
    from .common import contains_join

    by_name = contains_join(names.select("name"), queries, "name", "query", "query_id").select("query_id", F.lower("name").alias("entity"))
    return by_pattern.unionByName(by_name).groupBy("query_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def entity_contexts(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, row_id, score): rows of an entity (0.9) and all rows of their tables (0.7), each once at its best.

    The result is as large as its pairs, so these are not grouped: those by name come
    first, and a row of a table that has none of the names comes by the first table it
    shares with the query.
    """
    asked = entities.groupBy("query_id").agg(F.collect_set(F.lower("entity")).alias("keys"))  # of one query
    listed = rows.groupBy("row_id").agg(F.collect_set(F.lower("nome")).alias("names"), F.collect_set("table_id").alias("tables"))  # of one row
    keyed = asked.select("query_id", F.explode("keys").alias("key"))
    own = keyed.join(listed.select("row_id", F.explode("names").alias("key")), "key").select("query_id", "row_id").distinct()
    held = keyed.join(rows.where("table_id is not null").select(F.lower("nome").alias("key"), "table_id").distinct(), "key")
    held = held.groupBy("query_id").agg(F.collect_set("table_id").alias("theirs")).join(asked, "query_id")
    placed = small(written(held.select("query_id", "keys", "theirs", F.explode("theirs").alias("table_id"))))
    both = listed.select("row_id", "names", "tables", F.explode("tables").alias("table_id")).join(placed, "table_id")
    first = (F.size("tables") == 1) | (F.get(F.array_intersect("tables", "theirs"), F.lit(0)) == F.col("table_id"))
    others = both.where(~F.arrays_overlap("names", "keys") & first)
    return own.select("query_id", "row_id", F.lit(0.9).alias("score")).unionByName(others.select("query_id", "row_id", F.lit(0.7).alias("score")))


def merge_results(results: DataFrame) -> DataFrame:
    """The best result for each entity, source and first hundred characters."""
    return first_by(results.withColumn("head", F.substring("content", 1, 100)), ["entity_name", "source", "head"], F.desc("score"), F.col("result_id")).drop("head")


def hybrid_query(branches: list[DataFrame], k: int) -> DataFrame:
    """Branches (query_id, item, score, source) merged, best score for each item and source, top k a query."""
    rows = prioritised(branches, ["query_id", "source", "item"], F.desc("score")).drop("priority")
    return first_by(rows, ["query_id"], F.desc("score"), F.col("source"), F.col("item"), n=k)


def win_shares(compared: DataFrame, power_a: str, power_b: str) -> DataFrame:
    """Win share of each side in percent, by power."""
    total = F.col(power_a) + F.col(power_b)
    share = F.when(total == 0, 50.0).otherwise(F.rint(F.col(power_a) / total * 1000) / 10)
    return compared.withColumn("share_a", share).withColumn("share_b", F.rint((100 - F.col("share_a")) * 10) / 10)


def recommend(items: DataFrame, constraints: DataFrame, k: int) -> DataFrame:
    """Equipment within budget, of the wanted type, whose strength requirement is met; score 0.7 efficiency + 0.3 / (pe + 1).

    ``constraints`` (query_id, budget, strength, kind) are paired by kind; a null constraint allows everything.
    """
    needs = F.coalesce(F.regexp_extract("requisitos", r"(\d+)", 1).try_cast("int"), F.lit(0))
    fit = (F.col("pe") <= F.coalesce("budget", F.lit(1 << 30))) & (needs <= F.coalesce("strength", F.lit(1 << 30))) & F.contains(F.lower("tipo"), F.lower(F.coalesce("kind", F.lit(""))))
    kinds = meet_all(items.select("tipo").distinct(), constraints, "query_id").where(F.contains(F.lower("tipo"), F.lower(F.coalesce("kind", F.lit("")))))
    scored = items.join(kinds, "tipo").where(fit).withColumn("score", F.round(0.7 * F.col("efficiency") + 0.3 / (F.col("pe") + 1), 6))
    return first_by(scored, ["query_id"], F.desc("score"), F.col("row_id"), n=k, rank="rank")


def retrieve_by_entity(results: DataFrame, target: str, label: str | None = None) -> DataFrame:
    """Results whose recorded entities (map of label to list) hold ``target``."""
    holds = F.exists(F.map_entries("entities"), lambda e: (F.lit(True) if label is None else e["key"] == label) & F.exists(e["value"], lambda x: F.contains(F.lower(x), F.lit(target.lower()))))
    return results.where(holds)


def catalog_search(queries: DataFrame, entries: DataFrame, weights: tuple[int, ...] = (400, 200, 90, 40, 8, 140), k: int = 5) -> DataFrame:
    """(query_id, entry_id, score, rank) of entries (entry_id, title, text) that share a word with the query.

    Title equal, title contains, text contains, each word in the title, each in the text, all words in the title.
    """
    equal, inside, text, word, text_word, every = weights
    asked = queries.select("query_id", fold(F.trim("query")).alias("q"), F.array_distinct(tokens(fold(F.col("query")))).alias("words"))
    listed = entries.select("entry_id", fold(F.col("title")).alias("t"), fold(F.col("text")).alias("x"))
    # entries of equal titles and texts score alike: the first k of them are ranked as one
    alike = first_by(listed.repartition("entry_id"), ["t", "x"], F.col("entry_id"), n=k).groupBy("t", "x").agg(F.collect_list("entry_id").alias("ids"))
    held = alike.withColumn("held", F.array_distinct(tokens(F.concat_ws(" ", "t", "x"))))
    both = small(asked.withColumn("w", F.explode("words"))).join(held.withColumn("w", F.explode("held")), "w")
    both = both.where(F.get(F.array_intersect("words", "held"), F.lit(0)) == F.col("w"))  # once, by the first word of both
    in_title = F.size(F.filter("words", lambda w: F.contains(F.col("t"), w)))
    in_text = F.size(F.filter("words", lambda w: F.contains(F.col("x"), w)))
    score = (
        F.when(F.col("t") == F.col("q"), equal).otherwise(0)
        + F.when(F.contains("t", "q"), inside).otherwise(0)
        + F.when(F.contains("x", "q"), text).otherwise(0)
        + word * in_title
        + text_word * in_text
        + F.when(in_title == F.size("words"), every).otherwise(0)
    )
    scored = both.select("query_id", "ids", score.alias("score")).where("score > 0")
    best = first_by(scored, ["query_id"], F.desc("score"), F.array_min("ids"), n=k)  # k of them have k entries at least
    return first_by(best.select("query_id", "score", F.explode("ids").alias("entry_id")), ["query_id"], F.desc("score"), F.col("entry_id"), n=k, rank="rank")


def catalog_entries(catalogs: dict[str, DataFrame]) -> DataFrame:
    """(kind, entry_id, title, text) of several catalogues."""
    parts = [df.select(F.lit(kind).alias("kind"), "entry_id", "title", "text") for kind, df in catalogs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def shape_results(results: DataFrame) -> DataFrame:
    """(query_id, kind, n, best, sources): results of each kind counted, with their best score and number of sources."""
    return results.groupBy("query_id", "kind").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.count_distinct("source").alias("sources"))


def compare_systems(old: DataFrame, new: DataFrame) -> DataFrame:
    """(query_id, both, only_old, only_new): result sets (query_id, item) of two systems."""
    rows = old.select("query_id", "item", F.lit(1).alias("o")).distinct().join(new.select("query_id", "item", F.lit(1).alias("n")).distinct(), ["query_id", "item"], "full")
    return rows.groupBy("query_id").agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("both"), F.count_if(F.col("n").isNull()).alias("only_old"), F.count_if(F.col("o").isNull()).alias("only_new"))


def asset_search(assets: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Assets (asset_id, kind, related, context, size) with the query in a related entity or in their context, largest first."""
    low = F.lit(query.lower())
    hit = F.exists("related", lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), low)) | F.contains(F.lower(F.coalesce("context", F.lit(""))), low)
    found = assets.where(hit if kind is None else hit & (F.col("kind") == kind))
    return found.orderBy(F.desc("size"), "asset_id")


def assets_by_words(assets: DataFrame, query: str, kind: str | None = None, k: int = 10) -> DataFrame:
    """The ``k`` assets whose context holds most distinct words of the query, with ``score``; those without any go."""
    asked = F.array_distinct(tokens(F.lit(query)))
    score = F.size(F.array_intersect(asked, tokens(F.coalesce("context", F.lit("")))))
    rows = (assets if kind is None else assets.where(F.col("kind") == kind)).withColumn("score", score)
    return rows.where("score > 0").orderBy(F.desc("score"), F.desc("size"), "asset_id").limit(k)


def assets_of_kind(assets: DataFrame, kind: str) -> DataFrame:
    return assets.where(F.col("kind") == kind)


def asset_counts(assets: DataFrame) -> DataFrame:
    """(kind, n, sources): assets and distinct sources of each kind."""
    return assets.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


def neighbour_ratio(triples: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, c, ratio): distance of a to c over that of a to b for probe triples."""
    rows = triples
    for name in "abc":
        rows = rows.join(vectors.select(F.col("vec_id").alias(name), F.col("embedding").alias(f"v{name}")), name)
    far, close = (F.sqrt(squared_distance(F.col("va"), F.col(v))) for v in ("vc", "vb"))
    return rows.select("a", "b", "c", F.round(far / close, 6).alias("ratio"))
