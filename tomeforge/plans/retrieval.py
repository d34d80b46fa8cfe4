"""Queries of retrieval, knowledge lookup and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.vector import is_normalized, normalized
from ..operators import graph, indexes, retrieval
from ..operators.common import first_by
from ..plugins import embed_with_cache
from ..sources import io
from .binding import EQUIPMENT_ROWS, Registry, duck, equipment_table, table

R = Registry()


def bm25_of(asked: str) -> str:
    """CTEs for BM25 ranks ``r`` of queries (query_id, query)."""
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents), tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM f, tot), m AS (SELECT avg(idf) AS mean FROM i),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM ({asked})) GROUP BY ALL),
wt AS (SELECT query_id, term, times * CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS weight FROM q JOIN i USING (term), m),
s AS (SELECT query_id, doc_id, round(sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN wt USING (term), tot GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


BM25 = bm25_of("SELECT item_id AS query_id, text AS query FROM benchmark")


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@R.add(BM25 + " SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf):
    return retrieval.bm25(_queries(spark, sf), _docs(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


#: The query set of vector searches: every twentieth vector, against all vectors.
ASKED = "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0"
DISTANCE = "list_sum(list_transform(list_zip(q, embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"


def _vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), vectors


@R.add(f"WITH s AS (SELECT query_id, vec_id, round({DISTANCE}, 6) AS d FROM embeddings, ({ASKED})), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(1 / (1 + d), 6) AS similarity, rank FROM r WHERE rank <= 10")
def knn_topk(spark, sf):
    asked, vectors = _vectors(spark, sf)
    return retrieval.knn(asked, vectors).withColumn("rank", F.col("rank").cast("long"))


@R.add()
def knn_by_cells(spark, sf):
    asked, vectors = _vectors(spark, sf)
    return retrieval.knn_cells(asked, vectors, cells=8, probes=6)


@R.add(BM25 + " SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_stored(spark, sf):
    """The rows of bm25_topk from postings that are written first."""
    path = io.work_dir(spark)
    indexes.build_postings(_docs(spark, sf), path)
    return indexes.search_postings(_queries(spark, sf), path).withColumn("rank", F.col("rank").cast("long"))


@R.add()
def knn_by_codes(spark, sf):
    """The neighbours of all queries from an index of cells that is written first; these vectors have no clusters, so most cells are probed."""
    asked, vectors = _vectors(spark, sf)
    path = io.work_dir(spark)
    indexes.build_cells(vectors, path, cells=8)
    return indexes.search_cells(asked, path, probes=6)


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@R.add(f"""WITH s AS (SELECT query_id, vec_id, round({DOT.format(a='q', b='embedding')} / sqrt({DOT.format(a='q', b='q')}) / sqrt({DOT.format(a='embedding', b='embedding')}), 6) AS cosine FROM embeddings, ({ASKED})),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, cosine, rank FROM r WHERE rank <= 20""")
def cosine_rank(spark, sf):
    asked, vectors = _vectors(spark, sf)
    return retrieval.cosine_rank(asked, vectors, 20).withColumn("rank", F.col("rank").cast("long"))


@R.add(f"SELECT vec_id, round(list_sum(embedding) / sqrt({DOT.format(a='embedding', b='embedding')}), 4) AS total, true AS unit FROM embeddings")
def normalized_vectors(spark, sf):
    unit = normalized(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 4).alias("total"), is_normalized(unit).alias("unit"))


#: Documents and vectors share ids; a benchmark query has the vector of its own id.
SEMANTIC = f"""sv AS (SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id), sd AS (SELECT query_id, vec_id AS doc_id, round({DISTANCE}, 6) AS d FROM embeddings, sv),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rank FROM sd), c AS (SELECT query_id, doc_id, round(1 / (1 + d), 6) AS sem FROM sr WHERE rank <= 20)"""
MIXED = """h AS (SELECT query_id, doc_id, coalesce(max(sem), 0) AS sem, coalesce(max(bm25), 0) AS bm25 FROM (SELECT query_id, doc_id, sem, NULL AS bm25 FROM c UNION ALL SELECT query_id, doc_id, NULL, bm25 FROM l) GROUP BY ALL),
n AS (SELECT query_id, doc_id, CASE WHEN max(sem) OVER w = min(sem) OVER w THEN 0.5 ELSE (sem - min(sem) OVER w) / (max(sem) OVER w - min(sem) OVER w) END AS sem,
  CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 0.5 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS bm25 FROM h WINDOW w AS (PARTITION BY query_id)),
u AS (SELECT query_id, doc_id, round(0.7 * sem + 0.3 * bm25, 6) AS score FROM n), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u)"""
FUSED = BM25 + f", l AS (SELECT query_id, doc_id, score AS bm25 FROM r WHERE rank <= 20), {SEMANTIC}, {MIXED}"


def _query_vectors(spark, sf):
    return table(spark, sf, "embeddings").join(_queries(spark, sf).select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")


def _fused(spark, sf):
    lexical = retrieval.bm25(_queries(spark, sf), _docs(spark, sf), 20).select("query_id", "doc_id", "score")
    near = retrieval.knn(_query_vectors(spark, sf), table(spark, sf, "embeddings"), 20)
    return retrieval.fuse(retrieval.aggregate_hits(near.select("query_id", F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score")), lexical))


@R.add(FUSED + " SELECT query_id, doc_id, score, rank FROM z WHERE rank <= 5")
def hybrid_fusion(spark, sf):
    return retrieval.cut(_fused(spark, sf), 20, 5).withColumn("rank", F.col("rank").cast("long"))


OVERLAP = r"len(list_intersect(list_distinct(regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}_]+')), list_distinct(regexp_extract_all(lower({d}), '[\p{{L}}\p{{N}}_]+')))) / CAST(len(list_distinct(regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}_]+'))) AS DOUBLE)"


@R.add(FUSED + f""", p AS (SELECT z.query_id, z.doc_id, z.rank, round({OVERLAP.format(q='b.text', d='d.text')}, 6) AS rerank_score FROM z JOIN benchmark b ON b.item_id = z.query_id JOIN documents d ON d.doc_id = z.doc_id),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id) AS final_rank FROM p) SELECT query_id, doc_id, rerank_score, final_rank FROM fin WHERE final_rank <= 5""")
def reranked(spark, sf):
    candidates = _fused(spark, sf).join(_queries(spark, sf), "query_id").join(_docs(spark, sf), "doc_id")
    return retrieval.rerank(candidates, 5).select("query_id", "doc_id", "rerank_score", F.col("final_rank").cast("long"))


VARIANTS = r"""SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS variant_no, query FROM (
  SELECT item_id, unnest([text, CASE WHEN lower(text) <> key THEN key END, CASE WHEN length(key) < 30 THEN 'regra de ' || key ELSE 'explicar ' || substr(key, 1, 40) END]) AS query, generate_subscripts([1, 2, 3], 1) AS pos
  FROM (SELECT item_id, trim(text) AS text, trim(regexp_replace(regexp_replace(lower(text), '[?.!,•·—()]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM benchmark)) WHERE query IS NOT NULL"""


@R.add(bm25_of(f"SELECT {{'q': item_id, 'v': variant_no}} AS query_id, query FROM ({VARIANTS})") + f""", l AS (SELECT query_id.q AS query_id, doc_id, max(score) AS bm25 FROM r WHERE rank <= 20 GROUP BY ALL), {SEMANTIC}, {MIXED},
p AS (SELECT z.query_id, z.doc_id, z.rank, CASE WHEN count(*) OVER (PARTITION BY z.query_id) = 1 THEN 1.0 ELSE round({OVERLAP.format(q='trim(b.text)', d='d.text')}, 6) END AS rerank_score FROM z JOIN benchmark b ON b.item_id = z.query_id JOIN documents d ON d.doc_id = z.doc_id WHERE z.rank <= 40),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id) AS final_rank FROM p) SELECT query_id, doc_id, rerank_score, final_rank FROM fin WHERE final_rank <= 5""")
def hybrid_retrieve(spark, sf):
    """Variants of the benchmark queries by BM25 and vectors, fused and reranked."""
    variants = graph.query_variants(_queries(spark, sf))
    rows = retrieval.retrieve(variants, _docs(spark, sf), table(spark, sf, "embeddings"), _query_vectors(spark, sf))
    return rows.select("query_id", "doc_id", "rerank_score", F.col("final_rank").cast("long"))


@R.add(f"""WITH t AS (SELECT item_id AS query_id, unnest(string_split(text, ' ')[1:4]) AS term, generate_subscripts(string_split(text, ' ')[1:4], 1) AS term_no FROM benchmark),
e AS (SELECT DISTINCT term AS query_id, embedding AS q FROM t JOIN embeddings ON vec_id = (ascii(term) * 31 + length(term)) % 100), sd AS (SELECT query_id AS term, vec_id AS doc_id, round({DISTANCE}, 6) AS d FROM embeddings, e),
sr AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY d, doc_id) AS rank FROM sd), b AS (SELECT query_id, doc_id, max(round(round(1 / (1 + d), 6) * CASE WHEN term_no = 1 THEN 1.0 ELSE 0.8 END, 6)) AS score FROM sr JOIN t USING (term) WHERE rank <= 20 GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b),
p AS (SELECT z.query_id, z.doc_id, z.rank, CASE WHEN count(*) OVER (PARTITION BY z.query_id) = 1 THEN 1.0 ELSE round({OVERLAP.format(q='b.text', d='d.text')}, 6) END AS rerank_score FROM z JOIN benchmark b ON b.item_id = z.query_id JOIN documents d ON d.doc_id = z.doc_id WHERE z.rank <= 20),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id) AS final_rank FROM p) SELECT query_id, doc_id, rerank_score, final_rank FROM fin WHERE final_rank <= 5""")
def weighted_retrieve(spark, sf):
    """The first four words of queries as expanded terms, each with a vector of the vector table."""
    words = F.slice(F.split("query", " "), 1, 4)
    terms = _queries(spark, sf).select("query_id", F.posexplode(words).alias("term_no", "term")).withColumn("weight", F.when(F.col("term_no") == 0, 1.0).otherwise(0.8))
    vectors = table(spark, sf, "embeddings")
    terms = terms.withColumn("vec_id", ((F.ascii("term") * 31 + F.length("term")) % 100).cast("long")).join(vectors.select("vec_id", "embedding"), "vec_id")
    rows = retrieval.retrieve_weighted(terms, vectors, _docs(spark, sf), _queries(spark, sf))
    return rows.select("query_id", "doc_id", "rerank_score", F.col("final_rank").cast("long"))


@R.add("SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label, vec_id % 7 ORDER BY embedding[1] DESC, vec_id) AS p FROM embeddings) WHERE p = 1")
def dedup_best(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("result_id"), F.col("label").alias("entity_name"), (F.col("vec_id") % 7).alias("source"), F.lit("x").alias("content"), F.col("embedding")[0].alias("score"))
    return retrieval.merge_results(rows).select(F.col("result_id").alias("vec_id"), F.col("entity_name").alias("label"))


EQUIPMENT = duck(EQUIPMENT_ROWS)


@R.add(f"""WITH c(query_id, budget, kind) AS (VALUES (1, 10, 'arma'), (2, 30, 'armadura'), (3, NULL, NULL)),
e AS (SELECT row_id, pe, CASE WHEN dano <> '' THEN 'arma' WHEN defesa IS NOT NULL THEN 'armadura' ELSE 'item' END AS tipo, preco / 1000 AS efficiency FROM ({EQUIPMENT})),
s AS (SELECT query_id, row_id, round(0.7 * efficiency + 0.3 / (pe + 1), 6) AS score FROM e, c WHERE (budget IS NULL OR pe <= budget) AND contains(tipo, coalesce(kind, ''))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s) SELECT query_id, row_id, score, rank FROM r WHERE rank <= 10""")
def equipment_rank(spark, sf):
    from ..operators.tables import equipment_rows

    items = equipment_rows(equipment_table(spark, sf)).withColumns({"requisitos": F.lit(None).cast("string"), "efficiency": F.col("preco") / 1000})
    asked = spark.createDataFrame([(1, 10, None, "arma"), (2, 30, None, "armadura"), (3, None, None, None)], "query_id int, budget int, strength int, kind string")
    return retrieval.recommend(items, asked, 10).select("query_id", "row_id", "score", F.col("rank").cast("long"))


@R.add(f"SELECT item_id AS query_id, variant_no, query FROM ({VARIANTS})")
def query_variants(spark, sf):
    return graph.query_variants(_queries(spark, sf)).withColumn("variant_no", F.col("variant_no").cast("long"))


@R.add("SELECT conv_id, turn, 0 AS place, 'the phrase' AS phrase FROM conversations WHERE contains(lower(text), 'tion') UNION ALL SELECT conv_id, turn, CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END, 'other' FROM conversations WHERE contains(lower(text), 'ment')")
def synonym_phrases(spark, sf):
    chats = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    return graph.synonyms(chats, {"tion": ["the phrase"], "ment": ["other"]}).select("query_id.*", F.col("place"), "phrase")


def _edges(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    inside = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("is_a").alias("relation"), F.col("r_name").alias("dst"))
    sells = table(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.lit("element").alias("relation"), F.col("n_name").alias("dst"))
    return inside.unionByName(sells)


def _entities(spark, sf):
    return _edges(spark, sf).select(F.explode(F.array("src", "dst")).alias("name")).distinct()


EDGES = "SELECT n_name AS src, 'is_a' AS relation, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, 'element', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@R.add(f"SELECT DISTINCT n_nationkey AS query_id, src, relation, dst FROM nation JOIN ({EDGES}) ON upper(src) = upper(n_name)")
def relations_of(spark, sf):
    return graph.relations_for(table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("name")), _edges(spark, sf))


@R.add("""WITH e AS (SELECT DISTINCT p_name AS entity FROM part), q AS (SELECT p_partkey AS query_id, lower('the ' || p_name) AS q FROM part), m AS (SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY length(entity) DESC, entity) AS p FROM q JOIN e ON contains(q, lower(entity))) SELECT query_id, entity FROM m WHERE p = 1""")
def matched_entities(spark, sf):
    part = table(spark, sf, "part")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("the "), "p_name").alias("query"))
    return graph.match_entity(asked, part.select(F.col("p_name").alias("name")).distinct())


@R.add(f"""WITH g AS ({EDGES}), s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT s_suppkey AS query_id, s_name AS term, 1.0 AS weight, 0 AS tier FROM s UNION ALL SELECT s_suppkey, n_name, 0.9, 1 FROM s
  UNION ALL SELECT q.s_suppkey, m.s_name, 0.7, 2 FROM s q JOIN s m ON m.s_nationkey = q.s_nationkey AND m.s_name <> q.s_name
  UNION ALL SELECT s_suppkey, '1 a ' || s_suppkey || ' PM', 0.8, 3 FROM s WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'heals ' || n_name, 0.8, 3 FROM s
  UNION ALL SELECT s_suppkey, 'school of ' || r_name, 0.8, 4 FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, term) AS p FROM t) SELECT query_id, term, CAST(weight AS DOUBLE) AS weight FROM r WHERE p <= 8""")
def expand_graph(spark, sf):
    """Suppliers as queries: their nation, mates, costs (bare numbers among them, which are none), effects and a school that is no entity."""
    s, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    asked = s.select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("query"))
    members = s.select(F.col("s_nationkey").alias("cluster_id"), F.col("s_name").alias("entity"))
    placed = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey").cast("string")
    more = {"cost_pm": F.when(F.col("s_suppkey") % 2 == 0, key).otherwise(F.concat(F.lit("1 a "), key)), "effect": F.concat(F.lit("heals "), "n_name"), "school": F.concat(F.lit("school of "), "r_name")}
    edges = _edges(spark, sf)
    for relation, target in more.items():
        edges = edges.unionByName(placed.select(F.col("s_name").alias("src"), F.lit(relation).alias("relation"), target.alias("dst")))
    return graph.expand_with_graph(asked, edges, _entities(spark, sf), members, limit=8)


@R.add(f"""WITH RECURSIVE g AS ({EDGES}), u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), w AS (SELECT r_name AS seed, r_name AS node, 0 AS hop FROM region UNION SELECT seed, dst, hop + 1 FROM w JOIN u ON src = node WHERE hop < 3)
SELECT seed, node, min(hop) AS hop FROM w GROUP BY seed, node""")
def neighbourhood(spark, sf):
    return graph.neighbourhood(table(spark, sf, "region").select(F.col("r_name").alias("node")), _edges(spark, sf), 3)


@R.add("SELECT DISTINCT p_name AS term FROM part WHERE p_name LIKE '% %' AND p_name NOT LIKE 'red %'")
def valid_terms(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return graph.valid_terms(names.select(F.col("name").alias("term")), names, prefixes=["red"], stop_words=rules.STOP_WORDS, share=1.0)


@R.add("SELECT s_name AS name, s_nationkey AS cluster_id, count(*) OVER (PARTITION BY s_nationkey) AS mates FROM supplier")
def clusters_of(spark, sf):
    s = table(spark, sf, "supplier")
    members = s.select(F.col("s_nationkey").alias("cluster_id"), F.upper("s_name").alias("entity"))
    own = graph.cluster_of(s.select(F.col("s_name").alias("name")), members)
    n = graph.members_of(own.select("cluster_id").distinct(), members).groupBy("cluster_id").agg(F.count("*").alias("mates"))
    return own.join(n, "cluster_id").select("name", "cluster_id", "mates")


@R.add(f"""WITH g AS ({EDGES}), c AS (SELECT s_nationkey AS k, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS p FROM supplier)
SELECT s_suppkey AS query_id, s_name AS entity, 'element ' || n_name AS relations, 'balance=' || CAST(round(s_acctbal) AS BIGINT) AS properties,
  least(5, (SELECT count(*) FROM supplier x WHERE x.s_nationkey = s.s_nationkey AND x.s_name <> s.s_name)) AS n_mates FROM supplier s JOIN nation ON s_nationkey = n_nationkey""")
def enriched_queries(spark, sf):
    """What the graph knows of each supplier, at most five of each kind: the limit is the feature."""
    s = table(spark, sf, "supplier")
    asked = s.select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("query"))
    props = s.select(F.col("s_name").alias("name"), F.lit("balance").alias("key"), F.round("s_acctbal").cast("long").cast("string").alias("value"))
    members = s.select(F.col("s_nationkey").alias("cluster_id"), F.col("s_name").alias("entity"))
    rows = graph.enrich_queries(asked, _edges(spark, sf), props, members, _entities(spark, sf))
    return rows.select("query_id", "entity", F.array_join("relations", ";").alias("relations"), F.array_join("properties", ";").alias("properties"), F.coalesce(F.size("mates"), F.lit(0)).cast("long").alias("n_mates"))


@R.add(r"""WITH c AS (SELECT p_partkey AS entry_id, lower(p_name) AS t, lower(p_type || ' ' || p_brand) AS x FROM part), q AS (SELECT min(p_partkey) AS query_id, lower(p_name) AS q, string_split(lower(p_name), ' ') AS words FROM part GROUP BY p_name UNION ALL SELECT -min(p_partkey), lower(p_type), string_split(lower(p_type), ' ') FROM part GROUP BY p_type),
s AS (SELECT query_id, entry_id, CASE WHEN t = q THEN 400 ELSE 0 END + CASE WHEN contains(t, q) THEN 200 ELSE 0 END + CASE WHEN contains(x, q) THEN 90 ELSE 0 END + 40 * len(list_filter(words, lambda w: contains(t, w))) + 8 * len(list_filter(words, lambda w: contains(x, w)))
  + CASE WHEN len(list_filter(words, lambda w: contains(t, w))) = len(words) THEN 140 ELSE 0 END AS score FROM q, c WHERE len(list_intersect(words, regexp_extract_all(t || ' ' || x, '[\p{L}\p{N}_]+'))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s) SELECT query_id, entry_id, CAST(score AS BIGINT) AS score, rank FROM r WHERE rank <= 20""")
def catalog_search(spark, sf):
    entries = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    p = table(spark, sf, "part")
    asked = p.groupBy(F.col("p_name").alias("query")).agg(F.min("p_partkey").alias("query_id")).unionByName(p.groupBy(F.col("p_type").alias("query")).agg((-F.min("p_partkey")).alias("query_id")))
    return retrieval.catalog_search(asked, entries, k=20).select("query_id", "entry_id", F.col("score").cast("long"), F.col("rank").cast("long"))


@R.add("SELECT kind, count(*) AS n, min(title) AS first FROM (SELECT 'part' AS kind, p_name AS title FROM part UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'nation', n_name FROM nation) GROUP BY kind")
def catalog_entries(spark, sf):
    parts = {k: table(spark, sf, k).select(F.col(f"{k[0]}_{'partkey' if k == 'part' else 'suppkey' if k == 'supplier' else 'nationkey'}").cast("long").alias("entry_id"), F.col(f"{k[0]}_name").alias("title"), F.lit("").alias("text")) for k in ("part", "supplier", "nation")}
    return retrieval.catalog_entries(parts).groupBy("kind").agg(F.count("*").alias("n"), F.min("title").alias("first"))


@R.add(BM25 + " SELECT query_id, lang AS kind, count(*) AS n, max(score) AS best, count(DISTINCT source) AS sources FROM r JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY query_id, lang")
def shaped_results(spark, sf):
    meta = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("kind"), "source")
    return retrieval.shape_results(retrieval.bm25(_queries(spark, sf), _docs(spark, sf)).join(meta, "doc_id"))


@R.add(BM25 + " SELECT query_id, count(*) FILTER (rank <= 5) AS both, count(*) FILTER (rank > 5) AS only_old, 0 AS only_new FROM r WHERE rank <= 10 GROUP BY query_id")
def compared_systems(spark, sf):
    old = retrieval.bm25(_queries(spark, sf), _docs(spark, sf)).withColumn("item", F.col("doc_id"))
    return retrieval.compare_systems(old, old.where("rank <= 5"))


@R.add(f"""WITH t AS (SELECT vec_id AS a, vec_id + 1 AS b, vec_id + 2 AS c FROM embeddings WHERE vec_id + 2 < (SELECT count(*) FROM embeddings))
SELECT a, b, c, round(sqrt(list_sum(list_transform(list_zip(x.embedding, z.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) ** 2))) / sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) ** 2))), 6) AS ratio
FROM t JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b JOIN embeddings z ON z.vec_id = c""")
def neighbour_ratio(spark, sf):
    v = table(spark, sf, "embeddings")
    triples = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("vec_id") + 2).alias("c"))
    return retrieval.neighbour_ratio(triples, v)


@R.add("""WITH r AS (SELECT p_partkey AS row_id, p_name AS nome, p_brand AS table_id FROM part), e AS (SELECT min(p_partkey) AS query_id, p_name AS entity FROM part GROUP BY p_name), o AS (SELECT DISTINCT query_id, row_id, table_id FROM e JOIN r ON lower(entity) = lower(nome)),
b AS (SELECT query_id, row_id, 0.9 AS score FROM o UNION ALL SELECT DISTINCT query_id, r.row_id, 0.7 FROM (SELECT DISTINCT query_id, table_id FROM o) JOIN r USING (table_id)) SELECT query_id, row_id, CAST(max(score) AS DOUBLE) AS score FROM b GROUP BY ALL""")
def entity_contexts(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("nome"), F.col("p_brand").alias("table_id"))
    return retrieval.entity_contexts(part.groupBy(F.col("p_name").alias("entity")).agg(F.min("p_partkey").alias("query_id")), rows)


@R.add("SELECT c_custkey AS query_id, list_sort([lower(c_name), 'customer']) AS entities FROM customer")
def inferred_entities(spark, sf):
    """One entity by a question pattern, the other from the catalogue of names."""
    c = table(spark, sf, "customer")
    asked = c.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("what is customer? about "), "c_name", F.lit(" please")).alias("query"))
    return retrieval.infer_entities(asked, c.select(F.col("c_name").alias("name")), [r"what is (\w+)\?"])


@R.add("SELECT p_partkey AS asset_id FROM part WHERE (lower(p_brand) = 'brand#2' OR contains(lower(p_type || ' ' || p_brand), 'brand#2')) AND p_name LIKE '%ring%'")
def asset_search(spark, sf):
    assets = table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), F.element_at(F.split("p_name", " "), -1).alias("kind"), F.array("p_brand").alias("related"), F.concat_ws(" ", "p_type", "p_brand").alias("context"), F.col("p_size").alias("size"))
    return retrieval.asset_search(assets, "Brand#2", "ring").select("asset_id")


@R.add("SELECT split_part(p_name, ' ', -1) AS kind, count(*) AS n, count(DISTINCT p_brand) AS sources FROM part GROUP BY 1")
def asset_counts(spark, sf):
    return retrieval.asset_counts(table(spark, sf, "part").select(F.element_at(F.split("p_name", " "), -1).alias("kind"), F.col("p_brand").alias("source")))


@R.add(r"""WITH a AS (SELECT p_partkey AS asset_id, p_size, len(list_intersect(['small', 'economy', 'steel'], regexp_extract_all(lower(p_type), '[\p{L}\p{N}_]+'))) AS score FROM part)
SELECT asset_id, CAST(score AS INT) AS score FROM a WHERE score > 0 ORDER BY score DESC, p_size DESC, asset_id LIMIT 30""")
def assets_by_words(spark, sf):
    assets = table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_type").alias("context"), F.col("p_size").alias("size"))
    return retrieval.assets_by_words(assets, "Small economy STEEL", k=30).select("asset_id", "score")


@R.add("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget')")
def results_by_entity(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.create_map(F.lit("ner_names"), F.array("p_name"), F.lit("other"), F.array("p_type")).alias("entities"))
    return retrieval.retrieve_by_entity(rows, "Widget", "ner_names").select("p_partkey")


#: Names to search for, each with the vector of its id times 20 and the 50 texts nearest to that.
NAMED = [(1, "ring"), (2, "red widget"), (3, "the house of"), (4, "idiot")]
HITS = f"""n(query_id, name) AS (VALUES {", ".join(map(str, NAMED))}), v AS (SELECT query_id, embedding AS q FROM n JOIN embeddings ON vec_id = query_id * 20), vd AS (SELECT query_id, vec_id AS doc_id, round({DISTANCE}, 6) AS d FROM embeddings, v),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rank FROM vd), vs AS (SELECT query_id, doc_id, round(1 / (1 + d), 6) AS similarity FROM vr WHERE rank <= 50)"""
BY_NAME = r"""pn AS (SELECT p_partkey, lower(p_name) AS nome FROM part), pf AS (SELECT query_id, p_partkey, nome = name AS exact FROM n JOIN pn ON nome = name OR (contains(nome, name) AND name NOT IN (SELECT nome FROM pn))),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, p_partkey) AS p FROM pf), ph AS (SELECT query_id, CAST(p_partkey AS VARCHAR) AS item, CAST(CASE WHEN exact THEN 0.98 ELSE 0.85 END AS DOUBLE) AS score, 'table_rows' AS source FROM pr WHERE p <= 2
  UNION ALL SELECT query_id, CAST(vs.doc_id AS VARCHAR), round(0.95 / (1 + (1 / similarity - 1)), 6), 'vector_db' FROM vs JOIN n USING (query_id) JOIN documents USING (doc_id)
  WHERE contains(lower(text), name) OR len(list_intersect(list_filter(regexp_extract_all(name, '[\p{L}\p{N}_]+'), lambda w: length(w) > 2), regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) >= 2),
nk AS (SELECT query_id, item, score, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, item) AS o FROM ph) WHERE o <= 10)"""
#: Rows of the kind that a query's words ask for.
BY_KIND = """kq(query_id, kind, words) AS (VALUES (1, 'ring', ['which', 'small', 'ring', 'best']), (2, 'widget', ['red', 'widget', 'please'])), kn AS (SELECT p_partkey AS row_id, string_split(p_name, ' ')[-1] AS kind, list_distinct(string_split(lower(p_name), ' ')) AS ws FROM part),
kh AS (SELECT query_id, row_id, len(words) AS n, unnest(list_intersect(words, ws)) AS w FROM kq JOIN kn USING (kind)),
ku AS (SELECT query_id, row_id, 0.95 AS score, 0 AS pr FROM (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY row_id) AS p FROM kh) WHERE p <= 2 UNION ALL SELECT query_id, row_id, round(0.5 + 0.4 * count(*) / n, 6), 1 FROM kh GROUP BY query_id, row_id, n
  UNION ALL SELECT query_id, row_id, 0.5, 2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_id) AS p FROM kq JOIN kn USING (kind)) WHERE p <= {k}),
kb AS (SELECT *, row_number() OVER (PARTITION BY query_id, row_id ORDER BY pr, score DESC) AS o FROM ku), ks AS (SELECT query_id, row_id, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS p FROM kb WHERE o = 1) WHERE p <= {k})"""


def _named(spark, sf):
    return spark.createDataFrame(NAMED, "query_id int, name string")


def _near(spark, sf, k):
    vectors = table(spark, sf, "embeddings")
    asked = _named(spark, sf).join(vectors, F.col("vec_id") == F.col("query_id") * 20).select("query_id", "embedding")
    return retrieval.knn(asked, vectors, k).withColumnRenamed("vec_id", "doc_id")


def _by_name(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("nome"))
    hits = _near(spark, sf, 50).join(_docs(spark, sf), "doc_id").withColumn("d", 1 / F.col("similarity") - 1)
    return retrieval.name_search(_named(spark, sf), rows, hits.select("query_id", "doc_id", "text", "d"), 10)


def _by_kind(spark, sf, k):
    rows = equipment_table(spark, sf).select("row_id", F.element_at(F.split("nome", " "), -1).alias("table_type"), "nome")
    asked = spark.createDataFrame([(1, "which small ring is best"), (2, "a red widget please")], "query_id int, query string")
    return retrieval.structured_search(asked, rows, {"ring": ["ring"], "widget": ["widget"]}, k)


@R.add(f"WITH {HITS}, {BY_NAME} SELECT * FROM nk")
def name_search(spark, sf):
    return _by_name(spark, sf).select("query_id", "item", "score", "source")


@R.add("WITH " + BY_KIND.format(k=10) + " SELECT * FROM ks")
def structured_search(spark, sf):
    return _by_kind(spark, sf, 10)


@R.add(f"""WITH {HITS}, {BY_NAME}, {BY_KIND.format(k=5)}, eo AS (SELECT DISTINCT query_id, p_partkey AS row_id, p_brand FROM n JOIN part ON lower(p_name) = name), ec AS (SELECT query_id, row_id, max(score) AS score FROM (SELECT query_id, row_id, 0.9 AS score FROM eo
  UNION ALL SELECT DISTINCT query_id, p_partkey, 0.7 FROM (SELECT DISTINCT query_id, p_brand FROM eo) JOIN part USING (p_brand)) GROUP BY ALL),
a AS (SELECT query_id, item, score, source, 0 AS pr FROM nk UNION ALL SELECT query_id, CAST(doc_id AS VARCHAR), similarity, 'vector_db', 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS o FROM vs) WHERE o <= 5
  UNION ALL SELECT query_id, CAST(row_id AS VARCHAR), score, 'table_rows', 2 FROM ks UNION ALL SELECT query_id, CAST(row_id AS VARCHAR), CAST(score AS DOUBLE), 'context', 3 FROM ec),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, item ORDER BY pr, score DESC) AS o FROM a), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, item) AS p FROM m WHERE o = 1)
SELECT query_id, item, CAST(score AS DOUBLE) AS score, source FROM f WHERE p <= 10""")
def hybrid_search(spark, sf):
    """Names, vectors, kinds of rows and rows around an entity, merged."""
    near = first_by(_near(spark, sf, 50), ["query_id"], F.desc("similarity"), F.col("doc_id"), n=5).select("query_id", F.col("doc_id").cast("string").alias("item"), F.col("similarity").alias("score"), F.lit("vector_db").alias("source"))
    kinds = _by_kind(spark, sf, 5).select("query_id", F.col("row_id").cast("string").alias("item"), "score", F.lit("table_rows").alias("source"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("nome"), F.col("p_brand").alias("table_id"))
    around = retrieval.entity_contexts(_named(spark, sf).select("query_id", F.col("name").alias("entity")), part)
    around = around.select("query_id", F.col("row_id").cast("string").alias("item"), "score", F.lit("context").alias("source"))
    return retrieval.hybrid_query([_by_name(spark, sf), near, kinds, around], 10).select("query_id", "item", "score", "source")


@R.add()
def cached_embeddings(spark, sf):
    docs = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    cache = spark.createDataFrame([], "text_sha256 string, embedding array<float>")
    rows = embed_with_cache(docs, "text", cache)
    return rows.select("conv_id", "turn", "text_sha256", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@R.add(f"""WITH s AS (SELECT b.item_id AS query_id, d.doc_id, round({OVERLAP.format(q='b.text', d='d.text')}, 6) AS score FROM benchmark b, documents d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def lexical_scores(spark, sf):
    """The ten documents that hold most of each query's words: the limit is the feature."""
    return retrieval.overlap_rank(_queries(spark, sf), _docs(spark, sf), 10).withColumn("rank", F.col("rank").cast("long"))


@R.add("SELECT c_custkey, round_even(forca / CAST(forca + habilidade AS DOUBLE) * 1000, 0) / 10 AS share_a FROM (SELECT c_custkey, c_custkey % 23 AS forca, c_custkey % 17 AS habilidade FROM customer) WHERE forca + habilidade > 0")
def win_shares(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 23).alias("x"), (F.col("c_custkey") % 17).alias("y")).where("x + y > 0")
    return retrieval.win_shares(rows, "x", "y").select("c_custkey", "share_a")


@R.add("SELECT query_id, item_id AS doc_id, place FROM (SELECT item_id % 5 AS query_id, item_id, row_number() OVER (PARTITION BY item_id % 5 ORDER BY item_id) AS place FROM benchmark)")
def ranked_lists(spark, sf):
    w = Window.partitionBy("query_id").orderBy("doc_id")
    rows = table(spark, sf, "benchmark").select((F.col("item_id") % 5).alias("query_id"), F.col("item_id").alias("doc_id"))
    return rows.withColumn("place", F.row_number().over(w).cast("long"))
