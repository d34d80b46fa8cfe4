"""Queries of evaluation, audits and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, retrieval
from .binding import Registry, table
from .retrieval import BM25

R = Registry()
#: Ranked lists from embeddings: vectors of a residue class are a query's list, the label is its relevance.
RANKED = """SELECT vec_id % 20 AS query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY embedding[1] DESC, vec_id) AS rank, label = vec_id % 5 AS rel, embedding[1] AS score, label FROM embeddings"""


def _ranked(spark, sf):
    from pyspark.sql import Window

    v = table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("query_id"), F.col("vec_id").alias("doc_id"), F.col("embedding")[0].alias("score"), "label")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return v.withColumn("rank", F.row_number().over(w)).withColumn("rel", F.col("label") == F.col("doc_id") % 5)


@R.add(f"""WITH r AS ({RANKED}), h AS (SELECT *, sum(CAST(rel AS INT)) OVER (PARTITION BY query_id ORDER BY rank) AS hits, count(*) FILTER (rel) OVER (PARTITION BY query_id) AS n FROM r),
e AS (SELECT query_id, any_value(n) AS n, coalesce(max(CASE WHEN rel AND rank <= 10 THEN 1.0 / rank END), 0) AS rr, sum(CASE WHEN rel AND rank <= 5 THEN 1 ELSE 0 END) AS found,
  sum(CASE WHEN rel AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rel THEN hits / CAST(rank AS DOUBLE) ELSE 0 END) AS prec FROM h GROUP BY query_id),
i AS (SELECT *, (SELECT sum(1 / log2(x + 1)) FROM range(1, least(n, 5) + 1) t(x)) AS ideal FROM e)
SELECT count(*) AS queries, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN n > 0 THEN found / CAST(n AS DOUBLE) ELSE 0 END), 6) AS recall, round(avg(CASE WHEN n > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN n > 0 THEN prec / n ELSE 0 END), 6) AS map FROM i""")
def ir_metrics(spark, sf):
    r = _ranked(spark, sf)
    return evaluation.ir_metrics(r, r.where("rel"), r.select("query_id"))


@R.add(f"""WITH r AS (SELECT query_id, CAST(rel AS INT) AS label, score FROM ({RANKED})), p AS (SELECT a.query_id, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM r a JOIN r b ON a.query_id = b.query_id AND a.label = 1 AND b.label = 0 GROUP BY 1)
SELECT query_id, round(auc, 6) AS auc FROM p""")
def rerank_auc(spark, sf):
    return evaluation.pairwise_auc(_ranked(spark, sf).withColumn("label", F.col("rel").cast("int")))


@R.add(f"""WITH r AS ({RANKED}), d AS (SELECT query_id, sum((2 ** (label % 3) - 1) / log2(p + 1)) AS dcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS p FROM r) WHERE p <= 5 GROUP BY 1),
i AS (SELECT query_id, sum((2 ** (label % 3) - 1) / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label % 3 DESC, doc_id) AS p FROM r) WHERE p <= 5 GROUP BY 1)
SELECT query_id, CASE WHEN ideal > 0 THEN round(dcg / ideal, 6) ELSE 0 END AS ndcg FROM d JOIN i USING (query_id)""")
def rerank_ndcg(spark, sf):
    r = _ranked(spark, sf)
    return evaluation.graded_ndcg(r.select("query_id", F.col("doc_id").alias("item"), "score", (F.col("label") % 3).alias("label")))


SCORES = "SELECT user_id AS query_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, value AS score, event_id AS item FROM events"


def _scores(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("model"), F.col("value").alias("score"), F.col("event_id").alias("item"))


@R.add(f"WITH m AS (SELECT query_id, avg(score) FILTER (model = 'a') AS a, avg(score) FILTER (model = 'b') AS b FROM ({SCORES}) GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN a > b THEN 1.0 ELSE 0 END), 6) AS win_share, round(avg(CASE WHEN a > b THEN 1.0 ELSE 0 END), 6) >= 0.55 AS accepted FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def ab_test(spark, sf):
    return evaluation.ab_test(_scores(spark, sf), "a", "b")


@R.add(f"""WITH s AS ({SCORES}), m AS (SELECT query_id FROM s GROUP BY 1 HAVING avg(score) FILTER (model = 'a') < avg(score) FILTER (model = 'b')), t AS (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY score DESC, item) AS p FROM s)
SELECT query_id, max(item) FILTER (model = 'a') AS positive, max(item) FILTER (model = 'b') AS negative FROM t JOIN m USING (query_id) WHERE p = 1 GROUP BY 1""")
def ab_failures(spark, sf):
    return evaluation.ab_failures(_scores(spark, sf), "a", "b")


@R.add("""WITH m AS (SELECT event_type AS metric, avg(value) FILTER (event_id % 2 = 0) AS new, avg(value) FILTER (event_id % 2 = 1) AS base FROM events GROUP BY 1)
SELECT metric, round(base, 6) AS base, round(new, 6) AS new, round((new - base) / base, 6) AS delta, CAST(NULL AS BOOLEAN) AS accepted FROM m""")
def compare_models(spark, sf):
    e = table(spark, sf, "events")
    m = e.groupBy(F.when(F.col("event_id") % 2 == 0, "new").otherwise("old").alias("model"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return evaluation.compare_models(m, "old", "new").withColumns({c: F.round(c, 6) for c in ("base", "new")})


PHRASE = "SELECT item_id AS query_id, lower(string_split(text, ' ')[2]) AS phrase FROM benchmark"
LISTED = BM25 + ", l AS (SELECT query_id, doc_id, text, rank FROM r JOIN documents USING (doc_id) WHERE rank <= 10)"


def _listed(spark, sf):
    """The ten documents that BM25 ranks first for each benchmark query, with their texts."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.bm25(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), docs).join(docs, "doc_id")


@R.add(f"""{LISTED}, hit AS (SELECT query_id, min(rank) AS rank FROM l JOIN ({PHRASE}) USING (query_id) WHERE contains(lower(text), phrase) GROUP BY 1)
SELECT round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM ({PHRASE}) LEFT JOIN hit USING (query_id)""")
def phrase_metrics(spark, sf):
    phrases = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.lower(F.split("text", " ")[1])).alias("phrases"))
    return evaluation.phrase_metrics(_listed(spark, sf), phrases)


@R.add(r"""WITH t AS (SELECT item_id AS query_id, unnest([lower(string_split(text, ' ')[3]), lower(string_split(text, ' ')[5])]) AS target, item_id % 2 = 0 AS c FROM benchmark), w AS (SELECT doc_id, lower(text) AS l, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ws FROM documents),
g AS (SELECT query_id, target, c, list_sort(list_transform(regexp_extract_all(target, '[\p{L}\p{N}_]+'), lambda x: {'n': length(x), 'w': x}), 'DESC')[1].w AS k FROM t WHERE len(regexp_extract_all(target, '[\p{L}\p{N}_]+')) > 0)
SELECT query_id, doc_id FROM g JOIN w ON list_contains(ws, k) AND contains(l, target) GROUP BY query_id, doc_id, c HAVING count(DISTINCT target) >= CASE WHEN c THEN 2 ELSE 1 END""")
def ground_truth(spark, sf):
    words = F.split("text", " ")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.lower(words[2]), F.lower(words[4])).alias("targets"), (F.col("item_id") % 2 == 0).alias("comparison"))
    return evaluation.ground_truth(q, table(spark, sf, "documents"))


@R.add(LISTED + r""", lw AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 7) AS words FROM benchmark),
x AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY length(text), doc_id) AS final_rank, len(list_filter(words, lambda w: contains(lower(text), w))) > 0 AS rel FROM l JOIN lw USING (query_id))
SELECT query_id, count(*) FILTER (rel AND rank <= 5) AS before, count(*) FILTER (rel AND final_rank <= 5) AS after FROM x GROUP BY 1""")
def rerank_lift(spark, sf):
    """Lists by BM25, reranked by length; relevant is what holds a long word of the query."""
    from pyspark.sql import Window

    long = F.array_join(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.length(x) > 7), " ")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), long.alias("query"))
    ranked = _listed(spark, sf).withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.length("text"), "doc_id")))
    return evaluation.rerank_lift(ranked.join(q, "query_id"))


ANSWERS = "SELECT conv_id * 1000 + turn AS answer_id, text || CASE WHEN turn % 4 = 1 THEN ' \"quoted 12\" 12' WHEN turn % 4 = 3 THEN ' talvez 7' ELSE '' END AS text, CASE WHEN conv_id % 3 = 0 THEN 'B' ELSE 'A' END AS book FROM conversations WHERE role = 'assistant'"


def _answers(spark, sf):
    a = table(spark, sf, "conversations").where("role = 'assistant'")
    tail = F.when(F.col("turn") % 4 == 1, ' "quoted 12" 12').when(F.col("turn") % 4 == 3, " talvez 7").otherwise("")
    return a.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", tail).alias("text"), F.when(F.col("conv_id") % 3 == 0, "B").otherwise("A").alias("book"), F.array(F.lit("A")).alias("used_books"))


@R.add(rf"""WITH a AS (SELECT *, regexp_extract_all(text, '"([^"]{{3,}})"', 1) AS quotes, regexp_extract_all(text, '\d+') AS numbers FROM ({ANSWERS}))
SELECT answer_id, concat_ws(',', CASE WHEN len(quotes) = 0 THEN 'no_quotation' END, CASE WHEN book <> 'A' THEN 'unknown_book' END, CASE WHEN len(list_filter(numbers, lambda n: NOT contains(list_aggregate(list_append(quotes, ''), 'string_agg', ' '), n))) > 0 THEN 'loose_number' END,
  CASE WHEN regexp_matches(lower(text), 'talvez|acho que|provavelmente|possivelmente|pode ser que') THEN 'hedging' END) AS violations FROM a""")
def validate_answers(spark, sf):
    return evaluation.validate_answers(_answers(spark, sf)).select("answer_id", F.array_join("violations", ",").alias("violations"))


@R.add(rf"""SELECT answer_id, contains(text, 'the') AND contains(text, 'of') AS has_blocks, regexp_matches(text, '"[^"]{{3,}}"') AS has_citation, regexp_matches(lower(text), 'fonte|source|livro') AS has_source, regexp_matches(text, '\d+d\d*|[+=]\s*\d') AS has_formula FROM ({ANSWERS})""")
def answer_metrics(spark, sf):
    return evaluation.answer_metrics(_answers(spark, sf), ["the", "of"])


RATING = "CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END"


@R.add(f"SELECT CAST(user_id AS VARCHAR) AS query, round(avg({RATING}), 6) AS mean, count(*) AS n, round(avg({RATING}), 6) < 0 AS low FROM events GROUP BY 1")
def feedback_stats(spark, sf):
    rating = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "purchase", 1).otherwise(0)
    return evaluation.feedback_stats(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("query"), rating.alias("rating")))


@R.add("SELECT count(*) AS entries, count(DISTINCT user_id) AS queries FROM events")
def feedback_totals(spark, sf):
    return evaluation.feedback_totals(table(spark, sf, "events").select(F.col("user_id").alias("query")))


@R.add("SELECT CASE WHEN contains(lower(text), 'idiot') THEN 'rude' WHEN contains(lower(text), 'token') THEN 'secret' ELSE 'outros' END AS section, count(*) AS n FROM documents GROUP BY 1")
def section_labels(spark, sf):
    label = evaluation.section_label(F.lit(""), F.col("text"), [("idiot", "rude"), ("token", "secret")])
    return table(spark, sf, "documents").groupBy(label.alias("section")).agg(F.count("*").alias("n"))


@R.add("WITH a AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 25), b AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 45) SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'extra' ELSE 'covered' END AS status FROM a FULL JOIN b ON a.name = b.name")
def coverage(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"), "p_size")
    return evaluation.coverage(names.where("p_size < 25"), names.where("p_size > 45"))


@R.add("""WITH r AS (SELECT o_custkey % 20 AS "group", CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey AS INT) END AS n FROM orders WHERE o_orderkey % 3 = 0)
SELECT "group", n, gap FROM (SELECT *, lead(n) OVER (PARTITION BY "group" ORDER BY n) - n - 1 AS gap FROM r WHERE n IS NOT NULL) WHERE gap > 0 UNION ALL SELECT "group", n, NULL FROM r WHERE n IS NULL""")
def index_gaps(spark, sf):
    line = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 10 == 0, " x").otherwise(". x"))
    rows = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 20).alias("group"), line.alias("line"))
    return evaluation.index_gaps(rows)


@R.add(r"""SELECT count(*) AS items, round(avg(CASE WHEN p_size % 4 > 0 THEN 1.0 ELSE 0 END), 6) AS priced, round(avg(CASE WHEN length(p_type) < 20 THEN 1.0 ELSE 0 END), 6) AS brief, round(avg(CASE WHEN regexp_matches(p_brand, '\d{3,}|[^\p{L}\p{N}\s''#-]') OR length(p_brand) < 4 THEN 1.0 ELSE 0 END), 6) AS odd,
count(*) FILTER (p_size % 4 > 0 AND length(p_type) >= 20 AND NOT (regexp_matches(p_brand, '\d{3,}|[^\p{L}\p{N}\s''#-]') OR length(p_brand) < 4)) AS good FROM part""")
def profile_items(spark, sf):
    return evaluation.profile_items(table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice")).alias("price"), F.col("p_type").alias("effect")))


@R.add("""WITH a AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS n, p_type AS t FROM part WHERE p_partkey % 7 > 0), b AS (SELECT p_partkey, p_name AS n, CASE WHEN p_size % 4 = 0 THEN 'other' WHEN p_size % 4 = 1 THEN NULL ELSE p_type END AS t FROM part),
u AS (SELECT p_partkey, 'n' AS field, a.n AS got, b.n AS want FROM b LEFT JOIN a USING (p_partkey) UNION ALL SELECT p_partkey, 't', a.t, b.t FROM b LEFT JOIN a USING (p_partkey))
SELECT p_partkey, field, CASE WHEN got IS NOT DISTINCT FROM want THEN 'OK' WHEN got IS NULL THEN 'LACUNA' WHEN want IS NULL THEN 'SOBRANDO' ELSE 'DIFERENTE' END AS status FROM u""")
def field_diff(spark, sf):
    part = table(spark, sf, "part")
    a = part.where("p_partkey % 7 > 0").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("n"), F.col("p_type").alias("t"))
    b = part.select("p_partkey", F.col("p_name").alias("n"), F.when(F.col("p_size") % 4 == 0, "other").when(F.col("p_size") % 4 != 1, F.col("p_type")).alias("t"))
    return evaluation.field_diff(a, b, "p_partkey", ["n", "t"])


@R.add("SELECT p_brand, count(*) AS n, min(p_name) AS sample FROM part GROUP BY p_brand")
def source_summary(spark, sf):
    return evaluation.source_summary(table(spark, sf, "part"), "p_brand", "p_name")


@R.add("SELECT p_partkey FROM part WHERE p_size > 20 ORDER BY md5(CAST(p_partkey AS VARCHAR) || '|42'), p_partkey LIMIT 20")
def sample_items(spark, sf):
    """A random sample of 20 rows: the limit is the feature."""
    return evaluation.sample_items(table(spark, sf, "part").where("p_size > 20"), "p_partkey").select("p_partkey")


@R.add("SELECT 'half' AS field, round(avg(CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0 END), 6) AS share FROM part UNION ALL SELECT 'p_name', round(avg(CASE WHEN p_name IS NOT NULL THEN 1.0 ELSE 0 END), 6) FROM part")
def fill_rate(spark, sf):
    return evaluation.fill_rate(table(spark, sf, "part").withColumn("half", F.when(F.col("p_size") % 2 == 0, 1)), ["p_name", "half"])


@R.add("""WITH a AS (SELECT DISTINCT p_name AS name, CASE WHEN p_name = 'red ring' THEN 'blue ring' ELSE p_name END AS k FROM part), b AS (SELECT DISTINCT p_name AS found FROM part WHERE p_name NOT LIKE 'red%' AND p_name NOT LIKE 'small%' UNION SELECT 'small widget of old'),
e AS (SELECT name, min(found) AS found FROM a JOIN b ON k = found GROUP BY 1), p AS (SELECT name, found, row_number() OVER (PARTITION BY name ORDER BY length(found) DESC, found) AS o FROM a JOIN b ON (contains(k, found) OR contains(found, k)) WHERE name NOT IN (SELECT name FROM e))
SELECT name, found, 'covered' AS status FROM e UNION ALL SELECT name, found, 'partial' FROM p WHERE o = 1 UNION ALL SELECT name, NULL, 'missing' FROM a WHERE name NOT IN (SELECT name FROM e) AND name NOT IN (SELECT name FROM p)""")
def fuzzy_coverage(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"))
    found = names.where("name not like 'red%' and name not like 'small%'").unionByName(spark.createDataFrame([("the small widget of old",)], "name string"))
    rows = evaluation.fuzzy_coverage(names, found, {"red ring": "blue ring"}, ["the"])
    return rows.withColumn("found", F.regexp_replace("found", "^the ", ""))


@R.add("SELECT p_partkey, p_name AS name, p_brand AS source FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 7)")
def not_found(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("source"), "p_size")
    return evaluation.not_found(part, part.where("p_size = 7").select("name")).select("p_partkey", "name", "source")
