"""Queries of entity discovery and knowledge building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import catalog, entities, trainset
from ..sources import io
from .binding import Registry, table

R = Registry()
KINDS = ["alpha", "beta"]
RULES = {"alpha": [("content", "tion"), ("secondary", "idiot"), ("section", "src1")], "beta": [("content", "ment"), ("section", "src2")]}
SCORES = """SELECT doc_id AS chunk_id, CASE WHEN regexp_matches(text, '(?i)tion') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)idiot') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(source, '(?i)src1') THEN 3 ELSE 0 END AS alpha_score,
  CASE WHEN regexp_matches(text, '(?i)ment') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(source, '(?i)src2') THEN 3 ELSE 0 END AS beta_score FROM documents"""
#: Names: capitalised words between spaces, over whole texts, each once a document at its first place, with 20 characters before and 60 after.
NAME_PATTERN = r"(?<![^ ])([A-Z][a-z]{4,})(?![^ ])"
CANDIDATES = """SELECT doc_id AS chunk_id, name, substr(text, greatest(0, pos - 20) + 1, pos + length(name) + 60 - greatest(0, pos - 20)) AS context FROM (
  SELECT doc_id, text, name, min(pos) AS pos FROM (SELECT doc_id, text, name, CAST(sum(length(name) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(name) - 1 AS pos
    FROM (SELECT doc_id, text, unnest(string_split(text, ' ')) AS name, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)) WHERE regexp_full_match(name, '[A-Z][a-z]{4,}') GROUP BY doc_id, text, name)"""


def _chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("section"))


def _candidates(spark, sf):
    return entities.entity_candidates(_chunks(spark, sf), [NAME_PATTERN])


HINTED = {"has_year": r"\b(19|20)[0-9]{2}\b", "has_insult": r"(?i)idiot|moron"}


def _entities(spark, sf):
    chunks = _chunks(spark, sf)
    scores = entities.score_chunks(chunks, RULES, entities.hint_columns(HINTED, r"[0-9]{3,}"))
    found = entities.entity_candidates(chunks, [NAME_PATTERN], offsets=True)
    return entities.resolve_type(entities.aggregate_entities(found, scores, KINDS, chunks=chunks), KINDS)


@R.add(SCORES)
def chunk_scores(spark, sf):
    return entities.score_chunks(_chunks(spark, sf), RULES)


AGG = f"""WITH s AS ({SCORES}), c AS ({CANDIDATES}), a AS (SELECT name, count(*) AS mentions, count(DISTINCT chunk_id) AS sources, CAST(sum(alpha_score) AS BIGINT) AS alpha_score, CAST(sum(beta_score) AS BIGINT) AS beta_score,
  bool_or(regexp_matches(text, '\\b(19|20)[0-9]{{2}}\\b')) AS has_year, bool_or(regexp_matches(text, '(?i)idiot|moron')) AS has_insult,
  arg_min(CASE WHEN regexp_matches(text, '[0-9]{{3,}}') THEN array_to_string(regexp_extract_all(text, '[0-9]{{3,}}')[:8], ' ') END, CASE WHEN regexp_matches(text, '[0-9]{{3,}}') THEN chunk_id END) AS stats
  FROM c JOIN s USING (chunk_id) JOIN documents ON doc_id = chunk_id GROUP BY name),
x AS (SELECT name, string_agg(context, '|' ORDER BY chunk_id) AS contexts, count(*) AS n_contexts FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chunk_id) AS p FROM c) WHERE p <= 5 GROUP BY name),
t AS (SELECT *, greatest(alpha_score, beta_score) AS top, least(alpha_score, beta_score) AS low FROM a JOIN x USING (name)),
e AS (SELECT *, CASE WHEN top >= 5 OR (top >= 3 AND top - low >= 2) THEN CASE WHEN alpha_score >= beta_score THEN 'alpha' ELSE 'beta' END WHEN top >= 2 THEN 'desconhecido' ELSE 'generico' END AS type,
  CASE WHEN top >= 8 THEN 'alta' WHEN top >= 5 THEN 'media' WHEN top >= 3 AND top - low >= 2 THEN 'promovida' ELSE 'baixa' END AS confidence FROM t)"""


@R.add(AGG + " SELECT name, mentions, sources, alpha_score, beta_score, has_year, has_insult, stats, contexts, type, confidence FROM e")
def entity_types(spark, sf):
    return _entities(spark, sf).select("name", "mentions", "sources", "alpha_score", "beta_score", "has_year", "has_insult", "stats", F.array_join("contexts", "|").alias("contexts"), "type", "confidence")


@R.add()
def entity_mentions(spark, sf):
    return entities.entity_candidates(_chunks(spark, sf)).groupBy("name").agg(F.count("*").alias("mentions"))


DROPPED = " OR ".join([f"name IN ({', '.join(repr(n) for n in [*rules.NOT_NAMES, 'There', 'Diese'])})", *[f"regexp_matches(name, '{p}')" for p in [*rules.FRAGMENTS, "ing$"]]])


@R.add(AGG + f" SELECT name FROM e WHERE NOT ({DROPPED})")
def kept_names(spark, sf):
    return entities.drop_fragments(_entities(spark, sf).select("name"), blocked=[*rules.NOT_NAMES, "There", "Diese"], patterns=[*rules.FRAGMENTS, "ing$"])


@R.add(AGG + " SELECT name, type FROM e WHERE mentions >= CASE type WHEN 'alpha' THEN 3 WHEN 'beta' THEN 2 ELSE 1 END")
def min_mentions(spark, sf):
    return entities.min_mentions(_entities(spark, sf), {"alpha": 3, "beta": 2}, 1).select("name", "type")


@R.add(AGG + ", h AS (SELECT type, count(*) AS n FROM e GROUP BY type) SELECT coalesce(h.type, b.type) AS type, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < least THEN 'low' WHEN n > most THEN 'high' END AS alert FROM h FULL JOIN (VALUES ('alpha', 1, 10), ('gamma', 1, 5), ('beta', 0, 100000)) b(type, least, most) ON h.type = b.type")
def type_histogram(spark, sf):
    return entities.type_histogram(_entities(spark, sf), {"alpha": (1, 10), "gamma": (1, 5), "beta": (0, 100000)})


@R.add(AGG + " SELECT n.name, CASE WHEN want IS NULL THEN CASE WHEN type IS NULL THEN 'ok' ELSE 'unwanted' END WHEN type IS NULL THEN 'absent' WHEN want = type THEN 'ok' ELSE 'wrong_type' END AS verdict FROM (VALUES ('Eriner', 'alpha'), ('Thedre', 'beta'), ('Nothing', 'alpha'), ('Zzzzz', NULL), ('Thble', NULL)) n(name, want) LEFT JOIN e USING (name)")
def entity_audit(spark, sf):
    return entities.audit_entities(_entities(spark, sf), spark.createDataFrame([("Eriner", "alpha"), ("Thedre", "beta"), ("Nothing", "alpha"), ("Zzzzz", None), ("Thble", None)], "name string, type string"))


QUALITY = AGG + ", q AS (SELECT name, CASE WHEN lower(name) IN ('nicht', 'apache', 'eriner', 'thedre') THEN 'stopword' WHEN mentions >= 4 THEN NULL WHEN length(name) < 3 OR length(name) > 60 THEN 'size' WHEN regexp_matches(name, '[0-9]{3,}') THEN 'pattern' WHEN NOT regexp_matches(name, '^\\p{Lu}') THEN 'proper_noun' END AS reason FROM e)".replace("\\\\", "\\")
STOP = ["nicht", "apache", "eriner", "thedre"]


@R.add(QUALITY + " SELECT name, reason FROM q")
def entity_quality(spark, sf):
    return entities.classify_entities(_entities(spark, sf), STOP).select("name", "reason")


@R.add(QUALITY + " SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY reason")
def suspect_reasons(spark, sf):
    return entities.clean_entities(entities.classify_entities(_entities(spark, sf), STOP))[1]


@R.add(QUALITY + " SELECT count(*) AS entities, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason IS NOT NULL) AS suspect, round(1 - count(*) FILTER (reason IS NOT NULL) / CAST(count(*) AS DOUBLE), 6) AS precision, (SELECT count(*) FROM nation) AS relations, (SELECT count(DISTINCT n_regionkey) FROM nation) AS clusters FROM q")
def knowledge_report(spark, sf):
    nation = table(spark, sf, "nation")
    return entities.knowledge_report(entities.classify_entities(_entities(spark, sf), STOP), nation, nation.withColumn("cluster_id", F.col("n_regionkey")))


@R.add(AGG + " SELECT name, mentions FROM e ORDER BY mentions DESC, name LIMIT 50")
def capped_entities(spark, sf):
    """The 50 most mentioned entities: a top-k report."""
    return entities.cap_entities(_entities(spark, sf), 50).select("name", "mentions")


@R.add("SELECT 'documents' AS \"table\", count(*) AS rows, true AS present FROM documents UNION ALL SELECT 'pages', count(*), true FROM pages UNION ALL SELECT 'none', 0, false")
def coverage_report(spark, sf):
    return entities.coverage_report({"documents": table(spark, sf, "documents"), "pages": table(spark, sf, "pages"), "none": table(spark, sf, "pages").limit(0)})


#: Entities made of part names: every other one a spell; the first context states a rule, the second one holds stats and relations.
def _parts(spark, sf):
    part = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").alias("size"))
    word, size = F.element_at(F.split("name", " "), -1), F.col("size").cast("string")
    text = F.concat("name", F.lit(" é um "), word, F.lit(". "), "name", F.lit(" custa "), size, F.lit(" PM. "), "name", F.lit(" requer "), word, F.lit(" e fogo. escola: "), word, F.lit(". "), "name", F.lit(" causa dano. PV: "), size, F.lit(" F"), (F.col("size") % 7).cast("string"), F.lit("-H1-R2-A3."))
    kind = F.when(F.col("size") % 2 == 0, "magia").otherwise("monstro")
    return part.select("name", kind.alias("type"), F.array(F.lit("Um teste de PV: 99"), text).alias("contexts"), F.lit(3).alias("mentions"), "size")


PARTS = """SELECT p_name AS name, min(p_size) AS size, string_split(p_name, ' ')[-1] AS word, CASE WHEN min(p_size) % 2 = 0 THEN 'magia' ELSE 'monstro' END AS type, p_name || ' é um ' || string_split(p_name, ' ')[-1] || '. ' || p_name || ' custa ' || min(p_size) || ' PM. ' || p_name || ' requer ' || string_split(p_name, ' ')[-1]
  || ' e fogo. escola: ' || string_split(p_name, ' ')[-1] || '. ' || p_name || ' causa dano. PV: ' || min(p_size) || ' F' || min(p_size) % 7 || '-H1-R2-A3.' AS text FROM part GROUP BY p_name"""


@R.add(f"""WITH p AS ({PARTS}) SELECT name, unnest(CASE WHEN type = 'magia' THEN ['cost_pm', 'school'] ELSE ['pv', 'stats'] END) AS key,
  unnest(CASE WHEN type = 'magia' THEN [CAST(size AS VARCHAR), word] ELSE [CAST(size AS VARCHAR), 'F' || size % 7 || '-H1-R2-A3'] END) AS value, text AS evidence FROM p""")
def entity_properties(spark, sf):
    return entities.infer_properties(_parts(spark, sf))


@R.add(f"""WITH p AS ({PARTS}) SELECT name AS src, unnest(['is_a', 'cost_pm', 'requires', 'school', 'effect']) AS relation, unnest([word, CAST(size AS VARCHAR), word || ' e fogo', word, 'dano']) AS dst, text AS evidence FROM p""")
def relations(spark, sf):
    return entities.extract_relations(_parts(spark, sf))


@R.add(f"WITH p AS ({PARTS}) SELECT type, CASE type WHEN 'magia' THEN 1.0 ELSE round(2 / 3.0, 6) END AS completeness FROM p GROUP BY type")
def property_completeness(spark, sf):
    parts = _parts(spark, sf)
    return entities.property_completeness(parts, entities.infer_properties(parts), {"monstro": ["pv", "stats", "immunities"], "magia": ["cost_pm", "school"]})


@R.add("SELECT n_name AS name, 1 AS edges FROM nation UNION ALL SELECT r_name, 0 FROM region ORDER BY edges, name LIMIT 20")
def isolated_entities(spark, sf):
    """The 20 least connected entities: a top-k report."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    names = nation.select(F.col("n_name").alias("name")).unionByName(region.select(F.col("r_name").alias("name")))
    return entities.isolated_entities(names, nation.select(F.upper("n_name").alias("src"))).select("name", F.col("edges").cast("int"))


@R.add("WITH m AS (SELECT s_nationkey AS cluster_id, s_name AS entity FROM supplier UNION ALL SELECT 100 + s_nationkey, s_name FROM supplier WHERE s_suppkey % 3 > 0) SELECT DISTINCT cluster_id, CASE WHEN cluster_id >= 100 THEN cluster_id - 100 ELSE cluster_id END AS merged FROM m")
def merged_clusters(spark, sf):
    s = table(spark, sf, "supplier")
    m = s.select(F.col("s_nationkey").alias("cluster_id"), F.col("s_name").alias("entity")).unionByName(s.where("s_suppkey % 3 > 0").select((F.col("s_nationkey") + 100).alias("cluster_id"), F.col("s_name").alias("entity")))
    return entities.merge_clusters(m)


@R.add("SELECT s_nationkey AS cluster_id, CASE WHEN count(*) < 2 THEN 'small' ELSE 'stop_words' END AS issue FROM supplier GROUP BY 1 HAVING count(*) < 2 OR s_nationkey % 2 = 0")
def cluster_issues(spark, sf):
    c = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("cluster_id")).agg(F.count("*").alias("members"))
    return entities.cluster_issues(c.withColumn("terms", F.when(F.col("cluster_id") % 2 == 0, F.array(F.lit("a"), F.lit("de"))).otherwise(F.array(F.lit("word")))))


@R.add()
def taxonomy(spark, sf):
    """Clusters of documents by their words, with labels."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.array("text").alias("contexts"))
    members, terms = entities.discover_taxonomy(docs)
    return members.join(entities.name_clusters(terms), "cluster_id").select("name", "cluster_id", "label")


@R.add()
def weak_spans(spark, sf):
    return entities.weak_spans(table(spark, sf, "documents"), {"RUDE": ["idiot", "moron", "loser"]})


LINKED = "SELECT name FROM (SELECT p_name AS name FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT n_name FROM nation UNION SELECT 'is' UNION SELECT 'this is not')"


@R.add(f"""WITH n AS (SELECT string_agg(name, '|' ORDER BY length(name) DESC, name) AS p FROM (SELECT DISTINCT lower(name) AS name FROM ({LINKED}))), m AS (SELECT doc_id, text, regexp_extract_all(lower(text), p) AS found FROM documents, n)
SELECT doc_id, len(found) AS mentions, md5(array_to_string(list_sort(found), '|')) AS names, md5(text) AS whole FROM m""")
def linked_mentions(spark, sf):
    """Mentions of the parts, their first words and the nations in all documents; the pieces of each text put together again."""
    part = table(spark, sf, "part")
    names = part.select(F.col("p_name").alias("name")).unionByName(part.select(F.substring_index("p_name", " ", 1).alias("name"))).unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("name")))
    names = names.distinct().unionByName(spark.createDataFrame([("is",), ("this is not",)], "name string"))
    found = entities.link_mentions(table(spark, sf, "documents"), names)
    each = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "name"))).alias("p"))  # of one text
    held = F.array_sort(F.transform(F.filter("p", lambda x: x["name"].isNotNull()), lambda x: F.lower(x["name"])))
    return each.select("doc_id", F.size(held).cast("long").alias("mentions"), F.md5(F.array_join(held, "|").cast("binary")).alias("names"), F.md5(F.array_join(F.transform("p", lambda x: x["piece"]), "").cast("binary")).alias("whole"))


@R.add("SELECT conv_id, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS labels FROM conversations GROUP BY conv_id")
def span_rollup(spark, sf):
    spans = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("start"), F.col("role").alias("label"), F.substring("text", 1, 10).alias("text"))
    return entities.rollup_spans(spans, "conv_id").select("conv_id", F.size("entities").cast("long").alias("n"), F.array_join(F.array_sort(F.map_keys("by_label")), ",").alias("labels"))


@R.add(f"WITH p AS ({PARTS}) SELECT name, text[1:512] AS text, 0 AS start, CAST(length(name) AS INT) AS \"end\", type AS label FROM p ORDER BY md5(name || '|1|42'), name LIMIT 500")
def span_examples(spark, sf):
    """500 random span examples: the limit is the feature."""
    return entities.span_examples(_parts(spark, sf))


#: Entities of all the kinds that a rule corrects.
CASES = """SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'Armadura' WHEN 1 THEN 'se falhar' WHEN 2 THEN 'Magia Branca' WHEN 3 THEN 'Corpo Mágico' ELSE p_name END AS name, CASE p_partkey % 4 WHEN 0 THEN 'magia' WHEN 1 THEN 'monstro' WHEN 2 THEN 'item' ELSE 'desconhecido' END AS type, p_size % 3 AS c FROM part"""


@R.add(f"""WITH e AS ({CASES}), r AS (SELECT *, CASE WHEN lower(name) = 'magia branca' THEN CASE WHEN type <> 'magia' THEN 'critical' END WHEN type = 'magia' AND c = 0 THEN 'spell_with_stats' WHEN type = 'magia' AND c = 1 THEN 'spell_without_evidence'
  WHEN type = 'monstro' AND name = 'se falhar' THEN 'monster_without_proper_noun' WHEN type = 'item' AND name = 'Armadura' THEN 'generic_item' END AS reason FROM e),
u AS (SELECT *, name = 'Corpo Mágico' AND (reason IS NOT NULL OR type = 'desconhecido') AS promoted FROM r)
SELECT id, CASE WHEN name = 'Magia Branca' THEN 'magia' WHEN promoted THEN 'vantagem' WHEN reason IS NOT NULL THEN 'desconhecido' ELSE type END AS type, CASE WHEN promoted THEN 'promoted' ELSE reason END AS review FROM u""")
def post_rules(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    name = F.when(size % 5 == 0, "Armadura").when(size % 5 == 1, "se falhar").when(size % 5 == 2, "Magia Branca").when(size % 5 == 3, "Corpo Mágico").otherwise(F.col("p_name"))
    kind = F.when(key % 4 == 0, "magia").when(key % 4 == 1, "monstro").when(key % 4 == 2, "item").otherwise("desconhecido")
    text = F.when(size % 3 == 0, "F3, H2 custa 5 PMs").when(size % 3 == 1, "nada").otherwise("custa 5 PMs")
    rows = table(spark, sf, "part").select(key.alias("id"), name.alias("name"), kind.alias("type"), F.array(text).alias("contexts"))
    return entities.post_rules(rows, {"magia branca": "magia"}, [("^Corpo|Elemental", "vantagem")]).select("id", "type", "review")


@R.add(f"""WITH e AS ({CASES}) SELECT id, CASE WHEN name = 'Magia Branca' THEN 21 WHEN name = 'Corpo Mágico' THEN 11 ELSE 1 END AS magia_score, CASE WHEN name = 'Magia Branca' THEN 0 ELSE 4 END AS monstro_score, CASE WHEN name = 'Magia Branca' THEN 0 ELSE 2 END AS item_score,
  CASE name WHEN 'Armadura' THEN 3 WHEN 'se falhar' THEN 1 WHEN 'Magia Branca' THEN 4 WHEN 'Corpo Mágico' THEN 4 ELSE 3 END AS proper FROM e""")
def boosted_scores(spark, sf):
    size = F.col("p_size")
    name = F.when(size % 5 == 0, "Armadura").when(size % 5 == 1, "se falhar").when(size % 5 == 2, "Magia Branca").when(size % 5 == 3, "Corpo Mágico").otherwise(F.col("p_name"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.lit(1).alias("magia_score"), F.lit(4).alias("monstro_score"), F.lit(2).alias("item_score"))
    rows = entities.boost_scores(rows, r"^Magia (?:Elemental|Negra)", ["magia branca"], "Mágic[oa]")
    return rows.select("id", "magia_score", "monstro_score", "item_score", entities.proper_noun_score(F.col("name")).alias("proper"))


@R.add(f"WITH p AS ({PARTS}) SELECT name, (name || ' ' || type || ' Um teste de PV: 99 ' || text || ' ' || text)[1:500] AS description FROM p")
def described_entities(spark, sf):
    parts = _parts(spark, sf)
    return trainset.describe(parts, entities.infer_properties(parts))


@R.add("SELECT p_partkey, p_name FROM part WHERE p_size > 25")
def published_rows(spark, sf):
    path = io.work_dir(spark)
    catalog.publish(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path, F.col("p_size") > 25)
    return spark.read.parquet(path).select("p_partkey", "p_name")
