"""Queries of catalogue extraction, reconciliation and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from .binding import Registry, table

R = Registry()


def _names(spark, sf, condition):
    return table(spark, sf, "part").where(condition).select(F.col("p_name").alias("name"))


def _blocks(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit("intro\n"), "p_name", F.lit(": F1, H2, R3, A"), (F.col("p_size") % 9).cast("string"), F.lit(", PdF5, "), "p_type", F.lit("\nmore\nOther: F9, H9, R9, A9, PdF9\nOgro Velho\nF 1O; H 2; R l\nA "), (F.col("p_size") % 7).cast("string"), F.lit("S PdF O\nAnão\nCON 1S, FR 4, DEX 7, AGI 8\n"), F.lit("Fogo\nEscola: "), "p_brand", F.lit("\nCusto: "), F.col("p_size").cast("string"), F.lit(" PMs\n"))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@R.add("""WITH p AS (SELECT *, p_partkey AS doc_id, length(p_name) + length(p_type) + length(CAST(p_size % 9 AS VARCHAR)) AS n FROM part)
SELECT doc_id, p_name AS nome, CAST(p_size % 9 AS VARCHAR) AS armadura, p_type AS habilidades, 0 AS layout, 1 AS page, 6 AS start, 'more' AS description FROM p
UNION ALL SELECT doc_id, 'Other', '9', NULL, 0, 1, n + 35, 'Ogro Velho' FROM p UNION ALL SELECT doc_id, 'Ogro Velho', CAST(p_size % 7 AS VARCHAR) || '5', NULL, 1, 2, n + 74, 'Anão' FROM p
UNION ALL SELECT doc_id, 'Anão', NULL, NULL, 2, 2, n + 105, 'Fogo' || chr(10) || 'Escola: ' || p_brand || chr(10) || 'Custo: ' || p_size || ' PMs' FROM p""")
def stat_blocks(spark, sf):
    """Blocks of three layouts on two pages; the loose layout also fits the strict block of Other, which is covered."""
    blocks = _blocks(spark, sf)
    offsets = blocks.select("doc_id", F.inline(F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("start")), F.struct(F.lit(2).alias("page"), F.locate("Ogro", F.col("text")).alias("start")))))
    return catalog.stat_blocks(blocks, offsets=offsets).select("doc_id", "nome", "armadura", "habilidades", "layout", "page", F.col("start").cast("int"), "description")


@R.add("""SELECT p_partkey AS doc_id, 'SOLDADO ' || upper(split_part(p_name, ' ', 1)) || ' ' || upper(split_part(p_name, ' ', 2)) AS nome, CAST(p_size % 9 AS VARCHAR) AS forca, 4 AS start FROM part
UNION ALL SELECT p_partkey, 'CHEFE ORC', CAST(p_size % 9 AS VARCHAR), 30 + length(p_name) FROM part WHERE p_partkey % 2 = 0""")
def variant_blocks(spark, sf):
    """Two variants named in each text, of which one has a block of its own in every other text."""
    p = table(spark, sf, "part")
    text = F.concat(F.lit("(um soldado "), "p_name", F.lit("; chefe de todos, chefe Orc: F"), (F.col("p_size") % 9).cast("string"), F.lit(" H2)"))
    texts = p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    blocks = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("doc_id"), F.lit("Chefe  orc").alias("nome"))
    return catalog.variants(texts, blocks).select("doc_id", "nome", "forca", F.col("start").cast("int"))


@R.add("SELECT p_partkey AS doc_id, 'Fogo' AS nome, p_brand AS escola, CAST(p_size AS VARCHAR) || ' PMs' AS custo FROM part")
def spell_blocks(spark, sf):
    return catalog.spell_blocks(_blocks(spark, sf)).select("doc_id", "nome", "escola", "custo")


@R.add("""WITH i AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 30), e AS (SELECT DISTINCT CASE WHEN p_name LIKE 'blue%' THEN 'old ' || p_name ELSE p_name END AS found FROM part WHERE p_size > 20 AND p_name NOT LIKE 'red%'),
eq AS (SELECT name, found FROM i JOIN e ON name = found), p AS (SELECT name, found, row_number() OVER (PARTITION BY name ORDER BY length(found) DESC, found) AS o FROM i JOIN e ON contains(name, found) OR contains(found, name) WHERE name NOT IN (SELECT name FROM eq)),
p1 AS (SELECT name, found FROM p WHERE o = 1)
SELECT name, found, CAST(1.0 AS DOUBLE) AS confidence, 'delimitador' AS method FROM eq UNION ALL SELECT name, found, 0.8, 'delimitador_parcial' FROM p1 UNION ALL SELECT name, NULL, 0.0, 'indice_apenas' FROM i WHERE name NOT IN (SELECT name FROM eq) AND name NOT IN (SELECT name FROM p1)
UNION ALL SELECT found, found, 0.9, 'extra' FROM e WHERE found NOT IN (SELECT found FROM eq UNION SELECT found FROM p1)""")
def reconcile_index(spark, sf):
    found = _names(spark, sf, "p_size > 20 and p_name not like 'red%'").select(F.when(F.col("name").like("blue%"), F.concat(F.lit("old "), "name")).otherwise(F.col("name")).alias("name"))
    return catalog.reconcile(_names(spark, sf, "p_size < 30"), found)


@R.add()
def located_names(spark, sf):
    names = spark.createDataFrame([("Idiot",), ("worthles",), ("Benutzerfehlr",), ("pathetic",)], "name string")
    return catalog.locate_names(names, table(spark, sf, "documents"))


@R.add("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT p_partkey AS doc_id, p_name AS t, p_partkey % 3 AS k FROM part WHERE p_partkey % 3 < 2),
m AS (SELECT name, doc_id, CASE WHEN contains(t, name) THEN CASE k WHEN 0 THEN 'exact' ELSE 'case' END
  WHEN length(split_part(name, ' ', 1)) > 3 AND list_contains(string_split(t, ' '), split_part(name, ' ', 1)) THEN 'first word'
  WHEN k = 0 AND 1 - CAST(levenshtein(name, t) AS DOUBLE) / greatest(length(name), length(t)) >= 0.75 THEN 'fuzzy' END AS method FROM n, b)
SELECT n.name, min(doc_id) AS doc_id, coalesce(arg_min(method, doc_id), 'missing') AS method, CASE WHEN min(doc_id) IS NOT NULL THEN CAST(0.4 AS DOUBLE) END AS confidence FROM n LEFT JOIN m ON n.name = m.name AND method IS NOT NULL GROUP BY n.name""")
def located_entries(spark, sf):
    """Parts as books in order: entries as they are, in capitals, and mentions without fields, which are no entries."""
    p = table(spark, sf, "part")
    entry = F.concat(F.lit("\nEscola: "), "p_brand", F.lit(".\nCusto: "), F.col("p_size").cast("string"), F.lit(" PMs.\n"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", entry)).when(F.col("p_partkey") % 3 == 1, F.concat(F.upper("p_name"), entry)).otherwise(F.concat(F.lit("see "), "p_name", F.lit(" here")))
    found = catalog.locate_entries(p.select(F.col("p_name").alias("name")), p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return found.select("name", "doc_id", "method", "confidence")


@R.add("""WITH a AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name LIKE 'red%'), b AS (SELECT DISTINCT p_name || ' two' AS name FROM part WHERE p_size > 10),
c AS (SELECT name FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE contains(b.name, a.name)))
SELECT name FROM a UNION ALL SELECT name FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.name < c.name AND (contains(c.name, x.name) OR contains(x.name, c.name)))""")
def cascade_merge(spark, sf):
    return catalog.cascade_merge([_names(spark, sf, "p_name like 'red%'"), _names(spark, sf, "p_size > 10").select(F.concat("name", F.lit(" two")).alias("name"))]).select("name")


@R.add("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 3 = 1 THEN 'x' ELSE 'b' || p_size END AS v FROM part")
def filled_stats(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("nome"), "p_size")
    v = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, "0").otherwise("")
    one = p.where("p_size % 3 = 1").select("nome", F.lit("x").alias("v"))
    two = p.select(F.lower("nome").alias("nome"), F.concat(F.lit("b"), F.col("p_size").cast("string")).alias("v"))
    return catalog.fill_stats(p.select("p_partkey", "nome", v.alias("v")), one, two, fields=["v"]).select("p_partkey", "v")


@R.add("SELECT name, source, page FROM (SELECT p_name AS name, 'BK' || p_size % 5 AS source, CAST(p_size AS INT) AS page, row_number() OVER (PARTITION BY p_name ORDER BY p_size, 'BK' || p_size % 5) AS o FROM part) WHERE o = 1")
def extracted_index(spark, sf):
    text = F.concat(F.lit("1; "), "p_name", F.lit(" (BK"), (F.col("p_size") % 5).cast("string"), F.lit(", pg. "), F.col("p_size").cast("string"), F.lit(") and more"))
    return catalog.extract_index(table(spark, sf, "part").select(text.alias("text")))


@R.add("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|anvil') THEN 'metal' WHEN p_name LIKE 'red%' THEN 'vermelho' WHEN p_name = 'blue bolt' THEN 'azul' ELSE 'diverso' END AS category FROM part")
def categorized_items(spark, sf):
    rules = [("azul", "name", "blue bolt"), ("vermelho", "prefix", "red"), ("metal", "regex", "ring|anvil")]
    return catalog.categorize(table(spark, sf, "part"), rules, name="p_name").select("p_partkey", "category")


@R.add("SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '^green') AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 1)")
def kept_items(spark, sf):
    blocked = _names(spark, sf, "p_size = 1")
    return catalog.drop_fragment_names(table(spark, sf, "part").withColumn("name", F.col("p_name")), blocked, ["^green"]).select("p_partkey")


@R.add("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_brand = 'Brand#2' DESC, length(p_type) > 0 DESC, length(p_type) DESC, p_partkey) AS o FROM part) WHERE o = 1")
def best_record(spark, sf):
    return catalog.best_record(table(spark, sf, "part"), ["Brand#2"], "p_name", "p_brand", "p_type", "p_partkey").select("p_partkey")


@R.add("""WITH c AS (SELECT 'n' || p_partkey AS name, p_type AS category, CAST(p_size AS DOUBLE) AS price, p_name AS text FROM part WHERE p_partkey % 2 = 0), e AS (SELECT 'N' || p_partkey AS name, 'extraido' AS category, CAST(NULL AS DOUBLE) AS price, '' AS text FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 > 0),
u AS (SELECT * FROM c UNION ALL SELECT * FROM e) SELECT u.name, category, coalesce(CASE WHEN p_partkey % 5 = 0 THEN p_retailprice END, price) AS price, CASE WHEN p_partkey % 7 = 0 AND length(p_brand || ' ' || p_name) > length(text) THEN p_brand || ' ' || p_name ELSE text END AS text FROM u JOIN part ON lower(u.name) = 'n' || p_partkey""")
def merged_items(spark, sf):
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey").cast("string"))
    name = F.concat(F.lit("n"), "k")
    c = p.where("p_partkey % 2 = 0").select(name.alias("name"), F.col("p_type").alias("category"), F.col("p_size").cast("double").alias("price"), F.col("p_name").alias("text"))
    e = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("N"), "k").alias("name"), F.lit(None).cast("double").alias("price"), F.lit("").alias("text"))
    prices = p.where("p_partkey % 5 = 0").select(name.alias("name"), F.col("p_retailprice").alias("price"))
    canonical = p.where("p_partkey % 7 = 0").select(name.alias("name"), F.concat_ws(" ", "p_brand", "p_name").alias("text"))
    return catalog.merge_items(c, e, prices, canonical)


@R.add("SELECT p_brand, CASE WHEN p_brand = 'Brand#2' THEN 1 WHEN p_brand LIKE '%#1%' THEN 0 WHEN p_brand LIKE '%#2%' THEN 1 ELSE 999 END AS priority, count(*) AS n FROM part GROUP BY 1, 2")
def source_priority(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", catalog.source_priority(F.col("p_brand"), ["#1", "Brand#2"]).alias("priority")).agg(F.count("*").alias("n"))


@R.add("WITH a AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS ability, p_partkey AS monster FROM part) SELECT ability, monster, CASE ability WHEN 'red' THEN 'one' WHEN 'ring' THEN 'two' END AS effect FROM a WHERE length(ability) > 2")
def ability_index(spark, sf):
    one, two = (spark.createDataFrame(r, "name string, effect string") for r in ([("Red", "one")], [("red", "late"), ("ring", "two")]))
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("monster"), F.transform(F.split("p_name", " "), lambda x: F.concat(x, F.lit(" (2)"))).alias("abilities"))
    return catalog.ability_index(m, [one, two])


@R.add(r"SELECT doc_id, kind, regexp_extract(text, CASE kind WHEN 'rude' THEN '((?:idiot|moron)[^.]{0,60})' ELSE '(token[^.]{0,60})' END, 1) AS details FROM documents, (VALUES ('rude'), ('secret')) k(kind) WHERE regexp_matches(text, CASE kind WHEN 'rude' THEN '((?:idiot|moron)[^.]{0,60})' ELSE '(token[^.]{0,60})' END)")
def combat_abilities(spark, sf):
    return catalog.combat_abilities(table(spark, sf, "documents"), [("rude", r"((?:idiot|moron)[^.]{0,60})"), ("secret", r"(token[^.]{0,60})")])


@R.add("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN 'given' END, p_brand) AS habitat, p_brand AS uso FROM part")
def enriched_descriptions(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "given").otherwise("").alias("habitat"), F.lit("old").alias("uso"), F.concat(F.lit("lives: "), "p_brand").alias("text"))
    return catalog.enrich_descriptions(p, {"habitat": "lives: (.*)", "uso": "lives: (.*)"}, ["uso"]).select("p_partkey", "habitat", "uso")


@R.add("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'full' WHEN p_partkey % 4 = 0 THEN 'part' ELSE p_name END AS a, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS b FROM part")
def overridden_rows(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    none = F.lit(None).cast("string").alias("b")
    return catalog.apply_overrides(p, p.where("p_partkey % 10 = 0").select("p_partkey", F.lit("full").alias("a"), none), p.where("p_partkey % 4 = 0").select("p_partkey", F.lit("part").alias("a"), none), "p_partkey", ["a", "b"])


@R.add("SELECT min(p_partkey) AS p_partkey FROM part GROUP BY p_name, lower(p_brand)")
def dedup_first(spark, sf):
    return catalog.dedup_first(table(spark, sf, "part"), "p_name", "p_brand", "p_partkey").select("p_partkey")


@R.add(r"SELECT 'idiot' AS name, doc_id, regexp_replace(string_split(substr(text, strpos(lower(text), 'idiot') + 5, 200), chr(10))[1], '^\s+|\s+$', '', 'g') AS description FROM documents WHERE contains(lower(text), 'idiot') AND list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 'idiot') AND length(regexp_replace(string_split(substr(text, strpos(lower(text), 'idiot') + 5, 200), chr(10))[1], '^\s+|\s+$', '', 'g')) >= 30")
def texts_after_name(spark, sf):
    return catalog.text_after_name(spark.createDataFrame([("idiot",)], "name string"), table(spark, sf, "documents"), "\n", 200, 30)


@R.add("SELECT CASE WHEN p_name IN ('red ring', 'blue ring') THEN 'ring' WHEN p_name = 'red widget' THEN 'widget' ELSE 'outro' END AS type, count(*) AS n FROM part GROUP BY 1")
def types_by_list(spark, sf):
    return catalog.classify_type(table(spark, sf, "part"), {"ring": ["Red ring", "blue ring"], "widget": ["red widget"]}, name="p_name").groupBy("type").agg(F.count("*").alias("n"))


@R.add("SELECT 'regra' AS kind, p_name AS title, p_name || chr(10) || p_brand || chr(10) || p_type AS content FROM part")
def consolidated_rows(spark, sf):
    return catalog.consolidate(table(spark, sf, "part"), "regra", "p_name", ["p_brand", "p_type"])


@R.add("""WITH u AS (SELECT p_name AS name, p_brand AS source, 0 AS l FROM part WHERE p_size % 2 = 0 UNION ALL SELECT upper(p_name), p_brand, 1 FROM part WHERE p_size % 2 > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY CASE WHEN source = 'Brand#2' THEN 1 WHEN source LIKE '%#1%' THEN 0 WHEN source LIKE '%#2%' THEN 1 ELSE 999 END, l, source, name) AS o FROM u) SELECT name, source FROM r WHERE o = 1""")
def merged_advantages(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_size % 2 = 0").select(F.col("p_name").alias("name"), F.col("p_brand").alias("source"))
    return catalog.merge_advantages(a, p.where("p_size % 2 > 0").select(F.upper("p_name").alias("name"), F.col("p_brand").alias("source")), ["#1", "Brand#2"])


@R.add(r"""WITH n AS (SELECT regexp_extract(text, '^[\p{L}]{4,55}') AS name, doc_id FROM documents) SELECT name, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id, name) AS o FROM n WHERE length(name) >= 4 AND lower(name) <> 'that') WHERE o = 1""")
def discovered_items(spark, sf):
    return catalog.discover_items(table(spark, sf, "documents"), [r"^([\p{L}]{4,55})"], ["that"], gate=1.0)


@R.add("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END AS price, length(p_type) + 16 >= 20 AS plausible FROM part")
def priced_items(spark, sf):
    text = F.concat(F.lit("uso "), "p_type", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" Preço: "), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."))).otherwise(F.concat(F.lit(" vale "), F.lpad((F.col("p_size") + 1).cast("string"), 2, "0"), F.lit(" PE"))))
    return catalog.item_fields(table(spark, sf, "part").withColumn("text", F.rpad(text, 200, " ").substr(F.lit(1), F.length("p_type") + 16))).select("p_partkey", "price", "plausible")


@R.add("SELECT source, term, CAST(sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term)) AS BIGINT) AS n FROM documents, (VALUES ('idiot'), ('token')) t(term) GROUP BY 1, 2 HAVING sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term)) > 0")
def source_terms(spark, sf):
    return catalog.term_counts(table(spark, sf, "documents"), ["idiot", "token"])
