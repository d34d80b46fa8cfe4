"""Queries over typed tables: normalisation, enrichment, indexes and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import chunking, tables
from ..sources import io
from .binding import EQUIPMENT_ROWS, STAT_ROWS, Registry, duck, equipment_table, stat_table, table

R = Registry()
STATS, EQUIPMENT = duck(STAT_ROWS), duck(EQUIPMENT_ROWS)
CLAMPED = f"""WITH rows AS ({STATS}), s AS (SELECT row_id, nome, greatest(1, least(100, forca)) AS forca, greatest(1, least(100, habilidade)) AS habilidade, greatest(1, least(100, resistencia)) AS resistencia,
  greatest(0, least(50, armadura)) AS armadura, greatest(1, least(1000, pv)) AS pv, greatest(0, least(500, coalesce(pm, 0))) AS pm FROM rows),
p AS (SELECT *, forca + habilidade + resistencia + pv // 10 AS poder_combate FROM s)"""
MEAN = "CASE WHEN regexp_matches(dano, '^\\d+d\\d+') THEN (CAST(regexp_extract(dano, '^(\\d+)d(\\d+)([+-]\\d+)?', 2) AS INT) + 1) / 2 * CAST(regexp_extract(dano, '^(\\d+)d', 1) AS INT) + coalesce(TRY_CAST(regexp_extract(dano, '^(\\d+)d(\\d+)([+-]\\d+)?', 3) AS INT), 0) ELSE TRY_CAST(dano AS DOUBLE) END"


@R.add(CLAMPED + " SELECT row_id, forca, habilidade, resistencia, armadura, pv, pm, CAST(poder_combate AS BIGINT) AS poder_combate FROM p")
def stats_rows(spark, sf):
    return tables.stats_rows(stat_table(spark, sf)).select("row_id", *tables.STATS, F.col("poder_combate").cast("long"))


@R.add(CLAMPED + """ SELECT row_id, habilidade AS iniciativa, forca + habilidade AS ataque_fisico, CAST(forca // 2 AS BIGINT) AS dano_bonus, resistencia AS resistencia_magia,
  CASE WHEN poder_combate < 10 THEN 'Fraco' WHEN poder_combate < 30 THEN 'Médio' WHEN poder_combate < 60 THEN 'Forte' ELSE 'Épico' END AS categoria_poder, CAST(poder_combate * 10 AS BIGINT) AS xp_sugerido FROM p""")
def enriched_stats(spark, sf):
    rows = tables.enrich_stats(tables.stats_rows(stat_table(spark, sf)))
    return rows.select("row_id", "iniciativa", "ataque_fisico", F.col("dano_bonus").cast("long"), "resistencia_magia", "categoria_poder", F.col("xp_sugerido").cast("long"))


@R.add(f"WITH e AS ({EQUIPMENT}) SELECT row_id, CASE WHEN dano <> '' THEN 'arma' WHEN defesa IS NOT NULL THEN 'armadura' ELSE 'item' END AS tipo, {MEAN} AS dano_medio, round_even(({MEAN}) / pe * 100, 0) / 100 AS eficiencia_dano_pe, round_even(CAST(defesa AS DOUBLE) / pe * 100, 0) / 100 AS eficiencia_defesa_pe, CASE WHEN dano <> '' THEN CASE WHEN {MEAN} < 4 THEN 'Leve' WHEN {MEAN} < 7 THEN 'Média' ELSE 'Pesada' END END AS categoria_poder FROM e")
def normalized_equipment(spark, sf):
    rows = tables.enrich_equipment(tables.equipment_rows(equipment_table(spark, sf)))
    return rows.select("row_id", "tipo", parse.dice_mean(F.col("dano")).alias("dano_medio"), "eficiencia_dano_pe", "eficiencia_defesa_pe", "categoria_poder")


@R.add("""SELECT p_partkey, 'Instantânea' AS duracao, CASE WHEN p_size % 2 = 0 THEN 'Toque' ELSE p_brand END AS alcance, p_size % 30 AS custo_pm, contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass') AS is_combate,
  CASE WHEN p_size % 6 > 0 THEN p_size % 30 BETWEEN p_size % 6 * 2 AND p_size % 6 * 5 END AS custo_dentro_padrao FROM part""")
def enriched_spells(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select("p_partkey", F.col("p_name").alias("nome"), F.col("p_type").alias("descricao"), (F.col("p_size") % 30).alias("custo_pm"), (F.col("p_size") % 6).alias("circulo"), F.lit(None).cast("string").alias("duracao"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("alcance"))
    rows = tables.enrich_spells(tables.spell_rows(rows), ["steel", "brass"])
    return rows.select("p_partkey", "duracao", "alcance", "custo_pm", "is_combate", "custo_dentro_padrao")


@R.add(r"""SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '(-?\d+)', 1) AS INT) AS first_int, lower(concat(p_size % 5, 'D6+', p_size)) AS dice, concat_ws(', ', trim(p_brand), trim(p_type)) AS parts FROM part""")
def parsed_cells(spark, sf):
    dice = F.concat((F.col("p_size") % 5).cast("string"), F.lit("D6+"), F.col("p_size").cast("string"), F.lit(" or so"))
    parts = parse.split_list(F.concat("p_brand", F.lit("; ;,"), "p_type", F.lit(",")))
    return table(spark, sf, "part").select("p_partkey", parse.first_int(F.col("p_brand")).alias("first_int"), parse.norm_dice(dice).alias("dice"), F.concat_ws(", ", parts).alias("parts"))


@R.add(f"WITH rows AS ({STATS}) SELECT row_id, nome FROM rows WHERE coalesce(pm, 0) >= 10 AND coalesce(pm, 999) <= 999 AND coalesce(pv, 999) <= 150")
def range_lookup(spark, sf):
    return tables.find_by_range(stat_table(spark, sf), pm=(10, None), pv=(None, 150)).select("row_id", "nome")


PAIRS = "SELECT 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS a, 'Customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0') AS b FROM customer"
UNPIVOT = f"""WITH r AS ({STATS}), n AS (SELECT row_id, nome, forca, habilidade, resistencia, armadura, pv, coalesce(pm, 0) AS pm FROM r),
d AS (SELECT x.nome AS a, y.nome AS b, unnest(['forca', 'habilidade', 'resistencia', 'armadura', 'pv', 'pm']) AS stat,
  unnest([x.forca, x.habilidade, x.resistencia, x.armadura, x.pv, x.pm]) AS value_a, unnest([y.forca, y.habilidade, y.resistencia, y.armadura, y.pv, y.pm]) AS value_b FROM n x JOIN n y ON y.row_id = x.row_id + 1)"""


def _pairs(spark, sf):
    rows = stat_table(spark, sf)
    after = rows.select((F.col("row_id") - 1).alias("row_id"), F.col("nome").alias("b"))
    return rows, rows.select("row_id", F.col("nome").alias("a")).join(after, "row_id")


@R.add(UNPIVOT + " SELECT a, b, stat, value_a, value_b, value_a - value_b AS difference, CASE WHEN value_a > value_b THEN 1 WHEN value_a < value_b THEN 2 ELSE 0 END AS advantage FROM d")
def compare_pairs(spark, sf):
    rows, pairs = _pairs(spark, sf)
    return tables.compare_stats(rows, pairs)


@R.add(UNPIVOT + ", w AS (SELECT a, b, count(*) FILTER (value_a > value_b) AS won_a, count(*) FILTER (value_a < value_b) AS won_b FROM d GROUP BY a, b) SELECT *, CASE WHEN won_a > won_b THEN a WHEN won_b > won_a THEN b ELSE 'Empate' END AS winner FROM w")
def pair_winners(spark, sf):
    rows, pairs = _pairs(spark, sf)
    return tables.winners(tables.compare_stats(rows, pairs))


@R.add("SELECT lower(p_brand) AS key, p_partkey AS row_id FROM part")
def table_index(spark, sf):
    return tables.table_index(table(spark, sf, "part"), F.lower("p_brand"), "p_partkey")


@R.add("SELECT p_type AS table_type, p_brand AS nome, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS repeat, p_partkey AS row_id FROM part QUALIFY repeat > 1")
def table_consistency(spark, sf):
    return tables.repeated_names(table(spark, sf, "part").select(F.col("p_type").alias("table_type"), F.col("p_brand").alias("nome"), F.col("p_partkey").alias("row_id")))


@R.add("SELECT p_partkey FROM part WHERE p_size % 6 > 0 AND p_size > 10 * (p_size % 6)")
def costly_spells(spark, sf):
    return tables.costly_spells(table(spark, sf, "part").withColumns({"circulo": F.col("p_size") % 6, "custo_pm": F.col("p_size")})).select("p_partkey")


@R.add("SELECT CASE WHEN grouping(p_type) = 0 THEN p_type END AS table_type, CASE WHEN grouping(p_brand) = 0 THEN p_brand END AS source, count(*) AS tables FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), ())")
def table_stats(spark, sf):
    return tables.table_stats(table(spark, sf, "part").select(F.col("p_type").alias("table_type"), F.col("p_brand").alias("source")))


@R.add("SELECT substr(md5(concat_ws('_', p_brand, CAST(p_size AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN 'None' ELSE p_name END)), 1, 12) AS table_id, count(*) AS n FROM part GROUP BY 1")
def table_ids(spark, sf):
    key = tables.table_id(F.col("p_brand"), F.col("p_size"), F.when(F.col("p_size") % 2 != 0, F.col("p_name")))
    return table(spark, sf, "part").groupBy(key.alias("table_id")).agg(F.count("*").alias("n"))


@R.add("""WITH h AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ['F', 'H', 'R', 'x'] WHEN 1 THEN ['custo', 'pm', 'nome'] WHEN 2 THEN ['PE', 'Dano'] WHEN 3 THEN ['a'] WHEN 4 THEN ['CUSTO PE', 'Bônus de Ataque', 'HAB. ESPECIAIS'] ELSE ['Custo PM', ' escola ', 'Duração!', o_orderpriority] END AS headers FROM orders),
k AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'stats' WHEN 1 THEN 'magias' WHEN 2 THEN 'equipamentos' ELSE 'desconhecido' END AS kind, unnest(headers) AS header FROM h)
SELECT kind, CASE header WHEN 'F' THEN 'forca' WHEN 'H' THEN 'habilidade' WHEN 'R' THEN 'resistencia' WHEN 'custo' THEN 'custo_pm' WHEN 'a' THEN 'armadura' WHEN 'CUSTO PE' THEN 'pe' WHEN 'Bônus de Ataque' THEN 'bonus' WHEN 'HAB. ESPECIAIS' THEN 'habilidades_especiais'
  WHEN 'Custo PM' THEN 'custo_pm' WHEN ' escola ' THEN 'escola' WHEN 'Duração!' THEN 'duracao' ELSE lower(header) END AS name, count(*) AS n FROM k GROUP BY 1, 2""")
def header_kinds(spark, sf):
    sets = [["F", "H", "R", "x"], ["custo", "pm", "nome"], ["PE", "Dano"], ["a"], ["CUSTO PE", "Bônus de Ataque", "HAB. ESPECIAIS"], ["Custo PM", " escola ", "Duração!"]]
    headers = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in sets]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    headers = F.when(F.col("o_orderkey") % 6 == 5, F.array_append(headers, F.col("o_orderpriority"))).otherwise(headers)
    rows = table(spark, sf, "orders").select(headers.alias("headers"))
    rows = rows.select(tables.table_kind(F.col("headers")).alias("kind"), F.explode("headers").alias("header"))
    return rows.groupBy("kind", tables.header_name(F.col("header")).alias("name")).agg(F.count("*").alias("n"))


@R.add("""WITH r AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS row_index, l_returnflag || ' | ' || l_linestatus AS raw_text FROM lineitem)
SELECT CAST(table_id AS VARCHAR) || '_row_' || CAST(row_index AS VARCHAR) AS id, raw_text AS content FROM r UNION ALL SELECT CAST(table_id AS VARCHAR) || '_full', string_agg(raw_text, chr(10) ORDER BY row_index) FROM r GROUP BY table_id""")
def table_chunks(spark, sf):
    body = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))), lambda x: F.array(x["l_returnflag"], x["l_linestatus"]))
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("table_id")).agg(body.alias("body")).withColumn("headers", F.array(F.lit("flag"), F.lit("status")))
    return tables.table_chunks(tables.rows_to_cells(t))


@R.add("""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'stats' WHEN 1 THEN 'magias' ELSE 'equipamentos' END AS table_type, count(*) AS processed,
  count(*) FILTER (o_orderkey % 3 > 0 OR o_custkey % 7 > 0) AS normalized, count(*) FILTER (o_orderkey % 3 = 0 AND o_custkey % 7 = 0) AS rejected FROM orders GROUP BY 1""")
def normalize_counts(spark, sf):
    return tables.normalize_counts(tables.normalize_tables(_order_cells(spark, sf)))


def _order_cells(spark, sf):
    value = F.when(F.col("o_custkey") % 7 > 0, F.concat((F.col("o_custkey") % 50).cast("string"), F.lit("-x"))).otherwise("")
    cells = F.create_map(F.lit("nome"), F.col("o_orderpriority"), *[x for s in tables.STATS for x in (F.lit(s), value)])
    kind = F.element_at(F.array(F.lit("stats"), F.lit("magias"), F.lit("equipamentos")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select(kind.alias("table_type"), cells.alias("cells"))


@R.add("""WITH o AS (SELECT o_orderkey % 3 AS k, o_orderkey % 3 > 0 OR o_custkey % 7 > 0 AS ok FROM orders)
SELECT count(*) AS processed, count(*) FILTER (ok) AS normalized, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (k = 0 AND ok) AS stats_normalized, count(*) FILTER (k = 0 AND NOT ok) AS stats_rejected,
  count(*) FILTER (k = 1 AND ok) AS magias_normalized, 0 AS magias_rejected, count(*) FILTER (k = 2 AND ok) AS equipamentos_normalized, 0 AS equipamentos_rejected, count(*) FILTER (ok) AS written FROM o""")
def normalize_job(spark, sf):
    """The counters that the job observed, and the good rows that its table holds."""
    with io.scratch_dir(spark) as path:
        counted = tables.normalize_job(_order_cells(spark, sf), path)
        counted["written"] = spark.read.parquet(path).where("ok = 'true'").count()
    return spark.createDataFrame([counted])


@R.add(r"""WITH q(query, k) AS (VALUES ('ring', 'ring'), ('the old Small RING', 'the old small ring'), ('RED widget', 'red widget'), ('no such', 'no such')), n AS (SELECT p_partkey, lower(p_name) AS k FROM part),
e AS (SELECT query, p_partkey, true AS exact FROM q JOIN n USING (k))
SELECT * FROM e UNION ALL SELECT query, p_partkey, false FROM q JOIN n ON contains(n.k, q.k) OR contains(q.k, n.k) WHERE query NOT IN (SELECT query FROM e)""")
def name_lookup(spark, sf):
    asked = spark.createDataFrame([(x,) for x in ("ring", "the old Small RING", "RED widget", "no such")], "query string")
    return tables.find_by_name(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("nome")), asked).select("query", "p_partkey", "exact")


@R.add("SELECT p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def type_lookup(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("table_type"))
    return tables.find_by_type(part, part.agg(F.min("table_type")).first()[0]).select("p_partkey")


@R.add(f"""WITH e AS ({EQUIPMENT}) SELECT row_id, '**' || nome || '** (' || CASE WHEN dano <> '' THEN 'arma' WHEN defesa IS NOT NULL THEN 'armadura' ELSE 'item' END || '): Dano ' || coalesce(dano, '-') || ', Defesa ' || coalesce(CAST(defesa AS VARCHAR), '-') || ', PE ' || CAST(pe AS VARCHAR) || '. ' || substr(descricao, 1, 150) AS sentence FROM e""")
def row_sentences(spark, sf):
    rows = tables.equipment_rows(equipment_table(spark, sf)).withColumns({c: F.lit(None).cast("string") for c in ["forca", "habilidade", "resistencia", "armadura", "pv", "pm", "circulo", "custo_pm", "alcance", "duracao"]})
    return rows.select("row_id", tables.row_text(rows).alias("sentence"))


@R.add("SELECT o_orderkey AS table_id FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n >= 3 AND o_orderstatus IN ('F', 'O')")
def accepted_tables(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.collect_list("l_linenumber").alias("rows"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("table_id"), F.col("o_orderstatus").alias("table_type"))
    return tables.accept_tables(rows.join(orders, "table_id"), ["F", "O"], 3).select("table_id")


def _stat_text(spark, sf):
    """Pages with stat lines, made of suppliers: a name and five or six integers a line, a heading above."""
    s = table(spark, sf, "supplier")
    numbers = F.concat_ws("  ", *[(F.col("s_suppkey") % k).cast("string") for k in (5, 7, 11, 13, 17)])
    line = F.concat(F.lit("Golem  "), numbers)
    return s.select(F.col("s_suppkey").alias("doc_id"), F.concat_ws("\n", F.lit("TABELA"), F.lit("Nome  F  H  R  A  PV"), line, line, F.lit(""), F.lit("text")).alias("text"))


@R.add("SELECT s_suppkey AS doc_id, 'Golem' AS nome, CAST(s_suppkey % 5 AS INT) AS forca, CAST(s_suppkey % 7 AS INT) AS habilidade, CAST(s_suppkey % 11 AS INT) AS resistencia, CAST(s_suppkey % 13 AS INT) AS armadura, CAST(s_suppkey % 17 AS INT) AS pv FROM supplier, range(2)")
def stat_lines(spark, sf):
    return tables.stat_lines(_stat_text(spark, sf))


@R.add("SELECT s_suppkey AS doc_id, 1 AS table_no, pos, pos = 1 AS is_header, CASE pos WHEN 1 THEN 6 ELSE 6 END AS cells FROM supplier, range(1, 4) r(pos)")
def tables_in_text(spark, sf):
    return chunking.table_rows_of_text(_stat_text(spark, sf)).select("doc_id", F.col("table_no").cast("long"), F.col("pos").cast("long"), "is_header", F.size("cells").alias("cells"))


@R.add("SELECT s_suppkey AS table_id, 'TABELA' AS title FROM supplier")
def table_titles(spark, sf):
    pages = _stat_text(spark, sf)
    return tables.table_title(chunking.lines(pages), pages.select(F.col("doc_id").alias("table_id"), "doc_id", F.lit(1).alias("header_pos")))


@R.add("SELECT CAST(s_suppkey AS VARCHAR) AS source, 'table' AS kind, count(*) AS chunks FROM supplier GROUP BY 1 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'text', 1 FROM supplier")
def layout_chunks(spark, sf):
    pages = _stat_text(spark, sf).select(F.col("doc_id").cast("string").alias("source"), F.lit(1).alias("page"), "text")
    found = pages.select("source", "page", F.lit("t").alias("title"), F.element_at(F.split("text", "\n"), 3).alias("raw_text"))
    return chunking.layout_chunks(pages, found).groupBy("source", "kind").agg(F.count("*").alias("chunks"))
