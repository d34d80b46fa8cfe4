"""Queries of domain analytics, training sets and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import domain, trainset
from ..streaming import logs
from .binding import Registry, stat_table, table

R = Registry()


@R.add("""WITH s AS (SELECT c_custkey, least(25.0, 1.5 * (c_custkey % 5 + (c_custkey % 3 + c_custkey % 3 + 1) / 2.0 + c_custkey % 4)) + least(20.0, (c_custkey % 60 + floor((1 + c_custkey % 4) * 3.5 + 2 + 0.5)) / 4) + least(25.0, greatest(-5.0, 1.5 * CASE c_custkey % 3 WHEN 0 THEN 2.5 WHEN 1 THEN -0.5 ELSE 1.0 END))
 + least(15, (c_custkey % 3) * 2 - CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END) + CASE WHEN c_custkey % 10 = 0 THEN 10 ELSE 0 END + least(10, (c_custkey % 7) * 2) AS t FROM customer), r AS (SELECT c_custkey, CAST(floor(greatest(0.0, least(100.0, t)) + 0.5) AS INT) AS strength FROM s)
SELECT c_custkey, strength, CASE WHEN strength < 15 THEN 'Muito fraco' WHEN strength < 30 THEN 'Fraco' WHEN strength < 50 THEN 'Médio' WHEN strength < 70 THEN 'Forte' WHEN strength < 85 THEN 'Muito forte' ELSE 'Extremo' END AS label FROM r""")
def strength(spark, sf):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    many = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    abilities = F.when(k % 3 == 0, F.array(F.lit("Voo (5)"), F.lit("outra"))).when(k % 3 == 1, F.array(F.lit("Inculto"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    rows = table(spark, sf, "customer").select("c_custkey", text(k % 5).alias("f"), F.concat(text(k % 3), F.lit("-"), text(k % 3 + 1)).alias("h"), text(k % 4).alias("r"), F.lit("").alias("a"), F.lit(None).cast("string").alias("pdf"), text(k % 60).alias("pv"), F.concat(text(1 + k % 4), F.lit("d+2")).alias("pm"), abilities.alias("abilities"), many(k % 3).alias("immunities"), F.array().cast("array<string>").alias("vulnerabilities"), F.when(k % 2 == 0, F.array(F.lit("sol"))).otherwise(F.array().cast("array<string>")).alias("weaknesses"), many(k % 7).alias("attacks"), F.when(k % 10 == 0, "61S").otherwise("N").alias("scale"))
    return domain.strength(rows).select("c_custkey", "strength", "label")


@R.add("""WITH p AS (SELECT o_custkey % 50 AS party_id, 1 + o_custkey % 50 % 12 AS level FROM orders GROUP BY 1, 2), m AS (SELECT c_name AS monster, c_custkey % 23 + c_custkey % 17 + c_custkey % 13 + (c_custkey % 211) // 10 AS power FROM customer),
r AS (SELECT party_id, monster, power, row_number() OVER (PARTITION BY party_id ORDER BY power, monster) AS rank FROM p JOIN m ON power // 3 BETWEEN level - 2 AND level + 2) SELECT party_id, monster, CAST(power AS BIGINT) AS power, rank FROM r WHERE rank <= 10""")
def encounter_candidates(spark, sf):
    return _candidates(spark, sf).select("party_id", "monster", F.col("power").cast("long"), F.col("rank").cast("long"))


def _parties(spark, sf):
    party = (F.col("o_custkey") % 50).alias("party_id")
    rows = table(spark, sf, "orders").select(party).distinct()
    kinds = F.array(*map(F.lit, domain.DIFFICULTY))
    return rows.select("party_id", (1 + F.col("party_id") % 12).cast("int").alias("level"), F.lit(4).alias("size"), F.get(kinds, (F.col("party_id") % 4).cast("int")).alias("difficulty"))


def _candidates(spark, sf):
    m = stat_table(spark, sf).select(F.col("nome").alias("monster"), (F.col("forca") + F.col("habilidade") + F.col("resistencia") + F.expr("pv div 10")).alias("power"))
    return domain.encounter_candidates(_parties(spark, sf), m)


@R.add("""WITH p AS (SELECT DISTINCT o_custkey % 50 AS party_id, 1 + o_custkey % 50 % 12 AS level, (o_custkey % 50) % 4 AS d FROM orders), m AS (SELECT c_name AS monster, c_custkey % 23 + c_custkey % 17 + c_custkey % 13 + (c_custkey % 211) // 10 AS power FROM customer),
r AS (SELECT party_id, level, d, monster, power, row_number() OVER (PARTITION BY party_id ORDER BY power, monster) AS rank FROM p JOIN m ON power // 3 BETWEEN level - 2 AND level + 2), c AS (SELECT *, count(*) OVER (PARTITION BY party_id) AS n FROM r WHERE rank <= 10),
t AS (SELECT party_id, level * 400 * [0.5, 1.0, 1.5, 2.0][d + 1] AS target, monster, greatest(1, power * 10) AS each FROM c WHERE rank = CASE d WHEN 0 THEN 1 WHEN 1 THEN (n + 1) // 2 ELSE n END),
x AS (SELECT party_id, CAST(target AS DOUBLE) AS target, monster, CAST(greatest(1, floor(target / each)) AS INT) AS n, CAST(greatest(1, floor(target / each)) * each AS BIGINT) AS xp FROM t)
SELECT *, CASE WHEN xp / target < 0.7 THEN 'facil' WHEN xp / target < 1.3 THEN 'medio' WHEN xp / target < 2.0 THEN 'dificil' ELSE 'mortal' END AS actual FROM x""")
def composed_encounters(spark, sf):
    return domain.compose_encounters(_parties(spark, sf), _candidates(spark, sf))


def _builds(spark, sf):
    k = F.col("c_custkey")
    choices = F.array(F.concat(F.lit("adv"), (k % 5).cast("string")), F.concat(F.lit("dis"), (k % 3).cast("string")))
    return table(spark, sf, "customer").select(k.alias("build_id"), *[(k % n).cast("int").alias(c) for c, n in (("f", 3), ("h", 2), ("r", 4), ("a", 2), ("pdf", 7))], choices.alias("choices"), (k % 2).cast("int").alias("extra_pv"), F.lit(0).alias("extra_pm"), F.concat(F.lit("race"), (k % 4).cast("string")).alias("race"))


def _costs(spark):
    return spark.createDataFrame([(f"adv{i}", i, None if i < 4 else "adv1") for i in range(5)] + [(f"dis{i}", -i, None) for i in range(3)], "name string, cost int, requires string")


@R.add("""WITH b AS (SELECT c_custkey AS k, c_custkey % 3 AS f, c_custkey % 2 AS h, c_custkey % 4 AS r, c_custkey % 7 AS pdf, c_custkey % 5 AS adv, c_custkey % 3 AS dis FROM customer)
SELECT k AS build_id, CAST(f + h + r + h + pdf + adv AS BIGINT) AS spent, CAST(5 + dis - (f + h + r + h + pdf) - adv AS BIGINT) AS left, CAST(greatest(1, r * 5) + 5 * (k % 2) AS INT) AS pv, CAST(greatest(1, r * 5) AS INT) AS pm, concat_ws(',', CASE WHEN 5 + dis - (f + h + r + h + pdf) - adv < 0 THEN 'points' END, CASE WHEN pdf > 5 THEN 'stat_limit' END) AS violations FROM b""".replace("AS left", 'AS "left"'))
def check_builds(spark, sf):
    return domain.check_builds(_builds(spark, sf), _costs(spark)).withColumn("violations", F.array_join("violations", ","))


@R.add("""WITH b AS (SELECT c_custkey AS k FROM customer), c(name, cost, requires) AS (VALUES ('adv0', 0, NULL), ('adv1', 1, NULL), ('adv2', 2, NULL), ('adv3', 3, NULL), ('adv4', 4, 'adv1'), ('dis0', 0, NULL), ('dis1', -1, NULL), ('dis2', -2, NULL))
SELECT k AS build_id, name FROM b, c WHERE cost <= 4 AND name <> 'adv' || k % 5 AND name <> 'dis' || k % 3 AND NOT (k % 4 = 1 AND name = 'adv2') AND NOT (k % 5 = 0 AND name = 'adv3') AND (requires IS NULL OR requires IN ('adv' || k % 5, 'dis' || k % 3))""")
def allowed_choices(spark, sf):
    excluded = spark.createDataFrame([("race1", "adv2")], "race string, name string")
    exclusive = spark.createDataFrame([("adv0", "adv3")], "name string, other string")
    return domain.allowed_choices(_builds(spark, sf), _costs(spark), excluded, exclusive, F.lit(4))


@R.add("""WITH b AS (SELECT c_custkey AS k, c_custkey % 5 AS l, CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END AS own FROM customer), c(name, p) AS (SELECT 'x' || i, i FROM range(1, 5) r(i)),
t AS (SELECT *, c_custkey % 3 AS taken FROM customer)
SELECT c_custkey AS build_id, name FROM t, c WHERE CASE c_custkey % 5 WHEN 0 THEN p = 1 AND taken <> 1 WHEN 1 THEN p = 1 AND taken < 2 OR p = 2 AND taken = 0 WHEN 2 THEN p = 1 AND taken < 2 OR p = 2 AND taken <> 1 OR p > 2 AND taken = 0
  WHEN 3 THEN p < 3 OR taken = 0 ELSE true END""")
def limited_choices(spark, sf):
    """Disadvantages of one to four points that builds of five levels with none, one of one point or one of two have room for."""
    k = F.col("c_custkey")
    level = F.element_at(F.array(*map(F.lit, ("pessoa_comum", "novato", "lutador", "campeao", "lenda"))), (k % 5 + 1).cast("int"))
    held = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("y"), (k % 3).cast("string"))))
    builds = table(spark, sf, "customer").select(k.alias("build_id"), level.alias("level"), held.alias("choices"))
    catalog = spark.createDataFrame([(f"x{i}", -i) for i in range(1, 5)] + [("y1", -1), ("y2", -2)], "name string, cost int")
    every = builds.select("build_id", F.explode(F.array(*[F.lit(f"x{i}") for i in range(1, 5)])).alias("name"))
    return domain.within_limits(every, builds, catalog)


@R.add("SELECT c_custkey AS build_id, p_partkey AS spell FROM customer JOIN part ON c_custkey % 2 = 0 AND p_size % 5 < 2 AND c_custkey % 100 = p_partkey % 100")
def eligible_spells(spark, sf):
    builds = table(spark, sf, "customer").select(F.col("c_custkey").alias("build_id"), F.concat(F.lit("p"), (F.col("c_custkey") % 100).cast("string")).alias("path"), (1 - F.col("c_custkey") % 2).alias("value"))
    spells = table(spark, sf, "part").where("p_size % 5 < 2").select(F.col("p_partkey").alias("spell"), F.concat(F.lit("nada, Escola"), (F.col("p_partkey") % 100).cast("string")).alias("schools"))
    return domain.eligible_spells(builds, spells, {f"escola{i}": f"p{i}" for i in range(100)})


@R.add("SELECT c_custkey AS build_id, greatest(0, c_custkey % 3 + CASE WHEN c_custkey % 4 = 1 THEN -1 WHEN c_custkey % 4 = 2 THEN 2 ELSE 0 END) AS f, CASE WHEN c_custkey % 4 = 1 THEN 3 ELSE 2 END AS n_choices FROM customer")
def raced_builds(spark, sf):
    packages = spark.createDataFrame([("race1", -1, 0, 0, ["wings"]), ("race2", 2, 0, 0, [])], "race string, f_mod int, h_mod int, r_mod int, granted array<string>")
    return domain.apply_race(_builds(spark, sf), packages).select("build_id", F.col("f").cast("long"), F.size("choices").alias("n_choices"))


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", F.floor("value").cast("int").alias("xp"), F.array(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")), F.concat(F.lit("u"), (F.col("event_id") % 40).cast("string"))).alias("participants"), F.col("event_type").alias("description"), F.lit("").alias("place"))


@R.add("""WITH e AS (SELECT event_id, ts, CAST(floor(value) AS INT) AS xp, unnest(list_distinct(['u' || user_id % 40, 'u' || event_id % 40])) AS character FROM events), i AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM e WHERE character IN (SELECT 'u' || x FROM range(30) t(x)))
SELECT character, CAST(sum(xp // n) AS BIGINT) AS xp, count(*) AS appearances, max(ts) AS last_seen FROM i GROUP BY character""")
def xp_ledger(spark, sf):
    party = spark.range(30).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("character"))
    return domain.xp_ledger(_events(spark, sf), party)


LEVELS = "[0, 1000, 3000, 6000, 10000, 15000, 21000, 28000, 36000, 45000]"


@R.add(f"""WITH u AS (SELECT user_id, CAST(sum(floor(value)) AS BIGINT) * 20 AS xp FROM events GROUP BY 1), l AS (SELECT *, len(list_filter({LEVELS}, lambda t: t <= xp)) AS level FROM u)
SELECT user_id, xp, CAST(level AS INT) AS level, {LEVELS}[level + 1] AS next_xp, CASE WHEN level < 10 THEN greatest(0, {LEVELS}[level + 1] - xp) END AS missing, CASE WHEN level < 10 THEN CAST(floor((xp - {LEVELS}[level]) / CAST({LEVELS}[level + 1] - {LEVELS}[level] AS DOUBLE) * 100 + 0.5) AS INT) ELSE 100 END AS progress FROM l""")
def levels(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg((F.sum(F.floor("value")) * 20).alias("xp"))
    rows = domain.levels(u)
    return rows.withColumn("missing", F.when(F.col("next_xp").isNotNull(), F.col("missing")))


@R.add(f"""WITH u AS (SELECT user_id, CAST(sum(floor(value)) AS BIGINT) AS xp FROM events GROUP BY 1) SELECT user_id, CAST(ceil((list_filter({LEVELS}, lambda t: t > xp)[1] - xp) / 100.0) AS BIGINT) AS encounters FROM u""")
def progression(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.floor("value")).alias("xp"))
    return domain.progression(u).select("user_id", "encounters")


@R.add("""WITH q(query_id, w) AS (VALUES (1, 'purchase'), (2, 'u7')), s AS (SELECT query_id, CAST(event_id AS VARCHAR) AS item, CASE WHEN w = event_type THEN 3 ELSE 0 END + CASE WHEN w IN ('u' || user_id % 40, 'u' || event_id % 40) THEN 2 ELSE 0 END AS score FROM events, q),
a AS (SELECT query_id, 'event' AS kind, item, score FROM s WHERE score > 0 UNION ALL SELECT 2, 'character', 'u7', 5 UNION ALL SELECT DISTINCT 1, 'thread', event_type, 4 FROM events WHERE event_type = 'purchase'), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, item) AS o FROM a) SELECT query_id, kind, item, CAST(score AS BIGINT) AS score FROM r WHERE o <= 5""")
def event_recall(spark, sf):
    asked = spark.createDataFrame([(1, "purchase"), (2, "U7")], "query_id int, query string")
    names = spark.range(40).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"))
    threads = table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct()
    return domain.recall(asked, _events(spark, sf), names, threads)


@R.add("WITH e AS (SELECT event_id, user_id % 10 AS campaign, CAST(date_trunc('day', ts) AS DATE) AS session, event_id % 6 AS importance FROM events) SELECT event_id FROM (SELECT *, dense_rank() OVER (PARTITION BY campaign ORDER BY session DESC) AS p FROM e) WHERE p <= 3 AND importance >= 3")
def recap(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("campaign"), F.to_date("ts").alias("session"), (F.col("event_id") % 6).alias("importance"))
    return domain.recap(e, 3).select("event_id")


@R.add("SELECT user_id AS character, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-20') AS INT) AS days FROM events GROUP BY user_id HAVING user_id % 3 > 0 AND date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-20') > 14")
def dormant(spark, sf):
    seen = table(spark, sf, "events").groupBy(F.col("user_id").alias("character")).agg(F.max("ts").alias("last_seen")).withColumn("alive", F.col("character") % 3 > 0)
    return domain.dormant(seen, F.lit("2024-02-20").cast("date"))


@R.add("""WITH s AS (SELECT user_id % 10 AS campaign, user_id AS character, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-12') AS days FROM events GROUP BY user_id),
d AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY days DESC, 'c' || character) AS p FROM s WHERE character % 7 = 0 AND days > 14)
SELECT r.c AS campaign, CASE WHEN d.campaign IS NULL THEN 'paused' ELSE 'dormant' END AS kind, CASE WHEN d.campaign IS NULL THEN 'thread ' || r.c ELSE 'c' || character END AS subject, CASE WHEN d.campaign IS NULL THEN 'hook | a, b, c' ELSE CAST(days AS VARCHAR) END AS detail
FROM range(10) r(c) LEFT JOIN d ON d.campaign = r.c AND p = 1 WHERE r.c % 3 > 0 OR d.campaign IS NOT NULL""")
def callbacks(spark, sf):
    """Users as characters of ten campaigns, one in seven alive; event sessions of each campaign that is no multiple of three have a paused thread."""
    e = table(spark, sf, "events").withColumn("campaign", F.col("user_id") % 10)
    seen = e.groupBy("campaign", "user_id").agg(F.max("ts").alias("last_seen")).select("campaign", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("character"), "last_seen", (F.col("user_id") % 7 == 0).alias("alive"))
    status = F.when(F.col("campaign") % 3 > 0, "pausado").otherwise("ativo")
    threads = e.select("campaign").distinct().select("campaign", F.concat(F.lit("thread "), F.col("campaign").cast("string")).alias("title"), status.alias("status"), F.lit("hook").alias("hook"), F.array(*map(F.lit, "abcd")).alias("involved"))
    return domain.callbacks(seen, threads, F.lit("2024-02-12").cast("date"))


@R.add("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def session_counts(spark, sf):
    return domain.session_counts(table(spark, sf, "events").withColumn("session", F.to_date("ts").cast("string")))


@R.add(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'tion') THEN 'a' WHEN regexp_matches(lower(text), 'ment') THEN 'b' ELSE 'geral' END AS kind, CAST(NULL AS INT) AS level FROM conversations WHERE role = 'user'""")
def classified_queries(spark, sf):
    q = table(spark, sf, "conversations").where("role = 'user'").withColumn("query", F.col("text"))
    return domain.classify_queries(q, [("a", "tion"), ("b", "ment")]).select("conv_id", "turn", "kind", "level")


@R.add("SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_size']) AS field, unnest([p_name, p_brand, CAST(p_size AS VARCHAR)]) AS value FROM part")
def card_rows(spark, sf):
    return domain.card_rows(table(spark, sf, "part"), "p_partkey", ["p_name", "p_brand", "p_size"])


@R.add("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND contains(lower(p_name || ' ' || p_type), 'ring') AND contains(lower(p_name || ' ' || p_type), 'economy')")
def browsed_items(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("book"), F.lit("x").alias("kind"), F.col("p_type").alias("text"))
    return domain.browse(rows, book="Brand#2", text="Rings economy").select("p_partkey")


@R.add("SELECT slug, p_brand AS book FROM (SELECT replace(p_name, ' ', '-') AS slug, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY p_brand = 'Brand#7' DESC, p_brand) AS o FROM part) WHERE o = 1")
def slug_lookup(spark, sf):
    rows = table(spark, sf, "part").select(F.initcap("p_name").alias("name"), F.col("p_brand").alias("book"))
    slugs = rows.select(F.replace(F.lower("name"), F.lit(" "), F.lit("-")).alias("slug")).distinct()
    return domain.by_slug(rows, slugs, "Brand#7").select("slug", "book")


@R.add("SELECT p_partkey, -(p_size % 4) AS cost, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END AS spell_cost, CASE WHEN p_size % 3 = 0 THEN 3 * (p_size % 5) ELSE CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END END AS potency FROM part")
def parsed_costs(spark, sf):
    s = F.col("p_size")
    spell = parse.spell_cost(F.when(s % 2 == 0, F.concat(s.cast("string"), F.lit(" PMs"))).otherwise("none"))
    effect = F.when(s % 3 == 0, F.concat((s % 5).cast("string"), F.lit("d de dano"))).otherwise("x")
    return table(spark, sf, "part").select("p_partkey", parse.cost(F.concat(F.lit("–"), (s % 4).cast("string"), F.lit(" pontos"))).alias("cost"), spell.alias("spell_cost"), parse.spell_potency(effect, spell).alias("potency"))


@R.add("SELECT p_partkey, 1 + p_size % 3 + 2 AS least, (1 + p_size % 3) * 3.5 + 2 AS mean, (1 + p_size % 3) * 6 + 2 AS greatest, round(pow(1 / 6.0, 1 + p_size % 3), 6) AS extreme FROM part".replace("AS mean", "AS mean"))
def dice_stats(spark, sf):
    d = parse.dice_stats(F.concat((1 + F.col("p_size") % 3).cast("string"), F.lit("d6+2")))
    return table(spark, sf, "part").select("p_partkey", d.alias("d")).select("p_partkey", "d.least", "d.mean", "d.greatest", F.round("d.extreme", 6).alias("extreme"))


@R.add("SELECT p_partkey FROM part WHERE length(p_type || ' ' || p_brand) > 10 AND contains(p_name, 'ring') ORDER BY p_name, p_partkey LIMIT 50")
def catalog_view(spark, sf):
    """The first 50 of a catalogue search: the limit is the feature."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.lit("x").alias("kind"), F.lit(True).alias("unique"), F.lit("-").alias("school"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    return domain.catalog_view(rows, search="Ring").select(F.col("row_id").alias("p_partkey"))


@R.add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def kind_distribution(spark, sf):
    return domain.kind_distribution(table(spark, sf, "events"), "event_type")


# training sets: embeddings' labels are the clusters


def _described(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("name"), F.concat(F.lit("text of "), F.col("vec_id").cast("string")).alias("description"), F.col("label").alias("cluster_id"), F.when(F.col("label") % 2 == 0, "magia").otherwise("monstro").alias("type"), F.concat(F.lit("element "), F.when(F.col("vec_id") % 3 == 0, "fogo").otherwise("gelo")).alias("text"))


def _eligible(triples, described):
    """Triples checked: how many, and how many whose negative is of the anchor's own cluster."""
    a = described.select(F.col("name").alias("anchor"), F.col("cluster_id").alias("ca"))
    b = described.select(F.col("description").alias("negative"), F.col("cluster_id").alias("cb"))
    return triples.join(a, "anchor").join(b, "negative").groupBy("strategy").agg(F.count("*").alias("n"), F.count_if(F.col("ca") == F.col("cb")).alias("wrong"))


@R.add("SELECT 'graph' AS strategy, count(*) AS n, 0 AS wrong FROM embeddings")
def graph_triples(spark, sf):
    d = _described(spark, sf)
    return _eligible(trainset.graph_triples(d, 1 << 30), d)


@R.add("SELECT 'graph' AS strategy, count(*) AS n, 0 AS wrong, 0 AS own FROM embeddings")
def disjoint_triples(spark, sf):
    """Entities in three clusters each: negatives outside all of them; ``wrong`` counts those that share one."""
    d = _described(spark, sf).select("name", "description", "cluster_id")
    members = d.select("name", F.explode(F.array(F.col("cluster_id"), 100 + F.length("name"), 200 + F.pmod(F.xxhash64("name"), F.lit(5)).cast("int"))).alias("cluster_id"))
    triples = trainset.graph_triples(d, 1 << 30, members=members)
    theirs = triples.select("anchor", "negative").join(d.select(F.col("description").alias("negative"), F.col("name").alias("other")), "negative")
    shared = theirs.join(members.withColumnRenamed("name", "anchor"), "anchor").join(members.withColumnRenamed("name", "other"), ["other", "cluster_id"]).select("anchor").distinct()
    able = d.select("name").join(shared.withColumnRenamed("anchor", "name"), "name", "left_semi")  # none of those that overlap has a free one
    return triples.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if(F.col("positive") == F.col("negative")).cast("int").alias("own")).crossJoin(F.broadcast(able.agg(F.count("*").cast("int").alias("wrong")))).select("strategy", "n", "wrong", "own")


@R.add("SELECT 'similarity' AS strategy, CAST(sum(n) AS BIGINT) AS n, 0 AS wrong FROM (SELECT count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 1)")
def similarity_triples(spark, sf):
    d = _described(spark, sf)
    return _eligible(trainset.similarity_triples(d, 1 << 30), d)


@R.add("SELECT 'hard' AS strategy, count(*) FILTER (label % 2 = 0) AS n, 0 AS wrong FROM embeddings")
def hard_triples(spark, sf):
    d = _described(spark, sf)
    return _eligible(trainset.hard_triples(d, "magia", "monstro", 1 << 30), d)


@R.add("SELECT 'e' || vec_id AS anchor, CASE WHEN label % 2 = 0 THEN 'magia' ELSE 'monstro' END AS positive, CASE WHEN label % 2 = 0 THEN 'monstro' ELSE 'magia' END AS negative FROM embeddings ORDER BY md5('e' || vec_id || '|42'), 1 LIMIT 100")
def relation_triples(spark, sf):
    """100 seeded triples: the number is the operator's parameter."""
    return trainset.relation_triples(_described(spark, sf), {"magia": "monstro", "monstro": "magia"}, 100).select("anchor", "positive", "negative")


@R.add("SELECT 'relation' AS strategy, 40 AS n UNION ALL SELECT 'graph', 20")
def mixed_triples(spark, sf):
    """A mix of 100 triples at 40 and 20 percent: the numbers are the operator's parameters."""
    d = _described(spark, sf)
    rel = trainset.relation_triples(d, {"magia": "monstro", "monstro": "magia"}, 100)
    return trainset.strategy_counts(trainset.mix([(rel, 0.4), (trainset.graph_triples(d, 100), 0.2)], 100))


@R.add("SELECT 'relation' AS strategy, count(*) FILTER (vec_id % 2 = 0) AS kept, count(*) FILTER (vec_id % 2 = 1) AS dropped FROM embeddings")
def validated_anchors(spark, sf):
    d = _described(spark, sf)
    triples = trainset.relation_triples(d, {"magia": "monstro", "monstro": "magia"}, 1 << 30)
    known = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("name"))
    return trainset.validate_anchors(triples, known)


@R.add("SELECT vec_id, CASE WHEN CAST('0x' || md5(CAST(vec_id AS VARCHAR) || '|42')[1:8] AS BIGINT) / 4294967296.0 < 0.85 THEN 'train' ELSE 'val' END AS part FROM embeddings")
def train_val_split(spark, sf):
    return trainset.split(table(spark, sf, "embeddings"), "vec_id").select("vec_id", "part")


@R.add("SELECT 'e' || vec_id AS name, CASE WHEN vec_id % 3 = 0 THEN 'fogo' ELSE 'agua' END AS element FROM embeddings")
def inferred_attributes(spark, sf):
    return trainset.infer_attributes(_described(spark, sf), kind="type").select("name", "element")


@R.add("SELECT DISTINCT p_name, CASE WHEN length(string_split(p_name, ' ')[1]) > length(string_split(p_name, ' ')[2]) OR (length(string_split(p_name, ' ')[1]) = length(string_split(p_name, ' ')[2]) AND string_split(p_name, ' ')[1] > string_split(p_name, ' ')[2]) THEN string_split(p_name, ' ')[1] ELSE string_split(p_name, ' ')[2] END AS bucket FROM part")
def name_buckets(spark, sf):
    return trainset.name_buckets(table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()).select(F.col("name").alias("p_name"), "bucket")


@R.add("WITH n AS (SELECT DISTINCT p_name AS a, string_split(p_name, ' ') AS w FROM part) SELECT x.a, y.a AS b FROM n x JOIN n y ON x.a < y.a AND len(list_intersect(x.w, y.w)) >= 1")
def synonym_pairs(spark, sf):
    return trainset.synonym_pairs(table(spark, sf, "part").select(F.col("p_name").alias("name")))


#: Every name has one triple, for each element holds both types.
@R.add("SELECT 'element' AS strategy, count(*) AS n FROM embeddings")
def attribute_triples(spark, sf):
    d = trainset.infer_attributes(_described(spark, sf), kind="type")
    return trainset.attribute_triples(d, "element", "type", 1 << 30, "element").groupBy("strategy").agg(F.count("*").alias("n"))


@R.add("SELECT s AS strategy, n FROM (VALUES ('element', 50), ('synonym', 20), ('graph', 130)) v(s, n)")
def second_triples(spark, sf):
    """200 triples of the second set, topped up with those of the first: numbers and shares are the operator's parameters."""
    d = _described(spark, sf).withColumn("name", F.concat_ws(" ", F.lit("e"), F.substring("name", 2, 9)))
    return trainset.strategy_counts(trainset.second_triples(d, 200, trainset.graph_triples(d, 1 << 30)))


PAIRS = """SELECT doc_id AS query, 'w' || doc_id % 30 || CASE WHEN quality = 1 THEN ' q' || doc_id % 10 || ' ' ELSE '' END AS text, doc_id % 25 AS rank, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS query_type, 'a' AS doc_type, 'q' || doc_id % 10 AS k, quality FROM labels"""
LABELLED = f"""SELECT query, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS label, CASE WHEN quality = 1 THEN 'facil' WHEN query_type <> doc_type AND rank < 5 THEN 'dificil' WHEN rank >= 15 THEN 'facil' WHEN query_type <> doc_type THEN 'medio' END AS difficulty FROM ({PAIRS}) WHERE quality = 1 OR rank >= 15 OR query_type <> doc_type"""


def _labelled(spark, sf):
    k = F.col("doc_id")
    text = F.concat(F.lit("w"), (k % 30).cast("string"), F.when(F.col("quality") == 1, F.concat(F.lit(" q"), (k % 10).cast("string"), F.lit(" "))).otherwise(""))
    rows = table(spark, sf, "labels").select(F.concat(F.lit("q"), (k % 10).cast("string")).alias("query"), text.alias("text"), (k % 25).alias("rank"), F.when(k % 2 == 0, "a").otherwise("b").alias("query_type"), F.lit("a").alias("doc_type"), "doc_id")
    return trainset.label_pairs(rows)


@R.add(LABELLED)
def labelled_pairs(spark, sf):
    return _labelled(spark, sf).select(F.col("doc_id").alias("query"), "label", "difficulty")


@R.add(f"WITH l AS ({LABELLED}) SELECT CASE WHEN grouping(label) = 0 THEN label END AS label, CASE WHEN grouping(difficulty) = 0 THEN difficulty END AS difficulty, count(*) AS n FROM l GROUP BY GROUPING SETS ((label, difficulty), (label), ())")
def pair_stats(spark, sf):
    return trainset.pair_stats(_labelled(spark, sf))


@R.add(f"WITH l AS ({LABELLED}) SELECT label, least(count(*), 500) AS n FROM l GROUP BY label")
def balanced_pairs(spark, sf):
    """At most 500 pairs of each label: the operator's parameter."""
    return trainset.balance_pairs(_labelled(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@R.add(f"WITH p AS (SELECT count(*) AS n FROM ({LABELLED}) WHERE label = 1) SELECT unnest([0, 1]) AS label, n FROM p")
def topped_up_pairs(spark, sf):
    """Few negatives are topped up, from candidates without a label, to as many as positives."""
    rows = _labelled(spark, sf)
    few = rows.where("label = 1").unionByName(rows.where("label = 0").orderBy("doc_id").limit(1))
    spare = table(spark, sf, "documents").select(F.col("source").alias("query"), F.col("doc_id").cast("string").alias("text"))
    return trainset.balance_pairs(few, 1 << 30, spare=spare).groupBy("label").agg(F.count("*").alias("n"))


# streams: the same operators on the whole table; tests/test_streams.py runs them as streams


@R.add("SELECT date_trunc('hour', ts) AS start, user_id, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return logs.event_windows(table(spark, sf, "events")).withColumn("value", F.round("value", 4))


@R.add("""WITH e AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
SELECT min(ts) AS start, user_id, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, g""")
def event_sessions(spark, sf):
    return logs.event_sessions(table(spark, sf, "events")).select("start", "user_id", "events", F.round("value", 4).alias("value"))


@R.add("SELECT user_id, max(ts) AS last_seen, count(*) AS events FROM events GROUP BY 1")
def last_seen(spark, sf):
    return logs.last_seen(table(spark, sf, "events"))


@R.add("""WITH e AS (SELECT DISTINCT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events)
SELECT user_id, ts AS last_seen, ts + INTERVAL 12 HOUR AS dormant_at FROM e WHERE (next IS NULL OR next > ts + INTERVAL 12 HOUR) AND ts + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def dormancies(spark, sf):
    found = logs.dormancies(table(spark, sf, "events"), "12 hours")
    return found.select("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), F.col("dormant_at").cast("timestamp_ntz").alias("dormant_at"))


@R.add("SELECT event_type AS query, round(avg(user_id % 3 - 1), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def feedback_means(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("query"), (F.col("user_id") % 3 - 1).alias("rating"))
    return logs.feedback_means(e).select("query", F.round("mean", 6).alias("mean"), "n")
