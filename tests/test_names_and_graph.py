"""Name joins, passes in order, expansion and neighbourhoods by brute force on random rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tomeforge.operators import catalog, common, entities, evaluation, graph, tables, trainset


def random_names(seed, n, parts=("a", "ab", "ba", "b", "supplier", "red", "dragon's")):
    rnd = random.Random(seed)
    return sorted({" ".join(rnd.choices(parts, k=rnd.randrange(1, 5))) for _ in range(n)})


def held(s, l):
    """Whether s stands in l with a word that is whole there."""
    spans = [m.span() for m in re.finditer(r"\w+", s)]
    joined = lambda k: 0 <= k < len(l) and bool(re.match(r"\w", l[k]))
    for m in re.finditer(f"(?={re.escape(s)})", l) if s else ():
        if any(not joined(m.start() + a - 1) and not joined(m.start() + b) for a, b in spans):
            return True
    return False


def of(spark, values, column):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


@pytest.mark.parametrize("seed", range(3))
def test_held_names_by_brute_force(spark, seed):
    short, long = random_names(seed, 60), random_names(seed + 10, 120)
    found = common.held_names(of(spark, short + ["", "!"], "s"), "s", of(spark, long, "l"), "l").collect()
    assert sorted((r.s, r.l) for r in found) == sorted((s, l) for s in short for l in long if held(s, l))


def test_common_words_bring_no_names_together(spark):
    """The join on keys makes no more rows than names where all share one word."""
    names = of(spark, [f"supplier#{k:06d}" for k in range(3000)], "name")
    plan = common.held_names(names, "name", names.withColumnRenamed("name", "other"), "other")
    assert plan.count() == 3000
    keys = names.select(F.explode(common.name_keys(F.col("name"))).alias("key")).groupBy("key").count()
    asked = names.select(F.regexp_replace("name", "#", " ").alias("key")).join(keys, "key")
    assert asked.agg(F.sum("count")).first()[0] == 3000


def test_match_entity_by_brute_force(spark):
    named = random_names(1, 40) + ["Dragon", "RED dragon"]
    asked = random_names(2, 60) + ["dragon", "nothing here", "Ab", "b!"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = {r.query_id: r.entity for r in graph.match_entity(queries, of(spark, named, "name")).collect()}
    want = {}
    for k, q in enumerate(asked):
        q = q.lower()
        able = [e for e in named if held(q, e.lower()) or held(e.lower(), q)]
        if able:
            want[k] = min(able, key=lambda e: (e.lower() != q, -len(e), e))
    assert found == want


@pytest.mark.parametrize("seed", range(3))
def test_passes_in_order(spark, seed):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(70)} | {(k, k + 1) for k in range(60, 75)}
    kept, gone = set(), set()
    for k in range(76):
        (gone if any((x, k) in pairs for x in kept) else kept).add(k)
    found = common.dropped_in_turn(spark.createDataFrame(sorted(pairs), "early int, late int"))
    assert sorted(r.late for r in found.collect()) == sorted(gone)
    assert common.dropped_in_turn(spark.createDataFrame([], "early int, late int")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_cascade_merge_equals_a_loop(spark, seed):
    first, second, third = (random_names(seed * 3 + k, 25) for k in range(3))
    frames = [of(spark, rows + rows[:3], "name") for rows in (first, [*second, "Ab-Ba ab"], third)]
    plain = lambda n: re.sub("[- ]+", " ", n.strip().lower())
    kept = {plain(n): n for n in first}
    for rows in (sorted([*second, "Ab-Ba ab"]), third):
        for n in rows:
            k = plain(n)
            if not any(k == x or held(k, x) or held(x, k) for x in kept):
                kept[k] = n
    assert sorted(r.name for r in catalog.cascade_merge(frames).collect()) == sorted(kept.values())


@pytest.mark.parametrize("seed", range(2))
def test_merged_clusters_equal_a_loop(spark, seed):
    rnd = random.Random(seed)
    clusters = {k: set(rnd.sample(range(12), rnd.randrange(1, 7))) for k in range(25)}
    into, used = {}, set()
    for a in clusters:
        if a in used:
            continue
        into[a] = a
        for b in clusters:
            if b != a and b not in used and len(clusters[a] & clusters[b]) / min(len(clusters[a]), len(clusters[b])) >= 0.7:
                if b > a:
                    into[b] = a
                    used.add(b)
        used.add(a)
    members = spark.createDataFrame([(k, e) for k, some in clusters.items() for e in some], "cluster_id int, entity int")
    assert {r.cluster_id: r.merged for r in entities.merge_clusters(members).collect()} == into


EDGES = [
    ("Dragon", "is_a", "Monster"), ("Dragon", "element", "Fire of Old"), ("Dragon", "cost_pm", "5"), ("Dragon", "cost_pm", "1 to 5"), ("Dragon", "effect", "burns all"),
    ("Dragon", "effect", "12"), ("Dragon", "effect", "de fogo"), ("Dragon", "hates", "Elves of Wood"), ("Dragon", "school", "x"), ("Ghost", "cost_pm", "3"), ("Ghost", "effect", "o de"),
]


def test_expansion_rules(spark):
    """Tiers in order, unfit terms and bare numbers out, mates of coherent clusters alone, the query where nothing is fit."""
    edges = spark.createDataFrame(EDGES, "src string, relation string, dst string")
    names = of(spark, ["Dragon", "Ghost", "Monster", "Orc", "Elf", "Big Orc", "Imp"], "name")
    queries = spark.createDataFrame([(1, "dragon"), (2, "Ghost"), (3, "unknown"), (4, "the dragon")], "query_id long, query string")
    members = spark.createDataFrame([(7, "Dragon", "fire_beasts"), (7, "Orc", "fire_beasts"), (7, "Elf", "fire_beasts"), (7, "9", "fire_beasts"), (8, "Ghost", "de_nao"), (8, "Elf", "de_nao")], "cluster_id int, entity string, label string")
    fit = {"stop_words": ["de", "nao", "o"], "prefixes": ["de"]}
    rows = graph.expand_with_graph(queries, edges, names, members, limit=20, **fit).collect()
    found = {k: sorted((r.term, r.weight) for r in rows if r.query_id == k) for k in (1, 2, 3, 4)}
    rest = [("1 to 5 PM", 0.8), ("Elf", 0.7), ("Fire of Old", 0.8), ("Monster", 0.9), ("Orc", 0.7), ("burns all", 0.8)]
    assert found == {1: sorted([*rest, ("dragon", 1.0)]), 2: [("Ghost", 1.0)], 3: [("unknown", 1.0)], 4: sorted([*rest, ("the dragon", 1.0)])}
    few = graph.expand_with_graph(queries, edges, names, members, limit=3, **fit).where("query_id = 1").collect()
    assert sorted((r.term, r.weight) for r in few) == [("Elf", 0.7), ("Monster", 0.9), ("dragon", 1.0)]


def test_mates_are_cut_before_they_meet_queries(spark):
    members = spark.range(0, 200_000, 1, 8).select((F.col("id") % 10).alias("cluster_id"), F.concat(F.lit("member "), F.col("id").cast("string")).alias("entity"))
    mates = graph.mates_of(members, spark.range(10).withColumnRenamed("id", "cluster_id"), 5)
    assert mates.groupBy("cluster_id").count().agg(F.max("count")).first()[0] == 6
    assert "WindowGroupLimit" in mates._jdf.queryExecution().toString()
    queries = spark.range(0, 200_000, 20_000).select(F.col("id").alias("query_id"), F.concat(F.lit("member "), F.col("id").cast("string")).alias("query"))
    out = graph.enrich_queries(queries, spark.createDataFrame([], "src string, relation string, dst string"), spark.createDataFrame([], "name string, key string, value string"), members, queries.select(F.col("query").alias("name")))
    assert [len(r.mates) for r in out.collect()] == [5] * 10


def test_neighbourhood_of_many_hops(spark):
    """Ten hops and more over a path with a hub; the plan does not grow with the hops."""
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(15)] + [("n3", f"leaf{k}") for k in range(50)] + [("n0", None)], "src string, dst string")
    seeds = of(spark, ["n0", "lonely"], "node")
    found = {(r.seed, r.node): r.hop for r in graph.neighbourhood(seeds, edges, 10).collect()}
    assert found == {("lonely", "lonely"): 0} | {("n0", f"n{k}"): k for k in range(11)} | {("n0", f"leaf{k}"): 4 for k in range(50)}
    plans = [len(graph.neighbourhood(seeds, edges, hops)._jdf.queryExecution().toString()) for hops in (2, 12)]
    assert plans[1] < 1.2 * plans[0]


def test_lookups_by_part_of_a_name(spark):
    rows = spark.createDataFrame([(1, "Red Dragon"), (2, "dragon"), (3, "Old Red Dragon of the Sea"), (4, "Drag")], "id int, nome string")
    found = tables.find_by_name(rows, of(spark, ["red dragon", "the dragon", "sea"], "query")).collect()
    assert sorted((r.query, r.id, r.exact) for r in found) == [("red dragon", 1, True), ("sea", 3, False), ("the dragon", 2, False)]
    covered = evaluation.fuzzy_coverage(of(spark, ["Red Dragon", "dragon of the", "Elf"], "name"), rows.select(F.col("nome").alias("name")), {}, [])
    assert sorted((r.name, r.found, r.status) for r in covered.collect()) == [("Elf", None, "missing"), ("Red Dragon", "Red Dragon", "covered"), ("dragon of the", "Old Red Dragon of the Sea", "partial")]


def test_synonym_mates(spark, monkeypatch):
    """Every name with later partners has one of them, in sets of one ring or many, and for names of many words."""
    import random

    rng = random.Random(5)
    names = sorted({" ".join(rng.sample("abcdefghijklmno", rng.choice([1, 2, 2, 3, 4, 5, 6, 7, 8]))) for _ in range(300)} | {"", "-"})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = {(r.a, r.b) for r in trainset.synonym_pairs(df).collect()}
    sets = {n: set(n.split()) for n in names if n not in ("", "-")}
    assert pairs == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * min(len(sets[a]), len(sets[b]))}
    for ring in (1000, 7):
        monkeypatch.setattr(trainset, "RING", ring)
        mates = [(r.a, r.b) for r in trainset.synonym_mates(df).collect()]
        assert set(mates) <= pairs and sorted(a for a, _ in mates) == sorted({a for a, _ in pairs})


def test_synonym_mates_make_no_pairs(spark):
    """20,000 names with one word in common make 200 million pairs; each name gets its partner all the same."""
    df = spark.range(20_000).selectExpr("concat('e ', id) AS name")
    assert trainset.synonym_mates(df).count() == 19_999


def _random_texts(seed, n):
    rnd = random.Random(seed)
    words = ["red", "Red", "sacred", "fox", "box-fox", "fo", "ação", "AÇÃO", "b_1", "b", "1", "red fox", "fox.", "'fox", "--", "ΟΔΟΣ", "日本"]
    return [rnd.choice([" ", ", ", "\n", "-"]).join(rnd.choices(words, k=rnd.randrange(0, 9))) for _ in range(n)]


def _holds(text, name):
    """The rule of contains_join in plain Python; the longest word, the last one by order of those."""
    words = re.findall(r"[^\W]+", name.lower())
    return bool(words) and max(words, key=lambda w: (len(w), w)) in re.findall(r"[^\W]+", text.lower()) and name.lower() in text.lower()


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_contains_join_by_brute_force(spark, monkeypatch, limit):
    """Both ways give the same pairs; names that can be broadcast meet the texts without a shuffle, and rows that share an id are told apart."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    names = ["red", "fox", "Fox.", "red fox", "FOX, red", "ação", "b_1", "1", "", "--", "日本", "box-fox", "fo"]
    texts = _random_texts(1, 300)
    # beyond the broadcast, texts come back by id, which must be unique
    docs = spark.createDataFrame([(i // 2 if limit else i, t) for i, t in enumerate([*texts, None])], "doc_id int, text string")
    found = common.contains_join(spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name")), docs, "name", "text", "doc_id")
    assert sorted((r["name"], r.doc_id, r.text) for r in found.collect()) == sorted((n, i // 2 if limit else i, t) for i, t in enumerate(texts) for n in names if _holds(t, n))
    assert ("hashpartitioning" in found._jdf.queryExecution().executedPlan().toString()) == (not limit)


def test_ground_truth_by_brute_force(spark):
    texts = _random_texts(2, 200)
    asked = [(1, ["red", "fox"], True), (2, ["red", "red"], True), (3, ["red", "fox."], False), (4, ["Red", "b", "1"], True), (5, [], False), (6, ["red"], True), (6, ["fox"], True), (6, ["b"], False), (7, None, True)]
    got = evaluation.ground_truth(spark.createDataFrame(asked, "query_id int, targets array<string>, comparison boolean"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    held = {}
    for q, targets, comparison in asked:
        for t in targets or []:
            for i, text in enumerate(texts):
                if _holds(text, t):
                    held.setdefault((q, i, comparison), set()).add(t)
    want = sorted((q, i) for (q, i, comparison), found in held.items() if len(found) >= 1 + comparison)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == want and len(want) > 100
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(query_id") <= 2  # of the targets, and of the hits once


def test_names_that_stand_in_texts_are_located_in_one_pass(spark):
    """The result reads the table of places alone; texts are read anew for names that stand in none."""
    docs = spark.createDataFrame(list(enumerate(["a fenix", "Fenix", "FÊNIX", "hidra da lernia", "x"])), "doc_id int, text string")
    found = catalog.locate_names(spark.createDataFrame([("Fenix",), ("fênix",)], "name string"), docs)
    assert {r["name"]: (r.doc_id, r.method) for r in found.collect()} == {"Fenix": (1, "exact"), "fênix": (2, "case")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "LogicalRDD" not in plan
    found = catalog.locate_names(spark.createDataFrame([("Fenix",), ("Hidra da Lerna",), ("Kraken",)], "name string"), docs)
    assert {r["name"]: (r.doc_id, r.method) for r in found.collect()} == {"Fenix": (1, "exact"), "Hidra da Lerna": (3, "fuzzy")}
