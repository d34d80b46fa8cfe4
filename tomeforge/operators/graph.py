"""Knowledge lookup and query expansion over edges (src, relation, dst), entities and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rules import QUESTION_PREFIXES, STOP_WORDS, SYNONYMS
from ..functions.text import key_phrase, strip, tokens
from ..sources.io import work_dir, written
from .common import contains_join, first_by, held_names

FRAGMENT_PREFIXES = ["e", "de", "ou", "que", "com", "para"]


def relations_for(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, src, relation, dst): edges whose source equals the query's name or holds it as words, whatever the case."""
    asked = queries.select("query_id", "name")
    equal = asked.join(edges, F.upper("name") == F.upper("src")).select("query_id", "src", "relation", "dst")
    holding = contains_join(asked, edges, "name", "src").select("query_id", "src", "relation", "dst")
    return equal.unionByName(holding).distinct()


def match_entity(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity): the entity equal to, in, or holding the query, of which one holds the other with a whole word; equal first, then the longest, then the first by alphabet.

    Of the entities that hold a query of one word, only the best of each word takes part.
    """
    asked = queries.select("query_id", F.lower("query").alias("q"))
    texts = asked.select("q").distinct()
    named = entities.select(F.col("name").alias("entity"), F.lower("name").alias("e")).distinct()
    names = named.select("e").distinct()
    one_word = tokens(F.col("q")) == F.array("q")
    inside = held_names(names, "e", texts, "q")
    around = held_names(texts.where(~one_word), "q", names, "e")
    best = first_by(names.select("e", F.explode(F.array_distinct(tokens(F.col("e")))).alias("q")), ["q"], F.desc(F.length("e")), F.col("e"))
    alone = texts.where(one_word).join(best, "q")
    pairs = inside.select("q", "e").unionByName(around.select("q", "e")).unionByName(alone.select("q", "e")).join(named, "e")
    found = first_by(pairs, ["q"], F.desc(F.col("q") == F.col("e")), F.desc(F.length("entity")), F.col("entity"))
    return asked.join(found, "q").select("query_id", "entity")


def cluster_of(entities: DataFrame, members: DataFrame) -> DataFrame:
    return entities.join(members, F.lower(entities["name"]) == F.lower(members["entity"])).select("name", "cluster_id")


def members_of(clusters: DataFrame, members: DataFrame) -> DataFrame:
    return clusters.join(members, "cluster_id").select("cluster_id", "entity")


def valid_terms(terms: DataFrame, entities: DataFrame, prefixes: list[str] = FRAGMENT_PREFIXES, stop_words: list[str] = STOP_WORDS, generic: list[str] = (), share: float = 0.3, legacy_prefix: bool = False) -> DataFrame:
    """Terms (term) fit to expand a query.

    Single characters, fragments (a first word from ``prefixes``; with ``legacy_prefix``
    any text that starts so), digits, stop words alone and generic words go; what stays
    has two words or is an entity, and occurs as a word in at most ``share`` of the
    entity names.
    """
    words = tokens(F.col("term"))
    lowered = F.lower(F.trim("term"))
    fragment = reduce(lambda a, p: a | lowered.startswith(p if legacy_prefix else f"{p} "), prefixes, F.lit(False))
    idle = (F.length(lowered) < 2) | fragment | lowered.rlike(r"^\d+$") | (F.size(F.filter(words, lambda w: ~w.isin(*stop_words))) == 0) | lowered.isin(*(generic or [""]))
    kept = terms.where(~idle).withColumn("key", lowered)
    names = entities.select(F.lower("name").alias("key")).distinct()
    known = kept.join(names.withColumn("known", F.lit(True)), "key", "left")
    kept = known.where((F.size(words) >= 2) | F.col("known"))
    n = names.agg(F.count("*").alias("n"))
    df = names.select(F.explode(F.array_distinct(tokens(F.col("key")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    # a term of several words is no more frequent than its rarest word
    rarest = kept.select("term", F.explode(words).alias("w")).join(df, "w", "left").groupBy("term").agg(F.min(F.coalesce("df", F.lit(0))).alias("df"))
    return kept.select("term").distinct().join(rarest, "term").crossJoin(F.broadcast(n)).where(F.col("df") <= share * F.col("n")).select("term")


def mates_of(members: DataFrame, clusters: DataFrame, limit: int) -> DataFrame:
    """(cluster_id, entity): the first ``limit`` + 1 members of each of some clusters, by alphabet; the cut is made before any shuffle gathers a cluster."""
    return first_by(members.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_semi").select("cluster_id", "entity").distinct(), ["cluster_id"], F.col("entity"), n=limit + 1)


def coherent(members: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Members of clusters whose ``label``, if there is one, has four characters or more and a word that is no stop word."""
    if "label" not in members.columns:
        return members
    words = F.split(F.replace(F.lower("label"), F.lit("_"), F.lit(" ")), " ")
    return members.where((F.length("label") >= 4) & F.exists(words, lambda w: (w != "") & ~w.isin(*stop_words)))


def expand_with_graph(queries: DataFrame, edges: DataFrame, entities: DataFrame, members: DataFrame, limit: int = 5, **fit) -> DataFrame:
    """(query_id, term, weight): at most ``limit`` terms for each query, itself first at 1.0.

    For the query's entity there follow, in this order: targets of is_a, school and
    element that are entities (0.9); mates of its first cluster, if that is coherent
    (0.7); costs as "… PM" and effects (0.8); targets of is_a, school and element that
    are no entities (0.8); each by alphabet. Only terms that ``valid_terms`` passes
    (``fit``: its parameters) and that are new whatever the case count, and bare
    numbers are no costs. Candidates are cut to ``limit`` (mates to one more) for each
    entity or cluster before they meet the queries, which is as many as can be needed.
    """
    found = written(match_entity(queries, entities))
    asked = found.select(F.upper("entity").alias("key")).distinct()
    known = entities.select(F.lower("name").alias("low")).distinct().withColumn("known", F.lit(True))
    target = F.trim("dst")
    own = edges.withColumn("key", F.upper("src")).join(asked, "key", "left_semi").select("key", "relation", target.alias("dst"), F.lower(target).alias("low")).join(known, "low", "left")
    kind = F.col("relation").isin("is_a", "school", "element")
    cost = F.when(~F.col("dst").rlike(r"^\d+$"), F.concat("dst", F.lit(" PM")))
    term = F.when(F.col("relation") == "cost_pm", cost).when(kind | (F.col("relation") == "effect"), F.col("dst"))
    tier = F.when(kind & F.col("known"), 1).when(kind, 4).otherwise(3)
    own = written(own.select("key", term.alias("term"), tier.alias("tier")).where("term is not null").distinct())
    held = members.withColumn("key", F.upper("entity")).join(asked, "key", "left_semi")
    clusters = written(first_by(coherent(held, fit.get("stop_words", STOP_WORDS)).select("key", "cluster_id"), ["key"], F.col("cluster_id")))
    candidates = members.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_semi").select("cluster_id", F.col("entity").alias("term")).distinct()
    terms = written(own.select("term").unionByName(candidates.select("term")).distinct())
    fit_terms = written(valid_terms(terms, entities, **fit))
    own = first_by(own.join(fit_terms, "term", "left_semi"), ["key", "tier"], F.col("term"), n=limit)
    mates = mates_of(candidates.join(fit_terms, "term", "left_semi").withColumnRenamed("term", "entity"), clusters, limit).withColumnRenamed("entity", "term")
    mates = clusters.join(mates, "cluster_id").where("key <> upper(term)").select("key", "term", F.lit(2).alias("tier"))
    related = found.select("query_id", F.upper("entity").alias("key")).join(own.unionByName(mates), "key").select("query_id", "term", "tier")
    rows = queries.select("query_id", F.trim("query").alias("term"), F.lit(0).alias("tier")).unionByName(related)
    best = first_by(rows.withColumn("low", F.lower("term")), ["query_id", "low"], F.col("tier"), F.col("term"))
    weight = F.element_at(F.array(*map(F.lit, (1.0, 0.9, 0.7, 0.8, 0.8))), F.col("tier") + 1)
    return first_by(best, ["query_id"], F.col("tier"), F.col("term"), n=limit).select("query_id", "term", weight.alias("weight"))


def synonyms(queries: DataFrame, phrases: dict[str, list[str]] = SYNONYMS, limit: int = 2) -> DataFrame:
    """(query_id, place, phrase): phrases of dictionary terms in the query, in the dictionary's order."""
    listed = [F.when(F.contains(F.lower("query"), F.lit(term)), F.array(*map(F.lit, ps))).otherwise(F.array().cast("array<string>")) for term, ps in phrases.items()]
    found = F.slice(F.array_distinct(F.flatten(F.array(*listed))), 1, limit)
    return queries.select("query_id", F.posexplode(found).alias("place", "phrase"))


def query_variants(queries: DataFrame, phrases: dict[str, list[str]] = SYNONYMS, prefixes: list[str] = QUESTION_PREFIXES, limit: int = 3) -> DataFrame:
    """(query_id, variant_no, query): the question, its key phrase, phrases of its terms, then "regra de X" or "explicar X"; distinct whatever the case."""
    question, key = strip(F.col("query")), key_phrase(F.col("query"), prefixes)
    listed = [F.when(F.contains(F.lower("query"), F.lit(term)), F.array(*map(F.lit, ps))).otherwise(F.array().cast("array<string>")) for term, ps in phrases.items()]
    extra = F.when(F.length(key) < 30, F.concat(F.lit("regra de "), key)).otherwise(F.concat(F.lit("explicar "), F.substring(key, 1, 40)))
    raw = F.concat(F.array(question, F.when(F.length(key) >= 2, key)), F.slice(F.array_distinct(F.flatten(F.array(*listed))), 1, limit - 1), F.array(F.when(key != "", extra)))
    kept = F.filter(raw, lambda v: v.isNotNull() & (F.trim(v) != ""))
    unique = F.filter(kept, lambda v, i: F.array_position(F.transform(kept, lambda x: F.lower(F.trim(x))), F.lower(F.trim(v))) == i + 1)
    return queries.select("query_id", F.posexplode(F.slice(unique, 1, limit)).alias("variant_no", "query"))


def enrich_queries(queries: DataFrame, edges: DataFrame, properties: DataFrame, members: DataFrame, entities: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, entity, relations, properties, mates): at most ``limit`` of each for the matched entity."""
    found = written(match_entity(queries, entities))
    asked = found.select("entity").distinct()

    def some(rows: DataFrame, text: Column, name: str) -> DataFrame:
        """The first texts of each entity, before they meet the queries."""
        picked = first_by(rows.select("entity", text.alias("x")).distinct(), ["entity"], F.col("x"), n=limit)
        return picked.groupBy("entity").agg(F.sort_array(F.collect_list("x")).alias(name))

    related = some(asked.join(edges, F.upper("entity") == F.upper("src")), F.concat_ws(" ", "relation", "dst"), "relations")
    props = some(asked.join(properties, F.lower("entity") == F.lower("name")), F.concat_ws("=", "key", "value"), "properties")
    own = asked.join(members.withColumnRenamed("entity", "member"), F.lower("entity") == F.lower("member")).select("entity", "cluster_id")
    near = own.join(mates_of(members, own, limit).withColumnRenamed("entity", "mate"), "cluster_id").where("lower(mate) <> lower(entity)")
    mates = some(near, F.col("mate"), "mates")
    return found.join(related, "entity", "left").join(props, "entity", "left").join(mates, "entity", "left").select("query_id", "entity", "relations", "properties", "mates")


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): nodes within ``hops`` steps of each seed over undirected edges (src, dst), at the fewest steps.

    Each hop is written and joined from there, so that its plan holds the last frontier
    and the nodes reached so far as files; an empty frontier ends the search.
    """
    spark = seeds.sparkSession
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src is not null and dst is not null").distinct()
    path = work_dir(spark)
    start = seeds.select(F.col("node").alias("seed"), "node").distinct()
    schema = StructType(start.schema.fields).add("hop", "integer")
    start.write.parquet(f"{path}/hop=0")
    for hop in range(1, hops + 1):
        frontier = spark.read.schema(start.schema).parquet(f"{path}/hop={hop - 1}")
        if frontier.isEmpty():
            break
        reached = spark.read.schema(schema).parquet(path).select("seed", "node")
        step = frontier.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        step.join(reached, ["seed", "node"], "left_anti").write.parquet(f"{path}/hop={hop}")
    return spark.read.schema(schema).parquet(path)
