"""Training sets: every generator is a join that builds eligible pairs, then a seeded order that does not depend on partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import QUERY_TYPES, TEXT_TYPES
from ..functions.text import fold, tokens
from ..sources.io import written
from .common import draw, first_by, small

#: Places that an anchor tries in its bucket of the shuffled others.
TRIES = 20
#: Rows of one attribute value that stand in a ring.
RING = 1000


def describe(entities: DataFrame, properties: DataFrame, most: int = 500) -> DataFrame:
    """(name, description): name, type, contexts and the evidence of properties, cut to ``most`` characters."""
    evidence = properties.groupBy("name").agg(F.sort_array(F.collect_set("evidence")).alias("e"))
    rows = entities.join(evidence, "name", "left")
    return rows.select("name", F.substring(F.concat_ws(" ", "name", "type", F.array_join("contexts", " "), F.array_join("e", " ")), 1, most).alias("description"))


def _paired(anchors: DataFrame, others: DataFrame, n: int, strategy: str, weight: float, seed: int, unlike: str, disjoint: bool = False) -> DataFrame:
    """Each anchor (anchor, positive, <unlike>) with one of ``others`` (negative, <unlike>) that differs in ``unlike``.

    Anchors are dealt a place in the shuffled list of others; if that one is not eligible,
    the next ``TRIES`` places are tried, so that no anchor meets all others. Those left
    over get the first eligible of six rows, two of each of the three values that come
    first: whatever an anchor's own value and name, one of them is eligible if any is.
    With ``disjoint`` the values are arrays that must have nothing in common; what is
    left over then gets a row of the first array that differs, or any other row if all
    overlap. Digests take part in the tries, and texts come back by them.
    """
    total = others.count()
    if not total:
        return anchors.select("anchor", "positive", F.lit("").alias("negative"), F.lit(weight).alias("weight"), F.lit(strategy).alias("strategy")).limit(0)
    anchors, others = anchors.withColumn("pid", F.md5("positive")), others.withColumn("nid", F.md5("negative"))
    asked, given = anchors.select("anchor", "pid", unlike), others.select("nid", F.col(unlike).alias("other"))
    # places by a hash bucket and a rank inside it, so that no window holds all rows
    buckets = max(1, total // 1000)
    key = F.pmod(F.conv(F.substring("nid", 1, 7), 16, 10).cast("long"), F.lit(buckets))
    placed = given.withColumn("b", key).withColumn("p", F.row_number().over(Window.partitionBy("b").orderBy(draw("nid", seed=seed), "nid")) - 1)
    sizes = placed.groupBy("b").agg(F.count("*").alias("m"))
    drawn = F.conv(F.substring(draw("anchor", "pid", seed=seed), 1, 7), 16, 10).cast("long")
    tries = asked.withColumn("b", F.pmod(drawn, F.lit(buckets))).join(sizes, "b").select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("m"), F.lit(TRIES)) - 1)).alias("t"))
    tries = tries.withColumn("p", F.pmod(F.floor(drawn / buckets) + F.col("t"), F.col("m")).cast("int"))
    differs = ~F.arrays_overlap(F.col(unlike), F.col("other")) if disjoint else ~F.col(unlike).eqNullSafe(F.col("other"))
    own = F.col("nid") != F.md5("anchor")
    found = first_by(tries.join(placed, ["b", "p"]).where(differs & own), ["anchor", "pid"], F.col("t")).select("anchor", "pid", "nid")
    left = asked.join(found, ["anchor", "pid"], "left_anti").distinct()
    if disjoint:
        left = written(left)
        rest = found.limit(0) if left.isEmpty() else _disjoint_rest(left, given, unlike, seed)
    else:
        listed = given.distinct().withColumn("d", draw("nid", seed=seed))
        values = listed.groupBy("other").agg(F.min("d").alias("first")).orderBy("first", "other").limit(3)
        spare = first_by(listed.join(F.broadcast(values.withColumnRenamed("other", "v")), F.col("other").eqNullSafe(F.col("v"))), ["other"], F.col("d"), F.col("nid"), n=2)
        near = left.crossJoin(F.broadcast(spare.select("nid", "other", "d"))).where(differs & own)  # six rows
        rest = first_by(near, ["anchor", "pid"], F.col("d"), F.col("nid")).select("anchor", "pid", "nid")
    rows = found.unionByName(rest).join(anchors.select("anchor", "pid", "positive").dropDuplicates(["anchor", "pid"]), ["anchor", "pid"])
    rows = rows.join(others.select("nid", "negative").dropDuplicates(["nid"]), "nid")
    rows = rows.select("anchor", "positive", "negative", F.lit(weight).alias("weight"), F.lit(strategy).alias("strategy"))
    return rows.orderBy(draw("anchor", "positive", seed=seed), "anchor").limit(n)


def _disjoint_rest(left: DataFrame, given: DataFrame, unlike: str, seed: int) -> DataFrame:
    """(anchor, pid, nid): for anchors whose tries all failed a row whose array has nothing in common with theirs, else any other row.

    Distinct arrays are numbered; for each one asked for, those that share a value are
    joined by it, and the least number that is missing among them is free. So arrays
    meet only where they overlap, and rows not at all.
    """
    nids = given.groupBy("other").agg(F.min("nid").alias("a"), F.max("nid").alias("b"))
    listed = written(nids.withColumn("number", F.row_number().over(Window.orderBy(draw("a", seed=seed), "a")) - 1))  # of distinct arrays
    asked = left.select(unlike).distinct()
    shared = asked.select(unlike, F.explode(unlike).alias("v")).join(listed.select("number", F.explode("other").alias("v")), "v").select(unlike, "number").distinct()
    run = F.row_number().over(Window.partitionBy(unlike).orderBy("number")) - 1
    free = shared.withColumn("run", run).where("run = number").groupBy(unlike).agg((F.max("number") + 1).cast("int").alias("number"))
    free = asked.join(free, unlike, "left").select(unlike, F.coalesce("number", F.lit(0)).alias("number"))
    fit = left.join(free, unlike).join(listed, "number").select("anchor", "pid", F.when(F.col("a") != F.md5("anchor"), F.col("a")).otherwise(F.col("b")).alias("nid"))
    spare = given.agg(F.min("nid").alias("a"), F.max("nid").alias("b"))
    none = left.join(fit.select("anchor", "pid"), ["anchor", "pid"], "left_anti").crossJoin(F.broadcast(spare))  # one row
    other = F.when(~F.col("a").isin(F.col("pid"), F.md5("anchor")), F.col("a")).when(~F.col("b").isin(F.col("pid"), F.md5("anchor")), F.col("b"))
    return fit.unionByName(none.select("anchor", "pid", other.alias("nid")).where("nid is not null"))


def graph_triples(described: DataFrame, n: int, seed: int = 42, members: DataFrame | None = None) -> DataFrame:
    """Anchor, its own description, the description of an entity outside its cluster, or outside all its clusters.

    ``described`` has (name, description) and its ``cluster_id``, or else ``members``
    (name, cluster_id) has all clusters of each entity; where every entity shares one
    with the anchor, any other one serves.
    """
    if members is None:
        a = described.select(F.col("name").alias("anchor"), F.col("description").alias("positive"), "cluster_id")
        return _paired(a, described.select(F.col("description").alias("negative"), "cluster_id"), n, "graph", 1.0, seed, "cluster_id")
    sets = members.groupBy("name").agg(F.sort_array(F.collect_set("cluster_id")).alias("clusters"))  # of one entity
    kind = f"array<{dict(members.dtypes)['cluster_id']}>"
    rows = written(described.select("name", "description").join(sets, "name", "left").withColumn("clusters", F.coalesce("clusters", F.array().cast(kind))))
    return _paired(rows.select(F.col("name").alias("anchor"), F.col("description").alias("positive"), "clusters"), rows.select(F.col("description").alias("negative"), "clusters"), n, "graph", 1.0, seed, "clusters", disjoint=True)


def similarity_triples(described: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Anchor, a mate of its cluster, a description from another cluster.

    Mates are the next rows in shuffled closed rings of about ``RING`` rows, into which
    clusters are dealt; a row alone in its ring gets one of the cluster's first two.
    Clusters of one row have no mates.
    """
    rows = described.select("name", "description", "cluster_id", F.md5(F.concat_ws("\u0000", "name", "description")).alias("id")).dropDuplicates(["id", "cluster_id"])
    sizes = rows.groupBy("cluster_id").agg(F.ceil(F.count("*") / RING).cast("int").alias("rings"), F.min("id").alias("least"), F.max("id").alias("most"))
    dealt = rows.select("name", "id", "cluster_id").join(small(sizes), "cluster_id").withColumn("ring", F.pmod(F.xxhash64("id"), F.col("rings")))
    ring = Window.partitionBy("cluster_id", "ring").orderBy(draw("id", seed=seed), "id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("id").over(ring), F.first("id").over(whole))
    mate = F.when(after != F.col("id"), after).when(F.col("least") != F.col("id"), F.col("least")).when(F.col("most") != F.col("id"), F.col("most"))
    mates = dealt.select(F.col("name").alias("anchor"), "cluster_id", mate.alias("id")).where("id is not null")
    mates = mates.join(rows.select("id", F.col("description").alias("positive")).dropDuplicates(["id"]), "id").select("anchor", "positive", "cluster_id")
    return _paired(mates, described.select(F.col("description").alias("negative"), "cluster_id"), n, "similarity", 0.9, seed, "cluster_id")


def relation_triples(entities: DataFrame, opposite: dict[str, str], n: int, seed: int = 42) -> DataFrame:
    """Anchor, its type's label, the opposite type's label."""
    other = F.create_map(*[F.lit(x) for p in opposite.items() for x in p])
    rows = entities.select(F.col("name").alias("anchor"), F.col("type").alias("positive"), other[F.col("type")].alias("negative"), F.lit(0.8).alias("weight"), F.lit("relation").alias("strategy")).where("negative is not null")
    return rows.orderBy(draw("anchor", seed=seed), "anchor").limit(n)


def hard_triples(described: DataFrame, kind: str, positive_kind: str, n: int, seed: int = 42) -> DataFrame:
    """Anchors of a kind with their description, and a negative of another kind."""
    a = described.where(F.col("type") == kind).select(F.col("name").alias("anchor"), F.col("description").alias("positive"), "type")
    others = described.where(F.col("type") == positive_kind).select(F.col("description").alias("negative"), "type")
    return _paired(a, others, n, "hard", 1.2, seed, "type")


def mix(parts: list[tuple[DataFrame, float]], n: int, seed: int = 42) -> DataFrame:
    """Triples of several strategies by their share of ``n``."""
    picked = [df.orderBy(draw("anchor", "positive", seed=seed), "anchor").limit(max(1, int(n * share))) for df, share in parts]
    return reduce(DataFrame.unionByName, picked)


def backfill(first: DataFrame, second: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``first`` topped up with rows of ``second`` whose anchors it lacks, to ``n``."""
    have = first.count()
    more = second.join(first.select("anchor").distinct(), "anchor", "left_anti").select(first.columns)
    return first.unionByName(more.orderBy(draw("anchor", "positive", seed=seed), "anchor").limit(max(0, n - have)))


def strategy_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("strategy").agg(F.count("*").alias("n"))


def validate_anchors(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """(strategy, kept, dropped): triples whose anchor is and isn't an entity."""
    known = entities.select(F.col("name").alias("anchor")).distinct().withColumn("known", F.lit(True))
    rows = triples.join(known, "anchor", "left")
    return rows.groupBy("strategy").agg(F.count_if(F.col("known")).alias("kept"), F.count_if(F.col("known").isNull()).alias("dropped"))


def split(df: DataFrame, key: str, ratio: float = 0.85, seed: int = 42) -> DataFrame:
    """Add ``part``: train or val by a hash of the key, which needs no order of all rows."""
    unit = F.conv(F.substring(draw(key, seed=seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.withColumn("part", F.when(unit < ratio, "train").otherwise("val"))


def split_by_position(df: DataFrame, key: str, ratio: float = 0.85) -> DataFrame:
    """Add ``part``: the first share by the order of ``key`` is train, by exact count."""
    cut = df.approxQuantile(key, [ratio], 0.0)
    return df.withColumn("part", F.when(F.col(key) <= F.lit(cut[0] if cut else 0), "train").otherwise("val"))


ELEMENTS = {"fogo": "fogo|chama|fire", "agua": "agua|gelo|ice", "terra": "terra|pedra|stone", "ar": "\\bar\\b|vento|wind"}
FUNCTIONS = {"cura": "cura|regenera|heal", "dano": "dano|ataque|fere|damage"}
POWERS = {"alto": "lendari|epic|poderos", "medio": "comum|medio", "baixo": "fraco|menor"}


def infer_attributes(df: DataFrame, text: str = "text", kind: str | None = None) -> DataFrame:
    """Add element, function (spells only, where ``kind`` is given) and power by word lists, the first that matches."""

    def first(lists: dict[str, str]) -> Column:
        found = F.lit(None).cast("string")
        for label, pattern in reversed(list(lists.items())):
            found = F.when(fold(F.col(text)).rlike(pattern), label).otherwise(found)
        return found

    function = first(FUNCTIONS) if kind is None else F.when(F.col(kind) == "magia", first(FUNCTIONS))
    return df.withColumns({"element": first(ELEMENTS), "function": function, "power": first(POWERS)})


def name_buckets(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``bucket``: the longest folded word over two letters, the last by alphabet of equals."""
    words = F.filter(tokens(fold(F.col(name))), lambda w: F.length(w) > 2)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return df.withColumn("bucket", longest["w"])


def attribute_triples(described: DataFrame, same: str, unlike: str, n: int, strategy: str, weight: float = 1.0, seed: int = 42) -> DataFrame:
    """Anchor, its own description, and a description of the same attribute that differs in ``unlike``; one triple a name.

    With same bucket and other type: ambiguous names; same element, other type; same type,
    other function; and the like. The rows of an attribute value are dealt into rings of
    about ``RING`` rows, in which the nearest row that differs is taken; anchors whose ring
    has none get the first row of one of the value's first two kinds, of which one differs if any
    row of the value does.
    """
    rows = described.where(F.col(same).isNotNull())
    sizes = rows.groupBy(same).agg(F.ceil(F.count("*") / RING).cast("int").alias("rings"))
    order = [draw("name", seed=seed), F.col("name"), F.col("description"), F.col(unlike)]
    dealt = rows.join(small(sizes), same).withColumn("ring", F.pmod(F.xxhash64("name", "description"), F.col("rings")))
    dealt = dealt.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1))))  # the second lap closes the ring
    ring = Window.partitionBy(same, "ring").orderBy("lap", *order)
    dealt = dealt.withColumns({"pos": F.row_number().over(ring), "before": F.lag(unlike).over(ring)})
    # the nearest row that differs is the first one of the next run of equal values; backwards, a running value holds it
    start = F.when((F.col("pos") > 1) & ~F.col(unlike).eqNullSafe(F.col("before")), F.struct("pos", "description"))
    back = Window.partitionBy(same, "ring").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("start", start).withColumn("next", F.last("start", ignorenulls=True).over(back)).where("lap = 0")
    near = dealt.where("next is not null").select(same, "name", F.col("description").alias("positive"), F.col("next.description").alias("negative"), (F.col("next.pos") - F.col("pos")).alias("t"))
    values = rows.groupBy(same, unlike).agg(F.min(F.struct(draw("name", "description", seed=seed).alias("d"), F.col("description").alias("negative"))).alias("x"))
    spare = first_by(values, [same], F.col("x"), n=2).select(same, F.col(unlike).alias("other"), "x.d", "x.negative")
    rest = dealt.where("next is null").select(same, "name", F.col("description").alias("positive"), unlike).join(small(spare), same).where(~F.col(unlike).eqNullSafe(F.col("other")))
    rest = rest.select(same, "name", "positive", "negative", F.lit(1 << 30).alias("t"))
    found = first_by(near.unionByName(rest), ["name"], F.col("t"), F.col(same), F.col("positive"), F.col("negative"))
    out = found.select(F.col("name").alias("anchor"), "positive", "negative", F.lit(weight).alias("weight"), F.lit(strategy).alias("strategy"))
    return out.orderBy(draw("anchor", "positive", seed=seed), "anchor").limit(n)


#: Strategies of the second set of triples with their share: like names of other types, like elements of other types, like types
#: of other functions, like types of other power, and names that share half their words.
SECOND_SET = [("ambiguous", "bucket", "type", 0.30), ("element", "element", "type", 0.25), ("function", "type", "function", 0.20), ("power", "type", "power", 0.15)]


def second_triples(described: DataFrame, n: int, first: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """The second set (anchor, positive, negative, weight, strategy): each strategy's share of ``n``, the rest by synonyms, topped up from ``first``.

    ``described`` has (name, description, type, text); anchors of a strategy need the attribute it holds alike.
    """
    rows = name_buckets(infer_attributes(described))
    parts = [(attribute_triples(rows, same, unlike, n, strategy, seed=seed), share) for strategy, same, unlike, share in SECOND_SET]
    names = rows.select("name", "description", "type")
    a, b = names.select(F.col("name").alias("a"), F.col("description").alias("da"), F.col("type").alias("ta")), names.select(F.col("name").alias("b"), F.col("description").alias("db"), F.col("type").alias("tb"))
    alike = synonym_mates(names).join(a, "a").join(b, "b")
    alike = first_by(alike, ["a"], draw("a", "b", seed=seed), F.col("b")).select(F.col("a").alias("anchor"), F.col("db").alias("positive"), F.col("ta").alias("type"))
    parts.append((_paired(alike, names.select(F.col("description").alias("negative"), "type"), n, "synonym", 1.0, seed, "type"), round(1 - sum(share for *_, share in SECOND_SET), 6)))
    mixed = written(mix(parts, n, seed))
    return mixed if first is None else backfill(mixed, first, n, seed)


def synonym_pairs(df: DataFrame, share: float = 0.5, name: str = "name") -> DataFrame:
    """(a, b): names whose common words are ``share`` of the shorter name's or more.

    Prefix filter: two such names share one of the rarest words of either, those left
    when as many as the share needs, less one, are taken off the commonest; so names
    meet by these words alone, a pair at the first of them that both have.
    """
    words = df.select(F.col(name).alias("a"), F.array_distinct(tokens(fold(F.col(name)))).alias("wa")).where(F.size("wa") > 0).distinct()
    each = words.select("a", F.explode("wa").alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "w").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("r"))  # words of one name
    ranked = ranked.select("a", F.transform("r", lambda x: x["w"]).alias("wa"))
    # a partner that is no shorter needs at least this many of the name's words
    keyed = ranked.withColumn("key", F.explode(F.slice("wa", 1, F.greatest(F.lit(1), F.size("wa") - F.greatest(F.lit(1), F.ceil(share * F.size("wa"))).cast("int") + 1))))
    every = ranked.select(F.col("a").alias("b"), F.col("wa").alias("wb"), F.explode("wa").alias("key"))
    met = keyed.join(every, "key").where((F.col("a") != F.col("b")) & (F.size("wa") <= F.size("wb")))
    first = F.get(F.filter("wa", lambda w: F.array_contains(F.col("wb"), w)), F.lit(0)) == F.col("key")
    pairs = met.where(first & (F.size(F.array_intersect("wa", "wb")) >= share * F.size("wa")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def synonym_mates(df: DataFrame, share: float = 0.5, name: str = "name", most: int = 3, seed: int = 42) -> DataFrame:
    """(a, b): for each name that :func:`synonym_pairs` holds as ``a`` one of its partners ``b``, without a join of names.

    Two names belong together if they share as many words as the shorter one needs. Names
    meet as members of the sets of so many of their words; any two members are partners
    if the set has all that one of them needs. So a member takes the next later one by
    name that fits: of its ring of about ``RING`` members, or else the last of the set.
    Names that need more than ``most`` words have too many sets and meet as pairs.
    """
    words = df.select(F.col(name).alias("a"), F.array_sort(F.array_distinct(tokens(fold(F.col(name))))).alias("w")).where(F.size("w") > 0).distinct()
    words = words.withColumn("need", F.greatest(F.lit(1), F.ceil(share * F.size("w"))).cast("int"))
    sets = F.transform("w", lambda x: F.array(x))
    members = words.where(F.lit(most >= 1)).select("a", "need", F.lit(1).alias("m"), F.explode(sets).alias("key"))
    for m in range(2, most + 1):
        # words are sorted: a set grows by the words behind its last one
        sets = F.flatten(F.transform(sets, lambda s: F.transform(F.filter("w", lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))))
        members = members.unionByName(words.where(F.col("need") >= m).select("a", "need", F.lit(m).alias("m"), F.explode(sets).alias("key")))
    members = members.withColumn("short", F.when(F.col("need") == F.col("m"), F.col("a")))
    large = members.groupBy("key").agg(F.ceil(F.count("*") / RING).cast("int").alias("rings"), F.max("a").alias("last"), F.max("short").alias("last_short")).where("rings > 1")
    dealt = members.join(F.broadcast(large), "key", "left")  # a row for each ring at most
    dealt = dealt.withColumn("ring", F.pmod(F.xxhash64("a"), F.coalesce("rings", F.lit(1))))
    later = Window.partitionBy("key", "ring").orderBy(F.desc("a")).rowsBetween(Window.unboundedPreceding, -1)
    fits = F.col("short").isNotNull()
    mate = F.when(fits, F.coalesce(F.last("a").over(later), F.col("last"))).otherwise(F.coalesce(F.last("short", ignorenulls=True).over(later), F.col("last_short")))
    mates = dealt.select("a", mate.alias("b")).where("b > a")
    long = words.where(F.col("need") > most).select(F.col("a").alias("name"))
    return first_by(mates.unionByName(synonym_pairs(long, share)), ["a"], draw("a", "b", seed=seed), F.col("b"))


def guess_types(pairs: DataFrame, declared: str | None = None, query_types: dict[str, list[str]] = QUERY_TYPES, text_types: dict[str, str] = TEXT_TYPES) -> DataFrame:
    """Add query_type and doc_type to candidates (query, text): by the words of the query, and by the declared type if it is known, or else what the text holds; the first that fits, null if none does."""
    low = F.lower("query")
    asked, held = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, words in reversed(query_types.items()):
        asked = F.when(reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False)), kind).otherwise(asked)
    for kind, pattern in reversed(text_types.items()):
        held = F.when(F.col("text").rlike(pattern), kind).otherwise(held)
    if declared:
        held = F.when(F.upper(declared).isin(*text_types), F.upper(declared)).otherwise(held)
    return pairs.withColumns({"query_type": asked, "doc_type": held})


def label_pairs(pairs: DataFrame) -> DataFrame:
    """Add label and difficulty to candidates (query, text, rank, query_type, doc_type) by ordered rules; unlabelled ones go."""
    key = fold(F.col("query"))
    body = fold(F.col("text"))
    head = F.substring(body, 1, 80)
    both = F.col("query_type").isNotNull() & F.col("doc_type").isNotNull()
    label = lambda value, level: F.struct(F.lit(value).alias("label"), F.lit(level).alias("difficulty"))
    rule = F.when(F.contains(head, key), label(1, "facil")).when(F.contains(body, key), label(1, "medio"))
    rule = rule.when(both & (F.col("query_type") != F.col("doc_type")) & (F.col("rank") < 5), label(0, "dificil")).when(F.col("rank") >= 15, label(0, "facil"))
    rule = rule.when(both & (F.col("query_type") != F.col("doc_type")), label(0, "medio"))
    return pairs.withColumn("l", rule).where("l is not null").select("*", "l.label", "l.difficulty").drop("l")


def balance_pairs(labelled: DataFrame, n: int = 500, least: int = 0, spare: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """At most ``n`` pairs of each label in a seeded order.

    Where negatives are fewer than half the positives, rows of ``spare`` (candidates that
    no rule labels) top them up to as many as positives, as easy ones. With ``least``,
    pairs beyond ``n`` fill up to that many.
    """
    order = [draw("query", "text", seed=seed), F.col("query"), F.col("text")]
    columns = ["query", "text", "label", "difficulty"]
    rows = labelled.select(columns)
    if spare is not None:
        have = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        positives, negatives = have.get(1, 0), have.get(0, 0)
        if 0 < 2 * negatives < positives:
            more = spare.select("query", "text").distinct().join(rows.select("query", "text"), ["query", "text"], "left_anti")
            rows = rows.unionByName(more.orderBy(*order).limit(positives - negatives).select("query", "text", F.lit(0).alias("label"), F.lit("facil").alias("difficulty")))
    picked = first_by(rows, ["label"], *order, n=n)
    if least:
        rest = first_by(rows, ["label"], *order, n=n + least, rank="place").where(F.col("place") > n).drop("place")
        picked = picked.unionByName(rest.orderBy(*order).limit(max(0, least - picked.count())))
    return picked


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Pairs by label and difficulty, by label, and in total, in one pass."""
    return pairs.groupingSets([["label", "difficulty"], ["label"], []], "label", "difficulty").agg(F.count("*").alias("n"))
