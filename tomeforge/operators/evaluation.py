"""Evaluation of retrieval, answers and feedback; audits and profiles of catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, tokens
from .common import contains_join, draw, first_by, held_names


def ground_truth(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents that hold any target of a query (all of two or more for comparisons), matched by words.

    ``queries`` has (query_id, targets, comparison).
    """
    targets = queries.select("query_id", F.explode("targets").alias("target"), F.when(F.col("comparison"), 2).otherwise(1).alias("least"))
    targets = targets.withColumn("nth", F.dense_rank().over(Window.partitionBy("query_id", "least").orderBy("target")))
    hits = contains_join(targets, docs.select("doc_id", "text"), "target", "text", "doc_id")
    # numbers of a fixed width are aggregated before the one shuffle: two distinct targets are a least and a greatest one
    found = hits.groupBy("query_id", "doc_id", "least").agg(F.min("nth").alias("low"), F.max("nth").alias("high"))
    return found.where("least = 1 or low < high").select("query_id", "doc_id")


def ir_metrics(ranked: DataFrame, truth: DataFrame, queries: DataFrame, mrr_k: int = 10, recall_k: int = 5, ndcg_k: int = 5) -> DataFrame:
    """One row: MRR@10, Recall@5, NDCG@5 and MAP of ranked lists (query_id, doc_id, rank) over all queries.

    A document counts at its first place; queries without relevant documents count as 0.
    """
    relevant = truth.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    first = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    joined = first.join(relevant, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy("rank")
    joined = joined.withColumn("place", F.row_number().over(w)).withColumn("hits", F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = joined.groupBy("query_id").agg(
        F.coalesce(F.max(F.when((F.col("rel") == 1) & (F.col("place") <= mrr_k), 1 / F.col("place"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("place") <= recall_k, F.col("rel")).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("place") <= ndcg_k, F.col("rel") / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("place")).otherwise(0.0)).alias("precisions"),
    )
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(ndcg_k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = queries.select("query_id").distinct().join(each, "query_id", "left").join(n, "query_id", "left")
    part = lambda c: F.round(F.avg(F.when(F.col("n") > 0, c).otherwise(0.0)), 6)
    return rows.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"),
        part(F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"),
        part(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        part(F.coalesce("precisions", F.lit(0.0)) / F.col("n")).alias("map"),
    )


def compare_models(metrics: DataFrame, baseline: str, challenger: str, gain: float = 0.15) -> DataFrame:
    """(metric, base, new, delta, accepted): relative change, or times 100 from a base of 0; accepted if MRR gains enough. ``metrics`` is (model, metric, value)."""
    wide = metrics.groupBy("metric").agg(F.max(F.when(F.col("model") == baseline, F.col("value"))).alias("base"), F.max(F.when(F.col("model") == challenger, F.col("value"))).alias("new"))
    delta = F.when(F.col("base") == 0, (F.col("new") - F.col("base")) * 100).otherwise((F.col("new") - F.col("base")) / F.col("base"))
    return wide.withColumn("delta", F.round(delta, 6)).withColumn("accepted", F.when(F.col("metric") == "mrr", F.col("delta") >= gain))


def phrase_metrics(results: DataFrame, phrases: DataFrame, k: int = 5) -> DataFrame:
    """One row: share of queries with a result in the top k that holds one of their phrases, and the mean reciprocal rank."""
    both = results.join(phrases, "query_id").where(F.exists("phrases", lambda p: F.contains(F.lower("text"), F.lower(p))))
    first = both.groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = phrases.select("query_id").join(first, "query_id", "left")
    return rows.agg(F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def pairwise_auc(scored: DataFrame) -> DataFrame:
    """(query_id, auc): share of (positive, negative) pairs in the right order, ties half, by mean ranks; queries with both labels."""
    ranks = scored.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy("score")))
    ties = ranks.withColumn("t", F.count("*").over(Window.partitionBy("query_id", "score")))
    mean_rank = F.col("r") + (F.col("t") - 1) / 2
    each = ties.groupBy("query_id").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"), F.sum(F.when(F.col("label") == 1, mean_rank)).alias("s"))
    return each.where("p > 0 and n > 0").select("query_id", F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n")), 6).alias("auc"))


def graded_ndcg(scored: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ndcg) of (query_id, item, score, label) with gain 2^label - 1, ideal over all pairs."""
    gain = (F.pow(2.0, F.col("label")) - 1) / F.log2(F.col("p") + 1)

    def total(order: list[Column], name: str) -> DataFrame:
        return first_by(scored, ["query_id"], *order, n=k, rank="p").groupBy("query_id").agg(F.sum(gain).alias(name))

    got = total([F.desc("score"), F.col("item")], "dcg").join(total([F.desc("label"), F.col("item")], "ideal"), "query_id")
    return got.select("query_id", F.when(F.col("ideal") > 0, F.round(F.col("dcg") / F.col("ideal"), 6)).otherwise(0.0).alias("ndcg"))


def ab_means(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(query_id, a, b): mean score of each model for each query (query_id, model, score)."""
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("score")))
    return scores.groupBy("query_id").agg(mean(a).alias("a"), mean(b).alias("b"))


def ab_test(scores: DataFrame, challenger: str, baseline: str, target: float = 0.55) -> DataFrame:
    """One row: queries, win share of the challenger and whether it reaches the target."""
    means = ab_means(scores, challenger, baseline).where("a is not null and b is not null")
    share = F.round(F.avg((F.col("a") > F.col("b")).cast("double")), 6)
    return means.agg(F.count("*").alias("queries"), share.alias("win_share")).withColumn("accepted", F.col("win_share") >= target)


def ab_failures(scores: DataFrame, challenger: str, baseline: str) -> DataFrame:
    """(query_id, positive, negative): the two models' first results where the challenger's mean is lower."""
    lost = ab_means(scores, challenger, baseline).where("a < b").select("query_id")
    top = first_by(scores, ["query_id", "model"], F.desc("score"), F.col("item"))
    one = lambda m, name: top.where(F.col("model") == m).select("query_id", F.col("item").alias(name))
    return lost.join(one(challenger, "positive"), "query_id").join(one(baseline, "negative"), "query_id")


def rerank_lift(pairs: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, before, after): relevant results in the top k by the first and by the final rank; relevant if the text has a word of the query of three letters or more."""
    words = F.filter(tokens(F.col("query")), lambda w: F.length(w) > 2)
    relevant = F.exists(words, lambda w: F.contains(F.lower("text"), w))
    return pairs.groupBy("query_id").agg(F.count_if(relevant & (F.col("rank") <= k)).alias("before"), F.count_if(relevant & (F.col("final_rank") <= k)).alias("after"))


HEDGES = ["talvez", "acho que", "provavelmente", "possivelmente", "pode ser que"]


def validate_answers(answers: DataFrame, hedges: list[str] = HEDGES) -> DataFrame:
    """(answer_id, violations): rules an answer (text, book, used_books) breaks, in order.

    A quotation is there; the cited book is among the used ones; every number is inside
    a quotation; no hedging words.
    """
    quotes = F.regexp_extract_all("text", F.lit(r'"([^"]{3,})"'), F.lit(1))
    numbers = F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))
    quoted = F.array_join(quotes, " ")
    lowered = F.lower("text")
    hedge = F.exists(F.array(*map(F.lit, hedges)), lambda h: F.contains(lowered, h))
    rules = F.array(
        F.when(F.size(quotes) == 0, "no_quotation"),
        F.when(F.col("book").isNotNull() & ~F.array_contains("used_books", F.col("book")), "unknown_book"),
        F.when(F.exists(numbers, lambda n: ~F.contains(quoted, n)), "loose_number"),
        F.when(hedge, "hedging"),
    )
    return answers.select("answer_id", F.filter(rules, lambda r: r.isNotNull()).alias("violations"))


def answer_metrics(answers: DataFrame, blocks: list[str]) -> DataFrame:
    """(answer_id, has_blocks, has_citation, has_source, has_formula)."""
    every = F.forall(F.array(*map(F.lit, blocks)), lambda b: F.contains(F.col("text"), b))
    return answers.select("answer_id", every.alias("has_blocks"), F.col("text").rlike('"[^"]{3,}"').alias("has_citation"), F.lower("text").rlike("fonte|source|livro").alias("has_source"), F.col("text").rlike(r"\d+d\d*|[+=]\s*\d").alias("has_formula"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """(query, mean, n, low), low where the mean is below 0; shown worst first, more frequent first."""
    rows = feedback.groupBy("query").agg(F.round(F.avg("rating"), 6).alias("mean"), F.count("*").alias("n"))
    return rows.withColumn("low", F.col("mean") < 0).orderBy("mean", F.desc("n"), "query")


def feedback_totals(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count("*").alias("entries"), F.count_distinct("query").alias("queries"))


def section_label(section: Column, text: Column, cues: list[tuple[str, str]]) -> Column:
    """The given section, else the label of the first cue in the text, else "outros"."""
    found = F.lit("outros")
    for cue, label in reversed(cues):
        found = F.when(F.contains(F.lower(text), F.lit(cue)), F.lit(label)).otherwise(found)
    return F.coalesce(F.nullif(section, F.lit("")), found)


def coverage(index: DataFrame, extracted: DataFrame, folded: bool = False) -> DataFrame:
    """(name, status): covered, missing (only in the index) or extra (only extracted)."""
    key = fold(F.col("name")) if folded else F.col("name")
    a, b = (df.select(key.alias("name")).distinct() for df in (index, extracted))
    both = a.withColumn("i", F.lit(1)).join(b.withColumn("e", F.lit(1)), "name", "full")
    return both.select("name", F.when(F.col("e").isNull(), "missing").when(F.col("i").isNull(), "extra").otherwise("covered").alias("status"))


def index_gaps(rows: DataFrame, pattern: str = r"^(\d+)\.\s+\S") -> DataFrame:
    """(group, n, gap): numbered rows (group, line) after which numbers are missing, with how many; badly formed rows have gap null."""
    number = F.regexp_extract("line", pattern, 1).try_cast("int")
    kept = rows.select("group", number.alias("n"))
    gaps = kept.where("n is not null").withColumn("gap", F.lead("n").over(Window.partitionBy("group").orderBy("n")) - F.col("n") - 1).where("gap > 0")
    return gaps.unionByName(kept.where("n is null").select("group", "n", F.lit(None).cast("int").alias("gap")))


def profile_items(items: DataFrame) -> DataFrame:
    """One row of shares over items (name, price, effect): priced, short effects, suspicious names and good rows."""
    odd = F.col("name").rlike(r"\d{3,}|[^\p{L}\p{N}\s'#-]") | (F.length("name") < 4)
    brief = F.length(F.coalesce("effect", F.lit(""))) < 20
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    priced = F.col("price").isNotNull()
    return items.agg(F.count("*").alias("items"), share(priced).alias("priced"), share(brief).alias("brief"), share(odd).alias("odd"), F.count_if(priced & ~brief & ~odd).alias("good"))


def field_diff(extracted: DataFrame, reference: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, status): OK, LACUNA (missing), DIFERENTE or SOBRANDO (extra) for each field of each row."""
    a = extracted.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.col(f).cast("string"), F.lit("")).alias("got")) for f in fields])))
    b = reference.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.col(f).cast("string"), F.lit("")).alias("want")) for f in fields])))
    status = F.when(F.col("got").eqNullSafe(F.col("want")), "OK").when(F.col("got").isNull(), "LACUNA").when(F.col("want").isNull(), "SOBRANDO").otherwise("DIFERENTE")
    return a.join(b, [key, "field"], "full").select(key, "field", status.alias("status"))


def source_summary(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"), F.min(name).alias("sample"))


def sample_items(df: DataFrame, key: str, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` rows that look random and are the same in every run."""
    return df.orderBy(draw(key, seed=seed), key).limit(n)


def fill_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, share) of rows with a value."""
    row = df.agg(*[F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in columns])))


def fuzzy_coverage(index: DataFrame, names: DataFrame, aliases: dict[str, str], prefixes: list[str]) -> DataFrame:
    """(name, found, status): index names matched to extracted ones by folded equality after aliases and prefixes, then by containment of words; the rest missing."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None

    def key(c: Column) -> Column:
        k = fold(F.trim(c))
        k = F.coalesce(known[k], k) if known is not None else k
        return F.regexp_replace(k, "^(?:" + "|".join(rf"\Q{p}\E" for p in prefixes) + r")\s+", "") if prefixes else k

    a = index.select("name", key(F.col("name")).alias("k")).distinct()
    b = names.select(F.col("name").alias("found"), key(F.col("name")).alias("kf")).distinct()
    equal = first_by(a.join(b, F.col("k") == F.col("kf")), ["name"], F.col("found")).select("name", "found", F.lit("covered").alias("status"))
    rest = a.join(equal.select("name"), "name", "left_anti")
    pairs = held_names(rest, "k", b, "kf").unionByName(held_names(b, "kf", rest, "k")).distinct()
    partial = first_by(rest.join(pairs, "k").join(b, "kf"), ["name"], F.desc(F.length("kf")), F.col("found")).select("name", "found", F.lit("partial").alias("status"))
    missing = rest.join(partial.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("found"), F.lit("missing").alias("status"))
    return equal.unionByName(partial).unionByName(missing)


def not_found(index: DataFrame, extracted: DataFrame) -> DataFrame:
    """Index rows (name, source) without an extracted name, whatever the case."""
    return index.join(extracted.select(F.lower("name").alias("__k")), F.lower("name") == F.col("__k"), "left_anti")
