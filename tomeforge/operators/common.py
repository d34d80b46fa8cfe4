"""Shapes that many operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, words_of
from ..sources.io import scratch, written

#: A side up to this size is broadcast by hint; beyond it the join is by key, or by blocks of the small side.
BROADCAST_BYTES = 32 << 20


def first_by(df: DataFrame, keys: list[str], *order: Column, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in a total order; ``rank`` keeps the place as a column."""
    name = rank or "__place"
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return df if rank else df.drop(name)


def prioritised(branches: list[DataFrame], keys: list[str], *order: Column) -> DataFrame:
    """Union of branches in order of priority (column ``priority``, from 0); the first row of each key stays."""
    tagged = [df.withColumn("priority", F.lit(i)) for i, df in enumerate(branches)]
    return first_by(reduce(DataFrame.unionByName, tagged), keys, F.col("priority"), *order)


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate is within the bound of a broadcast."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__()) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer's size estimate is within the bound, else as it is."""
    return F.broadcast(df) if is_small(df) else df


def blocks(df: DataFrame, key: str, row_bytes: int = 256) -> list[DataFrame]:
    """``df`` with a broadcast hint if its rows, counted, are within the bound; else parts within it, dealt by a hash of ``key``.

    For a stated query set that meets all rows of another table: each part is one pass over those.
    """
    n = max(1, -(-df.count() * row_bytes // BROADCAST_BYTES))
    return [F.broadcast(df if n == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)) for k in range(n)]


def meet_all(rows: DataFrame, asked: DataFrame, key: str, row_bytes: int = 256) -> DataFrame:
    """Every row with every row of a stated query set, which goes along in broadcast blocks."""
    return reduce(DataFrame.unionByName, [rows.crossJoin(part) for part in blocks(asked, key, row_bytes)])


def draw(*keys: str, seed: int = 42) -> Column:
    """An order that looks random and is the same in every run: md5 of the keys and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def contains_join(names: DataFrame, texts: DataFrame, name: str, text: str, text_id: str | None = None) -> DataFrame:
    """Pairs where the lower-cased ``text`` holds the lower-cased ``name``, whose longest word is a word of the text.

    Distinct words of texts are joined to the longest words of names; a name that is more
    than this word is looked for in the text afterwards. Names that can be broadcast meet
    the texts in one pass, in which nothing is shuffled. Else, with ``text_id``, only ids
    and words take part in that join and texts come back by id, so that no text is
    multiplied by its words.
    """
    words = F.sort_array(F.transform(tokens(F.col(name)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False)
    keyed = names.withColumn("__key", F.get(words, F.lit(0))["w"]).where("__key is not null").withColumn("__name", F.lower(F.col(name)))
    lowered = texts.withColumn("__text", F.lower(F.col(text)))
    key = F.explode(F.array_distinct(words_of(F.col("__text")))).alias("__key")
    if text_id is None or is_small(keyed):
        pairs = lowered.select("*", key).join(small(keyed), "__key")
    else:
        pairs = lowered.select(text_id, key).join(keyed, "__key").join(lowered, text_id)
    return pairs.where((F.col("__key") == F.col("__name")) | F.contains("__text", "__name")).drop("__key", "__name", "__text")


def name_keys(name: Column) -> Column:
    """What a name may hold of another one: its words, and of words that follow each other a whole one with a start, or an end with a whole one."""
    words = tokens(name)
    follow = F.greatest(F.size(words) - 1, F.lit(0))
    firsts, seconds = F.slice(words, F.lit(1), follow), F.slice(words, F.lit(2), follow)
    starts = F.zip_with(firsts, seconds, lambda a, b: F.transform(F.sequence(F.lit(1), F.length(b)), lambda k: F.concat_ws(" ", a, F.substring(b, F.lit(1), k))))
    ends = F.zip_with(firsts, seconds, lambda a, b: F.transform(F.sequence(F.lit(1), F.length(a)), lambda k: F.concat_ws(" ", F.substring(a, k, F.length(a)), b)))
    return F.array_distinct(F.concat(words, F.flatten(starts), F.flatten(ends)))


def held_names(short: DataFrame, s: str, long: DataFrame, l: str) -> DataFrame:
    """(s, l): distinct lower-cased names ``l`` that hold ``s`` in a place where one of its words is whole.

    Of a held name of several words, two that follow each other stand in the holding
    name, the first one whole or the second one: names of two words meet by them, longer
    ones by the rarest pair behind their first word. A common word alone brings no names
    together, but for names that are this word.
    """
    held = long.select(l, F.explode(name_keys(F.col(l))).alias("__key"))
    words = short.select(s, tokens(F.col(s)).alias("__ws")).where(F.size("__ws") > 0).distinct()
    few = words.where(F.size("__ws") < 3).select(s, F.array_join("__ws", " ").alias("__key"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("__ws") - 1), lambda k: F.array_join(F.slice("__ws", k, F.lit(2)), " "))
    many = words.where(F.size("__ws") >= 3).select(s, F.explode(F.array_distinct(pairs)).alias("__key"))
    many = many.join(held.groupBy("__key").agg(F.count("*").alias("__n")), "__key")
    rarest = first_by(many, [s], F.col("__n"), F.col("__key")).select(s, "__key")
    return few.unionByName(rarest).join(held, "__key").where(F.contains(l, s)).select(s, l).distinct()


def dropped_in_turn(pairs: DataFrame) -> DataFrame:
    """(late): what a pass in order drops, of pairs (early, late) of which the late one goes if the early one stays.

    Whatever has no earlier partner left stays and drops its later ones; those take
    their own pairs with them, and so on in rounds, each a written table. The result is
    that of one pass over all in order; the rounds are at most the longest chain of
    pairs, and few where chains are short.
    """
    spark = pairs.sparkSession
    gone = None
    with scratch(spark) as keep:
        left = keep(pairs.select("early", "late").distinct())
        while not left.isEmpty():
            stay = left.select("early").distinct().join(left.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
            go = keep(left.join(stay, "early", "left_semi").select("late").distinct())
            gone = go if gone is None else gone.unionByName(go)
            left = keep(left.join(go, "late", "left_anti").join(go.select(F.col("late").alias("early")), "early", "left_anti"))
        return written(gone if gone is not None else left.select("late"))
