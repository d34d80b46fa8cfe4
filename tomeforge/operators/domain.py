"""Domain analytics over catalogue, build and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.rules import STRONG_ABILITIES, WEAK_ABILITIES
from ..functions.text import fold, slug, tokens
from ..sources.io import written
from .common import draw, first_by, meet_all, prioritised, small

#: Experience needed for each level, from level 1: of the campaign ledger and of the player's sheet.
CAMPAIGN_LEVELS = [0, 1000, 3000, 6000, 10000, 15000, 21000, 28000, 36000, 45000]
SHEET_LEVELS = [0, 50, 150, 300, 500, 800, 1200, 1700, 2300, 3000]
DIFFICULTY = {"facil": 0.5, "medio": 1.0, "dificil": 1.5, "mortal": 2.0}


def strength(df: DataFrame, strong: list[str] = STRONG_ABILITIES, weak: list[str] = WEAK_ABILITIES) -> DataFrame:
    """Add strength (0 to 100) and its label.

    Rows have f, h, r, a, pdf, pv, pm (texts, maybe ranges or dice), abilities, immunities,
    vulnerabilities, weaknesses and attacks (arrays) and scale (text).
    """
    stats = F.lit(0.0)
    for c in ("f", "h", "r", "a", "pdf"):
        stats = stats + F.coalesce(parse.range_mean(F.col(c)), F.lit(0.0))
    base = F.transform("abilities", lambda x: F.trim(F.split(F.lower(x), r"\(")[0]))
    worth = F.transform(base, lambda x: F.when(x.isin(*strong) | x.rlike("veneno|regenera|imortal|invulner|paralisia"), 2.0).when(x.isin(*weak), -1.0).otherwise(0.5))
    ability = F.aggregate(worth, F.lit(0.0), lambda s, x: s + x)
    scale = F.upper(F.coalesce("scale", F.lit("")))
    size = F.when(F.contains(scale, F.lit("S")), 10).when(F.contains(scale, F.lit("K")), 20).otherwise(0)
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    defence = F.least(F.lit(15), count("immunities") * 2 - count("vulnerabilities") * 2 - F.when(count("weaknesses") > 0, 3).otherwise(0))
    total = (
        F.least(F.lit(25.0), stats * 1.5)
        + F.least(F.lit(20.0), (parse.resource_mean(F.col("pv")) + parse.resource_mean(F.col("pm"))) / 4)
        + F.least(F.lit(25.0), F.greatest(F.lit(-5.0), ability * 1.5))
        + defence
        + size
        + F.least(F.lit(10), count("attacks") * 2)
    )
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)) + 0.5).cast("int")
    out = df.withColumn("strength", score)
    s = F.col("strength")
    return out.withColumn("label", F.when(s < 15, "Muito fraco").when(s < 30, "Fraco").when(s < 50, "Médio").when(s < 70, "Forte").when(s < 85, "Muito forte").otherwise("Extremo"))


def browse(df: DataFrame, book: str | None = None, kind: str | None = None, text: str | None = None, order: str = "name") -> DataFrame:
    """Rows (name, book, kind, text) of a book and kind that hold all words of a text, accents, case and plural -s aside; sorted by folded key."""
    if book:
        df = df.where(F.col("book") == book)
    if kind:
        df = df.where(fold(F.col("kind")) == kind.lower())
    hay = fold(F.concat_ws(" ", "name", "text"))
    for word in (text or "").lower().split():
        df = df.where(F.contains(hay, fold(F.lit(word.rstrip("s")))))
    return df.orderBy(fold(F.col(order)), "name")


def card_rows(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of a card's non-blank fields."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(key, F.inline(rows)).where("trim(value) <> ''")


def by_slug(df: DataFrame, slugs: DataFrame, preferred: str, name: str = "name", book: str = "book") -> DataFrame:
    """(slug, …): the row whose slug is equal, else one whose slug holds it by a shared part; the preferred book first."""
    keyed = df.withColumn("__s", slug(F.col(name)))
    equal = slugs.join(keyed, F.col("slug") == F.col("__s"))
    rest = slugs.join(equal.select("slug").distinct(), "slug", "left_anti").withColumn("__p", F.explode(F.split("slug", "-")))
    near = rest.join(keyed.withColumn("__p", F.explode(F.array_distinct(F.split("__s", "-")))), "__p").where("contains(__s, slug)").drop("__p").distinct()
    rows = prioritised([equal, near.select(equal.columns)], ["slug"], F.desc(F.col(book) == preferred), F.col("__s"), F.col(book))
    return rows.drop("__s", "priority")


def encounter_candidates(parties: DataFrame, monsters: DataFrame, k: int = 10) -> DataFrame:
    """(party_id, monster, power, rank): monsters whose level (power div 3) is within two of the party's, by power.

    Levels are joined as the five equal keys of the range, to the first ``k`` monsters of
    each, which are cut where tasks have shares of the monsters dealt by name.
    """
    keyed = parties.select("party_id", F.explode(F.sequence(F.col("level") - 2, F.col("level") + 2)).alias("mlevel"))
    rows = monsters.select("monster", "power", F.expr("power div 3").cast("int").alias("mlevel"))
    rows = first_by(rows.repartition("monster"), ["mlevel"], F.col("power"), F.col("monster"), n=k)
    ranked = first_by(keyed.join(rows, "mlevel"), ["party_id"], F.col("power"), F.col("monster"), n=k, rank="rank")
    return ranked.select("party_id", "monster", "power", "rank")


def compose_encounters(parties: DataFrame, candidates: DataFrame) -> DataFrame:
    """(party_id, target, monster, n, xp, actual): a base monster by difficulty (weakest, middle or strongest candidate), as many as the budget takes, and the difficulty reached."""
    factor = F.create_map(*[F.lit(x) for p in DIFFICULTY.items() for x in p])
    n = F.count("*").over(Window.partitionBy("party_id"))
    place = F.when(F.col("difficulty") == "facil", 1).when(F.col("difficulty") == "medio", F.expr("(n + 1) div 2")).otherwise(F.col("n"))
    rows = candidates.withColumn("n", n).join(parties, "party_id").where(F.col("rank") == place)
    target = F.col("level") * 100 * F.col("size") * factor[F.col("difficulty")]
    each = F.greatest(F.lit(1), F.col("power") * 10)
    many = F.greatest(F.lit(1), F.floor(target / each)).cast("int")
    rows = rows.select("party_id", target.alias("target"), "monster", many.alias("n"), (many * each).cast("long").alias("xp"))
    ratio = F.col("xp") / F.col("target")
    return rows.withColumn("actual", F.when(ratio < 0.7, "facil").when(ratio < 1.3, "medio").when(ratio < 2.0, "dificil").otherwise("mortal"))


def check_builds(builds: DataFrame, catalog: DataFrame, points: int = 5) -> DataFrame:
    """(build_id, spent, left, pv, pm, violations): points of characters (f, h, r, a, pdf, choices array, extra_pv, extra_pm) against costs (name, cost)."""
    chosen = builds.select("build_id", F.explode("choices").alias("name")).join(small(catalog.select("name", "cost")), "name", "left")
    cost = chosen.groupBy("build_id").agg(F.sum(F.greatest(F.lit(0), F.coalesce("cost", F.lit(0)))).alias("adv"), F.sum(F.least(F.lit(0), F.coalesce("cost", F.lit(0)))).alias("dis"))
    rows = builds.join(cost, "build_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("adv", "dis")})
    stats = F.col("f") + F.col("h") + F.col("r") + F.col("a") + F.col("pdf")
    left = F.lit(points) - F.col("dis") - stats - F.col("adv")
    base = F.greatest(F.lit(1), F.col("r") * 5)
    rules = F.array(F.when(left < 0, "points"), F.when(F.greatest("f", "h", "r", "a", "pdf") > 5, "stat_limit"), F.when(F.col("dis") < -points, "disadvantages"))
    return rows.select("build_id", (stats + F.col("adv")).alias("spent"), left.alias("left"), (base + F.col("extra_pv") * 5).alias("pv"), (base + F.col("extra_pm") * 5).alias("pm"), F.filter(rules, lambda x: x.isNotNull()).alias("violations"))


#: How many advantages a level may choose, and disadvantages of which costs; those of one row only without others: fixed values.
LEVEL_LIMITS = [
    ("pessoa_comum", "advantage", [1, 2, 3, 4], 2), ("novato", "advantage", [1, 2, 3, 4], 2), ("lutador", "advantage", [1, 2, 3, 4], 999), ("campeao", "advantage", [1, 2, 3, 4], 999), ("lenda", "advantage", [1, 2, 3, 4], 999),
    ("pessoa_comum", "disadvantage", [1], 1), ("novato", "disadvantage", [1], 3), ("novato", "disadvantage", [2], 1), ("lutador", "disadvantage", [1], 3), ("lutador", "disadvantage", [2], 2),
    ("lutador", "disadvantage", [3, 4], 1), ("campeao", "disadvantage", [1, 2], 3), ("campeao", "disadvantage", [3, 4], 2), ("lenda", "disadvantage", [1, 2, 3, 4], 3),
]


def within_limits(choices: DataFrame, builds: DataFrame, catalog: DataFrame, limits: list[tuple[str, str, list[int], int]] = LEVEL_LIMITS) -> DataFrame:
    """Rows of ``choices`` (build_id, name) that the level of a build (build_id, level, choices) has room for.

    A negative cost (name, cost) makes a disadvantage, of 1 to 4 points, other amounts
    count as 1. A choice falls under the limit of its level, kind and points: there must
    be fewer of these in the build than it says, and of disadvantages none under another
    limit. Choices under no limit go; builds of unknown level can choose nothing more.
    """
    spark = choices.sparkSession
    rules = spark.createDataFrame([(i, *row) for i, row in enumerate(limits)], "rule int, level string, kind string, points array<int>, most int")
    points = F.abs("cost").cast("int")
    kinds = catalog.select("name", F.when(F.col("cost") < 0, "disadvantage").otherwise("advantage").alias("kind"), F.when(points.between(1, 4), points).otherwise(1).alias("p"))
    levels = builds.select("build_id", "level")

    def ruled(rows: DataFrame) -> DataFrame:
        """With the limit that a row falls under."""
        known = rows.join(small(kinds), "name").join(levels, "build_id")
        return known.join(F.broadcast(rules.withColumn("p", F.explode("points")).drop("points")), ["level", "kind", "p"])  # a list of rules

    taken = ruled(builds.select("build_id", F.explode("choices").alias("name")))
    held = taken.groupBy("build_id", "kind").agg(F.count("*").alias("all"))
    own = taken.groupBy("build_id", "rule").agg(F.count("*").alias("own"))
    rows = ruled(choices.select("build_id", "name")).join(held, ["build_id", "kind"], "left").join(own, ["build_id", "rule"], "left")
    mine, every = F.coalesce("own", F.lit(0)), F.coalesce("all", F.lit(0))
    return rows.where((mine < F.col("most")) & ((F.col("kind") == "advantage") | (mine == every))).select("build_id", "name")


def allowed_choices(builds: DataFrame, catalog: DataFrame, excluded: DataFrame, exclusive: DataFrame, budget: Column) -> DataFrame:
    """(build_id, name): catalogue rows (name, cost, requires) a build may still take.

    Taken ones, those excluded for its race (race, name), those exclusive with a taken one
    (name, other), those whose requirement isn't taken and those beyond ``budget`` go.
    The result has as many rows as builds have eligible choices; ``within_limits`` cuts
    it by the counts that a level allows.
    """
    taken = builds.select("build_id", F.explode("choices").alias("name"))
    every = builds.withColumn("budget", budget).select("build_id", "race", "budget")
    every = meet_all(every, catalog, "name")
    rows = every.where(F.col("cost") <= F.col("budget"))
    rows = rows.join(taken, ["build_id", "name"], "left_anti").join(excluded, ["race", "name"], "left_anti")
    barred = taken.join(exclusive, "name").select("build_id", F.col("other").alias("name"))
    rows = rows.join(barred, ["build_id", "name"], "left_anti")
    free = rows.where("requires is null")
    met = rows.join(taken.withColumnRenamed("name", "requires"), ["build_id", "requires"], "left_semi")
    return free.select("build_id", "name").unionByName(met.select("build_id", "name"))


#: Pairs of builds and spells that a task gives, and spells that each of its builds meets in turn: a multiple of 8, as Parquet packs values by eight.
PAIRS_A_TASK, SPELLS_A_RUN = 8_000_000, 504
#: Runs of spells that are numbered together, and builds that are shuffled together.
RUNS, BUILDS = 32, 64


def eligible_spells(builds: DataFrame, spells: DataFrame, paths: dict[str, str]) -> DataFrame:
    """(build_id, spell): spells one of whose schools maps to a path the build has at 1 or more. Builds have (build_id, path, value).

    The result is as large as its pairs. So these are not shuffled: a pair comes from the
    first path that both have. Spells of a path are cut to runs, and of the builds of the
    path, dealt to as many tasks as the pairs, counted, need, each meets a run on its own;
    they are shuffled in packs, once for each run. Rows of a task repeat one short run, build
    after build, in the same order, so that a written result takes a tenth of a byte a pair.
    """
    known = F.create_map(*[F.lit(x) for p in paths.items() for x in p])
    schools = spells.select("spell", F.explode(F.split("schools", "[,/]| e | ou ")).alias("s")).select("spell", known[fold(F.trim("s"))].alias("path")).where("path is not null")
    some = lambda c: F.when(F.size(c) > 1, F.col(c)).alias(c)
    every = lambda df, key, c: df.groupBy(key).agg(F.array_sort(F.collect_set("path")).alias(c)).select(key, some(c), F.explode(c).alias("path"))
    schools, owned = written(every(schools, "spell", "theirs")), written(every(builds.where("value >= 1 and path is not null"), "build_id", "own"))
    count = lambda df, n: df.groupBy("path").agg(F.count("*").alias(n))
    share = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    sizes = written(count(owned, "n").join(count(schools, "m"), "path"))
    shared = schools.join(small(sizes), "path").withColumn("share", share("spell", F.ceil(F.col("m") / (RUNS * SPELLS_A_RUN))))
    place = F.row_number().over(Window.partitionBy("path", "share").orderBy("spell")) - 1
    runs = written(shared.select("spell", "theirs", "path", "n", (F.col("share") * 2 * RUNS + F.floor(place / SPELLS_A_RUN)).cast("int").alias("run")))
    need = F.ceil(F.col("n") * F.count("*") / PAIRS_A_TASK)
    deals = written(runs.groupBy("path", "run", "n").agg(need.alias("need")).select("path", "run", F.least("need", "n").cast("int").alias("deals")))
    tasks = min(max(1, deals.agg(F.sum("deals")).first()[0] or 1), 10_000)
    keys = ["path", "run", "deal"]
    held = max(1, min(BUILDS, PAIRS_A_TASK // SPELLS_A_RUN))
    packs = owned.join(small(sizes), "path").groupBy("path", "own", share("build_id", F.ceil(F.col("n") / held)).alias("pack")).agg(F.collect_list(F.struct("build_id")).alias("builds"))
    mine = packs.join(small(deals), "path").withColumn("deal", F.col("pack") % F.col("deals")).select("builds", "own", *keys)
    all_of = runs.join(small(deals), ["path", "run"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("spell", "theirs", *keys)
    mine = mine.repartition(tasks, *keys).select("own", *keys, F.inline("builds"))
    met = mine.join(all_of.repartition(tasks, *keys).hint("shuffle_hash"), keys)
    first = F.coalesce(F.get(F.array_intersect("own", "theirs"), F.lit(0)) == F.col("path"), F.lit(True))
    return met.where(first).select("build_id", "spell")


def apply_race(builds: DataFrame, packages: DataFrame) -> DataFrame:
    """Stats with the race's modifiers, not below 0, and its granted choices added. Packages have (race, f_mod, h_mod, r_mod, granted)."""
    both = builds.join(small(packages), "race", "left")
    mod = {c: F.greatest(F.lit(0), F.col(c) + F.coalesce(f"{c}_mod", F.lit(0))) for c in ("f", "h", "r")}
    return both.withColumns({**mod, "choices": F.array_union("choices", F.coalesce("granted", F.array().cast("array<string>")))}).drop("f_mod", "h_mod", "r_mod", "granted")


def recall(queries: DataFrame, events: DataFrame, characters: DataFrame, threads: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, kind, item, score): events whose description (+3), participants (+2) or place (+1) share a word with the query, characters (5) and threads (4) it names."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("w"))
    where = lambda c, n: events.select("event_id", F.explode(F.array_distinct(tokens(c))).alias("w"), F.lit(n).alias("s"))
    parts = where(F.col("description"), 3).unionByName(where(F.array_join("participants", " "), 2)).unionByName(where(F.col("place"), 1))
    hits = asked.join(parts, "w").groupBy("query_id", "event_id", "s").agg(F.lit(1).alias("one")).groupBy("query_id", "event_id").agg(F.sum("s").alias("score"))
    rows = hits.select("query_id", F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("item"), "score")
    for kind, df, score in (("character", characters, 5), ("thread", threads, 4)):
        named = df.select("name", F.explode(F.array_distinct(tokens(F.col("name")))).alias("w"))
        rows = rows.unionByName(asked.join(named, "w").select("query_id", F.lit(kind).alias("kind"), F.col("name").alias("item"), F.lit(score).cast("long").alias("score")).distinct())
    return first_by(rows, ["query_id"], F.desc("score"), F.col("kind"), F.col("item"), n=k)


def recap(events: DataFrame, sessions: int, importance: int = 3) -> DataFrame:
    """Important events of the last sessions in the order of time."""
    place = F.dense_rank().over(Window.partitionBy("campaign").orderBy(F.desc("session")))
    return events.withColumn("__p", place).where((F.col("__p") <= sessions) & (F.col("importance") >= importance)).drop("__p").orderBy("campaign", "ts")


def dormant(last_seen: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """(character, days): living characters not seen for more than ``days``, longest first."""
    gone = F.datediff(now, F.col("last_seen"))
    return last_seen.where(F.col("alive") & (gone > days)).select("character", gone.alias("days")).orderBy(F.desc("days"), "character")


def callbacks(seen: DataFrame, threads: DataFrame, now: Column, days: int = 14, seed: int = 42) -> DataFrame:
    """(campaign, kind, subject, detail): what to bring back into each campaign.

    The living character (campaign, character, last_seen, alive) that is gone for longest,
    if for more than ``days``, with the number of days; else one of the paused threads
    (campaign, title, status, hook, involved) in a seeded order, with its hook and the
    first three involved. Campaigns without either have no row.
    """
    gone = F.datediff(now, F.col("last_seen"))
    away = seen.where(F.col("alive") & (gone > days)).select("campaign", F.lit("dormant").alias("kind"), F.col("character").alias("subject"), gone.cast("string").alias("detail"), F.lpad((1_000_000 - gone).cast("string"), 8, "0").alias("order"))
    hook = F.concat_ws(" | ", F.coalesce("hook", F.lit("")), F.array_join(F.slice("involved", 1, 3), ", "))
    paused = threads.where("status = 'pausado'").select("campaign", F.lit("paused").alias("kind"), F.col("title").alias("subject"), hook.alias("detail"), draw("campaign", "title", seed=seed).alias("order"))
    return prioritised([away, paused], ["campaign"], F.col("order"), F.col("subject")).select("campaign", "kind", "subject", "detail")


def session_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session", "event_type").agg(F.count("*").alias("n"))


def xp_ledger(events: DataFrame, party: DataFrame) -> DataFrame:
    """(character, xp, appearances, last_seen): an event's xp divided (whole numbers) among its participants in the party."""
    rows = events.select("event_id", "ts", "xp", F.explode(F.array_distinct("participants")).alias("character"))
    inside = rows.join(small(party.select("character")), "character", "left_semi")
    shares = inside.withColumn("n", F.count("*").over(Window.partitionBy("event_id"))).withColumn("share", F.expr("xp div n"))
    return shares.groupBy("character").agg(F.sum("share").alias("xp"), F.count("*").alias("appearances"), F.max("ts").alias("last_seen"))


def levels(df: DataFrame, thresholds: list[int] = CAMPAIGN_LEVELS, xp: str = "xp") -> DataFrame:
    """Add level, next_xp, missing and progress (share of the way, in whole percent) by a threshold table; no next level is null."""
    table = F.array(*map(F.lit, thresholds))
    level = F.size(F.filter(table, lambda t: t <= F.greatest(F.lit(0), F.col(xp))))
    after = F.get(table, level)
    here = F.get(table, level - 1)
    progress = F.when(after.isNotNull(), F.floor((F.col(xp) - here) / (after - here) * 100 + 0.5).cast("int")).otherwise(100)
    return df.withColumns({"level": level, "next_xp": after, "missing": F.greatest(F.lit(0), after - F.col(xp)), "progress": progress})


def progression(df: DataFrame, per_encounter: int = 100) -> DataFrame:
    """Encounters needed to the next level."""
    return levels(df).withColumn("encounters", F.ceil(F.col("missing") / per_encounter))


QUERY_KINDS = [("comparacao", r"compar|versus|\bvs\b|melhor que"), ("recomendacao", r"recomend|qual.*(?:comprar|usar)|sugest"), ("encontro", r"encontro|desafio|monstros? para"), ("progressao", r"xp|experi[êe]ncia|n[íi]vel"), ("dados", r"\d+d\d*|dado"), ("regra", r"regra|como funciona|o que [ée]")]


#: Words for a difficulty, the first that is in the query counts: fixed values.
DIFFICULTY_WORDS = {"facil": ["facil", "fácil", "fraco"], "dificil": ["dificil", "difícil", "hard", "desafiador"], "mortal": ["mortal", "epico", "épico", "impossivel"]}


def query_mentions(queries: DataFrame, names: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(key, mentions): the distinct catalogue names in a query, in their order; queries without any have no row."""
    from .entities import link_mentions

    found = link_mentions(queries, names, key, text).where("name is not null")
    first = found.groupBy(key, "name").agg(F.min("place").alias("place"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("mentions"))  # of one query


def classify_queries(queries: DataFrame, kinds: list[tuple[str, str]] = QUERY_KINDS, default: str = "geral") -> DataFrame:
    """Add kind (the first rule that matches) and what a query names: level, budget, party, dice, strength, and a difficulty of ``DIFFICULTY_WORDS``."""
    text = F.lower("query")
    kind = F.lit(default)
    for name, pattern in reversed(kinds):
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
    number = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    difficulty = F.lit(None).cast("string")
    for name, words in reversed(DIFFICULTY_WORDS.items()):
        difficulty = F.when(text.rlike("|".join(words)), name).otherwise(difficulty)
    return queries.withColumns({"kind": kind, "strength": number(r"for[çc]a\s+(\d+)"), "difficulty": difficulty, "level": number(r"n[íi]vel (\d+)"), "budget": number(r"(\d+) ?(?:pe|pontos)"), "party": number(r"(\d+) (?:jogadores|personagens)"), "dice": F.nullif(F.regexp_extract(text, r"(\d+d\d*(?:[+-]\d+)?)", 1), F.lit(""))})


def catalog_view(df: DataFrame, kind: str | None = None, unique: bool = False, search: str = "", n: int = 50) -> DataFrame:
    """First rows (name, kind, unique, school, text) of a kind with a text over ten characters and a name that holds the search; a school "-" is null."""
    rows = df.where((F.length("text") > 10) & F.contains(fold(F.col("name")), fold(F.lit(search))))
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    rows = rows.where("unique") if unique else rows
    return rows.withColumn("school", F.nullif(F.trim("school"), F.lit("-"))).orderBy("name", "row_id").limit(n)


def kind_distribution(results: DataFrame, kind: str = "kind") -> DataFrame:
    return results.groupBy(kind).agg(F.count("*").alias("n"))
