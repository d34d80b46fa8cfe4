"""Catalogues: blocks in text, indexes, reconciliation and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, garbage_share, occurrences, strip, tokens
from ..sources.io import scratch, written
from .common import contains_join, dropped_in_turn, first_by, held_names, prioritised, small


def blocks(pages: DataFrame, opener: str, fields: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, block, <fields>): text cut before every match of ``opener``; each field by the first group of its pattern, null if absent.

    Spell blocks, stat blocks and their other layouts are this one job with other patterns.
    """
    parts = pages.select(key, F.posexplode(F.split(text, f"(?={opener})")).alias("block_no", "block"))
    parts = parts.where(F.col("block").rlike(f"^(?:{opener})"))
    return parts.select(key, "block_no", strip(F.col("block")).alias("block"), *[F.nullif(F.trim(F.regexp_extract("block", p, 1)), F.lit("")).alias(n) for n, p in fields.items()])


SPELL_OPENER = r"(?m)^[^\n:]{3,60}\n\s*Escola:"
SPELL_FIELDS = {"nome": r"^([^\n]+)", "escola": r"Escola:\s*([^\n]+)", "custo": r"Custo:\s*([^\n]+)", "alcance": r"Alcance:\s*([^\n]+)", "duracao": r"Duração:\s*([^\n.;]+)"}
#: A digit as OCR reads it, and what parts stats.
_D = r"[\dOolIS]+"
_GAP = r"\s*(?:[,;]|\s)\s*"
STAT_LINE = r"(?m)^[^\n:]{3,50}:\s*F\d+,\s*H\d+,\s*R\d+,\s*A\d+,\s*PdF\d+(?:,\s*[^\n.]+)?"
STAT_FIELDS = {"nome": r"^([^\n:]+):", "forca": r"F(\d+)", "habilidade": r"H(\d+)", "resistencia": r"R(\d+)", "armadura": r",\s*A(\d+)", "pdf": r"PdF(\d+)", "habilidades": r"PdF\d+,\s*([^\n.]+)"}
#: Stats parted by commas, semicolons, spaces or line ends; the name is on a line before them.
LOOSE_STATS = rf"(?<![\p{{L}}\d])F\s*{_D}{_GAP}H\s*{_D}{_GAP}R\s*{_D}{_GAP}A\s*{_D}{_GAP}PdF\s*{_D}"
LOOSE_FIELDS = {"forca": rf"^F\s*({_D})", "habilidade": rf"[,;\s]H\s*({_D})", "resistencia": rf"[,;\s]R\s*({_D})", "armadura": rf"[,;\s]A\s*({_D})", "pdf": rf"PdF\s*({_D})"}
#: The other system's stats.
CON_STATS = rf"(?<![\p{{L}}\d])CON\s*{_D}{_GAP}FR\s*{_D}{_GAP}DEX\s*{_D}(?:{_GAP}(?:AGI|AG)\s*{_D})?"
CON_FIELDS = {"con": rf"CON\s*({_D})", "fr": rf"FR\s*({_D})", "dex": rf"DEX\s*({_D})", "agi": rf"(?:AGI|AG)\s*({_D})"}
#: Strict layouts first.
LAYOUTS = [(STAT_LINE, STAT_FIELDS), (LOOSE_STATS, LOOSE_FIELDS), (CON_STATS, CON_FIELDS)]
#: Lines that can be a name, and those that are attacks or other stats.
NAME_LINE, NO_NAME = r"^\p{L}[\p{L} '-]{2,49}$", r"(?iu)^(?:con |mordida|garras|pancada|pinça|asfixia|bicada|cauda|bico)"


def spell_blocks(pages: DataFrame) -> DataFrame:
    return blocks(pages, SPELL_OPENER, SPELL_FIELDS)


def matches(texts: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, match, gap): all matches of a pattern, left to right, with their offsets and the text since the one before."""
    cut, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = texts.select(key, F.posexplode(F.arrays_zip(F.slice(cut, F.lit(1), F.size(found)).alias("gap"), found.alias("match"))).alias("place", "x")).select(key, "place", "x.*")
    size = F.length("gap") + F.length("match")
    rows = rows.withColumn("end", F.sum(size).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.select(key, (F.col("end") - F.length("match")).alias("start"), "end", "match", "gap")


def uncovered(taken: DataFrame, more: DataFrame, key: str = "doc_id") -> DataFrame:
    """``taken`` and those of ``more`` that overlap none of it, by [start, end) inside a key; ``taken`` must not overlap itself."""
    rows = taken.withColumn("__taken", F.lit(True)).unionByName(more.withColumn("__taken", F.lit(False)), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("start")
    before = F.max(F.when(F.col("__taken"), F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("__taken"), F.col("start"))).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumns({"__before": before, "__after": after})
    free = (F.coalesce("__before", F.lit(0)) <= F.col("start")) & (F.coalesce("__after", F.col("end")) >= F.col("end"))
    return rows.where(F.col("__taken") | free).drop("__taken", "__before", "__after")


def page_offsets(pages: DataFrame, key: str = "doc_id", gap: int = 2) -> DataFrame:
    """(key, page, start): where each page begins in the text of all pages of its key, joined by ``gap`` characters."""
    before = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select(key, "page", F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0)).alias("start"))


def on_pages(rows: DataFrame, offsets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add the ``page`` that holds each row's ``start``: the last one that begins at or before it."""
    marks = offsets.select(key, "start", F.col("page").alias("__page"), F.lit(0).alias("__kind"))
    both = rows.withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    last = F.last("__page", ignorenulls=True).over(Window.partitionBy(key).orderBy("start", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("page", last).where("__kind = 1").drop("__page", "__kind")


def name_before(gap: Column, line: str = NAME_LINE, no_name: str = NO_NAME) -> Column:
    """The nearest line at the end of a text that can be a name; null if none can."""
    lines = F.transform(F.split(gap, r"\n"), lambda x: strip(x))
    return F.try_element_at(F.filter(lines, lambda x: x.rlike(line) & ~x.rlike(no_name)), F.lit(-1))


def stat_blocks(texts: DataFrame, layouts: list[tuple[str, dict[str, str]]] = LAYOUTS, offsets: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, start, end, layout, nome, <fields>, description[, page]): stat blocks by several layouts, strict ones first.

    A later layout takes only places that no earlier one covers. The name is a field of
    the match, or else the nearest line before it, since the block before, that can be
    one; blocks without a name of 3 to 50 characters, or of digits alone, are none. The
    first block of a name stays in each text, whatever the case; by layouts, then by
    place. Fields that a layout lacks are null, and letters that OCR reads for digits
    are mended in all but names and abilities. The description runs to the next block.
    ``offsets`` (key, page, start) of the pages in the texts give the page.
    """
    numbers = sorted({name for _, fields in layouts for name in fields} - {"nome", "habilidades"})
    names = list(dict.fromkeys(name for _, fields in layouts for name in fields))
    taken = None
    for i, (pattern, fields) in enumerate(layouts):
        found = matches(texts, pattern, key)
        nome = F.trim(F.regexp_extract("match", fields["nome"], 1)) if "nome" in fields else name_before(F.col("gap"))
        kinds = {name: F.nullif(F.trim(F.regexp_extract("match", p, 1)), F.lit("")) for name, p in fields.items()} | {"nome": nome}
        found = found.select(key, "start", "end", F.lit(i).alias("layout"), *[value.alias(name) for name, value in kinds.items()])
        taken = found if taken is None else uncovered(taken, found, key)
    rows = taken.where(F.length("nome").between(3, 50) & ~F.col("nome").rlike(r"^[\d\s-]+$"))
    rows = rows.withColumns({name: ocr_digits(F.col(name)) for name in numbers})
    rows = rows.withColumn("next", F.lead("start").over(Window.partitionBy(key).orderBy("start")))
    rows = first_by(rows.withColumn("low", F.lower("nome")), [key, "low"], F.col("layout"), F.col("start")).drop("low")
    if offsets is not None:
        rows = on_pages(rows, offsets, key)
    held = rows.groupBy(key).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias("b"))  # of one text
    rows = held.join(texts.select(key, "text"), key).select(key, F.explode(F.transform("b", lambda b: F.struct(b.alias("b"), strip(F.substring("text", b["end"] + 1, F.coalesce(b["next"], F.length("text").cast("long")) - b["end"])).alias("d")))).alias("x"))
    return rows.select(key, *[f"x.b.{c}" for c in ("start", "end", "layout", *(["nome"] if "nome" not in names else []), *names)], F.col("x.d").alias("description"), *(["x.b.page"] if offsets is not None else []))


#: Ranks that make a variant of a creature's name, and words that are no name: fixed values.
RANKS = "SOLDADO ARQUEIRO XAMÃ XAMAN CAPITÃO CAPITAO SARGENTO CHEFE CAVALEIRO GUERREIRO MAGO BRUXO LÍDER LIDER ELITE VETERANO RECRUTA".split()
NO_KIND = "de da do das dos e ou".split()
#: Stats anywhere in a text, as the loose layout writes them.
NEAR_FIELDS = {name: rf"(?<![\p{{L}}\d]){letter}\s*({_D})" for name, letter in (("forca", "F"), ("habilidade", "H"), ("resistencia", "R"), ("armadura", "A"), ("pdf", "PdF"))}


def variants(texts: DataFrame, blocks: DataFrame, ranks: list[str] = RANKS, fields: dict[str, str] = NEAR_FIELDS, key: str = "doc_id", before: int = 250, after: int = 500) -> DataFrame:
    """(key, start, nome, <fields>): variants of creatures that a text names by a rank and one or two words, whatever the case.

    Those with a block (key, nome) of their own go, as do ranks before function words;
    of a name in a text the first place counts. Stats are those of the surroundings,
    from ``before`` characters ahead of the name to ``after`` behind it; null if none are.
    """
    pattern = rf"(?iu)(?<![\p{{L}}\d])(?:{'|'.join(ranks)})\s+\p{{L}}[\p{{L}}-]+(?:\s+[\p{{L}}-]+)?(?![\p{{L}}\d])"
    parts = F.split(F.upper(F.trim("match")), r"\s+")
    found = matches(texts.select(key, "text"), pattern, key).where(~F.lower(parts[1]).isin(*NO_KIND)).select(key, "start", "end", F.array_join(parts, " ").alias("nome"))
    known = blocks.select(key, F.upper(F.regexp_replace(F.trim("nome"), r"\s+", " ")).alias("nome")).distinct()
    first = first_by(found.join(known, [key, "nome"], "left_anti"), [key, "nome"], F.col("start"))
    from_ = F.greatest(F.col("start") - before, F.lit(0))
    near = first.join(texts.select(key, "text"), key).select(key, "start", "nome", F.substring("text", from_ + 1, F.col("end") + after - from_).alias("near"))
    return near.select(key, "start", "nome", *[F.nullif(ocr_digits(F.regexp_extract("near", p, 1)), F.lit("")).alias(n) for n, p in fields.items()])


def ocr_digits(text: Column) -> Column:
    """Digits that OCR reads as letters."""
    return F.translate(text, "OolIS", "00115")


def reconcile(index: DataFrame, extracted: DataFrame) -> DataFrame:
    """(name, found, confidence, method): index names with an equal block (1.0), one whose name holds it or is in it (0.8), none (0.0); extracted names left over (0.9)."""
    i = index.select("name", F.lower("name").alias("k")).dropDuplicates(["k"])
    e = extracted.select(F.col("name").alias("found"), F.lower("name").alias("f")).dropDuplicates(["f"])
    equal = i.join(e, F.col("k") == F.col("f")).select("name", "found", F.lit(1.0).alias("confidence"), F.lit("delimitador").alias("method"))
    rest = i.join(equal.select("name"), "name", "left_anti")
    pairs = held_names(rest, "k", e, "f").unionByName(held_names(e, "f", rest, "k")).distinct()
    near = pairs.join(rest, "k").join(e, "f")
    partial = first_by(near, ["name"], F.desc(F.length("f")), F.col("f")).select("name", "found", F.lit(0.8).alias("confidence"), F.lit("delimitador_parcial").alias("method"))
    none = rest.join(partial.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("found"), F.lit(0.0).alias("confidence"), F.lit("indice_apenas").alias("method"))
    used = equal.select("found").unionByName(partial.select("found"))
    extra = e.join(used, "found", "left_anti").select(F.col("found").alias("name"), "found", F.lit(0.9).alias("confidence"), F.lit("extra").alias("method"))
    return reduce(DataFrame.unionByName, [equal, partial, none, extra])


def locate_names(index: DataFrame, docs: DataFrame, fuzzy: float = 0.75, longest: int = 4) -> DataFrame:
    """(name, doc_id, method, confidence): where a name occurs, by the best of: exactly, whatever the case, without accents, nearly (Levenshtein from a place with the same first two letters, names of up to ``longest`` words).

    Names are written, so that their size is known and few of them meet the texts in one
    pass; so is the best place of each name that stands in a text. Texts are read once for
    all names and once more for those that stand in none.
    """
    named = written(index.select("name").distinct())
    texts = docs.select("doc_id", "text")
    by_fold = contains_join(named.withColumn("f", fold(F.col("name"))), texts.withColumn("t", fold(F.col("text"))), "f", "t", "doc_id")
    level = F.when(F.contains("text", "name"), 1.0).when(F.contains(F.lower("text"), F.lower("name")), 0.9).otherwise(0.8)
    best = [F.desc("confidence"), F.col("doc_id")]
    found = written(first_by(by_fold.select("name", "doc_id", level.alias("confidence")), ["name"], *best))
    method = F.when(F.col("confidence") == 1.0, "exact").when(F.col("confidence") == 0.9, "case").when(F.col("confidence") == 0.8, "accent").otherwise("fuzzy")
    rest = named.join(found.select("name"), "name", "left_anti").select("name", fold(F.col("name")).alias("f"), tokens(fold(F.col("name"))).alias("nw")).where(F.size("nw").between(1, longest))
    wanted = [r.two for r in rest.select(F.substring("f", 1, 2).alias("two")).distinct().collect()]  # pairs of letters
    if wanted:
        spans = texts.select("doc_id", tokens(fold(F.col("text"))).alias("w"))
        starts = F.filter(F.transform("w", lambda x, i: F.when(F.substring(x, 1, 2).isin(*wanted), i)), lambda i: i.isNotNull())
        spans = spans.select("doc_id", F.explode(F.transform(starts, lambda i: F.struct(F.substring(F.get(F.col("w"), i), 1, 2).alias("two"), F.slice("w", i + 1, longest).alias("next")))).alias("s")).select("doc_id", "s.*")
        near = spans.join(small(rest.withColumn("two", F.substring("f", 1, 2))), "two")
        near = near.withColumn("span", F.array_join(F.slice("next", 1, F.size("nw")), " "))
        share = 1 - F.levenshtein("span", "f") / F.greatest(F.length("span"), F.length("f"))
        hits = near.select("name", "doc_id", F.round(share * 0.8, 6).alias("confidence")).where(F.col("confidence") >= fuzzy * 0.8)
        found = found.unionByName(first_by(hits, ["name"], *best))
    return found.select("name", "doc_id", method.alias("method"), "confidence")


#: Fields of an entry, as written and as OCR reads them; these words are those of the books and fixed.
_SCHOOL, _COST, _TIME = r"(?:Escola|Ex[i!1l]g[eê6]n[cç][ilu1]a?s?)", r"(?:Custo|Custa|Cu1to|Culto)", r"(?:Dura[çc][ãa]o|Our[1l]{1,2}[Çc]io|Dunçio|Duraçlo|Our19Ao)"
_HEAD = rf"(?:{_SCHOOL}|{_COST}):"
ENTRY_FIELDS = {
    "escola": rf"(?iu){_SCHOOL}:\s*([^.\n]+)",
    "custo": rf"(?iu){_COST}[:.]\s*([^.\n]+)",
    "alcance": r"(?iu)(?:Alcance|A1CanC11|Alcanct|Alcara):\s*([^;.\n]+)",
    "duracao": rf"(?iu){_TIME}:\s*([^.\n]+)",
    "descricao": rf"(?isu){_TIME}:[^.\n]+(.*?)(?=\n\s*[\p{{L}}][\p{{L}}\s'-]{{4,50}}\s*\n\s*{_HEAD}|\z)",
}
INDICATOR, HEADING = rf"(?iu){_HEAD}", rf"(?iu)([\p{{L}}][\p{{L}} '-]{{3,50}}?)\s*\n\s*{_HEAD}"
BEFORE, AFTER, NEAR = 100, 2500, 300
#: Books of a name that are looked at first.
FIRST_BOOKS = 8


def entry_at(text: Column, at: Column, fields: dict[str, str]) -> Column:
    """(at, confidence, <fields>) of the entry whose name stands at an offset: the share of the fields that its surroundings fill."""
    first = F.greatest(at - BEFORE, F.lit(0))
    near = F.substring(text, first + 1, at + AFTER - first)
    values = {name: F.nullif(strip(F.regexp_extract(near, p, 1)), F.lit("")) for name, p in fields.items()}
    filled = sum((v.isNotNull().cast("int") for v in values.values()), F.lit(0))
    return F.struct(at.alias("at"), (filled / len(fields)).alias("confidence"), *[v.alias(n) for n, v in values.items()])


def best_entry(text: Column, places: Column, fields: dict[str, str], floor: float, enough: float) -> Column:
    """Of the entries at some offsets the first that is sure enough, or else the surest one above the floor, or else null."""
    entries = F.transform(places, lambda at: entry_at(text, at, fields))
    sure = F.get(F.filter(entries, lambda e: e["confidence"] >= enough), F.lit(0))
    ranked = F.array_sort(F.transform(F.filter(entries, lambda e: e["confidence"] > floor), lambda e: F.struct((-e["confidence"]).alias("c"), e["at"].alias("a"), e.alias("e"))))
    return F.coalesce(sure, F.get(ranked, F.lit(0))["e"])


def places_of(text: Column, name: Column, most: int) -> Column:
    """Offsets of the first occurrences of a name, at most ``most``, left to right without overlaps."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), most + 1)
    sizes = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g: F.length(g))
    return F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, y: a + y) + i * F.length(name))


def locate_entries(index: DataFrame, books: DataFrame, fields: dict[str, str] = ENTRY_FIELDS, order: str = "doc_id", floor: float = 0.3, enough: float = 0.8, fuzzy: float = 0.75, most: int = 15) -> DataFrame:
    """(name, doc_id, method, at, confidence, <fields>): the entry of each index name in the first book, by ``order``, that has one above the floor; method "missing" without one.

    In each book the first of these steps that finds an entry decides: the name as it
    is, whatever the case, without accents (of its first ``most`` places the surest, or
    the first that is sure enough); its first word, of four letters or more, where one
    of the indicators follows within 300 characters; the heading of an entry that is
    nearly the name (1 - Levenshtein distance / longer length of ``fuzzy`` or more, and a
    word or the first two letters in common). Confidence is the share of the fields
    found. A step passes over books behind the one that an earlier step has settled on.
    """
    spark = index.sparkSession
    named = index.select("name").where("trim(name) <> ''").distinct()
    books = books.select("doc_id", F.col(order).alias("turn"), "text").where("text is not null")
    kinds = [F.col("name"), F.lower("name"), fold(F.col("name"))]
    texts = [F.col("text"), F.lower("text"), fold(F.col("text"))]
    with scratch(spark) as keep:
        held = contains_join(named.withColumn("f", fold(F.col("name"))), books.withColumn("t", fold(F.col("text"))), "f", "t", "doc_id")
        held = keep(held.select("name", "doc_id", "turn"))
        tried = [F.when(F.contains(t, n), best_entry(F.col("text"), places_of(t, n, most), fields, floor, enough)) for t, n in zip(texts, kinds)]
        method = F.coalesce(*[F.when(e.isNotNull(), F.lit(m)) for e, m in zip(tried, ("exact", "case", "accent"))])

        def entries(pairs: DataFrame) -> DataFrame:
            rows = pairs.join(books.select("doc_id", "text"), "doc_id")
            return keep(rows.select("name", "doc_id", "turn", method.alias("method"), F.coalesce(*tried).alias("entry")).where("entry is not null"))

        def settled_names(found: DataFrame) -> DataFrame:
            """Names with the book that they are settled on."""
            settled = found.where(F.col("entry.confidence") > floor).groupBy("name").agg(F.min("turn").alias("settled"))
            return keep(named.join(settled, "name", "left"))

        def open_books(settled: DataFrame) -> DataFrame:
            """Books before the last one that a name is settled on; all while a name has none."""
            bound = settled.agg(F.count_if(F.col("settled").isNull()).alias("open"), F.max("settled").alias("last")).first()
            return books if bound.open else books.where(F.col("turn") < F.lit(bound.last))

        before = F.col("settled").isNull() | (F.col("turn") < F.col("settled"))
        # the first books of each name settle most; others are looked at for names that these leave open
        early = keep(first_by(held, ["name"], F.col("turn"), F.col("doc_id"), n=FIRST_BOOKS))
        found = entries(early)
        still = settled_names(found).where("settled is null").select("name")
        found = found.unionByName(entries(held.join(still, "name", "left_semi").join(early, ["name", "doc_id"], "left_anti")))
        known = settled_names(found)
        ahead = open_books(known)

        def without_own(pairs: DataFrame) -> DataFrame:
            return pairs.join(found.select("name", "doc_id"), ["name", "doc_id"], "left_anti")

        marks = matches(ahead, INDICATOR).select("doc_id", "end")
        marks = marks.join(ahead, "doc_id").withColumn("first", F.greatest(F.col("end") - NEAR, F.lit(0)))
        windows = keep(marks.select("doc_id", "turn", "first", F.substring("text", F.col("first") + 1, F.col("end") - F.col("first")).alias("window")))
        first_word = F.get(F.split(F.trim("name"), r"\s+"), F.lit(0))
        headed = known.withColumn("w", F.lower(first_word)).where("length(w) > 3")
        keys = windows.select("doc_id", "turn", "first", F.explode(F.array_distinct(tokens(F.col("window")))).alias("w"))
        near = keys.join(headed.select("name", "settled", F.get(tokens(F.col("w")), F.lit(0)).alias("w"), first_word.alias("word")), "w").where(before).drop("w", "settled", "turn")
        near = without_own(near.join(windows, ["doc_id", "first"]))
        spot = F.regexp_instr("window", F.concat(F.lit("(?iuU)(?<!\\w)\\Q"), F.col("word"), F.lit("\\E(?!\\w)")))
        near = near.withColumn("spot", spot).where("spot > 0").groupBy("name", "doc_id", "turn").agg(F.min(F.col("first") + F.col("spot") - 1).alias("at"))
        near = near.join(books.select("doc_id", "text"), "doc_id").select("name", "doc_id", "turn", F.lit("first word").alias("method"), entry_at(F.col("text"), F.col("at"), fields).alias("entry"))
        found = keep(found.unionByName(near))
        known = settled_names(found)

        heads = open_books(known).select("doc_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(HEADING), F.lit(1)))).alias("head"))
        heads = heads.select("doc_id", "turn", strip(F.col("head")).alias("head")).where("length(head) >= 4").distinct()

        def keyed(df: DataFrame, column: str) -> DataFrame:
            folded = fold(F.col(column))
            return df.withColumn("w", F.explode(F.array_distinct(F.concat(tokens(folded), F.array(F.concat(F.lit("^"), F.substring(folded, 1, 2)))))))

        close = keyed(known, "name").join(keyed(heads, "head"), "w").where(before).drop("w", "settled").distinct()
        share = 1 - F.levenshtein("name", "head") / F.greatest(F.length("name"), F.length("head"))
        close = first_by(without_own(close.withColumn("share", share).where(F.col("share") >= fuzzy)), ["name", "doc_id"], F.desc("share"), F.col("head"))
        close = close.join(books.select("doc_id", "text"), "doc_id").withColumn("at", F.instr("text", F.col("head")) - 1)
        close = close.select("name", "doc_id", "turn", F.lit("fuzzy").alias("method"), entry_at(F.col("text"), F.col("at"), fields).alias("entry"))
        best = first_by(found.unionByName(close).where(F.col("entry.confidence") > floor), ["name"], F.col("turn"), F.col("doc_id"))
        rows = named.join(best, "name", "left").select("name", "doc_id", F.coalesce("method", F.lit("missing")).alias("method"), "entry.*")
        return written(rows)


def cascade_merge(strategies: list[DataFrame], order: str | None = None) -> DataFrame:
    """Rows (name, …) of strategies in order, those of one by ``order`` or else by name; a row goes if the names kept so far have one equal to it, holding it or inside it.

    All of the first strategy stays, equal names once. Names are compared without
    accents, case and hyphens, and only if they share a word. The result is that of one
    pass in order, chains included.
    """
    rows = reduce(DataFrame.unionByName, [df.withColumn("priority", F.lit(i)) for i, df in enumerate(strategies)])
    place = F.struct("priority", *[F.col(c) for c in ([order] if order else []) + ["name"]])
    rows = first_by(rows.withColumns({"k": F.regexp_replace(fold(F.trim("name")), "[- ]+", " "), "place": place}), ["k"], F.col("place"))
    keys = rows.select("k", "place")
    pairs = held_names(keys.withColumnRenamed("k", "a"), "a", keys.withColumnRenamed("k", "b"), "b").where("a <> b")
    placed = pairs.join(keys.select(F.col("k").alias("a"), F.col("place").alias("p")), "a").join(keys.select(F.col("k").alias("b"), F.col("place").alias("q")), "b")
    early = placed.select(F.when(F.col("p") < F.col("q"), F.col("a")).otherwise(F.col("b")).alias("early"), F.when(F.col("p") < F.col("q"), F.col("b")).otherwise(F.col("a")).alias("late"), F.greatest("p", "q")["priority"].alias("turn"))
    gone = dropped_in_turn(early.where("turn > 0"))
    return rows.join(gone.withColumnRenamed("late", "k"), "k", "left_anti").drop("k", "place")


def fill_stats(df: DataFrame, *others: DataFrame, key: str = "nome", fields: list[str]) -> DataFrame:
    """Fields that are null, empty or "0" are filled from the other tables in order, by folded name."""
    out = df.withColumn("__k", fold(F.col(key)))
    for i, other in enumerate(others):
        given = first_by(other.select(fold(F.col(key)).alias("__k"), *[F.col(f).alias(f"__{i}_{f}") for f in fields]), ["__k"], *[F.col(f"__{i}_{f}") for f in fields])
        out = out.join(given, "__k", "left")
        out = out.withColumns({f: F.coalesce(F.when(F.col(f).cast("string").isin("", "0"), None).otherwise(F.col(f)), F.col(f"__{i}_{f}"), F.col(f)) for f in fields}).drop(*[f"__{i}_{f}" for f in fields])
    return out.drop("__k")


def extract_index(chunks: DataFrame, pattern: str = r"([\p{L}][\p{L}\p{N}' -]{2,50}) \(([A-Z0-9&]{2,8}), pg?\.? ?(\d+)\)", text: str = "text") -> DataFrame:
    """(name, source, page): entries "Name (BOOK, p. N)"; the first of a name."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "source"), (3, "page"))])
    rows = chunks.select(F.inline(parts)).select(F.trim("name").alias("name"), "source", F.col("page").cast("int").alias("page"))
    return first_by(rows, ["name"], F.col("page"), F.col("source"))


def categorize(items: DataFrame, taxonomy: list[tuple[str, str, str]], default: str = "diverso", name: str = "name") -> DataFrame:
    """Add category: regex rules of all categories first, then prefixes, then explicit names, in the taxonomy's order of (category, kind, value)."""
    category = F.lit(default)
    for kind in ("name", "prefix", "regex"):
        for label, of, value in reversed(taxonomy):
            if of == kind:
                folded = fold(F.col(name))
                hit = folded.rlike(value) if kind == "regex" else folded.startswith(value) if kind == "prefix" else folded == value
                category = F.when(hit, F.lit(label)).otherwise(category)
    return items.withColumn("category", category)


def drop_fragment_names(df: DataFrame, blocked: DataFrame, patterns: list[str], least: int = 3, most: int = 60, name: str = "name") -> DataFrame:
    """Names that are too short or long, cut off, sentence-like or blocked go."""
    bad = (F.length(name) < least) | (F.length(name) > most) | F.col(name).rlike(r"(?:[,;:-]|\s(?:de|do|da|e|ou))$")
    for p in patterns:
        bad = bad | F.col(name).rlike(p)
    return df.where(~bad).join(small(blocked.select(F.lower("name").alias("__b"))), F.lower(name) == F.col("__b"), "left_anti")


def best_record(df: DataFrame, favoured: list[str], name: str = "name", source: str = "source", text: str = "text", row_id: str = "row_id") -> DataFrame:
    """One record a name: from a favoured source, then with a text, then the longest text."""
    return first_by(df, [name], F.desc(F.col(source).isin(*favoured)), F.desc(F.length(F.coalesce(text, F.lit(""))) > 0), F.desc(F.length(text)), F.col(row_id))


def merge_items(categorised: DataFrame, extracted: DataFrame, prices: DataFrame, canonical: DataFrame) -> DataFrame:
    """(name, category, price, text): categorised items, extracted ones not among them, prices overridden, texts replaced by longer canonical ones."""
    key = lambda df: df.withColumn("__k", fold(F.col("name")))
    rows = prioritised([key(categorised.select("name", "category", "price", "text")), key(extracted.select("name", F.lit("extraido").alias("category"), "price", "text"))], ["__k"], F.col("name")).drop("priority")
    price = first_by(key(prices).select("__k", F.col("price").alias("__p")), ["__k"], F.col("__p"))
    text = first_by(key(canonical).select("__k", F.col("text").alias("__t")), ["__k"], F.desc(F.length("__t")), F.col("__t"))
    out = rows.join(price, "__k", "left").join(text, "__k", "left")
    longer = F.length(F.coalesce("__t", F.lit(""))) > F.length(F.coalesce("text", F.lit("")))
    return out.select("name", "category", F.coalesce("__p", "price").alias("price"), F.when(longer, F.col("__t")).otherwise(F.col("text")).alias("text"))


def source_priority(source: Column, policy: list[str]) -> Column:
    """Place of a source in an ordered policy, equal or holding a policy's name; 999 if none."""
    lowered = F.lower(source)
    place = F.lit(999)
    for i, entry in reversed(list(enumerate(policy))):
        place = F.when(F.contains(lowered, F.lit(entry.lower())), F.lit(i)).otherwise(place)
    exact = F.lit(None).cast("int")
    for i, entry in reversed(list(enumerate(policy))):
        exact = F.when(lowered == entry.lower(), F.lit(i)).otherwise(exact)
    return F.coalesce(exact, place)


def ability_index(monsters: DataFrame, effects: list[DataFrame]) -> DataFrame:
    """(ability, monster, effect): abilities (array) of monsters by base name, with the effect of the first table (name, effect) that has it; one row each pair."""
    base = F.lower(F.trim(F.regexp_extract("a", r"^([^(]+)", 1)))
    pairs = monsters.select("monster", F.explode("abilities").alias("a")).select("monster", base.alias("ability")).where(F.length("ability") > 2).distinct()
    known = prioritised([df.select(F.lower("name").alias("ability"), "effect") for df in effects], ["ability"], F.col("effect")).drop("priority")
    return pairs.join(known, "ability", "left").select("ability", "monster", "effect")


COMBAT_RULES = [("veneno", r"(?i)(veneno[^.]{0,60})"), ("imunidade", r"(?i)(imun[ea]\w*[^.]{0,60})"), ("vulneravel", r"(?i)(vulner[áa]ve\w*[^.]{0,60})"), ("constricao", r"(?i)(constri[çc][ãa]o[^.]{0,60})"), ("teste", r"(?i)(teste de [RHF][^.]{0,60})")]


def combat_abilities(df: DataFrame, rules: list[tuple[str, str]] = COMBAT_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, details): facts by patterns, one for each kind and first fifty characters of the details."""
    facts = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract(text, p, 1).alias("details")) for k, p in rules]), lambda x: x["details"] != "")
    return df.select(key, F.inline(facts)).withColumn("h", F.substring("details", 1, 50)).dropDuplicates([key, "kind", "h"]).drop("h")


def enrich_descriptions(df: DataFrame, fields: dict[str, str], overriding: list[str] = (), text: str = "text") -> DataFrame:
    """Fill fields from text by patterns, empty ones only; ``overriding`` fields take the text's value first."""
    found = {f: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for f, p in fields.items()}
    given = {f: F.nullif(F.col(f), F.lit("")) if f in df.columns else F.lit(None).cast("string") for f in fields}
    return df.withColumns({f: F.coalesce(found[f], given[f]) if f in overriding else F.coalesce(given[f], found[f]) for f in fields})


def apply_overrides(df: DataFrame, full: DataFrame, partial: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Curated full rows first, then curated partial ones field by field, then the row itself."""
    out = df
    for tag, other in (("__full", full), ("__part", partial)):
        out = out.join(other.select(F.col(key), *[F.col(f).alias(f"{tag}_{f}") for f in fields], F.lit(True).alias(tag)), key, "left")
    chosen = {f: F.when(F.col("__full"), F.col(f"__full_{f}")).otherwise(F.coalesce(f"__part_{f}", f)) for f in fields}
    return out.withColumns(chosen).select(df.columns)


def dedup_first(df: DataFrame, name: str, book: str, order: str) -> DataFrame:
    return first_by(df.withColumn("__b", F.lower(book)), [name, "__b"], F.col(order)).drop("__b")


def text_after_name(names: DataFrame, docs: DataFrame, marker: str = r"\n\s*\n", most: int = 1500, least: int = 30) -> DataFrame:
    """(name, doc_id, description): the text after a name, to the next marker or ``most`` characters, if long enough."""
    both = contains_join(names.select("name"), docs.select("doc_id", "text"), "name", "text", "doc_id")
    after = F.substring(F.col("text"), F.position(F.lower("name"), F.lower("text")) + F.length("name"), F.lit(most))
    return both.select("name", "doc_id", strip(F.split(after, marker, 2)[0]).alias("description")).where(F.length("description") >= least)


def classify_type(df: DataFrame, lists: dict[str, list[str]], default: str = "outro", name: str = "name") -> DataFrame:
    kind = F.lit(default)
    for label, names in reversed(list(lists.items())):
        kind = F.when(F.lower(name).isin(*[n.lower() for n in names]), F.lit(label)).otherwise(kind)
    return df.withColumn("type", kind)


def consolidate(df: DataFrame, kind: str, title: str, parts: list[str]) -> DataFrame:
    """(kind, title, content): canonical records as index rows."""
    return df.select(F.lit(kind).alias("kind"), F.col(title).alias("title"), F.concat_ws("\n", title, *parts).alias("content"))


def merge_advantages(a: DataFrame, b: DataFrame, policy: list[str]) -> DataFrame:
    """Two lists (name, source, …) by lower-cased name: the source of higher priority, ties to the first list."""
    rows = a.withColumn("__list", F.lit(0)).unionByName(b.withColumn("__list", F.lit(1)))
    rows = rows.withColumn("__k", F.lower("name")).withColumn("__p", source_priority(F.col("source"), policy))
    return first_by(rows, ["__k"], F.col("__p"), F.col("__list"), F.col("source"), F.col("name")).drop("__k", "__p", "__list")


def publish(df: DataFrame, path: str, condition: Column) -> None:
    df.where(condition).write.mode("overwrite").parquet(path)


def discover_items(pages: DataFrame, openers: list[str], blocked: list[str], gate: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(name, doc_id): names by opener patterns in order, 4 to 55 characters, not blocked, from pages that pass the OCR gate; the first of each."""
    clean = pages.where(garbage_share(F.col(text)) <= gate)
    found = [clean.select(key, F.explode(F.regexp_extract_all(text, F.lit(p), F.lit(1))).alias("name")).select(key, F.trim("name").alias("name")) for p in openers]
    kept = [df.where(F.length("name").between(4, 55) & ~F.lower("name").isin(*[x.lower() for x in blocked] or [""])).withColumn("k", F.lower("name")) for df in found]
    return prioritised(kept, ["k"], F.col(key), F.col("name")).select("name", key)


def item_fields(df: DataFrame, text: str = "text", foreign: str = r"(?i)\b(?:the|and|with)\b") -> DataFrame:
    """Add price (labelled first, then any currency) and whether the effect is plausible (20 to 1500 characters, no foreign words)."""
    labelled = F.regexp_extract(text, r"(?i)(?:pre[çc]o|custo):?\s*(\d+)", 1).try_cast("int")
    currency = F.regexp_extract(text, r"(\d+)\s*(?:PEs?|T\$|moedas)", 1).try_cast("int")
    return df.withColumns({"price": F.coalesce(labelled, currency), "plausible": F.length(text).between(20, 1500) & ~F.col(text).rlike(foreign)})


def term_counts(df: DataFrame, terms: list[str], source: str = "source", text: str = "text") -> DataFrame:
    """(source, term, n) of indicator terms that occur."""
    rows = df.select(source, F.inline(F.array(*[F.struct(F.lit(t).alias("term"), occurrences(F.col(text), t).alias("n")) for t in terms])))
    return rows.groupBy(source, "term").agg(F.sum("n").alias("n")).where("n > 0")


def map_titles(df: DataFrame, mapping: DataFrame, column: str, out: str = "title") -> DataFrame:
    """Add the controlled title of ``column`` by ``mapping`` (spelling, title): exactly, else whatever the case, else unchanged; null and blank become empty."""
    exact = mapping.select(F.col("spelling").alias("__e"), F.col("title").alias("__et")).dropDuplicates(["__e"])
    loose = first_by(mapping.select(F.lower(F.trim("spelling")).alias("__l"), F.col("title").alias("__lt"), "spelling"), ["__l"], F.col("spelling")).drop("spelling")
    given = F.trim(F.col(f"`{column}`"))
    both = df.join(small(exact), given == F.col("__e"), "left").join(small(loose), F.lower(given) == F.col("__l"), "left")
    return both.withColumn(out, F.coalesce("__et", "__lt", given, F.lit(""))).drop("__e", "__et", "__l", "__lt")
