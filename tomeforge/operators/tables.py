"""Tables found in pages: typed, validated, enriched, indexed and looked up."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import parse, rules
from .common import first_by, held_names

STATS = ["forca", "habilidade", "resistencia", "armadura", "pv", "pm"]


def header_name(header: Column, synonyms: dict[str, str] = rules.HEADERS) -> Column:
    """The column a header stands for: by its spelling without punctuation or the one without spaces too, else the lower-cased header."""
    known = F.create_map(*[F.lit(x) for spelling, column in synonyms.items() for x in (re.sub(r"[^\w\s]", "", spelling), column)])
    upper = F.upper(F.trim(F.regexp_replace(header, r"(?U)[^\w\s]", "")))
    return F.coalesce(known[upper], known[F.regexp_replace(upper, r"\s+", "")], F.nullif(F.lower(F.trim(header)), F.lit("")))


def table_kind(headers: Column, kinds: list[tuple[str, list[str], int]] = rules.TABLE_KINDS) -> Column:
    """The first kind enough of whose columns are among the headers."""
    upper = F.array_distinct(F.transform(headers, F.upper))
    found = F.lit("desconhecido")
    for kind, columns, least in reversed(kinds):
        overlap = F.size(F.array_intersect(upper, F.array(*map(F.lit, columns))))
        found = F.when(overlap >= least, F.lit(kind)).otherwise(found)
    return found


def rows_to_cells(tables: DataFrame) -> DataFrame:
    """(table_id, row_index, cells, raw_text) from ``headers`` and ``body`` (array of rows); empty rows go, tables without a body row too."""
    rows = tables.where(F.size("body") >= 1).select("table_id", "headers", F.posexplode("body").alias("row_index", "row"))
    rows = rows.where(F.exists("row", lambda x: F.trim(x) != ""))
    cells = F.map_filter(F.map_from_arrays("headers", F.transform("headers", lambda h, i: F.get(F.col("row"), i))), lambda k, v: k != "")
    return rows.select("table_id", "row_index", cells.alias("cells"), F.array_join("row", " | ").alias("raw_text"))


def clamp(column: str, ranges: dict[str, tuple[int, int]] = rules.RANGES) -> Column:
    low, high = ranges[column]
    return F.greatest(F.lit(low), F.least(F.lit(high), F.col(column)))


def power(df: DataFrame) -> Column:
    return F.col("forca") + F.col("habilidade") + F.col("resistencia") + F.expr("pv div 10")


def stats_rows(df: DataFrame) -> DataFrame:
    """Rows with a name and five stats, clamped; pm defaults to 0; ``poder_combate`` is derived."""
    needed = ["nome", "forca", "habilidade", "resistencia", "armadura", "pv"]
    kept = df.where(" and ".join(f"{c} is not null" for c in needed)).withColumn("pm", F.coalesce("pm", F.lit(0)))
    kept = kept.withColumns({c: clamp(c) for c in STATS})
    return kept.withColumn("poder_combate", power(kept))


def spell_rows(df: DataFrame) -> DataFrame:
    kept = df.where("nome <> ''")
    return kept.withColumns({"custo_pm": F.coalesce("custo_pm", F.lit(0)), "duracao": F.coalesce(F.nullif("duracao", F.lit("")), F.lit("Instantânea")), "alcance": F.coalesce(F.nullif("alcance", F.lit("")), F.lit("Toque"))})


def equipment_rows(df: DataFrame) -> DataFrame:
    """Rows with a name; the type is inferred as weapon from damage, as armour from defence."""
    given = F.coalesce(F.nullif("tipo", F.lit("")), F.lit("item"))
    kind = F.when(given != "item", given).when(F.col("dano") != "", "arma").when(F.col("defesa").isNotNull(), "armadura").otherwise("item")
    return df.where("nome <> ''").withColumn("tipo", kind)


def enrich_stats(df: DataFrame) -> DataFrame:
    p = F.col("poder_combate")
    return df.withColumns(
        {
            "iniciativa": F.col("habilidade"),
            "ataque_fisico": F.col("forca") + F.col("habilidade"),
            "dano_bonus": F.expr("forca div 2"),
            "resistencia_magia": F.col("resistencia"),
            "categoria_poder": F.when(p < 10, "Fraco").when(p < 30, "Médio").when(p < 60, "Forte").otherwise("Épico"),
            "xp_sugerido": p * 10,
        }
    )


def enrich_spells(df: DataFrame, words: list[str] = rules.COMBAT_WORDS) -> DataFrame:
    standard = F.when(F.col("circulo") > 0, F.col("custo_pm").between(F.col("circulo") * 2, F.col("circulo") * 5))
    return df.withColumns({"is_combate": F.coalesce(F.lower("descricao").rlike("|".join(words)), F.lit(False)), "custo_dentro_padrao": standard})


def enrich_equipment(df: DataFrame) -> DataFrame:
    """Mean damage and defence for each energy point (rounded to 2 digits) and the weight class of weapons."""
    mean = parse.dice_mean(F.col("dano"))
    paid = F.col("pe") > 0
    weight = F.coalesce(mean, F.lit(0.0))
    return df.withColumns(
        {
            "eficiencia_dano_pe": F.when(paid, F.rint(mean / F.col("pe") * 100) / 100),
            "eficiencia_defesa_pe": F.when(paid, F.rint(F.col("defesa") / F.col("pe") * 100) / 100),
            "categoria_poder": F.when((F.col("tipo") == "arma") & (F.col("dano") != ""), F.when(weight < 4, "Leve").when(weight < 7, "Média").otherwise("Pesada")),
        }
    )


def normalize_tables(rows: DataFrame) -> DataFrame:
    """(table_type, row fields as struct, ok): typed rows (cells map, table_type) normalised in one pass, rejected ones with ok false."""

    def cell(name: str) -> Column:
        return F.nullif(F.trim(F.col("cells")[name]), F.lit(""))

    typed = rows.withColumns({"nome": cell("nome"), "tipo": cell("tipo"), "dano": parse.norm_dice(cell("dano")), "descricao": cell("descricao"), "duracao": cell("duracao"), "alcance": cell("alcance")})
    typed = typed.withColumns({c: parse.first_int(cell(c), grouped=True) for c in [*STATS, "custo_pm", "circulo", "pe", "defesa", "bonus"]})
    needed = F.expr(" and ".join(f"{c} is not null" for c in ["forca", "habilidade", "resistencia", "armadura", "pv"]))
    ok = F.col("nome").isNotNull() & F.when(F.col("table_type") == "stats", needed).otherwise(F.col("table_type").isin("magias", "equipamentos"))
    return typed.withColumn("ok", ok)


def normalize_counts(rows: DataFrame) -> DataFrame:
    """Processed, normalised and rejected rows for each kind of table."""
    return rows.groupBy("table_type").agg(F.count("*").alias("processed"), F.count_if(F.col("ok")).alias("normalized"), F.count_if(~F.col("ok")).alias("rejected"))


def normalize_job(rows: DataFrame, path: str, kinds: tuple[str, ...] = ("stats", "magias", "equipamentos")) -> dict[str, int]:
    """Normalise and write rows below ``path``, rejected ones apart (``ok``); processed, normalized and rejected rows in all and by kind.

    The counters are observed while the rows are written: one job, one pass.
    """
    counted = {"processed": F.count("*"), "normalized": F.count_if("ok"), "rejected": F.count_if(~F.col("ok"))}
    for kind in kinds:
        own = F.col("table_type") == kind
        counted |= {f"{kind}_normalized": F.count_if(own & F.col("ok")), f"{kind}_rejected": F.count_if(own & ~F.col("ok"))}
    seen = Observation()
    watched = normalize_tables(rows).observe(seen, *[c.alias(name) for name, c in counted.items()])
    watched.write.partitionBy("ok", "table_type").parquet(path)
    return {name: seen.get[name] for name in counted}


def repeated_names(df: DataFrame) -> DataFrame:
    """(table_type, nome, repeat): one row for each repeat of a name inside a type."""
    place = F.row_number().over(Window.partitionBy("table_type", "nome").orderBy("row_id"))
    return df.withColumn("repeat", place).where("repeat > 1").select("table_type", "nome", "repeat", "row_id")


def costly_spells(df: DataFrame) -> DataFrame:
    return df.where("circulo > 0 and custo_pm > 10 * circulo")


def accept_tables(df: DataFrame, kinds: list[str], least_rows: int) -> DataFrame:
    return df.where(F.col("table_type").isin(*kinds) & (F.size("rows") >= least_rows))


def find_by_name(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(query, ...row, exact): rows whose lower-cased name equals the query; where none does, rows whose name holds it or is in it.

    The second step takes only queries without an exact row, and names that share a word.
    """
    keyed = rows.withColumn("key", F.lower("nome"))
    asked = names.select("query", F.lower("query").alias("key")).distinct()
    exact = asked.join(keyed, "key").withColumn("exact", F.lit(True))
    rest = asked.join(exact.select("query").distinct(), "query", "left_anti").withColumnRenamed("key", "asked")
    known = keyed.select("key").distinct()
    pairs = held_names(rest, "asked", known, "key").unionByName(held_names(known, "key", rest, "asked")).distinct()
    partial = rest.join(pairs, "asked").join(keyed, "key").drop("asked").distinct()
    return exact.unionByName(partial.withColumn("exact", F.lit(False)))


def find_by_type(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("table_type") == kind)


def find_by_range(df: DataFrame, **bounds: tuple[int | None, int | None]) -> DataFrame:
    """Rows within bounds; a missing value counts as 0 for a lower and as 999 for an upper bound."""
    for column, (low, high) in bounds.items():
        if low is not None:
            df = df.where(F.coalesce(F.col(column), F.lit(0)) >= low)
        if high is not None:
            df = df.where(F.coalesce(F.col(column), F.lit(999)) <= high)
    return df


def compare_stats(df: DataFrame, pairs: DataFrame, stats: list[str] = STATS, name: str = "nome") -> DataFrame:
    """(a, b, stat, value_a, value_b, difference, advantage): one row for each stat of each pair; advantage is 1, 2 or 0."""
    left = df.select(F.col(name).alias("a"), *[F.col(s).alias(f"a_{s}") for s in stats])
    right = df.select(F.col(name).alias("b"), *[F.col(s).alias(f"b_{s}") for s in stats])
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    rows = F.array(*[F.struct(F.lit(s).alias("stat"), F.coalesce(f"a_{s}", F.lit(0)).alias("value_a"), F.coalesce(f"b_{s}", F.lit(0)).alias("value_b")) for s in stats])
    rows = both.select("a", "b", F.inline(rows)).withColumn("difference", F.col("value_a") - F.col("value_b"))
    return rows.withColumn("advantage", F.when(F.col("difference") > 0, 1).when(F.col("difference") < 0, 2).otherwise(0))


def winners(compared: DataFrame) -> DataFrame:
    """(a, b, won_a, won_b, winner) by the number of stats won."""
    won = compared.groupBy("a", "b").agg(F.count_if(F.col("advantage") == 1).alias("won_a"), F.count_if(F.col("advantage") == 2).alias("won_b"))
    return won.withColumn("winner", F.when(F.col("won_a") > F.col("won_b"), F.col("a")).when(F.col("won_b") > F.col("won_a"), F.col("b")).otherwise("Empate"))


def row_text(df: DataFrame) -> Column:
    """A sentence for a typed row (table_type and its fields)."""

    def show(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("-"))

    stats = F.concat(F.lit("**"), show("nome"), F.lit("**: Força "), show("forca"), F.lit(", Habilidade "), show("habilidade"), F.lit(", Resistência "), show("resistencia"), F.lit(", Armadura "), show("armadura"), F.lit(", PV "), show("pv"), F.lit(", PM "), show("pm"), F.lit("."))
    spell = F.concat(F.lit("**"), show("nome"), F.lit("** (Círculo "), show("circulo"), F.lit(", "), show("custo_pm"), F.lit(" PM): Alcance "), show("alcance"), F.lit(", Duração "), show("duracao"), F.lit(". "), F.substring(F.coalesce("descricao", F.lit("")), 1, 200))
    item = F.concat(F.lit("**"), show("nome"), F.lit("** ("), F.coalesce("tipo", F.lit("Item")), F.lit("): Dano "), show("dano"), F.lit(", Defesa "), show("defesa"), F.lit(", PE "), show("pe"), F.lit(". "), F.substring(F.coalesce("descricao", F.lit("")), 1, 150))
    return F.when(F.col("table_type") == "stats", stats).when(F.col("table_type") == "magias", spell).otherwise(item)


def table_id(source: Column, page: Column, title: Column) -> Column:
    """Twelve hexadecimal digits of the md5 of source, page and title; a null title is written None."""
    return F.substring(F.md5(F.concat_ws("_", source, page.cast("string"), F.coalesce(title, F.lit("None")))), 1, 12)


def table_chunks(rows: DataFrame) -> DataFrame:
    """(id, content): one chunk for each row (table_id, row_index, raw_text) and one for each whole table."""
    single = rows.select(F.concat("table_id", F.lit("_row_"), F.col("row_index").cast("string")).alias("id"), F.col("raw_text").alias("content"))
    whole = rows.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row_index", "raw_text"))).alias("r"))
    return single.unionByName(whole.select(F.concat("table_id", F.lit("_full")).alias("id"), F.array_join(F.transform("r", lambda x: x["raw_text"]), "\n").alias("content")))


def table_index(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """(key, row_id): the inverted index as rows, which Spark can cluster by key; a key may hold any number of rows."""
    return df.select(key.alias("key"), F.col(row_id).alias("row_id"))


def table_stats(df: DataFrame) -> DataFrame:
    """Tables in total, by type and by source in one pass."""
    return df.groupingSets([["table_type"], ["source"], []], "table_type", "source").agg(F.count("*").alias("tables"))


def stat_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, nome, forca, habilidade, resistencia, armadura, pv) of lines like "Name 1 2 3 4 5"."""
    pattern = r"(?m)^\s*(\p{L}[\p{L} '-]{1,40}?)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*$"
    names = ["nome", *STATS[:5]]
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)])
    return df.select(key, F.inline(groups)).withColumns({c: F.col(c).cast("int") for c in STATS[:5]})


def table_title(page_lines: DataFrame, tables: DataFrame, above: int = 5) -> DataFrame:
    """(table_id, title): within five lines above a table's header, the nearest line in capitals or with "Tabela".

    ``page_lines`` has (doc_id, pos, line), ``tables`` (table_id, doc_id, header_pos).
    """
    near = tables.join(page_lines, "doc_id").where((F.col("pos") < F.col("header_pos")) & (F.col("pos") >= F.col("header_pos") - above))
    line = F.trim("line")
    titled = near.where(((line == F.upper(line)) & line.rlike(r"\p{L}")) | F.contains(line, F.lit("Tabela")))
    return first_by(titled, ["table_id"], F.col("pos")).select("table_id", line.alias("title"))


