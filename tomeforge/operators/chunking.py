"""Chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SECTION_PATTERN = r"(?imU)^\s*((?:capítulo|seção|parte|introdução|apêndice)\b[^\n]{0,80})$"


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line)."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def is_table_line(line: Column) -> Column:
    return F.contains(line, F.lit("|")) | (F.length(line) - F.length(F.replace(line, F.lit(";"), F.lit(""))) >= 2)


def group_table_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block, tabular, block_text): runs of tabular and of other lines, in order."""
    order = Window.partitionBy(key).orderBy("pos")
    marked = lines(df, key, text).withColumn("tabular", is_table_line(F.col("line")))
    starts = (F.col("tabular") != F.lag("tabular").over(order)).cast("int")
    marked = marked.withColumn("starts", F.coalesce(starts, F.lit(0))).withColumn("block", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = marked.groupBy(key, "block", "tabular").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return held.select(key, "block", "tabular", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block_text"))


def joined_blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the blocks of :func:`group_table_lines` with a blank line between them."""
    blocks = group_table_lines(df, key, text).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", "block_text"))).alias("b"))
    return blocks.select(key, F.array_join(F.transform("b", lambda x: x["block_text"]), "\n\n").alias(text))


def window_chunks(df: DataFrame, size: int = 1000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, chunk): windows of ``size`` characters every size - overlap, up to the one that reaches the end; blanks dropped."""
    step = max(1, size - overlap)
    n = F.length(text)
    starts = df.where(n > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("start"))
    kept = starts.where((F.col("start") == 0) | (F.col("start") - step + size < n))
    chunks = kept.select(key, "start", strip(F.substring(F.col(text), F.col("start") + 1, F.lit(size))).alias("chunk"))
    return chunks.where("chunk <> ''")


def split_recursively(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, packed greedily at the first separator that occurs."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next((s for s in separators if s and s in text), "")
    if not mark:
        return [x for k in range(0, len(text), size) if (x := text[k : k + size]).strip()]
    rest = separators[separators.index(mark) + 1 :]
    done, pack = [], ""
    for piece in text.split(mark):
        joined = f"{pack}{mark}{piece}" if pack else piece
        if len(joined) <= size:
            pack = joined
            continue
        if pack.strip():
            done.append(pack)
        pack = ""
        if len(piece) > size:
            done += split_recursively(piece, size, rest)
        else:
            pack = piece
    return [*done, pack] if pack.strip() else done


def stitch(pieces: list[str], size: int, overlap: int, truncate: bool = True) -> list[str]:
    """Start each piece with the end of the stitched piece before it, unless it does already."""
    done: list[str] = []
    for piece in pieces:
        tail = done[-1][-overlap:] if done and overlap else ""
        if tail and not piece.startswith(tail):
            piece = tail + piece
        done.append(piece[:size] if truncate else piece)
    return done


def recursive_chunks(df: DataFrame, size: int = 1000, overlap: int = 200, key: str = "doc_id", text: str = "text", truncate: bool = True) -> DataFrame:
    """(key, chunk_no, chunk). Packing is sequential inside a document, so it runs on batches of whole documents."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, c) for k, t in zip(batch[key], batch[text]) for n, c in enumerate(stitch(split_recursively(t or "", size), size, overlap, truncate))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(cut, f"`{key}` {kind}, chunk_no int, chunk string")


def infer_section(text: Column, given: Column, pattern: str = SECTION_PATTERN) -> Column:
    """The first heading line of a text, else the given section, else "Desconhecida"."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(text, pattern, 1)), F.lit("")), F.nullif(given, F.lit("")), F.lit("Desconhecida"))


def chunk_id(content: Column, source: Column, page: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", content, source, page.cast("string")), 256)


def chunk_documents(df: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Pages (source, page, text, section) to chunks with ids and inferred sections."""
    keyed = df.withColumn("doc_id", F.concat_ws("\x1f", "source", F.col("page").cast("string")))
    chunks = recursive_chunks(joined_blocks(keyed), size, overlap).withColumnRenamed("chunk", "content")
    rows = chunks.join(keyed.select("doc_id", "source", "page", "section"), "doc_id")
    return rows.select(chunk_id(F.col("content"), F.col("source"), F.col("page")).alias("chunk_id"), "content", "source", "page", "chunk_no", infer_section(F.col("content"), F.col("section")).alias("section"))


def table_rows_of_text(df: DataFrame, key: str = "doc_id", text: str = "text", numbers: int = 4) -> DataFrame:
    """(key, table_no, pos, cells, is_header): tables in plain text.

    A line of at least ``numbers`` integers opens a table, which takes the line before
    as its header and ends at a blank line or one without digits.
    """
    order = Window.partitionBy(key).orderBy("pos")
    dense = F.size(F.regexp_extract_all("line", F.lit(r"(?<!\S)-?\d+(?!\S)"), F.lit(0))) >= numbers
    body = F.trim("line") != F.lit("")
    marked = lines(df, key, text).withColumn("dense", dense).withColumn("body", body & F.col("line").rlike(r"\d"))
    # islands of body lines, of which those from the first dense line on are the table
    marked = marked.withColumn("island", F.sum((~F.col("body")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("open", F.col("body") & F.max("dense").over(inside))
    marked = marked.withColumn("head", ~F.col("open") & F.coalesce(F.lead("open").over(order), F.lit(False)) & body)
    kept = marked.where("open or head")
    previous = F.lag("pos").over(order)
    kept = kept.withColumn("new", (F.col("head") | previous.isNull() | (previous < F.col("pos") - 1)).cast("int"))
    kept = kept.withColumn("table_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(Window.partitionBy(key, "table_no").orderBy("pos")) == 1
    return kept.select(key, "table_no", "pos", F.split(F.trim("line"), r"\s{2,}|\t").alias("cells"), first.alias("is_header"))


def layout_chunks(pages: DataFrame, tables: DataFrame, size: int = 1000, overlap: int = 200, context: int = 300) -> DataFrame:
    """(source, page, kind, chunk_no, content): each located table with its context, and the text between tables packed.

    ``tables`` has (source, page, title, raw_text); a table whose text isn't on the page is a chunk without context.
    """
    both = tables.join(pages.select("source", "page", "text"), ["source", "page"])
    at = F.position(F.col("raw_text"), F.col("text"))
    before = F.when(at > 1, F.substring("text", F.greatest(F.lit(1), at - context), F.least(F.lit(context), at - 1))).otherwise("")
    after = F.when(at > 0, F.substring(F.col("text"), at + F.length("raw_text"), F.lit(context))).otherwise("")
    table_chunks = both.select("source", "page", F.lit("table").alias("kind"), F.row_number().over(Window.partitionBy("source", "page").orderBy(at, "raw_text")).alias("chunk_no"), F.concat(before, F.col("raw_text"), after).alias("content"))
    found = tables.groupBy("source", "page").agg(F.sort_array(F.collect_list("raw_text")).alias("found"))
    rest = pages.join(found, ["source", "page"], "left")
    rest = rest.select(F.concat_ws("\x1f", "source", F.col("page").cast("string")).alias("k"), "source", "page", F.aggregate(F.coalesce("found", F.array().cast("array<string>")), F.col("text"), lambda t, x: F.replace(t, x, F.lit("\n\n"))).alias("text"))
    text_chunks = recursive_chunks(rest, size, overlap, "k").join(rest.select("k", "source", "page"), "k")
    return table_chunks.unionByName(text_chunks.select("source", "page", F.lit("text").alias("kind"), "chunk_no", F.col("chunk").alias("content")))


def reassemble(chunks: DataFrame, pages: int = 1000) -> DataFrame:
    """(source, block, text): chunks (source, page, chunk_no, content) joined in page order, ``pages`` pages a block, so that no source is gathered whole."""
    parts = chunks.groupBy("source", F.expr(f"page div {pages}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("page", "chunk_no", "content"))).alias("p"))
    return parts.select("source", "block", F.array_join(F.transform("p", lambda x: x["content"]), "\n").alias("text"))


def entity_chunks(df: DataFrame, name: str, header: Column, full: Column) -> DataFrame:
    """(name, kind, content): one chunk for the name alone, one for its header and one for its full text; blanks dropped."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("content")) for kind, text in (("nome", F.col(name)), ("cabecalho", header), ("completo", full))])
    return df.select(F.col(name).alias("name"), F.explode(kinds).alias("c")).select("name", "c.*").where("trim(content) <> ''")


def chunks_by_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
