"""Queries over page and document text: cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import chunking
from ..operators.catalog import map_titles
from ..sources import io
from .binding import Registry, table

R = Registry()
NOISE = [("%%%", " "), (r"\*\*\*", " "), ("&&&", " and "), ("###", ""), (r"[ ]{2,}", " ")]
TERMS = ["the", "le ", "der", "que"]
MAPPING = {"src0": "Source Zero", "SRC1": "Source One"}


@R.add(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '(?m)[ \t]+$', '', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents""")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@R.add(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '%%%', ' ', 'g'), '\*\*\*', ' ', 'g'), '&&&', ' and ', 'g'), '###', '', 'g'), '[ ]{2,}', ' ', 'g') AS repaired FROM documents""")
def ocr_repair(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.repair_ocr(F.col("text"), NOISE).alias("repaired"))


@R.add(r"""SELECT sum(CAST(contains(text, '%%%') AS INT)) AS percent, sum(CAST(contains(text, '***') AS INT)) AS stars, sum(CAST(contains(text, '&&&') AS INT)) AS ands, sum(CAST(contains(text, '###') AS INT)) AS hashes FROM documents""")
def ocr_rule_hits(spark, sf):
    names = ["percent", "stars", "ands", "hashes"]
    return table(spark, sf, "documents").agg(*[F.sum(F.col("text").rlike(p).cast("int")).alias(n) for n, (p, _) in zip(names, NOISE)])


@R.add(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\s+', '\1', 'g'), ' +', ' ', 'g'), '([.!?,;:])([A-Za-zÀ-ÿ])', '\1 \2', 'g'), ' +([.,;:!?])', '\1', 'g'), '^\s+|\s+$', '', 'g') AS readable FROM documents""")
def readable_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.make_readable(F.col("text")).alias("readable"))


@R.add(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '%%%', ' ', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS shown FROM documents""")
def sanitized_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sanitize(F.col("text"), NOISE[:1]).alias("shown"))


def _displayed() -> str:
    """The fixes of displayed texts as SQL, around texts that hold what they mend."""
    text = "'F3-1 5, li F2; # aques fll 10°10 .  PE R ' || replace(coalesce(text, ''), 'a', ' ,')"
    for pattern, to in [(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"[ \t]{2,}", " "), *rules.DISPLAY_FIXES, (r"^\s+|\s+$", "")]:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), to.replace("$", "\\"))
    return f"SELECT doc_id, {text} AS shown FROM documents"


@R.add(_displayed())
def displayed_text(spark, sf):
    text = F.concat(F.lit("F3-1 5, li F2; # aques fll 10°10 .  PE R "), F.replace(F.coalesce("text", F.lit("")), F.lit("a"), F.lit(" ,")))
    return table(spark, sf, "documents").select("doc_id", T.sanitize(text, fixes=rules.DISPLAY_FIXES).alias("shown"))


@R.add(r"""SELECT doc_id, translate(lower(text), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy') AS folded,
  regexp_replace(regexp_replace(translate(lower(text), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents""")
def folded_slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"), T.slug(F.col("text")).alias("slug"))


@R.add("SELECT source, CASE lower(trim(source)) WHEN 'src0' THEN 'Source Zero' WHEN 'src1' THEN 'Source One' ELSE coalesce(source, '') END AS title, count(*) AS documents FROM documents GROUP BY 1, 2")
def mapped_titles(spark, sf):
    mapping = spark.createDataFrame(list(MAPPING.items()), "spelling string, title string")
    return map_titles(table(spark, sf, "documents"), mapping, "source").groupBy("source", "title").agg(F.count("*").alias("documents"))


@R.add(r"""SELECT t AS token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents) GROUP BY 1""")
def token_counts(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    each = words.groupBy("token", "doc_id").agg(F.count("*").alias("k"))
    return each.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("documents"))


@R.add("""SELECT source, CAST(sum((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3) AS BIGINT) AS the, CAST(sum((length(lower(text)) - length(replace(lower(text), 'le ', ''))) // 3) AS BIGINT) AS le,
  CAST(sum((length(lower(text)) - length(replace(lower(text), 'der', ''))) // 3) AS BIGINT) AS der, CAST(sum((length(lower(text)) - length(replace(lower(text), 'que', ''))) // 3) AS BIGINT) AS que FROM documents GROUP BY source""")
def term_frequency_probe(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(*[F.sum(T.occurrences(F.col("text"), t)).alias(t.strip()) for t in TERMS])


@R.add(r"""SELECT doc_id, round((length(text) - length(regexp_replace(text, '[^\p{L}\p{N}\s.,;:!?()''"-]', '', 'g'))) / length(text), 6) AS garbage FROM documents WHERE length(text) > 0 AND (length(text) - length(regexp_replace(text, '[^\p{L}\p{N}\s.,;:!?()''"-]', '', 'g'))) / length(text) > 0.1""")
def ocr_quality_gate(spark, sf):
    share = T.garbage_share(F.col("text"))
    return table(spark, sf, "documents").where(share > 0.1).select("doc_id", F.round(share, 6).alias("garbage"))


@R.add()
def acronym_expansion(spark, sf):
    expanded = T.expand_acronyms(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", expanded.alias("expanded"), (~T.has_acronyms(expanded)).alias("stable"))


@R.add()
def relevant_text(spark, sf):
    """The named sections and matching sentences of every document."""
    d = F.concat(F.coalesce("text", F.lit("")), F.lit(" Combate: o ataque causa dano. Magias: nenhuma."))
    return table(spark, sf, "documents").select("doc_id", T.relevant_text(d, r"tion|ment\b|ataque", ["Combate", "Magias?"]).alias("relevant"))


@R.add(r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(text, '%%%', ' ', 'g'), '###', '', 'g') AS t, source FROM documents),
m AS (SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])-\s+', '\1', 'g'), ' +', ' ', 'g'), '([.!?,;:])([A-Za-zÀ-ÿ])', '\1 \2', 'g'), ' +([.,;:!?])', '\1', 'g'), '^\s+|\s+$', '', 'g'), '') AS text, source FROM r)
SELECT doc_id, text, CASE WHEN source IS NULL THEN '' ELSE source END AS names FROM m""")
def normalized_fields(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.array("source", F.lit(" ")).alias("names"))
    return T.normalize_fields(rows, [("%%%", " "), ("###", "")]).withColumn("names", F.array_join("names", "|"))


@R.add(r"""WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(start AS INT) AS start, regexp_replace(substr(text, start + 1, 1000), '^\s+|\s+$', '', 'g') AS chunk FROM w
WHERE (start = 0 OR start - 800 + 1000 < length(text)) AND regexp_replace(substr(text, start + 1, 1000), '^\s+|\s+$', '', 'g') <> ''""")
def window_chunks(spark, sf):
    return chunking.window_chunks(table(spark, sf, "documents"))


@R.add(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT *, (contains(line, '|') OR length(line) - length(replace(line, ';', '')) >= 2) AS tabular FROM l),
c AS (SELECT *, coalesce(CAST(tabular <> lag(tabular) OVER (PARTITION BY doc_id ORDER BY pos) AS INT), 0) AS starts FROM m),
b AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM c)
SELECT doc_id, CAST(block AS BIGINT) AS block, tabular, string_agg(line, chr(10) ORDER BY pos) AS block_text FROM b GROUP BY doc_id, block, tabular""")
def table_line_blocks(spark, sf):
    return chunking.group_table_lines(table(spark, sf, "documents"))


@R.add()
def recursive_chunks(spark, sf):
    return chunking.recursive_chunks(table(spark, sf, "documents"))


@R.add()
def chunk_documents(spark, sf):
    pages = table(spark, sf, "documents").select("source", F.col("doc_id").cast("int").alias("page"), "text", F.lit("").alias("section"))
    return chunking.chunk_documents(pages)


@R.add(r"""SELECT coalesce(nullif(trim(regexp_extract(text, '(?m)^(The [^\n]{0,20})', 1)), ''), nullif(source, ''), 'Desconhecida') AS section, count(*) AS documents FROM documents GROUP BY 1""")
def section_inference(spark, sf):
    section = chunking.infer_section(F.col("text"), F.col("source"), r"(?m)^(The [^\n]{0,20})")
    return table(spark, sf, "documents").groupBy(section.alias("section")).agg(F.count("*").alias("documents"))


@R.add("SELECT doc_id, sha256(concat_ws(chr(31), text, source, CAST(doc_id AS VARCHAR))) AS doc_key FROM documents")
def doc_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", chunking.chunk_id(F.col("text"), F.col("source"), F.col("doc_id")).alias("doc_key"))


@R.add("SELECT lang AS source, doc_id // 50 AS block, sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS text_sha256 FROM documents GROUP BY 1, 2")
def reassembled_sources(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("page"), F.lit(0).alias("chunk_no"), F.col("text").alias("content"))
    return chunking.reassemble(docs, 50).select("source", "block", F.sha2("text", 256).alias("text_sha256"))


@R.add("""SELECT p_name AS name, unnest(['nome', 'cabecalho', 'completo']) AS kind, unnest([p_name, concat_ws(' ', p_name, p_brand), concat_ws(' ', p_name, p_brand, p_type)]) AS content FROM part""")
def entity_chunks(spark, sf):
    return chunking.entity_chunks(table(spark, sf, "part"), "p_name", F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_name", "p_brand", "p_type"))


@R.add("SELECT source, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def chunks_by_source(spark, sf):
    return chunking.chunks_by_source(table(spark, sf, "documents").withColumnRenamed("text", "content"))


@R.add(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS source, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '[_-]', ' ', 'g') AS book_title, 0 AS page, 'Desconhecida' AS section, 'texto' AS content_type FROM pages""")
def enriched_metadata(spark, sf):
    rows = io.enrich_metadata(table(spark, sf, "pages").select("page_id", F.col("url").alias("path")))
    return rows.select("page_id", "source", "book_title", "page", "section", "content_type")


@R.add("SELECT model_id, count(vec_id) AS vectors, count(vec_id) > 0 AS present FROM (SELECT 'm' || CAST(label AS VARCHAR) AS model_id, vec_id FROM embeddings UNION ALL SELECT 'm99', NULL) GROUP BY model_id")
def vector_inventory(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model_id"))
    return io.vector_inventory(vectors, ["m0", "m99"])


@R.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_vectors(spark, sf):
    have = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"))
    return io.missing_vectors(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id")), have).select(F.col("chunk_id").alias("doc_id"))


@R.add("""SELECT c AS copy, item_id FROM benchmark, range(0, 1 + (100 - 1) // (SELECT count(*) FROM benchmark)) r(c) ORDER BY c, item_id LIMIT 100""")
def repeated_queries(spark, sf):
    """The query list repeated up to 100 queries: the limit is the feature."""
    return io.repeat_to(table(spark, sf, "benchmark").select("item_id"), "item_id", 100).select(F.col("copy").cast("long").alias("copy"), "item_id")


# sources and sinks: what is written to the shared folder is what is read back


@R.add("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text AS content, source, CAST(doc_id % 10 AS INT) AS page, lang AS section FROM documents")
def stored_chunks(spark, sf):
    path = io.work_dir(spark)
    docs = table(spark, sf, "documents")
    io.write_chunks(docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), "source", (F.col("doc_id") % 10).cast("int").alias("page"), F.col("lang").alias("section")), path)
    return io.read_chunks(spark, path)


@R.add("SELECT doc_id, text, 'texto' AS kind, coalesce(lang, 'none') AS lang FROM documents")
def stored_jsonl(spark, sf):
    path = io.work_dir(spark)
    io.write_jsonl(table(spark, sf, "documents"), path, {"doc_id": F.lit(0).cast("long"), "text": F.lit(""), "kind": F.lit("texto"), "lang": F.lit("none")})
    return spark.read.schema("doc_id long, text string, kind string, lang string").json(path)


@R.add("SELECT p_partkey, p_name FROM part")
def review_csv(spark, sf):
    path = io.work_dir(spark)
    io.write_review(table(spark, sf, "part"), path, ["p_partkey", "p_name"])
    return spark.read.option("header", True).schema("p_partkey long, p_name string").csv(path)


@R.add("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS model_id, len(embedding) AS dims FROM embeddings UNION ALL SELECT CAST(vec_id AS VARCHAR), 'a', len(embedding) FROM embeddings WHERE vec_id % 2 = 1")
def stored_vectors(spark, sf):
    """The vectors of two models are written, those of one again, and all chunks added to the other, which lacks half of them."""
    path = io.work_dir(spark)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "vec_id")
    io.write_vectors(rows.where("vec_id % 2 = 0"), path, "a")
    io.write_vectors(rows, path, "b")
    io.write_vectors(rows.where("vec_id % 2 = 1"), path, "b")  # replaced
    io.append_vectors(rows, path, "a")
    both = io.read_vectors(spark, path, "a").unionByName(io.read_vectors(spark, path, "b"))
    return both.select("chunk_id", "model_id", F.size("embedding").cast("long").alias("dims"))


@R.add("SELECT event_id AS id, CAST(least(1, greatest(-1, user_id % 5 - 2)) AS INT) AS user_rating, '[{\"source\":\"' || event_type || '\",\"page\":3}]' AS chunks_used, '[0.5]' AS rerank_scores FROM events")
def stored_feedback(spark, sf):
    path = io.work_dir(spark)
    e = table(spark, sf, "events")
    chunk = F.struct(F.col("event_type").alias("source"), F.lit(3).alias("page"))
    rows = e.select(F.col("event_id").alias("id"), "ts", F.lit("q").alias("query"), F.lit("r").alias("response"), (F.col("user_id") % 5 - 2).cast("int").alias("user_rating"), F.array(chunk).alias("chunks_used"), F.array(F.lit(0.5)).alias("rerank_scores"), F.array(F.lit("f")).alias("validation_flags"))
    io.append_feedback(rows.where("event_id % 2 = 0"), path)
    io.append_feedback(rows.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).select("id", "user_rating", "chunks_used", "rerank_scores")


@R.add("SELECT conv_id, turn, text AS answer, '{\"n\":' || turn || '}' AS metrics FROM conversations WHERE role = 'assistant'")
def stored_responses(spark, sf):
    path = io.work_dir(spark)
    a = table(spark, sf, "conversations").where("role = 'assistant'")
    rows = a.select(F.current_timestamp().alias("ts"), F.concat_ws("/", "conv_id", "turn").alias("question"), F.col("text").alias("answer"), F.struct(F.col("turn").alias("n")).alias("metrics"), F.array(F.lit("s")).alias("sources"))
    io.append_responses(rows, path)
    key = F.split("question", "/")
    return spark.read.parquet(path).select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "answer", "metrics")


@R.add("SELECT item_id AS query_id, text AS query, 'c' || item_id % 3 AS category FROM benchmark")
def loaded_queries(spark, sf):
    path = io.work_dir(spark)
    items, row = table(spark, sf, "benchmark"), F.struct(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"))
    files = F.pmod(F.xxhash64("item_id"), F.lit(1 + items.count() // 1000)).alias("file")
    items.groupBy(files).agg(F.to_json(F.collect_list(row)).alias("value")).write.partitionBy("file").text(path)  # an array of about 1,000 a file, the form of query files
    return io.read_queries(spark, path).select("query_id", "query", "category")


@R.add("SELECT count(*) AS pages, 0 AS skipped, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages")
def page_source(spark, sf):
    path = io.work_dir(spark)
    table(spark, sf, "pages").select(F.col("url").alias("path"), F.lit(1).alias("page"), F.col("html").alias("text")).write.json(f"{path}/a/b")
    pages = io.read_pages(spark, path)
    return io.page_counts(pages).crossJoin(pages.agg(F.sum(F.length("text")).alias("chars")))


@R.add("SELECT replacement, count(*) AS n FROM (VALUES ('idiot', 'X'), ('moron', 'Y')) r(pattern, replacement) JOIN documents ON regexp_matches(text, '(?i)' || pattern) GROUP BY 1")
def loaded_rules(spark, sf):
    """OCR rules from a file, in order: here two words and what stands for them."""
    path = io.work_dir(spark)
    spark.createDataFrame([(1, "idiot", "<X>"), (2, "moron", "<Y>")], "place int, pattern string, replacement string").write.json(path)
    mended = table(spark, sf, "documents").select(T.repair_ocr(F.col("text"), io.read_rules(spark, path)).alias("t"))
    return mended.select(F.explode(F.filter(F.array(F.lit("X"), F.lit("Y")), lambda x: F.contains("t", F.concat(F.lit("<"), x, F.lit(">"))))).alias("replacement")).groupBy("replacement").agg(F.count("*").alias("n"))
