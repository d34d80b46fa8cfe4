import re

import pytest
from pyspark.sql import functions as F

from tomeforge import plugins
from tomeforge.functions import parse
from tomeforge.functions import text as T
from tomeforge.operators import catalog, chunking, domain, entities, evaluation, graph, retrieval, tables, trainset
from tomeforge.sources import io
from tomeforge.streaming import logs


#: Rules of which the later ones see what the earlier ones leave.
OCR = [(r"\bcon1\b", "com"), (r"con1(\d)", "com$1"), (r"en1([a-z])", "em$1"), (r"n1ais\b", "mais")]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.clean_text, "pala-\nvra  dois \t\n fim  ", "palavra dois\n fim"),
        (lambda c: T.repair_ocr(c, OCR), "CON1 en1boscadas con10 n1ais", "com emboscadas com0 mais"),
        (T.make_readable, "pala- vra , fim.Novo", "palavra, fim. Novo"),
        (T.expand_acronyms, "F5, H6 PdF8 30 PEs", "Força(F) 5, Habilidade(H) 6 Poder de Fogo(PdF) 8 30 Pontos de Energia(PE)"),
        (T.fold, "Fênix Ação", "fenix acao"),
        (T.slug, "  Dragão-Rei (61S)! ", "dragao-rei-61s"),
        (lambda c: T.key_phrase(c, ["o que é "]), "O que é Invocação da Fênix?", "invocação da fênix"),
        (parse.norm_dice, "Dano 2D6+1 x", "2d6+1"),
        (parse.norm_dice, "", None),
        (parse.dice_mean, "2d6+1", 8.0),
        (parse.dice_mean, "7", 7.0),
        (parse.dice_mean, "x", None),
        (lambda c: parse.first_int(c, grouped=True), "1.000 PE", 1000),
        (parse.first_int, "3-5", 3),
        (parse.split_list, "a, b;;\nc ", ["a", "b", "c"]),
        (parse.range_mean, "3-4", 3.5),
        (parse.resource_mean, "1d+6", 10.0),
        (parse.resource_mean, "variável", 15.0),
        (parse.cost, "-2 pontos", -2),
        (parse.spell_cost, "padrão", 1),
        (catalog.ocr_digits, "lO", "10"),
    ],
)
def test_columns(spark, function, text, want):
    assert one(spark, function, text) == want


def test_expanded_text_is_stable(spark):
    once = one(spark, T.expand_acronyms, "F5 PM PV: 10 CD FA = 3")
    assert one(spark, T.expand_acronyms, once) == once


def test_acronyms_by_pieces(spark, sf):
    """Pieces give what rule after rule gives over whole texts, and no rule runs over a whole text."""
    import random

    from tomeforge.functions import rules
    from tomeforge.plans import registry

    rnd = random.Random(3)
    parts = ["PdF", "pdf", "FA", "fa", "FD", "FDA", "F", "H", "R", "A", "PV", "pvs", "PM", "PMs", "PE", "PEs", "CD", "FAF+1", "F5", "R2", "7", "12", "٣", "-", "–", "+", "=", ":", ")", "(", " ", "  ", "\n", "\u00a0", ".", ",", ";", "!", "?", "wort", "é", "\u0301", "_"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(1, 25))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    whole = T.substitute(F.col("t"), rules.ACRONYMS, "(?U)")
    got = df.select("t", T.expand_acronyms(F.col("t")).alias("got"), whole.alias("want"), T.has_acronyms(F.col("t")).alias("held")).collect()
    assert [r for r in got if r.got != r.want or r.t is not None and r.held != (r.t != r.want)] == []
    assert sum(bool(r.held) for r in got) > 1000
    plan = registry.QUERIES["acronym_expansion"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(lambda" in plan and "regexp_replace(text" not in plan


def test_recursive_chunks(spark):
    text = "\n\n".join("word " * n for n in (5, 90, 400, 3)) + "x" * 700
    pieces = chunking.split_recursively(text, 200)
    assert all(0 < len(p) <= 200 for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())
    stitched = chunking.stitch(["abcdef", "ghi", "hij"], 8, 2, truncate=False)
    assert stitched == ["abcdef", "efghi", "hij"]
    assert chunking.recursive_chunks(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (15, 0), (100, 30)])
def test_recursive_chunks_of_random_texts(spark, size, overlap):
    """Pieces stand in their text in order, with nothing but separators and white space between; chunks begin with the end of the one before."""
    import random

    rnd = random.Random(size)
    parts = ["word", "longer words here", ". ", ", ", "\n", "\n\n", " ", "x" * 60, "é日", "", ".", "  "]
    texts = {k: "".join(rnd.choices(parts, k=rnd.randrange(0, 60))) for k in range(80)} | {99: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")

    def by_document(**how):
        found = {}
        for r in sorted(chunking.recursive_chunks(docs, size, **how).collect()):
            assert r.chunk_no == len(found.setdefault(r.doc_id, []))
            found[r.doc_id].append(r.chunk)
        return found

    pieces, whole, cut = by_document(overlap=0), by_document(overlap=overlap, truncate=False), by_document(overlap=overlap)
    assert set(pieces) == {k for k, t in texts.items() if t and t.strip()}
    for k, some in pieces.items():
        at = 0
        for piece in some:
            assert 0 < len(piece) <= size and piece.strip()
            place = texts[k].index(piece, at)
            assert not texts[k][at:place].strip(" \n.,")
            at = place + len(piece)
        assert not texts[k][at:].strip(" \n.,")
        assert len(whole[k]) == len(cut[k]) == len(some)
        for n, (piece, chunk) in enumerate(zip(some, whole[k])):
            tail = whole[k][n - 1][-overlap:] if n and overlap else ""
            assert chunk == (piece if piece.startswith(tail) else tail + piece)
        assert all(len(c) <= size for c in cut[k]) and cut[k][0] == some[0]


def test_layout_chunks(spark):
    page = "before text here\nNome F H\nA 1 2\nafter text"
    pages = spark.createDataFrame([("s", 1, page)], "source string, page int, text string")
    found = spark.createDataFrame([("s", 1, "t", "Nome F H\nA 1 2")], "source string, page int, title string, raw_text string")
    got = {r.kind: r.content for r in chunking.layout_chunks(pages, found).collect()}
    assert got["table"] == page and "Nome" not in got["text"]


def test_cascade_and_reconcile(spark):
    a, b = (spark.createDataFrame([(x,) for x in names], "name string") for names in (["Fire Ball", "Ice"], ["Fire Ball II", "ice", "Wind"]))
    assert sorted(r.name for r in catalog.cascade_merge([a, b]).collect()) == ["Fire Ball", "Ice", "Wind"]
    got = {(r.name, r.method) for r in catalog.reconcile(a, b).collect()}
    assert got == {("Fire Ball", "delimitador_parcial"), ("Ice", "delimitador"), ("Wind", "extra")}


def test_locate_names(spark):
    docs = spark.createDataFrame([(1, "o Dragão voa"), (2, "a fenix e a hidra de lerna")], "doc_id long, text string")
    names = spark.createDataFrame([("Dragão",), ("FÊNIX",), ("Hidra de Lernz",), ("Kraken",)], "name string")
    got = {r.name: (r.doc_id, r.method) for r in catalog.locate_names(names, docs).collect()}
    assert got == {"Dragão": (1, "exact"), "FÊNIX": (2, "accent"), "Hidra de Lernz": (2, "fuzzy")}


@pytest.mark.parametrize("offsets", [True, False])
def test_entity_candidates_leave_in_slices(spark, monkeypatch, offsets):
    """Names of one text and of several leave a worker a few at a time, all of them, by count and by characters."""
    texts = [" ".join(f"Ab{'c' * (k % 90)}d{chr(97 + k // 90)}" for k in range(n)) for n in (0, 1, 700, 40, 90)] + [None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")
    taken = {}
    monkeypatch.setattr(type(chunks), "mapInArrow", lambda df, f, schema: taken.update(find=f) or df)
    entities.entity_candidates(chunks, [r"\b([A-Z]\w+)"], offsets=offsets)
    monkeypatch.undo()
    monkeypatch.setattr(entities, "SLICE_ROWS", 50)
    monkeypatch.setattr(entities, "SLICE_CHARACTERS", 3000)
    slices = list(taken["find"](iter(chunks.toArrow().combine_chunks().to_batches())))
    assert len(slices) > 16 and max(s.num_rows for s in slices) <= 50
    got = [tuple(r.values()) for s in slices for r in s.to_pylist()]
    want = []
    for i, text in enumerate(texts):
        found = {}
        for m in re.finditer(r"\b([A-Z]\w+)", text or ""):
            found.setdefault(m[1], (max(0, m.start() - 20), m.end() + 60, m.start()))
        want += [(i, name, at, *((first, last) if offsets else (text[first:last],))) for name, (first, last, at) in found.items()]
    assert got == want and len(want) > 800


def test_entities(spark):
    chunks = spark.createDataFrame([(1, "Goblin é um monstro. Goblin Rei: forte", "x")], "chunk_id long, content string, section string")
    names = {r.name for r in entities.entity_candidates(chunks).collect()}
    assert {"Goblin", "Goblin Rei"} <= names
    spans = entities.weak_spans(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")), {"M": ["goblin rei", "goblin"]}).collect()
    assert [(s.start, s.end, s.label) for s in spans][:2] == [(0, 6, "M"), (21, 31, "M")]
    docs = spark.createDataFrame([(1, "o goblin rei e o goblin")], "doc_id long, text string")
    linked = entities.link_mentions(docs, spark.createDataFrame([("Goblin",), ("Goblin Rei",)], "name string")).collect()
    assert sorted((r.start, r.piece, r["name"]) for r in linked if r["name"]) == [(2, "goblin rei", "Goblin Rei"), (17, "goblin", "Goblin")]


def test_variants_and_scorers(spark):
    q = spark.createDataFrame([(1, "O que é Conjuração?"), (2, "x")], "query_id int, query string")
    got = {(r.query_id, r.variant_no): r["query"] for r in graph.query_variants(q).collect()}
    assert got[1, 0] == "O que é Conjuração?" and got[1, 1] == "conjuração" and got[1, 2] == "conjurar criatura invocação magia"
    pairs = spark.createDataFrame([(1, "a b", 1, "a c", 1), (1, "a b", 2, "a b", 2), (2, "z", 3, "z", 1)], "query_id int, query string, doc_id int, text string, rank int")
    assert [(r.doc_id, r.rerank_score) for r in retrieval.rerank(pairs, 5).orderBy("query_id", "final_rank").collect()] == [(2, 1.0), (1, 0.5), (3, 1.0)]
    failing = plugins.scorer_udf(lambda rows: 1 / 0)
    assert {r.rerank_score for r in retrieval.rerank(pairs.where("query_id = 1"), 5, failing).collect()} == {0.0}
    assert {r.rerank_score for r in retrieval.rerank(pairs, 5, enabled=False).collect()} == {0.5}


def test_cells_reach_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in retrieval.knn(asked, v).collect()}
    near = {(r.query_id, r.vec_id) for r in retrieval.knn_cells(asked, v, cells=8, probes=6).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id int, doc_id int, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12)], "query_id int, doc_id int")
    row = evaluation.ir_metrics(ranked, truth, ranked.select("query_id")).first()
    assert (row.queries, row.mrr, row.recall) == (2, 0.25, 0.5) and row.map == round((1 / 2 + 2 / 3) / 2 / 2, 6)


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.json").write_text('{"path": "x/My_Book-1.pdf", "page": 2, "text": "t"}\nnot json\n')
    pages = io.read_pages(spark, str(tmp_path / "in")).cache()
    assert tuple(io.page_counts(pages).first()) == (1, 1)
    row = io.enrich_metadata(pages.where("broken is null")).first()
    assert (row.source, row.book_title, row.page, row.section) == ("My_Book-1.pdf", "My Book 1", 2, "Desconhecida")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<double>")
    path = str(tmp_path / "v")
    io.write_vectors(vectors, path, "m1")
    io.write_vectors(vectors, path, "m2")
    io.write_vectors(vectors.limit(1), path, "m1")
    io.append_vectors(vectors, path, "m1")
    assert {r.model_id: r.n for r in io.read_vectors(spark, path).groupBy("model_id").agg(F.count("*").alias("n")).collect()} == {"m1": 2, "m2": 2}
    with pytest.raises(ValueError):
        io.write_vectors(vectors.limit(0), path, "m1")
    io.write_jsonl(vectors, str(tmp_path / "j"), {"chunk_id": F.lit(""), "missing": F.lit("d")})
    assert {r.missing for r in spark.read.json(str(tmp_path / "j")).collect()} == {"d"}
    io.write_review(vectors, str(tmp_path / "c"), ["chunk_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["chunk_id"]
    feedback = spark.createDataFrame([("1", "t", "q", "r", 5, [("s", 1)], [0.5], {"ok": True})], "id string, ts string, query string, response string, user_rating int, chunks_used array<struct<source:string,page:int>>, rerank_scores array<double>, validation_flags map<string,boolean>")
    io.append_feedback(feedback, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).first().user_rating == 1
    rows = tables.find_by_range(spark.createDataFrame([(1, None), (2, 5)], "id int, pm int"), pm=(1, None)).collect()
    assert [r.id for r in rows] == [2]


def test_training_rows_are_eligible(spark):
    rows = [(f"n{i}", f"d{i}", i % 3, "magia" if i % 2 else "monstro", None) for i in range(60)]
    d = spark.createDataFrame(rows, "name string, description string, cluster_id int, type string, text string")
    cluster = {f"d{i}": i % 3 for i in range(60)}
    for r in trainset.graph_triples(d, 1000).collect():
        assert cluster[r.negative] != cluster[r.positive]
    again = trainset.graph_triples(d.repartition(7), 20).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, trainset.graph_triples(d, 20).collect()))
    assert trainset.graph_triples(d.limit(0), 5).count() == 0


def memory_rows(spark, stream, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = memory_rows(spark, logs.event_windows(stream, delay="40 days"), "update", "w")
    want = logs.event_windows(events)
    last = got.groupBy("start", "user_id").agg(F.max("events").alias("events"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.select("start", "user_id", "events").collect()))
    seen = memory_rows(spark, logs.last_seen(stream), "complete", "s")
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, logs.last_seen(events).collect()))
    feedback = stream.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("query"), (F.col("user_id") % 3 - 1).alias("rating"))
    assert memory_rows(spark, logs.feedback_means(feedback, "40 days"), "complete", "f").count() == 5


def test_dormancies_of_a_stream(spark, tmp_path):
    """A replayed log with late rows gives each dormancy once, as the table does up to the watermark; those who come back can be dormant again."""
    hour = lambda h: f"2024-03-{1 + h // 24:02d} {h % 24:02d}:00:00"
    batches = [[(1, 0), (2, 3), (3, 5)], [(1, 30), (2, 9)], [(1, 12), (2, 26)], [(1, 90), (3, 100)], [(2, 118), (1, 119)], [(4, 200)]]  # 12 and 26 come late, within the delay
    want, done = set(), {}
    for b, rows in enumerate(batches):
        spark.createDataFrame([(u, hour(h)) for u, h in rows], "user_id int, ts string").select("user_id", F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"log/{b}"))
    table = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    for user in (1, 2, 3, 4):
        times = sorted(h for rows in batches for u, h in rows if u == user)
        for a, b in zip(times, [*times[1:], None]):
            if (b is None or b - a > 20) and a + 20 <= 200 - 24:
                want.add((user, hour(a)))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    for name, rows in (("table", logs.dormancies(table, "20 hours").collect()), ("stream", memory_rows(spark, logs.dormancies(stream, "20 hours"), "append", "d").collect())):
        assert sorted((r.user_id, str(r.last_seen)) for r in rows) == sorted(want), name
    assert all((r.dormant_at - r.last_seen).total_seconds() == 20 * 3600 for r in rows)


def test_normalize_job_counts_in_one_pass(spark, tmp_path):
    cells = [("stats", {"nome": "a", "forca": "1", "habilidade": "1", "resistencia": "1", "armadura": "1", "pv": "2"}), ("stats", {"nome": "b"}), ("magias", {"nome": "c"}), ("other", {"nome": "d"}), ("magias", {})]
    rows = spark.createDataFrame(cells, "table_type string, cells map<string,string>")
    got = tables.normalize_job(rows, str(tmp_path / "n"))
    counts = {r.table_type: r for r in tables.normalize_counts(tables.normalize_tables(rows)).collect()}
    assert (got["processed"], got["normalized"], got["rejected"]) == (5, 2, 3)
    assert all(got[f"{k}_{c}"] == counts[k][c] for k in ("stats", "magias") for c in ("normalized", "rejected")) and got["equipamentos_normalized"] == 0
    assert spark.read.parquet(str(tmp_path / "n")).count() == 5


def test_incremental_ingest(spark, tmp_path):
    def put(n, text):
        spark.createDataFrame([("s", n, text, "")], "source string, page int, text string, section string").write.mode("append").parquet(str(tmp_path / "p"))

    schema = "source string, page int, text string, section string"
    put(1, "one text")
    for n in (1, 2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "p"))
        logs.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        put(n + 1, f"text {n}")


@pytest.mark.parametrize("ring", [1000, 4])
def test_attribute_triples_find_every_anchor(spark, monkeypatch, ring):
    """One row in forty of another type: each anchor still gets its negative, round the end of the ring too, and from a ring of its own type alone."""
    monkeypatch.setattr(trainset, "RING", ring)
    rows = [(f"n{k}", f"d{k}", "fire", "spell" if k == 7 else "monster") for k in range(40)] + [("alone", "x", "water", "spell")]
    found = trainset.attribute_triples(spark.createDataFrame(rows, "name string, description string, element string, type string"), "element", "type", 1000, "element").collect()
    kinds = {d: t for _, d, _, t in rows}
    assert sorted(r.anchor for r in found) == sorted(f"n{k}" for k in range(40))
    assert all(r.positive == f"d{r.anchor[1:]}" and kinds[r.positive] != kinds[r.negative] for r in found)


def test_taxonomy_reads_whole_texts(spark):
    rows = [(f"n{k}", ["- " * 1500 + ("dragon fire cave" if k % 2 else "ship sea wind")]) for k in range(6)]
    members, _ = entities.discover_taxonomy(spark.createDataFrame(rows, "name string, contexts array<string>"), k=2)
    assert {r.name for r in members.collect()} == {n for n, _ in rows}


def test_paired_negatives_are_exact(spark, monkeypatch):
    """Every anchor gets an eligible negative, though all its tries fail, its bucket is empty or its cluster has nearly all rows."""
    rows = [(f"n{i}", "the same" if i % 2 else f"d{i}", 0 if i < 396 else i, "magia") for i in range(400)]
    d = spark.createDataFrame(rows, "name string, description string, cluster_id int, type string")
    clusters = {}
    for _, text, c, _ in rows:
        clusters.setdefault(text, set()).add(c)
    for tries in (1, 20):
        monkeypatch.setattr(trainset, "TRIES", tries)
        found = {r.anchor: r for r in trainset.graph_triples(d, 1 << 30).collect()}
        assert len(found) == 400
        for name, _, c, _ in rows:
            assert clusters[found[name].negative] - {c}
    assert trainset.graph_triples(d.where("cluster_id = 0"), 10).count() == 0


@pytest.mark.parametrize("tries", [1, 20])
def test_negatives_outside_all_clusters(spark, monkeypatch, tries):
    """Entities in several clusters, in none, and in one that nearly all are in: a negative shares none if any entity shares none, else it is another one."""
    import random

    monkeypatch.setattr(trainset, "TRIES", tries)
    rnd = random.Random(tries)
    clusters = {f"n{k}": set(rnd.sample(range(9), rnd.randrange(1, 6))) | ({99} if k % 20 else set()) for k in range(120)} | {"none": set(), "all": set(range(9)) | {99}}
    d = spark.createDataFrame([(n, f"about {n}") for n in clusters], "name string, description string")
    members = spark.createDataFrame([(n, c) for n, some in clusters.items() for c in some], "name string, cluster_id int")
    rows = trainset.graph_triples(d, 1 << 30, members=members).collect()
    assert sorted(r.anchor for r in rows) == sorted(clusters)
    for r in rows:
        own, other = clusters[r.anchor], r.negative.removeprefix("about ")
        able = [n for n, some in clusters.items() if n != r.anchor and not own & some]
        assert r.positive == f"about {r.anchor}" and (other in able or r.anchor == "none")
    same = spark.createDataFrame([(n, 1) for n in clusters], "name string, cluster_id int")
    rows = trainset.graph_triples(d, 1 << 30, members=same).collect()
    assert len(rows) == len(clusters) and all(r.negative != r.positive for r in rows)


@pytest.mark.parametrize("ring", [1000, 3])
def test_mates_in_rings(spark, monkeypatch, ring):
    """Each row of a cluster of two or more gets another one of it, whatever the rings; no window holds a cluster."""
    monkeypatch.setattr(trainset, "RING", ring)
    d = spark.createDataFrame([(f"n{k}", f"d{k}", 0 if k < 50 else k // 2) for k in range(61)], "name string, description string, cluster_id int")
    rows = trainset.similarity_triples(d, 1 << 30).collect()
    cluster = {f"d{k}": 0 if k < 50 else k // 2 for k in range(61)}
    assert sorted(r.anchor for r in rows) == sorted(f"n{k}" for k in range(60))
    assert all(r.positive[1:] != r.anchor[1:] and cluster[r.positive] == cluster[f"d{r.anchor[1:]}"] != cluster[r.negative] for r in rows)


def test_synonym_pairs_by_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(2)
    names = {" ".join(rnd.choices("a b c d e f g h i j k l".split(), k=rnd.randrange(1, 6))) for _ in range(80)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for share in (0.3, 0.5, 0.8, 1.0):
        words = {n: set(n.split()) for n in names}
        want = {tuple(sorted(p)) for p in itertools.combinations(names, 2) if words[p[0]] & words[p[1]] and len(words[p[0]] & words[p[1]]) >= share * min(map(len, (words[p[0]], words[p[1]])))}
        assert {(r.a, r.b) for r in trainset.synonym_pairs(df, share).collect()} == want


def test_relevant_text(spark):
    relevant = lambda text, most=12_000: one(spark, lambda c: T.relevant_text(c, "dano|ataque", ["Combate", "Magias?"], most=most), text)
    text = "Vive na mata.  O seu ataque\né forte demais. Combate: usa espada . E foge. Magia: fogo. Dano curto. O seu ataque é forte demais."
    assert relevant(text) == "Combate: usa espada. E foge. Magia: fogo. Dano curto. O seu ataque é forte demais. O seu ataque é forte demais."
    assert relevant("O seu ataque é forte demais. O seu ataque é forte demais. Ataque.") == "O seu ataque é forte demais."
    assert relevant("O seu ataque é forte demais. O ataque da noite é fraco.", 50) == "O seu ataque é forte demais."
    assert relevant("Nada de mais por aqui hoje.") == "" and relevant(None) == ""


def test_second_triples(spark):
    rows = [(f"fogo{i % 7} s{i}", f"d{i} {'fogo' if i % 3 else 'gelo'} {'cura' if i % 2 else 'dano'} {'lendario' if i % 5 else 'fraco'}", i % 9, "magia" if i % 4 else "monstro") for i in range(200)]
    d = spark.createDataFrame(rows, "name string, description string, cluster_id int, type string").withColumn("text", F.col("description"))
    kind = {r[1]: r[3] for r in rows}
    out = trainset.second_triples(d, 100).collect()
    counts = {s: sum(r.strategy == s for r in out) for s in {r.strategy for r in out}}
    assert counts == {"ambiguous": counts["ambiguous"], "element": 25, "function": 20, "power": 15, "synonym": counts["synonym"]} and counts["synonym"] <= 10
    for r in out:
        if r.strategy in ("element", "ambiguous", "synonym"):
            assert kind[r.negative] != kind[r.positive] or r.strategy == "synonym"
    first = trainset.graph_triples(d, 1 << 30)
    assert trainset.second_triples(d, 150, first).count() == 150


def test_queries_without_sql_by_brute_force(spark, sf):
    import re

    import pyarrow.parquet as pq

    from tomeforge.functions import rules
    from tomeforge.plans import registry

    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    mentions: dict = {}
    for text in docs.values():
        for name in {" ".join(m[1].split()) for p in entities.PATTERNS for m in re.finditer(p, text, re.M)}:
            mentions[name] = mentions.get(name, 0) + 1
    assert {r.name: r.mentions for r in registry.QUERIES["entity_mentions"](spark, sf).collect()} == mentions
    for r in registry.QUERIES["acronym_expansion"](spark, sf).collect():
        text = docs[r.doc_id]
        for pattern, replacement in rules.ACRONYMS:
            text = re.sub(pattern, replacement.replace("$1", r"\1"), text)
        assert r.expanded == text
    chats = {(c["conv_id"], c["turn"]): c["text"] for c in pq.read_table(f"{sf}/conversations.parquet").to_pylist()}
    rows = registry.QUERIES["cached_embeddings"](spark, sf).collect()
    assert len(rows) == len(chats)
    for r, want in zip(rows, plugins.hashed_embedder([chats[r.conv_id, r.turn] for r in rows])):
        assert max(abs(a - b) for a, b in zip(r.embedding, want)) < 1e-4
    words = re.compile(r"\b(?:idiot|moron|loser)\b", re.I)
    spans = [r for r in registry.QUERIES["weak_spans"](spark, sf).collect() if r.label == "RUDE"]
    assert sorted((r.doc_id, r.start, r.end) for r in spans) == sorted((i, *m.span()) for i, t in docs.items() for m in words.finditer(t))
    for r in registry.QUERIES["relevant_text"](spark, sf).collect():
        line = re.sub(r"\s*\.\s*", ". ", re.sub(r"\s+", " ", docs[r.doc_id].strip() + " Combate: o ataque causa dano. Magias: nenhuma."))
        kept = ["Combate: o ataque causa dano.", "Magias: nenhuma."]
        if not re.search("combate *:|magias? *:", docs[r.doc_id], re.I):
            for part in re.split(r"\.\s+", line[: line.rindex(" Combate:")]):
                part = part.strip()
                if len(part) >= 20 and re.search(r"tion|ment\b|ataque", part, re.I):
                    kept.append(part if part.endswith(".") else part + ".")
            whole = " ".join(dict.fromkeys(kept))
            assert r.relevant == whole or len(whole) > 12_000


def test_chunk_documents_by_hand(spark):
    """Ids, sections and the order of chunks; without overlap the chunks hold the whole text but for the separators between them."""
    import hashlib

    text = "Capítulo Um\n\n" + " ".join(f"palavra{k}." for k in range(400)) + "\n\nCapítulo Dois\n\n" + "x" * 1500
    pages = spark.createDataFrame([("livro", 1, text, None), ("livro", 2, "curto", "Magias"), ("livro", 3, None, "")], "source string, page int, text string, section string")
    rows = sorted(chunking.chunk_documents(pages, 300, 0).collect(), key=lambda r: (r.page, r.chunk_no))
    plain = lambda t: "".join(t.replace(".", "").split())
    assert plain("".join(r.content for r in rows if r.page == 1)) == plain(text)
    assert [(r.content, r.section) for r in rows if r.page == 2] == [("curto", "Magias")] and not [r for r in rows if r.page == 3]
    assert all(len(r.content) <= 300 and r.chunk_id == hashlib.sha256("\x1f".join([r.content, r.source, str(r.page)]).encode()).hexdigest() for r in rows)


def test_query_blocks_equal_one_broadcast(spark, sf, monkeypatch):
    """Query sets beyond the bound go in several broadcasts, never as a Cartesian product."""
    from tomeforge.operators import common
    from tomeforge.plans import registry

    whole = sorted(map(tuple, registry.QUERIES["knn_topk"](spark, sf).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 4000)
    some = registry.QUERIES["knn_topk"](spark, sf)
    plan = some._jdf.queryExecution().toString()
    assert sorted(map(tuple, some.collect())) == whole and "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") > 1


def test_guessed_types_and_parameters(spark):
    rows = [("custa quantos pm", "F: 3 e mais", None), ("um anel", "10 PE", "magia"), ("dragão e anel", "nada", "x"), ("oi", "a Escola negra", None), ("vampiro", None, "monstro")]
    got = trainset.guess_types(spark.createDataFrame(rows, "query string, text string, kind string"), "kind").collect()
    assert [(r.query_type, r.doc_type) for r in got] == [("MAGIA", "MONSTRO"), ("ITEM", "MAGIA"), ("MONSTRO", None), (None, "MAGIA"), ("MONSTRO", "MONSTRO")]
    queries = spark.createDataFrame([(1, "um encontro difícil de nível 3 para 4 jogadores, força 12"), (2, "Bola de Fogo e bola de fogo ou Gelo"), (3, "nada fácil, impossivel")], "query_id int, query string")
    found = {r.query_id: (r.difficulty, r.strength, r.level, r.party) for r in domain.classify_queries(queries).collect()}
    assert found == {1: ("dificil", 12, 3, 4), 2: (None, None, None, None), 3: ("facil", None, None, None)}
    names = spark.createDataFrame([("Gelo",), ("Bola de Fogo",), ("Bola",)], "name string")
    assert {r.query_id: r.mentions for r in domain.query_mentions(queries, names).collect()} == {2: ["Bola de Fogo", "Gelo"]}


def test_level_limits(spark):
    costs = {"a1": 1, "a2": 2, "d1": -1, "d1b": -1, "d1c": -1, "d2": -2, "d3": -3, "d9": -9}
    catalog = spark.createDataFrame(list(costs.items()), "name string, cost int")
    builds = spark.createDataFrame([(1, "novato", ["a1"]), (2, "novato", ["a1", "a2", "d1"]), (3, "campeao", ["d1", "d2"]), (4, "lutador", ["d3"]), (5, "other", [])], "build_id int, level string, choices array<string>")
    every = builds.select("build_id", F.explode(F.array(*map(F.lit, costs))).alias("name"))
    got = {}
    for r in domain.within_limits(every, builds, catalog).collect():
        got.setdefault(r.build_id, set()).add(r["name"])
    ones = {"d1", "d1b", "d1c", "d9"}
    assert got == {1: {"a1", "a2", "d2"} | ones, 2: ones, 3: {"a1", "a2", "d2"} | ones, 4: {"a1", "a2"}}


def test_display_fixes(spark):
    from tomeforge.functions.rules import DISPLAY_FIXES

    shown = lambda text: one(spark, lambda c: T.sanitize(c, fixes=DISPLAY_FIXES), text)
    assert shown("10-1 5 e 3-1 7 II TO 2 de xo FR S-6") == "10-15 e 3-17 AGI 2 DEX 0 FR 5-6"
    assert shown("''.)ú111 um #\\taques # Ataques fll 90°10 e 5° 20 , li F3 .\x0c  fim") == "Só um #Ataques #Ataques [1] 90% e 5%, F3. fim"
    assert shown(None) is None


def test_eligible_spells_of_many_paths(spark, monkeypatch):
    """A pair that several paths give comes once, and builds of a path are dealt to many tasks without a shuffle of pairs."""
    from tomeforge.operators import domain

    own = [(i, p, v) for i in range(60) for p, v in (("fire", i % 3), ("ice", i % 2), (None, 1), ("fire", 2 * (i % 5 == 0)))]
    builds = spark.createDataFrame(own, "build_id int, path string, value int")
    spells = [(i, ["Fogo, Gelo", "Gelo e Fogo", "fogo", "nada", "Gelo/Gelo", None][i % 6]) for i in range(50)]
    paths = {"fogo": "fire", "gelo": "ice"}
    theirs = {i: {p for s, p in paths.items() if s in (x or "").lower()} for i, x in spells}
    want = sorted({(b, s) for b, p, v in own if v >= 1 for s in theirs if p in theirs[s]})
    for size in (8_000_000, 50):
        monkeypatch.setattr(domain, "PAIRS_A_TASK", size)
        got = domain.eligible_spells(builds, spark.createDataFrame(spells, "spell int, schools string"), paths)
        assert sorted(map(tuple, got.collect())) == want
    assert got.rdd.getNumPartitions() > 20 and "HashAggregate(keys=[build_id" not in got._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
    assert domain.eligible_spells(builds.where("value > 9"), spark.createDataFrame(spells, "spell int, schools string"), paths).count() == 0


def test_eligible_spells_in_runs(spark, monkeypatch, tmp_path):
    """Shares that are cut small lose and double no pair, null ids included; a written result takes a fraction of a byte a pair."""
    import random

    rnd = random.Random(5)
    own = [(rnd.choice([*range(40), None]), rnd.choice(["fire", "ice", "air", None]), rnd.randrange(3)) for _ in range(90)]
    spells = [(i or None, rnd.choice(["Fogo, Gelo", "Ar e Fogo", "ar", "nada", "Gelo/Ar/Gelo", "Fogo ou gelo, ar", None])) for i in range(70)]
    paths = {"fogo": "fire", "gelo": "ice", "ar": "air"}
    theirs = {i: {paths.get(w.strip().lower()) for w in re.split("[,/]| e | ou ", x or "")} - {None} for i, x in spells}
    has = {b: {p for x, p, v in own if x == b and p and v >= 1} for b, _, _ in own}
    want = sorted((b or -1, s or -1) for b in has for s in theirs if has[b] & theirs[s])
    given = spark.createDataFrame(own, "build_id int, path string, value int"), spark.createDataFrame(spells, "spell int, schools string"), paths
    for pairs, run, runs, held in ((8_000_000, 504, 32, 64), (8_000_000, 8, 2, 3), (20, 3, 1, 64), (1, 8, 3, 2)):
        for name, value in (("PAIRS_A_TASK", pairs), ("SPELLS_A_RUN", run), ("RUNS", runs), ("BUILDS", held)):
            monkeypatch.setattr(domain, name, value)
        assert sorted((r.build_id or -1, r.spell or -1) for r in domain.eligible_spells(*given).collect()) == want and len(want) > 500
    monkeypatch.undo()
    builds = spark.range(100).selectExpr("1009 * id AS build_id", "'fire' AS path", "1 AS value")
    many = spark.range(20_000).selectExpr("1009 * id AS spell", "'Fogo' AS schools")
    domain.eligible_spells(builds, many, paths).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == spark.read.parquet(f"{tmp_path}/out").count() == 2_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1_000_000


def test_contexts_and_searches_without_grouped_pairs(spark):
    """Rows of several tables, names and no table; entries of equal texts; levels of more monsters than are asked for: against plain loops."""
    import random

    from tomeforge.operators import domain, retrieval

    rnd = random.Random(3)
    rows = [(rnd.randrange(40), rnd.choice(["Red", "red", "blue", "Old", None]), rnd.choice(["t1", "t2", "t3", "t4", None])) for _ in range(70)]
    asked = [(1, "RED"), (1, "old"), (2, "blue"), (3, "none"), (4, None), (5, "red")]
    want: dict = {}
    for q, e in asked:
        own = [r for r in rows if e and r[1] and e.lower() == r[1].lower()]
        tables = {t for *_, t in own} - {None}
        for r, _, t in rows:
            if t in tables:
                want[q, r] = max(want.get((q, r), 0), 0.7)
        for r, *_ in own:
            want[q, r] = 0.9
    got = retrieval.entity_contexts(spark.createDataFrame(asked, "query_id int, entity string"), spark.createDataFrame(rows, "row_id int, nome string, table_id string"))
    assert sorted((r.query_id, r.row_id, r.score) for r in got.collect()) == sorted((*k, v) for k, v in want.items())
    assert not any("query_id" in x and "row_id" in x and "max(" in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines())

    entries = [(i, rnd.choice(["red ring", "blue", "ring"]), rnd.choice(["a red one", "big ring", ""])) for i in range(60)]
    queries = [(1, "Red ring"), (2, "blue"), (3, "one big"), (4, "x"), (5, "")]
    found = retrieval.catalog_search(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(entries, "entry_id int, title string, text string"), k=7)
    got = sorted((r.query_id, r["rank"], r.entry_id, r.score) for r in found.collect())
    want = []
    for q, query in queries:
        ws, scored = query.lower().split(), []
        for i, t, x in entries:
            title = sum(w in t for w in ws)
            s = 400 * (t == query.lower()) + 200 * (query.lower() in t) + 90 * (query.lower() in x) + 40 * title + 8 * sum(w in x for w in ws) + 140 * (title == len(ws))
            if set(ws) & set((t + " " + x).split()):
                scored.append((-s, i))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:7])]
    assert got == sorted(want)

    monsters = [(f"m{i:03}", rnd.randrange(40)) for i in range(400)]
    parties = [(p, rnd.randrange(1, 14)) for p in range(12)]
    got = domain.encounter_candidates(spark.createDataFrame(parties, "party_id int, level int"), spark.createDataFrame(monsters, "monster string, power int"), 4)
    want = sorted((p, n + 1, w, m) for p, l in parties for n, (w, m) in enumerate(sorted((w, m) for m, w in monsters if abs(w // 3 - l) <= 2)[:4]))
    assert sorted((r.party_id, r["rank"], r.power, r.monster) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("WindowGroupLimit")  # levels are cut before they meet parties
