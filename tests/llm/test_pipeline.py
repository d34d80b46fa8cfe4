import hashlib
from pathlib import Path

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tomeforge.llm import decontaminate, langid, simhash, toxicity
from tomeforge.llm.common import id_hash, tiktoken_encoding

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "decontamination", "byte_level_bpe"]


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), id_hash() % 3 != 1).scorer()
    rows = [r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() if score(r["text"]) < toxicity.THRESHOLD]
    kept = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    tagger = langid.Tagger(langid.train(kept, id_hash() % 4 != 2))
    found = tagger.predict([r["text"] for r in rows])
    langs = {r["doc_id"]: r["lang"] or lang for r, (lang, _) in zip(rows, found)}
    rows = [r for r, (lang, s) in zip(rows, found) if lang != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    prints = {r.doc_id: r.fp for r in simhash.fingerprints(docs.select("doc_id", "text")).collect()}
    rows.sort(key=lambda r: r["doc_id"])
    group: list[set] = []
    for r in rows:
        near = [g for g in group if any(((prints[r["doc_id"]] ^ prints[x]) & (1 << 64) - 1).bit_count() <= 3 for x in g)]
        group = [g for g in group if g not in near] + [set().union({r["doc_id"]}, *near)]
    keep = {min(g) for g in group}
    items = [decontaminate.normal(x["text"]) for x in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    held = decontaminate.Passages(list(range(len(items))), items, decontaminate.ERROR_RATE)
    rows = [r for r in rows if r["doc_id"] in keep and not list(held.find([decontaminate.normal(r["text"])]))]
    encoding = tiktoken_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.lang, r.ids) for r in got} == {r["doc_id"]: (langs[r["doc_id"]], encoding.encode_ordinary(r["text"])) for r in rows}
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)


def test_pipeline_leaves_its_last_input_alone(spark, tmp_path, monkeypatch):
    """Tables that stages write are deleted, but for the one that the result reads."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len([x for x in set(folder.iterdir()) - before if x.name.startswith("tomeforge-")]) == 1


def test_language_stage_decides(spark):
    rows = [(k, "the cat of the house and the dog " * 3, None) for k in range(20)] + [(k, "der Hund und die Katze von dem Haus " * 3, "de") for k in range(20, 40)]
    rows += [(k, "the cat of the house and the dog " * 3, "en") for k in range(40, 60)] + [(60, "the cat of the house and the dog " * 9 + "der Hund und die Katze von dem Haus " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang for r in corpus_pipeline.keep_known_language(spark, docs, SF).collect()}
    assert all(out[k] == "en" for k in range(20)) and all(out[k] == "de" for k in range(20, 40))
    corpus_pipeline_score, corpus_pipeline.LEAST_LANGUAGE_SCORE = corpus_pipeline.LEAST_LANGUAGE_SCORE, 0.8
    try:
        assert 60 not in {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, SF).collect()}
    finally:
        corpus_pipeline.LEAST_LANGUAGE_SCORE = corpus_pipeline_score


def test_stages_with_odd_rows(spark):
    odd = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "the and of that", "en", "s", 15), (2, "the and of that", "en", "s", 15), (3, "the and of that", None, "s", 15), (4, "12345", "en", "s", 5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("fp", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 2, 4]
        if name == "language_id":
            assert sorted((r.doc_id, r.lang) for r in out.collect()) == [(2, "en"), (2, "en"), (3, "en")]


@pytest.mark.parametrize("lang", [True, False])
def test_stages_take_any_columns(spark, lang):
    """Names with dots, quotes and those of other stages, and tables without lang, go through every stage."""
    docs = spark.createDataFrame([(k, f"the cat and the dog of house {k} " * 9, "en") for k in range(9)] + [(9, "12 34", "en")], "doc_id long, text string, lang string")
    docs = docs.withColumns({name: F.lit(k) for k, name in enumerate(("a.b", "c`d", "x y", "fp", "score", "n_tokens"))})
    docs = docs if lang else docs.drop("lang")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} >= ({0} if name == "simhash_near_dedup" else set(range(9)))
    assert corpus_pipeline.encode(spark, docs, SF).select("doc_id", "lang").collect()[0] == (0, "en" if lang else None)
    bare = docs.select("doc_id", "text")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_known_language(spark, bare, SF).collect()) == list(range(9))


def test_near_copies_keep_every_group(spark):
    """Unlinked texts that share an id or have none all stay; a near copy with a smaller id does not cost the other text."""
    a, b, c, d = ("".join(f"{w}{k} " for k in range(30)) for w in ("ant", "bee", "cow", "dog"))
    rows = [(None, a), (None, a), (None, b), (9, b.upper()), (5, c), (5, d), (5, d), (3, d.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted([(None, a), (None, b), (5, c), (3, d.upper())], key=key)
