"""Top-k search, Merkle manifest and fill-in-middle, by SQL, by brute force and on odd rows."""

import random
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import rows
from tomeforge.llm import fim, merkle, topk
from tomeforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_merkle_manifest", "op13_fill_in_middle"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows(got) == rows(want)


# top-k

VECTORS = "vec_id long, embedding array<double>"


def best(query, vectors, k, own):
    """(vec_id, score) of the k best, by plain Python integers."""
    usable = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = lambda v: [int(np.floor(1024 * x)) for x in v]
    if not usable(query[1]):
        return []
    rest = list(vectors)
    if own:
        rest.remove(query)
    found = [(sum(a * b for a, b in zip(whole(query[1]), whole(v))), i) for i, v in rest if usable(v) and len(v) == len(query[1])]
    return [(i, s) for s, i in sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]]


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize(("block", "tile"), [(1 << 24, 1024), (200, 2)])
def test_topk_by_brute_force(spark, monkeypatch, block, tile):
    """Ties, copies, lost ids, other lengths, nulls and non-finite components, in many blocks, tiles and shards."""
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "FAN", 2)
    rnd = random.Random(5)
    data = [(i, [rnd.choice([-1.0, 0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(-50, 150)]
    data += [(500 + i, [1.0, 1.0, 1.0]) for i in range(40)] + [(None, [1.0, 1.0, 1.0]), (900, None), (901, [1.0, None, 1.0]), (902, [1.0, float("nan"), 1.0])]
    data += [(903, [float("inf"), 0.0, 0.0]), (904, [1.0, 2.0]), (1000, [1.0, 2.0]), (905, []), (2000, []), (3000, [0.5, 0.5, 0.5]), (3001, None)]
    vectors = spark.createDataFrame([(*r, "clash") for r in data], VECTORS + ", score string").repartition(7)
    found = answers(topk.search(vectors.where("vec_id % 100 = 0"), vectors, own=True, block_bytes=block))
    want = {r[0]: best(r, data, 10, True) for r in data if r[0] is not None and r[0] % 100 == 0}
    assert found == {q: [(k + 1, *hit) for k, hit in enumerate(hits)] for q, hits in want.items() if hits}
    assert len(found[2000]) == 1 and len(found[1000]) == 1 and 900 not in found


def test_topk_of_repeated_and_large_rows(spark):
    data = [(100, [1.0]), (100, [1.0]), (100, [2.0]), (7, [2.0])]
    vectors = spark.createDataFrame(data, VECTORS)
    found = answers(topk.search(vectors.where("vec_id = 100"), vectors, k=2, own=True))[100]
    want = sorted((k + 1, *hit) for r in data[:3] for k, hit in enumerate(best(r, data, 2, True)))
    assert sorted(found) == want  # each row leaves out one row like it, not others of its id
    big = [(100, [2.0**30, 1.0]), (101, [2.0**11, 3.0]), (102, [2.0**11, 2.0])]  # beyond the exact range of doubles
    vectors = spark.createDataFrame(big, VECTORS)
    assert [x[1:] for x in answers(topk.search(vectors.where("vec_id = 100"), vectors.where("vec_id > 100"), k=2))[100]] == best(big[0], big[1:], 2, False)
    with pytest.raises(Exception, match="OverflowError|too large"):
        topk.search(vectors.where("vec_id = 100"), spark.createDataFrame([(1, [2.0**40, 0.0])], VECTORS)).collect()
    none = vectors.limit(0)
    assert topk.search(none, vectors).count() == 0 and topk.search(vectors, none).count() == 0
    assert topk.search(vectors, none).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


# Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)))


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        found.append(nodes)
    return found


def path(found, k):
    out = []
    for nodes in found[:-1]:
        first = k // 3 * 3
        out.append((nodes[first:k], nodes[k + 1 : first + 3]))
        k //= 3
    return out


def plain_manifest(data):
    by = {}
    for row in data:
        by.setdefault(row[1], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    held = [sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in names]
    trees = [levels([leaf(r, r[4]) for r in x]) for x in held]
    top = levels([t[-1][0] for t in trees])
    out = []
    for j, some in enumerate(held):
        for i, row in enumerate(some):
            way = path(trees[j], i) + path(top, j)
            cut = row[4] is not None and row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0
            node = leaf(row, row[4].replace("\n", "") if cut else row[4])
            for left, right in way:
                node = h(*left, node, *right)
            out.append((row[0], leaf(row, row[4]), trees[j][-1][0], top[-1][0], h(*(x for a, b in way for x in a + b)), node, node == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("kind", ["empty", "one", "mixed", "hot", "sources"])
def test_manifest_by_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(merkle, "COPIES_A_TASK", 50)
    rnd = random.Random(kind)
    texts = [None, "", "a\nb", "ç\n\n", "plain", "long " * 3000 + "\n"]
    if kind == "empty":
        data = []
    elif kind == "one":
        data = [(4, None, None, None, "x\ny")]
    elif kind == "mixed":  # sparse, negative and repeated ids, null ids and sources, ids at both ends
        ids = lambda: rnd.choice([None, 5, 5, -7, 1 << 62, -(1 << 63), (1 << 63) - 1, rnd.randrange(-2000, 2000), rnd.randrange(-(1 << 50), 1 << 50)])
        data = [(ids(), rnd.choice([None, "", "é", "-", "a"]), rnd.choice([None, "de"]), rnd.choice([None, 1, -3]), rnd.choice(texts)) for _ in range(600)]
    elif kind == "hot":  # one source with almost all, one null id with a third, as equal rows and as others
        data = [(k, "s", "en", k, "t\n") for k in range(900)] + [(None, "s", None, None, "same")] * 230 + [(None, "s", None, k, "") for k in range(200)] + [(3, "z", None, 1, "q")]
    else:
        data = [(k, f"source {k}", None, None, "x\n") for k in range(760)]
    docs = spark.createDataFrame(data, DOCS).withColumns({"pos": F.lit(1), "word": F.lit("clash")}).repartition(5)
    got = merkle.manifest(docs)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(data)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_places_are_ranks(spark):
    ids = random.Random(2).sample(range(-(1 << 40), 1 << 40), 3000)
    rows_ = spark.createDataFrame([("=a", i, str(i), None) for i in ids], "source string, doc_id long, leaf string, tampered string")
    got = {r.doc_id: (r.pos, r.n) for r in merkle.placed(rows_).collect()}
    assert got == {i: (k, 3000) for k, i in enumerate(sorted(ids))}


# fill-in-middle

ODD = [None, "", "a", "ab<S>c", "<P", "S>", "x" * 70_000, "é日😀" * 9000, "line\n" * 200, "<" * 50, "ends with <", "ends with <S", "<M>", "日" * 30_000 + "<P>"]


@pytest.mark.parametrize("frame", [1, 7, 100, 1 << 16])
def test_frames_seek_and_stream(frame):
    for text in ["", "a", "é日😀x" * 60, "<P>abc<S>" * 20, "日" * 40]:
        data = text.encode()
        made = fim.Frames.of([data[:5], b"", data[5:]], frame)
        assert (made.n, made.size) == (len(text), len(data)) and b"".join(made.stream()) == data
        assert all(0 < b - a <= max(frame, 4) for a, b in zip([0, *made.sizes], made.sizes))
        for unit in {0, 1, len(text) // 3, len(text)} if text else {0}:
            made.opened = 0
            assert made.place(unit) == len(text[:unit].encode()) and made.opened <= 1
            assert b"".join(made.stream(made.place(unit))) == text[unit:].encode()
        assert made.find(b"<S>") == data.find(b"<S>") and made.find(b"<S>", 12) == data.find(b"<S>", 12)


def test_fill_in_middle_by_brute_force(spark):
    docs = spark.createDataFrame([(k % 97 if k % 50 else None, ODD[k % len(ODD)], "clash") for k in range(400)], "doc_id long, text string, form string").repartition(3)
    planned = fim.plan(docs).cache()
    whole = fim.expand(fim.transform(planned, frame=64), "output", "written")
    whole = fim.expand(fim.restore(whole, frame=64), "restored", "again").select("doc_id", "n", "form", "prefix_chars", "middle_chars", "written", "again")
    want = []
    for doc_id, text, _ in [tuple(r) for r in docs.collect()]:
        text, drawn = text or "", sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(drawn[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want.append((doc_id, len(text), "plain", None, None, text, text))
        elif h4 % 100 < 20:
            want.append((doc_id, len(text), "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", text))
        else:
            want.append((doc_id, len(text), "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", text))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    digested = [(*w[:5], sha256(w[5].encode()).hexdigest(), sha256(w[6].encode()).hexdigest()) for w in want]
    assert sorted(map(tuple, fim.digests(planned).collect()), key=str) == sorted(digested, key=str)
    assert fim.digests(fim.plan(docs.limit(0))).count() == 0


def test_outputs_without_marks_are_refused():
    with pytest.raises(ValueError, match="without its marks"):
        list(fim.restored(fim.Frames.of([b"<P>abc"]), "psm"))


def test_query_sets_of_many_blocks(spark):
    vectors = spark.range(0, 2000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    one, many = (topk.search(vectors.where("vec_id % 100 = 0"), vectors, own=True, block_bytes=b) for b in (1 << 24, 100))
    assert rows(one.toPandas()) == rows(many.toPandas()) and one.count() == 200
