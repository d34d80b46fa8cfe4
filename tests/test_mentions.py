"""Mention pieces and entity aggregates by plain loops."""

import random

from pyspark.sql import functions as F

from tomeforge.operators import entities

NAMES = ["Red", "red dragon", "Dragon", "dragon of the deep old sea", "a", "is", "İx", "ßa", "", None, "RED", "ed D"]
TEXTS = ["The red dragon of the deep old sea is RED", "hundred Dragons", "İX and İx, ßA", "", None, "x", "Big dragon of the deep old seas", "reDragon of the deep old seared", "red dragon" * 50]


def plain_pieces(text, names):
    table = {}
    for n in sorted(n for n in names if n and len(n.lower()) >= 2):
        table.setdefault(n.lower(), n)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out, at, held = [], 0, 0
    while at < len(text):
        able = [n for n in table if low.startswith(n, at)]
        if not able:
            at += 1
            continue
        best = max(able, key=len)
        if at > held:
            out.append((held, text[held:at], None))
        out.append((at, text[at : at + len(best)], table[best]))
        at = held = at + len(best)
    return out + ([(held, text[held:], None)] if held < len(text) else [])


def test_pieces_by_loops(spark):
    """In one pass and in many, pieces are those of a scan and put together are the text; names of many words are found."""
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id int, text string, found int")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    want = [(k, i, *p) for k, t in enumerate(TEXTS) for i, p in enumerate(plain_pieces(t or "", NAMES))]
    for size in (entities.NAME_BYTES, 200):
        got = sorted((tuple(r) for r in entities.link_mentions(docs, names, name_bytes=size).collect()), key=lambda r: r[:2])
        assert got == want
    assert any(r[4] == "dragon of the deep old sea" for r in want)
    assert entities.link_mentions(docs, names.limit(0)).where("name is not null").count() == 0
    for k, t in enumerate(TEXTS):
        assert "".join(r[3] for r in want if r[0] == k) == (t or "")


def test_aggregates_by_loops(spark):
    rnd = random.Random(4)
    chunks = [(k, f"s{k % 3}:{k % 2}", f"Força {k}, PV: {k} e H{k}" if k % 3 == 0 else "5 PO e bônus +1 FA" if k % 3 == 1 else None) for k in range(30)]
    rows = [(rnd.choice(chunks)[0], rnd.choice("AB"), k, f"context {k}") for k in range(200)]
    frame = spark.createDataFrame(chunks, "chunk_id int, source string, content string")
    scores = frame.select("chunk_id", (F.col("chunk_id") % 4).alias("x_score"), *entities.hint_columns()).join(frame.select("chunk_id", "source"), "chunk_id")
    cands = spark.createDataFrame(rows, "chunk_id int, name string, pos int, context string")
    got = {r["name"]: r for r in entities.aggregate_entities(cands, scores, ["x"]).collect()}
    for name in "AB":
        own = sorted(r for r in rows if r[1] == name)
        r = got[name]
        assert (r.mentions, r.sources, r.x_score) == (len(own), len({chunks[c][1] for c, *_ in own}), sum(c % 4 for c, *_ in own))
        assert r.contexts == [c[3] for c in sorted(own, key=lambda c: (c[0], c[2]))[:5]]
        assert (r.item_has_preco, r.item_has_bonus, r.monstro_has_pv, r.magia_has_school) == (True, True, True, False)
        first = min(c for c, *_ in own if c % 3 == 0)
        assert r.stats == f"Força {first} PV: {first} H{first}"
    assert entities.entity_sources(cands, frame).count() == sum(r.sources for r in got.values())
