import random
import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from tomeforge.llm import chat, decontaminate, graph, html, simhash
from tomeforge.llm.common import shared_dir

SF = "/root/testdata/sf0.01"


def roots(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def planted_codes():
    rng = np.random.default_rng(1)
    codes = [int(x) for x in rng.integers(0, 2**63, 150, dtype=np.uint64)]
    for code in list(codes):
        for _ in range(4):
            for k in rng.choice(64, rng.integers(1, 5), replace=False):
                code ^= 1 << int(k)
            codes.append(code)
    return np.unique(np.array(codes, np.uint64))


def test_gray_index_finds_all_components(spark):
    codes = planted_codes()
    signed = codes.view(np.int64).tolist()
    number = {x: i for i, x in enumerate(signed)}
    brute = [(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1 :]) <= 3) + i + 1]
    want = roots(len(codes), brute)
    assert roots(len(codes), [(number[a], number[b]) for a, b in simhash.spanning_links(codes, 3)]) == want
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for hot, group in ((4096, 2048), (5, 2048), (5, 4), (4096, 64)):  # with and without hot blocks dealt again, in wide and narrow Gray ranges
        found = [(number[r.a], number[r.b]) for r in simhash.links(df, 3, hot, group).collect()]
        assert roots(len(codes), found) == want


def test_gray_index_prunes_whole_groups():
    """Upper nodes share bits, and most pairs of codes are never looked at; what is found are all pairs within the limit."""
    rng = np.random.default_rng(4)
    codes = np.unique(np.concatenate([planted_codes(), rng.integers(0, 2**63, 6000, dtype=np.uint64)]))
    for same in (0, 0xFFFF << 48):
        index = simhash.GrayIndex(codes)
        assert len(index.levels) >= 4
        pairs = {tuple(sorted((int(index.codes[x]), int(index.codes[y])))) for a, b in index.near(3, same) for x, y in zip(a, b)}
        want = set()
        for i in range(len(codes)):
            apart = codes[i] ^ codes[i + 1 :]
            want |= {(int(codes[i]), int(codes[j])) for j in np.flatnonzero((np.bitwise_count(apart) <= 3) & (apart & np.uint64(same) == 0)) + i + 1}
        assert pairs == want
    assert index.visited[0] < len(codes) ** 2 / 2 / 40  # with the block held equal, under 1 in 40 pairs is compared
    for level in range(1, len(index.levels) - 1):
        pattern, mask, own = index.levels[level]
        parents = index.levels[level + 1][1].repeat(index.fans[level])[: len(mask)]
        assert (own == mask & ~parents).all() and (mask & parents == parents).all()
    assert (np.bitwise_count(index.levels[1][1]) > 0).mean() > 0.99


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 160)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_by_brute_force(spark, tmp_path):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    docs += [{"doc_id": 9000 + i, "text": t} for i, t in enumerate([None, "", " \t", "One", "one", "É a B"])]
    spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs.sort(key=lambda d: d["doc_id"])
    prints = [brute_fingerprint(d["text"]) for d in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = {docs[i]["doc_id"]: (f"{prints[i]:016x}", docs[r]["doc_id"]) for i, r in enumerate(roots(len(docs), pairs))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash_components(spark, str(tmp_path)).collect()} == want


def test_simhash_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d", 5), (1, "a b c d", 5), (None, "a b c d", 6)], "doc_id long, text string, fp int")
    assert [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).orderBy("doc_id").collect()] == [(None, 1), (1, 1), (1, 1)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def edit_distance_inside(passage, text):
    previous, lane, codes = np.zeros(len(text) + 1, int), np.arange(len(text) + 1), np.array(list(text))
    for i, c in enumerate(passage, 1):
        row = np.empty_like(previous)
        row[0] = i
        row[1:] = np.minimum(previous[:-1] + (codes != c), previous[1:] + 1)
        previous = np.minimum.accumulate(row - lane) + lane
    return previous.min()


def test_lemma_and_alignment_by_brute_force():
    rnd = random.Random(3)
    items = [decontaminate.normal(x["text"]) for x in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    texts = [decontaminate.normal(x["text"]) for x in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    held = decontaminate.Passages(list(range(len(items))), items, decontaminate.ERROR_RATE)
    for _ in range(120):
        k = rnd.randrange(len(items))
        changed = list(items[k])
        for _ in range(rnd.randrange(int(held.edits[k] * 1.6) + 1)):
            at, kind = rnd.randrange(len(changed)), rnd.random()
            changed[at : at + 1] = [rnd.choice("abc ")] if kind < 0.3 else [] if kind < 0.6 else [changed[at], rnd.choice("abc ")]
        text = rnd.choice(texts)[:1000] + "".join(changed) + rnd.choice(texts)[:400]
        best = edit_distance_inside(items[k], text)
        found = {item: edits for _, item, edits, _, _ in held.find([text])}
        assert (k in found) == (best <= held.edits[k]) and found.get(k, best) == best


def least_edits(text, passage):
    """The fewest edits of a passage in any part of a text, by the plain table of alignments, a row at a time."""
    codes, place = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(np.frombuffer(passage.encode("utf-32-le"), np.uint32).tolist()):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (codes != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def test_decontamination_query_by_brute_force(spark, tmp_path):
    """Whole documents and passages, and edited ones at and beyond their bounds, by alignments of all with all."""
    items = {x["item_id"]: x["text"] for x in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    docs = {x["doc_id"]: x["text"] for x in pq.read_table(f"{SF}/documents.parquet").to_pylist() if len(x["text"] or "") < 900}
    items |= {9000: "abcdefgh", 9001: "twelve chars", 9002: "twenty one characters", 9003: "thirty characters or near that"}
    edited = {900_000 + k: f"before {items[9000 + k % 4][:-1] + '#' if k < 4 else items[9000 + k % 4].replace('e', '#', 1)} after" for k in range(8)}
    rows = list({**docs, **edited}.items())
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.op4_decontamination(spark, str(tmp_path)).collect()}
    want = {}
    for d, text in rows:
        for i, passage in items.items():
            m = len(decontaminate.normal(passage))
            most = 0 if m < decontaminate.Q else min(m // 10, (m - 8) // 8)
            edits = least_edits(decontaminate.normal(text), decontaminate.normal(passage))
            if edits <= most:
                want[d, i] = edits
    assert got == want and len(want) > 5 and set(want.values()) > {0}


def test_decontamination_tables(spark):
    benchmark = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog today"), (2, None), (3, ""), (4, "tiny"), (1, "The quick brown fox jumps over the lazy dog today")], "item_id long, text string")
    hit = "x " * 50_000 + "the  QUICK brown\nfox jumped over the lazy dog today" + " y" * 50_000
    docs = spark.createDataFrame([(1, hit, "a"), (2, "nothing", "b"), (3, None, "c"), (4, "", "d"), (5, "a tiny thing", "e"), (None, "nothing", "f"), (6, "aaaa" * 20_000, "g")], "doc_id long, text string, item_id string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(docs, benchmark).collect()}
    assert found == {(1, 1): 2, (5, 4): 0}
    clean = decontaminate.clean(docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))), benchmark)
    assert sorted(r.item_id for r in clean.collect()) == ["b", "c", "d", "f", "g"] and clean.columns == docs.columns
    no_id = spark.createDataFrame([(None, "tiny words in here"), (-1, "words in there")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame([(None, "tiny words in here")], "doc_id long, text string"), no_id).collect()} == {(None, None)}
    assert decontaminate.matches(docs.limit(0), benchmark).count() == 0 and decontaminate.matches(docs, benchmark.limit(0)).count() == 0


def test_decontamination_in_slices(spark, monkeypatch):
    benchmark, docs = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    whole = sorted(map(tuple, decontaminate.matches(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 3000)
    assert sorted(map(tuple, decontaminate.matches(docs, benchmark).collect())) == whole and whole
    left = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert left == {r.doc_id for r in docs.select("doc_id").collect()} - {r[0] for r in whole}


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(map(tuple, chat.op3_chat_format(spark, SF).collect())) == sorted(con.execute(chat.SQL).fetchall())


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "### </turn>: \\ \\\\"), (2, 0, "assistant", "x"), (3, 0, None, ""), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "u</turn>### : ", "z" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("*", chat.read_back(out.formatted).alias("back")).collect()}
    assert {k: (r.valid, r.error_turn) for k, r in got.items()} == {1: (True, None), 2: (False, 0), 3: (False, 0), 4: (False, 1), 5: (False, 0)}
    for k, r in got.items():
        assert [tuple(x) for x in r.back] == [(role or "", text or "") for c, _, role, text in rows if c == k]
        assert r.formatted == "".join(s.text for s in r.segments)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_templates_of_other_marks(spark):
    import pytest

    for marks in (("##", ": ", "</t>"), ("<a", ": ", "x<"), ("[[x", "[[", "]]"), ("a\\b", ": ", "</t>"), ("#", ": ", "</t>")):
        with pytest.raises(ValueError):
            chat.Template(*marks)
    template = chat.Template("<|im|>", "::=", "\n<end>")
    rnd = random.Random(5)
    pieces = ["<|im|>", "::=", "\n<end>", "<|im", "|>", "::", "=", "\n", "<end>", "\\", "x", "end>"]
    rows = [(k, t, rnd.choice(["user", "assistant"]), "".join(rnd.choices(pieces, k=rnd.randrange(8)))) for k in range(60) for t in range(3)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    for r in out.select("conv_id", chat.read_back(out.formatted, template).alias("back")).collect():
        assert [tuple(x) for x in r.back] == [x[2:] for x in rows if x[0] == r.conv_id]


def article_by_hand(page):
    from html import unescape

    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<br[^>]*>", " ", x).replace("<b>", "").replace("</b>", ""))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(x for x in parts if x)


def test_html_pages_by_hand(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert all(html.main_text(p["html"]) == article_by_hand(p["html"]) for p in pages)


def test_html_rules():
    text = "The cat of the house was in the garden and it is one of those that is for the dog with a hat on the mat."
    page = f"""<html><body><div id="top">Home | <a href=x>About</a></div><header><h1>Site</h1></header><div class="content"><h2>Title</h2>
    <p>{text}</p><p>Short&nbsp;one.</p><p>{text}</p></div><section id="comments"><p>{text}</p></section><form><p>{text}</p></form><footer>(c)</footer></body></html>"""
    assert html.main_text(page) == f"Title\n{text}\nShort one.\n{text}"
    assert [html.main_text(x) for x in (None, "", "plain", "<p", "<article><p>x</article>", "<script>a<p>b")] == ["", "", "plain", "", "x", ""]
    assert html.main_text("<article><p>" + "a " * 500_000) == "a " * 499_999 + "a"


def test_html_text_after_the_last_tag():
    text = "It is one of the things that if a < b then this is the text of the page, and that is not all of it."
    assert html.main_text(f"<article><p>{text}") == html.main_text(f"<article><p>{text}</p></article>") == text
    for end in ("<", "</", '<a href="http://x', "<a href='x y", "</p", "<!-- x", "<b"):
        assert html.main_text(f"<article><p>{text} {end}") == text
    assert html.main_text(f"<article><p>{text}</p><p><a href=x>{text}") == text


def test_html_pages_without_article_tags():
    """Density, neighbours and containers alone find the same blocks."""
    for p in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        assert html.main_text(re.sub("(</?)article>", r"\1div>", p["html"])) == article_by_hand(p["html"])


def test_html_markup_and_names():
    text = "The cat of the house is in the garden and it is one of those that is for the dog."
    assert html.main_text(f'<p title="a>{text}</p><p>{text}</p>') == f"{text}\n{text}"  # a quote that is never closed
    assert html.main_text(f"<p title='a > b' data-x=\"<b>\">{text}</p>") == text
    assert html.main_text(f'<div class="page no-sidebar"><article><p>{text}</article></div>') == text
    assert html.main_text(f'<div class="sidebar-right"><article><p>{text}</article></div>') == text
    assert html.main_text(f'<article><p>{text}<p class="alert">Mind the gap.<div class="social-science">Yes.</div></article>') == f"{text}\nMind the gap.\nYes."
    for name in ("ad", "site-footer", "cookie_banner", "main-nav", "notice", "share-buttons", "comments", "comment-list"):
        assert html.main_text(f'<article><p>{text}</p><div class="{name}">{text} {text}</div></article>') == text
    assert html.main_text(f"<article><header><h1>Title</h1><p>By me</p><a href=/>Home</a></header><p>{text}</article>") == f"Title\n{text}"
    assert html.main_text(f'<article><p>{text}</article><section id="comments"><article class="comment"><p>{text}</article></section>') == text
    assert html.main_text(f"<b><article><p>{text}</b><p>{text}</article>") == f"{text}\n{text}"  # wrongly nested
    assert html.main_text(f"<article><p>{text}<button>Press</button><p>{text}<button>Press<p>{text}") == "\n".join([text] * 3)
    menu = "".join(f"<li><a href=/{k}>{w}</a>" for k, w in enumerate("the and of that".split()))
    assert html.main_text(f"<ul>{menu}</ul><div><h2>Title</h2><p>{text}<p>Short.<ul><li>One<li>Two</ul></div><div>Note.</div><ul>{menu}</ul>") == f"Title\n{text}\nShort.\nOne\nTwo"


def test_html_attributes_hide_only_what_they_say():
    text = "The cat of the house is in the garden and it is one of those that is for the dog."
    for tag in ('data-title="The hidden truth"', 'title="a hidden gem"', 'style="overflow: hidden !important"', "data-x='aria-hidden=\"true\"'", 'title="display:none"', "aria-hidden=false"):
        assert html.main_text(f"<div {tag}><article><p {tag}>{text}</p></article></div>") == text
    for tag in ("hidden", 'hidden=""', "aria-hidden='true'", "aria-hidden=TRUE", 'style="color:red; DISPLAY : none !important"', "class=x hidden"):
        assert html.main_text(f"<article><p>{text}</p><div {tag}>{text} {text}</div></article>") == text
        assert html.main_text(f"<div {tag}><p>{text}</p></div>") == text  # the page's only text
    assert html.main_text(f'<article><p>{text}</p><p title="a hidden gem>{text}</p></article>').startswith(text)


def test_html_names_of_comments_and_marks():
    text = "The cat of the house is in the garden and it is one of those that is for the dog."
    assert html.main_text(f'<article class="post comments-open"><p>{text}</article>') == text
    for name in ('class="comment-on-the-case"', 'id="comments-on-law"', 'class="ad-hoc-ruling"', 'id="menu-planning"', 'class="cookie-recipes"', 'class="banner-story"'):
        assert html.main_text(f"<article><p>{text}</p><section {name}>{text} Two.</section></article>") == f"{text}\n{text} Two."
    for name in ("comment-body", "user-comments", "comments_list", "comment-12", "disqus_thread", "ad-300x250", "menu-left", "cookie-bar", "sponsored-item", "top-nav"):
        assert html.main_text(f'<article><p>{text}</p><section class="{name}">{text} {text} {text}</section></article>') == text
    assert html.main_text(f'<article><p>Short.</p></article><div class="comments"><p>{text}</p><p>{text}</p></div>') == "Short."


def test_html_page_in_a_form():
    text = "The cat of the house is in the garden and it is one of those that is for the dog."
    page = f'<body><form id="aspnet"><nav>Home</nav><input name=q><div><article><h1>Title</h1><p>{text}</p><p>Short.</p></article></div><footer>(c)</footer></form></body>'
    assert html.main_text(page) == html.main_text(re.sub("</?article>", "", page)) == f"Title\n{text}\nShort."
    assert html.main_text(f"<article><p>{text}</p><form><p>{text}</p><p>{text}</p></form></article>") == text


def test_html_other_languages():
    for text in ("日本語の文章はここにあります。" * 6, "Это длинный текст на русском языке о погоде и природе. " * 5, "هذا نص طويل باللغة العربية عن الطقس والطبيعة. " * 6):
        page = f"<nav><a href=/>x</a></nav><div><h1>題</h1><p>{text}</p><p>{text}</p></div><footer>(c) {text}</footer>"
        assert html.main_text(page) == "\n".join(["題", text.strip(), text.strip()])


def test_html_many_blocks():
    import time

    began = time.process_time()
    assert html.main_text("<div>" + "<p>short one</p>" * 100_000 + "</div>").count("\n") == 99_999
    assert html.main_text("<article>" + "<li>short one" * 100_000).count("\n") == 99_999
    assert html.main_text("<b>x" * 100_000 + "</i></p>" * 100_000).count("x") == 100_000
    assert html.main_text("<div>x" * 100_000).count("x") == html.main_text("<b><div>x" * 50_000 + "</b>" * 50_000).count("x") * 2 == 100_000
    assert time.process_time() - began < 25


def test_html_query_by_hand(spark):
    want = {p["page_id"]: (p["url"], article_by_hand(p["html"])) for p in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = html.op5_html_text(spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_html_table(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "<article><p>x</p></article>", "u"), (2, "<article><p>x</p></article>", "u")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html.extract(df).collect()) == [(1, ""), (2, "x"), (2, "x")]


def test_shared_folder_is_new(spark):
    assert shared_dir(spark) != shared_dir(spark)
