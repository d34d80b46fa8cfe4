import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tomeforge.llm import bpe, sketch, tokencounts, wavelet
from tomeforge.llm.common import json_encoder, shared_dir, tiktoken_encoder, tiktoken_encoding

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "it's\n\n  x \t y", "\x1c a\x1f b ", "é 　 ß", "日本語 テキスト", "x" * 5000, "word " * 20_000, "<|endoftext|> #", "it's\n\n  x \t y"]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")


def test_chunks_keep_matches_whole():
    """Ids equal those of whole texts, over every order of white space, marks and letters, in batches and slices."""
    plain = tiktoken_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).encode_ordinary
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rnd = random.Random(1)
    signs = [*"ab1,.'s \n\t\r\x0b\x1c\x1f\x85\xa0\u3000\u2028\u1680é日#-_<|", "'re", "  ", "\n\n", "\u0301", "😀"]
    batches = [pa.array(ODD), pa.array(ODD[::-1]).slice(3), pa.array([None, ""]), pa.array([], pa.string())]
    batches += [pa.array(["".join(rnd.choices(signs, k=rnd.randrange(12))) for _ in range(200)]) for _ in range(60)]
    whole = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    for encoder, want in ((tiktoken_encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), plain), (json_encoder(P.path("byte_bpe_50k.json")), whole)):
        assert not encoder.whole
        for batch in batches:
            ends, ids = encoder(batch)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [want(x or "") for x in batch.to_pylist()]
            encoder.limit = rnd.choice([50, 800_000])


def test_other_patterns_and_tokenizers_take_whole_texts():
    pattern = r"\S+\s*|\s+"  # white space at a match's end
    encoding, encoder = (f(P.path("byte_bpe_multi_50k.tiktoken"), pattern) for f in (tiktoken_encoding, tiktoken_encoder))
    ends, ids = encoder(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [encoding.encode_ordinary(x or "") for x in ODD]
    other = json_encoder(P.path("word_bpe_49k.json"))
    ends, ids = other(pa.array(["Two Words", None]))
    assert other.whole and ids.tolist() == Tokenizer.from_file(P.path("word_bpe_49k.json")).encode("Two Words", add_special_tokens=False).ids


def test_bpe_by_brute_force_merges(spark):
    encoding = tiktoken_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    import base64

    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}

    def merged(piece):
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[x] for x in parts]

    text = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text")[3].as_py()[:600]
    assert [i for m in regex.findall(P.PATTERN, text) for i in merged(m.encode())] == encoding.encode_ordinary(text)


def test_bpe_digests(spark):
    encoding = tiktoken_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: r for r in bpe.digests(odd(spark), "doc_id").collect()}
    for i, text in enumerate(ODD):
        ids = encoding.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(odd(spark).limit(0), "doc_id").count() == 0
    coded = bpe.decode(bpe.encode(odd(spark))).collect()  # a clashing column "ids" is replaced, the others stay
    assert coded[0].__fields__ == ["doc_id", "text", "ids", "decoded"]
    assert all(r.ids == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in coded)
    raw = spark.createDataFrame([([255],), ([],), (None,)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(raw).collect()] == [encoding.decode_bytes([255]), b"", b""]
    with pytest.raises(Exception, match="outside the rank file"):
        bpe.decode(spark.createDataFrame([([50_256],)], "ids array<int>")).collect()


def test_bpe_query_by_brute_force(spark):
    encoding = tiktoken_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_bpe_roundtrip(spark, SF).collect()}
    ids = {d["doc_id"]: encoding.encode_ordinary(d["text"] or "") for d in rows}
    assert got == {d["doc_id"]: (len(ids[d["doc_id"]]), hashlib.sha256(",".join(map(str, ids[d["doc_id"]])).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()) for d in rows}


@pytest.mark.parametrize("block", [2, 10, 8 << 20])
def test_separator_scan_stitches_blocks(spark, block):
    encoding = tiktoken_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = ["a b c", "", "one two three four five", None, "z"]
    folder = shared_dir(spark)
    written = tokencounts.write_flat(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), folder)
    found = tokencounts.scan(spark, folder, block=block).join(written, ["file", "ordinal"]).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert len(found) == len(texts) and all(r.ended for r in found)


def test_scan_of_a_file_without_last_separator(spark, tmp_path):
    np.array([5, 6, tokencounts.END, tokencounts.END, 7], "<u2").tofile(tmp_path / "x.u16")
    (tmp_path / "empty.u16").touch()
    for block in (2, 4, 100):
        rows = sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in tokencounts.scan(spark, str(tmp_path), block=block).collect())
        assert rows == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]


def token_arrays():
    rng = np.random.default_rng(0)
    yield from (rng.integers(0, 300, 5000).astype(np.uint16), np.zeros(700, np.uint16), np.array([7], np.uint16), np.array([1, 2] * 600, np.uint16))
    yield from (rng.zipf(1.3, 20_000).clip(0, 60_000).astype(np.uint16), rng.integers(0, 200_000, 3000).astype(np.uint32))  # 200,000: beyond 16 bits


def test_wavelet_access_count_find():
    for ids in token_arrays():
        ids[[len(ids) // 2, -1]] = 2
        cut = len(ids) // 2 + 1
        names, lengths, matrix = wavelet.unpack(b"".join(wavelet.pack([1, None], np.array([cut, len(ids) - cut]), ids))) if len(ids) > 1 else wavelet.unpack(b"".join(wavelet.pack([1], np.array([1]), ids)))
        assert names == [1, None][: len(names)] and lengths.sum() == len(ids)
        assert (matrix.tokens() == ids).all() and (matrix.access(np.arange(len(ids))) == ids).all()
        for token in [*np.unique(ids)[:60].tolist(), 299_999]:
            places = np.flatnonzero(ids == token)
            assert matrix.count(token) == len(places) and matrix.count(token, 100, 200) == (ids[100:200] == token).sum()
            if len(places):
                assert (matrix.find(token, np.arange(len(places))) == places).all()
            with pytest.raises(IndexError):
                matrix.find(token, np.array([len(places)]))
    assert wavelet.unpack(b"".join(wavelet.pack([], np.array([], int), np.array([], np.uint16))))[2].n == 0


def test_wavelet_codes_are_huffman_codes():
    import heapq

    counts = np.random.default_rng(2).zipf(1.5, 500).clip(1, 10**6)
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    lengths = wavelet.code_lengths(counts)
    assert int((lengths * counts).sum()) == total
    codes = wavelet.deal_codes(lengths)
    words = {f"{c:032b}"[:n] for c, n in zip(codes.tolist(), lengths.tolist())}
    assert len(words) == 500 and not any(a != b and b.startswith(a) for a in words for b in words)
    steep = np.array([1, 1] + [0] * 43)
    for k in range(2, 45):
        steep[k] = steep[k - 1] + steep[k - 2]
    lengths = wavelet.code_lengths(steep)
    assert lengths.max() <= wavelet.DEEPEST and (0.5 ** lengths.astype(float)).sum() <= 1


def test_wavelet_shard_is_compressed():
    encode = json_encoder(P.path("byte_bpe_50k.json"))
    ends, ids = encode(pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks())
    ids = np.insert(ids, ends[1:], wavelet.END).astype(np.uint16)
    size = sum(map(len, wavelet.pack(list(range(len(ends) - 1)), np.diff(ends + np.arange(len(ends))), ids)))
    assert size < 0.85 * 2 * len(ids)


def test_wavelet_damaged_files():
    ids = np.array([5, 2, 6, 7, 2], np.uint16)
    data = b"".join(wavelet.pack([1, 2], np.array([2, 3]), ids))
    assert wavelet.unpack(data)[2].tokens().tolist() == ids.tolist()
    for bad in (b"", b"x" * 100, data[:20], data[:-9], b"".join(wavelet.pack([1, 2], np.array([1, 4]), ids))):
        with pytest.raises(ValueError):
            wavelet.unpack(bad)


def test_wavelet_shards_round_trip(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = odd(spark).unionByName(spark.createDataFrame([(None, "null id", ""), (-3, "first", "")], "doc_id long, text string, ids string"))
    folder = shared_dir(spark)
    shards = wavelet.write_shards(docs, folder, shard_tokens=50)
    assert shards.count() > 1
    read = wavelet.read_shards(spark, folder).join(wavelet.starts(shards), "name")
    got = {r.doc_id: (r.base + r.offset, r.n_tokens, r.ids_crc32) for r in read.collect()}
    start, want = 0, {}
    for i, text in [(None, "null id"), (-3, "first"), *enumerate(ODD)]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, wavelet.END]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_wavelet_shards_of_a_hot_id(spark):
    """Rows without id, equal ones too, are dealt over all parts, in one order with the others."""
    rows = [(None, "same words here")] * 2000 + [(None, f"text {k}") for k in range(1600)] + [(k, f"own {k}") for k in range(400)]
    docs, folder = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shared_dir(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = wavelet.write_shards(docs, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n_tokens for r in shards.collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
    read = sorted((r.base + r.offset, r.doc_id, r.n_tokens) for r in wavelet.read_shards(spark, folder).join(wavelet.starts(shards), "name").collect())
    assert len(read) == len(rows) and [r[1] for r in read] == [None] * 3600 + list(range(400))
    assert [r[0] for r in read] == np.cumsum([0, *(r[2] for r in read)])[:-1].tolist()


def test_wavelet_query_by_brute_force(spark, tmp_path):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    start, want = 0, {}
    for d in sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, wavelet.END]
        want[d["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.op10_wavelet_shards(spark, SF).collect()} == want
    odd(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert wavelet.op10_wavelet_shards(spark, str(tmp_path)).collect() == []


def test_token_counts_query_by_brute_force(spark, tmp_path):
    encoding = tiktoken_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rows = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    rows += [(None, "null id"), (7, "a repeated row"), (7, "a repeated row"), (9000, None), (9001, "word " * 50_000)]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ordinal string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, ((r.doc_id, r.n_tokens) for r in tokencounts.op9_token_counts(spark, str(tmp_path)).collect())))
    assert got == sorted(str((i, len(encoding.encode_ordinary(t or "")))) for i, t in rows)
    odd(spark).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert tokencounts.op9_token_counts(spark, f"{tmp_path}/none").collect() == []
    with pytest.raises(Exception, match="end id must be free"):
        tokencounts.write_flat(odd(spark), shared_dir(spark), end=11).count()


def sketch_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    shingles = [" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
    hashes = {xxhash.xxh64_intdigest(x.encode()) for x in shingles}
    return {h for h in hashes if h < (1 << 64) // sketch.SCALE} or ({min(hashes)} if len(words) > 5 else hashes)


def test_sketches_follow_descending_ids(spark):
    texts = ["one two three four five six seven", None, "", "a b", "x " * 3000, "a b", "é ü " * 50]
    docs = spark.createDataFrame([(10 * i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, next_text string")
    for size in (1, 3, 100):
        rows = {r.doc_id: r for r in sketch.edited(sketch.with_next(docs.repartition(3), size)).collect()}
        ids = sorted(rows, reverse=True)
        assert len(ids) == len(texts)
        for k, i in enumerate(ids):
            text, follow = texts[i // 10] or "", texts[ids[(k + 1) % len(ids)] // 10] or ""
            half = len(text) // 2
            assert rows[i].next_text == follow and rows[i].edited == text[: len(text) - half] + follow[:half]
    assert sketch.with_next(docs.limit(0)).count() == 0
    one = sketch.with_next(docs.where("doc_id = 0")).collect()
    assert one[0].next_text == texts[0]


def test_ranges_by_bisection():
    from bisect import bisect_right

    rnd = random.Random(7)
    rows = sorted({(rnd.randrange(20), rnd.randrange(-50, 50)) for _ in range(300)})
    for n in (1, 2, 40):
        bounds = sorted([rows[0], *rnd.sample(rows[1:], n - 1)])
        found, first = sketch.ranges_of(*np.array(rows).T, np.array(bounds).T)
        assert found.tolist() == [bisect_right(bounds, r) - 1 for r in rows] and first.tolist() == [r in bounds for r in rows]


def test_sketches_of_a_hot_id(spark):
    """Rows of one id, equal ones too, are dealt over ranges; each text has one successor and is one, null ids come last."""
    rows = [(1, "same")] * 400 + [(1, f"text {k}") for k in range(300)] + [(k, f"own {k}") for k in range(2, 200)] + [(None, "none"), (-(1 << 63), "least")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sketch.with_next(docs, 20)
    got = out.select("*", F.spark_partition_id().alias("p")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, rows)) and sorted(r.next_text for r in got) == sorted(t for _, t in rows)
    follow = {r.text: r.next_text for r in got if r.doc_id != 1}
    assert all(follow[f"own {k}"] == f"own {k - 1}" for k in range(3, 200)) and {follow["none"], follow["least"]} <= {"none", "least", "own 199"}
    assert sum(r.text == "same" and r.next_text != "same" for r in got) == 1
    assert len({r.p for r in got if r.doc_id == 1 and r.text != "same"}) > 5 and len({r.p for r in got if r.text == "same"}) > 1


def test_sketch_query_by_brute_force(spark, tmp_path):
    rows = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()] + [(90_000, None), (90_001, ""), (90_002, "two words"), (90_003, "é" * 70_000)]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, text_sketch string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sketch.op8_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    rows.sort(key=lambda r: -r[0])
    for k, (i, text) in enumerate(rows):
        text, follow = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + follow[:half]
        own, changed, after = map(sketch_by_hand, (text, edit, follow))
        line = lambda x: "".join(f"{h:016x}" for h in sorted(x))
        near = lambda a, b: len(a & b) / min(len(a), len(b))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (line(own), line(changed))
        assert abs(r.near_edited - near(own, changed)) < 1e-12 and abs(r.near_next - near(own, after)) < 1e-12


def test_compared_batches_equal_columns(spark, monkeypatch):
    """What the pairing worker makes of a batch is what the native columns say, for copies of a text too."""
    rows = [(1, "the same text of these words " * 3)] * 30 + [(k, f"é own text {k} of some words and others " * (k % 9)) for k in range(2, 60)] + [(None, None), (70, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    native = sketch.sketch(sketch.edited(sketch.with_next(docs, 20)), "text", "edited", "next_text")
    a, b, c = (F.col(f"{x}_sketch") for x in ("text", "edited", "next_text"))
    native = native.select("doc_id", F.length("text").cast("long"), F.sha2("edited", 256), sketch.digits(a), sketch.digits(b), sketch.containment(a, b), sketch.containment(a, c))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    made = sketch.with_next(docs, 20, sketch.compare_next, schema)
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, map(tuple, native.collect())))


def test_sketch_estimates_containment(spark):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 20_000)]
    part, whole = " ".join(words[:2000]), " ".join(words)
    df = sketch.sketch(spark.createDataFrame([(part, whole)], "a string, b string"), "a", "b")
    row = df.select(sketch.containment(df.a_sketch, df.b_sketch).alias("c"), "a_sketch").first()
    assert row.c > 0.95
    exact = {h for h in sketch.sketch_of(part, scale=1).tolist() if h < (1 << 64) // sketch.SCALE}
    assert exact == set(np.array(row.a_sketch, np.int64).view(np.uint64).tolist())
    assert sketch.merge(df, "a", "a_sketch").count() == len(row.a_sketch)
