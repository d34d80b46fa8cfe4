"""Merkle manifest of a dataset, with a proof for every row.

Rows find their places by rank queries instead of a sort: the ids of each source are a
bitmap of 64-bit words, of which only those with an id are kept; partial words are
merged by "or" before the shuffle. A directory of counts over the words, in blocks of
1,024 at each level, gives the rows before a word, and a popcount inside the word the
rest. Places deal digests to arrays of 243 slots, which are five levels of the tree
each, so that no source is ever gathered; their roots are dealt again until one is left.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, table

FAN, LEVELS = 3, 5
SLOTS = FAN**LEVELS
#: Words of a directory's block, as bits, and the number that makes words of all ids positive; null ids have word 0.
BLOCK_BITS, SHIFT = 10, (1 << 57) + 1
#: Equal rows that are given places by one task.
COPIES_A_TASK = 10_000
ALL = "*"


def item(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[item(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], item(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, tampered) of every row of documents; other columns play no part.

    ``source`` is a key that sorts as the tree does: `-` for null, `=` before others.
    ``tampered`` is the leaf without line feeds where 2 divides the id's checksum, null
    for others, for texts that hold none, and for rows without id.
    """
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(hit, leaf_of(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return docs.select(source.alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("leaf"), tampered.alias("tampered"))


def directory(rows: DataFrame) -> DataFrame:
    """(source, word, bits, n, base, total): the words of each source's bitmap of ids, their rows, the rows before them, and all of the source.

    Blocks of words are summed level by level until each source has one, and the sums
    come back down, so that no window holds more than a block.
    """
    words = materialize(rows.groupBy("source", "word").agg(F.bit_or(F.expr("shiftleft(1L, low)")).alias("bits"), F.count("*").alias("n")))
    low, high = words.agg(F.min("word"), F.max("word")).first()
    levels, depth = [words.select("source", F.col("word").alias("cell"), "n")], 0
    while low is not None and low >> depth * BLOCK_BITS != high >> depth * BLOCK_BITS:
        depth += 1
        block = F.shiftright("cell", BLOCK_BITS).alias("cell")
        levels.append(materialize(levels[-1].groupBy("source", block).agg(F.sum("n").alias("n"))))
    above = levels.pop().select("source", "cell", F.lit(0).cast("long").alias("base"), F.col("n").alias("total"))
    while levels:
        parent = F.shiftright("cell", BLOCK_BITS)
        earlier = Window.partitionBy("source", "parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = levels.pop().withColumn("parent", parent).withColumn("inner", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        above = above.withColumnRenamed("cell", "parent")
        above = cells.join(above, ["source", "parent"]).select("source", "cell", (F.col("base") + F.col("inner")).alias("base"), "total")
    return materialize(words.join(above.withColumnRenamed("cell", "word"), ["source", "word"]))


def counted_before(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Add ``before``: the weight of all rows that are less by the keys. Rows are dealt by ranges, whose sums are one row each."""
    ranges = materialize(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    sums = ranges.groupBy("range").agg(F.sum(weight).alias("n"))
    sums = sums.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inner", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return ranges.join(sums, "range").withColumn("before", F.col("earlier") + F.col("inner")).drop("range", "inner", "earlier")


def placed(rows: DataFrame) -> DataFrame:
    """(source, n, pos, doc_id, leaf, tampered): the place of each leaf in its source and the leaves of the source.

    Places ascend by doc_id, null ids first; rows that share an id are in the order of
    their leaves. A word of the bitmap in which ids repeat has more rows than bits: its
    rows are counted by ranges of (id, leaf), equal rows as one.
    """
    word, low = F.shiftright("doc_id", 6) + F.lit(SHIFT), F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    rows = rows.withColumns({"word": F.coalesce(word, F.lit(0).cast("long")), "low": F.coalesce(low, F.lit(0))})
    words = directory(rows)
    repeats = F.col("n") > F.bit_count("bits")
    columns = ["source", F.col("total").alias("n"), "pos", "doc_id", "leaf", "tampered"]
    ranked = rows.join(words, ["source", "word"])
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, low)"))
    out = ranked.where(~repeats).withColumn("pos", F.col("base") + below).select(columns)
    if words.where(repeats).isEmpty():
        return out
    same = ranked.where(repeats).groupBy("source", "word", "base", "total", "doc_id", "leaf", "tampered").agg(F.count("*").alias("copies"))
    same = materialize(counted_before(same, ["source", "word", "doc_id", "leaf"], "copies"))
    firsts = same.groupBy("source", "word").agg(F.min("before").alias("first"))
    same = same.join(firsts, ["source", "word"]).withColumn("start", F.col("base") + F.col("before") - F.col("first"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_A_TASK).cast("long")))
    same = same.withColumn("block", block).repartition("source", "doc_id", "leaf", "block")
    last = F.least(F.col("block") + COPIES_A_TASK, "copies") - 1
    same = same.withColumn("copy", F.explode(F.sequence("block", last)))
    return out.unionByName(same.withColumn("pos", F.col("start") + F.col("copy")).select(columns))


def height(n: int) -> int:
    """Levels above n nodes, inside one array of slots."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


def climb(nodes: list[str], n: int) -> list[list[str]]:
    """The nodes of all levels above an array of slots, itself first; n is the number of nodes beside it and in it."""
    found = [nodes]
    for _ in range(height(n)):
        nodes = [sha256("".join(nodes[k : k + FAN]).encode()).hexdigest() for k in range(0, len(nodes), FAN)]
        found.append(nodes)
    return found


def siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """The others of the runs that a slot goes through, level by level: those to the left and to the right."""
    found = []
    for nodes in levels[:-1]:
        run, k = nodes[slot // FAN * FAN : slot // FAN * FAN + FAN], slot % FAN
        found.append(("".join(run[:k]), "".join(run[k + 1 :])))
        slot //= FAN
    return found


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = sha256((left + node + right).encode()).hexdigest()
    return node


def slotted(slots: list[dict]) -> list[dict]:
    """The entries of an array of slots, each in its own."""
    found = [None] * len(slots)
    for entry in slots:
        found[entry["slot"]] = entry
    return found


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _root(slots: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array([climb([x["node"] for x in slotted(some.as_py())], k)[-1][0] for some, k in zip(slots, n.to_pylist())], pa.string())


def _paths(slots: pa.Array, n: pa.Array, path: pa.Array) -> pa.Array:
    found = []
    for some, k, rest in zip(slots, n.to_pylist(), path.to_pylist()):
        levels = climb([x["node"] for x in slotted(some.as_py())], k)
        found.append([{"slot": i, "path": [{"left": a, "right": b} for a, b in siblings(levels, i)] + rest} for i in range(len(levels[0]))])
    return pa.array(found, pa.list_(pa.struct([("slot", pa.int32()), ("path", _PATH)])))


def _proofs(slots: pa.Array, n: pa.Array, path: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("leaf", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]))
    found = []
    for some, k, rest in zip(slots, n.to_pylist(), path.to_pylist()):
        entries = slotted(some.as_py())
        levels = climb([x["node"] for x in entries], k)
        above = [(x["left"], x["right"]) for x in rest]
        tail, top = "".join(a + b for a, b in above), levels[-1][0]
        root, proofs = fold(top, above), []
        for slot, entry in enumerate(entries):
            own = siblings(levels, slot)
            reached = fold(entry["tampered"] or entry["node"], own)
            proof = sha256(("".join(a + b for a, b in own) + tail).encode()).hexdigest()
            proofs.append({"doc_id": entry["doc_id"], "leaf": entry["node"], "proof_sha256": proof, "folded_root": root if reached == top else fold(reached, above)})
        found.append(proofs)
    return pa.array(found, kind)


def udf(function, kind: str):
    return F.arrow_udf(function, kind).asNondeterministic()


def slot_paths() -> Column:
    """(slot, path) of each slot of an array, exploded."""
    return F.explode(udf(_paths, "array<struct<slot: int, path: array<struct<left: string, right: string>>>>")("slots", "n", "path"))


def dealt(nodes: DataFrame, *more: str) -> DataFrame:
    """(source, g, n, slots, root): nodes (source, n, pos, node) in arrays of ``SLOTS`` slots, with the root of each."""
    slots = F.collect_list(F.struct((F.col("pos") % SLOTS).cast("int").alias("slot"), "node", *more)).alias("slots")
    groups = nodes.groupBy("source", F.floor(F.col("pos") / SLOTS).alias("g"), "n").agg(slots)
    return materialize(groups.withColumn("root", udf(_root, "string")("slots", "n")), keep=True)


def forest(nodes: DataFrame, *more: str) -> list[DataFrame]:
    """The arrays of slots of each round, until every source has one array."""
    rounds = [dealt(nodes, *more)]
    while not (rest := rounds[-1].where(F.col("n") > SLOTS)).isEmpty():
        rounds.append(dealt(rest.select("source", F.ceil(F.col("n") / SLOTS).alias("n"), F.col("g").alias("pos"), F.col("root").alias("node"))))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(source, root) of each tree."""
    found = [x.where(F.col("n") <= SLOTS).select("source", "root") for x in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(source, g, path): the siblings above each array of the first round; ``above`` (source, path) has those above each tree's root."""
    known = None
    for k in range(len(rounds) - 1, -1, -1):
        last = rounds[k].where(F.col("n") <= SLOTS).select("source", "g").join(above, "source")
        known = last if known is None else last.unionByName(known)
        if k:
            each = rounds[k].join(known, ["source", "g"]).select("source", "g", slot_paths().alias("x"))
            known = materialize(each.select("source", (F.col("g") * SLOTS + F.col("x.slot")).alias("g"), "x.path"))
    return known


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of documents.

    Nulls in any column are leaves' values of their own; a null source is the first,
    null ids are a source's first, repeated ids are in the order of their leaves and
    equal rows stand next to each other, each with its own proof. No rows, no result.
    """
    spark = docs.sparkSession
    with scratch(spark):
        rows = materialize(leaves(docs))
        trees = forest(placed(rows).withColumnRenamed("leaf", "node"), "doc_id", "tampered")
        subroots = materialize(tops(trees).withColumn("one", F.lit(1).cast("long")), keep=True)
        order = counted_before(subroots, ["source"], "one")
        n = subroots.count()
        above = forest(order.select(F.lit(ALL).alias("source"), F.lit(n).cast("long").alias("n"), F.col("before").alias("pos"), F.col("root").alias("node"), F.col("source").alias("named")), "named")
        start = spark.createDataFrame([(ALL, [])], "source string, path array<struct<left: string, right: string>>")
        upper = above[0].join(paths(above, start), ["source", "g"]).select("slots", slot_paths().alias("x"))
        upper = upper.withColumn("source", F.filter("slots", lambda s: s["slot"] == F.col("x.slot"))[0]["named"]).select("source", F.col("x.path").alias("path"))
        top = tops(above).select(F.col("root"))
        found = materialize(paths(trees, materialize(upper)), keep=True)
        root = top.first()
    heads = subroots.select("source", F.col("root").alias("subroot"))
    each = trees[0].drop("root").join(found, ["source", "g"]).join(heads, "source")
    each = each.select("subroot", F.explode(udf(_proofs, "array<struct<doc_id: long, leaf: string, proof_sha256: string, folded_root: string>>")("slots", "n", "path")).alias("x"))
    return each.select("x.doc_id", "x.leaf", "subroot", F.lit(root[0] if root else None).alias("root"), "x.proof_sha256", "x.folded_root").withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {
    "op12_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, text, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS src,
                concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b:
                    list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) & 1 = 1 AS hit
            FROM documents
        ), leaves AS (
            SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN hit THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM d
        ), placed AS (
            SELECT doc_id, src, leaf, coalesce(tampered, leaf) AS changed, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
        ), up AS (
            SELECT src, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY src) AS n FROM placed
            UNION ALL
            SELECT src, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY src, level, pos // 3
        ), subroots AS (
            SELECT src, node, level AS height, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
        ), over AS (
            SELECT 0 AS level, pos, node, n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM over WHERE n > 1 GROUP BY level, pos // 3
        ), runs AS (
            SELECT src, level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM up WHERE n > 1 GROUP BY ALL
            UNION ALL
            SELECT '*', level, pos // 3, list(node ORDER BY pos) FROM over WHERE n > 1 GROUP BY ALL
        ), walk AS (
            SELECT doc_id, leaf, src AS home, src, 0 AS level, pos, changed AS node, '' AS proof FROM placed
            UNION ALL
            SELECT w.doc_id, w.leaf, w.home, CASE WHEN r.nodes IS NULL THEN '*' ELSE w.src END, CASE WHEN r.nodes IS NULL THEN 0 ELSE w.level + 1 END,
                CASE WHEN r.nodes IS NULL THEN s.pos ELSE w.pos // 3 END,
                CASE WHEN r.nodes IS NULL THEN w.node ELSE sha256(list_aggregate(r.nodes[:w.pos % 3] || [w.node] || r.nodes[w.pos % 3 + 2:], 'string_agg', '')) END,
                CASE WHEN r.nodes IS NULL THEN w.proof ELSE w.proof || coalesce(list_aggregate(r.nodes[:w.pos % 3] || r.nodes[w.pos % 3 + 2:], 'string_agg', ''), '') END
            FROM walk w LEFT JOIN runs r ON w.src = r.src AND w.level = r.level AND w.pos // 3 = r.run LEFT JOIN subroots s ON w.src = s.src
            WHERE w.src <> '*' OR r.nodes IS NOT NULL
        )
        SELECT w.doc_id, w.leaf, s.node AS subroot, o.node AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = o.node AS verified
        FROM walk w JOIN subroots s ON w.home = s.src JOIN over o ON o.n = 1
        WHERE w.src = '*' AND w.level = o.level
    """
}
