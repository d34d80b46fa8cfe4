"""Fill-in-middle transformation over seekable compressed frames.

A text is kept as independent zstandard frames, with the code points before each frame
counted up. A cut is found by the counts and the one frame that holds it; the parts of
an output, and the text read back from it, stream through their frames in order, so
that beside the compressed frames no more than one is open at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

#: Bytes of text in a frame.
FRAME = 1 << 16
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of texts that stay plain, and of the others those whose suffix comes first.
PLAIN_SHARE, SPM_SHARE = 10, 20
FRAMES = "array<struct<units: long, bytes: long, data: binary>>"
_compressor, _decompressor = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
_FRAME_TYPE = pa.list_(pa.struct([("units", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))


def starts_of(data: bytes) -> np.ndarray:
    """Places of the bytes that begin a code point."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


@dataclass
class Frames:
    """Compressed frames, with the code points and bytes up to the end of each."""

    data: list[bytes] = field(default_factory=list)
    units: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    opened: int = 0  # frames decompressed so far
    last: tuple[int, bytes] = (-1, b"")

    @classmethod
    def of(cls, pieces: Iterable[bytes], frame: int = FRAME) -> Frames:
        """Frames of at least 1 and at most ``frame`` bytes (or one code point) of the pieces put together, cut between code points."""
        made, held = cls(), bytearray()

        def close(size: int) -> None:
            while 0 < size < len(held) and held[size] & 0xC0 == 0x80:
                size -= 1
            while not size or size < len(held) and held[size] & 0xC0 == 0x80:  # a code point of more bytes than a frame
                size += 1
            part = bytes(held[:size])
            del held[: len(part)]
            made.data.append(_compressor.compress(part))
            made.units.append((made.units[-1] if made.units else 0) + len(starts_of(part)))
            made.sizes.append((made.sizes[-1] if made.sizes else 0) + len(part))

        for piece in pieces:
            for at in range(0, len(piece), frame):
                held += piece[at : at + frame]
                while len(held) > frame + 3:
                    close(frame)
        while held:
            close(min(frame, len(held)))
        return made

    @property
    def n(self) -> int:
        return self.units[-1] if self.units else 0

    @property
    def size(self) -> int:
        return self.sizes[-1] if self.sizes else 0

    def open(self, k: int) -> bytes:
        """The bytes of a frame; the one opened last stays open."""
        if self.last[0] != k:
            self.opened += 1
            self.last = k, _decompressor.decompress(self.data[k])
        return self.last[1]

    def place(self, unit: int) -> int:
        """The byte at which a code point begins, 0 and all of them without opening a frame."""
        k = int(np.searchsorted(self.units, unit, "right"))
        before = (self.units[k - 1], self.sizes[k - 1]) if k else (0, 0)
        if unit == before[0]:
            return before[1]
        return before[1] + int(starts_of(self.open(k))[unit - before[0]])

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The bytes from start up to stop, a frame at a time."""
        stop = self.size if stop is None else stop
        k = int(np.searchsorted(self.sizes, start, "right"))
        while start < stop:
            base = self.sizes[k - 1] if k else 0
            yield self.open(k)[start - base : stop - base]
            start, k = self.sizes[k], k + 1

    def find(self, mark: bytes, start: int = 0) -> int:
        """Where a short mark first begins at or after a byte, -1 if nowhere; marks may lie across frames."""
        at, rest = start, b""
        for part in self.stream(start):
            part = rest + part
            if (found := part.find(mark)) >= 0:
                return at + found
            rest = part[len(part) - min(len(part), len(mark) - 1) :]
            at += len(part) - len(rest)
        return -1


def output_of(text: Frames, form: str, first: int, second: int) -> Iterator[bytes]:
    """The output of a text that is cut at two code points: the marks, and the parts in the form's order."""
    if form == "plain":
        yield from text.stream()
        return
    a, b = text.place(first), text.place(second)
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, text.size)}
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield mark
        yield from text.stream(*parts[mark])


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text of an output, whose marks are looked up in it.

    Marks stand once each, as texts that hold one stay plain and no mark begins as
    another one ends. An output without its marks raises ValueError.
    """
    if form == "plain":
        yield from output.stream()
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    places, at = [], 0
    for mark in order:
        places.append(output.find(mark, at))
        if places[-1] < 0 or places[0]:
            raise ValueError("an output without its marks")
        at = places[-1] + len(mark)
    spans = dict(zip(order, zip([p + len(m) for p, m in zip(places, order)], [*places[1:], output.size])))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*spans[mark])


def digest(pieces: Iterable[bytes]) -> str:
    found = sha256()
    for piece in pieces:
        found.update(piece)
    return found.hexdigest()


def _packed(some: list[Frames]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x.data) for x in some)])
    columns = [pa.array([v for x in some for v in getattr(x, name)], kind) for name, kind in (("units", pa.int64()), ("sizes", pa.int64()), ("data", pa.binary()))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["units", "bytes", "data"]))


def _unpacked(value: pa.Scalar) -> Frames:
    held = value.values if value.is_valid else pa.array([], _FRAME_TYPE.value_type)
    return Frames(held.field("data").to_pylist(), held.field("units").to_pylist(), held.field("bytes").to_pylist())


def compress(df: DataFrame, text: str = "text", out: str = "frames", frame: int = FRAME) -> DataFrame:
    """Add the text as seekable frames. Null and empty texts have none; equal texts have equal frames."""

    @F.arrow_udf(FRAMES)
    def framed(batch: pa.Array) -> pa.Array:
        return _packed([Frames.of([x.as_py() or b""], frame) for x in batch])

    return df.withColumn(out, framed.asNondeterministic()(F.col(f"`{text}`").cast("binary")))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits drawn by seed and id; a null id is drawn as an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def plan(docs: DataFrame, seed: int = 1, frame: int = FRAME) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames) of each (doc_id, text); other columns are left out.

    Lengths, forms and cuts are native; null texts are empty, empty ones and those that
    hold a mark are plain. Repeated ids are drawn alike, each row with its own text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text").cast("long"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark.decode()))
    plain = (F.col("n") == 0) | marked | (h3 % 100 >= 100 - PLAIN_SHARE)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_SHARE, "spm").otherwise("psm")
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.select("doc_id", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"), "text")
    rows = compress(rows, frame=frame)
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), "frames")


def transform(planned: DataFrame, out: str = "output", frame: int = FRAME) -> DataFrame:
    """Add the output of each row of ``plan`` as frames of its own; only frames that a cut goes through are opened to find it."""

    @F.arrow_udf(FRAMES)
    def made(frames: pa.Array, form: pa.Array, prefix: pa.Array, middle: pa.Array) -> pa.Array:
        cuts = zip(frames, form.to_pylist(), prefix.to_pylist(), middle.to_pylist())
        return _packed([Frames.of(output_of(_unpacked(x), kind, a or 0, (a or 0) + (b or 0)), frame) for x, kind, a, b in cuts])

    return planned.withColumn(out, made.asNondeterministic()("frames", "form", "prefix_chars", "middle_chars"))


def restore(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored", frame: int = FRAME) -> DataFrame:
    """Add the frames of the text that an output was made of, from the output and its form alone."""

    @F.arrow_udf(FRAMES)
    def made(frames: pa.Array, forms: pa.Array) -> pa.Array:
        return _packed([Frames.of(restored(_unpacked(x), kind), frame) for x, kind in zip(frames, forms.to_pylist())])

    return df.withColumn(out, made.asNondeterministic()(F.col(f"`{output}`"), F.col(f"`{form}`")))


def expand(df: DataFrame, frames: str, out: str) -> DataFrame:
    """Add the whole text of a column of frames."""

    @F.arrow_udf("string")
    def whole(batch: pa.Array) -> pa.Array:
        return pa.array([b"".join(_unpacked(x).stream()).decode() for x in batch], pa.string())

    return df.withColumn(out, whole.asNondeterministic()(F.col(f"`{frames}`")))


def digests(planned: DataFrame) -> DataFrame:
    """output_sha256 and restored_sha256 after the columns of ``plan``, without its frames.

    As by ``transform`` and ``restore``, but in one Python worker and a frame at a
    time: the output is framed, and the text streams out of these frames.
    """

    @F.arrow_udf("struct<output_sha256: string, restored_sha256: string>")
    def made(frames: pa.Array, form: pa.Array, prefix: pa.Array, middle: pa.Array) -> pa.Array:
        found = []
        for x, kind, a, b in zip(frames, form.to_pylist(), prefix.to_pylist(), middle.to_pylist()):
            output = Frames.of(output_of(_unpacked(x), kind, a or 0, (a or 0) + (b or 0)))
            found.append({"output_sha256": digest(output.stream()), "restored_sha256": digest(restored(output, kind))})
        return pa.array(found, pa.struct([("output_sha256", pa.string()), ("restored_sha256", pa.string())]))

    rows = planned.withColumn("__made", made.asNondeterministic()("frames", "form", "prefix_chars", "middle_chars"))
    return rows.select(*[F.col(f"`{c}`") for c in planned.columns if c != "frames"], "__made.output_sha256", "__made.restored_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(materialize(plan(table(spark, sf_dir, "documents"))))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {
    "op13_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), drawn AS (
            SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                     WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), parts AS (
            SELECT *, least(a, b) AS p, greatest(a, b) AS q, substring(text, 1, least(a, b)) AS prefix,
                substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substring(text, greatest(a, b) + 1) AS suffix
            FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts
    """
}
