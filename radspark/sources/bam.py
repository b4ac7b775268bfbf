"""Binary alignment files cut at the borders of their compressed blocks, so that a file is read by many tasks.

The blocks' headers share a run of bytes, at which Spark's line reader can cut: a "line" is what follows it, a block's size and content. Each split of a file
is unpacked block by block. Where its first record begins is not written anywhere: it is the first place from which records follow one another; what is before it belongs to
the record that the split before it began. As the run of bytes may come up by chance within a block, a split likewise leaves what cannot be a block at its beginning to the split before.
These ends and beginnings, one of each a split, are put together and must make up whole records exactly, which also proves the places right; else reading fails.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What stands in a block's header before its size, as far as it is ASCII, and before that; bases and operations by number.
MARK, BEFORE = b"\x06\x00BC\x02\x00", 10
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
RECORD = "name string, flag int, ref int, pos long, mapq int, cigar string, seq string, qual string"
_FIELDS = [c.split()[0] for c in RECORD.split(", ")]
_SPLIT = f"file string, block long, idx long, {RECORD}, head binary, tail binary, lead binary, cut binary, n long, names array<string>"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _SPLIT.split(", ")])
CHAIN = 12  # records that must follow one another


def header(raw: bytes) -> tuple[list[str], int] | None:
    """Names of the reference sequences and the header's length; None if there is not enough of it."""
    try:
        if raw[:4] != b"BAM\1":
            if len(raw) < 4:
                return None
            raise ValueError("not a BAM file")
        at = 8 + struct.unpack_from("<i", raw, 4)[0]
        (n,) = struct.unpack_from("<i", raw, at)
        at += 4
        names = []
        for _ in range(n):
            (size,) = struct.unpack_from("<i", raw, at)
            if at + 8 + size > len(raw):
                return None
            names.append(raw[at + 4 : at + 3 + size].decode())
            at += 8 + size
        return names, at
    except struct.error:
        return None


def record(raw: bytes, at: int) -> tuple:
    """The fields of the record at a place."""
    _, ref, pos, l_name, mapq, _, n_ops, flag, l_seq = struct.unpack_from("<iiiBBHHHi", raw, at)
    p = at + 36
    name = raw[p : p + l_name - 1].decode()
    p += l_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, p)
    p += 4 * n_ops
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in raw[p : p + (l_seq + 1) // 2])[:l_seq]
    p += (l_seq + 1) // 2
    qual = raw[p : p + l_seq]
    return name, flag, ref, pos, mapq, "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*", seq, "*" if qual[:1] == b"\xff" else "".join(chr(33 + q) for q in qual)


def follows(raw: bytes, at: int, chain: int = CHAIN) -> bool:
    """Whether records follow one another from a place, as many as there are, up to `chain`; at least one must be whole."""
    for k in range(chain):
        if at + 36 > len(raw):
            return k > 0
        size, ref, pos, l_name, _, _, n_ops, _, l_seq = struct.unpack_from("<iiiBBHHHi", raw, at)
        if ref < -1 or pos < -1 or l_name < 2 or l_seq < 0 or size < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq or size > 1 << 28:
            return False
        end = at + 36 + l_name
        if end > len(raw):
            return k > 0
        name = raw[at + 36 : end]
        if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
            return False
        at += 4 + size
        if at > len(raw):
            return k > 0
    return True


def unpacked(value: bytes) -> bytes | None:
    """A block's content from what follows the mark; None if that is too short, as where the mark comes up by chance within a block. Raises where it is no block."""
    if len(value) < 2:
        return None
    size = struct.unpack_from("<H", value)[0] + 1 - 16
    if len(value) < size:
        return None
    if len(value) not in (size, size + BEFORE) or len(value) > size and value[size : size + 4] != b"\x1f\x8b\x08\x04":
        raise ValueError("blocks of this file have headers of another kind; it cannot be split")
    content = zlib.decompress(value[2 : size - 8], -15)
    if struct.unpack_from("<II", value, size - 8) != (zlib.crc32(content), len(content)):
        raise ValueError("a block's checksum is wrong")
    return content


def all_unpacked(data: bytes) -> bytes:
    """The content of whole blocks one after another, from what follows the first one's mark."""
    out, at = [], 0
    while at < len(data):
        size = struct.unpack_from("<H", data, at)[0] + 1 - 16
        content = unpacked(data[at : at + size + BEFORE])
        if content is None:
            raise ValueError("a block lacks its end")
        out.append(content)
        at += size + BEFORE
        if at < len(data) and data[at : at + len(MARK)] != MARK:
            raise ValueError("a block does not follow another")
        at += len(MARK)
    return b"".join(out)


class Split:
    """The records of one split, as its blocks come."""

    def __init__(self, file: str, block: int) -> None:
        self.file, self.block, self.raw, self.n = file, block, b"", 0
        self.head: bytes | None = None if block else b""
        self.names: list[str] | None = None
        self.part = b""  # of a block whose content has the mark in it
        self.begun = False
        self.lead: list[bytes] | None = [] if block else None  # what comes before the first block

    def add(self, value: bytes) -> Iterator[tuple]:
        if not self.begun and not self.block:
            self.begun = True  # what stands before the first mark
            return
        if self.lead is not None and not self.begun:
            try:
                self.begun = unpacked(value) is not None
            except (ValueError, zlib.error):
                self.begun = False
            if not self.begun:
                self.lead.append(value)
                return
        self.part = self.part + MARK + value if self.part else value
        content = unpacked(self.part)
        if content is None:
            return
        self.part = b""
        self.raw += content
        if not self.block and self.names is None:
            got = header(self.raw)
            if not got:
                return
            self.names, at = got
            self.raw = self.raw[at:]
        if self.head is None:
            if len(self.raw) < 1 << 17:
                return
            self.find()
        yield from self.records()

    def find(self) -> None:
        at = next((i for i in range(len(self.raw)) if follows(self.raw, i)), None)
        if at is None and self.raw:
            raise ValueError("no record begins in a split; make the splits larger")
        self.head, self.raw = self.raw[: at or 0], self.raw[at or 0 :]

    def records(self) -> Iterator[tuple]:
        at = 0
        while at + 4 <= len(self.raw):
            size = struct.unpack_from("<i", self.raw, at)[0] + 4
            if at + size > len(self.raw):
                break
            yield (self.file, self.block, self.n, *record(self.raw, at), *[None] * 6)
            self.n += 1
            at += size
        self.raw = self.raw[at:]

    def end(self) -> Iterator[tuple]:
        if self.head is None:
            self.find()
        yield from self.records()
        lead = MARK.join(self.lead or [])
        if self.n or self.raw or self.head or lead or self.part or self.names is not None:
            yield (self.file, self.block, None, *[None] * len(_FIELDS), self.head, self.raw, lead, self.part, self.n, self.names)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, now = [], None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    for b in batches:
        for file, block, value in zip(*(b.column(n).to_pylist() for n in ("file", "block", "value")), strict=True):
            if now is None or (now.file, now.block) != (file, block):
                held += now.end() if now else ()
                now = Split(file, block)
            held += now.add(value)
            if len(held) >= 10_000:
                yield out()
                held = []
    held += now.end() if now else ()
    if held:
        yield out()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a split leaves at its end and the next one at its beginning, as whole records; their number."""
    for b in batches:
        rows = []
        for file, tail, cut, lead, head in zip(*(b.column(c).to_pylist() for c in ("file", "tail", "cut", "lead", "head")), strict=True):
            raw, at, m = tail + all_unpacked(cut + MARK + lead if cut and lead else cut or lead) + head, 0, 0
            while at + 36 <= len(raw):
                at += struct.unpack_from("<i", raw, at)[0] + 4
                m += 1
            if at != len(raw):
                raise ValueError(f"the records of {file} do not fit together where it was split; make the splits larger")
            rows.append((raw, m))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file", "block", "n", "names")), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["file", "block", "n", "names", "raw", "m"])


def _glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = pa.schema([_SCHEMA.field(i) for i in range(3 + len(_FIELDS))])
    for b in batches:
        rows = []
        for file, block, n, raw in zip(*(b.column(c).to_pylist() for c in ("file", "block", "n", "raw")), strict=True):
            at = 0
            while at < len(raw):
                rows.append((file, block, n, *record(raw, at)))
                at, n = at + struct.unpack_from("<i", raw, at)[0] + 4, n + 1
        cols = list(zip(*rows, strict=True)) or [()] * len(kept)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kept, strict=True)], schema=kept)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line, name, flag, chr, pos, mapq, cigar, seq, qual) of every record; block is the split's start, line counts a file's records from 0."""
    from ..operators.graphs import written

    text = spark.read.option("lineSep", MARK.decode()).text(path)
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    t = written(raw.mapInArrow(_splits, _SPLIT), "alignments")[0]
    edges = t.where("tail is not null").select("file", "block", "head", "tail", "lead", "cut", "n", "names")  # a row a split
    order = Window.partitionBy("file").orderBy("block")
    none = F.lit(bytearray())
    after = lambda c: F.coalesce(F.lead(c).over(order), none).alias(c)
    edges = edges.select("file", "block", "n", "names", "tail", "cut", after("lead"), after("head"))
    edges = written(edges.mapInArrow(_joined, "file string, block long, n long, names array<string>, raw binary, m long"), "splits")[0]
    edges = edges.withColumn("before", F.coalesce(F.sum(F.col("n") + F.col("m")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = edges.where("names is not null").select("file", "names")  # a row a file
    glued = edges.where("m > 0").select("file", "block", "n", "raw").mapInArrow(_glued, f"file string, block long, idx long, {RECORD}")
    every = t.where("tail is null").select("file", "block", "idx", *_FIELDS).unionByName(glued)
    every = every.join(F.broadcast(edges.select("file", "block", "before")), ["file", "block"]).join(F.broadcast(names), "file")
    chr_ = F.when(F.col("ref") >= 0, F.get("names", F.col("ref"))).otherwise("*")
    return every.select("file", "block", (F.col("before") + F.col("idx")).alias("line"), "name", "flag", chr_.alias("chr"), "pos", "mapq", "cigar", "seq", "qual")
