"""Token sequences packed with whole documents: sure choices fixed by dominance, the rest by best fit.

A document's tokens and an end token are one piece, or pieces of CAPACITY tokens and a last shorter one if it is longer. All that packing asks of
a piece is its length, so it works on the number of pieces of each length (at most CAPACITY numbers, whatever the corpus), and what it
decides is a list of patterns: so many sequences, each of such lengths in this order.

First, Martello and Toth's reduction. A set of pieces dominates another if the other's pieces can be grouped so that each group is no longer than a
piece of its own in the first; if a set with piece j dominates all feasible sets with j, some best packing has it as a sequence. From the longest length down, sets
of one to three are tried: j alone if nothing fits beside it; j and the longest k that fits, if they fill the sequence, or if k is no shorter than any pair
that fits beside j while no three do; j with a pair, if that pair dominates every other pair and single that fits. What is fixed leaves the
instance, and the rounds go on until none is fixed. As a smaller instance has no new feasible sets, a set is fixed as often as its lengths last.
Then the remainder, longest first, goes where it leaves least room, again for all sequences of equal room at once.

Pieces get their place by rank among those of equal length: tasks number theirs as they tokenize, counts by task and length are summed up in task order, and the
rank says which sequence of which pattern takes the piece. A pattern list has a few thousand rows at most and goes to all tasks; a length that a third of all pieces
share is split among the tasks that made them.

Words are tokenized apart, as the tokenizer does not look across ASCII white space, and remembered in the worker within a bound; a long text is worked
through in stretches cut at white space, and one word is encoded as a whole. Null and empty texts hold the end token alone. Equal rows are pieces of their own, ids may be null or
repeat, no rows give no rows. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, text_buffers, written

CAPACITY = 2048
END = 0
STRETCH = 1 << 20  # bytes of text tokenized at once
REMEMBERED = 1 << 20  # words that a worker remembers: some 200 MB
_SIGNS = b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

# ---------------------------------------------------------------- tokens


class Words:
    """Ids of a text's words as little-endian 32-bit numbers. New words are encoded together, and the places that their tokens come from tell them apart. The tokenizer lowers letters
    and cuts between a letter or digit and what is neither, so an ASCII word counts as its lower case, and as its beginning and the signs that end it."""

    def __init__(self, path: str, most: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.words: dict[bytes, bytes] = {}

    def encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        text = b" ".join(words).decode("utf-8", "replace")
        found = self.tokenizer.encode(text, add_special_tokens=False)
        raw = np.array(found.ids, "<u4").tobytes()
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
        to = (4 * np.searchsorted([a for a, _ in found.offsets], ends)).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *to[:-1]], to, strict=True)}

    def learned(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words, which are remembered."""
        cut: dict[bytes, tuple[bytes, bytes]] = {}
        known, lacking = self.words, set()
        for w in words:
            core, signs = w, b""
            if w.isascii() and b"<" not in w:  # no special token
                low = w.lower()
                core = low.rstrip(_SIGNS)
                if core[-1:].isalnum():
                    signs = low[len(core) :]
                    if signs and signs not in known:
                        lacking.add(signs)
                else:
                    core = low
            cut[w] = core, signs
            if core not in known:
                lacking.add(core)
        new = self.encoded(list(lacking)) if lacking else {}
        for w, (core, signs) in cut.items():
            ids = new[core] if core in new else known[core]
            new[w] = ids + (new[signs] if signs in new else known[signs]) if signs else ids
        if len(self.words) + len(new) > self.most:
            self.words = {}
        if len(new) <= self.most:
            self.words.update((w, i) for w, i in new.items() if len(w) <= 64)
        return new

    def ids(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            to = cut.end() if cut else len(text)
            words = text[at:to].split(None)
            found = list(map(self.words.get, words))
            if None in found:
                new = self.learned({w for w, f in zip(words, found, strict=True) if f is None})
                found = [new[w] if f is None else f for w, f in zip(words, found, strict=True)]
            out.append(b"".join(found))
            at = to
        return b"".join(out)


_loaded: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The tokenizer of a file, loaded once by a worker."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECE = "piece int, start long, length long, ids_crc32 long, task int, place long"


def _pieces(schema: pa.Schema, path: str | None, capacity: int, end: int, keep_ids: bool):
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, seen = words_of(path or default_tokenizer()), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            buf, off = text_buffers(b.column("text"))
            cols: dict[str, list] = {n: [] for n in ("row", "piece", "start", "length", "ids_crc32", "place", "ids")}

            def out(b=b):
                got = {n: cols[n] for n in cols if n in schema.names} | {"task": [task] * len(cols["row"])}
                got["doc_id"] = b.column("doc_id").take(pa.array(cols["row"], pa.int64()))
                return pa.RecordBatch.from_arrays([got[f.name] if f.name == "doc_id" else pa.array(got[f.name], f.type) for f in schema], schema=schema)

            held = 0
            for i in range(b.num_rows):
                ids = tok.ids(buf[off[i] : off[i + 1]].tobytes()) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    raw = ids[at : at + 4 * capacity]
                    n = len(raw) // 4
                    for name, value in zip(cols, (i, k, at // 4, n, zlib.crc32(raw), int(seen[n]), raw), strict=True):
                        if name != "ids" or keep_ids:
                            cols[name].append(value)
                    seen[n] += 1
                    held += len(raw)
                if keep_ids and held > 16 << 20:
                    yield out()
                    held = 0
                    for c in cols.values():
                        c.clear()
            yield out()

    return run


# ---------------------------------------------------------------- patterns


class Lengths:
    """How many pieces of each length are left, and the lengths that are."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sorted = sorted(self.n)

    def take(self, s: int, m: int) -> None:
        self.n[s] -= m
        if not self.n[s]:
            del self.n[s]
            del self.sorted[bisect.bisect_left(self.sorted, s)]

    def left(self, s: int, without: tuple = ()) -> int:
        return self.n.get(s, 0) - without.count(s)

    def longest(self, room: int, without: tuple = ()) -> int:
        """The longest length of at most `room` that is left besides those in `without`; 0 if none is."""
        i = bisect.bisect_right(self.sorted, room) - 1
        while i >= 0 and self.left(self.sorted[i], without) <= 0:
            i -= 1
        return self.sorted[i] if i >= 0 else 0

    def shortest(self, k: int, without: tuple = ()) -> list[int]:
        """The k shortest pieces' lengths."""
        out: list[int] = []
        for s in self.sorted:
            out += [s] * min(k - len(out), max(0, self.left(s, without)))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int, without: tuple) -> tuple[int, int]:
        """Two pieces, the longer first, that together are the longest of at most `room`; of equal such pairs the one with the longest piece. (0, 0) if
        no two fit."""
        best = (0, 0)
        i, j = 0, bisect.bisect_right(self.sorted, room) - 1
        while i <= j:
            a, b = self.sorted[j], self.sorted[i]
            if a + b > room or not self.left(a, without):
                j -= 1
                continue
            if a + b > sum(best) and self.left(b, without) > (a == b):
                best = (a, b)
            i += 1
        return best


def dominating(have: Lengths, j: int, capacity: int) -> tuple[int, ...] | None:
    """The pieces beside one of length j, of a set that dominates all feasible sets with it; None if no set of up to three is known to."""
    room = capacity - j
    k = have.longest(room, (j,))
    if not k:
        return ()
    if k == room:
        return (k,)
    small = have.shortest(3, (j,))
    if sum(small[:2]) > room or len(small) < 2:
        return (k,)
    if sum(small) > room or len(small) < 3:
        # at most two fit beside j
        a, b = have.best_pair(room, (j,))
        if k >= a + b:
            return (k,)
        # the longest single must be covered, and every pair by its longer and its shorter piece
        if a >= k:
            shorter = max((min(x, have.longest(room - x, (j, x))) for x in have.sorted if x <= room and have.left(x, (j,)) > 0), default=0)
            if b >= shorter:
                return (a, b)
    return None


def reduced(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Patterns (sequences, lengths) fixed by dominance, and the counts of lengths that are left."""
    have, out, again = Lengths(counts), [], True
    while again:
        again = False
        for j in sorted(have.n, reverse=True):
            while have.n.get(j, 0):
                beside = dominating(have, j, capacity)
                if beside is None:
                    break
                need = {s: (j, *beside).count(s) for s in (j, *beside)}
                m = min(have.n[s] // c for s, c in need.items())
                for s, c in need.items():
                    have.take(s, c * m)
                out.append((m, (j, *beside)))
                again = True
    return out, have.n


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Longest first, each piece into the sequence that it leaves least room in: patterns of equal sequences."""
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    order: list[int] = []  # rooms that some sequence has

    def put(room: int, n: int, held: tuple[int, ...]) -> None:
        if n:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((n, held))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect.bisect_left(order, s)
            if i == len(order):
                room, n, held = capacity, -(-left // (capacity // s)), ()
            else:
                room = order[i]
                n, held = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[i]
            # a sequence that took a piece has least room again, so it takes pieces till they no longer fit
            each = room // s
            full = min(n, left // each)
            put(room - each * s, full, held + (s,) * each)
            left -= full * each
            n -= full
            if n and 0 < left < each:
                put(room - left * s, 1, held + (s,) * left)
                n, left = n - 1, 0
            put(room, n, held)
    return [p for r in sorted(rooms) for p in rooms[r]]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """How many sequences hold which lengths, in order."""
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """For the i-th piece of a length, its sequence and its place there."""

    def __init__(self, made: list[tuple[int, tuple[int, ...]]]) -> None:
        rows, first = [], 0
        for n, held in made:
            at = 0
            for s in sorted(set(held), reverse=True):
                rows.append((s, n, held.count(s), first, at))
                at += s * held.count(s)
            first += n
        rows.sort(key=lambda r: (r[0], r[3]))
        self.length, self.n, self.each, self.first, self.at = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
        took = np.cumsum(self.n * self.each) - self.n * self.each
        self.lengths, begin = np.unique(self.length, return_index=True)
        self.rank = took - np.repeat(took[begin], np.diff(np.append(begin, len(rows)))) if rows else took
        self.begin, self.end = begin, np.append(begin, len(rows))[1:]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for s in np.unique(length):
            i = np.flatnonzero(length == s)
            c = np.searchsorted(self.lengths, s)
            r = self.begin[c] + np.searchsorted(self.rank[self.begin[c] : self.end[c]], rank[i], "right") - 1
            k = rank[i] - self.rank[r]
            sequence[i], offset[i] = self.first[r] + k // self.each[r], self.at[r] + k % self.each[r] * s
        return sequence, offset


# ---------------------------------------------------------------- packing


def _placed(schema: pa.Schema, places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.of(b.column("length").to_numpy(), b.column("place").to_numpy() + b.column("before").to_numpy())
            new = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else b.column(f.name) for f in schema], schema=schema)

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; with keep_ids also its ids (binary, little-endian
    32-bit). tokenizer: the file's path on every executor; by default that of the installed package of public vocabularies."""
    from pyspark.sql.pandas.types import to_arrow_schema

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    more = _PIECE + (", ids binary" if keep_ids else "")
    schema = d.select("doc_id", *[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in more.split(", ")]).schema
    pieces = written(d.mapInArrow(_pieces(to_arrow_schema(schema), tokenizer, capacity, end, keep_ids), schema), "pieces")
    counts = written(pieces.groupBy("task", "length").count(), "lengths")
    made = patterns({r["length"]: int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"])
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    out = ranked.select(*keep, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(_placed(to_arrow_schema(out), Places(made)), out)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (binary) of pack(keep_ids=True)'s pieces put together; a group is one sequence, at most its capacity."""
    each = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return each.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op13_packing": op13_packing}
#: The tokenizer has no SQL form; tests compare with whole-text encoding and an exhaustive packing.
ORACLE_SQL: dict[str, str] = {}
