"""N-gram Jaccard join by prefix trees, exact, and the components of its links.

A document's set holds the distinct hashes of its SHINGLE-word shingles. Tokens have one global order, rare before
frequent (by the count class of a sketch over all documents), so two sets that reach the threshold share a token among the first
n - ceil(t n) + 1 of each. Documents with equal sets are one class; from then on classes are compared.

Prefixes bound the overlap: beyond the prefix that ends first, its set holds ceil(t n) - 1 more tokens, so two sets
overlap in at most that many and the prefix tokens they share. Sets are only fetched for pairs that this bound lets
reach the threshold.

Round 1 puts each class with the class that is most often the least of those that share its prefix tokens, verifies it
against that one and some of the others there; the links found give components. Round 2 takes the prefix tokens that still
meet in different components. Of tokens with up to SMALL classes, every pair from different components is counted, and
verified if the shared tokens, with all larger tokens of either set for good measure, satisfy the bound. Classes that meet in larger
tokens form piles, and in a pile every class outside the largest component probes all others, chunk against chunk. So no
link between components is missed, pairs inside a component need no test, and no pairs of a large group are listed.

A verification task holds the sets of about GROUP classes as a trie in global order. The search walks the trie, shares the
overlap of common beginnings, and leaves a subtree when the overlap so far and what remains of the shorter side
cannot reach the threshold.

Words are those of the lower-cased text (A-Z only). Texts with fewer words than a shingle have their whole
sequence as the only token; null, empty and blank texts have none and are linked with nothing. Repeated rows are
one class. Tokens are 58-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Slice, U, bits, by_bucket, free, gram_hashes, inside, mix, n_bytes, prefix_sums, read, row_key, slices, stretch_hashes, word_hashes, words, written
from .graph import components

SHINGLE = 5
PERCENT = 80
GROUP = 2048
PROBES = 64  # of the first round, which need not find all links
SMALL = 64  # tokens with more classes are settled by piles
SEGMENT = 20
MAX_BITS = 27
FLUSH = 1 << 20


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap with which sets of n and m tokens link."""
    return -(-percent * (n + m) // (100 + percent))


def shingles(s: Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents, repeats included, in text order."""
    buf = LOWER[s.buf]
    starts, ends, first = words(buf, s.off)
    sums = prefix_sums(word_hashes(buf, starts, ends))
    g = gram_hashes(sums, k)
    ok = inside(first, len(g), k)
    at = np.flatnonzero(ok)
    doc = np.searchsorted(first, at, "right") - 1
    m = np.diff(first)
    short = np.flatnonzero((m > 0) & (m < k))
    h = mix(stretch_hashes(sums, first[short], first[short + 1]) + m[short].astype(U))
    return np.concatenate([g[at], h]), np.concatenate([doc, short])


# ---------------------------------------------------------------- the global order


def _cell(h: np.ndarray, b: int) -> np.ndarray:
    return ((h * U(0x9FB21C651E98DF25)) >> U(64 - b)).astype(np.int64)


def _partial(b: int):
    """Each task counts its documents' distinct tokens into one table, and sends its pieces compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << b, np.uint8)
        some = False
        for s in slices(batches, "_text"):
            h, doc = shingles(s)
            # counting a document's repeats too only makes a token look more frequent
            c, n = np.unique(_cell(h, b), return_counts=True)
            total[c] = np.minimum(total[c].astype(np.int64) + n, 255)
            some |= len(c) > 0
        if some:
            for a in range(0, 1 << b, 1 << SEGMENT):
                yield pa.RecordBatch.from_arrays([pa.array([a >> SEGMENT], pa.int32()), pa.array([zlib.compress(total[a : a + (1 << SEGMENT)].tobytes(), 1)], pa.binary())], names=["seg", "cells"])

    return run


def _merge(t: pa.Table) -> pa.Table:
    total = None
    for x in t.column("cells"):
        part = np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8)
        total = part.astype(np.int32) if total is None else total + part
    # counts in quarter powers of two keep a byte a cell
    level = np.minimum(np.round(8 * np.log2(total + 1)), 255).astype(np.uint8)
    return pa.table({"seg": t.column("seg").slice(0, 1), "level": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})


def frequency_classes(texts: DataFrame, b: int) -> np.ndarray:
    """For each cell, 0 if its count may be chance, then higher with each doubling. One byte a cell comes to the driver."""
    got = texts.select("_text").mapInArrow(_partial(b), "seg int, cells binary").groupBy("seg").applyInArrow(_merge, "seg int, level binary, total long").collect()
    out = np.zeros(1 << b, np.uint8)
    unit = max(4.0, 3.0 * sum(r["total"] for r in got) / (1 << b))
    classes = np.clip(np.floor(np.arange(256) / 8 - np.log2(unit)) + 1, 0, 63).astype(np.uint8)
    for r in got:
        level = np.frombuffer(zlib.decompress(r["level"]), np.uint8)
        out[r["seg"] << SEGMENT : (r["seg"] << SEGMENT) + len(level)] = classes[level]
    return out


def token_sets(s: Slice, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sets, one after another and each in global order, and where each starts (one more at the end)."""
    h, doc = shingles(s)
    b = int(len(order)).bit_length() - 1
    token = (order[_cell(h, b)].astype(U) << U(58)) | (h >> U(6))
    at = np.lexsort((token, doc))
    token, doc = token[at], doc[at]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(s.n + 1))


def classes(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key for each set: equal sets have equal keys; 0 for the empty set."""
    sums = np.zeros(len(token) + 1, U)
    np.cumsum(mix(token.copy()), out=sums[1:])
    n = np.diff(first).astype(U)
    key = mix(sums[first[1:]] - sums[first[:-1]] + n * U(0x9E3779B97F4A7C15)).astype(np.int64)
    key[n == 0] = 0
    return key


# ---------------------------------------------------------------- candidates


def _documents(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "_text"):
            token, first = token_sets(s, shared.value)
            yield pa.RecordBatch.from_arrays([s.column("_key"), s.column("_key2"), pa.array(np.diff(first), pa.int64()), pa.array(classes(token, first))], names=["_key", "_key2", "n", "cls"])

    return run


def _prefixes(shared, n_buckets: int, percent: int):
    """Packed (token, cls, set size) of all documents' prefixes, by bucket of the token; equal ones of a flush once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush():
            pair = _distinct(np.concatenate(held))
            rows = [(b, packed(pair[i])) for b, i in by_bucket((pair["t"] % U(n_buckets)).astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["b", "data"])

        for s in slices(batches, "_text"):
            token, first = token_sets(s, shared.value)
            n = np.diff(first)
            cls = classes(token, first)
            prefix = np.where(n > 0, n - (-(-percent * n // 100)) + 1, 0)
            at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(prefix)[:-1]]), prefix) + np.arange(prefix.sum())
            p = np.empty(len(at), _PAIR)
            p["t"], p["c"], p["n"] = token[at], np.repeat(cls, prefix), np.repeat(n, prefix)
            held.append(p)
            n_held += len(p)
            if n_held >= FLUSH:
                yield flush()
                held, n_held = [], 0
        if n_held:
            yield flush()

    return run


_PAIR = np.dtype([("t", U), ("c", np.int64), ("n", np.uint32)])


def packed(pair: np.ndarray) -> bytes:
    """Byte after byte of all pairs: of sorted tokens the first bytes hardly change, nor do the sizes' last, so that Spark's compression of shuffles finds them."""
    return np.ascontiguousarray(pair).view(np.uint8).reshape(-1, _PAIR.itemsize).T.tobytes()


def unpacked(raw: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(_PAIR.itemsize, -1).T).view(_PAIR).ravel()


def _distinct(pair: np.ndarray) -> np.ndarray:
    """In order of token and class, each once."""
    pair = pair[np.lexsort((pair["c"], pair["t"]))]
    new = np.ones(len(pair), bool)
    new[1:] = (pair["t"][1:] != pair["t"][:-1]) | (pair["c"][1:] != pair["c"][:-1])
    return pair[new]


def _meet(t: pa.Table) -> pa.Table:
    """A bucket's tokens that two classes share: (token, class, set size) rows, each with the token's least class and its size."""
    pair = _distinct(np.concatenate([unpacked(x.as_buffer()) for x in t.column("data")]))
    cut = np.flatnonzero(pair["t"][1:] != pair["t"][:-1]) + 1
    a = np.concatenate([[0], cut])
    n = np.diff(np.concatenate([a, [len(pair)]]))
    two = np.repeat(n > 1, n)
    least, least_n = np.repeat(pair["c"][a], n)[two], np.repeat(pair["n"][a], n)[two]
    pair = pair[two]
    return pa.table({"token": pa.array(pair["t"].astype(np.int64)), "cls": pa.array(pair["c"].copy()), "n": pa.array(pair["n"].astype(np.int64)), "least": pa.array(least), "least_n": pa.array(least_n.astype(np.int64))})


def _may_link(shared, n: str, m: str, percent: int):
    """Whether sets of n and m tokens can link whose prefixes share at most so many tokens."""
    low, high = F.least(n, m), F.greatest(n, m)
    beyond = F.ceil(high * percent / 100) - 1
    return (shared + beyond >= F.ceil((low + high) * percent / (100 + percent))) & (low * 100 >= high * percent)


# ---------------------------------------------------------------- verification


class Trie:
    """Sorted token arrays as a compact trie: nodes are stretches of tokens common to a run of the sorted arrays."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.lens = np.array([len(sets[i]) for i in self.order], np.int64)
        self.common = np.zeros(max(0, len(sets) - 1), np.int64)
        for j in range(len(sets) - 1):
            x, y = sets[self.order[j]], sets[self.order[j + 1]]
            m = min(len(x), len(y))
            d = np.flatnonzero(x[:m] != y[:m])
            self.common[j] = d[0] if len(d) else m
        # all sets one after another, with tokens numbered in global order
        self.start = np.concatenate([[0], np.cumsum(self.lens)])
        self.tokens, ids = np.unique(np.concatenate([sets[i] for i in self.order]) if sets else np.zeros(0, U), return_inverse=True)
        self.ids = ids.ravel().astype(np.int32)

    def _leaves(self, leaf: np.ndarray, depth: int, got: int, n: int, rest: int, mark: np.ndarray, percent: int) -> list[int]:
        """Of leaves that share `depth` tokens, `got` of them the probe's: those that link. All at once."""
        m = self.lens[leaf]
        low, high = np.minimum(n, m), np.maximum(n, m)
        may = (got + np.minimum(rest, m - depth) >= -(-percent * (n + m) // (100 + percent))) & (100 * low >= percent * high)
        leaf, m = leaf[may], m[may]
        if not len(leaf):
            return []
        ends = np.cumsum(m - depth)
        at = np.repeat(self.start[leaf] + depth - (ends - (m - depth)), m - depth) + np.arange(ends[-1])
        hits = np.concatenate([[0], np.cumsum(mark[self.ids[at]])])
        over = got + hits[ends] - hits[ends - (m - depth)]
        return [self.order[i] for i in leaf[100 * over >= percent * (n + m - over)]]

    def search(self, probe: np.ndarray, percent: int = PERCENT) -> list[int]:
        """The sets whose similarity with the probe reaches the threshold."""
        found, n = [], len(probe)
        at = np.searchsorted(self.tokens, probe)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == probe] if len(self.tokens) else at
        mark = np.zeros(len(self.tokens), bool)
        mark[at] = True
        stack = [(0, len(self.order), 0, 0)] if self.order else []  # arrays lo..hi share `depth` tokens, `got` of them the probe's
        while stack:
            lo, hi, depth, got = stack.pop()
            rep = self.sets[self.order[lo]]
            share = int(self.common[lo : hi - 1].min()) if hi - lo > 1 else len(rep)
            least, most = int(self.lens[lo:hi].min()), int(self.lens[lo:hi].max())
            if share > depth:
                got += int(mark[self.ids[self.start[lo] + depth : self.start[lo] + share]].sum())
                depth = share
            rest = n - int(np.searchsorted(probe, rep[depth - 1], "right")) if depth else n
            # the bound grows by at most one with each token more, and the need by less, so the longest decides
            if got + min(rest, most - depth) < need(n, least, percent) or 100 * min(n, most) < percent * max(n, least):
                continue
            if hi - lo == 1:
                if 100 * got >= percent * (n + len(rep) - got):
                    found.append(self.order[lo])
                continue
            edges = np.concatenate([[lo], lo + 1 + np.flatnonzero(self.common[lo : hi - 1] == depth), [hi]])
            one = np.diff(edges) == 1
            found += self._leaves(edges[:-1][one], depth, got, n, rest, mark, percent)
            stack.extend((a, b, depth, got) for a, b in zip(edges[:-1][~one].tolist(), edges[1:][~one].tolist(), strict=True))
        return found


class Labels:
    """Components of the classes in a task, merged as links are found."""

    def __init__(self, roots: np.ndarray) -> None:
        self.of = np.unique(roots, return_inverse=True)[1].ravel()

    def largest(self) -> int:
        return int(np.bincount(self.of).argmax())

    def join(self, i: int, hits: list[int]) -> list[int]:
        """Merges i with hits; returns one hit of each component that was another."""
        hits = [j for j in hits if self.of[j] != self.of[i]]
        if not hits:
            return []
        new, at = np.unique(self.of[hits], return_index=True)
        self.of[np.isin(self.of, new)] = self.of[i]
        return [hits[j] for j in at]


def probe_rest(sets: list[np.ndarray], labels: Labels, probing: list[int], percent: int, most: int | None = None) -> list[tuple[int, int]]:
    """Links found by probing the trie of all sets with those outside the largest component, until none is untried."""
    trie, links, untried = Trie(sets), [], np.zeros(len(sets), bool)
    untried[probing] = True
    while most is None or most > 0:
        out = np.flatnonzero(untried & (labels.of != labels.largest()))
        if not len(out):
            break
        i = int(out[0])
        untried[i] = False
        links += [(i, j) for j in labels.join(i, trie.search(sets[i], percent))]
        most = None if most is None else most - 1
    return links


def _verify(percent: int, probes: int):
    def run(t: pa.Table) -> pa.Table:
        """A star: one class's set and its partners', probed with that class and up to `probes` partners. Or a pile: all
        that stand outside its largest component are probed."""
        sets: dict[int, np.ndarray] = {}
        roots: dict[int, int] = {}
        centre = t.column("centre")[0].as_py()
        star = t.column("root").null_count > 0
        for c, r, x in zip(t.column("member").to_pylist(), t.column("root").to_pylist(), t.column("data"), strict=True):
            if c not in sets:
                sets[c], roots[c] = np.frombuffer(x.as_buffer(), U), c if star else r
        names = list(sets)
        links = []
        if len(names) > 1 and (not star or centre in sets):
            all_sets, labels = [sets[c] for c in names], Labels(np.array([roots[c] for c in names]))
            if star:
                k = names.index(centre)
                links = [(k, j) for j in labels.join(k, Trie(all_sets).search(sets[centre], percent))]
                if probes and len(names) > 2:
                    links += probe_rest(all_sets, labels, [i for i in range(len(names)) if i != k], percent, probes)
            else:
                links = probe_rest(all_sets, labels, list(range(len(names))), percent)
        return pa.table({"a": pa.array([names[i] for i, _ in links], pa.int64()), "b": pa.array([names[j] for _, j in links], pa.int64())})

    return run


class _Bloom:
    """A filter of fixed size for keys: whatever it lets through beyond them costs work, not correctness."""

    BITS = 26

    @staticmethod
    def cells(k: np.ndarray) -> np.ndarray:
        h = mix(k.astype(U).copy())
        return np.concatenate([(h >> U(64 - _Bloom.BITS)), (h & U((1 << _Bloom.BITS) - 1))]).astype(np.int64)

    @staticmethod
    def of(keys: DataFrame) -> np.ndarray:
        def part(batches):
            for b in batches:
                c = np.unique(_Bloom.cells(b.column(0).to_numpy(zero_copy_only=False)))
                rows = [(s, (c[i] & ((1 << SEGMENT) - 1)).astype(np.uint32).tobytes()) for s, i in by_bucket(c >> SEGMENT)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["seg", "cells"])

        def merge(t):
            one = np.zeros(1 << SEGMENT, bool)
            for x in t.column("cells"):
                one[np.frombuffer(x.as_buffer(), np.uint32)] = True
            return pa.table({"seg": t.column("seg").slice(0, 1), "bits": pa.array([np.packbits(one).tobytes()], pa.binary())})

        table = np.zeros(1 << _Bloom.BITS >> 3, np.uint8)
        piece = 1 << SEGMENT >> 3
        for r in keys.mapInArrow(part, "seg int, cells binary").groupBy("seg").applyInArrow(merge, "seg int, bits binary").collect():
            table[r["seg"] * piece : (r["seg"] + 1) * piece] = np.frombuffer(r["bits"], np.uint8)
        return table

    @staticmethod
    def test(table: np.ndarray, k: np.ndarray) -> np.ndarray:
        c = _Bloom.cells(k)
        hit = (table[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return hit[: len(k)] & hit[len(k) :]


def _sets(shared, bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = _Bloom.test(bloom.value, b.column(b.schema.get_field_index("_key")).to_numpy(zero_copy_only=False))
            for s in slices([b.filter(pa.array(keep))], "_text"):
                token, first = token_sets(s, shared.value)
                cls = classes(token, first)
                data = [token[first[i] : first[i + 1]].tobytes() for i in range(s.n)]
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(data, pa.binary())], names=["cls", "data"])

    return run


def _stars(pairs: DataFrame) -> DataFrame:
    """Task rows of pairs (centre, member): partners in groups of about GROUP, each with the centre itself."""
    n = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    dealt = pairs.join(n, "centre").select("centre", F.pmod(F.xxhash64("member"), F.col("groups")).alias("g"), "member")
    own = n.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), F.col("centre").alias("member"))
    return dealt.union(own).select("centre", "g", "member", F.lit(None).cast("long").alias("root"))


def _piles(pile: DataFrame) -> DataFrame:
    """Task rows of pile (pile, cls, root): chunks of about GROUP / 2 classes, each pair of chunks a task."""
    n = pile.groupBy("pile").agg(F.ceil(F.count(F.lit(1)) / (GROUP // 2)).alias("chunks"))
    i, j = F.col("i"), F.col("j")
    rows = pile.join(n, "pile").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("chunks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return rows.select(F.col("pile").alias("centre"), (F.least(i, j) * F.col("chunks") + F.greatest(i, j)).alias("g"), F.col("cls").alias("member"), "root")


def _links(tasks: DataFrame, rows: DataFrame, reps: DataFrame, shared, percent: int, probes: int = 0) -> DataFrame:
    """Task rows (centre, g, member, root) -> links found, as (a, b). Sets are made anew from the texts of the classes wanted."""
    wanted = tasks.select(F.col("member").alias("cls")).distinct()
    bloom = rows.sparkSession.sparkContext.broadcast(_Bloom.of(reps.join(wanted, "cls").select("_key")))
    sets = rows.select("_key", "_text").mapInArrow(_sets(shared, bloom), "cls long, data binary")
    full = tasks.join(sets, F.col("member") == F.col("cls")).select("centre", "g", "member", "root", "data")
    return full.groupBy("centre", "g", F.col("root").isNull()).applyInArrow(_verify(percent, probes), "a long, b long")


def _cross(percent: int):
    def run(t: pa.Table) -> pa.Table:
        """Pairs of classes from different components that share tokens, of lengths that can link: how many of the
        bucket's tokens they share, their sizes, and the lesser number of larger tokens."""
        token, cls, root, n, large = (t.column(c).to_numpy() for c in ("token", "cls", "root", "n", "large"))
        order = np.lexsort((n, token))
        token, cls, root, n, large = token[order], cls[order], root[order], n[order], large[order]
        found = []
        at, step = np.arange(len(token)), 1
        while True:  # pairs `step` apart in order of token and length; those too long for one only get longer
            at = at[at + step < len(token)]
            at = at[(token[at] == token[at + step]) & (100 * n[at] >= percent * n[at + step])]
            if not len(at):
                break
            i = at[root[at] != root[at + step]]
            j = i + step
            found.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), n[i], n[j], np.minimum(large[i], large[j])], 1))
            step += 1
        pair = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
        pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:, :2] != pair[:-1, :2]).any(1)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(pair)))
        return pa.table([pa.array(x) for x in (*np.ascontiguousarray(pair[at].T), count)], names=["centre", "member", "low", "high", "large", "count"])

    return run


def _keys(*cols: str) -> list:
    return [row_key(*cols).alias("_key"), row_key(*cols, second=True).alias("_key2")]


def classify(docs: DataFrame, text: str = "text", key: tuple = ("doc_id",), percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Per row (key columns, n, cls: null where empty), and cls -> root of all classes with a link."""
    rows = docs.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_text"), *_keys(*key, text))
    size = n_bytes(docs, text)
    order = frequency_classes(rows, bits(size / 30, 12, MAX_BITS))
    free(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(order)
    n_buckets = max(16, -(-size // (3 << 20)))
    texts = rows.select("_key", "_key2", "_text")
    of = written(texts.mapInArrow(_documents(shared), "_key long, _key2 long, n long, cls long").distinct(), "classes")
    member = written(texts.mapInArrow(_prefixes(shared, n_buckets, percent), "b int, data binary").groupBy("b").applyInArrow(_meet, "token long, cls long, n long, least long, least_n long"), "meetings")
    free(docs.sparkSession)
    reps = of.where("n > 0").groupBy("cls").agg(F.min("_key").alias("_key"), F.first("n").alias("n"))
    near = member.where("cls <> least").groupBy("cls", "n", "least", "least_n").agg(F.count(F.lit(1)).alias("count"))
    # the least class may hide others that a pair shares, so twice the count is granted; what that misses is left to round 2
    near = near.where(_may_link(F.col("count") * 2, "n", "least_n", percent))
    one = near.groupBy(F.col("cls").alias("member")).agg(F.max_by("least", F.struct("count", -F.col("least"))).alias("centre")).select("centre", "member")
    tasks = written(_stars(one), "tasks1")
    free(docs.sparkSession)
    links = written(_links(tasks, rows, reps, shared, percent, PROBES), "links1")
    free(docs.sparkSession, tasks)
    root = components(links)
    named = member.join(root, F.col("cls") == F.col("v"), "left").select("token", "cls", "n", "least", F.coalesce("root", "cls").alias("root"))
    mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("token", "m")
    left = written(named.join(mixed, "token").select("token", "cls", "least", "root", "n", "m"), "mixed")
    free(docs.sparkSession, member, links)
    many = left.where(F.col("m") > SMALL)
    large = many.groupBy("cls").agg(F.count(F.lit(1)).alias("large"))
    few = left.where(F.col("m") <= SMALL).join(large, "cls", "left").withColumn("large", F.coalesce("large", F.lit(0).cast("long")))
    two = few.withColumn("b", F.pmod(F.xxhash64("token"), F.lit(n_buckets))).groupBy("b").applyInArrow(_cross(percent), "centre long, member long, low long, high long, large long, count long")
    two = two.groupBy("centre", "member", "low", "high", "large").agg(F.sum("count").alias("count"))
    two = two.where(_may_link(F.col("count") + F.col("large"), "low", "high", percent)).select("centre", "member")
    pile = components(many.select(F.col("cls").alias("a"), F.col("least").alias("b")))
    pile = many.select("cls", "root").distinct().join(pile, F.col("cls") == F.col("v")).select(pile["root"].alias("pile"), "cls", many["root"])
    two = written(two, "pairs2")
    free(docs.sparkSession)
    tasks = written(_stars(two).unionByName(_piles(pile)), "tasks2")
    free(docs.sparkSession, two, left)
    more = written(_links(tasks, rows, reps, shared, percent), "links2")
    free(docs.sparkSession, tasks)
    # the stars of the first components stand for its links
    root = components(root.select(F.col("v").alias("a"), F.col("root").alias("b")).union(more))
    return of, root


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple = (), percent: int = PERCENT) -> DataFrame:
    """For every row: key, n_shingles, component_id (least key reachable by links), and the kept columns.

    Least among non-null keys; a component without any has a null component_id.
    """
    of, root = classify(docs, text, (key,), percent)
    rows = docs.select(F.col(key).alias("_id"), *_keys(key, text), *([F.struct(*keep).alias("row")] if keep else []))
    ids = docs.select(F.col(key).alias("_id"), *_keys(key, text)).join(of, ["_key", "_key2"])
    cls = ids.where("n > 0").groupBy("cls").agg(F.min("_id").alias("low")).join(root, F.col("cls") == F.col("v"), "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    cls = written(cls, "members")
    least = cls.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of.join(cls.join(least, "root").select("cls", "component_id"), "cls", "left")
    out = rows.join(named, ["_key", "_key2"]).select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"), *(["row"] if keep else []))
    return out


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without near copies: of each component one row stays, of least key (null last), then least row hash.

    Rows with empty sets are linked with nothing, so they all stay.
    """
    of, root = classify(docs, text, (key,))
    ids = docs.select(F.col(key).alias("_id"), *_keys(key, text)).join(of, ["_key", "_key2"])
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "_key2"))
    cls = ids.where("n > 0").groupBy("cls").agg(best.alias("best")).join(root, F.col("cls") == F.col("v"), "left")
    stay = cls.groupBy(F.coalesce("root", "cls")).agg(F.min("best").alias("best")).select(F.col("best._key").alias("_key"), F.col("best._key2").alias("_key2"), F.lit(True).alias("one"))
    stay = stay.union(of.where("n = 0").select("_key", "_key2", F.lit(False)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys(key, text)).join(stay, ["_key", "_key2"])
    w = Window.partitionBy("_key", "_key2").orderBy(F.xxhash64("row"))
    return rows.withColumn("i", F.row_number().over(w)).where("i = 1 or not one").select("row.*")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard": op10_jaccard}
ORACLE_SQL = {
    "op10_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = d.doc_id"""
}
