import random
import struct
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from radspark.llm import packing

POOL = "aàéßÀİıŉſʼn'sdntrevm ll \t\n\x1c\x85\xa0 é̈ 12²½٣<|endoftext|>ŸǅȺ中文字😀!!..,,-_ΣςσÅ"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def test_words_apart_are_whole_texts(tokenizer):
    """Ids of a text's words, one after another, are those of the whole text; also where stretches are cut and memory is forgotten."""
    rng = random.Random(4)
    w = packing.Words(packing.default_tokenizer(), most=300)
    for i in range(1500):
        x = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            x = x.replace(" ", "<|endoftext|>", 1)
        assert np.frombuffer(w.ids(x.encode()), "<u4").tolist() == tokenizer.encode(x, add_special_tokens=False).ids, x
    long = " ".join("".join(rng.choice("abcdefg'1!") for _ in range(rng.randint(1, 12))) for _ in range(3000))
    want = tokenizer.encode(long, add_special_tokens=False).ids
    packing.STRETCH, held = 1000, packing.STRETCH
    try:
        assert np.frombuffer(w.ids(long.encode()), "<u4").tolist() == want
    finally:
        packing.STRETCH = held


def fewest(lengths: tuple, capacity: int) -> int:
    """By trying everything."""

    @lru_cache(None)
    def best(left: tuple) -> int:
        if not left:
            return 0
        first, rest = left[-1], left[:-1]
        out = 99

        def fill(room: int, i: int, kept: tuple) -> None:
            nonlocal out
            if i < 0:
                out = min(out, 1 + best(tuple(sorted(kept))))
                return
            fill(room, i - 1, (*kept, rest[i]))
            if rest[i] <= room:
                fill(room - rest[i], i - 1, kept)

        fill(capacity - first, len(rest) - 1, ())
        return out

    return best(tuple(sorted(lengths)))


def test_reduction_keeps_the_optimum():
    """What is fixed and the best packing of the rest together need no more sequences than the best packing of all."""
    rng = random.Random(3)
    fixed_some = kinds = 0
    for _ in range(250):
        capacity = rng.choice((10, 17, 30))
        lengths = tuple(rng.randint(rng.choice((1, capacity // 4)), capacity) for _ in range(rng.randint(1, 9)))
        made, rest = packing.reduced(dict(Counter(lengths)), capacity)
        held = Counter(s for n, p in made for s in p for _ in range(n)) + Counter(rest)
        assert held == Counter(lengths) and all(sum(p) <= capacity for _, p in made)
        left = tuple(s for s, n in rest.items() for _ in range(n))
        assert sum(n for n, _ in made) + fewest(left, capacity) == fewest(lengths, capacity), (lengths, capacity)
        fixed_some += bool(made)
        kinds |= sum(1 << len(p) for p in {p for _, p in made} if len(p) < 4)
    assert fixed_some > 150 and kinds & 0b1110 == 0b1110  # sets of one, two and three were fixed


def test_best_fit_is_the_piece_by_piece_one():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 12) for _ in range(rng.randint(1, 12))}
        rooms: list[int] = []
        for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 40) - s)
        made = packing.best_fit(counts, 40)
        assert Counter(s for n, p in made for s in p for _ in range(n)) == Counter(counts)
        assert sorted(40 - sum(p) for n, p in made for _ in range(n)) == sorted(rooms)
    assert packing.best_fit({1: 10**12, 700: 10**9}) and packing.patterns({}) == []


def test_pack(spark, tokenizer):
    """Every piece of every document once, with its ids, places gapless; odd rows, ties, and a clashing column."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(("the", "Über", "x1", "a-b", "don't")) for _ in range(int(rng.paretovariate(0.7)) % 900)) for _ in range(150)]
    texts += [None, "", " ", "word " * 700, "same text"] + ["same text"] * 60
    rows = [(None if i % 50 == 49 else i // 2 if i < 20 else i, x, 5) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    for capacity in (64, 2048):
        packed = packing.pack(docs, capacity=capacity, keep_ids=True)
        got = packed.collect()
        want = Counter()
        for key, x, _ in rows:
            ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 0]
            for k, at in enumerate(range(0, len(ids), capacity)):
                want[key, k, at, struct.pack(f"<{len(ids[at : at + capacity])}I", *ids[at : at + capacity])] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got) == want
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] == len(r["ids"]) // 4 for r in got)
        held = defaultdict(list)
        for r in got:
            held[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
        for s in held.values():
            at = 0
            for offset, length, _ in sorted(s):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(r["length"] for r in got)
        assert len(held) <= -(-total // capacity) + 1
        whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
        assert whole == {k: b"".join(x for _, _, x in sorted(v)) for k, v in held.items()}
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs.where(F.col("text").isNull())).select("length", "sequence_id", "offset").collect() == [(1, 0, 0)]
