import random
from collections import Counter

import pytest

from radspark.operators import assembly, cleaning, kmers, reads
from radspark.sources import encodings

LONG = "the quick brown fox jumps over a lazy dog and runs away, " * 20


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """Three texts alike in their first 64 letters, one of them a copy, and one without letters."""
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(1, LONG + "end", "a"), (2, LONG + "other end", "a"), (3, LONG + "end", "a"), (4, "12", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    return encodings.load(spark, d, "reads")


def test_reads_are_whole(spark, whole):
    letters = [c for c in LONG.lower() + "end" if c.isalpha()]
    seq = "".join("ACGT"[(ord(c) - 97) % 4] for c in letters)
    rows = {r["read_id"]: r for r in whole.collect()}
    assert rows[1]["seq"] == seq and rows[4]["seq"] == ""
    assert all(len(r["qual"]) == len(r["seq"]) for r in rows.values())
    assert {r["read_id"] for r in reads.OPS["clone_filter"](spark, reads=whole).collect()} == {1, 2, 4}
    want = Counter()
    for r in rows.values():
        want.update(r["seq"][i : i + 15] for i in range(len(r["seq"]) - 14))
    assert {r["kmer"]: r["n"] for r in kmers.count(whole).collect()} == want


def test_quality_windows_of_the_whole_read(spark):
    high, low = chr(48 + 40), chr(48 + 2)
    rows = [(1, "a", "A" * 700, high * 600 + low * 100), (2, "a", "A" * 5, high * 5), (3, "a", "", ""), (4, "a", "A" * 300, high * 300), (5, "a", "A" * 100, low * 50 + high * 50)]
    df = spark.createDataFrame(rows, "read_id long, sample string, seq string, qual string")
    got = {r["read_id"]: (r["verdict"], r["cut"]) for r in cleaning.quality_trim(df, window=0.1, least=20, base=48, min_length=3).collect()}
    # a window of 70 with m low scores has the mean 40 - 38 m / 70, below 20 from m = 37 on
    assert got == {1: ("retained", 567), 2: ("retained", 5), 3: ("short", None), 4: ("retained", 300), 5: ("low_quality", None)}


def test_similarity_of_any_length(spark):
    rng = random.Random(5)
    rows = []
    for n in (1, 3, 6, 7, 8, 20, 60, 64, 100, 1000):
        for _ in range(6):
            s = [rng.choice("ACGT") for _ in range(n)]
            rows.append("".join(s))
            for i in rng.sample(range(n), min(n, rng.randint(1, 9))):
                s[i] = rng.choice("ACGT")
            rows.append("".join(s))
    rows = [(i, "a", s) for i, s in enumerate(rows + rows[:5] + [""])]
    first = {}
    for i, _, s in rows:
        first.setdefault(s, i)
    dist = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {(i, j, dist(a, b)) for a, i in first.items() for b, j in first.items() if i < j and len(a) == len(b) and dist(a, b) <= 6}
    df = spark.createDataFrame(rows, "read_id long, sample string, seq string")
    got = assembly.similar_by_parts(df).collect()
    assert {len(rows[i][2]) for i, _, _ in want} == {1, 3, 6, 7, 8, 20, 60, 64, 100, 1000}
    assert sorted(map(tuple, got)) == sorted(want)


def test_consensus_of_every_column(spark):
    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice([1, 5, 19, 20, 255, 256, 257, 700]))) for _ in range(60)] + [""]
    rows = [(i, "ab"[i % 2], s) for i, s in enumerate(seqs)]
    want = {}
    for sample in "ab":
        own = [s for _, m, s in rows if m == sample]
        columns = [Counter(s[i] for s in own if len(s) > i) for i in range(max(map(len, own)))]
        want[sample] = "".join(min(c, key=lambda b: (-c[b], b)) for c in columns)
    df = spark.createDataFrame(rows, "read_id long, sample string, seq string")
    assert {r["sample"]: r["consensus"] for r in assembly.consensus(df).collect()} == want


def test_kmer_filters_by_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    seqs = [(b[: rng.randint(0, 60)] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9)))) for b in base * 8] + ["", "ACGTN" * 5, "A" * 40]
    rows = [(i, "s", s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "read_id long, sample string, seq string")
    k = 7
    cut = lambda s: [s[i : i + k] for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]
    count = Counter(x for s in seqs for x in cut(s))
    assert {r["read_id"]: r["freq"] for r in kmers.frequencies(df, k).collect()} == {i: [count[x] for x in cut(s)] for i, s in enumerate(seqs)}

    def median(v):
        v, h = sorted(v), len(v) // 2
        return 0 if not v else (v[h - 1] + v[h]) / 2 if len(v) % 2 == 0 else v[max(0, h - 1)]

    keep = set()
    for i, s in enumerate(seqs):
        n = [count[x] for x in cut(s)]
        bound, run, bad = int(median(n) * 0.5 + 0.5), 0, False
        for f in range(len(n)):
            if f >= k:
                run -= n[f - k + 1] <= bound
            run += n[f] <= bound
            bad |= run >= 3
        if not bad:
            keep.add(i)
    assert {r["read_id"] for r in kmers.rare_filter(df, k, 0.5, 3).collect()} == keep
    seen, kept = Counter(), set()
    for i, s in enumerate(seqs):
        if median([seen[x] for x in cut(s)]) <= 2:
            kept.add(i)
        seen.update(cut(s))
    assert {r["read_id"] for r in kmers.normalise(df, k, 2).collect()} == kept
    assert kmers.frequencies(df.limit(0), k).count() == 0


def test_chain_and_adapters():
    c = cleaning.Checks(min_length=10, enzyme="sbfI", adapter="GATCGGAAGAGC", adapter_kmer=5, adapter_mismatches=1, min_quality=0)
    site = "TGCAGG"
    body = "ACGTTACGATTACAGGA"
    assert cleaning.checked(site + body, "", False, c)[0] == "retained"
    assert cleaning.checked("TGCATG" + body, "", False, c)[:2] == ("retained", site + body)
    assert cleaning.checked("TTTATG" + body, "", False, c)[0] == "no_cutsite"
    assert cleaning.checked(site + "ACN" + body, "", False, c)[0] == "uncalled"
    assert cleaning.checked(site + body + "GATCGGATGAGC", "", False, c)[0] == "adapter"
    assert cleaning.checked(site + body + "GATCGG", "", False, c)[0] == "adapter"
    assert cleaning.checked(site, "", False, c)[0] == "short" and cleaning.checked(site + body, "", True, c)[0] == "chastity"
    trim = cleaning.Checks(min_length=10, adapter="GATCGGAAGAGC", min_quality=0, trim=True)
    assert cleaning.checked(body + "GATCGGAAGAGCTT", "", False, trim) == ("retained", body, "")


def test_similar_pairs_share_rare_kmers(spark):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        s = [rng.choice("ACGT") for _ in range(64)]
        for v in range(4):
            t = s.copy()
            for i in rng.sample(range(64), v):
                t[i] = rng.choice("ACGT")
            rows.append((len(rows), v % 2, "".join(t)))
    df = spark.createDataFrame(rows, "id long, sample int, seq string")
    dist = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = sorted((s, i, j, dist(a, b)) for i, s, a in rows for j, t, b in rows if i < j and s == t and 1 <= dist(a, b) <= 3)
    assert sorted(map(tuple, assembly.similar_pairs(df, 3, 64, ["sample"]).collect())) == want


def test_components_of_paths_and_stars(spark):
    from radspark.operators import graphs

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(map(tuple, graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {300: 300, 301: 300}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stream_of_reads(spark, tmp_path):
    from radspark import streaming

    rows = [(i, "s", "ACGTACGTACGTACGTAC"[i % 3 :], "I" * 5) for i in range(12)]
    spark.createDataFrame(rows, "read_id long, sample string, seq string, qual string").selectExpr("*", "timestamp'2024-01-01 00:00:00' ts").write.parquet(f"{tmp_path}/in")
    for name, f in (("clones", streaming.clone_filter), ("kept", streaming.normalise)):
        q = f(streaming.arriving(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("clones").count() == 3
    assert 0 < spark.table("kept").count() < 12


def test_kmer_count_of_short_reads(spark):
    """A batch of reads shorter than a k-mer has no k-mers."""
    assert kmers.count(spark.createDataFrame([("ACGT",), ("",)], "seq string")).count() == 0


def test_kmer_joins_pass_the_driver_by(spark):
    """K-mers are many times the tables' size that joins are planned by, so none may be sent through the driver."""
    from radspark import catalog

    for name in ("kmer_similarity_join", "stack_trees", "gapped_join", "gapped_secondary"):
        assert "Broadcast" not in catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_lumberjack_pairs_by_halves(spark):
    """Only piles that share a half with a deep one are compared; uneven halves, the deep one itself, and one two mismatches away."""
    rows = [(i, 0, s, d) for i, (s, d) in enumerate([("ACGTACG", 500), ("TCGTACG", 1), ("ACGTACT", 1), ("TCGTACT", 1), ("ACGTAC", 1), *[("GGGGGGG", 1)] * 40])]
    piles = spark.createDataFrame(rows, "stack long, sample int, seq string, depth int")
    got = assembly.lumberjack(piles)
    assert [r["stack"] for r in got.where("lumberjack").orderBy("stack").collect()] == [0, 1, 2]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "code" in got._jdf.queryExecution().executedPlan().toString()


def test_column_counts_are_as_wide_as_their_columns():
    """A group's counts are sent for its own columns only, not for a whole stretch."""
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 1]), pa.array(["ACG", "T", "AN"]), pa.array([1, 1, 2])], names=["sample", "seq", "depth"])
    (out,) = assembly._column_counts(iter([b]))
    assert [len(x) for x in out.column("counts").to_pylist()] == [3 * 32, 32]


def test_normalise_over_stretches(spark, monkeypatch):
    """Reads of a sample in many stretches are kept as if they came one after another."""
    monkeypatch.setattr(kmers, "GROUP", 100)
    rng = random.Random(4)
    rows = [(i, "ab"[i % 2], "".join(rng.choice("AC") for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    for limit in (2.0, 5.5):
        want = []
        for sample in "ab":
            seen = Counter()
            for i, s, seq in rows:
                if s == sample:
                    own = [seq[j : j + 5] for j in range(len(seq) - 4)]
                    n, h = sorted(seen[x] for x in own), len(own) // 2
                    if not n or ((n[h - 1] + n[h]) / 2 if len(n) % 2 == 0 else n[max(0, h - 1)]) <= limit:
                        want.append(i)
                    seen.update(own)
        got = kmers.normalise(spark.createDataFrame(rows, "read_id long, sample string, seq string"), 5, limit)
        assert len(want) < 60 and sorted(r["read_id"] for r in got.collect()) == sorted(want)


def test_kmers_are_dealt_to_small_buckets(spark, monkeypatch):
    """The number of buckets grows with the letters."""
    monkeypatch.setattr(kmers, "BUCKET", 20)
    seen = []
    counter = kmers._counter
    monkeypatch.setattr(kmers, "_counter", lambda k, buckets: seen.append(buckets) or counter(k, buckets))
    reads_ = spark.createDataFrame([("ACGTTGCA" * 200,)], "seq string")
    assert kmers.count(reads_, 8).agg({"n": "sum"}).first()[0] == 1593 and seen == [80]


def test_packed_forms():
    import numpy as np
    import pyarrow as pa

    from radspark.operators import packing

    rng, g = random.Random(1), np.random.default_rng(2)
    seqs = ["".join(rng.choices("ACGT", k=rng.choice([0, 1, 3, 4, 5, 90]))) if rng.random() < 0.8 else rng.choice(["ANT", "N", "", None, "acgü"]) for _ in range(400)]
    b = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(seqs)], names=["id", "seq"])
    for part in (b, b.slice(3, 100), b.slice(5, 1)):
        t = pa.Table.from_batches(list(packing.packed_sequences([part])))
        for u in (t, t.take(list(range(len(t) - 1, -1, -1)))):
            buf, off = packing.unpacked_sequences(u)
            assert [bytes(buf[x:y]).decode() for x, y in zip(off[:-1], off[1:], strict=True)] == [seqs[i] or "" for i in u.column("id").to_pylist()]
    assert not list(packing.packed_sequences([b.slice(0, 0)]))
    for n, most in ((1, 5), (2, 9), (1000, 1 << 30), (1000, 1001), (300, 1 << 62)):
        v = np.unique(g.integers(0, most, n))
        assert (packing.unpacked_set(packing.packed_set(v)) == v).all()
    for v in (np.zeros(0, np.int64), np.array([0, 0]), np.array([1, 300, 7, 2**40]), g.integers(0, 3, 1000)):
        assert (packing.unpacked_counts(packing.packed_counts(v)) == v).all()


@pytest.mark.parametrize("k", [15, 31])
def test_kmer_shuffles_are_small(spark, monkeypatch, k):
    """Reads go once, with a quarter byte a letter, and k-mers in bits: before, some 20 bytes a letter were shuffled."""
    monkeypatch.setattr(kmers, "GROUP", 200_000)
    monkeypatch.setattr(kmers, "BUCKET", 400_000)
    rng = random.Random(3)
    rows = [(i, "xy"[i % 2], "".join(rng.choices("ACGT", k=1000))) for i in range(600)]
    rows += [(600 + i, "x", rows[i][2][:500] + "N" + rows[i][2][500:]) for i in range(30)]
    df = spark.createDataFrame(rows, "read_id long, sample string, seq string").localCheckpoint()
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    count = Counter(s[j : j + k] for *_, s in rows for j in range(len(s) - k + 1))
    before = sent()
    got = {r[0]: r[1] for r in kmers.frequencies(df, k).collect()}
    middle = sent()
    for i, _, s in rows[::50] + rows[-3:]:
        assert got[i] == [count[x] for x in (s[j : j + k] for j in range(len(s) - k + 1)) if "N" not in x]
    kept = {r[0] for r in kmers.normalise(df, k, 0).collect()}
    assert kept == {i for i, s, _ in rows if i < 600 or rows[i - 600][1] != s}
    letters, bits = sum(len(s) for *_, s in rows), {15: 3, 31: 8}[k]
    assert 0 < middle - before < bits * letters and sent() - middle < bits * letters
