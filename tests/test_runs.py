import random

from radspark import runs
from radspark.operators import cleaning, storage
from radspark.operators.populations import Filters
from radspark.sources import formats


def test_from_files_to_statistics(spark, tmp_path):
    """Reads of eight samples with inline barcodes, from FASTQ to genotypes: three loci of 64 bases, one site each that differs between two populations."""
    rng = random.Random(7)
    loci = ["TGCAGG" + "".join(rng.choice("ACGT") for _ in range(58)) for _ in range(3)]
    codes = ["ACGTAC", "CATGCA", "GGCATT", "GTACCA", "TTGACA", "AACCGG", "CCTTAA", "TATACG"]
    lines, truth = [], {}
    for i, code in enumerate(codes):
        for n, seq in enumerate(loci):
            alt = seq[:30] + ("A" if seq[30] != "A" else "C") + seq[31:]
            pair = (seq, seq) if i < 3 else (alt, alt) if i > 5 else (seq, alt)
            truth[i, n] = pair
            for k in range(24):
                r = code + pair[k % 2]
                if k == 23:  # one read in 24 has an error
                    at = rng.randrange(40, 60)
                    r = r[:at] + ("A" if r[at] != "A" else "G") + r[at + 1 :]
                lines.append(f"@m:{i}:{n}:{k}\n{r}\n+\n{'I' * len(r)}\n")
    lines.append("@junk\n" + "T" * 70 + "\n+\n" + "I" * 70 + "\n")
    rng.shuffle(lines)
    (tmp_path / "lane.fq").write_text("".join(lines))
    (tmp_path / "codes.tsv").write_text("".join(f"{c}\ts{i}\n" for i, c in enumerate(codes)))
    reads = runs.load_reads(spark, [str(tmp_path / "lane.fq")])
    assert reads.count() == len(lines)
    done = runs.process_reads(reads, formats.barcodes(spark, str(tmp_path / "codes.tsv")), cleaning.Checks(enzyme="sbfI", offset=6), 6)
    clean = runs.save(done["retained"].select("read_id", "sample", "seq", "qual"), str(tmp_path), "clean")
    assert clean.count() == len(lines) - 1 and [r["n"] for r in done["unknown"].collect()] == [1]
    assert runs.clone_filter(clean).count() < clean.count()
    popmap = spark.createDataFrame([(f"s{i}", i // 4) for i in range(8)], "sample string, pop int")
    out = runs.de_novo(spark, clean, popmap, Filters(r=0.5, p=2), str(tmp_path / "out"), files=False)
    calls = out["calls"].collect()
    assert len({r["locus"] for r in calls}) == 3 and {r["col"] for r in calls} == {30}
    got = sorted((r["sample"], "".join(sorted((r["a1"], r["a2"])))) for r in calls if r["a1"])
    want = sorted((i, "".join(sorted((a[30], b[30])))) for (i, _), (a, b) in truth.items())
    assert len(got) >= 22 and sum(x in want for x in got) == len(got)


def test_corrections_and_predicates(spark):
    c = spark.createDataFrame([(1, 2, "a/a")], "locus long, sample long, genotype string")
    c = storage.correct(storage.correct(c, 1, 3, "b/b"), 1, 2, None)
    assert [tuple(r) for r in c.collect()] == [(1, 3, "b/b")]
    g = spark.createDataFrame([(1, 3, "a/b"), (1, 4, "a/a")], "locus long, sample long, genotype string")
    assert sorted(tuple(r) for r in storage.corrected(g, c).collect()) == [(1, 3, "b/b", True), (1, 4, "a/a", False)]
    n = storage.annotate(spark.createDataFrame([(1, "x")], "locus long, note string"), 1, "y")
    assert [r["note"] for r in n.collect()] == ["y"] and storage.annotate(n, 1, None).count() == 0
    df = spark.createDataFrame([(i, i % 3, f"m{i}") for i in range(20)], "locus long, chr int, marker string")
    assert [r["locus"] for r in storage.page(df.where(storage.where(locus_from=2, locus_to=15, chr_in=[1, 2], marker_like="m1%")), ["locus"], 2, 2).collect()] == [13, 14]
