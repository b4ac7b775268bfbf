import random
import re

from radspark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = {}
    for kind, p in PATTERNS.items():
        keep = []
        for m in re.finditer(p, text):
            s = m[0]
            digits = re.sub("[^0-9]", "", s)
            ok = {
                "email": lambda: True,
                "ip": lambda s=s: all(int(x) <= 255 for x in s.split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and pii.luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                keep.append((m.start(), m.end()))
        out[kind] = keep
    return out


def test_base_kinds_equal_patterns():
    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "1", "22", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49", " (0)", "-", " ", "  ", "+", "x", "é", "\n", "123456789", "a.b@c-d.e.f"]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        got, want = pii.spans(text), brute(text)
        assert {k: got[k] for k in want} == want, repr(text)


def test_extra_kinds():
    got = pii.spans("see https://x.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00 ok, account no. 12345678")
    assert len(got["url"]) == 1 and len(got["account"]) == 1


def test_digests(spark):
    """The digest of the base spans and the list of all, in code points, against the patterns."""
    import hashlib

    texts = ["é a@b.co, +49 (0) 1234 5678 and 1.2.3.4", "x" * 70_000 + " 4111 1111 1111 1111 é mail b@c.de https://q.io/z", "", None, "1.2.3.4.5 a@b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        want = brute(texts[r["doc_id"]] or "")
        names = [f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k]]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r["spans"].split(",") if r["spans"] else [])[: len(names)] == names
        assert [r[f"n_{k}"] for k in PATTERNS] == [len(want[k]) for k in PATTERNS]


def test_frame_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "k"), (None, "", "k"), (3, "mail a@b.co now", None), (3, "mail a@b.co now", None), (4, "x " * 200000 + "a@b.co", "k")], "doc_id long, text string, spans string")
    rows = pii.find(df).collect()
    assert [r["n_email"] for r in rows] == [0, 0, 1, 1, 1]
    assert pii.find(df.limit(0)).count() == 0
