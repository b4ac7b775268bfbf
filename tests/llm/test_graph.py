import random

from radspark.llm.graph import components


def test_components(spark):
    """Paths, a star, loops, null ends and repeated edges, against union-find."""
    rng = random.Random(3)
    ids = rng.sample(range(-(10**9), 10**9), 120)
    edges = [(ids[i], ids[i + 1]) for i in range(50)] + [(ids[60], x) for x in ids[61:90]] + [(ids[100], ids[101])] * 2 + [(ids[110], ids[110]), (None, ids[1]), (ids[2], None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.root for r in got} == {x: find(x) for x in list(root)} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
