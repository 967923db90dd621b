import random

from assetspark.llm.graph import components
from assetspark.llm.suffixes import suffix_array


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(roots) == set(range(61)) | set(range(100, 140)) | {200, 201}
    groups = {}
    for node, root in roots.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(min, groups.values())) == [0, 100, 200]


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array_is_the_order_of_suffixes():
    rng = random.Random(1)
    for _ in range(3000):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 3, 9])
        text = bytes(rng.randrange(k) for _ in range(n))
        if rng.random() < 0.4 and n:
            text = (text[: rng.randint(1, n)] * 9)[:60]
        assert list(suffix_array(text)) == sorted(range(len(text)), key=lambda i: text[i:])
