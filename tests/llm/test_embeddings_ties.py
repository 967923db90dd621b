"""Near vectors: copies and ties beyond a block, and tables without labels or with clashing columns."""

import numpy as np

from assetspark.llm import embeddings


def test_copies_and_ties_are_split(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "ROWS", 8)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 12))
    base[:, 0] = 0  # all tie on the first coordinate
    data = [base[k % 6] + np.r_[0, rng.standard_normal(11) * 0.12] for k in range(150)] + [base[0]] * 120 + [base[1]] * 3
    rows = [(k, [float(x) for x in v], 1, "a", 7) for k, v in enumerate(data)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string, block int").repartition(4)
    x = np.array(data) / np.linalg.norm(data, axis=1)[:, None]
    near = x @ x.T >= 0.93
    root = np.arange(len(x))
    for _ in range(len(x)):
        low = np.where(near, root[None, :], len(x)).min(axis=1)
        if (low == root).all():
            break
        root = low
    got = {r.vec_id: r for r in embeddings.near_vectors(made).collect()}
    assert len(set(root)) >= 5 and near.sum() > 15_000
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (int(near[k].sum()) - 1, int(root[k]), bool(root[k] == k)) for k in range(len(x))}


def test_no_labels(spark):
    made = spark.createDataFrame([(k, [1.0, 2.0], None) for k in range(5)], "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(made).collect()} == {(k, 0, k, True) for k in range(5)}
