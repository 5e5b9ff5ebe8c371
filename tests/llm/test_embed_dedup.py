import numpy as np
import pytest
from tessella.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, component int"


def plain(rows, threshold):
    """n_links and component_id by comparing all pairs."""
    good = {}
    for k, (_, v, label, _) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float32).astype(float)
    near = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                    near[a].add(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        out.append((rows[k][0], len(near[k]), min(ids) if ids else None, bool(ids) and rows[k][0] == min(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, split", [(1024, None), (16, None), (1024, (3, 16)), (16, (2, 10))])
def test_equals_all_pairs(spark, monkeypatch, block, split):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    if split:  # cells in several orders, however few the classes
        monkeypatch.setattr(embed_dedup, "splits", lambda n, threshold: split)
    rng = np.random.default_rng(4)
    rows = []
    for label in range(3):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.4])], label, 0))
    rows += [(1000 + k, rows[3][1], rows[3][2], 0) for k in range(30)] + [rows[5], rows[5]]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 0, 0), (2001, [0.0] * 16, 0, 0), (2002, [nan] * 16, 0, 0), (2003, [inf] * 16, 1, 0), (2004, [None] * 16, 1, 0), (2005, rows[3][1], None, 0), (2006, [], 1, 0), (2007, [1.0, 2.0], 1, 0), (2008, [2.0, 4.0], 1, 0), (None, rows[3][1], rows[3][2], 0), (None, None, None, 0)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(tuple, embed_dedup.near_duplicates(spark, vectors).collect()), key=str)
    assert found == plain(rows, 0.93)
    assert sum(r[1] for r in found) > 100
    assert embed_dedup.near_duplicates(spark, vectors.limit(0)).count() == 0


def test_calibrated_count_recalls_threshold_pairs():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(400, 64))
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.9300001 * a + np.sqrt(1 - 0.9300001**2) * b
    u, v = embed_dedup.links(a, b, 0.93)
    assert set(range(400)) <= {i for i, j in zip(u, v) if i == j}


def test_splits_recall_threshold_pairs_at_little_cost():
    """Few classes are one cell; of many, each meets few, and pairs at the threshold share a cell of some order."""
    assert embed_dedup.splits(2000, 0.93) == (0, 1)
    costs = []
    for n in (10**6, 10**8):
        signs, orders = embed_dedup.splits(n, 0.93)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** signs) ** orders <= embed_dedup.SPLIT_MISS
        costs.append(orders * (n / 2**signs / 2 + embed_dedup.ROW_COST))
    assert costs[1] < 5 * costs[0]  # for a hundred times the classes
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(3000, 64))
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    signs, orders = embed_dedup.splits(10**6, 0.93)
    together = np.zeros(3000, bool)
    for k in range(orders):
        h = embed_dedup.hyperplanes(64, k)[:, :signs]
        together |= ((a @ h > 0) == (b @ h > 0)).all(axis=1)
    assert together.all()
