import random

import numpy as np
import pandas as pd
import pytest
from tessella.llm import common, minhash


def plain(rows, width, percent):
    """n_shingles and component_id by comparing all pairs of sets of words."""
    sets = []
    for _, text in rows:
        words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        n = len(words) - width + 1
        sets.append({tuple(words[k : k + width]) for k in range(n)} if n > 0 else {tuple(words)} if words else set())
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    out = []
    for (doc, _), s, k in zip(rows, sets, least):
        ids = [rows[j][0] for j in range(len(rows)) if least[j] == k and rows[j][0] is not None]
        component = min(ids) if ids else None
        if not s:
            component = doc
        out.append((doc, len(s), component, doc is not None and doc == component))
    return sorted(out, key=str)


def corpus(seed, n_words):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(900))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, n_words))]
        for _ in range(rng.choice([1, 1, 2, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(copy)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "two words"), (906, "two words"), (None, rows[0][1]), (907, "É x y"), (908, "é x y"), (5, rows[5][1]), (None, "alone in the world with no id"), (909, "same " * 3000), (910, "same same same")]
    return rows


@pytest.mark.parametrize("seed, width, percent", [(1, 3, 85), (2, 5, 80)])
def test_equals_all_pairs(spark, monkeypatch, seed, width, percent):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # several blocks in a region
    rows = corpus(seed, 120)
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, set binary, row int")
    found = sorted((tuple(r) for r in minhash.near_duplicates(spark, docs.repartition(3), width, percent).drop("row").collect()), key=str)
    expected = plain(rows, width, percent)
    assert found == expected
    assert minhash.near_duplicates(spark, docs.limit(0), width, percent).count() == 0


def sorted_rows(rng, n_branches):
    """Rows of a range, sorted: branches of 1 to 40 classes with equal prefixes."""
    rows = []
    for branch in range(n_branches):
        prefix = branch.to_bytes(4, "big") * minhash.LEAST
        for _ in range(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 40])):
            name = len(rows).to_bytes(4, "big")
            rows.append((branch % 16, prefix + name * (minhash.DEPTH - minhash.LEAST), name, 7, b"\0" * 16))
    return sorted(rows)


def covered(pairs, full):
    """Pairs that are candidates or lie in one full branch."""
    branches = {}
    for branch, name in full:
        branches.setdefault(branch, []).append(name)
    return set(pairs) | {(x, y) for names in branches.values() for x in names for y in names if x < y}


@pytest.mark.parametrize("seed", range(8))
def test_walk_leaves_no_pair_of_a_branch_out(seed):
    rng = random.Random(seed)
    rows = sorted_rows(rng, 30)
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.choice([0, 3, 30])))})
    batches = [pd.DataFrame(rows[a:b], columns=["part", "key", "set", "n", "sketch"]) for a, b in zip(cuts, cuts[1:])]
    out = pd.concat(minhash.walk(iter(batches), minhash.WINDOW))
    pairs = out[out["b"].notna()]
    full = out[out["b"].isna()]
    assert not full.duplicated(["branch", "a"]).any() and not pairs.duplicated(["a", "b"]).any()
    of = {r[2]: (r[0], r[1][: 4 * minhash.LEAST]) for r in rows}
    wanted = {(x, y) for x in of for y in of if x < y and of[x] == of[y]}
    assert covered(zip(pairs["a"], pairs["b"]), zip(full["branch"], full["a"])) == wanted
    first, last = of[rows[0][2]], of[rows[-1][2]]
    sizes = {k: list(of.values()).count(k) for k in of.values()}
    assert set(full["a"]) == {x for x, k in of.items() if sizes[k] > minhash.WINDOW + 1 or k in (first, last)}


def test_branches_across_ranges(spark):
    """No pair of a branch is left out where an order is cut into ranges."""
    rows = sorted_rows(random.Random(1), 60)
    df = spark.createDataFrame(rows, "part int, key binary, set binary, n long, sketch binary").repartition(7)
    pairs, full = minhash.candidates(common.Scratch(spark, "test-forest"), df)
    of = {r[2]: (r[0], r[1][: 4 * minhash.LEAST]) for r in rows}
    found = covered({(bytes(r.a), bytes(r.b)) for r in pairs.collect()}, {(bytes(r.branch), bytes(r.set)) for r in full.collect()})
    assert found == {(x, y) for x in of for y in of if x < y and of[x] == of[y]}


def test_recall_of_templates_at_real_constants(spark):
    """Thousands of documents over few templates, most under the threshold: all links of brute force end in one component."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    templates = [[word() for _ in range(90)] for _ in range(4)]
    rows = []
    for k in range(3000):
        text = list(templates[k % 4])
        for _ in range(rng.choice([1, 2, 3, 6, 8])):
            text[rng.randrange(len(text))] = word()
        rows.append((k, " ".join(text)))
    sets = minhash.shingle_sets([t for _, t in rows], 3)
    least = np.arange(len(rows))
    links = []
    for k in range(4):
        own = list(range(k, len(rows), 4))
        common_n = minhash.common_counts([sets[i] for i in own], [sets[i] for i in own])
        total = np.add.outer([len(sets[i]) for i in own], [len(sets[i]) for i in own])
        u, v = np.nonzero(100 * common_n >= 85 * (total - common_n))
        links += [(own[i], own[j]) for i, j in zip(u, v)]
    nodes, roots = common.stars(*np.array(links).T)
    least[nodes] = roots
    assert 5 < len(set(least.tolist())) < 2990
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, docs, 3, 85).collect()}
    assert [found[k] for k in range(len(rows))] == least.tolist()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5300)]
    least = {x: x for e in edges for x in e}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    expected = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.id: r.component for r in common.components(common.Scratch(spark, "test-cc"), df).collect()} == expected
    assert common.components(common.Scratch(spark, "test-cc"), df.limit(0)).count() == 0
