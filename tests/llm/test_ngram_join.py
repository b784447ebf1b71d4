import random
import re

import numpy as np
import pytest

from keylog.llm import ngram_join as J
from keylog.llm.graph import components


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcÉé") for _ in range(3)) for _ in range(300)]
    line = " ".join(r.choice(vocab) for _ in range(30))
    base = [[r.choice(vocab) for _ in range(r.randrange(1, 90))] for _ in range(25)]
    rows = []
    for i in range(330):
        w = list(base[0] if i % 3 == 0 and seed % 2 else r.choice(base))
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        if i % 11 == 0:
            w = [line, *(r.choice(vocab) for _ in range(r.randrange(12)))]
        t = r.choice([" ", "  ", "\n"]).join(w)
        rows.append((r.randrange(10_000), t.upper() if i % 7 == 0 else t))
    return [*rows, (20_001, None), (20_000, ""), (20_002, " \n"), (None, rows[0][1]), (None, "alone by itself"), rows[5], (20_003, "a b"), (20_004, "A  B"), (20_005, "big " * 50_000)]


def brute_links(rows):
    """(doc_id, smallest doc_id with an equal set, other sets that link) of every row."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    least, links = {}, {}
    for (d, _), x in zip(rows, sets, strict=True):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    for x in set(sets):
        links[x] = sum(x != y and 100 * len(x & y) >= 75 * len(x | y) for y in set(sets) if x & y)
    return sorted(((d, least.get(x) if x else d, links[x]) for (d, _), x in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize(("seed", "hot", "bits", "unit"), [(1, J.HOT, 64, J.UNIT), (3, 7, 6, 5)])
def test_against_brute_force(spark, seed, hot, bits, unit):
    """Also with postings dealt out in chunks of seven, with names of six bits, which many different sets share, and components in blocks of five."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as c", "2 as n", "3 as component", "4 as f", "5 as block").repartition(3)
    out = J.ngram_join(docs, hot=hot, bits=bits, unit=unit).collect()
    assert sorted(((r.doc_id, r.least_id, r.n_links) for r in out), key=repr) == brute_links(rows)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)
    assert got == brute(rows)
    sets = {}
    for r, t in [(r, t) for r in out for d, t in rows if d == r.doc_id and d is not None and sum(x == d for x, _ in rows) == 1]:
        sets.setdefault(r.class_id, set()).add(frozenset(shingles(t)))
    assert all(len(x) == 1 for x in sets.values()) and len(sets) == len(set().union(*sets.values()))


@pytest.mark.parametrize("k", [2, 30, 90])
def test_overlaps_of_blocks(k):
    """Grams of few sets, of many, and more columns than a matrix holds."""
    r = np.random.default_rng(k)
    sets = [np.unique(np.concatenate([r.integers(0, 60, 40), r.integers(100, 9000, 3000 // k), r.integers(10_000, 10_200, 20)])) for _ in range(k)]
    owner, grams = np.repeat(np.arange(k), [len(s) for s in sets]), np.concatenate(sets)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    whole = J.common(owner, grams, k, k)
    off = ~np.eye(k, dtype=bool)
    assert (whole[off] == want[off]).all()
    assert (J.common(owner, grams, k, k // 2) == want[: k // 2, k // 2 :]).all()


def test_fragments_follow_the_global_order_with_equal_loads(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = J.frequent_grams(docs)
    count = {}
    for _, t in rows:
        for x in shingles(t):
            count[x] = count.get(x, 0) + 1
    assert order.load == sum(count.values()) and sorted(order.counts.tolist()) == sorted(c for c in count.values() if c > J.OFTEN)
    texts = __import__("pyarrow").array([t or "" for _, t in rows])
    g = np.concatenate(list(J.gram_sets(texts, 5)))
    f, often = order.fragment(g, J.FRAGMENTS), order.often(g)[0]
    by = np.lexsort((g, often))
    assert (np.diff(f[by]) >= 0).all()
    loads = np.bincount(f, minlength=J.FRAGMENTS)
    assert loads.sum() == order.load and loads.max() < 1.5 * order.load / J.FRAGMENTS + order.counts.max()


def test_keep_one_and_empty(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as lang")
    want = {d for d, _, c in brute(rows) if d == c}
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == want - {None}
    assert J.ngram_join(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    n = 100
    order = list(range(n))
    random.Random(0).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1000, 1000)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert {got[i] for i in range(n)} == {0} and got[1001] == 1000
