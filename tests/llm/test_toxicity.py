import random

import numpy as np

from keylog.llm import toxicity as X


def corpus(n=1500, seed=3):
    r = random.Random(seed)
    plain = ["".join(r.choice("abdefgilmnorstu") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    rude = ["zugh", "zughon", "zughar", "blarx"]
    docs, labels = [], []
    for i in range(n):
        t = [r.choice(plain) for _ in range(r.randrange(20, 120))]
        bad = i % 9 == 0
        for _ in range(r.randrange(1, 7) if bad else 0):
            t.insert(r.randrange(len(t)), r.choice(rude))
        docs.append((i, " ".join(t).title()))
        if i % 2 == 0 or i % 9 == 0:
            labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (None, "zughix blarx"), (5002, "x " * 200_000 + "zughen blarx blarx"), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as toxic", "0 as h")
    lab = spark.createDataFrame([*labels, (None, 1), (1, None), (99999, 1)], "doc_id long, toxic int")
    model = X.train(d, lab)
    assert len(model.calibration) == 2 and all(abs(mean - share) < 0.1 for mean, share in model.calibration)
    out = X.score(d, model).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    seen = {i for i, _ in labels}
    new = [i for i in range(1500) if i not in seen]
    assert not any(by[i].rejected for i in new)
    hits = [by[i].rejected for i in range(0, 1500, 9)]
    assert np.mean(hits) > 0.95
    assert by[None].rejected and by[5002].rejected
    assert by[5000].severity == by[5001].severity == 0 and not by[5000].rejected
    mild = np.mean([by[i].severity for i in range(0, 1500, 9)])
    assert mild > 0.8 > np.mean([by[i].severity for i in new])
    kept = X.filter_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(not r.rejected for r in out)


def test_without_labels_nothing_is_rejected(spark):
    d = spark.createDataFrame([(1, "idiot"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r.rejected for r in X.score(d, X.train(d, none)).collect())
    assert X.score(d.limit(0), X.train(d.limit(0), none)).count() == 0


def test_gradient_fits_ordered_thresholds():
    r = np.random.default_rng(0)
    x = r.integers(0, 5, (600, 3))
    z = x @ [1.5, 0.0, -1.0] + r.logistic(size=600)
    grades = (z > 1).astype(int) + (z > 3)
    rows, cols = np.nonzero(x)
    w, theta = X.fit_cumulative(rows, cols, x[rows, cols].astype(float), grades, 3, 1e-4, 2000)
    assert np.allclose(w, [1.5, 0, -1], atol=0.4) and np.allclose(theta, [1, 3], atol=0.6)


def test_only_near_copies_with_the_same_label_count_once(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abdefgilmnorstu") for _ in range(r.randrange(4, 9)))
    common = [word() for _ in range(300)]
    texts = [" ".join(r.sample(common, 80)) for _ in range(40)]  # unrelated, of common words
    copy = [texts[0] + " again", texts[1].replace(texts[1].split()[5], "other"), texts[2] + " again"]
    rows = list(enumerate([*texts, *copy]))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i == 42 or 10 <= i < 20)) for i, _ in rows], "doc_id long, toxic int")
    got = X.labelled_sample(d, lab).toArrow().sort_by("h")
    signs = np.stack([np.frombuffer(x.as_py(), dtype="<u4") for x in got["sign"]])
    toxic = np.asarray(got["toxic"]).astype(bool)
    keep = X.distinct(signs, toxic)
    assert len(toxic) == 43 and keep.sum() == 41 and toxic[keep].sum() == 11


def test_scores_equal_a_plain_scorer(spark):
    docs, labels = corpus(400, 5)
    docs += [(900, None), (901, ""), (902, "ZUGH" * 3 + " zugh-zugh blarx1blarx É zughonen")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.train(d, lab)
    assert model.weights and len(model.calibration) == 2
    for r in X.score(d, model).collect():
        t = dict(docs)[r.doc_id] or ""
        found, word = {}, ""
        for c in t.lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                for f in [word, *("^" + word[:k] for k in X.PREFIXES if len(word) > k)]:
                    found[f] = found.get(f, 0) + 1
                word = ""
        z = sum(w * np.log1p(found[f]) for f, w in model.weights.items() if f in found)
        p = [1 / (1 + np.exp(c - z)) if t else 0.0 for c in model.theta]
        assert abs(r.p_toxic - p[0]) < 1e-9 and abs(r.severity - sum(p)) < 1e-9 and r.rejected == (bool(t) and p[0] >= model.cut)


def test_features_are_counted_on_executors(spark):
    docs, labels = corpus(300, 6)
    rows = X.labelled_sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), fit_rows=100)
    assert rows.count() == 100
    texts = dict(docs)
    base = rows.where("toxic").count() / 100
    df, bad = {}, {}
    for r in rows.collect():
        for w in r.words:
            df[w] = df.get(w, 0) + 1
            bad[w] = bad.get(w, 0) + r.toxic
    tried = [w for w in df if base ** df[w] <= X.CHANCE]
    want = sorted(w for w in tried if bad[w] > 1.5 * base * df[w] and X.tail(df[w], bad[w], base) <= X.CHANCE / len(tried))
    assert X.vocabulary(rows, base) == want and len(texts) == 300
