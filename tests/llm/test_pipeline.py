import re
from collections import Counter

import corpus_pipeline as P
from keylog.llm import secret_scan, toxicity
from keylog.llm.common import saved, table

D = "/root/testdata/sf0.001"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark):
    docs = table(spark, D, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    clean = P.drop_toxic(spark, docs, D)
    model = toxicity.train(docs, table(spark, D, "labels"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("rejected").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == set(before) - rejected

    once = P.drop_near_copies(spark, docs, D)
    assert once.columns == columns
    up = {i: i for i in before}
    sets = {i: shingles(t) for i, t in before.items()}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in before:
        for j in before:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert {r.doc_id for r in once.collect()} == {i for i in before if root(i) == i}

    left = P.drop_contaminated(spark, docs, D)
    words = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    items = [words(r.text) for r in table(spark, D, "benchmark").collect()]
    whole = {i for i, t in before.items() if any(f" {x} " in f" {words(t)} " for x in items)}
    kept = {r.doc_id for r in left.collect()}
    assert left.columns == columns and not kept & whole and len(kept) > 0.8 * len(before)

    hidden = P.mask_secrets(spark, docs, D)
    assert hidden.columns == columns
    for r in hidden.collect():
        assert not secret_scan.base_spans(r.text or "") and (secret_scan.base_spans(before[r.doc_id] or "") or "[SECRET]" in r.text or r.text == before[r.doc_id])


def test_run(spark):
    rows = P.run(spark, D).collect()
    pieces = {(r.doc_id, r.piece) for r in rows}
    assert len(pieces) == len(rows) > 50 and max(r.offset + r.length for r in rows) <= 1024
    assert [n for n, _ in P.STAGES] == ["toxicity", "near copies", "decontamination", "secrets", "packing"]


def chained(spark, docs):
    """The documents after each stage but the last, and the pieces."""
    out = []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, D)
        if stage is not P.STAGES[-1][1]:
            docs = saved(docs, "chained")
            out.append(docs)
    return out, docs


def test_odd_rows_go_through_all_stages(spark):
    """Nulls, empty and very long texts, repeated rows and ids, columns named like those the stages use."""
    item = table(spark, D, "benchmark").where("length(text) > 100").orderBy("item_id").first().text
    some = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, D, "documents").orderBy("doc_id").limit(40).collect()]
    long = "".join(f"word{i * 7919 % 10007} " for i in range(60_000))
    odd = [
        (None, None, None, None, None), (None, "a text without an id that stays as it is", None, "s", 1), (9001, None, "en", None, None), (9002, "", None, None, 0), (9003, " \n ", "en", "s", 3),
        (9004, long, "en", "s", len(long)), (9005, long, None, None, None), (9006, "same short text", None, "s", 1), (9006, "same short text", None, "s", 1), (9007, "same short text", "en", "s", 1),
        (9008, "some words before " + item + " and after", "en", "s", 1), (9009, "password = 'Zx81kkQw02aaPl' is written here", "en", "s", 1),
    ]
    extra = ["h", "row", "c", "n", "kept", "_gone", "part", "piece", "length", "_part", "region", "item", "toxic", "found"]
    docs = spark.createDataFrame(some + odd, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"{i} as {x}" for i, x in enumerate(extra)))
    (clean, once, left, hidden), pieces = chained(spark, docs)
    assert clean.columns == once.columns == left.columns == hidden.columns == docs.columns
    count = lambda df: Counter(r.doc_id for r in df.collect() if r.doc_id is None or r.doc_id > 9000)
    assert count(clean) == Counter(i for i, *_ in odd)
    want = Counter([None, None, 9001, 9002, 9003, 9004, 9006, 9006, 9008, 9009])  # of equal texts the smallest id stays, in all its rows; those without words are linked with nothing
    assert count(once) == want
    want.pop(9008)
    assert count(left) == want == count(hidden)
    texts = {r.doc_id: r.text for r in hidden.collect() if r.doc_id is not None}
    assert texts[9001] is None and texts[9002] == "" and texts[9004] == long and "Zx81kkQw02aaPl" not in texts[9009] and "[SECRET]" in texts[9009]
    assert all(getattr(r, x) == i for r in hidden.collect() for i, x in enumerate(extra))
    got = pieces.collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in hidden.collect()} and sum(r.piece == 0 for r in got) == hidden.count()


def test_empty_tables(spark):
    kept, pieces = chained(spark, table(spark, D, "documents").limit(0))
    assert [k.count() for k in kept] == [0, 0, 0, 0] and pieces.count() == 0
