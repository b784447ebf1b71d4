import random

import numpy as np
import pyarrow as pa

from keylog.llm import bytewords as B
from keylog.llm import decontaminate as D


def words(t):
    out, w = [], ""
    for c in t + " ":
        if c.isalnum() or ord(c) > 127:
            w += c.lower() if c.isascii() else c
        elif w:
            out.append(w)
            w = ""
    return out


def sellers(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(r, ws, n, vocab):
    ws = list(ws)
    for _ in range(n):
        p = r.randrange(len(ws))
        kind = r.randrange(3)
        if kind == 0:
            ws[p] = r.choice(vocab)
        elif kind == 1:
            del ws[p]
        else:
            ws.insert(p, r.choice(vocab))
    return ws


def test_against_brute_force(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdé") for _ in range(r.randrange(2, 6))) for _ in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(8, 60))).capitalize() + ".") for i in range(40)] + [(90, None), (91, ""), (None, "one lonely item of a few words"), (92, "Hi"), (93, "Qqq")]
    items += [(94, items[5][1]), (5, items[5][1])]  # repeated items
    docs = []
    for i in range(260):
        ws = [r.choice(vocab) for _ in range(r.randrange(0, 150))]
        for _ in range(r.randrange(3)):
            item = words(items[r.randrange(40)][1])
            p = r.randrange(len(ws) + 1)
            ws[p:p] = edited(r, item, r.randrange(0, int(0.2 * len(item)) + 3), vocab)
        docs.append((i, ", ".join(ws).replace(", ", " ", 3)))
    docs += [(900, None), (901, ""), (None, "x one LONELY item of a few words"), (902, "z " * 100_000 + items[3][1]), (0, docs[0][1]), (903, "some words, QQQ!"), (904, items[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as distance")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = D.contamination(d, b).collect()
    assert all(r.distance <= int(0.2 * r.n_words + 1e-9) for r in got)
    got_pairs = {(r.doc_id, r.item_id): r.distance for r in got}
    want = {}
    for i, t in docs:
        if i == 902:
            continue
        tw = words(t or "")
        for k, x in items:
            iw = words(x or "")
            if iw and (s := sellers(iw, tw)) <= int(0.2 * len(iw) + 1e-9):
                want[i, k] = s
    assert (902, 3) in got_pairs and (None, None) in got_pairs and (903, 93) in got_pairs
    assert sum(r.doc_id == 904 and r.item_id in (5, 94) for r in got) == 3  # every row of a repeated item is reported
    assert sum(r.doc_id == 0 for r in got) == 2 * len([k for k in got_pairs if k[0] == 0])  # and every row of a repeated document
    assert {k for k in got_pairs if k[0] != 902} <= set(want)
    assert len(set(want) & set(got_pairs)) >= D.RECALL * len(want) and len(want) > 120
    assert sum(got_pairs[k] == want[k] for k in got_pairs if k in want) >= 0.98 * len(got_pairs)
    assert all(k in got_pairs for k, s in want.items() if s == 0)
    kept = D.decontaminated(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(i not in {k for k, _ in got_pairs} for i, _ in docs)
    assert D.contamination(d.limit(0), b).count() == 0 and D.contamination(d, b.limit(0)).count() == 0


def test_recall_at_the_largest_distance():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    as_hash = lambda ws: B.word_hashes(*B.text_bytes(pa.array([" ".join(ws)])), B.PLAIN)[0]
    found = total = 0
    for _ in range(150):
        item = [r.choice(vocab) for _ in range(r.randrange(14, 60))]
        e = int(0.2 * len(item))
        text = [r.choice(vocab) for _ in range(30)] + edited(r, item, e, vocab) + [r.choice(vocab) for _ in range(30)]
        ws, h = as_hash(item), as_hash(text)
        bits = D.Bits(100)
        bits.add(D.gate_hashes(ws))
        gate = D.Gate(bits, [len(ws), 30])
        starts = gate.windows(h, gate.pieces(h))[len(ws)]  # the gate loses nothing
        total += 1
        found += bool((D.window_keys(h, len(ws), starts) == D.window_keys(ws, len(ws), np.zeros(1, dtype=np.int64))).any())
    assert found >= D.RECALL * total


def test_words_of_batches():
    texts = ["Ab c", "", "d", "ab", "  c D  ", "é É", "x" * 1000]
    h, first = B.word_hashes(*B.text_bytes(pa.array(["skip", *texts]).slice(1)), B.SPACED)
    assert list(np.diff(first)) == [2, 0, 1, 1, 2, 2, 1]
    assert h[0] == h[3] and h[1] == h[4] and h[2] == h[5] and h[6] != h[7]
