"""License scan and quality rules against their SQL, on small tables with odd rows, and without Python in the plan."""

import random

import duckdb
import pandas as pd
import pytest

from keylog.llm import license_scan as L
from keylog.llm import quality_rules as Q

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2021 Some Body <some@body.org>

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Copyright (c) 2019, 2020 Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ISC = """ISC License

Copyright 2020 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
BSD3 = BSD2 + NAMES
PUBLISHED = {"MIT": MIT, "BSD-2-Clause": BSD2 + BSD_END, "BSD-3-Clause": BSD3 + BSD_END, "ISC": ISC, "Apache-2.0": "Copyright 2024 Some Body\n\n" + APACHE}
TEXTS = [
    None, "", " \n\t ", APACHE, "Some prose. Released under the MIT License.", "Title\nLicensed under CC BY-NC 4.0.\nmore", "This licence is our own. All rights reserved.",
    "Released under the MIT License. Released under the MIT License.", "x" * 200_000, "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", "A permission slip.",
]


def frames(spark, rows, columns):
    pdf = pd.DataFrame(rows, columns=columns)
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} {t}" for c, t in zip(columns, ("long", "string", "string", "string"), strict=False))), pdf


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_license_scan(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, None), (3, APACHE, "en", "s")]
    docs, documents = frames(spark, rows, ["doc_id", "text", "lang", "source"])
    out = L.license_scan(docs.selectExpr("*", "1 as ids", "2 as found", "3 as sentences"))
    assert "Python" not in plan(out) and "Arrow" not in plan(out) and "Exchange" not in plan(out)
    cols = ["doc_id", "source", "sentence_ids", "licenses", "n_sentences", "n_known", "n_unknown", "status"]
    got = sorted((tuple(r) for r in out.select(*cols).collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", documents.astype({"doc_id": "Int64"}))
    want = sorted(con.sql(L.OP1_SQL).select(", ".join(cols)).fetchall(), key=repr)
    assert got == want
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[3][3] == "Apache-2.0" and by[3][7] == "known" and by[4][3] == "MIT" and by[5][3] == "CC-BY-NC-4.0" and by[6][7] == "partial"
    assert by[7][3] == "MIT" and by[9][3] == "Apache-2.0,MIT" and by[10][7] == "unknown" and by[0][7] == "none"
    assert L.license_scan(docs.limit(0)).count() == 0


def matched(ids):
    """Licenses of an identifier sequence by plain lists."""
    rest, found = [i for i in ids if i != L.OUTSIDE], []
    for name, seq in L.RULES:
        k, i = len(seq), 0
        while i + k <= len(rest):
            if rest[i : i + k] == seq:
                rest[i : i + k] = ["#"]
                found.append(name)
            i += 1
    return list(dict.fromkeys(found))


def test_published_texts_and_adjacent_notices(spark):
    r = random.Random(3)
    texts = [*PUBLISHED.values(), BSD3 + BSD3, BSD3 + "\n" + BSD2, "Released under the MIT License.\n" * 5, "Released under the MIT License. Licensed under the MIT License."]
    sentences = [*L.SENTENCES, "copyright 2020 some body", "a licence of our own"]
    by_id = {}
    for t, i in L.SENTENCES.items():
        by_id.setdefault(i, t)
    for _ in range(150):
        some = [r.choice(sentences) for _ in range(r.randrange(4))]
        for _, seq in r.choices(L.RULES, k=r.randrange(5)):
            at = r.randrange(len(some) + 1)
            some[at:at] = [by_id[i] for i in seq[: r.choice([len(seq), len(seq), len(seq) - 1])]]
        texts.append(". ".join(some) + ".")
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs, documents = frames(spark, rows, ["doc_id", "text", "lang", "source"])
    out = {x.doc_id: x for x in L.op1_of(docs).collect()}
    for k, (name, _) in enumerate(PUBLISHED.items()):
        found = out[k].licenses.split(",")
        assert name in found and set(found) <= {name, "All-Rights-Reserved"} and out[k].status == "known", (name, out[k])
    assert out[5].licenses == "BSD-3-Clause,All-Rights-Reserved" and out[6].licenses.startswith("BSD-3-Clause,BSD-2-Clause")
    for x in out.values():
        assert x.licenses == ",".join(matched(x.sentence_ids.split(",") if x.sentence_ids else [])), x
    con = duckdb.connect()
    con.register("documents", documents)
    cols = ["doc_id", "source", "sentence_ids", "licenses", "n_sentences", "n_known", "n_unknown", "status"]
    assert sorted(con.sql(L.OP1_SQL).select(", ".join(cols)).fetchall()) == sorted(tuple(x[c] for c in cols) for x in out.values())


def quality_rows(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9)))
    rows, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(r.randrange(15, 90))]
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            ws = [w + "###" for w in ws]
        elif bad:
            ws = [w.upper() + "!!" for w in ws]
        if i % 13 == 0:
            ws += ws[:30] * 2
        t = r.choice(["\n", " ", "\t "]).join(ws)
        if i % 17 == 0:
            t = "\n".join([t, "same line", "same line ", "same line", " "])
        rows.append((i, t, r.choice(["en", None]), "s"))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


@pytest.mark.parametrize("n", [60, 3600])
def test_quality_rules(spark, n):
    rows, labels = quality_rows(n, n)
    rows += [(10_000, None, "en", "s"), (10_001, "", "en", "s"), (None, "one two", "zz", None), (10_002, "w " * 60_000, "en", "s"), rows[5]]
    labels += [(None, 1, 0), (2, None, 0), (3, 0, 0), (99_999, 1, 0)]
    docs, documents = frames(spark, rows, ["doc_id", "text", "lang", "source"])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = Q.quality_rules(docs.selectExpr("*", "1 as stratum", "2 as words", "3 as scores"), lab)
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted((tuple(r) for r in out.select(*cols).collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", documents.astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    assert got == sorted(con.sql(Q.OP9_SQL).select(", ".join(cols)).fetchall(), key=repr)
    base = {r[0] for r in got if r[6]}
    dropped = {r[0] for r in got if not r[7] and not r[6]}
    if n == 60:
        assert not dropped  # too few labels to guarantee anything
    else:
        assert all(i % 4 == 0 for i in dropped) and len(dropped) > 0.9 * sum(i % 4 == 0 and i not in base for i in range(n))
    assert Q.quality_rules(docs.limit(0), lab).count() == 0 and Q.quality_rules(docs, lab.limit(0)).where("not kept and not base_failed").count() == 0


def test_binomial_tail():
    assert abs(Q.binomial_tail(10, 2, 0.3) - 0.3827827864) < 1e-9 and Q.binomial_tail(5, 5, 0.1) == 1
    assert 0 < Q.binomial_tail(1_000_000, 4500, 0.005) < 1e-9


def test_strata_are_never_pooled(spark):
    rows = [(i, f"l{i // 4}", False, [500 if i % 4 == 0 else 0] * len(Q.RULES)) for i in range(4000)]
    rows += [(i, "big", False, [500 if i % 7 == 0 else 0] * len(Q.RULES)) for i in range(4000, 8000)]
    sig = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, scores array<int>")
    lab = spark.createDataFrame([(i, int(s[0] == 0)) for i, _, _, s in rows], "doc_id long, quality int")
    cuts = Q.cutoffs(sig, lab)
    assert {k for k, v in cuts.items() if any(c is not None for c in v)} == {"big"}  # three good labels guarantee nothing
