"""Secret scans: fixed patterns plus a character convolutional network.

Base findings come from three patterns and always stay. Beside them every
*candidate*, a maximal run of 12 or more key-like characters that base findings do not cover whole, is
judged by a small convolutional network in numpy that sees the whole candidate, however long, and the
characters around it. Its training data are labelled findings:

* base findings (positive, with the telling keyword masked in every second copy, so that the shape
  of the value must count);
* candidates that no pattern found (negative), unless they mix kinds of characters as keys do: what those
  are is not known, so they are neither trained nor measured on;
* public credential and identifier formats from a seeded generator (both).

The first two are all distinct findings of the whole texts of all documents. They are dealt out by their hash into parts of
about ``PART`` findings; in each of ``ROUNDS`` rounds every part goes on from the same network over all it holds, and the mean of the
parts' networks starts the next round (iterative parameter mixing). Means are sums of whole numbers, so they
depend neither on the order nor on the grouping of tasks. Of a kind with few findings each goes to several parts, so
that about ``LEAST`` are in every part; the generated ones are in all of them. One task holds one part, the driver a network for each task.
On all held-out findings (every fourth, by its content) the outputs are calibrated (Platt scaling), and the threshold lies just below the
highest one that reaches the required recall (half way to the next negative finding), found by ranks, not from bins or a sample;
the recall and precision that the held-out findings have there are kept with the network.

Training reads the documents once and shuffles their findings twice. Scoring is one map over the documents, whole texts, no
shuffle; the network is a few thousand numbers in the closure.

Edge cases: null and empty texts have no spans; offsets are code points with the end
exclusive; repeated documents each get a row; documents without an id are scanned and trained on like others;
other columns are never read; without findings to train on, only the generated ones are used.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.functions.stats import percentile_frame
from keylog.llm.common import BATCH_ROWS, drop_saved, saved, table, whole_text

#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # finds what [0-9a-f]+ does among runs of 16 or more
KINDS = ("assign", "access", "hex", "model")
KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")  # what any assign match holds

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
PART = 8192  #: expected number of findings of the larger kind in a part
LEAST = 32  #: findings of each kind that a part is to hold at least, if there are as many
ROUNDS, STEPS = 4, 100  #: rounds of training, and the least steps that a part takes in one
BATCH = {True: (24, 8), False: (96, 32)}  #: secrets and others in a step: found and generated ones
MADE = 4000  #: generated findings
UNIT = 2.0**-40  #: of the numbers that networks are summed in
CONTEXT, BODY = 24, 48  #: characters seen on either side, and of the candidate itself
WIDTH = CONTEXT + BODY + CONTEXT
ALPHABET = 16
FILTERS, SPAN = 24, 5
RECALL = 0.95

SPANS = "doc_id long, kinds array<string>, starts array<int>, ends array<int>, scores array<double>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, sorted."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Key-like runs of 12 or more characters, without a sentence's end, that no finding covers whole."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-/_+":
            b -= 1  # the end of a sentence is not part of a key
        if b - a >= 12 and not (taken and any(s <= a and b <= e for s, _, e in taken)):
            out.append((a, b))
    return out


def unclear(body: str) -> bool:
    """Whether a run that no pattern found mixes kinds of characters as keys do, so that nobody knows what it is."""
    kinds = [1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 0 for c in body]
    turns = sum(x != y and x > 0 and y > 0 for x, y in zip(kinds, kinds[1:], strict=False))
    return len(body) >= 16 and turns >= 4


_CLASS = np.zeros(128, dtype=np.int8)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s in "abcdef" else 2 if _s.islower() else 3 if _s in "ABCDEF" else 4 if _s.isupper() else 5 if _s.isdigit() else 6 if _s == " " else 7 if _s in "\n\r\t" else 8 if _s in "\"'`" else 9 if _s in "=:" else 10 if _s in "+/" else 11 if _s in "-_" else 12 if _s in ".,;!?" else 13 if _s in "@#$%&*" else 14


def classes(text: str) -> np.ndarray:
    """The class of every character; 15 stands for other scripts."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.where(code < 128, _CLASS[np.minimum(code, 127)], 15).astype(np.int8)
    out[code == 0] = 0
    return out


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """One row of classes for each span: the context before, the span (its ends, if it is longer than BODY), the context after; 0 pads."""
    c = np.concatenate([np.zeros(CONTEXT, dtype=np.int8), classes(text), np.zeros(CONTEXT, dtype=np.int8)])
    a, b = (np.array([s[k] for s in spans], dtype=np.int64)[:, None] + CONTEXT for k in (0, 1))
    left = c[a - CONTEXT + np.arange(CONTEXT)]
    right = c[b + np.arange(CONTEXT)]
    i = np.arange(BODY)
    at = np.where((b - a > BODY) & (i >= BODY // 2), b - BODY + i, a + i)
    body = np.where(i < b - a, c[np.minimum(at, len(c) - 1)], 0)
    return np.concatenate([left, body, right], 1).astype(np.int8)


def pieces(body: np.ndarray) -> np.ndarray:
    """Rows that cover all of a long span: BODY characters each, so overlapping that every SPAN characters in a row stand in one."""
    step = BODY - SPAN + 1
    n = max(1, -(-(len(body) - SPAN + 1) // step))
    padded = np.concatenate([body, np.zeros(n * step + BODY - len(body), dtype=np.int8)])
    inner = padded[np.arange(n)[:, None] * step + np.arange(BODY)]
    none = np.zeros((n, CONTEXT), dtype=np.int8)
    return np.concatenate([none, inner, none], 1)


def hints(body: str) -> list[float]:
    """Two numbers beside the convolution: entropy of the characters, and length."""
    n = len(body)
    return [-sum(k / n * math.log2(k / n) for k in Counter(body).values()) / 5, min(n, 80) / 40]


@dataclass
class Network:
    """Embedding by one-hot classes, one convolution, maximum over body and over context, a linear layer."""

    conv: np.ndarray  # SPAN x ALPHABET x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS + 2 + 1
    scale: tuple[float, float] = (1.0, 0.0)
    cut: float = 0.5
    recall: float | None = None  # of the held-out findings, at the cut
    precision: float | None = None

    def tops(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the places of every filter's maximum inside and around the span, and the maxima."""
        n, w = x.shape[0], x.shape[1] - SPAN + 1
        z = np.broadcast_to(self.bias, (n, w, FILTERS)).copy()
        for k in range(SPAN):
            z += self.conv[k][x[:, k : k + w]]
        inside = np.zeros(w, dtype=bool)
        inside[CONTEXT : CONTEXT + BODY - SPAN + 1] = True
        at_in = z[:, inside].argmax(1) + CONTEXT
        place = np.flatnonzero(~inside)
        at_out = place[z[:, ~inside].argmax(1)]
        rows, f = np.arange(n)[:, None], np.arange(FILTERS)
        return at_in, at_out, np.concatenate([z[rows, at_in, f], z[rows, at_out, f]], 1)

    def forward(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        at_in, at_out, top = self.tops(x)
        feats = np.concatenate([np.maximum(top, 0), h, np.ones((len(x), 1))], 1)
        return feats @ self.out, (at_in, at_out, top, feats)

    def logits(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Of spans (text, start, end): the maximum of every filter is taken over the whole span, in blocks of bounded size."""
        out = np.zeros(len(found))
        i = 0
        while i < len(found):
            text = found[i][0]
            j = i
            while j < len(found) and found[j][0] is text and j - i < 512:
                j += 1
            spans = [(a, b) for _, a, b in found[i:j]]
            top = self.tops(windows(text, spans))[2]
            for k, (a, b) in enumerate(spans):
                if b - a > BODY:  # the row of its ends gives the surroundings only
                    top[k, :FILTERS] = -np.inf
                    for s in range(a, b - SPAN + 1, 256 * (BODY - SPAN + 1)):
                        part = classes(text[s : min(b, s + 256 * (BODY - SPAN + 1) + SPAN - 1)])
                        top[k, :FILTERS] = np.maximum(top[k, :FILTERS], self.tops(pieces(part))[2][:, :FILTERS].max(0))
            h = np.array([hints(text[a:b]) for a, b in spans])
            out[i:j] = np.concatenate([np.maximum(top, 0), h, np.ones((j - i, 1))], 1) @ self.out
            i = j
        return out

    def probability(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logits(found) + self.scale[1], -40, 40)))


def packed(net: Network) -> np.ndarray:
    return np.concatenate([net.conv.ravel(), net.bias, net.out])


def unpacked(numbers: np.ndarray) -> Network:
    conv, bias, out = np.split(numbers, np.cumsum([SPAN * ALPHABET * FILTERS, FILTERS]))
    return Network(conv.reshape(SPAN, ALPHABET, FILTERS), bias, out)


def fresh(seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    return Network(r.normal(0, 0.25, (SPAN, ALPHABET, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.2, 2 * FILTERS + 3))


def batches(r: np.random.Generator, y: np.ndarray, old: np.ndarray) -> list[np.ndarray]:
    """The rows of each step: all of them are used, those of one kind and source as often as each other, up to one."""
    pools = {(kind, source): np.flatnonzero((y == kind) & (old == source)) for kind in (True, False) for source in (False, True)}
    take = {}
    for kind in (True, False):
        sizes = [n if len(pools[kind, source]) else 0 for source, n in zip((False, True), BATCH[kind], strict=True)]
        for source in (False, True):
            take[kind, source] = sum(BATCH[kind]) if sizes[source] and not sizes[not source] else sizes[source]
    steps = max([STEPS, *(-(-len(pools[k, False]) // n) for (k, source), n in take.items() if n and not source)])
    order = {k: np.concatenate([r.permutation(pools[k]) for _ in range(-(-steps * n // len(pools[k])))]) for k, n in take.items() if n}
    return [np.concatenate([o[t * take[k] : (t + 1) * take[k]] for k, o in order.items()]) for t in range(steps)]


def improved(net: Network, x: np.ndarray, h: np.ndarray, y: np.ndarray, seed: tuple[int, ...]) -> Network:
    """Adam on the logistic loss, kinds weighed alike, once or more over all findings given and beside them the generated ones."""
    old = np.arange(len(y) + len(made()[2])) >= len(y)
    x, h, y = (np.concatenate(z) for z in zip((x, h, y), made(), strict=True))
    net = unpacked(packed(net))
    par = [net.conv, net.bias, net.out]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    f = np.arange(FILTERS)
    for t, i in enumerate(batches(np.random.default_rng(seed), y, old), 1):
        logit, (at_in, at_out, top, feats) = net.forward(x[i], h[i])
        yi = y[i]
        g = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - yi) * np.where(yi, 0.5 / max(1, yi.sum()), 0.5 / max(1, (~yi).sum()))
        d_out = feats.T @ g + 1e-4 * net.out
        d_top = g[:, None] * net.out[: 2 * FILTERS] * (top > 0)
        d_conv, d_bias = 1e-4 * net.conv, d_top[:, :FILTERS].sum(0) + d_top[:, FILTERS:].sum(0)
        for at, d in ((at_in, d_top[:, :FILTERS]), (at_out, d_top[:, FILTERS:])):
            for k in range(SPAN):
                to = np.take_along_axis(x[i], at + k, 1).astype(np.int64) * FILTERS + f
                d_conv[k] += np.bincount(to.ravel(), d.ravel(), ALPHABET * FILTERS).reshape(ALPHABET, FILTERS)
        for j, d in enumerate((d_conv, d_bias, d_out)):
            m[j] = 0.9 * m[j] + 0.1 * d
            v[j] = 0.99 * v[j] + 0.01 * d * d
            par[j] -= 0.02 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
    return net


def generated(n: int, seed: int = 11) -> list[tuple[str, str, str, bool]]:
    """Labelled findings (left, body, right, secret) in publicly documented formats."""
    r = random.Random(seed)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda s, k: "".join(r.choice(s) for _ in range(k))
    word = lambda: "".join(r.choice("bcdfghklmnprstvwz") + r.choice(["a", "e", "i", "o", "u", "en", "er", "al", "ist"]) for _ in range(r.randrange(1, 4)))
    prose = lambda: " ".join(word() for _ in range(5))
    secrets = [
        lambda: "ghp_" + some(low + up + num, 36), lambda: "xoxb-" + some(num, 12) + "-" + some(low + up + num, 24), lambda: "sk_live_" + some(low + up + num, 24),
        lambda: some(low, r.randrange(20, 40)), lambda: some(up, r.randrange(20, 40)), lambda: "/".join([word(), word(), some(low + up + num, 40), word()]),
        lambda: some(low + up + num + "+/", 40), lambda: base64.b64encode(r.randbytes(30)).decode(), lambda: some(low + up + num, r.randrange(20, 44)), lambda: some("0123456789ABCDEF", r.choice([32, 40, 64])),
    ]
    others = [
        lambda: f"{word()}.{word()}.com/{word()}/{word()}{some(num, 3)}", lambda: f"{word()}-{word()}-{some(num, 4)}", lambda: f"20{some(num, 2)}-0{some('123456789', 1)}-1{some(num, 1)}T1{some(num, 1)}", lambda: f"{word()}_{word()}_{word()}{some(num, 2)}",
        lambda: "-".join(some(num, 4) for _ in range(4)), lambda: f"{some(num, 3)}.{some(num, 3)}.{some(num, 3)}.{some(num, 3)}", lambda: word().title() + word().title() + word().title(), lambda: "".join(word() for _ in range(r.randrange(4, 7))), lambda: "".join(word() for _ in range(r.randrange(4, 7))).title(), lambda: "".join(word() for _ in range(r.randrange(4, 7))).upper(),
        lambda: "-".join(word() for _ in range(r.randrange(3, 8))), lambda: "/".join(["", *(word() for _ in range(r.randrange(4, 14)))]), lambda: "_".join(word().upper() for _ in range(r.randrange(3, 6))), lambda: r.choice("-_=.") * r.randrange(12, 80), lambda: f"{word()}.{word()}{some(num, 2)}.{word()}", lambda: some(num, r.randrange(12, 16)), lambda: f"v{some(num, 1)}.{some(num, 2)}.{some(num, 1)}-{word()}.{some(num, 1)}",
    ]
    lead = ['key = "', "auth: ", "Bearer ", "credential=", "", " "]
    out = []
    for i in range(n):
        if i % 2:
            out.append((prose() + " " + r.choice(lead), r.choice(secrets)(), r.choice(['"', " ", "\n"]) + prose(), True))
        else:
            out.append((prose() + r.choice([" ", " ", ": ", "\n"]), r.choice(others)(), r.choice([" ", ". ", "\n"]) + prose(), False))
    return out


def findings(text: str) -> list[tuple[str, str, str, bool]]:
    """Labelled findings (left, body, right, secret) of a text: base ones positive, with and without their keyword, other candidates negative unless unclear."""
    out = []
    taken = base_spans(text)
    for a, kind, b in taken:
        if kind == 0:
            a = ASSIGN.match(text, a).start(2)
        if text[a:b].isdigit():
            continue  # a number that reads as hex says nothing about secrets
        left = text[max(0, a - CONTEXT) : a]
        out.append((left, text[a:b], text[b : b + CONTEXT], True))
        out.append((re.sub(r"\S", "x", left), text[a:b], text[b : b + CONTEXT], True))
    for a, b in candidates(text, taken):
        if not any(s < b and a < e for s, _, e in taken) and not unclear(text[a:b]):
            out.append((text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT], False))
    return out


def _digest(*parts: str) -> bytes:
    return hashlib.md5("\0".join(parts).encode("utf-8", "replace")).digest()


def held_out(body: str) -> bool:
    """Every fourth finding, by its content, is not trained on."""
    return _digest(body)[0] % 4 == 0


def features(rows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """What the network sees of findings (left, body, right): the classes of ``windows``, all read at once, and the hints."""
    ends = lambda t: t if len(t) <= BODY else t[: BODY // 2] + t[-BODY // 2 :]
    text = "".join(a[-CONTEXT:].rjust(CONTEXT, "\0") + ends(b).ljust(BODY, "\0") + c[:CONTEXT].ljust(CONTEXT, "\0") for a, b, c in rows)
    return classes(text).reshape(-1, WIDTH), np.array([hints(b) for _, b, _ in rows]).reshape(-1, 2)


@lru_cache(1)
def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The generated findings to train on: classes, hints, labels."""
    rows = [r for r in generated(MADE) if not held_out(r[1])]
    return *features([r[:3] for r in rows]), np.array([r[3] for r in rows])


def logits_of(net: Network, rows: list[tuple[str, str, str]]) -> np.ndarray:
    """Of findings (left, body, right), in blocks; long ones as ``Network.logits`` reads them."""
    out = np.zeros(len(rows))
    for i in range(0, len(rows), 256):
        x, h = features(rows[i : i + 256])
        out[i : i + 256] = net.forward(x, h)[0]
    for i, (a, b, c) in enumerate(rows):
        if len(b) > BODY:
            out[i] = net.logits([(a + b + c, len(a), len(a) + len(b))])[0]
    return out


def platt(sums: Callable[[float, float], tuple]) -> tuple[float, float]:
    """Platt scaling by Newton steps; sums(a, b) are those of (p - y) * logit, p - y, w * logit ** 2, w * logit and w = p * (1 - p)."""
    a, b = 1.0, 0.0
    for _ in range(30):
        s = sums(a, b)
        step = np.clip(np.linalg.solve([[s[2] + 1e-3, s[3]], [s[3], s[4] + 1e-3]], [s[0] + 1e-3 * (a - 1), s[1]]), -2, 2)
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def threshold(logit: np.ndarray, y: np.ndarray, recall: float) -> float:
    """The highest score that keeps the recall, moved half way down to the next negative: no further false finding."""
    mine, other = np.sort(logit[y]), np.sort(logit[~y])
    top = float(mine[math.floor(len(mine) * (1 - recall))])
    below = other[other < top]
    return (top + float(below[-1])) / 2 if len(below) else top - 1


def fit(rows: list[tuple[str, str, str, bool]], recall: float = RECALL) -> Network:
    """What ``train`` does, on findings in memory, as one part."""
    rows = sorted(rows, key=lambda r: _digest(*r[:3]).hex())
    mine = [r for r in rows if not held_out(r[1])]
    x, h = features([r[:3] for r in mine])
    y = np.array([r[3] for r in mine], dtype=bool)
    net = fresh()
    for k in range(ROUNDS):
        net = improved(net, x, h, y, (k, 0))
    held = [r for r in rows + generated(MADE) if held_out(r[1])]
    logit, yh = logits_of(net, [r[:3] for r in held]), np.array([r[3] for r in held])

    def sums(a: float, b: float) -> tuple:
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        w = p * (1 - p)
        return ((p - yh) * logit).sum(), (p - yh).sum(), (w * logit**2).sum(), (w * logit).sum(), w.sum()

    net.scale = platt(sums)
    at = threshold(logit, yh, recall)
    found = logit >= at
    return cut_at(net, at, float(found[yh].mean()), float(yh[found].mean()))


def cut_at(net: Network, at: float, recall: float, precision: float) -> Network:
    net.cut = float(1 / (1 + np.exp(-np.clip(net.scale[0] * at + net.scale[1], -40, 40))))
    net.recall, net.precision = recall, precision
    return net


def sampled(docs: DataFrame, sample_docs: int | None = None) -> DataFrame:
    """(h, left, body, right, secret, held): the distinct findings of the whole texts of all documents, or of about ``sample_docs`` of those with an id."""
    if sample_docs is not None:
        share = min(1.0, sample_docs / max(1, docs.count()))
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).where("doc_id is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = list({f for t in pdf["text"] for f in findings(t)})
            yield pd.DataFrame([(_digest(*f[:3]).hex(), *f, held_out(f[1])) for f in found], columns=["h", "left", "body", "right", "secret", "held"])

    rows = docs.select(whole_text().alias("text")).mapInPandas(run, "h string, left string, body string, right string, secret boolean, held boolean")
    return saved(rows.dropDuplicates(["h", "secret"]), "findings")


def dealt(found: DataFrame, parts: int, copies: dict[bool, int]) -> DataFrame:
    """(part, x, h, y): what the network sees of the findings of each part, by their hash; one row is a part. A finding goes to ``copies`` of its kind."""

    def see(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, h = features(list(zip(pdf["left"], pdf["body"], pdf["right"], strict=True)))
            n = pdf["secret"].map(copies).to_numpy(dtype=np.int64)
            row = np.repeat(np.arange(len(pdf)), n)
            for i in range(0, len(row), BATCH_ROWS):
                at = row[i : i + BATCH_ROWS]
                turn = i + np.arange(len(at)) - (np.cumsum(n) - n)[at]
                first = np.array([int(v[:15], 16) % parts for v in pdf["h"].iloc[at]], dtype=np.int64)
                yield pd.DataFrame({"part": (first + turn) % parts, "name": pdf["h"].to_numpy()[at], "x": [v.tobytes() for v in x[at]], "h": [v.tobytes() for v in h[at]], "y": pdf["secret"].to_numpy()[at]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["name", "y"])
        return pd.DataFrame([(pdf["part"].iloc[0], b"".join(pdf["x"]), b"".join(pdf["h"]), pdf["y"].to_numpy(dtype=bool).tobytes())], columns=["part", "x", "h", "y"])

    rows = found.select("h", "left", "body", "right", "secret").mapInPandas(see, "part long, name string, x binary, h binary, y boolean")
    return saved(rows.repartition(parts, "part").groupBy("part").applyInPandas(pack, "part long, x binary, h binary, y binary"), "parts")


def mixed(parts: DataFrame, net: Network, turn: int) -> Network:
    """One round: the mean of the networks that the parts make of this one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(packed(net).size, dtype=np.int64)
        for pdf in batches:
            for part, x, h, y in pdf[["part", "x", "h", "y"]].itertuples(index=False):
                seen = np.frombuffer(x, dtype=np.int8).reshape(-1, WIDTH), np.frombuffer(h).reshape(-1, 2), np.frombuffer(y, dtype=bool)
                total += np.rint(packed(improved(net, *seen, (turn, part))) / UNIT).astype(np.int64)
                n += 1
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tobytes()]})

    made_of = parts.mapInPandas(run, "n long, total binary").collect()
    if not made_of:  # nothing to train on: the generated findings alone
        return improved(net, *features([]), np.zeros(0, dtype=bool), (turn, 0))
    total = np.sum([np.frombuffer(r.total, dtype=np.int64) for r in made_of], axis=0)
    return unpacked(total / sum(r.n for r in made_of) * UNIT)


def calibrated(logits: DataFrame, net: Network, recall: float) -> Network:
    """Scale, cut, recall and precision from all rows of (secret, logit); the cut is that of ``threshold``."""
    value, y = F.col("logit"), F.col("secret").cast("double")

    def sums(a: float, b: float) -> tuple:
        p = 1 / (1 + F.exp(-F.greatest(F.least(a * value + b, F.lit(40.0)), F.lit(-40.0))))
        w = p * (1 - p)
        return tuple(logits.agg(*(F.sum(c) for c in ((p - y) * value, p - y, w * value * value, w * value, w))).first())

    net.scale = platt(sums)
    mine = logits.where("secret")
    n = mine.count()
    k = math.floor(n * (1 - recall))
    top = percentile_frame(mine, ["secret"], "logit", [100 * (k + 0.5) / max(1, n - 1)]).first().value if k < n - 1 else mine.agg(F.max("logit")).first()[0]
    below = logits.where(~F.col("secret") & (value < top)).agg(F.max("logit")).first()[0]
    at = (top + below) / 2 if below is not None else top - 1
    kept, right = logits.where(value >= at).agg(F.count("*"), F.count_if("secret")).first()
    return cut_at(net, at, right / n, right / kept)


def train(docs: DataFrame, sample_docs: int | None = None, recall: float = RECALL, most: int | None = None) -> Network:
    """Fits on all findings of all documents; where a caller asks for less, on those of about ``sample_docs`` documents or the ``most`` of each kind with the smallest hashes."""
    found = every = sampled(docs, sample_docs)
    if most is not None:
        found = found.where("secret").orderBy("h").limit(most).union(found.where("not secret").orderBy("h").limit(most))
    n = {r.secret: r["count"] for r in found.where("not held").groupBy("secret").count().collect()}
    parts = max(1, round(max(n.values(), default=0) / PART))
    copies = {kind: min(parts, -(-LEAST * parts // max(1, n.get(kind, 0)))) for kind in (True, False)}
    deal = dealt(found.where("not held"), parts, copies)
    net = fresh()
    for k in range(ROUNDS):
        net = mixed(deal, net, k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"secret": pdf["secret"], "logit": logits_of(net, list(zip(pdf["left"], pdf["body"], pdf["right"], strict=True)))})

    schema = "secret boolean, logit double"
    beside = [r for r in generated(MADE) if held_out(r[1])]
    beside = [(r[3], float(v)) for r, v in zip(beside, logits_of(net, [r[:3] for r in beside]), strict=True)]
    held = found.where("held").select("left", "body", "right", "secret").mapInPandas(run, schema)
    logits = saved(held.union(docs.sparkSession.createDataFrame(beside, schema)), "logits")
    net = calibrated(logits, net, recall)
    for df in (every, deal, logits):
        drop_saved(df)
    return net


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, kinds, starts, ends, scores): all spans of each document by start, then kind; base ones score 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = spans_of(list(pdf["text"]), net)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "kinds": [[KINDS[k] for _, k, _, _ in f] for f in found], "starts": [[a for a, *_ in f] for f in found],
                "ends": [[b for _, _, b, _ in f] for f in found], "scores": [[p for *_, p in f] for f in found],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, SPANS)


def spans_of(texts: list[str], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """Sorted (start, kind, end, score) of each text."""
    out, asked, owner = [], [], []
    for i, t in enumerate(texts):
        base = base_spans(t)
        out.append([(a, k, b, 1.0) for a, k, b in base])
        found = candidates(t, base)
        asked += [(t, a, b) for a, b in found]
        owner += [i] * len(found)
    if asked:
        p = net.probability(asked)
        for j in np.flatnonzero(p >= net.cut):
            out[owner[j]].append((asked[j][1], 3, asked[j][2], float(p[j])))
    return [sorted(f) for f in out]


def masked(docs: DataFrame, net: Network, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced; all other columns stay."""

    @F.pandas_udf("string")
    def hide(text: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans_of(list(text), net), strict=True):
            parts, at = [], 0
            for a, _, b, _ in found:
                if a >= at:
                    parts += [t[at:a], mask]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    return docs.withColumn("text", F.when(F.col("text").isNotNull(), hide(whole_text())))


def op5_of(docs: DataFrame, net: Network) -> DataFrame:
    s = scan(docs, net)
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    joined = F.array_join(F.expr("transform(filter(arrays_zip(kinds, starts, ends), x -> x.kinds != 'model'), x -> concat_ws(':', x.kinds, x.starts, x.ends))"), ",")
    every = F.array_join(F.expr("transform(arrays_zip(kinds, starts, ends), x -> concat_ws(':', x.kinds, x.starts, x.ends))"), ",")
    return s.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined, 256).alias("base_sha256"), every.alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op5_of(docs, train(docs))
