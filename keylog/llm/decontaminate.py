"""Benchmark decontamination under edit distance, over words.

An item of m words contaminates a document if some part of the document is within
``floor(RATE * m)`` word edits of it. The search:

1. Gate: an item with k edits allowed is cut into k + 1 pieces; one of them is left whole
   in any match. The pieces of all items, with their place and the item's size, set bits of
   a map of bounded size; a window of an item's size is hashed only if a piece stands in it where one of an item of this
   size would. This loses nothing and says nothing about which item it is.
2. CGK: each such window, and each item, is mapped by random walks to strings of 3 m
   symbols in which edits become few Hamming differences: at step j the current
   word is written out and a random bit of (j, word) tells whether to go on to the next.
3. Bit sampling, the index: ``TABLES`` keys of ``BITS`` sampled places each. The keys of the windows
   are joined with the keys of the items by (size, table, key); pairs that meet in any table are candidates. Their
   number is set for RECALL at the largest distance allowed (measured in the tests).
4. Exact check: the least edit distance between the item and any part of the
   window's surroundings.

Items are a table like the documents: its keys and words are joined, never collected; tasks hold the two
maps (16 MB each at most) and the list of item sizes. Regions of documents around gated windows are written once, so
all later steps read the same rows.

Words are runs of characters other than ASCII punctuation and spaces, A-Z in lower
case. Edge cases: null and empty texts and items have no words and no matches; an item of fewer than five words allows no
edit, so an item of one word contaminates every document that holds the word; a
null item_id or doc_id is carried as null; equal items are all reported; repeated
documents are each reported; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.llm import bytewords as B
from keylog.llm.common import saved, table, whole_text

RATE = 0.2
RECALL = 0.95
WALKS, TABLES, BITS = 12, 48, 3  #: random walks; tables over all walks; sampled places a table
MOST_BITS = 27  #: the maps have 2^27 bits at most
MATCHES = "doc_id long, item_id long, n_words int, start_word int, end_word int, distance int"
REGIONS = "region long, row long, doc_id long, h string, first int, words binary, sizes binary, starts binary"


def edits_of(m: int) -> int:
    return int(RATE * m + 1e-9)


def pieces_of(m: int) -> tuple[int, list[int]]:
    """(words of a piece, places of the pieces) of an item of m words."""
    q = m // (edits_of(m) + 1)
    return q, [j * q for j in range(edits_of(m) + 1)]


class Bits:
    """A set of 64-bit hashes as a map of bounded size: never misses a member, may take others for one."""

    def __init__(self, n: int) -> None:
        k = min(MOST_BITS, max(16, (64 * n).bit_length()))
        self.shift, self.data = np.uint64(64 - k), np.zeros(1 << (k - 3), dtype=np.uint8)

    def add(self, h: np.ndarray) -> None:
        for x in self.probes(h):
            at = x >> self.shift
            np.bitwise_or.at(self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(h.size, dtype=bool)
        left, places = h.ravel(), np.arange(h.size)
        for x in self.probes(None):  # few are left after the first
            at = (left * x) >> self.shift
            k = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            left, places = left[k], places[k]
        out[places] = True
        return out.reshape(h.shape)

    @staticmethod
    def probes(h: np.ndarray | None) -> list:
        odd = B.odd(11, 4)
        return list(odd) if h is None else [h * x for x in odd]


def _salt(*x: int) -> np.uint64:
    return B.mix(np.array([sum(v << (20 * i) for i, v in enumerate(x))], dtype=np.uint64))[0]


def gate_hashes(words: np.ndarray) -> np.ndarray:
    """What an item sets in the gate: its pieces alone, and with their place and its size."""
    m = len(words)
    q, places = pieces_of(m)
    g = B.grams(words, q)[places]
    return np.concatenate([B.mix(g ^ _salt(q)), B.mix(g ^ np.array([_salt(m, p, 1) for p in places]))])


class Gate:
    """Which windows of documents are worth hashing."""

    def __init__(self, bits: Bits, sizes: list[int]) -> None:
        self.bits = bits
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # piece length -> (sizes, places, salts)
        combos: dict[int, list[tuple[int, int]]] = {}
        for m in sizes:
            q, places = pieces_of(m)
            combos.setdefault(q, []).extend((m, p) for p in places)
        for q, c in combos.items():
            self.by[q] = np.array([m for m, _ in c]), np.array([p for _, p in c]), np.array([_salt(m, p, 1) for m, p in c])

    def pieces(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """By piece length, the places of the words ``h`` where some item's piece may stand."""
        out = {}
        for q in self.by:
            g = B.grams(h, q)
            out[q] = np.flatnonzero(self.bits.has(B.mix(g ^ _salt(q))))
        return out

    def windows(self, h: np.ndarray, at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """By size, the starts of the windows of the words ``h`` to hash, given the places of pieces."""
        found: dict[int, list[np.ndarray]] = {}
        for q, p in at.items():
            p = p[p + q <= len(h)]
            if not len(p):
                continue
            sizes, places, salts = self.by[q]
            g = B.grams(h, q)[p]
            for i in range(0, len(p), 1024):
                a, b = np.nonzero(self.bits.has(B.mix(g[i : i + 1024, None] ^ salts)))
                for m in np.unique(sizes[b]).tolist():
                    k = sizes[b] == m
                    found.setdefault(m, []).append(p[i + a[k]] - places[b[k]])
        out = {}
        for m, starts in found.items():
            e = edits_of(m)
            s = np.unique(np.unique(np.concatenate(starts))[:, None] + np.arange(-e, e + 1))
            out[m] = np.unique(np.clip(s, 0, len(h) - 1))
        return out


def window_keys(words: np.ndarray, m: int, starts: np.ndarray) -> np.ndarray:
    """The keys, which name size and table too, of the windows of m words at ``starts``; windows may hang over the end. A few thousand at a time."""
    padded = np.concatenate([words, np.zeros(m, dtype=np.uint64)])
    return B.mix(lsh_keys(padded[starts[:, None] + np.arange(m)]) ^ np.array([_salt(m, t, 2) for t in range(TABLES)]))


def lsh_keys(windows: np.ndarray) -> np.ndarray:
    """TABLES keys of each row of words: CGK walks, then sampled places."""
    n, m = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), dtype=np.uint64)], 1)
    out = np.empty((n, TABLES), dtype=np.uint64)
    rows, length, per = np.arange(n), 3 * m, TABLES // WALKS
    for w in range(WALKS):
        seeds = B.mix(np.arange(length, dtype=np.uint64) + np.uint64(w << 32))
        pick = np.random.default_rng([w, m]).integers(0, length, (per, BITS))
        last = int(pick.max())
        walk, at = np.empty((n, last + 1), dtype=np.uint64), np.zeros(n, dtype=np.int64)
        for j in range(last + 1):
            walk[:, j] = symbol = padded[rows, at]
            at = np.minimum(at + (((symbol ^ seeds[j]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64), m)
        for t in range(per):
            out[:, w * per + t] = B.mix(walk[:, pick[t]] @ B.odd(w * per + t + 7, BITS))
    return out


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(distance, end) of the part of ``text`` nearest to ``item``; of equals the earliest end."""
    n = len(text)
    row, steps = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    for i, w in enumerate(item):
        new = np.empty(n + 1, dtype=np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n_words, words, gate, keys) of the items that have words."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("words", pa.binary()), ("gate", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            h, first = B.word_hashes(*B.text_bytes(batch.column(1)), B.PLAIN)
            rows = []
            for item_id, a, b in zip(batch.column(0).to_pylist(), first[:-1], first[1:], strict=True):
                if b > a:
                    words = h[a:b]
                    rows.append((number, item_id, int(b - a), words.astype("<u8").tobytes(), gate_hashes(words).view(np.int64), window_keys(words, int(b - a), np.zeros(1, dtype=np.int64))[0].view(np.int64)))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    return saved(rows.mapInArrow(run, "item long, item_id long, n_words int, words binary, gate array<long>, keys array<long>"), "items")


def bits_of(items: DataFrame, column: str) -> Bits:
    """All hashes of a column of arrays as a map; read block by block."""
    out = Bits(items.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).collect()[0][0])
    for r in items.select(column).toLocalIterator():
        out.add(np.array(r[0], dtype=np.int64).view(np.uint64))
    return out


def regions(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The surroundings of all windows that the gate lets through, joined where they overlap; saved.

    row: a number of the document's row; h: MD5 of its text; first: the region's first word; words: their hashes; sizes and starts: the windows.
    """
    sizes = sorted(r.n_words for r in items.select("n_words").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(Gate(bits_of(items, "gate"), sizes))
    schema = pa.schema([("region", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("h", pa.string()), ("first", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("starts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        gate = shared.value
        row = region = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            h, first = B.word_hashes(*B.text_bytes(batch.column(1)), B.PLAIN)
            at = gate.pieces(h)
            touched = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(np.searchsorted(first, p, "right") - 1 for p in at.values())]))
            out = []
            for i in touched.tolist():
                a, b = int(first[i]), int(first[i + 1])
                own = {q: p[np.searchsorted(p, a) : np.searchsorted(p, b)] - a for q, p in at.items()}
                found = gate.windows(h[a:b], own)
                if not found:
                    continue
                m = np.concatenate([np.full(len(s), k) for k, s in found.items()])
                s = np.concatenate(list(found.values()))
                e = np.array([edits_of(int(x)) for x in m])
                low, high = np.maximum(0, s - e), np.minimum(b - a, s + m + 3 * e)
                order = np.argsort(low, kind="stable")
                m, s, low, high = m[order], s[order], low[order], np.maximum.accumulate(high[order])
                cuts = np.concatenate([[0], np.flatnonzero(low[1:] > high[:-1]) + 1, [len(m)]])
                digest = hashlib.md5(batch.column(1)[i].as_py().encode()).hexdigest()
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    lo, hi = int(low[x]), int(high[y - 1])
                    out.append((region, row + i, ids[i].as_py(), digest, lo, h[a + lo : a + hi].astype("<u8").tobytes(), m[x:y].astype("<i4").tobytes(), (s[x:y] - lo).astype("<i4").tobytes()))
                    region += 1
            row += batch.num_rows
            for x in range(0, max(len(out), 1), 256):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out[x : x + 256]], f.type) for j, f in enumerate(schema)], schema=schema)

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, REGIONS), "regions")


def candidates(found: DataFrame, items: DataFrame) -> DataFrame:
    """(region, item): the items whose keys a window of the region shares in any table."""
    shared = found.sparkSession.sparkContext.broadcast(bits_of(items, "keys"))
    schema = pa.schema([("key", pa.int64()), ("region", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = [batch.column(j).to_pylist() for j in range(4)]
            words = [np.frombuffer(w, dtype="<u8") for w in rows[1]]
            sizes, starts = (np.concatenate([np.zeros(0, dtype="<i4"), *(np.frombuffer(x, dtype="<i4") for x in rows[j])]).astype(np.int64) for j in (2, 3))
            owner = np.repeat(np.arange(len(words)), [len(x) // 4 for x in rows[2]])
            for m in np.unique(sizes).tolist():  # all windows of a size together, as many at a time as memory allows
                mine = np.flatnonzero(sizes == m)
                for i in range(0, len(mine), 2048):
                    w = mine[i : i + 2048]
                    some = np.unique(owner[w])
                    text = np.concatenate([y for x in some for y in (words[x], np.zeros(m, dtype=np.uint64))])
                    base = np.cumsum([0, *(len(words[x]) + m for x in some)])[np.searchsorted(some, owner[w])]
                    keys = window_keys(text, m, base + starts[w])
                    a, b = np.nonzero(known.has(keys))  # a key that no item has joins nothing
                    own, at = keys[a, b].view(np.int64), np.array(rows[0], dtype=np.int64)[owner[w[a]]]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(at)], schema=schema)

    windows = found.select("region", "words", "sizes", "starts").mapInArrow(run, "key long, region long").distinct()
    return windows.join(items.select(F.explode("keys").alias("key"), "item"), "key").select("region", "item").distinct()


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, h, doc_id, item_id, n_words, start_word, end_word, distance): the nearest match of each item in each document's row."""
    items = items_of(benchmark)
    found = regions(docs, items)
    met = saved(candidates(found, items), "candidates")
    both = met.join(found.select("region", "row", "doc_id", "h", "first", "words"), "region").join(items.select("item", "item_id", "n_words", F.col("words").alias("item_words")), "item")
    names = ["row", "h", "doc_id", "item", "item_id", "n_words", "start_word", "end_word", "distance"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                item, text = np.frombuffer(r["item_words"], dtype="<u8"), np.frombuffer(r["words"], dtype="<u8")
                d, end = best_match(item, text)
                if d <= edits_of(len(item)):
                    low = max(0, end - len(item) - d)
                    _, back = best_match(item[::-1], text[low:end][::-1])
                    out.append((r["row"], r["h"], r["doc_id"], r["item"], r["item_id"], r["n_words"], r["first"] + end - back, r["first"] + end, d))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], f.type) for j, f in enumerate(schema)], schema=schema)

    hits = both.mapInArrow(check, "row long, h string, doc_id long, item long, item_id long, n_words int, start_word int, end_word int, distance int")
    best = hits.groupBy("row", "item", "h", "doc_id", "item_id", "n_words").agg(F.min(F.struct("distance", "end_word", "start_word")).alias("best"))
    return saved(best.select("row", "h", "doc_id", "item_id", "n_words", "best.start_word", "best.end_word", "best.distance"), "matches")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, start_word, end_word, distance): the nearest match of each item in each document."""
    return contaminations(docs, benchmark).select(*(x.split()[0] for x in MATCHES.split(", ")))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any match, all columns kept. Which match depends on the text alone, so texts are told apart by their MD5."""
    gone = contaminations(docs, benchmark).select(F.col("h").alias("_gone")).distinct()
    return docs.join(gone, F.md5(whole_text().cast("binary")) == gone["_gone"], "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
