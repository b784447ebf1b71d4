"""Exact substring deduplication with distributed difference-cover suffix arrays.

Of every string of ``LENGTH`` bytes (a *window*) the first occurrence stays, in order of
doc_id and place; bytes that any later occurrence covers go. Sorting every suffix of
the corpus would shuffle it many times over, so what is sorted is reduced first,
without losing a repeat:

1. Anchors. Each window has an anchor: the place of the least hash among its
   ``GRAM``-byte grams. Equal windows have equal grams at equal places, so they
   meet wherever their anchor's gram does. The windows of one anchor make a *span*.
2. Spans are brought together by gram, packed, by hash range. Equal spans of
   one text block are reduced before the shuffle. Of equal spans all but the first are
   removed whole; grams that have one span only need nothing more.
3. What is left, the first of each of several different spans around one gram, is
   *contested*: some of their windows may agree. Contested spans are dealt out by gram, and
   each hash range sorts the suffixes of its text with the difference cover
   modulo 3: sampled triples are sorted and named, the sequence of names is sorted
   recursively until all names differ, the remaining suffixes are sorted by
   their first symbol and the rank that follows, and merged. Windows with equal
   prefixes are then neighbours, and neighbours are compared byte by byte.
4. Hot grams, found beforehand on one document in ``ONE_IN`` (a list of at most ``MOST_HOT``, which only lays out the
   work and changes no result), never meet as one: their spans are brought together by the hash of gram and span,
   and what is left of them, as of any gram with more than ``HOT`` contested spans, is dealt out window by
   window by the window's own hash. Equal windows of one block are compared and reduced before that shuffle,
   so that neither a common gram nor a common window makes a group of all rows that hold it.

Rows go by a number made of their file and their place in it, which is the same in every pass however the files are
split among tasks, so executors may come and go between the passes.

Edge cases: null and empty texts have no windows; texts shorter than LENGTH stay; rows
that repeat a doc_id are ordered by file and place in it, a null doc_id comes last;
overlapping repeats inside a document count; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.llm import bytewords as B
from keylog.llm.common import drop_saved, saved, table, whole_text

LENGTH = 100
GRAM = 40
HOT = 20_000
ONE_IN = 16  #: documents of which one is looked at for hot grams
MOST_HOT = 100_000  #: bound of the list of hot grams (0.8 MB)
FLUSH = 16 << 20  #: bytes of text whose spans are reduced together before the shuffle
CHUNK = 1 << 20  #: windows hashed at a time
_BASE = 0x9DDFEA08EB382D69
_INVERSE = pow(_BASE, -1, 1 << 64)
_END = np.iinfo(np.int64).max  #: stands for a null doc_id


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.cumprod(np.full(n - 1, base, dtype=np.uint64), out=out[1:])
    return out


class Hashes:
    """Hashes of any substrings of a byte array, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        room = max(1024, 1 << n.bit_length())
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, room)[:n], out=self.sums[1:])
        self.inverse = _powers(_INVERSE, room)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return B.mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> dict[str, np.ndarray]:
    """Per anchor: doc (index), lo and hi (first and last window start), g and s (hashes of gram and span); places in ``data``.

    Windows are taken ``chunk`` at a time. A span that a border cuts in two is two spans: they may be
    contested where one would not be, with the same result.
    """
    found = [_anchors(data[a : a + chunk + length - 1], a, offsets, length, gram) for a in range(0, max(1, len(data) - length + 1), chunk)]
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _anchors(data: np.ndarray, base: int, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    w = length - gram + 1
    n = len(data)
    none = {k: np.zeros(0, dtype=np.uint64 if k in "gs" else np.int64) for k in ("doc", "lo", "hi", "g", "s")}
    if n < length:
        return none
    hashes = Hashes(data)
    at = np.arange(n - gram + 1)
    g = hashes.of(at, at + gram)
    low = np.uint64((1 << 31) - 1)
    least = (g & ~low) | at.astype(np.uint64)  # the least hash; of equals the leftmost
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    anchor = (least & low).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(base, base + len(anchor)), "right") - 1
    starts = np.flatnonzero(np.arange(base, base + len(anchor)) + length <= offsets[doc + 1])  # windows inside one text
    if not len(starts):
        return none
    a, d = anchor[starts], doc[starts]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
    lo, hi, a, d = starts[first], starts[np.append(first[1:], len(starts)) - 1], a[first], d[first]
    shape = (a - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)
    return {"doc": d, "lo": lo + base, "hi": hi + base, "g": g[a], "s": B.mix(hashes.of(lo, hi + length) ^ B.mix(shape))}


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Places of ``s`` (whole numbers above 0) in the order of their suffixes.

    The difference cover {1, 2} modulo 3: sort sampled triples, recurse on their names
    unless they all differ, sort the other suffixes by symbol and following rank, merge.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), dtype=np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, dtype=np.int64)])
    m = n + (n % 3 == 1)  # one empty triple closes the first half
    one, two = np.arange(1, m, 3), np.arange(2, m, 3)
    one = np.append(one, n) if n % 3 == 0 else one
    sample = np.concatenate([one, two])
    triples = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
    p = sample[triples]
    new = np.concatenate([[True], (t[p[1:]] != t[p[:-1]]) | (t[p[1:] + 1] != t[p[:-1] + 1]) | (t[p[1:] + 2] != t[p[:-1] + 2])])
    names = np.empty(len(sample), dtype=np.int64)
    names[triples] = np.cumsum(new)
    differ = bool(new.all())
    del p, new
    ordered = sample[triples] if differ else sample[suffix_order(names)]
    del names, triples, sample
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[ordered] = np.arange(1, len(ordered) + 1)
    ordered = ordered[ordered < n]
    rank[n:] = 0
    zero = np.arange(0, n, 3)
    zero = zero[np.lexsort((rank[zero + 1], t[zero]))]
    a, b = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    key = lambda i: t[i] << 32 | rank[i + 1]
    before = np.searchsorted(key(a), key(zero))
    pairs = np.unique(np.concatenate([t[zero] << 32 | t[zero + 1], t[b] << 32 | t[b + 1]]), return_inverse=True)[1]
    before = before + np.searchsorted(pairs[len(zero) :] << 32 | rank[b + 2], pairs[: len(zero)] << 32 | rank[zero + 2])
    out = np.full(n, -1, dtype=np.int64)
    out[before + np.arange(len(zero))] = zero
    out[out < 0] = ordered
    return out


def repeated(text: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A group number for each of ``windows`` (places in ``text``), equal for equal windows of ``length`` bytes."""
    own = np.full(len(text), -1, dtype=np.int64)
    own[windows] = np.arange(len(windows))
    order = own[suffix_order(text.astype(np.int64) + 1)]
    order = order[order >= 0]
    at = windows[order]
    same = np.zeros(len(at), dtype=bool)
    span = np.arange(length)
    for i in range(1, len(at), 20_000):
        j = np.arange(i, min(i + 20_000, len(at)))
        same[j] = (text[at[j, None] + span] == text[at[j - 1, None] + span]).all(1)
    out = np.empty(len(windows), dtype=np.int64)
    out[order] = np.cumsum(~same)
    return out


def later(group: np.ndarray, doc: np.ndarray, rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which members are not the first of their group by (doc, rid, start)."""
    order = np.lexsort((start, rid, doc, group))
    g = group[order]
    out = np.empty(len(g), dtype=bool)
    out[order] = np.concatenate([[False], g[1:] == g[:-1]]) if len(g) else False
    return out


def joined(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each rid with touching and overlapping ones joined."""
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    if not len(rid):
        return rid, start, end
    shift = np.cumsum(np.concatenate([[0], (rid[1:] != rid[:-1]).astype(np.int64)])) << 33  # one running maximum for all rids
    reach = np.maximum.accumulate(end + shift)
    first = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return rid[at], start[at], (reach - shift)[np.append(at[1:], len(rid)) - 1]


def _placed(docs: DataFrame) -> DataFrame:
    """The documents as rows of Parquet files: a plain scan of such files as it is, all else written first."""
    rows = docs.select("doc_id", "text")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" +-:") for line in plan.splitlines() if line.strip()]
    plain = "_metadata" not in docs.columns and all(x.startswith(("Project", "Filter")) or x.startswith("Relation") and x.endswith("parquet") for x in lines)
    return rows if plain else saved(rows, "texts")


def _file_hash(paths: list[str]) -> tuple[int, int]:
    """(seed, bits) with which the files' hashes all differ."""
    names = {re.sub(r"^(\w+):/+", r"\1:/", p) for p in paths}
    bits = 2 * max(len(names) - 1, 0).bit_length() + 1
    seed = 0
    while len({xxhash.xxh64_intdigest(f"{seed}{p}", seed=42) >> (64 - bits) for p in names}) < len(names):
        seed += 1
    return seed, bits


def _numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc, text): rows of ``_placed`` documents numbered by file and place in it, the same in every pass."""
    seed, bits = _file_hash(docs.inputFiles())
    name = F.regexp_replace("_metadata.file_path", r"^(\w+):/+", "$1:/")
    high = F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(str(seed)), name)), 64 - bits)
    place = F.col("_metadata.row_index")
    place = F.when(place < (1 << (63 - bits)), place).otherwise(F.raise_error(F.lit("too many rows in one file")).cast("long"))
    rid = F.shiftleft(high, 63 - bits).bitwiseOR(place)
    return docs.select(rid.alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_END)).alias("doc"), whole_text().alias("text"))


_BLOB = pa.schema([("part", pa.int32()), *((k, pa.binary()) for k in ("g", "s", "doc", "rid", "lo", "hi", "local"))])


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in blocks of about ``limit`` bytes of text, one text at least: (rows, bytes, offsets)."""
    held, size = [], 0
    for batch in batches:
        i = 0
        lengths = np.diff(B.text_bytes(batch.column("text"))[1])
        while i < len(lengths):
            room = np.searchsorted(np.cumsum(lengths[i:]), limit - size, "right")
            j = i + max(int(room), 0 if held else 1)
            if j > i:
                held.append(batch.slice(i, j - i))
                size += int(lengths[i:j].sum())
            if j < len(lengths):
                t = pa.Table.from_batches(held)
                yield t, *B.text_bytes(t["text"])
                held, size = [], 0
            i = j
    if held:
        t = pa.Table.from_batches(held)
        yield t, *B.text_bytes(t["text"])


def _spans_of_block(t: pa.Table, data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The block's spans with rows' numbers and places inside their texts, and which are repeats inside the block."""
    x = anchors(data, offsets)
    base = offsets[x["doc"]]
    rid, doc = np.asarray(t["rid"])[x["doc"]], np.asarray(t["doc"])[x["doc"]]
    x = {"g": x["g"], "s": x["s"], "doc": doc, "rid": rid, "lo": x["lo"] - base, "hi": x["hi"] - base}
    group = np.zeros(len(rid), dtype=np.int64)
    order = np.lexsort((x["s"], x["g"]))
    g, s = x["g"][order], x["s"][order]
    group[order] = np.cumsum(np.concatenate([[0], ((g[1:] != g[:-1]) | (s[1:] != s[:-1])).astype(np.int64)])) if len(g) else 0
    return x, later(group, doc, rid, x["lo"])


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _parts(docs: DataFrame) -> int:
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // (8 << 20), 1 << 20), 4)


def hot_grams(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the grams with about ``HOT`` spans or more, at most ``MOST_HOT`` of them, those with most spans.

    Counted on one document in ONE_IN; decides where spans meet, never what is found.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, FLUSH):
            x, again = _spans_of_block(*block)
            g, k = np.unique(x["g"][~again].view(np.int64), return_counts=True)
            B.trim()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(k, pa.int64())], names=["g", "k"])

    some = _numbered(docs).where(F.pmod(F.xxhash64("rid"), F.lit(ONE_IN)) == 0)
    counts = some.mapInArrow(gather, "g long, k long").groupBy("g").agg(F.sum("k").alias("k")).where(F.col("k") * ONE_IN > HOT)
    counts = saved(counts, "hot", free=True)
    levels = [HOT << j for j in range(40)]
    over = counts.agg(*(F.count(F.when(F.col("k") * ONE_IN > x, 1)) for x in levels)).collect()[0]
    least = next(x for x, n in zip(levels, over, strict=True) if n <= MOST_HOT)
    rows = counts.where(F.col("k") * ONE_IN > least).select("g").collect()  # at most MOST_HOT
    drop_saved(counts)
    return np.sort(np.array([r.g for r in rows], dtype=np.int64)).view(np.uint64)


def _among(g: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return np.isin(g.view(np.int64), hot.view(np.int64)) if len(hot) else np.zeros(len(g), dtype=bool)


def met_spans(docs: DataFrame, parts: int) -> DataFrame:
    """(kind, rid, start, end, g): kind 0, spans that repeat an earlier one; 1, contested ones (start .. end are window starts); 2, hot contested ones.

    Spans that repeat inside their block of text are settled there; they travel along, joined, with one of the block's ranges.
    """
    hot = docs.sparkSession.sparkContext.broadcast(hot_grams(docs))  # bounded by MOST_HOT

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, FLUSH):
            x, again = _spans_of_block(*block)
            local = b"".join(v.astype("<i8").tobytes() for v in joined(x["rid"][again], x["lo"][again], x["hi"][again] + LENGTH))
            x = {k: v[~again] for k, v in x.items()}
            part = _part_of(B.mix(np.where(_among(x["g"], hot.value), x["g"] ^ B.mix(x["s"]), x["g"])), parts)
            order = np.argsort(part, kind="stable")
            part, x = part[order], {k: v[order] for k, v in x.items()}
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, dtype=np.int64)
            kinds = {"g": "<u8", "s": "<u8", "doc": "<i8", "rid": "<i8", "lo": "<u4", "hi": "<u4"}
            cols = [pa.array([v[a:b].astype(kinds[k]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for k, v in x.items()]
            first = (int(x["g"][0]) % max(len(cuts) - 1, 1)) if len(part) else 0
            B.trim()
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), *cols, pa.array([local if i == first else b"" for i in range(len(cuts) - 1)], pa.binary())], schema=_BLOB)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        get = lambda k, kind: np.frombuffer(b"".join(pdf[k]), dtype=kind)
        g, s, doc, rid = get("g", "<u8"), get("s", "<u8"), get("doc", "<i8"), get("rid", "<i8")
        lo, hi = get("lo", "<u4").astype(np.int64), get("hi", "<u4").astype(np.int64)
        order = np.lexsort((lo, rid, doc, s, g))
        g, s, rid, lo, hi = (v[order] for v in (g, s, rid, lo, hi))
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        first = new_g | np.concatenate([[True], s[1:] != s[:-1]])
        gram = np.cumsum(new_g) - 1
        spans = np.bincount(gram, first)[gram]
        B.trim()
        own = [np.frombuffer(b, dtype="<i8").reshape(3, -1) for b in pdf["local"]]
        rest = joined(*(np.concatenate([x, *(o[k] for o in own)]) for k, x in enumerate((rid[~first], lo[~first], hi[~first] + LENGTH))))
        often = _among(g, hot.value)  # other spans of the gram are elsewhere
        c = first & ((spans > 1) | often)
        kind = np.concatenate([np.zeros(len(rest[0])), np.where(often[c] | (spans[c] > HOT), 2, 1)]).astype(np.int8)
        return pd.DataFrame({"kind": kind, "rid": np.concatenate([rest[0], rid[c]]), "start": np.concatenate([rest[1], lo[c]]), "end": np.concatenate([rest[2], hi[c]]), "g": np.concatenate([np.zeros(len(rest[0]), dtype=np.int64), g[c].astype(np.int64)])})

    packed = _numbered(docs).mapInArrow(gather, "part int, g binary, s binary, doc binary, rid binary, lo binary, hi binary, local binary")
    return saved(packed.groupBy("part").applyInPandas(meet, "kind byte, rid long, start long, end long, g long"), "met", free=True)


#: windows: how many start in the text; below 0, a repeat of so many bytes that is settled
_DEALT = pa.schema([("part", pa.int32()), ("hot", pa.bool_()), ("doc", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("text", pa.binary())])


def _windows(size: np.ndarray, doc: np.ndarray, rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, doc, rid, start) of every window of pieces of text, of ``size`` bytes each, that follow each other."""
    base, k = np.cumsum(size) - size, size - LENGTH + 1
    step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return np.repeat(base, k) + step, np.repeat(doc, k), np.repeat(rid, k), np.repeat(start, k) + step


def _hot_windows(held: list[tuple], parts: int) -> Iterator[pa.RecordBatch]:
    """The windows of contested spans (doc, rid, start, bytes), each by its own hash; what repeats another one held here is settled."""
    text = np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint8)
    fixed = (np.array([h[i] for h in held], dtype=np.int64) for i in range(3))
    at, doc, rid, start = _windows(np.array([len(h[3]) for h in held], dtype=np.int64), *fixed)
    own = Hashes(text).of(at, at + LENGTH)
    order = np.lexsort((start, rid, doc, own))
    at, doc, rid, start, own = (x[order] for x in (at, doc, rid, start, own))
    span = np.arange(LENGTH)
    again = np.concatenate([[False], own[1:] == own[:-1]])
    for some in np.array_split(np.flatnonzero(again), len(at) // 20_000 + 1):
        again[some] = (text[at[some, None] + span] == text[at[some - 1, None] + span]).all(1)
    r, s, e = joined(rid[again], start[again], start[again] + LENGTH)
    at, doc, rid, start, own = (x[~again] for x in (at, doc, rid, start, own))

    def batch(h: np.ndarray, doc: np.ndarray, rid: np.ndarray, start: np.ndarray, windows: np.ndarray, data: bytes, each: int) -> pa.RecordBatch:
        offsets = np.arange(len(h) + 1, dtype=np.int32) * each
        texts = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        cols = [pa.array(_part_of(B.mix(h), parts), pa.int32()), pa.array(np.ones(len(h), dtype=bool)), *(pa.array(x, pa.int64()) for x in (doc, rid, start)), pa.array(windows, pa.int32()), texts]
        return pa.RecordBatch.from_arrays(cols, schema=_DEALT)

    yield batch(r.view(np.uint64), np.zeros(len(r), dtype=np.int64), r, s, s - e, b"", 0)
    for i in range(0, len(at), 20_000):
        j = slice(i, i + 20_000)
        yield batch(own[j], doc[j], rid[j], start[j], np.ones(len(at[j]), dtype=np.int64), text[at[j, None] + span].tobytes(), LENGTH)


def contested_repeats(docs: DataFrame, met: DataFrame, parts: int) -> DataFrame:
    """(rid, start, end) of the windows of contested spans that occur earlier in another one."""
    asked = met.where("kind > 0").groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end", "g")).alias("asked"))
    rows = _numbered(docs).join(asked, "rid")
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            out: list[list] = [[] for _ in _DEALT]
            for rid, doc, text, asked in zip(batch["rid"].to_pylist(), batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["asked"].to_pylist(), strict=True):
                raw = text.encode()
                g = np.array([a["g"] for a in asked], dtype=np.int64).view(np.uint64)
                for a, part in zip(asked, _part_of(B.mix(g), parts).tolist(), strict=True):
                    piece = raw[a["start"] : a["end"] + LENGTH]
                    if a["kind"] == 1:
                        for col, value in zip(out, (part, False, doc, rid, a["start"], a["end"] - a["start"] + 1, piece), strict=True):
                            col.append(value)
                    else:
                        held.append((doc, rid, a["start"], piece))
                        size += len(piece)
                        if size >= FLUSH // 4:
                            yield from _hot_windows(held, parts)
                            held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _DEALT, strict=True)], schema=_DEALT)
        if held:
            yield from _hot_windows(held, parts)

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        done = pdf[pdf["windows"] < 0]
        pdf = pdf[pdf["windows"] > 0]
        text = np.frombuffer(b"".join(pdf["text"]), dtype=np.uint8)
        windows, doc, rid, start = _windows(pdf["text"].str.len().to_numpy(dtype=np.int64), pdf["doc"].to_numpy(), pdf["rid"].to_numpy(), pdf["start"].to_numpy())
        again = later(repeated(text, windows), doc, rid, start)
        settled = (done["rid"], done["start"], done["start"] - done["windows"])
        spans = joined(*(np.concatenate([x, y.to_numpy(dtype=np.int64)]) for x, y in zip((rid[again], start[again], start[again] + LENGTH), settled, strict=True)))
        del text, windows, doc, rid, start, again
        B.trim()
        return pd.DataFrame(dict(zip(("rid", "start", "end"), spans, strict=True)))

    dealt = rows.mapInArrow(deal, "part int, hot boolean, doc long, rid long, start long, windows int, text binary")
    return saved(dealt.groupBy("part", "hot").applyInPandas(sort, "rid long, start long, end long"), "contested", free=True)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of every document; kept: the bytes that stay, as binary."""
    docs = _placed(docs)
    parts = _parts(docs)
    met = met_spans(docs, parts)
    extra = contested_repeats(docs, met, 4 * parts)  # spans travel one by one from here, so ranges can be finer
    spans = met.where("kind = 0").select("rid", "start", "end").unionByName(extra)
    by_doc = saved(spans.groupBy("rid").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans", free=True)
    drop_saved(met)
    rows = _numbered(docs).join(by_doc, "rid", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch["text"])
            out = []
            for i, (doc, starts, ends) in enumerate(zip(batch["doc"].to_pylist(), batch["starts"].to_pylist(), batch["ends"].to_pylist(), strict=True)):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                found = []
                if starts:
                    _, s, e = joined(np.zeros(len(starts), dtype=np.int64), np.array(starts), np.array(ends))
                    found = list(zip(s.tolist(), e.tolist(), strict=True))
                edges = [0, *(x for f in found for x in f), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if found else raw
                out.append((None if doc == _END else doc, len(raw), len(raw) - len(kept), len(found), [x for f in found for x in f], kept))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], f.type) for j, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS i, h FROM d),
w AS (SELECT doc_id, i, CASE WHEN 2 * i + {2 * LENGTH} <= len(h) THEN substr(h, 2 * i + 1, {2 * LENGTH}) END AS k, substr(h, 2 * i + 1, 2) AS x FROM b),
r AS (SELECT doc_id, i, x, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM w),
c AS (SELECT doc_id, i, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same result by a dictionary of all windows, for tests."""
    texts = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen: set[bytes] = set()
    out: list[tuple] = [()] * len(rows)
    for i in order:
        t, gone = texts[i], np.zeros(len(texts[i]), dtype=bool)
        for a in range(len(t) - LENGTH + 1):
            w = t[a : a + LENGTH]
            if w in seen:
                gone[a : a + LENGTH] = True
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (rows[i][0], len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest())
    return out
