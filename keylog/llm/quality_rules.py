"""Quality rules with risk-controlled cutoffs [native].

Base signals are counted per document with built-in functions. On top of them,
each rule ``score > cutoff`` gets its cutoff per stratum (language) from
labelled holdouts: a cutoff counts as safe only if an exact binomial test shows
at ``delta`` that it rejects at most ``alpha`` of the good documents there. Cutoffs
of one rule are tested from the loosest down and testing ends at the first
failure (fixed-sequence testing), and ``delta`` is divided by the number of strata
and rules (Bonferroni), so all guarantees of all strata hold together with
probability ``1 - delta``; ``alpha`` is divided by the number of rules, so it bounds
what the rules reject jointly. Among safe cutoffs the one that best separates bad from good
is taken. A stratum with too few labels gets no rule: it rejects nothing.

Plan: one pass over the texts writes a narrow table of signals to the shared
folder; the labelled histogram is an aggregate on the executors, of which only the
strata with enough labels for any rule reach the driver; the verdict is a projection. No Python runs on executors.

Edge cases: null text counts as empty (no words, fails the base rule); a null
language is a stratum of its own; labels that are null are ignored, of repeated
labels the lowest counts; repeated documents each get a row; other columns are
never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.llm.common import saved, table, whole_text

RULES = ("symbols", "dup_lines", "repeats", "word_length", "shouting", "capitals")
GRID = 100  #: cutoffs 0, 10, .. 990 per mille
ALPHA = 0.03  #: most good documents that the rules of a stratum may reject jointly
DELTA = 0.05  #: chance that any guarantee fails
COST = 5  #: a good document rejected weighs as much as so many bad ones kept

_WHITE = "' \\t\\n\\u000b\\f\\r'"


def signals(docs: DataFrame) -> DataFrame:
    """One row per document with the base columns and the rules' scores (per mille)."""
    d = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), whole_text().alias("text"))
    d = d.withColumn("_t", F.expr(f"btrim(text, {_WHITE})"))
    d = d.withColumn("words", F.when(F.col("_t") == "", F.expr("array()").cast("array<string>")).otherwise(F.split("_t", "[ \\t-\\r]+")))
    d = d.withColumn("lines", F.expr(f"filter(split(text, '\\n'), l -> btrim(l, {_WHITE}) != '')"))
    d = d.select(
        "doc_id", "stratum", "words",
        F.size("words").cast("long").alias("n_words"),
        F.expr("cast(length(array_join(words, '')) as long)").alias("word_chars"),
        F.expr("cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '')) as long)").alias("n_symbols"),
        F.expr("cast(size(lines) as long)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("cast(length(text) - length(replace(text, '!', '')) as long)").alias("n_shouts"),
        F.expr("cast(length(text) - length(regexp_replace(text, '[A-Z]', '')) as long)").alias("n_capitals"),
        F.expr("if(size(words) < 8, cast(array() as array<bigint>), transform(sequence(1, size(words) - 7), i -> xxhash64(slice(words, i, 8))))").alias("_w"),
    )
    # Windows found twice: sort (hash, place) and compare neighbours; only documents that have any pay for it.
    d = d.withColumn("_s", F.expr("if(size(array_distinct(_w)) = size(_w), null, sort_array(transform(_w, (h, i) -> struct(h, i))))"))
    d = d.withColumn("_f", F.expr("sort_array(transform(filter(_s, (x, j) -> (j > 0 and element_at(_s, if(j > 0, j, 1)).h = x.h) or (j + 1 < size(_s) and element_at(_s, if(j + 1 < size(_s), j + 2, 1)).h = x.h)), x -> x.i))"))
    covered = "aggregate(_f, struct(0 as e, 0 as t), (a, i) -> struct(i + 8 as e, a.t + i + 8 - greatest(i, a.e) as t), a -> a.t)"
    d = d.withColumn("n_repeat_words", F.expr(f"cast(coalesce({covered}, 0) as long)"))
    score = {
        "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
        "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
        "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
        "word_length": "10 * word_chars div greatest(n_words, 1)",
        "shouting": "1000 * n_shouts div greatest(word_chars, 1)",
        "capitals": "1000 * n_capitals div greatest(word_chars, 1)",
    }
    return d.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
        F.array(*(F.expr(f"cast(least({score[r]}, 1000) as int)") for r in RULES)).alias("scores"),
    )


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed from the largest term down."""
    if k >= n:
        return 1.0
    total, i = 0.0, k
    while i >= 0:
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        total += term
        if i < n * p and term < total * 1e-17:
            break
        i -= 1
    return min(total, 1.0)


def cutoffs(sig: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, list[int | None]]:
    """Per stratum the cutoff of each rule in per mille, or None for no rule; strata with too few good labels for any are left out."""
    lab = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    x = sig.where(~F.col("base_failed")).select("doc_id", "stratum", "scores").join(lab, "doc_id")
    # bin b: the cutoffs 0, 10, .. 10 * (b - 1) reject the document
    x = x.select("stratum", (F.col("quality") > 0).alias("good"), F.posexplode(F.expr("transform(scores, s -> cast(ceil(s / 10.0) as int))")).alias("rule", "bin"))
    bins = saved(x.groupBy("stratum", "rule", "good", "bin").agg(F.count("*").alias("n")), "histogram")
    good = saved(bins.where("rule = 0").groupBy("stratum").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good")), "good")
    level = delta / max(1, good.count() * len(RULES))
    least = math.floor(math.log(level) / math.log1p(-alpha / len(RULES)))  # with fewer no cutoff can be safe, whatever it rejects
    hist: dict = {}
    for r in bins.join(good.where(F.col("n_good") >= least).select("stratum"), "stratum").collect():
        h = hist.setdefault((r.stratum, r.rule), [[0] * (GRID + 1), [0] * (GRID + 1)])
        h[r.good][min(r.bin, GRID)] += r.n
    picked: dict = {}
    for (s, rule), (bad, good) in hist.items():
        n_good, n_bad, best, k_good, k_bad = sum(good), sum(bad), None, 0, 0
        for g in range(GRID - 1, -1, -1):  # cutoff 10 * g rejects bins above g
            k_good += good[g + 1]
            k_bad += bad[g + 1]
            if n_good == 0 or binomial_tail(n_good, k_good, alpha / len(RULES)) > level:
                break
            gain = k_bad * n_good - COST * k_good * n_bad
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, 10 * g)
        picked.setdefault(s, [None] * len(RULES))[rule] = best and best[1]
    return picked


def verdicts(sig: DataFrame, cuts: dict[str, list[int | None]]) -> DataFrame:
    """Adds ``kept``: false if the base rule failed or a score exceeds its stratum's cutoff."""
    off = 10**6
    known: Column = F.expr("cast(map() as map<string, array<int>>)")
    if cuts:
        keys = sorted(cuts)
        known = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.array(*(F.lit(off if c is None else c) for c in cuts[k])) for k in keys)))
    limits = F.coalesce(F.try_element_at(known, F.col("stratum")), F.array(*[F.lit(off)] * len(RULES)))
    over = F.exists(F.zip_with("scores", limits, lambda s, c: s > c), lambda x: x)
    return sig.withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Signals and verdict of every document; cutoffs come from the labelled ones."""
    sig = saved(signals(docs), "signals")
    return verdicts(sig, cutoffs(sig, labels, alpha, delta))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W = r"[\x20\x09-\x0D]"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_W}+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS k FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(0, 8)) AS o) GROUP BY rid),
f AS (SELECT w.rid, doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             length(text) - length(replace(text, '!', '')) AS n_shouts, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             [least(1000 * n_symbols // greatest(word_chars, 1), 1000), least(1000 * n_dup_lines // greatest(n_lines, 1), 1000),
              least(1000 * n_repeat_words // greatest(n_words, 1), 1000), least(10 * word_chars // greatest(n_words, 1), 1000),
              least(1000 * n_shouts // greatest(word_chars, 1), 1000), least(1000 * n_capitals // greatest(word_chars, 1), 1000)] AS scores FROM f),
lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
x AS (SELECT stratum, q > 0 AS good, r, scores[r] AS s FROM (SELECT stratum, q, scores, unnest(range(1, 7)) AS r FROM g JOIN lab USING (doc_id) WHERE NOT base_failed)),
n AS (SELECT stratum, r, count(*) FILTER (good) AS ng, count(*) FILTER (NOT good) AS nb FROM x GROUP BY ALL),
c AS (SELECT n.stratum, n.r, ng, nb, t.cut, (SELECT count(*) FROM x WHERE x.stratum = n.stratum AND x.r = n.r AND good AND s > t.cut) AS kg,
             (SELECT count(*) FROM x WHERE x.stratum = n.stratum AND x.r = n.r AND NOT good AND s > t.cut) AS kb
      FROM n, (SELECT unnest(range(0, 1000, 10)) AS cut) t),
lv AS (SELECT {DELTA} / (count(DISTINCT stratum) * 6) AS level FROM n),
p AS (SELECT c.*, ng > 0 AND (CASE WHEN kg >= ng THEN 1.0 ELSE (SELECT sum(exp(lgamma(ng + 1) - lgamma(i + 1) - lgamma(ng - i + 1)
             + i * ln({ALPHA} / 6) + (ng - i) * ln(1 - {ALPHA} / 6))) FROM (SELECT unnest(range(0, kg + 1)) AS i)) END) <= level AS ok FROM c, lv),
s AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, r ORDER BY cut DESC) AS safe, kb * ng - {COST} * kg * nb AS gain FROM p),
cuts AS (SELECT stratum, r, cut FROM s WHERE safe AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, r ORDER BY gain DESC, cut DESC) = 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.stratum = g.stratum AND g.scores[cuts.r] > cuts.cut) AS kept
FROM g
"""
