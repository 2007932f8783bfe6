"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The n-grams are the words and the pairs of neighbouring words, hashed into BUCKETS.
Two multinomials with add-one-half smoothing are counted over them: one over trusted documents, one over all documents.
A document's ratio is the mean over its n-grams of log(trusted) - log(all); it is kept from a fixed threshold on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import fresh, thinned

BUCKETS = 1 << 14
#: Trusted documents that the target is counted over, at most: those with the smallest hashes of their id.
TRUSTED_ROWS = 20_000
THRESHOLD = -0.2
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SPACES = " \t\n\x0b\f\r"
GAP, WORD, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP, -1)))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def pair_hashes(h: Column, step: int = 1) -> Column:
    """For each hash that of it and the hash `step` places on; the last `step` are of one hash only."""
    return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))


def repeated_words(pairs: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text has twice or more. pairs: hashes of neighbouring words."""

    def covered(starts: Column) -> Column:
        # starts of such windows in order: each covers WINDOW words but for those that the next one covers
        gap = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

    def repeats(hashes: Column) -> Column:
        def flagged(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            mine = F.transform(s, lambda x, k: F.when(same(x, F.when(k > 0, k - 1)) | same(x, k + 1), x["i"]))
            return let(F.array_sort(F.filter(mine, lambda i: i.isNotNull())), covered)

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, flagged)).otherwise(0)

    def with_next(step: int) -> Callable[[Column], Column]:
        return lambda h: pair_hashes(h, step)

    # hashes of 2, 4 and 8 words, each of two of the former; the last seven are cut off, as they are of fewer words
    hashes = pairs
    for step in (2, 4):
        hashes = let(hashes, with_next(step))
    return F.when(F.size(pairs) > WINDOW, let(F.slice(hashes, 1, F.size(pairs) - (WINDOW - 1)), repeats)).otherwise(0).cast("long")


def rules(w: Column, repeated: Column, text: Column) -> dict[str, Column]:
    """The counts of the rules; w holds the words of text, of which so many are repeated."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated,
    }


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", most: int = TRUSTED_ROWS) -> list[float]:
    """log(trusted) - log(all) of each bucket; BUCKETS numbers, whatever the input's size.

    The target is counted over the documents whose doc_id is among at most `most` ids of trusted; the corpus over all.
    Without any trusted document all ratios are 0.
    """
    ids = thinned(trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null"), "trusted_id", most, 5).distinct().orderBy(F.xxhash64("trusted_id", F.lit(5)), "trusted_id").limit(most)
    rows = docs.select(F.col("doc_id").alias("id"), words(F.col(text)).alias("w")).join(F.broadcast(ids), F.col("id") == F.col("trusted_id"), "left")
    # neighbours are put side by side before they are hashed, which whole-stage code then does
    both = rows.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("x"))
    both = both.select("t", F.xxhash64("x.a").alias("h"), F.when(F.col("x.b").isNotNull(), F.xxhash64(F.xxhash64("x.a"), F.xxhash64("x.b"))).alias("p"))
    grams = both.select("t", F.explode(F.array("h", "p")).alias("g")).where("g is not null").select("t", bucket(F.col("g")).alias("bucket"))
    raw, target = [0.5] * BUCKETS, [0.5] * BUCKETS
    for r in grams.groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("n")).collect():  # BUCKETS rows
        raw[r.bucket] += r.n
        target[r.bucket] += r.t
    all_, good = sum(raw), sum(target)
    if good <= 0.5 * BUCKETS:
        return [0.0] * BUCKETS
    return [math.log(t / good) - math.log(n / all_) for t, n in zip(target, raw, strict=True)]


def judge(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, dict[str, str]]:
    """docs with the counts of the rules, base_failed, ratio and kept.

    Returns the frame and the names of these columns, which differ only where docs has such a name. base_failed: fewer
    than 20 words, or over 30 % of them repeated. kept: not base_failed, and the ratio is at least the threshold. A null
    or empty text has no words and a ratio of 0. Whole texts count; equal texts get equal results.
    """
    names = {k: fresh(docs, k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept")}
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    total = lambda hashes: F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(model, bucket(h)))

    def stats(h: Column, p: Column) -> Column:
        n = F.size(h)
        mean = F.when(n > 0, (total(h) + total(F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))))) / (2 * n - 1)).otherwise(0.0)
        return F.struct(repeated_words(p).alias("repeated"), mean.alias("ratio"))

    # hashes are bound by let(), not columns: the optimizer could put a column's expression into a lambda, for each element
    out = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t"), words(F.col(text)).alias("w"))
    out = out.select("row", "t", "w", let(word_hashes(F.col("w")), lambda h: let(pair_hashes(h), lambda p: stats(h, p))).alias("s"))
    out = out.select("row", *(c.alias(names[k]) for k, c in rules(F.col("w"), F.col("s.repeated"), F.col("t")).items()), F.col("s.ratio").alias(names["ratio"]))
    out = out.withColumn(names["base_failed"], (F.col(names["n_words"]) < LEAST_WORDS) | (100 * F.col(names["n_repeat_words"]) > MOST_REPEATED * F.col(names["n_words"])))
    out = out.withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.col(names["ratio"]) >= threshold))
    return out.select("row.*", *names.values()), names


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs that are kept, as they are.

    Null, empty and short texts go, as judge() says; repeated rows stay or go together; an empty table gives an empty table.
    Without any trusted document only the rules decide.
    """
    out, names = judge(docs, log_ratios(docs, trusted))
    return out.where(names["kept"]).select(*docs.columns)
