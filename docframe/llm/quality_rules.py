"""Base text rules, and the log-likelihood ratio of hashed n-grams between a trusted target and
the raw corpus.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, literal_doubles, materialize, token_hash, words

#: Buckets of single tokens; pairs of tokens have as many, and a token beside itself has one more.
BUCKETS = 8191
TABLE = 2 * BUCKETS + 1
SYMBOLS = "[#*$%&|<>]"
#: Runs of letters and digits, and runs of other characters that are not white space.
TOKEN = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+"
SMOOTHING = 1.0
#: A document whose mean ratio per n-gram is below this is not kept.
THRESHOLD = -0.15


def _repeat_words(found: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the array."""

    def covered(hits: Column) -> Column:
        last = F.size(hits) - 1
        return F.aggregate(F.sequence(F.lit(0), last), F.lit(0).cast("long"), lambda acc, j: acc + F.when(j == last, F.lit(3)).otherwise(F.least(F.lit(3), F.get(hits, j + 1) - F.get(hits, j))).cast("long"))

    def positions(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = lambda j, k: F.get(pairs, j)["h"] == F.get(pairs, k)["h"]
        twice = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j, j - 1)) | ((j < last) & same(j, j + 1)))
        return F.sort_array(F.transform(twice, lambda j: F.get(pairs, j)["p"]))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))
    return F.when(F.size(found) < 4, F.lit(0).cast("long")).otherwise(let(windows, count))


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; 0 each for null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    found = words(text)
    stats = let(found, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    return {
        "stats": stats,
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def token_buckets(text: Column) -> Column:
    """The bucket of every token of a text, in order, as array<smallint>."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: (token_hash(t) % BUCKETS).cast("smallint"))


def _pair(a: Column, b: Column) -> Column:
    """The place in the table of two neighbouring tokens."""
    a, b = a.cast("long"), b.cast("long")
    return F.when(a == b, F.lit(2 * BUCKETS)).otherwise(BUCKETS + (a * 7919 + b * 104729) % BUCKETS)


def ratios(counts: list[tuple[int, int, int]]) -> list[float]:
    """(place, count in the target, count in the raw corpus) -> the log ratio of every place."""
    target, raw = [0] * TABLE, [0] * TABLE
    for place, t, r in counts:
        target[place], raw[place] = t, r
    nt, nr = sum(target) + SMOOTHING * TABLE, sum(raw) + SMOOTHING * TABLE
    return [math.log((t + SMOOTHING) / nt) - math.log((r + SMOOTHING) / nr) for t, r in zip(target, raw)]


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rules and verdict for every row of ``docs`` (doc_id, text).

    ``trusted`` (doc_id, ...) names the documents of the target.  All rows count in the raw
    multinomial and all trusted rows in the target's.  The driver receives one count pair per
    place of the table, whose size is fixed.  Null and empty texts have no words and fail the
    base rules.  With no trusted rows every ratio is that of equal multinomials shrunk to the
    prior.  Repeated rows count as often as they occur; null ids are never trusted.
    """
    base = base_columns(F.col("text"))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", *[c.alias(k) for k, c in base.items()], token_buckets(F.col("text")).alias("buckets")
    )
    first = materialize(first.select("doc_id", "stats.*", "n_symbols", "n_dup_lines", "buckets"), "rules")

    # labels grow with the corpus: never a broadcast
    marked = first.select("doc_id", "buckets").join(trusted.select(F.col("doc_id").cast("long")).distinct().withColumn("hit", F.lit(1)).hint("merge"), "doc_id", "left")
    tokens = F.col("buckets")
    singles = tokens.cast("array<int>")
    pairs = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda b, i: _pair(F.get(tokens, i), b).cast("int"))
    places = marked.select(F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(F.concat(singles, pairs)).alias("place"))
    counts = places.groupBy("place").agg(F.sum("hit").alias("t"), F.count("*").alias("r"))
    table = literal_doubles(ratios([tuple(x) for x in counts.collect()]))

    def total(b: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            pair = F.when(i > 0, F.get(table, _pair(F.get(b, i - 1), F.get(b, i)).cast("int"))).otherwise(F.lit(0.0))
            return acc + F.get(table, F.get(b, i).cast("int")) + pair

        n = F.size(b)
        return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), step) / (2 * n - 1))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return first.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), total(tokens).alias("ratio")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("ratio") >= threshold)
    )
