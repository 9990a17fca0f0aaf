"""Stupid backoff of any order as plain joins: count tables of n-grams, joined to exploded n-grams, summed by document.

The score of a word is log count(n-gram) - log count(context) for the longest n-gram that the corpus holds more often than
the scored document itself, and log BACKOFF for each word by which that is shorter than it could be. What is seen elsewhere
at one length is seen elsewhere at all shorter ones, so a document's score is a sum over its n-grams, each on its own:

    sum of log(count(word) / words) and of log BACKOFF for each word that could be left off
    + for each n-gram of two words or more that is seen elsewhere: log count - log count(without its last word)
      - log count(without its first word) + log count(without both, or words of the corpus) - log BACKOFF

The bracket is a property of the n-gram: a table of weights, made of the count tables by joins on hashes. Documents'
n-grams meet it in one join on the n-gram, and one sum by document follows. N-grams are 64-bit hashes; all tables are
partitioned by them. Very frequent n-grams are few rows in the weights, and AQE splits their other side.

This is the general form. It moves a row for each n-gram of each document, which is more disk than op2_lm_scores may use
(README); that query packs bigrams instead and gives the same scores.

Defined cases: a null or empty text has no words, log_score 0 and a null mean_log. Repeated rows are scored each. Equal
hashes of different n-grams would share their counts. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .ngrams import BACKOFF

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Hashes of the words between ASCII white space, ASCII letters made small."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[ \t\n\x0b\f\r]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _gram(words: Column, first: Column, n: int) -> Column:
    """The n-gram from a place (counted from 0) on; null for no words."""
    return F.xxhash64(F.lit(n), *(F.get(words, first + k) for k in range(n))) if n else F.lit(None).cast("long")


def _exploded(rows: DataFrame, n: int) -> DataFrame:
    """(row, gram, head, tail, inner) for each n-gram of each row: itself, without its last word, its first, and both."""
    words = F.col("words")
    each = F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.struct(_gram(words, i, n).alias("gram"), _gram(words, i, n - 1).alias("head"), _gram(words, i + 1, n - 1).alias("tail"), _gram(words, i + 1, max(0, n - 2)).alias("inner")),
    )
    return rows.filter(F.size(words) >= n).select("row", F.explode(each).alias("g")).select("row", "g.*")


def backoff_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """(key, n_words, log_score, mean_log) for each row of docs, by n-grams of up to order words."""
    rows = docs.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "words")
    total = rows.agg(F.sum(F.size("words"))).first()[0] or 0  # one number
    if not total:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_score"), F.lit(None).cast("double").alias("mean_log"))
    own = weights = None
    counts: list[DataFrame] = []
    for n in range(1, order + 1):
        grams = _exploded(rows, n)
        counts.append(written(grams.groupBy("gram").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("head", "tail", "inner"))), "counts"))
        of = lambda part, at: counts[at].select(F.col("gram").alias(part), F.log("n").alias(f"log_{part}"))
        if n == 1:
            weight = counts[0].select("gram", F.lit(True).alias("always"), "n", (F.log("n") - math.log(total)).alias("weight"))
        else:
            known = counts[n - 1].filter("n > 1").join(of("head", n - 2), "head").join(of("tail", n - 2), "tail")
            known = known.join(of("inner", n - 3), "inner") if n > 2 else known.withColumn("log_inner", F.lit(math.log(total)))
            weight = known.select("gram", F.lit(False).alias("always"), "n", (F.log("n") - F.col("log_head") - F.col("log_tail") + F.col("log_inner") - math.log(BACKOFF)).alias("weight"))
        each = grams.groupBy("row", "gram").agg(F.count("*").alias("own"))
        own, weights = (each, weight) if own is None else (own.union(each), weights.union(weight))
    sums = own.join(weights, "gram").filter("always or n > own").groupBy("row").agg(F.sum(F.col("own") * F.col("weight")).alias("sum"))
    size = F.size("words").cast("long")
    # word i could have min(i, order - 1) words before it
    short = F.least(size, F.lit(order))
    left_off = F.floor(short * (short - 1) / 2) + F.greatest(F.lit(0), size - order) * (order - 1)
    out = rows.select("row", "key", size.alias("n_words"), left_off.alias("left_off")).join(sums, "row", "left")
    score = F.coalesce("sum", F.lit(0.0)) + F.col("left_off") * math.log(BACKOFF)
    return out.select(F.col("key").alias(key), "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log"))
