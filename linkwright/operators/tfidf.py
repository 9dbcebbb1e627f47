"""TF-IDF over character n-grams inside words: sublinear counts, smooth idf, unit length.

Terms are counted and cosines computed where the texts are (Arrow), so that neither the terms of a text nor its weights become rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.config import DEFAULT, Settings
from linkwright.functions.text import tokens
from linkwright.operators.storage import durable


def ngrams(c: Column, low: int, high: int) -> Column:
    """All n-grams (low to high characters) of each word with one space on either side.

    A padded word as short as n gives itself once.
    """
    padded = F.transform(tokens(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(n: int) -> Column:
        windows = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))
        return F.flatten(F.transform(F.filter(padded, lambda w: F.length(w) >= n), windows))

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


@lru_cache(maxsize=1 << 14)
def _of_word(word: str, low: int, high: int) -> tuple[str, ...]:
    padded = f" {word} "
    return tuple(padded[i : i + n] for n in range(low, high + 1) for i in range(len(padded) - n + 1))


def _grams(text: str, low: int, high: int) -> list[str]:
    """What `ngrams` gives, word by word."""
    return [g for w in text.split(" ") if w for g in _of_word(w, low, high)]


def fit(corpus: DataFrame, column: str, settings: Settings = DEFAULT) -> DataFrame:
    """(term, df, tf, idf): the vocabulary of `corpus`, most frequent terms first, ties by term.

    Terms in fewer than `tfidf_min_df` texts are left out; at most `tfidf_max_terms` are kept.
    idf = ln((1 + texts) / (1 + df)) + 1; empty texts count as texts.
    """
    n = corpus.count()
    low, high = settings.tfidf_ngrams

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, seen = Counter(), defaultdict(Counter)
            for text, m in zip(b["text"].tolist(), b["m"].tolist()):
                for w in (text or "").split(" "):
                    words[w] += m
                seen[m].update(set(_grams(text or "", low, high)))
            df, tf = Counter(), Counter()
            for m, terms in seen.items():
                for g, c in terms.items():
                    df[g] += c * m
            for w, c in words.items():
                for g in _grams(w, low, high):
                    tf[g] += c
            tf = {g: tf[g] for g in df}
            yield pd.DataFrame({"term": list(df), "df": list(df.values()), "tf": list(tf.values())})

    # Equal texts are counted once, their terms batch by batch, so that no task holds the terms of all its texts.
    texts = corpus.groupBy(F.col(column).alias("text")).agg(F.count("*").alias("m"))
    per = texts.mapInPandas(counted, "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    kept = per.filter(F.col("df") >= settings.tfidf_min_df).orderBy(F.desc("tf"), "term").limit(settings.tfidf_max_terms)
    return kept.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def weights(norm: DataFrame, column: str, terms: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(entity_id, w): map of term to weight, of unit length; records without a known term are left out."""
    grams = norm.select("entity_id", F.explode(ngrams(F.col(column), *settings.tfidf_ngrams)).alias("term"))
    tf = grams.groupBy("entity_id", "term").agg(F.count("*").alias("c"))
    raw = tf.join(terms.select("term", "idf"), "term").withColumn("x", (1.0 + F.log("c")) * F.col("idf"))
    listed = raw.groupBy("entity_id").agg(F.collect_list(F.struct("term", "x")).alias("l"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return listed.select("entity_id", F.map_from_entries(F.transform("l", lambda e: F.struct(e["term"], (e["x"] / F.col("len")).alias("x")))).alias("w"))


def cosine(a: str, b: str, terms: DataFrame, settings: Settings = DEFAULT) -> Column:
    """Cosine of the texts in columns `a` and `b`; 0 where one has no known term.

    The vocabulary, `tfidf_max_terms` rows at most, is sent to the workers. It is written first: collected as it is, each task
    would send the driver so many rows, which cuts them there.
    """
    low, high = settings.tfidf_ngrams
    sent = terms.sparkSession.sparkContext.broadcast({r["term"]: r["idf"] for r in durable(terms.select("term", "idf")).toLocalIterator()})

    @F.pandas_udf("double")
    def dot(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        idf = sent.value

        @lru_cache(maxsize=1 << 14)
        def weights(text: str) -> dict[str, float]:
            counts = Counter(_grams(text, low, high))
            x = {g: v if c == 1 else (1.0 + math.log(c)) * v for g, c in counts.items() if (v := idf.get(g)) is not None}
            length = math.sqrt(sum(v * v for v in x.values()))
            return {g: v / length for g, v in x.items()}

        for left, right in batches:
            of = [(weights(x or ""), weights(y or "")) for x, y in zip(left, right)]
            yield pd.Series([sum([v * y[g] for g, v in x.items() if g in y], 0.0) for x, y in of], dtype="float64")

    return dot(F.col(a), F.col(b))
