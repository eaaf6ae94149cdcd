"""Keeping one language: a detector by n-grams on opening texts, the keep rule, and the breakdown.

The detector is a likelihood: Spark counts the 1- to 5-grams of the words of labelled texts, the most frequent of each language and order become a
table of smoothed log-probabilities, and a text's score in a language is the sum over the n-grams of its words, averaged over the orders. A batch's
distinct words are scored once each, in the task that reads the texts; these then add up the scores of their words. A language is named if its posterior probability leads that of
the next one by ``MIN_LANGUAGE_DISTANCE``, so texts of few letters, or none, have no signal. Any number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import clean
from ..plans.staging import stage_table

#: Longest n-grams, how many of each language and order are kept, and what is added to each count.
ORDERS, SIZE, ADDED = 5, 5000, 0.5


def keep(rows: DataFrame, language: str = "ENGLISH", column: str = "language") -> DataFrame:
    """Rows in the language, and those without a confident signal."""
    return rows.where(F.coalesce(column, F.lit(language)) == language)


def breakdown(rows: DataFrame, language: str = "ENGLISH", column: str = "language") -> DataFrame:
    """Dropped languages by count, then name."""
    return rows.where(F.col(column).isNotNull() & (F.col(column) != language)).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def report(rows: DataFrame, language: str = "ENGLISH", column: str = "language") -> DataFrame:
    """One row: total, retained, no_signal, filtered and the filtered share (0 for no rows)."""
    gone = F.col(column).isNotNull() & (F.col(column) != language)
    out = rows.agg(F.count("*").alias("total"), F.count_if(~gone).alias("retained"), F.count_if(F.col(column).isNull()).alias("no_signal"), F.count_if(gone).alias("filtered"))
    return out.withColumn("filtered_rate", F.coalesce(F.try_divide("filtered", "total"), F.lit(0.0)))


def profiles(rows: DataFrame, n: int = 3, size: int = 400, text: str = "text", column: str = "language") -> DataFrame:
    """``language, gram, n, share``: the ``size`` most frequent n-grams of each language's texts and their share among those.

    Counted over all rows of a known language, words first, so that each is cut once; as many rows come out as languages times ``size`` at most.
    """
    said = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)).alias("word")
    words = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("language"), said).groupBy("language", "word").agg(F.count("*").alias("c"))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: padded.substr(i, F.lit(n)))
    counted = words.where(F.length(padded) >= n).select("language", "c", F.explode(grams).alias("gram")).groupBy("language", "gram").agg(F.sum("c").alias("n"))
    own = Window.partitionBy("language")
    top = counted.withColumn("rn", F.row_number().over(own.orderBy(F.desc("n"), "gram"))).where(F.col("rn") <= size).drop("rn")
    return top.withColumn("share", F.col("n") / F.sum("n").over(own))


class Model(NamedTuple):
    """``grams``: ``language, n, gram, gain``, how much likelier an n-gram is than an unknown one; ``floors``: ``language, n, floor``, the log-probability of that."""

    grams: DataFrame
    floors: DataFrame
    languages: list[str]


def words_of(text: Column) -> Column:
    """The runs of letters of a text without links and handles, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(clean(text), F.lit(""))), F.lit(r"(\p{L}+)"), 1)


def _grams(word: Column) -> Column:
    """``n, gram`` of a word: its letters, and the longer n-grams of the word between two spaces."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))

    def of(n: int) -> Column:
        text = word if n == 1 else padded
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), text.substr(i, F.lit(n)).alias("gram")))).otherwise(F.array())

    return F.flatten(F.array(*[of(n) for n in range(1, ORDERS + 1)]))


def train(rows: DataFrame, text: str = "text", column: str = "language", size: int = SIZE) -> Model:
    """A model of all rows of a known language: counts of their words, then of the words' n-grams."""
    counted = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("language"), F.explode(words_of(F.col(text))).alias("word")).groupBy("language", "word").agg(F.count("*").alias("c"))
    counted = counted.select("language", "c", F.inline(_grams(F.col("word")))).groupBy("language", "n", "gram").agg(F.sum("c").alias("c"))
    counted = stage_table(counted, "gram-counts")
    distinct = counted.groupBy("n").agg(F.count_distinct("gram").alias("distinct"))
    totals = counted.groupBy("language", "n").agg(F.sum("c").alias("total")).join(distinct, "n")
    floors = stage_table(totals.select("language", "n", F.log(ADDED / (F.col("total") + ADDED * (F.col("distinct") + 1))).alias("floor")), "gram-floors")
    own = Window.partitionBy("language", "n").orderBy(F.desc("c"), "gram")
    top = counted.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= size)
    top = stage_table(top.select("language", "n", "gram", F.log((F.col("c") + ADDED) / ADDED).alias("gain")), "grams")
    return Model(top, floors, sorted(r[0] for r in floors.select("language").distinct().collect()))


def _summed(rows: DataFrame, model: Model, text: str, key: str) -> DataFrame:
    """``key, words, s0, s1, ...``: the log-likelihoods of a text's words, averaged over the orders; of a text without letters they are null.

    The model (languages times ``ORDERS`` times ``SIZE`` n-grams at most) goes to every task, which scores each distinct word of a batch once where it
    lies; only the sums of each text are shuffled.
    """
    wide = len(model.languages)
    lang = {name: i for i, name in enumerate(model.languages)}
    floors = np.zeros((ORDERS, wide))
    for r in model.floors.collect():
        floors[r["n"] - 1, lang[r["language"]]] = r["floor"]
    grams = model.grams.select("language", "gram", "gain").collect()  # an n-gram's length is its order
    place = {g: i for i, g in enumerate(dict.fromkeys(r["gram"] for r in grams))}
    gains = np.zeros((len(place), wide))
    for r in grams:
        gains[place[r["gram"]], lang[r["language"]]] = r["gain"]

    def scored(words: list[str]) -> np.ndarray:
        found, of = [], []
        for i, word in enumerate(words):
            padded = f" {word} "
            own = [*word, *(padded[j : j + n] for n in range(2, ORDERS + 1) for j in range(len(padded) - n + 1))]
            got = [place[g] for g in own if g in place]
            found += got
            of += [i] * len(got)
        long = np.array([len(w) for w in words], np.int64)[:, None]
        many = np.maximum(long + np.array([0, *(3 - n for n in range(2, ORDERS + 1))]), 0)
        known = gains[np.array(found, np.int64)]
        return (many @ floors + np.stack([np.bincount(np.array(of, np.int64), known[:, i], len(words)) for i in range(wide)], axis=1)) / ORDERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            said = b.column(1)
            count = said.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = said.flatten().dictionary_encode()
            each, words = scored(coded.dictionary.to_pylist()) if wide else np.zeros((len(coded.dictionary), 0)), coded.indices.to_numpy()
            ends, sums = np.concatenate([[0], np.cumsum(count)]), np.zeros((len(count), wide))
            for at in range(0, len(count), 256):
                own = count[at : at + 256]
                of, part = np.repeat(np.arange(len(own)), own), words[ends[at] : ends[at + len(own)]]
                for i in range(wide):
                    sums[at : at + 256, i] = np.bincount(of, each[part, i], len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), *(pa.array(sums[:, i], mask=count == 0) for i in range(wide))], names)

    columns = [f"s{i}" for i in range(wide)]
    names = [key, "words", *columns]
    said = rows.select(key, words_of(F.col(text)).alias("_words"))
    each = said.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, words long" + "".join(f", {c} double" for c in columns))
    return each.groupBy(key).agg(F.sum("words").alias("words"), *[F.sum(c).alias(c) for c in columns])


def scores(rows: DataFrame, model: Model, text: str = "message", key: str = "interaction_id") -> DataFrame:
    """``key, language, score`` of every text with letters, for each language of the model."""
    each = F.array(*[F.struct(F.lit(name).alias("language"), F.col(f"s{i}").alias("score")) for i, name in enumerate(model.languages)])
    return _summed(rows, model, text, key).where("words > 0").select(key, F.inline(each))


def detect(rows: DataFrame, model: Model, least: float = V.MIN_LANGUAGE_DISTANCE, text: str = "message", key: str = "interaction_id") -> DataFrame:
    """``key, language`` of every row; null where there is no confident signal."""
    if not model.languages:
        return rows.select(key, F.lit(None).cast("string").alias("language"))
    each = F.array(*[F.struct(F.col(f"s{i}").alias("score"), F.lit(name).alias("language")) for i, name in enumerate(model.languages)])
    best = F.sort_array(each, asc=False)
    sums = _summed(rows, model, text, key).withColumn("best", best)
    whole = F.aggregate("best", F.lit(0.0), lambda s, x: s + F.exp(x["score"] - F.col("best")[0]["score"]))
    second = F.coalesce(F.exp(F.try_element_at("best", F.lit(2))["score"] - F.col("best")[0]["score"]), F.lit(0.0))
    sure = (F.col("words") > 0) & ((1 - second) / whole >= least)
    return sums.select(key, F.when(sure, F.col("best")[0]["language"]).alias("language"))
