"""A persistent inverted index for BM25 whose blocks carry their greatest impact, and exact top-k that skips blocks.

Documents are laid out in ranges by length (a short text gives a term more weight, so impacts fall from range to range); a block
holds one term's postings of one range. The impact of a posting is its BM25 weight without the inverse document frequency, so blocks
do not depend on the batch that asks. A range cannot hold a document better than the sum of its blocks' greatest impacts;
a batch scores the most promising ranges of each entry first and then only those that this bound does not rule out.

Ids are unique. Null texts are empty; a text without words is a document of length 0 that is never found; an entry without a known
word has no result; an empty table makes an empty index.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contracts
from ..plans.staging import stage_table

#: Documents and words of a range, at most in the mean; lengths are told apart by quarters of a doubling.
DOCUMENTS, WORDS, STEPS = 1024, 1 << 20, 4
#: Terms up to which the scan of the postings gets a list of them; beyond, it is joined.
LISTED = 2000
#: Ranges that each entry scores before any is ruled out.
FIRST = 3
#: Asked entries that a range scores in one group, in the mean.
SLOT = 4096
_SLACK = 1e-7


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


@dataclass
class LexicalIndex:
    spark: SparkSession
    folder: str
    documents: int
    mean_length: float

    def blocks(self) -> DataFrame:
        """``range, term, most, n, entries``: a block's greatest impact, its size and its postings ``doc_id, impact``."""
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def terms(self) -> DataFrame:
        """``term, df``."""
        return self.spark.read.parquet(f"{self.folder}/terms")

    def places(self) -> DataFrame:
        """``doc_id, range``."""
        return self.spark.read.parquet(f"{self.folder}/places")


def build(docs: DataFrame, folder: str, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", documents: int = DOCUMENTS, words: int = WORDS) -> LexicalIndex:
    """Write the index of ``docs`` (``key, text``): their texts are shuffled once, by range; terms are counted where they then lie."""
    spark = docs.sparkSession
    size = F.size(tokens(F.col("text")))
    level = F.floor(STEPS * F.log2(F.col("len") + 1)).cast("int")
    lengths = stage_table(docs.select(F.col(key).alias("doc_id"), size.alias("len")).withColumn("level", level), "lengths")
    contracts.unique(lengths, "doc_id", "doc_id")
    levels = lengths.groupBy("level").agg(F.count("*").alias("n"), F.sum("len").alias("words")).orderBy("level").collect()  # some hundred rows
    first, base = {}, 0
    for r in levels:
        first[r["level"]] = (base, max(1, -(-r["n"] // documents), -(-r["words"] // words)))
        base += first[r["level"]][1]
    n, total = sum(r["n"] for r in levels), sum(r["words"] for r in levels)
    mean = total / n if n else 0.0
    index = LexicalIndex(spark, folder, n, mean)
    named = spark.createDataFrame([(k, *v) for k, v in first.items()], "level int, base int, slices int")
    place = F.col("base") + F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int")
    cut = docs.select(F.col(key).alias("doc_id"), tokens(F.col("text")).alias("ws")).withColumn("len", F.size("ws")).withColumn("level", level)
    cut = cut.join(F.broadcast(named), "level").select("doc_id", "len", place.alias("range"), "ws")  # a row for each level
    cut.select("doc_id", "range").write.mode("overwrite").parquet(f"{folder}/places")
    counted = cut.repartition("range").select("range", "doc_id", "len", F.explode("ws").alias("term")).groupBy("range", "doc_id", "len", "term").agg(F.count("*").alias("tf"))
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean or 1.0)))
    entry = F.struct("doc_id", impact.alias("impact"))
    blocks = counted.groupBy("range", "term").agg(F.max(impact).alias("most"), F.count("*").alias("n"), F.collect_list(entry).alias("entries"))
    blocks.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/blocks")
    index.blocks().groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    meta = json.dumps({"version": 1, "documents": n, "mean_length": mean, "k1": k1, "b": b})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    return index


def opened(spark: SparkSession, folder: str) -> LexicalIndex:
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    if meta["version"] != 1:
        raise contracts.ContractError(f"{folder} is not a lexical index of version 1")
    return LexicalIndex(spark, folder, meta["documents"], meta["mean_length"])


def weighted(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """``asked_id, term, idf`` of the known words of ``asked`` (``asked_id, text``); written."""
    idf = F.log(1 + (F.lit(float(index.documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = asked.select("asked_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return stage_table(words.join(index.terms(), "term").select("asked_id", "term", idf.alias("idf")), "asked")


def _read(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """The blocks, without those of terms that are not asked for where these are few enough to list."""
    listed = [r[0] for r in terms.select("term").distinct().limit(LISTED + 1).collect()]
    return index.blocks().where(F.col("term").isin(listed)) if len(listed) <= LISTED else index.blocks()


def bounds(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """``asked_id, range, bound, n``: what a document of the range can score at most, and how many it has at least."""
    blocks = _read(index, terms).select("range", "term", "most", "n")
    return blocks.join(terms, "term").groupBy("asked_id", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"), F.max("n").alias("n"))


def _order(k: int) -> Window:
    return Window.partitionBy("asked_id").orderBy(F.round("score", 9).desc(), "doc_id")


def _best(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(_order(k))).where(F.col("rank") <= k)


def _met(index: LexicalIndex, terms: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``asked_id, doc_id, score`` for ``wanted`` (``asked_id, range, docs``): of the documents ``docs``, or of the range's best ``k`` where that is null.

    The blocks of a range go to one place once, however many entries ask for them; the entries come in slots of some ``SLOT`` to a range. Documents
    that rounding may rank among the best ``k`` come along.
    """
    own = stage_table(terms.groupBy("asked_id").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs")), "asked-words")
    slots = max(1, -(-own.count() // SLOT))
    asked = wanted.join(own, "asked_id").withColumn("slot", F.pmod(F.xxhash64("asked_id"), F.lit(slots)).cast("int"))
    blocks = _read(index, terms).join(terms.select("term").distinct(), "term", "left_semi").join(wanted.select("range").distinct(), "range", "left_semi")
    blocks = blocks.select("range", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "term", F.col("entries.doc_id").alias("ids"), F.col("entries.impact").alias("impacts"))

    def score(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        asked_ids, ids, scores = [], [], []
        if len(blocks) and len(asked):
            place = {t: i for i, t in enumerate(blocks["term"])}
            ends = np.cumsum([len(x) for x in blocks["ids"]])
            docs, at = np.unique(np.concatenate(blocks["ids"].to_list()), return_inverse=True)
            at, impacts = np.split(at, ends[:-1]), blocks["impacts"].to_list()
            for asked_id, words, idfs, chosen in zip(asked["asked_id"], asked["terms"], asked["idfs"], asked["docs"], strict=True):
                own = np.zeros(len(docs))
                for i, idf in sorted((place[w], idf) for w, idf in zip(words, idfs, strict=True) if w in place):
                    own[at[i]] += idf * impacts[i]
                some = np.flatnonzero(own) if chosen is None else np.flatnonzero(np.isin(docs, chosen) & (own != 0))
                if chosen is None and len(some) > k:
                    some = some[own[some] >= np.partition(own[some], len(some) - k)[len(some) - k] - 2e-9]
                    some = some[np.lexsort((docs[some], own[some]))]
                    first = np.concatenate([[0], np.flatnonzero(np.diff(own[some])) + 1])  # of equal scores, the least ids
                    some = some[np.arange(len(some)) - np.repeat(first, np.diff(np.append(first, len(some)))) < k]
                asked_ids += [asked_id] * len(some)
                ids += docs[some].tolist()
                scores += own[some].tolist()
        return pd.DataFrame({"asked_id": asked_ids, "doc_id": ids, "score": scores})

    kinds = {f.name: f.dataType.simpleString() for f in [*own.schema, *index.places().schema]}
    both = blocks.groupBy("range", "slot").cogroup(asked.groupBy("range", "slot"))
    return both.applyInPandas(score, f"asked_id {kinds['asked_id']}, doc_id {kinds['doc_id']}, score double")


def _scored(index: LexicalIndex, terms: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``asked_id, doc_id, score`` of the best ``k`` documents of each of the ranges of ``pairs`` (``asked_id, range``)."""
    return _met(index, terms, pairs.select("asked_id", "range", F.lit(None).cast("array<long>").alias("docs")), k)


def topk(index: LexicalIndex, asked: DataFrame, k: int = 5) -> DataFrame:
    """``asked_id, doc_id, score, rank`` of the best ``k`` documents with a common word for each row of ``asked`` (``asked_id, text``)."""
    return searched(index, weighted(index, asked), k)[0]


def searched(index: LexicalIndex, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The best documents, and the pairs ``asked_id, range`` that were scored for them."""
    every = bounds(index, terms)
    order = Window.partitionBy("asked_id").orderBy(F.desc("bound"), "range")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = stage_table(every.withColumns({"first": (before < 2 * k) | (F.row_number().over(order) <= FIRST)}), "bounds")
    first = every.where("first")
    found = stage_table(_best(_scored(index, terms, first, k), k), "found")
    least = found.where(F.col("rank") == k).select("asked_id", F.col("score").alias("least"))
    rest = every.where("NOT first").join(least, "asked_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK))
    rest = stage_table(rest.select("asked_id", "range"), "rest")
    more = _best(_scored(index, terms, rest, k), k)
    return _best(found.drop("rank").unionByName(more.drop("rank")), k), first.select("asked_id", "range").unionByName(rest)


def scores_of(index: LexicalIndex, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``asked_id, doc_id, score`` of given pairs with a common word; only the blocks of their ranges are shuffled."""
    placed = stage_table(pairs.select("asked_id", "doc_id").distinct().join(index.places(), "doc_id"), "pairs")
    return _met(index, terms, placed.groupBy("asked_id", "range").agg(F.collect_list("doc_id").alias("docs")), 0)
