"""Benchmark decontamination (DataFrame functions only).

A document is contaminated by an item if one of its windows, as long as the item in words, has a weighted similarity of
at least ``similarity`` to it over word shingles. Windows and items get SimHash fingerprints; the items' 64 bits are cut
into ``BLOCKS`` blocks, and each block is indexed under every value within ``radius // BLOCKS`` bits of it, so that
a fingerprint within the radius of an item meets it in one block at least. Candidates are verified by the exact
weighted similarity: the sum of the lesser weights over the sum of the greater ones, counting repeats.

Windows are laid where one could pass the exact test: a window that shares no shingle with an item has similarity zero to it,
and one with the least similarity shares that part of the item's weight; so they are laid around shingles that a document shares
with some item, at every offset that insertions and deletions within the similarity can cause, and only where the document
has that much. Which items a document may have so much of, a prefix of each item decides: of its shingles, rarest first, those
without which the rest weighs less than the similarity asks for; a document that has none of them is not compared with
the item, so a template that many items share brings no pairs. A window is laid once for a length, not for an item: which items it is like, the index finds, over all
items of that length. A pair is found if its fingerprints are within ``radius`` (at a similarity of 0.8 they differ in some 10 of 64 bits,
so 24 leaves out next to none; the tests find every pair).

Words are runs of letters and digits of the lower-cased text. A shingle weighs 4 if one item at most has it, 2 if two
or three have it, else 1. Items shorter than a shingle are one shingle. Null and empty texts match nothing; ties between
windows go to the first one; repeated rows are reported repeatedly; null ids are reported as null; with an
empty table on either side nothing is reported; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHINGLE, BLOCKS, BITS = 5, 8, 8
#: Digests of a document's id and text.
KEY = ["doc", "digest"]
#: Shingles of all items, or documents with windows, up to which they are broadcast (about 64 MB); beyond, the join is a shuffle.
BROADCAST_ROWS = 1_000_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; the words are evaluated once."""

    def runs(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(F.lit(size), *[h[i + k] for k in range(size)]))
        return F.when(F.size(h) >= size, each).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(hashes), runs)[0]


def _bit_sums(weight: Column, value: Column) -> list[Column]:
    """Sums of the weights of set bits; each sum holds two bits, 32 bits apart."""
    bit = lambda k: F.shiftrightunsigned(value, k).bitwiseAND(F.lit(1).cast("long"))
    return [F.sum(weight * (bit(2 * j) + F.shiftleft(bit(2 * j + 1), 32))).alias(f"s{j}") for j in range(32)]


def _fingerprint(total: Column) -> Column:
    out = F.lit(0).cast("long")
    for j in range(32):
        low = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        high = F.shiftrightunsigned(F.col(f"s{j}"), 32)
        for k, ones in ((2 * j, low), (2 * j + 1, high)):
            out = out.bitwiseOR(F.when(2 * ones > total, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return out


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


@dataclass
class Found:
    """The windows that pass the exact test, and what names their documents and items again."""

    sure: DataFrame  # KEY, words, start, item, similarity, hamming
    hashed: DataFrame  # doc_id, KEY, text
    windows: DataFrame  # doc_id, KEY, words, start
    items: DataFrame  # item, item_id, words


def _found(docs: DataFrame, items: DataFrame, similarity: float, radius: int, id_col: str, text_col: str, item_col: str, item_text_col: str, scratch: Scratch) -> Found | None:
    """None if there are no items."""
    own = items.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("h")).where(F.size("h") > 0)
    own = scratch.put(own.withColumn("item", F.xxhash64("item_id", "h")).dropDuplicates(["item"]), "items")
    sizes = [r[0] for r in own.select(F.least(F.size("h"), F.lit(SHINGLE))).distinct().collect()]  # five values at most
    by_size = own.select("item", F.least(F.size("h"), F.lit(SHINGLE)).alias("size"), F.size("h").alias("words"), "h")
    parts = [by_size.where(F.col("size") == n).select("item", "size", "words", F.posexplode(shingles(F.col("h"), n)).alias("q", "sh")) for n in sizes]
    if not parts:
        return None
    places = parts[0]
    for p in parts[1:]:
        places = places.unionByName(p)
    df = places.groupBy("sh").agg(F.count_distinct("item").alias("items"))
    weight = F.when(F.col("items") <= 1, 4).when(F.col("items") <= 3, 2).otherwise(1).cast("long")
    places = scratch.put(places.join(df.select("sh", "items", weight.alias("weight")), "sh"), "places")
    counted = places.groupBy("item", "sh", "weight", "items").agg(F.count("*").alias("item_n"))
    rare_first = Window.partitionBy("item").orderBy("items", "sh")
    mass = F.col("weight") * F.col("item_n")
    earlier = F.coalesce(F.sum(mass).over(rare_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(mass).over(Window.partitionBy("item"))
    counted = counted.withColumn("prefix", total - earlier >= F.lit(similarity) * total - 1e-6)
    counted = scratch.put(counted.select("item", "sh", "weight", "item_n", "prefix"), "counted")
    totals = places.groupBy("item", "size", "words").agg(F.sum("weight").alias("item_total"), *_bit_sums(F.col("weight"), F.col("sh")))
    totals = scratch.put(totals.select("item", "size", "words", "item_total", _fingerprint(F.col("item_total")).alias("item_fp")), "totals")

    # Anchors: places of documents whose shingle some item has too; once, however many items have it.
    key = KEY
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("doc"), F.xxhash64(F.lit(1), text_col).alias("digest"), F.col(text_col).alias("text"))
    small = places.count() <= BROADCAST_ROWS
    fit = F.broadcast if small else (lambda x: x)
    known = counted.groupBy("sh", "weight").agg(F.bool_or("prefix").alias("prefix"))
    # Shingles of all sizes in one pass; the words are bound by an outer function, so that they are formed once.
    each = lambda h: [F.transform(shingles(h, n), lambda sh, p: F.struct(p.alias("p"), sh.alias("sh"))) for n in sizes]
    runs = F.transform(F.array(word_hashes(F.col("text"))), lambda h: F.concat(*each(h)))[0]
    found = hashed.select(*key, F.inline(runs))
    anchors = scratch.put(found.join(fit(known), "sh"), "anchors")
    # Enough of the item's weight must be there, counting a shingle no more often than the item has it.
    in_prefix = counted.where("prefix").select("sh", "item")
    met = anchors.where("prefix").select(*key, "sh").distinct().join(fit(in_prefix), "sh").select(*key, "item").distinct()
    met = scratch.put(met, "candidates")
    have = anchors.select(*key, "sh", "p").distinct().groupBy(*key, "sh").agg(F.count("*").alias("doc_n"))
    have = scratch.put(have.join(met.select(*key).distinct(), key, "left_semi"), "have")
    have = met.join(fit(counted), "item").join(have, [*key, "sh"]).groupBy(*key, "item").agg(F.sum(F.col("weight") * F.least("doc_n", "item_n")).alias("shared"))
    pairs = have.join(fit(totals), "item").where(F.col("shared") >= similarity * F.col("item_total")).select(*key, "item", "size", "words")
    pairs = scratch.put(pairs, "pairs")
    starts = pairs.join(fit(places.select("item", "sh", "q")), "item").join(anchors.select(*key, "sh", "p"), [*key, "sh"])
    starts = starts.select(*key, "size", "words", (F.col("p") - F.col("q")).alias("at")).distinct()
    spread = F.ceil((1 - similarity) * F.col("words")).cast("int") + 1
    starts = starts.select(*key, "size", "words", F.explode(F.sequence(F.col("at") - spread, F.col("at") + spread)).alias("start"))
    starts = scratch.put(starts.groupBy(*key, "size", "words").agg(F.collect_set("start").alias("starts")), "starts")

    # Windows of the few documents that have candidates.
    held = scratch.put(pairs.select(*key).distinct(), "held")
    again = hashed.join(F.broadcast(held) if held.count() <= BROADCAST_ROWS else held, key, "left_semi")
    again = again.join(starts, key).select("doc_id", *key, "size", "words", "starts", word_hashes(F.col("text")).alias("h"))
    last = F.greatest(F.size("h") - F.col("words"), F.lit(0))
    again = again.withColumn("starts", F.array_distinct(F.transform("starts", lambda s: F.greatest(F.lit(0), F.least(s, last)))))
    by_shingle = None
    for n in sizes:
        part = again.where(F.col("size") == n).withColumn("all", shingles(F.col("h"), n))
        part = part.withColumn("start", F.explode("starts")).drop("starts", "h")
        run = F.slice("all", F.col("start") + 1, F.greatest(F.col("words") - n + 1, F.lit(1)))
        part = part.select("doc_id", *key, "words", "start", run.alias("run"))
        by_shingle = part if by_shingle is None else by_shingle.unionByName(part)
    # Rows with the same id and text are one window; how often they occur comes back at the end.
    window = [*key, "words", "start"]
    windows = by_shingle.dropDuplicates(window).select(*window, F.explode("run").alias("sh"))
    windows = windows.join(fit(known.select("sh", "weight")), "sh", "left").withColumn("weight", F.coalesce("weight", F.lit(4).cast("long")))
    windows = windows.groupBy(*window, "sh", "weight").agg(F.count("*").alias("n"))
    windows = scratch.put(windows, "windows")
    prints = windows.groupBy(*window).agg(F.sum(F.col("weight") * F.col("n")).alias("total"), *_bit_sums(F.col("weight") * F.col("n"), F.col("sh")))
    prints = scratch.put(prints.select(*window, "total", _fingerprint(F.col("total")).alias("fp")), "prints")
    near = [sum(1 << b for b in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(BITS), r)]
    flips = F.array(*[F.lit(m).cast("long") for m in near])
    around = lambda k: F.transform(flips, lambda m: _block(F.col("item_fp"), k).bitwiseXOR(m))
    of_item = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), around(k).alias("near")) for k in range(BLOCKS)]))
    blocks = totals.select("item", "words", "item_fp", "item_total", of_item.alias("b")).select("item", "words", "item_fp", "item_total", "b.k", F.explode("b.near").alias("block"))
    probes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _block(F.col("fp"), k).alias("block")) for k in range(BLOCKS)]))
    met = prints.select(*window, "total", "fp", probes.alias("b")).select(*window, "total", "fp", "b.k", "b.block").join(blocks, ["words", "k", "block"])
    met = met.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("hamming") <= radius)
    met = scratch.put(met.select(*window, "item", "total", "item_total", "hamming").distinct(), "met")
    shared = met.select(*window, "item").join(windows, window).join(fit(counted.drop("prefix")), ["item", "sh", "weight"])
    shared = shared.groupBy(*window, "item").agg(F.sum(F.col("weight") * F.least("n", "item_n")).alias("shared"))
    alike = F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared"))
    sure = met.join(shared, [*window, "item"]).withColumn("similarity", alike).where(F.col("similarity") >= similarity)
    named = own.select("item", "item_id", F.size("h").alias("words"))
    return Found(sure, hashed, by_shingle.select("doc_id", *window), named)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = 0.8,
    radius: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, words, hamming``: the best window of each document and item.

    The result reads tables of ``scratch``, a folder of its own where none is given.
    """
    spark = docs.sparkSession
    found = _found(docs, items, similarity, radius, id_col, text_col, item_col, item_text_col, scratch or Scratch(spark, "decontaminate"))
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, start_word int, words int, hamming int")
    best = found.sure.groupBy(*KEY, "item").agg(F.max_by(F.struct("similarity", "start", "hamming"), F.struct("similarity", -F.col("start"))).alias("w"))
    ids = found.windows.withColumnRenamed("start", "some_start")
    first = ids.groupBy("doc_id", *KEY, "words").agg(F.min("some_start").alias("some_start"), F.count("*").alias("rows"), F.count_distinct("some_start").alias("starts"))
    times = F.explode(F.sequence(F.lit(1), (F.col("rows") / F.col("starts")).cast("int")))
    out = best.join(found.items, "item").join(first, [*KEY, "words"])
    return out.select(
        "doc_id", "item_id", F.col("w.similarity").alias("similarity"), F.col("w.start").alias("start_word"), "words", F.col("w.hamming").alias("hamming"), times.alias("copy")
    ).drop("copy")


def contaminated_ids(docs: DataFrame, items: DataFrame, id_col: str, scratch: Scratch, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """``id_col`` of each row that ``contaminated`` reports with any item, once a row. The result reads tables of ``scratch``.

    Neither the best windows nor how often rows repeat are asked for, so windows are not laid a second time.
    """
    found = _found(docs, items, similarity, radius, id_col, "text", "item_id", "text", scratch)
    if found is None:
        return docs.select(id_col).where(F.lit(False))
    keys = scratch.put(found.sure.select(*KEY).distinct(), "sure")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return found.hashed.join(keys, KEY, "left_semi").select(F.col("doc_id").alias(id_col))
