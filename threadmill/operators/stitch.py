"""Stitching reply edges into conversations between one customer and a brand.

Rows are ``tweet_id, author_id, inbound, created_at, text, parent_id``. Whom a conversation belongs to does not depend on where one
comes from: a brand's row belongs to the first author above it who is not the brand, and what belongs to one author and hangs together is a
forest. Climbing and growing are walks to the roots of such forests, by pointer doubling (``forest.roots``): rounds are the logarithm of
the depth, and cycles of replies are told apart.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, mentions
from ..plans.staging import stage_table
from .forest import closure, cycle_entries, roots


def parents(tweets: DataFrame) -> DataFrame:
    """``tweet_id, parent_author, parent_exists``: the row that each row replies to; it may be missing."""
    up = tweets.select(F.col("tweet_id").alias("parent_id"), F.col("author_id").alias("parent_author"))
    return tweets.join(up, "parent_id", "left").select("tweet_id", "parent_id", "parent_author", F.col("parent_author").isNotNull().alias("parent_exists"))


def replied_to(tweets: DataFrame, brand: str) -> DataFrame:
    """Rows that the brand replied to."""
    replies = tweets.where((F.col("author_id") == brand) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("tweet_id")).distinct()
    return tweets.join(replies, "tweet_id", "left_semi").select("tweet_id")


def seeds(tweets: DataFrame, brand: str) -> DataFrame:
    """Customer rows that mention the brand, were answered by it or answer it."""
    up = tweets.select(F.col("tweet_id").alias("parent_id"), F.col("author_id").alias("parent_author"))
    answered = replied_to(tweets, brand).withColumn("answered", F.lit(True))
    own = tweets.where(F.col("inbound") & (F.col("author_id") != brand)).join(up, "parent_id", "left").join(answered, "tweet_id", "left")
    hit = mentions(F.col("text"), brand) | F.coalesce("answered", F.lit(False)) | F.coalesce(F.col("parent_author") == brand, F.lit(False))
    return own.where(hit).select("tweet_id", "author_id")


def owned(tweets: DataFrame, brand: str) -> DataFrame:
    """``tweet_id, parent_id, above, owner``: the row replied to if it is there, the first row above that is not the brand's, and whose
    conversation the row is in: its author's or, for a row of the brand, the author's of the row above. Written."""
    up = tweets.select(F.col("tweet_id").alias("parent_id"), F.col("author_id").alias("parent_author"))
    nodes = stage_table(tweets.select("tweet_id", "author_id", "parent_id").join(up, "parent_id", "left"), "nodes")
    theirs = F.coalesce(F.col("parent_author") == brand, F.lit(False))
    runs, _ = roots(nodes.where(F.col("author_id") == brand).select(F.col("tweet_id").alias("node"), F.when(theirs, F.col("parent_id")).alias("up")))
    ends = nodes.where(~theirs & F.col("parent_author").isNotNull()).select(F.col("tweet_id").alias("root"), F.col("parent_id").alias("over"), F.col("parent_author").alias("over_author"))
    runs = runs.join(ends, "root").select(F.col("node").alias("parent_id"), "over", "over_author")
    # Above a row: its parent, or what is above the run of the brand's rows that its parent is in.
    linked = nodes.join(runs, "parent_id", "left")
    above = F.when(theirs, F.col("over")).when(F.col("parent_author").isNotNull(), F.col("parent_id"))
    above_author = F.when(theirs, F.col("over_author")).otherwise(F.col("parent_author"))
    owner = F.when(F.col("author_id") == brand, above_author).otherwise(F.col("author_id"))
    return stage_table(linked.select("tweet_id", F.when(F.col("parent_author").isNotNull(), F.col("parent_id")).alias("parent_id"), above.alias("above"), owner.alias("owner")), "owned")


def climb(tweets: DataFrame, brand: str, found: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``seed, opening``: from each seed up through the brand's rows and its author's own seeds to the topmost of these.

    On a cycle the last one before a row would come twice is the topmost.
    """
    found = stage_table(seeds(tweets, brand) if found is None else found, "seeds")
    nodes = owned(tweets, brand) if nodes is None else nodes
    above = found.join(nodes.select("tweet_id", "above"), "tweet_id")
    own = found.select(F.col("tweet_id").alias("above"), F.col("author_id").alias("above_author"))
    same = F.when((F.col("above_author") == F.col("author_id")) & (F.col("above") != F.col("tweet_id")), F.col("above"))
    links = stage_table(above.join(own, "above", "left").select(F.col("tweet_id").alias("node"), same.alias("up")), "seed-links")
    done, turning = roots(links)
    out = done.select(F.col("node").alias("seed"), F.col("root").alias("opening"))
    if turning.isEmpty():
        return out
    return out.unionByName(cycle_entries(links, turning).select(F.col("node").alias("seed"), F.col("last").alias("opening")))


class Placed(NamedTuple):
    """``rows``: ``tweet_id, opening``, the nearest opening at or above each row of its conversation; ``nests``: ``node, up``, for each opening the next one above it."""

    rows: DataFrame
    nests: DataFrame


def placed(openings: DataFrame, nodes: DataFrame) -> Placed:
    """Where rows lie below openings: a row is in an opening's dyad if all rows between are the brand's or of the opening's author."""
    names = stage_table(openings.select(F.col("opening").alias("tweet_id")).distinct(), "opening-names")
    own = nodes.where(F.col("owner").isNotNull())
    up = own.select(F.col("tweet_id").alias("parent_id"), F.col("owner").alias("parent_owner"))
    linked = own.join(up, "parent_id", "left").join(names.withColumn("opens", F.lit(True)), "tweet_id", "left")
    parent = F.when((F.col("parent_owner") == F.col("owner")) & (F.col("parent_id") != F.col("tweet_id")), F.col("parent_id"))
    linked = stage_table(linked.select(F.col("tweet_id").alias("node"), parent.alias("parent"), F.coalesce("opens", F.lit(False)).alias("opens")), "linked")
    done, _ = roots(linked.select("node", F.when(~F.col("opens"), F.col("parent")).alias("up")))  # cycles that are left have no opening
    rows = stage_table(done.join(names.withColumnRenamed("tweet_id", "root"), "root").select(F.col("node").alias("tweet_id"), F.col("root").alias("opening")), "nearest")
    over = linked.where("opens").select("node", F.col("parent").alias("tweet_id")).join(rows, "tweet_id", "left")
    return Placed(rows, stage_table(over.select("node", F.when(F.col("opening") != F.col("node"), F.col("opening")).alias("up")), "nests"))


def grow(tweets: DataFrame, openings: DataFrame, brand: str) -> DataFrame:
    """``opening, tweet_id``: rows reachable downwards from an opening by its author or the brand; openings within openings hold their rows both."""
    at = placed(openings, owned(tweets, brand))
    over = closure(at.nests.where("up is not null")).withColumnRenamed("node", "opening")
    outer = at.rows.join(over, "opening").select(F.col("up").alias("opening"), "tweet_id")
    return at.rows.select("opening", "tweet_id").unionByName(outer)


def outermost(at: Placed) -> DataFrame:
    """``opening, tweet_id`` of the dyads that lie in no other."""
    tops, _ = roots(at.nests)  # openings on a cycle lie in each other
    return at.rows.join(tops.select(F.col("node").alias("opening"), "root"), "opening").select(F.col("root").alias("opening"), "tweet_id")


def absorbed(dyads: DataFrame) -> DataFrame:
    """Openings that lie in another opening's dyad."""
    names = dyads.select(F.col("opening").alias("tweet_id")).distinct()
    return dyads.where("tweet_id <> opening").join(names, "tweet_id", "left_semi").select(F.col("tweet_id").alias("opening")).distinct()


def assemble(tweets: DataFrame, kept: DataFrame, brand: str) -> DataFrame:
    """One row per answered opening of the outermost dyads, its turns by time, then id."""
    turn = F.struct("created_at", "tweet_id", "author_id", F.when(F.col("author_id") == brand, "brand").otherwise("customer").alias("side"), "text")
    rows = kept.join(tweets, "tweet_id").groupBy("opening").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.max(F.col("author_id") == brand).alias("answered"), F.max(F.when(F.col("tweet_id") == F.col("opening"), F.col("author_id"))).alias("customer_id")
    )
    named = F.transform("turns", lambda t: F.struct(t["tweet_id"].alias("tweet_id"), t["author_id"].alias("author_id"), t["side"].alias("side"), t["created_at"].alias("created_at"), t["text"].alias("text")))
    return rows.where("answered").select(F.col("opening").alias("interaction_id"), "customer_id", F.lit(brand).alias("brand_id"), named.alias("turns"))


def stitch(tweets: DataFrame, brand: str) -> DataFrame:
    tweets = stage_table(tweets, "tweets")
    nodes = owned(tweets, brand)
    return assemble(tweets, outermost(placed(climb(tweets, brand, nodes=nodes), nodes)), brand)


def stitch_report(tweets: DataFrame, brand: str) -> DataFrame:
    """One row of counts over all stages."""
    tweets = stage_table(tweets, "tweets")
    found, nodes = stage_table(seeds(tweets, brand), "seeds"), owned(tweets, brand)
    at = placed(climb(tweets, brand, found, nodes), nodes)
    made = stage_table(assemble(tweets, outermost(at), brand), "made")
    brand_turns = F.size(F.filter("turns", lambda t: t["side"] == "brand"))
    parts = [
        tweets.agg(F.count("*").alias("total_rows"), F.count_if("inbound").alias("inbound_rows"), F.count_if(F.col("author_id") == brand).alias("brand_rows")),
        found.agg(F.count("*").alias("seed_count")),
        at.nests.agg(F.count("*").alias("opening_count"), F.count("up").alias("absorbed_openings")),
        made.agg(F.count("*").alias("interactions"), F.coalesce(F.sum(F.size("turns")), F.lit(0)).alias("turns_total"), F.coalesce(F.sum(brand_turns), F.lit(0)).alias("turns_brand")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out.withColumns({"unanswered_openings": F.col("opening_count") - F.col("absorbed_openings") - F.col("interactions"), "turns_customer": F.col("turns_total") - F.col("turns_brand")})


def opening_text(interactions: DataFrame) -> DataFrame:
    """The text that stands for a conversation: that of its first turn."""
    return interactions.withColumn("message", F.element_at("turns", 1)["text"])


def with_opening(interactions: DataFrame) -> DataFrame:
    """Conversations whose first turn is not blank."""
    return interactions.where(~is_blank(F.element_at("turns", 1)["text"]))


def turn_counts(interactions: DataFrame) -> DataFrame:
    n = lambda side: F.size(F.filter("turns", lambda t: t["side"] == side))
    return interactions.select("interaction_id", n("customer").alias("customer_turns"), n("brand").alias("brand_turns"))
