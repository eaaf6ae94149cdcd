"""Planning an evaluation set: quotas with floors, decision balance, stratified picks, interleaving, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import hash_rank


def apportion(strata: DataFrame, target: int = V.GOLDEN_TARGET, floor: int = V.GOLDEN_FLOOR) -> DataFrame:
    """``ord, intent, available, quota`` from ``ord, intent, available``.

    Seats are first given in proportion, at least the floor (or what there is). Then seats are added where the deficit
    is largest, or taken where it is smallest, ties to the earlier intent; floors win over the target. As each
    intent's deficits fall seat by seat, taking the best of all candidate seats at once gives what taking them one by one
    does. Intents are few; seats at most the target.
    """
    every = Window.partitionBy(F.lit(0))
    s = strata.withColumn("total", F.sum("available").over(every)).withColumn("goal", F.least(F.lit(target).cast("long"), "total"))
    share = F.col("goal") * F.col("available") / F.col("total")
    lowest = F.least(F.lit(floor).cast("long"), "available")
    s = s.withColumn("base", F.coalesce(F.least(F.col("available"), F.greatest(F.lit(floor).cast("long"), F.floor(share))), F.lit(0).cast("long")))
    s = s.withColumns({"short": F.col("goal") - F.sum("base").over(every), "low": lowest})
    room = F.when(F.col("short") > 0, F.col("available") - F.col("base")).otherwise(F.col("base") - F.col("low"))
    room = F.least(room, F.abs("short"))
    seats = s.where("short <> 0").select("ord", "short", "base", "goal", "available", "total", F.explode(F.sequence(F.lit(0).cast("long"), room)).alias("j")).where("j > 0")
    at = F.when(F.col("short") > 0, F.col("base") + F.col("j") - 1).otherwise(F.col("base") - F.col("j") + 1)
    deficit = F.col("goal").cast("double") * F.col("available") / F.col("total") - at
    order = Window.orderBy(F.when(F.col("short") > 0, -deficit).otherwise(deficit), "ord")
    taken = seats.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.abs("short")).groupBy("ord").agg(F.count("*").alias("seats"))
    moved = F.coalesce("seats", F.lit(0)) * F.signum("short").cast("long")
    return s.join(taken, "ord", "left").select("ord", "intent", "available", (F.col("base") + moved).alias("quota"))


def split_decisions(quotas: DataFrame, share: float = V.AUTO_SHARE) -> DataFrame:
    """``ord, intent, quota, auto_picks, escalate_picks`` from ``ord, intent, quota, auto, escalate`` (what there is)."""
    every = Window.partitionBy(F.lit(0))
    lower = F.col("quota") - F.least("escalate", "quota")
    upper = F.least("auto", "quota")
    q = quotas.withColumns({"lower": lower, "upper": upper})
    wanted = F.floor(F.sum("quota").over(every) * share + 0.5)
    goal = F.greatest(F.sum("lower").over(every), F.least(wanted, F.sum("upper").over(every)))
    q = q.withColumn("rest", goal - F.sum("lower").over(every)).withColumn("room", F.col("upper") - F.col("lower"))
    before = F.coalesce(F.sum("room").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auto = F.col("lower") + F.least(F.col("room"), F.greatest(F.lit(0).cast("long"), F.col("rest") - before))
    return q.select("ord", "intent", "quota", auto.alias("auto_picks"), (F.col("quota") - auto).alias("escalate_picks"))


def plan_queue(hints: DataFrame, intents: DataFrame, target: int = V.GOLDEN_TARGET, floor: int = V.GOLDEN_FLOOR, share: float = V.AUTO_SHARE, seed: int = V.SEED, key: str = "interaction_id") -> DataFrame:
    """``queue_pos, key, hint_intent, hint_decision`` from hints ``key, intent, decision`` and intents ``ord, intent``."""
    counts = hints.groupBy("intent").agg(F.count("*").alias("available"), F.count_if(F.col("decision") == "auto").alias("auto"), F.count_if(F.col("decision") == "escalate").alias("escalate"))
    strata = intents.join(counts, "intent")
    quotas = apportion(strata.select("ord", "intent", "available"), target, floor)
    picks = split_decisions(quotas.join(strata.select("ord", "auto", "escalate"), "ord"), share)
    limits = picks.select("ord", "intent", F.explode(F.array(F.struct(F.lit("auto").alias("decision"), F.col("auto_picks").alias("n")), F.struct(F.lit("escalate").alias("decision"), F.col("escalate_picks").alias("n")))).alias("p"))
    limits = limits.select("ord", "intent", "p.decision", "p.n")
    ranked = hints.withColumn("_h", hash_rank(seed, F.col(key)))
    # No stratum gives more rows than there are seats: with a constant limit each task keeps that many before the shuffle.
    seats = max(target, floor * intents.count())
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("intent", "decision").orderBy("_h", key))).where(F.col("_r") <= seats)
    chosen = ranked.join(F.broadcast(limits), ["intent", "decision"]).where(F.col("_r") <= F.col("n"))  # one row per intent and decision
    chosen = chosen.withColumn("_p", F.row_number().over(Window.partitionBy("intent").orderBy("_h", key)))
    place = F.row_number().over(Window.orderBy("_p", "ord"))  # at most the target's rows
    return chosen.select(place.alias("queue_pos"), key, F.col("intent").alias("hint_intent"), F.col("decision").alias("hint_decision"))


def queue_join(queue: DataFrame, holdout: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Queued rows with their content, in queue order; every queued id must be there once."""
    from ..functions.contracts import gate, unique

    unique(queue, key, "queued ids")
    unique(holdout, key, "ids")
    gate(queue.join(holdout, key, "left_anti").select(key), "queued ids that are unknown", key)
    return queue.join(holdout, key).orderBy("queue_pos")


def golden_report(queue: DataFrame, golden: DataFrame, intents: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Per gold intent (zeros kept, in order): totals, decisions, notes and agreement with the hints."""
    g = golden.join(queue.select(key), key, "left_semi")
    each = g.groupBy(F.col("gold_intent").alias("intent")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("gold_decision") == "auto").alias("auto"),
        F.count_if(F.col("gold_decision") == "escalate").alias("escalate"),
        F.count_if(F.col("notes").rlike(r"\S")).alias("notes_filled"),
        F.count_if(F.col("gold_intent") == F.col("hint_intent")).alias("intent_agreed"),
        F.count_if(F.col("gold_decision") == F.col("hint_decision")).alias("decision_agreed"),
    )
    return intents.join(each, "intent", "left").fillna(0).orderBy("ord")


def remaining(queue: DataFrame, golden: DataFrame, key: str = "interaction_id") -> DataFrame:
    return queue.join(golden, key, "left_anti")


def label_session(
    items: list[dict], labeled: list[dict], intents: list[str], version: int, ask: Callable[[str], str], tell: Callable[[str], None], save: Callable[[list[dict]], None]
) -> list[dict]:
    """A resumable session over queue items (``interaction_id, message, transcript, hint_intent, hint_decision``).

    Labelled ids and blank openings are skipped; ``?`` lists intents, ``s`` skips, ``q``, end of input or an interrupt pauses.
    The whole set is saved, in queue order, after each label.
    """
    known = {i["interaction_id"] for i in items}
    if any(g["interaction_id"] not in known for g in labeled) or any(g["taxonomy_version"] != version for g in labeled):
        raise ValueError("the labelled set belongs to another queue or taxonomy version")
    done = {g["interaction_id"]: g for g in labeled}
    order = [i["interaction_id"] for i in items]

    def answer(question: str, allowed: list[str], default: str) -> str:
        while True:
            got = ask(f"{question} [{default}]: ").strip()
            if got == "?":
                tell(", ".join(allowed))
            elif got in ("s", "q"):
                return got
            elif (got or default) in allowed:
                return got or default
            else:
                tell(f"unknown: {got}")

    try:
        for item in items:
            if item["interaction_id"] in done or not item["message"].strip():
                continue
            tell(item["transcript"])
            intent = answer("intent", intents, item["hint_intent"])
            if intent == "q":
                break
            if intent == "s":
                continue
            decision = answer("decision", ["auto", "escalate"], item["hint_decision"])
            if decision == "q":
                break
            if decision == "s":
                continue
            notes = ask("notes: ").strip()
            done[item["interaction_id"]] = {
                "interaction_id": item["interaction_id"], "taxonomy_version": version, "customer_message": item["message"], "gold_intent": intent,
                "gold_decision": decision, "notes": notes, "hint_intent": item["hint_intent"], "hint_decision": item["hint_decision"],
            }
            save([done[k] for k in order if k in done])
    except (EOFError, KeyboardInterrupt):
        tell("paused")
    return [done[k] for k in order if k in done]


