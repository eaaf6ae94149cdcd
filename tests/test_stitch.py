import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadmill.operators import forest, stitch
from threadmill.plans.staging import stage_table

SCHEMA = "tweet_id long, author_id string, inbound boolean, created_at timestamp, text string, parent_id long"


def tweets(spark, *rows):
    """Rows (id, author, parent, text); ``B`` is the brand."""
    at = datetime(2017, 11, 1, 10)
    return spark.createDataFrame([(i, a, a != "B", at + timedelta(minutes=i), t, p) for i, a, p, t in rows], SCHEMA)


def ids(df):
    return {r["interaction_id"]: [t["tweet_id"] for t in r["turns"]] for r in df.collect()}


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, "c", None, "@b hi"), (2, "B", 1, "x")], {1: [1, 2]}),
        ([(1, "c", None, "@b hi")], {}),
        ([(1, "c", None, "@b"), (2, "B", 1, ""), (3, "other", 2, ""), (4, "B", 3, "")], {1: [1, 2], 3: [3, 4]}),
        ([(1, "B", None, ""), (2, "c", 1, ""), (3, "B", 2, "")], {2: [2, 3]}),
        ([(1, "c", None, "@b"), (2, "c", 1, "no"), (3, "c", 2, "@b"), (4, "B", 3, "")], {1: [1, 2, 3, 4]}),
        ([(1, "c", 1, "@b"), (2, "B", 1, "")], {1: [1, 2]}),
        ([(1, "c", None, "@bHelp"), (2, "c", 9, "@b!"), (3, "B", 2, "")], {2: [2, 3]}),
    ],
)
def test_worked_examples(spark, rows, expected):
    assert ids(stitch.stitch(tweets(spark, *rows), "B")) == expected


def test_absorbed_and_report(spark):
    t = tweets(spark, (1, "c", None, "@b"), (2, "c", 1, "no mention"), (3, "c", 2, "@b"), (4, "B", 3, ""), (9, "d", None, "@b"))
    r = stitch.stitch_report(t, "B").first()
    assert (r.total_rows, r.seed_count, r.opening_count, r.absorbed_openings, r.interactions, r.unanswered_openings) == (5, 3, 3, 1, 1, 1)
    assert (r.turns_total, r.turns_customer, r.turns_brand) == (4, 3, 1)


def brute(rows, brand="B"):
    """Seeds climb and openings grow one reply at a time."""
    author, parent, text = ({r[0]: r[i] for r in rows} for i in (1, 2, 3))
    answered = {p for i, p in parent.items() if author[i] == brand}
    seeds = {i for i in author if author[i] != brand and ("@b" in text[i] or i in answered or author.get(parent[i]) == brand)}
    opening = {}
    for s in seeds:
        path, at, top = {s}, parent[s], s
        while at in author and at not in path and (author[at] == brand or author[at] == author[s] and at in seeds):
            top = at if author[at] != brand else top
            path.add(at)
            at = parent[at]
        opening[s] = top
    dyads = set()
    for o in set(opening.values()):
        reached, todo = {o}, [o]
        while todo:
            at = todo.pop()
            for c in author:
                if parent[c] == at and c not in reached and author[c] in (author[o], brand):
                    reached.add(c)
                    todo.append(c)
        dyads |= {(o, t) for t in reached}
    return opening, dyads


@pytest.mark.parametrize("seed", range(4))
def test_any_reply_graph(spark, seed):
    """Replies to any row, also later ones, so with cycles of all kinds."""
    rng = random.Random(seed)
    n = 60
    rows = [(i, rng.choice("BBBcccd"), rng.choice([None, i - 1, i - 1, i - 2, rng.randrange(1, n + 9)]) if i > 1 else None, rng.choice(["@b", ""])) for i in range(1, n)]
    frame = stage_table(tweets(spark, *rows), "tweets")
    opening, dyads = brute(rows)
    # The mention pattern asks for the handle of the brand, which is B here.
    assert {r.seed: r.opening for r in stitch.climb(frame, "B").collect()} == opening
    openings = spark.createDataFrame([(o,) for o in set(opening.values())], "opening long")
    got = [tuple(r) for r in stitch.grow(frame, openings, "B").select("opening", "tweet_id").collect()]
    assert len(got) == len(set(got)) and set(got) == dyads
    inner = {t for o, t in dyads if o != t and t in set(opening.values())}
    kept = {}
    for o, t in dyads:
        if o not in inner:
            kept.setdefault(o, set()).add(t)
    by = {r[0]: r[1] for r in rows}
    answered = {o: sorted(t) for o, t in kept.items() if any(by[x] == "B" for x in t)}
    assert ids(stitch.stitch(frame, "B")) == answered


def test_a_long_chain_takes_few_states(spark, monkeypatch):
    n, written = 10_000, []
    rows = [(i, "B" if i % 2 == 0 else "c", i - 1 if i > 1 else None, "") for i in range(1, n + 1)]
    frame = stage_table(tweets(spark, *rows).repartition(4), "tweets")
    for module in (stitch, forest):
        monkeypatch.setattr(module, "stage_table", lambda df, name, by=(): written.append(name) or stage_table(df, name, by))
    assert [(r.n, r.o) for r in stitch.climb(frame, "B").groupBy().agg(F.count("*").alias("n"), F.max("opening").alias("o")).collect()] == [(n // 2, 1)]
    assert len(written) <= 15


def test_parent_cycle_ends(spark):
    t = tweets(spark, (1, "c", 2, "@b"), (2, "c", 1, "@b"), (3, "B", 1, ""))
    made = [x for turns in ids(stitch.stitch(t, "B")).values() for x in turns]
    assert len(made) == len(set(made))
