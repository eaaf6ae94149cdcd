import random

import pytest
from pyspark.sql import functions as F

from threadmill.functions import text
from threadmill.functions.contracts import ContractError
from threadmill.operators import discovery, golden, inference, labels, metrics, resolution, sampling, stitch, vectors
from threadmill.plans.staging import stage_table
from threadmill.streaming import verdicts


def one_seat_at_a_time(avail, target, floor):
    total = sum(avail)
    goal = min(target, total)
    q = [min(a, max(floor, goal * a // total)) for a in avail]
    while sum(q) < goal:
        i = max((i for i in range(len(q)) if q[i] < avail[i]), key=lambda i: (goal * avail[i] / total - q[i], -i))
        q[i] += 1
    while sum(q) > goal and any(q[i] > min(floor, avail[i]) for i in range(len(q))):
        i = min((i for i in range(len(q)) if q[i] > min(floor, avail[i])), key=lambda i: (goal * avail[i] / total - q[i], i))
        q[i] -= 1
    return q


def test_apportion_is_the_greedy_rule(spark):
    rng = random.Random(1)
    for _ in range(12):
        avail = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 7))]
        target, floor = rng.randrange(1, 80), rng.randrange(0, 12)
        df = spark.createDataFrame([(i, f"i{i}", a) for i, a in enumerate(avail)], "ord int, intent string, available long")
        assert [r.quota for r in golden.apportion(df, target, floor).orderBy("ord").collect()] == one_seat_at_a_time(avail, target, floor)


@pytest.mark.parametrize(
    "groups, target, floor, share, auto, escalate",
    [
        ({"A": (100, 0), "B": (0, 100)}, 30, 5, 0.5, 15, 15),
        ({"A": (5, 0), "B": (5, 0), "C": (5, 0)}, 6, 3, 0.6, 9, 0),
        ({"A": (20, 20), "B": (20, 20)}, 10, 0, 0.6, 6, 4),
        ({"A": (0, 20), "B": (0, 20)}, 10, 0, 0.6, 0, 10),
        ({"A": (100, 0), "B": (0, 100), "C": (2, 0)}, 30, 5, 0.5, 16, 14),
    ],
)
def test_plan(spark, groups, target, floor, share, auto, escalate):
    rows, k = [], 0
    for name, (a, e) in groups.items():
        for d, n in (("auto", a), ("escalate", e)):
            rows += [(k + i, name, d) for i in range(n)]
            k += n
    hints = spark.createDataFrame(rows, "interaction_id long, intent string, decision string")
    intents = spark.createDataFrame([(i, n) for i, n in enumerate(groups)], "ord int, intent string")
    queue = golden.plan_queue(hints, intents, target, floor, share).orderBy("queue_pos").collect()
    assert sum(r.hint_decision == "auto" for r in queue) == auto and sum(r.hint_decision == "escalate" for r in queue) == escalate
    firsts = [r.hint_intent for r in queue][: len({r.hint_intent for r in queue})]
    assert len(set(firsts)) == len(firsts)  # interleaved


def test_sample_is_prefix_stable(spark):
    df = spark.range(100).withColumnRenamed("id", "interaction_id")
    small = {r[0] for r in sampling.hash_sample(df, 20).collect()}
    assert small < {r[0] for r in sampling.hash_sample(df.repartition(7), 40).collect()}
    three = sampling.sample_split(df.limit(3), 4, 2)
    assert sorted(r.split for r in three.collect()) == ["holdout", "pool", "pool"]
    assert [r.split for r in sampling.sample_split(df.limit(1), 4, 2).collect()] == ["pool"]
    with pytest.raises(ValueError):
        sampling.sample_split(df, 4, 4)


def test_gates(spark):
    rows = spark.createDataFrame([(1,), (2,)], "interaction_id long")
    put = lambda *x: spark.createDataFrame([(i, "resolved") for i in x], "interaction_id long, label string")
    assert resolution.exact_join(rows, put(1, 2)).count() == 2
    for bad, word in ((put(1), "without"), (put(1, 2, 3), "unknown"), (put(1, 2, 2), "duplicate")):
        with pytest.raises(ContractError, match=word):
            resolution.exact_join(rows, bad)


def test_gates_are_observed_where_the_rows_are_written(spark, monkeypatch):
    def own_job(*args):
        raise AssertionError("a gate with a job of its own")

    monkeypatch.setattr(resolution.contracts, "gate", own_job)
    written = []
    monkeypatch.setattr(resolution, "stage_table", lambda df, name: written.append(name) or stage_table(df, name))
    rows = spark.createDataFrame([(i, i * 2, "x") for i in range(1, 9)], "interaction_id long, `a.b` int, note string")
    put = lambda *x: spark.createDataFrame([(i, y) for i, y in x], "interaction_id long, label string")
    rule = F.when(F.col("label") == "bad", "unknown label")
    got = resolution.exact_join(rows, put(*[(i, "resolved") for i in range(1, 9)]), rule=rule)
    assert got.columns == ["interaction_id", "a.b", "note", "label"] and sorted(tuple(r) for r in got.collect())[0] == (1, 2, "x", "resolved") and written == ["covered"]
    for labels, said in (
        ([(1, "bad"), (1, "bad")], r"2 labels that break their contract: 1"),
        ([(3, "resolved"), (3, "resolved"), (2, "resolved")], r"1 duplicate labels: 3"),
        ([(8, "resolved")], r"7 rows without a label: 1, 2, 3, 4, 5, …"),
        ([(i, "resolved") for i in range(1, 11)], r"2 labels of unknown rows: 9, 10"),
    ):
        with pytest.raises(ContractError, match=said):
            resolution.exact_join(rows, put(*labels), rule=rule)
    with pytest.raises(ContractError, match="duplicate rows: 1, 2"):
        resolution.exact_join(rows.unionByName(rows), put(*[(i, "resolved") for i in range(1, 9)]))


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "interaction_id long, vector array<double>")
    assert [r.interaction_id for r in vectors.topk(v, [2.0, 0.0], 2).collect()] == [1, 2]
    assert vectors.topk(v, [], 2).count() == 0
    with pytest.raises(ValueError):
        vectors.topk(v, [1.0, 0.0], 0)
    assert [r.vector for r in vectors.normalized(v).orderBy("interaction_id").collect()][2] == [0.0, 0.0]
    made = vectors.embed(spark.createDataFrame([(1, "hello there"), (2, None)], "interaction_id long, message string"), vectors.hashing_embedder(8))
    assert {len(r.vector) for r in made.collect()} == {8}
    with pytest.raises(ValueError):
        vectors.kmeans(v, 4)


def test_inference_caches_and_repairs(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def model(prompt, system, temperature):
            calls.add(1)
            return ('{"label": "resolved"}' if "not valid" in prompt or "easy" in prompt else "hm"), "m"

        return model

    valid = lambda r: None if r.startswith("{") else "no object"
    work = spark.createDataFrame([(1, "easy"), (2, "hard")], "interaction_id long, prompt string")
    log = f"file://{tmp_path}/log"
    assert inference.cached(work, log, make, "s", valid, workers=2).count() == 2
    assert calls.value == 3
    assert inference.cached(work, log, make, "s", valid, workers=2).count() == 2
    assert calls.value == 3
    with pytest.raises(ContractError):
        inference.cached(spark.createDataFrame([(3, "x")], work.schema), log, lambda: lambda *a: ("hm", "m"), "s", valid)


def test_a_run_that_dies_keeps_its_verdicts(spark, tmp_path):
    """Every row is sent once over both runs, but for the wave in which the first one died."""
    calls = spark.sparkContext.accumulator(0)
    work = spark.range(60).select(F.col("id").alias("interaction_id"), F.col("id").cast("string").alias("prompt"))
    log, flag = f"file://{tmp_path}/log", tmp_path / "broken"
    flag.touch()
    path = str(flag)
    fourth = str(work.where(F.pmod(F.xxhash64("interaction_id", F.lit(7)), F.lit(6)) == 3).first()[0])  # of six waves

    def make():
        import os

        def model(prompt, system, temperature):
            if os.path.exists(path) and prompt == fourth:
                raise ValueError("the worker is lost")
            calls.add(1)
            return "{}", "m"

        return model

    with pytest.raises(Exception, match="lost"):
        inference.cached(work, log, make, "s", lambda r: None, wave=10, workers=2).count()
    kept = spark.read.parquet(log).count()
    assert kept > 10
    flag.unlink()
    before = calls.value
    assert inference.cached(work, log, make, "s", lambda r: None, wave=10, workers=2).count() == 60
    assert calls.value - before == 60 - kept


def test_verdicts_that_no_longer_hold(spark, tmp_path):
    work = spark.createDataFrame([(1, "a"), (2, "b")], "interaction_id long, prompt string")
    log = f"file://{tmp_path}/log"
    says = lambda what: lambda: lambda *a: (f'{{"intent": "{what}"}}', "m")
    named = lambda *names: F.get_json_object("reply", "$.intent").isin(*names)
    assert inference.cached(work, log, says("old"), "s", lambda r: None, current=named("old")).count() == 2
    with pytest.raises(ContractError, match="no longer hold"):
        inference.cached(work, log, says("new"), "s", lambda r: None, current=named("new"))
    got = inference.cached(work, log, says("new"), "s", lambda r: None, current=named("new"), stale="redo")
    assert {r.reply for r in got.collect()} == {'{"intent": "new"}'}


def test_errors_are_named(spark, tmp_path):
    work = spark.createDataFrame([(7, "a")], "interaction_id long, prompt string")

    def make():
        def model(*_):
            raise inference.InferenceError("no such model", 404)

        return model

    with pytest.raises(ContractError, match="7: call failed: no such model"):
        inference.cached(work, f"file://{tmp_path}/log", make, "s", lambda r: None)


def test_hint_replies_need_a_decision():
    valid_reply = inference.valid_reply

    check = valid_reply("intent", ["x"], decision=("auto", "escalate"))
    assert check('{"intent": "x", "decision": "maybe", "justification": "y"}') == "unknown decision"
    assert check('{"intent": "x", "decision": "auto", "justification": "y"}') is None


def test_grow_and_climb_over_cycles_and_long_chains(spark):
    """A chain longer than several rounds of hops, and two rows that answer each other."""
    who = lambda i: "brand" if i % 2 else "cust"
    rows = [(i, who(i), i % 2 == 0, "@brand hi", i - 1 if i else None) for i in range(40)] + [(100, "cust", True, "@brand", 101), (101, "cust", True, "@brand", 100)]
    t = spark.createDataFrame(rows, "tweet_id long, author_id string, inbound boolean, text string, parent_id long").withColumn("created_at", F.col("tweet_id"))
    climbed = {r.seed: r.opening for r in stitch.climb(t, "brand").collect()}
    assert climbed == {**{i: 0 for i in range(0, 40, 2)}, 100: 101, 101: 100}
    grown = stitch.grow(t, spark.createDataFrame([(0,), (100,)], "opening long"), "brand")
    assert sorted(tuple(r) for r in grown.collect()) == [(0, i) for i in range(40)] + [(100, 100), (100, 101)]


def test_backoff():
    slept, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise inference.InferenceError("busy", 429)
        return "ok", "m"

    assert inference.with_backoff(call, sleep=slept.append, jitter=lambda: 1.0) == ("ok", "m") and slept == [2.0, 4.0]
    with pytest.raises(inference.InferenceError):
        inference.with_backoff(lambda: (_ for _ in ()).throw(inference.InferenceError("no", 400)), sleep=slept.append)


def test_discovery(spark, tmp_path):
    messages = spark.createDataFrame([(i, "song stops playing" if i % 2 else "card was charged twice") for i in range(20)], "interaction_id long, message string")
    anchors = spark.createDataFrame([("playback", "song stops"), ("playback", "playing a song"), ("billing", "card charged"), ("billing", "charged twice")], "intent_id string, message string")
    seeds = spark.createDataFrame([(0, "playback", "Music does not play."), (1, "billing", "A wrong charge."), (2, "other", "Rest.")], "ord int, intent_id string, definition string")
    make = lambda: lambda p, s, t: ('Here:\n```json\n{"mapping": "%s", "justification": "as said"}\n```' % ("billing" if "charged" in p.split("Candidates")[0].split("nearest")[1] else "playback"), "m")
    got = discovery.discover(messages, anchors, seeds, vectors.hashing_embedder(32), make, f"file://{tmp_path}/log", k=2, restarts=2).collect()
    assert sorted((r.mapping, r["size"]) for r in got) == [("billing", 10), ("playback", 10)]
    assert all(r.candidates[0].intent_id == r.mapping and len(r.examples) == 8 for r in got)


def test_cluster_prompt(spark):
    row = spark.createDataFrame([(7, [(1, "it stopped", 0.5), (2, "no sound", 0.4)], [("playback", 0.25)])], "size long, examples array<struct<interaction_id:long,message:string,similarity:double>>, candidates array<struct<intent_id:string,similarity:double>>")
    said = row.select(inference.cluster_prompt(F.col("size"), F.col("examples"), F.col("candidates"), "- playback: Music does not play.", "- a fault is no wish")).first()[0]
    for part in ("- playback: Music does not play.", "- a fault is no wish", "7 messages; the 2 nearest", "- it stopped\n- no sound", "playback 0.250000", "junk", "new"):
        assert part in said


def test_fenced_and_wrapped_replies():
    check = inference.valid_reply("mapping", ["a", "junk"])
    good = '{"mapping": "a", "justification": "x"}'
    for reply in (good, f"```json\n{good}\n```", f"```\n{good}\n```", f"Sure: {good} - done", f"```JSON {good}```"):
        assert check(reply) is None
    assert [check(r) for r in ("", "[1]", "{broken", '{"mapping": "b", "justification": "x"}', '{"mapping": "a", "justification": 3}', '{"mapping": "a"}')] == ["no JSON object"] * 3 + ["unknown mapping", "no justification", "no justification"]


def test_reply_and_json(spark):
    rows = [('{"a": 1}',), ('```json\n{"a": 1}\n```',), ('so: {"a": 1} ok',), ("[1]",), ("none",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "r string").select(text.json_object(F.col("r"))).collect()]
    assert got == ['{"a": 1}'] * 3 + [None] * 3
    r = spark.createDataFrame([('{"l": "x", "justification": " a \\n b "}',), ('{"l": "z", "justification": "a"}',), ("hm",)], "r string")
    got = [x[0] for x in r.select(inference.reply_fields(F.col("r"), "l", ["x"])).collect()]
    assert [(g.value, g.text, g.error) for g in got] == [("x", "a b", None), ("z", "a", "unknown l"), (None, None, "no JSON object")]


def test_corrections_gate(spark):
    own = spark.createDataFrame([(1, "a", "j", "labeler", "m")], "interaction_id long, intent string, justification string, source string, model string")
    fix = spark.createDataFrame([(2, "a", "j")], "interaction_id long, intent string, justification string")
    with pytest.raises(ContractError):
        labels.overlay(own, fix)
    with pytest.raises(ContractError):
        labels.overlay(own, fix.withColumn("interaction_id", F.lit(1).cast("long")), ["b"])


def test_session_resumes():
    items = [{"interaction_id": i, "message": m, "transcript": m, "hint_intent": "a", "hint_decision": "auto"} for i, m in ((1, "x"), (2, " "), (3, "y"), (4, "z"))]
    answers = iter(["", "", "note", "?", "b", "escalate", "", "q"])
    saved = []
    got = golden.label_session(items, [], ["a", "b"], 1, lambda _: next(answers), lambda _: None, saved.append)
    assert [(g["interaction_id"], g["gold_intent"], g["gold_decision"]) for g in got] == [(1, "a", "auto"), (3, "b", "escalate")] and len(saved) == 2
    with pytest.raises(ValueError):
        golden.label_session(items, got, ["a", "b"], 2, input, print, saved.append)


def test_baselines(spark):
    train = spark.createDataFrame([("song stops", "play"), ("song skips", "play"), ("card charged", "bill"), ("card refund", "bill"), ("song", "play")], "message string, intent string")
    assert metrics.majority(train).first().intent == "play"
    got = metrics.tfidf_baseline(train, features=256).transform(train).select("prediction", "_y").collect()
    assert all(r.prediction == r._y for r in got)


def test_baseline_cuts_texts_once(spark):
    times = spark.sparkContext.accumulator(0)

    def said(text):
        times.add(1)
        return text

    train = spark.createDataFrame([(f"song {i}", "play") for i in range(8)] + [(f"card {i}", "bill") for i in range(8)], "message string, intent string")
    model = metrics.tfidf_baseline(train.withColumn("message", F.udf(said, "string")("message")), features=64)
    assert times.value == 16
    assert all(r.prediction == r._y for r in model.transform(train).select("prediction", "_y").collect())


def test_stream_keeps_latest(spark, tmp_path):
    schema = "k long, v string, seq long"
    for rows in [[(1, "a", 1), (2, "b", 2)], [(1, "c", 3)], [(2, "old", 0), (3, "d", 4)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for every in (50, 2):
        out = str(tmp_path / f"out{every}")
        q = verdicts.keep_latest(verdicts.read_stream(spark, str(tmp_path / "in"), schema, 1), "k", "seq", out, str(tmp_path / f"cp{every}"), every)
        q.awaitTermination(60)
        assert q.exception() is None
        assert sorted(tuple(r)[:2] for r in verdicts.current(spark, out, schema, "k", "seq").collect()) == [(1, "c"), (2, "b"), (3, "d")]
        assert sorted(p.name for p in (tmp_path / f"out{every}").iterdir()) == (["part-0", "part-1", "part-2"] if every == 50 else ["all-1", "part-2"])
    assert verdicts.current(spark, str(tmp_path / "none"), schema, "k", "seq").count() == 0
