import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadmill.functions import contracts
from threadmill.operators import labels, language, metrics, reconcile
from threadmill.plans import catalogue
from threadmill.streaming import verdicts


def test_hybrid_prefers_the_same_intent(spark):
    lexical = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0)], "asked_id long, doc_id long, score double")
    dense = spark.createDataFrame([(1, 10, 0.5, False), (1, 12, 1.0, True)], "asked_id long, doc_id long, score double, same_intent boolean")
    got = [(r.doc_id, round(r.score, 6)) for r in metrics.hybrid(lexical, dense, 0.5, 0.3).orderBy("rank").collect()]
    assert got == [(12, 0.8), (10, 0.75), (11, 0.25)]


def test_prompt_and_case(spark):
    df = spark.createDataFrame([(1, "resolved", [("customer", "hi"), ("brand", "yes"), ("brand", "more")])], "interaction_id long, label string, turns array<struct<side:string,text:string>>")
    intents = spark.createDataFrame([(1, "play")], "interaction_id long, intent string")
    assert tuple(metrics.case_format(df, intents).first()) == (1, "hi", "yes", "play", "resolved")
    said = df.select(metrics.grounded_prompt(F.lit("why?"), F.array(F.lit("a"), F.lit("b")))).first()[0]
    assert "[1] a\n[2] b" in said and "why?" in said


def test_decision_contract(spark):
    rows = [("a", "kept", "a", True), ("a", "kept", "b", False), ("a", "merged", "b", True), ("a", "merged", "a", False), ("a", "dropped", None, True), ("a", "dropped", "b", False), ("3", "promoted", "b", True), ("3", "promoted", None, False), ("a", "else", None, False)]
    df = spark.createDataFrame(rows, "subject string, decision string, final_intent string, ok boolean")
    assert all((r.e is None) == r.ok for r in df.select("ok", contracts.decision().alias("e")).collect())


def test_reports(spark):
    own = spark.createDataFrame([(i, "a" if i < 7 else "b", "human" if i == 6 else "labeler", "m%d" % i, "j") for i in range(8)], "interaction_id long, intent string, source string, customer_message string, justification string")
    intents = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "ord int, intent string")
    text = labels.review_report(own, intents, 3)
    assert text.index("## b (1)") < text.index("## a (7)") < text.index("## c (0)") and "… and 4 more" in text and text.index("- 6 [human]") < text.index("- 0 [labeler]")
    clusters = spark.createDataFrame([(0, 5, "a", "why", [("a", 0.5)], [(1, "msg", 0.25)])], "cluster_id long, size long, mapping string, justification string, candidates array<struct<intent_id:string,similarity:double>>, examples array<struct<interaction_id:long,message:string,similarity:double>>")
    seeds = spark.createDataFrame([(0, "a"), (1, "other")], "ord int, intent_id string")
    made = labels.discovery_markdown(reconcile.discovery_report(clusters, seeds), clusters)
    assert "| a | 1 | 5 |" in made and "| junk | 0 | 0 |" in made and "- 1 (0.250000): msg" in made


def test_detector(spark):
    taught = [("ENGLISH", "the cat and the dog were in the house with all of them"), ("SPANISH", "el perro y el gato estaban en la casa con todos ellos")]
    model = language.train(spark.createDataFrame(taught, "language string, text string"))
    rows = spark.createDataFrame([(1, "the dog and the cat"), (2, "el gato en la casa"), (3, "How?"), (4, "https://t.co/x @b"), (5, None), (6, "😀")], "interaction_id long, message string")
    got = {r.interaction_id: r.language for r in language.detect(rows, model).collect()}
    assert got[1] == "ENGLISH" and got[2] == "SPANISH" and got[4] is got[5] is got[6] is None
    kept = language.keep(spark.createDataFrame([(1, "ENGLISH"), (2, None), (3, "FRENCH")], "interaction_id long, language string"))
    assert sorted(r.interaction_id for r in kept.collect()) == [1, 2]


def test_profiles(spark):
    rows = spark.createDataFrame([("A", "Abc abc"), ("A", "a1é"), ("B", None), (None, "zzz"), ("C", "")], "language string, text string")
    got = {(r.language, r.gram): (r.n, round(r.share, 6)) for r in language.profiles(rows, size=3).collect()}
    assert got == {("A", " ab"): (2, 0.333333), ("A", "abc"): (2, 0.333333), ("A", "bc "): (2, 0.333333)}
    none = language.train(rows.limit(0))
    asked = rows.selectExpr("1L AS interaction_id", "'abc' AS message")
    assert {r.language for r in language.detect(asked, none).collect()} == {None} and language.scores(asked.limit(0), language.train(rows)).count() == 0


def test_profiles_cut_each_word_once(spark):
    rows = spark.createDataFrame([("A", "abc abc abc ab")] * 3, "language string, text string")
    made = language.profiles(rows)
    assert {r.gram: r.n for r in made.collect()} == {" ab": 12, "abc": 9, "bc ": 9, "ab ": 3}
    plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
    assert "word#" in plan  # words are counted before they are cut


def test_learned_detector_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    docs = catalogue._labelled(spark, sf)
    found = catalogue.lang_detect(spark, sf).withColumnRenamed("language", "said").withColumnRenamed("interaction_id", "doc_id")
    r = docs.where("held_out and language is not null").join(found, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.expr("said is not null")).alias("sure"), F.count_if(F.expr("said = language")).alias("right")).first()
    assert r.n > 100 and r.sure >= 0.98 * r.n and r.right >= 0.98 * r.n


def test_short_texts_have_no_signal(spark):
    """By what the documents teach: links, handles, signs and a word that two languages have say nothing."""
    taught = [("ENGLISH", "how are you all today was it"), ("GERMAN", "wie geht es dir heute how so"), ("FRENCH", "comment allez vous tous aujourd hui how")] * 20
    model = language.train(spark.createDataFrame(taught, "language string, text string"))
    rows = spark.createDataFrame(list(enumerate(["How?", "😭😭", "https://t.co/YxliFtc8p8", "@115888 @handle", None, "@115888 comment allez https://t.co/abc", "客服"])), "interaction_id long, message string")
    got = {r.interaction_id: r.language for r in language.detect(rows, model).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: None, 5: "FRENCH", 6: None}


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, 5), "click", 1.0) for h in (0, 0, 1)]
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = verdicts.windowed_counts(verdicts.read_stream(spark, str(tmp_path / "in"), schema))
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]


def test_agreement(spark):
    pairs = spark.createDataFrame([("a", "a")] * 4 + [("a", "b")] + [("b", "b")] * 3 + [("b", "a")] * 2, "judge string, human string")
    r = metrics.agreement(pairs).first()
    assert (r.n, round(r.agreement, 6), round(r.kappa, 6)) == (10, 0.7, 0.4)


def test_texts_are_scored_where_they_lie(spark):
    taught = [("FRENCH", "le chat est sur la table"), ("GERMAN", "die katze sitzt auf dem tisch"), ("GERMAN", "der hund")]
    model = language.train(spark.createDataFrame(taught, "language string, text string"))
    asked = [(1, "le Chat, le chat @x https://t.co/y"), (2, "hund"), (3, "12"), (4, None), (5, "z"), (2, "le")]
    made = language.scores(spark.createDataFrame(asked, "interaction_id long, message string").repartition(3), model)
    gain = {(r.language, r.gram): r.gain for r in model.grams.collect()}
    floor = {(r.language, r.n): r.floor for r in model.floors.collect()}

    def score(name, word):
        grams = [*word, *(f" {word} "[i : i + n] for n in range(2, 6) for i in range(len(word) + 3 - n))]
        return sum(floor[name, len(g)] + gain.get((name, g), 0.0) for g in grams) / 5

    words = {1: ["le", "chat", "le", "chat"], 2: ["hund", "le"], 5: ["z"]}
    want = {(i, name): sum(score(name, w) for w in said) for i, said in words.items() for name in ("FRENCH", "GERMAN")}
    got = {(r.interaction_id, r.language): r.score for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    plan = spark._jvm.PythonSQLUtils.explainString(made.select("*")._jdf.queryExecution(), "simple")
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1  # words do not meet the scores by a shuffle
