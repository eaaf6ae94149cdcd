"""What the pipeline's stages ask of the driver."""

import random

import public_tokenizers

import corpus_pipeline
from threadmill.llm import decontaminate, pretokens, rans_tokens
from threadmill.llm.components import connected_components
from threadmill.llm.scratch import Scratch


def test_driver_opens_no_tokenizer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pretokens, "_OPEN", {})
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "more of them")], "doc_id long, text string")
    rans_tokens.write_tokens(docs, f"file://{tmp_path}/corpus", public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    got = {r.doc_id: r.n_tokens for r in rans_tokens.read_tokens(spark, f"file://{tmp_path}/corpus").collect()}
    assert set(got) == {1, 2, 3} and got[2] == 1
    assert not pretokens._OPEN


def test_rounds_end_with_stars(spark):
    class Counted(Scratch):
        def put(self, df, table):
            written.append(table)
            return super().put(df, table)

    for links, most, want in (([(2, 1), (3, 1), (5, 9)], 5, {1: 1, 2: 1, 3: 1, 5: 5, 9: 5}), ([], 5, {}), ([(k, k + 1) for k in range(40)], 29, {k: 0 for k in range(41)})):
        written: list[str] = []
        made = connected_components(spark.createDataFrame(links, "a long, b long"), Counted(spark, "stars"))
        assert {r.node: r.root for r in made.collect()} == want
        assert len(written) <= most


def _corpus(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    items = [(k, prose(30)) for k in range(6)] + [(7, "two words"), (8, None)]
    held = [(100 + k, f"{prose(20)} {text} {prose(20)}") for k, text in items[:3]]
    docs = [*held, *held[:1], (110, items[3][1] + " " + items[4][1]), (111, "here are two words more"), (112, None), (113, items[5][1].rsplit(" ", 12)[0])]
    docs += [(k, prose(60)) for k in range(20)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_contaminated_ids(spark):
    docs, items = _corpus(spark)
    scratch = Scratch(spark, "ids")
    whole = {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}
    ids = decontaminate.contaminated_ids(docs, items, "doc_id", scratch)
    assert sorted(r.doc_id for r in ids.collect()) == sorted([100, *whole]) and whole == {100, 101, 102, 110, 111}
    assert decontaminate.contaminated_ids(docs, items.where("item_id = 8"), "doc_id", Scratch(spark, "ids")).count() == 0


def test_decontaminated_plans(spark, tmp_path, monkeypatch):
    """The rows that go are found by a semi-join: windows are not laid again in the last plan."""
    docs, items = _corpus(spark)
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    plans = {}
    put = Scratch.put

    def noted(self, df, table):
        plans[table] = df._jdf.queryExecution().optimizedPlan().toString()
        return put(self, df, table)

    monkeypatch.setattr(Scratch, "put", noted)
    stay = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert {r.doc_id for r in stay.collect()} == {*range(20), 112, 113}
    assert "Aggregate" not in plans["found"] and "Generate" not in plans["found"]
