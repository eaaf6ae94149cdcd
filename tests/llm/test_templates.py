"""Decontamination where documents and items have an opening in common: no pair is written for it."""

import random

from threadmill.llm import decontaminate
from threadmill.llm.scratch import Scratch


def test_a_shared_opening_brings_no_pairs(spark, monkeypatch):
    rng = random.Random(6)
    opening = "choose the one right answer"
    word = lambda: f"w{rng.randrange(100_000)}"
    items = [(i, opening + " " + " ".join(word() for _ in range(20))) for i in range(200)]
    docs = [(i, opening + " " + " ".join(word() for _ in range(40))) for i in range(300)]
    docs += [(1000, " ".join(word() for _ in range(9)) + " " + items[7][1]), (1001, items[8][1].replace("answer", "reply"))]
    written, put = {}, Scratch.put

    def counted(self, df, table):
        out = put(self, df, table)
        written[table] = out.count()
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1000, 7)}
    assert written["anchors"] < 500 and written["candidates"] < 10


def test_items_that_are_alike_are_all_found(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(1000)}" for _ in range(40)]
    items = [(i, " ".join([f"x{i}", *base])) for i in range(20)]
    docs = [(1, " ".join(["a", "b", *base, "c"])), (2, " ".join(base[:20]))]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, i) for i in range(20)}
