"""The quality fit learns from one row of each labelled id."""

from pyspark.sql import functions as F

from threadmill.llm import quality_fm


def test_one_row_of_an_id_is_learnt(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(quality_fm, "fit", lambda labels, rows: learnt.append((labels.tolist(), [r[2].tobytes() for r in rows])))
    rows = [(1, f"text of row {i} " * (i % 7 + 1), 20) for i in range(400)] + [(i, f"other text {i}", None) for i in range(2, 10)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, label int")
    for order in (1, -1):
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string, n_chars long").repartition(3)
        quality_fm.train(docs, labels, F.lit(True), sample=9)
    assert len(learnt[0][0]) == 9 and sum(learnt[0][0]) == 5
    assert learnt[0] == learnt[1]


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(quality_fm, "fit", lambda labels, rows: learnt.append([r[0].nbytes + r[1].nbytes + r[2].nbytes for r in rows]))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(300)), 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    quality_fm.train(docs, labels, F.lit(True))
    quality_fm.train(docs, labels, F.lit(True), sample_bytes=20_000)
    assert len(learnt[0]) == 40 and 0 < len(learnt[1]) < 10 and sum(learnt[1]) <= 20_000
