"""The pipeline's stages on rows with null and repeated ids."""

import random

import pytest

import corpus_pipeline

VOC = [f"{a}{b}" for a in ("ba", "lo", "mi", "re", "su", "ta") for b in ("nd", "rk", "st", "ll", "ve")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(VOC) for _ in range(n))
    top = tmp_path_factory.mktemp("keys")
    item = prose(30)
    texts = [prose(60) for _ in range(36)]
    held = [prose(40) + " " + item + " " + prose(40) for _ in range(2)]
    rows = [((None, 7, i)[i % 3], t) for i, t in enumerate(texts)] + [(None, held[0]), (7, held[1])]
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    frame.repartition(3).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    return str(top), rows, set(held)


def ran(spark, stage, top, docs):
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, top).collect()), key=str)


def test_different_texts_of_an_id_stay(spark, corpus):
    top, rows, _ = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet")
    assert ran(spark, corpus_pipeline.near_duplicates, top, docs.unionByName(docs)) == sorted(rows, key=str)


def test_only_the_contaminated_row_goes(spark, corpus):
    top, rows, held = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet")
    assert ran(spark, corpus_pipeline.decontaminated, top, docs) == sorted((r for r in rows if r[1] not in held), key=str)


def test_rows_are_mixed_one_by_one(spark, corpus):
    top, rows, _ = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet")
    assert ran(spark, corpus_pipeline.mixed, top, docs) == sorted(rows, key=str)  # one source: every row once


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontaminated", "mixed", "tokens"])
def test_empty_tables_and_odd_columns(spark, tmp_path, corpus, name):
    """No rows give no rows; further columns pass through under names that the stages use themselves."""
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, node long, unit long, root string, size int, score double, n int, copy string, `a.b` string, row_key string, `Row_Key_` int, row string, digest string, time int, doc int, `a b``c` int"
    stage = dict(corpus_pipeline.STAGES)[name]
    none = spark.createDataFrame([], kinds)
    assert stage(spark, none, str(tmp_path)).count() == 0
    if name == "tokens":
        rows = [(7, "one", None, None, None, 5, 6, "r", 7, 0.5, 8, "c", "d", "k", 1, "w", "g", 9, 10, 11)]
        assert [r.n_tokens for r in stage(spark, spark.createDataFrame(rows, kinds), str(tmp_path)).collect()] == [2]
    else:
        rows = [(i, t, None, s, None, 5, 6, "r", 7, 0.5, 8) for i, t, s in ((1, None, "a"), (2, "", "a"), (3, "one", None), (3, "one", None), (4, "two words", None))]
        rows = [(*r, "c", "d", f"k{k}", k, "w", "g", 9, 10, 11) for k, r in enumerate(rows)]
        out = stage(spark, spark.createDataFrame(rows, kinds), str(tmp_path))
        assert out.columns == none.columns
        got = sorted((r.doc_id, r.text, r.node, r.root) for r in out.collect())
        if name == "near_duplicates":
            assert [g[0] for g in got] == [1, 3, 4]
        elif name != "mixed":
            assert len(got) == 5
        assert all(g[2:] == (5, "r") for g in got)
        own = {r[14]: r for r in rows}
        assert all(tuple(r)[6:] == own[r["Row_Key_"]][6:] for r in out.collect())
