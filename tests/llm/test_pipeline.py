"""The pipeline on a small corpus of documents whose fate is known."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(8)
    top = tmp_path_factory.mktemp("sf")
    voc = [f"{a}{b}" for a in ("ba", "lo", "mi", "re", "su", "ta") for b in ("nd", "rk", "st", "ll", "ve")]
    prose = lambda n: ". ".join(" ".join(rng.choice(voc) for _ in range(10)).capitalize() for _ in range(n // 10))
    item = prose(30)
    docs = [(i, prose(100) if i % 4 else prose(100).upper().replace(" ", "!! "), "s%d" % (i % 3)) for i in range(200)]
    whole = docs[1][1]
    docs += [(300, whole, "s0"), (301, whole.replace("band", "bend", 1), "s1"), (302, prose(50) + " " + item + " " + prose(50), "s2")]
    frame = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    return str(top)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert name == "tokens" or docs.columns == columns
    assert ids["quality"] == [i for i in range(200) if i % 4] + [300, 301, 302]
    assert ids["near_duplicates"] == [i for i in range(200) if i % 4] + [302]
    assert ids["decontaminated"] == [i for i in range(200) if i % 4]
    assert set(ids["mixed"]) <= set(ids["decontaminated"]) and abs(len(ids["mixed"]) - 150) <= 6
    assert ids["tokens"] == ids["mixed"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == ids["tokens"]
