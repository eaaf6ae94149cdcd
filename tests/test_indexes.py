"""The lexical and the vector index, and hybrid ranking over both, against scores of all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from threadmill.functions.contracts import ContractError
from threadmill.operators import hybrid, kmeans, lexical, vector_index, vectors

VOC = [f"w{i}" for i in range(300)]


def texts(n, seed=1):
    rng = random.Random(seed)
    weight = [1 / (1 + i) for i in range(len(VOC))]
    out = [(i, " ".join(rng.choices(VOC, weight, k=rng.choice([3, 8, 20, 60])))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "W7 w7, w9!"), (n + 4, "W7 w7, w9!")]


def bm25(rows, asked, k):
    docs = {i: Counter((t or "").lower().replace(",", " ").replace("!", " ").replace(".", " ").split()) for i, t in rows}
    length = {i: sum(c.values()) for i, c in docs.items()}
    mean, df = sum(length.values()) / len(docs), Counter(t for c in docs.values() for t in c)
    out = {}
    for q, t in asked:
        score = {}
        for term in set((t or "").lower().split()) & set(df):
            idf = math.log(1 + (len(docs) - df[term] + 0.5) / (df[term] + 0.5))
            for i, c in docs.items():
                if term in c:
                    score[i] = score.get(i, 0) + idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * length[i] / mean))
        out[q] = sorted(((round(-s, 9), i) for i, s in score.items()))[:k]
    return out


@pytest.fixture(scope="module")
def corpus():
    return texts(900)


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lexical"))
    lexical.build(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3), folder, documents=16)
    return lexical.opened(spark, folder)


def batch(seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.sample(VOC, rng.choice([1, 2, 5])))) for i in range(12)] + [(50, "w7 w9"), (51, "unknown"), (52, None), (53, " ".join(VOC[:40]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_over_one_lexical_index(spark, corpus, index, seed):
    asked = batch(seed)
    got = {}
    for r in lexical.topk(index, spark.createDataFrame(asked, "asked_id long, text string"), 4).collect():
        got.setdefault(r.asked_id, []).append((round(-r.score, 9), r.doc_id))
    want = {q: v for q, v in bm25(corpus, asked, 4).items() if v}
    assert {q: sorted(v) for q, v in got.items()} == want


def test_blocks_are_skipped(spark, index):
    asked = spark.createDataFrame(batch(1), "asked_id long, text string")
    terms = lexical.weighted(index, asked)
    read = lexical.searched(index, terms, 3)[1]
    assert 0 < read.distinct().count() == read.count() < 0.6 * lexical.bounds(index, terms).count()


def test_lexical_edges(spark, tmp_path):
    none = lexical.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert lexical.topk(none, spark.createDataFrame([(1, "a")], "asked_id long, text string")).collect() == []
    with pytest.raises(ContractError):
        lexical.build(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string"), str(tmp_path / "twice"))


def clustered(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, dim))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.15, dim)).tolist()) for i in range(n)]
    return rows + [(n, [0.0] * dim), (n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 3, [2 * x for x in rows[3][1]])]


@pytest.fixture(scope="module")
def points():
    return clustered(1200)


@pytest.fixture(scope="module")
def parts(spark, points, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("vectors"))
    vector_index.build(spark.createDataFrame(points, "interaction_id long, vector array<double>").repartition(3), folder, "m", rows_a_part=40)
    return vector_index.opened(spark, folder, "m")


def test_vector_index_is_exact_and_skips(spark, points, parts):
    rows = spark.createDataFrame(points, "interaction_id long, vector array<double>")
    asked = rows.where("interaction_id % 40 = 3 or interaction_id >= 1200").withColumnRenamed("interaction_id", "asked_id")
    found, read = vector_index.searched(parts, asked, 4)
    plain = vectors.topk_batch(vectors.normalized(rows), vectors.normalized(asked), 4)
    key = lambda df: sorted((r.asked_id, r["rank"], r.interaction_id, r.score) for r in df.collect())
    assert key(found) == key(plain)  # the very same scores, ties by id
    every = vector_index.bounds(parts, vectors.normalized(asked))
    assert read.count() == read.distinct().count() < 0.5 * every.count()
    best = {(r.asked_id, r.part): r.bound for r in every.collect()}
    at = {r.interaction_id: r.part for r in parts.rows().collect()}
    v = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x in points}
    assert all(best[q, at[i]] >= v[q] @ v[i] - 1e-12 for q in (3, 43, 1200) for i in v)


def test_vector_index_edges(spark, parts, tmp_path):
    with pytest.raises(ContractError):
        vector_index.opened(spark, parts.folder, "another")
    with pytest.raises(ContractError):
        vector_index.topk(parts, spark.createDataFrame([(1, [1.0])], "asked_id long, vector array<double>"))
    none = vector_index.build(spark.createDataFrame([], "interaction_id long, vector array<double>"), str(tmp_path / "none"), "m")
    assert vector_index.topk(none, spark.createDataFrame([], "asked_id long, vector array<double>")).collect() == []


def test_equal_vectors_fill_many_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE", 10)
    rows = spark.createDataFrame([(i, [1.0, float(i > 90)]) for i in range(100)], "interaction_id long, vector array<double>")
    index = vector_index.build(rows, str(tmp_path / "v"), "m", rows_a_part=50)
    assert index.rows().select("part", "slice").distinct().count() >= 9
    got = vector_index.topk(index, spark.createDataFrame([(0, [3.0, 0.0])], "asked_id long, vector array<double>"), 3).collect()
    assert [(r.interaction_id, r["rank"]) for r in got] == [(0, 1), (1, 2), (2, 3)]


def test_hybrid_reads_as_deep_as_it_must(spark, corpus, index, points, parts):
    rng = random.Random(5)
    label = {i: rng.choice("ab") for i in range(1210)}
    near = dict(points)
    asked = [(i, " ".join(rng.sample(VOC, 3)), near[i * 7], rng.choice("ab")) for i in range(10)] + [(20, "unknown", near[5], None), (21, "w7", [0.0] * 16, "a")]
    frame = spark.createDataFrame(asked, "asked_id long, text string, vector array<double>, intent string")
    found, depth = hybrid.topk(index, parts, frame, spark.createDataFrame(list(label.items()), "doc_id long, intent string"), k=3, depth=4)
    words = bm25(corpus, [a[:2] for a in asked], 10**6)
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    got = {}
    for r in found.collect():
        got.setdefault(r.asked_id, []).append((round(-r.score, 8), r.doc_id))
    for q, _, vector, intent in asked:
        lex = {i: -s for s, i in words[q]}
        dense = {i: float(unit(vector) @ unit(v)) for i, v in points}
        lb, db = max(lex.values(), default=0), max(dense.values())
        score = {i: 0.5 * (lex.get(i, 0) / lb if lb > 0 else 0) + 0.5 * (dense.get(i, 0) / db if db > 0 else 0) + 0.1 * (label.get(i) == intent) for i in {*lex, *dense}}
        want = sorted((round(-s, 8), i) for i, s in score.items())[:3]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want] and all(abs(a[0] - b[0]) < 1e-7 for a, b in zip(sorted(got[q]), want, strict=True))
    assert depth >= 4


def test_all_restarts_in_one_pass(spark, points):
    rows = spark.createDataFrame(points[:1200], "interaction_id long, vector array<double>").repartition(3)
    fitted = kmeans.fit(rows, 9, 42, 10, "interaction_id")
    assert fitted.centres.shape == (10, 9, 16) and fitted.rounds <= kmeans.ROUNDS
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("vector").alias("features"))
    theirs = min(KMeans(k=9, seed=42 + i, maxIter=50).fit(data).summary.trainingCost for i in range(10))
    assert fitted.cost.min() <= theirs * (1 + 1e-6)
    out = vectors.kmeans(rows, 9).join(rows, "interaction_id").collect()
    by = {}
    for r in out:
        by.setdefault(r.cluster_id, set()).add(r.interaction_id % 9)
    assert len(by) == 9 and all(len(v) == 1 for v in by.values())  # the clusters that the points were made in
    assert [r.cluster_id for r in vectors.kmeans(rows.limit(3), 1).collect()] == [0, 0, 0]


@pytest.fixture
def split(spark):
    """Files are read in pieces smaller than their row groups, so that most tasks have no rows."""
    names = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def unit_rows(spark, n=300, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(n)], "interaction_id long, vector array<double>").coalesce(1)


def test_kmeans_where_tasks_have_no_rows(spark, split):
    assert vectors.kmeans(unit_rows(spark), 4).select("cluster_id").distinct().count() == 4


def test_vector_index_where_tasks_have_no_rows(spark, split, tmp_path):
    rows = unit_rows(spark)
    index = vector_index.build(rows, str(tmp_path), "m", rows_a_part=32)
    got = vector_index.topk(index, rows.where("interaction_id < 3").withColumnRenamed("interaction_id", "asked_id"), 2)
    assert sorted((r.asked_id, r.interaction_id) for r in got.where("rank = 1").collect()) == [(i, i) for i in range(3)]
    assert got.count() == 6


def test_hybrid_where_tasks_have_no_rows(spark, split, tmp_path):
    rows, docs = unit_rows(spark), texts(290)
    words = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "words"), documents=16)
    index = vector_index.build(rows, str(tmp_path / "vectors"), "m", rows_a_part=32)
    asked = rows.where("interaction_id < 3").selectExpr("interaction_id AS asked_id", "'w7 w9' AS text", "vector", "1 AS intent")
    out = hybrid.topk(words, index, asked, rows.selectExpr("interaction_id AS doc_id", "1 AS intent"), 2)[0]
    assert out.count() == 6


def test_topk_batch_by_chunks_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(90)]  # many equal scores
    odd = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [2.0, 1.0]), (93, [0.0] * 5), (94, [float("nan")] + [0.0] * 4), (95, rows[0][1])]
    asked = [(i, v) for i, v in rows[:20]] + [(i, v) for i, v in odd]
    score = lambda a, b: None if a is None or b is None or len(a) != len(b) or None in a + b else sum(x * y for x, y in zip(a, b, strict=True))
    want = []
    for i, q in asked:
        each = [(score(v, q), j) for j, v in rows + odd]
        each = sorted(each, key=lambda x: (x[0] is None, -(math.inf if x[0] is None or math.isnan(x[0]) else x[0]), x[1]))[:4]
        want += [(i, j, rank + 1, None if s is None or math.isnan(s) else s) for rank, (s, j) in enumerate(each)]
    frame = lambda x, c: spark.createDataFrame(x, f"{c} long, vector array<double>").repartition(3)
    out = vectors.topk_batch(frame(rows + odd, "interaction_id"), frame(asked, "asked_id"), 4)
    got = [(r.asked_id, r.interaction_id, r.rank, None if r.score is None or math.isnan(r.score) else r.score) for r in out.collect()]
    assert sorted(got, key=lambda x: x[:3]) == sorted(want, key=lambda x: x[:3])
    assert "NestedLoop" not in spark._jvm.PythonSQLUtils.explainString(vectors.topk_batch(frame(rows, "interaction_id"), frame(rows, "asked_id"), 4)._jdf.queryExecution(), "simple")


def test_scored_ranges_hand_on_their_best(spark, index, corpus):
    asked = spark.createDataFrame([(i, "w1 w2 w7") for i in range(40)], "asked_id long, text string")
    terms = lexical.weighted(index, asked)
    pairs = lexical.bounds(index, terms).select("asked_id", "range")
    made = lexical._scored(index, terms, pairs, 2)
    assert made.count() <= 3 * pairs.count()  # not every document of a range, for each entry
    want = bm25(corpus, [(0, "w1 w2 w7")], 5)[0]
    some = spark.createDataFrame([(q, d) for q in (3, 4) for _, d in want] + [(5, -1)], "asked_id long, doc_id long")
    got = sorted((r.asked_id, round(-r.score, 9), r.doc_id) for r in lexical.scores_of(index, terms, some).collect())
    assert got == sorted((q, s, d) for q in (3, 4) for s, d in want)


def test_slots_of_entries_find_the_same(spark, index, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "SLOT", 3)
    asked = batch(4)
    got = {}
    for r in lexical.topk(index, spark.createDataFrame(asked, "asked_id long, text string"), 3).collect():
        got.setdefault(r.asked_id, []).append((round(-r.score, 9), r.doc_id))
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in bm25(corpus, asked, 3).items() if v}
