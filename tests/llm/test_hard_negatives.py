"""Hard negatives against all pairs of Python integers."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, key string, score double, anchor string"


def rows_of(n=400, width=12, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.6) * 0.7**d for d in range(width)] for _ in range(4)]
    out = []
    for i in range(n):
        c = centres[i % 4]
        out.append((i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in c], rng.randrange(4)))
    out += [(50, out[50][1], out[50][2]), (7, out[7][1], 2), (3, out[3][1], out[3][2])]  # repeated rows, of ids and of vectors
    out += [(1000, None, 1), (1050, [0.1, None, 0.2], 1), (1100, [math.nan, 0.1], 1), (1150, [math.inf], 1), (1200, out[0][1], None), (1250, [0.5, 0.25], 1), (1300, [], 2), (1350, [1e30], 2)]
    return out + [(None, out[5][1], 1)]


def brute(rows, positives=5, negatives=3):
    whole = []
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(256 * x) for x in v]
            if sum(x * x for x in ints) < 2**62:
                whole.append((i, ints, label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, v, label) in enumerate(whole):
        if i is None or i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, m) for b, (j, w, m) in enumerate(whole) if b != a]
        for p in sorted([s for s in scored if s[2] == label], key=order)[:positives]:
            fits = sorted([s for s in scored if s[2] != label and 50 * p[0] <= 100 * s[0] <= 95 * p[0]], key=order)[:negatives]
            out += [(i, p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(fits)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [(1024, 10**6), (3, 50)])
def test_all_pairs(spark, blocks):
    rows = rows_of()
    frame = spark.createDataFrame([(*r, "k", 1.0, "a") for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(frame, F.col("id") % 50 == 0, anchors_a_block=blocks[0], rows_a_group=blocks[1])
    want = brute(rows)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want and len(want) > 60


def test_bound_never_drops_a_pair():
    rng = np.random.default_rng(2)
    for scale in (1, 1000, 2**20):
        v = (rng.normal(0, 1, (300, 24)) * 0.7 ** np.arange(24) * 256 * scale).astype(np.int32)
        turn, cuts = np.linalg.eigh(v.T.astype(float) @ v)[1][:, ::-1], [6, 12, 24]
        a, b = hard_negatives.Side(v[:40], turn, cuts), hard_negatives.Side(v, turn, cuts)
        exact = v[:40].astype(np.int64) @ v.T.astype(np.int64)
        least, most = np.quantile(exact, 0.8, axis=1).astype(np.int64), np.quantile(exact, 0.95, axis=1).astype(np.int64)
        i, j, score = hard_negatives.survivors(a, b, cuts, least, most, np.ones((40, 300), bool))
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, np.argwhere((exact >= least[:, None]) & (exact <= most[:, None])).tolist()))
        assert (score == exact[i, j]).all()


def test_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).collect() == []
    lone = spark.createDataFrame([(0, [1.0], 1, "k", 1.0, "a")], SCHEMA)
    assert hard_negatives.mine(lone, F.col("id") % 50 == 0).collect() == []


def test_query_is_its_sql(spark, tmp_path):
    rows = [(i, v, label) for i, v, label in rows_of(300) if v is None or (len(v) == 12 and i is not None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted([tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.ORACLE_SQL["op13_hard_negatives"]).fetchall()) and got
    changed = [(i, v, (label + 1) % 10 if label is not None and i % 7 == 0 else label) for i, v, label in rows]
    assert got == sorted(brute(changed))
