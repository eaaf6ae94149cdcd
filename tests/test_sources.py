import json
import zipfile

import pytest

from threadmill.functions.contracts import ContractError
from threadmill.sources import archive, config, records, sinks, taxonomy

HEAD = ",".join(records.TWEET_COLUMNS)


def test_archive_is_extracted_once(spark, tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x/t.csv", '﻿a,b\n1,"two\nlines"\n3,4\n')
    got = archive.read_source_archive(spark, z, tmp_path / "out")
    assert got.extracted and [(p.columns, p.rows) for p in got.files] == [(["a", "b"], 2)]
    assert not archive.read_source_archive(spark, z, tmp_path / "out").extracted
    (tmp_path / "out/x/t.csv").write_text("a,b\n1,2\n")
    assert archive.read_source_archive(spark, z, tmp_path / "out").extracted


def test_archive_refusals(spark, tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("../t.csv", "a\n1\n")
    with pytest.raises(archive.SourceError):
        archive.read_source_archive(spark, z, tmp_path / "out")
    (tmp_path / "own").mkdir()
    (tmp_path / "own/file").write_text("mine")
    with pytest.raises(archive.SourceError):
        archive.read_source_archive(spark, z, tmp_path / "own")
    (tmp_path / "bad.zip").write_text("no archive")
    with pytest.raises(archive.SourceError):
        archive.read_source_archive(spark, tmp_path / "bad.zip", tmp_path / "other")


def test_tweets(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(f'{HEAD}\n1,c,True,Wed Nov 01 10:00:00 +0000 2017,"a ""b""\nc",2,\n2,B,False,Wed Nov 01 10:01:00 +0000 2017,x,,1\n')
    rows = {r.tweet_id: r for r in records.read_tweets(spark, str(p)).collect()}
    assert rows[1].text == 'a "b"\nc' and rows[1].parent_id is None and rows[2].parent_id == 1 and rows[1].inbound
    for bad in ("1,c,yes,Wed Nov 01 10:00:00 +0000 2017,x,,", "x,c,True,Wed Nov 01 10:00:00 +0000 2017,x,,", "1,c,True,Wed Nov 01 10:00:00 +0100 2017,x,,"):
        p.write_text(f"{HEAD}\n{bad}\n")
        with pytest.raises(ContractError):
            records.read_tweets(spark, str(p)).count()
    p.write_text("a,b\n1,2\n")
    with pytest.raises(archive.SourceError):
        records.read_tweets(spark, str(p))


def test_records_round_trip_and_contracts(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    good = [{"interaction_id": 1, "label": "resolved", "reason": "r", "needs_adjudication": False}, {"interaction_id": 2, "label": None, "reason": "r", "needs_adjudication": True}]
    p.write_text("\n\n".join(map(json.dumps, good)) + "\n")
    df = records.read_records(spark, str(p), "closure_labels")
    assert df.count() == 2
    out = tmp_path / "o.jsonl"
    sinks.commit([(sinks.stage_json_lines(df, out, ["interaction_id"]), out)])
    assert [json.loads(x) for x in out.read_text().splitlines()] == good
    for change in ({"label": "maybe"}, {"needs_adjudication": True}, {"reason": " "}, {"interaction_id": True}, {"interaction_id": 1.0}):
        p.write_text(json.dumps(good[0] | change) + "\n")
        with pytest.raises(ContractError):
            records.read_records(spark, str(p), "closure_labels").count()
    p.write_text(json.dumps(good[0]) + "\n" + json.dumps(good[0]) + "\n")
    with pytest.raises(ContractError, match="duplicate"):
        records.read_records(spark, str(p), "closure_labels")


def test_log_tail(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    assert records.read_log(spark, str(p), "k long, v string", "k").count() == 0
    sinks.append_record(p, {"k": 1, "v": "a"})
    sinks.append_record(p, {"k": 1, "v": "b"})
    with p.open("a") as f:
        f.write('{"k": 2, "v"')
    assert [tuple(r) for r in records.read_log(spark, str(p), "k long, v string", "k").collect()] == [(1, "b")]
    sinks.append_record(p, {"k": 3, "v": "c"})
    assert sorted(r.k for r in records.read_log(spark, str(p), "k long, v string", "k").collect()) == [1, 3]
    p.write_text('broken\n{"k": 1, "v": "a"}\n')
    with pytest.raises(ContractError):
        records.read_log(spark, str(p), "k long, v string", "k")
    p.write_text('{"k": 1, "v": "a"}\n\n{"k": 1, "v": "b"}')  # complete, but without a line end
    assert [tuple(r) for r in records.read_log(spark, str(p), "k long, v string", "k").collect()] == [(1, "b")]
    sinks.append_record(p, {"k": 2, "v": "x" * 200_000})
    with p.open("a") as f:
        f.write('{"k": 9, "v": "' + "y" * 200_000)  # longer than a block of the tail
    sinks.append_record(p, {"k": 3, "v": "c"})
    assert [json.loads(x)["k"] for x in p.read_text().splitlines() if x] == [1, 1, 2, 3]
    p.write_text('{"k": 1, "v": "a"}\nbroken\n')  # a last line that ends is not partial
    with pytest.raises(ContractError, match="line 2"):
        records.read_log(spark, str(p), "k long, v string", "k")


def test_commit_rolls_back(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("old")

    def fail_second(temp, target):
        if target == b:
            raise OSError("disk")
        temp.replace(target)

    with pytest.raises(OSError):
        sinks.commit([(sinks.stage_text("new", a), a), (sinks.stage_text("new", b), b)], fail_second)
    assert a.read_text() == "old" and sorted(x.name for x in tmp_path.iterdir()) == ["a"]
    sinks.commit([(sinks.stage_text("new", a), a), (sinks.stage_text("new", b), b)])
    assert a.read_text() == b.read_text() == "new" and sorted(x.name for x in tmp_path.iterdir()) == ["a", "b"]
    with pytest.raises(sinks.SinkError):
        sinks.distinct_paths(a, tmp_path / "x/../a")


def test_a_failing_task_leaves_the_old_file(spark, tmp_path):
    out = tmp_path / "out.jsonl"
    out.write_text("old\n")
    rows = spark.range(50).selectExpr("id", "IF(id = 40, raise_error('broken row'), 'x') AS `a.b`")
    with pytest.raises(Exception, match="broken row"):
        sinks.commit([(sinks.stage_json_lines(rows, out, ["id"]), out)])
    assert out.read_text() == "old\n" and [x.name for x in tmp_path.iterdir()] == ["out.jsonl"]
    good = spark.range(50).repartition(7).selectExpr("50 - id AS id", "'x' AS `a.b`", "1 AS hidden")
    sinks.commit([(sinks.stage_json_lines(good, out, ["id"], ["hidden"]), out)])
    assert [json.loads(x) for x in out.read_text().splitlines()] == [{"id": i, "a.b": "x"} for i in range(1, 51)]
    sinks.commit([(sinks.stage_json_lines(good.limit(0), out), out)])
    assert out.read_text() == "" and [x.name for x in tmp_path.iterdir()] == ["out.jsonl"]


def test_outputs_in_a_store_that_only_spark_opens(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sinks.link./data", f"file://{tmp_path}")
    a, b = "viewfs://sinks/data/a.jsonl", "viewfs://sinks/data/b.md"
    sinks.commit([(sinks.stage_json_lines(spark.range(3), a, ["id"]), a), (sinks.stage_text("# é", b), b)])
    assert (tmp_path / "a.jsonl").read_text() == '{"id":0}\n{"id":1}\n{"id":2}\n' and (tmp_path / "b.md").read_text() == "# é"
    assert sinks.exists(a) and not sinks.exists(a + "x")

    def fail_second(temp, target):
        raise OSError("disk")

    with pytest.raises(OSError):
        sinks.commit([(sinks.stage_text("new", a), a)], fail_second)
    assert (tmp_path / "a.jsonl").read_text().startswith('{"id":0}')
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["a.jsonl", "b.md"]


def test_index(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "interaction_id long, vector array<double>")
    records.write_index(v, str(tmp_path / "i"), "m", 2, 0.1)
    docs, meta = records.read_index(spark, str(tmp_path / "i"))
    assert docs.count() == 2 and meta["embedding_dim"] == 2
    records.write_index(v, str(tmp_path / "j"), "m", 3, 0.1)
    with pytest.raises(ContractError):
        records.read_index(spark, str(tmp_path / "j"))


SEEDS = "| # | id | definition | note |\n|---|---|---|---|\n| 1 | `play` | cannot play | x |\n| 2 | `other` | rest | y |\n\n- `play`: it stopped\n- `other`: hello\n"


def final(n=7, version="**Version:** 1"):
    rows = "".join(f"| `i{k}` | d | seed | ex{k}; more{k} |\n" for k in range(n))
    return f"{version}\n\n| id | definition | origin | examples |\n|---|---|---|---|\n{rows}| `other` | rest | seed | hm |\n\n| seed | decision | final |\n|---|---|---|\n| i0 | kept | `i0` |\n".replace("| i0 |", "| `i0` |") + "\n| cluster | decision | final |\n|---|---|---|\n"


COLS = (["id", "definition", "origin", "examples"], ["seed", "decision", "final"], ["cluster", "decision", "final"])


def test_taxonomies(spark):
    assert [r.intent_id for r in taxonomy.seed_taxonomy(spark, SEEDS).orderBy("ord").collect()] == ["play", "other"]
    with pytest.raises(ContractError):
        taxonomy.seed_taxonomy(spark, SEEDS.replace("- `other`: hello\n", ""))
    got = taxonomy.final_taxonomy(spark, final(), *COLS)
    assert got["version"] == 1 and got["intents"].count() == 8 and got["theme_decisions"].count() == 0
    for bad in (final(3), final(version=""), final().replace("kept", "merged"), final().replace("hm", "ex1")):
        with pytest.raises(ContractError):
            taxonomy.final_taxonomy(spark, bad, *COLS)


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("roles:\n  embedder: e  # small\n  labeler: 'l'\n  generator: g\nprovider:\n  base_url: http://x\n")
    env = {"THREADMILL_CONFIG": str(p), "THREADMILL_LABELER_MODEL": "own", "THREADMILL_GENERATOR_MODEL": ""}
    assert config.load(env=env) == {"roles": {"embedder": "e", "labeler": "own", "generator": "g"}, "base_url": "http://x"}
    assert config.api_key(("A", "B"), {"A": "", "B": "k"}) == "k"
    p.write_text("roles:\n  embedder: e\n")
    with pytest.raises(config.ConfigError):
        config.load(env=env)
    p.write_text('roles:\n  embedder: "e # 1"\n  labeler: l\n  generator: g\nprovider: {base_url: "http://x"}\n')
    assert config.load(str(p), env={})["roles"]["embedder"] == "e # 1"
    p.write_text(json.dumps({"roles": dict.fromkeys(config.ROLES, "m"), "provider": {"base_url": "u"}}))
    assert config.load(str(p), env={})["base_url"] == "u"
    for bad in ("- a\n", "a: [\n", ""):
        p.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(p), env={})
