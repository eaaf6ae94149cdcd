import json

from threadmill import cli
from threadmill.sources.records import TWEET_COLUMNS


def lines(p):
    return [json.loads(x) for x in p.read_text().splitlines()]


def test_from_csv_to_retrieval(spark, tmp_path, capsys):
    csv = tmp_path / "t.csv"
    rows = []
    for k in range(6):
        a, b, c = 10 * k + 1, 10 * k + 2, 10 * k + 3
        at = f"Wed Nov 01 10:0{k}:0%d +0000 2017"
        rows += [f'{a},c{k},True,{at % 0},"@B my songs stop",,', f"{b},B,False,{at % 1},{'Drop us a DM' if k % 2 else 'Please reinstall'},,{a}", f"{c},c{k},True,{at % 2},{'Thank you' if k % 2 else 'That worked'},,{b}"]
    csv.write_text(",".join(TWEET_COLUMNS) + "\n" + "\n".join(rows) + "\n")
    f = lambda n: str(tmp_path / n)
    run = lambda *args: cli.main(list(args), spark, lambda: lambda p, s, t: ('{"label": "resolved", "justification": "ok"}', "m"))
    assert run("build-interactions", "--input", str(csv), "--output", f("i"), "--brand", "B") == 0
    assert [r["interaction_id"] for r in lines(tmp_path / "i")] == [1, 11, 21, 31, 41, 51]
    assert run("sample-split", "--input", f("i"), "--pool", f("pool"), "--holdout", f("hold"), "--sample-size", "4", "--holdout-size", "1") == 0
    assert len(lines(tmp_path / "pool")) == 3 and len(lines(tmp_path / "hold")) == 1
    assert run("sample-split", "--input", f("i"), "--pool", f("pool")) == 1
    assert run("label-closure", "--input", f("i"), "--output", f("c")) == 0
    assert run("adjudicate-closures", "--interactions", f("i"), "--labels", f("c"), "--output", f("final"), "--log", f("log")) == 0
    assert {r["source"] for r in lines(tmp_path / "final")} == {"heuristic", "labeler"}
    assert run("build-resolution-dataset", "--interactions", f("i"), "--labels", f("final"), "--output", f("d")) == 0
    assert run("build-minilm-index", "--input", f("d"), "--output", f("index")) == 0
    capsys.readouterr()
    assert run("retrieve-minilm", "--index", f("index"), "--query", "songs stop", "--top-k", "2") == 0
    assert [r["interaction_id"] for r in json.loads(capsys.readouterr().out)] == [1, 11]
    assert run("label-closure", "--input", f("missing"), "--output", f("x")) == 1
    assert run("label-closure", "--input", f("i"), "--output", f("i")) == 1 and len(lines(tmp_path / "i")) == 6
