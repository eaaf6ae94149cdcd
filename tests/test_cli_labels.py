"""The commands that label: language, hints, sessions, development labels, reconciliation and discovery."""

import json
import zipfile

import pytest

from threadmill import cli

INTENTS = ["a_one", "b_two", "c_three", "d_four", "e_five", "f_six", "g_seven", "other"]
TEXTS = ["my songs stop and the player is gone", "where is the bill that you sent to me", "the app will not let me in with this", "the family plan does not take my brother"]


def lines(p):
    return [json.loads(x) for x in p.read_text().splitlines()]


def put(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


@pytest.fixture
def files(tmp_path):
    turn = lambda i, k, side, text: {"tweet_id": i * 10 + k, "author_id": side, "side": side, "created_at": f"2017-11-01T10:{k:02d}:00+00:00", "text": text}
    rows = [{"interaction_id": i, "customer_id": f"c{i}", "brand_id": "B", "turns": [turn(i, 0, "customer", TEXTS[i % 4]), turn(i, 1, "brand", "Please restart it")]} for i in range(1, 25)]
    table = lambda head, body: "\n".join(f"| {' | '.join(r)} |" for r in [head, ["---"] * len(head), *body]) + "\n\n"
    final = "**Version:** 3\n\n" + table(cli.TAXONOMY_COLUMNS[0], [[f"`{n}`", f"What {n} is.", "seed", f'"{n} example"'] for n in INTENTS])
    final += table(cli.TAXONOMY_COLUMNS[1], [[f"`{n}`", "kept", f"`{n}`"] for n in INTENTS[:-1]]) + table(cli.TAXONOMY_COLUMNS[2], [])
    seeds = table(["#", "Intent", "Definition", "Messages"], [[str(i + 1), f"`{n}`", f"What {n} is.", "2"] for i, n in enumerate(INTENTS)]) + "".join(f'- `{n}`: "{n} words"\n' for n in INTENTS)
    (tmp_path / "final.md").write_text(final)
    (tmp_path / "seeds.md").write_text(seeds)
    put(tmp_path / "i", rows)
    return lambda n: str(tmp_path / n)


def run(spark, model, *args):
    return cli.main(list(args), spark, lambda: model)


def hints():
    """A model that goes to the workers by value."""
    texts = list(TEXTS)

    def hint(prompt, system, temperature):
        decision = "maybe" if "is not valid" not in prompt and texts[3] in prompt else "auto" if texts[0] in prompt or texts[3] in prompt else "escalate"
        return json.dumps({"intent": "a_one" if texts[0] in prompt else "b_two", "decision": decision, "justification": "read"}), "m"

    return hint


def test_hints_session_and_development_labels(spark, files, tmp_path, monkeypatch, capsys):
    i, final = files("i"), files("final.md")
    assert run(spark, hints(), "sample-golden", "--input", i, "--taxonomy", final, "--output", files("q"), "--log", files("log"), "--target", "8", "--floor", "2") == 0
    queue = lines(tmp_path / "q")
    assert len(queue) == 8 and {q["hint_intent"] for q in queue} == {"a_one", "b_two"} and {q["hint_decision"] for q in queue} <= {"auto", "escalate"}
    said = iter(["", "", "fine", "b_two", "escalate", "", "q"])
    monkeypatch.setattr("builtins.input", lambda _: next(said))
    assert run(spark, hints(), "label-golden", "--input", i, "--taxonomy", final, "--queue", files("q"), "--output", files("gold")) == 0
    gold = lines(tmp_path / "gold")
    assert [g["interaction_id"] for g in gold] == [q["interaction_id"] for q in queue[:2]] and gold[1]["gold_intent"] == "b_two" and gold[0]["taxonomy_version"] == 3
    by_hand = put(tmp_path / "fix", [{"interaction_id": 4, "intent": "c_three", "justification": "by hand"}])
    assert run(spark, hints(), "label-intents", "--input", i, "--taxonomy", final, "--output", files("dev"), "--review", files("review.md"), "--log", files("log2"), "--corrections", by_hand) == 0
    dev = {r["interaction_id"]: r for r in lines(tmp_path / "dev")}
    assert len(dev) == 24 and dev[4]["source"] == "human" and dev[4]["intent"] == "c_three" and dev[8]["intent"] == "a_one" and dev[1]["intent"] == "b_two"
    assert "a_one" in (tmp_path / "review.md").read_text()
    bad = put(tmp_path / "bad", [{"interaction_id": 999, "intent": "c_three", "justification": "by hand"}])
    assert run(spark, hints(), "label-intents", "--input", i, "--taxonomy", final, "--output", files("x"), "--review", files("y"), "--log", files("log2"), "--corrections", bad) == 1


def test_discovery_and_reconciliation(spark, files, tmp_path, capsys):
    says = lambda p, s, t: ('{"mapping": "a_one", "justification": "alike"}', "m")
    assert run(spark, says, "discover-intents", "--input", files("i"), "--seeds", files("seeds.md"), "--output", files("k"), "--review", files("r.md"), "--log", files("log"), "--clusters", "4", "--dim", "32") == 0
    made = lines(tmp_path / "k")
    assert sum(c["size"] for c in made) == 24 and {c["mapping"] for c in made} == {"a_one"} and all(len(c["candidates"]) == 5 for c in made)
    reconcile = ["reconcile-intents", "--seeds", files("seeds.md"), "--taxonomy", files("final.md"), "--output", files("cover")]
    assert run(spark, says, *reconcile, "--clusters", files("k")) == 1 and not (tmp_path / "cover").exists()
    assert "intents without a cluster" in capsys.readouterr().err
    every = put(tmp_path / "k2", [{**made[0], "cluster_id": k, "size": k + 1, "mapping": n} for k, n in enumerate(INTENTS[:-1])] + [{**made[0], "cluster_id": 7, "size": 9, "mapping": "junk"}])
    assert run(spark, says, *reconcile, "--clusters", every) == 0
    assert [(r["intent_id"], r["messages"]) for r in lines(tmp_path / "cover")] == [*((n, k + 1) for k, n in enumerate(INTENTS[:-1])), ("other", 9)]


def test_language_archive_and_smoke(spark, files, tmp_path, capsys):
    samples = {"ENGLISH": [" ".join(TEXTS)], "GERMAN": ["der die und in den von zu das mit sich des auf für ist im dem nicht ein eine"]}
    (tmp_path / "s.json").write_text(json.dumps(samples))
    assert run(spark, hints(), "filter-english", "--input", files("i"), "--output", files("en"), "--samples", files("s.json")) == 0
    assert len(lines(tmp_path / "en")) == 24
    assert run(spark, lambda p, s, t: ("hello there", "m"), "smoke-llm") == 0
    assert "hello there" in capsys.readouterr().out
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.csv", "a,b\n")
    assert run(spark, hints(), "read-source", "--archive", files("bad.zip"), "--output", files("raw")) == 1
    assert not (tmp_path / "out.csv").exists() and "error" in capsys.readouterr().err
