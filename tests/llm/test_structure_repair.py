"""The cheapest repair of conversations against a search over all edits, on tables with nulls, ties, repeated and very many rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from threadmill.llm import queries, structure_repair as sr

SHAPE = re.compile(r"(s?(ua)+)?\Z")
TRIM = " \t\n\x0b\x0c\r"


def brute(roles, texts, faults, inserts=2):
    """All letters with at most so many inserts, applied in every way; the least (cost, audit) that fits."""
    best = None
    for extra in range(inserts + 1):
        for places in itertools.combinations_with_replacement(range(len(roles) + 1), extra):
            options = []
            for i in range(len(roles) + 1):
                options += [["Iu", "Ia"]] * places.count(i)
                if i < len(roles):
                    options.append(["D"] if faults[i] in (1, 2) else ["K", "Ru", "Ra", "D"])
            for ops in itertools.product(*options):
                at, cost, out = 0, 0, []
                for op in ops:
                    if op[0] == "I":
                        cost += 5
                        out.append((op[1], ""))
                        continue
                    cost += {"K": 0, "R": 1, "D": 2}[op[0]] + (5 if faults[at] == 3 and op != "D" else 0)
                    if op == "K":
                        out.append((roles[at], texts[at]))
                    elif op[0] == "R":
                        out.append((op[1], texts[at]))
                    at += 1
                if SHAPE.match("".join(r[:1] or " " for r, _ in out)):
                    found = (cost, "".join(o[0] for o in ops), [({"u": "user", "a": "assistant"}.get(r, r), t) for r, t in out])
                    best = min(best or found, found)
    return best


def plain(rows):
    """The same by one search over (row, state) kept in a table, for longer conversations."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(TRIM)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
    return rows, faults, (gaps, *[faults.count(k) for k in (1, 2, 3)], sum(p not in ("su", "ua", "au") for p in pairs))


@pytest.fixture(scope="module")
def small():
    rng = random.Random(4)
    out = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            out.append((conv, rng.choice([turn, turn, None, turn + 3]), role, rng.choice(["Yes.", "No", " \t", "", None, "Hm?\n", "Yes."])))
    return out + [(None, 1, "user", "No id."), (None, 2, "assistant", "None!")]


def expected(rows):
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append((row[0], row[1] or "", row[2] or ""))
    out = {}
    for conv, own in by.items():
        own, faults, counts = plain(own)
        out[conv] = (*counts, brute([r[1] for r in own], [r[2] for r in own], faults), own, faults)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_all_edits(spark, small, parts):
    frame = spark.createDataFrame([(*r, 1, "x") for r in small], "conv_id long, turn int, role string, text string, fault int, key string").repartition(3)
    made = sr.repair(frame, parts=parts)
    want = expected(small)
    got = {r.conv_id: r for r in made.reports.collect()}
    assert set(got) == set(want)
    kept = {}
    for r in sorted(made.turns.collect(), key=lambda r: r.run):
        kept.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.kept)
    for conv, (gaps, blank, duplicate, truncated, illegal, best, _, _) in want.items():
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (gaps, blank, duplicate, truncated, illegal), conv
        assert (r.cost, r.audit, kept[conv]) == best, conv


def test_blocks_give_the_same_audit():
    rng = random.Random(2)
    for n in (1, 5, 40, 333):
        for _ in range(5):
            initials = [rng.choice("suat") for _ in range(n)]
            faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
            whole = sr.cheapest(initials, faults, n)
            assert whole == sr.cheapest(initials, faults, 3) == sr.cheapest(initials, faults, 16)


def test_long_conversation_is_cut_by_ranges(spark):
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Text {t}.", f"cut {t}", "", f"Again {t % 7}."])) for t in range(3000)]
    rows += [(6, 1, "user", "Hi."), (6, 2, "assistant", "Ho.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = sr.repair(frame, parts=6)
    own, faults, counts = plain([r[1:] for r in rows if r[0] == 5])
    cost, audit = sr.cheapest([r[1][:1] for r in own], faults, 10**9)
    got = {r.conv_id: r for r in made.reports.collect()}
    assert (*counts, cost, audit) == tuple(got[5][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    runs = [r for r in sorted(made.turns.collect(), key=lambda r: r.run) if r.conv_id == 5]
    assert [r.run for r in runs] == list(range(runs[0].runs)) and len(runs) > 4
    want = sr.apply(sr.START, audit, [r[1] for r in own], [r[2] for r in own])[1]
    assert [(t.role, t.text) for r in runs for t in r.kept] == [(t["role"], t["text"]) for t in want]
    assert SHAPE.match("".join(t["role"][0] for t in want)) and got[6].audit == "KK"


def test_nothing(spark):
    made = sr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert made.reports.collect() == [] and made.turns.collect() == []


def test_query(spark, small, tmp_path):
    rng = random.Random(8)
    rows = small + [(100 + i, t, rng.choice(["user", "assistant"]), f"Line {t}.") for i in range(40) for t in range(4)]
    rows += [(7000, t, ("user", "assistant")[t % 2], f"Number {t}!") for t in range(1500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    frame.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op12_structure_repair(spark, str(tmp_path)).collect()}
    by = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert set(got) == set(by)
    for conv, own in by.items():
        own, faults, counts = plain(own)
        cost, audit = sr.cheapest([r[1][:1] for r in own], faults, 10**9)
        if len(own) < 5:
            assert (cost, audit) == brute([r[1] for r in own], [r[2] for r in own], faults)[:2]
        turns = sr.apply(sr.START, audit, [r[1] for r in own], [r[2] for r in own])[1]
        sha = hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()).hexdigest()
        r = got[conv]
        assert (*counts, cost, audit, sha) == (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256), conv
