"""The near-copy stage against brute force on pairs around a five-word similarity of 0.8."""

import random

import pytest

import corpus_pipeline

VOC = [f"{a}{b}" for a in ("ba", "lo", "mi", "re", "su", "ta", "ke", "po") for b in ("nd", "rk", "st", "ll", "ve")]


def sets(text):
    words = (text or "").lower().split()
    return (tuple(words), {tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def alike(a, b):
    if a[0] == b[0]:
        return True
    return len(a[1]) > 0 and len(b[1]) > 0 and 9 * len(a[1] & b[1]) >= 4 * (len(a[1]) + len(b[1]))


def brute(rows):
    """Places of the rows that stay."""
    all_sets, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(all_sets[i], all_sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()]


def mostly(rows, out):
    """Nothing goes that brute force keeps, and of the rest nine tenths go at least (SimHash finds no more for sure)."""
    keep, out = {rows[i] for i in brute(rows)}, set(out)
    assert keep <= out
    assert len(out) - len(keep) <= 0.1 * (len(rows) - len(keep))


def stage(spark, path, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frame.write.parquet(str(path))
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(path)), "")
    assert out.columns == ["doc_id", "text"]
    return [tuple(r) for r in out.collect()]


def similar(a, b):
    a, b = sets(a)[1], sets(b)[1]
    return len(a & b) / len(a | b)


def edited(kind, words, rng, word):
    """A text of similarity 0.8 to 0.9, by one kind of edit."""
    while True:
        n, other = len(words), list(words)
        if kind == "scattered":
            for at in rng.sample(range(n), rng.randrange(2, 6)):
                other[at] = word()
        elif kind == "block":
            size = rng.randrange(8, 20)
            at = rng.randrange(n - size)
            other[at : at + size] = [word() for _ in range(size)]
        elif kind == "appended":
            other += [word() for _ in range(rng.randrange(20, 50))]
        else:
            other = other[rng.randrange(18, 42) :]
        if 0.8 <= similar(" ".join(words), " ".join(other)) <= 0.9:
            return " ".join(other)


@pytest.mark.parametrize("kind", ["scattered", "block", "appended", "cut"])
def test_recall_of_each_kind_of_edit(spark, kind):
    """300 pairs of 200 words: nine tenths are found at least, and nothing else is merged."""
    rng = random.Random(f"edits {kind}")
    word = lambda: rng.choice(VOC) + str(rng.randrange(400))
    rows = []
    for i in range(300):
        words = [word() for _ in range(200)]
        rows += [(i, " ".join(words)), (1000 + i, edited(kind, words, rng, word))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = {r[0] for r in rows} - {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()}
    assert all(i >= 1000 for i in gone) and len(gone) >= 285


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_around_the_threshold(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, near = [], 0
    for i in range(150):
        words = [rng.choice(VOC) for _ in range(rng.randrange(20, 120))]
        rows.append((i, " ".join(words)))
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.01, 0.05)))):
            other[at] = rng.choice(VOC).upper() + "x"
        rows.append((1000 + i, " ".join(other)))
        near += 0.8 <= (lambda a, b: len(a & b) / len(a | b))(sets(rows[-1][1])[1], sets(rows[-2][1])[1]) < 0.9
    line = " ".join(rng.choice(VOC) for _ in range(12))
    rows = [(i, f"{line} {t}" if i % 3 == 0 else t) for i, t in rows]
    assert near > 15
    mostly(rows, stage(spark, tmp_path / "d", rows))


def test_one_group_of_many(spark, tmp_path, monkeypatch):
    from threadmill.llm import near_copies

    monkeypatch.setattr(near_copies, "MEMBERS", 16)
    rng = random.Random(3)
    words = [rng.choice(VOC) for _ in range(100)]
    rows = []
    for i in range(200):
        other = list(words)
        for at in rng.sample(range(100), rng.choice([1, 2, 3, 4])):
            other[at] = f"w{i}"
        rows.append((i, " ".join(other)))
    out = stage(spark, tmp_path / "d", rows)
    mostly(rows, out)
    assert len(out) == len(brute(rows))  # one group, of many chunks: found whole


def test_group_without_a_middle(spark, tmp_path, monkeypatch):
    """Texts in a chain, each alike only to the next ones: none is near to all, and every chunk meets every other."""
    from threadmill.llm import near_copies

    monkeypatch.setattr(near_copies, "MEMBERS", 8)
    rng = random.Random(4)
    words = [rng.choice(VOC) + str(rng.randrange(50)) for _ in range(600)]
    rows = [(i, " ".join(words[i : i + 200])) for i in range(0, 400, 4)]
    mostly(rows, stage(spark, tmp_path / "d", rows))


def test_units_span_slices(spark, tmp_path):
    """Long texts of one group, more than a slice holds."""
    rng = random.Random(6)
    words = [rng.choice(VOC) + str(rng.randrange(5000)) for _ in range(60_000)]
    rows = [(i, " ".join([f"x{i}", *words[1:]])) for i in range(6)] + [(9, " ".join(reversed(words)))]
    assert sorted(r[0] for r in stage(spark, tmp_path / "d", rows)) == [0, 9]


def test_clean_and_short_texts_stay(spark, tmp_path):
    """Texts of few words, and long ones that share less, go only where another has the same words."""
    rng = random.Random(5)
    short = [(i, " ".join(rng.choice(VOC) for _ in range(i % 6))) for i in range(300)]
    words = [rng.choice(VOC) for _ in range(60)]
    half = [(1000, " ".join(words)), (1001, " ".join(words[:45] + [rng.choice(VOC) + "x" for _ in range(15)]))]
    # One word of ten differs: below 0.5, though most words are the same.
    half.append((1002, " ".join("y" + w if k % 10 == 5 else w for k, w in enumerate(words))))
    rows = [*short, *half, (2000, None), (2001, " \n"), (2002, half[0][1].upper())]
    out = stage(spark, tmp_path / "d", rows)
    assert sorted(out, key=str) == sorted((rows[i] for i in brute(rows)), key=str)
    assert {1000, 1001, 1002} <= {r[0] for r in out} and len([1 for r in out if not (r[1] or "").split()]) == 1


def test_simhash_blocks_name_candidates(spark):
    """Fingerprints within 3 bits are linked by their blocks, whatever bands their texts have; equal ones, too."""
    from threadmill.llm import near_copies
    from threadmill.llm.components import connected_components
    from threadmill.llm.scratch import Scratch

    fp = 0x123456789ABCDEF
    rows = [(1, fp), (2, fp), (3, fp ^ 0b1000000000100001), (4, fp ^ (0b11111 << 20)), (5, ~fp)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    scratch = Scratch(spark, "test")
    links = scratch.put(near_copies.simhash_links(nodes, scratch), "links")
    roots = {r.node: r.root for r in connected_components(links, scratch).collect()}
    assert set(roots) == {1, 2, 3} and len(set(roots.values())) == 1
