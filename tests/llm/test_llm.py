"""Each operator against a brute-force version on small tables, with nulls, empty and long texts, ties, repeated rows,
clashing columns and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from threadmill.llm import chat_format, components, decontaminate, exact_dedup, lattice_lm, mix_sources, pretokens, quality_fm, rans_tokens, recompress_dedup, simhash_dedup, suffix_dedup
from threadmill.llm.scratch import Scratch
from threadmill.llm.textblocks import P61, KeyTable, PlaceHash, RangeHash, bit_counts, column_bytes

tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, fp long, run string, digest binary, size string, copy int"


def table(spark, rows, parts=3):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, None, s, len(t) if t else None, 7, None, 1, "r", b"x", "big", 2) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    voc = ["alpha", "Beta", "gämma", "δ", "e", "f,", "g!", "the", "of"]
    passages = [" ".join(rng.choice(voc) for _ in range(60)) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [rng.choice([" ".join(rng.choice(voc) + str(rng.randrange(40)) for _ in range(12)), rng.choice(passages)[: rng.randrange(300)]]) for _ in range(rng.randrange(6))]
        out.append((i, "\n".join(parts), rng.choice(["a", "b", None, "ü"])))
    out += [(100, None, "a"), (101, "", None), (102, " \t\n", "b"), (103, passages[0], "a"), (104, passages[0], "b"), (104, passages[0], "b"), (None, passages[0], "a"), (105, "one", "c"), (106, "x " * 30000, "a"), (107, "a" * 5000, "z")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return sorted(rows, key=repr)


def words(t):
    return WORD.findall((t or "").encode())


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def test_key_table():
    rng = np.random.default_rng(1)
    t, seen = KeyTable(4), {}
    for _ in range(5):
        new = np.setdiff1d(np.unique(rng.integers(0, 5000, 700, dtype=np.uint64)), np.array(list(seen), np.uint64))
        t.add(new)
        seen |= {int(k): len(seen) + i for i, k in enumerate(new)}
    asked = np.arange(6000, dtype=np.uint64)
    assert t.find(asked).tolist() == [seen.get(int(k), -1) for k in asked]


def thue_morse(n):
    """Two strings on which polynomials modulo a power of two collide, whatever their base."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_hashes_tell_thue_morse_strings_apart():
    for n in (64, 1024, 4096):
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(n))
        zero, end = np.zeros(1, np.int64), np.array([n])
        h, place = RangeHash(3), PlaceHash(3)
        assert h.ranges(h.prefix(a), zero, end) != h.ranges(h.prefix(b), zero, end)
        assert place.of(a, zero, end) != place.of(b, zero, end)
        symbols = np.array([5, 9], np.uint64)
        assert h.ranges(h.prefix(symbols[a - 97]), zero, end) != h.ranges(h.prefix(symbols[b - 97]), zero, end)


def test_range_hashes_are_polynomials_modulo_a_prime():
    rng = np.random.default_rng(2)
    h, p = RangeHash(8), int(P61)
    for values in (rng.integers(0, 256, 40_000).astype(np.uint8), rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)):
        prefix, sums, power = h.prefix(values), 0, 1
        for i, v in enumerate(values.tolist()):
            assert prefix[i] == sums
            sums, power = (sums + (v + int(h.shift) if values.dtype == np.uint8 else v % p) * power) % p, power * h.base % p
        twice = np.concatenate([values[100:400], values[50:700]])
        again = h.prefix(twice)
        assert h.ranges(again, np.array([7, 357]), np.array([300, 650])).tolist() == h.ranges(prefix, np.array([107, 107]), np.array([400, 400])).tolist()


def test_bit_counts():
    rng = np.random.default_rng(3)
    counts = np.array([0, 3, 0, 70_000, 5, 140_000, 0, 1, 0])
    h = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    each = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int)
    assert (bit_counts(h, counts) == np.stack([x.sum(0) for x in np.split(each, np.cumsum(counts)[:-1])])).all()


# ---- 1


def overlap(doc, item, df, n):
    w = lambda g: 4 if df[g] <= 1 else 2 if df[g] <= 3 else 1
    grams = lambda x: Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
    a, best = grams(item), None
    for s in range(max(1, len(doc) - len(item) + 1)):
        b = grams(doc[s : s + len(item)])
        same = sum(w(g) * min(c, b[g]) for g, c in a.items())
        sim = same / (sum(w(g) * c for g, c in a.items()) + sum(w(g) * c for g, c in b.items()) - same)
        if sim >= 0.8 and (best is None or sim > best[0] + 1e-12):
            best = (round(sim, 9), s)
    return best


def test_decontaminate(spark):
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([1, 3, 5, 8, 20, 40])))) for i in range(10)] + [(10, None), (11, "")]
    rows = []
    for i in range(60):
        base = (items[rng.randrange(10)][1]).split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(base) + 1)
            rng.choice([lambda: base.insert(at, rng.choice(voc)), lambda: base and base.pop(min(at, len(base) - 1))])()
        rows.append((i if i % 10 else 7, "  ".join(rng.choice(voc) for _ in range(rng.randrange(30))) + "\n" + ", ".join(base).upper() + " " + " ".join(rng.choice(voc) for _ in range(rng.randrange(30))), "a"))
    rows += [(500, None, "a"), (501, "", "a"), (None, items[0][1], None)]
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    known = {i: split(t) for i, t in items if split(t)}
    df = Counter(g for w in known.values() for g in {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)})
    expected = [(i, k, *b) for i, t, _ in rows for k, w in known.items() if (b := overlap(split(t), w, df, min(5, len(w))))]
    items_df = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = [(r.doc_id, r.item_id, round(r.similarity, 9), r.start_word) for r in decontaminate.contaminated(table(spark, rows), items_df).collect()]
    assert key(got) == key(expected)


def test_the_index_finds_all_items_within_the_radius(spark):
    """Two items of one length; the document's shared shingles are those of one, but it is like both."""
    base = [f"w{i}" for i in range(60)]
    other = ["x0", *base[1:59], "x59"]
    items = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(f"y{i}" for i in range(60)))], "item_id long, text string")
    docs = table(spark, [(1, " ".join(["a", *base, "b"]), "a"), (2, " ".join(f"z{i}" for i in range(50)), "a")])
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 2)} and all(r.hamming <= 24 for r in got)


def test_decontaminate_nothing(spark, docs, nothing):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.contaminated(nothing, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


# ---- 2


def test_factorisation_is_the_pairwise_sum():
    rng = np.random.default_rng(2)
    n, stats = 1 << quality_fm.BITS, quality_fm.STATS
    m = quality_fm.Model(0.3, rng.normal(size=n + stats), rng.normal(size=(n + stats, quality_fm.FACTORS)), np.zeros(stats), np.ones(stats))
    index, value, z = np.array([5, 9, 700]), np.array([0.5, 0.25, 0.25]), rng.normal(size=stats)
    x = [(i, v) for i, v in zip(index, value, strict=True)] + [(n + k, v) for k, v in enumerate(z)]
    pairs = sum(m.v[i] @ m.v[j] * a * b for p, (i, a) in enumerate(x) for j, b in x[p + 1 :])
    assert math.isclose(m.margin(np.array([3]), index, value, z[None])[0], 0.3 + sum(m.w[i] * a for i, a in x) + pairs, rel_tol=1e-9)


def test_quality_learns(spark, nothing):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["this", "is", "plain", "prose", "with", "words."]) for _ in range(40))
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), "a") for i in range(300)] + [(1000, None, "a"), (1001, "", "a"), (None, "x", "a")]
    docs = table(spark, rows)
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(5, None), (5, 1)], "doc_id long, label int")
    model = quality_fm.train(docs, marks, F.lit(True))
    got = quality_fm.score(docs, model)
    assert got.select("row.*").columns == docs.columns and got.count() == len(rows)
    held = got.where("row.doc_id between 200 and 299").select("row.doc_id", "score").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held)
    assert quality_fm.score(docs, None).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)
    assert quality_fm.train(docs, marks.limit(0), F.lit(True)) is None and quality_fm.score(nothing, model).count() == 0


# ---- 3


def test_pretokens_are_the_library_s():
    e = pretokens.Encoder(tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    letters = [*"ab stmdrevl'' \n\t .,!?1²Ⅷéñ中  ", "'s", "'re", "'ll", "  ", "\n\n", " '", "it's", "\u0085", "😀", "\u3000", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(map(chr, range(a, a + 50))) for a in (*range(0, 0xD700, 50), *range(0xE000, 0x20000, 50))]
    data, offs = column_bytes(pa.array(texts))
    for _ in range(2):
        ids, count = e.encode(data, offs)
        got = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_blocks_round_trip_and_checks():
    rng = np.random.default_rng(3)
    for n in (1, 5, 4000, 600_000):
        ids = np.minimum(rng.geometric(0.002, n), 50_000).astype(np.int64)
        count = np.bincount(ids)
        s = np.flatnonzero(count)
        t = rans_tokens.Table(s, rans_tokens.Table.scaled(count[s]))
        block = rans_tokens.encode_block(ids, t, 17, np.array([-3, 4]), np.array([n - 1, 1]))
        start, out, docs, counts = rans_tokens.decode_block(block, t)
        assert start == 17 and (out == ids).all() and docs.tolist() == [-3, 4] and counts.tolist() == [n - 1, 1]
        if n > 500_000:
            assert (rans_tokens.decode_block(block, t, 1)[1] == ids[rans_tokens.EVERY * rans_tokens.LANES :]).all()
        with pytest.raises(ValueError):
            rans_tokens.decode_block(block[:-9] + b"x" + block[-8:], t)


def test_tokens_round_trip(spark, rows, docs, nothing):
    path = tokenizers.path("byte_bpe_50k.json")
    folder = Scratch(spark, "t").path("x")
    rans_tokens.write_tokens(docs, folder, path, 2)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans_tokens.read_tokens(spark, folder).collect()]
    tk = pretokens.encoder(path).tokenizer
    each = [(i, np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t, _ in rows]
    at, expected = 0, []
    for i, ids in sorted(each, key=lambda x: (x[0] is not None, x[0], zlib.crc32(x[1].tobytes()))):
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert key(got) == key(expected)
    folder = Scratch(spark, "t").path("y")
    rans_tokens.write_tokens(nothing, folder, path, 2)
    assert rans_tokens.read_tokens(spark, folder).count() == 0


def test_colliding_texts_keep_their_ids():
    """Each is one pretoken; polynomials modulo 2**64 take them for the same."""
    e = pretokens.Encoder(tokenizers.path("byte_bpe_50k.json"))
    texts = [*thue_morse(1024), *thue_morse(4096)]
    data, offs = column_bytes(pa.array(texts))
    ids, count = e.encode(data, offs)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


# ---- 4


def test_exact_dedup(spark, rows, docs, nothing):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in index.add(docs).collect()]
    by = {}
    for i, t, _ in rows:
        by.setdefault(t or "", []).append(i)
    best = {t: max((i for i in own if i is not None), default=None) for t, own in by.items()}
    assert key(got) == key((i, best[t or ""], len(by[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    # A later batch, through the files of the index: known texts keep nothing, new ones are appended.
    again = exact_dedup.DigestIndex(spark, index.path, buckets=3)
    more = table(spark, [(900, "one", "a"), (901, "new", "a"), (902, "new", "a")])
    assert key((r.doc_id, r.keep_id, r.kept) for r in again.add(more).collect()) == [(900, 105, False), (901, 902, False), (902, 902, True)]
    assert again.read().count() == len(by) + 1 and index.add(nothing).count() == 0
    index.close()


def test_index_keeps_its_buckets_and_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    facts = lambda got: key((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect())
    first, n = facts(index.add(docs, name="day 1")), index.read().count()
    assert facts(index.add(docs, name="day 1")) == first and index.read().count() == n  # a retry
    assert not any(r[3] for r in facts(index.add(docs, name="day 2"))) and index.read().count() == n
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, buckets=5)
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.buckets == 3 and not any(r[3] for r in facts(again.add(docs)))
    again.close()
    index.close()


# ---- 5


def fill(size, weight):
    """Capped shares by filling again and again."""
    total, capped, target = sum(size.values()), set(), {}
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        weights = sum(weight[s] for s in size if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / weights for s in size}
        over = {s for s in size if s not in capped and target[s] > 3 * size[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark, rows, docs, nothing):
    got = mix_sources.mix(docs).collect()
    size = Counter()
    for i, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = fill(size, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert len(got) == len(rows) and key((r.doc_id, r.source, r["size"]) for r in got) == key((i, s, len(words(t))) for i, t, s in rows)
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9) and r.taken <= 3 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max((r["size"] for r in own), default=0)
    assert key(map(tuple, got)) == key(map(tuple, mix_sources.mix(docs.repartition(5)).collect()))
    assert mix_sources.mix(nothing).count() == 0


# ---- 6, 7


def test_long_word_repeats(spark, rows, docs, nothing):
    k = 9
    each = [(i, words(t)) for i, t, _ in rows]
    seen = Counter(tuple(w[j : j + k]) for _, w in each for j in range(len(w) - k + 1))
    expected = []
    for i, w in each:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        expected.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = recompress_dedup.dedup(docs, window=k)
    assert key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == key(expected)
    assert recompress_dedup.dedup(nothing).count() == 0


def test_colliding_words_and_windows_stay(spark):
    a, b = thue_morse(1024)
    pair = [(1, " ".join([a, *[f"w{i}" for i in range(34)]]), "a"), (2, " ".join([b, *[f"w{i}" for i in range(34)]]), "a")]
    long = [(3, " ".join("pq"[c == "b"] for c in a), "a"), (4, " ".join("pq"[c == "b"] for c in b), "a")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in recompress_dedup.dedup(table(spark, pair), window=35).collect()}
    assert got == {1: (35, 0), 2: (35, 0)}
    assert all(r.n_removed == 0 for r in recompress_dedup.dedup(table(spark, long), window=1024).collect())
    found = suffix_dedup.dedup(table(spark, [(1, a[:700], "a"), (2, b[:700], "a")]), length=700)
    assert all(r.n_removed == 0 for r in found.collect())


def test_equal_words_get_equal_symbols():
    rng = np.random.default_rng(5)
    inner = rng.integers(0, 4, 200).astype(np.uint64)
    a = recompress_dedup.Parse(np.concatenate([rng.integers(0, 4, 30).astype(np.uint64), inner]), np.array([0, 230]))
    b = recompress_dedup.Parse(np.concatenate([inner, rng.integers(0, 4, 50).astype(np.uint64)]), np.array([0, 250]))
    of = lambda p, shift: {(int(l) - shift, int(n)) for l, h, n in zip(p.lo, p.hi, p.name, strict=True) if l >= shift and h < shift + 200}  # noqa: E741, E731
    assert of(a, 30) == of(b, 0) and len(of(b, 0)) > 10


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_bytes(spark, rows, docs, nothing, hot):
    k, seen, expected = 100, set(), []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - k + 1):
            if b[j : j + k] in seen:
                gone[j : j + k] = True
            seen.add(b[j : j + k])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        expected.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix_dedup.dedup(docs, length=k, hot=hot)
    assert key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == key(expected)
    assert suffix_dedup.dedup(nothing).count() == 0


def test_contexts_of_a_frequent_anchor_are_spread():
    from threadmill.llm.runs import Documents

    rng = np.random.default_rng(8)
    passage = bytes(rng.integers(97, 123, 60).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, 90).astype(np.uint8)) + passage + bytes(rng.integers(97, 123, 90).astype(np.uint8)) for _ in range(300)]
    blob = lattice_lm.pack(np.arange(300), np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8))
    own = suffix_dedup.Anchors(Documents(blob), 100)
    asked = suffix_dedup._Contexts(own, 16)
    hot = int(np.argmax(asked.count))
    assert asked.count[hot] > 100 and len(set(asked.kmer.tolist())) == len(asked.kmer)
    kmer, context = own.kmer[own.first], own.context[own.first]
    mine = set(np.flatnonzero(kmer == asked.kmer[hot]).tolist())
    shares = [len(mine & set(asked.pair_order[s:e].tolist())) for _, s, e, _, _ in asked.parts]
    assert sum(shares) == len(mine) == len(set(context[sorted(mine)].tolist())) and max(shares) < len(mine) / 4


# ---- 8


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "<image:1>", "", "a\\\\<", None, "😀 é"]
    rng = random.Random(6)
    turns = [(c, t, rng.choice(["user", "assistant", "sys: #<", None]), rng.choice(nasty), 5) for c in range(20) for t in range(rng.randrange(1, 200 if c == 3 else 8))]
    turns += [(3, None, "user", "first", 5), (3, 1, "user", "tie", 5), (3, 1, "user", "tie", 5), (None, 0, "assistant", "x", 5)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, block int")
    chats = chat_format.format_chats(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    got = chats.select("conv_id", "n_turns", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    esc = lambda s: re.sub(r"([\\#<])", r"\\\1", s)
    for r in got:
        own = sorted(((t is not None, t or 0), role or "", "### " + re.sub(r"([\\#<:])", r"\\\1", role or "") + ": " + esc(x or ""), x or "") for c, t, role, x, _ in turns if c == r.conv_id)
        assert [(t.role, t.text) for t in r.t] == [(o[1], o[3]) for o in own] and r.n_turns == len(own)
        assert r.loss == "".join(o[3] for o in own if o[1] == "assistant")
    assert len(got) == 21 and chat_format.format_chats(df.limit(0).withColumn("parts", chat_format.text_part(F.col("text")))).count() == 0


def test_long_conversation_is_linear(spark):
    """50,000 turns, and a text of a million characters."""
    turns = spark.range(50_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é <"), F.col("id").cast("string")).alias("text"))
    turns = turns.unionByName(spark.createDataFrame([(2, 0, "assistant", "<\\😀" * 250_000)], "conv_id int, turn long, role string, text string"))
    start = time.monotonic()
    chats = Scratch(spark, "t").put(chat_format.format_chats(turns.withColumn("parts", chat_format.text_part(F.col("text")))), "chats")
    read = chats.select("conv_id", F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: (r.n, r.loss) for r in read.collect()}
    assert got == {1: (50_000, "".join(f"é <{i}" for i in range(1, 50_000, 2))), 2: (1, "<\\😀" * 250_000)}
    assert time.monotonic() - start < 60


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see <"), part("image", ref="s3/a", units=2), part("audio", ref="b", units=None), None]), (1, 1, "assistant", [part("text", "a"), part("document", ref="c", units=3)]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(df).first()
    assert r.formatted == "### user: see \\<<image:1><audio:2></turn>\n### assistant: a<document:1></turn>\n### user: </turn>\n"
    assert [(a.turn_place, a.ord, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, 1, "image", "s3/a", 512), (1, 2, "audio", "b", 25), (2, 1, "document", "c", 1536)]
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["a<document:1>"]


# ---- 9


def test_lattice_is_the_sum_over_segmentations():
    path = tokenizers.path("piece_bpe_32k.model")
    own, logq = lattice_lm.pieces(path), lattice_lm.first_weights(path)
    q = {p: math.exp(logq[i]) for i, p in enumerate(own)}
    total = lambda t: 1.0 if not t else sum(q[t[:n]] * total(t[n:]) for n in range(1, len(t) + 1) if t[:n] in q)
    texts = [b"the", b"thing", b"x", "éa".encode(), b"\xff\x00", b"of"]
    got, counts = lattice_lm.lattices(path, logq, np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))), np.array([1, 0, 0, 0, 0, 0]))
    assert all(math.isclose(math.exp(g), total(b" " + t), rel_tol=1e-9) for g, t in zip(got, texts, strict=True))
    segs = lambda t: [[]] if not t else [[t[:n], *s] for n in range(1, len(t) + 1) if t[:n] in q for s in segs(t[n:])]
    mean = Counter()
    for s in segs(b" the"):
        for p in s:
            mean[p] += math.prod(q[x] for x in s) / total(b" the")
    assert all(math.isclose(counts[own.index(p)], c, rel_tol=1e-6) for p, c in mean.items()) and math.isclose(counts.sum(), sum(mean.values()), rel_tol=1e-6)


def test_scores(spark, rows, docs, nothing):
    path = tokenizers.path("piece_bpe_32k.model")
    learn = F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False))
    got = lattice_lm.score(docs, learn, path, rounds=1).collect()
    each = [(i, [*(w.translate(LOWER) for w in words(t)), None], i is not None and i % 4 != 0) for i, t, _ in rows]
    c = Counter(w for _, own, train in each if train for w in own)
    n, v = sum(c.values()), len(c)
    expected = [(i, not train, len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)) for i, own, train in each]
    assert key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == key(expected)
    assert all(r.score < 0 for r in got) and lattice_lm.score(nothing, learn, path).count() == 0
    assert {r.score for r in got if r.n_tokens == 1} == {max(r.score for r in got)}


def test_score_is_the_sum_of_lattices_and_the_end(spark):
    """Without learning, by the first weights: all segmentations of each word, added up one by one."""
    path = tokenizers.path("piece_bpe_32k.model")
    own, logq = lattice_lm.pieces(path), lattice_lm.first_weights(path)
    q = {p: math.exp(logq[i]) for i, p in enumerate(own)}

    def total(t):
        sums = [1.0]
        for e in range(1, len(t) + 1):
            sums.append(sum(sums[s] * q.get(t[s:e], 0.0) for s in range(e)))
        return sums[-1]

    texts = [(1, "the Thing of things", "a"), (2, None, "a"), (3, "éa the\tthe", "a")]
    expected = [(i, round(sum(math.log10(total(b" " + w.translate(LOWER))) for w in words(t)) + logq[-1] / math.log(10), 9)) for i, t, _ in texts]
    got = lattice_lm.score(table(spark, texts), F.lit(True), path, rounds=0)
    assert key((r.doc_id, round(r.score, 9)) for r in got.collect()) == key(expected)


def test_long_words_are_walked(spark, monkeypatch):
    path = tokenizers.path("piece_bpe_32k.model")
    logq = lattice_lm.first_weights(path)
    texts = [("Thequickbrownfox" * 60).encode()[:n] for n in (5, 40, 255, 700)]
    given = (path, logq, np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))), np.array([1, 2, 3, 4]))
    monkeypatch.setattr(lattice_lm, "LONG", 10**6)
    whole = lattice_lm.lattices(*given)
    monkeypatch.setattr(lattice_lm, "LONG", 1)
    monkeypatch.setattr(lattice_lm, "STRETCH", 50)
    assert all(np.allclose(a, b) for a, b in zip(whole, lattice_lm.lattices(*given), strict=True))


def test_word_of_a_megabyte_ends(spark):
    path, rng = tokenizers.path("piece_bpe_32k.model"), np.random.default_rng(1)
    word = rng.integers(97, 123, 1 << 20).astype(np.uint8).tobytes().decode()
    start = time.monotonic()
    got = lattice_lm.score(table(spark, [(1, word, "a"), (2, "one", "a")], 1), F.lit(True), path, rounds=1).orderBy("doc_id").collect()
    assert time.monotonic() - start < 60 and got[0].score < -1e6 and got[0].n_tokens == 2


def test_unseen_word_is_not_known(spark):
    a, b = thue_morse(1024)
    rows = [(1, a, "a"), (4, b, "a")]
    got = lattice_lm.score(table(spark, rows), F.col("doc_id") == 1, tokenizers.path("piece_bpe_32k.model"), rounds=0)
    assert {r.doc_id: r.n_known for r in got.collect()} == {1: 2, 4: 1}


# ---- 10


def test_simhash_groups(spark, rows, docs, nothing):
    fps = []
    for i, t, _ in rows:
        w = [x.translate(LOWER) for x in words(t)]
        h = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else []))]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    for radius, blocks in ((3, 6), (12, 14)):
        name = list(range(len(fps)))
        for _ in fps:
            for a, (_, x) in enumerate(fps):
                for b, (_, y) in enumerate(fps):
                    if (x ^ y).bit_count() <= radius:
                        name[a] = name[b] = min(name[a], name[b])
        least = {k: min(i for (i, _), n in zip(fps, name, strict=True) if n == k and i is not None) for k in set(name)}
        got = simhash_dedup.groups(docs, 3, radius, blocks).collect()
        assert key((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == key((i, f, least[n]) for (i, f), n in zip(fps, name, strict=True))
    assert simhash_dedup.groups(nothing).count() == 0


def test_forest_and_components(spark):
    rng = np.random.default_rng(7)
    near = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 9), dtype=np.uint64)))
    child, parent = simhash_dedup.forest(near, 3)
    assert len(child) == len(near) - 40 and (np.bitwise_count(near[child] ^ near[parent]) <= 3).all()
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = components.connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "cc"))
    assert {r.node: r.root for r in got.collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
