"""Encoding and decoding against the tokenizers library, and the check of pairs against exact merging."""

import hashlib
import random

import numpy as np
import pytest

from threadmill.llm import bpe, queries

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = ["a", "b", "e", "n", "t", "s", "'", "'ll", "'S", "ß", "é", "é", "Σ", "İ", "1", "٣", "½", ".", "!!", "-", " ", " ", " ", "\n", "中", "한", "하", "😀", "͸", "कि", "<|endoftext|>", "<|startoftext|>", "<|", "\x00"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    out += ["a" * n for n in range(1, 40)] + ["ab" * 20, "x" * 70_001, "hahaha" * 50, "''s'sam'll're've'vex''", "I'M We'Ll don'T", "", " ", "<|endoftext|>", "<|endoftext|><|endoftext|> a"]
    return out


def test_slices_of_many_texts(library, texts):
    enc = bpe.Encoder(PATH)
    for _ in range(2):  # the second time from what is kept
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
        ids, count = enc.encode(data, offs)
        got = np.split(ids, np.cumsum(count)[:-1])
        for t, own in zip(texts, got, strict=True):
            assert own.tolist() == library.encode(t, add_special_tokens=False).ids, t
        decoded, ends = enc.decode(ids.astype(np.int64), count)
        for k, own in enumerate(got):
            assert decoded[ends[k] : ends[k + 1]].tobytes().decode() == library.decode(own.tolist(), skip_special_tokens=False)


def test_every_code_point(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a".join(points[k : k + 512]) for k in range(0, len(points), 512)]
    enc = bpe.Encoder(PATH)
    for t, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        data = np.frombuffer(t.encode(), np.uint8)
        assert enc.encode(data, np.array([0, len(data)]))[0].tolist() == e.ids, hex(ord(t[0]))


def test_pairs_decide_as_merging_does():
    """Over a small vocabulary with a word end: every pair of entries, and every entry by itself."""
    vocab = {c: i for i, c in enumerate(["a", "b", "a</w>", "b</w>"])}
    merges = [("a", "a"), ("a", "b"), ("aa", "aa"), ("b", "a</w>"), ("ab", "ab"), ("aa", "b</w>"), ("b", "b"), ("bb", "ab")]
    for x, y in merges:
        vocab[x + y] = len(vocab)
    own = bpe.Vocabulary(vocab, merges, "</w>")
    plain = {i: t.replace("</w>", "").encode() for t, i in vocab.items()}
    for t, i in vocab.items():
        if t.endswith("</w>"):
            assert own.sound[i] == (own.merged(plain[i]) == [i])
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    ids, count = own.encoded(words)
    slow = [own.merged(w) for w in words]
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == slow
    kept = [own.proposed(w) == s for w, s in zip(words, slow, strict=True)]
    assert any(kept) and not all(kept)


def test_merges_out_of_order_are_merged_exactly():
    vocab = {c: i for i, c in enumerate("abc")} | {"bc": 3, "abc": 4, "ab": 5}
    own = bpe.Vocabulary(vocab, [("a", "bc"), ("a", "b"), ("b", "c")])
    ids, count = own.encoded([b"abc", b"bc"])
    assert not own.sound[4] and ids.tolist() == own.merged(b"abc") + own.merged(b"bc")


def test_rows(spark, library, texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "No id.", 1, "x"), (7, None, 1, "x"), (7, None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got])) == sorted(map(repr, want))
    assert bpe.encode(docs.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        bpe.Encoder(tokenizers.path("byte_bpe_50k.json"))


def test_query(spark, library, texts, tmp_path):
    spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op11_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate([*texts, None]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert len(got) == len(texts) + 1
