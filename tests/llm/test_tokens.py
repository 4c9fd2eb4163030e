"""Operators 1 and 9 against the libraries, and exact round trips."""

import io
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallystone.llm import pieces, repair

STRINGS = ["", " ", "   ", "a", "don't 'stop\n\n  it's  x\t y\n", "'", "''s '", "x'", "      hello      ", "▁a ▁▁b", "漢字 ①Ａ\U0001f600 ok", "a" * 300, "tail  \n", "<|endoftext|>", "<s>", "\x00\x1c \x85 z", "１２ ½ ٣x"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = "aàbcdeinorst   ''\n\t.,!?0123é漢▁\U0001f600Z"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def thue_morse(k, a="a", b="b"):
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def by_text(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_bpe_viterbi_gives_the_librarys_ids(vocab):
    path = vocab("piece_bpe_32k.model")
    m = pieces.load(path)
    assert m.bpe
    texts = STRINGS + random_texts(400) + [w for k in (9, 10, 11, 13) for w in thue_morse(k)] + [" ".join(thue_morse(11))]
    ids, n = pieces.encoder(m)(texts)
    assert by_text(ids, n) == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert pieces.decode(m, ids, n) == [t.replace("▁", " ") for t in texts]


def test_unigram_viterbi_finds_the_best_sum(vocab):
    """A small unigram model, compared with a search over all segmentations."""

    class Tiny:
        table = [("<unk>", 0.0)] + [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("▁a", -3.5), ("ab", -4.0), ("aba", -5.5), ("ba", -4.0), ("▁ab", -5.2), ("bb", -6.0)]
        get_piece_size = lambda s: len(s.table)
        id_to_piece = lambda s, i: s.table[i][0]
        get_score = lambda s, i: s.table[i][1]
        is_unknown = lambda s, i: i == 0
        is_control = is_byte = is_unused = lambda s, i: False
        unk_id = lambda s: 0

    m = pieces.build(Tiny(), 1)
    scores = dict(Tiny.table[1:])

    def best(w):
        if not w:
            return 0.0
        return max((scores[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in scores), default=-1e18)

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    ids, n = pieces._encoder(m)(texts)
    for t, got in zip(texts, by_text(ids, n)):
        marked = "▁" + t.replace(" ", "▁")
        assert "".join(Tiny.table[i][0] for i in got) == marked
        words, cur = [], ""
        for i, c in enumerate(marked):
            if c == "▁" and i and marked[i - 1] != "▁":
                words.append(cur)
                cur = ""
            cur += c
        assert sum(Tiny.table[i][1] for i in got) == pytest.approx(sum(map(best, [*words, cur])))


def test_words_that_share_a_hash_keep_their_own_ids(vocab, monkeypatch):
    """With a first hash of three values only, the second one tells words apart."""
    from tallystone.llm import wordcache

    keys = wordcache.word_keys
    monkeypatch.setattr(wordcache, "word_keys", lambda p, a, b: ((x := keys(p, a, b))[0] % np.uint64(3), x[1]))
    m = pieces.load(vocab("piece_bpe_32k.model"))
    encode, sp = pieces._encoder(m), sentencepiece.SentencePieceProcessor(model_file=vocab("piece_bpe_32k.model"))
    for seed in range(3):
        texts = random_texts(50, seed)
        assert by_text(*encode(texts)) == sp.encode(texts)


def test_a_run_of_unknown_characters_is_one_piece():
    class Tiny:
        table = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0)]
        get_piece_size = lambda s: len(s.table)
        id_to_piece = lambda s, i: s.table[i][0]
        get_score = lambda s, i: s.table[i][1]
        is_unknown = lambda s, i: i == 0
        is_control = is_byte = is_unused = lambda s, i: False
        unk_id = lambda s: 0

    ids, n = pieces._encoder(pieces.build(Tiny(), 1))(["xyza", "x", "ax y", "y"])
    assert by_text(ids, n) == [[1, 0, 2], [1, 0], [1, 2, 0, 1, 0], [1, 0]]


def test_sentencepiece_columns(spark, odd_docs, no_docs, vocab):
    path = vocab("piece_bpe_32k.model")
    rows = pieces.encode_column(odd_docs, path, ["doc_id", "a.b"]).collect()
    assert len(rows) == odd_docs.count() and all(r["round_trip"] for r in rows if r["round_trip"] is not None)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.select("doc_id", "text").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in rows:
        assert r["ids"] == sp.encode(texts[r["doc_id"]] or "")
    back = pieces.decode_column(spark.createDataFrame([(1, sp.encode("a  b")), (2, []), (3, None)], "doc_id long, ids array<int>"), path, ["doc_id"])
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "a  b", 2: "", 3: None}
    assert pieces.encode_column(no_docs, path, ["doc_id"]).count() == 0


@pytest.fixture(scope="module")
def bpe(vocab):
    return Tokenizer.from_file(vocab("byte_bpe_50k.json"))


def test_pre_tokens_change_no_id(vocab, bpe):
    texts = STRINGS + random_texts(600, 2) + [w for k in (9, 10, 11, 13) for w in thue_morse(k)] + ["hello <|endoftext|> there", "<|endoftext|><|endoftext|>don't", "<|endoftext", "a" * 60_000]
    encode, vocab_size = repair.encoder(open(vocab("byte_bpe_50k.json")).read())
    ids, n = encode(texts)
    assert vocab_size == 50257
    assert by_text(ids, n) == [e.ids for e in bpe.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n,kinds", [(0, 5), (1, 5), (2, 1), (5000, 1), (5000, 3), (60_000, 300)])
def test_repair_round_trip_and_random_access(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = rng.integers(0, kinds, n) * 7
    s = repair.Shard(repair.pack(ids, 50257))
    assert s.n_ids == n and (s.read() == ids).all()
    for _ in range(30):
        a = int(rng.integers(0, n + 1))
        k = int(rng.integers(0, n - a + 1))
        assert (s.read(a, k) == ids[a : a + k]).all()
    for (x, y), size in zip(s.rules.astype(int), s.size[s.vocab :]):
        assert size == s.size[x] + s.size[y]


@pytest.mark.parametrize("kinds", [1, 2, 40, 70_000])
def test_repair_leaves_no_frequent_pair(kinds):
    rng = np.random.default_rng(kinds)
    ids = np.concatenate([rng.integers(0, kinds, 20_000), np.tile(rng.integers(0, kinds, 30), 50), np.zeros(999, int)])
    s = repair.Shard(repair.pack(ids, max(kinds, 2)))
    assert (s.read() == ids).all()
    counts, left = {}, s.symbols.tolist()
    last = None
    for i, p in enumerate(zip(left, left[1:])):
        if p[0] == p[1] and last == (p, i - 1):  # overlaps the one before
            last = None
            continue
        counts[p], last = counts.get(p, 0) + 1, (p, i)
    assert max(counts.values(), default=0) < repair.LEAST
    assert s.symbols.dtype == (np.uint16 if s.vocab + len(s.rules) <= 1 << 16 else np.uint32)


def test_repair_refuses_ids_outside_the_vocabulary():
    with pytest.raises(ValueError):
        repair.pack(np.array([1, 70_000]), 50257)


def test_repair_compresses_repeats():
    ids = np.tile(np.arange(50), 4000)
    assert len(repair.pack(ids, 50257)) < len(ids) / 2


def test_repair_query(spark, odd_docs, no_docs, vocab, bpe):
    path = vocab("byte_bpe_50k.json")
    special = spark.createDataFrame([(700, "say <|endoftext|> twice <|endoftext|>"), (701, "plain")], "doc_id long, text string")
    odd_docs = odd_docs.unionByName(special, allowMissingColumns=True)
    shards = repair.write_shards(odd_docs, path, shard=500)
    got = [tuple(r) for r in repair.read_documents(shards).orderBy("start").collect()]
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, bpe.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in rows), key=lambda r: r[:2])
    assert [g[0] for g in got] == [w[1] if w[0] else None for w in want]
    at = 0
    for g, (_, _, ids) in zip(got, want):
        assert g[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert repair.read_documents(repair.write_shards(no_docs, path)).count() == 0
