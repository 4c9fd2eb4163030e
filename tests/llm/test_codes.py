"""Operators 11 to 13 against brute force and the tiktoken library."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import bytepairs as B
from tallystone.llm import codes as V
from tallystone.llm import collocations as C
from tallystone.llm import queries as Q

# --- phrases


def brute_phrases(rows, least, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            count[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrases(df, **kw):
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(5)
    words = "the of and New york new York a-b naïve 漢字 x1 \x00z it's".split(" ")
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 90))), rng.choice(["en", "fr", None, "und"])) for _ in range(60)]
    rows += [("new york city hall " * 30, "en")] * 3 + [("a a a a a a a", "fr"), ("", "en"), (None, "en"), (" \t\n", None), ("." * 50, "fr"), ("w" * 3000 + " end. " * 20, "en")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return rows, df.withColumns({"a": F.lit(1), "n": F.lit(2), "phrase": F.lit("x"), "block": F.lit(0), "a.b": F.lit(3), "k": F.lit(None).cast("int")})


@pytest.mark.parametrize("least,top,sizes", [(3, 2000, {}), (5, 7, {}), (2, 2000, {"shard": 500, "chunk": 120, "entries": 300}), (300, 10, {"shard": 900, "chunk": 300, "entries": 50})])
def test_phrases_of_brute_force(talk, least, top, sizes):
    rows, df = talk
    want = brute_phrases(rows, least, top)
    assert phrases(df, least=least, top=top, **sizes) == want
    assert want or least == 300


def test_phrases_without_limit_and_of_nothing(talk, no_docs):
    rows, df = talk
    assert phrases(df, least=4, top=None) == brute_phrases(rows, 4, 10**9)
    assert phrases(no_docs) == [] and phrases(df.where("text is null")) == []


def test_colliding_slots_change_no_count(talk):
    """With all runs in 16 slots every run is a candidate, and the counts decide."""
    rows, df = talk
    real = C.runs

    def crowded(text, longest=4):
        s, e, at, slots = real(text, longest)
        return s, e, at, [x & np.uint64(15) for x in slots]

    made = C.shards(df)
    blobs = [(r["lang"], C._text(r["text"], r["n_bytes"])) for r in made.collect()]
    for lang, text in blobs:
        starts, ends, at, slots = crowded(text)
        words = np.repeat(np.arange(1, 5), [len(a) for a in at])
        at = np.concatenate(at)
        order = np.argsort(at, kind="stable")
        found, k, n = C._counted(text, starts, ends, at[order], words[order])
        lines = [x.split(" ") for x in text.tobytes().decode().split("\n") if x]
        want = Counter(" ".join(w[i : i + m]) for w in lines for m in range(1, 5) for i in range(len(w) - m + 1))
        assert dict(zip([p.decode() for p in found], n.tolist(), strict=True)) == dict(want)
        assert all(len(p.decode().split(" ")) == m for p, m in zip(found, k.tolist(), strict=True))


def test_slots_survive_their_storage():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        x = np.unique(rng.integers(0, 1 << C.SLOT_BITS, n).astype(np.uint64))
        assert (C._read(C._stored(x), len(x)) == x).all()


# --- vector codes


def brute_codes(rows):
    whole = [(i, v, label) for i, v, label in rows if v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(256 * np.float64(x))) for x in v], label) for i, v, label in sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    books = [[v[2 * p : 2 * p + 2] for _, v, _ in whole[:64]] for p in range(16)]

    def assign(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[2 * p : 2 * p + 2], e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(2):
        held = [[[] for _ in b] for b in books]
        for _, v, _ in whole:
            for p in range(16):
                held[p][assign(v, p)[0]].append(v[2 * p : 2 * p + 2])
        books = [[[sum(x) // len(h) for x in zip(*h, strict=True)] if h else e for e, h in zip(b, hs, strict=True)] for b, hs in zip(books, held, strict=True)]
    final = [[assign(v, p) for p in range(16)] for _, v, _ in whole]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = Counter()
    for (_, _, label), f in zip(whole, final, strict=True):
        errors[label] += sum(d for _, d in f)
    return sorted(((i, "".join(f"{c:02x}" for c, _ in f), sum(d for _, d in f), errors[label], sha) for (i, _, label), f in zip(whole, final, strict=True)), key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 32))
    rows = [(int(i), (centres[i % 9] + 0.3 * rng.normal(size=32)).round(int(i) % 3 + 1).astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 4)) for i in range(150)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], 2), (400, rows[5][1], 0), (401, [0.0] * 32, None)]
    rows += [(-1, None, 1), (-2, [1.0] * 31 + [None], 1), (-3, [1.0] * 31 + [float("nan")], 1), (-4, [float("inf")] * 32, 1), (-5, [], 1), (500, [1.0] * 31, 1), (501, [1.0] * 48, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return rows, df.withColumns({"v": F.lit(1), "id": F.lit("x"), "error": F.lit(2), "codes": F.lit(0), "a.b": F.lit(1)})


def test_codes_of_brute_force(vectors):
    rows, df = vectors
    assert sorted((tuple(r) for r in V.op12(df).collect()), key=repr) == brute_codes(rows)


@pytest.mark.parametrize("n", [1, 5, 64])
def test_codes_of_few_vectors(vectors, n):
    rows, df = vectors
    got = sorted((tuple(r) for r in V.op12(df.where(f"vec_id between 0 and {n - 1} and vec_id <> 3")).collect()), key=repr)
    assert got == brute_codes([r for r in rows if r[0] is not None and 0 <= r[0] < n and r[0] != 3])


def test_no_vectors(vectors):
    _, df = vectors
    got = V.op12(df.where("vec_id in (-1, -2)"))
    assert got.count() == 0 and got.columns == V.op12(df).columns


def test_too_large_components_are_dropped(spark):
    df = spark.createDataFrame([(1, [1.0] * 32, 0), (2, [1e30] * 32, 0), (3, [-3.0] * 32, 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(r["vec_id"] for r in V.op12(df).collect()) == [1, 3]


def test_partial_distances_find_the_nearest_and_lowest():
    rng = np.random.default_rng(3)
    for k, d, spread in ((1, 1, 3), (64, 4, 4), (40, 6, 1000), (17, 2, 1)):
        book, x = rng.integers(-spread, spread + 1, (k, d)), rng.integers(-spread, spread + 1, (500, d))
        far = ((x[:, None] - book) ** 2).sum(2)
        code, best = V.nearest(x, book)
        assert (code == far.argmin(1)).all() and (best == far.min(1)).all()


def test_decoding_gives_the_entries():
    books = np.arange(16 * 3 * 2).reshape(16, 3, 2)
    assert (V.decode(bytes([2] * 16), books) * V.STEPS == books[:, 2].reshape(-1)).all()


# --- byte-level BPE


@pytest.fixture(scope="module")
def ranks(vocab):
    return B.read_ranks(vocab("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_of_the_library(odd_docs, vocab, library):
    got = sorted((tuple(r) for r in B.op13(odd_docs, vocab("byte_bpe_50k.tiktoken")).collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_no_texts(no_docs, vocab):
    assert B.op13(no_docs, vocab("byte_bpe_50k.tiktoken")).count() == 0


def test_ids_and_bytes_as_columns(spark, vocab, library):
    df = spark.createDataFrame([("a b'll  \n x", 1, 2), (None, 3, 4), ("<|endoftext|>", 5, 6)], "text string, `k.0` int, ids int")
    coded = B.encode_column(df, vocab("byte_bpe_50k.tiktoken"), ["k.0"])
    assert {r["k.0"]: r["ids"] for r in coded.collect()} == {1: library.encode_ordinary("a b'll  \n x"), 3: [], 5: library.encode_ordinary("<|endoftext|>")}
    back = B.decode_column(coded, vocab("byte_bpe_50k.tiktoken"), ["k.0"])
    assert {r["k.0"]: bytes(r["bytes"]) for r in back.collect()} == {1: b"a b'll  \n x", 3: b"", 5: b"<|endoftext|>"}


def test_bytes_that_are_no_text(spark, vocab, library):
    df = spark.sql("select 1 as doc_id, cast(unhex('61ff62') as string) as text")
    row = B.encode_column(df, vocab("byte_bpe_50k.tiktoken"), ["doc_id"]).first()
    assert row["ids"] == library.encode_ordinary("a�b")


def test_hash_is_minimal_and_perfect(ranks):
    v = B.Vocabulary.build(ranks)
    assert sorted(v.ids.tolist()) == sorted(ranks.values()) and len(v.moves) == len(ranks)
    rng = random.Random(4)
    others = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 20))) for _ in range(2000)] + [t + b"q" for t in list(ranks)[:2000]] + [t[:-1] + b"\x00" for t in list(ranks)[300:2000]]
    spans = [*ranks, *others]
    ends = np.cumsum([len(s) for s in spans])
    found = v.find(np.frombuffer(b"".join(spans), np.uint8), ends - [len(s) for s in spans], ends)
    assert found.tolist() == [ranks.get(s, -1) for s in spans]
    small = B.Vocabulary.build({b"a": 7})
    assert small.find(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2])).tolist() == [7, -1]


def test_merges_of_the_library(ranks, library):
    rng = random.Random(6)
    for n in (1, 2, 3, 9, 60, 500):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "éèñ漢"):
            word = "".join(rng.choice(letters) for _ in range(n))
            ids = library.encode_ordinary(word)
            if word.encode() not in ranks:
                assert B.merged(word.encode(), ranks) == ids


def test_texts_of_hypothesis(ranks, library):
    hypothesis = pytest.importorskip("hypothesis")
    from hypothesis import strategies as st

    v = B.Vocabulary.build(ranks)
    encoder, decoder = B.Encoder(v), B.Decoder(v)
    piece = st.one_of(st.text(max_size=6), st.sampled_from([" ", "  ", "\n", "'s", "'ll", "the", "　", "\x85", "1", "é"]))

    @hypothesis.settings(max_examples=150, deadline=None)
    @hypothesis.given(st.lists(st.lists(piece, max_size=8).map("".join), min_size=1, max_size=4))
    def check(texts):
        texts = [t.encode("utf-8", "replace").decode() for t in texts]
        ids, n = encoder.encode(texts)
        cut = np.concatenate([[0], np.cumsum(n)])
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]
        assert decoder.decode(ids, cut)[0] == "".join(texts).encode()

    check()


def test_queries_are_registered():
    assert {"op11_collocations", "op12_vector_codes", "op13_byte_bpe"} <= set(Q.QUERIES)
    assert {"op11_collocations", "op12_vector_codes"} <= set(Q.ORACLES)
