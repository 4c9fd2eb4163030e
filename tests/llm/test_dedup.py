"""Operators 7, 8 and 10 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tallystone.llm import decontaminate as D
from tallystone.llm import line_dedup as L
from tallystone.llm import minhash as M

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- line dedup


def brute_lines(rows, sites):
    spread = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if source is not None and (s := line.strip(" \t\r\f\v")):
                spread[s].add(source)
    shared = {s for s, v in spread.items() if len(v) >= sites}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r\f\v") not in shared) for _, t, _ in rows]


@pytest.mark.parametrize("sites", [1, 2, 3, 5])
def test_line_dedup(spark, odd_docs, sites):
    rng = random.Random(sites)
    pool = [f"line {i}" for i in range(12)]
    extra = [(200 + i, "\n".join(rng.choice(pool + ["", "  line 1 ", f"own {i}"]) for _ in range(rng.randint(0, 8))), f"s{rng.randint(0, 6)}") for i in range(80)]
    docs = odd_docs.drop("a.b").unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    out = L.remove_lines(docs, L.shared_lines(docs, sites=sites))
    assert out.columns == [*docs.columns, "__lines", "__removed"]
    got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in out.collect()))
    assert got == sorted((r[0] or -1, t or "") for r, t in zip(rows, brute_lines(rows, sites)))


def test_line_dedup_with_hot_lines_and_shuffled_ones(spark, monkeypatch):
    """No table is small enough to broadcast: hot lines and hot texts are, the others are shuffled."""
    from tallystone.llm import common

    monkeypatch.setattr(L, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(L, "BROADCAST_DROPS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(9)
    rows = [(i, "\n".join(["hot", *(f"line {rng.randint(0, 40)}" for _ in range(6)), f"own {i}"]), f"s{rng.randint(0, 6)}") for i in range(60)]
    rows += [(100 + i, "hot\nline 1\ncopied text", f"s{i % 7}") for i in range(30)] + [(200, None, "s1"), (201, "", None), (202, "hot\nline 2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["text"] or "") for r in L.remove_lines(docs, L.shared_lines(docs)).collect())
    assert got == sorted((r[0], t or "") for r, t in zip(rows, brute_lines(rows, 5)))


def test_line_dedup_many_sites_are_decided_by_the_sketch(spark):
    rows = [(i, f"common\nown {i}", f"s{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shared = L.shared_lines(docs)
    assert shared.count() == 1 and shared.first()["n_sites"] is None
    assert L.remove_lines(docs.where("1 = 0"), shared).count() == 0


# --- decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute_near_items(docs, items, length=10, near=20):
    """By document: the items with a phrase whose first word has all its others in the near words from there."""
    phrases = {(str(item), tuple(w[i : i + min(length, len(w))])) for item, text in items if item is not None and (w := words(text)) for i in range(len(w) - min(length, len(w)) + 1)}
    out = []
    for _, text in docs:
        w = words(text)
        out.append({item for item, p in phrases if any(w[i] == p[0] and set(p) <= set(w[i : i + near]) for i in range(len(w)))})
    return out


def brute_hits(docs, items, length=10, near=20):
    close = brute_near_items(docs, items, length, near)
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(length, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    out = []
    for (d, text), c in zip(docs, close):
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(c)))
    return out


def overlapping(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "C", "é", "x9", "漢"]
    w = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, w(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(30)] + [(90, None), (91, "..."), (92, "a b a b"), (93, "a b a b")]
    docs = [(i, w(rng.randint(0, 60))) for i in range(60)] + [(200, items[3][1].upper() + " " + (items[5][1] or "")), (201, None), (202, "")]
    return docs, items


@pytest.mark.parametrize("slice_bytes", [D.SLICE_BYTES, 200])
def test_decontamination(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(D, "SLICE_BYTES", slice_bytes)
    docs, items = overlapping(slice_bytes)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, D.op8(df, bench).collect())) == sorted(brute_hits(docs, items))


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, rows[0][1]), (2, "one two"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, D.op8(odd_docs, bench).collect()), key=key) == sorted(brute_hits(rows, items), key=key)
    assert D.op8(no_docs, bench).count() == 0
    assert D.op8(odd_docs, bench.where("1 = 0")).where("contaminated").count() == 0


@pytest.mark.parametrize("slice_bytes", [D.SLICE_BYTES, 20])
def test_items_without_an_id_hit(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(D, "SLICE_BYTES", slice_bytes)
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "x four five"), (3, "one two"), (4, "one two three four five")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (7, "four five"), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in D.op8(docs, bench).collect()}
    none, seven = (hashlib.sha256(x).hexdigest() for x in (b"", b"7"))
    assert got == {1: (5, 3, 0, none, True, 0), 2: (3, 2, 1, seven, True, 1), 3: (2, 0, 0, none, False, 0), 4: (5, 5, 1, seven, True, 1)}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "red x x x x blue"), (3, "blue"), (4, "red"), (5, "blue red"), (6, None)], "doc_id long, text string")
    queries = spark.createDataFrame([("rb", "red blue"), ("none", ""), (None, "red")], "query string, text string")
    got = D.proximity(D.build_index(docs), queries, near=4).collect()
    assert {tuple(r) for r in got} == {(1, "rb")}


@pytest.mark.parametrize("near", [10, 13, 40])
def test_proximity_is_that_of_brute_force(spark, near):
    rng = random.Random(near)
    vocab = [f"w{i}" for i in range(14)]
    w = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, items = [(i, w(rng.randint(0, 70))) for i in range(60)], [(i, w(rng.choice([1, 2, 5, 8, 10, 12]))) for i in range(25)]
    found = D.find(D.build_index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), near=near)
    assert {r["doc_id"]: set(r["near_ids"]) for r in found.collect()} == dict(enumerate(brute_near_items(docs, items, 10, near)))


def thue_morse(k, a="a", b="b"):
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_of_a_self_similar_pattern_stay_apart(spark):
    """Thue-Morse words and their swaps: a polynomial hash modulo a power of two gives both the same value."""
    long = [w for k in (6, 10, 11, 13) for w in thue_morse(k)]
    docs = [(i, f"one two {w} three four") for i, w in enumerate(long)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = [(0, f"two {long[2]} three"), (1, f"{long[5]} three four"), (2, long[6])]
    assert sorted(map(tuple, D.op8(df, spark.createDataFrame(bench, "item_id long, text string")).collect())) == sorted(brute_hits(docs, bench))
    near = docs + [(100 + i, " ".join(w)) for i, w in enumerate(long[:6])]  # sequences of one-letter words too
    got = [(False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in M.components(spark.createDataFrame(near, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_components(near, 5, 80, 100)


def test_a_block_whose_words_share_a_hash_is_hashed_anew(monkeypatch):
    from tallystone.llm import common

    monkeypatch.setattr(D, "byte_hashes", lambda b, s, e, seed=0: common.byte_hashes(b, s, e, seed) % np.uint64(3 if seed < 2 else 1 << 60))
    text = np.frombuffer(b"alpha-beta-gammagamma-deltadelta-alpha", np.uint8)
    starts, ends, _ = D.spans(text, np.array([0, len(text)]), D.WORD)
    seed, h, order, first = D._terms(text, starts, ends)
    assert seed == 2 and len(first) == 4


# --- near duplicates


def brute_components(rows, words_n, num, den):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        sets[i] = {tuple(w[k : k + words_n]) for k in range(max(len(w) - words_n + 1, 1))} if w else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is None, d or 0, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def families(seed, n=25, size=8, length=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, length, 3 * length]))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(w).upper() if rng.random() < 0.3 else "\t ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,part,num", [(1, 400, 85), (2, 4, 85), (3, 2, 80)])
def test_near_duplicates(spark, monkeypatch, seed, part, num):
    monkeypatch.setattr(M, "PART", part)
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in M.components(df, num=num).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, num, 100)


def test_near_duplicates_chain_over_parts(spark, monkeypatch):
    """A chain: each text is linked with the next one only, in parts too small to hold it."""
    monkeypatch.setattr(M, "PART", 3)
    w = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*(f"n{j}" for j in range(i)), *w[i:60]])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in M.components(df, num=85).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, 85, 100)


def test_near_duplicates_with_hot_keys(spark, monkeypatch):
    """Buckets, labels, groups and copies of more than three rows are looked up from broadcast tables."""
    from tallystone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = families(7, n=8, size=25) + [(5000 + i, "the very same words in each of these") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in M.components(df).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, 80, 100)


def test_parts_are_bounded_by_shingles_too(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_SHINGLES", 100)
    rows = families(8, n=10, size=6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in M.components(df, num=85).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, 85, 100)


def test_small_rounds_take_few_tasks(spark, monkeypatch):
    """A few links in many shuffle partitions: a round's table is not cut into a task and a file a partition."""
    keys = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        links = [(i, i + 1) for i in range(0, 400) if i % 5]
        out = M.connected(spark.createDataFrame(links, "a long, b long"), "few", len(links))
        assert out.rdd.getNumPartitions() <= 32 and len(out.inputFiles()) <= 32
        assert {r["v"]: r["c"] for r in out.collect()} == {v: (v - 1) // 5 * 5 + 1 for e in links for v in e}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_superseded_tables_are_deleted(spark, tmp_path):
    import os

    from tallystone.llm import common

    df = spark.createDataFrame(families(3, n=6), "doc_id long, text string")
    M.components(df).count()
    base = common.shared_dir(spark)
    mine = [p for p in common._written if os.path.isdir(p)]
    assert mine == common._written and not any(os.path.basename(p).split("-")[0] in ("ties", "sets", "links", "joined") for p in mine) and base


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in M.components(odd_docs).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, 80, 100)
    assert M.op10(no_docs).count() == 0


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 1 << 62, 500).astype(np.uint64)])
    s = M.min_max([a, b], 2000)
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.03
    assert M.bands_for(0.85) < M.bands_for(0.8)


def _unmix(x: int) -> int:
    """The inverse of common.mix."""
    m = (1 << 64) - 1
    x ^= x >> 31 ^ x >> 62
    x = x * pow(0x94D049BB133111EB, -1, 1 << 64) & m
    x ^= x >> 27 ^ x >> 54
    x = x * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) & m
    return x ^ x >> 30 ^ x >> 60


def test_words_made_to_collide_under_a_known_seed_are_told_apart(spark):
    """Two words of 16 bytes whose hashes with seed 0 are equal: the second half of one undoes the first half of the other."""
    from tallystone.llm.common import byte_hashes, mix, secret_hashes

    mixed = lambda x: int(mix(np.array([x], np.uint64))[0])
    start = mixed(16 + mixed(0) & (1 << 64) - 1)
    first = b"abcdefghijklmnop"
    rng, blank = random.Random(1), set(b" \t\n\r\x0b\x0c")
    half = lambda b: int.from_bytes(b, "little")
    while True:  # until the made half is one word of ASCII
        own = bytes(rng.choice(b"0123456789") for _ in range(8))
        rest = (mixed(half(first[:8]) ^ start) ^ half(first[8:]) ^ mixed(half(own) ^ start)).to_bytes(8, "little")
        if all(c < 128 and c not in blank and not 65 <= c <= 90 for c in rest):
            break
    made = own + rest
    assert mixed(_unmix(77)) == 77
    pair = np.frombuffer(first + made, np.uint8)
    at = np.array([0, 16])
    h = byte_hashes(pair, at, at + 16)
    assert h[0] == h[1]
    g = secret_hashes(pair, at, at + 16, (5, 6))
    assert g[0] != g[1]
    frame = [f"w{i}" for i in range(20)]
    words = [" ".join([*frame[:10], w, *frame[10:]]) for w in (first.decode(), made.decode(), "other", "abcdefghijklmnop\x00")]
    rows = [(i + 1, t) for i, t in enumerate([*words, " ".join([*frame[:10], "00000213\x13p'1p{3/", *frame[10:]])])]
    got = [(False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in M.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, 80, 100)
    assert len({r[3] for r in got}) == 5


def test_folded_products():
    from tallystone.llm import common

    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = np.arange(0, 3900, 13)
    ends = starts + rng.integers(1, 60, len(starts))
    a, b = common.byte_hash_lanes(buf, starts, ends, (3, 4))
    want = [(int(x) * int(y) & (1 << 64) - 1) ^ (int(x) * int(y) >> 64) for x, y in zip(a, b, strict=True)]
    assert common.secret_hashes(buf, starts, ends, (3, 4)).tolist() == want
