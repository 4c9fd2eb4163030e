"""Each stage on its own input, and the whole pipeline, against brute force."""

import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P

from .test_dedup import AZ, brute_hits, brute_lines
from .test_screens import brute_language

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def brute_near(kept, num):
    """One row of each group: the one with the least id, and of equal rows one; rows without an id or without words stay.

    Of several texts with the least id any may stay: each group is given as its ids and texts that could.
    """
    sets = []
    for _, t, _ in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    usable = [i for i, r in enumerate(kept) if r[0] is not None and sets[i]]
    for i in usable:
        for j in usable:
            if j < i and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in usable:
        groups.setdefault(find(i), []).append(kept[i])
    chosen = [sorted({(r[0], r[1]) for r in g if r[0] == min(x[0] for x in g)}) for g in groups.values()]
    return chosen, [(r[0], r[1]) for i, r in enumerate(kept) if i not in usable]


def near_agrees(got, kept, num):
    """Whether the (doc_id, text) rows got are one of each group of the rows kept, and the rows in no group."""
    got, (groups, single) = Counter((r[0], r[1]) for r in got), brute_near(kept, num)
    single = Counter(single)
    return all(sum(got[x] for x in g) == 1 for g in groups) and sum(got.values()) == len(groups) + sum(single.values()) and all(got[k] == n for k, n in single.items())


def test_language_stage(spark, odd_docs, no_docs):
    out = P.language_id(spark, odd_docs, SF)
    assert out.columns == odd_docs.columns
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert not kept & {4, 5, 6} and {1, 9, 10, 100} <= kept
    a = {tuple(r) for r in out.where("doc_id = 100").collect()}
    assert a == {tuple(r) for r in odd_docs.where("doc_id = 100").collect()}
    assert P.language_id(spark, no_docs, SF).count() == 0


def test_language_stage_against_brute_force(spark):
    """The stage's network, applied by hand to short documents and to probes that no language should claim."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    probes = [(10_000_001, "12345 67890"), (10_000_002, None), (10_000_003, "漢字漢字 漢字"), (10_000_004, "zq xj kv")]
    few = docs.unionByName(spark.createDataFrame(probes, "doc_id long, text string"), allowMissingColumns=True)
    net = P.langid.fit(few, F.expr("crc32(cast(doc_id as string)) % 5 <> 0"))
    kept = {r["doc_id"] for r in P.language_id(spark, few, SF).select("doc_id").collect()}
    for r in few.where("coalesce(length(text), 0) < 400").collect():
        label, score = brute_language(net, r["text"] or "")
        if abs(score - P.MIN_LANGUAGE) > 1e-3:
            assert (r["doc_id"] in kept) == (label != "und" and score >= P.MIN_LANGUAGE), r["doc_id"]


def test_line_stage(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    out = P.line_cleaning(spark, docs, SF)
    assert out.columns == docs.columns
    want = []
    for (d, t, s), x in zip(rows(docs), brute_lines(rows(docs), 5)):
        if x == t or x.strip(" "):
            want.append((d or 0, x or ""))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted(want)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    assert P.line_cleaning(spark, no_docs, SF).count() == 0


def test_copies_over_many_sites_outlive_the_line_stage(spark):
    """Copies and near copies over 12 sites keep their lines; a line of other texts on 6 sites goes; one copy is left in the end."""
    body = [f"w{i} x{i} y{i} z{i}" for i in range(60)]
    near = lambda i: "\n".join([*body[:30], f"edit {i}", *body[30:]])
    rows = [(i, "\n".join(["copied"] + body[::-1]), f"s{i}") for i in range(12)] + [(100 + i, near(i), f"s{i}") for i in range(12)]
    rows += [(200 + i, f"all rights reserved\nown a{i} b{i} c{i} d{i} e{i}", f"s{i}") for i in range(6)] + [(None, "copied again", f"s{i}") for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = P.line_cleaning(spark, docs, SF)
    want = [(d, t.replace("all rights reserved\n", ""), s) for d, t, s in rows]
    key = lambda r: str(r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    left = [r["doc_id"] for r in P.near_dedup(spark, out, SF).collect() if r["doc_id"] is not None]
    assert sorted(left) == [0, 100, *range(200, 206)]


def test_near_stage(spark, odd_docs, no_docs):
    out = P.near_dedup(spark, odd_docs, SF)
    assert out.columns == odd_docs.columns
    assert near_agrees(rows(out), rows(odd_docs), 80)
    assert P.near_dedup(spark, no_docs, SF).count() == 0


def test_near_stage_judges_rows_of_one_id_by_their_texts(spark):
    x, y = "a b c d e f g h i j", "k l m n o p q r s t"
    z = y + " u"  # 6 of 7 shingles
    make = lambda r: spark.createDataFrame([(d, t, "s") for d, t in r], "doc_id long, text string, source string")
    left = lambda r: sorted((d["doc_id"], d["text"]) for d in P.near_dedup(spark, make(r), SF).collect())
    assert left([(3, x), (5, x), (5, y)]) == [(3, x), (5, y)]
    assert left([(5, y), (5, y), (5, x), (7, "")]) == [(5, x), (5, y), (7, "")]
    assert len(left([(5, y), (5, z), (9, y), (9, z)])) == 1 and left([(2, z), (5, y), (5, x)]) == [(2, z), (5, x)]


def test_decontamination_stage(spark, odd_docs, no_docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    planted = spark.createDataFrame([(500, "before " + bench[0]["text"] + " after"), (None, bench[1]["text"])], "doc_id long, text string")
    docs = odd_docs.unionByName(planted, allowMissingColumns=True)
    out = P.decontamination(spark, docs, SF)
    hits = brute_hits([(i, r[1]) for i, r in enumerate(rows(docs))], [tuple(b) for b in bench])
    want = [r for r, h in zip(rows(docs), hits) if not h[5]]
    key = lambda r: str(r[:2])
    assert sorted(rows(out), key=key) == sorted(want, key=key) and len(want) == odd_docs.count()
    assert P.decontamination(spark, no_docs, SF).count() == 0


def test_run(spark, vocab):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = P.language_id(spark, docs, SF)
    assert first.count() == docs.count()  # all of these are in a known language
    kept = rows(docs)
    kept = [(d, x, s) for (d, t, s), x in zip(kept, brute_lines(kept, 5)) if x == t or x.strip(" ")]
    groups, single = brute_near(kept, 80)
    assert all(len(g) == 1 for g in groups)
    kept = [(*g[0], None) for g in groups] + [(*r, None) for r in single]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [r for r, h in zip(kept, brute_hits([(r[0], r[1]) for r in kept], bench)) if not h[5]]
    sp = sentencepiece.SentencePieceProcessor(model_file=vocab("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["ids"] for r in P.run(spark, SF).collect()}
    assert got == {d: sp.encode(t) for d, t, _ in kept}


def test_stages_are_listed():
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding"]
    assert P.ORACLE_SQL is None
    with pytest.raises(TypeError):
        P.STAGES[0][1]()
