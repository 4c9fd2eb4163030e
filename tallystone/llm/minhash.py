"""Operator 10: near duplicates by min-max hashing, with exact links and components.

A document's set holds its distinct shingles of `words` consecutive words (or its whole sequence of fewer words). Each
of several permutations of 64-bit hashes gives two signature values, the set's least and greatest element under it, so
half as many hash evaluations make a signature. Values are banded; the number of bands follows from the similarity so
that a linked pair shares no band with a probability of 1e-6 at most.

1. Equal sets become one class (an aggregation), so copies meet no candidate search.
2. In every bucket of a band each class is tied to the bucket's least class, first in a few bands, then in the others
   between the components found so far. The components of those ties are the candidate groups: whatever is linked and
   shares a bucket lies in one group. No pairs are made.
3. Full sets of the classes in groups are taken from the whole texts again, and dealt in parts of at most PART classes
   of one group. In a part all pairs are compared exactly, as bit sets; only a spanning forest of its links comes out.
4. A group of several parts is finished exactly: each class outside the group's largest component so far meets every
   part of the group. Components of all links give each document the least id that it reaches.

Components are found by label propagation with shortcuts in DataFrames, written to the shared folder each round.
Buckets, labels, groups and sets of copies that hold many rows are looked up from broadcast tables of a bounded number
of keys, so that their rows stay where they are; no task gets a whole one. The other joins are shuffled at every size,
so that small inputs take the plan of large ones. Tables that nothing reads any more are
deleted. Nothing about all documents comes to the driver, and no bucket, group or candidate list is capped.

The steps' words and shingles are 64-bit hashes (see secret_hashes and run_hashes) whose seeds each use draws anew, so
that no text can be made to collide; two of the shingles that a comparison meets are taken for one with a probability of
2**-64 a pair, and two sets for equal ones with 2**-128.
A miss has a probability of 1e-6 for a pair of large sets at the similarity asked for; of small sets, whose least and
greatest values are not independent, one of up to 1.2e-6. A higher similarity has a far smaller one.

Null and blank texts have an empty set and are linked with nothing. A null id has no component and is kept; it neither
links nor is linked. Rows that repeat an id are judged by their own texts; classes with the same least id count as
one vertex with several sets. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, col, drawn, few, lookup, mark, materialize, mix, release, run_hashes, secret_hashes, small_batches, spans, utf8

#: Values in a band, and the greatest probability that a linked pair shares none.
ROWS, MISS = 6, 1e-6
#: Bands whose ties are joined before those of the others.
FIRST_BANDS = 6
#: Classes of a group that one task compares with one another.
PART = 400
#: Shingles of a group that one task holds.
PART_SHINGLES = 4_000_000
#: Classes in groups that are broadcast to their texts: 32 bytes each.
BROADCAST_CLASSES = 500_000
#: All bytes but blanks (0x20 and 0x09 to 0x0D) make words.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def _distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; np.unique's table of hashes is several times slower on these."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int, seeds: tuple[int, int]) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    buf = LOWER[buf]
    starts, ends, row = spans(buf, offsets, WORD)
    h = secret_hashes(buf, starts, ends, seeds)
    n = np.bincount(row, minlength=len(offsets) - 1)
    last = np.cumsum(n)
    if len(h):
        first = np.arange(len(h))
        whole = first + words <= np.repeat(last, n)
        at = first[whole]
        full = run_hashes(h, at, words)
        k = np.bincount(row[whole], minlength=len(n))
    else:
        full, k = h, n
    ends_of = np.cumsum(k)
    out = []
    for i in range(len(n)):
        if k[i]:
            out.append(_distinct(full[ends_of[i] - k[i] : ends_of[i]]))
        elif n[i]:
            out.append(run_hashes(h, last[i : i + 1] - n[i], int(n[i])))
        else:
            out.append(h[:0])
    return out


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Least and greatest values under each permutation x -> a x + b (a odd, modulo 2**64): rows of sets, all not empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for k in range(permutations):
        y = flat * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]
        out[:, 2 * k] = np.minimum.reduceat(y, first)
        out[:, 2 * k + 1] = np.maximum.reduceat(y, first)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, seeds: tuple[int, int], rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands): a 128-bit digest of the set, and a 64-bit key for each band."""
    small_batches(docs.sparkSession)
    permutations = -(-bands * rows // 2)
    source = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                sets = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words, seeds)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                digest, keys = np.zeros((2, j - i), np.uint64), np.zeros((j - i, bands), np.uint64)
                if len(some):
                    filled = [sets[k] for k in some]
                    flat, first = np.concatenate(filled), np.cumsum([0, *n[some][:-1]])
                    for d, seed in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
                        digest[d, some] = mix(np.add.reduceat(mix(flat ^ np.uint64(seed)), first) + n[some].astype(np.uint64))
                    values = min_max(filled, permutations)[:, : bands * rows].reshape(len(some), bands, rows)
                    key = np.zeros((len(some), bands), np.uint64)
                    for r in range(rows):
                        key = mix(key * np.uint64(31) + values[:, :, r])
                    keys[some] = mix(key + np.arange(bands, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return source.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def connected(edges: DataFrame, tag: str, rows: int) -> DataFrame:
    """(v, c): the least vertex that each vertex of the edges (a, b) reaches; rows is about their number, or more."""
    spark, since = edges.sparkSession, mark()
    both = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    both = materialize(few(both, 2 * rows), tag)
    rows = both.count()
    # n is a vertex's number of neighbours, the rows that look its label up
    labels = materialize(few(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("c"), F.count("*").alias("n")), rows), tag)
    while True:
        before = labels
        seen = lookup(both, labels.select(F.col("v").alias("b"), "c", "n"), ["b"], shuffled=True).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        step = materialize(few(labels.join(seen.hint("merge"), "v").select("v", "n", F.col("c").alias("old"), F.least("c", "m").alias("c")), rows), tag)
        used = step.groupBy("c").agg(F.count("*").alias("n"))
        root = materialize(few(used.join(step.select(F.col("v").alias("c"), F.col("c").alias("r")).hint("merge"), "c"), rows), tag)
        if not step.where("c <> old").limit(1).count():
            out = materialize(step.select("v", "c"), tag)
            release(spark, since, out)
            return out
        moved = lookup(step.select("v", F.col("n").alias("degree"), "c"), root, ["c"], shuffled=True)
        labels = materialize(few(moved.select("v", F.least("c", "r").alias("c"), F.col("degree").alias("n")), rows), tag)
        release(spark, since, both, labels)


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of bits over the shingles that at least two of the sets hold; large inputs go by ranges of hashes."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    parts = min(64, 1 << max(0, len(flat) >> 19).bit_length())
    out = []
    for k in range(parts):
        inside = slice(None) if parts == 1 else np.flatnonzero(flat >> np.uint64(58) & np.uint64(parts - 1) == k)
        _, number, count = np.unique(flat[inside], return_inverse=True, return_counts=True)
        keep = count[number] > 1
        renumber = np.cumsum(count > 1) - 1
        c, r = renumber[number[keep]], owner[inside][keep]
        bits = np.zeros((len(sets), (int((count > 1).sum()) + 63) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits.reshape(-1), r.astype(np.int64) * bits.shape[1] + c // 64, np.uint64(1) << (c % 64).astype(np.uint64))
        out.append(bits)
    return out[0] if parts == 1 else np.hstack(out)


def forest(ids: list[int], sets: list[np.ndarray], parts: list[int], num: int, den: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, or with parts 0 and 1 both present, of those from part 0 to any set.

    Sets are linked if den * intersection >= num * union. Sets with equal labels count as joined from the start.
    """
    n = np.array([len(s) for s in sets], np.int64)
    bits = _bits(sets)
    root = np.arange(len(ids))
    if labels is not None:
        seen: dict[int, int] = {}
        root = np.array([seen.setdefault(x, i) for i, x in enumerate(labels)])
    across = 1 in parts
    out = []
    for i in range(len(ids)):
        if across and parts[i]:
            continue
        j = np.flatnonzero(root != root[i])
        if not across:
            j = j[j > i]
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        j = j[den * small >= num * large]  # else no intersection is large enough
        for a in range(0, len(j), 256):
            k = j[a : a + 256]
            k = k[root[k] != root[i]]
            common = np.bitwise_count(bits[k] & bits[i]).sum(1, dtype=np.int64)
            for m in k[den * common >= num * (n[i] + n[k] - common)]:
                if root[m] != root[i]:
                    out.append((ids[i], ids[m]))
                    root[root == root[m]] = root[i]
    return out


def _compare(members: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Links (a, b) from groups of rows (keys, rep, part, label, s)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["rep", "s"]).sort_values("rep", kind="stable")
        sets = [np.frombuffer(s, np.uint64) for s in group["s"]]
        links = forest(group["rep"].tolist(), sets, group["part"].tolist(), num, den, group["label"].tolist())
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return members.groupBy(*keys).applyInPandas(run, "a long, b long")


def _ties(keyed: DataFrame, rows: int) -> DataFrame:
    """(a, b): the vertices (v, bands) of each bucket, tied to the bucket's least one; rows is about the number of (v, band)."""
    keyed = keyed.select("v", F.explode("bands").alias("k"))
    least = keyed.groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("z"), F.count("*").alias("n")).where("a <> z").select("k", "a", "n")
    return lookup(keyed, materialize(few(least, rows), "buckets"), ["k"], shuffled=True).where("a <> v").select("a", F.col("v").alias("b"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; linked means den * intersection >= num * union."""
    spark, since = docs.sparkSession, mark()
    bands, seeds = bands_for(num / den), drawn()
    sig = materialize(signatures(docs, id_col, text_col, words, bands, seeds), "signatures")
    n = sig.count()
    usable = sig.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("size"), F.count("*").alias("n"))
    classes = materialize(few(classes, n), "classes")
    # The first bands join most of a large group, so that the others tie few vertices: ties stay near the number of classes.
    ties = lambda t, first, k: _ties(t.select("v", F.slice("bands", first, k).alias("bands")), n * k)
    some = connected(ties(classes.withColumnRenamed("rep", "v"), 1, FIRST_BANDS), "ties", n * FIRST_BANDS)
    joined = materialize(few(classes.join(some.hint("merge"), classes.rep == some.v, "left").select("rep", "size", F.coalesce("c", "rep").alias("v"), "bands"), n), "joined")
    rest = connected(ties(joined, FIRST_BANDS + 1, bands), "ties", n * bands)
    group = joined.select("rep", "size", F.col("v").alias("w")).join(rest.hint("merge"), F.col("w") == rest.v, "left").select("rep", "size", F.coalesce("c", "w").alias("c"))
    group = materialize(few(group, n), "grouped")
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("long").alias("parts")
    dealt = group.groupBy("c").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1").select("c", "n", F.col("n").alias("members"), parts)
    group = materialize(few(lookup(group.select("rep", "c"), materialize(few(dealt, n), "groups"), ["c"], shuffled=True), n), "groups")
    sets = materialize(_sets(docs, id_col, text_col, words, group, seeds), "sets")
    first = sets.select("c", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("p"), "rep", F.lit(0).alias("part"), F.col("rep").alias("label"), "s")
    links = materialize(_compare(first, ["c", "p"], num, den), "links")
    large = sets.where("parts > 1")
    if large.limit(1).count():
        links = _finish(large, links, num, den, n)
    label = connected(links, "linked", n)
    found = classes.join(label.hint("merge"), classes.rep == label.v, "left").select("s1", "s2", F.coalesce("c", "rep").alias("component_id"), "n")
    found = materialize(few(found, n), "found")
    release(spark, since, sig, found)
    own = F.coalesce("component_id", "doc_id")
    out = few(lookup(sig.select("doc_id", "n_shingles", "s1", "s2"), found, ["s1", "s2"], "left", shuffled=True), n)
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, own).otherwise(F.col("doc_id"))).alias("component_id"))


def _finish(large: DataFrame, links: DataFrame, num: int, den: int, n: int) -> DataFrame:
    """All links that groups of several parts still lack between their components."""
    label = connected(links, "linked", n)
    rows = large.select("c", "members", "parts", "rep", "s").join(label.select(F.col("v").alias("rep"), F.col("c").alias("l")), "rep", "left")
    rows = materialize(rows.select("c", "members", "parts", "rep", "s", F.coalesce("l", "rep").alias("label")), "large")
    sizes = rows.groupBy("c", "label").agg(F.countDistinct("rep").alias("m"), F.any_value("members").alias("n"))
    main = materialize(few(sizes.groupBy("c").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("main"), F.max("m").alias("m"), F.max("n").alias("n")), n), "main")
    rows = lookup(rows, main, ["c"]).where("members > m")
    # Those outside the largest component, in parts, meet every part of the group.
    deal, inner = F.col("parts"), F.ceil(F.col("parts") * (F.col("members") - F.col("m")) / F.col("members")).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    outside = rows.where("label <> main").select("c", F.pmod(F.xxhash64("rep"), inner).alias("p"), every(deal).alias("q"), "rep", F.lit(0).alias("part"), "label", "s")
    others = rows.select("c", every(inner).alias("p"), F.pmod(F.xxhash64("rep"), deal).alias("q"), "rep", F.lit(1).alias("part"), "label", "s")
    return materialize(links.unionByName(_compare(outside.unionByName(others), ["c", "p", "q"], num, den)), "links")


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, group: DataFrame, seeds: tuple[int, int]) -> DataFrame:
    """(c, members, parts, rep, s): the full sets of the classes in candidate groups."""
    rows = docs.select(col(id_col).cast("long").alias("rep"), col(text_col).alias("text"))
    few = group.count() <= BROADCAST_CLASSES  # else the texts are shuffled to their groups
    rows = rows.join(F.broadcast(group) if few else group.hint("merge"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(4))
            for i, j in chunks(offsets):
                sets = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words, seeds)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(4)], pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "members", "parts", "rep", "s"])

    return rows.select("c", "members", "parts", "rep", "text").mapInArrow(run, "c long, members long, parts long, rep long, s binary").where("octet_length(s) > 0")


def op10(docs: DataFrame) -> DataFrame:
    out = components(docs, num=85)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM n
  UNION SELECT l.v2, reach.r FROM reach JOIN (SELECT x AS v1, y AS v2 FROM links UNION ALL SELECT y, x FROM links) l ON reach.v = l.v1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, w.doc_id = coalesce(m.c, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT v, min(r) AS c FROM reach GROUP BY v) m ON w.doc_id = m.v
"""
