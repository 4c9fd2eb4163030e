"""Operator 8: benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents. Each block of documents is one row: its terms (64-bit hashes, sorted, and the
words themselves), and for each term the positions at which it occurs, as gaps. A block's words are compared with one
another when it is built; were two to share a hash, the block would be hashed anew with another seed. The index is
stored in the shared folder. A search looks up all test words in a block at once and compares them with the block's
own, leaves out phrases with an absent term, and takes the postings of each phrase's rarest term, adjusted by the
term's offset, as candidate starts; these are intersected with the other terms' offset-adjusted postings, from rare to
frequent. What remains are exact matches. Proximity matches take the rarest term's postings too, and keep those with
the phrase's first word at most `near - 1` words before or at them and all its other words in the `near` words from there.

Test texts are handed to the tasks in slices of at most SLICE_BYTES, one pass over the index for each slice, one after
the other, so that a large test set costs passes and not memory. The driver holds a slice's text and nothing made of
it. No term is shuffled, so frequent words burden no single task.

A null or empty text has no words and no hits, and a null or empty test text no phrases. Phrases of an item whose id is
null hit like others, but the item is in no list of items. An empty documents table
gives no rows. Repeated documents are judged one by one and repeated test texts all count. Texts are indexed whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_hashes, chunks, col, materialize, small_batches, spans, utf8
from .wordcache import ragged

PHRASE = 10
#: Words from a phrase's first one on that a proximity match may be spread over.
NEAR = 20
#: Test text that one pass over the index takes; the driver holds that much at a time.
SLICE_BYTES = 8 << 20
#: Postings that a search holds at once.
POSTINGS = 1 << 20
#: Bytes that make words: 0-9, a-z (after lower-casing A-Z) and all of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _equal(buf: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, where: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of two buffers are equal, one by one."""
    same = size == sizes
    k = np.flatnonzero(same)
    if len(k):
        n = size[k].astype(np.int64)
        differ = ragged(buf, at[k], n) != ragged(other, where[k], n)
        first = np.cumsum(n) - n
        same[k] = ~np.logical_or.reduceat(differ, first)
    return same


def _terms(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, hashes in ascending order, the words' numbers in that order, and where each distinct word's begin."""
    seed, size = 0, ends - starts
    while True:
        h = byte_hashes(buf, starts, ends, seed)
        order = np.argsort(h, kind="stable")  # positions ascend within a term
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        lead = np.repeat(order[first], np.diff(np.append(first, len(h))))
        # equal hashes of one length up to 8 bytes are of equal words
        check = np.flatnonzero((size[order] > 8) | (size[order] != size[lead]))
        a, b = order[check], lead[check]
        if _equal(buf, starts[a], size[a], buf, starts[b], size[b]).all():
            return seed, h, order, first
        seed += 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: block, doc_ids, n_words, seed, terms, sizes and words of the terms, counts, gaps."""
    small_batches(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                part = LOWER[buf[offsets[i] : offsets[j]]]
                starts, ends, row = spans(part, offsets[i : j + 1] - offsets[i], WORD)
                n = np.bincount(row, minlength=j - i)
                seed, h, order, first = _terms(part, starts, ends)
                gaps = np.diff(order, prepend=0).astype(np.int64)
                gaps[first] = order[first]
                counts, lead = np.diff(np.append(first, len(h))), order[first]
                sizes = ends[lead] - starts[lead]
                parts = (h[first], sizes.astype(np.uint32), ragged(part, starts[lead], sizes), counts.astype(np.uint32), gaps.astype(np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i)),
                        pa.array([n.tolist()], pa.list_(pa.int32())), pa.array([seed], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts],
                    ],
                    names=INDEX,
                )

    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"block string, doc_ids array<{kind}>, n_words array<int>, seed int, terms binary, sizes binary, words binary, counts binary, gaps binary"), "index")


INDEX = ["block", "doc_ids", "n_words", "seed", "terms", "sizes", "words", "counts", "gaps"]


class Block:
    """A block's postings in memory: keys are term number * 2**32 + position, sorted."""

    def __init__(self, n_words: list[int], seed: int, terms: bytes, sizes: bytes, words: bytes, counts: bytes, gaps: bytes):
        self.seed, self.terms, self.counts = seed, np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)
        self.sizes, self.words = np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(words, np.uint8)
        self.first = np.cumsum(self.counts) - self.counts
        g = np.frombuffer(gaps, np.uint32).astype(np.int64)
        total = np.cumsum(g)
        self.positions = total - np.repeat(total[self.first] - g[self.first] if len(g) else total[:0], self.counts)
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) + self.positions
        self.ends = np.cumsum(np.asarray(n_words, np.int64))

    def numbers(self, phrases: Phrases) -> np.ndarray:
        """Term numbers of the phrases' distinct words, -1 where absent."""
        hashes = phrases.hashes(self.seed)
        if not len(self.terms) or not len(hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        k = np.flatnonzero(self.terms[at] == hashes)
        places = np.cumsum(self.sizes) - self.sizes
        same = _equal(phrases.buf, phrases.starts[k], phrases.sizes[k], self.words, places[at[k]], self.sizes[at[k]])
        out = np.full(len(hashes), -1)
        out[k[same]] = at[k[same]]
        return out

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, "right")

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term occurs at a position from low to high."""
        at = np.searchsorted(self.keys, (term << 32) + np.maximum(low, 0))
        return (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term << 32) + high) & (at < len(self.keys)) & (high >= 0)

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of all the given terms, and the index of the term in the argument that each is of."""
        n = self.counts[term]
        owner = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + self.first[term][owner]
        return self.positions[at], owner

    def phrases(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases (a row of term numbers each, all of one length) occur: (phrase, start)."""
        rarity = np.argsort(self.counts[t], axis=1, kind="stable")
        lead = rarity[:, 0]
        start, owner = self.postings(t[np.arange(len(t)), lead])
        start = start - lead[owner]
        start, owner = start[start >= 0], owner[start >= 0]
        for k in range(1, t.shape[1]):
            offset = rarity[owner, k]
            ok = self.has(t[owner, offset], start + offset, start + offset)
            start, owner = start[ok], owner[ok]
        ok = self.doc(start) == self.doc(start + t.shape[1] - 1)
        return owner[ok], start[ok]

    def near(self, t: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the first word of phrases occurs with all the others in the near words from there: (phrase, position)."""
        rarity = np.argsort(self.counts[t], axis=1, kind="stable")
        at, owner = self.postings(t[np.arange(len(t)), rarity[:, 0]])
        for k in range(1, t.shape[1]):  # a posting must have each other word on one side or the other
            ok = self.has(t[owner, rarity[owner, k]], at - near + 1, at + near - 1)
            at, owner = at[ok], owner[ok]
        low = np.searchsorted(self.keys, (t[owner, 0] << 32) + np.maximum(at - near + 1, 0))
        n = np.searchsorted(self.keys, (t[owner, 0] << 32) + at, "right") - low
        first = self.keys[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)] & 0xFFFFFFFF
        pairs = np.unique((np.repeat(owner, n) << 32) + first)
        owner, first = pairs >> 32, pairs & 0xFFFFFFFF
        last = np.minimum(first + near, self.ends[self.doc(first)] if len(first) else first) - 1
        for k in range(t.shape[1]):  # all lie in the first word's document
            ok = self.has(t[owner, rarity[owner, k]], first, last)
            first, owner, last = first[ok], owner[ok], last[ok]
        return owner, first


class Phrases:
    """The phrases of a slice of test texts: length consecutive words of an item, or the whole of a shorter one."""

    def __init__(self, items: list[tuple[str | None, str]], length: int):
        texts = [t.encode() for _, t in items]
        self.names = [name for name, _ in items]
        offsets = np.cumsum([0, *map(len, texts)])
        joined = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        starts, ends, row = spans(joined, offsets, WORD)
        data, seen = joined.tobytes(), {}
        self.word = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        distinct = list(seen)
        self.buf, self.sizes = np.frombuffer(b"".join(distinct), np.uint8), np.array(list(map(len, distinct)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._hashes: dict[int, np.ndarray] = {}
        n = np.bincount(row, minlength=len(items))
        first, size = np.cumsum(n) - n, np.minimum(n, length)
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: first words and items
        for k in np.unique(size[size > 0]).tolist():
            item = np.flatnonzero(size == k)
            count = n[item] - k + 1
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            self.by[k] = np.repeat(first[item], count) + place, np.repeat(item, count)

    def hashes(self, seed: int) -> np.ndarray:
        if seed not in self._hashes:
            self._hashes[seed] = byte_hashes(self.buf, self.starts, self.starts + self.sizes, seed)
        return self._hashes[seed]

    def found_in(self, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, items, rows of term numbers) of the phrases all of whose words are in the block."""
        number = block.numbers(self)
        absent = np.concatenate([[0], np.cumsum(number[self.word] < 0)])
        for length, (start, item) in self.by.items():
            ok = absent[start + length] == absent[start]
            start, item = start[ok], item[ok]
            rarest = np.full(len(start), 1 << 40)
            for k in range(length):
                rarest = np.minimum(rarest, block.counts[number[self.word[start + k]]])
            for a, b in chunks(np.concatenate([[0], np.cumsum(rarest)]), POSTINGS):
                for c in range(a, b, POSTINGS // 16):
                    d = min(b, c + POSTINGS // 16)
                    yield length, item[c:d], number[self.word[start[c:d, None] + np.arange(length)]]


_phrases: dict[str, Phrases] = {}


def _slices(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, str]]]:
    """The test rows as (id, text), in lists of about SLICE_BYTES at most."""
    rows = items.select(col(id_col).cast("string").alias("item"), col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SLICE_BYTES) or 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item"], r["text"]) for r in part.collect()]


def find(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", length: int = PHRASE, near: int = 0) -> DataFrame:
    """Matches by document: (doc_id, n_words, n_hit, item_ids, near_ids).

    A phrase is length consecutive words of an item, or the whole of a shorter item. n_hit counts the words inside
    any occurrence of any phrase; item_ids are the items (as strings, sorted) with an occurring phrase. near_ids are
    those with a phrase whose first word has all its others in the `near` words from there; none if near is 0.
    """
    spark = index.sparkSession
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    slices = _slices(items, item_col, text_col)
    parts = []
    rows = next(slices)
    while rows is not None:
        following = next(slices, None)
        shared = spark.sparkContext.broadcast(rows)
        part = _find(index, shared, kind, length, near)
        if parts or following is not None:  # one slice after the other
            part = materialize(part, "slice")
            shared.unpersist()
        parts.append(part)
        rows = following
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"), "item_ids", "near_ids")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # one row a document and slice: a bounded group
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("item_ids", "near_ids")]
    out = out.groupBy("block", "ordinal").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), *lists)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    merged = F.aggregate("hits", zero, lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"])
    return out.select("doc_id", "n_words", merged.alias("n_hit"), "item_ids", "near_ids")


def _find(index: DataFrame, shared, kind: str, length: int, near: int) -> DataFrame:
    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        if tag not in _phrases:  # once a worker and slice
            _phrases.clear()
            _phrases[tag] = Phrases(shared.value, length)
        phrases = _phrases[tag]
        for batch in batches:
            for r in range(batch.num_rows):
                n_words = batch.column(2)[r].as_py()
                block = Block(n_words, *(batch.column(k)[r].as_py() for k in range(3, len(INDEX))))
                total = int(block.ends[-1]) if len(n_words) else 0
                cover, items, close = np.zeros(total + 1, np.int64), [set() for _ in n_words], [set() for _ in n_words]
                for n, item, terms in phrases.found_in(block):
                    which, start = block.phrases(terms)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + n, -1)
                    _note(items, phrases.names, item[which], block.doc(start))
                    if near:
                        which, start = block.near(terms, near)
                        _note(close, phrases.names, item[which], block.doc(start))
                hit = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                hits: list[list[dict]] = [[] for _ in n_words]
                for a, b in edges.reshape(-1, 2).tolist():
                    while a < b:  # two documents' hits may touch
                        d = int(block.doc(np.array([a]))[0])
                        end, base = int(block.ends[d]), int(block.ends[d] - n_words[d])
                        hits[d].append({"start": a - base, "end": min(b, end) - base})
                        a = min(b, end)
                lists = [pa.array([sorted(x) for x in found], pa.list_(pa.string())) for found in (items, close)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[r].as_py()] * len(n_words), pa.string()), pa.array(range(len(n_words)), pa.int32()), batch.column(1)[r].values,
                        pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(span)), *lists,
                    ],
                    names=["block", "ordinal", "doc_id", "n_words", "hits", "item_ids", "near_ids"],
                )

    return index.mapInArrow(run, f"block string, ordinal int, doc_id {kind}, n_words long, hits array<struct<start:long,end:long>>, item_ids array<string>, near_ids array<string>")


def _note(found: list[set], names: list[str | None], item: np.ndarray, doc: np.ndarray) -> None:
    for p in np.unique((item << 32) + doc).tolist():
        if (name := names[p >> 32]) is not None:
            found[p & 0xFFFFFFFF].add(name)


def proximity(index: DataFrame, queries: DataFrame, query_col: str = "query", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """(doc_id, query) where a query's first word has all its other words in the near words from there."""
    out = find(index, queries, query_col, text_col, 1 << 30, near)
    return out.select("doc_id", F.explode("near_ids").alias("query"))


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = find(build_index(docs), benchmark, near=NEAR)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_ids").cast("long").alias("n_near"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, x.item_id, g.i, g.n FROM grams g JOIN windows x ON g.n = x.n AND g.s = x.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
positions AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near
  FROM (SELECT doc_id, w, i, w[i] AS first FROM positions) p
  JOIN (SELECT DISTINCT item_id, w[i:i + n - 1] AS phrase, w[i] AS first FROM starts) x USING (first)
  WHERE list_has_all(w[i:i + 19], phrase) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
