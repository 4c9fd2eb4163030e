"""Operator 9: token ids in Re-Pair compressed shards.

Every text is encoded by a byte-level BPE tokenizer and ends with id 0. Documents go in ascending order of doc_id into
shards of about SHARD ids. In a shard, pairs of neighbouring symbols are replaced by new symbols until no pair occurs
LEAST times; the shard stores the pair that each new symbol stands for, and how many ids it expands to, so that a
reader finds any range of ids by a sum of expansion lengths and expands that range only. New symbols start above the
tokenizer's greatest id, added tokens included; a shard's symbols take 2 bytes, or 4 where 2 do not hold them.

Each distinct pre-token is encoded by the tokenizers library once a worker, those of a blank and letters JOINED at a
time, as the library cuts their joined text into the same pre-tokens; texts are cut into pre-tokens in numpy by
the byte-level scheme's pattern (BPE never joins across pre-tokens, so this changes no id; a test compares both).
Texts that hold the string of an added token go to the library whole, which makes that token's id of it.

A shard is one row: part and seq give its place, doc_ids and lengths its documents, blob the bytes (see pack). Null
and empty texts have only the end id. Null ids come first and equal ids stand in the order of their texts' hashes; a
document is never split, so that one of more than SHARD ids makes its own shard. An empty table makes no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize, small_batches
from .wordcache import WordCache, code_points, ragged, text_chunks

END = 0
SHARD = 1 << 19
#: A rule takes 8 bytes and saves a symbol of 2 each time that it is used: pairs of fewer occurrences save little.
LEAST = 8
#: Text bytes of a range partition, and how many bytes of text a stored byte may hold.
PART_BYTES, RATIO = 48 << 20, 4
#: Pre-tokens that go to the library in one text.
JOINED = 64
MAGIC = b"RPG2"
#: Fixed value: the byte-level scheme's pre-token pattern, with its notion of white space spelled out.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 white space, 1 letters, 2 numbers, 3 others, by code point."""
    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, p in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, rf"[{_WS}]+")):
        for m in regex.finditer(p, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = k  # runs never span the surrogates, which are of class 3
    out[0xD800:0xE000] = 3
    return out


def pre_tokens(texts: list[str], points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens, and the text of each."""
    n = len(points)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = _classes()[points]
    filled = offsets[:-1][np.diff(offsets) > 0]
    top, bottom = np.zeros(n, bool), np.zeros(n, bool)
    top[filled] = True
    bottom[np.append(filled[1:], n) - 1] = True
    blank = kind == 0
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], before[0], after[:-1], after[-1] = kind[:-1], 0, kind[1:], 0
    space_before = np.zeros(n, bool)
    space_before[1:] = points[:-1] == 32
    word = (before != kind) & ~space_before
    gap = (after != 0) & ~bottom | (before != 0)
    start = np.where(blank, gap, word) | top
    # contractions: these texts go through the pattern itself
    quote = np.flatnonzero(points[:-1] == 39)
    quote = quote[np.isin(points[quote + 1], [ord(c) for c in "stmdrvl"])]
    odd = np.unique(np.searchsorted(offsets, quote, "right") - 1)
    for i in odd:
        a, b = offsets[i], offsets[i + 1]
        start[a:b] = False
        start[[a + m.start() for m in PATTERN.finditer(texts[i])]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(offsets, starts, "right") - 1


def _pairs(seq: np.ndarray) -> np.ndarray:
    """The key of the pair at each position."""
    wide = np.uint32 if len(seq) and seq.max() < 1 << 16 else np.uint64
    half = wide(16 if wide is np.uint32 else 32)
    return seq[:-1].astype(wide) << half | seq[1:].astype(wide)


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of positions in unbroken runs every other one, from each run's first."""
    gap = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    place = np.arange(len(at)) - np.repeat(gap, np.diff(np.append(gap, len(at))))
    return at[place % 2 == 0]


_SLOT_BITS = 18


def frequent(seq: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of frequent pairs, the number of the pair at each, the pairs' keys, how often each can be replaced if no
    other is, and the count from which on pairs are frequent: a sixteenth of the greatest or so, least at least. No pair if none is.

    Pairs are counted in hashed slots first; only those in a slot with enough are counted one by one.
    """
    key = _pairs(seq)
    wide, half = key.dtype.type, key.dtype.type(4 * key.itemsize)
    slot = ((key * wide(0x9E3779B97F4A7C15 & (0xFFFFFFFF if key.itemsize == 4 else (1 << 64) - 1))) >> wide(8 * key.itemsize - _SLOT_BITS)).astype(np.intp)
    held = np.bincount(slot, minlength=1 << _SLOT_BITS)
    enough = max(least, int(held.max()) // 16)
    while True:
        at = np.flatnonzero((held >= enough)[slot])
        k = key[at]
        twins = k >> half == k & ((wide(1) << half) - wide(1))
        counted = k[~twins]
        if twins.any():  # "a a a" holds the pair "a a" once
            counted = np.concatenate([counted, key[_alternate(at[twins])]])
        counted = np.sort(counted)
        first = np.flatnonzero(np.concatenate([[True], counted[1:] != counted[:-1]])) if len(counted) else np.zeros(0, np.int64)
        pairs, count = counted[first], np.diff(np.append(first, len(counted)))
        top = int(count.max()) if len(count) else 0
        if top >= least or enough == least:
            break
        enough = least
    enough = max(least, min(enough, top // 4))
    pairs, count = pairs[count >= enough], count[count >= enough]
    if not len(pairs):
        return at[:0], at[:0], pairs, count, enough
    number = np.minimum(np.searchsorted(pairs, k), len(pairs) - 1)
    hit = pairs[number] == k
    return at[hit], number[hit], pairs, count, enough


def repair(ids: np.ndarray, vocab: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): rule k stands for symbol vocab + k, a pair that expands to lengths[k] ids.

    A round replaces all pairs that are at least a sixteenth as frequent as the most frequent one; where their occurrences
    overlap every other one is replaced, from the left, and a pair that loses most of its own so waits for a later
    round. Rounds go on until no pair occurs least times.
    """
    if len(ids) and (ids.min() < 0 or ids.max() >= vocab):
        raise ValueError("an id is outside the vocabulary")
    seq, rules, made, size = ids.astype(np.uint32), [np.zeros((0, 2), np.int64)], 0, np.ones(vocab, np.int64)
    while len(seq) > 1:
        at, number, pairs, count, enough = frequent(seq, least)
        if not len(pairs):
            break
        which = np.empty(len(seq), np.int32)
        which[at] = number
        picked = _alternate(at)
        uses = np.bincount(which[picked], minlength=len(pairs))
        kept = 2 * uses >= enough
        if not kept.all():
            if not kept.any():
                kept = np.arange(len(pairs)) == np.argmax(count)
            picked = _alternate(at[kept[number]])
            uses = np.bincount(which[picked], minlength=len(pairs))
            kept = uses > 0
        symbol = (vocab + made + np.cumsum(kept) - 1).astype(np.uint32)
        half = pairs.dtype.type(4 * pairs.itemsize)
        pair = np.column_stack([pairs >> half, pairs & ((pairs.dtype.type(1) << half) - pairs.dtype.type(1))])[kept].astype(np.int64)
        rules.append(pair)
        made += len(pair)
        size = np.concatenate([size, size[pair].sum(1)])
        keep = np.ones(len(seq), bool)
        keep[picked + 1] = False
        seq[picked] = symbol[which[picked]]
        seq = seq[keep]
    return seq, np.concatenate(rules), size[vocab:]


def pack(ids: np.ndarray, vocab: int) -> bytes:
    """MAGIC, then u32: vocab, bytes a symbol (2 or 4), numbers of rules, symbols and ids; rules (pairs of symbols), lengths (u32), symbols."""
    seq, rules, lengths = repair(ids, vocab)
    width = 2 if vocab + len(rules) <= 1 << 16 else 4
    kind = np.uint16 if width == 2 else np.uint32
    return MAGIC + struct.pack("<IIIII", vocab, width, len(rules), len(seq), len(ids)) + rules.astype(kind).tobytes() + lengths.astype(np.uint32).tobytes() + seq.astype(kind).tobytes()


class Shard:
    """Reads a packed shard: all of it, or any range of ids."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        self.vocab, width, n, m, self.n_ids = struct.unpack_from("<IIIII", blob, 4)
        kind = np.uint16 if width == 2 else np.uint32
        self.rules = np.frombuffer(blob, kind, 2 * n, 24).reshape(n, 2)
        lengths = np.frombuffer(blob[24 + 2 * width * n : 24 + (2 * width + 4) * n], np.uint32)
        self.size = np.concatenate([np.ones(self.vocab, np.int64), lengths])
        self.symbols = np.frombuffer(blob[24 + (2 * width + 4) * n :], kind, m)
        self.ends = self.table = None

    def _step(self, seq: np.ndarray) -> np.ndarray:
        """seq with each rule's symbol replaced by its pair."""
        big = seq >= self.vocab
        n = 1 + big
        out = np.repeat(seq, n)
        at = np.cumsum(n)[big] - 1
        pair = self.rules[seq[big] - self.vocab]
        out[at - 1], out[at] = pair[:, 0], pair[:, 1]
        return out

    def expand(self, seq: np.ndarray) -> np.ndarray:
        seq, own = seq.astype(np.int64), self.size[self.vocab :]
        if self.table is None and own.sum() <= 4 * max(self.n_ids, 1 << 16):  # all rules' expansions, once
            flat = self.rules.reshape(-1).astype(np.int64)
            while (flat >= self.vocab).any():
                flat = self._step(flat)
            self.table = np.concatenate([np.arange(self.vocab), flat])
            self.places = np.concatenate([np.arange(self.vocab), self.vocab + np.cumsum(own) - own])
        if self.table is not None:
            return ragged(self.table, self.places[seq], self.size[seq])
        while (seq >= self.vocab).any():
            seq = self._step(seq)
        return seq

    def read(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """ids [start, start + n)."""
        if n is None:
            return self.expand(self.symbols)[start:]
        if self.ends is None:
            self.ends = np.cumsum(self.size[self.symbols])
        i, j = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, start + n, "left")
        base = int(self.ends[i - 1]) if i else 0
        return self.expand(self.symbols[i : j + 1])[start - base : start - base + n]


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str):
    """(encode, vocab): encode maps texts to (flat ids, number of ids of each text); all ids are below vocab.

    A worker keeps it, with its cache of words, from task to task.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # a character of a byte-level token's name is a byte
    sizes[list(vocab.values())] = list(map(len, vocab))
    cache = WordCache()

    def plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, offsets = code_points(texts)
        joined = "".join(texts)
        starts, ends, row = pre_tokens(texts, points, offsets)

        def singly(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return _flat(tokenizer.encode_batch_fast([joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], add_special_tokens=False))

        def new(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            letters = np.concatenate([[0], np.cumsum(_classes()[points] == 1)])
            plain = (points[a] == 32) & (b - a > 1) & (letters[b] - letters[np.minimum(a + 1, b)] == b - a - 1)
            one, many = np.flatnonzero(~plain), np.flatnonzero(plain)
            if len(many) < JOINED:
                return singly(a, b)
            size = b[many] - a[many]
            chosen, ends = ragged(points, a[many], size), np.concatenate([[0], np.cumsum(size)])
            cuts = ends[[*range(0, len(many), JOINED), len(many)]].tolist()
            text = chosen.tobytes().decode("utf-32-le")
            ids, _ = _flat(tokenizer.encode_batch_fast([text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False))
            # where the pre-tokens' bytes end, tokens end
            width = np.cumsum(1 + (chosen >= 0x80) + (chosen >= 0x800).astype(np.int64) + (chosen >= 0x10000))
            token_ends, word_ends = np.cumsum(sizes[ids]), width[ends[1:] - 1]
            last = np.minimum(np.searchsorted(token_ends, word_ends), len(token_ends) - 1)
            if (token_ends[last] != word_ends).any():
                return singly(a, b)
            found = np.diff(last, prepend=-1)
            more, k = singly(a[one], b[one])
            counts = np.zeros(len(a), np.int64)
            counts[many], counts[one] = found, k
            out, at = np.empty(len(ids) + len(more), np.int32), np.cumsum(counts) - counts
            for which, flat in ((many, ids), (one, more)):
                own = counts[which]
                out[np.arange(len(flat)) + np.repeat(at[which] - (np.cumsum(own) - own), own)] = flat
            return out, counts

        ids, n = cache.lookup(points, starts, ends, new)
        return ids, np.bincount(row, weights=n, minlength=len(texts)).astype(np.int64)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, t in enumerate(texts) if any(a in t for a in added)]
        if not odd:
            return plain(texts)
        texts, whole = list(texts), [texts[i] for i in odd]
        for i in odd:
            texts[i] = ""
        ids, n = plain(texts)
        more, counts = _flat(tokenizer.encode_batch_fast(whole, add_special_tokens=False))
        ids = np.insert(ids, np.repeat(np.cumsum(n)[odd], counts), more)
        n[odd] = counts
        return ids, n

    return encode, len(sizes)


def _flat(found: list) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in found]
    counts = np.array([len(x) for x in ids], np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts


def write_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """The stored shards: part, seq, doc_ids, lengths, n_ids, blob."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())  # one vocabulary file, a few MB
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"), F.xxhash64(col(text_col)).alias("h"))
    size = RATIO * int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, without a scan
    if size > 1 << 50:  # not known
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode, vocab = None, 0
        names, lengths, ids = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, names, lengths, ids
            n, flat = np.concatenate(lengths), np.concatenate(ids)
            doc = pa.concat_arrays(names)
            out = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc), pa.array([n.tolist()], pa.list_(pa.int32())), pa.array([len(flat)], pa.int64()), pa.array([pack(flat, vocab)], pa.binary())]
            seq, names, lengths, ids = seq + 1, [], [], []
            return pa.RecordBatch.from_arrays(out, names=["part", "seq", "doc_ids", "lengths", "n_ids", "blob"])

        total = 0
        for batch in batches:
            if encode is None:
                encode, vocab = encoder(model.value)
            texts = batch.column(1).to_pylist()
            for i, j in text_chunks(texts):
                flat, n = encode(texts[i:j])
                stop = np.cumsum(n)
                flat = np.insert(flat, stop, END)  # the end id of each document
                n, stop = n + 1, stop + np.arange(1, j - i + 1)
                a = 0
                while a < j - i:  # whole documents, until the shard is full
                    base = int(stop[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(stop, base + shard - total, "right"))) if total < shard else a
                    if b == a or total and total + int(stop[b - 1]) - base > shard:
                        yield flush()
                        total = 0
                        continue
                    names.append(batch.column(0).slice(i + a, b - a))
                    lengths.append(n[a:b])
                    ids.append(flat[base : int(stop[b - 1])])
                    total += int(stop[b - 1]) - base
                    a = b
        if total:
            yield flush()

    return materialize(rows.select("id", "text").mapInArrow(run, f"part int, seq int, doc_ids array<{kind}>, lengths array<int>, n_ids long, blob binary"), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored bytes."""
    # Where a shard starts: the ids of the parts before it, and of its part's shards before it; one row a shard.
    sizes = shards.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    whole = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    whole = whole.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inner")).join(whole, "part")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n = np.asarray(batch.column(3)[r].as_py(), np.int64)
                ids = Shard(batch.column(4)[r].as_py()).read().astype("<u4")
                stop = np.cumsum(n)
                crc = [zlib.crc32(ids[b - k : b]) for k, b in zip(n.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[r].as_py()] * len(n), pa.int32()), pa.array([batch.column(1)[r].as_py()] * len(n), pa.int32()), batch.column(2)[r].values, pa.array(stop - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("part", "seq", "doc_ids", "lengths", "blob").mapInArrow(run, f"part int, seq int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return docs.join(sizes, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inner") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_documents(write_shards(docs, tokenizer_path))
