"""Operator 13: byte-level BPE from a table of ranks, and back to the bytes.

A text is cut into pre-tokens by the byte-level scheme's pattern, and each goes through two tiers:

1. A minimal perfect hash over the vocabulary (as many slots as tokens) gives the one token that a pre-token could be; a
   comparison of all its bytes tells whether it is. Whole batches are looked up in numpy. The table is built on the
   driver and broadcast: a fixed vocabulary of a few MB.
2. Other pre-tokens are merged: bytes are a linked list, a heap holds its neighbouring pairs by rank and place, and the
   best one is joined until none has a rank. Each such pre-token is merged once a worker while its bounded memory of
   them lasts (see WordCache).

Null and empty texts have no ids. Bytes that are no UTF-8 become U+FFFD first. A pre-token of any length is merged whole,
in time n log n. Null ids and repeated rows are rows like any other; an empty table gives no rows. Only the columns that
are asked for are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_hash_lanes, col, mix, small_batches
from .repair import pre_tokens
from .wordcache import WordCache, code_points, ragged, text_chunks

#: Seeds of the two hashes of a pre-token. Nothing depends on their secrecy: bytes are compared.
SEEDS = (11, 12)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token a line, in base 64, with its id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}


@dataclass
class Vocabulary:
    """Tokens by slot of their minimal perfect hash: bytes are data[starts[slot] : starts[slot] + sizes[slot]]."""

    moves: np.ndarray  # by bucket: what its tokens' second hashes are shifted by, or -1 - the slot of its only token
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    data: np.ndarray

    @staticmethod
    def build(ranks: dict[bytes, int]) -> Vocabulary:
        """Buckets of several tokens take, the fullest first, the least shift that sends all to free slots; the others what is left."""
        tokens = list(ranks)
        n = len(tokens)
        sizes = np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(tokens), np.uint8)
        a, b = byte_hash_lanes(data, starts, starts + sizes, SEEDS)
        bucket = (a % np.uint64(max(n, 1))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=n)
        first = np.cumsum(count) - count
        moves, slot, taken = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, bool)
        for k in np.argsort(-count, kind="stable").tolist():
            if count[k] < 2:
                break
            own = order[first[k] : first[k] + count[k]]
            if len(np.unique(b[own])) < len(own):
                raise ValueError("two tokens have the same two hashes")
            move = 0
            while True:
                at = (mix(b[own] + np.uint64(move)) % np.uint64(n)).astype(np.int64)
                if not taken[at].any() and len(set(at.tolist())) == len(own):
                    break
                move += 1
            moves[k], slot[own], taken[at] = move, at, True
        single = order[first[count == 1]]
        slot[single] = np.flatnonzero(~taken)[: len(single)]
        moves[bucket[single]] = -1 - slot[single]
        back = np.argsort(slot)
        return Vocabulary(moves, np.array([ranks[t] for t in tokens], np.int64)[back], starts[back], sizes[back], data)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The id of each byte span [start, end) that is a token, else -1."""
        n = len(self.ids)
        if not n or not len(starts):
            return np.full(len(starts), -1)
        a, b = byte_hash_lanes(buf, starts, ends, SEEDS)
        move = self.moves[(a % np.uint64(n)).astype(np.int64)]
        slot = np.where(move < 0, -1 - move, (mix(b + np.maximum(move, 0).astype(np.uint64)) % np.uint64(n)).astype(np.int64))
        out = np.where(self.sizes[slot] == ends - starts, self.ids[slot], -1)
        live = np.flatnonzero(out >= 0)
        x, y = _words(buf), _words(self.data)
        at = 0
        while len(live):  # eight bytes at a time
            left = ends[live] - starts[live] - at
            same = _load(x, starts[live] + at, left) == _load(y, self.starts[slot[live]] + at, left)
            out[live[~same]] = -1
            at += 8
            live = live[same & (left > 8)]
        return out


def _words(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) // 8 + 2, np.uint64)
    out.view(np.uint8)[: len(buf)] = buf
    return out


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _load(words: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The up to eight bytes from each place."""
    k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    return (words[k] >> shift | words[k + 1] << np.uint64(1) << (np.uint64(63) - shift)) & _TAIL[np.minimum(left, 8)]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: of all neighbouring pairs the one of the least rank, the leftmost of several, is joined, while there is one."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by first byte of a part: where it ends, where the part before starts
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != e:  # a part of this pair is gone or has grown
            continue
        end[i], end[j] = e, -1
        if e < n:
            before[e] = i
            if (r := ranks.get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        k = before[i]
        if k >= 0 and (r := ranks.get(word[k:e])) is not None:
            heapq.heappush(heap, (r, k, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes lists of texts; keeps the ids of pre-tokens that it has merged."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        raw = v.data.tobytes()
        self.ranks = {raw[a : a + k]: i for a, k, i in zip(v.starts.tolist(), v.sizes.tolist(), v.ids.tolist(), strict=True)}
        self.cache = WordCache()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and how many each text has."""
        points, offsets = code_points(texts)
        starts, ends, row = pre_tokens(texts, points, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        place = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000))])
        raw = "".join(texts).encode()
        buf = np.frombuffer(raw, np.uint8)
        whole = self.vocabulary.find(buf, place[starts], place[ends])
        miss = np.flatnonzero(whole < 0)

        def merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = [merged(raw[i:j], self.ranks) for i, j in zip(place[a].tolist(), place[b].tolist(), strict=True)]
            return np.array([x for ids in found for x in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

        more, n = self.cache.lookup(points, starts[miss], ends[miss], merge)
        counts = np.ones(len(starts), np.int64)
        counts[miss] = n
        at = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        known = whole >= 0
        ids[at[known]] = whole[known]
        ids[np.arange(len(more)) + np.repeat(at[miss] - (np.cumsum(n) - n), n)] = more
        return ids, np.bincount(row, weights=counts, minlength=len(texts)).astype(np.int64)


class Decoder:
    """The bytes of ids."""

    def __init__(self, v: Vocabulary):
        top = int(v.ids.max()) + 1 if len(v.ids) else 0
        self.data, self.starts, self.sizes = v.data, np.zeros(top, np.int64), np.full(top, -1)
        self.starts[v.ids], self.sizes[v.ids] = v.starts, v.sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all lists ids[offsets[i] : offsets[i + 1]], and offsets into them."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or (self.sizes[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        n = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ragged(self.data, self.starts[ids], n).tobytes(), ends[offsets]


@lru_cache(maxsize=2)
def _encoder(held) -> Encoder:
    """A worker keeps it, with its memory of pre-tokens, from task to task."""
    return Encoder(held.value)


def _shared(df: DataFrame, ranks_path: str):
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Vocabulary.build(read_ranks(ranks_path)))


def _columns(df: DataFrame, keep: list[str]) -> tuple[list[Column], str]:
    """The kept columns under numbered names, and their part of a schema."""
    return [col(c).alias(f"k{i}") for i, c in enumerate(keep)], "".join(f"k{i} {df.select(col(c)).schema[0].dataType.simpleString()}, " for i, c in enumerate(keep))


def encode_column(docs: DataFrame, ranks_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and `ids`, the token ids of the text."""
    shared = _shared(docs, ranks_path)
    kept, schema = _columns(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(shared)
            texts = [t.decode("utf-8", "replace") for t in batch.column(0).to_pylist()]
            for i, j in text_chunks(texts):
                ids, n = encoder.encode(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[batch.column(k + 1).slice(i, j - i) for k in range(len(keep))], lists], names=[*[f"k{k}" for k in range(len(keep))], "ids"])

    out = docs.select(F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"), *kept).mapInArrow(run, f"{schema}ids array<int>")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids")


def decode_column(rows: DataFrame, ranks_path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The kept columns and `bytes`, what the ids stand for."""
    shared = _shared(rows, ranks_path)
    kept, schema = _columns(rows, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(shared.value)
            ids, offsets = batch.column(0).flatten().to_numpy(), np.asarray(batch.column(0).offsets)
            data, cut = decoder.decode(ids, offsets - offsets[0])
            values = [data[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k + 1) for k in range(len(keep))], pa.array(values, pa.binary())], names=[*[f"k{k}" for k in range(len(keep))], "bytes"])

    none = F.array().cast("array<int>")
    out = rows.select(F.coalesce(col(ids_col), none).alias("ids"), *kept).mapInArrow(run, f"{schema}bytes binary")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "bytes")


def _ids_digest(ids_col: str, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, n_tokens and ids_sha256, of the ids as little-endian unsigned numbers of 4 bytes; and the ids."""
    kept, schema = _columns(rows, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = batch.column(0).flatten().to_numpy().astype("<u4"), np.asarray(batch.column(0).offsets)
            offsets = offsets - offsets[0]
            sums = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k + 1) for k in range(len(keep))], pa.array(np.diff(offsets), pa.int64()), pa.array(sums), batch.column(0)], names=[*[f"k{k}" for k in range(len(keep))], "n_tokens", "ids_sha256", "ids"])

    out = rows.select(col(ids_col).alias("ids"), *kept).mapInArrow(run, f"{schema}n_tokens long, ids_sha256 string, ids array<int>")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids_sha256", "ids")


def op13(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: its ids, and the bytes that they decode to."""
    coded = _ids_digest("ids", encode_column(docs, ranks_path, ["doc_id"]), ["doc_id"])
    back = decode_column(coded, ranks_path, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
