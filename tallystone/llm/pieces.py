"""Operator 1: SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words of equal length advance together, one character position a step. All substrings that end at the position are
hashed from one prefix sum and looked up in the sorted keys of the pieces; each candidate extends the best path to its
start, and the best candidate of each word is stored as its backpointer. Only substrings as long as some piece are
hashed, and the pieces of every best path are compared with the word itself: an error is raised if a key has lied.

The score of a path follows the model's type, as the model file states it:

* unigram: the sum of the pieces' scores; of equal sums the longest last piece wins.
* BPE: a path has a score only if each two neighbouring pieces are what the merge rule itself makes of the two joined
  texts. One path through every position has that property, and it is the merge rule's own result, so that ids equal
  those of the model's merges. Whether two pieces may stand side by side is found by undoing their merges from the
  latest one and asking at each step whether an earlier merge would have joined them across the border.

Text is normalised as such models do that have no character map: a blank is put first, blanks become U+2581. Words end
before a U+2581 that follows another character (no piece holds one inside; the loader checks that). A character
without a piece becomes its bytes' pieces; in models without those a run of them is one unknown piece. Decoding turns ids into text.

Null and empty texts have no ids; decoding gives an empty text. Texts of any length are encoded whole; repeated rows
get equal ids; an empty table gives no rows. Decoding restores any text, but for U+2581 itself, which becomes a blank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, mix, small_batches
from .wordcache import WordCache, code_points, ragged, text_chunks

BLANK = 0x2581
NEVER = np.int64(1 << 40)
_UNIGRAM, _BPE = 1, 2
#: Leading bits of a key that the table of marks is indexed by, and the memory of border verdicts a worker keeps.
MARK_BITS, MEMO_BITS = 20, 18


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(2 * n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _raw(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of (code point + 1) * base**i over spans: joined texts have raw(a) + base**len(a) * raw(b)."""
    p, q = powers(len(points) + 1)
    c = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * p[:-1], out=c[1:])
    return (c[ends] - c[starts]) * q[starts]


@dataclass
class Model:
    """A model's normal pieces, sorted by their hashes. Pieces are numbered by rank: single characters, then by falling score."""

    name: str  # tells models apart
    bpe: bool
    ids: np.ndarray  # by rank
    scores: np.ndarray
    lengths: np.ndarray
    raw: np.ndarray
    left: np.ndarray  # the merge that makes a piece: ranks; a character's are its own
    right: np.ndarray
    keys: np.ndarray  # sorted
    ranks: np.ndarray  # by sorted key, only pieces that can be made
    all_keys: np.ndarray
    all_ranks: np.ndarray
    known: np.ndarray  # sorted code points with a piece
    byte_ids: np.ndarray  # 256, or none
    unknown: int
    out_bytes: np.ndarray  # all ids' texts, flat
    out_starts: np.ndarray
    out_lengths: np.ndarray
    longest: int
    points: np.ndarray  # all pieces' code points, flat
    places: np.ndarray  # where each rank's start
    marks: np.ndarray  # by the leading bits of a key: whether any piece's key has them

    def find(self, raw: np.ndarray, lengths: np.ndarray, every: bool = False) -> np.ndarray:
        """Ranks of substrings, -1 where there is no such piece."""
        keys, ranks = (self.all_keys, self.all_ranks) if every else (self.keys, self.ranks)
        h = mix(raw + lengths.astype(np.uint64))
        out = np.full(h.shape, -1, np.int64)
        maybe = self.marks[h >> np.uint64(64 - MARK_BITS)]  # most substrings are no piece, and need no probe
        h = h[maybe]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out[maybe] = np.where(keys[at] == h, ranks[at], -1)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merge rule leaves the border between pieces a and b (ranks) standing."""
        a, b = a.copy(), b.copy()
        ok, limit, live = np.ones(len(a), bool), np.full(len(a), NEVER), np.arange(len(a))
        p, _ = powers(self.longest + 1)
        while len(live):
            x, y = a[live], b[live]
            joined = self.find(self.raw[x] + p[self.lengths[x]] * self.raw[y], self.lengths[x] + self.lengths[y], True)
            bad = (joined >= 0) & (joined < limit[live])
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            first = x > y  # undo the later of the two merges; of equal ones, the right
            lim = np.where(first, x, y + 1)
            nx, ny = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
            stuck = np.where(first, nx == x, ny == y)  # a character: undo the other one
            lim = np.where(stuck, np.where(first, y + 1, x), lim)
            mx, my = np.where(stuck & ~first, self.right[x], nx), np.where(stuck & first, self.left[y], ny)
            done = stuck & np.where(first, my == y, mx == x)
            a[live], b[live], limit[live] = mx, my, lim
            live = live[~done]
        return ok


def load(path: str) -> Model:
    """Reads a model file with the sentencepiece library; checks what encoding relies on."""
    import sentencepiece

    with open(path, "rb") as f:
        kind = _model_type(f.read())
    return build(sentencepiece.SentencePieceProcessor(model_file=path), kind)


def _model_type(proto: bytes) -> int:
    """trainer_spec (field 2) . model_type (field 3) of a serialized model; unigram if absent."""

    def fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
        i = 0

        def varint() -> int:
            nonlocal i
            x = s = 0
            while True:
                x |= (b[i] & 127) << s
                s, i = s + 7, i + 1
                if b[i - 1] < 128:
                    return x

        while i < len(b):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            elif tag & 7 == 2:
                n = varint()
                yield tag >> 3, b[i : i + n]
                i += n
            else:
                i += 4 if tag & 7 == 5 else 8

    for k, v in fields(proto):
        if k == 2 and isinstance(v, bytes):
            return next((x for f, x in fields(v) if f == 3 and isinstance(x, int)), _UNIGRAM)
    return _UNIGRAM


def build(sp, kind: int) -> Model:
    """A Model from a SentencePieceProcessor and the model's type."""
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(chr(BLANK) in pieces[i].lstrip(chr(BLANK)) for i in normal):
        raise ValueError("a piece holds U+2581 inside: words cannot be encoded one by one")
    if kind not in (_UNIGRAM, _BPE):
        raise ValueError("only unigram and BPE models are encoded")
    normal.sort(key=lambda i: (len(pieces[i]) > 1, -sp.get_score(i), i))
    texts = [pieces[i] for i in normal]
    points, offsets = code_points(texts)
    raw, lengths = _raw(points, offsets[:-1], offsets[1:]), np.diff(offsets)
    rank = {t: r for r, t in enumerate(texts)}
    left, right, made = np.arange(len(texts)), np.arange(len(texts)), np.ones(len(texts), bool)
    if kind == _BPE:
        for r, t in enumerate(texts):
            if len(t) > 1:
                parts = list(t)
                while len(parts) > 1:
                    best = min((rank.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
                    if best[0] == NEVER:
                        break
                    pair = parts[best[1]], parts[best[1] + 1]
                    parts[best[1] : best[1] + 2] = ["".join(pair)]
                made[r] = len(parts) == 1 and all(p in rank for p in pair)
                if made[r]:
                    left[r], right[r] = rank[pair[0]], rank[pair[1]]
    keys = mix(raw + lengths.astype(np.uint64))
    order = np.argsort(keys)
    usable = order[made[order]]
    marks = np.zeros(1 << MARK_BITS, bool)
    marks[keys >> np.uint64(64 - MARK_BITS)] = True
    byte_ids = np.array([i for i in range(n) if sp.is_byte(i)], np.int32)
    outs = [bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else pieces[i].replace(chr(BLANK), " ").encode() for i in range(n)]
    sizes = np.array(list(map(len, outs)))
    name = hashlib.sha256(repr((kind, pieces, [sp.get_score(i) for i in range(n)])).encode()).hexdigest()
    return Model(
        name, kind == _BPE, np.array(normal, np.int32), np.array([sp.get_score(i) for i in normal]), lengths, raw, left, right, keys[usable], usable, keys[order], order,
        np.unique(points[np.isin(np.arange(len(points)), offsets[:-1][lengths == 1])]), byte_ids, sp.unk_id(), np.frombuffer(b"".join(outs), np.uint8), np.cumsum(sizes) - sizes, sizes, int(lengths.max()), points, offsets[:-1], marks,
    )


class Borders:
    """Remembers Model.compatible's verdicts in a table of fixed size; a newer pair takes an older one's slot."""

    def __init__(self, m: Model) -> None:
        self.m, self.table = m, np.full(1 << MEMO_BITS, -1, np.int64)  # pair * 2 + verdict

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a << 32) | b
        slot = mix(pair.astype(np.uint64)) >> np.uint64(64 - MEMO_BITS)
        found = self.table[slot]
        ok, miss = (found & 1) == 1, np.flatnonzero(found >> 1 != pair)
        if len(miss):
            new, back = np.unique(pair[miss], return_inverse=True)
            verdict = self.m.compatible(new >> 32, new & 0xFFFFFFFF)
            ok[miss] = verdict[back]
            self.table[slot[miss]] = pair[miss] << 1 | ok[miss]
        return ok


def viterbi(m: Model, borders: Borders, points: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ranks of words of one length (all of known characters), flat, and each word's number of pieces."""
    n = len(starts)
    grid = points[starts[:, None] + np.arange(length)]
    p, q = powers(length + 1)
    c = np.zeros((n, length + 1), np.uint64)
    np.cumsum((grid.astype(np.uint64) + np.uint64(1)) * p[:-1], axis=1, out=c[:, 1:])
    last, score = np.full((n, length + 1), -1, np.int64), np.full((n, length + 1), -np.inf)
    score[:, 0] = 0
    for e in range(1, length + 1):
        size = np.arange(min(e, m.longest), 0, -1)  # the longest first: it wins among equals
        s = e - size
        t = m.find((c[:, e, None] - c[:, s]) * q[s], np.broadcast_to(size, (n, len(size))))
        w, k = np.nonzero((t >= 0) & np.isfinite(score[:, s]))
        rank, before = t[w, k], last[w, s[k]]
        value = np.full(t.shape, -np.inf)
        if m.bpe:
            ok = before < 0
            inner = ~ok
            ok[inner] = borders.stand(before[inner], rank[inner])
            value[w, k] = np.where(ok, 0.0, -np.inf)
        else:
            value[w, k] = score[w, s[k]] + m.scores[rank]
        best = value.argmax(1)
        row = np.arange(n)
        score[:, e] = value[row, best]
        last[:, e] = np.where(np.isfinite(score[:, e]), t[row, best], -1)
    out, at, row = np.zeros((n, length), np.int64), np.full(n, length), np.arange(n)
    count = np.zeros(n, np.int64)
    while (live := np.flatnonzero(at > 0)).size:  # backpointers, from the end
        r = last[live, at[live]]
        count[live] += 1
        out[live, length - count[live]] = r
        at[live] -= m.lengths[r]
    return out[np.arange(length) >= length - count[:, None]], count


_encoders: dict[str, object] = {}


def encoder(m: Model):
    """texts -> (flat ids, number of ids of each text). A worker keeps it, with its cache of words, from task to task."""
    if m.name not in _encoders:
        _encoders.clear()
        _encoders[m.name] = _encoder(m)
    return _encoders[m.name]


def _encoder(m: Model):
    cache, borders = WordCache(), Borders(m)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = [chr(BLANK) + t.replace(" ", chr(BLANK)) if t else "" for t in texts]
        points, offsets = code_points(marked)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        blank = points == BLANK
        strange = ~np.isin(points, m.known)
        start = np.zeros(len(points), bool)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        start[1:] |= blank[1:] & ~blank[:-1] | strange[1:] | strange[:-1]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(points))
        row = np.searchsorted(offsets, starts, "right") - 1

        def new(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts, parts = np.zeros(len(a), np.int64), {}
            odd = strange[a]
            for i in np.flatnonzero(odd).tolist():
                x = chr(points[a[i]]).encode("utf-8", "surrogatepass")
                parts[i] = m.byte_ids[list(x)] if len(m.byte_ids) else np.array([m.unknown], np.int32)
                counts[i] = len(parts[i])
            size = np.where(odd, 0, b - a)
            flats = []
            for length in np.unique(size[size > 0]).tolist():
                words = np.flatnonzero(size == length)
                step = max(1, (1 << 18) // length)
                for k in range(0, len(words), step):
                    ranks, n = viterbi(m, borders, points, a[words[k : k + step]], length)
                    if (ragged(m.points, m.places[ranks], m.lengths[ranks]) != points[(a[words[k : k + step], None] + np.arange(length)).reshape(-1)]).any():
                        raise ValueError("two texts of a piece's length have one key: build the model with another base")
                    counts[words[k : k + step]] = n
                    flats.append((words[k : k + step], n, m.ids[ranks]))
            flat, at = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
            for words, n, ids in flats:
                flat[np.arange(len(ids)) + np.repeat(at[words] - (np.cumsum(n) - n), n)] = ids
            for i, ids in parts.items():
                flat[at[i] : at[i] + len(ids)] = ids
            return flat, counts

        ids, n = cache.lookup(points, starts, ends, new)
        if not len(m.byte_ids):  # a run of characters without a piece is one unknown id
            of = np.repeat(np.arange(len(n)), n)
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == m.unknown) & (ids[:-1] == m.unknown) & (row[of[1:]] == row[of[:-1]])
            ids, n = ids[~again], n - np.bincount(of[again], minlength=len(n))
        return ids, np.bincount(row, weights=n, minlength=len(texts)).astype(np.int64)

    return encode


def decode(m: Model, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of lists of ids, given flat; the blank that encoding put first goes."""
    n = m.out_lengths[ids]
    flat = ragged(m.out_bytes, m.out_starts[ids], n).tobytes()
    ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
    out, a = [], 0
    for b in ends.tolist():
        t = flat[a:b].decode("utf-8", "replace")
        out.append(t[1:] if t.startswith(" ") else t)
        a = b
    return out


def _plain(df: DataFrame, keep: list[str], last) -> DataFrame:
    """The kept columns as k0, k1, ... and one more: mapInArrow takes no names with dots."""
    return df.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keep)], last.alias("last"))


def _named(df: DataFrame, keep: list[str]) -> DataFrame:
    """_plain's columns under their own names again."""
    return df.toDF(*keep, *df.columns[len(keep):])


def encode_column(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, then ids (array<int>), and whether decoding them gives the text back (null for null texts)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(load(model_path))  # one vocabulary, a few MB
    rows = _plain(docs, keep, col(text_col))
    plain = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, m = encoder(model.value), model.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for i, j in text_chunks(texts := [t or "" for t in texts]):
                ids, n = encode(texts[i:j])
                same = [t.replace(chr(BLANK), " ") == x for t, x in zip(texts[i:j], decode(m, ids, n), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
                flags = pa.array([s if v else None for s, v in zip(same, batch.column(len(keep)).is_valid().to_pylist()[i:j], strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(len(keep))], lists, flags], names=[*plain, "ids", "round_trip"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return _named(rows.mapInArrow(run, ", ".join([*kinds, "ids array<int>", "round_trip boolean"])), keep)


def decode_column(tokens: DataFrame, model_path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns in keep, then text; null ids give null."""
    spark = tokens.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(load(model_path))
    rows = _plain(tokens, keep, col(ids_col).cast("array<int>"))
    plain = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            texts = [None if x is None else decode(model.value, np.asarray(x, np.int64), np.array([len(x)]))[0] for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*plain, "text"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return _named(rows.mapInArrow(run, ", ".join([*kinds, "text string"])), keep)


def op1(docs: DataFrame, model_path: str) -> DataFrame:
    out = encode_column(docs, model_path, ["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
