"""Operator 11: phrases of two to four words that occur together, by language.

Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and pieces into words at blanks and tabs. A
phrase is a run of words in one piece; all its occurrences count, overlaps included.

1. Shards: texts of one language, normalised to words with one blank between them and one line end after a piece, in
   stored rows of about SHARD bytes. Pieces are never divided; a longer piece makes its own shard.
2. Sketches: each shard counts the hashed slots (SLOT_BITS bits) of its runs of one to four words. Slots go in blocks
   by their leading bits, compressed; a block's task sums them over all shards. A sum is an upper bound of the count of
   every run in that slot, so a run of a slot below the threshold is no candidate. Each shard is told, by one bit a slot
   of its own, which of them reach it. Nothing about all phrases is broadcast or comes to the driver, and a task holds
   one block or one shard, whatever the size of the corpus.
3. Automata: the runs of a shard in such slots are compiled, CHUNK bytes of text at a time, into an Aho-Corasick
   automaton, each guarded by a blank on both sides; a scan of the text counts all overlapping matches. Counts are
   summed over the shards and only then held against the threshold, so that collisions of slots change no result.
4. A phrase is cut after each of its words; the counts of both parts are joined (parts of a frequent phrase are
   frequent, so they have been counted). Scores are exact integers. Longer phrases that hold a shorter one nearly always
   where it occurs suppress it.

Null texts are empty; a null language is `und`, and so one with a language of that name. Texts without words, and an
empty table, give no rows. Repeated rows count each time. Columns other than the text's and language's are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_hashes, chunks, col, lookup, mark, materialize, mix, release, small_batches, spans, utf8

#: Words of the longest phrase.
LONGEST = 4
#: Bytes of a shard's text, and of the text that one automaton is made for.
SHARD, CHUNK = 8 << 20, 2 << 20
#: Bits of a slot. Slots of one block are told apart by the trailing ones.
SLOT_BITS = 40
#: Slots that a block's task gets from all shards, about.
BLOCK_ENTRIES = 4_000_000
#: Phrases of a language are first ranked in so many parts.
SALTS = 64
UNKNOWN = "und"
#: Tells the phrases of a chunk apart; a process draws its own, so that nobody can prepare two with one hash.
_SEED = int.from_bytes(os.urandom(7), "little")

_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_INSIDE = np.ones(256, bool)  # bytes of words in a normalised text
_INSIDE[[0x20, 0x0A]] = False


def normal(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of all words in lower case, each followed by a blank, or by a line end if its piece ends there."""
    b = LOWER[np.insert(buf, offsets[1:], 10)]
    starts, ends, _ = spans(b, np.array([0, len(b)]), _WORD)
    if not len(starts):
        return b[:0]
    stops = np.concatenate([[0], np.cumsum(_ENDS[b])])
    last = stops[np.append(starts[1:], len(b))] > stops[ends]
    b[ends] = np.where(last, 10, 32)
    keep = _WORD[b]
    keep[ends] = True
    return b[keep]


def runs(text: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Starts and ends of a normalised text's words; for each length the first words of all runs, and their slots."""
    starts, ends, _ = spans(text, np.array([0, len(text)]), _INSIDE)
    n = len(starts)
    h = byte_hashes(text, starts, ends)
    piece = np.concatenate([[0], np.cumsum(text[ends] == 10)])[:n]
    g, at, slots = h, [np.arange(n)], [mix(h) >> np.uint64(64 - SLOT_BITS)]
    for k in range(2, longest + 1):
        g = mix(g[: max(n - k + 1, 0)] * np.uint64(31) + h[k - 1 :])
        first = np.flatnonzero(piece[: max(n - k + 1, 0)] == piece[k - 1 :])
        at.append(first)
        slots.append(g[first] >> np.uint64(64 - SLOT_BITS))
    return starts, ends, at, slots


def _stored(values: np.ndarray) -> bytes:
    """Ascending slots of a block as compressed steps, bytes of equal weight together."""
    steps = np.diff(values, prepend=values[:1]).astype("<u8")
    steps[:1] = values[:1]
    return pa.compress(steps.view(np.uint8).reshape(-1, 8)[:, : SLOT_BITS // 8].T.tobytes(), "zstd", asbytes=True)


def _read(blob: bytes, n: int) -> np.ndarray:
    width = SLOT_BITS // 8
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(pa.decompress(blob, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SHARD) -> DataFrame:
    """The stored shards: (shard, lang, n_words, n_bytes, text), a text being a compressed normal one."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 32

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            text = np.concatenate(held.pop(lang))
            del sizes[lang]
            a = 0
            while a < len(text):
                b = len(text)
                if b - a > 2 * size:  # of whole pieces
                    stop = np.flatnonzero(text[a + size :] == 10)
                    b = a + size + int(stop[0]) + 1
                part = text[a:b]
                words = int(np.count_nonzero(~_INSIDE[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made], pa.int64()), pa.array([lang]), pa.array([words], pa.int64()), pa.array([b - a], pa.int64()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())],
                    names=["shard", "lang", "n_words", "n_bytes", "text"],
                )
                made, a = made + 1, b

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            order = np.argsort(names.indices.to_numpy(), kind="stable")
            which = names.indices.to_numpy()[order]
            for k, lang in enumerate(names.dictionary.to_pylist()):
                a, b = np.searchsorted(which, [k, k + 1])
                buf, offsets = utf8(batch.column(1).take(pa.array(order[a:b])))
                for i, j in chunks(offsets):
                    text = normal(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    if not len(text):
                        continue
                    held.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text)
                    if sizes[lang] >= size:
                        yield from flush(lang)
            while sum(sizes.values()) > 4 * size:  # many languages
                yield from flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flush(lang)

    return materialize(rows.mapInArrow(run, "shard long, lang string, n_words long, n_bytes long, text binary"), "shards", "uncompressed")


def _text(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n, "zstd", asbytes=True), np.uint8)


def _salted(slots: list[np.ndarray], lang: str) -> list[np.ndarray]:
    """The slots with the language mixed in: languages share no counts."""
    raw = np.frombuffer(lang.encode(), np.uint8)
    own = byte_hashes(raw, np.array([0]), np.array([len(raw)]), 1) >> np.uint64(64 - SLOT_BITS)
    return [s ^ own for s in slots]


def _cuts(slots: np.ndarray, bits: int) -> np.ndarray:
    """Where the blocks' ranges of ascending slots start and end."""
    return np.searchsorted(slots, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(SLOT_BITS - bits))


def sketches(made: DataFrame, bits: int, least: int, longest: int = LONGEST) -> DataFrame:
    """(shard, block, n, slots, counts): each shard's slots and their counts, the latter at most least."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, n_bytes, blob in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                slots = np.sort(np.concatenate(_salted(runs(_text(blob, n_bytes), longest)[3], lang)))
                first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
                count = np.minimum(np.diff(np.append(first, len(slots))), least).astype(kind)
                slots = slots[first]
                cut = _cuts(slots, bits)
                some = np.flatnonzero(np.diff(cut))
                base = np.uint64(SLOT_BITS - bits)
                parts = [(cut[k], cut[k + 1]) for k in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array([b - a for a, b in parts], pa.int64()),
                     pa.array([_stored(slots[a:b] - (np.uint64(k) << base)) for k, (a, b) in zip(some, parts, strict=True)], pa.binary()),
                     pa.array([pa.compress(count[a:b].tobytes(), "zstd", asbytes=True) for a, b in parts], pa.binary())],
                    names=["shard", "block", "n", "slots", "counts"],
                )

    return made.select("shard", "lang", "n_bytes", "text").mapInArrow(run, "shard long, block long, n long, slots binary, counts binary")


def _replies(sketch: DataFrame, least: int) -> DataFrame:
    """(shard, block, bits): for each of a shard's slots in a block whether the sum over all shards reaches least."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(group: pa.Table) -> pa.Table:
        n = group["n"].to_numpy()
        slots = np.concatenate([_read(s, k) for s, k in zip(group["slots"].to_pylist(), n.tolist(), strict=True)])
        counts = np.concatenate([np.frombuffer(pa.decompress(c, k * kind().itemsize, "zstd", asbytes=True), kind) for c, k in zip(group["counts"].to_pylist(), n.tolist(), strict=True)])
        order = np.argsort(slots)
        ranked = slots[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        enough = np.add.reduceat(counts[order], first, dtype=np.int64) >= least
        reached = np.empty(len(slots), bool)
        reached[order] = np.repeat(enough, np.diff(np.append(first, len(slots))))
        stop = np.cumsum(n)
        bits = [np.packbits(reached[b - k : b]).tobytes() for k, b in zip(n.tolist(), stop.tolist(), strict=True)]
        return pa.table({"shard": group["shard"], "block": group["block"], "n": group["n"], "bits": pa.array(bits, pa.binary())})

    return sketch.groupBy("block").applyInArrow(run, "shard long, block long, n long, bits binary")


def _counted(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct phrases among the runs (at, words) of a normal text, their numbers of words, and all their matches in it."""
    import ahocorasick

    last = ends[at + words - 1]
    raw = text.tobytes().decode("latin-1")  # a character a byte: any bytes go through
    one = np.unique(byte_hashes(text, starts[at], last, _SEED), return_index=True)[1]
    phrases = [raw[a:b] for a, b in zip(starts[at[one]].tolist(), last[one].tolist(), strict=True)]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", k)
    automaton.make_automaton()
    found = np.fromiter(map(itemgetter(1), automaton.iter(" " + raw.replace("\n", " \n "))), np.int32)
    return [p.encode("latin-1") for p in phrases], words[one], np.bincount(found, minlength=len(phrases))


def _matches(made: DataFrame, replies: DataFrame, longest: int, size: int) -> DataFrame:
    """(lang, phrase, words, n): counts in parts of shards of the runs whose slots reach the threshold."""
    none = F.lit(None)
    rows = made.select("shard", F.lit(-1).cast("long").alias("block"), F.col("n_bytes").alias("n"), "text", "lang").unionByName(
        replies.select("shard", "block", "n", F.col("bits").alias("text"), none.cast("string").alias("lang"))
    )

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["block"].to_numpy())
        n, blobs, langs = group["n"].to_pylist(), group["text"].to_pylist(), group["lang"].to_pylist()
        top, told = int(order[0]), order[1:].tolist()
        text, lang = _text(blobs[top], n[top]), langs[top]
        starts, ends, at, slots = runs(text, longest)
        words = np.repeat(np.arange(1, longest + 1), [len(a) for a in at])
        at, slots = np.concatenate(at), np.concatenate(_salted(slots, lang))
        own = np.sort(slots)  # np.unique's table of hashes is many times slower
        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        reached = own[np.concatenate([np.unpackbits(np.frombuffer(blobs[i], np.uint8), count=n[i]) for i in told]).astype(bool)]
        rough = np.zeros(1 << 22, bool)
        rough[reached & np.uint64((1 << 22) - 1)] = True
        live = np.flatnonzero(rough[slots & np.uint64((1 << 22) - 1)])
        live = live[reached[np.minimum(np.searchsorted(reached, slots[live]), len(reached) - 1)] == slots[live]] if len(reached) else live[:0]
        live = live[np.argsort(at[live], kind="stable")]
        at, words = at[live], words[live]
        out: list[tuple[list[bytes], np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(text):  # whole pieces
            b = len(text)
            if b - a > 2 * size:
                stop = np.flatnonzero(text[a + size : min(b, a + 4 * size)] == 10)
                stop = stop if len(stop) else np.flatnonzero(text[a + size :] == 10)
                b = a + size + int(stop[0]) + 1
            w0, w1 = np.searchsorted(starts, [a, b])
            i, j = np.searchsorted(at, [w0, w1])
            if j > i:
                out.append(_counted(text[a:b], starts[w0:w1] - a, ends[w0:w1] - a, at[i:j] - w0, words[i:j]))
            a = b
        phrases = [p for ps, _, _ in out for p in ps]
        k, counts = (np.concatenate([o[x] for o in out]) if out else np.zeros(0, np.int64) for x in (1, 2))
        return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.binary()), "words": pa.array(k, pa.int64()), "n": pa.array(counts, pa.int64())})

    return rows.groupBy("shard").applyInArrow(run, "lang string, phrase binary, words long, n long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = LONGEST, shard: int = SHARD, chunk: int = CHUNK, entries: int = BLOCK_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Stored tables: (lang, phrase, words, a) of all runs of at most `longest` words that occur at least `least` times, and (lang, n), all words."""
    spark, since = docs.sparkSession, mark()
    made = shards(docs, text_col, lang_col, shard)
    totals = materialize(made.groupBy("lang").agg(F.sum("n_words").alias("n")), "words")
    words = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, longest * words / entries))))
    found = _matches(made, _replies(sketches(made, bits, least, longest), least), longest, chunk)
    found = found.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("a")).where(F.col("a") >= least)
    found = materialize(found.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    release(spark, since, found, totals)
    return found, totals


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int | None = 2000, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases that no longer one stands for; all of them without top.

    score is floor(2000000 a / (l + r)) of the cut, into parts that occur l and r times, for which it is least. sizes are
    those of phrase_counts.
    """
    found, totals = phrase_counts(docs, text_col, lang_col, least, **sizes)
    longer = found.where("words > 1")
    cut = longer.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), (F.col("words") - 1).cast("int"))).alias("k"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)"))

    def with_count(rows: DataFrame, part: str, name: str) -> DataFrame:
        """rows with the count of their part; frequent parts are looked up where the rows are."""
        uses = rows.groupBy("lang", part).agg(F.count("*").alias("n"))
        counts = found.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)).hint("merge")
        return lookup(rows, materialize(uses.join(counts, ["lang", part]), "parts"), ["lang", part], shuffled=True)

    cut = with_count(materialize(with_count(cut, "first", "l"), "cuts"), "rest", "r")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    # the words of a longer candidate's inner runs, with its count; one shuffle brings them to the candidates
    word = F.split("phrase", " ")
    inner = longer.where("words > 2").select("lang", "a", word.alias("w")).select(
        "lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = scored.join(inner.hint("merge"), ["lang", "phrase"], "left").where(F.col("over").isNull() | (_exact(F.col("over")) * 100 < _exact(F.col("a")) * 80))
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # a part of a language at a time, so that no task ranks all of one
        part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("part")
        kept = kept.select("*", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        kept = kept.where(F.col("rank") <= top)
    return kept.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def op11(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS x FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k AS size, a, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS k FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT lang, w, a, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM (SELECT lang, string_split(phrase, ' ') AS w, a, unnest(generate_series(2, k - 1)) AS k FROM f WHERE k > 2)) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
