"""Operator 5: toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises one character at a time: case, full-width, mathematical, circled and other styled letters,
Greek and Cyrillic look-alikes, digits and signs for letters, and invisible characters inside words. Accented Latin
letters and signs at a word's ends may be meant as they are: such a word is matched as it is written, without the
signs, and where that is no hit, without accents and with the signs as letters. The lexicon holds whole words and
beginnings of words with weights learnt from labelled documents (smoothed log odds of the document frequencies), kept
where the likelihood ratio is beyond chance for that many candidates and each half of the rows confirms it. Exception
phrases cancel the hits inside them: a fixed list, and those learnt from the same rows, as pairs of neighbouring words
around a term that clean documents hold.
A document's features are its weighted hits, as a sum and by length; a logistic curve over them is the score.

Null and empty texts have no hits and get the curve's value at zero, so do texts without words. Texts are scored
whole, whatever their length; repeated rows get equal scores. Without labels of both kinds the lexicon is empty and
every score is 0.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, small_batches

#: Most labelled documents that the lexicon is learnt from, the first by a hash of doc_id; 20 bytes each, so that
#: their broadcast list stays under 0.5 MB.
TRAIN_BOUND = 16_000
#: Most terms that are tried for the lexicon, those of the greatest likelihood ratios.
TERM_BOUND = 2_000
#: Phrases in which a word of abuse is none.
HARMLESS = [
    "circus clown", "clown car", "clown fish", "idiot proof", "loser pays", "pathetic fallacy", "pond scum", "rodeo clown", "scum line", "soap scum", "trash bag", "trash bags", "trash bin", "trash bins", "trash can", "trash cans",
    "trash collection", "trash compactor", "trash day", "trash truck",
]
#: Characters that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
#: Digits and signs between letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"


@lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    table: dict[int, str] = {}
    for c in map(chr, range(0x80, 0x2000)):
        x = unicodedata.normalize("NFKD", c.lower())
        x = "".join(LOOKALIKES.get(y, y) for y in x if not unicodedata.combining(y)).lower()
        # an accented Latin letter stays as it is: dropping accents would merge different words of a language
        if LOOKALIKES.get(c.lower()) or (x != c and not "LATIN" in unicodedata.name(c, "")):
            table[ord(c)] = x
        elif c.lower() != c:
            table[ord(c)] = c.lower()
    for c in [*range(0x2100, 0x2150), *range(0x2460, 0x2500), *range(0x1D400, 0x1D800), *range(0x1F110, 0x1F150)]:
        x = unicodedata.normalize("NFKD", chr(c)).lower()
        x = "".join(LOOKALIKES.get(y, y) for y in x if not unicodedata.combining(y)).strip("()")
        if x.isascii() and x.isalnum():
            table[c] = x
    for c in range(0xFF01, 0xFF5F):
        table[c] = chr(c - 0xFEE0).lower()
    for c in range(65, 91):
        table[c] = chr(c + 32)
    return table | {ord(c): "" for c in INVISIBLE}


_SEPARATORS = {c: " " for c in [*range(33), *map(ord, "\"#%&'()*+,-./:;<=>?[\\]^_`{}~‘’“”–—… ¡¿«»")]}


@lru_cache(maxsize=1)
def _plain() -> dict[int, str]:
    return _folds() | _SEPARATORS


def fold(text: str) -> str:
    """Folded words, each with a space before it and after it. Digits and signs fold only inside words with letters."""
    return folded(text)[0]


def folded(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Folded words with spaces around them, and other readings of some: the word's number and the reading."""
    words = text.translate(_plain()).split()
    joined = " ".join(words)
    signs, accents = any(c in joined for c in DIGITS), not joined.isascii()
    if not signs and not accents:
        return f" {joined} ", []
    out, others = [], []
    for w in words:
        x = _digits(w) if signs else w
        if not x:
            continue
        y = x
        if signs and w[0] in "$@!|" or w[-1] in "$@":
            core = w.rstrip("!|")
            if any(map(str.isalpha, core)):
                y = "".join(DIGITS.get(c, c) for c in core)
        if accents and not y.isascii():
            y = _bare(y)
        if y != x:
            others.append((len(out), y))
        out.append(x)
    return f" {' '.join(out)} ", others


@lru_cache(maxsize=1 << 16)
def _bare(word: str) -> str:
    """The word without accents."""
    return "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _digits(word: str) -> str:
    bare = word.strip("!|$@")
    if bare.isalpha() or not any(map(str.isalpha, bare)):
        return bare
    return "".join(DIGITS.get(c, c) for c in bare)


@dataclass
class Lexicon:
    """terms: folded texts with a leading space (and a trailing one for whole words) to weights."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, -6.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            a.add_word(fold(phrase), (len(fold(phrase)), None))
        a.make_automaton()
        return a

    def hits(self, text: str, a: ahocorasick.Automaton) -> tuple[float, int, int]:
        """Summed weights of the hits, their number, and the number of words. Of hits that start at one word the heaviest counts."""
        main, others = folded(text)
        words = main.count(" ") - 1 if len(main) > 2 else 0
        if not len(a):
            return 0.0, 0, words
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in a.iter(main):
            at = end - n + 1
            if weight is None:
                spared.append((at, end))
            elif weight > best.get(at, 0.0):
                best[at] = weight
        kept = [w for at, w in best.items() if not any(i <= at < j for i, j in spared)]
        if others:
            text, more = f" {' '.join(w for _, w in others)} ", {}
            for end, (n, weight) in a.iter(text):
                if weight is not None:
                    word = others[text.count(" ", 0, end - n + 1)][0]
                    more[word] = max(weight, more.get(word, 0.0))
            if more:
                hit = {main.count(" ", 0, at) for at in best}
                kept += [w for word, w in more.items() if word not in hit]
        return sum(kept), len(kept), words

    def features(self, text: str, a: ahocorasick.Automaton) -> tuple[float, float]:
        total, _, words = self.hits(text, a)
        return math.log1p(total), math.log1p(100 * total / (words + 20))



def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_BOUND) -> DataFrame:
    """(doc_id, text, toxic) of at most bound labelled documents whose crc32 of doc_id is not 1 modulo 3."""
    picked = (
        labels.select(F.col("doc_id"), F.col("toxic"))
        .where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by bound rows of 12 bytes


def learn(rows: DataFrame, min_docs: int = 3, exceptions: list[str] | None = None, max_prefix: int = 9) -> Lexicon:
    """A lexicon from rows of (text, toxic): terms, weights, and the curve of the score.

    Candidates are a document's folded words and their beginnings of 4 to max_prefix letters, counted once a
    document. The counts are made by Spark; at most TERM_BOUND terms that pass the tests come to the driver. Exception
    phrases are HARMLESS and learnt ones, unless they are given.
    """
    small_batches(rows.sparkSession)
    rows = materialize(rows.select("text", "toxic"), "labelled")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in fold(text or "").split() if w.isalpha() and 3 <= len(w) <= 40}
                terms = {f" {w} " for w in words}
                for n in range(4, max_prefix + 1):
                    terms.update(f" {w[:n]}" for w in words if len(w) >= n)
                for t in terms:
                    counts.setdefault(t, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "clean", "toxic"])

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return Lexicon({})
    counted = rows.mapInArrow(candidates, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    n = clean + toxic
    both = F.col("c") + F.col("t")
    part = lambda k, m: F.when(k > 0, k * F.log(k * F.lit(float(n)) / (both * F.lit(float(m))))).otherwise(0.0)
    ratio = 2 * (part(F.col("t"), toxic) + part(F.col("c"), clean))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    tested = materialize(counted.where(f"t >= {min_docs} and c < 0.1 * t").select("term", "c", "t", weight.alias("w"), ratio.alias("g")).where("w > 2"), "terms")
    beyond = tested.where(F.col("g") > 2 * math.log(max(tested.count(), 8)) + 2)
    kept = confirmed(rows, {r["term"]: r["w"] for r in beyond.orderBy(F.desc("g"), F.desc(F.length("term")), "term").limit(TERM_BOUND).collect()})
    lexicon = Lexicon(kept, sorted({*learn_exceptions(rows, Lexicon(kept), clean, toxic, min_docs), *HARMLESS}) if exceptions is None else exceptions)
    a = lexicon.automaton

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = a()
        for batch in batches:
            f = [lexicon.features(t or "", automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in f], pa.float64()), pa.array([y for _, y in f], pa.float64()), batch.column(1).cast(pa.int64())], names=["x", "y", "toxic"])

    pairs = rows.mapInArrow(features, "x double, y double, toxic long").toPandas()  # at most the training bound
    lexicon.curve = _logistic(pairs[["x", "y"]].to_numpy(), pairs["toxic"].to_numpy())
    return lexicon


def confirmed(rows: DataFrame, terms: dict[str, float]) -> dict[str, float]:
    """The terms (with their weights) that more toxic than clean documents hold in both halves of the rows, by a hash of the text.

    A beginning of a kept word, or a longer form of a kept beginning, is needless; those in the most toxic documents come first.
    """
    names = sorted(terms)
    if not names:
        return {}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Lexicon({t: float(i + 1) for i, t in enumerate(names)}).automaton()
        for batch in batches:
            found = [sorted({int(w) - 1 for _, (_, w) in a.iter(fold(t or ""))}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.int32())], names=["found", "toxic", "half"])

    halves = rows.select("text", "toxic", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).cast("int").alias("half"))
    counts = halves.mapInArrow(held, "found array<int>, toxic int, half int").select("toxic", "half", F.explode("found").alias("k")).groupBy("k", "half").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    by = {(r["k"], r["half"]): (r["t"], r["c"]) for r in counts.collect()}  # two rows a term, of at most TERM_BOUND
    hits = {k: sum(by.get((k, h), (0, 0))[0] for h in (0, 1)) for k in range(len(names))}
    agreed = [k for k in range(len(names)) if all(t > c for t, c in (by.get((k, h), (0, 0)) for h in (0, 1)))]
    kept: dict[str, float] = {}
    for k in sorted(agreed, key=lambda k: (-hits[k], -len(names[k]), names[k])):
        if not any(names[k].startswith(x) or x.strip().startswith(names[k].strip()) and hits[k] <= 1.05 * hits[names.index(x)] for x in kept):
            kept[names[k]] = terms[names[k]]
    return kept


def learn_exceptions(rows: DataFrame, lexicon: Lexicon, clean: int, toxic: int, min_docs: int = 3) -> list[str]:
    """Phrases of two folded words, one of which starts a hit, that at least min_docs clean documents hold and no toxic one.

    A phrase must be cleaner than the documents with a hit are, beyond chance for that many phrases: their clean share
    to the power of the phrase's documents has to be improbable enough, by the likelihood ratio that terms are tested with.
    """
    if not lexicon.terms:
        return []

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                main = fold(text or "")
                starts = {end - n + 1 for end, (n, _) in a.iter(main)}
                found = {""} if starts else set()  # the empty phrase counts the documents with a hit
                for at in starts:
                    stop = main.index(" ", at + 1)
                    before, after = main.rfind(" ", 0, at), main.find(" ", stop + 1)
                    if before >= 0:
                        found.add(main[before + 1 : stop])
                    if after >= 0:
                        found.add(main[at + 1 : after])
                for t in found:
                    counts.setdefault(t, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["phrase", "clean", "toxic"])

    counted = materialize(rows.mapInArrow(phrases, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")), "phrases")
    hit = counted.where("phrase = ''").first()
    if hit is None or not hit["c"] or not hit["t"]:
        return []
    tested = counted.where(f"phrase <> '' and c >= {min_docs} and t = 0")
    ratio = -2 * F.col("c") * math.log(hit["c"] / (hit["c"] + hit["t"]))
    found = tested.where(ratio > 2 * math.log(max(counted.where(f"phrase <> '' and c + t >= {min_docs}").count(), 8)) + 2)
    return sorted(r["phrase"] for r in found.collect())  # only phrases beyond chance


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Newton's method with a little shrinkage of the slopes; slopes are not negative."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(3), np.array([ridge, ridge, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    w[:2] = np.maximum(w[:2], 0)
    return float(w[0]), float(w[1]), float(w[2])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_hits, n_words) of every whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            hits = [lexicon.hits(t, a) for t in texts]
            scores = [_curve(lexicon, h) for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64())], names=["doc_id", "score", "n_hits", "n_words"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_hits long, n_words long")


def _curve(lexicon: Lexicon, hit: tuple[float, int, int]) -> float:
    if not lexicon.terms:
        return 0.0
    total, _, words = hit
    z = lexicon.curve[0] * math.log1p(total) + lexicon.curve[1] * math.log1p(100 * total / (words + 20)) + lexicon.curve[2]
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    lexicon = learn(training_rows(docs, labels))
    held = F.expr("crc32(cast(doc_id as string)) % 3 = 1").alias("held_out")
    return score(docs, lexicon).select("doc_id", held, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_hits")
