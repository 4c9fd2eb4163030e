"""Operator 12: vectors as codes of one byte a part, by codebooks that a few rounds of k-means train.

Each component x becomes the integer floor(256 x); a vector is cut into PARTS equal consecutive parts. The codebook of a
part starts as that part of the vectors of the ENTRIES least ids; a round assigns every part to its nearest entry and
replaces entries by the floored means of their parts. All arithmetic is on integers, so that results depend on no order.

The nearest entry is found by partial distances: dimensions go in descending variance over the codebook, a first complete
distance comes from the entry nearest in the first of them, and entries go in blocks, in which a mask drops those whose
distance so far strictly exceeds the best complete one. Entries at the same distance stay, so that the lowest index wins.

A round is one pass over the vectors: a task sums its parts by entry, and an aggregation brings PARTS x ENTRIES sums,
whatever the number of vectors, to the driver, which holds nothing but the codebooks.

Dropped are vectors that are null or empty, hold null or non-finite components, or components so large (from 524288 on at
64 dimensions) that a sum of squares would pass 64 bits; vectors whose length is no multiple of PARTS; and those of
another length than the vector that comes first. Null ids come last in the order of ids, equal ids in the order of
their vectors; such rows are coded like any other, and repeated rows count each time. With fewer than ENTRIES vectors
codebooks are shorter. A table without usable vectors gives no rows. Columns with clashing names are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, lookup, materialize, small_batches

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component's steps to the unit.
STEPS = 256
#: Entries of a block, and vectors that one numpy step takes.
BLOCK, ROWS = 16, 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the lowest index of the nearest rows of the book, and its squared distance; int64."""
    spread = len(book) * (book * book).sum(0) - book.sum(0) ** 2
    order = np.argsort(-spread, kind="stable")
    x, book = x[:, order], book[:, order]
    lead = np.argsort(book[:, 0], kind="stable")
    code = lead[np.minimum(np.searchsorted(book[lead, 0], x[:, 0]), len(lead) - 1)]
    best = ((x - book[code]) ** 2).sum(1)
    for start in range(0, len(book), BLOCK):
        part = book[start : start + BLOCK]
        so_far = (x[:, :1] - part[:, 0]) ** 2
        row, entry = np.nonzero(so_far <= best[:, None])
        so_far = so_far[row, entry]
        for j in range(1, x.shape[1]):
            so_far = so_far + (x[row, j] - part[entry, j]) ** 2
            live = so_far <= best[row]
            row, entry, so_far = row[live], entry[live], so_far[live]
        if not len(row):
            continue
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        low, r = np.minimum.reduceat(so_far, first), row[first]
        at_low = so_far == np.repeat(low, np.diff(np.append(first, len(row))))
        index = start + np.minimum.reduceat(np.where(at_low, entry, BLOCK), first)
        better = (low < best[r]) | (low == best[r]) & (index < code[r])
        code[r[better]], best[r[better]] = index[better], low[better]
    return code, best


def _limit(width: int) -> int:
    """Components below this size leave the sum of `width` squared differences below 2**62."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def usable(vectors: DataFrame, id_col: str, vector_col: str, keep: tuple[str, ...] = (), parts: int = PARTS) -> tuple[DataFrame, int]:
    """(id, v, kept columns as k0 and so on) of the rows that can be coded, and their vectors' length (0 if there are none)."""
    rows = vectors.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v"), *[col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    whole = rows.where(f"size(v) > 0 and size(v) % {parts} = 0").where(f"forall(v, x -> x is not null and abs(x * {STEPS}) < {_limit(1)}D and abs(x * {STEPS}) < sqrt({float(1 << 62)}D / size(v)) / 2)")
    first = whole.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    width = first[0] if first else 0
    return whole.where(F.size("v") == width), width


def _steps(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integer components."""
    return np.floor(STEPS * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)).astype(np.int64)


def _coded(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, part, its values, codes, errors) of all parts of some rows."""
    size = books.shape[2]
    for a in range(0, len(x), ROWS):
        for p, book in enumerate(books):
            own = x[a : a + ROWS, p * size : (p + 1) * size]
            yield a, a + len(own), p, own, *nearest(own, book)


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) from usable rows (id, v)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # `entries` vectors
    start = np.floor(STEPS * np.array([r["v"] for r in first], float)).astype(np.int64)
    size = width // parts
    books = np.stack([start[:, p * size : (p + 1) * size] for p in range(parts)])
    spark = rows.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for _, _, p, own, code, _ in _coded(_steps(batch.column(0), width), books):
                    order = np.argsort(code, kind="stable")
                    used, at, n = np.unique(code[order], return_index=True, return_counts=True)
                    sums[p, used] += np.add.reduceat(own[order], at, axis=0)
                    counts[p, used] += n
            p, e = np.nonzero(counts)
            if len(p):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * size, pa.int32()), pa.array(sums[p, e].reshape(-1)))],
                    names=["p", "e", "n", "s"],
                )

        found = rows.select("v").mapInArrow(run, "p int, e int, n long, s array<long>").select("p", "e", "n", F.posexplode("s").alias("j", "s"))
        books = books.copy()
        for r in found.groupBy("p", "e", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # one row a codebook component
            books[r["p"], r["e"], r["j"]] = r["s"] // r["n"]
        shared.unpersist()
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows, with the integer code of each part and the squared error instead of the vector: (id, kept columns, codes, error)."""
    shared, width = rows.sparkSession.sparkContext.broadcast(books), books.shape[0] * books.shape[2]
    kept = [c for c in rows.columns if c != "v"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            x = _steps(batch.column(0), width)
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for a, b, p, _, code, far in _coded(x, books):
                codes[a:b, p] = code
                error[a:b] += far
            blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), len(x), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(k + 1) for k in range(len(kept))], blobs, pa.array(error)], names=[*kept, "codes", "error"])

    return rows.select("v", *kept).mapInArrow(run, f"{schema}, codes binary, error long")


def decode(codes: bytes, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in units."""
    return np.concatenate([book[c] for book, c in zip(books, codes, strict=True)]) / STEPS


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code in hexadecimal, error, label_error, codebooks_sha256) of all usable vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows, width = usable(vectors, id_col, vector_col, (label_col,), parts)
    if not width:
        return rows.select(F.col("id").alias("vec_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]).where("1 = 0")
    books = train(rows.select("id", "v"), width, parts, entries, rounds)
    # two columns, so that nulls are equal to one another and to no label
    keyed = encode(rows, books).select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", F.col("k0").isNull().alias("unlabelled"), F.coalesce(F.col("k0").cast("string"), F.lit("")).alias("label"))
    keyed = materialize(keyed, "codes")
    sums = materialize(keyed.groupBy("unlabelled", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return lookup(keyed, sums, ["unlabelled", "label"], shuffled=True).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12(vectors: DataFrame) -> DataFrame:
    return compressed(vectors)


def _round(k: int) -> str:
    """The nearest entries a{k} of all parts in the codebooks b{k}, and the next codebooks."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT id, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS m
  FROM (SELECT t.id, t.p, t.x, b.e, list_sum(list_transform(list_zip(t.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM t JOIN b{k} b ON t.p = b.p) GROUP BY id, p),
u{k} AS (SELECT p, e, j, sum(s)::BIGINT AS s, count(*) AS n FROM (SELECT p, m.e AS e, unnest(x) AS s, unnest(range(len(x))) AS j FROM a{k}) GROUP BY p, e, j),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM u{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e),"""


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS MATERIALIZED (SELECT id, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM v, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, x FROM t WHERE id <= 64),
{_round(0)}
{_round(1)}
{_round(2)}
code AS MATERIALIZED (SELECT id, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY id),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS j FROM b2))
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM code JOIN v USING (id), h
"""
