"""The nearest of all other vectors, exactly, with cells around pivots and the triangle inequality.

Vectors are dealt to the cells of their nearest pivots. A first pass compares the vectors of each cell with one another,
which gives every vector k neighbours and so a bound on the distance of its k nearest. A second pass sends a vector to
just those other cells that can hold a nearer one: neither the cell's ring around its pivot nor the plane between the
cell's pivot and the vector's own rules that out. Cells lie together in a number of shelves that grows with the table,
and a vector is sent once to a shelf, however many of its cells it visits; the task compares it with those alone, and
keeps what the bound lets through. Cells, shelves and their visitors are compared in blocks of bounded size.

Greatest dot products are nearest distances, too: with one more coordinate, all vectors have the length of the longest,
while the vector that is searched for has none of it; then |q - s|^2 = |q|^2 + longest^2 - 2 q s.

Pivots are chosen from PIVOT_ROWS vectors; every vector is compared wherever the bounds do not rule it out. In a table
without any clusters they rule out little, and all pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import stored
from .kmeans import first_centres

#: Vectors of a block; a task compares two blocks. Numbers of a shelf's block, which has more vectors where those are short.
BLOCK, NUMBERS = 4096, 1 << 21
#: Most pivots, vectors to a pivot at least, and vectors that pivots are chosen from.
PIVOTS, CELL, PIVOT_ROWS = 256, 32, 4096
#: Shelves of a table that fits them, and vectors that ask for their cells at once.
SHELVES, VISITORS = 6, 1024
#: What rounding may add to a squared distance, relative to the greatest squared length; ties in nine digits lie within.
SLACK = 1e-7


def nearest(vectors: DataFrame, id_col: str, vec_col: str, k: int, euclidean: bool = False, block: int = BLOCK, report: dict[str, float] | None = None) -> DataFrame:
    """(a, b, similarity, rank): the k most similar of all other vectors, by dot product or by the negative distance.

    Similarities equal in nine digits are in the order of b. Null ids and null vectors are left out. report gets `share`:
    the pairs that had to be compared, in shares of all, and `sent`: how often a vector went to shelves.
    """
    ship(vectors.sparkSession)
    rows = stored(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null"), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    size = rows.agg(F.count("*").alias("n"), F.max(square).alias("most")).first()
    n, most = size["n"], size["most"] or 0.0
    near = f"a {kind}, b {kind}, similarity double, r double"
    if not n:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    sample = np.array([r["v"] for r in rows.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOT_ROWS).collect()], float)  # PIVOT_ROWS vectors
    slack = SLACK * (1 + most)

    def placed(x: np.ndarray) -> np.ndarray:
        """Vectors as they are searched among."""
        return x if euclidean else np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])

    def asking(x: np.ndarray) -> np.ndarray:
        return x if euclidean else np.column_stack([x, np.zeros(len(x))])

    pivots = np.unique(first_centres(placed(sample), min(PIVOTS, max(1, n // CELL)), np.random.default_rng(0)), axis=0)

    def far(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = far(placed(matrix(batch.column(1))))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "cell", "d"])

    dealt = stored(rows.mapInArrow(deal, f"id {kind}, v array<double>, cell int, d double"), "cells")
    cells = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()}  # one row a pivot
    parts = {c: -(-r["n"] // block) for c, r in cells.items()}

    def compared(left: DataFrame, left_parts: dict[int, int], right: DataFrame) -> DataFrame:
        """The k best of right for each of left's rows (id, v, cell) among right's of that cell."""
        count = lambda p: F.element_at(F.create_map(*[F.lit(x) for pair in p.items() for x in pair]), F.col("cell"))  # noqa: E731  a pivot's number
        every, own = lambda p: F.explode(F.sequence(F.lit(0), count(p) - 1)), lambda p: F.pmod(F.xxhash64("id"), count(p)).cast("int")
        a = left.select("cell", own(left_parts).alias("p"), every(parts).alias("q"), F.lit(0).alias("side"), "id", "v")
        b = right.select("cell", every(left_parts).alias("p"), own(parts).alias("q"), F.lit(1).alias("side"), "id", "v")

        def run(group: pd.DataFrame) -> pd.DataFrame:
            left, right = (group[group["side"] == s] for s in (0, 1))
            if not len(left) or not len(right):
                return pd.DataFrame({"a": [], "b": [], "similarity": [], "r": []})
            u, v = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            return pd.concat([_best(left["id"].to_numpy()[i : i + 256], u[i : i + 256], right["id"].to_numpy(), v, k, euclidean) for i in range(0, len(u), 256)])

        return a.unionByName(b).groupBy("cell", "p", "q").applyInPandas(run, near)

    ranked = Window.partitionBy("a").orderBy(F.desc("r"), F.asc("b"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    first = stored(best(compared(dealt, parts, dealt)), "near")
    worst = first.where(F.col("rank") == k).groupBy(F.col("a").alias("id")).agg(F.min("r").alias("bound"))
    ready = stored(dealt.select("id", "v", "cell").join(worst, "id", "left"), "bounds")
    names = np.array(sorted(cells))
    low, high = (np.array([cells[c][x] for c in names]) for x in ("low", "high"))
    between = np.sqrt(((pivots[:, None] - pivots[names]) ** 2).sum(2))
    # Shelves: cells in the order of their distance from the first pivot, cut where a block is full.
    shelf_rows = min(max(block, min(8 * block, NUMBERS // max(1, sample.shape[1]))), max(block, -(-n // SHELVES)))
    in_order = np.argsort(between[0], kind="stable")
    filled = np.array([cells[c]["n"] for c in names[in_order]]).cumsum()
    shelf = np.empty(len(names), np.int64)
    shelf[in_order] = (filled - 1) // shelf_rows
    shelves = int(shelf.max()) + 1

    def open_cells(x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """(vectors, cells): which cells can hold a nearer vector than the bound of similarities; all if there is none."""
        reach = np.where(np.isnan(bound), np.inf, bound**2 if euclidean else (x * x).sum(1) + most - 2 * bound)
        d = far(asking(x))
        home = d.argmin(1)
        there = d[:, names]
        plane = (there**2 - d[np.arange(len(x)), home][:, None] ** 2) / np.maximum(2 * between[home], 1e-300)
        least = np.maximum(np.maximum(there - high, low - there), np.where(between[home] > 0, plane, 0))
        return np.maximum(least, 0) ** 2 <= reach[:, None] + slack

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, VISITORS):
                batch = whole.slice(start, VISITORS)
                cell = batch.column(2).to_numpy()
                may = open_cells(matrix(batch.column(1)), batch.column(3).to_numpy(zero_copy_only=False).astype(float)) & (names != cell[:, None])
                for s in range(shelves):  # a vector once a shelf, so many at a time
                    at = np.flatnonzero(may[:, shelf == s].any(axis=1))
                    if len(at):
                        pairs = (may[np.ix_(at, np.flatnonzero(shelf == s))] * np.array([cells[c]["n"] for c in names[shelf == s]])).sum(1)
                        rows = pa.array(at)
                        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in range(4)], pa.array([s] * len(at), pa.int32()), pa.array(pairs, pa.int64())], names=["id", "v", "cell", "bound", "shelf", "pairs"])

    visitor = f"id {kind}, v array<double>, cell int, bound double, shelf int, pairs long"
    visits = ready.select("id", "v", "cell", "bound").mapInArrow(visit, visitor)
    met = {r["shelf"]: r for r in visits.groupBy("shelf").agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs")).collect()}  # one row a shelf
    if report is not None:
        report["share"] = (sum(r["n"] ** 2 for r in cells.values()) + sum(r["pairs"] for r in met.values())) / n**2
        report["sent"] = sum(r["n"] for r in met.values()) / n
    if not met:
        return first.select("a", "b", "similarity", "rank")
    held = dict(zip(range(shelves), np.bincount(shelf, [cells[c]["n"] for c in names]).astype(int).tolist(), strict=True))
    blocks = {s: (-(-r["n"] // shelf_rows), -(-held[s] // shelf_rows)) for s, r in met.items()}
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for s, p in blocks.items() for x in (s, p[i])]), F.col("shelf"))  # noqa: E731  a shelf's number of blocks
    every, own = lambda i: F.explode(F.sequence(F.lit(0), of(i) - 1)), lambda i: F.pmod(F.xxhash64("id"), of(i)).cast("int")
    place = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(names, shelf, strict=True) for x in pair]), F.col("cell"))
    left = visits.select("shelf", own(0).alias("p"), every(1).alias("q"), "id", "v", "cell", "bound")
    right = dealt.select("id", "v", "cell", place.alias("shelf")).where(F.col("shelf").isin(list(blocks)))
    right = right.select("shelf", every(0).alias("p"), own(1).alias("q"), "id", "v", "cell")

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        """What the vectors of a block of visitors find in one of a shelf, cell by cell, in pieces of a bounded size."""
        found = []
        if asked.num_rows and there.num_rows:
            asked, there = asked.combine_chunks(), there.combine_chunks()
            column = lambda t, c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
            u, v = matrix(column(asked, "v")), matrix(column(there, "v"))
            a, b = (np.array(t["id"].to_pylist() if kind == "string" else t["id"].to_numpy()) for t in (asked, there))
            bound, home, cell = asked["bound"].to_numpy().astype(float), asked["cell"].to_numpy(), there["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(cell[order], prepend=-1)), len(order))
            columns = np.searchsorted(names, cell[order[cuts[:-1]]])
            for i in range(0, len(u), VISITORS):
                at = slice(i, i + VISITORS)
                may = open_cells(u[at], bound[at])[:, columns] & (names[columns] != home[at][:, None])
                ids, x, best = a[at], u[at], []
                full = may.mean(axis=1) > 0.5  # these see the whole block at once, for a long product is a fast one
                if full.any():
                    rows = np.flatnonzero(full)
                    # their home's vectors were met before and are found once more
                    best.append(_best(ids[rows], x[rows], b, v, k, euclidean, bound[at][rows]))
                for c in np.flatnonzero(may[~full].any(axis=0)) if not full.all() else []:
                    rows, here = np.flatnonzero(may[:, c] & ~full), order[cuts[c] : cuts[c + 1]]
                    best.append(_best(ids[rows], x[rows], b[here], v[here], k, euclidean, bound[at][rows]))
                if best:
                    best = pd.concat(best)
                    found.append(best.sort_values(["a", "r", "b"], ascending=[True, False, True]).groupby("a").head(k))
        if not found:
            return pa.schema([("a", there.schema.field("id").type), ("b", there.schema.field("id").type), ("similarity", pa.float64()), ("r", pa.float64())]).empty_table()
        return pa.Table.from_pandas(pd.concat(found), preserve_index=False)

    key = ["shelf", "p", "q"]
    second = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, near)
    every_one = first.drop("rank").unionByName(second).dropDuplicates(["a", "b"])
    return best(every_one).select("a", "b", "similarity", "rank")


def _best(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray, k: int, euclidean: bool, bound: np.ndarray | None = None) -> pd.DataFrame:
    """The k best of (b, v) for each of (a, u), none under its bound. A matrix product finds candidates, whose similarities are then summed anew."""
    rough, slack = u @ v.T, 1e-8
    if euclidean:
        square = (u * u).sum(1)[:, None] + (v * v).sum(1) - 2 * rough
        rough, slack = -np.sqrt(np.maximum(square, 0)), 1e-6 * (1 + np.abs(u).max() + np.abs(v).max())
    rough[a[:, None] == b] = -np.inf
    if bound is not None:  # few pass it, so that few rows are left to be sorted
        floor = np.where(np.isnan(bound), -np.inf, bound) - slack - 1e-9
        over = rough >= floor[:, None]
        many = np.flatnonzero(over.sum(1) > 4 * k)
        if len(many):
            at = max(rough.shape[1] - k, 0)
            over[many] &= rough[many] >= np.partition(rough[many], at, axis=1)[:, at, None] - slack
        i, j = np.nonzero(over & (rough > -np.inf))
    else:
        at = max(rough.shape[1] - k, 0)
        i, j = np.nonzero((rough >= np.partition(rough, at, axis=1)[:, at, None] - slack) & (rough > -np.inf))
    exact = np.empty(len(i))
    for s in range(0, len(i), 1 << 16):
        x, y = u[i[s : s + (1 << 16)]], v[j[s : s + (1 << 16)]]
        exact[s : s + (1 << 16)] = -np.sqrt(((x - y) ** 2).sum(1)) if euclidean else (x * y).sum(1)
    out = pd.DataFrame({"i": i, "a": a[i], "b": b[j], "similarity": exact, "r": np.round(exact, 9)})
    return out.sort_values(["i", "r", "b"], ascending=[True, False, True]).groupby("i").head(k)[["a", "b", "similarity", "r"]]
