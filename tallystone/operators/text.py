"""Text operators: keyword rates, n-grams, long-form TF-IDF and contrasts. Terms are rows, so that nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import ratio
from ..shipping import ship
from ..storage import read_block, stored, stored_blocks
from .shares import top


def keyword_counts(df: DataFrame, key: str, text: str, words: Sequence[str]) -> DataFrame:
    """By key: the number of rows, and of those with each word in their text, as columns. One pass, no join."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(key, low.alias("__t"))
    return rows.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("__t").contains(w.lower())).alias(w) for w in words])


def keyword_rates(df: DataFrame, key: str, text: str, words: Sequence[str], per: float = 1000.0) -> DataFrame:
    c = keyword_counts(df, key, text, words)
    return c.select(key, "total", *[ratio(F.col(w) * per, F.col("total")).alias(w) for w in words])


def first_appearance(df: DataFrame, text: str, words: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """For each word the first row that has it, in an order; words never found have nulls."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    agg = [F.min_by(F.struct(*keep), F.when(low.contains(w), F.struct(*order))).alias(w) for w in words]
    one = df.agg(*agg)
    return one.select(F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"`{w}`").alias("r")) for w in words])).alias("x")).select("x.term", *[F.col(f"x.r.{k}").alias(k) for k in keep])


def tokens(text: str | Column, least: int = 2, stops: Sequence[str] = ()) -> Column:
    """Runs of a-z of at least that length in the lower-cased text, without stop words."""
    t = F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(rf"([a-z]{{{least},}})"), 1)
    return F.filter(t, lambda x: ~x.isin(*stops)) if stops else t


def words(text: str | Column, latin: bool = False, stops: Sequence[str] = ()) -> Column:
    """Whole words of two or more letters, digits or underscores in the lower-cased text, without stop words.

    With latin only words of a-z alone: `x86` and `élan` give no token, not even a part of one.
    """
    t = F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    t = F.filter(t, lambda x: x.rlike("^[a-z]+$")) if latin else t
    return F.filter(t, lambda x: ~x.isin(*stops)) if stops else t


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def bigram_rows(df: DataFrame, keys: Sequence[str], text: str, stop: Sequence[str] = K.STOP_BIGRAMS) -> DataFrame:
    """Neighbouring tokens of three or more letters, after shorter ones are dropped."""
    cut = df.select(*keys, tokens(text, 3).alias("__w"))
    rows = cut.select(*keys, F.explode(bigrams(F.col("__w"))).alias("bigram"))
    return rows.where(~F.col("bigram").isin(*stop))


def distinctive(counts: DataFrame, group: str, term: str, least: int = 5, n: int = 25) -> DataFrame:
    """Terms of each group by lift: their rate in it over their smoothed rate elsewhere."""
    by_term, all_rows = Window.partitionBy(term), Window.partitionBy()
    groups = counts.groupBy(group).agg(F.sum("cnt").alias("n_group"))
    groups = groups.withColumn("n_all", F.sum("n_group").over(all_rows))  # one row a group
    rows = counts.withColumn("n_term", F.sum("cnt").over(by_term)).join(F.broadcast(groups), group)  # as many rows as there are groups
    lift = (F.col("cnt") / F.col("n_group")) / ((F.col("n_term") - F.col("cnt") + 1) / (F.col("n_all") - F.col("n_group") + 1))
    rows = rows.where(F.col("cnt") >= least).withColumn("lift", lift)
    return top(rows, [group], n, F.desc(F.round("lift", 9)), F.asc(term)).select(group, term, "cnt", "lift", "rank")


def _terms(found: Column, pairs: bool) -> Column:
    return F.concat(found, bigrams(found)) if pairs else found


def term_counts(df: DataFrame, doc: str | Sequence[str], text: str, least: int = 2, stops: Sequence[str] = (), pairs: bool = False, found: Column | None = None) -> DataFrame:
    """(doc, term, tf): counted map side first, so that a hot document or term costs one row a task.

    Terms are the tokens of at least that length, or those of found; doc may be several columns.
    """
    keys = [doc] if isinstance(doc, str) else list(doc)
    # in a step of its own: an expression that is used several times, as pairs do, is told anew for each use
    cut = df.select(*keys, (tokens(text, least, stops) if found is None else found).alias("__w"))
    return cut.select(*keys, F.explode(_terms(F.col("__w"), pairs)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, min_df: int, size: int | None) -> DataFrame:
    """Terms in at least min_df documents, the most frequent ones; ties by term."""
    v = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    return v if size is None else v.orderBy(F.desc("total"), "term").limit(size)


def tfidf(tf: DataFrame, doc: str, n_docs: DataFrame | None = None, min_df: int = 1, size: int | None = None) -> DataFrame:
    """Smooth idf ln((1 + n) / (1 + df)) + 1 and rows of unit length: (doc, term, w)."""
    tf = stored(tf, "tf")  # read three times: the texts are cut into terms once
    n = tf.agg(F.countDistinct(doc).alias("n")) if n_docs is None else n_docs
    v = vocabulary(tf, min_df, size).crossJoin(F.broadcast(n))  # n is one row
    rows = tf.join(v.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    # a document's length is summed map side, so that a large document is no single task's
    norm = rows.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, doc).select(doc, "term", (F.col("w") / F.col("norm")).alias("w"))


def capped_tfidf(df: DataFrame, doc: str, found: Column, size: int) -> DataFrame:
    """(doc, term, w) as of `tfidf` with pairs, min_df 2 and that size, with terms by number in their order; rows without a doc are left out.

    No table of all terms by document is made: a term's total and its least and greatest document choose the vocabulary,
    whose few terms alone are then counted by document.
    """
    cut = stored(df.where(F.col(doc).isNotNull()).select(F.col(doc).alias("d"), found.alias("__w")), "words")  # the texts are cut once
    each = cut.select("d", F.explode(_terms(F.col("__w"), True)).alias("term"))
    totals = each.groupBy("term").agg(F.count("*").alias("total"), F.min("d").alias("a"), F.max("d").alias("b")).where("a < b")  # in two documents or more
    v = totals.orderBy(F.desc("total"), "term").limit(size).select("term")
    v = stored(v.withColumn("i", F.row_number().over(Window.orderBy("term")) - 1), "vocabulary")  # at most size rows
    tf = stored(each.join(F.broadcast(v), "term").groupBy("d", "i").agg(F.count("*").alias("tf")), "tf")
    n = cut.where(F.size("__w") > 0).agg(F.countDistinct("d").alias("n"))  # one row
    idf = tf.groupBy("i").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("i", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = tf.join(F.broadcast(idf), "i").withColumn("w", F.col("tf") * F.col("idf"))  # at most size rows
    norm = rows.groupBy("d").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return stored(rows.join(norm, "d").select(F.col("d").alias(doc), F.col("i").alias("term"), (F.col("w") / F.col("norm")).alias("w")), "weights")


def cosine(weights: DataFrame, doc: str, block: int = 1024, shards: int = 64) -> DataFrame:
    """(a, b, similarity) of documents of unit length that share a term, a < b: for a bounded number of grouped documents.

    Pairs of blocks of about `block` documents meet in `shards` parts by terms. So a term of all documents makes at
    most block * block products in a task, and a task returns a pair of documents once, whatever terms they share.
    """
    w = stored(weights.select(F.col(doc).alias("d"), "term", "w"), "weights")
    parts = -(-w.select("d").distinct().count() // block) or 1
    own, shard = F.pmod(F.xxhash64("d"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")
    w = w.select("d", "term", "w", own.alias("o"), shard.alias("s"))
    cell = ["p", "q", "s"]
    low = w.select("d", "term", "w", F.col("o").alias("p"), F.explode(F.sequence("o", F.lit(parts - 1))).alias("q"), "s")
    high = w.select("d", "term", "w", F.explode(F.sequence(F.lit(0), "o")).alias("p"), F.col("o").alias("q"), "s")
    x = low.repartition(*cell).select(*cell, "term", F.col("d").alias("x"), F.col("w").alias("wx"))
    y = high.repartition(*cell).select(*cell, "term", F.col("d").alias("y"), F.col("w").alias("wy"))
    # within one block a pair comes in both orders, between two in one
    met = x.join(y.hint("shuffle_hash"), [*cell, "term"]).where((F.col("p") < F.col("q")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    sums = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(F.col("wx") * F.col("wy")).alias("similarity"))
    return sums


#: Documents of a block; a task holds the similarities of two blocks. Products that are expanded at once.
SIMILAR_BLOCK, PRODUCTS = 4096, 1 << 20


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, w) of every weight in a block of documents, by term."""
    terms = [np.frombuffer(x, np.int64) for x in t["terms"].to_pylist()]
    row = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
    term, w = np.concatenate(terms), np.concatenate([np.frombuffer(x, np.float64) for x in t["ws"].to_pylist()])
    order = np.argsort(term, kind="stable")
    return row[order], term[order], w[order]


def block_products(left: tuple, right: tuple, rows: int, columns: int) -> np.ndarray:
    """All dot products of two blocks of sparse vectors: very frequent terms by a matrix product, others term by term, rare ones many at once."""
    out = np.zeros((rows, columns))
    (r, s, u), (c, t, v) = left, right
    known, first, n = np.unique(s, return_index=True, return_counts=True)
    other, start, m = np.unique(t, return_index=True, return_counts=True)
    _, i, j = np.intersect1d(known, other, assume_unique=True, return_indices=True)
    first, n, start, m = first[i], n[i], start[j], m[j]
    work = n * m
    frequent = np.flatnonzero(work > rows * columns // 50)
    for at in range(0, len(frequent), 256):
        some = frequent[at : at + 256]
        x, y = np.zeros((rows, len(some))), np.zeros((columns, len(some)))
        for k, z in enumerate(some):
            x[r[first[z] : first[z] + n[z]], k] = u[first[z] : first[z] + n[z]]
            y[c[start[z] : start[z] + m[z]], k] = v[start[z] : start[z] + m[z]]
        out += x @ y.T
    for z in np.flatnonzero((work <= rows * columns // 50) & (work > 512)):
        a, b = slice(first[z], first[z] + n[z]), slice(start[z], start[z] + m[z])
        out[r[a][:, None], c[b]] += u[a][:, None] * v[b]
    rare = np.flatnonzero((work <= 512) & (work <= rows * columns // 50))
    flat, total = out.reshape(-1), np.cumsum(work[rare])
    for at in range(0, int(total[-1]) if len(total) else 0, PRODUCTS):
        some = rare[(total > at) & (total <= at + PRODUCTS)]
        k = np.repeat(np.arange(len(some)), work[some])
        place = np.arange(len(k)) - np.repeat(np.cumsum(work[some]) - work[some], work[some])
        a, b = first[some][k] + place // m[some][k], start[some][k] + place % m[some][k]
        np.add.at(flat, r[a] * columns + c[b], u[a] * v[b])
    return out


def similar(weights: DataFrame, doc: str, least: float) -> DataFrame:
    """(a, b, similarity) of all pairs of unit vectors with a similarity of at least `least` > 0, a < b; exact.

    Blocks of documents meet in pairs, with their whole vectors; a task reads a pair of blocks where they are stored,
    multiplies it out and returns the similar pairs. The work is the square of the number of documents, but nothing is
    made for a pair that is not similar, nor for a term of a pair, and no copy of a block is shuffled: what is stored
    and shuffled grows with the documents. The sums are compared after rounding to 12 digits. Terms of one document
    cannot be shared and are left out.
    """
    ship(weights.sparkSession)
    w = stored(weights.select(F.col(doc).alias("d"), "term", "w").where("w > 0 and d is not null"), "weights")
    terms = stored(w.groupBy("term").agg(F.count("*").alias("df")).where("df > 1").select("term", F.monotonically_increasing_id().alias("t")), "terms")
    kind = w.schema["d"].dataType.simpleString()
    lists = w.join(terms, "term").groupBy("d").agg(F.collect_list(F.struct("t", "w")).alias("v")).select("d", F.col("v.t").alias("t"), F.col("v.w").alias("w"))  # one vector's terms

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[x.values.to_numpy().tobytes() for x in batch.column(i)] for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in both)], names=["d", "terms", "ws"])

    packed = stored(lists.mapInArrow(pack, f"d {kind}, terms binary, ws binary"), "vectors")
    n = packed.count()
    parts = max(1, -(-n // SIMILAR_BLOCK), min(8, -(-n // 256)))
    path = stored_blocks(packed, F.pmod(F.xxhash64("d"), F.lit(parts)), parts, "similar")
    block = lambda p: pa.concat_tables([t.select(["d", "terms", "ws"]) for t in read_block(path, p)] or [pa.table({"d": []})])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, pa.Table, tuple] | None = None  # the first block of the pair before, which neighbours share
        for batch in batches:
            for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None or held[0] != p:
                    left = block(p)
                    held = p, left, _entries(left) if left.num_rows else ()
                left, right = held[1], held[1] if p == q else block(q)
                if not left.num_rows or not right.num_rows:
                    continue
                x = block_products(held[2], held[2] if p == q else _entries(right), left.num_rows, right.num_rows)
                i, j = np.nonzero(x >= least - 1e-9)
                similarity = x[i, j]
                a, b = (t["d"].take(pa.array(k)) for t, k in ((left, i), (right, j)))
                out = pa.table({"a": a, "b": b, "similarity": pa.array(similarity)})
                # within one block a pair comes in both orders, between two in one
                out = out.filter(pc.less(out["a"], out["b"]) if p == q else pc.not_equal(out["a"], out["b"]))
                yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    spark = weights.sparkSession
    pairs = spark.range(0, parts * parts).select(F.floor(F.col("id") / parts).cast("int").alias("p"), (F.col("id") % parts).cast("int").alias("q")).where("p <= q")
    # a few pairs of blocks a task, of one first block where it can be; so many tasks that none is long
    tasks = pairs.repartitionByRange(max(1, min(parts * (parts + 1) // 2, 10_000)), "p", "q").sortWithinPartitions("p", "q")
    both = tasks.mapInArrow(meet, f"a {kind}, b {kind}, similarity double")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").where(F.round("similarity", 12) >= least)


def log_odds(tf: DataFrame, group: str, sides: tuple[str, str], smooth: float = 0.5) -> DataFrame:
    """Each term's smoothed log odds between two groups: (term, n_first, n_second, log_odds)."""
    p = stored(tf.groupBy("term").pivot(group, list(sides)).agg(F.sum("tf")).fillna(0), "odds")
    a, b = (F.col(s).cast("double") for s in sides)
    sums = p.agg(F.sum(a).alias("__a"), F.sum(b).alias("__b"), F.count("*").alias("__v"))  # one row
    p = p.crossJoin(F.broadcast(sums))
    odds = F.log((a + smooth) / (F.col("__a") - a + smooth * F.col("__v"))) - F.log((b + smooth) / (F.col("__b") - b + smooth * F.col("__v")))
    return p.select("term", F.col(sides[0]).alias("n_first"), F.col(sides[1]).alias("n_second"), odds.alias("log_odds"))


def contrast(df: DataFrame, side: str, sides: tuple[str, str], scope: str, found: Column, min_df: int = 5, size: int = 6000, least_rows: int = 50, smooth: float = 0.5) -> DataFrame:
    """(scope, term, n_first, n_second, log_odds): how much more often a term is used on one side than on the other.

    A row is a document. Terms are words and pairs in at least min_df documents, the size most frequent ones; the ratio
    is that of their smoothed shares of all terms. It is made for all rows (scope `overall`) and for each scope of at
    least least_rows rows that has both sides. Every term is in every scope, with zeros where it does not occur.

    A term's first place in its row is told within the row, so that documents are counted in the same sums as terms,
    map side, and no table of terms by document is made.
    """
    rows = df.where(F.col(side).isin(*sides))
    marked = F.transform("__t", lambda t, i: F.struct(t.alias("term"), F.when((i == 0) | (t != F.get(F.col("__t"), i - 1)), 1).otherwise(0).alias("first")))
    cut = rows.select(F.col(side).alias("side"), F.col(scope).alias("scope"), found.alias("__w"))
    each = cut.select("side", "scope", F.sort_array(_terms(F.col("__w"), True)).alias("__t")).select("side", "scope", F.inline(marked))
    tf = stored(each.groupBy("side", "scope", "term").agg(F.count("*").alias("tf"), F.sum("first").alias("df")), "contrast")
    v = tf.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    v = stored(v.orderBy(F.desc("total"), "term").limit(size).select("term"), "vocabulary")  # at most size rows
    used = tf.join(F.broadcast(v), "term").groupBy("scope", "term").agg(*[F.sum(F.when(F.col("side") == s, F.col("tf")).otherwise(0)).alias(k) for s, k in zip(sides, ("a", "b"), strict=True)])
    used = stored(used, "contrast")  # at most size rows a scope
    n = rows.groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("n"), *[F.count_if(F.col(side) == s).alias(k) for s, k in zip(sides, ("x", "y"), strict=True)])
    scopes = n.where(f"n >= {least_rows} and x > 0 and y > 0 and scope is not null").select(F.col("scope").cast("string").alias("scope"))
    every = n.agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("x > 0 and y > 0").select(F.lit("overall").alias("scope"))
    counts = used.select(F.col("scope").cast("string").alias("scope"), "term", "a", "b").unionByName(used.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(F.lit("overall").alias("scope"), "term", "a", "b"))
    names = scopes.unionByName(every).agg(F.collect_set("scope").alias("names"))  # one row
    grid = v.crossJoin(F.broadcast(names)).select("term", F.explode("names").alias("scope"))
    full = grid.join(counts, ["scope", "term"], "left").fillna(0, ["a", "b"])
    w = Window.partitionBy("scope")  # a scope has the vocabulary's terms
    share = lambda k: (F.col(k) + smooth) / (F.sum(k).over(w) + smooth * F.count("*").over(w))
    return full.select("scope", "term", F.col("a").alias("n_first"), F.col("b").alias("n_second"), F.log(share("a") / share("b")).alias("log_odds"))


def payee_types(df: DataFrame, key: str, category: str, categories: Sequence, kinds: Mapping[str, Column]) -> DataFrame:
    """(key, category, n, a rate in per cent for each kind): for all rows (category `all`) and for each of the categories; nulls where there is none."""
    flags = {k: c.cast("double") for k, c in kinds.items()}
    rows = df.select(key, F.col(category).cast("string").alias("category"), *[c.alias(k) for k, c in flags.items()])
    sums = rows.groupBy(key, "category").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in kinds])
    total = sums.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", *kinds)]).withColumn("category", F.lit("all"))
    wanted = total.select(key, F.explode(F.array(*[F.lit(str(c)) for c in categories])).alias("category"))  # a few rows a key
    out = wanted.join(sums, [key, "category"], "left").fillna(0, ["n"]).unionByName(total.select(key, "category", "n", *kinds))
    return out.select(key, "category", "n", *[ratio(F.col(k) * 100.0, F.col("n")).alias(k) for k in kinds])


def complexity(df: DataFrame, key: str, text: str, patterns: Mapping[str, Column]) -> DataFrame:
    """Mean and median number of words, and the rate of rows that match each pattern."""
    rows = df.withColumn("__n", F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "")))
    return rows.groupBy(key).agg(F.count("*").alias("total_entries"), F.avg("__n").alias("avg_words"), F.median("__n").alias("median_words"), *[F.avg(p.cast("double")).alias(k) for k, p in patterns.items()])
