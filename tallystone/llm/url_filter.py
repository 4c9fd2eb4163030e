"""Operator 2: URL filters as a cascade of Bloom filters, in DataFrame functions only.

A list of (host, path) keys is encoded by a cascade over the complete universe of keys that the corpus can ask
for. Level 1 holds the listed keys; level 2 holds the unlisted keys of the corpus that level 1 lets through;
level 3 the listed keys that level 2 lets through, and so on until a level lets nothing wrong through. A key is
listed if the first level that rejects it has an even number, so membership is exact for every key of the corpus,
without a join against the list: each level is a bit array that a scalar subquery hands to the scan. Level 1 gets the
more bits a key the larger the universe is, so many that it lets no more unlisted keys through than the list has (or
LEAST_PASSING); so every level is bounded by the list, and its size grows with the corpus by a logarithm only.

A host is looked up by those of its suffixes that have as many labels as some listed host, a path by those of its
prefixes that are as long as some listed path; both are sets of numbers that grow with the list's shape, not with
the corpus. The list itself is a bounded input (LIST_BOUND keys), as it is in a URL filter's configuration.

Null urls, and urls without "://", have an empty host and path and match nothing. Rows with equal urls get equal
results. An empty table gives no rows, an empty list lets the default verdict stand for all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

#: Most listed keys of one filter: at 10 to 43 bits a key (43 for 10**15 keys of the corpus) its first level is 1 to 5 MB.
LIST_BOUND = 1_000_000
#: Unlisted keys that level 1 may let through however short the list is, and its greatest rate of them.
LEAST_PASSING, FIRST_RATE = 1000, 1e-3
#: Listed (verdict, host, path): block or allow a host with all its subdomains, where the path starts so.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_AZ, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased. Path: from there up to ? or #."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, _AZ, _LOWER), path


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> list[Column]:
    """The (host suffix, path prefix) pairs that a listed key of these shapes could equal, as strings or null."""
    parts = F.split(host, r"\.", -1)
    suffixes = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return [F.concat(h, F.lit(" "), p) for h in suffixes for p in prefixes]


class Level:
    """One Bloom filter: a bit array in 64-bit words, as a scalar subquery over at most n keys."""

    def __init__(self, keys: DataFrame, n: int, fpr: float, number: int):
        bits = max(64, math.ceil(-max(n, 1) * math.log(fpr) / math.log(2) ** 2))
        self.words = (bits + 63) // 64
        self.hashes = max(1, round(self.words * 64 / max(n, 1) * math.log(2)))
        self.hashes = min(self.hashes, 30)
        self.number = number
        words = keys.select(F.explode(F.array(*self._positions(F.col("key")))).alias("bit")).select(
            F.expr("int(bit div 64)").alias("word"), F.expr("shiftleft(1L, int(bit % 64))").alias("mask")
        )
        words = words.groupBy("word").agg(F.bit_or("mask").alias("mask"))
        filled = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
        # at most self.words entries are gathered, a number that the list bounds
        self.table = materialize(
            filled.select(F.transform(F.sequence(F.lit(0), F.lit(self.words - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("w")),
            f"bloom{number}",
        )

    def _positions(self, key: Column) -> list[Column]:
        salted = F.xxhash64(key, F.lit(self.number))
        first, step = F.pmod(salted, F.lit(1 << 31)), F.pmod(F.shiftrightunsigned(salted, 31), F.lit(1 << 31))
        return [F.pmod(first + step * i, F.lit(self.words * 64)) for i in range(self.hashes)]

    def contains(self, key: Column) -> Column:
        """Whether all bits of a key are set; the words come from a scalar subquery, once a query."""
        words = self.table.select("w").scalar()
        hit = F.lit(True)
        for p in self._positions(key):
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))
            hit = hit & (F.get(words, F.floor(p / 64).cast("int")).bitwiseAND(bit) != 0)
        return hit


class BloomCascade:
    """Exact membership of corpus keys in a list: see the module's text.

    listed and universe have one string column, key; universe need not be distinct. asked is at least the universe's
    number of keys; it is counted if not given.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, asked: int | None = None):
        self._first(listed, universe.count() if asked is None else asked)
        BloomCascade._others([self], universe)

    @classmethod
    def together(cls, lists: dict[str, DataFrame], universe: DataFrame, asked: int) -> dict[str, BloomCascade]:
        """A cascade for each list, from one pass over the universe."""
        found = {}
        for name, listed in lists.items():
            found[name] = cls.__new__(cls)
            found[name]._first(listed, asked)
        cls._others(list(found.values()), universe)
        return found

    def _first(self, listed: DataFrame, asked: int) -> None:
        self.listed = materialize(listed.select("key").where("key is not null").distinct(), "listed")
        self.size = self.listed.count()
        if self.size > LIST_BOUND:
            raise ValueError(f"a list of {self.size} keys is over the bound of {LIST_BOUND}")
        rate = min(FIRST_RATE, max(self.size, LEAST_PASSING) / max(asked, 1))
        self.levels = [Level(self.listed, self.size, rate, 1)] if self.size else []

    @staticmethod
    def _others(cascades: list[BloomCascade], universe: DataFrame) -> None:
        cascades = [c for c in cascades if c.size]
        if not cascades:
            return
        # Keys that a level 1 lets through, listed or not: one aggregation tells them apart, without a join.
        n = range(len(cascades))
        tagged = universe.select("key", *[c.levels[0].contains(F.col("key")).alias(f"p{i}") for i, c in enumerate(cascades)])
        tagged = tagged.where(" or ".join(f"p{i}" for i in n)).select("key", *[f"p{i}" for i in n], *[F.lit(False).alias(f"l{i}") for i in n])
        for i, c in enumerate(cascades):
            tagged = tagged.unionByName(c.listed.select("key", *[F.lit(False).alias(f"p{k}") for k in n], *[F.lit(k == i).alias(f"l{k}") for k in n]))
        tagged = materialize(tagged.groupBy("key").agg(*[F.max(f"{x}{i}").alias(f"{x}{i}") for x in "pl" for i in n]), "cascade")
        for i, c in enumerate(cascades):
            encoded, others = tagged.where(f"p{i} and not l{i}").select("key"), c.listed  # what the next level holds, and what it must not let through
            while (size := encoded.count()) > 0:
                level = Level(encoded, size, 0.5 if len(c.levels) > 1 else 0.05, len(c.levels) + 1)
                c.levels.append(level)
                encoded, others = materialize(others.where(level.contains(F.col("key"))), "cascade"), encoded

    def contains(self, key: Column) -> Column:
        """True for the listed keys among those of the universe."""
        found = F.lit(len(self.levels) % 2 == 1)
        for k, level in reversed(list(enumerate(self.levels, 1))):
            found = F.when(~level.contains(key), F.lit(k % 2 == 0)).otherwise(found)
        return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Each url's longest fitting rule and verdict: (page_id, host, path, rule, verdict).

    One cascade for each verdict tells which of a url's candidate keys it lists; the longest listed key wins.
    default: the method's verdict for urls that no listed key fits.
    """
    spark = pages.sparkSession
    host, path = host_and_path(col(url_col))
    rows = pages.select(col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, lengths = sorted({h.count(".") + 1 for _, h, _ in rules}), sorted({len(p) for _, _, p in rules})
    keys = candidate_keys(F.col("host"), F.col("path"), labels, lengths)
    names = [f"key{i}" for i in range(len(keys))]
    rows = rows.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    universe = rows.select(F.explode(F.array_compact(F.array(*names))).alias("key"))
    asked = pages.count() * len(keys)
    found = []
    lists = {v: spark.range(1).select(F.explode(F.array(*[F.lit(f"{h} {p}") for w, h, p in rules if w == v])).alias("key")) for v in sorted({v for v, _, _ in rules})}
    for verdict, cascade in BloomCascade.together(lists, universe, asked).items():
        for n in names:
            key = F.struct(F.length(n).alias("n"), F.replace(F.col(n), F.lit(" "), F.lit("")).alias("rule"), F.lit(verdict).alias("verdict"))
            found.append(F.when(F.col(n).isNotNull() & cascade.contains(F.col(n)), key))
    rows = rows.select("page_id", "host", "path", F.array_max(F.array(*found)).alias("best"))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, arg_max(struct_pack(rule := h || p, verdict := verdict), length(h || p)) AS best
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, s.host, s.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id
"""
