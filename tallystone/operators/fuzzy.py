"""All pairs of texts within an edit distance, without comparing all pairs.

Texts are cut into padded q-grams with their places. An edit destroys q of them at most, so of q d + 1 grams of a text
at least one stands in any text within distance d, at most d places away. The rarest grams of each text are its prefix;
texts within distance d share one of their prefixes' grams. Joined by gram and length, candidates differ by at most d
in length and place, and each pair is measured once.

Short texts have too few grams for that; those of two short texts within distance d become equal when d characters or
fewer are deleted from each, so short texts are joined by what deletions leave of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

PAD = "\x00"


def _grams(q: int) -> Column:
    """(gram, place) of the padded text x."""
    padded = F.concat(F.lit(PAD * (q - 1)), F.col("x"), F.lit(PAD * (q - 1)))
    return F.transform(F.sequence(F.lit(1), F.length("x") + q - 1), lambda i: F.struct(F.substring(padded, i, F.lit(q)).alias("g"), i.alias("at")))


def _deleted(texts: Column, n: int) -> Column:
    """What is left of a text when up to n characters are deleted."""
    found = F.array(texts)
    for _ in range(n):
        once = F.flatten(F.transform(found, lambda t: F.when(F.length(t) == 0, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))))
        found = F.array_distinct(F.concat(found, once))
    return found


def similar_pairs(df: DataFrame, text: str, most: int, q: int = 2) -> DataFrame:
    """(a, b, distance) of all distinct texts a < b within an edit distance of `most`, at least 1. Nulls are left out; equal texts count once."""
    texts = stored(df.select(F.col(text).alias("x")).where("x is not null").distinct().withColumn("n", F.length("x")), "texts")
    short = q * most - (q - 1)  # at most q * most grams
    grams = texts.where(F.col("n") > short - most).select("x", "n", F.explode(_grams(q)).alias("t")).select("x", "n", "t.g", "t.at")
    grams = stored(grams, "grams")
    rarity = grams.groupBy("g").agg(F.count("*").alias("df"))
    ranked = grams.join(rarity, "g").groupBy("x", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g", "at"))).alias("t"))  # a text's grams
    last = F.element_at("t", F.least(F.size("t"), F.lit(q * most + 1)))
    # all places of the last gram belong to the prefix, so that no order of places can part two texts
    prefix = F.filter("t", lambda t: F.struct(t["df"], t["g"]) <= F.struct(last["df"], last["g"]))
    marks = stored(ranked.select("x", "n", F.explode(prefix).alias("t")).select("x", "n", "t.g", "t.at"), "prefixes")
    left = marks.select(F.col("x").alias("a"), "g", "n", F.col("at").alias("p"))
    right = marks.select(F.col("x").alias("b"), "g", F.explode(F.sequence(F.col("n") - most, F.col("n") + most)).alias("n"), F.col("at").alias("r"))
    near = left.join(right, ["g", "n"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("p") - F.col("r")) <= most)).select("a", "b")
    tiny = texts.where(F.col("n") <= short).select("x", F.explode(_deleted(F.col("x"), most)).alias("k"))
    both = tiny.select(F.col("x").alias("a"), "k").join(tiny.select(F.col("x").alias("b"), "k"), "k").where("a < b").select("a", "b")
    pairs = near.unionByName(both).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")
