"""Hooks for models that live outside: replies, enrichment and embeddings, batched, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..shipping import ship, small_batches

Provider = Callable[[list[str]], list[str]]

#: Words that decide a category, the first group that has one.
CATEGORY_WORDS = {
    "land_rent": ["rent", "tenement", "farm"], "ecclesiastical": ["chapel", "church", "vicar", "tithe"], "maintenance": ["repair", "mason", "glazier", "carpenter"], "salary_stipend": ["stipend", "salary", "wages"],
    "educational": ["tuition", "scholar", "exhibition"], "financial": ["dividend", "interest", "consols", "loan"], "domestic": ["kitchen", "butler", "coal", "bread"], "charitable": ["alms", "poor", "charity"], "administrative": ["postage", "stationery", "audit"],
}
PERIOD_WORDS = {"half_year": ["half year", "half-year"], "annual": ["per annum", "annual", "yearly"], "biennial": ["two years"], "triennial": ["three years"]}


def replies(df: DataFrame, prompt: str, provider: Provider, batch: int = 30, name: str = "reply") -> DataFrame:
    """One reply a row, asked for in batches; a batch that fails has empty replies."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[str] = []
            for i in range(0, len(part), batch):
                asked = part[prompt].fillna("").tolist()[i : i + batch]
                try:
                    got = provider(asked)
                except Exception:  # noqa: BLE001  a provider may fail in any way
                    got = []
                out += got if len(got) == len(asked) else [""] * len(asked)
            yield part.assign(**{name: out})

    ship(df.sparkSession)
    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` string"]))


def stub(prompts: list[str]) -> list[str]:
    """A stand-in for a model: the labels that the keyword rules give, as fenced JSON."""
    return [f"```json\n{json.dumps({'category': _first(p.lower(), CATEGORY_WORDS, 'other'), 'payment_period': _first(p.lower(), PERIOD_WORDS, 'unclear')})}\n```" for p in prompts]


def _first(text: str, groups: dict[str, list[str]], default: str) -> str:
    return next((k for k, words in groups.items() if any(w in text for w in words)), default)


def enriched(rows: DataFrame) -> DataFrame:
    """Labels by keyword rules, all built in: direction by header or side, category, period, arrears; null on rows that are no entries."""
    entry = F.col("row_type") == "entry"
    text = F.lower(F.coalesce("description", F.lit("")))
    late = F.concat_ws(" ", F.lower("section_header"), text).rlike("arrear")
    side = S.lookup("side", {"left": "income", "right": "expenditure"})
    return rows.withColumns(
        {
            "direction": F.when(entry, F.coalesce(S.header_direction("section_header"), side, F.lit("unclear"))),
            "category": F.when(entry, S.first_group(text, CATEGORY_WORDS, "other")),
            "payment_period": F.when(entry, S.first_group(text, PERIOD_WORDS, "unclear")),
            "is_arrears": F.when(entry, late),
        }
    )


def candidates(parts: dict[str, DataFrame], page: str = "page_id") -> DataFrame:
    """(page, best): the candidate with most rows for each page, the first named among equals."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        n = df.groupBy(page).agg(F.count("*").alias("n")).select(page, F.lit(name).alias("name"), F.lit(i).alias("ord"), "n")
        out = n if out is None else out.unionByName(n)
    return out.groupBy(page).agg(F.min_by("name", F.struct(-F.col("n"), "ord")).alias("best"))


def retried(scores: DataFrame, run: Callable[[DataFrame], DataFrame], least: float = 0.7, times: int = 2) -> DataFrame:
    """Pages under a score are run again, up to so many times; the better score stays. scores: page, combined."""
    for _ in range(times):
        again = run(scores.where(F.col("combined") < least)).select("page", F.col("combined").alias("__c"))
        scores = scores.join(again, "page", "left").withColumn("combined", F.greatest("combined", "__c")).drop("__c")
    return scores


def model_grid(**models: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """All combinations of models for each page, from literal lists."""

    def grid(pages: DataFrame) -> DataFrame:
        for k, v in models.items():
            pages = pages.withColumn(k, F.explode(F.array(*map(F.lit, v))))
        return pages

    return grid


#: Words whose hashes an embedding remembers within a batch.
WORDS = 50_000


def embedding(text: Column | str, size: int = 64) -> Column:
    """A stand-in for an embedding model: hashed words, of unit length."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        known: dict[str, tuple[int, int]] = {}
        for t in texts:
            v = [0.0] * size
            for m in re.finditer(r"\w+", (t or "").lower()):
                if (got := known.get(m[0])) is None:
                    h = int.from_bytes(hashlib.blake2b(m[0].encode(), digest_size=8).digest(), "big")
                    if len(known) >= WORDS:
                        known.clear()
                    got = known[m[0]] = (h % size, 1 if h >> 63 else -1)
                v[got[0]] += got[1]
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return pd.Series(out)

    small_batches(SparkSession.active())
    return F.pandas_udf(run, "array<double>")(text)
