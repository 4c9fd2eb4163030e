"""Column builders for the cleaning rules: all are built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str, default: float | None = None) -> Column:
    out = F.when(F.trim(_c(x).cast("string")) != "", _c(x).cast("string").try_cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def money(x: Column | str) -> Column:
    """Amounts as typed: all but digits, dots and signs is dropped; what is no number then is 0."""
    return number(F.regexp_replace(_c(x).cast("string"), r"[^0-9.\-]", ""), 0.0)


def money_strict(x: Column | str) -> Column:
    """As money, but what is no number after cleaning is an error; empty is 0."""
    s = F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), r"[^0-9.\-]", "")
    bad = F.raise_error(F.concat(F.lit("not an amount: "), s)).cast("double")
    return F.when(s == "", 0.0).otherwise(F.coalesce(s.try_cast("double"), bad))


def fraction(x: Column | str, texts: str = "numbers") -> Column:
    """Fraction glyphs and their spellings, else the number itself, else 0.

    texts tells which other texts are numbers: any that reads as one (`numbers`), those of digits and dots only
    (`digits`), or none (`none`).
    """
    s = F.lower(F.trim(_c(x).cast("string")))
    other = {"numbers": number(s, 0.0), "digits": F.coalesce(F.when(s.rlike(r"^[0-9.]+$"), s.try_cast("double")), F.lit(0.0)), "none": F.lit(0.0)}[texts]
    return F.coalesce(lookup(s, K.FRACTIONS), other)


def pounds(p: Column, s: Column, d: Column, f: Column) -> Column:
    """Decimal pounds from pounds, shillings, pence and a fraction of a penny."""
    return p + s / 20 + (d + f) / 240


def pence(p: Column | str, s: Column | str, d: Column | str) -> Column:
    """Whole pence, each part cut to an integer; the fraction does not count."""
    whole = lambda x: number(x, 0.0).cast("long")
    return whole(p) * 240 + whole(s) * 12 + whole(d)


def normal_value(x: Column | str) -> Column:
    """Trimmed, without a trailing .0; "0" and null are the empty text."""
    s = F.regexp_replace(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))), r"\.0$", "")
    return F.when(s == "0", "").otherwise(s)


def clean_description(x: Column | str) -> Column:
    """Lower case, trimmed, one pair of matching outer quotes dropped."""
    s = F.trim(F.lower(F.coalesce(_c(x), F.lit(""))))
    return F.regexp_replace(s, r"""^(["'])(.*)\1$""", "$2")


def interpolate(x: Column | str, anchors: Mapping[int, float]) -> Column:
    """Piecewise linear between anchors, level beyond the ends: one CASE expression, no join."""
    x, points = _c(x), sorted(anchors.items())
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, y), (b, z) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, F.lit(y) + (x - a) * (z - y) / (b - a))
    return out.otherwise(F.when(x.isNotNull(), F.lit(points[-1][1])))


def price_index(year: Column | str, anchors: Mapping[int, float] | None = None) -> Column:
    return interpolate(year, anchors or K.PRICE_ANCHORS)


def era(year: Column | str, scheme: Sequence[tuple] = K.ERAS3) -> Column:
    y, out = _c(year), None
    for bound, inclusive, name in scheme:
        if bound is None:
            return F.when(y.isNull(), None).otherwise(out.otherwise(name))
        test = (y <= bound) if inclusive else (y < bound)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def decade(year: Column | str) -> Column:
    return (F.floor(_c(year) / 10) * 10).cast("int")


def page_years(page_id: Column | str, typo_gap: int | None = 5) -> Column:
    """The years of a page id: YYYY_n_image, YYYY-YYYY_n_image, else the first four digits, else null.

    A reversed span of more than typo_gap years is a typing error of the second year and means the next year;
    with typo_gap None the ends are swapped whatever their distance.
    """
    p = _c(page_id)
    part = lambda rx, k: F.regexp_extract(p, rx, k).try_cast("int")
    one, span = r"^(\d{4})_(\d+)_image$", r"^(\d{4})-(\d{4})_(\d+)_image$"
    a, b = part(span, 1), part(span, 2)
    end = b if typo_gap is None else F.when(a - b > typo_gap, a + 1).otherwise(b)
    any4 = part(r"(\d{4})", 1)
    return (
        F.when(p.rlike(one), F.array(part(one, 1)))
        .when(p.rlike(span), F.sequence(F.least(a, end), F.greatest(a, end)))
        .when(any4.isNotNull(), F.array(any4))
    )


def page_number(page_id: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(_c(page_id), r"^\d{4}(?:-\d{4})?_(\d+)_image$", 1).try_cast("int"), F.lit(1))


def natural_key(page_id: Column | str) -> Column:
    """Sorts page ids by their numbers."""
    return F.transform(F.regexp_extract_all(_c(page_id), F.lit(r"(\d+)"), 1), lambda x: x.try_cast("long"))


def normal_text(x: Column | str) -> Column:
    """Lower case; all but a-z, 0-9 and blanks becomes a blank; blanks collapse."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normal_header(x: Column | str) -> Column:
    """Lower case without years; null where only digits and punctuation are left."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"\b\d{4}[\.:]?\b", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(s.rlike(r"[a-z]"), s)


def coerced(x: Column | str, domain: Sequence[str], fallback: str, row_type: Column | str | None = None) -> Column:
    """A value of a domain, else the fallback; null on rows that are no entries."""
    s = F.lower(F.trim(_c(x)))
    out = F.when(s.isin(*domain), s).otherwise(fallback)
    return out if row_type is None else F.when(F.lower(F.trim(_c(row_type))) == "entry", out)


def header_direction(header: Column | str) -> Column:
    """What a section header says: expenditure by its beginning, else income by a word in it, else null."""
    h = F.lower(F.trim(_c(header)))
    return F.when(h.rlike("^(" + "|".join(K.HEADER_EXPENDITURE) + ")"), "expenditure").when(any_of(h, K.HEADER_INCOME), "income")


def any_of(x: Column | str, words: Sequence[str]) -> Column:
    """Whether any of some words is in a text."""
    return reduce(lambda a, b: a | b, [_c(x).contains(w) for w in words])


def first_group(x: Column | str, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first group with a word in the text."""
    s, out = F.lower(F.coalesce(_c(x), F.lit(""))), None
    for name, words in groups.items():
        out = F.when(any_of(s, words), name) if out is None else out.when(any_of(s, words), name)
    return out.otherwise(default)


def names(x: Column | str) -> Column:
    """A list written with semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "")


def lookup(x: Column | str, table: Mapping) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(_c(x) == k, F.lit(v)) if out is None else out.when(_c(x) == k, F.lit(v))
    return out


def band(x: Column | str, bounds: Sequence[tuple[float, str]], last: str) -> Column:
    """The name of the first bound that a value reaches."""
    out = None
    for bound, name in bounds:
        out = F.when(_c(x) >= bound, name) if out is None else out.when(_c(x) >= bound, name)
    return F.when(_c(x).isNotNull(), out.otherwise(last))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(_c(a).cast("double"), F.nullif(_c(b).cast("double"), F.lit(0.0)))


def exactly_rounded(x: Column, digits: int) -> Column:
    """x to some digits by its exact binary value, halves to the even digit: `round` goes by the decimal text of a number instead.

    x times a power of ten is a rounded product and its exact error (both factors are split into halves of 26 bits).
    """
    scale = 10.0**digits
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    top = high(scale)

    def nearest(v: Column) -> Column:
        product, a = v * scale, high(v)
        error = ((a * top - product) + a * (scale - top) + (v - a) * top) + (v - a) * (scale - top)
        whole = F.floor(product).cast("double")
        rest = product - whole
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2.0)) == 1))))
        return (whole + F.when(up, 1.0).otherwise(0.0)) / scale

    return F.transform(F.array(x), nearest)[0]  # x, which may be a long expression, is written once


def lev_ratio(a: Column | str, b: Column | str) -> Column:
    """1 - 2 d / (lengths), 1 for two empty texts; below 0 for very different ones."""
    n = F.length(_c(a)) + F.length(_c(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - 2.0 * F.levenshtein(_c(a), _c(b)) / n)


def amount_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a).cast("double"), _c(b).cast("double")
    top = F.greatest(a, b)
    return F.when(top == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.nullif(top, F.lit(0.0))))


def count_similarity(p: Column | str, g: Column | str) -> Column:
    """Agreement of two counts; without expected rows, 1 if there are none and 0 else."""
    p, g = _c(p).cast("double"), _c(g).cast("double")
    return F.when(g == 0, F.when(p == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(p - g) / F.nullif(g, F.lit(0.0))))


def currency_valid(p: Column, s: Column, d: Column) -> Column:
    return (p >= 0) & s.between(0, 19) & d.between(0, 11)


def json_reply(x: Column | str) -> Column:
    """The JSON text in a reply: inside fences if there are any, from the first brace to the last; null if not valid."""
    s = F.coalesce(_c(x), F.lit(""))
    inner = F.coalesce(F.nullif(F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), s)
    braces = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    return F.when((braces != "") & (F.json_array_length(F.concat(F.lit("["), braces, F.lit("]"))) == 1), braces)
