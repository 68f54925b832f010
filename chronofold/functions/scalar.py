"""Scalar functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.operators.guards import finite


def zfill(c: Column, width: int) -> Column:
    """Zeros on the left; longer values are left alone."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def normalize_cik(c: Column) -> Column:
    """Ten digits, from text with or without a trailing ``.0``; zero and anything else is null."""
    digits = F.regexp_replace(F.trim(c), r"\.0$", "")
    return F.when(digits.rlike(r"^\d{1,10}$") & ~digits.rlike("^0+$"), zfill(digits, 10))


def normalize_ticker(c: Column) -> Column:
    """Upper case with dashes for dots; null unless one to ten letters, digits, dots or dashes."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike(r"^[A-Z0-9.\-]{1,10}$"), F.replace(t, F.lit("."), F.lit("-")))


#: Legal forms and their short names.
FORMS = {"corporation": "corp", "incorporated": "inc", "company": "co", "limited": "ltd"}


def legal_name(c: Column) -> Column:
    """Lower case words without marks, state suffixes dropped, legal forms shortened."""
    t = F.lower(F.regexp_replace(c, r"/[A-Za-z]{2}/", " "))
    words = F.split(F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), " ")
    names = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(names[w], w)), " ")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def last_completed_quarter(d: Column) -> Column:
    """First day of the last month of the quarter before the date's."""
    return F.add_months(F.trunc(d, "quarter"), -1)


def bin_right_closed(v: Column, edges: Sequence[float]) -> Column:
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((v > edges[i]) & (v <= edges[i + 1]), i).otherwise(out)
    return out


def bin_left_closed(v: Column, edges: Sequence[float]) -> Column:
    """Left-closed; the last bin has both ends."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        upper = v <= edges[i + 1] if i == len(edges) - 2 else v < edges[i + 1]
        out = F.when((v >= edges[i]) & upper, i).otherwise(out)
    return out


def one_hot(c: Column, values: Sequence[str]) -> dict[str, Column]:
    return {v: F.coalesce((c == v).cast("int"), F.lit(0)) for v in values}


def sha_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def md5_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]))


def logit_clip(p: Column, margin: float = 1e-7) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - margin)), F.lit(margin))
    return F.ln(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bounded_score(z: Column) -> Column:
    """From (0, 1), falling in z."""
    return 0.5 + F.atan(-z) / math.pi


def decay_weight(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age / half_life)


def archive_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit(base), cik.cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def url_ok(url: Column) -> Column:
    """https with a host."""
    return F.coalesce(url.startswith("https://") & F.regexp_like(url, F.lit("^https://[^/]+")), F.lit(False))


def item_codes(c: Column) -> Column:
    """Distinct item codes, such as 5.02, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+\.\d{2})"), F.lit(1)))


def first_finite(*columns: Column) -> Column:
    return F.coalesce(*[finite(c) for c in columns])


def divide(a: Column, b: Column) -> Column:
    """Null for a missing, infinite or zero denominator."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def missing_fraction(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total / len(columns)


def failures(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
