"""Small Column builders shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .fixed_values import SMALL, TINY


def ratio(a: Column, b: Column, eps: float = TINY) -> Column:
    """``a/(b+eps)``, 0 where the divisor is missing or smaller than ``eps``."""
    b = b.cast("double")
    return F.when(b.isNull() | (F.abs(b) < eps), F.lit(0.0)).otherwise(a.cast("double") / (b + F.lit(eps)))


def shifted_ratio(a: Column, b: Column, eps: float = SMALL) -> Column:
    """``a/(b+eps)`` with nulls passed on; null where the shifted divisor is exactly 0."""
    return F.try_divide(a.cast("double"), b.cast("double") + F.lit(eps))


def finite(c: Column) -> Column:
    """Null instead of NaN or an infinity."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def to_number(c: Column) -> Column:
    """Number or null, never an error; infinities become null."""
    return finite(c.try_cast("double"))


def strip_space(c: Column) -> Column:
    """Drop every kind of Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Collapse blanks, cap blank lines, strip. ``\\x0B`` is spelled out: Java's ``\\v`` would eat newlines."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.regexp_replace(c, r"[ \t\r\f\x0B]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip_space(c)


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_rule(c: Column, rules) -> Column:
    """Name of the first rule one of whose words occurs in ``c``; null if none does."""
    out = None
    for name, words in rules:
        hit = contains_any(c, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def md5_order(key: Column, seed: int) -> Column:
    """Seeded, reproducible shuffle order of a key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison between engines; the nudge keeps exact decimal halves from falling either way."""
    return F.round(c.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)


def nudge(digits: int) -> float:
    return round(0.00317 * 10.0**-digits, digits + 6)


def rounded_table(df: DataFrame, keep=("id",), digits=6) -> DataFrame:
    """All numeric columns but ``keep`` rounded; ``digits`` is a number or a function of the column name.

    Wide tables are stated as SQL text: one expression per column instead of several calls into the JVM.
    """
    d = digits if callable(digits) else lambda _: digits
    same = {c for c, t in df.dtypes if c in keep or t in ("string", "boolean")}
    return df.selectExpr(*[
        f"`{c}`" if c in same else f"round(cast(`{c}` as double) + {nudge(d(c))!r}D, {d(c)}) + 0D as `{c}`" for c in df.columns])
