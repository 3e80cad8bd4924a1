"""Categorical clean-up: domains, generators, attacks, splits and labels as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import contains_any, first_rule
from .fixed_values import (
    ATTACK_RULES, DOMAIN_PATH_RULES, DOMAIN_RULES, GENERATOR_PATH_RULES, GENERATOR_RULES, HUMAN_PATH_WORDS,
    MACHINE_PATH_WORDS, SPLIT_PATH_RULES, SPLIT_RULES,
)


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", ""))


def _missing(p: Column) -> Column:
    return (p == "") | (p == "nan")


def _slug(p: Column, keep: str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(p, f"[^{keep}]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit("unknown")).otherwise(slug)


def domain(c: Column) -> Column:
    p = _plain(c)
    return F.when(_missing(p), F.lit("unknown")).otherwise(F.coalesce(first_rule(p, DOMAIN_RULES), _slug(p, "a-z0-9_")))


def domain_from_path(path: Column) -> Column:
    return F.coalesce(first_rule(F.lower(path), DOMAIN_PATH_RULES), F.lit("unknown"))


def generator(c: Column, label: Column) -> Column:
    p = _plain(c)
    named = F.coalesce(first_rule(p, GENERATOR_RULES), _slug(p, "a-z0-9._-"))
    return F.when(label == 0, F.lit("human")).when(_missing(p), F.lit("unknown")).otherwise(named)


def generator_from_path(path: Column, label: Column) -> Column:
    return F.when(label == 0, F.lit("human")).otherwise(F.coalesce(first_rule(F.lower(path), GENERATOR_PATH_RULES), F.lit("unknown")))


def attack(c: Column) -> Column:
    p = _plain(c)
    return F.when(_missing(p), F.lit("none")).otherwise(F.coalesce(first_rule(p, ATTACK_RULES), F.lit("unknown")))


def split(c: Column) -> Column:
    p = _plain(c)
    out = None
    for name, words in SPLIT_RULES:
        hit = p.isin(name, *words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def split_from_path(path: Column) -> Column:
    return first_rule(F.lower(path), SPLIT_PATH_RULES)


def _binary(c: Column) -> Column:
    whole = F.floor(F.abs(c.try_cast("double"))).cast("int")
    return F.when(whole.isin(0, 1) & (c.try_cast("double") > -1.0), whole)


def label(value: Column, generator_value: Column, path: Column) -> Column:
    """Label from the label value, else the generator, else words of the path; null if nothing tells.

    Path words must stand alone (between non-letters), so that "train" does not count as "ai".
    """
    p = _plain(value)
    stated = (
        F.when(p.isin("0", "human", "real"), F.lit(0))
        .when(p.isin("1", "ai", "generated", "machine", "llm"), F.lit(1))
        .otherwise(_binary(value))
    )
    g = _plain(generator_value)
    by_generator = F.when(g.isin("human", "reference", "real"), F.lit(0)).when(~_missing(g), F.lit(1))
    alone = lambda words: F.lower(path).rlike("(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)")
    by_path = F.when(alone(HUMAN_PATH_WORDS), F.lit(0)).when(alone(MACHINE_PATH_WORDS), F.lit(1))
    unreadable = value.isNotNull() & value.try_cast("double").isNull()
    return F.when(value.isNotNull() & ~(unreadable & stated.isNull()), stated).otherwise(F.coalesce(by_generator, by_path))


def external_label(value: Column) -> Column:
    p = _plain(value)
    return (
        F.when(p.isin("0", "human", "false", "real"), F.lit(0))
        .when(p.isin("1", "ai", "machine", "generated", "true"), F.lit(1))
        .otherwise(_binary(value))
    )


def risk_level(prob: Column) -> Column:
    return F.when(prob < 0.35, F.lit("Low")).when(prob < 0.70, F.lit("Medium")).otherwise(F.lit("High"))


def error_type(label_: Column, prediction: Column) -> Column:
    return (
        F.when((label_ == 1) & (prediction == 1), F.lit("TP"))
        .when((label_ == 0) & (prediction == 1), F.lit("FP"))
        .when((label_ == 0) & (prediction == 0), F.lit("TN"))
        .when((label_ == 1) & (prediction == 0), F.lit("FN"))
        .otherwise(F.lit("NA"))
    )
