"""Document features as Column expressions over one text column.

Everything stays inside the row: a corpus of any size is turned into features by one narrow scan,
and the text itself is never shuffled.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import arrays as A
from .columns import clean_text, ratio, strip_space
from .fixed_values import (
    ADVERBS, CAPITALISED, COMMAS, EXCLAMATIONS, NUMBERS, NUMERALS, PARAGRAPH_BREAK, PERIODS, PRONOUNS, PUNCTUATION,
    QUESTIONS, SENTENCE_BREAK, TOKEN_PATTERN, TextRules,
)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))


def _pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip_space), lambda p: p != "")


def sentences(c: Column) -> Column:
    return _pieces(c, SENTENCE_BREAK)


def paragraphs(c: Column) -> Column:
    return _pieces(c, PARAGRAPH_BREAK)


def hits(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def occurrences(c: Column, phrases) -> Column:
    """Non-overlapping occurrences of each phrase, summed."""
    out = F.lit(0)
    for p in phrases:
        out = out + ((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("int")
    return out.cast("double")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def packed_ratios(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """(zlib, gzip) bytes over raw bytes for every text of an array, 0 for an empty text."""
    def one(text):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if not raw:
            return [0.0, 0.0]
        return [len(zlib.compress(raw)) / len(raw), len(gzip.compress(raw)) / len(raw)]

    for batch in batches:
        yield batch.map(lambda texts: [one(t) for t in texts])


def redundancy(c: Column, size: int = 4) -> Column:
    """Share of repeated character shingles: a JVM-side stand-in for compressibility."""
    def share(chars):
        n = F.size(chars) - (size - 1)
        at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        shingles = F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)]))
        return F.when(n < 1, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(shingles)) / n.cast("double"))

    return A.let(F.filter(F.split(c, ""), lambda ch: ch != ""), share)


def add_layers(df: DataFrame, text: str = "text") -> DataFrame:
    """Tokens, sentences and paragraphs once, shared by all feature families."""
    c = F.col(text)
    return (
        df.withColumn("_tokens", tokens(c))
        .withColumns({
            "_words": F.transform("_tokens", F.lower),
            "_sentence_sizes": F.transform(sentences(c), lambda s: F.size(tokens(s))),
            "_paragraph_sizes": F.transform(paragraphs(c), lambda s: F.size(tokens(s))),
        })
    )


def drop_layers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def burstiness(df: DataFrame, text: str = "text", compression: bool = True) -> DataFrame:
    """Length, punctuation and repetition columns (prefix ``burst_``) on top of :func:`add_layers`."""
    c = F.col(text)
    zero_if_none = lambda a: F.when(F.size(a) == 0, F.array(F.lit(0))).otherwise(a)
    df = df.withColumns({
        "_sent": A.mean_std(zero_if_none(F.col("_sentence_sizes"))),
        "_para": A.mean_std(zero_if_none(F.col("_paragraph_sizes"))),
        "_word_sizes": F.sort_array(A.run_sizes(F.sort_array("_words")), asc=False),
        "_chars": F.length(c),
        "_solid": F.replace(c, F.lit(" "), F.lit("")),
        "_marks": F.regexp_replace(c, PUNCTUATION.replace("[", "[^"), ""),
    })
    if compression:
        df = df.withColumn("_packed", packed_ratios(F.array(c)))
    chars, words = F.col("_chars"), F.size("_words")
    solid = F.col("_solid")
    distinct_solid = F.size(F.array_distinct(F.filter(F.split(solid, ""), lambda ch: ch != "")))
    marks = F.col("_marks")
    out = {
        "text_length": chars.cast("double"),
        "char_count": chars.cast("double"),
        "word_count": words.cast("double"),
        "sentence_count": F.size("_sentence_sizes").cast("double"),
        "avg_sentence_length": F.col("_sent.mean"),
        "std_sentence_length": F.col("_sent.std"),
        "sentence_length_cv": ratio(F.col("_sent.std"), F.col("_sent.mean")),
        "max_sentence_length": F.coalesce(F.array_max("_sentence_sizes"), F.lit(0)).cast("double"),
        "min_sentence_length": F.coalesce(F.array_min("_sentence_sizes"), F.lit(0)).cast("double"),
        "punctuation_ratio": ratio(F.length(marks), chars),
        "comma_ratio": ratio(hits(marks, COMMAS), chars),
        "period_ratio": ratio(hits(marks, PERIODS), chars),
        "question_ratio": ratio(hits(marks, QUESTIONS), chars),
        "exclamation_ratio": ratio(hits(marks, EXCLAMATIONS), chars),
        "paragraph_count": F.size("_paragraph_sizes").cast("double"),
        "avg_paragraph_length": F.col("_para.mean"),
        "std_paragraph_length": F.col("_para.std"),
        "type_token_ratio": ratio(F.size("_word_sizes"), words),
        "repeated_char_ratio": ratio(F.length(solid) - distinct_solid, F.greatest(chars, F.lit(1))),
        "repeated_word_ratio": ratio(words - F.size("_word_sizes"), F.greatest(words, F.lit(1))),
        "zipf_deviation_score": A.log_rank_deviation(F.col("_word_sizes")),
    }
    if compression:
        out["compression_ratio_zlib"] = F.get(F.get("_packed", F.lit(0)), F.lit(0))
        out["compression_ratio_gzip"] = F.get(F.get("_packed", F.lit(0)), F.lit(1))
    return df.withColumns({f"burst_{k}": v for k, v in out.items()})


def _grams(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    gram = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(at, gram))


def structure(df: DataFrame, text: str = "text", rules: TextRules = TextRules()) -> DataFrame:
    """Template, n-gram, word-class and density columns (prefix ``struct_``) on top of :func:`add_layers`."""
    c = F.col(text)
    df = df.withColumns({
        "_lower": F.lower(c),
        "_gram_sizes2": A.run_sizes(F.sort_array(_grams(F.col("_words"), 2))),
        "_gram_sizes3": A.run_sizes(F.sort_array(_grams(F.col("_words"), 3))),
        "_template": occurrences(c, rules.template_phrases) + hits(c, rules.template_pattern),
        "_transition": occurrences(c, rules.transition_phrases),
    })
    n = F.size("_words")
    share = lambda v: F.when(n > 0, ratio(v, n)).otherwise(F.lit(0.0))
    out = {
        "template_phrase_count": F.col("_template"),
        "template_phrase_ratio": ratio(F.col("_template"), n),
        "transition_phrase_count": F.col("_transition"),
        "transition_phrase_ratio": ratio(F.col("_transition"), n),
    }
    for k, name in ((2, "bigram"), (3, "trigram")):
        sizes = F.col(f"_gram_sizes{k}")
        grams = F.greatest(n - (k - 1), F.lit(0))
        out[f"repeated_{name}_ratio"] = ratio(A.total(F.filter(sizes, lambda s: s > 1)), grams)
        out[f"top_{name}_frequency"] = F.coalesce(F.array_max(sizes), F.lit(0)).cast("double")
        out[f"unique_{name}_ratio"] = ratio(F.size(sizes), grams)
    zero = F.lit(0.0)
    out.update({
        "noun_ratio": zero,
        "verb_ratio": zero,
        "adjective_ratio": zero,
        "adverb_ratio": share(hits(F.col("_lower"), ADVERBS)),
        "numeral_ratio": share(hits(c, NUMERALS)),
        "pronoun_ratio": share(hits(F.col("_lower"), PRONOUNS)),
        "function_word_ratio": zero,
        "number_density": ratio(hits(c, NUMBERS), n),
        "english_capitalized_entity_density": ratio(hits(c, CAPITALISED), n),
        "domain_term_density": ratio(occurrences(F.col("_lower"), [t.lower() for t in rules.domain_terms]), n),
    })
    df = df.withColumns({f"struct_{k}": v for k, v in out.items()})
    return df.withColumn(
        "struct_content_word_ratio",
        F.col("struct_noun_ratio") + F.col("struct_verb_ratio") + F.col("struct_adjective_ratio") + F.col("struct_adverb_ratio"),
    )


def tidy_punctuation(c: Column) -> Column:
    c = F.regexp_replace(c, "[，,]{2,}", "，")
    c = F.regexp_replace(c, "[。.!！?？]{2,}", "。")
    return strip_space(c)


def rewritten(c: Column, rules: TextRules = TextRules()) -> Column:
    """Rule-based rewritings of a text: distinct, not empty, different from the text, in rule order."""
    swapped = c
    for old, new in rules.phrase_replacements:
        swapped = F.replace(swapped, F.lit(old), F.lit(new))
    thinned = c
    for word in rules.dropped_adverbs:
        thinned = F.replace(thinned, F.lit(word), F.lit(""))
    parts = sentences(c)
    shortened = A.let(
        parts,
        lambda s: F.when(
            F.size(s) > 1,
            F.concat_ws("", F.slice(s, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(s) * F.lit(0.8)).cast("int")))),
        ),
    )
    clause = "[^，,；;]*"
    reordered = F.when(
        F.regexp_count(c, F.lit("[，,；;]")) >= 2,
        tidy_punctuation(F.regexp_replace(c, f"(?s)^({clause})([，,；;])({clause})([，,；;])", "$3$2$1$4")),
    )
    all_of_them = F.array(tidy_punctuation(swapped), tidy_punctuation(thinned), shortened, reordered, tidy_punctuation(c))
    return F.array_distinct(F.filter(all_of_them, lambda v: v.isNotNull() & (v != "") & (v != c)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(ratio(F.size(F.array_intersect(a, b)), union))


def stability(df: DataFrame, text: str = "text", rules: TextRules = TextRules(), compression: bool = True) -> DataFrame:
    """How much the rewritings differ from the text (prefix ``pert_``) on top of :func:`add_layers`."""
    c = F.col(text)
    df = df.withColumn("_variants", rewritten(c, rules))
    df = df.withColumn("_token_set", F.array_distinct("_tokens"))
    base = F.greatest(F.length(c), F.lit(1))
    df = df.withColumns({
        "_len_delta": A.mean_std(F.transform("_variants", lambda v: (F.length(v) - base) / base.cast("double"))),
        "_overlap": A.mean_std(F.transform("_variants", lambda v: jaccard(F.col("_token_set"), tokens(v)))),
    })
    none = lambda v: F.coalesce(v, F.lit(0.0))
    out = {
        "perturbation_count": F.size("_variants").cast("double"),
        "avg_length_delta": none(F.col("_len_delta.mean")),
        "std_length_delta": none(F.col("_len_delta.std")),
        "avg_jaccard_similarity": none(F.col("_overlap.mean")),
        "std_jaccard_similarity": none(F.col("_overlap.std")),
    }
    if compression:
        df = df.withColumn("_variant_packed", packed_ratios(F.concat(F.array(c), F.col("_variants"))))
        rest = F.slice("_variant_packed", F.lit(2), F.size("_variants"))
        own = F.get(F.get("_variant_packed", F.lit(0)), F.lit(0))
        out["avg_compression_ratio_delta"] = none(
            A.let(own, lambda o: A.mean(F.transform(rest, lambda p: F.get(p, F.lit(0)) - o)))
        )
    return df.withColumns({f"pert_{k}": v for k, v in out.items()})


def cleaned(df: DataFrame, text: str = "text") -> DataFrame:
    """Clean the text column and drop rows left empty."""
    return df.withColumn(text, clean_text(F.col(text))).filter(F.length(text) > 0)
