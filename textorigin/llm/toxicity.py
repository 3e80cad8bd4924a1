"""Toxicity by a chain of linear classifiers: each category sees the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: labelled documents that the fit uses (smallest md5 of the id), folds for the out-of-fold probabilities
FIT_DOCUMENTS, FOLDS = 20_000, 3
#: a word is a feature if so many of these documents have it, and it is so many standard deviations more frequent among the
#: positives of a category, or less, than chance has it; the strongest VOCABULARY words count
LEAST_DOCUMENTS, LEAST_DEVIATIONS, VOCABULARY = 5, 5.5, 5_000
#: lengths of the beginnings of words that are features beside whole words
STEMS = (4, 5, 6, 7)
WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Chain:
    """Categories in order, with a model each (None where the labels are of one kind) and the share of positives; and the words
    that are features."""

    categories: tuple[str, ...]
    models: tuple[LogisticRegressionModel | None, ...]
    shares: tuple[float, ...]
    words: tuple[str, ...] = ()


def _begins(words: Column, k: int) -> Column:
    return F.transform(F.filter(words, lambda x: F.char_length(x) > k), lambda x: F.concat(F.substring(x, 1, k), F.lit("*")))


def _words(text: Column) -> Column:
    """Distinct lower-cased words of the whole text, and the beginnings of longer words, as inflected and compound words share these."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(f"({WORD})"), F.lit(1)))
    # bound to a name by a transform over one element, so that the words are looked for once
    return F.array_distinct(F.transform(F.array(words), lambda w: F.concat(w, *[_begins(w, k) for k in STEMS]))[0])


def _inputs(df: DataFrame, earlier: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=["_found", *[f"_p_{c}" for c in earlier]], outputCol="_x").transform(df) if earlier else df.withColumn("_x", F.col("_found"))


def _found(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """Which of the feature words a text has. Without any, a vector of one word that no text has."""
    model = CountVectorizerModel.from_vocabulary(list(words) or ["\u0000"], "_words", "_found")
    return model.setBinary(True).transform(df).drop("_words")


def _vocabulary(df: DataFrame, categories: Sequence[str]) -> tuple[str, ...]:
    """The words whose documents differ most from chance in a category."""
    totals = df.select(*[F.avg(c).alias(c) for c in categories]).first()
    counted = df.select(F.explode("_words").alias("w"), *categories).groupBy("w").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories])
    off = []
    for c in categories:
        share = float(totals[c] or 0.0)
        if 0 < share < 1:
            off.append(F.abs(F.col(c) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share)))
    if not off:
        return ()
    most = F.greatest(*off) if len(off) > 1 else off[0]
    best = counted.filter(F.col("n") >= LEAST_DOCUMENTS).withColumn("z", most).filter(F.col("z") >= LEAST_DEVIATIONS)
    return tuple(sorted(r["w"] for r in best.orderBy(F.desc("z"), "w").limit(VOCABULARY).collect()))


def _regression(label: str) -> LogisticRegression:
    return LogisticRegression(featuresCol="_x", labelCol=label, predictionCol="_y", probabilityCol="_q", rawPredictionCol="_r", maxIter=30, regParam=1e-4, standardization=False)


def _probability(model: LogisticRegressionModel | None, share: float, df: DataFrame, name: str) -> DataFrame:
    if model is None:
        return df.withColumn(name, F.lit(share))
    return model.transform(df).withColumn(name, vector_to_array("_q")[1]).drop("_y", "_q", "_r")


def _fit(df: DataFrame, label: str, share: float) -> LogisticRegressionModel | None:
    kinds = df.select(F.min(label), F.max(label)).first()
    return None if kinds[0] is None or kinds[0] == kinds[1] else _regression(label).fit(df)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], doc_id: str = "doc_id", text: str = "text") -> Chain:
    """A chain over the label columns ``categories``, from FIT_DOCUMENTS labelled documents.

    Later models learn from out-of-fold probabilities of the earlier categories: the documents are cut into FOLDS by a hash of their id,
    and each fold gets its probabilities from a model fitted to the others. Rows with a null id, or a label that is null or not 0 or
    1 in one of the categories, are left out; of repeated labels of an id the largest counts, of repeated documents the smallest text.
    """
    own = labels.select(F.col(doc_id).cast("long").alias("_id"), *[F.col(c).cast("double").alias(c) for c in categories])
    for c in categories:
        own = own.filter(F.col(c).isin(0.0, 1.0))
    own = own.filter("_id is not null").groupBy("_id").agg(*[F.max(c).alias(c) for c in categories])
    there = docs.select(F.col(doc_id).cast("long").alias("_id")).distinct()
    chosen = own.join(there, "_id", "left_semi").orderBy(F.md5(F.col("_id").cast("string"))).limit(FIT_DOCUMENTS)
    # bounded: FIT_DOCUMENTS rows of labels
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_t")).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy("_id", *categories).agg(F.min("_t").alias("_t"))
    given = texts.select("_id", *categories, _words(F.col("_t")).alias("_words"), F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).alias("_fold"))
    given = given.persist(StorageLevel.MEMORY_AND_DISK)
    n = given.count()
    vocabulary = _vocabulary(given, categories)
    # a bounded table of few columns: few tasks, as each step of a fit is a job
    data = _found(given, vocabulary).coalesce(4).persist(StorageLevel.MEMORY_AND_DISK)
    models, shares, scored, held = [], [], data, [given, data]
    for k, c in enumerate(categories):
        rows = _inputs(scored, categories[:k])
        share = float(rows.select(F.sum(c)).first()[0] or 0.0) / n if n else 0.0
        models.append(_fit(rows, c, share))
        shares.append(share)
        if k + 1 < len(categories):
            parts = []
            for fold in range(FOLDS):
                model = _fit(rows.filter(F.col("_fold") != fold), c, share)
                parts.append(_probability(model, share, rows.filter(F.col("_fold") == fold), f"_p_{c}").drop("_x"))
            scored = parts[0]
            for p in parts[1:]:
                scored = scored.unionByName(p)
            scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(scored)
    for table in held:
        table.unpersist()
    return Chain(tuple(categories), tuple(models), tuple(shares), vocabulary)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` for each category of the chain, in order, in one narrow pass over whole texts.

    A null or empty text has no words; a category whose labels were all alike gives its share to every row; repeated rows get equal
    probabilities; an empty table stays empty; columns named like the new ones are replaced.
    """
    names = [c for c in docs.columns if c not in {f"p_{k}" for k in chain.categories}]
    plain = [f"c{i}" for i in range(len(names))]
    given = docs.select(*names).toDF(*plain)
    df = _found(given.withColumn("_words", _words(F.col(plain[names.index(text)]))), chain.words)
    for k, c in enumerate(chain.categories):
        df = _probability(chain.models[k], chain.shares[k], _inputs(df, chain.categories[:k]), f"_p_{c}").drop("_x")
    return df.select(*[F.col(p).alias(n) for p, n in zip(plain, names)], *[F.col(f"_p_{c}").alias(f"p_{c}") for c in chain.categories])


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Probabilities of junk and of toxicity, in this order, and whether a document is toxic."""
    own = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    docs = docs.select("doc_id", "text")
    out = score(docs, fit(docs, own, ("junk", "toxic")))
    return out.select("doc_id", "p_junk", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))
