import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textorigin.operators import surprise as L
from textorigin.session import shared_dir

RNG = np.random.default_rng(5)


def word(k):
    """Letters only, for a token is letters or digits."""
    return "".join(chr(97 + int(c)) for c in str(k))


def corpus(spark, texts, parts=5):
    rows = [(k, t, i % 3 > 0) for i, (k, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, text string, train boolean").repartition(parts)


def written_bytes(place):
    return sum(os.path.getsize(os.path.join(a, f)) for a, _, files in os.walk(place) for f in files)


def test_scoring_keeps_few_bytes_per_token(spark):
    """What stays on the shared disk after scoring: before, two rows of hashes for each n-gram."""
    texts = [(str(i), " ".join(map(word, RNG.zipf(1.3, 400) % 5000))) for i in range(300)]
    df = corpus(spark, texts)
    before = written_bytes(shared_dir(spark))
    found = L.GramModel.fit(df.filter("train")).losses(df)
    assert found.select(F.sum(F.size("ng4"))).first()[0] == 300 * 399
    assert written_bytes(shared_dir(spark)) - before < 12 * 300 * 400


def test_one_corpus_with_a_mark_scores_as_two(spark):
    """Slices of several tasks, words of one text only, texts without words or with one, and the losses of the training rows alone."""
    texts = [(str(i), " ".join(["once", f"only{word(i)}", *map(word, RNG.integers(0, 9, 30))])) for i in range(40)]
    df = corpus(spark, [*texts, ("one", "b"), ("none", "   "), ("long", "b c " * 700)])
    two = {r["id"]: r for r in L.GramModel.fit(df.filter("train")).losses(df).collect()}
    packed = L.packed_within(df, "train")
    one = {r["id"]: r for r in packed.unpacked().collect()}
    assert one == two and len(one) == 42 and one["one"]["ng2"] == [] and len(one["long"]["ng1"]) == 1399
    train = {r["id"] for r in df.filter("train").collect()}
    learned = {r["id"]: r for r in packed.unpacked(learned=True).collect()}
    assert learned == {k: r for k, r in one.items() if k in train}
    words = Counter(w for r in df.filter("train").collect() for w in r["text"].split())
    assert packed.vocabulary == len(words) and packed.total == sum(words.values())


def test_repeated_and_missing_keys_give_one_row(spark):
    """A key that repeats is learned from as often as it comes and scored once, in its longest text; short texts stay as they are."""
    texts = [("a", "x y z x y"), ("a", "x y z x y"), ("b", "x y"), ("b", "z z z x y"), (None, "x z"), (None, "x z"), ("c", "x"), ("c", "x")]
    got = L.GramModel.fit(corpus(spark, texts)).losses(corpus(spark, texts))
    assert Counter((r["id"], len(r["ng1"])) for r in got.collect()) == Counter({("a", 4): 1, ("b", 4): 1, (None, 1): 1, ("c", 0): 2})
