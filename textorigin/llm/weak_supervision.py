"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

ROUNDS, SMOOTHING, TOLERANCE = 30, 1.0, 1e-6
#: a rule calls no larger share of the good texts bad. Without this bound a kind of bad text that only one rule sees may end among
#: the good, as an error of that rule.
MOST_WRONG = 0.002
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_capitals", "n_exclamations", "n_separators", "n_stops", "n_lines", "n_dup_lines", "n_repeat_words",
)

#: rule: (value, votes bad at or beyond, votes good within, direction). Between the two limits a rule abstains.
RULES = {
    "symbols": ("n_symbols / n_words", 0.10, 0.01, "high"),
    "repeated_lines": ("n_dup_lines / n_lines", 0.50, 0.05, "high"),
    "repeated_words": ("n_repeat_words / n_words", 0.40, 0.15, "high"),
    "short_words": ("word_chars / n_words", 2.5, 3.5, "low"),
    "long_words": ("word_chars / n_words", 14.0, 9.0, "high"),
    "capitals": ("n_capitals / word_chars", 0.40, 0.15, "high"),
    "exclamations": ("n_exclamations / n_words", 0.20, 0.02, "high"),
    "separators": ("n_separators / n_words", 0.20, 0.02, "high"),
    "sentences": ("n_stops / n_words", 0.005, 0.02, "low"),
}


def _repeats(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the windows' hashes in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def flagged(sorted_: Column) -> Column:
        n = F.size(sorted_)
        return F.filter(
            sorted_,
            lambda p, k: ((k > 0) & (F.get(sorted_, k - 1)["h"] == p["h"])) | ((k < n - 1) & (F.get(sorted_, k + 1)["h"] == p["h"])),
        )

    def covered(places: Column) -> Column:
        n = F.size(places)
        steps = F.transform(places, lambda p, k: F.when(k < n - 1, F.least(F.lit(3), F.get(places, k + 1) - p)).otherwise(3))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    # each array is bound to a name by a transform over one element, so that it is made once and not for every element
    places = F.transform(F.array(pairs), lambda s: F.sort_array(F.transform(flagged(s), lambda p: p["i"])))
    return F.transform(places, covered)[0]


def _own(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` under names that nothing here uses, beside the text as ``given_text``; and their names before."""
    plain = docs.toDF(*[f"own_{i}" for i in range(len(docs.columns))])
    names = {f"own_{i}": c for i, c in enumerate(docs.columns) if c in keep}
    return plain.select(*names, F.col(f"own_{docs.columns.index(text)}").alias("given_text")), names


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the other counts that the rules use.

    All are expressions over the row: no shuffle, and no array is searched once per element, so long texts cost in proportion.
    A null text has no words, no lines with words, and zero for each count. Columns named like a count are replaced, all others stay.
    """
    own, names = _own(docs, [c for c in docs.columns if c not in COUNTS], text)
    t = F.coalesce(F.col("given_text").cast("string"), F.lit(""))
    given = own.withColumn("_t", t).withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    n = F.size("_w")
    windows = F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    marks = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    found = given.withColumns({
        "_l": lines, "_h": windows, "n_words": n.cast("long"), "word_chars": F.char_length(F.regexp_replace("_t", SPACE, "")).cast("long"),
        "n_symbols": marks(r"[#*$%&|<>]"), "n_capitals": marks(r"\p{Lu}"), "n_exclamations": marks("!"), "n_separators": marks(r"\|"), "n_stops": marks(r"[.!?]"),
    })
    counted = found.withColumns({
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        # most texts repeat no window; the others are sorted
        "n_repeat_words": F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(_repeats(F.col("_h"))),
    })
    return counted.select(*[F.col(o).alias(n) for o, n in names.items()], *COUNTS)


def votes() -> dict[str, Column]:
    """1 for good, 0 for bad, null for an abstaining rule."""
    out = {}
    for name, (value, bad, good, side) in RULES.items():
        top, _, below = value.partition(" / ")
        v = F.col(top).cast("double") if not below else F.when(F.col(below) > 0, F.col(top) / F.col(below))
        is_bad, is_good = (v >= bad, v <= good) if side == "high" else (v < bad, v >= good)
        out[name] = F.when(is_bad, F.lit(0)).when(is_good, F.lit(1))
    return out


def _posterior(model: dict) -> Column:
    """Probability of good, given the votes and the rules' accuracies."""
    total = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, (good, bad) in model["rules"].items():
        for vote, k in ((1, 0), (0, 1), (None, 2)):
            is_it = F.col(name).isNull() if vote is None else F.col(name) == vote
            total = total + F.when(is_it, F.lit(math.log(good[k] / bad[k]))).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(voted: DataFrame) -> dict:
    """Prior of good, and for every rule the probabilities of its votes (good, bad, abstain) given good and given bad.

    ``voted`` has a column of votes per rule. Rows are counted by their pattern of votes first, at most 3 to the number of rules
    patterns whatever the number of rows; each round is one aggregation over that table.
    """
    names = list(RULES)
    patterns = cut_lineage(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("rows")))
    # a rule sees one kind of bad text and calls all others good, so one bad vote outweighs any number of good ones at the start
    bad = sum((F.coalesce((F.col(n) == 0).cast("int"), F.lit(0)) for n in names), F.lit(0))
    start = F.when(bad > 0, F.lit(0.1)).otherwise(F.lit(0.95))
    model, belief = None, start
    for _ in range(ROUNDS):
        p = patterns.withColumn("p", belief)
        sums = [F.sum("rows").alias("all"), F.sum(F.col("rows") * F.col("p")).alias("good")]
        for name in names:
            for vote, k in ((1, 0), (0, 1), (None, 2)):
                is_it = F.col(name).isNull() if vote is None else F.col(name) == vote
                own = F.when(is_it, F.col("rows")).otherwise(0)
                sums += [F.sum(own * F.col("p")).alias(f"{name}_{k}_good"), F.sum(own * (1 - F.col("p"))).alias(f"{name}_{k}_bad")]
        r = p.agg(*sums).first()
        rows, of_good = float(r["all"] or 0), float(r["good"] or 0)
        rules = {}
        for name in names:
            sides = []
            for side, weight in (("good", of_good), ("bad", rows - of_good)):
                sides.append([(float(r[f"{name}_{k}_{side}"] or 0) + SMOOTHING) / (weight + 3 * SMOOTHING) for k in range(3)])
            of_good_text = sides[0]
            if of_good_text[1] > MOST_WRONG:  # the others keep their proportion
                rest = (1 - MOST_WRONG) / (1 - of_good_text[1])
                sides[0] = [x * rest for x in of_good_text]
                sides[0][1] = MOST_WRONG
            rules[name] = tuple(map(tuple, sides))
        prior = min(max((of_good + SMOOTHING) / (rows + 2 * SMOOTHING), 1e-6), 1 - 1e-6)
        change = 1.0 if model is None else abs(prior - model["prior"])
        model = {"prior": prior, "rules": rules}
        belief = _posterior(model)
        if change < TOLERANCE:
            break
    return model


def supervise(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts of :func:`measures`, ``posterior`` (probability of good quality), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows; ``kept`` is false then, and
    otherwise true if the posterior is 0.5 or more. Rules whose value has no denominator abstain. A null or empty text fails;
    ties and repeated rows get equal results; an empty table stays empty. ``keep`` names the columns to return (all, the text
    included, unless given): the table between counting and judging is written with them. Columns named like the new ones are
    replaced, all others stay, those named like a rule too.
    """
    new = {*COUNTS, "posterior", "base_failed", "kept"}
    own, names = _own(docs, [c for c in (docs.columns if keep is None else keep) if c not in new], text)
    counted = cut_lineage(measures(own, "given_text").drop("given_text"))
    voted = counted.withColumns(votes())
    model = fit(voted.select(*RULES))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("posterior", _posterior(model)).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    return out.select(*[F.col(o).alias(n) for o, n in names.items()], *COUNTS, "posterior", "base_failed", "kept")


def op5(docs: DataFrame) -> DataFrame:
    out = supervise(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
