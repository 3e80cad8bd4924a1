"""Statistics inside one array value. All of them are narrow: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Without the binding a value named inside a lambda would be worked out again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean(a: Column) -> Column:
    """Mean, null for an empty array."""
    return let(a, lambda v: F.try_divide(total(v), F.size(v).cast("double")))


def moments(a: Column) -> Column:
    """Struct of n, mean, m2, m3, m4 (population central moments) in two passes over the array."""
    def second_pass(v, m):
        zero = F.struct(F.lit(0.0).alias("s2"), F.lit(0.0).alias("s3"), F.lit(0.0).alias("s4"))

        def step(acc, x):
            d = x.cast("double") - m
            return F.struct(
                (acc["s2"] + d * d).alias("s2"), (acc["s3"] + d * d * d).alias("s3"), (acc["s4"] + d * d * d * d).alias("s4")
            )

        n = F.size(v).cast("double")
        return F.aggregate(
            v,
            zero,
            step,
            lambda acc: F.struct(
                F.size(v).alias("n"),
                m.alias("mean"),
                F.try_divide(acc["s2"], n).alias("m2"),
                F.try_divide(acc["s3"], n).alias("m3"),
                F.try_divide(acc["s4"], n).alias("m4"),
            ),
        )

    return let(a, lambda v: let(mean(v), lambda m: second_pass(v, m)))


def mean_std(a: Column) -> Column:
    """Struct of mean and population std, null for an empty array."""
    def second_pass(v, m):
        sq = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - m) * (x.cast("double") - m))
        return F.struct(m.alias("mean"), F.sqrt(F.try_divide(sq, F.size(v).cast("double"))).alias("std"))

    return let(a, lambda v: let(mean(v), lambda m: second_pass(v, m)))


def run_sizes(sorted_array: Column) -> Column:
    """How often each distinct value occurs, in the order of a sorted array."""
    def sizes(v):
        n = F.size(v)
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: (i < n) & ((i == 0) | (F.get(v, i) != F.get(v, i - 1))),
        )
        return let(
            starts,
            lambda s: F.transform(s, lambda at, k: F.coalesce(F.get(s, k + 1), n) - at),
        )

    return let(sorted_array, sizes)


def log_rank_deviation(sizes_desc: Column) -> Column:
    """Mean absolute residual of the least-squares line through (log rank, log size); 0 below 3 sizes."""
    def fit(pts):
        n = F.size(pts).cast("double")
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xx", "xy")])
        return F.aggregate(
            pts,
            zero,
            lambda s, p: F.struct(
                (s["x"] + p["x"]).alias("x"),
                (s["y"] + p["y"]).alias("y"),
                (s["xx"] + p["x"] * p["x"]).alias("xx"),
                (s["xy"] + p["x"] * p["y"]).alias("xy"),
            ),
            lambda s: F.struct(
                F.try_divide(s["xy"] - s["x"] * s["y"] / n, s["xx"] - s["x"] * s["x"] / n).alias("slope"),
                (s["x"] / n).alias("mx"),
                (s["y"] / n).alias("my"),
            ),
        )

    def deviation(pts, line):
        # the fitted line goes through the mean point
        off = lambda p: F.abs((p["y"] - line["my"]) - line["slope"] * (p["x"] - line["mx"]))
        return F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + off(p)) / F.size(pts)

    points = F.transform(
        sizes_desc, lambda f, i: F.struct(F.log((i + 1).cast("double")).alias("x"), F.log(f.cast("double")).alias("y"))
    )
    return F.when(F.size(sizes_desc) < 3, F.lit(0.0)).otherwise(
        let(points, lambda pts: let(fit(pts), lambda line: deviation(pts, line)))
    )


def tied_percent_rank(a: Column) -> Column:
    """Ascending rank of every element over the array length, ties averaged, in the array's own order."""
    def ranks(tagged):
        values = F.transform(tagged, lambda s: s["v"])
        n = F.size(tagged)

        def spread(v):
            firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
            return let(
                firsts,
                lambda s: F.flatten(
                    F.transform(
                        s,
                        lambda at, k: let(
                            F.coalesce(F.get(s, k + 1), n) - at,
                            lambda size: F.array_repeat((at * 2 + size + 1) / F.lit(2.0) / n, size),
                        ),
                    )
                ),
            )

        return F.transform(
            F.sort_array(F.zip_with(tagged, let(values, spread), lambda t, r: F.struct(t["i"].alias("i"), r.alias("r")))),
            lambda s: s["r"],
        )

    tagged = F.sort_array(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
    return F.when(F.size(a) == 0, F.array().cast("array<double>")).otherwise(let(tagged, ranks))


def edge_mean(a: Column, share: float, largest: bool) -> Column:
    """Mean of the largest (or smallest) ``share`` of the elements, at least one of them."""
    k = F.greatest(F.lit(1), F.ceil(F.size(a) * F.lit(share)).cast("int"))
    return mean(F.slice(F.sort_array(a, asc=not largest), F.lit(1), k))


def entropy(counts: Column) -> Column:
    """Base-2 entropy of an array of counts, null when they sum to 0."""
    return let(
        total(counts),
        lambda t: F.when(
            t > 0,
            F.aggregate(
                F.filter(counts, lambda c: c > 0),
                F.lit(0.0),
                lambda acc, c: acc - (c / t) * F.log2(c / t),
            ),
        ),
    )
