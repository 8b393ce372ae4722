"""Exact binomial intervals and McNemar's test, as column expressions over tables of counts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from navspark.operators.metrics import precision_at_prevalence

# Assumed prevalences, and the number of discordant pairs from which the corrected chi-square is used.
PREVALENCES = (0.5, 0.1, 0.01, 0.001, 0.0001)
EXACT_BELOW = 25

_ROUNDS = 80
_RAISED = 15
_TINY = 1e-300
# Stirling's series for log gamma, coefficients of 1 / x, 1 / x**3 and so on; from 15 on it is good to the last digit.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def log_gamma(x: Column) -> Column:
    """Log gamma of a positive number: Stirling's series, after raising small arguments by the recurrence."""
    def series(up: Column) -> Column:
        total = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi)
        for i, c in enumerate(_STIRLING):
            total = total + c / F.pow(up, F.lit(2.0 * i + 1))
        return total

    raised = x
    for i in range(1, _RAISED):
        raised = raised * (x + i)
    return F.when(x < _RAISED, _let(x + _RAISED, series) - F.log(raised)).otherwise(_let(x, series))


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function by Lentz's recurrence, two terms a step, until a step changes no digit.

    About the root of the larger parameter is what it takes to settle.
    """
    nonzero = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)

    def state(c: Column, d: Column, f: Column, change: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), f.alias("f"), change.alias("change"))

    def term(s: Column, value: Column) -> Column:
        moved = F.struct((1.0 / nonzero(1.0 + value * s["d"])).alias("d"), nonzero(1.0 + value / s["c"]).alias("c"))
        return _let(moved, lambda m: state(m["c"], m["d"], s["f"] * m["c"] * m["d"], F.abs(m["c"] * m["d"] - 1.0)))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(s["change"] < 1e-16, s).otherwise(_let(term(s, even), lambda t: term(t, odd)))

    start = 1.0 / nonzero(1.0 - (a + b) * x / (a + 1.0))
    terms = (F.lit(100.0) + 6.0 * F.sqrt(F.greatest(a, b))).cast("int")
    counted = F.transform(F.sequence(F.lit(1), terms), lambda m: m.cast("double"))
    return F.aggregate(counted, _let(start, lambda d: state(F.lit(1.0), d, d, F.lit(1.0))), step, lambda s: s["f"])


def beta_quantile(p: Column, a: Column, b: Column) -> Column:
    """Quantile of a beta distribution with parameters of at least 1.

    Newton steps on the log odds, where the distribution is smooth and its ends keep their digits; a step that would
    leave the bracket, which every evaluation narrows, goes to its middle instead.
    """
    def searched(q: Column) -> Column:
        a, b, norm = q["a"], q["b"], q["norm"]

        def step(s: Column, _: Column) -> Column:
            def moved(e: Column) -> Column:
                low, high = F.when(e["share"] < q["p"], s["u"]).otherwise(s["low"]), F.when(e["share"] < q["p"], s["high"]).otherwise(s["u"])
                newton = s["u"] - (e["share"] - q["p"]) / F.greatest(e["density"], F.lit(_TINY))
                following = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
                return F.struct(low.alias("low"), high.alias("high"), following.alias("u"), F.abs(following - s["u"]).alias("change"))

            def evaluated(x: Column) -> Column:
                # x and 1 - x from the log odds, each to full precision.
                front = F.exp(norm - a * F.log1p(F.exp(-s["u"])) - b * F.log1p(F.exp(s["u"])))
                share = F.when(x["x"] < (a + 1) / (a + b + 2), front * _fraction(x["x"], a, b) / a).otherwise(1.0 - front * _fraction(x["rest"], b, a) / b)
                return F.struct(share.alias("share"), front.alias("density"))

            both = F.struct((1.0 / (1.0 + F.exp(-s["u"]))).alias("x"), (1.0 / (1.0 + F.exp(s["u"]))).alias("rest"))
            return F.when(s["change"] < 1e-15, s).otherwise(_let(_let(both, evaluated), moved))

        middle, width = F.log(a / b), 40.0 * F.sqrt(1.0 / a + 1.0 / b) + 60.0 / F.least(a, b)
        start = F.struct((middle - width).alias("low"), (middle + width).alias("high"), middle.alias("u"), F.lit(1.0).alias("change"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, step, lambda s: 1.0 / (1.0 + F.exp(-s["u"])))

    norm = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    return _let(F.struct(p.alias("p"), a.alias("a"), b.alias("b"), norm.alias("norm")), searched)


def exact_interval(hits: Column, trials: Column, alpha: float = 0.05) -> Column:
    """Struct (low, high): two-sided Clopper-Pearson interval of each proportion; both null without trials."""
    k, n = hits.cast("double"), trials.cast("double")
    low = F.when(k > 0, beta_quantile(F.lit(alpha / 2), k, n - k + 1)).otherwise(0.0)
    high = F.when(k < n, beta_quantile(F.lit(1 - alpha / 2), k + 1, n - k)).otherwise(1.0)
    return F.struct(F.when(n > 0, low).alias("low"), F.when(n > 0, high).alias("high"))


def base_rate_analysis(counts: DataFrame, keys: list[str], prevalences=PREVALENCES, alpha: float = 0.05) -> DataFrame:
    """Precision at assumed prevalences with conservative corners of the exact intervals.

    ``counts`` holds ``keys`` and ``tn, fp, fn, tp``. The pessimistic corner pairs the
    lowest TPR with the highest FPR, the optimistic one the reverse.
    """
    rates = counts.select(
        *keys,
        *[
            part
            for name, hits, others in (("tpr", "tp", "fn"), ("fpr", "fp", "tn"))
            for trials in [F.col(hits) + F.col(others)]
            for part in (F.when(trials > 0, F.col(hits) / trials).alias(name), exact_interval(F.col(hits), trials, alpha).alias(f"{name}_ci"))
        ],
    )
    # A generator between the intervals and their uses keeps them from being computed once for each use.
    levels = F.explode(F.array(*[F.lit(float(p)) for p in prevalences])).alias("prevalence")
    ends = {f"{name}_ci_{short}": F.col(f"{name}_ci.{end}") for name in ("tpr", "fpr") for short, end in (("lo", "low"), ("hi", "high"))}
    table = rates.select("*", levels).withColumns(ends)
    corners = {"precision_at_prevalence": ("tpr", "fpr"), "precision_lo": ("tpr_ci_lo", "fpr_ci_hi"), "precision_hi": ("tpr_ci_hi", "fpr_ci_lo")}
    precision = [precision_at_prevalence(F.col(t), F.col(f), F.col("prevalence")).alias(name) for name, (t, f) in corners.items()]
    return table.select(*keys, "prevalence", "tpr", "fpr", *ends, *precision)


def error_tail(z: Column) -> Column:
    """Complementary error function of a number from 0 on: a series of positive terms below 2, a continued fraction beyond."""
    def series(v: Column) -> Column:
        def add(s: Column, k: Column) -> Column:
            following = s["t"] * 2.0 * v * v / (2.0 * k + 1.0)
            return F.struct(following.alias("t"), (s["sum"] + following).alias("sum"))

        start = F.struct(v.alias("t"), v.alias("sum"))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda s: s["sum"])
        return 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-v * v) * total

    def fraction(v: Column) -> Column:
        whole = F.aggregate(F.sequence(F.lit(150), F.lit(1), F.lit(-1)), v, lambda f, k: v + k / (2.0 * f))
        return F.exp(-v * v) / math.sqrt(math.pi) / whole

    return _let(z, lambda v: F.when(v < 2, series(v)).otherwise(fraction(v)))


def mcnemar_p(only_first: Column, only_second: Column) -> Column:
    """Two-sided p-value of a pair of discordant counts: binomial when they are few, corrected chi-square otherwise."""
    first, second = only_first.cast("long"), only_second.cast("long")
    fewer, pairs = F.least(first, second).cast("double"), (first + second).cast("double")

    def add(s: Column, i: Column) -> Column:
        following = s["t"] * (pairs - i + 1) / i
        return F.struct(following.alias("t"), (s["sum"] + F.when(i <= fewer, following).otherwise(0.0)).alias("sum"))

    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum"))
    ways = F.aggregate(F.sequence(F.lit(1), F.lit(EXACT_BELOW)), start, add, lambda s: s["sum"])
    exact = F.least(F.lit(1.0), 2.0 * ways / F.pow(F.lit(2.0), pairs))
    return F.when(pairs < EXACT_BELOW, exact).otherwise(error_tail(F.abs(pairs - 2 * fewer - 1) / F.sqrt(2 * pairs)))


def mcnemar_table(tables: DataFrame) -> DataFrame:
    """Add ``p_value`` to contingency counts."""
    return tables.withColumn("p_value", mcnemar_p(F.col("only_first"), F.col("only_second")))
