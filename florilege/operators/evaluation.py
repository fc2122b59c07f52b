"""Offline evaluation of ranked lists."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(ranks: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """From the gold's rank (null: not found): success@5, recall@20, reciprocal rank, nDCG@20."""
    r = F.col(rank)
    hit = lambda k: F.when(r <= k, 1.0).otherwise(0.0)
    return ranks.select(
        query, hit(5).alias("success5"), hit(20).alias("recall20"), F.coalesce(1.0 / r, F.lit(0.0)).alias("rr"), F.when(r <= 20, 1.0 / F.log2(r + 1)).otherwise(0.0).alias("ndcg20")
    )


def summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    measures = ["success5", "recall20", "rr", "ndcg20"]
    return scores.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in measures])


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1: Stirling's series at x + 8, brought back."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return series - F.log(reduce(lambda p, i: p * (x + i), range(1, 8), x))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p of McNemar's test from the discordant counts, of any size.

    The tail of the binomial is summed from its largest term down; terms 20 standard widths further
    are below e^-800 of it, beyond what a double holds.
    """
    n, k = (only_a + only_b).cast("double"), F.least(only_a, only_b).cast("long")
    last = F.greatest(k - F.ceil(20 * F.sqrt(n) + 50), F.lit(0).cast("long")).cast("long")
    term = lambda i: F.exp(log_gamma(n + 1) - log_gamma(i + 1) - log_gamma(n - i + 1) - n * math.log(2))
    tail = F.aggregate(F.sequence(last, k), F.lit(0.0), lambda s, i: s + term(i.cast("double")))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def sample_size(p1: Column, p2: Column, z_alpha: float = 1.959963984540054, z_beta: float = 0.8416212335729143) -> Column:
    """Units for each arm to tell p1 from p2 (two-sided 0.05, power 0.8)."""
    mean = (p1 + p2) / 2
    top = z_alpha * F.sqrt(2 * mean * (1 - mean)) + z_beta * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return F.ceil(F.try_divide(top * top, (p1 - p2) * (p1 - p2)))


#: Draws of a bootstrap; one MD5 gives eight of 16 bits each.
DRAWS, PER_HASH = 2000, 8
#: Where a draw of 16 bits passes to the next Poisson(1) weight.
POISSON = [round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 65536) for k in range(7)]


def bootstrap(df: DataFrame, unit: str, value: str, iterations: int = DRAWS, seed: int = 7) -> DataFrame:
    """``mean, n, low, high``: a mean with its 95% interval. Each unit gets a Poisson(1) weight in each
    iteration, drawn by the MD5 of unit, block of iterations and seed.

    Poisson weights resample without collecting the units: a unit is read once, in whatever task holds
    it, and each task sums its weights by iteration before the shuffle.
    """
    hashed = df.select(value, unit, F.explode(F.sequence(F.lit(0), F.lit(-(-iterations // PER_HASH) - 1))).alias("b"))
    hashed = hashed.select(value, "b", F.md5(F.concat_ws(":", F.col(unit).cast("string"), F.col("b").cast("string"), F.lit(str(seed)))).alias("h"))
    drawn = hashed.select(value, "b", F.posexplode(F.array(*[F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("int") for k in range(PER_HASH)])).alias("k", "u"))
    weight = sum(((F.col("u") >= c).cast("int") for c in POISSON), F.lit(0))
    means = drawn.where(F.col("b") * PER_HASH + F.col("k") < iterations).groupBy("b", "k").agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias("m"))
    interval = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return df.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).join(F.broadcast(interval))  # one row


def grade(value: Column, threshold: float, at_most: bool) -> Column:
    """A gate: passed where there is a value and it is on the right side; a null never passes."""
    good = value <= threshold if at_most else value >= threshold
    return F.coalesce(good, F.lit(False))
