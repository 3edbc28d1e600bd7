"""Stationary block bootstraps as blocks: a resample is a list of (start, length), never a copied series.

A resample of n steps starts at a drawn step and goes on to the next, around the end, with a chance of 1 - 1/L; otherwise it
draws anew. Blocks come from the draws that begin one. Sums over a resample are differences of prefix sums at its blocks' ends;
its distribution is the series' ranks weighted by how often blocks cover each step. Draws are keyed by resample and step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.simulate import hash_uniform


def blocks(returns: DataFrame, resamples: int, mean_length: float, seed: int = 1) -> DataFrame:
    """(ticker, b, start, length): the blocks of every resample, start from 0, cut at the resample's end. A block may go around the end."""
    sizes = returns.groupBy("ticker").agg(F.count("*").alias("n"))
    draws = sizes.withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(resamples).cast("long")))).withColumn("t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    fresh = (F.col("t") == 1) | (hash_uniform(F.col("b"), F.col("t"), 2 * seed) < 1 / mean_length)
    begun = draws.where(fresh).withColumn("start", F.floor(hash_uniform(F.col("b"), F.col("t"), 2 * seed + 1) * F.col("n")).cast("long"))
    after = F.coalesce(F.lead("t").over(Window.partitionBy("ticker", "b").orderBy("t")), F.col("n") + 1)
    return begun.select("ticker", "b", "n", "start", (after - F.col("t")).alias("length"))


def _arcs(found: DataFrame) -> DataFrame:
    """Blocks as arcs [lo, hi) within the series: whole rounds and what is left of them, none around the end."""
    rounds = F.expr("length div n")
    rest = F.col("length") - rounds * F.col("n")
    stop = F.col("start") + rest
    arc = lambda lo, hi, times: F.struct(F.lit(lo).cast("long").alias("lo") if isinstance(lo, int) else lo.alias("lo"), hi.alias("hi"), times.alias("times"))
    one = F.lit(1).cast("long")
    arcs = F.array(arc(0, F.col("n"), rounds), arc(F.col("start"), F.least(stop, F.col("n")), one), arc(0, F.greatest(stop - F.col("n"), F.lit(0).cast("long")), one))
    return found.select("ticker", "b", "n", F.explode(arcs).alias("a")).select("ticker", "b", "n", "a.*").where("times > 0 and hi > lo")


def resampled_kurtosis(returns: DataFrame, found: DataFrame) -> DataFrame:
    """(ticker, b, kurt): excess kurtosis, by the n - 1 deviation, of every resample, from prefix sums of the series' centred powers."""
    mean = returns.groupBy("ticker").agg(F.avg("g").alias("mean"))
    upto = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    d = returns.join(mean, "ticker").withColumn("d", F.col("g") - F.col("mean"))
    sums = d.select("ticker", F.col("idx").alias("at"), *[F.sum(F.pow("d", F.lit(k))).over(upto).alias(f"s{k}") for k in range(1, 5)])
    ends = _arcs(found).select("ticker", "b", "n", F.explode(F.array(F.struct(F.col("hi").alias("at"), F.col("times").alias("sign")), F.struct(F.col("lo").alias("at"), (-F.col("times")).alias("sign")))).alias("e")).select("ticker", "b", "n", "e.*").where("at > 0")
    met = ends.groupBy("ticker", "b", "n", "at").agg(F.sum("sign").alias("sign")).join(sums, ["ticker", "at"])
    m = met.groupBy("ticker", "b").agg(F.first("n").cast("double").alias("n"), *[F.sum(F.col("sign") * F.col(f"s{k}")).alias(f"m{k}") for k in range(1, 5)])
    m = m.select("ticker", "b", "n", *[(F.col(f"m{k}") / F.col("n")).alias(f"m{k}") for k in range(1, 5)])
    var = F.col("m2") - F.col("m1") ** 2
    fourth = F.col("m4") - 4 * F.col("m3") * F.col("m1") + 6 * F.col("m2") * F.col("m1") ** 2 - 3 * F.col("m1") ** 4
    sample = F.nullif(var * F.col("n") / (F.col("n") - 1), F.lit(0.0))
    return m.select("ticker", "b", (fourth / (sample * sample) - 3).alias("kurt"))


def resampled_ks(returns: DataFrame, found: DataFrame) -> DataFrame:
    """(ticker, b, ks): Kolmogorov-Smirnov distance of every resample to the series, from its ranks' weights.

    A rank's weight changes only at the ends of arcs, so the sums of weights up to a rank need each step's cover: arcs are
    spread over the steps they cover, a row of (rank, weight) each, and summed in order of rank within a resample.
    """
    top = F.count("*").over(Window.partitionBy("ticker").orderBy("g").rangeBetween(Window.unboundedPreceding, 0))
    ranks = returns.select("ticker", (F.col("idx") - 1).alias("step"), top.alias("upto"))
    cover = _arcs(found).select("ticker", "b", "n", "times", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("step"))
    weights = cover.join(ranks, ["ticker", "step"]).groupBy("ticker", "b", "n", "upto").agg(F.sum("times").alias("w"))
    by = Window.partitionBy("ticker", "b").orderBy("upto")
    # the distance is largest at a value of the resample or just below one
    here = F.sum("w").over(by) / F.col("n")
    before = here - F.col("w") / F.col("n")
    shares = ranks.groupBy("ticker", "upto").agg(F.count("*").alias("same"))
    gaps = weights.join(shares, ["ticker", "upto"]).withColumn("gap", F.greatest(F.abs(here - F.col("upto") / F.col("n")), F.abs(before - (F.col("upto") - F.col("same")) / F.col("n"))))
    return gaps.groupBy("ticker", "b").agg(F.max("gap").alias("ks"))


def interval(rows: DataFrame, x: str, probs: tuple[float, ...]) -> DataFrame:
    """Interpolated quantiles of x over the resamples of a ticker, as columns q025 and so on."""
    q = rows.groupBy("ticker").agg(F.count("*").alias("resamples"), F.percentile(x, F.array(*map(F.lit, probs))).alias("q"))
    return q.select("ticker", "resamples", *[F.col("q")[i].alias(f"q{round(1000 * p):03d}") for i, p in enumerate(probs)])


def generator_paths(returns: DataFrame, early: Column, paths: int, seed: int = 5) -> list[tuple[str, DataFrame, DataFrame]]:
    """(generator, paths, observed) of three generators, to show how often a test passes what is right, nearly right and wrong.

    later: steps drawn from the later part, against it; earlier: as many steps drawn from the earlier part, against the later one;
    normal: as many normal draws as the earlier part has steps, with its mean and sample deviation, against it. idx runs from 1
    without gaps. Every step of the part gives the step of each path, so draws are spread as the rows are. A ticker without
    an earlier or a later part has no paths of the generators that need it; one earlier step has no deviation, so no normal path.
    """
    part = returns.select("ticker", "idx", "g", F.coalesce(early, F.lit(False)).alias("early"))
    mine = F.when(F.col("early"), F.col("g"))
    sizes = part.groupBy("ticker").agg(F.count_if("early").alias("n_early"), F.count_if(~F.col("early")).alias("n_late"), F.avg(mine).alias("mu"), F.stddev_samp(mine).alias("sd"))
    steps = part.join(sizes, "ticker").withColumn("path_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(paths).cast("long"))))
    steps = steps.withColumn("t", F.col("idx") - F.when(F.col("early"), 0).otherwise(F.col("n_early")))
    drawn = lambda k: hash_uniform(F.col("path_id"), F.col("t"), seed + k)
    own, other = part.where("early"), part.where("not early")

    def gathered(at: Column, source: DataFrame) -> DataFrame:
        return steps.where("not early").select("ticker", "path_id", "t", at.cast("long").alias("idx")).join(source.select("ticker", "idx", "g"), ["ticker", "idx"]).select("ticker", "path_id", "t", "g")

    normal = F.col("mu") + F.col("sd") * F.sqrt(-2 * F.log(drawn(2))) * F.cos(2 * F.pi() * drawn(3))
    return [
        ("later", gathered(F.col("n_early") + F.floor(drawn(0) * F.col("n_late")) + 1, other), other),
        ("earlier", gathered(F.floor(drawn(1) * F.col("n_early")) + 1, own), other),
        ("normal", steps.where("early and sd is not null").select("ticker", "path_id", "t", normal.alias("g")), own),
    ]
