"""Item diagnostics against abilities: fit, correlation, curves, separation, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.irt import clip, information, p_correct, pearson

BINS = 5
LOW_A, HIGH_OUTFIT, LOW_OUTFIT, DROP, LEAST_BIN = 0.3, 1.3, 0.7, 0.15, 5


def joined(responses: DataFrame, params: DataFrame, abilities: DataFrame) -> DataFrame:
    return responses.join(abilities, "model_id").join(params, "item_id")


def residuals(responses: DataFrame, params: DataFrame, abilities: DataFrame) -> DataFrame:
    """model_id, item_id, correct, p and the standardised residual z."""
    p = clip(p_correct(F.col("theta"), F.col("a"), F.col("b"), F.col("c")), 1e-6, 1 - 1e-6)
    out = joined(responses, params, abilities).select("model_id", "item_id", "correct", "theta", p.alias("p"))
    return out.withColumn("z", (F.col("correct") - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p"))))


def infit_outfit(res: DataFrame) -> DataFrame:
    square, v = F.pow(F.col("correct") - F.col("p"), 2), F.col("p") * (1 - F.col("p"))
    return res.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), (F.sum(square) / F.sum(v)).alias("infit"), F.avg(square / v).alias("outfit"))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; null where a side is constant."""
    return F.when((F.stddev_pop(x) > 1e-9) & (F.stddev_pop(y) > 1e-9), pearson(x, y))


def point_biserial(responses: DataFrame, abilities: DataFrame) -> DataFrame:
    both = responses.join(abilities, "model_id").withColumn("y", F.col("correct").cast("double"))
    return both.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("proportion"), safe_corr("theta", "y").alias("r"))


def bins(abilities: DataFrame, n: int = BINS) -> DataFrame:
    """model_id, theta, bin: by quantiles of all abilities; a bin's upper edge belongs to it."""
    edges = abilities.agg(*[F.expr(f"percentile(theta, {i / n})").alias(f"e{i}") for i in range(1, n)])
    above = sum(((F.col("theta") > F.col(f"e{i}")).cast("int") for i in range(1, n)), F.lit(0))
    return abilities.crossJoin(F.broadcast(edges)).select("model_id", "theta", above.alias("bin"))


def empirical_curve(responses: DataFrame, binned: DataFrame) -> DataFrame:
    both = responses.join(binned, "model_id")
    return both.groupBy("item_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("proportion"))


def monotone_drop(curve: DataFrame) -> DataFrame:
    """The largest fall between neighbouring bins (a missing bin breaks the pair)."""
    order = W.partitionBy("item_id").orderBy("bin")
    steps = curve.select("item_id", "bin", "n", "proportion", F.lag("proportion").over(order).alias("before"), F.lag("bin").over(order).alias("bin0"))
    fall = F.when(F.col("bin") == F.col("bin0") + 1, F.col("before") - F.col("proportion"))
    return steps.groupBy("item_id").agg(F.greatest(F.coalesce(F.max(fall), F.lit(0.0)), F.lit(0.0)).alias("drop"), F.min("n").alias("least_n"), F.count(F.lit(1)).alias("n_bins"))


def separation(responses: DataFrame, abilities: DataFrame) -> DataFrame:
    """Mann-Whitney AUC of ability for right over wrong, ties by model_id."""
    order = W.partitionBy("item_id").orderBy("theta", "model_id").rowsBetween(W.unboundedPreceding, 0)
    both = responses.join(abilities, "model_id").withColumn("below", F.sum(1 - F.col("correct")).over(order))
    out = both.groupBy("item_id").agg(F.sum(F.col("correct") * F.col("below")).alias("wins"), F.sum("correct").alias("n1"), F.sum(1 - F.col("correct")).alias("n0"))
    return out.select("item_id", "n1", "n0", F.try_divide(F.col("wins").cast("double"), F.col("n1") * F.col("n0")).alias("auc"))


def flags(params: DataFrame, fit: DataFrame, biserial: DataFrame, auc: DataFrame, drops: DataFrame) -> DataFrame:
    """Nine boolean flags for each item."""
    every = params.join(fit.select("item_id", "outfit"), "item_id").join(biserial.select("item_id", "proportion"), "item_id").join(auc.select("item_id", "auc"), "item_id").join(drops.select("item_id", "drop", "least_n"), "item_id")
    return every.select(
        "item_id",
        F.coalesce(F.col("auc") >= 1, F.lit(False)).alias("perfect_separation"),
        (F.col("a") < 0).alias("negative_slope"),
        ((F.col("a") >= 0) & (F.col("a") < LOW_A)).alias("low_slope"),
        (F.col("outfit") > HIGH_OUTFIT).alias("underfit"),
        (F.col("outfit") < LOW_OUTFIT).alias("overfit"),
        ((F.col("least_n") >= LEAST_BIN) & (F.col("drop") > DROP)).alias("non_monotone"),
        (F.col("proportion") > 0.99).alias("too_easy"),
        (F.col("proportion") < 0.01).alias("too_hard"),
        (information(F.lit(0.0), F.col("a"), F.col("b"), F.col("c")) < 0.01).alias("no_information"),
    )


def flags_by_benchmark(flagged: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of each flag by benchmark, and for all (benchmark null)."""
    names = [c for c in flagged.columns if c != "item_id"]
    both = flagged.join(items.select("item_id", "benchmark"), "item_id")
    return both.rollup("benchmark").agg(F.count(F.lit(1)).alias("n_items"), *[F.count_if(F.col(c)).alias(c) for c in names])
