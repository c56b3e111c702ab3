"""One EM step as relations: expected counts, Fisher scoring, standard errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.irt import clip, sigmoid


def expected_counts(responses: DataFrame, post: DataFrame) -> DataFrame:
    """n and r of each item and node. Posteriors travel packed, one row for each model."""
    packed = post.groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "post"))), lambda x: x["post"]).alias("p"))
    cells = responses.join(packed, "model_id").select("item_id", "correct", F.posexplode("p").alias("q", "p"))
    return cells.groupBy("item_id", "q").agg(F.sum("p").alias("n"), F.sum(F.col("p") * F.col("correct")).alias("r"))


def sums(counts: DataFrame, params: DataFrame, quad: DataFrame) -> DataFrame:
    """Gradient and information of (a, d) for each item, priors included (two-parameter model)."""
    j = counts.join(F.broadcast(params), "item_id").join(F.broadcast(quad), "q").withColumn("d", -F.col("a") * F.col("b"))
    p = clip(sigmoid(F.col("a") * F.col("x") + F.col("d")), 1e-10, 1 - 1e-10)
    j = j.select("item_id", "a", "d", "x", (F.col("r") - F.col("n") * p).alias("s"), (F.col("n") * p * (1 - p)).alias("w"))
    return j.groupBy("item_id", "a", "d").agg(
        (F.sum(F.col("s") * F.col("x")) - (F.col("a") - 1)).alias("ga"), (F.sum("s") - F.col("d") / 16).alias("gd"),
        (F.sum(F.col("w") * F.col("x") * F.col("x")) + 1).alias("haa"), F.sum(F.col("w") * F.col("x")).alias("had"), (F.sum("w") + 1 / 16).alias("hdd"),
    ).withColumn("det", F.greatest(F.col("haa") * F.col("hdd") - F.col("had") * F.col("had"), F.lit(1e-10)))


def step(s: DataFrame) -> DataFrame:
    """The scoring step, clipped and bounded."""
    da = clip((F.col("hdd") * F.col("ga") - F.col("had") * F.col("gd")) / F.col("det"), -2, 2)
    dd = clip((F.col("haa") * F.col("gd") - F.col("had") * F.col("ga")) / F.col("det"), -4, 4)
    return s.select("item_id", clip(F.col("a") + da, -6, 6).alias("a"), clip(F.col("d") + dd, -30, 30).alias("d"))


def standard_errors(s: DataFrame) -> DataFrame:
    """Of a and b = -d/a, by the delta method."""
    va, vd, cov = F.col("hdd") / F.col("det"), F.col("haa") / F.col("det"), -F.col("had") / F.col("det")
    to_a, to_d = F.col("d") / (F.col("a") * F.col("a")), -1 / F.col("a")
    vb = to_a * to_a * va + to_d * to_d * vd + 2 * to_a * to_d * cov
    return s.select("item_id", F.sqrt(va).alias("se_a"), F.sqrt(F.greatest(vb, F.lit(0.0))).alias("se_b"))
