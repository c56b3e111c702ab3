"""Local dependence: residual correlations, tetrachorics, design effects, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.irt import pearson
from ..sources.scratch import stored
from .selection import per_benchmark

FLAG, BLOCK, LEAST_MODELS = 0.2, 0.8, 20
#: Items of a benchmark whose pairs are looked at.
MOST_ITEMS = 500


def complete_cases(rows: DataFrame, key: str = "benchmark") -> DataFrame:
    """Rows of the models that answered all of their benchmark's items."""
    total = rows.groupBy(key).agg(F.count_distinct("item_id").alias("items_"))
    each = rows.groupBy(key, "model_id").agg(F.count_distinct("item_id").alias("n_"))
    whole = each.join(F.broadcast(total), key).where("n_ = items_").select(key, "model_id")
    return rows.join(whole, [key, "model_id"], "left_semi")


def item_pairs(rows: DataFrame, *values: str) -> DataFrame:
    """Self-join of answers by benchmark and model, each pair of items once: for each model
    the square of a benchmark's items, which callers bound by sampled()."""
    left = rows.select("benchmark", "model_id", F.col("item_id").alias("i"), *[F.col(v).alias(f"{v}1") for v in values])
    right = rows.select("benchmark", "model_id", F.col("item_id").alias("j"), *[F.col(v).alias(f"{v}2") for v in values])
    return left.join(right, ["benchmark", "model_id"]).where("i < j")


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """Rows of at most `most` items of each benchmark, drawn by a keyed hash: the sample that
    the definition of residual correlations names."""
    items = per_benchmark(rows.select("benchmark", "item_id").distinct(), most, "dependence")
    return rows.join(items.select("item_id"), "item_id", "left_semi")


def q3(residuals: DataFrame, most_items: int = MOST_ITEMS) -> DataFrame:
    """benchmark, i, j, n, q3 (null where a side is constant) over complete cases."""
    pairs = item_pairs(complete_cases(sampled(residuals, most_items)), "z")
    out = pairs.groupBy("benchmark", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.when((F.stddev_pop("z1") > 1e-9) & (F.stddev_pop("z2") > 1e-9), pearson("z1", "z2")).alias("q3"))
    return out.where(F.col("n") >= LEAST_MODELS)


def q3_summary(pairs: DataFrame) -> DataFrame:
    some = pairs.where("q3 is not null")
    return some.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("q3").alias("mean"), F.stddev_pop("q3").alias("sd"), F.expr("percentile(q3, 0.95)").alias("p95"),
        F.max("q3").alias("max"), F.avg((F.col("q3") > FLAG).cast("int")).alias("share_above"),
    )


def design_effect(summary: DataFrame, sizes: DataFrame) -> DataFrame:
    """Variance inflation of a mean over n dependent items, and the items it is worth."""
    both = summary.select("benchmark", "mean").join(sizes, "benchmark")
    effect = 1 + F.greatest(F.col("n") - 1, F.lit(0)) * F.greatest(F.col("mean"), F.lit(0.0))
    return both.select("benchmark", "n", effect.alias("design_effect"), (F.col("n") / effect).alias("effective_items"))


def tetrachoric(rows: DataFrame, most_items: int = MOST_ITEMS) -> DataFrame:
    """Digby's approximation over complete cases, half a count added to each cell."""
    pairs = item_pairs(complete_cases(sampled(rows, most_items)), "correct")

    def cell(x: int, y: int):
        return F.count_if((F.col("correct1") == x) & (F.col("correct2") == y)).cast("double")

    t = pairs.groupBy("benchmark", "i", "j").agg(F.count(F.lit(1)).alias("n"), cell(1, 1).alias("n11"), cell(0, 0).alias("n00"), cell(1, 0).alias("n10"), cell(0, 1).alias("n01"))
    u = F.pow((F.col("n11") + 0.5) * (F.col("n00") + 0.5) / ((F.col("n10") + 0.5) * (F.col("n01") + 0.5)), F.lit(0.75))
    rho = F.least(F.greatest((u - 1) / (u + 1), F.lit(-0.999)), F.lit(0.999))
    return t.where(F.col("n") >= LEAST_MODELS).select("benchmark", "i", "j", "n", rho.alias("rho"))


def blocks(pairs: DataFrame, value: str = "q3", least: float = BLOCK, rounds: int = 40) -> DataFrame:
    """Connected components of pairs above `least`: block_id (the smallest item),
    item_id, size and the largest value inside. Labels move to their smallest
    neighbour until none moves; every round is a stored table."""
    edges = pairs.where(F.col(value) > least).select("i", "j", value)
    both = edges.select(F.col("i").alias("item_id"), F.col("j").alias("other")).unionByName(edges.select(F.col("j").alias("item_id"), F.col("i").alias("other"))).distinct()
    label = both.groupBy("item_id").agg(F.least(F.min("item_id"), F.min("other")).alias("block_id"))
    for _ in range(rounds):
        near = both.join(label.select(F.col("item_id").alias("other"), F.col("block_id").alias("near")), "other").groupBy("item_id").agg(F.min("near").alias("near"))
        moved = label.join(near, "item_id").select("item_id", F.least("block_id", "near").alias("block_id"), (F.col("near") < F.col("block_id")).alias("moved"))
        moved = stored(moved, "blocks")
        label = moved.select("item_id", "block_id")
        if not moved.where("moved").limit(1).count():
            break
    inside = edges.join(label.withColumnRenamed("item_id", "i"), "i").groupBy("block_id").agg(F.max(value).alias("max_value"))
    sizes = label.groupBy("block_id").agg(F.count(F.lit(1)).alias("size"))
    return label.join(sizes, "block_id").join(inside, "block_id").select("block_id", "item_id", "size", "max_value")


def ability_correlations(abilities: DataFrame, least: int = 5) -> DataFrame:
    """Correlation of every two benchmarks' abilities over shared models; null under `least`."""
    left = abilities.select("model_id", F.col("benchmark").alias("b1"), F.col("theta").alias("t1"))
    right = abilities.select("model_id", F.col("benchmark").alias("b2"), F.col("theta").alias("t2"))
    both = left.join(right, "model_id").where("b1 < b2")
    r = F.when((F.count(F.lit(1)) >= least) & (F.stddev_pop("t1") > 1e-9) & (F.stddev_pop("t2") > 1e-9), pearson("t1", "t2"))
    return both.groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("n"), r.alias("r"))
