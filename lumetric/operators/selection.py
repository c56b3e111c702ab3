"""Choosing items: adaptive step, random and stratified subsets, suites, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.irt import information
from ..sources.fixtures import uniform


def strata(items: DataFrame) -> DataFrame:
    """benchmark, its place by name, and its share of the items."""
    n = items.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))
    all_of = W.partitionBy(F.lit(0))
    return n.select("benchmark", "n", (F.row_number().over(all_of.orderBy("benchmark")) - 1).alias("place"), (F.col("n") / F.sum("n").over(all_of)).alias("weight"))


def selector_step(abilities: DataFrame, answered: DataFrame, bank: DataFrame, weights: DataFrame) -> DataFrame:
    """The next item of each model: of the benchmark with the largest deficit that
    still has items, the most informative one at the model's theta. bank: item_id,
    benchmark, a, b, c. Ties go to the first benchmark and the smallest item."""
    used = answered.join(bank.select("item_id", "benchmark"), "item_id").groupBy("model_id", "benchmark").agg(F.count(F.lit(1)).alias("used"))
    total = used.groupBy("model_id").agg(F.sum("used").alias("total"))
    open_items = abilities.crossJoin(bank).join(answered.select("model_id", "item_id"), ["model_id", "item_id"], "left_anti")
    open_items = open_items.join(weights.select("benchmark", "weight"), "benchmark").join(used, ["model_id", "benchmark"], "left").join(total, "model_id", "left")
    deficit = F.col("weight") * F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)) - F.coalesce("used", F.lit(0))
    i = information(F.col("theta"), F.col("a"), F.col("b"), F.col("c"))
    order = W.partitionBy("model_id").orderBy(F.desc(F.round(deficit, 9)), "benchmark", F.desc(F.round(i, 9)), "item_id")
    return open_items.select("model_id", "item_id", "benchmark", i.alias("information"), F.row_number().over(order).alias("r")).where("r = 1").drop("r")


def random_subset(cells: DataFrame, n: int, seed: str) -> DataFrame:
    """n items of each model without replacement, by a keyed hash."""
    order = W.partitionBy("model_id").orderBy(uniform(F.lit(seed), "model_id", "item_id"), "item_id")
    return cells.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def per_benchmark(items: DataFrame, n: int, seed: str) -> DataFrame:
    """At most n items of each benchmark, by a keyed hash."""
    order = W.partitionBy("benchmark").orderBy(uniform(F.lit(seed), "item_id"), "item_id")
    return items.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def stratified_subset(items: DataFrame, n: int, seed: str, bins: int = 4) -> DataFrame:
    """items: item_id, benchmark, b. A benchmark gets its rounded share (to even):
    all its items if they are no more, else equally many from each of `bins` runs
    of items by difficulty, one at least; so the size isn't exactly n."""
    of = W.partitionBy("benchmark")
    placed = items.select(
        "item_id", "benchmark", "b", F.count(F.lit(1)).over(of).alias("m"), F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("total"),
        (F.row_number().over(of.orderBy("b", "item_id")) - 1).alias("at"),
    ).withColumn("want", F.bround(F.lit(float(n)) * F.col("m") / F.col("total")).cast("int"))
    big, rest = F.floor(F.col("m") / bins), F.col("m") % bins  # the first `rest` runs hold one more
    run = F.when(F.col("at") < rest * (big + 1), F.floor(F.col("at") / (big + 1))).otherwise(rest + F.floor((F.col("at") - rest * (big + 1)) / F.greatest(big, F.lit(1))))
    binned = placed.withColumn("run", F.when(F.col("m") <= F.col("want"), F.lit(0)).otherwise(run).cast("int"))
    quota = F.when(F.col("m") <= F.col("want"), F.col("m")).otherwise(F.greatest(F.floor(F.col("want") / bins), F.lit(1)))
    order = W.partitionBy("benchmark", "run").orderBy(uniform(F.lit(seed), "item_id"), "item_id")
    return binned.withColumn("r", F.row_number().over(order)).where((F.col("want") > 0) & (F.col("r") <= quota)).select("benchmark", "run", "item_id")


def apportion(items: DataFrame, size: int) -> DataFrame:
    """Largest-remainder seats of each benchmark (all of a benchmark at most: shares
    of a size within the pool never ask for more)."""
    all_of = W.partitionBy(F.lit(0))
    n = items.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("exact", F.lit(float(size)) * F.col("n") / F.sum("n").over(all_of)).withColumn("base", F.floor("exact"))
    order = all_of.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "benchmark")
    left = F.lit(size) - F.sum("base").over(all_of)
    return n.select("benchmark", "n", (F.col("base") + (F.row_number().over(order) <= left).cast("int")).cast("bigint").alias("seats"))


def suite(items: DataFrame, size: int, seed: str) -> DataFrame:
    seats = apportion(items, size).select("benchmark", "seats")
    order = W.partitionBy("benchmark").orderBy(uniform(F.lit(seed), "item_id"), "item_id")
    return items.join(seats, "benchmark").withColumn("r", F.row_number().over(order)).where("r <= seats").select("benchmark", "item_id")


def cost_by_checkpoint(cells: DataFrame, checkpoints: list[int], seed: str) -> DataFrame:
    """What the first n cells of a model's random order cost; an unpriced cell adds nothing."""
    order = W.partitionBy("model_id").orderBy(uniform(F.lit(seed), "model_id", "item_id"), "item_id").rowsBetween(W.unboundedPreceding, 0)
    run = cells.select("model_id", F.count(F.lit(1)).over(order).alias("n"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).over(order).alias("spend"))
    return run.where(F.col("n").isin(*checkpoints))


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4 + 0.5)


def run_estimate(prompts: DataFrame, prices: DataFrame, output_tokens: int, margin: float = 1.25) -> DataFrame:
    """prompts: alias, chars. prices: alias, input, output (USD for a million tokens),
    batch (multiplier or null). A model without a price has no cost, which isn't a cost of 0."""
    n = prompts.groupBy("alias").agg(F.count(F.lit(1)).alias("calls"), F.sum(token_estimate(F.col("chars"))).alias("input_tokens"))
    both = n.join(prices, "alias", "left")
    cost = (F.col("input_tokens") * F.col("input") + F.col("calls") * output_tokens * F.col("output")) / 1e6 * F.coalesce("batch", F.lit(1.0))
    return both.select("alias", "calls", "input_tokens", cost.alias("cost_usd"), (cost * margin).alias("with_margin"))
