"""Panels, tasks and banks as wholes: frames, stacks, unions, drift, bridges, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.irt import pearson

LEAST_PRECISION_ITEMS = 10


def usable(params: DataFrame) -> DataFrame:
    """Items whose parameters are all finite."""
    whole = F.lit(True)
    for p in "abc":
        whole = whole & F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return params.where(whole)


def measurable(responses: DataFrame, params: DataFrame) -> DataFrame:
    """Answered cells of items the bank can place."""
    return responses.join(usable(params).select("item_id"), "item_id", "left_semi")


def stacked(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of two panels over the same suite; a benchmark missing in one comes from the other."""
    both = first.unionByName(second)
    known = both.where("benchmark is not null").groupBy("item_id").agg(F.min("benchmark").alias("known_"))
    return both.join(known, "item_id", "left").withColumn("benchmark", F.coalesce("benchmark", "known_")).drop("known_")


def task_scores(identity: DataFrame, scores: DataFrame) -> DataFrame:
    """identity: task, doc_id, item_id, answer_key; scores: task, doc_id, model_id, correct."""
    return identity.join(scores, ["task", "doc_id"])


def key_drift(answers: DataFrame) -> DataFrame:
    """answers: task, item_id, model_id, answer_key. By task: items, those whose keys differ, those
    that every model answered and those that under half of the models did."""
    models = answers.groupBy("task").agg(F.count_distinct("model_id").alias("n_models"))
    items = answers.groupBy("task", "item_id").agg(F.count_distinct("model_id").alias("by"), (F.count_distinct("answer_key") > 1).alias("drifted"))
    return items.join(models, "task").groupBy("task", "n_models").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("drifted").alias("n_drifted"), F.count_if(F.col("by") == F.col("n_models")).alias("answered_by_all"), F.count_if(2 * F.col("by") < F.col("n_models")).alias("under_half")
    )


def bridge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Items of two banks that ask the same question. first: item_id, question_id after a
    prefix 'bank:'; second: the question_id behind the last '#'. item_id's of both, once each."""
    one = first.select(F.col("item_id").alias("first_id"), F.regexp_replace("question_id", "^[^:]*:", "").alias("q"))
    two = second.select(F.col("item_id").alias("second_id"), F.substring_index("question_id", "#", -1).alias("q"))
    return one.join(two, "q").groupBy("q").agg(F.min("first_id").alias("first_id"), F.min("second_id").alias("second_id"))


def discrimination(params: DataFrame) -> DataFrame:
    return params.agg(F.count(F.lit(1)).alias("n_items"), F.median("a").alias("median_a"), F.avg((F.col("a") < 0.3).cast("int")).alias("share_low"), F.avg((F.col("a") < 0).cast("int")).alias("share_negative"))


def precise(able: DataFrame, target: float, least: int = LEAST_PRECISION_ITEMS) -> DataFrame:
    """able: model_id, se, n. Whether a test may stop: enough items and an error small enough."""
    return able.select("model_id", "n", "se", ((F.col("n") >= least) & (F.col("se") <= target)).alias("reached"))


def first_reach(curve: DataFrame, value: str, target: Column) -> DataFrame:
    """By method the first n whose value reaches the target; null where none does."""
    return curve.groupBy("method").agg(F.min(F.when(F.col(value) >= target, F.col("n"))).alias("n"))


def carried(estimates: DataFrame, points: DataFrame) -> DataFrame:
    """estimates: model_id, n, theta; points: n. The last estimate at or before each point, for
    models that ran out of items."""
    return points.select(F.col("n").alias("at")).join(estimates, F.col("n") <= F.col("at")).groupBy("model_id", "at").agg(F.max_by("theta", "n").alias("theta"), F.max("n").alias("n"))


def build_summary(before: DataFrame, kept: DataFrame, items: DataFrame) -> DataFrame:
    """By benchmark: items, items dropped by the floor, and responses kept."""
    n = before.groupBy("item_id").agg(F.count(F.lit(1)).alias("had")).join(kept.groupBy("item_id").agg(F.count(F.lit(1)).alias("has")), "item_id", "left").join(items.select("item_id", "benchmark"), "item_id")
    return n.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("has").isNull()).alias("n_dropped"), F.coalesce(F.sum("has"), F.lit(0)).alias("n_responses"))


def reliability(agreements: DataFrame, n_items: int) -> DataFrame:
    """agreements: source, alias, agreement. The own run's worst flip rate where there is
    one, else the worst of hosted (not local-) models; and the standard deviation of a score, in points."""
    hosted = ~F.col("alias").startswith("local-")
    worst = agreements.agg(F.max(F.when((F.col("source") == "own") & hosted, 1 - F.col("agreement"))).alias("own"), F.max(F.when((F.col("source") != "own") & hosted, 1 - F.col("agreement"))).alias("others"))
    rate = F.coalesce("own", "others")
    return worst.select(rate.alias("flip_rate"), F.col("own").isNotNull().alias("measured"), (100 * F.sqrt(rate / n_items)).alias("points_sd"))


def bootstrap_mean(values: DataFrame, draws: DataFrame, pick: Column) -> DataFrame:
    """values: group, place (from 0), n, value; draws: draw. Percentile interval of each group's mean;
    pick: which place the k-th of a draw's n values has (over draw, place and n)."""
    drawn = values.crossJoin(F.broadcast(draws)).select("group", "draw", pick.alias("place"))
    means = drawn.join(values.select("group", "place", "value"), ["group", "place"]).groupBy("group", "draw").agg(F.avg("value").alias("mean"))
    point = values.groupBy("group").agg(F.avg("value").alias("point"), F.count(F.lit(1)).alias("n"))
    return point.join(means.groupBy("group").agg(F.expr("percentile(mean, 0.025)").alias("lo"), F.expr("percentile(mean, 0.975)").alias("hi")), "group")


def bootstrap_correlation(values: DataFrame, draws: DataFrame, pick: Column) -> DataFrame:
    """The same for the correlation of x and y; values: place, n, x, y."""
    drawn = values.crossJoin(F.broadcast(draws)).select("draw", pick.alias("place"))
    each = drawn.join(values.select("place", "x", "y"), "place").groupBy("draw").agg(pearson("x", "y").alias("r"))
    point = values.agg(pearson("x", "y").alias("point"), F.count(F.lit(1)).alias("n"))
    return point.crossJoin(each.agg(F.expr("percentile(r, 0.025)").alias("lo"), F.expr("percentile(r, 0.975)").alias("hi")))
