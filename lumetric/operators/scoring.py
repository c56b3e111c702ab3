"""Abilities by expected a posteriori scoring, relationally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.irt import clip, p_correct


def node_terms(params: DataFrame, quad: DataFrame) -> DataFrame:
    """item_id, q, and the log probabilities of a right and a wrong answer (items x nodes)."""
    p = clip(p_correct(F.col("x"), F.col("a"), F.col("b"), F.col("c")), 1e-10, 1 - 1e-10)
    grid = params.crossJoin(F.broadcast(quad)).select("item_id", "q", p.alias("p"))
    return grid.select("item_id", "q", F.ln("p").alias("lp1"), F.ln(1 - F.col("p")).alias("lp0"))


def posterior(responses: DataFrame, params: DataFrame, quad: DataFrame) -> DataFrame:
    """model_id, q, x, post and the model's loglik.

    An item's nodes are packed into one row of arrays, so a response joins once;
    the sums over items come back as one row for each model and node.
    """
    packed = node_terms(params, quad).groupBy("item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("q", "lp1", "lp0"))), lambda t: F.struct(t["lp1"].alias("lp1"), t["lp0"].alias("lp0"))).alias("terms")
    )
    scored = responses.join(packed, "item_id").select("model_id", F.posexplode(F.when(F.col("correct") == 1, F.transform("terms", lambda t: t["lp1"])).otherwise(F.transform("terms", lambda t: t["lp0"]))).alias("q", "lp"))
    sums = scored.groupBy("model_id", "q").agg(F.sum("lp").alias("lp")).join(F.broadcast(quad), "q")
    sums = sums.select("model_id", "q", "x", (F.col("lp") + F.col("lw")).alias("l"))
    model = W.partitionBy("model_id")
    top = sums.withColumn("top", F.max("l").over(model)).withColumn("e", F.exp(F.col("l") - F.col("top")))
    total = F.sum("e").over(model)
    return top.select("model_id", "q", "x", (F.col("e") / total).alias("post"), (F.col("top") + F.ln(total)).alias("loglik"))


def eap(responses: DataFrame, params: DataFrame, quad: DataFrame) -> DataFrame:
    post = posterior(responses, params, quad)
    out = post.groupBy("model_id").agg(
        F.sum(F.col("post") * F.col("x")).alias("theta"), F.sum(F.col("post") * F.col("x") * F.col("x")).alias("square"), F.max("loglik").alias("loglik")
    )
    return out.select("model_id", "theta", F.sqrt(F.greatest(F.col("square") - F.col("theta") * F.col("theta"), F.lit(0.0))).alias("se"), "loglik")


def interval(post: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Equal-tailed credible interval: the posterior's distribution function,
    inverted by linear interpolation and held at the end nodes."""
    order = W.partitionBy("model_id").orderBy("q")
    cdf = post.select("model_id", "q", "x", F.sum("post").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("f"))
    cdf = cdf.withColumn("f0", F.lag("f").over(order)).withColumn("x0", F.lag("x").over(order))

    def at(level: float):
        hit = F.col("f") >= level
        value = F.when(F.col("f0").isNull(), F.col("x")).otherwise(F.col("x0") + (F.lit(level) - F.col("f0")) / (F.col("f") - F.col("f0")) * (F.col("x") - F.col("x0")))
        return F.coalesce(F.min_by(F.when(hit, value), F.when(hit, F.col("q"))), F.max("x"))

    return cdf.groupBy("model_id").agg(at(low).alias("lo"), at(high).alias("hi"))
