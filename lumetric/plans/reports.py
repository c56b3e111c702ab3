"""Reports as DataFrames: broken items, curves of information, histograms, results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.irt import information, wilson


def worst_items(params: DataFrame, counts: DataFrame, n: int = 20, least_models: int = 60) -> DataFrame:
    """The items of lowest discrimination among those enough models answered."""
    both = params.join(counts, "item_id").where(F.col("n_models") >= least_models)
    return both.orderBy("a", "item_id").limit(n).select("item_id", "a", "b", "n_models")


def histogram(rows: DataFrame, column: str, low: float, high: float, n: int) -> DataFrame:
    """Counts in n equal bins; values beyond the ends count in the end bins."""
    clipped = F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high))
    return rows.groupBy(F.least(F.floor((clipped - low) / ((high - low) / n) + 1e-9), F.lit(n - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def information_curve(params: DataFrame, abilities: DataFrame, best: int = 200) -> DataFrame:
    """theta, information of the whole bank and of its best items at that ability."""
    i = information(F.col("theta"), F.col("a"), F.col("b"), F.col("c"))
    grid = abilities.crossJoin(F.broadcast(params)).select("grid", i.alias("i"))
    return grid.groupBy("grid").agg(F.sum("i").alias("whole"), F.aggregate(F.slice(F.sort_array(F.collect_list("i"), asc=False), 1, best), F.lit(0.0), lambda a, x: a + x).alias("best"))


def flagged_evidence(responses: DataFrame, flagged: DataFrame) -> DataFrame:
    """Accuracy on flagged items and on the rest, with unclamped intervals."""
    mark = flagged.select("item_id", F.lit(True).alias("flag"))
    rows = responses.join(F.broadcast(mark), "item_id", "left").select(F.coalesce("flag", F.lit(False)).alias("flagged"), "correct")
    s = rows.groupBy("flagged").agg(F.sum("correct").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"), z=1.96, clamp=False)
    return s.select("flagged", "k", "n", lo.alias("lo"), hi.alias("hi"))


def decision_table(responses: DataFrame, abilities: DataFrame, z: float = 1.96) -> DataFrame:
    """Accuracy with its interval beside ability with its own, by model."""
    s = responses.groupBy("model_id").agg(F.sum("correct").alias("k"), F.count(F.lit(1)).alias("n")).join(abilities, "model_id")
    lo, hi = wilson(F.col("k"), F.col("n"))
    return s.select("model_id", "k", "n", lo.alias("lo"), hi.alias("hi"), "theta", (F.col("theta") - z * F.col("se")).alias("theta_lo"), (F.col("theta") + z * F.col("se")).alias("theta_hi"))


def panel_table(cells: DataFrame) -> DataFrame:
    """What each model answered, how well, and what it cost (an unpriced cell adds nothing)."""
    return cells.groupBy("model_id").agg(F.count(F.lit(1)).alias("usable"), F.avg("correct").alias("accuracy"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("spend"))


def observed_output(records: DataFrame) -> DataFrame:
    """Mean output tokens of each alias over finished replies."""
    return records.where("finish_reason = 'stop' AND output_tokens is not null").groupBy("alias").agg(F.avg("output_tokens").alias("mean_output"), F.count(F.lit(1)).alias("n"))


def flip_rates(agreement: DataFrame) -> DataFrame:
    """template, alias, agreement: the mean flip rate of each template; no template stands in for another."""
    return agreement.groupBy("template").agg(F.avg(1 - F.col("agreement")).alias("flip_rate"), F.count(F.lit(1)).alias("n"))


def results(**measures: DataFrame) -> DataFrame:
    """One row for each measure: name, point, lo, hi, n; each frame is one row of these."""
    out = None
    for name, df in measures.items():
        row = df.select(F.lit(name).alias("measure"), *[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in ("point", "lo", "hi")], (F.col("n") if "n" in df.columns else F.lit(None)).cast("bigint").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
