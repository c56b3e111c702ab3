"""Differential item functioning by Mantel-Haenszel, and the splits it is run on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.irt import chi2_1_tail

FLAG_DELTA, FLAG_P, LEAST_SIDE = 1.5, 0.01, 10


def mantel_haenszel(responses: DataFrame, binned: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: split, model_id, focal (boolean). A row for each split and item:
    delta (-2.35 ln of the common odds ratio, positive favours the focal group),
    chi2, p, and how many answers each side gave, usable strata or not."""
    models = binned.join(groups, "model_id")
    sides = models.groupBy("split", "bin").agg(F.count_if(F.col("focal")).alias("f"), F.count_if(~F.col("focal")).alias("r"))
    usable = sides.where("f > 0 AND r > 0").select("split", "bin")
    all_of = responses.join(models, "model_id")
    answers = all_of.groupBy("split", "item_id").agg(F.count_if(~F.col("focal")).alias("n_reference"), F.count_if(F.col("focal")).alias("n_focal"))
    both = all_of.join(usable, ["split", "bin"], "left_semi")
    right, focal = F.col("correct") == 1, F.col("focal")
    t = both.groupBy("split", "item_id", "bin").agg(
        F.count_if(~focal & right).cast("double").alias("a"), F.count_if(~focal & ~right).cast("double").alias("b"),
        F.count_if(focal & right).cast("double").alias("c"), F.count_if(focal & ~right).cast("double").alias("d"),
    )
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    t = t.where((a + b >= 2) & (c + d >= 2)).select(
        "split", "item_id",
        (a * d / n).alias("ad"), (b * c / n).alias("bc"), a.alias("a"), ((a + b) * (a + c) / n).alias("e"),
        ((a + b) * (c + d) * (a + c) * (b + d) / (n * n * F.greatest(n - 1, F.lit(1.0)))).alias("v"),
    )
    s = t.groupBy("split", "item_id").agg(*[F.sum(x).alias(x) for x in ("ad", "bc", "a", "e", "v")])
    chi2 = F.when(F.col("v") > 0, F.pow(F.abs(F.col("a") - F.col("e")) - 0.5, 2) / F.col("v"))
    s = answers.join(s, ["split", "item_id"], "left").select("split", "item_id", "n_reference", "n_focal", F.when((F.col("ad") > 0) & (F.col("bc") > 0), -2.35 * F.ln(F.col("ad") / F.col("bc"))).alias("delta"), chi2.alias("chi2"))
    return s.withColumn("p", chi2_1_tail(F.col("chi2")))


def summary(found: DataFrame) -> DataFrame:
    size = F.abs("delta")
    return found.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if((size > FLAG_DELTA) & (F.col("p") < FLAG_P)).alias("n_flagged"), F.median(size).alias("median_abs_delta")
    )


def by_date(models: DataFrame, month: str, name: str) -> DataFrame:
    """Focal: released after a month; models without a date belong to neither side."""
    dated = models.where("release_date is not null AND release_date <> ''")
    return dated.select(F.lit(name).alias("split"), "model_id", (F.substring("release_date", 1, 7) > month).alias("focal"))


def enough(groups: DataFrame, responses: DataFrame, least: int = LEAST_SIDE) -> tuple[DataFrame, DataFrame]:
    """The splits with at least `least` answering models on both sides, and the splits that are
    skipped with the sizes of their sides."""
    there = groups.join(responses.select("model_id").distinct(), "model_id", "left_semi")
    sides = groups.select("split").distinct().join(there.groupBy("split").agg(F.count_if(~F.col("focal")).alias("n_reference"), F.count_if(F.col("focal")).alias("n_focal")), "split", "left").fillna(0)
    fits = F.least("n_reference", "n_focal") >= least
    return there.join(sides.where(fits).select("split"), "split", "left_semi"), sides.where(~fits)


def contrasts(models: DataFrame, published: DataFrame) -> DataFrame:
    """split, benchmark (null: all items), model_id, focal: open weights against the others,
    merges against models trained directly, and for each benchmark with a known month
    (published: benchmark, month) models released after it; models without a date take no part."""
    nothing = F.lit(None).cast("string").alias("benchmark")
    access = models.select(F.lit("open_vs_api").alias("split"), nothing, "model_id", (F.col("access") == "open").alias("focal"))
    merges = models.select(F.lit("merge_vs_trained").alias("split"), nothing, "model_id", (F.col("family") == "merge").alias("focal"))
    dated = models.where("release_date is not null AND release_date <> ''")
    after = dated.crossJoin(F.broadcast(published.where("month <> ''"))).select(F.concat(F.lit("contamination_"), "benchmark").alias("split"), "benchmark", "model_id", (F.substring("release_date", 1, 7) > F.col("month")).alias("focal"))
    return access.unionByName(merges).unionByName(after)


def generation(models: DataFrame) -> DataFrame:
    """Focal: released after the middle month (element n // 2 of the sorted months)."""
    dated = models.where("release_date is not null AND release_date <> ''").select("model_id", F.substring("release_date", 1, 7).alias("month"))
    # counts of a few hundred months instead of a list of all models
    months = dated.groupBy("month").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(W.orderBy("month")))
    middle = months.crossJoin(F.broadcast(dated.agg(F.floor(F.count(F.lit(1)) / 2).alias("half")))).where("upto > half").agg(F.min("month").alias("middle"))
    return dated.crossJoin(F.broadcast(middle)).select(F.lit("generation").alias("split"), "model_id", (F.col("month") > F.col("middle")).alias("focal"))
