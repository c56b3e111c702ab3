"""Agreement of two orders: Kendall, Spearman, deciles, banks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.irt import pearson


def kendall(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Tau-b over every two rows. The rows are models, hundreds at most."""
    left = rows.select(F.col(key).alias("k1"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    right = rows.select(F.col(key).alias("k2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    s = left.join(right, F.col("k1") < F.col("k2")).select(F.signum(F.col("x1") - F.col("x2")).alias("sx"), F.signum(F.col("y1") - F.col("y2")).alias("sy"))
    sums = s.agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("sx") * F.col("sy")).alias("cd"), F.sum(F.abs("sx")).alias("nx"), F.sum(F.abs("sy")).alias("ny"))
    return sums.select("pairs", F.try_divide(F.col("cd"), F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def kendall_by(rows: DataFrame, by: list[str], x: str, y: str, key: str) -> DataFrame:
    """Tau-b within each group, over every two of its rows (models)."""
    left = rows.select(*by, F.col(key).alias("k1"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    right = rows.select(*by, F.col(key).alias("k2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    s = left.join(right, by).where("k1 < k2").select(*by, F.signum(F.col("x1") - F.col("x2")).alias("sx"), F.signum(F.col("y1") - F.col("y2")).alias("sy"))
    sums = s.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("sx") * F.col("sy")).alias("cd"), F.sum(F.abs("sx")).alias("nx"), F.sum(F.abs("sy")).alias("ny"))
    return sums.select(*by, "pairs", F.try_divide(F.col("cd"), F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def ranked(rows: DataFrame, key: str, *names: str, by: str | None = None) -> DataFrame:
    """Adds rank_<name>: places in ascending order, ties by key."""
    part = W.partitionBy(by) if by else W.partitionBy(F.lit(0))
    return rows.withColumns({f"rank_{n}": F.row_number().over(part.orderBy(n, key)) for n in names})


def spearman(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    r = ranked(rows, key, x, y)
    return r.agg(F.count(F.lit(1)).alias("n"), pearson(F.col(f"rank_{x}").cast("double"), F.col(f"rank_{y}").cast("double")).alias("rho"))


def decile_overlap(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Share of the hardest tenth by x that is in the hardest tenth by y."""
    r = ranked(rows, key, x, y).crossJoin(F.broadcast(rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("size"), F.count(F.lit(1)).alias("n"))))
    top = F.col("n") - F.col("size")
    return r.groupBy("size").agg((F.count_if((F.col(f"rank_{x}") > top) & (F.col(f"rank_{y}") > top)) / F.first("size")).alias("overlap"))


def cross_bank(pairs: DataFrame) -> DataFrame:
    """pairs: item_id, a1, b1, a2, b2. Pearson and Spearman of b and a, for all items
    and for those that discriminate (a above 0.3) in both banks."""
    scopes = pairs.withColumn("scope", F.lit("all")).unionByName(pairs.where("a1 > 0.3 AND a2 > 0.3").withColumn("scope", F.lit("working")))
    r = ranked(scopes, "item_id", "a1", "a2", "b1", "b2", by="scope")

    def d(c: str):
        return F.col(c).cast("double")

    return r.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), pearson("b1", "b2").alias("pearson_b"), pearson(d("rank_b1"), d("rank_b2")).alias("spearman_b"),
        pearson("a1", "a2").alias("pearson_a"), pearson(d("rank_a1"), d("rank_a2")).alias("spearman_a"),
    )
