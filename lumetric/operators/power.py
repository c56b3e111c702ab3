"""How many items a decision needs: information, power, budgets, early stopping."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.irt import erfc, information, p_correct

SLOPE_STEP, LEAST_PAIRS = 0.05, 20


def upper_tail(z: Column) -> Column:
    """1 - the normal distribution function."""
    half = erfc(F.abs(z) / math.sqrt(2)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def prefix_information(params: DataFrame, ability: float = 0.0) -> DataFrame:
    """Items by information at an ability, and the mean information of the best n."""
    i = information(F.lit(ability), F.col("a"), F.col("b"), F.col("c"))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("information"), "item_id")
    return params.select("item_id", i.alias("information")).select("item_id", "information", F.row_number().over(order).cast("bigint").alias("n"), F.avg("information").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("mean_information"))


def slope(params: DataFrame, ability: float = 0.0, step: float = SLOPE_STEP) -> DataFrame:
    """How fast the expected score rises with ability."""
    up, down = (p_correct(F.lit(ability + s), F.col("a"), F.col("b"), F.col("c")) for s in (step, -step))
    return params.agg((F.avg(up - down) / (2 * step)).alias("slope"))


def power_grid(params: DataFrame, effects: DataFrame, ability: float = 0.0, alpha: float = 0.05, paired: bool = True) -> DataFrame:
    """Power to tell models `effect` points apart with the best n items, for every n."""
    k, z = (2 if paired else 1), NormalDist().inv_cdf(1 - alpha / 2)
    grid = prefix_information(params, ability).crossJoin(F.broadcast(effects)).crossJoin(F.broadcast(slope(params, ability)))
    shift = F.col("effect") / 100 / F.col("slope") / F.sqrt(k / (F.col("n") * F.col("mean_information")))
    return grid.select("effect", "n", (upper_tail(z - shift) + upper_tail(z + shift)).alias("power"))


@dataclass(frozen=True)
class Resolution:
    """What a bank shows at one ability: the mean information of its best n items, for every
    n, and how fast its expected score rises."""

    means: list[float]
    rise: float

    @classmethod
    def of(cls, params: DataFrame, ability: float = 0.0) -> Resolution:
        """Sorted on the executors; a double for each item comes to the driver."""
        means = [r["mean_information"] for r in prefix_information(params, ability).select("n", "mean_information").orderBy("n").toLocalIterator()]
        return cls(means, slope(params, ability).first()["slope"])

    def information(self, n: int) -> float:
        return max(self.means[min(n, len(self.means)) - 1], 1e-9)

    def items_needed(self, effect: float, power: float = 0.8, alpha: float = 0.05, paired: bool = True, max_items: int | None = None, rounds: int = 12) -> tuple[int, bool]:
        """Items to see `effect` accuracy points, and whether the bank (or max_items) caps
        them: the fixed point of n and the information of the best n."""
        if not 0 < power < 1 or effect <= 0:
            raise ValueError("power must be between 0 and 1, the effect above 0")
        if self.rise <= 1e-6:
            raise ValueError("the expected score doesn't rise at this ability")
        z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
        n = 50
        for _ in range(rounds):
            new = max(math.ceil((2 if paired else 1) * z * z / ((effect / 100 / self.rise) ** 2 * self.information(n))), 1)
            if new == n:
                break
            n = new
        most = max_items or len(self.means)
        return min(n, most), n > most

    def detectable_effect(self, n: int, power: float = 0.8, alpha: float = 0.05, paired: bool = True) -> float:
        """The smallest drop, in accuracy points, that n items show."""
        z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
        return 100 * self.rise * z * math.sqrt((2 if paired else 1) / (n * self.information(n)))

    def power_at(self, n: int, effect: float, alpha: float = 0.05, paired: bool = True) -> float:
        if self.rise <= 1e-6:
            return math.nan
        shift = effect / 100 / self.rise / math.sqrt((2 if paired else 1) / (n * self.information(n)))
        z, normal = NormalDist().inv_cdf(1 - alpha / 2), NormalDist()
        return normal.cdf(shift - z) + normal.cdf(-z - shift)


def items_needed(params: DataFrame, effect: float, power: float = 0.8, ability: float = 0.0, alpha: float = 0.05, paired: bool = True, max_items: int | None = None) -> int:
    return Resolution.of(params, ability).items_needed(effect, power, alpha, paired, max_items)[0]


def detectable_effect(params: DataFrame, n: int, power: float = 0.8, ability: float = 0.0, alpha: float = 0.05, paired: bool = True) -> float:
    return Resolution.of(params, ability).detectable_effect(n, power, alpha, paired)


def power_at(params: DataFrame, n: int, effect: float, ability: float = 0.0, alpha: float = 0.05, paired: bool = True) -> float:
    return Resolution.of(params, ability).power_at(n, effect, alpha, paired)


def equivalent_budget(curve: DataFrame, method: str, baseline: str) -> DataFrame:
    """For each budget of a method, the baseline budget that first reaches its
    value, by linear interpolation; null where it never does."""
    order = W.partitionBy("method").orderBy("n")
    base = curve.where(F.col("method") == baseline).withColumn("n0", F.lag("n").over(order)).withColumn("v0", F.lag("value").over(order)).select(F.col("n").alias("n1"), "n0", F.col("value").alias("v1"), "v0")
    mine = curve.where(F.col("method") == method).select("n", "value")
    hit = F.col("v1") >= F.col("value")
    place = F.when(F.col("n0").isNull() | (F.col("v0") >= F.col("value")), F.col("n1").cast("double")).otherwise(F.col("n0") + (F.col("value") - F.col("v0")) / (F.col("v1") - F.col("v0")) * (F.col("n1") - F.col("n0")))
    return mine.crossJoin(F.broadcast(base)).groupBy("n").agg(F.min_by(F.when(hit, place), F.when(hit, F.col("n1"))).alias("equivalent"))


def separated_pairs(intervals: DataFrame) -> DataFrame:
    """Pairs of models whose intervals don't overlap; the leader by theta."""
    left = intervals.select(F.col("model_id").alias("leader"), F.col("theta").alias("t1"), F.col("lo").alias("lo1"))
    right = intervals.select(F.col("model_id").alias("other"), F.col("theta").alias("t2"), F.col("hi").alias("hi2"))
    return left.join(right, (F.col("lo1") > F.col("hi2")) & (F.col("t1") > F.col("t2"))).select("leader", "other")


def power_validation(models: DataFrame, width: float = 0.5) -> DataFrame:
    """models: model_id, theta, score. By band of the true gap, how often the score
    orders a pair rightly; bands of LEAST_PAIRS pairs."""
    left = models.select(F.col("model_id").alias("m1"), F.col("theta").alias("t1"), F.col("score").alias("s1"))
    right = models.select(F.col("model_id").alias("m2"), F.col("theta").alias("t2"), F.col("score").alias("s2"))
    both = left.join(right, F.col("m1") < F.col("m2")).withColumn("gap", F.col("t1") - F.col("t2"))
    return (
        both.groupBy(F.floor(F.abs("gap") / width + 1e-9).alias("band"))
        .agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.signum("gap") == F.signum(F.col("s1") - F.col("s2"))).cast("int")).alias("right_order"))
        .where(F.col("pairs") >= LEAST_PAIRS)
    )
