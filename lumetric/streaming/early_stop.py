"""Comparing two models as their answers arrive: a pair stops when its intervals part.

The state of a pair is the two log posteriors, how many items both have answered, and
whether it has been decided; a decided pair takes no more answers. Within a micro-batch
items are taken in the order of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernels import em
from ..plans.fitting import checked

OUT = "pair bigint, separated boolean, leader string, items bigint, theta_a double, theta_b double"
LEVEL = 0.95


def interval(post: np.ndarray, x: np.ndarray, level: float = LEVEL) -> tuple[float, float]:
    """Equal-tailed, by linear interpolation of the distribution function."""
    low, high = np.interp([(1 - level) / 2, (1 + level) / 2], np.cumsum(post), x)
    return float(low), float(high)


def running_decisions(answers: DataFrame, params: DataFrame) -> DataFrame:
    p = params.orderBy("item_id").toPandas()
    checked(40 * len(p), "item parameters")
    x, lw = em.quadrature()
    prob = em.probability(x, p["a"].to_numpy(), -(p["a"] * p["b"]).to_numpy(), p["c"].to_numpy())
    shared = answers.sparkSession.sparkContext.broadcast(({i: k for k, i in enumerate(p["item_id"])}, np.log(prob), np.log(1 - prob)))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, right, wrong = shared.value
        a, b, n, decided = (np.array(state.get[0]), np.array(state.get[1]), state.get[2], state.get[3]) if state.exists else (lw.copy(), lw.copy(), 0, False)
        if decided:
            return
        held = pd.concat(list(frames)).drop_duplicates("item_id").sort_values("item_id")
        for item, ya, yb in zip(held["item_id"], held["correct_a"], held["correct_b"], strict=True):
            if item not in place:
                continue
            k, n = place[item], n + 1
            a, b = a + (right if ya else wrong)[k], b + (right if yb else wrong)[k]
            posts = [np.exp(z - z.max()) / np.exp(z - z.max()).sum() for z in (a, b)]
            (lo_a, hi_a), (lo_b, hi_b) = (interval(q, x) for q in posts)
            decided = lo_a > hi_b or lo_b > hi_a
            if decided:
                break
        state.update((a.tolist(), b.tolist(), n, bool(decided)))
        if not n:
            return
        thetas = [float(q @ x) for q in posts]
        leader = ("a" if thetas[0] > thetas[1] else "b") if decided else None
        yield pd.DataFrame([(key[0], bool(decided), leader, n, *thetas)], columns=["pair", "separated", "leader", "items", "theta_a", "theta_b"])

    return answers.groupBy("pair").applyInPandasWithState(update, OUT, "a array<double>, b array<double>, n bigint, decided boolean", "append", GroupStateTimeout.NoTimeout)


def decisions(spark: SparkSession, path: str, params: DataFrame, out: str, checkpoint: str, files: int = 4) -> DataFrame:
    """Runs the stream over what is at path and returns each pair's last word."""
    answers = spark.readStream.schema("pair bigint, item_id bigint, correct_a int, correct_b int").option("maxFilesPerTrigger", files).json(path)
    run = running_decisions(answers, params).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.schema(OUT).parquet(out).groupBy("pair").agg(F.max_by(F.struct("separated", "leader", "items", "theta_a", "theta_b"), "items").alias("r"))
    return last.select("pair", "r.*")
