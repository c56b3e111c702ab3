"""Abilities so far, as answers arrive: a stateful stream over answer files.

The state of a model is its log posterior on the nodes, how many answers it holds, and
a bit for each item of the bank it has answered: its size is the bank's, however long
the stream runs. Updates add, so late and out-of-order answers change nothing, an item's
first answer counts, and the last state of a model equals batch scoring of the same
answers.
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

OUT = "model_id bigint, theta double, se double, n bigint"


def answers_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("model_id bigint, item_id bigint, correct int, request_sha256 string").option("maxFilesPerTrigger", 4).json(path)


def running_abilities(answers: DataFrame, params: DataFrame) -> DataFrame:
    """A row for each model and micro-batch that brought it answers."""
    p = params.orderBy("item_id").toPandas()
    checked(40 * len(p), "item parameters")
    x, lw = em.quadrature()
    place = {i: k for k, i in enumerate(p["item_id"])}
    prob = em.probability(x, p["a"].to_numpy(), -(p["a"] * p["b"]).to_numpy(), p["c"].to_numpy())
    shared = answers.sparkSession.sparkContext.broadcast((place, np.log(prob), np.log(1 - prob), x, lw))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, right, wrong, x, lw = shared.value
        log, n = (np.array(state.get[0]), state.get[1]) if state.exists else (lw.copy(), 0)
        seen = np.unpackbits(np.frombuffer(state.get[2], np.uint8)).astype(bool) if state.exists else np.zeros(-(-len(place) // 8) * 8, bool)
        for f in frames:
            for item, correct in zip(f["item_id"], f["correct"], strict=True):
                if item in place and not seen[place[item]]:
                    seen[place[item]] = True
                    log = log + (right if correct else wrong)[place[item]]
                    n += 1
        state.update((log.tolist(), n, np.packbits(seen).tobytes()))
        e = np.exp(log - log.max())
        post = e / e.sum()
        theta = float(post @ x)
        yield pd.DataFrame([(key[0], theta, float(np.sqrt(max(post @ (x * x) - theta * theta, 0))), n)], columns=["model_id", "theta", "se", "n"])

    return answers.groupBy("model_id").applyInPandasWithState(update, OUT, "log array<double>, n bigint, seen binary", "append", GroupStateTimeout.NoTimeout)


def final_abilities(spark: SparkSession, path: str, params: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what is at path and returns each model's last row."""
    query = running_abilities(answers_stream(spark, path), params).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(OUT).parquet(out)
    return rows.groupBy("model_id").agg(F.max_by("theta", "n").alias("theta"), F.max_by("se", "n").alias("se"), F.max("n").alias("n"))
