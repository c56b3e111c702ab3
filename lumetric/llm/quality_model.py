"""Quality classifier: document evidence and hierarchical empirical Bayes by site.

A logistic model on features of the text gives each document its evidence, as
log odds at the global base rate. The corpus is then summed by path (a section of
a host) and by host, and both levels' rates are shrunk: a host's towards the
global rate, a path's towards its host's, each by a strength that the spread of
the groups' means shows (method of moments). A document's score replaces the
global prior odds in its evidence by its path's, from which the document itself
is left out, so a sparse site says little and a single page nothing.

Scale: the text is read once; evidence is stored as a narrow table. Group sums
are partial sums; paths are joined back broadcast if their counted number is
within BROADCAST_PATHS, else as two stored tables that adaptive execution can
split at a hot host.

Learned on at most MOST_LABELLED labelled documents outside the held-out fold
(crc32(doc_id) mod 5 = 0). For `documents`, the host is source and the path lang.

Defined results
    null or empty text   features of an empty text
    null host or path    a group of its own
    very long text       whole text
    repeated rows        each counts; of rows that share a labelled doc_id one text is
                         learned from
    null doc_id          not held out
    null label           not learned from
    no usable labels     evidence 0 everywhere
    empty tables         empty result
    other columns        ignored
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled, read, shared_table, take

MOST_LABELLED = 8_000
BROADCAST_PATHS = 100_000
#: Bounds of the shrinkage strengths, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0
OWNER = "quality_model"
N_FEATURES = 12
_SYMBOLS = bytes(b if chr(b) in "#*$%&|<>{}[]\\^~@_=+" else 0 for b in range(256))
_DROP = bytes(b for b in range(256) if not _SYMBOLS[b])


def text_features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    raw = text.encode("utf-8", "surrogatepass")
    symbols = len(raw.translate(None, _DROP))
    upper = sum(map(str.isupper, words))
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    size = max(n, 1)
    return [
        math.log1p(n),
        math.log1p(distinct) - math.log1p(n),
        pairs / max(n - 1, 1),
        min(symbols / size, 3.0),
        upper / size,
        min(raw.count(b"!") / size, 2.0),
        min((chars - text.count(" ")) / size, 30.0) / 10,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        min(ends / size, 1.0),
        min(sum(map(str.isdigit, words)) / size, 1.0),
        min(math.log1p(max(map(len, words), default=0)), 8.0),
        float(n < 50),
    ]


class Evidence:
    """Standardised logistic model with squares; log odds at the base rate."""

    def __init__(self) -> None:
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.weights, self.base = np.zeros(1 + 2 * N_FEATURES), 0.0

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.ones(len(z)), z, z * z]

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Evidence:
        if len(y) and 0 < y.sum() < len(y):
            self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
            a, w = self.design(x), self.weights
            penalty = np.r_[1e-3, np.full(a.shape[1] - 1, ridge)]
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
                w = w + np.clip(step, -3, 3)
                if np.abs(step).max() < 1e-8:
                    break
            self.weights = w
            self.base = float(np.log(y.mean() / (1 - y.mean())))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -12, 12)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Evidence:
    """Features are computed where the texts are; the driver gets these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([text_features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["row", "quality", "x"])

    sample = labelled(docs, labels, "quality", most, 7).withColumn("quality", F.col("quality").cast("bigint"))
    held = sorted(zip(*[c.to_pylist() for c in sample.mapInArrow(run, "row bigint, quality bigint, x array<double>").toArrow().columns], strict=True))
    return Evidence().fit(np.array([x for *_, x in held]).reshape(-1, N_FEATURES), np.array([y for _, y, _ in held], float))


def evidence(docs: DataFrame, model: Evidence, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, log_odds for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t.as_py()) for t in b.column(3)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(shared.value.log_odds(x))], ["doc_id", "host", "path", "log_odds"])

    rows = take(docs, "doc_id", host, path, "text").toDF("doc_id", "host", "path", "text")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"), "text")
    return rows.mapInArrow(run, "doc_id bigint, host string, path string, log_odds double")


def strength(groups: DataFrame, base: float) -> float:
    """How many documents a group's prior counts as, from the spread of group
    means: groups has n and good (summed probability)."""
    usable = groups.where("n >= 2").select("n", (F.col("good") / F.col("n")).alias("m"))
    row = usable.agg(
        F.count(F.lit(1)).alias("k"),
        F.avg(F.pow(F.col("m") - F.lit(base), 2)).alias("spread"), F.avg(1 / F.col("n")).alias("inverse"),
    ).first()
    if not row["k"] or row["k"] < 2:
        return MOST_STRENGTH
    within = base * (1 - base)
    between = max(row["spread"] - within * row["inverse"], 1e-9)
    return float(min(max(within / between - 1, LEAST_STRENGTH), MOST_STRENGTH))


def posterior(docs: DataFrame, model: Evidence, host: str = "source", path: str = "lang", broadcast_paths: int = BROADCAST_PATHS, owner: str = OWNER) -> DataFrame:
    """doc_id, evidence (log odds), host_rate, path_rate (shrunk, without the
    document itself) and score for every row."""
    rows = shared_table(evidence(docs, model, host, path), owner, "evidence")
    good = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = shared_table(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good")), owner, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    if not total["n"]:
        return rows.select("doc_id", F.col("log_odds").alias("evidence"), F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate"), F.lit(0.5).alias("score"))
    base = min(max(total["good"] / total["n"], 1e-4), 1 - 1e-4)
    k_host, k_path = strength(hosts, base), strength(paths, base)
    sums = paths.withColumnsRenamed({"n": "n_path", "good": "good_path"}).join(
        hosts.select(F.col("host").alias("h_"), F.col("n").alias("n_host"), F.col("good").alias("good_host")), F.col("host").eqNullSafe(F.col("h_"))
    )
    sums = sums.select(F.col("host").alias("host_"), F.col("path").alias("path_"), "n_path", "good_path", "n_host", "good_host")
    sums = shared_table(sums, owner, "sums")
    if sums.count() <= broadcast_paths:
        sums = F.broadcast(sums)
    joined = rows.join(sums, rows["host"].eqNullSafe(F.col("host_")) & rows["path"].eqNullSafe(F.col("path_")))
    rated = joined.select("doc_id", "log_odds", good.alias("own"), "n_path", "good_path", "n_host", "good_host")
    rated = rated.withColumn("host_rate", (k_host * base + F.greatest(F.col("good_host") - F.col("own"), F.lit(0.0))) / (k_host + F.col("n_host") - 1))
    rated = rated.withColumn("path_rate", (k_path * F.col("host_rate") + F.greatest(F.col("good_path") - F.col("own"), F.lit(0.0))) / (k_path + F.col("n_path") - 1))
    rate = F.least(F.greatest("path_rate", F.lit(1e-4)), F.lit(1 - 1e-4))
    z = F.col("log_odds") - F.lit(model.base) + F.ln(rate / (1 - rate))
    return rated.select("doc_id", F.col("log_odds").alias("evidence"), "host_rate", "path_rate", (1 / (1 + F.exp(-z))).alias("score"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = posterior(docs, learn(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))
