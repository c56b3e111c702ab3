"""From raw documents to token digests, in five stages.

    quality_rules     documents that a rule rejects go
    line_dedup        boilerplate lines go, documents stay
    near_dedup        one document of each near-duplicate group stays, the smallest doc_id
    decontamination   documents that hold a benchmark item go
    byte_bpe          the last: doc_id, n_tokens, ids_sha256, decoded_sha256

Every stage works on all rows its predecessor kept, which come as a Parquet
table; all but the last return the columns of documents, n_chars following the
text. Scratch tables of a stage are removed when the next one begins, by when
its result has been written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumetric.llm import bpe, decontamination, line_dedup, near_text, quality_rules
from lumetric.llm.common import read, release, shared_table, take

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OWNER = "corpus_pipeline"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(OWNER)
    return quality_rules.keep_good(docs, COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(OWNER)
    out = line_dedup.clean(docs, COLUMNS, owner=OWNER)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The stage's rows with a key of their own, stored so that it can't change."""
    return shared_table(take(docs, *COLUMNS).withColumn("row_", F.monotonically_increasing_id()), OWNER, "keyed")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id stays of every group that 5-word shingles with
    a Jaccard of 0.8 or more connect; a row without a doc_id only where its whole
    group has none.

    Texts don't move for the decision: the keys of the rows that go are broadcast if
    their counted number is within the bound, and joined as a stored table beyond it.
    """
    release(OWNER)
    rows = keyed(docs)
    groups = shared_table(near_text.near_groups(rows, OWNER), OWNER, "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = shared_table(best.select("root", F.col("best.row_").alias("best")), OWNER, "best")
    gone = shared_table(groups.join(best, "root").where("row_ <> best").select("row_"), OWNER, "gone")
    return rows.join(near_text.few(gone), "row_", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item go; another row of the same doc_id, or without one, stays."""
    release(OWNER)
    rows = keyed(docs)
    found = decontamination.contaminated(rows.select(F.col("row_").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"), owner=OWNER)
    bad = shared_table(found.select(F.col("doc_id").alias("row_")).distinct(), OWNER, "bad")
    return rows.join(near_text.few(bad), "row_", "left_anti").select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(OWNER)
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: XXH64 fingerprints, alignments and byte-pair merges aren't SQL; tests/llm holds
#: the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's table goes when its successor's is written."""
    docs, held = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        owner = f"{OWNER}-{name}-{uuid.uuid4().hex}"
        docs = shared_table(stage(spark, docs, sf_dir), owner, name)
        if held:
            release(held)
        held = owner
    return STAGES[-1][1](spark, docs, sf_dir)
