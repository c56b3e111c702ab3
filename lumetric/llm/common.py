"""What the operators of this package share: safe column picking and shared scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every white-space character that separates words, as the contracts define it.
ASCII_SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Folds of the labelled documents, of which one is held out.
FOLDS = 5

_TABLES: dict[str, list[tuple[SparkSession, str]]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def take(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name and position.

    Extra columns never matter, whatever they are called: not even one whose
    name differs by case only, or that repeats a needed name (the first counts).
    """
    at = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(at))])
    return plain.select(*[F.col(f"c{at.index(n)}").alias(n) for n in names])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, salt: int) -> DataFrame:
    """row, text and the label of at most `most` labelled documents outside the held-out
    fold; of rows that share a doc_id, the text with the least hash."""
    rows = take(docs, "doc_id", "text").where(F.col("text").isNotNull())
    marks = take(labels, "doc_id", column).where(F.col(column).isin(0, 1) & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.max(column).alias(column))
    few = marks.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(most)
    one = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id", column).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("best"))
    return one.select(F.col("doc_id").cast("bigint").alias("row"), F.col("best.text").alias("text"), column)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    Only a session that names none (a local one, as in tests) gets a temporary
    folder of its own.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumetric-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, owner: str, label: str) -> str:
    """A new path in the shared folder, forgotten and removed with its owner."""
    path = f"{shared_dir(spark)}/lumetric/{label}-{uuid.uuid4().hex}"
    _TABLES.setdefault(owner, []).append((spark, path))
    return path


def shared_table(df: DataFrame, owner: str, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and gives the next join real sizes."""
    path = shared_path(df.sparkSession, owner, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(owner: str) -> None:
    """Remove an owner's scratch tables; for when its result has been written."""
    for spark, path in _TABLES.pop(owner, []):
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001 - a session that has ended takes its folder along
            continue


@atexit.register
def _release_all() -> None:
    for owner in list(_TABLES):
        release(owner)
