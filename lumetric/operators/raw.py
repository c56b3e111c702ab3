"""Raw evaluation records: run names, instances, per-instance results, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INSTANCE = "id string, input struct<text: string>, references array<struct<output: struct<text: string>, tags: array<string>>>"
RESULT = "instance_id string, stats array<struct<name: struct<name: string>, count: int, mean: double>>"


def run_name(name: Column) -> tuple[Column, Column]:
    """'scenario:k=v,model=m,...' as (scenario key without the model, model)."""
    head, tail = F.substring_index(name, ":", 1), F.when(F.instr(name, ":") > 0, F.substring(name, F.instr(name, ":") + 1, F.lit(1 << 30))).otherwise("")
    parts = F.filter(F.split(tail, ","), lambda x: x != "")
    model = F.get(F.filter(parts, lambda x: x.startswith("model=")), 0)
    rest = F.filter(parts, lambda x: ~x.startswith("model="))
    return F.concat_ws(":", F.array_compact(F.array(head, F.when(F.size(rest) > 0, F.array_join(rest, ","))))), F.regexp_replace(model, "^model=", "")


def responses(results: DataFrame, metric: str) -> DataFrame:
    """instance_id, correct from one binary metric of per-instance results; a value
    that is neither 0 nor 1 is an error."""
    s = results.select("instance_id", F.explode("stats").alias("s")).where((F.col("s.name.name") == metric) & (F.col("s.count") >= 1))
    mean = F.col("s.mean")
    return s.select("instance_id", F.when(mean.isin(0.0, 1.0), mean.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a binary result: "), mean.cast("string")))).alias("correct"))


def instances(rows: DataFrame) -> DataFrame:
    """id, question, options and the answer (of several marked correct, the last)."""
    right = F.filter("references", lambda r: F.array_contains(r["tags"], "correct"))
    return rows.select(
        "id", F.col("input.text").alias("question"), F.transform("references", lambda r: r["output"]["text"]).alias("options"),
        F.get(right, F.size(right) - 1)["output"]["text"].alias("answer"),
    )


MODEL = "name string, info struct<creator: string, access: string>, release_date string"


def models(lines: DataFrame) -> DataFrame:
    """Model records (JSON in value): model_id, creator, access, release_date ('' if unknown)."""
    m = lines.select(F.from_json("value", MODEL).alias("m")).where("m.name is not null")
    return m.select(F.col("m.name").alias("model_id"), F.col("m.info.creator").alias("creator"), F.coalesce("m.info.access", F.lit("closed")).alias("access"), F.coalesce("m.release_date", F.lit("")).alias("release_date"))


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("r_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("r_ = 1").drop("r_")


def candidates(leaderboard: DataFrame) -> DataFrame:
    """Unflagged rows with an average, the best of each repository."""
    usable = leaderboard.where(~F.coalesce("flagged", F.lit(False)) & F.col("average").isNotNull() & F.col("fullname").isNotNull())
    return usable.withColumn("r_", F.row_number().over(W.partitionBy("fullname").orderBy(F.desc("average"), "eval_name"))).where("r_ = 1").drop("r_")


def identities(docs: DataFrame) -> DataFrame:
    """task, doc_id, question, answer_key: an item id from task and question, with
    the key and an occurrence number where a question repeats."""
    q = F.trim(F.regexp_replace("question", r"(?U)\s+", " "))
    rows = docs.withColumn("q_", q)
    rows = rows.withColumn("same_", F.count(F.lit(1)).over(W.partitionBy("task", "q_"))).withColumn("at_", F.row_number().over(W.partitionBy("task", "q_", "answer_key").orderBy("doc_id")))
    extra = F.when(F.col("same_") > 1, F.concat(F.lit("\x1f"), F.col("answer_key"), F.lit("\x1f"), F.col("at_").cast("string"))).otherwise("")
    return rows.select("task", "doc_id", "answer_key", F.substring(F.sha2(F.concat("task", F.lit("\x00"), "q_", extra), 256), 1, 16).alias("item_id"))
