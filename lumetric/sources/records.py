"""Administration records, banks and suites on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.bank import content_hash

RECORD = (
    "cell string, item_id string, alias string, benchmark string, kind string, template string, rotation int, key string, parsed string, "
    "correct int, unparsed boolean, reply string, cost_usd double, input_tokens bigint, output_tokens bigint, model_returned string, "
    "ledger_id bigint, error string, request_sha256 string, finish_reason string, cached boolean, retryable boolean, "
    "settings struct<temperature: double, max_tokens: int, system_sha256: string>"
)

RECORDS_A_FILE = 500_000


def append_records(rows: DataFrame, path: str) -> None:
    """JSON lines in gzip: most of a record is names and hex digits. One task reads a file, so files end by records."""
    rows.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that isn't whole (a writer was stopped) is dropped."""
    read = F.from_json("value", RECORD + ", corrupt_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_"})
    rows = spark.read.text(path).where("trim(value) <> ''").select(read.alias("r"))
    return rows.where(F.col("r.corrupt_").isNull()).select("r.*").drop("corrupt_")


def panel(records: DataFrame, suite: DataFrame) -> DataFrame:
    """The suite's cells with an answer; of repeated cells the last record counts."""
    known = records.join(suite.select("item_id"), "item_id", "left_semi").where("correct is not null")
    last = W.partitionBy("alias", "item_id").orderBy(F.desc("ledger_id"), F.desc("request_sha256"))
    return known.withColumn("r", F.row_number().over(last)).where("r = 1").select(F.col("alias").alias("model_id"), "item_id", "correct", "cost_usd")


def supersede(records: DataFrame, aliases: list[str]) -> DataFrame:
    """All records but those of the given aliases."""
    return records.where(~F.col("alias").isin(*aliases))


def save_bank(spark: SparkSession, path: str, version: str, responses: DataFrame, items: DataFrame, models: DataFrame) -> dict:
    """Three Parquet tables and a manifest with a digest of their rows."""
    root = f"{path}/{version}"
    tables = {"responses": responses, "items": items, "models": models}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    manifest = {"version": version, "hash": {n: content_hash(spark.read.parquet(f"{root}/{n}.parquet")) for n in tables}, "rows": {n: spark.read.parquet(f"{root}/{n}.parquet").count() for n in tables}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")
    return manifest


def load_bank(spark: SparkSession, path: str, version: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables; raises if their rows aren't those the manifest names."""
    root = f"{path}/{version}"
    manifest = json.loads(spark.read.text(f"{root}/manifest").first()["value"])
    tables = {n: spark.read.parquet(f"{root}/{n}.parquet") for n in manifest["hash"]}
    for name, df in tables.items() if verify else ():
        if content_hash(df) != manifest["hash"][name]:
            raise ValueError(f"{name} isn't the table that the manifest of {version} names")
    return tables


def matching_params(params: DataFrame, items: DataFrame) -> DataFrame:
    """Parameters of exactly the bank's items; raises if either has others."""
    missing = items.join(params, "item_id", "left_anti").limit(1).count()
    strange = params.join(items, "item_id", "left_anti").limit(1).count()
    if missing or strange:
        raise ValueError("parameters and bank don't have the same items")
    return params


def latest(dated: DataFrame, column: str = "date") -> DataFrame:
    """The rows of the latest date (ISO strings compare as dates)."""
    return dated.join(F.broadcast(dated.agg(F.max(column).alias(column))), column, "left_semi")


def supersede_file(spark: SparkSession, source: str, target: str, aliases: list[str]) -> None:
    """A copy of a log without the given aliases; the old one stays as it is."""
    append_records(supersede(read_records(spark, source), aliases), target)


def save_prices(rows: DataFrame, path: str) -> None:
    """rows: date and prices; a folder for each date."""
    rows.write.mode("append").partitionBy("date").json(path)


def latest_prices(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest date: dates are folders, so no other file is opened."""
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").json(path).withColumn("date", F.col("date").cast("string"))
    return rows.where(F.col("date") == rows.agg(F.max("date")).first()[0])


def versions(spark: SparkSession, path: str) -> list[str]:
    """The bank versions under a path: the folders that hold a manifest."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*/manifest"))
    return sorted(f.getPath().getParent().getName() for f in found or ())


def save_fit(spark: SparkSession, path: str, version: str, kind: str, params: DataFrame, abilities: DataFrame) -> None:
    """Parameters and abilities beside their bank, with the digest of the bank's items they are for."""
    root = f"{path}/{version}"
    params.write.mode("overwrite").parquet(f"{root}/params-{kind}.parquet")
    abilities.write.mode("overwrite").parquet(f"{root}/abilities-{kind}.parquet")
    items = json.loads(spark.read.text(f"{root}/manifest").first()["value"])["hash"]["items"]
    spark.createDataFrame([(json.dumps({"kind": kind, "items": items}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/fit-{kind}")


def load_fit(spark: SparkSession, path: str, version: str, kind: str, items: DataFrame) -> dict[str, DataFrame]:
    """Raises if the fit is for other items than the bank's present ones."""
    root = f"{path}/{version}"
    said = json.loads(spark.read.text(f"{root}/fit-{kind}").first()["value"])
    if said["items"] != json.loads(spark.read.text(f"{root}/manifest").first()["value"])["hash"]["items"]:
        raise ValueError(f"the {kind} fit of {version} is for other items")
    return {"params": matching_params(spark.read.parquet(f"{root}/params-{kind}.parquet"), items), "abilities": spark.read.parquet(f"{root}/abilities-{kind}.parquet")}


def save_dependence(blocks: DataFrame, path: str, version: str) -> None:
    """blocks: benchmark and the item_ids of each dependent block."""
    blocks.write.mode("overwrite").json(f"{path}/{version}/dependence")


def dependence_index(spark: SparkSession, path: str, version: str) -> DataFrame:
    """item_id and the number of its block within its benchmark."""
    rows = spark.read.schema("benchmark string, items array<bigint>").json(f"{path}/{version}/dependence")
    rows = rows.withColumn("block", F.row_number().over(W.partitionBy("benchmark").orderBy(F.desc(F.size("items")), F.get("items", 0))))
    return rows.select("benchmark", "block", F.explode("items").alias("item_id"))


def save_suite(suite: DataFrame, path: str, version: str, name: str) -> None:
    suite.select("benchmark", "item_id").coalesce(1).write.mode("overwrite").json(f"{path}/{version}/suite-{name}")


def load_suite(spark: SparkSession, path: str, version: str, name: str) -> DataFrame:
    return spark.read.schema("benchmark string, item_id bigint").json(f"{path}/{version}/suite-{name}")


def save_packed(responses: DataFrame, models: DataFrame, path: str) -> None:
    """A row for each item: its answers in the order of the models' ids, a character each
    (0, 1, or 2 for none)."""
    places = models.select("model_id", (F.row_number().over(W.orderBy("model_id")) - 1).alias("place"))
    places.write.mode("overwrite").parquet(f"{path}/models")
    n = places.count()
    answers = F.map_from_entries(F.collect_list(F.struct("place", "correct")))
    held = responses.join(places, "model_id").groupBy("item_id").agg(answers.alias("m"))
    packed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i).cast("string"), F.lit("2"))), "")
    held.select("item_id", packed.alias("answers")).write.mode("overwrite").parquet(f"{path}/answers")


def load_packed(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/answers").select("item_id", F.posexplode(F.split("answers", "")).alias("place", "x")).where("x in ('0', '1')")
    return rows.join(spark.read.parquet(f"{path}/models"), "place").select("model_id", "item_id", F.col("x").cast("int").alias("correct"))
