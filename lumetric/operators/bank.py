"""Building a bank: repeats, floors, scores, restriction, resumption, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 40


def cell_counts(administrations: DataFrame) -> DataFrame:
    return administrations.groupBy("model_id", "item_id").agg(F.sum("correct").alias("k"), F.count(F.lit(1)).alias("n"))


def collapse_repeats(administrations: DataFrame) -> DataFrame:
    """Majority answer of each cell, with its count; exact ties are dropped."""
    cells = cell_counts(administrations).where("2 * k <> n")
    return cells.select("model_id", "item_id", (2 * F.col("k") > F.col("n")).cast("int").alias("correct"), "n")


def repeat_agreement(administrations: DataFrame) -> DataFrame:
    """repeated_cells, agreement (1 where none repeats) and tied_cells."""
    repeated = F.col("n") > 1
    agree = F.count_if(repeated & F.col("k").isin(0) | repeated & (F.col("k") == F.col("n")))
    return cell_counts(administrations).agg(
        F.count_if(repeated).alias("repeated_cells"),
        F.coalesce(F.try_divide(agree.cast("double"), F.count_if(repeated)), F.lit(1.0)).alias("agreement"),
        F.count_if(F.col("k") * 2 == F.col("n")).alias("tied_cells"),
    )


def scores(responses: DataFrame) -> DataFrame:
    return responses.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("score"))


def item_floor(responses: DataFrame, least: int = FLOOR) -> DataFrame:
    return responses.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_models")).where(F.col("n_models") >= least)


def restrict(responses: DataFrame, items: DataFrame) -> DataFrame:
    return responses.join(items.select("item_id"), "item_id", "left_semi")


def common_items(responses: DataFrame) -> DataFrame:
    """Items that every model of the frame has answered (relational division)."""
    total = responses.agg(F.count_distinct("model_id").alias("models"))
    each = responses.groupBy("item_id").agg(F.count_distinct("model_id").alias("n_models"))
    return each.join(F.broadcast(total), F.col("n_models") == F.col("models")).select("item_id", "n_models")


def request_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def outstanding(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests whose hash no finished record has."""
    return requests.join(done.select("request_sha256").distinct(), "request_sha256", "left_anti")


def content_hash(table: DataFrame) -> str:
    """A digest of the rows, whatever their order or files: counts and sums of
    row hashes, so nothing is sorted or gathered."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns))), 256)
    parts = table.select(*[F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)").alias(f"h{at}") for at in (1, 13, 25, 37)])
    found = parts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in parts.columns]).first()
    import hashlib

    return hashlib.sha256("|".join(str(x) for x in found).encode()).hexdigest()
