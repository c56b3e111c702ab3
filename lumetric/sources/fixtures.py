"""The driver's tables as a response bank: models answer items under planted parameters.

A model is a customer number modulo MODELS, an item a part number modulo the
view's item count; whether an answer is right is an md5 uniform against the
planted two-parameter model. Every function returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored

MODELS, ITEMS, DENSE_ITEMS = 150, 200, 60
NODES, SPAN = 61, 4.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(*parts: Column | str) -> Column:
    """A double in [0, 1) from the md5 of the parts joined by '|'."""
    key = F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def theta_true(model: Column) -> Column:
    return (model * 53 % MODELS) / F.lit(float(MODELS)) * 4 - 2


def a_true(item: Column, items: int) -> Column:
    return F.lit(0.4) + (item * 17 % items) / F.lit(float(items)) * 1.6


def b_true(item: Column, items: int) -> Column:
    return (item * 37 % items) / F.lit(float(items)) * 3 - 1.5


_BANKS: dict[tuple, DataFrame] = {}

#: What numbers the administrations of a cell; lines that agree in all of it are alike.
ORDER = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate", "l_tax")
#: Of these alone depends whether an answer is right.
GRADED_BY = ORDER[:2]


def once(spark: SparkSession, sf_dir: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, computed once for each application and a stored table from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _BANKS:
        _BANKS[key] = stored(make(), label)
    return spark.read.schema(_BANKS[key].schema).parquet(*_BANKS[key].inputFiles())


def lines(spark: SparkSession, sf_dir: str, items: int) -> DataFrame:
    """model_id, item_id and the columns of ORDER, a row for each line.

    Only the columns that a reader takes travel, and both sides are dealt by the
    order's key at every size: the bytes grow with the input, without a step where
    the orders get too large for a broadcast."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % items).alias("item_id"), *ORDER)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % MODELS).alias("model_id"))
    return rows.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def correct(items: int) -> Column:
    model, item = F.col("model_id"), F.col("item_id")
    p = 1 / (1 + F.exp(-(a_true(item, items) * (theta_true(model) - b_true(item, items)))))
    return (uniform(model, item, *GRADED_BY) < p).cast("int").alias("correct")


def described(rows: DataFrame, items: int, *more: str) -> DataFrame:
    """Lines as administrations, with these columns more."""
    return rows.select(
        "model_id", "item_id", *more, correct(items),
        F.col("l_returnflag").alias("template"),
        (F.col("l_linenumber") % 4).alias("rotation"),
        (F.col("l_extendedprice") * F.col("l_tax") / F.lit(1e6)).alias("cost_usd"),
        F.col("l_shipdate").alias("ts"),
    )


def numbered(rows: DataFrame, order: tuple[str, ...] = ORDER, by: tuple[str, ...] = ("model_id", "item_id")) -> DataFrame:
    """rep, from 1. Where only the first are kept, a task sends no more than those of its own."""
    return rows.withColumn("rep", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def answers(spark: SparkSession, sf_dir: str, items: int = ITEMS) -> DataFrame:
    """All administrations without their numbers, for what counts them: not stored."""
    return described(lines(spark, sf_dir, items), items)


def administrations(spark: SparkSession, sf_dir: str, items: int = ITEMS) -> DataFrame:
    """model_id, item_id, rep (from 1), correct, template, rotation, cost_usd, ts of all
    administrations, for what needs each one's number: not stored.

    A cell's lines of one order lie together after the join, so they are placed there; what
    travels to its cell is the order's key, the place and the columns a reader takes."""
    of_order = W.partitionBy("l_orderkey", "model_id", "item_id").orderBy(*ORDER[1:])
    placed = lines(spark, sf_dir, items).withColumn("place", F.row_number().over(of_order))
    rows = numbered(described(placed, items, "l_orderkey", "place"), ("l_orderkey", "place"))
    return rows.select("model_id", "item_id", "rep", "correct", "template", "rotation", "cost_usd", "ts")


def first_answers(spark: SparkSession, sf_dir: str, items: int = ITEMS) -> DataFrame:
    """The administrations with rep 1 and 2."""
    return once(spark, sf_dir, f"first-{items}", lambda: described(numbered(lines(spark, sf_dir, items)).where("rep <= 2"), items, "rep"))


def first_of(spark: SparkSession, sf_dir: str, arm: str) -> DataFrame:
    """model_id, item_id, the arm (template or rotation) and correct: the first answer of each."""
    value = {"template": F.col("l_returnflag"), "rotation": F.col("l_linenumber") % 4}[arm]
    by = ("model_id", "item_id", arm)
    rows = lines(spark, sf_dir, ITEMS).select("model_id", "item_id", value.alias(arm), *GRADED_BY)
    return once(spark, sf_dir, f"first-{arm}", lambda: numbered(rows, GRADED_BY, by).where("rep = 1").select(*by, correct(ITEMS)))


def responses_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first administration of each cell of 150 x 60."""
    rows = lines(spark, sf_dir, DENSE_ITEMS).select("model_id", "item_id", *GRADED_BY)
    return once(spark, sf_dir, "dense", lambda: numbered(rows, GRADED_BY).where("rep = 1").select("model_id", "item_id", correct(DENSE_ITEMS)))


def items(spark: SparkSession, n: int = ITEMS) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        i.alias("item_id"), F.concat(F.lit("b"), (i % 5).cast("string")).alias("benchmark"),
        F.when(i % 5 == 4, "free_response").otherwise("multiple_choice").alias("kind"),
    )


def params(spark: SparkSession, n: int = ITEMS, guessing: bool = False) -> DataFrame:
    i = F.col("id")
    c = (i * 13 % n) / F.lit(float(n)) * 0.25 if guessing else F.lit(0.0)
    return spark.range(n).select(i.alias("item_id"), a_true(i, n).alias("a"), b_true(i, n).alias("b"), c.alias("c"))


def abilities(spark: SparkSession) -> DataFrame:
    return spark.range(MODELS).select(F.col("id").alias("model_id"), theta_true(F.col("id")).alias("theta"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, access and the month-resolved release_date."""
    m = F.col("o_custkey") % MODELS
    seen = table(spark, sf_dir, "orders").groupBy(m.alias("model_id")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("release_date"))
    access = F.element_at(F.array(F.lit("open"), F.lit("limited"), F.lit("closed")), (F.col("model_id") % 3 + 1).cast("int"))
    return seen.select("model_id", access.alias("access"), "release_date")


def quadrature(spark: SparkSession, points: int = NODES, span: float = SPAN) -> DataFrame:
    """q, x, lw: normal nodes and log weights."""
    import math

    total = sum(math.exp(-((-span + 2 * span * q / (points - 1)) ** 2) / 2) for q in range(points))
    x = F.lit(-span) + F.lit(2 * span / (points - 1)) * F.col("id")
    return spark.range(points).select(F.col("id").alias("q"), x.alias("x"), (-(x * x) / 2 - F.lit(math.log(total))).alias("lw"))
